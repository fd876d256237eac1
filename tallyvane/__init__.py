"""tallyvane: market-research analytics as lazy Spark DataFrame operators."""
