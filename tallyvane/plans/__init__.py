"""All-company jobs: each chains operators into one lazy plan."""
