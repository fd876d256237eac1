"""Documents in no known language."""

import random

import corpus_pipeline
from tests.llm.test_operators import prose


def test_documents_in_no_known_language_are_dropped(spark, documents, as_folder):
    rng = random.Random(3)
    rows = [(i, prose(rng, 60), "x", "s") for i in range(40)]
    rows += [(100 + i, " ".join("".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω") for _ in range(6)) for _ in range(80)), None, "s") for i in range(20)]
    folder = as_folder(documents=documents(rows), benchmark=spark.createDataFrame([], "item_id bigint, text string"))
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()}
    assert kept >= set(range(40)) and len(kept) <= 41
