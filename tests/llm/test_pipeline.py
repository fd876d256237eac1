"""The corpus pipeline on a small folder, stage by stage."""

import random

import corpus_pipeline
from tests.llm.test_operators import WORDS, prose


def test_pipeline_stages(spark, documents, as_folder):
    rng = random.Random(8)
    item = prose(rng, 30)
    rows = [(i, prose(rng, 80), "x", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1], "x", "s1"), (101, rows[1][1] + " extra", "x", None), (102, "12 34", None, "s0"), (103, None, "x", "s0"),
             (104, prose(rng, 40) + " " + item, "x", "s2"), (2, rows[2][1], "x", "s2")]
    benchmark = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    folder = as_folder(documents=documents(rows), benchmark=benchmark)
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), "test")
        seen[name] = sorted(r["doc_id"] for r in docs.collect())
    assert seen["language"] == sorted([*range(60), 2, 100, 101, 104])
    assert seen["near_duplicates"] == sorted([*range(60), 104])
    assert seen["decontamination"] == list(range(60))
    assert set(seen["mix"]) <= set(range(60)) and max(map(seen["mix"].count, seen["mix"])) <= 3
    assert seen["shards"] == seen["mix"] and len(WORDS) == 48
    assert corpus_pipeline.run(spark, folder).count() == len(seen["shards"])


def test_empty_documents(spark, documents, as_folder):
    folder = as_folder(documents=documents([]), benchmark=spark.createDataFrame([], "item_id bigint, text string"))
    assert corpus_pipeline.run(spark, folder).count() == 0
