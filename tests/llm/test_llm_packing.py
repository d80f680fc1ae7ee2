"""Containers: keys kept, even blocks, lower bound."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakelens.llm import packing


def test_null_and_large_keys_are_kept(spark):
    big = 9007199254740993
    rows = [(None, "one two"), (big, "three"), (big, "three"), (None, None), (5, ""), (7, "word " * 3000)]
    got = packing.containers(spark.createDataFrame(rows, "doc_id long, text string"), 2048).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.doc_id != 7) == [(False, big), (False, big), (True, 0)]
    pieces = sorted((r.piece_no, r.start_token, r.n_tokens) for r in got if r.doc_id == 7)
    assert pieces[0] == (0, 0, 2048) and pieces[1][:2] == (1, 2048) and len(pieces) == 2
    assert all(n <= 2048 for n in [sum(r.n_tokens for r in got if r.container_id == c) for c in {r.container_id for r in got}])


@pytest.mark.parametrize("parts,rows,blocks", [(64, 10, 16), (40, 33, 32), (8, 1000, 8), (100, 1, 4)])
def test_blocks_are_even_whatever_the_partitions(spark, parts, rows, blocks):
    df = spark.range(parts * rows, numPartitions=parts).withColumn("block", packing.block_of(blocks))
    sizes = [r["count"] for r in df.groupBy("block").count().collect()]
    mean = parts * rows / blocks
    assert len(sizes) == blocks and max(sizes) <= mean + 6 * mean**0.5


def test_one_task_for_each_block_and_no_second_shuffle(spark):
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"))
    plan = packing.containers(df, 2048)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_windows_needed_at_least():
    assert packing.at_least(np.array([6, 6, 6]), 10) == 3
    assert packing.at_least(np.array([6, 6, 5, 5, 5]), 10) == 4
    for seed in range(20):
        rng = random.Random(seed)
        sizes = np.array([rng.randint(1, 100) for _ in range(rng.randint(1, 60))])
        own = packing.pack(sizes, 100)
        sums = np.bincount(own, weights=sizes)
        assert sums.max() <= 100 and packing.at_least(sizes, 100) <= len(sums) <= 1.25 * packing.at_least(sizes, 100) + 1
