"""Bounds of what training holds, and ids of any type."""

import numpy as np
from pyspark.sql import functions as F

from marketframe.llm import near_dedup, quality, toxicity
from test_llm import sentence


def test_near_groups_keep_text_ids(spark):
    r = np.random.default_rng(2)
    base = sentence(r, 90, 500)
    rows = [("b-2", base), ("a-1", base + " tail"), ("c", "other words that nothing is like at all"), (None, base + " tail"), ("z", None)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {(x.doc_id, x.component_id, x.kept) for x in got} == {("b-2", "a-1", False), ("a-1", "a-1", True), ("c", "c", True), (None, "a-1", False), ("z", "z", True)}


def test_pairs_of_voters_are_counted_by_blocks(monkeypatch):
    r = np.random.default_rng(4)
    votes = np.unique(r.integers(0, [60, 700], (2000, 2)), axis=0)
    x = np.zeros((60, 700))
    x[votes[:, 0], votes[:, 1]] = 1
    monkeypatch.setattr(toxicity.Together, "AT_ONCE", 100)
    made = toxicity.Together(votes[:, 0], votes[:, 1], 700)
    assert np.array_equal(np.vstack([made.block(k) for k in range(0, 700, made.BLOCK)]), x.T @ x)
    assert np.array_equal(made.alone, x.sum(0))
    assert toxicity.Together(np.zeros(0, int), np.zeros(0, int), 3).block(0).sum() == 0


def test_label_model_of_very_many_voters_is_bounded():
    import tracemalloc

    r = np.random.default_rng(5)
    votes = np.unique(np.stack([r.integers(0, 3000, 90_000), r.integers(0, 50_000, 90_000)], 1), axis=0)
    known = r.integers(-1, 2, 3000)
    tracemalloc.start()
    made = toxicity.label_model(votes[:, 0], votes[:, 1], known, np.arange(50_000) < 20, rounds=1)
    assert tracemalloc.get_traced_memory()[1] < 1e9 and np.isfinite(made.posterior).all()
    tracemalloc.stop()


def test_training_lines_are_bounded(spark):
    rows = [(i, "\n".join(["line"] * k), 1) for i, k in enumerate([1, 5, 3, 2000, 7, 0])] + [(6, None, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    kept = {r.doc_id for r in quality.within_lines(table, 1000).collect()}
    assert kept == {0, 1, 2, 4, 5, 6}
    few = quality.within_lines(table.where(F.col("doc_id") != 3), 700).collect()
    assert {r.doc_id for r in few} == {0, 1, 2, 4, 5, 6} and quality.within_lines(table, 100).count() < 6
