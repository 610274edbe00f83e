"""Scores and extraction on long texts, ties, repeated rows, clashing columns, nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from marketframe.llm import html_extract, quality, toxicity
from test_llm import SCHEMA, corpus, labelled, sentence


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_scores_on_odd_rows(spark, operator):
    import numpy as np

    known, labels = labelled(spark)
    model = operator.train(known, labels)
    long = sentence(np.random.default_rng(1), 150_000, 300) + " idiot"  # above a piece of bytes
    rows = [*corpus(seed=4), (5000, long, "s", 1, 2, 3, "x", True), (5001, long, "s", 1, 2, 3, "x", True), (5002, "\n".join(["same"] * 3000), None, 0, 0, 0, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = docs.select("*", quality.is_held_out(F.col("doc_id")).alias("held_out"), operator.score(model, F.col("text")).alias("score")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r in got:  # equal texts, repeated rows included, have equal scores; null is empty
        assert by_text.setdefault(r.text or "", r.score) == r.score
    assert all(r.held_out is False for r in got if r.doc_id is None)
    again = docs.select("doc_id", operator.score(operator.train(known, labels), F.col("text")).alias("score")).collect()
    assert sorted((str(r.doc_id), r.score) for r in again) == sorted((str(r.doc_id), r.score) for r in got)
    # training on a table with repeated rows, nulls and clashing names
    odd = operator.train(docs, spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0)) for i in range(90)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int"))
    assert all(0 <= r[0] <= 1 for r in docs.select(operator.score(odd, F.col("text"))).collect())
    nothing = operator.train(docs.limit(0), labels)
    assert all(0 <= r[0] <= 1 for r in docs.select(operator.score(nothing, F.col("text"))).collect())


def test_quality_is_the_same_in_any_batch():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(0)
    model = quality.LineModel(r.normal(size=3 * quality.N_OWN), r.normal(size=(2, 2)), 5.0, -2.0)
    texts = ["\n".join(sentence(r, int(r.integers(1, 40)), 300).replace("x ", ["! ", "x, ", "X "][i % 3]) for _ in range(int(r.integers(1, 9)))).encode() for i in range(300)]
    alone = [model.scores(pa.array([t], pa.binary()))[0] for t in texts]
    for size in (1, 7, 100, 300):
        order = r.permutation(len(texts))
        got = np.concatenate([model.scores(pa.array([texts[i] for i in order[a : a + size]], pa.binary())) for a in range(0, len(texts), size)])
        assert got.tolist() == [alone[i] for i in order]


def test_long_pages_and_clashing_columns(spark):
    model = html_extract.train()
    body = "".join(f"<p>Paragraph number {i} of a long article about the sea and its many ships.</p>" for i in range(5000))
    page = f"<html><body><nav><a href='/'>Home</a> <a href='/b'>News</a></nav><article><h1>The sea</h1>{body}</article><footer>Imprint</footer></body></html>"
    table = spark.createDataFrame([(1, "u", page, "t", 5), (1, "u", page, "t", 5), (None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract(table, model).collect()
    assert len(got) == 3
    for r in got[:2] if got[0].page_id else got[1:]:
        assert r.text.count("\n") >= 5000 and "Paragraph number 4999 of" in r.text and r.n_chars == len(r.text)
    assert [r.text for r in got if r.page_id is None] == [""]
