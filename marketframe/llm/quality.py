"""Quality by a linear-chain conditional random field over the lines of a text.

Each line is good or bad.  Its features are shares of characters and words of
some kinds, with those of the lines before and after it; the chain's transitions
tie neighbouring lines.  A document's score is the mean of the lines' marginal
probabilities of being good, weighted by the lines' lengths, passed through a
logistic curve that is fitted with the model.

The model is trained on at most ``SAMPLE`` labelled documents (the first by a
hash of doc_id) and all their lines.  The lines start with the document's label; after each fit, lines of bad
documents that look good by themselves are relabelled, so that a bad document
may have good lines.  Scoring reads every line of every text.

Defined cases: null and empty texts are scored as one empty line; without
labels of both kinds all texts get the score 0.5; null labels are left out;
repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.arrays import pieces, prefix_sums, spans_hash, word_spans

#: Labelled documents that the model is fitted on, with all their lines.
SAMPLE = 3000
#: Lines that they may have together (the driver holds their features), and the share of these that one of them may have.
LINES, ONE_TEXT = 400_000, 0.01
ROUNDS, STEPS = 3, 120

#: Classes of bytes: lower case and others, upper case, digits, white space, stops, bars, exclamation marks, other signs.
KINDS = 8
_KIND = np.zeros(256, np.int64)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\n\r\x0b\x0c", 3), (b".,;:?'\"-()", 4), (b"|", 5), (b"!", 6), (b"#$%&*+/<=>@[\\]^_`{}~", 7)):
    for _c in _chars:
        _KIND[_c] = _k
N_OWN = 16


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line (lines x N_OWN), lengths, and the first line of each document (and the end).
    A document has one line more than it has line feeds."""
    n_docs = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    first = np.searchsorted(feeds, offsets) + np.arange(n_docs + 1)
    starts = np.empty(len(feeds) + n_docs, np.int64)
    is_first = np.zeros(len(starts), bool)
    is_first[first[:-1]] = True
    starts[is_first] = offsets[:-1]
    starts[~is_first] = feeds + 1
    ends = np.empty_like(starts)
    is_last = np.zeros(len(starts), bool)
    is_last[first[1:] - 1] = True
    ends[is_last] = offsets[1:]
    ends[~is_last] = feeds
    lengths = ends - starts
    n = len(starts)
    bounds = np.zeros(len(data) + 1, np.int64)
    np.add.at(bounds, starts, 1)
    line_of = np.cumsum(bounds[:-1]) - 1
    counts = np.bincount(line_of * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS).astype(float)
    ws, we, _ = word_spans(data, offsets)
    word_line = line_of[ws]
    words = np.bincount(word_line, minlength=n).astype(float)
    h = spans_hash(prefix_sums(data), ws, we)
    same = np.zeros(len(h))
    far = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (word_line[1:] == word_line[:-1])
    far[8:] = (h[8:] == h[:-8]) & (word_line[8:] == word_line[:-8])
    repeats = np.bincount(word_line, same, n)
    long_words = np.bincount(word_line, we - ws > 18, n)
    letters = np.maximum(counts[:, 0] + counts[:, 1], 1)
    some = np.maximum(words, 1)
    size = np.maximum(lengths, 1)
    own = np.stack(
        [
            np.ones(n), lengths == 0, np.minimum(np.log1p(lengths) / 5, 2), counts[:, 1] / letters, counts[:, 1] / letters > 0.4, counts[:, 2] / size,
            np.minimum(counts[:, 5] / some, 1), np.minimum(counts[:, 6] / some, 2), np.minimum(counts[:, 7] / some, 3) / 3, counts[:, 7] / some > 0.5,
            repeats / some, repeats / some > 0.4, np.minimum(counts[:, 4] / some, 1), np.minimum(letters / some, 20) / 10, long_words / some, counts[:, 3] / size,
        ],
        axis=1,
    )
    return own.astype(np.float32), lengths, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and of the line after (zeros at a document's ends)."""
    prev, after = np.zeros_like(own), np.zeros_like(own)
    prev[1:], after[:-1] = own[:-1], own[1:]
    prev[first[:-1]] = 0
    after[first[1:] - 1] = 0
    return np.hstack([own, prev, after])


def line_scores(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Each line's features by the weights, added in one order: a matrix product's last digit depends on the lines beside it."""
    return (x * weights).sum(1)


def marginals(unary: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all documents at once, line by line: each line's probability of being
    good, and the expected transitions (2 x 2, summed).  unary: the score of good against bad."""
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    starts, sizes = first[:-1][order], counts[order]
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")
    e = np.exp(np.clip(np.stack([-unary / 2, unary / 2], 1), -30, 30))
    m = np.exp(trans)
    after = lambda a, m: a[:, :1] * m[0] + a[:, 1:] * m[1]  # noqa: E731  a @ m, the same wherever a line stands
    alpha = np.empty_like(e)
    beta = np.ones_like(e)
    for t in range(longest):
        i = starts[: live[t]] + t
        a = e[i] if t == 0 else after(alpha[i - 1], m) * e[i]
        alpha[i] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        i = starts[: live[t]] + t
        eb = e[i] * beta[i]
        b = after(eb, m.T)
        joint = alpha[i - 1][:, :, None] * m[None] * eb[:, None, :]
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        beta[i - 1] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(1), pairs


@dataclass
class LineModel:
    """The chain's weights, and the slope and intercept of the curve from mean to score."""

    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    intercept: float = 0.0

    def means(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        own, lengths, first = line_features(data, offsets)
        p, _ = marginals(line_scores(with_neighbours(own, first), self.weights), first, self.trans)
        weight = lengths + 1.0
        return np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for row, data, offsets in pieces(column):
            mean = self.means(data, offsets)
            out[row : row + len(mean)] = 1 / (1 + np.exp(-(self.slope * mean + self.intercept)))
        return out


def fit_chain(x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood by Adam, full batch; y: each line's label."""
    w, t = np.zeros(x.shape[1]), np.zeros((2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    seen = np.zeros((2, 2))
    at = np.flatnonzero(inner)
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    n = len(y)
    for k in range(1, steps + 1):
        p, pairs = marginals(x @ w, first, t)
        for v, g, i in ((w, x.T @ ((y - p) * weight) / n - 1e-4 * w, 0), (t, (seen - pairs) / n - 1e-3 * t, 2)):
            state[i] = 0.9 * state[i] + 0.1 * g
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * g * g
            v += 0.1 * (state[i] / (1 - 0.9**k)) / (np.sqrt(state[i + 1] / (1 - 0.99**k)) + 1e-8)
    return w, t


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """A logistic curve in one variable by Newton's method, with a small ridge."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - 1e-2 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        w += np.linalg.solve(hess, grad)
    return float(w[0]), float(w[1])


def fit(features: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray) -> LineModel:
    """A model from each document's line features, line lengths and label."""
    if len(set(labels.tolist())) < 2:
        return LineModel(np.zeros(3 * N_OWN), np.zeros((2, 2)), 0.0, 0.0)
    first = np.concatenate([[0], np.cumsum([len(f) for f in features])])
    own, size = np.vstack(features), np.concatenate(lengths)
    x = with_neighbours(own, first)
    doc = np.repeat(labels, np.diff(first)).astype(float)
    balance = np.where(doc > 0.5, 0.5 / max(labels.mean(), 1e-3), 0.5 / max(1 - labels.mean(), 1e-3))
    y = doc.copy()
    for k in range(ROUNDS):
        w, t = fit_chain(x, first, y, balance)
        if k + 1 < ROUNDS:  # a line's own look, without its neighbours
            alone = own @ w[:N_OWN]
            y = np.where(doc > 0.5, 1.0, (alone > 0).astype(float))
            none_bad = np.minimum.reduceat(y, first[:-1]) > 0
            y = np.where(np.repeat(none_bad, np.diff(first)), doc, y)
    p, _ = marginals(x @ w, first, t)
    weight = size + 1.0
    mean = np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
    slope, intercept = fit_curve(mean, labels.astype(float))
    return LineModel(w, t, slope, intercept)


def is_held_out(doc_id: Column) -> Column:
    """Whether a document's label may not be learned from; false for a null id."""
    return F.coalesce((F.crc32(doc_id.cast("string")) % 3) == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, size: int) -> DataFrame:
    """(doc_id, text, label) of at most ``size`` labelled documents that aren't held out; the labels' side is broadcast, ``size`` rows at most."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def within_lines(rows: DataFrame, most: int) -> DataFrame:
    """The labelled rows (doc_id, text, label), in order of the hashes of ids, as long as they have ``most`` lines together;
    texts with more than ONE_TEXT of these are left out.  Lines are counted where the texts are; one row for each of the sample's documents is added up."""
    n = F.char_length(F.coalesce("text", F.lit(""))) - F.char_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(""))) + 1
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.groupBy("doc_id").agg(F.sum(n).alias("lines")).where(F.col("lines") <= int(most * ONE_TEXT)).withColumn("so_far", F.sum("lines").over(order))
    return rows.join(F.broadcast(counted.where(F.col("so_far") <= most).select("doc_id")), "doc_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> LineModel:
    def features(batches):
        for batch in batches:
            rows = []
            for row, data, offsets in pieces(batch.column("text")):
                own, lengths, first = line_features(data, offsets)
                for i in range(len(offsets) - 1):
                    a, z = first[i], first[i + 1]
                    rows.append((int(batch.column("label")[row + i].as_py()), own[a:z].tobytes(), lengths[a:z].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["label", "own", "size"])

    rows = within_lines(labelled_sample(docs, labels, "quality", sample), lines).mapInArrow(features, "label int, own binary, size binary").collect()
    rows.sort(key=lambda r: (r["label"], r["own"]))
    return fit([np.frombuffer(r["own"], np.float32).reshape(-1, N_OWN) for r in rows], [np.frombuffer(r["size"], np.int64) for r in rows], np.array([r["label"] for r in rows]))


def score(model: LineModel, text: Column) -> Column:
    """The quality score of each text, 0 to 1."""

    @F.arrow_udf("double")
    def quality(column: pa.Array) -> pa.Array:
        return pa.array(model.scores(column), pa.float64())

    return quality(F.coalesce(text.cast("binary"), F.lit(b"").cast("binary")))



