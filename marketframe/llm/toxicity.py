"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters are patterns over words (letters, digits and non-ASCII characters,
A-Z lower-cased): a fixed seed lexicon, and whole words and word beginnings of
3 to 8 bytes that make up a certain share of a text (``SHARES``).  Spark counts
them in the labelled documents and keeps those that speak in toxic ones almost
alone.  Beginnings catch inflected forms that were never labelled, and shares
tell a text about a thing from a long one that names it once.

The label model knows each voter's accuracy (how often it speaks in toxic and in
clean texts) and the correlations between voters; both are estimated by EM over
the votes of at most ``SAMPLE`` labelled documents and of about ``SAMPLE`` others.
A given label is one more voter, whose accuracy is estimated too: strong votes
outweigh a wrong label, and rows without one are judged by their votes.  A voter
that agrees with others beyond what the label explains counts for less: its
log-odds are divided by the sum of its correlations.

The posterior labels of all these rows train a logistic classifier over the
voters, drawn towards the label model's own log-odds.  How strongly, and how sure
a voter must be, is chosen among ``RIDGES`` and ``LEAST`` on a fourth of the
labelled training rows, by voters and models from the other three.  That classifier scores every word of every text.

Defined cases: null and empty texts have no votes and get the score of a text
without votes; without labels the seed lexicon alone votes, on unlabelled texts; an empty table leaves the seeds
their rates before data; null labels are left out; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketframe.llm.arrays import LOWER, NON_WORD, U64, mix, pieces, prefix_sums, spans_hash, word_spans
from marketframe.llm.quality import is_held_out, labelled_sample
from marketframe.llm.store import saved

#: Words that are insults in most contexts.
SEEDS = "idiot moron stupid clown loser scum pathetic disgusting worthless trash".split()
SAMPLE = 12000
#: A mined voter speaks in so many toxic texts at least, and in so many toxic ones for each clean one (times the labels' odds); one pair is chosen by the training rows.
LEAST = ((2, 12.0), (3, 12.0), (2, 25.0), (3, 25.0))
LENGTHS = (3, 4, 5, 6, 7, 8)
#: The shares of a text's words from which voters speak; 0 is one word.
SHARES = (0.0, 0.005, 0.01, 0.02)
#: How strongly the classifier is drawn to the label model's weights; one of these is chosen by the training rows.
RIDGES = (3e-3, 1e-3, 3e-4)
#: The seeds' accuracies before data: how often each speaks in toxic and in clean texts, and of how many texts that is worth.
SEED_RATES, SEED_TEXTS = (0.1, 0.001), 20.0
#: The same of a given label: how often it says toxic of toxic and of clean texts.
GOLD_RATES, GOLD_TEXTS = (0.97, 0.01), 100.0


def keys(lower: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words' beginnings and of whole words, the document of each, and the documents' numbers of words."""
    ws, we, first = word_spans(lower, offsets, NON_WORD)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    sums = prefix_sums(lower)
    out, of = [spans_hash(sums, ws, we)], [doc]
    for k in LENGTHS:
        long = we - ws >= k
        out.append(spans_hash(sums, ws[long], ws[long] + k) + np.uint64(k))
        of.append(doc[long])
    return np.concatenate(out), np.concatenate(of), n


def voter_of(key: np.ndarray, share: int) -> np.ndarray:
    """The voter that speaks where ``key`` reaches SHARES[share]."""
    return mix(key + U64(share)) if share else key


def spoken(key: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents and voters of all votes, each once, from the keys found in documents of n words."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(head, len(key)))
    key, doc = key[head], doc[head]
    reach = [times >= s * n[doc] for s in SHARES]
    return np.concatenate([doc[r] for r in reach]), np.concatenate([voter_of(key[r], k) for k, r in enumerate(reach)])


def key_of(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(spans_hash(prefix_sums(data), np.array([0]), np.array([len(data)]))[0])


SEED_KEYS = np.array([key_of(w) for w in SEEDS], np.uint64)


@dataclass
class ToxicModel:
    """Voters (sorted) and the keys they come from, the weights of their presence, of any vote at all and of the log of the number of votes, and the intercept."""

    voters: np.ndarray
    bases: np.ndarray
    presence: np.ndarray
    some: float
    count: float
    intercept: float

    def votes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents and voters of all votes, each once, and how many there are in each document."""
        key, doc, n = keys(LOWER[data], offsets)
        known = self.bases[np.minimum(np.searchsorted(self.bases, key), len(self.bases) - 1)] == key
        doc, voter = spoken(key[known], doc[known], n)
        at = np.minimum(np.searchsorted(self.voters, voter), len(self.voters) - 1)
        hit = self.voters[at] == voter
        doc, at = doc[hit], at[hit]
        order = np.lexsort((at, doc))
        return doc[order], at[order], np.bincount(doc, minlength=len(n))

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        for row, data, offsets in pieces(column):
            doc, voter, n = self.votes(data, offsets)
            z = self.intercept + self.some * (n > 0) + np.bincount(doc, self.presence[voter], len(n)) + self.count * np.log1p(n)
            out[row : row + len(n)] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


@dataclass
class Labels:
    """What the label model says: each row's posterior, each voter's log-odds when it speaks, those of a text with votes before they count, and those of one without."""

    posterior: np.ndarray
    weights: np.ndarray
    base: float
    silent: float


class Together:
    """How often two voters speak together, by blocks of voters: no matrix of all pairs is held.  A block's counts come
    from the votes of the texts its voters speak in, some at a time."""

    BLOCK, AT_ONCE = 256, 1 << 22

    def __init__(self, doc: np.ndarray, voter: np.ndarray, n_voters: int):
        by_doc, by_voter = np.lexsort((voter, doc)), np.lexsort((doc, voter))
        self.voters, self.docs, self.n = voter[by_doc], doc[by_voter], n_voters
        self.alone = np.bincount(voter, minlength=n_voters).astype(float)
        self.of_voter = np.append(0, np.cumsum(self.alone.astype(np.int64)))
        self.of_doc = np.append(0, np.cumsum(np.bincount(doc, minlength=int(doc.max()) + 1 if len(doc) else 0)))

    def block(self, first: int) -> np.ndarray:
        """Counts of voters from ``first`` on with all voters."""
        last = min(first + self.BLOCK, self.n)
        out = np.zeros((last - first) * self.n)
        a, z = self.of_voter[first], self.of_voter[last]
        docs = self.docs[a:z]
        mine = np.repeat(np.arange(last - first), np.diff(self.of_voter[first : last + 1]))
        size = self.of_doc[docs + 1] - self.of_doc[docs]
        total = np.append(0, np.cumsum(size))
        at = 0
        while at < len(docs):
            end = max(at + 1, int(np.searchsorted(total, total[at] + self.AT_ONCE, "right")) - 1)
            s = size[at:end]
            place = np.repeat(self.of_doc[docs[at:end]] - np.cumsum(s) + s, s) + np.arange(s.sum())
            found, times = np.unique(np.repeat(mine[at:end], s) * self.n + self.voters[place], return_counts=True)
            out[found] += times
            at = end
        return out.reshape(last - first, self.n)


def label_model(doc: np.ndarray, voter: np.ndarray, known: np.ndarray, seed: np.ndarray, rounds: int = 8) -> Labels:
    """doc, voter: the votes, each once.  known: the rows' labels, 1, 0, or -1 where there is none.  seed: which voters are seeds.

    Accuracies: P(vote | toxic) and P(vote | clean), smoothed.  Correlations: those of the votes' residuals given the label.
    A voter that doesn't speak abstains; that none speaks at all is a sign of its own."""
    n, n_voters, voted = len(known), len(seed), np.unique(doc)
    if n == 0:  # nothing but what the seeds are taken for
        base = float(np.log(GOLD_RATES[1] / (1 - GOLD_RATES[1])))
        return Labels(np.zeros(0), np.where(seed, np.log(SEED_RATES[0] / SEED_RATES[1]), 0.0) - base, base, base)
    post = np.where(known >= 0, known, np.isin(np.arange(n), doc[seed[voter]])).astype(float)
    together = Together(doc, voter, n_voters)
    labelled, quiet = known >= 0, ~np.isin(np.arange(n), voted)
    weights, base, silent = np.zeros(n_voters), 0.0, 0.0
    for _ in range(rounds):
        rate = np.clip(post.mean(), 0.01, 0.5)
        n1, n0 = post.sum(), (1 - post).sum()
        s1, s0 = np.bincount(voter, post[doc], n_voters), np.bincount(voter, 1 - post[doc], n_voters)
        a = np.where(seed, (s1 + SEED_TEXTS * SEED_RATES[0]) / (n1 + SEED_TEXTS), (s1 + 0.5 * rate) / (n1 + 1))
        b = np.where(seed, (s0 + SEED_TEXTS * SEED_RATES[1]) / (n0 + SEED_TEXTS), (s0 + 0.02) / (n0 + 10))
        q1, q0, q = post @ post, (1 - post) @ (1 - post), post @ (1 - post)
        x1, x0 = s1 / max(n1, 1e-9), s0 / max(n0, 1e-9)  # as they are: smoothed ones would make the silent voters look alike
        square = together.alone - 2 * (s1 * x1 + s0 * x0) + q1 * x1 * x1 + 2 * q * x1 * x0 + q0 * x0 * x0
        sd = np.sqrt(np.maximum(square, 0) / n) + 1e-3
        alike = np.empty(n_voters)
        for k in range(0, n_voters, Together.BLOCK):
            i = slice(k, k + Together.BLOCK)
            left = np.stack([s1[i], s0[i], x1[i], x0[i]], 1)
            right = np.stack([-x1, -x0, q1 * x1 + q * x0 - s1, q * x1 + q0 * x0 - s0])
            corr = np.abs(together.block(k) + left @ right) / n / np.outer(sd[i], sd)
            corr[np.arange(len(corr)), np.arange(k, k + len(corr))] = 1
            alike[i] = np.where(corr > 0.2, corr, 0).sum(1)
        weights, base = np.log(a / b) / alike, np.log(rate / (1 - rate))
        none1, none0 = (post[quiet].sum() + rate) / (n1 + 1), ((1 - post)[quiet].sum() + 1) / (n0 + 1)
        silent = base + np.log(none1 / none0)
        # the given label: how often it says toxic of toxic and of clean texts
        p, y = post[labelled], known[labelled]
        g1, g0 = ((w @ y + GOLD_TEXTS * r) / (w.sum() + GOLD_TEXTS) for w, r in zip((p, 1 - p), GOLD_RATES, strict=True))
        gold = np.where(known == 1, np.log(g1 / g0), np.where(known == 0, np.log((1 - g1) / (1 - g0)), 0.0))
        post = 1 / (1 + np.exp(-np.clip(np.where(quiet, silent, base) + gold + np.bincount(doc, weights[voter], n), -30, 30)))
    return Labels(post, weights, float(base), float(silent))


def logistic(doc: np.ndarray, voter: np.ndarray, n: np.ndarray, labels: Labels, ridge: float) -> tuple[np.ndarray, float, float, float]:
    """Weights of voters, of any vote at all and of n (the log of 1 + the number of votes), and the intercept, for the posterior labels, drawn to the label model's."""
    rows, post = len(n), labels.posterior
    silent = np.clip(labels.silent, -6.0, 0.0)
    start = [labels.weights, labels.base - silent, 0.0, silent]
    now = [np.array(x, float) for x in start]
    m = [np.zeros_like(x) for x in now]
    v = [np.zeros_like(x) for x in now]
    some = n > 0
    for k in range(1, 301 if rows else 1):
        r = (post - 1 / (1 + np.exp(-np.clip(linear(now, doc, voter, n), -30, 30)))) / rows
        for i, g in enumerate((np.bincount(voter, r[doc], len(now[0])), r[some].sum(), n @ r, r.sum())):
            g = g - ridge * (now[i] - start[i])
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            now[i] = now[i] + 0.1 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
    return now[0], float(now[1]), max(float(now[2]), 0.0), float(now[3])


def linear(weights, doc: np.ndarray, voter: np.ndarray, n: np.ndarray) -> np.ndarray:
    w, some, c, b = weights
    return b + some * (n > 0) + np.bincount(doc, w[voter], len(n)) + c * n


@dataclass
class Votes:
    """The rows that train: votes (doc, voter), log of 1 + the number of votes, labels (-1: none), and which rows are in the chosen fourth."""

    doc: np.ndarray
    voter: np.ndarray
    n: np.ndarray
    label: np.ndarray
    fourth: np.ndarray

    def of(self, rows: np.ndarray, voters: np.ndarray) -> Votes:
        """The same of some rows and voters (masks), numbered anew."""
        use = rows[self.doc] & voters[self.voter]
        doc, voter = (np.cumsum(rows) - 1)[self.doc[use]], (np.cumsum(voters) - 1)[self.voter[use]]
        n = np.log1p(np.bincount(doc, minlength=int(rows.sum())).astype(float))
        return Votes(doc, voter, n, self.label[rows], self.fourth[rows])


def admitted(toxic: np.ndarray, clean: np.ndarray, odds: float, least: tuple[int, float]) -> np.ndarray:
    """Which mined voters qualify, from the numbers of toxic and clean texts they speak in and the labels' odds."""
    return (toxic >= least[0]) & ((toxic + 0.5) / (clean + 0.5) >= least[1] * odds) & (clean <= 0.1 * (toxic + clean))


def chosen(votes: Votes, toxic: np.ndarray, clean: np.ndarray, seed: np.ndarray, odds: float) -> tuple[tuple[int, float], float]:
    """The pair of LEAST and the one of RIDGES with the least loss on the labelled rows of the fourth, learned from the other rows (which ``toxic`` and ``clean`` count)."""
    best = (np.inf, LEAST[-1], RIDGES[0])
    for least in LEAST:
        use = admitted(toxic, clean, odds, least) | seed
        test, rest = votes.of(votes.fourth & (votes.label >= 0), use), votes.of(~votes.fourth, use)
        if len(test.label) == 0 or len(rest.label) == 0:
            break
        labels = label_model(rest.doc, rest.voter, rest.label, seed[use])
        for ridge in RIDGES:
            z = np.clip(linear(logistic(rest.doc, rest.voter, rest.n, labels, ridge), test.doc, test.voter, test.n), -30, 30)
            best = min(best, (float(np.mean(np.log1p(np.exp(-np.where(test.label == 1, z, -z))))), least, ridge))
    return best[1:]


def mine(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Voters that speak in toxic documents almost alone by the easiest of LEAST, their keys, how many toxic and clean texts they speak in (of all, and
    of those not in the fourth), and the labels' odds.  Spark counts; the voters come to the driver, as many as the sample's toxic words give."""

    def distinct(batches):
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            fourth = batch.column("fourth").to_numpy(zero_copy_only=False)
            for row, data, offsets in pieces(batch.column("text")):
                key, doc, n = keys(LOWER[data], offsets)
                order = np.lexsort((key, doc))
                key, doc = key[order], doc[order]
                head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.zeros(0, np.int64)
                times = np.diff(np.append(head, len(key)))
                key, doc = key[head], row + doc[head]
                reach = sum((times >= s * n[doc - row]).astype(np.int32) for s in SHARES)  # shares grow, so this many from the first
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(reach - 1, pa.int32()), pa.array(label[doc].astype(np.int32)), pa.array(fourth[doc])], ["key", "reach", "label", "fourth"])

    levels = range(len(SHARES))
    found = sample.mapInArrow(distinct, "key long, reach int, label int, fourth boolean")
    sums = [F.sum(F.when((F.col("reach") >= k) & (F.col("label") == y) & (F.lit(True) if not f else ~F.col("fourth")), 1).otherwise(0)).alias(f"{'cu'[f]}{k}_{y}") for k in levels for y in (0, 1) for f in (0, 1)]
    counts = found.groupBy("key").agg(*sums)
    known = sample.agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    if not 0 < (known["toxic"] or 0) < known["n"]:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros((0, 4)), 1.0)
    odds = known["toxic"] / (known["n"] - known["toxic"])
    texts, times = min(x[0] for x in LEAST), min(x[1] for x in LEAST)

    def good(k: int, f: str) -> Column:
        toxic, clean = F.col(f"{f}{k}_1"), F.col(f"{f}{k}_0")
        return (toxic >= texts) & ((toxic + 0.5) / (clean + 0.5) >= times * odds) & (clean <= 0.1 * (toxic + clean))

    each = F.explode(F.array(*[F.struct(F.lit(k).alias("share"), (good(k, "c") | good(k, "u")).alias("good"), *[F.col(f"{f}{k}_{y}").alias(f"{f}{y}") for f in "cu" for y in (1, 0)]) for k in levels]))
    rows = counts.select("key", each.alias("v")).where("v.good").select("key", "v.share", "v.c1", "v.c0", "v.u1", "v.u0").collect()
    key = np.array([r["key"] for r in rows], np.int64).view(np.uint64)
    voter = np.array([int(voter_of(key[i : i + 1], r["share"])[0]) for i, r in enumerate(rows)], np.uint64)
    return voter, key, np.array([r[2:] for r in rows], float).reshape(-1, 4), odds


def unlabelled_sample(docs: DataFrame, size: int) -> DataFrame:
    """(text, label null) of about ``size`` documents that aren't held out, chosen by a hash of the text."""
    known = docs.where(F.col("text").isNotNull() & ~F.coalesce(is_held_out(F.col("doc_id")), F.lit(False)))
    share = F.pmod(F.xxhash64("text", F.lit("unlabelled")), F.lit(max(docs.count(), 1)))
    return known.where(share < size).select("text", F.lit(None).cast("int").alias("label"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicModel:
    # a text counts once, or the words of copied texts would look like signs
    gold = labelled_sample(docs, labels, "toxic", sample).select("text", "label")
    once = gold.union(unlabelled_sample(docs, sample)).select(F.col("text").cast("binary").alias("text"), "label").groupBy("text")
    rows = saved(once.agg(F.coalesce(F.max("label"), F.lit(-1)).alias("label")).withColumn("fourth", F.pmod(F.xxhash64("text", F.lit("fourth")), F.lit(4)) == 0))
    mined, key, counts, odds = mine(rows.where("label >= 0"))
    bases = np.unique(np.concatenate([key, SEED_KEYS]))
    voters, place = np.unique(np.concatenate([mined, SEED_KEYS]), return_index=True)
    seed = np.isin(voters, SEED_KEYS)
    counts = np.concatenate([counts, np.zeros((len(SEED_KEYS), 4))])[place]
    blank = ToxicModel(voters, bases, np.zeros(len(voters)), 0.0, 0.0, 0.0)

    def votes(batches):
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for row, data, offsets in pieces(batch.column("text")):
                doc, voter, n = blank.votes(data, offsets)
                cut = np.searchsorted(doc, np.arange(len(n) + 1))
                lists = [voter[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(len(n))]
                yield pa.RecordBatch.from_arrays([pa.array(label[row : row + len(n)].astype(np.int32)), batch.column("fourth").slice(row, len(n)), pa.array(lists, pa.binary())], ["label", "fourth", "voters"])

    got = rows.mapInArrow(votes, "label int, fourth boolean, voters binary").collect()
    got.sort(key=lambda r: (r["label"], r["voters"], r["fourth"]))
    said = [np.frombuffer(r["voters"], np.int32) for r in got]
    doc = np.repeat(np.arange(len(said)), [len(x) for x in said]).astype(np.int64)
    every = Votes(doc, np.concatenate(said).astype(np.int64) if said else doc, np.zeros(len(said)), np.array([r["label"] for r in got], int), np.array([r["fourth"] for r in got], bool))
    least, ridge = chosen(every, counts[:, 2], counts[:, 3], seed, odds)
    now = admitted(counts[:, 0], counts[:, 1], odds, least) | seed
    used = every.of(np.ones(len(said), bool), now)
    found = label_model(used.doc, used.voter, used.label, seed[now])
    return ToxicModel(voters[now], bases, *logistic(used.doc, used.voter, used.n, found, ridge))


def score(model: ToxicModel, text: Column) -> Column:
    """The toxicity score of each text, 0 to 1."""

    @F.arrow_udf("double")
    def toxicity(column: pa.Array) -> pa.Array:
        return pa.array(model.scores(column), pa.float64())

    return toxicity(F.coalesce(text.cast("binary"), F.lit(b"").cast("binary")))
