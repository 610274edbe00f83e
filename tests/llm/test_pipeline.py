"""Each stage of the corpus pipeline against a brute-force version, on nulls, empties, long texts, repeats and clashing columns."""

import hashlib
import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline as P
from marketframe.llm import mixing, quality
from test_llm import LOWER, NON_WORD, SCHEMA, corpus, shingles, words


@pytest.fixture(scope="module")
def rows():
    return corpus(seed=2)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    """labels and benchmark for these documents."""
    path = str(tmp_path_factory.mktemp("tables"))
    labels = [(x[0], int(len(words(x[1])) > 40), 0) for x in rows if x[0] is not None and x[0] % 4]
    spark.createDataFrame([*labels, (None, 1, 1), (2000, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join(words(rows[60][1])[30:60])), (2, "one"), (3, None), (4, rows[66][1]), (None, "nothing here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def kept(df):
    return Counter(tuple(r) for r in df.collect())


def test_empty_tables(spark, folder):
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in P.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0
        assert name == "shard_documents" or out.columns == empty.columns


def test_quality_filter(spark, docs, rows, folder):
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = model.scores(pa.array([(x[1] or "").encode() for x in rows], pa.binary()))
    want = Counter(x for x, s in zip(rows, scores, strict=True) if s >= 0.5)
    got = P.quality_filter(spark, docs, folder)
    assert got.columns == docs.columns and kept(got) == want and 0 < sum(want.values()) < len(rows)


def test_near_dedup_filter(spark, docs, rows, folder):
    sets = [shingles(x[1]) for x in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    groups = defaultdict(list)
    for i, x in enumerate(rows):
        groups[root[i] if sets[i] else ("alone", x[0], x[1])].append(x)
    want = Counter(min(g, key=lambda x: (x[0] is None, x[0])) for g in groups.values())
    assert kept(P.near_dedup_filter(spark, docs, folder)) == want


def test_decontamination_filter(spark, docs, rows, folder):
    items = [words((r.text or "").translate(LOWER), NON_WORD) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = Counter()
    for x in rows:
        ws, hit = words((x[1] or "").translate(LOWER), NON_WORD), set()
        for iw in items:
            n = min(13, len(iw))
            windows = {tuple(iw[p : p + n]) for p in range(len(iw) - n + 1)} if n else set()
            for q in range(len(ws) - n + 1):
                if tuple(ws[q : q + n]) in windows:
                    hit.update(range(q, q + n))
        if not (hit and 20 * len(hit) >= len(ws)):
            want[x] += 1
    assert kept(P.decontamination_filter(spark, docs, folder)) == want and sum(want.values()) < len(rows)


def queue(rows):
    """Words taken of each row by a plain queue: packets of all sources by finish time, until the budget is spent."""
    size = [len(words(x[1])) for x in rows]
    total = Counter()
    for x, n in zip(rows, size, strict=True):
        total[x[2]] += n
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    free, left, target = set(names), 1.5 * sum(size), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= 2 * total[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    place = lambda i: hashlib.md5(f"mix|{'null' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest()
    packets = []
    for s in names:
        sent = 0
        own = sorted((i for i in range(len(rows)) if rows[i][2] == s), key=lambda i: (place(i), rows[i][0] is not None, rows[i][0] or 0, size[i]))
        for _ in range(2):
            for i in own:
                if size[i] and sent < target[s]:
                    early = max(0, min(size[i], math.floor(target[s]) - sent))
                    packets += [((sent + early) / target[s], s is None, s or "", sent, early, i)] * (early > 0)
                    packets += [((sent + size[i]) / target[s], s is None, s or "", sent + early, size[i] - early, i)] * (early < size[i])
                sent += size[i]
    budget, taken = math.floor(1.5 * sum(size)), [0] * len(rows)
    for *_, n, i in sorted(packets):
        part = min(n, budget)
        taken[i] += part
        budget -= part
    return taken, target


def test_mix_sources(spark, docs, rows, folder):
    taken, target = queue(rows)
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.source, r.size, r.taken) for r in got) == Counter((x[0], x[2], len(words(x[1])), t) for x, t in zip(rows, taken, strict=True))
    assert sum(taken) == math.floor(1.5 * sum(len(words(x[1])) for x in rows))
    out = P.mix_sources(spark, docs, folder)
    assert out.columns == docs.columns
    want, share = Counter(), defaultdict(list)
    for x, t in zip(rows, taken, strict=True):
        share[x].append(t)
    for x, ts in share.items():  # repeated rows share alike
        t, n = sum(ts) // len(ts), len(words(x[1]))
        for _ in ts:
            if t:
                want[x] += t // n
            if t and t % n:
                want[(x[0], " ".join(words(x[1])[: t % n]), *x[2:])] += 1
    assert kept(out) == +want


def test_mix_is_sent_in_order_of_finish(spark, docs, rows):
    mixed = mixing.mix(docs)
    known = {(r.doc_id, r.source): r for r in mixed.collect()}
    sent, seen = mixing.emit(docs, mixed).collect(), Counter()
    times = []
    for r in sent:
        m = known[r.doc_id, r.source]
        if (r.doc_id, r.text) in {(rows[5][0], rows[5][1])} or r.doc_id is None:
            continue  # repeated rows
        times.append(m.virtual_start + (seen[r.doc_id] * m.source_size + m.size) / m.target)
        seen[r.doc_id] += 1
    assert times == pytest.approx(sorted(times))


def test_shard_documents(spark, docs, rows, folder):
    def best(doc_id, n):
        name = "null" if doc_id is None else str(doc_id)
        return min(range(n), key=lambda s: -math.log((int(hashlib.md5(f"{name}:{s}".encode()).hexdigest()[:13], 16) + 1.0) / (16.0**13 + 1)))

    got = P.shard_documents(spark, docs, folder).collect()
    assert Counter((r.doc_id, r.shard, r.grown_shard) for r in got) == Counter((x[0], best(x[0], 16), best(x[0], 17)) for x in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
