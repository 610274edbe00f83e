"""Each operator against a brute-force version on small tables, and its edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketframe.llm import decontaminate, exact_dedup, html_extract, mixing, near_dedup, quality, sharding, substring_dedup, suffix_dedup, toxicity

SPACE = re.compile("[\x20\x09-\x0d]+")
NON_WORD = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: doc_id, text, source, and columns whose names operators use themselves.
SCHEMA = "doc_id long, text string, source string, size long, shard int, uid long, label string, kept boolean"


def words(text, between=SPACE):
    return [w for w in between.split(text or "") if w]


def sentence(r, n, vocabulary=60):
    return " ".join(f"w{r.integers(vocabulary)}x" for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, shared passages, runs, nulls, empties, repeated rows, a very long text, non-ASCII."""
    r = np.random.default_rng(seed)
    passage, long = sentence(r, 70, 500), sentence(r, 6000, 4000)
    texts = [sentence(r, int(r.integers(1, 120)), 800) for _ in range(60)]
    texts += [f"{sentence(r, 30)} {passage} {sentence(r, 20)}" for _ in range(6)]
    base = sentence(r, 200, 900)
    texts += [base, base.upper(), base + " tail", "Head " + base, base.replace("w1x", "v1x", 1), base, " ".join(base.split()[:170])]
    texts += ["a " * 90, "a " * 60 + "b " * 50, "x" * 900, "x" * 850 + "yz" * 100, long, long[:30000] + " cut", "Éa " * 50, "É a\tb\nc", "", None, None, "   ", "one", "One", "one two three four"]
    rows = [(i, t, f"s{i % 4}" if i % 9 else None, 1, 2, 3, "x", True) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5], (None, "no id here at all", None, 0, 0, 0, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_counter(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_sharding(spark, docs, rows, empty):
    got = sharding.shard(docs, [1.0, 2.0, 1.0]).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((x[0], len((x[1] or "").encode()) + 1, zlib.crc32((x[1] or "").encode())) for x in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 3)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    many = spark.range(20000).select(sharding.shard_of(F.col("id"), [1.0, 2.0, 1.0]).alias("s")).groupBy("s").count().collect()
    assert all(abs(r["count"] / 20000 - (0.5 if r.s == 1 else 0.25)) < 0.02 for r in many)
    assert sharding.shard(empty, [1.0]).count() == 0


def test_exact_dedup(docs, rows, empty):
    group = defaultdict(list)
    for x in rows:
        group[(x[1] or "").translate(LOWER)].append(x[0])
    want = Counter()
    for text, ids in group.items():
        top, sha = max((i for i in ids if i is not None), default=None), hashlib.sha256(text.encode()).hexdigest()
        done = False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            keep = i == top and not done
            done = done or keep
            want[(i, top, len(ids), keep, sha)] += 1
    assert as_counter(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_dedup_numbers_contents_that_share_a_digest(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest", lambda chunk: F.struct(F.pmod(F.xxhash64(chunk), F.lit(3)).alias("a")))
    test_exact_dedup(docs, rows, empty)


def test_chunks_join_to_the_text(docs):
    bad = docs.where("text is not null").select(F.col("text"), F.concat_ws("", exact_dedup.chunks(F.col("text"))).alias("back")).where("text <> back")
    assert bad.count() == 0


def test_decontamination(spark, docs, rows, empty):
    long = words((rows[60][1]).translate(LOWER), NON_WORD)
    items = [(1, " ".join(long[30:60])), (2, "one"), (3, "One, TWO three!"), (4, None), (5, "..."), (6, rows[66][1]), (7, "nothing like it anywhere in here"), (8, "a a a a a a a a a a a a a"), (2, "one"), (None, "w1x")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for x in rows:
        ws = words((x[1] or "").translate(LOWER), NON_WORD)
        hit, ids = set(), set()
        for i, t in items:
            iw = words((t or "").translate(LOWER), NON_WORD)
            n = min(13, len(iw))
            for p in range(len(iw) - n + 1 if n else 0):
                for q in range(len(ws) - n + 1):
                    if ws[q : q + n] == iw[p : p + n]:
                        hit.update(range(q, q + n))
                        if i is not None:
                            ids.add(str(i))
        want[(x[0], len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws))] += 1
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert as_counter(decontaminate.contamination(docs, benchmark), *columns) == want
    clean = decontaminate.contamination(docs, benchmark.limit(0))
    assert clean.where("n_hit > 0 or contaminated").count() == 0 and clean.count() == len(rows)
    assert decontaminate.contamination(empty, benchmark).count() == 0


def removed(sequences, n):
    """Per sequence: which elements a repeated window of n covers."""
    seen = Counter(tuple(s[p : p + n]) if not isinstance(s, bytes) else s[p : p + n] for s in sequences for p in range(len(s) - n + 1))
    out = []
    for s in sequences:
        cover = np.zeros(len(s), bool)
        for p in range(len(s) - n + 1):
            if seen[tuple(s[p : p + n]) if not isinstance(s, bytes) else s[p : p + n]] > 1:
                cover[p : p + n] = True
        out.append(cover)
    return out


@pytest.mark.parametrize("window", [35, 11])
def test_recompression(docs, rows, empty, window):
    seqs = [(x[1] or "").encode().split() for x in rows]
    want = Counter()
    for x, s, c in zip(rows, seqs, removed(seqs, window), strict=True):
        kept = b" ".join(w for w, gone in zip(s, c, strict=True) if not gone)
        want[(x[0], len(s), int(c.sum()), hashlib.sha256(kept).hexdigest())] += 1
    assert as_counter(substring_dedup.deduplicate(docs, window), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    if window == 35:
        assert substring_dedup.deduplicate(empty).count() == 0


def test_suffix_buckets(docs, rows, empty):
    seqs = [(x[1] or "").encode() for x in rows]
    want = Counter()
    for x, s, c in zip(rows, seqs, removed(seqs, 400), strict=True):
        kept = bytes(b for b, gone in zip(s, c, strict=True) if not gone)
        spans = int(c[:1].sum() + (c[1:] & ~c[:-1]).sum()) if len(c) else 0
        want[(x[0], len(s), int(c.sum()), spans, hashlib.sha256(kept).hexdigest())] += 1
    assert as_counter(suffix_dedup.deduplicate(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.deduplicate(empty).count() == 0


def test_names_that_collide_change_no_result(docs, rows, empty, monkeypatch):
    from pyspark.sql import functions as F

    from marketframe.llm import distinct_texts

    U64 = np.uint64
    monkeypatch.setattr(distinct_texts, "first_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(13)))
    mark, named, ids = substring_dedup._mark, suffix_dedup._named, near_dedup.set_ids
    monkeypatch.setattr(substring_dedup, "_mark", lambda sums, at, window: mark(sums, at, window) & U64(15))
    test_recompression(docs, rows, empty, 35)
    monkeypatch.setattr(suffix_dedup, "_named", lambda sums, starts, ends: named(sums, starts, ends) & U64(15))
    test_suffix_buckets(docs, rows, empty)
    monkeypatch.setattr(near_dedup, "set_ids", lambda shingles, first: ids(shingles, first) & U64(15))
    test_near_dedup(docs, rows, empty)


def test_suffix_lengths_around_the_limit(spark):
    r = np.random.default_rng(9)
    filler = lambda n: "".join(chr(97 + k) for k in r.integers(0, 26, n))
    rows, want = [], {}
    for k, (size, wide) in enumerate([(399, False), (400, False), (401, False), (399, True), (400, True), (401, True), (450, True)]):
        passage = ("é" * 40 + filler(size - 80)) if wide else filler(size)
        assert len(passage.encode()) == size
        for j in range(3):
            rows.append((3 * k + j, f"{filler(300 + 40 * j)} {passage} {filler(120)}"))
            want[3 * k + j] = (size if size >= 400 else 0, int(size >= 400))
    # sides that the copies share by chance would lengthen them: the spaces are shared
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seqs = [t.encode() for _, t in rows]
    exact = {i: int(c.sum()) for (i, _), c in zip(rows, removed(seqs, 400), strict=True)}
    assert {i: n for i, (n, _) in got.items()} == exact
    assert all(exact[i] >= n for i, (n, _) in want.items()) and exact[3] > 0 and {got[i][1] for i in got if exact[i]} == {1}


def shingles(text):
    ws = words((text or "").translate(LOWER))
    return frozenset(tuple(ws[k : k + 5]) for k in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)] if ws else [])


def test_near_dedup(docs, rows, empty):
    sets = [shingles(x[1]) for x in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(rows[i][0])
    want = Counter()
    for i, x in enumerate(rows):
        c = min((k for k in least[find(i)] if k is not None), default=None)
        want[(x[0], len(sets[i]), c, x[0] == c)] += 1
    assert as_counter(near_dedup.near_groups(docs), "doc_id", "n_shingles", "component_id", "kept") == want
    assert near_dedup.near_groups(empty).count() == 0


def test_near_dedup_links_that_meet_no_leader(spark, monkeypatch):
    r = np.random.default_rng(12)
    base = [f"b{k}" for k in range(150)]
    texts = []
    for k in range(40):  # unlike the others of the group, but in pairs like each other
        ws = list(base)
        for p in r.choice(150, 7, replace=False):
            ws[p] = f"u{k}x{p}"
        texts += [" ".join(ws), " ".join([*ws, "end"])]
    sets = [shingles(t) for t in texts]
    monkeypatch.setattr(near_dedup, "band_keys", lambda s, first: np.ones((len(first) - 1, 1), np.uint64))  # all in one group
    monkeypatch.setattr(near_dedup, "HUBS", 1)
    monkeypatch.setattr(near_dedup, "DRAWS", 1)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    want = {i: min(k for k in range(len(texts)) if root[k] == root[i]) for i in range(len(texts))}
    assert len(set(want.values())) > 20
    got = near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == want


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs).collect()
    size, total = defaultdict(int), 0
    for x in rows:
        size[x[2]] += len(words(x[1]))
    total = sum(size.values())
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    free, left, target = set(names), 1.5 * total, {}
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * size[s]
            left -= 2 * size[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((x[0], len(words(x[1]))) for x in rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(2)).collect()), key=str)
    assert mixing.mix(empty).count() == 0
    out = mixing.emit(docs, mixing.mix(docs))
    assert out.columns == docs.columns
    sent = sum(len(words(r.text)) for r in out.collect())
    assert abs(sent - sum(taken.values())) <= 4


def labelled(spark, seed=3):
    r = np.random.default_rng(seed)
    out, labels = [], []
    for i in range(400):
        lines = [sentence(r, int(r.integers(4, 14)), 300).capitalize() + "." for _ in range(int(r.integers(1, 6)))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            lines = [" ".join(w.upper() + "!!" for w in x.split()) if i % 8 else "###".join(x.split()) for x in lines]
        if toxic:
            lines[-1] += f" idiot {r.choice(['zarlo', 'zarlen', 'zarlist'])} moron"
        out.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame([*out, (900, ""), (901, None), (902, "\n\n")], "doc_id long, text string")
    return docs, spark.createDataFrame([*labels, (901, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def held_out_accuracy(scored, labels, label, least):
    rows = scored.join(labels, "doc_id").where(quality.is_held_out(F.col("doc_id")) & F.col(label).isNotNull()).collect()
    assert len(rows) > 80
    return np.mean([(r.score >= least) == (r[label] == 1) for r in rows])


def test_quality(spark, empty):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels)
    scored = docs.select("doc_id", quality.score(model, F.col("text")).alias("score"))
    assert held_out_accuracy(scored, labels, "quality", 0.5) > 0.97
    assert all(0 <= r.score <= 1 for r in scored.collect())
    blank = quality.train(docs, labels.limit(0))
    assert {r[0] for r in docs.select(quality.score(blank, F.col("text"))).collect()} == {0.5}
    assert empty.select(quality.score(model, F.col("text"))).count() == 0


def test_chain_against_all_labellings():
    r = np.random.default_rng(0)
    unary, trans = r.normal(size=5), r.normal(size=(2, 2))
    first = np.array([0, 3, 5])
    got, _ = quality.marginals(unary, first, trans)
    best = html_extract.viterbi(unary, first, trans)
    for a, z in ((0, 3), (3, 5)):
        total, up, top = 0.0, np.zeros(z - a), (-np.inf, None)
        for code in range(2 ** (z - a)):
            y = [(code >> k) & 1 for k in range(z - a)]
            s = sum((unary[a + k] / 2) * (1 if y[k] else -1) for k in range(z - a)) + sum(trans[y[k], y[k + 1]] for k in range(z - a - 1))
            total += np.exp(s)
            up += np.exp(s) * np.array(y)
            top = max(top, (s, y), key=lambda t: t[0])
        assert np.allclose(got[a:z], up / total) and best[a:z].tolist() == top[1]


def test_toxicity(spark, empty):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    scored = docs.select("doc_id", toxicity.score(model, F.col("text")).alias("score"))
    assert held_out_accuracy(scored, labels, "toxic", 0.7) > 0.97
    new = spark.createDataFrame([("Quite zarlomatic words.",), ("Quite plain words.",), ("you idiot",), (None,)], "text string").select(toxicity.score(model, F.col("text")).alias("s")).collect()
    assert new[0].s > new[1].s and new[2].s > 0.5 > new[1].s == new[3].s
    seeds = toxicity.train(docs, labels.limit(0))
    assert spark.range(1).select(toxicity.score(seeds, F.lit("moron")), toxicity.score(seeds, F.lit("fine"))).first()[0] > 0.5
    assert empty.select(toxicity.score(model, F.col("text"))).count() == 0


def test_toxicity_learns_from_unlabelled_texts(spark):
    docs, labels = labelled(spark)
    few = labels.where("doc_id < 60")
    r = np.random.default_rng(5)
    more = [(1000 + i, sentence(r, 20, 300) + (" idiot moron vexo" if i % 3 == 0 else "")) for i in range(300)]
    every = docs.union(spark.createDataFrame(more, "doc_id long, text string"))
    alone, together = toxicity.train(docs.where("doc_id < 60"), few), toxicity.train(every, few)
    assert not np.allclose(alone.presence[np.isin(alone.voters, toxicity.SEED_KEYS)], together.presence[np.isin(together.voters, toxicity.SEED_KEYS)])
    seeds = toxicity.train(every, labels.limit(0))  # nothing but unlabelled rows
    assert spark.range(1).select(toxicity.score(seeds, F.lit("such a moron")), toxicity.score(seeds, F.lit("vexo"))).first()[0] > 0.5


def test_votes_decide_the_posteriors():
    # rows 0-9 toxic, 10-39 clean, 40 labelled clean against three voters, 41 unlabelled with the voters, 42 unlabelled without
    doc = np.array([*range(10), *range(8), *range(5, 10), 40, 40, 40, 41, 41, 41])
    voter = np.array([0] * 10 + [1] * 8 + [2] * 5 + [0, 1, 2] * 2)
    known = np.array([1] * 10 + [0] * 31 + [-1, -1])
    with_ = toxicity.label_model(doc, voter, known, np.array([True, False, False])).posterior
    fewer = toxicity.label_model(doc[doc < 40], voter[doc < 40], known, np.array([True, False, False])).posterior
    assert with_[41] > 0.9 > fewer[41] and with_[42] < 0.1 and with_[40] > fewer[40] + 0.05
    assert with_[:10].min() > 0.9 and with_[10:40].max() < 0.1


def test_label_model_against_a_direct_version():
    r = np.random.default_rng(4)
    n, k, rounds = 60, 5, 3
    y = r.random(n) < 0.3
    x = r.random((n, k)) < np.where(y[:, None], 0.5, 0.1)
    x[:, 4] = x[:, 3]  # two voters that always agree
    known = np.where(r.random(n) < 0.6, y.astype(int), -1)
    seed = np.array([True, True, False, False, False])
    doc, voter = np.nonzero(x)
    post = [float(known[i]) if known[i] >= 0 else float(x[i, seed].any()) for i in range(n)]
    for _ in range(rounds):
        rate = min(max(sum(post) / n, 0.01), 0.5)
        n1, n0 = sum(post), n - sum(post)
        a, b, x1, x0 = [], [], [], []
        for j in range(k):
            s1, s0 = sum(p for p, v in zip(post, x[:, j], strict=True) if v), sum(1 - p for p, v in zip(post, x[:, j], strict=True) if v)
            a.append((s1 + 2) / (n1 + 20) if seed[j] else (s1 + 0.5 * rate) / (n1 + 1))
            b.append((s0 + 0.02) / (n0 + 20) if seed[j] else (s0 + 0.02) / (n0 + 10))
            x1.append(s1 / n1)
            x0.append(s0 / n0)
        left = np.array([[x[i, j] - post[i] * x1[j] - (1 - post[i]) * x0[j] for j in range(k)] for i in range(n)])
        cov = left.T @ left / n
        corr = np.abs(cov) / np.outer(np.sqrt(np.diag(cov)) + 1e-3, np.sqrt(np.diag(cov)) + 1e-3)
        np.fill_diagonal(corr, 1)
        alike = [sum(c for c in corr[j] if c > 0.2) for j in range(k)]
        quiet = [not row.any() for row in x]
        none1 = (sum(p for p, q in zip(post, quiet, strict=True) if q) + rate) / (n1 + 1)
        none0 = (sum(1 - p for p, q in zip(post, quiet, strict=True) if q) + 1) / (n0 + 1)
        g1 = (sum(p for p, l in zip(post, known, strict=True) if l == 1) + 97) / (sum(p for p, l in zip(post, known, strict=True) if l >= 0) + 100)
        g0 = (sum(1 - p for p, l in zip(post, known, strict=True) if l == 1) + 1) / (sum(1 - p for p, l in zip(post, known, strict=True) if l >= 0) + 100)
        new = []
        for i in range(n):
            z = np.log(rate / (1 - rate)) + (np.log(none1 / none0) if quiet[i] else sum(np.log(a[j] / b[j]) / alike[j] for j in range(k) if x[i, j]))
            z += {1: np.log(g1 / g0), 0: np.log((1 - g1) / (1 - g0)), -1: 0}[int(known[i])]
            new.append(1 / (1 + np.exp(-z)))
        post = new
    assert np.allclose(toxicity.label_model(doc, voter, known, seed, rounds).posterior, post, atol=1e-5)


def test_toxicity_has_a_voter_for_every_word(spark):
    r = np.random.default_rng(6)
    bad = [f"{chr(97 + k // 26)}{chr(97 + k % 26)}qj{k}" for k in range(100)]  # each in a few texts of many
    rows = [(i, sentence(r, 12, 300) + (f" {bad[i // 5 % 100]}" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(6000)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int"))
    assert np.isin([toxicity.key_of(w) for w in bad], model.voters).all()


def test_quality_reads_all_lines(spark, monkeypatch):
    good, bad = "A plain line of quiet words.", "BUY!! NOW!! $$$ ### 99"
    docs = spark.createDataFrame([(i, "\n".join([good] * 60 + [bad if i % 2 else good] * 60)) for i in range(60)], "doc_id long, text string")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda own, size, label: seen.extend(len(x) for x in own))
    quality.train(docs, docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality")))
    assert set(seen) == {120}


def test_html(spark, empty):
    model = html_extract.train()
    wrong = 0
    pages = list(html_extract.labelled_pages(100, seed=77))
    for page in pages:
        want = "\n".join(b[0] for b in html_extract.blocks(page) if b[4])
        wrong += html_extract.main_text([page], model)[0] != want
    assert wrong <= 5
    page = '<html><head><title>T</title></head><body><nav><a href="/">Home</a></nav><article><h1>Big &amp; bold</h1><p>First  part<br>goes &lt;on&gt; here.<p>Second <b>one</b>.</article><div class="comments"><p>Nice!</p></div><script>var x="<p>no</p>"</script><footer>&copy; me</footer>'
    table = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<<<>>&bogus;<p"), (1, "u", page)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(table, model).collect()}
    text = "Big & bold\nFirst part goes <on> here.\nSecond one."
    assert got[1] == (text, len(text)) and got[2] == ("", 0) and got[3] == ("", 0)
    assert html_extract.extract(table.limit(0), model).count() == 0


def test_near_dedup_filter_without_ids(spark):
    import corpus_pipeline as P

    r = np.random.default_rng(8)
    a, b, c, d = (sentence(r, 60, 5000) for _ in range(4))
    rows = [(None, a), (None, b), (7, c), (7, d), (None, ""), (None, " \n"), (8, ""), (8, "..."), (9, a + " tail"), (None, a + " two more"), (7, c + " tail")]
    kept = P.near_dedup_filter(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    got = Counter((x.doc_id, x.text) for x in kept)
    c_kept = (7, c) if (7, c) in got else (7, c + " tail")
    assert got == Counter([(9, a + " tail"), (None, b), c_kept, (7, d), (None, ""), (None, " \n"), (8, ""), (8, "...")])


def test_pipeline(spark, tmp_path, sf_dir):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "shard_documents":
            assert out.columns == columns
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "near_dedup_filter":
            assert len(ids) == len(set(ids))
            sets = [shingles(before[i]) for i in ids]
            linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
            assert not linked
        if name == "decontamination_filter":
            flagged = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
            assert set(before) - set(ids) == {r.doc_id for r in flagged.collect()}
        docs = out
    assert docs.count() > 0
