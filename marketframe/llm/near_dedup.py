"""Near-duplicate groups by min-max hashing.

A document's set is its distinct five-word shingles.  Under each permutation both
the least and the largest hash are kept, so ``PERMUTATIONS`` evaluations give
twice as many unbiased signature values; ``ROWS`` values make a band, and equal
bands make candidates.  At a similarity of 0.75 a pair shares none of the 30
bands with a probability below 1e-7.

Equal sets are one node from the start; two names of 64 bits tell sets apart.  Within a band's group, nodes are
compared with leaders, not with each other: first with the leader they share most
bands with, then, where a group still holds several components, with the other
leaders, with HUBS central members and with DRAWS members drawn at random.  These
rounds are there to save work: what then still lies in different components of one
group is compared by an exact prefix-filtered join, so that no link is lost there.
All links are confirmed on the full sets before they count, and groups are the
connected components of confirmed links.

Defined cases: null, empty and word-less texts have an empty set and are linked
with nothing; a text of fewer than five words is one shingle; repeated rows are
equal sets; a null doc_id never names a group that has other ids; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketframe.llm.arrays import LOWER, U64, mix, pieces, powers, prefix_sums, spans_hash, word_spans
from marketframe.llm.bitmap import array_of, has, passes
from marketframe.llm.components import components, rooted
from marketframe.llm.store import saved

WORDS, SHARE = 5, 75
PERMUTATIONS, ROWS = 45, 3
#: Further leaders of a group that still holds several components: central ones and random ones.
HUBS, DRAWS = 2, 1
#: Bits of the bitmap of nodes whose sets are needed, as a power of 2: 1 MB.
BITS = 23
_MULTIPLIERS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * U64(0xD1342543DE82EF95)) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All documents' distinct shingles as 48-bit numbers, sorted within each document, and where each document's begin."""
    lower = LOWER[data]
    ws, we, first = word_spans(lower, offsets)
    n = np.diff(first)
    sums = prefix_sums(spans_hash(prefix_sums(lower), ws, we))
    per = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), per)
    begin = np.concatenate([[0], np.cumsum(per)])
    start = np.arange(begin[-1]) - begin[doc] + first[:-1][doc]
    size = np.minimum(n, WORDS)[doc]
    h = mix(((sums[start + size] - sums[start]) * powers(len(sums))[1][start]) + size.astype(U64))
    rows = 1 << 15  # documents numbered within the top 15 bits; pieces of more are done in turns
    out, counts = [], np.zeros(len(n), np.int64)
    for a in range(0, len(n), rows):
        part = slice(begin[a], begin[min(a + rows, len(n))])
        key = np.sort(((doc[part] - a).astype(U64) << U64(48)) | (h[part] >> U64(16)))
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new]
        found = np.bincount((key >> U64(48)).astype(np.int64), minlength=min(rows, len(n) - a))
        counts[a : a + len(found)] = found
        out.append(key & U64((1 << 48) - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def set_ids(shingles: np.ndarray, first: np.ndarray, a: int = 1, b: int = 7) -> np.ndarray:
    """A 64-bit name of each non-empty set, another one for other ``a`` and ``b``; 0 for empty ones."""
    some = np.diff(first) > 0
    ids = np.zeros(len(first) - 1, np.uint64)
    if some.any():
        at = first[:-1][some]
        ids[some] = mix(np.add.reduceat(mix(shingles + U64(a)), at) + mix(np.bitwise_xor.reduceat(mix(shingles + U64(b)), at)))
    return ids


def band_keys(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bands' keys of each document (documents x bands)."""
    some = np.diff(first) > 0
    low = np.zeros((PERMUTATIONS, len(first) - 1), np.uint64)
    high = np.zeros_like(low)
    if some.any():
        at = first[:-1][some]
        base = mix(shingles + U64(1))
        for j, m in enumerate(_MULTIPLIERS):
            value = base * m
            low[j, some] = np.minimum.reduceat(value, at)
            high[j, some] = np.maximum.reduceat(value, at)
    both = np.concatenate([low, high])
    bands = len(both) // ROWS
    key = np.zeros((bands, both.shape[1]), np.uint64)
    for k in range(ROWS):
        key = mix(key * U64(0x9FB21C651E98DF25) + both[np.arange(bands) * ROWS + k] + np.arange(bands, dtype=np.uint64)[:, None])
    return key.T


def second_ids(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    return set_ids(shingles, first, 11, 13)


def _signed(texts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, text_key, node, n, bands) of each document, and a bitmap of the names that several sets share: there the second name is the node."""

    def of(batches):
        for batch in batches:
            for row, data, offsets in pieces(batch.column("text")):
                shingles, first = shingle_sets(data, offsets)
                keys = band_keys(shingles, first)
                n = len(offsets) - 1
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * keys.shape[1]), pa.array(np.ascontiguousarray(keys).reshape(-1).view(np.int64)))
                names = [pa.array(name(shingles, first).view(np.int64)) for name in (set_ids, second_ids)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, n), batch.column("text_key").slice(row, n), *names, pa.array(np.diff(first)), flat], ["doc_id", "text_key", "node", "second", "n", "bands"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    signed = saved(texts.mapInArrow(of, f"doc_id {kind}, text_key long, node long, second long, n long, bands array<long>"))
    several = signed.where("n > 0").groupBy("node").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low <> high")
    clashes = array_of(several, "node", BITS)
    if clashes.any():
        signed = signed.withColumn("node", F.when(passes(clashes, F.col("node")), F.col("second")).otherwise(F.col("node")))
    return signed.drop("second"), clashes


def sets_of(docs: DataFrame, wanted: DataFrame, clashes: np.ndarray) -> DataFrame:
    """(node, shingles) of the nodes of ``wanted``, once each, and of few others: a bitmap of fixed size spares most other sets."""
    bitmap = docs.sparkSession.sparkContext.broadcast(array_of(wanted, "node", BITS))
    shared = docs.sparkSession.sparkContext.broadcast(clashes) if clashes.any() else None

    def of(batches):
        bits = bitmap.value
        for batch in batches:
            for _, data, offsets in pieces(batch.column("text")):
                shingles, first = shingle_sets(data, offsets)
                ids = set_ids(shingles, first)
                if shared is not None:
                    ids = np.where(has(shared.value, ids), second_ids(shingles, first), ids)
                take = np.flatnonzero(has(bits, ids) & (np.diff(first) > 0))
                yield pa.RecordBatch.from_arrays([pa.array(ids[take].view(np.int64)), pa.array([shingles[first[i] : first[i + 1]].tobytes() for i in take], pa.binary())], ["node", "shingles"])

    found = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(of, "node long, shingles binary")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def similar(a: pa.Array, b: pa.Array) -> pa.Array:
    """100 * intersection >= SHARE * union of two sorted sets."""
    out = []
    for x, y in zip(a, b, strict=True):
        u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        both = len(u) + len(v) - len(np.union1d(u, v))
        out.append(100 * both >= SHARE * (len(u) + len(v) - both))
    return pa.array(out, pa.bool_())


def _confirmed(pairs: DataFrame, docs: DataFrame, clashes: np.ndarray, sets: DataFrame | None = None) -> DataFrame:
    """The pairs (a, b) that are similar; a's set moves to its leader b."""
    pairs = saved(pairs.select("a", "b").distinct())
    sets = sets if sets is not None else saved(sets_of(docs, pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))), clashes))
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
    with_b = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
    return saved(with_b.where(F.arrow_udf(similar, "boolean")("set_a", "set_b")).select("a", "b"))


def _fits(n: Column, m: Column) -> Column:
    """The length bound: the smaller set is at least SHARE % of the larger."""
    return 100 * F.least(n, m) >= SHARE * F.greatest(n, m)


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after ``links`` (a, b) have joined components; nodes that get their first link come in."""
    root = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    between = links.join(root, "a", "left").join(root.select(F.col("a").alias("b"), F.col("root_a").alias("root_b")), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    lone = joined.select(F.col("root").alias("node"), "top")  # nodes that get their first link now
    tops = roots.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return saved(tops.union(lone.join(roots, "node", "left_anti").select("node", F.col("top").alias("root"))))


def _elements(batches):
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles")]
        at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at)) for c in ("node", "n", "root")], pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], ["node", "n", "root", "shingle"])


def _residual(members: DataFrame, tops: DataFrame, docs: DataFrame, clashes: np.ndarray) -> DataFrame:
    """All links (a, b) between different components of the groups that still hold several.

    A link's nodes share a shingle within the rarest 25 % of both; positions and lengths bound what two
    nodes that share it can have in common.  Of a shingle's pairs one node at least lies outside
    the component that most of its nodes are of, so a group's main component never meets itself."""
    placed = saved(members.join(tops, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root")))
    open_ = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    nodes = saved(placed.join(open_, "band").select("node", "n", "root").distinct())
    sets = saved(sets_of(docs, nodes, clashes).join(nodes, "node"))
    rows = sets.mapInArrow(_elements, "node long, n long, root long, shingle long")
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("often", "shingle"))
    need = F.floor((SHARE * F.col("n") + 99) / 100)
    first = saved(rows.join(counts, "shingle").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - need + 1).where("often > 1").drop("often"))
    main = first.groupBy("shingle", "root").count().groupBy("shingle").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    several = saved(first.join(main.select("shingle", "main"), "shingle"))
    x, y = several.where("root <> main").alias("x"), several.alias("y")
    both = 1 + F.least(F.col("x.n") - F.col("x.rank"), F.col("y.n") - F.col("y.rank"))
    enough = (100 + SHARE) * both >= SHARE * (F.col("x.n") + F.col("y.n"))
    on = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root")) & _fits(F.col("x.n"), F.col("y.n")) & enough
    pairs = x.join(y, on).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"))
    return _confirmed(pairs, docs, clashes, sets.select("node", "shingles"))


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_key (a hash of the text, for joins),
    root (the component's own key, independent of doc_id; null for an empty set)."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    signed, clashes = _signed(texts)
    nodes = signed.where("n > 0").groupBy("node").agg(F.first("bands").alias("bands"), F.max("n").alias("n"))
    in_band = nodes.select("node", "n", F.explode("bands").alias("band"))
    groups = in_band.groupBy("band").agg(F.min(F.struct("node", "n")).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = saved(in_band.join(saved(groups.select("band", "lead", "size")), "band").select("band", "node", "n", "lead", "size"))

    cands = saved(members.where("node <> lead.node").where(_fits(F.col("n"), F.col("lead.n"))).groupBy(F.col("node").alias("a"), F.col("lead.node").alias("b")).count())
    best = cands.groupBy("a").agg(F.max(F.struct("count", F.col("b").alias("b"))).alias("best")).select("a", F.col("best.b").alias("b"))
    links = _confirmed(best, docs, clashes)
    roots = rooted(links)  # a leader's id is less than its follower's
    # groups that still hold several components; nodes without links are components of their own
    # a node in large groups in many bands is like most of its group: the text that the others were made from
    central = members.groupBy("node").agg(F.sum("size").alias("central"))
    placed = saved(members.join(central, "node").join(roots, "node", "left").select("band", "node", "n", "central", F.coalesce("root", "node").alias("root")))
    share = F.pmod(F.xxhash64("node", F.lit("hub")), F.lit(HUBS))  # the most central one of each of HUBS random parts
    keys = [*[F.when(share == k, -F.col("central")) for k in range(HUBS)], *[F.xxhash64("node", F.lit(k)) for k in range(DRAWS)]]
    drawn = [F.min(F.when(key.isNotNull(), F.struct(key.alias("draw"), "node", "n", "root"))).alias(f"lead{k}") for k, key in enumerate(keys)]
    open_ = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.array(*drawn).alias("leads")).where("low <> high").select("band", "leads")
    near = placed.join(open_, "band").select("node", "n", "root", F.explode(F.array_distinct(F.array_compact(F.transform("leads", lambda x: F.when(x.isNotNull(), F.struct(x["node"].alias("node"), x["n"].alias("n"), x["root"].alias("root"))))))).alias("lead")).where("root <> lead.root").where(_fits(F.col("n"), F.col("lead.n")))
    root = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    rest = cands.select("a", "b").join(links, ["a", "b"], "left_anti").join(root, "a", "left").join(root.select(F.col("a").alias("b"), F.col("root_a").alias("root_b")), "b", "left")
    rest = rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    pairs = rest.union(near.select(F.greatest("node", "lead.node").alias("a"), F.least("node", "lead.node").alias("b"))).distinct()
    more = _confirmed(pairs.join(best, ["a", "b"], "left_anti"), docs, clashes)
    tops = _merged(roots, more)
    tops = _merged(tops, _residual(members, tops, docs, clashes))

    own = signed.select("doc_id", "text_key", "node", "n")
    # tables of their own, so that the joins may split a node or group that very many documents share
    named = saved(own.where("n > 0").join(tops, "node", "left").withColumn("root", F.coalesce("root", "node")))
    first = saved(named.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    some = named.join(first, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "text_key", "root")
    none = own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "text_key", F.lit(None).cast("long").alias("root"))
    return some.union(none).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key", "root")
