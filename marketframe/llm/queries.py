"""The queries op1 to op13 over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketframe.llm import bpe, decontaminate, exact_dedup, html_extract, mixing, near_dedup, phrases, quality, sharding, substring_dedup, suffix_dedup, toxicity, whitening
from marketframe.session import ship

SHARDS = 16


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_docs(spark, sf_dir), [1.0] * SHARDS)


def op2_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(_docs(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), quality.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_key")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_docs(spark, sf_dir))


def op6_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_docs(spark, sf_dir)).drop("text_key", "root")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(ship(spark).read.parquet(f"{sf_dir}/pages.parquet"), html_extract.train())


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(_docs(spark, sf_dir))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(_docs(spark, sf_dir))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    made = _docs(spark, sf_dir).select("doc_id", bpe.encode(known, F.col("text")).alias("e"))
    shown = F.array_join(F.col("e.ids").cast("array<string>"), " ")
    back = bpe.decode(known, F.col("e.ids"), F.col("e.starts"))
    return made.select("doc_id", F.size("e.ids").cast("long").alias("n_tokens"), F.sha2(shown, 256).alias("ids_sha256"), F.sha2(back, 256).alias("decoded_sha256"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    known = (
        op1_rendezvous_sharding, op2_recompression_dedup, op3_quality_classifier, op4_benchmark_decontamination, op5_exact_dedup,
        op6_minmax_near_dedup, op7_toxicity, op8_html_extraction, op9_source_mixing, op10_suffix_dedup, op11_phrase_mining, op12_byte_bpe, op13_embedding_whitening,
    )
    return {f.__name__: f for f in known}


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _draws(shards: int) -> str:
    return f"""(select arg_min(s, -ln((('0x' || substr(md5(coalesce(cast(d.doc_id as varchar), 'null') || ':' || s), 1, 13))::bigint::double + 1.0) / {16**13 + 1}.0::double)) from range({shards}) r(s))"""


_OP1 = f"""
with d as (select *, coalesce(text, '') body, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') bytes from documents),
s as (
  select doc_id, strlen(body)::bigint + 1 size,
    xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(bytes, lambda b: [('0x' || b)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)::bigint text_crc32,
    {_draws(SHARDS)}::int shard, {_draws(SHARDS + 1)}::int grown_shard
  from d)
select doc_id, size, text_crc32, 'key' law, shard, row_number() over (partition by shard order by substr(md5('part:' || coalesce(cast(doc_id as varchar), 'null')), 1, 3), doc_id, text_crc32, size) - 1 slot, grown_shard from s
"""

_OP4 = f"""
with w as (select doc_id, row_number() over () rid, list_filter(string_split_regex(coalesce({_LOWER}, ''), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') ws from documents),
i as (select distinct item_id, ws, least(13, len(ws)) need from (select item_id, list_filter(string_split_regex(coalesce({_LOWER}, ''), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') ws from benchmark) where len(ws) > 0),
win as (select distinct item_id, need, array_to_string(ws[p:p + need - 1], ' ') g from (select *, unnest(range(1, len(ws) - need + 2)) p from i)),
pos as (select rid, need, p, array_to_string(ws[p:p + need - 1], ' ') g from (select w.rid, ws, need, unnest(range(1, len(ws) - need + 2)) p from w, (select distinct need from i) n where len(ws) >= need)),
hit as (select rid, item_id, win.need, p from pos join win using (need, g)),
cov as (select rid, count(distinct q) n_hit from (select rid, unnest(range(p, p + need)) q from hit) group by rid),
its as (select rid, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) ids from hit group by rid)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from w left join cov using (rid) left join its using (rid)
"""

_OP5 = f"""
with d as (select doc_id, coalesce({_LOWER}, '') norm from documents)
select doc_id, max(doc_id) over g keep_id, count(*) over g group_size, doc_id = max(doc_id) over g kept, sha256(norm) text_sha256
from d window g as (partition by norm)
"""

_OP9 = """
with d as (select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::bigint size,
    md5('mix|' || coalesce(cast(doc_id as varchar), 'null')) place from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, [3.0::double, 1.0::double, 2.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] weight, source_size * 2.0::double most from s),
l as (select *, ((sum(source_size) over ())::bigint * 1.5::double - coalesce(sum(most) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) level
  from w window before as (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding)),
f as (select *, (select arg_min(level, most / weight) from l where level * weight <= most) fits from l),
t as (select source, source_size, coalesce(least(most, fits * weight), most) target from f),
c as (select d.*, source_size, target, row_number() over () id, sum(size) over (partition by d.source order by place, doc_id, size rows unbounded preceding)::bigint - size as first
  from d join t on d.source is not distinct from t.source),
k as (select id, source, size, target, first + copy * source_size s, greatest(0, least(size, floor(target)::bigint - (first + copy * source_size)))::bigint early from c, range(2) r(copy)),
p as (select id, source, target, s, early words from k union all select id, source, target, s + early, size - early from k where s < target),
q as (select id, words, sum(words) over (order by (s + words)::double / target, source nulls last, s rows unbounded preceding) run from p where words > 0),
b as (select floor(1.5::double * coalesce(sum(size), 0))::bigint budget from d),
n as (select id, sum(greatest(0, least(words, budget - (run - words))))::bigint taken from q, b group by id)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint taken from c left join n using (id)
"""

_OP11 = f"""
with t as (select coalesce(lang, 'und') lang, unnest(string_split_regex({_LOWER.replace("text", "coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) piece from documents),
p as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') ws from t),
g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') phrase from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) i from p, range(1, 4) r(k) where len(ws) >= k)),
f as (select lang, k, phrase, count(*) f from g group by lang, k, phrase),
n as (select lang, sum(f)::bigint n from f where k = 1 group by lang),
c as (select lang, phrase, f a, string_split(phrase, ' ') ws, k from f where k > 1 and f >= 10),
s as (select lang, array_to_string(ws[o:o + 1], ' ') phrase, max(a) most from c, range(1, 3) r(o) where k = 3 group by all),
kept as (select c.* from c left join s on s.lang = c.lang and s.phrase = c.phrase and c.k = 2 where s.phrase is null or 100 * most < 50 * a),
cut as (select lang, phrase, a, j, array_to_string(ws[1:j], ' ') lp, array_to_string(ws[j + 1:], ' ') rp from kept, range(1, 3) r(j) where j < k),
v as (select cut.*, x.f l, y.f r, (1000000::hugeint * a * a) // (x.f::hugeint * y.f) score from cut join f x on x.lang = cut.lang and x.phrase = lp join f y on y.lang = cut.lang and y.phrase = rp),
w as (select lang, phrase, a, unnest(arg_min(struct_pack(l := l, r := r, score := score), [score, j])) from v group by lang, phrase, a),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from w)
select lang, rank::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, n, score::bigint score from o join n using (lang) where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_rendezvous_sharding": _OP1, "op4_benchmark_decontamination": _OP4, "op5_exact_dedup": _OP5, "op9_source_mixing": _OP9, "op11_phrase_mining": _OP11}
