"""The registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blockdedup, decontamination, extraction, language, mixing, neardup, neighbours, pii, sharding, suffixdedup
from .common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs, ~language.held_out())
    return language.predict(docs, model).withColumn("held_out", language.held_out())


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_pages(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(table(spark, sf_dir, "documents"))
    found = F.expr("n_email + n_ip + n_card + n_phone + n_key + n_id")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_key", "n_id", found.alias("n_found"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def quality(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): 2 for documents labelled as of high quality; all others count 1."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id", F.lit(2.0).alias("quality")).distinct()


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_documents(table(spark, sf_dir, "documents"), quality(table(spark, sf_dir, "labels")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockdedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text", "n_spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_language_id, op3_html_extraction, op4_suffix_dedup, op5_near_dedup, op6_personal_data, op7_sharding, op8_nearest_neighbours, op9_mixing, op10_substring_dedup)}


WORDS = "regexp_extract_all({0}, '[^ \\t-\\r]+')"

OP4_SQL = """with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents), w as (select doc_id, unnest(range(length(h) // 2 - 399)) as s, h from d where length(h) >= 800),
k as (select doc_id, s, md5(h[2 * s + 1:2 * s + 800]) as k from w), r as (select doc_id, s, s - row_number() over (partition by doc_id order by s) as g, s - lag(s) over (partition by doc_id order by s) as gap from k where k in (select k from k group by k having count(*) > 1)),
i as (select doc_id, s, sum(case when gap is null or gap > 400 then 1 else 0 end) over (partition by doc_id order by s) as i from r), m as (select doc_id, min(s) as a, max(s) + 400 as b from i group by doc_id, i),
e as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as p from m), f as (select doc_id, sum(b - a)::bigint as gone, count(*) as spans, max(b) as last from e group by doc_id),
p as (select e.doc_id, string_agg(h[2 * p + 1:2 * a], '' order by a) as kept from e join d using (doc_id) group by e.doc_id)
select d.doc_id, length(h) // 2 as n_bytes, coalesce(gone, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(case when f.doc_id is null then h else kept || h[2 * last + 1:] end)) as kept_sha256 from d left join f using (doc_id) left join p using (doc_id)"""

OP5_SQL = f"""with recursive w as (select doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 3 then [hash(w[i:i + 2]) for i in range(1, len(w) - 1)] when len(w) > 0 then [hash(w)] else [] end) as k from w), n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2), l as (select a, b from c join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l), r as (select a as node, b as far from e union select r.node, e.b from r join e on r.far = e.a)
select w.doc_id, coalesce(n.n, 0) as n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) as component_id, w.doc_id <= coalesce(m, w.doc_id) as kept from w left join n using (doc_id) left join (select node, min(far) as m from r group by node) t on w.doc_id = t.node"""

OP10_SQL = f"""with d as (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents), k as (select doc_id, unnest(range(len(w) - 49)) as s, unnest([md5(array_to_string(w[i + 1:i + 50], ' ')) for i in range(len(w) - 49)]) as k from d where len(w) >= 50),
f as (select k, min(doc_id) as m from k group by k), g as (select distinct doc_id, unnest(range(s, s + 50)) as i from k join f using (k) where m < doc_id), x as (select doc_id, unnest(range(len(w))) as i, unnest(w) as word from d),
r as (select x.doc_id, string_agg(word, ' ' order by x.i) filter (g.i is null) as kept, count(g.i) as gone from x left join g on x.doc_id = g.doc_id and x.i = g.i group by x.doc_id)
select d.doc_id, len(w) as n_words, coalesce(gone, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join r using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """What SQL can say of the contracts; the other queries are tested against plain reimplementations."""
    return {"op4_suffix_dedup": OP4_SQL, "op5_near_dedup": OP5_SQL, "op10_substring_dedup": OP10_SQL}
