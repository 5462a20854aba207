"""The registered queries of the engine's operators over the driver's tables, each with its DuckDB SQL.

A query takes (spark, sf_dir). Where SQL cannot say it, or a seeded hash decides, there is no SQL and the tests hold the
operator against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import instructions as I  # noqa: E741
from ..functions import maths, templates, text, verifiers
from ..operators import contamination, convert, evaluation, filters, joins, packing, preferences, repetition, rewards, sampling, statistics, trees
from ..sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


#: Columns that DuckDB would give as HUGEINT or DECIMAL.
TYPES = {
    "keyword_filter": {"removed": "bigint", "kept": "bigint"},
    "empty_filter": {"empty_rows": "bigint"},
    "identity_filter": {"claims": "bigint"},
    "label_join": {"chars": "bigint"},
    "removal_report": {"kept": "bigint", "removed": "bigint"},
    "over_limits": {"n": "bigint"},
    "length_duel": {"wins": "bigint", "losses": "bigint", "ties": "bigint"},
    "check_counts": {"wrong": "bigint", '"right"': "bigint"},
    "format_rewards": {"format_reward": "double"},
    "score_summary": {"perfect": "bigint", "zero": "bigint"},
    "weighted_rewards": {"reward": "double"},
    "judge_scores": {"score": "double", "decision": "double"},
}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        name = f.__name__
        QUERIES[name] = f
        if sql:
            casts = ", ".join(f"{c}::{t} as {c}" for c, t in TYPES.get(name, {}).items())
            SQL[name] = f"select * replace ({casts}) from ({sql})" if casts else sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def chats(spark: SparkSession, sf: str) -> DataFrame:
    return convert.assemble(table(spark, sf, "conversations"))


def rounded(x, digits: int = 6):
    return F.round(x, digits)


# conversations


@query("select conv_id, count(*) as n_turns, string_agg(role || ': ' || text, chr(10) order by turn) as prompt from conversations group by conv_id")
def conv_assemble(spark, sf):
    return chats(spark, sf).select("conv_id", F.size("messages").cast("long").alias("n_turns"), convert.flatten_prompt("messages").alias("prompt"))


@query("""select conv_id, string_agg(case role when 'user' then 'User' when 'assistant' then 'Assistant' else upper(role[1]) || lower(role[2:]) end || ': ' || trim(text, ' ' || chr(10) || chr(9)), chr(10) || chr(10) order by turn) as transcript
from conversations where text <> '' group by conv_id""")
def conv_transcript(spark, sf):
    return chats(spark, sf).select("conv_id", convert.transcript("messages").alias("transcript"))


@query("select conv_id, arg_max(text, turn) as answer from conversations where role = 'assistant' group by conv_id")
def last_assistant(spark, sf):
    return chats(spark, sf).select("conv_id", convert.last_of("messages").alias("answer")).where("answer is not null")


@query("""with l as (select *, row_number() over (partition by conv_id order by turn) as m, count(*) over (partition by conv_id) as n from conversations)
select conv_id, count(*) as n_kept, string_agg(role || ': ' || text, chr(10) order by turn) as kept from l where not (n > 1 and m = n and role = 'assistant') group by conv_id""")
def drop_trailing_assistant(spark, sf):
    kept = convert.without_last_answer("messages")
    return chats(spark, sf).select("conv_id", F.size(kept).cast("long").alias("n_kept"), convert.flatten_prompt(kept).alias("kept"))


@query("""with l as (select conv_id, turn, role, text, row_number() over (partition by conv_id order by turn) - 1 as i from conversations)
select conv_id, bool_and(trim(text) <> '') and arg_max(role, turn) = 'assistant' as ends_properly, bool_and(role = case when i % 2 = 0 then 'user' else 'assistant' end) as alternates from l group by conv_id""")
def turn_validity(spark, sf):
    return chats(spark, sf).select("conv_id", filters.ends_properly("messages").alias("ends_properly"), filters.alternates("messages", "user", "assistant", "role").alias("alternates"))


@query("""select conv_id, string_agg(case role when 'system' then '<|system|>' || chr(10) || text || chr(10) when 'user' then '<|user|>' || chr(10) || text || chr(10)
 when 'assistant' then '<|assistant|>' || chr(10) || text || '</s>' || case when turn = m then '' else chr(10) end end, '' order by turn) as rendered
from (select *, max(turn) over (partition by conv_id) as m from conversations) group by conv_id""")
def chat_template(spark, sf):
    return chats(spark, sf).select("conv_id", templates.render("messages", "bars").alias("rendered"))


@query("""select c.conv_id, r.rn - 1 as turn, c.role, c.text from conversations c join (select conv_id, turn, row_number() over (partition by conv_id order by turn) as rn from conversations) r using (conv_id, turn)""")
def turns_round_trip(spark, sf):
    return convert.explode_turns(chats(spark, sf)).withColumn("turn", F.col("turn").cast("long"))


@query("""with recursive n as (select conv_id * 1000 + turn as id, conv_id, turn, role, text, lead(turn) over (partition by conv_id order by turn) as nxt,
 case when lag(turn) over (partition by conv_id order by turn) is null then null else conv_id * 1000 + lag(turn) over (partition by conv_id order by turn) end as pid from conversations),
w as (select id, 1 as size, length(text) as chars, nxt, role, conv_id from n where pid is null union all select n.id, w.size + 1, w.chars + length(n.text), n.nxt, n.role, n.conv_id from w join n on n.pid = w.id)
select conv_id, size, chars from w where nxt is null and role = 'assistant'""")
def reply_paths(spark, sf):
    from pyspark.sql.window import Window

    turns = table(spark, sf, "conversations")
    ident = F.col("conv_id") * 1000 + F.col("turn")
    parent = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    replies = turns.select(ident.cast("string").alias("message_id"), (F.col("conv_id") * 1000 + parent).cast("string").alias("parent_id"), "role", F.concat_ws("\u0001", F.col("conv_id").cast("string"), "text").alias("text"), F.lit(False).alias("deleted"), F.lit(1.0).alias("quality"))
    paths = trees.reply_paths(replies, user="user")
    body = F.aggregate("path", F.lit(0), lambda a, m: a + F.length(F.element_at(F.split(m["content"], "\u0001"), 2)))
    return paths.select(F.element_at(F.split(F.col("path")[0]["content"], "\u0001"), 1).cast("long").alias("conv_id"), F.size("path").alias("size"), body.cast("long").alias("chars"))


# text filters


@query("""select lang, count_if(regexp_matches(lower(text), '\\b(license|copyright|mail[0-9])')) as removed, count_if(not regexp_matches(lower(text), '\\b(license|copyright|mail[0-9])')) as kept from documents group by lang""")
def keyword_filter(spark, sf):
    one = F.array(convert.message("assistant", F.col("text")))
    flag = filters.any_message(one, lambda c: F.lower(c).rlike(r"\b(license|copyright|mail[0-9])"))
    return table(spark, sf, "documents").select("lang", flag.alias("hit")).groupBy("lang").agg(F.count_if("hit").alias("removed"), F.count_if(~F.col("hit")).alias("kept"))


@query("select count(*) as n, count_if(text is null or trim(text, ' ' || chr(10) || chr(9)) = '') as empty_rows from documents")
def empty_filter(spark, sf):
    flag = filters.has_empty_message(F.array(convert.message("user", F.col("text"))))
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), F.count_if(flag).alias("empty_rows"))


@query("select doc_id, round(len(regexp_extract_all(text, '[à-ÿ]')) / length(text), 6) as ratio from documents where length(text) > 0")
def script_ratio(spark, sf):
    return table(spark, sf, "documents").where("length(text) > 0").select("doc_id", rounded(filters.script_ratio("text", "[à-ÿ]")).alias("ratio"))


@query("""with d as (select source, 'I am an assistant made by ' || case doc_id % 3 when 0 then 'OpenAI' when 1 then 'nobody' else 'a team' end || '. ' || text as t, doc_id % 3 = 0 as bad from documents)
select source, count(*) as n, count_if(bad) as claims from d group by source""")
def identity_filter(spark, sf):
    who = F.when(F.col("doc_id") % 3 == 0, "OpenAI").when(F.col("doc_id") % 3 == 1, "nobody").otherwise("a team")
    said = F.concat(F.lit("I am an assistant made by "), who, F.lit(". "), "text")
    return table(spark, sf, "documents").select("source", filters.claims_identity(F.array(convert.message("assistant", said))).alias("c")).groupBy("source").agg(F.count("*").alias("n"), F.count_if("c").alias("claims"))


@query("""with d as (select doc_id, case when doc_id % 4 = 0 then 'As of my last update in March 2021, ' || text when doc_id % 4 = 1 then text || ' knowledge cutoff 2019' else text end as t from documents)
select doc_id, case doc_id % 4 when 0 then 'As of my last update in March 2021' when 1 then 'knowledge cutoff 2019' else '' end as found from d""")
def cutoff_filter(spark, sf):
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("As of my last update in March 2021, "), "text")).when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" knowledge cutoff 2019"))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(filters.cutoff_matches(F.array(convert.message("assistant", t))), "|").alias("found"))


@query("select coalesce(l.toxic, -1) as toxic, coalesce(l.quality, -1) as quality, count(*) as n, sum(d.n_chars) as chars from documents d left join labels l using (doc_id) group by 1, 2")
def label_join(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.groupBy(F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.coalesce("quality", F.lit(-1)).alias("quality")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""with d as (select d.doc_id, coalesce(l.toxic, 0) = 0 as ok1, lower(lang) = 'en' as ok2, source not in ('src0', 'src1') as ok3 from documents d left join (select doc_id, max(toxic) as toxic from labels group by 1) l using (doc_id)),
s as (select count(*) as n, count_if(ok1) as a, count_if(ok1 and ok2) as b, count_if(ok1 and ok2 and ok3) as c from d)
select 'toxic' as step, a as kept, n - a as removed, round((n - a) / n, 6) as removed_share from s union all select 'language', b, a - b, round((a - b) / a, 6) from s union all select 'source', c, b - c, round((b - c) / b, 6) from s""")
def removal_report(spark, sf):
    toxic = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = table(spark, sf, "documents").join(toxic, "doc_id", "left")
    steps = [("toxic", F.coalesce(F.col("toxic"), F.lit(0)) == 0), ("language", F.lower("lang") == "en"), ("source", filters.not_from(["src0", "src1"]))]
    return filters.removal_report(rows, steps).withColumn("removed_share", rounded("removed_share"))


@query("select doc_id, trim(replace(replace(replace(replace('<think>' || text || '</think>', '<think>', chr(10)), '</think>', ''), '<answer>', chr(10) || chr(10)), '</answer>', ''), ' ' || chr(10) || chr(9)) as plain from documents")
def special_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", convert.plain_tokens(F.concat(F.lit("<think>"), "text", F.lit("</think>"))).alias("plain"))


# repetition


@query("""with i as (select doc_id, unnest(string_split(text, chr(10))) as item, unnest(range(len(string_split(text, chr(10))))) as pos from documents),
s as (select doc_id, trim(item, ' ' || chr(9)) as item, pos from i where length(trim(item, ' ' || chr(9))) >= 10),
g as (select doc_id, item, pos, pos - row_number() over (partition by doc_id, item order by pos) as isl from s),
r as (select doc_id, item, isl, count(*) as n, min(pos) as p from g group by all)
select doc_id, md5(item) as item, cast(sum(n) as bigint) as total, min(p) as first, max(n) as run from r group by doc_id, item having sum(n) > 1""")
def repeated_lines(spark, sf):
    items = table(spark, sf, "documents").select("doc_id", F.posexplode(F.transform(F.split("text", "\n", -1), text.strip)).alias("pos", "item"))
    out = repetition.repeated_items(items, "doc_id", 10)
    return out.select("doc_id", F.md5("item").alias("item"), "total", F.col("first").cast("long").alias("first"), "run")


@query()
def block_repetition(spark, sf):
    return repetition.block_repetition(table(spark, sf, "documents"), paragraphs_at=3, sentences_at=10, runs_at=2, mark="\n").select("doc_id", "has_repetition", "repetition_reason")


@query("""with w as (select doc_id, regexp_extract_all(lower(text), '[^ \\t\\n\\r\\f\\v]+') as w from documents),
g as (select doc_id, unnest([array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)]) as ngram from w where len(w) >= 3)
select doc_id, md5(ngram) as ngram, count(*) as occurrences from g group by doc_id, ngram having count(*) >= 4""")
def ngram_repeats(spark, sf):
    return repetition.ngram_repetition(table(spark, sf, "documents"), 3, 4).select("doc_id", F.md5("ngram").alias("ngram"), "occurrences")


# statistics


@query("""select lang, 'n_chars' as name, count(n_chars) as count, round(avg(n_chars), 6) as mean, round(stddev_samp(n_chars), 4) as std, min(n_chars)::double as min, quantile_cont(n_chars, 0.25)::double as q25,
quantile_cont(n_chars, 0.5)::double as q50, quantile_cont(n_chars, 0.75)::double as q75, max(n_chars)::double as max from documents group by lang""")
def length_stats(spark, sf):
    out = statistics.describe(table(spark, sf, "documents"), ["n_chars"], ["lang"])
    return out.withColumn("mean", rounded("mean")).withColumn("std", rounded("std", 4))


@query("""select "limit", n, round(n / c, 6) as share from (select count(n_chars) as c, [struct_pack("limit" := 512, n := count_if(n_chars > 512)), struct_pack("limit" := 1024, n := count_if(n_chars > 1024)), struct_pack("limit" := 4096, n := count_if(n_chars > 4096))] as r from documents) t, unnest(t.r) as u(x), lateral (select x."limit" as "limit", x.n as n)""")
def over_limits(spark, sf):
    return statistics.over_limits(table(spark, sf, "documents"), "n_chars", (512, 1024, 4096)).withColumn("share", rounded("share"))


@query("select doc_id, n_chars from documents order by n_chars desc, doc_id limit 100")
def longest_100(spark, sf):
    return statistics.longest(table(spark, sf, "documents"), "doc_id", "n_chars")


@query("""with c as (select lang, n_chars // 20000 as bin, count(*) as n from documents group by 1, 2),
t as (select lang, bin, n, sum(n) over (partition by lang) as t from c), m as (select case when t >= 120 then lang else 'Other' end as category, bin, sum(n) as n from t group by 1, 2)
select category, bin::int as bin, n::bigint as n, (sum(n) over (partition by category))::bigint as category_total from m""")
def length_histogram(spark, sf):
    return statistics.histogram(table(spark, sf, "documents"), "n_chars", 20000.0, F.col("lang"), 120)


@query("""select source, count(*) as rows, sum(n_chars)::bigint as chars, round(count(*) / sum(count(*)) over (), 6) as rows_share, round(sum(n_chars) / sum(sum(n_chars)) over (), 6) as chars_share from documents group by source""")
def source_shares(spark, sf):
    sums = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars"))
    out = statistics.with_shares(sums, ["rows", "chars"])
    return out.withColumn("rows_share", rounded("rows_share")).withColumn("chars_share", rounded("chars_share"))


@query("""select count(n_chars) as n, min(n_chars) as min, round(avg(n_chars), 6) as mean, quantile_cont(n_chars, 0.5) as median, max(n_chars) as max, round(list_sum(quantile_cont(n_chars, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])), 4) as decile_sum from documents""")
def deciles(spark, sf):
    out = statistics.deciles(table(spark, sf, "documents"), "n_chars")
    return out.select("n", "min", rounded("mean").alias("mean"), "median", "max", rounded(F.aggregate("deciles", F.lit(0.0), lambda a, x: a + x), 4).alias("decile_sum"))


@query("""select conv_id, count(*) filter (role <> 'system')::int as n_turns, coalesce(sum(length(text)) filter (role = 'user'), 0)::bigint as "user", coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as assistant, coalesce(sum(length(text)) filter (role <> 'system'), 0)::bigint as total from conversations group by conv_id""")
def conversation_lengths(spark, sf):
    out = statistics.conversation_lengths(chats(spark, sf), "conv_id", lambda c: F.length(c))
    return out.select("conv_id", "n_turns", *[F.col(c).cast("long").alias(c) for c in ("user", "assistant", "total")])


# sampling and mixing


@query("""with r as (select *, row_number() over (partition by lang order by doc_id) as k, count(*) over (partition by lang) as n from documents where lang in ('en', 'fr', 'de'))
select lang as dataset_source, doc_id from r where k <= floor(n * case lang when 'en' then 0.5 when 'fr' then 0.25 else 1.0 end)""")
def mix_shares(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    parts = {x: docs.where(F.col("lang") == x) for x in ("en", "fr", "de")}
    shares = {"en": sampling.Share(0.5), "fr": sampling.Share(0.25), "de": sampling.Share(1.0)}
    return sampling.mix(parts, shares, "doc_id", seed=None).select("dataset_source", "doc_id")


@query("""with r as (select *, row_number() over (partition by lang order by doc_id) as k from documents where lang in ('en', 'fr'))
select lang as dataset_source, doc_id from r where k <= case lang when 'en' then 40 else 10 end""")
def mix_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    parts = {x: docs.where(F.col("lang") == x) for x in ("en", "fr")}
    return sampling.mix(parts, {"en": sampling.amount("40"), "fr": sampling.amount("10")}, "doc_id", seed=None).select("dataset_source", "doc_id")


@query("""with n as (select count(*) as n from labels) select doc_id, true as fair, (select 5 * n // 2 from n) as rows from labels""")
def upsample(spark, sf):
    labels = table(spark, sf, "labels")
    n = labels.count()
    out = sampling.upsample(labels, 5 * n // 2, "doc_id", size=n).groupBy("doc_id").agg(F.count("*").alias("c"), F.countDistinct("copy").alias("copies"))
    total = out.agg(F.sum("c")).first()[0]
    # every row twice, some of them, at random, once more
    return out.select("doc_id", (F.col("c").between(2, 3) & (F.col("c") == F.col("copies"))).alias("fair"), F.lit(total).cast("long").alias("rows"))



@query("select source, doc_id from (select *, row_number() over (partition by source order by doc_id) as k from documents) where k <= 10")
def per_source_cap(spark, sf):
    return sampling.per_group(table(spark, sf, "documents").select("source", "doc_id"), "source", 10, "doc_id")


@query("""with c as (select conv_id, count(*) as n from conversations group by 1) select conv_id, 4::bigint as rows, 4::bigint as different, true as inside from c where n >= 4""")
def exactly_per_group(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("k", F.col("conv_id") * 1000 + F.col("turn"))
    out = sampling.exactly_per_group(turns, "conv_id", 4, "k").groupBy("conv_id").agg(F.count("*").alias("rows"), F.countDistinct("k").alias("different"), F.array_sort(F.collect_list("k")).alias("ks"))
    every = turns.groupBy("conv_id").agg(F.collect_list("k").alias("every"))
    return out.join(every, "conv_id").select("conv_id", "rows", "different", (F.size(F.array_except("ks", "every")) == 0).alias("inside"))


@query("""with n as (select least(100, floor(0.1 * count(*))::bigint) as d from documents), r as (select doc_id, row_number() over (order by doc_id) as k from documents)
select doc_id, case when k <= d then 'dev' else 'train' end as part from r, n""")
def head_split(spark, sf):
    train, dev = sampling.head_split(table(spark, sf, "documents").select("doc_id"), 0.1, 100, "doc_id")
    return train.withColumn("part", F.lit("train")).unionByName(dev.withColumn("part", F.lit("dev")))


@query("select min(doc_id) as doc_id, count(*) as copies from documents group by text")
def exact_dedup(spark, sf):
    digest = F.sha2("text", 256)
    return table(spark, sf, "documents").groupBy(digest.alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("select doc_id from documents where doc_id in (select doc_id from labels) and doc_id in (select item_id from benchmark)")
def ids_in_all(spark, sf):
    frames = [table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"))]
    return sampling.in_all(frames, "doc_id")


@query("""with p as (select conv_id, role, turn, length(text) as n, row_number() over (partition by conv_id, role order by length(text) desc, turn) as k from conversations) select conv_id, role, turn, n from p where k = 1""")
def longest_per_group(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "role", "turn", F.length("text").cast("long").alias("n"))
    return sampling.first_per_key(rows, ["conv_id", "role"], [F.desc("n"), "turn"])


@query("select doc_id, (row_number() over (order by doc_id) - 1) // 250 as shard from documents")
def fixed_shards(spark, sf):
    return sinks.in_shards(table(spark, sf, "documents").select("doc_id"), 250, [F.col("doc_id")])


@query("""with o as (select doc_id, n_chars, sum(n_chars) over (order by doc_id) - n_chars as s, sum(n_chars) over (order by doc_id) as e from documents where n_chars > 0),
c as (select unnest(range((s // 100000)::bigint, ((e - 1) // 100000 + 1)::bigint)) as chunk, doc_id, s, e from o)
select chunk::bigint as chunk, doc_id, (greatest(s, chunk * 100000) - chunk * 100000)::bigint as start, (least(e, chunk * 100000 + 100000) - chunk * 100000)::bigint as "end" from c""")
def chunk_boundaries(spark, sf):
    return sinks.chunk_boundaries(table(spark, sf, "documents"), "doc_id", "n_chars", 100_000)


@query("""select source, printf('%.4f', max(n_chars) filter (coalesce(lang, 'none') = 'de')::double) as de, printf('%.4f', max(n_chars) filter (coalesce(lang, 'none') = 'en')::double) as en, printf('%.4f', max(n_chars) filter (coalesce(lang, 'none') = 'es')::double) as es, printf('%.4f', max(n_chars) filter (coalesce(lang, 'none') = 'fr')::double) as fr, printf('%.4f', max(n_chars) filter (coalesce(lang, 'none') = 'none')::double) as none from documents group by source""")
def score_matrix(spark, sf):
    return sinks.matrix(table(spark, sf, "documents").withColumn("lang", F.coalesce("lang", F.lit("none"))), "source", "lang", "n_chars", ["de", "en", "es", "fr", "none"])


@query("""select count(*) as responses, sum(cast(json_extract(props, '$.k') as bigint))::bigint as prompt_tokens, 0::bigint as completion_tokens, round(sum(cast(json_extract(props, '$.k') as bigint)) * 2.5 / 1e6, 6) as cost from events""")
def usage_cost(spark, sf):
    body = F.to_json(F.struct(F.struct(F.get_json_object("props", "$.k").cast("long").alias("prompt_tokens")).alias("usage")))
    return sinks.usage_cost(table(spark, sf, "events").select(body.alias("body")), "body", 2.5, 10.0).withColumn("cost", rounded("cost"))


# contamination


@query("""with q as (select item_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ' ') as q from benchmark), d as (select doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ' ') || ' ' as d from documents)
select item_id, doc_id as original_id from q join d on q <> '' and contains(d, ' ' || q || ' ')""")
def contamination_exact(spark, sf):
    return contamination.exact_match(contamination.index_texts(table(spark, sf, "documents"), "doc_id"), table(spark, sf, "benchmark"), "item_id", ["text"])


NGRAM_SQL = """with q as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as q from benchmark), qg as (select item_id, len(q) as size, unnest(range(len(q) - 7)) as pos, unnest([array_to_string(q[i + 1:i + 8], ' ') for i in range(len(q) - 7)]) as g from q where len(q) >= 8),
d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as d from documents), dg as (select distinct doc_id, unnest([array_to_string(d[i + 1:i + 8], ' ') for i in range(len(d) - 7)]) as g from d where len(d) >= 8),
c as (select distinct item_id, doc_id, size, unnest(range(pos, pos + 8)) as t from qg join dg using (g)), s as (select item_id, doc_id as original_id, count(*) / any_value(size) as score from c group by item_id, doc_id)"""


@query(NGRAM_SQL + " select item_id, original_id, round(score, 6) as score from s")
def contamination_ngram(spark, sf):
    index = contamination.index_texts(table(spark, sf, "documents"), "doc_id")
    return contamination.ngram_scores(index, table(spark, sf, "benchmark"), "item_id", ["text"]).withColumn("score", rounded("score"))


@query(NGRAM_SQL + ", b as (select distinct original_id from s where score > 0.5) select (select count(*) from documents) as total, count(*) as removed, round(1 - count(*) / (select count(*) from documents), 6) as kept_share from b")
def contamination_report(spark, sf):
    docs = table(spark, sf, "documents")
    scores = contamination.ngram_scores(contamination.index_texts(docs, "doc_id"), table(spark, sf, "benchmark"), "item_id", ["text"])
    return contamination.decontaminate(docs, "doc_id", contamination.contaminated(scores, 0.5))[1].withColumn("kept_share", rounded("kept_share"))


@query("""with v as (select vec_id, embedding::double[] as e, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings), s as (select q.vec_id as query_id, d.vec_id as original_id, list_inner_product(q.e, d.e) / (q.n * d.n) as s from v q, v d where q.vec_id % 20 = 0 and d.vec_id <> q.vec_id)
select query_id, original_id, round(s, 6) as score, rank::int as rank from (select *, row_number() over (partition by query_id order by s desc, original_id) as rank from s) where rank <= 5""")
def vector_top5(spark, sf):
    v = table(spark, sf, "embeddings")
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = v.select(F.col("vec_id").alias("original_id"), "embedding")
    return contamination.vector_scores(index, queries, "query_id", others_only=True).withColumn("score", rounded("score"))


# preferences


@query("""with s as (select user_id, event_id, value, row_number() over (partition by user_id order by value desc, event_id) as hi, row_number() over (partition by user_id order by value, event_id desc) as lo, count(*) over (partition by user_id) as n from events)
select b.user_id as prompt, b.event_id as chosen, w.event_id as rejected from s b join s w on b.user_id = w.user_id and b.hi = 1 and w.lo = 1 where b.n > 1 and b.value <> w.value and b.value - w.value >= 100""")
def binarise_pairs(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.col("event_id").cast("string").alias("r"), "value", "event_id")
    out = preferences.binarise(rows, "user_id", "r", F.col("value"), "event_id", margin=100.0)
    return out.select("prompt", F.col("chosen")[1]["content"].cast("long").alias("chosen"), F.col("rejected")[1]["content"].cast("long").alias("rejected"))


@query("""with s as (select l_orderkey, l_linenumber, 0.65 * l_quantity + 0.8 * l_discount + 0.45 * l_tax as v from lineitem), r as (select *, row_number() over (partition by l_orderkey order by v desc, l_linenumber) as hi, row_number() over (partition by l_orderkey order by v, l_linenumber desc) as lo, count(*) over (partition by l_orderkey) as n from s)
select b.l_orderkey as prompt, b.l_linenumber as chosen, w.l_linenumber as rejected from r b join r w on b.l_orderkey = w.l_orderkey and b.hi = 1 and w.lo = 1 where b.n > 1 and b.v <> w.v""")
def weighted_binarise(spark, sf):
    score = preferences.mean_of(["l_quantity", "l_discount", "l_tax"], [0.65, 0.8, 0.45])
    rows = table(spark, sf, "lineitem").withColumn("r", F.col("l_linenumber").cast("string"))
    out = preferences.binarise(rows, "l_orderkey", "r", score, "l_linenumber")
    return out.select("prompt", F.col("chosen")[1]["content"].cast("int").alias("chosen"), F.col("rejected")[1]["content"].cast("int").alias("rejected"))


@query("""select user_id, max(n) as votes from (select user_id, event_type, count(*) as n from events group by 1, 2) group by user_id""")
def majority_vote(spark, sf):
    return preferences.majority(table(spark, sf, "events"), "user_id", "event_type").select("user_id", "votes")


@query("""select user_id, event_type, arg_max(event_id, (value, -event_id)) as chosen, arg_min(event_id, (value, event_id)) as rejected, max(value) as chosen_score, min(value) as rejected_score from events group by user_id, event_type""")
def rejection_sampling(spark, sf):
    return preferences.rejection_sample(table(spark, sf, "events"), "user_id", "event_id", "value", "event_id", ("event_type",))


@query("select a.conv_id, a.turn as i, b.turn as j from conversations a join conversations b on a.conv_id = b.conv_id and a.turn < b.turn")
def all_pairs(spark, sf):
    return preferences.all_pairs(table(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "i", "j")


@query("""select count(*) as pairs, round(avg((l_discount > l_tax)::int), 6) as accuracy, round(avg(ln(1 + exp(-(l_discount - l_tax)))), 6) as loss from lineitem""")
def pair_metrics(spark, sf):
    out = preferences.pair_metrics(table(spark, sf, "lineitem"), "l_discount", "l_tax")
    return out.select("pairs", rounded("accuracy").alias("accuracy"), rounded("loss").alias("loss"))


@query("""with t as (select conv_id, turn, role, length(text) as n from conversations), p as (select a.conv_id, a.turn, a.n as x, b.n as y from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant')
select count_if(x > y) as wins, count_if(x < y) as losses, count_if(x = y) as ties from p""")
def length_duel(spark, sf):
    rows = table(spark, sf, "conversations")
    a = rows.where("role = 'user'").select(F.struct("conv_id", "turn").alias("k"), "text")
    b = rows.where("role = 'assistant'").select(F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("k"), "text")
    return preferences.length_duel(a, b, "k", F.length("text"))


@query("select user_id, ts::varchar as last_ts, event_type from (select *, row_number() over (partition by user_id, event_type order by ts desc) as k from events) where k = 1")
def latest_annotation(spark, sf):
    out = evaluation.latest(table(spark, sf, "events"), "user_id", "event_type", "ts")
    return out.select("user_id", F.regexp_replace(F.col("ts").cast("string"), r"\.0+$", "").alias("last_ts"), "event_type")


# evaluation


def samples(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    return table(spark, sf, "events").groupBy("user_id").agg(F.transform(rows, lambda r: r["event_type"]).alias("samples")).withColumn("gold", F.lit("purchase"))


SAMPLES_SQL = "with e as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as k from events)"


@query(SAMPLES_SQL + " select user_id, bool_or(event_type = 'purchase' and k <= 1) as p1, bool_or(event_type = 'purchase' and k <= 5) as p5, bool_or(event_type = 'purchase' and k <= 40) as p40 from e group by user_id")
def pass_at_k(spark, sf):
    same = lambda a, b: a == b
    return samples(spark, sf).select("user_id", *[evaluation.pass_at("samples", "gold", k, same).alias(f"p{k}") for k in (1, 5, 40)])


@query(SAMPLES_SQL + ", v as (select user_id, event_type, count(*) as n, min(k) as f from e where k <= 40 group by 1, 2) select user_id, arg_max(event_type, (n, -f)) = 'purchase' as c40, arg_max(event_type, (n, -f)) as answer from v group by user_id")
def consensus_at_k(spark, sf):
    return samples(spark, sf).select("user_id", evaluation.consensus_at("samples", "gold", 40, lambda a, b: a == b).alias("c40"), evaluation.vote("samples", 40).alias("answer"))


ACCURACY_SQL = """with f as (select o_orderpriority as category, o_orderstatus as unit, o_totalprice > 150000 as main, o_orderkey % 3 = 0 as cons from orders), l as (select category, unit, 'main' as metric, main::int as ok from f union all select category, unit, 'cons', cons::int from f)
select 'overall' as scope, '' as value, metric, round(avg(ok), 6) as accuracy, count(*) as n from l group by metric union all select 'category', category, metric, round(avg(ok), 6), count(*) from l group by category, metric union all select 'unit', unit, metric, round(avg(ok), 6), count(*) from l group by unit, metric"""


@query(ACCURACY_SQL)
def accuracy_rollup(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("unit"), (F.col("o_totalprice") > 150000).alias("main"), (F.col("o_orderkey") % 3 == 0).alias("cons"))
    return evaluation.accuracy(rows, ["main", "cons"], ["category", "unit"]).withColumn("accuracy", rounded("accuracy"))


@query("select l_returnflag, count_if(l_quantity <= 25) as wrong, count_if(l_quantity > 25) as \"right\", round(avg((l_quantity > 25)::int), 6) as share_right from lineitem group by l_returnflag")
def check_counts(spark, sf):
    out = evaluation.check_counts(table(spark, sf, "lineitem").withColumn("ok", F.col("l_quantity") > 25), "ok", "l_returnflag")
    return out.withColumn("share_right", rounded("share_right"))


@query("""with g as (select o_orderkey, o_custkey from orders), p as (select l_orderkey, count(*) as n from lineitem group by 1) select count(*) as gold, count(p.n) as predicted, count(*) - count(p.n) as missing from g left join p on o_orderkey = l_orderkey""")
def gold_join(spark, sf):
    predictions = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("output"))
    rows = joins.gold_with_predictions(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), predictions)
    return rows.agg(F.count("*").alias("gold"), F.count("output").alias("predicted"), F.count_if(F.col("output").isNull()).alias("missing"))


@query("select o_orderkey, l_linenumber, count(*) over (partition by o_orderkey) as num_outputs from orders join lineitem on o_orderkey = l_orderkey")
def one_to_many(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return joins.with_all_matches(table(spark, sf, "orders").select("o_orderkey"), lines, "o_orderkey")


@query("select doc_id from documents where trim(text, ' ' || chr(10) || chr(9)) not in (select trim(text, ' ' || chr(10) || chr(9)) from documents where source = 'src0')")
def without_texts(spark, sf):
    docs = table(spark, sf, "documents")
    return joins.without_texts(docs.select("doc_id", "text"), docs.where("source = 'src0'"), "text", "text").select("doc_id")


ANNOTATIONS_SQL = """with a as (select event_id % 200 as instance_id, user_id::varchar as evaluator, ts, 'm' || (event_id % 3) as model_a, 'm' || ((event_id // 3) % 3) as model_b, event_type in ('purchase', 'click') as ok_a, event_type in ('purchase', 'view') as ok_b,
 case event_type when 'purchase' then 'a-is-better' when 'click' then 'a-is-slightly-better' when 'view' then 'b-is-better' else 'tie' end as preference from events),
l as (select * from (select *, row_number() over (partition by instance_id, evaluator order by ts desc) as k from a) where k = 1)"""


def annotations(spark, sf):
    e, kind = table(spark, sf, "events"), F.col("event_type")
    yes = lambda c: F.when(c, "yes").otherwise("no")
    side = F.when(kind == "purchase", "a-is-better").when(kind == "click", "a-is-slightly-better").when(kind == "view", "b-is-better").otherwise("tie")
    return e.select(
        (F.col("event_id") % 200).alias("instance_id"), F.col("user_id").cast("string").alias("evaluator"), F.col("ts").alias("timestamp"),
        F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model_a"), F.concat(F.lit("m"), (F.floor(F.col("event_id") / 3) % 3).cast("string")).alias("model_b"),
        yes(kind.isin("purchase", "click")).alias("completion_a_is_acceptable"), yes(kind.isin("purchase", "view")).alias("completion_b_is_acceptable"), side.alias("preference"),
    )


@query(ANNOTATIONS_SQL + """ select least(model_a, model_b) as model_1, greatest(model_a, model_b) as model_2, count(*) as n,
round(avg((case when preference like 'a-is%' then model_a when preference like 'b-is%' then model_b else '' end = least(model_a, model_b))::int), 6) as wins_1,
round(avg((case when preference like 'a-is%' then model_a when preference like 'b-is%' then model_b else '' end = greatest(model_a, model_b))::int), 6) as wins_2, round(avg((preference = 'tie')::int), 6) as ties from l group by 1, 2""")
def win_rates(spark, sf):
    out = evaluation.win_rates(annotations(spark, sf))
    return out.select("model_1", "model_2", "n", *[rounded(c).alias(c) for c in ("wins_1", "wins_2", "ties")])


@query(ANNOTATIONS_SQL + """, s as (select instance_id, case when preference like 'a-is%' then 'a' when preference like 'b-is%' then 'b' else 'tie' end as side, row_number() over (partition by instance_id order by ts, evaluator) as r from l),
p as (select f.side as f, g.side as g from s f join s g on f.instance_id = g.instance_id and f.r = 1 and g.r = 2)
select count(*) as n, round(avg((f = g)::int), 6) as strict, round(avg(case when f = g then 1.0 when f = 'tie' or g = 'tie' then 0.5 else 0.0 end), 6) as relaxed from p""")
def preference_agreement(spark, sf):
    out = evaluation.preference_agreement(annotations(spark, sf))
    return out.select("n", rounded("strict").alias("strict"), rounded("relaxed").alias("relaxed"))


@query(ANNOTATIONS_SQL + """, s as (select instance_id, evaluator, ts, model_a as model, ok_a as ok from l union all select instance_id, evaluator, ts, model_b, ok_b from l), o as (select model, instance_id, ok, row_number() over (partition by model, instance_id order by ts, evaluator, ok) as r from s)
select f.model, count(*) as n, round(avg(f.ok::int), 6) as acceptance, round(avg(case when g.ok is not null then (f.ok = g.ok)::int end), 6) as agreement from (select * from o where r = 1) f left join (select * from o where r = 2) g on f.model = g.model and f.instance_id = g.instance_id group by f.model""")
def acceptance(spark, sf):
    out = evaluation.acceptance(annotations(spark, sf))
    return out.select("model", "n", rounded("acceptance").alias("acceptance"), rounded("agreement").alias("agreement"))


@query("select day(ts)::int as training_step, round(sum(value) - 20 * count(*), 2) as total_score, round(avg((value > 20)::int), 6) as solve_rate, count(value) as n from events group by 1")
def trace_statistics(spark, sf):
    rows = table(spark, sf, "events").select(F.dayofmonth("ts").alias("training_step"), "value", (F.col("value") - 20).alias("scores"))
    out = evaluation.trace_statistics(rows)
    return out.select("training_step", rounded(F.col("mean_score") * F.col("n"), 2).alias("total_score"), rounded("solve_rate").alias("solve_rate"), "n")


@query("select user_id, round(avg(value), 6) as reward, list_aggregate(list_sort(list(event_id)), 'string_agg', ',') as ids, arg_max(event_type, event_id) as last_type from events group by user_id")
def combine_metrics(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", F.array("event_id").alias("ids"), F.col("value").alias("reward"), F.col("event_type").alias("last_type"))
    out = evaluation.combine_metrics(rows, "user_id", "event_id", ["ids"], ["reward"], ["last_type"])
    return out.select("user_id", rounded("reward").alias("reward"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "last_type")


# rewards


@query("select event_id, round((value - avg(value) over w) / (stddev_pop(value) over w + 1e-8), 5) as advantage from events window w as (partition by user_id)")
def advantages(spark, sf):
    return rewards.advantages(table(spark, sf, "events"), "user_id", "value").select("event_id", rounded("advantage", 5).alias("advantage"))


@query("""select l_orderkey, count(*) as n, case when min(l_linestatus) <> max(l_linestatus) then 'mixed' when max(l_linestatus) = 'O' then 'zero' else 'solved' end as kind from lineitem group by l_orderkey""")
def group_kinds(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("r", F.when(F.col("l_linestatus") == "O", 0.0).otherwise(1.0))
    return rewards.group_kinds(rows, "l_orderkey", "r", 1.0)


@query("""select l_orderkey, count(*) as total_rollouts, sum((l_returnflag = 'R')::int)::bigint as total_correct, round(avg((l_returnflag = 'R')::int), 6) as passrate from lineitem group by l_orderkey""")
def pass_rates(spark, sf):
    out = rewards.pass_rates(table(spark, sf, "lineitem").withColumn("ok", F.col("l_returnflag") == "R"), "l_orderkey", "ok")
    return out.withColumn("passrate", rounded("passrate"))


@query("""with p as (select l_orderkey, avg((l_returnflag = 'R')::int) as r from lineitem group by 1) select o_orderkey from orders left join p on o_orderkey = l_orderkey where coalesce(r, 0.0) between 0.25 and 0.75""")
def pass_rate_band(spark, sf):
    rates = rewards.pass_rates(table(spark, sf, "lineitem").withColumn("ok", F.col("l_returnflag") == "R"), "l_orderkey", "ok").withColumnRenamed("l_orderkey", "o_orderkey")
    return rewards.in_band(table(spark, sf, "orders"), rates, "o_orderkey", 0.25, 0.75).select("o_orderkey")


@query("""with t as (select conv_id, turn, role, case when role = 'assistant' then '<think>x</think> <answer>' || text || '</answer>' else text end as r from conversations), f as (select conv_id, turn, regexp_matches(r, '(?s)^.*?</think>\\s*<answer>.*?</answer>') as hit from t)
select conv_id, turn, case when hit then 1.0 else 0.0 end as format_reward from f""")
def format_rewards(spark, sf):
    r = F.when(F.col("role") == "assistant", F.concat(F.lit("<think>x</think> <answer>"), "text", F.lit("</answer>"))).otherwise(F.col("text"))
    return rewards.format_reward(table(spark, sf, "conversations").withColumn("response", r), "conv_id").select("conv_id", "turn", "format_reward")


# verifiers and predicates


@query("""select doc_id, coalesce(nullif(list_extract(regexp_extract_all(regexp_replace(text, '([0-9]),([0-9])', '\\1\\2', 'g'), '[-+]?[0-9]*\\.[0-9]+|[0-9]+'), -1), ''), regexp_replace(text, '([0-9]),([0-9])', '\\1\\2', 'g')) as extracted from documents""")
def last_number(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.last_number("text").alias("extracted"))


@query("""with w as (select doc_id, list_filter(regexp_extract_all(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\S+'), lambda x: x not in ('a', 'an', 'the')) as w from documents) select doc_id, array_to_string(w, ' ') as plain from w""")
def normalize_answer(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize_answer("text").alias("plain"))


F1_SQL = """with t as (select conv_id, turn, role, list_filter(regexp_extract_all(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\S+'), lambda x: x not in ('a', 'an', 'the')) as w from conversations),
p as (select a.conv_id, a.turn, a.w as u, b.w as v from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1 and a.role = 'user' and b.role = 'assistant'),
x as (select conv_id, turn, unnest(u) as tok, 1 as u, 0 as v from p union all select conv_id, turn, unnest(v), 0, 1 from p), c as (select conv_id, turn, tok, least(sum(u), sum(v)) as same from x group by all), s as (select conv_id, turn, sum(same) as same from c group by all)
select p.conv_id, p.turn, round(case when coalesce(same, 0) = 0 then 0.0 else 2.0 * same / (len(u) + len(v)) end, 6) as f1 from p left join s using (conv_id, turn)"""


@query(F1_SQL)
def string_f1(spark, sf):
    rows = table(spark, sf, "conversations")
    a = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("u"))
    b = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("v"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", rounded(verifiers.string_f1("v", "u")).alias("f1"))


@query("""select doc_id, len(regexp_extract_all(text, '\\S+')) >= 50 as words, not contains(text, ',') as no_commas, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(trim(x), '^[*-]'))) = 2 as bullets, text = upper(text) as upper_case,
len(regexp_extract_all(text, '\\*(.*?)\\*')) >= 1 as highlights, len(string_split(text, '******')) = 2 as two_parts, length(text) - length(replace(text, 'e', '')) = 10 as ten_e, ends_with(text, '.') as stops from documents""")
def simple_predicates(spark, sf):
    t = "text"
    return table(spark, sf, "documents").select(
        "doc_id", I.word_count(t, 50, "at least").alias("words"), I.no_commas(t).alias("no_commas"), I.bullet_points(t, 2).alias("bullets"), I.uppercase(t).alias("upper_case"), I.highlighted(t, 1).alias("highlights"),
        (F.size(text.split_plain(t, "******")) == 2).alias("two_parts"), I.letter_frequency(t, "e", 10).alias("ten_e"), I.ends_with(t, ".").alias("stops"),
    )


@query("""select doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) >= 100 as words, not contains(text, '!') as no_exclamation, len(regexp_extract_all(text, '[a-zA-Z]')) < 2000 as letters, length(lower(text)) - length(replace(lower(text), 'z', '')) < 3 as few_z,
not contains(text, ' the ') as without_the, len(list_filter(regexp_extract_all(text, '\\S+'), lambda x: x = reverse(x))) > 0 as palindrome, len(regexp_extract_all(text, '\\[.*?\\]')) >= 1 as placeholder from documents""")
def constraint_predicates(spark, sf):
    c, t = I.CONSTRAINTS, "text"
    return table(spark, sf, "documents").select(
        "doc_id", c["length_constraints:number_words"](t, "at least", 100).alias("words"), c["punctuation:punctuation_exclamation"](t).alias("no_exclamation"), c["letters:letter_counting"](t, "less than", 2000).alias("letters"),
        c["keywords:letter_frequency"](t, "z", "less than", 3).alias("few_z"), c["keywords:exclude_word_harder"](t, "the").alias("without_the"), c["keywords:palindrome"](t).alias("palindrome"), c["detectable_content:number_placeholders"](t, 1).alias("placeholder"),
    )


@query("""select l_orderkey, l_linenumber, abs(l_quantity - 25) < 1e-9 or l_quantity = 25 as same from lineitem""")
def numeric_answers(spark, sf):
    boxed = F.concat(F.lit("so \\boxed{"), F.format_string("%.1f", "l_quantity"), F.lit("}"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (verifiers.math_value(boxed, F.lit("25")) == 1.0).alias("same"))


# sequences


@query("select conv_id, sum(len(regexp_extract_all('<|' || role || '|>' || chr(10) || text || chr(10), '[\\p{L}\\p{N}_]+(?:[''’-][\\p{L}\\p{N}_]+)*|[^\\p{L}\\p{N}_\\s]')))::bigint as n_tokens, sum(case when role = 'assistant' then len(regexp_extract_all('<|' || role || '|>' || chr(10) || text || chr(10), '[\\p{L}\\p{N}_]+(?:[''’-][\\p{L}\\p{N}_]+)*|[^\\p{L}\\p{N}_\\s]')) else 0 end)::bigint as n_trained from conversations group by conv_id")
def tokenize_chats(spark, sf):
    out = packing.tokenize(chats(spark, sf))
    return out.select("conv_id", F.size("input_ids").cast("long").alias("n_tokens"), F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("n_trained"))


@query("""with t as (select sum(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[''’-][\\p{L}\\p{N}_]+)*|[^\\p{L}\\p{N}_\\s]')) + 1) as n from documents) select unnest(range((n // 512)::bigint)) as block, 512::int as n from t""")
def token_blocks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.token_ids("text").alias("ids"))
    return packing.blocks(docs, "doc_id", "ids", 512, eos=0).select("block", F.size("input_ids").alias("n"))


@query()
def sequence_packs(spark, sf):
    parts = packing.tokenize_prompt(chats(spark, sf)).withColumn("response_ids", text.token_ids(F.coalesce(convert.last_of("messages"), F.lit(""))))
    packs = packing.pack(parts.withColumn("shard", F.floor(F.col("conv_id") / 64)), "shard", "conv_id", "input_ids_prompt", "response_ids", 2048)
    return packs.select("shard", "pack", F.size("ids").alias("n_tokens"), F.size("n_actions").alias("n_sequences"))


@query()
def split_conversations(spark, sf):
    return packing.split_conversation(chats(spark, sf), "conv_id", "messages", 300, lambda m: F.size(text.tokens(m["content"]))).select("conv_id", F.size("messages").alias("n_turns"))


@query()
def context_window(spark, sf):
    kept = packing.fit_context("messages", 400, lambda c: F.size(text.tokens(c)))
    return chats(spark, sf).select("conv_id", F.size(kept).alias("n_kept"))


@query()
def epoch_batches(spark, sf):
    return sampling.epoch_batches(table(spark, sf, "documents"), "doc_id", 16, seed=42, epoch=1, rank=0, world=2)


@query("""with r as (select user_id, list(value order by ts, event_id) as v from events group by 1) select user_id, len(v) as n, round(list_sum(v), 4) as total from r""")
def gae_inputs(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    r = table(spark, sf, "events").groupBy("user_id").agg(F.transform(rows, lambda x: x["value"]).alias("v"))
    # with gamma = lambda = 1 and no values the first advantage is the sum of all rewards
    zero = F.transform("v", lambda _: F.lit(0.0))
    out = packing.gae(zero, F.col("v"), 1.0, 1.0)
    return r.select("user_id", F.size("v").cast("long").alias("n"), rounded(out["advantages"][0], 4).alias("total"))


@query("""select date_trunc('hour', ts)::varchar as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def hourly_counts(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", rounded("total", 4).alias("total"))


@query("select o_orderkey, round(-ln(1 / (1 + exp(-0.1 * ((o_orderkey % 7) - (o_custkey % 5) - (o_orderkey % 3) + (o_custkey % 2))))), 6) as loss from orders")
def preference_losses(spark, sf):
    mod = lambda c, n: (F.col(c) % n).cast("double")
    loss = maths.preference_loss(mod("o_orderkey", 7), mod("o_custkey", 5), mod("o_orderkey", 3), mod("o_custkey", 2))
    return table(spark, sf, "orders").select("o_orderkey", rounded(loss).alias("loss"))


# conversion of other tables


@query("""select o_orderkey, 'Below is an instruction that describes a task, paired with an input that provides further context. Write a response that appropriately completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || o_orderpriority || chr(10) || chr(10) || '### Input:' || chr(10) || o_orderstatus || chr(10) || chr(10) || '### Response:' as prompt, o_custkey::varchar as answer from orders""")
def instruction_records(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("instruction"), F.col("o_orderstatus").alias("input"), F.col("o_custkey").cast("string").alias("output"))
    return convert.auto_convert(rows).select("o_orderkey", F.col("messages")[0]["content"].alias("prompt"), F.col("messages")[1]["content"].alias("answer"))


@query("""select conv_id, string_agg(case role when 'assistant' then 'gpt>assistant' when 'user' then 'human>user' else 'system>system' end, ',' order by turn) as roles from conversations group by conv_id""")
def role_mapping(spark, sf):
    name = F.when(F.col("role") == "assistant", "gpt").when(F.col("role") == "user", "human").otherwise(F.col("role"))
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", name.alias("from"), F.col("text").alias("value")))).alias("t"))
    mapped = turns.withColumn("m", convert.from_turns("t"))
    return mapped.select("conv_id", F.array_join(F.zip_with("t", "m", lambda a, b: F.concat(a["from"], F.lit(">"), b["role"])), ",").alias("roles"))


@query("""select conv_id, 1 + count(*) filter (not (turn = m and role = 'system')) as n, 'Be brief.' as first from (select *, min(turn) over (partition by conv_id) as m from conversations) group by conv_id""")
def system_prompts(spark, sf):
    out = chats(spark, sf).select("conv_id", convert.with_system("messages", "Be brief.").alias("m"))
    return out.select("conv_id", F.size("m").cast("long").alias("n"), F.col("m")[0]["content"].alias("first"))


@query("""select item_id || '-' || k as id, md5(text) as text from benchmark, range(5) r(k)""")
def replicate_five(spark, sf):
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.md5("text").alias("text"))
    return convert.replicate(rows, 5)


@query("""select n.n_nationkey as n, (n.n_nationkey // 5) % 10 + 1 as difficulty, r.r_name as category from nation n join region r on n.n_nationkey % 5 = r.r_regionkey""")
def category_enumeration(spark, sf):
    regions = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("i"), F.col("r_name").alias("category"))
    numbers = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n"))
    return convert.enumerate_categories(numbers, regions, 5).select(F.col("n").cast("int").alias("n"), "difficulty", "category")


@query("""select n_name as persona, replace(t, '{persona}', n_name) as prompt from nation, (values ('Ask {persona} a question.'), ('Write as {persona}.')) v(t)""")
def persona_prompts(spark, sf):
    shapes = spark.createDataFrame([("Ask {persona} a question.",), ("Write as {persona}.",)], ["template"])
    return convert.persona_prompts(table(spark, sf, "nation").select(F.col("n_name").alias("persona")), shapes).select("persona", "prompt")


@query("""with c as (select conv_id, list(text order by turn) filter (role = 'assistant') as a from conversations group by conv_id) select conv_id, unnest(range(len(a)))::int as completion_index, md5(unnest(a)) as completion from c""")
def exploded_completions(spark, sf):
    rows = chats(spark, sf).withColumn("completions", F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: m["content"]))
    return convert.explode_completions(rows).select("conv_id", "completion_index", F.md5("completion").alias("completion"))


@query("""select p_partkey, chr((64 + list_position(list_sort([lower(p_brand), lower(p_type), lower(p_name)]), lower(p_name)))::int) as letter from part""")
def lettered_choices(spark, sf):
    out = convert.lettered_choices(table(spark, sf, "part"), "p_name", "p_name", ["p_brand", "p_type"])
    return out.select("p_partkey", F.col("ground_truth")[0].alias("letter"))


@query("""select o_orderkey, o_totalprice::varchar as answer from orders""")
def split_rationales(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.lit("q").alias("question"), F.concat(F.lit("because\n#### "), F.col("o_totalprice").cast("string"), F.lit(" ")).alias("answer"))
    return convert.split_rationale(rows).select("o_orderkey", F.col("ground_truth")[0].cast("double").cast("string").alias("answer"))


@query("""select conv_id, turn, '<think>a</think>' || chr(10) || '<answer>' || trim(text, ' ' || chr(10)) || '</answer>' as tagged from conversations""")
def answer_tags(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", convert.add_answer_tags(F.concat(F.lit("<think>a</think>"), "text")).alias("tagged"))


# more filters and joins


@query("""select conv_id, arg_max(regexp_matches(text, '[éèê]') and len(regexp_extract_all(text, '[éèê]')) / length(text) >= 0.02, turn) as accented from conversations where role = 'assistant' group by conv_id""")
def script_filter(spark, sf):
    rows = chats(spark, sf).where(F.exists("messages", lambda m: m["role"] == "assistant"))
    return rows.select("conv_id", filters.in_script("messages", "[éèê]", 0.02).alias("accented"))


@query("""select doc_id, doc_id % 3 = 0 as thinks, doc_id % 5 <> 0 as safe from documents""")
def format_and_safety(spark, sf):
    body = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>x</think>"), "text")).otherwise(F.col("text"))
    code = F.when(F.col("doc_id") % 5 == 0, "import os; os.remove('x')").otherwise("print(1)")
    return table(spark, sf, "documents").select("doc_id", filters.thinks(F.array(convert.message("assistant", body))).alias("thinks"), filters.is_safe(code).alias("safe"))


@query("""select l_orderkey as id, l_linenumber, o_orderstatus, o_custkey from lineitem join orders on l_orderkey = o_orderkey""")
def overlay_originals(spark, sf):
    results = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber")
    originals = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_custkey")
    return joins.overlay(results, originals, "id", ["o_custkey"])


@query("""with f as (select conv_id, arg_min(text, turn) as t from conversations group by conv_id) select a.conv_id, b.conv_id as other from f a join f b on sha256(a.t) = sha256(b.t)""")
def same_first_message(spark, sf):
    c = chats(spark, sf)
    return joins.by_first_message(c, c.withColumnRenamed("conv_id", "other")).select("conv_id", "other")


@query("""select (select count(*) from orders) as requests, count(distinct o_orderkey) as answered, (select count(*) from orders) - count(distinct o_orderkey) as open from orders join lineitem on l_orderkey = o_orderkey and l_returnflag = 'R'""")
def response_cache(spark, sf):
    requests = table(spark, sf, "orders").select("o_orderkey")
    saved = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    hit, miss = joins.cached(requests, saved, "o_orderkey")
    rows = requests.withColumn("k", F.lit("requests")).union(hit.select("o_orderkey", F.lit("answered"))).union(miss.select("o_orderkey", F.lit("open")))
    return rows.agg(*[F.count_if(F.col("k") == k).alias(k) for k in ("requests", "answered", "open")])


@query("""with r as (select *, row_number() over (order by doc_id) as k from documents) select doc_id from r where k > 20 and k <= 50""")
def page_of_rows(spark, sf):
    return sampling.page(table(spark, sf, "documents").select("doc_id"), 20, 30, ["doc_id"])


@query("""with r as (select doc_id, n_chars, sum(n_chars) over (order by doc_id) - n_chars as b from documents) select doc_id, least(n_chars, 50000 - b)::bigint as taken from r where b < 50000""")
def running_cap(spark, sf):
    return sampling.running_cap(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 50_000, ["doc_id"]).select("doc_id", F.col("taken").cast("long").alias("taken"))


# more evaluation and rewards


@query("""with c as (select o_orderpriority as metric, avg((o_totalprice > 150000)::int) as a, avg((o_totalprice > 250000)::int) as b from orders group by 1) select 'run10' as run, 10 as step, round(max(a) filter (metric = '1-URGENT'), 6) as urgent, round(max(a) filter (metric = '5-LOW'), 6) as low from c union all select 'run20', 20, round(max(b) filter (metric = '1-URGENT'), 6), 0.0 from c""")
def run_comparison(spark, sf):
    rate = lambda limit: table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("metric")).agg(F.avg((F.col("o_totalprice") > limit).cast("int")).alias("accuracy"))
    wide = evaluation.compare_runs({"run20": rate(250000).where("metric <> '5-LOW'"), "run10": rate(150000)})
    return wide.select("run", "step", rounded("`1-URGENT`").alias("urgent"), rounded("`5-LOW`").alias("low"))


@query("""select event_id, round(least(cast(json_extract(props, '$.k') as double), 1e9), 4) as k from events""")
def metric_lookup(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.struct((F.get_json_object("props", "$.k").cast("double") + 1000).alias("k")).alias("m"))).alias("metrics"))
    return evaluation.metric_table(rows, {"k": "$.m.k"}).select("event_id", (F.col("k") - 1000).alias("k"))


TRACES_SQL = "with t as (select day(ts)::int as training_step, value, event_type, row_number() over (partition by day(ts) order by ts, event_id) - 1 as sample from events)"


def traces(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value", "event_type")))
    days = table(spark, sf, "events").groupBy(F.dayofmonth("ts").alias("training_step")).agg(rows.alias("r"))
    return days.select("training_step", F.transform("r", lambda x: x["value"]).alias("scores"), F.transform("r", lambda x: x["event_type"]).alias("responses"))


@query(TRACES_SQL + " select training_step, sample::int as sample, value as scores, event_type as responses from t")
def trace_samples(spark, sf):
    return evaluation.explode_trace(traces(spark, sf)).select("training_step", "sample", "scores", "responses")


@query(TRACES_SQL + ", s as (select training_step, max(value) as m, count(*) as n from t group by 1) select training_step, n::int as n from s where m >= 250")
def trace_filter(spark, sf):
    return evaluation.filter_traces(traces(spark, sf), at_least=250.0).select("training_step", F.size("scores").alias("n"))


@query("select count(value) as n, min(value) as min, max(value) as max, count_if(value = 10) as perfect, count_if(value = 0) as zero, round(stddev_pop(value), 4) as std from events")
def score_summary(spark, sf):
    return evaluation.score_summary(table(spark, sf, "events"), "value").select("n", "min", "max", "perfect", "zero", rounded("std", 4).alias("std"))


@query("""select count(*) as batches, sum(event_id)::bigint as tokens, list_aggregate(list_sort(list(distinct event_type)), 'string_agg', ',') as reasons from events""")
def generation_report(spark, sf):
    out = evaluation.generation_report(table(spark, sf, "events"), "value", "event_id", "event_type")
    return out.select("batches", "tokens", F.array_join(F.array_sort(F.map_keys("reasons")), ",").alias("reasons"))


@query("""with e as (select user_id, event_type, event_id, row_number() over (partition by user_id order by event_id) as k from events where event_type <> 'error'), v as (select user_id, event_type, count(*) as n, min(event_id) as f, max(event_id) as l from e group by 1, 2) select user_id, arg_max(l, (n, -f)) as answer, max(n) as votes from v group by user_id""")
def raw_vote(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("form"))
    return evaluation.raw_vote(rows.withColumn("raw", F.col("event_id")), "user_id", "event_id", "raw", "form")


@query(ANNOTATIONS_SQL + """, d as (select evaluator, count(distinct instance_id) as done from a group by 1), u as (select distinct user_id::varchar as evaluator from events) select evaluator, coalesce(done, 0) as done from u left join d using (evaluator) union all select 'all', sum(done)::bigint from d""")
def annotation_progress(spark, sf):
    rows = annotations(spark, sf).withColumnRenamed("instance_id", "instance_index")
    return evaluation.progress(rows, rows.select("evaluator").distinct(), 200)[0]


@query(ANNOTATIONS_SQL + """, u as (select distinct evaluator from a), x as (select evaluator, i as instance_index from u, range(200) r(i)) select x.evaluator, x.instance_index::int as instance_index from x left join (select distinct evaluator, instance_id from a) d on x.evaluator = d.evaluator and x.instance_index = d.instance_id where d.evaluator is null""")
def missing_annotations(spark, sf):
    rows = annotations(spark, sf).select("evaluator", F.col("instance_id").cast("int").alias("instance_index"), "timestamp")
    return evaluation.progress(rows, rows.select("evaluator").distinct(), 200)[1]


@query("""select o_orderkey, case when o_orderkey % 3 = 0 then 2.0 else 0.0 end + case when o_custkey % 2 = 0 then 0.5 else 0.0 end as reward from orders""")
def weighted_rewards(spark, sf):
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        F.concat(F.lit("The answer is: "), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string")).otherwise("unknown")).alias("prediction"),
        F.array(F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 2 == 0, "the answer is").otherwise("no such word"), F.lit("x")).alias("ground_truth"),
        F.array(F.lit("flan"), F.lit("parity"), F.lit("none")).alias("dataset"),
    )
    flan = rewards.weighted_rewards(rows.withColumn("ground_truth", F.slice("ground_truth", 1, 1)).withColumn("dataset", F.slice("dataset", 1, 1)), "o_orderkey", weights={"flan": 2.0}, only=["flan"])
    parity = F.when(F.element_at(rows["ground_truth"], 2) == "the answer is", 0.5).otherwise(0.0)
    return rows.join(flan, "o_orderkey").select("o_orderkey", (F.col("reward") + parity).alias("reward"))


@query("""with g as (select l_orderkey, count(*) as n, count(*) filter (l_returnflag <> 'R') as p from lineitem group by 1) select l_orderkey, p::int as passed from g where p >= 0.8 * n""")
def accepted_tests(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_returnflag") != "R").cast("int").alias("ok"))))
    tests = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(rows.alias("r")).select("l_orderkey", F.transform("r", lambda x: x["l_linenumber"]).alias("tests"), F.transform("r", lambda x: x["ok"]).alias("results"))
    return rewards.accepted_tests(tests, "tests", "results").select("l_orderkey", F.size("tests").alias("passed"))


@query("""with g as (select user_id, min(event_type) <> max(event_type) as v from events group by 1) select event_id from events join g using (user_id) where v""")
def varied_prompts(spark, sf):
    return preferences.varied(table(spark, sf, "events"), "user_id", "event_type").select("event_id")


@query("""select l_orderkey, max(l_quantity) filter (l_linestatus = 'O') as open_quantity, max(l_quantity) filter (l_linestatus = 'F') as filled_quantity from lineitem group by l_orderkey""")
def rating_table(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.max("l_quantity").alias("v"))
    return preferences.rating_table(rows, "l_orderkey", "l_linestatus", "v", ["O", "F"]).select("l_orderkey", F.col("O").alias("open_quantity"), F.col("F").alias("filled_quantity"))


@query("""select event_id, case event_id % 4 when 0 then 0.8 when 1 then 0.85 when 2 then 1.0 else 0.0 end as score, case when event_id % 2 = 0 then 1.0 else 0.0 end as decision from events""")
def judge_scores(spark, sf):
    reply = F.when(F.col("event_id") % 4 == 0, "I give 4/5").when(F.col("event_id") % 4 == 1, "about 85%").when(F.col("event_id") % 4 == 2, "Yes").otherwise("unclear")
    verdict = F.when(F.col("event_id") % 2 == 0, "Final Decision: Yes").otherwise("Final Decision: No")
    return table(spark, sf, "events").select("event_id", text.parse_score(reply).alias("score"), text.parse_decision(verdict).alias("decision"))


@query("""select o_orderkey, '\\frac{' || (o_orderkey % 9 + 1) || '}{' || (o_custkey % 7 + 2) || '}' as form from orders""")
def answer_forms(spark, sf):
    top, bottom = (F.col("o_orderkey") % 9 + 1).cast("string"), (F.col("o_custkey") % 7 + 2).cast("string")
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("x = "), top, F.lit("/"), bottom)).otherwise(F.concat(F.lit("\\dfrac"), top, bottom, F.lit("\\!")))
    return table(spark, sf, "orders").select("o_orderkey", maths.strip_answer(raw).alias("form"))


@query("""select o_orderkey, '{' || o_custkey || '}^2' as boxed from orders""")
def boxed_answers(spark, sf):
    t = F.concat(F.lit("first \\boxed{1}, so \\boxed{{"), F.col("o_custkey").cast("string"), F.lit("}^2} holds"))
    return table(spark, sf, "orders").select("o_orderkey", text.last_boxed(t).alias("boxed"))


# more sequences and statistics


@query("""with t as (select conv_id, turn, list_transform(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+'), lambda w: length(w)) as l from conversations), n as (select conv_id, turn, l, sum(len(l)) over (partition by conv_id order by turn)::bigint as upto from t)
select conv_id, array_to_string(flatten(list(l order by turn)), ' ') as ids, '0 ' || string_agg(upto::varchar, ' ' order by turn) as cuts from n group by conv_id""")
def flattened_batches(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.transform(text.words("text"), lambda w: F.length(w)).alias("ids"))
    out = packing.flatten_batch(rows, "conv_id", "turn", "ids")
    return out.select("conv_id", F.array_join("input_ids", " ").alias("ids"), F.array_join("cu_seq_lens", " ").alias("cuts"))


@query("""with m as (select conv_id, length(text) as n, row_number() over (partition by conv_id order by turn) as i, count(*) over (partition by conv_id) as size from conversations)
select conv_id, string_agg(n::varchar, ' ' order by i) filter (i <= 3) as tokens, greatest(any_value(size) - 4, 0)::int as excess from m group by conv_id""")
def clipped_outputs(spark, sf):
    ids = F.transform("messages", lambda m: F.length(m["content"]))
    out = chats(spark, sf).select("conv_id", packing.clip_tool_output(ids, 4, 3).alias("c"))
    return out.select("conv_id", F.array_join("c.tokens", " ").alias("tokens"), F.col("c.excess").alias("excess"))


@query("""with n as (select source, count(*) as initial, count(*) filter (lang = 'en') as final from documents group by source) select source as dataset_source, initial, final, initial - final as filtered, round(final / initial, 6) as factor from n""")
def transform_report(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("dataset_source"), "lang")
    return statistics.transform_statistics(docs, docs.where("lang = 'en'")).withColumn("factor", rounded("factor"))


@query("""with t as (select max(value) as m, least(50, floor(max(value) / 10)::int) as b from events) select least(floor(value / (m / b)), b - 1)::bigint as bin, count(*) as n from events, t group by 1""")
def equal_bins(spark, sf):
    return statistics.equal_bins(table(spark, sf, "events"), "value").select(F.col("bin").cast("long").alias("bin"), "n")


@query(NGRAM_SQL + ", b as (select item_id, max(score) as s from s group by 1) select count(*) as queries, round(avg(coalesce(b.s, 0)), 6) as mean_score from benchmark left join b using (item_id)")
def contamination_mean(spark, sf):
    tests = table(spark, sf, "benchmark")
    scores = contamination.ngram_scores(contamination.index_texts(table(spark, sf, "documents"), "doc_id"), tests, "item_id", ["text"])
    return contamination.mean_score(tests, scores, "item_id").withColumn("mean_score", rounded("mean_score"))


# the flagship: a decontaminated, quality-filtered mix with statistics of each source


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    toxic = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    scores = contamination.ngram_scores(contamination.index_texts(docs, "doc_id"), table(spark, sf, "benchmark"), "item_id", ["text"])
    clean, _ = contamination.decontaminate(docs, "doc_id", contamination.contaminated(scores, 0.5))
    kept = clean.join(toxic, "doc_id", "left_anti")
    return kept.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.countDistinct("lang").alias("languages"))


QUERIES["clean_mix"] = flagship
SQL["clean_mix"] = NGRAM_SQL + """, b as (select distinct original_id from s where score > 0.5), k as (select *, row_number() over (partition by source order by doc_id) as k from documents where doc_id not in (select original_id from b) and doc_id not in (select doc_id from labels where toxic = 1))
select source, count(*) as documents, sum(n_chars)::bigint as chars, count(distinct lang) as languages from k group by source"""


from . import predicate_queries, sequence_queries, value_queries  # noqa: E402, F401
