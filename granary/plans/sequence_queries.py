"""Token sequences, templates, sources, sinks and streams compared by value.

The tokenizer is a parameter; here a token's id is the length of a word, which SQL can say too. Arrays are compared as
text. Sources and streams read back what a sink has written from the same tables.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import templates, text
from ..operators import convert, joins, packing, sampling
from ..sources import readers, sinks
from ..streaming import rollouts
from . import registry
from .queries import SQL, chats, query, rounded, table


def lengths(x):
    """A tokenizer: the lengths of the words."""
    return F.transform(text.words(x), F.length)


def joined(ids):
    return F.array_join(ids, " ")


#: Messages with their ids, m of n in order; w: the ids masked.
MESSAGES = r"""select conv_id, role, text, ids, list_transform(ids, lambda x: -100) as w, row_number() over (partition by conv_id order by turn) as m, count(*) over (partition by conv_id) as n
from (select *, list_transform(regexp_extract_all('<|' || role || '|>' || chr(10) || text || chr(10), '\S+'), lambda x: length(x)) as ids from conversations)"""


def flat(item: str, most: int | None = None) -> str:
    return f"array_to_string(flatten(list({item} order by m)){f'[1:{most}]' if most else ''}, ' ')"


@query(f"""with m as ({MESSAGES}) select conv_id, {flat('ids')} as ids, {flat('case when m = n then ids else w end')} as last, {flat('ids', 64)} as cut, {flat("case when role = 'assistant' then ids else w end", 64)} as trained,
{flat("case when m = n and role = 'assistant' then ids else w end", 64)} as last_answer, len(flatten(list(ids))) as mask from m group by conv_id""")
def tokenized_chats(spark, sf):
    rows = chats(spark, sf)
    made = {"ids": ("all", None, "input_ids"), "last": ("last", None, "labels"), "cut": ("all", 64, "input_ids"), "trained": ("assistant", 64, "labels"), "last_answer": ("last_assistant", 64, "labels")}
    for name, (train, most, column) in made.items():
        rows = packing.tokenize(rows, train_on=train, most=most, tokenizer=lengths).withColumn(name, joined(F.col(column)))
        if name == "ids":
            rows = rows.withColumn("mask", F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x))
    return rows.select("conv_id", *made, "mask")


PROMPTS = f"""with m as ({MESSAGES}), p as (select *, n > 1 and m = n and role = 'assistant' as answer from m)"""


@query(f"""{PROMPTS}, r as (select conv_id, {flat('ids')} as chosen, {flat('case when m = n then ids else w end')} as labels, coalesce(array_to_string(flatten(list(ids order by m) filter (m < n)), ' '), '') as prompt, coalesce(flatten(list(ids order by m) filter (not answer)), []) as kept from p group by conv_id)
select conv_id, chosen, labels, prompt, array_to_string(list_concat(kept, [13, 2, 1]), ' ') as rejected from r""")
def tokenized_pairs(spark, sf):
    rows = chats(spark, sf).withColumn("chosen", F.col("messages"))
    rows = rows.withColumn("rejected", F.concat(convert.without_last_answer("messages"), F.array(convert.message("assistant", F.lit("No .")))))
    out = packing.tokenize_pairs(rows, tokenizer=lengths, prompt=True)
    return out.select("conv_id", joined("chosen_input_ids").alias("chosen"), joined("chosen_labels").alias("labels"), joined("input_ids_prompt").alias("prompt"), joined("rejected_input_ids").alias("rejected"))


@query(f"""{PROMPTS} select conv_id, array_to_string(flatten(list(ids order by m)), ' ') as ids, string_agg(role || ': ' || text, chr(10) order by m) as prompt from p where not answer group by conv_id""")
def tokenized_prompts(spark, sf):
    return packing.tokenize_prompt(chats(spark, sf), tokenizer=lengths).select("conv_id", joined("input_ids_prompt").alias("ids"), "prompt")


@query(f"""with m as ({MESSAGES}), c as (select conv_id, flatten(list(ids order by m))[1:300] as ids, flatten(list(case when role = 'assistant' then ids else w end order by m))[1:300] as labels from m group by conv_id)
select array_to_string(ids, ' ') as ids, array_to_string(labels, ' ') as labels, conv_id from c where len(ids) <= 250 and len(list_filter(labels, lambda x: x <> -100)) > 0""")
def registered_transforms(spark, sf):
    steps = (("to_messages", {}), ("sft_tokenize_truncate", {"most": 300, "tokenizer": lengths}), ("sft_filter", {"most": 250}))
    out = registry.apply(chats(spark, sf), steps, ("conv_id", "input_ids", "labels"))
    return out.select("conv_id", joined("input_ids").alias("ids"), joined("labels").alias("labels"))


@query(f"""{PROMPTS}, r as (select conv_id, flatten(list(ids order by m)) as chosen, len(flatten(list(ids) filter (m < n))) as prompt, len(flatten(list(ids) filter (not answer))) + 3 as rejected from p group by conv_id)
select conv_id, array_to_string(chosen, ' ') as chosen from r where len(chosen) <= 250 and rejected <= 250 and coalesce(prompt, 0) <= 200 union all select -1 - conv_id, array_to_string(flatten(list(ids order by m)), ' ') from p where not answer group by conv_id having len(flatten(list(ids))) <= 100""")
def filtered_pairs_and_prompts(spark, sf):
    rows = chats(spark, sf).withColumn("chosen", F.col("messages"))
    rows = rows.withColumn("rejected", F.concat(convert.without_last_answer("messages"), F.array(convert.message("assistant", F.lit("No .")))))
    pairs = registry.apply(rows, (("preference_tokenize", {"tokenizer": lengths}), ("preference_filter", {"most": 250, "most_prompt": 200})))
    prompts = registry.apply(chats(spark, sf), (("verifiable_tokenize", {"tokenizer": lengths}), ("verifiable_filter", {"most_prompt": 100})))
    return pairs.select("conv_id", joined("chosen_input_ids").alias("chosen")).unionByName(prompts.select((-1 - F.col("conv_id")).alias("conv_id"), joined("input_ids_prompt").alias("chosen")))


TOKENS = r"""select doc_id, unnest(list_append(l, 0)) as id, unnest(range(len(l) + 1)) as i from (select doc_id, list_transform(regexp_extract_all(text, '\S+'), lambda x: length(x)) as l from documents)"""


@query(f"""with t as ({TOKENS}), p as (select id, row_number() over (order by doc_id, i) - 1 as p from t) select p // 128 as block, string_agg(id::varchar, ' ' order by p) as ids from p group by 1 having count(*) = 128""")
def block_tokens(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", lengths(F.col("text")).alias("ids"))
    return packing.blocks(docs, "doc_id", "ids", 128, eos=0).select("block", joined("input_ids").alias("ids"))


@query(f"""with t as (select * from ({TOKENS}) where id > 0), p as (select id, (doc_id % 4 = 0 and id > 3)::int as m, row_number() over (order by doc_id, i) - 1 as p from t) select p // 65 as block, string_agg(id::varchar, ' ' order by p) as ids, string_agg(m::varchar, '' order by p) as mask from p group by 1 having count(*) = 65 and max(m) = 1""")
def masked_block_tokens(spark, sf):
    ids = lengths(F.col("text"))
    docs = table(spark, sf, "documents").select("doc_id", ids.alias("ids"), F.transform(ids, lambda n: ((F.col("doc_id") % 4 == 0) & (n > 3)).cast("int")).alias("mask"))
    return packing.blocks(docs, "doc_id", "ids", 65, mask="mask").select("block", joined("input_ids").alias("ids"), F.array_join("loss_mask", "").alias("mask"))


@query(f"""with recursive m as ({MESSAGES}), x as (select conv_id // 8 as shard, row_number() over (partition by conv_id // 8 order by conv_id) as i, q, r, len(q) + len(r) as n from
(select conv_id, coalesce(flatten(list(ids order by m) filter (m < n)), []) as q, flatten(list(ids) filter (m = n)) as r from m group by conv_id)), p as (select shard, i, (n > 400)::int as pack, n as used from x where i = 1
union all select x.shard, x.i, p.pack + (p.used + x.n > 400)::int, case when p.used + x.n > 400 then x.n else p.used + x.n end from p join x on x.shard = p.shard and x.i = p.i + 1)
select shard, pack, string_agg(array_to_string(list_concat(q, r), ' '), ' ' order by i) as ids, string_agg(array_to_string(list_concat(list_transform(q, lambda z: 0), list_transform(r, lambda z: i)), ' '), ' ' order by i) as mask,
string_agg(array_to_string(range(n), ' '), ' ' order by i) as positions, string_agg(len(r)::varchar, ' ' order by i) as actions from p join x using (shard, i) group by shard, pack union all select shard, 0, '', '', '', '' from x where i = 1 and n > 400""")
def packed_tokens(spark, sf):
    parts = packing.message_ids("messages", lengths)
    rows = chats(spark, sf).withColumn("parts", parts)
    ids = lambda p: F.flatten(F.transform(p, lambda x: x["ids"]))
    rows = rows.withColumn("q", ids(F.slice("parts", 1, F.size("parts") - 1))).withColumn("r", F.element_at("parts", -1)["ids"]).withColumn("shard", F.floor(F.col("conv_id") / 8))
    out = packing.pack(rows, "shard", "conv_id", "q", "r", 400)
    return out.select("shard", F.col("pack").cast("long").alias("pack"), joined("ids").alias("ids"), joined("response_mask").alias("mask"), joined("position_ids").alias("positions"), joined("n_actions").alias("actions"))


@query(f"""with m as ({MESSAGES}) select conv_id, {flat('ids')} as ids, {flat('list_transform(ids, lambda x: m - 1)')} as seq, {flat('range(len(ids))')} as positions from m group by conv_id""")
def flattened_tokens(spark, sf):
    turns = table(spark, sf, "conversations")
    marked = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n"))
    out = packing.flatten_batch(turns.withColumn("ids", lengths(marked)), "conv_id", "turn", "ids")
    again = packing.position_ids(F.col("seq_idx"))
    return out.select("conv_id", joined("input_ids").alias("ids"), joined("seq_idx").alias("seq"), joined(F.when(again == F.col("position_ids"), F.col("position_ids"))).alias("positions"))


@query("select o_custkey as pack, string_agg(case o_orderkey % 4 when 1 then '0.5' when 2 then '1.0' else '0.0' end, ' ' order by o_orderkey) as advantages from orders group by 1")
def pack_advantages(spark, sf):
    masks = F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_orderkey") % 4).alias("m"))))
    packs = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("pack")).agg(F.transform(masks, lambda x: x["m"]).alias("response_mask"))
    known = spark.range(1, 3).select(F.col("id").alias("seq"), (F.col("id") * 0.5).alias("advantage"))
    return joins.advantages_into_packs(packs, known).select("pack", F.array_join(F.transform("advantages", lambda a: F.format_string("%.1f", a)), " ").alias("advantages"))


#: Tokens of a text as the engine's own tokenizer counts them.
COUNT = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[''’-][\p{L}\p{N}_]+)*|[^\p{L}\p{N}_\s]'))"

SQL["split_conversations"] = f"""with recursive t as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as i, {COUNT} + 6 as n, count(*) over (partition by conv_id) // 2 as pairs from conversations),
p as (select conv_id, i // 2 as j, sum(n)::bigint as n, any_value(pairs) as pairs from t where i < 2 * pairs group by 1, 2),
w as (select conv_id, 0::bigint as j, 0::bigint as a, 0::bigint as used, null::bigint as s, null::bigint as e from p where p.j = 0
union all select w.conv_id, w.j + 1, case when w.used + p.n > 300 then case when p.n > 300 then 2 * p.j + 2 else 2 * p.j end else w.a end, case when w.used + p.n > 300 then p.n else w.used + p.n end, w.a, case when w.used + p.n > 300 then 2 * p.j when p.j = p.pairs - 1 then 2 * p.j + 2 end from w join p on p.conv_id = w.conv_id and p.j = w.j)
select conv_id || '_' || s as conv_id, greatest(e - s, 0)::int as n_turns from w where e is not null"""

SQL["context_window"] = f"""with t as (select conv_id, turn, {COUNT} as n, role = 'system' and turn = min(turn) over (partition by conv_id) as head from conversations), s as (select conv_id, head, n, sum(case when head then 0 else n end) over (partition by conv_id order by turn desc) as upto, sum(case when head then n else 0 end) over (partition by conv_id) as cost from t)
select conv_id, (count_if(head) + count_if(not head and upto + cost <= 400))::int as n_kept from s group by conv_id"""


@query("""with e as (select user_id, value as r, ln(1 + abs(value)) as v, row_number() over (partition by user_id order by ts, event_id) as i from events), d as (select a.user_id, a.i, a.v, a.r + 0.9 * coalesce(b.v, 0) - a.v as d from e a left join e b on a.user_id = b.user_id and b.i = a.i + 1)
select a.user_id, a.i - 1 as i, round(sum(b.d * pow(0.72, b.i - a.i)), 3) as advantage, round(sum(b.d * pow(0.72, b.i - a.i)) + any_value(a.v), 3) as total from d a join d b on a.user_id = b.user_id and b.i >= a.i group by 1, a.i""")
def advantage_estimates(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    r = table(spark, sf, "events").groupBy("user_id").agg(F.transform(rows, lambda x: x["value"]).alias("r")).withColumn("v", F.transform("r", lambda x: F.log(1 + F.abs(x))))
    out = r.withColumn("g", packing.gae("v", "r", 0.9, 0.8)).select("user_id", F.posexplode(F.arrays_zip("g.advantages", "g.returns")).alias("i", "x"))
    return out.select("user_id", F.col("i").cast("long").alias("i"), rounded(F.col("x.advantages"), 3).alias("advantage"), rounded(F.col("x.returns"), 3).alias("total"))


#: Tokens of a message with its marks, as the engine's own tokenizer counts them.
MARKED = COUNT.replace("(text,", "('<|' || role || '|>' || chr(10) || text || chr(10),")

SQL["sequence_packs"] = f"""with recursive t as (select *, row_number() over (partition by conv_id order by turn) as m, count(*) over (partition by conv_id) as n, {MARKED} as marked, {COUNT} as plain from conversations),
c as (select conv_id, coalesce(sum(marked) filter (not (n > 1 and m = n and role = 'assistant')), 0)::bigint + coalesce(arg_max(plain, turn) filter (role = 'assistant'), 0) as n from t group by 1),
x as (select conv_id // 64 as shard, row_number() over (partition by conv_id // 64 order by conv_id) as i, n from c), p as (select shard, i, (n > 2048)::int as pack, n as used from x where i = 1
union all select x.shard, x.i, p.pack + (p.used + x.n > 2048)::int, case when p.used + x.n > 2048 then x.n else p.used + x.n end from p join x on x.shard = p.shard and x.i = p.i + 1)
select shard, pack, sum(x.n)::int as n_tokens, count(*)::int as n_sequences from p join x using (shard, i) group by 1, 2 union all select shard, 0, 0, 0 from x where i = 1 and n > 2048"""


@query("""select o_orderkey, case o_orderkey % 3 when 0 then '5 0 0 0' when 1 then '5 7 0 0' else '5 7 9 0' end as padded, case o_orderkey % 3 when 0 then '5' when 1 then '5 7' else '5 7 9' end as bare, case o_orderkey % 3 when 2 then '5 7 -1' else case o_orderkey % 3 when 0 then '5' else '5 7' end end as stopped,
case o_orderkey % 3 when 0 then 'user:5' when 1 then 'user:5 assistant:7' else 'user:5 assistant:7' end as turns from orders""")
def array_shapes(spark, sf):
    ids = F.slice(F.array(F.lit(5), F.lit(7), F.lit(9)), 1, (F.col("o_orderkey") % 3 + 1).cast("int"))
    strings = F.transform(F.when(F.size(ids) == 1, F.array(F.lit(5), F.lit(6))).otherwise(ids), lambda x: x.cast("string"))
    turns = F.array_join(F.transform(convert.alternating(strings), lambda m: F.concat(m["role"], F.lit(":"), m["content"])), " ")
    shown = F.when(F.size(ids) == 1, F.substring_index(turns, " ", 1)).otherwise(turns)
    return table(spark, sf, "orders").select("o_orderkey", joined(packing.pad(ids, 4)).alias("padded"), joined(packing.without_padding(packing.pad(ids, 4))).alias("bare"), joined(packing.until_stop(ids, 7, -1)).alias("stopped"), shown.alias("turns"))


@query("select n_nationkey, n_name, n_regionkey from nation")
def shuffled_rows(spark, sf):
    return sampling.shuffled(table(spark, sf, "nation"), "n_nationkey", seed=3)


# templates


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _template_sql(name: str, t: templates.Template) -> str:
    capital = "upper(role[1]) || role[2:]"
    mark = lambda s: f"replace(replace({_quote(s)}, '{{eos}}', '</s>'), '{{Role}}', {capital})"

    def by_role(marks: dict[str, str]) -> str:
        other = mark(marks["*"]) if "*" in marks else "''"
        named = [f"when '{r}' then {mark(s)}" for r, s in marks.items() if r != "*"]
        return f"case role {' '.join(named)} else {other} end" if named else other

    said = "case when role = 'assistant' then '<think>hm</think>' || chr(10) || text else text end"
    if t.thinking == "drop":
        said = "case when role = 'assistant' then chr(10) || text else text end"
    if t.thinking == "last":
        said = f"case when role = 'assistant' and m < n then ltrim(text, chr(10)) else {said} end"
    known = "true" if "*" in t.before else f"role in ({', '.join(repr(r) for r in t.before)})"
    line = f"{by_role(t.before)} || {said} || case when m = n then {by_role({**t.after, **t.last_after})} else {by_role(t.after)} end"
    system = _quote(t.before.get("system", "") + (t.system or "") + t.after.get("system", "")) if t.system else "''"
    body = f"coalesce(string_agg({line}, {_quote(t.between)} order by m) filter ({known}), '')"
    return f"select conv_id, '{name}' as template, {_quote(t.head)} || case when bool_or(role = 'system') then '' else {system} end || {body} || {_quote(t.end.replace('{eos}', '</s>'))} as rendered from m group by conv_id"


@query("with m as (select conv_id, role, text, row_number() over (partition by conv_id order by turn) as m, count(*) over (partition by conv_id) as n from conversations) " + " union all ".join(_template_sql(n, t) for n, t in templates.TEMPLATES.items()))
def every_template(spark, sf):
    rows = chats(spark, sf).withColumn("messages", convert.map_contents("messages", lambda c: F.concat(F.lit("<think>hm</think>\n"), c), "assistant"))
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("template"), templates.render("messages", n).alias("rendered")) for n in templates.TEMPLATES])).alias("x")
    return rows.select("conv_id", both).select("conv_id", "x.template", "x.rendered")


@query("""with m as (select *, row_number() over (partition by conv_id order by turn) as m, count(*) over (partition by conv_id) as n from conversations)
select conv_id, case when bool_or(role = 'system') then '' else '<|im_start|>system' || chr(10) || 'You are a helpful AI assistant. You do not currently have access to any functions. <functions></functions><|im_end|>' || chr(10) end || string_agg('<|im_start|>' || role || chr(10) || text ||
case role when 'system' then case when conv_id % 2 = 0 then ' <functions>f()</functions>' else ' You do not currently have access to any functions. <functions></functions>' end when 'user' then case when turn % 3 = 0 then chr(10) || '<functions>g()</functions>' else '' end else case when turn % 2 = 0 then '<function_calls>g(1)</function_calls>' else '' end end
|| case when role = 'assistant' and m = n then '</s>' else '<|im_end|>' || chr(10) end, '' order by m) as rendered from m group by conv_id""")
def tool_templates(spark, sf):
    turns = table(spark, sf, "conversations")
    known = F.when(F.col("role") == "system", F.when(F.col("conv_id") % 2 == 0, "f()")).otherwise(F.when(F.col("turn") % 3 == 0, "g()"))
    parts = F.struct("turn", F.struct("role", F.col("text").alias("content"), known.alias("functions"), F.when(F.col("turn") % 2 == 0, "g(1)").alias("function_calls")).alias("m"))
    rows = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["m"]).alias("messages"))
    return rows.select("conv_id", templates.render("messages", "im", tools=True).alias("rendered"))


@query("""with c as (select conv_id, max(text) filter (role = 'user') as q, max(text) filter (role = 'assistant') as a from conversations group by 1 having q is not null and a is not null)
select conv_id, chr(10) || chr(10) || '### 指示:' || chr(10) || q || chr(10) || chr(10) || '### 応答:' || chr(10) as prompt, a as chosen, 'はい' as rejected from c where len(regexp_extract_all(q, '\\S+')) + len(regexp_extract_all(a, '\\S+')) <= 150""")
def section_pairs(spark, sf):
    said = lambda r: F.array_max(F.transform(F.filter("messages", lambda m: m["role"] == r), lambda m: m["content"]))
    rows = chats(spark, sf).select("conv_id", said("user").alias("q"), said("assistant").alias("chosen")).where("q is not null and chosen is not null")
    prompt = templates.render(convert.turns(("user", F.col("q"))), "sections_ja", prompt=True)
    short = F.size(F.concat(lengths(F.col("q")), lengths(F.col("chosen")))) <= 150
    return rows.where(short).select("conv_id", prompt.alias("prompt"), "chosen", F.lit("はい").alias("rejected"))


# sources and sinks


@query("select doc_id, lang, n_chars from documents")
def json_records(spark, sf):
    path = sinks.shared_path(spark, "records.jsonl")
    sinks.write(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), path)
    return readers.read(spark, path, schema="doc_id long, lang string, n_chars long")


@query("select doc_id, source, coalesce(lang, 'none') as part from documents")
def parquet_folders(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.coalesce("lang", F.lit("none")).alias("part"))
    paths = []
    for i, some in enumerate((docs.where("part = 'en'"), docs.where("part <> 'en'"))):
        paths.append(sinks.shared_path(spark, f"folder-{i}"))
        sinks.write(some, paths[-1])
    return readers.read(spark, *paths)


@query("select n_nationkey, n_name, n_regionkey from nation")
def csv_records(spark, sf):
    path = sinks.shared_path(spark, "nations.csv")
    table(spark, sf, "nation").write.option("header", True).csv(path)
    return readers.read(spark, path, schema="n_nationkey int, n_name string, n_regionkey int")


@query("""select n_nationkey::varchar as id, n_name as name, case when n_regionkey = 2 then null else n_regionkey::varchar end as region from nation""")
def workbook_rows(spark, sf):
    path = sinks.shared_path(spark, "nations.xlsx")
    rows = table(spark, sf, "nation").selectExpr("n_nationkey as id", "n_name as name", "case when n_regionkey <> 2 then n_regionkey end as region")
    sinks.write_workbook(rows, path)  # 25 rows
    return readers.read_workbook(spark, path)


@query("select n_nationkey, n_name from nation")
def database_rows(spark, sf):
    """The database is an archive in the shared folder, so executors read it as the driver does; any other URL goes the same way."""
    url = sinks.write_database(table(spark, sf, "nation").select("n_nationkey", "n_name"), sinks.shared_path(spark, "nations.jar"), "nations")
    return readers.read_database(spark, url, "nations").toDF("n_nationkey", "n_name")


@query("select * from nation")
def resolved_dataset(spark, sf):
    at = PurePosixPath(sf)
    return readers.resolve(spark, at.name, "nation", ("/nowhere", sf[: -len(at.name) - 1]))


@query("""with l as (select doc_id % 50 as id, doc_id as v, case when doc_id % 2 = 0 then 'hard' else 'soft' end as method from documents where doc_id % 7 <> 3), k as (select *, row_number() over (partition by id order by v desc) as r from l) select id::varchar as id, v, method from k where r = 1""")
def tolerant_records(spark, sf):
    path = sinks.shared_path(spark, "lines.txt")
    line = F.expr("case when doc_id % 7 = 3 then '{\"id\": broken' when doc_id % 2 = 0 then '{\"id\": \"' || doc_id % 50 || '\", \"v\": ' || doc_id || ', \"method\": \"hard\", \"unknown\": [1]}' else '{\"v\": ' || doc_id || ', \"id\": \"' || doc_id % 50 || '\"}' end")
    table(spark, sf, "documents").repartition(1).sortWithinPartitions("doc_id").select(line.alias("value")).write.text(path)
    schema = StructType([StructField("id", StringType()), StructField("v", LongType()), StructField("method", StringType())])
    return readers.read_tolerant(spark, path, schema, defaults={"method": "soft"})[0]


@query("""select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 250 as shard, true as named from orders""")
def sharded_files(spark, sf):
    path = sinks.shared_path(spark, "shards.jsonl")
    sinks.write_shards(table(spark, sf, "orders").select("o_orderkey"), path, 250, ["o_orderkey"])
    rows = readers.read_shards(spark, path, schema="o_orderkey long, shard long")
    return rows.select("o_orderkey", "shard", F.col("file_id").startswith("part-").alias("named"))


@query("select n_name as name, 'nations' as dataset, n_regionkey as region from nation union all select r_name, 'regions', null from region")
def tagged_files(spark, sf):
    a, b = sinks.shared_path(spark, "a.parquet"), sinks.shared_path(spark, "b.parquet")
    sinks.write(table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), a)
    sinks.write(table(spark, sf, "region").select(F.col("r_name").alias("name")), b)
    return readers.tag_files(spark, {a: "nations", b: "regions"})


@query("""select doc_id, coalesce(lang, 'none') as lang from documents""")
def partitioned_sink(spark, sf):
    path = sinks.shared_path(spark, "parts.parquet")
    sinks.write(table(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang")), path, partition_by=("lang",))
    return readers.read(spark, path)


HEX = "lpad(hex(id % 256), 2, '0') || lpad(hex(id // 256), 2, '0')"


@query(f"""with t as (select * from ({TOKENS}) where id > 0), p as (select least(id, 60000) as id, row_number() over (order by doc_id, i) - 1 as p from t) select p // 1000 as chunk, 'uint16' as kind, lower(string_agg({HEX}, '' order by p)) as data from p group by 1""")
def token_chunks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.transform(lengths(F.col("text")), lambda n: F.least(n, F.lit(60000))).alias("ids"))
    path = sinks.shared_path(spark, "chunks")
    sinks.write_chunks(docs, "doc_id", "ids", path, 1000, largest=60000)
    return spark.read.parquet(f"{path}/tokens").select(F.col("chunk").cast("long").alias("chunk"), "kind", F.lower(F.hex("data")).alias("data"))


@query(f"""with l as (select doc_id, len(regexp_extract_all(text, '\\S+')) as n from documents), s as (select doc_id, n, sum(n) over (order by doc_id) - n as a from l where n > 0), c as (select doc_id, a, a + n as b, unnest(range((a // 1000)::bigint, ((a + n - 1) // 1000 + 1)::bigint)) as chunk from s)
select chunk, doc_id, (greatest(a, chunk * 1000) - chunk * 1000)::bigint as start, (least(b, chunk * 1000 + 1000) - chunk * 1000)::bigint as stop from c""")
def token_chunk_index(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", lengths(F.col("text")).alias("ids"))
    path = sinks.shared_path(spark, "chunks")
    sinks.write_chunks(docs, "doc_id", "ids", path, 1000, largest=60000)
    return spark.read.option("header", True).schema("chunk long, doc_id long, start long, stop long").csv(f"{path}/boundaries")


@query("""select 'parts' as source, p_partkey::varchar as id, 'user: ' || p_name || chr(10) || 'assistant: ' || p_brand as lines from part union all select 'nations', n_nationkey::varchar, 'user: ' || n_name || chr(10) || 'assistant: ' || n_regionkey from nation, range(2)""")
def cached_mixture(spark, sf):
    base = sinks.shared_path(spark, "mixture")
    sinks.write(table(spark, sf, "part").selectExpr("cast(p_partkey as string) as id", "p_name as prompt", "p_brand as completion"), f"{base}/parts.parquet")
    sinks.write(table(spark, sf, "nation").selectExpr("cast(n_nationkey as string) as id", "n_name as prompt", "cast(n_regionkey as string) as completion"), f"{base}/nations.parquet")
    steps = (("to_messages", {}),)
    mixture = registry.Mixture((registry.Dataset(f"{base}/parts.parquet", steps=steps), registry.Dataset(f"{base}/nations.parquet", "2.0", steps=steps)), columns=("id",))
    registry.build_cached(spark, mixture, f"{base}/cache")
    rows = registry.build_cached(spark, mixture, f"{base}/cache")  # from the cache
    source = F.when(F.endswith("dataset_source", F.lit("parts.parquet")), "parts").otherwise("nations")
    return rows.select(source.alias("source"), "id", convert.flatten_prompt("messages").alias("lines"))


# streams


def _events(spark, sf, name: str) -> DataFrame:
    """The events as a stream of files."""
    path = sinks.shared_path(spark, name + ".parquet")
    sinks.write(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), path)
    return readers.stream(spark, path, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")


def _drain(stream: DataFrame, spark, name: str) -> DataFrame:
    """All that a stream appends until its input is used up."""
    out = sinks.shared_path(spark, name + ".parquet")
    stream.writeStream.format("parquet").option("checkpointLocation", sinks.shared_path(spark, name + "-state")).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("select event_id, user_id, value from events where event_type <> 'view' and value > 1")
def streamed_scan(spark, sf):
    return _drain(_events(spark, sf, "scan").where("event_type <> 'view' and value > 1").select("event_id", "user_id", "value"), spark, "scan-out")


@query("select event_id, user_id from events")
def streamed_once(spark, sf):
    path = sinks.shared_path(spark, "twice.parquet")
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    sinks.write(rows.unionByName(rows), path)
    stream = readers.stream(spark, path, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    return _drain(rollouts.once(stream, "event_id", "ts", "100000 days").select("event_id", "user_id"), spark, "once-out")


@query("""with w as (select time_bucket(interval 1 hour, ts) as t, event_type, count(*) as n, round(sum(value), 4) as total, (select max(ts) from events) as last from events group by 1, 2) select strftime(t, '%Y-%m-%d %H:%M:%S') as start, event_type, n, total from w where t + interval 1 hour <= date_trunc('millisecond', last) - interval 2 hour""")
def streamed_windows(spark, sf):
    out = _drain(rollouts.windowed_counts(_events(spark, sf, "windows"), "ts", "event_type", "value", "1 hour", "2 hours"), spark, "windows-out")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", rounded("total", 4).alias("total"))


GROUPS = "select event_id, user_id, event_type = 'purchase' as ok, (event_type = 'purchase')::int::double as reward, case when event_id % 5 = 0 then 'length' else 'stop' end as finish from events"


@query(f"""with e as ({GROUPS}), g as (select *, avg(reward) over (partition by user_id) as mean, stddev_pop(reward) over (partition by user_id) as dev, max(reward) over (partition by user_id) > min(reward) over (partition by user_id) as varied from e)
select event_id, round((reward - mean) / (dev + 1e-8), 4) as advantage from g where varied and finish = 'stop'""")
def streamed_rollouts(spark, sf):
    reward = (F.col("event_type") == "purchase").cast("double")
    rows = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("prompt"), reward.alias("reward"), F.when(F.col("event_id") % 5 == 0, "length").otherwise("stop").alias("finish_reason"))
    path, out = sinks.shared_path(spark, "rollouts.parquet"), sinks.shared_path(spark, "batches")
    sinks.write(rows.repartition(1), path)  # one file, so that a prompt's rollouts come in one batch
    stream = readers.stream(spark, path, rows.schema)
    rollouts.write_batches(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"), sinks.shared_path(spark, "batches-state")).awaitTermination()
    return spark.read.parquet(f"{out}/*").select("event_id", rounded("advantage", 4).alias("advantage"))


@query(f"""with e as ({GROUPS}), s as (select user_id::varchar as prompt, count(*) as attempts, count_if(ok)::bigint as passes from e group by 1) select prompt, attempts, passes, round(passes / attempts, 6) as rate, attempts >= 4 and passes / attempts >= 0.25 as excluded from s""")
def streamed_state(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("p"), (F.col("event_type") == "purchase").alias("ok"))
    path, out = sinks.shared_path(spark, "tries.parquet"), sinks.shared_path(spark, "solved")
    sinks.write(rows.repartition(1), path)
    solved = rollouts.solved_prompts(readers.stream(spark, path, rows.schema), "p", "ok", 4, 0.25)
    run = solved.writeStream.outputMode("update").option("checkpointLocation", sinks.shared_path(spark, "solved-state"))
    run.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/*").withColumn("rate", rounded("rate"))
