"""Verifiers, conversions, filters, joins and samples compared by value.

Where an operator reads free text, the text is made so that what it holds is known from the row's key: the SQL then
states the outcome itself and does not repeat the operator's rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import maths, verifiers
from ..operators import convert, evaluation, filters, joins, preferences, repetition, rewards, sampling, statistics
from .queries import chats, query, rounded, table

# verifiers

#: a and b: two small numbers of a row that are equal for some keys.
AB = "o_orderkey % 7 as a, o_custkey % 5 as b"


def pairs(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr("o_orderkey", "cast(o_orderkey % 7 as string) as a", "cast(o_custkey % 5 as string) as b", "o_orderkey % 3 as k")


@query(f"""with o as (select o_orderkey, {AB}, o_orderkey % 3 as k from orders) select o_orderkey, (a = b)::int::double as gsm8k, (a = b)::int::double as math, (a = b)::int::double as math_value, (a = b)::int::double as strict_math, (a = b)::int::double as flan,
(a = b and k > 0)::int::double as string_matcher, (a = b)::int::double as puzzle, case k when 0 then 0.0 when 1 then (case when a = b then 1.0 when a = b + 1 then 1.0 else 0.1 end) else (case when a = b or a = b + 1 then 2.0 / 3 else 0.1 end) end::double as search_f1,
(k = 1 and a in (b, b + 1))::int::double as search_exact, round(1 - abs(a + 1 - b) / 10.0, 6)::double as max_length, round(case when a + 1 < b then 1.0 else 1 - (a + 1 - b) / 10.0 end, 6)::double as up_to_max_length from o""")
def verifier_scores(spark, sf):
    c = lambda *parts: F.concat(*[F.col(p) if p in ("a", "b") else F.lit(p) for p in parts])
    labels = F.concat(F.lit('["'), F.col("b"), F.lit('", "'), (F.col("b").cast("int") + 1).cast("string"), F.lit('"]'))
    tagged = F.when(F.col("k") == 0, c("a")).when(F.col("k") == 1, c("think <finish>", "a", "</finish>")).otherwise(c("<finish>", "a", " more</finish>"))
    cases = {
        "gsm8k": verifiers.gsm8k(c("First 12 and 3,400, then ", "a"), "b"),
        "math": verifiers.math(c("we get \\boxed{", "a", "}"), "b"),
        "math_value": verifiers.math_value(c("so \\boxed{\\frac{", "a", "}{2}}"), c("\\frac{", "b", "}{2}")),
        "strict_math": verifiers.strict_math(c("Final Answer: The final answer is $", "a", "$. I hope it is correct."), "b"),
        "flan": verifiers.flan(c("because. The answer is: The ", "a", "!"), "b"),
        "string_matcher": verifiers.string_matcher(F.when(F.col("k") == 0, c("<answer>", "a")).otherwise(c("<answer>no</answer> <answer>A ", "a", ".</answer>")), "b"),
        "puzzle": verifiers.puzzle(c("<think>7 8</think><answer> ", "a", " </answer>"), "b"),
        "search_f1": verifiers.search_f1(tagged, labels),
        "search_exact": verifiers.search_exact(F.when(F.col("k") == 2, c("<finish>", "a", " more</finish>")).when(F.col("k") == 1, c("x <FINISH>", "a", "</finish>")).otherwise(c("a")), labels),
        "max_length": rounded(verifiers.max_length(F.array_join(F.array_repeat(F.lit("w"), F.col("a").cast("int") + 1), " "), "b", most=10)),
        "up_to_max_length": rounded(verifiers.up_to_max_length(F.array_join(F.array_repeat(F.lit("w"), F.col("a").cast("int") + 1), " "), "b", most=10)),
    }
    return pairs(spark, sf).select("o_orderkey", *[x.cast("double").alias(n) for n, x in cases.items()])


@query("""select o_orderkey, round(case when o_orderkey % 6 = 0 then 0.0 when (o_orderkey % 6) / 5.0 < 0.4 then 0.0 else (o_orderkey % 6) / 5.0 end, 6)::double as rate, round(greatest(0.0, (o_orderkey % 6) / 5.0 - 0.1 * (o_custkey % 4)), 6)::double as timed,
(o_orderkey % 3 = 1)::int::double as printed from orders""")
def program_scores(spark, sf):
    results = F.expr("transform(sequence(1, 5), i -> cast(i <= o_orderkey % 6 as int))")
    times = F.array_repeat((F.col("o_custkey") % 4).cast("double"), 5)
    claimed = F.concat(F.lit("out <result>no</result> then <Result> "), (F.col("o_orderkey") % 3).cast("string"), F.lit(" </result>"))
    return table(spark, sf, "orders").select("o_orderkey", rounded(verifiers.pass_rate(results, 0.4)).alias("rate"), rounded(verifiers.pass_rate(results, 0.0, times, 0.1)).alias("timed"), verifiers.output_matches(F.lit("1\n"), claimed).alias("printed"))


@query(f"""with o as (select o_orderkey, {AB}, o_orderkey % 4 as k from orders) select o_orderkey, case k when 3 then null else (a = b)::int::double end as score from o""")
def verifier_by_name(spark, sf):
    name = F.expr("case o_orderkey % 4 when 0 then 'GSM8K' when 1 then 'puzzle' when 2 then 'Flan' else 'unknown' end")
    text = F.expr("case o_orderkey % 4 when 2 then 'The answer is: ' || a else a end")
    return pairs(spark, sf).select("o_orderkey", verifiers.verify(name, text, F.col("b")).alias("score"))


@query("""select o_orderkey, case o_orderkey % 3 when 0 then 0.0 when 1 then 0.5 else 1.0 end::double as score from orders""")
def instruction_scores(spark, sf):
    words = F.expr("case o_orderkey % 3 when 0 then 'one, two.' when 1 then 'one two.' else 'one two' end")
    label = F.lit('{"instruction_id": ["punctuation:no_comma", "punctuation:punctuation_dot"], "kwargs": [null, {"relation": null}]}')
    return rewards.instruction_scores(table(spark, sf, "orders").select("o_orderkey", words.alias("t"), label.alias("l")), "o_orderkey", "t", "l")


@query(f"""with o as (select o_orderkey, {AB}, o_orderkey % 3 as k from orders) select o_orderkey, (a = b)::int::double as squares, case k when 0 then 1.0 else (a = b)::int::double end::double as boxed from o""")
def symbolic_answers(spark, sf):
    c = lambda *parts: F.concat(*[F.col(p) if p in ("a", "b") else F.lit(p) for p in parts])
    rows = pairs(spark, sf)
    square = c("x^2 + 2 \\cdot ", "b", "x + ", "b", "^2")
    boxed = F.when(F.col("k") == 0, c("so \\boxed{\\frac{2 \\sqrt{3}}{", "b", "+1}}")).when(F.col("k") == 1, c("so \\boxed{\\{7, ", "a", "\\}}")).otherwise(c("so \\boxed{[", "a", ", \\infty)}"))
    label = F.when(F.col("k") == 0, c("\\sqrt{12} \\cdot (1 + ", "b", ")^{-1}")).when(F.col("k") == 1, c("\\{", "b", ",7\\}")).otherwise(c("[", "b", ",\\infty)"))
    return rows.select("o_orderkey", verifiers.math(c("$(x + ", "a", ")^2$"), square).alias("squares"), verifiers.math_value(boxed, label).alias("boxed"))


@query("""with o as (select o_orderkey, (o_orderkey % 2)::double as v, case o_custkey % 3 when 0 then 0.0 when 1 then 0.5 else 1.0 end::double as f, o_orderkey % 5 < 3 as good, case when o_custkey % 4 = 0 then 'length' else 'stop' end as finish from orders)
select o_orderkey, v + f as added, case when f = 1 then v else 0.0 end::double as gated, case when good then v + f else f end as good_only, case when finish = 'stop' then v else -1.0 end::double as stopped from o""")
def reward_composition(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "cast(o_orderkey % 2 as double) as v", "case o_custkey % 3 when 0 then 0.0D when 1 then 0.5D else 1.0D end as f", "o_orderkey % 5 < 3 as good", "case when o_custkey % 4 = 0 then 'length' else 'stop' end as finish")
    v, f = F.col("v"), F.col("f")
    return rows.select("o_orderkey", rewards.compose(v, f).alias("added"), rewards.compose(v, f, additive=False).alias("gated"), rewards.compose(v, f, good=F.col("good")).alias("good_only"), rewards.compose(v, finish=F.col("finish"), penalty=-1.0).alias("stopped"))


@query("select o_orderkey, round((o_orderkey % 5 * (o_custkey % 2) + o_orderkey % 3) / (1.0 + o_custkey % 2), 6)::double as mean from orders")
def masked_means(spark, sf):
    values = F.array(F.col("o_orderkey") % 5, F.col("o_orderkey") % 3, F.lit(9))
    mask = F.array(F.col("o_custkey") % 2, F.lit(1), F.lit(0))
    return table(spark, sf, "orders").select("o_orderkey", rounded(maths.masked_mean(values, mask)).alias("mean"))


# conversions


def _spec_rows() -> str:
    parts = []
    for name, spec in convert.SPECS.items():
        text = []
        for role, template in spec:
            filled = "'" + template.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
            for c in ("instruction", "input", "output", "query", "answer", "response", "question", "system_prompt", "prompt", "completion", "inputs", "targets", "problem", "solution", "generated_solution"):
                filled = filled.replace("{" + c + "}", f"' || '{c} of ' || c_name || '")
            line = f"'{role}: ' || {filled}"
            text.append(f"case when c_acctbal < 0 then '' else {line} || chr(10) end" if role == "system" else line + (" || chr(10)" if role == "user" else ""))
        parts.append(f"select c_custkey, '{name}' as spec, {' || '.join(text)} as lines from customer")
    return " union all ".join(parts)


@query(_spec_rows())
def every_spec(spark, sf):
    rows = table(spark, sf, "customer")
    for c in ("instruction", "input", "output", "query", "answer", "response", "question", "system_prompt", "prompt", "completion", "inputs", "targets", "problem", "solution", "generated_solution"):
        text = F.concat(F.lit(f"{c} of "), "c_name")
        rows = rows.withColumn(c, F.when(F.col("c_acctbal") < 0, "").otherwise(text) if c == "system_prompt" else text)
    out = None
    for name in convert.SPECS:
        one = convert.convert(rows, name).select("c_custkey", F.lit(name).alias("spec"), convert.flatten_prompt("messages").alias("lines"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""select conv_id, row_number() over (partition by conv_id order by turn) - 1 as turn, role, trim(text, e' \\t\\n\\r\\x0b\\x0c') as text from conversations where role in ('user', 'assistant')""")
def parsed_transcripts(spark, sf):
    spoken = F.filter("messages", lambda m: m["role"].isin("user", "assistant"))
    mark = lambda m: F.when(m["role"] == "user", F.lit("\n\nHuman: ")).otherwise(F.lit("\n\nAssistant: "))
    joined = F.array_join(F.transform(spoken, lambda m: F.concat(mark(m), m["content"])), "")
    rows = chats(spark, sf).select("conv_id", convert.parse_transcript(joined).alias("messages"))
    return convert.explode_turns(rows).withColumn("turn", F.col("turn").cast("long"))


@query("""with p as (select p_partkey, p_name, p_brand, p_type, p_size % 4 as a, p_partkey % 3 as b from part), s as (select *, 'system: Cite.' || chr(10) || 'user: ' || p_name || chr(10) || chr(10) as head from p)
select p_partkey, case when a > b then head || '[1] ' || p_brand || chr(10) || chr(10) || '[2] ' || p_type || chr(10) || 'assistant: first' else head || '[1] ' || p_type || chr(10) || 'assistant: second' end as chosen,
case when a < b then head || '[1] ' || p_brand || chr(10) || chr(10) || '[2] ' || p_type || chr(10) || 'assistant: first' else head || '[1] ' || p_type || chr(10) || 'assistant: second' end as rejected, abs(a - b)::bigint as margin from s where a <> b""")
def quoted_answers(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", "p_name", "array(p_brand, p_type) as q1", "array(p_type) as q2", "'first' as a1", "'second' as a2", "p_size % 4 as s1", "p_partkey % 3 as s2")
    out = convert.quoted_pairs(rows, "p_name", ("q1", "q2"), ("a1", "a2"), ("s1", "s2"), "Cite.")
    return out.select("p_partkey", convert.flatten_prompt("chosen").alias("chosen"), convert.flatten_prompt("rejected").alias("rejected"), F.col("margin").cast("long").alias("margin"))


@query("""select p_partkey, 'user: ' || p_name as prompt, case when p_partkey % 3 = 0 then '' else p_brand end as one, case when p_partkey % 4 = 0 then '' else p_brand || ',' || p_type end as many, p_size::varchar as number, 'math' as dataset, '["' || p_brand || '","' || p_type || '"]' as json from part""")
def ground_truths(spark, sf):
    rows = table(spark, sf, "part").selectExpr("p_partkey", "p_name", "p_size", "case when p_partkey % 3 <> 0 then p_brand end as one", "case when p_partkey % 4 <> 0 then array(p_brand, p_type) end as many", "array(p_brand, p_type) as both")
    one = convert.with_ground_truth(rows, "p_name", "one").select("p_partkey", convert.flatten_prompt("messages").alias("prompt"), F.array_join("ground_truth", ",").alias("one"), F.array_join("dataset", ",").alias("dataset"))
    many = convert.with_ground_truth(rows, "p_name", "many").select("p_partkey", F.array_join("ground_truth", ",").alias("many"))
    number = convert.with_ground_truth(rows, "p_name", "p_size").select("p_partkey", F.array_join("ground_truth", ",").alias("number"))
    json = convert.json_answers(rows, "p_name", "both").select("p_partkey", F.col("ground_truth").alias("json"))
    return one.join(many, "p_partkey").join(number, "p_partkey").join(json, "p_partkey")


@query("""select p_partkey, 'user: Name ' || p_brand || '.' || chr(10) || 'assistant: ' || p_name || ' Acme' as filled, 'Question: 1?' || chr(10) || 'Answer: one' || chr(10) || chr(10) || 'Question: ' || p_name as shots, 'Say ' || p_name || '!' as prompt, p_size::varchar as completion, 'user: ' || p_name as chosen from part""")
def prompt_shapes(spark, sf):
    rows = table(spark, sf, "part")
    messages = convert.turns(("user", F.concat(F.lit("Name "), "p_brand", F.lit("."))), ("assistant", F.concat("p_name", F.lit(" {maker}"))))
    filled = rows.select("p_partkey", convert.flatten_prompt(convert.substitute(messages, {"maker": "Acme"})).alias("filled"))
    shots = convert.few_shot(rows, "p_name", [("1?", "one")]).select("p_partkey", F.col("messages")[0]["content"].alias("shots"))
    prompts = convert.prompt_completion(rows, "p_name", "p_size", "Say {prompt}!").select("p_partkey", "prompt", "completion")
    one = convert.turns(("user", F.col("p_name")))
    sides = convert.auto_convert(rows.select("p_partkey", one.alias("chosen"), one.alias("rejected"), F.lit("x").alias("reference_completion"))).select("p_partkey", convert.flatten_prompt("messages").alias("chosen"))
    return filled.join(shots, "p_partkey").join(prompts, "p_partkey").join(sides, "p_partkey")


@query("""select conv_id, string_agg(case role when 'user' then 'User A' when 'assistant' then 'User B' else 'System' end || ': ' || trim(text, e' \\t\\n\\r\\x0b\\x0c'), chr(10) || chr(10) order by turn) as talk from conversations where text <> '' group by conv_id""")
def two_user_transcripts(spark, sf):
    return chats(spark, sf).select("conv_id", convert.transcript("messages", "User A", "User B").alias("talk"))


@query("""with p as (select *, case p_partkey % 3 when 0 then '  ' when 1 then ' in ' || p_type || ' ' else null end as given from part) select p_partkey, case when p_partkey % 3 = 1 then p_name || chr(10) || chr(10) || 'in ' || p_type || chr(10) || chr(10) else p_name || chr(10) || chr(10) end as prompt,
case when p_partkey % 3 = 1 then 'Do: ' || p_name || '; with: in ' || p_type else 'Just: ' || p_name end as templated, p_name || chr(10) || chr(10) || 'Input:' || chr(10) || p_brand || chr(10) || 'Output:' || chr(10) || p_type || chr(10) || chr(10) || 'Input:' || chr(10) || p_size || chr(10) || 'Output:' || chr(10) as shots,
case p_partkey % 3 when 0 then p_name || ': ' when 1 then p_name || chr(10) else p_name || chr(10) end as opened, 'user: ' || p_name || chr(10) || 'assistant: ' || p_brand || chr(10) || 'user: ' || p_type || chr(10) || 'assistant: ok' as rounds, case when p_partkey % 3 = 0 then 'NO SOLUTION' else 'print(' || p_size || ')' end as code,
case when p_partkey % 3 = 2 then null else 'long ' || p_name end as label, p_partkey % 4 > 1 as kept from p""")
def corpus_shapes(spark, sf):
    rows = table(spark, sf, "part").withColumn("given", F.expr("case p_partkey % 3 when 0 then '  ' when 1 then ' in ' || p_type || ' ' end"))
    shots = convert.shown_examples("p_name", F.array(F.struct(F.col("p_brand").alias("input"), F.concat(F.lit(" "), "p_type").alias("output"))), F.col("p_size").cast("string"))
    opened = convert.open_prompt(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, ": ").when(F.col("p_partkey") % 3 == 1, "\n").otherwise("")))
    talk = F.concat(F.lit("The talk. [|Human|] "), "p_name", F.lit(" [|AI|]"), "p_brand", F.lit("[|Human|] [|Human|]"), "p_type", F.lit("\n[|AI|] ok [|Human|]"))
    code = F.when(F.col("p_partkey") % 3 == 0, "none").otherwise(F.concat(F.lit("```python\nold()\n``` then ```\nprint("), "p_size", F.lit(")\n```")))
    notes = F.when(F.col("p_partkey") % 3 == 2, F.array().cast("array<struct<long_answer:string>>")).otherwise(F.array(F.struct(F.concat(F.lit("long "), "p_name").alias("long_answer"))))
    said = F.array(F.struct(F.when(F.col("p_partkey") % 4 == 0, "system").when(F.col("p_partkey") % 4 == 1, "bing").otherwise("human").alias("from"), F.col("p_name").alias("value")))
    labelled = convert.long_form_answers(rows.withColumn("notes", notes).withColumn("said", said), "p_name", "notes", "search")
    kept = convert.without_roles(labelled, "said", ["system", "bing"]).select("p_partkey", F.lit(True).alias("kept"))
    shapes = labelled.select(
        "p_partkey", convert.instruction_prompt("p_name", "given").alias("prompt"), convert.instruction_prompt("p_name", "given", "p_partkey", [("Do: {instruction}; with: {input}", 1.0)], [("Just: {instruction}", 0.5)]).alias("templated"),
        shots.alias("shots"), opened.alias("opened"), convert.flatten_prompt(convert.marked_rounds(talk)).alias("rounds"), convert.code_solution(code).alias("code"), F.col("ground_truth").alias("label"),
    )
    return shapes.join(kept, "p_partkey", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


# filters

_NAMES = "'" + "|".join(k.lower().replace(".", "\\.") for k in filters.KEYWORDS) + "'"


@query(f"""with d as (select doc_id, case doc_id % 6 when 0 then 'ask ChatGPT about ' || text when 1 then 'askChatGPTabout ' || text when 2 then text || ' by Open Assistant' when 3 then text || ' a bard' when 4 then text || ' gpt 4' else text end as t from documents)
select doc_id, regexp_matches(lower(t), '(^|[^\\p{{L}}\\p{{Nd}}\\p{{M}}\\p{{Pc}}])(' || {_NAMES} || ')([^\\p{{L}}\\p{{Nd}}\\p{{M}}\\p{{Pc}}]|$)') and doc_id % 12 <> 0 as keyword, {' or '.join(f"contains(lower(t), '{s.lower()}')" for s in filters.SUBSTRINGS)} as substring from d""")
def provider_names(spark, sf):
    text = F.expr("case doc_id % 6 when 0 then 'ask ChatGPT about ' || text when 1 then 'askChatGPTabout ' || text when 2 then text || ' by Open Assistant' when 3 then text || ' a bard' when 4 then text || ' gpt 4' else text end")
    role = F.when(F.col("doc_id") % 12 == 0, "user").otherwise("assistant")
    rows = table(spark, sf, "documents").select("doc_id", F.array(convert.message(role, text)).alias("m"))
    return rows.select("doc_id", filters.has_keyword("m").alias("keyword"), filters.has_substring("m").alias("substring"))


@query("""select d.doc_id from documents d left join (select doc_id, max(toxic) as toxic from labels group by 1) l using (doc_id) where coalesce(toxic, 0) = 0 and not coalesce(contains(source, '1'), false) and coalesce(lang = 'en', false) and (source is null or source not in ('nowhere'))""")
def clean_records(spark, sf):
    toxic = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    language = F.when(F.col("lang") == "en", "English").otherwise(F.col("lang"))
    rows = table(spark, sf, "documents").join(toxic, "doc_id", "left")
    return rows.where(filters.clean_metadata("toxic", F.contains("source", F.lit("1")), language) & filters.not_from(["nowhere"])).select("doc_id")


@query("""select doc_id, regexp_matches(text, '[0-9]{4}') as hit, not regexp_matches(text, '[0-9]{4}') as missed from documents""")
def parted_rows(spark, sf):
    hit, rest = filters.partition_by_pattern(table(spark, sf, "documents"), "text", "[0-9]{4}")
    return hit.select("doc_id", F.lit(True).alias("hit"), F.lit(False).alias("missed")).unionByName(rest.select("doc_id", F.lit(False).alias("hit"), F.lit(True).alias("missed")))


@query("""with d as (select doc_id, len(regexp_extract_all(text, '\\S+')) as n, n_chars from documents) select doc_id, doc_id % 11 <> 0 and n <= 200 as short, true as unlimited, n > 0 and doc_id % 3 = 0 as labelled, length(d2.text) + length(coalesce(lang, '')) <= 4000 as brief, doc_id % 4 <> 0 as kept, doc_id % 5 <> 0 as complement from d join documents d2 using (doc_id)""")
def length_and_label_filters(spark, sf):
    words = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    ids = F.when(F.col("doc_id") % 11 != 0, F.transform(words, F.length))
    labels = F.transform(words, lambda w: F.when(F.col("doc_id") % 3 == 0, F.length(w)).otherwise(-100))
    valid = F.when(F.col("doc_id") % 4 == 1, F.lit(None).cast("int")).when(F.col("doc_id") % 4 == 2, -1).otherwise((F.col("doc_id") % 4 != 0).cast("int"))
    never = F.when(F.col("doc_id") % 5 == 0, True).when(F.col("doc_id") % 5 == 1, F.lit(None).cast("boolean")).otherwise(False)
    rows = table(spark, sf, "documents")
    return rows.select("doc_id", filters.within_length(ids, 200).alias("short"), filters.within_length(ids, None).alias("unlimited"), filters.has_labels(labels).alias("labelled"), filters.short_enough(["text", "lang"]).alias("brief"), filters.not_rejected(valid).alias("kept"), filters.complement(never).alias("complement"))


@query("""select doc_id from documents where lang is not null and source is not null and doc_id % 3 = 0""")
def complete_records(spark, sf):
    flag = F.when(F.col("doc_id") % 3 == 0, True).when(F.col("doc_id") % 3 == 1, F.lit(None).cast("boolean")).otherwise(False)
    return filters.complete(table(spark, sf, "documents").withColumn("good", flag), ["lang", "source"], ["good"]).select("doc_id")


@query("""with o as (select o_orderkey, o_orderkey % 4 as k, o_custkey % 60 as n from orders), r as (select o_orderkey, case k when 0 then case when n >= 4 then 'line_repeated_' || n || 'x_consecutive' end when 1 then case when n >= 8 then 'line_repeated_' || n || 'x_consecutive_short_phrase' end
when 2 then case when n >= 10 then 'paragraph_repeated_' || n || 'x' end else case when n >= 40 then 'line_repeated_' || n || 'x' end end as reason from o)
select o_orderkey, reason is not null as has_repetition, reason as repetition_reason, case when reason is null then '' when o_orderkey % 4 = 1 then 'So it is done' else 'Black pepper cake' end as example from r""")
def repeated_blocks(spark, sf):
    n = "cast(o_custkey % 60 as int)"
    many = f"array_join(transform(sequence(0, greatest({n} - 1, 0)), i -> 'Black pepper cake. Warm bread ' || i || '. '), '')"
    text = F.expr(f"case o_orderkey % 4 when 0 then repeat('Black pepper cake. ', {n}) when 1 then repeat('So it is done. ', {n}) when 2 then repeat('Black pepper cake\\n\\n', {n}) else case when {n} = 0 then '' else {many} end end")
    out = repetition.block_repetition(table(spark, sf, "orders").select("o_orderkey", text.alias("text")), "o_orderkey")
    return out.select("o_orderkey", "has_repetition", "repetition_reason", F.array_join("repetition_examples", "|").alias("example"))


@query("""with r as (select o_orderpriority, o_custkey % 60 as n from orders where o_orderkey % 4 = 0 and o_custkey % 60 >= 4) select 'line_repeated_' || n || 'x_consecutive' as repetition_reason, o_orderpriority, count(*) as n from r group by 1, 2, r.n""")
def repetition_by_source(spark, sf):
    rows = table(spark, sf, "orders").where("o_orderkey % 4 = 0").select("o_orderkey", "o_orderpriority", F.expr("repeat('Black pepper cake. ', cast(o_custkey % 60 as int))").alias("text"))
    return repetition.repetition_report(repetition.block_repetition(rows, "o_orderkey"), rows, "o_orderkey", "o_orderpriority")


# joins, unions and samples


@query("select * from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
def without_customers(spark, sf):
    bad = table(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.without_ids(table(spark, sf, "orders"), bad, "o_custkey")


@query("select o_custkey as dataset_index, o_orderkey, c_name, unnest(range(3))::int as sample from orders join customer on o_custkey = c_custkey")
def prompts_by_index(spark, sf):
    samples = table(spark, sf, "orders").select(F.col("o_custkey").alias("dataset_index"), "o_orderkey")
    prompts = table(spark, sf, "customer").select(F.col("c_custkey").alias("dataset_index"), "c_name")
    return joins.prompts_by_index(samples, prompts, times=3)


#: Line numbers repeat in an order; i numbers its lines.
LINES = "select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as i from lineitem"


def numbered_lines(spark, sf) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, sf, "lineitem").withColumn("i", F.row_number().over(order))


@query(f"""with l as (select l_orderkey, i, l_quantity % 3 as f, l_partkey as s from ({LINES})), g as (select l_orderkey, f, count(*) as votes, min(i) as first, arg_max(s, i) as answer from l group by 1, 2)
select l_orderkey, answer, votes from g qualify row_number() over (partition by l_orderkey order by votes desc, first) = 1""")
def voted_classes(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("i", F.col("l_partkey").alias("s"), (F.col("l_quantity") % 3).alias("f"))))
    samples = numbered_lines(spark, sf).groupBy("l_orderkey").agg(rows.alias("r")).select("l_orderkey", F.transform("r", lambda x: x["s"]).alias("s"), F.transform("r", lambda x: x["f"]).alias("f"))
    return evaluation.class_vote(samples, "l_orderkey", "s", "f")


@query("""with s as (select source, count(*) as n, count_if(n_chars > 1000) as long, max(n_chars) as most from documents group by 1) select source, n, round(100.0 * long / n, 2) as long_percent, most from s""")
def length_report(spark, sf):
    stats = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("long"), F.max("n_chars").alias("most"))
    return statistics.statistics_report(stats, "source", "n", ["long"])


@query(f"""with v as (select *, row_number() over (partition by l_orderkey order by i) as j from ({LINES}) where l_returnflag <> 'R') select l_orderkey, max(l_partkey) filter (j = 1) as chosen, max(l_partkey) filter (j = 2) as rejected from v where j <= 2 group by 1 having count(*) = 2""")
def ranked_pairs(spark, sf):
    valid = F.col("l_returnflag") != "R"
    two = sampling.per_group(numbered_lines(spark, sf).where(valid), "l_orderkey", 2, "i")  # of two valid answers neither is drawn at random
    rows = two.unionByName(numbered_lines(spark, sf).where(~valid))
    return preferences.ranked_pair(rows, "l_orderkey", "l_partkey", "i", valid)


@query(f"""with l as (select *, count(*) over (partition by l_orderkey) as n from ({LINES}) where i <= 3) select l_orderkey, string_agg(l_partkey::varchar, ',' order by i) as completions, string_agg(i::varchar, ',' order by i) as models from l where n = 3 group by 1""")
def completions_by_prompt(spark, sf):
    out = preferences.completions_by_prompt(numbered_lines(spark, sf).where("i <= 3"), "l_orderkey", "l_partkey", "i", 3)
    return out.select("l_orderkey", F.array_join("completions", ",").alias("completions"), F.array_join("models", ",").alias("models"))


@query("select coalesce(sum(c_acctbal), 0.0) as points from customer where regexp_matches(c_name, '[05]$')")
def usage_points(spark, sf):
    from ..sources import sinks

    return sinks.usage_by(table(spark, sf, "customer"), "c_name", "[05]$", "c_acctbal").withColumn("points", rounded("points", 4))


@query("select n_nationkey, n_name, unnest(range(3)) * 0 as zero from nation")
def repeated_rows(spark, sf):
    return sampling.repeat(table(spark, sf, "nation"), 3).select("n_nationkey", "n_name", F.lit(0).cast("long").alias("zero"))


@query("""with c as (select o_orderpriority, count(*) as n from orders group by 1) select o_orderpriority, least(n, floor(case o_orderpriority when '1-URGENT' then 0.5 when '2-HIGH' then 0.3 else 0.2 end * 1000)::bigint) as n from c where o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW')""")
def stratified_counts(spark, sf):
    out = sampling.stratified(table(spark, sf, "orders"), "o_orderpriority", {"1-URGENT": 0.5, "2-HIGH": 0.3, "5-LOW": 0.2}, 1000, "o_orderkey")
    return out.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""select c_custkey as key, c_name as name, c_acctbal as balance, c_mktsegment as segment from customer union all select s_suppkey, s_name, s_acctbal, null from supplier union all select n_nationkey::bigint, n_name, null, null from nation""")
def concatenated(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit(1).alias("dropped"))
    c = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    return sampling.concatenate(a, b, c)


@query("select o_orderkey, o_custkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as r from orders where o_orderstatus <> 'F') where r = 1")
def first_then_sampled(spark, sf):
    chosen = sampling.first_per_key(table(spark, sf, "orders").where("o_orderstatus <> 'F'"), "o_custkey", ["o_orderkey"])
    return sampling.take(chosen, sampling.Share(1.0), "o_orderkey", seed=3).select("o_orderkey", "o_custkey")


@query("""with c as (select count(*) as n from orders) select (row_number() over (order by o_totalprice desc, o_orderkey) - 1) // 64 as batch, o_orderkey from orders""")
def length_batches(spark, sf):
    return sampling.length_batches(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", 64).select("batch", "o_orderkey")


@query("""with r as (select count(*) as n from documents where doc_id % 10 <> 0), m as (select (n - 1 + 2) // 3 as mine from r) select unnest(range((mine // 16)::bigint)) as batch, 16::bigint as n from m""")
def epoch_batch_sizes(spark, sf):
    docs = table(spark, sf, "documents")
    out = sampling.epoch_batches(docs, "doc_id", 16, seed=42, epoch=1, rank=1, world=3, exclude=docs.where("doc_id % 10 = 0"))
    return out.join(docs.where("doc_id % 10 <> 0").select("doc_id"), "doc_id").groupBy("batch").agg(F.countDistinct("doc_id").alias("n"))


@query("""select o_orderkey, case o_orderkey % 3 when 0 then null else 'since ' || o_custkey end as explanation, case o_orderkey % 4 when 0 then null else 'yes' end as decision from orders""")
def judge_decisions(spark, sf):
    text = F.expr("case when o_orderkey % 3 = 0 then '' else 'Explanation: since ' || o_custkey || '\\n' end || case when o_orderkey % 4 = 0 then '' else 'Decision: YES' end")
    v = preferences.parse_judgement(text)
    return table(spark, sf, "orders").select("o_orderkey", v["explanation"].alias("explanation"), v["decision"].alias("decision"))
