"""Operators against literal cases and plain reimplementations."""

import json
import random

import pytest
from pyspark.sql import functions as F

from granary.functions import text
from granary.operators import contamination, convert, evaluation, filters, joins, packing, preferences, repetition, rewards, sampling, statistics, trees
from granary.plans import registry
from granary.sources import readers, sinks
from granary.streaming import rollouts

MESSAGES = "array<struct<role:string,content:string>>"


def chats(spark, *conversations):
    return spark.createDataFrame([(i, [{"role": r, "content": c} for r, c in turns]) for i, turns in enumerate(conversations)], f"id long, messages {MESSAGES}")


# sources and sinks


def test_tolerant_reader_keeps_the_last_and_reports_bad_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"id": 1, "output": "a", "other": 5}\nnot json\n\n{"id": 2}\n{"id": 1, "output": "b"}\n')
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField(c, StringType()) for c in ("id", "output", "evaluation_method")])
    good, bad = readers.read_tolerant(spark, str(path), schema, defaults={"evaluation_method": "soft"})
    assert sorted(map(tuple, good.collect())) == [("1", "b", "soft"), ("2", None, "soft")]
    assert [r[0] for r in bad.collect()] == ["not json"]


def test_files_by_suffix_shards_and_resolution(spark, tmp_path):
    df = spark.range(7).withColumn("g", F.col("id") % 2)
    sinks.write(df, str(tmp_path / "d" / "train.parquet"))
    sinks.write_shards(df, str(tmp_path / "s.json"), 2, ["id"], ("g",))
    assert readers.resolve(spark, "d", "train", (str(tmp_path),)).count() == 7
    assert readers.read(spark, str(tmp_path / "s.json")).groupBy("g", "shard").count().agg(F.max("count")).first()[0] == 2
    with pytest.raises(FileNotFoundError):
        readers.resolve(spark, "none", roots=(str(tmp_path),))
    tagged = readers.tag_files(spark, {str(tmp_path / "d" / "train.parquet"): "x"})
    assert {r["dataset"] for r in tagged.collect()} == {"x"}
    assert sinks.smallest_type(255) == "uint8" and sinks.smallest_type(256) == "uint16" and sinks.smallest_type(100_000) == "uint32"


def test_ranks_without_one_task(spark):
    rows = sinks.ranked(spark.range(1000).repartition(7), ["id"]).collect()
    assert all(r["rank"] == r["id"] + 1 for r in rows)


# conversion


@pytest.mark.parametrize(
    ("columns", "want"),
    [
        ({"instruction": "I", "output": "O"}, [("user", "I"), ("assistant", "O")]), ({"prompt": "P", "completion": "C"}, [("user", "P"), ("assistant", "C")]),
        ({"question": "Q", "response": "R", "system_prompt": "S"}, [("system", "S"), ("user", "Q"), ("assistant", "R")]), ({"question": "Q", "response": "R", "system_prompt": ""}, [("user", "Q"), ("assistant", "R")]),
        ({"query": "Q", "answer": "A"}, [("user", "Q"), ("assistant", "A")]), ({"query": "Q", "response": "R"}, [("user", "Q"), ("assistant", "R")]),
    ],
)
def test_auto_convert(spark, columns, want):
    got = convert.auto_convert(spark.createDataFrame([tuple(columns.values())], list(columns))).first()["messages"]
    assert [tuple(m) for m in got] == want


def test_turns_with_unknown_roles_raise(spark):
    kind = "conversations array<struct<from:string,value:string>>"
    known, df = spark.createDataFrame([([("human", "a"), ("gpt", "b")],)], kind), spark.createDataFrame([([("alien", "x")],)], kind)
    assert [tuple(m) for m in known.select(convert.from_turns("conversations").alias("m")).first()["m"]] == [("user", "a"), ("assistant", "b")]
    with pytest.raises(Exception, match="alien"):
        df.select(convert.from_turns("conversations").alias("m")).collect()
    assert df.select(convert.from_turns("conversations", strict=False).alias("m")).first()["m"][0]["role"] == "assistant"


def test_transcripts_and_system_prompts(spark):
    df = spark.createDataFrame([("\n\nHuman: Hi there\n\nAssistant: Yo\n\nHuman: Bye",)], ["t"])
    assert [tuple(m) for m in df.select(convert.parse_transcript("t").alias("m")).first()["m"]] == [("user", "Hi there"), ("assistant", "Yo"), ("user", "Bye")]
    one = chats(spark, [("system", "old"), ("user", "a"), ("assistant", "b")])
    r = one.select(convert.with_system("messages", "new").alias("s"), convert.without_last_answer("messages").alias("w"), convert.transcript("messages").alias("t"), convert.flatten_prompt("messages").alias("f")).first()
    assert [m["content"] for m in r["s"]] == ["new", "a", "b"] and len(r["w"]) == 2
    assert r["t"] == "System: old\n\nUser: a\n\nAssistant: b" and r["f"] == "system: old\nuser: a\nassistant: b"


def test_verifiable_prompts(spark):
    df = spark.createDataFrame([("1+1?", "one and one #### 2", "b", "A", ["x", "y"])], ["question", "answer", "right", "wrong", "answers"])
    assert convert.split_rationale(df).first()["ground_truth"] == ["2"]
    assert convert.lettered_choices(df, "question", "right", ["wrong"]).first()["ground_truth"] == ["B"]
    assert json.loads(convert.json_answers(df, "question", "answers").first()["ground_truth"]) == ["x", "y"]
    assert convert.with_ground_truth(df, "question", "answers").first()["ground_truth"] == ["x", "y"]
    assert convert.replicate(df.withColumn("id", F.lit(3)), 5).select("id").distinct().count() == 5
    assert convert.target_lengths(df, "question", 10, 20).first()["target_length"] in range(10, 21)


# filters and repetition


def test_message_filters(spark):
    df = chats(
        spark,
        [("user", "I'm Claude, an AI assistant made by Anthropic, yes."), ("assistant", "ok")],
        [("user", "x"), ("assistant", "I am a language model trained by OpenAI to help.")],
        [("user", "hi"), ("assistant", None)],
        [("user", "汉字"), ("assistant", "abc 汉")],
        [("user", "q"), ("assistant", "<think>a</think>b")],
    )
    got = df.select(
        filters.claims_identity("messages").alias("i"), filters.has_keyword("messages").alias("k"), filters.has_substring("messages").alias("s"), filters.has_empty_message("messages").alias("e"),
        filters.in_script("messages").alias("c"), filters.in_script("messages", threshold=0.5).alias("c5"), filters.in_script("messages", with_user=True, threshold=0.5).alias("cu"), filters.thinks("messages").alias("t"),
    ).collect()
    column = lambda c: [r[c] for r in got]
    assert column("i") == [False, True, True, False, False] and column("k") == [False, True, False, False, False]
    assert column("s") == [True, True, False, False, False] and column("e") == [False, False, True, False, False]
    assert column("c") == [False, False, False, True, False] and column("c5") == [False] * 5 and column("cu") == [False, False, False, True, False]
    assert column("t") == [False, False, False, False, True]


def test_cutoffs_are_removed_by_id(spark):
    df = chats(spark, [("assistant", "As of my last update in May 2020, no.")], [("assistant", "fine")]).withColumn("id", F.lit("same"))
    assert filters.remove_cutoffs(df).count() == 0


def test_null_safe_filters(spark):
    df = spark.createDataFrame([("a", None, 0), (None, True, -1), ("b", False, 1), ("c", None, None)], "source string, toxic boolean, is_valid int")
    assert [r["source"] for r in df.where(filters.not_from(["a"])).collect()] == [None, "b", "c"]
    assert df.where(filters.not_rejected()).count() == 3
    kept, dropped = filters.partition_by_pattern(df, "source", "a|b")
    assert kept.count() + dropped.count() == df.count()


def plain_repetition(t, paragraph, sentence, run):
    """First paragraph or sentence over its threshold, for texts without code, mathematics or lists."""
    import re

    def counts(items, least):
        out = {}
        for i, x in enumerate(items):
            if len(x) >= least:
                out.setdefault(x, []).append(i)
        return {k: v for k, v in out.items() if len(v) > 1}

    def longest(pos):
        best = cur = 1
        for a, b in zip(pos, pos[1:]):
            cur = cur + 1 if b == a + 1 else 1
            best = max(best, cur)
        return best

    for p, pos in counts([x.strip() for x in t.split("\n\n") if x.strip()], 10).items():
        r = longest(pos)
        if r == 1 and len(p) < 20:
            continue
        need = paragraph * (4 if "\n" in p else 1)
        if len(pos) >= (min(2 * need, 30) if r == 1 else need):
            return f"paragraph_repeated_{len(pos)}x"
    for s, pos in counts([x.strip() for x in re.split(r"[.!?]+", t) if x.strip()], 5).items():
        if len(s.split()) <= 1:
            continue
        if any(w in s.lower() for w in repetition.PHRASES):
            if longest(pos) >= 2 * run:
                return f"line_repeated_{len(pos)}x_consecutive_short_phrase"
        elif longest(pos) >= run:
            return f"line_repeated_{len(pos)}x_consecutive"
        elif len(pos) >= sentence and len(s) >= 10:
            return f"line_repeated_{len(pos)}x"
    return None


def test_block_repetition_against_plain_code(spark):
    rng, docs = random.Random(3), []
    vocabulary = ["quick brown fox", "lazy dog sleeps", "purple lemur jump", "verb", "this that"]
    for i in range(120):
        parts = [". ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6))) + "." for _ in range(rng.randint(1, 5))]
        docs.append((i, "\n\n".join(p for p in parts for _ in range(rng.choice([1, 1, 2, 4])))))
    got = repetition.block_repetition(spark.createDataFrame(docs, ["doc_id", "text"]), paragraphs_at=3, sentences_at=5, runs_at=2)
    assert {r["doc_id"]: r["repetition_reason"] for r in got.collect()} == {i: plain_repetition(t, 3, 5, 2) for i, t in docs}


def test_kinds_of_content(spark):
    df = spark.createDataFrame([("import os",), ("foo(bar",), ("x + y",), ("plain words",), ("1. a\n2. b",), ("math.log(x)",)], ["t"])
    x = F.col("t")
    got = df.select(repetition.is_statement(x), repetition.is_formula(x), repetition.is_expression(x), repetition.is_list(x)).collect()
    assert [tuple(r) for r in got] == [(True, False, False, False), (True, False, True, False), (False, True, True, False), (False, False, False, False), (False, False, False, True), (True, True, True, False)]


def test_ngram_positions(spark):
    r = repetition.ngram_repetition(spark.createDataFrame([(1, "A b c a B c")], ["doc_id", "text"])).collect()
    assert [(x["ngram"], x["positions"]) for x in r] == [("a b c", [0, 3])]


# sampling


def test_mix_semantics(spark):
    parts = {n: spark.range(100).withColumnRenamed("id", "k") for n in ("a", "b", "c")}
    assert sampling.mix(parts, {"a": sampling.Share(0.5), "b": sampling.Share(0.3), "c": sampling.Share(0.2)}, "k").count() == 100
    assert sampling.mix(parts, {"a": sampling.Share(0.7), "b": sampling.Share(0.4)}, "k").count() == 110
    assert sampling.mix(parts, {"a": sampling.Count(250)}, "k").groupBy("k").count().agg(F.min("count"), F.max("count")).first() == (2, 3)
    with pytest.raises(ValueError):
        sampling.amount(-1)
    with pytest.raises(ValueError):
        sampling.mix(parts, {"a": sampling.Share(0.5), "b": sampling.Count(3)}, "k")
    assert sampling.amount("1.0") == sampling.Share(1.0) and sampling.amount("1") == sampling.Count(1) and sampling.amount(1, loose=True) == sampling.Share(1.0)


def test_union_takes_the_first_schema(spark):
    a, b = spark.createDataFrame([(1, "x")], "k long, t string"), spark.createDataFrame([("2", 5)], "k string, z int")
    assert sorted(map(tuple, sampling.concatenate(a, b).collect()), key=str) == [(1, "x"), (2, None)]


def test_splits_and_batches_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = sampling.split(df, 0.2, "k")
    c, d = sampling.split(df.repartition(9), 0.2, "k")
    assert sorted(r[0] for r in b.collect()) == sorted(r[0] for r in d.collect()) and a.count() + b.count() == 1000
    one = sampling.epoch_batches(df, "k", 8, 42, 0, 0, 2)
    two = sampling.epoch_batches(df.repartition(5), "k", 8, 42, 0, 1, 2, exclude=spark.range(10).withColumnRenamed("id", "k"))
    assert one.groupBy("batch").count().where("count <> 8").count() == 0 and two.where("k < 10").count() == 0
    assert sampling.epoch_batches(df, "k", 8, 42, 1, 0, 2).exceptAll(one).count() > 0
    cap = sampling.running_cap(spark.createDataFrame([(1, 4), (2, 4), (3, 4)], ["k", "n"]), "n", 6, ["k"]).collect()
    assert [(r["k"], r["taken"]) for r in cap] == [(1, 4), (2, 2)]
    assert sampling.stratified(df.withColumn("s", F.when(F.col("k") < 500, "a").otherwise("b")), "s", {"a": 0.75, "b": 0.25}, 100, "k").groupBy("s").count().orderBy("s").collect() == [("a", 75), ("b", 25)]


# joins, contamination


def test_lookups(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], ["id", "x"])
    right = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (3, "z", 1)], ["id", "y", "n"])
    assert [tuple(r) for r in joins.overlay(left, right, "id", ["n"]).select("id", "x", "y").collect()] == [(1, "a", "new")]
    hit, miss = joins.cached(left, right.select("id", "y").dropDuplicates(["id"]), "id")
    assert hit.count() == 1 and [r["id"] for r in miss.collect()] == [2]
    a = chats(spark, [("user", "p"), ("assistant", "1")])
    assert joins.by_first_message(a, a.withColumn("tag", F.lit("t")).drop("id")).count() == 1
    packs = spark.createDataFrame([(0, [0, 1, 1, 0, 2])], "pack int, response_mask array<int>")
    adv = spark.createDataFrame([(1, 0.5), (2, -1.0)], ["seq", "advantage"])
    assert joins.advantages_into_packs(packs, adv).first()["advantages"] == [0.0, 0.5, 0.5, 0.0, -1.0]


def test_contamination(spark):
    train = spark.createDataFrame([(1, "The quick, brown fox jumps over it"), (2, "a lazy dog"), (3, "quick brown cats and a fox"), (4, None)], ["original_id", "text"])
    tests = spark.createDataFrame([(10, "quick brown fox", "over"), (11, "lazy dog", None), (12, "nothing here", "x")], ["q", "f", "g"])
    assert [tuple(r) for r in contamination.exact_match(train, tests, "q", ["f"]).orderBy("q").collect()] == [(10, 1), (11, 2)]
    assert [tuple(r) for r in contamination.exact_match(train, tests, "q", ["f", "g"]).collect()] == [(10, 1)]
    s = {(r["q"], r["original_id"]): r["score"] for r in contamination.ngram_scores(train, tests, "q", ["f"], 2).collect()}
    assert s[10, 1] == 1.0 and s[10, 3] == pytest.approx(2 / 3) and (12, 1) not in s
    scores = contamination.ngram_scores(train, tests, "q", ["f"], 2)
    kept, summary = contamination.decontaminate(train.withColumnRenamed("original_id", "id"), "id", contamination.contaminated(scores, 0.9))
    assert sorted(r["id"] for r in kept.collect()) == [3, 4] and summary.first()["removed"] == 2
    assert contamination.contaminated(scores, None).count() == 0
    assert contamination.mean_score(tests, scores, "q").first()["mean_score"] == pytest.approx(2 / 3)


# preferences and evaluation


def test_binarise_ties_and_margins(spark):
    df = spark.createDataFrame([("p", "a", 3, 1), ("p", "b", 3, 2), ("p", "c", 1, 3), ("p", "d", 1, 4), ("q", "x", 2, 5), ("q", "y", 2, 6), ("r", "z", 1, 7)], ["prompt", "response", "s", "o"])
    got = preferences.binarise(df, "prompt", "response", F.col("s").cast("double"), "o").collect()
    assert [(r["prompt"], r["chosen"][1]["content"], r["rejected"][1]["content"]) for r in got] == [("p", "a", "d")]
    assert preferences.binarise(df, "prompt", "response", F.col("s").cast("double"), "o", min_score=4).count() == 0
    pair = preferences.ranked_pair(df, "prompt", "response", "o", F.lit(True)).where("prompt = 'p'").first()
    assert pair["chosen"] != pair["rejected"]


def test_judges(spark):
    r = spark.createDataFrame([(1, "help", "5, 3"), (1, "truth", "4, x"), (2, "help", "1,2"), (2, "truth", "1,4")], ["id", "aspect", "rating"])
    got = {x["id"]: (x["chosen"], x["rejected"], x["scores"]) for x in preferences.judge_pairs(r, "id", "aspect", "rating", ["A", "B"]).collect()}
    assert got == {1: ("A", "B", [4.5, 1.0]), 2: ("B", "A", [1.0, 3.0])}
    v = spark.createDataFrame([("f", "s", "preferred: 1"), ("f", "s", "Preferred: 0"), ("f", "s", "?")], ["first", "second", "t"])
    assert [x["chosen"] for x in preferences.judged_pairs(v, "t").collect()] == ["s", "f"]
    d = spark.createDataFrame([("Explanation: too short\nDecision: No",)], ["t"]).select(preferences.parse_judgement("t").alias("d")).first()["d"]
    assert (d["explanation"], d["decision"]) == ("too short", "no")


def test_votes(spark):
    df = spark.createDataFrame([(1, ["a", None, "b", "b", None]), (2, ["a", "b"]), (3, []), (4, None)], "id int, s array<string>")
    same = lambda a, b: a == b
    got = df.select("id", evaluation.vote("s", 5).alias("v"), evaluation.consensus_at("s", F.lit("a"), 5, same).alias("c"), evaluation.pass_at("s", F.lit("b"), 2, same).alias("p")).collect()
    assert [(r["v"], r["c"], r["p"]) for r in got] == [(None, False, False), ("a", True, True), (None, False, False), (None, False, False)]
    raw = spark.createDataFrame([(1, 0, "1.0", "1"), (1, 1, "1", "1"), (1, 2, "2", "2"), (1, 3, None, None)], "id int, o int, raw string, form string")
    assert tuple(evaluation.raw_vote(raw, "id", "o", "raw", "form").first()) == (1, "1", 2)


def test_traces(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0], ["x", "y"], ["stop"]), (2, [0.0], ["z"], ["length"])], "training_step int, scores array<double>, responses array<string>, finish_reasons array<string>")
    flat = evaluation.explode_trace(t)
    assert flat.count() == 3 and flat.where("finish_reasons is null").count() == 1
    assert evaluation.trace_overall(flat).first()["solve_rate"] == 0.25
    assert evaluation.filter_traces(t, at_least=1.0).count() == 1
    assert [len(r["scores"]) for r in evaluation.filter_traces(t, most_samples=1).collect()] == [1]
    assert evaluation.score_summary(flat, perfect=1.0).first()["perfect"] == 1


# rewards


def test_weighted_rewards_and_composition(spark):
    df = spark.createDataFrame([(1, "the answer 5", ["5", "x"], ["GSM8K", "none"]), (2, "6", ["5"], ["gsm8k"]), (3, "a", [], [])], "id int, prediction string, ground_truth array<string>, dataset array<string>")
    got = {r["id"]: (r["reward"], r["by_verifier"]) for r in rewards.weighted_rewards(df, "id", weights={"gsm8k": 2.0}, scale=10.0).collect()}
    assert got == {1: (20.0, {"gsm8k": 20.0}), 2: (0.0, {"gsm8k": 0.0}), 3: (0.0, {})}
    bad = spark.createDataFrame([(1, "p", ["5"], [])], df.schema)
    with pytest.raises(Exception, match="differ in number"):
        rewards.weighted_rewards(bad, "id").collect()
    f = spark.createDataFrame([("b", "<python>x</python> <result>1</result>"), ("b", "<python>x</python>"), ("c", "<result>1</result>"), ("c", "none")], ["batch", "response"])
    assert [r["format_reward"] for r in rewards.format_reward(f, "batch").orderBy("batch", F.desc("response")).collect()] == [0.0, 1.0, 0.0, 0.5] or sorted(r["format_reward"] for r in rewards.format_reward(f, "batch").collect()) == [0.0, 0.0, 0.5, 1.0]
    v = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert v(rewards.compose(F.lit(1.0), F.lit(0.5), additive=False)) == 0.0 and v(rewards.compose(F.lit(1.0), F.lit(0.5))) == 1.5
    assert v(rewards.compose(F.lit(1.0), finish=F.lit("length"), penalty=-1.0)) == -1.0


def test_instruction_scores(spark):
    label = json.dumps([{"instruction_id": ["punctuation:no_comma", "length_constraints:number_words"], "kwargs": [None, {"num_words": 3, "relation": "at least", "other": None}]}])
    rows = [(1, "a b c", label), (2, "a, b", label), (3, "x", json.dumps({"instruction_id": [], "kwargs": []})), (4, "x", json.dumps({"instruction_id": ["none:such"], "kwargs": [{}]}))]
    got = rewards.instruction_scores(spark.createDataFrame(rows, ["id", "t", "l"]), "id", "t", "l")
    assert {r["id"]: r["score"] for r in got.collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}


# sequences


def test_pack(spark):
    df = spark.createDataFrame([(0, 0, [1, 2, 3], [10, 11, 12]), (0, 1, [4, 5], [20, 21]), (1, 0, [1] * 9, [2])], "s long, o int, q array<int>, r array<int>")
    got = {(p["shard"], p["pack"]): p for p in packing.pack(df, "s", "o", "q", "r", 8).collect()}
    assert got[0, 0]["ids"] == [1, 2, 3, 10, 11, 12] and got[0, 1]["ids"] == [4, 5, 20, 21]
    assert got[0, 0]["response_mask"] == [0, 0, 0, 1, 1, 1] and got[0, 1]["dones"] == [0, 0, 0, 2] and got[0, 1]["sequence"] == [1] * 4
    assert got[1, 0]["ids"] == [] and len(got[1, 1]["ids"]) == 10


def plain_gae(values, rewards_, gamma, lam, dones=None, mask=None):
    out, last, nxt = [], 0.0, 0.0
    for t in reversed(range(len(values))):
        go = (1 - min(1, dones[t])) * min(1, mask[t]) if dones else 1.0
        delta = rewards_[t] + gamma * nxt * go - values[t]
        last = delta + gamma * lam * last * go
        nxt = values[t]
        out.append(last)
    return out[::-1]


def test_gae_packed_equals_unpacked(spark):
    rng = random.Random(1)
    seqs = [[rng.random() for _ in range(n)] for n in (3, 5, 2)]
    rews = [[0.0] * (len(s) - 1) + [1.0] for s in seqs]
    flat_v, flat_r = sum(seqs, []), sum(rews, [])
    dones = sum([[0] * (len(s) - 1) + [i + 1] for i, s in enumerate(seqs)], [])
    mask = sum([[i + 1] * len(s) for i, s in enumerate(seqs)], [])
    df = spark.createDataFrame([(flat_v, flat_r, dones, mask)], "v array<double>, r array<double>, d array<int>, m array<int>")
    got = df.select(packing.gae("v", "r", 0.9, 0.8, "d", "m").alias("g")).first()["g"]["advantages"]
    assert got == pytest.approx(sum([plain_gae(s, r, 0.9, 0.8) for s, r in zip(seqs, rews)], []))
    assert got == pytest.approx(plain_gae(flat_v, flat_r, 0.9, 0.8, dones, mask))


def plain_split(turns, most):
    turns, out, start, used = turns[: len(turns) // 2 * 2], [], 0, 0
    for i in range(0, len(turns), 2):
        n = len(turns[i].split()) + len(turns[i + 1].split()) + 12
        if used + n > most:
            out.append((start, i))
            start, used = (i + 2 if n > most else i), 0
        elif i == len(turns) - 2:
            out.append((start, i + 2))
        used += n
    return [turns[a:b] for a, b in out]


def test_split_conversation_against_plain_code(spark):
    rng = random.Random(5)
    data = [(i, [" ".join("w" * rng.randint(1, 12)) for _ in range(rng.randint(0, 9))]) for i in range(60)]
    df = spark.createDataFrame(data, "k int, t array<string>")
    got = packing.split_conversation(df, "k", "t", 30, lambda t: F.size(text.words(t)))
    by = {}
    for r in got.collect():
        by.setdefault(int(r["k"].split("_")[0]), []).append(r["t"])
    want = {i: plain_split(t, 30) for i, t in data}
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items() if v}


def test_blocks_lay_tokens_end_to_end(spark):
    docs = [(i, list(range(i * 100, i * 100 + n))) for i, n in enumerate([5, 0, 17, 3, 9])]
    df = spark.createDataFrame(docs, "k int, ids array<int>").withColumn("mask", F.transform("ids", lambda x: (x < 100).cast("int")))
    flat = sum([d for _, d in docs], [])
    got = packing.blocks(df, "k", "ids", 8).orderBy("block").collect()
    assert [r["input_ids"] for r in got] == [flat[i : i + 8] for i in range(0, len(flat) // 8 * 8, 8)]
    assert packing.blocks(df, "k", "ids", 8, mask="mask").count() == 1
    assert packing.blocks(df, "k", "ids", 8, eos=-1).count() == (len(flat) + 5) // 8


def test_tokenization_masks(spark):
    df = chats(spark, [("user", "a b"), ("assistant", "c"), ("user", "d"), ("assistant", "e f")])
    r = packing.tokenize(df).first()
    assert len(r["input_ids"]) == len(r["labels"]) == len(r["attention_mask"])
    learned = [x for x in r["labels"] if x != -100]
    assert 0 < len(learned) < len(r["labels"]) and all(a == b for a, b in zip(r["input_ids"], r["labels"]) if b != -100)
    last = packing.tokenize(df, train_on="last_assistant").first()
    assert len([x for x in last["labels"] if x != -100]) < len(learned)
    assert len(packing.tokenize(df, most=5).first()["input_ids"]) == 5
    pair = packing.tokenize_pairs(df.select(F.col("messages").alias("chosen"), F.col("messages").alias("rejected")), prompt=True).first()
    assert pair["chosen_input_ids"] == r["input_ids"] and len(pair["input_ids_prompt"]) < len(r["input_ids"])


def test_array_helpers(spark):
    v = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    arr = lambda *x: F.array(*[F.lit(i) for i in x])
    assert v(packing.pad(arr(1, 2), 4)) == [1, 2, 0, 0] and v(packing.without_padding(arr(0, 1, 0, 2))) == [1, 2]
    assert v(packing.until_stop(arr(1, 9, 2, 9), 9, 0)) == [1, 9, 0, 0] and v(packing.position_ids(arr(1, 1, 2, 2, 2))) == [0, 1, 0, 1, 2]
    assert tuple(v(packing.clip_tool_output(arr(1, 2, 3, 4), 3, 2))) == ([1, 2], 1)
    f = packing.flatten_batch(spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [3])], "b int, o int, x array<int>"), "b", "o", "x").first()
    assert (f["input_ids"], f["seq_idx"], f["position_ids"], f["cu_seq_lens"]) == ([1, 2, 3], [0, 0, 1], [0, 1, 0], [0, 2, 3])
    size = lambda c: F.size(text.words(c))
    kept = chats(spark, [("system", "s s"), ("user", "a a a"), ("assistant", "b b"), ("user", "c")]).select(packing.fit_context("messages", 5, size).alias("k"), packing.fit_context("messages", 5, size, compat=True).alias("c")).first()
    assert [m["content"] for m in kept["k"]] == ["s s", "b b", "c"] and [m["content"] for m in kept["c"]] == ["s s", "c"]


def test_reply_paths(spark):
    rows = [("r", None, "prompter", "q", False, 1.0), ("a", "r", "assistant", "x", False, 0.0), ("b", "r", "assistant", "y", False, 1.0), ("c", "b", "prompter", "z", False, 0.0), ("d", "a", "prompter", "gone", True, 0.0), ("e", "c", "assistant", "w", False, 0.0)]
    df = spark.createDataFrame(rows, "message_id string, parent_id string, role string, text string, deleted boolean, quality double")
    got = [[m["content"] for m in r["path"]] for r in trees.reply_paths(df).collect()]
    assert got == [["q", "y", "z", "w"]]  # a's only reply is deleted: it gives no path
    assert trees.reply_paths(df, top_k=1).first()["quality"] == 0.5


def test_statistics(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 10.0), (4, 1.0)], ["k", "n"])
    r = statistics.describe(df, ["n"]).first()
    assert (r["q50"], r["min"], r["max"]) == (2.5, 1.0, 10.0)
    assert sum(x["n"] for x in statistics.equal_bins(df, "n").collect()) == 4
    assert statistics.edges("fixed", 0, 4500)[-1] == 6000 and len(statistics.edges("log", 1, 100)) == 26


# plans and streams


def test_registry_and_cache(spark, tmp_path):
    spark.createDataFrame([(i, "q" * (i % 3 + 1), "a") for i in range(10)], ["id", "prompt", "completion"]).write.json(str(tmp_path / "d" / "train"))
    steps = (("to_messages", {}), ("sft_tokenize_truncate", {"most": 64}), ("sft_filter", {"most": 64}))
    m = registry.Mixture((registry.Dataset(f"{tmp_path}/d/train/*.json", "0.5", steps=steps),), columns=("input_ids", "labels"))
    rows = registry.build_cached(spark, m, str(tmp_path / "cache"))
    assert rows.count() == 5 and set(rows.columns) == {"input_ids", "labels", "dataset_source", "messages"}
    assert registry.build_cached(spark, m, str(tmp_path / "cache")).count() == 5
    other = registry.Mixture((registry.Dataset("x", "0.6", steps=steps),))
    assert m.digest() != other.digest() and registry.parse_mixture(["a", "0.5", "b", "10"]).datasets[1].share == "10"


def test_stream_of_rollouts(spark, tmp_path):
    rows = [("p", 1.0, "stop", 1), ("p", 0.0, "stop", 0), ("p", 0.5, "length", 0), ("q", 1.0, "stop", 1), ("q", 1.0, "stop", 1)]
    schema = "prompt string, reward double, finish_reason string, ok int"
    spark.createDataFrame(rows, schema).write.json(str(tmp_path / "in"))
    stream = readers.stream(spark, str(tmp_path / "in" / "*.json"), schema)
    seen = []
    q = rollouts.write_batches(stream, lambda df, n: seen.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted((r["prompt"], r["reward"]) for r in seen) == [("p", 0.0), ("p", 1.0)]
    out = rollouts.solved_prompts(stream, "prompt", "ok", 2, 0.9)
    q = out.writeStream.outputMode("update").format("memory").queryName("solved").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert {r["prompt"]: r["excluded"] for r in spark.table("solved").collect()} == {"p": False, "q": True}


def test_blocks_of_templates_and_constraints(spark):
    people = spark.createDataFrame([(1, "a cook"), (2, "a judge")], "id long, persona string")
    texts = spark.createDataFrame([(f"as {{persona}}, write {i}",) for i in range(7)] + [(None,)], "template string")
    got = convert.persona_prompts(people, texts, block=2).collect()
    assert sorted(r["prompt"] or "" for r in got) == sorted([f"as {p}, write {i}" for p in ("a cook", "a judge") for i in range(7)] + ["", ""])
    assert convert.persona_prompts(people, texts.limit(0)).count() == 0
    label = lambda n: f'{{"instruction_id": ["length_constraints:number_words", "nothing:known"], "kwargs": [{{"relation": "at least", "num_words": {n}}}, null]}}'
    rows = spark.createDataFrame([(n, "one two three", label(n)) for n in range(1, 8)] + [(9, "x", None)], "k long, t string, l string")
    for most in (1, 3, 500):
        got = {r["k"]: r["score"] for r in rewards.instruction_scores(rows, "k", "t", "l", most).collect()}
        assert got == {n: 0.5 if n <= 3 else 0.0 for n in range(1, 8)} | {9: 0.0}


def test_workbooks_with_shared_strings_and_gaps(spark, tmp_path):
    import zipfile

    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    for name in ("a.xlsx", "b.xlsx"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Two" sheetId="2" r:id="r2"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>name</t></si><si><r><t>Acme </t></r><r><t>&amp; Co</t></r></si></sst>')
            z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>3.5</v></c></row><row r="3"><c r="B3"><v>7</v></c></row></sheetData></worksheet>')
            z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row></sheetData></worksheet>')
    df = readers.read_workbook(spark, f"{tmp_path}/*.xlsx")
    assert df.columns == ["name", "column_1", "n"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("Acme & Co", None, "3.5"), (None, "7", None)] * 2, key=str)
    assert readers.read_workbook(spark, str(tmp_path / "a.xlsx"), "Two").count() == 0
    path = f"{tmp_path}/out.xlsx"
    sinks.write_workbook(spark.range(30).selectExpr("id", "case when id % 2 = 0 then '<a> & b' end as t"), path)
    assert sorted((int(r["id"]), r["t"]) for r in readers.read_workbook(spark, path).collect()) == [(i, "<a> & b" if i % 2 == 0 else None) for i in range(30)]
    with pytest.raises(ValueError):
        sinks.write_workbook(spark.range(5), path, most=4)


def test_chunks_of_tokens_keep_every_byte(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, [rng.randrange(70_000) for _ in range(rng.choice([0, 1, 5, 40]))]) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, ids array<int>")
    sinks.write_chunks(df, "doc_id", "ids", str(tmp_path / "c"), 16, largest=70_000)
    got = sorted((r["chunk"], r["kind"], bytes(r["data"])) for r in spark.read.parquet(str(tmp_path / "c/tokens")).collect())
    flat = [t for _, ids in docs for t in ids]
    assert [k for _, k, _ in got] == ["uint32"] * -(-len(flat) // 16)
    assert b"".join(d for _, _, d in got) == b"".join(t.to_bytes(4, "little") for t in flat)
    at = spark.read.option("header", True).schema("chunk long, doc_id long, start long, stop long").csv(str(tmp_path / "c/boundaries")).collect()
    back = {}
    for r in sorted(at, key=lambda r: (r["doc_id"], r["chunk"])):
        data = got[r["chunk"]][2]
        back.setdefault(r["doc_id"], []).extend(int.from_bytes(data[4 * i : 4 * i + 4], "little") for i in range(r["start"], r["stop"]))
    assert back == {i: ids for i, ids in docs if ids}
