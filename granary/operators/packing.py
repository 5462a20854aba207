"""Token sequences: chat tokenization with loss masks, truncation, packing, chunking, splitting, recurrences.

The tokenizer is a parameter: a function from a text Column to a Column of token ids. The default is the library's own.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import col, let, token_ids
from ..schema import MASKED

Tokenizer = Callable[[Column], Column]


def message_ids(messages, tokenizer: Tokenizer = token_ids, render=None) -> Column:
    """(role, ids) of each message; ``render`` gives a message's text, role marks included."""
    text = render or (lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), F.coalesce(m["content"], F.lit("")), F.lit("\n")))
    return F.transform(col(messages), lambda m: F.struct(m["role"].alias("role"), tokenizer(text(m)).alias("ids")))


def _joined(parts: Column, most: int | None) -> Column:
    flat = F.flatten(F.transform(parts, lambda p: p["ids"]))
    return flat if most is None else F.slice(flat, 1, most)


def _labels(parts: Column, learn, most: int | None) -> Column:
    flat = F.flatten(F.transform(parts, lambda p, i: F.when(learn(p, i), p["ids"]).otherwise(F.array_repeat(F.lit(MASKED), F.size(p["ids"])))))
    return flat if most is None else F.slice(flat, 1, most)


def tokenize(df: DataFrame, messages: str = "messages", train_on: str = "assistant", most: int | None = None, tokenizer: Tokenizer = token_ids, render=None) -> DataFrame:
    """input_ids, attention_mask and labels of whole conversations, cut at ``most`` tokens.

    ``train_on``: all tokens, those of the assistant, those of the last message ("last"), or of the assistant's last ("last_assistant").
    """
    last = lambda parts: F.size(parts) - 1
    rules = {
        "all": lambda parts: lambda p, i: F.lit(True),
        "assistant": lambda parts: lambda p, i: p["role"] == "assistant",
        "last": lambda parts: lambda p, i: i == last(parts),
        "last_assistant": lambda parts: lambda p, i: (p["role"] == "assistant") & (i == last(parts)),
    }
    rows = df.withColumn("_parts", message_ids(messages, tokenizer, render))
    parts = F.col("_parts")
    rows = rows.withColumn("input_ids", _joined(parts, most)).withColumn("labels", _labels(parts, rules[train_on](parts), most))
    return rows.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))).drop("_parts")


def tokenize_pairs(df: DataFrame, most: int | None = None, tokenizer: Tokenizer = token_ids, render=None, train_on: str = "last", prompt: bool = False) -> DataFrame:
    """The six columns of a preference pair, and the prompt's two if asked."""
    for side in ("chosen", "rejected"):
        df = tokenize(df, side, train_on, most, tokenizer, render).withColumnsRenamed({c: f"{side}_{c}" for c in ("input_ids", "labels", "attention_mask")})
    if prompt:
        df = df.withColumn("input_ids_prompt", _joined(F.slice(message_ids("chosen", tokenizer, render), 1, F.size("chosen") - 1), most)).withColumn("attention_mask_prompt", F.array_repeat(F.lit(1), F.size("input_ids_prompt")))
    return df


def tokenize_prompt(df: DataFrame, messages: str = "messages", tokenizer: Tokenizer = token_ids, render=None) -> DataFrame:
    """input_ids_prompt of the messages without the last answer, and prompt, the ``role: content`` lines."""
    from .convert import flatten_prompt, without_last_answer

    prompt = without_last_answer(messages)
    return df.withColumn("input_ids_prompt", _joined(message_ids(prompt, tokenizer, render), None)).withColumn("attention_mask_prompt", F.array_repeat(F.lit(1), F.size("input_ids_prompt"))).withColumn("prompt", flatten_prompt(prompt))


def pad(ids, size: int, value: int = 0) -> Column:
    """Filled on the right to a size; longer arrays stay."""
    return F.concat(col(ids), F.array_repeat(F.lit(value), F.greatest(F.lit(0), size - F.size(col(ids)))))


def without_padding(ids, value: int = 0) -> Column:
    return F.array_remove(col(ids), value)


def until_stop(ids, stop: int, fill: int) -> Column:
    """Tokens after the first stop become ``fill``."""
    at = F.array_position(col(ids), stop)
    return F.transform(col(ids), lambda t, i: F.when((at > 0) & (i >= at), fill).otherwise(t))


def blocks(docs: DataFrame, key: str, ids: str, size: int, mask: str | None = None, eos: int | None = None) -> DataFrame:
    """(block, input_ids[, loss_mask]): all tokens laid end to end by key and cut into blocks of ``size``.

    The remainder is dropped, and so are blocks whose mask is 0 throughout. Documents are placed by running sums over
    ranges of keys; only a block's own pieces meet in one group.
    """
    from ..sources.sinks import chunk_boundaries, materialize

    # written, as sizes and tokens are read apart: nothing is tokenized twice
    full = materialize(docs.select(key, (F.concat(ids, F.array(F.lit(eos))) if eos is not None else F.col(ids)).alias("ids"), *([F.col(mask).alias("mask")] if mask else [])).withColumn("n", F.size("ids")), "tokens")
    at = chunk_boundaries(full, key, "n", size).withColumnRenamed("start", "s").withColumnRenamed("end", "e")
    order = Window.partitionBy(key).orderBy("chunk")
    taken = at.withColumn("done", F.coalesce(F.sum(F.col("e") - F.col("s")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cut = lambda c: F.slice(c, (F.col("done") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int"))
    pieces = taken.join(full, key).select("chunk", "s", cut(F.col("ids")).alias("ids"), *([cut(F.col("mask")).alias("mask")] if mask else []))
    whole = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("s", c))), lambda x: x[c]))
    out = pieces.groupBy("chunk").agg(whole("ids").alias("input_ids"), *([whole("mask").alias("loss_mask")] if mask else [])).where(F.size("input_ids") == size)
    if mask:
        out = out.where(F.exists("loss_mask", lambda m: m == 1))
    return out.withColumnRenamed("chunk", "block")


PACK = "shard long, pack int, ids array<int>, sequence array<int>, response_mask array<int>, position_ids array<int>, dones array<int>, n_actions array<int>"


def pack(df: DataFrame, shard: str, order: str, query: str, response: str, length: int, padding: int = 0) -> DataFrame:
    """Next-fit packing of query and response within each shard, in order: a pack closes when the next sequence does not fit.

    A first sequence longer than ``length`` closes an empty pack. Sequences are numbered from 1 in their shard;
    ``sequence`` counts within the pack, ``response_mask`` and ``dones`` carry the number. Order decides the packs, so a
    shard is one group, streamed; choose shards of a bounded size.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("o").to_pylist(), table.column("q").to_pylist(), table.column("r").to_pylist()))
        out, shard_ = {n: [] for n in PACKED.names}, table.column("s")[0].as_py()
        held: list[tuple[int, list, list]] = []

        def close() -> None:
            ids, seq, mask, pos, dones, actions = [], [], [], [], [], []
            for k, (i, q, r) in enumerate(held, 1):
                n = len(q) + len(r)
                ids += q + r
                seq += [k] * n
                mask += [0] * len(q) + [i] * len(r)
                pos += range(n)
                dones += [0] * (n - 1) + [i]
                actions.append(len(r))
            for name, value in zip(PACKED.names, (shard_, len(out["pack"]), ids, seq, mask, pos, dones, actions)):
                out[name].append(value)
            held.clear()

        used = 0
        for i, (_, q, r) in enumerate(rows, 1):
            q, r = [t for t in q if t != padding], [t for t in r if t != padding]
            if used + len(q) + len(r) > length:
                close()
                used = 0
            held.append((i, q, r))
            used += len(q) + len(r)
        if held:
            close()
        return pa.table(out, schema=PACKED)

    small = df.select(F.col(shard).cast("long").alias("s"), F.col(order).alias("o"), F.col(query).alias("q"), F.col(response).alias("r"))
    return small.groupBy("s").applyInArrow(run, PACK)


_INTS = pa.list_(pa.int32())
PACKED = pa.schema([("shard", pa.int64()), ("pack", pa.int32()), *[(c, _INTS) for c in ("ids", "sequence", "response_mask", "position_ids", "dones", "n_actions")]])


def position_ids(sequence) -> Column:
    """0, 1, 2, ... anew at every change of the sequence number."""
    step = lambda a, s: F.struct(F.concat(a["out"], F.array(F.when(a["last"].eqNullSafe(s), F.element_at(a["out"], -1) + 1).otherwise(0))).alias("out"), s.alias("last"))
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(None).cast("int").alias("last"))
    return F.aggregate(col(sequence), start, lambda a, s: F.when(F.size(a["out"]) == 0, F.struct(F.array(F.lit(0)).alias("out"), s.alias("last"))).otherwise(step(a, s)), lambda a: a["out"])


def flatten_batch(df: DataFrame, batch: str, order: str, ids: str) -> DataFrame:
    """(batch, input_ids, seq_idx, position_ids, cu_seq_lens) without padding."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ids).alias("x"))))
    parts = df.groupBy(batch).agg(F.transform(rows, lambda r: r["x"]).alias("p"))
    ends = F.aggregate(F.transform("p", lambda x: F.size(x)), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    return parts.select(
        batch,
        F.flatten("p").alias("input_ids"),
        F.flatten(F.transform("p", lambda x, i: F.array_repeat(i, F.size(x)))).alias("seq_idx"),
        F.flatten(F.transform("p", lambda x: F.transform(x, lambda _, i: i))).alias("position_ids"),
        ends.alias("cu_seq_lens"),
    )


def split_conversation(df: DataFrame, key: str, turns: str, most: int, size, extra: int = 6) -> DataFrame:
    """(key_start, turns): a conversation cut in steps of two turns into parts of at most ``most`` tokens.

    Each turn counts its tokens plus ``extra``. A pair that is too long alone is left out, yet still counts for the part
    after it; a last pair that does not fit is lost, as the budget rule has it. ``size`` measures a turn's text.
    """
    even = F.slice(turns, 1, (F.size(turns) - F.size(turns) % 2).cast("int"))
    rows = df.select(F.col(key).cast("string").alias("k"), even.alias("t")).where(F.size("t") >= 2)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("t") / 2).cast("int") - 1), lambda i: size(F.element_at("t", 2 * i + 1)) + size(F.element_at("t", 2 * i + 2)) + 2 * extra)
    last = F.size(F.col("t")) - 2
    part = lambda s, e: F.array(F.struct(s.alias("s"), e.alias("e")))

    def step(a: Column, x: Column) -> Column:
        i, n = x["i"] * 2, x["n"]
        over, end = a["len"] + n > most, i == last
        return F.struct(
            F.when(over, F.when(n > most, i + 2).otherwise(i)).otherwise(a["start"]).alias("start"),
            (F.when(over, 0).otherwise(a["len"]) + n).alias("len"),
            F.when(over, F.concat(a["out"], part(a["start"], i))).when(end, F.concat(a["out"], part(a["start"], i + 2))).otherwise(a["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("start"), F.lit(0).alias("len"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))
    walked = F.aggregate(F.transform(pairs, lambda n, i: F.struct(n.alias("n"), i.alias("i"))), start, step, lambda a: a["out"])
    cut = rows.select("k", "t", F.explode(walked).alias("p"))
    return cut.select(F.concat_ws("_", "k", F.col("p.s").cast("string")).alias(key), F.slice("t", F.col("p.s") + 1, F.col("p.e") - F.col("p.s")).alias(turns))


def fit_context(messages, most: int, size, compat: bool = False) -> Column:
    """Messages that fit a budget: the system message stays, the last ones are kept while they fit.

    ``compat``: the system message is charged twice, once to the budget and once to what is used.
    """

    def fitted(m: Column) -> Column:
        system = F.filter(m, lambda x, i: (i == 0) & (x["role"] == "system"))
        rest = F.filter(m, lambda x, i: ~((i == 0) & (x["role"] == "system")))
        cost = F.aggregate(system, F.lit(0), lambda a, x: a + size(x["content"]))
        step = lambda a, x: F.when(a["full"] | (a["used"] + size(x["content"]) > most), F.struct(a["used"].alias("used"), F.lit(True).alias("full"), a["n"].alias("n"))).otherwise(F.struct((a["used"] + size(x["content"])).alias("used"), F.lit(False).alias("full"), (a["n"] + 1).alias("n")))
        start = F.struct((cost * (2 if compat else 1)).alias("used"), F.lit(False).alias("full"), F.lit(0).alias("n"))
        kept = F.aggregate(F.reverse(rest), start, step, lambda a: a["n"])
        return let(kept, lambda n: F.concat(system, F.reverse(F.slice(F.reverse(rest), 1, n))))

    return let(col(messages), fitted)


def clip_tool_output(ids, model_room: int, response_room: int) -> Column:
    """(tokens, excess): what fits both the model's and the response's remaining room, and how many did not fit the model."""
    n = F.size(col(ids))
    excess = F.greatest(F.lit(0), n - model_room)
    return F.struct(F.slice(col(ids), 1, F.greatest(F.lit(0), F.least(n - excess, F.lit(response_room)))).alias("tokens"), excess.alias("excess"))


def gae(values, rewards, gamma: float, lam: float, dones=None, mask=None) -> Column:
    """(advantages, returns) by the backward recurrence; with ``dones`` and ``mask`` it restarts at ends and queries of packs."""
    flags = lambda c, n: F.transform(col(c), lambda x: F.least(x.cast("double"), F.lit(1.0))) if c is not None else F.array_repeat(F.lit(n), F.size(col(values)))
    rows = F.arrays_zip(col(values).alias("v"), col(rewards).alias("r"), flags(dones, 0.0).alias("d"), flags(mask, 1.0).alias("m"))

    def step(a: Column, x: Column) -> Column:
        go = (1 - x["d"]) * x["m"]
        adv = x["r"].cast("double") + gamma * a["next"] * go - x["v"].cast("double") + gamma * lam * a["last"] * go
        return F.struct(adv.alias("last"), x["v"].cast("double").alias("next"), F.concat(F.array(adv), a["out"]).alias("out"))

    start = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("next"), F.array().cast("array<double>").alias("out"))
    adv = F.aggregate(F.reverse(rows), start, step, lambda a: a["out"])
    return let(adv, lambda a: F.struct(a.alias("advantages"), F.zip_with(a, col(values), lambda x, v: x + v.cast("double")).alias("returns")))
