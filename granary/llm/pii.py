"""Personal data: base patterns, and identifiers found from their contexts by bootstrapping.

Base spans come from four patterns with checks. Their tokens, and hexadecimal keys, are the seeds of a pattern-instance
graph: an instance is a token with a digit, a pattern the word or the two words before it with the token's shape. A
pattern's confidence is the smoothed share
of its occurrences that are believed; an instance is believed by the noisy-or of its patterns, seeds always. Scores run
for a few rounds over the graph's edges, which are counted once; patterns that enough different seeds support and that
score high discover the instances that no base pattern sees.

Everything is DataFrame functions: no Python runs on the executors. Texts are read once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Fixed patterns of the contract, leftmost and non-overlapping; possessive and anchored where that changes no match,
#: so that no text makes them quadratic. A run of digits counts as a card with 13 to 19 of them only.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "key", "id")
#: Seeds beside the base spans, kind key: hexadecimal strings of the lengths of digests and access keys.
KEY = r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])(?=[0-9]*[a-f])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})(?![A-Za-z0-9])"
#: A whitespace-delimited token with a digit.
TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
SPAN = "array<struct<s:int,e:int,m:string,left:array<string>>>"
#: Rounds of scoring; what a pattern needs: distinct seeds, confidence; what an instance needs.
ROUNDS, SEEDS, SURE = 3, 4, 0.9


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def running(x: Column, reach: int = 1) -> Column:
    """The running sums of an array: each pass adds the value ``reach`` places before, and ``reach`` doubles."""

    def level(a: Column) -> Column:
        added = F.transform(a, lambda v, i: v + F.coalesce(F.get(a, i - reach), F.lit(0)))
        return F.when(F.size(a) <= reach, a).otherwise(running(added, 2 * reach) if reach < 1 << 30 else added)

    return let(x, level)


def context(before: Column, gap: Column) -> Column:
    """The last two words, in lower case, of what lies between a token and the one before, whose shape counts as a word."""
    near = F.when(F.length(gap) < 60, F.concat(F.lit("<"), shape(before), F.lit("> "), gap)).otherwise(F.right(gap, F.lit(60)))
    words = F.split(F.trim(F.regexp_replace(F.lower(near), r"\s+", " ")), " ")
    return F.transform(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)), lambda w: F.right(w, F.lit(24)))


def matches(text: Column, pattern: str, keep=None, left: bool = False) -> Column:
    """Start, end (code points) and text of all matches, those that ``keep`` accepts; ``left``: with the words before.

    Linear but for the running sums of the lengths, which take a pass for each doubling of the number of matches.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def spans(p: Column) -> Column:
        def span(ends: Column) -> Column:
            words = lambda i: context(F.coalesce(F.get(p["m"], i - 1), F.lit("")), F.get(p["g"], i)) if left else F.lit(None).cast("array<string>")
            return F.transform(p["m"], lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("s"), F.get(ends, i).alias("e"), m.alias("m"), words(i).alias("left")))

        lengths = F.transform(p["m"], lambda m, i: F.length(F.get(p["g"], i)) + F.length(m))
        return F.when(F.size(p["m"]) == 0, F.array().cast(SPAN)).otherwise(let(running(lengths), span))

    found = let(parts, spans)
    return F.filter(found, lambda x: keep(x["m"])) if keep else found


def some(text: Column, hint: str, pattern: str, keep=None, left: bool = False) -> Column:
    """``matches`` of texts that have what every match has, which is looked for first."""
    return F.when(text.rlike(hint), matches(text, pattern, keep, left)).otherwise(F.array().cast(SPAN))


def shape(token: Column) -> Column:
    """Runs of letters as a, of digits as 9; strings of letters and digits that change over and over by their length."""
    plain = F.regexp_replace(F.regexp_replace(token, r"[0-9]+", "9"), r"\p{L}+", "a")
    return F.when(plain.rlike("^(?:9?a9a9a|9a9a9)[9a]*$"), F.concat(F.lit("x"), F.length(token).cast("string"))).otherwise(F.left(plain, F.lit(40)))


def luhn(digits: Column) -> Column:
    """Whether the digits' check sum, every second one from the right doubled, ends in 0."""
    reversed_ = F.split(F.reverse(digits), "")
    doubled = F.transform(reversed_, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)).cast("int"))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def base(text: Column) -> dict[str, Column]:
    """The base spans of a text by kind."""
    plain = lambda m: F.regexp_replace(m, r"^0+(?=.)", "")
    low = lambda m: F.forall(F.split(m, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.substring(plain(p), 1, 3).cast("int") <= 255))
    digits = lambda m: F.regexp_replace(m, r"[^0-9]", "")
    return {
        "email": some(text, "@", EMAIL),
        "ip": some(text, r"[0-9]\.[0-9]++\.[0-9]", IP, low),
        "card": some(text, r"[0-9](?:[\x20-]?[0-9]){12}", CARD, lambda m: luhn(digits(m))),
        "phone": some(text, r"\+[0-9]", PHONE, lambda m: F.length(digits(m)).between(9, 15)),
    }


def listed(spans: Column) -> Column:
    """kind:start:end of (k, s, e) spans, by kind and start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def discover(tokens: DataFrame, rounds: int = ROUNDS, seeds: int = SEEDS, sure: float = SURE) -> DataFrame:
    """The distinct (left, shape, core) of tokens that are no seeds and that sure patterns find.

    ``tokens``: left, shape, core, seed, a row for each width of the context. A pattern is a context with a shape; edges
    to its instances are counted once and joined in every round, occurrences are not.
    """
    edges = tokens.groupBy("left", "shape", "core").agg(F.count("*").alias("n"), F.max(F.col("seed").cast("int")).alias("seed"))
    edges = materialize(edges, "edges")
    scored = edges.withColumn("belief", F.col("seed").cast("double"))
    for _ in range(rounds):
        patterns = scored.groupBy("left", "shape").agg(F.sum(F.col("n") * F.col("belief")).alias("good"), F.sum("n").alias("all"), F.sum("seed").alias("seeds"))
        patterns = patterns.where(F.col("seeds") >= seeds).select("left", "shape", (F.col("good") / (F.col("all") + 1)).alias("conf"))
        # written, so that the planner knows how few they are and hot contexts need not meet in one task
        doubt = edges.join(materialize(patterns, "patterns"), ["left", "shape"], "left").withColumn("conf", F.coalesce("conf", F.lit(0.0)))
        instances = doubt.groupBy("core").agg(F.sum(F.log1p(-F.least(F.col("conf"), F.lit(0.999)))).alias("log")).select("core", (1 - F.exp("log")).alias("score"))
        scored = doubt.join(instances, "core").withColumn("belief", F.when(F.col("seed") == 1, 1.0).otherwise(F.col("score")))
        scored = materialize(scored.select("left", "shape", "core", "n", "seed", "conf", "belief"), "scores")
    return scored.where((F.col("seed") == 0) & (F.col("conf") >= sure) & (F.col("belief") >= sure)).select("left", "shape", "core")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_key, n_id, base, spans for each row of ``docs``.

    ``base`` and ``spans`` list kind:start:end (code points, end exclusive) by kind and start, joined by commas: the
    base spans, and these with the keys and the discovered ones (kind id). Null texts count as empty; null ids, repeated
    rows and other columns do no harm; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    found = base(text) | {"key": some(text, "[0-9a-f]{32}", KEY)}
    tagged = lambda i: lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    kinds = F.concat(*[F.transform(found[k], tagged(i)) for i, k in enumerate(KINDS[:5])])
    slim = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", kinds.alias("seeds"), some(text, "[0-9]", TOKEN, left=True).alias("tokens"))
    slim = materialize(slim, "pii")
    trimmed = F.regexp_replace("t.m", r"^[^\p{L}0-9+@]+", "")
    core = F.regexp_replace(trimmed, r"[^\p{L}0-9]+$", "")
    start = F.col("t.s") + F.length("t.m") - F.length(trimmed)
    tokens = slim.select("row", "seeds", F.explode("tokens").alias("t")).select("row", "seeds", start.alias("s"), core.alias("core"), F.coalesce("t.left", F.array(F.lit(""))).alias("words"))
    tokens = tokens.where(F.length("core") >= 6).withColumn("e", F.col("s") + F.length("core")).withColumn("shape", shape(F.col("core")))
    tokens = tokens.withColumn("seed", F.exists("seeds", lambda b: (b["s"] < F.col("e")) & (F.col("s") < b["e"]))).drop("seeds")
    tokens = tokens.withColumn("left", F.explode(F.array_distinct(F.array(F.element_at("words", -1), F.array_join("words", " "))))).drop("words")
    new = discover(tokens)
    more = tokens.where(~F.col("seed")).join(new, ["left", "shape", "core"]).groupBy("row").agg(F.collect_set(F.struct(F.lit(5).alias("k"), "s", "e")).alias("more"))
    out = slim.select("row", "doc_id", "seeds").join(more, "row", "left")
    count = lambda i: F.size(F.filter("seeds", lambda x: x["k"] == i)).cast("long")
    extra = F.coalesce("more", F.array().cast("array<struct<k:int,s:int,e:int>>"))
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:5])], F.size(extra).cast("long").alias("n_id"), listed(F.filter("seeds", lambda x: x["k"] < 4)).alias("base"), listed(F.concat("seeds", extra)).alias("spans"))
