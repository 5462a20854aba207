"""Exact-block repetition: paragraphs and sentences that a text repeats, with thresholds by kind of content.

Items are exploded with their positions, counted per document, and their longest run found by gaps and islands. Rules
are Columns on the aggregated items; the first item in the text that breaks one gives the reason, paragraphs before
sentences. Documents without any item twice are dropped before the explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clauses, let, ngrams, paragraphs, strip, words

# Signs, patterns and phrases of the rules, in natural order.
SIGNS = "=+-*/^()[]{}<>|&~!@#$%\\"
EXPRESSIONS = [r"\w+\([^)]*\)", r"\w+\s*=\s*\w+", r"\d+/\d+", r"[a-zA-Z_]\w*\s*[+\-*/]\s*[a-zA-Z_]\w*", r"[a-zA-Z_]\w*\s*[=<>!]+\s*[a-zA-Z_]\w*"]
STATEMENTS = [
    r"^import\s+", r"^from\s+\w+\s+import", r"^return\s+", r"^\w+\s*\+\s*=\s*\d+", r"^\w+\s*-\s*=\s*\d+", r"^\w+\s*\*\s*=\s*\d+", r"^\w+\s*/\s*=\s*\d+",
    r"^for\s+", r"^while\s+", r"^if\s+", r"^def\s+", r"^class\s+", r"^\w+\.\w+\(", r"^\w+\s*=\s*\w+\(",
]
FORMULAS = [
    r"math\.\w+\([^)]*\)", r"\w+\*\*[0-9]+", r"[0-9]+\s*[+\-*/]\s*[0-9]+", r"[a-zA-Z_]\w*\s*[+\-*/]\s*[a-zA-Z_]\w*", r"def\s+\w+\([^)]*\):",
    r"lambda\s+[^:]+:", r"\[[^\]]*for[^\]]*\]", r"\{[^}]*for[^}]*\}", r"\([^)]*for[^)]*\)",
]
PHRASES = [
    "not sure", "wait no", "i think", "maybe", "probably", "yes", "no", "ok", "okay", "right", "wrong", "correct", "incorrect", "true", "false", "good", "bad", "nice",
    "great", "awesome", "terrible", "wow", "oh", "hmm", "um", "uh", "well", "so", "now", "then", "here", "there", "this", "that", "these", "those", "it", "is", "are",
    "was", "were", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "can", "cannot", "cant", "dont", "doesnt", "isnt", "arent",
    "second < b", "we can use:", "we can use", "first < a", "third < c", "fourth < d", "a < b", "b < c", "c < d", "d < e", "e < f", "f < g", "g < h", "x < y", "y < z",
    "i < j", "j < k", "k < l", "l < m", "m < n", "n < o", "o < p", "p < q", "q < r", "r < s", "s < t", "t < u", "u < v", "v < w", "w < x", "return none", "return true",
    "return false", "return 0", "return 1", "return -1", "return null", "return undefined",
]
TRANSITIONS = ["alternatively,", "therefore,", "however,"]


def any_of(x: Column, patterns: list[str], flags: str = "(?U)") -> Column:
    return x.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def is_expression(x: Column) -> Column:
    """Signs of mathematics or code anywhere."""
    return (F.translate(x, SIGNS, "") != x) | any_of(x, EXPRESSIONS)


def is_statement(x: Column) -> Column:
    """A line of code, or brackets that do not match."""
    open_, shut = x.rlike(r"[(\[{][^)\]}]*$"), x.rlike(r"^[^(\[{]*[)\]}]")
    return ((open_ | shut) & ~x.rlike(r"[(\[{][^(\[{)\]}]*[)\]}]")) | any_of(x, STATEMENTS, "(?iU)")


def is_formula(x: Column) -> Column:
    return any_of(x, FORMULAS)


def is_short_phrase(x: Column) -> Column:
    """Holds a common phrase, as a substring anywhere (so nearly all sentences do), or is a bare comparison."""
    names = lambda words_: F.array(*[F.lit(w) for w in words_])
    code = names(["import", "from", "return", "def", "class", "if", "for", "while"])
    bare = lambda low: low.rlike(r"(?U)^\w+\s*[<>]\s*\w+$") & ~F.exists(code, lambda w: F.contains(low, w))
    return let(F.lower(x), lambda low: F.exists(names(PHRASES), lambda p: F.contains(low, p)) | bare(low))


def is_list(x: Column) -> Column:
    """Two lines at least that start with a number, or with a bullet."""
    lines = F.transform(F.split(x, "\n", -1), strip)
    return (F.size(F.filter(lines, lambda s: s.rlike(r"(?U)^\d+\.\s"))) >= 2) | (F.size(F.filter(lines, lambda s: s.rlike(r"(?U)^[-*•]\s"))) >= 2)


def repeated_items(items: DataFrame, key: str, least: int) -> DataFrame:
    """(key, item, total, first, run) of items that occur twice at least; ``items`` has key, pos, item.

    Items shorter than ``least`` count for nothing, but their positions break runs.
    """
    long_ = items.where(F.length("item") >= least)
    island = F.col("pos") - F.row_number().over(Window.partitionBy(key, "item").orderBy("pos"))
    runs = long_.withColumn("island", island).groupBy(key, "item", "island").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    return runs.groupBy(key, "item").agg(F.sum("n").alias("total"), F.min("p").alias("first"), F.max("n").alias("run")).where("total > 1")


def block_repetition(docs: DataFrame, key: str = "doc_id", text: str = "text", paragraphs_at: int = 10, sentences_at: int = 40, runs_at: int = 4, mark: str = "\n\n") -> DataFrame:
    """(key, has_repetition, repetition_reason, repetition_examples) for each document.

    ``mark`` separates paragraphs; sentences end at runs of . ! and ?. Thresholds are multiplied for lists, paragraphs of
    several lines, and mathematics; paragraphs that never stand together need twice as many, 30 at most.
    """
    listed = is_list(F.col(text))
    base = docs.select(key, F.col(text).alias("t"), listed.alias("listed"))

    def items(parts: Column) -> DataFrame:
        some = base.withColumn("parts", parts).where(F.size(F.array_distinct("parts")) < F.size("parts"))
        return some.select(key, "listed", F.posexplode("parts").alias("pos", "item"))

    p = items(paragraphs(F.col("t"), mark))
    rep = repeated_items(p.select(key, "pos", "item"), key, 10).join(base.select(key, "listed"), key)
    x = F.col("item")
    factor = F.greatest(F.when(F.col("listed"), 3).otherwise(1), F.when(x.contains("\n"), 4).otherwise(1), F.when(is_expression(x), 2).otherwise(1))
    need = F.when(F.col("run") == 1, F.least(paragraphs_at * factor * 2, F.lit(30))).otherwise(paragraphs_at * factor)
    skip = ((F.col("run") == 1) & (F.length(x) < 20)) | is_statement(x) | is_formula(x) | F.lower(x).isin(TRANSITIONS)
    hits = rep.where(~skip & (F.col("total") >= need)).select(key, F.lit(0).alias("tier"), "first", F.format_string("paragraph_repeated_%dx", "total").alias("reason"), "item")
    s = items(clauses(F.col("t")))
    rep = repeated_items(s.select(key, "pos", "item"), key, 5).join(base.select(key, "listed"), key)
    factor = F.greatest(F.when(is_expression(x), 2).otherwise(1), F.when(F.col("listed"), 3).otherwise(1))
    short = is_short_phrase(x)
    skip = is_statement(x) | is_formula(x) | F.lower(x).isin(TRANSITIONS)
    reason = (
        F.when(short, F.when(F.col("run") >= 2 * runs_at, F.format_string("line_repeated_%dx_consecutive_short_phrase", "total")))
        .when(skip, F.lit(None))
        .when(F.col("run") >= runs_at * factor, F.format_string("line_repeated_%dx_consecutive", "total"))
        .when((F.col("total") >= sentences_at * factor) & (F.length(x) >= 10), F.format_string("line_repeated_%dx", "total"))
    )
    lines = rep.where(F.size(words(x)) > 1).select(key, F.lit(1).alias("tier"), "first", reason.alias("reason"), "item").where("reason is not null")
    first = hits.unionByName(lines).groupBy(key).agg(F.min(F.struct("tier", "first", "reason", "item")).alias("r"))
    out = docs.select(key).join(first, key, "left")
    return out.select(key, F.col("r").isNotNull().alias("has_repetition"), F.col("r.reason").alias("repetition_reason"), F.when(F.col("r").isNotNull(), F.array("r.item")).otherwise(F.array().cast("array<string>")).alias("repetition_examples"))


def repetition_report(flags: DataFrame, docs: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Counts by reason and source, most first."""
    return flags.where("has_repetition").join(docs.select(key, source), key).groupBy("repetition_reason", source).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "repetition_reason", source)


def ngram_repetition(docs: DataFrame, n: int = 3, least: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ngram, occurrences, positions) of n-grams of lower-case words that a text has ``least`` times.

    Places whose n-gram stands at another place of the text too are found within the row, by sorted hashes; only these
    are exploded and compared as text.
    """
    tokens = words(F.lower(F.col(text)))
    if least > 1:

        def twice(t: Column) -> Column:
            places = F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.struct(F.xxhash64(F.slice(t, i + 1, n)).alias("h"), i.alias("pos")))
            alike = lambda s, i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            found = let(F.sort_array(places), lambda s: F.filter(s, lambda x, i: alike(s, i, i - 1) | alike(s, i, i + 1)))
            return F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), F.array_join(F.slice(t, x["pos"] + 1, n), " ").alias("ngram")))

        some = let(tokens, lambda t: F.when(F.size(t) > n, twice(t)))
        grams = docs.select(key, F.explode(some).alias("x")).select(key, "x.pos", "x.ngram")
    else:
        grams = docs.select(key, F.posexplode(ngrams(tokens, n)).alias("pos", "ngram"))
    return grams.groupBy(key, "ngram").agg(F.count("*").alias("occurrences"), F.array_sort(F.collect_list("pos")).alias("positions")).where(F.col("occurrences") >= least)
