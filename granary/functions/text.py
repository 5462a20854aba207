"""Text functions with the semantics of common scripting languages: Unicode white space, words, splits, extraction.

Everything is a Column expression. ``\\w``, ``\\s`` and ``\\b`` need the flag (?U) to see more than ASCII in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it; keeps nested rules from growing."""
    return F.element_at(F.transform(F.array(value), body), 1)


def rx(pattern: str) -> Column:
    return F.lit(pattern)


def strip(x) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(x), r"(?U)^\s+|\s+$", "")


def blank(x) -> Column:
    """Null, empty, or white space only."""
    return col(x).isNull() | (F.length(strip(x)) == 0)


def words(x) -> Column:
    """Runs of anything but white space."""
    return F.regexp_extract_all(col(x), rx(r"(?U)\S+"), F.lit(0))


def word_tokens(x) -> Column:
    """Runs of word characters."""
    return F.regexp_extract_all(col(x), rx(r"(?U)\w+"), F.lit(0))


def tokens(x) -> Column:
    """Word characters, or single signs: the library's own deterministic tokenizer."""
    return F.regexp_extract_all(col(x), rx(r"(?U)\w+(?:['’-]\w+)*|[^\w\s]"), F.lit(0))


def token_ids(x, vocabulary: int = 1 << 31) -> Column:
    """A stable integer for each token."""
    return F.transform(tokens(x), lambda t: F.pmod(F.xxhash64(t), F.lit(vocabulary)).cast("int"))


def count_matches(x, pattern: str) -> Column:
    return F.regexp_count(col(x), rx(pattern))


def replace_all(x, pairs: list[tuple[str, str]]) -> Column:
    """Plain replacements, one after the other."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col(x))


def after_last(x, mark: str) -> Column:
    """What follows the last ``mark``; all of it if there is none."""
    return F.element_at(split_plain(x, mark), -1)


def before_first(x, mark: str) -> Column:
    return F.element_at(split_plain(x, mark), 1)


def split_plain(x, mark: str) -> Column:
    return F.split(col(x), r"\Q" + mark + r"\E", -1)


def paragraphs(x, mark: str = "\n\n") -> Column:
    """Stripped parts between marks, without empty ones."""
    return F.filter(F.transform(split_plain(x, mark), strip), lambda p: p != "")


def clauses(x) -> Column:
    """Stripped parts between runs of full stops, exclamation and question marks, without empty ones."""
    return F.filter(F.transform(F.split(col(x), r"[.!?]+", -1), strip), lambda p: p != "")


def sentences(x) -> Column:
    """Split at white space after a full stop or question mark, but not after abbreviations such as ``e.g.`` or ``Dr.``."""
    return F.split(col(x), r"(?U)(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?)\s", -1)


def sentence_list(x) -> Column:
    """Stripped sentences that end in . ! or ?, the rest as one more; abbreviations, initials and decimals do not end one.

    An approximation of trained sentence splitters.
    """
    marked = F.regexp_replace(col(x), r"(?U)\n", " ")
    for pattern, to in (
        (r"\b(Mr|St|Mrs|Ms|Dr|Prof|Capt|Cpt|Lt|Mt|Inc|Ltd|Jr|Sr|Co)\.", "$1\u0001"),
        (r"(?U)\b([A-Za-z])\.([A-Za-z])\.", "$1\u0001$2\u0001"),
        (r"([0-9])\.([0-9])", "$1\u0001$2"),
        (r"(?U)\s([A-Za-z])\.\s", " $1\u0001 "),
        (r"\.(com|net|org|io|gov|edu|me)\b", "\u0001$1"),
    ):
        marked = F.regexp_replace(marked, pattern, to)
    parts = F.regexp_extract_all(marked, rx(r"[^.!?]*[.!?]+[\"”']?|[^.!?]+$"), F.lit(0))
    clean = F.transform(parts, lambda s: F.translate(strip(s), "\u0001", "."))
    return F.filter(clean, lambda s: s != "")


PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def normalize_answer(x) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.translate(F.lower(col(x)), PUNCTUATION, "")
    return strip(F.regexp_replace(F.regexp_replace(plain, r"(?U)\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def remove_thinking(x) -> Column:
    """The answer after the last thinking section, without answer tags."""
    text = strip(F.replace(col(x), F.lit("<|assistant|>"), F.lit("")))
    return strip(replace_all(after_last(text, "</think>"), [("<answer>", ""), ("</answer>", "")]))


def tag_blocks(x, begin: str, end: str) -> Column:
    """Stripped contents of all pairs of marks."""
    return F.transform(F.regexp_extract_all(col(x), rx(r"(?s)\Q" + begin + r"\E(.*?)\Q" + end + r"\E"), F.lit(1)), strip)


def last_line(x) -> Column:
    """The last line that is not blank, stripped; empty if there is none."""
    lines = F.filter(F.transform(F.split(col(x), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1), strip), lambda s: s != "")
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))


def last_code_block(x) -> Column:
    """Contents of the last fenced block (its language left out), the whole text if there is none."""
    blocks = F.regexp_extract_all(col(x), rx(r"(?s)```(?:[A-Za-z0-9_+-]*)\n(.*?)```"), F.lit(1))
    return F.coalesce(F.try_element_at(blocks, F.lit(-1)), col(x))


def last_number(x) -> Column:
    """The last number, after one comma between digits each is dropped; the text without one. A sign shows with decimals only."""
    joined = F.regexp_replace(col(x), r"([0-9]),([0-9])", "$1$2")
    found = F.regexp_extract_all(joined, rx(r"[-+]?[0-9]*\.[0-9]+|[0-9]+"), F.lit(0))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), joined)


def last_boxed(x) -> Column:
    """The content of the last \\boxed{...} or \\fbox{...} with balanced braces; null if there is none or it never closes."""

    def step(a: Column, c: Column) -> Column:
        depth = a["d"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.when(a["done"], a).otherwise(F.struct(depth.alias("d"), (a["n"] + 1).alias("n"), ((c == "}") & (a["d"] == 1)).alias("done")))

    def inside(tail: Column) -> Column:
        # the content ends where the depth first returns to 0
        start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("n"), F.lit(False).alias("done"))
        return let(F.aggregate(F.split(tail, ""), start, step), lambda w: F.when(w["done"], F.substr(tail, F.lit(2), w["n"] - 2)))

    tail = F.regexp_extract(col(x), r"(?s).*\\(?:boxed|fbox)(\{.*)", 1)
    plain = F.regexp_extract(col(x), r".*\\boxed ([^$]+)", 1)
    return let(tail, lambda t: F.when(t != "", inside(t)).otherwise(F.nullif(plain, F.lit(""))))


def f1(prediction, truth) -> Column:
    """Token F1 of normalised texts, as multisets."""
    split = lambda c: F.filter(F.split(normalize_answer(c), " "), lambda w: w != "")
    count = lambda a, w: F.size(F.filter(a, lambda v: v == w))

    def score(p: Column, t: Column) -> Column:
        same = F.aggregate(F.array_distinct(p), F.lit(0), lambda a, w: a + F.least(count(p, w), count(t, w)))
        return F.when(same == 0, 0.0).otherwise(2.0 * same / (F.size(p) + F.size(t)))

    return let(split(prediction), lambda p: let(split(truth), lambda t: score(p, t)))


def ngrams(tokens_: Column, n: int) -> Column:
    """All runs of n tokens, joined by spaces."""
    runs = lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, n), " "))
    return let(tokens_, lambda t: F.when(F.size(t) >= n, runs(t)).otherwise(F.array().cast("array<string>")))


def parse_score(x) -> Column:
    """A judge's score from free text: the first ratio, else percentage, else number, else words for right and wrong, else 0."""
    text = col(x)
    first = lambda pattern, group=1: F.regexp_extract(text, pattern, group)
    ratio, percent, number = r"([0-9]+)/([0-9]+)", r"([0-9]+\.?[0-9]*|\.[0-9]+)%", r"([0-9]+\.?[0-9]*|\.[0-9]+)"
    return (
        F.when(text.rlike(ratio), first(ratio).try_cast("double") / F.nullif(first(ratio, 2).try_cast("double"), F.lit(0.0)))
        .when(text.rlike(percent), first(percent).try_cast("double") / 100)
        .when(text.rlike(number), first(number).try_cast("double"))
        .when(text.rlike("(?i)yes|correct|good|true|pass"), 1.0)
        .otherwise(0.0)
    )


def parse_decision(x) -> Column:
    """1 for ``final decision: yes``, else 0."""
    return F.lower(col(x)).contains("final decision: yes").cast("double")


def parse_json_score(x, scale: float = 1.0) -> Column:
    """SCORE of a JSON object, fenced or not, or what a broken one has in its place; 0 without one."""
    text = clean_json(x)
    found = F.coalesce(F.get_json_object(text, "$.SCORE"), F.regexp_extract(text, r'"SCORE"\s*:\s*"?([0-9]+(?:\.[0-9]+)?)"?', 1))
    return F.coalesce(found.try_cast("double"), F.lit(0.0)) / scale


def clean_json(x) -> Column:
    """JSON text without a code fence around it."""
    return strip(F.regexp_replace(strip(x), r"(?i)^```(?:json)?|```$", ""))


#: JSON by its grammar, with NaN and Infinity; numbers and strings of any length.
_STRICT = {"allowSingleQuotes": "false", "maxNumLen": "2147483647", "maxStringLen": "2147483647"}


def is_json(x) -> Column:
    """Whether the whole text is one JSON value, nested at most 1000 deep; keys may repeat.

    Spark's parsers stop after the first value, so the text is read as the first of an array's two items: the second, the
    text's own hash, comes out as such only if one value fills the first one's place. ``+Infinity`` is made no number.
    """

    def whole(t: Column) -> Column:
        pair = F.from_json(F.concat(F.lit("["), F.replace(t, F.lit("+I"), F.lit("+_I")), F.lit(',"'), F.sha2(t, 256), F.lit('"]')), "array<string>", _STRICT)
        return F.coalesce((F.size(pair) == 2) & (F.element_at(pair, 2) == F.sha2(t, 256)), F.lit(False))

    return let(col(x), whole)
