"""Scores of a prediction against a label, as Columns, and the registry they are dispatched by.

A verifier is a function (prediction, label, options) -> Column of doubles. Names match in lower case. Labels with
several answers are JSON arrays. Calls to judges and running of code are outside: their results are input columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .algebra import answers_formula
from .maths import final_answer_phrase, math_candidates, normalize_final_answer, same_answer, same_value
from .text import (
    after_last,
    before_first,
    col,
    f1,
    last_boxed,
    last_number,
    normalize_answer,
    parse_decision,
    parse_json_score,
    parse_score,
    remove_thinking,
    replace_all,
    strip,
    words,
)

VERIFIERS: dict[str, Callable[..., Column]] = {}


def verifier(*names: str):
    def add(f):
        for name in names:
            VERIFIERS[name] = f
        return f

    return add


def score(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False)).cast("double")


def labels(label) -> Column:
    """The answers of a label: the elements of a JSON array, or the label itself."""
    return F.coalesce(F.from_json(col(label), "array<string>"), F.array(strip(label)))


@verifier("gsm8k")
def gsm8k(prediction, label, **_) -> Column:
    return score(F.lower(last_number(prediction)) == F.lower(col(label)))


@verifier("math")
def math(prediction, label, symbolic: bool = True, **_) -> Column:
    """One of the answers that the solution may mean is the label; ``symbolic``: also as a formula of the same value."""
    found = math_candidates(prediction)
    plain = F.exists(found, lambda a: same_value(a, col(label)))
    if not symbolic:
        return score(plain)
    return score(F.coalesce(plain, F.lit(False)) | answers_formula(prediction, label, True))


@verifier("math-verify")
def math_value(prediction, label, symbolic: bool = True, **_) -> Column:
    """Same number, form or (``symbolic``) formula as the boxed or last answer."""
    answer = F.coalesce(last_boxed(prediction), normalize_final_answer(final_answer_phrase(prediction)), last_number(prediction))
    plain = F.coalesce(same_value(answer, label), F.lit(False))
    return score(plain | answers_formula(prediction, label, False) if symbolic else plain)


@verifier("strict_math")
def strict_math(prediction, label, **_) -> Column:
    return score(same_answer(normalize_final_answer(final_answer_phrase(prediction)), label))


@verifier("flan")
def flan(prediction, label, **_) -> Column:
    return score(normalize_answer(after_last(prediction, "The answer is: ")) == normalize_answer(label))


@verifier("string_matcher")
def string_matcher(prediction, label, **_) -> Column:
    text = col(prediction)
    answer = before_first(after_last(text, "<answer>"), "</answer>")
    return score(text.contains("<answer>") & text.contains("</answer>") & (normalize_answer(answer) == normalize_answer(label)))


@verifier("string_f1")
def string_f1(prediction, label, **_) -> Column:
    return f1(replace_all(after_last(prediction, "</think>"), [("<answer>", ""), ("</answer>", "")]), label)


@verifier("puzzle")
def puzzle(prediction, label, **_) -> Column:
    return score(normalize_answer(remove_thinking(prediction)) == normalize_answer(label))


@verifier("re_search_f1")
def search_f1(prediction, label, **_) -> Column:
    """Best F1 over the labels between finish tags; 0.1 where it is 0 in the right format."""
    text = col(prediction)
    answer = before_first(after_last(text, "<finish>"), "</finish>")
    best = F.array_max(F.transform(labels(label), lambda one: f1(answer, one)))
    tagged = (text.contains("<finish>") | text.contains("</finish>")) & (answer != "")
    return F.when(tagged, F.when(best == 0, 0.1).otherwise(best)).otherwise(0.0)


@verifier("re_search")
def search_exact(prediction, label, **_) -> Column:
    answer = strip(F.regexp_extract(col(prediction), r"(?is)<finish>(.*?)</finish>", 1))
    return score((answer != "") & F.exists(labels(label), lambda one: normalize_answer(one) == normalize_answer(answer)))


def _length(prediction, length) -> Column:
    return col(length) if length is not None else F.size(words(prediction))


@verifier("max_length")
def max_length(prediction, label, length=None, most: float = 32768, **_) -> Column:
    """1 less the share of ``most`` by which the length differs from the label; may be negative."""
    return 1 - F.abs(_length(prediction, length) - col(label).try_cast("double")) / most


@verifier("up_to_max_length")
def up_to_max_length(prediction, label, length=None, most: float = 32768, **_) -> Column:
    over = _length(prediction, length) - col(label).try_cast("double")
    return F.when(over < 0, 1.0).otherwise(1 - over / most)


def pass_rate(results, threshold: float = 0.0, runtimes=None, penalty: float = 0.0) -> Column:
    """Share of the passed tests (an array of 0 and 1); 0 below ``threshold``, less ``penalty`` a second of mean run time."""
    r = col(results)
    rate = F.when(F.size(r) > 0, F.aggregate(r, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(r)).otherwise(0.0)
    rate = F.when(rate < threshold, 0.0).otherwise(rate)
    if runtimes is None:
        return rate
    mean = F.aggregate(col(runtimes), F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(col(runtimes)), F.lit(1))
    return F.greatest(F.lit(0.0), rate - penalty * mean)


def output_matches(printed, result) -> Column:
    """Whether the last result tag's content is what a program printed."""
    claimed = F.try_element_at(F.regexp_extract_all(col(result), F.lit(r"(?is)<result>(.*?)</result>"), F.lit(1)), F.lit(-1))
    return score(strip(claimed) == strip(printed))


def verify(name, prediction, label, only: list[str] | None = None, **options) -> Column:
    """The score by the verifier that the column ``name`` holds; null for names that none has."""
    out = F.lit(None).cast("double")
    for key in only or sorted(VERIFIERS):
        out = F.when(F.lower(col(name)) == key, VERIFIERS[key](prediction, label, **options)).otherwise(out)
    return out


#: How a judge's reply becomes a score, by the kind of prompt it was given.
EXTRACTORS: dict[str, Callable[..., Column]] = {
    "text": parse_score,
    "decision": parse_decision,
    "json": parse_json_score,
    "json_of_ten": lambda reply: parse_json_score(reply, 10.0),
}


def judged(reply, kind: str = "json") -> Column:
    """The score in a judge's reply; the reply comes from a table of saved judgements."""
    return EXTRACTORS[kind](reply)


#: Tiers of a response's format, best first, with the share of the reward; the best tier that any response of a batch reaches counts for all.
FORMATS = [
    (r"(?is)^.*?<python>.*?</python>.*?<result>.*?</result>", 1.0),
    (r"(?is)^.*?<python>.*?</python>", 1.0),
    (r"(?s)^.*?assistantfinal\s*<PYTHON>.*?</PYTHON>", 1.0),
    (r"(?is)^.*?assistantfinal\s*<python>.*?</python>", 1.0),
    (r"(?s)^.*?<result>.*?</result>", 0.5),
    (r"(?s)^.*?</think>\s*<answer>.*?</answer>", 1.0),
]
