"""Normal forms of mathematical answers, and numeric functions over arrays.

The normal forms are chains of replacements on Columns; only the fraction rules that look at single characters need a
fold over the parts between fractions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, last_boxed, let, replace_all, split_plain, strip

# What answers are rewritten to, and what is left out of them, in this order (Lewkowycz et al. 2022, appendix D).
SUBSTITUTIONS = [("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}")]
REMOVED = [
    "square", "ways", "integers", "dollars", "mph", "inches", "ft", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents",
    "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}",
    "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
]


def normalize_final_answer(x) -> Column:
    """A quantitative answer without units, markup and shorthand."""
    s = replace_all(F.element_at(F.split(col(x), "=", -1), -1), SUBSTITUTIONS)
    s = replace_all(s, [(w, "") for w in REMOVED])
    for pattern, to in (
        (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
        (r"(\\text\{)(.*?)(\})", "$2"),
        (r"(\\textbf\{)(.*?)(\})", "$2"),
        (r"(\\overline\{)(.*?)(\})", "$2"),
        (r"(\\boxed\{)(.*)(\})", "$2"),
        (r"(frac)([^{])(.)", "frac{$2}{$3}"),
        (r"(sqrt)([^{])", "sqrt{$2}"),
    ):
        s = F.regexp_replace(s, pattern, to)
    s = F.replace(s, F.lit("$"), F.lit(""))
    return let(s, lambda t: F.when(F.replace(t, F.lit(","), F.lit("")).rlike(r"(?U)^\d+$"), F.replace(t, F.lit(","), F.lit(""))).otherwise(t))


def final_answer_phrase(x) -> Column:
    """What stands between the phrase for final answers and the invitation to agree; null if there is none."""
    found = F.regexp_extract(F.concat(col(x), F.lit("I hope it is correct.")), r"Final Answer: The final answer is(.*?). I hope it is correct.", 1)
    return F.nullif(strip(found), F.lit(""))


def _arguments(s: Column) -> Column:
    """Braces around the two single characters that follow a fraction without them."""
    head, second = (lambda p: F.substring(p, 1, 1)), (lambda p: F.substring(p, 2, 1))
    given = lambda p: F.startswith(p, F.lit("{"))
    half = lambda p: F.concat(F.lit("{"), head(p), F.lit("}"), F.substr(p, F.lit(2)))
    both = lambda p: F.concat(F.lit("{"), head(p), F.lit("}{"), second(p), F.lit("}"), F.substr(p, F.lit(3)))
    one = lambda p: F.when(given(p), p).when(second(p) == "{", half(p)).otherwise(both(p))
    rest = lambda parts: F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    odd = lambda parts: F.exists(rest(parts), lambda p: (F.length(p) < 2) & ~given(p))
    whole = lambda parts: F.array_join(parts, "\\frac")
    fixed = lambda parts: F.array_join(F.concat(F.slice(parts, 1, 1), F.transform(rest(parts), one)), "\\frac")
    return let(split_plain(s, "\\frac"), lambda parts: F.when((F.size(parts) < 2) | odd(parts), whole(parts)).otherwise(fixed(parts)))


def strip_answer(x) -> Column:
    """The form in which competition answers are compared: no layout, one notation for fractions and roots, no units."""
    s = replace_all(x, [("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")])
    s = F.element_at(split_plain(s, "\\text{ "), 1)
    s = F.regexp_replace(replace_all(s, [("\\%", ""), (" .", " 0."), ("{.", "{0.")]), r"^\.", "0.")
    s = let(F.split(s, "=", -1), lambda p: F.when((F.size(p) == 2) & (F.length(p[0]) <= 2), F.try_element_at(p, F.lit(2))).otherwise(F.array_join(p, "=")))
    s = F.regexp_replace(s, r"\\sqrt([^{])", r"\\sqrt{$1}")
    s = F.regexp_replace(_arguments(F.replace(s, F.lit(" "), F.lit(""))), r"^0\.5$", r"\\frac{1}{2}")
    return F.regexp_replace(s, r"^(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)$", r"\\frac{$1}{$2}")


def same_answer(a, b) -> Column:
    """Whether two answers have one stripped form; two nulls do, one null does not."""
    return F.coalesce(strip_answer(a).eqNullSafe(strip_answer(b)), F.lit(False))


def number(stripped) -> Column:
    """The value of a decimal, with thousands or units or not, or of a plain fraction; null of anything else."""
    bare = F.regexp_replace(col(stripped), r"[,$\s]|\\text\{[^}]*\}", "")

    def value(s: Column) -> Column:
        part = lambda i: F.regexp_extract(s, r"^(-?)\\frac\{(-?[0-9.]+)\}\{(-?[0-9.]+)\}$", i)
        ratio = part(2).try_cast("double") / F.nullif(part(3).try_cast("double"), F.lit(0.0))
        return F.when(s.rlike(r"^[+-]?[0-9]*\.?[0-9]+$"), s.try_cast("double")).otherwise(F.when(part(1) == "-", -ratio).otherwise(ratio))

    return let(bare, value)


def same_value(a, b, tolerance: float = 1e-9) -> Column:
    """Whether two answers have one stripped form or are the same number: decimals, thousands, fractions."""
    close = lambda x, y: F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
    near = lambda p, q: F.coalesce(let(number(p), lambda x: let(number(q), lambda y: close(x, y))), F.lit(False))
    return let(strip_answer(a), lambda p: let(strip_answer(b), lambda q: p.eqNullSafe(q) | near(p, q)))


def math_candidates(x) -> Column:
    """The answers a solution may mean: boxed and by phrase, else the last formula, else all of it."""
    text = col(x)
    named = F.array(last_boxed(text), normalize_final_answer(final_answer_phrase(text)))
    formula = let(F.split(text, r"\$", -1), lambda p: F.when(F.size(p) > 2, F.array(normalize_final_answer(F.element_at(p, F.greatest(F.size(p) - 1, F.lit(1)))))))
    other = F.coalesce(formula, F.array(normalize_final_answer(text), text))
    return let(F.filter(named, lambda a: a.isNotNull()), lambda first: F.when(F.size(first) > 0, first).otherwise(other))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a) -> Column:
    """The vector over its length; unchanged if that is 0."""
    n = norm(a)
    return F.transform(col(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def masked_mean(values, mask) -> Column:
    """Mean over the elements whose mask is not 0."""
    return dot(values, mask) / F.aggregate(col(mask), F.lit(0.0), lambda s, m: s + m.cast("double"))


def log_sigmoid(x) -> Column:
    """-log(1 + exp(-x)) without overflow."""
    return F.least(col(x), F.lit(0.0)) - F.log1p(F.exp(-F.abs(col(x))))


def preference_loss(chosen, rejected, ref_chosen, ref_rejected, beta: float = 0.1, smoothing: float = 0.0) -> Column:
    """Direct preference loss of one pair of sequence log probabilities against a reference."""
    margin = beta * ((col(chosen) - col(rejected)) - (col(ref_chosen) - col(ref_rejected)))
    return -(1 - smoothing) * log_sigmoid(margin) - smoothing * log_sigmoid(-margin)


def simple_preference_loss(chosen, rejected, beta: float = 2.0, gap: float = 0.5, smoothing: float = 0.0) -> Column:
    """Reference-free preference loss over length-normalised log probabilities with a target gap (as a ratio to beta)."""
    margin = beta * (col(chosen) - col(rejected) - gap)
    return -(1 - smoothing) * log_sigmoid(margin) - smoothing * log_sigmoid(-margin)


def weighted_preference_loss(chosen, rejected, ref_chosen, ref_rejected, weight, beta: float = 0.1) -> Column:
    """Preference loss of a pair times its weight."""
    return preference_loss(chosen, rejected, ref_chosen, ref_rejected, beta) * col(weight)


def kl_estimates(difference, ratio) -> Column:
    """Four estimators of a divergence from the log probability difference d and the importance ratio: d, d²/2, exp(-d)-1+d, ratio * d."""
    d = col(difference)
    return F.struct(d.alias("linear"), (d * d / 2).alias("quadratic"), (F.expm1(-d) + d).alias("stable"), (col(ratio) * d).alias("weighted"))
