"""Predicates for instructions on a response's form, as Columns.

SIMPLE are plain functions of (text, parameters); CONSTRAINTS are named constraints with their own parameters, with
CONFLICTS telling which cannot be asked for together. Counts compare by ``relation``: "less than" or "at least".
Rules that need a trained sentence splitter, tokenizer or language detector use the library's own deterministic ones.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, clean_json, col, count_matches, is_json, let, rx, sentence_list, sentences, split_plain, strip, tokens, word_tokens, words

SIMPLE: dict[str, Callable[..., Column]] = {}
CONSTRAINTS: dict[str, Callable[..., Column]] = {}

#: Function words that tell languages apart (fixed values).
STOP_WORDS = {
    "en": "the of and to in is that it for was on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do".split(),
    "fr": "le la les de des et un une du est que dans pour qui pas sur au avec ce il elle plus par ne se sont mais nous vous ou leur cette aux été".split(),
    "de": "der die das und ist in den von zu mit sich auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem".split(),
    "es": "el la los las de que y en un una es se no por con para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también".split(),
}


def simple(f):
    SIMPLE[f.__name__] = f
    return f


def constraint(*names: str):
    def add(f):
        for name in names:
            CONSTRAINTS[name] = f
        return f

    return add


def quoted(s: str) -> str:
    return r"\Q" + s + r"\E"


def compare(n: Column, relation: str, limit: int) -> Column:
    return n < limit if relation == "less than" else n >= limit


def quantified(n: Column, quantifier: str, limit: int, slack: int = 0) -> Column:
    return {"at least": n >= limit, "at most": n <= limit, "around": F.abs(n - limit) <= slack}.get(quantifier, F.lit(False))


def half_even(x: float) -> int:
    return round(x)


def language_of(text) -> Column:
    """The language with most function words in the text; null if none has any."""
    known = lambda found, s: F.size(F.filter(found, lambda w: w.isin(s)))
    counts = lambda found: F.array(*[F.struct(known(found, s).alias("n"), F.lit(k).alias("k")) for k, s in _FOLDED.items()])
    best = let(word_tokens(F.lower(col(text))), lambda found: F.array_max(counts(found)))
    return let(best, lambda b: F.when(b["n"] > 0, b["k"]))


_FOLDED = {k: sorted(set(v)) for k, v in STOP_WORDS.items()}


# plain functions; (?d): a dot stops at line feeds alone


@simple
def has_keywords(text, keywords: list[str]) -> Column:
    low = F.lower(col(text))
    return F.forall(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(low, k)) if keywords else F.lit(True)


@simple
def keyword_frequency(text, word: str, n: int) -> Column:
    return F.size(F.filter(word_tokens(F.lower(col(text))), lambda w: w == word.lower())) == n


@simple
def no_forbidden_words(text, forbidden: list[str]) -> Column:
    low = F.lower(col(text))
    return ~F.exists(F.array(*[F.lit(k.lower()) for k in forbidden]), lambda k: F.contains(low, k)) if forbidden else F.lit(True)


@simple
def letter_frequency(text, letter: str, n: int) -> Column:
    if len(letter) != 1:
        raise ValueError("one letter is asked for")
    return F.length(col(text)) - F.length(F.replace(col(text), F.lit(letter), F.lit(""))) == n


@simple
def response_language(text, language: str) -> Column:
    return F.coalesce(language_of(text) == language, F.lit(False))


@simple
def paragraph_count(text, n: int) -> Column:
    trimmed = F.array_join(F.transform(F.split(col(text), r"\r\n|[\n\r]", -1), strip), "\n")
    parts = split_plain(strip(trimmed), "* * *")
    return F.forall(parts, lambda p: ~blank(p)) & (F.size(parts) == n)


@simple
def word_count(text, n: int, quantifier: str) -> Column:
    return quantified(F.size(words(text)), quantifier, n, max(half_even(n * 0.1), 1))


@simple
def sentence_count(text, n: int, quantifier: str) -> Column:
    return quantified(F.size(sentences(text)), quantifier, n, 1)


@simple
def paragraph_starts(text, n: int, first_word: str, i: int) -> Column:
    parts = F.split(col(text), "\n\n", -1)
    return (F.size(parts) == n) & F.coalesce(F.startswith(strip(F.try_element_at(parts, F.lit(i))), F.lit(first_word)), F.lit(False))


@simple
def has_postscript(text, marker: str) -> Column:
    at = F.instr(col(text), marker)
    return (at > 0) & (F.length(strip(F.substr(col(text), at))) > len(marker))


@simple
def placeholders(text, n: int) -> Column:
    return count_matches(text, r"(?d)\[(.*?)\]") >= n


@simple
def bullet_points(text, n: int) -> Column:
    return F.size(F.filter(F.split(col(text), "\n", -1), lambda s: strip(s).rlike(r"^[*-]"))) == n


@simple
def has_title(text) -> Column:
    return col(text).rlike(r"(?d)<<(.*?)>>")


@simple
def is_choice(text, options: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(o) for o in options]), lambda o: F.contains(o, col(text)))


@simple
def highlighted(text, n: int) -> Column:
    return count_matches(text, r"(?d)\*(.*?)\*") >= n


@simple
def section_count(text, n: int, splitter: str) -> Column:
    parts = split_plain(text, splitter)
    return F.size(parts) - (parts[0] == "").cast("int") == n


@simple
def valid_json(text) -> Column:
    return is_json(text)


@simple
def repeats_prompt(text, prompt) -> Column:
    return F.startswith(col(text), prompt if isinstance(prompt, Column) else F.lit(prompt))


@simple
def two_responses(text) -> Column:
    parts = split_plain(text, "******")
    return (F.size(parts) == 2) & ~F.try_element_at(F.transform(parts, strip), F.lit(1)).eqNullSafe(F.try_element_at(F.transform(parts, strip), F.lit(2)))


@simple
def uppercase(text) -> Column:
    return col(text) == F.upper(col(text))


@simple
def lowercase(text) -> Column:
    return col(text) == F.lower(col(text))


@simple
def capital_word_count(text, n: int, quantifier: str) -> Column:
    return quantified(count_matches(text, r"(?U)\b[A-Z]+\b"), quantifier, n)


@simple
def ends_with(text, phrase: str) -> Column:
    return F.endswith(col(text), F.lit(phrase))


@simple
def wrapped_in_quotes(text) -> Column:
    return col(text).startswith('"') & col(text).endswith('"')


@simple
def no_commas(text) -> Column:
    return ~col(text).contains(",")


# constraints


@constraint("language:response_language")
def c_language(text, language: str) -> Column:
    return F.coalesce(language_of(text) == language, F.lit(True))


@constraint("length_constraints:number_sentences")
def c_sentences(text, relation: str, n: int) -> Column:
    return compare(F.size(sentence_list(text)), relation, n)


@constraint("detectable_content:number_placeholders")
def c_placeholders(text, n: int) -> Column:
    return count_matches(text, r"\[.*?\]") >= n


@constraint("detectable_format:number_bullet_lists")
def c_bullets(text, n: int) -> Column:
    return count_matches(text, r"(?mU)^\s*\*[^*].*$") + count_matches(text, r"(?mU)^\s*-.*$") == n


@constraint("detectable_format:constrained_response")
def c_options(text, options: tuple[str, ...] = ("My answer is yes.", "My answer is no.", "My answer is maybe.")) -> Column:
    return F.exists(F.array(*[F.lit(o) for o in options]), lambda o: F.contains(strip(text), o))


@constraint("multi-turn:constrained_start")
def c_start(text, starter: str) -> Column:
    return col(text).rlike(r"(?mU)^\s*" + starter + r".*$")


@constraint("detectable_format:number_highlighted_sections")
def c_highlights(text, n: int) -> Column:
    one = F.filter(F.regexp_extract_all(col(text), rx(r"\*[^\n*]*\*"), F.lit(0)), lambda h: ~blank(F.translate(h, "*", "")))
    two = F.filter(F.regexp_extract_all(col(text), rx(r"\*\*[^\n*]*\*\*"), F.lit(0)), lambda h: ~blank(F.regexp_replace(h, r"^\*\*|\*\*$", "")))
    return F.size(one) + F.size(two) >= n


@constraint("detectable_format:multiple_sections")
def c_sections(text, splitter: str, n: int) -> Column:
    return F.size(F.split(col(text), r"(?U)\s?" + splitter + r"\s?\d+\s?", -1)) - 1 >= n


def _divided(text, pattern: str) -> tuple[Column, Column]:
    """Number of parts without blank edges, and whether no inner part is blank."""
    parts = F.split(col(text), pattern, -1)
    last = F.size(parts)
    edges = blank(parts[0]).cast("int") + F.when(last > 1, blank(F.element_at(parts, -1)).cast("int")).otherwise(0)
    inner = F.slice(parts, 2, F.greatest(last - 2, F.lit(0)))
    return last - edges, ~F.exists(inner, blank)


@constraint("length_constraints:number_paragraphs")
def c_paragraphs(text, n: int) -> Column:
    count, whole = _divided(text, r"(?U)\s?\*\*\*\s?")
    return whole & (count == n)


@constraint("paragraphs:paragraphs")
def c_two_paragraphs(text) -> Column:
    return c_paragraphs(text, 2)


@constraint("paragraphs:paragraphs2")
def c_two_blocks(text) -> Column:
    count, whole = _divided(text, "\n\n")
    return whole & (count == 2)


@constraint("detectable_content:postscript")
def c_postscript(text, marker: str) -> Column:
    pattern = {"P.P.S": r"\s*p\.\s?p\.\s?s.*$", "P.S.": r"\s*p\.\s?s\..*$"}.get(marker, r"\s*" + marker.lower() + r".*$")
    return F.lower(col(text)).rlike("(?mU)" + pattern)


@constraint("edit:rephrase")
def c_rephrase(text, reference: str) -> Column:
    """Null where the text marks no change."""
    rest = lambda c: F.regexp_replace(c, r"\*.*\*", "")
    return F.when(col(text).rlike(r"\*.*\*"), rest(col(text)) == rest(F.lit(reference)))


@constraint("keywords:existence")
def c_keywords(text, keywords: list[str]) -> Column:
    out = F.lit(True)
    for k in keywords:
        out = out & col(text).rlike("(?iu)" + k)
    return out


@constraint("keywords:frequency", "keywords:word_count_different_numbers")
def c_keyword_count(text, keyword: str, relation: str, n: int) -> Column:
    return compare(count_matches(text, "(?iu)" + keyword), relation, n)


@constraint("keywords:word_once")
def c_keyword_once(text, keyword: str) -> Column:
    return count_matches(text, "(?iu)" + keyword) == 1


@constraint("count:count_increment_word")
def c_increment(text, once: str, twice: str) -> Column:
    return (count_matches(text, "(?iu)" + once) == 1) & (count_matches(text, "(?iu)" + twice) == 2)


@constraint("length_constraints:number_words")
def c_words(text, relation: str, n: int) -> Column:
    return compare(F.size(word_tokens(text)), relation, n)


@constraint("detectable_format:json_format")
def c_json(text) -> Column:
    return is_json(clean_json(text))


@constraint("length_constraints:nth_paragraph_first_word")
def c_paragraph_first_word(text, n: int, k: int, word: str) -> Column:
    parts = F.split(col(text), "\n\n", -1)
    filled = F.size(F.filter(parts, lambda p: ~blank(p)))
    start = F.regexp_replace(F.regexp_extract(strip(F.try_element_at(parts, F.lit(k))), r"(?U)^\S+", 0), r"^'*\"*", "")
    return F.coalesce((filled == n) & (F.lit(k) <= filled) & (F.lower(F.regexp_extract(start, r"^[^.,?!'\"]*", 0)) == word), F.lit(False))


@constraint("keywords:key_sentences")
def c_key_sentences(text, key_sentences: list[str], n: int) -> Column:
    return F.size(F.array_intersect(F.array(*[F.lit(s) for s in key_sentences]), sentence_list(text))) == n


@constraint("keywords:forbidden_words")
def c_forbidden(text, words_: list[str]) -> Column:
    out = F.lit(True)
    for w in words_:
        out = out & ~col(text).rlike(r"(?iU)\b" + w + r"\b")
    return out


@constraint("edit:rephrase_paragraph")
def c_overlap(text, original: str, low: int, high: int) -> Column:
    count = lambda words_, w: F.size(F.filter(words_, lambda x: x == w))
    shared = lambda a, b: F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))
    n = let(word_tokens(F.lower(F.lit(original))), lambda a: let(word_tokens(F.lower(col(text))), lambda b: shared(a, b)))
    return n.between(low, high)


@constraint("combination:two_responses")
def c_two_responses(text) -> Column:
    parts = split_plain(text, "******")
    good = F.filter(parts, lambda p: ~blank(p))
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    return ~F.exists(inner, blank) & (F.size(good) == 2) & (strip(F.try_element_at(good, F.lit(1))) != strip(F.try_element_at(good, F.lit(2))))


@constraint("combination:repeat_prompt")
def c_repeat(text, prompt: str) -> Column:
    return F.startswith(F.lower(strip(text)), F.lower(strip(F.lit(prompt))))


@constraint("startend:end_checker")
def c_end(text, phrase: str) -> Column:
    return F.endswith(F.lower(F.regexp_replace(strip(text), '^"+|"+$', "")), F.lit(phrase.strip().lower()))


@constraint("detectable_format:title")
def c_title(text) -> Column:
    found = F.regexp_extract_all(col(text), rx(r"<<[^\n]+>>"), F.lit(0))
    return F.exists(found, lambda t: ~blank(F.regexp_replace(t, r"^<+|>+$", "")))


@constraint("keywords:letter_frequency", "letters:letter_counting2")
def c_letters(text, letter: str, relation: str, n: int) -> Column:
    low = F.lower(col(text))
    return compare(F.length(low) - F.length(F.replace(low, F.lit(letter.lower()), F.lit(""))), relation, n)


def _cased(text) -> Column:
    return col(text).rlike(r"\p{Lu}|\p{Ll}|\p{Lt}")


@constraint("change_case:english_capital")
def c_capital(text) -> Column:
    return _cased(text) & ~col(text).rlike(r"\p{Ll}|\p{Lt}") & F.coalesce(language_of(text) == "en", F.lit(True))


@constraint("change_case:english_lowercase")
def c_lowercase(text) -> Column:
    return _cased(text) & ~col(text).rlike(r"\p{Lu}|\p{Lt}") & F.coalesce(language_of(text) == "en", F.lit(True))


@constraint("punctuation:no_comma")
def c_no_comma(text) -> Column:
    return ~col(text).contains(",")


@constraint("change_case:capital_word_frequency")
def c_capital_words(text, relation: str, n: int) -> Column:
    upper = F.filter(tokens(text), lambda w: w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}|\p{Lt}"))
    return compare(F.size(upper), relation, n)


@constraint("startend:quotation")
def c_quotation(text) -> Column:
    s = strip(text)
    return (F.length(s) > 1) & s.startswith('"') & s.endswith('"')


@constraint("copy:repeat_phrase")
def c_repeat_phrase(text, phrase: str, n: int) -> Column:
    given = phrase.split()
    found = F.regexp_extract_all(col(text), rx(given[0] + r" .*? " + given[-1]), F.lit(0))
    want = F.array(*[F.lit(w) for w in given])
    wrong = F.transform(found, lambda p: F.when(F.size(words(p)) == len(given), F.aggregate(F.zip_with(words(p), want, lambda x, y: x != y), F.lit(0), lambda a, d: a + d.cast("int"))).otherwise(99))
    return (F.size(found) == n) & ~F.exists(wrong, lambda d: d > 1) & F.coalesce(F.try_element_at(wrong, F.lit(-1)) == 1, F.lit(False))


@constraint("copy:copy", "copy:copying_simple")
def c_copy(text, prompt: str) -> Column:
    return F.lower(strip(text)) == F.lower(strip(F.lit(prompt)))


@constraint("new:copy_span_idx")
def c_copy_span(text, prompt: str, start: int, end: int) -> Column:
    return F.lower(strip(text)) == prompt[start:end].strip().lower()


@constraint("copy:copying_multiple")
def c_copies(text, prompt: str, n: int) -> Column:
    parts = split_plain(text, "******")
    return (F.size(parts) == n) & F.forall(parts, lambda p: F.lower(strip(p)) == prompt.strip().lower())


@constraint("detectable_format:sentence_hyphens")
def c_hyphens(text) -> Column:
    parts, gold = F.split(col(text), "-", -1), sentence_list(F.replace(col(text), F.lit("-"), F.lit(" ")))
    n = F.least(F.size(parts), F.size(gold))
    return F.forall(F.zip_with(F.slice(parts, 1, n), F.slice(gold, 1, n), lambda p, g: (p == strip(p)) & (p == g)), lambda ok: ok)


@constraint("keywords:no_adjacent_consecutive")
def c_no_adjacent(text) -> Column:
    first = F.transform(words(F.lower(col(text))), lambda w: F.ascii(F.substring(w, 1, 1)))
    n = F.greatest(F.size(first) - 1, F.lit(0))
    return ~F.exists(F.zip_with(F.slice(first, 1, n), F.slice(first, 2, n), lambda a, b: b - a), lambda d: d == 1)


@constraint("detectable_format:square_brackets")
def c_brackets(text) -> Column:
    return F.forall(words(text), lambda w: w.startswith("[") & w.endswith("]"))


@constraint("keywords:exclude_word_harder")
def c_exclude(text, keyword: str) -> Column:
    return ~col(text).contains(" " + keyword + " ")


@constraint("first_word:first_word_sent")
def c_first_word_sentences(text, word: str) -> Column:
    return F.forall(sentence_list(text), lambda s: F.lower(F.try_element_at(words(s), F.lit(1))) == word.lower())


@constraint("first_word:first_word_answer")
def c_first_word(text, word: str) -> Column:
    return F.coalesce(F.lower(F.try_element_at(words(text), F.lit(1))) == word.lower(), F.lit(False))


def _bare(w: Column) -> Column:
    return F.lower(F.regexp_replace(w, r"(?U)[^\w\s]", ""))


@constraint("last_word:last_word_sent")
def c_last_word_sentences(text, word: str) -> Column:
    return F.forall(sentence_list(text), lambda s: _bare(F.try_element_at(words(s), F.lit(-1))) == word.lower())


@constraint("last_word:last_word_answer")
def c_last_word(text, word: str) -> Column:
    return F.coalesce(_bare(F.try_element_at(words(text), F.lit(-1))) == word.lower(), F.lit(False))


@constraint("detectable_format:bigram_wrapping")
def c_bigrams(text) -> Column:
    w = words(text)
    pairs = F.when(F.size(w) >= 2, F.sequence(F.lit(1), F.size(w) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.forall(pairs, lambda i: F.startswith(F.element_at(w, i), F.lit("<<")) & F.endswith(F.element_at(w, i + 1), F.lit(">>")))


@constraint("punctuation:punctuation_dot")
def c_no_dot(text) -> Column:
    return ~col(text).contains(".")


@constraint("punctuation:punctuation_exclamation")
def c_no_exclamation(text) -> Column:
    return ~col(text).contains("!")


@constraint("count:lowercase_counting")
def c_lowercase_words(text, n: int) -> Column:
    return count_matches(text, r"(?U)\b[a-z]+\b") <= n


@constraint("letters:letter_counting")
def c_letter_count(text, relation: str, n: int) -> Column:
    return compare(count_matches(text, "[a-zA-Z]"), relation, n)


@constraint("count:counting_composition")
def c_composition(text, n_sentences: int, n_words: int) -> Column:
    parts = F.split(col(text), r"(?U)\s?\*\*\*\s?", -1)
    count, whole = _divided(text, r"(?U)\s?\*\*\*\s?")
    right = F.forall(parts, lambda p: (F.size(sentence_list(p)) == n_sentences) & F.forall(sentence_list(p), lambda s: F.size(tokens(s)) == n_words))
    return whole & right & (count == 3)


@constraint("count:count_unique")
def c_unique(text) -> Column:
    return F.size(F.array_distinct(tokens(text))) == F.size(tokens(text))


@constraint("keywords:palindrome")
def c_palindrome(text) -> Column:
    return F.exists(words(text), lambda w: w == F.reverse(w))


@constraint("keywords:keyword_specific_position")
def c_position(text, keyword: str, n: int, m: int) -> Column:
    return F.coalesce(F.try_element_at(tokens(F.try_element_at(sentence_list(text), F.lit(n))), F.lit(m)) == keyword, F.lit(False))


@constraint("keywords:start_end")
def c_start_end(text) -> Column:
    w = F.transform(tokens(text), F.lower)
    return (F.size(w) >= 2) & F.coalesce(F.try_element_at(w, F.lit(1)) == F.try_element_at(w, F.lit(-1)), F.lit(False))


#: Families of which one constraint at most can hold.
_FAMILIES = [
    {"combination:two_responses", "combination:repeat_prompt", "copy:copy", "copy:copying_simple", "copy:copying_multiple", "new:copy_span_idx", "detectable_format:constrained_response", "detectable_format:json_format"},
    {"change_case:english_capital", "change_case:english_lowercase", "count:lowercase_counting", "change_case:capital_word_frequency"},
    {"length_constraints:number_paragraphs", "paragraphs:paragraphs", "paragraphs:paragraphs2", "length_constraints:nth_paragraph_first_word", "count:counting_composition"},
    {"language:response_language", "change_case:english_capital"},
    {"language:response_language", "change_case:english_lowercase"},
    {"startend:end_checker", "startend:quotation", "detectable_format:json_format"},
]
#: What fixes the text as a whole conflicts with everything but itself.
_WHOLE = {"detectable_format:constrained_response", "copy:copy", "copy:copying_simple", "copy:copying_multiple", "new:copy_span_idx"}


def conflicts(a: str, b: str) -> bool:
    """Whether two constraints cannot be asked for together."""
    return a == b or bool({a, b} & _WHOLE) or any({a, b} <= family for family in _FAMILIES)


def follows(text, constraints: list[tuple[str, dict]]) -> Column:
    """Share of the constraints that the text meets; 0 without any."""
    if not constraints:
        return F.lit(0.0)
    met = [check(text, name, options).cast("double") for name, options in constraints]
    return sum(met[1:], met[0]) / len(met)


#: Parameter names of other registries for the same constraints.
PARAMETERS = {
    "num_sentences": "n", "num_placeholders": "n", "num_bullets": "n", "num_highlights": "n", "num_sections": "n", "num_paragraphs": "n", "num_words": "n", "frequency": "n", "let_frequency": "n", "capital_frequency": "n",
    "small_n": "n", "N": "n", "num_key_sentences": "n", "let_relation": "relation", "capital_relation": "relation", "section_spliter": "splitter", "postscript_marker": "marker", "nth_paragraph": "k", "first_word": "word",
    "last_word": "word", "forbidden_words": "words_", "prompt_to_repeat": "prompt", "end_phrase": "phrase", "n_start": "start", "n_end": "end", "n_sent": "n_sentences", "keyword1": "once", "keyword2": "twice",
    "original_paragraph": "original", "original_message": "reference",
}


def check(text, name: str, options: dict) -> Column:
    """A constraint by name with its parameters under either name; those it does not take are left out. Never null."""
    f = CONSTRAINTS[name]
    takes = set(inspect.signature(f).parameters) - {"text"}
    given = {PARAMETERS.get(k, k) if k not in takes else k: v for k, v in options.items() if v is not None}
    return F.coalesce(f(text, **{k: v for k, v in given.items() if k in takes}), F.lit(False))
