"""Literal cases of text functions, normal forms, verifiers, predicates, templates and formulas."""

import math

import pytest
from pyspark.sql import functions as F

from granary.functions import instructions as I  # noqa: E741
from granary.functions import maths, templates, text, utilization, verifiers


def value(spark, column, **row):
    row = row or {"x": 1.0}
    names = list(row)
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} {'string' if isinstance(row[n], (str, type(None))) else 'array<double>' if isinstance(row[n], list) else 'double'}" for n in names)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("\\frac12", "\\frac{1}{2}"), ("\\dfrac{1}{2}", "\\frac{1}{2}"), ("0.5", "\\frac{1}{2}"), ("3/4", "\\frac{3}{4}"), (".5x", "0.5x"), ("x = 7", "7"), ("\\sqrt3", "\\sqrt{3}"), ("10\\%", "10"), ("5 \\text{ cm}", "5"), ("\\left(1, 2\\right)", "(1,2)"), ("", ""), ("\\frac1{72}", "\\frac{1}{72}")],
)
def test_strip_answer(spark, given, want):
    assert value(spark, maths.strip_answer("t"), t=given) == want


@pytest.mark.parametrize(
    ("given", "want"), [("x = 12 dollars", "12"), ("\\boxed{5}", "5"), ("1,000", "1000"), ("\\frac12", "\\frac{1}{2}"), ("the $7$ cats", "7"), ("\\text{ab}", "ab"), ("3 hours", "3")]
)
def test_normalize_final_answer(spark, given, want):
    assert value(spark, maths.normalize_final_answer("t"), t=given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("a \\boxed{1} b \\boxed{x^{2}}", "x^{2}"), ("\\boxed{\\frac{1}{2}} end", "\\frac{1}{2}"), ("\\fbox{3}", "3"), ("\\boxed{open", None), ("nothing", None), ("\\boxed 4$ x", "4")],
)
def test_last_boxed(spark, given, want):
    assert value(spark, text.last_boxed("t"), t=given) == want


@pytest.mark.parametrize(
    ("name", "prediction", "label", "want"),
    [
        ("gsm8k", "so 1,234 apples", "1234", 1.0), ("gsm8k", "it is -5", "5", 1.0), ("gsm8k", "1,2,3", "3", 1.0), ("gsm8k", "none", "none", 1.0),
        ("math", "thus \\boxed{\\frac{1}{2}}", "0.5", 1.0), ("math", "the answer is $3$ or $4$", "4", 1.0), ("math", "\\boxed{2}", "3", 0.0),
        ("math-verify", "\\boxed{1,000}", "1000", 1.0), ("math-verify", "\\boxed{1}", "100", 0.0),
        ("strict_math", "Final Answer: The final answer is $7$. I hope it is correct.", "7", 1.0), ("strict_math", "\\boxed{7}", "7", 0.0),
        ("flan", "Well. The answer is: The Cat.", "cat", 1.0), ("flan", "dog", "cat", 0.0),
        ("string_matcher", "<answer>A b</answer>", "b", 1.0), ("string_matcher", "A b", "b", 0.0),
        ("string_f1", "<think>x</think><answer>red blue</answer>", "blue green", 0.5), ("puzzle", "<think>no</think> <answer>Right!</answer>", "right", 1.0),
        ("re_search_f1", "<finish>Paris</finish>", '["paris", "rome"]', 1.0), ("re_search_f1", "<finish>Oslo</finish>", '["paris"]', 0.1), ("re_search_f1", "Oslo", "oslo", 0.0),
        ("re_search", "<FINISH> the Rome </finish>", '["paris", "rome"]', 1.0), ("re_search", "<finish></finish>", "x", 0.0),
        ("max_length", "a b c", "5", 1 - 2 / 32768), ("up_to_max_length", "a b c", "5", 1.0),
    ],
)
def test_verifiers(spark, name, prediction, label, want):
    assert value(spark, verifiers.verify(F.lit(name.upper()), "p", "l"), p=prediction, l=label) == pytest.approx(want)


def test_unknown_verifier_gives_null(spark):
    assert value(spark, verifiers.verify(F.lit("none"), "p", "l"), p="a", l="a") is None


@pytest.mark.parametrize(
    ("given", "want"), [("4/5", 0.8), ("85%", 0.85), ("score 3.5", 3.5), ("Yes, good", 1.0), ("bad", 0.0), ("???", 0.0)]
)
def test_parse_score(spark, given, want):
    assert value(spark, text.parse_score("t"), t=given) == pytest.approx(want)


def test_json_score(spark):
    assert value(spark, text.parse_json_score("t", 10.0), t='```json\n{"REASONING": "x", "SCORE": 7}\n```') == pytest.approx(0.7)
    assert value(spark, text.parse_json_score("t"), t='{"SCORE": "4", broken') == 4.0


@pytest.mark.parametrize(
    ("name", "given", "options", "want"),
    [
        ("has_keywords", "Alpha beta", {"keywords": ["ALPHA", "beta"]}, True), ("keyword_frequency", "a b a", {"word": "a", "n": 2}, True), ("no_forbidden_words", "xyz", {"forbidden": ["Y"]}, False),
        ("letter_frequency", "aAa", {"letter": "a", "n": 2}, True), ("paragraph_count", "a\n* * *\nb", {"n": 2}, True), ("paragraph_count", "a\n* * *\n", {"n": 2}, False),
        ("word_count", "a b c", {"n": 3, "quantifier": "around"}, True), ("sentence_count", "One. Two? Three", {"n": 3, "quantifier": "at least"}, True), ("paragraph_starts", "A b\n\nC d", {"n": 2, "first_word": "C", "i": 2}, True),
        ("has_postscript", "x P.S. y", {"marker": "P.S."}, True), ("has_postscript", "x P.S.", {"marker": "P.S."}, False), ("placeholders", "[a] [b]", {"n": 2}, True), ("bullet_points", "* a\n- b\nc", {"n": 2}, True),
        ("has_title", "<<T>> x", {}, True), ("is_choice", "yes", {"options": ["oh yes"]}, True), ("highlighted", "*a* b *c*", {"n": 2}, True), ("section_count", "S1 S2", {"n": 2, "splitter": "S"}, True),
        ("valid_json", '{"a": 1}', {}, True), ("valid_json", "{", {}, False), ("repeats_prompt", "ab c", {"prompt": "ab"}, True), ("two_responses", "a******b", {}, True), ("two_responses", "a******a", {}, False),
        ("uppercase", "AB 1", {}, True), ("lowercase", "aB", {}, False), ("capital_word_count", "AB cd EF", {"n": 2, "quantifier": "around"}, True), ("ends_with", "the end", {"phrase": "end"}, True),
        ("wrapped_in_quotes", '"a"', {}, True), ("no_commas", "a, b", {}, False), ("response_language", "the cat is on the mat and it was not there", {"language": "en"}, True),
    ],
)
def test_simple_instructions(spark, name, given, options, want):
    assert value(spark, I.SIMPLE[name]("t", **options), t=given) is want


@pytest.mark.parametrize(
    ("name", "given", "options", "want"),
    [
        ("length_constraints:number_sentences", "Dr. Who came. He left! Why?", {"relation": "at least", "n": 3}, True), ("length_constraints:number_sentences", "Dr. Who came. He left! Why?", {"relation": "at least", "n": 4}, False),
        ("detectable_format:number_bullet_lists", "* a\n- b\n** c", {"n": 2}, True), ("detectable_format:number_highlighted_sections", "*a* **b** **", {"n": 2}, True),
        ("detectable_format:multiple_sections", "SECTION 1 a SECTION 2 b", {"splitter": "SECTION", "n": 2}, True), ("length_constraints:number_paragraphs", "a\n***\nb", {"n": 2}, True), ("length_constraints:number_paragraphs", "a *** *** b", {"n": 2}, False),
        ("paragraphs:paragraphs2", "a\n\nb", {}, True), ("detectable_content:postscript", "x\np.s. y", {"marker": "P.S."}, True), ("edit:rephrase", "a *b* c", {"reference": "a *d* c"}, True), ("keywords:existence", "Hello", {"keywords": ["hel+o"]}, True),
        ("keywords:word_once", "one two", {"keyword": "one"}, True), ("count:count_increment_word", "a b b", {"once": "a", "twice": "b"}, True), ("detectable_format:json_format", "```json\n[1]\n```", {}, True),
        ("length_constraints:nth_paragraph_first_word", "x\n\n'Hello, you", {"n": 2, "k": 2, "word": "hello"}, True), ("keywords:forbidden_words", "a badge", {"words_": ["bad"]}, True), ("edit:rephrase_paragraph", "a b c", {"original": "b c d", "low": 2, "high": 2}, True),
        ("combination:two_responses", "a******b", {}, True), ("combination:repeat_prompt", " Do it. ok", {"prompt": "do it."}, True), ("startend:end_checker", 'x the End"', {"phrase": "the end"}, True), ("detectable_format:title", "<< >>", {}, False),
        ("change_case:english_capital", "THE CAT IS ON THE MAT", {}, True), ("change_case:english_lowercase", "123", {}, False), ("change_case:capital_word_frequency", "AB Cd EF", {"relation": "at least", "n": 2}, True), ("startend:quotation", ' "a" ', {}, True),
        ("copy:repeat_phrase", "go to the home now and go to a home now", {"phrase": "go to the home now", "n": 2}, True), ("copy:copy", " Ab ", {"prompt": "aB"}, True), ("new:copy_span_idx", "ell", {"prompt": "Hello", "start": 1, "end": 4}, True),
        ("copy:copying_multiple", "a******A", {"prompt": "a", "n": 2}, True), ("keywords:no_adjacent_consecutive", "ant bee", {}, False), ("keywords:no_adjacent_consecutive", "ant cat", {}, True), ("detectable_format:square_brackets", "[a] [b]", {}, True),
        ("first_word:first_word_sent", "So it is. So be it.", {"word": "so"}, True), ("first_word:first_word_answer", "", {"word": "so"}, False), ("last_word:last_word_sent", "It is so. Be it so!", {"word": "so"}, True), ("last_word:last_word_answer", "be so.", {"word": "so"}, True),
        ("detectable_format:bigram_wrapping", "<<a b>> <<c d>>", {}, True), ("count:lowercase_counting", "a b C", {"n": 2}, True), ("letters:letter_counting", "ab1", {"relation": "less than", "n": 3}, True),
        ("count:count_unique", "a b a", {}, False), ("keywords:palindrome", "xx anna", {}, True), ("keywords:keyword_specific_position", "Ab bc cd. De ef fg.", {"keyword": "ef", "n": 2, "m": 2}, True), ("keywords:start_end", "Go now go", {}, True),
        ("language:response_language", "12345", {"language": "fr"}, True), ("count:counting_composition", "aa bb. cc dd.***ee ff. gg hh.***ii jj. kk ll.", {"n_sentences": 2, "n_words": 3}, True), ("detectable_format:sentence_hyphens", "One is.-Two is.", {}, True),
    ],
)
def test_constraints(spark, name, given, options, want):
    assert value(spark, I.CONSTRAINTS[name]("t", **options), t=given) is want


def test_constraint_share_and_conflicts(spark):
    share = I.follows("t", [("punctuation:no_comma", {}), ("startend:quotation", {})])
    assert value(spark, share, t="no commas") == 0.5
    assert I.conflicts("copy:copy", "punctuation:no_comma") and not I.conflicts("punctuation:no_comma", "startend:quotation")
    assert len(I.CONSTRAINTS) >= 54 and len(I.SIMPLE) == 25


def chat(*turns):
    return F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in turns])


def test_templates(spark):
    m = chat(("user", "Hi"), ("assistant", "<think>\nx</think>\n\nYo"), ("user", "And"), ("assistant", "<think>y</think>Go"))
    get = lambda name, **o: value(spark, templates.render(m, name, **o))
    assert get("concat_space").endswith("Go</s>") and get("named").startswith("User: Hi\n\nAssistant: ")
    assert get("bars") == "<|user|>\nHi\n<|assistant|>\n<think>\nx</think>\n\nYo</s>\n<|user|>\nAnd\n<|assistant|>\n<think>y</think>Go</s>"
    last = get("im_thinking_last", system="S")
    assert last.startswith("<|im_start|>system\nS") and "<|im_start|>assistant\nYo<|im_end|>" in last and last.endswith("<think>y</think>Go</s>")
    assert get("bars_reasoning", prompt=True).endswith("<|assistant|>\n<think>") and "x</think>" not in get("bars_reasoning")
    assert get("assistant_only") == "<think>\nx</think>\n\nYo<think>y</think>Go"


def test_losses_and_divergences(spark):
    assert value(spark, maths.preference_loss(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), 1.0)) == pytest.approx(math.log(1 + math.exp(-1)))
    assert value(spark, maths.simple_preference_loss(F.lit(1.0), F.lit(0.5), 2.0, 0.5)) == pytest.approx(math.log(2))
    kl = value(spark, maths.kl_estimates(F.lit(0.5), F.lit(2.0)))
    assert (kl.linear, kl.quadratic, kl.weighted) == (0.5, 0.125, 1.0) and kl.stable == pytest.approx(math.exp(-0.5) - 0.5)
    assert value(spark, maths.masked_mean("v", "m"), v=[1.0, 2.0, 9.0], m=[1.0, 1.0, 0.0]) == 1.5


def test_utilization_is_a_share(spark):
    m = utilization.Model(layers=28, hidden=3584, intermediate=18944, vocabulary=152064, heads=28, kv_heads=4, head_dim=128)
    assert 7e9 < m.weights() < 8e9
    p, r = F.lit(1000.0), F.lit(500.0)
    share = utilization.flops_share(m.prefill_flops(p) + m.decode_flops(p, r), F.lit(10.0), F.lit(1.0), 1e15)
    read = utilization.bytes_share(m.decode_bytes(p, r, F.lit(1.0)), F.lit(10.0), F.lit(1.0), 3.3e12)
    assert 0 < value(spark, share) < 100 and 0 < value(spark, read) < 100


SAME = [("x^2+2x+1", "(x+1)^2"), ("\\frac{1}{\\sqrt{2}}", "\\frac{\\sqrt{2}}{2}"), ("2\\sqrt{3}", "\\sqrt{12}"), ("\\frac12", "0.5"), ("1\\frac{1}{2}", "\\frac{3}{2}"), ("(1,2)", "(1, 2)"), ("x=5", "5"), ("\\{1,2\\}", "\\{2,1\\}"), ("1,2", "2,1"), ("\\pi r^2", "r^2\\pi"), ("\\sin^2 x+\\cos^2 x", "1"), ("1,000", "1000"), ("2^{10}", "1024"), ("y=2x+1", "y=1+2x"), ("x+y=2", "2x+2y=4"), ("1\\pm\\sqrt{2}", "1+\\sqrt{2},1-\\sqrt{2}"), ("\\log_2 8", "3"), ("5!", "120"), ("\\binom{4}{2}", "6"), ("e^{i\\pi}", "-1"), ("\\dfrac{a}{b}", "a/b"), ("[0,\\infty)", "[0, \\infty)"), ("\\left(\\frac{1}{2},3\\right)", "(0.5,3)"), ("|{-3}|", "3"), ("50\\%", "50"), ("3x\\cdot 2", "6x"), ("\\sqrt[3]{8}", "2"), ("x_1+x_2", "x_2+x_1")]
DIFFERENT = [("x^2", "x^3"), ("(1,2)", "(2,1)"), ("\\{1,2\\}", "\\{1,3\\}"), ("x+1", "y+1"), ("[0,1]", "(0,1)"), ("2", "3"), ("", "1"), ("\\foo", "1"), ("x=5", "y=5"), ("1,2", "1,2,3"), ("1/0", "2"), ("(1,2)", "1,2,3"), ("x+y=2", "x+y=3"), ("a b c is", "d")]


def test_formulas_are_compared_by_value(spark):
    from pyspark.sql import functions as F

    from granary.functions import algebra, verifiers

    assert all(algebra.same(a, b) and algebra.same(b, a) for a, b in SAME)
    assert not any(algebra.same(a, b) or algebra.same(b, a) for a, b in DIFFERENT)
    assert not algebra.same("(" * 500 + "1" + ")" * 500, "2") and not algebra.same("9^{9^{9^9}}", "1") and not algebra.same(None, "1") and not algebra.same("x" * 5000, "y")
    # the plain rules drop a name before an equals sign, whichever it is
    rows = spark.createDataFrame([(f"so \\boxed{{{a}}}", b, True) for a, b in SAME if b] + [(f"so \\boxed{{{a}}}", b, False) for a, b in DIFFERENT if a and b and "=5" not in a] + [(None, "1", False), ("no answer", None, False)], "p string, l string, ok boolean")
    got = rows.select("p", "l", "ok", (verifiers.math("p", "l") == 1).alias("m"), (verifiers.math_value("p", "l") == 1).alias("v"), (verifiers.math("p", "l", symbolic=False) <= verifiers.math("p", "l")).alias("more")).collect()
    assert [tuple(r) for r in got if not (r["m"] == r["v"] == r["ok"] and r["more"])] == []


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ('"a" b', False), ("1 2", False), ("[1] [2]", False), ("1] [2", False), ("1,2", False), ('"a","b"', False), ('{"a": 1} x', False), ("47 six", False), ("", False), (" ", False), (None, False), ("'a'", False), ("{a: 1}", False), ("01", False), ('"a\tb"', False), ("+Infinity", False), ("[+INF]", False),
        (" 1\n", True), ('"a b"', True), ('"+Ink"', True), ('{"a": 1, "a": 2}', True), ("null", True), ("[[], {}]", True), ("NaN", True), ('{"a": -Infinity}', True), ("7" * 1500, True), ("[" * 900 + "]" * 900, True), ('"]["', True),
    ],
)
def test_json_is_one_whole_value(spark, given, want):
    assert value(spark, I.check("t", "detectable_format:json_format", {}), t=given) == want


@pytest.mark.parametrize(("given", "want"), [('"token = "3f" end"', False), ("4754 Ieein +1******4754 ieein +1", False), ("```json\n[1]\n```", False), ('"a \\" b"', True), ("-0.5e3", True)])
def test_valid_json_is_one_whole_value(spark, given, want):
    assert value(spark, I.valid_json("t"), t=given) == want


@pytest.mark.parametrize("end", ["\r", "\u0085", "\u2028"])
def test_marks_reach_across_all_but_line_feeds(spark, end):
    for mark, found in (("[a{}b]", I.placeholders("t", 1)), ("<<a{}b>>", I.has_title("t")), ("*a{}b*", I.highlighted("t", 1))):
        assert value(spark, found, t=mark.format(end)) and not value(spark, found, t=mark.format("\n"))
