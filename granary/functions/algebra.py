"""Whether two formulas in LaTeX are the same, by value.

A formula is parsed by recursive descent and evaluated, over the complex numbers, at a few fixed points of its
variables: two that agree at all of them are the same but for chance. Lists, sets, intervals, equations, signs such as
plus-minus and mixed numbers are compared by their parts. What cannot be parsed is no formula and equals nothing.

Texts come in Arrow batches; the plain rules of ``maths`` stay in the JVM beside it.
"""

from __future__ import annotations

import cmath
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .text import col

Value = Callable[[dict[str, complex]], complex]
#: The longest formula that is parsed, and how deep it may be nested.
LONGEST, DEEPEST = 2000, 60
#: Points at which formulas are compared, and how near values must be.
POINTS, NEAR = 4, 1e-9

FUNCTIONS: dict[str, Callable[[complex], complex]] = {
    "sin": cmath.sin, "cos": cmath.cos, "tan": cmath.tan, "sec": lambda z: 1 / cmath.cos(z), "csc": lambda z: 1 / cmath.sin(z), "cot": lambda z: 1 / cmath.tan(z),
    "arcsin": cmath.asin, "arccos": cmath.acos, "arctan": cmath.atan, "sinh": cmath.sinh, "cosh": cmath.cosh, "tanh": cmath.tanh, "ln": cmath.log, "exp": cmath.exp,
}
GREEK = frozenset("alpha beta gamma delta theta lambda mu nu rho sigma phi varphi omega infty".split())
#: What layout and units leave behind.
DROPPED = re.compile(r"\\(?:left|right|displaystyle|limits|bigl?|bigr?|Bigl?|Bigr?)(?![A-Za-z])|\\[,;:! ]|\\(?:quad|qquad)(?![A-Za-z])|\^\{?\\circ\}?|\\%|%|\\\$|\$|\\(?:text|mathrm|mbox|textbf|mathbf)\{[^{}]*\}|~")
TOKEN = re.compile(r"\s*(?:(?P<number>\d{1,3}(?:,\d{3})+(?:\.\d+)?(?!\d)|\d+(?:\.\d+)?|\.\d+)|\\(?P<name>[A-Za-z]+)|(?P<letter>[A-Za-z])|(?P<sign>[-+*/^_()\[\]{}|!=,]))")


class Unknown(ValueError):
    """Not a formula of this grammar."""


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise Unknown(text[at:])
            kind = m.lastgroup or ""
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = self.depth = 0
        self.bars = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("", "")

    def take(self, sign: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if not token[0] or sign is not None and token[1] != sign:
            raise Unknown(sign or "end")
        self.at += 1
        return token

    def whole(self) -> Value:
        out = self.sum()
        if self.at < len(self.tokens):
            raise Unknown(self.peek()[1])
        return out

    def sum(self) -> Value:
        self.depth += 1
        if self.depth > DEEPEST:
            raise Unknown("too deep")
        out = self.product()
        while self.peek() in (("sign", "+"), ("sign", "-")):
            sign, left, right = self.take()[1], out, self.product()
            out = (lambda e, a=left, b=right: a(e) + b(e)) if sign == "+" else (lambda e, a=left, b=right: a(e) - b(e))
        self.depth -= 1
        return out

    def product(self) -> Value:
        out = self.signed()
        while True:
            kind, token = self.peek()
            if (kind, token) in (("sign", "*"), ("sign", "/")) or kind == "name" and token in ("cdot", "times", "div"):
                self.take()
                left, right = out, self.signed()
                out = (lambda e, a=left, b=right: a(e) / b(e)) if token in ("/", "div") else (lambda e, a=left, b=right: a(e) * b(e))
            elif kind in ("number", "letter") or kind == "name" or (kind, token) in (("sign", "("), ("sign", "{")) or (kind, token) == ("sign", "|") and not self.bars:
                left, right = out, self.power()
                out = lambda e, a=left, b=right: a(e) * b(e)
            else:
                return out

    def signed(self) -> Value:
        if self.peek() in (("sign", "+"), ("sign", "-")):
            sign, inner = self.take()[1], self.signed()
            return inner if sign == "+" else (lambda e: -inner(e))
        return self.power()

    def power(self) -> Value:
        mixed = self.peek()[0] == "number" and self.peek()[1].isdigit() and self.peek(1) == ("name", "frac") and self.peek(3)[0] == "number"
        base = self.atom()
        if mixed:  # a whole number right before a fraction of numbers
            whole, part = base, self.atom()
            return lambda e: whole(e) + part(e)
        while self.peek() == ("sign", "!"):
            self.take()
            base = self.factorial(base)
        if self.peek() == ("sign", "^"):
            self.take()
            exponent = self.signed() if self.peek()[1] == "-" else self.argument()
            return lambda e, a=base, b=exponent: a(e) ** b(e)
        return base

    @staticmethod
    def factorial(inner: Value) -> Value:
        def value(e: dict) -> complex:
            n = inner(e)
            if n.imag or n.real < 0 or n.real > 170 or n.real != int(n.real):
                raise Unknown("factorial")
            out = 1
            for i in range(2, int(n.real) + 1):
                out *= i
            return complex(out)

        return value

    def argument(self) -> Value:
        """A braced group, or a single atom; of a number without braces its first digit only."""
        kind, token = self.peek()
        if kind == "number" and len(token) > 1 and token.isdigit():
            self.tokens[self.at] = ("number", token[1:])
            return lambda e, v=complex(int(token[0])): v
        return self.atom()

    def inside(self, end: str) -> Value:
        out = self.sum()
        self.take(end)
        return out

    def atom(self) -> Value:
        kind, token = self.take()
        if kind == "number":
            return lambda e, v=complex(float(token.replace(",", ""))): v
        if kind == "letter":
            if token in ("e", "i"):
                return lambda e, v=complex(cmath.e) if token == "e" else 1j: v
            return self.variable(token)
        if (kind, token) in (("sign", "("), ("sign", "{"), ("sign", "[")):
            bars, self.bars = self.bars, 0
            out = self.inside({"(": ")", "{": "}", "[": "]"}[token])
            self.bars = bars
            return out
        if (kind, token) == ("sign", "|"):
            self.bars += 1
            inner = self.inside("|")
            self.bars -= 1
            return lambda e: complex(abs(inner(e)))
        if kind == "name":
            return self.command(token)
        raise Unknown(token)

    def variable(self, name: str) -> Value:
        if self.peek() == ("sign", "_"):
            self.take()
            if self.peek() == ("sign", "{"):
                self.take()
                while self.peek()[1] not in ("}", ""):
                    name += "_" + self.take()[1]
                self.take("}")
            else:
                name += "_" + self.take()[1]
        return lambda e: e[name]

    def command(self, name: str) -> Value:
        if name in ("frac", "dfrac", "tfrac"):
            over, under = self.argument(), self.argument()
            return lambda e: over(e) / under(e)
        if name == "sqrt":
            root = None
            if self.peek() == ("sign", "["):
                self.take()
                root = self.inside("]")
            inner = self.argument()
            return (lambda e: cmath.sqrt(inner(e))) if root is None else (lambda e: inner(e) ** (1 / root(e)))
        if name == "pi":
            return lambda e: complex(cmath.pi)
        if name in GREEK:
            return self.variable("\\" + name)
        if name == "binom":
            n, k = self.argument(), self.argument()
            top, bottom, rest = self.factorial(n), self.factorial(k), self.factorial(lambda e: n(e) - k(e))
            return lambda e: top(e) / (bottom(e) * rest(e))
        if name in FUNCTIONS or name == "log":
            base = power = None
            if name == "log" and self.peek() == ("sign", "_"):
                self.take()
                base = self.argument()
            if self.peek() == ("sign", "^"):
                self.take()
                power = self.argument()
            inner = self.power()
            f = FUNCTIONS.get(name, cmath.log if base else cmath.log10)
            plain = (lambda e: f(inner(e)) / cmath.log(base(e))) if base else (lambda e: f(inner(e)))
            return plain if power is None else (lambda e: plain(e) ** power(e))
        raise Unknown(name)


class Point(dict):
    """A fixed value for every variable, told by its name and the point's number."""

    def __init__(self, number: int):
        self.number = number

    def __missing__(self, name: str) -> complex:
        seed = sum(ord(c) * 131**i for i, c in enumerate(name)) * 7919 + self.number * 104729
        self[name] = complex(0.3 + (seed * 2654435761 % 100003) / 57737.0)
        return self[name]


def values(text: str) -> list[complex] | None:
    """The formula's values at the points; None if it is none, or has no value at some."""
    try:
        f = Parser(text).whole()
        out = [complex(f(Point(i))) for i in range(POINTS)]
    except (Unknown, ArithmeticError, ValueError, RecursionError):
        return None
    return out if all(cmath.isfinite(v) for v in out) else None


def near(a: complex, b: complex) -> bool:
    return abs(a - b) <= NEAR * max(1.0, abs(a), abs(b))


def parts(text: str) -> list[str]:
    """What stands between commas outside all brackets; thousands are not parted."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{") - (c in ")]}")
        if c == "," and depth == 0 and not re.match(r"(?<!\d)\d{1,3}(?:,\d{3})+(?!\d)", text[max(0, i - 3) : i + 4].lstrip("+-( ")):
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


def clean(text: str) -> str:
    return DROPPED.sub("", text.replace("\\\\", "\\").replace("\\{", "\x01").replace("\\}", "\x02")).strip().rstrip(".").strip()


def same(a: str | None, b: str | None) -> bool:
    """Whether two answers are the same formula."""
    if a is None or b is None or max(len(a), len(b)) > LONGEST:
        return False
    a, b = clean(a), clean(b)
    if not a or not b:
        return False
    if a == b:
        return True
    for x, y in ((a, b), (b, a)):
        if "\\pm" in x:
            both = [x.replace("\\pm", "+"), x.replace("\\pm", "-")]
            others = [y.replace("\\pm", "+"), y.replace("\\pm", "-")] if "\\pm" in y else parts(y.strip("\x01\x02"))
            return unordered(both, others)
    if a[0] == "\x01" or b[0] == "\x01":
        if not (a[0] == b[0] == "\x01" and a[-1] == b[-1] == "\x02"):
            return False
        return unordered(parts(a[1:-1]), parts(b[1:-1]))
    for open_, shut in (("(", ")"), ("(", "]"), ("[", ")"), ("[", "]")):
        if a[0] == open_ and a[-1] == shut and len(parts(a[1:-1])) > 1 and enclosed(a):
            return b[0] == open_ and b[-1] == shut and enclosed(b) and ordered(parts(a[1:-1]), parts(b[1:-1]))
    if len(parts(a)) > 1 or len(parts(b)) > 1:
        return unordered(parts(a), parts(b))
    if a.count("=") == 1 or b.count("=") == 1:
        return equations(a, b)
    x, y = values(a), values(b)
    return x is not None and y is not None and all(map(near, x, y))


def enclosed(text: str) -> bool:
    """Whether the first bracket closes with the last character."""
    depth = 0
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if depth == 0:
            return i == len(text) - 1
    return False


def equations(a: str, b: str) -> bool:
    """An equation that names a variable is its right side; two others are the same if their differences are proportional."""
    sides = [x.split("=") if x.count("=") == 1 else [x] for x in (a, b)]
    named = [len(s) == 2 and re.fullmatch(r"\s*[A-Za-z]\w?\s*", s[0]) is not None for s in sides]
    if all(n or len(s) == 1 for n, s in zip(named, sides)) and (len(sides[0]) != len(sides[1]) or sides[0][0].strip() == sides[1][0].strip()):
        return same(sides[0][-1], sides[1][-1])
    if len(sides[0]) != 2 or len(sides[1]) != 2:
        return False
    x, y = (values(f"({s[0]})-({s[1]})") for s in sides)
    if x is None or y is None or not all(map(abs, x)) or not all(map(abs, y)):
        return False
    return all(near(x[0] / y[0], p / q) for p, q in zip(x, y))


def ordered(a: list[str], b: list[str]) -> bool:
    return len(a) == len(b) and all(map(same, a, b))


def unordered(a: list[str], b: list[str]) -> bool:
    left = list(b)
    for x in a:
        found = next((i for i, y in enumerate(left) if same(x, y)), None)
        if found is None:
            return False
        left.pop(found)
    return not left


def boxed(text: str) -> str | None:
    """The content of the last box with balanced braces."""
    at = max(text.rfind("\\boxed{"), text.rfind("\\fbox{"))
    if at < 0:
        return None
    start = text.index("{", at)
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[start + 1 : i]
    return None


PHRASE = re.compile(r"Final Answer: The final answer is(.*?)\. I hope it is correct\.")


def answers(text: str, last: bool) -> list[str]:
    """What a solution may mean as its answer: its box and its phrase, else (``last``) the last formula, else all of it."""
    named = [x for x in (boxed(text), *(m.strip() for m in PHRASE.findall(text + "I hope it is correct.")[:1])) if x]
    if named or not last:
        return named[:2]
    formulas = text.split("$")
    return [formulas[-2]] if len(formulas) > 2 else [text]


def _verdicts(last: bool):
    @F.pandas_udf(BooleanType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, labels in batches:
            yield pd.Series([t is not None and b is not None and any(same(a, b) for a in answers(t, last)) for t, b in zip(texts, labels)], dtype="boolean")

    return run


def answers_formula(prediction, label, last: bool) -> Column:
    """Whether the label is the same formula as an answer of the prediction.

    Both are columns or plain expressions: an Arrow function does not take what holds nested lambdas.
    """
    return F.coalesce(_verdicts(last)(col(prediction), col(label)), F.lit(False))
