r"""Grading of short mathematical answers: a scanner, a renderer over typed tokens, exact numbers.

An answer is scanned into tokens (number, unit, scale, command, group, connective, sign, space),
and each kind has one rule for how it is rendered. The rules:

* units with their plural and power, currency, percent signs and degree marks say nothing;
* `or` and `and` between answers are commas; million, billion, trillion are powers of ten;
* ``\frac{a}{b}``, ``\frac12`` and their d and t forms are `a/b`; ``\sqrt``, ``\pi``,
  ``\infty``, ``\cup``, ``\cdot``, ``\times`` have names or signs; ``\text{x}`` is x;
* ``,\!`` is a thousands separator; spaces vanish, but between two numbers they add (7 3/4);
* groups are transparent, letters are lower case, and a number that is whole is written so.

Two answers are equal if they render alike, or if both are decidable expressions of exact
rationals of the same value; a bare whole number equals no other form, and two plain fractions
are compared as written. What cannot be decided is not equal.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calibrant.functions.text import UNITS, extract_final_answer

_SCAN = re.compile(
    "|".join(
        (
            r"(?P<joiner> (?:or|and) )",
            r"(?P<degree>\^ *\\circ(?![a-zA-Z]))",
            r"(?P<thin>,\\! *)",
            r"(?P<scale>million|billion|trillion)",
            rf"(?P<unit>(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?:es)?s? *(?:\^[0-9]+)?)",
            r"(?P<number>\d+(?:\.\d*)?|\.\d+)",
            r"(?P<command>\\(?:[a-zA-Z]+|.))",
            r"(?P<open>\{)",
            r"(?P<close>\})",
            r"(?P<space>\s+)",
            r"(?P<sign>[^\\{}\s])",
        )
    ),
    re.S,
)
_SCALES = {"million": "*10^6", "billion": "*10^9", "trillion": "*10^12"}
_NAMES = {"\\sqrt": "sqrt", "\\pi": "pi", "\\infty": "inf", "\\cup": "U", "\\cdot": "*", "\\times": "*"}
_FRACTIONS = ("\\frac", "\\dfrac", "\\tfrac")
_SILENT = ("\\text", "\\mathrm", "\\left", "\\right", "\\!", "\\,", "\\;", "\\:", "\\ ", "\\%", "\\$")


def last_box(text: str | None) -> str | None:
    r"""STR-03: from the last \boxed (\fbox counts as one) to where its braces close; null if they do not."""
    if not text:
        return None
    _, mark, tail = text.replace("\\fbox", "\\boxed").rpartition("\\boxed")
    depth = 0
    for brace in re.finditer(r"[{}]", tail if mark else ""):
        depth += 1 if brace[0] == "{" else -1
        if brace[0] == "}" and depth == 0:
            return mark + tail[: brace.end()]
    return None


def scan(text: str) -> list[tuple[str, str]]:
    """Typed tokens of an answer."""
    return [(m.lastgroup or "sign", m[0]) for m in _SCAN.finditer(text)]


def _argument(tokens: list[tuple[str, str]], at: int) -> tuple[list[tuple[str, str]], int]:
    """A command's argument that begins at a token: a group, or the first digit of a number; and where it ends."""
    while at < len(tokens) and tokens[at][0] == "space":
        at += 1
    if at >= len(tokens):
        return [], at
    kind, word = tokens[at]
    if kind == "number" and len(word) > 1:
        tokens[at] = (kind, word[1:])
        return [(kind, word[0])], at
    if kind != "open":
        return [tokens[at]], at + 1
    depth, end = 0, at
    for end in range(at, len(tokens)):
        depth += {"open": 1, "close": -1}.get(tokens[end][0], 0)
        if not depth:
            break
    return tokens[at + 1 : end], end + 1


def parse_latex(text: str) -> str:
    """STR-05: an answer with commands as plain text."""
    return _render(scan(text))


def _render(tokens: list[tuple[str, str]]) -> str:
    tokens, out, at, gap = list(tokens), "", 0, False
    while at < len(tokens):
        kind, word = tokens[at]
        at += 1
        if kind == "space":
            gap = True
            continue
        said = ""
        if kind == "number":
            said = word
        elif kind == "command" and word in _FRACTIONS:
            above, at = _argument(tokens, at)
            below, at = _argument(tokens, at)
            said = f"{_render(above)}/{_render(below)}"
        elif kind == "command" and word not in _SILENT:
            said = _NAMES.get(word, word)
        elif kind == "scale":
            said = _SCALES[word]
        elif kind == "joiner":
            said = ","
        elif kind == "sign" and word not in "$%":
            said = word
        if not said:
            continue
        if gap and out[-1:].isdigit() and said[0].isdigit():
            out += "+"
        elif kind == "command" and word in _FRACTIONS and out[-1:].isdigit():
            out += "+"  # 7\frac34 is a mixed number
        out, gap = out + said, False
    return out


def _whole(text: str) -> str:
    """A number within 1e-7 of a whole one, written as that."""
    if not re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)(e[-+]?\d{1,3})?", text):
        return text
    x = Fraction(text)
    return str(round(x)) if abs(x - round(x)) <= Fraction(1, 10**7) else text


def normalize(text: str | None) -> str:
    """STR-06: the rendered form of an answer; null is empty."""
    return _whole(_render(scan(str(text))).lower()) if text is not None else ""


class Undecided(ValueError):
    """An expression that exact rationals cannot tell the value of."""


_LEVEL = {"+": 1, "-": 1, "*": 2, "/": 2, "neg": 3, "^": 4}


def _symbols(text: str) -> Iterator[str]:
    """Numbers, operators and parentheses; a product without a sign gets one, a sign before a value is `neg`."""
    was = ""
    for m in re.finditer(r"(\d+\.?\d*|\.\d+)|(\*\*|[-+*/^])|([()])|(.)", text, re.S):
        if m[4]:
            raise Undecided(text)
        word = "^" if m[0] == "**" else m[0]
        after_value = was == ")" or was[-1:].isdigit() or was[-1:] == "."
        if after_value and (m[1] or word == "("):
            yield "*"
        elif m[2] and not after_value:
            if word not in "+-":
                raise Undecided(text)
            was = word
            if word == "-":
                yield "neg"
            continue
        yield word
        was = word


def rational(text: str) -> Fraction:
    """STR-09: the value of numbers under + - * / ^ and parentheses; powers are single digits and do not nest."""
    values: list[Fraction] = []
    ops: list[str] = []

    def apply() -> None:
        op = ops.pop()
        need = 1 if op == "neg" else 2
        if op == "(" or len(values) < need:
            raise Undecided(text)
        b = values.pop()
        if op == "neg":
            values.append(-b)
            return
        a = values.pop()
        if op == "^":
            if b.denominator != 1 or abs(b) > 9 or (not a and b < 0):
                raise Undecided(text)
            values.append(a ** int(b))
        elif op == "/":
            if not b:
                raise Undecided(text)
            values.append(a / b)
        else:
            values.append(a + b if op == "+" else a - b if op == "-" else a * b)

    was = ""
    for word in _symbols(text):
        if word == "(":
            if was == "^":
                raise Undecided(text)
            ops.append(word)
        elif word == ")":
            while ops and ops[-1] != "(":
                apply()
            if not ops:
                raise Undecided(text)
            ops.pop()
        elif word in _LEVEL:
            if word == "^" and "^" in ops and ops[-1] == "^":
                raise Undecided(text)
            while word != "neg" and ops and ops[-1] != "(" and _LEVEL[ops[-1]] >= _LEVEL[word]:
                apply()
            ops.append(word)
        else:
            if was == "^" and len(word) > 1:
                raise Undecided(text)
            values.append(Fraction(word))
        was = word
    while ops:
        apply()
    if len(values) != 1:
        raise Undecided(text)
    return values[0]


def _shape(text: str) -> str:
    return "empty" if not text else "whole" if re.fullmatch(r"-?\d+", text) else "fraction" if re.fullmatch(r"-?\d+/\d+", text) else "other"


def _same_value(a: str, b: str) -> bool:
    try:
        return rational(a) == rational(b)
    except ValueError:
        return False


#: What decides for answers that render differently, by their shapes; other pairs by value.
_BY_SHAPE: dict[frozenset, Callable[[str, str], bool]] = {
    **{frozenset(("whole", x)): lambda a, b: False for x in ("empty", "fraction", "other")},
    **{frozenset(("empty", x)): lambda a, b: False for x in ("fraction", "other")},
    frozenset(("fraction",)): lambda a, b: False,
}


def grade_text(given: str | None, truth: str | None) -> bool:
    """STR-07: equal as rendered."""
    return normalize(given) == normalize(truth)


def grade(given: str | None, truth: str | None) -> bool:
    """STR-08/10: equal as rendered, or by value where their shapes allow it."""
    a, b = normalize(truth), normalize(given)
    return a == b or _BY_SHAPE.get(frozenset((_shape(a), _shape(b))), _same_value)(a, b)


@F.pandas_udf(T.StringType())
def normalize_udf(text: pd.Series) -> pd.Series:
    return text.map(normalize)


@F.pandas_udf(T.StringType())
def latex_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else parse_latex(x))


@F.pandas_udf(T.BooleanType())
def grade_text_udf(given: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([grade_text(a, b) for a, b in zip(given, truth)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def grade_udf(given: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([grade(a, b) for a, b in zip(given, truth)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def same_value_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_same_value(normalize(x), normalize(y)) for x, y in zip(a, b)], dtype=bool)


def judge(response: Column, truth: Column) -> Column:
    """STR-10: grade of a response's final answer."""
    return grade_udf(extract_final_answer(response), truth)
