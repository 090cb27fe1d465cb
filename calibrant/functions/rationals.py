"""Answers as exact numbers: normalised text and comparison of integers, decimals and fractions, as column expressions.

What only a computer-algebra system can decide is null, not false, so that a reader can tell the
two apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from calibrant.functions.dists import let

# What carries no meaning around a number, in order.
_DROP = (r"\\left|\\right|\\!|\\,|\;|\\ |\\\$|\$|\\%|%|\^\{?\\circ\}?|\\circ|°", r"\s+")
_WRAPS = (r"^\\text\{([^{}]*)\}$", r"^\\mathrm\{([^{}]*)\}$", r"^\{([^{}]*)\}$")

_SIGNED = r"([-+]?)"
_INT = r"[0-9]{1,18}"
_DECIMAL = rf"^{_SIGNED}(\d{{0,18}})(?:\.(\d{{0,18}}))?$"
_FRAC = rf"^{_SIGNED}\\[dt]?frac\{{{_SIGNED}({_INT})\}}\{{{_SIGNED}({_INT})\}}$"
_RATIO = rf"^{_SIGNED}({_INT})/{_SIGNED}({_INT})$"


def normal(text: Column) -> Column:
    """Text without marks that do not change a number: spaces, dollar and percent signs, degrees, thousands' commas, a wrapping command, a full stop."""
    plain = reduce(lambda t, p: F.regexp_replace(t, p, ""), _DROP, text)
    plain = F.regexp_replace(plain, r"(?<=\d),(?=\d{3}(?!\d))", "")
    plain = F.regexp_replace(plain, r"\.$", "")
    return reduce(lambda t, p: F.regexp_replace(t, p, "$1"), _WRAPS, plain)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _negative(*signs: Column) -> Column:
    return reduce(lambda a, b: a != b, [s == "-" for s in signs])


def rational(text: Column) -> Column:
    """(num, den) of an integer, decimal or fraction as decimals of up to 18 digits, den > 0; null for all other text."""
    kind = "decimal(18,0)"

    def of(t: Column) -> Column:
        whole, rest = _part(t, _DECIMAL, 2), F.rtrim(_part(t, _DECIMAL, 3), F.lit("0"))
        digits = F.concat(whole, rest)
        sign = lambda n, d: F.when(n, -d).otherwise(d).cast(kind)
        den = F.rpad(F.lit("1"), F.length(rest) + 1, "0")
        number = F.struct(sign(_part(t, _DECIMAL, 1) == "-", digits.try_cast(kind)).alias("num"), den.try_cast(kind).alias("den"))
        frac = F.struct(sign(_negative(*(_part(t, _FRAC, k) for k in (1, 2, 4))), _part(t, _FRAC, 3).try_cast(kind)).alias("num"), _part(t, _FRAC, 5).try_cast(kind).alias("den"))
        ratio = F.struct(sign(_negative(*(_part(t, _RATIO, k) for k in (1, 3))), _part(t, _RATIO, 2).try_cast(kind)).alias("num"), _part(t, _RATIO, 4).try_cast(kind).alias("den"))
        got = F.when(t.rlike(r"\d") & t.rlike(_DECIMAL), number).when(t.rlike(_FRAC), frac).when(t.rlike(_RATIO), ratio)
        return F.when((got["num"].isNotNull()) & (got["den"] > 0), got)

    return let(text, of)


def equal(answer: Column, truth: Column) -> Column:
    """Whether two answers are equal: as normalised texts, or as exact numbers by cross-multiplication; null where neither decides."""

    def decide(p: Column) -> Column:
        cross = p["a"]["num"].cast("decimal(38,0)") * p["b"]["den"] == p["b"]["num"].cast("decimal(38,0)") * p["a"]["den"]
        one = p["a"].isNotNull() != p["b"].isNotNull()
        name = r"^[A-Za-z]+$"  # a word is no number
        return F.when(p["s"] == p["t"], F.lit(True)).when(p["a"].isNotNull() & p["b"].isNotNull(), cross).when(one & (p["s"].rlike(name) | p["t"].rlike(name)), F.lit(False))

    pair = let(F.struct(normal(answer).alias("s"), normal(truth).alias("t")), lambda n: F.struct(n["s"].alias("s"), n["t"].alias("t"), rational(n["s"]).alias("a"), rational(n["t"]).alias("b")))
    return F.when(answer.isNull() | truth.isNull(), F.lit(False)).otherwise(let(pair, decide))
