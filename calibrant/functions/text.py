"""Answer text: extraction, normalisation, prompts. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calibrant.functions.dists import let

#: Patterns of answers (fixed values).
NUMBER = r"-?[0-9][0-9,]*"
BOXED = r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
ANSWER_LINE = r"[Aa]nswer\s*:\s*([^\n]+)"
FINAL = r"(?i)(?:final\s+answer|answer)\s*[:：]\s*([^\n]+)"
#: Unit words that grading drops (fixed values).
UNITS = ("degree", "cm", "centimeter", "meter", "mile", "second", "minute", "hour", "day", "week", "month", "year", "foot", "feet", "inch", "yard")
#: Prompt endings (fixed values).
BOXED_SUFFIX = "\nPlease reason step by step, and put your final answer within \\boxed{}."
DAPO_PREFIX = "Solve the following math problem step by step. The last line of your response should be of the form Answer: $Answer (without quotes) where $Answer is the answer to the problem.\n\n"
DAPO_SUFFIX = '\n\nRemember to put your answer on its own line after "Answer:".'


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def last_number(c: Column) -> Column:
    """Last number anywhere in the text; null if none."""
    return F.try_element_at(_all(c, NUMBER), F.lit(-1))


def first_number(c: Column) -> Column:
    return F.try_element_at(_all(c, NUMBER), F.lit(1))


def extract_answer(c: Column, style: str = "boxed") -> Column:
    """STR-01: the last boxed number, else the last boxed text, else the last number, else ''. The text is searched for boxes once, and for numbers only where no box has an answer."""

    def boxed(boxes: Column) -> Column:
        holding = F.filter(boxes, lambda b: b.rlike(NUMBER))
        return F.coalesce(first_number(F.try_element_at(holding, F.lit(-1))), F.trim(F.try_element_at(boxes, F.lit(-1))))

    out = F.coalesce(let(_all(c, BOXED, 1), boxed), last_number(c), F.lit(""))
    if style == "dapo":
        line = F.try_element_at(_all(c, ANSWER_LINE, 1), F.lit(-1))
        out = F.coalesce(first_number(line), out)
    return F.when(c.isNull(), F.lit("")).otherwise(out)


def normalize_answer(c: Column) -> Column:
    """STR-02: a whole number without separators, else null."""
    bare = F.replace(F.trim(c), F.lit(","), F.lit(""))
    return F.when(bare.rlike(r"^-?[0-9]+$"), bare.try_cast("decimal(38,0)"))


def last_box(c: Column) -> Column:
    """STR-03: from the last \\boxed (\\fbox counts as one) to where its braces close; null if they do not.

    The text behind the mark is split at closing braces, and a fold over the pieces counts how
    deep each one stands: no bound on nesting, and no Python.
    """
    t = F.replace(c, F.lit("\\fbox"), F.lit("\\boxed"))
    tail = F.substring_index(t, "\\boxed", -1)
    pieces = F.split(tail, r"\}")
    opened = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit(""))))

    def step(s: Column, n: Column) -> Column:
        depth = s["depth"] + n - 1
        return F.when(s["shut"], s).otherwise(F.struct(depth.alias("depth"), (s["n"] + 1).alias("n"), (depth == 0).alias("shut")))

    end = F.aggregate(opened, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("shut")), step)
    box = F.concat(F.lit("\\boxed"), F.array_join(F.slice(pieces, F.lit(1), end["n"]), "}"), F.lit("}"))
    return F.when(F.contains(t, F.lit("\\boxed")) & end["shut"], box)


def remove_boxed(c: Column) -> Column:
    """STR-04: what stands inside \\boxed{...} that makes up the whole text; null otherwise."""
    return F.when(F.startswith(c, F.lit("\\boxed{")) & F.endswith(c, F.lit("}")), F.substring(c, F.lit(8), F.length(c) - 8))


def boxed_answer(c: Column) -> Column:
    """STR-04: inside of the last box, braces balanced to any depth."""
    return remove_boxed(last_box(c))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def extract_final_answer(c: Column) -> Column:
    """STR-11: the last box, else the first marked answer (null if that is blank), else the last number, else null."""
    marked = F.try_element_at(_all(c, FINAL, 1), F.lit(1))
    box = F.nullif(boxed_answer(c), F.lit(""))
    return F.when(box.isNotNull(), box).when(marked.isNotNull(), F.nullif(strip(marked), F.lit(""))).otherwise(F.nullif(extract_answer(c), F.lit("")))


def hash_answer(c: Column) -> Column:
    """STR-12: what follows the last ####, unboxed or trimmed."""
    tail = strip(F.element_at(F.split(c, "####"), -1))
    return F.coalesce(F.nullif(boxed_answer(tail), F.lit("")), tail)


def format_prompt(c: Column, style: str = "boxed") -> Column:
    """PRJ-01."""
    return F.concat(F.lit(DAPO_PREFIX), F.trim(c), F.lit(DAPO_SUFFIX)) if style == "dapo" else F.concat(F.trim(c), F.lit(BOXED_SUFFIX))


def chat_prompt(c: Column) -> Column:
    """PRJ-02 for one user turn: ChatML with a generation header."""
    return F.concat(F.lit("<|im_start|>user\n"), c, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def format_value(c: Column, digits: int = 4) -> Column:
    """PRJ-14: a number with fixed digits, a dash for null or what is no number."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit("—")).otherwise(F.format_string(f"%.{digits}f", x))


def label_year(c: Column) -> Column:
    """STR-13: year of a file name."""
    return F.when(c.contains("24"), F.lit("2024")).when(c.contains("25"), F.lit("2025"))


def is_true_number(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)
