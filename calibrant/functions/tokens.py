"""Token sequences: padding, masks, loops, status. Arrays in, arrays or scalars out; no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_to(ids: Column, length: int, pad: int = 0) -> Column:
    """PRJ-03: truncate and pad on the right to a fixed length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad).cast("int"), length)), 1, length)


def truncate_content(ids: Column, length: int, overhead: int, least: int = 8) -> Column:
    """PRJ-04: keep room for the template's tail."""
    return F.slice(ids, 1, max(least, length - overhead))


def strip_pad(ids: Column, pad: int = 0) -> Column:
    """PRJ-05: drop padding on the right; all padding leaves one."""
    last = F.array_max(F.transform(ids, lambda x, i: F.when(x != pad, i + 1).otherwise(0)))
    return F.when(F.coalesce(last, F.lit(0)) == 0, F.array(F.lit(pad).cast("int"))).otherwise(F.slice(ids, F.lit(1), F.greatest(last, F.lit(1))))


def length_mask(length: Column, width: int) -> Column:
    """PRJ-06: 1 while the position is below the length."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda t: (t < length).cast("int"))


def relative_position(length: Column, width: int) -> Column:
    """PRJ-07: t / max(len - 1, 1), and -1 beyond the length."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda t: F.when(t < length, t / F.greatest(length - 1, F.lit(1))).otherwise(F.lit(-1.0)))


def has_tail_loop(ids: Column, periods: list[int], least: int) -> Column:
    """ARR-02: for some period p, the last p tokens repeat the p before them."""
    n = F.size(ids)

    def looped(p: Column) -> Column:
        long = (n >= 2 * p) & (n >= least)
        return long & (F.slice(ids, F.when(long, n - p + 1).otherwise(F.lit(1)), F.when(long, p).otherwise(F.lit(0))) == F.slice(ids, F.when(long, n - 2 * p + 1).otherwise(F.lit(1)), F.when(long, p).otherwise(F.lit(0))))

    return F.exists(F.array(*(F.lit(p) for p in periods)), looped)


def repetition_penalty(logits: Column, seen: Column, penalty: float) -> Column:
    """ARR-03: logits of seen ids over the penalty."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i), x / F.lit(penalty)).otherwise(x))


def status(ids: Column, eos: int, periods: list[int], least: int) -> Column:
    """ARR-04: loop, else empty, else eos, else budget_stop."""
    return (
        F.when(has_tail_loop(ids, periods, least), F.lit("loop")).when(F.size(ids) == 0, F.lit("empty"))
        .when(F.array_contains(ids, eos), F.lit("eos")).otherwise(F.lit("budget_stop"))
    )


def train_length(ids: Column, eos: int) -> Column:
    """ARR-04: up to and with the end token."""
    at = F.array_position(ids, F.lit(eos))
    return F.when(at > 0, at).otherwise(F.size(ids).cast("long"))


def eval_tokens(ids: Column, eos: int) -> Column:
    """ARR-05: what precedes the end token."""
    at = F.array_position(ids, F.lit(eos)).cast("int")
    return F.when(at > 0, F.slice(ids, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(ids)


def token_logps(maps: Column) -> Column:
    """ARR-06/07: the chosen token's log-probability at each position; null where the map is empty."""
    return F.transform(maps, lambda m: F.try_element_at(F.map_values(m), F.lit(1)))


def chosen_rank(ids: Column, chosen: Column, k: int) -> Column:
    """ARR-08: place of the chosen id in a ranked list, k if absent."""
    return F.coalesce(F.nullif(F.array_position(ids, chosen), F.lit(0)) - 1, F.lit(k).cast("long"))


def overlap_rate(a: Column, b: Column) -> Column:
    """JOIN-12: share of a that is in b, duplicates kept; b's distinct ids are taken once, not for each of a."""
    hits = F.transform(F.array(F.array_distinct(b)), lambda kept: F.size(F.filter(a, lambda x: F.array_contains(kept, x))))
    return F.element_at(hits, 1) / F.size(a)
