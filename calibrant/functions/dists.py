"""Distributions over a vocabulary as arrays: log-softmax, top-K, support lookups, losses. No shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from calibrant.session import ship

TAIL = -100.0


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def let(x: Column, f) -> Column:
    """f of a value that is computed once: lambdas compute what they hold again for each element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def log_softmax(x: Column) -> Column:
    """ARR-01."""
    shifted = let(F.transform(x, lambda v: v.cast("double")), lambda d: let(F.array_max(d), lambda top: F.transform(d, lambda v: v - top)))
    return let(shifted, lambda d: let(F.ln(_sum(F.transform(d, F.exp))), lambda z: F.transform(d, lambda v: v - z)))


def top_k(x: Column, k: int) -> Column:
    """TOP-02: (id, v) of the k largest, ties to the lower id, in that order."""
    pairs = F.transform(x, lambda v, i: F.struct((-v).alias("n"), i.alias("id"), v.alias("v")))
    return F.transform(F.slice(F.sort_array(pairs), 1, k), lambda s: F.struct(s["id"].alias("id"), s["v"].alias("v")))


def by_id(pairs: Column) -> Column:
    """TOP-12: a support in order of id."""
    return F.sort_array(pairs)


def lookup(ids: Column, support: Column, fill: float = 0.0) -> Column:
    """JOIN-02/03 inside an expression: values of a support at ids, `fill` outside it. K * K steps a position; `look_up` takes K log K."""
    return let(F.map_from_entries(support), lambda m: F.transform(ids, lambda i: F.coalesce(F.element_at(m, i), F.lit(fill))))


def _found(ids, support, fill: float):
    """Values of supports at ids for a whole Arrow batch: one binary search for all rows, as a row's number leads its ids."""

    def cells(lists):
        n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.repeat(np.arange(len(lists)) << 33, n), lists.flatten(), n

    at_row, wanted, n = cells(ids)
    row, pairs, _ = cells(support)
    keys = row + pairs.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pairs.field(1).cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(keys) > 1 and (keys[1:] < keys[:-1]).any():  # not in order of id
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
    out = np.full(len(at_row), fill)
    if len(keys):
        key = at_row + wanted.to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[place] == key
        out[hit] = values[place[hit]]
    offsets = np.zeros(len(n) + 1, np.int32)
    np.cumsum(n, out=offsets[1:])
    none = np.array(ids.is_null()) | np.array(support.is_null())
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out), mask=pa.array(none) if none.any() else None)


def look_up(rows: DataFrame, ids: str, support: str, out: str, fill: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """JOIN-02/03: rows with `out`, the values of the support column (id, v) at the ids column, `fill` outside it; null where either is.

    A search over Arrow batches: the map that the JVM offers is searched from its beginning for
    each id. Supports in order of id (TOP-12) need no sorting here. keep: the columns that come
    back beside `out`, all but the support where none are named.
    """
    ship(rows.sparkSession)
    keep = [c for c in rows.columns if c != support] if keep is None else keep
    rows = rows.select(*keep, F.col(ids).alias("_ids"), F.col(support).alias("_support"))
    n = len(keep)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:n], _found(b.column(n), b.column(n + 1), fill)], names=[*keep, out])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:n], StructField(out, ArrayType(DoubleType()))]))


def teacher_support_delta(rl: Column, ref: Column, k: int) -> Column:
    """TOP-03: (id, v) of the k most likely tokens under rl, with v the difference to ref there."""
    return let(top_k(rl, k), lambda s: F.zip_with(s, gather(ref, F.transform(s, lambda p: p["id"])), lambda p, r: F.struct(p["id"].alias("id"), (p["v"] - r).alias("v"))))


def scatter(ids: Column, values: Column, vocab: int, fill: float = 0.0) -> Column:
    """JOIN-01: dense form of a support."""
    return let(F.map_from_arrays(ids, values), lambda m: F.transform(F.sequence(F.lit(0), F.lit(vocab - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(fill))))


def gather(dense: Column, ids: Column, fill: float | None = None) -> Column:
    """JOIN-17/18: values of a dense array at 0-based ids; `fill` (or null) where the id is outside."""
    return let(dense, lambda a: F.transform(ids, lambda i: F.coalesce(F.try_element_at(a, (i + 1).cast("int")), F.lit(fill).cast("double"))))


def kl_k3(s: Column, r: Column) -> Column:
    """AGG-27: sum of e^s (e^x - x - 1) with x = r - s."""
    return _sum(F.zip_with(s, r, lambda a, b: F.exp(a) * (F.exp(b - a) - (b - a) - 1)))


def kl_k3_support(s: Column, r: Column, renormalise: bool = False) -> Column:
    """AGG-28: the same on a support, its probabilities over their sum if asked."""
    return kl_k3(s, r) / (_sum(F.transform(s, F.exp)) + F.lit(1e-8)) if renormalise else kl_k3(s, r)


def expected(logp: Column, delta: Column) -> Column:
    """AGG-29: expectation of delta."""
    return _sum(F.zip_with(logp, delta, lambda a, b: F.exp(a) * b))


def pg_token(s_cur: Column, s_old: Column, delta: Column, *, clip: float = 0.2, delta_clip: float | None = None, ratio_clip: float | None = 5.0, mismatch: float | None = 20.0, renormalise: bool = False) -> Column:
    """AGG-26: clipped policy-gradient loss of one position."""
    c = lambda x, m: F.least(F.greatest(x, F.lit(-m)), F.lit(m))
    rows = F.transform(F.arrays_zip(s_cur.alias("a"), s_old.alias("b"), delta.alias("d")), lambda z: F.struct((z["a"] - z["b"]).alias("lr"), z["b"].alias("so"), (c(z["d"], delta_clip) if delta_clip else z["d"]).alias("d")))
    if renormalise:
        mass = _sum(F.transform(rows, lambda z: F.when(z["d"] != 0, F.exp(z["so"])).otherwise(F.lit(0.0)))) + F.lit(1e-8)

    def term(z: Column) -> Column:
        ratio = F.exp(c(z["lr"], ratio_clip) if ratio_clip else z["lr"])
        m = F.least(ratio * z["d"], F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip)) * z["d"])
        m = F.when(z["so"] < F.lit(-mismatch), F.lit(0.0)).otherwise(m) if mismatch else m
        p = F.exp(z["so"])
        return (F.when(z["d"] != 0, p).otherwise(F.lit(0.0)) / mass if renormalise else p) * m

    return -_sum(F.transform(rows, term))


def disagreement(a: Column, b: Column, mask: Column) -> Column:
    """AGG-24: masked mean of |a - b|."""
    num = _sum(F.transform(F.arrays_zip(a.alias("a"), b.alias("b"), mask.alias("m")), lambda z: F.abs(z["a"] - z["b"]) * z["m"]))
    return num / (_sum(F.transform(mask, lambda m: m.cast("double"))) + F.lit(1e-8))
