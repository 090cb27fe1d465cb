"""Teacher caches over large vocabularies: two-level top-K over blocks, without a row that holds a whole vocabulary.

A teacher's logits come as blocks of one position: (pos, block, values), where token `block *
size + i` has the value values[i]. A block keeps its k largest and its share of the normaliser;
blocks are merged FAN at a time, so that nothing larger than a block or FAN * k entries is ever
sorted or held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.errors import StateError
from calibrant.functions.dists import let

#: Blocks merged at a time.
FAN = 16


class TeacherMismatch(StateError):
    """Two teachers differ in their positions or their vocabulary."""


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of logits in long form, (pos, id, value); ids of a position must be 0 to V - 1."""
    cells = F.array_sort(F.collect_list(F.struct("id", "value")))  # `size` cells a block
    return rows.groupBy("pos", F.floor(F.col("id") / size).alias("block")).agg(cells.alias("cells")).select("pos", "block", F.col("cells.value").alias("values"))


def check_teachers(rl: DataFrame, ref: DataFrame) -> None:
    """Raise TeacherMismatch unless both have the same positions, and the same tokens at each."""
    sizes = lambda df, name: df.select("pos", "block", F.size("values").alias(name))
    both = sizes(rl, "a").join(sizes(ref, "b"), ["pos", "block"], "full_outer")
    bad = both.where(~F.col("a").eqNullSafe(F.col("b"))).select("pos", "block", "a", "b").first()
    if bad:
        raise TeacherMismatch(f"at position {bad['pos']}, block {bad['block']}, one teacher has {bad['a']} tokens and the other {bad['b']}")


def _best(pairs: Column, k: int) -> Column:
    """The first k in order of (-value, id)."""
    return F.slice(F.sort_array(pairs), 1, k)


def _mass(parts: Column) -> Column:
    """(max, sum of exponents below it) of several such pairs."""
    return let(F.array_max(F.transform(parts, lambda p: p["top"])), lambda m: F.struct(m.alias("top"), F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["sum"] * F.exp(p["top"] - m)).alias("sum")))


def summarise(blocks: DataFrame, size: int, k: int) -> DataFrame:
    """(pos, best, log_z): the k largest of each position, as (neg, id) with neg the negated logit, and its log normaliser."""
    values = F.transform("values", lambda v: v.cast("double"))
    top = let(values, lambda d: let(F.array_max(d), lambda m: F.struct(m.alias("top"), F.aggregate(d, F.lit(0.0), lambda s, v: s + F.exp(v - m)).alias("sum"))))
    # only values that reach the k-th largest become pairs
    least = F.coalesce(F.get(F.sort_array(values, asc=False), F.lit(k - 1)), F.lit(float("-inf")))
    pairs = lambda t: F.filter(F.transform("values", lambda v, i: F.when(v >= t, F.struct((-v.cast("double")).alias("neg"), (F.col("block") * size + i).cast("long").alias("id")))), lambda p: p.isNotNull())
    level = blocks.select("pos", "block", let(least, lambda t: _best(pairs(t), k)).alias("best"), top.alias("mass"))
    n = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    while n > 1:
        level = level.groupBy("pos", F.floor(F.col("block") / FAN).alias("block")).agg(F.collect_list("best").alias("bests"), F.collect_list("mass").alias("masses"))
        level = level.select("pos", "block", _best(F.flatten("bests"), k).alias("best"), _mass(F.col("masses")).alias("mass"))
        n = -(-n // FAN)
    return level.select("pos", "best", (F.col("mass.top") + F.ln("mass.sum")).alias("log_z"))


def teacher_cache(rl: DataFrame, ref: DataFrame, size: int, k: int, consistent: bool = True) -> DataFrame:
    """TOP-01: (pos, pairs): the k tokens that the first teacher finds likeliest, in order of id, each with both teachers' log-probabilities and their difference.

    Ties go to the lower id. The second teacher's values come by a join on (pos, block), so that
    only the blocks that hold a kept token meet one.
    """
    if consistent:
        check_teachers(rl, ref)
    kept = summarise(rl, size, k).select("pos", "log_z", F.inline("best")).withColumn("block", F.floor(F.col("id") / size))
    there = kept.join(ref, ["pos", "block"]).select("pos", "id", (-F.col("neg") - F.col("log_z")).alias("rl"), F.get("values", (F.col("id") % size).cast("int")).cast("double").alias("raw"))
    norm = summarise(ref, size, 1).select("pos", "log_z")
    cells = there.join(norm, "pos").select("pos", "id", "rl", (F.col("raw") - F.col("log_z")).alias("ref"))
    return cells.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("id", "rl", "ref", (F.col("rl") - F.col("ref")).alias("delta")))).alias("pairs"))  # k a position


#: Positions that are asked about at a time, whatever an Arrow batch holds; with blocks of 500 tokens an array takes 1 MB.
ROWS = 256
_PART = pa.struct([("order", pa.int64()), ("id", pa.int64()), ("rl", pa.float64()), ("ref", pa.float64())])

#: Logits of the tokens from the second to before the third argument, for inputs of n positions (n, width); those that are missing are masked.
Teacher = Callable[[np.ma.MaskedArray, int, int], np.ma.MaskedArray]


def _inputs(lists: pa.Array) -> np.ma.MaskedArray:
    """Rows as wide as the longest; null components, and what shorter or null rows lack, are masked."""
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    flat = lists.flatten()
    out = np.ma.masked_all((len(lists), int(sizes.max(initial=0))))
    at = np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out.data[at] = flat.fill_null(0).to_numpy(zero_copy_only=False)
    out.mask[at] = flat.is_null().to_numpy(zero_copy_only=False)
    return out


def _order(v: np.ma.MaskedArray) -> np.ndarray:
    """Integers that ascend as values do, NaN above all and what is missing below."""
    bits = (v.data + 0.0).view(np.int64)  # one zero
    key = bits ^ ((bits >> 63) & np.iinfo(np.int64).max)
    key[np.isnan(v.data)] = np.iinfo(np.int64).max
    key[np.ma.getmaskarray(v)] = np.iinfo(np.int64).min
    return key


class _Mass:
    """The log normaliser of rows whose logits come block by block."""

    def __init__(self, n: int):
        self.top, self.sum, self.any = np.full(n, -np.inf), np.zeros(n), np.zeros(n, bool)

    def add(self, v: np.ma.MaskedArray) -> None:
        seen = ~np.ma.getmaskarray(v)
        x = np.where(seen, v.data, -np.inf)
        top = np.maximum(self.top, x.max(axis=1))
        low = np.where(np.isneginf(top), 0.0, top)  # exp(-inf) is 0, whatever is taken from it
        self.sum = self.sum * np.exp(self.top - low) + np.exp(x - low[:, None]).sum(axis=1)
        self.top, self.any = top, self.any | seen.any(axis=1)

    def log(self) -> pa.Array:
        z = np.where(np.isneginf(self.top), -np.inf, np.where(np.isfinite(self.top), self.top + np.log(self.sum), np.nan))
        return pa.array(z, mask=~self.any)


def _ask(inputs: tuple, teachers: tuple[Teacher, Teacher], vocab: int, size: int, k: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The first k tokens of each row as _PART, and both log normalisers; a block of both teachers is there at a time."""
    n = len(inputs[0])
    masses = _Mass(n), _Mass(n)
    held = [np.empty(0, np.int64) for _ in range(3)] + [np.ma.masked_all(0) for _ in range(2)]  # row, order, id, both logits
    least = np.full(n, np.iinfo(np.int64).min)
    for lo in range(0, vocab, size):
        hi = min(lo + size, vocab)
        both = [np.ma.asarray(f(x, lo, hi), dtype=np.float64) for f, x in zip(teachers, inputs, strict=True)]
        if any(v.shape != (n, hi - lo) for v in both):
            raise TeacherMismatch(f"for tokens {lo} to {hi} of {n} positions, one teacher has logits {both[0].shape} and the other {both[1].shape}")
        for mass, v in zip(masses, both, strict=True):
            mass.add(v)
        key = _order(both[0])
        if lo < k:  # no k are held yet: all, or in the first block what reaches its k-th
            bound = np.partition(key, -k, axis=1)[:, -k] if not lo and hi > k else least
            row, j = np.nonzero(key >= bound[:, None])
        else:
            row, j = np.nonzero(key > least[:, None])  # of equal values the lower id is held
        new = [row, key[row, j], j + lo, both[0][row, j], both[1][row, j]]
        held = [np.ma.concatenate(x) if np.ma.isMA(x[0]) else np.concatenate(x) for x in zip(held, new, strict=True)]
        first = np.lexsort((held[2], ~held[1], held[0]))
        row = held[0][first]
        first = first[np.arange(len(row)) - np.searchsorted(row, row) < k]
        held = [x[first] for x in held]
        least = np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(most := np.full(n, np.iinfo(np.int64).max), held[0], held[1])
        full = np.bincount(held[0], minlength=n) == k
        least[full] = most[full]
    real = lambda v: pa.array(v.data, mask=np.ma.getmaskarray(v))
    cells = pa.StructArray.from_arrays([pa.array(~held[1]), pa.array(held[2].astype(np.int64)), real(held[3]), real(held[4])], fields=list(_PART))
    ends = np.concatenate([[0], np.cumsum(np.bincount(held[0], minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), cells), masses[0].log(), masses[1].log()


def _log_sum(logs: str) -> Column:
    """The log normaliser of parts with these: null without any, NaN if all logits are minus infinity."""
    top = F.array_max(logs)
    sum_ = let(top, lambda m: F.aggregate(logs, F.lit(0.0), lambda s, z: s + F.exp(z - m)))
    return F.when(top == F.lit(float("-inf")), F.lit(float("nan"))).otherwise(top + F.ln(sum_))


def asked_cache(rows: DataFrame, teachers: tuple[Teacher, Teacher], vocab: int, size: int, k: int) -> DataFrame:
    """TOP-01 as teacher_cache, for teachers that answer where a position's inputs lie: (pos, pairs) from (pos, rl, ref).

    Both are asked for a block of the vocabulary at a time and only what may stay is kept, so that no
    logits are written or shuffled: k tokens and two sums are. Rows of one position count together.
    Teachers must answer for all positions and tokens of a block, else TeacherMismatch is raised.
    """
    kind = dict(rows.dtypes)["pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                with np.errstate(all="ignore"):
                    best, rl, ref = _ask((_inputs(some.column("rl")), _inputs(some.column("ref"))), teachers, vocab, size, k)
                yield pa.RecordBatch.from_arrays([some.column("pos"), best, rl, ref], ["pos", "best", "z_rl", "z_ref"])

    parts = rows.select("pos", *(F.col(c).cast("array<double>").alias(c) for c in ("rl", "ref"))).mapInArrow(run, f"pos {kind}, best array<struct<order: bigint, id: bigint, rl: double, ref: double>>, z_rl double, z_ref double")
    each = parts.groupBy("pos").agg(F.collect_list("best").alias("bests"), F.collect_list("z_rl").alias("zs_rl"), F.collect_list("z_ref").alias("zs_ref"))
    each = each.select("pos", _best(F.flatten("bests"), k).alias("best"), _log_sum("zs_rl").alias("z_rl"), _log_sum("zs_ref").alias("z_ref"))
    rl, ref = (lambda p: p["rl"] - F.col("z_rl")), (lambda p: p["ref"] - F.col("z_ref"))
    return each.select("pos", F.array_sort(F.transform("best", lambda p: F.struct(p["id"].alias("id"), rl(p).alias("rl"), ref(p).alias("ref"), (rl(p) - ref(p)).alias("delta")))).alias("pairs"))
