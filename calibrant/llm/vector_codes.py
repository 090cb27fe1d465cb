"""Vector code compression: product codes with a codebook for each part of a vector.

Components become integers, so sums, distances and ties are exact. Each round broadcasts one
kd-tree a codebook: an entry's subtree is a box, and a part visits the boxes that are no farther
than the best entry found so far, the nearer child first. Boxes at exactly that distance are
visited too, so that of equally near entries the lowest index wins. Tasks add up the parts of
each entry before anything is shuffled, at most a row for each entry and task; the sums are
integers, so their order does not matter.

What is broadcast or brought to the driver is one codebook for each part: parts * entries *
width integers, whatever the number of vectors.

Defined results: rows whose vector is null or holds null, NaN or an infinity are dropped; no kept
row gives no rows. Vectors of another length than that of the smallest kept vec_id, of a length
that is no positive multiple of `parts`, or with components so large that a distance could leave
64 bits, are returned with null code and error and do not move entries. A repeated vec_id starts
one entry, the smallest of its vectors; every row is coded, equal ones alike. A null vec_id counts
as the largest. With fewer vec_ids than entries the codebooks are shorter. Null labels are one
label; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm.graph import bounded
from calibrant.llm.worker import enter
from calibrant.session import ship, table

#: Entries in a leaf of a tree.
LEAF = 4
_HEX = np.array([f"{k:02x}" for k in range(256)])


@dataclass
class Node:
    """A box around some entries: a leaf has these, others a dimension, the place where it is cut, and two children."""

    low: np.ndarray
    high: np.ndarray
    entries: list[int]
    axis: int = 0
    cut: int = 0
    children: tuple[Node, Node] | None = None


def build(entries: np.ndarray) -> Node:
    """The kd-tree of a codebook: cut at the median of the widest dimension until LEAF entries are left or all are equal."""

    def node(ids: np.ndarray) -> Node:
        own = entries[ids]
        low, high = own.min(axis=0), own.max(axis=0)
        axis = int(np.argmax(high - low))
        if len(ids) <= LEAF or low[axis] == high[axis]:
            return Node(low, high, sorted(ids.tolist()))
        order = ids[np.argsort(own[:, axis], kind="stable")]
        half = len(order) // 2
        return Node(low, high, [], axis, int(entries[order[half], axis]), (node(order[:half]), node(order[half:])))

    return node(np.arange(len(entries)))


def nearest(tree: Node, entries: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of each point; of equally near ones the lowest index."""
    best, at = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(entries))

    def visit(node: Node, rows: np.ndarray) -> None:
        p = points[rows]
        gap = np.maximum(node.low - p, 0) + np.maximum(p - node.high, 0)
        rows = rows[np.einsum("ij,ij->i", gap, gap) <= best[rows]]  # an equal bound may hide a lower index
        if not len(rows):
            return
        p = points[rows]
        if node.children is None:
            for e in node.entries:
                diff = p - entries[e]
                d = np.einsum("ij,ij->i", diff, diff)
                closer = (d < best[rows]) | ((d == best[rows]) & (e < at[rows]))
                best[rows[closer]], at[rows[closer]] = d[closer], e
            return
        left = p[:, node.axis] < node.cut
        for first, second, own in ((0, 1, rows[left]), (1, 0, rows[~left])):
            if len(own):
                visit(node.children[first], own)
                visit(node.children[second], own)

    visit(tree, np.arange(len(points)))
    return at, best


@dataclass
class Codebooks:
    """Entries of each part: integers[part, entry, place within the part]."""

    entries: np.ndarray

    def trees(self) -> list[Node]:
        return [build(e) for e in self.entries]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _clean_batches(batches: Iterator[pa.RecordBatch], parts: int, scale: int) -> Iterator[pa.RecordBatch]:
    """(vec_id, vector, label) to integers; misfits get none."""
    enter("vector_codes")
    for b in batches:
        vectors = b.column(1)
        keep, ints = [], []
        for k, v in enumerate(vectors):
            if not v.is_valid:
                continue
            if v.values.null_count or not np.isfinite(x := v.values.to_numpy(zero_copy_only=False)).all():
                continue
            keep.append(k)
            n = len(x)
            with np.errstate(over="ignore"):
                x = np.floor(x * scale)
            fits = n and n % parts == 0 and np.abs(x).max() <= math.isqrt(((1 << 63) - 1) // n) // 2
            ints.append(x.astype(np.int64) if fits else None)
        take = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(ints, pa.list_(pa.int64())), b.column(2).take(take)], names=["vec_id", "v", "label"])


def _assigned(points: np.ndarray, books: Codebooks, trees: list[Node]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part its own columns, the index of the nearest entry and the squared distance."""
    width = books.entries.shape[2]
    for part, tree in enumerate(trees):
        own = np.ascontiguousarray(points[:, part * width : (part + 1) * width])
        yield own, *nearest(tree, books.entries[part], own)


def _sum_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Sums and counts of this task's parts by entry."""
    enter("vector_codes")
    books, trees = shared.value
    sums, counts = np.zeros_like(books.entries), np.zeros(books.entries.shape[:2], np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        for part, (own, at, _) in enumerate(_assigned(_matrix(b.column(0)), books, trees)):
            np.add.at(sums[part], at, own)
            counts[part] += np.bincount(at, minlength=counts.shape[1])
    part, entry = np.nonzero(counts)
    cols = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry])]
    cols += [pa.array(np.ascontiguousarray(sums[part, entry, k])) for k in range(sums.shape[2])]
    yield pa.RecordBatch.from_arrays(cols, names=["part", "entry", "n", *(f"s{k}" for k in range(sums.shape[2]))])


def _code_batches(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    enter("vector_codes")
    books, trees = shared.value
    for b in batches:
        if not b.num_rows:
            continue
        error, code = np.zeros(b.num_rows, np.int64), []
        for _, at, far in _assigned(_matrix(b.column(1)), books, trees):
            error += far
            code.append(_HEX[at])
        codes = ["".join(c) for c in zip(*code)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes, pa.string()), pa.array(error), b.column(2)], names=["vec_id", "code", "error", "label"])


def integers(vectors: DataFrame, vector_col: str = "embedding", parts: int = 16, scale: int = 256) -> DataFrame:
    """(vec_id, v, label) of the kept rows of vectors, written once; v is null for vectors that cannot be coded."""
    ship(vectors.sparkSession)
    kind = dict(vectors.dtypes)["label"]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col("label").alias("label"))
    rows = table(rows.mapInArrow(partial(_clean_batches, parts=parts, scale=scale), f"vec_id long, v array<long>, label {kind}"), "integers")
    first = rows.where(F.col("v").isNotNull()).orderBy(F.col("vec_id").asc_nulls_last(), F.size("v")).select(F.size("v").alias("n")).first()
    return rows.withColumn("v", F.when(F.size("v") == (first["n"] if first else 0), F.col("v")))


def initial(rows: DataFrame, parts: int = 16, entries: int = 64) -> Codebooks | None:
    """The parts of the smallest vec_ids' vectors; None where no vector can be coded. Collects `entries` vectors."""
    rows = rows.where(F.col("v").isNotNull())
    ids = rows.select(F.col("vec_id").alias("id")).distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries)
    own = rows.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("id"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    got = [r["v"] for r in own.orderBy(F.col("vec_id").asc_nulls_last()).collect()]
    if not got:
        return None
    return Codebooks(np.ascontiguousarray(np.array(got, np.int64).reshape(len(got), parts, -1).transpose(1, 0, 2)))


def step(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: assign all parts, replace each used entry by the floor of its parts' mean."""
    width = books.entries.shape[2]
    shared = rows.sparkSession.sparkContext.broadcast((books, books.trees()))
    sums = [f"s{k}" for k in range(width)]
    own = rows.where(F.col("v").isNotNull()).select("v").mapInArrow(partial(_sum_batches, shared=shared), f"part int, entry int, n long, {', '.join(f'{s} long' for s in sums)}")
    total = own.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ["n", *sums])).collect()  # a row for each entry
    entries = books.entries.copy()
    for r in total:
        entries[r["part"], r["entry"]] = [r[s] // r["n"] for s in sums]
    return Codebooks(entries)


def encode(rows: DataFrame, books: Codebooks | None) -> DataFrame:
    """(vec_id, code, error, label) of every kept row."""
    misfits = rows.where(F.col("v").isNull()).select("vec_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), "label")
    if books is None:
        return misfits
    shared = rows.sparkSession.sparkContext.broadcast((books, books.trees()))
    coded = rows.where(F.col("v").isNotNull()).mapInArrow(partial(_code_batches, shared=shared), f"vec_id long, code string, error long, label {dict(rows.dtypes)['label']}")
    return coded.union(misfits)


def compress(vectors: DataFrame, vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks | None]:
    """Codes of all vectors, and the codebooks that they refer to. entries: 256 at most, as an index has two hex digits."""
    rows = integers(vectors, vector_col, parts, scale)
    books = initial(rows, parts, min(entries, 256))
    for _ in range(rounds if books else 0):
        books = step(rows, books)
    return encode(rows, books), books


def decode(codes: DataFrame, books: Codebooks, scale: int = 256) -> DataFrame:
    """codes with `vector`: the entries that a code names, at the middle of their integer cell; null for a null code."""
    parts, n, width = books.entries.shape
    flat = F.lit(((books.entries.ravel() + 0.5) / scale).tolist())
    at = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.conv(F.substr("code", 2 * p + 1, F.lit(2)), 16, 10).cast("int") + p * n)
    return codes.withColumn("vector", F.when(F.col("code").isNotNull(), F.flatten(F.transform(at, lambda k: F.slice(flat, k * width + 1, width)))))


def label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the sum of errors over equal labels: summed by label first, then joined by broadcast where labels are few."""
    kind = "decimal(38,0)"
    sums = table(codes.groupBy("label").agg(F.sum(F.col("error").cast(kind)).try_cast("long").alias("label_error")), "labels").withColumnRenamed("label", "l")
    return codes.join(bounded(sums), F.col("label").eqNullSafe(F.col("l")), "left").drop("l")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = label_errors(table(codes, "codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assignment k and the entries after it."""
    return f"""near{k} AS (
  SELECT vec_id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
    SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x))::BIGINT AS d
    FROM p JOIN book{k} b ON p.part = b.part AND p.place = b.place GROUP BY ALL) GROUP BY vec_id, part),
sum{k} AS (SELECT p.part, n.entry, p.place, sum(p.x)::BIGINT AS s, count(*) AS n FROM p JOIN near{k} n USING (vec_id, part) GROUP BY ALL),
book{k + 1} AS (
  SELECT b.part, b.entry, b.place, CASE WHEN s.n IS NULL THEN b.x ELSE (s.s - (s.s % s.n + s.n) % s.n) // s.n END AS x
  FROM book{k} b LEFT JOIN sum{k} s ON b.part = s.part AND b.entry = s.entry AND b.place = s.place)"""


ORACLE = f"""WITH kept AS (
  SELECT vec_id, embedding, label FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT vec_id, len(embedding) // 16 AS width, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM kept),
p AS (SELECT vec_id, i // width AS part, i % width AS place, floor(256 * x::DOUBLE)::BIGINT AS x FROM flat),
ranks AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64),
book0 AS (SELECT part, entry, place, x FROM p JOIN ranks USING (vec_id)),
{_round_sql(0)}, {_round_sql(1)}, {_round_sql(2)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) FROM book2) AS codebooks_sha256
FROM kept JOIN coded USING (vec_id)"""
