"""Document fingerprints by one-permutation MinHash; DataFrame operations only.

A text's set is its five-word shingles (with fewer words, the whole sequence as one). Every
shingle is hashed once; the hash's high bits name its bin, and each bin keeps its least hash.
Hashes are sorted within the row, so a bin's least is the first of its run. An empty bin borrows
from a full one by optimal densification: each bin has its own random order of all bins, and the
first full one in that order lends. The first PROBES places of these orders are a table; beyond
them, which happens to short texts, the full bins are ranked by the same hashes.

Of each bin's value the low BITS bits are kept, packed into longs. Two bins of different sets
agree by chance in one of 2 ** BITS cases; the likeness is the share of equal bins corrected for
that: (equal - c) / (1 - c) with c = 2 ** -BITS, not below 0.

The next document by doc_id is found without a global sort: bounds are drawn from the keys by
hash, each row finds its bucket by binary search, and a bucket's first row is copied to the end
of the bucket before. Whole texts are shuffled once, in buckets of some PER_BUCKET rows.

Defined results: null text counts as empty; texts without words have the empty fingerprint, which
is like itself (1) and unlike all others (0); a null doc_id comes first; rows that repeat a doc_id
are ordered by a hash of the text, then by text, and equal rows follow each other; one row alone
is followed by itself; an empty table gives none; other columns are not read. All rows of one
doc_id and one text share a bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibrant.functions.dists import let

BINS, BITS, WIDTH = 256, 4, 5
#: Bins in a packed long, and one bit for each of them.
PER_LONG = 64 // BITS
_ONES = sum(1 << (BITS * k) for k in range(PER_LONG))
_SHIFT = 64 - (BINS.bit_length() - 1)
#: Places of each bin's order that are in the table.
PROBES = 16
#: Rows of a bucket, and most buckets (their bounds are two longs each, in the plan).
PER_BUCKET, MAX_BUCKETS = 512, 1 << 16
_SPACE = " \t\n\x0b\x0c\r"
_LEAST = -(1 << 63)


def _longs(values: list[int]) -> Column:
    """An array as one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _rank(bin_: Column, other: Column) -> Column:
    return F.xxhash64(bin_.cast("int"), other.cast("int"), F.lit("order"))


def probes(spark: SparkSession) -> Column:
    """For each of PROBES places, the bin that stands there in each bin's order."""
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.struct(_rank(F.col("id"), b).alias("r"), b.alias("b"))))
    rows = spark.range(BINS).select("id", F.slice(F.transform(order, lambda x: x["b"]), 1, PROBES).alias("o")).orderBy("id").collect()
    return _longs([r["o"][t] for t in range(PROBES) for r in rows])


def shingle_hashes(text: Column) -> Column:
    """Hashes of the text's shingles, as often as they occur."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    words = F.transform(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w))
    many = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WIDTH), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WIDTH))))
    hashes = let(words, lambda h: F.when(F.size(h) < WIDTH, F.array(F.xxhash64(h))).otherwise(many(h)))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<bigint>")).otherwise(hashes)


def _bin(x: Column) -> Column:
    return F.shiftright(x, _SHIFT) + BINS // 2


def minima(hashes: Column) -> Column:
    """For each bin its least hash, or null. A mark above all hashes of a bin stands for each, so that every bin is in the sorted row."""
    marks = _longs([((b + 1) << _SHIFT) - 1 for b in range(-BINS // 2, BINS // 2)])
    last = (1 << _SHIFT) - 1
    heads = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1).bitwiseAND(last) == last))
    return F.transform(let(F.sort_array(F.concat(hashes, marks)), heads), lambda x: F.when(x.bitwiseAND(last) != last, x))


def densified(least: Column, table: Column) -> Column:
    """A value for each bin: its own, or that of the first full bin in its order; none at all for an empty set."""

    def lend(full: Column, some: Column) -> Column:
        ranked = lambda i: F.array_min(F.transform(some, lambda x: F.struct(_rank(i, _bin(x)).alias("r"), x.alias("x"))))["x"]
        return F.transform(full, lambda x, i: F.coalesce(x, *(F.get(full, F.get(table, i + t * BINS).cast("int")) for t in range(PROBES)), ranked(i)))

    spread = lambda full, some: F.when(F.size(some).isin(0, BINS), some).otherwise(lend(full, some))
    return let(least, lambda full: let(F.filter(full, lambda x: x.isNotNull()), lambda some: spread(full, some)))


def pack(bins: Column) -> Column:
    """The low bits of all bins, as longs; empty for a text without words. bins: a column, as it is read for each bin."""
    low = [F.shiftleft(F.get(bins, F.lit(k)).bitwiseAND((1 << BITS) - 1), 64 - BITS * (k % PER_LONG + 1)) for k in range(BINS)]
    longs = [reduce(Column.bitwiseOR, low[k : k + PER_LONG]) for k in range(0, BINS, PER_LONG)]
    return F.when(F.size(bins) == 0, F.array().cast("array<bigint>")).otherwise(F.array(*longs))


def with_fingerprint(rows: DataFrame, text: str, name: str, table: Column) -> DataFrame:
    """rows with the packed fingerprint of a text column."""
    return rows.withColumn(name, densified(minima(shingle_hashes(F.col(text))), table)).withColumn(name, pack(F.col(name)))


def shown(packed: Column) -> Column:
    """A fingerprint as text: hex digits, BITS bits a bin in order of bins."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the sets behind two fingerprints, corrected for chance agreement of the kept bits."""

    def differing(x: Column) -> Column:
        step = 1
        while step < BITS:
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
            step *= 2
        return F.bit_count(x.bitwiseAND(F.lit(_ONES - (1 << 64) if _ONES >> 63 else _ONES)))

    apart = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    near = F.greatest(F.lit(0.0), (1 - apart / BINS - chance) / (1 - chance))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), near).when(F.size(a) == F.size(b), F.lit(1.0)).otherwise(F.lit(0.0))


def _bounds(rows: DataFrame) -> list[tuple[int, int]]:
    """Keys at which buckets begin, the least of all first: two longs for every PER_BUCKET rows or so, MAX_BUCKETS in the mean at most."""
    step = max(PER_BUCKET, -(-rows.count() // MAX_BUCKETS))
    least = rows.agg(F.min(F.struct("k", "h")).alias("m")).first()["m"]
    if least is None:
        return []
    some = rows.where(F.pmod(F.xxhash64("k", "h"), F.lit(step)) == 0).select("k", "h").distinct().collect()
    return sorted({(r["k"], r["h"]) for r in some} | {(least["k"], least["h"])})


def with_next(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, packed) with `next`, the (text, packed) of the document that follows in order of doc_id."""
    keyed = docs.withColumns({"k": F.coalesce("doc_id", F.lit(_LEAST)), "h": F.xxhash64("text")})
    bounds = _bounds(keyed.select("k", "h"))
    if not bounds:
        return docs.withColumn("next", F.struct("text", "packed"))
    ks, hs = _longs([k for k, _ in bounds]), _longs([h for _, h in bounds])
    halves = [1 << s for s in reversed(range((len(bounds) - 1).bit_length()))]

    def further(at: Column, half: Column) -> Column:
        k, h = F.get(ks, (at + half).cast("int")), F.get(hs, (at + half).cast("int"))  # null beyond the last
        return F.when((k < F.col("k")) | ((k == F.col("k")) & (h <= F.col("h"))), at + half).otherwise(at)

    at = F.aggregate(_longs(halves), F.lit(0).cast("bigint"), further) if halves else F.lit(0).cast("bigint")
    keyed = keyed.withColumn("at", at)
    here = F.struct(F.col("at").alias("bucket"), F.lit(False).alias("copy"))
    before = F.struct(F.pmod(F.col("at") - 1, F.lit(len(bounds)).cast("bigint")).alias("bucket"), F.lit(True).alias("copy"))
    begins = (F.col("k") == F.get(ks, F.col("at").cast("int"))) & (F.col("h") == F.get(hs, F.col("at").cast("int")))
    dealt = keyed.withColumn("to", F.explode(F.when(begins, F.array(here, before)).otherwise(F.array(here))))
    order = Window.partitionBy("to.bucket").orderBy("to.copy", "k", "h", "text")
    return dealt.withColumn("next", F.lead(F.struct("text", "packed")).over(order)).where(~F.col("to.copy")).select(*docs.columns, "next")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited text, and the packed fingerprints of the text, of the edited text and of the next document."""
    table = probes(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(rows, "text", "packed", table))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("moved", F.floor(F.col("n_chars") / 4).cast("int"))
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - F.col("moved")).cast("int")), F.substr("next.text", F.lit(1), F.col("moved")))
    rows = rows.select("doc_id", "n_chars", "packed", F.col("next.packed").alias("next_packed"), edited.alias("edited"))
    return with_fingerprint(rows, "edited", "edited_packed", table)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("packed")).alias("fingerprint"), shown(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"), likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
