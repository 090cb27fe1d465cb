"""Substring dedup: content-defined chunks, equal by digest, and the windows at their edges.

A gear rolling hash over the last 16 bytes is taken at each word start; a chunk begins where
that hash is the least among the words near it, so that cuts depend on nearby text alone and
an insertion shifts no cut but those beside it. Chunks that occur earlier (in order of doc_id
and place) point to their first occurrence. Chunks one after another that point to chunks one
after another are a run: its bytes stand in the earlier text as well, and if it has min_words
words or more it is a repeated passage as far as it goes.

What is left are windows of min_words words whose inner chunks all repeat but that lie in no run:
at the edges of runs, or in passages too short for one. These are hashed, and each that occurs
earlier is a repeated passage. The earliest place of a window is never in a run, as a run points
to something earlier still; so it is among the hashed ones, and every window that stands earlier
is found, whichever earlier text holds it. All words of repeated passages are removed.

The work is in proportion to the text, however often it repeats itself: a text gives a row for
each chunk, and one for each left window that it has not had before; no text travels to another.
Digests of chunks that very many texts hold, and of such windows, are joined by broadcast, and
their number is bounded by construction.

Chunk digests have 64 bits and a run many of them; window digests have 128.

Defined results: null stays null; an empty text has no chunks; rows with a null doc_id or one
that other rows repeat count as later than all others, in order of doc_id (null last) and of a
hash of the text, equal rows one after another; they are cut like all others. Other columns are
carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.functions.dists import let
from calibrant.llm import textscan as ts
from calibrant.llm.graph import bounded
from calibrant.llm.worker import enter
from calibrant.session import ship, table

#: Words on either side that a chunk's first word is compared with.
NEAR = 4
#: Words at a window's beginning and end whose cuts may depend on text outside it: 16 bytes are 8 words at most.
RIM = (NEAR + 9, NEAR + 1)
#: Bits of a byte or chunk number in a packed (key, number).
BITS = 21
#: Digests with more rows than this are joined by broadcast; the bound grows with the rows, so that there are MOST_HOT of them at most.
HOT, MOST_HOT = 1000, 250_000
_GEAR = np.random.Generator(np.random.PCG64(99)).integers(0, 2**32, 256, dtype=np.uint32)
_SPANS = "array<struct<start: bigint, end: bigint, source: bigint>>"
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def gear(s: ts.Slice) -> np.ndarray:
    """h = (h << 2) + GEAR[byte], 32 bits, so over 16 bytes; starts anew in each row."""
    h = _GEAR[s.buf]
    for lag in (1, 2, 4, 8):
        if len(h) <= lag:
            break
        back = np.zeros_like(h)
        back[lag:] = h[:-lag]
        head = (s.offs[:-1, None] + np.arange(lag)[None, :])[np.arange(lag)[None, :] < np.diff(s.offs)[:, None]]
        back[head] = 0
        h = h + (back << np.uint32(2 * lag))
    return h


def chunks(s: ts.Slice) -> ts.Spans:
    """Chunks of each row: they cover it whole; none for an empty row."""
    w = ts.words(s, ts.SPACED)
    n, size, row = len(w.starts), np.diff(s.offs), w.rows()
    # the hash of what stands before a word; the first of equal ones counts as least
    h = gear(s)[np.maximum(w.starts - 1, 0)].astype(np.int64) if n else np.zeros(0, np.int64)
    h[np.isin(w.starts, s.offs)] = 1 << 33  # nothing stands before it
    least = np.ones(n, bool)
    for k in range(1, NEAR + 1):
        if n > k:
            same = row[k:] == row[:-k]
            least[k:] &= ~same | (h[k:] < h[:-k])
            least[:-k] &= ~same | (h[:-k] <= h[k:])
    at = w.starts[least]
    at = at[~np.isin(at, s.offs)]
    starts = np.sort(np.r_[at, s.offs[:-1][size > 0]])
    first = np.searchsorted(starts, s.offs)
    return ts.Spans(starts, np.r_[starts[1:], s.offs[-1:]] if len(starts) else starts, first)


def _open(begins: np.ndarray, n: int, known: np.ndarray, size: int) -> np.ndarray:
    """Runs (begin, end, begin, ...) of windows of size words without a whole inner chunk that is not known.

    begins: each chunk's first word; n: words of the text; known: whether each chunk counts.
    """
    if n < size:
        return np.zeros(0, np.int64)
    lo = np.maximum(np.r_[begins[1:], n + size] - size + RIM[1], 0)
    hi = np.minimum(begins - RIM[0] + 1, n - size + 1)
    bad = ~known & (lo < hi)
    shut = np.zeros(n - size + 2, np.int64)
    np.add.at(shut, lo[bad], 1)
    np.add.at(shut, hi[bad], -1)
    free = np.r_[False, np.cumsum(shut[:-1]) == 0, False]
    return np.flatnonzero(free[1:] != free[:-1])


_CHUNKS = "key long, digests array<long>, begins array<int>, starts array<int>, n_words int, n_bytes int, open boolean"


def _chunk_batches(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    enter("substring_dedup")
    for b in batches:
        for s in ts.slices(b.column(1)):
            c, w = chunks(s), ts.words(s, ts.SPACED)
            got = ts.hashes(s.buf, c.starts, c.ends).astype(np.int64)
            n, per, lists = np.diff(w.first), np.diff(c.first), pa.array(c.first.astype(np.int32))
            begins = np.searchsorted(w.starts, c.starts) - np.repeat(w.first[:-1], per)
            starts = c.starts - np.repeat(s.offs[:-1], per)
            free = [bool(len(_open(begins[i:j], k, np.zeros(j - i, bool), min_words))) for i, j, k in zip(c.first[:-1].tolist(), c.first[1:].tolist(), n.tolist())]
            arrays = [pa.ListArray.from_arrays(lists, pa.array(x)) for x in (got, begins.astype(np.int32), starts.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(s.lo, s.hi - s.lo), *arrays, pa.array(n.astype(np.int32)), pa.array(np.diff(s.offs).astype(np.int32)), pa.array(free)],
                ["key", "digests", "begins", "starts", "n_words", "n_bytes", "open"],
            )


_RUNS = f"key long, spans {_SPANS}, left array<int>"


def _run_batches(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """(key, begins, starts, n_words, n_bytes, repeated chunks) to the passages that runs cover, and the windows left (begin, end, begin, ...)."""
    enter("substring_dedup")
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64())]))
    for b in batches:
        keys, spans, left = [], [], []
        for key, begins, starts, n, size, at in zip(b.column(0).to_pylist(), *(b.column(k) for k in (1, 2)), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5)):
            begins, starts = begins.values.to_numpy(), starts.values.to_numpy()
            known = np.zeros(len(begins), bool)
            found = []
            if at.is_valid:
                place, source, first = (at.values.field(k).to_numpy() for k in range(3))
                order = np.argsort(place)
                place, source, first = place[order], source[order], first[order]
                known[place] = True
                earlier = (source != key) | (first != place)
                place, source, first = place[earlier], source[earlier], first[earlier]
                if len(place):
                    cut = np.flatnonzero((np.diff(place) != 1) | (np.diff(first) != 1) | (np.diff(source) != 0)) + 1
                    lo, hi = np.r_[0, cut], np.r_[cut, len(place)]
                    k0, k1 = place[lo], place[hi - 1] + 1
                    w0, w1 = begins[k0], np.r_[begins, n][k1]
                    long = w1 - w0 >= min_words
                    found = list(zip(starts[k0][long].tolist(), np.r_[starts, size][k1][long].tolist(), source[lo][long].tolist()))
                    w0, w1 = w0[long], w1[long]
            runs = _open(begins, n, known, min_words)
            if found and len(runs):
                most = int(runs[-1]) + 1
                shut = np.zeros(most + 1, np.int64)
                np.add.at(shut, runs, np.tile([1, -1], len(runs) // 2))
                free = np.cumsum(shut)[:most] > 0
                for i, j in zip(w0.tolist(), w1.tolist()):
                    free[i : max(i, j - min_words + 1)] = False
                free = np.r_[False, free, False]
                runs = np.flatnonzero(free[1:] != free[:-1])
            if found or len(runs):
                keys.append(key)
                spans.append([{"start": i, "end": j, "source": k} for i, j, k in found])
                left.append(runs.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(spans, spans_type), pa.array(left, pa.list_(pa.int32()))], ["key", "spans", "left"])


_WINDOWS = "h1 long, h2 long, key long, place long, end long"


def _window_batches(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """(key, text, windows) to a row for each window's first place in its text, and rows without digest for all later places, joined where they touch."""
    enter("substring_dedup")
    for b in batches:
        for s in ts.slices(b.column(1)):
            w = ts.words(s, ts.SPACED)
            n = s.hi - s.lo
            per = [np.concatenate([np.arange(i, j) for i, j in r.values.to_numpy().reshape(-1, 2)]) for r in b.column(2).slice(s.lo, n)]
            sizes = [len(x) for x in per]
            row = np.repeat(np.arange(n), sizes)
            at = np.concatenate(per) + np.repeat(w.first[:-1], sizes)
            # a word with the space after it; the last of a window without
            gaps, words = ts.hashes(s.buf, w.starts, np.r_[w.starts[1:], w.ends[-1:]]), ts.hashes(s.buf, w.starts, w.ends)
            with np.errstate(over="ignore"):
                h1 = ts.mix(ts.windows(gaps, min_words - 1)[at] * np.uint64(0x9DDFEA08EB382D69) + words[at + min_words - 1])
                h2 = ts.mix(ts.windows(ts.mix(gaps * _OTHER), min_words - 1)[at] * _OTHER + ts.mix(words[at + min_words - 1] * _OTHER))
            ends = np.r_[w.starts[1:], w.ends[-1:]]
            after = at + min_words
            last = after == w.first[row + 1]
            end = np.where(last, s.offs[row + 1], ends[after - 1]) - s.offs[row]
            place = w.starts[at] - s.offs[row]
            key = np.repeat(b.column(0).slice(s.lo, n).to_numpy(), sizes)
            order = np.lexsort((place, h2, h1, row))
            again = np.zeros(len(at), bool)
            again[order[1:]] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1]) & (row[order][1:] == row[order][:-1])
            first, later = np.flatnonzero(~again), np.flatnonzero(again)
            names = ["h1", "h2", "key", "place", "end"]
            yield pa.RecordBatch.from_arrays([pa.array(h1[first].astype(np.int64)), pa.array(h2[first].astype(np.int64)), pa.array(key[first]), pa.array(place[first]), pa.array(end[first])], names)
            if len(later):
                apart = np.flatnonzero((row[later][1:] != row[later][:-1]) | (place[later][1:] > end[later][:-1]))
                lo, hi = np.r_[0, apart + 1], np.r_[apart, len(later) - 1]
                none = pa.nulls(len(lo), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(key[later[lo]]), pa.array(place[later[lo]]), pa.array(end[later[hi]])], names)


def _starts(text: bytes) -> list[int]:
    s = ts.Slice(0, 1, np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64))
    return chunks(s).starts.tolist()


def _join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, spans in any order) to disjoint ascending spans; of joined ones the first one's source counts."""
    for b in batches:
        out = []
        for all_spans in b.column(1).to_pylist():
            spans: list[dict] = []
            for x in sorted(all_spans, key=lambda x: (x["start"], -x["end"], x["source"])):
                if spans and x["start"] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], x["end"])
                else:
                    spans.append(x)
            out.append(spans)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, b.schema.field(1).type)], ["cut_id", "spans"])


def earlier(rows: DataFrame, by: list[str], it: str) -> DataFrame:
    """rows whose key `by` an earlier row, by `it`, has too, and the first of such rows, with `first`, that row's `it`."""
    many = table(rows.groupBy(*by).agg(F.min(it).alias("first"), F.count("*").alias("n")).where("n > 1"), "many")
    limit = max(HOT, (many.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    hot = F.broadcast(many.where(F.col("n") > limit).drop("n"))  # MOST_HOT rows at most, as these have more than `limit` rows each
    cold = rows.join(hot, by, "left_anti").join(many.where(F.col("n") <= limit).drop("n"), by)
    return rows.join(hot, by).unionByName(cold)


def keyed(docs: DataFrame) -> DataFrame:
    """(key, row, text): a number for each row, the doc_id where that is one row's alone; the numbers of other rows come after these."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("key"), F.col("text").cast("string").alias("text"))
    again = table(rows.groupBy("key").count().where("count > 1 or key is null").select("key"), "repeated")
    if again.isEmpty():
        return rows
    odd = F.col("key").eqNullSafe(F.col("a_key"))
    ids = bounded(again.withColumnRenamed("key", "a_key"))
    single = rows.join(ids, odd, "left_anti")
    top = single.agg(F.max("key")).first()[0]
    order = ["key_last", "key", "digest"]
    others = rows.join(ids, odd, "left_semi").withColumns({"key_last": F.col("key").isNull(), "digest": F.sha2("text", 256)})
    dealt = table(others.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id()), "others")
    low = dealt.groupBy("part").agg(F.count("*").alias("n"), F.min("nth").alias("low")).orderBy("part").collect()  # a row for each range
    at, before = (-1 if top is None else top) + 1, []
    for r in low:
        before.append((r["part"], at - r["low"]))
        at += r["n"]
    shift = F.broadcast(docs.sparkSession.createDataFrame(before, "part int, shift long"))
    return single.unionByName(dealt.join(shift, "part").select("row", (F.col("nth") + F.col("shift")).alias("key"), "text"))


def cut_spans(rows: DataFrame, min_words: int = 50) -> DataFrame:
    """(cut_id, spans) of rows(key, text): disjoint ascending byte ranges that an earlier place holds too, and the key of a text that does."""
    ship(rows.sparkSession)
    rows = rows.select("key", "text").where(F.col("text").isNotNull())
    own = table(rows.mapInArrow(partial(_chunk_batches, min_words=min_words), _CHUNKS), "chunks")
    most = own.agg(F.max("key"), F.min("key"), F.max("n_bytes")).first()
    packs = most[0] is None or (most[0] < 1 << (63 - BITS) and most[1] >= 0 and most[2] < 1 << BITS)
    it = F.shiftleft("key", BITS) + F.col("place") if packs else F.struct("key", F.col("place").cast("long").alias("place"))
    key = lambda c: F.shiftright(c, BITS) if packs else F.col(f"{c}.key")
    place = lambda c: F.col(c).bitwiseAND((1 << BITS) - 1) if packs else F.col(f"{c}.place")

    flat = own.select("key", F.posexplode("digests").alias("place", "digest")).select("digest", it.alias("it"))
    dup = earlier(flat, ["digest"], "it").select(key("it").alias("d_key"), F.struct(place("it").cast("int").alias("place"), key("first").alias("source"), place("first").cast("int").alias("first")).alias("at"))
    dup = dup.groupBy("d_key").agg(F.collect_list("at").alias("at"))
    runs = own.drop("digests").join(dup, F.col("key") == F.col("d_key"), "left").where(F.col("open") | F.col("at").isNotNull())
    runs = table(runs.select("key", "begins", "starts", "n_words", "n_bytes", "at").mapInArrow(partial(_run_batches, min_words=min_words), _RUNS), "runs")

    left = runs.where(F.size("left") > 0).select("key", "left")
    held = rows.join(bounded(left.select("key")), "key", "left_semi")  # other texts are not shuffled
    some = table(held.join(left, "key").select("key", "text", "left").mapInArrow(partial(_window_batches, min_words=min_words), _WINDOWS), "windows")
    found = earlier(some.where(F.col("h1").isNotNull()).select("h1", "h2", it.alias("it"), "end"), ["h1", "h2"], "it").where(F.col("it") != F.col("first"))
    found = found.select(key("it").alias("key"), place("it").cast("long").alias("start"), "end", key("first").alias("source"))
    again = some.where(F.col("h1").isNull()).select("key", F.col("place").alias("start"), "end", F.col("key").alias("source"))
    spans = runs.select("key", F.inline("spans")).unionByName(found).unionByName(again)
    return spans.groupBy("key").agg(F.collect_list(F.struct("start", "end", "source")).alias("spans")).mapInArrow(_join_batches, f"cut_id long, spans {_SPANS}")


def dedup(docs: DataFrame, **kw) -> DataFrame:
    """docs as `row` (a struct), with `spans` to remove (null if none) and `text` without them."""
    rows = keyed(docs)
    cuts = table(cut_spans(rows, **kw), "cuts")
    rows = rows.join(bounded(cuts, longs=1 + 3 * F.size("spans")), F.col("key") == F.col("cut_id"), "left")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end"))
    ends = F.concat(F.col("spans.start"), F.array(F.octet_length("text").cast("long")))
    pieces = let(F.encode("text", "utf-8"), lambda raw: F.zip_with(begins, ends, lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")), "utf-8")))
    return rows.select("row", "spans", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(pieces, "")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "row.doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        (F.coalesce(F.length("row.text"), F.lit(0)) - F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_passages"), F.col("spans").isNotNull().alias("cut"),
        F.coalesce("spans.source", F.array().cast("array<long>")).alias("sources"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages are cut; documents of which no word is left go."""
    out = dedup(docs).where(F.col("spans").isNull() | F.col("text").rlike(r"[^\s]"))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast("long")).alias("n_chars"))
        else:
            cols.append(F.col(f"row.`{c}`").alias(c))
    return out.select(*cols)
