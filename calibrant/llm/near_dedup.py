"""Near-duplicate classes by SetSketch registers: banding, likelihood estimate, exact check.

A text's set is its distinct word shingles, told apart by 64-bit hashes. Its sketch holds, for each of `registers` hash
functions, the smallest exponential over the set on a scale of powers of `base`, truncated to
16 bits; sketches of unions are register maxima. Texts with equal sets are one class: equal by a
128-bit cryptographic digest over the shingles themselves, not their hashes. Class
representatives that agree on all registers of a band are candidates; their Jaccard
similarity is estimated by likelihood from how many registers are larger, smaller and equal,
and those not clearly below the threshold are confirmed on their full sets of strings.

Only components are wanted, so a bucket's pairs are not all made. First every member meets the
bucket's first member. Of buckets that then still hold several components, small ones give the
pairs between these; large ones are dealt to pairs of blocks, in which each text outside the
bucket's largest component is held against the rest without a row for each pair. Every two
texts that share a bucket and are not in one component by then are compared.

With 32 bands of 4 registers a pair at the threshold of 0.8 is missed once in 10**7.

Defined results: a text of fewer words than a shingle is one shingle; null or empty texts and
those without words have an empty set and are linked with nothing; rows that repeat a doc_id
are one document whose texts' links are united; a null doc_id is linked with nothing, has a
null component and is kept; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm import textscan as ts
from calibrant.llm.graph import bounded, components
from calibrant.llm.worker import enter
from calibrant.session import ship, table

REGISTERS, ROWS, BASE = 128, 4, 1.001
_SCHEMA = "doc_id long, n_shingles long, digest binary, registers binary, keys array<long>"
_rng = np.random.Generator(np.random.PCG64(2024))
_MUL = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def shingle_hashes(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text with word hashes h, ascending, and where each is first."""
    return np.unique(ts.windows(h, min(width, len(h))), return_index=True) if len(h) else (h, np.zeros(0, np.int64))


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, width: int) -> bytes:
    """The shingles that begin at words `at`, one after another: each word with a space."""
    k = (at[:, None] + np.arange(width)[None, :]).ravel()
    a, size = starts[k], ends[k] - starts[k] + 1
    stop = np.cumsum(size)
    out = np.full(int(stop[-1]), 32, np.uint8)
    gone = np.arange(len(out)) - np.repeat(stop - size, size)  # byte of its word
    inside = np.ones(len(out), bool)
    inside[stop - 1] = False
    out[inside] = buf[(np.repeat(a, size) + gone)[inside]]
    return out.tobytes().lower()


def registers(u: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    x = (u >> np.uint64(32)).astype(np.uint32)
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        low = np.minimum(low, (x[i : i + 512, None] * _MUL + _ADD).min(axis=0))
    least = -np.log1p(-(low + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, 65535).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 101) -> np.ndarray:
    """Most likely Jaccard similarity of pairs of sets, from their registers (a row each) and sizes."""
    up, down = (ra > rb).sum(1)[:, None], (ra < rb).sum(1)[:, None]
    same = ra.shape[1] - up - down
    u, v = (na / (na + nb))[:, None], (nb / (na + nb))[:, None]
    j = np.linspace(0, 1, steps)[None, :] * np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    pu, pd = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    like = up * np.log(pu + tiny) + down * np.log(pd + tiny) + same * np.log(np.maximum(1 - pu - pd, tiny))
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def _sketch_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    enter("near_dedup")
    band = ts.mix(np.arange(1, REGISTERS // ROWS + 1, dtype=np.uint64))
    for b in batches:
        for s in ts.slices(b.column(1)):
            w = ts.words(s, ts.SPACED)
            h = ts.hashes(s.buf, w.starts, w.ends, fold=True)
            sizes, digests, regs, keys = [], [], [], []
            for i, j in zip(w.first[:-1], w.first[1:]):
                u, at = shingle_hashes(h[i:j], width)
                sizes.append(len(u))
                if len(u):
                    r = registers(u)
                    digests.append(hashlib.blake2b(_joined(s.buf, w.starts[i:j], w.ends[i:j], at, min(width, j - i)), digest_size=16, key=bytes([min(width, j - i)])).digest())
                    regs.append(r.tobytes())
                    keys.append(ts.mix(r.view("<u8") ^ band).astype(np.int64))
                else:
                    digests.append(None)
                    regs.append(None)
                    keys.append(np.zeros(0, np.int64))
            offs = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(s.lo, s.hi - s.lo), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary()), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))],
                ["doc_id", "n_shingles", "digest", "registers", "keys"],
            )


def sketches(docs: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, size, digest and registers of each row's set, and its band keys."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_sketch_batches, width=width), _SCHEMA)


def shingles(text: str | None, width: int) -> set:
    """A text's set as strings of bytes: A-Z lowered, words between ASCII white space."""
    words = (text or "").encode().lower().split()
    if len(words) <= width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


def _likely_batches(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    enter("near_dedup")
    for b in batches:
        if b.num_rows:
            regs = [np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (2, 3)]
            near = estimate(*regs, *(b.column(i).to_numpy().astype(float) for i in (4, 5))) >= least
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(near)) for i in (0, 1)], ["u", "v"])


def _linked(x: set, y: set, percent: int) -> bool:
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm_batches(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    enter("near_dedup")
    last: dict[int, tuple] = {0: (None, None), 1: (None, None)}

    def of(side: int, key, text) -> set:
        if last[side][0] != key:
            last[side] = (key, shingles(text.as_py(), width))
        return last[side][1]

    for b in batches:
        a, c, ta, tc = (b.column(i) for i in range(4))
        ia, ic = a.to_pylist(), c.to_pylist()
        out = pa.array([i for i in range(b.num_rows) if _linked(of(0, ia[i], ta[i]), of(1, ic[i], tc[i]), percent)], pa.int64())
        yield pa.RecordBatch.from_arrays([a.take(out), c.take(out)], ["u", "v"])


def _confirm(pairs: DataFrame, sets: DataFrame, texts: DataFrame, width: int, percent: int, margin: float) -> DataFrame:
    """The pairs (u, v) that are links: first by estimate, then on full sets."""
    reg = lambda side: sets.select(F.col("id").alias(side), F.col("registers").alias(f"r_{side}"), F.col("n_shingles").alias(f"n_{side}"))
    rows = pairs.join(reg("u"), "u").join(reg("v"), "v").select("u", "v", "r_u", "r_v", "n_u", "n_v")
    likely = table(rows.mapInArrow(partial(_likely_batches, least=percent / 100 - margin), "u long, v long"), "likely")
    text = lambda side: texts.select(F.col("id").alias(side), F.col("text").alias(f"t_{side}"))
    full = likely.join(text("u"), "u").join(text("v"), "v").select("u", "v", "t_u", "t_v")
    return full.mapInArrow(partial(_confirm_batches, width=width, percent=percent), "u long, v long").distinct()


def _block_links(pdf: pd.DataFrame, width: int, percent: int, margin: float) -> pd.DataFrame:
    """Links between the sides of one pair of blocks that join components not yet joined here."""
    pdf = pdf.sort_values("id", kind="stable").drop_duplicates(["side", "id", "text"])
    a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    same = not len(b)  # a block with itself
    b = a if same else b
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    sets: dict[tuple, set] = {}

    def of(i: int, text: str) -> set:
        if (i, text) not in sets:
            sets[i, text] = shingles(text, width)
        return sets[i, text]

    band = int(pdf["band"].iloc[0])
    kb, rb, nb = np.array(b["keys"].tolist()), np.frombuffer(b"".join(b["registers"]), "<u2").reshape(-1, REGISTERS), b["n"].to_numpy(float)
    ib, cb, tb = b["id"].tolist(), b["comp"].tolist(), b["text"].tolist()
    out = []
    for k, (i, comp, text, keys, regs, n) in enumerate(zip(a["id"], a["comp"], a["text"], a["keys"], a["registers"], a["n"])):
        # a pair belongs to the first band that its texts share
        ok = (kb[:, :band] != np.array(keys)[:band]).all(1) & (100 * np.minimum(nb, n) >= percent * np.maximum(nb, n))
        if same:
            ok[: k + 1] = False
        at = np.flatnonzero(ok)
        if not len(at):
            continue
        ra = np.broadcast_to(np.frombuffer(regs, "<u2"), (len(at), REGISTERS))
        at = at[estimate(ra, rb[at], np.full(len(at), float(n)), nb[at]) >= percent / 100 - margin]
        for j in at.tolist():
            if i != ib[j] and find(comp) != find(cb[j]) and _linked(of(i, text), of(ib[j], tb[j]), percent):
                parent[find(comp)] = find(cb[j])
                out.append((i, ib[j]))
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def _blocks(members: DataFrame, size: int) -> DataFrame:
    """Rows of large buckets dealt to pairs of blocks (key, i, j, side): each text that is not of its
    bucket's largest component meets all of the bucket, the others of that component only it."""
    count = members.groupBy("key", "comp").agg(F.count("*").alias("c"))
    of = lambda n: F.ceil(n / size).cast("int")
    info = count.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("n")).where(F.col("n") > F.col("m.c"))
    info = table(info.select("key", F.col("m.comp").alias("main"), of(F.col("n") - F.col("m.c")).alias("of_minor"), of(F.col("m.c")).alias("of_major")), "buckets")
    # a row for each large bucket: broadcast, as a join by key would bring a bucket into one task
    rows = members.join(bounded(info, longs=F.lit(4)), "key").withColumn("minor", (F.col("comp") != F.col("main")).cast("int"))
    # texts are dealt to blocks by hash, not numbered
    dealt = F.pmod(F.xxhash64("id"), F.when(F.col("minor") == 1, F.col("of_minor")).otherwise(F.col("of_major"))).cast("int")
    rows = rows.withColumn("block", dealt).withColumn("most_minor", F.col("of_minor") - 1).withColumn("most_major", F.col("of_major") - 1)
    b, last_minor, last_major = F.col("block"), F.col("most_minor"), F.col("most_major")
    spot = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    up_to = lambda n: F.sequence(F.lit(0), n)
    minor = F.concat(
        F.transform(up_to(last_major), lambda j: spot(0, b, j, 0)),
        F.transform(F.sequence(b, last_minor), lambda j: spot(1, b, j, 0)),
        F.transform(F.filter(up_to(b), lambda i: i < b), lambda i: spot(1, i, b, 1)),
    )
    major = F.transform(up_to(last_minor), lambda i: spot(0, i, b, 1))
    rows = rows.withColumn("spot", F.explode(F.when(F.col("minor") == 1, minor).otherwise(major)))
    return rows.select("key", "band", "id", "comp", "n", "spot.*")


def components_of(docs: DataFrame, width: int = 2, percent: int = 80, margin: float = 0.2, small: int = 24, block: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    rows = table(sketches(docs, width), "sketches")
    full = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = table(full.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = rows.select("doc_id", "n_shingles", "digest", "keys").join(classes, "digest").where(F.col("doc_id") == F.col("rep"))
    bands = reps.select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), F.posexplode("keys").alias("band", "key"))
    shared = bands.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("size")).where("a <> b").select("key", "size", F.col("a").alias("first"))
    members = table(bands.join(shared, "key").distinct(), "members")
    if members.isEmpty():
        return _result(rows, classes, None)
    ids = bounded(table(members.select("id").distinct(), "ids"))
    sets = rows.select(F.col("doc_id").alias("id"), "n_shingles", "registers", "keys", "digest").join(classes, "digest").where("id = rep").drop("rep", "digest")
    sets = table(sets.join(ids, "id", "left_semi").dropDuplicates(["id", "registers"]), "candidates")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    texts = table(texts.join(ids, "id", "left_semi").distinct(), "texts")
    # every member meets its bucket's first
    stars = members.where("id <> first").select(F.col("id").alias("u"), F.col("first").alias("v")).distinct()
    links = table(_confirm(stars, sets, texts, width, percent, margin), "links")
    comp = table(components(links), "components")
    here = members.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    still = here.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.max("size").alias("m")).where("a <> b AND m > 2").select("key")
    here = table(here.join(bounded(table(still, "still")), "key", "left_semi"), "open")
    few = here.where(F.col("size") <= small)
    other = few.select("key", F.col("id").alias("v"), F.col("n").alias("m"), F.col("comp").alias("other"))
    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    # the bucket's first was met above
    pairs = few.where("id <> first").join(other, "key").where((F.col("id") > F.col("v")) & (F.col("v") != F.col("first")) & (F.col("comp") != F.col("other")) & fits)
    more = table(_confirm(pairs.select(F.col("id").alias("u"), "v").distinct(), sets, texts, width, percent, margin), "links")
    spots = _blocks(here.where(F.col("size") > small), block)
    spots = spots.join(sets.select("id", "registers", "keys"), "id").join(texts, "id")
    fn = partial(_block_links, width=width, percent=percent, margin=margin)
    many = table(spots.groupBy("key", "kind", "i", "j").applyInPandas(fn, "u long, v long"), "links")
    found = more.union(many)
    if not found.isEmpty():
        comp = table(components(comp.select(F.col("id").alias("u"), F.col("comp").alias("v")).union(found)), "components")
    return _result(rows, classes, comp)


def _result(rows: DataFrame, classes: DataFrame, comp: DataFrame | None) -> DataFrame:
    of = rows.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    if comp is not None:
        of = of.join(comp.select(F.col("id").alias("rep"), "comp"), "rep", "left")
    else:
        of = of.withColumn("comp", F.col("rep"))
    of = of.withColumn("comp", F.coalesce("comp", "rep", "doc_id"))
    out = of.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("comp")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (five-word shingles, 0.8) the smallest doc_id stays.

    Of rows that are equal in all columns one stays; rows that repeat a doc_id with another text stay with it.
    """
    again = table(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again")), "again")
    if not again.isEmpty():
        twice = docs.join(again, docs["doc_id"] == again["again"], "left_semi").dropDuplicates()
        docs = table(docs.join(again, docs["doc_id"] == again["again"], "left_anti").union(twice), "rows")
    gone = table(components_of(docs, width=5).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct(), "gone")
    gone = bounded(gone)
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
      ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM d),
n AS (SELECT doc_id, len(g)::BIGINT AS n, g FROM s),
x AS (SELECT doc_id, n, unnest(g) AS g FROM n),
f AS (SELECT g, count(*) AS df FROM x GROUP BY g),
p AS (SELECT doc_id, n, x.g, row_number() OVER (PARTITION BY doc_id ORDER BY df, x.g) AS r FROM x JOIN f ON x.g = f.g),
pre AS (SELECT doc_id, n, g FROM p WHERE r <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT c.a, c.b FROM c JOIN n x ON x.doc_id = c.a JOIN n y ON y.doc_id = c.b
      WHERE 100 * len(list_intersect(x.g, y.g)) >= 80 * (x.n + y.n - len(list_intersect(x.g, y.g)))),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id WHERE r.m < e.b)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, t.m) AS component_id, n.doc_id = least(n.doc_id, t.m) AS kept
FROM n JOIN (SELECT doc_id, min(m) AS m FROM r GROUP BY doc_id) t USING (doc_id)
"""
