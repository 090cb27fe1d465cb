"""Prefix trie of conversations from a global range sort.

Every turn becomes a digest of fixed length, and a conversation's digests one after another its
key, so that keys in order of text put each prefix before what it begins. Keys are sorted by
ranges over the cluster, conversation ids breaking ties, so that copies of one conversation
spread over as many ranges as they fill. A trie node is then a run of neighbouring rows.

Each range is swept once: the longest common prefix with the row before says how many open nodes
end there (popped off a stack) and how many begin. Nodes that both begin and end in a range are
finished on the spot. Those on the way to a range's first or last row may go on in the range
before or after; they leave partial sums, and each range its first and last key. The common
prefix of two neighbouring ranges' keys says which open nodes are one: what both sides counted
twice there (a child, the words of a node, a leaf that goes on) is taken off by column
arithmetic, and the parts of a node are added up by key. All sums are of this additive kind:

* members;
* children, less one where the child is one too;
* leaves below, less one where the last key of the range before is what the next begins with;
* saved tokens below, (members - 1) times words, so plus the words of all nodes that are one.

The ids that end at a node lie side by side in order. They are hashed on the spot if they are few
and the node is finished; else they leave the range in pieces of bounded length, which one task
strings together as they pass.

What is broadcast: three numbers for each range, and the nodes on the way to a range's first or
last row where they are few (`graph.bounded`).

Defined results: rows without conv_id belong to no conversation; null role or text counts as
empty; null turns come first; rows that repeat a turn number are turns of their own, ordered by
digest; no rows give no nodes; other columns are not read. A conversation's key is one value,
of 32 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm.graph import bounded
from calibrant.llm.worker import enter
from calibrant.session import ship, table

#: Characters of a turn's digest: 128 bits of SHA-256 in hex.
WIDTH = 32
#: Characters of a piece of an open node's list of ids.
PIECE = 1 << 15
#: Digest of a node where no conversation ends.
NO_ENDS = hashlib.sha256(b"").hexdigest()
_WORDS = r"[^\x20\x09-\x0D]+"


def turn_digest(role: Column, text: Column) -> Column:
    """Equal for equal role and text; the length keeps the two apart."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, WIDTH)


def keys(conversations: DataFrame) -> DataFrame:
    """(conv_id, key, words): each conversation's digests in order of turn as one string, and the words of its turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), turn_digest(role, text).alias("digest"), F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("words")).alias("t"))
    rows = rows.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))  # nulls first
    return rows.select("conv_id", F.array_join("t.digest", "").alias("key"), F.col("t.words").alias("words"))


def rebuild(own: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Keys after the sharing of first turns: the first h of conversation c - c % group, then c's own after its first h; h = crc32(c) % most."""
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("h_id"), F.substring("key", 1, WIDTH * (most - 1)).alias("h_key"), F.slice("words", 1, most - 1).alias("h_words"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    rows = own.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % group == F.col("h_id"), "left")
    none = F.array().cast("array<long>")
    return rows.select(
        "conv_id",
        F.concat(F.coalesce(F.substr("h_key", F.lit(1), F.col("h") * WIDTH), F.lit("")), F.substr("key", F.col("h") * WIDTH + 1, F.length("key"))).alias("key"),
        F.concat(F.coalesce(F.slice("h_words", F.lit(1), F.col("h")), none), F.slice("words", F.col("h") + 1, F.greatest(F.size("words") - F.col("h"), F.lit(0)))).alias("words"),
    )


def common(a: str, b: str) -> int:
    """Turns that two keys begin with alike."""
    most = min(len(a), len(b)) // WIDTH
    if a[: most * WIDTH] == b[: most * WIDTH]:
        return most
    low = 0
    while most - low > 1:  # a[: low] agree, a[: most] do not
        mid = (low + most) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            most = mid
    return low


@dataclass
class Open:
    """A node whose run of rows has not ended."""

    depth: int
    words: int  # of its last text
    before: int  # of the texts above it
    first: bool  # on the way to the range's first row
    low: int | None = None
    convs: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    parted: bool = False  # ids that end at it or below it have left in pieces
    name: str | None = None
    ends: list[str] = field(default_factory=list)
    size: int = 0  # characters of ends
    waiting: list[dict] = field(default_factory=list)  # finished children, until the smallest member here is known


#: Finished nodes have no key, but their parent's where that one is open; parts of open ones have both; pieces of ids have `piece`, and a range's ends have `front`.
_SWEPT = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key string, parent_key string, part int, first boolean, before long, piece string, at int, front string, back string, totals array<long>"


class Sweep:
    """Rows of one range, in order, to records of _SWEPT."""

    def __init__(self, part: int) -> None:
        self.part, self.out = part, []
        self.stack: list[Open] = []
        self.key, self.totals = "", [0]
        self.front: tuple[str, list[int]] | None = None
        self.pieces = 0

    def _name(self, node: Open) -> str:
        if node.name is None:
            node.name = hashlib.sha256(self.key[: node.depth * WIDTH].encode()).hexdigest()
        return node.name

    def _piece(self, node: Open) -> None:
        self.out.append({"key": self._name(node), "part": self.part, "piece": ",".join(node.ends), "at": self.pieces})
        self.pieces += 1
        node.ends, node.size, node.parted = [], 0, True

    def _close(self, last: bool) -> None:
        """The innermost open node ends here, or at least this range does (last)."""
        node = self.stack.pop()
        up = self.stack[-1] if self.stack else None
        node.leaves += not node.children
        node.saved += (node.convs - 1) * node.words
        rec = {"conv_id": node.low, "depth": node.depth, "n_convs": node.convs, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}
        goes_on = node.first or last
        for child in node.waiting:
            self.out.append(child | ({"parent_key": self._name(node)} if goes_on else {"parent_conv_id": node.low}))
        if goes_on or node.parted:
            if node.ends:
                self._piece(node)
            self.out.append(rec | {"key": self._name(node), "parent_key": self._name(up) if up else None, "part": self.part, "first": node.first, "before": node.before})
        else:
            rec["ends_sha256"] = hashlib.sha256(",".join(node.ends).encode()).hexdigest() if node.ends else NO_ENDS
            if up.first:  # a child of a node that other ranges may have too need not wait
                self.out.append(rec | {"parent_key": self._name(up)})
            else:
                up.waiting.append(rec)
        if up:
            up.low = node.low if up.low is None else min(up.low, node.low)
            up.convs += node.convs
            up.leaves += node.leaves
            up.saved += node.saved
            up.parted |= node.parted

    def row(self, conv_id: int, key: str, words: list[int]) -> None:
        depth, first = len(key) // WIDTH, self.front is None
        same = -1 if first else common(self.key, key)
        while len(self.stack) > same + 1:
            self._close(False)
        del self.totals[max(same, 0) + 1 :]
        for d in range(same + 1, depth + 1):
            own = words[d - 1] if d else 0
            if d:
                self.totals.append(self.totals[-1] + own)
                self.stack[-1].children += 1
            self.stack.append(Open(d, own, self.totals[-1] - own, first))
        if first:
            self.front = key, list(self.totals)
        self.key = key
        node, text = self.stack[-1], str(conv_id)
        node.convs += 1
        node.low = conv_id if node.low is None else min(node.low, conv_id)
        node.ends.append(text)
        node.size += len(text) + 1
        if node.size > PIECE:
            self._piece(node)

    def end(self) -> None:
        if self.front is None:
            return
        while self.stack:
            self._close(True)
        self.out.append({"part": self.part, "front": self.front[0], "totals": self.front[1], "back": self.key})

    def records(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _SCHEMA], schema=_SCHEMA)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
_SCHEMA = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in _SWEPT.split(", ")])


def _sweep_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("prefix_trie")
    sweep = Sweep(TaskContext.get().partitionId())
    for b in batches:
        for conv_id, key, words in zip(*(c.to_pylist() for c in b.columns)):
            sweep.row(conv_id, key, words)
            if len(sweep.out) >= 4096:
                yield sweep.records()
    sweep.end()
    yield sweep.records()


def _seam_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, front, totals, back of the range before) to how deep the nodes are that both ranges have."""
    for b in batches:
        rows = [(part, same := common(back, front), totals[same], same * WIDTH == len(back)) for part, front, totals, back in zip(*(c.to_pylist() for c in b.columns))]
        cols = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.bool_()))], names=["part", "same", "total", "goes_on"])


def _string_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one digest a key."""
    enter("prefix_trie")
    key, h = None, None
    for b in batches:
        done = []
        for k, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if k != key:
                if h:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(piece.encode())
            else:
                h.update(f",{piece}".encode())
        yield _strings(done)
    yield _strings([(key, h.hexdigest())] if h else [])


def _strings(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["e_key", "e_hash"])


def _seams(swept: DataFrame) -> DataFrame:
    """(part, same, total, goes_on): a row for each range but the first."""
    spark = swept.sparkSession
    ends = swept.where(F.col("front").isNotNull()).select("part", "front", "totals", "back")
    parts = sorted(r["part"] for r in ends.select("part").collect())  # one number for each range
    after = spark.createDataFrame(list(zip(parts[1:], parts)), "part int, was int")
    back = ends.select(F.col("part").alias("was"), F.col("back").alias("was_back"))
    rows = ends.join(F.broadcast(after), "part").join(back, "was").select("part", "front", "totals", "was_back")
    return rows.mapInArrow(_seam_batches, "part int, same int, total long, goes_on boolean")


def build(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """The trie's nodes over rows(conv_id, key, words), a row for each."""
    spark = rows.sparkSession
    ship(spark)
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(rows, "keys")  # the sort samples it before it is dealt out
    swept = table(rows.select("conv_id", "key", "words").repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_sweep_batches, _SWEPT), "swept")
    seams = F.broadcast(_seams(swept))
    own = swept.where(F.col("key").isNotNull() & F.col("piece").isNull()).join(seams, "part", "left")
    one = F.col("first") & (F.col("same") >= F.col("depth"))  # with the range before
    less = lambda x, flag: F.col(x) - F.coalesce(flag, F.lit(False)).cast("long")
    parts = own.select(
        "key", "parent_key", "depth", "conv_id", "n_convs",
        less("n_children", F.col("first") & (F.col("same") > F.col("depth"))).alias("n_children"),
        less("n_leaves", one & F.col("goes_on")).alias("n_leaves"),
        (F.col("saved_tokens") + F.when(one, F.col("total") - F.col("before")).otherwise(0)).alias("saved_tokens"),
    )
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    merged = parts.groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums))
    pieces = swept.where(F.col("piece").isNotNull()).repartition(n, "key").sortWithinPartitions("key", "part", "at").select("key", "piece")
    merged = table(merged.join(pieces.mapInArrow(_string_batches, "e_key string, e_hash string"), F.col("key") == F.col("e_key"), "left"), "merged")
    names = bounded(merged.select(F.col("key").alias("up"), F.col("conv_id").alias("up_id")), longs=F.lit(10))
    cols = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    whole = merged.join(names, F.col("parent_key") == F.col("up"), "left").withColumns({"parent_conv_id": F.col("up_id"), "ends_sha256": F.coalesce("e_hash", F.lit(NO_ENDS))}).select(*cols)
    inner = swept.where(F.col("key").isNull() & F.col("front").isNull())
    inner = inner.join(names, F.col("parent_key") == F.col("up"), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up_id")).select(*cols)
    return whole.union(inner).withColumn("depth", F.col("depth").cast("long"))


def trie(conversations: DataFrame, ranges: int | None = None) -> DataFrame:
    """The trie of conversations(conv_id, turn, role, text) as they are."""
    return build(keys(conversations), ranges)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(keys(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "own")
    return build(rebuild(own)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE = r"""WITH turns AS (
  SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT *, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda crc, b: list_reduce([xor(crc, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295) % 4 AS h
  FROM turns),
rebuilt AS (
  SELECT c.conv_id, coalesce(g.t[1:c.h], []) || c.t[c.h + 1:] AS t FROM hashed c LEFT JOIN turns g ON g.conv_id = c.conv_id - c.conv_id % 20),
paths AS (SELECT conv_id, len(t) AS n, unnest(range(len(t) + 1)) AS depth, t FROM rebuilt),
node AS (
  SELECT conv_id, depth, n, min(conv_id) OVER w AS rep, count(*) OVER w AS n_convs, CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(t[depth][2], '[^ 	-
]+')) END AS words
  FROM paths WINDOW w AS (PARTITION BY depth, sha256(t[1:depth]::VARCHAR) || len(list_transform(t[1:depth], lambda x: x[1] || x[2])::VARCHAR))),
own AS (SELECT rep, depth, any_value(n_convs) AS n_convs, any_value(words) AS words, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends FROM node GROUP BY ALL),
up AS (SELECT o.rep, o.depth, p.rep AS parent FROM own o LEFT JOIN node p ON p.conv_id = o.rep AND p.depth = o.depth - 1),
kids AS (SELECT parent AS rep, depth - 1 AS depth, count(*) AS n FROM up WHERE depth > 0 GROUP BY ALL),
below AS (
  SELECT a.rep, a.depth, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((o.n_convs - 1) * o.words) AS saved
  FROM own o LEFT JOIN kids k USING (rep, depth) JOIN node a ON a.conv_id = o.rep AND a.depth <= o.depth GROUP BY ALL)
SELECT rep AS conv_id, depth, parent AS parent_conv_id, n_convs, coalesce(kids.n, 0) AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM own JOIN up USING (rep, depth) JOIN below USING (rep, depth) LEFT JOIN kids USING (rep, depth)"""
