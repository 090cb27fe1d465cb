"""Benchmark decontamination by a generalised suffix automaton of the test items.

The items' words (A-Z lowered) form one automaton; a text's words are streamed through it,
tracking the longest match that ends at each word. A match of `window` words or more, or of a
whole shorter item, is an occurrence, and marks its words and its items. Streaming starts only
where consecutive words occur next to each other in some item: elsewhere a match is one word.

The automaton is broadcast in blocks of items of a bounded size, each passed over all rows.

Defined results: null or empty text has no words; items without an id or words match nothing;
repeated ids count once; repeated rows are marked alike; without items nothing is hit. All
other columns of the documents are carried along whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm import textscan as ts
from calibrant.llm.worker import enter
from calibrant.session import ship, table

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first", pa.int64()), ("last", pa.int64())]))
#: start, end: bytes of the text; first, last: indexes of its words.
MARKS = "n_words long, spans array<struct<start: bigint, end: bigint, first: bigint, last: bigint>>, items array<string>"


def item_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


class Automaton:
    """Suffix automaton of several word sequences, with the items that each long enough state occurs in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = 10) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.items: dict[int, set[int]] = {}
        self.names = [name for name, _ in items]
        seqs = [[self.vocab.setdefault(w, len(self.vocab)) for w in words] for _, words in items]
        for seq in seqs:
            last = 0
            for w in seq:
                last = self._add(last, w)
        #: Shorter items match as a whole only: (words, item) by state.
        self.short: dict[int, dict[int, set[int]]] = {}
        self.lengths = sorted({len(s) for s in seqs if 0 < len(s) < window})
        self.least = min([window, *self.lengths])
        for i, seq in enumerate(seqs):
            at = 0
            for n, w in enumerate(seq, 1):
                at = self.next[at][w]
                if n >= window:
                    self.items.setdefault(self.suffix(at, n, window), set()).add(i)
            if 0 < len(seq) < window:
                self.short.setdefault(len(seq), {}).setdefault(at, set()).add(i)
        words = list(self.vocab)
        pairs = {(a, b) for _, ws in items for a, b in zip(ws, ws[1:])}
        hs = dict(zip(words, _hash(words).tolist()))
        self.grams = np.unique(ts.windows(np.array([hs[x] for p in pairs for x in p], np.uint64), 2)[::2]) if self.least > 1 and pairs else np.unique(np.array([*hs.values()], np.uint64))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.grams >> np.uint64(44)).astype(np.int64)] = True

    def _add(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, q, w)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w: int) -> int:
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def suffix(self, state: int, length: int, n: int) -> int:
        """The state of the last n of the `length` words that led to a state."""
        while self.len[self.link[state]] >= n:
            state = self.link[state]
        return state

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans of words (first, last + 1) inside occurrences, and the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        at = n = 0
        for i, word in enumerate(words):
            w = self.vocab.get(word, -1)
            while at and w not in self.next[at]:
                at = self.link[at]
                n = self.len[at]
            if w in self.next[at]:
                at, n = self.next[at][w], n + 1
            if n >= self.window:
                spans.append((i + 1 - self.window, i + 1))
                found |= self.items[self.suffix(at, n, self.window)]
            for k in self.lengths:
                if k <= n and (got := self.short[k].get(self.suffix(at, n, k))):
                    spans.append((i + 1 - k, i + 1))
                    found |= got
        return spans, found

    def candidates(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Ranges (first, last + 1) of words that may hold an occurrence, from word hashes and rows."""
        if not len(h):
            return np.zeros((0, 2), np.int64)
        if self.least > 1:
            g, extra = ts.windows(h, 2), 1
        else:
            g, extra = h, 0
        ok = self.seen[(g >> np.uint64(44)).astype(np.int64)]
        if extra:
            ok &= row[1:] == row[:-1]
        at = np.flatnonzero(ok)
        if not len(self.grams) or not len(at):
            return np.zeros((0, 2), np.int64)
        pos = np.minimum(np.searchsorted(self.grams, g[at]), len(self.grams) - 1)
        at = at[self.grams[pos] == g[at]]
        if not len(at):
            return np.zeros((0, 2), np.int64)
        # words of different rows are never in one range
        brk = np.flatnonzero((np.diff(at) != 1) | (row[at[1:]] != row[at[:-1]]))
        first, last = at[np.r_[0, brk + 1]], at[np.r_[brk, len(at) - 1]] + 1 + extra
        out = np.stack([first, last], 1)
        return out[out[:, 1] - out[:, 0] >= self.least]


def _hash(words: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    return ts.hashes(buf, np.r_[0, ends[:-1]].astype(np.int64) if len(words) else ends, ends, fold=True)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _mark_batches(batches: Iterator[pa.RecordBatch], text: int, auto: Broadcast, first_block: bool) -> Iterator[pa.RecordBatch]:
    enter("decontaminate")
    for b in batches:
        row_col = b.column(0)
        texts = row_col.flatten()[text]
        for s in ts.slices(texts):
            a: Automaton = auto.value
            w = ts.words(s, ts.ALNUM)
            row = w.rows()
            n = s.hi - s.lo
            spans: list[list] = [[] for _ in range(n)]
            items: list[list] = [[] for _ in range(n)]
            if not first_block:
                for i, (sp, it) in enumerate(zip(b.column(2).slice(s.lo, n).to_pylist(), b.column(3).slice(s.lo, n).to_pylist())):
                    spans[i] = [(x["first"], x["last"]) for x in sp]
                    items[i] = it
            for i, j in a.candidates(ts.hashes(s.buf, w.starts, w.ends, fold=True), row).tolist():
                r = int(row[i])
                part = s.buf[w.starts[i] : w.ends[j - 1]].tobytes().lower()
                got, found = a.stream(_WORD.findall(part))
                base = i - int(w.first[r])
                spans[r] += [(x + base, y + base) for x, y in got]
                items[r] += [a.names[k] for k in found]
            out_spans = []
            for r in range(n):
                f, o = int(w.first[r]), int(s.offs[r])
                out_spans.append([{"start": int(w.starts[f + x]) - o, "end": int(w.ends[f + y - 1]) - o, "first": x, "last": y} for x, y in _merge(spans[r])] if spans[r] else [])
            yield pa.RecordBatch.from_arrays(
                [row_col.slice(s.lo, n), pa.array(np.diff(w.first).astype(np.int64)), pa.array(out_spans, _SPANS), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))],
                ["row", "n_words", "spans", "items"],
            )


def blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items with an id and words, in blocks of about block_bytes of text; at least one block."""
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k)
        yield [(r["id"], ws) for r in part.collect() if (ws := item_words(r["text"]))]


def mark(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 1 << 20, keep: list[str] | None = None) -> DataFrame:
    """For every row of docs (`row`, a struct): n_words, spans inside occurrences, and the items that occur."""
    spark = docs.sparkSession
    ship(spark)
    names = docs.columns if keep is None else keep
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    schema = f"row {df.schema['row'].dataType.simpleString()}, {MARKS}"
    for k, block in enumerate(blocks(items, item_id, item_text, block_bytes)):
        if k:
            df = table(df, "marked")
        auto = spark.sparkContext.broadcast(Automaton(block, window))
        df = df.mapInArrow(partial(_mark_batches, text=names.index(text_col), auto=auto, first_block=not k), schema)
    return df


def n_hit() -> F.Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"])


def remove(docs: DataFrame, items: DataFrame, *, max_coverage: float = 0.5, max_words: int = 0, **kw) -> DataFrame:
    """Cut spans of more than max_words words; rows with more than max_coverage of their words hit go."""
    m = mark(docs, items, **kw).where(n_hit() <= F.lit(float(max_coverage)) * F.col("n_words"))
    cut = F.filter("spans", lambda x: x["last"] - x["first"] > max_words)
    raw = F.encode(F.col("row.text"), "utf-8")
    kept = F.concat(
        F.transform(cut, lambda x, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.element_at(cut, i.cast("int"))["end"]).alias("a"), x["start"].alias("b"))),
        F.array(F.struct(F.element_at(cut, -1)["end"].alias("a"), F.octet_length(F.col("row.text")).cast("long").alias("b"))),
    )
    pieces = F.transform(kept, lambda x: F.decode(F.substring(raw, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")), "utf-8"))
    text = F.when(F.size(cut) == 0, F.col("row.text")).otherwise(F.array_join(pieces, ""))
    changed = F.size(cut) > 0
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(text.alias("text"))
        elif c == "n_chars":
            cols.append(F.when(changed, F.length(text).cast("long")).otherwise(F.col("row.n_chars")).alias("n_chars"))
        else:
            cols.append(F.col(f"row.`{c}`").alias(c))
    return m.select(*cols)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mark(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return m.select("row.doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit() > 0).alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: benchmark passages are cut; documents that are mostly such go."""
    return remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
