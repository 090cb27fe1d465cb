"""Language identification with unigrams of pieces, summed over all segmentations.

The pieces are all normal ones of a fixed public vocabulary, with every other character as a
piece of its own kind. For each language piece probabilities are estimated by expectation
maximisation (forward-backward) over the words of a sample bounded in texts and bytes. A text's
likelihood in a language is the product over its words of the forward sum over all ways to cut
the word into pieces; sums are scaled as they go, so a word may have any length.

Words are runs of letters, digits and non-ASCII characters, A-Z lowered, each after a word
mark; the sums of words met before are kept in a bounded table, which changes no result. In
training a word of more than CUT characters counts as several.

Defined results: null texts and texts without letters are `und` with score 0; repeated rows are
told alike; ties go to the first language in order; without training texts all are `und`.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm import sp_model
from calibrant.llm import textscan as ts
from calibrant.llm.sample import labelled
from calibrant.llm.worker import tenant
from calibrant.session import ship

UND = "und"
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Characters from which a word is trained on in parts.
CUT = 500


def _step(h: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of strings with one more code point each."""
    with np.errstate(over="ignore"):
        h = (h + points.astype(np.uint64) + np.uint64(1)) * _MUL
    return h ^ (h >> np.uint64(29))


class Vocabulary:
    """Ids by hash of the pieces; the last id is for other characters."""

    def __init__(self, pieces: list[str]) -> None:
        pieces = [p for p in dict.fromkeys(p.lower() for p in pieces) if p]
        self.size, self.longest = len(pieces) + 1, max(map(len, pieces), default=1)
        h = np.zeros(len(pieces), np.uint64)
        for k in range(self.longest):
            at = np.array([i for i, p in enumerate(pieces) if len(p) > k], np.int64)
            h[at] = _step(h[at], np.array([ord(pieces[i][k]) for i in at.tolist()], np.uint32))
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.seen = np.zeros(1 << 18, bool)
        self.seen[h >> np.uint64(46)] = True

    def find(self, h: np.ndarray, one: bool) -> tuple[np.ndarray, np.ndarray]:
        """Which of the strings with these hashes are pieces, and their ids; one: of one character, so that all are."""
        at = np.arange(len(h)) if one else np.flatnonzero(self.seen[h >> np.uint64(46)])
        if not len(self.hashes):
            return at, np.full(len(at), self.size - 1)
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        ok = self.hashes[k] == h[at]
        if one:
            return at, np.where(ok, self.order[k], self.size - 1)
        return at[ok], self.order[k[ok]]


def _groups(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Words by length: their indexes, and a matrix of code points with the word mark first."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, at in by.items():
        flat = np.frombuffer("".join(words[i] for i in at).encode("utf-32-le"), "<u4").reshape(len(at), n)
        yield at, np.concatenate([np.full((len(at), 1), 0x2581, np.uint32), flat], 1)


def _arcs(v: Vocabulary, m: np.ndarray) -> Iterator[tuple[int, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """For each place (length, rows, piece ids) of the pieces that begin there."""
    n = m.shape[1]
    for i in range(n):
        h, arcs = np.zeros(len(m), np.uint64), []
        for k in range(1, min(v.longest, n - i) + 1):
            h = _step(h, m[:, i + k - 1])
            rows, ids = v.find(h, k == 1)
            if len(rows):
                arcs.append((k, rows.astype(np.int32), ids.astype(np.int32)))
        yield i, arcs


def forward(v: Vocabulary, logp: np.ndarray, words: list[str]) -> np.ndarray:
    """Log of the sum over all segmentations, a row for each word and a column for each language."""
    out = np.zeros((len(words), logp.shape[1]))
    p = np.exp(logp)
    for at, m in _groups(words):
        for lo in range(0, len(at), 20_000):
            part = m[lo : lo + 20_000]
            n, shape = part.shape[1], (len(part), logp.shape[1])
            a = {0: np.ones(shape)}
            scale = np.zeros(shape)
            for i, arcs in _arcs(v, part):
                now = a.pop(i)
                if i % 8 == 7:
                    # keep the sums that are still open near one
                    top = np.maximum.reduce([now, *a.values()])
                    now = now / top
                    for q in a:
                        a[q] /= top
                    scale += np.log(top)
                for k, rows, ids in arcs:
                    if i + k not in a:
                        a[i + k] = np.zeros(shape)
                    a[i + k][rows] += now[rows] * p[ids]
            out[np.array(at[lo : lo + 20_000])] = np.log(a[n]) + scale
    return out


def estimate(v: Vocabulary, counts: Counter, rounds: int = 3, smooth: float = 0.01) -> np.ndarray:
    """Log piece probabilities of one language from its word counts."""
    p = np.full(v.size, 1.0 / v.size)
    parts: Counter = Counter()
    for w, n in counts.items():
        for i in range(0, len(w), CUT):
            parts[w[i : i + CUT]] += n
    words = list(parts)
    groups = [(m, list(_arcs(v, m)), np.array([parts[words[i]] for i in at], float)) for at, m in _groups(words)]
    for _ in range(rounds):
        got = np.zeros(v.size)
        for m, lattice, weight in groups:
            n = m.shape[1]
            wide = np.longdouble if n > 40 else float  # its exponents reach beyond any word of CUT characters
            q = p.astype(wide)
            a, b = np.zeros((n + 1, len(m)), wide), np.zeros((n + 1, len(m)), wide)
            a[0] = b[n] = 1
            for i, arcs in lattice:
                for k, rows, ids in arcs:
                    a[i + k, rows] += a[i, rows] * q[ids]
            for i, arcs in reversed(lattice):
                for k, rows, ids in arcs:
                    b[i, rows] += q[ids] * b[i + k, rows]
            share = weight / a[n]
            for i, arcs in lattice:
                for k, rows, ids in arcs:
                    got += np.bincount(ids, (a[i, rows] * q[ids] * b[i + k, rows] * share[rows]).astype(float), v.size)
        p = got + smooth
        p /= p.sum()
    return np.log(p)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    logp: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def _words(text: str | None) -> list[str]:
    s = ts.Slice(0, 1, np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
    w = ts.words(s, ts.ALNUM)
    raw = s.buf.tobytes().lower()
    return [raw[a:b].decode() for a, b in zip(w.starts.tolist(), w.ends.tolist())]


def train(texts: list[str | None], langs: list[str], vocabulary: str | None = None, **kw) -> Model:
    names = sorted(set(langs))
    m = sp_model.load(vocabulary or sp_model.default_path())
    pieces = [p for p, t in zip(m.pieces, m.types) if t == sp_model.NORMAL]
    v = Vocabulary(pieces)
    cols = []
    for name in names:
        counts: Counter = Counter()
        for t, g in zip(texts, langs):
            if g == name:
                counts.update(_words(t))
        cols.append(estimate(v, counts, **kw) if counts else np.full(v.size, -np.log(v.size)))
    return Model(names, pieces, np.stack(cols, 1) if cols else np.zeros((v.size, 0)))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, max_rows: int = 2000, max_bytes: int = 4 << 20, **kw) -> Model:
    """Train on documents with a language, the first in an order by hash of doc_id, none of them held out: at most max_rows, and max_bytes of text."""
    ids = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    rows = sorted(labelled(docs, ids.groupBy("doc_id").agg(F.min("lang").alias("label")), max_rows, max_bytes))
    return train([r["text"] for r in rows], [r["label"] for r in rows], **kw)


class _Sums:
    """Log sums of words by hash, in sorted order; forgets all when full."""

    def __init__(self, model: Model, cap: int = 1_000_000) -> None:
        self.v, self.logp, self.cap = Vocabulary(model.pieces), model.logp, cap
        self.hashes, self.sums = np.zeros(0, np.uint64), np.zeros((0, model.logp.shape[1]), np.float32)

    def of(self, h: np.ndarray, text_of) -> np.ndarray:
        """h: distinct, ascending. text_of: the words at some of its indexes."""
        at = np.searchsorted(self.hashes, h)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == h[known]
        new = np.flatnonzero(~known)
        if len(new):
            got = forward(self.v, self.logp, text_of(new)).astype(np.float32)
            if len(self.hashes) + len(new) > self.cap:
                self.hashes, self.sums = self.hashes[:0], self.sums[:0]
                out = np.zeros((len(h), self.sums.shape[1]), np.float32)
                rest = np.flatnonzero(known)
                if len(rest):
                    out[rest] = forward(self.v, self.logp, text_of(rest)).astype(np.float32)
                out[new] = got
                self.hashes, self.sums = h, out
                return out
            where = np.searchsorted(self.hashes, h[new])
            self.sums = np.insert(self.sums, where, got, 0)
            self.hashes = np.insert(self.hashes, where, h[new])
            at = np.searchsorted(self.hashes, h)
        return self.sums[at]


_LETTERS = ts.byte_set(bytes(range(65, 91)) + bytes(range(97, 123)))


def _tell_batches(batches: Iterator[pa.RecordBatch], model, key: str) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    sums: _Sums = tenant("language_id", key, lambda: _Sums(m))
    for b in batches:
        for s in ts.slices(b.column(1), 1 << 20):
            w = ts.words(s, ts.ALNUM)
            n = s.hi - s.lo
            letters = ts.row_counts(_LETTERS[s.buf], s.offs) > 0
            for i in np.flatnonzero(~letters & (np.diff(w.first) > 0)):
                letters[i] = any(c.isalpha() for c in s.buf[s.offs[i] : s.offs[i + 1]].tobytes().decode())
            total = np.zeros((n, len(m.languages)))
            if len(w.starts) and m.languages:
                h, one, back = np.unique(ts.hashes(s.buf, w.starts, w.ends, fold=True), return_index=True, return_inverse=True)

                def text_of(at: np.ndarray) -> list[str]:
                    return [s.buf[w.starts[k] : w.ends[k]].tobytes().lower().decode() for k in one[at].tolist()]

                each = sums.of(h, text_of)[back].astype(float)
                c = np.vstack([np.zeros((1, each.shape[1])), np.cumsum(each, 0)])
                total = c[w.first[1:]] - c[w.first[:-1]]
            told = letters & bool(m.languages)
            best = total.argmax(1) if m.languages else np.zeros(n, int)
            score = np.zeros(n)
            if m.languages:
                score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            names = [m.languages[k] if t else UND for k, t in zip(best, told)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(s.lo, n), pa.array(names), pa.array(np.where(told, score, 0.0))], ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the posterior of it) of every row of docs, from its text alone."""
    spark = docs.sparkSession
    ship(spark)
    key = hashlib.sha256(model.logp.tobytes() + repr(model.languages).encode()).hexdigest()
    fn = partial(_tell_batches, model=spark.sparkContext.broadcast(model), key=key)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(fn, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
