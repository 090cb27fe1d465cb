"""Toxicity by compression distance with two zstandard dictionaries.

Two dictionaries are trained by cover selection from a bounded labelled sample: byte strings of
training text are taken greedily by the weight of the runs of RUN bytes that they hold and no
earlier one held. The ordinary dictionary covers what is frequent in ordinary text. The toxic one
has the same strings at the same distances, and in front of them strings of toxic text, whose
runs weigh as much as they are likelier there (log-likelihood ratio against chance); where the
toxic dictionary has these, the ordinary one has zeros. Nothing is split into words in training,
and what is frequent in either kind of text costs the same under both dictionaries.

A text is cut into windows of a sentence's length. Each is compressed under both dictionaries
between two passages of the common part, as a compressor reaches neither the first nor the last
bytes of its input and stores a few bytes raw. The bytes that the toxic dictionary saves are the
window's distance. A distance counts for as much as it is likelier among toxic texts' windows
(log-likelihood ratio, one for each number of bytes), and the sum is taken per word of the text,
with `slack` words added. A window that has no string of MATCH bytes, the
least match, in common with the toxic strings has the same length under both and need not be
compressed; nothing else is left out.

The dictionaries are trained on the whole sample. What distances count for, the slack and the
rate from which a text is called toxic are calibrated on the distances that the sample's parts
have under dictionaries of the other parts. Texts count once in training, however many copies there are, and their order
does not matter.

Defined results: null or empty texts have no windows and score 0; repeated rows are scored
alike; ties between segments go to the bytes; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm import textscan as ts
from calibrant.llm.sample import labelled
from calibrant.llm.worker import tenant
from calibrant.session import ship

#: Bytes of a run in training, and of the least match of the compressor.
RUN, MATCH = 6, 5
#: Saved bytes above which all count the same.
MOST_SAVED = 8
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGE = 32
_BITS = 20


def _flat(s: ts.Slice) -> tuple[np.ndarray, np.ndarray, ts.Spans]:
    """Words of all rows, lowered, with one space before and after each; where each begins; their spans."""
    w = ts.words(s, ts.SPACED)
    size = w.ends - w.starts
    at = np.cumsum(size + 1) - size
    out = np.full(int(size.sum()) + len(size) + 1, 32, np.uint8)
    word = np.repeat(np.arange(len(size)), size)
    out[np.arange(len(word)) + word + 1] = _LOWER[s.buf[ts.SPACED[s.buf]]]
    return out, at, w


def _runs(flat: np.ndarray, size: int = RUN) -> np.ndarray:
    """The run that begins at each byte, as a number."""
    n = max(0, len(flat) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h |= flat[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    return h


def _normal(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return _flat(ts.Slice(0, 1, raw, np.array([0, len(raw)], np.int64)))[0]


class _Weights:
    """Weight by run; 0 for all others."""

    def __init__(self, runs: np.ndarray, weights: np.ndarray) -> None:
        order = np.argsort(runs)
        self.runs, self.weights = runs[order], weights[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[self._slot(self.runs)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of runs that weigh something, and their indexes here."""
        at = np.flatnonzero(self.seen[self._slot(h)])
        if not len(self.runs):
            return at[:0], at[:0]
        k = np.minimum(np.searchsorted(self.runs, h[at]), len(self.runs) - 1)
        ok = self.runs[k] == h[at]
        return at[ok], k[ok]


def cover(texts: list[np.ndarray], w: _Weights, size: int, segment: int, without: _Weights | None = None) -> list[bytes]:
    """Segments of texts, the most useful first: greedy by the weight of runs not yet covered.

    without: they begin anywhere and hold none of its runs; else they begin near runs that weigh something.
    """
    found: dict[bytes, np.ndarray] = {}
    for t in texts:
        at, k = w.hits(_runs(t))
        if not len(at):
            continue
        if without is None:
            starts, last = [], -segment
            for p in at.tolist():
                if p + RUN > last + segment:
                    starts.append(max(0, p - (segment - RUN) // 4))
                    last = starts[-1]
        else:
            starts = np.arange(0, max(1, len(t) - segment), segment // 2)
            bad = without.hits(_runs(t))[0]
            starts = starts[np.searchsorted(bad, starts + segment - RUN, "right") == np.searchsorted(bad, starts - RUN + 1)].tolist()
            if not starts:
                continue
        lo, hi = np.searchsorted(at, starts), np.searchsorted(at, np.asarray(starts) + segment - RUN, "right")
        for p, i, j in zip(starts, lo.tolist(), hi.tolist()):
            if j > i:
                found.setdefault(t[p : p + segment].tobytes(), np.unique(k[i:j]))
    left = w.weights.copy()
    heap = [(-float(left[ks].sum()), s) for s, ks in found.items()]
    heapq.heapify(heap)
    out, n = [], 0
    while heap and n < size:
        _, s = heapq.heappop(heap)
        now = float(left[found[s]].sum())
        if now <= 0:
            continue
        if heap and now < -heap[0][0] - 1e-9:
            heapq.heappush(heap, (-now, s))
            continue
        out.append(s)
        n += len(s)
        left[found[s]] = 0
    return out


def _counts(texts: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of texts, how often they occur (a text counts for `most` at most) and in how many texts."""
    got = [np.unique(_runs(t), return_counts=True) for t in texts]
    h = np.concatenate([g for g, _ in got]) if got else np.zeros(0, np.uint64)
    n = np.concatenate([np.minimum(c, most) for _, c in got]) if got else np.zeros(0, np.int64)
    runs, back, of = np.unique(h, return_inverse=True, return_counts=True)
    return runs, np.bincount(back, n, len(runs)), of


def _contrast(toxic: list[np.ndarray], other: list[np.ndarray], least: int, surprise: float, likelier: float, most: int) -> _Weights:
    """Weights of runs more than `likelier` times as frequent in toxic text as in other text."""
    runs, a, of = _counts(toxic, most)
    keep = of >= least
    runs, a = runs[keep], a[keep]
    b = np.zeros(len(runs))
    screen = _Weights(runs, a)
    for t in other:
        _, k = screen.hits(_runs(t))
        b += np.minimum(np.bincount(k, minlength=len(runs)), most)
    size = [max(1, sum(map(len, x))) for x in (toxic, other)]
    q = likelier * size[0] / (likelier * size[0] + size[1])
    p = a / np.maximum(a + b, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        w = a * np.log(p / q) + np.where(b > 0, b * np.log((1 - p) / (1 - q)), 0.0)
    ok = (p > q) & (w >= surprise)
    return _Weights(screen.runs[ok], w[ok])


def _unlike(texts: list[np.ndarray]) -> list[int]:
    """Indexes of texts, one of each group of near copies: copies are one witness, not many.

    A near copy has the same two smallest run hashes and about the same length.
    """
    first: dict[tuple, tuple] = {}
    for i, t in enumerate(texts):
        h = np.unique(ts.mix(_runs(t)))[:2].tolist()
        name = hashlib.blake2b(t.tobytes(), digest_size=8).digest()
        key = (*h, len(t) * 8 // max(1, 1 << len(t).bit_length()), len(t).bit_length()) if h else (name,)
        first[key] = min(first.get(key, (name, i)), (name, i))
    return sorted(i for _, i in first.values())


@dataclass
class Model:
    common: bytes
    toxic: bytes
    words: int = 6
    #: What a window counts for by the bytes that the toxic dictionary saves in it, from 1 on; the last is for all above.
    counts: tuple[float, ...] = (1.0,)
    #: Words added to a text's length.
    slack: int = 0
    #: Sum a thousand words from which a text is called toxic.
    rate: float = 1.0

    def compressors(self) -> tuple:
        """Under the ordinary and the toxic dictionary."""
        p = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, window_log=17, chain_log=17, hash_log=17, search_log=5, min_match=MATCH, target_length=64,
            strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0,
        )
        out = []
        for own in (bytes(len(self.toxic)), self.toxic):
            d = zstandard.ZstdCompressionDict(own + self.common, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress)
        return tuple(out)


class Scorer:
    """Windows of slices of text under both dictionaries of a model."""

    def __init__(self, model: Model) -> None:
        self.m, (self.a, self.b) = model, model.compressors()
        strings = np.unique(_runs(np.frombuffer(model.toxic, np.uint8), MATCH))
        self.shared = _Weights(strings, np.ones(len(strings)))
        n = len(model.common)
        self.before, self.after = model.common[n // 3 : n // 3 + _EDGE], model.common[n // 2 : n // 2 + _EDGE]

    def distance(self, window: bytes) -> int:
        """Bytes that the toxic dictionary saves in a window."""
        x = self.before + window + self.after
        return len(self.a(x)) - len(self.b(x))

    def windows(self, s: ts.Slice, every: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and bytes saved of each window that may differ (or of every one); number of words of each row."""
        flat, begin, w = _flat(s)
        n_words = np.diff(w.first)
        size, row = w.ends - w.starts, w.rows()
        per = -(-n_words // self.m.words)
        base = np.cumsum(per) - per
        window = base[row] + (np.arange(len(row)) - w.first[row]) // self.m.words
        head = np.searchsorted(window, np.arange(int(per.sum())))
        last = np.r_[head[1:], len(row)] - 1
        if not len(head):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
        lo, hi = begin[head] - 1, begin[last] + size[last] + 1
        some = np.arange(len(head))
        if not every:
            at, _ = self.shared.hits(_runs(flat, MATCH))
            some = some[np.searchsorted(at, hi - MATCH, "right") > np.searchsorted(at, lo)]
        saved = np.array([self.distance(flat[lo[k] : hi[k]].tobytes()) for k in some.tolist()], np.int64)
        return row[head[some]], saved, n_words

    def rates(self, s: ts.Slice) -> np.ndarray:
        """What a row's windows count for, a thousand words."""
        row, saved, n_words = self.windows(s)
        return _rates(row, saved, n_words, self.m.counts, self.m.slack)

    def scores(self, s: ts.Slice) -> np.ndarray:
        """0 to 1; 0.7 at the calibrated rate."""
        r = self.rates(s)
        return r / (r + self.m.rate * 3 / 7)


def _rates(row: np.ndarray, saved: np.ndarray, n_words: np.ndarray, counts: tuple[float, ...], slack: int) -> np.ndarray:
    worth = np.array((0.0, *counts))[np.clip(saved, 0, len(counts))]
    return 1000 * np.bincount(row, worth, len(n_words)) / np.maximum(1, n_words + slack)


def _counts_for(saved: np.ndarray, toxic: np.ndarray, windows: tuple[int, int]) -> tuple[float, ...]:
    """The log-likelihood ratio of each number of saved bytes up to MOST_SAVED, not below 0 and never falling; windows: of other and of toxic texts."""
    a, b = (np.bincount(np.clip(saved[toxic == y], 0, MOST_SAVED), minlength=MOST_SAVED + 1)[1:] for y in (True, False))
    ratio = np.log((a + 0.5) / (windows[1] + 1)) - np.log((b + 0.5) / (windows[0] + 1))
    return tuple(np.maximum.accumulate(np.maximum(ratio, 0.0)).tolist())


def _best(rates: np.ndarray, toxic: np.ndarray, recall: float = 1.0) -> tuple[float, float]:
    """The best F score of any cut between the rates, and the cut."""
    order = np.argsort(-rates, kind="stable")
    x, y = rates[order], np.cumsum(toxic[order])
    end = np.flatnonzero((x > 0) & (np.r_[x[1:], -1.0] != x))
    if not len(end):
        return 0.0, 1.0
    score = (1 + recall**2) * y[end] / (end + 1 + recall**2 * toxic.sum())
    k = int(np.argmax(score))
    below = x[end[k] + 1] if end[k] + 1 < len(x) else 0.0
    return float(score[k]), float((x[end[k]] + below) / 2)


def dictionaries(toxic: list[np.ndarray], other: list[np.ndarray], *, words: int, common_bytes: int, own_bytes: int, segment: int, least: int, surprise: float, likelier: float, most: int, cover_texts: int) -> Model:
    """A model without thresholds."""
    w = _contrast(toxic, other, least, surprise, likelier, most)
    own = b"".join(reversed(cover(toxic, w, own_bytes, segment)))
    some = sorted(other, key=lambda t: hashlib.blake2b(t.tobytes(), digest_size=8).digest())[:cover_texts]
    runs, n, of = _counts(some, most)
    held = of >= least
    common = b"".join(reversed(cover(some, _Weights(runs[held], n[held]), common_bytes, 32, w)))
    return Model(common.rjust(4 * _EDGE, b" "), own, words)


def train(texts: list[str | None], toxic: list[bool], *, words: int = 6, common_bytes: int = 1 << 15, own_bytes: int = 1 << 13, segment: int = 10, least: int = 4, surprise: float = 10.0, likelier: float = 6.0, most: int = 4, cover_texts: int = 600, folds: int = 5, recall: float = 1.25) -> Model | None:
    """Dictionaries and thresholds from labelled texts; None without texts of both kinds.

    common_bytes, own_bytes: bounds of the dictionaries' parts; segment: bytes of a string of
    toxic text; least: texts that must hold a run; surprise: least weight; likelier: least ratio
    of frequencies; most: occurrences that count in a text; cover_texts: ordinary texts whose
    strings may enter the common part; folds: parts of the sample, each measured under
    dictionaries of the others to calibrate the thresholds; recall: how many times as much as
    precision it counts in choosing the rate.
    """
    if not any(toxic) or all(toxic):
        return None
    flat = [_normal(t) for t in texts]
    one = _unlike(flat)
    part = {i: hashlib.blake2b(flat[i].tobytes(), digest_size=8, person=b"part").digest()[0] % folds for i in one}

    def of(ids: list[int]) -> Model:
        bad, good = [flat[i] for i in ids if toxic[i]], [flat[i] for i in ids if not toxic[i]]
        return dictionaries(bad, good, words=words, common_bytes=common_bytes, own_bytes=own_bytes, segment=segment, least=least, surprise=surprise, likelier=likelier, most=most, cover_texts=cover_texts)

    rows, savings, n_words, order = [], [], [], []
    for k in range(folds):
        ids = [i for i in one if part[i] == k]
        scorer = Scorer(of([i for i in one if part[i] != k] or ids))
        for s in ts.slices(pa.array([texts[i] or "" for i in ids], pa.large_string())):
            row, saved, n = scorer.windows(s)
            rows.append(row + len(order))
            savings.append(saved)
            n_words.append(n)
            order += ids[s.lo : s.hi]
    model, y = of(one), np.array([toxic[i] for i in order], bool)
    row, saved, n = np.concatenate(rows), np.concatenate(savings), np.concatenate(n_words)
    per = -(-n // words)
    model.counts = _counts_for(saved, y[row], (int(per[~y].sum()), int(per[y].sum())))
    best = -1.0
    for slack in (0, 25, 50, 100, 200, 400):
        f, cut = _best(_rates(row, saved, n, model.counts, slack), y, recall)
        if f > best + 1e-12:
            best, model.slack, model.rate = f, slack, cut
    return model


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", max_rows: int = 5000, max_bytes: int = 8 << 20, **kw) -> Model | None:
    """Train on labelled documents, the first in an order by hash of doc_id, none of them held out: at most max_rows, and max_bytes of text."""
    lab = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label_col).alias("label"))
    rows = labelled(docs, lab, max_rows, max_bytes)
    return train([r["text"] for r in rows], [r["label"] == 1 for r in rows], **kw)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _score_batches(batches: Iterator[pa.RecordBatch], model, key: str) -> Iterator[pa.RecordBatch]:
    m: Model | None = model.value
    scorer = tenant("toxicity", key, lambda: Scorer(m)) if m else None
    for b in batches:
        for s in ts.slices(b.column(1)):
            got = scorer.scores(s) if scorer else np.zeros(s.hi - s.lo)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(s.lo, s.hi - s.lo), pa.array(got, pa.float64())], ["doc_id", "score"])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score of every row of docs, from its text alone."""
    spark = docs.sparkSession
    ship(spark)
    key = hashlib.sha256(repr((model.common, model.toxic, model.words, model.counts, model.slack, model.rate)).encode()).hexdigest() if model else ""
    fn = partial(_score_batches, model=spark.sparkContext.broadcast(model), key=key)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(fn, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
