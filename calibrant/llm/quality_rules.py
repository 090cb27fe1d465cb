"""Quality rules: a learned decision list over text statistics (sequential covering).

Statistics are taken from every whole text; rules are ordered conjunctions of thresholds,
each grown by information gain on one part of a bounded labelled sample and pruned on the
other, and are applied as one ordered Spark conditional expression.

Defined results: a null or empty text has all statistics 0 and fails the base rule; repeated
rows are scored alike; a null doc_id is kept in the output; without labels the list is empty
and only the base rule decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm import textscan as ts
from calibrant.llm.worker import enter
from calibrant.session import ship

#: Symbols that count as such (fixed values).
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_digits", "n_lines", "n_bytes")

_SYM, _UPPER, _MARK, _DIGIT = ts.byte_set(SYMBOLS), ts.byte_set(range(65, 91)), ts.byte_set(b"!?"), ts.byte_set(range(48, 58))


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags by position: equal to an earlier key; one of two or more equal keys."""
    later, many = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        later[order[1:][same]] = True
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
    return later, many


def slice_stats(s: ts.Slice) -> dict[str, np.ndarray]:
    w = ts.words(s, ts.SPACED)
    n_words = np.diff(w.first)
    row = w.rows()
    lead = (s.buf & 0xC0) != 0x80
    in_word = ts.SPACED[s.buf]
    salt = ts.mix(np.arange(1, len(n_words) + 1, dtype=np.uint64))
    ln = ts.lines(s)
    wc = np.zeros(len(s.buf) + 1, np.int64)
    np.cumsum(in_word, out=wc[1:])
    full = wc[ln.ends] > wc[ln.starts]
    lrow = ln.rows()[full]
    later, _ = _repeats(ts.mix(ts.hashes(s.buf, ln.starts, ln.ends)[full] ^ salt[lrow]))
    h = ts.hashes(s.buf, w.starts, w.ends)
    h3 = ts.windows(h, 3)
    hit = np.zeros(len(h) + 1, np.int64)
    if len(h3):
        at = np.flatnonzero(row[: len(h3)] == row[2:])
        _, many = _repeats(ts.mix(h3[at] ^ salt[row[at]]))
        np.add.at(hit, at[many], 1)
        np.add.at(hit, np.minimum(at[many] + 3, len(h)), -1)
    covered = np.cumsum(hit[:-1]) > 0
    rows = len(n_words)
    return {
        "n_words": n_words,
        "word_chars": ts.row_counts(in_word & lead, s.offs),
        "n_symbols": ts.row_counts(_SYM[s.buf], s.offs),
        "n_dup_lines": np.bincount(lrow[later], minlength=rows),
        "n_repeat_words": np.bincount(row[covered], minlength=rows),
        "n_upper": ts.row_counts(_UPPER[s.buf], s.offs),
        "n_marks": ts.row_counts(_MARK[s.buf], s.offs),
        "n_digits": ts.row_counts(_DIGIT[s.buf], s.offs),
        "n_lines": np.bincount(ln.rows()[full], minlength=rows),
        "n_bytes": np.diff(s.offs),
    }


def _stats_batches(batches: Iterator[pa.RecordBatch], text: int | None) -> Iterator[pa.RecordBatch]:
    enter("quality_rules")
    for b in batches:
        row = b.column(0)
        for s in ts.slices(b.column(1) if text is None else row.flatten()[text]):
            got = slice_stats(s)
            yield pa.RecordBatch.from_arrays([row.slice(s.lo, s.hi - s.lo), *(pa.array(got[c].astype(np.int64)) for c in COUNTS)], ["row", *COUNTS])


def text_stats(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Counts for every row of docs; `row` holds the row's columns (or those in keep) as a struct."""
    ship(docs.sparkSession)
    names = docs.columns if keep is None else keep
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(text_col).cast("string").alias("text"))
    at = names.index(text_col) if text_col in names and dict(docs.dtypes)[text_col] == "string" else None
    if at is not None:
        row = row.select("row")
    schema = f"row {row.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS)
    return row.mapInArrow(partial(_stats_batches, text=at), schema)


#: Ratios that rules may test, from the counts alone.
RATIOS: dict[str, tuple[str, str]] = {
    "symbol_ratio": ("n_symbols", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "upper_ratio": ("n_upper", "n_bytes"),
    "mark_ratio": ("n_marks", "n_words"),
    "digit_ratio": ("n_digits", "n_bytes"),
    "word_length": ("word_chars", "n_words"),
    "line_length": ("n_words", "n_lines"),
    "size": ("n_words", ""),
}


def _ratio(name: str) -> Column:
    a, b = RATIOS[name]
    return F.col(a).cast("double") / (F.greatest(F.col(b), F.lit(1)).cast("double") if b else F.lit(1.0))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '>=' or '<=', threshold); rows that satisfy it are rejected."""

    terms: tuple[tuple[str, str, float], ...]

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, op, t in self.terms:
            out &= x[f] >= t if op == ">=" else x[f] <= t
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, t in self.terms:
            out = out & (_ratio(f) >= F.lit(float(t)) if op == ">=" else _ratio(f) <= F.lit(float(t)))
        return out


def _grow(x: dict[str, np.ndarray], y: np.ndarray, steps: int, max_terms: int) -> Rule:
    terms: list[tuple[str, str, float]] = []
    on = np.ones(len(y), bool)
    while len(terms) < max_terms and (y[on] == 0).any():
        p0, n0 = int(y[on].sum()), int((y[on] == 0).sum())
        best, base = (1e-9, None), np.log2(p0 / (p0 + n0)) if p0 else -99.0
        for f, v in x.items():
            cuts = np.unique(np.quantile(v[on], np.linspace(0, 1, steps + 1)))
            mids = (cuts[1:] + cuts[:-1]) / 2
            for op in (">=", "<="):
                for t in mids:
                    m = on & (v >= t if op == ">=" else v <= t)
                    p = int(y[m].sum())
                    if p and (gain := p * (np.log2(p / m.sum()) - base)) > best[0]:
                        best = (gain, (f, op, float(t)))
        if best[1] is None:
            break
        terms.append(best[1])
        on = on & Rule((best[1],)).mask(x)
    return Rule(tuple(terms))


def _prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        m = r.mask(x)
        p, n = int(y[m].sum()), int((y[m] == 0).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    while len(best.terms) > 1 and worth(shorter := Rule(best.terms[:-1])) >= worth(best):
        best = shorter
    return best


def fit_rules(x: dict[str, np.ndarray], bad: np.ndarray, *, max_rules: int = 12, max_terms: int = 3, steps: int = 64, min_precision: float = 0.9, min_cover: int = 5, seed: int = 7) -> list[Rule]:
    """Sequential covering: ordered rules that find bad rows at no less than min_precision.

    Two thirds of the rows grow a rule, one third prunes it; a rule is kept if it covers
    min_cover bad rows of all that remain at that precision, and covered rows then go.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    part = np.random.Generator(np.random.PCG64(seed)).random(len(bad)) < 2 / 3
    while len(rules) < max_rules and bad[left].sum() >= min_cover:
        at = left & part
        rule = _prune(_grow({k: v[at] for k, v in x.items()}, bad[at], steps, max_terms), {k: v[left & ~part] for k, v in x.items()}, bad[left & ~part])
        if not rule.terms:
            break
        m = rule.mask(x) & left
        hits = int(bad[m].sum())
        if hits < min_cover or hits / m.sum() < min_precision:
            break
        rules.append(rule)
        left &= ~m
    return rules


def learn(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", max_rows: int = 20_000, **kw) -> list[Rule]:
    """Fit on the documents of at most max_rows labels, the first in an order by hash of doc_id."""
    lab = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).alias("label"))
    some = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # max_rows bounds the broadcast
    pdf = text_stats(texts, keep=["label"]).select(*(_ratio(r).alias(r) for r in RATIOS), F.col("row.label").alias("label")).toPandas()
    if not len(pdf):
        return []
    return fit_rules({r: pdf[r].to_numpy(float) for r in RATIOS}, (pdf["label"].to_numpy() == 0).astype(int), **kw)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def verdict(rules: list[Rule]) -> Column:
    """Index of the first rule that holds (the row is rejected), or -1."""
    out = None
    for i, r in enumerate(rules):
        out = F.when(r.column(), F.lit(i)) if out is None else out.when(r.column(), F.lit(i))
    return F.lit(-1) if out is None else out.otherwise(F.lit(-1))


def score(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, **kw) -> DataFrame:
    """Counts, base_failed, rule (that rejects, or -1) and kept for every row of docs, beside `row`."""
    rules = learn(docs, labels, **kw)
    out = text_stats(docs, keep=keep).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") < 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, labels, keep=["doc_id"]).select("row.doc_id", *COUNTS[:5], "base_failed", "kept", "rule")


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the base rule or the list rejects go."""
    return score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select("row.*")
