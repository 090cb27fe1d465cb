"""Bounded labelled samples for classifiers that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def labelled(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int) -> list[Row]:
    """(text, label) of documents in labels(doc_id, label), at most max_rows and max_bytes of text.

    They are the first in an order by hash of doc_id; the bytes are bounded before any text is
    collected. A document larger than what is left of the bytes is passed over. Null texts are
    left out; the rows come in no particular order.
    """
    some = labels.where(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(some), "doc_id")  # max_rows bounds the broadcast
    sizes = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    keep, left = [], max_bytes
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if r["n"] <= left:
            keep.append((r["doc_id"],))
            left -= r["n"]
    if not keep:
        return []
    ids = docs.sparkSession.createDataFrame(keep, "doc_id long")
    return rows.join(F.broadcast(ids), "doc_id").select("text", "label").collect()
