"""Token-ID files: ORC with run-length encoded ids, row indexes and Bloom filters on doc_id.

Documents are dealt by ranges of doc_id and sorted, then encoded where they lie and written;
so files, stripes and row groups hold disjoint doc_id ranges, and a read by id prunes files
and stripes by their statistics and row groups by their Bloom filters. Stripes are read in
parallel. Encoding uses the tokenizers library; words that recur keep their ids in a bounded
cache, which is exact for a tokenizer that drops white space before it splits.

Defined results: null text counts as empty (the end id alone); rows that repeat a doc_id are
separate documents, ordered by text; null doc_ids come first; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibrant.llm.worker import enter, tenant
from calibrant.session import shared_dir, ship, table

SCHEMA = "doc_id long, ids array<int>"
#: Characters of the longest word that is kept with its ids; with the number of words it bounds the cache's bytes.
_LONGEST = 48
_SPACES = re.compile("[ \t\n\r\x0b\x0c]+")
#: Below this code point there are no combining marks, and lower-casing goes letter by letter.
_LATIN = 0x250
_PLAIN = re.compile("[\t\n\r\x0b\x0c -~\xa1-\u012f\u0131-\u024f]*")


def _latin(kind: str) -> str:
    """The Latin characters of a Unicode category, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in range(_LATIN) if unicodedata.category(chr(c))[0] == kind)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies, by byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Pieces(dict):
    """ids (as bytes) of pre-split pieces, by the library's model; forgets all when full, and keeps no long ones."""

    def __init__(self, tok, cap: int) -> None:
        super().__init__()
        self.model, self.cap, self.letters = tok.model, cap, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        got = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(piece) <= _LONGEST:
            if len(self) >= self.cap:
                self.clear()
            self[piece] = got
        return got


class _Words(dict):
    """ids (as bytes) of lower-case Latin words between white space; forgets all when full, and keeps no long ones."""

    def __init__(self, tok, cap: int) -> None:
        super().__init__()
        self.tok, self.cap = tok, cap
        spec = json.loads(tok.to_str())
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        #: Then white space is dropped and each word is encoded alone, so that its pieces may be split and looked up here.
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre] == ["Split", "ByteLevel"] and pre[0]["invert"] and pre[0]["behavior"] == "Removed"
        if self.by_word:
            pattern = pre[0]["pattern"]["Regex"].replace(r"\p{L}", _latin("L")).replace(r"\p{N}", _latin("N"))
            self.split, self.pieces = re.compile(pattern).findall, _Pieces(tok, cap)
            self.special = [x["content"] for x in spec["added_tokens"]]

    def __missing__(self, word: str) -> bytes:
        got = b"".join(map(self.pieces.__getitem__, self.split(word)))
        if len(word) <= _LONGEST:
            if len(self) >= self.cap:
                self.clear()
            self[word] = got
        return got

    def whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, text: str) -> bool:
        return bool(_PLAIN.fullmatch(text)) and not any(x in text for x in self.special)

    def text(self, text: str) -> bytes:
        if not self.by_word:
            return self.whole(text)
        if self.plain(text):
            return b"".join(map(self.__getitem__, text.lower().split()))
        return b"".join(self.text(w) if self.plain(w) else self.whole(w) for w in _SPACES.split(text) if w)


def encoder(path: str, cap: int = 500_000) -> Callable[[str], bytes]:
    """Text to ids (little-endian unsigned 32-bit), as the tokenizer file's library encodes it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return tenant("token_files", f"{cap} {path}", lambda: _Words(Tokenizer.from_file(path), cap)).text


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _encode_batches(tokenizer: str, end_id: int, size_of: int = 1 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()

        def batch(ids: list, parts: list[bytes]) -> pa.RecordBatch:
            offs = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) // 4 for p in parts], out=offs[1:])
            flat = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offs), flat)], ["doc_id", "ids"])

        for b in batches:
            ids, parts, size = [], [], 0
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(d)
                parts.append(encode(t.as_py() or "") + end)
                size += len(parts[-1])
                if size >= size_of:
                    yield batch(ids, parts)
                    ids, parts, size = [], [], 0
            if ids:
                yield batch(ids, parts)

    return run


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = 1, stripe_bytes: int = 32 << 20, index_stride: int = 1000, fpp: float = 0.01) -> None:
    """Encode docs(doc_id, text) and write them in ascending doc_id order."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    out = rows.mapInArrow(_encode_batches(tokenizer or default_tokenizer(), end_id), SCHEMA)
    (
        out.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(fpp))
        .option("orc.stripe.size", str(stripe_bytes)).option("orc.row.index.stride", str(index_stride)).option("orc.create.index", "true")
        .option("compression", "snappy").orc(path)
    )


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids); with a list of doc_ids, files, stripes and row groups without them are skipped."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if ids is None else df.where(F.col("doc_id").isin([int(i) for i in ids]))


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("token_files")
    at = 0
    for b in batches:
        col = b.column(1)
        offs, flat = np.asarray(col.offsets), np.ascontiguousarray(np.asarray(col.values), "<i4").tobytes()
        n = np.diff(offs)
        crc = [zlib.crc32(memoryview(flat)[4 * i : 4 * j]) for i, j in zip(offs[:-1].tolist(), offs[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64()), b.column(2), pa.array(np.arange(at, at + len(n)))], ["doc_id", "n_tokens", "ids_crc32", "file", "pos"])
        at += len(n)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    df = spark.read.schema(SCHEMA).orc(path).select("doc_id", "ids", F.col("_metadata.file_path").alias("file"))
    # the files are read once; what is counted from them is small
    rows = table(df.mapInArrow(_digest_batches, "doc_id long, n_tokens long, ids_crc32 long, file string, pos long"), "digests")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("low"))
    before = files.select("file", (F.sum("n").over(Window.orderBy(F.col("low").asc_nulls_first(), "file")) - F.col("n")).alias("before"))
    order = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "pos")
    within = F.sum("n_tokens").over(order) - F.col("n_tokens")
    return rows.withColumn("within", within).join(before, "file").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/calibrant/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return digests(spark, path)
