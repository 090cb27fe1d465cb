"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is read by sp_model; its normaliser, word mark, pieces (unigram
scores, or the merges that BPE scores imply) and byte fallback are rebuilt as a tokenizer of
that library, which encodes batches on several threads and decodes them. No piece has a word
mark after another character, so text may be cut before each run of marks and each part encoded
and decoded alone; parts met before are kept in a cache bounded in bytes, which changes no
result. New parts are encoded and decoded some at a time, joined by spaces, and told apart by
the marks their first pieces begin with.

The sentencepiece library only verifies: whatever enters the cache was encoded and decoded by
it too. Parts on which ids or text differ never enter the cache, keep what the rebuilt
tokenizer says, and are counted in `differing`. (With unigram models that library adds up in
single precision; where a text cannot be cut it may break near ties otherwise after thousands
of words.)

Defined results: null text counts as empty and has no ids; repeated rows are treated alike; a
null doc_id is kept; other columns are not read. A text that holds the word mark itself decodes
to a space there, as in the original; round_trip tells.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibrant.llm import sp_model
from calibrant.llm.worker import tenant
from calibrant.session import ship

MARK = "▁"
_SCHEMA = "doc_id long, text string, ids array<int>, decoded string, differing long"


def build(m: sp_model.Model):
    """A tokenizer of the tokenizers library that encodes as the model does."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.kind == sp_model.BPE:
        vocab = {p: i for i, p in enumerate(m.pieces)}
        can = {p for p, t in zip(m.pieces, m.types) if t in (sp_model.NORMAL, sp_model.USER_DEFINED)}
        order = sorted((i for i, t in enumerate(m.types) if t == sp_model.NORMAL and len(m.pieces[i]) > 1), key=lambda i: (-m.scores[i], i))
        merges = [(p[:k], p[k:]) for p in (m.pieces[i] for i in order) for k in range(1, len(p)) if p[:k] in can and p[k:] in can]
        model = models.BPE(vocab, merges, unk_token=m.pieces[m.unk_id], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        model = models.Unigram(list(zip(m.pieces, m.scores)), m.unk_id, m.byte_fallback)
    tok = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.add_dummy_prefix else [])])
    if m.kind != sp_model.BPE:
        # control and byte pieces are in the vocabulary, but text that spells one is no such piece: it is cut after its first character
        named = [p for p, t in zip(m.pieces, m.types) if t not in (sp_model.NORMAL, sp_model.USER_DEFINED) and len(p) > 1]
        starts = {p[:2] for p in named}
        if named and not any(x in p for p, t in zip(m.pieces, m.types) if t == sp_model.NORMAL for x in starts):
            tok.pre_tokenizer = pre_tokenizers.Split(Regex("|".join(f"{re.escape(p[0])}(?={re.escape(p[1:])})" for p in named)), "merged_with_previous")
    own = [p for p, t in zip(m.pieces, m.types) if t == sp_model.USER_DEFINED]
    if own:
        tok.add_tokens([AddedToken(p, normalized=True) for p in own])
    return tok


class Codec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str, threads: int = 2, cache_bytes: int = 96 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        self.m = sp_model.load(path)
        self.tok, self.sp, self.threads = build(self.m), sentencepiece.SentencePieceProcessor(model_file=path), threads
        self.half = cache_bytes // 2
        #: ids by part, all verified: of late, and before that.
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0
        #: Of the batch at hand: ids of parts that are not kept, text of those that decode to another, parts that differ.
        self.once: dict[str, bytes] = {}
        self.back: dict[str, str] = {}
        self.odd: set[str] = set()
        #: Text may be cut before each run of spaces.
        self.cuts = not self.m.charsmap and not self.m.remove_extra_whitespaces and self.m.add_dummy_prefix and MARK in self.m.pieces and not any(MARK in p.lstrip(MARK) for p in self.m.pieces)
        self.begins = np.array([p.startswith(MARK) for p in self.m.pieces])
        self.lone = array("i", [self.m.pieces.index(MARK)]).tobytes() if self.cuts else b""

    def parts(self, text: str) -> list[str]:
        """Parts of a text, without the space before each; joined by spaces they are the text."""
        if not text:
            return []
        if not self.cuts or MARK in text:
            return [text]
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [p[1:] for p in re.findall(r" +[^ ]*", " " + text)]
        return text.split(" ")

    def _keep(self, part: str, ids: bytes) -> None:
        self.cache[part] = ids
        self.size += 4 * len(part) + len(ids) + 200  # with what the objects take besides

    def _each(self, parts: list[str]) -> None:
        """Encode, decode and verify parts one by one; only short ones without a difference are kept."""
        got = [e.ids for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]
        want = self.sp.encode(parts, num_threads=self.threads)
        for p, a, b, x, y in zip(parts, got, want, self.texts(got), self.sp.decode(want, num_threads=self.threads)):
            ids = array("i", a).tobytes()
            if a != b or x != y:
                self.odd.add(p)
            if x != p:
                self.back[p] = x
            if p in self.odd or p in self.back or len(p) > 64:
                self.once[p] = ids
            else:
                self._keep(p, ids)

    def _some(self, parts: list[str], together: int = 64) -> None:
        """The same for parts without spaces, some at a time."""
        groups = [parts[i : i + together] for i in range(0, len(parts), together)]
        joined = [" ".join(g) for g in groups]
        got = [e.ids for e in self.tok.encode_batch_fast(joined, add_special_tokens=False)]
        want = self.sp.encode(joined, num_threads=self.threads)
        one, other = self.texts(got), self.sp.decode(want, num_threads=self.threads)
        for g, t, a, b, x, y in zip(groups, joined, got, want, one, other):
            ids = np.array(a, "<i4")
            at = np.flatnonzero(self.begins[ids])
            if a != b or x != t or y != t or len(at) != len(g) or at[0]:
                self._each(g)
                continue
            raw, at = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            self.cache.update(zip(g, [raw[i:j] for i, j in zip(at, at[1:])]))
            self.size += 4 * len(t) + len(raw) + 200 * len(g)

    def learn(self, parts: set[str]) -> None:
        """Encode parts that are not in the cache."""
        joint, alone = [], []
        for p in parts:
            if (ids := self.older.get(p)) is not None:
                self._keep(p, ids)
            elif not p and self.cuts:
                self._keep(p, self.lone)  # a run of one space before nothing
            else:
                (joint if self.cuts and len(p) <= 64 and " " not in p and MARK not in p else alone).append(p)
        if joint:
            self._some(joint)
        if alone:
            self._each(alone)

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[str], list[int]]:
        """ids of each text as little-endian 32-bit integers, the text they decode to, and how many of its parts differed."""
        out, back, odd = [], [], []
        lo = 0
        while lo < len(texts):
            hi, n = lo, 0
            while hi < len(texts) and (hi == lo or n < 1 << 18):
                n += len(texts[hi])
                hi += 1
            self.once, self.back, self.odd = {}, {}, set()
            if self.size > self.half:
                self.older, self.cache, self.size = self.cache, {}, 0
            split = [self.parts(t) for t in texts[lo:hi]]
            flat = list(chain.from_iterable(split))
            got = list(map(self.cache.get, flat))
            if None in got:
                new = [i for i, x in enumerate(got) if x is None]
                self.learn({flat[i] for i in new})
                for i in new:
                    p = flat[i]
                    got[i] = self.cache[p] if p in self.cache else self.once[p]
            i = 0
            for t, ps in zip(texts[lo:hi], split):
                out.append(b"".join(got[i : i + len(ps)]))
                i += len(ps)
                # each part decodes to itself or is in back
                back.append(" ".join([self.back.get(p, p) for p in ps]) if self.back else t)
                odd.append(sum(p in self.odd for p in ps) if self.odd else 0)
            lo = hi
        return out, back, odd

    def texts(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)

    def decode(self, ids: bytes) -> str:
        return self.texts([array("i", ids).tolist()])[0]


def codec(path: str, threads: int = 2) -> Codec:
    return tenant("sentencepiece", f"{threads} {path}", lambda: Codec(path, threads))


def _coded(batches: Iterator[pa.RecordBatch], path: str, threads: int, size: int = 1 << 20) -> Iterator[tuple]:
    """Slices of batches of (doc_id, text), of about `size` bytes: doc_ids, texts, ids, decoded texts, differing parts."""
    c = codec(path, threads)
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
            texts = [t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()]
            yield b.slice(lo, hi - lo), texts, *c.encode(texts)
            lo = hi


def _lists(ids: list[bytes]) -> pa.Array:
    offs = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _same(texts: list[str], back: list[str]) -> pa.Array:
    return pa.array([x == y for x, y in zip(texts, back)], pa.bool_())


def _codec_batches(batches: Iterator[pa.RecordBatch], path: str, threads: int) -> Iterator[pa.RecordBatch]:
    for b, _, ids, back, odd in _coded(batches, path, threads):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(ids), pa.array(back, pa.string()), pa.array(odd, pa.int64())], ["doc_id", "text", "ids", "decoded", "differing"])


def _pairs(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str | None = None, threads: int = 2) -> DataFrame:
    """doc_id, text, ids, decoded text, and the number of parts on which the libraries differ."""
    return _pairs(docs).mapInArrow(partial(_codec_batches, path=path or sp_model.default_path(), threads=threads), _SCHEMA)


def _digest_batches(batches: Iterator[pa.RecordBatch], path: str, threads: int) -> Iterator[pa.RecordBatch]:
    for b, texts, ids, back, odd in _coded(batches, path, threads):
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(list(map(zlib.crc32, ids)), pa.int64()), pa.array(list(map(len, back)), pa.int64()), _same(texts, back), pa.array(odd, pa.int64())],
            ["doc_id", "n_ids", "ids_crc32", "n_decoded", "round_trip", "differing"],
        )


def digests(docs: DataFrame, path: str | None = None, threads: int = 2) -> DataFrame:
    """Per row: doc_id, n_ids, ids_crc32, n_decoded (code points), round_trip, differing."""
    return _pairs(docs).mapInArrow(partial(_digest_batches, path=path or sp_model.default_path(), threads=threads), "doc_id long, n_ids long, ids_crc32 long, n_decoded long, round_trip boolean, differing long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _stage_batches(batches: Iterator[pa.RecordBatch], path: str, threads: int) -> Iterator[pa.RecordBatch]:
    for b, texts, ids, back, odd in _coded(batches, path, threads):
        yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids), _same(texts, back), pa.array(odd, pa.int64())], ["doc_id", "ids", "round_trip", "differing"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, threads: int = 2) -> DataFrame:
    """Last pipeline stage: doc_id, ids and their number; the decoded text was compared where it was made, and differing parts are reported."""
    out = _pairs(docs).mapInArrow(partial(_stage_batches, path=sp_model.default_path(), threads=threads), "doc_id long, ids array<int>, round_trip boolean, differing long")
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "round_trip", "differing")
