"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from calibrant.llm import chat_format, decontaminate, graph, html_text, language_id, near_dedup, quality_rules, sentencepiece_codec, sp_model, substring_dedup, token_files, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(5)
VOCAB = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 9))) for _ in range(4000)]


def prose(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append(r.choice(VOCAB) + ("." if r.random() < 0.1 else ""))
    return " ".join(out)


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


ODD = [None, "", " \n\t ", "one", "two words", "é 中文 ß İ Σ", "a" * 30_000, prose(6000, 1), "x\x00y\x1cz", "line\nline\n\nline", prose(80, 2), prose(80, 2)]


def test_quality_statistics(spark):
    df = docs_of(spark, ODD).withColumn("n_words", F.lit("clash")).withColumn("row", F.lit(1))
    got = {r["row"]["doc_id"]: r for r in quality_rules.text_stats(df).collect()}
    for i, t in enumerate(ODD):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        wins = {}
        for k in range(len(ws) - 2):
            wins.setdefault(tuple(ws[k : k + 3]), []).append(k)
        rep = {p for v in wins.values() if len(v) > 1 for k in v for p in (k, k + 1, k + 2)}
        seen, dup = set(), 0
        for ln in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", ln):
                dup += ln in seen
                seen.add(ln)
        want = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep))
        assert tuple(got[i][c] for c in quality_rules.COUNTS[:5]) == want, i
        assert got[i]["row"]["n_words"] == "clash"


def test_quality_rules_learn_and_keep(spark):
    good, junk = [prose(100, k) for k in range(60)], [re.sub(" ", "%%% ", prose(100, k)) for k in range(100, 140)]
    docs = docs_of(spark, good + junk)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(100)] + [(None, 0), (3, None)], "doc_id long, quality int")
    out = {r["row"]["doc_id"]: r["kept"] for r in quality_rules.score(docs, labels).collect()}
    assert all(out[i] for i in range(60)) and not any(out[i] for i in range(60, 100))
    none = quality_rules.score(docs, labels.limit(0)).where("kept").count()
    assert none == 100
    assert quality_rules.score(docs.limit(0), labels).count() == 0


def brute_near(texts, width, percent=80):
    sets = {i: near_dedup.shingles(t, width) for i, t in texts.items()}
    comp = {i: i for i in texts}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(base, n, share, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        ws = base.split()
        for k in range(len(ws)):
            if r.random() < share:
                ws[k] = r.choice(VOCAB)
        out.append(" ".join(ws))
    return out


def test_near_dedup_matches_brute_force(spark):
    texts = [*ODD, *variants(prose(60, 9), 60, 0.06, 1), *variants(prose(200, 10), 20, 0.03, 2), *[prose(40, k) for k in range(30, 60)], "Two WORDS", "two\twords"]
    want = brute_near(dict(enumerate(texts)), 2)
    # small buckets and blocks, so that every way is taken
    got = near_dedup.components_of(docs_of(spark, texts).withColumn("component_id", F.lit("x")), small=6, block=16).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_dedup_edges(spark):
    rows = docs_of(spark, ["a b c d", "a b c d", "a b c d", "q", None], [7, 7, None, 3, 4])
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.components_of(rows).collect()), key=str)
    assert got == [(3, 3, True), (4, 4, True), (7, 7, True), (7, 7, True), (None, None, True)]
    assert near_dedup.components_of(rows.limit(0)).count() == 0
    docs = docs_of(spark, [prose(100, 1), prose(100, 1), prose(100, 3)])
    assert {r["doc_id"] for r in near_dedup.stage(spark, docs, "").collect()} == {0, 2}


def test_registers_merge_and_estimate():
    a, b = (near_dedup.ts.mix(np.arange(k, k + 1000, dtype=np.uint64)) for k in (1, 201))
    ra, rb, both = near_dedup.registers(a), near_dedup.registers(b), near_dedup.registers(np.union1d(a, b))
    assert (near_dedup.merge(ra, rb) == both).all()
    got = near_dedup.estimate(ra[None], rb[None], np.array([1000.0]), np.array([1000.0]))[0]
    assert abs(got - 800 / 1200) < 0.2


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["id"]: r["comp"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 90, 90: 90, 95: 90}


def test_substring_dedup(spark):
    p = prose(60, 77)
    texts = [*ODD[:10], f"{prose(30, 1)} {p} {prose(30, 2)}", f"{prose(25, 3)}\n{p}\n{prose(10, 4)}", p, f"{prose(40, 5)} {' '.join(p.split()[:40])}", prose(100, 6), None]
    df = docs_of(spark, texts).withColumn("spans", F.lit("clash"))
    got = {r["row"]["doc_id"]: r["text"] for r in substring_dedup.dedup(df).collect()}
    for i in range(10):
        assert got[i] == texts[i] or i in (6, 7), i
    assert got[10] == texts[10] and p not in got[11] and got[12] == "" and got[13] == texts[13] and got[14] == texts[14]
    assert got[11].split() == (prose(25, 3) + " " + prose(10, 4)).split()
    assert substring_dedup.dedup(df.limit(0)).count() == 0
    kept = {r["doc_id"]: r for r in substring_dedup.stage(spark, docs_of(spark, texts), "").collect()}
    assert 12 not in kept and kept[11]["n_chars"] == len(kept[11]["text"])


def test_substring_dedup_of_null_and_repeated_ids(spark):
    """They come after all others, in order of id and text, and are cut and used as sources like them."""
    p, q, tail = prose(60, 77), prose(60, 78), prose(20, 9)
    same = docs_of(spark, [p, p, p], [1, 1, 2])
    assert sorted((r["row"]["doc_id"], r["text"]) for r in substring_dedup.dedup(same).collect()) == [(1, ""), (1, ""), (2, p)]
    odd = docs_of(spark, [q, f"{tail} {q}", q, None, None, f"{p} {tail}"], [5, 5, None, None, 8, 9])
    got = sorted(((r["row"]["doc_id"], r["text"]) for r in substring_dedup.dedup(odd).collect()), key=str)
    assert [x for x in got if x[0] in (8, 9)] == [(8, None), (9, f"{p} {tail}")]
    kept = [x[1].strip() for x in got if x[0] == 5]
    assert sorted(kept) in (sorted(["", f"{tail} {q}"]), sorted([q, tail])) and [x[1] for x in got if x[0] is None] in (["", None], [None, ""])
    alone = docs_of(spark, [q] * 4, [None] * 4)
    assert sorted(r["text"] for r in substring_dedup.dedup(alone).collect()) == ["", "", "", q]


def test_substring_dedup_grows_with_the_text(spark):
    """Texts of lines drawn from a few, a log: rows and windows in proportion to the text, and the result of brute force."""
    r = random.Random(4)
    lines = [prose(60, 600 + k) for k in range(12)]
    texts = ["\n".join(r.choice(lines) for _ in range(n)) for n in (3, 40, 80)] + ["\n".join(lines[:3])]
    got = {x["row"]["doc_id"]: x["text"].split() for x in substring_dedup.dedup(docs_of(spark, texts)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        ws, gone = re.findall(r"\S+\s*", t), set()
        for k in range(len(ws) - 49):
            w = "".join(ws[k : k + 50]).rstrip()
            if w in seen:
                gone.update(range(k, k + 50))
            seen.add(w)
        assert got[i] == [w.strip() for k, w in enumerate(ws) if k not in gone], i
    sizes = []
    for n in (100, 200, 400):
        text = "\n".join(r.choice(lines) for _ in range(n))
        own = next(substring_dedup._chunk_batches([_batch([7], [text])], 50))
        chunks = own.column(1)[0].as_py()
        first = {}
        at = [{"place": k, "source": 7, "first": first.setdefault(c, k)} for k, c in enumerate(chunks)]
        runs = next(substring_dedup._run_batches([pa.RecordBatch.from_arrays([*(own.column(k) for k in (0, 2, 3, 4, 5)), pa.array([at])], list("abcdef"))], 50))
        left = runs.column(2)[0].as_py()
        rows = sum(b.num_rows for b in substring_dedup._window_batches([pa.RecordBatch.from_arrays([pa.array([7]), pa.array([text]), pa.array([left], pa.list_(pa.int32()))], list("abc"))], 50))
        sizes.append((len(text), rows + len(runs.column(1)[0])))
    assert sizes[2][1] <= 4.2 * sizes[0][1] and all(rows * 25 < size for size, rows in sizes)


def _batch(keys, texts):
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts)], ["key", "text"])


def test_substring_dedup_finds_any_earlier_copy(spark):
    """Every 50 words that 50 words of an earlier text equal are cut, though an earlier text still holds them but for one word."""
    texts, spans = [], []
    for k in range(120):
        p = prose(50 + k % 49, 3000 + k).split()
        edited = [*p[: len(p) // 2], "changed", *p[len(p) // 2 + 1 :]]
        for j, x in enumerate((edited, p, p)):
            texts.append(" ".join([*prose(20, 9000 + 3 * k + j).split(), *x, *prose(20, 7000 + 3 * k + j).split()]))
            spans.append((20, 20 + len(p)) if j == 2 else None)
    texts += ["again " * 3000, "again " * 200, " ".join([prose(7, 1)] * 30)]
    got = {r["row"]["doc_id"]: r["text"].split() for r in substring_dedup.dedup(docs_of(spark, texts)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        ws = t.split()
        gone = set()
        for k in range(len(ws) - 49):
            w = " ".join(ws[k : k + 50])
            if w in seen:
                gone.update(range(k, k + 50))
            seen.add(w)
        assert got[i] == [w for k, w in enumerate(ws) if k not in gone], i
        assert i >= len(spans) or spans[i] is None or gone >= set(range(*spans[i])), i


def test_chunks_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = [prose(300, k) for k in range(20)] + ["", "a"]
    whole = [s for s in substring_dedup.ts.slices(pa.array(texts))][0]
    c = substring_dedup.chunks(whole)
    for i, t in enumerate(texts):
        got = (c.starts[c.first[i] : c.first[i + 1]] - whole.offs[i]).tolist()
        assert got == substring_dedup._starts(t.encode())


def brute_hits(text, items):
    words = lambda t: decontaminate.item_words(t)
    w, hit, found = words(text), set(), set()
    for name, t in items:
        q = words(t)
        k = min(10, len(q))
        for i in range(len(q) - k + 1 if k else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == q[i : i + k]:
                    hit |= set(range(j, j + k))
                    found.add(name)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination(spark, block_bytes):
    base = [prose(25, k) for k in range(6)]
    items = [("1", base[0]), ("2", base[1]), ("30", "Only Three words"), ("4", None), (None, base[2]), ("5", ""), ("6", base[0]), ("7", " ".join(base[1].split()[3:9] * 3))]
    texts = [*ODD[:6], f"{prose(9, 8)} {base[0].upper()} tail", " ".join(base[1].split()[4:16]), " ".join(base[1].split()[4:13]), "zz only, three-words zz", base[2], " ".join(base[1].split()[3:9] * 5)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = {r["row"]["doc_id"]: r for r in decontaminate.mark(docs_of(spark, texts).withColumn("items", F.lit(1)), bench, block_bytes=block_bytes).select("*", decontaminate.n_hit().alias("h")).collect()}
    for i, t in enumerate(texts):
        assert (got[i]["n_words"], got[i]["h"], got[i]["items"]) == brute_hits(t, [x for x in items if x[0]]), i
    cut = {r["doc_id"]: r for r in decontaminate.remove(docs_of(spark, texts), bench).collect()}
    assert cut[0]["text"] is None and cut[3]["text"] == texts[3] and base[0].upper() not in (cut.get(6) or {"text": ""})["text"]
    assert decontaminate.mark(docs_of(spark, texts), bench.limit(0)).where("size(items) > 0").count() == 0


def test_chat_round_trip(spark):
    r = random.Random(1)
    bits = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "\\e", "\\\\", "s", " ", "é", "w "]
    rows = [(c, k, r.choice(["user", "assistant"]) if k else r.choice(["system", "user"]), "".join(r.choice(bits) for _ in range(r.choice([0, 3, 50, 400])))) for c in range(10) for k in range(r.choice([1, 3, 40, 600]))]
    rows += [(90, 0, None, None), (90, 0, "user", "tie"), (None, 1, "assistant", "no id"), (91, None, "user", "no turn")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("span", F.lit(1))
    got = {x["conv_id"]: x for x in chat_format.digests(chat_format.format_windows(df, budget=300, history=80)).collect()}
    convs = {}
    for c, k, role, text in rows:
        convs.setdefault(c, []).append((-1 if k is None else k, role or "", text or ""))
    assert set(got) == set(convs)
    for c, ts_ in convs.items():
        ts_.sort()
        told, loss = "".join(f"{a}\n{b}\n" for _, a, b in ts_), "".join(b for _, a, b in ts_ if a == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(ts_), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    assert chat_format.digests(chat_format.format_windows(df.limit(0))).count() == 0


def test_language_forward_and_accuracy(spark):
    alpha = {"aa": "abcdef", "bb": "ghijkl"}
    text = lambda g, k: " ".join("".join(random.Random(k * 99 + j).choice(alpha[g] + "xyz") for _ in range(5)) for j in range(30))
    texts, langs = zip(*[(text(g, k), g) for g in alpha for k in range(60)])
    m = language_id.train(list(texts), list(langs))
    v = language_id.Vocabulary(m.pieces)
    number = {p: i for i, p in enumerate(dict.fromkeys(p.lower() for p in m.pieces))}
    for w in ("the", "erçà", "中a", "x" * 25, "internationalization"):
        x, a = "▁" + w, [np.ones(2)]
        for j in range(1, len(x) + 1):
            s = np.zeros(2)
            for k in range(1, j + 1):  # every piece of the vocabulary
                i = number.get(x[j - k : j], v.size - 1 if k == 1 else -1)
                s = s + (a[j - k] * np.exp(m.logp[i]) if i >= 0 else 0)
            a.append(s)
        assert np.allclose(np.log(a[-1]), language_id.forward(v, m.logp, [w])[0])
    assert np.isfinite(language_id.forward(v, m.logp, ["ab" * 2000])).all()
    got = {r["doc_id"]: r for r in language_id.identify(docs_of(spark, [text("aa", 900), text("bb", 901), None, "12 ..", "", "é"]), m).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["aa", "bb", "und", "und", "und"] and got[5]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = language_id.identify(docs_of(spark, ["abc"]), language_id.train([], []))
    assert [r["lang_pred"] for r in none.collect()] == ["und"]


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [*ODD, "it's <|endoftext|> NOT 1234!!", "ΑΣ σ", "a\xa0b　c"]
    path = str(tmp_path / "t")
    token_files.write_tokens(docs_of(spark, texts).withColumn("ids", F.lit(1)).repartition(4), path)
    tok, at = Tokenizer.from_file(token_files.default_tokenizer()), 0
    got = {r["doc_id"]: r for r in token_files.digests(spark, path).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        at += len(ids)
    assert [r["doc_id"] for r in token_files.read_tokens(spark, path, [3, 999]).collect()] == [3]
    empty = str(tmp_path / "e")
    token_files.write_tokens(docs_of(spark, texts).limit(0), empty)
    assert token_files.digests(spark, empty).count() == 0


def _message(*fields):
    """A protobuf message of (number, value): bytes, int or float."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for number, v in fields:
        if isinstance(v, bytes):
            out += varint(number << 3 | 2) + varint(len(v)) + v
        elif isinstance(v, float):
            out += varint(number << 3 | 5) + struct.pack("<f", v)
        else:
            out += varint(number << 3) + varint(v)
    return out


def unigram_model(path, extra_spaces):
    """A small unigram model with a normaliser's table and byte fallback, written field by field."""
    import sentencepiece

    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    normalizer = next(v for n, v in sp_model._fields(rules) if n == 3)
    charsmap = next(v for n, v in sp_model._fields(normalizer) if n == 2)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", 0.0, 6) for i in range(256))]
    words = sorted({w[:k] for w in VOCAB[:300] for k in range(1, len(w) + 1)})
    r = random.Random(3)
    pieces += [(m + w, -8.0 + 0.7 * len(w) - r.random(), 1) for w in words for m in ("", "▁")] + [("▁", -4.0, 1)]
    body = _message(*((1, _message((1, p.encode()), (2, float(x)), (3, t))) for p, x, t in pieces))
    body += _message((2, _message((3, 1), (35, 1), (40, 0), (41, 1), (42, 2), (43, 2**64 - 1))), (3, _message((1, b"nmt_nfkc"), (2, charsmap), (3, 1), (4, int(extra_spaces)), (5, 1))))
    path.write_bytes(body)
    return str(path)


@pytest.mark.parametrize("kind", ["bpe", "unigram", "unigram with extra spaces"])
def test_sentencepiece(spark, tmp_path, kind):
    import sentencepiece

    path = sp_model.default_path() if kind == "bpe" else unigram_model(tmp_path / "m.model", kind == "unigram")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*ODD, "  a  b ", " ", "a\n b\t\tc  ", "▁x ▁", "<s> </s> <0x0A>", "😀 x", "ﬁ ① ｆｕｌｌ", " ".join(VOCAB[:200])]
    if kind != "bpe":
        texts[7] = prose(300, 1)  # over thousands of words the other library's single-precision sums break near ties otherwise
    c = sentencepiece_codec.Codec(path, cache_bytes=2000)
    for _ in range(2):  # from the cache too
        ids, back, odd = c.encode([t or "" for t in texts])
        for t, x, y in zip(texts, ids, back):
            assert np.frombuffer(x, "<i4").tolist() == sp.encode(t or ""), t
            assert y == c.decode(x) == sp.decode(sp.encode(t or "")), t
        assert not sum(odd)
    rows = docs_of(spark, [*texts, "again", "again", "no id"], [*range(len(texts)), 90, 90, None]).withColumn("ids", F.lit(1))
    got = sentencepiece_codec.digests(rows, path).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(texts) + 3 and None in by and len({tuple(r) for r in got if r["doc_id"] == 90}) == 1
    for i, t in enumerate(texts):
        want = sp.encode(t or "")
        assert (by[i]["n_ids"], by[i]["ids_crc32"]) == (len(want), zlib.crc32(np.array(want, "<i4").tobytes())), t
        assert by[i]["round_trip"] == (sp.decode(want) == (t or "")) and not by[i]["differing"], t
    assert sentencepiece_codec.encode(rows.limit(0), path).count() == 0


def test_sentencepiece_library_only_verifies(monkeypatch):
    """Ids and text are those of the rebuilt tokenizer; a wrong rebuild shows in both, and in what the stage reports."""
    real = sentencepiece_codec.Codec(sp_model.default_path())
    want = real.tok.encode("zebra", add_special_tokens=False).ids
    c = sentencepiece_codec.Codec(sp_model.default_path())

    class Wrong:
        def encode_batch_fast(self, parts, **kw):
            return real.tok.encode_batch_fast(["zebra" for _ in parts], **kw)

        def decode_batch(self, ids, **kw):
            return [x + "!" for x in real.tok.decode_batch(ids, **kw)]

    c.tok = Wrong()
    ids, back, odd = c.encode(["hello"])
    assert np.frombuffer(ids[0], "<i4").tolist() == want and odd == [1] and back == ["zebra!"] and c.decode(ids[0]) == "zebra!"
    monkeypatch.setattr(sentencepiece_codec, "codec", lambda *a: c)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array(["hello hello"])], ["doc_id", "text"])
    out = next(sentencepiece_codec._stage_batches(iter([batch]), "", 1)).to_pydict()
    assert out["ids"] == [want + want] and out["differing"] == [2] and out["round_trip"] == [False]


def test_html():
    page = """<html><head><title>t</title><script>var a="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>
    <div id="sidebar">side <a href=x>l</a></div><div class="content"><h2>Title&nbsp;here</h2><p>Para one is long &amp; has enough text to
    count, <b>bold</b> too.<p>Para two with <a href="#">link</a> and<br>break<ul><li>item one<li>item two</ul><div class="comments"><p>reader says hi</div></div>
    <form><p>subscribe</form><div class="cookie-notice">cookies</div><footer>foot</footer><!-- x"""
    assert html_text.main_text(page) == "Title here\nPara one is long & has enough text to count, bold too.\nPara two with link and break\nitem one\nitem two"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("plain") == "plain" and html_text.main_text("<div>" * 3000 + "deep") == "deep"
    assert len(html_text.main_text("<article>" + "<p>word word</p>" * 5000 + "</article>").split("\n")) == 5000


def random_tree(r, depth=0):
    """(tag, attributes, kids); a kid is a tree or text. Paragraphs hold text, links and marks only."""
    words = lambda: " ".join(r.choice(VOCAB) for _ in range(r.choice([0, 1, 3, 30])))
    tag = r.choice(["div", "section", "p", "p", "article", "main", "nav", "blockquote"]) if depth else "body"
    if tag == "p":
        return tag, "", [words(), ("a", ' href="x"', [words()]) if r.random() < 0.3 else ("b", "", [words()]), words()]
    kids = [random_tree(r, depth + 1) if r.random() < 0.8 else words() for _ in range(r.randint(1, 4))] if depth < 5 else [words()]
    return tag, ' class="sidebar"' if tag == "div" and r.random() < 0.2 else "", kids


def test_html_density_sums_match_brute_force():
    """Densities, sums and the chosen subtree against sums over all descendants, each from scratch."""
    import math

    inline = ("a", "b")

    def write(t):
        return t if isinstance(t, str) else f"<{t[0]}{t[1]}>" + "".join(map(write, t[2])) + f"</{t[0]}>"

    def chars(t):
        return len("".join(t.split())) if isinstance(t, str) else sum(map(chars, t[2]))

    def every(t, path=()):
        if not isinstance(t, str):
            yield t, path
            for k in t[2]:
                yield from every(k, (*path, t))

    def own(t):  # text and links of a block itself
        for k in t[2]:
            if isinstance(k, str):
                yield k
            elif k[0] in inline:
                yield k

    def den(c, tags, lc, lt, share):
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        return c / max(1, tags) * max(0.0, math.log(c / max(1, lc) * max(1, tags) / max(1, lt)) / math.log(max(base, 2.0)))

    def dens(t, share):
        below = [x for x, _ in every(t) if x is not t]
        links = [x for x in below if x[0] == "a"]
        return den(chars(t), sum(x[0] != "b" for x in below), sum(map(chars, links)), len(links), share)

    def plain(t):
        return chars(t) if isinstance(t, str) else 0 if t[0] in ("nav", "a") else sum(map(plain, t[2]))

    def stays(tree):
        """Ids of the sidebars that are not left out."""
        everything = list(every(tree))
        articles = [(t, path) for t, path in everything if t[0] in ("article", "main") and plain(t) and all(x[0] != "nav" for x in path)]
        clean = [x for x in articles if not any("sidebar" in y[1] for y in x[1])] or [x for x in articles if plain(x[0]) >= 0.25 * plain(tree)]
        main, around = max(clean, key=lambda x: plain(x[0]), default=(None, ()))
        half = lambda t, path: 2 * plain(t) >= plain(tree) and (main is None or any(x is main for x in path))
        return {id(t) for t, path in everything if "sidebar" in t[1] and (any(t is x for x in around) or half(t, path))}

    out = lambda t, path: any(x[0] == "nav" or ("sidebar" in x[1] and id(x) not in kept) for x in (t, *path))

    def total(t, share):
        mine = list(own(t))
        links = [k for k in mine if not isinstance(k, str) and k[0] == "a"]
        return sum(dens(k, share) for k in t[2] if not isinstance(k, str) and k[0] not in inline and not out(k, ())) + den(sum(map(chars, mine)), len(links), sum(map(chars, links)), len(links), share)

    for seed in range(150):
        tree = random_tree(random.Random(seed))
        kept = stays(tree)
        root = html_text.parse("<html>" + write(tree) + "</html>")
        html_text.measure(root)
        share = sum(chars(x) for x, _ in every(tree) if x[0] == "a") / max(1, chars(tree))
        blocks = [(t, path) for t, path in every(tree) if t[0] not in inline]
        nodes = [n for n in html_text._order(root) if n.block and n is not root]
        assert [n.tag for n in nodes] == [t[0] for t, _ in blocks]
        for n, (t, path) in zip(nodes, blocks):
            assert math.isclose(n.density, dens(t, share), abs_tol=1e-9), seed
            assert out(t, path) or math.isclose(n.total, total(t, share), abs_tol=1e-9), seed
        best = max((b for b in blocks if not out(*b)), key=lambda b: round(total(b[0], share), 6))
        if not total(best[0], share):
            continue
        body, (top, path) = dens(tree, share), best
        mean = math.sqrt(body * dens(top, share))
        while top[0] not in ("article", "main", "body"):
            up = path[-1]
            if up[0] == "body" or dens(up, share) < (body if up[0] in ("article", "main") else mean):
                break
            top, path = up, path[:-1]
        got = html_text.chosen(root)
        at = next(i for i, (t, _) in enumerate(blocks) if t is top)
        assert got is nodes[at], seed


SENTENCES = [f"{prose(11, 800 + k)}." for k in range(24)]
ARTICLE, WHOLE = "".join(f"<p>{x}</p>" for x in SENTENCES), "\n".join(SENTENCES)
FILLER = '<nav><a href=a>one</a> <a href=b>two</a></nav><div class="{}"><p>Short words beside the article.</p></div><footer>end of page</footer>'


@pytest.mark.parametrize("name", ["elementor-widget elementor-widget-theme-post-content", "widget Blog", "popular-science", "content share-enabled", "col left-side", "post comments-enabled", "page-header-on", "ad-free reader"])
def test_html_named_wrappers_of_the_article_stay(name):
    """A word of a wrapper's class does not take the article with it; the same class beside the article goes."""
    for page in (
        f'<body>{FILLER.format("sidebar")}<div class="{name}">{ARTICLE}</div></body>',
        f'<body><div class="{name}"><article>{ARTICLE}</article>{FILLER.format("sidebar")}</div></body>',
        f'<body><div id="page" class="{name}"><div class="post"><h1>Title</h1>{ARTICLE}</div></div>{FILLER.format("widget")}</body>',
        f'<body><form id="aspnetForm"><input name=q><div class="{name}">{ARTICLE}</div><button>Go</button></form></body>',
        f'<body><article><div class="{name}">{ARTICLE}</div></article></body>',
    ):
        assert html_text.main_text(page).removeprefix("Title\n") == WHOLE, page[:200]
    beside = f'<body><article>{ARTICLE}</article><div class="{name}"><p>Short words beside the article.</p></div></body>'
    assert html_text.main_text(beside) == WHOLE
    inside = f'<body><article>{ARTICLE}<div class="{name}"><p>Short words in the article.</p></div></article></body>'
    assert html_text.main_text(inside) == WHOLE


def test_html_comments_cards_and_forms_go():
    """However long they are: reader comments, cards of other articles, forms; and a small article beside a long notice stays."""
    comment = "".join(f'<article class="comment"><p>{prose(40, 60 + k)}</p></article>' for k in range(30))
    short = "".join(f"<p>{x}</p>" for x in SENTENCES[:6])
    assert html_text.main_text(f'<body><article>{short}</article><section id="comments">{comment}</section></body>') == "\n".join(SENTENCES[:6])
    assert html_text.main_text(f'<body><article>{short}<div class="comment-list">{comment}</div></article></body>') == "\n".join(SENTENCES[:6])
    cards = "".join(f"<article><h3><a href=x>{prose(5, k)}</a></h3><p>{prose(12, 70 + k)}</p></article>" for k in range(4))
    assert html_text.main_text(f'<body><main><div class="body">{ARTICLE}</div><div class="related-posts">{cards}</div></main></body>') == WHOLE
    assert html_text.main_text(f'<body><div class="body">{ARTICLE}</div><div class="related-posts">{cards}</div></body>') == WHOLE
    form = f'<form class="signup"><p>{prose(30, 5)}</p><label>Mail</label></form>'
    assert html_text.main_text(f"<body><article>{ARTICLE}{form}</article>{form}</body>") == WHOLE
    notice = f'<div class="cookie-notice"><p>{prose(90, 6)}</p></div>'
    assert html_text.main_text(f"<body>{notice}<article><h1>Title</h1><p>Few words.</p></article></body>") == "Title\nFew words."
    assert html_text.main_text(f'<body><div hidden>{ARTICLE}</div><div class="text"><p>{SENTENCES[0]}</p></div></body>') == SENTENCES[0]


def test_html_odd_pages():
    """Letters whose lower case is longer, ties, and deep nesting in time that grows with the page."""
    import time

    assert html_text.main_text("İ" * 40 + "<script>x</SCRIPT><p>next paragraph</p>").endswith("next paragraph")
    same = "<div><p>same words here in both of these</p></div>"
    assert html_text.main_text(f"<body><div class=x>{same}</div><div class=y>{same}</div>").count("same") == 2  # equal parts: the body's sum is both
    assert html_text.main_text("<p>a</p><p>b") == "a\nb"

    def took(page):
        best = 9e9
        for _ in range(3):
            t = time.process_time()
            html_text.main_text(page)
            best = min(best, time.process_time() - t)
        return best

    for piece in ("<center>", "<div><b>", "</center>", "<i></b>", "<div><li>x", "<b><p>x</p></b>", "<table><tr><td>", "<a href='x"):
        assert took(piece * 8000) < 16 * max(took(piece * 2000), 0.004), piece


def test_html_rows(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a b</p>", 5), (1, "u", "<p>a b</p>", 5), (None, None, None, 6)], "page_id long, url string, html string, text int")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_text.extract(rows).collect()), key=str)
    assert got == [(1, "u", "a b", 3), (1, "u", "a b", 3), (None, None, "", 0)]
    assert html_text.extract(rows.limit(0)).count() == 0


def toxic_rows(n, seed, marks=("grumbly", "snortface", "wartlump")):
    texts, toxic = [], []
    for k in range(n):
        ws = prose(60, seed + k).split()
        if k % 5 == 0:
            for j in range(3):
                ws[7 + 11 * j] = marks[(k + j) % 3]
        texts.append(" ".join(ws))
        toxic.append(k % 5 == 0)
    return texts, toxic


def tell(model, texts):
    import pyarrow as pa

    s = toxicity.Scorer(model)
    return np.concatenate([s.scores(x) for x in toxicity.ts.slices(pa.array(texts))]) >= 0.7


def test_toxicity(spark):
    texts, toxic = toxic_rows(300, 1000)
    m = toxicity.train(texts[:200], toxic[:200])
    rows = docs_of(spark, [*texts[200:], None, "", " \n"], [*range(102), None]).withColumn("score", F.lit(1))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(rows, m).collect()}
    right = sum((got[i] >= 0.7) == y for i, y in enumerate(toxic[200:]))
    assert right >= 98 and all(0 <= s <= 1 for s in got.values()) and got[100] == got[101] == got[None] == 0
    assert toxicity.score(rows.limit(0), m).count() == 0
    same = toxicity.score(docs_of(spark, [texts[0], texts[0]], [5, 5]), m).collect()
    assert same[0] == same[1] and same[0]["score"] >= 0.7
    assert toxicity.train(["a"], [False]) is None
    assert [r["score"] for r in toxicity.score(docs_of(spark, ["a"]), None).collect()] == [0.0]


def test_toxicity_needs_no_order_of_labels_and_counts_copies_once():
    texts, toxic = toxic_rows(200, 4000)
    rows, models = list(zip(texts, toxic)), []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        models.append(toxicity.train([t for t, _ in rows], [y for _, y in rows]))
    copies = [(t, y) for t, y in rows for _ in range(1 + 30 * (t == texts[0]))]
    models.append(toxicity.train([t for t, _ in copies], [y for _, y in copies]))
    assert len({(m.common, m.toxic) for m in models}) == 1
    assert len({(m.counts, m.slack, m.rate) for m in models[:3]}) == 1


def syllables(n, seed, mark):
    """Texts of words of few syllables; toxic ones hold some of the marks, all hold the syllables of these."""
    r = random.Random(seed)
    parts = ["ba", "ke", "li", "mo", "nu", "ra", "se", "ti", "vo", "wi", "grum", "bly", "snort", "wart"]
    texts, toxic = [], []
    for k in range(n):
        ws = ["".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(120)]
        if k % 4 == 0:
            for j in range(5):
                ws[5 + 20 * j] = r.choice(mark)
        texts.append(" ".join(ws))
        toxic.append(k % 4 == 0)
    return texts, np.array(toxic)


def test_toxicity_is_told_by_compressed_lengths(spark):
    """Only windows that cannot differ are left out; the same windows without their lengths tell clearly less."""
    texts, toxic = syllables(400, 7, ["grumzysnort", "wartqubly", "snortzowart"])
    m = toxicity.train(texts[:250], toxic[:250].tolist())
    s = toxicity.Scorer(m)
    whole = [x for x in toxicity.ts.slices(pa.array([*texts[:60], "", "one", "a\n\n grumzysnort\tB  C d E", "x " * 500 + "wartqubly"]), 3000)]
    seen = 0
    for x in whole:
        (row, saved, n), (rows, saves, _) = s.windows(x), s.windows(x, every=True)
        kept = [(i, d) for i, d in zip(rows.tolist(), saves.tolist()) if d]
        assert kept == [(i, d) for i, d in zip(row.tolist(), saved.tolist()) if d] and len(rows) == (-(-n // m.words)).sum()
        seen += len(kept)
    assert seen > 10

    def right(counts):
        got = [(row, np.maximum(saved, 0) if counts else np.ones(len(saved), np.int64), n) for row, saved, n in (s.windows(next(toxicity.ts.slices(pa.array([t])))) for t in texts)]
        rates = np.array([toxicity._rates(row, saved, n, m.counts if counts else (1.0,), m.slack)[0] for row, saved, n in got])
        _, cut = toxicity._best(rates[:250], toxic[:250])
        return ((rates[250:] >= cut) == toxic[250:]).mean()

    assert right(True) > 0.93 and right(False) < right(True) - 0.05, (right(True), right(False))


def test_toxicity_counts_marks_in_a_text():
    """Marks that as many other texts hold once are told by how often a toxic text has them."""
    texts, toxic = [], []
    for k in range(300):
        ws = prose(60, 5000 + k).split()
        for i in range(4 if k % 5 == 0 else k % 5 == 1):
            ws.insert(7 * i, "snortface")
        texts.append(" ".join(ws))
        toxic.append(k % 5 == 0)
    m = toxicity.train(texts[:200], toxic[:200], likelier=2.0)
    assert (tell(m, texts[200:]) == np.array(toxic[200:])).sum() >= 95


def test_toxicity_fit_leaves_out_held_out_rows(spark):
    texts, toxic = toxic_rows(240, 1000)
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(240)]
    labels = spark.createDataFrame([(i, int(y != h)) for i, (y, h) in enumerate(zip(toxic, held))] + [(None, 1), (3, None)], "doc_id long, toxic int")
    m = toxicity.fit(docs_of(spark, texts), labels)  # labels of held-out rows are wrong
    assert (tell(m, texts) == np.array(toxic)).mean() > 0.97
    assert toxicity.fit(docs_of(spark, texts), labels.limit(0)) is None
    few = toxicity.labelled(docs_of(spark, texts), labels.withColumnRenamed("toxic", "label"), 100, 5000)
    assert 0 < sum(len(r["text"].encode()) for r in few) <= 5000
