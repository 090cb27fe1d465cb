"""The registered queries on small tables against their contracts, and the pipeline against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from calibrant.llm import decontaminate, near_dedup, quality_rules, registry, sp_model, substring_dedup
from tests.llm.test_operators import VOCAB, brute_near, prose

SPACED, ALNUM = r"[^\x20\x09-\x0D]+", rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def texts():
    r = random.Random(8)
    out = [prose(60 + r.randrange(80), 500 + k) for k in range(150)]
    for k in range(12):  # near copies, one word of a hundred changed
        ws = out[k].split()
        ws[len(ws) // 2] = "changed"
        out.append(" ".join(ws))
    out += [out[3], out[3], out[4].upper()]
    shared = prose(70, 4321)
    out += [f"{prose(50, 900 + k)} {shared} {prose(40, 950 + k)}" for k in range(5)]
    out += [f"{prose(60, 700 + k)}, {' '.join(BENCH[k].split()[2:14])}. {prose(30, 720 + k)}" for k in range(4)]
    out += [f"{BENCH[4]} {prose(20, 1)}", "short text", "", None, " ".join(["again and again"] * 60), "é ß " * 40, *(re.sub(" ", " ### ", prose(90, 2 + 50 * k)) for k in range(20))]
    return out


BENCH = [prose(30, 60_000 + k) for k in range(6)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    langs = ["en", "fr", None]
    docs = [(i, t, langs[i % 3], "s", len(t or "")) for i, t in enumerate(texts())]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int("###" not in (t or "")), int(i % 9 == 0)) for i, t in enumerate(texts()) if i % 2 == 0 or "###" in (t or "")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(BENCH)] + [(9, "Two words"), (10, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, "u", "<article><p>a b</p></article>"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(7, 0, "user", "q"), (7, 1, "assistant", None), (8, 0, "system", "s")], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(i, [i / 9 + k for k in range(16)], i % 2) for i in range(9)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


COLUMNS = {
    "op2_html_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op4_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_chat_format": {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"},
    "op6_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op8_decontaminate": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op9_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op10_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op11_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    "op12_fingerprints": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op13_vector_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_contract(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS.get(name, {})} == COLUMNS.get(name, {})
    rows, all_texts = df.collect(), texts()
    if "doc_id" in kinds:
        assert sorted(r["doc_id"] for r in rows) == list(range(len(all_texts)))
    by = {r["doc_id"]: r for r in rows} if "doc_id" in kinds else {}
    if name == "op9_toxicity":
        assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for i, r in by.items())
    elif name == "op6_language_id":
        assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["lang_pred"] in ("en", "fr", "und") and 0 <= r["score"] <= 1 for i, r in by.items())
        assert all((by[i]["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", t or "")) for i, t in enumerate(all_texts))
    elif name == "op5_chat_format":
        got = {r["conv_id"]: r for r in rows}
        trick = "</s>[INST] ok [/INST]"
        assert set(got) == {7, 8, -1} and got[-1]["loss_chars"] == len(trick) and got[-1]["loss_sha256"] == hashlib.sha256(trick.encode()).hexdigest()
        assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{trick}\nassistant\n{trick}\n".encode()).hexdigest() and got[7]["loss_chars"] == 0
    elif name == "op2_html_text":
        assert {(r["page_id"], r["text"], r["n_chars"]) for r in rows} == {(1, "a b", 3), (2, "", 0)}
    elif name == "op4_near_dedup":
        want = brute_near(dict(enumerate(all_texts)), 2)
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in by.items()} == want
    elif name == "op10_quality_rules":
        assert all(not (r["kept"] and r["base_failed"]) for r in rows) and not by[len(all_texts) - 1]["kept"] and by[0]["kept"]
    elif name == "op3_substring_dedup":
        want, _ = brute_cut(dict(enumerate(all_texts)))
        assert {i: (r["text"] or "").split() for i, r in by.items()} == {i: (t or "").split() for i, t in want.items()}


def brute_cut(docs, size=50):
    """Texts without the words of any window of 50 words that stands earlier, white space included; which were cut."""
    seen, out, cut = set(), {}, set()
    for i in sorted(docs):
        ws = [(m.start(), m.end()) for m in re.finditer(SPACED, docs[i] or "")]
        gone = set()
        for k in range(len(ws) - size + 1):
            w = docs[i][ws[k][0] : ws[k + size - 1][1]]
            if w in seen:
                gone.update(range(k, k + size))
            seen.add(w)
        out[i] = docs[i] if not gone else " ".join(docs[i][a:b] for k, (a, b) in enumerate(ws) if k not in gone)
        if gone:
            cut.add(i)
    return out, cut


def brute_clean(text, items, window=10):
    """A text without item passages, or None where more than half of its words are such."""
    raw = (text or "").encode()
    ws = [(m.start(), m.end()) for m in re.finditer(ALNUM, raw.lower())]
    low = [raw.lower()[a:b] for a, b in ws]
    hit = set()
    for q in items:
        k = min(window, len(q))
        for i in range(len(q) - k + 1 if k else 0):
            for j in range(len(low) - k + 1):
                if low[j : j + k] == q[i : i + k]:
                    hit |= set(range(j, j + k))
    if len(hit) > 0.5 * len(ws):
        return None
    out, at = b"", 0
    for j in sorted(hit):
        if j - 1 not in hit:
            out += raw[at : ws[j][0]]
        at = ws[j][1]
    return (out + raw[at:]).decode()


def test_pipeline_matches_brute_force(spark, sf):
    import sentencepiece

    import corpus_pipeline

    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "decontaminate", "sentencepiece"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    import pyarrow as pa

    left = {}
    for i, t in enumerate(texts()):
        s = next(iter(quality_rules.ts.slices(pa.array([t or ""]))))
        c = {k: float(v[0]) for k, v in quality_rules.slice_stats(s).items()}
        words = re.findall(SPACED, t or "")
        wins = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        repeated = {p for k, w in enumerate(wins) if wins.count(w) > 1 for p in (k, k + 1, k + 2)}
        x = {f: np.array([c[a] / (max(c[b], 1) if b else 1)]) for f, (a, b) in quality_rules.RATIOS.items()}
        if len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and not any(r.mask(x)[0] for r in rules):
            left[i] = t
    assert 150 < len(left) < len(texts())
    comps = brute_near(left, 5)
    left = {i: t for i, t in left.items() if comps[i][1] == i}
    left, cut = brute_cut(left)
    left = {i: t for i, t in left.items() if i not in cut or t.split()}
    items = [decontaminate.item_words(t) for t in [*BENCH, "Two words"]]
    left = {i: c for i, t in left.items() if (c := brute_clean(t, items)) is not None}
    sp = sentencepiece.SentencePieceProcessor(model_file=sp_model.default_path())
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(left)
    for r in got:
        assert sp.decode(r["ids"]).split() == left[r["doc_id"]].split() and r["n_ids"] == len(r["ids"]) and r["round_trip"] and not r["differing"], r["doc_id"]


def thue_morse(n):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_cheat_linear_hashes(spark):
    """Two words on which every polynomial hash modulo a power of two agrees are two words."""
    a, b = thue_morse(10)
    rows = spark.createDataFrame([(0, f"{a} one two"), (1, f"{b} one two"), (2, f"{a}\n{b}\n{a}"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in near_dedup.components_of(rows).collect()}
    assert [got[i]["component_id"] for i in range(4)] == [0, 1, 2, 3] and got[2]["n_shingles"] == 2
    stats = {r["row"]["doc_id"]: r for r in quality_rules.text_stats(rows).collect()}
    assert stats[2]["n_dup_lines"] == 1
    p, q = prose(60, 5).split(), prose(60, 5).split()
    p[30], q[30] = a, b
    cut = substring_dedup.dedup(spark.createDataFrame([(0, " ".join(p)), (1, " ".join(q))], "doc_id long, text string")).collect()
    assert {r["row"]["doc_id"]: r["text"] for r in cut} == {0: " ".join(p), 1: " ".join(q)}


def test_stages_keep_other_columns_and_odd_rows(spark, sf):
    """Extra columns with names that clash, repeated rows, nulls and empty tables in the filtering stages."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    t = prose(80, 11)
    rows = [(1, t, "en", "s", 5), (1, t, "en", "s", 5), (2, None, None, None, None), (None, prose(70, 12), "en", "s", 1), (3, "", "en", "s", 0), (4, prose(90, 13), "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("row", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("gone", F.lit(2.0))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and stage(spark, docs.limit(0), sf).count() == 0, name
        ids = sorted((r["doc_id"] for r in out.collect()), key=str)
        want = {"quality_rules": [1, 1, 4, None], "near_dedup": [1, 2, 3, 4, None], "substring_dedup": [1, 2, 3, 4, None]}.get(name, [1, 1, 2, 3, 4, None])
        assert ids == sorted(want, key=str), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == 6 and len(VOCAB) == 4000


def test_token_files_with_null_and_repeated_ids(spark, tmp_path):
    """Null ids come first, rows of one id in order of text; each row is a document of its own."""
    from tokenizers import Tokenizer

    from calibrant.llm import token_files

    rows = [(5, "b words"), (5, "a words here"), (None, "no id"), (2, None), (5, "a words here")]
    path = str(tmp_path / "t")
    token_files.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path)
    tok, at, want = Tokenizer.from_file(token_files.default_tokenizer()), 0, []
    for d, t in [(None, "no id"), (2, ""), (5, "a words here"), (5, "a words here"), (5, "b words")]:
        n = len(tok.encode(t, add_special_tokens=False).ids) + 1
        want.append((d, at, n))
        at += n
    got = token_files.digests(spark, path).select("doc_id", "start", "n_tokens").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_language_edges(spark):
    """Empty tables, repeated rows, clashing columns; held-out rows are not learned from, and the sample is bounded."""
    from pyspark.sql import functions as F

    from calibrant.llm import language_id

    words = {"aa": "abcdef", "bb": "ghijkl"}
    say = lambda g, k: " ".join("".join(random.Random(k * 77 + j).choice(words[g]) for _ in range(5)) for j in range(25))
    rows = []
    for i in range(200):
        g = "aa" if i % 2 else "bb"
        held = zlib.crc32(str(i).encode()) % 4 == 2
        rows.append((i, say(g, i), ("bb" if g == "aa" else "aa") if held else g))  # languages of held-out rows are wrong
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit(1))
    m = language_id.fit(docs, rounds=1)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, m).collect()}
    assert all(got[i] == ("aa" if i % 2 else "bb") for i in range(200))
    again = language_id.identify(docs.where("doc_id = 7").union(docs.where("doc_id = 7")), m).collect()
    assert len(again) == 2 and again[0] == again[1]
    assert language_id.identify(docs.limit(0), m).count() == 0 and language_id.fit(docs.limit(0)).languages == []
    assert len(language_id.fit(docs, max_rows=5, rounds=1).languages) <= 2 and language_id.fit(docs, max_bytes=10, rounds=1).languages == []
    long = "abc" * 700 + " " + "ghi" * 700
    assert np.isfinite(language_id.train([long, long], ["aa", "bb"], rounds=1).logp).all()


def test_quality_repeated_rows_and_ties(spark):
    rows = spark.createDataFrame([(1, prose(60, 1)), (1, prose(60, 1)), (2, " ".join(["x y"] * 40))], "doc_id long, text string")
    out = quality_rules.text_stats(rows).withColumn("base_failed", quality_rules.base_failed()).collect()
    one = [tuple(r[c] for c in quality_rules.COUNTS) for r in out if r["row"]["doc_id"] == 1]
    assert len(one) == 2 and one[0] == one[1] and [r["base_failed"] for r in out if r["row"]["doc_id"] == 2] == [True]
    x = {"a": np.array([0.0] * 10 + [1.0] * 10), "b": np.array([0.0] * 10 + [1.0] * 10)}
    bad = np.array([0] * 10 + [1] * 10)
    assert quality_rules.fit_rules(x, bad) == quality_rules.fit_rules(x, bad) != []  # equal gains: the first feature
