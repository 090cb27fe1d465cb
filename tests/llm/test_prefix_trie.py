"""The trie against brute force, over few and many ranges: shared turns, copies, turnless conversations, nulls, deep chains."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from calibrant.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + v[h:]
    return own, out


def brute(convs):
    """(smallest member, depth) to the rest."""
    nodes = {}
    for c, v in convs.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    kids, low = {p: 0 for p in nodes}, {p: min(m) for p, m in nodes.items()}
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = {p: int(not kids[p]) for p in nodes}, {p: (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0) for p, m in nodes.items()}
    for p in sorted(nodes, key=len, reverse=True):
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = {p: ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p)))) for p, m in nodes.items()}
    return {(low[p], len(p)): (low[p[:-1]] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in nodes.items()}


def result(df):
    rows = df.collect()
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(got) == len(rows)
    return got


def talk(n, seed, words=3, most=6):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, most)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", " ".join(["w"] * r.randrange(words))))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("ranges", [1, 2, 7, 40, 300])
def test_matches_brute_force_over_any_number_of_ranges(spark, ranges):
    rows = talk(160, 3)
    rows += [(200 + k, t, "user", f"same {t}") for k in range(60) for t in range(4)]  # copies, over many ranges
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    own, new = rebuilt(rows)
    assert result(prefix_trie.trie(df, ranges)) == brute(own)
    assert result(prefix_trie.build(prefix_trie.rebuild(prefix_trie.keys(df)), ranges)) == brute(new)


@pytest.mark.parametrize("seed", range(30))
def test_sweeps_and_seams(seed):
    """Cuts of sorted rows at any places, empty ranges among them: joined nodes equal those of one sweep; no Spark."""
    r = random.Random(seed)
    turns = ["".join(r.choice("0123456789abcdef") for _ in range(prefix_trie.WIDTH)) for _ in range(3)]
    size = {t: r.randrange(4) for t in turns}
    rows = sorted(("".join(seq), c, [size[t] for t in seq]) for c in range(40) for seq in [[r.choice(turns) for _ in range(r.randrange(4))]])
    cuts = sorted(r.randrange(len(rows) + 1) for _ in range(r.randrange(6)))
    merged = {}
    for limit in ([], cuts):
        swept, back = [], None
        for part, (i, j) in enumerate(zip([0, *limit], [*limit, len(rows)])):
            s = prefix_trie.Sweep(part)
            for key, c, w in rows[i:j]:
                s.row(c, key, w)
            s.end()
            same = total = goes_on = None
            if s.front and back is not None:
                same = prefix_trie.common(back, s.front[0])
                total, goes_on = s.front[1][same], same * prefix_trie.WIDTH == len(back)
            back = s.key if s.front else back
            swept += [x | {"same": same, "total": total, "goes_on": goes_on} for x in s.out]
        nodes, low = {}, {}
        for x in swept:
            if x.get("key") and "piece" not in x:
                one = x["first"] and x["same"] is not None and x["same"] >= x["depth"]
                n = nodes.setdefault(x["key"], [x["parent_key"], x["depth"], x["conv_id"], 0, 0, 0, 0])
                n[2] = min(n[2], x["conv_id"])
                n[3] += x["n_convs"]
                n[4] += x["n_children"] - bool(x["first"] and x["same"] is not None and x["same"] > x["depth"])
                n[5] += x["n_leaves"] - bool(one and x["goes_on"])
                n[6] += x["saved_tokens"] + (x["total"] - x["before"] if one else 0)
        low = {k: n[2] for k, n in nodes.items()}
        out = [(n[2], n[1], low.get(n[0]), *n[3:]) for n in nodes.values()]
        out += [(x["conv_id"], x["depth"], x.get("parent_conv_id", low.get(x.get("parent_key"))), x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"]) for x in swept if "key" not in x and "front" not in x]
        merged[len(limit)] = sorted(out, key=str)
    assert len({str(v) for v in merged.values()}) == 1


def test_ids_that_leave_in_pieces(spark):
    """A list of ids longer than a piece, inside one range and over several."""
    rows = [(c, t, "u", x) for c in range(9000) for t, x in enumerate(["hello there", "bye"][: 1 + c % 2])]
    rows += [(c + 10_000, *x) for c, *x in talk(30, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rebuilt(rows)[0])
    for ranges in (1, 5):
        assert result(prefix_trie.trie(df, ranges)) == want


def test_odd_rows(spark):
    """Null and repeated turns, null roles, texts and ids, tricky texts, clashing columns, ids below zero, empty tables."""
    rows = [(1, None, None, None), (1, 0, "a", "b"), (2, None, "", ""), (2, 0, "ab", ""), (3, 0, "", "ab"), (4, 5, "", None), (40, 1, "x", "one two"), (41, 0, "x", "one  two"), (45, 0, "x", "one two"), (45, 1, "y", " é"), (None, 0, "u", "no id"), (-7, 0, "x", "one two")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")).withColumn("words", F.lit(1)).withColumn("t", F.lit(0))
    assert result(prefix_trie.trie(df, 3)) == brute(rebuilt(rows)[0])
    same = [(9, 0, "u", "a"), (9, 0, "u", "b"), (9, 0, "u", "a"), (8, 0, "u", "b"), (8, 0, "u", "a"), (8, 0, "u", "a")]
    got = result(prefix_trie.trie(spark.createDataFrame(same, SCHEMA), 2))  # the same turns under one number: one order
    assert len(got) == 4 and all(v[1] == 2 for v in got.values())
    assert prefix_trie.trie(df.limit(0), 2).count() == 0
    deep = [(c, t, "u", f"{t} {'x' * (c if t == 1500 else 0)}") for c in range(3) for t in range(2000)]
    assert result(prefix_trie.trie(spark.createDataFrame(deep, SCHEMA), 3)) == brute(rebuilt(deep)[0])


def test_query_matches_sql_and_brute_force(spark, tmp_path):
    rows = talk(130, 8) + [(1000 + k, 0, "user", "hi") for k in range(40)]
    rows = [x for x in rows if x[0] not in (20, 60)]  # groups without a first conversation
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = prefix_trie.query(spark, str(tmp_path))
    assert result(got) == brute(rebuilt(rows)[1])
    sql = duckdb.connect().sql(prefix_trie.ORACLE.replace("FROM conversations", f"FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(sql, key=str)
