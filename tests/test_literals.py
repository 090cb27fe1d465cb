"""Literal cases of the operators."""

import json

import pytest
from pyspark.sql import functions as F

from calibrant.functions import dists, grading, text, tokens
from calibrant.operators import curves, evaluation, selection, state, stats
from calibrant.sources import files


def one(spark, *cols):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())


def test_answers(spark):
    a = lambda x, style="boxed": text.extract_answer(F.lit(x).cast("string"), style)
    assert one(spark, a(r"\boxed{1} then \boxed{\frac{25}{8}}"), a("n=3 so 2+1=3"), a("none"), a(None)) == ("25", "3", "", "")
    assert one(spark, a("answer: 7\nAnswer: 42", "dapo")) == ("42",)
    f = lambda x: text.extract_final_answer(F.lit(x).cast("string"))
    assert one(spark, f("Final Answer: 42"), f(r"Answer: 7 \boxed{9}"), f("no digits"), f(""), f(None)) == ("42", "9", None, None, None)
    assert one(spark, text.normalize_answer(F.lit(" 1,234 ")).cast("long"), text.normalize_answer(F.lit("x"))) == (1234, None)
    assert one(spark, text.format_value(F.lit(None).cast("string")), text.format_value(F.lit("0.5"))) == ("—", "0.5000")


def test_boxes_balance_braces(spark):
    say = lambda f, x: one(spark, f(F.lit(x).cast("string")))[0]
    cases = {
        r"\boxed{42}": r"\boxed{42}", r"a \boxed{12} b\boxed{34}": r"\boxed{34}", r"\fbox{7}": r"\boxed{7}", "no box": None, "": None, None: None,
        r"x \boxed{\frac{\sqrt{2}}{3}} y}": r"\boxed{\frac{\sqrt{2}}{3}}", r"\boxed{1} \boxed{2": None, r"\boxed {7}": r"\boxed {7}", r"\boxed{{{{a}}}}": r"\boxed{{{{a}}}}",
        r"\boxed{}": r"\boxed{}", r"\boxed{a}{b}": r"\boxed{a}",
    }
    for x, want in cases.items():
        assert say(text.last_box, x) == want == grading.last_box(x), x
    assert say(text.boxed_answer, r"1 \boxed{\frac{25}{8}}") == r"\frac{25}{8}" and say(text.boxed_answer, r"\boxed {7}") is None
    f = text.extract_final_answer
    assert say(f, r"we get \boxed{\frac{\sqrt{2}}{3}} and 5") == r"\frac{\sqrt{2}}{3}" and say(f, "Answer:  ") is None and say(f, "n=3 so 2+1=3") == "3"
    assert say(f, "Final Answer: 99\n\\boxed{7}") == "7" and say(f, "half\nAnswer: 7") == "7"
    h = text.hash_answer
    assert say(h, "a #### 5.5 ") == "5.5" and say(h, r"a #### \boxed{\frac{1}{\sqrt{2}}}") == r"\frac{1}{\sqrt{2}}" and say(h, "plain") == "plain"


@pytest.mark.parametrize(
    ("given", "truth", "right"),
    [
        (r"\frac{25}{8}", "25/8", True), ("3/4", "0.75", True), ("0.75", "3/4", True), ("7 3/4", "31/4", True), ("005", "5", True), ("204", "204", True), ("204", "205", False),
        ("1/2", "1/2", True), ("1/2", "1/3", False), ("2/4", "1/2", False), ("4/2", "2", False), ("", "3", False), (None, "3", False), ("12.0", "12", True), ("30 degrees", "30", True),
        ("5 cm^2", "5", True), (r"30^\circ", "30", True), (r"1,\!000", "1000", True), ("5 million", "5*10^6", True), (r"\text{yes}", "yes", True), ("$5.50", "5.5", True), ("50\\%", "50", True),
        (r"\frac{\sqrt{2}}{3}", "sqrt2/3", True), (r"7\frac34", "31/4", True), ("(1/2)(3)", "1.5", True), ("2^10", "1024.5", False), ("2^(3)", "8.5", False), ("1/0", "2.5", False), ("x+1", "y+1", False),
        ("1 or 2", "1,2", True), ("-1/2", "-0.5", True), ("2^3+0.5", "8.5", True), ("1/3+1/6", "0.5", True),
    ],
)
def test_grading(given, truth, right):
    assert grading.grade(given, truth) is right


def test_rational_agrees_with_the_language():
    import random
    from fractions import Fraction

    r = random.Random(4)

    def make(depth):
        if not depth or r.random() < 0.3:
            n = r.randint(1, 9)
            return str(n)
        a, b, op = make(depth - 1), make(depth - 1), r.choice("+-*/")
        return r.choice(("", "-")) + f"({a}){op}({b})"

    for _ in range(300):
        said = make(3)
        try:
            want = eval(__import__("re").sub(r"\d+", lambda m: f"Fraction({m[0]})", said))
        except ZeroDivisionError:
            continue
        try:
            assert grading.rational(said) == want, said
        except grading.Undecided:
            raise AssertionError(said) from None
    assert grading.rational("2(3+1)") == 8 and grading.rational("-2^2") == -4 and grading.rational(".5*4") == Fraction(2)
    for bad in ("", "1+", "(1", "1)", "*2", "2^10", "2^3^2", "2^(1+1)", "a", "1//2"):
        with pytest.raises(ValueError):
            grading.rational(bad)


def test_tokens(spark):
    arr = lambda *x: F.array(*(F.lit(v) for v in x)) if x else F.array().cast("array<int>")
    loop = lambda a, p, m: tokens.has_tail_loop(a, p, m)
    assert one(spark, loop(arr(*[1, 2, 3] * 6), [3], 16), loop(arr(1, 2, 3, 4, 5, 6), [2], 0), loop(arr(*[1, 2, 3] * 2), [3], 16)) == (True, False, False)
    assert one(spark, tokens.strip_pad(arr(0, 0)), tokens.strip_pad(arr(1, 0, 2, 0)), tokens.pad_to(arr(5), 3)) == ([0], [1, 0, 2], [5, 0, 0])
    assert one(spark, tokens.train_length(arr(1, 9, 2), 9), F.size(tokens.eval_tokens(arr(1, 9, 2), 9)), F.size(tokens.eval_tokens(arr(9), 9))) == (2, 1, 0)


def test_distributions(spark):
    x = F.array(*(F.lit(v) for v in (0.1, 0.9, 0.9, 0.2)))
    assert [r["id"] for r in one(spark, dists.top_k(x, 2))[0]] == [1, 2]
    s, r = dists.log_softmax(x), dists.log_softmax(F.array(*(F.lit(v) for v in (0.3, 0.1, 0.5, 0.0))))
    kl = dists._sum(F.zip_with(s, r, lambda a, b: F.exp(a) * (a - b)))
    k3, true = one(spark, dists.kl_k3(s, r), kl)
    assert k3 == pytest.approx(true, abs=1e-9)
    d = F.zip_with(r, s, lambda a, b: a - b)
    pg, e = one(spark, dists.pg_token(s, s, d), dists.expected(s, d))
    assert pg == pytest.approx(-e, abs=1e-9)


def test_curves(spark):
    grid = spark.createDataFrame([(b,) for b in (256, 512, 1024, 2048, 4096)], "budget int")
    assert [r["width"] for r in curves.widths(grid).orderBy("budget").collect()] == [256, 384, 768, 1536, 2048]
    rows = spark.createDataFrame([("a", b, 1.0) for b in (256, 512, 1024, 2048, 4096)], "label string, budget int, accuracy double")
    assert tuple(curves.area(rows, grid, ["label"]).first()) == ("a", 4992.0, 1.0)
    c = spark.createDataFrame([("a", 512, 0.4), ("a", 1024, 0.6), ("b", 512, 0.3), ("c", 512, 0.5)], "label string, budget int, accuracy double")
    assert {r["label"]: r["budget_at"] for r in curves.budget_at(c, 0.5, ["label"]).collect()} == {"a": 768.0, "b": None, "c": 512.0}


def test_statistics(spark):
    x = spark.createDataFrame([(1.0, False), (1.0, True), (2.0, True), (3.0, True)], "score double, correct boolean")
    assert stats.correlate(x, "score", "correct").first()["auc"] == pytest.approx((0.5 + 1 + 1) / 3)
    few = stats.correlate(x.limit(2), "score", "correct").first()
    assert (few["rho"], few["auc"]) == (0.0, 0.5)
    arr = lambda *v: F.array(*(F.lit(k).cast("double") for k in v))
    got = one(spark, stats.sequence_delta(arr(-1, -1, -1, -1), arr(-1, -1, -1, -2), F.lit(3)), stats.sequence_delta(arr(float("nan"), None), arr(1, 1), F.lit(0)))
    assert tuple(got[0]) == (1.0, 1.0, 1) and tuple(got[1]) == (0.0, 0.0, 0)


def test_majority(spark):
    rows = [("a", 0, "42"), ("a", 1, "42"), ("a", 2, "7"), ("b", 0, None), ("b", 1, None), ("c", 0, "42"), ("c", 1, None), ("c", 2, "42"), ("d", 0, "y"), ("d", 1, "x")]
    got = evaluation.majority(spark.createDataFrame(rows, "problem_id string, sample_idx int, answer string"), ["problem_id"])
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == {"a": ("42", 2), "b": (None, 0), "c": ("42", 2), "d": ("y", 1)}


def test_length_stats(spark):
    rows = spark.createDataFrame([("g", 100, 1, "eos"), ("g", 300, 3, "eos"), ("g", 8192, 100, "budget_stop")], "g string, tokens int, wall_s int, status string")
    r = evaluation.length_stats(rows, ["g"]).first()
    assert (r["total"], r["p50"]) == (8592, 300.0) and r["eos_rate"] == pytest.approx(2 / 3) and r["tokens_per_s"] == pytest.approx(8592 / 104)


def test_selection(spark):
    same = spark.createDataFrame([(i, 0.5) for i in range(4)], "id int, v double")
    assert {r["budget"] for r in selection.budget_bands(same, "v").collect()} == {1024}
    rows = spark.createDataFrame([(g, i, 2048, 0.1 * (i + 1)) for g in (1, 2) for i in range(4)], "g int, id int, b int, v double")
    for limit, want in ((3000, [512, 512, 512, 1024]), (9000, [2048] * 4), (900, [0, 256, 256, 256]), (100, [0, 0, 0, 256])):
        got = selection.enforce_budget(rows, ["g"], "id", "b", "v", limit, 0.2).orderBy("g", "id").collect()
        assert [r["granted"] for r in got] == want * 2, limit
        assert all(r["dropped"] == (r["granted"] == 0) for r in got)
    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("b", 2), ("c", 2)], "k string, v int")
    assert {tuple(r) for r in selection.upsert(old, new, ["k"]).collect()} == {("a", 1), ("b", 2), ("c", 2)}


def test_state_machines(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, 0.0), (1, 2, 1.0, 0.0)], "u int, step int, r double, d double")
    p = state.prompt_state(rows, "u", ["step"], "r", "d").first()
    assert p["reward_ema"] == pytest.approx(0.19) and p["seen"] == 2
    limits = {"hit_rate": (0.995, 0.98)}
    status, reason = state.health({"hit_rate": F.col("v")}, limits)
    told = spark.createDataFrame([(0.999,), (0.99,), (0.97,), (None,)], "v double").select(status.alias("s"), reason.alias("r")).collect()
    assert [tuple(x) for x in told] == [("HEALTHY", ""), ("WARNING", "unknown"), ("CRITICAL", "hit_rate critical (0.97)"), ("HEALTHY", "")]
    h = state.alert_count(10)
    assert [h(i, "WARNING")["record_count"] for i in (0, 1, 9, 10, 11)] == [1, 1, 1, 2, 2]
    q = state.StaleQueue(1, least=2)
    assert [q(k, v)["result"] for k, v in (("put", 0), ("advance", 0), ("advance", 0), ("put", 0), ("get", 0), ("get", 0))] == ["queued", "advanced", "advanced", "stale", "stale", "empty"]
    r = state.RingBuffer(2)
    assert [x["slot"] for x in state.replay(r, [(i, float(i)) for i in range(4)])] == [0, 1, 0, 1]
    assert state.kl_coefficient(2.5)(1.0)["alpha"] == 2.5 and state.ratio_controller("fixed")(1, 1, 1)["alpha"] == 0.3
    linear, led = state.ratio_controller("linear"), state.ratio_controller(warmup=2)
    assert [round(linear(0, 0, 0)["alpha"], 4) for _ in range(1001)][::500] == [0.1004, 0.3004, 0.5]
    path = [led(5.0, 0.0, 5.0)["alpha"] for _ in range(20)]
    assert path[:2] == [0.3, 0.3] and all(abs(b - a) <= 0.05 + 1e-12 and 0.1 <= b <= 0.5 for a, b in zip(path, path[1:])) and path[-1] > 0.3
    aware = [state.ratio_controller(warmup=0, pull=(0.0, 0.0, 0.0, 0.5)) for _ in range(3)]
    assert aware[0](0, 0, 0, 2.0)["alpha"] > aware[1](0, 0, 0)["alpha"] == 0.3 > aware[2](0, 0, 0, 0.1)["alpha"]
    assert state.cold_start_ratio(0.3, 2, 8) == 0.25


def test_ring_buffer_against_a_scan():
    """Slots, evictions and protection against a plain scan of an array of slots; a saved buffer goes on alike."""
    import random

    r = random.Random(2)
    for cap in (1, 2, 5, 8):
        b, slots, pos = state.RingBuffer(cap, 0.5), [None] * cap, 0
        for i in range(200):
            u = r.choice([r.random(), 0.5, 2.0])
            if all(x is not None for x in slots):
                turn = [(pos + j) % cap for j in range(cap)]
                passed = next((j for j, k in enumerate(turn) if not slots[k][2]), cap)
                slots = [(*x[:2], x[2] and k not in turn[:passed]) for k, x in enumerate(slots)]
                pos = turn[passed % cap]
            gone = slots[pos][0] if slots[pos] else -1
            slots[pos] = (i, u, False)
            us = sorted(x[1] for x in slots if x)
            at = 0.5 * (len(us) - 1)
            cut = us[int(at)] + (us[min(int(at) + 1, len(us) - 1)] - us[int(at)]) * (at - int(at))
            slots[pos] = (i, u, u > cut)
            assert b(i, u) == {"slot": pos, "evicted": gone, "protected": u > cut}, (cap, i)
            pos = (pos + 1) % cap
            if i % 17 == 0:
                b = state.RingBuffer.load(json.loads(json.dumps(b.save())))
    old = state.RingBuffer.load({"capacity": 3, "rows": [{"slot": 0, "item": 7}, {"slot": 1, "item": 8, "utility": 1.0}]})
    assert old(9, 0.5) == {"slot": 2, "evicted": -1, "protected": False} and old.save()["rows"][0]["utility"] == 0.0


def test_fold_streams_keys_across_batches(spark):
    rows = spark.createDataFrame([(i % 3, i, float(i)) for i in range(500)], "k int, step int, x double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")

    def make():
        seen = []
        return lambda x: seen.append(x) or {"n": len(seen), "total": sum(seen)}

    got = {(r["k"], r["step"]): (r["n"], r["total"]) for r in state.fold(rows, ["k"], ["step"], make, ["x"], "n int, total double").collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 500
    for k in range(3):
        total = 0.0
        for n, i in enumerate(range(k, 500, 3), 1):
            total += i
            assert got[k, i] == (n, total)
    assert state.fold(rows.limit(0), ["k"], ["step"], make, ["x"], "n int, total double").count() == 0


def test_sources(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"prompt": "a", "response": "b"}\n\nnot json\n{"prompt": "", "response": "b"}\n{"prompt": null, "response": "c"}\n')
    assert files.read_jsonl(spark, str(p)).count() == 1
    got = files.read_aligned(spark, str(p), "prompt string, response string").orderBy("idx").collect()
    assert [r["corrupt"] for r in got][2] and len(got) == 5
    with pytest.raises(files.NoRows):
        files.require_rows(files.read_jsonl(spark, str(p)).where("prompt = 'z'"))
    with pytest.raises(ValueError):
        files.load(spark, "nope")
    assert files.load(spark, "synthetic", 3, 4, 10).count() == 3
    m = str(tmp_path / "m")
    files.append_metrics(spark.createDataFrame([(1, 2.0)], "step int, loss double"), m)
    files.append_metrics(spark.createDataFrame([(2, 3.0, 4.0)], "step int, loss double, kl double"), m)
    assert files.read_metrics(spark, m).where("kl IS NOT NULL").count() == 1
    rows = spark.createDataFrame([(i, 3) for i in range(4)], "id int, n_samples int")
    out = str(tmp_path / "o")
    assert files.append_missing(spark, rows.where("id < 2"), out, ["id"]).count() >= 0
    files.append_missing(spark, rows, out, ["id"])
    assert spark.read.parquet(out).count() == 4
    with pytest.raises(ValueError):
        files.append_missing(spark, rows.withColumn("n_samples", F.lit(5)), out, ["id"])
    (tmp_path / "s1.json").write_text('{"name": "b", "v": 1}')
    (tmp_path / "s2.json").write_text("{broken")
    assert files.merge_summaries(spark, [str(tmp_path / "s1.json"), str(tmp_path / "s2.json")], "name string, v int").count() == 1
    assert files.latest_checkpoint(["step-2", "step-10", "x"]) == "step-10"
    assert files.parse_scalar("1,2") == (1, 2) and files.parse_scalar("true") is True and json.dumps(files.set_dotted({}, "a.b", 1)) == '{"a": {"b": 1}}'
    spec = files.Registry({"G": files.DatasetSpec(str(p), problem=["nope", "prompt"], answer=["response"], aliases=("gg",))})
    assert spec.resolve("GG") == "G" and spec.problems(spark, "gg").count() >= 1


def test_stream_state_equals_batch(spark, tmp_path):
    from calibrant.streaming import live

    rows = [(1, i, ("advance", "put", "get")[i % 3], i // 5) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, seq long, kind string, version int")
    src = str(tmp_path / "in")
    for k in range(3):
        df.where(f"seq >= {20 * k} AND seq < {20 * k + 20}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    live.run_available(live.stale_queue(stream, "key", 2), live.once_per_batch(str(tmp_path), "out"), str(tmp_path / "cp"))
    got = [r["result"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]
    assert got == [x["result"] for x in state.replay(state.StaleQueue(2), [(r[2], r[3]) for r in rows])]


def test_quantiles_by_narrowing(spark, monkeypatch):
    """Medians and deciles against numpy, over several rounds, with ties, outliers, nulls and empty groups."""
    import numpy as np

    monkeypatch.setattr(stats, "MAX_VALUES", 20)
    monkeypatch.setattr(stats, "BINS", 8)
    r = np.random.default_rng(3)
    data = {"a": r.normal(size=700), "b": np.r_[np.zeros(300), 1e12, -5.0], "c": np.array([2.5]), "d": np.exp(r.normal(size=400) * 8), "e": np.array([])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("e", None), ("a", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {x["k"]: x for x in stats.signal_stats(df, "v", ["k"]).collect()}
    data[None] = np.array([1.0, 2.0])
    for k, v in data.items():
        g = got[k]
        assert g["n"] == len(v)
        want = np.quantile(v, [0.5, 0.1, 0.9]) if len(v) else [None] * 3
        assert [g["median"], g["p10"], g["p90"]] == (pytest.approx(list(want), rel=1e-12, abs=1e-12) if len(v) else want), k
    whole = stats.signal_stats(df.where("k = 'a'"), "v", []).first()
    assert whole["median"] == pytest.approx(np.median(data["a"])) and whole["over_0"] == pytest.approx((data["a"] > 0).mean())
    assert stats.signal_stats(df.limit(0), "v", ["k"]).count() == 0


def test_length_stats_by_counts(spark):
    import statistics

    lengths = [5, 1, 9, 9, 4, 100, 7, None]
    df = spark.createDataFrame([("g", x, 1.0, "eos" if x == 9 else "loop") for x in lengths] + [("one", 3, 0.0, "eos"), ("none", None, 1.0, "loop")], "k string, tokens int, wall_s double, status string")
    got = {r["k"]: r for r in evaluation.length_stats(df, ["k"]).collect()}
    own = sorted(x for x in lengths if x is not None)
    q = statistics.quantiles(own, n=20)
    assert (got["g"]["n"], got["g"]["total"], got["g"]["longest"]) == (8, sum(own), 100)
    assert got["g"]["p50"] == statistics.median(own) and got["g"]["p90"] == pytest.approx(q[17]) and got["g"]["p95"] == pytest.approx(q[18])
    assert got["g"]["eos_rate"] == 0.25 and got["one"]["p90"] == 3.0 and got["one"]["tokens_per_s"] == 0.0 and got["none"]["p90"] == 0.0


def test_detector_sweep_names_its_cases(spark):
    """The sequences flagged and missed stand beside the figures; a configuration without any keeps its row."""
    from calibrant.operators import calibration

    data = [(0, [1, 2, 3] * 6, True), (1, [7, 8, 9, 10, 11, 12, 7, 8, 7, 8], False), (2, [1, 2, 3, 4, 5] * 3, True)]
    df = spark.createDataFrame(data, "k long, ids array<int>, label boolean")
    sweep = lambda label: sorted(tuple(r) for r in calibration.detector_sweep(df, "k", "ids", [((2, 3, 4), 8)], label).select("detected", "rate", "false_positive_rate", "missed", "k", "kind").collect())
    assert sweep("label") == [(2, 2 / 3, 1.0, 1, 0, "flagged"), (2, 2 / 3, 1.0, 1, 1, "flagged"), (2, 2 / 3, 1.0, 1, 2, "missed")]
    assert sweep(None) == [(2, 2 / 3, None, None, 0, "flagged"), (2, 2 / 3, None, None, 1, "flagged")]
    none = calibration.detector_sweep(df, "k", "ids", [((2, 3), 99), ((5,), 15)], None).select("config", "detected", "k", "kind").collect()
    assert sorted(map(tuple, none)) == [("periods=(2, 3),min_len=99", 0, None, None), ("periods=(5,),min_len=15", 1, 2, "flagged")]
