"""Text, prompt and token-sequence queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from calibrant.functions import grading as g
from calibrant.functions import text as t
from calibrant.functions import tokens as k
from calibrant.operators import relational, training
from calibrant.plans.views import read
from calibrant.session import ship

QUERIES, ORACLE = {}, {}


def add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


def answers(s, d):
    """Response texts with a box, nested boxes, a marked answer, a bare number or none: one for each line item."""
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 6
    text = (
        F.when(n == 0, F.concat(F.lit("so x \\boxed{"), q, F.lit("} and more")))
        .when(n == 1, F.concat(F.lit("Final Answer: "), q, F.lit(".5 units\nanswer: 3")))
        .when(n == 2, F.concat(F.lit("n=3 then "), q, F.lit(",000 and no box \\boxed{\\frac{"), q, F.lit("}{8}}")))
        .when(n == 3, F.concat(F.lit("\\boxed{1} deep \\fbox{\\frac{\\sqrt{"), q, F.lit("^{2}}}{1+\\frac{1}{\\frac{2}{3}}}} end}")))
        .when(n == 4, F.concat(F.lit("open \\boxed{"), q, F.lit(" Answer:   \n  "), q, F.lit(" ")))
        .otherwise(F.lit("no digits here"))
    )
    return read(s, d, "lineitem").select(*_ID, text.alias("text"))


_ID = ("l_orderkey", "l_linenumber")
_K = ", ".join(_ID)
_A = r"""WITH a0 AS (SELECT l_orderkey, l_linenumber, l_quantity::INT::VARCHAR AS q, l_linenumber % 6 AS n FROM lineitem),
a1 AS (SELECT l_orderkey, l_linenumber, CASE n WHEN 0 THEN 'so x \boxed{' || q || '} and more' WHEN 1 THEN 'Final Answer: ' || q || '.5 units' || chr(10) || 'answer: 3'
  WHEN 2 THEN 'n=3 then ' || q || ',000 and no box \boxed{\frac{' || q || '}{8}}' WHEN 3 THEN '\boxed{1} deep \fbox{\frac{\sqrt{' || q || '^{2}}}{1+\frac{1}{\frac{2}{3}}}} end}'
  WHEN 4 THEN 'open \boxed{' || q || ' Answer:   ' || chr(10) || '  ' || q || ' ' ELSE 'no digits here' END AS text FROM a0),
a2 AS (SELECT *, string_split(string_split(replace(text, '\fbox', '\boxed'), '\boxed')[-1], '}') AS p FROM a1),
a3 AS (SELECT *, list_filter(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x) - length(replace(x, '{', '')))) = i)[1] AS j FROM a2),
a4 AS (SELECT l_orderkey, l_linenumber, text, CASE WHEN contains(replace(text, '\fbox', '\boxed'), '\boxed') AND j IS NOT NULL THEN '\boxed' || array_to_string(p[1:j], '}') || '}' END AS box FROM a3),
a AS (SELECT *, CASE WHEN box[1:7] = '\boxed{' THEN box[8:-2] END AS inside FROM a4)
"""
_NUM, _BOX = "-?[0-9][0-9,]*", r"\\boxed\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
_BOXES = f"regexp_extract_all(text, '{_BOX}', 1)"
_EXTRACT = f"coalesce((regexp_extract_all(list_filter({_BOXES}, lambda b: regexp_matches(b, '{_NUM}'))[-1], '{_NUM}'))[1], trim({_BOXES}[-1]), regexp_extract_all(text, '{_NUM}')[-1], '')"
_MARKED = r"regexp_extract_all(text, '(?i)(?:final\s+answer|answer)\s*[:：]\s*([^\n]+)', 1)[1]"


def on_answers(cols):
    return lambda s, d: answers(s, d).select(*_ID, *cols())


add("str01_extract_answer", on_answers(lambda: [t.extract_answer(F.col("text")).alias("answer")]), _A + f"SELECT {_K}, {_EXTRACT} AS answer FROM a")
add("str01_extract_answer_line", on_answers(lambda: [t.extract_answer(F.col("text"), "dapo").alias("answer")]),
    _A + rf"SELECT {_K}, coalesce(regexp_extract_all(regexp_extract_all(text, '[Aa]nswer\s*:\s*([^\n]+)', 1)[-1], '{_NUM}')[1], {_EXTRACT}) AS answer FROM a")
add("str02_normalize_answer", on_answers(lambda: [t.normalize_answer(t.extract_answer(F.col("text"))).cast("long").alias("value")]), _A + f"SELECT {_K}, try_cast(replace(trim({_EXTRACT}), ',', '') AS BIGINT) AS value FROM a")
add("str03_last_box", on_answers(lambda: [t.last_box(F.col("text")).alias("box")]), _A + f"SELECT {_K}, box FROM a")
add("str04_remove_boxed", on_answers(lambda: [t.boxed_answer(F.col("text")).alias("inside")]), _A + f"SELECT {_K}, inside FROM a")
add("str11_final_answer", on_answers(lambda: [t.extract_final_answer(F.col("text")).alias("answer")]),
    _A + f"SELECT {_K}, CASE WHEN inside <> '' THEN inside WHEN {_MARKED} IS NOT NULL THEN nullif(regexp_replace({_MARKED}, '^\\s+|\\s+$', '', 'g'), '') ELSE nullif({_EXTRACT}, '') END AS answer FROM a")


def graded(s, d):
    """Given answers and true ones of seven forms, one for each line item."""
    ship(s)
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 7
    x = q.cast("string")
    text = lambda *parts: F.concat(*(F.lit(z) if isinstance(z, str) else z for z in parts))
    given = (
        F.when(n == 0, text("\\frac{", x, "}{2}")).when(n == 1, text(x, ".0")).when(n == 2, text(x, " 1/2")).when(n == 3, text("\\text{", x, " cms}"))
        .when(n == 4, text(x, " + 1")).when(n == 5, text(x, "/2")).otherwise(F.lit(""))
    )
    truth = F.when(n == 0, text(x, "/2")).when(n == 2, text((2 * q + 1).cast("string"), "/2")).when(n == 5, text("2 \\cdot ", x, "/4")).otherwise(x)
    return read(s, d, "lineitem").select(*_ID, given.alias("given"), truth.alias("truth"))


def on_graded(cols):
    return lambda s, d: graded(s, d).select(*_ID, *cols())


_G = "WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity::INT::VARCHAR AS q, l_linenumber % 7 AS n FROM lineitem) "
_NORMAL = "CASE n WHEN 0 THEN q || '/2' WHEN 1 THEN q WHEN 2 THEN q || '+1/2' WHEN 3 THEN q WHEN 4 THEN q || '+1' WHEN 5 THEN q || '/2' ELSE '' END"
add("str05_parse_latex", on_graded(lambda: [g.latex_udf("given").alias("plain")]), _G + f"SELECT {_K}, CASE WHEN n = 1 THEN q || '.0' ELSE {_NORMAL} END AS plain FROM g")
add("str06_normalize", on_graded(lambda: [g.normalize_udf("given").alias("normal")]), _G + f"SELECT {_K}, {_NORMAL} AS normal FROM g")
add("str07_grade_text", on_graded(lambda: [g.grade_text_udf("given", "truth").alias("same")]), _G + f"SELECT {_K}, n IN (0, 1, 3) AS same FROM g")
add("str08_grade", on_graded(lambda: [g.grade_udf("given", "truth").alias("right")]), _G + f"SELECT {_K}, n IN (0, 1, 2, 3, 5) AS right FROM g")
add("str09_same_value", on_graded(lambda: [g.same_value_udf("given", "truth").alias("same")]), _G + f"SELECT {_K}, n IN (0, 1, 2, 3, 5) AS same FROM g")
add("str10_judge", lambda s, d: graded(s, d).select(*_ID, g.judge(F.concat(F.lit("so \\boxed{"), "given", F.lit("}")), F.col("truth")).alias("right")), _G + f"SELECT {_K}, n IN (0, 1, 2, 3, 5) AS right FROM g")
add("str12_hash_answer", lambda s, d: read(s, d, "customer").select("c_custkey", t.hash_answer(F.concat("c_name", F.lit(" #### "), F.col("c_custkey").cast("string"), F.lit(" "))).alias("gt")), "SELECT c_custkey, c_custkey::VARCHAR AS gt FROM customer")
add("str13_label_year", lambda s, d: read(s, d, "orders").select("o_orderkey", t.label_year(F.col("o_orderkey").cast("string")).alias("year")), "SELECT o_orderkey, CASE WHEN contains(o_orderkey::VARCHAR, '24') THEN '2024' WHEN contains(o_orderkey::VARCHAR, '25') THEN '2025' END AS year FROM orders")
add("prj01_format_prompt", lambda s, d: read(s, d, "benchmark").select("item_id", t.format_prompt(F.col("text")).alias("prompt")), r"SELECT item_id, trim(text) || chr(10) || 'Please reason step by step, and put your final answer within \boxed{}.' AS prompt FROM benchmark")
add("prj02_chat_prompt", lambda s, d: read(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["text"], F.lit("<|im_end|>\n"))), "").alias("chat")),
    "SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS chat FROM conversations GROUP BY conv_id")
add("prj14_format_value", lambda s, d: read(s, d, "events").select("event_id", t.format_value(F.when(F.col("event_id") % 3 == 0, F.lit("x")).otherwise((F.col("event_id") % 100).cast("string"))).alias("shown")), "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '—' ELSE (event_id % 100)::VARCHAR || '.0000' END AS shown FROM events")
add("prj13_label_map", lambda s, d: read(s, d, "orders").select("o_orderkey", F.coalesce(F.create_map(F.lit("P"), F.lit("pending"), F.lit("F"), F.lit("filled"))[F.col("o_orderstatus")], F.col("o_orderstatus")).alias("label")), "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS label FROM orders")

# token ids: a word's length modulo 5, so that loops and end tokens (4) occur
_T = "WITH tk AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: (len(w) % 5)::INT) AS ids FROM documents) "


def toks(s, d):
    return read(s, d, "documents").select("doc_id", F.transform(F.split("text", " "), lambda w: (F.length(w) % 5).cast("int")).alias("ids"))


def on_tokens(cols):
    return lambda s, d: toks(s, d).select("doc_id", *cols())


_S = "list_sum(list_transform({0}, lambda x, i: (x * i)::BIGINT))::BIGINT"  # a checksum that sees order
_sum = lambda a: F.aggregate(F.transform(a, lambda x, i: (x * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda p, q: p + q)
_PAD = "list_concat(ids, list_transform(range(32), lambda x: 0))[1:32]"
add("prj03_pad", on_tokens(lambda: [F.size(k.pad_to(F.col("ids"), 32)).alias("n"), _sum(k.pad_to(F.col("ids"), 32)).alias("check")]), _T + f"SELECT doc_id, 32 AS n, {_S.format(_PAD)} AS check FROM tk")
add("prj04_truncate_content", on_tokens(lambda: [F.size(k.truncate_content(F.col("ids"), 24, 10)).alias("n"), F.array_join(k.truncate_content(F.col("ids"), 24, 10), " ").alias("kept")]), _T + "SELECT doc_id, least(len(ids), 14)::INT AS n, coalesce(array_to_string(ids[1:14], ' '), '') AS kept FROM tk")
_LASTNZ = "coalesce(list_max(list_transform(ids, lambda x, i: CASE WHEN x <> 0 THEN i ELSE 0 END)), 0)"
add("prj05_strip_pad", on_tokens(lambda: [F.size(k.strip_pad(F.col("ids"))).alias("n"), _sum(k.strip_pad(F.col("ids"))).alias("check")]), _T + f"SELECT doc_id, greatest({_LASTNZ}, 1)::INT AS n, coalesce({_S.format(f'ids[1:greatest({_LASTNZ}, 1)]')}, 0) AS check FROM tk")
add("prj06_length_mask", on_tokens(lambda: [F.aggregate(k.length_mask(F.size(F.col("ids")), 32), F.lit(0), lambda a, b: a + b).alias("ones")]), _T + "SELECT doc_id, least(len(ids), 32)::INT AS ones FROM tk")
add("prj07_relative_position", on_tokens(lambda: [F.round(F.aggregate(k.relative_position(F.size(F.col("ids")), 32), F.lit(0.0), lambda a, b: a + b), 6).alias("total")]),
    _T + "SELECT doc_id, round(list_sum(list_transform(range(32), lambda t: CASE WHEN t < len(ids) THEN t::DOUBLE / greatest(len(ids) - 1, 1) ELSE -1e0 END)), 6) AS total FROM tk")
_LOOP = "list_bool_or(list_transform([1, 2, 3], lambda p: len(ids) >= 2 * p AND len(ids) >= 4 AND ids[len(ids) - p + 1 : len(ids)] = ids[len(ids) - 2 * p + 1 : len(ids) - p]))"
add("arr02_tail_loop", on_tokens(lambda: [k.has_tail_loop(F.col("ids"), [1, 2, 3], 4).alias("looped")]), _T + f"SELECT doc_id, {_LOOP} AS looped FROM tk")
add("arr03_repetition_penalty", lambda s, d: read(s, d, "embeddings").select("vec_id", F.round(F.aggregate(k.repetition_penalty(F.transform("embedding", lambda x: x.cast("double")), F.array(F.lit(1), F.lit(5)), 1.3), F.lit(0.0), lambda a, b: a + b), 5).alias("total")),
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: CASE WHEN i IN (2, 6) THEN x::DOUBLE / 1.3::DOUBLE ELSE x::DOUBLE END)), 5) AS total FROM embeddings")
add("arr04_status", on_tokens(lambda: [k.status(F.col("ids"), 4, [1, 2, 3], 4).alias("status"), k.train_length(F.col("ids"), 4).alias("length")]),
    _T + f"SELECT doc_id, CASE WHEN {_LOOP} THEN 'loop' WHEN len(ids) = 0 THEN 'empty' WHEN list_contains(ids, 4) THEN 'eos' ELSE 'budget_stop' END AS status, coalesce(list_position(ids, 4), len(ids))::BIGINT AS length FROM tk")
add("arr05_eval_tokens", on_tokens(lambda: [F.size(k.eval_tokens(F.col("ids"), 4)).alias("n")]), _T + "SELECT doc_id, coalesce(list_position(ids, 4) - 1, len(ids))::INT AS n FROM tk")
add("arr08_chosen_rank", on_tokens(lambda: [k.chosen_rank(F.col("ids"), F.lit(3), 40).alias("rank")]), _T + "SELECT doc_id, coalesce(list_position(ids, 3) - 1, 40)::BIGINT AS rank FROM tk")
add("set04_distinct_tokens", on_tokens(lambda: [F.size(F.array_distinct(F.col("ids"))).alias("n")]), _T + "SELECT doc_id, len(list_distinct(ids))::INT AS n FROM tk")
add("map01_get_with_default", lambda s, d: read(s, d, "events").select("event_id", F.coalesce(F.from_json("props", "map<string,int>")["k"], F.lit(-1)).alias("k"), F.coalesce(F.from_json("props", "map<string,int>")["z"], F.lit(-1)).alias("z")), "SELECT event_id, coalesce((props->>'$.k')::INT, -1) AS k, coalesce((props->>'$.z')::INT, -1) AS z FROM events")
add("jsn01_tolerant_parse", lambda s, d: read(s, d, "events").select("event_id", F.get_json_object(F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.col("props")), "$.k").cast("int").alias("k")), "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (props->>'$.k')::INT END AS k FROM events")
add("mth01_scalar_math", lambda s, d: read(s, d, "events").select("event_id", F.round(F.col("value") / (1 + F.abs("value")), 9).alias("squashed"), F.round(F.least(F.greatest(F.ln(F.col("value") + 1), F.lit(0.5)), F.lit(2.0)), 9).alias("clamped"), F.coalesce(F.try_divide(F.lit(1.0), F.col("event_id") % 3), F.lit(0.0)).alias("safe")).withColumn("safe", F.round("safe", 9)),
    "SELECT event_id, round(value / (1 + abs(value)), 9) AS squashed, round(least(greatest(ln(value + 1), 0.5), 2), 9)::DOUBLE AS clamped, round(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1e0 / (event_id % 3) END, 9) AS safe FROM events")
add("join12_overlap", lambda s, d: toks(s, d).select("doc_id", F.round(k.overlap_rate(F.slice("ids", F.lit(1), F.ceil(F.size("ids") / 2).cast("int")), F.slice("ids", F.ceil(F.size("ids") / 2).cast("int") + 1, F.size("ids"))), 6).alias("rate")).where("rate IS NOT NULL"),
    _T + ", h AS (SELECT doc_id, ids[1:(len(ids) + 1) // 2] AS a, list_distinct(ids[(len(ids) + 1) // 2 + 1:]) AS b FROM tk) SELECT doc_id, round(len(list_filter(a, lambda x: list_contains(b, x)))::DOUBLE / len(a), 6) AS rate FROM h WHERE len(a) > 0",)
add("prj10_gather_rows", lambda s, d: relational.gather_rows(read(s, d, "documents").select("doc_id", "lang"), "doc_id", read(s, d, "orders").select(F.col("o_orderkey").alias("place"), (F.col("o_custkey") * 3).alias("doc_id"))).select("place", "doc_id", "lang"),
    "SELECT o_orderkey AS place, doc_id, lang FROM orders JOIN documents ON doc_id = o_custkey * 3")
add("prj09_row_range", lambda s, d: read(s, d, "orders").where((F.col("o_orderkey") >= 100) & (F.col("o_orderkey") < 200)).select((F.col("o_orderkey") - 100).alias("idx"), "o_totalprice"), "SELECT o_orderkey - 100 AS idx, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
add("prj08_valid_status", lambda s, d: read(s, d, "events").where(~F.col("event_type").isin("error", "view")).select("event_id", "event_type"), "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'view')")
_SETTINGS = lambda s, d, n, add: read(s, d, "nation").where(n).select(F.when(F.col("n_nationkey") == 7, "model_type").otherwise(F.col("n_name")).alias("name"), (F.col("n_nationkey") % add).alias("v"))
add("prj12_config_diff", lambda s, d: relational.config_diff(_SETTINGS(s, d, "n_nationkey < 20", 4), _SETTINGS(s, d, "n_nationkey > 4", 3), "name", "v"),
    """SELECT name, x AS "left", y AS "right" FROM (SELECT n_name AS name, n_nationkey % 4 AS x FROM nation WHERE n_nationkey < 20 AND n_nationkey <> 7) a
FULL JOIN (SELECT n_name AS name, n_nationkey % 3 AS y FROM nation WHERE n_nationkey > 4 AND n_nationkey <> 7) b USING (name) WHERE x IS DISTINCT FROM y""")  # fmt: skip
_RENAMED = lambda s, d: read(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("acc"), F.col("o_custkey").cast("double").alias("pass@1"), F.col("o_custkey").alias("max_tokens"))
add("prj15_alias_fields", lambda s, d: (lambda x: x.select("o_orderkey", relational.first_of(x, "accuracy").alias("accuracy"), relational.first_of(x, "budget").alias("budget")))(_RENAMED(s, d)), "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, o_custkey) AS accuracy, o_custkey AS budget FROM orders")
add("prj11_cold_start", lambda s, d: read(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", training.skip_reason(F.col("n"), 100).alias("reason")), "SELECT user_id, CASE WHEN count(*) < 100 THEN 'too few' END AS reason FROM events GROUP BY user_id")
add("prj02_generation_prompt", lambda s, d: read(s, d, "benchmark").select("item_id", t.chat_prompt(t.format_prompt(F.col("text"))).alias("prompt")), r"SELECT item_id, '<|im_start|>user' || chr(10) || trim(text) || chr(10) || 'Please reason step by step, and put your final answer within \boxed{}.' || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM benchmark")
add("arr06_token_logps", lambda s, d: read(s, d, "embeddings").select("vec_id", F.round(F.aggregate(k.token_logps(F.transform("embedding", lambda x, i: F.when(i % 5 == 3, F.expr("cast(map() as map<int,double>)")).otherwise(F.create_map(i, x.cast("double"))))), F.lit(0.0), lambda a, b: a + F.coalesce(b, F.lit(0.0))), 5).alias("total")),
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: CASE WHEN (i - 1) % 5 = 3 THEN 0 ELSE x::DOUBLE END)), 5) AS total FROM embeddings")
