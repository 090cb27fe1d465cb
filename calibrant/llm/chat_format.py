"""Chat formatting in budgeted, turn-aligned windows; DataFrame operations only.

Running sums of turn tokens cut each conversation into spans of whole turns: a span holds the
turns that start and end in the same stretch of `budget` tokens (less those kept for the system
turn and history); a turn that crosses a stretch's end is a span of its own. Each window shows
the leading system turn, at most `history` tokens of the turns just before the span, and the
span. Repeated turns come first in a window and carry no loss, so each assistant text is a
target exactly once.

A window is `<s>` and, for each turn, `[INST]role[/INST]text</s>`. These strings and the
backslash are escaped inside roles and texts, and unescape() gives them back.

The running sums go in two levels (stretches of 256 turn numbers, then within), so that one
very long conversation is dealt over many tasks; windows are bounded by the budget and by the
longest single turn.

Defined results: null text or role counts as empty; rows that repeat a turn number are turns of
their own, ordered by role and text; null turn numbers come first; rows without conv_id form
one conversation with a null id; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibrant.session import table

BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_CODES = [(END, "\\e"), (BEGIN, "\\s"), (OPEN, "\\i"), (CLOSE, "\\j")]
_BLOCK = 256


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), _CODES, out)


def unescape(text: Column) -> Column:
    parts = F.split(text, r"\\\\", -1)  # a regular expression for two backslashes
    plain = F.transform(parts, lambda p: reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), _CODES, p))
    return F.array_join(plain, "\\")


def count_tokens(text: Column) -> Column:
    """Default measure of a turn: its words, and four for the marks."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long") + 4


def plan(conversations: DataFrame, budget: int = 1024, history: int = 256, tokens=count_tokens) -> DataFrame:
    """Turns with their order, running token sums, span and the conversation's system turn."""
    base = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumns({"tokens": tokens(F.col("text")), "block": F.floor(F.col("turn") / _BLOCK)})
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    blocks = base.groupBy("conv_id", "block").agg(
        F.sum("tokens").alias("block_tokens"), F.count("*").alias("block_turns"),
        F.min(F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("t"), "role", "text", "tokens")).alias("head"),
    )
    conv = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first())
    whole = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block"),
        (F.sum("block_tokens").over(conv) - F.col("block_tokens")).alias("tokens_before"),
        (F.sum("block_turns").over(conv) - F.col("block_turns")).alias("turns_before"),
        F.first("head").over(whole).alias("head"),
    )
    turns = base.join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & F.col("block").eqNullSafe(F.col("b_block"))).drop("b_conv", "b_block")
    near = Window.partitionBy("conv_id", "block").orderBy(*order)
    led = F.col("head.role") == "system"
    s = F.when(led, F.col("head.tokens")).otherwise(F.lit(0))
    turns = turns.withColumns({
        "ord": F.col("turns_before") + F.row_number().over(near) - 1,
        "after": F.col("tokens_before") + F.sum("tokens").over(near) - s,
        "cap": F.greatest(F.lit(budget - history) - s, F.lit(max(1, budget // 4))).cast("long"),
    })
    turns = turns.withColumn("before", F.col("after") - F.col("tokens"))
    lead = led & (F.col("ord") == 0)
    stretch = F.floor(F.col("before") / F.col("cap"))
    crosses = F.col("after") > (stretch + 1) * F.col("cap")
    return turns.select(
        "conv_id", "ord", "role", "text", "before", "after", "cap", lead.alias("lead"),
        F.when(led, F.col("head.text")).alias("system"),
        F.when(lead, F.lit(0)).otherwise(2 * stretch + crosses.cast("long")).cast("long").alias("span"),
    )


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256, tokens=count_tokens) -> DataFrame:
    """One row for each window: conv_id, span, formatted, n_repeated (turns at its start), targets (character spans from 0)."""
    turns = table(plan(conversations, budget, history, tokens), "turns")  # read several times below
    # a turn is history of a span that begins at most `history` tokens after it began, so of the next few only
    reach = F.ceil(F.lit(history) / F.col("cap")) + 1
    starts = turns.where(~F.col("lead")).groupBy("conv_id", "span").agg(F.min("before").alias("from"), F.max("system").alias("system"))
    starts = starts.select(F.col("conv_id").alias("s_conv"), F.col("span").alias("s_span"), "from", "system")
    lone = turns.where(F.col("lead")).select("conv_id", "ord", "role", "text", F.col("span"), F.lit(True).alias("new"))
    new = turns.where(~F.col("lead")).select("conv_id", "ord", "role", "text", "span", F.lit(True).alias("new"))
    ahead = turns.where(~F.col("lead")).withColumn("to", F.explode(F.sequence(F.col("span") + 1, F.col("span") + 2 * reach + 1)))
    past = ahead.join(starts.drop("system"), F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("to") == F.col("s_span")))
    past = past.where((F.col("after") <= F.col("from")) & (F.col("before") >= F.col("from") - history))
    past = past.select("conv_id", "ord", "role", "text", F.col("to").alias("span"), F.lit(False).alias("new"))
    # the system turn is new in the first span of its conversation, which need not be span 0
    first = Window.partitionBy("s_conv")
    systems = starts.where(F.col("system").isNotNull()).withColumn("low", F.min("s_span").over(first))
    again = systems.where(F.col("s_span") > F.col("low")).select(F.col("s_conv").alias("conv_id"), F.lit(-1).cast("long").alias("ord"), F.lit("system").alias("role"), F.col("system").alias("text"), F.col("s_span").alias("span"), F.lit(False).alias("new"))
    low = systems.where(F.col("s_span") == F.col("low")).select(F.col("s_conv"), F.col("s_span"))
    lone = lone.join(low, F.col("conv_id").eqNullSafe(F.col("s_conv")), "left").withColumn("span", F.coalesce("s_span", "span")).drop("s_conv", "s_span")
    rows = new.unionByName(past).unionByName(again).unionByName(lone)
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    rows = rows.withColumns({"head": head, "body": escape(F.col("text"))}).withColumn("turn", F.concat("head", "body", F.lit(END)))
    at = Window.partitionBy("conv_id", "span").orderBy("ord")
    rows = rows.withColumn("at", F.sum(F.length("turn")).over(at) - F.length("turn") + len(BEGIN) + F.length("head"))
    target = F.when(F.col("new") & (F.col("role") == "assistant"), F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    out = rows.groupBy("conv_id", "span").agg(
        F.array_sort(F.collect_list(F.struct("ord", "turn"))).alias("turns"),
        F.array_sort(F.collect_list(target)).alias("targets"),
        F.sum((~F.col("new")).cast("long")).alias("n_repeated"),
    )
    return out.select("conv_id", "span", F.concat(F.lit(BEGIN), F.array_join("turns.turn", "")).alias("formatted"), "n_repeated", "targets")


def read_windows(windows: DataFrame) -> DataFrame:
    """The turns a window adds, from its text alone: conv_id, span, turns(role, text); and its loss text."""
    body = F.substr("formatted", F.lit(len(BEGIN) + 1))
    raw = F.split(body, END, -1)
    added = F.slice(raw, F.col("n_repeated").cast("int") + 1, F.size(raw) - 1 - F.col("n_repeated").cast("int"))

    def turn(x: Column) -> Column:
        parts = F.split(F.substr(x, F.lit(len(OPEN) + 1)), r"\[/INST\]", -1)
        return F.struct(unescape(parts[0]).alias("role"), unescape(parts[1]).alias("text"))

    loss = F.transform("targets", lambda t: unescape(F.substr("formatted", (t["start"] + 1).cast("int"), (t["end"] - t["start"]).cast("int"))))
    return windows.select("conv_id", "span", F.transform(added, turn).alias("turns"), F.array_join(loss, "").alias("loss"), F.length("formatted").cast("long").alias("chars"))


def digests(windows: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its windows."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    got = read_windows(windows).select("conv_id", "span", F.size("turns").cast("long").alias("n"), told.alias("told"), "loss", "chars")
    whole = got.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("span", "told", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    loss = F.array_join("w.loss", "")
    return whole.select("conv_id", "n_turns", F.sha2(F.array_join("w.told", ""), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_windows(rows))
