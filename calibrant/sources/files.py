"""Sources and sinks: tolerant JSON lines, candidate columns, evolving metrics, resumable and merged outputs."""

from __future__ import annotations

import itertools
import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from calibrant.errors import StateError
from calibrant.functions.text import hash_answer
from calibrant.session import few, table
from calibrant.sources import versions

PROMPTS = "prompt string, response string, ground_truth string"


class NoRows(ValueError):
    """A source holds no valid row."""


def read_jsonl(spark: SparkSession, path: str, schema: str = PROMPTS, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """SRC-01: rows with both texts; blank and corrupt lines and null or empty texts are left out."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.where((F.col(prompt) != "") & (F.col(response) != ""))


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise NoRows("no valid row")
    return df


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, value): every line of the files with its number from 0, however many splits a file is read in.

    Lines are counted by split, and a split's first number is the sum of the counts before it in
    its file; only these counts, a row for each split, are shuffled, and the lines stay where they
    are read.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    raw = spark.read.option("lineSep", "\n").text(path).select(*split, "value", F.monotonically_increasing_id().alias("at"))
    counts = table(raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("low")), "splits")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    return raw.join(few(starts), ["file", "block"]).select("file", (F.col("at") + F.col("shift")).alias("idx"), "value")


def read_aligned(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-27: every line of the files with its number; a corrupt line is a null struct."""
    lines = numbered_lines(spark, path)
    return lines.select("file", "idx", F.from_json("value", schema).alias("row"), F.try_parse_json("value").isNull().alias("corrupt"))


def synthetic(spark: SparkSession, n: int, length: int, vocab: int, seed: int = 0) -> DataFrame:
    """SRC-02: seeded token ids; an even token is worth 1.0, an odd one -0.2."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(vocab)).cast("int"))
    return spark.range(n).select(F.col("id").alias("sample_id"), ids.alias("ids")).withColumn("rewards", F.transform("ids", lambda t: F.when(t % 2 == 0, F.lit(1.0)).otherwise(F.lit(-0.2))))


SOURCES: dict[str, Callable[..., DataFrame]] = {"jsonl": read_jsonl, "synthetic": synthetic}


def load(spark: SparkSession, kind: str, *args, **kw) -> DataFrame:
    """SRC-03."""
    if kind not in SOURCES:
        raise ValueError(f"unknown source type: {kind}")
    return SOURCES[kind](spark, *args, **kw)


def nested_chat(df: DataFrame) -> DataFrame:
    """SRC-04: single user messages with content and a ground truth."""
    m = F.col("prompt")[0]
    ok = (F.size("prompt") == 1) & (m["role"] == "user") & (m["content"] != "") & (F.col("reward_model.ground_truth") != "")
    return df.where(ok).select(m["content"].alias("prompt"), F.col("reward_model.ground_truth").alias("ground_truth"))


def first_of(df: DataFrame, candidates: list[str], alias: str) -> Column:
    """SRC-05: first non-null of the candidate columns that are there; fails if none is."""
    there = [c for c in candidates if c in df.columns]
    if not there:
        raise ValueError(f"none of {candidates} in {df.columns}")
    return F.coalesce(*(F.col(c) for c in there)).alias(alias)


@dataclass(frozen=True)
class DatasetSpec:
    path: str
    problem: list[str] = field(default_factory=lambda: ["problem", "question", "prompt"])
    answer: list[str] = field(default_factory=lambda: ["answer", "solution", "ground_truth"])
    extract: Callable[[Column], Column] = lambda c: c.cast("string")
    aliases: tuple[str, ...] = ()


class Registry:
    """SRC-06/07: datasets by name or alias, whatever the case."""

    def __init__(self, specs: dict[str, DatasetSpec]) -> None:
        self.specs = specs
        self.names = {a.lower(): n for n, s in specs.items() for a in (n, *s.aliases)}

    def resolve(self, name: str) -> str:
        if name.lower() not in self.names:
            raise KeyError(name)
        return self.names[name.lower()]

    def problems(self, spark: SparkSession, name: str) -> DataFrame:
        s = self.specs[self.resolve(name)]
        df = spark.read.parquet(s.path) if s.path.endswith(".parquet") else spark.read.json(s.path)
        return df.select(first_of(df, s.problem, "problem"), s.extract(first_of(df, s.answer, "answer")).alias("ground_truth"))


def hash_spec(path: str) -> DatasetSpec:
    return DatasetSpec(path, extract=hash_answer)


def read_results_tree(spark: SparkSession, root: str, schema: str, kind: str = "jsonl") -> DataFrame:
    """SRC-08: JSON lines below root, as root/stage/model/file or root/stage/model/step/file; the year is from the file's name. Lines that are no JSON are left out."""
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}").option("mode", "DROPMALFORMED").json(root)
    last = root.rstrip("/").rpartition("/")[2]
    parts = F.split(F.substring_index(F.col("_metadata.file_path"), f"/{last}/", -1), "/")
    step = F.when(F.size(parts) > 3, F.get(parts, F.lit(2)))
    return df.select("*", F.get(parts, F.lit(0)).alias("stage"), F.get(parts, F.lit(1)).alias("model"), step.alias("step"), F.nullif(F.regexp_extract(F.element_at(parts, -1), r"(20\d\d)", 1), F.lit("")).alias("year"))


def append_metrics(df: DataFrame, path: str) -> None:
    """SRC-11: append; columns may grow between appends."""
    df.write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def export_metrics(spark: SparkSession, path: str, out: str) -> None:
    """SRC-11: the metrics as CSV under one header that has every column that ever was."""
    read_metrics(spark, path).orderBy("step").write.option("header", "true").csv(out)


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: a metrics CSV: numbers where all values are, else text; a last line cut short by a crash, or any line of another width, is left out."""
    guessed = spark.read.option("header", "true").option("inferSchema", "true").option("mode", "DROPMALFORMED").csv(path).schema
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in guessed), StructField("_corrupt", StringType())])
    rows = spark.read.schema(schema).option("header", "true").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt")


def first_valid(spark: SparkSession, path: str, n: int, schema: str = PROMPTS, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """SRC-28: the first n valid rows in order of file and line; a sort with a limit needs no full sort."""
    ok = numbered_lines(spark, path).withColumn("row", F.from_json("value", schema)).where((F.col(f"row.{prompt}") != "") & (F.col(f"row.{response}") != ""))
    return ok.orderBy("file", "idx").limit(n).select("row.*")


def experiment_matrix(spark: SparkSession, axes: dict[str, list], base: dict | None = None) -> DataFrame:
    """UDF-05: every combination of some settings over a base, as rows of (name, config in JSON)."""
    rows = []
    for values in itertools.product(*axes.values()):
        picked = dict(zip(axes, values))
        config = json.loads(json.dumps(base or {}))
        for k, v in picked.items():
            set_dotted(config, k, v)
        rows.append(("-".join(f"{k.rsplit('.', 1)[-1]}={v}" for k, v in picked.items()), json.dumps(config, sort_keys=True)))
    return spark.createDataFrame(rows, "name string, config string")


def stop_if_poisoned(df: DataFrame, flag: str = "rollout/weight_sync_poisoned") -> DataFrame:
    """STM-13: metrics of a run whose weights may be out of step are not gone on with."""
    if flag in df.columns and not df.where(F.col(f"`{flag}`").cast("string").isin("true", "True", "1", "1.0")).isEmpty():
        raise StateError(f"{flag} is set: weights of the generator and the trainer may differ")
    return df


def phase_column(df: DataFrame) -> str | None:
    """SRC-12."""
    return next((c for c in ("pool", "phase", "stage", "type", "phase_type") if c in df.columns), None)


def truncate_at(df: DataFrame, step: int) -> DataFrame:
    """SRC-13: rows before a resume step; rows without a step stay."""
    return df.where(F.col("step").isNull() | (F.col("step") < step))


def truncate_metrics(spark: SparkSession, path: str, step: int) -> DataFrame:
    """SRC-13 on a table of versions: the full metrics are kept once under the resume step's name, and the cut ones become the newest version."""
    full, version = versions.newest(spark, path)
    backup = f"{path.rstrip('/')}_pre_resume_step{step}"
    if versions.newest_number(spark, backup) is None:
        versions.publish(full, backup)
    if version is not None:
        versions.publish(truncate_at(full, step), path)
    return versions.newest(spark, path)[0]


def write_cells(rows: DataFrame, path: str, keys: tuple[str, ...] = ("label", "dataset", "budget")) -> None:
    """SRC-14: JSON lines by cell."""
    rows.write.mode("append").partitionBy(*keys).json(path)


def append_missing(spark: SparkSession, rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """SRC-15: append what is not yet there; the number of samples must agree. Returns what was new."""
    try:
        done = spark.read.schema(rows.schema).parquet(path)
        done.isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = rows.limit(0)
    if "n_samples" in rows.columns and rows.select("n_samples").union(done.select("n_samples")).distinct().limit(2).count() > 1:
        raise ValueError("n_samples differs from what was written")
    new = rows.join(done.select(*keys), keys, "left_anti")
    new.write.mode("append").parquet(path)
    return new


def merge_shards(main: DataFrame, shards: DataFrame, key: str, value: str) -> DataFrame:
    """SRC-17: values of shards by index into the main rows; indexes outside it are ignored."""
    s = shards.select(key, F.col(value).alias("_new")).dropDuplicates([key])
    return main.join(s, key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def merge_summaries(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """SRC-18: summaries of sub-runs by name; corrupt ones are left out."""
    raw = spark.read.text(paths, wholetext=True).select(F.from_json("value", schema).alias("s"), F.try_parse_json("value").isNotNull().alias("ok"))
    return raw.where("ok").select("s.*")


def save_cache(support: DataFrame, path: str, meta: dict) -> None:
    """SRC-10: supports sorted by id, with their metadata."""
    support.withColumn("pairs", F.array_sort("pairs")).write.parquet(f"{path}/data")
    support.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").write.json(f"{path}/meta")


def load_cache(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/data").withColumn("pairs", F.array_sort("pairs")), json.loads(spark.read.json(f"{path}/meta").first()["meta"])


def latest_checkpoint(names: list[str]) -> str | None:
    """SRC-19: the name with the largest step."""
    steps = [(int(d), n) for n in names if (d := "".join(c for c in n.rpartition("-")[2] if c.isdigit()))]
    return max(steps)[1] if steps else None


def snapshot_config(config: dict, folder: str) -> str:
    """SRC-20."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "config.json")
    with open(path, "w") as f:
        json.dump(config, f, indent=2, sort_keys=True)
    return path


def parse_scalar(text: str):
    """STR-14: bool, int, float, tuple or text."""
    t = text.strip()
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    return tuple(parse_scalar(x) for x in t.strip("()[]").split(",") if x.strip()) if "," in t else t


def set_dotted(config: dict, key: str, value) -> dict:
    """SRC-23: a nested value by dotted key."""
    *path, last = key.split(".")
    at = config
    for p in path:
        at = at.setdefault(p, {})
    at[last] = value
    return config


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """SRC-21: a small result as text."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("—" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows)])
