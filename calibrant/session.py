"""Session helpers shared by the whole library."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = Path(__file__).resolve().parent


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("calibrant")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Rows an Arrow batch holds where nobody set their number, 10,000 included; whole texts in batches of 10,000 (the default) fill a small executor.
ARROW_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, and keep Arrow batches small unless the session sets their size."""
    sc = spark.sparkContext
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(ARROW_ROWS))
    if getattr(sc, "_calibrant_shipped", False):
        return
    out = Path(tempfile.mkdtemp()) / "calibrant_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, f"calibrant/{p.relative_to(_ROOT).as_posix()}")
    sc.addPyFile(str(out))
    sc._calibrant_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    sc = spark.sparkContext
    got = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not got:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = getattr(sc, "_calibrant_shared", None) or tempfile.mkdtemp(prefix="calibrant-")
        sc._calibrant_shared = got
        if "://" not in got:
            got = f"file://{os.path.abspath(got)}"
    return got.rstrip("/")


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/calibrant/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a side of a join may have to be broadcast.
FEW_ROWS = 100_000


def few(df: DataFrame, limit: int = FEW_ROWS) -> DataFrame:
    """Mark df for broadcast if it has few rows; else it is joined by shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
