"""Session helpers: shared folder, lineage cuts, shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: documents may be large, so batches stay small.
ARROW_ROWS = 256
#: A value of a key that holds more than this part of the rows of a join is dealt to slices.
SLICES = 1000
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in this process (tests) a temporary folder of this machine is
    set; on a cluster that would be an error, as executors write what the driver reads.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="treeloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def prepare(spark: SparkSession) -> SparkSession:
    """Makes a session ready for Arrow operators: small batches, and this package on every executor."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    if not getattr(sc, "_treeloom_shipped", False):
        top = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(prefix="treeloom-"), "treeloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, str(p.relative_to(top.parent)))
        sc.addPyFile(path)
        sc._treeloom_shipped = True
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/treeloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if not _tables:
        atexit.register(_remove_all)
    _tables.append((spark, path))
    return path


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: later steps don't recompute it,
    and a lost executor costs no more than its running tasks."""
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, deal: list[str | Column], how: str = "inner") -> DataFrame:
    """rows joined with groups, a table with one row for each value of keys and the number of its rows in column
    size, which goes. A value that holds more than one part in SLICES of the rows that groups counts is dealt to
    slices by a hash of deal, columns of rows, so that no value burdens a task. There are fewer than SLICES such
    values, whatever the tables' size: the hashes of their keys are part of the plan, and both sides tell by them
    which values have slices. A value with the hash of a hot one is sliced like it, which changes no result.
    """
    total = groups.agg(F.sum(size)).first()[0] or 1
    slices = F.ceil(F.col(size) * SLICES / F.lit(total))
    of_number: dict[int, list[int]] = {}
    for key, n in groups.filter(F.col(size) * SLICES > total).select(F.xxhash64(*keys), slices).collect():
        of_number.setdefault(1 << (int(n) - 1).bit_length(), []).append(key)
    number = F.lit(1)
    for n, hashes in sorted(of_number.items()):
        number = F.when(F.col("_key").isin(hashes), F.lit(n)).otherwise(number)
    number = number.cast("long")
    rows = rows.withColumn("_key", F.xxhash64(*keys)).withColumn("_slice", F.pmod(F.xxhash64(*deal), number)).drop("_key")
    groups = groups.withColumn("_key", F.xxhash64(*keys)).withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), number - 1))).drop(size, "_key")
    return rows.hint("merge").join(groups, [*keys, "_slice"], how).drop("_slice")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_all() -> None:
    for spark, path in _tables:
        try:
            drop_path(spark, path)
        except Exception:  # the session has gone already
            return
