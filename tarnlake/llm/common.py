"""Shared plumbing: the shared scratch folder, lineage cuts and column handling."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir.  Only a local session may leave it unset and gets a folder of its own;
    on a cluster, where that folder would be one machine's, it raises RuntimeError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        java = spark.sparkContext._jsc.sc().getCheckpointDir()
        if java.isDefined():
            found = java.get()
        elif spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            found = tempfile.mkdtemp(prefix="tarnlake-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_RUN = uuid.uuid4().hex


def _run_dir(spark: SparkSession) -> str:
    """The folder of this process's tables, removed when its JVM ends."""
    name = f"{shared_dir(spark)}/tables-{_RUN}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: lineage ends there, and a lost executor
    costs a reread instead of a recomputation.  The reread frame has no partitioning of its own, so a later
    join deals both of its sides anew and adaptive execution may split a skewed partition."""
    spark = df.sparkSession
    path = f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ... by position, so that no name of the input, twice or not, clashes with one of ours."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def importable(spark: SparkSession) -> None:
    """Put the folder that holds this package on the Python path of the workers, for sessions started elsewhere.
    On a cluster the package is installed or shipped with --py-files; the added folder is then merely absent."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


#: Rows and bytes of one Arrow batch.  A worker holds a batch or two at a time and an executor has a worker a core.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ARROW_ROWS and ARROW_BYTES where they are larger."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    digits = re.match(r"(\d+)b?$", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), re.I)
    if not digits or int(digits[1]) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def own_columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Select only what an operator reads, under names of its own, so that extra columns of the input, whatever
    they are called, never clash with what the operator adds."""
    importable(df.sparkSession)
    small_batches(df.sparkSession)
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in wanted.items()])


def uniform(*parts: Column | str, seed: int) -> Column:
    """A double in [0, 1) from the md5 of the parts: 52 bits, the same on every engine."""
    cols = [F.coalesce(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string"), F.lit("\u0000")) for p in parts]
    hexed = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *cols).cast("binary")), 1, 13)
    return F.conv(hexed, 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))
