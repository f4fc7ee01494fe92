"""Session factory and the few settings that every plan relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "millrace", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with UTC and adaptive execution; on a cluster the caller brings its own."""
    n = cores or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where it is unset (tests on one machine) a temporary folder is set once.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not current:
            if not sc.master.startswith("local["):
                raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
            current = tempfile.mkdtemp(prefix="millrace-checkpoint-")
        sc.setCheckpointDir(current)
    return sc._jsc.sc().getCheckpointDir().get()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, clean: bool = False) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and reads it back without its lineage.

    With ``clean`` the shuffle files that made it are removed at once and not when the driver happens to
    collect its garbage. They serve this step alone then: what else is built on the same frames shuffles again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not clean:
        return df.checkpoint(eager=True)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where a scan gives fewer parts than there are cores, for steps that cost much per row.

    That is so for a table in a few small files only: with as many parts as cores, or behind a shuffle, ``df`` comes back as it is.
    """
    plan = df._jdf.queryExecution().executedPlan()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" or plan.execute().getNumPartitions() * 2 > cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
