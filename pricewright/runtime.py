"""Sessions, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}
_SHIPPED: set[str] = set()


def session(app: str = "pricewright", cpus: int | str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own."""
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    home = Path(__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="pricewright-"), "pricewright.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(home.rglob("*.py")):
            z.write(f, f"{home.name}/{f.relative_to(home)}")
    spark.sparkContext.addPyFile(archive)


def arrow_map(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInArrow with this package on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def spread(df: DataFrame) -> DataFrame:
    """The rows over enough tasks for work that costs much CPU per row. Input
    that comes in too few splits is redistributed, which shuffles it once; input
    of two splits a core or more never is. Results don't depend on it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(4 * cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is
    unset on one machine (tests) a folder of this process. On a cluster without
    the setting there is none, and that is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="pricewright-")
    return _OWN_DIR[app]


def finished(spark: SparkSession, path: str, table_name: str) -> list[int]:
    """Numbers of the complete versions v0, v1, ... of a table under a path. A
    folder that isn't there has none; any other failure to look is raised."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/{table_name}")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = []
    for f in fs.listStatus(root):
        name = f.getPath().getName()
        if f.isDirectory() and name[:1] == "v" and name[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")):
            found.append(int(name[1:]))
    return sorted(found)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table with all in it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder, so that a lost
    executor costs no more than the work since the cut."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the unit of parallelism operators plan for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
