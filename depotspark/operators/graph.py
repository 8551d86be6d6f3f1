"""Scratch tables that cut lineage, scopes that delete them, and connected components by repeated minimum labels."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local = threading.local()


def _scopes() -> list[list[str]]:
    """Paths of the scratch tables of each open scope of this thread, the innermost last; the first is that of no scope."""
    if not hasattr(_local, "scopes"):
        _local.scopes = [[]]
    return _local.scopes


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="depotspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame, *by: str) -> DataFrame:
    """A Parquet table in the shared folder, with a folder for each value of `by`, read back; later reads prune its columns and know its size. It belongs to the innermost scope."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    _scopes()[-1].append(path)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what cut_lineage() writes inside the block when it ends, also after a failure. Nothing that reads those tables may leave the block: see settled."""
    mine: list[str] = []
    _scopes().append(mine)
    try:
        yield
    finally:
        _scopes().pop()
        delete(spark, mine)


def settled(spark: SparkSession, make: Callable[[], DataFrame | tuple[DataFrame, ...]]) -> DataFrame | tuple[DataFrame, ...]:
    """make()'s result as tables of the scope around; the scratch tables that it took are deleted. A frame that is a scratch table itself is handed on as it is."""
    with scratch(spark):
        out = make()
        many = out if isinstance(out, tuple) else (out,)
        done = tuple(x if getattr(x, "_scratch", None) in _scopes()[-1] else cut_lineage(x) for x in many)
        for x in done:
            _scopes()[-1].remove(x._scratch)
            _scopes()[-2].append(x._scratch)
    return done if isinstance(out, tuple) else done[0]


def disown(df: DataFrame) -> str:
    """The path of a scratch table, which from here on belongs to the caller instead of a scope."""
    for scope in _scopes():
        if df._scratch in scope:
            scope.remove(df._scratch)
    return df._scratch


def release_loose(spark: SparkSession) -> None:
    """Deletes the scratch tables that this thread wrote outside any scope, once everything that reads them is done."""
    loose = _scopes()[0]
    delete(spark, loose)
    loose.clear()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id), edges (a, b) -> id, component: the smallest id reachable. Labels jump along their own labels, so rounds grow with the logarithm of a path."""
    spark = nodes.sparkSession
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(nodes.select("id").distinct().withColumn("component", F.col("id")))
    while True:  # labels fall until each component has one
        near = both.join(labels.toDF("b", "c"), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        new = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("c", "component")).alias("component"))
        jump = new.toDF("component", "root")
        new = cut_lineage(new.join(jump, "component", "left").select("id", F.least("component", F.coalesce("root", "component")).alias("component")))
        moved = new.join(labels.toDF("id", "old"), "id").where("component <> old").limit(1).count()
        delete(spark, [disown(labels)])
        labels = new
        if not moved:
            delete(spark, [disown(both)])
            return labels
