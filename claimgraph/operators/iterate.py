"""Tables between the steps of operators: written to the shared folder, so lost executors cost no lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir.

    Where that is unset in local mode (tests, a notebook) a temporary folder is made, set as the
    checkpoint folder and removed at exit. A cluster without the setting is refused: its executors share no local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("claimgraph.scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("claimgraph.scratch", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Removes a query's shuffle files when it ends: a staged table never needs them again.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a Spark context: they need not see the driver's disk."""
    sc = spark.sparkContext
    if not getattr(sc, "_claimgraph_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        if os.path.isdir(root):  # else the workers' package came in an archive itself
            folder = tempfile.mkdtemp(prefix="claimgraph-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            sc.addPyFile(shutil.make_archive(f"{folder}/claimgraph", "zip", root, "claimgraph"))
        sc._claimgraph_shipped = True


#: Tables staged inside the open ``scratch`` blocks.
_OPEN: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[..., DataFrame]]:
    """Removes the tables staged inside the block when it ends, in success or failure. What it yields stages a result that stays; inside another
    block, until that one ends."""
    _OPEN.append([])

    def keep(df: DataFrame, name: str = "result") -> DataFrame:
        mine = _OPEN.pop()
        try:
            return staged(df, name)
        finally:
            _OPEN.append(mine)

    try:
        yield keep
    finally:
        unstage(*_OPEN.pop())


def staged(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/claimgraph/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(schema).parquet(path)
    out._staged_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def unstage(*frames: DataFrame | None) -> None:
    """Removes staged tables that nothing will read again."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
