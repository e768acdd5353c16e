"""A graph kept as facts in buckets, merged run by run.

Layout under ``base``: ``facts/run=<run>/bucket=<n>`` holds the facts that a run added or compacted, ``live/version=<n>`` which
(run, bucket) make up a version. A merge writes the new claims' facts into the buckets that they touch and a new version; it reads no old fact.
Reading folds the live facts; asking for what a run changed reads its buckets alone. Buckets of many runs are folded into one by
``compact``. A version appears with its last file, so a reader sees the old one or the new one, and a failed merge that is run again overwrites its own
files. Two writers at once are not provided for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import counted_edges, counted_nodes, edge_facts, fact_parts, folded
from ..schemas import CLAIMS

BUCKETS = 64


def bucket_of(source: str = "source", target: str = "target", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(source, target), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def live(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """(run, bucket, version) of a version, by default the latest; at most buckets x runs since the last compaction."""
    kinds = "run string, bucket int, version int"
    if not _exists(spark, f"{base}/live"):
        return spark.createDataFrame([], kinds)
    table = spark.read.schema(kinds).parquet(f"{base}/live")
    of = table.agg(F.max("version")) if version is None else None
    return table.where(F.col("version") == (version if version is not None else of.first()[0]))


def _commit(spark: SparkSession, base: str, rows: list[tuple[str, int]], version: int) -> None:
    spark.createDataFrame(sorted(rows), "run string, bucket int").coalesce(1).write.mode("overwrite").parquet(f"{base}/live/version={version}")


def _write(parts: DataFrame, base: str, run: str, buckets: int) -> list[tuple[str, int]]:
    """Folds rows of one run and writes them by bucket; the (run, bucket) written. They are dealt to the buckets before they are folded there: one shuffle."""
    spark = parts.sparkSession
    path = f"{base}/facts/run={run}"
    folded(parts.withColumn("bucket", bucket_of(buckets=buckets)).repartition("bucket"), "bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)
    return [(run, r.bucket) for r in spark.read.parquet(path).select("bucket").distinct().collect()]


def merge_run(spark: SparkSession, base: str, run: str, claims: DataFrame, buckets: int = BUCKETS) -> int:
    """Adds a run's claims to the graph and returns the new version. A run that is merged again replaces itself."""
    now = live(spark, base).collect()
    version = max((r.version for r in now), default=0) + 1
    added = _write(fact_parts(claims), base, run, buckets)
    _commit(spark, base, [(r.run, r.bucket) for r in now if r.run != run] + added, version)
    return version


def _stored(spark: SparkSession, base: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The facts of a version as its runs wrote them; ``buckets`` reads their files only. None without any."""
    rows = [(r.run, r.bucket) for r in live(spark, base, version).collect() if buckets is None or r.bucket in set(buckets)]
    return spark.read.parquet(*(f"{base}/facts/run={run}/bucket={bucket}" for run, bucket in rows)) if rows else None


def _by_pair(stored: DataFrame) -> DataFrame:
    """Stored facts folded where their pair is dealt to, as in the buckets: edges are then counted in place."""
    return folded(stored.repartition("source", "target"))


def read_facts(spark: SparkSession, base: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The facts of a version, folded; ``buckets`` reads their files only."""
    stored = _stored(spark, base, version, buckets)
    return edge_facts(spark.createDataFrame([], CLAIMS)) if stored is None else _by_pair(stored)


def changed_edges(spark: SparkSession, base: str, run: str) -> DataFrame:
    """The edges that a run added to or made, as they stand in the latest version: its buckets are read, and nothing else."""
    mine = [r.bucket for r in live(spark, base).where(F.col("run") == run).collect()]
    if not mine:
        return counted_edges(read_facts(spark, base, buckets=[]))
    keys = spark.read.parquet(*(f"{base}/facts/run={run}/bucket={b}" for b in mine)).select("source", "target").distinct()
    return counted_edges(_by_pair(_stored(spark, base, buckets=mine).join(keys, ["source", "target"], "left_semi")))


def read_store(spark: SparkSession, base: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a version, in counts."""
    facts = read_facts(spark, base, version)
    return counted_nodes(facts), counted_edges(facts)


def compact(spark: SparkSession, base: str, run: str, most: int = 8, buckets: int = BUCKETS) -> int:
    """Folds the buckets that more than ``most`` runs make up into one run each, as a new version; others stay as they are."""
    now = live(spark, base).collect()
    version = max((r.version for r in now), default=0)
    runs: dict[int, int] = {}
    for r in now:
        runs[r.bucket] = runs.get(r.bucket, 0) + 1
    many = [b for b, n in runs.items() if n > most]
    if not many:
        return version
    made = _write(_stored(spark, base, version, many), base, run, buckets)
    _commit(spark, base, [(r.run, r.bucket) for r in now if r.bucket not in set(many)] + made, version + 1)
    return version + 1

