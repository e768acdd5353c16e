"""C15 kept: an inverted index of a corpus, bucketed by term, that searches read instead of the texts.

``base/bucket=<n>`` holds the postings (term, pmid, year) of the terms of one bucket, sorted by term, so that a search opens the files of its terms'
buckets alone and skips their other row groups. Postings of a frequent term are rows over many files, never one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.corpus import matching_documents, search_terms

BUCKETS = 256
#: Bytes of a term, a-z, 0-9 and the hyphen; and how many texts are cut at once.
TERM, STEP = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz0123456789-")), 400


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def index_terms(pubs: DataFrame) -> DataFrame:
    """(pmid, year, term): what ``text_terms`` gives, but for the empty term; the texts of a batch are cut at once and their terms compared as numbers."""
    texts = pubs.select("pmid", "year", F.lower(F.concat_ws(" ", "title", "abstract")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, STEP):
                batch = whole.slice(low, STEP)
                text = batch.column(2).cast(pa.large_binary())
                _, ends, data = text.buffers()
                ends = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
                values = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
                ends = ends - ends[0]
                inside = TERM[values]
                start = inside.copy()
                start[1:] &= ~inside[:-1]
                cuts = ends[:-1][ends[:-1] < len(values)]
                start[cuts] = inside[cuts]  # a text starts a term of its own
                starts = np.flatnonzero(start)
                if not len(starts):
                    continue
                places = np.append((np.cumsum(inside) - 1)[starts], np.count_nonzero(inside))
                terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(values[inside])]).dictionary_encode()
                wide = len(terms.dictionary)
                each = np.unique((np.searchsorted(ends, starts, side="right") - 1) * wide + terms.indices.to_numpy())
                of = pa.array(each // wide)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), terms.dictionary.take(pa.array(each % wide)).cast(pa.string())], ["pmid", "year", "term"])

    return texts.mapInArrow(run, texts.select("pmid", "year", F.col("text").alias("term")).schema)


def write_index(pubs: DataFrame, base: str, buckets: int = BUCKETS, mode: str = "overwrite") -> None:
    """Writes the postings of ``pubs`` (pmid, title, abstract, year); ``append`` adds those of new documents."""
    rows = index_terms(pubs).withColumn("bucket", _bucket(buckets))
    # a frequent term's postings are dealt over four tasks
    rows = rows.repartition("bucket", F.pmod(F.xxhash64("pmid"), F.lit(4))).sortWithinPartitions("bucket", "term", F.desc("year"), "pmid")
    rows.write.mode(mode).option("compression", "zstd").partitionBy("bucket").parquet(base)


def read_postings(spark: SparkSession, base: str, strategies: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(pmid, year, term) of the buckets that the strategies' terms lie in; the numbers of these buckets come to the driver."""
    asked = strategies.select(F.explode(F.flatten("groups")).alias("term")).select(_bucket(buckets).alias("b")).distinct()
    wanted = sorted(r.b for r in asked.collect())
    return spark.read.parquet(base).where(F.col("bucket").isin(wanted)).select("pmid", "year", "term")


def search_index(spark: SparkSession, base: str, strategies: DataFrame, per_query: int = 25, cap: int = 120, pages: int = 1, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """What ``search_corpus`` gives, from the index."""
    return search_terms(read_postings(spark, base, strategies, buckets), strategies, per_query, cap, pages)


def next_page(spark: SparkSession, base: str, strategies: DataFrame, cursor: DataFrame | None = None, per_query: int = 25, buckets: int = BUCKETS) -> DataFrame:
    """(strategy, year, pmid, rank): each strategy's next documents by year and number after its ``cursor`` (strategy, year, pmid; the last row of the page before;
    none: from the first on)."""
    found = matching_documents(read_postings(spark, base, strategies, buckets), strategies).withColumn("no_", F.col("pmid").cast("long"))
    if cursor is not None:
        at = cursor.select("strategy", F.col("year").alias("y_"), F.col("pmid").cast("long").alias("p_"))
        found = found.join(at, "strategy", "left").where("y_ is null or year < y_ or (year = y_ and no_ > p_)")
    by = Window.partitionBy("strategy").orderBy(F.desc("year"), "no_")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= per_query).select("strategy", "year", "pmid", "rank")
