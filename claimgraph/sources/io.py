"""Sources and sinks (S1-S6): XML and JSON corpora, graph documents, run-scoped snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PUBLICATIONS

TEXT = "struct<_VALUE:string,_Label:string>"
ARTICLE = (
    "MedlineCitation struct<PMID:struct<_VALUE:string>,Article:struct<ArticleTitle:string,"
    f"Abstract:struct<AbstractText:array<{TEXT}>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string>>>,"
    "Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,"
    "PublicationTypeList:struct<PublicationType:array<struct<_VALUE:string>>>>,"
    "MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string>>>>>,"
    "PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>"
)


def read_publications_xml(spark: SparkSession, path: str) -> DataFrame:
    """Bulk citation XML; labelled abstract parts as "LABEL: text", the year from MedlineDate where there is no Year. Broken records go (``quarantine``)."""
    return checked_publications_xml(spark, path)[0]


def checked_publications_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S1 with what is wrong: the publications, and (file, reason, pmid, record) of records that can't be read or have no pmid."""
    # record by record: text is split at the closing tags, so that a broken record spoils no other and files can be split
    end = "</PubmedArticle>"
    text = spark.read.option("lineSep", end).text(path).withColumn("file", F.col("_metadata.file_path"))
    text = text.select("file", F.concat(F.regexp_extract("value", r"(?s)<PubmedArticle(?=[\s>/]).*", 0), F.lit(end)).alias("x_")).where(F.col("x_") != end)
    options = {"rowTag": "PubmedArticle", "attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    raw = text.select("file", F.from_xml("x_", f"{ARTICLE}, {CORRUPT} string", options).alias("r")).select("file", "r.*")
    a = F.col("MedlineCitation.Article")
    part = lambda p: F.when(p["_Label"].isNotNull(), F.concat(p["_Label"], F.lit(": "), p["_VALUE"])).otherwise(p["_VALUE"])
    date = a["Journal"]["JournalIssue"]["PubDate"]
    ids = F.filter("PubmedData.ArticleIdList.ArticleId", lambda i: i["_IdType"] == "doi")
    rows = raw.select(
        F.col("MedlineCitation.PMID._VALUE").alias("pmid"),
        a["ArticleTitle"].alias("title"),
        F.array_join(F.transform(a["Abstract"]["AbstractText"], part), " ").alias("abstract"),
        F.transform(a["AuthorList"]["Author"], lambda x: F.concat_ws(" ", x["ForeName"], x["LastName"])).alias("authors"),
        a["Journal"]["Title"].alias("journal"),
        F.coalesce(date["Year"], F.substring(date["MedlineDate"], 1, 4)).try_cast("int").alias("year"),
        F.try_element_at(ids, F.lit(1))["_VALUE"].alias("doi"),
        F.transform("MedlineCitation.MeshHeadingList.MeshHeading", lambda m: m["DescriptorName"]["_VALUE"]).alias("mesh_terms"),
        F.transform(a["PublicationTypeList"]["PublicationType"], lambda t: t["_VALUE"]).alias("publication_types"),
        "file",
        CORRUPT,
    )
    return _checked(rows)


#: Column of a record that can't be read.
CORRUPT = "_corrupt_record"


def _checked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be read and have a pmid; and the others with their reason."""
    reason = F.when(F.col(CORRUPT).isNotNull(), "corrupt record").when(F.coalesce(F.trim("pmid"), F.lit("")) == "", "no pmid")
    told = rows.withColumn("reason", reason)
    bad = told.where("reason is not null")
    return told.where("reason is null").drop("file", "reason", CORRUPT), bad.select("file", "reason", "pmid", F.coalesce(CORRUPT, F.to_json(F.struct(*(c for c in rows.columns if c not in ("file", CORRUPT))))).alias("record"))


def quarantine_report(quarantined: DataFrame) -> DataFrame:
    """C9 for records that never became publications: how many of each reason, and of how many files."""
    return quarantined.groupBy("reason").agg(F.count("*").alias("records"), F.count_distinct("file").alias("files"))


def read_publications(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, a JSON list of publications, or one document with a ``publications`` list. Broken documents and records go (``quarantine``)."""
    return checked_publications(spark, path)[0]


def checked_publications(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S2 with what is wrong: the publications, and (file, reason, pmid, record) of documents that can't be read and records without a pmid."""
    if path.rstrip("/").endswith(".parquet"):
        raw = spark.read.parquet(path).withColumns({"file": F.col("_metadata.file_path"), CORRUPT: F.lit(None).cast("string")})
        return _checked(raw)
    reader = spark.read.option("columnNameOfCorruptRecord", CORRUPT).schema(f"{PUBLICATIONS}, publications array<struct<{_as_struct(PUBLICATIONS)}>>, {CORRUPT} string")
    raw = reader.json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    wrapped = raw.where(f"publications is not null and {CORRUPT} is null").select("file", CORRUPT, F.inline("publications"))
    alone = raw.where(f"publications is null or {CORRUPT} is not null").drop("publications")
    return _checked(alone.unionByName(wrapped))


def _as_struct(ddl: str) -> str:
    return ",".join(f.strip().replace(" ", ":", 1) for f in ddl.split(", "))


EDGE_DOC = (
    "claim_id:string,source:string,target:string,relation:string,primary_relation:string,relations:array<string>,pmid:string,pmids:array<string>,"
    "confidence:double,evidence_strength:string,provenance_type:string,source_type:string,target_type:string,evidence_sentences:map<string,string>,"
    "source_refs:array<struct<pmid:string,source_sentence:string>>"
)
NODE_DOC = "id:string,type:string,pmid_count:int,pmids:array<string>,edge_count:int,provenance_type:string"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S3: graph documents as (nodes, edges, meta); older shapes get their relations, pmids and sentences from what they have."""
    schema = f"nodes array<struct<{NODE_DOC}>>, edges array<struct<{EDGE_DOC}>>, metadata struct<disease:string,version:string,updated:string,node_count:int,edge_count:int,quality_contract:string>"
    raw = spark.read.schema(schema).json(path, multiLine=True).withColumn("graph_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.json)?$", 1))
    nodes = raw.select("graph_id", F.inline("nodes"))
    edges = raw.select("graph_id", F.inline("edges"))
    relation = F.coalesce("relation", "primary_relation", F.try_element_at("relations", F.lit(1)))
    refs = F.transform(F.map_entries("evidence_sentences"), lambda e: F.struct(e["key"].alias("pmid"), e["value"].alias("source_sentence")))
    edges = edges.withColumns({"relation": relation, "relations": F.coalesce("relations", F.array(relation)), "pmids": F.coalesce("pmids", F.array_compact(F.array("pmid"))), "source_refs": F.coalesce("source_refs", refs)})
    meta = raw.select("graph_id", "metadata.*", F.size("nodes").alias("counted_nodes"), F.size("edges").alias("counted_edges"))
    return nodes, edges.drop("primary_relation", "pmid", "evidence_sentences"), meta


def graph_catalog(meta: DataFrame) -> DataFrame:
    """One row per stored graph; stated counts first, else the counted ones."""
    return meta.select("graph_id", "disease", F.coalesce("node_count", "counted_nodes").alias("node_count"), F.coalesce("edge_count", "counted_edges").alias("edge_count"), "version", "updated")


def write_graph(table: DataFrame, base: str, name: str, scope: str, run_id: str) -> None:
    """An immutable run-scoped snapshot of one table; only this run's partition is written."""
    write_graphs(table.withColumns({"scope": F.lit(scope), "run_id": F.lit(run_id)}), base, name)


def write_graphs(table: DataFrame, base: str, name: str) -> None:
    """Snapshots of any number of runs (scope, run_id) in one write; only their partitions are replaced."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scope", "run_id").parquet(f"{base}/{name}")


def latest_graph(table: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each scope's latest snapshot by (updated, run_id), as a semi-join on the catalog (scope, run_id, updated)."""
    last = catalog.groupBy("scope").agg(F.max_by("run_id", F.struct("updated", "run_id")).alias("run_id"))
    return table.join(last, ["scope", "run_id"], "left_semi")
