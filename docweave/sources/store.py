"""Documents, settings, glossaries and stage caches as files that Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "struct<id:string,type:string,layout_type:string,x:double,y:double,width:double,height:double,reading_order:int,original_text:string,translated_text:string,confidence:double,translation_confidence:double,is_edited:boolean,metadata:map<string,string>>"
DOCUMENT = f"schema_version string, id string, name string, status string, mime_type string, file_size long, pages array<struct<page_number:int,width:double,height:double,blocks:array<{BLOCK}>>>, warnings array<string>, timings map<string,double>, created_at timestamp, updated_at timestamp"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document a file; old versions are brought to the present one."""
    return spark.read.schema(DOCUMENT).json(path, multiLine=True).withColumn("schema_version", F.lit("2.0.0"))


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content", F.sha2("content", 256).alias("sha256"))


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """(term, translation) of a JSON map; a broken file is an empty glossary."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("term", "translation"))


def nest(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks and pages as one row a document with pages[].blocks[] in reading order."""
    fields = [c for c in blocks.columns if c not in ("doc_id", "page_number")]
    per = blocks.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("reading_order", *(c for c in fields if c != "reading_order")))).alias("blocks"))
    full = pages.join(per, ["doc_id", "page_number"], "left")
    return full.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_number", *(c for c in pages.columns if c not in ("doc_id", "page_number")), "blocks"))).alias("pages")).withColumn("page_count", F.size("pages"))


def unnest(docs: DataFrame, key: str = "id") -> DataFrame:
    page = docs.select(key, F.explode("pages").alias("p"))
    return page.select(key, "p.page_number", F.explode("p.blocks").alias("b")).select(key, "page_number", "b.*")
