"""What a recogniser, renderer or store has to offer, and the ones registered by name."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import output_name
from ..operators.export import html_export
from .ingest import read_settings
from .store import read_documents, write_documents


class Vision(Protocol):
    name: str

    def analyse(self, regions: DataFrame, page: list[str], tie: str, page_w: float) -> DataFrame: ...


class Rules:
    """Page analysis by rules alone."""

    name = "heuristic"

    def analyse(self, regions: DataFrame, page: list[str], tie: str, page_w: float) -> DataFrame:
        from ..operators.vision import document_map

        return document_map(regions, page, tie, page_w)


class Renderer(Protocol):
    extension: str

    def render(self, blocks: DataFrame, use_translated: bool) -> DataFrame:
        """doc_id, content."""
        ...


class Html:
    extension = "html"

    def render(self, blocks: DataFrame, use_translated: bool) -> DataFrame:
        return html_export(blocks, use_translated).select("doc_id", F.col("html").alias("content"))


class Text:
    """Texts of the blocks in reading order, a line each."""

    extension = "txt"

    def render(self, blocks: DataFrame, use_translated: bool) -> DataFrame:
        from ..functions.text import effective_text

        text = effective_text(F.col("original_text"), F.col("translated_text"), use_translated)
        own = blocks.select("doc_id", F.struct("page_number", "reading_order", F.coalesce(text, F.lit("")).alias("t")).alias("b"))
        return own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["t"]), "\n").alias("content"))


VISION: dict[str, type] = {"heuristic": Rules}
RENDERERS: dict[str, type] = {"html": Html, "txt": Text}


def vision(name: str) -> Vision:
    """The named analyser; an unknown name gives the one by rules."""
    return VISION.get(name, Rules)()


def export(blocks: DataFrame, fmt: str, use_translated: bool = True, semantic: bool = True) -> DataFrame:
    """doc_id, filename, content of each document in a registered format."""
    if fmt not in RENDERERS:
        raise ValueError(f"no renderer for {fmt}: {', '.join(sorted(RENDERERS))}")
    r = RENDERERS[fmt]()
    name = output_name(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")), r.extension, use_translated, semantic)
    return r.render(blocks, use_translated).select("doc_id", name.alias("filename"), "content")


def write_outputs(outputs: DataFrame, path: str) -> None:
    """export() rows as JSON lines below path, one folder a format's extension."""
    outputs.withColumn("format", F.element_at(F.split("filename", r"\."), -1)).write.mode("overwrite").partitionBy("format").json(path)


class Store:
    """Documents, settings and cached results below one folder that all machines reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def documents(self) -> DataFrame:
        return read_documents(self.spark, f"{self.root}/documents")

    def save_documents(self, docs: DataFrame) -> None:
        write_documents(docs, f"{self.root}/documents")

    def document_ids(self) -> DataFrame:
        return self.documents().select("id").distinct().orderBy("id")

    def settings(self, schema: str, defaults: dict) -> dict:
        return read_settings(self.spark, f"{self.root}/settings.json", schema, defaults)

    def save_settings(self, values: dict) -> None:
        """One JSON object; a later call replaces it."""
        import json

        text = self.spark.createDataFrame([(json.dumps(values),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{self.root}/settings.json")

    def save_glossary(self, terms: DataFrame) -> None:
        """(term, translation) rows as one JSON map; glossaries are small and kept whole."""
        whole = terms.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("term", "translation")))).alias("value"))
        whole.coalesce(1).write.mode("overwrite").text(f"{self.root}/glossary")


def read_cache(spark: SparkSession, path: str, schema: str, stage: str) -> DataFrame:
    """Cached rows of a stage; values that do not parse count as absent, and so does a missing folder."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.parquet(path).where(F.col("stage") == stage)
    except AnalysisException:
        return spark.createDataFrame([], f"doc_id long, page_number int, hash string, value {schema}")
    parsed = rows.select("doc_id", "page_number", "hash", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("value"))
    return parsed.where("value is not null")
