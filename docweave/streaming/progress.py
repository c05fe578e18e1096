"""Progress of documents as a stream: the latest event of each, and the share done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stages in order.
STAGES = ("preparing", "normalizing", "layout_detection", "vision_understanding", "ocr", "building_model", "translating", "layout_solver", "review", "reconstructing", "verification", "complete")
SCHEMA = "document_id long, stage string, elapsed_ms long, progress double, message string"


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def latest(events: DataFrame) -> DataFrame:
    """Latest event of each document; works on a batch and, in update mode, on a stream."""
    top = F.max(F.struct("elapsed_ms", "stage", "progress")).alias("last")
    return events.groupBy("document_id").agg(top, F.count("*").alias("events")).select("document_id", "last.stage", "last.elapsed_ms", "last.progress", "events")


def paging_progress(done, total):
    return 0.1 + done / total * 0.5


def stage_ordinal(stage):
    """Place of a stage, -1 if unknown."""
    return F.array_position(F.array(*map(F.lit, STAGES)), stage) - 1
