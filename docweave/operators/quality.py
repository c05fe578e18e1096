"""Quality scores, gates, verification and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERFLOW = 1.15


def overflows(text: Column, limit: Column) -> Column:
    return F.coalesce((F.coalesce(limit, F.lit(0)) > 0) & (F.length(text) > limit * OVERFLOW), F.lit(False))


def quality_scores(documents: DataFrame, blocks: DataFrame, residual: Column | float = 0.0) -> DataFrame:
    """One row a document; blocks: confidence, translation_confidence, translated_text, is_edited,
    max_chars. A document without blocks scores 0, with residual 1."""
    some = F.coalesce(F.col("translated_text"), F.lit("")) != ""
    per = blocks.groupBy("doc_id").agg(
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.85)), 3).alias("ocr_confidence"), F.round(F.coalesce(F.avg("translation_confidence"), F.lit(1.0)), 3).alias("translation_qa"),
        F.sum(overflows(F.col("translated_text"), F.col("max_chars")).cast("int")).alias("overflow_count"), F.count("*").alias("blocks_total"),
        F.sum(some.cast("int")).alias("blocks_translated"), F.sum(F.col("is_edited").cast("int")).alias("blocks_edited"))
    out = documents.select("doc_id").join(per, "doc_id", "left")
    none = F.col("blocks_total").isNull()
    residual = F.lit(residual) if not isinstance(residual, Column) else residual
    return out.select(
        "doc_id", F.when(none, 0.0).otherwise(F.col("ocr_confidence")).alias("ocr_confidence"), F.when(none, 0.0).otherwise(F.col("translation_qa")).alias("translation_qa"),
        F.coalesce("overflow_count", F.lit(0)).alias("overflow_count"), "blocks_total", "blocks_translated", "blocks_edited", F.when(none, 1.0).otherwise(residual).alias("source_text_residual"),
        F.when(~none, F.round(F.greatest(F.lit(0.0), 1 - residual - F.col("overflow_count") * 0.05), 3)).alias("layout_quality"))


def gates(scores: DataFrame) -> DataFrame:
    """scores with warnings; a missing layout quality counts as 0."""
    checks = [(F.col("source_text_residual") > 0.15, "residual"), (F.col("overflow_count") > 0, "overflow"), (F.coalesce("layout_quality", F.lit(0.0)) < 0.7, "layout")]
    return scores.withColumn("warnings", F.array_compact(F.array(*(F.when(c, F.lit(w)) for c, w in checks))))


def verify_pages(blocks: DataFrame, residual: Column | float = 0.0) -> DataFrame:
    """overflow_count, layout_score and acceptable of each page."""
    residual = F.lit(residual) if not isinstance(residual, Column) else residual
    per = blocks.groupBy("doc_id", "page_number").agg(F.sum(overflows(F.col("translated_text"), F.col("max_chars")).cast("int")).alias("overflow_count"))
    return per.withColumn("layout_score", F.round(F.greatest(F.lit(0.0), 1 - F.col("overflow_count") * 0.08), 3)).withColumn("acceptable", (residual <= 0.15) & (F.col("overflow_count") == 0))


def shrunk_font(font_size: Column, overflow_count: Column, passes: int = 1) -> Column:
    """Net effect of verification: each outer pass takes 8 percent off, to 7 at least."""
    out = font_size.cast("double")
    for _ in range(passes):
        out = F.when(overflow_count > 0, F.greatest(F.lit(7.0), out * 0.92)).otherwise(out)
    return out


def residual_score(rects: DataFrame, keys: list[str]) -> DataFrame:
    """Area-weighted mean score of rects (score, area)."""
    w = F.greatest(F.lit(1), F.col("area"))
    return rects.groupBy(*keys).agg((F.sum(F.col("score") * w) / F.sum(w)).alias("residual"))


def stage_timings(events: DataFrame, doc: str, stage: str, elapsed: str) -> DataFrame:
    return events.groupBy(doc, stage).agg(F.count("*").alias("runs"), F.round(F.sum(elapsed), 3).alias("total_ms"))


def timing_map(events: DataFrame, doc: str, stage: str, elapsed: str, hit: str) -> DataFrame:
    """One row a document: timings (map of stage to the sum of its times) and cache_hits."""
    per = events.groupBy(doc, stage).agg(F.round(F.sum(elapsed), 3).alias("ms"), F.sum(F.col(hit).cast("int")).alias("hits"))
    return per.groupBy(doc).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(stage, "ms")))).alias("timings"), F.sum("hits").alias("cache_hits"))


def add_timings(old: Column, new: Column) -> Column:
    """Maps of times added up by stage."""
    none = F.create_map().cast("map<string,double>")
    return F.map_zip_with(F.coalesce(old, none), F.coalesce(new, none), lambda _, a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def more_warnings(old: Column, *new: Column) -> Column:
    """Arrays of warnings one after the other; a null one adds nothing."""
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(old, none), *(F.coalesce(n, none) for n in new))


def translation_warnings(stats: DataFrame) -> DataFrame:
    """stats (total, translated, unchanged, failed) with warnings in a fixed order."""
    t, d, u, f = (F.col(c) for c in ("total", "translated", "unchanged", "failed"))
    return stats.withColumn("warnings", F.array_compact(F.array(
        F.when(f > 0, F.concat(F.lit("Translation failed: "), f.cast("string"), F.lit(" blocks"))), F.when((u == t) & (t > 0), F.lit("all unchanged")).when(d < t, F.lit("some untranslated")))))


def drop_stale(warnings: Column, prefix: str = "Translation failed:") -> Column:
    return F.filter(warnings, lambda w: ~F.startswith(w, F.lit(prefix)))
