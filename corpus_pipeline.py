"""From documents to packed training sequences: five stages, each written and reread.

1. toxicity: rows scored 0.7 or more go. 2. line dedup: recurring lines are taken out of the
texts (n_chars follows). 3. near-dedup: one document of each group of near copies stays.
4. decontamination: documents that hold a benchmark item go. 5. packing: pieces with their
sequence and offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm._common import forget, mark, materialise, table
from docweave.llm.decontam import decontaminate
from docweave.llm.linededup import line_dedup
from docweave.llm.neardup import near_duplicates
from docweave.llm.packing import pack, token_pieces
from docweave.llm.toxicity import toxicity_scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without rows scored 0.7 or more. Null, empty and wordless texts have no evidence and
    stay; repeated rows have one score, so all stay or go; an empty table gives an empty one. A
    column of any name is passed through, score too."""
    own = docs.select(F.struct(*docs.columns).alias("docweave_row"), "doc_id", "text")
    return toxicity_scores(own, table(spark, sf_dir, "labels")).where("score < 0.7").select("docweave_row.*")


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with recurring lines out of text; no row goes. n_chars, where there is one, follows a
    changed text. A null text stays null, one of recurring lines only becomes empty; repeated rows
    count as one document and change alike; columns of any other name are passed through."""
    own = docs.select("doc_id", "text", F.struct(*docs.columns).alias("docweave_row"))
    row = F.col("docweave_row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.col("n_dropped") > 0, length).otherwise(F.col("docweave_row.n_chars")))
    return line_dedup(own).select(row.alias("docweave_row")).select("docweave_row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the least doc_id of each group of near copies, and all that are linked with
    nothing: null and empty texts, rows without an id. Of a row that comes twice one stays."""
    found = near_duplicates(docs)
    out = docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    ids = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    return out.dropDuplicates(docs.columns) if ids.limit(1).count() else out  # a row that comes twice is a copy too


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without rows that hold a benchmark item. Null and empty texts hold none; repeated rows
    stay or go alike; an empty benchmark drops nothing; columns of any name are passed through."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows of docs (null text: empty) with sequence and offset; other columns are
    left out. Repeated rows are packed as often as they come; an empty table gives no piece."""
    import public_tokenizers

    return pack(materialise(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "pieces"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_recurring_lines), ("minhash_near_dedup", keep_one_of_each), ("decontamination", drop_contaminated), ("packing", pack_sequences)]

#: Viterbi decoding, sketches and tokenisation have no SQL form; tests/llm holds a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, start = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        forget(start, keep=docs)  # a stage's own tables, and its input
    return docs
