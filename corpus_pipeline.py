"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage but the last returns the columns of ``documents``.  Toxic documents
go; lines that ten documents or more share stay only where they first occur (a
document that so loses lines and keeps none but blank ones goes); one row of each group of near
copies stays (five-word shingles, similarity 0.8 or more), whatever the rows' ids are; documents that hold a
benchmark passage go; the rest is encoded.  ORACLE_SQL is None: the toxicity
model cannot be said in SQL, so the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import decontamination, jaccard_join, line_dedup, sentencepiece_bpe, toxicity
from fieldmark.llm.common import discard, scratch_tables, staged, table
from fieldmark.llm.queries import PIECES, remainder, vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The line stage: keys of so many code points in so many documents.
MIN_CHARS, MIN_DOCS = 1, 10


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs.where(remainder(5) != 0), table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs.select(COLUMNS), model).where("predicted = 0").select(COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bitmaps = line_dedup.keep_bitmaps(docs, MIN_DOCS, MIN_CHARS, keep_first=True)
    changed = F.col("n_dropped") > 0
    done = line_dedup.apply_bitmaps(docs.select(COLUMNS), bitmaps).where(~changed | (F.btrim("kept_text", F.lit(line_dedup.STRIP)) != ""))
    return done.select("doc_id", F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of its own for each row, so that rows without an id, or with the id of others, count for themselves.

    Written, since a second evaluation could number the rows otherwise.
    """
    return staged(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    classes = jaccard_join.similarity_classes(rows.select(F.col("row").alias("doc_id"), "text"), 5, 80, 100)
    copies = staged(classes.where("doc_id <> component_id").select(F.col("doc_id").alias("row")), "copies")
    return rows.join(copies, "row", "left_anti").select(COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = numbered(docs)
    leaks = decontamination.find_leaks(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row")).distinct()
    return rows.join(leaks, "row", "left_anti").select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(docs, vocabulary(PIECES))


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece encoding", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; all that the stages wrote on the way is deleted as soon as the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch_tables() as made:
            after = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        discard(*(t for t in made if t is not after), *([docs] if hasattr(docs, "scratch") else []))
        docs = after
    return docs
