"""Corpus pipeline over ``documents``: low quality goes, one document of each near-duplicate group stays, repeated paragraphs are
cut, sources are mixed to target weights, and what is left is packed in batches.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``; all but the last return the columns of
``docs``. Texts that a stage changes carry their new length in ``n_chars``, if that column is there. Where ids are null or
repeat, stages decide by rows. Empty tables give empty ones. The ids that decide on documents are broadcast while they are few by a
check of their size, and merged with the documents beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.mixing import mix
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import THRESHOLD, learn, with_quality
from tidemark.llm.ranking import ranked
from tidemark.llm.shared import side, stage
from tidemark.llm.substring import cut_repeats, repeated_spans
from tidemark.storage import drop, new_path, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the rules are learnt from the labels of the rows given.

    Null texts are scored as empty ones, equal texts alike whatever their id, whole texts however long. Without labelled rows every
    score is 0.5, so nothing stays.
    """
    rules = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_quality(docs, rules, score_column="__score").where(F.col("__score") >= THRESHOLD).drop("__score")


NEAR = {"percent": 80, "bands": 28, "rows": 5}  # a pair at 0.8 collides nowhere with probability 1.5e-5


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row as ``__own``: its id where all rows have one of their own, else its place by id, null last."""
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn("__own", F.col("doc_id"))
    return ranked(docs.withColumn("__all", F.lit(0)), ["__all"], [F.col("doc_id").asc_nulls_last(), F.col("text")], "__own").drop("__all")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each group linked by a Jaccard of 0.8 or more.

    Null and blank texts are alike to nothing and stay. Rows that repeat an id are rows of their own: exact repeats count as copies,
    other texts don't. A null id comes last.
    """
    keyed = _keyed(docs)
    gone = stage(near_duplicates(keyed, id_column="__own", **NEAR).where("not kept").select(F.col("doc_id").alias("__id")), "gone")
    return keyed.join(side(gone), F.col("__own") == F.col("__id"), "left_anti").drop("__own")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated paragraphs and passages of over 50 words.

    Null, empty and short texts are unchanged; a text that repeats earlier ones as a whole is empty, its row stays. Rows that
    repeat an id or have none are rows of their own, null ids last.
    """
    keyed = _keyed(docs)
    cut = cut_repeats(keyed, repeated_spans(keyed, id_column="__own"), id_column="__own").drop("__own")
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, 0 to 3 times.

    Rows without words are not taken; a null source is a source, the last. Rows that repeat an id or have none are taken each by itself.
    """
    keyed = _keyed(docs)
    copies = mix(keyed, id_column="__own").where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("copies").alias("__copies"))
    taken = keyed.join(side(stage(copies, "copies")), F.col("__own") == F.col("__id")).drop("__id", "__own")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).drop("__copy", "__copies").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, bucket, bucket_len, batch, slot)``, a row for each row given; null texts have no tokens."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mixing", mixing), ("packing", packing)]

# near-duplicate banding, the lasso's rules and both dynamic programmes have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table, and what it staged on the way, is deleted as soon as the next one's is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, apply in STAGES[:-1]:
        path = new_path(spark, name)
        with scratch(spark):
            made = apply(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before is not None:
            drop(spark, [before])
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
