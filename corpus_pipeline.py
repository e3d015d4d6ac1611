"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windrift.llm.common import Scratch, table
from windrift.llm.mixing import mixed_texts
from windrift.llm.packing import pack_documents
from windrift.llm.quality import quality_rules
from windrift.llm.queries import tokenizer_path
from windrift.llm.recompression import remove_repeats
from windrift.llm.repeats import uid
from windrift.llm.weighted_minhash import near_duplicate_classes


def folded(docs: DataFrame) -> DataFrame:
    """doc_id, text and source as they are, all other columns in one, so that none can clash with an operator's own."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    return docs.select("doc_id", "text", "source", F.struct(*others).alias("others") if others else F.lit(None).cast("string").alias("others"))


def unfolded(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, n_chars counted anew."""
    column = lambda c: F.char_length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(c) if c in ("doc_id", "text", "source") else F.col(f"others.`{c}`")
    return rows.select(*(column(c).alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules(docs.select("text", F.struct(*docs.columns).alias("row")), keep_columns=["row"]).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one of smallest doc_id; of rows equal in id and text the one whose other columns come first."""
    kept = near_duplicate_classes(Scratch(spark), docs.select("doc_id", "text")).where("kept").select("uid").distinct()
    others = F.to_json(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text")), F.lit(0).alias("_")))
    rows = docs.select(uid().alias("uid"), F.struct(*docs.columns).alias("row"), others.alias("others")).join(kept, "uid")
    return rows.groupBy("uid").agg(F.min_by("row", "others").alias("row")).select("row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages they share; those of which nothing is left go."""
    cut = remove_repeats(Scratch(spark), folded(docs), with_text=True).where("n_words > n_removed or n_words = 0")
    return unfolded(cut.withColumn("text", F.col("kept_text")), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by target weights; a document can come up to three times."""
    return unfolded(mixed_texts(Scratch(spark), folded(docs)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return pack_documents(Scratch(spark), docs, tokenizer_path())


STAGES = [("quality_rules", quality), ("minhash_near_dedup", near_duplicates), ("substring_dedup", repeats), ("source_mixing", mixing), ("best_fit_packing", packing)]

#: No stage after the quality rules can be put in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
