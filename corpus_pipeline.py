"""From raw documents to packed training sequences, in five stages of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; whoever runs them writes each result as Parquet and
reads it again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.llm import langid, linededup, packing, pii, setjoin
from karst.llm.common import Scratch


def _wrapped(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns a stage works on, and the others of a row as one, so that no name can clash with the operator's own."""
    return docs.select(*columns, F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in columns)).alias("row"))


def _unwrapped(rows: DataFrame, docs: DataFrame, *columns: str) -> DataFrame:
    return rows.select(*(F.col(c) if c in columns else F.col("row").getField(c).alias(c) for c in docs.columns))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without text or without any letter go, whether there is a model or not.

    Null and repeated ids are rows like others; rows with a null id or a null language are not learned from."""
    out = langid.identify(_wrapped(docs, "doc_id", "text", "lang"), ["doc_id", "text", "lang", "row"])
    # without any usable label there is no model and all is 'und', which says nothing about a text
    out = out.where((F.col("lang_pred") != "und") | F.col("text").rlike("\\p{L}"))
    return _unwrapped(out, docs, "doc_id", "text", "lang")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks are taken out of all texts but the first. Every row stays: rows with a null id or a null
    text as they are, repeated rows treated alike, a text that is all repeated as an empty one."""
    return linededup.removed(docs, docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by five-word shingles at a similarity of 0.8: the one of the smallest id.

    Rows of one doc_id and different texts are different documents, of which the smallest text hash goes first; so are rows
    with a null doc_id and different texts, which come after all others. Of rows that share both id and text, the one whose
    other columns come first as JSON stays. Texts without words are linked with nothing and stay.
    """
    scratch = Scratch(spark, "near_rows")
    keyed = _wrapped(docs, "doc_id", "text").withColumn("hash", F.xxhash64("text"))
    several = keyed.where("doc_id is not null").groupBy("doc_id").agg(F.min("hash").alias("least"), F.max("hash").alias("most")).where("least < most").select("doc_id", "least")
    keyed = keyed.join(scratch.save(several, "several"), "doc_id", "left")
    # the operator's ids: doc_id itself, and a hash of id and text for what has no id of its own
    own = F.col("doc_id").isNotNull() & (F.col("least").isNull() | (F.col("hash") == F.col("least")))
    keyed = keyed.withColumn("further", ~own).withColumn("id", F.when(own, F.col("doc_id")).otherwise(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "text")).cast("long"))
    further = scratch.save(keyed.where("further").select("id", "doc_id", "further").distinct(), "further")
    links = setjoin.link_components(keyed.select(F.col("id").alias("doc_id"), "text"), 5, 80).select(F.col("doc_id").alias("id"), "component_id")
    links = links.join(further, "id", "left").withColumn("further", F.coalesce("further", F.lit(False)))
    owner = F.when(F.col("further"), F.col("doc_id")).otherwise(F.col("id"))
    links = links.withColumn("place", F.struct(owner.isNull().alias("nameless"), owner.alias("doc_id"), "further", "id"))
    kept = links.groupBy("component_id").agg(F.min("place").alias("place")).select("place.id")
    others = F.to_json(F.struct(*(F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("doc_id", "text"))))
    out = keyed.join(kept, "id", "left_semi").groupBy("id", "text").agg(F.first("doc_id").alias("doc_id"), F.min_by("row", others).alias("row"))
    return _unwrapped(out, docs, "doc_id", "text")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets. Every row stays, whatever its id; null texts stay null."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 1024 tokens. A null text is an empty one; null and repeated ids
    are rows like others."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Language models, set similarity by components and packing have no SQL form; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
