"""From documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import mixing, packing, quality, repeats, simhash
from fleetlens.llm.common import documents, stored
from fleetlens.llm.queries import quality_weights

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives half or more. Trained on the labelled ids of op4; without labels all
    stay, as every score is a half."""
    scored = quality.score(docs.select(*COLUMNS), quality_weights(spark, docs, sf_dir))
    return scored.where("score >= 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-equal fingerprints the row of least id (null last; of repeated ids the first)."""
    # ids may repeat or be null; a row's number is written down once, as it is no fact of the table
    rows = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    found = simhash.near_duplicates(rows, doc_id="row").select(F.col("doc_id").alias("row"), "component_id")
    named = found.join(rows.select("row", "doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    kept = stored(named.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row").alias("row")))
    return rows.join(kept, "row", "left_semi").select(*COLUMNS)


def dedup_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated strings (and of characters cut in two by that). A document goes if no word of
    it is left by this; all others stay. A null text becomes empty."""
    others = [c for c in COLUMNS if c != "text"]
    cut = repeats.repeated(docs, carry=tuple(others), as_text=True).withColumnRenamed("kept", "text")
    changed = F.col("n_removed") > 0
    n_chars = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    left = cut.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", n_chars).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in the order of its slots: every document at least once, small sources repeated up to their weight."""
    docs = docs.select(*COLUMNS)
    mixed = mixing.mix_sources(docs)
    return mixed.repartitionByRange("slot").sortWithinPartitions("slot").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every delivery's pieces and their places in sequences."""
    return packing.best_fit(packing.pieces(docs))


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", dedup_repeats),
    ("source mixing", mix),
    ("best-fit packing", pack),
]

#: Classifier training, fingerprints, byte-wise repeats, schedules and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all its predecessor kept, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
