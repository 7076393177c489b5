"""From raw documents to packed training batches, in five stages.

Each stage takes the documents its predecessor kept and is written before the
next one reads it. All but the last return the columns of ``documents``. Rows
are documents of their own, with or without an id or a text: a null text has no
words and falls to the first stage, of equal rows the second keeps one, and an
empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featherloom.llm import minhash, mixing, packing, quality, suffix_dedup
from featherloom.llm.common import repeated, table, word_count
from featherloom.plans.lineage import drop, shared_folder


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither a base rule nor the n-gram ratio rejects."""
    trusted = quality.trusted_ids(table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    return quality.judge(rows, trusted).where("kept").select("row.*")


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, once: five-word shingles, similarity 0.8."""
    return minhash.without_near_duplicates(docs, width=5, percent=80)


def suffix_array_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 100 bytes or more that came earlier; n_chars follows."""
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mixing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Documents without words add nothing and go."""
    key = ["id", "t1", "t2", "of"]
    size = word_count(F.col("text"))
    own = docs.where(size > 0).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"), F.col("source").alias("of"), F.struct(*docs.columns).alias("row"), size.alias("size"))
    mixed = mixing.mix(own.select("id", "t1", "t2", F.col("of").alias("source"), "size"))
    taken = mixed.groupBy("id", "t1", "t2", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    taken = taken.select(*[F.col(c).alias(f"{c}_") for c in ("id", "t1", "t2", "source")], "copies", "rows")
    # Rows alike in id, text and source share their copies out in order; equal ones are counted first.
    each = own.groupBy(*key, "row").agg(F.count("*").alias("n"))
    met = each.join(taken.hint("merge"), (F.col("id") == F.col("id_")) & (F.col("t1") == F.col("t1_")) & (F.col("t2") == F.col("t2_")) & F.col("of").eqNullSafe(F.col("source_")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("n"), F.col("copies") % F.col("rows") - before))
    return repeated(met.select("row", (F.col("n") * F.floor(F.col("copies") / F.col("rows")) + more).cast("long").alias("times")), "times", "k").select("row.*")


def length_packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each copy in the length-bucketed batches."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("source_mixing", source_mixing),
    ("length_packing", length_packing),
]

#: Sketches, rounding and dynamic programming are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet into the shared folder and read again.
    A stage's table goes when the next one stands; the last one stays for the caller."""
    folder = shared_folder(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            drop(spark, f"{folder}/{before}")
        before = name
    return docs
