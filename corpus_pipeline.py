"""A corpus pipeline of five stages: toxicity, line dedup, near-duplicate removal, benchmark decontamination, source mixing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
``documents``; the last one adds ``copy`` and ``copies`` unless the documents have such columns. Nulls in any column are
allowed: a null text is empty, a null id passes the near-duplicate stage. Repeated rows are near duplicates; an empty table passes all stages; further columns are carried whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwright.llm import textkit as tk
from cellwright.llm.decontaminate import decontaminate
from cellwright.llm.line_dedup import line_dedup
from cellwright.llm.mixture import poisson_mix
from cellwright.llm.near_dedup import near_classes, text_hash
from cellwright.llm.toxicity import toxicity

#: Toxicity, near duplicates and mixing ask for a model, iterations and hashes that SQL doesn't express together.
ORACLE_SQL = None


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    scored = toxicity(docs, tk.table_of(spark, sf_dir, "labels"))
    return _columns(scored.where("predicted = 0"), docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many sources carry go from all documents but the first; lengths follow."""
    done = line_dedup(docs)
    new = {"text": F.col("kept"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return done.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays: of its least id, the least text, once. Rows without an id stay.

    Rows with one id and different texts are different documents, so neither goes unless it is near another.
    """
    stay = near_classes(docs).where("stays").select("doc_id", "h")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("h"))
    unique = rows.join(stay, ["doc_id", "h"], "left_semi").groupBy("doc_id", "h").agg(F.first("row").alias("row"))
    return _columns(unique.select("row").unionByName(rows.where("doc_id IS NULL").select("row")), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are a twentieth of the words, or more, go; others stay as they are."""
    done = decontaminate(docs, tk.table_of(spark, sf_dir, "benchmark"))
    return _columns(done.where("NOT contaminated"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target rate draws it, in shuffled order."""
    mixed = poisson_mix(docs)
    own = [F.col("row")[c].alias(c) for c in docs.columns]
    return mixed.select(*own, *[F.col(c) for c in ("copy", "copies") if c not in docs.columns])


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tk.table_of(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tk.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
