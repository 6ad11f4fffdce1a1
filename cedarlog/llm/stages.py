"""The stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import remove_contaminated
from .minhash import drop_near_duplicates
from .packing import pack
from .secrets import scan_secrets
from .toxicity import fit_toxicity, remove_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their labels, takes for toxic go.

    Null and empty texts have the score of a text without features; rows without an id teach nothing and are judged as any
    other; equal rows are judged alike; columns are as they come; an empty table stays empty."""
    return remove_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are linked by five-word shingles at 0.8 or more, the one of least id stays.

    Rows are judged by id and text: of equal rows one stays, rows that share an id with another text or have none are judged
    by their texts, and texts without words all stay. Columns are as they come; an empty table stays empty."""
    return drop_near_duplicates(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least a twentieth of the words are in benchmark windows go.

    Rows are judged by id and text, so also those without an id, and equal rows alike; null and empty texts stay; columns are
    as they come; an empty table or benchmark changes nothing."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; confirmed secrets in their texts are replaced by a mark, and n_chars follows.

    Null texts stay null, and texts without secrets as they are; equal rows change alike; all other columns pass as they
    come, also where their names are those of the scan's results; an empty table stays empty."""
    scanned = scan_secrets(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text")))
    own = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("redacted")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_secrets") > 0, F.length("redacted")).otherwise(own["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return scanned.select(*(v.alias(c) for c, v in own.items()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents in sequences of 2048: one row for each piece of a document.

    Null and empty texts are the end's id alone; rows without an id and equal rows are packed as any other; other columns are
    not read; an empty table gives no piece."""
    return pack(docs, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]
