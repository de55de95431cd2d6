"""Table access, durable cut points and partition helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.durable import cut as cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data set at ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-case A-Z only, as the contracts ask."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(column, modulus: int):
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, so that other columns may have any names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def names_apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with those columns renamed that begin with an underscore, as the operators' own helpers do, and the way back.

    The way back takes a table of the same columns in the same order.
    """
    names, taken = docs.columns, {c.lower() for c in docs.columns}
    apart = []
    for k, name in enumerate(names):
        new = name
        while new.startswith("_") or (new != name and new.lower() in taken):
            new = f"input{k}_{new}" if new == name else f"x{new}"
        apart.append(new)
    return docs.toDF(*apart), lambda out: out.toDF(*names)
