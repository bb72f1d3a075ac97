"""Helpers shared by the corpus operators: table access, words, shared scratch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.scratch import Scratch  # noqa: F401  (operators take it from here)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The white space that separates words: \x20 and \x09-\x0D.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def byte_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8 bytes.

    ``bytes.lower`` touches only A-Z and ``bytes.split`` cuts exactly at that white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def crc_mod(c: Column, n: int) -> Column:
    """crc32 of a column's text, modulo n; null ids count as remainder -1."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % n, F.lit(-1))
