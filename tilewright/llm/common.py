"""What the operators of this package share: staging tables, word splitting, band and component joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.shared import clear_staged, staged, staged_path

__all__ = ["SPACE", "WORD", "bound", "clear_staged", "held_out", "lower_ascii", "read_table", "renamed", "restored", "row_hash", "staged", "staged_path", "words_of"]

#: White space as the word contract has it: a space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns _c0, _c1, ... that no working column clashes with, and their names before."""
    names = {f"_c{k}": name for k, name in enumerate(df.columns)}
    return df.toDF(*names), names


def restored(names: dict[str, str], without: tuple[str, ...] = ()) -> list[Column]:
    """The columns of ``renamed`` by their old names, but for those that are replaced."""
    return [F.col(now).alias(old) for now, old in names.items() if old.lower() not in without]


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of ``df``, maps as JSON."""
    return F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes])


def bound(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with ``value`` worked out once per row, whatever filters or lambdas use it later.

    A plain column would be written out again inside each filter that is pushed below it and inside
    each lambda; what a generator has made stays as it is.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other letters left alone."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(text.rlike("[A-Z]"), F.translate(text, upper, lower)).otherwise(text)


def words_of(text: Column) -> Column:
    """Words of a text; an empty array for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
