"""Result tables as files: CSV with fixed decimals (K1-K4, K7), text (K5), Markdown (K10), manifests (K8).

Spark writes folders of part files; ordered tables are range-partitioned by their key, so no task holds a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.shared import numbered


def fixed_decimals(table: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles as texts with ``digits`` decimals."""
    return table.select(*[F.format_string(f"%.{digits}f", n).alias(n) if t == "double" else F.col(n) for n, t in table.dtypes])


def write_csv(table: DataFrame, path: str, order: list[str] | None = None, digits: int = 4) -> None:
    """K1-K4, K6, K7: CSV with a header, in order of ``order`` over all part files."""
    rows = fixed_decimals(table.orderBy(*order) if order else table, digits)
    rows.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def correctness_text(result: DataFrame) -> DataFrame:
    """K5: one line per figure of the comparison."""
    lines = [F.concat(F.lit(name.upper() + "="), F.col(name).cast("string")) for name in result.columns]
    return result.select(F.explode(F.array(*lines)).alias("value"))


def markdown(table: DataFrame, order: list[str]) -> DataFrame:
    """(seq, line) of a Markdown table; bars inside cells become slashes. The header has places 0 and 1."""
    def row(cells: list[Column]) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = table.sparkSession.createDataFrame([(0, "| " + " | ".join(table.columns) + " |"), (1, "| " + " | ".join("---" for _ in table.columns) + " |")], "seq bigint, line string")
    body = numbered(table, order, "_place").select((F.col("_place") + 2).cast("bigint").alias("seq"), row([F.translate(F.coalesce(F.col(c).cast("string"), F.lit("")), "|", "/") for c in table.columns]).alias("line"))
    return head.unionByName(body)


def first_frames(parts: list[DataFrame], frames: int) -> DataFrame:
    """The first ``frames`` rows of several sources in turn (each with seq); fewer are an error."""
    rows = parts[0].withColumn("part", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        rows = rows.unionByName(p.withColumn("part", F.lit(k)))
    out = rows.orderBy("part", "seq").limit(frames)
    n = out.agg(F.count("*").alias("n"))
    return out.join(F.broadcast(n)).where(F.when(F.col("n") < frames, F.raise_error(F.lit("too few frames")).cast("boolean")).otherwise(True)).drop("n")
