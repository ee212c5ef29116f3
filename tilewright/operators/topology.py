"""Process meshes: neighbours, hosts and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.text import short_host

#: Row and column steps that reach every pair of neighbours once.
STEPS = ((0, 1), (1, 0), (1, 1), (1, -1))


def mesh(ranks: DataFrame, cols: int) -> DataFrame:
    """(rank, host, r, c) of (rank, host) in row-major order."""
    return ranks.select("rank", "host", F.floor(F.col("rank") / cols).cast("int").alias("r"), (F.col("rank") % cols).cast("int").alias("c"))


def edges(cells: DataFrame) -> DataFrame:
    """(a, b, diagonal, same_host) of all neighbouring cells, each pair once, by an equi-join on the stepped place."""
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in STEPS]))
    left = cells.select(F.col("rank").alias("a"), F.col("host").alias("a_host"), "r", "c", steps.alias("s")).select(
        "a", "a_host", (F.col("r") + F.col("s.dr")).alias("r"), (F.col("c") + F.col("s.dc")).alias("c"), ((F.col("s.dr") != 0) & (F.col("s.dc") != 0)).alias("diagonal"))
    return left.join(cells.select(F.col("rank").alias("b"), F.col("host").alias("b_host"), "r", "c"), ["r", "c"]).select("a", "b", "diagonal", (F.col("a_host") == F.col("b_host")).alias("same_host"))


def edge_counts(found: DataFrame) -> DataFrame:
    """Edges in all, inside and between hosts, the share between, straight and diagonal."""
    total = F.count("*")
    between = F.count_if(~F.col("same_host"))
    return found.agg(total.alias("total_edges"), F.count_if("same_host").alias("intra_machine_edges"), between.alias("inter_machine_edges"),
                     F.round(F.when(total > 0, between / total).otherwise(0.0), 6).alias("inter_machine_edge_ratio"), F.count_if(~F.col("diagonal")).alias("cardinal_edges"), F.count_if("diagonal").alias("diagonal_edges"))


def ascii_grid(cells: DataFrame) -> DataFrame:
    """K8: (r, line): rank@host of each cell of a row, short host names."""
    one = F.format_string("%d@%s", "rank", short_host(F.col("host")))
    return cells.groupBy("r").agg(F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(F.struct("c", one.alias("t")))), lambda x: x["t"])).alias("line"))
