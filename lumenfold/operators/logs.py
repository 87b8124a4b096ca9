"""Logs: phases from lines of text, and lines that belong together by order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def phases(lines: DataFrame) -> DataFrame:
    """line_no, phase and ms of lines like ``... phase=NAME took 123ms``; others are left out."""
    form = r"phase=(\w+) took (\d+)ms"
    return lines.where(F.col("line").rlike(form)).select("line_no", F.regexp_extract("line", form, 1).alias("phase"), F.regexp_extract("line", form, 2).cast("bigint").alias("ms"))


def tiles_with_calls(lines: DataFrame) -> DataFrame:
    """For each tile line of each log: the latest call line (kind ipc) since the tile line before it, and the first merge
    and write lines before the next one; null where there is none. log, tile_line, ipc_line, merge_line, write_line.

    lines: log, line_no, kind. A call that one tile took is not taken again. Each log is
    numbered in the order of its lines, apart from the others.
    """
    ordered = Window.partitionBy("log").orderBy("line_no")
    tile = F.when(F.col("kind") == "tile", 1)
    before = F.coalesce(F.count(tile).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    line = lambda k: F.when(F.col("kind") == k, F.col("line_no"))
    # A call belongs to the tile after it, the rest to the tile before them.
    each = lines.withColumn("__before", before).withColumn("k", F.col("__before") - F.when(F.col("kind").isin("tile", "ipc"), 0).otherwise(1))
    out = each.groupBy("log", "k").agg(
        F.max(line("tile")).alias("tile_line"), F.max(line("ipc")).alias("ipc_line"), F.min(line("merge")).alias("merge_line"), F.min(line("write")).alias("write_line")
    )
    return out.where("tile_line is not null").drop("k")
