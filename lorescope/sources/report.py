"""Report rows: table bodies and flow links as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorescope.functions.text import one_decimal
from lorescope.operators.metrics import best_in_column, listed


def table_cell(midpoint: Column, margin: Column, best: Column) -> Column:
    """``mid ± margin`` in LaTeX, bold when best, a blank when the run is missing."""
    middle = one_decimal(midpoint)
    shown = F.when(best, F.concat(F.lit("\\textbf{"), middle, F.lit("}"))).otherwise(middle)
    around = F.concat(F.lit(" \\textsubscript{$\\pm$ "), one_decimal(margin), F.lit("}"))
    return F.coalesce(F.concat(shown, around), F.lit(" "))


def emit_table(ci: DataFrame, tasks: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One LaTeX line per model and method, cells by task and metric; a task that is not listed is an error, metrics are a choice."""
    cells = best_in_column(ci, "midpoint", ("task", "metric")).withColumn(
        "_cell", table_cell(F.col("midpoint"), F.col("margin"), F.col("best"))
    )
    columns = [f"{t}_{m}" for t in tasks for m in metrics]
    wide = (
        cells.withColumn("_column", F.concat_ws("_", listed("task", tasks), "metric"))
        .groupBy("model", "method")
        .pivot("_column", columns)
        .agg(F.max("_cell"))
        .fillna(" ", columns)
    )
    line = F.concat(F.concat_ws(" & ", "model", "method", *[F.col(f"`{c}`") for c in columns]), F.lit(" \\\\"))
    return wide.select("model", "method", line.alias("line"))


def emit_links(links: DataFrame, by: Sequence[str] = ("task",)) -> DataFrame:
    """Flow links as JSON objects, one list per group; a group has at most six links."""
    one = F.to_json(F.struct("from", "to", "value"))
    return links.groupBy(*by).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(one)), ", "), F.lit("]")).alias("links"))
