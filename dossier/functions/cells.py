"""Report cells as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def metric_cell(stats: Column, graded: Column, total: Column) -> Column:
    """"mean ± stdev", or the mean alone, or a dash; coverage added when it is partial."""
    mean, stdev = stats.getField("mean"), stats.getField("stdev")
    shown = F.when(stdev.isNull(), mean.cast("string")).otherwise(
        F.concat(mean.cast("string"), F.lit(" ± "), stdev.cast("string"))
    )
    coverage = F.when(
        graded.isNotNull() & (total > 0) & (graded < total),
        F.concat(F.lit("<br>*("), graded.cast("string"), F.lit("/"), total.cast("string"),
                 F.lit(" graded)*")),
    ).otherwise(F.lit(""))
    return F.when(stats.isNull() | mean.isNull(), F.lit("—")).otherwise(F.concat(shown, coverage))


def stability_cell(rounds: Column, repeated_exactly: Column, n_unstable: Column,
                   total: Column) -> Column:
    """Never measured, deterministic, or how many items changed their verdict."""
    return (
        F.when(F.coalesce(rounds, F.lit(1)) < 2, F.lit("not measured"))
        .when(F.coalesce(repeated_exactly, F.lit(False)), F.lit("deterministic"))
        .otherwise(F.concat(n_unstable.cast("string"), F.lit("/"), total.cast("string")))
    )


def tokens_cell(tokens: Column) -> Column:
    """Reported total, else the sum of the counts, with thousands separators."""
    summed = F.aggregate(F.map_values(tokens), F.lit(0).cast("bigint"), lambda a, v: a + v)
    total = F.coalesce(F.try_element_at(tokens, F.lit("total")), summed)
    return F.when(tokens.isNull() | (F.size(tokens) == 0), F.lit("—")).otherwise(
        F.format_number(total, 0)
    )
