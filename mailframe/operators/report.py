"""Per-run report over corpus records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _totals() -> list[Column]:
    failed = (F.coalesce(F.col("parse_error"), F.lit("")) != "") | F.coalesce(
        F.col("status") == "error", F.lit(False)
    )
    warned = F.size(F.coalesce("checks", F.array().cast("array<string>"))) > 0
    return [
        F.count("*").alias("total"),
        F.count_if(~failed).alias("ok"),
        F.count_if(failed).alias("error"),
        F.count_if(warned).alias("validation_warn"),
        F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("total_latency_ms"),
    ]


def run_report(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of a run: a record is an error or ok, and on top of that may carry warnings.

    Reads parse_error, status, checks and latency_ms. The mean is whole milliseconds, 0 for no
    records; ``has_warnings`` is the fail-on-warning gate.
    """
    totals = df.groupBy(*(by or [])).agg(*_totals())
    mean = F.expr("coalesce(total_latency_ms div nullif(total, 0), 0)")
    return totals.withColumn("mean_latency_ms", mean).withColumn(
        "has_warnings", F.col("validation_warn") > 0
    )


def write_run(records: DataFrame, path: str) -> dict:
    """Write records as JSON lines in the order of their paths; returns the totals of ``run_report``.

    Records are sorted by ranges, a file per range, and the totals are observed behind the sort,
    where each record passes once: nothing is read a second time.
    """
    seen = Observation("corpus-run")
    records.orderBy("path").observe(seen, *_totals()).write.mode("errorifexists").json(path)
    totals = dict(seen.get)
    mean = totals["total_latency_ms"] // totals["total"] if totals["total"] else 0
    return totals | {"mean_latency_ms": mean, "has_warnings": totals["validation_warn"] > 0}
