"""Files of the control report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.report import category_aggregate


def export_control_report(metrics: DataFrame, folder: str) -> None:
    """``summary`` as CSV, one row per site with fixed decimals, and ``report`` as JSON, one document per category."""
    def fixed(c, digits=3):
        return F.format_string(f"%.{digits}f", F.col(c))

    summary = metrics.select("site_id", "category", fixed("span_m").alias("span_m"), fixed("generated_m_p95").alias("p95_m"), "changed", "coverage")
    summary.repartitionByRange("category", "site_id").sortWithinPartitions("category", "site_id").write.mode("overwrite").csv(f"{folder}/summary", header=True)
    site = F.struct("site_id", "span_m", F.col("generated_m_p95").alias("p95_m"), "changed", "coverage", "reference_delta_m")
    # Sites are control points set by hand, so a category's list is small.
    nested = metrics.groupBy("category").agg(F.array_sort(F.collect_list(site)).alias("sites"))
    totals = category_aggregate(metrics).withColumnRenamed("sites", "site_count")
    doc = nested.join(totals, "category").select(F.to_json(F.struct("*")).alias("value"))
    doc.write.mode("overwrite").text(f"{folder}/report")
