"""Writers: chunk tables, the vector index and experiment reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ragweave.operators import report
from ragweave.plans.config import Settings


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Overwrite a table of master or packed chunks; JSON lines if the path ends so, else Parquet."""
    chunks.write.mode("overwrite").format("json" if path.endswith(".json") else "parquet").save(path)


def write_index(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(path)


def write_report(evaluated: DataFrame, folder: str, settings: Settings = Settings(), xlsx: bool = False) -> str:
    """Write Summary_Metrics and Detailed_Trace below a folder named after the run and minute; returns it."""
    run = f"{folder.rstrip('/')}/{report.run_name(settings)}"
    summary, detail = report.summary(evaluated, settings), report.detail(evaluated)
    summary.write.mode("overwrite").option("header", True).csv(f"{run}/Summary_Metrics")
    detail.write.mode("overwrite").parquet(f"{run}/Detailed_Trace")
    if xlsx:  # a question set is small; needs an Excel engine on the driver
        import pandas

        with pandas.ExcelWriter(f"{run}.xlsx") as book:
            summary.toPandas().to_excel(book, sheet_name="Summary_Metrics", index=False)
            detail.toPandas().to_excel(book, sheet_name="Detailed_Trace", index=False)
    return run
