"""Writing results, reports and closed periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig


def write_results(results: DataFrame, path: str, cfg: MatchConfig | None = None, fmt: str = "parquet") -> None:
    """Match results, a folder per stage; with the settings of the run beside them."""
    results.write.mode("overwrite").partitionBy("stage").format(fmt).save(path)
    if cfg is not None and "://" not in path:
        cfg.snapshot(f"{path.rstrip('/')}.config.json")


def write_csv(df: DataFrame, path: str) -> None:
    """A report as CSV; commas in texts become blanks, all cells are quoted."""
    texts = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    df.select(*[(F.replace(F.col(f"`{c}`"), F.lit(","), F.lit(" ")) if c in texts else F.col(f"`{c}`")).alias(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True, quoteAll=True)


def close_period(kpi: DataFrame, summary: DataFrame, period: str, path: str) -> None:
    """Append the one row of figures of a closed period to the table of closed periods."""
    kpi.join(summary, F.lit(True)).withColumn("period", F.lit(period)).write.mode("append").parquet(path)


def markdown_report(kpi: DataFrame, statuses: DataFrame, exceptions: DataFrame, transactions: DataFrame, rows: int = 100) -> str:
    """A report from small summaries; of the transactions the first ``rows`` by id are listed, which is the report's form."""
    k = kpi.first().asDict()
    lines = ["# Reconciliation report", "", *(f"- {name}: {value}" for name, value in k.items()), "", "| status | rows | share |", "| --- | --- | --- |"]
    lines += [f"| {r['taxonomy']} | {r['n']} | {r['share']} |" for r in statuses.orderBy("taxonomy").collect()]
    lines += ["", "| exception | priority | state | rows |", "| --- | --- | --- | --- |"]
    lines += [f"| {r['exception_type']} | {r['priority']} | {r['state']} | {r['n']} |" for r in exceptions.orderBy("exception_type", "priority", "state").collect()]
    listed = transactions.orderBy("id").limit(rows)
    lines += ["", "| " + " | ".join(listed.columns) + " |", "|" + " --- |" * len(listed.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in listed.collect()]
    return "\n".join(lines) + "\n"
