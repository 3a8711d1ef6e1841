"""The ledger of embedding costs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import schemas

#: Days that a period goes back.
PERIODS = {"day": 1, "week": 7, "month": 30}


def read(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and malformed ones, and those without a time, are skipped."""
    rows = spark.read.text(path).select(F.from_json("value", "ts string, model string, tokens long, requests long, cost double").alias("r")).select("r.*")
    return rows.withColumn("ts", F.col("ts").try_cast("timestamp")).where("ts is not null")


def record(spark: SparkSession, path: str, model: str, tokens: int, requests: int, cost: float, now: datetime | None = None) -> None:
    row = [((now or datetime.now(timezone.utc)).isoformat(), model, tokens, requests, cost)]
    spark.createDataFrame(row, schemas.LEDGER).coalesce(1).write.mode("append").json(path)


def summary(ledger: DataFrame, period: str = "month", now: Column | None = None) -> DataFrame:
    """One row: total_tokens, total_requests, total_cost, entries since now less the period."""
    if period not in PERIODS:
        raise ValueError(f"Unknown period: {period!r}")
    since = (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {PERIODS[period]} DAYS")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return ledger.where(F.col("ts") >= since).agg(total("tokens").alias("total_tokens"), total("requests").alias("total_requests"), total("cost").alias("total_cost"), F.count("*").alias("entries"))


def by_model(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("model").agg(F.sum("tokens").alias("tokens"), F.sum("requests").alias("requests"), F.sum("cost").alias("cost"), F.count("*").alias("entries"))
