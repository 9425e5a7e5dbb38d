"""Run history: sources, listing and statistics of review runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.functions import text as T
from reviewlake.functions.schemas import RUN

DAY = 86_400


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One row a run; unreadable files are skipped."""
    return spark.read.schema(RUN).option("multiLine", True).option("mode", "DROPMALFORMED").option("pathGlobFilter", "*.json").json(folder).filter("id IS NOT NULL")


def write_run(run: DataFrame, folder: str) -> None:
    run.write.mode("append").json(folder)


def listing(runs: DataFrame) -> DataFrame:
    """id, timestamp, kept: newest first."""
    return runs.select("id", "timestamp", F.size(F.filter("findings", lambda f: ~f["suppressed"])).alias("kept")).orderBy(F.desc("timestamp"), F.desc("id"))


def last(runs: DataFrame, n: int) -> DataFrame:
    return runs.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def findings_of(runs: DataFrame) -> DataFrame:
    return runs.select("id", "timestamp", F.explode("findings").alias("f")).select(F.col("id").alias("run_id"), "timestamp", "f.*")


def clean_rate(runs: DataFrame) -> DataFrame:
    """runs, clean_runs, clean_percent of runs without errors and warnings."""
    clean = (F.col("summary.errors") == 0) & (F.col("summary.warnings") == 0)
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.count_if(clean).alias("clean_runs")).withColumn("clean_percent", F.when(F.col("runs") > 0, F.round(100.0 * F.col("clean_runs") / F.col("runs"), 1)))


def averages(runs: DataFrame) -> DataFrame:
    return runs.agg(*(F.round(F.avg(f"summary.{n}"), 2).alias(f"avg_{n}") for n in ("errors", "warnings", "info", "suppressed")))


def week_trend(runs: DataFrame, now: int, total: Column | None = None) -> DataFrame:
    """this_week, last_week: findings of runs younger than 7 days, and of 7 to 14 days."""
    n = total if total is not None else F.col("summary.errors") + F.col("summary.warnings") + F.col("summary.info")
    age = T.saturating_sub(F.lit(now).cast("long"), F.col("timestamp"))
    zero = F.lit(0)
    return runs.agg(
        F.coalesce(F.sum(F.when(age < 7 * DAY, n)), zero).cast("long").alias("this_week"),
        F.coalesce(F.sum(F.when((age >= 7 * DAY) & (age < 14 * DAY), n)), zero).cast("long").alias("last_week"),
    )


def noisiest(findings: DataFrame, suppressed: bool = False, n: int = 5) -> DataFrame:
    """prefix, n of the rules with the most findings (or suppressions), ties by name."""
    rows = findings.filter(F.col("suppressed") == suppressed)
    return rows.groupBy(F.upper(T.prefix_of(F.col("id"))).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prefix").limit(n)


def latest(runs: DataFrame) -> DataFrame:
    """Findings of the newest run."""
    return findings_of(last(runs, 1)).filter("NOT suppressed")


def report_tables(runs: DataFrame) -> dict[str, DataFrame]:
    """What the report shows: rules and files of the latest run (10 each), and a trend of 14 runs, oldest first."""
    now = latest(runs)
    rules = now.groupBy(T.prefix_of(F.col("id")).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prefix").limit(10)
    files = now.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file").limit(10)
    trend = last(runs, 14).select("id", T.date_of(F.col("timestamp")).alias("date"), "timestamp", "summary.errors", "summary.warnings", "summary.info").orderBy("timestamp", "id")
    return {"rules": rules, "files": files, "trend": trend}
