"""Operations: counters, fill levels, soak runs and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blockprism.functions import scalars as S
from blockprism.schemas import BLOCK

#: Fixed value: words that hint at an issue.
HINTS = "panic|error|failed|failure|mismatch|corrupt|crc|overlap|rejected|timeout|drift"


def metric_deltas(snapshots: DataFrame, by: list[str], order: str, value: str = "value") -> DataFrame:
    """Growth of counters from snapshot to snapshot; one that was reset grows by nothing, the first has none."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(order))
    return snapshots.withColumn("_before", before).filter("_before is not null").withColumn("delta", F.greatest(F.col(value) - F.col("_before"), F.lit(0))).drop("_before")


def fill(shards: DataFrame) -> DataFrame:
    """Per shard and in all (null): used, capacity and whole percent."""
    sums = shards.rollup("shard").agg(F.sum("used_bytes").alias("used_bytes"), F.sum("capacity_bytes").alias("capacity_bytes"))
    return sums.withColumn("fill_pct", S.fill_percent("used_bytes", "capacity_bytes"))


def flush_counters(units: DataFrame) -> DataFrame:
    """Per volume: units, blocks and bytes."""
    return units.groupBy("vol_id").agg(F.count("*").alias("units"), F.sum("lba_count").alias("lbas"), (F.sum("lba_count") * BLOCK).alias("bytes"))


def compression_totals(units: DataFrame) -> DataFrame:
    """Bytes in and out, and their ratio, of units with ``original_size`` and ``compressed_size``."""
    sums = units.agg(F.sum("original_size").alias("bytes_in"), F.sum("compressed_size").alias("bytes_out"))
    return sums.withColumn("ratio", F.when(F.col("bytes_out") > 0, F.col("bytes_in").cast("double") / F.col("bytes_out")))


def throughput(workers: DataFrame) -> DataFrame:
    """Of workers' ``ops, bytes`` and the phase's ``wall_secs, drain_secs``: rates and microseconds an operation."""
    sums = workers.agg(F.sum("ops").alias("ops"), F.sum("bytes").alias("bytes"), F.max("wall_secs").alias("wall"), F.max("drain_secs").alias("drain"))
    rate = lambda x, t: F.when(F.col(t) > 0, x / F.col(t)).otherwise(0.0)
    mib = F.col("bytes") / float(1 << 20)
    sums = sums.withColumn("total", F.col("wall") + F.col("drain"))
    return sums.select("ops", "bytes", rate(mib, "wall").alias("mib_s"), rate(F.col("ops").cast("double"), "wall").alias("iops"), F.when(F.col("ops") > 0, F.col("wall") * 1e6 / F.col("ops")).otherwise(0.0).alias("avg_us"), rate(mib, "total").alias("sustained_mib_s"), rate(F.col("ops").cast("double"), "total").alias("sustained_iops"))


def memory_total(families: DataFrame) -> DataFrame:
    """Per property the sum over column families ``(family, property, bytes)``, and in all (null)."""
    return families.rollup("property").agg(F.sum("bytes").alias("bytes"))


def volume_counts(volumes: DataFrame, handles: DataFrame) -> DataFrame:
    open_ = handles.filter("live").select("vol_id").distinct()
    return volumes.join(open_.withColumn("open", F.lit(True)), "vol_id", "left").agg(F.count("*").alias("volumes"), F.count("open").alias("live"))


def volumes_with_metrics(volumes: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every volume, with zeros where nothing was counted."""
    names = [c for c in metrics.columns if c != "vol_id"]
    return volumes.join(metrics, "vol_id", "left").fillna(0, names)


def soak_summary(reports: DataFrame, by: list[str], order: str, counters: list[str], elapsed: str = "elapsed_secs") -> DataFrame:
    """Each report with its recent rates (since the report before) and those of the whole run; times count as 1 s at least."""
    own = Window.partitionBy(*by).orderBy(order)
    out = reports.withColumn("_dt", F.greatest(F.col(elapsed) - F.coalesce(F.lag(elapsed).over(own), F.lit(0.0)), F.lit(1.0)))
    for c in counters:
        out = out.withColumn(f"recent_{c}", (F.col(c) - F.coalesce(F.lag(c).over(own), F.lit(0))) / F.col("_dt")).withColumn(f"avg_{c}", F.col(c) / F.greatest(F.col(elapsed), F.lit(1.0)))
    return out.drop("_dt")


def log_context(lines: DataFrame, by: list[str], order: str, match, before: int, after: int) -> DataFrame:
    """Lines that match, with ``before`` lines ahead of each and ``after`` behind, none twice.

    A line is shown if a match lies within ``after`` lines before it or ``before``
    lines behind it.
    """
    near = Window.partitionBy(*by).orderBy(order).rowsBetween(-after, before)
    return lines.withColumn("is_match", match.cast("int")).withColumn("_near", F.max("is_match").over(near)).filter("_near = 1").drop("_near")


def issue_histogram(lines: DataFrame, message: str = "msg", top: int | None = None) -> DataFrame:
    """How often each issue's message occurs once numbers and addresses are replaced; ``top`` is a report's length."""
    counts = lines.filter(is_issue(message=message)).groupBy(S.normalised(message).alias("issue")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "issue").limit(top) if top else counts


def signal_counts(lines: DataFrame, signals: list[str], message: str = "msg") -> DataFrame:
    """One row: how many issues contain each signal, whatever the case."""
    text = F.lower(message)
    return lines.filter(is_issue(message=message)).agg(*(F.count_if(text.contains(s.lower())).alias(s.lower().replace(" ", "_")) for s in signals))


def is_issue(level: str = "level", message: str = "msg"):
    """Warnings and errors, and lines that hint at one."""
    return F.col(level).isin("WARN", "ERROR") | F.lower(message).rlike(HINTS)


def last_failure(events: DataFrame, order: str = "line_no") -> DataFrame:
    """The last failure of a run, one row if there is any."""
    return events.filter("event = 'failure'").orderBy(F.desc(order)).limit(1)


def last_issues(lines: DataFrame, n: int, order: str = "line_no") -> DataFrame:
    return lines.filter(is_issue()).orderBy(F.desc(order)).limit(n)
