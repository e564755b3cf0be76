"""Text sources: soak events in JSON lines, engine logs, and configuration."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockprism.functions import scalars as S
from blockprism.schemas import SOAK_EVENT

#: Fixed value: a log line's time, level, target and message.
LINE = r"^(\S+)\s+(TRACE|DEBUG|INFO|WARN|ERROR)\s+([\w:]+):\s+(.*)$"


def soak_events(spark: SparkSession, path: str) -> DataFrame:
    """Events; blank and malformed lines are left out."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = F.from_json("value", SOAK_EVENT, {"mode": "PERMISSIVE"})
    good = F.from_json("value", "map<string,string>").isNotNull()
    return lines.filter(good).select(parsed.alias("e")).select("e.*")


def log_lines(lines: DataFrame, column: str = "value", hints: str | None = None) -> DataFrame:
    """``ts, level, target, msg`` of lines that are log lines, without terminal colours; other columns stay.

    With ``hints``, an expression in lower case, other lines that hint at an issue
    are kept whole, of level ``TEXT``.
    """
    clean = lines.withColumn("_line", S.plain(column))
    is_line = F.col("_line").rlike(LINE)
    out = clean.filter(is_line | F.lower("_line").rlike(hints) if hints else is_line)
    whole = {"ts": "", "level": "TEXT", "target": "", "msg": F.col("_line")}
    parts = (F.when(is_line, F.regexp_extract("_line", LINE, k + 1)).otherwise(whole[n]).alias(n) for k, n in enumerate(whole))
    return out.select(*(c for c in lines.columns if c != column), *parts)


def latest_run(files: DataFrame, column: str = "path") -> DataFrame:
    """The last run folder, by name, that has a ``summary.json``; one row of column ``run``."""
    run = F.regexp_extract(column, r"^(.*)/summary\.json$", 1)
    return files.select(run.alias("run")).filter("run <> ''").agg(F.max("run").alias("run"))


def write_events(events: DataFrame, path: str) -> None:
    """Events as JSON lines, added to what is there; fields that are null are left out."""
    events.write.mode("append").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A run's summary, one row, as JSON, in place of the one before."""
    summary.limit(1).coalesce(1).write.mode("overwrite").json(path)


#: Settings that a file need not give.
DEFAULTS = {
    "storage": {"block_size": 4096, "default_compression": "lz4"},
    "meta": {"block_cache_mb": 256},
    "buffer": {"capacity_mb": 16384, "flush_watermark_pct": 80, "group_commit_wait_us": 500, "shards": 4},
    "ublk": {"nr_queues": 4, "queue_depth": 128, "io_buf_bytes": 1048576},
    "flush": {"compress_workers": 2, "coalesce_max_raw_bytes": 131072, "coalesce_max_lbas": 32, "skip_fully_superseded": True},
    "engine": {"zone_count": 4, "zone_size_blocks": 256},
    "gc": {"enabled": True, "scan_interval_ms": 5000, "dead_ratio_threshold": 0.25, "buffer_usage_max_pct": 80, "buffer_usage_resume_pct": 50, "max_rewrite_per_cycle": 64},
    "dedup": {"enabled": True, "workers": 2, "buffer_skip_threshold_pct": 90, "rescan_interval_ms": 30000, "max_rescan_per_cycle": 256},
    "service": {},
    "ha": {"enabled": False, "node_id": 0, "heartbeat_interval_ms": 3000, "lease_duration_secs": 30},
}


def config(spark: SparkSession, text: str) -> DataFrame:
    """Settings ``(section, name, value)`` of a TOML text, defaults filled in; all values as text."""
    given = tomllib.loads(text)
    rows = [(s, n, str(given.get(s, {}).get(n, v)).lower() if isinstance(v, bool) else str(given.get(s, {}).get(n, v))) for s, names in DEFAULTS.items() for n, v in names.items()]
    rows += [(s, n, str(v)) for s, names in given.items() if isinstance(names, dict) for n, v in names.items() if n not in DEFAULTS.get(s, {})]
    return spark.createDataFrame(rows, "section string, name string, value string")
