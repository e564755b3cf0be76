"""Block metadata derived from the driver's tables, as DataFrames and, for the oracle, as DuckDB views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockprism.functions import scalars as S
from blockprism.operators import blockmap as B
from blockprism.operators import dedup, writelog
from blockprism.sources.tables import driver_table

TOTAL = 2056
LBAS = 1024


class Derived:
    """Each property is one derived table; nothing is computed before it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return driver_table(self.spark, self.dir, name)

    @property
    def events(self) -> DataFrame:
        return self.table("events").select("event_id", "user_id", "event_type", "value", F.concat(F.lit("vol-"), (F.col("user_id") % 3).cast("string")).alias("vol_id"))

    @property
    def writes(self) -> DataFrame:
        """One block each."""
        kept = self.events.filter(F.col("event_type").isin("click", "purchase"))
        return kept.select(F.col("event_id").alias("seq"), "vol_id", ((F.col("event_id") * F.col("event_id") + F.col("user_id")) % LBAS).alias("lba"))

    @property
    def volumes(self) -> DataFrame:
        """The generation is that of the last signup."""
        last = self.events.groupBy("vol_id").agg(F.coalesce(F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))), F.lit(0)).alias("created_at"))
        return last.select("vol_id", F.lit(LBAS * 4096).cast("bigint").alias("size_bytes"), "created_at")

    @property
    def generations(self) -> DataFrame:
        """Writes with a generation, some stale, some a wildcard."""
        rows = self.writes.join(self.volumes.select("vol_id", F.col("created_at").alias("now")), "vol_id")
        made = F.when(F.col("seq") % 11 == 0, F.lit(0)).when(F.col("seq") % 5 == 0, F.col("now") - 1).otherwise(F.col("now"))
        return rows.select("seq", "vol_id", "lba", made.cast("bigint").alias("vol_created_at"))

    @property
    def log(self) -> DataFrame:
        """Entries of 1 to 8 blocks in 4 shards, with how far they are flushed."""
        count = F.col("seq") % 8 + 1
        return self.writes.select("seq", "vol_id", F.col("lba").alias("start_lba"), count.alias("lba_count"), (F.col("lba") % 4).alias("shard"), ((F.col("seq") % 17 != 0) | (F.col("seq") < 3000)).alias("flushed"))

    @property
    def marks(self) -> DataFrame:
        """Flushed ranges, some twice, some not of the whole entry."""
        one = self.log.filter("seq % 3 <> 0").select("seq", "start_lba", (F.col("lba_count") - F.when(F.col("seq") % 4 == 0, 1).otherwise(0)).alias("lba_count"))
        return one.unionByName(one.filter("seq % 2 = 0"))

    @property
    def unit_writes(self) -> DataFrame:
        """Each write covers four or eight blocks of an aligned unit of eight."""
        kept = self.events.filter(F.col("event_type").isin("click", "purchase"))
        width = F.when(F.col("event_id") % 3 == 0, 7).otherwise(3)
        base = (F.col("event_id") * F.col("event_id") + F.col("user_id")) % 128 * 8
        each = kept.withColumn("k", F.explode(F.sequence(F.lit(0), width)))
        return each.select(F.col("event_id").alias("seq"), "vol_id", (base + F.col("k")).alias("lba"))

    @property
    def blockmap(self) -> DataFrame:
        return _mapped(writelog.latest(self.unit_writes))

    @property
    def blockmap_before(self) -> DataFrame:
        """The same as of the first 5000 events."""
        return _mapped(writelog.latest(self.unit_writes.filter("seq < 5000")))

    @property
    def stored(self) -> DataFrame:
        """Counts of which many are wrong or orphaned."""
        return self.table("events").select((F.col("event_id") + 8).alias("pba"), (F.col("event_id") % 5 + 1).alias("refcount"))

    @property
    def allocated(self) -> DataFrame:
        return writelog.latest(self.writes).select((F.col("seq") % (TOTAL - 8) + 8).alias("pba")).distinct()

    @property
    def doc_blocks(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", F.col("lang").alias("vol_id"), F.col("text").alias("payload"))
        return dedup.fingerprints(docs).select("doc_id", "vol_id", F.col("index").cast("bigint").alias("lba"), "hash")

    @property
    def index(self) -> DataFrame:
        """The canonical owner of each content among the first half of the blocks, one in seven stale."""
        own = dedup.canonical(self.doc_blocks.filter("doc_id % 2 = 0"), ["doc_id", "lba"])
        return own.select("hash", (F.col("doc_id") * 64 + F.col("lba") + 8).alias("pba"))

    @property
    def reverse(self) -> DataFrame:
        """Without one in eleven, and with rows that have no entry."""
        kept = self.index.filter("pba % 11 <> 0").select("pba", "hash")
        extra = self.doc_blocks.filter("doc_id % 10 = 1").select((F.col("doc_id") * 64 + F.col("lba") + 8).alias("pba"), "hash")
        return kept.unionByName(extra).distinct()

    @property
    def index_counts(self) -> DataFrame:
        return self.index.select("pba", F.when(F.col("pba") % 7 == 0, 0).otherwise(1).cast("bigint").alias("refcount"))

    @property
    def fragments(self) -> DataFrame:
        docs = self.table("documents").filter("lang is not null")
        return docs.select(F.col("lang").alias("lane"), F.col("doc_id").alias("order_key"), (F.octet_length(F.coalesce("text", F.lit(""))) % 6000 + 1).cast("bigint").alias("size"))

    @property
    def requests(self) -> DataFrame:
        views = self.events.filter("event_type = 'view'")
        return views.select(F.col("event_id").alias("pos"), "vol_id", (F.col("event_id") * 37 % LBAS).alias("lba"))

    @property
    def ranges(self) -> DataFrame:
        e = self.events
        return e.select("event_id", (F.col("event_id") * 37 % 2000).alias("start"), (F.col("user_id") % 300 + 1).alias("count"))

    @property
    def byte_ranges(self) -> DataFrame:
        return self.events.select("event_id", (F.col("event_id") * 997 % 1_000_000).alias("offset"), (F.col("user_id") * 131 % 20_000).alias("length"))

    @property
    def log_lines(self) -> DataFrame:
        rows = self.table("conversations").filter("conv_id is not null and turn is not null")
        level = F.when(F.col("turn") % 5 == 0, "WARN").when(F.col("turn") % 7 == 3, "ERROR").otherwise("INFO")
        text = F.concat(F.lit("Pba("), (F.col("conv_id") % 9).cast("string"), F.lit(") at 0xff"), (F.col("turn") % 3).cast("string"), F.lit(" retry "), (F.col("conv_id") % 4).cast("string"), F.lit(" "), F.coalesce("role", F.lit("")), F.when(F.col("conv_id") % 5 == 0, " CRC mismatch").otherwise(""))
        return rows.select("conv_id", "turn", level.alias("level"), text.alias("msg")).distinct()


def _mapped(current: DataFrame) -> DataFrame:
    size = F.col("seq") * 37 % 20_000 + 1
    return current.select(
        "vol_id",
        "lba",
        (F.col("seq") + 8).alias("pba"),
        (F.col("seq") % 3).alias("compression"),
        size.alias("unit_compressed_size"),
        F.lit(32768).cast("bigint").alias("unit_original_size"),
        F.lit(8).cast("bigint").alias("unit_lba_count"),
        (F.col("lba") % 8).alias("offset_in_unit"),
        (F.col("seq") * 7919 % 4294967296).alias("crc32"),
        F.when(size < 4096, F.least(F.col("seq") % 4 * 16, 4096 - size)).otherwise(0).cast("bigint").alias("slot_offset"),
        F.when(F.col("seq") % 7 == 0, 1).otherwise(0).cast("bigint").alias("flags"),
        "seq",
    )


_MAPPED = """vol_id, lba, seq + 8 AS pba, seq % 3 AS compression, seq * 37 % 20000 + 1 AS unit_compressed_size, 32768::BIGINT AS unit_original_size,
 8::BIGINT AS unit_lba_count, lba % 8 AS offset_in_unit, seq * 7919 % 4294967296 AS crc32,
 (CASE WHEN seq * 37 % 20000 + 1 < 4096 THEN least(seq % 4 * 16, 4096 - (seq * 37 % 20000 + 1)) ELSE 0 END)::BIGINT AS slot_offset,
 (CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS flags, seq"""
_LATEST = "SELECT vol_id, lba, max(seq) AS seq FROM {} GROUP BY 1, 2"

#: In DuckDB's dialect, each after those that it uses.
VIEWS = {
    "ev": "SELECT event_id, user_id, event_type, value, 'vol-' || (user_id % 3) AS vol_id FROM events",
    "writes": "SELECT event_id AS seq, vol_id, (event_id * event_id + user_id) % 1024 AS lba FROM ev WHERE event_type IN ('click', 'purchase')",
    "vols": "SELECT vol_id, 4194304::BIGINT AS size_bytes, coalesce(max(CASE WHEN event_type = 'signup' THEN event_id END), 0)::BIGINT AS created_at FROM ev GROUP BY 1",
    "gens": "SELECT seq, w.vol_id, lba, (CASE WHEN seq % 11 = 0 THEN 0 WHEN seq % 5 = 0 THEN created_at - 1 ELSE created_at END)::BIGINT AS vol_created_at FROM writes w JOIN vols v ON w.vol_id = v.vol_id",
    "wlog": "SELECT seq, vol_id, lba AS start_lba, seq % 8 + 1 AS lba_count, lba % 4 AS shard, (seq % 17 <> 0 OR seq < 3000) AS flushed FROM writes",
    "mark1": "SELECT seq, start_lba, lba_count - (CASE WHEN seq % 4 = 0 THEN 1 ELSE 0 END) AS lba_count FROM wlog WHERE seq % 3 <> 0",
    "marks": "SELECT * FROM mark1 UNION ALL SELECT * FROM mark1 WHERE seq % 2 = 0",
    "uw": "SELECT event_id AS seq, vol_id, (event_id * event_id + user_id) % 128 * 8 + k AS lba FROM (SELECT *, unnest(range(0, CASE WHEN event_id % 3 = 0 THEN 8 ELSE 4 END)) AS k FROM ev WHERE event_type IN ('click', 'purchase'))",
    "bm": f"SELECT {_MAPPED} FROM ({_LATEST.format('uw')})",
    "bm0": f"SELECT {_MAPPED} FROM ({_LATEST.format('uw WHERE seq < 5000')})",
    "stored": "SELECT event_id + 8 AS pba, event_id % 5 + 1 AS refcount FROM events",
    "alloc": f"SELECT DISTINCT seq % 2048 + 8 AS pba FROM ({_LATEST.format('writes')})",
    "docb": "SELECT doc_id, lang AS vol_id, k AS lba, sha256(unhex(substr(hex(encode(text)), k * 8192 + 1, 8192))) AS hash FROM (SELECT doc_id, lang, text, unnest(range(0, (strlen(text) + 4095) // 4096)) AS k FROM documents)",
    "own": "SELECT hash, min(doc_id * 1000000 + lba) AS o FROM docb WHERE doc_id % 2 = 0 GROUP BY 1",
    "idx": "SELECT hash, (o // 1000000) * 64 + o % 1000000 + 8 AS pba FROM own",
    "rev": "SELECT pba, hash FROM idx WHERE pba % 11 <> 0 UNION SELECT doc_id * 64 + lba + 8, hash FROM docb WHERE doc_id % 10 = 1",
    "idxc": "SELECT pba, (CASE WHEN pba % 7 = 0 THEN 0 ELSE 1 END)::BIGINT AS refcount FROM idx",
    "frags": "SELECT lang AS lane, doc_id AS order_key, (strlen(coalesce(text, '')) % 6000 + 1)::BIGINT AS size FROM documents WHERE lang IS NOT NULL",
    "reqs": "SELECT event_id AS pos, vol_id, event_id * 37 % 1024 AS lba FROM ev WHERE event_type = 'view'",
    "rngs": "SELECT event_id, event_id * 37 % 2000 AS start, user_id % 300 + 1 AS count FROM ev",
    "bytes_": "SELECT event_id, event_id * 997 % 1000000 AS off, user_id * 131 % 20000 AS len FROM ev",
    "lines": "SELECT DISTINCT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'WARN' WHEN turn % 7 = 3 THEN 'ERROR' ELSE 'INFO' END AS level, 'Pba(' || (conv_id % 9) || ') at 0xff' || (turn % 3) || ' retry ' || (conv_id % 4) || ' ' || coalesce(role, '') || CASE WHEN conv_id % 5 = 0 THEN ' CRC mismatch' ELSE '' END AS msg FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL",
    "issues": "SELECT * FROM lines WHERE level IN ('WARN', 'ERROR') OR regexp_matches(lower(msg), 'panic|error|failed|failure|mismatch|corrupt|crc|overlap|rejected|timeout|drift')",
}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """A DuckDB query over the named views and those that they use."""
    import re

    needed: list[str] = []

    def need(name: str) -> None:
        if name not in needed:
            for other in VIEWS:
                if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
                    need(other)
            needed.append(name)

    for name in views:
        need(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed]
    joined = ", ".join(parts)
    return f"WITH {'RECURSIVE ' if recursive else ''}{joined}{', ' if body.startswith('+') else ' '}{body.removeprefix('+')}" if parts else body
