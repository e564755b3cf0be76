"""Tables in Parquet, and how change is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockprism import schemas

SCHEMAS = {"volumes": schemas.VOLUMES, "blockmap": schemas.BLOCKMAP, "refcount": schemas.REFCOUNT, "dedup_index": schemas.DEDUP_INDEX, "dedup_reverse": schemas.DEDUP_REVERSE, "write_log": schemas.WRITE_LOG, "shard_checkpoint": schemas.SHARD_CHECKPOINT}


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A metadata table by its declared schema: no inference, and columns and rows are pruned in the scan."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def write(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """One atomic commit.  Volumes of a block map are directories, each in order of addresses, so ranges prune."""
    out = df.select(*(F.col(n).cast(t) for n, t in schemas.fields(SCHEMAS[name])))
    if name == "blockmap":
        out.repartitionByRange("vol_id", "lba").sortWithinPartitions("vol_id", "lba").write.mode(mode).partitionBy("vol_id").parquet(f"{root}/{name}")
    else:
        out.write.mode(mode).parquet(f"{root}/{name}")


def list_volumes(volumes: DataFrame) -> DataFrame:
    """In order; a row without a name or size is an error."""
    bad = F.col("vol_id").isNull() | F.col("size_bytes").isNull()
    return volumes.withColumn("vol_id", F.when(bad, F.raise_error(F.lit("bad volume row"))).otherwise(F.col("vol_id"))).orderBy("vol_id")


def volume(volumes: DataFrame, vol_id: str) -> DataFrame:
    return volumes.filter(F.col("vol_id") == vol_id)


def dedup_entries(index: DataFrame) -> DataFrame:
    """Entries whose hash has 32 bytes."""
    return index.filter(F.octet_length("hash") == 32)


def device_blocks(blocks: DataFrame, reads: DataFrame) -> DataFrame:
    """``reads`` ``(id, pba, size)`` from a table of blocks ``(pba, data)``: whole blocks are read, the size is returned."""
    wanted = reads.select("id", "size", F.posexplode(F.expr("sequence(pba, pba + (size + 4095) div 4096 - 1)")).alias("k", "pba"))
    got = wanted.join(blocks, "pba").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("k", F.hex("data").alias("data")))).alias("parts"))
    whole = F.unhex(F.array_join(F.transform("parts", lambda p: p["data"]), ""))
    return got.select("id", F.substring(whole, F.lit(1), F.col("size").cast("int")).alias("data"))


def status_json(**parts: DataFrame) -> DataFrame:
    """One JSON document of one-row tables."""
    from functools import reduce

    one = [df.select(F.struct("*").alias(name)).withColumn("_k", F.lit(1)) for name, df in parts.items()]
    return reduce(lambda a, b: a.join(b, "_k"), one).select(F.to_json(F.struct(*parts)).alias("json"))


def volumes_json(volumes: DataFrame) -> DataFrame:
    """All volumes as one JSON list in order of their names; a store has few."""
    rows = F.array_sort(F.collect_list(F.struct("vol_id", *(c for c in volumes.columns if c != "vol_id"))))
    return volumes.agg(F.to_json(rows).alias("json"))
