"""An append-only key-value log in Parquet, and a reader for 512-aligned record volumes."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = "seq long, key string, value binary"
ALIGN = 512
VOLUME_BYTES = 1 << 26  # a volume this long takes no further key


def append(batch: DataFrame, path: str) -> None:
    """One batch is one job; an empty value deletes its key."""
    batch.select(F.col("seq").cast("long").alias("seq"), "key", F.col("value").cast("binary").alias("value"), F.crc32(F.concat(F.col("key").cast("binary"), F.coalesce(F.col("value").cast("binary"), F.lit(b""))) ).alias("crc")).write.mode("append").parquet(path)


def replay(log: DataFrame) -> DataFrame:
    """(key, value, seq): the last write of each key, without deleted ones."""
    last = log.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    return last.filter(F.coalesce(F.octet_length("value"), F.lit(0)) > 0)


def replay_whole(log: DataFrame) -> DataFrame:
    """`replay` of what stands before the first row whose checksum doesn't match, as after a torn write."""
    torn = corrupt(log).agg(F.min("seq").alias("torn"))
    return replay(log.join(F.broadcast(torn)).filter(F.col("torn").isNull() | (F.col("seq") < F.col("torn"))).drop("torn"))  # one row


def put_many(spark: SparkSession, rows: list[tuple[int, str, bytes]], path: str) -> None:
    append(spark.createDataFrame(rows, LOG_SCHEMA), path)


def delete_key(spark: SparkSession, seq: int, key: str, path: str) -> None:
    """A write of an empty value."""
    put_many(spark, [(seq, key, b"")], path)


def get(log: DataFrame, key: str) -> DataFrame:
    """(key, value, seq) of one key; only its rows are read."""
    return replay(log.filter(F.col("key") == key))


def scan_prefix(log: DataFrame, prefix: str) -> DataFrame:
    """Live rows of the keys that begin so, in key order."""
    return replay(log.filter(F.col("key").startswith(prefix))).orderBy("key")


def snapshot(log: DataFrame, path: str) -> None:
    """The live rows with their checksum, and in each the sequence number that they stand for."""
    upto = log.agg(F.max("seq").alias("upto"))
    live = replay(log).join(F.broadcast(upto))  # one row
    live.withColumn("crc", F.crc32(F.concat(F.col("key").cast("binary"), "value"))).write.mode("overwrite").parquet(path)


def mount(log: DataFrame, saved: DataFrame | None) -> DataFrame:
    """`replay` from a snapshot and the rows after it; a snapshot that is empty, damaged or disagrees on what it stands for is not used."""
    if saved is None:
        return replay(log)
    seen = saved.agg(F.count(F.lit(1)).alias("n"), F.min("upto").alias("lo"), F.max("upto").alias("hi")).first()
    if not seen["n"] or seen["lo"] != seen["hi"] or not corrupt(saved).isEmpty():
        return replay(log)
    tail = log.filter(F.col("seq") > seen["hi"])
    return replay(saved.select("seq", "key", "value").unionByName(tail.select("seq", "key", "value")))


def checkpoint_working(memories: DataFrame, path: str) -> int:
    """Write the memories of layers 0 and 1, which live in the session only; returns how many."""
    rows = memories.filter("layer in (0, 1)")
    rows.write.mode("append").parquet(path)
    return rows.count()


def prune_working(memories: DataFrame) -> DataFrame:
    return memories.filter("layer not in (0, 1)")


def corrupt(log: DataFrame) -> DataFrame:
    """Rows whose checksum doesn't match."""
    return log.filter(F.crc32(F.concat(F.col("key").cast("binary"), F.coalesce("value", F.lit(b"")))) != F.col("crc"))


def compact(spark: SparkSession, path: str, into: str) -> DataFrame:
    """Write the live rows to another folder."""
    live = replay(spark.read.parquet(path))
    live.withColumn("crc", F.crc32(F.concat(F.col("key").cast("binary"), "value"))).write.mode("overwrite").parquet(into)
    return spark.read.parquet(into)


def encode_record(key: bytes, value: bytes) -> bytes:
    """A record: magic, key and value lengths, crc of key and value; padded to 512 bytes."""
    body = b"TKLV" + len(key).to_bytes(4, "little") + len(value).to_bytes(4, "little") + zlib.crc32(key + value).to_bytes(4, "little") + key + value
    return body + b"\0" * (-len(body) % ALIGN)


def pack_volumes(writes: Iterable[tuple[bytes, bytes]], full: int = VOLUME_BYTES) -> Iterator[bytes]:
    """Volumes of the (key, value) writes in order; writes of one key that follow each other stay in one volume, even if it is full."""
    out, last = bytearray(), None
    for key, value in writes:
        if len(out) >= full and key != last:
            yield bytes(out)
            out = bytearray()
        out += encode_record(key, value)
        last = key
    if out:
        yield bytes(out)


def scan_volume(data: bytes) -> tuple[list[tuple[str, bytes]], int]:
    """(records in order, corrupt records): after damage the scan goes on at the next 512-byte boundary."""
    at, out, bad = 0, [], 0
    while at + 16 <= len(data):
        if data[at : at + 4] != b"TKLV":
            bad += data[at : at + 4] not in (b"TKL\0", b"\0\0\0\0")
            at += ALIGN
            continue
        n, m = int.from_bytes(data[at + 4 : at + 8], "little"), int.from_bytes(data[at + 8 : at + 12], "little")
        key, value = data[at + 16 : at + 16 + n], data[at + 16 + n : at + 16 + n + m]
        if len(key) < n or len(value) < m or zlib.crc32(key + value) != int.from_bytes(data[at + 12 : at + 16], "little"):
            bad += 1
            at += ALIGN
            continue
        out.append((key.decode("utf-8", "replace"), value))
        at += -(-(16 + n + m) // ALIGN) * ALIGN
    return out, bad


def through_volumes(writes: DataFrame, full: int = VOLUME_BYTES) -> DataFrame:
    """(path, seq, key, value) of (seq, key, value) writes, encoded in volumes and read by their bytes; all writes of a key stand in one volume, in the order of `seq`."""

    def volumes(frames):
        own = TaskContext.get().partitionId()
        pairs = ((k.encode(), bytes(v)) for frame in frames for k, v in zip(frame["key"], frame["value"], strict=True))
        for n, data in enumerate(pack_volumes(pairs, full)):
            found, _ = scan_volume(data)
            yield pd.DataFrame({"path": f"volume-{own}-{n}", "seq": range(len(found)), "key": [k for k, _ in found], "value": [v for _, v in found]})

    rows = writes.select("seq", "key", F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"))
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(volumes, "path string, seq long, key string, value binary")


def live_records(records: DataFrame) -> DataFrame:
    """(path, key, value): the last record of each key in a volume; one without a value deletes it."""
    last = records.groupBy("path", "key").agg(F.max_by("value", "seq").alias("value"))
    return last.filter(F.octet_length("value") > 0)


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, key, value) of all whole records of volume files."""

    def decode(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                rows, _ = scan_volume(bytes(content))
                yield pd.DataFrame({"path": name, "seq": range(len(rows)), "key": [k for k, _ in rows], "value": [v for _, v in rows]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, "path string, seq long, key string, value binary")
