"""Point access, prefix scans, pagination, key checks and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def get(memories: DataFrame, layer: int, key: str) -> DataFrame:
    return memories.filter(F.col("sk") == f"md/L{layer}/{key}")


def scan_prefix(memories: DataFrame, prefix: str) -> DataFrame:
    return memories.filter(F.col("sk").startswith(prefix)).orderBy("sk")


def scan_prefix_page(memories: DataFrame, prefix: str, offset: int, size: int) -> DataFrame:
    return scan_prefix(memories, prefix).offset(offset).limit(size)


def cursor_page(memories: DataFrame, prefix: str, offset: int, size: int) -> DataFrame:
    """A page with `next_cursor`, null on the last page; one row more is read to know."""
    rows = scan_prefix(memories, prefix).select("sk").offset(offset).limit(size + 1)
    numbered = rows.withColumn("r", F.row_number().over(Window.orderBy("sk")))  # size + 1 rows
    more = F.max("r").over(Window.partitionBy()) > size
    return numbered.withColumn("next_cursor", F.when(more, F.lit(offset + size))).filter(F.col("r") <= size).drop("r")


def batch_texts(keys: DataFrame, memories: DataFrame) -> DataFrame:
    """(sk, text) of distinct keys; a missing one has an empty text."""
    return keys.select("sk").distinct().join(memories.select("sk", "text"), "sk", "left").select("sk", F.coalesce("text", F.lit("")).alias("text"))


def resolve(keys: DataFrame, memories: DataFrame) -> DataFrame:
    """(key, sk): the first layer, in the fixed order, that has a raw key."""
    place = F.create_map(*[F.lit(x) for pair in ((layer, at) for at, layer in enumerate(S.RESOLVE_ORDER)) for x in pair])
    held = memories.select("key", "sk", place[F.col("layer")].alias("place"))
    return keys.select("key").distinct().join(held, "key", "left").groupBy("key").agg(F.min_by("sk", "place").alias("sk"))


def prefix_conflicts(keys: DataFrame) -> DataFrame:
    """(sk, other): keys that are a proper prefix of another key.

    Keys are joined with the cuts of other keys at existing key lengths, so nothing is sorted in one task.
    """
    own = keys.select("sk").distinct()
    lengths = own.agg(F.collect_set(F.length("sk")).alias("lengths"))  # at most 4096 lengths
    cuts = own.crossJoin(F.broadcast(lengths)).select(F.col("sk").alias("other"), F.explode(F.filter("lengths", lambda n: n < F.length("sk"))).alias("n"))
    cuts = cuts.select("other", F.expr("left(other, n)").alias("sk"))
    return cuts.join(own, "sk").select("sk", "other")


def bad_keys(keys: DataFrame) -> DataFrame:
    """Keys that may not be written: empty, too long, with `#`, control characters, or `.` and `..` parts."""
    k = F.col("key")
    why = F.when(F.length(k) == 0, "empty").when(F.octet_length(k) > 4096, "long").when(k.contains("#"), "hash").when(k.rlike(r"[\x00-\x1f\x7f]"), "control").when(k.rlike(r"(^|/)\.{1,2}(/|$)"), "dots")
    return keys.select("key", why.alias("why")).filter("why is not null")


def parse_uri(uris: DataFrame) -> DataFrame:
    pattern = r"^memory://L([0-7])/(.+)$"
    return uris.select("uri", F.regexp_extract("uri", pattern, 1).alias("layer"), F.regexp_extract("uri", pattern, 2).alias("key")).filter("layer <> ''")


def keys_for_clock(replicas: DataFrame, node: int, counter: int) -> DataFrame:
    return replicas.select("sk", F.explode("remote_clock").alias("node", "counter")).filter((F.col("node") == node) & (F.col("counter") == counter)).select("sk")
