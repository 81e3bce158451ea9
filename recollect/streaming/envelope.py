"""Signed envelopes: node, payload and an opaque signature as bytes, checked where they come in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashes import keyed_signature

HEAD = 9  # fixed format: node byte, payload and signature lengths (32 bits each, lowest byte first), payload, signature
Signer = Callable[[Column], Column]


def demo_signer(key: int) -> Signer:
    """Eight bytes that depend on payload and key; for tests of the flow only."""

    @F.pandas_udf(T.BinaryType())
    def sign(payload: pd.Series) -> pd.Series:
        return pd.Series([int(h).to_bytes(8, "little") for h in keyed_signature([bytes(p) for p in payload], key)], dtype=object)

    return sign


def _length(n: Column) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)]))


def _read(data: Column, at: int) -> Column:
    part = lambda k: F.conv(F.hex(F.substring(data, at + 1 + k, 1)), 16, 10).cast("long")
    return sum((part(k) * (1 << 8 * k) for k in range(1, 4)), part(0))


def seal(packets: DataFrame, signer: Signer) -> DataFrame:
    """(node, envelope) of (node, payload)."""
    signed = packets.select("node", F.col("payload").cast("binary").alias("payload")).withColumn("auth", signer(F.col("payload")))
    head = F.concat(F.unhex(F.lpad(F.hex(F.col("node")), 2, "0")), _length(F.octet_length("payload")), _length(F.octet_length("auth")))
    return signed.select("node", F.concat(head, "payload", "auth").alias("envelope"))


def open_envelopes(rows: DataFrame, signer: Signer) -> DataFrame:
    """(envelope, node, payload, valid): cut short or changed envelopes are not valid and have no payload."""
    data = F.col("envelope")
    whole = rows.select(data, F.octet_length(data).alias("size")).withColumns({"n": F.when(F.col("size") >= HEAD, _read(data, 1)), "m": F.when(F.col("size") >= HEAD, _read(data, 5))})
    fits = F.coalesce(F.col("n") + F.col("m") + HEAD <= F.col("size"), F.lit(False))
    n = F.when(fits, F.col("n")).otherwise(0).cast("int")
    m = F.when(fits, F.col("m")).otherwise(0).cast("int")
    parts = whole.select("envelope", F.when(fits, F.conv(F.hex(F.substring(data, 1, 1)), 16, 10).cast("int")).alias("node"), fits.alias("fits"), F.substring(data, F.lit(HEAD + 1), n).alias("payload"), F.substring(data, F.lit(HEAD + 1) + n, m).alias("auth"))
    valid = F.col("fits") & (signer(F.col("payload")) == F.col("auth"))
    judged = parts.withColumn("valid", valid)
    return judged.select("envelope", "node", F.when(F.col("valid"), F.col("payload")).alias("payload"), "valid")
