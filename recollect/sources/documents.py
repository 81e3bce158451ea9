"""Import of stored document records: magic, layer, key, clock, payload and sign bits in one run of bytes."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame

MAGIC = b"NMD1"  # fixed value of the format
FIXED_NODES = 8
SCHEMA = "layer int, key string, clock map<int,bigint>, payload binary, bits array<long>, error string"


def encode(layer: int, key: str, clock: dict[int, int], payload: bytes, bits: list[int] | None) -> bytes:
    """A record; the clock is FIXED_NODES node bytes and their counters, free places counting 0."""
    name, held = key.encode(), sorted(clock.items())
    if len(held) > FIXED_NODES:
        raise ValueError(f"a record's clock has {FIXED_NODES} nodes; further ones are metadata")
    held += [(0, 0)] * (FIXED_NODES - len(held))
    out = [MAGIC, bytes([layer]), struct.pack("<I", len(name)), name, bytes(n for n, _ in held), struct.pack(f"<{FIXED_NODES}Q", *(c for _, c in held))]
    out += [struct.pack("<I", len(payload)), payload, b"\0" if bits is None else b"\1" + struct.pack(f"<I{len(bits)}q", len(bits), *bits)]
    return b"".join(out)


def decode(data: bytes) -> tuple:
    """The fields of SCHEMA; what is cut short or wrong has only an error."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("cut short")
        at += n
        return data[at - n : at]

    try:
        if take(4) != MAGIC:
            raise ValueError("no document")
        layer = take(1)[0]
        if layer > 7:
            raise ValueError("no layer")
        key = take(struct.unpack("<I", take(4))[0]).decode()
        nodes, counters = take(FIXED_NODES), struct.unpack(f"<{FIXED_NODES}Q", take(8 * FIXED_NODES))
        clock = {n: c for n, c in zip(nodes, counters, strict=True) if c}
        payload = take(struct.unpack("<I", take(4))[0])
        bits = None
        if take(1) == b"\1":
            n = struct.unpack("<I", take(4))[0]
            bits = list(struct.unpack(f"<{n}q", take(8 * n)))
        return layer, key, clock, payload, bits, None
    except (ValueError, struct.error) as e:
        return None, None, None, None, None, "no UTF-8" if isinstance(e, UnicodeDecodeError) else str(e)


def decode_documents(records: DataFrame, column: str = "value") -> DataFrame:
    """SCHEMA of each record in a binary column."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([decode(bytes(v or b"")) for v in frame[column]], columns=["layer", "key", "clock", "payload", "bits", "error"])

    return records.select(column).mapInPandas(run, SCHEMA)
