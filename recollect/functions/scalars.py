"""Scalar expressions: tokens, keys, content types, sign quantisation, clocks."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The importance a layer gives, and the order in which layers are asked for a raw key.
LAYER_IMPORTANCE = {0: 0.0, 1: 0.0, 2: 0.2, 3: 0.4, 4: 1.0, 5: 0.8, 6: 0.5, 7: 1.0}
RESOLVE_ORDER = (4, 5, 3, 2, 6, 0, 1, 7)
# Words that hint at program code.
CODE_WORDS = ["fn ", "impl ", "struct ", "enum ", "trait ", "def ", "class ", "func ", "function ", "return ", "=> "]
# Queries that ask nothing, and how a statement worth keeping begins.
TRIVIAL = ["ok", "okay", "sim", "não", "obrigado", "thanks", "hi", "hello"]
CAPTURED = {"preference": ["i prefer ", "eu prefiro "], "decision": ["we decided ", "decidimos "], "constraint": ["constraint:", "restrição:"]}
LEAST_CAPTURED, MOST_CAPTURED = 12, 2000
# The labels of content types.
LABELS = ["text", "json", "code", "embedding", "binary"]
PROSE = ["text", "json", "code"]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def tokens(text: Column) -> Column:
    """Runs of letters and numbers, only A-Z lower-cased."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def normalized(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def padded(x: Column, width: int = 8) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def time_key(ts: Column) -> Column:
    """`ts/` and 16 hexadecimal digits: the order of keys is that of times."""
    return F.concat(F.lit("ts/"), F.lpad(F.lower(F.hex(ts)), 16, "0"))


def time_of_key(sk: Column) -> Column:
    digits = F.regexp_extract(sk, r"(?:^|/)ts/([0-9a-f]{1,16})", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("long"))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def cut_bytes(text: Column, limit: int = 200) -> Column:
    """At most `limit` bytes, cut between characters, `…` behind a cut."""
    ends = F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("s"), F.lit(True).alias("open")),
        lambda a, c: F.when(a["open"] & (F.octet_length(a["s"]) + F.octet_length(c) <= limit), F.struct(F.concat(a["s"], c).alias("s"), F.lit(True).alias("open"))).otherwise(F.struct(a["s"].alias("s"), F.lit(False).alias("open"))),
    )["s"]
    ascii_cut = F.left(text, F.lit(limit))
    plain = F.octet_length(F.left(text, F.lit(limit + 1))) == F.length(F.left(text, F.lit(limit + 1)))
    return F.when(F.octet_length(text) <= limit, text).when(plain, F.concat(ascii_cut, F.lit("…"))).otherwise(F.concat(ends, F.lit("…")))


def looks_like_code(text: Column) -> Column:
    low = ascii_lower(text)
    hits = reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in CODE_WORDS])
    return (hits > 0) & ((hits >= 2) | text.rlike(r"[{};]|->"))


def content_type(text: Column, dim: Column | None = None) -> Column:
    """The label of a payload: declared dimension, else JSON by its ends, else code, else text."""
    inner = F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))
    ends = (inner.startswith("{") & inner.endswith("}")) | (inner.startswith("[") & inner.endswith("]"))
    found = F.when((F.length(inner) >= 2) & ends, "json").when(looks_like_code(inner), "code").otherwise("text")
    return found if dim is None else F.when(dim.isNotNull(), "embedding").otherwise(found)


def opaque_scope(*parts: str) -> str:
    """`name/<encoded value>` pairs joined by `/`; everything but unreserved characters is percent-encoded."""
    from urllib.parse import quote

    return "/".join(f"{name}/{quote(value, safe='')}" for name, value in zip(("tenant", "agent", "workspace"), parts, strict=False))


def is_trivial(text: Column) -> Column:
    """Whether a query asks nothing: empty, a command, or a bare courtesy."""
    clean = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    return (clean == "") | clean.startswith("/") | clean.isin(TRIVIAL)


def capture_class(text: Column) -> Column:
    """What a statement is about, by how it begins; null for what isn't captured."""
    clean = F.regexp_replace(text, r"^\s+|\s+$", "")
    low, kind = F.lower(clean), F.lit(None).cast("string")
    for name, begins in reversed(CAPTURED.items()):
        kind = F.when(reduce(lambda a, b: a | b, [low.startswith(b) for b in begins]), name).otherwise(kind)
    return F.when(F.length(clean) >= LEAST_CAPTURED, kind)


def captured_text(text: Column) -> Column:
    return F.left(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit(MOST_CAPTURED))


def embedding_dim(payload: Column, has_bits: Column) -> Column:
    """How many 32-bit floats a payload holds, if it may be a vector."""
    n = F.octet_length(payload)
    return F.when((n % 4 == 0) & (has_bits | (n >= 4)), (n / 4).cast("int"))


def payload_type(payload: Column, dim: Column | None = None) -> Column:
    """The label of binary content: a declared dimension, `binary` unless it is UTF-8, else what its text looks like."""
    found = F.when(F.is_valid_utf8(payload.cast("string")), content_type(payload.cast("string"))).otherwise("binary")
    return found if dim is None else F.when(dim.isNotNull(), "embedding").otherwise(found)


def resolved_type(declared: Column, text: Column, fallback: Column) -> Column:
    """What the writer declared, else what the text looks like, else the payload's type."""
    return F.when(declared.isNotNull(), declared).when(F.coalesce(F.length(text), F.lit(0)) == 0, fallback).otherwise(content_type(text))


def renders_prose(label: Column) -> Column:
    return label.isin(PROSE)


def checked_label(label: Column) -> Column:
    return F.when(label.isNull() | label.isin(LABELS), label).otherwise(F.raise_error(F.concat(F.lit("no content type: "), label)))


def grounding(query: list[str], hit_tokens: Column) -> Column:
    """How many query tokens stand in a hit, duplicates counted."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in query]), lambda t: F.array_contains(hit_tokens, t)))


def sign_words(v: Column, dims: int, centered: bool = False) -> list[Column]:
    """One BIGINT per 64 components; bit i says whether component i is above 0 (or above the mean)."""
    low = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v) if centered else F.lit(0.0)

    def word(w):
        bits = F.transform(F.slice(v, 64 * w + 1, 64), lambda x, i: F.when(x > low, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return [word(w) for w in range(-(-dims // 64))]


def query_words(v: list[float], centered: bool = False) -> list[int]:
    """The same bits of a query vector, as signed integers."""
    low = sum(v) / len(v) if centered else 0.0
    out = []
    for at in range(0, len(v), 64):
        bits = sum(1 << i for i, x in enumerate(v[at : at + 64]) if x > low)
        out.append(bits - (1 << 64) if bits >= 1 << 63 else bits)
    return out


def hamming(words: list[Column], query: list[int]) -> Column:
    """Differing bits; a missing word counts as zero, so a longer tail counts its own bits."""
    n = max(len(words), len(query))
    padded_words = words + [F.lit(0).cast("long")] * (n - len(words))
    padded_query = query + [0] * (n - len(query))
    return reduce(lambda a, b: a + b, [F.bit_count(w.bitwiseXOR(F.lit(q).cast("long"))) for w, q in zip(padded_words, padded_query, strict=True)]).cast("int")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(v: Column, q: Column) -> Column:
    """1 - cosine, the cosine clamped to [-1, 1]."""
    return 1 - clamp(_dot(v, q) / (F.sqrt(_dot(v, v) * _dot(q, q)) + 1e-8), -1.0, 1.0)


def literal_vector(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def oversample(dims: int) -> int:
    """Candidates per wanted hit, by the width of the quantised vector."""
    words = -(-dims // 64)
    return 16 if words <= 1 else 8 if words <= 4 else 4


def clock_of(clock: Column, node) -> Column:
    return F.coalesce(F.get(F.map_values(F.map_filter(clock, lambda k, _: k == node)), 0), F.lit(0).cast("long"))


def clock_merge(a: Column, b: Column) -> Column:
    """Per-node maximum."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0).cast("long")), F.coalesce(y, F.lit(0).cast("long"))))


def clock_order(a: Column, b: Column) -> Column:
    """`equal`, `before`, `after` or `concurrent`; an absent node counts as 0."""
    zero = F.lit(0).cast("long")
    both = F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.struct(F.coalesce(x, zero).alias("x"), F.coalesce(y, zero).alias("y"))))
    less, more = F.exists(both, lambda e: e["x"] < e["y"]), F.exists(both, lambda e: e["x"] > e["y"])
    return F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal")
