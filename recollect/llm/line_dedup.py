"""Removal of lines that many documents share.

A text is split at `\\n`; a null or empty text is one empty line.  A line's key is
the line without white space `[\\x20\\x09-\\x0D]` at both ends and with A-Z
lower-cased.  Keys of at least `min_chars` code points found in at least `min_docs`
distinct documents lose all their lines except those in the largest document id
that holds them.  Keys are compared by two independent 64-bit hashes.

Rows repeated under one id count as one document for a key and keep their own rows
in the result.  A null id is not a document: its lines never count and always stay.
An empty table gives an empty result; extra columns are ignored unless `keep` names
them.  All work is done by built-in expressions; a key that sits in a third of all
documents is counted by partial aggregation.  The `COMMON_SENT` keys of most documents are
broadcast to the lines, so no hot key is dealt to one task; keys beyond that number are
each in few lines and join by a shuffle.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import join_hot, materialize

MARGIN = " \t\n\x0b\x0c\r"
COMMON_SENT = 500_000


def _lower_ascii(text: Column) -> Column:
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def shared_lines(docs: DataFrame, min_chars: int, min_docs: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, pos) of the lines that go."""
    lines = (
        docs.filter(F.col(id_col).isNotNull() & (F.length(text_col) >= min_chars))
        .select(
            F.col(id_col).alias("id"),
            F.xxhash64(text_col).alias("text_key"),
            F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"),
        )
        .filter(F.length("line") >= min_chars)
        .select("id", "text_key", "pos", F.btrim("line", F.lit(MARGIN)).alias("line"))
        .filter(F.length("line") >= min_chars)
        .withColumn("line", _lower_ascii(F.col("line")))
        .select("id", "text_key", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    )
    held = lines.select("h1", "h2", "id").distinct()
    common = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    common = materialize(common.filter(F.col("n") >= min_docs))
    found = join_hot(lines, common, ["h1", "h2"], "n", COMMON_SENT)
    return found.filter(F.col("id") < F.col("last")).select("id", "text_key", "pos")


def drop_shared_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """(id, n_lines, n_dropped, kept text, `keep` columns), one row for each input row."""
    gone = (
        shared_lines(docs, min_chars, min_docs, id_col, text_col)
        .groupBy("id", "text_key")
        .agg(F.collect_set("pos").alias("gone"))
        .withColumnsRenamed({"id": "_id", "text_key": "_key", "gone": "_gone"})
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col), text.alias(text_col), *keep)
    joined = base.join(gone, (F.col(id_col) == F.col("_id")) & (F.xxhash64(text_col) == F.col("_key")), "left")
    parts = F.split(F.col(text_col), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    rebuilt = joined.withColumn("_parts", F.when(F.col("_gone").isNotNull(), parts))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("_parts"), i)), "\n")
    return rebuilt.select(
        id_col,
        (F.octet_length(text_col) - F.octet_length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept).alias(text_col),
        *keep,
    )
