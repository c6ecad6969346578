"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own characters say so (CUT), so equal texts have equal chunks wherever they lie. Each distinct
chunk moves once: (identifier, chunk) pairs are made distinct map-side and then compared as whole texts, which verifies
that an identifier stands for one chunk. Documents are then compared by their ordered lists of identifiers alone.
Should two different chunks share an identifier, documents that hold one carry their text in the recipe as well.

Defined cases: a null text counts as empty and equals the empty text, whose recipe is empty; a null key is smaller than
any other; rows that repeat both text and key are each returned by dedup, and all marked as the key that stays, while
survivors keeps one of them; a very long text is taken whole, as a longer list of identifiers of chunks of at most 4096
characters; of ties (equal texts) the largest key stays; an empty table gives an empty result; other columns aren't read, whatever their names (dedup) or come along unchanged (survivors).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

#: At least 512 characters, up to the next end of a sentence or line; at most 4096.
CUT = r"(?s).{512,4095}?[.!?\n]|.{1,4096}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CUT), F.lit(0))


def _text(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`"), F.lit(""))


def clashing(df: DataFrame, text: str = "text", identifier: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Identifiers that stand for several different chunks: id."""
    pairs = df.select(F.explode(chunks(_text(text))).alias("chunk")).select(identifier(F.col("chunk")).alias("id"), "chunk").distinct()
    return pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")


def _matched(df: DataFrame, key: str, text: str, carry: list[str], identifier: Callable[[Column], Column]) -> DataFrame:
    ids, sha = F.transform(chunks(_text(text)), lambda c: identifier(c)), F.unhex(F.sha2(_text(text), 256))
    rows = df.select(F.col(f"`{key}`").alias("k"), ids.alias("ids"), sha.alias("sha"), _text(text).alias("own"), F.struct(*[F.col(f"`{c}`") for c in carry] or [F.lit(0)]).alias("row"))
    # n chunks have about n * n / 2**65 clashes: none here, some ten thousand among 10**12
    bad = materialise(clashing(df, text, identifier), "clashes")
    if bad.limit(1).count():
        hit = df.select(F.col(f"`{key}`").alias("k2"), sha.alias("sha2"), F.explode(ids).alias("id")).join(bad, "id", "left_semi").select("k2", "sha2").distinct()
        rows = rows.join(hit, F.col("k").eqNullSafe(F.col("k2")) & (F.col("sha") == F.col("sha2")), "left").withColumn("own", F.when(F.col("sha2").isNotNull(), F.col("own")).otherwise("")).drop("k2", "sha2")
    else:
        rows = rows.withColumn("own", F.lit(""))
    # written, so that a join with a group that a third of all rows share can be split
    groups = materialise(rows.groupBy("ids", "own").agg(F.max("k").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    single = F.col("n").isNull()
    return rows.join(groups, ["ids", "own"], "left").withColumns({"keep_id": F.when(single, F.col("k")).otherwise(F.col("last")), "group_size": F.coalesce("n", F.lit(1).cast("long"))})


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", identifier: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """For each row of df: key, keep_id, group_size, kept, text_sha256. Of equal texts the largest key stays."""
    return _matched(df, key, text, [], identifier).select(
        F.col("k").alias(key), "keep_id", "group_size", F.col("k").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def survivors(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay, with all its columns. Of rows that repeat both text and key one stays, any."""
    kept = _matched(df, key, text, df.columns, F.xxhash64).where(F.col("k").eqNullSafe(F.col("keep_id")))
    pairs = df.select(F.col(f"`{key}`").alias("k"), F.xxhash64(_text(text)).alias("h"))
    if pairs.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["k", "sha"])  # a second exchange of what stays, for tables with such rows only
    return kept.select("row.*")
