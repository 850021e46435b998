"""Exact duplicates by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch, stored
from .sizes import counted

PREFIX = 256


def normal(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _rows(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id"), F.length(text).alias("n"), normal(F.col("text")).alias("body"), *more).withColumn("len", F.length("body"))


def _prefix() -> Column:
    return F.xxhash64(F.substring("body", 1, PREFIX))


def shared_lengths(rows: DataFrame) -> DataFrame:
    """The first stage: (k_len) that two rows or more have. Summed in the map tasks, so no length is hot."""
    return rows.groupBy("len").count().where("count > 1").select(F.col("len").alias("k_len"))


def shared_prefixes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """The second stage: (p_len, p_pre) that two rows or more have; only rows of a shared length are hashed."""
    left = rows.join(counted(lengths), F.col("len") == F.col("k_len"), "left_semi").select("len", _prefix().alias("pre"))
    return left.groupBy("len", "pre").count().where("count > 1").select(F.col("len").alias("p_len"), F.col("pre").alias("p_pre"))


def resolve(docs: DataFrame, digest_all: bool = False, raw_hash: bool = False) -> DataFrame:
    """One row per document: which row of its group of equal texts stays.

    Texts are equal if they are the same without white space. Lengths are counted
    first; of the rows whose length occurs twice or more the first 256
    characters are hashed; only rows that share both with another are hashed in full, by
    SHA-256. Groups are reduced in the map tasks; the joins are equi joins that AQE
    splits where one group holds many rows.

    Result: doc_id, keep_id, group_size, kept, digest (binary; null for a text that stands alone unless
    ``digest_all``, which hashes those for the result only), and with ``raw_hash`` h, a hash of the raw text. The row with
    the most code points in the raw text stays, then the smallest doc_id (null
    last), then any one of the repeated rows. Null counts as empty, and empty texts are
    equal. Extra columns are not read.
    """
    with scratch(docs.sparkSession):
        return _resolve(docs, digest_all, raw_hash)


def _resolve(docs: DataFrame, digest_all: bool, raw_hash: bool) -> DataFrame:
    more = [F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h")] if raw_hash else []
    names = ["doc_id", *(["h"] if raw_hash else [])]
    lengths = stored(shared_lengths(_rows(docs)), "dedup-lengths")
    keys = stored(shared_prefixes(_rows(docs), lengths), "dedup-keys")
    rows = _rows(docs, *more).join(counted(lengths), F.col("len") == F.col("k_len"), "left")
    rows = rows.withColumn("pre", F.when(F.col("k_len").isNotNull(), _prefix()))
    hashed = rows.join(counted(keys), (F.col("len") == F.col("p_len")) & (F.col("pre") == F.col("p_pre")), "left")
    shared, full = F.col("p_len").isNotNull(), F.unhex(F.sha2("body", 256))
    hashed = stored(
        hashed.select(
            *names, "n", "len", shared.alias("shared"), (full if digest_all else F.when(shared, full)).alias("digest")
        ).withColumn("rid", F.monotonically_increasing_id()),
        "dedup-hashed",
    )
    # complements fall where ids rise, for every long
    best = F.max(F.struct("n", F.bitwise_not("doc_id").alias("neg"), (-F.col("rid")).alias("rid")))
    groups = (
        hashed.where("shared")
        .groupBy("len", "digest")
        .agg(best.alias("b"), F.count(F.lit(1)).alias("group_size"))
        .select("len", "digest", F.bitwise_not(F.col("b.neg")).alias("keep_id"), (-F.col("b.rid")).alias("keep_rid"), "group_size")
    )
    groups = stored(groups, "dedup-groups")
    cols = [*names, "keep_id", "group_size", "kept", "digest"]
    joined = hashed.where("shared").join(groups, ["len", "digest"]).withColumn("kept", F.col("rid") == F.col("keep_rid"))
    alone = hashed.where("not shared").select(
        *names, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    return stored(joined.select(*cols).unionByName(alone), "dedup-rows", keep=True)


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns.

    Rows that go are taken out by (doc_id, raw text). Of repeated rows with the same
    doc_id and text one stays; they are looked at apart, only if there are any.
    """
    per = resolve(docs, raw_hash=True).groupBy("doc_id", "h").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    out = stored(per.where("not stays or n > 1").select(F.col("doc_id").alias("__i"), F.col("h").alias("__h"), "stays"), "dedup-out", keep=True)
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    same = F.col("doc_id").eqNullSafe(F.col("__i")) & (own == F.col("__h"))
    left = docs.join(counted(out), same, "left_anti")
    again = out.where("stays")
    if again.isEmpty():
        return left
    once = docs.join(again, same, "left_semi").withColumn("__h", own).dropDuplicates(["doc_id", "__h"]).drop("__h")
    return left.unionByName(once)
