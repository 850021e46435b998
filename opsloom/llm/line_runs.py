"""Line deduplication over levelled sorted runs of line hashes.

A run is a Parquet table bucketed and sorted by line hash, with one row per hash:
in how many documents of the run it is found, and which one holds it. All runs have the
same buckets, so a run meets another, or a new batch, by a merge of sorted buckets:
only the batch is shuffled. Every batch adds a run to level 0; when a level has
``fanout`` runs, they are merged into one run of the next level. So a batch meets
at most ``fanout - 1`` runs per level, and a hash is rewritten once per level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import release, scratch, scratch_path, stored
from .sizes import counted

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased (and only those)."""
    body = F.btrim(line, F.lit(BLANK))
    ascii_only = F.length(body) == F.octet_length(body)
    return F.when(ascii_only, F.lower(body)).otherwise(F.translate(body, _UPPER, _LOWER))


def hashed(key: Column) -> Column:
    """128 bits that stand for a line."""
    return F.unhex(F.md5(key))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The levels of runs, and what becomes of a batch that meets them."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 3):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []
        self.tables: list[tuple[str, str]] = []

    def release(self) -> None:
        """Remove the runs, those that were merged included."""
        for name, path in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            release(self.spark, path)

    def _run(self, rows: DataFrame) -> DataFrame:
        """Write rows with unique keys as a sorted run."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, "line-run")
        self.tables.append((name, path))
        # dealt by the bucket's own hash, so that every bucket is one sorted file
        dealt = rows.repartition(self.buckets, "key").sortWithinPartitions("key")
        dealt.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).format("parquet").saveAsTable(name)
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Take a batch of (key, doc_id), distinct, whose documents no earlier batch had.

        The batch is anti-joined against the runs: a key that none has gets its holder
        (the largest doc_id) from this batch. A key that a run has is only counted,
        so batches are given from the largest doc_id down.
        """
        counted = batch.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("holder"))
        fresh = counted
        for run in self.runs():
            seen = run.where("holder is not null").select(F.col("key").alias("k"), F.lit(True).alias("seen"))
            fresh = fresh.join(seen, F.col("key") == F.col("k"), "left").drop("k")
            fresh = fresh.withColumn("holder", F.when(F.col("seen").isNull(), F.col("holder"))).drop("seen")
        self._push(0, self._run(fresh))

    def _push(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            merged, self.levels[level] = self.merged(self.levels[level]), []
            self._push(level + 1, self._run(merged))

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        """One row per key over several runs: counts add up, one run has the holder."""
        both = runs[0]
        for run in runs[1:]:
            other = run.select(F.col("key").alias("k"), F.col("n").alias("m"), F.col("holder").alias("h"))
            both = both.join(other, F.col("key") == F.col("k"), "full").select(
                F.coalesce("key", "k").alias("key"),
                (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"),
                F.coalesce("holder", "h").alias("holder"),
            )
        return both


def dedup_lines(
    docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 6, fanout: int = 3
) -> DataFrame:
    """The documents with ``n_lines``, ``n_dropped`` and ``kept_text``.

    Lines are what \\n separates. The key of a line is the line without white space at
    both ends, A-Z lower-cased. Keys of ``min_chars`` code points or more that are in
    ``min_docs`` documents or more lose all their lines, except in the largest
    doc_id that holds them. The other lines stay, joined by \\n.

    The documents come in ``batches`` ranges of doc_id, the largest first (they could be
    days of a crawl); the line hashes of a batch meet the runs of the earlier
    ones. At the end one merge of the runs gives the counts. A frequent line is
    reduced in the map tasks; where its lines meet the verdict, AQE splits the join.

    Null or empty texts are one empty line. Rows with the same doc_id count as
    one document. Rows without doc_id count for nothing and lose nothing. An empty table
    gives an empty table. Columns with the result's names are replaced.
    """
    spark = docs.sparkSession
    parts = F.transform(F.filter(lines(F.col("text")), lambda x: F.length(x) >= min_chars), line_key)
    found = docs.where("doc_id is not null").select("doc_id", F.explode(F.array_distinct(parts)).alias("line"))
    found = found.where(F.length("line") >= min_chars).select("doc_id", hashed(F.col("line")).alias("key"))
    ends = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    width = (hi - lo) // batches + 1
    path = scratch_path(spark, "line-hashes")
    number = F.expr(f"cast((doc_id - {lo}L) div {width}L as int)")
    runs = LineRuns(spark, fanout=fanout)
    try:
        found.withColumn("batch", number).write.partitionBy("batch").parquet(path)
        table = spark.read.schema("doc_id long, key binary, batch int").parquet(path)
        for b in reversed(range(batches)):
            runs.add(table.where(F.col("batch") == b).select("key", "doc_id").distinct())
        frequent = LineRuns.merged(runs.runs()).where(F.col("n") >= min_docs)
        with scratch(spark):
            frequent = stored(frequent.select(F.col("key").alias("k"), "holder"), "line-verdicts")
            goes = table.join(frequent, F.col("key") == F.col("k")).where("doc_id <> holder")
            per_doc = stored(goes.groupBy("doc_id").agg(F.collect_set("key").alias("__gone")), "line-gone", keep=True)
    finally:
        runs.release()
        release(spark, path)
    per_doc = counted(per_doc.withColumnRenamed("doc_id", "__i"), weight=1 + F.size("__gone"))
    base = docs.drop("n_lines", "n_dropped", "kept_text")
    out = base.join(per_doc, F.col("doc_id") == F.col("__i"), "left")
    split = lines(F.col("text"))
    stays = F.filter(
        split,
        lambda x: (F.length(x) < min_chars) | ~F.array_contains(F.col("__gone"), hashed(line_key(x))),
    )
    kept = F.when(F.col("__gone").isNull(), split).otherwise(stays)
    return (
        out.withColumn("__kept", kept)
        .withColumn("n_lines", F.size(split).cast("long"))
        .withColumn("n_dropped", (F.size(split) - F.size("__kept")).cast("long"))
        .withColumn("kept_text", F.array_join("__kept", "\n"))
        .drop("__i", "__gone", "__kept")
    )
