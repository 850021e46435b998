"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch, stored

WORD = r"[^\x20\x09-\x0D]+"
PLAN = ("__mix_whole", "__mix_end", "__mix_part", "__mix_of")  # columns that meet the caller's
DIGITS = 3  # hex digits that one descent resolves: at most 4096 sums per source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """(source, weight): sources by code point, null last, take the weights in turn."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return sources.select("source", F.element_at(cycle, (rank % len(weights) + 1).cast("int")).alias("weight"))


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """(source, source_size, weight) to the same with ``target``.

    The sources share ``share`` times all sizes by weight. A source is clamped at
    ``max_epochs`` times its size and the excess goes to the others by weight, until
    none is above. In the order of cap over weight the clamped sources are a
    prefix, so the rounds have a closed form: a source is clamped if its cap is not
    above its part of what the sources before it leave. One row per source; if all
    are clamped, every target is its cap. Sources with weight 0 get 0.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sources.withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .where("weight > 0")
        .withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("clamped", F.col("cap") <= F.col("weight") * (F.col("left") / F.sum("weight").over(after)))
    )
    rest = F.col("total") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0.0)).over(every)
    weight = F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(every)
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * (rest / weight))
    filled = ranked.select("source", "source_size", "weight", target.alias("target"))
    none = sources.where("weight <= 0 or weight is null")
    return filled.unionByName(none.select("source", "source_size", "weight", F.lit(0.0).alias("target")))


def _key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(
    docs: DataFrame,
    weights: DataFrame | tuple[float, ...],
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target``, ``taken`` and ``epochs``.

    ``weights`` is a (source, weight) table, one row per source, or weights that the
    sources take in turn. A source takes floor(target) words: every document is
    repeated whole ``floor(target / source_size)`` times, and the rest goes through
    the documents in the order of a seeded hash, each once, until it is used up; the
    last one is taken in part (its first ``taken % size`` words). So the words of a
    source are exact, no document is taken more than ``max_epochs`` times, and reruns agree.

    The point where a source ends is found by radix descent on the hash: sums per 12
    bits, twice, then the few documents that share 24 bits. No source is sorted or
    gathered, however many rows it holds.

    Null or empty texts have size 0 and take 0. A null source is a source. Rows with
    one doc_id share a hash; at the end point they share the rest by size, rounded
    down. An empty table gives an empty table. Columns of the input with the names
    of result columns are replaced.
    """
    names = ("size", "source_size", "target", "taken", "epochs")
    rows = docs.drop(*names).withColumn("size", word_count(F.col("text"))).withColumn("__mix_key", _key(F.col("doc_id"), seed))
    with scratch(docs.sparkSession):
        plan = _plan(rows, weights, share, max_epochs)
    out = rows.join(plan, rows["source"].cast("string").eqNullSafe(plan["__mix_source"]), "left")
    extra = (
        F.when(F.col("__mix_key") < F.col("__mix_end"), F.col("size"))
        .when(F.col("__mix_key") == F.col("__mix_end"), F.expr("size * __mix_part div __mix_of"))
        .otherwise(0)
    )
    taken = (F.col("__mix_whole") * F.col("size") + extra).cast("long")
    return (
        out.withColumn("taken", taken)
        .withColumn("epochs", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0.0))
        .drop("__mix_source", "__mix_key", *PLAN)
        .to(_schema(docs, names))
    )


def _plan(rows: DataFrame, weights: DataFrame | tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Per source: size, target, whole repetitions, the hash at which the rest ends, and how much of it goes there."""
    base = stored(rows.select(F.col("source").cast("string").alias("source"), "size", "__mix_key"), "mix")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = weights if isinstance(weights, DataFrame) else cycled_weights(sizes, weights)
    table = table.select(F.col("source").alias("__s"), F.col("weight").cast("double").alias("weight"))
    weighted = sizes.join(table, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    words = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(0).cast("long")
    state = stored(
        water_fill(weighted, share, max_epochs)
        .withColumn("whole", whole)
        .select("source", "source_size", "target", "whole", (words - F.col("whole") * F.col("source_size")).alias("rest")),
        "mix-targets",
    )
    open_ = state.select(F.col("source").alias("__s"), F.lit("").alias("at"), "rest")
    by_source = Window.partitionBy("__s").orderBy("bucket")
    for level in range(2):
        bucket = F.substring("__mix_key", 1, DIGITS * (level + 1))
        inside = base.join(open_, F.col("source").eqNullSafe(F.col("__s")) & F.col("__mix_key").startswith(F.col("at")))
        sums = inside.groupBy("__s", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        open_ = stored(_ending(sums, by_source).select("__s", F.col("bucket").alias("at"), "rest"), "mix-open")
    inside = base.join(open_, F.col("source").eqNullSafe(F.col("__s")) & F.col("__mix_key").startswith(F.col("at")))
    sums = inside.groupBy("__s", "rest", F.col("__mix_key").alias("bucket")).agg(F.sum("size").alias("n"))
    ends = _ending(sums, by_source).select("__s", F.col("bucket").alias("end"), F.col("rest").alias("part"), F.col("n").alias("of"))
    plan = state.join(ends, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s", "rest")
    return stored(plan.withColumnsRenamed({"source": "__mix_source", **{c.removeprefix("__mix_"): c for c in PLAN}}), "mix-plan", keep=True)


def _ending(sums: DataFrame, by_source) -> DataFrame:
    """The bucket of each source in which its rest is used up, with the rest at its start."""
    before = F.coalesce(F.sum("n").over(by_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sums.withColumn("before", before).where("before <= rest and rest < before + n")
    return cut.withColumn("rest", F.col("rest") - F.col("before"))


def _schema(docs: DataFrame, names: tuple[str, ...]):
    kinds = dict(zip(names, (T.LongType(), T.LongType(), T.DoubleType(), T.LongType(), T.DoubleType()), strict=True))
    return T.StructType([*docs.drop(*names).schema.fields, *[T.StructField(n, k) for n, k in kinds.items()]])


def materialise(mixed: DataFrame) -> DataFrame:
    """One row per repetition: ``repetition`` from 1, the last one cut after its words if it is partial.

    Documents of which nothing is taken go. ``mixed`` is a result of ``mix``.
    """
    turns = F.when(F.col("taken") > 0, F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))
    words = F.least(F.col("size"), F.col("taken") - (F.col("repetition") - 1) * F.col("size"))
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), words.cast("int")), "")
    text = F.when(words < F.col("size"), cut).otherwise(F.col("text"))
    return mixed.drop("repetition").select("*", F.explode(turns).alias("repetition")).withColumn("text", text)
