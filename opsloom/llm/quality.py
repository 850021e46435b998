"""Quality rules: counts of whole texts, and a hashed n-gram likelihood ratio between trusted and raw text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch, stored
from .sizes import counted

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BUCKETS = 65_521  # a prime: one long for each reaches the driver and the tasks, however large the corpus
SPREAD = 1_000_003  # times a 32-bit hash it stays below 2^52
MICRO = 1_000_000  # weights are whole millionths, so sums do not depend on any order
BIN = 1_000  # scores are binned by a thousandth for the threshold
IDS = 2_000_000  # ids (8 bytes) of trusted documents that may be broadcast
WINDOW = 8

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def split_words(text: Column) -> Column:
    """The words (runs without white space) of a text; none of null."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(F.length(body) > 0, F.split(body, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _shifted(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def _pairs(a: Column, by: int, f) -> Column:
    """``f`` of every element and the one ``by`` places on, as long as there is one."""
    return F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - by, F.lit(0))), _shifted(a, by), f)


def grams(words: Column, buckets: int = BUCKETS) -> Column:
    """The buckets of all words and pairs of words: their CRC-32, and a multiple of one plus the other, modulo a prime."""

    def both(h: Column) -> Column:
        return F.concat(F.transform(h, lambda x: x % buckets), _pairs(h, 1, lambda x, y: (x * SPREAD + y) % buckets))

    return _let(F.transform(words, lambda w: F.crc32(w.cast("binary"))), both)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column, window: int = WINDOW) -> Column:
    """How many words are in windows that the text has twice or more. ``window`` is a power of two.

    A window is known by 64 bits, put together from halves. Only a text with equal windows has them
    sorted; a position is in the count if its neighbour has the same hash, and each adds what the
    next one does not cover.
    """

    def hashes(h: Column, width: int) -> Column:
        """Hashes of runs of ``window`` words from those of ``width``."""
        if width == window:
            return _let(h, lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), covered(x)).otherwise(F.lit(0).cast("long")))
        return _let(_pairs(h, width, lambda x, y: F.xxhash64(x, y)), lambda x: hashes(x, 2 * width))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        none = F.struct(F.lit(None).cast("long").alias("h"), F.lit(None).cast("int").alias("i"))

        def ends(s: Column) -> Column:
            last = F.concat(F.array(none), s)  # one longer than s: zip_with fills s up with null, which is filtered out
            nxt = F.concat(_shifted(s, 1), F.array(none))
            around = F.zip_with(F.zip_with(s, last, lambda x, p: F.struct(x.alias("x"), p.alias("p"))), nxt, lambda a, n: F.struct(a["x"].alias("x"), a["p"].alias("p"), n.alias("n")))
            twice = F.filter(around, lambda t: t["x"].isNotNull() & ((t["x"]["h"] == t["p"]["h"]) | (t["x"]["h"] == t["n"]["h"])))
            return F.array_sort(F.transform(twice, lambda t: t["x"]["i"]))

        def total(at: Column) -> Column:
            steps = _pairs(at, 1, lambda a, b: F.least(b - a, F.lit(window)))
            return F.aggregate(steps, F.lit(window).cast("long"), lambda acc, x: acc + x)

        return _let(_let(placed, ends), total)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: hashes(h, 1))


def features(docs: DataFrame) -> DataFrame:
    """The documents with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and ``__words``.

    Columns with these names are replaced. Null counts as an empty text: all five are 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANK))) > 0)
    words = F.col("__words")
    return docs.drop(*FEATURES, "__words").withColumn("__words", split_words(F.col("text"))).withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            "n_repeat_words": _repeated(words),
        }
    )


@dataclass(frozen=True)
class Ratios:
    """A weight (millionths of a nat) for every bucket, and the least mean weight of a text that is kept (None: all are)."""

    weights: tuple[int, ...]
    threshold: int | None

    def table(self) -> Column:
        """The weights as one constant of the plan: Spark folds the expression once, whatever its rows."""
        return F.split(F.lit(",".join(map(str, self.weights))), ",").cast("array<long>")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id) of the documents that ``labels`` (doc_id, quality) calls good; rows without doc_id are left out."""
    return labels.where("doc_id is not null and quality = 1").select("doc_id").distinct()


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, lose: float = 0.01) -> Ratios:
    """Weights from all words and pairs of words of all texts, against those of the ``trusted`` (doc_id) among them.

    The weight of a bucket is the logarithm of its share in the trusted texts over that in all
    texts, both with one added to every count. Counts are added up in the map tasks, so a
    task sends one row per bucket at most. All trusted texts are scored and counted by thousandths of
    a mean weight per n-gram; the threshold lies as far below the value that the share ``lose`` of them
    does not reach as that lies below their median. Without trusted texts there is no threshold.

    Null doc_ids are not trusted; rows with the same doc_id all are. An empty table gives weights of 0.
    """
    spark = docs.sparkSession
    with scratch(spark):
        known = counted(stored(trusted.select(F.col("doc_id").alias("__i")), "quality-trusted"), IDS)
        marked = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("__i"), "left")
        found = marked.select(F.explode(grams(split_words(F.col("text")), buckets)).alias("bucket"), F.col("__i").isNotNull().cast("long").alias("good"))
        seen = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
        seen = stored(seen, "quality-counts")
        total = seen.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
        slots = spark.range(buckets).withColumnRenamed("id", "bucket").join(seen, "bucket", "left")

        def share(column: str, whole: int) -> Column:
            return F.log((F.coalesce(F.col(column), F.lit(0)) + 1) / F.lit(float(whole + buckets)))

        weight = F.floor((share("good", total[1]) - share("n", total[0])) * MICRO + 0.5) if total[1] else F.lit(0)
        weights = [0] * buckets
        for bucket, w in slots.select("bucket", weight.cast("long")).collect():  # as many rows as buckets
            weights[bucket] = w
        model = Ratios(tuple(weights), None)
        good = docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("__i"), "left_semi")
        scored = good.select(split_words(F.col("text")).alias("w")).where(F.size("w") > 0).select((_total(model, F.col("w")) / (2 * F.size("w") - 1)).alias("mean"))
        # weights lie between -60 and 60 nats, so there are 120,000 bins at most
        bins = sorted(scored.groupBy(F.floor(F.col("mean") / BIN).alias("bin")).count().collect())
    if not bins:
        return model
    low, middle = (_quantile(bins, q) for q in (lose, 0.5))
    return Ratios(model.weights, (2 * low - middle) * BIN)


def _quantile(bins: list[tuple[int, int]], share: float) -> int:
    """The bin in which the ``share`` of all counted lies."""
    left = share * sum(n for _, n in bins)
    for at, n in bins:
        left -= n
        if left < 0:
            break
    return at


def _total(model: Ratios, words: Column) -> Column:
    table = model.table()
    return F.aggregate(grams(words, len(model.weights)), F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b.cast("int")))


def assess(docs: DataFrame, model: Ratios, least: int = 20, repeats: int = 30) -> DataFrame:
    """The documents with the counts of ``features``, ``llr``, ``base_failed`` and ``kept``.

    ``llr`` is the mean weight of a text's words and pairs of words, in nats (0 without words).
    A text of fewer than ``least`` words, or with more than ``repeats`` per cent of its words in
    repeated windows, fails the base rules. Of the others those are kept whose mean
    reaches the threshold: every text gets its own verdict, and the same one again.

    One pass over each text, no shuffle: texts of any length, copies and hot sources cost what their words cost.
    Null or empty texts fail. An empty table gives an empty table; columns with the result's names are replaced.
    """
    rows = features(docs.drop("llr", "base_failed", "kept", "__sum")).withColumn("__sum", _total(model, F.col("__words")))
    n = F.col("n_words")
    count = 2 * n - 1
    failed = (n < least) | (100 * F.col("n_repeat_words") > repeats * n)
    reached = F.lit(True) if model.threshold is None else F.col("__sum") >= count * model.threshold
    return (
        rows.withColumn("llr", F.when(n > 0, F.col("__sum") / (count * MICRO)).otherwise(0.0))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & reached)
        .drop("__words", "__sum")
    )
