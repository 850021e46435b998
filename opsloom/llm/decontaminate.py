"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, stored
from .sizes import counted, text_batches
from .tokens import _ODD, PUNCT, U64, list_column, mix64, slices, words

BITS = (26, 29)  # of the bitmap of test hashes, 8 to 64 MB: 32 times their number between these bounds
MASKS = 128  # per window length, at most
KEYS = 256  # choices of words that may differ, at most; beyond, windows are compared


@dataclass(frozen=True)
class Seeds:
    """An overlap is ``window`` neighbouring words of which ``share`` percent are equal; items of fewer words are compared whole.

    Of items of fewer than ``few`` words all must be equal, as one of a few words is soon another text.
    With a ``span`` an overlap needs a seed as well: ``span`` words that are equal but for the
    positions of one residue modulo ``masks``. With span 0 it needs none.
    """

    span: int = 12
    masks: int = 3
    window: int = 13
    share: int = 80
    few: int = 12

    def spare(self, w: int) -> int:
        """How many of ``w`` words may differ."""
        return 0 if w < min(self.few, self.window) else min(w - 1, (100 - self.share) * w // 100)


WHOLE = Seeds(span=0)


def masks(w: int, spare: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Groups of neighbouring positions of ``w`` words as (first, end), and the groups that each mask leaves out: every choice of ``spare`` ones.

    ``spare`` words lie in ``spare`` groups at most, so some mask leaves all of them out.
    """
    n = max(spare + 1, min(w, 3 * spare))
    while n > spare + 1 and math.comb(n, spare) > MASKS:
        n -= 1
    ends = [w * i // n for i in range(n + 1)]
    return list(itertools.pairwise(ends)), list(itertools.combinations(range(n), spare))


def _windows(h: np.ndarray, w: int, spare: int) -> Iterator[np.ndarray]:
    """Per mask: the hash of the ``w`` words from every word on."""
    m = len(h) - w + 1
    groups, left_out = masks(w, spare)
    with np.errstate(over="ignore"):
        runs = {1: h}
        for n in range(2, max(b - a for a, b in groups) + 1):
            runs[n] = runs[n - 1][: len(h) - n + 1] * U64(_ODD) + h[n - 1 :]
        parts = [mix64(runs[b - a][a : a + m], 64 * w + a) for a, b in groups]
        whole = reduce(np.add, parts)
        for out in left_out:
            yield reduce(np.subtract, [parts[i] for i in out], whole)


def _may_hold(bits: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Where both bits of a hash are set."""
    n = len(bits).bit_length() + 5
    slot = v >> U64(64 - n)
    hit = (bits[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) == 1
    at = np.flatnonzero(hit)
    slot = (v[at] >> U64(64 - 2 * n)) & U64((1 << n) - 1)
    hit[at] = (bits[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) == 1
    return hit


def _hashes(seeds: Seeds, lengths: list[int], bitmap=None):
    """A function from (id, text) batches to the windows of ``lengths`` words whose hash may be in the bitmap; without one, of texts to all windows of their own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for part in slices(batches, "text"):
            h, rows = words(part.column("text"), PUNCT, alone=True)
            size = np.bincount(rows, minlength=part.num_rows)
            begin = np.cumsum(size) - size
            for w in lengths:
                m = len(h) - w + 1
                if m <= 0:
                    continue
                inside = rows[:m] == rows[w - 1 :]
                if bits is None:
                    inside &= np.minimum(size, seeds.window)[rows[:m]] == w
                hs, ats = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
                for v in _windows(h, w, seeds.spare(w)):
                    at = np.flatnonzero(inside if bits is None else inside & _may_hold(bits, v))
                    hs.append(v[at])
                    ats.append(at)
                at = np.concatenate(ats)
                ctx = h[at[:, None] + np.arange(w)].ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(rows[at])),
                        pa.array(at - begin[rows[at]]),
                        pa.array(np.concatenate(hs).view(np.int64)),
                        pa.array(np.full(len(at), w)),
                        list_column(ctx.view(np.int64), np.full(len(at), w), pa.int64()),
                    ],
                    ["id", "pos", "hash", "w", "ctx"],
                )

    return run


_SCHEMA = "id long, pos long, hash long, w long, ctx array<long>"


def test_hashes(benchmark: DataFrame, seeds: Seeds) -> DataFrame:
    """(hash, w, item_id, item_ctx) of all windows of the items; of equal texts the smallest item_id stands for all."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("id"), "text")
    items = items.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("id").alias("id"), F.first("text").alias("text"))
    rows = items.select("id", "text").mapInArrow(_hashes(seeds, list(range(1, seeds.window + 1))), _SCHEMA)
    return rows.select("hash", "w", F.col("id").alias("item_id"), F.col("ctx").alias("item_ctx"))


def _bitmap(spark: SparkSession, hashes: DataFrame):
    """Two bits for every test hash; at most 2^(n-6) rows reach the driver, n the bits of a slot."""
    n = min(max(hashes.count().bit_length() + 5, BITS[0]), BITS[1])
    slots = F.array(F.shiftrightunsigned("hash", 64 - n), F.shiftrightunsigned("hash", 64 - 2 * n).bitwiseAND(F.lit((1 << n) - 1)))
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    rows = hashes.select(F.explode(slots).alias("slot")).select(F.shiftright("slot", 6).alias("w"), one.alias("b"))
    got = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    bits = np.zeros(1 << (n - 6), U64)
    bits[got.w.to_numpy(np.int64)] = got.b.to_numpy(np.int64).view(U64)
    return spark.sparkContext.broadcast(bits)


def _has_seed(same: Column, seeds: Seeds) -> Column:
    """Whether some ``span`` words are equal outside one residue."""
    at = lambda i: F.coalesce(F.get(same, F.lit(i)), F.lit(False))
    return reduce(
        lambda a, b: a | b,
        [reduce(lambda a, b: a & b, [at(o + p) for p in range(seeds.span) if p % seeds.masks != r], F.size(same) >= o + seeds.span)
         for o in range(max(1, seeds.window - seeds.span + 1)) for r in range(seeds.masks)],
    )


def _exact_keys(ctx: Column, w: int, spare: int) -> Column:
    """A hash of the ``w`` words without each choice of ``spare`` ones: two windows differ in at most that many words if they share one."""
    kept = [[i for i in range(w) if i not in out] for out in itertools.combinations(range(w), spare)]
    table = F.array(*[F.array(*map(F.lit, k)) for k in kept])
    return F.transform(table, lambda keep: F.xxhash64(keep, F.transform(keep, lambda i: F.get(ctx, i))))


def _matched(docs: DataFrame, benchmark: DataFrame, seeds: Seeds) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is found: (id, pos, w, own) windows of the documents, (w, own, key) those that overlap test windows, (w, key, item_id).

    Windows that the hashes bring together are verified without pairs of them: two windows differ in no more words than
    they may if they share a key that leaves out just those, so both are joined with their keys, however many documents and
    items hold a passage with other words in places. Where that takes too many keys, or overlaps need a seed
    as well, distinct windows are compared, and the key is the test window.
    """
    spark = docs.sparkSession
    text_batches(spark)
    tests = test_hashes(benchmark, seeds).withColumn("window", F.xxhash64("item_ctx"))
    tests = stored(tests, "test-hashes")
    bits = _bitmap(spark, tests)
    lengths = sorted(r.w for r in tests.select("w").distinct().collect())
    train = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    found = train.mapInArrow(_hashes(seeds, lengths, bits), _SCHEMA).withColumn("own", F.xxhash64("ctx"))
    found = stored(found, "training-hits")
    mine = stored(found.dropDuplicates(["hash", "w", "own"]).select("hash", "w", "own", "ctx"), "training-windows")
    hit = counted(stored(mine.select("hash", "w").distinct(), "hit-hashes"))
    known = stored(tests.join(hit, ["hash", "w"], "left_semi").dropDuplicates(["hash", "w", "window"]).select("hash", "w", "window", "item_ctx"), "test-windows")
    items = tests.select("w", "window", "item_id").distinct()
    if not seeds.span and all(math.comb(w, seeds.spare(w)) <= KEYS for w in lengths):

        def keys(ctx: str) -> Column:
            made = [F.when(F.col("w") == w, _exact_keys(F.col(ctx), w, seeds.spare(w))) for w in lengths]
            return F.explode(F.coalesce(*made) if made else F.array().cast("array<long>")).alias("key")

        ours = stored(mine.dropDuplicates(["w", "own"]).select("w", "own", keys("ctx")), "training-keys")
        theirs = stored(known.dropDuplicates(["w", "window"]).select("w", "window", keys("item_ctx")), "test-keys")
        links = ours.join(theirs.select("w", "key").distinct(), ["w", "key"], "left_semi")
        theirs = theirs.join(ours.select("w", "key").distinct(), ["w", "key"], "left_semi")
        named = theirs.join(items, ["w", "window"]).select("w", "key", "item_id").distinct()
        return found, links, named
    # as many windows as 50,000 rows of three masks
    pairs = mine.join(counted(known, 250_000), ["hash", "w"])
    same = F.zip_with("ctx", "item_ctx", lambda a, b: a == b)
    pairs = pairs.select("w", "own", "window", same.alias("same"))
    least = F.when(F.col("w") < min(seeds.few, seeds.window), 100).otherwise(seeds.share)
    checked = pairs.where(100 * F.size(F.filter("same", lambda x: x)) >= least * F.col("w"))
    if seeds.span:
        checked = checked.where(_has_seed(F.col("same"), seeds))
    return found, checked.select("w", "own", F.col("window").alias("key")).distinct(), items.withColumnRenamed("window", "key")


def hits(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = WHOLE) -> DataFrame:
    """(doc_id, item_id, first_word, last_word, n_hits): verified overlaps, one row per document and item.

    Words are runs of letters and digits, A-Z folded; in scripts without spaces every character
    is a word. An overlap is ``window`` neighbouring words, or a whole item if it has fewer, of which
    ``share`` percent are equal (all for items of fewer than ``few`` words, down to one). All are found:
    the words that may differ lie in a few groups of positions, and for every choice of that many groups a
    mask leaves them out. The hashes of all windows of all texts under all masks are tested against a
    bitmap of the test hashes; those that pass are joined with the test hashes, and the words
    of both windows compared, once for all copies of a window. ``n_hits`` counts the windows of the document.
    Items without any word cannot be searched; ``unsearched`` lists them.

    Null texts have no words. Rows without doc_id are left out. Repeated doc_ids count
    as one document. Extra columns are not read. Empty tables give an empty table.
    """
    found, links, named = _matched(docs, benchmark, seeds)
    own = links.join(named, ["w", "key"]).select("w", "own", "item_id").distinct()
    return (
        found.select("id", "pos", "w", "own").distinct().join(own, ["w", "own"]).groupBy(F.col("id").alias("doc_id"), "item_id")
        .agg(F.min("pos").alias("first_word"), F.max(F.col("pos") + F.col("w") - 1).alias("last_word"), F.count_distinct("pos").alias("n_hits"))
    )


def unsearched(benchmark: DataFrame) -> DataFrame:
    """(item_id, text) of the items that no search can find: without item_id, or without a letter or digit."""
    text_batches(benchmark.sparkSession)
    rows = benchmark.select("item_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            size = np.bincount(words(part.column("text"), PUNCT)[1], minlength=part.num_rows)
            yield part.filter(pc.or_(pa.array(size == 0), part.column("item_id").is_null()))

    return rows.mapInArrow(run, rows.schema)


def report(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = WHOLE) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, items (ids, ascending), first_word, last_word (null if clean).

    Test windows that the same items share are one list of items, so a passage that many documents and items have in
    common costs a document one list.
    """
    with scratch(docs.sparkSession):
        found, links, named = _matched(docs, benchmark, seeds)
        lists = named.groupBy("w", "key").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("list", F.xxhash64("items"))
        lists = stored(lists, "item-lists")
        own = stored(links.join(counted(lists.select("w", "key", "list")), ["w", "key"]).select("w", "own", "list").distinct(), "window-lists")
        per_list = found.select("id", "pos", "w", "own").distinct().join(counted(own), ["w", "own"]).groupBy("id", "list")
        per_list = per_list.agg(F.min("pos").alias("first"), F.max(F.col("pos") + F.col("w") - 1).alias("last"))
        sets = counted(stored(lists.dropDuplicates(["list"]).select("list", "items"), "item-sets"), weight=1 + F.size("items"))
        per = per_list.join(sets, "list").groupBy(F.col("id").alias("doc_id")).agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.min("first").alias("first_word"), F.max("last").alias("last_word")
        )
        per = stored(per.withColumnRenamed("doc_id", "__i"), "contaminated", keep=True)
    per = counted(per, weight=1 + F.size("items"))
    out = docs.select("doc_id").join(per, F.col("doc_id") == F.col("__i"), "left")
    return out.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        "first_word",
        "last_word",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, seeds: Seeds = WHOLE) -> DataFrame:
    """The documents without an overlap with the benchmark, with their columns. Which items they overlap is not looked up."""
    with scratch(docs.sparkSession):
        found, links, _ = _matched(docs, benchmark, seeds)
        own = counted(stored(links.select("w", "own").distinct(), "equal-windows"))
        bad = stored(found.join(own, ["w", "own"], "left_semi").select(F.col("id").alias("__i")).distinct(), "contaminated", keep=True)
    return docs.join(counted(bad), F.col("doc_id") == F.col("__i"), "left_anti")
