"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .sizes import counted, text_batches
from .tokens import char_ngrams, list_column, slices

BITS = 19
ORDERS = (3, 4, 5)


@dataclass(frozen=True)
class Model:
    """A weight for every n-gram bucket (log-count ratio times coefficient), and the intercept."""

    weights: np.ndarray
    bias: float


def held_out(folds: int = 5, fold: int = 0) -> Column:
    """Whether a document belongs to the fold that no learner sees."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.pmod(F.crc32(key.cast("binary")), F.lit(folds)) == fold


#: Counters: texts of label 0 and 1 outside the fold that finds the cut, then inside it.
GROUPS = ("clean", "toxic", "clean_cut", "toxic_cut")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket, how many texts of each group have it; at -1 how many there are, at -2 their bytes. One row per bucket and task at most."""
    seen = np.zeros((len(GROUPS), 1 << BITS), np.int64)
    total, size = np.zeros(len(GROUPS), np.int64), np.zeros(len(GROUPS), np.int64)
    every = np.arange(1 << BITS, dtype=np.int32)
    for part in slices(batches, "text", 1 << 20):
        group = part.column("label").to_numpy(zero_copy_only=False) + 2 * part.column("part").to_numpy(zero_copy_only=False)
        total += np.bincount(group, minlength=len(GROUPS))
        size += np.bincount(group, pc.binary_length(part.column("text")).to_numpy(zero_copy_only=False), len(GROUPS)).astype(np.int64)
        ids, sizes = _buckets(part.column("text"), every)
        of = np.repeat(group, sizes)
        for g in np.unique(group):
            seen[g] += np.bincount(ids[of == g], minlength=1 << BITS)
    at = np.flatnonzero(seen.any(axis=0))
    sums = [pa.array(np.concatenate([seen[g, at], [total[g], size[g]]])) for g in range(len(GROUPS))]
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), *sums], ["bucket", *GROUPS])


def _buckets(texts: pa.Array, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, how many per text): the distinct places of each text's buckets, text after text; buckets at a place below 0 are passed over."""
    n, found = len(texts), []
    for ids, rows in char_ngrams(texts, ORDERS, BITS):
        at = place[ids]
        use = at >= 0
        found.append((at[use], np.searchsorted(rows[use], np.arange(n + 1))))
    last = np.zeros(max(0, int(place.max())) + 1, np.int32)
    out, sizes = [np.zeros(0, np.int32)], np.zeros(n, np.int64)
    for i in range(n):
        own = np.concatenate([at[c[i] : c[i + 1]] for at, c in found]) if found else out[0]
        k = np.arange(len(own), dtype=np.int32)
        last[own] = k
        own = own[last[own] == k]
        sizes[i] = len(own)
        out.append(own)
    return np.concatenate(out), sizes


def _places(chosen: np.ndarray) -> np.ndarray:
    """For every bucket its number among ``chosen``, -1 for the others."""
    return np.where(chosen, np.cumsum(chosen) - 1, -1).astype(np.int32)


def _features(place: np.ndarray):
    """A function from batches of (text, label, part) to (label, part, places of buckets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            ids, sizes = _buckets(part.column("text"), place)
            yield pa.RecordBatch.from_arrays([part.column("label"), part.column("part"), list_column(ids, sizes, pa.int32())], ["label", "part", "ids"])

    return run


def _ratios(bucket: np.ndarray, clean: np.ndarray, toxic: np.ndarray, n0: int, n1: int, least: int, chance: float) -> np.ndarray:
    """The log-count ratio of every bucket, 0 for those that are rare or within chance."""
    out = np.zeros(1 << BITS)
    use = clean + toxic >= least
    bucket, clean, toxic = bucket[use], clean[use], toxic[use]
    prior = n1 / (n0 + n1)
    ratio = np.log((toxic + prior) / n1) - np.log((clean + 1 - prior) / n0)
    error = np.sqrt(1 / ((clean + toxic + 1.0) * prior * (1 - prior)))
    use = np.abs(ratio) > chance * error
    out[bucket[use]] = ratio[use]
    return out


def fit(
    train: DataFrame, rows: int = 10_000, size: int = 32 << 20, least: int = 4, chance: float = 3.0, strength: float = 30.0, steps: int = 200, folds: int = 4
) -> Model:
    """A model from (doc_id, text, label 0/1).

    The log-count ratios come from all rows: log of the share of texts with the n-gram in
    one class over that in the other, smoothed by the share in both. n-grams in fewer than
    ``least`` texts, or with a ratio within ``chance`` standard errors of none, are left out; all
    others are used, 2^19 buckets at most.
    The coefficients are fitted by logistic regression with an L2 penalty on about
    ``rows`` texts of about ``size`` bytes together at most, those with the smallest hash of doc_id; that is
    the only sample. What reaches the driver is bounded: one row per bucket, and the sample's chosen buckets,
    of which a text has no more than n-grams.

    Few texts are toxic and the penalty is strong, so scores are too low for an even
    cut. One in ``folds`` rows is left out of the counts and the sample of a first model, which scores the
    sample's rows among them; the cut with the best balance of precision and recall (F1) there, between
    odds of ``e^-2`` and even ones, becomes the score 0.5 of the model of all rows.

    Without rows of both classes the model scores every text with the share of label 1
    (smoothed; a third without any rows, so that nothing is rejected).
    """
    text_batches(train.sparkSession)
    part = (F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(folds)) == 0).cast("long").alias("part")
    train = train.where("label in (0, 1)").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("long"), part)
    per_task = train.select("text", "label", "part").mapInArrow(_count, ", ".join(f"{c} long" for c in ("bucket", *GROUPS)))
    table = per_task.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in GROUPS)).toArrow()
    bucket, *counts = (table.column(c).to_numpy() for c in ("bucket", *GROUPS))
    n, sizes = ([int(c[bucket == at].sum()) for c in counts] for at in (-1, -2))
    real = bucket >= 0
    bucket, counts = bucket[real], [c[real] for c in counts]
    n0, n1 = n[0] + n[2], n[1] + n[3]
    weights = np.zeros(1 << BITS)
    if not n0 or not n1:
        return Model(weights, float(np.log((n1 + 0.5) / (n0 + 1.0))))
    ratios = _ratios(bucket, counts[0] + counts[2], counts[1] + counts[3], n0, n1, least, chance)
    first = _ratios(bucket, counts[0], counts[1], n[0], n[1], least, chance) if all(n) else np.zeros(1 << BITS)
    cut = min(1.0, rows / (n0 + n1), size / max(1, sum(sizes)))
    sample = train
    if cut < 1:
        sample = sample.where(F.xxhash64("doc_id", F.lit(17)) < F.lit(int(-(2**63) + cut * 2**64)))
    either = (ratios != 0) | (first != 0)
    data = sample.select("text", "label", "part").mapInArrow(_features(_places(either)), "label long, part long, ids array<int>").toArrow()
    y = data.column("label").to_numpy().astype(float)
    if not len(y):
        return Model(weights, float(np.log(n1 / n0)))
    lists, apart = data.column("ids"), data.column("part").to_numpy() == 1
    w, bias = _logistic(lists, ratios[either], y, strength, steps)
    weights[either] = w * ratios[either]
    if (y[apart] == 1).any() and (y[apart] == 0).any() and not apart.all():
        held, rest = lists.filter(pa.array(apart)), lists.filter(pa.array(~apart))
        v, base = _logistic(rest, first[either], y[~apart], strength, steps)
        bias -= _cut(_sums(held, v * first[either]) + base, y[apart])
    return Model(weights, bias)


def _sums(lists: pa.ChunkedArray, value: np.ndarray) -> np.ndarray:
    """The sum of the values of each text's places."""
    out = [np.zeros(0)]
    for chunk in lists.chunks:
        col, ends = chunk.flatten().to_numpy(), chunk.offsets.to_numpy() - chunk.offsets[0].as_py()
        out.append(np.bincount(np.repeat(np.arange(len(chunk)), np.diff(ends)), value[col], len(chunk)))
    return np.concatenate(out)


def _cut(z: np.ndarray, y: np.ndarray, lowest: float = -2.0) -> float:
    """The log odds, from ``lowest`` to 0, at which the rows from there on have the best F1; halfway to the next row below."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    ends = np.flatnonzero(np.append(z[1:] != z[:-1], True))
    best = ends[np.argmax(2 * np.cumsum(y)[ends] / (ends + 1 + y.sum()))]
    below = z[best + 1] if best + 1 < len(z) else z[best]
    return float(np.clip((z[best] + below) / 2, lowest, 0.0))


def _logistic(lists: pa.ChunkedArray, x: np.ndarray, y: np.ndarray, strength: float, steps: int) -> tuple[np.ndarray, float]:
    """The penalised logistic loss of texts given by the places of their buckets, with values ``x``, by gradient steps scaled per coefficient (Adam).

    The texts are gone through some at a time, so memory is that of the lists.
    """
    n, width = len(y), len(x)
    parts, at = [], 0
    for chunk in lists.chunks:
        col, ends = chunk.flatten().to_numpy(), chunk.offsets.to_numpy() - chunk.offsets[0].as_py()
        lo = 0
        while lo < len(chunk):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + (1 << 20), "right")) - 1)
            parts.append((at + lo, at + hi, col[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo]))
            lo = hi
        at += len(chunk)
    w = np.zeros(width + 1)
    w[-1] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    mean, square = np.zeros(width + 1), np.zeros(width + 1)
    for k in range(1, steps + 1):
        value, slope = w[:-1] * x, np.zeros(width + 1)
        for lo, hi, col, ends in parts:
            z = np.diff(np.append(0.0, np.cumsum(value[col]))[ends]) + w[-1]
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[lo:hi]) / n
            slope[:-1] += np.bincount(col, np.repeat(err, np.diff(ends)), width)
            slope[-1] += err.sum()
        slope[:-1] = slope[:-1] * x + strength / n * w[:-1]
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope * slope
        size = 0.05 * (1 - k / (steps + 1))
        w -= size * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-9)
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on), from the whole text alone.

    Null or empty texts score the intercept. Columns with these names are replaced.
    """
    text_batches(docs.sparkSession)
    place, weights, bias = _places(model.weights != 0), model.weights[model.weights != 0], model.bias
    base = docs.drop("score", "predicted")
    schema = [*base.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            ids, sizes = _buckets(part.column("text"), place)
            z = bias + np.bincount(np.repeat(np.arange(part.num_rows), sizes), weights[ids], part.num_rows)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*part.schema.names, "score", "predicted"]
            )

    from pyspark.sql import types as T

    return base.mapInArrow(run, T.StructType([*schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the documents that ``labels`` (doc_id, toxic) knows.

    Labels other than 0 and 1, and rows without doc_id, are left out; of several labels
    of a document the largest counts.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = counted(stored(known.withColumnRenamed("doc_id", "__i"), "toxic-labels"))
    return docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("__i")).select("doc_id", "text", "label")
