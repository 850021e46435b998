"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .sizes import text_batches
from .tokens import byte_ngrams, list_column, slices

BITS = 15
ORDERS = (2, 3, 4)
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Scores of every subword bucket per language, temperature, and the least accepted score."""

    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float


def _draw(count: int, seed: int):
    """A function from (text, lang) to (lang, ids): ``count`` subwords drawn from all of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [(ids, rows) for n in ORDERS for ids, rows in byte_ngrams(part.column("text"), n, BITS)]
            ids = np.concatenate([np.zeros(0, np.int64), *[f[0] for f in found]])
            rows = np.concatenate([np.zeros(0, np.int64), *[f[1] for f in found]])
            order = np.argsort(rows, kind="stable")
            at = np.searchsorted(rows[order], np.arange(part.num_rows + 1))
            out = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                pick = np.random.default_rng(seed + int(b - a)).integers(0, b - a, count if b > a else 0)
                out.append(ids[order[a + pick]])
            values = np.concatenate([np.zeros(0, np.int64), *out]).astype(np.int32)
            sizes = np.array([len(o) for o in out], np.int64)
            yield pa.RecordBatch.from_arrays([part.column("lang"), list_column(values, sizes, pa.int32())], ["lang", "ids"])

    return run


def fit(
    train: DataFrame, per_lang: int = 1500, draws: int = 400, dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 5,
    rows: int = 20_000, languages: int = 400,
) -> Model | None:
    """A model from (doc_id, text, lang), fitted on a bounded sample.

    The sample takes about ``per_lang`` documents of every language, by hash of doc_id, fewer if that were more than
    ``rows`` in all, and from each ``draws`` subwords from anywhere in its text. So what reaches the driver is bounded
    by ``rows`` x ``draws`` numbers. Of more than ``languages`` values of lang the most frequent (then the
    smallest) are learned; a column of many is likely dirty. Four fifths train embeddings and softmax
    by stochastic gradient descent; the rest sets the temperature (least log loss) and
    the least score to accept (99 % of what is accepted is right).
    Without any labelled text there is no model.
    """
    text_batches(train.sparkSession)
    train = train.where("lang is not null and length(text) > 0").select("doc_id", "text", "lang")
    sizes = stored(train.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages), "lang-counts")
    each = min(per_lang, rows // max(1, sizes.count()))
    shares = F.least(F.lit(1.0), F.lit(float(each)) / F.col("count"))
    unit = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    # one row per language
    rates = F.broadcast(sizes.select(F.col("lang").alias("__l"), shares.alias("share")))
    sample = train.join(rates, F.col("lang") == F.col("__l")).where(unit < F.col("share")).select("text", "lang")
    data = sample.mapInArrow(_draw(draws, seed), "lang string, ids array<int>").toArrow()
    lists = data.column("ids").combine_chunks()
    full = np.flatnonzero(np.diff(lists.offsets.to_numpy()) == draws)
    if not len(full):
        return None
    ids = lists.flatten().to_numpy().reshape(-1, draws)
    lang = data.column("lang").to_numpy(zero_copy_only=False)[full]
    langs = tuple(sorted(set(lang.tolist())))
    y = np.searchsorted(np.array(langs), lang.astype(str))
    # an order that does not depend on the tasks
    by = np.lexsort((*ids[:, :8].T, y))
    ids, y = ids[by], y[by]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = max(1, len(y) * 4 // 5)
    fit_, hold = order[:cut], order[cut:] if cut < len(y) else order
    emb = rng.uniform(-0.5, 0.5, (1 << BITS, dim)).astype(np.float32) / dim
    soft, bias = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    weight = len(y) / (len(langs) * np.maximum(np.bincount(y, minlength=len(langs)), 1))
    n_batches = max(1, len(fit_) // 16)
    for epoch in range(epochs):
        for i, batch in enumerate(np.array_split(rng.permutation(fit_), n_batches)):
            step = rate * (1 - (epoch * n_batches + i) / (epochs * n_batches))
            g = ids[batch]
            h = emb[g].mean(axis=1)
            err = _softmax(h @ soft + bias)
            err[np.arange(len(batch)), y[batch]] -= 1
            err *= weight[y[batch], None] / len(batch)
            back = (err @ soft.T).astype(np.float32)
            soft -= step * 4 * (h.T @ err)
            bias -= step * err.sum(axis=0)
            change = np.repeat(back * (step * 40 / draws), g.shape[1], axis=0)
            np.add.at(emb, g.ravel(), -change)
    table = emb @ soft
    logits = table[ids[hold]].mean(axis=1) + bias
    losses = [(-np.log(_softmax(logits / t)[np.arange(len(hold)), y[hold]] + 1e-9).mean(), t) for t in np.geomspace(0.02, 5, 40)]
    temperature = float(min(losses)[1])
    p = _softmax(logits / temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == y[hold]
    by = np.argsort(-best)
    good = np.flatnonzero(np.cumsum(right[by]) >= 0.99 * np.arange(1, len(by) + 1))
    least = float(best[by][good[-1]]) if len(good) else 1.0
    return Model(langs, table.astype(np.float32), bias.astype(np.float64), temperature, least)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents with ``lang_pred``, ``score`` (calibrated probability) and ``rejected``.

    The whole text is averaged, and nothing but the text is read. Null texts and texts without
    a letter get ``und`` with score 0. Scores below the calibrated
    bound are marked ``rejected``; the best language is given all the same. Without
    a model every text is ``und``. Columns with these names are replaced.
    """
    text_batches(docs.sparkSession)
    names = ("lang_pred", "score", "rejected")
    base = docs.drop(*names)
    if model is None:
        return base.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "rejected": F.lit(True)})
    langs, table, bias, temperature, least = model.langs, model.table, model.bias, model.temperature, model.least
    schema = T.StructType(
        [
            *base.schema.fields,
            T.StructField("__l", T.BooleanType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sums = np.zeros((part.num_rows, len(langs)))
            count = np.zeros(part.num_rows)
            for n in ORDERS:
                for ids, rows in byte_ngrams(part.column("text"), n, BITS):
                    count += np.bincount(rows, minlength=part.num_rows)
                    for c in range(len(langs)):
                        sums[:, c] += np.bincount(rows, table[ids, c], part.num_rows)
            p = _softmax((sums / np.maximum(count, 1)[:, None] + bias) / temperature)
            letter = part.column("__l").to_numpy(zero_copy_only=False).astype(bool)
            best = np.where(letter, p.max(axis=1), 0.0)
            lang = np.where(letter, np.array(langs, object)[p.argmax(axis=1)], UNKNOWN)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(lang, pa.string()), pa.array(best), pa.array(~letter | (best < least))],
                [*part.schema.names, *names],
            )

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return base.withColumn("__l", letter).mapInArrow(run, schema).drop("__l")
