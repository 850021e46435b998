"""Periodic runs of words: longest common extensions over a difference cover, on a harmonic grid.

A batch of texts is one sequence of word numbers, each text closed by a number of its own, so that
no comparison leaves a text. Suffixes are sorted only at the positions of a difference cover: of any two
positions, some step of less than ``MODULUS`` brings both into it. A common extension is found
by comparing up to that step, then by the least value between the two ranks.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sizes import text_batches
from .tokens import slices

#: A perfect difference set; every difference modulo 13 is that of two members.
COVER, MODULUS = (0, 1, 3, 9), 13
PAIRS = 1 << 20  # grid pairs looked at together


def _steps() -> np.ndarray:
    """For every pair of residues the least step that brings both into the cover."""
    inside = np.isin(np.arange(2 * MODULUS) % MODULUS, COVER)
    r = np.arange(MODULUS)
    both = inside[r[:, None, None] + r] & inside[r[None, :, None] + r]
    return both.argmax(axis=2)


STEP = _steps()
_PLACE = np.cumsum(np.isin(np.arange(MODULUS), COVER)) - 1


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks from 0, equal for equal keys."""
    order = np.argsort(keys, kind="stable")
    new = np.empty(len(keys), np.int64)
    new[order] = np.cumsum(np.concatenate(([0], keys[order][1:] != keys[order][:-1])))
    return new


class Extensions:
    """Longest common extensions to the right in a sequence of numbers from 1 up whose last one is unique."""

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        self.n = n
        self.seq = np.zeros(n + 2 * MODULUS, np.int64)
        self.seq[:n] = seq
        base = np.arange(0, n + MODULUS, MODULUS)
        at = (base[:, None] + np.array(COVER)).ravel()
        self.at = at[at < n + MODULUS]
        self._sort()

    def _slot(self, position: np.ndarray) -> np.ndarray:
        """Where a position of the cover stands among all of the cover."""
        return position // MODULUS * len(COVER) + _PLACE[position % MODULUS]

    def _sort(self) -> None:
        """Ranks of the suffixes at the cover by doubling, with the ranks of every length kept for the common prefixes."""
        top = int(self.seq.max()) + 1
        m = len(self.at)
        rank, bound, done = self.seq[np.minimum(self.at, self.n)], top, 1
        while done < MODULUS:
            key = rank.copy()
            while done < MODULUS and bound < (1 << 62) // top:
                key = key * top + self.seq[np.minimum(self.at + done, self.n)]
                bound *= top
                done += 1
            rank = _dense(key)
            bound = int(rank.max()) + 1
        levels, width = [rank], 1  # in blocks of MODULUS words, that is len(COVER) slots
        while bound < m and width * len(COVER) < m:
            ahead = np.zeros(m, np.int64)
            ahead[: m - width * len(COVER)] = rank[width * len(COVER) :] + 1
            rank = _dense(rank * (bound + 1) + ahead)
            levels.append(rank)
            bound = int(rank.max()) + 1
            width *= 2
        order = np.argsort(rank, kind="stable")
        self.rank = np.empty(m, np.int64)
        self.rank[order] = np.arange(m)
        # common prefixes of neighbours: the kept ranks from the widest down, then single words
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(m - 1, np.int64)
        for level in range(len(levels) - 1, -1, -1):
            blocks = 1 << level
            kept = np.append(levels[level], -1)
            x, y = np.minimum(a, m), np.minimum(b, m)
            same = (kept[x] == kept[y]) & (x < m) & (y < m)
            common[same] += blocks * MODULUS
            a[same] += blocks * len(COVER)
            b[same] += blocks * len(COVER)
        left, right = self.at[order[:-1]] + common, self.at[order[1:]] + common
        self._extend(left, right, common, np.arange(m - 1), MODULUS)
        self._table(common)

    def _extend(self, left: np.ndarray, right: np.ndarray, into: np.ndarray, live: np.ndarray, words: int) -> np.ndarray:
        """Compare up to ``words`` words at ``left`` and ``right`` (moved along), adding to ``into``; those still equal are returned."""
        for _ in range(words):
            if not len(live):
                break
            x, y = left[live], right[live]
            same = (x < self.n) & (y < self.n) & (self.seq[np.minimum(x, self.n)] == self.seq[np.minimum(y, self.n)])
            live = live[same]
            into[live] += 1
            left[live] += 1
            right[live] += 1
        return live

    def _table(self, common: np.ndarray) -> None:
        """Least values over all runs of 2^k neighbours."""
        self.least = [common.astype(np.int32)]
        while 2 * (1 << len(self.least)) <= 2 * len(common):
            half, low = 1 << (len(self.least) - 1), self.least[-1]
            if len(low) <= half:
                break
            self.least.append(np.minimum(low[:-half], low[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal from ``i`` and from ``j`` on; i differs from j."""
        step = STEP[i % MODULUS, j % MODULUS]
        out = np.zeros(len(i), np.int64)
        left, right = i.copy(), j.copy()
        live = np.arange(len(i))
        for k in range(MODULUS):
            live = live[step[live] > k]
            if not len(live):
                break
            same = self._extend(left, right, out, live, 1)
            differ = live[~np.isin(live, same, assume_unique=True)] if len(same) < len(live) else live[:0]
            step[differ] = -1
            live = same
        at = np.flatnonzero(step >= 0)
        at = at[(left[at] < self.n) & (right[at] < self.n)]
        if len(at):
            p, q = self.rank[self._slot(left[at])], self.rank[self._slot(right[at])]
            lo, hi = np.minimum(p, q), np.maximum(p, q)
            level = np.frexp((hi - lo).astype(float))[1] - 1
            found = np.empty(len(at), np.int64)
            for k in np.unique(level):
                use = level == k
                row = self.least[k]
                found[use] = np.minimum(row[lo[use]], row[hi[use] - (1 << int(k))])
            out[at] += found
        return out


@dataclass(frozen=True)
class Runs:
    """Maximal runs: which text, first word, number of words, smallest period; by text, start and period."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def find_runs(numbers: list[np.ndarray], times: int = 4, least: int = 6) -> Runs:
    """All maximal runs of at least ``least`` words and ``times`` periods in sequences of word numbers (0 up).

    With period p the words that equal the one p later are a stretch of (times - 1) * p or more, so
    it has a point of the grid of multiples of p, and of the first such point at least (times - 2) * p
    of it lie ahead. For every period and grid point the extension ahead is taken; where it is that
    long, the extension back is found by halving (it is below p). Equal stretches of two periods belong to the
    smaller one, which divides the larger.
    """
    sizes = np.array([len(s) for s in numbers], np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] >= least]
    none = np.zeros(0, np.int64)
    if not len(order):
        return Runs(none, none, none, none)
    high = max(int(s.max()) for s in numbers if len(s)) + 2
    ends = np.cumsum(sizes[order] + 1)
    seq = np.empty(int(ends[-1]), np.int64)
    for k, i in enumerate(order):
        seq[ends[k] - sizes[i] - 1 : ends[k] - 1] = numbers[i] + 1
        seq[ends[k] - 1] = high + k
    ahead: Extensions | None = None
    found = []
    for p, i in _grid(sizes[order], ends, times):
        j = i + p
        use = seq[i] == seq[j]
        need = np.maximum((times - 1) * p, least - p) - (p - 1)
        deep = need > 1
        use &= ~deep | (seq[np.minimum(i + 1, len(seq) - 1)] == seq[np.minimum(j + 1, len(seq) - 1)])
        p, i, j, need = p[use], i[use], j[use], need[use]
        if not len(p):
            continue
        if ahead is None:
            ahead = Extensions(seq)
        fwd = ahead.common(i, j)
        use = fwd >= need
        p, i, fwd = p[use], i[use], fwd[use]
        if len(p):
            back = _back(ahead, i, p, ends, np.concatenate(([0], ends[:-1])))
            use = (back < p) & (back + fwd + p >= np.maximum(times * p, least))
            found.append(np.stack([(i - back)[use], (back + fwd + p)[use], p[use]]))
    if not found:
        return Runs(none, none, none, none)
    start, length, period = np.concatenate(found, axis=1)
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    of = np.searchsorted(ends, start, "right")
    start = start - np.concatenate(([0], ends[:-1]))[of]
    text = order[of]
    by = np.lexsort((period, start, text))
    return Runs(text[by], start[by], length[by], period[by])


def _grid(sizes: np.ndarray, ends: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, point) of all grids, about ``PAIRS`` at a time. Texts come longest first: a period looks only at those that can hold it."""
    top = int(sizes[0]) // times
    periods = np.arange(1, top + 1)
    texts = np.searchsorted(-sizes, -times * periods, "right")  # how many texts are long enough
    points = np.maximum(0, (ends[texts - 1] - periods - 1)) // periods + 1
    at = np.concatenate(([0], np.cumsum(points)))
    lo = 0
    while lo < top:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PAIRS, "right")) - 1)
        p = np.repeat(periods[lo:hi], points[lo:hi])
        k = np.arange(len(p)) - np.repeat(at[lo:hi] - at[lo], points[lo:hi])
        i = k * p
        use = i + p < ends[-1]
        yield p[use], i[use]
        lo = hi


def _back(ahead: Extensions, i: np.ndarray, p: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many words before ``i`` equal those before ``i + p``, in one text, as far as p of them (p: there are that many or more)."""
    room = np.minimum(p, i - begins[np.searchsorted(ends, i, "right")])
    lo, hi = np.zeros(len(i), np.int64), room.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_] + 1) // 2
        enough = ahead.common(i[open_] - mid, i[open_] - mid + p[open_]) >= mid
        lo[open_[enough]] = mid[enough]
        hi[open_[~enough]] = mid[~enough] - 1


RESULT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")]
    + [T.StructField("runs_sha256", T.StringType(), False), T.StructField("collapsed_sha256", T.StringType(), False)]
    + [T.StructField("runs", T.StringType(), False), T.StructField("collapsed", T.StringType(), False)]
)


def _describe(texts: list[tuple[list[bytes], np.ndarray, np.ndarray]], times: int, least: int, whole: bool) -> Iterator[tuple]:
    """The result of every text, given as words, their numbers, and which word stands at each place."""
    runs = find_runs([numbers for _, numbers, _ in texts], times, least)
    cut = np.searchsorted(runs.text, np.arange(len(texts) + 1))
    for k, (words, numbers, places) in enumerate(texts):
        own = list(zip(*(x[cut[k] : cut[k + 1]].tolist() for x in (runs.start, runs.length, runs.period)), strict=True))
        best, gone = None, np.zeros(len(numbers), bool)
        for s, n, q in own:
            gone[s + q : s + n] = True
            if best is None or n * best[2] > best[1] * q or (n * best[2] == best[1] * q and (s, q) < (best[0], best[2])):
                best = (s, n, q)
        if own or len(places):
            at = np.flatnonzero(~gone)
            kept = b" ".join([words[i] for i in (places[at] if len(places) else at).tolist()])
        else:
            kept = b" ".join(words)
        shown = "".join(f"{s},{n},{q}\n" for s, n, q in own)
        top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        digests = hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()
        yield (len(own), *top, *digests, *((shown, kept.decode()) if whole else ("", "")))


def periodic_runs(docs: DataFrame, places: Column | None = None, times: int = 4, least: int = 6, whole: bool = True) -> DataFrame:
    """The documents with ``n_runs``, the run of the greatest exponent, ``runs`` and ``collapsed``, and digests of both.

    Words are runs without white space, numbered from 0. A run is a stretch of words with smallest
    period q (words q apart are the same) of at least ``least`` words and ``times`` * q that no neighbour
    extends. ``start``, ``length``, ``period`` and ``exponent_milli`` are those of the run with the greatest exact
    length / period (then the smallest start, then period), null without runs; ``runs`` has
    ``start,length,period`` and LF of all, by start and period. In ``collapsed`` every run is cut to its first
    period (a word goes if any run holds it after that run's first q words); words are joined by one blank.
    With ``whole`` false both texts are left empty, and only their digests are made.

    ``places`` is a struct (first, period) or null: from word ``first`` on, the words of that text are repeated with
    that period before the search.

    Texts are worked on in batches of about 1 MB in the tasks that read them, nothing is shuffled, and a batch needs
    some tens of bytes per word; one long text is a batch. Null or empty texts have no words and no runs, and
    digests of empty texts. Columns with the result's names are replaced. An empty table gives an empty table.
    """
    text_batches(docs.sparkSession)
    names = RESULT.fieldNames()
    base = docs.drop(*names, "__first", "__turn")
    kept = base.schema.fields
    rule = places if places is not None else F.lit(None).cast("struct<first:long,period:long>")
    given = base.withColumns({"__first": rule["first"].cast("long"), "__turn": rule["period"].cast("long")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            number = defaultdict(count().__next__)
            texts = []
            for text, first, turn in zip(*(part.column(c).to_pylist() for c in ("text", "__first", "__turn")), strict=True):
                words = (text or "").encode().split()  # bytes are split at exactly these six characters
                numbers = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                at = np.zeros(0, np.int64)
                if first is not None and turn and first < len(words):
                    at = np.arange(len(words))
                    at[first:] = first + (at[first:] - first) % turn
                    numbers = numbers[at]
                texts.append((words, numbers, at))
            rows = list(zip(*_describe(texts, times, least, whole), strict=True)) or [()] * len(names)
            new = [pa.array(v, pa.int64() if f.dataType == T.LongType() else pa.string()) for f, v in zip(RESULT.fields, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *new], [*(f.name for f in kept), *names])

    return given.mapInArrow(run, T.StructType([*kept, *RESULT.fields]))


def word_total(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def planted(doc_id: Column, text: Column) -> Column:
    """(first, period) for the tenth of the documents whose CRC-32 of doc_id ends in 0; null for the others, for null ids and for texts without words."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    n = word_total(text)
    tenth = (h % 10 == 0) & (n > 0)
    safe = F.greatest(n, F.lit(1))
    first = g % safe
    period = 1 + F.floor((n - first) / (3 + g % 8)).cast("long")
    return F.when(tenth, F.struct(first.alias("first"), period.alias("period")))
