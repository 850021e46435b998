"""Exact n-gram Jaccard join over prefix trees.

Sets of shingle hashes are put in one global order. Documents with the same set are one
set. Two sets that are similar enough share one of the rarest shingles of both (the prefix
filter), so sets are first grouped to blocks that share such shingles, and only blocks
are joined: the sets of a block are stored in a prefix tree, and every set walks
it, sharing the overlap of common prefixes, leaving subtrees that the remaining
lengths rule out and subtrees that are linked to it already. Where many sets walk, they do so
together, and their overlaps with the sets below a node are one product of tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import number_components
from ..session import scratch, stored
from .sizes import counted, text_batches
from .tokens import bounds, gram_sets, list_column, mix64, shingles, slices, words

#: Sets and shingles of a group that one task joins at a time.
CHUNK_SETS, CHUNK_GRAMS = 4096, 2_000_000
#: Sets of a subtree that are compared side by side.
BUCKET = 64
#: From so many sets on they walk the tree together, in tables of so many cells (sets times elements).
FEW_PROBES, PROBE_CELLS = 12, 8_000_000


@dataclass(frozen=True)
class Measure:
    """Shingles of ``words`` words; linked if ``den`` * overlap >= ``num`` * union."""

    words: int = 5
    num: int = 80
    den: int = 100

    def least(self, n: np.ndarray) -> np.ndarray:
        """The size of the smallest set that can link with one of ``n``; also their least overlap."""
        return (n * self.num + self.den - 1) // self.den

    def spare(self, n: np.ndarray) -> np.ndarray:
        """Half the prefix length n - least(n) + 1: shingles looked at beyond it."""
        return np.minimum(self.least(n) - 1, (n - self.least(n) + 1) // 2)


# --- the tree -----------------------------------------------------------------------


class PrefixTree:
    """A compressed trie over ascending arrays: a node is a run of the sorted sets.

    Below a node of at most ``BUCKET`` sets the sets lie side by side. ``sizes`` are the sizes of the sets of which the arrays are the smallest elements;
    without it the arrays are the sets.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray | None = None):
        self.order = np.array(sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes()), np.int64)
        self.sets = [sets[i] for i in self.order]
        held = np.array([len(s) for s in self.sets], np.int64)
        self.size = held if sizes is None else sizes[self.order]
        self.partial = sizes is not None
        lcp = np.array([_common(a, b) for a, b in zip(self.sets[:-1], self.sets[1:], strict=True)], np.int64)
        self.lo, self.hi, self.begin, self.end, self.least, self.most, self.below = [], [], [], [], [], [], []
        self.leaves: list[_Leaves | None] = []
        todo = [(0, len(sets), 0, -1)]
        while todo:
            lo, hi, depth, parent = todo.pop()
            node = len(self.lo)
            if parent >= 0:
                self.below[parent].append(node)
            end = int(lcp[lo : hi - 1].min()) if hi - lo > 1 else int(held[lo])
            for column, value in (
                (self.lo, lo), (self.hi, hi), (self.begin, depth), (self.end, end),
                (self.least, int(self.size[lo:hi].min())), (self.most, int(self.size[lo:hi].max())), (self.below, []),
            ):
                column.append(value)
            if 1 < hi - lo <= BUCKET:
                self.leaves.append(self._leaves(range(lo, hi), end))
            elif hi - lo > 1:
                cuts = [lo, *(lo + 1 + np.flatnonzero(lcp[lo : hi - 1] == end)).tolist(), hi]
                runs = list(zip(cuts[:-1], cuts[1:], strict=True))
                self.leaves.append(self._leaves([a for a, b in runs if b - a == 1], end))
                todo += [(a, b, end, node) for a, b in runs if b - a > 1]
            else:
                self.leaves.append(self._leaves([lo], end))

    def _leaves(self, places, end: int) -> _Leaves | None:
        """Sets that hang directly on a node, side by side."""
        at = np.array(places, np.int64)
        if not len(at):
            return None
        tails = [self.sets[i][end:] for i in at]
        return _Leaves(
            at, np.concatenate(tails), np.concatenate(([0], np.cumsum([len(t) for t in tails]))).astype(np.int64),
            np.array([self.sets[i][-1] for i in at]), np.array([len(self.sets[i]) for i in at], np.int64), self.size[at],
        )

    def link(self, labels: np.ndarray, measure: Measure) -> np.ndarray:
        """Labels of the sets, in the order given, joined along all links; equal labels at the start are linked.

        Of sets that are known in part, all that may link are joined: what lies behind the
        last element known of either can be shared.
        """
        lab = labels[self.order]
        n = len(lab)
        if n < 2:
            return labels
        # some sets look for all others; in a family of near copies most are linked after that
        for x in sorted({0, n // 2, n - 1}):
            self._probe(x, lab, np.arange(n) == x, measure)
        # sets of the most frequent label do not look for others: the others look for them
        _, of, counts = np.unique(lab, return_inverse=True, return_counts=True)
        probes = (of != counts.argmax()) if counts.max() > 1 else np.ones(n, bool)
        if np.count_nonzero(probes) < FEW_PROBES:
            for x in np.flatnonzero(probes):
                self._probe(int(x), lab, probes, measure)
        else:
            for group in self._groups(np.flatnonzero(probes)):
                self._probe_all(group, lab, probes, measure)
        out = np.empty_like(lab)
        out[self.order] = lab
        return out

    def _probe(self, x: int, lab: np.ndarray, probes: np.ndarray, measure: Measure) -> None:
        """Link a set with those that do not look for it themselves."""
        num, den = measure.num, measure.den
        own = self.sets[x]
        nx, last = int(self.size[x]), own[-1]
        todo = [(0, 0, 0, 0)]
        while todo:
            # of x and of the sets below: elements that are the same, and elements passed
            node, same, mine, theirs = todo.pop()
            lo, hi, begin, end = self.lo[node], self.hi[node], self.begin[node], self.end[node]
            if (lab[lo:hi] == lab[x]).all():
                continue
            least, most = self.least[node], self.most[node]
            if most * den < num * nx or least * num > den * nx:
                continue
            best = same + min(nx - mine, most - theirs)
            if den * best < num * (nx + least - best):
                continue
            part = self.sets[lo][begin:end]
            if len(part) and theirs == begin:
                at = np.searchsorted(own, part)
                equal = own[np.minimum(at, len(own) - 1)] == part
                same += int(np.count_nonzero(equal))
                if part[-1] <= last:
                    mine, theirs = int(at[-1]) + bool(equal[-1]), end
                else:
                    mine, theirs = len(own), begin + int(np.searchsorted(part, last, "right"))
            best = same + min(nx - mine, most - theirs)
            if den * best < num * (nx + least - best):
                continue
            if self.leaves[node] is not None:
                for y in self.leaves[node].near(x, own, nx, lab, probes, same, mine, theirs, theirs == end, measure):
                    a, b = sorted((lab[x], lab[y]))
                    if a != b:
                        lab[lab == b] = a
            todo += [(child, same, mine, theirs) for child in self.below[node]]


    def _groups(self, probes: np.ndarray) -> Iterator[_Probes]:
        """Sets that walk the tree together: as many as fit a table of them and their elements."""
        held = np.array([len(s) for s in self.sets], np.int64)
        cut = np.concatenate(([0], np.cumsum(held)))
        every, flat, times = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        column = np.full(len(every), -1, np.int64)
        begin = 0
        while begin < len(probes):
            some = held[probes[begin:]]
            cells = np.cumsum(some) * np.arange(1, len(some) + 1)
            at = probes[begin : begin + max(1, int(np.searchsorted(cells, PROBE_CELLS, "right")))]
            begin += len(at)
            own, row = np.concatenate([flat[cut[x] : cut[x + 1]] for x in at]), np.repeat(np.arange(len(at)), held[at])
            used, place = np.unique(own, return_inverse=True)
            sums = np.zeros((len(at), len(used)), np.int32)
            sums[row, place] = 1
            # an element of one set is in no other
            shared = times[used] > 1
            table = sums[:, shared].astype(np.float32)
            column[used[shared]] = np.arange(table.shape[1])
            last = np.array([self.sets[x][-1] for x in at])
            yield _Probes(at, self.size[at], held[at], last, table, np.cumsum(sums, axis=1, dtype=np.int32, out=sums), every[used], flat, cut, column)
            column[used] = -1

    def _probe_all(self, p: _Probes, lab: np.ndarray, probes: np.ndarray, measure: Measure) -> None:
        """``_probe`` of several sets at once: each node is read once for all that reach it."""
        num, den = measure.num, measure.den
        zero = np.zeros(len(p.at), np.int64)
        todo = [(0, np.arange(len(p.at)), zero, zero, zero)]
        while todo:
            # as in _probe; an entry for each set that got here
            node, i, same, mine, theirs = todo.pop()
            lo, hi, begin, end = self.lo[node], self.hi[node], self.begin[node], self.end[node]
            least, most = self.least[node], self.most[node]
            labels, nx = lab[lo:hi], p.size[i]
            go = (most * den >= num * nx) & (least * num <= den * nx)
            if (labels == labels[0]).all():
                go &= lab[p.at[i]] != labels[0]
            best = same + np.minimum(nx - mine, most - theirs)
            go &= den * best >= num * (nx + least - best)
            i, same, mine, theirs = i[go], same[go], mine[go], theirs[go]
            part = self.sets[lo][begin:end]
            if len(part) and len(i):
                on = theirs == begin
                at = p.columns(lo, begin, end)
                same = same + np.where(on, p.table[np.ix_(i, at[at >= 0])].sum(axis=1).astype(np.int64), 0)
                whole = part[-1] <= p.last[i]
                mine = np.where(on, np.where(whole, p.upto(i, part[-1:])[:, 0], p.held[i]), mine)
                theirs = np.where(on, np.where(whole, end, begin + np.searchsorted(part, p.last[i], "right")), theirs)
            nx = p.size[i]
            best = same + np.minimum(nx - mine, most - theirs)
            go = den * best >= num * (nx + least - best)
            i, same, mine, theirs = i[go], same[go], mine[go], theirs[go]
            if not len(i):
                continue
            if self.leaves[node] is not None:
                _join(lab, *self._near_all(p, self.leaves[node], i, end, same, mine, theirs, lab, probes, measure))
            todo += [(child, i, same, mine, theirs) for child in self.below[node]]

    def _near_all(self, p: _Probes, leaves: _Leaves, i, end: int, same, mine, theirs, lab, probes, measure: Measure) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that ``_Leaves.near`` finds for each of several sets."""
        num, den = measure.num, measure.den
        x, nx, y, ny = p.at[i][:, None], p.size[i][:, None], leaves.at[None, :], leaves.size[None, :]
        use = ((y > x) | ~probes[y]) & (lab[y] != lab[x]) & (ny * den >= num * nx) & (ny * num <= den * nx)
        best = same[:, None] + np.minimum(nx - mine[:, None], ny - theirs[:, None])
        use &= den * best >= num * (nx + ny - best)
        k, m = use.any(axis=1), use.any(axis=0)
        if not k.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, use, nx, ny, at = i[k][:, None], use[np.ix_(k, m)], nx[k], ny[:, m], leaves.at[m]
        same, mine, theirs = (np.repeat(v[k][:, None], len(at), axis=1) for v in (same, mine, theirs))
        on = theirs == end
        tails = [p.columns(y, end, None) for y in at]
        rows = np.zeros((len(at), p.table.shape[1]), np.float32)
        for row, tail in zip(rows, tails, strict=True):
            row[tail[tail >= 0]] = 1
        same = same + np.where(on, (p.table[i[:, 0]] @ rows.T).astype(np.int64), 0)
        if self.partial:
            whole = leaves.last[m][None, :] <= p.last[i]
            inside = np.stack([np.searchsorted(self.sets[y][end:], p.last[i[:, 0]], "right") for y in at], axis=1)
            theirs = np.where(on, np.where(whole, leaves.held[m][None, :], theirs + inside), theirs)
            mine = np.where(on, np.where(whole, p.upto(i[:, 0], leaves.last[m]), p.held[i]), mine)
        # of whole sets all elements are passed now
        best = same + np.where(on & (not self.partial), 0, np.minimum(nx - mine, ny - theirs))
        k, m = np.nonzero(use & (den * best >= num * (nx + ny - best)))
        return p.at[i[k, 0]], at[m]


def _join(lab: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Give linked sets the smaller label of both."""
    while True:
        apart = np.flatnonzero(lab[x] != lab[y])
        if not len(apart):
            return
        a, b = sorted((lab[x[apart[0]]], lab[y[apart[0]]]))
        lab[lab == b] = a
        x, y = x[apart], y[apart]


@dataclass(frozen=True)
class _Probes:
    """Sets that walk a tree together: places, sizes, elements known, the last of them; which shared elements they have (``table``), how many up to each of ``names`` (``sums``)."""

    at: np.ndarray
    size: np.ndarray
    held: np.ndarray
    last: np.ndarray
    table: np.ndarray
    sums: np.ndarray
    names: np.ndarray
    flat: np.ndarray
    cut: np.ndarray
    column: np.ndarray

    def columns(self, y: int, begin: int, end: int | None) -> np.ndarray:
        """Columns of the table for elements of a set; -1 for those that no other set here has."""
        stop = self.cut[y + 1] if end is None else self.cut[y] + end
        return self.column[self.flat[self.cut[y] + begin : stop]]

    def upto(self, i: np.ndarray, values: np.ndarray) -> np.ndarray:
        """How many elements of each set are no larger than each value."""
        at = np.searchsorted(self.names, values, "right") - 1
        return np.where(at >= 0, self.sums[np.ix_(i, np.maximum(at, 0))], 0).astype(np.int64)


@dataclass(frozen=True)
class _Leaves:
    """Sets below one node: place, what follows the common part, last element, elements known and in all."""

    at: np.ndarray
    flat: np.ndarray
    cut: np.ndarray
    last: np.ndarray
    held: np.ndarray
    size: np.ndarray

    def near(self, x: int, own, nx: int, lab, probes, same: int, mine: int, theirs: int, on: bool, measure: Measure) -> np.ndarray:
        """Places of those that link with x, have another label, and do not look for x themselves."""
        num, den = measure.num, measure.den
        best = same + np.minimum(nx - mine, self.size - theirs)
        use = ((self.at > x) | ~probes[self.at]) & (lab[self.at] != lab[x]) & (den * best >= num * (nx + self.size - best))
        use &= (self.size * den >= num * nx) & (self.size * num <= den * nx)
        pick = np.flatnonzero(use)
        if not len(pick):
            return pick
        size, shared, passed, used = self.size[pick], np.full(len(pick), same), np.full(len(pick), theirs), np.full(len(pick), mine)
        if on:
            length = self.cut[pick + 1] - self.cut[pick]
            if len(pick) == len(self.at):
                values = self.flat
            else:
                values = np.concatenate([self.flat[self.cut[i] : self.cut[i + 1]] for i in pick])
            row = np.repeat(np.arange(len(pick)), length)
            equal = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
            shared = same + np.bincount(row[equal], minlength=len(pick))
            whole = self.last[pick] <= own[-1]
            inside = np.bincount(row[values <= own[-1]], minlength=len(pick))
            passed = np.where(whole, self.held[pick], theirs + inside)
            used = np.where(whole, np.searchsorted(own, self.last[pick], "right"), len(own))
        best = shared + np.minimum(nx - used, size - passed)
        return self.at[pick[den * best >= num * (nx + size - best)]]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    m = min(len(a), len(b))
    differ = np.flatnonzero(a[:m] != b[:m])
    return int(differ[0]) if len(differ) else m


# --- tasks --------------------------------------------------------------------------


def _fingerprints(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set that tell sets apart."""
    out = []
    for seed in (31, 37):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix64(h, seed), out=sums[1:])
        out.append((sums[at[1:]] - sums[at[:-1]]).view(np.int64))
    return out[0], out[1]


def _signatures(measure: Measure):
    """(doc_id, text) to (doc_id, n, keep, f1, f2, low): size, fingerprint, the smallest hashes of the set, how many of them to use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            h, r = shingles(*words(part.column("text")), measure.words)
            at = bounds(r, part.num_rows)
            sets = [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            n = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets])
            f1, f2 = _fingerprints(flat, np.concatenate(([0], np.cumsum(n))))
            some = np.maximum(n, 1)
            take = np.where(n > 0, some - measure.least(some) + 1 + measure.spare(some), 0)
            keep = take - np.where(n > 0, measure.spare(measure.least(some)), 0)
            low = np.concatenate([np.zeros(0, np.uint64), *[s[:t] for s, t in zip(sets, take, strict=True)]])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *map(pa.array, (n, keep, f1, f2)), list_column(low.view(np.int64), take, pa.int64())],
                ["doc_id", "n", "keep", "f1", "f2", "low"],
            )

    return run


def _by_group(keys: tuple[str, ...], join):
    """A function over batches sorted by ``keys`` that gives ``join`` one group at a time, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, now = [], None
        for batch in batches:
            cols = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
            cuts = np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(cols)], strict=True):
                if a == b:
                    continue
                key = tuple(cols[a])
                if group and key != now:
                    yield join(pa.Table.from_batches(group))
                    group = []
                now = key
                group.append(batch.slice(a, b - a))
        if group:
            yield join(pa.Table.from_batches(group))

    return run


def _linked(table: pa.Table, at: np.ndarray, linked: np.ndarray) -> pa.RecordBatch:
    ids, labels = (pa.array(table.column(c).to_numpy()[at]) for c in ("set_id", "label"))
    return pa.RecordBatch.from_arrays([ids, labels, pa.array(linked)], ["set_id", "label", "linked"])


def _join_texts(measure: Measure):
    """A group (set_id, label, f1, f2, text) to (set_id, label, linked) by the sets of the texts.

    Rows whose text is not the set's (another row with the same doc_id) are left out.
    """

    def join(table: pa.Table) -> pa.RecordBatch:
        texts = table.column("text").combine_chunks()
        sets = [s for i in range(0, len(texts), 256) for s in gram_sets(texts.slice(i, 256), measure.words)]
        n = np.array([len(s) for s in sets], np.int64)
        f1, f2 = _fingerprints(np.concatenate(sets), np.concatenate(([0], np.cumsum(n))))
        at = np.flatnonzero((f1 == table.column("f1").to_numpy()) & (f2 == table.column("f2").to_numpy()))
        _, once = np.unique(table.column("set_id").to_numpy()[at], return_index=True)
        at = at[once]
        labels = table.column("label").to_numpy()[at]
        return _linked(table, at, PrefixTree([sets[i] for i in at]).link(labels, measure) if len(at) else labels)

    return join


def _join_signatures(measure: Measure):
    """A group (set_id, label, n, low) to (set_id, label, linked) by what the signatures leave possible."""

    def join(table: pa.Table) -> pa.RecordBatch:
        _, at = np.unique(table.column("set_id").to_numpy(), return_index=True)
        low = table.column("low").combine_chunks()
        sets = [low[int(i)].values.to_numpy().view(np.uint64) for i in at]
        tree = PrefixTree(sets, table.column("n").to_numpy()[at])
        return _linked(table, at, tree.link(table.column("label").to_numpy()[at], measure))

    return join


#: Links that one task may join up; more of them take distributed rounds.
LOCAL_LINKS = 500_000


def _roots(links: DataFrame) -> DataFrame:
    """(node, root) of (u, v) links: the smallest number that is connected.

    Links are counted first: up to ``LOCAL_LINKS`` (16 bytes each) are joined up by one task,
    which saves the rounds of shuffles; the result is the same.
    """
    links = stored(links, "jaccard-links")
    if links.count() > LOCAL_LINKS:
        return number_components(links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        ends = np.concatenate([np.zeros((0, 2), np.int64), *[np.stack([b.column(c).to_numpy() for c in ("u", "v")], axis=1) for b in got]])
        nodes, at = np.unique(ends, return_inverse=True)
        u, v = at.reshape(-1, 2).T
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[u], root[v])
            if (low == root[u]).all() and (low == root[v]).all():
                break
            for end in (u, v):
                np.minimum.at(root, root[end], low)
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])

    return stored(links.coalesce(1).mapInArrow(run, "node long, root long"), "jaccard-roots")


# --- the join -----------------------------------------------------------------------


_LINKED = "set_id long, label long, linked long"


def _by_text(docs: DataFrame, members: DataFrame, keys: tuple[str, ...], measure: Measure) -> DataFrame:
    """Fetch the texts of ``members`` (keys, set_id, label, first_doc, f1, f2) and join each group."""
    texts = docs.select(F.col("doc_id").alias("__i"), "text")
    rows = texts.join(counted(members), F.col("__i") == F.col("first_doc")).select(*keys, "set_id", "label", "f1", "f2", "text")
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "set_id")
    return dealt.mapInArrow(_by_group(keys, _join_texts(measure)), _LINKED)


def _pairs_of_chunks(at: DataFrame, sizes: DataFrame) -> DataFrame:
    """(a, b, ..): the rows of each shingle in ``sizes`` (gram, c, g), as pairs of chunks if they are many."""
    kept = at.columns
    at = at.join(sizes.select("gram", _parts("c", "g").alias("parts")), "gram")
    at = at.withColumn("x", F.pmod(F.xxhash64("set_id"), F.col("parts")))
    at = at.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return at.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *kept)


def _parts(n: str, grams: str) -> F.Column:
    """Into how many chunks a group of so many sets and shingles is cut."""
    return F.ceil(F.greatest(F.col(n) / CHUNK_SETS, F.col(grams) / CHUNK_GRAMS)).cast("long")


def _prefix_keys(sig: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_id, gram, n): the shingles by which a set can meet a similar one.

    A signature holds the n - least(n) + 1 + spare(n) smallest hashes of a set. A set lacks at
    most n - least(n) shingles of a similar one, so the two signatures share more than spare
    shingles of the smaller set. Each leaves out its most frequent ones, no more than the
    spare of the smallest set that could link. The rarest of the shared ones is left out by
    neither. Shingles of a single set meet nothing and are not kept.
    """
    own = sig.join(counted(sets.select("set_id")), F.col("rid") == F.col("set_id"), "left_semi")
    posted = own.select(F.col("rid").alias("set_id"), "n", "keep", F.size("low").alias("held"), F.explode("low").alias("gram"))
    posted = stored(posted, "jaccard-postings")
    found = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    found = stored(found.withColumnRenamed("gram", "g"), "jaccard-shared")
    met = posted.join(found, F.col("gram") == F.col("g"))
    # the shingles of one set
    per_set = Window.partitionBy("set_id")
    ranked = met.withColumn("rank", F.row_number().over(per_set.orderBy("df", "gram"))).withColumn("met", F.count(F.lit(1)).over(per_set))
    return ranked.where(F.col("rank") <= F.col("keep") - (F.col("held") - F.col("met"))).select("set_id", "gram", "n")


def components(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document; component_id is the smallest doc_id reachable by links.

    A-Z is folded; words are what white space separates. A text of fewer words
    than a shingle is one shingle. Null, empty and blank texts have no shingles and link
    with nothing. Rows without doc_id have no component (null) and link nothing. Rows with
    the same doc_id are one document, linked through each of their texts. Extra columns
    are not read. An empty table gives an empty table.

    Steps: signatures; documents with one set become one set; prefix shingles; blocks
    (components of sets over shared prefix shingles); large blocks are split by a tree join
    of the signatures; the tree join of the sets in blocks. Blocks that are still large are
    cut into chunks that all hold the block's first and last set; sets that are
    apart after that and share a prefix shingle meet in another tree join, by
    shingle, or by block where that takes fewer pairs. Every group that a task holds is bounded; larger ones go as
    pairs of chunks. Shingles are 64-bit hashes.
    """
    text_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        return _components(docs, measure)


def _components(docs: DataFrame, measure: Measure) -> DataFrame:
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sig = text.mapInArrow(_signatures(measure), "doc_id long, n long, keep long, f1 long, f2 long, low array<long>")
    sig = stored(sig.withColumn("rid", F.monotonically_increasing_id()), "jaccard-signatures")
    some = sig.where("n > 0 and doc_id is not null")
    sets = some.groupBy("f1", "f2", "n").agg(F.min("rid").alias("set_id"), F.min("doc_id").alias("first_doc"))
    sets = stored(sets, "jaccard-sets")
    keys = stored(_prefix_keys(sig, sets), "jaccard-keys")
    hubs = keys.groupBy("gram").agg(F.min("set_id").alias("v"), F.count(F.lit(1)).alias("c")).where("c > 1").select("gram", "v")
    star = keys.join(hubs, "gram").where("set_id <> v").select(F.col("set_id").alias("u"), "v").distinct()
    blocks = stored(_roots(star).select(F.col("node").alias("set_id"), F.col("root").alias("block")), "jaccard-blocks")
    links = _block_links(text, sets, keys, _split(sig, sets, keys, blocks, measure), measure)
    roots = _roots(links).select(F.col("node").alias("set_id"), "root")
    owner = sets.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    owner = stored(owner.select("f1", "f2", "n", "root", "first_doc"), "jaccard-owners")
    least = owner.groupBy("root").agg(F.min("first_doc").alias("component"))
    named = stored(owner.join(least, "root").select("f1", "f2", F.col("n").alias("m"), "component"), "jaccard-named")
    rows = some.select("doc_id", "n", "f1", "f2").join(
        named.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "m", "component"),
        (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("m")),
    )
    rows = _same_ids(stored(rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")), "jaccard-rows"))
    none = sig.where("n = 0 or doc_id is null")
    none = none.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).alias("component_id"))
    return stored(rows.unionByName(none), "jaccard-components", keep=True)


def _same_ids(rows: DataFrame) -> DataFrame:
    """Components that meet in the texts of one doc_id are one; usually doc_ids are unique."""
    twice = rows.groupBy("doc_id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a <> b")
    pairs = stored(rows.join(twice, "doc_id").select(F.col("component_id").alias("u"), F.col("a").alias("v")).where("u <> v").distinct(), "jaccard-twice")
    if pairs.isEmpty():
        return rows
    merged = _roots(pairs).select(F.col("node").alias("component_id"), "root")
    return rows.join(merged, "component_id", "left").select("doc_id", "n_shingles", F.coalesce("root", "component_id").alias("component_id"))


def _ranked(keys: DataFrame, sets: DataFrame) -> DataFrame:
    """The keys of some sets (set_id), numbered by hash within each set."""
    some = keys.join(counted(sets.select("set_id")), "set_id", "left_semi")
    # the keys of one set
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("set_id").orderBy("gram")))


def _dealt(ranked: DataFrame, members: DataFrame) -> DataFrame:
    """Keys in which the sets of a block meet once, by the block's number and with rank 0, where that takes fewer pairs than to meet in every shingle.

    A family of near copies shares most of its shingles, and would be compared as often.
    """
    place = members.where("parts > 1").select("set_id", "block").distinct()
    all_ = stored(ranked.join(place, "set_id"), "jaccard-meeting")
    met = all_.groupBy("block", "gram").agg(F.count(F.lit(1)).alias("c")).groupBy("block").agg(F.sum(F.col("c") * F.col("c")).alias("met"))
    size = place.groupBy("block").agg(F.count(F.lit(1)).alias("c"))
    once = counted(stored(met.join(size, "block").where(F.col("c") * F.col("c") <= F.col("met")).select("block"), "jaccard-once"))
    some = all_.join(once, "block", "left_anti").select("set_id", "gram", "n", "rank")
    rest = all_.join(once, "block", "left_semi").groupBy("set_id", "block").agg(F.first("n").alias("n"))
    return some.unionByName(rest.select("set_id", F.col("block").alias("gram"), "n", F.lit(0).alias("rank")))


def _apart(keys: DataFrame, state: DataFrame, take: int | None) -> tuple[DataFrame, DataFrame]:
    """The first ``take`` keys per set (all) with what ``state`` knows of it, and the size of each shingle whose sets have several labels."""
    at = stored((keys if take is None else keys.where(F.col("rank") <= take)).join(state, "set_id"), "jaccard-at")
    sizes = at.groupBy("gram").agg(F.min("label").alias("p"), F.max("label").alias("q"), F.count(F.lit(1)).alias("c"), F.sum("n").alias("g"))
    return at, stored(sizes.where("p <> q").select("gram", "c", "g"), "jaccard-apart")


def _relabelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(set_id, label): the smallest set that links lead to."""
    roots = _roots(links).select(F.col("node").alias("set_id"), F.col("root").alias("label"))
    out = sets.select("set_id").join(roots, "set_id", "left").select("set_id", F.coalesce("label", "set_id").alias("label"))
    return stored(out, "jaccard-labels")


def _split(sig: DataFrame, sets: DataFrame, keys: DataFrame, blocks: DataFrame, measure: Measure) -> DataFrame:
    """Blocks of more than one chunk, cut to the sets that may link by their signatures; other blocks as they are.

    Sets that share frequent passages hang together in large blocks. Per shingle their
    signatures are joined over a tree; few of them can reach the overlap. Two shingles per set
    come first, then all: near copies find each other early, and shingles of which all
    sets are together are not looked at again.
    """
    size = blocks.join(sets.select("set_id", "n"), "set_id").groupBy("block").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("g"))
    # blocks by size, not sets by block: a block may hold a third of the sets
    large = stored(size.where(_parts("c", "g") > 1).select("block"), "jaccard-large-blocks")
    inside = stored(blocks.join(counted(large), "block", "left_semi"), "jaccard-large")
    if inside.isEmpty():
        return blocks
    low = sig.select(F.col("rid").alias("set_id"), "low").join(counted(inside.select("set_id")), "set_id", "left_semi")
    low, own = stored(low, "jaccard-low"), stored(_ranked(keys, inside), "jaccard-ranked")
    labels, links = inside.select("set_id", F.col("set_id").alias("label")), None
    for take in (2, None):
        at, sizes = _apart(own, labels.join(low, "set_id"), take)
        if sizes.isEmpty():
            continue
        dealt = _pairs_of_chunks(at, sizes).repartition("gram", "a", "b").sortWithinPartitions("gram", "a", "b", "set_id")
        may = dealt.mapInArrow(_by_group(("gram", "a", "b"), _join_signatures(measure)), _LINKED)
        may = stored(may.where("label <> linked").select(F.col("label").alias("u"), F.col("linked").alias("v")).distinct(), "jaccard-may")
        links = may if links is None else links.unionByName(may)
        labels = _relabelled(inside, links)
    together = labels.groupBy("label").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("label")
    cut = labels.join(together, "label", "left_semi").select("set_id", F.col("label").alias("block"))
    return stored(blocks.join(counted(inside.select("set_id")), "set_id", "left_anti").unionByName(cut), "jaccard-split")


def _block_links(text: DataFrame, sets: DataFrame, keys: DataFrame, blocks: DataFrame, measure: Measure) -> DataFrame:
    """(u, v) numbers of sets that spans all links."""
    facts = sets.select("set_id", "n", "first_doc", "f1", "f2")
    size = blocks.join(sets.select("set_id", "n"), "set_id").groupBy("block")
    size = size.agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("g"), F.min("set_id").alias("lo"), F.max("set_id").alias("hi"))
    size = stored(size.withColumn("parts", _parts("c", "g")).drop("c", "g"), "jaccard-block-sizes")
    members = blocks.join(counted(size), "block")
    own = F.array(F.pmod(F.xxhash64("set_id"), F.col("parts")))
    every = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    hub = F.col("set_id").isin(F.col("lo"), F.col("hi"))
    members = members.withColumn("chunk", F.explode(F.when(hub, every).otherwise(own)))
    members = members.join(facts, "set_id").withColumn("label", F.col("set_id"))
    members = stored(members.select("block", "chunk", "parts", "set_id", "label", "first_doc", "f1", "f2"), "jaccard-members")
    local = stored(_by_text(text, members.drop("parts"), ("block", "chunk"), measure), "jaccard-local")
    links = local.where("set_id <> linked").select(F.col("set_id").alias("u"), F.col("linked").alias("v"))
    cut = stored(members.where("parts > 1").select("set_id").distinct(), "jaccard-chunked")
    if cut.isEmpty():
        return links
    # sets of cut blocks that are still apart, by the shingles that they share, or all of a block at once
    own = stored(_dealt(_ranked(keys, cut), members), "jaccard-ranked")
    for some, take in ((own, 2), (own.where("rank > 0"), None)):
        at, sizes = _apart(some, _relabelled(cut, links), take)
        if sizes.isEmpty():
            continue
        again = stored(_pairs_of_chunks(at, sizes).drop("n", "rank").join(facts.drop("n"), "set_id"), "jaccard-again")
        more = _by_text(text, again, ("gram", "a", "b"), measure).where("label <> linked")
        links = links.unionByName(stored(more.select(F.col("label").alias("u"), F.col("linked").alias("v")).distinct(), "jaccard-more"))
    return links


def dedup(docs: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """One document of each group of linked ones: that with the smallest doc_id. Columns are kept."""
    out = components(docs, measure).where("doc_id <> component_id").select(F.col("doc_id").alias("__i")).distinct()
    return docs.join(counted(stored(out, "jaccard-out")), F.col("doc_id") == F.col("__i"), "left_anti")
