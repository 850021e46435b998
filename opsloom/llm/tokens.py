"""Word and shingle hashes of Arrow text, computed on whole byte buffers.

A slice of a batch is one byte array. The hash of a word is a polynomial over its
bytes (difference of two prefix sums), so no Python object is made per word. Only
``SEGMENT`` bytes are expanded at once, cut between words, so memory does not
depend on the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
U64 = np.uint64


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x.astype(U64, copy=True) + U64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


_ODD = 0x9E3779B97F4A7C15 | 1
_BYTE = np.arange(256)
_FOLDED = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE)
#: A value for every byte, the same for A-Z and a-z.
_VALUE = mix64(np.arange(256).astype(U64), 7)[_FOLDED]

SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_ALNUM = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_FOLDED >= 97) & (_FOLDED <= 122)) | (_BYTE >= 128)
#: Separators when words are runs of letters and digits; every non-ASCII byte is part of a word.
PUNCT = ~_ALNUM

#: Lead bytes of characters of scripts without spaces, some of them with others.
_UNSPACED = (_BYTE == 0xE0) | (_BYTE == 0xE1) | ((_BYTE >= 0xE3) & (_BYTE <= 0xE9)) | (_BYTE == 0xF0)

_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 2**64))):
                p = np.full(max(n, SEGMENT), base, U64)
                p[0] = 1
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        _, at = buffers(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every character of a script that is written without spaces.

    Thai, Lao and Tibetan, Myanmar, Khmer, kana and Han (with the marks among them), of 3 bytes, and Han of 4 bytes.
    """
    lead = np.flatnonzero(_UNSPACED[data[:-1]])
    a, b = data[lead], data[lead + 1]
    use = ((a >= 0xE3) & (a <= 0xE9)) | ((a == 0xE0) & (b >= 0xB8)) | ((a == 0xE1) & (((b >= 0x80) & (b <= 0x82)) | (b == 0x9E) | (b == 0x9F))) | ((a == 0xF0) & (b >= 0xA0) & (b <= 0xB3))
    return lead[use], np.minimum(lead[use] + np.where(a[use] == 0xF0, 4, 3), len(data))


def words(texts: pa.Array, separators: np.ndarray = SPACE, alone: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word, in order; A-Z is folded to a-z. With ``alone``, characters of scripts without spaces are words."""
    data, at = buffers(texts)
    hashes, rows = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    lo, end = int(at[0]), int(at[-1])
    while lo < end:
        hi = min(lo + SEGMENT, end)
        while hi < end:
            bound = int(at[np.searchsorted(at, hi, "right") - 1])
            if bound > lo:
                hi = bound
                break
            gaps = np.flatnonzero(separators[data[lo:hi]])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
                break
            hi = min(hi + SEGMENT, end)
        part = data[lo:hi]
        apart = separators[part]
        begins = np.zeros(len(part) + 1, bool)
        inside = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)]
        begins[inside - lo] = True
        begins[-1] = True
        if alone:
            for bounds_of in unspaced(part):
                begins[bounds_of] = True
        before = np.empty(len(part), bool)
        before[0] = True
        before[1:] = apart[:-1]
        after = np.empty(len(part), bool)
        after[-1] = True
        after[:-1] = apart[1:]
        s = np.flatnonzero(~apart & (before | begins[:-1]))
        e = np.flatnonzero(~apart & (after | begins[1:])) + 1
        up, down = _powers(len(part))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, U64)
            np.cumsum(_VALUE[part] * up[: len(part)], out=sums[1:])
            hashes.append(mix64((sums[e] - sums[s]) * down[s], 1))
        rows.append(np.searchsorted(at, lo + s, "right") - 1)
        lo = hi
    return np.concatenate(hashes), np.concatenate(rows)


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of k words of a row; of fewer words the whole run as one. Sorted by row."""
    n = len(hashes)
    if not n:
        return hashes, rows
    out, of = [], []
    with np.errstate(over="ignore"):
        if n >= k:
            m = n - k + 1
            v = hashes[:m].copy()
            for j in range(1, k):
                v *= U64(_ODD)
                v += hashes[j : m + j]
            same = rows[:m] == rows[k - 1 :]
            out.append(mix64(v[same], 2))
            of.append(rows[:m][same])
        edge = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1], [True])))
        size = np.diff(edge)
        short = np.flatnonzero(size < k)
        for m in range(1, k):
            first = edge[short[size[short] == m]]
            if len(first):
                v = hashes[first].copy()
                for j in range(1, m):
                    v = v * U64(_ODD) + hashes[first + j]
                out.append(mix64(v, 100 + m))
                of.append(rows[first])
    h, r = np.concatenate(out), np.concatenate(of)
    if len(of) > 1:
        order = np.argsort(r, kind="stable")
        h, r = h[order], r[order]
    return h, r


def bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Start of every row's run in ``rows`` (sorted), and the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def gram_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of every text, ascending."""
    h, r = shingles(*words(texts), k)
    at = bounds(r, len(texts))
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def list_column(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Concatenated values as a column of lists."""
    at = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def byte_ngrams(texts: pa.Array, n: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of all n-grams of bytes, in order, some at a time; A-Z is folded, white space is one blank each."""
    data, at = buffers(texts)
    lo, end = int(at[0]), int(at[-1])
    with np.errstate(over="ignore"):
        while lo < end:
            hi = min(lo + SEGMENT, end)
            part = _GRAM[data[lo : min(hi + n - 1, end)]]
            m = len(part) - n + 1
            if m <= 0:
                return
            v = part[:m].copy()
            for j in range(1, n):
                v *= np.uint32(0x85EBCA6B)
                v += part[j : j + m]
            v ^= v >> np.uint32(15)
            v *= np.uint32(0x2C1B3C6D + 2 * n)
            row = _rows(at, lo, m)
            inside = np.arange(lo, lo + m) + n <= at[row + 1]
            yield (v[inside] >> np.uint32(32 - bits)).astype(np.int64), row[inside]
            lo = hi


def char_ngrams(texts: pa.Array, orders: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of all n-grams of code points of every order, by row, some at a time; letters are folded, white space is one blank each."""
    data, at = buffers(texts)
    lo, end, reach = int(at[0]), int(at[-1]), 4 * (max(orders) - 1)
    with np.errstate(over="ignore"):
        while lo < end:
            hi = _char_start(data, min(lo + SEGMENT, end), end)
            # n-grams that begin before ``hi`` end beyond it
            far = _char_start(data, min(hi + reach, end), end)
            starts = np.flatnonzero((data[lo:far] & 0xC0) != 0x80) + lo
            points = np.frombuffer(data[lo:far].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            part = _folded(points) * np.uint32(0x9E3779B1)
            part ^= part >> np.uint32(15)
            first, own = np.searchsorted(starts, at), int(np.searchsorted(starts, hi))
            v = part
            for n in range(1, max(orders) + 1):
                m = min(own, len(points) - n + 1)
                if m <= 0:
                    break
                v = part[:m] if n == 1 else v[:m] * np.uint32(0x85EBCA6B) + part[n - 1 : n - 1 + m]
                if n in orders:
                    h = (v ^ (v >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
                    row = np.repeat(np.arange(len(at) - 1), np.diff(np.minimum(first, m)))
                    inside = np.arange(m) + n <= first[row + 1]
                    yield (h[inside] >> np.uint32(32 - bits)).astype(np.int64), row[inside]
            lo = hi


def _char_start(data: np.ndarray, at: int, end: int) -> int:
    """The first byte from ``at`` that begins a character."""
    while at < end and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def _folded(points: np.ndarray) -> np.ndarray:
    """Code points in lower case where that is one code point, ASCII white space as a blank."""
    if not len(_LOWER):
        _LOWER.append(np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(1 << 16)], np.uint32))
        _LOWER[0][:256][SPACE] = 32
    return np.where(points < 1 << 16, _LOWER[0][np.minimum(points, (1 << 16) - 1)], points)


_LOWER: list[np.ndarray] = []


def _rows(at: np.ndarray, lo: int, m: int) -> np.ndarray:
    """The row of each of ``m`` bytes from ``lo``."""
    first = int(np.searchsorted(at, lo, "right")) - 1
    last = int(np.searchsorted(at, lo + m - 1, "right")) - 1
    cut = np.clip(at[first : last + 2], lo, lo + m)
    return np.repeat(np.arange(first, last + 1), np.diff(cut))


_GRAM = (mix64(np.arange(256).astype(U64), 11) >> U64(32)).astype(np.uint32)[np.where(SPACE, 32, _FOLDED)]
