"""Vectorised text kernels shared by the Arrow-side operators.

Everything works on the UTF-8 buffer of one bounded chunk of whole documents: no kernel sees more than
`limit` bytes plus one document at a time, so a worker's memory does not depend on the partition size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Word separators: blank and the five ASCII control separators 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes or items that one hashing step covers; the power tables below are as long and never grow.
HASH_BLOCK = 1 << 17


def _powers(base: int) -> np.ndarray:
    run = np.full(HASH_BLOCK + 1, base % (1 << 64), np.uint64)
    run[0] = 1
    return np.multiply.accumulate(run)


#: Powers of the hash base and of its inverse modulo 2^64.
_UP, _DOWN = _powers(int(_BASE)), _powers(pow(int(_BASE), -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def give_back() -> None:
    """Returns freed memory to the system: a worker stays alive beside the next stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def chunks(batches, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most `limit` bytes of text each (or one longer row)."""
    yield from _slices(batches, column, limit)
    give_back()


def _slices(batches, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at, done = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, end - at)
            at, done = end, int(size[end - 1])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes, cut at document bounds: starts, ends and the document of each."""
    n = len(inside)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = True
    starts = np.flatnonzero(first & inside)
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[edges[edges > 0] - 1] = True
    ends = np.flatnonzero(last & inside) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of anything but separators) of each document: starts, ends, document index."""
    return runs(~SPACE[data], offsets)


def _sums(values: np.ndarray) -> np.ndarray:
    """Running sums (from 0) of at most HASH_BLOCK values times the powers of the base."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _UP[: len(values)], out=total[1:])
    return total


def _long_hash(data: np.ndarray) -> np.uint64:
    """The sum behind a span's hash, block by block."""
    total, step = 0, pow(int(_BASE), HASH_BLOCK, 1 << 64)
    for at in range((len(data) - 1) // HASH_BLOCK * HASH_BLOCK, -1, -HASH_BLOCK):
        total = (total * step + int(_sums(data[at : at + HASH_BLOCK].astype(np.uint64) + np.uint64(1))[-1])) % (1 << 64)
    return np.uint64(total)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal spans have equal hashes in every chunk.

    Works in blocks of at most HASH_BLOCK bytes, so beside the result it needs a few MB however long the text is.
    """
    out = np.empty(len(starts), np.uint64)
    order = None
    if len(starts) > 1 and ((starts[1:] < starts[:-1]).any() or (ends[1:] < ends[:-1]).any()):
        order = np.argsort(ends, kind="stable")
        starts, ends = starts[order], ends[order]
    at = 0
    while at < len(starts):
        # Spans that end within a block of the first one's start; those that start sooner wait for a block of their own.
        base = int(starts[at])
        stop = at + int(np.searchsorted(ends[at:], base + HASH_BLOCK, "right"))
        if order is not None and stop > at:
            early = np.flatnonzero(starts[at:stop] < base)
            stop = at + int(early[0]) if len(early) else stop
        if stop == at:
            out[at] = _long_hash(data[base : ends[at]])
            at += 1
            continue
        total = _sums(data[base : ends[stop - 1]].astype(np.uint64) + np.uint64(1))
        first = starts[at:stop] - base
        out[at:stop] = (total[ends[at:stop] - base] - total[first]) * _DOWN[first]
        at = stop
    out = mix(out)
    if order is not None:
        back = np.empty_like(out)
        back[order] = out
        return back
    return out


def window_hashes(items: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k consecutive items (fewer than k items: none), in blocks as span_hashes."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if k >= HASH_BLOCK:
        raise ValueError(f"a window of {k} items; HASH_BLOCK is {HASH_BLOCK}")
    out = np.empty(n, np.uint64)
    step = HASH_BLOCK - k + 1
    for at in range(0, n, step):
        total = _sums(items[at : at + HASH_BLOCK])
        m = min(step, n - at)
        out[at : at + m] = (total[k : k + m] - total[:m]) * _DOWN[:m]
    return mix(out)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word shingles of each document: (hash, document). Documents of 1 to k-1 words give their whole sequence as one."""
    bounds = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(counts)), counts)
    window = window_hashes(hashes, k)
    whole = doc[: len(window)] == doc[k - 1 :] if len(window) else np.zeros(0, bool)
    out, of = window[whole], doc[: len(window)][whole]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for size in np.unique(counts[short]):
            rows = short[counts[short] == size]
            total = np.zeros(len(rows), np.uint64)
            for j in range(int(size)):
                total = mix(total * _BASE + hashes[bounds[rows] + j] + np.uint64(j + 1))
            extra[counts[short] == size] = total
        out, of = np.concatenate([out, extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        out, of = out[order], of[order]
    return out, of


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each of many ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep], lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    at = np.cumsum(lengths)[:-1]
    step[at] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(step)


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each document."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return lead[offsets[1:]] - lead[offsets[:-1]]


#: Items of a block, and labels up to which long sequences are cut into blocks.
VITERBI_BLOCK, VITERBI_LABELS = 256, 16


def viterbi(scores: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """The best label path of many sequences at once.

    scores: one row of label scores for each item, sequences one after the other; counts: their lengths;
    transition[a, b]: score of label b after label a. Exact; ties go to the smaller label.

    A sequence of several blocks is cut: the best scores from each label before a block to each label at its end are
    found for all blocks at once, chained block by block, and then each block's path is found between its known ends. So
    the number of numpy calls follows the block and the number of blocks, not the longest sequence.
    """
    labels, begin = scores.shape[1], np.cumsum(counts) - counts
    long = np.flatnonzero(counts > 2 * VITERBI_BLOCK) if labels <= VITERBI_LABELS else np.zeros(0, np.int64)
    if not len(long):
        return _paths(scores, begin, counts, transition, None, None)
    number = -(-counts[long] // VITERBI_BLOCK)
    own = np.repeat(np.arange(len(long)), number)
    turn = np.arange(len(own)) - np.repeat(np.cumsum(number) - number, number)
    start = begin[long][own] + turn * VITERBI_BLOCK
    size = np.minimum(counts[long][own] - turn * VITERBI_BLOCK, VITERBI_BLOCK)
    # From each label before a block to each label at its end; a first block has no label before it.
    row = np.repeat(np.arange(len(own)), np.where(turn == 0, 1, labels))
    enter = np.where(turn[row] == 0, -1, np.arange(len(row)) - np.searchsorted(row, row))
    ends = _ends(scores, start[row], size[row], transition, enter)
    at = np.searchsorted(row, np.arange(len(own)))
    first = np.cumsum(number) - number
    best, came = ends[at[first]].copy(), np.zeros((len(own), labels), np.int64)
    for j in range(1, int(number.max())):
        live = np.flatnonzero(number > j)
        block = first[live] + j
        reach = best[live][:, :, None] + ends[at[block][:, None] + np.arange(labels)]
        came[block] = reach.argmax(1)
        best[live] = reach.max(1)
    leave = np.zeros(len(own), np.int64)
    label = best.argmax(1)
    for j in range(int(number.max()) - 1, -1, -1):
        live = np.flatnonzero(number > j)
        block = first[live] + j
        leave[block] = label[live]
        label[live] = came[block, label[live]]
    before = np.where(turn == 0, -1, np.append(-1, leave[:-1]))
    short = np.flatnonzero(counts <= 2 * VITERBI_BLOCK)
    none = np.full(len(short), -1)
    return _paths(scores, np.append(begin[short], start), np.append(counts[short], size), transition, np.append(none, before), np.append(none, leave))


def _entered(scores: np.ndarray, begin: np.ndarray, transition: np.ndarray, enter: np.ndarray | None) -> np.ndarray:
    """Scores of the first item's labels, after the label before it (-1: none)."""
    best = scores[begin].copy()
    if enter is not None:
        some = enter >= 0
        best[some] += transition[enter[some]]
    return best


def _ends(scores: np.ndarray, begin: np.ndarray, size: np.ndarray, transition: np.ndarray, enter: np.ndarray) -> np.ndarray:
    """The best score of each label at the end of each sequence."""
    order = np.argsort(-size, kind="stable")
    begin, long = begin[order], size[order]
    best = _entered(scores, begin, transition, enter[order])
    for t in range(1, int(long[0])):
        n = int(np.searchsorted(-long, -t, "left"))
        now = best[:n]
        new = np.stack([(now + transition[:, b]).max(1) for b in range(scores.shape[1])], 1)
        best[:n] = new + scores[begin[:n] + t]
    out = np.empty_like(best)
    out[order] = best
    return out


def _paths(scores: np.ndarray, begin: np.ndarray, counts: np.ndarray, transition: np.ndarray, enter: np.ndarray | None, leave: np.ndarray | None) -> np.ndarray:
    """The best path of each sequence, given the label before it and its last label (None or -1: any).

    Step t advances every sequence longer than t together.
    """
    labels = scores.shape[1]
    order = np.argsort(-counts, kind="stable")
    size, begin = counts[order], begin[order]
    steps = int(size[0]) if len(size) else 0
    path = np.zeros(len(scores), np.int16)
    if not steps:
        return path
    active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    back = np.zeros((len(scores), labels), np.int16)
    k = int(active[0])
    best = _entered(scores, begin[:k], transition, None if enter is None else enter[order][:k])
    final = np.zeros((len(size), labels), scores.dtype)
    for t in range(1, steps):
        n = int(active[t])
        if n < k:
            final[n:k] = best[n:k]
            k = n
            best = best[:n]
        here = begin[:n] + t
        new = np.empty_like(best)
        for b in range(labels):
            reach = best + transition[:, b]
            came = reach.argmax(1)
            back[here, b] = came
            new[:, b] = reach[np.arange(n), came]
        best = new + scores[here]
    final[:k] = best
    live = int(active[0])
    state = final[:live].argmax(1)
    if leave is not None:
        told = leave[order][:live]
        state = np.where(told >= 0, told, state)
    for t in range(steps - 1, -1, -1):
        n = int(active[t])
        here = begin[:n] + t
        path[here] = state[:n]
        if t:
            state[:n] = back[here, state[:n]]
    return path
