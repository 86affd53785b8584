"""Removal of word passages that an earlier document already holds, by level-wise doubling.

Levels: lengths that double up to `length` (13 words: 7, then 13 as two windows of 7 that share a word). Level 1 hashes
every window where its document is read; each later level knows only the windows that more than one document holds at
the level before, and extends each by the one that starts a step further on if that survived, too. A level is a
distributed step: windows meet by hash range, those that several documents hold go to the group of their document,
which makes the next level's candidates. Words under a window of `length` words that a smaller id holds as well are
removed; windows are judged on the input, not on what is left. With `longest` the levels go on doubling until no
candidate survives, which gives the longest repeated level of each document.

Windows are told apart by 64 bits at the first of several levels, which only proposes candidates, and by 128 bits from
the second on (a single level uses 128). A passage's rows are pre-reduced: a chunk or group sends the windows of its
smallest id only and marks its other documents at once, so a passage in a third of all documents costs its range one
row a chunk.

Edge cases: null and empty texts have no words and an empty remainder; documents shorter than a window lose nothing;
rows with a null id lose nothing and are no source; rows that share an id count as one document, and a mark applies to
those of them whose text has the window; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from variq.llm import _text
from variq.llm._store import Tables

#: A first level has no more words than this.
START = 8
_SEND = "part int, kind int, doc_id long, text string, hashes binary, places binary"
_NAMES = [f.split()[0] for f in _SEND.split(", ")]
_NO_ID = -(1 << 63)
_OTHER = np.uint64(0xD6E8FEB86659FD93)
_WINDOW, _SURVIVOR, _DOCUMENT = 0, 1, 2  # kinds of rows


def levels_to(length: int) -> list[int]:
    """The lengths of the levels up to `length`, each at most twice the one before."""
    out = [length]
    while out[0] > START:
        out.insert(0, (out[0] + 1) // 2)
    return out


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of integers, each as differences, compressed together."""
    return zstandard.compress(b"".join(np.diff(c, prepend=c.dtype.type(0)).tobytes() for c in columns), 1)


def _unpack(raw: bytes, kinds: tuple) -> list[np.ndarray]:
    data = zstandard.decompress(raw)
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        size = n * np.dtype(k).itemsize
        out.append(np.cumsum(np.frombuffer(data[at : at + size], k), dtype=k))
        at += size
    return out


class Windows:
    """Windows of one length: keys (64 or 128 bits), ids, positions and a flag (window: also in another document of the
    chunk; survivor: a smaller id has it)."""

    KINDS = (np.int64, np.int32, np.uint8)

    def __init__(self, keys: list[np.ndarray], ids: np.ndarray, at: np.ndarray, flag: np.ndarray | None = None):
        self.keys, self.ids, self.at = keys, ids, at
        self.flag = np.zeros(len(ids), bool) if flag is None else flag

    def __len__(self) -> int:
        return len(self.ids)

    def take(self, where: np.ndarray) -> Windows:
        return Windows([k[where] for k in self.keys], self.ids[where], self.at[where], self.flag[where])

    @classmethod
    def join(cls, parts: list[Windows]) -> Windows:
        return cls([np.concatenate(k) for k in zip(*(p.keys for p in parts), strict=True)], *(np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "at", "flag")))

    def packed(self) -> tuple[bytes, bytes]:
        return b"".join(k.tobytes() for k in self.keys), _pack(self.ids, self.at.astype(np.int32), self.flag.astype(np.uint8))

    @classmethod
    def unpacked(cls, hashes: bytes, places: bytes) -> Windows:
        ids, at, flag = _unpack(places, cls.KINDS)
        return cls(list(np.frombuffer(hashes, np.uint64).reshape(-1, len(ids))), ids, at.astype(np.int64), flag.astype(bool))

    def rows(self, part: np.ndarray, kind: int) -> pa.RecordBatch:
        """One row a part."""
        order = np.lexsort((self.at, self.ids, part))
        part = part[order]
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
        blobs = [self.take(order[a:b]).packed() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        n = len(blobs)
        return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), pa.array([kind] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), *[pa.array([b[i] for b in blobs], pa.binary()) for i in (0, 1)]], _NAMES)

    def judged(self) -> tuple[Windows, np.ndarray]:
        """Sorted by key and id, with whether several documents have each one (or its flag says so); flags then say
        whether a smaller id has it."""
        held = self.take(np.lexsort((self.at, self.ids, *self.keys)))
        if not len(held):
            return held, np.zeros(0, bool)
        new = np.zeros(len(held), bool)
        new[0] = True
        for k in held.keys:
            new[1:] |= k[1:] != k[:-1]
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(held)))
        first, last = held.ids[start], held.ids[start + size - 1]
        several = np.repeat((first != last) | np.logical_or.reduceat(held.flag, start), size)
        held.flag = held.ids > np.repeat(first, size)
        return held, several


def _words(texts: pa.Array, n: int):
    data, offsets = _text.utf8(texts)
    starts, ends, doc = _text.words(data, offsets)
    return data, starts, ends, doc, np.bincount(doc, minlength=n)


def _first_windows(texts: pa.Array, ids: np.ndarray, length: int, wide: bool) -> Windows:
    """Every window of the chunk. wide: 128-bit keys."""
    data, starts, ends, doc, count = _words(texts, len(ids))
    words = _text.span_hashes(data, starts, ends)
    keys = [_text.window_hashes(w, length) for w in ((words, _text.mix(words ^ _OTHER)) if wide else (words,))]
    n = len(keys[0])
    at = np.arange(n) - np.repeat(np.cumsum(count) - count, count)[:n]
    good = (doc[:n] == doc[length - 1 :]) & (ids[doc[:n]] != _NO_ID) if n else np.zeros(0, bool)
    return Windows([k[good] for k in keys], ids[doc[:n][good]], at[good])


def _extended(held: Windows, step: int) -> Windows:
    """The next level's candidates: windows of which the one `step` words on survived as well."""
    held = held.take(np.lexsort((*held.keys, held.at, held.ids)))
    if not len(held):
        return Windows([np.zeros(0, np.uint64)] * 2, held.ids, held.at)
    _, dense = np.unique(held.ids, return_inverse=True)
    place = dense.astype(np.int64) << 32 | held.at
    lo, hi = np.searchsorted(place, place + step, "left"), np.searchsorted(place, place + step, "right")
    # Rows that share an id can have several windows at a place.
    one, two = np.repeat(np.arange(len(held)), hi - lo), _text.ragged(lo, hi - lo)
    return Windows(_combined([k[one] for k in held.keys], [k[two] for k in held.keys]), held.ids[one], held.at[one])


def _combined(one: list[np.ndarray], two: list[np.ndarray]) -> list[np.ndarray]:
    """128-bit keys of windows made of two shorter ones."""
    if len(one) == 1:
        return [one[0], two[0]]
    return [_text.mix(_text.mix(a ^ salt) + b * _OTHER) for a, b, salt in zip(one, two, (np.uint64(1), _OTHER), strict=True)]


def _owner(ids: np.ndarray, groups: int) -> np.ndarray:
    return (_text.mix(ids.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _sent(found: Windows, ranges: int, groups: int, turn: int):
    """A chunk's windows to their ranges; what the chunk can tell alone goes through to the groups."""
    held, several = found.judged()
    later = held.flag.copy()
    told = held.take(later)
    if len(told):
        rows = told.rows(_owner(told.ids, groups), _SURVIVOR)
        # The group's number travels in doc_id; the rows themselves are dealt evenly over ranges of their own.
        yield rows.set_column(2, "doc_id", rows.column("part").cast(pa.int64())).set_column(0, "part", pa.array(ranges + (np.arange(rows.num_rows) + turn) % ranges, pa.int32()))
    held.flag = several
    own = held.take(~later)
    if len(own):
        key = own.keys[0] if len(own.keys) == 1 else _text.mix(own.keys[0] ^ own.keys[1])
        yield own.rows((key >> np.uint64(32)).astype(np.int64) * ranges >> 32, _WINDOW)


def _by_part(batches):
    """(part, windows of all its rows) of rows that come sorted by part."""
    now, held = None, []
    for batch in batches:
        for part, *blobs in zip(*(batch.column(c).to_pylist() for c in ("part", "hashes", "places")), strict=True):
            if part != now and held:
                yield now, Windows.join(held)
                held = []
            now = part
            held.append(Windows.unpacked(*blobs))
    if held:
        yield now, Windows.join(held)


def _level(found: DataFrame, partitions: int, groups: int) -> DataFrame:
    """Survivors, by the group of their document, of windows that were sent to ranges."""

    def judge(batches):
        waiting: list[Windows] = []

        def tell():
            """Survivors of many ranges at once: a task sends a group few rows, however many ranges there are."""
            if waiting:
                some = Windows.join(waiting)
                waiting.clear()
                yield some.rows(_owner(some.ids, groups), _SURVIVOR)

        def windows():
            for batch in batches:
                passing = batch.filter(pc.equal(batch.column("kind"), _SURVIVOR))
                if passing.num_rows:
                    through.append(passing.set_column(0, "part", passing.column("doc_id").cast(pa.int32())).set_column(2, "doc_id", pa.nulls(passing.num_rows, pa.int64())))
                yield batch.filter(pc.equal(batch.column("kind"), _WINDOW))

        through: list[pa.RecordBatch] = []
        for _, held in _by_part(windows()):
            yield from through
            through.clear()
            held, several = held.judged()
            waiting.append(held.take(several))
            if sum(map(len, waiting)) > 1 << 20:
                yield from tell()
        yield from through
        yield from tell()

    return found.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(judge, _SEND)


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = 13, partitions: int | None = None, with_text: bool = False, longest: bool = False, survivors: list | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed, kept_sha256, removed_spans (start:end in words, comma-joined) and,
    if asked for, kept_text and longest_repeat (the longest level at which a smaller id has a window of it; 0: none).

    survivors: a list that gets (words, windows that several documents hold) of each level but the last.
    """
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges, groups = partitions * 4, partitions * 2
    tables = Tables(docs.sparkSession, "substrings")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    levels = levels_to(length)

    def first(batches):
        turn = 0
        for batch in _text.chunks(batches, "text", 6 << 20):
            ids = pc.fill_null(batch.column("doc_id"), _NO_ID).to_numpy(zero_copy_only=False)
            for out in _sent(_first_windows(batch.column("text"), ids, levels[0], len(levels) == 1), ranges, groups, turn):
                turn += out.num_rows
                yield out

    def extend(step: int):
        def run(batches):
            """Several groups' candidates at once, and fewer ranges than at first: a task sends few rows to each."""
            turn, waiting = 0, []
            for _, held in _by_part(batches):
                waiting.append(_extended(held, step))
                if sum(map(len, waiting)) > 1 << 20:
                    for out in _sent(Windows.join(waiting), partitions, groups, turn):
                        turn += out.num_rows
                        yield out
                    waiting = []
            if waiting:
                yield from _sent(Windows.join(waiting), partitions, groups, turn)

        return run

    def counted(batches):
        for batch in batches:
            held = [Windows.unpacked(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("hashes", "places")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in held], pa.int64())], ["windows"])

    def save(found: DataFrame, words: int) -> tuple[DataFrame, int]:
        seen = Observation()
        out = tables.save(found.observe(seen, F.count("*").alias("rows")), f"level{words}")
        if survivors is not None:
            survivors.append((words, out.mapInArrow(counted, "windows long").agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]))
        return out, seen.get["rows"]

    def next_level(held: DataFrame, step: int) -> DataFrame:
        sent = held.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(extend(step), _SEND)
        return _level(sent, partitions, groups)

    now = _level(rows.mapInArrow(first, _SEND), partitions, groups)
    for before, words in zip(levels, levels[1:], strict=False):
        held, _ = save(now, before)
        now = next_level(held, words - before)
    target, _ = save(now, length)
    tables.drop_all_but(target)

    def marks(batches):
        """What the last step needs of a survivor: its place and 16 bits of its key, if a smaller id has it."""
        for batch in batches:
            out = []
            for part, *blobs in zip(*(batch.column(c).to_pylist() for c in ("part", "hashes", "places")), strict=True):
                held = Windows.unpacked(*blobs)
                held = held.take(held.flag)
                if len(held):
                    out.append((part, _pack(held.ids, held.at.astype(np.int32), _check(held.keys))))
            n = len(out)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([_SURVIVOR] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.array([x for _, x in out], pa.binary())], _NAMES)

    def own_group(batches):
        for batch in batches:
            ids = pc.fill_null(batch.column("doc_id"), _NO_ID).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(_owner(ids, groups), pa.int32()), pa.array([_DOCUMENT] * n, pa.int32()), *batch.columns, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], _NAMES)

    fields = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed_spans string" + ", kept_text string" * with_text

    def finish(batches):
        """A group's marks come before its documents."""
        now, held, table = None, [], None
        for batch in _text.chunks(batches, "text"):
            part = batch.column("part").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                some = batch.slice(a, b - a)
                if part[a] != now:
                    now, held, table = int(part[a]), [], None
                held += some.filter(pc.equal(some.column("kind"), _SURVIVOR)).column("places").to_pylist()
                some = some.filter(pc.equal(some.column("kind"), _DOCUMENT))
                if some.num_rows:
                    if table is None:
                        table = _table(held)
                        held = []
                    yield _finish(some.column("doc_id"), some.column("text"), table, levels, with_text)

    out = target.mapInArrow(marks, _SEND).unionByName(rows.mapInArrow(own_group, _SEND)).repartition(partitions, "part").sortWithinPartitions("part", "kind").mapInArrow(finish, fields)
    return out.join(_longest(target, next_level, save, length), "doc_id", "left").withColumn("longest_repeat", F.coalesce("longest_repeat", F.lit(0).cast("long"))) if longest else out


def _longest(held: DataFrame, next_level, save, words: int) -> DataFrame:
    """(doc_id, longest_repeat): levels double until nothing survives."""

    def later(words: int):
        def run(batches):
            for batch in batches:
                held = [Windows.unpacked(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("hashes", "places")), strict=True)]
                ids = np.unique(np.concatenate([x.ids[x.flag] for x in held])) if held else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), words))], ["doc_id", "longest_repeat"])

        return run

    found = held.mapInArrow(later(words), "doc_id long, longest_repeat long")
    n = 1
    while n:
        held, n = save(next_level(held, words), 2 * words)
        words *= 2
        found = found.unionByName(held.mapInArrow(later(words), "doc_id long, longest_repeat long"))
    return found.groupBy("doc_id").agg(F.max("longest_repeat").alias("longest_repeat"))


def _check(keys: list[np.ndarray]) -> np.ndarray:
    """16 bits of a window's key."""
    return (_text.mix(keys[0] ^ (keys[1] * _OTHER)) >> np.uint64(48)).astype(np.int32)


def _table(marks: list[bytes]) -> tuple[np.ndarray, ...]:
    """The group's marks (id, position, check), sorted."""
    if not marks:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    parts = [_unpack(x, (np.int64, np.int32, np.int32)) for x in marks]
    ids, at, check = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(3))
    order = np.lexsort((at, ids))
    return ids[order], at[order], check[order]


def _target_keys(words: np.ndarray, levels: list[int]) -> list[np.ndarray]:
    """Keys of all windows of the last level, over words laid end to end (those across documents mean nothing)."""
    if len(levels) == 1:
        return [_text.window_hashes(w, levels[0]) for w in (words, _text.mix(words ^ _OTHER))]
    keys = [_text.window_hashes(words, levels[0])]
    for before, now in zip(levels, levels[1:], strict=False):
        n, step = len(words) - now + 1, now - before
        if n <= 0:
            return [np.zeros(0, np.uint64)] * 2
        keys = _combined([k[:n] for k in keys], [k[step : step + n] for k in keys])
    return keys


def _finish(doc_ids: pa.Array, texts: pa.Array, table: tuple[np.ndarray, ...], levels: list[int], with_text: bool) -> pa.RecordBatch:
    n, length = len(doc_ids), levels[-1]
    ids = pc.fill_null(doc_ids, _NO_ID).to_numpy(zero_copy_only=False)
    data, starts, ends, doc, count = _words(texts, n)
    base = np.cumsum(count) - count
    lo, hi = np.searchsorted(table[0], ids, "left"), np.searchsorted(table[0], ids, "right")
    size = np.where(ids == _NO_ID, 0, hi - lo)
    row, owner = _text.ragged(lo, size), np.repeat(np.arange(n), size)
    at, check = table[1][row], table[2][row]
    fits = at + length <= count[owner]
    at, check, owner = at[fits], check[fits], owner[fits]
    if len(at):  # rows that share an id can differ in text
        keys = _target_keys(_text.span_hashes(data, starts, ends), levels)
        spot = base[owner] + at
        fits = _check([k[spot] for k in keys]) == check
        at, owner = at[fits], owner[fits]
    change = np.zeros(len(starts) + 1, np.int64)
    np.add.at(change, base[owner] + at, 1)
    np.add.at(change, base[owner] + at + length, -1)
    gone = np.cumsum(change)[:-1] > 0
    keep = ~gone
    s, e, d = starts[keep], ends[keep], doc[keep]
    size = e - s + 1
    buffer = np.append(data, np.uint8(32))[_text.ragged(s, size)]
    close = np.cumsum(size)
    buffer[close - 1] = 32
    bound = np.concatenate([[0], close])[np.searchsorted(d, np.arange(n + 1))]
    whole = buffer.tobytes()
    kept = [whole[a : b - 1] if b > a else b"" for a, b in zip(bound[:-1], bound[1:], strict=True)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])) if len(gone) else np.zeros(0))
    spans = [""] * n
    flat = np.concatenate([[False], (doc[1:] != doc[:-1]) & gone[1:] & gone[:-1]]) if len(gone) else np.zeros(0, bool)
    cuts = np.sort(np.concatenate([edge, np.repeat(np.flatnonzero(flat), 2)])) if len(gone) else edge
    for a, b in zip(cuts[::2], cuts[1::2], strict=True):
        k = doc[a]
        one = f"{a - base[k]}:{b - base[k]}"
        spans[k] = f"{spans[k]},{one}" if spans[k] else one
    columns = [doc_ids, pa.array(count, pa.int64()), pa.array(np.bincount(doc[gone], minlength=n), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(spans, pa.string())]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed_spans"]
    if with_text:
        columns, names = [*columns, pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())], [*names, "kept_text"]
    return pa.RecordBatch.from_arrays(columns, names)
