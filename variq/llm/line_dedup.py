"""Fuzzy deduplication of lines across documents, with DataFrame expressions only.

1. Lines (split at line feeds, blanks at the ends and case of letters ignored) that are equal form a class. Classes are
   pre-aggregated before they are shuffled and written once, bucketed by class, so later joins don't move texts again.
2. Signature: every shingle of `k` UTF-8 bytes is hashed once, the hash picks one of bands x rows bins, a bin keeps its
   smallest hash (one-permutation MinHash; a bin without a shingle counts as empty on both sides). Of a line with more
   than PER_BIN shingles a bin only the smaller hashes are looked at, that many a bin on average.
3. Banding: classes that agree on all bins of a band (empty bands aside) meet in a bucket; each is paired with the
   bucket's first class.
4. Pairs are verified by the exact Jaccard similarity of their shingle sets; distributed union-find joins them.
5. Buckets of three or more that still mix components are settled exactly: all pairs of different components there are
   compared, in blocks, by the sizes of their sets and by sketches that no similar pair fails, and what is left is
   verified. So lines of similarity `similar` that share a bucket always end in one group.
6. Of each component the first line (smallest id, then text hash, then position) stays.

With 12 bands of 4 rows two lines of similarity 0.8 meet with probability 0.998, of 0.9 with more than 0.99999; lines
that differ in length by a fifth, both of more than PER_BIN shingles a bin, of similarity 0.8 with 0.997.

With `kernels` signatures and verification are Arrow kernels in Python workers, which take less CPU time (figures in the
README). The query and the pipeline don't use them.

Edge cases: null texts stay null, empty texts and blank lines are kept as they are; lines shorter than k bytes are one
shingle (in the kernels filled with zero bytes); rows with a null id lose no line and keep others' lines; rows that share
an id are told apart by their texts, rows that share both are judged alike; an empty table gives no rows; input columns
named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variq.llm import _text
from variq.llm._components import components
from variq.llm._store import Tables

K, SIMILAR, BANDS, ROWS = 8, 0.8, 12, 4
#: Bytes of lines that a task compares at once; larger buckets are split into blocks.
BLOCK_BYTES = 2 << 20
#: Bytes of heads (repeated for each pair) whose sets a task makes at once.
HEAD_BYTES = 4 << 20
#: Sets up to which pairs are compared at once, without first looking for those that have no partner.
FEW = 12
GROUP_BITS = 9
#: Bytes of a line that a lambda reads at once.
PIECE = 64
#: Hashes that a bin is expected to see at least; of longer lines the largest hashes are left out before.
PER_BIN = 4
#: Words of 64 bits of a sketch, and classes of a bucket that are compared with each other at once.
WORDS, BLOCK_ROWS = 16, 1024
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SENT = "part int, keys binary, cls binary, key long, member long, head long"


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, of, at, cls, line) of each line that isn't blank; `of` is a hash of the whole text."""
    raw = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("of"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    # Blank lines are told before letters are lowered: a filter on the result would lower every line twice.
    return raw.filter(F.trim("line") != "").withColumn("line", F.lower(F.trim("line"))).withColumn("cls", F.xxhash64("line"))


def _at_bytes(data: np.ndarray, k: int) -> np.ndarray:
    """The k-byte shingle that starts at each byte (beyond the end: filled with zeros). The bytes themselves for k up to 8."""
    if k > 8:
        return _text.window_hashes(np.append(data, np.zeros(k - 1, np.uint8)).astype(np.uint64) + np.uint64(1), k)
    wide = np.ndarray(len(data), "<u8", buffer=np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    return wide if k == 8 else wide & np.uint64((1 << 8 * k) - 1)


def _short(data: np.ndarray, offsets: np.ndarray, lines: np.ndarray, k: int) -> np.ndarray:
    """The only shingle of each line of fewer than k bytes: its bytes and zeros."""
    filled = np.zeros((len(lines), k), np.uint8)
    size = offsets[lines + 1] - offsets[lines]
    at = _text.ragged(offsets[lines], size)
    row = np.repeat(np.arange(len(lines)), size)
    filled[row, at - offsets[lines][row]] = data[at]
    return _at_bytes(filled.ravel(), k)[::k]


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each line. Lines of about one size are sorted together, as rows of a matrix."""
    size = np.diff(offsets)
    n, value = len(size), _at_bytes(data, k)
    count = np.where(size > 0, np.maximum(size - k + 1, 1), 0)
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * n
    short = np.flatnonzero((size > 0) & (size < k))
    for i, x in zip(short.tolist(), _short(data, offsets, short, k), strict=True):
        out[i] = np.array([x])
    order = np.argsort(count, kind="stable")
    order = order[size[order] >= k]
    at, sizes = 0, count[order]
    while at < len(order):
        # Rows of up to a quarter more shingles than the first, some 64K shingles in all.
        width = int(sizes[at])
        end = max(at + 1, min(int(np.searchsorted(sizes, width + width // 4, "right")), at + (1 << 16) // width))
        rows, width = order[at:end], int(sizes[end - 1])
        place = offsets[rows, None] + np.arange(width)
        block = value[np.minimum(place, len(value) - 1)]
        block[np.arange(width) >= sizes[at:end, None]] = _NONE
        block.sort(axis=1)
        fresh = block != _NONE
        fresh[:, 1:] &= block[:, 1:] != block[:, :-1]
        held = fresh.sum(1)
        flat, stop = block[fresh], np.cumsum(held)
        for i, a, b in zip(rows.tolist(), (stop - held).tolist(), stop.tolist(), strict=True):
            out[i] = flat[a:b]
        at = end
    return out


def signatures(data: np.ndarray, offsets: np.ndarray, k: int, bins: int) -> np.ndarray:
    """[line, bin]: the smallest hash of each bin; all bits set where a bin has no shingle. In blocks of bytes."""
    size = np.diff(offsets)
    low = np.full(len(size) * bins, _NONE, np.uint64)

    def put(value: np.ndarray, line: np.ndarray, counts: np.ndarray | None = None) -> None:
        value = _text.mix(value * _GOLD)
        slot = ((value >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        if counts is not None:
            value[~counts] = _NONE
        np.minimum.at(low, line * bins + slot, value)

    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        put(_short(data, offsets, short, k), short)
    for at in range(0, len(data), _text.HASH_BLOCK):
        end = min(len(data), at + _text.HASH_BLOCK)
        value = _at_bytes(data[at : end + k - 1], k)[: end - at]
        # The line of each byte; shingles that reach beyond its end don't count.
        first = int(np.searchsorted(offsets, at, "right")) - 1
        last = int(np.searchsorted(offsets, end, "left"))
        bounds = np.clip(offsets[first : last + 1], at, end)
        line = np.repeat(np.arange(first, last), np.diff(bounds))
        counts = np.ones(end - at, bool)
        ends = offsets[first + 1 : last + 1]
        for back in range(1, k):
            cut = ends - back
            cut = cut[(cut >= at) & (cut < end)]
            counts[cut - at] = False
        put(value, line, counts)
    return low.reshape(len(size), bins)


def band_keys(low: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, line) of each band that isn't empty."""
    keys, of = [], []
    for band in range(bands):
        part = low[:, band * rows : (band + 1) * rows]
        some = np.flatnonzero((part != _NONE).any(1))
        key = np.full(len(some), band + 1, np.uint64)
        for r in range(rows):
            key = _text.mix(key * _GOLD + part[some, r])
        keys.append(key)
        of.append(some)
    return np.concatenate(keys), np.concatenate(of)


def _buckets(keys: np.ndarray, cls: np.ndarray):
    """Entries sorted by key and class, the first class of each one's bucket, the bucket's size, where buckets begin."""
    order = np.lexsort((cls, keys))
    keys, cls = keys[order], cls[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(keys)))
    return keys, cls, np.repeat(cls[start], size), np.repeat(size, size), start


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys as their first bytes, their second ones and so on: the leading ones repeat and compress well."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(">u8")[:, 0].astype(np.uint64)


def _met_rows(keys: np.ndarray, cls: np.ndarray, head: np.ndarray) -> pa.RecordBatch:
    n = len(keys)
    nothing = [pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.binary())]
    return pa.RecordBatch.from_arrays([*nothing, pa.array(keys.view(np.int64)), pa.array(cls), pa.array(head)], [f.split()[0] for f in _SENT.split(", ")])


def _met_in_kernels(classes: DataFrame, k: int, bands: int, rows: int, partitions: int) -> DataFrame:
    """(key, cls, head) of classes that share a bucket: members of it in a chunk with the chunk's first, and the chunks'
    first ones with the bucket's first."""
    parts, names = partitions * 4, [f.split()[0] for f in _SENT.split(", ")]

    def send(batches):
        for batch in _text.chunks(batches, "line"):
            data, offsets = _text.utf8(batch.column("line"))
            own = batch.column("cls").to_numpy()
            keys, of = band_keys(signatures(data, offsets, k, bands * rows), bands, rows)
            keys, cls, head, size, start = _buckets(keys, own[of])
            several = size > 1
            if several.any():
                out = _met_rows(keys[several], cls[several], head[several])
                # They pass through the step below unchanged, dealt evenly.
                yield out.set_column(0, "part", pa.array(np.arange(out.num_rows) % parts, pa.int32()))
            keys, cls = keys[start], cls[start]
            part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)  # sorted, as keys are
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
            blobs = [[pack(x[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)] for x, pack in ((keys, _planes), (cls, np.ndarray.tobytes))]
            n = len(cut) - 1
            yield pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]].astype(np.int32)), *[pa.array(x, pa.binary()) for x in blobs], *[pa.nulls(n, pa.int64()) for _ in range(3)]], names)

    def meet(batches):
        now, held = None, []

        def done():
            if not held:
                return
            keys, cls = np.concatenate([_from_planes(x[0]) for x in held]), np.frombuffer(b"".join(x[1] for x in held), np.int64)
            held.clear()
            keys, cls, head, size, _ = _buckets(keys, cls)
            several = size > 1  # of buckets of a single chunk that chunk has told the members
            yield pa.RecordBatch.from_arrays([pa.array(keys[several].view(np.int64)), pa.array(cls[several]), pa.array(head[several])], ["key", "cls", "head"])

        for batch in batches:
            passing = batch.filter(batch.column("key").is_valid())
            if passing.num_rows:
                yield pa.RecordBatch.from_arrays([passing.column(c) for c in ("key", "member", "head")], ["key", "cls", "head"])
            batch = batch.filter(batch.column("keys").is_valid())
            for part, *blobs in zip(*(batch.column(c).to_pylist() for c in names[:3]), strict=True):
                if part != now:
                    yield from done()
                now = part
                held.append(blobs)
        yield from done()

    sent = classes.select("cls", "line").mapInArrow(send, _SENT)
    return sent.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(meet, "key long, cls long, head long")


def _needed(a, b, similar: float):
    """The smallest overlap of sets of a and b with similarity `similar`."""
    return np.ceil((a + b) * (similar / (1 + similar)) - 1e-9)


def _overlaps(mine: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    size = np.array([len(x) for x in others])
    every = np.concatenate(others)
    spot = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
    return np.add.reduceat((mine[spot] == every).astype(np.int64), np.cumsum(size) - size)


def verified(batches, k: int, similar: float):
    """Batches (a, b) of the pairs (cls, head; texts x, y) whose shingle sets are similar enough. Rows of a head come one
    after the other."""
    head, mine = None, None
    for batch in _text.chunks(_text.chunks(batches, "x", 1 << 20), "y", HEAD_BYTES):
        sets = sets_of(*_text.utf8(batch.column("x")), k)
        heads, cls = batch.column("head").to_numpy(), batch.column("cls").to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], heads[1:] != heads[:-1], [True]]))
        # The sets of all heads that begin here are made at once; only the first head can go on from the last batch.
        begin = cut[1:-1] if heads[0] == head else cut[:-1]
        tops = iter(sets_of(*_text.utf8(batch.column("y").take(pa.array(begin))), k))
        size, good = np.array([len(x) for x in sets]), np.zeros(len(cls), bool)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if heads[a] != head:
                head, mine = heads[a], next(tops)
            good[a:b] = _overlaps(mine, sets[a:b]) >= _needed(len(mine), size[a:b], similar)
        yield pa.RecordBatch.from_arrays([pa.array(cls[good]), pa.array(heads[good])], ["a", "b"])


def _verified_in_kernels(pairs: DataFrame, classes: DataFrame, k: int, similar: float) -> DataFrame:
    """The pairs (cls, head) whose shingle sets are similar enough."""
    # Only the pairs are hashed and moved: classes are read bucket by bucket, unsorted.
    lines = classes.select("cls", F.col("line").alias("x")).join(pairs.hint("shuffle_hash"), "cls")
    heads = classes.select(F.col("cls").alias("head"), F.col("line").alias("y")).join(pairs.select("head").distinct().hint("shuffle_hash"), "head")
    joined = lines.join(heads, "head").sortWithinPartitions("head").select("cls", "head", "x", "y")
    return joined.mapInArrow(lambda batches: verified(batches, k, similar), "a long, b long")


def _settled(members: DataFrame, classes: DataFrame, k: int, similar: float, partitions: int) -> DataFrame:
    """(a, b): links between the roots of `members` (key, cls, root): all pairs of a bucket that are similar, unless
    their components are joined already. Buckets of many bytes are split and each pair of blocks is a task."""
    sized = classes.select("cls", "size").join(members.select("key", "cls").hint("shuffle_hash"), "cls")
    blocks = sized.groupBy("key").agg(F.ceil(F.sum(F.col("size") + 64) / BLOCK_BYTES).cast("int").alias("blocks"))
    dealt = members.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls", "root")
    dealt = classes.select("cls", "line").join(dealt.hint("shuffle_hash"), "cls").select("key", "i", "j", "cls", "root", "line")

    def settle(batches):
        now, names, roots, sets = None, [], [], []

        def done():
            if len(names) > 1:
                links = linked(np.array(roots), sets, similar)
                if len(links):
                    yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])
            names.clear()
            roots.clear()
            sets.clear()

        for batch in _text.chunks(batches, "line", 1 << 20):
            found = sets_of(*_text.utf8(batch.column("line")), k)
            for s, *place, cls, root in zip(found, *(batch.column(c).to_pylist() for c in ("key", "i", "j", "cls", "root")), strict=True):
                if place != now:
                    yield from done()
                    now = place
                names.append(cls)
                roots.append(root)
                sets.append(s)
        yield from done()

    return dealt.repartition(partitions, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(settle, "a long, b long")


def linked(roots: np.ndarray, sets: list[np.ndarray], similar: float) -> np.ndarray:
    """Links (root, root) that join the components of all similar sets; sets of one root are not compared.

    In larger groups a set of which too few shingles occur under other roots has no partner and goes first; what is
    left is compared with all sets of near enough size under roots that aren't joined yet.
    """
    _, group = np.unique(roots, return_inverse=True)
    size = np.array([len(s) for s in sets])
    alive = np.ones(len(sets), bool)
    while len(sets) > FEW and alive.any():
        at = np.flatnonzero(alive)
        token = np.unique(np.concatenate([sets[i] for i in at]), return_inverse=True)[1]
        of = np.repeat(at, size[at])
        first = np.full(token.max() + 1, len(sets))
        last = np.full(token.max() + 1, -1)
        np.minimum.at(first, token, group[of])
        np.maximum.at(last, token, group[of])
        shared = np.bincount(of, first[token] != last[token], len(sets))
        keep = alive & (shared >= np.ceil(similar * size - 1e-9))
        if (keep == alive).all():
            break
        alive = keep
    at = np.flatnonzero(alive)
    at = at[np.argsort(size[at], kind="stable")]
    if len(at) < 2:
        return np.zeros((0, 2), np.int64)
    # Shingles counted in groups: the overlap of two sets is at most the sum of the smaller counts.
    row = np.repeat(np.arange(len(at)), size[at])
    group_of = ((np.concatenate([sets[i] for i in at]) * _GOLD) >> np.uint64(64 - GROUP_BITS)).astype(np.int64)
    counts = np.bincount(row << GROUP_BITS | group_of, minlength=len(at) << GROUP_BITS).astype(np.uint32).reshape(len(at), -1)
    parent = list(range(int(group.max()) + 1))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, sizes, groups = [], size[at], group[at].tolist()
    for k in range(1, len(at)):
        mine, lo = top(groups[k]), int(np.searchsorted(sizes[:k], similar * sizes[k] - 1e-9))
        near = [j for j in range(lo, k) if top(groups[j]) != mine]
        if not near:
            continue
        near = np.array(near)
        least = _needed(sizes[k], sizes[near], similar)
        fits = np.minimum(counts[near], counts[k]).sum(1) >= least
        if not fits.any():
            continue
        near = near[fits]
        for j in near[_overlaps(sets[at[k]], [sets[at[j]] for j in near]) >= least[fits]].tolist():
            a, b = top(groups[k]), top(groups[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((roots[at[k]], roots[at[j]]))
    return np.array(links, np.int64).reshape(-1, 2)


def _positions(raw: Column, k: int) -> Column:
    """The number of shingles of a line, repeated ones included."""
    return F.greatest(F.octet_length(raw) - (k - 1), F.lit(1))


def _exploded(lines: DataFrame, k: int, *kept: str) -> DataFrame:
    """(cls, h, kept) of each shingle of the lines (cls, raw, kept)."""
    each = lines.select("cls", "raw", *kept, F.explode(F.sequence(F.lit(1), _positions(F.col("raw"), k))).alias("i"))
    return each.select("cls", *kept, F.xxhash64(F.substring("raw", F.col("i"), F.lit(k))).alias("h"))


def _shingles(raw: Column, k: int) -> Column:
    """The distinct hashes of a line's shingles. A lambda that reads a column copies it at every step, hence the pieces."""
    last = F.floor((_positions(raw, k) - 1) / PIECE).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda j: F.substring(raw, j * PIECE + 1, F.lit(PIECE + k - 1)))
    return F.array_distinct(F.flatten(F.transform(pieces, lambda x: F.transform(F.sequence(F.lit(1), _positions(x, k)), lambda i: F.xxhash64(F.substring(x, i, F.lit(k)))))))


def _raw(classes: DataFrame, *kept: str) -> DataFrame:
    return classes.select("cls", F.col("line").cast("binary").alias("raw"), *kept)


def _entries(classes: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(key, cls) of each band that isn't empty. Grouped by class throughout, so nothing but keys is shuffled."""
    # The smallest of many hashes is small: of long lines those that can hardly be a bin's smallest go before the aggregate.
    share = F.lit(float(PER_BIN * bands * rows)) / _positions(F.col("raw"), k)
    bound = F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("long"))
    hashed = _exploded(_raw(classes).withColumn("bound", bound), k, "bound").filter("h <= bound")
    # The low half of a hash, scaled to the number of bins; a band's bins are columns of one aggregate.
    slot = F.shiftrightunsigned(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)) * F.lit(bands * rows).cast("long"), 32)
    band = F.shiftright("slot", rows.bit_length() - 1) if rows & (rows - 1) == 0 else F.floor(F.col("slot") / rows)
    placed = hashed.select("cls", "h", slot.alias("slot")).select("cls", "h", "slot", band.cast("int").alias("band"))
    least = [F.min(F.when(F.col("slot") == F.col("band") * rows + r, F.col("h"))).alias(f"m{r}") for r in range(rows)]
    lows = [F.coalesce(f"m{r}", F.lit((1 << 63) - 1)) for r in range(rows)]
    return placed.groupBy("cls", "band").agg(*least).select(F.xxhash64("band", *lows).alias("key"), "cls")


def _met(classes: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(key, cls, head) of the classes of buckets that hold several; head is the bucket's first class."""
    keyed = _entries(classes, k, bands, rows).repartition("key")
    heads = keyed.groupBy("key").agg(F.min("cls").alias("head"), F.count("*").alias("held")).filter("held > 1").select("key", "head")
    return keyed.join(heads.hint("shuffle_hash"), "key").select("key", "cls", "head")


def _verified(pairs: DataFrame, classes: DataFrame, k: int, similar: float) -> DataFrame:
    """(a, b) of the pairs (cls, head) whose shingle sets are similar enough. A head's set is made once."""
    # Only the pairs are hashed and moved: classes are read bucket by bucket, unsorted.
    lines = _raw(classes).join(pairs.hint("shuffle_hash"), "cls").select("cls", "head", "raw").repartition("head")
    lines = lines.select("cls", "head", _shingles(F.col("raw"), k).alias("x"))
    heads = _raw(classes).withColumnRenamed("cls", "head").join(pairs.select("head").distinct().hint("shuffle_hash"), "head")
    heads = heads.select(F.col("head").alias("b"), _shingles(F.col("raw"), k).alias("y"))
    enough = F.size(F.array_intersect("x", "y")) * F.lit(1 + similar) >= F.lit(similar) * (F.size("x") + F.size("y")) - 1e-9
    return lines.join(heads.hint("shuffle_hash"), (F.col("head") == F.col("b")) & enough).select(F.col("cls").alias("a"), "b")


def _sketches(members: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(cls, n, w0, w1, ...): the size of each class's shingle set and its sketch of 64 x WORDS bits: a shingle turns one.

    Two sketches differ in at most as many bits as the sets in shingles.
    """
    lines = _raw(classes).join(members.select("cls").distinct().hint("shuffle_hash"), "cls")
    words = _exploded(lines, k).distinct().groupBy("cls", F.pmod(F.shiftright("h", 6), F.lit(WORDS)).alias("word"))
    words = words.agg(F.count("*").alias("n"), F.bit_xor(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    return words.groupBy("cls").agg(F.sum("n").alias("n"), *[F.coalesce(F.max(F.when(F.col("word") == w, F.col("bits"))), F.lit(0).cast("long")).alias(f"w{w}") for w in range(WORDS)])


def _near(members: DataFrame, sketches: DataFrame, similar: float) -> DataFrame:
    """(a, b, u, v, apart): the pairs of classes of different roots u, v that meet in a bucket of `members` (key, cls,
    root) and can be similar by the sizes of their sets and their sketches; misses none that is. Large buckets are split
    and each pair of blocks is joined by itself; classes that share several buckets are paired in one of them."""
    blocks = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = members.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    keys = members.groupBy("cls").agg(F.collect_list("key").alias("keys"))
    dealt = dealt.join(sketches.join(keys, "cls"), "cls").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("blocks", "other").repartition("key", "i", "j")
    names = ["cls", "root", "own", "keys", "n", *[f"w{w}" for w in range(WORDS)]]
    x, y = (dealt.select("key", "i", "j", *[F.col(c).alias(f"{side}_{c}") for c in names]) for side in "xy")
    bits = [F.bit_count(F.col(f"x_w{w}").bitwiseXOR(F.col(f"y_w{w}"))) for w in range(WORDS)]
    limit = (F.col("x_n") + F.col("y_n")) * F.lit((1 - similar) / (1 + similar)) + 1e-6
    few, apart = sum(bits[1 : WORDS // 2], bits[0]), sum(bits[1:], bits[0])
    met = (F.col("x_cls") < F.col("y_cls")) & (F.col("x_root") != F.col("y_root")) & ((F.col("x_own") != F.col("y_own")) | (F.col("i") == F.col("j")))
    fits = (F.least("x_n", "y_n") >= F.greatest("x_n", "y_n") * F.lit(similar) - 1e-6) & (few <= limit) & (apart <= limit)
    once = F.array_min(F.array_intersect("x_keys", "y_keys")) == F.col("key")
    found = x.join(y.hint("shuffle_hash"), ["key", "i", "j"]).filter(met & fits & once)
    return found.select(F.col("y_cls").alias("a"), F.col("x_cls").alias("b"), F.greatest("x_root", "y_root").alias("u"), F.least("x_root", "y_root").alias("v"), apart.alias("apart"))


def _bonds(near: DataFrame, classes: DataFrame, tables: Tables, k: int, similar: float) -> DataFrame:
    """(a, b): the roots that a similar pair of `near` links. The nearest pair of two roots is verified first, their
    other pairs only where that one isn't similar."""
    tested = near.groupBy("u", "v").agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("u", "v", "p.a", "p.b")
    tested = tables.save(tested, "tested", small=True)
    good = _verified(tested.select(F.col("a").alias("cls"), F.col("b").alias("head")), classes, k, similar)
    done = tables.save(tested.join(good, ["a", "b"]).select("u", "v"), "bonds", small=True)
    rest = tables.save(near.join(tested, ["a", "b"], "left_anti").join(done, ["u", "v"], "left_anti"), "rest", small=True)
    more = _verified(rest.select(F.col("a").alias("cls"), F.col("b").alias("head")), classes, k, similar)
    return done.unionByName(rest.join(more, ["a", "b"]).select("u", "v")).select(F.col("u").alias("a"), F.col("v").alias("b"))


def line_classes(docs: DataFrame, tables: Tables, *, doc_id: str, text: str) -> DataFrame:
    """(cls, line, size, first, n) of each distinct line, bucketed by class: its bytes, its first place, its number of places."""
    place = F.struct("doc_id", "of", "at")
    grouped = _lines(docs, doc_id, text).groupBy("cls").agg(F.first("line").alias("line"), F.min(place).alias("first"), F.count("*").alias("n"))
    return tables.save_bucketed(grouped.withColumn("size", F.octet_length("line")), "cls", "classes")


def line_groups(classes: DataFrame, tables: Tables, *, k: int, similar: float, bands: int, rows: int, kernels: bool = False) -> DataFrame:
    """(node, root): the classes that have a similar one, with the smallest class of their component."""
    partitions = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = tables.save(_met_in_kernels(classes, k, bands, rows, partitions) if kernels else _met(classes, k, bands, rows), "met", small=True)
    pairs = met.filter("cls <> head").select("cls", "head").distinct()
    verify = _verified_in_kernels if kernels else _verified
    roots = components(tables.save(verify(pairs, classes, k, similar), "links", small=True), tables)
    # Buckets of two are settled by their pair; of larger ones, those that still mix components are not.
    members = met.select("key", "cls").distinct().join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    members = tables.save(members, "members", small=True)
    # Buckets with the same members (by two hashes and their number) are settled once.
    seen = members.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
    open_keys = seen.filter("n > 2 and lo < hi").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    mixed = tables.save(members.join(open_keys, "key", "left_semi"), "mixed", small=True)
    if kernels:
        bonds = _settled(mixed, classes, k, similar, partitions)
    else:
        sketches = tables.save(_sketches(mixed, classes, k), "sketches", small=True)
        bonds = _bonds(tables.save(_near(mixed, sketches, similar), "near", small=True), classes, tables, k, similar)
    tops = components(tables.save(bonds.distinct(), "bonds", small=True), tables)
    joined = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return joined.unionByName(tops.join(roots, "node", "left_anti"))


def duplicate_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, kernels: bool = False) -> DataFrame:
    """(doc_id, of, at): the lines that a sooner line of their component makes superfluous; of is the text's xxhash64."""
    tables = Tables(docs.sparkSession, "lines")
    classes = line_classes(docs, tables, doc_id=doc_id, text=text)
    roots = line_groups(classes, tables, k=k, similar=similar, bands=bands, rows=rows, kernels=kernels)
    places = classes.select("cls", "first", "n")
    grouped = places.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    first = grouped.filter("root is not null").groupBy("root").agg(F.min("first").alias("top"))
    linked_classes = grouped.join(first, "root").select("cls", "top")
    repeated = grouped.filter("root is null and n > 1").select("cls", F.col("first").alias("top"))
    wanted = tables.save(linked_classes.unionByName(repeated), "wanted", small=True)
    tables.drop_all_but(wanted)
    gone = _lines(docs, doc_id, text).select("doc_id", "of", "at", "cls").join(wanted, "cls")
    return gone.filter(F.struct("doc_id", "of", "at") != F.col("top")).select("doc_id", "of", "at")


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, similar: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, kernels: bool = False) -> DataFrame:
    """The rows with the text of their remaining lines, n_lines and n_removed; input columns of the last two names go.

    kernels: signatures and verification run as Arrow kernels in Python workers instead of DataFrame expressions."""
    gone = duplicate_lines(docs, doc_id=doc_id, text=text, k=k, similar=similar, bands=bands, rows=rows, kernels=kernels)
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("of").alias("_of")).agg(F.collect_set("at").alias("_gone"))
    rest = docs.drop("n_lines", "n_removed", "_id", "_of", "_gone")
    parts = F.split(text, "\n")
    kept = F.array_join(F.filter(F.arrays_zip(parts.alias("line"), F.sequence(F.lit(0), F.size(parts) - 1).alias("at")), lambda x: ~F.array_contains(F.col("_gone"), x["at"])).getField("line"), "\n")
    out = rest.join(gone, (rest[doc_id].cast("long") == gone["_id"]) & (F.xxhash64(rest[text]) == gone["_of"]), "left")
    n = F.coalesce(F.size("_gone"), F.lit(0)).cast("long")
    return out.select(*[F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else rest[c] for c in rest.columns], F.when(F.col(text).isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), F.when(F.col("_gone").isNull(), 0).otherwise(n).cast("long").alias("n_removed"))
