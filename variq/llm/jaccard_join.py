"""Exact n-gram Jaccard self-join of documents, as connected components of its links.

1. Each text becomes the set of 64-bit hashes of its word shingles; texts with equal sets are one class from here on.
2. Token groups: the hashes of a set are counted in g groups (low bits of the hash), which makes a point. The overlap
   of two sets is at most the summed minima of their points' coordinates.
3. Two linked sets share one of the first |A| - ceil(t|A|) + 1 hashes in any common order, so classes meet under those
   keys. The order puts hashes that are frequent within chunks last (a bounded list that only steers the order).
4. Classes under one key form a count-vector R-tree; links whose bound reaches the needed overlap join classes into
   candidate clusters. Nothing is verified yet and no pair leaves the task: union-find keeps one link a class.
5. Each cluster's sets meet once; the R-tree proposes pairs, which are verified on the sets unless both are in one
   component already. A cluster of more than `block` classes is split into blocks and each pair of blocks is a task.
6. Components over the verified links, by distributed union-find, give each class the smallest id of its component.

Edge cases: null, empty and word-free texts have an empty set and are linked with nothing; ties and repeated rows fall
into one class; rows with a null id have a null component unless their class has an id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variq.llm import _text
from variq.llm._components import components
from variq.llm._store import Tables

SMALL = 16  # classes under one key up to which all pairs are bounded at once
HOT_SHARE, HOT_LIST = 0.01, 20_000  # a hash in this share of a chunk's documents may be put last; so many at most


def groups_for(n: int) -> int:
    """Token groups of a set of n: more for large sets, or their points would look alike."""
    return 64 if n < 1024 else 512 if n < 8192 else 1024


def needed(a, b, percent: int):
    """The smallest overlap at which 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    data, offsets = _text.utf8(texts)
    data = _text.lower_ascii(data)
    n = len(offsets) - 1
    starts, ends, doc = _text.words(data, offsets)
    hashes, of = _text.shingles(_text.span_hashes(data, starts, ends), np.bincount(doc, minlength=n), k)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    keep = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])]) if len(of) else np.zeros(0, bool)
    hashes, of = hashes[keep], of[keep]
    cut = np.searchsorted(of, np.arange(n + 1))
    return [hashes[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def class_of(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def point(s: np.ndarray) -> np.ndarray:
    g = groups_for(len(s))
    return np.bincount((s & np.uint64(g - 1)).astype(np.int64), minlength=g).astype(np.uint16)


def packed(p: np.ndarray) -> bytes:
    """A point as bytes: one byte a group where that is enough, else two."""
    return b"\x01" + p.astype(np.uint8).tobytes() if p.max(initial=0) < 256 else b"\x02" + p.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if raw[0] == 1 else np.uint16, offset=1).astype(np.uint16)


def tiers(points: list[np.ndarray], sizes: np.ndarray, percent: int):
    """(members, their points on one number of groups) such that any two that can link are together in one tier.

    A tier has all points of one number of groups and those finer ones that are near enough in size to link with them;
    the latter are folded (group j of a finer point lies in group j mod g). Larger sets stay on their finer points,
    on which unrelated ones look different.
    """
    own = np.array([len(p) for p in points])
    for g in np.unique(own):
        at = np.flatnonzero(own == g)
        finer = np.flatnonzero((own > g) & (percent * sizes <= 100 * sizes[at].max()))
        at = np.concatenate([at, finer])
        if len(at) > 1:
            yield at, np.stack([points[i] if own[i] == g else points[i].reshape(-1, g).sum(0, dtype=np.uint16) for i in at])


class CountTree:
    """An R-tree over count vectors, bulk-loaded in order of size and leading coordinates, with a union-find over its
    points.

    A node keeps the largest value of each coordinate and its range of sizes. For a query the summed minima of its
    coordinates and the node's bound the overlap with everything below the node. A node whose points are all in one
    component remembers a point of it, so a query from that component passes it by.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int, leaf: int = 16):
        self.percent = percent
        self.order = np.lexsort((points[:, 1 % points.shape[1]], points[:, 0], sizes))
        self.points, self.sizes = points[self.order].astype(np.int32), sizes[self.order]
        self.parent = np.arange(len(sizes))
        self.levels, self.fan = [], leaf
        high, low_n, high_n = self.points, self.sizes, self.sizes
        while len(high) > leaf:
            cut = np.arange(0, len(high), leaf)
            high, low_n, high_n = np.maximum.reduceat(high, cut), np.minimum.reduceat(low_n, cut), np.maximum.reduceat(high_n, cut)
            self.levels.append((high, low_n, high_n, np.full(len(high), -1)))  # the last: a point of the one component

    def roots(self, x: np.ndarray) -> np.ndarray:
        """The root of each point; shortens the way for the next time."""
        top = self.parent[x]
        while (above := self.parent[top]).tolist() != top.tolist():
            top = above
        self.parent[x] = top
        return top

    def union(self, k: int, others: np.ndarray) -> None:
        tops = np.unique(np.append(self.roots(others), self.roots(np.array([k]))))
        self.parent[tops] = tops[0]

    def near(self, k: int) -> np.ndarray:
        """Points before k (in tree order), of other components, that may overlap enough with it."""
        p, n, mine = self.points[k], int(self.sizes[k]), int(self.roots(np.array([k]))[0])
        at, span = None, self.fan ** len(self.levels)
        for level in range(len(self.levels) - 1, -1, -1):
            high, low_n, high_n, one = self.levels[level]
            at = np.arange(len(high)) if at is None else self._below(at, len(high))
            at = at[at * span < k]
            fit = (100 * high_n[at] >= self.percent * n) & (self.percent * low_n[at] <= 100 * n)
            at = at[fit]
            known = one[at] >= 0
            if known.any():
                other = ~known
                other[known] = self.roots(one[at[known]]) != mine
                at = at[other]
            at = at[np.minimum(high[at], p).sum(1) >= needed(n, low_n[at], self.percent)]
            self._remember(level, at, span)
            span //= self.fan
        at = np.arange(len(self.points)) if at is None else self._below(at, len(self.points))
        at = at[at < k]
        m = self.sizes[at]
        at = at[(100 * m >= self.percent * n) & (self.percent * m <= 100 * n)]
        at = at[self.roots(at) != mine] if len(at) else at
        return at[np.minimum(self.points[at], p).sum(1) >= needed(n, self.sizes[at], self.percent)]

    def _remember(self, level: int, at: np.ndarray, span: int) -> None:
        """Marks the visited nodes whose points (or nodes below) are of one component by now."""
        for x in at.tolist():
            one = self.levels[level][3]
            if one[x] >= 0:
                continue
            if level:
                held = self.levels[level - 1][3][x * self.fan : (x + 1) * self.fan]
                if (held < 0).any():
                    continue
            else:
                held = np.arange(x * self.fan, min((x + 1) * self.fan, len(self.points)))
            tops = self.roots(held)
            if (tops == tops[0]).all():
                one[x] = held[0]

    def _below(self, at: np.ndarray, n: int) -> np.ndarray:
        out = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
        return out[out < n]


def joined(points: list[np.ndarray], sizes: np.ndarray, percent: int, sets: list[np.ndarray] | None = None) -> np.ndarray:
    """The smallest index of each item's component. Items link when their bound allows it or, given sets, when verified."""
    parent = np.arange(len(sizes))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for at, flat in tiers(points, sizes, percent):
        root = _joined(flat, sizes[at], percent, [sets[i] for i in at] if sets else None)
        for i in np.flatnonzero(root != np.arange(len(root))):
            a, b = top(int(at[i])), top(int(at[root[i]]))
            parent[max(a, b)] = min(a, b)
    return np.array([top(x) for x in range(len(sizes))])


RECENT = 4  # components whose last member is tried before the tree


def _joined(points: np.ndarray, sizes: np.ndarray, percent: int, sets: list[np.ndarray] | None) -> np.ndarray:
    tree = CountTree(points, sizes, percent)
    held = [sets[k] for k in tree.order] if sets else None
    recent: list[int] = []

    def linked(k: int, at: np.ndarray) -> np.ndarray:
        if not held or not len(at):
            return at
        mine = held[k]
        count = np.array([len(held[j]) for j in at])
        other = np.concatenate([held[j] for j in at])
        spot = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
        both = np.add.reduceat((mine[spot] == other).astype(np.int64), np.cumsum(count) - count)
        return at[both >= needed(len(mine), count, percent)]

    for k in range(len(sizes)):
        # A member of a large group mostly links with its last members; the tree then passes the group by.
        tried = np.array(recent, np.int64)
        if len(tried):
            fits = np.minimum(tree.points[tried], tree.points[k]).sum(1) >= needed(int(tree.sizes[k]), tree.sizes[tried], percent)
            hits = linked(k, tried[fits])
            if len(hits):
                tree.union(k, hits)
        at = tree.near(k)
        while len(at):
            # One point of each component at a time: those of a component that links need no more.
            tops, first = np.unique(tree.roots(at), return_index=True)
            hits = linked(k, at[first])
            if len(hits):
                tree.union(k, hits)
            rest = np.ones(len(at), bool)
            rest[first] = False
            at = at[rest]
            at = at[tree.roots(at) != tree.roots(np.array([k]))[0]] if len(at) else at
        mine = tree.roots(np.array([k]))[0]
        recent = [k, *[r for r in recent if tree.roots(np.array([r]))[0] != mine]][:RECENT]
    label = tree.roots(np.arange(len(sizes)))
    root = np.full(len(sizes), len(sizes))
    np.minimum.at(root, label, tree.order)
    out = np.empty(len(sizes), np.int64)
    out[tree.order] = root[label]
    return out


def _classes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, cls, point) of each row, and rows of (hot, n) with the hashes frequent in a chunk."""

    def run(batches):
        for batch in _text.chunks(batches, "text"):
            sets = shingle_sets(batch.column("text"), k)
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
            seen = {class_of(s): s for s in sets if len(s)}
            hot, count = np.unique(np.concatenate(list(seen.values())), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            pick = count >= max(8, HOT_SHARE * len(seen))
            hot, count = hot[pick].view(np.int64), count[pick]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*ids, *[None] * len(hot)], pa.int64()), pa.array([*map(len, sets), *count.tolist()], pa.int64()), pa.array([*map(class_of, sets), *[None] * len(hot)], pa.binary()),
                    pa.array([*[packed(point(s)) if len(s) else None for s in sets], *[None] * len(hot)], pa.binary()), pa.array([*[None] * n, *hot.tolist()], pa.int64()), pa.array([*texts, *[None] * len(hot)], pa.int64()),
                ],
                ["doc_id", "n", "cls", "point", "hot", "text_hash"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, cls binary, point binary, hot long, text_hash long")


def _meetings(docs: DataFrame, k: int, percent: int, hot: np.ndarray, partitions: int) -> DataFrame:
    """(key, cls) of the classes that meet another class of near enough size under a key."""
    parts = partitions * 4
    schema = "part int, keys binary, of binary, cls binary, sizes binary"

    def send(batches):
        for batch in _text.chunks(batches, "text", 6 << 20):
            sets = {class_of(s): s for s in shingle_sets(batch.column("text"), k) if len(s)}
            keys, of = [], []
            for c, s in enumerate(sets.values()):
                first = len(s) - (percent * len(s) + 99) // 100 + 1
                if len(hot):
                    spot = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    late = hot[spot] == s
                    cold = s[~late]
                    s = cold[:first] if len(cold) >= first else np.concatenate([cold, s[late]])[:first]
                keys.append(s[:first])
                of.append(np.full(len(keys[-1]), c, np.int32))
            if not keys:
                continue
            keys, of = np.concatenate(keys), np.concatenate(of)
            part = ((_text.mix(keys) >> np.uint64(32)).astype(np.int64) * parts) >> 32
            order = np.lexsort((of, part))
            part, keys, of = part[order], keys[order], of[order]
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
            names, sizes = np.frombuffer(b"".join(sets), np.uint8).reshape(-1, 16), np.array([len(s) for s in sets.values()], np.int32)
            rows = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                who, at = np.unique(of[a:b], return_inverse=True)
                rows.append((int(part[a]), keys[a:b].tobytes(), at.astype(np.int32).tobytes(), names[who].tobytes(), sizes[who].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if i else pa.int32()) for i, x in enumerate(zip(*rows, strict=True))], ["part", "keys", "of", "cls", "sizes"])

    def meet(batches):
        now, held = None, []

        def done():
            if not held:
                return
            keys = np.concatenate([np.frombuffer(x[0], np.uint64) for x in held])
            base = np.cumsum([0, *[len(x[2]) // 16 for x in held]])
            of = np.concatenate([np.frombuffer(x[1], np.int32).astype(np.int64) + base[i] for i, x in enumerate(held)])
            names, code = np.unique(np.frombuffer(b"".join(x[2] for x in held), "V16"), return_inverse=True)
            size = np.zeros(len(names), np.int64)
            size[code] = np.frombuffer(b"".join(x[3] for x in held), np.int32)
            of = code[of]
            order = np.lexsort((of, size[of], keys))
            keys, of = keys[order], of[order]
            keep = np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])
            keys, of = keys[keep], of[keep]
            # By size under each key: whoever may link with any class there may link with a neighbour.
            n = size[of]
            pair = (keys[1:] == keys[:-1]) & (100 * n[:-1] >= percent * n[1:])
            more = np.append(pair, False) | np.append(False, pair)
            keys, of = keys[more], of[more]
            held.clear()
            for a in range(0, len(keys), 50_000):
                k = keys[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array([names[x].tobytes() for x in of[a : a + 50_000]], pa.binary())], ["key", "cls"])

        for batch in batches:
            for part, *x in zip(*(batch.column(c).to_pylist() for c in ("part", "keys", "of", "cls", "sizes")), strict=True):
                if part != now:
                    yield from done()
                now = part
                held.append(x)
        yield from done()

    return docs.mapInArrow(send, schema).repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(meet, "key long, cls binary")


def _bound_links(met: DataFrame, percent: int, partitions: int) -> DataFrame:
    """(a, b): under each key (or pair of blocks of one), links of classes whose points allow enough overlap; one link a
    class at most for many classes."""

    def flush(runs: list[tuple[list, list]]):
        a, b = [], []
        twos: dict[int, list] = {}
        for names, points in runs:
            if len(names) == 2:  # most keys: all of them at once
                g = min(map(len, points))
                twos.setdefault(g, []).append((*names, *(p if len(p) == g else p.reshape(-1, g).sum(0, dtype=np.uint16) for p in points)))
        for held in twos.values():
            one, two, p, q = zip(*held, strict=True)
            p, q = np.stack(p), np.stack(q)
            total = lambda x: x.sum(1, dtype=np.int64)
            fit = np.flatnonzero(total(np.minimum(p, q)) >= needed(total(p), total(q), percent))
            a += [one[x] for x in fit]
            b += [two[x] for x in fit]
        for names, points in runs:
            if len(names) == 2:
                continue
            sizes = np.array([int(p.sum()) for p in points])
            if len(names) <= SMALL:
                for at, flat in tiers(points, sizes, percent):
                    i, j = np.triu_indices(len(at), 1)
                    fit = np.minimum(flat[i], flat[j]).sum(1, dtype=np.int64) >= needed(sizes[at[i]], sizes[at[j]], percent)
                    a += [names[x] for x in at[i[fit]]]
                    b += [names[x] for x in at[j[fit]]]
            else:
                j = joined(points, sizes, percent)
                i = np.flatnonzero(j != np.arange(len(j)))
                a += [names[x] for x in i]
                b += [names[x] for x in j[i]]
        pairs = list({(x, y) if x < y else (y, x) for x, y in zip(a, b, strict=True)})
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([y for _, y in pairs], pa.binary())], ["a", "b"])

    def run(batches):
        now, names, points, runs, size = None, [], [], [], 0
        for batch in batches:
            for *key, cls, p in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "cls", "point")), strict=True):
                if key != now:
                    if names:
                        runs.append((names, points))
                    if size > 20_000:
                        yield flush(runs)
                        runs, size = [], 0
                    now, names, points = key, [], []
                names.append(cls)
                points.append(unpacked(p))
                size += 1
        if names:
            runs.append((names, points))
        yield flush(runs)

    return met.repartition(partitions, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a binary, b binary")


def _blocked(met: DataFrame, key_block: int) -> DataFrame:
    """(key, i, j, cls): keys of many classes are cut into blocks by a hash, and each pair of blocks meets on its own."""
    many = met.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > key_block).select("key", F.ceil(F.col("n") / key_block).cast("int").alias("blocks"))
    dealt = met.join(many, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cls")


def _verified_links(members: DataFrame, docs: DataFrame, k: int, percent: int, partitions: int) -> DataFrame:
    """(a, b): verified links of each cluster (or pair of blocks of one), one a class at most.

    Texts travel, not sets: they are smaller and compress. A row whose text isn't of the class (ids can repeat) goes.
    """

    def verify(batches):
        now, held, size = None, [], 0
        sets: dict[bytes, np.ndarray] = {}

        def hash_held():
            found = shingle_sets(pa.array([x for _, x in held], pa.large_string()), k)
            sets.update({c: s for (c, _), s in zip(held, found, strict=True) if c not in sets and class_of(s) == c})
            held.clear()

        def done():
            hash_held()
            names, found = list(sets), list(sets.values())
            sets.clear()
            if len(names) < 2:
                return
            root = joined([point(s) for s in found], np.array([len(s) for s in found]), percent, found)
            at = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in at], pa.binary()), pa.array([names[root[x]] for x in at], pa.binary())], ["a", "b"])

        for batch in _text.chunks(batches, "text"):
            for *key, cls, text in zip(*(batch.column(c).to_pylist() for c in ("cluster", "i", "j", "cls", "text")), strict=True):
                if key != now:
                    yield from done()
                    now, size = key, 0
                held.append((cls, text))
                size += len(text or "")
                if size > 4 << 20:
                    hash_held()
                    size = 0
        yield from done()

    one = F.min("doc_id").alias("doc_id")
    wanted = members.groupBy("cls", "cluster", "i", "j").agg(one)
    texts = docs.join(wanted, "doc_id").select("cluster", "i", "j", "cls", "text")
    return texts.repartition(partitions, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(verify, "a binary, b binary")


def similar_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, block: int = 1024, key_block: int = 4096, partitions: int | None = None, detail: bool = False) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest id reachable by links of at least `percent` similarity).

    detail: also text_hash (xxhash64 of the text) and group_id, the component's name (null without words), which tell
    rows without an id, and rows that share one, apart.
    """
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = Tables(spark, "jaccard")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = tables.save(_classes(rows.withColumn("text_hash", F.xxhash64("text")), k), "classes")
    classes = found.filter("hot is null").drop("hot")
    frequent = found.filter("hot is not null").groupBy("hot").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hot").limit(HOT_LIST)
    hot = np.sort(np.array([r[0] for r in frequent.collect()], np.int64).view(np.uint64))
    points = classes.filter("cls is not null").groupBy("cls").agg(F.first("point").alias("point"), F.min("doc_id").alias("doc_id"))
    met = tables.save(_meetings(rows, k, percent, hot, partitions), "met")
    bounds = tables.save(_bound_links(_blocked(met, key_block).join(points.select("cls", "point"), "cls"), percent, partitions), "bounds", small=True)
    tables.drop(met)
    clusters = components(bounds, tables)
    size = clusters.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    spread = clusters.join(size, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = spread.select(F.col("node").alias("cls"), F.col("root").alias("cluster"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).join(points.select("cls", "doc_id"), "cls")
    roots = components(_verified_links(tasks, rows, k, percent, partitions), tables).select(F.col("node").alias("cls"), "root")
    labelled = classes.drop("point").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    labelled = tables.save(labelled, "labelled")
    tables.drop_all_but(labelled)
    least = labelled.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = labelled.join(least, "root", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *(["text_hash", F.col("root").alias("group_id")] if detail else []))
