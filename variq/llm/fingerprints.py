"""One-permutation MinHash fingerprints of documents.

Each word shingle is hashed once; the high bits of the hash choose a bin, the bin keeps its smallest hash. Empty bins
are filled by optimal densification: bin b draws bins at random, by a hash of (b, attempt) alone, until one is full
(however many draws that takes), and copies it. `bits` low-order bits of each bin are packed. The share of equal bins m of two fingerprints estimates
the Jaccard similarity after the bias correction (m - c) / (1 - c), c = 2^-bits the chance of equal low bits.

Edge cases: null and empty texts have the empty fingerprint ""; two empty ones are alike (1), an empty and another
aren't (0). Texts of fewer words than a shingle give their whole sequence as one. Equal texts have equal fingerprints.
Rows that share an id, and those without one (which come first), are ordered by a hash of their text and the text.
Input columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variq.llm import _text
from variq.llm._store import partition_keys

BINS, BITS, WORDS = 256, 8, 5
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
DRAWS = 32  # that are made at once
HELD_BYTES, HELD_ROWS = 2 << 20, 2000  # of texts that are compared at once


def sketches(data: np.ndarray, offsets: np.ndarray, bins: int = BINS, bits: int = BITS, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """[document, bin] low bits as bytes, and whether the document has any shingle. bits: 1, 2, 4 or 8."""
    n = len(offsets) - 1
    starts, ends, doc = _text.words(data, offsets)
    hashes, of = _text.shingles(_text.span_hashes(data, starts, ends), np.bincount(doc, minlength=n), k)
    low = np.full(n * bins, _EMPTY, np.uint64)
    shift = np.uint64(64 - bins.bit_length() + 1)
    np.minimum.at(low, of * bins + (hashes >> shift).astype(np.int64), hashes)
    low = low.reshape(n, bins)
    full = low != _EMPTY
    some = full.any(1)
    doc, empty = np.nonzero(~full & some[:, None])
    attempt = 0
    while len(doc):
        # Blocks of draws for the bins that are still empty, until the last one has found a full bin.
        tries = np.arange(attempt, attempt + DRAWS, dtype=np.uint64) << np.uint64(32)
        draw = (_text.mix(np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B1) + tries) % np.uint64(bins)).astype(np.int64)
        left = []
        for at in range(0, len(doc), 1 << 15):
            d, b = doc[at : at + (1 << 15)], empty[at : at + (1 << 15)]
            hit = full[d[:, None], draw[b]]
            first, found = hit.argmax(1), hit.any(1)
            low[d[found], b[found]] = low[d[found], draw[b[found], first[found]]]
            left.append((d[~found], b[~found]))
        doc, empty = (np.concatenate(x) for x in zip(*left, strict=True))
        attempt += DRAWS
    return (_text.mix(low) & np.uint64((1 << bits) - 1)).astype(np.uint8), some


def pack(sketch: np.ndarray, some: np.ndarray, bits: int = BITS) -> list[str]:
    """Hex text of each fingerprint; "" for documents without a shingle."""
    if bits < 8:
        per = 8 // bits
        sketch = (sketch.reshape(len(sketch), -1, per) << (np.arange(per, dtype=np.uint8) * np.uint8(bits))).sum(2).astype(np.uint8)
    return [row.tobytes().hex() if ok else "" for row, ok in zip(sketch, some, strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bias-corrected similarity, from 0 to 1, of each pair of rows."""
    chance = 2.0**-bits
    same = (np.clip(((a == b).mean(1) - chance) / (1 - chance), 0, 1)) if len(a) else np.zeros(0)
    return np.where(some_a & some_b, same, (some_a == some_b).astype(float))


def fingerprint(docs: DataFrame, *, text: str = "text", bins: int = BINS, bits: int = BITS, k: int = WORDS) -> DataFrame:
    """The rows with their fingerprint."""
    keep = docs.drop("fingerprint")
    schema = T.StructType([*keep.schema.fields, T.StructField("fingerprint", T.StringType())])

    def run(batches):
        for batch in _text.chunks(batches, text):
            sketch, some = sketches(*_text.utf8(batch.column(text)), bins, bits, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pack(sketch, some, bits), pa.string())], [*batch.schema.names, "fingerprint"])

    return keep.mapInArrow(run, schema)


def _neighbours(docs: DataFrame, doc_id: str, text: str, partitions: int) -> DataFrame:
    """(bucket, tail, doc_id, text) in id order: ranges of ids as buckets, each followed by the first row of the next.

    Only range bounds and each bucket's smallest place (one a partition) reach the driver; texts are shuffled once, each
    bucket to a partition of its own. An id that holds several ranges' worth of rows is cut by the hash of the text. The
    last bucket is followed by the first.
    """
    least = -(1 << 63)
    mask = F.lit((1 << 63) - 1)
    order = F.coalesce(F.col(doc_id).cast("long"), F.lit(least))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), order.alias("place"), F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(mask).alias("hash"))
    bounds = rows.agg(F.percentile_approx("place", F.array(*[F.lit((i + 1) / partitions) for i in range(partitions - 1)]), 10_000)).first()[0] if partitions > 1 else []
    bounds = np.array(sorted(bounds or []), np.int64)
    named = partition_keys(docs.sparkSession, partitions)

    def bucket(place: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(bounds, place, "left"), np.searchsorted(bounds, place, "right")
        return lo + (hashed.astype(np.float64) / 2.0**63 * (hi - lo + 1)).astype(np.int64).clip(0, hi - lo)

    def columns(batch):
        return (batch.column(c).to_numpy(zero_copy_only=False) for c in ("place", "hash"))

    def count(batches):
        for batch in batches:
            place, hashed = columns(batch)
            yield pa.RecordBatch.from_arrays([pa.array(bucket(place, hashed)), pa.array(place), pa.array(hashed)], ["bucket", "place", "hash"])

    first = F.min(F.struct("place", "hash")).alias("first")
    heads = {r[0]: (r[1][0], r[1][1]) for r in rows.select("place", "hash").mapInArrow(count, "bucket long, place long, hash long").groupBy("bucket").agg(first).collect()}
    filled = sorted(heads)
    before = {heads[b]: named[filled[i - 1]] for i, b in enumerate(filled)}

    def deal(batches):
        for batch in _text.chunks(batches, "text"):
            place, hashed = columns(batch)
            of = named[bucket(place, hashed)]
            kept = [batch.column("doc_id"), batch.column("text"), batch.column("place"), batch.column("hash")]
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(np.zeros(len(of), bool)), *kept], names)
            head = [k for k, x in enumerate(zip(place.tolist(), hashed.tolist(), strict=True)) if x in before]
            if head:
                to = [before[place[k], hashed[k]] for k in head]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(np.ones(len(head), bool)), *[c.take(pa.array(head)) for c in kept]], names)

    names = ["bucket", "tail", "doc_id", "text", "place", "hash"]
    dealt = rows.mapInArrow(deal, "bucket long, tail boolean, doc_id long, text string, place long, hash long")
    return dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket", "tail", "place", "hash", "text").select("bucket", "tail", "doc_id", "text")


def edited_pairs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None, bins: int = BINS, bits: int = BITS, k: int = WORDS) -> DataFrame:
    """Fingerprints of each text, of its edit (its last quarter replaced by the start of the next text) and their likeness."""
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(ids: list, texts: list[str], following: str):
        after = [*texts[1:], following]
        edited = []
        for mine, other in zip(texts, after, strict=True):
            cut = len(mine) // 4
            edited.append(mine[: len(mine) - cut] + other[:cut])
        near = [sketches(*_text.utf8(pa.array(x, pa.large_string())), bins, bits, k) for x in ([*texts, following], edited)]
        (plain, some), (changed, has) = near
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                pa.array(pack(plain[:-1], some[:-1], bits), pa.string()), pa.array(pack(changed, has, bits), pa.string()),
                pa.array(likeness(plain[:-1], changed, some[:-1], has, bits)), pa.array(likeness(plain[:-1], plain[1:], some[:-1], some[1:], bits)),
            ],
            [f.split()[0] for f in fields.split(", ")],
        )

    def run(batches):
        ids, texts, size, bucket = [], [], 0, None
        for batch in _text.chunks(batches, "text"):
            for b, tail, i, x in zip(*(batch.column(n).to_pylist() for n in ("bucket", "tail", "doc_id", "text")), strict=True):
                x = x or ""
                if ids and b == bucket and (tail or size > HELD_BYTES or len(ids) >= HELD_ROWS):
                    yield compare(ids, texts, x)
                    ids, texts, size = [], [], 0
                bucket = b
                if not tail:
                    ids.append(i)
                    texts.append(x)
                    size += len(x)

    return _neighbours(docs, doc_id, text, partitions).mapInArrow(run, fields)
