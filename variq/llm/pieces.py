"""SentencePiece encoding and decoding (BPE models with byte fallback) by suffix-array matching.

The distinct units of a batch (a blank and what follows up to the next one) are laid end to end and indexed: prefix
doubling gives every suffix the rank of its first 16 characters, and each round's sorted keys are the index of that
length. Every piece's occurrence range is binary-searched in those keys, all pieces at once. The ranges become edges,
filed by end position and length, and are relaxed in that order: the last token of each prefix is the one edge that is
compatible with the last token of the prefix before it. Two tokens are compatible if undoing their merges in order of
time never shows a pair across the border that would have been merged first; a sequence is the model's encoding if all
neighbours are compatible, so the result equals the merge procedure's.

Pieces of several blanks have the lowest score, so they form last: runs of single blanks in the result are merged then.
Characters without a piece become bytes. Null texts have null ids and a null decoded text, empty ones no ids; repeated
rows agree; very long units are relaxed one position at a time; an empty table gives no rows; input columns named like
an output are replaced. A blank sign (U+2581) in a text is read as a blank, as the model does.
"""

from __future__ import annotations

import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from variq.llm import _text

BLANK = "▁"
LONG = 96  # characters of a unit from which it is relaxed alone
CACHE = 300_000  # distinct units that a worker remembers
SLICE = 400_000  # characters that are indexed at once


def merged(symbols: list[str], score: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """The merge procedure itself: the best-scored neighbouring pair first, the leftmost of equals; and the last merge."""
    left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    symbols, last = list(symbols), None
    heap: list = []

    def offer(a: int) -> None:
        b = right[a]
        if b >= 0 and (s := score.get(symbols[a] + symbols[b])) is not None:
            heapq.heappush(heap, (-s, a, b, symbols[a], symbols[b]))

    for a in range(len(symbols) - 1):
        offer(a)
    while heap:
        _, a, b, x, y = heapq.heappop(heap)
        if symbols[a] != x or symbols[b] != y or right[a] != b:
            continue
        symbols[a], symbols[b], last = x + y, "", (x, y)
        right[a] = right[b]
        if right[b] >= 0:
            left[right[b]] = a
        if left[a] >= 0:
            offer(left[a])
        offer(a)
    return [s for s in symbols if s], last


class Pieces:
    """Tables of a model. Tokens are numbered by the time of their merge: single characters first, then by score."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        normal = {p: i for i, p in enumerate(pieces) if kinds[i] == "normal"}
        self.byte_ids = np.array([next((i for i, p in enumerate(pieces) if kinds[i] == "byte" and int(p[3:5], 16) == b), -1) for b in range(256)], np.int32)
        self.unknown = next((i for i, k in enumerate(kinds) if k == "unknown"), 0)
        score = {p: scores[i] for p, i in normal.items()}
        self.blanks = {p: s for p, s in score.items() if len(p) > 1 and not p.strip(BLANK)}
        lowest = min((s for p, s in score.items() if len(p) > 1 and p not in self.blanks), default=0.0)
        plain = {p: s for p, s in score.items() if p not in self.blanks}
        longer = [p for p in plain if len(p) > 1]
        if any(s >= lowest for s in self.blanks.values()) or any(BLANK in p[1:] for p in longer) or len({plain[p] for p in longer}) < len(longer):
            raise ValueError("a BPE model is needed with distinct scores, blanks first in a piece and runs of blanks last")
        self.single = [p for p in plain if len(p) == 1]
        order = [*self.single, "", *sorted(longer, key=lambda p: -plain[p])]  # "": a character without a piece
        self.none = len(self.single)
        number = {p: i for i, p in enumerate(order)}
        self.ids = np.array([normal.get(p, -1) for p in order], np.int32)
        self.blank_ids = {p: normal[p] for p in [*self.blanks, BLANK] if p in normal}
        self.lengths = np.array([max(1, len(p)) for p in order], np.int64)
        self.first, self.second = np.arange(len(order)), np.arange(len(order))
        made = []
        for p in longer:
            out, last = merged(list(p), plain)
            if out == [p] and all(x in number for x in last):
                k = number[p]
                self.first[k], self.second[k] = number[last[0]], number[last[1]]
                made.append(k)
        # Pairs that merge, in an open hash table.
        made = np.array(sorted(made), np.int64)
        self.bits = 18
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.result = np.zeros(1 << self.bits, np.int64)
        for k in made:
            key = (int(self.first[k]) << 32) | int(self.second[k])
            at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - self.bits)
            while self.slots[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.slots[at], self.result[at] = key, k
        # The alphabet and the reachable pieces as character codes; code 0 stands for any other character.
        alphabet = sorted({c for p in plain for c in p})
        self.alphabet = np.array([ord(c) for c in alphabet], np.uint32)
        code = {c: i + 1 for i, c in enumerate(alphabet)}
        self.by_length = {}
        for k in [*range(self.none), *made]:
            p = order[k]
            self.by_length.setdefault(len(p), []).append((k, [code[c] for c in p]))
        self.by_length = {n: (np.array([k for k, _ in x]), np.array([c for _, c in x], np.int64)) for n, x in self.by_length.items()}
        self.longest = max(self.by_length)
        self.span = 1 << max(0, (self.longest - 1).bit_length())
        surface = [bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(BLANK, " ").encode() if k == "normal" else b"" for p, k in zip(pieces, kinds, strict=True)]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in surface])]).astype(np.int64)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """Reads the vocabulary of a model file; encoding is done here."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        kind = lambda i: "byte" if model.is_byte(i) else "unknown" if model.is_unknown(i) else "control" if model.is_control(i) else "normal"
        return cls([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)], [kind(i) for i in range(n)])

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges to; a huge number for none."""
        key = (a << 32) | b
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(key), 1 << 40, np.int64)
        todo = np.arange(len(key))
        while len(todo):
            slot = self.slots[at[todo]]
            hit = slot == key[todo]
            out[todo[hit]] = self.result[at[todo[hit]]]
            todo = todo[~hit & (slot >= 0)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a and b stay apart: going back in time, no pair at the border is due before its parts' next merge."""
        good = np.zeros(len(a), bool)
        todo = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        due = np.full(len(a), 1 << 40, np.int64)
        while len(todo):
            ok = self.pair(a, b) >= due
            todo, a, b, due = todo[ok], a[ok], b[ok], due[ok]
            sa, sb = self.second[a], self.first[b]
            undo_a = (a > b) & (sa != a) | (sb == b) & (sa != a)
            undo_b = ~undo_a & (sb != b)
            end = ~undo_a & ~undo_b
            good[todo[end]] = True
            due = np.where(undo_a, a, b + 1)
            a, b = np.where(undo_a, sa, a), np.where(undo_b, sb, b)
            go = ~end
            todo, a, b, due = todo[go], a[go], b[go], due[go]
        return good

    def occurrences(self, codes: np.ndarray) -> np.ndarray:
        """[length - 1, end - 1] the token that ends there with that length, or -1: the edges, filed by position."""
        n = len(codes)
        ranks, keys, sizes = codes.astype(np.int64), [], [int(len(self.alphabet)) + 1]
        step = 1
        while step < self.span:
            after = np.zeros(n, np.int64)
            after[:-step] = ranks[step:] + 1
            key, ranks = np.unique(ranks * (sizes[-1] + 1) + after, return_inverse=True)
            keys.append(key)
            sizes.append(len(key))
            step *= 2
        suffixes = np.argsort(ranks, kind="stable")
        bound = np.concatenate([[0], np.cumsum(np.bincount(ranks, minlength=sizes[-1]))])

        def search(level: int, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not level:
                return part[:, 0], part[:, 0] + 1
            half, wide = 1 << (level - 1), sizes[level - 1] + 1
            lo, hi = search(level - 1, part[:, :half])
            if part.shape[1] <= half:
                return np.searchsorted(keys[level - 1], lo * wide), np.searchsorted(keys[level - 1], hi * wide)
            there = hi > lo
            c, d = search(level - 1, part[:, half:])
            a, b = np.searchsorted(keys[level - 1], lo * wide + c + 1), np.searchsorted(keys[level - 1], lo * wide + d + 1)
            return np.where(there, a, 0), np.where(there, b, 0)

        edges = np.full((self.longest, n), -1, np.int32)
        for length, (tokens, part) in self.by_length.items():
            lo, hi = search(len(keys), part)
            begin, count = bound[lo], np.maximum(bound[hi] - bound[lo], 0)
            ends = suffixes[_text.ragged(begin, count)] + length - 1
            edges[length - 1, ends] = np.repeat(tokens, count)
        edges[0, codes == 0] = self.none
        return edges

    def encode_units(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units laid end to end as code points: all ids, and how many each unit has."""
        spot = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        codes = np.where(self.alphabet[spot] == points, spot + 1, 0)
        edges = self.occurrences(codes)
        last = np.full(len(points) + 1, -1, np.int64)  # the last token of the prefix that ends before each place
        order = np.argsort(-sizes, kind="stable")
        few = int(np.searchsorted(-sizes[order], -LONG, "left"))
        for u in order[:few]:
            self._relax_alone(edges, last, int(starts[u]), int(sizes[u]))
        begin, size = starts[order[few:]], sizes[order[few:]]
        for t in range(1, int(size[0]) + 1 if len(size) else 1):
            live = begin[: int(np.searchsorted(-size, -t, "right"))]
            ends = live + t
            open_ = np.arange(len(live))
            for length in range(min(t, self.longest), 0, -1):
                token = edges[length - 1, ends[open_] - 1]
                some = np.flatnonzero(token >= 0)
                if not len(some):
                    continue
                who, token = open_[some], token[some].astype(np.int64)
                fits = np.ones(len(who), bool) if length == t else self.compatible(last[ends[who] - length], token)
                last[ends[who[fits]]] = token[fits]
                keep = np.ones(len(open_), bool)
                keep[some[fits]] = False
                open_ = open_[keep]
        # Back from each unit's end.
        unit, token, where, ends = [], [], [], starts + sizes
        live = np.flatnonzero(sizes > 0)
        at = ends.copy()
        while len(live):
            now = last[at[live]]
            unit.append(live)
            token.append(now)
            at[live] -= self.lengths[now]
            where.append(at[live].copy())
            live = live[at[live] > starts[live]]
        unit, token, where = (np.concatenate(x[::-1]) if x else np.zeros(0, np.int64) for x in (unit, token, where))
        order = np.argsort(unit, kind="stable")
        unit, token, where = unit[order], token[order], where[order]
        ids = self.ids[token]
        lost = np.flatnonzero(token == self.none)
        if len(lost):
            raw = [chr(c).encode("utf-8", "replace") for c in points[where[lost]]]
            width = np.ones(len(ids), np.int64)
            width[lost] = [len(x) for x in raw]
            ids, unit = np.repeat(ids, width), np.repeat(unit, width)
            place = _text.ragged((np.cumsum(width) - width)[lost], width[lost])
            bytes_ = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            ids[place] = np.where(bytes_ >= 0, bytes_, self.unknown)
        return ids, np.bincount(unit, minlength=len(starts))

    def _relax_alone(self, edges: np.ndarray, last: np.ndarray, start: int, size: int) -> None:
        """One long unit, position by position."""
        table, before = edges[:, start : start + size].T.tolist(), [-1] * (size + 1)
        for end in range(1, size + 1):
            for length in range(min(end, self.longest), 0, -1):
                token = table[end - 1][length - 1]
                if token >= 0 and (length == end or self._pair_fits(before[end - length], token)):
                    before[end] = token
                    break
        last[start + 1 : start + size + 1] = before[1:]

    def _pair_fits(self, a: int, b: int) -> bool:
        known = self.__dict__.setdefault("_fits", {})
        if (a, b) not in known:
            if len(known) > 500_000:
                known.clear()
            known[a, b] = bool(self.compatible(np.array([a]), np.array([b]))[0])
        return known[a, b]

    @functools.lru_cache(maxsize=1024)  # noqa: B019  one model lives as long as its worker
    def blank_run(self, n: int) -> tuple[int, ...]:
        return tuple(self.blank_ids[x] for x in merged([BLANK] * n, self.blanks)[0])

    def encode(self, texts: list[str], cache: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has. cache: units seen before, by hash."""
        laid = [BLANK + x.replace(" ", BLANK) if x else "" for x in texts]
        points = np.frombuffer("".join(laid).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        bound = np.concatenate([[0], np.cumsum([len(x) for x in laid])])
        starts = np.flatnonzero(points == ord(BLANK))
        ends = np.append(starts[1:], len(points))
        hashes = _text.span_hashes(points, starts, ends)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        known = cache if cache is not None else {}
        if not known or len(known["hash"]) > CACHE:
            known.update(hash=np.zeros(0, np.uint64), at=np.zeros(0, np.int64), n=np.zeros(0, np.int64), ids=np.zeros(0, np.int32))
        spot = np.minimum(np.searchsorted(known["hash"], distinct), max(0, len(known["hash"]) - 1))
        new = np.flatnonzero(known["hash"][spot] != distinct) if len(known["hash"]) else np.arange(len(distinct))
        if len(new):
            s, e = starts[first[new]], ends[first[new]]
            total = np.cumsum(e - s)
            parts, counts, a = [], [], 0
            while a < len(new):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + SLICE, "right")))
                size = e[a:b] - s[a:b]
                ids, n = self.encode_units(points[_text.ragged(s[a:b], size)], np.cumsum(size) - size, size)
                parts.append(ids)
                counts.append(n)
                a = b
            n = np.concatenate(counts)
            where = len(known["ids"]) + np.cumsum(n) - n
            all_hash = np.concatenate([known["hash"], distinct[new]])
            order = np.argsort(all_hash, kind="stable")
            known.update(hash=all_hash[order], at=np.concatenate([known["at"], where])[order], n=np.concatenate([known["n"], n])[order], ids=np.concatenate([known["ids"], *parts]))
            spot = np.searchsorted(known["hash"], distinct)
        n = known["n"][spot][back]
        ids = known["ids"][_text.ragged(known["at"][spot][back], n)]
        count = np.bincount(np.searchsorted(bound, starts, "right") - 1, n, len(texts)).astype(np.int64)
        return self._merge_blanks(ids, count)

    def _merge_blanks(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blank = self.blank_ids.get(BLANK)
        is_blank = ids == blank
        if blank is None or not self.blanks or not (is_blank[1:] & is_blank[:-1]).any():
            return ids, count
        bound = np.concatenate([[0], np.cumsum(count)])
        starts, ends, doc = _text.runs(is_blank, bound)
        keep = np.ones(len(ids), bool)
        ids = ids.copy()
        for a, b in zip(starts, ends, strict=True):
            if b - a > 1:
                run = self.blank_run(int(b - a))
                ids[a : a + len(run)] = run
                keep[a + len(run) : b] = False
        total = np.concatenate([[0], np.cumsum(keep)])
        return ids[keep], total[bound[1:]] - total[bound[:-1]]

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """The texts of ids laid one after the other; the blank that encoding puts first goes."""
        width = (self.at[1:] - self.at[:-1])[ids]
        raw = self.surface[_text.ragged(self.at[ids], width)].tobytes()
        total = np.concatenate([[0], np.cumsum(width)])
        bound = total[np.concatenate([[0], np.cumsum(count)])]
        return [(raw[a + 1 : b] if raw[a : a + 1] == b" " else raw[a:b]).decode("utf-8", "replace") for a, b in zip(bound[:-1], bound[1:], strict=True)]


_caches: dict = {}


MADE = {
    "n_tokens": (T.LongType(), pa.int64()), "ids": (T.ArrayType(T.IntegerType()), None), "decoded": (T.StringType(), pa.string()),
    "ids_sha256": (T.StringType(), pa.string()), "decoded_sha256": (T.StringType(), pa.string()), "round_trip": (T.BooleanType(), pa.bool_()),
}


def encode(docs: DataFrame, model: str, *, text: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """The rows with the asked-for columns of MADE; model: path of a model file.

    ids: array of int; decoded: the text of the ids; ids_sha256: of the ids as little-endian 32-bit numbers;
    decoded_sha256: of the decoded text; round_trip: whether decoding gives the text back.
    """
    pieces = Pieces.load(model)
    keep = docs.drop(*columns)
    schema = T.StructType([*keep.schema.fields, *[T.StructField(c, MADE[c][0]) for c in columns]])

    def run(batches):
        cache = _caches.setdefault(model, {})
        for batch in _text.chunks(batches, text, 2 << 20):
            texts = batch.column(text).to_pylist()
            gone = np.array([x is None for x in texts])
            ids, count = pieces.encode([x or "" for x in texts], cache)
            bound = np.concatenate([[0], np.cumsum(count)])
            decoded = pieces.decode(ids, count)
            raw = ids.astype("<i4")
            make = {
                "n_tokens": lambda: count,
                "decoded": lambda: decoded,
                "ids_sha256": lambda: [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(bound[:-1], bound[1:], strict=True)],
                "decoded_sha256": lambda: [hashlib.sha256(x.encode()).hexdigest() for x in decoded],
                "round_trip": lambda: [x == (y or "").replace(BLANK, " ") for x, y in zip(decoded, texts, strict=True)],
            }
            made = [pa.ListArray.from_arrays(pa.array(bound, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(gone)) if c == "ids" else pa.array(make[c](), MADE[c][1], mask=gone) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *columns])

    return keep.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str, *, ids: str = "ids") -> DataFrame:
    """The rows with decoded, the text of an array of ids (null: null)."""
    pieces = Pieces.load(model)
    keep = rows.drop("decoded")
    schema = T.StructType([*keep.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        for batch in batches:
            lists = batch.column(ids).to_pylist()
            flat = np.array([i for x in lists for i in x or []], np.int64)
            out = pieces.decode(flat, np.array([len(x or []) for x in lists], np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string(), mask=np.array([x is None for x in lists]))], [*batch.schema.names, "decoded"])

    return keep.mapInArrow(run, schema)


def default_model() -> str:
    """The public model that is installed beside the library."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
