"""Secret scans: fixed patterns plus a linear-chain conditional random field.

The CRF tags tokens as outside, begin or inside of a secret. Its features are a code of the token's shape (length,
digits, case, symbols, changes between letters and digits, known keywords), the codes of the neighbouring tokens and
two features of the file; Viterbi decodes the best tags of the whole text. It is trained here, on sentences made by
`examples`; pattern spans always stay and CRF spans that they do not cover to the last byte are added whole, kind `crf`.

Edge cases: null and empty texts have no spans; repeated rows get equal spans; an empty table gives no rows; input
columns named like an output are replaced. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from variq.llm import _text

#: The fixed patterns, on bytes: letters of the first are compared after A-Z were lower-cased.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "crf")
#: Words that tend to stand by a secret. Fixed values.
KEYWORDS = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api", "key", "auth", "authorization", "bearer", "credential", "credentials", "private", "access", "client_secret", "passphrase"]

_CLASS = np.zeros(256, np.int8)  # 0 separator, 1 of a word, 2 punctuation
_CLASS[33:127] = 2
_CLASS[[ord(c) for c in string.ascii_letters + string.digits + "+/_.-"]] = 1
_CLASS[128:] = 1
_CLASS[:33] = np.where(_text.SPACE[:33], 0, 2)
_CLASS[127] = 2
_HEX = np.zeros(256, bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True
_LENGTHS = np.array([4, 8, 16, 24, 40])
SHAPES = 6 * 3 * 4 * 2 * 2 * 3
CODES = SHAPES + 4 + len(KEYWORDS) + 1  # and one for "no token"
FEATURES = 4 * CODES + 4


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends, documents and shape codes of the tokens: runs of word bytes, runs of punctuation."""
    kind = _CLASS[data]
    one, two = _text.runs(kind == 1, offsets), _text.runs(kind == 2, offsets)
    starts, ends, doc = (np.concatenate(x) for x in zip(one, two, strict=True))
    order = np.argsort(starts, kind="stable")
    word = np.concatenate([np.ones(len(one[0]), bool), np.zeros(len(two[0]), bool)])[order]
    starts, ends, doc = starts[order], ends[order], doc[order]
    digit = (data >= 48) & (data <= 57)
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)

    def count(mark):
        total = np.concatenate([[0], np.cumsum(mark, dtype=np.int32)])
        return total[ends] - total[starts]

    size = ends - starts
    digits = count(digit)
    share = np.where(digits == 0, 0, np.where(10 * digits < 3 * size, 1, 2))
    case = (count(upper) > 0) * 2 + (count(lower) > 0)
    symbols = count((kind == 1) & ~digit & ~upper & ~lower & (data < 128)) > 0
    turn = np.zeros(len(data), bool)
    if len(data):
        turn[1:] = digit[1:] != digit[:-1]
    turns = np.minimum((count(turn) + 1) // 2, 2)
    code = np.searchsorted(_LENGTHS, size, "right")
    for value, base in ((share, 3), (case, 4), (count(data >= 128) > 0, 2), (symbols, 2), (turns, 3)):
        code = code * base + value
    marks = SHAPES + np.where(count((data == 61) | (data == 58)) > 0, 1, 0) + np.where(count((data == 34) | (data == 39)) > 0, 2, 0)
    code = np.where(word, code, marks)
    hashes = _text.span_hashes(_text.lower_ascii(data), starts, ends)
    known, place = _keywords()
    spot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return starts, ends, doc, np.where(known[spot] == hashes, SHAPES + 4 + place[spot], code)


@functools.cache
def _keywords() -> tuple[np.ndarray, np.ndarray]:
    data, offsets = _text.utf8(pa.array(KEYWORDS))
    hashes = _text.span_hashes(data, offsets[:-1], offsets[1:])
    order = np.argsort(hashes)
    return hashes[order], order


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # [feature, tag]
    moves: np.ndarray  # [tag, tag]


def _emissions(code: np.ndarray, doc: np.ndarray, file: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Scores of the tags of each token: its own code, two before it, one after it, and its file's feature."""
    none = CODES - 1
    out = weights[code] + weights[4 * CODES + file[doc]]
    for k, (by, base) in enumerate(((1, CODES), (2, 2 * CODES), (-1, 3 * CODES))):
        near = np.full(len(code), none)
        if by > 0:
            near[by:] = np.where(doc[by:] == doc[:-by], code[:-by], none)
        elif len(code) > 1:
            near[:by] = np.where(doc[:by] == doc[-by:], code[-by:], none)
        out = out + weights[base + near]
    return out


def _files(code: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """The file's feature: whether it has a keyword, whether it has many assignment signs for its length."""
    size = np.maximum(np.bincount(doc, minlength=n), 1)
    keyword = np.bincount(doc, (code >= SHAPES + 4) & (code < CODES - 1), n) > 0
    signs = np.bincount(doc, (code >= SHAPES) & (code < SHAPES + 4) & ((code - SHAPES) % 2 == 1), n)
    return keyword * 2 + (signs > 0.02 * size)


def examples(n: int, seed: int = 7) -> list[list[tuple[str, int]]]:
    """Made-up lines as (piece, tag) lists: prose, settings, logs and look-alikes that are no secrets."""
    rng = random.Random(seed)
    pick = rng.choice
    some = lambda chars, a, b: "".join(pick(chars) for _ in range(rng.randint(a, b)))
    alnum = string.ascii_letters + string.digits
    word = lambda: pick([some(string.ascii_lowercase, 2, 12), some(string.ascii_lowercase, 2, rng.choice([9, 9, 22])).title(), some("aeiouäéñçßth", 3, 14), some("aeinorstáüöß", 12, 36).title()])
    prose = lambda: [(word() + pick(["", "", "", "", ",", ".", some(string.digits, 1, 3)]), 0) for _ in range(rng.randint(1, 12))]
    secret = lambda: pick([lambda: some(alnum, 20, 44), lambda: some("0123456789abcdef", 24, 64), lambda: "AKIA" + some(string.ascii_uppercase + string.digits, 16, 16), lambda: some(alnum + "+/", 30, 60), lambda: pick(["ghp_", "sk-", "xoxb-"]) + some(alnum, 20, 40), lambda: some(alnum + "_.-", 8, 20) + str(rng.randint(10, 999)) + pick(string.ascii_uppercase), lambda: some("0123456789ABCDEF", 24, 64), lambda: some(alnum + "_-", 16, 30) + "." + some(alnum + "_-", 20, 40)])()
    # Told from other tokens by what stands before them: pass phrases, and keys in groups, which look like other ids.
    named = lambda: pick([secret, secret, lambda: some(alnum, 4, 8) + pick("_!-.@") + some(string.digits, 2, 5) + some(string.ascii_uppercase, 0, 3), lambda: word() + pick("_!@") + some(string.digits, 2, 6), lambda: "-".join(some(string.ascii_uppercase + string.digits, 5, 5) for _ in range(rng.randint(3, 5)))])()
    plain = lambda: pick([lambda: some(string.digits, 1, 16), lambda: word() + "-" + word(), lambda: "/".join(word() for _ in range(3)), lambda: f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}", lambda: f"20{rng.randint(10, 30)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: word() + pick(["", "." + word(), "." + some(string.digits, 1, 4), some(string.digits, 1, 4)]) + "@" + word() + some(string.digits, 0, 1) + ".com", lambda: f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}", word, lambda: "v" + ".".join(some(string.digits, 1, 2) for _ in range(3)), lambda: "www." + word() + ".org/" + word(), lambda: some("aeionrst", 18, 40), lambda: "-".join(some("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)), lambda: some(string.ascii_uppercase, 2, 12), lambda: some(string.ascii_uppercase, 2, 4) + "-" + some(string.digits, 3, 9)])()
    out = []
    for _ in range(n):
        line = prose()
        for _ in range(rng.randint(0, 2)):
            if rng.random() < 0.45:
                name = pick(["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "key", "Authorization", "Bearer", "private", "client_secret", "passphrase", "credential"])
                quote = pick(["", '"', "'"])
                line += [(pick([name, name.upper(), name.title()]), 0), (pick([" = ", ": ", "=", " ", " is ", " := ", " is: "]) + quote, 0), (named(), 1)] + ([(quote, 0)] if quote else [])
            elif rng.random() < 0.3:
                line += [(secret(), 1)]
            else:
                line += [(pick(["name", "id", "port", "path", "date", "size", "host", "page", "the", "key", "token", "of", "is", "order", "user"]), 0), (pick([" = ", ": ", " ", " is "]), 0), (plain(), 0)]
            line += prose()
        out.append(line)
    return out


@functools.lru_cache(maxsize=2)
def trained(n: int = 2000, steps: int = 160) -> Field:
    """Fits the field by full-batch gradient ascent of the conditional likelihood (Adam, L2 prior); deterministic."""
    texts, marks = [], []
    for line in examples(n):
        text, spans = "", []
        for piece, tag in line:
            text += "" if not text or text[-1] in " =\"'" or piece[0] in " =:\"'" else " "
            if tag:
                spans.append((len(text.encode()), len((text + piece).encode())))
            text += piece
        texts.append(text)
        marks.append(spans)
    data, offsets = _text.utf8(pa.array(texts))
    starts, ends, doc, code = tokens(data, offsets)
    tag = np.zeros(len(code), np.int64)
    for d, spans in enumerate(marks):
        for a, b in spans:
            own = np.arange(np.searchsorted(starts, offsets[d] + a), np.searchsorted(starts, offsets[d] + b))
            tag[own] = 2
            tag[own[:1]] = 1
    file = _files(code, doc, len(texts))
    none = CODES - 1
    shifted = []
    for by in (1, 2, -1):
        near = np.full(len(code), none)
        if by > 0:
            near[by:] = np.where(doc[by:] == doc[:-by], code[:-by], none)
        else:
            near[:by] = np.where(doc[:by] == doc[-by:], code[-by:], none)
        shifted.append(near)
    feats = np.stack([code, CODES + shifted[0], 2 * CODES + shifted[1], 3 * CODES + shifted[2], 4 * CODES + file[doc]], 1)
    count = np.bincount(doc, minlength=len(texts))
    length, base = int(count.max()), np.cumsum(count) - count
    at = np.minimum(base[:, None] + np.arange(length), len(code) - 1)
    live = np.arange(length) < count[:, None]
    hot = np.zeros((len(code), 3))
    hot[np.arange(len(code)), tag] = 1
    gold = np.zeros((3, 3))
    np.add.at(gold, (tag[:-1][doc[1:] == doc[:-1]], tag[1:][doc[1:] == doc[:-1]]), 1)
    weights, moves = np.zeros((FEATURES, 3)), np.zeros((3, 3))
    state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    up = lambda x: x.max(-1) + np.log(np.exp(x - x.max(-1, keepdims=True)).sum(-1))
    for step in range(1, steps + 1):
        score = weights[feats].sum(1)[at]
        ahead = np.zeros((len(count), length, 3))
        back = np.zeros_like(ahead)
        ahead[:, 0] = score[:, 0]
        for t in range(1, length):
            go = up(ahead[:, t - 1, :, None].transpose(0, 2, 1) + moves.T[None]) + score[:, t]
            ahead[:, t] = np.where(live[:, t, None], go, ahead[:, t - 1])
        for t in range(length - 2, -1, -1):
            go = up(moves[None] + (score[:, t + 1] + back[:, t + 1])[:, None, :])
            back[:, t] = np.where(live[:, t + 1, None], go, 0)
        total = up(ahead[:, -1])[:, None, None]
        node = np.exp(ahead + back - total)
        pair = np.exp(ahead[:, :-1, :, None] + moves + (score + back)[:, 1:, None, :] - total[..., None]) * live[:, 1:, None, None]
        gap = hot - node[live]
        grad = np.zeros_like(weights)
        for k in range(feats.shape[1]):
            for y in range(3):
                grad[:, y] += np.bincount(feats[:, k], gap[:, y], FEATURES)
        for value, g, m, v in ((weights, grad - 0.5 * weights, state[0], state[1]), (moves, gold - pair.sum((0, 1)) - 0.5 * moves, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    moves[0, 2] = -1e4  # inside never follows outside
    return Field(weights.astype(np.float32), moves.astype(np.float32))


def _patterns(joined: bytes, low: bytes, data: np.ndarray) -> list[tuple[str, int, int]]:
    """(kind, start, end) byte spans of the fixed patterns in texts joined by a separator."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= SHORTEST["assign"]]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(joined) if m.end() - m.start() >= SHORTEST["access"]]
    total = np.concatenate([[0], np.cumsum(_HEX[data], dtype=np.int32)])
    k = SHORTEST["hex"]
    full = np.flatnonzero(total[k:] - total[:-k] == k)
    first = full[np.concatenate([[True], full[1:] != full[:-1] + 1])] if len(full) else full
    last = full[np.concatenate([full[1:] != full[:-1] + 1, [True]])] if len(full) else full
    return out + [("hex", int(a), int(b) + k) for a, b in zip(first, last, strict=True)]


def find(field: Field, texts: pa.Array) -> list[list[tuple[str, int, int]]]:
    """The spans of each text, by start and then by kind."""
    data, offsets = _text.utf8(texts)
    n = len(texts)
    # A line end after each text: no pattern crosses it.
    size = np.diff(offsets)
    shifted = offsets + np.arange(n + 1)
    wide = np.full(len(data) + n, 10, np.uint8)
    wide[_text.ragged(shifted[:-1], size)] = data
    raw = wide.tobytes()
    spans = _patterns(raw, raw.lower(), wide)
    starts, ends, doc, code = tokens(data, offsets)
    if len(code):
        scores = _emissions(code, doc, _files(code, doc, n), field.weights)
        path = _text.viterbi(scores.astype(np.float32), np.bincount(doc, minlength=n), field.moves)
        begin = np.flatnonzero(path == 1)
        goes = np.flatnonzero(path != 2)
        stop = np.append(goes, len(path))[np.searchsorted(goes, begin, "right")]
        taken = np.zeros(len(wide) + 1, np.int32)
        for _, a, b in spans:
            taken[a] += 1
            taken[b] -= 1
        covered = np.concatenate([[0], np.cumsum(np.cumsum(taken)[:-1] > 0)])
        for a, b, d in zip(starts[begin], ends[stop - 1], doc[begin], strict=True):
            a, b = int(a) + d, int(b) + d
            if covered[b] - covered[a] < b - a:
                spans.append(("crf", a, b))
    lead = np.concatenate([[0], np.cumsum((wide & 0xC0) != 0x80)])
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(n)]
    for kind, a, b in spans:
        d = int(np.searchsorted(shifted, a, "right")) - 1
        out[d].append((kind, int(lead[a] - lead[shifted[d]]), int(lead[b] - lead[shifted[d]])))
    for x in out:
        x.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def scan(docs: DataFrame, field: Field | None = None, *, text: str = "text") -> DataFrame:
    """The rows with n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined)."""
    made = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    keep = docs.drop(*made)
    kinds = [T.LongType()] * 3 + [T.StringType()] * 2
    schema = T.StructType([*keep.schema.fields, *[T.StructField(a, b) for a, b in zip(made, kinds, strict=True)]])
    field = field or trained()

    def run(batches):
        say = lambda x: ",".join(f"{a}:{b}:{c}" for a, b, c in x)
        for batch in _text.chunks(batches, text):
            found = find(field, batch.column(text))
            counts = [pa.array([sum(s[0] == kind for s in x) for x in found], pa.int64()) for kind in KINDS[:3]]
            base = [hashlib.sha256(say([s for s in x if s[0] != "crf"]).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, *counts, pa.array(base, pa.string()), pa.array([say(x) for x in found], pa.string())], [*batch.schema.names, *made])

    return keep.mapInArrow(run, schema)
