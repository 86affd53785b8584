"""Language identification of whole, possibly mixed texts.

Script ranges narrow the candidates of each word; a naive-Bayes table of byte n-grams, fitted on a bounded sample of
labelled rows, scores the word under each candidate; Viterbi with a switching penalty then labels spans of words. The
language with most letters in its spans is the text's.

Edge cases: a null text or one without a letter is `und` with score 0 and no spans; rows labelled null are not learned
from; without any labelled row everything is `und`; repeated rows get equal answers; ties go to the smaller code.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variq.llm import _text

#: First code point of each script range and the script's name; from Unicode's block list. Fixed values.
SCRIPTS = [
    (0x0000, "other"), (0x0041, "latin"), (0x005B, "other"), (0x0061, "latin"), (0x007B, "other"), (0x00AA, "latin"), (0x00AB, "other"),
    (0x00BA, "latin"), (0x00BB, "other"), (0x00C0, "latin"), (0x02B0, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x08A0, "arabic"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"),
    (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0x4DC0, "other"), (0x4E00, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"), (0x20000, "han"), (0x32000, "other"),
]
_STARTS = np.array([x for x, _ in SCRIPTS], np.uint32)
_NAMES = sorted({x for _, x in SCRIPTS} - {"other"})
_SCRIPT = np.array([_NAMES.index(x) if x != "other" else -1 for _, x in SCRIPTS], np.int16)
BITS = 17  # buckets of the n-gram table
ORDERS = (1, 2, 3, 4)
FIT_BYTES = 1 << 18  # of texts whose n-grams training holds at once: these take over 100 times as many bytes
_HASH = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    table: np.ndarray  # [bucket, language] log-odds of an n-gram
    scripts: np.ndarray  # [script, language] whether the language is written in it
    switch: float


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams of each span, bounds included, and the span of each."""
    size = ends - starts
    buffer = np.full(int(size.sum() + 2 * len(size)) + max(ORDERS), 32, np.uint8)
    at = np.cumsum(size + 2) - size - 1
    buffer[_text.ragged(at, size)] = data[_text.ragged(starts, size)]
    out, of = [], []
    code = np.zeros(len(buffer), np.uint64)
    wide = buffer.astype(np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code = code << np.uint64(8)
        code[: len(code) - n + 1] |= wide[n - 1 :]
        if n in ORDERS:
            first = at if n == 1 else at - 1
            count = np.maximum(size if n == 1 else size + 3 - n, 0)
            where = _text.ragged(first, count)
            out.append(((code[where] * _HASH[n - 1]) >> np.uint64(64 - BITS)).astype(np.int64))
            of.append(np.repeat(np.arange(len(size)), count))
    return np.concatenate(out), np.concatenate(of)


def _word_scripts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The script of most letters of each span; -1 without any."""
    size = ends - starts
    raw = data[_text.ragged(starts, size)]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    if len(lead) != len(points):  # not UTF-8: only ASCII letters count
        points, lead = raw.astype(np.uint32), np.arange(len(raw))
    script = _SCRIPT[np.searchsorted(_STARTS, points, "right") - 1]
    of = np.searchsorted(np.cumsum(size), lead, "right")
    keep = script >= 0
    votes = np.bincount(of[keep] * len(_NAMES) + script[keep], minlength=len(size) * len(_NAMES)).reshape(len(size), -1)
    return np.where(votes.any(1), votes.argmax(1), -1)


def fit(rows: list[tuple[str, str]], switch: float = 6.0) -> Model:
    """The model of (text, language) rows."""
    langs = tuple(sorted({lang for _, lang in rows}))
    counts = np.zeros((1 << BITS, len(langs)))
    letters = np.zeros((len(_NAMES), len(langs)))
    for k, lang in enumerate(langs):
        texts = pa.RecordBatch.from_arrays([pa.array([x for x, y in rows if y == lang], pa.large_string())], ["text"])
        for part in _text.chunks([texts], "text", FIT_BYTES):
            data, offsets = _text.utf8(part.column("text"))
            data = _text.lower_ascii(data)
            starts, ends, _ = _text.words(data, offsets)
            if len(starts):
                counts[:, k] += np.bincount(_grams(data, starts, ends)[0], minlength=1 << BITS)
                script = _word_scripts(data, starts, ends)
                letters[:, k] += np.bincount(script[script >= 0], minlength=len(_NAMES))
    smooth = (counts + 0.5) / np.maximum((counts + 0.5).sum(0), 1)
    table = np.log(smooth) - np.log(smooth.mean(1, keepdims=True)) if langs else smooth
    table[counts.sum(1) == 0] = 0
    return Model(langs, table.astype(np.float32), letters >= np.maximum(1, 0.01 * letters.sum(0)), switch)


def _score_words(model: Model, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[span, language] log-odds; each distinct span is scored once."""
    hashes = _text.span_hashes(data, starts, ends)
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    starts, ends = starts[first], ends[first]
    script = _word_scripts(data, starts, ends)
    scores = np.zeros((len(first), len(model.langs)), np.float32)
    spelled = np.flatnonzero(script >= 0)
    for at in range(0, len(spelled), 1 << 16):
        part = spelled[at : at + (1 << 16)]
        gram, of = _grams(data, starts[part], ends[part])
        for k in range(len(model.langs)):
            scores[part, k] = np.bincount(of, model.table[gram, k], len(part))
    written = model.scripts[script] & (script >= 0)[:, None]
    scores -= np.where((script >= 0)[:, None] & written.any(1, keepdims=True) & ~written, np.float32(50), np.float32(0))
    return scores[back]


def label(model: Model, texts: pa.Array) -> tuple[list[str], list[float], list[str]]:
    """Language, score and spans (start:end:language, code points, comma-joined) of each text."""
    data, offsets = _text.utf8(texts)
    n = len(texts)
    raw, data = data, _text.lower_ascii(data)
    starts, ends, doc = _text.words(data, offsets)
    letter = np.concatenate([[0], np.cumsum(((data >= 97) & (data <= 122)) | (data >= 128))])
    spelled = letter[ends] > letter[starts]
    starts, ends, doc = starts[spelled], ends[spelled], doc[spelled]
    langs, score, spans = ["und"] * n, [0.0] * n, [""] * n
    if not len(starts) or not model.langs:
        return langs, score, spans
    scores = _score_words(model, data, starts, ends)
    count = np.bincount(doc, minlength=n)
    move = np.full((len(model.langs),) * 2, -model.switch, np.float32)
    np.fill_diagonal(move, 0)
    path = _text.viterbi(scores, count, move)
    weight = (letter[ends] - letter[starts]).astype(float)
    votes = np.bincount(doc * len(model.langs) + path, weight, n * len(model.langs)).reshape(n, -1)
    total = np.stack([np.bincount(doc, scores[:, k], n) for k in range(len(model.langs))], 1)
    best = votes.argmax(1)
    mine = total[np.arange(n), best]
    sure = 1 / np.exp(np.clip(total - mine[:, None], -50, 50)).sum(1)
    share = votes.max(1) / np.maximum(votes.sum(1), 1)
    cut = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])]))
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    last = np.concatenate([cut[1:] - 1, [len(path) - 1]])
    texts = None
    for a, b in zip(cut, last, strict=True):
        d, base = doc[a], lead[offsets[doc[a]]]
        one = f"{lead[starts[a]] - base}:{lead[ends[b]] - base}:{model.langs[path[a]]}"
        spans[d] = f"{spans[d]},{one}" if spans[d] else one
    ascii_letter = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    plain = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for d in np.flatnonzero(count):
        if plain[d] or any(map(str.isalpha, raw[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))):
            langs[d], score[d] = model.langs[best[d]], float(share[d] * min(1.0, sure[d]))
        else:
            spans[d] = ""
    return langs, score, spans


def training_sample(docs: DataFrame, text: str, lang: str, key: str, per_lang: int, longest: int) -> list[tuple[str, str]]:
    """About per_lang labelled texts of each language, of at most `longest` characters, chosen by a hash of the key."""
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) <= longest))
    there = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}  # one row a language
    if not there:
        return []
    share = F.create_map(*[F.lit(x) for k, n in there.items() for x in (k, min(1.0, per_lang / n))])
    chosen = F.pmod(F.xxhash64(F.lit("train"), F.col(key).cast("string")), F.lit(1 << 20)) < F.element_at(share, F.col(lang)) * (1 << 20)
    return sorted((r[0], r[1]) for r in usable.filter(chosen).select(text, lang).collect())


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = 400, longest: int = 20_000) -> Model:
    """Fits on a bounded sample: per_lang texts a language of at most `longest` characters (documented bounds)."""
    return fit(training_sample(docs, text, lang, key, per_lang, longest))


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows with lang_pred, score and lang_spans; input columns of those names are replaced."""
    keep = docs.drop("lang_pred", "score", "lang_spans")
    schema = T.StructType([*keep.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_spans", T.StringType())])

    def run(batches):
        for batch in _text.chunks(batches, text):
            langs, score, spans = label(model, batch.column(text))
            names = [*batch.schema.names, "lang_pred", "score", "lang_spans"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.string())], names)

    return keep.mapInArrow(run, schema)
