"""A small corpus with the awkward cases, and plain versions of what operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, n=60):
    """(doc_id, text, lang, source): nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(seed)
    vocabulary = {"en": "the of and to in is was that for on with river stone house light walked evening".split(), "de": "der die und das ist nicht mit von für über straße haus größe abend schön".split(), "fr": "le la les des une est avec pour dans sur où été maison lumière soirée".split()}
    say = lambda lang, k: " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(k))
    passage = say("en", 40)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(vocabulary))
        text = "\n".join(say(lang, rng.randint(3, 30)) for _ in range(rng.randint(1, 5)))
        if i % 7 == 0:
            text += "\n" + passage
        if i % 9 == 3:
            text = rows[-1][1] or ""
        if i % 9 == 6 and rows[-1][1]:
            words = rows[-1][1].split(" ")
            words[len(words) // 2] = "CHANGED"
            text = " ".join(words)
        rows.append((i, text, lang if i % 4 else None, rng.choice(["a", "b", "hot", "hot", None])))
    rows += [(n, None, "en", "a"), (n + 1, "", "en", None), (n + 2, " \n\t ", None, "b"), (n + 3, "word", "en", "a"), (n + 4, "12345 --- !!", "en", "b"), (n + 5, say("en", 9000), "en", "a")]
    rows += [rows[5], rows[5], (None, rows[4][1], "en", "a"), (None, None, None, None)]
    return rows


def frame(spark, rows):
    """With columns whose names clash with outputs."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
