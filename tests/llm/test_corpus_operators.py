"""Operators over the whole corpus against brute force."""

import collections
import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import WORD, corpus, empty, frame, shingles
from variq.llm import jaccard_join, line_dedup, mixing, substrings
from variq.llm._components import components
from variq.llm._store import Tables


def brute_components(sets, percent):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    items = sorted(sets.items())
    for k, (i, s) in enumerate(items):
        for j, t in items[:k]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (4, 5), (5, 6), (6, 7), (20, 20), (None, 3), (2, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Tables(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(1, 8), 1), 8: 8, 9: 8, 10: 8}
    assert components(spark.createDataFrame([], "a long, b long"), Tables(spark, "t")).count() == 0


@pytest.mark.parametrize("k, percent, block", [(4, 85, 1024), (2, 50, 4)])
def test_jaccard_join(spark, k, percent, block):
    rows = corpus(n=90)
    got = jaccard_join.similar_documents(frame(spark, rows), k=k, percent=percent, block=block, partitions=3).collect()
    assert len(got) == len(rows)
    sets = {i: shingles(x, k) for i, x, *_ in rows if i is not None}
    want = brute_components(sets, percent)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    assert any(n > 1 for n in collections.Counter(want.values()).values())
    assert jaccard_join.similar_documents(empty(spark), partitions=2).count() == 0


@pytest.mark.parametrize("key_block", [4096, 20])
def test_jaccard_join_of_a_large_group(spark, key_block):
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[: 100 + i % 20] + [f"own{i}"] * (i % 9)), None, None) for i in range(150)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_documents(frame(spark, rows), k=3, percent=85, block=16, key_block=key_block, partitions=3).collect()}
    assert got == brute_components({i: shingles(x, 3) for i, x, *_ in rows}, 85)


def windows_of(x, n):
    w = WORD.findall(x or "")
    return [tuple(w[k : k + n]) for k in range(len(w) - n + 1)]


@pytest.mark.parametrize("length", [3, 8, 13, 20])
def test_substrings(spark, length):
    rows = corpus(n=80)
    rows += [(3, rows[4][1], None, None)]  # an id with two texts
    levels = []
    got = substrings.remove_repeats(frame(spark, rows), length=length, partitions=3, with_text=True, longest=True, survivors=levels).collect()
    assert len(got) == len(rows)
    holders: dict = {}
    for i, x, *_ in rows:
        for n in {length << k for k in range(12)} | {n for n, _ in levels}:
            for w in windows_of(x, n):
                if i is not None:
                    holders.setdefault(w, set()).add(i)
    known = {}
    for i, x, *_ in rows:
        w = WORD.findall(x or "")
        gone = [False] * len(w)
        for k, window in enumerate(windows_of(x, length)):
            if i is not None and min(holders[window]) < i:
                gone[k : k + length] = [True] * length
        kept = " ".join(a for a, b in zip(w, gone, strict=True) if not b)
        known.setdefault(str(i), []).append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    found: dict = {}
    longest: dict = {}
    for r in got:
        found.setdefault(str(r["doc_id"]), []).append((r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]))
        longest[r["doc_id"]] = r["longest_repeat"]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in known.items()}
    # The longest level at which a smaller id has a window of the document.
    for i in longest:
        mine = [x for j, x, *_ in rows if j == i]
        want = max([n for k in range(12) for n in [length << k] if any(min(holders[w]) < i for x in mine for w in windows_of(x, n))], default=0) if i is not None else 0
        assert longest[i] == want
    # Each level sends on the windows that several documents hold, and no others (each id's places count once a window).
    assert [n for n, _ in levels][: len(substrings.levels_to(length))] == substrings.levels_to(length) and levels[-1][1] == 0
    for n, count in levels:
        places = {(i, k, w) for i, x, *_ in rows if i is not None for k, w in enumerate(windows_of(x, n)) if len(holders[w]) > 1}
        assert len(places) <= count <= 3 * len(places), n  # a repeated row sends its own again
    assert substrings.remove_repeats(empty(spark), partitions=2).count() == 0


def test_longest_repeat_follows_any_holder(spark):
    words = [f"w{k}" for k in range(1, 27)]
    rows = [(1, " ".join(words[13:]), None, None), (2, " ".join(words), None, None), (3, " ".join(words), None, None)]
    got = {r["doc_id"]: (r["n_removed"], r["longest_repeat"]) for r in substrings.remove_repeats(frame(spark, rows), partitions=2, longest=True).collect()}
    assert got == {1: (0, 0), 2: (13, 13), 3: (26, 26)}


def test_lines(spark):
    rows = [r for r in corpus(n=70) if r[0] is not None][:-2]
    rows += [(200, "A quite long line that many documents share, word for word\nfresh line of its own here", None, None), (201, "  a quite long line that many documents share, word for word \n\n\nx", None, None), (202, "a quite long line that many documents share, word for ward\nx", None, None), (203, "x", None, None)]
    df = frame(spark, rows).withColumn("n_lines", F.lit("clash"))
    lines = sorted((i, k, x.strip(" ").lower()) for i, t, *_ in rows if t for k, x in enumerate(t.split("\n")) if x.strip(" "))
    classes: dict = {}
    for i, k, x in lines:
        classes.setdefault(x, []).append((i, k))
    names = list(classes)
    grams = [{x.encode()[j : j + 8] for j in range(max(1, len(x.encode()) - 7))} for x in names]
    root = list(range(len(names)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(names)):
        for b in range(a):
            if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups: dict = {}
    for a, x in enumerate(names):
        groups.setdefault(find(a), []).extend(classes[x])
    want = {p for g in groups.values() for p in sorted(g)[1:]}
    got = {(r["doc_id"], r["at"]) for r in line_dedup.duplicate_lines(df).collect()}
    assert not got - want  # verified, so nothing is removed wrongly
    assert len(got) >= 0.99 * len(want)
    assert {(201, 0), (202, 0), (202, 1), (203, 0)} <= got and (200, 0) not in got
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    for i, t, *_ in rows:
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in got)
        assert out[i]["text"] == kept and out[i]["n_lines"] == (0 if t is None else t.count("\n") + 1)
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_lines_of_one_template(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for i in range(400):
        head, tail = "2024-05-01 warning from the storage service of the eastern volume ", word(10)
        lines += [head + tail] + ([head + tail[:3] + word(7)] if i % 8 == 0 else [])
    rng.shuffle(lines)
    grams = {i: {x[j : j + 8] for j in range(len(x) - 7)} for i, x in enumerate(lines)}
    want = {i for i, root in brute_components(grams, 80).items() if i != root}
    got = {r["doc_id"] for r in line_dedup.duplicate_lines(frame(spark, [(i, x, None, None) for i, x in enumerate(lines)])).collect()}
    assert len(want) > 50 and got == want


def test_lines_of_large_near_copy_groups(spark):
    """Recall over groups of near copies in which most pairs, but not all, are similar."""
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz "
    rows = []
    for _ in range(3):
        base = [rng.choice(letters) for _ in range(260)]
        for _ in range(200):
            line = list(base)
            for _ in range(rng.randint(0, 5)):
                line[rng.randrange(2, 258)] = rng.choice(letters)
            rows.append((len(rows), "x" + "".join(line[1:-1]) + "y", None, None))
    rng.shuffle(rows)
    grams = {i: {x[j : j + 8] for j in range(len(x) - 7)} for i, x, *_ in rows}
    root = brute_components(grams, 80)
    want = {i for i, r in root.items() if i != r}
    got = {r["doc_id"] for r in line_dedup.duplicate_lines(frame(spark, rows)).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) > 400


def test_lines_need_no_python_workers(spark, monkeypatch):
    """The default form is DataFrame expressions only; the kernels remove the same lines."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([5, 60, 900]))) for _ in range(30)]
    rows = [(i, base[i % 30] + ("" if i % 3 else "tail"), None, None) for i in range(120)]
    by_kernels = {r["doc_id"] for r in line_dedup.duplicate_lines(frame(spark, rows), kernels=True).collect()}

    def refused(*_, **__):
        raise AssertionError("Python on the executors")

    for kind in (DataFrame, type(frame(spark, rows))):
        for name in ("mapInArrow", "mapInPandas"):
            monkeypatch.setattr(kind, name, refused)
    got = {r["doc_id"] for r in line_dedup.duplicate_lines(frame(spark, rows)).collect()}
    assert got == by_kernels and len(got) > 60


def test_line_stage_of_the_pipeline_needs_no_python_workers(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("Python on the executors")

    docs = frame(spark, [(1, "the same line\nmy own", None, None), (2, "The same line", None, None), (3, "nothing shared", None, None)])
    for kind in (DataFrame, type(docs)):
        monkeypatch.setattr(kind, "mapInArrow", refused)
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert out == {1: "the same line\nmy own", 3: "nothing shared"}


def test_sketches_of_lines_miss_no_similar_pair(spark, monkeypatch):
    """Each similar pair of a bucket is left once, however many blocks and buckets it meets in; most others go."""
    rng = random.Random(8)
    lines, shared = [], ["".join(rng.choice("abcdefghijkl ") for _ in range(n)) for n in (300, 300, 1500)]
    for i in range(150):
        line = list(shared[i % 3])
        for _ in range(rng.choice([0, 1, 2, 4, 8, 16])):
            line[rng.randrange(len(line))] = rng.choice("xyz")
        lines.append("".join(line) * (2 if i % 7 == 0 else 1))
    grams = [{x[j : j + 8] for j in range(len(x) - 7)} for x in lines]
    want = {(j, i) for i in range(len(lines)) for j in range(i) if len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j])}
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", 40)
    classes = spark.createDataFrame(list(enumerate(lines)), "cls long, line string")
    members = spark.createDataFrame([(key, i, i) for i in range(len(lines)) for key in (1, 2) if key == 1 or i % 2], "key long, cls long, root long")
    near = line_dedup._near(members, line_dedup._sketches(members, classes, 8), 0.8).collect()
    left = {(r["b"], r["a"]) for r in near}
    assert len(left) == len(near) and want <= left and len(left) < 2 * len(want) < 0.5 * 150 * 149 / 2
    pairs = spark.createDataFrame([(b, a) for a, b in left], "cls long, head long")
    assert {(r["b"], r["a"]) for r in line_dedup._verified(pairs, classes, 8, 0.8).collect()} == want


def test_heads_of_pairs_are_hashed_together(monkeypatch):
    rng = random.Random(11)
    rows = []
    for head in range(300):
        y = "".join(rng.choice("abcde ") for _ in range(rng.choice([3, 7, 8, 40, 300])))
        for _ in range(rng.choice([1, 1, 2, 9])):
            x = list(y)
            for _ in range(rng.choice([0, 1, 6])):
                x[rng.randrange(len(x))] = "z"
            rows.append((len(rows) + 1000, head - 150, "".join(x), y))
    sets = lambda s: {s[i : i + 8] for i in range(max(1, len(s) - 7))}
    want = {(c, h) for c, h, x, y in rows if len(sets(x) & sets(y)) >= 0.8 * len(sets(x) | sets(y))}
    assert 0 < len(want) < len(rows)
    whole = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["cls", "head", "x", "y"])
    calls, made = [], line_dedup.sets_of
    monkeypatch.setattr(line_dedup, "sets_of", lambda *a: calls.append(1) or made(*a))
    # Batches cut heads in two; few bytes of heads at once cut them again.
    for size, held in ((10_000, 4 << 20), (7, 4 << 20), (10_000, 500)):
        monkeypatch.setattr(line_dedup, "HEAD_BYTES", held)
        calls.clear()
        out = list(line_dedup.verified((whole.slice(i, size) for i in range(0, len(rows), size)), 8, 0.8))
        assert {x for b in out for x in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True)} == want
        assert len(calls) == 2 * len(out)


def test_mixing(spark):
    rows = corpus(n=200)
    mixed = mixing.mix_sources(frame(spark, rows).withColumn("target", F.lit("clash")))
    got = mixed.collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, x, _, s in rows:
        size[s] += len(WORD.findall(x or ""))
    names = sorted((s for s in size if s is not None)) + [None]
    weight, target, total = {s: 1 + k % 3 for k, s in enumerate(names)}, {}, sum(size.values())
    free = set(names)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 3 * size[s]
            free.discard(s)
    target |= share
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert sorted(map(str, got)) == sorted(map(str, mixed.collect()))
    assert mixing.emit_copies(mixed).count() == sum(r["copies"] for r in got)
    assert mixing.mix_sources(empty(spark)).count() == 0
    for s in names:  # size classes span a factor of two; one text is a third of all words
        assert abs(taken[s] - target[s]) <= 2 * largest[s], s
    long = [r for r in rows if len(r[1] or "") < 5000 and r[3]]
    for r in mixing.mix_sources(frame(spark, long)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")).collect():
        assert abs(r["taken"] - r["target"]) <= max(0.15 * r["target"], r["largest"])


def brute_lines(rows):
    """(id, hash of the text, place) of the lines that a sooner similar one makes superfluous."""
    classes: dict = {}
    for i, h, x in rows:
        for k, line in enumerate((x or "").split("\n") if i is not None else []):
            if line.strip(" "):
                classes.setdefault(line.strip(" ").lower(), set()).add((i, h, k))
    grams = {x: {x.encode()[j : j + 8] for j in range(max(1, len(x.encode()) - 7))} for x in classes}
    groups: dict = {}
    for x, root in brute_components(dict(enumerate(grams.values())), 80).items():
        groups.setdefault(root, set()).update(list(classes.values())[x])
    return {p for g in groups.values() for p in sorted(g)[1:]}


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import sentencepiece

    import corpus_pipeline
    from variq.llm import pieces

    rows = corpus(n=80)
    rows += [(7, "an id that has another text, too\nwith a line of its own", "en", "a"), (None, rows[4][1], "en", "b"), (None, "a row without an id\nthat is like no other row", "en", "b")]
    docs = frame(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [[r.asDict() for r in docs.withColumn("h", F.xxhash64("text")).collect()]]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append([r.asDict() for r in (docs.withColumn("h", F.xxhash64("text")) if "text" in docs.columns else docs).collect()])
    start, labelled, lined, single, mixed, done = seen
    bag = lambda rows: collections.Counter((r["doc_id"], r["text"]) for r in rows)
    assert bag(labelled) == bag(r for r in start if any(map(str.isalpha, r["text"] or "")))
    assert all(r["lang"] in ("en", "de", "fr") for r in labelled)

    gone, want = brute_lines([(r["doc_id"], r["h"], r["text"]) for r in labelled]), collections.Counter()
    for r in labelled:
        lines = r["text"].split("\n")
        left = [x for k, x in enumerate(lines) if (r["doc_id"], r["h"], k) not in gone]
        if len(left) == len(lines) or "".join(left).strip():
            want[r["doc_id"], "\n".join(left)] += 1
    assert bag(lined) == want
    assert all(r["n_chars"] == len(r["text"]) for r in lined)

    sets = {k: shingles(r["text"], 5) for k, r in enumerate(lined)}
    groups: dict = {}
    for k, root in brute_components(sets, 80).items():
        groups.setdefault(root if sets[k] else ("alone", k), []).append(k)
    rank = lambda k: (lined[k]["doc_id"] is None, lined[k]["doc_id"] or 0, lined[k]["h"])
    assert bag(single) == bag(lined[min(g, key=rank)] for g in groups.values())

    size = collections.Counter()
    for r in single:
        size[r["source"]] += len(WORD.findall(r["text"]))
    copies, before = bag(mixed), bag(single)
    assert set(copies) <= set(before) and all(n <= 3 * before[x] for x, n in copies.items())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in done) == collections.Counter((r["doc_id"], tuple(library.encode(r["text"]))) for r in mixed)
    assert all(r["round_trip"] for r in done)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    empty(spark).withColumn("n_chars", F.lit(0).cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
