"""Near-dedup, decontamination, toxicity, languages, chats and the pipeline against brute force, with odd rows."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafgraph.llm import chat_format, decontam, langid, near_dedup, queries, shingles, toxicity
from leafgraph.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, text_id int"
SF = "/root/testdata/sf0.001"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "a", len(t or ""), None, None, None) for i, t in rows], DOCS)


def near_sets(texts, n=4):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute_components(rows, n=4):
    sets = near_sets([t for _, t in rows], n)
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations([(i, s) for (i, _), s in zip(rows, sets) if i is not None and s], 2):
        if 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in root}, sets


def edited(rng, words, share):
    return [rng.choice(["x", "y", "z"]) + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


def corpus(seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = [(10 + i, " ".join(edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.04, 0.05])))) for i in range(120)]
    rows += [(500 + i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    rows += [(700 + i, rows[i][1].upper()) for i in range(20)]
    shared = " ".join(f"s{i}" for i in range(40))
    rows += [(800 + i, shared + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 14)))) for i in range(60)]
    rows += [(1, None), (2, ""), (3, " \n "), (4, "One"), (5, "one"), (6, "one two three"), (None, "one"), (None, None), (7, "long " * 50_000), (8, "LONG " * 60_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus()
    want, sets = brute_components(rows)
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == Counter((i, len(s), want.get(i), i is None or want[i] == i) for (i, _), s in zip(rows, sets))


def test_near_duplicates_cut_deeper(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "RUN", 40)
    rows = corpus(2)
    want, _ = brute_components(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows)).collect() if r.doc_id is not None}
    assert sum(got[i] != want[i] for i in want) <= len(want) // 50


def test_dense_runs_stay_whole(spark, monkeypatch):
    """Documents that share five minima in one order, and not one more, are of one region, however many they are."""
    monkeypatch.setattr(near_dedup, "RUN", 2)
    rng = np.random.default_rng(4)
    size = 4 * near_dedup.TREES * near_dedup.DEPTH
    shared = rng.bytes(4 * near_dedup.DEPTH)
    rows = [(i, bytearray(shared + rng.bytes(size - len(shared)))) for i in range(6)] + [(9, bytearray(rng.bytes(size)))]
    found = near_dedup.runs(spark.createDataFrame(rows, "doc_id long, signature binary"))
    assert sorted((r.doc_id, r.size) for r in found.collect()) == [(i, 6) for i in range(6)]
    assert sorted(tuple(r) for r in near_dedup.regions(found).collect()) == [(0, i) for i in range(6)]


def test_near_duplicates_of_repeated_ids_and_empty_tables(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (1, "p q r s t u v"), (3, "P q r s t u v"), (3, "k l m n")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs(spark, rows)).collect())
    assert got == Counter([(1, 4, 1), (1, 4, 1), (2, 4, 1), (1, 4, 1), (3, 4, 1), (3, 1, 1)])
    assert near_dedup.near_duplicates(docs(spark, rows).limit(0)).count() == 0
    assert sorted(r.doc_id for r in near_dedup.unique_documents(docs(spark, rows)).collect()) == [1, 1, 1]


def test_components_of_long_paths(spark):
    n = 200
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


def test_shingle_sets_are_those_of_the_words():
    texts = [t for _, t in corpus()] + ["a", None, "b c", "é É ü", "tab\tnew\nline\x0b\x0c x"]
    for size in (1, 4, 5):
        for pieces in (1 << 20, 64):
            shingles.PIECE, old = pieces, shingles.PIECE
            try:
                found = list(shingles.shingle_sets(pa.array(texts), size))
            finally:
                shingles.PIECE = old
            assert [len(f) for f in found] == [len(s) for s in near_sets(texts, size)]
    a, b = shingles.shingle_sets(pa.array(["q a b c d", "z A b C d"]), 4)
    assert len(np.intersect1d(a, b)) == 1


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_contamination(text, items, window=10):
    seq, hit, ids = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            part = w[k : k + window]
            for p in range(len(seq) - len(part) + 1):
                if seq[p : p + len(part)] == part:
                    hit |= set(range(p, p + len(part)))
                    ids.add("" if item is None else str(item))
    return len(seq), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def contaminated(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "Dé", "e1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 6, 9, 10, 11, 15, 30]) + 2)) for i in range(12)] + [(5, text(14)), (None, text(12)), (50, None), (51, ""), (52, "...")]
    rows = [(i, text(rng.randrange(0, 60))) for i in range(60)] + [(100 + i, text(5) + "! " + (t or "").upper() + ", " + text(5)) for i, (_, t) in enumerate(items)]
    return items, [*rows, (200, None), (201, ""), (201, ""), (None, items[0][1]), (202, "other " * 50_000 + items[1][1])]


@pytest.mark.parametrize("block_words", [200_000, 25])
def test_contamination(spark, block_words):
    for seed in (1, 2):
        items, rows = contaminated(seed)
        table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
        got = decontam.contamination(docs(spark, rows), table, block_words=block_words).collect()
        want = Counter((i, *brute_contamination(t, items)) for i, t in rows)
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want


def test_cleaning_cuts_passages_and_drops_what_is_mostly_passage(spark):
    item = " ".join(f"i{k}" for k in range(20))
    table = spark.createDataFrame([(1, item)], "item_id long, text string")
    clean = " ".join(f"c{k}" for k in range(60))
    rows = [(1, clean), (2, f"{clean}. {item.upper()}! end"), (3, f"x {item}"), (4, None), (5, "")]
    got = {r.doc_id: r for r in decontam.cleaned(docs(spark, rows), table).collect()}
    assert sorted(got) == [1, 2, 4, 5] and got[1].text == clean and got[2].text == f"{clean}. ! end" and got[4].text is None
    assert all(r.n_chars == len(r.text or "") for r in got.values())
    assert decontam.contamination(docs(spark, rows), table.limit(0)).where("contaminated").count() == 0
    assert decontam.cleaned(docs(spark, rows).limit(0), table).count() == 0


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    network = toxicity.Network()
    x = rng.normal(size=(9, toxicity.INPUTS)).astype(np.float32)
    kind, there = rng.integers(0, 9, (7, 5)), rng.random((7, 5)) < 0.8
    there[0] = True
    weight = rng.normal(size=5).astype(np.float32)
    back: dict = {}
    network.forward(x, kind, there, back)
    g, d_inputs = network.backward(back, weight)
    for name, values in [*network.p.items(), ("inputs", x)]:
        flat, slope = values.reshape(-1), (d_inputs if name == "inputs" else g[name]).reshape(-1)
        for i in rng.choice(len(flat), min(8, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-2
            up = (network.forward(x, kind, there).astype(float) * weight).sum()
            flat[i] = old - 1e-2
            down = (network.forward(x, kind, there).astype(float) * weight).sum()
            flat[i] = old
            assert (up - down) / 2e-2 == pytest.approx(slope[i], rel=0.05, abs=2e-2), name


def test_slopes_of_vectors_reach_the_words_and_their_largest_grams():
    rng = np.random.default_rng(1)
    words = toxicity.Words.of(pa.array(["alpha bet gamma delta alphabet a", "zz"], pa.large_string()))
    found = list(words.grams())
    grams = np.full((len(words.hashes), len(found)), toxicity.GRAM_BUCKETS, np.int32)
    for place, (types, code) in enumerate(found):
        grams[types, place] = code
    vectors = toxicity.Vectors()
    vectors.words[:] = rng.normal(size=vectors.words.shape)
    batch = toxicity.Batch(np.arange(len(words.hashes) + 1), words, grams)
    known = np.ones(len(words.hashes), bool)
    known[0] = False
    x = batch.inputs(vectors, known)
    assert (x[-1] == 0).all() and (x[0, : toxicity.WORD_INPUTS] == 0).all()
    assert np.array_equal(x[1:-1], vectors.of(words)[1:]) and np.array_equal(x[:-1, toxicity.WORD_INPUTS :], vectors.of(words)[:, toxicity.WORD_INPUTS :])
    d = rng.normal(size=x.shape).astype(np.float32)
    slopes = batch.slopes(vectors, d)
    for name, table in (("words", vectors.words), ("grams", vectors.grams)):
        for at in np.argwhere(slopes[name])[:40]:
            old = table[tuple(at)]
            table[tuple(at)] = old + 1e-3
            up = (batch.inputs(vectors, known) * d).sum(dtype=float)
            table[tuple(at)] = old
            assert (up - (x * d).sum(dtype=float)) / 1e-3 == pytest.approx(slopes[name][tuple(at)], rel=0.05, abs=2e-2), name
        assert np.count_nonzero(slopes[name]) >= 24


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def slow_score(model, text):
    """The score by loops over single words, states and windows; words of ASCII only, of 24 bytes at most."""
    p, h = {k: v.astype(float) for k, v in model.network.p.items()}, toxicity.HIDDEN
    seq = re.findall("[0-9a-z]+", text.lower())

    def code(part, salt):
        x = salt
        for c in part.encode():
            x = (x * 257 + c) % 2**64
        return int(shingles.mixed_bits(np.array([x], np.uint64))[0] % np.uint64(toxicity.GRAM_BUCKETS))

    def vector(word):
        whole = shingles.span_hashes(np.frombuffer(word.encode(), np.uint8), np.array([0]), np.array([len(word)]))[0]
        codes = [code(word[:n], n + 100) for n in toxicity.BEGINS if len(word) >= n]
        codes += [code(word[i : i + n], n) for n in toxicity.GRAMS for i in range(1, len(word) - n + 1)]
        grams = [max(model.vectors.grams[c][k] for c in codes) for k in range(toxicity.GRAM_INPUTS)] if codes else [0] * toxicity.GRAM_INPUTS
        return np.array([*model.vectors.words[int(whole % np.uint64(toxicity.WORD_BUCKETS))], *grams], float)

    def states(xs, way):
        state, out = np.zeros(h), []
        for x in xs:
            a, b = x @ p[f"w{way}"] + p[f"c{way}"], state @ p[f"u{way}"]
            z, r = sigmoid(a[:h] + b[:h]), sigmoid(a[h : 2 * h] + b[h : 2 * h])
            state = (1 - z) * np.tanh(a[2 * h :] + r * b[2 * h :]) + z * state
            out.append(state)
        return out

    best, at = -np.inf, 0
    while True:
        xs = [vector(w) for w in seq[at : at + toxicity.WINDOW]]
        blanks = [np.zeros(toxicity.INPUTS)] * (toxicity.WINDOW - len(xs))
        ahead, behind = states(xs + blanks, "f"), states((xs + blanks)[::-1], "b")[::-1]
        both = [np.concatenate(x) for x in zip(ahead, behind)][: max(1, len(xs))]
        heat = np.exp([x @ p["v"] for x in both]) if xs else np.ones(1)
        if not xs:
            both = [np.mean([np.concatenate(x) for x in zip(ahead, behind)], axis=0)]
        best = max(best, sum(w * x for w, x in zip(heat / heat.sum(), both)) @ p["out"] + p["bias"][0])
        if at + toxicity.WINDOW >= len(seq):
            return sigmoid(best)
        at += toxicity.STRIDE


def test_scores_equal_those_by_loops():
    rows, labels = toxic_corpus(200)
    model = toxicity.trained(pa.array([t for _, t in rows], pa.large_string()), np.array([y for _, y in labels]), np.ones(len(rows)))
    texts = [t for _, t in rows[:25]] + ["", "a", "Grumpf!", "ba " * 33 + "grumpf", "x-y (grumpf) 12 é".replace("é", "")]
    assert model.scores(pa.array(texts)) == pytest.approx([slow_score(model, t) for t in texts], abs=2e-4)


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        start, size, first = toxicity.windows(np.array([0, n]))
        covered = {w for s, k in zip(start, size) for w in range(s, s + k)}
        assert covered == set(range(n)) and first[-1] == len(start) and (size[1:] > 0).all()


def toxic_corpus(n=900):
    rng = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows, labels = [], []
    for i in range(n):
        text = [word() for _ in range(rng.randrange(1, 150))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text) + 1), rng.choice(["Grumpf", "zxolt!" "", "quxx" + word()]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_of_held_out_documents(spark):
    rows, labels = toxic_corpus()
    odd = [(5000, None), (5001, ""), (5002, "!!! ..."), (5003, "ba " * 100_000 + "grumpf"), (None, "ba grumpf"), (0, "ba")]
    table = spark.createDataFrame([*labels, (3, None), (None, 1), (9999, 1), (7, 1 - labels[7][1])], "doc_id long, toxic int").withColumn("text", F.lit("x"))
    got = toxicity.scored(docs(spark, rows + odd), table)
    assert got.columns == [c for c in DOCS.replace(",", "").split()[::2] if c != "score"] + ["score", "predicted"]
    by = defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r)
    held = [(by[i][0].predicted, y) for i, y in labels if i and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for rs in by.values() for r in rs)
    assert [by[i][0].predicted for i in (5000, 5001, 5002, 5003, None)] == [0, 0, 0, 1, 1] and len(by[0]) == 2
    assert toxicity.scored(docs(spark, rows).limit(0), table).count() == 0
    assert toxicity.scored(docs(spark, rows[:3]), table.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_is_trained_outside_the_driver(spark, monkeypatch):
    rows, labels = toxic_corpus(300)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    driver, train = os.getpid(), toxicity.trained

    def elsewhere(texts, *others):
        assert os.getpid() != driver or not len(texts)
        return train(texts, *others)

    monkeypatch.setattr(toxicity, "trained", elsewhere)
    model = toxicity.fitted(docs(spark, rows), known)
    empty = toxicity.Model.of({}).arrays()
    assert {k: (v.shape, v.dtype) for k, v in model.arrays().items()} == {k: (v.shape, v.dtype) for k, v in empty.items()}
    scores, bad = model.scores(pa.array([t for _, t in rows])), np.array([y for _, y in labels]) == 1
    assert scores[bad].mean() > scores[~bad].mean() + 0.3
    assert toxicity.fitted(docs(spark, rows).limit(0), known).scores(pa.array(["a", None])).max() < 0.5


def test_toxicity_model_travels_small(spark, monkeypatch):
    rows, labels = toxic_corpus(300)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.trained(pa.array([t for _, t in rows], pa.large_string()), np.array([y for _, y in labels]), np.ones(len(rows)))
    again = toxicity.Model.of(model.packed()).arrays()
    assert {k: v.tobytes() for k, v in again.items()} == {k: v.tobytes() for k, v in model.arrays().items()}
    sizes, ship = [], toxicity.Shipped

    def shipped(context, thing):
        found = ship(context, thing)
        sizes.append(len(found.bytes.value))
        return found

    monkeypatch.setattr(toxicity, "Shipped", shipped)
    assert toxicity.accepted(docs(spark, rows), known).count() < len(rows)
    assert sizes[0] < 2_000_000  # the vectors as they are have 10 MB


def test_toxicity_reads_every_byte():
    rows, labels = toxic_corpus()
    model = toxicity.trained(pa.array([t for _, t in rows], pa.large_string()), np.array([y for _, y in labels]), np.ones(len(rows)))
    clean = [t.split() for (_, t), (_, y) in zip(rows, labels) if not y and t.count(" ") > 40][:20]
    for glue in ("\u3000", "\u00a0", "\u2014", "\u201d \u201c", "\u3002", "\uff0c"):
        joined = [glue.join(w) for w in clean] + [glue.join([*w[:20], "grumpf", *w[20:]]) for w in clean]
        spaced = [j.replace(glue, " ") for j in joined]
        assert (model.scores(pa.array(joined)) == model.scores(pa.array(spaced))).all(), glue
    runs = ["".join(w[:20]) for w in clean]
    inside = model.scores(pa.array([r + "grumpf" + r for r in runs]))
    assert (inside > 2 * model.scores(pa.array([r + r for r in runs]))).all()
    for n in (1, 23, 24, 25, 43, 44, 62, 63, 500):
        word = np.random.default_rng(n).integers(0x4E00, 0x9FFF, n)
        raw = np.frombuffer(("a" * (n % 3) + "".join(map(chr, word)) + " ").encode(), np.uint8)
        words = toxicity.Words(raw, np.array([0, len(raw)]))
        text = [bytes(x).rstrip(b"\0") for x in words.letters]
        for size in toxicity.GRAMS:
            inner = {x[i : i + size] for x in text for i in range(1, len(x) - size + 1)}
            assert inner == {bytes(raw[i : i + size]) for i in range(1, len(raw) - size)}, (n, size)


def test_languages(spark):
    got = {r.doc_id: r for r in queries.op6_language_id(spark, SF).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)


def test_languages_of_odd_rows(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(30)] + [(100 + i, "der Hund und die Katze", "de") for i in range(30)]
    odd = [(200, None, "en"), (201, "", None), (202, "123 !?", "de"), (203, "日本語", None), (204, "THE DOG", None), (205, "und " * 80_000, None), (None, "the cat", "xx"), (0, "Katze", None)]
    table = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {(r.doc_id, r.lang_pred, r.score > 0, r.rejected) for r in langid.identified(table).collect()}
    assert {(200, "und", False, True), (201, "und", False, True), (202, "und", False, True)} <= got
    assert {(i, p) for i, p, _, _ in got if i in (203, 204, 205, None)} >= {(204, "en"), (205, "de"), (None, "en")}
    assert (203, True) in {(i, far) for i, _, _, far in got} and len([1 for i, *_ in got if i == 0]) == 2
    assert langid.identified(table.limit(0)).count() == 0
    for nothing in (table.where("lang is null"), table.where("not text rlike '[a-zA-Z]'")):  # no language, or no letter, to learn from
        rows = langid.identified(nothing).collect()
        assert len(rows) == nothing.count() > 0 and all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in rows)
    named = table.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert {r.lang_pred for r in langid.identified(named).where("doc_id = 'd204'").collect()} == {"en"}


def cheapest(roles):
    """Least cost by trying every sequence of choices."""
    best = [chat_format.FAR]

    def go(i, state, cost):
        if cost >= best[0]:
            return
        if i == len(roles):
            best[0] = min(best[0], cost + chat_format.FINISH[state][0])
            return
        for r in (1, 2, 3):
            price = cost + chat_format.relabel(roles[i], r)
            if r in chat_format.NEXT[state]:
                go(i + 1, r, price)
            if r == state:
                go(i + 1, r, price + chat_format.MERGE)
            for q in chat_format.NEXT[state]:
                if r in chat_format.NEXT[q]:
                    go(i + 1, r, price + chat_format.INSERT)

    go(0, 0, 0)
    return best[0]


def cost_of(pieces, given):
    total = 0
    for p in pieces:
        if p.after == 0 or p.action == "merge":
            total += chat_format.INSERT if p.after == 0 else chat_format.MERGE
        if p.after == 1:
            total += chat_format.relabel(given[p.place], chat_format.ROLES.index(p.role))
    return total


@pytest.mark.parametrize("partitions", [1, 7])
def test_chats(spark, partitions):
    rng = random.Random(9)
    names = ["system", "user", "assistant", "User ", "bot", "tool", None]
    turns = [(c, t, rng.choice(names), rng.choice(["hi", None, "", "a b"])) for c in range(40) for t in range(rng.randrange(1, 7))]
    turns += [(77, t, rng.choice(names[:3]), f"t{t}") for t in range(300)] + [(None, 1, "user", "x"), (None, None, "user", "y"), (78, 1, "user", "z"), (78, 1, "user", "z")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("rendered", F.lit(1))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat_format.formatted(table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    by = defaultdict(list)
    for p in sorted(got, key=lambda p: (p.place, p.after)):
        by[p.conv_id].append(p)
    low = lambda v: (v is not None, v or 0)
    for conv in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (low(t[1]), t[2] is not None, t[2] or "", t[3] is not None, t[3] or ""))
        given, pieces = [chat_format.known(t[2]) for t in own], by[conv]
        assert [p.turn for p in pieces if p.after] == [t[1] for t in own]
        whole = "".join(p.rendered for p in pieces)
        found = re.findall(r"<\|(system|user|assistant)\|>\n(.*?)<\|end\|>\n", whole, re.S)
        assert "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in found) == whole
        roles = [chat_format.ROLES.index(r) for r, _ in found]
        assert all(r in chat_format.NEXT[s] for s, r in zip([0, *roles], roles)) and roles[-1] in (2, 3)
        assert sorted({p.out_turn for p in pieces}) == list(range(len(roles)))
        if len(own) <= 6:
            assert cost_of(pieces, given) == cheapest(given)
        else:
            now, _ = chat_format.priced(given, 0)
            assert cost_of(pieces, given) == min(now[s][0] + chat_format.FINISH[s][0] for s in range(4))


def test_empty_chats(spark):
    assert chat_format.formatted(spark.createDataFrame([], "conv_id string, turn int, role string, text string")).count() == 0


def same_texts(texts):
    out = defaultdict(list)
    for i, t in texts.items():
        out[re.sub(r"[\x20\x09-\x0D]+", "", t)].append(i)
    return out.values()


def test_pipeline_stages_against_brute_force(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    rows, names = raw, raw.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF).cache()
        seen[name] = {r.doc_id: r.text for r in rows.collect()}
        if name != "mixing":
            assert rows.columns == names
    assert set(seen["exact_dedup"]) == {
        max(own, key=lambda i: (len(seen["toxicity"][i]), -i))
        for own in same_texts(seen["toxicity"])
    }
    want, _ = brute_components(list(seen["exact_dedup"].items()), 5)
    assert set(seen["near_dedup"]) == set(want.values())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, text in seen["near_dedup"].items():
        n, hits, *_ = brute_contamination(text, items)
        if hits > n / 2:
            assert i not in seen["decontamination"]
        else:
            assert (seen["decontamination"][i] == text) == (hits == 0)
    assert set(seen["mixing"]) <= set(seen["decontamination"])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(r.doc_id for r in raw.select("doc_id").collect()) - set(seen["toxicity"])
    assert sum(labels.get(i) == 0 for i in gone) <= 2
