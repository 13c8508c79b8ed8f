"""Language identification by the nearest of several centroids per language, over TF-IDF n-gram vectors.

A text is a vector of counts of hashed byte n-grams within words, damped, weighted by inverse document frequency and
normalised. Each language has up to CENTROIDS centroids found by spherical k-means on a bounded training sample;
the nearest centroid by cosine names the language, and one that is too far is reported as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.shingles import pieces
from leafgraph.llm.shipping import Shipped

#: n-grams of so many bytes (blanks between words count as one), hashed to SLOTS.
GRAMS, SLOTS = (1, 2, 3), 1 << 13
CENTROIDS, ROUNDS = 4, 8
#: The bounded training sample: about so many documents of each language, and at most so many languages.
TRAIN_PER_LANGUAGE, LANGUAGES = 800, 400
#: The share of training documents of a language that may lie farther from their nearest centroid than its limit.
REJECTED = 0.005
#: Bytes that are not part of a word: all ASCII but letters.
_PART = np.ones(256, bool)
_PART[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def grams(texts: pa.Array) -> Iterator[np.ndarray]:
    """Counts of the n-grams of each text, float32 of SLOTS: lower-cased words with one blank before, between and after."""
    for raw, bounds in pieces(pc.utf8_lower(texts)):
        blank = _PART[raw]
        keep = ~blank | np.concatenate(([True], ~blank[:-1]))  # one blank of each run
        at = np.concatenate(([0], np.cumsum(keep)))[bounds]
        code = np.where(blank, 0, raw)[keep].astype(np.uint32)
        slots = []
        mix = np.zeros_like(code)
        for n in range(1, max(GRAMS) + 1):
            mix[: len(code) - n + 1] = mix[: len(code) - n + 1] * np.uint32(0x01000193) ^ code[n - 1 :]
            if n in GRAMS:
                hashed = (mix ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                slots.append((n, (hashed >> np.uint32(32 - SLOTS.bit_length() + 1)).astype(np.int64)))
        for a, b in zip(at[:-1], at[1:], strict=True):
            # a text's n-grams end before the first blank of the next
            parts = [s[a : max(a, b - n + 1)] for n, s in slots]
            yield np.bincount(np.concatenate(parts), minlength=SLOTS).astype(np.float32)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


class Model:
    """centroids (n, SLOTS) of unit length, language of each, and the least cosine at which each is near enough."""

    def __init__(self, languages: list[str], idf: np.ndarray, centroids: np.ndarray, of: np.ndarray, limits: np.ndarray):
        self.languages, self.idf, self.centroids, self.of, self.limits = languages, idf, centroids, of, limits

    @classmethod
    def empty(cls) -> Model:
        """A model without languages; nothing can be predicted with it."""
        return cls([], np.ones(SLOTS, np.float32), np.zeros((0, SLOTS), np.float32), np.zeros(0, int), np.zeros(0))

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        return normal(np.log1p(counts) * self.idf)

    def predicted(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, cosine, and whether it is farther than the limit, for each text."""
        if not self.languages:
            n = len(texts)
            return np.zeros(n, int), np.zeros(n), np.ones(n, bool)
        out: list = []
        block: list = []

        def flush() -> None:
            cosine = self.weighted(np.array(block)) @ self.centroids.T
            best = cosine.argmax(1)
            top = cosine[np.arange(len(best)), best]
            out.append((self.of[best], top, top < self.limits[best]))
            block.clear()

        for counts in grams(texts):
            block.append(counts)
            if len(block) == 256:
                flush()
        if block:
            flush()
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0), np.zeros(0, bool))


def normal(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.square(x).sum(-1, keepdims=True)), 1e-9)


def clustered(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means: at most n unit centroids of the rows of x."""
    centroids = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = (x @ centroids.T).argmax(1)
        centroids = np.array([x[near == k].mean(0) if (near == k).any() else centroids[k] for k in range(len(centroids))])
        centroids = normal(centroids)
    return centroids


def trained(counts: np.ndarray, languages: np.ndarray, seed: int = 2) -> Model:
    rng = np.random.default_rng(seed)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x = normal(np.log1p(counts) * idf)
    names = sorted(set(languages))
    centroids, of, limits = [], [], []
    for k, name in enumerate(names):
        own = x[languages == name]
        found = clustered(own, CENTROIDS, rng)
        cosine = own @ found.T
        near = cosine.argmax(1)
        for c in range(len(found)):
            mine = cosine[near == c, c]
            limits.append(float(np.quantile(mine, REJECTED)) if len(mine) else 1.0)
        centroids.append(found)
        of += [k] * len(found)
    return Model(names, idf, np.concatenate(centroids).astype(np.float32), np.array(of), np.array(limits))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame) -> Model:
    """A model of about TRAIN_PER_LANGUAGE documents of each language, chosen by hash among those that are not held out;
    an empty one if there is none with a letter. More than LANGUAGES languages raise ValueError: their sample would not fit
    the driver.

    The executors send a training document's non-zero counts only: at most SLOTS numbers, however long the text.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    n = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(n) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages to learn; raise LANGUAGES if the driver has 26 MB for each")
    if not n:
        return Model.empty()
    share = F.create_map(*[F.lit(x) for lang, c in n.items() for x in (lang, min(1.0, TRAIN_PER_LANGUAGE / c))])
    at = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(has_letter(F.col("text"))).where(at < share[F.col("lang")]).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, counts = [], []
            for c in grams(batch.column(2)):
                at = np.flatnonzero(c)
                slots.append(at.astype(np.int32))
                counts.append(c[at])
            columns = [batch.column(0), batch.column(1), pa.array(slots, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "slots", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = chosen.mapInArrow(run, f"doc_id {kind}, lang string, slots array<int>, counts array<float>").toArrow()
    if not len(rows):
        return Model.empty()
    rows = rows.take(pc.sort_indices(rows, [("lang", "ascending"), ("doc_id", "ascending")]))
    counts = np.zeros((len(rows), SLOTS), np.float32)
    for i, (s, c) in enumerate(zip(rows.column("slots"), rows.column("counts"), strict=True)):
        counts[i, s.values.to_numpy()] = c.values.to_numpy()
    return trained(counts, np.array(rows.column("lang").to_pylist()))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``docs`` (doc_id, text, lang).

    ``lang`` serves only to fit the model, and not that of held-out documents. lang_pred is ``und`` and score 0 where
    the text is null or has no letter; else it is a learned language and score the cosine with its nearest centroid.
    rejected: there is no letter, or the centroid is farther than all but REJECTED of its own training documents. An empty
    table gives no rows. Where no document can be learned from, as none has both a language and a letter, every prediction
    is ``und`` with score 0 and rejected. Rows repeated count each; doc_id may be of any type.
    """
    shared = Shipped(docs.sparkSession.sparkContext, fitted(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.open()
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            best, cosine, far = model.predicted(batch.column(2))
            lettered = batch.column(3).to_numpy(zero_copy_only=False).astype(bool) & bool(model.languages)
            best = np.where(lettered, best, len(names) - 1)
            score = np.where(lettered, np.clip(cosine, 0, 1), 0.0)
            columns = [batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(far | ~lettered)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", has_letter(F.col("text")).alias("lettered"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean"
    return rows.mapInArrow(run, schema)
