"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Word input: a learned vector of the word, found by its hash; a word that no training text had adds nothing.
Character input: learned vectors of the word's hashed beginnings and inner n-grams, of which the largest value counts in each
dimension, so that unseen forms of a word are recognised. Training begins one dimension of both at log odds of the sample and
moves all of them together with the network. Words end at blanks and punctuation of ASCII and beyond; what
is longer than LETTERS bytes, such as a sentence in a script without blanks, is read in overlapping pieces, each a word of its
own. The network reads overlapping windows of every whole text; a text scores as its worst window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafgraph.llm.shingles import mixed_bits, pieces, span_hashes, word_spans
from leafgraph.llm.shipping import Shipped

#: The bounded training sample: so many labelled documents of either kind, with texts of at most so many characters.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 1500, 3000, 12_000
#: Words of a window, and from one window to the next.
WINDOW, STRIDE = 32, 24
#: Values of a word's vector and of an n-gram's, and of a state of the network.
WORD_INPUTS, GRAM_INPUTS, HIDDEN = 8, 8, 8
INPUTS = WORD_INPUTS + GRAM_INPUTS
#: Beginnings of so many bytes, and n-grams of so many anywhere in a word or piece of LETTERS bytes.
BEGINS, GRAMS, LETTERS = (3, 4, 5, 6), (4, 5), 24
#: Vectors that words and n-grams share by hash.
WORD_BUCKETS, GRAM_BUCKETS = 1 << 16, 1 << 18
#: STEPS is the least number of steps: a small sample is seen more often.
EPOCHS, STEPS, BATCH, RATE = 5, 120, 128, 0.04
#: In every so manieth epoch the highest window of each document is looked for anew.
LOOKS = 3
#: Smoothing of the first values of vectors, as so many words seen.
PRIOR = 10.0
#: The share of words whose vector is left out of a training step, so that their n-grams learn too.
DROPPED = 0.3
#: Steadies the steps of vectors: those with small slopes, such as words of clean texts only, hardly move.
STEADY = 1e-3

_LETTER = np.ones(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False  # what parts words
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: From one piece of a long word to the next: so every inner n-gram of the word is an inner one of some piece.
PIECE_STRIDE = LETTERS - max(GRAMS)
#: Code points beyond ASCII that part words: blanks and punctuation, without joiners and marks of direction.
_PARTS = [
    0x85, 0xA0, *range(0xA1, 0xAA), 0xAB, 0xAC, *range(0xAE, 0xB2), 0xB4, *range(0xB6, 0xB9), 0xBB, 0xBF, 0xD7, 0xF7,
    0x37E, 0x387, 0x589, 0x5BE, 0x5C0, 0x5C3, 0x60C, 0x61B, 0x61F, *range(0x66A, 0x66E), 0x6D4, 0x964, 0x965, 0xE5A, 0xE5B, 0x104A, 0x104B, 0x1680, 0x17D4, 0x17D5,
    *range(0x2000, 0x200C), *range(0x2010, 0x202A), *range(0x202F, 0x2060), *range(0x3000, 0x3005), *range(0x3008, 0x3021), 0x3030, 0x303D, 0x30FB,
    *range(0xFE30, 0xFE70), *range(0xFF01, 0xFF10), *range(0xFF1A, 0xFF21), *range(0xFF3B, 0xFF41), *range(0xFF5B, 0xFF66),
]
_PARTS_2 = np.array([int.from_bytes(chr(c).encode()) for c in _PARTS if c < 0x800], np.uint32)
_PARTS_3 = np.array([int.from_bytes(chr(c).encode()) for c in _PARTS if c >= 0x800], np.uint32)


def parted(raw: np.ndarray) -> np.ndarray:
    """``raw`` (UTF-8) with blanks in place of what parts words beyond ASCII, byte for byte."""
    out = raw
    for low, high, size, codes in ((0xC2, 0xE0, 2, _PARTS_2), (0xE0, 0xF0, 3, _PARTS_3)):
        at = np.flatnonzero((raw >= low) & (raw < high))
        at = at[at + size <= len(raw)]
        code = np.zeros(len(at), np.uint32)
        for k in range(size):
            code = code << np.uint32(8) | raw[at + k]
        at = at[np.isin(code, codes)]
        if len(at):
            out = out.copy() if out is raw else out
            for k in range(size):
                out[at + k] = 0x20
    return out


class Words:
    """The words of a piece of texts: ``kind`` has each word's type, ``bounds`` where each text's words begin."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        raw = parted(raw)
        start, end = word_spans(raw, _LETTER)
        n = np.maximum(1, -(-(end - start - LETTERS) // PIECE_STRIDE) + 1)
        skip = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * PIECE_STRIDE
        start, last = np.repeat(start, n) + skip, np.repeat(end, n)
        end = np.minimum(start + LETTERS, last)
        hashes = span_hashes(raw, start, np.where(skip == 0, last, end))  # a first piece is known by its whole word
        self.bounds = np.searchsorted(start, bounds)
        self.hashes, first, self.kind = np.unique(hashes, return_index=True, return_inverse=True)
        self.kind = self.kind.reshape(-1)
        start, end = start[first], end[first]
        place = start[:, None].astype(np.int32) + np.arange(LETTERS, dtype=np.int32)
        self.letters = np.where(place < end[:, None], _LOWER[raw[np.minimum(place, len(raw) - 1)]], np.uint8(0))

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        """The words of all texts; what hashing a piece takes is free again before the next."""
        if not len(texts):
            return cls(np.full(1, 0x20, np.uint8), np.zeros(1, np.int64))
        parts = [cls(raw, bounds) for raw, bounds in pieces(pc.utf8_lower(texts))]
        self = cls.__new__(cls)
        self.hashes, first, types = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True, return_inverse=True)
        self.letters = np.concatenate([p.letters for p in parts])[first]
        ends = np.cumsum([len(p.hashes) for p in parts])
        self.kind = np.concatenate([types[e - len(p.hashes) : e][p.kind] for p, e in zip(parts, ends, strict=True)])
        before = np.cumsum([0, *(len(p.kind) for p in parts)])
        self.bounds = np.concatenate([[0], *(p.bounds[1:] + b for p, b in zip(parts, before[:-1], strict=True))])
        return self

    def buckets(self) -> np.ndarray:
        return (self.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(types, the bucket of each) for each place an n-gram may have."""
        for n, at in [(n, 0) for n in BEGINS] + [(n, at) for n in GRAMS for at in range(1, LETTERS - n + 1)]:
            types = np.flatnonzero(self.letters[:, at + n - 1])
            if len(types):
                code = np.full(len(types), n + (0 if at else 100), np.uint64)
                for k in range(at, at + n):
                    code = code * np.uint64(257) + self.letters[types, k]
                yield types, (mixed_bits(code) % np.uint64(GRAM_BUCKETS)).astype(np.int64)


class Vectors:
    """The learned vectors of words and n-grams."""

    def __init__(self, seed: int = 4):
        self.seed, self.rest = seed, 0.0
        rng = np.random.default_rng(seed)
        self.words = np.zeros((WORD_BUCKETS, WORD_INPUTS), np.float32)
        self.grams = rng.normal(0, 0.05, (GRAM_BUCKETS, GRAM_INPUTS)).astype(np.float32)

    @classmethod
    def before(cls, seed: int, rest: float) -> Vectors:
        """The vectors as they begin where no training text has their words; ``rest``: what the odds of those are."""
        self = cls(seed)
        self.rest = rest
        self.words[:, 0] = self.grams[:, 0] = rest
        return self

    def begin(self, words: Words, toxic: np.ndarray, clean: np.ndarray) -> None:
        """First values of a dimension of each table: log odds of the toxic documents; ``toxic``, ``clean``: in how many such
        documents each type occurs."""
        share = min(max(toxic.sum() / max(1.0, (toxic + clean).sum()), 1e-3), 0.999)

        def odds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (np.log((a + PRIOR * share) / (b + PRIOR * (1 - share))) - np.log(share / (1 - share))) / 3

        at = words.buckets()
        self.words[:, 0] = odds(np.bincount(at, toxic, WORD_BUCKETS), np.bincount(at, clean, WORD_BUCKETS))
        a, b = np.zeros(GRAM_BUCKETS), np.zeros(GRAM_BUCKETS)
        for types, code in words.grams():
            a += np.bincount(code, toxic[types], GRAM_BUCKETS)
            b += np.bincount(code, clean[types], GRAM_BUCKETS)
        self.grams[:, 0] = odds(a, b)
        free = np.flatnonzero(a + b == 0)
        self.rest = float(self.grams[free[0], 0]) if len(free) else 0.0

    def of(self, words: Words) -> np.ndarray:
        """The inputs of each word type."""
        pooled = np.full((len(words.hashes), GRAM_INPUTS), -np.inf, np.float32)
        for types, code in words.grams():
            pooled[types] = np.maximum(pooled[types], self.grams[code])
        pooled[np.isinf(pooled)] = 0  # a word too short for any n-gram
        return np.concatenate([self.words[words.buckets()], pooled], axis=1)


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and number of words of each window, and the first window of each text (and the end)."""
    sizes = np.diff(bounds)
    n = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    first = np.concatenate(([0], np.cumsum(n)))
    of = np.repeat(np.arange(len(sizes)), n)
    skip = (np.arange(first[-1]) - first[of]) * STRIDE
    return bounds[of] + skip, np.minimum(WINDOW, sizes[of] - skip), first


def tanh_(x: np.ndarray) -> np.ndarray:
    return np.tanh(x, out=x)


class Network:
    """Parameters by name in ``p``; all float32."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        near = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        d, h = INPUTS, HIDDEN
        self.p = {"v": near(2 * h, scale=0.3), "out": near(2 * h, scale=0.3), "bias": np.full(1, -1, np.float32)}
        for way in "fb":
            self.p |= {f"w{way}": near(d, 3 * h, scale=d**-0.5), f"u{way}": near(h, 3 * h, scale=h**-0.5), f"c{way}": np.zeros(3 * h, np.float32)}

    def _read(self, x: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """The states (steps, windows, HIDDEN) over projected inputs x (steps, windows, 3 HIDDEN)."""
        h, u = HIDDEN, self.p[f"u{way}"]
        states = np.zeros((len(x) + 1, x.shape[1], h), np.float32)
        for t in range(len(x)):
            old = states[t]
            a = old @ u
            zr = tanh_((x[t, :, : 2 * h] + a[:, : 2 * h]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            new = tanh_(x[t, :, 2 * h :] + zr[:, h:] * a[:, 2 * h :])
            states[t + 1] = new + zr[:, :h] * (old - new)
            if keep is not None:
                keep.append((zr, new, a[:, 2 * h :]))
        return states

    def forward(self, x: np.ndarray, kind: np.ndarray, there: np.ndarray, back: dict | None = None) -> np.ndarray:
        """Logits of windows: x has an input row per type and a last one of zeros; kind (steps, windows) indexes it."""
        kept = {"f": [], "b": []} if back is not None else {"f": None, "b": None}
        ways = {}
        for way in "fb":
            projected = x @ self.p[f"w{way}"] + self.p[f"c{way}"]
            ways[way] = self._read(projected[kind if way == "f" else kind[::-1]], way, kept[way])
        both = np.concatenate([ways["f"][1:], ways["b"][:0:-1]], axis=2)
        heat = both @ self.p["v"]
        heat = np.where(there, heat, np.float32(-30))
        heat = np.exp(heat - heat.max(0))
        heat /= heat.sum(0)
        pooled = np.einsum("tb,tbh->bh", heat, both)
        if back is not None:
            back |= {"ways": ways, "kept": kept, "both": both, "heat": heat, "pooled": pooled, "x": x, "kind": kind}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def backward(self, back: dict, d: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients by name and those of the inputs for d, that of the logits."""
        h, g, d_inputs = HIDDEN, {}, np.zeros_like(back["x"])
        both, heat = back["both"], back["heat"]
        g["out"], g["bias"] = back["pooled"].T @ d, d.sum(keepdims=True)
        d_pooled = d[:, None] * self.p["out"]
        d_both = heat[..., None] * d_pooled
        d_heat = np.einsum("tbh,bh->tb", both, d_pooled)
        d_heat = heat * (d_heat - (heat * d_heat).sum(0))
        g["v"] = np.einsum("tb,tbh->h", d_heat, both)
        d_both = d_both + d_heat[..., None] * self.p["v"]
        for way in "fb":
            kind = back["kind"] if way == "f" else back["kind"][::-1]
            own = d_both[..., :h] if way == "f" else d_both[::-1, :, h:]
            states, kept, u = back["ways"][way], back["kept"][way], self.p[f"u{way}"]
            d_x, g_u = np.zeros((*kind.shape, 3 * h), np.float32), np.zeros_like(u)
            later = np.zeros_like(states[0])
            for t in range(len(kind) - 1, -1, -1):
                (zr, new, lin), old = kept[t], states[t]
                z, r = zr[:, :h], zr[:, h:]
                later = later + own[t]
                d_new = later * (1 - z) * (1 - new * new)
                d_z = later * (old - new) * z * (1 - z)
                d_r = d_new * lin * r * (1 - r)
                d_x[t] = np.concatenate([d_z, d_r, d_new], axis=1)
                d_a = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g_u += old.T @ d_a
                later = later * z + d_a @ u.T
            g[f"u{way}"], g[f"c{way}"] = g_u, d_x.sum((0, 1))
            flat_x, flat_kind = d_x.reshape(-1, 3 * h), kind.reshape(-1)
            g[f"w{way}"] = back["x"][flat_kind].T @ flat_x
            np.add.at(d_inputs, flat_kind, flat_x @ self.p[f"w{way}"].T)
        return g, d_inputs


def laid_out(words: Words, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Types (steps, windows), the type after the last for places without a word, and which places have one."""
    step = np.arange(WINDOW)[:, None]
    there = step < size
    place = np.where(there, start + step, 0)
    return np.where(there, words.kind[place] if len(words.kind) else 0, len(words.hashes)), there


def logits(network: Network, x: np.ndarray, words: Words) -> np.ndarray:
    """The logit of each text of ``words``: its highest window's."""
    start, size, first = windows(words.bounds)
    x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
    out = np.empty(len(start), np.float32)
    for i in range(0, len(start), 1024):
        out[i : i + 1024] = network.forward(x, *laid_out(words, start[i : i + 1024], size[i : i + 1024]))
    return np.maximum.reduceat(out, first[:-1]) if len(first) > 1 else out


class Model:
    def __init__(self, network: Network, vectors: Vectors):
        self.network, self.vectors = network, vectors

    def arrays(self) -> dict[str, np.ndarray]:
        """All values by name."""
        return self.network.p | {"words": self.vectors.words, "grams": self.vectors.grams}

    def packed(self) -> dict[str, np.ndarray]:
        """What makes the same model anew, by name: of the vectors, the bits that training has changed, compressed."""
        out = self.network.p | {"seed": np.array([self.vectors.seed], np.int32), "rest": np.array([self.vectors.rest], np.float32)}
        before = Vectors.before(self.vectors.seed, self.vectors.rest)
        for name in ("words", "grams"):
            bits = getattr(self.vectors, name).view(np.uint32) ^ getattr(before, name).view(np.uint32)
            out[name] = np.frombuffer(zlib.compress(bits.tobytes()), np.uint8)
        return out

    @classmethod
    def of(cls, found: dict[str, np.ndarray]) -> Model:
        """The model that was :meth:`packed`; of nothing, one that learned nothing."""
        if not found:
            return trained(pa.array([], pa.large_string()), np.zeros(0, int), np.zeros(0))
        self = cls(Network(), Vectors.before(int(found["seed"][0]), float(found["rest"][0])))
        self.network.p = {k: found[k] for k in self.network.p}
        for name in ("words", "grams"):
            bits = getattr(self.vectors, name).view(np.uint32)
            bits ^= np.frombuffer(zlib.decompress(found[name].tobytes()), np.uint32).reshape(bits.shape)
        return self

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        for raw, bounds in pieces(pc.utf8_lower(texts)):
            words = Words(raw, bounds)
            out.append(logits(self.network, self.vectors.of(words), words))
        return 1 / (1 + np.exp(-np.concatenate(out).astype(np.float64))) if out else np.zeros(0)


class Steps:
    """Adam over arrays by name."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays, self.n = arrays, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in arrays.items()}

    def take(self, slopes: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        for k, v in self.arrays.items():
            m, s = self.moments[k]
            m += 0.1 * (slopes[k] - m)
            s += 0.01 * (slopes[k] * slopes[k] - s)
            v -= rate * (m / (1 - 0.9**self.n)) / (np.sqrt(s / (1 - 0.99**self.n)) + (1e-8 if k not in ("words", "grams") else STEADY))


class Batch:
    """The word types of some windows and where their vectors come from."""

    def __init__(self, kinds: np.ndarray, words: Words, grams: np.ndarray):
        """grams: buckets of every type of ``words``, GRAM_BUCKETS for none."""
        used, self.kinds = np.unique(kinds, return_inverse=True)
        self.kinds = self.kinds.reshape(kinds.shape)
        self.real = used < len(words.hashes)
        self.words, self.grams = words.buckets()[used[self.real]], grams[used[self.real]]

    def inputs(self, vectors: Vectors, known: np.ndarray) -> np.ndarray:
        """Inputs of the types; ``known``: types whose word vector counts."""
        self.known = known[:, None]
        pooled = np.full((len(self.grams), GRAM_INPUTS), -np.inf, np.float32)
        for place in range(self.grams.shape[1]):
            some = np.flatnonzero(self.grams[:, place] < GRAM_BUCKETS)
            pooled[some] = np.maximum(pooled[some], vectors.grams[self.grams[some, place]])
        out = np.zeros((len(self.real), INPUTS), np.float32)
        out[self.real, :WORD_INPUTS] = vectors.words[self.words] * self.known
        out[self.real, WORD_INPUTS:] = np.where(np.isinf(pooled), 0, pooled)
        return out

    def slopes(self, vectors: Vectors, d: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of both tables of vectors from those of the inputs; of the n-grams, the largest one's."""
        own = d[self.real]
        words, grams = np.zeros_like(vectors.words), np.zeros_like(vectors.grams)
        np.add.at(words, self.words, own[:, :WORD_INPUTS] * self.known)
        some = np.flatnonzero(own[:, WORD_INPUTS:].any(1) & (self.grams < GRAM_BUCKETS).any(1))
        codes = self.grams[some]
        each = np.where((codes < GRAM_BUCKETS)[..., None], vectors.grams[np.minimum(codes, GRAM_BUCKETS - 1)], -np.inf)
        largest = np.take_along_axis(codes, each.argmax(1), 1)
        np.add.at(grams, (largest, np.arange(GRAM_INPUTS)), own[some, WORD_INPUTS:])
        return {"words": words, "grams": grams}


def trained(texts: pa.Array, toxic: np.ndarray, weight: np.ndarray, seed: int = 3) -> Model:
    """A model of labelled texts. A document's loss is that of its highest window."""
    rng = np.random.default_rng(seed)
    words = Words.of(texts)
    n = len(texts)
    found = list(words.grams())
    grams = np.full((len(words.hashes), max(1, len(found))), GRAM_BUCKETS, np.int32)
    for place, (types, code) in enumerate(found):
        grams[types, place] = code
    network, vectors = Network(seed), Vectors(seed)
    of = np.repeat(np.arange(n), np.diff(words.bounds))
    seen, kind = np.divmod(np.unique(of.astype(np.int64) * len(words.hashes) + words.kind), max(1, len(words.hashes)))
    vectors.begin(words, *(np.bincount(kind[toxic[seen] == label], minlength=len(words.hashes)).astype(float) for label in (1, 0)))
    del found, of, seen, kind  # what only prepares is not held through training
    steps = Steps(network.p | {"words": vectors.words, "grams": vectors.grams})
    start, size, first = windows(words.bounds)
    highest = first[:-1].copy()
    epochs = max(EPOCHS, -(-STEPS // -(-n // BATCH))) if n else 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        for low in range(0, n, BATCH):
            docs = order[low : low + BATCH]
            if epoch % LOOKS == 0:
                own = np.concatenate([np.arange(first[i], first[i + 1]) for i in docs])
                mine = np.concatenate(([0], np.cumsum(first[docs + 1] - first[docs])))
                kinds, there = laid_out(words, start[own], size[own])
                batch = Batch(kinds, words, grams)
                inputs = batch.inputs(vectors, np.ones(len(batch.words), bool))
                heights = np.concatenate([network.forward(inputs, batch.kinds[:, i : i + 4096], there[:, i : i + 4096]) for i in range(0, len(own), 4096)])
                highest[docs] = [own[a + np.argmax(heights[a:b])] for a, b in zip(mine[:-1], mine[1:], strict=True)]
            kinds, there = laid_out(words, start[highest[docs]], size[highest[docs]])
            batch = Batch(kinds, words, grams)
            inputs = batch.inputs(vectors, rng.random(len(batch.words)) >= DROPPED)
            back: dict = {}
            score = network.forward(inputs, batch.kinds, there, back)
            d = (1 / (1 + np.exp(-score)) - toxic[docs]) * weight[docs] / len(docs)
            slopes, d_inputs = network.backward(back, d.astype(np.float32))
            slopes = {k: g + 1e-4 * network.p[k] for k, g in slopes.items()} | batch.slopes(vectors, d_inputs)
            steps.take(slopes, RATE * (1 - epoch / epochs))
    return Model(network, vectors)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, weight) of the training sample: no held-out, null or contradictory label, chosen by hash."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    known = known.where("toxic = most and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    most = {1: TRAIN_TOXIC, 0: TRAIN_CLEAN}
    share = {k: min(1.0, most[k] / n.get(k, 1)) for k in most}
    at = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    some = known.where(at < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    weight = F.when(F.col("toxic") == 1, min(4.0, 1 / share[1])).otherwise(min(4.0, 1 / share[0])).alias("weight")
    some = some.orderBy(at).limit(2 * (TRAIN_TOXIC + TRAIN_CLEAN))  # a bound on the broadcast, not reached
    texts = docs.where(F.length("text") <= TRAIN_CHARS).select("doc_id", "text")
    return texts.join(F.broadcast(some), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), weight)


def learned(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """A model, packed, of a bounded sample of the labelled documents that aren't held out; rows in an order of their own, so
    that a model does not depend on how the tables are split. The sample is read and the model trained in a task: of both
    only the packed model comes to the driver. Without any usable label it has nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            rows = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("text", "ascending")])
            texts = rows.column("text").combine_chunks().cast(pa.large_string())
            found = trained(texts, rows.column("toxic").to_numpy(), rows.column("weight").to_numpy()).packed()
            for name, values in found.items():
                columns = {"name": [name], "kind": [values.dtype.str], "shape": pa.array([values.shape], pa.list_(pa.int32())), "data": pa.array([values.tobytes()], pa.binary())}
                yield pa.RecordBatch.from_pydict(columns)

    made = sample(docs, labels).repartition(1).mapInArrow(run, "name string, kind string, shape array<int>, data binary").collect()
    return {r["name"]: np.frombuffer(bytes(r["data"]), r["kind"]).reshape(r["shape"]) for r in made}


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of :func:`learned`, made in the driver."""
    return Model.of(learned(docs, labels))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs`` with score (0 to 1, higher: toxic likelier) and predicted (1 from 0.5 on).

    Labels (doc_id, toxic) serve only to fit the model. Null and empty texts are one window without words. Without any
    usable label the network is untrained and nothing is predicted toxic. All columns stay; ones named score or
    predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    shared = Shipped(docs.sparkSession.sparkContext, learned(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(shared.open())
        for batch in batches:
            score = model.scores(batch.column(at))
            columns = [*batch.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`scored` predicts not to be toxic, with their columns as they are, whatever their
    names. Null and empty texts stay; an empty table gives no rows; rows repeated stay or go together."""
    shared = Shipped(docs.sparkSession.sparkContext, learned(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(shared.open())
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
