"""Benchmark decontamination with a generalised suffix automaton of the benchmark's items.

The automaton is built on the driver from the items (a bounded block of their words at a time) and shipped to the
executors. Every document streams through it word by word; from the longest match that ends at a word follows which
windows of which items end there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from leafgraph.llm.shipping import Shipped

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}
#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Item words in one automaton: some 500 bytes each on the driver and in each worker. A larger benchmark takes several
#: automata, loaded one after the other for some BLOCK_BYTES of documents.
BLOCK_WORDS, BLOCK_BYTES = 200_000, 1 << 25
#: A document with a larger share of hit words is dropped whole by :func:`cleaned`.
MAX_COVERAGE = 0.5


def lowered(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(UPPER)


def words(text: str | None) -> list[str]:
    """A-Z lower-cased; runs of digits, letters and whatever is not ASCII."""
    return WORD.findall(lowered(text)) if text else []


class Automaton:
    """A generalised suffix automaton over the words of (item, words) pairs.

    ``step[s]`` maps a word to the next state, ``length[s]`` is the length of the longest string of s, ``link[s]`` its
    suffix link. ``windows[s]`` has the items of the window that ends a match in s of at least a window's length;
    ``short[s]`` lists (words, items) of items below a window's length that end such a match: the first may be of
    length[s] itself and then needs a match as long.
    """

    def __init__(self, items: Iterable[tuple[object, list[str]]], window: int = WINDOW):
        items = [(item, seq) for item, seq in items if seq]
        self.window = window
        self.step: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, seq in items:
            state = 0
            for word in seq:
                state = self._extended(state, word)
        full: dict[int, set] = {}
        whole: dict[int, set] = {}
        for item, seq in items:
            for i in range(max(1, len(seq) - window + 1)):
                (full if len(seq) >= window else whole).setdefault(self._walked(seq[i : i + window]), set()).add(item)
        self.windows: list[tuple] = [()] * len(self.step)
        self.short: list[tuple] = [()] * len(self.step)
        for s in sorted(range(1, len(self.step)), key=self.length.__getitem__):  # links first
            up = self.link[s]
            if self.length[s] >= window:
                self.windows[s] = tuple(full[s]) if self.length[up] < window else self.windows[up]
            own = ((self.length[s], tuple(whole[s])),) if s in whole else ()
            self.short[s] = own + self.short[up]

    def _walked(self, seq: list[str]) -> int:
        state = 0
        for word in seq:
            state = self.step[state][word]
        return state

    def _state(self, step: dict[str, int], length: int, link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, p: int, word: str, q: int) -> int:
        """The state of p's longest string and word, taken out of q where q has longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(dict(self.step[q]), self.length[p] + 1, self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        return clone

    def _extended(self, last: int, word: str) -> int:
        if word in self.step[last]:
            return self._split(last, word, self.step[last][word])
        new, p = self._state({}, self.length[last] + 1, 0), last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, self.step[p][word])
        return new

    def matches(self, seq: list[str]) -> list[tuple[int, int, tuple]]:
        """(start, end, items) of each occurrence of a window, by end."""
        found = []
        step, link, length, windows, short, window = self.step, self.link, self.length, self.windows, self.short, self.window
        state = n = 0
        for i, word in enumerate(seq):
            to = step[state].get(word)
            if to is None:
                while to is None and state:
                    state = link[state]
                    to = step[state].get(word)
                if to is None:
                    n = 0
                    continue
                n = length[state]
            state = to
            n += 1
            if n >= window:
                found.append((i + 1 - window, i + 1, windows[state]))
            if short[state]:
                found += [(i + 1 - m, i + 1, items) for m, items in short[state] if m <= n]
        return found


def blocks(items: Iterator[tuple[object, str | None]], window: int, size: int) -> Iterator[Automaton]:
    """Automata of at most ``size`` item words; a longer item is cut, its pieces overlapping by a window less one word."""
    held: list[tuple[object, list[str]]] = []
    n = 0
    for item, text in items:
        seq = words(text)
        for i in range(0, max(1, len(seq) - window + 1), size):
            piece = seq[i : i + size + window - 1]
            if held and n + len(piece) > size:
                yield Automaton(held, window)
                held, n = [], 0
            held.append((item, piece))
            n += len(piece)
    if held:
        yield Automaton(held, window)


def shipped(items: DataFrame, window: int, size: int) -> list[Shipped]:
    context = items.sparkSession.sparkContext
    rows = ((r[0], r[1]) for r in items.select("item_id", "text").toLocalIterator())
    return [Shipped(context, a) for a in blocks(rows, window, size)]


def gathered(batches: Iterator[pa.RecordBatch], automata: int) -> Iterator[pa.RecordBatch]:
    """The batches; where there are several automata, joined to some BLOCK_BYTES, so that each is loaded once for these."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if automata < 2:
            yield batch
            continue
        held.append(batch)
        if sum(b.nbytes for b in held) >= BLOCK_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def each(shared: list[Shipped], one: Automaton | None, texts: list[str | None]) -> Iterator[tuple[list[str], list[tuple[int, int, tuple]]]]:
    """Words and matches of each text; ``one``: the only automaton, if there is only one."""
    if one:
        for text in texts:
            seq = words(text)
            yield seq, one.matches(seq)
        return
    found: list[list] = [[] for _ in texts]
    for block in shared:  # one automaton in memory at a time
        automaton = block.open()
        for text, out in zip(texts, found, strict=True):
            out += automaton.matches(words(text))
    for text, out in zip(texts, found, strict=True):
        yield words(text), out


def marked(n: int, found: list[tuple[int, int, tuple]]) -> bytearray:
    hit = bytearray(n)
    for start, end, _ in found:
        hit[start:end] = b"\x01" * (end - start)
    return hit


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What ``items`` (item_id, text) each document (doc_id, text) holds, a row per input row:

    doc_id, n_words, n_hit (words inside any occurrence of a window), n_items (items with occurring windows),
    items_sha256 (those item_ids as sorted strings, comma-joined), contaminated (n_hit > 0), longest (words of the
    longest hit span). Null or wordless texts have 0 words; null and wordless items have no window; rows repeated in
    either table count as they are, items by their id (null as an empty string). Other columns are not looked at.
    """
    shared = shipped(items, window, block_words)
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared[0].open() if len(shared) == 1 else None
        for batch in gathered(batches, len(shared)):
            rows = []
            for seq, found in each(shared, one, batch.column(1).to_pylist()):
                if not found:
                    rows.append((len(seq), 0, 0, empty, False, 0))
                    continue
                ids = sorted({"" if x is None else str(x) for _, _, held in found for x in held})
                hit = marked(len(seq), found)
                runs = max(map(len, bytes(hit).split(b"\x00")))
                rows.append((len(seq), sum(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), True, runs))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def cut(text: str, hit: bytearray) -> str:
    """The text without its hit spans, from the first word of a span to the end of its last."""
    out, at, inside = [], 0, False
    for found, h in zip(WORD.finditer(lowered(text)), hit, strict=True):
        if h and not inside:
            out.append(text[at : found.start()])
        if h:
            at = found.end()
        inside = bool(h)
    out.append(text[at:])
    return "".join(out)


def cleaned(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The documents with all hit spans cut from their texts; those of which more than ``max_coverage`` of the words are
    hit are dropped. Untouched documents, null and empty texts among them, stay as they are. All columns stay; n_chars,
    if there is one, follows a text that was cut."""
    shared = shipped(items, window, block_words)
    names = docs.columns
    at = names.index("text")
    size = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared[0].open() if len(shared) == 1 else None
        for batch in gathered(batches, len(shared)):
            texts = batch.column(at).to_pylist()
            keep, changed = [True] * len(texts), {}
            for i, (seq, found) in enumerate(each(shared, one, texts)):
                if found:
                    hit = marked(len(seq), found)
                    keep[i] = sum(hit) <= max_coverage * len(seq)
                    changed[i] = cut(texts[i], hit) if keep[i] else ""
            if changed:
                columns = batch.columns
                columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], batch.schema.field(at).type)
                if size is not None:
                    counts = batch.column(size).to_pylist()
                    columns[size] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(counts)], batch.schema.field(size).type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))
            yield batch

    return docs.mapInArrow(run, docs.schema)
