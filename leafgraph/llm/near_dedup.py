"""MinHash near-dedup with an LSH forest.

1. One pass over the texts makes each document's shingle set, its digest and a MinHash signature. Documents with equal
   sets are one from here on: the one with the smallest doc_id stands for all.
2. The signature is read in TREES orders, each beginning with DEPTH minima of its own. In each sorted order, runs of
   documents whose longest common prefix has DEPTH minima or more are neighbours, however many they are.
3. In each run the document with the most neighbours over all orders leads. The runs of one leader form a region;
   every document of a region is held against the leader on full shingle sets, those that don't link with it (or with
   one that does) against all of the region, in blocks, also on full sets. So all links within a run are found, and
   no more pairs are formed than its documents, blocks aside.
4. The links that hold a region's groups together are edges; components come from them.

A pair of similarity 0.8 shares no run with probability (1 - 0.8^5)^32 = 3e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.graph import components
from leafgraph.llm.shingles import MinHash, shingle_sets
from leafgraph.llm.skew import met
from leafgraph.session import written

WORDS = 4
#: Sets are linked with 100 * intersection >= PERCENT * union.
PERCENT = 80
TREES, DEPTH = 32, 5
#: A run of more documents is dense. It is held whole like any other; no result depends on this number.
RUN = 2048
#: A region is dealt out in blocks of about so many documents and bytes.
BLOCK, BLOCK_BYTES = 512, 8_000_000


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the set), bytes, signature; the latter is null for an empty set."""
    hashes = MinHash(TREES * DEPTH)
    weights = np.random.default_rng(11).integers(1, 2**63, 2, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, signatures = [], [], []
            for found in shingle_sets(batch.column(1), words):
                n.append(len(found))
                if len(found):
                    turned = found * weights[0]
                    ids.append(found.sum().tobytes() + ((turned ^ (turned >> np.uint64(29))) * weights[1]).sum().tobytes())
                    signatures.append(hashes(found).tobytes())
                else:
                    ids.append(None)
                    signatures.append(None)
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), size, pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_id", "bytes", "signature"])

    schema = "doc_id long, n_shingles long, set_id binary, bytes long, signature binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def runs(reps: DataFrame) -> DataFrame:
    """(run, doc_id, size) of the runs with two documents or more of the forest over ``reps`` (doc_id, signature)."""

    def order(tree: int):
        return F.xxhash64(F.lit(tree), F.lit(DEPTH), F.substring("signature", 4 * DEPTH * tree + 1, 4 * DEPTH))

    rows = reps.select("doc_id", F.explode(F.array(*[order(t) for t in range(TREES)])).alias("run"))
    sizes = rows.groupBy("run").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return written(met(rows, sizes, "run", F.col("size"), reps.count() * TREES), "runs").select("run", "doc_id", "size")


def regions(found: DataFrame) -> DataFrame:
    """(hub, doc_id), each once: the leaders of each document's runs; a leader is in its own region."""
    score = found.groupBy("doc_id").agg(F.sum("size").alias("score"))
    scored = found.join(score, "doc_id")
    lead = scored.groupBy("run").agg(F.max(F.struct("score", F.bitwise_not("doc_id").alias("behind"))).alias("lead"), F.count(F.lit(1)).alias("n"))
    lead = lead.select("run", F.bitwise_not("lead.behind").alias("hub"), "n")
    return met(found, lead, "run", F.col("n"), found.count()).select("hub", "doc_id").distinct()


class Region:
    """Links among the sets of one block of a region, exact."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        _, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        shared = times[inverse] > 1  # what only one set has can't be in an intersection
        _, column = np.unique(inverse[shared], return_inverse=True)
        self.owner, self.column = owner[shared], column.reshape(-1)
        self.width = int(self.column.max()) + 1 if len(self.column) else 0
        self.starts = np.searchsorted(self.owner, np.arange(len(sets) + 1))

    def links(self, rows: np.ndarray) -> np.ndarray:
        """Row by row of ``rows``, whether it links with each set."""
        common = np.zeros((len(rows), len(self.sizes)), np.int64)
        for i, r in enumerate(rows):
            mine = np.zeros(self.width, bool)
            mine[self.column[self.starts[r] : self.starts[r + 1]]] = True
            common[i] = np.bincount(self.owner[mine[self.column]], minlength=len(self.sizes))
        union = self.sizes[rows, None] + self.sizes[None, :] - common
        return 100 * common >= PERCENT * union


def joined(ids: list[int], sets: list[np.ndarray], queries: list[int] | None = None) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges that connect all that links connect, and the places not connected with place 0.

    ``queries``: the places to hold against all others; None: 0, then whichever is not connected with it.
    """
    region = Region(sets)
    root = np.arange(len(sets))
    edges = []

    def hang(place: int, linked: np.ndarray) -> None:
        for j in np.flatnonzero(linked & (root != root[place])):
            if root[j] != root[place]:
                edges.append((ids[place], ids[j]))
                root[root == root[j]] = root[place]

    if queries is None:
        hang(0, region.links(np.array([0]))[0])
        queries = [int(i) for i in np.flatnonzero(root != root[0])]
    for start in range(0, len(queries), 64):
        part = np.array(queries[start : start + 64])
        for place, linked in zip(part, region.links(part), strict=True):
            hang(int(place), linked)
    return edges, [int(i) for i in np.flatnonzero(root != root[0])]


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with equal first ``keys`` columns of a sorted stream."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            key = tuple(int(c[a]) for c in columns)
            if held and key != last:
                yield last, held
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, held


def edges_of(held: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Edges (a, b) among the documents of each region of ``held`` (hub, doc_id, bytes)."""
    needed = held.select(F.col("doc_id").alias("needed")).distinct()
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(needed.hint("merge"), F.col("id") == F.col("needed"), "left_semi")
    texts = written(texts, "texts")  # the texts are shuffled once as a whole, then only those of regions
    sizes = held.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total"))
    sizes = sizes.select("hub", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_BYTES)).cast("int").alias("blocks"), "n")
    total = held.count()
    placed = written(
        met(held.where("hub <> doc_id"), sizes, "hub", F.col("n"), total).select(
            "hub", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int").alias("block"), "doc_id", "blocks", "n"
        ),
        "blocks",
    )
    leaders = placed.select("hub", "block", "blocks", "n").distinct().select("hub", "block", F.col("hub").alias("doc_id"), "blocks", "n")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, hubs, rest = [], [], [], []
        for (hub, _, blocks), parts in grouped(batches, 3):
            rows = pa.Table.from_batches(parts)
            ids = rows.column("doc_id").to_pylist()
            sets = list(shingle_sets(rows.column("text").combine_chunks(), words))
            lead = ids.index(hub)
            order = [lead, *(i for i in range(len(ids)) if i != lead)]
            edges, away = joined([ids[i] for i in order], [sets[i] for i in order])
            a += [e[0] for e in edges]
            b += [e[1] for e in edges]
            if blocks > 1:
                hubs += [hub] * len(away)
                rest += [ids[order[i]] for i in away]
            if len(a) + len(rest) > 10_000:
                yield packed(a, b, hubs, rest)
                a, b, hubs, rest = [], [], [], []
        yield packed(a, b, hubs, rest)

    def packed(a: list, b: list, hubs: list, rest: list) -> pa.RecordBatch:
        none = [None] * len(rest)
        columns = [a + none, b + none, [None] * len(a) + hubs, [None] * len(a) + rest]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "hub", "doc_id"])

    def with_text(rows: DataFrame, *keys: str) -> DataFrame:
        met = rows.join(texts.hint("merge"), F.col("doc_id") == F.col("id")).drop("id")
        return met.repartition(*keys).sortWithinPartitions(*keys, "doc_id")

    rows = with_text(placed.unionByName(leaders), "hub", "block")
    first = written(rows.select("hub", "block", "blocks", "doc_id", "text").mapInArrow(check, "a long, b long, hub long, doc_id long"), "edges")
    edges = first.where("a is not null").select("a", "b")
    lone = first.where("hub is not null").select("hub", "doc_id")
    if lone.isEmpty():
        return edges

    # regions of several blocks: what did not connect in its block is held, in chunks, against every block
    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in grouped(batches, 3):
            rows = pa.Table.from_batches(parts)
            ids, asks = rows.column("doc_id").to_pylist(), rows.column("asks").to_pylist()
            if len(set(asks)) == 2:
                sets = list(shingle_sets(rows.column("text").combine_chunks(), words))
                edges, _ = joined(ids, sets, [i for i, x in enumerate(asks) if x])
                yield packed([e[0] for e in edges], [e[1] for e in edges], [], [])

    per = lone.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
    blocks = placed.select("hub", "blocks", "n").distinct().join(per, "hub")
    asking = met(lone, blocks, "hub", F.col("n"), total).select(
        "hub", F.pmod(F.xxhash64("doc_id", F.lit(1)), "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "doc_id", F.lit(True).alias("asks")
    )
    asked = met(placed.drop("blocks", "n"), blocks, "hub", F.col("n"), total).select("hub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "block", "doc_id", F.lit(False).alias("asks"))
    rows = with_text(asking.unionByName(asked), "hub", "chunk", "block")
    more = rows.select("hub", "chunk", "block", "doc_id", "asks", "text").mapInArrow(across, "a long, b long, hub long, doc_id long")
    return edges.unionByName(more.select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id), a row per
    input row of ``docs`` (doc_id, text).

    Words are runs of other than blanks, A-Z lower-cased; a text of fewer than ``words`` words is one shingle; null and
    wordless texts have no shingle and link with nothing. Rows repeated with one doc_id are one document, linked if
    any of its texts is. Rows without a doc_id link with nothing, have no component_id and are kept. An empty table
    gives no rows; other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(signed(docs, words), "signatures")
    linkable = rows.where("set_id is not null and doc_id is not null")
    best = F.min(F.struct("doc_id", "bytes", "signature")).alias("rep")
    sets = written(linkable.groupBy("set_id").agg(best, F.count(F.lit(1)).alias("copies")).select("set_id", "rep.*", "copies"), "sets")
    found = regions(runs(sets.select("doc_id", "signature")))
    held = written(found.join(sets.groupBy("doc_id").agg(F.sum("bytes").alias("bytes")), "doc_id").select("hub", "doc_id", "bytes"), "regions")
    repeated = written(linkable.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        edges = edges_of(held, docs, words)
    else:  # each text of a document once, and what its several sets connect
        texts = docs.join(repeated, "doc_id", "left_anti").unionByName(docs.join(repeated, "doc_id", "left_semi").distinct())
        reps = sets.select("set_id", F.col("doc_id").alias("b"))
        own = linkable.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), "set_id").distinct()
        edges = edges_of(held, texts, words).unionByName(own.join(reps, "set_id").select("a", "b"))
    found = components(edges)
    final = written(
        sets.join(found, F.col("doc_id") == F.col("node"), "left").select("set_id", F.coalesce("component", "doc_id").alias("component_id"), "copies"),
        "components",
    )
    base = rows.select("doc_id", "n_shingles", "set_id")
    some = base.where("set_id is not null and doc_id is not null")
    none = base.where("set_id is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = met(some, final, "set_id", F.col("copies"), rows.count()).select("doc_id", "n_shingles", "component_id").unionByName(none)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def unique_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns."""
    kept = near_duplicates(docs, words).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    found = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return found.join(kept, F.col("id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")
