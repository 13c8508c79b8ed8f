"""License scans with MinHash bands over overlapping windows and exact shingle containment. DataFrame functions only.

A template of m shingles belongs to the size class S, the next power of two: it is found where one of the windows of 2 S
shingles that begin at every S-th holds 0.8 of it; any run of m shingles lies in such a window whole. The windows that
retrieve are wider, so that few classes do for all templates: 4 N shingles, the next beginning 3 N on, N the next of NETS
from 2 S on; each window of a template's own class lies in one of these whole.

A window's bands are the minima of one permutation: its hashes are dealt to as many bins as N has, by their leading
bits, and the least of each bin is a band. Windows meet templates in a join on N and band; nothing else brings them
together. A window holds at least 0.8 m shingles of a template that it is to retrieve, in bins with 4 N / bins others on
average at most; the least of a bin is one of them, and the same as the template's, with probability (1 - exp(-x)) / x for x = 4 N /
bins. :func:`bins` takes as many bins as make the chance that all fail less than MISS. What a window retrieves is then
checked on full shingle sets, in the windows of the template's own class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.licenses import TEMPLATES  # noqa: F401  (part of this module's interface)
from leafgraph.session import written

WORDS = 5
#: Least containment, as a fraction of whole numbers: shared * PART >= total * LEAST.
LEAST, PART = 4, 5
#: Chance at most that a window which holds 0.8 of a template has no band in common with it; and the least bins.
MISS, LEAST_BINS = 1e-5, 64
#: Bands of templates up to this many go to the tasks as a set; beyond, bands of windows are shuffled to them.
LISTED_BANDS = 20_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Sizes N of the windows that retrieve; the smallest takes all templates of half of it or less, a larger one those above an eighth.
NETS = [16 * 4**k for k in range(10)]


def shingles(text: Column) -> Column:
    """64-bit hashes of the runs of WORDS lower-cased words, in order; none in a text of fewer words or null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))

    def hashed(words: Column) -> Column:
        at = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)])
        return F.transform(F.sequence(F.lit(0), F.size(words) - WORDS), at)

    # the one-element array binds the words, which are used more than once, to a name
    return F.element_at(
        F.transform(F.array(found), lambda w: F.when(F.size(w) >= WORDS, hashed(w)).otherwise(F.expr("cast(array() as array<bigint>)"))), 1
    )


def bins(net: int) -> int:
    """Bins, a power of two, for windows of 4 ``net`` shingles."""
    held = math.ceil(LEAST * (net // 8 + 1) / PART) if net > NETS[0] else 1
    n = LEAST_BINS
    while True:
        x = 4 * net / n
        if (1 + math.expm1(-x) / x) ** held < MISS:
            return n
        n *= 2


def bands(window: Column, net: int) -> Column:
    """The least hash of each bin of a window that has any."""
    bin_ = lambda x: F.shiftright(x, 64 - bins(net).bit_length() + 1)
    # in a sorted window these are the first of each run of one bin
    firsts = lambda x, i, all_: (i == 0) | (bin_(x) != bin_(F.get(all_, i - 1)))
    return F.element_at(F.transform(F.array(F.sort_array(window)), lambda w: F.filter(w, lambda x, i: firsts(x, i, w))), 1)


def classed(templates: DataFrame) -> DataFrame:
    """license, shingles (distinct), total, class and net of each template."""
    sets = templates.select("license", F.array_distinct(shingles(F.col("text"))).alias("shingles")).withColumn("total", F.size("shingles"))
    return sets.where("total > 0").withColumn("class", F.expr("cast(pow(2, ceil(log2(total))) as int)")).withColumn(
        "net", F.array_min(F.filter(F.array(*map(F.lit, NETS)), lambda n: n >= 2 * F.col("class")))
    )


def windows(hashes: Column, net: int, known: list[int] | None = None) -> Column:
    """Structs net, k, bands of all windows of 4 ``net`` shingles; the last one is the first that reaches the end. ``known``: the
    bands of templates, where they are few; then only these bands of windows, and only windows that have any."""
    last = F.greatest(F.ceil((F.size(hashes) - 4 * net) / (3 * net)).cast("int"), F.lit(0))
    cut = lambda k: bands(F.slice(hashes, 3 * net * k + 1, F.lit(4 * net)), net)
    met = lambda k: cut(k) if known is None else F.filter(cut(k), lambda band: band.isin(known))
    found = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.lit(net).alias("net"), k.alias("k"), met(k).alias("bands")))
    return found if known is None else F.filter(found, lambda w: F.size(w["bands"]) > 0)


def scanned(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """A row for each license found in each document: doc_id, license, shared and total (distinct shingles of the template, and
    how many of them the best window holds; 0.8 of them at least), first_word (of the first best window, from 0).

    ``docs``: doc_id, text; ``templates``: license, text. Null texts and ones below WORDS words have no license; nor
    can such templates be found, which raises ValueError (null ones are left out). Rows repeated with one doc_id are one
    document. Templates repeated with one name are alternatives. Empty tables give no rows. Other columns are not looked at.
    """
    sets = written(classed(templates), "templates")
    if sets.count() < templates.where("text is not null").count():
        raise ValueError(f"a template has fewer than {WORDS} words")
    nets = sorted(r[0] for r in sets.select("net").distinct().collect())  # as many as NETS at most
    least = F.expr("cast(array() as array<bigint>)")
    for net in nets:
        least = F.when(F.col("net") == net, bands(F.col("shingles"), net)).otherwise(least)
    keys = sets.withColumn("least", F.explode(least)).withColumnRenamed("net", "of")
    listed = keys.count() <= LISTED_BANDS
    known = {net: [r[0] for r in keys.where(F.col("of") == net).select("least").distinct().collect()] if listed else None for net in nets}
    hashed = docs.select("doc_id", shingles(F.col("text")).alias("h"))
    none = F.expr("cast(array() as array<struct<net:int,k:int,bands:array<bigint>>>)")
    retrieved = F.concat(*[windows(F.col("h"), net, known[net]) for net in nets]) if nets else none
    key = (F.col("band") == F.col("least")) & (F.col("net") == F.col("of"))
    carried = ["doc_id", "h"] if listed else ["doc_id"]
    held = hashed.select(*carried, F.explode_outer(retrieved).alias("w"))  # outer: the plan tests the array for rows otherwise, at its full price
    signed = held.select(*carried, F.col("w.net").alias("net"), F.col("w.k").alias("k"), F.explode_outer("w.bands").alias("band"))
    if listed:
        near = signed.join(F.broadcast(keys), key)
    else:  # the few windows that meet a template fetch their shingles after that
        places = signed.join(keys.select("of", "license", "total", "class", "least").hint("merge"), key)
        places = places.select(F.col("doc_id").alias("id"), "net", "k", "license", "total", "class").distinct()
        near = hashed.join(places, F.col("doc_id").eqNullSafe(F.col("id"))).join(sets.drop("net"), ["license", "total", "class"])
    # the template's own windows in the one that retrieved it, best first, then by place
    per = F.floor(F.col("net") / F.col("class")).cast("int")
    own = F.sequence(3 * F.col("k") * per, 3 * F.col("k") * per + 4 * per - 2)
    cut = lambda k: F.slice(F.col("h"), k * F.col("class") + 1, 2 * F.col("class"))
    shared = lambda k: F.size(F.array_intersect(F.array_distinct(cut(k)), F.col("shingles")))
    best = F.array_max(F.transform(own, lambda k: F.struct(shared(k).cast("long").alias("shared"), (-k).cast("long").alias("behind"))))
    found = near.select("doc_id", "license", "class", F.col("total").cast("long").alias("total"), best.alias("best")).select(
        "doc_id", "license", "total", F.col("best.shared").alias("shared"), (-F.col("best.behind") * F.col("class")).alias("first_word")
    ).where(F.col("shared") * PART >= F.col("total") * LEAST)
    best = F.max(F.struct("shared", (-F.col("first_word")).alias("behind"), (-F.col("total")).alias("less"))).alias("best")
    return found.groupBy("doc_id", "license").agg(best).select(
        "doc_id", "license", F.col("best.shared").alias("shared"), (-F.col("best.less")).alias("total"), (-F.col("best.behind")).alias("first_word")
    )
