"""Progress of runs: running maximum, throttled reports, time left, weights, planned costs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafgraph.operators import folds

#: Seconds of projected run time from which an estimate is shown, and for how long it must have looked so.
THRESHOLD, STEADY = 10.0, 2.0
#: Nanoseconds a byte or an object.
STREAM_NS, CONTENT_NS, IMAGE_NS, JPEG_NS, OBJECT_NS, WRITE_NS = 330, 25, 200, 50, 1000, 2


def running(fraction: Column, by: list[str], order: list[str]) -> Column:
    """The largest fraction so far, 1 at most."""
    return F.max(F.least(fraction, F.lit(1.0))).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def throttled(times: Column, gap: int) -> Column:
    """Of sorted times those reported: the first, then each that is ``gap`` or more after the last reported one; for short
    arrays. :func:`reported` takes any number of times."""

    def step(out: Column, t: Column) -> Column:
        due = (F.size(out) == 0) | (t - F.element_at(F.concat(F.array(t), out), -1) >= gap)
        return F.when(due, F.concat(out, F.array(t))).otherwise(out)

    return F.aggregate(times, F.expr("cast(array() as array<bigint>)"), step)


#: Samples before so many seconds, or with no more than such a fraction, say too little.
EARLY, LITTLE = 1.0, 0.01
#: Seconds in which the weight of what was projected before falls to 1/e.
MEMORY = 2.0


def projection(before: tuple, t: float, fraction: float, threshold: float = THRESHOLD) -> tuple:
    """The state (end, at, since, left) after a sample at ``t`` seconds. ``end`` is when the run is projected to end: the
    samples' t / fraction, smoothed exponentially in time; a finished run's is not smoothed. ``since``: from when on ``end`` has
    been beyond the threshold. ``left``: seconds to ``end``, None until it has been so for STEADY seconds once."""
    end, at, since, left = before
    if t < EARLY or fraction <= LITTLE:
        return before
    old = 0.0 if end is None or fraction >= 1 else math.exp(min(0.0, at - t) / MEMORY)
    end = t / min(fraction, 1.0) * (1 - old) + (end * old if old else 0.0)
    since = None if end <= threshold else t if since is None else since
    if left is not None or since is not None and since + STEADY <= t:
        left = max(end - t, 0.0)
    return end, t, since, left


def time_left(samples: Column, threshold: float = THRESHOLD) -> Column:
    """What :func:`projection` says is left after samples (array of structs t: seconds since the start, fraction; sorted by t);
    for short arrays. :func:`times_left` takes any number of samples."""
    null = F.lit(None).cast("double")
    start = F.struct(null.alias("end"), null.alias("at"), null.alias("since"), null.alias("left"))

    def step(s: Column, x: Column) -> Column:
        t, share = x["t"], F.least(x["fraction"], F.lit(1.0))
        old = F.when((share < 1) & s["end"].isNotNull(), F.exp(F.least(F.lit(0.0), s["at"] - t) / MEMORY)).otherwise(0.0)
        blend = t / share * (1 - old) + F.coalesce(s["end"], F.lit(0.0)) * old

        def then(end: Column) -> Column:
            since = F.when(end > threshold, F.coalesce(s["since"], t))
            shown = s["left"].isNotNull() | F.coalesce(since + STEADY <= t, F.lit(False))
            return F.struct(end.alias("end"), t.alias("at"), since.alias("since"), F.when(shown, F.greatest(end - t, F.lit(0.0))).alias("left"))

        # the array binds the end, which is used three times, to a name
        moved = F.element_at(F.transform(F.array(blend), then), 1)
        return F.when((t >= EARLY) & (x["fraction"] > LITTLE), moved).otherwise(s)

    return F.aggregate(samples, start, step, lambda s: s["left"])


def times_left(samples: DataFrame, run: str, threshold: float = THRESHOLD) -> DataFrame:
    """(run, left) of runs of any number of samples (run, t: seconds since the run's start, fraction)."""
    kind = samples.schema[run].dataType.simpleString()
    return folds.folded(
        samples.select(run, "t", "fraction"), run, ["t", "fraction"], (None,) * 4, lambda s, x: projection(s, x[0], x[1], threshold), f"{run} {kind}, left double", last=lambda s: (s[3],)
    )


def reported(times: DataFrame, key: str, time: str, gap: int) -> DataFrame:
    """The rows (key, time) that are reported of each key's times: see :func:`throttled`, for any number of them."""
    kind = times.schema[key].dataType.simpleString()
    due = lambda last, x: x[0] if last is None or x[0] - last >= gap else last
    return folds.folded(times.select(key, time), key, [time], None, due, f"{key} {kind}, {time} long", each=lambda old, new, x: (x[0],) if new is not old else None)


def weighted(weight: Column, status: Column, progress: Column) -> Column:
    """Progress of a batch (aggregate): finished items count whole, the one at work by its progress, others nothing."""
    w = F.greatest(weight, F.lit(1).cast("long"))
    done = F.when(status.isin("done", "failed", "locked"), w).when(status == "compressing", w * progress).otherwise(0)
    return F.sum(done) / F.sum(w)


def stream_cost(length: Column, filtered: Column) -> Column:
    return length * F.when(filtered, 4).otherwise(1) * STREAM_NS


def content_cost(length: Column, filtered: Column, passes: int = 1) -> Column:
    return length * F.when(filtered, 4).otherwise(1) * CONTENT_NS * passes


def image_cost(width: Column, height: Column, parts: Column, bits: Column, jpeg: Column) -> Column:
    bits = F.least(F.lit(16), F.greatest(F.lit(1), bits))
    size = F.least(F.floor(width * height * parts * bits / 8), F.lit(10**12))
    return size * F.when(jpeg, JPEG_NS).otherwise(IMAGE_NS)


def write_cost(objects: Column, length: Column) -> Column:
    return objects * OBJECT_NS + length * WRITE_NS


def deflate_level(length: Column) -> Column:
    """12 up to 16 MiB, 9 up to 64 MiB, else 6."""
    return F.when(length <= 16 << 20, 12).when(length <= 64 << 20, 9).otherwise(6)


def seconds_text(seconds: Column) -> Column:
    """Seconds rounded for display: up to the next five below a minute, else to the nearest minute."""
    return F.when(seconds < 60, F.greatest(F.lit(5).cast("long"), F.ceil(seconds / 5) * 5)).otherwise(F.floor(seconds / 60 + 0.5) * 60)


def twentieths(quality: Column) -> Column:
    return F.floor(quality * 20 + 0.5) / 20


def bytes_text(n: Column) -> Column:
    """Decimal units without decimals: ``999 bytes``, ``12 KB``, ``3 MB``."""
    unit = lambda size, name: F.concat(F.floor(n / size + 0.5).cast("string"), F.lit(name))
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(" bytes"))).when(n < 999_500, unit(1000, " KB")).when(n < 999_500_000, unit(10**6, " MB")).otherwise(unit(10**9, " GB"))


def latest(history: DataFrame, by: list[Column], most: int = 1000) -> DataFrame:
    """The newest entries, ``most`` of them: a top-k, kept per partition before they meet."""
    return history.orderBy(*by).limit(most)
