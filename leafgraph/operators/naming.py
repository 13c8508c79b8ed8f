"""Names and places of files: output names without collisions, natural order, common folders, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SUFFIX = "-compressed"


def output_base(kind: Column, base: Column, suffix: Column, same_place: Column) -> Column:
    """The name that a file's output would like to have: ``kind`` is same_folder, folder or replace."""
    own = F.when(F.length(F.coalesce(suffix, F.lit(""))) > 0, suffix).otherwise(F.lit(SUFFIX))
    return (
        F.when(kind == "same_folder", F.concat(base, own))
        .when((kind == "folder") & same_place, F.concat(base, F.lit(SUFFIX)))
        .otherwise(base)
    )


def numbered(items: DataFrame, base: str, order: str, existing: DataFrame) -> DataFrame:
    """``items`` with ``name``: their base, else "base 2", "base 3" and so on, the first that neither exists (``existing``:
    name) nor went to an item before it in order."""
    k = F.row_number().over(W.partitionBy(base).orderBy(order))
    parts = existing.select(F.regexp_extract("name", r"^(.*?)(?: ([2-9]|[1-9][0-9]+))?$", 1).alias("b"), F.regexp_extract("name", r" ([2-9]|[1-9][0-9]{1,8})$", 1).alias("n"))
    slots = parts.select("b", F.when(F.col("n") == "", 1).otherwise(F.col("n").try_cast("int")).alias("slot"))
    taken = slots.groupBy("b").agg(F.sort_array(F.collect_set("slot")).alias("taken"))
    met = items.withColumn("_k", k).join(taken, F.col(base) == F.col("b"), "left")
    slot = F.aggregate(F.coalesce("taken", F.expr("cast(array() as array<int>)")), F.col("_k"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    name = F.when(slot == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit(" "), slot.cast("string")))
    return met.withColumn("name", name).drop("_k", "b", "taken")


def natural_key(path: Column) -> Column:
    """Orders as people do: case aside, and numbers by value (f2 before f10), however long."""
    runs = F.regexp_extract_all(F.lower(path), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def number(r: Column) -> Column:
        value = F.regexp_replace(r, "^0+(?=.)", "")  # over 20 digits: after all shorter ones, by length
        long = F.concat(F.lit(":"), F.lpad(F.length(value).cast("string"), 10, "0"), value)
        return F.when(F.length(value) > 20, long).otherwise(F.lpad(value, 20, "0"))

    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), number(r)).otherwise(r)), "")


def first_seen(paths: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Each path once, as it came first."""
    names = [c for c in paths.columns if c != path]
    return paths.groupBy(path).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_first")).select(path, "_first.*")


def is_pdf(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1)) == "pdf"


def common_prefix(low: Column, high: Column) -> Column:
    """What two arrays begin with. Of a group's least and greatest array it is what all begin with."""
    n = F.least(F.size(low), F.size(high))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: (i < n) & (F.get(low, i) == F.get(high, i)))
    places = F.transform(same, lambda i, k: F.when(i == k, 1).otherwise(0))
    return F.slice(low, F.lit(1), F.aggregate(places, F.lit(0), lambda s, x: s + x))


def location(path: Column, exists: Column) -> Column:
    """missing, trash or present."""
    return F.when(~exists, "missing").when(F.array_contains(F.split(path, "/"), ".Trash"), "trash").otherwise("present")


def original_location(replaced: Column, trashed: Column, source: Column) -> Column:
    return F.when(replaced, F.coalesce(trashed, source)).otherwise(source)


#: What each state is called.
STATES = {"ready": "Ready", "locked": "Password needed", "waiting": "Waiting", "compressing": "Compressing", "done": "Done", "failed": "Failed"}


def state_text(state: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in STATES.items():
        out = F.when(state == k, v).otherwise(out)
    return out


def eligible(items: DataFrame, state: str) -> Column:
    """Which items a run takes: ready and failed ones; if there are none, all that are done."""
    open_ = F.col(state).isin("ready", "failed")
    return open_ if not items.where(open_).isEmpty() else F.col(state) == "done"


def reset(state: Column) -> Column:
    """After a run whatever is not finished is ready again."""
    return F.when(state.isin("waiting", "compressing"), "ready").otherwise(state)
