"""Removing parts of documents by option."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What can be stripped, and what ``all`` stands for.
STRIPPABLE = ("metadata", "bookmarks", "annotations", "attachments", "javascript", "editing")
#: The trailer's keys that are kept.
TRAILER = ("Root", "Info", "ID", "Encrypt")


def strip_list(text: str) -> list[str]:
    """Names of a comma-separated list, lower-cased and trimmed; ``all`` is every one of STRIPPABLE."""
    names = [n.strip() for n in text.lower().split(",") if n.strip()]
    found = [x for n in names for x in (STRIPPABLE if n == "all" else (n,))]
    unknown = sorted(set(found) - set(STRIPPABLE))
    if unknown:
        raise ValueError(f"can't strip {', '.join(unknown)}")
    return list(dict.fromkeys(found))


def kept_unless(value: Column, stripped: Column, name: str) -> Column:
    """``value``, or null where the array ``stripped`` has ``name``."""
    return F.when(F.array_contains(stripped, name), None).otherwise(value)


def trailer(entries: Column, stripped: Column | None = None) -> Column:
    """A map's entries that a trailer keeps; Info only where metadata is not stripped."""
    keep = lambda k: k.isin(*TRAILER)
    if stripped is None:
        return F.map_filter(entries, lambda k, v: keep(k))
    return F.map_filter(entries, lambda k, v: keep(k) & ~((k == "Info") & F.array_contains(stripped, "metadata")))


def without_scripts(html: Column) -> Column:
    """Markup without its script elements."""
    return F.regexp_replace(html, r"(?s)<script>.*?</script>", "")


def without(items: Column, field: str, value: str) -> Column:
    """An array of structs without those whose field has the value; null fields stay."""
    return F.filter(items, lambda x: ~x[field].eqNullSafe(F.lit(value)))
