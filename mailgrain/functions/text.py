"""Small text helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# One blank as a mail client sees it: Unicode white space plus the four separator controls.
BLANK = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Drop blanks of any kind at both ends (``trim`` drops spaces only)."""
    return F.regexp_replace(text, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def squeeze(text: Column) -> Column:
    """Runs of blanks become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"(?U){BLANK}+", " "))


def has(text: Column, needle: str) -> Column:
    """Substring test that is never NULL."""
    return F.coalesce(F.contains(text, F.lit(needle)), F.lit(False))


def has_any(text: Column, needles: list[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | has(text, needle)
    return found


def found(text: Column, pattern: str) -> Column:
    """Regex search that is never NULL."""
    return F.coalesce(text.rlike(pattern), F.lit(False))


def labelled(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.array_compact(
        F.array(*[F.when(cond, label if isinstance(label, Column) else F.lit(label)) for cond, label in pairs])
    )


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Use a computed value several times while it is computed once, wherever the plan puts it."""
    return F.get(F.transform(F.array(value), then), 0)


def exploded(rows: DataFrame, items: Column, name: str, *kept: str, place: str | None = None) -> DataFrame:
    """One row per list item, with ``kept`` columns and, if asked for, the item's place.

    The outer form with the filter behind it keeps Spark from testing the list for emptiness
    beforehand, for that test is pushed below and computes the whole list a second time.
    """
    out = F.posexplode_outer(items).alias(place, name) if place else F.explode_outer(items).alias(name)
    return rows.select(*kept, out).filter(F.col(name).isNotNull())
