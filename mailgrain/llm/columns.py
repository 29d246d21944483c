"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailgrain.functions.text import let

BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The words of a text in lower case."""
    inner = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(BLANKS))
    return let(inner, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")))


#: Code points of one block of a text that is cut up.
BLOCK = 4096


def stretches(text: Column, bounds: Column) -> Column:
    """The stretches (start, end) of a text, in code points. The text is cut into blocks once, so that no stretch is counted off
    from the beginning of a long text."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def cut(parts: Column, b: Column) -> Column:
        first, last = F.floor(b["start"] / BLOCK).cast("int"), F.floor(b["end"] / BLOCK).cast("int")
        at, length = b["start"] - first * BLOCK + 1, b["end"] - b["start"]
        head = F.coalesce(F.substring(F.get(parts, first), at, F.least(length, F.lit(BLOCK))), F.lit(""))
        middle = F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        tail = F.coalesce(F.substring(F.get(parts, last), F.lit(1), b["end"] - last * BLOCK), F.lit(""))
        return F.when(first == last, head).otherwise(F.concat(head, middle, tail))

    return let(blocks, lambda parts: F.transform(bounds, lambda b: cut(parts, b)))
