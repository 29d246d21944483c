"""Secret scans with corpus-wide ownership: whose is a candidate, and how far is it copied?

1. Candidates are found in every whole text: the base kinds ``assign``, ``access`` and ``hex``, and
   ``bare``, a long run of mixed characters that no base span covers.
2. Each candidate's value is hashed; hashes are counted by distinct repository (the document) and distinct owner
   (its source) over the corpus.
3. A value that at least ``WIDE_OWNERS`` owners have is a ``copied`` example; else it is ``live`` if it looks
   like a credential (many different characters), else ``weak``.
4. Base spans all stay, each with its class. Bare candidates become spans only where they are live.

Everything runs as column expressions. A row's spans are put together by a key that is given and stored once,
so repeated ids and repeated rows keep spans of their own. The matches of a very long text are as many narrow rows; places,
overlaps and masks cost time in proportion to them. Defined results: a null text is an empty text and has
no spans; a null source is an owner of its own, a null id a repository of its own; all columns asked for are carried
along, and ``spans`` replaces a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailgrain.llm.columns import stretches
from mailgrain.llm.tables import stored
from mailgrain.operators.joins import salted_join

#: Fixed values of the base kinds: pattern, group with the value, shortest value that counts.
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    # Runs below 24 never count, and a run is matched whole: asking for 24 skips the others.
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
BARE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = [*BASE, "bare"]
WIDE_OWNERS, LEAST_DIFFERENT = 3, 10
MASK = "[SECRET]"


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """All matches of one pattern, counting or not, as structs (gap, whole, value): the lengths of the stretch before the match
    and of the match. Stretches and matches come from the same left-to-right search."""
    none = F.array().cast("array<struct<kind_no:int,gap:int,whole:int,value:string>>")
    regex = F.lit(pattern)
    steps = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, regex, 0), F.length).alias("whole"),
        F.regexp_extract_all(text, regex, group).alias("value"),
    )
    found = F.transform(
        steps, lambda s: F.struct(F.lit(KINDS.index(kind)).alias("kind_no"), s["gap"].alias("gap"), s["whole"].alias("whole"), s["value"].alias("value"))
    )
    # Behind the last match there is a stretch only.
    return F.when(F.regexp_like(text, regex), F.filter(found, lambda s: s["whole"].isNotNull())).otherwise(none)


def matches(text: Column) -> Column:
    """The matches of all kinds, each kind's in their order."""
    base = [_matches(text, kind, pattern, group) for kind, (pattern, group, _) in BASE.items()]
    return F.concat(*base, _matches(text, "bare", BARE, 0))


def candidates(rows: DataFrame) -> DataFrame:
    """Base spans, and bare candidates outside them, of ``rows`` (_row, _found and others): the other columns with ``start, kind_no,
    end, value``. Places are running sums over a text's matches, so the work grows with their number, not its square."""
    others = [c for c in rows.columns if c != "_found"]
    each = rows.select(*others, F.posexplode("_found").alias("_i", "m")).select(*others, "_i", "m.*").repartition("_row")
    before = Window.partitionBy("_row", "kind_no").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("whole")).over(before).cast("int"))
    each = each.withColumn("start", F.col("end") - F.col("whole"))
    least = F.lit(20)
    for kind, (_, _, size) in BASE.items():
        least = F.when(F.col("kind_no") == KINDS.index(kind), size).otherwise(least)
    value, is_base = F.col("value"), F.col("kind_no") < len(BASE)
    mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
    each = each.filter((F.length("value") >= least) & (is_base | mixed))
    # A bare candidate is clear of all base spans if those that begin before it end before it, and the next begins behind it.
    earlier = Window.partitionBy("_row").orderBy("start", "kind_no").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("_row").orderBy(F.col("start").desc(), F.col("kind_no").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.when(is_base, F.col("end"))).over(earlier), F.lit(0))
    next_base = F.coalesce(F.min(F.when(is_base, F.col("start"))).over(later), F.col("end"))
    each = each.withColumns({"_reach": reach, "_next": next_base})
    clear = is_base | ((F.col("_reach") <= F.col("start")) & (F.col("_next") >= F.col("end")))
    return each.filter(clear).select(*others, "start", "kind_no", "end", "value")


def ownership(found: DataFrame) -> DataFrame:
    """``hash, repositories, owners`` of candidates (hash, repository, owner), counted in steps without lists."""
    per_owner = found.distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def _class(value: Column, owners: Column) -> Column:
    different = F.size(F.array_distinct(F.split(F.lower(value), "")))
    return (
        F.when(owners >= WIDE_OWNERS, "copied").when(different >= LEAST_DIFFERENT, "live").otherwise("weak")
    )


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs`` (doc_id, source, text) and ``spans``: array of (start, kind_no, end, class,
    repositories, owners, fresh, reach) by start and kind. ``fresh`` says that no span before overlaps this one, and ``reach`` how
    far the spans up to it go."""
    rows = docs.select(
        *keep,
        F.col("doc_id").alias("_repository"),
        F.col("source").alias("_owner"),
        F.monotonically_increasing_id().alias("_row"),
        matches(F.coalesce("text", F.lit(""))).alias("_found"),
    )
    rows = stored(rows, "matches")
    some = F.size("_found") > 0
    each = candidates(rows.filter(some).select("_row", "_repository", "_owner", "_found"))
    each = stored(each.withColumn("hash", F.md5("value")), "candidates")
    counts = ownership(
        each.select(
            "hash",
            F.coalesce(F.col("_repository").cast("string"), F.lit("")).alias("repository"),
            F.coalesce(F.col("_owner"), F.lit("")).alias("owner"),
        )
    )
    each = salted_join(each, stored(counts, "ownership"), ["hash"], F.col("_row"))
    each = each.withColumn("class", _class(F.col("value"), F.col("owners")))
    each = each.filter((F.col("kind_no") < len(BASE)) | (F.col("class") == "live"))
    order = Window.partitionBy("_row").orderBy("start", "kind_no")
    furthest = lambda to: F.max("end").over(order.rowsBetween(Window.unboundedPreceding, to))
    each = each.withColumns({"fresh": F.coalesce(furthest(-1) <= F.col("start"), F.lit(True)), "reach": furthest(0)})
    span = F.struct("start", "kind_no", "end", "class", "repositories", "owners", "fresh", "reach")
    lists = each.groupBy("_row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.array().cast(lists.schema["spans"].dataType)
    kept = [c for c in keep if c != "spans"]
    with_some = rows.filter(some).join(lists, "_row", "left").select(*kept, F.coalesce("spans", none).alias("spans"))
    return rows.filter(~some).select(*kept, none.alias("spans")).unionByName(with_some)


def written(spans: Column, only_base: bool = False) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    kind = F.array(*map(F.lit, KINDS))
    chosen = F.filter(spans, lambda s: s["kind_no"] < len(BASE)) if only_base else spans
    one = lambda s: F.concat_ws(":", F.get(kind, s["kind_no"]), s["start"], s["end"])
    return F.array_join(F.transform(chosen, one), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span, and every group of overlapping ones, replaced by one mask."""
    starts = F.transform(F.filter(spans, lambda s: s["fresh"]), lambda s: s["start"])
    last = lambda s, i: F.coalesce(F.get(spans, i + 1)["fresh"], F.lit(True))
    ends = F.transform(F.filter(spans, last), lambda s: s["reach"])
    froms = F.concat(F.array(F.lit(0)), ends)
    tos = F.concat(starts, F.array(F.length(text)))
    gaps = stretches(text, F.arrays_zip(froms.alias("start"), tos.alias("end")))
    return F.when(F.size(spans) > 0, F.array_join(gaps, MASK)).otherwise(text)
