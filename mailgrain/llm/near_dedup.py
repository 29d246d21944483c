"""Near-duplicate groups: one-permutation MinHash, banded buckets, star-shaped candidate edges.

Texts are lower-cased (A-Z) and cut into words at ASCII white space; the set of a text is its distinct
shingles of five words (fewer words: the whole sequence; none: empty). Two texts are linked when
``100 * |A & B| >= 75 * |A | B|`` on the full sets.

1. Texts with the same set become one class, however many copies there are.
2. Each class gets a signature of one-permutation hashing with optimal densification, cut into bands.
   Classes that share a band key share a bucket.
3. For each class its shingles that no other class in a bucket has are counted. They bound every intersection
   from above, so most chance neighbours are ruled out exactly, without a look at the pair.
4. A bucket never pairs its members with each other. It has a centre, and members are paired with that. In
   the first round each class uses one centre of all its buckets, its pivot: the member that shares most.
   Pairs are compared on the full sets, and confirmed links join classes to components.
5. A star can miss a link between two members that are both unlike the centre. So a bucket whose members
   lie in different components goes on. A member that was a centre has met all others and leaves the bucket. The
   next centres are the most shared members outside the bucket's largest component, ``MORE_CENTRES`` times as
   many each round, and meet only fitting members of other components. A bucket is done when what is left of it lies
   in one component. What two members have in common with the same pivot bounds their intersection further. No
   bucket is capped: members of the largest component never meet each other, and only a bucket of texts that
   are all unlike each other, and could all be alike by these bounds, comes to all its pairs.

Buckets and texts that hold many rows are spread: bucket facts go back to members by band and salt, centres are
copied once per ``PAIRS`` pairs of their bucket, texts once per ``LOAD`` pairs.

Defined results: null and empty texts, and texts of white space, have no shingles, are linked with
nothing and form a component of their own row; equal rows are copies of each other; rows with a null id
take part, and a component of only such rows has a null id; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailgrain.llm import minhash
from mailgrain.llm.graph import components
from mailgrain.llm.tables import stored

WIDTH, PER_CENT = 5, 75
#: At a similarity of 0.75 a pair shares no bucket with probability (1 - 0.75**4)**40, about 3e-7.
BANDS, ROWS = 40, 4
SLICE_BYTES = 128 << 10
#: Centres of a bucket in the first star round, and how many times as many in each next one.
FIRST_CENTRES, MORE_CENTRES = 64, 8
#: Pairs per copy of a text that many pairs need, and of a bucket's centres.
LOAD, PAIRS = 1000, 1 << 16
#: Over so many parts a bucket is spread when it is told what holds for all of it.
SALTS = 64


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_shingles, set_one, set_two, bands`` for every row; equal texts have equal keys."""
    schema = "doc_id long, text_key long, n_shingles long, set_one long, set_two long, bands array<long>"
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(lambda it: minhash.describe(it, WIDTH, BANDS * ROWS, ROWS, SLICE_BYTES), schema)


def classes_of(rows: DataFrame) -> DataFrame:
    """One numbered row per distinct non-empty set. ``first`` is its smallest id, ``found`` where its text is."""
    grouped = (
        rows.filter("n_shingles > 0")
        .groupBy("set_one", "set_two")
        .agg(
            F.min("doc_id").alias("first"),
            F.min(F.struct("doc_id", "text_key")).alias("found"),
            F.first("n_shingles").alias("size"),
            F.first("bands").alias("bands"),
        )
    )
    return stored(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")


def _with_salt(members: DataFrame) -> DataFrame:
    return members.withColumn("salt", F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(SALTS)).cast("int"))


def _salts() -> Column:
    """The salts that occur, as the bits of one number."""
    return F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")


def _per_salt(buckets: DataFrame) -> DataFrame:
    """One row per bucket and salt that occurs in it, instead of one per bucket with ``salts``."""
    occurs = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("salts", i) == 1)
    return buckets.withColumn("salt", F.explode(occurs)).drop("salts")


def bucket_members(classes: DataFrame) -> DataFrame:
    """``band, place, node`` of buckets with more than one class; ``place`` is the band's number."""
    entries = _with_salt(classes.select("node", F.posexplode("bands").alias("place", "band")))
    shared = entries.groupBy("band").agg(F.count(F.lit(1)).alias("n"), _salts()).filter("n > 1").select("band", "salts")
    return stored(entries.join(_per_salt(shared), ["band", "salt"]).drop("salt"), "buckets")


def texts_of(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """``node, text`` of every class in a bucket, one text each."""
    wanted = classes.join(members.select("node").distinct(), "node", "left_semi").select(
        "node", F.col("found.doc_id").alias("of"), F.col("found.text_key").alias("key")
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("of"), "text", F.xxhash64("text").alias("key"))
    fetched = rows.join(wanted, rows["of"].eqNullSafe(wanted["of"]) & (rows["key"] == wanted["key"]))
    return stored(fetched.groupBy("node").agg(F.first("text").alias("text")), "texts")


def with_shared(members: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Members with ``size`` and ``shared``, their shingles that some other class in a bucket has too; without
    those that have too few to be linked with anything."""
    each = texts.mapInArrow(lambda it: minhash.members(it, WIDTH, SLICE_BYTES), "node long, shingle long")
    own = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).filter("n = 1")
    alone = own.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    nodes = classes.select("node", "size").join(texts.select("node"), "node").join(alone, "node", "left")
    nodes = nodes.withColumn("shared", F.col("size") - F.coalesce("alone", F.lit(0)))
    fit = stored(nodes.filter(F.lit(100) * F.col("shared") >= F.lit(PER_CENT) * F.col("size")).drop("alone"), "nodes")
    return stored(members.join(fit, "node"), "members")


def _fits(one: str, other: str) -> Column:
    """Whether two members can be linked at all, given what bounds their intersection from above.

    It is no larger than what either shares with any class; and with a common pivot, no larger than the
    smaller part in the pivot and the smaller shared part outside it together.
    """
    of = lambda name: (F.col(one + name), F.col(other + name))
    (size_a, size_b), (shared_a, shared_b) = of("size"), of("shared")
    (pivot_a, pivot_b), (in_a, in_b) = of("pivot"), of("inside")
    split = F.least(in_a, in_b) + F.least(shared_a - in_a, shared_b - in_b)
    most = F.when(pivot_a == pivot_b, split).otherwise(F.least(shared_a, shared_b))
    return F.lit(100 + PER_CENT) * most >= F.lit(PER_CENT) * (size_a + size_b)


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` after new links (a, b): only their ends' components are joined, however large those are."""
    edges = links
    for end in ("a", "b"):
        to = labels.select(F.col("node").alias(end), F.col("root").alias("to"))
        edges = edges.join(to, end).withColumn(end, F.col("to")).drop("to")
    moves = components(stored(edges.filter("a != b").distinct(), "edges"))
    moves = moves.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return stored(labels.join(moves, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")


def mixed_buckets(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Members of buckets that span components, with the ``facts`` of their classes, ``root`` among them, the bucket's
    number of members ``n`` and the root ``top`` of most of them."""
    kept = [c for c in members.columns if c == "node" or c not in (*facts.columns, "n", "top")]
    told = _with_salt(members.select(kept).join(facts, "node"))
    parts = told.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), _salts())
    buckets = parts.groupBy("band").agg(
        F.count(F.lit(1)).alias("roots"), F.sum("n").alias("n"), F.max_by("root", F.struct("n", "root")).alias("top"), F.bit_or("salts").alias("salts")
    )
    mixed = _per_salt(buckets.filter("roots > 1").drop("roots"))
    return stored(told.join(mixed, ["band", "salt"]).drop("salt"), "mixed")


def _best() -> Column:
    """Order of centres: by the part shared, the larger text, the number."""
    return F.struct((F.col("shared") / F.col("size")).alias("part"), "size", "node")


def pivots_of(members: DataFrame) -> DataFrame:
    """``node, pivot``: of all members of a class's buckets the one with the largest shared part, which is
    that of a text of which the others are edited copies."""
    members = _with_salt(members)
    best = members.groupBy("band").agg(F.max(_best()).alias("best"), _salts())
    chosen = members.select("band", "salt", "node").join(_per_salt(best), ["band", "salt"])
    chosen = chosen.groupBy("node").agg(F.max("best").alias("best"))
    return stored(chosen.select("node", F.col("best.node").alias("pivot")), "pivots")


def next_centres(mixed: DataFrame, per_bucket: int) -> DataFrame:
    """Up to ``per_bucket`` of the rows ``mixed`` of each bucket, the most shared first."""
    seat = F.pmod(F.xxhash64("node", F.lit(per_bucket)), F.lit(per_bucket))
    rest = [c for c in mixed.columns if c not in ("band", "place", "node", "top")]
    picked = mixed.groupBy("band", seat.alias("seat")).agg(F.max(F.struct(_best().alias("best"), *rest)).alias("c"))
    return stored(picked.select("band", F.col("c.best.node").alias("node"), *(f"c.{r}" for r in rest)), "centres")


def star_pairs(mixed: DataFrame, centres: DataFrame, tried: DataFrame, per_bucket: int) -> DataFrame:
    """``a, b``: centres with the fitting members of other components, without the pairs ``tried`` (low, high).

    Two classes meet in every bucket they share. Their pair comes from the first of these, once one of them is a
    centre there, and not from the others.
    """
    copies = F.ceil(F.col("n") * F.least(F.col("n"), F.lit(per_bucket)) / F.lit(PAIRS)).cast("int")
    hubs = centres.select("band", F.struct(*(c for c in centres.columns if c != "band")).alias("hub"), copies.alias("copies"))
    hubs = hubs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    members = mixed.withColumn("salt", F.pmod(F.xxhash64("node"), copies).cast("int"))
    before = lambda bands: F.slice(bands, F.lit(1), F.col("place"))
    met = F.arrays_overlap(before(F.col("bands")), before(F.col("hub.bands")))
    pairs = (
        members.join(hubs, ["band", "salt"])
        .filter((F.col("root") != F.col("hub.root")) & _fits("", "hub.") & ~met)
        .groupBy(F.least("hub.node", "node").alias("low"), F.greatest("hub.node", "node").alias("high"))
        .agg(F.max("hub.node").alias("a"))
    )
    pairs = pairs.join(tried, ["low", "high"], "left_anti")
    return pairs.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))


def _with_text(pairs: DataFrame, texts: DataFrame, end: str, other: str) -> DataFrame:
    """``pairs`` with the text of their ``end``; a class in many pairs is copied once per ``LOAD`` pairs, so that no
    task gets them all."""
    loads = pairs.groupBy(end).agg(F.ceil(F.count(F.lit(1)) / LOAD).cast("int").alias("copies"))
    many = loads.filter("copies > 1")
    dealt = pairs.join(many, end, "left")
    dealt = dealt.withColumn("salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("copies")).cast("int"), F.lit(0))).drop("copies")
    copied = texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")).join(loads, end)
    copied = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    return dealt.join(copied, [end, "salt"]).drop("salt")


def compared(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, both, linked`` for pairs (a, b) of classes, a stored table; ``both`` counts common shingles."""
    both = _with_text(_with_text(pairs, texts, "b", "a"), texts, "a", "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(lambda it: minhash.compare(it, WIDTH, PER_CENT, SLICE_BYTES), "a long, b long, both long, linked boolean")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of each group of near duplicates: the one with the smallest id, and of rows with
    one id the one with the smallest hash. Texts without shingles are no one's duplicates and all stay."""
    groups = near_groups(docs).select("doc_id", "text_key", "component")
    first = groups.filter("component IS NOT NULL").groupBy("component").agg(F.min(_by_id()).alias("k"))
    alone = groups.filter("component IS NULL").select("doc_id", "text_key").distinct()
    keys = first.select("k.doc_id", "k.text_key").unionByName(alone)
    keys = stored(keys.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "kept")
    own, key = F.col("doc_id").cast("long"), F.xxhash64("text")
    rows = docs.withColumn("_key_of", key).join(keys, own.eqNullSafe(F.col("_id")) & (F.col("_key_of") == F.col("_key")), "left_semi")
    repeated = groups.filter("component IS NOT NULL").groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = stored(repeated.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "repeated")
    if repeated.limit(1).count():
        same = own.eqNullSafe(F.col("_id")) & (F.col("_key_of") == F.col("_key"))
        again = rows.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "_key_of"])
        rows = rows.join(repeated, same, "left_anti").unionByName(again)
    return rows.drop("_key_of")


def _by_id() -> Column:
    """Order by id, a null one last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, n_shingles, component, component_id, kept`` for every row of ``docs`` (doc_id, text).

    ``component`` numbers the components, null for a text without shingles; ``component_id`` is the smallest id in
    it, and ``kept`` says that it is the row's own.
    """
    rows = stored(described(docs), "sets")
    classes = classes_of(rows)
    members = bucket_members(classes)
    texts = texts_of(docs, classes, members)
    members = with_shared(members, classes, texts)
    pivots = pivots_of(members)
    pairs = stored(pivots.filter("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")), "pairs")
    found = stored(compared(texts, pairs), "links")
    roots = components(found.filter("linked").select("a", "b"))
    labels = pivots.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    labels = stored(labels, "labels")
    tried = pairs.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    inside = found.select(F.col("b").alias("node"), F.col("both").alias("inside"))
    facts = labels.join(pivots, "node").join(inside, "node", "left").join(classes.select("node", "bands"), "node")
    members = mixed_buckets(members, facts).withColumn("inside", F.coalesce("inside", "shared"))
    outside, per_bucket = members, FIRST_CENTRES
    while True:
        centres = next_centres(outside, per_bucket)
        if not centres.limit(1).count():
            break
        pairs = stored(star_pairs(members, centres, tried, per_bucket), "pairs")
        if pairs.limit(1).count():
            new = stored(compared(texts, pairs), "links").filter("linked").select("a", "b")
            if new.limit(1).count():
                labels = merged(labels, new)
        members = mixed_buckets(members.join(centres.select("band", "node"), ["band", "node"], "left_anti"), labels)
        outside = members.filter("root != top")
        per_bucket *= MORE_CENTRES
    named = classes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select("set_one", "set_two", F.col("root").alias("component"), "component_id")
    found = rows.drop("bands").join(named, ["set_one", "set_two"], "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id", "text_key", "n_shingles", "component", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )
