"""User rules as one equi-join, whatever their condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailgrain.functions.text import exploded
from mailgrain.operators.joins import copied_join, identity, joined_null_safe


#: A text's pieces by which a subject finds the rules it may contain, and the bits of the filter that they pass before.
PIECE, BITS = 3, 1 << 16


def _pieces(text: Column, length: int) -> Column:
    """All pieces of one length, from one linear pass: a match of nothing at each place that looks ahead."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def _rule_pieces(rules: DataFrame) -> DataFrame:
    """Subject rules with the one piece of their text, ``piece``, that the fewest rules have."""
    text = F.col("condition_value")
    pieces = F.when(F.length(text) >= PIECE, _pieces(text, PIECE)).otherwise(F.array(text))
    each = rules.select("condition_value", "action_type", "rule", F.explode(pieces).alias("piece"))
    often = each.groupBy("piece").agg(F.count_distinct("condition_value").alias("n"))
    rarest = F.min(F.struct("n", "piece")).alias("r")
    chosen = each.join(often, "piece").groupBy("condition_value", "action_type").agg(rarest, F.first("rule").alias("rule"))
    return chosen.select("condition_value", "action_type", "rule", "r.piece")


def _bit(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(BITS)).cast("int")


def _bit_filter(pieces: DataFrame) -> Column:
    """One value of fixed size, whatever the rules: 64-bit words in which the bit of every piece is set."""
    bit = _bit(F.col("piece"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63))
    words = pieces.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    known = words.agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    every = F.sequence(F.lit(0), F.lit(BITS // 64 - 1))
    return known.select(F.transform(every, lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))).scalar()


def subject_pieces(mail: DataFrame, pieces: DataFrame) -> DataFrame:
    """Identity and ``piece`` for the pieces of each subject that some rule has. The others are dropped within the
    projection, but for the few whose bit another piece has set; no text is carried on."""
    keys = identity(mail)
    own = F.flatten(F.array(*[_pieces(F.lower("subject"), n) for n in range(1, PIECE + 1)]))
    rows = mail.select(*keys, own.alias("_own"), _bit_filter(pieces).alias("_bits"))
    set_in = lambda p: F.getbit(F.get("_bits", F.shiftright(_bit(p), 6)), _bit(p).bitwiseAND(63)) == 1
    return exploded(rows, F.filter("_own", set_in), "piece", *keys)


def apply_rules(mail: DataFrame, rules: DataFrame) -> DataFrame:
    """The first matching rule per message and action type; lower priority numbers go first.

    Every condition becomes an equality, so no message is paired with all rules: a message offers its sender,
    domain and category, and those pieces of its subject, of up to three characters, that some rule has. A subject rule is
    found by the piece of its text that the fewest rules have; the texts are fetched for the pairs found, and tested whole, case
    ignored. Rules with the same condition
    and action type are reduced to the first before the join: the others could never be first.

    ``mail``: its identity, sender, domain, category, subject.
    """
    keys = identity(mail)
    by_subject = F.col("condition_type") == "subject_contains"
    value = F.when(by_subject, F.lower("condition_value")).otherwise(F.col("condition_value"))
    first = F.min(F.struct("priority", "id", "action_value"))
    active = (
        rules.filter(F.col("is_active") & (F.length("condition_value") > 0))
        .groupBy("condition_type", value.alias("condition_value"), "action_type")
        .agg(first.alias("rule"))
    )
    entry = lambda kind, v: F.struct(F.lit(kind).alias("condition_type"), v.alias("condition_value"))
    offers = F.array(*[entry(kind, F.col(kind)) for kind in ("sender", "domain", "category")])
    offered = exploded(mail, offers, "o", *keys).select(*keys, "o.*").filter(F.col("condition_value").isNotNull())
    equal = copied_join(offered, active.filter(~by_subject), ["condition_type", "condition_value"], F.xxhash64(*keys))
    by_piece = _rule_pieces(active.filter(by_subject))
    near = copied_join(subject_pieces(mail, by_piece), by_piece, ["piece"], F.xxhash64(*keys))
    texts = mail.select(*keys, F.lower("subject").alias("_text"))
    held = joined_null_safe(near, texts, keys).filter(F.contains("_text", F.col("condition_value")))
    matched = equal.select(*keys, "action_type", "rule").unionByName(held.select(*keys, "action_type", "rule"))
    chosen = matched.groupBy(*keys, "action_type").agg(F.min("rule").alias("rule"))
    return chosen.select(
        *keys, "action_type", F.col("rule.id").alias("rule_id"), F.col("rule.action_value").alias("action_value")
    )
