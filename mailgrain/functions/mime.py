"""Reading one provider message: headers, addresses, bodies, attachments, times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailgrain.functions.text import let, strip


# A private character that sets genuine replacement characters apart from repaired bytes.
_ESCAPE = "\ue000"


def header_map(headers: Column) -> Column:
    """Name/value pairs to a map with lower-cased names; the last of a repeated name wins.

    Earlier repeats are dropped before the map is built, so no session setting decides the outcome.
    """
    pairs = F.coalesce(
        F.transform(headers, lambda h: F.struct(F.lower(h["name"]).alias("k"), h["value"].alias("v"))),
        F.array().cast("array<struct<k:string,v:string>>"),
    )
    keep_last = lambda all_, names: F.filter(
        all_, lambda p, i: F.size(all_) - F.array_position(names, p["k"]) == i
    )
    kept = let(pairs, lambda all_: let(F.reverse(all_["k"]), lambda names: keep_last(all_, names)))
    return F.map_from_entries(kept)


def addresses(header: Column) -> Column:
    """A header value split on commas, each piece stripped; no header gives no address."""
    return F.coalesce(F.transform(F.split(header, ","), strip), F.array().cast("array<string>"))


def recipients(headers: Column) -> Column:
    return F.concat(addresses(headers["to"]), addresses(headers["cc"]))


def decode_bytes(data: Column) -> Column:
    """URL-safe base64 to raw text bytes; empty gives empty, damaged base64 gives NULL."""
    plain = F.translate(F.coalesce(data, F.lit("")), "-_", "+/")
    return F.try_to_binary(plain, F.lit("base64")).cast("string")


def decode_strict(data: Column) -> Column:
    """Text, or NULL where the bytes are no valid UTF-8: such rows belong in quarantine."""
    return F.try_validate_utf8(decode_bytes(data))


def decode_lenient(data: Column) -> Column:
    """Text without the bytes that are no valid UTF-8; a replacement character of the text itself stays."""

    def repaired(raw: Column) -> Column:
        marked = F.replace(F.replace(raw, F.lit(_ESCAPE), F.lit(_ESCAPE + "0")), F.lit("\ufffd"), F.lit(_ESCAPE + "1"))
        kept = F.replace(F.make_valid_utf8(marked), F.lit("\ufffd"), F.lit(""))
        return F.replace(F.replace(kept, F.lit(_ESCAPE + "1"), F.lit("\ufffd")), F.lit(_ESCAPE + "0"), F.lit(_ESCAPE))

    return let(decode_bytes(data), lambda raw: F.when(F.is_valid_utf8(raw), raw).otherwise(repaired(raw)))


def _parts(payload: Column, mime: str) -> Column:
    return F.filter(payload["parts"], lambda p: p["mimeType"] == mime)


def body_text(payload: Column) -> Column:
    """The top-level body if it holds anything, else the first plain part even when that is empty."""
    own = payload["body"]["data"]
    first = F.get(_parts(payload, "text/plain"), 0)
    chosen = F.when(F.length(own) > 0, own).otherwise(F.coalesce(first["body"]["data"], F.lit("")))
    return decode_strict(chosen)


def body_text_lenient(payload: Column) -> Column:
    """The top-level body if present even when empty, else the first plain part that has data."""
    with_data = F.filter(_parts(payload, "text/plain"), lambda p: p["body"]["data"].isNotNull())
    return decode_lenient(F.coalesce(payload["body"]["data"], F.get(with_data, 0)["body"]["data"], F.lit("")))


def body_html(payload: Column) -> Column:
    """The first HTML part, NULL when there is none."""
    first = F.get(_parts(payload, "text/html"), 0)
    return F.when(first.isNotNull(), decode_strict(first["body"]["data"]))


def has_attachment(payload: Column) -> Column:
    """Whether any top-level part names a file, an empty name included."""
    return F.coalesce(F.exists(payload["parts"], lambda p: p["filename"].isNotNull()), F.lit(False))


def message_time(epoch_ms: Column) -> Column:
    """NULL where the text is no number, so that one bad row does not fail the job."""
    return F.timestamp_millis(epoch_ms.try_cast("bigint"))
