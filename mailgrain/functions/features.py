"""Message features as native columns: ``Column -> Column``, no state, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailgrain.functions.text import has, has_any, labelled, let, squeeze, strip

# What counts as a link, as a character class so that long links need no recursion.
LINK = r"https?://[!$-_a-z]+"
# Subject words that mark marketing.
MARKETING_WORDS = ["sale", "offer", "discount", "limited time"]
# Body phrases of automated mail and the names they are counted under.
CONTENT_PHRASES = [
    ("unsubscribe", "unsubscribe"),
    ("click here", "click_here"),
    ("view in browser", "view_in_browser"),
]
# Closings that count as a signature, case-sensitive.
SIGNATURES = ["--", "Best regards", "Thanks"]
# Month names of mail dates.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_MAIL_DATE = (
    r"(?i)\A\s*(?:[a-z]{3,9},?\s+)?(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{4}|\d{2})\s+"
    r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+([+-]\d{4}|[a-z]+))?(?:\s*\(.*\))?\s*\z"
)


def sender_domain_learn(sender: Column) -> Column:
    """Lower-cased text between the first and second ``@``; NULL when there is none."""
    return F.when(F.contains(sender, F.lit("@")), F.lower(F.split_part(sender, F.lit("@"), F.lit(2))))


def sender_domain_report(sender: Column) -> Column:
    """Text after the last ``@`` without closing brackets, case kept; empty when there is none."""
    tail = F.btrim(F.substring_index(sender, "@", -1), F.lit(">"))
    return F.when(F.contains(sender, F.lit("@")), tail).otherwise(F.lit(""))


def sender_domain_store(sender: Column) -> Column:
    """Text between the first and second ``@``, untouched; empty when there is none."""
    return F.coalesce(F.split_part(sender, F.lit("@"), F.lit(2)), F.lit(""))


def sender_name(sender: Column) -> Column:
    """Display name before ``<``; a bare address is its own name; NULL when empty."""
    return F.nullif(strip(F.split_part(sender, F.lit("<"), F.lit(1))), F.lit(""))


def length_bucket(size: Column) -> Column:
    """Bucket of a body length."""
    return F.when(size < 100, "short").when(size < 500, "medium").otherwise("long")


def mean_line_length(body: Column) -> Column:
    """Characters per line: the line breaks are all that splitting would remove."""
    without = F.length(F.replace(body, F.lit("\n"), F.lit("")))
    return without / (F.length(body) - without + 1)


def spacing_bucket(mean: Column) -> Column:
    """Bucket of a mean line length."""
    return F.when(mean > 80, "dense").when(mean > 40, "normal").otherwise("sparse")


def _count_links(body: Column, pattern: str) -> Column:
    """Most mail holds no link: the plain search first spares it the pattern."""
    return F.when(has(body, "http"), F.regexp_count(body, F.lit(pattern))).when(body.isNotNull(), F.lit(0))


def link_count(body: Column) -> Column:
    return _count_links(body, LINK)


def link_bucket(links: Column) -> Column:
    """Bucket of a link count."""
    return F.when(links == 0, "none").when(links < 3, "few").otherwise("many")


def url_count(body: Column) -> Column:
    """How often a link starts, whether or not anything follows."""
    return _count_links(body, "https?://")


def hour_received(received: Column, zone: str = "UTC") -> Column:
    return F.hour(F.from_utc_timestamp(received, zone))


def hour_header(date_header: Column) -> Column:
    """Hour as written in a mail date, whatever its offset; NULL unless the whole date is sound."""
    months = F.array(*[F.lit(m) for m in MONTHS])

    def hour(piece: Column) -> Column:
        number = lambda i: F.get(piece, i).try_cast("int")
        year, second = number(2), F.coalesce(number(5), F.lit(0))
        century = F.when(F.length(F.get(piece, 2)) > 2, 0).when(year < 69, 2000).otherwise(1900)
        month = F.nullif(F.array_position(months, F.lower(F.get(piece, 1))), F.lit(0)).cast("int")
        moment = F.try_make_timestamp(
            year + century, month, number(0), number(3), number(4), second.cast("double")
        )
        offset = F.coalesce(F.substring(F.get(piece, 6), 2, 2).try_cast("int"), F.lit(0))
        # A second of 60 is a valid Spark timestamp, but not a valid clock reading.
        return F.when(moment.isNotNull() & (second < 60) & (offset < 24), number(3))

    pieces = F.split(F.regexp_replace(date_header, _MAIL_DATE, "$1|$2|$3|$4|$5|$6|$7"), r"\|")
    return let(pieces, lambda piece: F.when(F.size(piece) == 7, hour(piece)))


def subject_tests(lowered: Column) -> list[tuple[Column, str]]:
    """Tests of a lower-cased subject and the names of what they find."""
    return [
        (has(lowered, "re:"), "re:"),
        (has(lowered, "fw:"), "fw:"),
        (has_any(lowered, MARKETING_WORDS), "marketing"),
    ]


def content_tests(lowered: Column) -> list[tuple[Column, str]]:
    """Tests of a lower-cased body."""
    return [(has(lowered, phrase), name) for phrase, name in CONTENT_PHRASES]


def reply_tests(body: Column) -> list[tuple[Column, str]]:
    return [
        (has(body, ">"), "quoted"),
        (has(body, "On ") & has(body, "wrote:"), "email_client"),
    ]


def subject_markers(subject: Column) -> Column:
    return labelled(*subject_tests(F.lower(subject)))


def content_markers(body: Column) -> Column:
    return labelled(*content_tests(F.lower(body)))


def reply_markers(body: Column) -> Column:
    return labelled(*reply_tests(body))


def signature_marker(body: Column) -> Column:
    return has_any(body, SIGNATURES)


def shorten(text: Column, size: int) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def mail_preview(body: Column, size: int = 100) -> Column:
    return shorten(squeeze(body), size)


def subject_preview(subject: Column, size: int = 50) -> Column:
    return shorten(subject, size)


def subject_words(subject: Column) -> Column:
    """Lower-cased words longer than three characters, repeats and punctuation kept."""
    return F.filter(F.split(squeeze(F.lower(subject)), " "), lambda word: F.length(word) > 3)


def content_hash(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)
