"""Masks and field checks as native columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from mailgrain.functions.text import found, has, has_any, let, strip

# The masking patterns.
ADDRESS_IN_TEXT = r"(?U)\b([a-zA-Z0-9._%+-])([a-zA-Z0-9._%+-]*)@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b"
TOKEN_IN_DATA = r"(?U)\b[a-zA-Z0-9]{32,}\b"
TOKEN_IN_LOG = r"(?U)\b[a-zA-Z0-9+/=]{32,}\b"
SECRET_IN_LOG = r"""(?iU)(password|key|token|secret|auth)["']?\s*[:=]\s*["']?([^\s"']+)"""
# Markers after which a log line may hold a message body, in order of precedence.
BODY_MARKERS = ["body:", "content:", "message:", "text:"]
# Field patterns, limits and accepted words.
HEX_ID = r"\A[a-fA-F0-9]{16,}\z"
LABEL = r"(?U)\A[\p{L}\p{N}_\s\x1c-\x1f\-/]{1,100}\z"
ADDRESS = r"\A[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\z"
PRIORITIES = ["critical", "important", "normal", "low", "archive"]
CATEGORIES = ["personal", "work", "newsletter", "marketing", "transactional", "social", "other"]


def mask_addresses(text: Column) -> Column:
    masked = F.regexp_replace(text, ADDRESS_IN_TEXT, "$1***@$3")
    return F.when(has(text, "@"), masked).otherwise(text)


def mask_data(text: Column, addresses: bool = True) -> Column:
    """Data form: addresses keep their first character and domain, long tokens go."""
    return F.regexp_replace(mask_addresses(text) if addresses else text, TOKEN_IN_DATA, "[TOKEN]")


def mask_log(text: Column) -> Column:
    """Log form: addresses, then tokens with base64 signs, then named secrets."""
    text = F.regexp_replace(mask_addresses(text), TOKEN_IN_LOG, "[TOKEN]")
    masked = lambda t: F.regexp_replace(t, SECRET_IN_LOG, "$1=***")
    return let(text, lambda t: F.when(has_any(t, [":", "="]), masked(t)).otherwise(t))


def redact_body(text: Column) -> Column:
    """Cut after the first marker in precedence order that occurs anywhere."""

    def cut(lowered: Column) -> Column:
        result = text
        for marker in reversed(BODY_MARKERS):
            at = F.instr(lowered, F.lit(marker))
            kept = F.concat(F.substring(text, F.lit(1), at + F.lit(len(marker) - 1)), F.lit(" [REDACTED]"))
            result = F.when(at > 0, kept).otherwise(result)
        return result

    return let(F.lower(text), cut)


@dataclass(frozen=True)
class Check:
    """A field rule: the cleaned value, and whether the value is accepted."""

    name: str
    clean: Column
    ok: Column


def check_id(name: str, value: Column) -> Check:
    clean = strip(value)
    return Check(name, clean, found(clean, HEX_ID))


def check_label(value: Column) -> Check:
    clean = strip(value)
    return Check("label", clean, found(clean, LABEL))


def check_email(value: Column) -> Check:
    clean = F.lower(strip(value))
    return Check("email", clean, found(clean, ADDRESS) & (F.length(clean) <= 254))


def check_filename(value: Column) -> Check:
    trimmed = strip(value)
    clean = F.translate(trimmed, "/\\\x00", "__")
    ok = (F.length(trimmed) > 0) & (F.length(clean) <= 255) & ~F.startswith(clean, F.lit("."))
    return Check("filename", clean, F.coalesce(ok, F.lit(False)))


def clean_subject(value: Column, size: int = 1000) -> Column:
    """Control characters but the line break go, then the cut, then the strip."""
    return strip(F.substring(F.regexp_replace(value, r"[\x00-\x09\x0b-\x1f]", ""), 1, size))


def check_confidence(value: Column) -> Check:
    return Check("confidence", value, F.coalesce((value >= 0) & (value <= 1), F.lit(False)))


def _check_word(name: str, value: Column, words: list[str]) -> Check:
    clean = strip(F.lower(value))
    return Check(name, clean, F.coalesce(clean.isin(words), F.lit(False)))


def check_priority(value: Column) -> Check:
    return _check_word("priority", value, PRIORITIES)


def check_category(value: Column) -> Check:
    return _check_word("category", value, CATEGORIES)
