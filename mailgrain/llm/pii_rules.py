"""Spans of personal data in texts: the base kinds by their rules, further kinds by a trained field of word shapes."""

from __future__ import annotations

import re

import numpy as np

from mailgrain.llm import arrays as A
from mailgrain.llm import crf

BASE_KINDS = ["email", "ip", "card", "phone"]
LEARNED_KINDS = ["national_phone", "birth_date", "street", "identity"]
KINDS = [*BASE_KINDS, *LEARNED_KINDS]
# Fixed values of the base kinds. What stands before the first character of an address or number changes no match, as
# a match from the run's first character takes the whole run; it only spares tries from every later
# character. Nothing follows the repeated groups, so they need not keep ways back.
_ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
EMAIL, EMAIL_ON = re.compile(r"(?<![A-Za-z0-9._%+-])" + _ADDRESS), re.compile(_ADDRESS)
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str):
    at = 0
    while "@" in text:
        # Straight behind a match the rest of a run may be an address of its own.
        found = (at and EMAIL_ON.match(text, at)) or EMAIL.search(text, at)
        if not found:
            return
        yield found.start(), found.end()
        at = found.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind_no, end) of all base spans in code points, by start and kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _lines(data: np.ndarray, limit: int):
    """A long text in parts that end behind a line break."""
    start = 0
    while len(data) - start > limit:
        stop = data[start + limit :].tobytes().find(b"\n")
        if stop < 0:
            break
        yield start, data[start : start + limit + stop + 1]
        start += limit + stop + 1
    yield start, data[start:]


def learned_spans(data: np.ndarray, offsets: np.ndarray, model: crf.Model) -> tuple[np.ndarray, ...]:
    """(text, start, end, kind) of the spans that the field finds, in code points of their texts."""
    given = crf.stretches(data, offsets)
    start, end, kind = crf.spans(given, crf.decode(given, model))
    if not len(start):
        return start, start, start, start
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)))
    text = np.searchsorted(offsets, start, side="right") - 1
    return text, points[start] - points[offsets[text]], points[end] - points[offsets[text]], kind


def found(batches, weights: dict, keep: list[str], limit: int):
    """Arrow batches with a column ``text`` to the columns ``keep`` and ``spans``: lists of (start, kind_no, end)."""
    import pyarrow as pa

    model = crf.Model(**weights)
    for batch in batches:
        column = batch.column("text")
        more: dict[int, list[tuple[int, int, int]]] = {}
        for first, last, data, offsets in A.text_slices(column, limit):
            alone = last == first + 1 and len(data) > limit
            done = 0
            for _, part in _lines(data, limit) if alone else [(0, data)]:
                bounds = np.array([0, len(part)]) if alone else offsets
                for row, a, b, kind in zip(*(x.tolist() for x in learned_spans(part, bounds, model)), strict=True):
                    more.setdefault(first + row, []).append((done + a, len(BASE_KINDS) + kind, done + b))
                if alone:
                    done += int(((part & 0xC0) != 0x80).sum())
        starts, kinds, ends, sizes = [], [], [], []
        for i, value in enumerate(column):
            spans = base_spans(value.as_py() or "")
            if i in more:
                spans = sorted([*spans, *outside(spans, more[i])])
            sizes.append(len(spans))
            for a, k, b in spans:
                starts.append(a)
                kinds.append(k)
                ends.append(b)
        items = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (starts, kinds, ends)], ["start", "kind_no", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), items)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], [*keep, "spans"])


def outside(base: list[tuple[int, int, int]], others: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of the other spans, ordered by start and apart from each other, that overlap no base span."""
    reach, covered = 0, []
    for a, _, b in base:
        reach = max(reach, b)
        covered.append(reach)  # the furthest end of all spans up to this one
    at, out = 0, []
    for a, k, b in others:
        while at < len(base) and base[at][0] < b:
            at += 1
        if not at or covered[at - 1] <= a:
            out.append((a, k, b))
    return out
