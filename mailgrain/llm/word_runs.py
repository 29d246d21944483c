"""Buckets of a text's runs of words, by the CRC of each run in the separator-normalised stream."""

from __future__ import annotations

import numpy as np

from mailgrain.llm import arrays as A
from mailgrain.llm.prefix_crc import Running, stretch_crc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, letters and everything beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts in lower case with one space behind each, where each word starts and ends there, and
    each text's first word."""
    inside = _WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    opens = inside.copy()
    opens[1:] &= first[1:-1] | ~inside[:-1]
    at = np.flatnonzero(opens)
    kept = np.flatnonzero(inside)
    word = np.cumsum(opens)[kept] - 1
    length = np.bincount(word, minlength=len(at))
    end = np.cumsum(length + 1) - 1
    stream = np.full(len(kept) + len(at), 0x20, np.uint8)
    stream[np.arange(len(kept)) + word] = _LOWER[data[kept]]
    return stream, end - length, end, np.searchsorted(at, offsets).astype(np.int64)


def runs(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each number of words from 1 to ``longest``: the runs' buckets, their texts, and their last word's place
    in its text."""
    stream, start, end, texts = normalised(data, offsets)
    running, text = Running(stream), A.rows_of(texts)
    place = np.arange(len(text)) - texts[:-1][text]
    out = []
    for n in range(1, longest + 1):
        last = np.flatnonzero(place >= n - 1)
        crc = stretch_crc(running, start[last - n + 1], end[last])
        out.append(((crc % np.uint32(buckets)).astype(np.int64), text[last], place[last]))
    return out


def _context(part: np.ndarray, words: int) -> np.ndarray:
    """The last so many words of a part, with a space behind each."""
    stream, start, _, _ = normalised(part, np.array([0, len(part)]))
    return stream[start[-min(words, len(start))] :] if words and len(start) else stream[:0]


def measured(column, longest: int, buckets: int, limit: int):
    """``(first row, number of rows, buckets, rows, number of words by row)`` for runs of rows of a string column. A row longer than ``limit`` bytes comes in
    parts, each beginning with the words that runs from the part before reach back to."""
    for first, last, data, offsets in A.text_slices(column, limit):
        long = last == first + 1 and len(data) > limit
        before = data[:0]
        for part in A.parts(data, limit) if long else [data]:
            known = normalised(before, np.array([0, len(before)]))[1]
            whole = np.concatenate((before, part)) if len(before) else part
            bounds = np.array([0, len(whole)]) if long else offsets
            found = [(b[p >= len(known)], t[p >= len(known)]) for b, t, p in runs(whole, bounds, longest, buckets)]
            yield first, last - first, np.concatenate([b for b, _ in found]), np.concatenate([t for _, t in found]), np.bincount(found[0][1], minlength=last - first)
            if long and longest > 1:
                before = _context(whole, longest - 1)


def counted(batches, longest: int, buckets: int, limit: int):
    """Arrow batches (text) to one row for each bucket that the task has seen: (bucket, n)."""
    import pyarrow as pa

    total = np.zeros(buckets, np.int64)
    for batch in batches:
        for _, _, bucket, _, _ in measured(batch.column(0), longest, buckets, limit):
            total += np.bincount(bucket, minlength=buckets)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])


def weighed(batches, gains: np.ndarray, longest: int, limit: int):
    """Arrow batches (doc_id, text) to (doc_id, n_features, n_words, weight)."""
    import pyarrow as pa

    for batch in batches:
        n_features, n_words, weight = (np.zeros(len(batch), np.int64) for _ in range(3))
        for first, rows, bucket, row, words in measured(batch.column(1), longest, len(gains), limit):
            here = slice(first, first + rows)
            n_features[here] += np.bincount(row, minlength=rows)
            n_words[here] += words
            np.add.at(weight, row + first, gains[bucket])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_features), pa.array(n_words), pa.array(weight)], ["doc_id", "n_features", "n_words", "weight"]
        )
