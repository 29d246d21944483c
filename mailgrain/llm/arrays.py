"""Texts as flat numpy arrays: no Python loop runs over words or characters."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_POWERS: dict[str, np.ndarray] = {}
SEPARATORS = (0x20, *range(0x09, 0x0E))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept for later calls."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        inverse = U64(pow(int(_BASE), -1, 2**64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any stretch follows; one longer than ``codes``."""
    up, _ = powers(len(codes) + 1)
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * up[:-1], out=out[1:])
    return out


def stretch_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``codes[start:end]``, a short stretch; equal stretches are equal wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(0xD1342543DE82EF95))


#: Stretches of more units than this are told apart by a digest: the sums alone do not tell some long regular ones apart.
LONG = 32


def hashed(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches ``codes[start:end]``, of any length. Long ones are rare, and their bytes are read once."""
    out = stretch_hash(prefix_hash(codes), start, end)
    for i in np.flatnonzero(end - start > LONG).tolist():
        digest = blake2b(codes[start[i] : end[i]].tobytes(), digest_size=8).digest()
        out[i] = U64(int.from_bytes(digest, "little"))
    return out


_BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def _tables(lower: bool) -> tuple[np.ndarray, np.ndarray]:
    separator = np.zeros(256, bool)
    separator[list(SEPARATORS)] = True
    codes = _BYTE_CODES.copy()
    if lower:
        codes[65:91] = codes[97:123]
    return separator, codes


_PLAIN, _LOWER = _tables(False), _tables(True)


def slices(lengths: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Cut rows into runs of at most ``limit`` units; a longer row is a run of its own."""
    out, start, held = [], 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > limit:
            out.append((start, i))
            start, held = i, 0
        held += n
    out.append((start, len(lengths)))
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts ``data[offsets[i]:offsets[i + 1]]`` (UTF-8 bytes), and where each
    text's words start in that list. Words are runs of anything but ASCII white space."""
    separator, codes = _LOWER if lower else _PLAIN
    n = len(data)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    start = np.flatnonzero(inside & (first[:-1] | ~before))
    after = np.concatenate((inside[1:], [False]))
    end = np.flatnonzero(inside & (first[1:] | ~after)) + 1
    hashes = hashed(codes[data], start, end)
    return hashes, np.searchsorted(start, offsets).astype(np.int64)


def rows_of(starts: np.ndarray) -> np.ndarray:
    """Row number of every item, from the rows' starts (one more than rows)."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def shingles(hashes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all stretches of ``width`` words, and their starts by text. A text of fewer words is one
    shingle as a whole; a text without words has none."""
    counts = np.diff(starts)
    per = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_starts = np.concatenate(([0], np.cumsum(per)))
    row = rows_of(out_starts)
    first = starts[:-1][row] + (np.arange(len(row)) - out_starts[:-1][row])
    length = np.minimum(counts, width)[row]
    total = np.zeros(len(row), U64)
    for k in range(width):
        here = k < length
        at = np.where(here, first + k, 0)
        term = mix(hashes[at] + U64((0x632BE59BD9B4E019 * (k + 1)) % 2**64)) if len(hashes) else total
        total += np.where(here, term, U64(0))
    return mix(total + length.astype(U64)), out_starts


def distinct_sorted(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and their starts."""
    row = rows_of(starts)
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    counts = np.bincount(row[keep], minlength=len(starts) - 1)
    return values[keep], np.concatenate(([0], np.cumsum(counts)))


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each row's values modulo 2**64; empty rows give 0."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; a null counts as an empty text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return everything[starts[0] : starts[-1]] if len(starts) else everything, starts - starts[0]


def text_slices(column, limit: int):
    """Runs ``(first, last, data, offsets)`` of a string column of at most ``limit`` bytes each."""
    data, offsets = utf8(column)
    for first, last in slices(np.diff(offsets), limit):
        part = offsets[first : last + 1]
        yield first, last, data[part[0] : part[-1]], part - part[0]


def parts(data: np.ndarray, limit: int):
    """A text's bytes in parts of about ``limit`` that end behind a blank; one without blanks stays whole."""
    blank = np.zeros(256, bool)
    blank[list(SEPARATORS)] = True
    start = 0
    while len(data) - start > limit:
        cut = start + limit
        while cut < len(data):
            stop = np.flatnonzero(blank[data[cut : cut + limit]])
            if len(stop):
                cut += int(stop[0]) + 1
                break
            cut += limit
        if cut >= len(data):
            break
        yield data[start:cut]
        start = cut
    yield data[start:] if start else data
