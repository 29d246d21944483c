"""One-permutation MinHash signatures and exact set comparison, on flat arrays."""

from __future__ import annotations

import numpy as np

from mailgrain.llm import arrays as A

U64 = np.uint64


def probes(bins: int, seed: int = 7) -> np.ndarray:
    """For every bin the order in which an empty bin looks for a full one. Each order is a random
    permutation, so some full bin is always reached."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(bins) for _ in range(bins)], axis=1)


def signatures(values: np.ndarray, starts: np.ndarray, bins: int, order: np.ndarray) -> np.ndarray:
    """One permutation: the hash range is cut into ``bins`` and each bin keeps its smallest hash.

    Empty bins are filled by optimal densification: bin i copies the first full bin of its own probe
    order, the same order in every text. ``values`` must be distinct and ascending within a row.
    Rows without values stay zero.
    """
    rows = len(starts) - 1
    row = A.rows_of(starts)
    bin_of = (((values >> U64(32)) * U64(bins)) >> U64(32)).astype(np.int64)
    first = np.ones(len(values), bool)
    first[1:] = (bin_of[1:] != bin_of[:-1]) | (row[1:] != row[:-1])
    sketch, full = np.zeros((rows, bins), U64), np.zeros((rows, bins), bool)
    sketch[row[first], bin_of[first]] = values[first]
    full[row[first], bin_of[first]] = True
    which, slot = np.nonzero(~full & full.any(axis=1)[:, None])
    for attempt in range(bins):
        if not len(which):
            break
        source = order[attempt, slot]
        found = full[which, source]
        sketch[which[found], slot[found]] = sketch[which[found], source[found]]
        which, slot = which[~found], slot[~found]
    return sketch


def band_keys(sketch: np.ndarray, rows_per_band: int) -> np.ndarray:
    """One 64-bit key per band of a signature; keys of different bands never meet."""
    n, bins = sketch.shape
    parts = sketch.reshape(n, bins // rows_per_band, rows_per_band)
    key = np.broadcast_to(A.mix(np.arange(1, parts.shape[1] + 1, dtype=U64)), parts.shape[:2]).copy()
    for k in range(rows_per_band):
        key = A.mix(key * U64(0x9FB21C651E98DF25) + parts[:, :, k])
    return key


def text_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, starts = A.words(data, offsets, lower=True)
    return A.distinct_sorted(*A.shingles(hashes, starts, width))


def set_codes(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set."""
    return (
        A.row_sums(A.mix(values ^ U64(0x5851F42D4C957F2D)), starts),
        A.row_sums(A.mix(values + U64(0x14057B7EF767814F)), starts),
    )


def describe(batches, width: int, bins: int, rows_per_band: int, limit: int):
    """Arrow batches (id, text key, text) to (id, text key, set size, 128-bit set name, band keys)."""
    import pyarrow as pa

    order = probes(bins)
    for batch in batches:
        for first, last, data, offsets in A.text_slices(batch.column(2), limit):
            values, starts = text_sets(data, offsets, width)
            keys = band_keys(signatures(values, starts, bins, order), rows_per_band).view(np.int64)
            one, two = (x.view(np.int64) for x in set_codes(values, starts))
            per = np.where(np.diff(starts) > 0, keys.shape[1], 0)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(per))), pa.int32()), pa.array(keys[per > 0].ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(first, last - first) for k in (0, 1)), pa.array(np.diff(starts)), pa.array(one), pa.array(two), lists],
                ["doc_id", "text_key", "n_shingles", "set_one", "set_two", "bands"],
            )


def common(values_a, starts_a, values_b, starts_b) -> np.ndarray:
    """Size of the intersection of row i of one side with row i of the other."""
    rows = len(starts_a) - 1
    row = np.concatenate((A.rows_of(starts_a), A.rows_of(starts_b)))
    values = np.concatenate((values_a, values_b))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    same = (values[1:] == values[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row[1:][same], minlength=rows)


def compare(batches, width: int, per_cent: int, limit: int):
    """Arrow batches (a, b, text_a, text_b) to (a, b, size of the intersection of the full sets, similar enough)."""
    import pyarrow as pa

    for batch in batches:
        left, right = A.utf8(batch.column(2)), A.utf8(batch.column(3))
        for first, last in A.slices(np.diff(left[1]) + np.diff(right[1]), limit):
            sets = []
            for data, offsets in (left, right):
                part = offsets[first : last + 1]
                sets.append(text_sets(data[part[0] : part[-1]], part - part[0], width))
            (va, sa), (vb, sb) = sets
            both = common(va, sa, vb, sb)
            union = np.diff(sa) + np.diff(sb) - both
            linked = (union > 0) & (100 * both >= per_cent * union)
            ends = [batch.column(k).slice(first, last - first) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ends, pa.array(both), pa.array(linked)], ["a", "b", "both", "linked"])


def members(batches, width: int, limit: int):
    """Arrow batches (node, text) to (node, shingle), one row per distinct shingle."""
    import pyarrow as pa

    for batch in batches:
        for first, last, data, offsets in A.text_slices(batch.column(1), limit):
            values, starts = text_sets(data, offsets, width)
            node = batch.column(0).slice(first, last - first).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[A.rows_of(starts)]), pa.array(values.view(np.int64))], ["node", "shingle"]
            )
