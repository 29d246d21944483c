"""Exact integer inner products, several candidates at a time, and the best few of each query.

Kronecker packing: candidates' components are made non-negative and put into separate bit fields of one wide integer, so
that one product with an anchor's component multiplies them all. The fields are wide enough for the whole sum, so no
carry crosses them, and the scores are unpacked exactly. The wide integers have at most 53 bits, as many as a double
holds exactly, so numpy's matrix product does the multiplying.
"""

from __future__ import annotations

import numpy as np

WIDE_BITS = 53
ANCHOR_TILE, ROW_TILE = 256, 2048
LOWEST = np.int64(-(2**63))


def dense(lists, width: int) -> np.ndarray:
    """An Arrow list column of integers as a matrix; shorter rows end in zeros, longer ones are cut at ``width``."""
    counts = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    if len(values) == out.size and (counts == width).all():
        return values.reshape(out.shape)
    row = np.repeat(np.arange(len(lists)), counts)
    column = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    inside = column < width
    out[row[inside], column[inside]] = values[inside]
    return out


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of all anchors with all rows, as 64-bit numbers (modulo 2**64 where they pass those)."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    low_a, low_r = int(anchors.min()), int(rows.min())
    most = anchors.shape[1] * (int(anchors.max()) - low_a) * (int(rows.max()) - low_r)
    bits = max(1, most.bit_length())
    fields = WIDE_BITS // bits
    if not fields or max(abs(low_a), abs(low_r)) >= 2**WIDE_BITS:
        return anchors @ rows.T
    a, r = anchors - low_a, rows - low_r
    per = -(-len(rows) // fields)
    wide = np.zeros((per, rows.shape[1]))
    for f in range(fields):
        part = r[f * per : (f + 1) * per]
        wide[: len(part)] += part * float(2 ** (bits * f))
    product = (a.astype(np.float64) @ wide.T).astype(np.int64)
    mask = np.int64(2**bits - 1)
    out = np.concatenate([(product >> np.int64(bits * f)) & mask for f in range(fields)], axis=1)[:, : len(rows)]
    out += low_r * a.sum(axis=1)[:, None]
    out += low_a * r.sum(axis=1)[None, :] + anchors.shape[1] * low_a * low_r
    return out


class Best:
    """For each query the first ``k`` candidates so far, by score from the highest and id from the lowest."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, LOWEST)
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        if not len(query):
            return
        query, score, id = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, id)))
        order = np.lexsort((id, ~score, query))
        query, score, id = query[order], score[order], id[order]
        counts = np.bincount(query, minlength=len(self.floor))
        starts = np.cumsum(counts) - counts
        keep = np.arange(len(query)) - starts[query] < self.k
        full = np.flatnonzero(counts >= self.k)
        self.floor[full] = score[starts[full] + self.k - 1]
        self.query, self.score, self.id = query[keep], score[keep], id[keep]


def _split(batches):
    """A stream of (kind, id, label, vec, ...) with all anchors first: the anchors' columns, then the other rows'."""
    import pyarrow as pa

    held, rest = [], None
    for batch in batches:
        n = int((batch.column("kind").to_numpy(zero_copy_only=False) == 0).sum())
        held.append(batch.slice(0, n))
        if n < len(batch):
            rest = batch.slice(n)
            break
    table = pa.Table.from_batches(held) if held else None

    def others():
        if rest is not None:
            yield rest
        yield from batches

    return table, others()


def _numbers(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy() if hasattr(batch, "to_batches") else batch.column(name).to_numpy(zero_copy_only=False)


def _tiles(batches, matrix: np.ndarray):
    """Scores of a tile of anchors against a tile of rows: (first anchor, scores, ids and labels of the rows)."""
    for batch in batches:
        ids, labels = _numbers(batch, "id"), _numbers(batch, "label")
        for b in range(0, len(batch), ROW_TILE):
            rows = dense(batch.column("vec").slice(b, ROW_TILE), matrix.shape[1])
            for a in range(0, len(matrix), ANCHOR_TILE):
                yield a, products(matrix[a : a + ANCHOR_TILE], rows), ids[b : b + ROW_TILE], labels[b : b + ROW_TILE]


def _matrix(table) -> np.ndarray:
    lists = table.column("vec").combine_chunks()
    return dense(lists, max([1, *lists.value_lengths().to_pylist()]))


def positives(batches, k: int):
    """Each anchor's first ``k`` other rows of its label among the rows of this stream: (anchor_id, score, id)."""
    import pyarrow as pa

    table, others = _split(iter(batches))
    if table is None or not len(table):
        return
    matrix, own, label = _matrix(table), _numbers(table, "id"), _numbers(table, "label")
    best = Best(len(own), k)
    for a, scores, ids, labels in _tiles(others, matrix):
        here = slice(a, a + len(scores))
        good = (label[here, None] == labels) & (own[here, None] != ids) & (scores >= best.floor[here, None])
        query, row = np.nonzero(good)
        best.add(query + a, scores[query, row], ids[row])
    yield pa.RecordBatch.from_arrays([pa.array(own[best.query]), pa.array(best.score), pa.array(best.id)], ["anchor_id", "score", "id"])


def negatives(batches, k: int, low: int, high: int):
    """For each anchor and positive the first ``k`` rows of other labels whose score lies between the given percentages of the
    positive's: (anchor_id, positive_id, positive_score, score, id)."""
    import pyarrow as pa

    table, others = _split(iter(batches))
    if table is None or not len(table):
        return
    matrix, own, label = _matrix(table), _numbers(table, "id"), _numbers(table, "label")
    wanted = table.column("wanted").combine_chunks()
    counts = wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    pairs = wanted.flatten()
    anchor, starts = np.repeat(np.arange(len(own)), counts), np.concatenate(([0], np.cumsum(counts)))
    positive = pairs.field("id").to_numpy(zero_copy_only=False)
    given = pairs.field("score").to_pylist()
    # Python's integers, since a multiple of a score may pass 64 bits.
    bottom = np.array([max(-(-low * s // 100), -(2**63)) for s in given], np.int64)
    top = np.array([min(high * s // 100, 2**63 - 1) for s in given], np.int64)
    best = Best(len(anchor), k)
    for a, scores, ids, labels in _tiles(others, matrix):
        here = slice(starts[a], starts[min(a + len(scores), len(own))])
        mine = anchor[here]
        each = scores[mine - a]
        good = (each >= np.maximum(bottom, best.floor)[here, None]) & (each <= top[here, None]) & (label[mine, None] != labels)
        query, row = np.nonzero(good)
        best.add(query + here.start, each[query, row], ids[row])
    q = best.query
    yield pa.RecordBatch.from_arrays(
        [pa.array(own[anchor[q]]), pa.array(positive[q]), pa.array(np.array(given, np.int64)[q]), pa.array(best.score), pa.array(best.id)],
        ["anchor_id", "positive_id", "positive_score", "score", "id"],
    )
