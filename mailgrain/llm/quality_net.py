"""Random-indexing vectors, pooling and a two-layer network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from mailgrain.llm import arrays as A

U64 = np.uint64
#: Vectors are kept by hash bucket of the word, so their table has one size whatever the corpus.
BUCKETS, WIDTH, SPIKES = 1 << 14, 32, 4
FEATURES = 3 * WIDTH

_KIND = np.full(256, 3, np.uint8)
_KIND[list(A.SEPARATORS)] = 0
_KIND[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = 1
_KIND[48:58] = 2
_CODES = A.mix(np.arange(1, 257, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of letters, digits or marks, as written, and where each text's begin."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _KIND[data]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    word = kind[start] > 0
    start, end = start[word], end[word]
    hashes = A.hashed(_CODES[data], start, end)
    return (hashes >> U64(50)).astype(np.int64), np.searchsorted(start, offsets).astype(np.int64)


def spikes(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The index vector of every bucket: a few places with +1 or -1."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((BUCKETS, WIDTH)), axis=1)[:, :SPIKES]
    return places, rng.choice([-1.0, 1.0], (BUCKETS, SPIKES))


def contexts(data: np.ndarray, offsets: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sum, for each bucket, of the index vectors of its neighbours left and right."""
    bucket, starts = tokens(data, offsets)
    row = A.rows_of(starts)
    left = np.flatnonzero(row[1:] == row[:-1]) if len(row) > 1 else np.zeros(0, np.int64)
    own = np.concatenate((bucket[left], bucket[left + 1])) if len(left) else left
    other = np.concatenate((bucket[left + 1], bucket[left])) if len(left) else left
    at = own[:, None] * WIDTH + places[other]
    return np.bincount(at.ravel(), signs[other].ravel(), BUCKETS * WIDTH).astype(np.int64)


def gathered(batches, block: int, limit: int):
    """Arrow batches (text) to one row per block of the task's sums: (task, block, sums)."""
    import pyarrow as pa
    from pyspark import TaskContext

    places, signs = spikes()
    total = np.zeros(BUCKETS * WIDTH, np.int64)
    for batch in batches:
        for _, _, data, offsets in A.text_slices(batch.column(0), limit):
            for part in A.parts(data, limit) if len(offsets) == 2 else [data]:
                total += contexts(part, offsets if part is data else np.array([0, len(part)]), places, signs)
    parts = total.reshape(-1, block)
    some = np.flatnonzero(parts.any(axis=1))
    task = TaskContext.get().partitionId()
    for i in some:
        yield pa.RecordBatch.from_arrays(
            [pa.array([task], pa.int64()), pa.array([i], pa.int64()), pa.array([parts[i]], pa.list_(pa.int64()))],
            ["task", "block", "sums"],
        )


def added(keys, group):
    """Add up the blocks of one group: at most a bounded number of tasks' at first, then one per such group."""
    import pyarrow as pa

    sums = group.column("sums").combine_chunks()
    total = sums.flatten().to_numpy().reshape(len(sums), -1).sum(axis=0)
    names = [n for n in group.schema.names if n != "sums"]
    return pa.table([*(pa.array([k.as_py()], pa.int64()) for k in keys), pa.array([total], pa.list_(pa.int64()))], [*names, "sums"])


def vectors(total: np.ndarray) -> np.ndarray:
    """Word vectors: the sums by bucket, each of length 1, around their mean direction."""
    table = total.reshape(BUCKETS, WIDTH).astype(np.float64)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return np.divide(table, norm, out=np.zeros_like(table), where=norm > 0).astype(np.float32)


@dataclass(frozen=True)
class Sums:
    """What the pools of texts are made of, by text; sums of a text's parts add up."""

    words: np.ndarray
    own: np.ndarray  # sums of the words' vectors, of their squares, and of the products of neighbours
    square: np.ndarray
    product: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Sums:
        bucket, starts = tokens(data, offsets)
        counts = np.diff(starts)
        own, square, product = (np.zeros((len(counts), WIDTH)) for _ in range(3))
        some = np.flatnonzero(counts > 0)
        if len(some):
            begin, vector = starts[:-1][some], table[bucket]
            own[some] = np.add.reduceat(vector, begin, axis=0, dtype=np.float64)
            square[some] = np.add.reduceat(vector * vector, begin, axis=0, dtype=np.float64)
            vector[:-1] *= vector[1:]
            vector[starts[1:][some] - 1] = 0.0
            product[some] = np.add.reduceat(vector, begin, axis=0, dtype=np.float64)
        return cls(counts, own, square, product)

    def plus(self, other: Sums) -> Sums:
        return Sums(self.words + other.words, self.own + other.own, self.square + other.square, self.product + other.product)

    def pools(self) -> np.ndarray:
        """Per text the mean and spread of its words' vectors, and the mean product of neighbours; a text without
        words has zeros."""
        n = np.maximum(self.words, 1)[:, None].astype(np.float64)
        mean = self.own / n
        spread = np.sqrt(np.maximum(self.square / n - mean * mean, 0.0))
        return np.concatenate((mean, spread, self.product / np.maximum(n - 1, 1)), axis=1)


def pooled(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, limit: int = 1 << 62) -> np.ndarray:
    """The pools of all texts. A text alone that is longer than ``limit`` bytes is summed up in parts that end at a blank; the
    words on either side of such an end do not count as neighbours."""
    if len(offsets) != 2 or len(data) <= limit:
        return Sums.of(data, offsets, table).pools()
    total = None
    for part in A.parts(data, limit):
        sums = Sums.of(part, np.array([0, len(part)]), table)
        total = total.plus(sums) if total else sums
    return total.pools()


def features(batches, table: np.ndarray, limit: int):
    """Arrow batches whose last column is the text to the other columns and the pooled vector."""
    import pyarrow as pa

    for batch in batches:
        names = batch.schema.names[:-1]
        for first, last, data, offsets in A.text_slices(batch.column(len(names)), limit):
            pool = pooled(data, offsets, table, limit)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(pool.ravel()), FEATURES).cast(pa.list_(pa.float64()))
            rest = [batch.column(c).slice(first, last - first) for c in names]
            yield pa.RecordBatch.from_arrays([*rest, lists], [*names, "pool"])


@dataclass(frozen=True)
class Net:
    centre: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.centre) / self.scale @ self.hidden + self.hidden_bias, 0.0)
        return h @ self.out + self.out_bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logit(x) / self.temperature)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, units: int = 32, epochs: int = 60, seed: int = 5) -> Net:
    """Adam on the log loss over four fifths of the rows; the temperature is the one that gives the rest the
    smallest log loss. Without rows of both labels the score is the share of label 1, or a half."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    if len(np.unique(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        zero = np.zeros((width, units))
        return Net(np.zeros(width), np.ones(width), zero, np.zeros(units), np.zeros(units), bias, 1.0)
    order = rng.permutation(len(x))
    cut = max(1, len(x) // 5)
    held, used = order[:cut], order[cut:]
    centre, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
    a = (x - centre) / scale
    w = [rng.normal(0, np.sqrt(2 / width), (width, units)), np.zeros(units), rng.normal(0, np.sqrt(1 / units), units), np.zeros(1)]
    m, s = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    step, size = 0, min(256, max(8, len(used) // 8))
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs) + 1e-4
        mixed = rng.permutation(used)
        for i in range(0, len(mixed), size):
            batch = mixed[i : i + size]
            before = a[batch] @ w[0] + w[1]
            h = np.maximum(before, 0)
            d = (sigmoid(h @ w[2] + w[3]) - y[batch]) / len(batch)
            dh = np.outer(d, w[2]) * (before > 0)
            grads = [a[batch].T @ dh + 1e-4 * w[0], dh.sum(axis=0), h.T @ d + 1e-4 * w[2], np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    net = Net(centre, scale, w[0], w[1], w[2], float(w[3][0]), 1.0)
    z, truth = net.logit(x[held]), y[held]
    candidates = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    p = np.clip(sigmoid(z[None, :] / candidates[:, None]), 1e-12, 1 - 1e-12)
    loss = -(truth * np.log(p) + (1 - truth) * np.log(1 - p)).mean(axis=1)
    best = float(candidates[int(np.argmin(loss))])
    return Net(centre, scale, w[0], w[1], w[2], float(w[3][0]), best)


def scored(batches, table: np.ndarray, weights: dict, keep: list[str], limit: int):
    """Arrow batches with a column ``text`` to the columns ``keep`` and the score."""
    import pyarrow as pa

    net = Net(**weights)
    for batch in batches:
        for first, last, data, offsets in A.text_slices(batch.column("text"), limit):
            score = np.round(net.score(pooled(data, offsets, table, limit)), 6)
            rest = [batch.column(c).slice(first, last - first) for c in keep]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(score)], [*keep, "score"])
