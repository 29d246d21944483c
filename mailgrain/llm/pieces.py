"""Text to vocabulary pieces on flat arrays: merge counting and lattice sampling.

A text becomes one array of code points with a space mark before it, as the vocabulary expects. Pieces
never run past a space mark that follows another character, nor over a character the vocabulary lacks, so
the text falls into pre-tokens that are worked out once however often they occur in a batch.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from heapq import heapify, heappop, heappush

import numpy as np

from mailgrain.llm import arrays as A

U64 = np.uint64
MARK = 0x2581
NO_RANK = np.int64(2**62)


@dataclass(frozen=True)
class Vocabulary:
    """Arrays made from a public vocabulary file; their size is bounded by the file's."""

    char_id: np.ndarray  # by code point; -1: spelled as bytes
    pair_key: np.ndarray  # left id * number of ids + right id, ascending
    pair_piece: np.ndarray
    rank: np.ndarray  # of a piece; a lower one merges first
    together: np.ndarray  # a piece whose merges in one sequence cannot get in each other's way
    size: int
    longest_run: int  # of space marks in one piece
    run_tokens: np.ndarray  # tokens of a run of fewer space marks than that
    piece_hash: np.ndarray  # ascending
    prefix_seen: np.ndarray  # by the first 20 bits of a hash
    piece_of_hash: np.ndarray
    log_weight: np.ndarray
    longest: int
    piece_bytes: np.ndarray  # all pieces' bytes in a row, the space mark as a space
    piece_start: np.ndarray
    byte_id: np.ndarray

    def pairs(self) -> dict[int, int]:
        """The piece by pair key."""
        return dict(zip(self.pair_key.tolist(), self.pair_piece.tolist(), strict=True))


def load(path: str) -> Vocabulary:
    """Read a merge vocabulary with byte pieces. Weights for sampling fall with the piece's place, as 1 / place."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    name = [model.id_to_piece(i) for i in range(size)]
    special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(size)]
    ids = {name[i]: i for i in range(size) if not special[i]}
    scores = np.array([model.get_score(i) for i in range(size)])
    order = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
    char_id = np.full(0x110000, -1, np.int32)
    pairs, lowest_above = {}, np.full(size, NO_RANK)
    for text, i in ids.items():
        if len(text) == 1:
            char_id[ord(text)] = i
        for k in range(1, len(text)):
            left, right = ids.get(text[:k]), ids.get(text[k:])
            if left is not None and right is not None:
                pairs[left * size + right] = i
            for part in (left, right):
                if part is not None:
                    lowest_above[part] = min(lowest_above[part], order[i])
    char_id[ord(" ")] = char_id[MARK]
    keys = np.array(sorted(pairs), np.int64)
    own_rank = np.bincount(order, minlength=order.max() + 1)[order] == 1
    normal = sorted(ids.values())
    codes = [np.array([char_id[ord(c)] for c in name[i]], np.int64) for i in normal]
    flat = np.concatenate(codes)
    ends = np.cumsum([len(c) for c in codes])
    hashes = A.stretch_hash(A.prefix_hash(symbol_codes(flat)), ends - [len(c) for c in codes], ends)
    by_hash = np.argsort(hashes)
    place = np.full(size, 1.0)
    place[normal] = 1.0 + np.argsort(np.argsort(order[normal], kind="stable"))
    byte_id = np.zeros(256, np.int64)
    spelled = []
    for i in range(size):
        if model.is_byte(i):
            value = int(name[i][3:5], 16)
            byte_id[value] = i
            spelled.append(bytes([value]))
        else:
            spelled.append(name[i].replace("▁", " ").encode())
    vocabulary = Vocabulary(
        run_tokens=np.zeros(1, np.int64),
        char_id=char_id,
        pair_key=keys,
        pair_piece=np.array([pairs[k] for k in keys.tolist()], np.int64),
        rank=order,
        together=(lowest_above > order) & own_rank,
        size=size,
        longest_run=max((len(p) for p in ids if not p.strip("▁")), default=1),
        piece_hash=hashes[by_hash],
        prefix_seen=np.bincount((hashes >> U64(44)).astype(np.int64), minlength=1 << 20) > 0,
        piece_of_hash=np.array(normal, np.int64)[by_hash],
        log_weight=-np.log(place + 10.0),
        longest=max(map(len, ids)),
        piece_bytes=np.frombuffer(b"".join(spelled), np.uint8),
        piece_start=np.concatenate(([0], np.cumsum([len(b) for b in spelled]))),
        byte_id=byte_id,
    )
    short = np.arange(1, vocabulary.longest_run)
    runs = merge(np.full(short.sum(), char_id[MARK]), np.concatenate(([0], np.cumsum(short))), vocabulary)[0]
    return replace(vocabulary, run_tokens=np.concatenate(([0], runs)))


def symbol_codes(ids: np.ndarray) -> np.ndarray:
    return A.mix(ids.astype(U64) + U64(1)) | U64(1)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each non-empty one behind a space mark; starts of the texts."""
    marked = ["▁" + t if t else "" for t in texts]
    flat = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    return flat, np.concatenate(([0], np.cumsum([len(t) for t in marked]))).astype(np.int64)


def utf8_length(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int64)


def pretokens(ids: np.ndarray, starts: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches no piece crosses; characters without an id are in none."""
    known = ids >= 0
    is_mark = ids == mark
    first = np.zeros(len(ids) + 1, bool)
    first[starts] = True
    first = first[:-1]
    first[1:] |= ~known[:-1] | (is_mark[1:] & ~is_mark[:-1])
    start = np.flatnonzero(first & known)
    last = np.ones(len(ids), bool)
    last[:-1] = first[1:] | ~known[1:]
    return start, np.flatnonzero(last & known) + 1


def ragged(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all items of the stretches, one after the other, and where each stretch begins."""
    offsets = np.concatenate(([0], np.cumsum(length)))
    return np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1]), offsets


#: Longer sequences are merged place by place: in step, each of their many rounds would pass over all of them.
LONG = 256


def merge(symbols: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence to its end: symbols left, and whether the first one is still a lone space mark."""
    length = np.diff(offsets)
    long = length > LONG
    if not long.any():
        return merge_in_step(symbols, offsets, v)
    left_over, alone = np.zeros(len(length), np.int64), np.zeros(len(length), bool)
    short = np.flatnonzero(~long)
    at, starts = ragged(offsets[:-1][short], length[short])
    left_over[short], alone[short] = merge_in_step(symbols[at], starts, v)
    for i in np.flatnonzero(long).tolist():
        left_over[i], alone[i] = merge_long(symbols[offsets[i] : offsets[i + 1]], v)
    return left_over, alone


def merge_long(symbols: np.ndarray, v: Vocabulary) -> tuple[int, bool]:
    """Merge one sequence, the lowest rank and then the leftmost place first, from a heap of all places where a pair
    stands. A merge touches only the two pairs beside it, so the time is about in proportion to the length."""
    n = len(symbols)
    at, good = _pairs(symbols[:-1].astype(np.int64), symbols[1:].astype(np.int64), v)
    piece = v.pair_piece[at]
    wanted = [*np.where(good, piece, -1).tolist(), -1]  # by place: the piece that this and the next symbol make
    own, rank, find = symbols.tolist(), v.rank.tolist(), v.pairs()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = ((v.rank[piece[good]] << 32) | np.flatnonzero(good)).tolist()
    heapify(heap)
    left = n
    while heap:
        entry = heappop(heap)
        i = entry & 0xFFFFFFFF
        new = wanted[i]
        if new < 0 or rank[new] != entry >> 32:
            continue
        j = after[i]
        k, own[i], wanted[j] = after[j], new, -1
        after[i] = k
        left -= 1
        wanted[i] = -1
        if k < n:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b < n:
                wanted[a] = made = find.get(own[a] * v.size + own[b], -1)
                if made >= 0:
                    heappush(heap, rank[made] << 32 | a)
    return left, own[0] == v.char_id[MARK]


def _pairs(left: np.ndarray, right: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Where the pairs stand in the vocabulary's list, and which of them stand there."""
    keys = left * v.size + right
    at = np.minimum(np.searchsorted(v.pair_key, keys), len(v.pair_key) - 1)
    return at, v.pair_key[at] == keys


def merge_in_step(symbols: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence to its end: symbols left, and whether the first one is still a lone space mark.

    All sequences work in step. In each round a sequence merges its pair of lowest rank: every place of it,
    left to right, where that is the same as one at a time, else the leftmost place.
    """
    n = len(offsets) - 1
    left_over, alone = np.zeros(n, np.int64), np.zeros(n, bool)
    active = np.arange(n)
    mark = v.char_id[MARK]
    symbols = symbols.astype(np.int64)
    while len(active):
        row = A.rows_of(offsets)
        rank = np.full(len(symbols), NO_RANK)
        if len(symbols) > 1:
            at, good = _pairs(symbols[:-1], symbols[1:], v)
            good &= row[:-1] == row[1:]
            piece = np.concatenate((v.pair_piece[at], [0]))
            rank[:-1][good] = v.rank[piece[:-1][good]]
        else:
            piece = np.zeros(len(symbols), np.int64)
        best = np.minimum.reduceat(rank, offsets[:-1])
        done = best == NO_RANK
        if done.any():
            left_over[active[done]] = np.diff(offsets)[done]
            alone[active[done]] = symbols[offsets[:-1][done]] == mark
        hit = np.flatnonzero((rank == best[row]) & ~done[row])
        if not len(hit):
            break
        run = np.ones(len(hit), bool)
        run[1:] = hit[1:] != hit[:-1] + 1
        since = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        leftmost = np.ones(len(hit), bool)
        leftmost[1:] = row[hit[1:]] != row[hit[:-1]]
        hit = hit[np.where(v.together[piece[hit]], since % 2 == 0, leftmost)]
        symbols[hit] = piece[hit]
        keep = ~done[row]
        keep[hit + 1] = False
        counts = np.bincount(row[keep], minlength=len(active))[~done]
        symbols, active = symbols[keep], active[~done]
        offsets = np.concatenate(([0], np.cumsum(counts)))
    return left_over, alone


class Known:
    """Counts of pre-tokens seen before, for the length of a task; forgotten when they fill the limit."""

    def __init__(self, limit: int):
        self.limit, self.keys, self.values = limit, np.zeros(0, U64), np.zeros(0, np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[at] == keys, self.values[at]

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.limit:
            self.keys, self.values = keys[: self.limit], values[: self.limit]
        else:
            keys, values = np.concatenate((self.keys, keys)), np.concatenate((self.values, values))
            order = np.argsort(keys)
            self.keys, self.values = keys[order], values[order]


def count_tokens(texts: list[str | None], v: Vocabulary, known: Known) -> np.ndarray:
    """Number of tokens of each text, as merging the whole text would give."""
    points, starts = code_points(texts)
    if not len(points):
        return np.zeros(len(texts), np.int64)
    ids = v.char_id[points]
    mark = v.char_id[MARK]
    total = np.zeros(len(points) + 1, np.int64)
    lacking = ids < 0
    np.cumsum(np.where(lacking, utf8_length(points), 0), out=total[1:])
    out = total[starts[1:]] - total[starts[:-1]]
    first, last = pretokens(ids, starts, mark)
    text = np.searchsorted(starts, first, side="right") - 1
    # Merges within a run of space marks come last, all of one rank, from the left: whole pieces of the longest
    # kind, then the rest. So a run is counted apart from the last mark, which may belong to the word.
    marks = np.concatenate(([0], np.cumsum(ids == mark)))
    run = marks[last] - marks[first]
    begin = first + np.maximum(run - 1, 0)
    hashes = A.hashed(symbol_codes(ids), begin, last)
    kinds, example, which = np.unique(hashes, return_index=True, return_inverse=True)
    have, value = known.get(kinds)
    new = np.flatnonzero(~have)
    if len(new):
        at, offsets = ragged(begin[example[new]], (last - begin)[example[new]])
        left_over, alone = merge(ids[at], offsets, v)
        value[new] = left_over * 2 + alone
        known.put(kinds[new], value[new])
    tokens, alone = value[which] >> 1, value[which] & 1
    spaces = np.where(run > 1, run - 1 + alone, 0)
    tokens = tokens - np.where(run > 1, alone, 0) + spaces // v.longest_run + v.run_tokens[spaces % v.longest_run]
    return out + np.bincount(text, tokens, len(texts)).astype(np.int64)


def counted(batches, vocabulary, limit: int, cache: int):
    """Arrow batches (id, text) to (id, bytes, number of tokens)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    v, known = Vocabulary(**vocabulary.value), Known(cache)
    for batch in batches:
        texts = batch.column(1).to_pylist()
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        tokens = [count_tokens(texts[a:b], v, known) for a, b in A.slices(lengths, limit)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lengths, pa.int64()), pa.array(np.concatenate(tokens))], ["doc_id", "n_bytes", "n_tokens"]
        )


def _piece_at(hashes: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are those of pieces, and the pieces. Most are not; a bit per hash prefix drops them early."""
    maybe = np.flatnonzero(v.prefix_seen[(hashes >> U64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(v.piece_hash, hashes[maybe]), len(v.piece_hash) - 1)
    good = v.piece_hash[at] == hashes[maybe]
    return maybe[good], v.piece_of_hash[at[good]]


@dataclass(frozen=True)
class Lattice:
    """All pieces of a batch of sequences, those that end at one position side by side, shortest first."""

    first: np.ndarray  # by position: its first piece
    length: np.ndarray  # by piece
    piece: np.ndarray
    chance: np.ndarray  # of coming to the piece's end by it or a shorter one


def lattice(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary, sharpness: float) -> Lattice:
    """Forward filter: sum the weights of all ways to each position, all sequences in step."""
    n = len(ids)
    prefix = A.prefix_hash(symbol_codes(ids))
    place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))  # position within the sequence
    order = np.argsort(place, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    widest = min(v.longest, int(place.max()) + 1) if n else 0
    found = np.full((n, widest), -1, np.int32)
    for k in range(1, widest + 1):
        ends = np.flatnonzero(place >= k - 1)
        good, piece = _piece_at(A.stretch_hash(prefix, ends - k + 1, ends + 1), v)
        found[rank[ends[good]], k - 1] = piece
    at, length = np.nonzero(found >= 0)
    piece, length = found[at, length], length + 1
    counts = np.bincount(at, minlength=n)
    first = np.concatenate(([0], np.cumsum(counts)))
    weight = v.log_weight[piece] * sharpness
    before = order[at] - length
    chance = np.empty(len(piece))
    reach = np.zeros(n)  # log of the summed weights of all ways to fill the sequence up to and with a position
    bounds = np.concatenate(([0], np.cumsum(np.bincount(place)))) if n else np.zeros(1, np.int64)
    for step in range(len(bounds) - 1):
        here = slice(bounds[step], bounds[step + 1])
        some = slice(first[bounds[step]], first[bounds[step + 1]])
        begin, per = first[here] - some.start, counts[here]
        ways = weight[some] + np.where(length[some] == step + 1, 0.0, reach[before[some]])
        top = np.maximum.reduceat(ways, begin)
        share = np.exp(ways - np.repeat(top, per))
        total = np.add.reduceat(share, begin)
        reach[order[here]] = top + np.log(total)
        running = np.cumsum(share)
        chance[some] = (running - np.repeat(running[begin] - share[begin], per)) / np.repeat(total, per)
    chance[first[1:] - 1] = 2.0  # the last one is taken whatever the rounding
    return Lattice(first[:-1][rank], length, piece, chance)


def draws(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend only on the row's seed and the place in its text."""
    return (A.mix(seed + A.mix(place.astype(U64) + U64(0x2545F4914F6CDD1D))) >> U64(11)).astype(np.float64) * 2.0**-53


def sample(texts: list[str | None], seeds: np.ndarray, v: Vocabulary, sharpness: float) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of one sampled segmentation of each text, and the texts' starts in that list.

    The same row key and text give the same pieces wherever and in whatever batch the row is worked on. A
    space mark that stands in the text itself is spelled as bytes, so that decoding can tell it from a space.
    """
    points, starts = code_points(texts)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    own_mark = points == MARK
    own_mark[starts[:-1][np.diff(starts) > 0]] = False
    ids = np.where(own_mark, -1, v.char_id[points])
    first, last = pretokens(ids, starts, v.char_id[MARK])
    hashes = A.hashed(symbol_codes(ids), first, last)
    _, example, which = np.unique(hashes, return_index=True, return_inverse=True)
    at, offsets = ragged(first[example], (last - first)[example])
    ways = lattice(ids[at], offsets, v, sharpness)
    chosen = np.full(len(points), -1, np.int64)
    text = np.searchsorted(starts, first, side="right") - 1
    seed = A.mix(seeds.astype(U64))[text] if len(first) else np.zeros(0, U64)
    length = last - first
    begin, where, left = first, offsets[:-1][which], length
    while len(left):
        end = where + left - 1
        u = draws(seed, begin + left - starts[text])
        taken = ways.first[end]
        later = np.flatnonzero(u >= ways.chance[taken])
        while len(later):
            taken[later] += 1
            later = later[u[later] >= ways.chance[taken[later]]]
        left = left - ways.length[taken]
        chosen[begin + left] = ways.piece[taken]
        more = left > 0
        begin, where, left, seed, text = begin[more], where[more], left[more], seed[more], text[more]
    lacking = np.flatnonzero(ids < 0)
    per = np.where(chosen >= 0, 1, 0)
    per[lacking] = utf8_length(points[lacking])
    place = np.concatenate(([0], np.cumsum(per)))
    out = np.empty(place[-1], np.int64)
    whole = chosen >= 0
    out[place[:-1][whole]] = chosen[whole]
    if len(lacking):
        spelled = np.frombuffer(points[lacking].tobytes().decode("utf-32-le").encode(), np.uint8)
        into, _ = ragged(place[:-1][lacking], per[lacking])
        out[into] = v.byte_id[spelled]
    return out, place[starts]


def decode(ids: np.ndarray, starts: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their starts: the pieces' bytes in a row, without the leading space."""
    sizes = np.diff(v.piece_start)[ids]
    at, begin = ragged(v.piece_start[ids], sizes)
    data = v.piece_bytes[at]
    ends = begin[starts]
    keep = np.ones(len(data), bool)
    some = np.diff(starts) > 0
    keep[ends[:-1][some]] = False
    return data[keep], ends - np.concatenate(([0], np.cumsum(some)))


def encoded(batches, vocabulary, sharpness: float, limit: int):
    """Arrow batches (seed, text, anything else) to (anything else, piece ids)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    v = Vocabulary(**vocabulary.value)
    for batch in batches:
        column = batch.column(1)
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        seeds = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b in A.slices(lengths, limit):
            ids, starts = sample(column.slice(a, b - a).to_pylist(), seeds[a:b].view(np.uint64), v, sharpness)
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            rest = [c.slice(a, b - a) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*rest, lists], [*batch.schema.names[2:], "pieces"])


def decoded(batches, vocabulary, limit: int):
    """Arrow batches (piece ids, anything else) to (anything else, text); null ids give a null text."""
    import pyarrow as pa

    v = Vocabulary(**vocabulary.value)
    for batch in batches:
        lists = batch.column(0)
        counts = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        ids = lists.flatten().to_numpy().astype(np.int64)
        for a, b in A.slices(counts, limit):
            data, ends = decode(ids[starts[a] : starts[b]], starts[a : b + 1] - starts[a], v)
            buffers = [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
            texts = pa.Array.from_buffers(pa.large_string(), b - a, buffers).cast(pa.string())
            texts = pa.compute.if_else(lists.slice(a, b - a).is_valid(), texts, pa.scalar(None, pa.string()))
            rest = [c.slice(a, b - a) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([*rest, texts], [*batch.schema.names[1:], "text"])
