"""A linear-chain conditional random field over word shapes, on flat numpy arrays.

A text is cut into runs of letters, runs of digits and single signs. Tags other than "outside" are allowed only within
``REACH`` tokens of a digit or an at sign on the same line; so the chain falls into stretches of such tokens, before and behind
which everything is outside, and only those are trained on and decoded. A token's features are the shapes of itself and
of two tokens on either side, with whether a blank stands before them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

REACH, SIDE = 3, 2
BLANK, LETTER, DIGIT, SIGN = range(4)
KIND = np.full(256, SIGN, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
KIND[48:58] = DIGIT
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words that announce a kind, as shapes of their own; they are no longer than ``CUE_BYTES``.
CUES = {
    "phone": "tel phone call mobile cell fax telefon telephone ring dial handy anruf teléfono móvil téléphone portable",
    "birth": "born birth dob birthday birthdate geboren geburtsdatum geb née né naissance nacido nacida nacimiento",
    "street": "street st road rd avenue ave lane ln drive dr boulevard blvd court straße strasse str weg platz allee rue calle avenida",
    "identity": "ssn passport id identity licence license social security ausweis pass passeport pasaporte dni nif insurance",
    "month": "january february march april may june july august september october november december januar märz mai juni juli",
}
CUE_BYTES = 12
_CUE = sorted((w.encode(), i) for i, words in enumerate(CUES.values()) for w in words.split() if len(w.encode()) <= CUE_BYTES)
_CUE_WORDS, _CUE_GROUP = np.array([w for w, _ in _CUE], f"S{CUE_BYTES}"), np.array([i for _, i in _CUE])

# Shapes: border, ten lengths of digit runs, four spellings of letters in three lengths, the cues, and each ASCII sign.
_DIGITS, _LETTERS, _CUES_AT = 1, 11, 23
_SIGNS = _CUES_AT + len(CUES)
SHAPES = _SIGNS + 128
_DIGIT_CLASS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 8, 8, 9])


@dataclass(frozen=True)
class Stretches:
    """Tokens that may be tagged, stretch after stretch."""

    start: np.ndarray  # byte places of the tokens
    end: np.ndarray
    codes: np.ndarray  # tokens x places around them: shape and blank
    offsets: np.ndarray  # where each stretch begins


def stretches(data: np.ndarray, offsets: np.ndarray) -> Stretches:
    """The stretches of all texts ``data[offsets[i]:offsets[i + 1]]`` (UTF-8 bytes); none crosses a line or a text."""
    n, width = len(data), 2 * SIDE + 1
    none = np.zeros(0, np.int64)
    kind = KIND[data]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == SIGN)
    edge[offsets] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    word = kind[start] != BLANK if n else np.zeros(0, bool)
    start, end = start[word], end[word]
    own = kind[start] if n else kind
    marked = np.flatnonzero((own == DIGIT) | (data[start] == 0x40)) if n else none
    if not len(marked):
        return Stretches(none, none, np.zeros((0, width), np.int64), np.zeros(1, np.int64))
    breaks = (data == 0x0A).astype(np.int32)
    breaks[offsets[:-1][offsets[:-1] < n]] += 1
    line = np.cumsum(breaks)[start]

    def around(places: np.ndarray, reach: int) -> np.ndarray:
        """All tokens within reach of the given ones on their lines."""
        near = places[:, None] + np.arange(-reach, reach + 1)
        good = (near >= 0) & (near < len(start))
        good &= line[np.where(good, near, 0)] == line[places][:, None]
        flag = np.zeros(len(start), bool)
        flag[near[good]] = True
        return np.flatnonzero(flag)

    active = around(marked, REACH)
    seen = around(active, SIDE)
    shape = np.zeros(len(start), np.int64)
    shape[seen] = 2 * _shapes(data, start[seen], end[seen], own[seen])
    shape[seen] += (start[seen] > 0) & (kind[start[seen] - 1] == BLANK)
    near = active[:, None] + np.arange(-SIDE, SIDE + 1)
    good = (near >= 0) & (near < len(start))
    near = np.where(good, near, 0)
    good &= line[near] == line[active][:, None]
    first = np.ones(len(active), bool)
    first[1:] = (active[1:] != active[:-1] + 1) | (line[active[1:]] != line[active[:-1]])
    return Stretches(start[active], end[active], np.where(good, shape[near], 0), np.append(np.flatnonzero(first), len(active)))


def _shapes(data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    out, length = np.zeros(len(start), np.int64), end - start
    digits, letters, signs = (np.flatnonzero(kind == k) for k in (DIGIT, LETTER, SIGN))
    out[digits] = _DIGITS + _DIGIT_CLASS[np.minimum(length[digits], len(_DIGIT_CLASS) - 1)]
    out[signs] = _SIGNS + data[start[signs]]
    if len(letters):
        size = length[letters]
        place = np.concatenate(([0], np.cumsum(size)))
        flat = data[np.repeat(start[letters] - place[:-1], size) + np.arange(place[-1])]
        upper = np.add.reduceat(_UPPER[flat].astype(np.int64), place[:-1])
        spelling = np.where(upper == 0, 0, np.where(upper == size, 2, np.where((upper == 1) & _UPPER[flat[place[:-1]]], 1, 3)))
        out[letters] = _LETTERS + 3 * spelling + (size > 1) + (size > 3)
        short = np.flatnonzero(size <= CUE_BYTES)
        column = np.arange(CUE_BYTES)
        inside = column < size[short][:, None]
        text = np.where(inside, _LOWER[flat[np.where(inside, place[:-1][short][:, None] + column, 0)]], 0).astype(np.uint8)
        text = np.ascontiguousarray(text).view(f"S{CUE_BYTES}").ravel()
        found = np.minimum(np.searchsorted(_CUE_WORDS, text), len(_CUE_WORDS) - 1)
        hit = _CUE_WORDS[found] == text
        out[letters[short[hit]]] = _CUES_AT + _CUE_GROUP[found[hit]]
    return out


@dataclass(frozen=True)
class Model:
    emit: np.ndarray  # places around a token x codes x tags
    move: np.ndarray  # tag x tag; tag 0 is outside, then a beginning and an inside tag for each kind


def _allowed(tags: int) -> np.ndarray:
    """An inside tag follows only its own beginning or inside."""
    move = np.zeros((tags, tags))
    for inside in range(2, tags, 2):
        move[:, inside] = -1e4
        move[[inside - 1, inside], inside] = 0.0
    return move


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(given: Stretches, tags: np.ndarray, kinds: int, rounds: int = 250, rate: float = 0.1, penalty: float = 0.02) -> Model:
    """Maximise the penalised likelihood of ``tags`` (by token) with Adam; sums forward and backward over all stretches in step.
    Without stretches the model tags nothing."""
    count, width = 1 + 2 * kinds, given.codes.shape[1]
    length = np.diff(given.offsets)
    emit, move, allowed = np.zeros((width, 2 * SHAPES, count)), np.zeros((count, count)), _allowed(count)
    if not len(length):
        emit[SIDE, :, 0] = 1.0
        return Model(emit, move + allowed)
    rows, steps = len(length), int(length.max())
    row = np.repeat(np.arange(rows), length)
    step = np.arange(len(tags)) - given.offsets[:-1][row]
    real = np.arange(steps) < length[:, None]
    place, last = np.arange(width)[None, :], length - 1
    gold = np.zeros((rows, steps), np.int64)
    gold[row, step] = tags
    before = np.concatenate((np.zeros((rows, 1), np.int64), gold[:, :-1]), axis=1)
    seen_move = np.zeros((count, count))
    np.add.at(seen_move, (before[real], gold[real]), 1.0)
    np.add.at(seen_move, (gold[np.arange(rows), last], 0), 1.0)
    weights, moments = [emit, move], [[np.zeros_like(w), np.zeros_like(w)] for w in (emit, move)]
    for turn in range(1, rounds + 1):
        m = move + allowed
        score = np.zeros((rows, steps, count))
        score[row, step] = emit[place, given.codes].sum(axis=1)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = m[0] + score[:, 0]
        for t in range(1, steps):
            forward[:, t] = _log_sum(forward[:, t - 1, :, None] + m, 1) + score[:, t]
        backward[:, -1] = m[:, 0]
        for t in range(steps - 2, -1, -1):
            on = _log_sum(m + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None], on, m[:, 0])
        total = _log_sum(forward[:, 0] + backward[:, 0], 1)
        chance = np.exp(forward + backward - total[:, None, None])[row, step]
        chance[np.arange(len(tags)), tags] -= 1.0
        grad_emit = np.zeros_like(emit)
        np.add.at(grad_emit, (place, given.codes), chance[:, None, :])
        both = forward[:, :-1, :, None] + m + (score + backward)[:, 1:, None, :] - total[:, None, None, None]
        grad_move = (np.exp(both) * real[:, 1:, None, None]).sum(axis=(0, 1))
        grad_move[0] += np.exp(forward[:, 0] + backward[:, 0] - total[:, None]).sum(axis=0)
        grad_move[:, 0] += np.exp(forward[np.arange(rows), last] + m[:, 0] - total[:, None]).sum(axis=0)
        for w, g, (a, b) in zip(weights, (grad_emit, grad_move - seen_move), moments, strict=True):
            g = g + penalty * w
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= rate * (a / (1 - 0.9**turn)) / (np.sqrt(b / (1 - 0.999**turn)) + 1e-8)
    return Model(emit, move + allowed)


def decode(given: Stretches, model: Model) -> np.ndarray:
    """The likeliest tags (Viterbi), all stretches in step, the longest first."""
    length = np.diff(given.offsets)
    tags = np.zeros(len(given.start), np.int64)
    if not len(length):
        return tags
    order = np.argsort(-length, kind="stable")
    begin, length = given.offsets[:-1][order], length[order]
    still = np.searchsorted(-length, -np.arange(length[0]), side="left")  # stretches longer than each step
    back = np.zeros((len(tags), len(model.move)), np.int8)
    last = np.zeros(len(length), np.int64)
    emit = lambda at: model.emit[np.arange(given.codes.shape[1]), given.codes[at]].sum(axis=1)
    score = model.move[0] + emit(begin)
    for t in range(1, int(length[0]) + 1):
        go = int(still[t]) if t < length[0] else 0
        last[go : len(score)] = (score[go:] + model.move[:, 0]).argmax(axis=1)
        if not go:
            break
        ways = score[:go, :, None] + model.move
        best = ways.argmax(axis=1)
        at = begin[:go] + t
        back[at] = best
        score = np.take_along_axis(ways, best[:, None, :], axis=1)[:, 0] + emit(at)
    for t in range(int(length[0]) - 1, -1, -1):
        here = slice(0, int(still[t]))
        at = begin[here] + t
        tags[at] = last[here]
        last[here] = back[at, last[here]]
    return tags


def spans(given: Stretches, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes, ends and kinds of the tagged runs; an inside tag never begins one."""
    first = np.flatnonzero(tags % 2 == 1)
    inside = np.append((tags > 0) & (tags % 2 == 0), False)
    inside[given.offsets] = False  # stretches end
    stop = np.flatnonzero(~inside)
    last = stop[np.searchsorted(stop, first + 1)] - 1 if len(first) else first
    return given.start[first], given.end[last], (tags[first] - 1) // 2
