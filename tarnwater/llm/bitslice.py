"""Hamming neighbours among 64-bit fingerprints, by vertically stored bit planes.

A word holds one bit of 64 fingerprints.  A query is compared with all 64 at once: for each plane the
differing bits are added to carry-save counters (ones, twos, fours and a sticky overflow), so that after all
planes every lane knows whether its distance is within the radius.  Words whose lanes have all exceeded the
radius are abandoned between groups of planes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np

Near = Callable[[np.ndarray, np.ndarray], np.ndarray]
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: A bucket above this size is searched breadth first, so that a dense group costs about one pass a member.
BREADTH_FIRST = 512


def planes_of(values: np.ndarray) -> np.ndarray:
    """(words, 64) array: entry [w, p] holds bit p of fingerprints 64w .. 64w+63, lane 0 lowest."""
    n = len(values)
    padded = np.zeros((n + 63) // 64 * 64, np.uint64)
    padded[:n] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(0, 2, 1), axis=2, bitorder="little")).view(np.uint64).reshape(-1, 64)


def within(planes: np.ndarray, queries: np.ndarray, words: np.ndarray, valid: np.ndarray, radius: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Lanes within radius for each unit (query value, word): (unit numbers, lane masks) of units with any.

    valid: lanes of each unit that count.  skip: mask of planes known to be equal.  The counters have as many planes as
    the radius has bits; a carry out of the last one is kept in `over`.
    """
    unit, q, w, over = np.arange(len(queries)), queries, words, ~valid
    counters = [np.zeros(len(queries), np.uint64) for _ in range(max(1, radius.bit_length()))]
    todo = [p for p in range(64) if not skip >> p & 1]
    for step in range(0, len(todo), 8):
        for p in todo[step : step + 8]:
            carry = planes[w, p] ^ np.where((q >> np.uint64(p)) & np.uint64(1), ALL, np.uint64(0))
            for k, c in enumerate(counters):
                counters[k], carry = c ^ carry, c & carry
            over = over | carry
        alive = (over | _above(counters, radius)) != ALL
        if not alive.all():
            unit, q, w, over, *counters = (x[alive] for x in (unit, q, w, over, *counters))
            if not len(unit):
                break
    near = ~(over | _above(counters, radius))
    some = near != 0
    return unit[some], near[some]


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count (counters[k] holds bit k) exceeds radius, compared from the highest bit down."""
    more, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ALL)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            more = more | (equal & counters[k])
            equal = equal & ~counters[k]
    return more


def lanes(units: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit, lane) for each bit set."""
    bits = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(bits)
    return units[row], lane


def bucket_pairs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int, skip: int, near: Near | None = None, units: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (i, j), i < j, within radius inside each of the buckets [start, end) of values, some at a time.

    Buckets are compared together, whatever their sizes; about `units` comparisons of a value with a word are made at
    once.  near(i, j) may test the pairs further.
    """
    sizes = ends - starts
    starts, ends, sizes = starts[sizes > 1], ends[sizes > 1], sizes[sizes > 1]
    if not len(sizes):
        return
    n_words = (sizes + 63) // 64
    # Lay the buckets out so that each begins with a new word.
    first_word = np.concatenate(([0], np.cumsum(n_words)[:-1]))
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    source = np.repeat(starts, sizes) + place
    slot = first_word[bucket] * 64 + place
    padded = np.zeros(int(n_words.sum()) * 64, np.uint64)
    padded[slot] = values[source]
    used = np.zeros(len(padded), bool)
    used[slot] = True
    filled = np.packbits(used.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
    planes = planes_of(padded)
    back = np.zeros(len(padded), np.int64)
    back[slot] = source
    # A query meets its own word (later lanes only) and the later words of its bucket.
    ahead = n_words[bucket] - place // 64
    done = np.concatenate(([0], np.cumsum(ahead)))
    at = 0
    while at < len(source):
        to = max(at + 1, int(np.searchsorted(done, done[at] + units, "right")) - 1)
        query = np.repeat(np.arange(at, to), ahead[at:to])
        step = np.arange(len(query)) - np.repeat(done[at:to] - done[at], ahead[at:to])
        word = slot[query] // 64 + step
        own = (slot[query] % 64).astype(np.uint64)
        later = np.where(own == 63, np.uint64(0), ALL << (own + np.uint64(1)) % np.uint64(64))
        valid = np.where(step == 0, filled[word] & later, filled[word])
        unit, lane = lanes(*within(planes, values[source[query]], word, valid, radius, skip))
        i, j = source[query[unit]], back[word[unit] * 64 + lane]
        if near is not None:
            kept = near(i, j)
            i, j = i[kept], j[kept]
        if len(i):
            yield i, j
        at = to


def small_buckets(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int, skip: int, near: Near | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of bucket_pairs at once."""
    found = list(bucket_pairs(values, starts, ends, radius, skip, near))
    return (np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def large_bucket(values: np.ndarray, radius: int, skip: int, near: Near | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links within radius: breadth first over the fingerprints not reached yet."""
    n = len(values)
    planes, left = planes_of(values), np.full((n + 63) // 64, ALL)
    if n % 64:
        left[-1] = np.uint64((1 << n % 64) - 1)
    order = np.arange(n, dtype=np.int64)
    place = order.copy()
    n_left, out_i, out_j = n, [], []
    for seed in range(n):
        at = int(place[seed])
        if at < 0 or not int(left[at // 64]) >> at % 64 & 1:
            continue
        left[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
        n_left -= 1
        frontier = np.array([seed], np.int64)
        while len(frontier) and n_left:
            batch, frontier = frontier[:64], frontier[64:]
            live = np.flatnonzero(left)
            unit, mask = within(planes, np.repeat(values[batch], len(live)), np.tile(live, len(batch)), np.tile(left[live], len(batch)), radius, skip)
            u, lane = lanes(unit, mask)
            spot = live[u % len(live)] * 64 + lane
            if near is not None and len(u):
                kept = near(batch[u // len(live)], order[spot])
                u, spot = u[kept], spot[kept]
            if len(u):
                spot, first = np.unique(spot, return_index=True)
                reached = order[spot]
                out_i.append(batch[u[first] // len(live)])
                out_j.append(reached)
                np.bitwise_and.at(left, spot // 64, ~(np.uint64(1) << (spot % 64).astype(np.uint64)))
                n_left -= len(spot)
                frontier = np.concatenate((frontier, reached))
            if n_left and n_left * 2 < len(order):  # store the planes of the rest anew
                keep = np.unpackbits(left.view(np.uint8), bitorder="little")[: len(order)].astype(bool)
                place[:] = -1
                order = order[keep]
                place[order] = np.arange(len(order))
                planes, left = planes_of(values[order]), np.full((len(order) + 63) // 64, ALL)
                if len(order) % 64:
                    left[-1] = np.uint64((1 << len(order) % 64) - 1)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.empty(0, np.int64), np.empty(0, np.int64))


def spanning(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each member of a connected group of pairs (i, j) to the group's smallest: at most one a member."""
    nodes, flat = np.unique(np.concatenate((i, j)), return_inverse=True)
    a, b = flat[: len(i)], flat[len(i) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def forest(i: np.ndarray, j: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Mask of the pairs (i, j) that make a least spanning forest when pairs weigh by their place in `order`.

    Every tree takes its lightest pair to another tree, all trees at once, until none is left.
    """
    chosen = np.zeros(len(i), bool)
    nodes, flat = np.unique(np.concatenate((i, j)), return_inverse=True)
    weight = np.empty(len(i), np.int64)
    weight[order] = np.arange(len(i))
    label, live = np.arange(len(nodes)), np.arange(len(i))
    a, b = flat[: len(i)], flat[len(i) :]
    while len(live):
        x, y, w = label[a[live]], label[b[live]], weight[live]
        apart = x != y
        live, x, y, w = live[apart], x[apart], y[apart], w[apart]
        least = np.full(len(nodes), len(i))
        np.minimum.at(least, x, w)
        np.minimum.at(least, y, w)
        picked = order[np.unique(least[least < len(i)])]
        chosen[picked] = True
        # Trees joined by picked pairs get one label: the smallest, passed on until nothing changes.
        u, v = label[a[picked]], label[b[picked]]
        up = np.arange(len(nodes))
        while len(u):
            low = np.minimum(up[u], up[v])
            before = up.copy()
            np.minimum.at(up, u, low)
            np.minimum.at(up, v, low)
            up = up[up]
            if (up == before).all():
                break
        label = up[label]
    return chosen


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of the bit groups of which at least one is equal for any two fingerprints within radius.

    64 bits fall into so many blocks; at most radius of them differ, so some blocks - radius agree.
    """
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    each = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(pick) for pick in combinations(each, blocks - radius)]


def blocks_for(n: int, radius: int, per_bucket: int = 256) -> int:
    """The fewest blocks with which n spread fingerprints make buckets of per_bucket at most; every choice is exact."""
    blocks = radius + 1
    while blocks < 16 and n / 2.0 ** (64 / blocks * (blocks - radius)) > per_bucket and comb(blocks + 1, radius) <= 4096:
        blocks += 1
    return blocks
