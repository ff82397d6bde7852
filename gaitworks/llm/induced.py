"""Suffix arrays by induced sorting, and permuted common prefixes, for one shard of symbols in NumPy."""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket, each as one array; larger ones suffix by suffix.
SMALL_ALPHABET = 1024
#: Symbols compared at a time in ``common_prefixes``; they must be below 2^12 - 1.
_PACKED, _WORD_BITS = 5, 60


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is less than the next one (S); the last suffix, the sentinel, is S."""
    n = len(s)
    smaller = np.ones(n, bool)
    if n > 1:
        step = np.sign(np.diff(s.astype(np.int64)))
        # equal neighbours take the type of the next unequal pair
        place = np.where(step != 0, np.arange(n - 1), n)
        place = np.minimum.accumulate(place[::-1])[::-1]
        smaller[:-1] = np.append(step, 1)[np.minimum(place, n - 1)] > 0
    return smaller


def leftmost_smaller(smaller: np.ndarray) -> np.ndarray:
    """Places of S suffixes that follow an L suffix."""
    return np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def name_pieces(s: np.ndarray, smaller: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Ranks of the pieces from one leftmost smaller place to the next, both included; equal pieces share a rank.

    Symbols carry their type, so that a piece is never a prefix of a longer one.
    Several symbols go into one sort key; only pieces still tied are looked at further.
    """
    typed = s.astype(np.uint64) * np.uint64(2) + smaller.astype(np.uint64) + np.uint64(1)
    bits = max(int(typed.max()).bit_length(), 1)
    ends = np.append(places[1:], places[-1])
    ranks = np.zeros(len(places), np.int64)
    tied, offset = np.arange(len(places)), 0
    while len(tied):
        room = max((63 - int(ranks.max()).bit_length()) // bits, 1)
        key = ranks[tied].astype(np.uint64)
        for i in range(room):
            at = places[tied] + offset + i
            inside = at <= ends[tied]
            key = key << np.uint64(bits) | np.where(inside, typed[np.minimum(at, len(s) - 1)], np.uint64(0))
        offset += room
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        # new ranks keep room for the others: the old rank plus the place of the group among its tied pieces
        old = ranks[tied][order]
        group = np.concatenate(([True], old[1:] != old[:-1]))
        first = np.maximum.accumulate(np.where(group, np.arange(len(old)), 0))
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(old)), 0))
        ranks[tied[order]] = old + (start - first)
        many = np.bincount(np.cumsum(fresh) - 1)[np.cumsum(fresh) - 1] > 1
        still = tied[order][many]
        tied = np.sort(still[places[still] + offset <= ends[still]])
    return ranks


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of symbols; the last symbol must be 0 and no other may be."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    smaller = suffix_types(s)
    places = leftmost_smaller(smaller)
    if len(places) > 1:
        ranks = name_pieces(s, smaller, places)
        used = np.unique(ranks)
        if len(used) < len(places):
            reduced = np.searchsorted(used, ranks)
            # the sentinel's piece is the least and alone, so it ends the reduced string as a sentinel
            order = suffix_array(reduced)
        else:
            order = np.argsort(ranks, kind="stable")
        places = places[order]
    if int(s.max()) < SMALL_ALPHABET:
        return _induce_by_bucket(s, smaller, places)
    return _induce_by_suffix(s, smaller, places)


def _deal(chars: np.ndarray, suffixes: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append suffixes to the buckets of their first symbols, order kept."""
    order = np.argsort(chars.astype(np.uint16), kind="stable")
    chars, suffixes = chars[order], suffixes[order]
    cuts = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1])))
    for start, end in zip(cuts, np.append(cuts[1:], len(chars))):
        into[chars[start]].append(suffixes[start:end])


def _pass(s: np.ndarray, wanted: np.ndarray, seeds: list[list[np.ndarray]], symbols: range) -> list[np.ndarray]:
    """One scan: every suffix, in order, puts its left neighbour, if of the wanted type, into that one's bucket.

    Within a bucket the suffixes it puts into itself come in rounds, as the scan would meet them.
    """
    into: list[list[np.ndarray]] = [[] for _ in seeds]
    for c in symbols:
        rounds, at = into[c], 0
        while at < len(rounds):
            batch = np.concatenate(rounds[at:]) if len(rounds) - at > 1 else rounds[at]
            at = len(rounds)
            left = batch[batch > 0] - 1
            left = left[wanted[left]]
            if len(left):
                _deal(s[left], left, into)
        for seed in seeds[c]:
            left = seed[seed > 0] - 1
            left = left[wanted[left]]
            if len(left):
                _deal(s[left], left, into)
    none = np.zeros(0, np.int64)
    return [np.concatenate(parts) if parts else none for parts in into]


def _induce_by_bucket(s: np.ndarray, smaller: np.ndarray, places: np.ndarray) -> np.ndarray:
    count = int(s.max()) + 1
    seeds: list[list[np.ndarray]] = [[] for _ in range(count)]
    _deal(s[places], places, seeds)
    larger = _pass(s, ~smaller, seeds, range(count))
    # L suffixes of a bucket come before its S suffixes; the scan from the right meets both kinds from their ends
    back = [[part[::-1]] if len(part) else [] for part in larger]
    less = _pass(s, smaller, back, range(count - 1, -1, -1))
    less[0] = np.array([len(s) - 1])
    return np.concatenate([part for c in range(count) for part in (larger[c], less[c][::-1])])


def _induce_by_suffix(s: np.ndarray, smaller: np.ndarray, places: np.ndarray) -> np.ndarray:
    n = len(s)
    counts = np.bincount(s)
    ends = np.cumsum(counts)
    symbols, is_s = s.tolist(), smaller.tolist()
    array = [-1] * n
    tails = (ends - 1).tolist()
    for i in places[::-1].tolist():
        c = symbols[i]
        array[tails[c]] = i
        tails[c] -= 1
    heads = (ends - counts).tolist()
    for k in range(n):
        i = array[k] - 1
        if i >= 0 and not is_s[i]:
            c = symbols[i]
            array[heads[c]] = i
            heads[c] += 1
    tails = (ends - 1).tolist()
    for k in range(n - 1, -1, -1):
        i = array[k] - 1
        if i >= 0 and is_s[i]:
            c = symbols[i]
            array[tails[c]] = i
            tails[c] -= 1
    array[0] = n - 1
    return np.array(array, np.int64)


def common_prefixes(s: np.ndarray, array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By text position: the common prefix with the suffix before it in the array, and with the one after it.

    A value is one less than its left neighbour's unless the symbols before the
    two suffixes differ; only those irreducible ones are compared, all together.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    at = np.arange(n)
    same = np.zeros(n, bool)
    inner = (at > 0) & (before > 0)
    same[inner] = s[at[inner] - 1] == s[before[inner] - 1]
    # reducible only if the left neighbours are neighbours in the array, too
    same[inner] &= before[at[inner] - 1] == before[inner] - 1
    start = np.flatnonzero(~same & (before >= 0))
    length = np.zeros(n, np.int64)
    # _PACKED symbols in a word: one look tells whether all of them are equal, and else the first that is not
    bits = _WORD_BITS // _PACKED
    wide = np.full(n + _PACKED, (1 << bits) - 1, np.uint64)
    wide[:n] = s
    words = np.zeros(n + 1, np.uint64)
    for i in range(_PACKED):
        words |= wide[i : i + n + 1] << np.uint64(bits * i)
    active, other, done = start, before[start], 0
    while len(active):
        differ = words[np.minimum(active + done, n)] ^ words[np.minimum(other + done, n)]
        lowest = differ & (~differ + np.uint64(1))
        gained = np.where(differ == 0, _PACKED, (np.frexp(lowest.astype(np.float64))[1] - 1) // bits)
        length[active] += gained
        more = differ == 0
        active, other, done = active[more], other[more], done + _PACKED
    source = np.maximum.accumulate(np.where(same, 0, at))
    prefix = length[source] - (at - source)
    prefix[before < 0] = 0
    after = np.zeros(n, np.int64)
    after[array[:-1]] = prefix[array[1:]]
    return prefix, after
