"""Suffix arrays of one shard, in numpy, for strings of a fixed length.

A shard is a buffer of *pieces*; a suffix ends with its piece. Only the first
``length`` bytes of a suffix count, so refinement stops there, and suffixes that are
shorter take part as the second halves of others only.
"""

from __future__ import annotations

import numpy as np

FIRST = 5  # bytes by which suffixes are sorted at first: with a place in the shard they are one number


def order_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The order that sorts these numbers of at most so many bits, equal ones as they stand.

    Numbers that hold their place in the low bits are sorted as such, which is much faster than an indirect sort.
    """
    low = len(keys).bit_length()
    if bits + low > 64:
        return np.argsort(keys, kind="stable")
    packed = keys.astype(np.uint64) << np.uint64(low)
    packed |= np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    packed &= np.uint64((1 << low) - 1)
    return packed.view(np.int64)


def suffix_groups(buffer: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the suffixes of at least ``length`` bytes in sorted order, and their group numbers.

    ``ends[p]`` is the end of the piece that byte p belongs to. Suffixes have one group
    number if and only if their first ``length`` bytes are equal. As in the refinement
    of Larsson and Sadakane, a group's number is its place in the order, a suffix is
    moved only as long as its group has other members, and its key in the next step is
    the group number of the suffix that begins where its own sorted prefix stops.
    """
    places = np.arange(len(buffer))
    depth = min(FIRST, length)
    at = places[places + depth <= ends]
    group = np.full(len(buffer), -1, np.int64)
    if len(at):
        group[at] = _numbers(_packed(buffer, depth)[at], 8 * depth)
    while depth < length:
        step = min(depth, length - depth)
        members = np.bincount(group[at], minlength=len(buffer) + 1)
        at = at[at + depth + step <= ends[at]]
        old = group[at]
        open_ = members[old] > 1
        moved = at[open_]
        new = group.copy()
        if len(moved):
            # places of the new group numbers: behind the members of the group that sort before
            key = old[open_] << len(buffer).bit_length() | group[moved + step]
            order = order_of(key, 2 * len(buffer).bit_length())
            key, parent = key[order], old[open_][order]
            starts = np.concatenate([[True], key[1:] != key[:-1]])
            heads = np.concatenate([[True], parent[1:] != parent[:-1]])
            index = np.arange(len(key))
            offset = np.maximum.accumulate(np.where(starts, index, 0)) - np.maximum.accumulate(np.where(heads, index, 0))
            new[moved[order]] = parent + offset
        group = new
        depth += step
    numbers = group[at]
    order = order_of(numbers, len(buffer).bit_length())
    return at[order], numbers[order]


def _packed(buffer: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` (at most 8) bytes from each place on as one number that sorts like them."""
    key, done = buffer.astype(np.uint64), 1
    while done < width:
        more = min(done, width - done)
        shifted = key[: len(key) - more] << np.uint64(8 * more)
        tail = key[more:] if more == done else key[more:] & np.uint64((1 << (8 * more)) - 1)
        key = shifted | tail
        done += more
    return key


def _numbers(keys: np.ndarray, bits: int) -> np.ndarray:
    """For each key of so many bits the number of smaller ones."""
    order = order_of(keys, bits)
    ranked = keys[order]
    starts = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    out = np.empty(len(keys), np.int64)
    out[order] = np.maximum.accumulate(np.where(starts, np.arange(len(keys)), 0))
    return out


def common_prefixes(buffer: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to ``length`` bytes; 0 for the first.

    Kasai's observation, for all places at once: if the suffix at p has the one at q
    before it, and the suffix at p - 1 has the one at q - 1, they agree as far as those
    do, less one byte. Such chains start with a comparison byte by byte; along a chain
    only the byte that has come into view remains to be compared, as long as the whole
    length agreed before.
    """
    n = len(order)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.full(len(buffer), -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.sort(order)
    q = before[at]
    found = np.zeros(len(buffer), np.int64)
    chained = np.zeros(len(at), bool)
    chained[1:] = (at[1:] == at[:-1] + 1) & (q[1:] == q[:-1] + 1) & (q[:-1] >= 0)
    heads = (q >= 0) & ~chained
    found[at[heads]] = _compare(buffer, at[heads], q[heads], length)
    rest = at[chained]
    same = buffer[rest + length - 1] == buffer[before[rest] + length - 1]
    # a chain's head agrees in full, and so does everything up to the first byte that differs
    broken = np.zeros(len(at), bool)
    broken[chained] = ~same
    broken[heads] = found[at[heads]] < length
    index = np.arange(len(at))
    head_of = np.maximum.accumulate(np.where(~chained, index, 0))
    last_broken = np.maximum.accumulate(np.where(broken, index, -1))
    whole = chained & (last_broken < head_of)
    found[at[whole]] = length
    unclear = chained & ~whole
    found[at[unclear]] = _compare(buffer, at[unclear], q[unclear], length)
    return found[order]


def _compare(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, each at least ``length`` bytes long."""
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    for k in range(length):
        alive = alive[buffer[a[alive] + k] == buffer[b[alive] + k]]
        if not len(alive):
            break
        out[alive] += 1
    return out


def strings(buffer: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The strings at these places as fixed-width items, for binary search."""
    if not len(at):
        return np.zeros(0, f"S{length}")
    windows = np.lib.stride_tricks.sliding_window_view(buffer, length)
    return np.ascontiguousarray(windows[at]).view(f"S{length}").ravel()


def merge_least(sides: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct strings of several shards, each with the least of its values.

    Each shard gives its sorted distinct strings and a value for each. Shard after
    shard is placed into the merged list by binary search.
    """
    names, least = sides[0]
    for more, values in sides[1:]:
        place = np.searchsorted(names, more)
        known = np.zeros(len(more), bool)
        inside = place < len(names)
        known[inside] = names[place[inside]] == more[inside]
        least = least.copy()
        least[place[known]] = np.minimum(least[place[known]], values[known])
        names = np.insert(names, place[~known], more[~known])
        least = np.insert(least, place[~known], values[~known])
    return names, least
