"""Draws as Arrow kernels inside tasks: numpy hashes many texts at a time, so a draw is neither a row nor a call.

Functions go to the executors by value, so these need not have the package."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Fixed values of MD5 (RFC 1321): rotations, constants, first state.
TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def mixed(state: list, words: Sequence) -> list:
    """The state after one block; words: 16, each an array of uint32 or a whole number that all texts share."""
    return [x + y for x, y in zip(state, steps(state, words, range(64)))]


def steps(state: list, words: Sequence, some: range) -> list:
    """The state after some of a block's 64 steps; the first 16 take a word each, in order."""
    a, b, c, d = (x.copy() for x in state)
    f, low = np.empty_like(a), np.empty_like(a)
    for i in some:
        if i < 16:  # d ^ (b & (c ^ d))
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f), d, out=f)
            g = i
        elif i < 32:  # c ^ (d & (b ^ c))
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f), c, out=f)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
            g = (3 * i + 5) % 16
        else:  # c ^ (b | ~d)
            np.bitwise_xor(np.bitwise_or(np.invert(d, out=f), b, out=f), c, out=f)
            g = 7 * i % 16
        turn, word = TURNS[i // 16][i % 4], words[g]
        a += f
        if isinstance(word, int):
            a += np.uint32((SINES[i] + word) % 2**32)
        else:
            a += word
            a += np.uint32(SINES[i])
        np.right_shift(a, np.uint32(32 - turn), out=low)
        a <<= np.uint32(turn)
        a |= low
        a += b
        a, b, c, d = d, a, b, c
    return [a, b, c, d]


def heads(begin: pa.Array, n: int) -> np.ndarray:
    """For k of 1 to n (rows) and each text (columns), the first 13 hex digits of the MD5 of the text and k, as a number.

    Texts of as many blocks go together. As k grows, only the words in which its digits stand are taken anew; steps before these words are shared."""
    begin = begin.cast(pa.large_binary())
    at = np.frombuffer(begin.buffers()[1], np.int64)[begin.offset : begin.offset + len(begin) + 1]
    data = np.frombuffer(begin.buffers()[2] or b"", np.uint8)
    sizes, out = np.diff(at), np.empty((n, len(begin)), np.int64)
    blocks = (sizes + len(str(n)) + 8) // 64 + 1
    for some in np.unique(blocks).tolist():
        rows = np.flatnonzero(blocks == some)
        size, each = sizes[rows], np.arange(len(rows))
        most = int(size.max())
        place = np.arange(most)
        own = np.zeros((len(rows), 64 * some), np.uint8)
        own[:, :most] = np.where(place < size[:, None], data[np.minimum(at[rows][:, None] + place, len(data) - 1)] if most else 0, 0)
        seen = own.view("<u4")
        digits, last = 0, None
        for k in range(1, n + 1):
            text = str(k).encode()
            if grown := len(text) > digits:
                if last is not None:
                    seen[each, last] = 0
                digits = len(text)
                # the length goes into the last block that a text needs; blocks are counted for the most digits
                last = 16 * ((size + digits + 8) // 64 + 1) - 2
                own[each, size + digits] = 0x80
                seen[each, last] = 8 * (size + digits)
                used = {*range((most + digits) // 4 + 1), *np.unique(last).tolist()}
                words = [0] * (16 * some)
            for i, c in enumerate(text):
                own[each, size + i] = c
            for i in used if grown else range(int(size.min()) // 4, (most + digits) // 4 + 1):
                words[i] = seen[:, i].copy()
            if grown:
                begun = [np.full(len(rows), x, np.uint32) for x in STATE]
                same = min(int(size.min()) // 4, 16)
                ahead = steps(begun, words, range(same))
            for i in range(0, len(words), 16):
                state = mixed(state, words[i : i + 16]) if i else [x + y for x, y in zip(begun, steps(ahead, words, range(same, 64)))]
                done = state if i == 0 else [np.where(last > i, x, y) for x, y in zip(state, done)]
            first, second = (x.byteswap().astype(np.int64) for x in done[:2])
            out[k - 1, rows] = (first << 20) | (second >> 12)
    return out


def flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each list its start and size, and the elements of all; null is empty."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.cumsum(sizes) - sizes, sizes, lists.flatten()


def places(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each hash, the number of its column's cuts (sizes of values from starts) up to it: few are counted, many searched."""
    most, out = int(sizes.max(initial=0)), np.zeros(hashes.shape, np.int32)
    if most <= 8:
        for r in range(most):
            inside = r < sizes
            cut = np.where(inside, values[np.where(inside, starts + r, 0)], 1 << 52)
            for own, to in zip(hashes, out):  # a row of draws stays in the cache
                to += cut <= own
        return out
    for k in reversed(range(most.bit_length())):
        beyond = out + (1 << k)
        inside = beyond <= sizes
        out += (inside & (values[np.where(inside, starts + beyond - 1, 0)] <= hashes)).astype(np.int32) << k
    return out


def picker(n: int) -> Callable[[pa.Array, pa.Array], pa.Array]:
    """begin, cuts -> the places of n draws; null for null."""

    def run(begin: pa.Array, cuts: pa.Array) -> pa.Array:
        some = begin.is_valid()
        starts, sizes, values = flat(cuts.filter(some))
        picked = places(heads(begin.filter(some), n), starts, sizes, values.to_numpy(zero_copy_only=False)).T
        ends = np.cumsum(np.concatenate([[0], np.where(some.to_numpy(zero_copy_only=False), n, 0)])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(picked.ravel()), mask=pc.invert(some))

    return run


def united(lists: pa.Array, fixed: Sequence[pa.Array], n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each row's draws end, and the words of all draws: the union of the row's fixed words with those picked from what is open (begin,
    cuts, masks). One draw where nothing is open."""
    _, sizes, every = flat(lists)
    own = np.flatnonzero(sizes)
    some = np.where(sizes > 0, n, 1)
    ends = np.cumsum(np.concatenate([[0], some])).astype(np.int32)
    words = [np.repeat(pc.fill_null(f, 0).to_numpy(zero_copy_only=False), some) for f in fixed]
    if len(own):
        begin, cuts, masks = every.flatten()
        at, _, held = flat(masks)
        starts, many, values = flat(cuts)
        picked = at + places(heads(begin, n), starts, many, values.to_numpy(zero_copy_only=False))
        first = (np.cumsum(sizes) - sizes)[own]
        to = ends[own] + np.arange(n)[:, None]
        for word, values in zip(words, held.flatten()):
            word[to] |= np.bitwise_or.reduceat(values.to_numpy(zero_copy_only=False)[picked], first, axis=1)
    return ends, words


def uniter(n: int, names: Sequence[str]) -> Callable[..., pa.Array]:
    """open, fixed words -> the words of each draw."""

    def run(lists: pa.Array, *fixed: pa.Array) -> pa.Array:
        ends, words = united(lists, fixed, n)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(w) for w in words], list(names)))

    return run


def scored(words: Sequence[np.ndarray], suppressed: Sequence[tuple[list[int], list[int]]], weighed: Sequence[tuple[float, list[int]]]) -> np.ndarray:
    """The score of each mask, given as words, by rules as Groups gives them."""
    kept = [w.copy() for w in words]
    for up, own in suppressed:
        hit = np.any([(w & p) != 0 for w, p in zip(words, up) if p], axis=0)
        for w, bits in zip(kept, own):
            if bits:
                w[hit] &= ~bits
    total = np.zeros(words[0].shape)
    for weight, bits in weighed:
        for w, b in zip(kept, bits):
            if b:
                total += weight * np.bitwise_count(w & b)
    return total


def scorer(n: int, suppressed: Sequence[tuple[list[int], list[int]]], weighed: Sequence[tuple[float, list[int]]]) -> Callable[..., pa.Array]:
    """open, fixed words -> the whole-numbered score of each draw, by rules as Groups gives them."""

    def run(lists: pa.Array, *fixed: pa.Array) -> pa.Array:
        ends, words = united(lists, fixed, n)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(scored(words, suppressed, weighed).astype(np.int32)))

    return run


#: Rows of whole encounters that go through a kernel at once: long arrays hash fastest, and these still fit a core's cache.
STEP = 40_000


def changes(table: pa.Table, *columns: str) -> np.ndarray:
    """Where runs of rows with equal columns begin; null equals null."""
    ends = [pc.run_end_encode(table[c].combine_chunks()).run_ends.to_numpy()[:-1] for c in columns]
    return np.unique(np.concatenate([[0], *ends])).astype(np.int64)[: len(table)]


def filled(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, 0).to_numpy()


def squeezed(table: pa.Table) -> pa.Table:
    """Rows sorted by encounter as one row for each encounter and prefix, with the union of their masks; so an encounter has no more rows than there
    are prefixes. An encounter's listed row comes first."""
    first = changes(table, "enc_id")
    prefs = table["pref"].combine_chunks().dictionary_encode()
    code = np.where(table["listed"].to_numpy(), 0, 1 + pc.fill_null(prefs.indices, len(prefs.dictionary)).to_numpy())
    key = np.repeat(np.arange(len(first)), np.diff(first, append=len(table))) * (len(prefs.dictionary) + 2) + code
    order = np.argsort(key)
    own = np.flatnonzero(np.diff(key[order], prepend=-1))
    out = table.take(order[own])
    if len(own) < len(table):
        for i, field in enumerate(table.schema):
            if field.type == pa.int64() and field.name != "enc_id":
                out = out.set_column(i, field, pa.array(np.bitwise_or.reduceat(filled(table[field.name])[order], own)))
    return out


def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by encounter as tables of whole encounters, squeezed."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= STEP:
            table = squeezed(pa.Table.from_batches(held))
            last = int(changes(table, "enc_id")[-1])
            if last:
                yield table.slice(0, last)
            # what stays is copied, so that the table before it can go
            held, rows = table.take(np.arange(last, len(table))).to_batches(), 0
    if sum(map(len, held)):
        yield squeezed(pa.Table.from_batches(held))


def drawn(begin: pa.Array, lists: pa.Array, fixed: list[np.ndarray], at: np.ndarray, n: int, rules: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The scores of encounters' draws. begin, lists and at: of each open prefix the text to hash, its cuts followed by the masks of its outcomes (a
    word of all, then the next), and its encounter, in ascending order; fixed: the words that all draws of each encounter have.
    Returns the scores without draws, the open encounters, and the scores of each of their draws (rows)."""
    once = scored(fixed, *rules)
    if not len(at):
        return once, at, np.zeros((n, 0))
    first = np.flatnonzero(np.diff(at, prepend=-1))
    open_ = at[first]
    starts, sizes, values = flat(lists)
    values, many = values.to_numpy(zero_copy_only=False), (sizes + 1) // (len(fixed) + 1)
    picked, out = places(heads(begin, n), starts, many - 1, values), np.empty((n, len(open_)))
    own = [w[open_] for w in fixed]
    for k in range(n):
        place = picked[k] + starts + many - 1
        words = []
        for w in own:
            words.append(w | np.bitwise_or.reduceat(values[place], first))
            place += many
        out[k] = scored(words, *rules)
    return once, open_, out


def mean(once: np.ndarray, open_: np.ndarray, draws: np.ndarray) -> np.ndarray:
    out = once.copy()
    out[open_] = draws.sum(axis=0) / len(draws)
    return out


def median(once: np.ndarray, open_: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The exact median; with an even number the mean of the middle two."""
    out, last = once.copy(), len(draws) - 1
    ordered = np.sort(np.ascontiguousarray(draws.T), axis=1)
    out[open_] = (ordered[:, last // 2] + ordered[:, (last + 1) // 2]) / 2
    return out


def likely(chances: pa.Array, at: np.ndarray, encounters: int, weights: Sequence[float], parents: Sequence[Sequence[int]]) -> np.ndarray:
    """The expected score of each encounter; chances: of each row (at: its encounter) groups and the logarithms of the chance that it does not bring them."""
    _, sizes, every = flat(chances)
    group, log = (x.to_numpy(zero_copy_only=False) for x in every.flatten())
    none = np.bincount(np.repeat(at, sizes) * len(weights) + group, log, encounters * len(weights)).reshape(encounters, len(weights))
    p, out = np.maximum(1 - np.exp(none), 0), np.zeros(encounters)
    for g, (w, up) in enumerate(zip(weights, parents)):
        out += p[:, g] * w * np.prod(1 - p[:, list(up)], axis=1)
    return out


def estimator(kinds: dict[str, list[str]], stages: Sequence[tuple[str, str, int, str, list[str]]], rules: tuple, chances: tuple | None, out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (enc_id, pref, listed, who, words of masks, open_<stage>, chances) sorted by enc_id -> a row for each listed encounter: enc_id, the words of kinds, and
    estimates: for each stage (name, what hashed texts begin with, number of draws, "mean" or "median", fixed words) one, and the expected score where chances (weights,
    parents of the groups) are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            first = changes(table, "enc_id")
            at = np.repeat(np.arange(len(first)), np.diff(first, append=len(table)))
            union = lambda c: np.bitwise_or.reduceat(filled(table[c]), first)  # noqa: B023, E731
            made = {"enc_id": table["enc_id"].take(first).combine_chunks()} | {c: pa.array(union(c)) for names in kinds.values() for c in names}
            for stage, begin, n, use, words in stages:
                lists = table[f"open_{stage}"].combine_chunks()
                some = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
                texts = pc.binary_join_element_wise(begin, table["who"].combine_chunks().take(some), "")
                made[stage] = pa.array({"mean": mean, "median": median}[use](*drawn(texts, lists.take(some), [union(c) for c in words], at[some], n, rules)))
            if chances:
                made["expected"] = pa.array(likely(table["chances"].combine_chunks(), at, len(first), *chances))
            listed = table["listed"].take(first).combine_chunks()
            yield pa.RecordBatch.from_arrays([made[c].cast(out.field(c).type) for c in out.names], schema=out).filter(listed)

    return run


cloudpickle.register_pickle_by_value(sys.modules[__name__])
