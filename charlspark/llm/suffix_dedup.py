"""Operator 2: removal of long repeats across documents by longest-previous-factor arrays in suffix order.

A byte goes if a WIDTH-byte string that covers it also starts in a document with a smaller id. A suffix's longest previous
factor is its longest common prefix with a suffix of a document with a smaller id; in suffix order that is one of two, the
nearest place before and the nearest place after with a smaller document (previous and next smaller positions), and its length the
least common prefix of neighbours on the way. Where it is WIDTH or more, these bytes go; the first copy has no smaller
document and stays. What lies beyond WIDTH bytes does not matter, so suffixes end there.

The suffix order is cut into parts that need no text from each other: every WIDTH-byte window belongs to the smallest hash
among its GRAM-byte grams (its minimizer), so equal windows meet in one part. Consecutive windows mostly share it and
travel as one string of n + WIDTH - 1 bytes, packed by part. Before they travel, strings that occur whole in several
documents of a task's slice are settled there: all but the smallest document's copy are removed windows, and the smallest
one stands for them. So a passage that a third of all documents share reaches its part once for each slice, not once for
each document. Hashes only choose the part and the candidates; bytes decide.

The texts travel once more, packed by buckets of documents, to meet the runs that go.

Defined results: a null text counts as empty; texts under WIDTH bytes keep all; rows without id take no part and keep all;
rows that repeat an id are copies of one document; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlspark.llm.common import parts_for, tidy, whole_text

WIDTH, GRAM = 50, 8
SLICE_BYTES = 3_000_000
#: Bytes of strings that are sorted at a time.
RUN_BYTES = 1_000_000
#: Level of the packing.
LEVEL = 6
#: MB of input files for each part; its windows' strings take about six times that.
PART_MB = 2.5

ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** i modulo 2**64."""
    out = np.ones(n, np.uint64)
    filled = 1
    step = int(base)
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(step)
        filled += more
        step = step * step % (1 << 64)
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes starts[k] .. starts[k] + lengths[k] - 1, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def words(s: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as an integer (s is padded by 8 bytes or more)."""
    n = len(s) - 7
    out = np.empty(n, np.uint64)
    for r in range(8):
        part = s[r : r + (len(s) - r) // 8 * 8].view("<u8")
        out[r::8] = part[: len(out[r::8])]
    return out


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of w values from each position on (shorter by w - 1)."""
    size = 1
    while size * 2 <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return h if size == w else np.minimum(h[: len(h) - (w - size)], h[w - size :])


def cut_strings(s: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, number of windows and minimizer of each run of windows of one text that share a minimizer."""
    total = int(lengths.sum())
    w = words(np.concatenate([s[:total], np.zeros(WIDTH + 16, np.uint8)]))
    h = w[: total + WIDTH] * ODD  # a word is a gram
    h ^= h >> np.uint64(29)
    gram = (h * ODD >> np.uint64(32)).astype(np.uint32)
    least = sliding_min(gram, WIDTH - GRAM + 1)[:total]
    n = np.maximum(lengths - (WIDTH - 1), 0)
    edge = np.zeros(total + 2, np.int32)
    np.add.at(edge, offsets + 1, 1)
    np.add.at(edge, offsets + n + 1, -1)
    valid = np.cumsum(edge) > 0  # shifted by one: valid[0] is False
    change = np.zeros(total + 2, bool)
    change[1 : total + 1] = valid[1 : total + 1]
    change[2 : total + 1] &= ~valid[1:total] | (least[1:] != least[:-1])
    starts = np.flatnonzero(change) - 1
    ends = np.flatnonzero(valid[:-1] & (~valid[1:] | change[1:]))
    return starts, ends - starts, least[starts]


def settle(s: np.ndarray, doc: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which strings equal one of a smaller document in this slice; only the smallest document's stands for equal ones."""
    length = n + WIDTH - 1
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s.astype(np.uint64) * powers(BASE, len(s)), dtype=np.uint64)])
    key = (total[starts + length] - total[starts]) * powers(inverse, len(s) + 1)[starts] + n.astype(np.uint64) * ODD
    order = np.lexsort((doc, key))
    head = np.ones(len(order), bool)
    head[1:] = key[order][1:] != key[order][:-1]
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    later = order[(doc[order] > doc[first]) & (n[order] == n[first])]
    first = first[(doc[order] > doc[first]) & (n[order] == n[first])]
    differs = s[ragged(starts[later], length[later])] != s[ragged(starts[first], length[first])]
    at = np.cumsum(length[later]) - length[later]
    equal = np.add.reduceat(differs, at) == 0 if len(later) else np.zeros(0, bool)
    out = np.zeros(len(doc), bool)
    out[later[equal]] = True
    return out


def planes(*columns: np.ndarray) -> bytes:
    """Columns of four-byte integers, byte by byte, which packs better."""
    return b"".join(np.ascontiguousarray(c, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns)


def from_planes(raw: bytes, k: int, n: int) -> list[np.ndarray]:
    """The first n columns of k integers each."""
    return [np.frombuffer(raw, np.uint8, 4 * k, 4 * k * i).reshape(4, k).T.copy().view("<i4").ravel().astype(np.int64) for i in range(n)]


def dealt(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each document."""
    return ((ids.astype(np.uint64) * ODD >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def pack_slice(ids: list[int], texts: list[bytes], parts: int) -> pa.RecordBatch | None:
    """The strings of some documents, packed by part; windows that are settled here go along with some part."""
    lengths = np.array([len(t) for t in texts], np.int64)
    if not (lengths >= WIDTH).any():
        return None
    offsets = np.cumsum(lengths) - lengths
    s = np.frombuffer(b"".join(texts), np.uint8)
    starts, n, least = cut_strings(s, offsets, lengths)
    text = np.searchsorted(offsets, starts, "right") - 1
    doc, place = np.array(ids, np.int64)[text], starts - offsets[text]
    done = settle(s, doc, starts, n)
    settled = doc[done].tobytes() + place[done].astype(np.int64).tobytes() + n[done].astype(np.int64).tobytes()
    rest = np.flatnonzero(~done)
    part = ((least[rest].astype(np.uint64) * ODD) >> np.uint64(33)) % np.uint64(parts)
    order = np.lexsort((least[rest], part))
    rest, part = rest[order], part[order].astype(np.int64)
    length = n[rest] + WIDTH - 1
    data = s[ragged(starts[rest], length)]
    ends = np.concatenate([[0], np.cumsum(length)])
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    rows: list[tuple] = []
    codec = pa.Codec("zstd", LEVEL)
    all_ids = np.array(ids, np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(part)]):
        own = rest[a:b]
        used, local = np.unique(text[own], return_inverse=True)
        raw = planes(local, place[own], n[own], np.diff(least[own].view(np.int32), prepend=np.int32(0))) + all_ids[used].tobytes() + data[ends[a] : ends[b]].tobytes()
        rows.append((int(part[a]), len(own), len(used), len(raw), codec.compress(raw, asbytes=True), b""))
    if settled:
        rows.append((ids[0] % parts, 0, 0, 0, b"", settled))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["part", "k", "docs", "size", "data", "settled"])


def repeats_in_part(table: pa.Table, buckets: int) -> pa.Table:
    """Longest previous factors within one part: runs of bytes to remove."""
    out_doc, out_start, out_end = [], [], []
    docs, places, ns, leasts, texts = [], [], [], [], []
    for k, m, size, data, settled in zip(*(table.column(c) for c in ("k", "docs", "size", "data", "settled"))):
        if settled.as_py():
            d, a, n = np.frombuffer(settled.as_py(), np.int64).reshape(3, -1)
            out_doc.append(d), out_start.append(a), out_end.append(a + n + WIDTH - 1)
        if k := k.as_py():
            raw = pa.decompress(data.as_py(), size.as_py(), "zstd", asbytes=True)
            local, place, n, steps = from_planes(raw, k, 4)
            docs.append(np.frombuffer(raw, np.int64, m.as_py(), 16 * k)[local])
            places.append(place), ns.append(n)
            leasts.append(np.cumsum(steps).astype(np.int32))
            texts.append(np.frombuffer(raw, np.uint8, offset=16 * k + 8 * m.as_py()))
    if docs:
        doc, place, n, least = map(np.concatenate, (docs, places, ns, leasts))
        s = np.concatenate(texts)
        length = n + WIDTH - 1
        at = np.cumsum(length) - length
        # only minimizers of several documents can repeat
        order = np.lexsort((doc, least))
        head = np.concatenate([[True], least[order][1:] != least[order][:-1]])
        groups = np.flatnonzero(head)
        several = np.minimum.reduceat(doc[order], groups) != np.maximum.reduceat(doc[order], groups)
        sizes = np.diff([*groups, len(order)])[several]
        kept = order[np.repeat(several, np.diff([*groups, len(order)]))]
        # runs of whole groups, so that the working arrays stay small
        filled = np.cumsum(np.add.reduceat(length[kept], np.cumsum(sizes) - sizes)) if len(kept) else np.zeros(0, np.int64)
        run = np.repeat(filled // RUN_BYTES, sizes)
        for own in np.split(kept, np.flatnonzero(run[1:] != run[:-1]) + 1):
            text = s[ragged(at[own], length[own])]
            out = windows(text, np.cumsum(length[own]) - length[own], n[own], doc[own], place[own])
            for store, new in zip((out_doc, out_start, out_end), out):
                store.append(new)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    doc = join(out_doc)
    return pa.table({"bucket": dealt(doc, buckets).astype(np.int32), "doc_id": doc, "s": join(out_start).astype(np.int32), "e": join(out_end).astype(np.int32)})


def common_prefixes(keys: Iterator[np.ndarray], n: int) -> np.ndarray:
    """Bytes, WIDTH at most, that each of n suffixes has in common with the one before it; keys: their words, in suffix order."""
    out = np.zeros(max(0, n - 1), np.int64)
    equal = np.arange(len(out))
    for k in keys:
        x = k[equal + 1] ^ k[equal]
        differ = x != 0
        for j in range(1, 8):
            out[equal[differ]] += x[differ] >> np.uint64(64 - 8 * j) == 0
        equal = equal[~differ]
        out[equal] += 8
    return np.minimum(out, WIDTH)


def smaller_before(d: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place in suffix order the common prefix with the nearest place before it that has a smaller document (0: none
    within WIDTH bytes). All places jump at once: between a place and its candidate no document is smaller, so the
    candidate's own candidate is the next one to look at."""
    to, reach = np.arange(len(d)) - 1, np.concatenate([np.zeros(1, np.int64), lcp])
    while True:
        going = np.flatnonzero(reach >= WIDTH)
        going = going[d[to[going]] >= d[going]]
        if not len(going):
            return reach
        at = to[going]
        to[going], reach[going] = to[at], np.minimum(reach[going], reach[at])


def windows(s: np.ndarray, at: np.ndarray, n: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start, end of the runs of removed windows; at, n, doc, place: where the strings lie in s and in their texts."""
    none = (np.zeros(0, np.int64),) * 3
    if not len(at):
        return none
    pos, own = ragged(at, n), np.repeat(np.arange(len(at)), n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(s.astype(np.uint64) * powers(BASE, len(s)), dtype=np.uint64)])
    key = (total[pos + WIDTH] - total[pos]) * powers(np.uint64(pow(int(BASE), -1, 1 << 64)), len(s))[pos]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(pos), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cand = np.flatnonzero(twice)
    if not len(cand):
        return none
    # suffix order of the windows that may repeat (others have factors under WIDTH), by big-endian words
    padded = words(np.concatenate([s, np.zeros(16, np.uint8)])).byteswap()
    keys = [padded[pos[cand] + 8 * k] for k in range(WIDTH // 8)]
    if WIDTH % 8:
        keys.append(padded[pos[cand] + WIDTH - WIDTH % 8] >> np.uint64(64 - WIDTH % 8 * 8) << np.uint64(64 - WIDTH % 8 * 8))
    suffix = np.lexsort(keys[::-1])
    lcp = common_prefixes((k[suffix] for k in keys), len(suffix))
    del keys, padded
    d = doc[own[cand[suffix]]]
    before, after = smaller_before(d, lcp), smaller_before(d[::-1], lcp[::-1])[::-1]
    gone = np.zeros(len(pos), bool)
    gone[cand[suffix[np.maximum(before, after) >= WIDTH]]] = True
    g = np.flatnonzero(gone)
    if not len(g):
        return none
    first = np.concatenate([[True], (g[1:] != g[:-1] + 1) | (own[g][1:] != own[g][:-1])])
    a, b = g[first], g[np.concatenate([np.flatnonzero(first)[1:] - 1, [len(g) - 1]])]
    start = place[own[a]] + pos[a] - at[own[a]]
    return doc[own[a]], start, start + (b - a) + WIDTH


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """ids and texts of about SLICE_BYTES."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for k in range(batch.num_rows):
            ids.append(batch.column(0)[k].as_py()), texts.append(batch.column(1)[k].as_py())
            held += len(texts[-1])
            if held >= SLICE_BYTES or k + 1 == batch.num_rows:
                yield ids, texts
                ids, texts, held = [], [], 0


def repeats(own: DataFrame, parts: int, buckets: int) -> DataFrame:
    """own: doc_id, t -> bucket, doc_id, s, e: runs of bytes (end exclusive, they may overlap) that repeat a document with
    a smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for ids, texts in slices(batches):
            packed = pack_slice(ids, texts, parts)
            if packed is not None:
                yield packed

    def in_part(table: pa.Table) -> pa.Table:
        tidy()
        return repeats_in_part(table, buckets)

    packed = own.filter("doc_id IS NOT NULL").mapInArrow(run, "part int, k int, docs int, size int, data binary, settled binary")
    return packed.groupBy("part").applyInArrow(in_part, "bucket int, doc_id long, s int, e int")


def spans(s: np.ndarray, e: np.ndarray) -> list[tuple[int, int]]:
    """The union of runs, as maximal runs."""
    if not len(s):
        return []
    order = np.argsort(s, kind="stable")
    s, far = s[order], np.maximum.accumulate(e[order])
    first = np.flatnonzero(np.concatenate([[True], s[1:] > far[:-1]]))
    return list(zip(s[first].tolist(), far[np.append(first[1:], len(s)) - 1].tolist()))


def packed_texts(own: DataFrame, buckets: int) -> DataFrame:
    """own: doc_id, t -> bucket, k, size, data: texts packed by bucket, so that they travel small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", LEVEL)
        for ids, texts in slices(batches):
            known = np.array([i is not None for i in ids])
            number = np.array([i or 0 for i in ids], np.int64)
            bucket, rows = dealt(number, buckets), []
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]]))
            for own_rows in np.split(order, cuts[1:]):
                lengths = np.array([len(texts[i]) for i in own_rows], np.int64)
                raw = number[own_rows].tobytes() + known[own_rows].tobytes() + lengths.tobytes() + b"".join(texts[i] for i in own_rows)
                rows.append((int(bucket[own_rows[0]]), len(own_rows), len(raw), codec.compress(raw, asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["bucket", "k", "size", "data"])

    return own.mapInArrow(run, "bucket int, k int, size long, data binary")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the bytes that stay."""
    own = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.encode(whole_text(f"`{text}`"), "UTF-8").alias("t"))
    buckets = parts_for(docs, 4, least=96)
    runs = repeats(own, parts_for(docs, PART_MB, least=96), buckets)
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}
    if not with_text:
        del kinds["kept"]

    def finish(texts: pa.Table, gone: pa.Table) -> pa.Table:
        ids, s, e = (np.asarray(gone.column(c)) for c in ("doc_id", "s", "e"))
        order = np.argsort(ids, kind="stable")
        ids, s, e = ids[order], s[order], e[order]
        rows = []
        for k, size, data in zip(*(texts.column(c).to_pylist() for c in ("k", "size", "data"))):
            raw = pa.decompress(data, size, "zstd", asbytes=True)
            number, known, lengths = np.frombuffer(raw, np.int64, k), np.frombuffer(raw, bool, k, 8 * k), np.frombuffer(raw, np.int64, k, 9 * k)
            at, lo, hi = 17 * k, np.searchsorted(ids, number, "left"), np.searchsorted(ids, number, "right")
            for i in range(k):
                t = raw[at : at + int(lengths[i])]
                at += len(t)
                cut = spans(s[lo[i] : hi[i]], e[lo[i] : hi[i]]) if known[i] else []
                kept = t if not cut else b"".join(t[a:b] for a, b in zip([0, *[y for _, y in cut]], [*[x for x, _ in cut], len(t)]))
                rows.append((int(number[i]) if known[i] else None, len(t), len(t) - len(kept), len(cut), hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.table({n: pa.array(c, kind) for (n, kind), c in zip(kinds.items(), columns)})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return packed_texts(own, buckets).groupBy("bucket").cogroup(runs.groupBy("bucket")).applyInArrow(finish, schema)
