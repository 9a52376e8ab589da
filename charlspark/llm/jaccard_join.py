"""Operator 5: Jaccard join of shingle sets by a token-group matrix.

Documents are sets of hashed word shingles. Equal sets form classes first; the smallest id stands for a class. Classes
that may link at all are partitioned into groups of similar sets (near sizes, equal minima under a hash function, at most
about GROUP members), twice by different hash functions, and each group is joined within. What links so is one family; a family
is a unit, and so is what is left of a group. Sets that can link with smaller ones only (they have lost too many tokens, see below) never link
with each other, so any of near sizes whose frequent tokens have an equal minimum may form a unit. No unit has links within that are not known
already, so units meet other units only. The token-group matrix holds, for each token, the units whose union has
it, so a family of any size is one column of it. A query's overlap with a unit's union bounds its overlap with every member;
the join of a few of the queries' first tokens with the matrix, counted by (query, unit), opens only units that reach the bound and of these
only groups of a size that can link; there the members are counted exactly. Of two units the lighter one (that of fewer members) asks: a few sets
near a family of any size ask its one column each, not every member of the family theirs. Links inside a family add nothing and are not
looked for; every family that any link joins is found.

What keeps this small: a link leaves at most d = n - ceil(t n) of n tokens without partner. So in a common order of
tokens the first 2d + 1 decide, of which the partner's first tokens hold more than a bound that follows from the least
partner size. Documents with fewer tokens that occur in any other set drop out at once (shared_counts, with tokens
packed to four bytes; tokens that several sets of a task's run of texts share are settled there, so a frequent one is sent
once for each run). Of the others, tokens that no other set has are then taken out (stripped): they count in a set's size, come first in
the order and meet nobody. With s of its n tokens left, a set links with none of more than its reach, s (1 + t) / t - n, so
of two sets that link the smaller one reaches its own size at least. Copies with too many changes, of which a family may have
any number, so never meet each other. The order may be any; tokens frequent among what is left go last (HOT_ROUNDS rounds),
which thins the matrix without losing a link.

Defined results: null or wordless texts have empty sets and are linked with nothing; rows without id are left out; rows that
repeat an id are one document of several texts: each row gives its own number of shingles, and all share the component that any
of the texts reaches; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charlspark.llm.common import cut, parts_for, tidy
from charlspark.llm.components import components
from charlspark.llm.shingles import mixed, shingle_sets
from charlspark.llm.suffix_dedup import ragged

GROUP = 128
#: First tokens of a query that the matrix is asked for beyond those of which one must be met.
MORE = 1
QUERIES = 256
HOT, HOT_ROUNDS, HOT_MOST = 100, 4, 500_000
#: Units of fewer members without a family count as one member when two units settle which one asks.
FEW = 16
#: Bytes of text that are cut into shingles at a time, tokens that are packed at a time and looked through at a time.
SLICE_BYTES = 1_000_000
PACK_TOKENS = 500_000
SET_TOKENS = 500_000
#: MB of input files for each part of the first tokens.
PART_MB = 16


def missing(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of n that a link may leave without partner."""
    return n - -(-n * percent // 100)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, 2 * missing(n, percent) + 1)


def least_common(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that the prefixes of a set of n tokens and of any partner have in common, at least."""
    return np.minimum(missing(-(-n * percent // 100), percent) + 1, prefix_length(n, percent))


def bound(n: Column, reach: Column, least: Column, most: Column, percent: int) -> Column:
    """First tokens that a query of n tokens has in common with a partner in a group of sizes least to most, at least.

    Sets of n and m tokens that link have o >= p (n + m) tokens in common, p = t / (1 + t). Their first L(n) and L(m)
    tokens then have min(L(n) - n, L(m) - m) + o in common, and L(n) - n >= (1 - 2t) n - 1. In m this rises up to n and
    falls beyond it, so the least value is at an end of the sizes that can link."""
    t = percent / 100
    p = t / (1 + t)

    def at(m: Column) -> Column:
        return F.lit(1 - 2 * t) * F.greatest(n, m) - 1 + F.lit(p) * (n + m)

    low, high = F.greatest(least.cast("double"), n * t), F.least(most, reach).cast("double")
    return F.greatest(F.ceil(F.least(at(low), at(high)) - 1e-9), F.lit(1))


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    for batch in batches:
        ids, texts, held = [], [], 0
        for k in range(batch.num_rows):
            ids.append(batch.column(0)[k].as_py()), texts.append(batch.column(1)[k].as_py())
            held += len(texts[-1])
            if held >= SLICE_BYTES or k + 1 == batch.num_rows:
                yield ids, texts
                ids, texts, held = [], [], 0


def id_and_bytes(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.encode(F.coalesce(f"`{text}`", F.lit("")), "UTF-8").alias("t")).filter("id IS NOT NULL")


def summaries(frame: DataFrame, width: int) -> DataFrame:
    """id, n, digest (of the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for ids, texts in text_slices(batches):
            counts, h = shingle_sets(texts, width)
            ends = np.cumsum(counts)
            digest = [hashlib.blake2b(h[e - c : e].tobytes(), digest_size=16).digest() for c, e in zip(counts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int32()), pa.array(digest, pa.binary())], names=["id", "n", "digest"])

    return frame.mapInArrow(run, "id long, n int, digest binary")


def shared_counts(frame: DataFrame, width: int, percent: int, parts: int) -> DataFrame:
    """id, shared: how many of a document's first tokens occur among another document's first tokens (a few more, as
    tokens are told apart by part and four bytes)."""

    def packed(ids: np.ndarray, token: np.ndarray, doc: np.ndarray) -> pa.RecordBatch | None:
        order = np.argsort(token, kind="stable")
        token, doc = token[order], doc[order]
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        times = np.diff([*np.flatnonzero(new), len(token)])
        mine = np.repeat(times > 1, times)
        known = np.bincount(doc[mine], minlength=len(ids))
        token, doc, notice = token[new], doc[new], mine[new]  # one row for each token: a lone document's, or a notice of several
        spread = mixed(token)
        part, small = (spread >> np.uint64(32)) % np.uint64(parts), (spread & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order = np.lexsort((small, part))
        part, small, doc, notice = part[order].astype(np.int64), small[order], doc[order], notice[order]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(part)]):
            used, local = np.unique(doc[a:b], return_inverse=True)
            raw = np.diff(small[a:b], prepend=np.uint32(0)).tobytes() + local.astype(np.uint32).tobytes() + notice[a:b].astype(np.uint8).tobytes() + ids[used].tobytes()
            rows.append((int(part[a]), b - a, len(raw), pa.compress(transposed(raw, b - a), "zstd", asbytes=True)))
        if known.any():
            who = np.flatnonzero(known)
            raw = ids[who].tobytes() + known[who].astype(np.int64).tobytes()
            rows.append((int(ids[0]) % parts, -len(who), len(raw), raw))
        if rows:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["part", "k", "size", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_docs, n_tokens = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = packed(*map(np.concatenate, zip(*held))) if held else None
            held.clear()
            if out is not None:
                yield out

        for ids, texts in text_slices(batches):
            n, h = shingle_sets(texts, width)
            take = prefix_length(n, percent)
            held.append((np.array(ids, np.int64), h[ragged(np.cumsum(n) - n, take)], np.repeat(np.arange(len(ids)) + n_docs, take)))
            n_docs, n_tokens = n_docs + len(ids), n_tokens + int(take.sum())
            if n_tokens >= PACK_TOKENS:
                yield from flush()
                n_docs = n_tokens = 0
        yield from flush()

    def count(table: pa.Table) -> pa.Table:
        small, doc, notice, ids, sums = [], [], [], [], []
        for _, k, size, data in zip(*(table.column(c).to_pylist() for c in table.column_names)):
            if k < 0:
                ids.append(np.frombuffer(data, np.int64, -k)), sums.append(np.frombuffer(data, np.int64, -k, -8 * k))
                continue
            raw = untransposed(pa.decompress(data, size, "zstd", asbytes=True), k)
            small.append(np.cumsum(np.frombuffer(raw, np.uint32, k), dtype=np.uint32))
            local = np.frombuffer(raw, np.uint32, k, 4 * k)
            notice.append(np.frombuffer(raw, np.uint8, k, 8 * k).astype(bool))
            doc.append(np.frombuffer(raw, np.int64, offset=9 * k)[local])
        if small:
            small, doc, notice = map(np.concatenate, (small, doc, notice))
            order = np.argsort(small, kind="stable")
            small, doc, notice = small[order], doc[order], notice[order]
            cuts = np.flatnonzero(np.concatenate([[True], small[1:] != small[:-1]]))
            sizes = np.diff([*cuts, len(small)])
            shared = np.repeat((sizes > 1) | np.logical_or.reduceat(notice, cuts), sizes) & ~notice
            who, times = np.unique(doc[shared], return_counts=True)
            ids.append(who), sums.append(times)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table({"id": join(ids), "shared": join(sums).astype(np.int64)})

    return frame.mapInArrow(run, "part int, k int, size int, data binary").groupBy("part").applyInArrow(count, "id long, shared long").groupBy("id").agg(F.sum("shared").alias("shared"))


def transposed(raw: bytes, k: int) -> bytes:
    """The four-byte columns byte by byte, which packs better."""
    head = np.frombuffer(raw, np.uint8, 8 * k).reshape(2 * k, 4)
    return head.T.tobytes() + raw[8 * k :]


def untransposed(raw: bytes, k: int) -> bytes:
    return np.frombuffer(raw, np.uint8, 8 * k).reshape(4, 2 * k).T.tobytes() + raw[8 * k :]


def token_sets(frame: DataFrame, width: int) -> DataFrame:
    """id, n, tokens (ascending, as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_slices(batches):
            n, h = shingle_sets(texts, width)
            tokens = [h[e - c : e].tobytes() for e, c in zip(np.cumsum(n), n)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(tokens, pa.binary())], names=["id", "n", "tokens"])

    return frame.mapInArrow(run, "id long, n int, tokens binary")


def set_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about SET_TOKENS tokens; n is the second column."""
    for whole in batches:
        filled = np.cumsum(np.asarray(whole.column(1)).astype(np.int64)) // SET_TOKENS
        cuts = [0, *(np.flatnonzero(filled[1:] != filled[:-1]) + 1).tolist(), whole.num_rows]
        yield from (whole.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def flat(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a column of sets, and how many each set has."""
    raw = tokens.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64), np.array([len(x) // 8 for x in raw], np.int64)


def stripped(sets: DataFrame, percent: int) -> DataFrame:
    """id, n, tokens (those that another set has, too), reach (the size of the largest set it can link with), alike0, alike1 (two
    keys that similar sets tend to share); sets that keep too few tokens to link go."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in set_slices(batches):
            h, n = flat(batch.column(2))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n)))], names=["token", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in set_slices(batches):
            kept = []
            for raw, lone in zip(batch.column(2).to_pylist(), batch.column(3)):
                h = np.frombuffer(raw, np.uint64)
                kept.append(np.setdiff1d(h, lone.values.to_numpy(zero_copy_only=False).view(np.uint64), assume_unique=True) if lone.is_valid else h)
            n, s = np.asarray(batch.column(1)).astype(np.int64), np.array([len(h) for h in kept], np.int64)
            some = np.flatnonzero((100 * s >= percent * n) & (s > 0))
            if not len(some):
                continue
            n, s, kept = n[some], s[some], [kept[i] for i in some]
            h, starts = np.concatenate(kept), np.cumsum(s) - s
            alike = [mixed(size_class(n) ^ np.minimum.reduceat(mixed(h ^ np.uint64(1 + k)), starts)).view(np.int64) for k in (0, 1)]
            reach = (100 + percent) * s // percent - n
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(n, pa.int32()), pa.array([h.tobytes() for h in kept], pa.binary()), pa.array(reach), *map(pa.array, alike)], names=["id", "n", "tokens", "reach", "alike0", "alike1"])

    tokens = sets.select("id", "n", "tokens").mapInArrow(each, "token long, id long")
    # of an id with several sets each loses its own, as no other set has these tokens
    lone = tokens.groupBy("token").agg(F.count("*").alias("times"), F.min("id").alias("id")).filter("times = 1").groupBy("id").agg(F.collect_list("token").alias("lone"))
    return sets.join(lone, "id", "left").select("id", "n", "tokens", "lone").mapInArrow(run, "id long, n int, tokens binary, reach long, alike0 long, alike1 long")


def first_tokens(sets: DataFrame, hot: np.ndarray, percent: int) -> DataFrame:
    """token, id, n, reach, unit, weight, place, kept: the first tokens of each set, those in hot (ascending) last, each with its place among
    them and their number; what is stripped came before all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in set_slices(batches):
            n = np.asarray(batch.column(1)).astype(np.int64)
            h, s = flat(batch.column(2))
            owner = np.repeat(np.arange(len(n)), s)
            late = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h if len(hot) else np.zeros(len(h), bool)
            order = np.lexsort((h, late, owner))
            kept = np.maximum(prefix_length(n, percent) - (n - s), 0)
            at = order[ragged(np.cumsum(s) - s, kept)]
            who = owner[at]
            places = [pa.array(ragged(np.zeros(len(s), np.int64), kept)), pa.array(kept[who])]
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), *[batch.column(c).take(pa.array(who)) for c in (0, 1, 3, 4, 5)], *places], names=["token", "id", "n", "reach", "unit", "weight", "place", "kept"])

    return sets.select("id", "n", "tokens", "reach", "unit", "weight").mapInArrow(run, "token long, id long, n int, reach long, unit long, weight long, place long, kept long")


def size_class(n: np.ndarray) -> np.ndarray:
    return (np.log(n) * 6).astype(np.uint64)


def crowds(sets: DataFrame, hot: np.ndarray) -> DataFrame:
    """The sets and crowd: a key that sets of near sizes and with the same tokens in hot tend to share, null without such tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in set_slices(batches):
            h, s = flat(batch.column(2))
            owner = np.repeat(np.arange(len(s)), s)
            least = np.full(len(s), np.iinfo(np.uint64).max)
            if len(hot):
                often = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                np.minimum.at(least, owner[often], mixed(h[often] ^ np.uint64(3)))
            key = mixed(least ^ size_class(np.asarray(batch.column(1)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key.view(np.int64), mask=least == np.iinfo(np.uint64).max)], names=[*batch.schema.names, "crowd"])

    return sets.select("id", "n", "tokens", "reach", "grp").mapInArrow(run, "id long, n int, tokens binary, reach long, grp long, crowd long")


def links(n_q: int, q: np.ndarray, union: np.ndarray, starts: np.ndarray, member: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which members of an open group link with the set q: the group's tokens (ascending) and, for each, its members."""
    at = np.searchsorted(union, q)
    at[at == len(union)] = 0
    hit = at[union[at] == q]
    if 100 * len(hit) < percent * n_q:  # the bound by the union
        return np.zeros(0, np.int64)
    common = np.bincount(member[ragged(starts[hit], starts[hit + 1] - starts[hit])], minlength=len(sizes))
    return np.flatnonzero((common > 0) & (100 * common >= percent * (sizes + n_q - common)))


def matrix_of(sets: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """union, starts, member, sizes (before stripping) of a group's sets."""
    token, member = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(token, kind="stable")
    token, member = token[order], member[order]
    head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    return token[head], np.append(head, len(token)), member, sizes


def as_sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """id, n, tokens."""
    return np.asarray(table.column("id")), np.asarray(table.column("n")).astype(np.int64), [np.frombuffer(t.as_py(), np.uint64) for t in table.column("tokens")]


def edge_table(a: list, b: list) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def chunk(count: Column) -> Column:
    """The number of groups for count members."""
    return F.ceil(count / GROUP).alias("chunks")


def asks(q: str, u: str) -> Column:
    """Whether q's unit asks u's: of two units that may link the lighter one does, of equally heavy ones that of the smaller key."""
    return (F.col(f"{q}.weight") < F.col(f"{u}.weight")) | ((F.col(f"{q}.weight") == F.col(f"{u}.weight")) & (F.col(f"{q}.unit") < F.col(f"{u}.unit")))


def chunk_of(chunks: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("id", "tokens", F.lit(salt)), F.coalesce(chunks, F.lit(1)))


def families(sets: DataFrame, known: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """sets: as stripped; known: links a, b from elsewhere. Returns the sets with grp in place of the keys,
    and id, component of what links within the groups of either key."""
    for k in (0, 1):
        by = f"alike{k}"
        large = cut(sets.groupBy(by).agg(chunk(F.count("*"))).filter("chunks > 1"))
        sets = sets.join(large, by, "left").withColumn(f"grp{k}", F.xxhash64(by, chunk_of(F.col("chunks"), k))).drop("chunks", by)
    sets = cut(sets)

    def within(table: pa.Table) -> pa.Table:
        ids, n, own = as_sets(table)
        a, b = [], []
        if len(ids) > 1:
            m, root = matrix_of(own, n), list(range(len(ids)))
            for i, q in enumerate(own):
                for j in links(int(n[i]), q, *m, percent):
                    root[find(root, int(j))] = find(root, i)
            least: dict[int, int] = {}
            for i in range(len(ids)):
                least[find(root, i)] = min(int(ids[i]), least.get(find(root, i), int(ids[i])))
            for i in range(len(ids)):
                if (top := least[find(root, i)]) != ids[i]:
                    a.append(int(ids[i])), b.append(top)
        return edge_table(a, b)

    edges = known
    for k in (0, 1):
        edges = edges.unionByName(sets.groupBy(f"grp{k}").applyInArrow(within, "a long, b long"))
    return sets.withColumnRenamed("grp0", "grp").drop("grp1"), components(edges)


def hot_tokens(sets: DataFrame, percent: int) -> np.ndarray:
    """Tokens that are frequent among the first ones, in rounds, HOT_MOST at most (they only choose the order)."""
    hot = np.zeros(0, np.uint64)
    for _ in range(HOT_ROUNDS):
        often = first_tokens(sets, hot, percent).groupBy("token").count().filter(F.col("count") > HOT).orderBy(F.desc("count"), "token").limit(HOT_MOST)
        found = often.select("token").toArrow()["token"].to_numpy().view(np.uint64)
        if not len(np.setdiff1d(found, hot)):
            break
        hot = np.union1d(hot, found)[:HOT_MOST]
    return hot


def join_sets(sets: DataFrame, known: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Two tables id, component: what the groups link, and, over these components (or ids), what the matrix adds."""
    sets, first = families(sets, known, percent)
    hot = hot_tokens(sets.withColumnRenamed("grp", "unit").withColumn("weight", F.lit(1).cast("long")), percent)
    sets = cut(crowds(sets, hot))
    sizes = first.groupBy("component").agg(F.count("*").alias("members"))
    family = cut(first.join(sizes, "component").select("id", F.col("component").alias("comp"), "members"))
    named = sets.join(family, "id", "left")
    alone, short = F.col("comp").isNull(), F.col("reach") < F.col("n")
    # a unit never meets itself: sets that reach only smaller ones do not link with each other, whatever unites them; all others
    # without a family share a unit only if their group has been joined within
    unit = F.when(alone, F.xxhash64(F.when(short, F.coalesce("crowd", "grp")).otherwise(F.col("grp")), short)).otherwise(F.xxhash64("comp", F.lit(1)))
    sets = cut(named.select("id", "n", "reach", "tokens", F.coalesce("comp", "id").alias("comp"), unit.alias("unit"), "members"))
    others = sets.filter("members IS NULL").groupBy("unit").agg(F.count("*").alias("others")).filter(F.col("others") >= FEW)
    sets = sets.join(others, "unit", "left").withColumn("weight", F.coalesce("members", "others", F.lit(1).cast("long")))
    sets = sets.withColumn("grp", F.xxhash64("unit", chunk_of(chunk(F.col("weight")), 2)))
    sets = cut(sets.select("id", "n", "reach", "tokens", "comp", "unit", "weight", "grp"))

    def across(key: tuple, queries: pa.Table, members: pa.Table) -> pa.Table:
        """Links between the components of queries and members, less those whose ends others of this task already connect."""
        a, b = [], []
        if queries.num_rows and members.num_rows:
            _, n, own = as_sets(members)
            comps, root = [*members.column("comp").to_pylist(), *queries.column("comp").to_pylist()], {}
            for c in comps:
                root[c] = c
            m = matrix_of(own, n)
            for k, q, c in zip(*as_sets(queries)[1:], queries.column("comp").to_pylist()):
                for j in links(int(k), q, *m, percent):
                    x, y = find(root, c), find(root, comps[j])
                    if x != y:
                        root[x] = y
                        a.append(c), b.append(comps[j])
        return edge_table(a, b)

    span = (F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("far"), F.every(F.col("reach") < F.col("n")).alias("short"))
    rows = first_tokens(sets, hot, percent)
    shared = rows.groupBy("token").agg(F.min("unit").alias("lo"), F.max("unit").alias("hi")).filter("lo <> hi").select("token")
    rows = cut(rows.join(shared, "token"))
    union = rows.select("token", "unit").distinct().join(sets.groupBy("unit").agg(F.max("weight").alias("weight"), *span), "unit")
    # each of two sets that link has a size that the other reaches, and the smaller one reaches its own
    near = lambda q, u: (F.col(f"{u}.least") <= F.col(f"{q}.reach")) & (F.col(f"{u}.far") >= F.col(f"{q}.n")) & ((F.col(f"{q}.reach") >= F.col(f"{q}.n")) | ~F.col(f"{u}.short"))
    # of the first tokens at most kept - bound lie outside a partner's, so a few of them decide as well as all: asked of them, all
    # but so many must be met; how many are asked of a unit depends on its sizes
    often = lambda least, most: bound(F.col("q.n"), F.col("q.reach"), least, most, percent)
    asked = lambda least, most: F.least(F.col("q.kept"), F.col("q.kept") - often(least, most) + 1 + MORE)
    sized = F.col("u.least"), F.col("u.most")
    asking = rows.alias("q").filter(F.col("q.place") < asked(F.lit(0), F.col("q.reach")))
    met = asking.join(union.alias("u"), (F.col("q.token") == F.col("u.token")) & asks("q", "u") & near("q", "u") & (F.col("q.place") < asked(*sized)))
    need = F.greatest(asked(*sized) - F.col("q.kept") + often(*sized), F.lit(1))
    met = met.select("q.id", "q.n", "q.reach", "u.unit", need.alias("need")).groupBy("id", "n", "reach", "unit", "need").count()
    met = met.filter(F.col("count") >= F.col("need")).select("id", "n", "reach", "unit")
    groups = sets.groupBy("unit", "grp").agg(*span)
    opened = met.alias("q").join(groups.alias("u"), (F.col("q.unit") == F.col("u.unit")) & near("q", "u"))
    opened = cut(opened.select("q.id", "u.grp").distinct())
    turns = cut(opened.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES).alias("turns")))
    queries = opened.join(turns, "grp").withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns"))).select("id", "grp", "turn").join(sets.select("id", "n", "tokens", "comp"), "id")
    again = sets.select(*[F.col(c).alias(c) for c in ("id", "n", "tokens", "comp", "grp")])  # its own columns, as it meets itself
    members = again.join(turns.select(F.col("grp").alias("grp"), F.col("turns").alias("turns")), "grp").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).select("id", "n", "tokens", "comp", "grp", "turn")
    outer = queries.groupBy("grp", "turn").cogroup(members.groupBy("grp", "turn")).applyInArrow(across, "a long, b long")
    return first, components(outer)


def find(root: list[int] | dict[int, int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def join(docs: DataFrame, width: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest id with the same set): one row for each document."""
    frame = id_and_bytes(docs, key, text)
    slim = cut(summaries(frame, width))
    classes = cut(slim.filter("n > 0").groupBy("digest").agg(F.min("id").alias("class_id"), F.first("n").alias("n")))
    worded = F.when(F.col("n") > 0, F.col("digest"))
    per_id = slim.groupBy("id").agg(F.count("*").alias("rows"), F.min(worded).alias("lo"), F.max(worded).alias("hi"), F.min("n").alias("least")).filter("rows > 1 AND (lo <> hi OR least = 0 AND hi IS NOT NULL)")
    per_id = cut(per_id.select("id", "hi", (F.col("lo") != F.col("hi")).alias("twice"), (F.col("least") == 0).alias("part_empty")))
    several = slim.filter("n > 0").join(per_id.filter("twice").select("id"), "id").select("id", "digest").join(classes.select("digest", "class_id"), "digest")
    known = several.groupBy("id").agg(F.min("class_id").alias("b")).join(several.select("id", F.col("class_id").alias("a")), "id").select("a", "b").distinct()
    low = F.ceil(F.col("n").cast("long") * percent / 100)
    need = F.least(low - F.ceil(low * percent / 100) + 1, F.least(F.col("n"), (F.col("n") - low) * 2 + 1))
    counts = shared_counts(frame, width, percent, parts_for(docs, PART_MB, least=96))
    able = cut(classes.join(counts, F.col("class_id") == F.col("id")).filter(F.col("shared") >= need).select("id").distinct())
    sets = token_sets(frame.join(able.hint("shuffle_hash"), "id", "left_semi"), width).filter("n > 0").distinct()
    first, rest = join_sets(cut(stripped(cut(sets), percent)), known, percent)
    named = classes.select("digest", "class_id").join(first.select(F.col("id").alias("class_id"), F.col("component").alias("c")), "class_id", "left").withColumn("c", F.coalesce("c", "class_id"))
    named = named.join(rest.withColumnRenamed("id", "c"), "c", "left").select("digest", "class_id", F.coalesce("component", "c").alias("component"))
    named = cut(named)
    out = slim.join(named, "digest", "left")
    # an id's wordless rows share the component of its other rows
    other = per_id.filter("part_empty").select("id", F.col("hi").alias("digest")).join(named, "digest").select(F.col("id").alias("other_id"), F.col("component").alias("other"))
    out = out.join(cut(other), (F.col("n") == 0) & (F.col("id") == F.col("other_id")), "left")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.coalesce("other", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id")).alias("class_id"))
