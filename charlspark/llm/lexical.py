"""Operator 12: exact ranked lexical search over a length-stratified index.

A term's score in a document depends on its weight, its occurrences tf and the document's normaliser m, which depends on the
document's length alone. So documents of equal m form a stratum; within one, postings are ordered by term and tf, and an impact is computed
once for each tf that occurs. The highest tf of each term bounds every score of a stratum; bounds order the visits and
strata whose bound is below a query's k-th score stay closed.

As Spark jobs: texts become rows of term numbers and counts, once; rows are sorted by range of m, which neither needs a join nor puts a
frequent length into one task, and runs of one m become blocks of at most BLOCK documents (a stratum may have several); an index is a table of blocks.
A search reads the blocks' bounds first, scores the best block of each query for a k-th score to start from, then visits
all blocks of each task in the order of their bounds. Tasks send k rows for each query at most.

An index holds the terms that its queries have (others cannot score), for all documents. Queries are taken QUERY_BYTES at a
time, a bounded batch that goes to all tasks; a larger set takes several batches, each with an index of its own.

Defined results: a null or termless document is not counted and not found; documents without id count in the statistics and are not
found; rows that repeat an id are found each on its own; a query without terms, or none that any document has, finds nothing;
queries without id are left out, rows that repeat one are queries of their own; extra columns are ignored; empty tables give an empty
table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from charlspark.llm.common import cut, parts_for
from charlspark.llm.suffix_dedup import ragged
from charlspark.llm.terms import binaries, id_and_text, text_slices, words

#: Documents of a block, at most; their places are kept in two bytes.
BLOCK = 2048
#: Bytes of query texts that are answered together.
QUERY_BYTES = 16_000_000
#: MB of the written rows for each range of m. Ranges have as many rows each, so that of the longest documents has more MB.
RANGE_MB = 4

BLOCKS = "block long, m long, ids binary, terms binary, ends binary, tops binary, docs binary, tfs binary"


@dataclass(frozen=True)
class Queries:
    """A batch of queries: terms are numbers in the vocabulary, times how often a query has them."""

    ids: list
    vocabulary: pa.Array
    starts: np.ndarray
    term: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> "Queries":
        ids, text = rows.column("id").combine_chunks(), rows.column("text").combine_chunks()
        counts, code, vocabulary = words(text)
        size = max(len(vocabulary), 1)
        key, times = np.unique(np.repeat(np.arange(len(counts)), counts) * size + code, return_counts=True)
        owner, term = np.divmod(key, size)
        used, starts = np.unique(owner, return_index=True)
        return Queries([ids[int(i)].as_py() for i in used], vocabulary, starts, term, times.astype(np.int64))

    def span(self, q: int) -> slice:
        return slice(self.starts[q], self.starts[q + 1] if q + 1 < len(self.starts) else len(self.term))


def forward(docs: DataFrame, vocabulary: pa.Array, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n (terms of the text, repeats counted), terms, tfs (of those in the vocabulary): documents with any term."""
    size = max(len(vocabulary), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            n, code, distinct = words(batch.column("text"))
            known = pc.fill_null(pc.index_in(distinct, value_set=vocabulary), -1).to_numpy().astype(np.int64)[code]
            owner = np.repeat(np.arange(len(n)), n)[known >= 0]
            pair, tf = np.unique(owner * size + known[known >= 0], return_counts=True)
            owner, term = np.divmod(pair, size)
            counts = np.bincount(owner, minlength=len(n))
            out = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n.astype(np.int64)), binaries(term.astype(np.int32), counts), binaries(tf.astype(np.int32), counts)], names=["id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return id_and_text(docs, key, text).mapInArrow(run, "id long, n long, terms binary, tfs binary")


def index(rows: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The blocks: of each, its m, its documents' ids, its terms (ascending) with the end of each one's postings and its
    highest tf, and the postings (place of the document, tf) by term, then tf, the highest first."""

    def block(number: int, m: int, ids: list, terms: list, tfs: list) -> dict:
        counts = [len(t) // 4 for t in terms]
        term, tf = np.frombuffer(b"".join(terms), np.int32), np.frombuffer(b"".join(tfs), np.int32)
        doc = np.repeat(np.arange(len(ids)), counts)
        order = np.lexsort((doc, -tf, term))
        term, tf, doc = term[order], tf[order], doc[order]
        head = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        data = (np.array(ids, np.int64), term[head], np.append(head[1:], len(term)).astype(np.int32) if len(head) else head.astype(np.int32), tf[head], doc.astype(np.uint16), tf)
        return dict(zip(("block", "m", "ids", "terms", "ends", "tops", "docs", "tfs"), (number, m, *(x.tobytes() for x in data))))

    types = pa.schema([("block", pa.int64()), ("m", pa.int64()), *((c, pa.binary()) for c in ("ids", "terms", "ends", "tops", "docs", "tfs"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        done: list[dict] = []

        def close() -> None:
            nonlocal number
            if held:
                m, *columns = zip(*held)
                done.append(block(number, m[0], *columns))
                number += 1
                held.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("m", "id", "terms", "tfs"))):
                if held and (row[0] != held[0][0] or len(held) == BLOCK):
                    close()
                held.append(row)
            if len(done) >= 16:
                yield pa.RecordBatch.from_pylist(done, types)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, types)

    found = rows.filter("id IS NOT NULL").withColumn("m", F.lit(25).cast("long") + F.expr(f"(75 * n * {n_docs}L) div {max(n_terms, 1)}L"))
    spread = found.repartitionByRange(parts_for(rows, RANGE_MB), "m", F.xxhash64("id", "terms")).sortWithinPartitions("m")
    return spread.select("m", "id", "terms", "tfs").mapInArrow(run, BLOCKS)


def document_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How many of the rows hold each term of the vocabulary; tasks send one row for each term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    found = rows.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def bounds(q: Queries, weight: np.ndarray, m: int, terms: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """No document of the block scores more for each query."""
    best = np.zeros(len(weight), np.int64)
    best[terms] = weight[terms] * impacts(tops, m)
    return np.add.reduceat(best[q.term] * q.times, q.starts)


class Best:
    """The k best of each query so far: equal scores by id."""

    def __init__(self, k: int, floor: np.ndarray) -> None:
        self.k, self.floor, self.kept = k, floor.copy(), {}

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        if q in self.kept:
            score, ids = np.concatenate([self.kept[q][0], score]), np.concatenate([self.kept[q][1], ids])
        top = np.lexsort((ids, -score))[: self.k]
        self.kept[q] = score[top], ids[top]
        if len(top) == self.k:
            self.floor[q] = max(self.floor[q], score[top[-1]])

    def batch(self) -> pa.RecordBatch:
        rows = [(q, int(s), int(i)) for q, (score, ids) in self.kept.items() for s, i in zip(score, ids)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))], names=["q", "score", "id"])


def visit(q: Queries, weight: np.ndarray, row: dict, asked: np.ndarray, best: Best) -> None:
    """Scores a block's documents for the queries asked."""
    of = lambda c, t: np.frombuffer(row[c], t)
    ids, terms, ends, docs = of("ids", np.int64), of("terms", np.int32), of("ends", np.int32).astype(np.int64), of("docs", np.uint16)
    distinct, which = np.unique(of("tfs", np.int32), return_inverse=True)
    size = np.diff(ends, prepend=0)
    impact = impacts(distinct, row["m"])[which] * np.repeat(weight[terms], size)  # once for each tf
    place = np.full(len(weight), -1)
    place[terms] = np.arange(len(terms))
    for k in asked:
        own = q.span(k)
        at, times = place[q.term[own]], q.times[own]
        at, times = at[at >= 0], times[at >= 0]
        if len(at):
            here = ragged(ends[at] - size[at], size[at])
            score = np.bincount(docs[here], impact[here] * np.repeat(times, size[at]), len(ids)).astype(np.int64)  # whole numbers below 2^53
            some = np.flatnonzero(score >= max(best.floor[k], 1))
            if len(some):
                best.add(int(k), score[some], ids[some])


def answered(blocks: DataFrame, q: Queries, weight: np.ndarray, k: int) -> DataFrame:
    """q, score, id: the k best of every task for each query, less those that some block shows to be beaten."""
    n = len(q.ids)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, where = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            for number, m, terms, tops in zip(*(batch.column(c).to_pylist() for c in ("block", "m", "terms", "tops"))):
                b = bounds(q, weight, m, np.frombuffer(terms, np.int32), np.frombuffer(tops, np.int32))
                where[b > top] = number
                top = np.maximum(top, b)
        some = np.flatnonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(top[some]), pa.array(where[some])], names=["q", "bound", "block"])

    seeds = blocks.select("block", "m", "terms", "tops").mapInArrow(first, "q long, bound long, block long")
    seeds = seeds.groupBy("q").agg(F.max_by("block", F.struct("bound", "block")).alias("block")).groupBy("block").agg(F.collect_list("q").alias("asked"))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, best = batch.slice(i, 1).to_pylist()[0], Best(k, np.zeros(n, np.int64))
                visit(q, weight, row, np.array(row["asked"], np.int64), best)
                yield best.batch()

    # one row for each query of the batch at most
    floor = np.zeros(n, np.int64)
    begun = blocks.join(F.broadcast(cut(seeds)), "block").mapInArrow(start, "q long, score long, id long")
    for r in begun.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).collect():
        floor[r.q] = r.least

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k, floor)
        for batch in batches:
            limits = [bounds(q, weight, m, np.frombuffer(t, np.int32), np.frombuffer(x, np.int32)) for m, t, x in zip(*(batch.column(c).to_pylist() for c in ("m", "terms", "tops")))]
            for i in sorted(range(batch.num_rows), key=lambda i: -int(limits[i].max(initial=0))):
                open_for = np.flatnonzero((limits[i] > 0) & (limits[i] >= best.floor))
                if len(open_for):
                    visit(q, weight, batch.slice(i, 1).to_pylist()[0], open_for, best)
        yield best.batch()

    return blocks.mapInArrow(rest, "q long, score long, id long")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", query_key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank (1 to k), doc_id, score: each query's k best documents with a score above 0, equal scores by id."""
    spark = docs.sparkSession
    asked = cut(id_and_text(queries, query_key, text).filter("id IS NOT NULL"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    turns = max(1, math.ceil(size / QUERY_BYTES))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for turn in range(turns):
        q = Queries.of(asked.filter(F.pmod(F.xxhash64("id"), F.lit(turns)) == turn).toArrow())
        if not q.ids:
            continue
        rows = cut(forward(docs, q.vocabulary, key, text))
        n_docs, n_terms = (x or 0 for x in rows.agg(F.count("*"), F.sum("n")).first())
        blocks = cut(index(rows, n_docs, n_terms))
        held = document_counts(rows, len(q.vocabulary))
        weight = np.array([math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * d + 1))) for d in held.tolist()], np.int64)
        names = spark.createDataFrame(list(enumerate(q.ids)), "q long, item_id long")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        best = answered(blocks, q, weight, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        out = out.unionByName(best.join(F.broadcast(names), "q").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
    return out
