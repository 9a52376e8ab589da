"""Operator 13: importance resampling towards a target distribution.

A document's features are its runs of 1 to n words. Features fall into buckets by their checksum; a bucket's gain is the
logarithm of its smoothed share among the target's features over its share among the documents'. A document's weight is the
sum of its features' gains, and the documents with the highest weight plus Gumbel noise (keyed by the id, so reruns agree)
are drawn, which samples without replacement in proportion to exp(weight).

Two passes over the texts, neither of which moves them: the first counts buckets, the second adds gains. Both cut texts into words by Arrow
kernels (ascii_lower, split_pattern_regex, list_flatten, dictionary_encode); longer features are pairs of shifted dictionary indices;
only distinct pairs are spelled out and hashed, and gains come back by take and sums of segments. What goes to the tasks is
one gain for each bucket. The draw sorts slim rows by range, so that no task holds more than a range of scores.

Defined results: a null or wordless text has no features and weight 0; a null id has a null score and is not drawn, nor counted
among those to draw from, but its words count in the corpus; rows that repeat an id are rows of their own (ties: smaller id, then
fewer features); extra columns are ignored; an empty table gives an empty table, an empty target gains from smoothing alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charlspark.llm.common import cut, parts_for
from charlspark.llm.terms import id_and_text, text_slices, words

BUCKETS = 10_000
#: MB of input files for each range of scores.
RANGE_MB = 256


def features(texts: pa.Array, n: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 1 to n: how many features each text has, and the buckets of all of them in turn."""
    counts, code, single = words(texts)
    owner = np.repeat(np.arange(len(counts)), counts)
    ids, spelled, size = code, single, max(len(single), 1)
    for k in range(1, n + 1):
        if k > 1:
            whole = owner[: max(len(owner) - k + 1, 0)] == owner[k - 1 :]
            pairs = pa.array((ids[: len(whole)] * size + code[k - 1 :])[whole]).dictionary_encode()
            head, tail = np.divmod(pairs.dictionary.to_numpy(), size)
            spelled = pc.binary_join_element_wise(spelled.take(pa.array(head)), single.take(pa.array(tail)), " ")
            place = np.flatnonzero(whole)
            ids = np.zeros(len(whole), np.int64)
            ids[place] = pairs.indices.to_numpy()
            used, who = ids[place], owner[place]
        else:
            used, who = ids, owner
        crc = np.fromiter((zlib.crc32(w) % buckets for w in spelled.cast(pa.binary()).to_pylist()), np.int64, len(spelled))
        yield np.bincount(who, minlength=len(counts)), crc[used]


def bucket_counts(docs: DataFrame, n: int, buckets: int, text: str = "text") -> np.ndarray:
    """How many features fall into each bucket, over all rows; tasks send one row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in text_slices(batches):
            for _, bucket in features(batch.column("text"), n, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    texts = id_and_text(docs.withColumn("__importance_id", F.lit(None)), "__importance_id", text)
    rows = texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, in thousandths, rounded down."""
    k, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = ((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)) for s, t in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(seed: int) -> Column:
    """Gumbel noise of the id, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weighted(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, seed: int = 2024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight, score of every row of docs."""
    gain = gains(bucket_counts(docs, n, buckets, text), bucket_counts(target, n, buckets, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            n_features, n_words, weight = np.zeros((3, batch.num_rows), np.int64)
            for k, (counts, bucket) in enumerate(features(batch.column("text"), n, buckets)):
                sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                ends = np.cumsum(counts)
                weight += sums[ends] - sums[ends - counts]
                n_features += counts
                n_words += counts if k == 0 else 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, (n_features, n_words, weight))], names=["doc_id", "n_features", "n_words", "weight"])

    out = id_and_text(docs, key, text).mapInArrow(run, "doc_id long, n_features long, n_words long, weight long")
    return out.withColumn("score", F.col("weight") + noise(seed))


def drawn(scored: DataFrame, percent: int = 10, least_words: int = 20, parts: int = 12) -> DataFrame:
    """scored with rank: 1, 2, 3... for the floor(percent of N) highest scores of the N rows with least_words or more, else null."""
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")]
    scored = cut(scored)
    able = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    ranges = cut(scored.filter(able).repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    counts = sorted(ranges.groupBy("range").count().collect())  # one row for each range
    quota, before, starts = sum(c for _, c in counts) * percent // 100, 0, []
    for r, c in counts:
        if before < quota:
            starts.append((r, before))
        before += c
    first = F.broadcast(scored.sparkSession.createDataFrame(starts, "range int, before long"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    head = ranges.join(first, "range").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank"))).select(*scored.columns, "rank")
    none = F.lit(None).cast("long").alias("rank")
    tail = ranges.filter(F.col("range") > (starts[-1][0] if starts else -1)).select(*scored.columns, none)
    return head.unionByName(tail).unionByName(scored.filter(~F.coalesce(able, F.lit(False))).select("*", none))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_features, n_words, weight, score, rank of every document."""
    return drawn(weighted(docs, target, n, buckets, seed, key, text), percent, least_words, parts_for(docs, RANGE_MB))


def drawn_documents(docs: DataFrame, ranked: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is drawn."""
    ids = ranked.filter("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn_id")).distinct()
    return docs.join(ids, docs[key] == F.col("__drawn_id"), "left_semi")
