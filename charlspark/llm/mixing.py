"""Operator 9: mixing sources to target weights by cube-method balanced sampling.

Each source gets a target of words: weights share all words, and no source may exceed MAX_REPEATS times its words; the
excess is shared anew by weight (water filling, one pass over the sorted table of sources). A source's documents are
taken r = target / words times each: floor(r) times for certain, and once more with inclusion probability r - floor(r).
Which documents get the extra copy is drawn by the cube method: probabilities move through the null space of the
constraints (number of documents, number of words) in a random walk until all but a few are 0 or 1.

The walk runs in blocks of BLOCK documents of a source (dealt by hash, so a source of any size spreads over tasks);
each block leaves at most two open documents, which meet in the next level's blocks, until one block a source is
left, whose at most two open documents are set so that the word total is nearest; where a very long one leaves a rest, the
landing also turns documents of the last block, from long to short, while that brings the total nearer. So that it can, every
source keeps a reserve picked by hash out of the earlier levels, whatever the other sources' sizes: about BLOCK documents, or
as many as hold RESERVE times the words of its longest one. Draws are keyed by block and order by hash, so reruns agree.
Only ids and sizes are shuffled.

Defined results: a null text has size 0 and takes 0 words; null source is a source of its own, last in order; rows with
equal ids are drawn one by one (taken_texts() gives them one decision, the larger); an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from charlspark.llm.common import WORD, cut

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK = 512
#: Words of the reserve, in longest documents of the source.
RESERVE = 4
SEED = 7
#: Equal rows that one task makes.
RUN = 10_000


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, source, size in words."""
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.coalesce(F.regexp_count(f"`{text}`", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """source, docs, source_size, longest, target. The windows run over one row for each source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"), F.max("size").alias("longest"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everywhere = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum(F.col("source_size").cast("double")).over(everywhere) - above) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("place", F.row_number().over(order)).withColumn("level", level)
    fits = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("place", "level"))).over(everywhere)
    target = F.least(F.coalesce(fits["level"], F.lit(math.inf)) * F.col("w"), F.col("cap"))
    return per.select("source", "docs", "source_size", "longest", target.alias("target"))


def flight(pi: list[float], size: list[int], rng: np.random.Generator) -> list[float]:
    """Moves the probabilities along null vectors of (1, size) over three open documents at a time; at most two stay
    open. Each move keeps the sums of pi and of pi * size, and its direction is drawn so that the mean of pi stays."""
    pi, tiny, window = list(pi), 1e-9, []
    for i in range(len(pi)):
        if pi[i] <= tiny or pi[i] >= 1 - tiny:
            pi[i] = round(pi[i])
            continue
        window.append(i)
        while len(window) == 3:
            a, b, c = (size[k] for k in window)
            v = (b - c, c - a, a - b)
            if not any(v):
                v = (1, -1, 0)
            up = min((1 - pi[k]) / x if x > 0 else pi[k] / -x for k, x in zip(window, v) if x)
            down = min(pi[k] / x if x > 0 else (1 - pi[k]) / -x for k, x in zip(window, v) if x)
            move = up if rng.random() * (up + down) < down else -down
            for k, x in zip(window, v):
                pi[k] += move * x
                if pi[k] <= tiny or pi[k] >= 1 - tiny:
                    pi[k] = round(pi[k])
            window = [k for k in window if 0 < pi[k] < 1]
    return pi


def land(pi: list[float], size: list[int], start: list[float]) -> list[float]:
    """Sets the open documents (two at most) so that the words are nearest to what the probabilities at start gave, then
    turns others for what is left. Where these do not suffice, the next nearest setting is tried."""
    open_, others = [i for i, p in enumerate(pi) if 0 < p < 1], sorted((i for i, s in enumerate(start) if 0 < s < 1), key=lambda i: -size[i])
    base = sum((p - s) * n for p, s, n in zip(pi, start, size)) - sum(pi[i] * size[i] for i in open_)
    near, best = sum(size[i] for i in others) / max(1, len(others)) / 2, None
    settings = [(base + sum(size[i] for k, i in enumerate(open_) if n >> k & 1), n) for n in range(1 << len(open_))]
    for off, n in sorted(settings, key=lambda x: (abs(x[0]), x[1])):
        out = list(pi)
        for k, i in enumerate(open_):
            out[i] = float(n >> k & 1)
        for i in others:
            turned = off + size[i] * (1 - 2 * out[i])
            if abs(turned) < abs(off):
                out[i], off = 1 - out[i], turned
        if best is None or abs(off) < best[0]:
            best = abs(off), out
        if best[0] <= near:
            break
    return best[1]


def fly(units: DataFrame, last: bool) -> DataFrame:
    """One level of the walk, a task for each (source, block)."""

    def run(table: pa.Table) -> pa.Table:
        ids, size, pi = (table.column(c).to_pylist() for c in ("doc_id", "size", "pi"))
        tie = table.column("tie").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (tie[i], ids[i] is None, ids[i] or 0, size[i]))
        name = f"{SEED}|{table.column('source')[0].as_py()}|{table.column('block')[0].as_py()}|{len(ids)}"
        moved = flight([pi[i] for i in order], [size[i] for i in order], np.random.default_rng(zlib.crc32(name.encode())))
        if last:
            moved = land(moved, [size[i] for i in order], [pi[i] for i in order])
        return table.take(pa.array(order, pa.int64())).set_column(table.schema.get_field_index("pi"), "pi", pa.array(moved, pa.float64()))

    return units.groupBy("source", "block").applyInArrow(run, units.schema)


def numbered(sized: DataFrame) -> DataFrame:
    """Equal rows, as of an id that many rows repeat, get the numbers 0, 1, ... as copy, so that a hash deals them out. They are
    counted first and made again RUN at a time, so none of it meets in one task."""
    counted = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    many = runs.filter(F.col("n") > RUN).repartition("doc_id", "source", "size", "run")
    copies = F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1)
    out = lambda df: df.select("doc_id", "source", "size", F.explode(copies).alias("copy"))
    return out(runs.filter(F.col("n") <= RUN)).unionByName(out(many))


def mix(sized: DataFrame, weights: tuple = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix takes the document)."""
    sized = cut(sized)
    per = cut(targets(sized, weights, repeats))
    most = per.agg(F.max("docs")).first()[0] or 0
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(repeats)))).otherwise(0.0)
    tie = F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("size"), F.col("copy"))
    units = numbered(sized).join(per.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    units = units.withColumn("sure", F.floor(rate)).withColumn("pi", rate - F.floor(rate)).withColumn("tie", tie)
    blocks = F.ceil(F.col("docs") / BLOCK)
    units = units.withColumn("block", F.pmod(F.col("tie"), blocks).cast("long")).withColumn("blocks", blocks.cast("long"))
    reserve = F.greatest(F.lit(float(BLOCK)), RESERVE * F.col("longest") * F.col("docs") / F.greatest("source_size", F.lit(1)))
    reserved = F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("doc_id"), F.col("size"), F.col("copy")), F.col("docs")) < reserve
    held, units, settled = units.filter(reserved).withColumn("block", F.lit(0).cast("long")), units.filter(~reserved), []
    while most > BLOCK:
        flown = cut(fly(units, False))
        still = (F.col("pi") > 0) & (F.col("pi") < 1)
        settled.append(flown.filter(~still))
        fewer = F.ceil(F.col("blocks") * 2 / BLOCK).cast("long")
        units = flown.filter(still).withColumn("block", F.pmod(F.col("block"), fewer)).withColumn("blocks", fewer)
        most = math.ceil(most / BLOCK) * 2
    settled.append(cut(fly(held.unionByName(units.withColumn("block", F.lit(0).cast("long"))), True)))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("sure") + F.round("pi")).cast("long").alias("copies"))


def taken_texts(docs: DataFrame, key: str = "doc_id", **names: str) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns."""
    n = mix(sizes(docs, key=key, **names)).groupBy("doc_id").agg(F.max("copies").alias("__mix_n")).filter("__mix_n > 0").withColumnRenamed("doc_id", "__mix_id")
    joined = docs.join(n, docs[key].eqNullSafe(n["__mix_id"]))
    return joined.withColumn("__mix_i", F.explode(F.sequence(F.lit(1), F.col("__mix_n").cast("int")))).select(*[docs[c] for c in docs.columns])
