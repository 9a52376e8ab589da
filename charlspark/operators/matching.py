"""Codes to groups: either of code and pattern is a prefix of the other.

Two forms. For distinct codes and any number of patterns: in sorted order whatever starts with a string follows it without a gap, so one
merge pass over both finds all pairs. For the rows of a cohort and a map: the map's patterns become two small
tables of masks, by whole pattern and by what a pattern starts with, and a code looks itself and its starts up there, so that
the rows are read once and neither deduplicated nor exchanged."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from charlspark.operators.scoring import Groups, either


def starts(c: Column) -> Column:
    """All prefixes of a code."""
    return F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, F.lit(1), i))


def pattern_hits(codes: DataFrame, patterns: DataFrame) -> DataFrame:
    """code, pat and the other columns of patterns, for each pair where either is a prefix of the other. codes are distinct;
    empty codes and patterns match nothing.

    Strings with the same first character come to one task in order (a pattern before an equal code); those that the
    current one starts with are kept on a stack."""
    schema = StructType([StructField("code", StringType()), *patterns.schema.fields])
    whole = patterns.select(F.col("pat").alias("s"), F.struct(*patterns.columns).alias("p"))
    both = whole.unionByName(codes.select(F.col("code").alias("s"), F.lit(None).cast(whole.schema["p"].dataType).alias("p")))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple] = []
        for batch in batches:
            found = []
            for s, p in zip(batch.column("s").to_pylist(), batch.column("p").to_pylist()):
                while stack and not s.startswith(stack[-1][0]):
                    stack.pop()
                found += [{"code": s, **q} if p is None else {"code": t, **p} for t, q in stack if (p is None) != (q is None)]
                stack.append((s, p))
            yield pa.RecordBatch.from_pylist(found, out)

    out = to_arrow_schema(schema)
    ordered = both.filter("s <> ''").repartition(F.substring("s", 1, 1)).sortWithinPartitions("s", F.col("p").isNull())
    return ordered.mapInArrow(sweep, schema)


def code_groups(codes: DataFrame, patterns: DataFrame) -> DataFrame:
    """code, gk for distinct codes."""
    return pattern_hits(codes.select("code").distinct(), patterns).select("code", "gk").distinct()


def encounters_with(dx: DataFrame, listed: DataFrame) -> DataFrame:
    """enc_id of the encounters with any code that matches a pattern of listed (pat)."""
    hits = pattern_hits(dx.select("code").distinct(), listed).select("code").distinct()
    return dx.join(hits, "code", "left_semi").select("enc_id").distinct()


def with_masks(rows: DataFrame, patterns: DataFrame, groups: Groups, code: str, lengths: tuple[int, ...]) -> DataFrame:
    """rows with the mask columns of the groups that the code belongs to (0 for none). lengths: those that patterns have. The joins are left joins from the rows, so only the map's tables can be broadcast, and are if Spark knows
    them to be small."""
    bits = dict(zip(groups.columns(), groups.bits(F.col("gk"))))
    own = patterns.select("pat", *[c.alias(n) for n, c in bits.items()])
    whole = own.groupBy("pat").agg(*groups.ored())
    below = own.select(F.explode(starts(F.col("pat"))).alias("pat"), *bits).groupBy("pat").agg(*groups.ored())
    out, terms = rows, []
    # a code as long as the longest pattern starts no other one: null, which no join looks up
    head = F.when(F.length(code) < max(lengths, default=0), F.col(code))
    for k in (0, *lengths):
        key, names = f"__start{k}", [f"__{n}_{k}" for n in bits]
        table = (whole if k else below).select(F.col("pat").alias(key), *[F.col(n).alias(m) for n, m in zip(bits, names)])
        out = out.join(table, (F.substring(F.col(code), 1, k) if k else head) == F.col(key), "left")
        terms.append(names)
    masks = [either([F.coalesce(c, F.lit(0).cast("long")) for c in map(F.col, word)]).alias(n) for n, word in zip(bits, zip(*terms))]
    return out.select(*rows.columns, *masks)


def head_masks(patterns: DataFrame, groups: Groups, lengths: tuple[int, ...]) -> DataFrame:
    """pref and its masks for the first three characters of every pattern that has as many. Any other prefix of three characters can match none but shorter patterns."""
    heads = patterns.select(F.substring("pat", 1, 3).alias("pref")).filter(F.length("pref") == 3).distinct()
    return with_masks(heads, patterns, groups, "pref", lengths)


def groups_of(rows: DataFrame, patterns: DataFrame, groups: Groups, code: str, lengths: tuple[int, ...]) -> DataFrame:
    """code, gk for rows of distinct codes, by lookup; rows stay where they are."""
    masked = with_masks(rows.select(code), patterns, groups, code, lengths)
    return masked.select(code, F.explode(groups.listed(groups.mask())).alias("gk"))
