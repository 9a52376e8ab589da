"""Operator 7 [native]: line dedup by content-defined chunks of lines.

Lines that are not blank are hashed, and a rolling hash over ROLL line hashes cuts a text wherever it falls on one of SPREAD values, so
the cuts follow the content and are the same again a few lines after an insertion. A chunk of several lines that occurs again anywhere is a candidate; the
first occurrence (smallest id, then place) stays, and the lines of a later one go after its bytes were compared with those
of the first.

Chunks alone would leave the ends of repeated passages and short ones that hold no whole chunk. So a match grows line by line:
windows of two neighbouring lines (with the blank ones between) are looked up in the same way, over the borders of chunks
and in chunks that do not repeat; those within a repeated chunk go with it and are not compared again. Overlapping matches join up: of a passage of two
lines or more that occurred before, every line goes. A single line that is repeated between different neighbours stays.

Only hashes are shuffled to find repeats (a grouped minimum, which combines before the shuffle); the texts of repeated
pieces alone are dealt by hash for the comparison. Different pieces of one hash are told apart by their bytes. A piece that many documents share is a hot key of joins whose other
side has one row for each key, which adaptive execution splits.

Defined results: null and empty texts have no lines and stay as they are; rows without id take no part and stay whole; rows
that repeat an id count as one document at equal places, and each loses only windows that it has itself; extra columns pass through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charlspark.llm.common import table

BLANK = " \t\r"
#: Line hashes of a rolling hash, and one of how many values of it cuts.
ROLL, SPREAD = 2, 4
PIECES = "array<struct<a:int,b:int,h:bigint,own:bigint,of:bigint>>"
#: Names of working columns, which no table is likely to have.
GONE_ID, GONE, DONE = "__line_dedup_id", "__line_dedup_removed", "__line_dedup_done"


def bound(value: Column, use) -> Column:
    """use(value), with value computed once wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def part(lines: Column, a: Column, b: Column) -> Column:
    """Lines a to b as a text."""
    return F.array_join(F.slice(lines, a + 1, b - a + 1), "\n")


def pieces(text: Column) -> Column:
    """struct(a, b, h, own, of) of each chunk of three lines or more and each window of two: its first and last line, its hash, a
    chunk's name (of its place and hash; null for a window) and the name of the chunk that a window lies in (null for none)."""

    def from_lines(lines: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(lines) - 1)
        return bound(F.filter(numbers, lambda i: F.btrim(F.get(lines, i), F.lit(BLANK)) != ""), lambda full: F.when(F.size(full) > 1, from_full(lines, full)))

    def from_full(lines: Column, full: Column) -> Column:
        n = F.size(full)
        hashes = F.transform(full, lambda i: F.xxhash64(F.get(lines, i)))
        starts = lambda x: F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | (F.pmod(rolled(x, j - 1), F.lit(SPREAD)) == 0))
        chunks = lambda at: F.transform(at, lambda a, k: F.struct(a.alias("a"), (F.coalesce(F.get(at, k + 1), n) - 1).alias("b")))
        each = lambda c: bound(named(lines, full, c), lambda name: of_chunk(lines, full, n, c, name))
        return F.flatten(F.transform(bound(bound(hashes, starts), chunks), each))

    def rolled(x: Column, j: Column) -> Column:
        """Of the ROLL line hashes up to j (the first ones of a text have fewer)."""
        return F.xxhash64(*[F.coalesce(F.get(x, F.greatest(j - k, F.lit(0))), F.lit(0)) for k in range(ROLL)])

    def named(lines: Column, full: Column, c: Column) -> Column:
        a, b = F.get(full, c["a"]), F.get(full, c["b"])
        return F.when(c["b"] - c["a"] >= 2, bound(F.xxhash64(part(lines, a, b)), lambda h: F.struct(a.alias("a"), b.alias("b"), h.alias("h"), F.xxhash64(a, h).alias("own"), none.alias("of"))))

    def of_chunk(lines: Column, full: Column, n: Column, c: Column, name: Column) -> Column:
        def window(j: Column) -> Column:
            a, b = F.get(full, j), F.get(full, j + 1)
            return F.struct(a.alias("a"), b.alias("b"), F.xxhash64(part(lines, a, b)).alias("h"), none.alias("own"), F.when(j < c["b"], name["own"]).alias("of"))

        last = F.least(c["b"], n - 2)
        own = F.when(last >= c["a"], F.transform(F.sequence(c["a"], F.greatest(last, c["a"])), window)).otherwise(F.array().cast(PIECES))
        return F.concat(F.when(name.isNotNull(), F.array(name)).otherwise(F.array().cast(PIECES)), own)

    none = F.lit(None).cast("long")
    return bound(lines_of(text), from_lines)


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, removed: struct(a, b, h) of each chunk or window to remove."""
    whole = docs
    docs = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    slim = docs.select("id", F.explode(pieces(F.col("text"))).alias("c")).select("id", "c.*")
    first = slim.groupBy("h").agg(F.min(F.struct("id", "a")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    wanted = slim.join(first, "h").groupBy("id").agg(F.collect_set(F.struct("a", "b", "h", (F.struct("id", "a") == F.col("first")).alias("is_first"), "own", "of")).alias("wanted"))
    # windows within a chunk that goes anyway need no comparison of their own
    gone = F.transform(F.filter("wanted", lambda c: c["own"].isNotNull() & ~c["is_first"]), lambda c: c["own"])
    rest = lambda own: F.filter("wanted", lambda c: c["is_first"] | c["of"].isNull() | ~F.array_contains(own, c["of"]))
    wanted = wanted.select("id", bound(gone, rest).alias("wanted"))
    pick = lambda lines: F.transform("wanted", lambda c: F.struct(c["a"].alias("a"), c["b"].alias("b"), c["h"].alias("h"), c["is_first"].alias("is_first"), part(lines, c["a"], c["b"]).alias("t")))
    # dealt by id in the very way in which dedup deals the table, so that Spark makes one exchange of the texts serve both if they are all it has
    dealt = whole.join(wanted.withColumnRenamed("id", GONE_ID).hint("shuffle_hash"), whole[key].eqNullSafe(F.col(GONE_ID)))
    texts = dealt.select(F.col(GONE_ID).alias("id"), F.explode(bound(lines_of(whole[text]), pick)).alias("c")).select("id", "c.*")
    texts = texts.filter(F.xxhash64("t") == F.col("h"))  # of rows that repeat an id, only those that have the window there
    later, kept = texts.filter("NOT is_first"), texts.filter("is_first").select("h", F.col("t").alias("first_t")).dropDuplicates(["h"])
    met = later.join(kept, "h").select("id", "a", "b", "h", "t", (F.col("t") == F.col("first_t")).alias("same"))
    # windows that share a hash with a different first one have a first one of their own
    other = met.filter("NOT same")
    own = other.groupBy("h", "t").agg(F.min(F.struct("id", "a")).alias("own"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = other.join(own, ["h", "t"]).filter(F.struct("id", "a") != F.col("own"))
    same = met.filter("same").select("id", "a", "b", "h").unionByName(again.select("id", "a", "b", "h"))
    return same.groupBy("id").agg(F.collect_set(F.struct("a", "b", "h")).alias("removed"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with their texts less the repeated lines, and n_lines, n_removed (lines)."""
    gone = repeats(docs, key, text).select(F.col("id").alias(GONE_ID), F.col("removed").alias(GONE))
    joined = docs.drop("n_lines", "n_removed").join(gone.hint("shuffle_hash"), docs[key].eqNullSafe(F.col(GONE_ID)), "left")
    body, removed = F.col(f"`{text}`"), F.col(GONE)

    def without(lines: Column) -> Column:
        own = F.filter(removed, lambda w: F.xxhash64(part(lines, w["a"], w["b"])) == w["h"])  # rows that repeat an id may differ
        numbers = F.sequence(F.lit(0), F.size(lines) - 1)
        return bound(F.array_except(numbers, F.flatten(F.transform(own, lambda w: F.sequence(w["a"], w["b"])))), lambda left: F.struct(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n").alias("text"), (F.size(lines) - F.size(left)).alias("n")))

    done = bound(lines_of(body), without)
    df = joined.withColumn(DONE, F.when(removed.isNotNull(), done))
    clean = F.when(removed.isNull(), body).otherwise(F.col(DONE)["text"])
    lines = F.when(body != "", line_count(body)).otherwise(0)
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return df.select(*[clean.alias(c) if c == text else F.col(f"`{c}`") for c in own], lines.cast("long").alias("n_lines"), F.coalesce(F.col(DONE)["n"], F.lit(0)).cast("long").alias("n_removed"))


def op7(spark, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
