"""Reference frequencies of full codes: code, code_nodot, code3, freq_total and, optionally, a column for each age band."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from charlspark.functions.codes import AGE_LABELS, german_number, undotted
from charlspark.sources.staging import staged


def from_raw(raw: DataFrame) -> DataFrame:
    """Text rows (code, sex_raw, total and bands) as published, one for each sex, to one row for each full code."""
    bands = [c for c in raw.columns if c in AGE_LABELS]
    code = F.upper(F.trim("code"))
    sums = [F.coalesce(F.sum(german_number(F.col(f"`{c}`"))), F.lit(0.0)).alias("freq_total" if c == "total" else c) for c in ["total", *bands]]
    full = raw.withColumn("code", code).filter(F.col("code").rlike(r"^[A-Z][0-9]{2}\."))
    out = full.groupBy("code").agg(*sums).withColumn("code_nodot", undotted(F.col("code")))
    return out.select("code", "code_nodot", F.substring("code_nodot", 1, 3).alias("code3"), "freq_total", *[f"`{b}`" for b in bands])


#: Columns of the published text, in order: code, sex, total, bands.
TEXT = ["code", "sex_raw", "total", *AGE_LABELS]
REJECTED = "rejected"


def from_text(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ";") -> tuple[DataFrame, DataFrame]:
    """The published rows from text files at any path that Spark reads: the parsed table, and the rows that are none (rejected,
    the text of each).

    The schema is declared (columns: those of the files, all of TEXT if not said), so no pass infers it. A row with too few or too many fields, or with
    a quote that does not end, is rejected and not guessed at; so is one without a code. A field that is no number counts as none, as in from_raw."""
    names = columns or TEXT
    schema = StructType([StructField(c, StringType()) for c in [*names, REJECTED]])
    rows = spark.read.schema(schema).csv(path, sep=sep, header=False, mode="PERMISSIVE", columnNameOfCorruptRecord=REJECTED, multiLine=False)
    whole = F.when(F.col(REJECTED).isNotNull(), F.col(REJECTED)).when(F.trim(F.coalesce("code", F.lit(""))) == "", F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in names]))
    rows = staged(rows.withColumn("__bad", whole))  # what is read from text for its rejected rows alone would not be parsed
    return from_raw(rows.filter("__bad IS NULL").select(*[f"`{c}`" for c in names])), rows.filter("__bad IS NOT NULL").select(F.col("__bad").alias(REJECTED))


def custom(table: DataFrame) -> DataFrame:
    """A user's table: required columns are checked, keys normalised, rows of one code added up."""
    lacking = [c for c in ("code", "code_nodot", "code3", "freq_total") if c not in table.columns]
    if lacking:
        raise ValueError(f"frequency table lacks {', '.join(lacking)}")
    bands = [c for c in table.columns if c in AGE_LABELS]
    keyed = table.withColumn("code_nodot", undotted(F.col("code_nodot")))
    sums = [F.sum(F.col(f"`{c}`").cast("double")).alias(c) for c in ["freq_total", *bands]]
    out = keyed.groupBy("code_nodot").agg(F.min("code").alias("code"), *sums)
    return out.select("code", "code_nodot", F.substring("code_nodot", 1, 3).alias("code3"), "freq_total", *[f"`{b}`" for b in bands])


def by_age(freq: DataFrame) -> DataFrame:
    """code3, code_nodot, age_bin, freq from the band columns."""
    bands = [c for c in freq.columns if c in AGE_LABELS]
    return freq.select("code3", "code_nodot", *[f"`{b}`" for b in bands]).unpivot(["code3", "code_nodot"], [F.col(f"`{b}`") for b in bands], "age_bin", "freq")
