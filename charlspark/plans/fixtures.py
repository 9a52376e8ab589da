"""A cohort, a map and reference frequencies from the driver's tables, which hold no medical data.

Line items become diagnoses (orders are encounters), with spellings that need cleaning; the frequencies are counts of the
cohort's own full codes, by sex and age band, printed as in the published table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from charlspark.functions.codes import AGE_LABELS, age_band
from charlspark.sources import charlson, cohort, frequency

# The codes of the frequency fixture, in order, then eight that it lacks (the last two are too short).
CODES = """
E10.4 E10.9 E11.4 E11.9 E12.4 E12.9 E13.4 E13.9 E14.4 E14.9 I12.0 I12.9 I13.1 I13.9 N18.1 N18.4 N18.9 N19.0
Z49.0 Z49.1 B18.0 B18.9 K70.3 K70.9 K70.4 K70.0 K71.5 K71.1 K74.6 K74.0 K76.5 K76.7 C16.0 C16.9 C18.4 C18.9
C50.1 C50.9 C71.0 C71.9 C77.0 C77.9 C78.0 C78.9 C79.5 C79.9 C80.0 C80.9 I21.0 I21.4 I22.0 I22.9 I25.2 I25.9
I50.0 I50.9 I43.0 I42.9 P29.0 P29.8 I63.3 I63.9 I60.0 I69.4 G81.0 G81.9 G82.5 G83.4 J44.0 J44.9 J45.0 J45.9
J47.0 J47.9 M05.0 M05.9 M06.0 M06.9 M32.1 M32.9 F00.1 F00.9 F03.0 G30.0 G30.9 K25.0 K25.9 K26.0 K27.9 K28.0
K28.9 I70.0 I70.9 I71.3 I71.9 I73.1 I73.9 B20.0 B20.9 B21.0 B22.0 B24 Z01.0 Z01.9 I10.0 I10.9 E78.0 E78.5
""".split()
BEYOND = ["C34.1", "D63.0", "E46", "G45.9", "Z96.1", "F05.1", "AB", ""]

#: The band that the wide frequency table lacks, so that its ages fall back to all ages.
MISSING_BAND = AGE_LABELS[-1]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_column() -> Column:
    listed = F.array(*[F.lit(c) for c in CODES + BEYOND])
    return F.get(listed, (F.col("l_partkey") % (len(CODES) + len(BEYOND))).cast("int"))


def dx_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """enc_id, ord, l_partkey, l_suppkey, raw: one row for each line item."""
    code, kind = code_column(), F.col("l_suppkey") % 7
    raw = (
        F.when(kind == 0, F.lower(code))
        .when(kind == 1, F.replace(code, F.lit("."), F.lit(",")))
        .when(kind == 2, F.concat(F.lit(" "), code, F.lit(" ")))
        .when(kind == 3, F.replace(code, F.lit("."), F.lit("")))
        .when(kind == 4, F.concat(code, F.lit("0")))
        .otherwise(code)
    )
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("enc_id"), F.col("l_linenumber").alias("ord"), "l_partkey", "l_suppkey", raw.alias("raw"))


def encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """enc_id, age."""
    age = F.when(F.col("o_custkey") % 17 != 0, (F.col("o_custkey") % 101).cast("double"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("enc_id"), age.alias("age"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """enc_id, diagnosen (null without line items), age."""
    sep = F.when(F.col("enc_id") % 5 == 0, "||").otherwise("|")
    listed = cohort.to_wide(dx_raw(spark, sf_dir), ["ord", "l_partkey", "l_suppkey"], sep)
    return encounters(spark, sf_dir).join(listed, "enc_id", "left").select("enc_id", "diagnosen", "age")


def dx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """enc_id, code: the cohort in long form."""
    return cohort.codes_of(dx_raw(spark, sf_dir))


def charlson_map(spark: SparkSession) -> DataFrame:
    return charlson.built_in(spark, "reduced")


def german(n: Column) -> Column:
    """A whole number with dots between thousands; '-' for none."""
    return F.when(n == 0, "-").otherwise(F.replace(F.format_number(n, 0), F.lit(","), F.lit(".")))


def freq_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, sex_raw, total and bands, all text: counts of the cohort's listed codes, in thirteens."""
    raw = dx_raw(spark, sf_dir).filter(F.col("l_partkey") % (len(CODES) + len(BEYOND)) < len(CODES)).select("enc_id", code_column().alias("code"), F.when(F.col("l_suppkey") % 2 == 0, "m").otherwise("w").alias("sex_raw"))
    rows = raw.join(encounters(spark, sf_dir).select("enc_id", age_band(F.col("age")).alias("band")), "enc_id")
    long = rows.groupBy("code", "sex_raw", "band").agg((F.count("*") * 13).alias("n")).coalesce(1)  # a few thousand rows at most; the bands are laid out afterwards
    counts = [german(F.coalesce(F.sum(F.when(F.col("band") == b, F.col("n"))), F.lit(0))).alias(b) for b in AGE_LABELS if b != MISSING_BAND]
    return long.groupBy("code", "sex_raw").agg(german(F.sum("n")).alias("total"), *counts)


def freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed frequency table with its bands."""
    return frequency.custom(frequency.from_raw(freq_raw(spark, sf_dir)))
