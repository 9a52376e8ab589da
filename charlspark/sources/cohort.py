"""Cohorts: encounters with their diagnoses, wide (one pipe-separated string) or long (a row for each code)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlspark.functions.codes import prefix, undotted


def to_wide(raw: DataFrame, order: list[str], sep) -> DataFrame:
    """enc_id, raw codes with columns that order them -> enc_id, diagnosen. sep: a column expression on enc_id."""
    listed = raw.groupBy("enc_id").agg(F.array_sort(F.collect_list(F.struct(*order, "raw"))).alias("x"))
    return listed.select("enc_id", F.array_join(F.transform("x", lambda s: s["raw"]), "\x00").alias("joined")).select("enc_id", F.replace("joined", F.lit("\x00"), sep).alias("diagnosen"))


def to_long(wide: DataFrame) -> DataFrame:
    """enc_id, code: codes of three characters or more, undotted."""
    return codes_of(wide.select("enc_id", F.explode(F.split("diagnosen", r"\|+")).alias("raw")))


def codes_of(raw: DataFrame) -> DataFrame:
    """enc_id, raw -> enc_id, code."""
    return raw.select("enc_id", undotted(F.col("raw")).alias("code")).filter(F.length("code") >= 3)


def prefixes(dx: DataFrame) -> DataFrame:
    """The distinct three-character prefixes of each encounter."""
    return dx.select("enc_id", prefix(F.col("code")).alias("pref")).distinct()
