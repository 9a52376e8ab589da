"""Charlson maps: groups with weights, code patterns and the groups that suppress them.

A map is a table with a row for each group: gk, name, weight, codes (array of condition and codes), depends_on. It comes from
JSON in the usual schema, or is built in: 'published' (Quan and others, 2005) or 'reduced' (a smaller one for tests)."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "map<string, struct<name:string, weight:double, codes:array<struct<condition:string, codes:array<string>>>, depends_on:array<string>>>"
ROOT = "cci_icd_quan_orig"
BLOCK = pa.struct([("condition", pa.string()), ("codes", pa.list_(pa.string()))])
ROWS = pa.schema([("gk", pa.string()), ("name", pa.string()), ("weight", pa.float64()), ("codes", pa.list_(BLOCK)), ("depends_on", pa.list_(pa.string()))])

#: Fixed values, as JSON: charlson_published.json and charlson_reduced.json.
DATA = Path(__file__).parent / "data"


def built_in_text(which: str = "published") -> str:
    return (DATA / f"charlson_{which}.json").read_text(encoding="utf-8")


def parsed(texts: DataFrame, root: str = ROOT) -> DataFrame:
    """texts: value, a whole JSON text."""
    return texts.select(F.explode(F.from_json("value", f"`{root}` {SCHEMA}")[root]).alias("gk", "g")).select("gk", "g.*")


def built_in(spark: SparkSession, which: str = "published") -> DataFrame:
    """A map that comes with the package, as parsed rows: the driver reads it, as executors need not have the file."""
    groups = json.loads(built_in_text(which))[ROOT]
    rows = [{"gk": gk, "name": g.get("name"), "weight": float(g["weight"]), "codes": g["codes"], "depends_on": g.get("depends_on")} for gk, g in groups.items()]
    return spark.createDataFrame(pa.Table.from_pylist(rows, ROWS))


def from_json(spark: SparkSession, path: str, root: str = ROOT) -> DataFrame:
    """The map under the key root of a JSON file, at any path that Spark reads."""
    return parsed(spark.read.text(path, wholetext=True), root)


def patterns(groups: DataFrame) -> DataFrame:
    """pat (undotted), gk, w: only blocks of condition 'any' count."""
    block = groups.select("gk", "weight", F.explode("codes").alias("block")).filter("block.condition = 'any'")
    pat = block.select(F.explode("block.codes").alias("pat"), "gk", F.col("weight").alias("w"))
    return pat.select(F.regexp_replace(F.upper("pat"), "[^A-Z0-9]", "").alias("pat"), "gk", "w").distinct()


def dependencies(groups: DataFrame) -> DataFrame:
    """child, parent: a group whose parent is triggered too does not count."""
    return groups.select(F.col("gk").alias("child"), F.explode("depends_on").alias("parent"))


def lengths(groups: DataFrame) -> tuple[int, ...]:
    """The lengths of a map's patterns; one row for each group comes to the driver."""
    blocks = F.filter("codes", lambda b: b["condition"] == "any")
    own = F.transform(F.flatten(F.transform(blocks, lambda b: b["codes"])), lambda c: F.length(F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")))
    return tuple(sorted({n for r in groups.select(F.array_distinct(own).alias("n")).collect() for n in r.n or [] if n}))


def weights(groups: DataFrame) -> DataFrame:
    """gk, w of the groups that have patterns."""
    return patterns(groups).select("gk", "w").distinct()
