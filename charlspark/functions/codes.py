"""Column expressions on diagnosis codes, ages and German numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bounds of the age bands after the first, and the labels of all bands.
AGE_FROM = [1, 5, 10, 15, 18, 20, *range(25, 96, 5)]
AGE_LABELS = ["unter 1", "1 - 5", "5 - 10", "10 - 15", "15-18", "18-20", *[f"{a} - {a + 5}" for a in range(20, 95, 5)], "95 u. älter"]
# What stands for a missing number in the published table.
NO_NUMBER = ["-", ".", "/", "NA"]


def normalized(code: Column) -> Column:
    """Upper case, comma to dot, nothing but letters, digits and single inner dots."""
    c = F.regexp_replace(F.upper(F.trim(code)), ",", ".")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Z0-9.]", ""), r"\.+", "."), r"\.$", "")


def undotted(code: Column) -> Column:
    """The form in which codes are matched."""
    return F.regexp_replace(F.upper(code), "[^A-Z0-9]+", "")


def redotted(code: Column) -> Column:
    """A dot into plain four-character codes."""
    return F.regexp_replace(F.upper(F.trim(code)), "^([A-Z][0-9]{2})([0-9])$", "$1.$2")


def prefix(code: Column) -> Column:
    """The three characters to which anonymised data are cut."""
    return F.substring(code, 1, 3)


def age_band(age: Column) -> Column:
    """The band's label; null for null and NaN."""
    out = F.when(age.isNull() | F.isnan(age), None).when(age < AGE_FROM[0], AGE_LABELS[0])
    for below, label in zip(AGE_FROM[1:], AGE_LABELS[1:]):
        out = out.when(age < below, label)
    return out.otherwise(AGE_LABELS[-1])


def german_number(text: Column) -> Column:
    """A number with dots between thousands and a decimal comma; null where there is none."""
    t = F.trim(text)
    return F.when(~t.isin(NO_NUMBER), F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".").try_cast("double"))
