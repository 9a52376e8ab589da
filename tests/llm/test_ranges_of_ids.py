"""Operator 6 where ids lie close together far from zero, repeat, or rows are equal: it ends and each row finds its next one."""

import hashlib

import pytest
from pyspark.sql import functions as F

from charlspark.llm import iblt


def next_of(rows):
    """id, text, next text in the order of (id, hash of the text) descending, by sorting; hashes by the table."""
    order = sorted(rows, key=lambda r: (r[0], r[2]), reverse=True)
    return sorted((i, t, order[(k + 1) % len(order)][1]) for k, (i, t, _) in enumerate(order))


@pytest.mark.parametrize("kind", ["far", "one id", "equal", "ends"])
def test_next_document(spark, kind, monkeypatch):
    monkeypatch.setattr(iblt, "RANGE", 8)
    top = 1 << 60
    rows = {
        "far": [(top + k % 2, f"t{k}") for k in range(400)],
        "one id": [(7, f"t{k}") for k in range(300)] + [(9, "x"), (5, "y"), (top, "z")],
        "equal": [(7, "same")] * 300 + [(7, f"t{k}") for k in range(100)] + [(8, "same")] * 200 + [(3, "z")],
        "ends": [(-(1 << 63), "a"), ((1 << 63) - 1, "b")] + [(k, f"t{k}") for k in range(300)],
    }[kind]
    table = spark.createDataFrame(rows, "id long, text string").repartition(3)
    hashed = [tuple(r) for r in table.select("id", "text", F.xxhash64("text")).collect()]
    got = sorted((r.id, r.text, r.next) for r in iblt.with_next(table).select("id", "text", "next").collect())
    assert got == next_of(hashed)


def test_many_equal_rows_to_the_end(spark):
    out = iblt.fingerprints(spark.createDataFrame([(4, "One two. Three four.\nFive")] * 10_000, "doc_id long, text string").repartition(4))
    rows = out.groupBy("doc_id", "n_chars", "fingerprint", "near_next").count().collect()
    assert [(r.doc_id, r.n_chars, r.near_next, r["count"]) for r in rows] == [(4, 25, 1.0, 10_000)]
    assert {r.edited_sha256 for r in out.limit(3).collect()} == {hashlib.sha256(b"One two. Three fo" + b"One two. T"[:8]).hexdigest()}
