"""Operator 7's chunks by an independent chunker, and what it removes by brute force over windows, on texts full of repeats."""

import random

import pytest
from pyspark.sql import functions as F

from charlspark.llm import line_dedup


def chunker(lines, hash_of):
    """Chunks (first and last line) of three full lines or more, cut where the hash of a line's hash and the one before falls on one of SPREAD values."""
    full = [i for i, line in enumerate(lines) if line.strip(" \t\r")]
    if len(full) < 2:
        return set()
    starts = [j for j in range(len(full)) if j == 0 or hash_of[lines[full[j - 1]], lines[full[max(j - 2, 0)]]] % line_dedup.SPREAD == 0]
    return {(full[a], full[b - 1]) for a, b in zip(starts, [*starts[1:], len(full)]) if b - a >= 3}


def brute(rows):
    """Later copies of every window of two full lines go, line by line."""
    seen, gone = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        lines = t.split("\n")
        full = [k for k, line in enumerate(lines) if line.strip(" \t\r")]
        for a, b in zip(full, full[1:]):
            w = "\n".join(lines[a : b + 1])
            if w in seen:
                gone.setdefault(i, set()).update(range(a, b + 1))
            seen.add(w)
    return {i: (t if i not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]), len(gone.get(i, ()))) for i, t in rows}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    line = lambda: " ".join("".join(rng.choice("abcde") for _ in range(4)) for _ in range(4))
    passages = [[line() for _ in range(n)] for n in (2, 3, 4, 6, 9, 15, 40)]
    out = []
    for i in range(120):
        body = [line() for _ in range(rng.randint(0, 12))]
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(body))
            cut = p[rng.randint(0, 1) : len(p) - rng.randint(0, 1)]
            body[at:at] = [x if rng.random() > 0.02 else line() for x in cut]
        for _ in range(rng.randint(0, 2)):
            body.insert(rng.randint(0, len(body)), rng.choice(["", "  ", "same line"]))
        out.append((i, "\n".join(body)))
    return out + [(200, "same line\n" * 300), (201, "same line\n" * 300), (202, ""), (203, None), (204, "\n".join(["x"] * 5 + passages[6]))]


def test_chunks_are_those_of_an_independent_chunker(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = {(x, y) for _, t in rows if t for full in [[line for line in t.split("\n") if line.strip(" \t\r")]] for j, x in enumerate(full) for y in {full[max(j - 1, 0)]}}
    hashed = spark.createDataFrame(sorted(pairs), "x string, y string").select("x", "y", F.xxhash64(F.xxhash64("x"), F.xxhash64("y")).alias("h")).collect()
    hash_of = {(r.x, r.y): r.h for r in hashed}
    got = table.select("doc_id", F.explode(line_dedup.pieces(F.col("text"))).alias("c")).select("doc_id", "c.*").collect()
    chunks, windows = {}, {}
    for r in got:
        (chunks if r.own is not None else windows).setdefault(r.doc_id, set()).add((r.a, r.b))
    for i, t in rows:
        lines = (t or "").split("\n")
        full = [k for k, line in enumerate(lines) if line.strip(" \t\r")]
        assert chunks.get(i, set()) == chunker(lines, hash_of) and windows.get(i, set()) == set(zip(full, full[1:]))
    assert sum(map(len, chunks.values())) > 100
    inside = {(r.doc_id, r.of) for r in got if r.of is not None}
    assert inside == {(r.doc_id, r.own) for r in got if r.own is not None}


def test_matches_grow_to_whole_passages(spark, rows):
    want = brute(rows)
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in got} == want


def test_rows_that_repeat_an_id(spark, rows):
    """Each row loses what it has itself; equal rows are one occurrence at equal places."""
    one, two = "\n".join(f"a {k}" for k in range(8)), "\n".join(f"b {k}" for k in range(8))
    table = [(1, one), (2, one), (2, two), (3, two), (4, "\n".join(["new", *two.split("\n")])), (None, one)]
    got = sorted(((r.doc_id or 0), r.text) for r in line_dedup.dedup(spark.createDataFrame(table, "doc_id long, text string")).collect())
    assert got == [(0, one), (1, one), (2, ""), (2, two), (3, ""), (4, "new")]
