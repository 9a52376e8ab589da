"""Operator 6 against an independent way to cut texts into pieces, and operator 4 on a table with columns of working names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from charlspark.llm import iblt, topk
from charlspark.llm.common import ship


def pieces(text):
    """Line by line: up to a sentence end before white space, at most PIECE code points; the rest of a line ends with it."""
    out = set()
    for line in text.split("\n"):
        at = 0
        while at < len(line):
            end = min(at + iblt.PIECE, len(line))
            for k in range(at + 1, end + 1):
                if line[k - 1] in ".!?" and line[k : k + 1] in (" ", "\t") and k < len(line):
                    end = k
                    break
            out.add(line[at:end].strip(" "))
            at = end
    return out


def test_likeness_of_texts_with_sentences(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé\U0001f600") for _ in range(rng.randint(1, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + rng.choice([".", "!", "?", "...", ".x", ""])
    pool = [sentence(rng.randint(1, 12)) for _ in range(40)]
    texts = {}
    for i in range(14):
        parts = rng.sample(pool, rng.randint(1, 30)) + [sentence(rng.choice([3, 60, 200]))]
        rng.shuffle(parts)
        texts[i] = "".join(p + rng.choice([" ", "\t", "\n", "  ", "\n\n"]) for p in parts)
    texts |= {20: "." * 500, 21: "a. " * 300, 22: " . . . ", 23: "x" * 199 + ". " + "x" * 200 + ". y", 24: "One.\tTwo! Three?\nFour"}
    got = {r.doc_id: r for r in iblt.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    ids = sorted(texts, reverse=True)
    for i, j in zip(ids, ids[1:] + ids[:1]):
        third = len(texts[i]) // 3
        edited = texts[i][: len(texts[i]) - third] + texts[j][:third]
        for other, near in ((edited, got[i].near_edited), (texts[j], got[i].near_next)):
            a, b = pieces(texts[i]), pieces(other)
            assert near == pytest.approx(len(a & b) / len(a | b)), i


def test_top_k_with_columns_of_working_names(spark):
    ship(spark)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    plain = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    odd = plain.withColumns({c: F.lit("x") for c in ("id", "q", "score", "rank", "query_id", "block", "v")})
    run = lambda t: sorted(map(tuple, topk.top_k(topk.integers(t), topk.integers(t).filter(F.col("id") % 20 == 0)).select("query_id", "rank", "vec_id", "score").collect()))
    assert run(odd) == run(plain) and len(run(odd)) == 3 * 20
