"""Operator 5 on pairs that only just link and are connected by nothing else: no link may be lost."""

import numpy as np
import pytest

from charlspark.llm import jaccard_join
from charlspark.llm.common import ship


def made(width, percent, pairs, seed):
    """Rows, and the id of each row's component. Pairs share a passage, and other documents hold the words that tell them apart."""
    rng = np.random.default_rng(seed)
    word = lambda n: ["w%x" % x for x in rng.integers(0, 1 << 40, n)]
    passage, rows, component = word(30), [], {}
    for p in range(pairs):
        n = [104, 104, 60, 250][p % 4]
        changes = max(k for k in range(n) if 100 * (n - width * k) >= percent * (n + width * k))
        a = passage + word(n + width - 1 - 30)
        b = list(a)
        places = np.linspace(30 + width, len(a) - width - 1, changes).astype(int)
        for i in places:
            b[i] = word(1)[0]
        near = lambda t: [w for i in places for w in t[i - width + 1 : i + width]]
        ids = [4 * p + k for k in range(4)]
        rows += zip(ids, (" ".join(t) for t in (a, b, near(a) + passage, near(b) + passage)))
        component |= {ids[0]: ids[0], ids[1]: ids[0], ids[2]: ids[2], ids[3]: ids[3]}
    return rows, component


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_pairs_that_only_just_link(spark, width, percent):
    ship(spark)
    rows, component = made(width, percent, 500, width)
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width, percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == component
