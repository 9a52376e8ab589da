"""Operator 5 on a family of many copies beside sets that just miss it, of which some link with one of its members."""

import numpy as np
import pytest

from charlspark.llm import jaccard_join
from charlspark.llm.common import ship


def made(width, percent, seed):
    rng = np.random.default_rng(seed)
    word = lambda n: ["w%x" % x for x in rng.integers(0, 1 << 40, n)]
    base = word(120 + width - 1)

    def changed(text, changes, least, most):
        text = list(text)
        for i in np.linspace(least, most - 1, changes).astype(int):
            text[i] = word(1)[0]
        return text

    family = [changed(base, 1, int(rng.integers(0, 120)), 123) for _ in range(300)]
    far = [changed(base, 6, width, 118) for _ in range(40)]  # each misses the family, and the others
    copies = [changed(far[k % 5], 1, int(rng.integers(0, 120)), 123) for k in range(30)]  # families of their own
    between = [changed(base, 3, width, 60) for _ in range(10)]
    texts = family + far + copies + between
    return [(int(i), " ".join(t)) for i, t in zip(rng.permutation(len(texts)), texts)]


def brute(rows, width, percent):
    sets = {i: {" ".join(w[k : k + width]) for k in range(len(w) - width + 1)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_light_units_ask(spark, width, percent):
    ship(spark)
    rows = made(width, percent, width)
    want = brute(rows, width, percent)
    assert 1 < len(set(want.values())) < len(rows) - 250
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width, percent)
    assert {r.doc_id: r.component_id for r in got.collect()} == want
