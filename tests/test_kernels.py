"""The kernels of draws against plain Python."""

import hashlib
import random

import pyarrow as pa

from charlspark.operators import kernels


def plain(text, k):
    return int(hashlib.md5(f"{text}{k}".encode()).hexdigest()[:13], 16)


def test_hashes_of_texts_of_any_length():
    texts = ["x" * i for i in range(200)] + ["", "é|日本|\U0001f600", "42|s3|-17|I50|"]
    for rows in (texts, texts[50:60], texts[:1], []):
        for n in (1, 12, 101):
            got = kernels.heads(pa.array(rows, pa.string()), n)
            assert got.tolist() == [[plain(t, k) for t in rows] for k in range(1, n + 1)]
    assert kernels.heads(pa.array(texts).slice(3, 7), 2).tolist() == [[plain(t, k) for t in texts[3:10]] for k in (1, 2)]


def test_picks_and_unions():
    rng = random.Random(3)
    cuts = [sorted(rng.randrange(1 << 52) for _ in range(rng.randrange(6))) for _ in range(40)]
    begin = [None if rng.random() < 0.2 else f"t{i}|" for i in range(40)]
    place = lambda t, k, own: sum(c <= plain(t, k) for c in own)
    got = kernels.picker(11)(pa.array(begin, pa.string()), pa.array(cuts, pa.list_(pa.int64()))).to_pylist()
    assert got == [None if b is None else [place(b, k, c) for k in range(1, 12)] for b, c in zip(begin, cuts)]
    one = lambda i: {"begin": f"t{i}|", "cuts": cuts[i], "masks": [{"mask": rng.randrange(1 << 62), "mask1": rng.randrange(8)} for _ in range(len(cuts[i]) + 1)]}
    rows = [[one(rng.randrange(40)) for _ in range(rng.choice([0, 0, 1, 3]))] for _ in range(30)]
    fixed = [[rng.randrange(1 << 62) for _ in rows], [rng.randrange(8) for _ in rows]]
    kind = pa.list_(pa.struct([("begin", pa.string()), ("cuts", pa.list_(pa.int64())), ("masks", pa.list_(pa.struct([("mask", pa.int64()), ("mask1", pa.int64())])))]))
    words = [pa.array(f, pa.int64()) for f in fixed]
    want = []
    for row, own in zip(rows, zip(*fixed)):
        draws = []
        for k in range(1, 12 if row else 2):
            masks = [o["masks"][place(o["begin"], k, o["cuts"])] for o in row]
            draws.append([own[0], own[1]])
            for m in masks:
                draws[-1] = [draws[-1][0] | m["mask"], draws[-1][1] | m["mask1"]]
        want.append(draws)
    got = kernels.uniter(11, ["mask", "mask1"])(pa.array(rows, kind), *words).to_pylist()
    assert [[[d["mask"], d["mask1"]] for d in row] for row in got] == want
    suppressed, weighed = [([0, 1], [2, 0]), ([2, 4], [1, 2])], [(1.0, [6, 3]), (3.0, [1, 4])]

    def score(d):
        kept = list(d)
        for up, own in suppressed:
            if any(x & p for x, p in zip(d, up)):
                kept = [x & ~b for x, b in zip(kept, own)]
        return sum(w * (x & b).bit_count() for w, bits in weighed for x, b in zip(kept, bits))

    assert kernels.scorer(11, suppressed, weighed)(pa.array(rows, kind), *words).to_pylist() == [[score(d) for d in row] for row in want]
    assert kernels.scorer(3, [], [])(pa.array([], kind), words[0].slice(0, 0)).to_pylist() == []
