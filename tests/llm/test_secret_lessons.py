"""The network of operator 11 learns from all findings, whatever their number, length and partitions."""

import numpy as np
from pyspark.sql import functions as F

from charlspark.llm import secret_scan


def table(spark, n):
    rng = np.random.default_rng(11)
    code = lambda m: "".join(rng.choice(list("0123456789abcdef"), m))
    word = lambda: "".join(rng.choice(list("aeioulnrst"), 9)) + "-" + "".join(rng.choice(list("aeioulnrst"), 9))
    rows = [(i, f"und secret={code(40)} auch {word()} hier") for i in range(n)] + [(n, "token=" + "k7" * 3000), (n + 1, "x " + "ab-" * 2000)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_all_findings_are_lessons(spark, monkeypatch):
    docs = table(spark, 2300)
    found = secret_scan.findings(docs).cache()
    every = secret_scan.lessons(found)
    assert {(r.label, r["count"]) for r in every.groupBy("label").count().collect()} == {(1, 2301), (0, 2301)}  # more than 2,000 of each
    assert every.filter(F.length("body") > 4096).count() == 2
    monkeypatch.setattr(secret_scan, "SHARD", 60_000)
    monkeypatch.setattr(secret_scan, "EPOCHS", 2)
    net, again = secret_scan.fitted(found), secret_scan.fitted(found.repartition(7))
    assert (net.filters == again.filters).all() and net.limits == again.limits and np.allclose((net.scale, net.shift), (again.scale, again.shift))
    got = secret_scan.scanned(found, net).select(F.explode("secrets").alias("s")).groupBy("s.kind").count().collect()
    got = {r.kind: r["count"] for r in got}
    assert got["assign"] == 2301 and got.get("likely", 0) < 120


def test_neighbours_do_not_matter():
    net = secret_scan.Network.fresh(2)
    x, y, z = ["ab", "", "q = "], ["x1y2z3", "hello.world", "0aF" * 20], ["", " c", "!"]
    alone = [net.logits([a], [b], [c])[0] for a, b, c in zip(x, y, z)]
    assert np.allclose(alone, net.logits(x, y, z)) and np.allclose(alone[::-1], net.logits(x[::-1], y[::-1], z[::-1]))


def test_pieces_of_long_findings_agree(monkeypatch):
    net = secret_scan.Network.fresh(2)
    flat, starts = secret_scan.symbols(["ab", "", "q"], ["x1y2z3" * 9, "hello.world", "0aF" * 20], ["", " c", "!"])
    label = np.array([1.0, 0.0, 1.0])
    whole, inputs = net.gradients(flat, starts, label), net.pooled(net.responses(flat), starts)
    for size in (7, 20, 64):
        monkeypatch.setattr(secret_scan, "FLAT", size)
        assert np.allclose(net.inputs(flat, starts), inputs)
        assert all(np.allclose(a, b) for a, b in zip(net.gradients(flat, starts, label), whole))


def test_thresholds_of_counts():
    prob = np.array([0.4, 0.1, 0.3, 0.2])
    times = np.array([90.0, 1.0, 7.0, 2.0])
    each = np.sort(np.repeat(prob, times.astype(int)))
    assert secret_scan.threshold(prob, times) == min(0.5, each[int((1 - secret_scan.RECALL) * len(each))])
