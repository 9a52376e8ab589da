"""Operator 11: secrets by patterns and a convolutional network over characters.

Base kinds are patterns with a check (assign, access, hex) and always stay. Every other candidate, a run of characters of
which keys are made, is judged by a network that sees the whole candidate and the text around it, one symbol for each character
(characters of the candidate and of its surroundings are different symbols). A filter of WIDTH symbols is a sum of one table row for
each symbol, so candidates of any length go through in one flat array: filters, then the highest and the mean response of each, then one weight each.

The network is trained in numpy, in Spark groups, on labelled findings. Where a user has none, they come from the documents: base findings are
secrets, other candidates are not; each is learnt with and without its surroundings, so that the shape counts too. Held-out
findings calibrate the scores as probabilities (Platt) and set the thresholds, one for candidates near a key word and one for others: a
probability of one half, or as much less as it takes to find RECALL of the held-out secrets. What passes is a span of the kind "likely".

One pass over the texts writes the findings, a small table; training takes all distinct findings, of any length, and a second pass over
that table adds the scores. Findings are dealt by hash to shards of about SHARD symbols. In each of EPOCHS rounds every shard is a Spark group that
takes the network through all its findings, and the networks that result are averaged by a Spark aggregation, weighed by their findings, in
fixed point, so that no order of addition shows. The findings held out become counts by label, key word and logit (floored to
1 / STEPS, ends at TOP), from which calibration and thresholds follow; only the network and these counts, both of a fixed size, reach the driver.

Defined results: a null text counts as empty and has no spans; null ids and repeated rows pass through; a table in which
one of the labels is lacking trains nothing and has base spans only; extra columns are ignored; an empty table gives an empty
table. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charlspark.llm.common import cut, ship
from charlspark.llm.terms import id_and_text, text_slices

BASE = ("assign", "access", "hex")
LIKELY = "likely"
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: What may be a key: long runs, and shorter ones with a digit.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")
DIGIT, LONG = re.compile("[0-9]"), 16
KEY_WORD = re.compile(r"(?ai:pass|pwd|secret|token|key|auth|credential|bearer)")
#: Code points before and after a candidate that the network sees.
BEFORE, AFTER = 24, 8

#: Symbols of a shard; steps of a held-out logit and where its counts end; fixed point of averages.
SHARD, STEPS, TOP, POINT = 500_000, 256, 40, 1 << 24
HELD_OUT, RECALL = 4, 0.98
WIDTH, FILTERS, EPOCHS, BATCH, RATE = 5, 16, 6, 256, 0.01
SYMBOLS = 256
#: Symbols that go through the filters at a time.
FLAT = 400_000

FINDING = "struct<kind:string,start:int,end:int,text:string,before:string,body:string,after:string>"
SPAN = "struct<kind:string,start:int,end:int,text:string,score:double>"


def base_spans(text: str) -> Iterator[tuple[str, int, int, int, int]]:
    """kind, start, end and the place of the secret itself."""
    for m in ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 8:
            yield "assign", m.start(), m.end(), m.start(1), m.end(1)
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end(), m.start(), m.end()


def proposed(text: str) -> list[dict]:
    """Base findings and, of kind null, all candidates that touch none."""
    out = sorted(base_spans(text), key=lambda s: (s[1], BASE.index(s[0])))
    ends, top = [], 0
    for s in out:
        top = max(top, s[2])
        ends.append(top)
    starts, more, at = [s[1] for s in out], [], 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        if b - a < LONG and not DIGIT.search(text, a, b):
            continue
        while at < len(starts) and starts[at] < b:
            at += 1
        if not at or ends[at - 1] <= a:
            more.append((None, a, b, a, b))
    return [dict(kind=k, start=a, end=b, text=text[a:b], before=text[max(0, x - BEFORE) : x], body=text[x:y], after=text[y : y + AFTER]) for k, a, b, x, y in out + more]


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, found (all findings of the text)."""
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), *((c, pa.string()) for c in ("text", "before", "body", "after"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = [proposed(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kinds)], names=["id", "found"])

    return id_and_text(docs, key, text).mapInArrow(run, f"id long, found array<{FINDING}>")


def symbols(before: list[str], body: list[str], after: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all findings in turn, each followed by WIDTH - 1 blanks, and where each starts."""
    code = lambda s, own: np.minimum(np.frombuffer(s.encode("utf-32-le"), np.uint32), 127).astype(np.int64) + own
    blank = np.zeros(WIDTH - 1, np.int64)
    parts = [np.concatenate([code(x, 0), code(y, 128), code(z, 0), blank]) for x, y, z in zip(before, body, after)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return np.concatenate(parts), np.cumsum(sizes) - sizes


@dataclass
class Network:
    """filters: WIDTH x SYMBOLS x FILTERS; bias: of each filter; out: weights of the highest and mean responses, then a bias;
    scale, shift: calibration; limits: thresholds without and with a key word near."""

    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    limits: tuple[float, float] = (1.0, 1.0)

    @staticmethod
    def fresh(seed: int = 0) -> "Network":
        rng = np.random.default_rng(seed)
        return Network(rng.normal(0, 0.1, (WIDTH, SYMBOLS, FILTERS)), np.zeros(FILTERS), np.concatenate([rng.normal(0, 0.3, 2 * FILTERS), [0.0]]))

    @staticmethod
    def of(flat: np.ndarray) -> "Network":
        """From the weights in a row."""
        a = WIDTH * SYMBOLS * FILTERS
        return Network(flat[:a].reshape(WIDTH, SYMBOLS, FILTERS), flat[a : a + FILTERS], flat[a + FILTERS :])

    def responses(self, flat: np.ndarray) -> np.ndarray:
        padded = np.concatenate([flat, np.zeros(WIDTH - 1, np.int64)])
        h = sum(self.filters[j][padded[j : j + len(flat)]] for j in range(WIDTH)) + self.bias
        return np.maximum(h, 0) * (flat[:, None] != 0)  # a blank has none, else it would see the next finding

    def pooled(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sizes = np.diff(starts, append=len(h))[:, None]
        return np.concatenate([np.maximum.reduceat(h, starts), np.add.reduceat(h, starts) / sizes, np.ones((len(starts), 1))], axis=1)

    def pieces(self, flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, slice, np.ndarray]]:
        """About FLAT symbols at a time: their symbols and those after them, responses, findings, and where these start in the piece."""
        padded = np.concatenate([flat, np.zeros(WIDTH - 1, np.int64)])
        for a in range(0, len(flat), FLAT):
            some = padded[a : min(a + FLAT, len(flat)) + WIDTH - 1]
            n = len(some) - WIDTH + 1
            own = slice(int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, a + n)))
            h = sum(self.filters[j][some[j : j + n]] for j in range(WIDTH)) + self.bias
            yield some, np.maximum(h, 0) * (some[:n, None] != 0), own, np.maximum(starts[own] - a, 0)

    def inputs(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """As pooled, without the responses of all symbols at once."""
        top, total = np.zeros((len(starts), FILTERS)), np.zeros((len(starts), FILTERS))
        for _, h, own, at in self.pieces(flat, starts):
            top[own] = np.maximum(top[own], np.maximum.reduceat(h, at))
            total[own] += np.add.reduceat(h, at)
        return np.concatenate([top, total / np.diff(starts, append=len(flat))[:, None], np.ones((len(starts), 1))], axis=1)

    def logits(self, before: list[str], body: list[str], after: list[str]) -> np.ndarray:
        """Of any number of findings of any length, about FLAT symbols at a time."""
        out = [np.zeros(0)]
        for a, b in cuts([len(x) for x in body]):
            out.append(self.inputs(*symbols(before[a:b], body[a:b], after[a:b])) @ self.out)
        return np.concatenate(out)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -50, 50)))

    def gradients(self, flat: np.ndarray, starts: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy."""
        x = self.inputs(flat, starts)
        error = (1 / (1 + np.exp(-np.clip(x @ self.out, -50, 50))) - label) / len(label)
        sizes = np.diff(starts, append=len(flat))
        to_max, to_mean = error[:, None] * self.out[:FILTERS], error[:, None] * self.out[FILTERS:-1] / sizes[:, None]
        filters, bias = np.zeros_like(self.filters), np.zeros(FILTERS)
        for some, h, own, at in self.pieces(flat, starts):
            owner = own.start + np.repeat(np.arange(len(at)), np.diff(at, append=len(h)))
            d = (np.where(h == x[owner, :FILTERS], to_max[owner], 0) + to_mean[owner]) * (h > 0)
            order = np.argsort(some, kind="stable")
            seen, first = np.unique(some[order], return_index=True)
            for j in range(WIDTH):
                moved = np.zeros((len(some), FILTERS))
                moved[j : j + len(h)] = d
                filters[j][seen] += np.add.reduceat(moved[order], first)
            bias += d.sum(0)
        return [filters, bias, error @ x]

    def taught(self, rows: list[tuple[str, str, str, int]], rng: np.random.Generator, epochs: int = 1) -> None:
        """Goes through rows (before, body, after, label), and through their bodies alone, in steps of BATCH or FLAT symbols."""
        rows = rows + [("", y, "", k) for _, y, _, k in rows]
        weights = [self.filters, self.bias, self.out]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a, b in cuts([len(rows[i][1]) for i in order], BATCH):
                x, y, z, k = zip(*(rows[i] for i in order[a:b]))
                step += 1
                for w, g, (m, v) in zip(weights, self.gradients(*symbols(x, y, z), np.array(k, float)), moments):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def calibrated(self, logit: np.ndarray, label: np.ndarray, near: np.ndarray, times: np.ndarray) -> "Network":
        """Sets calibration and thresholds from logits of findings held out; times: how often each occurs."""
        self.scale, self.shift = platt(logit, label, times)
        prob = self.probability(logit)
        yes = label == 1
        whole = threshold(prob[yes], times[yes])
        sides = [yes & (near == side) for side in (False, True)]
        self.limits = tuple(threshold(prob[s], times[s]) if times[s].sum() >= 20 else whole for s in sides)
        return self


def cuts(sizes: list[int], most: int | None = None) -> list[tuple[int, int]]:
    """Ranges of findings of about FLAT symbols and at most so many findings; a longer one may end any."""
    out, a, filled = [], 0, 0
    for i, size in enumerate(sizes):
        filled += size + BEFORE + AFTER
        if filled >= FLAT or i + 1 - a == most:
            out.append((a, i + 1))
            a, filled = i + 1, 0
    return out + [(a, len(sizes))] * (a < len(sizes))


def trained(rows: list[tuple[str, str, str, int]], seed: int = 0) -> Network | None:
    """rows: before, body, after, label (1: a secret). None where a label is lacking."""
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held, own = rows[:: HELD_OUT], [r for i, r in enumerate(rows) if i % HELD_OUT]
    if any(len({r[3] for r in part}) < 2 for part in (held, own)):
        return None
    net = Network.fresh(seed)
    net.taught(own, rng, EPOCHS)
    held = held + [("", y, "", k) for _, y, _, k in held]
    x, y, z, k = zip(*held)
    return net.calibrated(net.logits(list(x), list(y), list(z)), np.array(k), near_key(x), np.ones(len(x)))


def near_key(before: Iterable[str]) -> np.ndarray:
    return np.array([bool(KEY_WORD.search(b)) for b in before], bool)


def platt(logit: np.ndarray, label: np.ndarray, times: np.ndarray) -> tuple[float, float]:
    """scale, shift of the logits that make them probabilities, by Newton steps towards smoothed labels."""
    yes, no = times[label == 1].sum(), times[label == 0].sum()
    goal = np.where(label == 1, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.stack([logit, np.ones(len(logit))], axis=1)
    w = np.array([1.0, 0.0])
    loss = lambda w: float(times @ (np.logaddexp(0, x @ w) - goal * (x @ w)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve(x.T @ (x * (times * p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (times * (p - goal)))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def threshold(prob: np.ndarray, times: np.ndarray) -> float:
    """One half, or the highest below it at which RECALL of these still pass."""
    order = np.argsort(prob)
    upto = np.cumsum(times[order])
    return min(0.5, float(prob[order][np.searchsorted(upto, int((1 - RECALL) * upto[-1]), "right")]))


def lessons(found: DataFrame) -> DataFrame:
    """All distinct findings: before, body, after, label, h (their hash), held (of the part held out)."""
    each = found.select(F.explode("found").alias("f")).select("f.before", "f.body", "f.after", F.col("f.kind").isNotNull().cast("int").alias("label")).distinct()
    h = F.xxhash64("before", "body", "after")
    return cut(each.withColumns({"h": h, "held": F.pmod(h, F.lit(HELD_OUT)) == 0}))


def fitted(found: DataFrame, seed: int = 0) -> Network | None:
    """A network trained on all findings; None where a label is lacking in either part."""
    every = lessons(found)
    symbols_of = F.sum(F.length("before") + F.length("body") + F.length("after"))
    kinds = every.groupBy("held", "label").agg(symbols_of.alias("symbols")).collect()
    if len(kinds) < 4:
        return None
    shards = max(1, round(sum(r.symbols for r in kinds if not r.held) / SHARD))
    own = every.filter("NOT held").select("before", "body", "after", "label", "h", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(shards)).alias("shard"))
    net = Network.fresh(seed)
    for epoch in range(EPOCHS):
        sums = own.groupBy("shard").applyInArrow(lesson(net, epoch), "n long, sums array<long>")
        rows = sums.select("n", F.posexplode("sums")).groupBy("pos").agg((F.sum("col") / F.lit(float(POINT)) / F.sum("n")).alias("w")).collect()
        flat = np.empty(len(rows))
        flat[[r.pos for r in rows]] = [r.w for r in rows]
        net = Network.of(flat)
    counted = every.filter("held").mapInArrow(held_out(net), "label int, near boolean, step int").groupBy("label", "near", "step").count()
    label, near, step, times = (np.array(c) for c in zip(*counted.orderBy("label", "near", "step").collect()))
    return net.calibrated(step / STEPS, label, near, times.astype(float))


def lesson(net: Network, epoch: int) -> Callable[[pa.Table], pa.Table]:
    """The shard's findings in the order of their hashes -> their number and, in fixed point, the network times it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("h", "before", "body", "after", "label")])
        own = Network(net.filters.copy(), net.bias.copy(), net.out.copy())
        own.taught(list(zip(*(table[c].to_pylist() for c in ("before", "body", "after", "label")))), np.random.default_rng([epoch, table["shard"][0].as_py()]))
        sums = np.rint(np.concatenate([w.ravel() for w in (own.filters, own.bias, own.out)]) * POINT).astype(np.int64) * len(table)
        return pa.table({"n": pa.array([len(table)], pa.int64()), "sums": pa.array([sums], pa.list_(pa.int64()))})

    return run


def held_out(net: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Findings, with and without their surroundings -> label, near a key word, logit in steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, z, k = (batch.column(c).to_pylist() for c in ("before", "body", "after", "label"))
            none = [""] * len(x)
            steps = np.floor(np.clip(net.logits(x + none, y + y, z + none), -TOP, TOP) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(k + k, pa.int32()), pa.array(near_key(x + none)), pa.array(steps)], names=["label", "near", "step"])

    return run


def scanned(found: DataFrame, net: Network | None) -> DataFrame:
    """id, secrets (kind, start, end, text, score): by start, then kind; score is null without a network."""
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("score", pa.float64())]))
    order = {k: i for i, k in enumerate((*BASE, LIKELY))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("found").to_pylist()
            every = [f for row in rows for f in row]
            columns = [[f[c] for f in every] for c in ("before", "body", "after")]
            score = net.probability(net.logits(*columns)).tolist() if net else [None] * len(every)
            scores, out = iter(score), []
            for row in rows:
                spans = []
                for f in row:
                    p = next(scores)
                    kind = f["kind"] or (LIKELY if net and p >= net.limits[bool(KEY_WORD.search(f["before"]))] else None)
                    if kind:
                        spans.append(dict(kind=kind, start=f["start"], end=f["end"], text=f["text"], score=p))
                out.append(sorted(spans, key=lambda s: (s["start"], order[s["kind"]])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, kinds)], names=["id", "secrets"])

    return found.mapInArrow(run, f"id long, secrets array<{SPAN}>")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", net: Network | None = None) -> DataFrame:
    """id, secrets of each row; net: one trained on findings of the user's own."""
    found = cut(findings(docs, key, text))
    ship(docs.sparkSession)
    return scanned(found, net or fitted(found))


def listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, number of base spans of each kind, hash of the base spans' listing, listing of all spans."""
    found = scan(docs, key, text)
    of = lambda k: F.filter("secrets", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("secrets", lambda s: s["kind"] != LIKELY)
    return found.select(F.col("id").alias(key), *counts, F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("secrets")).alias("spans"))
