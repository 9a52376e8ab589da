"""Exact scores: triggered groups, suppression, sums.

The groups of a map also serve as bits of a mask: 63 to a word, as many words as the map needs. A set of groups is then a few
long columns, its union an aggregation by bit_or, and a score a count of bits for each weight that occurs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of a word; its sign stays clear.
WORD = 63


def folded(op: Callable[[Column, Column], Column], terms: Sequence[Column]) -> Column:
    """The terms joined by op as a flat tree, as deep as the logarithm of their number."""
    terms = list(terms)
    while len(terms) > 1:
        terms = [reduce(op, terms[i : i + 2]) for i in range(0, len(terms), 2)]
    return terms[0]


def either(terms: Sequence[Column]) -> Column:
    return folded(lambda a, b: a.bitwiseOR(b), terms)


def word(bits: int) -> Column:
    return F.lit(bits).cast("long")


@dataclass(frozen=True)
class Groups:
    """A map's groups on the driver, in order: names, weights and the positions of each one's parents."""

    names: tuple[str, ...]
    weights: tuple[float, ...]
    parents: tuple[tuple[int, ...], ...]

    @staticmethod
    def of(weights: DataFrame, deps: DataFrame) -> "Groups":
        return Groups.made([(r.gk, r.w) for r in weights.collect()], [(r.child, r.parent) for r in deps.collect()])

    @staticmethod
    def of_map(groups: DataFrame) -> "Groups":
        """From the map itself: groups that have a pattern; one row for each group comes to the driver."""
        some = F.exists("codes", lambda b: (b["condition"] == "any") & (F.size(b["codes"]) > 0))
        rows = groups.select("gk", "weight", F.coalesce(some, F.lit(False)).alias("some"), "depends_on").collect()
        return Groups.made([(r.gk, r.weight) for r in rows if r.some], [(r.gk, p) for r in rows for p in r.depends_on or []])

    @staticmethod
    def made(weights: list[tuple[str, float]], deps: list[tuple[str, str]]) -> "Groups":
        """Dependencies on groups that are not listed have no effect."""
        rows = sorted(set(weights))
        at = {gk: i for i, (gk, _) in enumerate(rows)}
        up: dict[str, set[int]] = {}
        for child, parent in deps:
            if parent in at:
                up.setdefault(child, set()).add(at[parent])
        return Groups(tuple(g for g, _ in rows), tuple(w for _, w in rows), tuple(tuple(sorted(up.get(g, ()))) for g, _ in rows))

    def columns(self, kind: str = "mask") -> list[str]:
        """Names of the words of a mask."""
        return [kind if i == 0 else f"{kind}{i}" for i in range(max(1, -(-len(self.names) // WORD)))]

    def mask(self, kind: str = "mask") -> list[Column]:
        return [F.col(c) for c in self.columns(kind)]

    def ored(self, kind: str = "mask", of: Sequence[Column] | None = None) -> list[Column]:
        """The union of masks, as aggregates."""
        return [F.bit_or(c).alias(n) for n, c in zip(self.columns(kind), of or self.mask(kind))]

    def literal(self, members: Sequence[int]) -> list[int]:
        out = [0] * len(self.columns())
        for i in members:
            out[i // WORD] |= 1 << (i % WORD)
        return out

    def bits(self, gk: Column) -> list[Column]:
        """The mask of one group by name; empty for an unknown one."""
        at = F.coalesce(F.array_position(F.array(*map(F.lit, self.names)), gk), F.lit(0)) - 1 if self.names else F.lit(-1)
        one = lambda i: F.call_function("shiftleft", word(1), (at - WORD * i).cast("int"))
        return [F.when(at.between(WORD * i, WORD * i + WORD - 1), one(i)).otherwise(word(0)) for i in range(len(self.columns()))]

    def suppressed(self) -> list[tuple[list[int], list[int]]]:
        """Parents and the children that they share, as the words of masks."""
        children: dict[tuple[int, ...], list[int]] = {}
        for i, up in enumerate(self.parents):
            if up:
                children.setdefault(up, []).append(i)
        return [(self.literal(up), self.literal(own)) for up, own in children.items()]

    def weighed(self) -> list[tuple[float, list[int]]]:
        """Each weight that occurs, and its groups as the words of a mask."""
        return [(float(w), self.literal([i for i, x in enumerate(self.weights) if x == w])) for w in sorted(set(self.weights))]

    def counted(self, mask: Sequence[Column]) -> list[Column]:
        """The groups that count: none of their parents is in the mask; parents that are suppressed themselves suppress as well."""
        gone: list[list[Column]] = [[] for _ in mask]
        for up, own in self.suppressed():
            hit = folded(lambda a, b: a | b, [c.bitwiseAND(word(p)) != 0 for c, p in zip(mask, up) if p])
            for i, bits in enumerate(own):
                if bits:
                    gone[i].append(F.when(hit, word(bits)).otherwise(word(0)))
        return [c.bitwiseAND(F.bitwise_not(either(g))) if g else c for c, g in zip(mask, gone)]

    def total(self, mask: Sequence[Column]) -> Column:
        """The sum of weights without suppression."""
        terms = []
        for w, lit in self.weighed():
            terms.append(folded(lambda a, b: a + b, [F.bit_count(c.bitwiseAND(word(b))) for c, b in zip(mask, lit) if b]) * F.lit(w))
        return folded(lambda a, b: a + b, terms) if terms else F.lit(0.0)

    def score(self, mask: Sequence[Column]) -> Column:
        """The sum of weights that count."""
        return self.total(self.counted(mask))

    def score_of(self, df: DataFrame, name: str, kind: str = "mask") -> DataFrame:
        """df with the score in place of the mask's words, which are computed once."""
        cols = self.columns(kind)
        kept = df.withColumns(dict(zip(cols, self.counted(self.mask(kind)))))
        return kept.withColumn(name, self.total(self.mask(kind))).drop(*[c for c in cols if c != name])

    def has(self, mask: Sequence[Column], i: int) -> Column:
        return mask[i // WORD].bitwiseAND(word(1 << (i % WORD))) != 0

    def listed(self, mask: Sequence[Column]) -> Column:
        """The names of the groups in a mask."""
        words = F.array(*mask)
        inside = lambda _, i: F.call_function("shiftright", F.get(words, (i / F.lit(WORD)).cast("int")), i % WORD).bitwiseAND(word(1)) == 1
        return F.filter(F.array(*map(F.lit, self.names)).cast("array<string>"), inside)

    def active(self, mask: Sequence[Column]) -> Column:
        """The names of the groups that count."""
        return self.listed(self.counted(mask))

    def masks(self, code_groups: DataFrame) -> DataFrame:
        """code and the words of its mask."""
        return code_groups.groupBy("code").agg(*self.ored(of=self.bits(F.col("gk"))))


def triggered(dx: DataFrame, code_groups: DataFrame) -> DataFrame:
    """Distinct enc_id, gk."""
    return dx.join(code_groups, "code").select("enc_id", "gk").distinct()


def active(trig: DataFrame, deps: DataFrame, weights: DataFrame) -> DataFrame:
    """enc_id, gk, w of the groups that count: a child goes if any parent is triggered for the encounter."""
    parents = trig.select(F.col("enc_id").alias("enc_id"), F.col("gk").alias("parent"))
    gone = trig.join(deps, trig["gk"] == deps["child"]).select("enc_id", "gk", "parent").join(parents, ["enc_id", "parent"]).select("enc_id", "gk")
    return trig.join(gone, ["enc_id", "gk"], "left_anti").join(weights, "gk").select("enc_id", "gk", "w")


def score_masked(encounters: DataFrame, masked: DataFrame, groups: Groups) -> DataFrame:
    """enc_id, cci for every encounter; masked: enc_id and the words of a mask. One exchange by enc_id of either."""
    own = groups.score_of(masked.groupBy("enc_id").agg(*groups.ored()), "cci")
    return encounters.select("enc_id").join(own, "enc_id", "left").select("enc_id", F.coalesce("cci", F.lit(0.0)).cast("int").alias("cci"))


def score(encounters: DataFrame, dx: DataFrame, masks: DataFrame, groups: Groups) -> DataFrame:
    """enc_id, cci for every encounter, from diagnoses and the masks of their codes."""
    return score_masked(encounters, dx.join(masks, "code"), groups)
