"""Operator 8 [native]: personal data by regular expressions, checksum validators and context words.

Every kind has a pattern that proposes spans (leftmost, non-overlapping) and a validator that confirms them: parts of at
most 255 for ip, Luhn for card, a digit count for phone, mod-97 for iban. Words near a span adjust its score. The base
kinds email, ip, card and phone are kept whatever their score; the added kinds (iban, national phone numbers, and the
numbers of social insurance and passports that need a context word) are kept from MIN_SCORE on.

Spark's functions give the matches but not their places; the places follow from the matches and the gaps between them
(split by the same pattern), as both cover the text in turn: their lengths are summed by blocks of BLOCK matches, then within
each block, so the work grows with the text, not with its square. The patterns cannot backtrack over long runs: a start
inside a run is only tried at the run's beginning or just after the last match, and repetitions are possessive.

One row in, one row out; no shuffle. Defined results: a null text counts as empty and has no spans; null ids and
repeated rows pass through; input columns of the names of the output columns are dropped; an empty table gives an empty table.
Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charlspark.llm.common import whole_text

MIN_SCORE = 0.6
#: Code points before and after a span in which context words count.
NEAR = 40
CONTEXT_GAIN = 0.35
#: Matches whose lengths are summed together.
BLOCK = 64

SPAN = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn's checksum of a string of digits."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """The checksum of account numbers: country and check digits go to the end, letters count 10 to 35."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        v = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(v >= 65, rest * 100 + v - 55).otherwise(rest * 10 + v - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def digit_count(least: int, most: int):
    return lambda m: F.length(digits(m)).between(least, most)


#: A decimal part of at most 255, leading zeros allowed.
PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    confirm: object  # Column -> Column
    score: float
    context: str
    base: bool = False


KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 0.65, r"mail|contact|correo|courriel", True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: m.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"), 0.5, r"\bip\b|host|server|address|adresse", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda m: F.when(F.length(digits(m)).between(16, 19), luhn(digits(m))).otherwise(False), 0.6, r"card|visa|credit|kredit|karte|carte|tarjeta", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", digit_count(8, 15), 0.6, r"tel|phone|call|fon|mobil|appel|llam", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda m: mod97(F.regexp_replace(m, " ", "")), 0.65, r"iban|account|konto|compte|cuenta"),
    Kind("local_phone", r"(?:(?<=(?:^|[^0-9+.\x20()-])[\x20(])|(?<![0-9+.\x20()-]))0[1-9](?:[\x20()./-]?[0-9]){6,12}(?![0-9])", digit_count(8, 13), 0.3, r"tel|phone|call|fon|mobil|appel|llam"),
    Kind("social", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(000|666|9..)|-00-|-0000$"), 0.3, r"ssn|social|insurance|sozial"),
    Kind("passport", r"(?<![A-Za-z0-9])[A-Z][0-9]{8}(?![A-Za-z0-9])", lambda m: F.lit(True), 0.3, r"passport|passeport|reisepass|pasaporte"),
]


def total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, n: a + n)


def placed(kind: Kind, matches: Column, gaps: Column) -> Column:
    """The matches with their places, confirmed and scored. gaps: the text before, between and after them."""

    def with_lengths(lengths: Column) -> Column:
        """lengths: of each match with the gap before it."""
        starts = F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(BLOCK))
        blocks = F.transform(starts, lambda at: F.slice(lengths, at + 1, F.lit(BLOCK)))
        sums = F.transform(blocks, total)
        return F.flatten(bound(sums, lambda done: F.transform(blocks, lambda own, b: bound(total(F.slice(done, F.lit(1), b)), lambda base: F.filter(F.transform(own, lambda _, i: span(own, b, i, base)), lambda s: s.isNotNull())))))

    def span(own: Column, b: Column, i: Column, base: Column) -> Column:
        n = b * BLOCK + i
        m = F.get(matches, n)
        return F.when(kind.confirm(m), bound(base + total(F.slice(own, F.lit(1), i + 1)), lambda end: scored(m, n, end)))

    def scored(m: Column, n: Column, end: Column) -> Column:
        around = F.lower(F.concat(F.substring(F.get(gaps, n), F.lit(-NEAR), F.lit(NEAR)), F.lit(" "), F.substring(F.get(gaps, n + 1), 1, NEAR)))
        score = F.lit(kind.score) + F.when(around.rlike(kind.context), CONTEXT_GAIN).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("text"), score.alias("score"))

    good = bound(F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.length(m) + F.length(g)), with_lengths)
    return good if kind.base else F.filter(good, lambda s: s["score"] >= MIN_SCORE)


def bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds pii: all spans (kind, start, end, text, score), by kind as in KINDS, then start."""
    own = [f"__pii_m{k}" for k in range(len(KINDS))]
    df = docs.drop("pii").withColumn("__pii_text", whole_text(f"`{text}`"))
    df = df.withColumns({c: F.regexp_extract_all("__pii_text", F.lit(k.pattern), F.lit(0)) for c, k in zip(own, KINDS)})
    gaps = [F.split("__pii_text", k.pattern, -1) for k in KINDS]
    df = df.withColumns({f"{c}g": F.when(F.size(c) > 0, g) for c, g in zip(own, gaps)})
    spans = [F.when(F.size(c) > 0, placed(k, F.col(c), F.col(f"{c}g"))).otherwise(F.array().cast(SPAN)) for c, k in zip(own, KINDS)]
    return df.withColumn("pii", F.concat(*[s.cast(SPAN) for s in spans])).drop("__pii_text", *own, *[f"{c}g" for c in own])


def listing(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, number of base spans of each kind, hash of the base spans' listing, listing of all spans."""
    names = [k.name for k in KINDS if k.base]
    found = find(docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("text")))
    of = lambda n: F.filter("pii", lambda s: s["kind"] == n)
    counts = [F.size(of(n)).cast("long").alias(f"n_{n}") for n in names]
    base = F.filter("pii", lambda s: s["kind"].isin(names))
    return found.select(key, *counts, F.sha2(listing(base), 256).alias("base_sha256"), listing(F.col("pii")).alias("spans"))
