"""Operator 6 [native]: document fingerprints as invertible Bloom lookup sketches.

A text's paragraphs (lines, cut further at sentence ends before white space, and after PIECE code points where a run has none,
so that pieces are the same again from the first sentence after an edit) are hashed. A sketch puts each digest
into one cell of each of three rows; a cell holds the number of its digests, their XOR and the XOR of their check hashes.
Sketches of two versions subtract cell by cell: common digests cancel. Cells that then hold one digest (the check
proves it) are peeled: the digest is recovered and taken out of its other cells, which frees further ones.

The published fingerprint is one sketch of 3 * ROW_CELLS cells. Where it cannot be peeled to the end, digests are dealt by another hash
to parts of about LOAD of both versions, with a sketch of 3 * PART_CELLS cells each, and a part that cannot be peeled is tried again
with other hashes and twice the cells, until it peels. Sizes and recovered digests give the likeness, the share of
common digests among all. Digests are dealt to parts by digits, so the work grows with a text's paragraphs, not their square.

The next document in descending id order comes from a window over ranges of ids (each of about RANGE rows; a range that holds
far more is cut again by its own ids, and rows of one id by a hash of the text) plus a small table with the largest id
of each range; no window spans all rows.

Defined results: a null text counts as empty; empty texts are alike (1.0); rows without id are left out; rows that repeat
an id are neighbours, in the order of a hash of the text; a table of one row is its own next document; extra columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from charlspark.llm.common import cut, parts_for, whole_text

PIECE = 200
ROW_CELLS = 12
PART_CELLS = 8
LOAD = 12
#: Tries of a part, each with other hashes; few parts need a third one.
TRIES = 12
#: Rounds of peeling; each takes all digests that stand alone in a cell.
ROUNDS = 16
RANGE = 1024
MOST_RANGES = 1_000_000

SIDES = "struct<plus:int,minus:int>"


def bound(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\n]{{0,{PIECE - 1}}}?(?:[.!?](?=[ \t])|[^\n](?=\n|\z))|[^\n]{{1,{PIECE}}}"), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda p: F.xxhash64(F.trim(p))))


def check(k: Column) -> Column:
    return F.xxhash64(k, F.lit(17))


def place(k: Column, salt: Column) -> Column:
    return F.xxhash64(k, salt)


def item(k: Column, salt: Column, row_cells: Column, *more: Column) -> Column:
    """struct(k, c, i0, i1, i2, ...): a digest, its check hash and its place in each row, from parts of the place hash."""
    at = lambda x, row: (F.shiftrightunsigned(x, 20 * row).bitwiseAND(F.lit(0xFFFFF)) % row_cells).cast("int")
    return bound(place(k, salt), lambda x: F.struct(k.alias("k"), check(k).alias("c"), *[at(x, row).alias(f"i{row}") for row in range(3)], *more))


def items(keys: Column, salt: Column, row_cells: Column, n: int = 1) -> Column:
    return F.transform(keys, lambda k: item(k, salt, row_cells, F.lit(n).alias("n")))


def sketch(own: Column, row_cells: Column) -> Column:
    """The cells of items; those with n = -1 are taken out."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("c"))
    add = lambda a, i: F.struct((a["n"] + i["n"]).alias("n"), a["k"].bitwiseXOR(i["k"]).alias("k"), a["c"].bitwiseXOR(i["c"]).alias("c"))

    def of_row(row: int) -> Column:
        return F.transform(F.sequence(F.lit(0), row_cells - 1), lambda j: F.aggregate(F.filter(own, lambda i: i[f"i{row}"] == j), zero, add))

    return F.concat(*[of_row(row) for row in range(3)])


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def is_pure(cell: Column) -> Column:
    return ((cell["n"] == 1) | (cell["n"] == -1)) & (cell["c"] == check(cell["k"]))


def peel(cells: Column, salt: Column, row_cells: Column) -> Column:
    """struct(cells left, found: recovered digests with their sides 1 or -1)."""
    zero = F.struct(cells.alias("cells"), F.array().cast("array<struct<n:int,k:bigint>>").alias("found"), F.lit(True).alias("going"))

    def step(state: Column, _: Column) -> Column:
        def without(ones: Column) -> Column:
            less = lambda cell, one: F.struct((cell["n"] - one["n"]).alias("n"), cell["k"].bitwiseXOR(one["k"]).alias("k"), cell["c"].bitwiseXOR(one["c"]).alias("c"))
            of_row = lambda row: F.transform(F.slice(state["cells"], row_cells * row + 1, row_cells), lambda cell, j: F.aggregate(F.filter(ones, lambda one: one[f"i{row}"] == j), cell, less))
            return F.concat(*[of_row(row) for row in range(3)])

        def out(pure: Column) -> Column:
            ones = F.transform(pure, lambda p: item(p["k"], salt, row_cells, p["n"].alias("n")))
            more = F.struct(bound(ones, without).alias("cells"), F.concat(state["found"], pure).alias("found"), F.lit(True).alias("going"))
            return F.when(F.size(pure) > 0, more).otherwise(F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(False).alias("going")))

        pure = F.transform(F.filter(state["cells"], is_pure), lambda c: F.struct(c["n"].alias("n"), c["k"].alias("k")))
        return F.when(state["going"], bound(F.array_distinct(pure), out)).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), zero, step)


def is_empty(cells: Column) -> Column:
    return F.forall(cells, lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0))


def sides(state: Column) -> Column:
    """struct(plus, minus): numbers of digests on either side, null if peeling failed."""
    count = lambda sign: F.size(F.filter(state["found"], lambda f: f["n"] == sign))
    return F.when(is_empty(state["cells"]), F.struct(count(1).alias("plus"), count(-1).alias("minus")))


def dealt(keys: Column, parts: Column) -> Column:
    """Digests by part (an array for each), digit by digit of the part's number to the base of 16."""

    def by_digit(held: Column, bits: int, n: Column) -> Column:
        digit = lambda i: F.shiftright(i["p"], bits) if bits == 12 else F.shiftright(i["p"], bits).bitwiseAND(F.lit(15))
        return F.flatten(F.transform(held, lambda some: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.filter(some, lambda i: digit(i) == k))))

    def split(own: Column) -> Column:
        held = by_digit(F.array(own), 12, F.ceil(parts / 4096).cast("int"))
        for bits in (8, 4, 0):
            held = by_digit(held, bits, F.lit(16))
        few = F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.filter(own, lambda i: i["p"] == k))
        return F.transform(F.when(parts <= 16, few).otherwise(held), lambda some: F.transform(some, lambda i: i["k"]))

    number = lambda k: F.pmod(place(k, F.lit(99)), parts.cast("bigint")).cast("int")
    return bound(F.transform(keys, lambda k: F.struct(k.alias("k"), number(k).alias("p"))), split)


def difference(a: Column, b: Column) -> Column:
    """Numbers of digests only in a and only in b, by sketches of parts."""

    def of_part(own: Column) -> Column:
        def turn(known: Column, t: Column) -> Column:
            row_cells = (F.pow(F.lit(2.0), F.least(t, F.lit(6))) * PART_CELLS).cast("int")
            # both versions go into one set of cells, the second with its sign turned, which is their sketches' difference
            both = F.concat(items(own["a"], t + 101, row_cells), items(own["b"], t + 101, row_cells, -1))
            return F.when(known.isNull(), bound(bound(both, lambda i: peel(sketch(i, row_cells), t + 101, row_cells)), sides)).otherwise(known)

        return F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast(SIDES), turn)

    def with_parts(parts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("plus"), F.lit(0).alias("minus"))
        pairs = F.zip_with(dealt(a, parts), dealt(b, parts), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
        pairs = F.filter(pairs, lambda own: (F.size(own["a"]) > 0) | (F.size(own["b"]) > 0))
        add = lambda t, s: F.when(t.isNotNull() & s.isNotNull(), F.struct((t["plus"] + s["plus"]).alias("plus"), (t["minus"] + s["minus"]).alias("minus")))
        return F.aggregate(F.transform(pairs, of_part), zero, add)

    return bound(F.greatest(F.ceil((F.size(a) + F.size(b)) / LOAD), F.lit(1)).cast("int"), with_parts)


def likeness(a: Column, b: Column, a_cells: Column, b_cells: Column) -> Column:
    """Share of common digests, from the fingerprints where these peel, else from larger sketches."""
    few = lambda d: F.size(F.filter(d, lambda c: c["n"] == 0)) >= ROW_CELLS
    published = bound(subtract(a_cells, b_cells), lambda d: F.when(few(d), bound(peel(d, F.lit(100), F.lit(ROW_CELLS)), sides)))
    found = bound(published, lambda known: F.when(known.isNull(), difference(a, b)).otherwise(known))
    found = F.coalesce(found, F.raise_error(F.lit("no sketch peels")).cast(SIDES))

    def share(d: Column) -> Column:
        common = F.greatest(F.size(a) - d["plus"], F.lit(0))
        total = common + d["plus"] + d["minus"]
        return F.when(total == 0, 1.0).otherwise(common / total)

    return bound(found, share)


def printed(cells: Column) -> Column:
    """The fingerprint as text: number:xor:check of each cell in hex; empty cells are left blank."""
    return F.array_join(F.transform(cells, lambda c: F.when(c["n"] == 0, F.lit("")).otherwise(F.concat_ws(":", c["n"], F.lower(F.hex(c["k"])), F.lower(F.hex(c["c"]))))), ",")


def ranges(docs: DataFrame, low: int, high: int, n: int) -> tuple[DataFrame, list[str]]:
    """docs with the numbers of a range of (id, h), most significant first, and these columns' names.

    Distances of ids are exact, and a range of several ids that is too large always falls into smaller ones, so the cuts end. Rows of
    one id are cut by h; if even rows of one id and one h are too many, that h becomes a range of its own, dealt out
    anyhow, as these rows are equal."""
    width, names = max(1.0, (high - low + 1) / max(1, n // RANGE)), ["r0"]
    docs = docs.withColumn("r0", F.floor(apart(F.col("id"), F.lit(low)) / F.lit(width)).cast("long"))
    while True:
        held = docs.groupBy(*names).agg(F.count("*").alias("rows"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter(F.col("rows") > 8 * RANGE)
        held = cut(held)
        several = held.filter("lo < hi")
        if several.isEmpty():
            break
        new = f"r{len(names)}"
        steps = several.select(*names, "lo", ((apart(F.col("hi"), F.col("lo")) + 1) * RANGE / F.col("rows")).alias("step"))
        docs = docs.join(small(steps), names, "left").withColumn(new, F.coalesce(F.floor(apart(F.col("id"), F.col("lo")) / F.greatest("step", F.lit(1.0))), F.lit(0)).cast("long")).drop("lo", "step")
        names.append(new)
    if not held.isEmpty():  # many rows of one id
        one = held.select(*names, (F.col("rows") / RANGE).alias("cuts"))
        docs = docs.join(small(one), names, "left").withColumn("rh", F.coalesce(F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("cuts")), F.lit(0)).cast("long")).drop("cuts")
        names.append("rh")
        equal = cut(docs.groupBy(*names, "h").agg(F.count("*").alias("rows")).filter(F.col("rows") > 8 * RANGE))
        if not equal.isEmpty():
            docs = docs.join(small(equal.select(*names, F.lit(True).alias("own")).distinct()), names, "left").withColumn("rg", F.when(F.col("own"), F.col("h")).otherwise(F.lit(0))).drop("own")
            cuts = equal.select(*names, F.col("h").alias("rg"), F.ceil(F.col("rows") / RANGE).alias("cuts"))
            names.append("rg")
            docs = docs.join(small(cuts), names, "left").withColumn("rr", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("cuts")), F.lit(0)).cast("long")).drop("cuts")
            names.append("rr")
    return docs, names


def apart(a: Column, b: Column) -> Column:
    """a - b of longs, without loss before it is a double."""
    return (a.cast("decimal(20,0)") - b.cast("decimal(20,0)")).cast("double")


def small(df: DataFrame) -> DataFrame:
    """To be broadcast, if it has at most MOST_RANGES rows of a few numbers."""
    return F.broadcast(df) if df.limit(MOST_RANGES + 1).count() <= MOST_RANGES else df


def with_next(docs: DataFrame) -> DataFrame:
    """id, text -> id, text, t, tc (the text's digests and their cells) and next, n, nc: those of the next document in descending
    id order; after the last, the first's."""
    sketched = lambda df: df.withColumn("t", digests(F.col("text"))).withColumn("tc", sketch_of(F.col("t")))
    low, high, n = docs.agg(F.min("id"), F.max("id"), F.count("*")).first()
    if not n:
        return sketched(docs).withColumns({"next": F.col("text"), "n": F.col("t"), "nc": F.col("tc")})
    placed, names = ranges(docs.withColumn("h", F.xxhash64("text")), low, high, n)
    tops = cut(placed.groupBy(*names).agg(F.max(F.struct("id", "h")).alias("top")))
    first = tops.agg(F.max("top")).first()[0]
    order = Window.orderBy(*[F.desc(c) for c in names])
    follow = tops.select(*names, F.lead("top", 1).over(order).alias("top")).select(*[F.col(c).alias(f"to_{c}") for c in names], F.coalesce("top.id", F.lit(first.id)).alias("id"), F.coalesce("top.h", F.lit(first.h)).alias("h"))
    # each range also gets the document that follows it, as its last row
    after = docs.withColumn("h", F.xxhash64("text")).join(small(cut(follow)), ["id", "h"]).groupBy(*[f"to_{c}" for c in names]).agg(F.first("id").alias("id"), F.first("h").alias("h"), F.first("text").alias("text"))
    after = after.select(*[F.col(f"to_{c}").alias(c) for c in names], "id", "h", "text", F.lit(True).alias("guest"))
    own = placed.select(*names, "id", "h", "text", F.lit(False).alias("guest"))
    spread = own.unionByName(after).repartition(parts_for(docs, 12), *names)
    order = Window.partitionBy(*names).orderBy("guest", F.desc("id"), F.desc("h"))
    follow = {new: F.lead(own).over(order) for new, own in (("next", "text"), ("n", "t"), ("nc", "tc"))}
    return sketched(spread).withColumns(follow).filter("NOT guest").select("id", "text", "t", "tc", *follow)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    pairs = with_next(docs.select(F.col(f"`{key}`").alias("id"), whole_text(f"`{text}`").alias("text")).filter("id IS NOT NULL"))
    third = F.floor(F.length("text") / 3).cast("int")
    df = pairs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next", F.lit(1), third)))
    df = df.select("id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "t", "tc", "n", "nc", digests(F.col("edited")).alias("e"))
    df = df.withColumn("ec", sketch_of(F.col("e")))
    near = {"near_edited": likeness(F.col("t"), F.col("e"), F.col("tc"), F.col("ec")), "near_next": likeness(F.col("t"), F.col("n"), F.col("tc"), F.col("nc"))}
    return df.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", printed(F.col("tc")).alias("fingerprint"), printed(F.col("ec")).alias("edited_fingerprint"), *[c.alias(n) for n, c in near.items()])


def sketch_of(keys: Column) -> Column:
    """The cells of the published fingerprint of digests."""
    return bound(items(keys, F.lit(100), F.lit(ROW_CELLS)), lambda own: sketch(own, F.lit(ROW_CELLS)))
