"""Operator 1: language identification by Bayesian evidence fusion.

Four kinds of evidence meet in log space for each record and language:
- the text: a naive Bayes model of hashed byte trigrams, damped beyond FULL_GRAMS so that long texts do not drown the rest;
- the declared markup language, by P(declared | language);
- the address suffix, by P(suffix | language);
- the host: its prior, smoothed towards its domain's, that towards its suffix's, and that towards all records'.
The tables of the last three are grouped sums of the text posteriors over all records, so they need no labels.

The trigram model alone is fitted to labelled rows, for each label a sample of about LABEL_ROWS picked by a hash of id and text,
all of a label that has fewer; all else covers every record. Every label with text is a language; the model has BUCKETS
rows for each, whatever the input's size (0.13 MB a label in memory), and each score is a column, so a table with more than MOST_LABELS labels
is refused with an error. Scores are slim rows, so no text is
shuffled; hot hosts are combined before the shuffle, and their prior comes back by a join whose other side has one
row for each host.

Defined results: a null or empty text gives no text evidence; without letters in the text, the language is 'und' and the record is
rejected; null declared language, suffix or host are values of their own that carry the evidence of such rows; rows
with equal ids are judged one by one; extra columns are ignored; an empty table gives an empty table; with no labelled rows at all
every record is 'und'.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from charlspark.llm.common import cut, tidy
from charlspark.llm.shingles import LOWER

LABEL_ROWS = 1000
#: Labels that a model can have.
MOST_LABELS = 256
#: Ends of whatever may be open at the end of a page.
ENDS = "--></script></style>"
BUCKETS = 1 << 15
FULL_GRAMS = 60
#: Pseudo-records by which each level leans on the one above.
LEAN = 5.0
#: Smoothing of the declared and suffix tables.
SMOOTH = 2.0
MIN_PROB = 0.6
SLICE_BYTES = 1_000_000


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray  # BUCKETS x languages, log probabilities


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bucket of each trigram, text of each, and number of letters for each text. Bytes other than letters count as blanks."""
    lengths = np.array([len(t) + 3 for t in texts], np.int64)
    s = LOWER[np.frombuffer(b"".join(b" " + t + b"  " for t in texts), np.uint8)].astype(np.uint32)
    letter = (s >= 97) & (s <= 122) | (s >= 128)
    s[~letter] = 32
    code = s.copy()
    code[:-1] |= s[1:] << 8
    code[:-2] |= s[2:] << 16
    use = letter | np.concatenate([letter[1:], [False]])
    use[np.cumsum(lengths) - 2], use[np.cumsum(lengths) - 1] = False, False
    owner = np.repeat(np.arange(len(texts)), lengths)
    letters = np.bincount(owner[letter], minlength=len(texts))
    at = np.flatnonzero(use)
    return ((code[at] * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64), owner[at], letters


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        start, texts, held = 0, [], 0
        for k in range(batch.num_rows):
            texts.append(batch.column(column)[k].as_py() or b"")
            held += len(texts[-1])
            if held >= SLICE_BYTES or k + 1 == batch.num_rows:
                yield batch.slice(start, len(texts)), texts
                start, texts, held = k + 1, [], 0


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", rows: int = LABEL_ROWS) -> Model:
    """The trigram model from about rows rows of each label: those with the smallest hashes of id and text, so that a label whose ids are null or
    repeated is sampled like any other, and at least the smallest, so that none is lost. More than MOST_LABELS labels are refused: the model
    has a column for each, and such a table's labels are not languages."""
    labelled = docs.select(F.col(f"`{key}`").alias("id"), F.encode(F.coalesce(f"`{text}`", F.lit("")), "UTF-8").alias("t"), F.lower(F.trim(f"`{label}`")).alias("lang")).filter("lang IS NOT NULL AND lang <> ''")
    labelled = labelled.withColumn("h", F.pmod(F.xxhash64("id", "t", F.lit(11)), F.lit(1 << 30)))
    share = F.when(F.count("*") <= rows, F.lit(1 << 30)).otherwise(F.floor((1 << 30) * rows / F.count("*")))
    per = cut(labelled.groupBy("lang").agg(F.greatest(share, F.min("h") + 1).alias("share")))
    if per.limit(MOST_LABELS + 1).count() > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    sample = labelled.join(F.broadcast(per), "lang").filter(F.col("h") < F.col("share"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, 0):
            g, owner, _ = grams(texts)
            langs, code = np.unique(np.array(batch.column(1).to_pylist(), str), return_inverse=True)
            keys, n = np.unique(code[owner] * BUCKETS + g, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(langs[keys // BUCKETS].tolist(), pa.string()), pa.array(keys % BUCKETS, pa.int32()), pa.array(n, pa.int64())], names=["lang", "bucket", "n"])

    counted = sample.select("t", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = tuple(sorted(pc.unique(counted["lang"]).to_pylist()))
    sums = np.zeros((BUCKETS, len(languages)), np.float32)
    if languages:
        sums[counted["bucket"].to_numpy(), pc.index_in(counted["lang"], pa.array(languages, pa.string())).to_numpy()] = counted["n"].to_numpy()
    sums += np.float32(0.5)
    return Model(languages, np.log(sums / sums.sum(0, dtype=np.float64)).astype(np.float32) if languages else sums)


def likelihoods(records: DataFrame, model: Model) -> DataFrame:
    """records: keys..., t (bytes) -> keys..., letters, ll0, ll1, ... (damped log likelihoods)."""
    keys = [c for c in records.columns if c != "t"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in records.select(*keys).schema], "letters long", *[f"ll{k} double" for k in range(len(model.languages))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch, texts in slices(batches, len(keys)):
            g, owner, letters = grams(texts)
            ll = np.zeros((len(texts), len(model.languages)))
            n = np.bincount(owner, minlength=len(texts))
            some = np.flatnonzero(n)
            if len(some) and len(model.languages):
                ll[some] = np.add.reduceat(model.table[g], (np.cumsum(n) - n)[some], axis=0)
            ll *= np.minimum(1, FULL_GRAMS / np.maximum(n, 1))[:, None]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keys))], pa.array(letters), *[pa.array(ll[:, k]) for k in range(ll.shape[1])]], names=[*keys, "letters", *[f"ll{k}" for k in range(ll.shape[1])]])

    return records.select(*keys, "t").mapInArrow(run, schema)


def total_of(columns: list[str]) -> Column:
    """Their sum, as one flat expression however many there are."""
    return F.aggregate(F.array(*columns), F.lit(0.0), lambda a, x: a + x)


def normal(df: DataFrame, columns: list[Column], names: list[str]) -> DataFrame:
    """df with log values as probabilities, step by step, so that the plan grows in proportion to their number."""
    logs = [f"{n}_log" for n in names]
    df = df.withColumns(dict(zip(logs, columns)))
    df = df.withColumn("top", F.greatest(*logs) if len(logs) > 1 else F.col(logs[0]))
    df = df.withColumns({n: F.exp(F.col(c) - F.col("top")) for n, c in zip(names, logs)}).withColumn("total", total_of(names))
    return df.withColumns({n: F.col(n) / F.col("total") for n in names}).drop("top", "total", *logs)


def identify(records: DataFrame, model: Model, min_prob: float = MIN_PROB) -> DataFrame:
    """records: id, t (bytes), declared, suffix, domain, host -> id, lang, prob, text_lang, kept."""
    n = len(model.languages)
    if not n:
        return records.select("id", F.lit("und").alias("lang"), F.lit(0.0).alias("prob"), F.lit("und").alias("text_lang"), F.lit(False).alias("kept"))
    places = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("declared", "suffix", "domain", "host")]
    scored = cut(likelihoods(records.select("id", *places, "t"), model))
    ll, p = [f"ll{k}" for k in range(n)], [f"p{k}" for k in range(n)]
    with_p = normal(scored, [F.col(c) for c in ll], p).withColumns({c: F.when(F.col("letters") > 0, F.col(c)).otherwise(0.0) for c in p})
    sums = [F.sum(c).alias(c) for c in p]
    everywhere = with_p.agg(*sums).first()
    total = sum(v or 0.0 for v in everywhere)
    base = [math.log(((v or 0.0) + 1.0) / (total + n)) for v in everywhere]

    def level(by: str, above: str | None) -> DataFrame:
        """Log priors for each value of by, smoothed towards the value above (all records, for the top)."""
        table = with_p.groupBy(*[c for c in (by, above) if c]).agg(*sums)
        if above is None:
            lean = {c: F.lit(math.exp(b)) for c, b in zip(p, base)}
        else:
            table = table.groupBy(by).agg(*[F.sum(c).alias(c) for c in p], F.min(above).alias(above))
            table = table.join(levels[above].withColumnsRenamed({f"{above}_{c}": f"up_{c}" for c in p}), above)
            lean = {c: F.exp(f"up_{c}") for c in p}
        return table.withColumn("size", total_of(p)).select(by, *[F.log((F.col(c) + LEAN * lean[c]) / (F.col("size") + LEAN)).alias(f"{by}_{c}") for c in p])

    levels: dict[str, DataFrame] = {}
    for by, above in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        levels[by] = cut(level(by, above))

    def likelihood(by: str) -> DataFrame:
        """log P(value | language), with one more value for unseen ones."""
        table = with_p.groupBy(by).agg(*sums)
        return table.select(by, *[F.log((F.col(c) + SMOOTH / 10) / ((v or 0.0) + SMOOTH)).alias(f"{by}_l{k}") for k, (c, v) in enumerate(zip(p, everywhere))])

    fused = scored.join(levels["host"], "host").join(likelihood("declared"), "declared").join(likelihood("suffix"), "suffix")
    fused = normal(fused, [F.col(f"ll{k}") + F.col(f"host_p{k}") + F.col(f"declared_l{k}") + F.col(f"suffix_l{k}") for k in range(n)], p)
    best = F.array_max(F.array(*[F.struct(F.col(c).alias("prob"), F.lit(-k).alias("at")) for k, c in enumerate(p)]))
    text = F.array_max(F.array(*[F.struct(F.col(c).alias("ll"), F.lit(-k).alias("at")) for k, c in enumerate(ll)]))
    names = F.array(*[F.lit(x) for x in model.languages])
    out = fused.withColumn("b", best).withColumn("x", text)
    found = F.col("letters") > 0
    return out.select(
        "id",
        F.when(found, F.element_at(names, 1 - F.col("b.at"))).otherwise("und").alias("lang"),
        F.when(found, F.col("b.prob")).otherwise(0.0).alias("prob"),
        F.when(found, F.element_at(names, 1 - F.col("x.at"))).otherwise("und").alias("text_lang"),
        (found & (F.col("b.prob") >= min_prob)).alias("kept"),
    )


def of_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Records of documents: the lang column is the declared language, the source is the host."""
    return docs.select(
        F.col(f"`{key}`").alias("id"), F.encode(F.coalesce(f"`{text}`", F.lit("")), "UTF-8").alias("t"), F.lower(F.trim(f"`{lang}`")).alias("declared"),
        F.lit("").alias("suffix"), F.lit("").alias("domain"), F.col(f"`{source}`").alias("host"),
    )


def of_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Records of web pages: visible text, lang of the html tag; host, its last two labels, and as suffix the last label with
    a two-letter first path segment."""
    h, u = F.coalesce(F.col(f"`{html}`"), F.lit("")), F.lower(F.coalesce(F.col(f"`{url}`"), F.lit("")))
    # with an end of everything at the end, no opening looks past the first end that follows it, so the work is linear in the page
    ended = F.concat(h, F.lit(ENDS))
    visible = F.regexp_replace(F.regexp_replace(ended, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " "), rf"{ENDS}\z|<[^>]*>|&#?[A-Za-z0-9]+;", " ")
    host = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://([^/:?#]*)", 1)
    path = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1)
    return pages.select(
        F.col(f"`{key}`").alias("id"), F.encode(visible, "UTF-8").alias("t"), F.lower(F.regexp_extract(h, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)).alias("declared"),
        F.concat_ws("/", F.regexp_extract(host, r"([^.]*)$", 1), path).alias("suffix"), F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1).alias("domain"), host.alias("host"),
    )
