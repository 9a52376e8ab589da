"""A pipeline from raw documents to token ids: language, repeated lines, near duplicates, mix, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet in the shared
folder before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from charlspark.llm import bpe_trie, jaccard_join, langid, line_dedup, mixing
from charlspark.llm.common import cut, ship, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Names of working columns, which no table is likely to have.
FOUND_ID, FOUND_LANG, FIRST_ID, PLACE = "__pipeline_id", "__pipeline_lang", "__pipeline_first_id", "__pipeline_place"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found with enough certainty stay, under the language found.

    Null, empty and letterless texts have no language and go, and so do rows without id; a null lang or source is evidence of its
    own kind. Rows that repeat an id are judged as one document, by the row judged with most certainty: all stay or all go. Very
    long texts count whole. Extra columns are dropped; an empty table gives an empty table."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    found = langid.identify(langid.of_documents(docs), langid.train(docs)).filter("kept").groupBy("id").agg(F.max_by("lang", "prob").alias(FOUND_LANG)).withColumnRenamed("id", FOUND_ID)
    joined = docs.join(found.hint("shuffle_hash"), docs["doc_id"] == F.col(FOUND_ID))
    return joined.select(*[F.col(FOUND_LANG).alias("lang") if c == "lang" else docs[c] for c in COLUMNS])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of passages that an earlier document (or an earlier place) has go; a document of which nothing is left goes.

    Null and empty texts stay as they are, and so do rows without id. Of equal passages that of the smallest id stays. Rows
    that repeat an id are cleaned one by one. Very long texts count whole. Extra columns are dropped; an empty table gives an empty
    table. n_chars becomes the length of what is left (null for a null text)."""
    clean = line_dedup.dedup(docs.select(*COLUMNS)).filter("n_removed = 0 OR length(text) > 0")
    return clean.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id: five words, similarity of 0.8 or more.

    Null, empty and wordless texts are groups of their own and stay; rows without id go. Rows that repeat an id are one document
    of several texts: they are grouped together, and one row stays, that with the smallest text (null before all others) and, of
    equal texts, the smallest other columns. Very long texts count whole. Extra columns, whatever their names, are
    dropped; an empty table gives an empty table."""
    ship(spark)
    docs = docs.select(*COLUMNS)
    first = jaccard_join.join(docs, width=5, percent=80).filter("doc_id = component_id").groupBy(F.col("doc_id").alias(FIRST_ID)).agg(F.count("*").alias("rows"))
    first = cut(first)
    kept = docs.join(first.filter("rows = 1").hint("shuffle_hash"), docs["doc_id"] == F.col(FIRST_ID), "left_semi")
    order = Window.partitionBy("doc_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("text", "lang", "source", "n_chars")])
    several = docs.join(first.filter("rows > 1"), docs["doc_id"] == F.col(FIRST_ID), "left_semi").withColumn(PLACE, F.row_number().over(order))
    return kept.unionByName(several.filter(F.col(PLACE) == 1).select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a document comes as often as it is taken.

    Null and empty texts have size 0, so they cost nothing and are drawn like any other; a null source is a source of its own.
    Rows that repeat an id share the largest number of copies drawn for one of them. Very long documents are drawn whole. Extra
    columns are dropped; an empty table gives an empty table."""
    ship(spark)
    return mixing.taken_texts(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and the hash of the decoded text of each row.

    A null text counts as empty and has no ids; rows without id and rows that repeat one are encoded one by one; very long texts are
    encoded whole; extra columns are dropped; an empty table gives an empty table."""
    ship(spark)
    return bpe_trie.encode_decode(docs, ["ids", "n_tokens", "decoded_sha256"], bpe_trie.read_spec(), keep=["doc_id", "lang", "source"])


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]

#: BPE has no SQL form; tests hold each stage, and run(), against a plain version (tests/llm/test_pipeline_stages.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
