"""Registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from charlspark.llm import bpe_trie, iblt, importance, jaccard_join, langid, lexical, line_dedup, mixing, pii, secret_scan, sstable, suffix_dedup, topk
from charlspark.llm.common import ship, table


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over documents and pages, with one text model; of doc_id and page_id one is null."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    of_docs = langid.identify(langid.of_documents(docs), model)
    of_pages = langid.identify(langid.of_pages(table(spark, sf_dir, "pages")), model)
    none = F.lit(None).cast("long")
    rest = ["lang", F.round("prob", 6).alias("prob"), "text_lang", "kept"]
    return of_docs.select(F.col("id").alias("doc_id"), none.alias("page_id"), *rest).unionByName(of_pages.select(none.alias("doc_id"), F.col("id").alias("page_id"), *rest))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), with_text=False)


def op3_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe_trie.encode_decode(table(spark, sf_dir, "documents"), ["n_tokens", "ids_sha256", "decoded_sha256"], bpe_trie.read_spec(), keep=["doc_id"])


def op4_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    vectors = topk.integers(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("id") % 20 == 0))


def op5_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op6_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op9_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    mixed = mixing.mix(mixing.sizes(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_id_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return sstable.read_shards(spark, sstable.write_shards(table(spark, sf_dir, "documents"), sstable.read_spec()))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op12_stratum_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    ranked = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict:
    return {
        "op1_language": op1_language,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_bpe_trie": op3_bpe_trie,
        "op4_block_topk": op4_block_topk,
        "op5_group_join": op5_group_join,
        "op6_iblt": op6_iblt,
        "op7_line_chunks": line_dedup.op7,
        "op8_pii": op8_pii,
        "op9_cube_mix": op9_cube_mix,
        "op10_id_tables": op10_id_tables,
        "op11_secret_scan": op11_secret_scan,
        "op12_stratum_search": op12_stratum_search,
        "op13_importance": op13_importance,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_block_topk": OP4_SQL, "op5_group_join": OP5_SQL, "op7_line_chunks": OP7_SQL, "op12_stratum_search": OP12_SQL, "op13_importance": OP13_SQL}


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""

OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')))) END AS s
  FROM d
), c AS (
  SELECT min(doc_id) AS class_id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s
), t AS (
  SELECT class_id, n, unnest(s) AS token FROM c
), e AS (
  SELECT x.class_id AS a, y.class_id AS b FROM t x JOIN t y ON x.token = y.token AND x.class_id <> y.class_id
  GROUP BY x.class_id, y.class_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), r AS (
  SELECT class_id AS id, class_id AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id
), k AS (
  SELECT id, min(root) AS component FROM r GROUP BY id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.component, s.doc_id) AS component_id, coalesce(c.class_id, s.doc_id) AS class_id
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN k ON k.id = c.class_id
"""

OP7_SQL = """
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), f AS (
  SELECT doc_id, ls, list_filter(range(1, len(ls) + 1), lambda i: trim(ls[i], chr(32) || chr(9) || chr(13)) <> '') AS f FROM l WHERE doc_id IS NOT NULL AND text IS NOT NULL
), w AS (
  SELECT doc_id, f[k] AS a, f[k + 1] AS b, array_to_string(ls[f[k]:f[k + 1]], chr(10)) AS t FROM (SELECT *, unnest(range(1, len(f))) AS k FROM f)
), x AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, a) AS place FROM w
), g AS (
  SELECT doc_id, list_distinct(flatten(list(range(a, b + 1)))) AS g FROM x WHERE place > 1 GROUP BY doc_id
)
SELECT l.doc_id, CASE WHEN text <> '' THEN len(ls) ELSE 0 END::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(coalesce(CASE WHEN g IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(g, i)), lambda i: ls[i]), chr(10)) END, '')) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id
"""

OP12_SQL = r"""
WITH lowered AS (
  SELECT 0 AS kind, doc_id AS id, row_number() OVER () AS row, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 1, item_id, row_number() OVER (), translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark WHERE item_id IS NOT NULL
), w AS (
  SELECT kind, id, row, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered WHERE t IS NOT NULL
), tf AS (
  SELECT kind, id, row, term, count(*) AS tf FROM w GROUP BY ALL
), d AS (
  SELECT row, sum(tf)::BIGINT AS n FROM tf WHERE kind = 0 GROUP BY row
), g AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d
), m AS (
  SELECT row, 25 + (75 * n * n_docs) // n_terms AS m FROM d, g
), i AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, g WHERE kind = 0 GROUP BY term, n_docs
), s AS (
  SELECT a.id AS item_id, a.row AS item, b.id AS doc_id, sum(a.tf * w * ((1000000000 * b.tf) // (1000 * b.tf + 8 * m)))::BIGINT AS score
  FROM tf a JOIN tf b ON a.term = b.term AND a.kind = 1 AND b.kind = 0 JOIN i ON i.term = a.term JOIN m ON m.row = b.row
  WHERE b.id IS NOT NULL GROUP BY a.id, a.row, b.id, b.row
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
) WHERE rank <= 10
"""

OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range AS i, 0 AS k, range::UBIGINT AS c FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM bits WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS c FROM bits WHERE k = 8
), lowered AS (
  SELECT 0 AS kind, row_number() OVER () AS row, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 1, NULL, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), w AS (
  SELECT kind, row, term, count(*) AS tf FROM (
    SELECT kind, row, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM lowered WHERE t IS NOT NULL) GROUP BY ALL
), hexed AS (
  SELECT term, hex(term) AS h FROM (SELECT DISTINCT term FROM w)
), hashed AS (
  SELECT term, xor(4294967295::UBIGINT, list_reduce([4294967295::UBIGINT] || list_transform(range(1, length(h) // 2 + 1), lambda j: ('0x' || substr(h, CAST(2 * j - 1 AS INTEGER), 2))::UBIGINT),
    lambda a, b: xor(a // 256, c[CAST(xor(a % 256, b) AS BIGINT) + 1]))) % 10000 AS bucket FROM hexed, crc
), counts AS (
  SELECT bucket, coalesce(sum(tf) FILTER (kind = 0), 0)::DOUBLE AS s, coalesce(sum(tf) FILTER (kind = 1), 0)::DOUBLE AS t FROM w JOIN hashed USING (term) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts) + 10000) / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000))))::BIGINT AS g FROM counts
), sums AS (
  SELECT row, sum(tf)::BIGINT AS n, sum(tf * g)::BIGINT AS weight FROM w JOIN hashed USING (term) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY row
), x AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h
  FROM (SELECT doc_id, row_number() OVER () AS row FROM documents) LEFT JOIN sums USING (row)
), y AS (
  SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM x
), z AS (
  SELECT doc_id, n_features, weight, row_number() OVER (ORDER BY score DESC, doc_id, n_features, weight) AS rank FROM y WHERE n_features >= 20 AND doc_id IS NOT NULL
)
SELECT y.doc_id, y.n_features, y.weight, y.score, CASE WHEN rank <= 10 * (SELECT count(*) FROM z) // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (doc_id, n_features, weight)
"""
