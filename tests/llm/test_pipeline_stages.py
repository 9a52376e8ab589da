"""The pipeline's stages by content on one hard table (nulls, long texts, repeated ids, extra columns with working names), each held
against a plain version of what it must do with its input; run() against these stages; and empty tables."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_language_fusion import WORDS, brute as brute_language
from test_line_chunks import brute as brute_lines
from tokenizers import Tokenizer

import corpus_pipeline
from charlspark.llm import langid, mixing, queries
from charlspark.llm.common import cut, ship

COLUMNS = corpus_pipeline.COLUMNS
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, __mix_n string, __pipeline_id long, copies int, h string"


def hard_rows():
    rng = np.random.default_rng(12)
    langs = list(WORDS)
    line = lambda k: " ".join(rng.choice(WORDS[langs[k % 3]].split(), 8)) + f" {rng.integers(1 << 30)}"
    passage = [line(0) for _ in range(5)]
    base = "\n".join(line(0) for _ in range(30))
    rows = [(i, "\n".join(line(i) for _ in range(int(rng.integers(1, 9)))), langs[i % 3] if i % 5 else None, f"s{i % 4}" if i % 7 else None) for i in range(60)]
    rows += [(100 + i, "\n".join([line(0), *passage, line(0)]), "en", "s0") for i in range(4)]
    words = base.split(" ")
    for i in range(6):  # near copies of one long text, each changed in one place
        words_i = list(words)
        words_i[10 + 20 * i] = f"new{i}"
        rows.append((200 + i, " ".join(words_i).replace("\n", " "), "en", "s1"))
    rows += [(300, None, "en", "s0"), (301, "", "en", "s0"), (302, "12 34", "de", None), (None, base + " x", "en", "s0"), (None, None, None, None)]
    rows += [(303, " ".join(rng.choice(WORDS["de"].split(), 30_000)), "de", "s2"), (304, "the and " * 20_000, "en", "s3")]
    rows += [(5, "\n".join(line(0) for _ in range(4)), "en", "s1"), (5, "12", "en", "s1"), (6, rows[6][1], "de", "s2"), (6, rows[6][1], "de", "s2")]
    return [(i, t, d, s, len(t or ""), 7, "x", 8, 9, "y") for i, t, d, s in rows]


def listed(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def near(rows, width=5, percent=80):
    """Smallest id of each group; rows of one id are grouped together."""
    sets = []
    for i, t, *_ in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = {r[0]: r[0] for r in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(rows[a][0]), find(rows[b][0])))
                root[q] = p
    return {i: find(i) for i in root}


def test_stages(spark, tmp_path):
    ship(spark)
    path = str(tmp_path)
    spark.createDataFrame(hard_rows(), SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before, stages = listed(docs), dict(corpus_pipeline.STAGES)

    out = cut(stages["language"](spark, docs, path))
    judged = brute_language([(k, r[1], (r[2] or "").strip().lower() or None, "", "", r[3]) for k, r in enumerate(before)], langid.train(docs.select(*COLUMNS)))
    found = {}
    for k, (lang, prob, _, kept) in judged.items():
        i = before[k][0]
        if kept and i is not None:
            found[i] = max(found.get(i, (0, "")), (prob, lang))
    want = [(i, t, found[i][1], s, n) for i, t, _, s, n in before if i in found]
    assert Counter(listed(out)) == Counter(want) and {300, 301, 302}.isdisjoint(r[0] for r in want) and len(want) > 60

    odd = spark.createDataFrame([(300, None, "en", "s0", 0), (None, before[0][1], "en", "s0", 3)], out.schema)  # as if kept
    wide = lambda df: df.withColumns({c: F.lit(1) for c in ("id", "n_lines", "removed", "h", "__mix_n", "class_id")})
    held = cut(out.unionByName(odd))
    before, out = listed(held), cut(stages["lines"](spark, wide(held), path))
    single = [r for r in before if Counter(x[0] for x in before)[r[0]] == 1 and r[0] is not None]
    clean = brute_lines([(r[0], r[1]) for r in before])
    got = {r[0]: r for r in listed(out)}
    for i, t, lang, s, n in single:
        text, gone = clean[i]
        if i not in (5, 6):
            assert (i in got) == (gone == 0 or len(text) > 0) and (i not in got or got[i] == (i, text, lang, s, len(text) if text is not None else None))
    assert got[300] == (300, None, "en", "s0", None) and any(r[0] is None and r[1] == before[-1][1] or r[0] is None for r in listed(out))
    assert got[100][1].count("\n") == 6 and all(got[i][1].count("\n") == 1 for i in (101, 102, 103))

    before, out = listed(out), cut(stages["near_duplicates"](spark, wide(out), path))
    group = near([r for r in before if r[0] is not None])
    after = listed(out)
    assert sorted(r[0] for r in after) == sorted(set(group.values())) and set(after) <= set(before)
    assert 200 in group.values() and group[205] == 200
    for r in after:
        assert r[1:] == min(((x[1] is not None, x[1] or "", x[2:], x[1:]) for x in before if x[0] == r[0]), key=lambda x: x[:2])[3]

    before, out = after, cut(stages["mix"](spark, wide(out), path))
    copies = {r.doc_id: r.copies for r in mixing.mix(mixing.sizes(spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long"))).collect()}
    assert Counter(listed(out)) == Counter({r: copies[r[0]] for r in before if copies[r[0]]}) and max(copies.values()) <= 3

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    before, encoded = listed(out), stages["encode"](spark, wide(out), path).collect()
    want = []
    for i, t, lang, s, _ in before:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, lang, s, tuple(ids), len(ids), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    rows = lambda x: Counter((r.doc_id, r.lang, r.source, tuple(r.ids), r.n_tokens, r.decoded_sha256) for r in x)
    assert rows(encoded) == Counter(want)

    held = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = cut(stage(spark, held, path))
    assert rows(corpus_pipeline.run(spark, path).collect()) == rows(stages["encode"](spark, held, path).collect())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, name):
    ship(spark)
    empty = spark.createDataFrame([], SCHEMA)
    out = dict(corpus_pipeline.STAGES)[name](spark, empty, "")
    assert out.count() == 0 and (name == "encode" or out.columns == COLUMNS)


def test_registered_wrappers():
    """Each operator has one query, SQL only for registered ones; the driver compares rows with SQL, the other tests with brute force."""
    own, sql = queries.queries(), queries.oracle_sql()
    assert sorted(int(n[2:].split("_")[0]) for n in own) == list(range(1, 14)) and set(sql) <= set(own)
