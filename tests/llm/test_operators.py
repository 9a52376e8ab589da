"""Every operator against brute force on a small table of hard cases: nulls, empty and long texts, ties, repeated rows,
columns with clashing names; and on an empty table."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from charlspark.llm import bpe_trie, components, iblt, jaccard_join, langid, line_dedup, mixing, pii, sstable, suffix_dedup, topk
from charlspark.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n int, __id string"
WORD = r"[^\x20\x09-\x0D]+"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("aeionstr"), rng.integers(2, 8))) for _ in range(n))


def texts():
    base, passage = prose(1, 120), prose(2, 60)
    near = base.split()
    near[60] = "changed"
    lines = "\n".join(prose(s, 9) for s in range(10, 18))
    return {
        1: base, 2: " ".join(near), 3: base, 4: prose(3, 80) + " " + passage, 5: passage + " " + prose(4, 90),
        6: "", 7: None, 8: "one two three", 9: "One  two\tthree", 10: "x" * 120_000, 11: "ab " * 20_000,
        12: lines, 13: prose(5, 5) + "\n" + lines + "\n" + prose(6, 5), 14: "Ünïcödé ÀÉ 日本語 \U0001f600 <|endoftext|> a   b \x1c c",
        15: "mail a.b@c.de.f_g@h.ij, ip 1.2.3.4.5 and 300.1.1.1, card 4111 1111 1111 1111, call +49 (30) 123-4567; iban DE89370400440532013000",
        16: "tel 030 1234567 " + "7" * 3000 + " 1.1.1.1", 17: "\n\n \n", 18: prose(7, 40) + "\n" + prose(8, 40),
    }


@pytest.fixture(scope="module")
def docs(spark):
    ship(spark)
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", "b", None][i % 4], len(t or ""), i, 0, "x") for i, t in texts().items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows and a row without id."""
    ship(spark)
    return spark.createDataFrame([(1, "a b c d e f", "en", "s", 1, 1, 1, ""), (1, "a b c d e f", "en", "s", 1, 1, 1, ""), (None, None, None, None, None, None, None, None)], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def sha(b):
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def test_bpe(docs, empty, odd):
    spec = bpe_trie.read_spec()
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = by_id(bpe_trie.encode_decode(docs, ["ids", "n_tokens", "ids_sha256", "decoded_sha256"], spec))
    for i, t in texts().items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].ids_sha256 == sha(",".join(map(str, ids)))
        assert got[i].decoded_sha256 == sha(lib.decode(ids, skip_special_tokens=False))
    assert bpe_trie.encode_decode(empty, ["n_tokens"], spec).count() == 0
    assert bpe_trie.encode_decode(odd, ["n_tokens"], spec).count() == 3


def test_id_tables(docs, empty, odd, spark):
    spec = sstable.read_spec()
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation(), lib.no_padding()
    shards = sstable.write_shards(docs, spec)
    got, start, paths = by_id(sstable.read_shards(spark, shards)), 0, [r.path for r in shards.collect()]
    for i, t in sorted(texts().items()):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        found = [x for path in paths for x in sstable.Shard(path).lookup(i)]
        assert [x.tolist() for x in found] == [ids]
    assert not any(sstable.Shard(path).lookup(99) for path in paths)
    assert sstable.read_shards(spark, sstable.write_shards(empty, spec)).count() == 0
    assert [r.doc_id for r in sstable.read_shards(spark, sstable.write_shards(odd, spec)).orderBy("start").collect()] == [None, 1, 1]


def test_suffix_dedup(docs, empty, odd):
    got, seen = by_id(suffix_dedup.dedup(docs)), set()
    for i, t in sorted(texts().items()):
        b = (t or "").encode()
        own = [b[k : k + 50] for k in range(len(b) - 49)]
        gone = np.zeros(len(b) + 2, int)
        for k, w in enumerate(own):
            if w in seen:
                gone[k + 1 : k + 51] = 1
        seen.update(own)
        kept = bytes(c for c, g in zip(b, gone[1:]) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (len(b), gone.sum(), (np.diff(gone) == 1).sum(), kept)
    assert suffix_dedup.dedup(empty).count() == 0 and suffix_dedup.dedup(odd).count() == 3


def shingles(t, width):
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(sets, percent):
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard_join(docs, width, percent):
    sets = {i: shingles(t, width) for i, t in texts().items()}
    got, want = by_id(jaccard_join.join(docs, width, percent)), brute_components(sets, percent)
    assert {i: r.component_id for i, r in got.items()} == want and {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


def test_jaccard_join_on_many_near_copies(spark, empty, odd):
    """Families around the threshold, with a passage that all share."""
    rng, rows = np.random.default_rng(5), []
    shared = prose(99, 25)
    for family in range(6):
        words = prose(200 + family, 70).split()
        for _ in range(25):
            own = list(words)
            for at in rng.choice(70, rng.integers(0, 5), replace=False):
                own[at] = f"w{rng.integers(1000)}"
            rows.append((len(rows), " ".join(own) + " " + shared))
    sets = {i: shingles(t, 4) for i, t in rows}
    got = by_id(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r.component_id for i, r in got.items()} == brute_components(sets, 85)
    assert jaccard_join.join(empty).count() == 0 and [r.component_id for r in jaccard_join.join(odd).collect()] == [1, 1]


def test_jaccard_join_of_one_large_family(spark):
    """2,000 near copies of one text, some only linked through others, beside a text that reaches the family by few links."""
    rng, base, rows = np.random.default_rng(8), prose(400, 150).split(), []
    for i in range(2000):
        own = list(base)
        for at in rng.choice(150, rng.integers(0, 4), replace=False):
            own[at] = f"w{rng.integers(10_000)}"
        rows.append((10_000 - i, " ".join(own)))
    rows += [(20_000 + k, " ".join(base[: 150 - 5 * k] + prose(500 + k, 5 * k).split())) for k in range(8)]
    sets = {i: shingles(t, 4) for i, t in rows}
    got = by_id(jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)))
    assert {i: r.component_id for i, r in got.items()} == brute_components(sets, 85)


def test_jaccard_join_of_ids_with_several_texts(spark):
    """An id that stands for two texts joins what either links with."""
    a, b, c = (prose(s, 80).split() for s in (601, 602, 603))
    near = lambda w: " ".join([*w[:40], "x", *w[41:]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(c)), (0, " ".join(c)), (4, ""), (5, " ".join(c)), (5, "lone text of its own"), (6, None), (6, None)]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 77): 1, (2, 77): 1, (3, 77): 1, (4, 77): 0, (4, 0): 0, (0, 77): 0, (5, 77): 0, (5, 2): 0, (6, 0): 6}


def test_components(spark):
    long = [(i, i + 1) for i in range(80)]
    assert {r.component for r in components.components(spark.createDataFrame(long, "a long, b long")).collect()} == {0}
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_iblt(docs, empty, odd, spark):
    got, t = by_id(iblt.fingerprints(docs)), {i: x or "" for i, x in texts().items()}
    ids = sorted(t, reverse=True)
    pieces = lambda x: {p.strip(" ") for p in re.findall(rf"[^\n]{{1,{iblt.PIECE}}}", x)}
    for i, j in zip(ids, ids[1:] + ids[:1]):
        third = len(t[i]) // 3
        edited = t[i][: len(t[i]) - third] + t[j][:third]
        assert got[i].n_chars == len(t[i]) and got[i].edited_sha256 == sha(edited)
        for other, near in ((edited, got[i].near_edited), (t[j], got[i].near_next)):
            a, b = pieces(t[i]), pieces(other)
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert got[1].fingerprint == got[3].fingerprint != got[2].fingerprint
    assert iblt.fingerprints(empty).count() == 0 and iblt.fingerprints(odd).count() == 2


def test_iblt_resynchronises_at_sentences(spark):
    """A short line keeps the likeness of its unchanged sentences; a word inserted at the start of a long line changes one."""
    sentence = lambda k: prose(700 + k, 6) + "."
    long = " ".join(map(sentence, range(40)))
    rows = [(3, " ".join(map(sentence, range(50, 54)))), (2, long), (1, "word " + long)]
    got = by_id(iblt.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[3].near_edited > 0.3 and got[2].near_next == pytest.approx(39 / 41)


def test_line_dedup(docs, empty, odd):
    out = by_id(line_dedup.dedup(docs))
    assert out[12].n_removed == 0 and out[13].n_removed >= 2 and all(out[i].text == t for i, t in texts().items() if i != 13)
    kept = out[13].text.split("\n")
    assert len(kept) == 10 - out[13].n_removed and kept[0] == prose(5, 5) and kept[-1] == prose(6, 5) and out[13].n_lines == 10
    assert line_dedup.dedup(empty).count() == 0 and line_dedup.dedup(odd).count() == 3


def test_line_dedup_of_short_passages(spark):
    """Passages of two to six lines between differing neighbours, also over blank lines, go whole from all documents but the first."""
    rows, want = [], {}
    for n in (2, 3, 4, 6):
        for gap in ("\n", "\n\n"):
            passage = gap.join(prose(1000 * n + 100 * len(gap) + k, 6) for k in range(n))
            for _ in range(4):
                i = len(rows)
                before, after = ("\n".join(prose(50_000 + 10 * i + k, 6) for k in (s, s + 1)) for s in (0, 2))
                rows.append((i, f"{before}\n{passage}\n{after}"))
                want[i] = rows[i][1] if i % 4 == 0 else f"{before}\n{after}"
    out = by_id(line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: r.text for i, r in out.items()} == want
    assert all(r.n_removed == rows[i][1].count("\n") - want[i].count("\n") for i, r in out.items())


def base_spans(t):
    def luhn(x):
        return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(x)))) % 10 == 0

    num = lambda m: re.sub("[^0-9]", "", m)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(num(m)) <= 19 and luhn(num(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(num(m)) <= 15),
    }
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if ok(m.group())] for k, (p, ok) in kinds.items()}


def test_pii(docs, empty, odd):
    got = by_id(pii.digest(docs))
    for i, t in texts().items():
        want = base_spans(t or "")
        assert [got[i][f"n_{k}"] for k in want] == [len(v) for v in want.values()]
        assert got[i].base_sha256 == sha(",".join(x for v in want.values() for x in v))
        assert set(x for v in want.values() for x in v) <= set(got[i].spans.split(","))
    assert "iban:" in got[15].spans and "local_phone:" in got[16].spans
    assert pii.digest(empty).count() == 0 and pii.digest(odd).count() == 3


def test_mixing(docs, empty, odd, spark):
    many = spark.createDataFrame([(i, prose(i, 3 + i % 40), ["a", "b", "c", None][i % 7 % 4]) for i in range(3000)], "doc_id long, text string, source string")
    rows = mixing.mix(mixing.sizes(many)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(mixing.sizes(many.repartition(5))).collect()))
    size = Counter()
    for r in rows:
        size[r.source] += r.size
    names, total = sorted(size, key=lambda s: (s is None, s)), sum(size.values())
    weight, capped = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, set()
    while True:
        left = total - sum(3 * size[s] for s in capped)
        goal = {s: 3 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names}
        over = {s for s in names if goal[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        capped |= over
    for s in names:
        own = [r for r in rows if r.source == s]
        assert own[0].target == pytest.approx(goal[s]) and abs(sum(r.copies * r.size for r in own) - goal[s]) <= 20
        assert all(0 <= r.copies <= 3 for r in own)
    small = mixing.mix(mixing.sizes(docs)).collect()
    assert {r.doc_id: r.size for r in small} == {i: len(re.findall(WORD, t or "")) for i, t in texts().items()}
    assert mixing.mix(mixing.sizes(empty)).count() == 0 and mixing.mix(mixing.sizes(odd)).count() == 3


def test_mixing_lands_beside_a_large_source(spark):
    """A very long document leaves no rest in a source of 400 rows, nor in one of 2,000, whatever the others hold."""
    rng, rows = np.random.default_rng(4), []
    for source, n, longest in (("a", 400, 20_000), ("b", 400, 20_000), ("c", 400, 100_000), ("d", 2000, 100_000), ("e", 3000, 700), ("f", 400, 20_000)):
        rows += [(len(rows) + k, source, int(s)) for k, s in enumerate([*rng.integers(50, 701, n), longest])]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    for s in "abcdef":
        own = [r for r in out if r.source == s]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 50, s


def test_cube_keeps_sums():
    rng = np.random.default_rng(1)
    size, pi = rng.integers(1, 500, 400).tolist(), [0.3] * 400
    out = mixing.flight(pi, size, rng)
    assert sum(0 < p < 1 for p in out) <= 2
    assert sum(out) == pytest.approx(120) and np.dot(out, size) == pytest.approx(0.3 * sum(size))


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(300)] + [(300, None), (301, [float("nan")] * 8), (302, [None] * 8), (303, [1.0] * 3), (None, [1.0] * 8)]
    vectors = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = topk.top_k(vectors, vectors.filter(F.col("id") % 20 == 0), 7).collect()
    v = {i: np.floor(64 * np.array([*e, *[0.0] * (8 - len(e))])).astype(int) for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in v:
        if q % 20 == 0:
            best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:7]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    none = vectors.limit(0)
    assert topk.top_k(none, none).count() == 0


def test_language(spark, empty, odd):
    letters = {"en": "the and of with that ", "de": "der die und nicht mit "}
    rng, rows = np.random.default_rng(3), []
    for i in range(200):
        lang = ["en", "de"][i % 2]
        rows.append((i, " ".join(rng.choice(letters[lang].split(), 30)), lang, f"host{i % 5}"))
    train = spark.createDataFrame(rows[:120], "doc_id long, text string, lang string, source string")
    held = spark.createDataFrame([(i, t, None, s) for i, t, _, s in rows[120:]] + [(900, None, "en", "h"), (901, "12 34 !", None, None)], train.schema)
    got = by_id(langid.identify(langid.of_documents(held), langid.train(train)), "id")
    assert all(got[i].lang == lang and got[i].kept for i, _, lang, _ in rows[120:])
    assert got[900].lang == got[901].lang == "und" and not got[900].kept
    assert langid.identify(langid.of_documents(empty), langid.train(train)).count() == 0
    assert langid.identify(langid.of_documents(held), langid.train(empty)).filter("kept").count() == 0
    pages = spark.createDataFrame([(1, "https://a.example.de/de/x", "<html lang='de'><script>the</script><p>der die und</p>"), (2, None, None)], "page_id long, url string, html string")
    assert [r.lang for r in langid.identify(langid.of_pages(pages), langid.train(train)).orderBy("id").collect()] == ["de", "und"]


def test_language_of_rare_and_many_labels(spark):
    """A label with 3 of some 13,000 rows has its model, and so has each of 70 labels."""

    def words(lang):
        rng = np.random.default_rng(1000 + lang)
        return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(25)]

    def rows(counts):
        rng, of = np.random.default_rng(6), {k: words(k) for k in counts}
        return [(f"l{k:02}", " ".join(rng.choice(of[k], 40))) for k, n in counts.items() for _ in range(n)]

    for counts in ({0: 6500, 1: 6500, 2: 3}, {k: 4 for k in range(70)}):
        data = [(i, t, lang, "h") for i, (lang, t) in enumerate(rows(counts))]
        train = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
        model = langid.train(train)
        assert model.languages == tuple(f"l{k:02}" for k in counts)
        held = train.filter("doc_id % 100 = 0 OR doc_id >= 13000") if 2 in counts and counts[2] == 3 else train
        out = langid.identify(langid.of_documents(held), model).collect()
        assert all(r.lang == data[r.id][2] and r.kept for r in out)


def test_pipeline(spark, tmp_path):
    """Each stage against what it must do with its own input."""
    rows = [(i, t, "en", "a", len(t)) for i, t in texts().items() if t and i not in (10, 11)] + [(50, "", "en", "a", 0)]
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    held = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, out = by_id(held), stage(spark, held, path)
        after = by_id(out)
        assert set(after) <= set(before)
        if name == "language":
            assert set(before) - set(after) == {17, 50}  # nothing to read in them
        elif name == "lines":
            assert set(after) == set(before) and 0 < len(after[13].text) < len(before[13].text)
        elif name == "near_duplicates":
            groups = brute_components({i: shingles(r.text, 5) for i, r in before.items()}, 80)
            assert set(after) == set(groups.values())
        elif name == "encode":
            lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            assert all(r.ids == lib.encode(before[i].text, add_special_tokens=False).ids for i, r in after.items())
        held = corpus_pipeline.cut(out)
    assert corpus_pipeline.run(spark, path).count() == held.count()


def test_iblt_of_many_lines_and_an_outlying_id(spark):
    """20,000 distinct lines against edited ones; 4,000 near ids beside one far away; many rows of one id."""
    lines = [f"line {k} of many" for k in range(20_000)]
    rows = [(i, f"text {i}") for i in range(4000)] + [(10**15, "\n".join(lines)), (10**15 + 1, "\n".join([*lines[:19_000], *[f"new {k}" for k in range(3000)]]))] + [(5000, f"same {k}") for k in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ranged, names = iblt.ranges(docs.withColumnRenamed("doc_id", "id").withColumn("h", F.xxhash64("text")), 0, 10**15 + 1, len(rows))
    assert ranged.groupBy(*names).count().agg(F.max("count")).first()[0] <= 8 * iblt.RANGE
    got = by_id(iblt.fingerprints(docs).filter("doc_id <> 5000"))
    assert got[10**15 + 1].near_next == pytest.approx(19_000 / 23_000) and len(got) == 4002
    assert got[7].edited_sha256 == sha("text" + "te")


def test_pii_of_many_matches(spark):
    text = " ".join(f"mail a{k}@b.org or 10.0.{k % 300}.1" for k in range(20_000))
    want = base_spans(text)
    got = pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_email == 20_000 and got.n_ip == len(want["ip"]) and got.base_sha256 == sha(",".join(x for v in want.values() for x in v))


def test_suffix_dedup_of_a_hot_passage(spark):
    """A passage in every document, at shifting places, and documents that repeat themselves."""
    passage = prose(70, 30)
    rows = [(i, prose(3000 + i, 4) + " " + passage * (1 + i % 3) + " " + prose(4000 + i, i % 9)) for i in range(120)]
    got, seen = by_id(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))), set()
    for i, t in rows:
        own, gone = [t[k : k + 50] for k in range(len(t) - 49)], np.zeros(len(t), bool)
        for k, w in enumerate(own):
            gone[k : k + 50] |= w in seen
        seen.update(own)
        assert got[i].n_removed == gone.sum(), i
