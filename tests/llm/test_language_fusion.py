"""Operator 1 against a plain version of its formulas, and on hard tables."""

import time

import numpy as np
import pytest

from charlspark.llm import langid
from charlspark.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string"
WORDS = {"en": "the and of with that have from this", "de": "der die und nicht mit auch sich eine", "fr": "les des une dans pour que avec sur"}


def soft(v):
    e = np.exp(v - v.max())
    return e / e.sum()


def brute(records, model):
    """records: id, text, declared, suffix, domain, host -> id: lang, prob, text_lang, kept."""
    n, rows = len(model.languages), []
    for i, t, *places in records:
        g, _, letters = langid.grams([(t or "").encode()])
        ll = model.table[g].astype(float).sum(0) * min(1, langid.FULL_GRAMS / max(len(g), 1)) if len(g) else np.zeros(n)
        rows.append((i, int(letters[0]) > 0, ll, [p or "" for p in places]))
    post = [soft(ll) if some else np.zeros(n) for _, some, ll, _ in rows]
    every = sum(post)
    lean = {"": (every + 1) / (every.sum() + n)}
    above = {}
    for level, up in ((1, None), (2, 1), (3, 2)):
        sums, ups = {}, {}
        for (_, _, _, places), p in zip(rows, post):
            sums[places[level]] = sums.get(places[level], 0) + p
            ups[places[level]] = min(ups.get(places[level], places[up] if up else ""), places[up] if up else "")
        above[level] = {v: (s + langid.LEAN * (above[up][ups[v]] if up else lean[""])) / (s.sum() + langid.LEAN) for v, s in sums.items()}

    def given(at):
        sums = {}
        for (_, _, _, places), p in zip(rows, post):
            sums[places[at]] = sums.get(places[at], 0) + p
        return {v: np.log((s + langid.SMOOTH / 10) / (every + langid.SMOOTH)) for v, s in sums.items()}

    declared, suffix, out = given(0), given(1), {}
    for i, some, ll, places in rows:
        p = soft(ll + np.log(above[3][places[3]]) + declared[places[0]] + suffix[places[1]])
        best = int(np.argmax(p))
        out[i] = (model.languages[best], p[best], model.languages[int(np.argmax(ll))], bool(p[best] >= langid.MIN_PROB)) if some else ("und", 0.0, "und", False)
    return out


def sentences(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang].split(), n))


def test_formulas(spark):
    ship(spark)
    rng = np.random.default_rng(8)
    langs = list(WORDS)
    train = spark.createDataFrame([(i, sentences(rng, langs[i % 3], 12), langs[i % 3], "x") for i in range(90)], SCHEMA)
    model = langid.train(train)
    rows = [(i, sentences(rng, langs[i % 3], int(rng.integers(0, 5))) + " of les der"[: i % 12], [langs[i % 3], langs[(i + 1) % 3], None][i % 7 % 3], f"h{i % 9 % 4}") for i in range(120)]
    rows += [(500, "", "en", "h0"), (501, None, None, None), (502, "12 !", "fr", "h1"), (503, "the and " * 5000, "de", "h9")]
    got = {r.id: r for r in langid.identify(langid.of_documents(spark.createDataFrame(rows, SCHEMA)), model).collect()}
    want = brute([(i, t, d, "", "", h) for i, t, d, h in rows], model)
    assert set(got) == set(want)
    for i, (lang, prob, text, kept) in want.items():
        assert (got[i].lang, got[i].text_lang, got[i].kept) == (lang, text, kept) and got[i].prob == pytest.approx(prob, abs=1e-6), i
    urls = [(k, f"https://{['a', 'b', 'c'][k % 3]}.site{k % 4}.{['de', 'org'][k % 2]}/{['de', 'fr', 'about'][k % 3]}/p", f"<html lang=\"{langs[k % 3]}\"><body>{sentences(rng, langs[k % 5 % 3], 6)}</body></html>") for k in range(60)]
    pages = spark.createDataFrame([*urls, (90, "not a url", "<p>der die"), (91, None, None)], "page_id long, url string, html string")
    records = [(r.id, bytes(r.t).decode(), r.declared, r.suffix, r.domain, r.host) for r in langid.of_pages(pages).collect()]
    got = {r.id: r for r in langid.identify(langid.of_pages(pages), model).collect()}
    for i, (lang, prob, text, kept) in brute(records, model).items():
        assert (got[i].lang, got[i].text_lang, got[i].kept) == (lang, text, kept) and got[i].prob == pytest.approx(prob, abs=1e-6), i
    assert langid.identify(langid.of_pages(pages.limit(0)), model).count() == 0
    clash = pages.selectExpr("page_id", "url", "html", "'x' AS id", "'y' AS t", "0 AS letters", "1 AS p0", "2 AS ll0")
    assert langid.identify(langid.of_pages(clash), model).count() == 62


def test_labels_of_null_and_repeated_ids(spark):
    rng = np.random.default_rng(9)
    rows = [(None, sentences(rng, "de", 9), "de", "s") for _ in range(1500)] + [(5, sentences(rng, "fr", 9), "fr", "s") for _ in range(1500)]
    rows += [(i, sentences(rng, "en", 9), "en", "s") for i in range(300)] + [(7, "una misma frase repetida", "es", "s")] * 1200
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    assert model.languages == ("de", "en", "es", "fr")
    with pytest.raises(ValueError, match="labels"):
        langid.train(spark.createDataFrame([(i, "abc def", f"l{i}", "s") for i in range(langid.MOST_LABELS + 1)], SCHEMA))


def test_wrong_declared_languages(spark):
    """A third of the declarations are wrong; the text outweighs them, and they do not pull right ones along."""
    rng = np.random.default_rng(10)
    langs = list(WORDS)
    truth = [langs[i % 3] for i in range(600)]
    said = [langs[(i + 1) % 3] if i % 9 < 3 else t for i, t in enumerate(truth)]
    rows = [(i, sentences(rng, t, 15), d, f"h{i % 3}") for i, (t, d) in enumerate(zip(truth, said))]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.lang for r in langid.identify(langid.of_documents(table), langid.train(spark.createDataFrame([(i, t, truth[i], h) for i, t, _, h in rows[:150]], SCHEMA))).collect()}
    assert np.mean([got[i] == t for i, t in enumerate(truth)]) >= 0.99
    own = {r.id: r.lang for r in langid.identify(langid.of_documents(table), langid.train(table)).collect()}  # trained on wrong labels, too
    assert np.mean([own[i] == t for i, t in enumerate(truth)]) >= 0.9


def test_pages_are_cleaned_in_linear_time(spark):
    hard = ["<script " * 60_000 + "der", "<!-- " * 80_000, "<style>a" * 50_000, "< a " * 80_000, "<p>der</p><script>the and"]
    pages = spark.createDataFrame([(i, None, h) for i, h in enumerate(hard)] + [(9, None, "<p>der <!-- the --> und</p>")], "page_id long, url string, html string")
    began = time.time()
    seen = {r.id: bytes(r.t).decode().split() for r in langid.of_pages(pages).collect()}
    assert time.time() - began < 30
    assert seen[4] == ["der"] and seen[9] == ["der", "und"] and seen[1] == []
