"""Each operator against a brute-force version, exact round trips, and odd inputs."""

import hashlib
import zlib

import numpy as np
import pytest

from chronoframe.llm import base, decontam, fingerprint, html, jaccard, language, lines, packing, pitman_yor, tokens, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
ODD = [(None, "a b c d e f", "en", "s", 1, 0.0), (1, None, None, None, None, None), (2, "", "en", "s", 0, 1.0), (3, "word " * 30_000, "en", "s", 5, 1.0), (4, "same line here\nother words to read", "en", "s", 1, 1.0), (4, "same line here\nother words to read", "en", "s", 1, 1.0)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_solver_is_optimal_and_whole():
    rng = np.random.default_rng(3)
    for n in (1, 7, 40, 400):
        sizes = rng.integers(1, 100, n).tolist()
        plan = packing.solve({s: sizes.count(s) for s in sizes}, 100)
        assert sorted(s for items, k in plan for s in list(items) * k) == sorted(sizes)
        assert all(sum(items) <= 100 for items, _ in plan)
        assert sum(k for _, k in plan) <= packing.lower_bound({s: sizes.count(s) for s in sizes}, 100) + 1


def test_packing(spark, odd, empty):
    r = packing.pack(odd, path()).toPandas()
    assert len(r[r.doc_id == 3]) == 8 and r[r.doc_id == 1].length.tolist() == [1]
    for _, g in r.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert packing.pack(empty, path()).count() == 0


def test_word_ids_are_the_tokenizers():
    ids = packing.WordIds(path())
    for t in ("Hello, World's  end\n\tnow", "café ÀÉ é İstanbul 12ab ...!?", "a\x1cb", "<|endoftext|> x", ""):
        assert np.frombuffer(ids(t), "<u4").tolist() == ids.tok.encode(t, add_special_tokens=False).ids


def test_toxicity_shares_ngrams(spark, odd, empty):
    rng = np.random.default_rng(1)
    clean = [" ".join(rng.choice(["river", "stone", "walks", "green", "paper"], 30)) for _ in range(60)]
    bad = [t + " stupid idiot" for t in clean[:30]]
    m = toxicity.fit(clean + bad, [0] * 60 + [1] * 30, steps=150)
    found = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, "river stupidd stone"), (2, "green paper walks")], "doc_id long, text string"), m).collect()}
    assert found[1] > 0.3 > found[2]
    assert toxicity.score(odd, m).count() == len(ODD) and toxicity.score(empty, m).count() == 0
    assert toxicity.fit([], []).bias == -60


def test_language(spark, odd, empty):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.train(docs)
    test = spark.createDataFrame([(1, "the dogs"), (2, "die hunde"), (3, "123 !!"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language.predict(test, m).collect()} == {1: "en", 2: "de", 3: "und", 4: "und"}
    assert language.predict(odd, m).count() == len(ODD) and language.predict(odd, language.train(empty)).first().lang_pred == "und"


def test_decontamination(spark, odd, empty):
    words = [f"w{i}" for i in range(60)]
    item = " ".join(words[10:40])
    changed = " ".join("zz" if i in (15, 22, 30) else w for i, w in enumerate(words))
    docs = spark.createDataFrame([(1, changed), (2, " ".join(reversed(words))), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (10, "too short"), (11, None)], "item_id long, text string")
    r = decontam.find(docs, bench).collect()
    assert [(x.doc_id, x.item_id, x.equal) for x in r] == [(1, 9, 27)]
    assert sorted(x.doc_id for x in decontam.clean(docs, bench).collect()) == [2, 3]
    assert decontam.clean(odd, bench).count() == len(ODD) and decontam.find(empty, bench).count() == 0


def test_stretches_are_all_tried(spark):
    words = [f"w{i}" for i in range(51)]
    docs = spark.createDataFrame([(1, " ".join("zz" if i % 19 >= 13 else w for i, w in enumerate(words)))], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    assert [(x.doc_id, x.item_id, x.equal >= 13) for x in decontam.find(docs, bench).collect()] == [(1, 9, True)]
    rng = np.random.default_rng(4)
    for _ in range(200):
        same = rng.random(40) < 0.75
        most = max(int(same[a:b].sum()) for a in range(40) for b in range(a + 1, 41) if 5 * same[a:b].sum() >= 4 * (b - a))
        a, b, equal = decontam.stretch(same, 0.8)
        assert equal == most == same[a:b].sum() and 5 * equal >= 4 * (b - a)


def test_lines(spark, odd, empty):
    rows = [(1, "user alice logged in from host one two three four five\nonly here once more"), (2, "user alice logged in from host 77 two three four five"), (3, "user alice logged in from host one two nine four five"), (4, None), (5, "")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("", 1) and got[3] == ("", 1) and got[4] == (None, 0) and got[5] == ("", 0)
    out = lines.drop_lines(odd)
    assert out.count() == len(ODD) and "score" in out.columns and lines.drop_lines(empty).count() == 0


def dropped(spark, texts):
    return [r.n_dropped for r in lines.drop_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]


def test_long_lines_are_generalised(spark):
    long = [f"t{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}" for i in range(100)]
    assert dropped(spark, [" ".join(long), " ".join([*long[:50], "changed", *long[51:]])]) == [0, 1]


def test_templates_of_one_leaf(spark):
    lead = "and so it was "
    one, two = "red green blue white black grey pink brown", "up down left right front back near far"
    pairs = [lead + x.replace(y, z) for x in (one, two) for y, z in (("-", "-"), (x.split()[6], "other"))]
    noise = [lead + " ".join("abcdefgh"[i] + c for c in "qrstuvwx") for i in range(8)]
    assert dropped(spark, pairs) == [0, 1, 0, 1]
    assert dropped(spark, [*pairs, *noise]) == [0, 1, 0, 1] + [0] * 8


def test_short_lines_are_dropped(spark):
    assert dropped(spark, ["Les.\n\nAnd ornd.\nonce", "Les.\n\nAnd ornd."]) == [0, 2]


def test_pitman_yor(spark, odd, empty):
    rows = [(i, "the cat sat on the mat and ran" if i % 3 else "le chat dort sur la table") for i in range(120)]
    r = pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert (r.score < 0).all() and r[r.held_out].score.sum() > r[r.held_out].n_tokens.sum() * -2
    assert pitman_yor.score(odd).count() == len(ODD) and pitman_yor.score(empty).count() == 0


def test_jaccard(spark, odd, empty):
    base_text = [f"t{i}" for i in range(100)]
    near = base_text[:50] + ["x"] + base_text[51:]
    docs = spark.createDataFrame([(5, " ".join(base_text)), (3, " ".join(near)), (8, " ".join(base_text)), (9, "alone here"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(docs).collect()} == {5: (3, 2), 3: (3, 2), 8: (3, 2), 9: (9, 0), 2: (2, 0)}
    assert sorted(r.doc_id for r in jaccard.keep_one(docs).collect()) == [2, 3, 9]
    assert jaccard.classes(odd).count() == len(ODD) and jaccard.keep_one(empty).count() == 0
    bands, rows = jaccard.choose_bands(0.8, 0.9999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_blocks_of_a_large_group(spark):
    docs = spark.createDataFrame([(i, " ".join(f"t{k}" if k != i else "x" for k in range(120))) for i in range(60)], "doc_id long, text string")
    one, many = jaccard.classes(docs), jaccard.classes(docs, block=7)
    assert sorted(map(tuple, one.select("doc_id", "class_id", "n_links").collect())) == sorted(map(tuple, many.select("doc_id", "class_id", "n_links").collect()))


PAGE = """<html><head><title>T</title><script>var x="</p>";</script></head><body class="with-sidebar"><header><a href=x>Home</a></header>
<nav><ul><li><a href="/a">One</a></ul></nav><div class="cookie-notice">We use cookies to make the site better for you and for us.</div>
<div id="content"><h1>A title</h1><p>This is the main text of the page, and it has many of the words that are used in all texts &amp; more.</p>
<p>Short one.</p><p>And then there is another paragraph that is long enough to be told from a menu or an advert by its words.</p></div>
<div class="ad">Buy now</div><form>Mail <input></form><section id="comments"><p>I think that this is the best text that I have read in all of my days.</p></section>
<aside><p>See also all of the other texts that are on this site and that you may like to read.</p></aside><footer>&copy; all of it</footer>"""


def test_html(spark):
    want = "A title\nThis is the main text of the page, and it has many of the words that are used in all texts & more.\nShort one.\nAnd then there is another paragraph that is long enough to be told from a menu or an advert by its words."
    assert html.main_text(PAGE) == want
    assert [html.main_text(x) for x in (None, "", "<p>", "<nav>only a menu</nav>", "<!-- open", "<a title=\"x>y")] == [""] * 6 or html.main_text(None) == ""
    pages = spark.createDataFrame([(1, None, PAGE), (2, "u", None)], "page_id long, url string, html string")
    assert {r.page_id: r.n_chars for r in html.extract(pages).collect()} == {1: len(want), 2: 0}


def test_fingerprints(spark, odd, empty):
    rng = np.random.default_rng(2)
    words = np.array([f"w{i}" for i in range(400)])
    rows = [(int(i), " ".join(rng.choice(words, 200))) for i in rng.permutation(50)]
    r = fingerprint.fingerprint(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().sort_values("doc_id")
    texts = dict(rows)
    order = sorted(texts)
    for i, x in zip(order, r.itertuples()):
        t, n = texts[i], texts[order[(order.index(i) + 1) % 50]]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (x.doc_id, x.n_chars, x.edited_sha256) == (i, len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b = ({w: s.split().count(w) for w in s.split()} for s in (t, e))
        true = sum(min(a.get(w, 0), b.get(w, 0)) for w in a) / sum(max(a.get(w, 0), b.get(w, 0)) for w in {*a, *b})
        assert abs(x.near_edited - true) < 0.2
    assert fingerprint.fingerprint(odd).count() == len(ODD) and fingerprint.fingerprint(empty).count() == 0
    assert (fingerprint.fingerprints(["a b b", "a b b"])[0] == fingerprint.fingerprints(["b a b"])[0]).all()


def test_salvage():
    recs = [warc.record(i, f"http://x/{i}", b"p" * (10 + i), hashlib.sha1(b"p" * (10 + i)).hexdigest()) for i in range(4)]
    parts = [warc.member(r) for r in recs]
    hurt = parts[0] + parts[1][:30] + b"\x00" + parts[1][31:] + parts[2] + b"junk" + parts[3]
    got = list(warc.salvage(hurt))
    assert [r.page_id for r, _ in got if r] == ["0", "2", "3"]
    gaps = [g for _, g in got if g]
    assert gaps == [(len(parts[0]), len(parts[0]) + len(parts[1])), (len(hurt) - len(parts[3]) - 4, len(hurt) - len(parts[3]))]
    plain = recs[0] + recs[1].replace(b"ppp", b"pqp", 1) + recs[2][:-8] + recs[3]
    assert [r.page_id for r, _ in warc.salvage(plain) if r] == ["0", "3"]


def test_warc(spark):
    big = "x" * 1200
    pages = spark.createDataFrame([(1, "u", big), (2, None, big), (3, "v\nw", None), (4, "u", "s"), (5, "u", "s"), (None, "u", "é")], "page_id long, url string, html string")
    r = {x.page_id: (x.payload_bytes, x.record_type, x.refers_to, x.payload_digest) for x in warc.round_trip(pages).collect()}
    d = hashlib.sha1(big.encode()).hexdigest()
    assert r[1] == (1200, "revisit", 2, d) and r[2] == (1200, "response", None, d) and r[3][0] == 0 and r[4][1] == r[5][1] == "response" and r[None][0] == 2
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_token_hashes():
    h, b = tokens.token_hashes(["The cat, the CAT", None, "x" * 10])
    assert np.diff(b).tolist() == [4, 0, 1] and h[0] == h[2] and h[1] == h[3]
    long = "ab cd " * 900_000
    h, b = tokens.token_hashes([long])
    assert b[-1] == 1_800_000 and len(set(h.tolist())) == 2


def test_fold(spark):
    r = spark.createDataFrame([(7,), (8,)], "doc_id long").select("doc_id", base.fold("doc_id", 4, 2)).collect()
    assert [x[1] for x in r] == [zlib.crc32(str(x[0]).encode()) % 4 == 2 for x in r]
