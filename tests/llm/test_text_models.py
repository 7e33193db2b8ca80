"""Toxicity and language identification on held-out rows, with disguises and odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from convolens.llm import charlm, langid, toxicity

SF_DIR = "/root/testdata/sf0.01"
ODD = [None, "", " ", "123 456", "  ", "a" * 50_000, "\U0001f600"]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    out = langid.held_out(F.col("doc_id"), 3, 1)
    return toxicity.fit(docs.where(~out), labels, corpus=docs), docs, labels, out


def test_trigram_counts_cover_every_text(spark):
    df = spark.createDataFrame([("Ab b",), ("ab",), (None,), ("",), ("Жz Été",)], "text string")
    got = {charlm.gram_text(r.gram): r.n for r in charlm.trigram_counts(df).collect()}
    o = charlm.OTHER
    assert got == {
        " ab": 2, "ab ": 2, " b ": 1, f" {o}z": 1, f"{o}z ": 1, " ét": 1, "été": 1, "té ": 1,
    }
    assert charlm.trigram_counts(df.limit(0)).count() == 0


def test_disguised_words_come_back(model):
    lm = charlm.CharModel(model[0].grams)
    restorer = charlm.Restorer(lm)
    for shown in ("1d10t", "idi0t", "i d i o t", "i.d.i.o.t", "idiooooot", "IDIIIOT"):
        assert "idiot" in restorer.restore(f"the {shown} was").lower(), shown
    plain = "The quick-brown fox, e-mail a.b@c.org and 3.14; U.S. 2024-01-01"
    assert restorer.word("well-known") == "well-known" and restorer.restore("plain words only") == "plain words only"
    assert "quick-brown" in restorer.restore(plain)
    assert charlm.decode(lm, "a" * 20_000)  # long spans stay linear


def test_toxicity_on_held_out_rows(spark, model):
    fitted, docs, labels, out = model
    rows = toxicity.score(docs.where(out), fitted).join(labels, "doc_id").collect()
    got = np.array([(r.toxic, r.predicted) for r in rows])
    assert (got[got[:, 0] == 0, 1] == 0).mean() >= 0.97
    assert (got[got[:, 0] == 1, 1] == 1).mean() >= 0.75


def test_disguised_documents_are_caught(spark, model):
    words = "the thing was on the and in the of to"
    hits = ["1d10t", "m o r o n", "stuuuupid", "p@thetic", "w0rthless", "scum"]
    rows = [(i, f"{words} {h} {words}", "x") for i, h in enumerate(hits)] + [(99, words, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r.doc_id: r.predicted for r in toxicity.score(df, model[0]).collect()}
    assert got == {i: 1 for i in range(len(hits))} | {99: 0}


def test_every_disguise_is_decoded(model):
    grams = model[0].grams
    chances = dict.fromkeys(("idiot", "stupid", "scum", "ass", "moron"), 0.9)
    shown = [
        "a55", "a$$", "5cum", "idio7", "st-upid", "st.upid", "stuupiid", "scumm", "s,c,u,m", "s;c;u;m", "i d ! o t", "$ c u m",
        "i d i o t !", "m0ron!!", "1d10t", "moron", "(moron)",
    ]
    fitted = toxicity.ToxicityModel(grams, chances, 0.01)
    reader = fitted.reader()
    assert [w for w in shown if fitted.score(reader, f"the {w} was") < 0.7] == []
    assert all(fitted.score(reader, t) < 0.7 for t in ("a good book, well-known", "* * *", "1 + 1", "as the + of it"))


def test_skeletons_rule_out_nothing_that_counts(model):
    rng = np.random.default_rng(7)
    chances = dict.fromkeys(("idiot", "stup*", "scum", "ass", "moron", "k", "it's", "patheti*", "zzyx"), 0.9)
    fitted = toxicity.ToxicityModel(model[0].grams, chances, 0.01)
    filtered, plain = fitted.reader(), fitted.reader()
    plain.skeletons = None
    swaps = {r: [c for c, letters in charlm.LOOKALIKES.items() if r in letters] for r in "abcdefghijklmnopqrstuvwxyz"}
    words = ["idiot", "stupid", "scum", "asset", "morons", "kk", "its", "pathetic", "little", "quick", "glass", "zyx", "mass"]
    texts = []
    for _ in range(600):
        out = []
        for w in rng.choice(words, 3):
            for c in w:
                c = str(rng.choice(swaps[c])) if swaps[c] and rng.random() < 0.3 else c
                out.append((c.upper() if rng.random() < 0.1 else c) * int(rng.choice([1, 1, 1, 2])))
                out.append(str(rng.choice(["", "", "", ".", " ", "-", ", ", "&", "!"])))
            out.append(" ")
        texts.append("".join(out))
    scores = [fitted.score(filtered, t) for t in texts]
    assert scores == [fitted.score(plain, t) for t in texts]
    assert 100 < sum(s > 0.7 for s in scores) < 600


def test_skeletons():
    assert charlm.skeleton("1d-10OT!") == charlm.skeleton("idiloti") == "idioti"
    assert charlm.skeleton("a*b") is None and charlm.skeleton(" & ") == ""


def test_the_decoder_finds_the_best_reading():
    """Against all readings of short words."""
    grams = charlm.count_trigrams("idiot idol total bottle title lilt boot tool ideal " * 3)
    lm = charlm.CharModel({int(g): int(grams[g]) for g in np.flatnonzero(grams)})

    def every(span, at=0, letters="", cost=0.0):
        if at == len(span):
            path, before = 0.0, "  "
            for c in letters:
                known = c if c in charlm._AT else charlm.OTHER
                path, before = path + lm.log(before, known), before[1] + known
            yield cost + path + lm.log(before, charlm.EDGE), letters
            return
        ch = span[at]
        if ch.isalpha():
            yield from every(span, at + 1, letters + ch, cost)
        for r in charlm.LOOKALIKES.get(ch, ""):
            yield from every(span, at + 1, letters + r, cost + charlm.SWAPPED)
        if ch in charlm.SEPARATORS or not (ch.isalpha() or ch in charlm.LOOKALIKES):
            yield from every(span, at + 1, letters, cost + charlm.DROPPED)
        elif at and ch == span[at - 1]:
            yield from every(span, at + 1, letters, cost + charlm.SQUEEZED)

    for span in ("1d10t", "b00-t", "t1tl3", "id.e4l", "lillt", "to|al", "b*tt1e", "&x&", "7oo1", "ii11"):
        best = max(every(span))[0]
        got = charlm.decode(lm, span)
        assert max(s for s, letters in every(span) if letters == got) == pytest.approx(best), span


def test_toxicity_of_odd_texts(spark, model):
    df = spark.createDataFrame([(None, t) for t in ODD + ODD], "doc_id long, text string")
    rows = toxicity.score(df, model[0], drop_text=True).collect()
    assert len(rows) == len(df.columns) * 7 and all(r.predicted == 0 and 0 <= r.score <= 1 for r in rows)
    restored = toxicity.restore(df, model[0].grams)
    assert restored.where("text IS NULL AND restored IS NOT NULL").count() == 0
    nothing = df.limit(0)
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    empty = toxicity.fit(nothing, labels)
    assert {r.predicted for r in toxicity.score(df, empty).collect()} == {0}


def test_copies_count_once():
    a = " ".join(f"w{i}" for i in range(300))
    b = a + " tail"
    assert toxicity.family(a) == toxicity.family(b) != toxicity.family("other text here")


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    fitted = langid.fit(docs.where(~out), per_language=100)
    rows = langid.identify(docs.where(out), fitted).collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(None, t, "x", "y") for t in ODD], "doc_id long, text string, lang_pred string, lang string")
    named = {r.text: (r.lang_pred, r.score) for r in langid.identify(odd, fitted).collect()}
    assert all(named[t] == ("und", 0.0) for t in (None, "", " ", "123 456", "  ", "\U0001f600"))
    assert named["a" * 50_000][0] in fitted.languages


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    fitted = langid.fit(df)
    assert {r.lang_pred for r in langid.identify(df, fitted).collect()} == {"und"}
    assert langid.identify(df.limit(0), fitted).count() == 0


def test_languages_of_many_scripts_are_told_apart():
    rng = np.random.default_rng(1)
    # Latin, Cyrillic, Georgian, Thai, kana, two halves of Han, Hangul, Gothic: far more than 62 letters.
    starts = (0x61, 0x430, 0x10D0, 0xE01, 0x3042, 0x4E00, 0x6E00, 0xAC00, 0x10330)
    draw = lambda s, n: ["".join(chr(s + int(c)) for c in rng.integers(0, 20, 60)) for _ in range(n)]
    texts, labels = [], []
    for s in starts:
        texts += draw(s, 10)
        labels += [f"{s:x}"] * 10
    model = langid.fit_texts(texts, labels, landmarks=36)
    assert all(model.predict(draw(s, 5))[0] == [f"{s:x}"] * 5 for s in starts)
    # Every n-gram of a landmark is kept, however many there are.
    rare = ["".join(map(chr, range(0x4E00 + 4000 * i, 0x4E00 + 4000 * (i + 1)))) for i in range(2)]
    wide = langid.fit_texts(rare, ["a", "b"])
    assert len(wide.grams.codes) == len({g for t in rare for g in langid.all_grams(t).tolist()}) > 20_000
    assert wide.predict([rare[0][3900:], rare[1][3900:]])[0] == ["a", "b"]
    assert np.allclose(wide.kernel(rare) @ wide.weights, wide.values(rare), atol=1e-4)


def test_kernel_equals_its_definition():
    texts = ["abc de", "abd", "xyz", "de"]
    model = langid.fit_texts(texts, ["a", "a", "b", "b"], landmarks=4)

    def grams(t):
        t = f" {t} "
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    sets = [grams(t) for t in texts]
    want = [[len(x & y) / np.sqrt(len(x) * len(y)) for y in (sets[0], sets[2], sets[1], sets[3])] for x in sets]
    assert np.allclose(model.kernel(texts), want, atol=1e-6)


def test_grams_of_stretches_are_those_of_the_text(monkeypatch):
    text = "ab  cd, \u0130x 12\u4e2d\u6587e\u0301 " * 9
    whole = langid.all_grams(text)
    for stretch in (1, 2, 3, 7, 50, len(text)):
        monkeypatch.setattr(langid, "STRETCH", stretch)
        assert np.array_equal(langid.all_grams(text), whole), stretch
    assert np.array_equal(langid.all_grams(""), [32])


def test_many_languages_and_languages_of_long_texts(spark):
    rng = np.random.default_rng(2)
    word = lambda k, n: " ".join("".join(chr(0x4E00 + 40 * k + int(c)) for c in rng.integers(0, 12, 5)) for _ in range(n))
    rows = [(100 * k + i, word(k, 20), f"l{k}") for k in range(100) for i in range(3)]
    rows += [(20_000 + i, word(200, 6000), "long") for i in range(3)]
    fitted = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(fitted.languages) == 101 and len(fitted.held) == 303
    assert fitted.predict([word(k, 10) for k in (0, 57, 99, 200)])[0] == ["l0", "l57", "l99", "long"]


def test_products_of_parts_of_a_batch(monkeypatch):
    texts = ["abc de", "", "xyz", "abd", "123"]
    model = langid.fit_texts(texts[:1] + texts[2:4], ["a", "b", "a"])
    whole = model.values(texts)
    monkeypatch.setattr(langid, "ENTRIES", 1)
    assert np.allclose(model.values(texts), whole) and np.allclose(whole, model.kernel(texts) @ model.weights, atol=1e-5)


def test_ordinary_texts_and_words_skip_the_costly_steps():
    """Texts without letters by themselves are not searched for runs, words that begin like no term make no terms."""
    odd = ["a b c", " x y", "à l'é t", "b.a.d y o u", "a - b", "", "é é é", "s  t  u p", "l_o_l x", "aa b b", "c,d;e f", "plain words here"]
    for text in odd:
        assert not charlm.SPACED.search(text) or charlm.NEAR.search(text)
    for word in ["good", "gód", "abc", "ab1", "a.b", "ªª", "ʰʰ", "x_y", "漢漢", "²²"]:
        assert charlm.may_differ(word) == bool(charlm.LETTER.search(word) and charlm.OPEN.search(word))
    model = toxicity.ToxicityModel({}, {"badword": 0.9, "stup*": 0.8, "abc": 0.7}, 0.1)
    reader = model.reader()
    assert [reader.words[w] for w in ("badword", "badwords", "stupid", "stup", "abc", "abcd")] == [
        ("badword", 0.9), None, ("stupid", 0.8), None, ("abc", 0.7), None
    ]
    made = []
    real, toxicity.terms = toxicity.terms, lambda w: made.append(w) or real(w)
    try:
        assert [model.reader().words[w] for w in ("ordinary", "badwords")] == [None, None] and made == ["badwords"]
    finally:
        toxicity.terms = real
