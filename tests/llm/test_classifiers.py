"""Toxicity, quality and language: held-out accuracy and awkward rows."""

import random

import pytest

from edge import documents
from patronlens.llm import language, quality, toxicity

RUDE = ["grobnik", "zlotar", "mupfel"]
MILD = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]


def sentences(seed, n, rude):
    rng = random.Random(seed)
    words = rng.choices(MILD, k=n)
    for _ in range(3 if rude else 0):
        words.insert(rng.randrange(n), rng.choice(RUDE) + rng.choice(["", "en", "s."]))
    return " ".join(words)


def test_toxicity_on_held_out_and_disguised_words(spark):
    rows = [(i, sentences(i, 60, i % 6 == 0)) for i in range(600)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(500)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    right = [(model.score(t) >= 0.5) == (i % 6 == 0) for i, t in rows[500:]]
    assert sum(right) >= 98
    mild = sentences(9_999, 40, False)
    for disguised in ("GR0BNIK grobn1k", "grоbnik grobniк", "gr\u200bobnik ｇｒｏｂｎｉｋ", "Zlotar! mupfel..."):
        assert model.score(f"{mild} {disguised} {disguised}") >= 0.5, disguised
    assert model.score(None) == model.score("") < 0.5
    scored = toxicity.score_documents(documents(spark, clash="score"), model)
    assert scored.columns[-1] == "score_" and scored.where("score_ IS NULL").isEmpty()
    assert toxicity.score_documents(documents(spark, []), model).collect() == []


def test_exception_phrases_cancel_hits():
    lexicon = toxicity.Lexicon({" trash ": 2.0, " tra": 1.0}, ("trash can",))
    assert lexicon.hits(toxicity.fold("the Trash-can and tr4sh")) == {18: 2.0}
    assert lexicon.hits(toxicity.fold("a trash can")) == {}


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(documents(spark), labels).score("anything") < 1e-6
    ones = spark.createDataFrame([(i, 1) for i in range(1, 12)], "doc_id long, toxic int")
    assert toxicity.train(documents(spark), ones).score("anything") > 0.99


def test_quality_on_held_out(spark):
    def text(i):
        words = sentences(i, 50, False).split()
        return " | ".join(w.upper() + "!!" for w in words) if i % 5 == 0 else " ".join(words) + "."

    rows = [(i, text(i)) for i in range(700)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(560)] + [(None, 1), (4, None)], "doc_id long, quality int")
    machine = quality.train(documents(spark, rows), labels)
    scores = machine.score([t for _, t in rows[560:]], [[]] * 140)
    assert sum((s >= 0.7) == (i % 5 != 0) for s, (i, _) in zip(scores, rows[560:])) >= 136
    found = quality.score_documents(documents(spark, clash="score"), machine).collect()
    assert len(found) == 14 and all(0 <= r.score <= 1 for r in found)
    assert quality.score_documents(documents(spark, []), machine).collect() == []


def test_pair_terms_match_the_double_sum():
    import numpy as np

    rng = np.random.default_rng(1)
    machine = quality.Machine(0.3, rng.normal(size=20), rng.normal(size=(20, 4)))
    index, value = np.array([1, 5, 7, 19, 2, 3]), rng.normal(size=6)
    for first, end in ((0, 4), (4, 6)):
        i, v = index[first:end], value[first:end]
        pairs = sum(v[a] * v[b] * machine.factors[i[a]] @ machine.factors[i[b]] for a in range(len(i)) for b in range(a))
        plain = 0.3 + machine.weights[i] @ v + pairs
        assert abs(machine.raw(index, value, np.array([0, 4]))[first // 4] - plain) < 1e-9


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(documents(spark), labels).score(["x"], [[]])[0] < 1e-6


def test_quality_reads_metadata():
    index, _ = quality.features("a b", [None, 1000.0])
    assert index.max() < quality.n_features(2) and len(index) == 2 + quality.STATISTICS + 2


def test_quality_is_fitted_and_applied_with_metadata(spark):
    """Texts say nothing; a metadata column decides."""
    rows = [(i, "same text", 100_000.0 if i % 3 else None) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, size double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)], "doc_id long, quality int")
    machine = quality.train(docs, labels, metadata_cols=["size"])
    found = quality.score_documents(docs, machine, metadata_cols=["size"]).collect()
    assert len(found) == 240 and all((r.score >= 0.7) == (r.doc_id % 3 > 0) for r in found)


SYLLABLES = {"aa": ["ka", "lo", "mi", "ne"], "bb": ["stra", "pfen", "zu", "ich"], "cc": ["eau", "oux", "é", "ç"]}


def test_language_on_held_out(spark):
    rng = random.Random(3)

    def text(lang):
        return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 5))) for _ in range(12))

    rows = [(i, text(lang), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=600))]
    odd = [(700, None, "aa"), (701, "12 ² 34", None), (702, "kalo", None), (None, "zuich", "bb"), (703, "", "cc")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 AS score")
    model = language.train(docs, per_language=100)
    found = {r.doc_id: r for r in language.predict(docs, model).collect()}
    truth = {i: lang for i, _, lang in rows}
    assert sum(found[i].lang_pred == lang for i, lang in truth.items()) >= 597
    assert found[700].lang_pred == found[701].lang_pred == found[703].lang_pred == "und"
    assert found[702].lang_pred == "aa" and 0 < found[702].score <= 1
    assert model.judge("pfenpfenzuzuichstra")[0] == "bb"


def test_rare_languages_keep_words_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(language, "LEAST_EACH", 40, raising=False)
    common = [f"{a}{b}e" for a in "abdfgk" for b in "lmnrst"]
    rare = ["qwox", "xiwuq", "wyqz", "zuxwy"]
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(common, k=30)), "aa") for i in range(200)]
    rows += [(1000 + i, " ".join(rng.choices(rare, k=3)), "zz") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, max_words=30, max_grams=30)
    assert set(rare) <= set(model.index)
    assert model.judge("qwox wyqz")[0] == "zz" and model.judge("ale bne")[0] == "aa"
    monkeypatch.setattr(language, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language.train(docs)


def test_language_without_training_texts(spark):
    model = language.train(documents(spark))
    assert {r.lang_pred for r in language.predict(documents(spark), model).collect()} == {"und"}
