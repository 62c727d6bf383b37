"""The pipeline, each stage on its own input against plain code."""

import re

import corpus_pipeline
from patronlens.llm import toxicity
from patronlens.llm.common import table
from test_duplicates import plain_groups
from test_texts import plain_hits, plain_ids, plain_spans


def test_stages_on_small_tables(spark, small_data):
    docs = table(spark, small_data, "documents")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}

    out = stage["toxicity"](spark, docs, small_data)
    model = toxicity.train(docs, table(spark, small_data, "labels"))
    assert out.columns == columns
    assert {r.doc_id for r in out.collect()} == {i for i, r in rows.items() if model.score(r.text) < 0.5}

    kept = stage["near_dedup"](spark, docs, small_data)
    assert kept.columns == columns
    groups = plain_groups([(i, r.text) for i, r in rows.items()], 5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(groups.values()))

    clean = stage["decontamination"](spark, docs, small_data)
    items = [(r.item_id, r.text) for r in table(spark, small_data, "benchmark").collect()]
    grams = {g for _, t in items for g in ten_words(t)}
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {i for i, r in rows.items() if not grams & ten_words(r.text)}

    redacted = stage["pii"](spark, docs, small_data)
    assert redacted.columns == columns
    for r in redacted.collect():
        spans = plain_spans(rows[r.doc_id].text)
        assert r.n_chars == len(r.text) and not plain_spans(r.text)
        assert (r.text == rows[r.doc_id].text) == (not spans)
        assert len(re.findall(r"\[(?:EMAIL|IP|CARD|PHONE)\]", r.text)) >= bool(spans)

    packed = stage["packing"](spark, docs, small_data).collect()
    assert {r.doc_id for r in packed} == set(rows)
    assert sum(r.length for r in packed) == sum(len(plain_ids(r.text)) for r in rows.values())


def ten_words(text):
    from test_texts import plain_words

    words = plain_words(text)
    return {tuple(words[i : i + 10]) for i in range(len(words) - 9)}


def test_stages_keep_other_columns_and_odd_rows(spark, small_data):
    docs = table(spark, small_data, "documents").limit(20).selectExpr("*", "'x' AS rep", "'y' AS toxicity_score", "1 AS id")
    odd = docs.limit(1).selectExpr(
        "cast(null as bigint) AS doc_id", "cast(null as string) AS text", "lang", "source", "n_chars", "rep", "toxicity_score", "id"
    )
    docs = docs.unionByName(odd).unionByName(docs.limit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_out = stage(spark, docs, small_data)
        assert docs_out.columns == docs.columns, name
        assert docs_out.where("doc_id IS NULL").count() == 1, name


def test_rows_that_share_an_id_but_not_their_text_all_stay(spark):
    one, two = "a clean text that resembles nothing else in the whole table", "quite another one about the sea and ships"
    rows = [(1, one), (1, two), (1, two.upper()), (1, two), (2, one), (3, "some third text that stands alone here"), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "map('k', text) AS print")
    found = corpus_pipeline.one_of_near_copies(spark, docs, "")
    assert found.columns == docs.columns
    wanted = [(1, one), (1, two.upper()), (3, rows[5][1]), (None, one)]
    assert sorted((str(r.doc_id), r.text) for r in found.collect()) == sorted((str(i), t) for i, t in wanted)


def test_whole_run(spark, small_data):
    assert corpus_pipeline.run(spark, small_data).count() > 100


def test_plain_search_agrees_with_itself():
    assert plain_hits("a b c", [(1, "b c")]) == (3, 2, ["1"])
