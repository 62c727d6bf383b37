import pytest

from patronlens.operators.answers import AnswerContext, answer_questions
from patronlens.operators.insights import insights, model_record
from patronlens.operators.churn import ChurnModel

FACTS = ["Active customers: 4", "Retention rate: 50.0%", "Churn-risk customers: 3"]
WARNING = ("At-risk segment is sizable", "evidence one.", "action one.")
PATTERN = ("Statistically significant pattern detected", "evidence two.", "action two.")


def answer(spark, message, days=None, **changes):
    known = dict(active=[1, 1, 3], facts=FACTS, insights=[WARNING, PATTERN], significant=[])
    frame = spark.createDataFrame([(message, days)], "message string, days int")
    row = answer_questions(frame, AnswerContext(**{**known, **changes}), "message", "days").head()
    return row["intent"], row["answer"]


@pytest.mark.parametrize(
    ("message", "intent"),
    [("  ACTIVE users ", "active"), ("who is inactive?", "active"), ("latest", "test"),
     ("Retention", "retention"), ("retention of active", "active"), ("at risk", "churn"),
     ("CHURN?", "churn"), ("at-risk", "summary"), ("significant", "test"), ("", "summary"),
     (None, "summary"), ("hello", "summary")],
)
def test_first_matching_word_decides(spark, message, intent):
    assert answer(spark, message)[0] == intent


def test_texts(spark):
    assert answer(spark, "retention")[1] == "Retention rate: 50.0%"
    assert answer(spark, "churn")[1] == "Churn-risk customers: 3 evidence one. action one."
    assert answer(spark, "test")[1].startswith("No statistically significant tests")
    assert answer(spark, "test", significant=[("T", 0.01239)])[1] == "T was significant (p=0.0124)."
    assert answer(spark, "hi", 9)[1] == (
        "Here are the top insights for the last 9 days: "
        "- At-risk segment is sizable: evidence one. Action: action one. "
        "- Statistically significant pattern detected: evidence two. Action: action two."
    )


def test_without_material(spark):
    assert answer(spark, "churn", insights=[])[1] == "Churn-risk customers: 3"
    assert answer(spark, "hi", insights=[])[0] == "fallback"
    # Without a retention fact the question falls through to the summary.
    assert answer(spark, "retention", facts=[FACTS[0], FACTS[2]])[0] == "summary"


@pytest.mark.parametrize(
    ("days", "count"), [(1, 1), (2, 3), (30, 3), (None, 3), (0, 3), (-5, 0)]
)
def test_active_count_follows_the_asked_window(spark, days, count):
    assert answer(spark, "active", days)[1] == f"Active customers: {count}"


def shares(spark, at_risk, others):
    rows = [("At-Risk",)] * at_risk + [("Moderate",)] * others
    return spark.createDataFrame(rows, "segment string")


def results_table(spark, rows):
    return spark.createDataFrame(
        rows, "name string, method string, pValue double, result string"
    )


@pytest.mark.parametrize(
    ("at_risk", "others", "percent"), [(3, 17, "15%"), (1, 7, None), (1, 4, "20%"), (3, 5, "38%")]
)
def test_warning_from_fifteen_percent(spark, at_risk, others, percent):
    found = insights(shares(spark, at_risk, others), results_table(spark, [])).collect()
    if percent is None:
        assert found == []
    else:
        assert f" {percent} of all customers" in found[0]["evidence"]


def test_six_insights_at_most_in_order(spark):
    many = [(f"T{i}", "ANOVA", 0.001 * i, "significant") for i in range(1, 9)]
    many.append(("other", "ANOVA", None, "not_significant"))
    found = insights(shares(spark, 1, 1), results_table(spark, many)).collect()
    assert [r["severity"] for r in found] == ["warning"] + ["info"] * 5
    assert found[1]["evidence"] == "T1 (p=0.0010)."


def test_model_record(spark):
    row = model_record(spark, ChurnModel("rule_only", "rule", ("a", "b"))).head()
    assert (row["type"], row["features"], row["metrics"]["auc"]) == ("rule_only", ["a", "b"], None)
