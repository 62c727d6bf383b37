"""Layouts of date texts by vote, and the one job that an analysis starts with."""

import os
import shutil
from datetime import datetime

import pytest

from patronlens.functions.documents import document_rows
from patronlens.operators.first_look import first_look
from patronlens.operators.layouts import full_layout, infer_layouts
from patronlens.plans.customer_insights import CustomerInsights, InsightsMemo
from patronlens.sources.bundle import TableBundle, load_bundle
from patronlens.sources.fingerprint import fingerprint

SCHEMA = "order_id string, customer_id string, order_datetime string, total_amount string"


def dates(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "day string")


@pytest.mark.parametrize(
    ("texts", "layout"),
    [
        (["05/01/2024", "13/01/2024 10:30"], "d/M/yyyy"),
        (["01/05/2024", "1/13/2024 2:05 PM"], "M/d/yyyy"),
        (["5/1/24", "25/1/24"], "d/M/yy"),
        (["2024/1/5", "2024/01/06 10:30:05"], "yyyy/M/d"),
        (["05.01.2024", "bad", None, ""], "d.M.yyyy"),
        (["05-01-2024", "28-02-2024"], "d-M-yyyy"),
        (["5 Jan 2024", "17 Mar 2024 08:00"], "d MMM yyyy"),
        (["Jan 5, 2024"], "MMM d, yyyy"),
        (["05/05/2024", "6/6/2024"], "d/M/yyyy"),  # both orders mean the same days
        (["15/01/2024", "13/01/2024", "01/14/2024"], "d/M/yyyy"),  # more votes
        (["2024-01-05", "2024-01-06T10:00:00Z", "20240107"], None),
        (["2024-01-05", "31/01/2024"], "d/M/yyyy"),
        (["bad", None], None), ([], None),
    ],
)
def test_layout_by_vote(spark, texts, layout):
    assert infer_layouts(dates(spark, *texts), "day") == ((full_layout(layout),) if layout else ())


@pytest.mark.parametrize("texts", [["05/01/2024", "06/02/2024"], ["13/01/2024", "01/14/2024"], ["31/12/2024", "31.12.2024"]])
def test_ambiguous_columns_are_an_error(spark, texts):
    with pytest.raises(ValueError, match="ambiguous"):
        infer_layouts(dates(spark, *texts), "day")


def test_other_types_need_no_vote(spark):
    assert infer_layouts(spark.sql("SELECT DATE'2024-01-05' AS day"), "day") == ()


def export(folder, day, created="05/01/2023"):
    """Two CSV files; orders on the days 2 to 29 of February 2024, one of them without an amount."""
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/customers.csv", "w") as out:
        out.write("customer_id,name,account_creation_date,device_type\n")
        out.writelines(f"{i},n{i},{created if i else '31/01/2023'},{'a' if i % 2 else 'b'}\n" for i in range(4))
    with open(f"{folder}/transactions.csv", "w") as out:
        out.write("order_id,customer_id,order_datetime,total_amount\n")
        out.writelines(f"{i},{i % 4},{day(i)} 10:30,{i}\n" for i in range(2, 30))
        out.write("99,1,31/12/2030 00:00,\n")


def test_a_day_first_export_loads_without_an_argument(spark, tmp_path):
    results = []
    for name, day in (("dmy", lambda i: f"{i:02d}/02/2024"), ("iso", lambda i: f"2024-02-{i:02d}")):
        export(str(tmp_path / name), day)
        with CustomerInsights(load_bundle(spark, str(tmp_path / name)), scorer="rule") as run:
            results.append((run.window.anchor, sorted(map(tuple, run.base.collect()))))
            created = run.bundle.customers.select("account_creation_date").collect()
            assert sorted(r[0] for r in created)[-1] == datetime(2023, 1, 31)
    assert results[0] == results[1] and results[0][0] == datetime(2024, 2, 29)
    assert len(results[0][1]) == 4


def test_first_look_is_one_job_and_naming_layouts_skips_the_vote(spark, tmp_path):
    export(str(tmp_path), lambda i: f"{i:02d}/02/2024")
    bundle = load_bundle(spark, str(tmp_path))
    look = first_look(bundle)
    assert look.layouts["order_datetime"] == (full_layout("d/M/yyyy"),) and sorted(look.often.keys) == ["0", "1", "2", "3"]
    assert first_look(bundle, at="2024-02-10").window.anchor == datetime(2024, 2, 10)
    named = first_look(bundle, date_formats=["dd/MM/yyyy HH:mm"])
    assert named.window == look.window and named.layouts == {}
    with pytest.raises(ValueError, match="No valid order_datetime"):
        first_look(bundle, date_formats=[])
    nothing = TableBundle(bundle.customers, bundle.transactions.limit(0))
    with pytest.raises(ValueError, match="No valid order_datetime"):
        first_look(nothing)


def test_memo_knows_changed_files(spark, tmp_path):
    folder = str(tmp_path / "shop")
    export(folder, lambda i: f"{i:02d}/02/2024")
    memo = InsightsMemo()
    first = memo.get(load_bundle(spark, folder), scorer="rule")
    assert first.base.count() == 4
    again = load_bundle(spark, folder)
    tracker, group = spark.sparkContext.statusTracker(), "memo"
    spark.sparkContext.setJobGroup(group, "")
    assert memo.get(again, scorer="rule") is first
    jobs = tracker.getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("rest", "")
    assert len(jobs) <= 2  # the listing of the files; the data is not read
    # The anchor day stays the same, an earlier order changes.
    with open(f"{folder}/transactions.csv", "a") as out:
        out.write("100,7,03/02/2024 09:00,5\n")
    second = memo.get(load_bundle(spark, folder), scorer="rule")
    assert second is not first and second.base.count() == 5
    assert memo.get(load_bundle(spark, folder), 7, scorer="rule") is not second
    memo.clear()


def test_fingerprint_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "a b")
    spark.range(10).repartition(2).write.parquet(path)
    one = fingerprint(spark.read.parquet(path))
    assert one == fingerprint(spark.read.parquet(path).filter("id > 3").select("id"))
    shutil.copytree(path, str(tmp_path / "other"))
    assert fingerprint(spark.read.parquet(str(tmp_path / "other"))) != one
    spark.range(1).write.mode("append").parquet(path)
    assert fingerprint(spark.read.parquet(path)) != one
    assert fingerprint(spark.range(3)) is None and fingerprint() is None
    assert fingerprint(spark.read.parquet(path).union(spark.range(3))) is None


def test_documents_as_rows(spark):
    texts = [('{"a":{"b":[1,2.5,"x",null,true],"c":{}}}',), (None,)]
    rows = document_rows(spark.createDataFrame(texts, "j string"), "j").collect()
    assert sorted((r["path"], r["type"], r["text"], r["number"]) for r in rows) == [
        ("$", "object", None, None), ("$.a", "object", None, None), ("$.a.b", "array", None, None),
        ("$.a.b[0]", "number", None, 1.0), ("$.a.b[1]", "number", None, 2.5), ("$.a.b[2]", "string", "x", None),
        ("$.a.b[3]", "null", None, None), ("$.a.b[4]", "boolean", "true", None), ("$.a.c", "object", None, None),
    ]
