import pytest
from pyspark.errors import AnalysisException

from patronlens.sources import sinks
from patronlens.sources.bundle import load_bundle
from patronlens.sources.delimited import pick_separator, read_delimited


@pytest.mark.parametrize("sep", [",", "\t", ";", "|"])
def test_every_separator_gives_the_same_table(spark, tmp_path, sep):
    lines = [["order_id", "note", "amount"], ["1", "plain", "2.5"], ["2", "NA", ""]]
    path = tmp_path / "file.csv"
    path.write_text("\n".join(sep.join(line) for line in lines) + "\n")
    found = read_delimited(spark, str(path))
    assert [f.dataType.simpleString() for f in found.schema] == ["string"] * 3
    assert [tuple(r) for r in found.orderBy("order_id").collect()] == [
        ("1", "plain", "2.5"), ("2", None, None),
    ]


def test_separator_ignores_quoted_text():
    assert pick_separator('"a,b,c,d"\tx\ty') == "\t"
    assert pick_separator("single") == ","


def test_quoted_fields_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "q.csv"
    path.write_text('id,text\n1,"a, ""b"""\n2,null\n3,None\n4,nan\n5,none\n6, NA\n')
    found = {r["id"]: r["text"] for r in read_delimited(spark, str(path)).collect()}
    assert found == {"1": 'a, "b"', "2": None, "3": None, "4": None, "5": "none", "6": " NA"}


def test_optional_tables_may_be_absent(spark, tmp_path):
    (tmp_path / "customers.csv").write_text("customer_id,account_creation_date\nc,2024-01-01\n")
    (tmp_path / "transactions.csv").write_text("order_id\tcustomer_id\no\tc\n")
    (tmp_path / "products.csv").write_text("sku,name\ns,n\n")
    bundle = load_bundle(spark, str(tmp_path))
    assert bundle.payments is None and bundle.inventory is None
    assert bundle.products.columns == ["sku", "name"]
    assert bundle.transactions.columns == ["order_id", "customer_id"]


def test_required_table_must_exist(spark, tmp_path):
    (tmp_path / "customers.csv").write_text("customer_id,account_creation_date\nc,2024-01-01\n")
    with pytest.raises(AnalysisException):
        load_bundle(spark, str(tmp_path))


def test_parquet_bundle_turns_nan_into_null(spark, tmp_path):
    spark.sql("SELECT 'c' AS customer_id, double('NaN') AS x").write.parquet(
        str(tmp_path / "customers.parquet")
    )
    spark.sql("SELECT 'o' AS order_id").write.parquet(str(tmp_path / "transactions.parquet"))
    bundle = load_bundle(spark, str(tmp_path), fmt="parquet")
    assert bundle.customers.head()["x"] is None


def test_stored_result_replaces_only_its_own_partition(spark, tmp_path):
    path = str(tmp_path / "out")
    one, two = spark.range(1), spark.range(2)
    sinks.write_result(two, path, 30, "2024-01-30")
    sinks.write_result(two, path, 7, "2024-01-30")
    sinks.write_result(one, path, 30, "2024-01-30")
    counts = spark.read.parquet(path).groupBy("days").count().collect()
    assert {r["days"]: r["count"] for r in counts} == {30: 1, 7: 2}


def test_report_stores_nested_columns_as_json(spark, tmp_path):
    nested = spark.sql("SELECT 'x' AS name, array('a', 'b') AS items")
    paths = sinks.write_csv_report({"part": nested}, str(tmp_path))
    row = spark.read.option("header", True).option("escape", '"').csv(paths["part"]).head()
    assert (row["name"], row["items"]) == ("x", '["a","b"]')


def test_scratch_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    folder = sinks.shared_folder(spark)
    assert folder != sinks.shared_folder(spark)
    if root:
        assert folder.startswith(root.rstrip("/"))
