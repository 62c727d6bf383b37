"""Named queries over the star-schema tables: (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from patronlens.functions.dates import month_label
from patronlens.functions.documents import document_rows
from patronlens.operators import (
    alerts,
    anchor,
    anova,
    answers,
    churn,
    clean,
    display,
    insights as insight_rules,
    inventory,
    kpis,
    quality,
    rfm,
    sales,
    segments as segment_rules,
)
from patronlens.operators.joins import flag_members, join_unique
from patronlens.plans.customer_insights import CustomerInsights
from patronlens.sources import sinks, star_schema as star
from patronlens.sources.bundle import load_bundle
from patronlens.sources.delimited import drop_missing_tokens, read_delimited
from patronlens.streaming import buckets, refresh

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BUNDLES = {"orders": star.orders_bundle, "events": star.events_bundle}

# All given tables.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()

# Decimals of the reported figures.
MONEY, MEAN, FINE = 2, 4, 6


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """Sums of doubles depend on row order in their last bits; report fewer digits."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def analysis(spark: SparkSession, folder: str, mapping: str, **options) -> CustomerInsights:
    """An analysis whose persisted customer table lives as long as the session."""
    return CustomerInsights(BUNDLES[mapping](spark, folder), **options)


def clean_orders(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_transactions(star.order_transactions(spark, folder))


def clean_purchases(spark: SparkSession, folder: str) -> DataFrame:
    return clean.clean_transactions(star.event_transactions(spark, folder))


# Sources and cleaning ---------------------------------------------------------------------


def dirty_transactions(
    spark: SparkSession, folder: str, exported: Column | None = None
) -> DataFrame:
    """Orders as the text a careless export would hold; defects follow from the key.

    ``exported`` selects the orders, by default all of them.
    """
    key, text = F.col("o_orderkey"), lambda c: F.col(c).cast("string")

    def every(n: int, value: str | None, otherwise: Column) -> Column:
        return F.when(key % n == 0, F.lit(value)).otherwise(otherwise)

    day = F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")
    amount = F.concat(F.lit(" "), text("o_totalprice"), F.lit(" "))
    orders = star.table(spark, folder, "orders")
    orders = orders if exported is None else orders.filter(exported)
    return orders.select(
        every(29, "", text("o_orderkey")).alias("order_id"),
        every(23, "NA", text("o_custkey")).alias("customer_id"),
        every(11, "bad", F.concat(day, F.lit(" 10:30:00"))).alias("order_datetime"),
        every(7, "n/a", every(13, "5d", every(17, "1,000", amount))).alias("total_amount"),
        every(5, "abc", (key % 9).cast("string")).alias("quantity"),
        every(3, "TRUE", every(4, "True", every(19, " TRUE ", F.lit("no")))).alias(
            "coupon_applied"
        ),
    )


@query
def clean_transactions(spark, folder):
    typed = clean.clean_transactions(drop_missing_tokens(dirty_transactions(spark, folder)))
    return rounded(typed, {"total_amount": MONEY})


@query
def clean_customers(spark, folder):
    key = F.col("c_custkey")
    dirty = star.table(spark, folder, "customer").select(
        F.when(key % 31 == 0, "null").otherwise(key.cast("string")).alias("customer_id"),
        F.when(key % 6 == 0, "2020-13-45")
        .otherwise(F.concat(F.lit("2020-01-1"), (key % 10).cast("string")))
        .alias("account_creation_date"),
        F.when(key % 8 == 0, "<NA>").otherwise(F.col("c_name")).alias("name"),
        F.when(key % 9 == 0, "inf?").otherwise(F.col("c_acctbal").cast("string")).alias(
            "avg_session_time_min"
        ),
        F.when(key % 10 == 0, "NaN").otherwise((key % 12).cast("string")).alias(
            "wishlist_items_count"
        ),
    )
    return clean.clean_customers(drop_missing_tokens(dirty))


@query
def tab_file_transactions(spark, folder):
    """The dirty export written as a tab-separated file and read back by detection."""
    path = sinks.shared_folder(spark)
    (
        dirty_transactions(spark, folder)
        .write.option("header", True)
        .option("sep", "\t")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return rounded(
        clean.clean_transactions(read_delimited(spark, path)), {"total_amount": MONEY}
    )


# Window, features and segments ------------------------------------------------------------


@query
def anchor_window(spark, folder):
    return anchor.window_frame(clean_orders(spark, folder))


@query
def anchor_window_events(spark, folder):
    return anchor.window_frame(clean_purchases(spark, folder), days=7)


FEATURE_DIGITS = {"monetary": MONEY, "monetary90d": MONEY}


@query
def rfm_features(spark, folder):
    orders = clean_orders(spark, folder)
    found = rfm.rfm_features(orders, anchor.reporting_window(orders))
    return rounded(found, FEATURE_DIGITS)


@query
def rfm_features_events(spark, folder):
    purchases = clean_purchases(spark, folder)
    found = rfm.rfm_features(purchases, anchor.reporting_window(purchases))
    return rounded(found, FEATURE_DIGITS)


@query
def rfm_90d(spark, folder):
    return rfm_features(spark, folder).select("customer_id", "frequency90d", "monetary90d")


@query
def recency_days_events(spark, folder):
    return rfm_features_events(spark, folder).select("customer_id", "last_order", "recencyDays")


@query
def customer_attributes(spark, folder):
    base = analysis(spark, folder, "orders").base
    found = base.select(
        "customer_id", "name", "device_type", "avg_session_time_min",
        "wishlist_items_count", "location",
    )
    return rounded(found, {"avg_session_time_min": FINE})


@query
def segment_thresholds(spark, folder):
    limits = segment_rules.segment_thresholds(analysis(spark, folder, "orders").base)
    names = ["monetary_q75", "frequency_q75", "recency_q50", "recency_q75"]
    return spark.range(1).select(
        [F.round(F.lit(getattr(limits, n)), MEAN).alias(n) for n in names]
    )


def _segments(spark, folder, mapping):
    return analysis(spark, folder, mapping).features.select(
        "customer_id", "recencyDays", "frequency", F.round("monetary", MONEY).alias("monetary"),
        "segment", "isActiveInWindow",
    )


@query
def segments(spark, folder):
    return _segments(spark, folder, "orders")


@query
def segments_events(spark, folder):
    return _segments(spark, folder, "events")


@query
def segment_counts(spark, folder):
    return analysis(spark, folder, "orders").segment_counts


@query
def segment_counts_events(spark, folder):
    return analysis(spark, folder, "events").segment_counts


@query
def active_customers(spark, folder):
    orders = clean_orders(spark, folder)
    return rfm.active_customers(orders, anchor.reporting_window(orders, days=90))


@query
def active_flag(spark, folder):
    """The general membership flag, on all customers instead of only transacting ones."""
    orders = clean_orders(spark, folder)
    active = rfm.active_customers(orders, anchor.reporting_window(orders))
    customers = star.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("customer_id")
    )
    return flag_members(customers, active, "customer_id", "isActiveInWindow")


# Tests of group differences ---------------------------------------------------------------


@query
def aov_by_customer(spark, folder):
    return rounded(anova.average_order_value(clean_orders(spark, folder)), {"aov": FINE})


@query
def aov_by_customer_events(spark, folder):
    return rounded(anova.average_order_value(clean_purchases(spark, folder)), {"aov": FINE})


def _order_values(spark, folder, *dimensions):
    bundle = clean.clean_bundle(star.orders_bundle(spark, folder))
    averages = anova.average_order_value(bundle.transactions)
    attributes = bundle.customers.select("customer_id", *dimensions)
    return join_unique(averages, attributes, "customer_id", "inner")


@query
def anova_groups(spark, folder):
    moments = anova.group_moments(_order_values(spark, folder, "device_type"))
    return rounded(moments, {"mean": MEAN, "variance": 0})


ANOVA_DIGITS = {"f": FINE, "p": FINE}


@query
def anova_f(spark, folder):
    moments = anova.group_moments(_order_values(spark, folder, "device_type"))
    return rounded(anova.one_way_anova(moments), ANOVA_DIGITS)


@query
def anova_many(spark, folder):
    """Several (metric, dimension) pairs in one pass over the customers."""
    tests = {
        "order value by device": ("aov", "device_type"),
        "order value by location": ("aov", "location"),
    }
    rows = _order_values(spark, folder, "device_type", "location")
    return rounded(anova.one_way_anova(anova.group_moments(rows, tests)), ANOVA_DIGITS)


@query
def test_result(spark, folder):
    return rounded(analysis(spark, folder, "orders").tests, {"pValue": FINE})


@query
def test_result_tables(spark, folder):
    """The same record straight from the cleaned tables, without the feature table."""
    bundle = clean.clean_bundle(star.orders_bundle(spark, folder))
    return rounded(anova.run_tests(bundle.customers, bundle.transactions), {"pValue": FINE})


def spend_bands() -> dict[str, Column]:
    """Dimensions that do differ in order value: one group holds all customers below a limit,
    the others divide the rest by id. In the order in which they are tested."""
    key = F.col("customer_id")
    return {
        f"band_{groups}_{limit}": F.when(F.col("aov") >= limit, (key % (groups - 1)).cast("string"))
        .otherwise("low")
        for limit in (160_000, 150_000, 140_000)
        for groups in (7, 5, 3)
    }


def _banded_tests(spark, folder):
    bands = spend_bands()
    table = _order_values(spark, folder).withColumns(bands)
    return anova.order_value_tests(table, *bands), [anova.order_value_test_name(b) for b in bands]


@query
def significant_tests(spark, folder):
    tests, _ = _banded_tests(spark, folder)
    return rounded(tests, {"pValue": FINE})


@query
def significant_insights(spark, folder):
    """More significant tests than there is room for: the first ones in test order stay."""
    tests, order = _banded_tests(spark, folder)
    return insight_rules.insights(analysis(spark, folder, "orders").features, tests, order)


# Churn ------------------------------------------------------------------------------------


@query
def churn_labels(spark, folder):
    base = analysis(spark, folder, "orders").base
    return churn.with_label(base).select("customer_id", "recencyDays", churn.LABEL)


@query
def feature_matrix(spark, folder):
    base = analysis(spark, folder, "orders").base
    names = churn.present_features(base)
    filled = churn.feature_matrix(base).select("customer_id", *names)
    return rounded(filled, {"monetary90d": MONEY, "avg_session_time_min": FINE})


@query
def split_assignment(spark, folder):
    base = analysis(spark, folder, "orders").base
    return churn.with_split(churn.with_label(base)).select("customer_id", churn.LABEL, "is_test")


def _rule_scores(spark, folder, mapping):
    scored = analysis(spark, folder, mapping, scorer="rule").scored_base
    return scored.select("customer_id", "recencyDays", F.round("churnRisk", FINE).alias("churnRisk"))


@query
def rule_churn(spark, folder):
    return _rule_scores(spark, folder, "orders")


@query
def rule_churn_events(spark, folder):
    """No label variety here, so the automatic scorer falls back to the rule."""
    scored = analysis(spark, folder, "events").scored_base
    return scored.select("customer_id", "recencyDays", F.round("churnRisk", FINE).alias("churnRisk"))


@query
def lr_score(spark, folder):
    scored = analysis(spark, folder, "orders").scored_base
    return scored.select("customer_id", F.round("churnRisk", MEAN).alias("churnRisk"))


@query
def lr_metrics(spark, folder):
    record = analysis(spark, folder, "orders").model_record
    return record.select(
        "type", "labelRule", F.array_join("features", ",").alias("features"),
        F.round("metrics.auc", MEAN).alias("auc"),
        F.round("metrics.accuracy", MEAN).alias("accuracy"),
    )


def _one_input_model(spark, folder):
    """A fit on orders of the last 90 days alone, which does not restate the label."""
    return analysis(spark, folder, "orders", model_features=("frequency90d",))


@query
def lr_one_input_score(spark, folder):
    scored = _one_input_model(spark, folder).scored_base
    return scored.select("customer_id", F.round("churnRisk", 3).alias("churnRisk"))


@query
def lr_one_input_metrics(spark, folder):
    record = _one_input_model(spark, folder).model_record
    return record.select(
        "type", F.array_join("features", ",").alias("features"),
        F.round("metrics.auc", FINE).alias("auc"), F.round("metrics.accuracy", FINE).alias("accuracy"),
    )


@query
def model_record_events(spark, folder):
    record = analysis(spark, folder, "events").model_record
    return record.select(
        "type", "labelRule", F.array_join("features", ",").alias("features"),
        "metrics.auc", "metrics.accuracy",
    )


# Figures, lists and the response ----------------------------------------------------------

KPI_DIGITS = {"avgCustomerValue": MEAN, "retentionRate": FINE}


@query
def headline_kpis(spark, folder):
    """Churn risk from the recency rule, which SQL can check."""
    return rounded(analysis(spark, folder, "orders", scorer="rule").kpis, KPI_DIGITS)


@query
def headline_kpis_model(spark, folder):
    return rounded(analysis(spark, folder, "orders").kpis, KPI_DIGITS)


@query
def headline_kpis_events(spark, folder):
    return rounded(analysis(spark, folder, "events").kpis, KPI_DIGITS)


@query
def clv_trend(spark, folder):
    return rounded(analysis(spark, folder, "orders").clv_trend, {"value": MEAN})


@query
def clv_trend_events(spark, folder):
    return rounded(analysis(spark, folder, "events").clv_trend, {"value": MEAN})


TOP_DIGITS = {"monetary": MONEY, "churnRisk": FINE}


@query
def top_customers(spark, folder):
    return rounded(analysis(spark, folder, "orders", scorer="rule").top_customers, TOP_DIGITS)


@query
def top_customers_model(spark, folder):
    return rounded(analysis(spark, folder, "orders").top_customers, TOP_DIGITS)


@query
def top_customers_events(spark, folder):
    return rounded(analysis(spark, folder, "events").top_customers, TOP_DIGITS)


@query
def insights(spark, folder):
    return analysis(spark, folder, "orders", scorer="rule").insights


@query
def insights_events(spark, folder):
    return analysis(spark, folder, "events").insights


@query
def facts(spark, folder):
    found = analysis(spark, folder, "orders", scorer="rule").facts
    return found.select(F.posexplode("facts").alias("position", "fact"))


@query
def facts_events(spark, folder):
    found = analysis(spark, folder, "events").facts
    return found.select(F.posexplode("facts").alias("position", "fact"))


@query
def question_answers(spark, folder):
    """Every message of the conversations table."""
    messages = star.table(spark, folder, "conversations")
    answered = analysis(spark, folder, "orders", scorer="rule").answer(messages, "text")
    return answered.select("conv_id", "turn", "role", "intent", "answer")


@query
def question_answers_days(spark, folder):
    """Each message asks about its own topic and window, derived from its keys."""
    topic = F.element_at(
        F.array(*[F.lit(t) for t in (
            "", " ACTIVE users", " Retention?", " churn", " At Risk", " at-risk", " significant",
        )]),
        (F.col("conv_id") % 7 + 1).cast("int"),
    )
    days = F.when(F.col("turn") % 3 == 2, F.lit(None)).otherwise(
        (F.col("conv_id") % 50) * 20 - 40
    )
    messages = star.table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.concat("text", topic).alias("message"),
        days.cast("int").alias("days"),
    )
    answered = analysis(spark, folder, "orders", scorer="rule").answer(
        messages, "message", "days"
    )
    return answered.select("conv_id", "turn", "role", "days", "intent", "answer")


@query
def question_answers_significant(spark, folder):
    """Tests that do find differences: messages ask for them, for a summary and for other things."""
    topic = F.element_at(
        F.array(*[F.lit(t) for t in ("", " any test?", " SIGNIFICANT", " retention")]),
        (F.col("conv_id") % 4 + 1).cast("int"),
    )
    messages = star.table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.concat(F.col("role"), topic).alias("message")
    )
    run = analysis(spark, folder, "orders", scorer="rule")
    tests, order = _banded_tests(spark, folder)
    found = insight_rules.insights(run.features, tests, order)
    context = answers.answer_context(run.base, run.window, run.facts, found, tests, order)
    answered = answers.answer_questions(messages, context)
    return answered.select("conv_id", "turn", "role", "intent", "answer")


@query
def response_json(spark, folder):
    return analysis(spark, folder, "orders").response()


@query
def response_fields(spark, folder):
    """Fields picked out of the JSON document."""
    document = analysis(spark, folder, "orders", scorer="rule").response()
    paths = {
        "days": ("$.range.days", "int"),
        "end": ("$.range.end", "date"),
        "active": ("$.kpis.activeCustomers.value", "bigint"),
        "average": ("$.kpis.avgCustomerValue.value", "double"),
        "risky": ("$.kpis.churnRiskCustomers.value", "bigint"),
        "retention": ("$.kpis.retentionRate.value", "double"),
        "segment": ("$.segments[0].name", "string"),
        "segment_size": ("$.segments[0].value", "bigint"),
        "trend_month": ("$.clvTrend[5].month", "string"),
        "trend_value": ("$.clvTrend[5].value", "double"),
        "top_id": ("$.topCustomers[0].id", "string"),
        "last_id": ("$.topCustomers[11].id", "string"),
        "model": ("$.model.churnModel.type", "string"),
        "method": ("$.tests[0].method", "string"),
        "severity": ("$.insights[0].severity", "string"),
        "fact": ("$.grounding.facts[0]", "string"),
    }
    picked = document.select(
        [F.get_json_object("response", p).cast(t).alias(n) for n, (p, t) in paths.items()]
    )
    return rounded(picked, {"average": MEAN, "retention": FINE, "trend_value": MEAN})


@query
def response_json_events(spark, folder):
    return analysis(spark, folder, "events", days=7).response()


def _document(run: CustomerInsights) -> DataFrame:
    return rounded(document_rows(run.response(), "response"), {"number": MEAN})


@query
def response_document(spark, folder):
    """The whole response with a fitted model, taken apart into a row for each of its parts."""
    return _document(analysis(spark, folder, "orders"))


@query
def response_document_events(spark, folder):
    """The whole response without a model, tests and some attributes."""
    return _document(analysis(spark, folder, "events", days=7))


@query
def kpi_display(spark, folder):
    return display.kpi_display(analysis(spark, folder, "orders", scorer="rule").kpis)


@query
def kpi_display_changes(spark, folder):
    run = _compared(spark, folder, "events", 7)
    return display.kpi_display(run.kpis, run.kpi_changes)


@query
def top_customers_display(spark, folder):
    top = analysis(spark, folder, "orders", scorer="rule").top_customers
    return rounded(display.top_customers_display(top), {"churn": FINE})


@query
def segment_display(spark, folder):
    return display.segment_display(analysis(spark, folder, "orders").segment_counts)


# Inventory and sales ----------------------------------------------------------------------


def _sales(spark, folder):
    sold = star.line_sales(spark, folder)
    return sold, anchor.find_anchor(sold, "sold_at")


def _outlook(spark, folder):
    sold, latest = _sales(spark, folder)
    return inventory.sku_outlook(star.scarce_inventory(spark, folder), sold, latest)


OUTLOOK_DIGITS = {"predicted_demand": MEAN, "days_to_stock_out": MEAN}


@query
def stock_risk(spark, folder):
    return inventory.stock_risk(star.part_inventory(spark, folder))


@query
def stock_risk_by_category(spark, folder):
    return inventory.stock_risk_by_category(
        star.part_inventory(spark, folder), star.part_products(spark, folder)
    )


@query
def sku_outlook(spark, folder):
    return rounded(_outlook(spark, folder), OUTLOOK_DIGITS)


@query
def top_skus(spark, folder):
    top = inventory.top_skus(_outlook(spark, folder), star.part_products(spark, folder))
    return rounded(top, OUTLOOK_DIGITS)


@query
def reorder_alerts(spark, folder):
    return rounded(inventory.reorder_alerts(_outlook(spark, folder)), OUTLOOK_DIGITS)


@query
def reorder_message(spark, folder):
    message = inventory.reorder_message(_outlook(spark, folder))
    return rounded(message, {"days_to_stock_out": MEAN})


@query
def inventory_turnover(spark, folder):
    sold, latest = _sales(spark, folder)
    found = inventory.inventory_turnover(
        star.part_inventory(spark, folder), star.part_products(spark, folder), sold, latest
    )
    return rounded(found, {"sold_cost": MONEY, "stock_cost": MONEY, "turnover": FINE})


@query
def weekly_forecast(spark, folder):
    sold, latest = _sales(spark, folder)
    found = sales.weekly_forecast(sold, latest)
    return rounded(found, {"actual": MONEY, "forecast": MONEY})


@query
def revenue_forecast(spark, folder):
    found = sales.revenue_forecast(star.line_sales(spark, folder))
    return rounded(found, {"slope": MEAN, "forecast": MONEY})


@query
def monthly_figures(spark, folder):
    return rounded(sales.monthly_figures(clean_orders(spark, folder)), {"revenue": MONEY})


@query
def visits_per_weekday(spark, folder):
    return sales.visits_per_weekday(star.table(spark, folder, "events"), "ts")


@query
def device_share(spark, folder):
    return rounded(
        sales.share_by(star.order_customers(spark, folder), "device_type"), {"share": FINE}
    )


GROWTH_DIGITS = {"current": MEAN, "previous": MEAN, "growth": FINE}


@query
def product_growth(spark, folder):
    sold, latest = _sales(spark, folder)
    return rounded(sales.growth(sold, "sku", latest), GROWTH_DIGITS)


@query
def trending_products(spark, folder):
    sold, latest = _sales(spark, folder)
    return rounded(sales.trending(sales.growth(sold, "sku", latest), "sku"), GROWTH_DIGITS)


# Data quality, comparisons and alerts -----------------------------------------------------


@query
def table_profiles(spark, folder):
    """One profile row per table."""
    specs = {
        "orders": ("o_custkey", "o_orderdate"),
        "lineitem": ("l_partkey", "l_shipdate"),
        "events": ("user_id", "ts"),
        "customer": ("c_custkey", None),
    }
    profiles = [
        quality.profile(star.table(spark, folder, name), key, ts).select(
            F.lit(name).alias("table_name"), "*"
        )
        for name, (key, ts) in specs.items()
    ]
    combined = profiles[0]
    for p in profiles[1:]:
        combined = combined.unionByName(p)
    return combined


@query
def column_profiles(spark, folder):
    """Every column of every given table, as its schema has it; the first column is the key. Estimates
    of distinct values are left to tests, as no other engine gives the same."""
    profiles = []
    for name in TABLES:
        df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
        found = quality.column_profile(df, df.columns[0]).drop("distinct_estimate")
        profiles.append(found.select(F.lit(name).alias("table_name"), "*"))
    combined = profiles[0]
    for p in profiles[1:]:
        combined = combined.unionByName(p)
    return rounded(combined, {"least_number": MEAN, "greatest_number": MEAN})


@query
def table_preview(spark, folder):
    return quality.sample_rows(star.table(spark, folder, "customer"), "c_custkey")


@query
def cleaning_report(spark, folder):
    """Dirty orders of which a part was exported a second time, whole rows and values."""
    return rounded(
        quality.cleaning_report(drop_missing_tokens(repeated_export(spark, folder))),
        {"retained_share": FINE},
    )


def repeated_export(spark: SparkSession, folder: str) -> DataFrame:
    again = dirty_transactions(spark, folder, F.col("o_orderkey") % 37 == 0)
    return dirty_transactions(spark, folder).unionByName(again)


@query
def retention_summary(spark, folder):
    orders = clean_orders(spark, folder)
    found = quality.retention_summary(orders, anchor.find_anchor(orders))
    return rounded(found, {"kept_amount": MONEY})


@query
def retained_orders(spark, folder):
    """Rows kept under the six-month policy, per month."""
    orders = clean_orders(spark, folder)
    kept = quality.apply_retention(orders, anchor.find_anchor(orders), 6)
    return kept.groupBy(month_label(F.col("order_datetime")).alias("month")).agg(
        F.count("*").alias("kept_rows")
    )


def _alerts(spark, folder, mapping, **limits):
    run = analysis(spark, folder, mapping, scorer="rule")
    found = alerts.churn_alerts(run.scored, high_value=run.thresholds.monetary_q75, **limits)
    return rounded(found, TOP_DIGITS)


@query
def churn_alerts(spark, folder):
    return _alerts(spark, folder, "orders")


@query
def churn_alerts_early(spark, folder):
    """An early warning: valuable customers from a tenth of the longest absence on."""
    return _alerts(spark, folder, "orders", threshold=0.1)


@query
def churn_alerts_events(spark, folder):
    return _alerts(spark, folder, "events")


def _compared(spark, folder, mapping, days):
    return analysis(spark, folder, mapping, days=days, scorer="rule", compare=True)


CHANGE_DIGITS = {"value": MEAN, "previous": MEAN, "deltaPct": FINE}


@query
def kpi_changes(spark, folder):
    return rounded(_compared(spark, folder, "orders", 30).kpi_changes, CHANGE_DIGITS)


@query
def kpi_changes_events(spark, folder):
    return rounded(_compared(spark, folder, "events", 7).kpi_changes, CHANGE_DIGITS)


@query
def kpi_changes_model(spark, folder):
    """Both periods scored by models of their own."""
    run = analysis(spark, folder, "orders", days=90, compare=True)
    return rounded(run.kpi_changes, CHANGE_DIGITS)


@query
def retention_by_segment(spark, folder):
    found = kpis.retention_by_segment(analysis(spark, folder, "orders").features)
    return rounded(found, {"retentionRate": FINE})


# Streaming and report files ---------------------------------------------------------------


@query
def streaming_refresh(spark, folder):
    """Orders streamed into the stored state, and the features rebuilt from it."""
    arriving = star.as_transactions(
        refresh.transaction_stream(
            spark, folder, star.SCHEMAS["orders"], pathGlobFilter="orders.parquet"
        )
    )
    state = sinks.shared_folder(spark)
    refresh.refresh_state(arriving, state)
    refresh.compact_state(spark, state)
    rows = refresh.stored_rows(spark, state)
    found = rfm.rfm_features(rows, anchor.reporting_window(rows))
    return rounded(found, FEATURE_DIGITS)


@query
def streaming_batches(spark, folder):
    """Orders that arrive in four parts, each streamed as a batch of its own; the state is merged
    in between and the batches it covers are removed. Customers span the parts."""
    base = sinks.shared_folder(spark)
    arriving, state = f"{base}/in", f"{base}/state"
    orders = star.order_transactions(spark, folder)
    for part in range(4):
        chosen = orders.filter(F.col("order_id") % 4 == part)
        chosen.write.mode("append").parquet(arriving)
        refresh.refresh_state(refresh.transaction_stream(spark, arriving, orders.schema), state)
        if part % 2:
            refresh.compact_state(spark, state, remove=True)
    rows = refresh.stored_rows(spark, state)
    features = rfm.rfm_features(rows, anchor.reporting_window(rows))
    values = anova.average_order_value(rows)
    return rounded(features.join(values, "customer_id"), {**FEATURE_DIGITS, "aov": FINE})


@query
def streaming_segments(spark, folder):
    """Orders that arrive in order of time, a quarter at a time, taken into bucketed state: every
    batch moves the window. Segments by limits that the counting trees give."""
    base = sinks.shared_folder(spark)
    arriving = f"{base}/in"
    orders = star.order_transactions(spark, folder)
    day = F.unix_date(F.col("order_datetime").cast("date"))
    cuts = orders.agg(F.percentile_approx(day, [0.25, 0.5, 0.75])).head()[0]
    state = buckets.BucketedState(spark, f"{base}/state", buckets=16, leaf_values=1_000)
    for low, high in zip([None, *cuts], [*cuts, None]):
        later = F.lit(True) if low is None else day > low
        part = orders.filter(later & (F.lit(True) if high is None else day <= high))
        part.write.mode("append").parquet(arriving)
        state.refresh(refresh.transaction_stream(spark, arriving, orders.schema))
    found = segment_rules.with_segments(state.features(), state.window, state.thresholds())
    return rounded(found.select("customer_id", "recencyDays", "frequency", "monetary", "segment", "isActiveInWindow"), {"monetary": MONEY})


@query
def csv_folder_kpis(spark, folder):
    """Customers and orders exported as CSV, loaded as a table folder and analysed."""
    path = sinks.shared_folder(spark)
    bundle = star.orders_bundle(spark, folder)
    bundle.customers.write.option("header", True).csv(f"{path}/customers.csv")
    bundle.transactions.write.option("header", True).csv(f"{path}/transactions.csv")
    run = CustomerInsights(load_bundle(spark, path), scorer="rule")
    return rounded(run.kpis, KPI_DIGITS)


@query
def stored_result(spark, folder):
    """Segment sizes stored under (days, anchor) and read back."""
    run = analysis(spark, folder, "orders")
    path = sinks.shared_folder(spark)
    sinks.write_result(run.segment_counts, path, run.days, run.window.anchor.date().isoformat())
    return spark.read.parquet(path)


@query
def csv_report(spark, folder):
    """Segments and trend written as CSV and read back."""
    run = analysis(spark, folder, "orders")
    trend = rounded(run.clv_trend, {"value": MEAN})
    paths = sinks.write_csv_report(
        {"segments": run.segment_counts, "clvTrend": trend}, sinks.shared_folder(spark)
    )
    rows = [
        spark.read.option("header", True).csv(path).toDF("name", "value").select(
            F.lit(section).alias("section"), "name", F.col("value").cast("double").alias("value")
        )
        for section, path in paths.items()
    ]
    return rows[0].unionByName(rows[1])
