"""The whole customer analysis, from input tables to the response."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from patronlens import fixed_values as fixed
from patronlens.operators import answers, churn, insights, kpis
from patronlens.operators.anchor import Window
from patronlens.operators.anova import (
    DEFAULT_DIMENSIONS,
    order_value_test_name,
    order_value_tests,
)
from patronlens.operators.first_look import first_look
from patronlens.operators.rfm import FEATURES, customer_activity, with_attributes
from patronlens.operators.segments import Thresholds, segment_thresholds, with_segments
from patronlens.sources.bundle import TableBundle
from patronlens.sources.fingerprint import fingerprint

PREVIOUS = "_previous"


class PeriodAnalysis:
    """Everything that depends on one anchor; each part is built on first use."""

    def __init__(
        self,
        table: DataFrame,
        window: Window,
        suffix: str,
        scorer: str,
        model_features: tuple[str, ...],
    ):
        self._table = table
        self._suffix = suffix
        self.window = window
        self.scorer = scorer
        self.model_features = model_features

    @cached_property
    def base(self) -> DataFrame:
        """Features and attributes of the customers with an order up to the anchor."""
        figures = [F.col(name + self._suffix).alias(name) for name in FEATURES]
        kept = [c for c in fixed.CUSTOMER_ATTRIBUTES if c in self._table.columns]
        return self._table.filter(F.col("frequency" + self._suffix) > 0).select(
            "customer_id", *figures, *kept
        )

    @cached_property
    def features(self) -> DataFrame:
        return with_segments(self.base, self.window, self.thresholds)

    @cached_property
    def thresholds(self) -> Thresholds:
        """The segment limits, found once for all parts that need them."""
        return segment_thresholds(self.base)

    @cached_property
    def model(self) -> churn.ChurnModel:
        """Training runs Spark jobs when first asked for; the rule needs none."""
        if self.scorer == "rule":
            return churn.rule_model(self.base, self.model_features)
        return churn.train_churn(self.base, self.model_features)

    @cached_property
    def scored_base(self) -> DataFrame:
        """Scores without segments, for figures that do not need the thresholds."""
        return churn.score_churn(self.base, self.model)

    @cached_property
    def scored(self) -> DataFrame:
        return churn.score_churn(self.features, self.model)

    @cached_property
    def kpis(self) -> DataFrame:
        start = self.window.start
        active = self.scored_base.withColumn("isActiveInWindow", F.col("last_order") >= start)
        return kpis.kpis(active)


class CustomerInsights(PeriodAnalysis):
    """One analysis of one set of tables.

    The transactions are read once for the anchor (not at all if it is given) and once for
    everything else. The resulting customer-grain table feeds several passes (thresholds,
    model, figures, lists). With ``keep="memory"`` it is persisted; with ``keep="storage"`` it is
    written to a new folder below ``folder``, by default the shared one that the session
    names, so that a lost executor never costs another pass over the transactions. ``release``
    drops what is kept, and so does leaving a ``with`` block. An analysis of changed files must
    follow the release of the old one. ``date_formats`` lists date layouts besides ISO; by default the
    layout of text dates is found by a vote. ``dimensions`` is what order values are tested by. The job
    that finds the anchor also holds that vote and finds customers that are listed very often; their
    rows are spread over tasks.
    """

    def __init__(
        self,
        bundle: TableBundle,
        days: int = fixed.DEFAULT_DAYS,
        anchor: date | str | None = None,
        scorer: str = "auto",
        model_features: tuple[str, ...] = tuple(fixed.CHURN_FEATURES),
        compare: bool = False,
        keep: str = "memory",
        folder: str | None = None,
        date_formats: Sequence[str] | None = None,
        dimensions: Sequence[str] = DEFAULT_DIMENSIONS,
    ):
        if scorer not in ("auto", "rule"):
            raise ValueError("scorer must be 'auto' or 'rule'")
        if keep not in ("memory", "storage"):
            raise ValueError("keep must be 'memory' or 'storage'")
        look = first_look(bundle, days, anchor, date_formats)
        self.bundle, window, often = look.bundle, look.window, look.often
        self.days = days
        self.dimensions = tuple(dimensions)
        self._persisted: list[DataFrame] = []
        self._written: str | None = None
        windows, suffixes = [window], [""]
        if compare:
            windows.append(Window(window.anchor - timedelta(days=days), days))
            suffixes.append(PREVIOUS)
        activity = customer_activity(self.bundle.transactions, windows, suffixes)
        joined = with_attributes(activity, self.bundle.customers, often)
        table = self._keep(joined) if keep == "memory" else self._stored(joined, folder)
        super().__init__(table, window, "", scorer, model_features)
        if compare:
            self.previous = PeriodAnalysis(table, windows[1], PREVIOUS, scorer, model_features)

    def _stored(self, df: DataFrame, folder: str | None) -> DataFrame:
        spark = df.sparkSession
        base = folder or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            raise ValueError("name a folder, or set spark.checkpoint.dir")
        self._written = f"{base.rstrip('/')}/patronlens-{uuid.uuid4().hex}"
        df.write.parquet(self._written)
        return spark.read.schema(df.schema).parquet(self._written)

    def _keep(self, df: DataFrame) -> DataFrame:
        self._persisted.append(df.persist())
        return df

    def __enter__(self) -> CustomerInsights:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def release(self) -> None:
        while self._persisted:
            self._persisted.pop().unpersist()
        if self._written:
            context = self.base.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(self._written)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
            self._written = None

    @cached_property
    def tests(self) -> DataFrame:
        """Few rows that several parts read, so they are computed only once."""
        return self._keep(order_value_tests(self._table, *self.dimensions))

    @property
    def _test_order(self) -> list[str]:
        return [order_value_test_name(d) for d in self.dimensions]

    @cached_property
    def segment_counts(self) -> DataFrame:
        return kpis.segment_counts(self.features)

    @cached_property
    def clv_trend(self) -> DataFrame:
        return kpis.clv_trend(self.base)

    @cached_property
    def top_customers(self) -> DataFrame:
        return kpis.top_customers(self.scored)

    @cached_property
    def insights(self) -> DataFrame:
        return self._keep(insights.insights(self.features, self.tests, self._test_order))

    @cached_property
    def facts(self) -> DataFrame:
        return insights.facts(self.kpis, self.model)

    @cached_property
    def model_record(self) -> DataFrame:
        return insights.model_record(self.base.sparkSession, self.model)

    @cached_property
    def kpi_changes(self) -> DataFrame:
        """KPIs against the period before; needs ``compare=True``."""
        return kpis.kpi_changes(self.kpis, self.previous.kpis)

    def answer(
        self, messages: DataFrame, text: str = "message", days: str | None = None
    ) -> DataFrame:
        """Answer a table of messages; ``days`` names a column with their windows."""
        context = answers.answer_context(
            self.base, self.window, self.facts, self.insights, self.tests, self._test_order
        )
        return answers.answer_questions(messages, context, text, days)

    def sections(self) -> dict[str, DataFrame]:
        """The parts of the response as tables."""
        return {
            "range": self.base.sparkSession.range(1).select(
                F.lit(self.days).alias("days"), self.window.end.cast("date").alias("end")
            ),
            "kpis": self.kpis,
            "segments": self.segment_counts,
            "clvTrend": self.clv_trend,
            "topCustomers": self.top_customers,
            "model": self.model_record,
            "tests": self.tests,
            "insights": self.insights,
            "grounding": self.facts,
        }

    def response(self) -> DataFrame:
        """The response as one row with one JSON document; every part is small."""
        parts = self.sections()

        def only(name: str) -> DataFrame:
            frame = parts[name]
            return frame.select(F.struct(*frame.columns).alias("v"))

        def every(name: str, order: list) -> DataFrame:
            """All rows of a part that is bounded by design, in report order."""
            frame = parts[name]
            items = F.collect_list(F.struct(*[F.col(c) for c in frame.columns]))
            return frame.orderBy(*order).coalesce(1).agg(items.alias("v"))

        cards = self.kpis.select(
            F.struct(
                *[
                    F.struct(
                        F.col(name).alias("value"),
                        F.lit(None).cast("double").alias("deltaPct"),
                        F.lit(label).alias("deltaLabel"),
                    ).alias(name)
                    for name, label in fixed.KPI_DELTA_LABELS.items()
                ]
            ).alias("v")
        )
        model = self.model_record.select(
            F.struct(F.struct(*self.model_record.columns).alias("churnModel")).alias("v")
        )
        found = self.insights
        pieces = {
            "range": only("range"),
            "kpis": cards,
            "segments": every("segments", ["name"]),
            "clvTrend": every("clvTrend", ["month"]),
            "topCustomers": every("topCustomers", [F.desc("monetary"), "id"]),
            "model": model,
            "tests": every("tests", ["name"]),
            "insights": found.agg(F.collect_list(F.struct(*found.columns)).alias("v")),
            "grounding": only("grounding"),
        }
        one = self.base.sparkSession.range(1)
        document = F.struct(*[p.scalar().alias(name) for name, p in pieces.items()])
        return one.select(
            F.to_json(document, {"ignoreNullFields": "false"}).alias("response")
        )


class InsightsMemo:
    """Remembers analyses by (days, anchor day), checked after loading and cleaning.

    Tables that come from files are known by the listing of these files (path, length, time): unchanged
    files give the remembered analysis without a job over the data, changed ones a new analysis, after
    which the old one for the same window is released. Other tables are known by their anchor day
    alone, so changed rows before it are not noticed; call ``clear`` then.
    """

    def __init__(self) -> None:
        self._runs: dict[tuple, CustomerInsights] = {}
        self._seen: dict[tuple, tuple[int, date]] = {}

    def get(
        self, bundle: TableBundle, days: int = fixed.DEFAULT_DAYS, **options
    ) -> CustomerInsights:
        """``options`` go to the analysis; they do not take part in the memory's key."""
        files = fingerprint(bundle.customers, bundle.transactions)
        if files is not None and (days, files) in self._seen:
            return self._runs[(*self._seen[days, files], files)]
        look = first_look(bundle, days, options.get("anchor"), options.get("date_formats"))
        key = (days, look.window.anchor.date(), files)
        if key not in self._runs:
            for old in [k for k in self._runs if k[0] == days and k[2] is not None and k[2] != files]:
                self._runs.pop(old).release()
                self._seen = {k: v for k, v in self._seen.items() if k != (days, old[2])}
            self._runs[key] = CustomerInsights(bundle, days, **{**options, "anchor": look.window.anchor.date()})
        if files is not None:
            self._seen[days, files] = key[:2]
        return self._runs[key]

    def clear(self) -> None:
        for run in self._runs.values():
            run.release()
        self._runs.clear()
        self._seen.clear()
