"""Customer analytics as Spark jobs: RFM features, segments, tests, churn, KPIs, reports."""
