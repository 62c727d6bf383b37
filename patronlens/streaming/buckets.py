"""Customer state that a batch changes only where its own customers are.

Rows and features lie in hash buckets of the customer. A batch reads and rewrites the buckets of
its own customers, and, where it moves the reporting window, those with rows on the days that enter or
leave it. What has changed is found by comparing the old features of these buckets with the new.
Segment limits come from counting trees (`counting_tree`) that take the same changes, so no refresh
reads all customers.

Every batch writes folders under its own number and, last of all, a manifest: which version of each bucket
and leaf is current. A batch that breaks off leaves no manifest; repeated, it starts from the manifest
before it and replaces its own folders. Old versions stay readable until `remove_unused`.

Layout of a state folder: manifest/, arriving/, days/, rows/, features/, changed/ and leaves/, each with
a folder for every batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, time, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from patronlens.fixed_values import DEFAULT_DAYS, TRAILING_DAYS
from patronlens.functions.dates import whole_days_between
from patronlens.operators.anchor import Window, check_days
from patronlens.operators.clean import clean_transactions
from patronlens.operators.rfm import FEATURES, customer_activity
from patronlens.operators.segments import Thresholds
from patronlens.sources.delimited import drop_missing_tokens
from patronlens.streaming import counting_tree as tree
from patronlens.streaming.refresh import KEYS, partial_rows

BUCKETS = 256
# What a feature row holds besides its id; the age follows from the last order and the anchor.
FIGURES = [name for name in FEATURES if name != "recencyDays"] + ["aov"]
MANIFEST = "kind string, field string, id int, low double, n long, version long, text string"


@dataclass(frozen=True)
class Report:
    """What a refresh has touched: buckets and leaves, and the stored rows that lay in them."""

    batch: int
    buckets: tuple[int, ...]
    rows_read: int
    leaves: int


@dataclass(frozen=True)
class _Manifest:
    """The state after a batch: {bucket: (version, rows)}, the trees' leaves, latest time, schemas."""

    buckets: dict[int, tuple[int, int]]
    leaves: tree.Leaves
    latest: datetime | None
    rows: StructType | None = None
    features: StructType | None = None


def midnight_of(moment: datetime) -> datetime:
    return datetime.combine(moment.date(), time())


class BucketedState:
    """A state folder on storage that all executors share.

    ``buckets`` is fixed when the folder is first used: choose it so that a bucket's rows fit a task.
    ``leaf_values`` is the number of different values a leaf of the trees is laid out for.
    """

    def __init__(
        self, spark: SparkSession, folder: str, days: int = DEFAULT_DAYS, buckets: int = BUCKETS,
        leaf_values: int = tree.LEAF_VALUES,
    ):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.days, self.buckets, self.leaf_values = check_days(days), buckets, leaf_values

    # Manifests ----------------------------------------------------------------------------

    def _batches(self) -> list[int]:
        try:
            found = self.spark.read.schema(f"{MANIFEST}, batch long").parquet(f"{self.folder}/manifest")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return sorted(row["batch"] for row in found.select("batch").distinct().collect())

    def _manifest(self, before: int | None = None) -> _Manifest:
        """The last one, or the last one before a batch."""
        numbers = [n for n in self._batches() if before is None or n < before]
        if not numbers:
            return _Manifest({}, {}, None)
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest/batch={numbers[-1]}").collect()
        info = json.loads(next(r["text"] for r in rows if r["kind"] == "info"))
        if info["buckets"] != self.buckets:
            raise ValueError(f"this state has {info['buckets']} buckets, not {self.buckets}")
        return _Manifest(
            {r["id"]: (r["version"], r["n"]) for r in rows if r["kind"] == "bucket"},
            tree.from_rows([r for r in rows if r["kind"] == "leaf"]),
            datetime.fromisoformat(info["latest"]) if info["latest"] else None,
            *[StructType.fromJson(info[name]) if info[name] else None for name in ("rows", "features")],
        )

    def _note(self, made: _Manifest, number: int) -> None:
        info = {
            "buckets": self.buckets,
            "latest": made.latest.isoformat() if made.latest else None,
            "rows": made.rows.jsonValue() if made.rows else None,
            "features": made.features.jsonValue() if made.features else None,
        }
        rows = [("info", None, None, None, None, None, json.dumps(info))]
        rows += [("bucket", None, k, None, n, version, None) for k, (version, n) in made.buckets.items()]
        rows += tree.to_rows(made.leaves)
        table = self.spark.createDataFrame(rows, MANIFEST).coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={number}")

    # Reading ------------------------------------------------------------------------------

    def _read(self, kind: str, manifest: _Manifest, chosen: Sequence[int] | None = None) -> DataFrame:
        """The current version of the chosen buckets, by default of all."""
        schema = manifest.rows if kind == "rows" else manifest.features
        chosen = manifest.buckets if chosen is None else [k for k in chosen if k in manifest.buckets]
        paths = [f"{self.folder}/{kind}/batch={manifest.buckets[k][0]}/bucket={k}" for k in chosen]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _window(self, manifest: _Manifest) -> Window | None:
        return Window(midnight_of(manifest.latest), self.days) if manifest.latest else None

    @property
    def window(self) -> Window | None:
        """The reporting window of the last finished batch."""
        return self._window(self._manifest())

    def rows(self) -> DataFrame:
        """All partial rows; use them wherever clean transactions are expected."""
        return self._read("rows", self._manifest())

    def features(self) -> DataFrame:
        """A feature row for each customer with an order up to the anchor."""
        manifest = self._manifest()
        return self._with_age(self._read("features", manifest), self._window(manifest))

    def _with_age(self, features: DataFrame, window: Window) -> DataFrame:
        age = whole_days_between(F.col("last_order"), window.end).alias("recencyDays")
        return features.filter("frequency > 0").select("customer_id", *FIGURES[:-1], age, "aov")

    def thresholds(self) -> Thresholds:
        """The segment limits, read from the counting trees: a leaf or two for each limit."""
        manifest = self._manifest()
        return tree.thresholds(self.spark, self.folder, manifest.leaves, self._window(manifest))

    # Writing ------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("customer_id").cast("string")), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame, kind: str, number: int) -> None:
        placed = df.withColumn("bucket", self._bucket()).repartition("bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{kind}/batch={number}")

    def _entering_or_leaving(self, old: datetime | None, new: datetime | None) -> list[tuple[str, str]]:
        """Days, first and last, whose rows count differently after the window has moved."""
        if old is None or new is None or midnight_of(old) == midnight_of(new):
            return []
        back = timedelta(days=TRAILING_DAYS)
        ends = (midnight_of(old), midnight_of(new))
        return [(str(ends[0].date()), str(ends[1].date())), (str((ends[0] - back).date()), str((ends[1] - back).date()))]

    def update(self, transactions: DataFrame, number: int) -> tuple[DataFrame, Report]:
        """Take in a batch of clean transactions; the changed feature rows, and what was touched."""
        before = self._manifest(number)
        arriving_path, days_path = (f"{self.folder}/{kind}/batch={number}" for kind in ("arriving", "days"))
        partial_rows(transactions).write.mode("overwrite").parquet(arriving_path)
        arriving = self.spark.read.parquet(arriving_path)
        days = arriving.select("order_day", self._bucket().alias("bucket")).distinct()
        days.coalesce(1).write.mode("overwrite").parquet(days_path)
        newest = arriving.agg(F.max("order_datetime")).head()[0]
        latest = max((t for t in (before.latest, newest) if t is not None), default=None)
        schema = arriving.schema
        window = Window(midnight_of(latest or datetime(1970, 1, 1)), self.days)
        if newest is None:  # nothing usable has arrived
            self._note(before, number)
            return self._with_age(customer_activity(arriving, [window]), window), Report(number, (), 0, 0)

        touched = arriving.select(self._bucket().alias("bucket"))
        for first, last in self._entering_or_leaving(before.latest, latest):
            days = self.spark.read.parquet(f"{self.folder}/days").filter(F.col("batch") < number)
            touched = touched.union(days.filter(F.col("order_day").between(first, last)).select("bucket"))
        chosen = sorted(row["bucket"] for row in touched.distinct().collect())

        old_rows = self._read("rows", _with_schemas(before, schema, None), chosen)
        merged = old_rows.unionByName(arriving).groupBy(*KEYS).agg(
            F.max("order_datetime").alias("order_datetime"),
            F.sum("total_amount").alias("total_amount"),
            F.sum("row_count").alias("row_count"),
        ).select(*schema.names)
        self._write(merged, "rows", number)
        stored = _Manifest({k: (number, 0) for k in chosen}, {}, latest, schema)
        new = customer_activity(self._read("rows", stored), [window]).select("customer_id", *FIGURES)
        self._write(new, "features", number)
        stored = _with_schemas(stored, schema, new.schema)
        counted = self._read("rows", stored).groupBy(self._bucket().alias("bucket")).count().collect()

        figures = F.struct(*FIGURES)
        old = self._read("features", _with_schemas(before, schema, new.schema), chosen)
        pairs = old.select("customer_id", figures.alias("old")).join(
            self._read("features", stored).select("customer_id", figures.alias("new")), "customer_id", "full"
        )
        changed_path = f"{self.folder}/changed/batch={number}"
        pairs.filter(~F.col("old").eqNullSafe(F.col("new"))).write.mode("overwrite").parquet(changed_path)
        changed = self.spark.read.schema(pairs.schema).parquet(changed_path)

        buckets = before.buckets | {r["bucket"]: (number, r["count"]) for r in counted}
        made = _Manifest(buckets, before.leaves, latest, schema, new.schema)
        leaves, n_leaves = tree.update(
            self.spark, self.folder, number, before.leaves, changed, lambda: self._read("features", made), self.leaf_values
        )
        self._note(_Manifest(buckets, leaves, latest, schema, new.schema), number)
        read = sum(before.buckets[k][1] for k in chosen if k in before.buckets)
        rows = self._with_age(changed.filter("new IS NOT NULL").select("customer_id", "new.*"), window)
        return rows, Report(number, tuple(chosen), read, n_leaves)

    def refresh(
        self,
        transactions: DataFrame,
        after_batch: Callable[[DataFrame, Report], None] | None = None,
        date_formats: Sequence[str] = (),
    ) -> None:
        """Process all files of a stream that have arrived since the last run, then stop.

        ``after_batch`` is given the feature rows that a batch has changed. A batch that is
        repeated after a failure passes the same rows again.
        """

        def store(batch: DataFrame, number: int) -> None:
            changed, report = self.update(batch, number)
            if after_batch is not None:
                after_batch(changed, report)

        query = (
            clean_transactions(drop_missing_tokens(transactions), date_formats)
            .writeStream.foreachBatch(store)
            .option("checkpointLocation", f"{self.folder}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def remove_unused(self) -> None:
        """Delete versions that the last manifest does not name; no query on the state may be running."""
        numbers = self._batches()
        if not numbers:
            return
        manifest = self._manifest()
        keep = {f"{kind}/batch={v}/bucket={k}" for kind in ("rows", "features") for k, (v, _) in manifest.buckets.items()}
        keep |= {leaf.path for leaves in manifest.leaves.values() for leaf in leaves}
        keep.add(f"manifest/batch={numbers[-1]}")
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        patterns = ["rows/batch=*/bucket=*", "features/batch=*/bucket=*", "leaves/batch=*/field=*/leaf=*", "manifest/batch=*", "arriving/batch=*", "changed/batch=*"]
        for pattern in patterns:
            path = hadoop.Path(f"{self.folder}/{pattern}")
            files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for found in files.globStatus(path) or ():
                name = "/".join(str(found.getPath()).split("/")[-(pattern.count("/") + 1) :])
                if name not in keep:
                    files.delete(found.getPath(), True)


def _with_schemas(manifest: _Manifest, rows: StructType, features: StructType | None) -> _Manifest:
    return _Manifest(manifest.buckets, manifest.leaves, manifest.latest, rows, features)
