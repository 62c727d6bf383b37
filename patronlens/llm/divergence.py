"""How the sources of a language differ in their words: pairs of sources, and the terms each has more of.

A term is a run of letters (A-Z in lower case, every character beyond ASCII counts as one). A language
keeps the terms in at least `min_docs` of its documents. A group (language, source), and a language as a
whole, gives each kept term p = 1 + floor(10^9 (count + 2) / (N + 2 V)), N being the sum of its counts over
the V kept terms. Two values differ by f = floor((p - q)^2 / (p + q)). Everything is in whole numbers.

`pairs` sums f over all kept terms for every two sources. Counts are laid out as blocks of terms by
blocks of sources and each block is worked out with numpy, so no pair is ever a row for a term, and
the terms that neither block holds are added as one product.

`leading_terms` ranks the terms of a group above its language by f. It reads them through a dominance
skyband: f rises with the count in the group and falls with that in the language, and equal values rank by
UTF-8, so a term with k others of a higher or equal group count, a lower or equal language count and an
earlier place in UTF-8 cannot be among the first k. Every task keeps the terms with fewer than k such
others among its own, these are merged in two steps, and what is left is ranked exactly. A task holds
`RUN` rows at a time; terms of which hardly any dominates another pass on unreduced, not dropped.

Defined results: null text, language and source are ''. A row is a document, so repeated rows and rows
that share an id count each. Groups without terms take part. Very long texts count whole. Ties rank by
UTF-8. No rows give no result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patronlens.llm.common import stored

MIN_DOCS = 10
SCALE = 1_000_000_000
FLUSH_TERMS = 500_000  # terms a task holds before it hands their counts on
BLOCK_TERMS, BLOCK_SOURCES = 2048, 128
RUN = 50_000
SALTS = 16
EXACT = (1 << 63) // SCALE - 2  # counts that 64 bits can scale
LETTERS = bytes((b | 32 if b < 128 else b) if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), and an empty term for each group, counted in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, in_docs) in held.items():
                keys = [b"", *n]
                yield pa.record_batch(
                    [
                        pa.repeat(lang, len(keys)), pa.repeat(source, len(keys)),
                        pa.array(keys, pa.binary()), pa.array([0, *n.values()], pa.int64()),
                        pa.array([0, *map(in_docs.__getitem__, n)], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(column.to_pylist() for column in batch.columns)):
                n, in_docs = held.setdefault((lang, source), (Counter(), Counter()))
                found, before = terms(text), len(n)
                n.update(found)
                in_docs.update(set(found))
                size += len(n) - before
                if size > FLUSH_TERMS:
                    yield from flush()
                    size = 0
        yield from flush()

    sent = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    sent = sent.withColumn("text", F.col("text").cast("binary"))
    partial = sent.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    partial = partial.withColumn("term", F.col("term").cast("string"))
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): counts of the kept terms that a group has (lang, source, term, g, l, l being the
    count in the language), and a row for each group (lang, source, total, lang_total, v, n_sources)."""
    counts = stored(term_counts(docs))
    named = counts.where("term <> ''")
    kept = named.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("l"), F.min("source").alias("first")
    )
    kept = kept.where(F.col("docs") >= min_docs).drop("docs")
    rows = named.join(kept, ["lang", "term"]).select(
        "lang", "source", "term", F.col("n").alias("g"), "l", (F.col("source") == F.col("first")).alias("counted")
    )
    rows = stored(rows)
    totals = rows.groupBy("lang", "source").agg(F.sum("g").alias("total"), F.count_if("counted").alias("own"))
    groups = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0)
    langs = groups.groupBy("lang").agg(
        F.sum("total").alias("lang_total"), F.sum("own").alias("v"), F.count("*").alias("n_sources")
    )
    return rows.drop("counted"), stored(groups.drop("own").join(langs, "lang"))


def _share(count: Column, total: Column, v: Column) -> Column:
    """p, in 64 bits where they suffice and in decimals beyond."""
    wide = F.call_function("div", (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + 2 * v).cast("decimal(19,0)"))
    return 1 + F.when(count <= EXACT, F.call_function("div", (count + 2) * SCALE, total + 2 * v)).otherwise(wide)


def _difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _with_totals(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The figures of its group with each row; groups are copied to salts, as one may hold most rows."""
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")
    return rows.withColumn("salt", salt).join(salted, ["lang", "source", "salt"]).drop("salt")


def skyband(g: np.ndarray, l: np.ndarray, names: list[str], k: int) -> np.ndarray:
    """Positions of the terms that fewer than k others dominate: g at least as high, l at most as high,
    and a name earlier in UTF-8."""
    place = np.empty(len(g), np.int64)
    place[sorted(range(len(g)), key=lambda i: names[i].encode())] = np.arange(len(g))
    order = np.lexsort((place, l, -g))  # whatever dominates a term comes before it
    l, place = l[order], place[order]
    kept = np.empty(0, np.int64)
    for at in range(0, len(order), 512):
        now = np.arange(at, min(at + 512, len(order)))
        above = np.zeros(len(now), np.int64)
        for part in range(0, len(kept), 8192):  # only kept terms need to be counted
            other = kept[part : part + 8192]
            above += ((l[other] <= l[now, None]) & (place[other] < place[now, None])).sum(1)
        within = (l[now] <= l[now, None]) & (place[now] < place[now, None])
        new = np.zeros(len(now), bool)
        for i in np.flatnonzero(above < k):
            new[i] = above[i] + (within[i, :i] & new[:i]).sum() < k
        kept = np.concatenate([kept, now[new]])
    return np.sort(order[kept])


def _skybands(rows: DataFrame, k: int) -> DataFrame:
    """The skyband of what each task has of each group; rows (lang, source, term, g, l, f)."""
    schema = "lang string, source string, term string, g long, l long, f long"

    def reduce(table: pa.Table) -> pa.Table:
        g, l = (table.column(c).to_numpy() for c in ("g", "l"))
        return table.take(pa.array(skyband(g, l, table.column("term").to_pylist(), k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], pa.Table] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(table.column("lang").to_pylist(), table.column("source").to_pylist()))
            places: dict[tuple[str, str], list[int]] = {}
            for i, key in enumerate(keys):
                places.setdefault(key, []).append(i)
            for key, own in places.items():
                part = table.take(pa.array(own))
                held[key] = pa.concat_tables([held[key], part]) if key in held else part
            if sum(t.num_rows for t in held.values()) > RUN:
                held = {key: reduce(t) for key, t in held.items()}
                if sum(t.num_rows for t in held.values()) > RUN // 2:
                    for t in held.values():
                        yield from t.combine_chunks().to_batches()
                    held = {}
        for t in held.values():
            yield from reduce(t.combine_chunks()).to_batches()

    return rows.select("lang", "source", "term", "g", "l", "f").mapInArrow(run, schema)


def leading_terms(rows: DataFrame, groups: DataFrame, k: int = 10) -> DataFrame:
    """(lang, source, item, value, rank): the k terms by which a group most exceeds its language."""
    full = _with_totals(rows, groups)
    full = full.withColumn("p", _share(F.col("g"), F.col("total"), F.col("v")))
    full = full.withColumn("q", _share(F.col("l"), F.col("lang_total"), F.col("v"))).where("p > q")
    found = _skybands(full.withColumn("f", _difference(F.col("p"), F.col("q"))), k)
    found = _skybands(found.repartition("lang", "source", F.pmod(F.xxhash64("term"), F.lit(SALTS))), k)
    found = _skybands(found.repartition("lang", "source"), k)
    return _ranked(found.select("lang", "source", F.col("term").alias("item"), F.col("f").alias("value"))).where(
        F.col("rank") <= k
    )


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language, the most different first."""
    block = F.pmod(F.xxhash64("source"), F.ceil(F.col("n_sources") / BLOCK_SOURCES))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("v") / BLOCK_TERMS))
    given = groups.select(
        "lang", "source", "total", "v", block.alias("block"), F.ceil(F.col("n_sources") / BLOCK_SOURCES).alias("blocks"),
        buckets.alias("buckets"),
    )
    marks = given.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1)))
    marks = marks.withColumn("term", F.lit(None).cast("string")).withColumn("g", F.lit(0).cast("long"))
    full = _with_totals(rows.select("lang", "source", "term", "g"), given)
    full = full.withColumn("bucket", F.pmod(F.xxhash64("term"), F.col("buckets")))
    both = full.unionByName(marks).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = both.select(
        "lang", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "source", "term", "g", "total", "v",
    )

    def work(table: pa.Table) -> pa.Table:
        mark = table.filter(table.column("term").is_null())
        sources = mark.column("source").to_pylist()
        index = {s: x for x, s in enumerate(sources)}
        total = np.array(mark.column("total").to_pylist(), object)
        v, own = table.column("v")[0].as_py(), mark.column("block").to_numpy()
        seen = table.filter(table.column("term").is_valid())
        coded = seen.column("term").combine_chunks().dictionary_encode()
        counts = np.zeros((len(coded.dictionary), len(sources)), np.int64)
        counts[coded.indices.to_numpy(), [index[s] for s in seen.column("source").to_pylist()]] = seen.column("g").to_numpy()
        if counts.max(initial=0) > EXACT or total.max(initial=0) + 2 * v >= 1 << 63:
            counts = counts.astype(object)  # beyond 64 bits: whole numbers of any size
        else:
            total = total.astype(np.int64)
        p = (1 + SCALE * (counts + 2) // (total + 2 * v)).astype(np.int64) if len(counts) else counts
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right, value = [], [], []
        for a in np.flatnonzero(own == i):
            b = np.flatnonzero((own == j) & ((i != j) | (np.arange(len(own)) > a)))
            d, s = p[:, b] - p[:, [a]], p[:, b] + p[:, [a]]
            value += (d * d // s).sum(0).tolist() if len(counts) else [0] * len(b)
            left += [a] * len(b)
            right += b.tolist()
        total = total.astype(np.int64)
        return pa.table({
            "lang": pa.array([table.column("lang")[0].as_py()] * len(left), pa.string()),
            "a": pa.array([sources[x] for x in left], pa.string()),
            "b": pa.array([sources[x] for x in right], pa.string()),
            "a_total": pa.array(total[left], pa.int64()),
            "b_total": pa.array(total[right], pa.int64()),
            "v": pa.array([v] * len(left), pa.int64()),
            "seen": pa.array([len(counts)] * len(left), pa.int64()),
            "value": pa.array(value, pa.int64()),
        })

    schema = "lang string, a string, b string, a_total long, b_total long, v long, seen long, value long"
    parts = both.groupBy("lang", "bucket", "i", "j").applyInArrow(work, schema)
    sums = parts.groupBy("lang", "a", "b").agg(
        *[F.max(c).alias(c) for c in ("a_total", "b_total", "v")], F.sum("seen").alias("seen"), F.sum("value").alias("value")
    )
    none = F.lit(0).cast("long")
    apart = _difference(_share(none, F.col("a_total"), F.col("v")), _share(none, F.col("b_total"), F.col("v")))
    rest = F.when(F.col("v") > F.col("seen"), (F.col("v") - F.col("seen")) * apart).otherwise(0)
    sums = sums.withColumn("value", F.col("value") + rest)
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return _ranked(sums.select("lang", ways.alias("way"), "value").select("lang", "way.*", "value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank), part being 'pair' or 'term'."""
    rows, groups = kept_counts(docs, min_docs)
    both = pairs(rows, groups).withColumn("part", F.lit("pair")).unionByName(
        leading_terms(rows, groups, k).withColumn("part", F.lit("term"))
    )
    return both.select("lang", "source", "part", "item", "value", "rank")
