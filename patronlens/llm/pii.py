"""Personal data: generators propose spans, boosted trees score them, thresholds select.

All of it is DataFrame work. Generators are regular expressions with high recall: the four base
forms (email, ip, card, phone), and wider ones for disguised emails, IPv6 addresses written out in
eight groups (shortened ones with :: are not proposed), numbers without a plus sign and cards with other separators; their spans may overlap. Each span gets
format and context features. Gradient boosted trees learn on all proposed
spans, where the checks of the base form (range, checksum, digit count) or of IPv6, applied to the
plain form of the span, give the label, and damaged copies give further negatives. Forms that the corpus shows fewer than SEEDS
different valid spans of are taught by spans with serial numbers as well. A threshold for
each kind is calibrated on the part of the spans that the trees have not seen. Spans that
pass a base check always stay; others are added if their score reaches the threshold and they
overlap no base span and no added span before them.

Defined results: a null or empty text has no spans. Rows that agree in id and text each give
one result row. Positions count code points and ends are exclusive. Texts may hold control
characters; two of these mark matches and are treated as a third while matching. Other
columns play no part. No rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patronlens.llm.common import fresh, stored

KINDS = ("email", "ip", "card", "phone")
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"


@dataclass(frozen=True)
class Generator:
    kind: str
    guard: str  # a cheap condition on `text` that every match implies
    pattern: str
    base: bool = False


# Possessive forms of the base patterns: the same leftmost matches, but linear and without
# recursion. A match begins where its first run of characters begins or the last match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
_AT = r"(?: ?[\[({<] ?at ?[\])}>] ?| at )"
_IPV6 = "(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
_DOT = r"(?: ?[\[({<] ?dot ?[\])}>] ?| dot |\.)"
GENERATORS = (
    Generator("email", "contains(text, '@')",
              rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True),
    Generator("ip", r"text rlike '[0-9][.][0-9]'", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", True),
    Generator("card", r"text rlike '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'", r"[0-9](?:[ -]?+[0-9]){12,}+", True),
    Generator("phone", "contains(text, '+')", r"\+[0-9][ ().0-9-]+[0-9]", True),
    Generator("email", r"text rlike '(?i)[\\[({< ]at[\\])}> ]' AND text rlike '(?i)[\\[({< ]dot[\\])}> ]'",
              rf"(?i)(?<![a-z0-9._%+-])[a-z0-9][a-z0-9._%+-]{{0,63}}{_AT}[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{1,63}}){{1,4}}"),
    Generator("email", r"contains(text, '@ ') OR contains(text, ' @')",
              r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?@ ?[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,4}"),
    Generator("ip", r"text rlike '(?i)[0-9a-f]:[0-9a-f]'",
              r"(?i)(?<![0-9a-z:.])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-z:])"),
    Generator("card", r"text rlike '[0-9]{4}[._/][0-9]{4}'",
              r"(?<![0-9._/])[0-9]{4}(?:[._/][0-9]{2,7}){2,4}(?![0-9._/])"),
    Generator("phone", r"text rlike '[0-9]{3}[ .)-]+[0-9]{3}[ .-][0-9]{4}'",
              r"(?<![0-9+(.-])(?:00?[0-9]{0,3}[ .-])?\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
)
CONTEXT = 24  # characters before and after a span that features look at
#: Spans with serial numbers for each form that the corpus itself shows fewer different valid ones of.
SEEDS = 120
TREES, DEPTH = 8, 3
#: Added spans should be right at least this often on the calibration part.
PRECISION = 0.98
KEY = ["id", "text_hash"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Proposed spans: id, text_hash, gen, at, match, before, after, start, end, copies.

    gen counts the generators from 1. A row with gen 0 stands for the document itself.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    marked = F.contains(raw, F.lit(OPEN)) | F.contains(raw, F.lit(CLOSE))
    texts = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.when(marked, F.translate(raw, OPEN + CLOSE, OTHER + OTHER)).otherwise(raw).alias("text"),
    )
    sets = [F.struct(F.lit(0).alias("gen"), F.array(F.lit("")).alias("pieces"))]
    for number, generator in enumerate(GENERATORS, 1):
        cut = F.split(F.regexp_replace("text", generator.pattern, f"{OPEN}$0{CLOSE}"), OPEN, -1)
        pieces = F.when(F.expr(generator.guard), cut).otherwise(F.array(F.lit("")))
        sets.append(F.struct(F.lit(number).alias("gen"), pieces.alias("pieces")))
    # Outer forms, as the plain ones would let the optimiser repeat the matching in a filter.
    by_set = texts.select(*KEY, F.explode_outer(F.array(*sets)).alias("set")).where(
        "set.gen = 0 OR size(set.pieces) > 1"
    )
    pieces = by_set.select(*KEY, F.col("set.gen").alias("gen"), F.posexplode_outer("set.pieces").alias("at", "piece"))
    gap = F.substring_index("piece", CLOSE, -1)
    rows = pieces.select(
        *KEY, "gen", "at",
        F.when(F.col("at") > 0, F.substring_index("piece", CLOSE, 1)).alias("match"),
        F.length(gap).alias("gap"),
        F.right(gap, F.lit(CONTEXT)).alias("tail"),
        F.left(gap, F.lit(CONTEXT)).alias("after"),
    )
    # Equal rows of documents propose the same spans; they count once, and are repeated at the end.
    once = rows.groupBy(*KEY, "gen", "at").agg(
        F.first("match").alias("match"), F.first("gap").alias("gap"), F.first("tail").alias("tail"),
        F.first("after").alias("after"), F.count("*").alias("copies"),
    )
    order = Window.partitionBy(*KEY, "gen").orderBy("at")
    so_far = F.sum(F.col("gap") + F.coalesce(F.length("match"), F.lit(0))).over(order)
    placed = once.select(
        *KEY, "gen", "at", "match", "after", "copies",
        F.coalesce(F.lag("tail").over(order), F.lit("")).alias("before"),
        (so_far - F.col("gap")).alias("end"),
    ).withColumn("start", F.col("end") - F.length("match"))
    return placed.where("gen = 0 OR at > 0")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def base_check(kind: Column, match: Column) -> Column:
    """Whether a match of a base pattern, or the plain form of another, is valid."""
    digits = _digits(match)
    n = F.length(digits)
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (
        F.when(kind == "email", match.rlike(rf"\A{_LOCAL}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\z"))
        .when(kind == "ip", match.rlike(rf"\A{part}(?:\.{part}){{3}}\z"))
        .when(kind == "card", match.rlike(r"\A[0-9](?:[ -]?+[0-9])++\z") & n.between(13, 19)
              & F.call_function("luhn_check", F.when(n.between(13, 19), digits).otherwise(F.lit("1"))))
        .otherwise(match.rlike(r"\A\+[0-9][ ().0-9-]+[0-9]\z") & n.between(9, 15))
    )


def label_check(kind: Column, match: Column) -> Column:
    """Whether a plain form is valid: the base check, or an address of eight groups, which no base form has."""
    return base_check(kind, match) | ((kind == "ip") & match.rlike(rf"\A{_IPV6}\z"))


def plain_form(kind: Column, match: Column) -> Column:
    """A disguised span as its kind is usually written."""
    mail = F.regexp_replace(match, rf"(?i){_AT}| ?@ ?", "@")
    mail = F.regexp_replace(mail, rf"(?i){_DOT}", ".")
    return (
        F.when(kind == "email", mail)
        .when(kind == "card", F.regexp_replace(match, "[._/]", " "))
        .when((kind == "phone") & ~match.startswith("+"), F.concat(F.lit("+"), F.regexp_replace(match, "^[(0]+", "1")))
        .otherwise(match)
    )


def _featured(spans: DataFrame) -> DataFrame:
    """Columns f0, f1, ... from the span and what stands around it."""
    match, kind = F.col("match"), F.col("kind")
    digits = _digits(match)
    plain = plain_form(kind, match)
    last = F.right(F.col("before"), F.lit(1))
    first = F.left(F.col("after"), F.lit(1))
    words = {
        "email": "mail|contact|write|@", "ip": r"\bip\b|host|server|address",
        "card": "card|visa|credit|pay", "phone": "phone|tel|call|mobile|fax",
    }
    cue = F.lit(False)
    for name, pattern in words.items():
        cue = cue | ((kind == name) & F.lower("before").rlike(pattern))
    numbers = [
        *[(kind == name) for name in KINDS],
        F.length(match),
        F.length(digits),
        F.length(F.regexp_replace(match, "[^A-Za-z]", "")),
        F.length(F.regexp_replace(match, "[A-Za-z0-9]", "")),
        F.size(F.array_distinct(F.split(digits, ""))),
        # An IPv6 address with all its groups counts like four parts, so that the few trees need no split more.
        F.when((kind == "ip") & plain.rlike(rf"\A{_IPV6}\z"), 4).otherwise(F.size(F.split(plain, "[.]"))),
        F.when(F.length(digits).between(2, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False)),
        plain.rlike(r"(?:\A|[.])0*(?:[3-9][0-9]{2}|2[6-9][0-9]|25[6-9]|[0-9]{4,})(?:[.]|\z)"),
        plain.rlike(r"@[A-Za-z0-9-]+\.[A-Za-z]{2,}"),
        match.startswith("+"),
        last.rlike("[A-Za-z0-9]"), last.rlike(r"[\s(:\"']"), first.rlike("[A-Za-z0-9]"), first.rlike(r"[\s.,;)\"']"),
        cue,
        F.col("base"),
    ]
    return spans.select(
        "*", *[F.coalesce(n.cast("double"), F.lit(0.0)).alias(f"f{i}") for i, n in enumerate(numbers)]
    )


def _features(spans: DataFrame) -> DataFrame:
    featured = _featured(spans)
    names = [c for c in featured.columns if c.startswith("f") and c[1:].isdigit()]
    return VectorAssembler(inputCols=names, outputCol="features").transform(featured).drop(*names)


def _kind_of() -> tuple[Column, Column]:
    kind, base = F.lit(None).cast("string"), F.lit(False)
    for number, generator in enumerate(GENERATORS, 1):
        kind = F.when(F.col("gen") == number, F.lit(generator.kind)).otherwise(kind)
        base = F.when(F.col("gen") == number, F.lit(generator.base)).otherwise(base)
    return kind, base


def _seeds(spark: SparkSession) -> DataFrame:
    """Spans of each kind with serial numbers, so that a corpus without them can teach all kinds too."""
    texts = [
        ("email", True, "concat('user', id, '@mail', id % 7, '.example.com')"),
        ("email", False, "concat('user', id, ' [at] mail', id % 7, ' [dot] com')"),
        ("ip", True, "concat_ws('.', 11 + id, 7 * id % 256, 31 * id % 256, 1 + id)"),
        ("ip", False, "concat_ws(':', '2001', 'db8', lower(hex(7 * id)), hex(31 * id), '0', hex(257 * id), '0', hex(1 + id))"),
        ("card", True, "concat_ws(' ', 4000 + 37 * id, 1000 + 91 * id, 1000 + 73 * id, 1000 + 17 * id)"),
        ("card", False, "concat_ws('.', 4000 + 37 * id, 1000 + 91 * id, 1000 + 73 * id, 1000 + 17 * id)"),
        ("phone", True, "concat('+1 (', 200 + 5 * id, ') 555-', 1000 + 61 * id)"),
        ("phone", False, "concat(200 + 5 * id, '-555-', 1000 + 61 * id)"),
    ]
    kinds = F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), F.expr(text).alias("match"))
        for kind, base, text in texts
    ]))
    return spark.range(SEEDS).select(kinds.alias("s")).select("s.*", F.lit(" ").alias("before"), F.lit(" ").alias("after"))


def _valid(kind: Column, match: Column) -> Column:
    return F.coalesce(label_check(kind, plain_form(kind, match)), F.lit(False))


def _with_seeds(spans: DataFrame) -> DataFrame:
    """The spans, and seeds of the forms that they show too few valid ones of."""
    own = spans.select("kind", "base", "match", "before", "after")
    shown = own.where(_valid(F.col("kind"), F.col("match"))).groupBy("kind", "base").agg(F.count_distinct("match").alias("n"))
    shown = F.broadcast(shown.where(F.col("n") >= SEEDS).select("kind", "base"))
    seeds = _seeds(spans.sparkSession).join(shown, ["kind", "base"], "left_anti")
    return own.unionByName(seeds.select(own.columns))


def train(spans: DataFrame) -> tuple[GBTClassificationModel, dict[str, float]] | None:
    """The trees and the threshold of each kind, or None if there is nothing to learn from."""
    sample = _with_seeds(spans)
    match = F.col("match")
    damaged = [
        F.concat(F.lit("9"), match),
        F.substring(match, 3, 1_000_000),
        F.expr("substring(match, 1, length(match) - 3)"),
        F.regexp_replace(match, "[.]([A-Za-z0-9-]+)$", ".$1.$1.$1.999"),
    ]
    every = sample.withColumn("match", F.explode(F.array(match, *damaged)))
    every = every.where(F.length("match") > 0).withColumn("label", _valid(F.col("kind"), match).cast("double"))
    part = F.pmod(F.xxhash64("match"), F.lit(4))
    every = stored(_features(every.withColumn("part", part)).select("kind", "base", "label", "part", "features"))
    classes = {r["label"]: r["n"] for r in every.where("part > 0").groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(classes) < 2:
        return None
    # Spark finds splits on a sample if there are more than 10,000 rows and more than the square of the bins.
    rows = sum(classes.values())
    bins = 32 if rows <= 10_000 else 1 + isqrt(rows)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, labelCol="label", maxBins=bins, cacheNodeIds=False)
    model = trees.fit(every.where("part > 0").coalesce(max(4, rows // 20_000)))
    scored = model.transform(every.where("part = 0")).select(
        "kind", "label", F.floor(vector_to_array("probability")[1] * 100).alias("score")
    )
    found = scored.groupBy("kind", "score").agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    thresholds = {}
    for kind in KINDS:  # at most 101 rows for each
        good = n = 0
        for row in sorted((r for r in found if r["kind"] == kind), key=lambda r: -r["score"]):
            good, n = good + row["good"], n + row["n"]
            if good >= PRECISION * n:
                thresholds[kind] = row["score"] / 100
    return model, thresholds


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Selected spans and one row with kind null for each document.

    id, text_hash, copies, kind, start, end, is_base.
    """
    kind, base = _kind_of()
    rows = stored(candidates(docs, id_col, text_col).withColumn("kind", kind).withColumn("base", base))
    spans = rows.where("gen > 0")
    learned = train(spans)
    own = rows.where("gen = 0").select(
        *KEY, "copies", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("start"),
        F.lit(None).cast("long").alias("end"), F.lit(None).cast("boolean").alias("is_base"),
    )
    valid = F.col("base") & F.coalesce(base_check(F.col("kind"), F.col("match")), F.lit(False))
    spans = spans.withColumn("is_base", valid)
    if learned is None:
        chosen = spans.where("is_base").withColumn("wanted", F.lit(True))
    else:
        model, thresholds = learned
        least = F.lit(2.0)
        for name, value in thresholds.items():
            least = F.when(F.col("kind") == name, F.lit(value)).otherwise(least)
        scored = model.transform(_features(spans)).withColumn("p", vector_to_array("probability")[1])
        chosen = scored.where(F.col("is_base") | (F.col("p") >= least))
    chosen = chosen.select(*KEY, "kind", F.col("start").cast("long"), F.col("end").cast("long"), "is_base").distinct()
    # Added spans give way to base spans and to added ones before them.
    whole = Window.partitionBy(*KEY).orderBy("start", F.desc("end"), "kind", F.desc("is_base"))
    past = whole.rowsBetween(Window.unboundedPreceding, -1)
    ahead = whole.rowsBetween(1, Window.unboundedFollowing)
    base_start = F.when(F.col("is_base"), F.col("start"))
    clear = (F.coalesce(F.max("end").over(past), F.lit(0)) <= F.col("start")) & (
        F.coalesce(F.min(base_start).over(ahead), F.col("end")) >= F.col("end")
    )
    kept = chosen.withColumn("clear", clear).where("is_base OR clear")
    return own.unionByName(
        kept.select(*KEY, F.lit(0).cast("long").alias("copies"), "kind", "start", "end", "is_base")
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: counts of the base spans, their digest, and all spans."""
    found = find_spans(docs, id_col, text_col)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct(rank.alias("rank"), F.col("start"), F.col("end"), F.col("kind"))
    counted = found.groupBy(*KEY).agg(
        F.max("copies").alias("copies"),
        *[F.sum((F.col("is_base") & (F.col("kind") == k)).cast("long")).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.when(F.col("is_base"), span))).alias("base_spans"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("all_spans"),
    )

    def text_of(column: str) -> Column:
        return F.expr(f"array_join(transform({column}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")

    return counted.select(
        "id", "text_hash",
        *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(text_of("base_spans"), 256).alias("base_sha256"),
        text_of("all_spans").alias("spans"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every selected span replaced by its kind in brackets; overlapping spans become one."""
    found = find_spans(docs, id_col, text_col).where("kind IS NOT NULL")
    order = Window.partitionBy(*KEY).orderBy("start", F.desc("end"), "kind")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = (F.coalesce(before, F.lit(0)) <= F.col("start")).cast("int")
    merged = (
        found.withColumn("run", first)
        .withColumn("run", F.sum("run").over(order))
        .groupBy(*KEY, "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind"))
    )
    names = {c: fresh(docs.columns, f"pii_{c}") for c in ("id", "hash", "spans")}
    per_doc = merged.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias(names["spans"])
    ).select(F.col("id").alias(names["id"]), F.col("text_hash").alias(names["hash"]), names["spans"])
    joined = docs.join(
        per_doc,
        docs[id_col].eqNullSafe(per_doc[names["id"]]) & (F.xxhash64(docs[text_col]) == per_doc[names["hash"]]),
        "left",
    )
    s, t = f"`{names['spans']}`", f"`{text_col}`"
    ends = f"IF(i = 0, 0L, element_at({s}, i).end)"
    cut = F.expr(
        f"concat(array_join(transform({s}, (s, i) -> concat(substring({t}, cast({ends} + 1 AS int),"
        f" cast(s.start - {ends} AS int)), '[', upper(s.kind), ']')), ''),"
        f" substring({t}, cast(element_at({s}, -1).end + 1 AS int)))"
    )
    return joined.withColumn(text_col, F.when(F.col(names["spans"]).isNotNull(), cut).otherwise(F.col(text_col))).select(docs.columns)
