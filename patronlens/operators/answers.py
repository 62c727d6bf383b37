"""Answers to a table of questions, routed by keywords.

Everything an answer needs is a handful of texts and one short list of counts, so it enters
the message job as constants: the message table is neither shuffled nor joined, whatever
its size.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from patronlens import fixed_values as fixed
from patronlens.operators.anchor import Window
from patronlens.operators.insights import test_position


@dataclass(frozen=True)
class AnswerContext:
    """``active[d]`` is the number of customers active in the last d days."""

    active: Sequence[int]
    facts: Sequence[str]
    insights: Sequence[tuple[str, str, str]]
    significant: Sequence[tuple[str, float]]


def normalised_message(message: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(message, F.lit("")), r"^\s+|\s+$", ""))


def requested_days(days: Column) -> Column:
    """The asked window; null and 0 mean the default. No range check here."""
    return F.coalesce(F.nullif(days.cast("int"), F.lit(0)), F.lit(fixed.DEFAULT_DAYS))


def active_by_days(features: DataFrame, window: Window) -> DataFrame:
    """Rows (d, n): customers whose last order is reached by exactly d days and no fewer.

    Each message may ask for its own window, but of all facts only the active count depends
    on it, and a running sum over these rows answers every window at once. There are at
    most as many rows as days of history.
    """
    age = window.end - F.col("last_order")
    whole = F.date_part(F.lit("DAY"), age).cast("int")
    reach = F.when(age > F.make_dt_interval(whole), whole + 1).otherwise(whole)
    return features.groupBy(reach.alias("d")).agg(F.count("*").alias("n"))


def answer_context(
    features: DataFrame,
    window: Window,
    facts: DataFrame,
    insights: DataFrame,
    tests: DataFrame,
    test_order: Sequence[str] = (),
) -> AnswerContext:
    """Gather the ingredients of every answer; each of them is bounded by design."""
    reached = {row["d"]: row["n"] for row in active_by_days(features, window).collect()}
    active, total = [], 0
    for d in range(max(reached, default=0) + 1):
        total += reached.get(d, 0)
        active.append(total)
    place = test_position(test_order, F.col("name"))
    significant = tests.filter(F.col("result") == "significant").orderBy(place, "name").limit(1)
    shown = insights.select("title", "evidence", "recommendedAction")
    return AnswerContext(
        active=active,
        facts=facts.head()["facts"],
        insights=[tuple(row) for row in shown.collect()],
        significant=[(row["name"], row["pValue"]) for row in significant.collect()],
    )


def _first(texts: Sequence[str], start: str) -> str | None:
    return next((t for t in texts if t.lower().startswith(start)), None)


def _churn_answer(context: AnswerContext) -> str:
    about = [i[1:] for i in context.insights if re.search("at-risk|churn", i[0].lower())]
    fact = _first(context.facts, "churn-risk")
    return " ".join([*([fact] if fact else []), *(about[0] if about else [])])


def _test_answer(context: AnswerContext) -> str:
    if not context.significant:
        return fixed.NO_TEST_ANSWER
    name, p = context.significant[0]
    return fixed.TEST_ANSWER % (name, f"{p:.4f}")


def _active_count(context: AnswerContext, days: Column) -> Column:
    """Look up the count; windows beyond the history contain every customer."""
    counts = F.split(F.lit(",".join(map(str, context.active))), ",").cast("array<bigint>")
    last = len(context.active) - 1
    found = F.element_at(counts, F.least(F.greatest(days, F.lit(0)), F.lit(last)) + 1)
    return F.when(days >= 0, found).otherwise(F.lit(0))


def answer_questions(
    messages: DataFrame,
    context: AnswerContext,
    text: str = "message",
    days: str | None = None,
) -> DataFrame:
    """Add ``intent`` and ``answer`` to every message; the first matching rule wins.

    Words are plain substrings: 'inactive' asks about active customers, 'latest' about tests.
    """
    message = normalised_message(F.col(text))
    asked = requested_days(F.col(days)) if days else F.lit(fixed.DEFAULT_DAYS)
    bullets = " ".join(
        fixed.SUMMARY_BULLET % insight for insight in context.insights[: fixed.SUMMARY_INSIGHTS]
    )
    retention = _first(context.facts, "retention rate")
    active = F.format_string(fixed.ACTIVE_FACT, _active_count(context, asked).cast("string"))
    summary = F.format_string(fixed.SUMMARY_ANSWER, asked.cast("string"), F.lit(bullets))

    rules = [("active", ["active"], active)]
    if retention:
        rules.append(("retention", ["retention"], F.lit(retention)))
    rules.append(("churn", ["churn", "at risk"], F.lit(_churn_answer(context))))
    rules.append(("test", ["test", "significant"], F.lit(_test_answer(context))))
    rules.append(
        ("summary", [""], summary)
        if context.insights
        else ("fallback", [""], F.lit(fixed.FALLBACK_ANSWER))
    )
    intent, answer = F, F
    for name, words, reply in rules:
        says = F.lit(False)
        for word in words:
            says = says | F.col("_message").contains(word)
        intent, answer = intent.when(says, name), answer.when(says, reply)
    return messages.withColumn("_message", message).select(
        *messages.columns, intent.alias("intent"), answer.alias("answer")
    )
