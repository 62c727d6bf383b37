"""Join and membership helpers that stay balanced when one key holds most of the rows.

Adaptive execution splits a hot key only if both join inputs come straight from a shuffle. Here one
input is an aggregate, so rows of keys with more than a fixed share are dealt out over salts. The keys
come from a mergeable summary (`heavy`): either the caller has them from a pass made before, or the
summary is a subquery of the join's own plan, and no job runs before the join does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from patronlens.operators.heavy import HOT_SHARE, HeavyKeys, heavy_key_row

SALTS = 64


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys with more than ``share`` of the rows, as values; one narrow pass without a shuffle."""
    return heavy_key_row(df, key, share).head()[0]


def _is_hot(keys: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(keys, F.col(key)), F.lit(False))


def _copied(df: DataFrame, hot: Column) -> DataFrame:
    """A row for every salt for hot keys, one row else."""
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    return df.withColumn("_salt", F.explode(F.when(hot, every).otherwise(F.array(F.lit(0)))))


def _dealt(df: DataFrame, hot: Column) -> DataFrame:
    """Rows of hot keys under a salt by content and partition, so that equal rows spread too and a
    repeated task deals its rows as before."""
    salt = F.pmod(F.xxhash64(*df.columns) + F.spark_partition_id(), F.lit(SALTS)).cast("int")
    return df.withColumn("_salt", F.when(hot, salt).otherwise(0))


def _keys(df: DataFrame, key: str, known: HeavyKeys | bool | None, share: float) -> Column | None:
    """The hot keys of df as an array, None where there are none to care for."""
    if isinstance(known, HeavyKeys):
        return known.column(df.schema[key].dataType.simpleString()) if known.keys else None
    return None if known is False else heavy_key_row(df, key, share).scalar()


def join_unique(
    unique: DataFrame,
    other: DataFrame,
    key: str,
    how: str = "left",
    repeats: HeavyKeys | bool | None = None,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Left or inner join of a table that is unique on ``key`` with another that may repeat it.

    ``repeats`` holds the hot keys of ``other`` if an earlier pass over it has found them; without any it
    is a plain join. By default they are found in the plan of this join. The rows of a hot key in
    ``other`` are dealt out over salts, and its single partner row is copied to each of them, within
    one join over both inputs. Copies that met nothing go: a hot key has matches elsewhere. False
    promises that ``other`` does not repeat keys; the result is the same.
    """
    keys = _keys(other, key, repeats, share)
    if keys is None:
        return unique.join(other, key, how)
    hot = _is_hot(keys, key)
    found = _dealt(other, hot).withColumn("_found", F.lit(True))
    joined = _copied(unique, hot).join(found, [key, "_salt"], how)
    if how == "left":
        joined = joined.filter(F.col("_found") | ~_is_hot(keys, key))
    return joined.drop("_salt", "_found")


def flag_members(
    df: DataFrame,
    ids: DataFrame,
    key: str,
    flag: str,
    share: float = HOT_SHARE,
    repeats: HeavyKeys | bool | None = None,
) -> DataFrame:
    """Mark rows of ``df`` whose key occurs in ``ids``; rows of hot keys are dealt out over salts."""
    members = ids.select(key).distinct().withColumn("_member", F.lit(True))
    keys = _keys(df, key, repeats, share)
    if keys is None:
        marked = df.join(members, key, "left")
    else:
        hot = _is_hot(keys, key)
        marked = _dealt(df, hot).join(_copied(members, hot), [key, "_salt"], "left").drop("_salt")
    return marked.withColumn(flag, F.col("_member").isNotNull()).drop("_member")
