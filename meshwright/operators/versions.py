"""Two states of a table: what came, changed and went, and stamps that move only with their row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(columns: list[str]) -> Column:
    """A digest of a row's fields, nulls told from absent ones."""
    return F.md5(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def _fields(rows: DataFrame, keys: list[str]) -> list[str]:
    return [c for c in rows.columns if c not in (*keys, "created", "updated", "digest")]


def _one_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key; of several the one of the largest digest, whatever the partitioning."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("digest")).alias("x")).select(*keys, "x.*")


def stamped(rows: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """A first state: every row created and updated now, with its digest."""
    out = rows.withColumns({"digest": digest(_fields(rows, keys)), "created": now, "updated": now})
    return _one_each(out, keys)


def saved(before: DataFrame, rows: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """The stamped state `before` with `rows` saved over it: new rows are created now, rows of another digest updated now, equal ones keep both stamps.

    Rows that `rows` doesn't have stay as they are. Only digests and stamps of the old rows meet the new ones, by
    their keys (null keys are keys, too).
    """
    return _met(before, rows, keys, now).where("change <> 'deleted'").drop("change")


def changes(before: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and change, `inserted`, `changed` or `deleted`, of the rows in which a stamped state and `rows` differ."""
    met = _met(before, rows, keys, F.current_timestamp(), whole=True)
    return met.where("change <> 'same'").select(*keys, "change")


def _met(before: DataFrame, rows: DataFrame, keys: list[str], now: Column, whole: bool = False) -> DataFrame:
    fields = _fields(rows, keys)
    new = _one_each(rows.select(*keys, *fields).withColumn("digest", digest(fields)), keys)
    held = before.select(*(F.col(k).alias(f"__{k}") for k in keys), *(F.col(c).alias(f"__{c}") for c in ("digest", "created", "updated")), *([] if whole else [F.struct(*fields).alias("__row")]))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    both = new.withColumn("__new", F.lit(True)).join(held.withColumn("__old", F.lit(True)), on, "full_outer")
    is_new, is_old = F.col("__new").isNotNull(), F.col("__old").isNotNull()
    same = F.col("digest") == F.col("__digest")
    change = F.when(~is_old, "inserted").when(~is_new, "deleted" if whole else "kept").when(same, "same").otherwise("changed")
    key = [F.when(is_new, F.col(k)).otherwise(F.col(f"__{k}")).alias(k) for k in keys]
    if whole:
        return both.select(*key, change.alias("change"))
    value = [F.when(is_new, F.col(c)).otherwise(F.col(f"__row.{c}")).alias(c) for c in fields]
    created = F.when(is_old, F.col("__created")).otherwise(now).alias("created")
    updated = F.when(is_new & (~is_old | ~same), now).otherwise(F.col("__updated")).alias("updated")
    return both.select(*key, *value, F.coalesce("digest", "__digest").alias("digest"), created, updated, change.alias("change"))
