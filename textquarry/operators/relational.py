"""Filters, joins, aggregations and pages over documents, chunks and run metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textquarry.functions.numbers import to_fixed


def contains_ci(c: Column, needle: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` are ordinary characters."""
    return F.lower(c).contains(needle.lower())


def any_of(c: Column, wanted: list[str]) -> Column:
    """Whether an array holds any of the wanted values, each trimmed; false for a null array."""
    return F.coalesce(F.arrays_overlap(F.array_compact(c), F.array(*[F.lit(w.strip()) for w in wanted])), F.lit(False))


def non_empty(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none."""
    return df.where(F.col(key) == F.lit(value))


def among(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows whose key is one of 1 to 100 ids."""
    if not 1 <= len(ids) <= 100:
        raise ValueError("1 to 100 ids")
    return df.where(F.col(key).isin(ids))


def first_match(df: DataFrame, condition: Column, *order: Column) -> DataFrame:
    """One row that meets a condition: the first by ``order``."""
    return df.where(condition).orderBy(*order).limit(1)


def batch(df: DataFrame, size: int, *order: Column) -> DataFrame:
    """The next ``size`` rows in a given order."""
    return df.orderBy(*order).limit(size)


def ordered(name: str, descending: bool) -> Column:
    """Nulls first in descending and last in ascending order, as the reference's store has them."""
    return F.col(name).desc_nulls_first() if descending else F.col(name).asc_nulls_last()


def nested(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, order: str, name: str) -> DataFrame:
    """Each parent with its children as an array in order; an empty one where it has none."""
    rows = children.select(child_key, F.struct(F.col(order).alias("__order"), F.struct(*[c for c in children.columns if c != child_key]).alias("row")).alias("x"))
    held = rows.groupBy(F.col(child_key).alias(parent_key)).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["row"]).alias(name))
    out = parents.join(held, parent_key, "left")
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(dict(held.dtypes)[name])))


def page(df: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> DataFrame:
    """One page in a total order (give a key last)."""
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1..100")
    return df.orderBy(*order).offset(offset).limit(limit)


def equal_filters(df: DataFrame, **wanted) -> DataFrame:
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def first_by_hash(df: DataFrame, content: str, key: str) -> DataFrame:
    """Each row with the least key that has its content's md5, and whether it is that one. Only what occurs several times is joined: a text
    that very many rows share is one row on the small side, and Spark splits its rows on the other."""
    digest = df.withColumn("md5", F.md5(F.col(content)))
    counts = digest.groupBy("md5").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return digest.join(counts, "md5", "left").withColumn("first_id", F.coalesce("first_id", key)).withColumn("is_first", F.col(key) == F.col("first_id"))


def with_child_count(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, name: str) -> DataFrame:
    """Parents with their number of children, 0 when none; children are counted before the join."""
    n = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.count(F.lit(1)).alias(name))
    return parents.join(n, parent_key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def snapshot_diff(remote: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """key, action: add, update, remove or skip."""
    r = remote.select(key, F.col(digest).alias("r"), F.lit(True).alias("in_r"))
    s = stored.select(key, F.col(digest).alias("s"), F.lit(True).alias("in_s")).where(F.col(key).isNotNull())
    both = r.join(s, key, "full_outer")
    action = F.when(F.col("in_s").isNull(), "add").when(F.col("in_r").isNull(), "remove").when(F.col("r").isNotNull() & ~F.col("r").eqNullSafe(F.col("s")), "update").otherwise("skip")
    return both.select(key, action.alias("action"))


def cascade_match(files: DataFrame, stored: DataFrame) -> DataFrame:
    """For each file (file_id, md5): the stored row by remote id, else by content, and what follows: reprocess where the content changed,
    restore where the row had been removed at the remote end, relink, else insert. A remote id or content that several rows have counts
    for the least of them, so files don't fan out."""
    rows = stored.select("id", "drive_file_id", "md5_hash", "status", "fail_reason")
    by_id = rows.where("drive_file_id IS NOT NULL").groupBy(F.col("drive_file_id").alias("file_id")).agg(F.min(F.struct("id", "md5_hash", "status", "fail_reason")).alias("a"))
    by_md5 = rows.where("md5_hash IS NOT NULL").groupBy(F.col("md5_hash").alias("md5")).agg(F.min("id").alias("id2"))
    x = files.join(by_id, "file_id", "left").join(by_md5, "md5", "left")
    known, removed = F.col("a").isNotNull(), (F.col("a.status") == "FAILED") & (F.col("a.fail_reason") == "REMOVED_FROM_DRIVE")
    changed = F.col("md5").isNotNull() & ~F.col("md5").eqNullSafe(F.col("a.md5_hash"))
    action = F.when(known & changed, "reprocess").when(known & F.coalesce(removed, F.lit(False)), "restore").when(known | F.col("id2").isNotNull(), "relink").otherwise("insert")
    return x.select("file_id", F.coalesce("a.id", "id2").alias("document_id"), action.alias("action"))


def bulk_outcome(spark, ids: list[int], stored: DataFrame, key: str, allowed: Column) -> DataFrame:
    """(pos, id, outcome) for each requested id in order, repeats kept; at most 100 ids."""
    if not 1 <= len(ids) <= 100:
        raise ValueError("1 to 100 ids")
    asked = spark.createDataFrame(list(enumerate(ids)), "pos int, id long")
    rows = stored.select(F.col(key).cast("long").alias("id"), allowed.alias("ok"))
    return asked.join(rows, "id", "left").select("pos", "id", F.when(F.col("ok").isNull(), "not_found").when(F.col("ok"), "done").otherwise("wrong_state").alias("outcome"))


def success_rate(done: Column, failed: Column) -> Column:
    """Percent with two decimals, 0 of nothing."""
    d, f = F.count_if(done), F.count_if(failed)
    return F.when(d + f > 0, to_fixed(d / (d + f) * 100, 2)).otherwise(0.0)


def trend(df: DataFrame, ts: str, unit: str, *aggs: Column) -> DataFrame:
    return df.groupBy(F.date_trunc(unit, F.col(ts)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), *aggs)


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts by bound, and +Inf; one pass."""
    row = df.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("inf"))
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    return row.select(F.inline(F.array(*cells, F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("n")))))


def map_sum(df: DataFrame, column: str) -> DataFrame:
    """Sums a map column by key."""
    return df.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("total"))


def last_state(df: DataFrame, key: str, *order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
