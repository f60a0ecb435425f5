"""Analytics over documents, chunks and run metrics: each report is one aggregation of each table, side by side in one row.

``period``: (start, end), both ends included, or None for all rows. ``now`` is always an argument.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions.numbers import percent, round_js, to_fixed
from textquarry.operators.quality import in_band

Period = tuple[datetime, datetime] | None

#: States of a chunk's copy in the vector store, size from which a chunk is oversized.
SYNC_STATES = ("PENDING", "SYNCED", "FAILED")
OVERSIZED = 1500
STAGES = ("conversion_time_ms", "chunking_time_ms", "embedding_time_ms", "total_time_ms", "queue_time_ms", "user_wait_time_ms")


def period_range(name: str, now: datetime) -> tuple[datetime, datetime]:
    """24h, 7d and 30d back from now; ``all`` goes back to the same day and time of the year 2000, no further."""
    if name == "all":
        return now.replace(year=2000), now
    return now - {"24h": timedelta(hours=24), "7d": timedelta(days=7), "30d": timedelta(days=30)}[name], now


def within(df: DataFrame, period: Period, ts: str = "created_at") -> DataFrame:
    return df if period is None else df.where(F.col(ts).between(*map(F.lit, period)))


def beside(*rows: DataFrame) -> DataFrame:
    """One row of the columns of several one-row frames."""
    names = [n for r in rows for n in r.columns]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return together.agg(*[F.max(F.col(n)).alias(n) for n in names])


def mean(c: str) -> Column:
    """Rounded mean, 0 where there is none."""
    return round_js(F.coalesce(F.avg(c), F.lit(0.0))).alias(f"avg_{c}")


def overview(documents: DataFrame, chunks: DataFrame, metrics: DataFrame, period: Period = None) -> DataFrame:
    """Totals, success rate and means of a period, and how many chunks wait for the vector store in all."""
    done, failed = F.count_if(F.col("status") == "COMPLETED"), F.count_if(F.col("status") == "FAILED")
    rate = F.when(done + failed > 0, to_fixed(done / (done + failed) * 100, 2)).otherwise(0.0)
    d = within(documents, period).agg(done.alias("total_documents"), rate.alias("success_rate"))
    # one pass over the chunks: those of the period, and states of all
    inside = F.lit(True) if period is None else F.coalesce(F.col("created_at").between(*map(F.lit, period)), F.lit(False))
    c = chunks.agg(F.count_if(inside).alias("total_chunks"), *[F.count_if(F.col("sync_status") == s).alias(f"sync_{s.lower()}") for s in SYNC_STATES])
    m = within(metrics, period).agg(
        *map(mean, ("total_time_ms", "queue_time_ms", "user_wait_time_ms")),
        to_fixed(F.coalesce(F.avg("avg_quality_score"), F.lit(0.0)), 3).alias("avg_quality_score"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
    )
    return beside(d, c, m)


def format_counts(documents: DataFrame, period: Period = None) -> DataFrame:
    return within(documents, period).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


def sync_counts(chunks: DataFrame) -> DataFrame:
    """(sync_status, n) of each state, 0 where no chunk has it; other states and null are left out."""
    row = chunks.agg(*[F.count_if(F.col("sync_status") == s).alias(s) for s in SYNC_STATES])
    return row.select(F.inline(F.array(*[F.struct(F.lit(s).alias("sync_status"), F.col(s).alias("n")) for s in SYNC_STATES])))


def of_format(metrics: DataFrame, documents: DataFrame, fmt: str | None) -> DataFrame:
    """Metrics of documents of a format: a semi-join."""
    return metrics if fmt is None else metrics.join(documents.where(F.col("format") == fmt).select(F.col("id").alias("document_id")), "document_id", "left_semi")


def processing(metrics: DataFrame, documents: DataFrame, period: Period = None, fmt: str | None = None) -> DataFrame:
    """Stage means, share of recognised text, conversion time a page."""
    m = of_format(within(metrics, period), documents, fmt)
    total, pages = F.coalesce(F.sum("conversion_time_ms"), F.lit(0)), F.coalesce(F.sum("page_count"), F.lit(0))
    return m.agg(
        F.count(F.lit(1)).alias("documents_processed"),
        percent(F.count_if("ocr_applied"), F.count(F.lit(1))).alias("ocr_usage_percent"),
        F.when(pages > 0, round_js(total / pages)).otherwise(F.lit(0).cast("long")).alias("avg_conversion_time_per_page"),
        *map(mean, STAGES),
    )


def trends(metrics: DataFrame, documents: DataFrame, period: Period = None, unit: str = "day", fmt: str | None = None) -> DataFrame:
    """(date, n, means) by hour or day, ascending; days without runs are left out, and so are metrics without a document."""
    d = documents.select(F.col("id").alias("document_id"), "format")
    m = within(metrics, period).join(d if fmt is None else d.where(F.col("format") == fmt), "document_id")
    return m.groupBy(F.date_trunc(unit, "created_at").alias("date")).agg(F.count(F.lit(1)).alias("n"), mean("total_time_ms"), mean("queue_time_ms")).orderBy("date")


def quality(chunks: DataFrame, metrics: DataFrame, period: Period = None) -> DataFrame:
    """Bands, mean score, flag rates, share of chunks with context, tokens a chunk."""
    s = F.col("quality_score")
    c = within(chunks, period).agg(
        F.count("quality_score").alias("total_chunks"),
        to_fixed(F.coalesce(F.avg(s), F.lit(0.0)), 3).alias("avg_quality_score"),
        *[F.count_if(in_band(s, b)).alias(b) for b in ("excellent", "good", "low")],
        percent(F.count_if(F.size("breadcrumbs") > 0), F.count(F.lit(1))).alias("context_injection_rate"),
    )
    total, tokens = F.coalesce(F.sum("total_chunks"), F.lit(0)), F.coalesce(F.sum("total_tokens"), F.lit(0))
    flag = lambda f: F.coalesce(F.sum(F.element_at("quality_flags", f)), F.lit(0))
    m = within(metrics, period).agg(
        *[percent(flag(f), total).alias(n) for f, n in (("FRAGMENT", "fragment_rate"), ("NO_CONTEXT", "no_context_rate"), ("TOO_SHORT", "too_short_rate"))],
        F.when(total > 0, round_js(tokens / total)).otherwise(F.lit(0).cast("long")).alias("avg_tokens_per_chunk"),
    )
    return beside(c, m)


def flag_counts(metrics: DataFrame, period: Period = None) -> DataFrame:
    """(flag, n): documents' histograms of flags added up."""
    return within(metrics, period).select(F.explode("quality_flags").alias("flag", "n")).groupBy("flag").agg(F.sum("n").alias("n"))


def chunk_metrics(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Of each document: chunks, mean length, oversized ones, by raw lengths."""
    n = F.length(F.coalesce("content", F.lit("")))
    return chunks.groupBy(key).agg(F.count(F.lit(1)).alias("total_chunks"), F.avg(n).alias("avg_chunk_size"), F.count_if(n > OVERSIZED).alias("oversized_chunks"))


def quality_summary(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """Of each document: mean of the known scores (0 without any), its histogram of flags, tokens. Flags are counted before they are gathered, so a
    map has as many entries as there are kinds of flags."""
    base = chunks.groupBy(key).agg(F.coalesce(F.avg("quality_score"), F.lit(0.0)).alias("avg_quality_score"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"))
    counts = chunks.select(key, F.explode("quality_flags").alias("flag")).groupBy(key, "flag").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("flag", "n")))).alias("quality_flags"))
    return base.join(maps, key, "left").withColumn("quality_flags", F.coalesce("quality_flags", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))))


def stage_times(df: DataFrame, conversion: str = "conversion_time_ms", pipeline: str = "pipeline_time_ms", embedding: str = "embedding_time_ms") -> DataFrame:
    """chunking_time_ms (what the pipeline took beyond embedding, not under 0) and total_time_ms, whole milliseconds."""
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0))
    df = df.withColumn("chunking_time_ms", F.greatest(F.lit(0).cast("long"), whole(pipeline) - whole(embedding)))
    return df.withColumn("total_time_ms", whole(conversion) + F.col("chunking_time_ms") + whole(embedding))


def dashboard(documents: DataFrame, chunks: DataFrame, metrics: DataFrame, period: Period = None) -> DataFrame:
    """The most frequent format, its share of the completed documents (it counts all, so the share may pass 100), and chunking time a scored chunk."""
    top = format_counts(documents, period).agg(F.max_by("format", F.struct("n", "format")).alias("top_format"), F.max("n").alias("top_n"))
    d = within(documents, period).agg(F.count_if(F.col("status") == "COMPLETED").alias("done"))
    c = within(chunks, period).agg(F.count("quality_score").alias("chunks"))
    m = within(metrics, period).agg(F.count(F.lit(1)).alias("runs"), mean("chunking_time_ms"))
    each = F.when(F.col("chunks") > 0, round_js(F.col("avg_chunking_time_ms") * F.col("runs") / F.col("chunks"))).otherwise(F.lit(0).cast("long"))
    share = to_fixed(F.col("top_n") / F.greatest(F.col("done"), F.lit(1)) * 100, 0).cast("long")
    return beside(top, d, c, m).select("top_format", share.alias("top_format_percent"), each.alias("avg_chunking_time_per_chunk"))


def status_counts(documents: DataFrame) -> DataFrame:
    """Documents by state and by being active, of all documents, 0 where there are none."""
    s, active = F.col("status"), F.col("is_active")
    return documents.agg(*[F.count_if(s == x).alias(x.lower()) for x in ("PENDING", "PROCESSING", "COMPLETED", "FAILED")], F.count_if(active).alias("active"), F.count_if(~active).alias("inactive"))


def exposition(df: DataFrame, name: str, labels: list[str]) -> DataFrame:
    """A labelled counter as lines of text: ``name{label="value"} n``."""
    shown = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in labels])
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit(name + "{"), shown, F.lit("} "), F.col("n").cast("string")).alias("line"))
