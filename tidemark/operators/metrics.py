"""Counters, rates, percentiles and their text exposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import escape_label, topic_label
from tidemark.model import MAX_TRACKED_TOPICS, OVERFLOW_TOPIC

#: Families of the exposition: suffix -> (help, kind).
FAMILIES = {
    "ingested_records_total": ("Records ingested, by topic", "counter"),
    "delivered_records_total": ("Records delivered to the sink, by topic", "counter"),
    "active_sse_subscribers": ("Active streaming subscribers", "gauge"),
    "uncommitted_records": ("Records pending delivery", "gauge"),
    "dropped_events_total": ("Events dropped for slow subscribers", "counter"),
    "ring_buffer_capacity": ("Capacity of the ring", "gauge"),
    "ring_buffer_count": ("Entries in the ring", "gauge"),
    "storage_disk_bytes": ("Size of the log files in bytes", "gauge"),
    "uncommitted_bytes": ("Serialized bytes not yet committed", "gauge"),
    "sink_flushes_total": ("Delivery attempts", "counter"),
    "sink_errors_total": ("Failed delivery attempts", "counter"),
    "sink_retries_total": ("Failures that are retried", "counter"),
    "engine_enqueued_total": ("Records accepted", "counter"),
    "engine_append_errors_total": ("Append errors", "counter"),
    "engine_spool_full_total": ("Records refused by capacity", "counter"),
    "engine_committed_records_total": ("Records committed", "counter"),
    "engine_delivery_attempts_total": ("Batches attempted", "counter"),
    "engine_retries_total": ("Retry cycles", "counter"),
    "engine_sink_errors_total": ("Delivery errors", "counter"),
    "engine_permanent_rejections_total": ("Batches rejected for good", "counter"),
    "engine_corrupt_skips_total": ("Corrupt records skipped", "counter"),
}
BY_TOPIC = ("ingested_records_total", "delivered_records_total")


def topic_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("topic").agg(F.count("*").alias("n"))


def capped_topic_counts(records: DataFrame, most: int = MAX_TRACKED_TOPICS) -> DataFrame:
    """Counts with bounded cardinality: long topics, and labels beyond the first ``most`` - 1 by arrival, are added up
    under the overflow label.  Only labels, not records, are ranked; the ones kept are at most ``most`` - 1 rows."""
    labels = records.groupBy(topic_label(F.col("topic")).alias("label")).agg(F.count("*").alias("n"), F.min("offset").alias("first"))
    known = labels.orderBy("first").limit(most - 1).select("label", F.lit(True).alias("known"))
    kept = labels.join(F.broadcast(known), "label", "left")
    return kept.groupBy(F.when(F.col("known"), F.col("label")).otherwise(OVERFLOW_TOPIC).alias("topic")).agg(F.sum("n").alias("n"))


def engine_counters(log: DataFrame) -> DataFrame:
    """One row of counters from a log of events: kind, records."""
    n = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("records"))), F.lit(0)).cast("long")
    e = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return log.agg(n("enqueued").alias("enqueued"), e("append_error").alias("append_errors"), e("full").alias("spool_full"), n("delivered", "permanent", "corrupt").alias("committed"), e("delivered", "transient", "permanent").alias("delivery_attempts"), e("transient").alias("retries"), e("transient", "permanent").alias("sink_errors"), e("permanent").alias("permanent_rejections"), e("corrupt").alias("corrupt_skips"))


def sink_counters(attempts: DataFrame) -> DataFrame:
    """One row: flushes, errors, retries from delivery attempts with an ``outcome``."""
    return attempts.agg(F.count("*").alias("flushes"), F.count_if(F.col("outcome") != "ok").alias("errors"), F.count_if(F.col("outcome") == "transient").alias("retries"))


def exposition(samples: DataFrame, prefix: str = "log") -> DataFrame:
    """family, topic (or null), value -> ``line`` in order ``pos``: families in their order, topics by bytes."""
    spark = samples.sparkSession
    rows = [(i, f, h, k, f in BY_TOPIC) for i, (f, (h, k)) in enumerate(FAMILIES.items())]
    heads = F.broadcast(spark.createDataFrame(rows, "f_pos int, family string, help string, kind string, by_topic boolean"))
    name = F.concat(F.lit(f"{prefix}_"), F.col("family"))
    label = F.when(F.col("topic").isNotNull(), F.concat(F.lit('{topic="'), escape_label(F.col("topic")), F.lit('"}'))).otherwise("")
    values = samples.join(heads, "family").select("f_pos", F.lit(2).alias("part"), F.coalesce("topic", F.lit("")).alias("topic"), F.concat(name, label, F.lit(" "), F.col("value").cast("string")).alias("line"))
    given = samples.select("family", F.lit(True).alias("given")).distinct()
    seen = heads.join(given, "family", "left").where("by_topic or given")
    text = [F.lit(0).alias("part"), F.lit("").alias("topic"), F.concat(F.lit("# HELP "), name, F.lit(" "), F.col("help")).alias("line")], [F.lit(1).alias("part"), F.lit("").alias("topic"), F.concat(F.lit("# TYPE "), name, F.lit(" "), F.col("kind")).alias("line")]
    out = values.unionByName(seen.select("f_pos", *text[0])).unionByName(seen.select("f_pos", *text[1]))
    # bounded: families, and topics under the cardinality cap
    w = Window.orderBy("f_pos", "part", "topic")
    return out.select((F.row_number().over(w) - 1).cast("long").alias("pos"), "line")


def scan_exposition(lines: DataFrame, prefix: str = "log") -> DataFrame:
    """One row of six numbers from exposition text (``line_no``, ``line``): delivered and sink errors are summed over
    labels, of the others the last counts; lines that aren't numbers are skipped."""
    text = F.trim(F.regexp_replace("line", r"[\t\r\n\f\v]+", " "))
    parts = F.split(text, " +")
    rows = lines.where((text != "") & ~text.startswith("#")).select("line_no", F.get(parts, 0).alias("name"), F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 1)).alias("raw"))
    v = F.col("raw").try_cast("long")
    rows = rows.where(F.col("raw").rlike(r"^[+-]?[0-9]+$") & v.isNotNull()).withColumn("v", v)
    at = lambda f: F.col("name").startswith(f"{prefix}_{f}")
    last = lambda f: F.coalesce(F.max_by(F.when(at(f), F.col("v")), F.when(at(f), F.col("line_no"))), F.lit(0))
    total = lambda f: F.coalesce(F.sum(F.when(at(f) & ~F.col("raw").startswith("-"), F.col("v"))), F.lit(0))
    return rows.agg(last("uncommitted_records").alias("uncommitted_records"), last("storage_disk_bytes").alias("storage_disk_bytes"), total("delivered_records_total").alias("delivered_total"), last("sink_flushes_total").alias("sink_flushes"), total("sink_errors_total").alias("sink_errors"), last("sink_retries_total").alias("sink_retries"))


def rates(samples: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """samples: t (seconds), total: ``rate`` since the sample before; after a counter reset the last rate stands."""
    w = Window.partitionBy(*by).orderBy("t")
    elapsed, gone = F.col("t") - F.lag("t").over(w), F.col("total") - F.lag("total").over(w)
    raw = samples.withColumn("_raw", F.when((elapsed > 0) & (gone >= 0), gone.cast("double") / elapsed))
    forward = w.rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("rate", F.coalesce(F.last("_raw", ignorenulls=True).over(forward), F.lit(0.0))).drop("_raw")


def history(samples: DataFrame, value: str = "rate", n: int = 60, by: tuple[str, ...] = ()) -> DataFrame:
    """Each sample with the last ``n`` values, itself included."""
    return samples.withColumn("history", F.collect_list(value).over(Window.partitionBy(*by).orderBy("t").rowsBetween(-(n - 1), 0)))


#: The eight levels of a sparkline, the lowest blank.
SPARKS = " ▂▃▄▅▆▇█"


def sparkline(values, width: int = 60):
    """Column of text for a column of arrays: the last ``width`` values scaled between their least and largest."""
    last = F.slice(values, F.greatest(F.size(values) - width, F.lit(0)) + 1, width)
    low, high = F.array_min(last), F.array_max(last)
    marks = F.array(*(F.lit(c) for c in SPARKS))
    one = lambda v: F.get(marks, F.least(F.greatest(((v - low) / (high - low) * (len(SPARKS) - 1)).cast("int"), F.lit(0)), F.lit(len(SPARKS) - 1)))
    return (
        F.when(F.size(values) == 0, "")
        .when(high <= 0, F.repeat(F.lit(" "), F.size(last)))
        .when(high == low, F.repeat(F.lit(SPARKS[len(SPARKS) // 2]), F.size(last)))
        .otherwise(F.array_join(F.transform(last, one), ""))
    )


def latency_percentiles(samples: DataFrame, points: tuple[int, ...] = (50, 90, 95, 99), most: int = 200_000) -> DataFrame:
    """One row: n, and p<k> = the value at 0-based index n*k/100 of the sorted first ``most`` samples (seq, value)."""
    first = samples.orderBy("seq").limit(most).agg(F.array_sort(F.collect_list("value")).alias("a"))
    n = F.size("a")
    return first.select(n.cast("long").alias("n"), *(F.get("a", F.least(F.floor(n * k / 100), n - 1).cast("int")).alias(f"p{k}") for k in points))


def load_summary(attempts: DataFrame, seconds: float) -> DataFrame:
    """One row: counts and shares of outcomes of attempts (status, bytes), and the rates over ``seconds``."""
    status = F.col("status")
    ok, refused = status.between(200, 299), status.isin(429, 503)
    a = attempts.agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(refused).alias("rejected"), F.coalesce(F.sum(F.when(ok, F.col("bytes"))), F.lit(0)).alias("bytes"))
    a = a.withColumn("errors", F.col("total") - F.col("success") - F.col("rejected"))
    share = lambda c: F.round(F.col(c) * 100.0 / F.greatest(F.col("total"), F.lit(1)), 4).alias(f"{c}_pct")
    t = max(seconds, 1e-9)
    return a.select("total", "success", "rejected", "errors", share("success"), share("rejected"), share("errors"), F.round(F.col("success") / t, 4).alias("avg_eps"), F.round(F.col("bytes") / (1024.0 * 1024.0) / t, 6).alias("mb_per_s"))
