"""Registered queries: streams of feature rows and events. Each job runs twice, as if it had been stopped half way."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnish.operators import corruption as C
from tarnish.plans.corruption_queries import SEED, SEVERITY, c2_columns
from tarnish.session import scratch_path
from tarnish.sources.adapter import read_table
from tarnish.sources.silver import silver
from tarnish.streaming import jobs


def in_two_runs(spark, df, first, transform, files_per_batch=None):
    """What the job stores when the rows where ``first`` holds come before its first run, the others before its second."""
    source, sink, checkpoint = (scratch_path(spark, f"stream-{x}") for x in ("source", "sink", "checkpoint"))
    out = None
    for part in (first, ~first):
        df.where(part).write.mode("append").parquet(source)
        out = transform(jobs.arriving(spark, source, df.schema, files_per_batch))
        jobs.store_available(out, sink, checkpoint)
    return spark.read.schema(out.schema).parquet(sink)


def family(name, columns=None):
    def query(spark, sf):
        of = silver(spark, sf)

        def transform(stream):
            out = jobs.corrupted(stream, name, SEVERITY, SEED)
            return columns(of, out) if columns else out

        return in_two_runs(spark, of, F.pmod(F.xxhash64("order_id"), F.lit(2)) == 0, transform, files_per_batch=4)

    return query


def c4_undone(spark, sf):
    """Events with copies, in two halves by time; the job keeps one of each."""
    events = read_table(spark, sf, "events")
    copied = C.apply(events, "duplicate_rows", SEVERITY, SEED, key="event_id")
    seconds = F.col("ts").cast("timestamp").cast("double")
    middle = events.agg(F.percentile_approx(seconds, 0.5)).first()[0] or 0.0
    return in_two_runs(spark, copied, seconds < middle, lambda s: jobs.without_copies(s, ["event_id"], "ts", "1 hour"))


QUERIES = {
    "c1_streamed": family("missing_injection"),
    "c2_streamed": family("type_flip", c2_columns),
    "c6_streamed": family("currency_unit_drift"),
    "c7_streamed": family("timezone_collapse"),
    "c8_streamed": family("category_taxonomy_drift"),
    "c9_streamed": family("mojibake_roundtrip"),
    "c4_copies_undone": c4_undone,
}
