"""Times the headline queries and prints one JSON line.

    BENCH_SF_DIR   folder of the input tables (default /root/testdata/sf0.1)
    BENCH_CPUS     threads of the local session (default 8)
    BENCH_QUERIES  comma-separated names, to run others than the headline ones
    BENCH_COPIES   how often the conversations and events are repeated under new
                   numbers (default 1), to see how times grow with the data
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "dedup_messages",
    "chronological_index",
    "merge_stats",
    "stitch_components",
    "merged_archive",
    "parse_roundtrip",
    "date_order_sniff",
    "archives_to_messages",
    "media_catalog",
    "chat_list",
    "search_messages",
    "sender_share",
    "chat_overview",
    "source_contribution",
    "latest_media_per_chat",
    "media_ordinals",
    "sender_runs",
    "page_window",
    "chat_documents",
    "links",
    "plain_text",
)


def replicate(spark, folder: str, copies: int) -> str:
    """Conversations and events several times over, in a temporary folder."""
    from pyspark.sql import functions as F

    target = tempfile.mkdtemp(prefix="spark-")
    for name, key in (("conversations", "conv_id"), ("events", "event_id")):
        table = spark.read.parquet(f"{folder}/{name}.parquet")
        step = table.agg(F.max(key)).first()[0] + 1
        # Keep the residues that the simulated exports are built on.
        step += -step % 27720
        copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy")
        more = table.select("*", copy).withColumn(key, F.col(key) + F.col("_copy") * step)
        if name == "events":
            more = more.withColumn("user_id", F.col("user_id") + F.col("_copy") * 9240)
        more.drop("_copy").repartition(64).write.parquet(f"{target}/{name}.parquet")
    return target


def main() -> None:
    from threadlake.plans.queries import QUERIES
    from threadlake.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    copies = int(os.environ.get("BENCH_COPIES", "1"))
    spark = build_session(
        "threadlake-bench",
        master=f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    if copies > 1:
        folder = replicate(spark, folder, copies)
    # Start the JVM's and the Python workers' first-use work outside the timings.
    QUERIES["merge_stats"](spark, "/root/testdata/sf0.001").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")),
                "copies": copies,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
