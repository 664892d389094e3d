"""Times the headline queries: ``BENCH_SF_DIR=... BENCH_CPUS=8 python bench.py`` prints one JSON line.

Every query is run in full into a sink that throws the rows away. Each is run
twice and the shorter time counts, so that start-up and code generation of the
first run stay out.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "word_count", "doc_avg_distinct_words", "lexicon_sentiment", "traffic_tumbling", "rides_interval_join", "ride_tips",
    "point_in_polygon", "port_statistics", "port_statistics_stream", "log_consumer", "message_latency",
    "latency_sequence", "latency_hist", "latency_box", "packet_latency", "consumer_throughput", "delivery_matrix",
    "undelivered", "counter_rate", "trigger_stats", "metrics_rollup", "duplicate_rows", "describe", "knob_sampling",
    "topic_copy",
]


def trigger_ms(spark, sf_dir: str, files: int = 12) -> dict:
    """Mean time of a trigger of the port statistics stream, one input file per trigger, without the first."""
    from streamjobs.catalog.ports import packet_messages
    from streamjobs.catalog.registry import table
    from streamjobs.operators.progress import trigger_stats
    from streamjobs.plans import port_statistics as ports
    from streamjobs.session import fresh_path
    from streamjobs.sources.topics import file_source, read_topic
    from streamjobs.streaming import sinks
    from streamjobs.streaming.progress import ProgressRecorder, progress_table

    topic, out = fresh_path(spark, "bench-topic"), fresh_path(spark, "bench-out")
    packet_messages(table(spark, sf_dir, "events")).repartition(files).write.text(topic)
    stream = read_topic(spark, file_source(topic, "text", maxFilesPerTrigger="1"))
    stats = ports.running_statistics(ports.packets(stream))
    with ProgressRecorder.on(spark) as recorder:
        query = sinks.start_foreach_batch(
            stats, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/b={n}"), "update", available_now=True)
        query.awaitTermination()
        row = trigger_stats(progress_table(recorder, query)).first()
    return {"triggers": row["n_triggers"], "mean_ms": round(row["steady_ms"], 1)}


def main() -> None:
    from streamjobs.catalog import QUERIES
    from streamjobs.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    copied = times.get("topic_copy")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"),
                      "port_statistics_trigger": None if sys.argv[1:] else trigger_ms(spark, sf_dir),
                      "topic_copy_messages_per_s": round(rows / copied) if copied else None}))


if __name__ == "__main__":
    main()
