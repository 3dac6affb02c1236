"""Benchmark: time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_QUERY_S`` (default 900: a query's jobs are cancelled after
so many seconds and the query is reported as failed, so that the line is always
printed).  Each query is executed in full with a ``noop`` write (nothing is
collected to the driver); the time includes planning and the iterative
steps' own jobs.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from storyloom.plans.queries import queries  # noqa: E402
from storyloom.session import get_spark  # noqa: E402

HEADLINE = [
    "groups_kept",          # F1-F3, A1, A2
    "articles_grouped",     # + distributed in-group ids
    "intros",               # W1, M1, M2
    "strip_entities",       # tagger, E1, M5
    "doc_terms",            # F6-F8
    "tfidf",                # A3-A5
    "doc_vectors_tfidf",    # J1, A7, M6
    "representatives",      # C2-C5, W2, W5 on article lengths
    "bigram_phrases",       # A12, P1
    "cosmul_neighbours",    # P6 over the whole vocabulary
    "cluster_articles",     # Q1: the full cluster pipeline
    "triples_filtered",     # T5, T6 on every kept article
    "svo_triples",          # T9-T11
    "topics_to_9",          # Q2 over 2 to 9 topics a cluster: bigrams, sweep, coherence, names
    "triples_to_9",         # Q3 on the topics of that Q2
]


def run(spark, name, sf_dir):
    df = queries()[name](spark, sf_dir)
    t0 = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - t0


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app_name="storyloom-bench")
    times = {}
    skip = set(filter(None, os.environ.get("BENCH_SKIP", "").split(",")))
    failed = {}
    for name in [q for q in HEADLINE if q not in skip]:
        t0 = time.time()
        limit = threading.Timer(float(os.environ.get("BENCH_QUERY_S", "900")), spark.sparkContext.cancelAllJobs)
        limit.daemon = True
        limit.start()
        try:
            run(spark, name, sf_dir)
        except Exception as exc:  # noqa: BLE001 - report, never hide, a failed query
            failed[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
            print(f"# {name}: FAILED {failed[name]}", file=sys.stderr, flush=True)
            continue
        finally:
            limit.cancel()
        times[name] = round(time.time() - t0, 2)  # planning + execution
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir).replace("sf", "")
    total = round(sum(times.values()), 2)
    out = {"metric": "headline_queries_total", "value": total, "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
