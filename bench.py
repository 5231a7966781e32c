"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs end to end from the parquet tables (no caching between queries) and is
forced with the ``noop`` sink, so the time covers the whole plan without a driver collect.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shroud.plans import catalog  # noqa: E402
from shroud.session import get_session  # noqa: E402

HEADLINE = {
    "detect": "OVL-02",          # candidates -> validation -> overlap resolution
    "scored_candidates": "VAL-18",
    "pseudonymize": "JOIN-04",   # + corpus-wide mapping
    "redact": "RED-01",          # + join back to the text
    "value_map_redact": "RED-02",
    "doc_stats": "AGG-01",
    "evaluate": "EVAL-02",
}


def run(spark, sf_dir: str) -> dict:
    times = {}
    for name, key in HEADLINE.items():
        t0 = time.time()
        catalog.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    t0 = time.time()
    catalog.flagship(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times["flagship"] = round(time.time() - t0, 3)
    return times


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session()
    # JIT / codegen warm-up on the smallest scale (not reported)
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(warm):
        catalog.QUERIES["OVL-02"](spark, warm).write.format("noop").mode("overwrite").save()
    times = run(spark, sf_dir)
    n_docs = catalog.corpus(spark, sf_dir).count()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times, "sf": sf,
                      "docs": n_docs, "docs_per_sec_flagship": round(n_docs / times["flagship"], 1)}))


if __name__ == "__main__":
    main()
