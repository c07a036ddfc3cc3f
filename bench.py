"""Headline timings: one JSON line.  BENCH_SF_DIR picks the data, BENCH_CPUS the local cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagefacts import session  # noqa: E402
from pagefacts.plans import derive, registry  # noqa: E402

HEADLINE = (
    "host_summary", "extract_nodes", "page_locators", "identities", "bind_direct", "select_nodes", "nearest_ancestors", "bind_nearest_ancestor", "document_instances",
    "source_cardinality", "feed_readiness", "admission_audit", "runtime_coverage", "assemble_chunks", "redact_corpus", "verify_files",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build("bench", **{
        "spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": str(max(8, int(cpus))), "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"})
    queries = registry.queries()
    timings: dict[str, float] = {}
    started = time.time()
    for shape in (derive.measured_tree, derive.page_nodes, derive.source_elements, derive.bound_tree, derive.observations, derive.sessions):
        shape(spark, sf_dir)
    timings["write_shapes"] = round(time.time() - started, 3)
    for name in HEADLINE:
        started = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - started, 3)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": timings, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
