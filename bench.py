"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import random
import tempfile
import time

from tracewell.catalog import all_queries
from tracewell.operators.scan import scan_images, signature_patterns
from tracewell.session import get_spark
from tracewell.sources.images import block_index, list_images
from tracewell.sources.signatures import signature_table

HEADLINE = [
    "merge_extents", "extent_gaps", "drop_contained", "free_overlap", "entropy", "sample_entropy", "block_profile", "digests",
    "dedupe_first", "suppress_known", "score_candidates", "scored_unknown", "signature_hits", "needle_counts", "next_footer",
    "timeline_fold", "corroborated_names", "paths_deep", "fragment_order", "missing_keys", "outliers", "block_hash", "append_blocks",
    "ledger_report", "doc_validation", "payload_hashes", "sample_verdict", "residual_bound", "budget_admission",
]


#: Bytes of the generated image that the scan reads.
IMAGE_BYTES = 1 << 30


def scan_rate(spark) -> float:
    """MB/s of the signature scan over a generated image of noise."""
    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        piece = random.Random(1).randbytes(32 << 20)
        with open(os.path.join(folder, "noise.img"), "wb") as image:
            for _ in range(IMAGE_BYTES // len(piece)):
                image.write(piece)
        patterns = signature_patterns(signature_table(spark))
        start = time.perf_counter()
        scan_images(block_index(list_images(spark, folder)), patterns).write.format("noop").mode("overwrite").save()
        return round(IMAGE_BYTES / 1e6 / (time.perf_counter() - start), 1)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # The first query of a session pays for starting the JVM's code paths and the Python workers.
    for name in ("entropy", "extent_total"):
        queries[name](spark, sf_dir).limit(1).collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "scan_mb_per_s": scan_rate(spark), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
