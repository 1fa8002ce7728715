"""Benchmark: headline stages of the engine on the provider records.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints one JSON line with seconds per stage.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from linkwise.operators.blocking import candidate_pairs  # noqa: E402
from linkwise.operators.compare import compare  # noqa: E402
from linkwise.operators.quality import quality_score, recommendations  # noqa: E402
from linkwise.operators.train import train  # noqa: E402
from linkwise.plans.pipeline import build_profiles, deduplicate, prepare_data, run_deduplication  # noqa: E402
from linkwise.plans.spec import preset_strict, spec_fuzzy  # noqa: E402
from linkwise.session import local_session, materialize  # noqa: E402
from linkwise.sources.fixture import provider_records  # noqa: E402


def _run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus=cpus, shuffle_partitions=int(cpus) * 2, app="linkwise-bench")
    times: dict[str, float] = {}
    counts: dict[str, int] = {}

    def timed(name, fn):
        t = time.time()
        out = fn()
        times[name] = round(time.time() - t, 3)
        return out

    raw = timed("load_source", lambda: materialize(provider_records(spark, sf_dir), "raw"))
    fuzzy = spec_fuzzy()
    prep = timed("prepare", lambda: prepare_data(raw, "rid"))
    counts["records"] = prep.records.count()
    profiles, cols = timed("profiles", lambda: build_profiles(prep.records, fuzzy))

    def blocking():
        pairs = candidate_pairs(profiles, fuzzy, [])
        return pairs.count()

    counts["candidate_pairs"] = timed("blocking", blocking)

    def comparing():
        pairs = candidate_pairs(profiles, fuzzy, list(dict.fromkeys(c.column for c in fuzzy.comparisons)))
        _run(compare(pairs, fuzzy.comparisons))

    timed("compare", comparing)
    model = timed("train", lambda: train(prep.records, profiles, fuzzy))

    def dedup():
        r = deduplicate(prep.records, profiles, cols, fuzzy, model)
        return r.statistics.collect()[0]

    stats = timed("score_cluster", dedup)
    counts["clusters"] = int(stats["unique_clusters"])
    timed("quality", lambda: (quality_score(prep.records).collect(), recommendations(prep.records).collect()))

    def preset():
        r = run_deduplication(raw, preset_strict(), id_column="rid")
        return r.statistics.collect()[0]

    pst = timed("preset_end_to_end", preset)
    counts["preset_duplicates"] = int(pst["duplicates_found"])
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "counts": counts, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
