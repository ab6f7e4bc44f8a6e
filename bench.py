"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from effectspark.plans import catalog
from effectspark.session import local_session
from effectspark.sources.store import session_workspace

HEADLINE = (
    "src_ratings", "feat_all", "split_protected", "split_exact", "profile_summary", "profile_user", "profile_age",
    "profile_label", "top_titles", "fit_user", "rmse_ladder", "rmse_shrunk", "score_shrunk", "cv_rmse_grid",
    "rmse_final",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="effectspark-bench")
    queries = catalog.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("rmse_ladder")  # warm up the JVM
    times: dict[str, float] = {}
    warm: dict[str, float] = {}
    for name in HEADLINE:
        session_workspace(spark).drop()  # nothing that an earlier query staged is left
        times[name], warm[name] = run(name), run(name)
        print(f"{name}: {times[name]} cold, {warm[name]} warm", file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries, each from the tables alone (warm: the staged frame is there)",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "warm": warm,
                "warm_value": round(sum(warm.values()), 3),
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
