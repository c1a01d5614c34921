"""Headline timings: one JSON line with seconds per query.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated names; default the headline list, "all" for every query).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "J1_as_of", "J2_panel_as_of", "K3_upsert", "J3_price_as_of", "J8_forward_return", "W12_trailing_median_adv",
    "W5_forward_excess", "A12_weighted_basket", "A4_pearson_ic", "A5_spearman_ic", "W16_benjamini_hochberg",
    "A29_block_bootstrap", "C1_purged_kfold", "C2_combinatorial_purged", "C3_walk_forward_anchored",
    "W7_extract_eps", "A21_shares_outstanding", "W6_standardized_surprise", "J21_known_at_panel",
    "G5_market_cap_candidates", "P3_qualify", "J15_matched_control", "J16_event_study", "J9_resolve_cik",
    "J12_find_conflicts", "J27_match_names", "A14_locality", "T1_heading_sections", "T4_lexicon_sentiment",
    "M2_out_of_sample_ic", "M4_overfitting", "M7_changepoints", "X1_insider_clusters",
)


def main() -> None:
    from tidemark.plans.catalog import QUERIES
    from tidemark.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else ([n for n in chosen.split(",") if n] or list(HEADLINE))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # warm the JVM and the Python workers, so the first query is not charged for them
    QUERIES["J1_as_of"](spark, sf).count()
    QUERIES["A7_t_test_p"](spark, sf).count()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": Path(sf).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
