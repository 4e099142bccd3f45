"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from goldmatch.plans.registry import queries
from goldmatch.session import build_session

HEADLINE = [
    "metrics_long", "tier_table", "compare_runs_overall", "sample_verdict", "ordered_compare", "bag_compare",
    "bag_compare_by_name", "row_ordinals", "normalize_cells", "classify_errors", "evaluate_pairs",
    "extract_sql", "classify_query_type", "estimate_difficulty", "load_items", "attach_schema", "render_ddl",
    "chatml_prompt", "sft_samples", "render_conversations", "render_tool_calls", "merge_tool_turns",
    "group_split", "leakage_audit", "length_profile", "length_by_part", "overlength_cut", "length_udf",
    "with_predictions", "key_profile", "fk_orphans", "incremental_eval", "q_filter_project", "q_scalar_agg",
    "q_group_agg", "q_join_having", "q_multi_join", "q_comma_join", "q_top_k", "q_order_by", "q_in_subquery",
    "q_not_in_subquery", "q_union", "q_except", "q_intersect", "q_cte", "q_recursive_cte", "q_cross_join",
    "q_correlated", "q_and_or_predicates",
]

# run once, untimed, on the smallest tables, so that class loading is not timed
WARM_UP = ["metrics_long", "q_join_having", "sft_samples", "render_tool_calls", "length_udf"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "goldmatch-bench",
        master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    registered, times = queries(), {}
    small = f"{sf_dir.rstrip('/').rsplit('sf', 1)[0]}sf0.001"
    for name in WARM_UP if os.path.isdir(small) else []:
        registered[name](spark, small).write.format("noop").mode("overwrite").save()
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
