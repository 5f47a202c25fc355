"""Times of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from keepsake.queries import QUERIES
from keepsake.session import get_session

HEADLINES = [
    "timeline_day_collapse", "timeline_stats", "scoped_library", "free_text_search", "hour_hist", "weekday_hour_grid", "busiest_run", "series_bucket_60", "series_headline",
    "trend_first_last", "monthly_totals", "column_profile_lineitem", "money_card", "rank_top8", "exact_duplicates", "three_stage_dup_flag", "keep_n_per_group", "supersede_anti",
    "cross_part_dedup", "paged_table_merge", "near_dup_pairs", "rules_first_match", "plan_summary", "bucket_plan", "nearby_3h", "sidecar_join", "reconcile_ladder", "reply_tree",
    "people_rollup", "self_votes", "name_normalise", "mojibake_repair", "activity_html", "json_props", "date_coalesce", "number_parse", "notes_words", "cumulative_budget", "geo_bins", "counter_stream",
    "mailbox_senders", "health_type_days", "activity_blocks", "record_events", "zip_mail_events", "zip_health_days", "cards_all", "append_exports", "alias_states", "sidecar_forms", "json_merged_schema", "paged_cells",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    local = tempfile.mkdtemp(prefix="spark-")
    spark = get_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.local.dir": local, "spark.sql.warehouse.dir": f"{local}/warehouse"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["timeline_stats"](spark, folder).write.format("noop").mode("overwrite").save()  # the session starts here
    chosen = sys.argv[1:] or HEADLINES
    times: dict[str, float] = {}
    for name in chosen:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
