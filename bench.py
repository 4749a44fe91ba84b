"""Headline queries on ``$BENCH_SF_DIR``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from palimpsest import plans
from palimpsest.session import build_session

HEADLINE = [
    "flagship_edit_kinds",
    "a_revisions",
    "a_parallel_pairs",
    "b_rewrite_comment",
    "b_blacklist",
    "b_reject_report",
    "b_bleu_filter",
    "b_overlap",
    "b_meaningless",
    "c_revision_pairs",
    "c_verb_lookup",
    "c_eps_pairs",
    "d_corpus_bleu",
    "d_entity_metrics",
    "d_label_vocab",
    "e_page_comments",
    "e_round_robin",
    "e_top_terms",
    "h_two_stage_diff",
    "h_context_window",
    "h_section_text",
    "i_generation_records",
    "i_align_slots",
    "j_dbscan",
    "j_kmeans",
    "j_tfidf",
    "k_annotate",
    "k_apply_edits",
    "s_ingest",
    "s_pairs",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
