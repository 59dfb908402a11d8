"""Headline queries at one scale, timed; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Each query is run
to the end by writing its rows to the ``noop`` sink, after one warm-up query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "tag_by_rules",
    "job_tag_rules",
    "clean_text",
    "term_counts",
    "tfidf_l2",
    "score_labels",
    "decide_top_k",
    "hybrid_gated",
    "multilabel_metrics",
    "per_label_prf",
    "category_report",
    "top_n_per_code",
    "split_holdout",
    "grid_sweep",
    "naive_bayes_sql",
    "crosstab_share",
    "income_band",
    "tag_many_rules",
    "fit_ovr_logistic",
    "fit_ovr_all_words",
    "tag_indexed_rules",
    "lemma_endings",
    "two_step_classify",
    "job_tag_ovr",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tagspark.session import local_session

    spark = local_session(cpus)
    from checks import catalog

    chosen = sys.argv[1:] or HEADLINE
    catalog.QUERIES["taxonomy_levels"](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in chosen:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
