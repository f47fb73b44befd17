"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``fit`` builds, writes and loads a model. ``search_stored`` answers all benchmark texts from that model and is also
given per query; ``search_single`` asks it one string. ``fit_custom`` and ``search_custom`` do the same with lemmas. The other names are registered queries, each run from raw tables.
"""

from __future__ import annotations

import json
import os
import time

from nearkin.plans.model import SimilarityModel, fit
from nearkin.plans.queries import QUERIES, benchmark, corpus, table
from nearkin.session import get_session, scratch_path

HEADLINE = [
    "predict", "tfidf_l2", "analyzer_custom", "inspect_doc", "clean_issue", "dot_dense", "batch_vs_catalog",
    "cross_group_match", "near_dups", "split_positional", "standardize", "feedback_counts",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, fn) -> None:
        start = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - start, 3)

    stored: list[SimilarityModel] = []
    queries = benchmark(spark, sf)
    timed("fit", lambda: stored.append(corpus(spark, sf).save(scratch_path(spark, "model"))))
    timed("search_stored", lambda: run(stored[0].predict(queries)))
    times["search_stored_per_query"] = round(times["search_stored"] / queries.count(), 4)
    timed("search_single", lambda: run(stored[0].predict("image file upload fails")))
    docs = table(spark, sf, "documents")
    timed(
        "fit_custom",
        lambda: stored.append(
            fit(docs, "text", ["source", "lang"], "doc_id", mode="custom").save(scratch_path(spark, "model"))
        ),
    )
    timed("search_custom", lambda: run(stored[1].predict(queries)))
    for name in HEADLINE:
        timed(name, lambda: run(QUERIES[name](spark, sf)))
    total = round(sum(v for k, v in times.items() if k != "search_stored_per_query"), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
