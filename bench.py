"""Seconds per headline query. BENCH_SF_DIR and BENCH_CPUS choose data and cores; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from siftwell.plans.queries import QUERIES
from siftwell.session import build_session

HEADLINE = [
    "spam_scores", "naive_bayes_scores", "censor_chain", "marker_extraction", "exact_dedup", "dataset_union",
    "dedup_after_censor", "stratified_holdout", "class_caps", "blank_line_split", "link_mask", "phone_mask",
    "name_mask", "word_ngrams", "letter_ngrams", "train_vocabulary", "token_presence", "substring_presence",
    "class_words", "class_word_hits", "tagged_tokens", "tag_ngram_sentences", "tree_nodes", "tree_path_ngrams",
    "style_sizes", "style_links", "feature_blocks", "nearest_neighbour_votes", "boosting_stump_errors",
    "fold_summary", "chat_export_messages", "mailbox_messages", "sentence_round_trip",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executors
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
