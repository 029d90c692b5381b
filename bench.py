"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from twinline.plans import queries as named  # noqa: E402

HEADLINE = (
    "profile_pairs cleaning_funnel clean_pairs dedup_pairs length_profile word_vocab_size stratified_split "
    "split_leakage mix_report shuffled_mix batch_assign word_freq char_coverage learn_bpe encode_pairs "
    "decode_text unk_rate finetune_feed epoch_loss running_loss best_checkpoint consent_filter "
    "bleu_tokenize clipped_matches bleu_corpus"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("twinline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The baseline's vocabulary, so that the figures compare; the registered one has 16,000 pieces.
    named.VOCAB = int(os.environ.get("BENCH_VOCAB", "128"))
    chosen = sys.argv[1:] or HEADLINE
    named.registry()["profile_pairs"](spark, sf_dir).collect()  # start the JVM's machinery
    took: dict[str, float] = {}
    for name in chosen:
        start = time.perf_counter()
        # The noop sink computes every column of every row and keeps none.
        named.registry()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "vocab": named.VOCAB,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
