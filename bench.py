"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores."""

from __future__ import annotations

import json
import math
import os
import statistics
import time

os.environ.setdefault("OMP_NUM_THREADS", "1")  # before NumPy: one thread a worker

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Lines of the throughput queries, and characters of a line on average.
LINES, MEAN = 4_000, 43
#: Made-up entries of the pair and word vocabularies, some 2.5 million weights in all; runs that warm up and that count.
MORE, WARM, RUNS = 65_000, 10, 4
SAMPLE = "東京都渋谷区で東京都民が暮らす。Pythonで簡単に使えるツールです。吾輩は猫である、名前はまだ無い。アイスクリームを食べながら本を読む。"
QUERIES = (
    "rstrip_space_map", "chartype_histogram", "char_bigrams_end_marker", "bmes_assemble", "dictionary_spans", "dictionary_segment", "postag_filter", "postag_extract",
    "stopword_remove", "token_counts", "words_json", "preprocess_nfkc", "isalnum",
)


def lines() -> list[tuple[int, str]]:
    """Lines of 3 to some hundred characters, shuffled by a fixed rule."""
    sizes = [3 + int(-(MEAN - 3) * math.log(1 - (i * 0.6180339887) % 1)) for i in range(LINES)]
    return [(i, ((SAMPLE * 8)[i % 60 :])[: min(n, 454)]) for i, n in enumerate(sizes)]


def latency(net) -> dict[str, dict[str, list[float]]]:
    """Median and 95th percentile of microseconds a text, one text a call, in one thread and without Spark."""
    from kotoba.plans.api import segment

    found: dict[str, dict[str, list[float]]] = {"words": {}, "words_and_pos": {}}
    for size in (20, 100, 400):
        column = pa.array([(SAMPLE * 8)[:size]])
        for name, call in (("words", lambda: segment(net, None, column, False).lists()), ("words_and_pos", lambda: net.label_ids(segment(net, None, column, False).lists().to_pylist()))):
            each = []
            for _ in range(WARM + 100):
                start = time.perf_counter()
                call()
                each.append((time.perf_counter() - start) * 1e6)
            each = sorted(each[WARM:])
            found[name][str(size)] = [round(each[50], 1), round(each[94], 1)]
    return found


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from kotoba.plans.api import Segmenter, Tagger
    from kotoba.plans.nn import synthetic
    from kotoba.queries import QUERIES as known

    took: dict[str, float] = {}

    def run(df) -> float:
        start = time.time()
        df.write.format("noop").mode("overwrite").save()
        return time.time() - start

    def timed(name: str, df) -> None:
        took[name] = round(run(df), 3)

    def dealt(parts: int):
        df = spark.createDataFrame(lines(), "id long, text string").repartition(parts).cache()
        df.count()
        return df

    net = synthetic(0, True, SAMPLE, MORE)
    seg, tag = Segmenter.of(spark, net), Tagger.of(spark, net)
    jobs = {"words_4000_lines": lambda df: df.select(seg.words("text").alias("w")), "words_and_pos_4000_lines": lambda df: df.select(tag.tagging("text").alias("x"))}
    texts = dealt(int(CPUS))
    texts.select(seg.words("text").alias("w"), tag.tagging("text").alias("x")).write.format("noop").mode("overwrite").save()  # workers load the model once
    for name, job in jobs.items():
        timed(name, job(texts))
    first = {k: round(LINES / took[k]) for k in jobs}
    rates: dict[str, dict[str, int]] = {k: {} for k in jobs}
    for parts in sorted({1, 2, 4, int(CPUS)}, reverse=True):
        texts = dealt(parts)
        for name, job in jobs.items():
            for _ in range(WARM if parts == int(CPUS) else 1):
                run(job(texts))
            rates[name][str(parts)] = round(LINES / statistics.median(run(job(texts)) for _ in range(RUNS)))
        texts.unpersist()
    known["rstrip_space_map"](spark, SF).agg(F.count("*")).collect()
    for name in QUERIES:
        timed(name, known[name](spark, SF))
    shown = {
        "metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF,
        "lines_per_sec": {k: r[CPUS] for k, r in rates.items()}, "lines_per_sec_by_tasks": rates, "lines_per_sec_first_run": first,
        "protocol": f"median of {RUNS} runs after {WARM} that warm up; the times under queries are first runs", "latency_us_median_p95": latency(net), "weights": f"synthetic, {sum(w.size for w in net.weights.values())} numbers",
    }
    print(json.dumps(shown))


if __name__ == "__main__":
    main()
