"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrill.operators import evaluate as Ev
from vectrill.operators import search as S
from vectrill.operators.clustering import KMeans
from vectrill.operators.ivf import Inverted
from vectrill.plans.search_queries import asked, base
from vectrill.runtime import materialize, shared_dir
from vectrill.streaming.window import SlidingIndex

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def timed(run) -> tuple[float, object]:
    began = time.perf_counter()
    out = run()
    if isinstance(out, DataFrame):
        out.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3), out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    b = materialize(base(spark, SF_DIR).repartition(int(CPUS)), "bench")
    every, some = asked(b, "true"), asked(b, "id % 20 = 0")
    S.knn_blocks(some, b, 10).count()  # warm up
    seconds: dict[str, float] = {}
    recall: dict[str, float] = {}

    seconds["knn_self_join_k10_expressions"], _ = timed(lambda: S.knn(some, b, 10))
    seconds["knn_self_join_k10_matrix"], _ = timed(lambda: S.knn_blocks(every, b, 10))
    seconds["kmeans_32_10_rounds"], model = timed(lambda: KMeans(32, 10).fit(b))
    index = Inverted.build(b, model.centroids)
    index.lists = materialize(index.lists.repartition("list_no"), "lists")
    truth = materialize(S.knn(some, b, 10), "truth")
    for nprobe in (1, 4, 16):
        seconds[f"ivf32_nprobe{nprobe}"], found = timed(lambda: index.search(some, 10, nprobe))  # noqa: B023
        recall[f"ivf32_nprobe{nprobe}"] = round(Ev.knn_intersection(found, truth, 10).first()[0], 4)
    seconds["ivf32_big_batch_nprobe4"], _ = timed(lambda: index.search_big(every, 10, 4))

    def slide() -> DataFrame:
        window = SlidingIndex(spark, f"{shared_dir(spark)}/vectrill-bench-{os.getpid()}", model.centroids)
        for s in range(10):
            window.step(b.where(F.floor(F.col("id") / 100) == s).select("id", "vec"), remove_oldest=s >= 5)
        return window.rows()

    seconds["sliding_window_10_slices"], _ = timed(slide)
    print(json.dumps({"metric": "total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "recall_at_10": recall, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
