"""Headline timings, printed as one JSON line.

Set BENCH_SF_DIR and BENCH_CPUS to change the data folder and the number of cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("telltale-bench")
    for key, value in {
        "spark.sql.shuffle.partitions": cpus,
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    from telltale import fixtures as X
    from telltale.functions.codes import signature
    from telltale.operators.scaling import scaler_values
    from telltale.operators.similarity import build_index, similar_topk
    from telltale.plans.anomaly_model import fit_anomaly_model
    from telltale.plans.knowledge_base import build_knowledge_base
    from telltale.plans.preprocess import preprocess, with_codes
    from telltale.session import materialise
    from telltale.workload import queries as W

    seconds: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        result = run()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    # Input preparation, not part of any timing.
    train, test = X.train(spark, folder), X.test(spark, folder)
    incidents = W.incidents(spark, folder)
    n_train, n_test = train.count(), incidents.count()

    def run_preprocess():
        done = preprocess(train, test)
        done.train = materialise(done.train, "bench-train")
        drain(done.test)
        drain(done.report)
        return done

    done = timed("preprocess", run_preprocess)
    model = timed("anomaly_fit", lambda: fit_anomaly_model(done.train))
    index = timed("similarity_index", lambda: build_index(done.train, scaler_values(done.scaler)))
    timed("similar_topk", lambda: drain(similar_topk(incidents, index)))
    # History with all its copies: every raw train row is a candidate.
    raw_history = with_codes(train).withColumn("dtc_signature", signature(F.col("active_dtcs")))
    raw_history = raw_history.withColumnRenamed("row_id", "historical_index")
    full = timed("similarity_index_raw_history", lambda: build_index(raw_history, index.scaler))
    timed("similar_topk_raw_history", lambda: drain(similar_topk(incidents, full)))
    timed("knowledge_base", lambda: drain(build_knowledge_base(X.entries(spark, folder))[0]))
    timed("vector_knn", lambda: drain(W.QUERIES["vector_knn"](spark, folder)))
    timed("hybrid_retrieve", lambda: drain(W.QUERIES["hybrid_retrieve"](spark, folder)))
    timed("quality_report", lambda: drain(W.QUERIES["quality_report"](spark, folder)))
    timed("detect_anomalies", lambda: drain(W.DEV.detect_anomalies(incidents, model.forest, index.scaler, model.bands)))
    W.resources(spark, folder)
    timed("analyze_incidents", lambda: drain(W.analysis(spark, folder)))

    rates = {
        name: round(n_test / seconds[name], 1)
        for name in ("similar_topk", "similar_topk_raw_history", "detect_anomalies", "analyze_incidents")
    }
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cores": int(cpus), "spark": spark.version,
                "train_rows": n_train, "incidents": n_test, "incidents_per_second": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
