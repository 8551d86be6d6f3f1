"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]: one JSON line with seconds, warm, median of three."""

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402

from depotspark.operators.cache import cache_of  # noqa: E402
from depotspark.operators.graph import release_loose  # noqa: E402
from depotspark.plans.queries import QUERIES  # noqa: E402
from depotspark.sources.star import raw_lines, sales  # noqa: E402

HEADLINE = ["sku_abc", "brand_pairs", "fc_select", "predicted_category_abc", "isolation_reasons", "sku_master", "address_backfill", "wave_rounds", "kpi"]
MORE = ["predicted_items", "cleaning_run", "cell_distance"]  # timed as well, not part of the total
FIXTURES = {"fixture_sales": sales, "fixture_raw_lines": raw_lines}  # the joins that make the queries' input, which is part of every time above


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.local.dir", scratch)
        .config("spark.checkpoint.dir", f"{scratch}/shared").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, query in ({n: QUERIES[n] for n in HEADLINE + MORE} | FIXTURES).items():
        runs = []
        for _ in range(3 + 1):
            cache_of(spark).close()  # no run finds results of an earlier one
            release_loose(spark)
            start = time.time()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec", "queries": times, "sf": sf_dir.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
