"""Measure how a hot order spreads over tasks in the change fold.

Derives a skewed change log from the given events (every third request is moved
onto one order, so that order holds a third of all rows), runs the fold, and reads
Spark's event log (written to a scratch folder) to report, per stage, the largest
share of shuffle records any single task read. Compares with a plain window
partitioned by order only. Usage: python tools/skew_probe.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from washline.operators import changes  # noqa: E402
from washline.sources import views  # noqa: E402
from washline.sources.tables import Tables  # noqa: E402


def stage_skew(log_dir: str) -> list[tuple[int, int, float]]:
    per_stage: dict[int, list[int]] = {}
    for path in glob.glob(f"{log_dir}/**/*", recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerTaskEnd":
                    continue
                m = ev.get("Task Metrics") or {}
                rd = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                per_stage.setdefault(ev["Stage ID"], []).append(rd)
    out = []
    for sid, recs in sorted(per_stage.items()):
        tot = sum(recs)
        if tot > 1000:
            out.append((sid, tot, max(recs) / tot))
    return out


def run(sf_dir: str, mode: str) -> None:
    log_dir = tempfile.mkdtemp(prefix=f"skew-{mode}-", dir="/tmp")
    ckpt = tempfile.mkdtemp(prefix="skew-ckpt-", dir="/tmp")
    spark = (SparkSession.builder.master("local[8]").appName(f"skew-{mode}")
             .config("spark.sql.shuffle.partitions", "64")
             .config("spark.sql.adaptive.enabled", "false")
             .config("spark.ui.enabled", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.checkpoint.dir", ckpt).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(ckpt)
    t = Tables(spark, sf_dir)
    ev = views.change_events(t).withColumn(
        "order_id", F.when(F.col("event_id") % 3 == 0, F.lit(7)).otherwise(F.col("order_id")))
    tx = views.transactions(t, with_customer=False)
    if mode == "cut":
        out = changes.annotate(ev, tx)
    else:  # the plain form: one window partitioned by order only
        w = Window.partitionBy("order_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
        out = ev.withColumn("_prev", F.last("action", ignorenulls=True).over(w))
    out.write.format("noop").mode("overwrite").save()
    spark.stop()
    worst = max(stage_skew(log_dir), key=lambda r: r[2])
    print(json.dumps({"mode": mode, "rows": ev_rows(sf_dir), "worst_stage": worst[0],
                      "stage_records": worst[1], "max_task_share": round(worst[2], 4)}))


def ev_rows(sf_dir: str) -> int:
    import pyarrow.parquet as pq
    return pq.ParquetFile(f"{sf_dir}/events.parquet").metadata.num_rows


if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    for m in ("plain", "cut"):
        run(sf, m)
