"""The daily run: ingest -> catalogue -> train -> report, on one session.

Any scheduler can call ``daily_run``; every step is a Spark job and the
outputs land under ``base`` (a folder in the shared checkpoint location by
default). With the same ``base`` a rerun takes up where the last one ended:
steps finished for the same input files and parameters are not done again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import ml as ML
from tessera.plans import fixtures as fx
from tessera.plans.reports import report_dataset, write_report
from tessera.plans.steps import Steps, files_version
from tessera.session import scratch_dir
from tessera.sources import catalog as C
from tessera.sources.files import table

# Tables that the report reads besides the landed events.
REPORTED = ("lineitem", "orders", "events")


def daily_run(spark: SparkSession, sf_dir: str, base: str | None = None, num_trees: int = 200,
              max_depth: int = ML.MAX_DEPTH) -> DataFrame:
    base = base or scratch_dir(spark, "daily")
    steps = Steps(spark, base)
    version = {t: files_version(spark, f"{sf_dir.rstrip('/')}/{t}.parquet") for t in REPORTED}
    # 1. ingest: land today's events as Parquet and catalogue them
    landed = steps.run("events", lambda out: table(spark, sf_dir, "events").write.parquet(out), events=version["events"])
    stored = spark.read.parquet(landed)
    steps.run("catalog", lambda out: C.register_datasets(spark, out, [("events", "parquet", landed, stored)]), after=("events",))

    # 2. profile (into the report below) and 3. train
    def train(out: str) -> None:
        run = ML.train(fx.orders_dummies(spark, sf_dir), "label", "classification", key="o_orderkey", num_trees=num_trees,
                       max_depth=max_depth)
        model = ML.save_model(run["model"], f"{out}/models/{run['model_name']}")
        ML.log_run(spark, f"{out}/runs", run, model)

    trained = steps.run("train", train, orders=version["orders"], num_trees=num_trees, max_depth=max_depth)

    # 4. report
    def report(out: str) -> None:
        write_report(report_dataset(spark, sf_dir, {"events": stored}, spark.read.parquet(f"{trained}/runs")), out, "json")

    return spark.read.json(steps.run("report", report, after=("events", "train"), **version))
