"""python -m casewise.cli COMMAND: quarters, years, periods, reports, structure scans and models."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import batch
from .operators import cases, periods
from .plans.study import Z_DRUGS_AND_FALLS
from .sources import census, quarter_files, sinks

#: Training rows of each kind of model unless --train-sample-n is given.
TRAIN_SAMPLE_N = {"logistic": 400_000, "forest": 200_000, "boosted": 300_000}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="casewise")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple):
        made = sub.add_parser(name)
        for flag, extra in options:
            made.add_argument(flag, **extra)

    raw, output = ("--raw-root", {"default": None}), ("--output", {"default": "output"})
    year, quarter = ("--year", {"type": int, "required": True}), ("--quarter", {"required": True})
    command("quarter", raw, output, year, quarter, ("--table", {"default": "all", "choices": ["all", *batch.DATASETS]}))
    command("years", raw, output, ("--start-year", {"type": int, "required": True}), ("--end-year", {"type": int, "required": True}), ("--force", {"action": "store_true"}))
    command("period", output, ("--start-year", {"type": int, "default": 2004}), ("--end-year", {"type": int, "default": 2025}))
    command("analyse", output, ("--period-token", {"default": None}))
    command("terms", raw, output, year, quarter, ("--scope", {"default": "suspect", "choices": ["suspect", "ps"]}), ("--top-n", {"type": int, "default": 50}))
    command("report", output, ("--case-file", {"required": True}))
    command("scan", raw, output)
    command(
        "model", output, ("--kind", {"default": "logistic", "choices": ["logistic", "forest", "boosted"]}), ("--period-token", {"default": None}),
        ("--target-col", {"default": "is_fall_narrow"}), ("--train-end-year", {"type": int, "default": 2023}), ("--valid-year", {"type": int, "default": 2024}),
        ("--test-year", {"type": int, "default": 2025}), ("--train-sample-n", {"type": int, "default": None}), ("--cv-folds", {"type": int, "default": 5}),
        ("--bootstrap-iterations", {"type": int, "default": 1000}), ("--random-state", {"type": int, "default": 42}),
        ("--n-estimators", {"type": int, "default": None}), ("--max-depth", {"type": int, "default": None}), ("--learning-rate", {"type": float, "default": 0.05}),
    )
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("casewise").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "quarter":
        tables = batch.DATASETS if a.table == "all" else (a.table,)
        batch.process_quarter(spark, quarter_files.raw_root(spark, a.raw_root), a.output, a.year, a.quarter, tables)
    elif a.command == "years":
        batch.process_years(spark, quarter_files.raw_root(spark, a.raw_root), a.output, a.start_year, a.end_year, a.force)
    elif a.command == "period":
        batch.build_period(spark, a.output, a.start_year, a.end_year)
    elif a.command == "analyse":
        signals, features = (spark.read.parquet(p) for p in sinks.one_pair(f"{a.output}/period", a.period_token))
        dataset = periods.with_features(signals, features)
        for name, table in batch.analyse(spark, signals, dataset, Z_DRUGS_AND_FALLS).items():
            sinks.write_csv(table, Path(a.output) / "period" / f"{name}.csv")
    elif a.command == "terms":
        reports = quarter_files.quarter_reports(spark, quarter_files.raw_root(spark, a.raw_root), a.year, a.quarter)
        relations = batch.quarter_relations(reports, a.year, a.quarter)
        profile = cases.term_profile(reports.reac, relations["case_base"], relations["drug_exposure"], a.scope == "ps", a.top_n)
        sinks.write_csv(profile, Path(a.output) / f"terms_{a.year}{a.quarter}_{a.scope}.csv")
    elif a.command == "report":
        batch.descriptive_report(spark.read.parquet(a.case_file), a.output)
    elif a.command == "scan":
        files = census.scan_files(census.header_lines(spark, quarter_files.raw_root(spark, a.raw_root))).cache()
        tables = {"files": files.drop("columns"), "columns": census.column_rows(files), "counters": census.counters(files), "variants": census.variants(files), "changes": census.changes(files)}
        for name, table in tables.items():
            sinks.write_csv(table.orderBy(*table.columns[:3]), Path(a.output) / f"structure_{name}.csv")
        sinks.write_json({name: [r.asDict() for r in table.collect()] for name, table in tables.items() if name != "columns"}, Path(a.output) / "structure.json")
        files.unpersist()
    else:
        if a.train_sample_n is None:
            a.train_sample_n = TRAIN_SAMPLE_N[a.kind]
        run_model(spark, a)


def run_model(spark: SparkSession, a: argparse.Namespace) -> None:
    from .ml import metrics, models

    signals, features = (spark.read.parquet(p) for p in sinks.one_pair(f"{a.output}/period", a.period_token, widest=True))
    parts = models.temporal_split(models.modelling_frame(signals, features, a.target_col), a.train_end_year, a.valid_year, a.test_year)
    train = models.balanced_weights(models.fixed_sample(parts["train"], a.train_sample_n, a.random_state)).cache()
    make = {
        "logistic": models.logistic,
        "forest": lambda _: models.forest(a.n_estimators or 300, a.max_depth, a.random_state),
        "boosted": lambda _: models.boosted(a.n_estimators or 400, a.max_depth or 5, a.learning_rate, a.random_state),
    }[a.kind]
    folder = sinks.run_folder(Path(a.output) / "models", a.kind)
    models.cv_summary(models.cross_validate(train.drop("weight"), make, a.cv_folds, a.random_state)).to_csv(folder / "cv.csv", index=False)
    model = models.fit(train, make(train))
    curve = models.calibrator(models.scores(model, parts["valid"]))
    valid, test = (models.calibrated(models.scores(model, parts[p]), curve) for p in ("valid", "test"))
    threshold = metrics.youden_threshold(valid).first().threshold
    values = {name: metrics.all_metrics(rows, threshold) for name, rows in (("valid", valid), ("test", test))}
    sinks.write_json({"threshold": threshold, "calibration": curve, "metrics": values}, folder / "metrics.json")
    sinks.write_csv(models.split_summary(parts), folder / "split.csv")
    sinks.write_csv(metrics.roc_points(test.withColumn("score", F.round("score", 4))), folder / "roc.csv")
    sinks.write_csv(metrics.calibration_bins(test), folder / "calibration.csv")
    sinks.write_csv(models.bootstrap(test, a.bootstrap_iterations, a.random_state, threshold), folder / "bootstrap.csv")
    test.write.mode("overwrite").parquet(str(folder / "predictions"))
    models.save(model, spark, str(folder / "pipeline"))
    sinks.write_csv(spark.createDataFrame(models.feature_table(model, train), "feature string, value double"), folder / "features.csv")


if __name__ == "__main__":
    main()
