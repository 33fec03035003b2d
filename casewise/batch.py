"""Builds and analyses whole quarters, years and periods of report files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.signal import full_measures
from .operators import analyses, cases, cohort, periods, report, trend
from .plans.study import Z_DRUGS_AND_FALLS, StudySpec
from .sources import sinks, store
from .sources.order_tables import Reports
from .sources.quarter_files import quarter_reports

QUARTERS = ("Q1", "Q2", "Q3", "Q4")
SIGNALS = "01_signal_analysis_results"
DATASETS = ("case_base", "drug", "drug_feature", "drug_exposure", "reac_case", "outc_case", "case_dataset", "signal_dataset")
#: Columns of the file of trends (fixed values).
TREND_COLUMNS = [
    "year", "analysis", "outcome_name", "outcome_definition", "conclusion", "a", "b", "c", "d", "n", "ror", "ror_ci_low", "ror_ci_high", "prr", "prr_ci_low", "prr_ci_high",
    "ic", "ic025", "ic975", "ebgm", "eb05", "eb95", "chi_square_yates", "expected_a", "signal_flag_mhra", "signal_flag_ror", "signal_flag_ic", "signal_flag_ebgm",
]


def quarter_relations(reports: Reports, year: int, quarter: str, spec: StudySpec = Z_DRUGS_AND_FALLS) -> dict[str, DataFrame]:
    """All relations of a quarter as one lazy plan; case_base and the drug rows are what others share."""
    base = cohort.case_base(reports.demo, reports.deleted, spec)
    rows = cases.drug_rows(reports.drug, base)
    drugs, reactions = cases.drug_cases(rows, spec), cases.reaction_cases(reports.reac, base, spec)
    outcomes = cases.outcome_cases(cases.outcome_tokens(reports.outc, base), spec)
    found = {
        "case_base": base, "drug": rows, "drug_feature": cases.drug_feature(drugs), "drug_exposure": cases.drug_exposure(drugs),
        "reac_case": reactions, "outc_case": outcomes, "case_dataset": cases.case_dataset(base, drugs, reactions, outcomes),
        "signal_dataset": cases.signal_dataset(base, drugs, reactions, outcomes),
    }
    return {n: df.withColumn("year", F.lit(year)).withColumn("quarter", F.lit(quarter.upper())) for n, df in found.items()}


def process_quarter(spark: SparkSession, raw: str, output: str, year: int, quarter: str, tables=DATASETS, spec: StudySpec = Z_DRUGS_AND_FALLS) -> dict[str, str]:
    """Write relations of a quarter, bucketed by case id.

    For all of them, each is computed once: children read the written base, and the star joins read written relations, whose
    buckets meet without an exchange.
    """
    reports = quarter_reports(spark, raw, year, quarter)
    if tuple(tables) != DATASETS:
        relations = quarter_relations(reports, year, quarter, spec)
        return {name: sinks.write_bucketed(relations[name], output, name) for name in tables}
    paths = {}

    def kept(name: str, df: DataFrame) -> DataFrame:
        dated = df.withColumn("year", F.lit(year)).withColumn("quarter", F.lit(quarter.upper()))
        paths[name] = sinks.write_bucketed(dated, output, name)
        return sinks.read_bucketed(spark, output, name, dated.schema).where((F.col("year") == year) & (F.col("quarter") == quarter.upper()))

    base = kept("case_base", cohort.case_base(reports.demo, reports.deleted, spec))
    rows = kept("drug", cases.drug_rows(reports.drug, base))
    drugs = cases.drug_cases(rows, spec)
    features, exposure = kept("drug_feature", cases.drug_feature(drugs)), kept("drug_exposure", cases.drug_exposure(drugs))
    reactions = kept("reac_case", cases.reaction_cases(reports.reac, base, spec)).drop("year", "quarter")
    outcomes = kept("outc_case", cases.outcome_cases(cases.outcome_tokens(reports.outc, base), spec)).drop("year", "quarter")
    drugs = features.drop("year", "quarter").join(exposure.drop("year", "quarter"), "caseid")
    kept("case_dataset", cases.case_dataset(base, drugs, reactions, outcomes))
    kept("signal_dataset", cases.signal_dataset(base, drugs, reactions, outcomes))
    return paths


def is_complete(spark: SparkSession, output: str, year: int, quarter: str, name: str = "signal_dataset") -> bool:
    """Whether a quarter's relation is there, in files that were written to their end."""
    files = store.files_below(spark, f"{output}/{name}/year={year}/quarter={quarter}", ".parquet")
    return bool(files) and all(store.looks_like_parquet(spark, f.path) for f in files)


def process_year(spark: SparkSession, raw: str, output: str, year: int, force: bool = False, spec: StudySpec = Z_DRUGS_AND_FALLS) -> dict[str, DataFrame]:
    """Quarters that are not there yet, then the year's analyses; a year is a partition filter, not a copy.

    Of a finished year, all quarters and results there, the signal results are read back and nothing is done anew.
    """
    missing = [q for q in QUARTERS if force or not is_complete(spark, output, year, q)]
    finished = f"{output}/analysis/{year}/{SIGNALS}.csv"
    if not missing and store.exists(spark, finished) and store.exists(spark, f"{output}/analysis/{year}/summary.txt"):
        return {SIGNALS: sinks.read_csv(spark, finished)}
    for quarter in missing:
        process_quarter(spark, raw, output, year, quarter, spec=spec)
    results = analyse(spark, sinks.read_dataset(spark, output, "signal_dataset", year), sinks.read_dataset(spark, output, "case_dataset", year), spec)
    folder = Path(output) / "analysis" / str(year)
    for name, table in results.items():
        sinks.write_csv(table, folder / f"{name}.csv")
    sinks.write_text(year_summary(year, results), folder / "summary.txt")
    return results


def analyse(spark: SparkSession, signals: DataFrame, dataset: DataFrame, spec: StudySpec) -> dict[str, DataFrame]:
    order = [F.asc("analysis"), F.asc("outcome_name"), F.desc_nulls_last("ror")]
    return {
        SIGNALS: full_measures(analyses.signal_tables(signals, spec)),
        "01_signal_qc": analyses.signal_qc(signals),
        "02_comparative_results": full_measures(analyses.comparative_tables(signals, spec)),
        "02_group_qc": analyses.group_qc(signals),
        "03_feature_results": full_measures(analyses.feature_tables(dataset, spec)).orderBy(*order),
        "03_feature_qc": analyses.feature_qc(dataset, spec),
        "04_age_rates": analyses.age_rates(signals),
        "04_age_crosstab": trend.crosstab(signals),
        "04_age_tests": _tests(spark, signals),
        "04_age_logistic": trend.age_trend_logistic(dataset),
        "quarter_summary": report.quarter_summary(dataset),
    }


def _tests(spark: SparkSession, signals: DataFrame) -> DataFrame:
    values = trend.trend_tests(analyses.age_rates(signals))
    return spark.createDataFrame([(k, None if v is None else float(v)) for k, v in values.items()], "statistic string, value double")


def year_summary(year: int, results: dict[str, DataFrame], top: int = 5) -> str:
    """Plain text: overall signals, and the strongest features of each analysis and outcome."""
    lines = [f"Year {year}", ""]
    for r in results[SIGNALS].where("stratum = 'overall'").orderBy("analysis", "outcome_name").collect():
        lines.append(f"{r.analysis} {r.outcome_name}: a={r.a} n={r.n} ror={r.ror} prr={r.prr} {r.conclusion}")
    seen: dict[tuple, int] = {}
    for r in results["03_feature_results"].collect():
        key = (r.analysis, r.outcome_name)
        seen[key] = seen.get(key, 0) + 1
        if seen[key] <= top:
            lines.append(f"feature {r.analysis} {r.outcome_name} {r.feature}={r.level}: ror={r.ror}")
    return "\n".join(lines) + "\n"


def trend_row(year: int, results: DataFrame) -> DataFrame:
    """A year's overall rows in the columns of the trend file; absent columns become null."""
    rows = results.where("stratum = 'overall'").withColumn("year", F.lit(year))
    if "outcome_definition" not in rows.columns:
        rows = rows.withColumn("outcome_definition", F.when(F.col("outcome_name") == "broad_fall", "Broad fall definition").otherwise("Narrow fall definition"))
    for name in TREND_COLUMNS:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None))
    return rows.select(*TREND_COLUMNS)


def process_years(spark: SparkSession, raw: str, output: str, first: int, last: int, force: bool = False, spec: StudySpec = Z_DRUGS_AND_FALLS) -> DataFrame:
    rows = [trend_row(y, process_year(spark, raw, output, y, force, spec)[SIGNALS]) for y in range(first, last + 1)]
    whole = rows[0]
    for row in rows[1:]:
        whole = whole.unionByName(row, allowMissingColumns=True)
    sinks.write_csv(whole, Path(output) / "analysis" / f"trend_{first}_{last}.csv")
    return whole


def build_period(spark: SparkSession, output: str, first: int = 2004, last: int = 2025) -> dict[str, DataFrame]:
    """Index, signal and feature rows across quarters, written once, with their counts."""
    bases, signals, features = (sinks.read_bucketed(spark, output, name) for name in ("case_base", "signal_dataset", "drug_feature"))
    index = periods.global_index(bases, first, last, clean=False).cache()
    signals = periods.signal_of_period(index, signals, clean=False)
    features = periods.features_of_period(index, features.withColumn("year_quarter", F.concat(F.col("year").cast("string"), F.col("quarter"))))
    token = f"{first}_{last}"
    with sinks.joined_by_bucket(spark):
        for name, df in (("global_case_index", index), ("signal_dataset", signals), ("feature_dataset", features)):
            df.write.mode("overwrite").parquet(f"{output}/period/{name}_{token}")
        sinks.write_csv(periods.period_summary(index, signals, features), Path(output) / "period" / f"summary_{token}.csv")
    return {"index": index, "signals": signals, "features": features}


def descriptive_report(dataset: DataFrame, folder: str, spec: StudySpec = Z_DRUGS_AND_FALLS) -> dict[str, DataFrame]:
    """Thirteen tables as CSV, and one Markdown file."""
    tables = {
        "01_overview": report.overview(dataset),
        "02_missingness": report.missingness(dataset, report.KEY_COLUMNS),
        "03_age_summary": report.numeric_summary(dataset),
        "04_age_group": report.distribution(dataset, "age_group"),
        "05_sex": report.distribution(dataset, "sex_clean"),
        "06_serious": report.flag_distribution(dataset, ["serious", "is_serious_any"], only_known=True),
        "07_outcome": report.flag_distribution(dataset, ["is_fall_narrow", "is_fall_broad"]),
        "08_exposure": report.flag_distribution(dataset, ["is_zolpidem_any", *cases.SUSPECT]),
        "09_target_drug_group": report.distribution(dataset, "target_drug_group").union(report.distribution(dataset, "target_drug_group_ps")),
        "10_medication_burden": report.flag_distribution(dataset, ["polypharmacy_5", "polypharmacy"]),
        "11_comedication": report.flag_distribution(dataset, list(spec.comedication)),
        "12_exposure_outcome_crosstab": report.exposure_outcome_crosstab(
            dataset, ["is_zolpidem_any", "is_zolpidem_suspect", "is_zolpidem_suspect_ps"], ["is_fall_narrow", "is_fall_broad"]
        ),
        "13_top_broad_pt": report.top_terms(dataset),
    }
    for name, table in tables.items():
        sinks.write_csv(table, Path(folder) / f"{name}.csv")
    sinks.write_text(report.markdown("Descriptive report", tables), Path(folder) / "report.md")
    return tables
