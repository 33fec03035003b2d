"""Registered queries over the generated tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signal
from ..functions.text import truth
from ..ml import metrics, models
from ..operators import analyses, cases, cohort, periods, report, trend
from ..sources.order_tables import Reports, order_reports
from ..sources.sinks import stored
from . import oracle as O
from .study import ORDER_TABLES as SPEC

QUARTER_KEYS = ("year", "quarter", "caseid")


class Relations:
    """The case-level relations of one folder, built when asked for.

    The retained reports and their drug and reaction rows are written once (``sinks.stored``): every child relation reads them,
    and none joins or ranks the order tables again.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: tuple[str, ...] = ("caseid",)):
        self.spark, self.folder = spark, folder
        self.reports: Reports = order_reports(spark, folder)
        self.base = cohort.case_base(self.reports.demo, self.reports.deleted, SPEC, keys)
        if len(keys) > 1:  # quarterly relations: a report belongs to one period, so the period rides on the case id
            self.base = self.base.withColumn("caseid", F.concat_ws("@", "caseid", "year_quarter"))

    @cached_property
    def retained(self) -> DataFrame:
        """``base``, for what reads it more than once."""
        return stored(self.base, "case-base")

    @cached_property
    def children(self) -> Reports:
        """The reports with drug and reaction rows of retained ones only."""
        return order_reports(self.spark, self.folder, self.retained)

    @cached_property
    def drug_rows(self) -> DataFrame:
        return cases.drug_rows(self.children.drug, self.retained)

    @cached_property
    def drugs(self) -> DataFrame:
        return cases.drug_cases(self.drug_rows, SPEC)

    @cached_property
    def reactions(self) -> DataFrame:
        return cases.reaction_cases(self.children.reac, self.retained, SPEC)

    @cached_property
    def tokens(self) -> DataFrame:
        return cases.outcome_tokens(self.reports.outc, self.retained)

    @cached_property
    def outcomes(self) -> DataFrame:
        return cases.outcome_cases(self.tokens, SPEC)

    @property
    def dataset(self) -> DataFrame:
        return cases.case_dataset(self.retained, self.drugs, self.reactions, self.outcomes)

    @property
    def signals(self) -> DataFrame:
        return cases.signal_dataset(self.retained, self.drugs, self.reactions, self.outcomes)


def _unkeyed(df: DataFrame) -> DataFrame:
    """Quarterly rows with the case id and the period apart again."""
    parts = F.split("caseid", "@")
    return df.withColumn("year_quarter", parts[1]).withColumn("caseid", parts[0])


class Periods:
    """Quarterly relations and the full-period relations over them.

    Signals and features are only built for the quarterly reports that the index has: a case's rows of other quarters would be
    built to be left out by the join with the index.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.quarterly = Relations(spark, folder, QUARTER_KEYS)

    @cached_property
    def every(self) -> DataFrame:
        """The retained report of each case and quarter."""
        return stored(self.quarterly.base, "quarterly-base")

    @cached_property
    def index(self) -> DataFrame:
        return stored(periods.global_index(_unkeyed(self.every), 1990, 2025), "index")

    @cached_property
    def _reports(self) -> Relations:
        """The quarterly relations of the reports in the index."""
        r = self.quarterly
        r.base = self.every.join(self.index.select(F.concat_ws("@", "caseid", "year_quarter").alias("caseid")), "caseid", "left_semi")
        return r

    @cached_property
    def signals(self) -> DataFrame:
        return periods.signal_of_period(self.index, _unkeyed(self._reports.signals).drop("year_quarter"))

    @cached_property
    def features(self) -> DataFrame:
        return periods.features_of_period(self.index, _unkeyed(cases.drug_feature(self._reports.drugs)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _on_cases(build: Callable[[Relations], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: rounded(build(Relations(spark, folder)))


def _on_periods(build: Callable[[Periods], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: rounded(build(Periods(spark, folder)))


KEYS = ["analysis", "outcome_name", "stratum", "level"]
FEATURE_KEYS = ["analysis", "outcome_name", "domain", "feature", "level"]
CELLS = ["a", "b", "c", "d", "n"]
FLAGS = ["signal_flag_mhra", "signal_flag_ror", "signal_flag_ic", "signal_flag_ebgm"]
RATIOS = ["reporting_rate_exposed", "reporting_rate_unexposed", "ror", "ror_ci_low", "ror_ci_high", "prr", "prr_ci_low", "prr_ci_high"]
POINTS = [*RATIOS, "chi_square_yates", "expected_a", "ic", "ebgm"]


def _points(cells: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return signal.point_measures(cells).select(*keys, *columns)


def _no_burden(r: Relations) -> DataFrame:
    """The signal relation does not carry polypharmacy, so that stratum is absent."""
    return r.signals


BOOLS = ["is_zolpidem_any", "is_zolpidem_suspect", "is_other_zdrug_suspect", "is_benzo", "is_antidepressant", "polypharmacy_5", "serious", "is_fall_narrow", "is_fall_broad"]
EXPOSURES = ["is_zolpidem_any", "is_zolpidem_suspect", "is_zolpidem_suspect_ps"]
OUTCOMES = ["is_fall_narrow", "is_fall_broad"]


def _sum_rows(names: list[str], template: str) -> str:
    return " union all ".join(template.format(c=c) for c in names)


_PCT = "coalesce(round(100.0 * {n} / nullif((select count(*) from case_dataset), 0), 2), 0.0)"

#: name -> (query, SQL or None)
CATALOGUE: dict[str, tuple[Callable, str | None]] = {
    # cohort
    "latest_case_version": (
        _on_cases(lambda r: cohort.latest_versions(r.reports.demo).select("caseid", "primaryid", "fda_dt", "caseversion")),
        "with " + O.DEMO + " select caseid, primaryid, fda_dt, caseversion from demo qualify row_number() over (partition by caseid "
        "order by fda_dt desc nulls first, caseversion desc nulls first, primaryid desc nulls first) = 1",
    ),
    "deleted_anti_join": (
        _on_cases(lambda r: cohort.drop_deleted(r.reports.demo, r.reports.deleted).select("caseid", "primaryid")),
        "with " + O.DEMO + " select caseid, primaryid from demo d where not exists (select 1 from deleted x where x.caseid = d.caseid)",
    ),
    "deletion_counts": (
        _on_cases(lambda r: cohort.deletion_counts(r.reports.demo, r.reports.deleted)),
        "with " + O.DEMO + " select count(*) as removed_rows, count(distinct caseid) as removed_cases from demo where caseid in (select caseid from deleted)",
    ),
    "demographic_cohort": (
        _on_cases(lambda r: r.base),
        "with " + O.CASE_BASE + " select caseid, primaryid, fda_dt, round(age_years, 6) as age_years, age_group, sex_clean, year, quarter, year_quarter from case_base",
    ),
    "age_unit_years": (
        _on_cases(lambda r: r.reports.demo.select("primaryid", cohort.age_years(cohort.number(F.col("age")), F.col("age_cod")).alias("age_years"), "age_cod")),
        "select o_orderkey as primaryid, cast(60 + c_custkey % 40 as double) as age_years, case when c_nationkey % 5 = 0 then 'MON' else 'YR' end as age_cod "
        "from orders join customer on o_custkey = c_custkey",
    ),
    # drugs
    "drug_row_filtered": (
        _on_cases(lambda r: r.drug_rows.select("caseid", "primaryid", "drugname", "prod_ai", "role_cod")),
        O.CASES + " select caseid, primaryid, drugname, prod_ai, role_cod from drug",
    ),
    "caseid_backfill": (
        _on_cases(lambda r: r.drug_rows.groupBy("primaryid", "caseid").agg(F.count("*").alias("n_rows"))),
        O.CASES + " select primaryid, caseid, count(*) as n_rows from drug group by all",
    ),
    "drug_feature_case": (_on_cases(lambda r: cases.drug_feature(r.drugs)), O.CASES + f" select {', '.join(O.FEATURE)} from drug_cases"),
    "drug_exposure_case": (
        _on_cases(lambda r: cases.drug_exposure(r.drugs)),
        O.CASES + f" select caseid, {', '.join(O.SUSPECT)}, target_drug_group, target_drug_group_ps from drug_cases",
    ),
    "target_group_counts": (
        _on_cases(lambda r: r.drugs.groupBy("target_drug_group", "target_drug_group_ps").agg(F.count("*").alias("n_cases"))),
        O.CASES + " select target_drug_group, target_drug_group_ps, count(*) as n_cases from drug_cases group by all",
    ),
    "polypharmacy_counts": (
        _on_cases(lambda r: r.drugs.groupBy("polypharmacy_5").agg(F.count("*").alias("n_cases"), F.sum("drug_n").alias("n_drugs"))),
        O.CASES + " select polypharmacy_5, count(*) as n_cases, cast(sum(drug_n) as bigint) as n_drugs from drug_cases group by all",
    ),
    # reactions and outcomes
    "reac_case": (
        _on_cases(lambda r: r.reactions),
        O.CASES + " select caseid, is_fall_narrow, fall_narrow_pt_count, all_reac_n, is_fall_broad, fall_pt_list from reac_case",
    ),
    "pt_frequency_target": (
        _on_cases(lambda r: cases.term_profile(r.children.reac, r.retained, r.drugs)),
        O.CASES + ", t as (select d.caseid, pt from drug d join drug_cases c using (caseid) where is_zolpidem_suspect), p as (select pt, count(*) as n_rows, "
        "count(distinct caseid) as n_cases from t group by pt) select row_number() over (order by n_cases desc, n_rows desc, pt) as rank, pt, n_rows, n_cases, "
        "round(100.0 * n_rows / (select count(*) from t), 6) as row_percent, round(100.0 * n_cases / (select count(distinct caseid) from t), 6) as case_percent from p",
    ),
    "outc_tokens_case": (
        _on_cases(lambda r: r.outcomes),
        O.CASES + f" select caseid, {', '.join(O.OUTC)}, is_serious_any from outc_case",
    ),
    "unknown_outc_codes": (
        _on_cases(lambda r: cases.unknown_codes(r.tokens, SPEC)),
        O.CASES + f" select code, count(*) as n_rows from outc where code not in {O._in(SPEC.outcome_codes)} group by code order by n_rows desc, code limit 20",
    ),
    # star joins
    "case_dataset": (_on_cases(lambda r: r.dataset), O.CASES + " select * replace (round(age_years, 6) as age_years) from case_dataset"),
    "signal_dataset": (_on_cases(lambda r: r.signals), O.CASES + f" select {', '.join(O.SIGNAL)} from case_dataset"),
    "repeated_case_keys": (
        _on_cases(lambda r: cases.repeated_keys(r.reports.demo)),
        "with " + O.DEMO + " select caseid, count(*) as n_rows from demo group by caseid having count(*) > 1 order by caseid limit 10",
    ),
    # full period
    "global_case_index": (_on_periods(lambda p: p.index), O.PERIODS + O._INDEX + " select * from global_index"),
    "signal_global": (
        _on_periods(lambda p: p.signals),
        O.PERIODS + O._INDEX + f" select {', '.join(O.SIGNAL)} from case_dataset join global_index using (caseid, year, quarter)",
    ),
    "feature_global": (
        _on_periods(lambda p: p.features),
        O.PERIODS + O._INDEX + f" select year_quarter, {', '.join(O.FEATURE)} from drug_cases join global_index using (caseid, year_quarter)",
    ),
    "global_qc_counts": (
        _on_periods(lambda p: periods.table_counts(global_case_index=p.index, signal_global=p.signals, feature_global=p.features)),
        O.PERIODS + O._INDEX + " select 'global_case_index' as table_name, count(*) as n_rows from global_index union all select 'signal_global', count(*) from "
        "case_dataset join global_index using (caseid, year, quarter) union all select 'feature_global', count(*) from drug_cases join global_index using (caseid, year_quarter)",
    ),
    "global_signal_summary": (
        _on_periods(lambda p: periods.period_summary(p.index, p.signals, p.features)),
        O.PERIODS + O._INDEX + ", s as (select c.* from case_dataset c join global_index using (caseid, year, quarter)) "
        + "select 'global_total_cases' as metric, (select count(*) from global_index) as value union all select 'signal_dataset_cases', (select count(*) from s) "
        + "union all select 'feature_dataset_cases', (select count(*) from drug_cases join global_index using (caseid, year_quarter)) "
        + "".join(
            f" union all select '{n}', (select count(*) from s where {f})"
            for n, f in {
                "strict_fall_cases": "is_fall_narrow", "broad_fall_cases": "is_fall_broad", "suspect_any_cases_ps_ss": "suspect_role_any",
                "suspect_any_cases_ps_only": "suspect_role_any_ps", "zolpidem_any_cases": "is_zolpidem_any", "zolpidem_suspect_cases_ps_ss": "is_zolpidem_suspect",
                "zolpidem_suspect_cases_ps_only": "is_zolpidem_suspect_ps", "other_zdrug_suspect_cases_ps_ss": "is_other_zdrug_suspect",
                "other_zdrug_suspect_cases_ps_only": "is_other_zdrug_suspect_ps",
            }.items()
        )
        + "".join(
            f" union all select 'group_{l}_{g}', (select count(*) from s where {c} = '{g}')"
            for l, c in (("ps_ss", "target_drug_group"), ("ps_only", "target_drug_group_ps"))
            for g in ("no_suspect_drug", "no_target_zdrug_suspect", "other_zdrug_only", "zolpidem_only", "both_zolpidem_and_other_zdrug")
        ),
    ),
    # disproportionality
    "signal_2x2": (
        _on_cases(lambda r: analyses.two_by_two(r.signals.where("suspect_role_any"), "is_zolpidem_suspect", "is_fall_narrow")),
        O.CASES + f" select {O._cells('is_zolpidem_suspect', 'is_fall_narrow')} from case_dataset where suspect_role_any",
    ),
    "signal_ror_prr": (
        _on_cases(lambda r: _points(analyses.signal_tables(r.signals, SPEC, strata=False), KEYS, [*CELLS, *RATIOS])),
        O.CASES + O.measures(O.signal_cells(False), KEYS, [*KEYS, *CELLS, *RATIOS]),
    ),
    "signal_chi_yates": (
        _on_cases(lambda r: _points(analyses.signal_tables(r.signals, SPEC, strata=False), KEYS, ["chi_square_yates", "expected_a"])),
        O.CASES + O.measures(O.signal_cells(False), KEYS, [*KEYS, "chi_square_yates", "expected_a"]),
    ),
    "signal_ic_ebgm_point": (
        _on_cases(lambda r: _points(analyses.signal_tables(r.signals, SPEC, strata=False), KEYS, ["ic", "ebgm"])),
        O.CASES + O.measures(O.signal_cells(False), KEYS, [*KEYS, "ic", "ebgm"]),
    ),
    "signal_stratified": (
        _on_cases(lambda r: _points(analyses.signal_tables(_no_burden(r), SPEC), KEYS, [*CELLS, *POINTS])),
        O.CASES + O.measures(O.signal_cells(True, skip=("polypharmacy_5",)), KEYS, [*KEYS, *CELLS, *POINTS]),
    ),
    "comparative_2x2": (
        _on_cases(lambda r: _points(analyses.comparative_tables(r.signals, SPEC), KEYS, [*CELLS, *POINTS])),
        O.CASES + O.measures(O.comparative_cells(), KEYS, [*KEYS, *CELLS, *POINTS]),
    ),
    "feature_disprop": (
        _on_cases(lambda r: _points(analyses.feature_tables(r.dataset, SPEC), FEATURE_KEYS, [*CELLS, *POINTS])),
        O.CASES + O.measures(O.feature_cells(), FEATURE_KEYS, [*FEATURE_KEYS, *CELLS, *POINTS]),
    ),
    "signal_full_measures": (_on_cases(lambda r: signal.full_measures(analyses.signal_tables(r.signals, SPEC))), None),
    "signal_flags": (
        _on_cases(lambda r: signal.full_measures(analyses.signal_tables(r.signals, SPEC)).select(*KEYS, *FLAGS, "conclusion")),
        O.CASES + O.flags(O.signal_cells(True, skip=("polypharmacy_5",)), KEYS),
    ),
    "comparative_flags": (
        _on_cases(lambda r: signal.full_measures(analyses.comparative_tables(r.signals, SPEC)).select(*KEYS, *FLAGS, "conclusion")),
        O.CASES + O.flags(O.comparative_cells(), KEYS),
    ),
    "signal_qc": (
        _on_cases(lambda r: analyses.signal_qc(r.signals)),
        O.CASES + " select count(*) as n_cases, count(*) filter (is_zolpidem_suspect) as n_exposed, count(*) filter (not is_zolpidem_suspect) as n_unexposed, "
        "count(*) filter (is_fall_narrow) as n_outcome, count(*) filter (is_zolpidem_suspect and is_fall_narrow) as n_both, count(*) filter (age_group is null) as "
        "missing_age_group, count(*) filter (sex_clean is null) as missing_sex_clean, count(*) filter (serious is null) as missing_serious, "
        "cast(-1 as bigint) as missing_polypharmacy_5 from case_dataset",
    ),
    "comparative_qc": (
        _on_cases(lambda r: analyses.group_qc(r.signals)),
        O.CASES + " select target_drug_group as drug_group, count(*) as n_cases, count(*) filter (is_fall_narrow) as n_narrow, count(*) filter (is_fall_broad) as n_broad, "
        "round(avg(cast(is_fall_narrow as double)), 6) as narrow_rate, count(*) filter (sex_clean = 'F') as n_female, "
        "count(*) filter (age_group in ('75-84', '>=85')) as n_75_plus from case_dataset group by target_drug_group",
    ),
    "feature_qc": (
        _on_cases(lambda r: analyses.feature_qc(r.dataset, SPEC)),
        O.CASES + " select count(*) as n_exposed, " + ", ".join(f"count(*) filter ({c}) as n_{c}" for c in ["serious", "polypharmacy_5", *SPEC.comedication])
        + " from case_dataset where is_zolpidem_suspect",
    ),
    "yearly_trend": (
        _on_cases(lambda r: _points(analyses.year_trend(r.signals), ["year"], [*CELLS, *POINTS])),
        O.CASES + O.measures(
            f"select year, {O._cells('is_zolpidem_suspect', 'is_fall_narrow')} from case_dataset where suspect_role_any and "
            "target_drug_group <> 'both_zolpidem_and_other_zdrug' group by year", ["year"], ["year", *CELLS, *POINTS]),
    ),
    # age trend
    "age_rates": (
        _on_cases(lambda r: analyses.age_rates(r.signals)),
        O.CASES + " select g.age_order, g.age_group, coalesce(n, 0) as n_cases, coalesce(k, 0) as n_outcome, round(coalesce(k * 1.0 / n, 0.0), 6) as rate from "
        "(values (0, '65-74'), (1, '75-84'), (2, '>=85')) as g(age_order, age_group) left join (select age_group, count(*) as n, count(*) filter (is_fall_narrow) as k "
        "from case_dataset where is_zolpidem_suspect group by age_group) using (age_group)",
    ),
    "age_crosstab": (
        _on_cases(lambda r: trend.crosstab(r.signals)),
        O.CASES + " select age_group, count(*) filter (not is_fall_narrow) as no_outcome, count(*) filter (is_fall_narrow) as outcome from case_dataset "
        "where is_zolpidem_suspect group by age_group",
    ),
    "age_trend_tests": (
        _on_cases(lambda r: trend.trend_statistics(analyses.age_rates(r.signals))),
        O.CASES + """, e as (select case age_group when '65-74' then 0.0 when '75-84' then 1.0 else 2.0 end as s, cast(is_fall_narrow as int) as y from case_dataset where is_zolpidem_suspect),
        r as (select *, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as rs, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ry from e),
        q as (select avg(y) as q, avg(s) as ms, count(*) as n from e),
        c as (select s, count(*) as n, sum(y) as k from e group by s)
        select (select n from q) as n_cases,
          round((select sum((k - n * q.q) ** 2 / (n * q.q) + (n - k - n * (1 - q.q)) ** 2 / (n * (1 - q.q))) from c, (select q from q) q), 6) as pearson_chi_square, 2 as df,
          round(exp(-(select sum((k - n * q.q) ** 2 / (n * q.q) + (n - k - n * (1 - q.q)) ** 2 / (n * (1 - q.q))) from c, (select q from q) q) / 2), 6) as pearson_p,
          round((select corr(rs, ry) from r), 6) as spearman_rho,
          round((select sum((s - q.ms) * (y - q.q)) from e, q) / sqrt((select q * (1 - q) from q) * (select sum((s - q.ms) ** 2) from e, q)), 6) as trend_z""",
    ),
    "age_trend_logistic": (_on_cases(lambda r: trend.age_trend_logistic(stored(r.dataset.where(truth("is_zolpidem_suspect")), "exposed"))), None),
    # report
    "report_overview": (
        _on_cases(lambda r: report.overview(r.dataset)),
        O.CASES + " select unnest(['n_rows', 'n_caseid', 'n_primaryid', 'n_columns', 'years', 'quarters', 'first_date', 'last_date']) as indicator, unnest([cast(count(*) as varchar), "
        "cast(count(distinct caseid) as varchar), cast(count(distinct primaryid) as varchar), '45', string_agg(distinct cast(year as varchar), ',' order by cast(year as varchar)), "
        "string_agg(distinct quarter, ',' order by quarter), cast(min(fda_dt) as varchar), cast(max(fda_dt) as varchar)]) as value from case_dataset",
    ),
    "report_missingness": (
        _on_cases(lambda r: report.missingness(r.dataset, report.KEY_COLUMNS)),
        O.CASES + ", x as (" + _sum_rows(report.KEY_COLUMNS, "select '{c}' as variable, count(*) filter ({c} is null) as n_missing from case_dataset")
        + ") select variable, n_missing, " + _PCT.format(n="n_missing") + " as percent from x where variable <> 'serious' or (select count(serious) > 0 or count(is_serious_any) = 0 from case_dataset)",
    ),
    "report_age_summary": (
        _on_cases(lambda r: report.numeric_summary(r.dataset)),
        O.CASES + " select count(age_years) as n, round(avg(age_years), 2) as mean, round(stddev_samp(age_years), 2) as sd, round(quantile_cont(age_years, 0.5), 2) as median, "
        "round(quantile_cont(age_years, 0.25), 2) as p25, round(quantile_cont(age_years, 0.75), 2) as p75, round(min(age_years), 2) as min, round(max(age_years), 2) as max from case_dataset",
    ),
    **{
        f"report_{c}": (
            _on_cases(partial(lambda c, r: report.distribution(r.dataset, c), c)),
            O.CASES + f" select '{c}' as variable, coalesce({c}, 'missing') as level, count(*) as n, round(100.0 * count(*) / (select count(*) from case_dataset), 2) as percent "
            f"from case_dataset group by {c}",
        )
        for c in ("age_group", "sex_clean", "target_drug_group")
    },
    "report_flags": (
        _on_cases(lambda r: report.flag_distribution(r.dataset, BOOLS)),
        O.CASES + ", x as (" + _sum_rows(BOOLS, "select '{c}' as variable, count(*) filter ({c}) as n from case_dataset") + ") select variable, n, " + _PCT.format(n="n") + " as percent from x",
    ),
    "report_crosstab": (
        _on_cases(lambda r: report.exposure_outcome_crosstab(r.dataset, EXPOSURES, OUTCOMES)),
        O.CASES + ", x as (" + " union all ".join(
            f"select '{e}' as exposure, '{o}' as outcome, {s} as exposed, count(*) filter ({e} = {s}) as n_cases, count(*) filter ({e} = {s} and {o}) as n_outcome from case_dataset"
            for e in EXPOSURES for o in OUTCOMES for s in ("true", "false"))
        + ") select *, coalesce(round(n_outcome * 1.0 / nullif(n_cases, 0), 6), 0.0) as rate from x",
    ),
    "report_medication_burden": (
        _on_cases(lambda r: r.dataset.groupBy("polypharmacy").agg(F.count("*").alias("n_cases"), F.avg("drug_n").alias("mean_drugs"), F.avg("distinct_drug_n").alias("mean_distinct"))),
        O.CASES + " select polypharmacy, count(*) as n_cases, round(avg(drug_n), 6) as mean_drugs, round(avg(distinct_drug_n), 6) as mean_distinct from case_dataset group by polypharmacy",
    ),
    "top_broad_pt": (
        _on_cases(lambda r: report.top_terms(r.dataset)),
        O.CASES + ", t as (select distinct caseid, unnest(string_split(fall_pt_list, '|')) as pt from case_dataset where fall_pt_list <> '') select pt, count(*) as n_cases, "
        "round(100.0 * count(*) / (select count(*) from case_dataset), 2) as percent_all, round(100.0 * count(*) / (select count(*) from case_dataset where is_fall_broad), 2) as percent_broad "
        "from t group by pt order by n_cases desc, pt limit 20",
    ),
    "quarter_summary": (
        _on_cases(lambda r: report.quarter_summary(r.dataset)),
        O.CASES + " select year, quarter, count(*) as n_cases, " + ", ".join(f"count(*) filter ({f}) as n_{f}" for f in ("is_fall_narrow", "is_fall_broad", "is_zolpidem_any", "is_zolpidem_suspect", "serious"))
        + " from case_dataset group by year, quarter",
    ),
}


def _scored(r: Relations) -> DataFrame:
    """Cases with a label and a fixed score formula, to compare metrics exactly."""
    score = F.least(F.lit(1.0), F.round((F.col("age_years") - 60) / 50.0 + F.col("distinct_drug_n") / 50.0, 2))
    return r.dataset.select(F.col("is_fall_narrow").cast("int").alias("label"), score.alias("score"))


_SCORED = O.CASES + (
    ", scored as (select cast(is_fall_narrow as int) as label, least(1.0, round((age_years - 60) / 50.0 + distinct_drug_n / 50.0, 2)) as score from case_dataset)"
    ", by_score as (select score, count(*) filter (label = 1) as p, count(*) filter (label = 0) as n from scored group by score)"
    ", pts as (select score as threshold, cast(sum(p) over w as bigint) as tp, cast(sum(n) over w as bigint) as fp, p from by_score window w as (order by score desc))"
    ", roc as (select threshold, tp, fp, tp * 1.0 / (select sum(p) from by_score) as tpr, fp * 1.0 / (select sum(n) from by_score) as fpr from pts)"
)
_FRAME = O.CASES + (
    ", frame as (select c.caseid, cast(is_fall_narrow as int) as label, age_group, sex_clean, quarter, cast(year as double) as year, cast(d.drug_n as double) as drug_n, "
    "cast(d.distinct_drug_n as double) as distinct_drug_n, " + ", ".join(f"cast(d.{c} as double) as {c}" for c in models.FLAGS) + " from case_dataset c join drug_cases d using (caseid))"
)


def _frame(r: Relations) -> DataFrame:
    return models.modelling_frame(r.signals, cases.drug_feature(r.drugs))


def _kept_frame(r: Relations) -> DataFrame:
    """The modelling frame written once: a fit reads it many times."""
    return stored(_frame(r), "frame")


def _forecast(r: Relations) -> DataFrame:
    """Logistic model of the earlier years on the last year; rows-only, models have no SQL."""
    frame = _kept_frame(r)
    train = models.balanced_weights(frame.where("year <= 1999"))
    return models.scores(models.fit(train, models.logistic(train, 100)), frame.where("year > 1999"))


def _tree_forecast(estimator: Callable, r: Relations) -> DataFrame:
    """Trees of the earlier years on the last year; rows-only, tests compare with brute force."""
    frame = _kept_frame(r)
    return models.scores(models.fit(frame.where("year <= 1999"), estimator()), frame.where("year > 1999"))


CATALOGUE |= {
    "modelling_frame": (_on_cases(_frame), _FRAME + " select * from frame"),
    "temporal_split_summary": (
        _on_cases(lambda r: models.split_summary(models.temporal_split(_kept_frame(r), 1999, 2000, 2001))),
        _FRAME + " select case when year <= 1999 then 'train' when year = 2000 then 'valid' else 'test' end as part, count(*) as n_rows, cast(sum(label) as bigint) as n_positive from frame group by 1",
    ),
    "confusion_metrics": (
        _on_cases(lambda r: metrics.confusion(_scored(r))),
        _SCORED + ", c as (select count(*) filter (score >= 0.5 and label = 1) as tp, count(*) filter (score >= 0.5 and label = 0) as fp, "
        "count(*) filter (score < 0.5 and label = 1) as fn, count(*) filter (score < 0.5 and label = 0) as tn from scored) select tp, fp, fn, tn, "
        "round((tp + tn) * 1.0 / (tp + fp + fn + tn), 6) as accuracy, round(coalesce(tp * 1.0 / nullif(tp + fp, 0), 0), 6) as precision, "
        "round(coalesce(tp * 1.0 / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1, "
        "round(coalesce(tn * 1.0 / nullif(tn + fp, 0), 0), 6) as specificity from c",
    ),
    "roc_points": (
        _on_cases(lambda r: metrics.roc_points(_scored(r))),
        _SCORED + " select threshold, tp, fp, round(tpr, 6) as tpr, round(fpr, 6) as fpr from roc",
    ),
    "youden_threshold": (
        _on_cases(lambda r: metrics.youden_threshold(_scored(r))),
        _SCORED + " select threshold, round(tpr - fpr, 6) as youden_j from roc order by round(tpr - fpr, 12) desc, threshold desc limit 1",
    ),
    "roc_auc": (
        _on_cases(lambda r: metrics.auc(_scored(r))),
        _SCORED + " select round(sum((a.p * b.n) * case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end) / "
        "((select sum(p) from by_score) * (select sum(n) from by_score)), 6) as roc_auc from by_score a, by_score b",
    ),
    "average_precision": (
        _on_cases(lambda r: metrics.average_precision(_scored(r))),
        _SCORED + " select round(sum(p * tp * 1.0 / (tp + fp)) / (select sum(p) from by_score), 6) as average_precision from pts",
    ),
    "brier": (_on_cases(lambda r: metrics.brier(_scored(r))), _SCORED + " select round(avg((score - label) ** 2), 6) as brier from scored"),
    "calibration_bins": (
        _on_cases(lambda r: metrics.calibration_bins(stored(_scored(r), "scored"))),
        _SCORED + ", e as (select distinct unnest(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) as e from scored), "
        "b as (select row_number() over (order by e) - 1 as bin, lag(e) over (order by e) as lo, e as hi from e) "
        "select cast(bin as int) as bin, count(*) as n, round(avg(score), 6) as mean_score, round(avg(label), 6) as event_rate from scored join b "
        "on (score > lo and score <= hi) or (bin = 1 and score <= hi) where bin >= 1 group by bin",
    ),
    "logistic_forecast": (_on_cases(_forecast), None),
    "boosted_forecast": (_on_cases(partial(_tree_forecast, lambda: models.boosted(8, 3, 0.3))), None),
    "forest_forecast": (_on_cases(partial(_tree_forecast, lambda: models.forest(10, 6))), None),
}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Full disproportionality table of the study, overall and by stratum."""
    return CATALOGUE["signal_stratified"][0](spark, folder)
