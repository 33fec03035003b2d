"""Hand-made edge cases of cohort, drugs, reactions, outcomes and the period index."""

import datetime as dt
import math

import numpy as np
import pytest

from casewise.functions.text import mentions, strip
from casewise.operators import analyses, cases, cohort, periods, report, trend
from casewise.plans.study import Z_DRUGS_AND_FALLS as SPEC
from pyspark.sql import functions as F

DEMO = "caseid string, primaryid long, caseversion long, fda_dt date, age string, age_cod string, sex string, gndr_cod string, year int, quarter string, file_row long"
D = dt.date


def demo(spark, rows):
    return spark.createDataFrame(rows, DEMO)


def row(case, pid, day=D(2024, 1, 1), age="70", unit="YR", sex="F", other=None, version=1, line=0):
    return (case, pid, version, day, age, unit, sex, other, 2024, "Q1", line)


def test_missing_date_wins_in_a_quarter_and_loses_in_the_period(spark):
    rows = [row("1", 10), row("1", 11, None), row("1", 12, D(2024, 2, 1))]
    assert cohort.latest_versions(demo(spark, rows)).first().primaryid == 11
    bases = spark.createDataFrame([("1", 10, D(2024, 1, 1), 2024, "Q1", "2024Q1"), ("1", 11, None, 2024, "Q2", "2024Q2"), ("1", 12, D(2024, 2, 1), 2024, "Q3", "2024Q3")],
                                  "caseid string, primaryid long, fda_dt date, year int, quarter string, year_quarter string")
    assert periods.global_index(bases).first().primaryid == 12


def test_full_ties_go_to_the_later_file_row(spark):
    last = cohort.latest_versions(demo(spark, [row("1", 5, sex="F", line=1), row("1", 5, sex="M", line=2)])).first()
    assert last.sex == "M"


def test_ages_units_and_sexes(spark):
    ages = [("780", "MON"), ("6.5", "DEC"), ("65", "YR"), ("64.99", "YR"), ("120", "YR"), ("121", "YR"), ("70", "XX"), ("5d", "YR")]
    kept = cohort.case_base(demo(spark, [row(str(i), i, age=a, unit=u) for i, (a, u) in enumerate(ages)]), None, SPEC)
    assert sorted(r.primaryid for r in kept.collect()) == [0, 1, 2, 4]
    sexes = [("", "F"), ("U", "M"), ("U", None)]
    kept = cohort.case_base(demo(spark, [row(str(i), i, sex=s, other=o) for i, (s, o) in enumerate(sexes)]), None, SPEC)
    assert {r.primaryid: r.sex_clean for r in kept.collect()} == {0: "F", 1: "M"}
    groups = cohort.case_base(demo(spark, [row(str(i), i, age=a) for i, a in enumerate(["75", "84.9", "85"])]), None, SPEC)
    assert [r.age_group for r in groups.orderBy("primaryid").collect()] == ["75-84", "75-84", ">=85"]


def test_terms_need_boundaries(spark):
    texts = ["ZOLPIDEM 10MG", "ZOLPIDEMXR", "AMBIEN-CR", "XAMBIEN", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mentions(F.col("t"), F.lit(""), SPEC.target_terms)).collect()] == [True, False, True, False, False]


def _base(spark, *ids):
    return cohort.case_base(demo(spark, [row(str(i), i) for i in ids]), None, SPEC)


def test_drug_cases(spark):
    drug = spark.createDataFrame(
        [(1, "", "ESZOPICLONE", None, "PS"), (2, "", "ambien", "", "PS"), (2, "", "sonata ", "", "SS"), (3, "3", "x", "Zolpidem tartrate", "C"),
         (4, None, " ", "", "PS"), (99, "", "AMBIEN", "", "PS")],
        "primaryid long, caseid string, drugname string, prod_ai string, role_cod string")
    base = _base(spark, 1, 2, 3, 4)
    got = {r.caseid: r for r in cases.drug_cases(cases.drug_rows(drug, base), SPEC).collect()}
    assert set(got) == {"1", "2", "3"}
    assert got["1"].is_eszopiclone and not got["1"].is_zopiclone and got["1"].target_drug_group == "other_zdrug_only"
    assert got["2"].target_drug_group == "both_zolpidem_and_other_zdrug" and got["2"].target_drug_group_ps == "zolpidem_only"
    assert got["3"].is_zolpidem_any and not got["3"].is_zolpidem_suspect and got["3"].target_drug_group == "no_suspect_drug"
    assert got["2"].distinct_drug_n == 2 and got["2"].drug_n == 2


def test_reactions_count_rows_and_blanks(spark):
    reac = spark.createDataFrame([(1, "", p) for p in ["Fall", "FALL", "VERTIGO", "HEADACHE", ""]], "primaryid long, caseid string, pt string")
    r = cases.reaction_cases(reac, _base(spark, 1), SPEC).first()
    assert (r.is_fall_narrow, r.fall_narrow_pt_count, r.all_reac_n, r.fall_pt_list) == (True, 2, 5, "FALL|VERTIGO")


def test_outcome_tokens(spark):
    outc = spark.createDataFrame([(1, "", "DE,HO"), (2, "", "de/lt"), (3, "", "XX"), (4, "", None), (5, "", "DEATH")], "primaryid long, caseid string, outc_cod string")
    tokens = cases.outcome_tokens(outc, _base(spark, 1, 2, 3, 4, 5))
    got = {r.caseid: r for r in cases.outcome_cases(tokens, SPEC).collect()}
    assert set(got) == {"1", "2", "5"}
    assert got["1"].is_hospitalization and got["2"].is_life_threatening and got["5"].is_death and not got["5"].is_life_threatening
    assert [(r.code, r.n_rows) for r in cases.unknown_codes(tokens, SPEC).collect()] == [("AT", 1), ("XX", 1)]


def test_strip_takes_all_white_space(spark):
    df = spark.createDataFrame([(" \t x y  ",), (None,)], "t string")
    assert [r[0] for r in df.select(strip(F.col("t"))).collect()] == ["x y", ""]


def test_strata_sum_to_the_total_and_row_order_is_irrelevant(spark):
    rows = [(str(i), i % 3 == 0, i % 2 == 0, i % 2 == 0, True, "zolpidem_only" if i % 2 == 0 else "no_target_zdrug_suspect", ["65-74", "75-84", ">=85"][i % 3], "FM"[i % 2]) for i in range(60)]
    schema = "caseid string, is_fall_narrow boolean, is_zolpidem_suspect boolean, is_zolpidem_suspect_ps boolean, suspect_role_any boolean, target_drug_group string, age_group string, sex_clean string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "false as is_fall_broad", "suspect_role_any as suspect_role_any_ps", "target_drug_group as target_drug_group_ps")
    def table(d):
        return {(r.analysis, r.outcome_name, r.stratum, r.level): (r.a, r.b, r.c, r.d) for r in analyses.signal_tables(d, SPEC).collect()}
    got = table(df)
    assert got == table(df.orderBy(F.desc("caseid")).repartition(3))
    whole = got[("main_ps_ss", "strict_fall", "overall", "all")]
    assert sum(whole) == 60
    ages = [v for k, v in got.items() if k[:3] == ("main_ps_ss", "strict_fall", "age_group")]
    assert tuple(map(sum, zip(*ages))) == whole


def test_trend_of_nothing_is_defined(spark):
    empty = spark.createDataFrame([], "age_group string, is_zolpidem_suspect boolean, is_fall_narrow boolean")
    rates = analyses.age_rates(empty)
    assert [r.n_cases for r in rates.orderBy("age_order").collect()] == [0, 0, 0]
    tests = trend.trend_tests(rates)
    assert tests["pearson_chi_square"] is None and tests["trend_z"] == 0.0 and tests["trend_p_two_sided"] == 1.0


def test_logistic_with_a_separating_column_is_finite(spark):
    rows = [(1.0, 1.0)] * 20 + [(0.0, 1.0)] * 3 + [(0.0, 0.0)] * 17
    out = trend.logistic_inference(spark.createDataFrame(rows, "x double, y double"))
    assert [r["term"] for r in out] == ["intercept", "x"] and all(0 < r["odds_ratio"] < 1e23 for r in out)
    assert trend.logistic_inference(spark.createDataFrame([], "x double, y double")) == []


def test_logistic_inference_on_rows_matches_an_independent_solution(spark):
    rng = np.random.default_rng(2)
    n = 1_500
    x = np.column_stack([rng.standard_normal(n), rng.integers(0, 3, n), rng.random(n) < 0.3, np.full(n, 4.0)]).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(-1 + 0.8 * x[:, 0] - 0.4 * x[:, 1] + 0.9 * x[:, 2])))).astype(float)
    frame = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, same double, y double").repartition(4)
    out = {r["term"]: r for r in trend.logistic_inference(frame)}
    assert list(out) == ["intercept", "a", "b", "c"]
    z, w = np.column_stack([np.ones(n), x[:, :3]]), np.zeros(4)
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z, z.T @ (y - p))
    p = 1 / (1 + np.exp(-z @ w))
    se = np.sqrt(np.diag(np.linalg.inv((z * (p * (1 - p))[:, None]).T @ z)))
    for row, b, s in zip(out.values(), w, se, strict=True):
        assert abs(row["coefficient"] - b) < 1e-7 and abs(row["std_error"] - s) < 1e-7
        assert abs(row["p_value"] - math.erfc(abs(b / s) / math.sqrt(2))) < 1e-7
        assert abs(math.log(row["or_ci_high"]) - (b + 1.96 * s)) < 1e-6
    assert out["a"]["converged"] and abs(out["a"]["log_likelihood"] - (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()) < 1e-6


def test_trend_design_follows_age_order_and_sex(spark):
    rows = [("1", "65-74", "M", 2020, True, True), ("2", ">=85", "F", 2022, True, False), ("3", "75-84", "unknown", 2021, True, None), ("4", "unknown", "M", 2019, True, True), ("5", "65-74", "M", 2018, False, True)]
    cases_of = spark.createDataFrame(rows, "caseid string, age_group string, sex_clean string, year int, is_zolpidem_suspect boolean, is_fall_narrow boolean").withColumn("is_benzo", F.col("caseid") == "2")
    got = sorted((r.age_order, r.year_centered, r.sex_male, r.sex_unknown, r.is_benzo, r.serious, r.y) for r in trend.trend_design(cases_of).collect())
    assert got == [(0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), (1.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0), (2.0, 2.0, 0.0, 0.0, 1.0, 0.0, 0.0)]


def _star(spark, serious):
    """Two cases, the first serious by its outcome codes, with a ``serious`` column of the reports if any."""
    rows = [("1", 1, D(2024, 1, 1), 70.0, "65-74", "F", 2024, "Q1", "2024Q1", serious and serious[0]), ("2", 2, D(2024, 1, 1), 70.0, "65-74", "F", 2024, "Q1", "2024Q1", serious and serious[1])]
    base = spark.createDataFrame(rows, "caseid string, primaryid long, fda_dt date, age_years double, age_group string, sex_clean string, year int, quarter string, year_quarter string, serious boolean")
    base = base.drop("serious") if serious is None else base
    drug = spark.createDataFrame([(1, "", "X", "X", "PS")], "primaryid long, caseid string, drugname string, prod_ai string, role_cod string")
    reac = spark.createDataFrame([(1, "", "FALL")], "primaryid long, caseid string, pt string")
    outc = spark.createDataFrame([(1, "", "DE")], "primaryid long, caseid string, outc_cod string")
    return base, cases.drug_cases(cases.drug_rows(drug, base), SPEC), cases.reaction_cases(reac, base, SPEC), cases.outcome_cases(cases.outcome_tokens(outc, base), SPEC)


def test_seriousness_is_reported_or_else_by_codes(spark):
    for stated, want in ((None, [True, False]), ([None, None], [True, False]), ([None, True], [False, True]), ([False, None], [False, False])):
        parts = _star(spark, stated)
        for build in (cases.case_dataset, cases.signal_dataset):
            got = build(*parts)
            assert [r.serious for r in got.orderBy("caseid").collect()] == want and "__reported_serious" not in got.columns


def test_missing_values_are_nulls_and_unstated_seriousness_is_left_out(spark):
    rows = [("1", "", None, True), ("2", "FALL", None, False), (None, "", None, True)]
    frame = spark.createDataFrame(rows, "caseid string, fall_pt_list string, serious boolean, is_serious_any boolean")
    assert {r.variable: (r.n_missing, r.percent) for r in report.missingness(frame, report.KEY_COLUMNS).collect()} == {"caseid": (1, 33.33), "fall_pt_list": (0, 0.0), "is_serious_any": (0, 0.0)}
    assert {r.variable: r.n_missing for r in report.missingness(frame.drop("is_serious_any"), report.KEY_COLUMNS).collect()} == {"caseid": 1, "fall_pt_list": 0, "serious": 3}


def test_a_report_of_two_cases_stops_the_job(spark):
    base = spark.createDataFrame([("1", 7), ("2", 7), ("3", 8), ("4", None), ("5", None)], "caseid string, primaryid long")
    reac = spark.createDataFrame([(7, "", "FALL"), (8, "", "FALL")], "primaryid long, caseid string, pt string")
    with pytest.raises(Exception, match="report 7 belongs to the cases 1 and 2"):
        cases.reaction_cases(reac, base, SPEC).collect()
    assert cases.reaction_cases(reac, base.where("caseid > '2'"), SPEC).first().caseid == "3"


def test_features_meet_their_own_case_and_period(spark):
    signals = spark.createDataFrame([("1", 2020, "Q1", True), ("1", 2021, "q2", False), ("2", 2020, "Q1", True)], "caseid string, year int, quarter string, is_zolpidem_any boolean")
    features = spark.createDataFrame([("1", "2020Q1", False, 3), ("1", "2021Q2", True, 5), ("2", "2021Q2", True, 7)], "caseid string, year_quarter string, is_zolpidem_any boolean, drug_n long")
    got = {(r.caseid, r.year): (r.drug_n, r.is_zolpidem_any) for r in periods.with_features(signals, features).collect()}
    assert got == {("1", 2020): (3, True), ("1", 2021): (5, False), ("2", 2020): (None, True)}
    assert periods.with_features(signals, features.drop("year_quarter").where("drug_n = 7")).count() == 3
