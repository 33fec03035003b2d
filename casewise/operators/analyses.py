"""Disproportionality analyses: all strata, outcomes and definitions from one pass over the cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import feature_mask, truth
from ..plans.study import StudySpec

OUTCOMES = (("strict_fall", "is_fall_narrow"), ("broad_fall", "is_fall_broad"))
#: definition -> (suspect flag, target flag, comparator flag, group column)
DEFINITIONS = {
    "main_ps_ss": ("suspect_role_any", "is_zolpidem_suspect", "is_other_zdrug_suspect", "target_drug_group"),
    "sensitivity_ps_only": ("suspect_role_any_ps", "is_zolpidem_suspect_ps", "is_other_zdrug_suspect_ps", "target_drug_group_ps"),
}
BOTH = "both_zolpidem_and_other_zdrug"


def cells(exposed: Column, outcome: Column) -> list[Column]:
    """Counts a, b, c, d; flags must not be null."""
    return [
        F.count_if(exposed & outcome).alias("a"),
        F.count_if(exposed & ~outcome).alias("b"),
        F.count_if(~exposed & outcome).alias("c"),
        F.count_if(~exposed & ~outcome).alias("d"),
    ]


def two_by_two(cases: DataFrame, exposure: str, outcome: str) -> DataFrame:
    return cases.agg(*cells(truth(exposure), truth(outcome)))


def _keyed(cases: DataFrame, memberships: list[tuple[Column, list[Column]]], names: list[str]) -> DataFrame:
    """One row for each table a case belongs to: (names..., exposed, outcome); a small array is exploded, not the case."""
    entries = F.array(*[F.when(inside, F.struct(*[v.alias(n) for n, v in zip([*names, "e", "o"], values)])) for inside, values in memberships])
    return cases.select(F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("k")).select("k.*")


def _strata(cases: DataFrame, spec: StudySpec) -> list[tuple[str, str, Column]]:
    """Overall, and every stratum whose column the cases have."""
    found = [("overall", "all", F.lit(True))]
    return found + [(c, str(v).lower() if isinstance(v, bool) else v, feature_mask(c, v)) for c, v in spec.strata if c in cases.columns]


def signal_tables(cases: DataFrame, spec: StudySpec, strata: bool = True) -> DataFrame:
    """2x2 tables of target suspects among suspect cases without both drugs: definitions x outcomes x strata."""
    members = []
    for definition, (suspect, target, _, group) in DEFINITIONS.items():
        inside = truth(suspect) & (F.coalesce(F.col(group), F.lit("")) != BOTH)
        for outcome, flag in OUTCOMES:
            for stratum, level, mask in _strata(cases, spec) if strata else _strata(cases, spec)[:1]:
                members.append((inside & mask, [F.lit(definition), F.lit(outcome), F.lit(stratum), F.lit(level), truth(target), truth(flag)]))
    names = ["analysis", "outcome_name", "stratum", "level"]
    return _keyed(cases, members, names).groupBy(*names).agg(*cells(F.col("e"), F.col("o")))


def comparative_tables(cases: DataFrame, spec: StudySpec, strata: bool = True) -> DataFrame:
    """Target-only against comparator-only cases."""
    members = []
    for definition, (_, _, _, group) in DEFINITIONS.items():
        named = F.coalesce(F.col(group), F.lit(""))
        for outcome, flag in OUTCOMES:
            for stratum, level, mask in _strata(cases, spec) if strata else _strata(cases, spec)[:1]:
                inside = named.isin("zolpidem_only", "other_zdrug_only") & mask
                members.append((inside, [F.lit(definition), F.lit(outcome), F.lit(stratum), F.lit(level), named == "zolpidem_only", truth(flag)]))
    names = ["analysis", "outcome_name", "stratum", "level"]
    return _keyed(cases, members, names).groupBy(*names).agg(*cells(F.col("e"), F.col("o")))


def feature_tables(cases: DataFrame, spec: StudySpec) -> DataFrame:
    """Among target-exposed cases, each feature against the rest."""
    members = []
    for definition, (_, target, _, _) in DEFINITIONS.items():
        for outcome, flag in OUTCOMES:
            for column, value, domain in spec.features:
                if column in cases.columns:
                    level = str(value).lower() if isinstance(value, bool) else value
                    keys = [F.lit(definition), F.lit(outcome), F.lit(domain), F.lit(column), F.lit(level)]
                    members.append((truth(target), [*keys, feature_mask(column, value), truth(flag)]))
    names = ["analysis", "outcome_name", "domain", "feature", "level"]
    return _keyed(cases, members, names).groupBy(*names).agg(*cells(F.col("e"), F.col("o")))


def signal_qc(cases: DataFrame, exposure: str = "is_zolpidem_suspect", outcome: str = "is_fall_narrow") -> DataFrame:
    """Totals and missing values; -1 marks an absent column."""
    e, o = truth(exposure), truth(outcome)
    missing = [
        (F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")) if c in cases.columns else F.lit(-1).cast("long")).alias(f"missing_{c}")
        for c in ("age_group", "sex_clean", "serious", "polypharmacy_5")
    ]
    return cases.agg(
        F.count("*").alias("n_cases"), F.count_if(e).alias("n_exposed"), F.count_if(~e).alias("n_unexposed"),
        F.count_if(o).alias("n_outcome"), F.count_if(e & o).alias("n_both"), *missing,
    )


def group_qc(cases: DataFrame, group: str = "target_drug_group") -> DataFrame:
    return cases.groupBy(F.col(group).alias("drug_group")).agg(
        F.count("*").alias("n_cases"),
        F.count_if(truth("is_fall_narrow")).alias("n_narrow"),
        F.count_if(truth("is_fall_broad")).alias("n_broad"),
        F.round(F.avg(truth("is_fall_narrow").cast("double")), 6).alias("narrow_rate"),
        F.count_if(F.col("sex_clean") == "F").alias("n_female"),
        F.count_if(F.col("age_group").isin("75-84", ">=85")).alias("n_75_plus"),
    )


def feature_qc(cases: DataFrame, spec: StudySpec) -> DataFrame:
    exposed = truth("is_zolpidem_suspect")
    columns = [c for c in dict.fromkeys(c for c, _, d in spec.features if d not in ("demographic",)) if c in cases.columns]
    return cases.where(exposed).agg(F.count("*").alias("n_exposed"), *[F.count_if(truth(c)).alias(f"n_{c}") for c in columns])


def age_rates(cases: DataFrame, exposure: str = "is_zolpidem_suspect", outcome: str = "is_fall_narrow") -> DataFrame:
    """Cases, outcomes and rate for each of the three age groups, also those without a case."""
    groups = cases.sparkSession.sql("select * from values (0, '65-74'), (1, '75-84'), (2, '>=85') as t(age_order, age_group)")
    found = cases.where(truth(exposure)).groupBy("age_group").agg(F.count("*").alias("n"), F.count_if(truth(outcome)).alias("k"))
    joined = groups.join(found, "age_group", "left")
    n, k = F.coalesce("n", F.lit(0).cast("long")), F.coalesce("k", F.lit(0).cast("long"))
    return joined.select("age_order", "age_group", n.alias("n_cases"), k.alias("n_outcome"), F.when(n > 0, k / n).otherwise(0.0).alias("rate"))


def year_trend(cases: DataFrame) -> DataFrame:
    """Main-definition 2x2 of the narrow outcome by year."""
    suspect, target, _, group = DEFINITIONS["main_ps_ss"]
    rows = cases.where(truth(suspect) & (F.col(group) != BOTH))
    return rows.groupBy("year").agg(*cells(truth(target), truth("is_fall_narrow")))
