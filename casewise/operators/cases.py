"""Case-level relations: drugs, reactions, outcomes, and the two star joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mentions, normal, strip, truth
from ..plans.study import StudySpec
from .cohort import with_case_id

CLASSES = (
    "is_zolpidem", "is_zaleplon", "is_zopiclone", "is_eszopiclone", "is_benzo", "is_antidepressant", "is_antipsychotic", "is_opioid", "is_antiepileptic",
)
SUSPECT = (
    "suspect_role_any", "suspect_role_any_ps", "is_zolpidem_suspect", "is_zolpidem_suspect_ps", "is_other_zdrug_suspect", "is_other_zdrug_suspect_ps",
)
GROUPS = ("target_drug_group", "target_drug_group_ps")
COUNTS = ("drug_n", "distinct_drug_n")
BURDEN = ("is_zolpidem_any", "polypharmacy_5", "polypharmacy")
#: The reports' own seriousness, while relations are joined.
REPORTED = "__reported_serious"


def drug_rows(drug: DataFrame, base: DataFrame) -> DataFrame:
    """Normalised drug rows of retained reports that name a drug."""
    rows = drug.withColumns({c: normal(F.col(c)) for c in ("drugname", "prod_ai")}).withColumn("role_cod", F.upper(strip(F.col("role_cod"))))
    return with_case_id(rows.where("drugname != '' or prod_ai != ''"), base)


def target_group(suspect: str, target: str, comparator: str) -> Column:
    """Exclusive group by priority: both, target, comparator, another suspect drug, none."""
    return (
        F.when(F.col(target) & F.col(comparator), "both_zolpidem_and_other_zdrug")
        .when(F.col(target), "zolpidem_only")
        .when(F.col(comparator), "other_zdrug_only")
        .when(F.col(suspect), "no_target_zdrug_suspect")
        .otherwise("no_suspect_drug")
    )


def drug_cases(rows: DataFrame, spec: StudySpec) -> DataFrame:
    """Features and exposure of each case in one aggregation over its drug rows."""
    name, ingredient, role = F.col("drugname"), F.col("prod_ai"), F.col("role_cod")
    suspect, primary = role.isin(*spec.suspect_roles), role.isin(*spec.primary_roles)
    target, other = mentions(name, ingredient, spec.target_terms), mentions(name, ingredient, spec.comparator_terms)
    flags = {c: mentions(name, ingredient, spec.feature_terms[c]) for c in CLASSES}
    flags |= {
        "suspect_role_any": suspect, "suspect_role_any_ps": primary,
        "is_zolpidem_suspect": target & suspect, "is_zolpidem_suspect_ps": target & primary,
        "is_other_zdrug_suspect": other & suspect, "is_other_zdrug_suspect_ps": other & primary,
    }
    resolved = F.coalesce(F.nullif(ingredient, F.lit("")), name)
    # flags are one bit mask a row, so the terms are searched once and the aggregate carries one number
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(flags.values())])
    cases = rows.select("caseid", resolved.alias("drug"), mask.alias("mask")).groupBy("caseid").agg(
        F.count("*").alias("drug_n"), F.count_distinct("drug").alias("distinct_drug_n"), F.bit_or("mask").alias("mask")
    )
    many = F.col("distinct_drug_n") >= spec.polypharmacy_from
    cases = cases.select("*", *[(F.col("mask").bitwiseAND(1 << i) != 0).alias(c) for i, c in enumerate(flags)])
    return cases.select(
        "caseid", *CLASSES, *COUNTS, F.col("is_zolpidem").alias("is_zolpidem_any"), many.alias("polypharmacy_5"), many.alias("polypharmacy"),
        *SUSPECT, target_group(*SUSPECT[0:6:2]).alias("target_drug_group"), target_group(*SUSPECT[1:6:2]).alias("target_drug_group_ps"),
    )


def drug_feature(cases: DataFrame) -> DataFrame:
    return cases.select("caseid", *CLASSES, *COUNTS, *BURDEN)


def drug_exposure(cases: DataFrame) -> DataFrame:
    return cases.select("caseid", *SUSPECT, *GROUPS)


def reaction_cases(reac: DataFrame, base: DataFrame, spec: StudySpec) -> DataFrame:
    """Outcome flags and terms of each case. Blank terms count as reactions."""
    rows = with_case_id(reac.select("primaryid", "caseid", normal(F.col("pt")).alias("pt")), base)
    narrow, broad = F.col("pt").isin(*spec.narrow_terms), F.col("pt").isin(*spec.broad_terms)
    return rows.groupBy("caseid").agg(
        F.bool_or(narrow).alias("is_fall_narrow"),
        F.count_if(narrow).alias("fall_narrow_pt_count"),
        F.count("*").alias("all_reac_n"),
        F.bool_or(broad).alias("is_fall_broad"),
        F.array_join(F.array_sort(F.collect_set(F.when(broad, F.col("pt")))), "|").alias("fall_pt_list"),
    )


def outcome_tokens(outc: DataFrame, base: DataFrame) -> DataFrame:
    """(caseid, code): every pair of letters in the outcome text, known or not."""
    rows = with_case_id(outc, base)
    return rows.select("caseid", F.explode(F.regexp_extract_all(F.upper(strip(F.col("outc_cod"))), F.lit("[A-Z]{2}"), F.lit(0))).alias("code"))


def outcome_cases(tokens: DataFrame, spec: StudySpec) -> DataFrame:
    known = tokens.where(F.col("code").isin(*spec.outcome_codes))
    flags = [F.bool_or(F.col("code") == code).alias(flag) for code, flag in spec.outcome_codes.items()]
    return known.groupBy("caseid").agg(*flags, F.lit(True).alias("is_serious_any"))


def unknown_codes(tokens: DataFrame, spec: StudySpec, top: int = 20) -> DataFrame:
    rows = tokens.where(~F.col("code").isin(*spec.outcome_codes)).groupBy("code").agg(F.count("*").alias("n_rows"))
    return rows.orderBy(F.desc("n_rows"), "code").limit(top)


def _filled(joined: DataFrame) -> DataFrame:
    """Post-join defaults: flags false, counts 0, lists empty, groups without a suspect drug."""
    fills = {}
    for name, kind in joined.dtypes:
        if name == REPORTED:
            continue
        if kind == "boolean":
            fills[name] = F.coalesce(F.col(name), F.lit(False))
        elif name in GROUPS:
            fills[name] = F.coalesce(F.col(name), F.lit("no_suspect_drug"))
        elif name in (*COUNTS, "fall_narrow_pt_count", "all_reac_n"):
            fills[name] = F.coalesce(F.col(name), F.lit(0).cast("long"))
        elif name == "fall_pt_list":
            fills[name] = F.coalesce(F.col(name), F.lit(""))
        elif name in ("age_group", "sex_clean"):
            fills[name] = F.coalesce(F.col(name), F.lit("unknown"))
    return joined.withColumns(fills)


def case_dataset(base: DataFrame, drugs: DataFrame, reactions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row a case with all features; the child relations are unique on caseid by construction."""
    stated = "serious" in base.columns
    joined = (base.withColumnRenamed("serious", REPORTED) if stated else base).join(drugs.select("caseid", *CLASSES, *COUNTS, *BURDEN, *SUSPECT, *GROUPS), "caseid", "left")
    joined = joined.join(reactions, "caseid", "left").join(outcomes, "caseid", "left")
    return _with_serious(_filled(joined), stated)


SIGNAL_COLUMNS = (
    "caseid", "is_fall_narrow", "is_zolpidem_any", *SUSPECT[2:], *SUSPECT[:2], *GROUPS, "age_group", "sex_clean", "year", "quarter",
    "serious", "is_fall_broad", "fall_narrow_pt_count", "fall_pt_list",
)


def _with_serious(cases: DataFrame, stated: bool) -> DataFrame:
    """Seriousness as reported (``REPORTED``), by outcome codes where no report of the relation states it."""
    if not stated:
        return cases.withColumn("serious", F.col("is_serious_any"))
    any_stated = cases.agg((F.count(REPORTED) > 0).alias("__stated"))
    both = cases.crossJoin(F.broadcast(any_stated))  # with one row
    return both.withColumn("serious", F.when(F.col("__stated"), truth(REPORTED)).otherwise(F.col("is_serious_any"))).drop("__stated", REPORTED)


def signal_dataset(base: DataFrame, drugs: DataFrame, reactions: DataFrame, outcomes: DataFrame) -> DataFrame:
    stated = "serious" in base.columns
    joined = base.select("caseid", "age_group", "sex_clean", "year", "quarter", *([F.col("serious").alias(REPORTED)] if stated else []))
    joined = joined.join(drugs.select("caseid", "is_zolpidem_any", *SUSPECT, *GROUPS), "caseid", "left")
    joined = joined.join(reactions.drop("all_reac_n"), "caseid", "left")
    joined = joined.join(outcomes.select("caseid", "is_serious_any"), "caseid", "left")
    return _with_serious(_filled(joined), stated).select(*SIGNAL_COLUMNS)


def repeated_keys(relation: DataFrame, keys: tuple[str, ...] = ("caseid",), show: int = 10) -> DataFrame:
    """Quality check: keys that occur more than once, the first few."""
    return relation.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1").orderBy(*keys).limit(show)


def term_profile(reac: DataFrame, base: DataFrame, exposure: DataFrame, primary_only: bool = False, top: int = 50) -> DataFrame:
    """Ranked preferred terms of target cases with row and case shares; blank terms are left out."""
    flag = "is_zolpidem_suspect_ps" if primary_only else "is_zolpidem_suspect"
    rows = with_case_id(reac.select("primaryid", "caseid", normal(F.col("pt")).alias("pt")), base).where("pt != ''")
    rows = rows.join(exposure.where(flag).select("caseid"), "caseid", "left_semi")
    # a row a case and term first; the totals are the last grouping set over the same rows, so rows are read once
    pairs = rows.groupBy("caseid", "pt").agg(F.count("*").alias("n"))
    sets = pairs.groupingSets([["pt"], []], "pt").agg(
        F.grouping("pt").alias("whole"), F.sum("n").alias("n_rows"), F.count_distinct("caseid").alias("n_cases")
    )
    ranked = sets.orderBy(F.desc("whole"), F.desc("n_cases"), F.desc("n_rows"), "pt").limit(top + 1)
    every = Window.partitionBy(F.lit(0))  # over at most top + 1 rows
    place = F.row_number().over(Window.orderBy(F.desc("whole"), F.desc("n_cases"), F.desc("n_rows"), "pt"))

    def share(name: str) -> Column:
        return F.round(100.0 * F.col(name) / F.greatest(F.max(F.when(F.col("whole") == 1, F.col(name))).over(every), F.lit(1)), 6)

    placed = ranked.select("whole", (place - 1).cast("long").alias("rank"), "pt", "n_rows", "n_cases", share("n_rows").alias("row_percent"), share("n_cases").alias("case_percent"))
    return placed.where("whole = 0").drop("whole")
