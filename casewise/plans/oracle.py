"""DuckDB SQL for the catalogue, written independently of the operators."""

from __future__ import annotations

from .study import ORDER_TABLES as S


def _has(terms) -> str:
    pattern = "(^|[^A-Z0-9])(?:" + "|".join(terms) + ")($|[^A-Z0-9])"
    return f"(regexp_matches(drugname, '{pattern}') or regexp_matches(prod_ai, '{pattern}'))"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_SUS, _PRI = f"role_cod in {_in(S.suspect_roles)}", f"role_cod in {_in(S.primary_roles)}"
_TAR, _COM = _has(S.target_terms), _has(S.comparator_terms)
CLASSES = list(S.feature_terms)
SUSPECT = ["suspect_role_any", "suspect_role_any_ps", "is_zolpidem_suspect", "is_zolpidem_suspect_ps", "is_other_zdrug_suspect", "is_other_zdrug_suspect_ps"]
OUTC = list(S.outcome_codes.values())


def _group(suffix: str) -> str:
    return (
        f"case when is_zolpidem_suspect{suffix} and is_other_zdrug_suspect{suffix} then 'both_zolpidem_and_other_zdrug' "
        f"when is_zolpidem_suspect{suffix} then 'zolpidem_only' when is_other_zdrug_suspect{suffix} then 'other_zdrug_only' "
        f"when suspect_role_any{suffix} then 'no_target_zdrug_suspect' else 'no_suspect_drug' end"
    )


DEMO = """
demo as (
  select cast(o_custkey as varchar) as caseid, o_orderkey as primaryid, cast(o_orderdate as date) as fda_dt,
         cast(substr(o_orderpriority, 1, 1) as bigint) as caseversion,
         case when c_nationkey % 5 = 0 then cast(60 + c_custkey % 40 as double) * 12 / 12 else cast(60 + c_custkey % 40 as double) end as age_years,
         case when c_mktsegment in ('HOUSEHOLD', 'FURNITURE') then 'F' when c_mktsegment in ('BUILDING', 'MACHINERY') then 'M' else 'UNK' end as sex_clean,
         cast(year(o_orderdate) as integer) as year, 'Q' || quarter(o_orderdate) as quarter
  from orders join customer on o_custkey = c_custkey
), deleted as (select cast(c_custkey as varchar) as caseid from customer where c_acctbal < 0)
"""

_SHAPE = """caseid, primaryid, fda_dt, age_years,
  case when age_years < 75 then '65-74' when age_years < 85 then '75-84' else '>=85' end as age_group,
  sex_clean, year, quarter, cast(year as varchar) || quarter as year_quarter"""

CASE_BASE = (
    DEMO
    + """, latest as (
  select * from demo d where not exists (select 1 from deleted x where x.caseid = d.caseid)
  qualify row_number() over (partition by caseid order by fda_dt desc nulls first, caseversion desc nulls first, primaryid desc nulls first) = 1
), case_base as (select """
    + _SHAPE
    + """ from latest where age_years between 65 and 120 and sex_clean in ('F', 'M'))
"""
)

QUARTERLY_BASE = (
    DEMO
    + """, latest as (
  select * from demo d where not exists (select 1 from deleted x where x.caseid = d.caseid)
  qualify row_number() over (partition by year, quarter, caseid order by fda_dt desc nulls first, caseversion desc nulls first, primaryid desc nulls first) = 1
), case_base as (select """
    + _SHAPE
    + """ from latest where age_years between 65 and 120 and sex_clean in ('F', 'M'))
"""
)


def _children(key: str) -> str:
    """Child relations grouped by ``key`` (case, or case and period)."""
    flags = ", ".join(f"bool_or({_has(S.feature_terms[c])}) as {c}" for c in CLASSES)
    codes = ", ".join(f"bool_or(code = '{c}') as {f}" for c, f in S.outcome_codes.items())
    return f"""
, items as (
  select l_orderkey, upper(p_name) as drugname, upper(p_brand) as prod_ai, upper(p_type) as pt,
         case l_returnflag when 'R' then 'PS' when 'A' then 'SS' else 'C' end as role_cod
  from lineitem join part on l_partkey = p_partkey
), drug as (select {key}, primaryid, drugname, prod_ai, role_cod, pt from items join case_base on l_orderkey = primaryid)
, drug_raw as (
  select {key}, {flags}, count(*) as drug_n, count(distinct coalesce(nullif(prod_ai, ''), drugname)) as distinct_drug_n,
    bool_or({_SUS}) as suspect_role_any, bool_or({_PRI}) as suspect_role_any_ps,
    bool_or({_TAR} and {_SUS}) as is_zolpidem_suspect, bool_or({_TAR} and {_PRI}) as is_zolpidem_suspect_ps,
    bool_or({_COM} and {_SUS}) as is_other_zdrug_suspect, bool_or({_COM} and {_PRI}) as is_other_zdrug_suspect_ps
  from drug group by {key}
), drug_cases as (
  select *, is_zolpidem as is_zolpidem_any, distinct_drug_n >= 5 as polypharmacy_5, distinct_drug_n >= 5 as polypharmacy,
    {_group('')} as target_drug_group, {_group('_ps')} as target_drug_group_ps from drug_raw
), reac_case as (
  select {key}, bool_or(pt in {_in(S.narrow_terms)}) as is_fall_narrow, count(*) filter (pt in {_in(S.narrow_terms)}) as fall_narrow_pt_count,
    count(*) as all_reac_n, bool_or(pt in {_in(S.broad_terms)}) as is_fall_broad,
    coalesce(string_agg(distinct pt, '|' order by pt) filter (pt in {_in(S.broad_terms)}), '') as fall_pt_list
  from drug group by {key}
), outc as (
  select {key}, unnest(regexp_extract_all(case substr(o_orderpriority, 1, 1) when '1' then 'DE,HO' when '2' then 'LT' when '3' then 'OT/XX'
    when '4' then '' else 'HO;OT' end, '[A-Z]{{2}}')) as code
  from orders join case_base on o_orderkey = primaryid
), outc_case as (select {key}, {codes}, true as is_serious_any from outc where code in {_in(S.outcome_codes)} group by {key})
"""


def _star(key: str) -> str:
    using = f"using ({key})"
    bools = ", ".join(f"coalesce({c}, false) as {c}" for c in [*CLASSES, "is_zolpidem_any", "polypharmacy_5", "polypharmacy", *SUSPECT])
    outs = ", ".join(f"coalesce({c}, false) as {c}" for c in [*OUTC, "is_serious_any"])
    return f"""
, case_dataset as (
  select case_base.*, coalesce(drug_n, 0) as drug_n, coalesce(distinct_drug_n, 0) as distinct_drug_n, {bools},
    coalesce(target_drug_group, 'no_suspect_drug') as target_drug_group, coalesce(target_drug_group_ps, 'no_suspect_drug') as target_drug_group_ps,
    coalesce(is_fall_narrow, false) as is_fall_narrow, coalesce(fall_narrow_pt_count, 0) as fall_narrow_pt_count,
    coalesce(all_reac_n, 0) as all_reac_n, coalesce(is_fall_broad, false) as is_fall_broad, coalesce(fall_pt_list, '') as fall_pt_list,
    {outs}, coalesce(is_serious_any, false) as serious
  from case_base left join drug_cases {using} left join reac_case {using} left join outc_case {using}
)
"""


CASES = "with " + CASE_BASE + _children("caseid") + _star("caseid")
PERIODS = "with " + QUARTERLY_BASE + _children("caseid, year_quarter") + _star("caseid, year_quarter")

_INDEX = """
, global_index as (
  select caseid, primaryid, fda_dt, year, quarter, year_quarter from case_base where year between 1990 and 2025
  qualify row_number() over (partition by caseid order by fda_dt desc nulls last, primaryid desc nulls last, year desc, quarter desc) = 1
)
"""

SIGNAL = [
    "caseid", "is_fall_narrow", "is_zolpidem_any", *SUSPECT[2:], *SUSPECT[:2], "target_drug_group", "target_drug_group_ps", "age_group", "sex_clean",
    "year", "quarter", "serious", "is_fall_broad", "fall_narrow_pt_count", "fall_pt_list",
]
FEATURE = ["caseid", *CLASSES, "drug_n", "distinct_drug_n", "is_zolpidem_any", "polypharmacy_5", "polypharmacy"]

_DEFS = {
    "main_ps_ss": ("suspect_role_any", "is_zolpidem_suspect", "target_drug_group"),
    "sensitivity_ps_only": ("suspect_role_any_ps", "is_zolpidem_suspect_ps", "target_drug_group_ps"),
}
_OUT = {"strict_fall": "is_fall_narrow", "broad_fall": "is_fall_broad"}


def _cells(e: str, o: str) -> str:
    return (
        f"count(*) filter ({e} and {o}) as a, count(*) filter ({e} and not {o}) as b, "
        f"count(*) filter (not {e} and {o}) as c, count(*) filter (not {e} and not {o}) as d"
    )


def _mask(column: str, value) -> str:
    return column if value is True else f"{column} = '{value}'"


def _level(value) -> str:
    return "true" if value is True else value


def signal_cells(strata: bool, skip=()) -> str:
    parts = []
    for d, (sus, tar, group) in _DEFS.items():
        for name, flag in _OUT.items():
            for column, value in [("overall", "all")] + (list(S.strata) if strata else []):
                if column in skip:
                    continue
                mask = "true" if column == "overall" else _mask(column, value)
                parts.append(
                    f"select '{d}' as analysis, '{name}' as outcome_name, '{column}' as stratum, '{_level(value)}' as level, {_cells(tar, flag)} "
                    f"from case_dataset where {sus} and {group} <> 'both_zolpidem_and_other_zdrug' and {mask} having count(*) > 0"
                )
    return " union all ".join(parts)


def comparative_cells() -> str:
    parts = []
    for d, (_, _, group) in _DEFS.items():
        for name, flag in _OUT.items():
            for column, value in [("overall", "all"), *[s for s in S.strata if s[0] != "polypharmacy_5"]]:
                mask = "true" if column == "overall" else _mask(column, value)
                exposed = f"({group} = 'zolpidem_only')"
                parts.append(
                    f"select '{d}' as analysis, '{name}' as outcome_name, '{column}' as stratum, '{_level(value)}' as level, {_cells(exposed, flag)} "
                    f"from case_dataset where {group} in ('zolpidem_only', 'other_zdrug_only') and {mask} having count(*) > 0"
                )
    return " union all ".join(parts)


def feature_cells() -> str:
    parts = []
    for d, (_, tar, _) in _DEFS.items():
        for name, flag in _OUT.items():
            for column, value, domain in S.features:
                parts.append(
                    f"select '{d}' as analysis, '{name}' as outcome_name, '{domain}' as domain, '{column}' as feature, '{_level(value)}' as level, "
                    f"{_cells('(' + _mask(column, value) + ')', flag)} from case_dataset where {tar} having count(*) > 0"
                )
    return " union all ".join(parts)


_X = "(x + 8.0)"
_DIGAMMA = (
    f"(ln{_X} - 1.0 / (2.0 * {_X}) - 1.0 / (12.0 * {_X} ** 2) + 1.0 / (120.0 * {_X} ** 4) - 1.0 / (252.0 * {_X} ** 6) + 1.0 / (240.0 * {_X} ** 8)"
    + "".join(f" - 1.0 / (x + {k}.0)" for k in range(8))
    + ")"
).replace("x +", "(fa + 1.0) +")


def measures(cells: str, keys: list[str], columns: list[str]) -> str:
    """Point measures of a cells query, rounded."""
    own = ", ".join(keys)
    return f"""
, cells as ({cells})
, f as (select *, cast(a as double) as fa, cast(b as double) as fb, cast(c as double) as fc, cast(d as double) as fd,
          cast(a + b + c + d as double) as fn, case when a = 0 or b = 0 or c = 0 or d = 0 then 0.5 else 0.0 end as s from cells)
, g as (select *, fa + s as a1, fb + s as b1, fc + s as c1, fd + s as d1,
          case when fn > 0 then (fa + fb) * (fa + fc) / fn else 0.0 end as expected_a,
          (fa + fb) * (fc + fd) * (fa + fc) * (fb + fd) as margins from f)
, h as (select *, (a1 * d1) / (b1 * c1) as ror, (a1 / (a1 + b1)) / (c1 / (c1 + d1)) as prr,
          sqrt(1 / a1 + 1 / b1 + 1 / c1 + 1 / d1) as rse, sqrt(1 / a1 - 1 / (a1 + b1) + 1 / c1 - 1 / (c1 + d1)) as pse from g)
, m as (select {own}, a, b, c, d, a + b + c + d as n,
  case when a + b > 0 then fa / (fa + fb) end as reporting_rate_exposed, case when c + d > 0 then fc / (fc + fd) end as reporting_rate_unexposed,
  ror, exp(ln(ror) - 1.96 * rse) as ror_ci_low, exp(ln(ror) + 1.96 * rse) as ror_ci_high,
  prr, exp(ln(prr) - 1.96 * pse) as prr_ci_low, exp(ln(prr) + 1.96 * pse) as prr_ci_high,
  case when margins > 0 then fn * greatest(abs(fa * fd - fb * fc) - fn / 2, 0) ** 2 / margins else 0 end as chi_square_yates,
  expected_a, log2((fa + 0.5) / (expected_a + 0.5)) as ic, exp({_DIGAMMA}) / (expected_a + 1.0) as ebgm from h)
select {", ".join(columns if not columns else [_show(c) for c in columns])} from m
"""


def _show(column: str) -> str:
    exact = {"analysis", "outcome_name", "stratum", "level", "domain", "feature", "year", "a", "b", "c", "d", "n"}
    return column if column in exact else f"round({column}, 6) as {column}"


def flags(cells: str, keys: list[str]) -> str:
    """Signal flags and conclusion of a cells query; credibility limits are compared through the gamma distribution function (its series)."""

    def gamma_cdf(shape: str, x: str) -> str:
        return f"list_sum(list_transform(range(0, 20000), lambda k: exp(({shape} + k) * ln({x}) - {x} - lgamma({shape} + k + 1))))"

    ready = measures(cells, keys, keys).rpartition("select ")[0]
    return ready + f"""select {", ".join(keys)}, signal_flag_mhra, signal_flag_ror, signal_flag_ic, signal_flag_ebgm,
  case when signal_flag_mhra or signal_flag_ror or signal_flag_ic or signal_flag_ebgm then 'signal_detected' else 'no_clear_signal' end as conclusion
from (select *, coalesce(a >= 3 and prr >= 2 and chi_square_yates >= 4, false) as signal_flag_mhra, coalesce(ror_ci_low > 1, false) as signal_flag_ror,
  coalesce({gamma_cdf("(a + 0.5)", "(expected_a + 0.5)")} < 0.025, false) as signal_flag_ic,
  coalesce(a >= 3 and {gamma_cdf("(a + 1.0)", "(2 * (expected_a + 1.0))")} <= 0.05, false) as signal_flag_ebgm from m)"""
