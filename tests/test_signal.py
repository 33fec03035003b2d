"""Disproportionality measures on golden vectors, and numeric functions on known points."""

import math

import pytest

from casewise.functions import numerics
from casewise.functions.signal import full_measures

GOLDEN = {
    (105, 526, 11875, 346797): dict(expected_a=21.039012, ror=5.829687, ror_ci_low=4.724051, ror_ci_high=7.194091, prr=5.026015, prr_ci_low=4.216881, prr_ci_high=5.990405,
                                    chi_square_yates=343.109214, ic=2.292219, ic025=2.002940, ic975=2.554811, ebgm=4.786984, eb05=4.067899, eb95=5.602973),
    (30, 278, 11950, 347045): dict(expected_a=10.269438, ror=3.133966, prr=2.926113, chi_square_yates=37.285244, ic=1.501866, ic025=0.939308, ebgm=2.706556, eb05=1.991626, eb95=3.610695),
    (244, 1982, 11736, 345341): dict(expected_a=74.220032, ror=3.622549, prr=3.335081, chi_square_yates=401.898393, ic=1.710267, ebgm=3.250466, eb05=2.922558, eb95=3.606777),
    (0, 10, 5, 985): dict(expected_a=0.05, ror=8.532468, prr=8.190083, chi_square_yates=0.0, ic=-0.137504, ic025=-10.129391, ic975=2.191300, ebgm=0.534723, eb05=0.048851, eb95=2.853078),
    (3, 7, 20, 970): dict(expected_a=0.23, ror=20.785714, prr=14.85, chi_square_yates=23.162963, ic=2.261387, ic025=0.210943, ic975=3.455182, ebgm=2.855090, eb05=1.110828, eb95=6.303786),
}


def test_golden_vectors(spark):
    rows = full_measures(spark.createDataFrame(list(GOLDEN), "a long, b long, c long, d long")).collect()
    for r in rows:
        for name, value in GOLDEN[(r.a, r.b, r.c, r.d)].items():
            assert r[name] == pytest.approx(value, abs=2e-6), (r.a, name)
    flags = {r.a: (r.signal_flag_mhra, r.signal_flag_ror, r.signal_flag_ic, r.signal_flag_ebgm) for r in rows}
    assert flags == {105: (True,) * 4, 30: (True, True, True, False), 244: (True,) * 4, 0: (False,) * 4, 3: (True, True, True, False)}


def test_empty_table_has_defined_values(spark):
    r = full_measures(spark.createDataFrame([(0, 0, 0, 0)], "a long, b long, c long, d long")).first()
    assert r.ror is None and r.prr is None and r.chi_square_yates == 0 and r.ic == 0 and r.conclusion == "no_clear_signal"


def test_known_quantiles():
    assert numerics.gamma_ppf(0.975, 0.5, 0.5) == pytest.approx(5.023886, abs=1e-6)
    assert numerics.gamma_ppf(0.95, 1.0, 0.5) == pytest.approx(5.991465, abs=1e-6)
    assert numerics.gamma_ppf(0.5, 1.0) == pytest.approx(math.log(2), abs=1e-9)
    assert numerics.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-7)
    assert numerics.student_sf(2.228139, 10) == pytest.approx(0.025, abs=1e-6)


def test_an_empty_table_has_no_ratios_and_no_signal(spark):
    r = full_measures(spark.createDataFrame([(0, 0, 0, 0)], "a long, b long, c long, d long")).first()
    assert (r.n, r.ror, r.ror_ci_low, r.prr, r.prr_ci_high, r.reporting_rate_exposed, r.reporting_rate_unexposed) == (0, None, None, None, None, None, None)
    assert (r.chi_square_yates, r.expected_a, r.ic) == (0.0, 0.0, 0.0) and r.conclusion == "no_clear_signal"
    assert not any((r.signal_flag_mhra, r.signal_flag_ror, r.signal_flag_ic, r.signal_flag_ebgm)) and r.ic025 < 0 < r.ic975
