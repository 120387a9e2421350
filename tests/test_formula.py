import datetime
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import formats, formula, numbering, special


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(3.7, 2.0, "abc", 5), (-1.25, 4.0, "12", 2), (0.0, 0.0, None, 0)], "x double, y double, s string, k int").cache()


def values(df, text):
    return [r[0] for r in df.select(formula.compile_text(text)).collect()]


def test_every_opcode_is_covered():
    found = formula.coverage()
    assert len(found) == 286
    assert [k for k, v in found.items() if v == "missing"] == []
    assert {formula.OPCODES[k] for k, v in found.items() if v == "inert"} == formula.INERT
    import importlib

    for v in found.values():
        if v.startswith("operators."):
            module, name = v.rsplit(".", 1)
            assert hasattr(importlib.import_module(f"tabulon.{module}"), name), v


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("=IF([x] > 2; [x] * 2; 0)", [7.4, 0, 0]),
        ("=[x] + [y] * 2 ^ 2", [11.7, 14.75, 0]),
        ("=-[k]%", [-0.05, -0.02, 0]),
        ("=[k] / [y]", [2.5, 0.5, None]),
        ("=MOD([k]; [y])", [1, 2, None]),
        ('=MID([s]; 1; 2) & "z"', ["abz", "12z", None]),
        ("=GCD([k]; 10)", [5, 2, 10]),
        ("=LCM([k]; 10)", [10, 10, 0]),
        ("=CHOOSE([k] + 1; 1; 2; 3; 4; 5; 6)", [6, 3, 1]),
        ("=[x] > 1 and [y] < 3", [True, False, False]),
        ("=ROUNDUP([x]; 0)", [4, -2, 0]),
        ('=VALUE([s])', [None, 12, None]),
        ("=ODD([x])", [5, -3, 1]),
    ],
)
def test_values(rows, text, wanted):
    found = values(rows, text)
    assert [None if v is None else round(v, 9) if isinstance(v, float) else v for v in found] == wanted


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("NORMSDIST(1.96)", 0.9750021), ("NORMINV(0.975; 10; 2)", 13.919928), ("TDIST(2; 10; 2)", 0.0733880), ("TINV(0.05; 10)", 2.2281389), ("CHIDIST(3.84; 1)", 0.0500435), ("CHIINV(0.05; 3)", 7.8147279), ("FDIST(4; 2; 10)", 0.0529221), ("FINV(0.05; 2; 10)", 4.1028210),
        ("GAMMADIST(3; 2; 1.5; 1)", 0.5939942), ("GAMMAINV(0.5; 2; 1)", 1.6783470), ("BETADIST(0.4; 2; 3)", 0.5248), ("BETAINV(0.5; 2; 3)", 0.3857276), ("BINOMDIST(2; 10; 0.3; 1)", 0.3827828), ("POISSON(2; 3; 1)", 0.4231901), ("HYPGEOMDIST(1; 4; 8; 20)", 0.3632611), ("NEGBINOMDIST(3; 2; 0.4)", 0.13824),
        ("CRITBINOM(10; 0.5; 0.9)", 7), ("COMBIN(5; 2)", 10), ("PERMUT(5; 2)", 20), ("COMBINA(4; 3)", 20), ("GAMMALN(5)", 3.1780538), ("LOGNORMDIST(4; 3.5; 1.2)", 0.03908356), ("WEIBULL(1; 2; 3; 1)", 0.1051607), ("CONFIDENCE(0.05; 2.5; 50)", 0.6929519),
        ("PMT(0.05; 10; 1000)", -129.5045750), ("PV(0.05; 10; -100)", 772.1734929), ("FV(0.05; 10; -100)", 1257.7892536), ("NPER(0.05; -100; 772.1734929)", 10), ("RATE(10; -129.5045750; 1000)", 0.05), ("IPMT(0.05; 2; 10; 1000)", -46.0247713), ("PPMT(0.05; 2; 10; 1000)", -83.4798037),
        ("CUMIPMT(0.05; 10; 1000; 1; 3)", -137.8755523), ("DDB(1000; 100; 5; 2)", 240), ("DB(1000; 100; 5; 1)", 369), ("VDB(1000; 100; 5; 0; 1)", 400), ("SYD(1000; 100; 5; 1)", 300), ("SLN(1000; 100; 5)", 180), ("EFFECTIVE(0.12; 12)", 0.1268250), ("NOMINAL(0.1268250; 12)", 0.12),
    ],
)
def test_published_values(rows, text, wanted):
    assert values(rows, text)[0] == pytest.approx(wanted, rel=1e-6)


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 2.0, -100.0), (2, 4.0, 60.0), (3, 5.0, 60.0), (4, 9.0, 5.0)], "t int, x double, cash double")
    build = lambda n, *a: formula.FUNCTIONS[n].build(*a)
    x, cash, t = F.col("x"), F.col("cash"), F.col("t")
    r = df.agg(build("irr", cash, t).alias("irr"), build("mirr", cash, t, 0.1, 0.12).alias("mirr"), build("harmean", x).alias("h"), build("dsum", x, t > 2).alias("d"), build("subtotal", 9, x).alias("s"), build("linest", x, t).alias("l"), build("skew", x).alias("skew")).first()
    assert sum(c / (1 + r.irr) ** k for k, c in enumerate([-100, 60, 60, 5])) == pytest.approx(0, abs=1e-6)
    assert r.mirr == pytest.approx(((60 * 1.12**2 + 60 * 1.12 + 5) / 100) ** (1 / 3) - 1)
    assert (r.d, r.s, r.l.slope) == (14, 20, pytest.approx(2.2))
    assert r.skew == pytest.approx(0.940661, rel=1e-5)


def test_serial_dates(spark):
    serials = [-0.5, 0.0, 0.3, 0.7, 1.0, 2.0, 43000.59, 43000.61, 1e9]
    df = spark.createDataFrame([(s,) for s in serials], "v double").select(numbering.serial_to_date(F.col("v"), True).alias("strict"), numbering.serial_to_date(F.col("v")).alias("plain"))
    rows = df.collect()
    assert [str(r.strict) for r in rows] == ["1899-12-29", "1899-12-30", "1899-12-31", "1900-01-01", "1900-01-01", "1900-01-01", "2017-09-22", "2017-09-23", "None"]
    assert rows[4].plain == datetime.date(1899, 12, 31)


def test_names_and_numbers(spark):
    df = spark.createDataFrame([(0, 0), (25, 9), (26, 10), (701, 99), (702, 0), (18277, 5)], "c int, r int")
    made = df.select(numbering.a1_name(F.col("c"), F.col("r"), True).alias("n"), "c", "r")
    rows = made.select("*", numbering.a1_position(F.col("n")).alias("p")).collect()
    assert [r.n for r in rows] == ["$A1", "$Z10", "$AA11", "$ZZ100", "$AAA1", "$ZZZ6"]
    assert all((r.p.col, r.p.row) == (r.c, r.r) for r in rows)
    one = spark.range(1).select(numbering.split_first(F.lit("a|b|c"), "|").alias("s"), numbering.colour_text(F.lit(255)).alias("c"), numbering.packed_datetime(F.lit(20150929), F.lit(17231800)).alias("d"), numbering.simplified(F.lit("aéèb")).alias("e"), numbering.alphabetic(F.lit(28)).alias("a")).first()
    assert (one.s.head, one.s.tail, one.c, one.d, one.e, one.a) == ("a", "b|c", "#0000ff", "2015-09-29T17:23:18.00", "a@b", "AB")


def test_formats(spark):
    assert formats.date_code_pattern("YYYY-MM-DD HH:MM:SS") == "yyyy-MM-dd HH:mm:ss"
    assert formats.date_code_pattern("0.00") is None
    assert formats.strftime_pattern("%Y/%m/%d at %H:%M") == "yyyy/MM/dd' at 'HH:mm"
    assert formats.token_pattern([(17, ""), (-1, ". of "), (9, ""), (43, "")]) == "dd'. of 'MMMMyyyy"
    assert formats.token_pattern([(999, "")]) is None
    row = spark.range(1).select(formats.formatted(F.lit(1234.5), "#,##0.00").alias("a"), formats.formatted(F.lit(-0.256), "0.0%").alias("b"), formats.formatted(F.lit(-3.0), "0;(0)").alias("c"), formats.formatted(F.lit(7.0), "000").alias("d"), formats.conditional(F.lit(150.0), [(">", 100, '"big" 0')], "0.0").alias("e")).first()
    assert tuple(row) == ("1,234.50", "-25.6%", "(3)", "007", "big 150")


def test_tokens_and_polish_order(spark):
    given = [{"type": "number", "value": 2}, {"type": "number", "value": 3}, {"type": "operator", "name": "+"}, {"type": "number", "value": 4}, {"type": "function", "name": "Max2", "arity": 2}]
    assert formula.render(formula.infix(given)) == "Max2((2+3);4)"
    assert formula.render(formula.tokens('=IF([a]>=1.5;"x""y";-2)')) == 'IF([a]>=1.5;"x""y";-2)'
    for bad in ("=1 +", "=IF(1; 2", "=1 2", "=NOSUCH(1)", "=VLOOKUP(1; 2)"):
        with pytest.raises(ValueError, match="."):
            formula.compile_text(bad)


def test_easter_and_days360(spark):
    import pandas as pd

    assert special.easter([2024, 2025, None]) == [datetime.date(2024, 3, 31), datetime.date(2025, 4, 20), None]
    d = pd.Series(pd.to_datetime(["2023-01-31"]))
    assert special.days_360(d, pd.Series(pd.to_datetime(["2023-03-31"])), pd.Series([False])).tolist() == [60]


def test_convert_and_trim(spark):
    row = spark.range(1).select(formula.convert(F.lit(100.0), "C", "F").alias("f"), formula.convert(F.lit(1.0), "mi", "km").alias("k"), formula.convert(F.lit(1.0), "m", "kg").alias("n")).first()
    assert row.f == pytest.approx(212) and row.k == pytest.approx(1.609344) and row.n is None


@pytest.mark.parametrize("a", [1e2, 999.0, 1001.0, 1e4, 1e5, 1e6, 1e7, 1e8])
def test_gamma_of_large_arguments(a):
    # The median of a gamma distribution lies a third below a, so just over half lies below a.
    assert special.gamma_p(a, a) == pytest.approx(0.5 + 1 / (3 * math.sqrt(2 * math.pi * a)), abs=1e-3 / a**1.0)
    assert special.gamma_p(a, a - 1 / 3) == pytest.approx(0.5, abs=1e-2 / a)
    for z in (-6, -2, -0.5, 0.5, 2, 6):  # by the cube root's normal approximation
        x = a * (1 - 1 / (9 * a) + z / (3 * math.sqrt(a))) ** 3
        assert special.gamma_p(a, x) == pytest.approx(statistics.NormalDist().cdf(z), rel=0.2 if abs(z) > 5 else 0.01, abs=2e-3 / math.sqrt(a))


def test_gamma_meets_at_the_expansion():
    x = np.linspace(800, 1250, 91)
    series = special.gamma_p(np.full(91, 1000.0), x)
    assert np.abs(special._expanded(np.full(91, 1000.0), x) - series).max() < 1e-9


def test_beta_of_large_arguments():
    for n in (10.0, 1e3, 1e5, 1e7):
        assert special.beta_i(n, n, 0.5) == pytest.approx(0.5, abs=1e-7)
        x = 0.5 + 1 / (2 * math.sqrt(2 * n + 1))  # one standard deviation
        assert special.beta_i(n, n, x) == pytest.approx(0.841345, abs=0.02 / math.sqrt(n) + 1e-4)
