"""The formula vocabulary and its compiler to columns.

`OPCODES` names every operator and function a stored formula can hold. `FUNCTIONS` maps a
name to what it computes: scalar columns, aggregates (to be used in `agg` or over a
window), windows, and batch functions (pandas UDFs). Names that need cell positions are
`REFERENCES`: they are relational operators, in `tabulon.operators.lookup` and
`tabulon.operators.matrix`. `INERT` names have no value of their own.

`compile_tokens` turns an infix token list into one column; `compile_text` reads the usual
notation, with columns in square brackets: `IF([qty] > 25; [qty] * 2; 0)`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tabulon.functions import numbering
from tabulon.functions import special as S

# Names by opcode, each list from its first opcode on.
BINARY = (21, "+ - * / & ^ = <> < > <= >= and or ! ~ :")
UNARY = (41, "Not - -")
CONSTANT = (46, "Pi Random True False Today Now NA Current")
ONE_ARGUMENT = (
    61,
    """Degrees Radians Sin Cos Tan Cot Asin Acos Atan ACot SinH CosH TanH CotH AsinH ACosH ATanH ACosH Exp Ln Sqrt Fact
    Year Month Day Hour Minute Second ± Abs Int Phi Gauss IsBlank IsText IsNonText IsLogical Type IsRef IsNumber IsFormula IsNA IsErr IsError IsEven IsOdd N
    DateValue TimeValue Code Trim Upper Proper Lower Len T Value Clean Char Log10 Even Odd NormDist Fisher FisherInv NormSInv GammaLn ErrorType IsErr Formula Arabic""",
)
MORE_ARGUMENTS = (
    201,
    """Atan2 Ceil Floor Round RoundUp RoundDown Trunc Log Power GCD LCM Mod SumProduct SumSQ SumX2MY2 SumX2PY2 SumXMY2 Date Time Days Days360 Min Max Sum Product Average Count
    CountA NPV IRR Var VarP StDev StDevP B NormDist ExpDist BinomDist Poisson Combin CombinA Permut PermutationA PV SYD DDB DB VDB Duration SLN PMT Columns Rows Column Row RRI FV
    NPER Rate IPMT PPMT CUMIPMT CUMPRINC Effective Nominal SubTotal DSum DCount DCountA DAverage DGet DMax DMin DProduct DStDev DStDevP DVar DVarP Indirect Address Match CountBlank
    CountIf SumIf LookUp VLookUp HLookUp MultiRange Offset Index Areas Dollar Replace Fixed Find Exact Left Right Search Mid Text Substitute Rept Concatenate MValue MDeterm MInverse
    MMult Transpose MUnit GoalSeek HypGeomDist HYPGEOM.DIST LogNormDist TDist FDist ChiDist WeiBull NegBinomDist CritBinom Kurt HarMean GeoMean Standardize AveDev Skew DevSQ Median
    Mode ZTest TTest Rank Percentile PercentRank Large Small Frequency Quartile NormInv Confidence FTest TrimMean Prob CorRel CoVar Pearson RSQ STEYX Slope Intercept Trend Growth
    Linest Logest Forecast ChiInv GammaDist GammaInv TInv FInv ChiTest LogInv Multiple.Operations BetaDist BetaInv WeekNum WeekDay #Name! Style DDE Base Sheet Sheets MinA MaxA
    AverageA StDevA StDevPA VarA VarPA EasterSunday Decimal Convert Roman MIRR Cell IsPMT""",
)
OPCODES = {first + k: name for first, names in (BINARY, UNARY, CONSTANT, ONE_ARGUMENT, MORE_ARGUMENTS) for k, name in enumerate(names.split())}
#: Opcodes whose name repeats another's, with a name of their own here.
OWN_NAME = {78: "ACotH", 123: "NormSDist"}

#: Functions of a whole table, below.
TABLE_WISE = {"AveDev": "avedev", "TrimMean": "trimmean"}
INERT = {"±", "#Name!", "Style", "DDE", "Current"}
REFERENCES = {
    "!": "lookup.intersect", "~": "lookup.union", ":": "ranges.cells_in", "IsRef": "lookup.is_reference", "IsFormula": "lookup.is_formula", "IsNA": "lookup.is_na", "IsErr": "lookup.is_err",
    "IsError": "lookup.is_error", "ErrorType": "lookup.error_type", "Formula": "lookup.formula_text", "Columns": "lookup.columns", "Rows": "lookup.rows", "Column": "lookup.column_of", "Row": "lookup.row_of",
    "Indirect": "lookup.indirect", "Address": "lookup.address", "Match": "lookup.match", "LookUp": "lookup.lookup", "VLookUp": "lookup.vlookup", "HLookUp": "lookup.hlookup", "MultiRange": "lookup.union",
    "Offset": "lookup.offset", "Index": "lookup.index", "Areas": "lookup.areas", "MValue": "matrix.value", "MDeterm": "matrix.determinant", "MInverse": "matrix.inverse", "MMult": "matrix.multiply",
    "Transpose": "matrix.transpose", "MUnit": "matrix.unit", "GoalSeek": "lookup.goal_seek", "Multiple.Operations": "lookup.multiple_operations", "Sheet": "lookup.sheet_of", "Sheets": "lookup.sheets", "Cell": "lookup.cell_info",
}


@dataclass(frozen=True)
class Function:
    kind: str  # scalar, aggregate, window, batch
    build: Callable[..., Column]


FUNCTIONS: dict[str, Function] = {}


def define(kind: str, **builders: Callable) -> None:
    for name, build in builders.items():
        FUNCTIONS[name.lower()] = Function(kind, build)


def named(kind: str, builders: dict[str, Callable]) -> None:
    define(kind, **builders)


def true(x: Column) -> Column:
    """A value as a condition: numbers above zero hold."""
    return x.cast("double") > 0


def num(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def number_in(text: Column) -> Column:
    """The number a text holds, else null."""
    return text.cast("string").try_cast("double")


def zero_if_text(text: Column) -> Column:
    return F.coalesce(number_in(text), F.when(text.isNotNull(), F.lit(0.0)))


def away(x: Column, n, up: bool) -> Column:
    scale = F.pow(F.lit(10.0), num(n))
    size = F.abs(num(x)) * scale
    return F.signum(num(x)) * (F.ceil(size) if up else F.floor(size)) / scale


def div(x, y) -> Column:
    """Null where y is zero, whatever the session's ANSI mode."""
    return F.try_divide(num(x), num(y))


# Operators and logic.
named("scalar", {
    "+": lambda x, y: num(x) + num(y), "*": lambda x, y: num(x) * num(y), "/": lambda x, y: F.try_divide(num(x), num(y)), "&": lambda *s: F.concat(*(x.cast("string") for x in s)),
    "-": lambda x, y=None: -num(x) if y is None else num(x) - num(y), "^": lambda x, y: F.pow(num(x), num(y)), "=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y,
    ">=": lambda x, y: x >= y, "%": lambda x: num(x) / 100, "and": lambda *c: _all(c), "or": lambda *c: _any(c), "not": lambda x: ~_condition(x),
})


def _condition(x: Column) -> Column:
    return F.coalesce(x.try_cast("double") > 0, F.lit(False))


def _all(given: Iterable[Column]) -> Column:
    out = F.lit(True)
    for x in given:
        out = out & _condition(x)
    return out


def _any(given: Iterable[Column]) -> Column:
    out = F.lit(False)
    for x in given:
        out = out | _condition(x)
    return out


define("scalar", **{
    "if": lambda c, a=None, b=None: F.when(_condition(c), F.lit(True) if a is None else a).otherwise(F.lit(False) if b is None else b),
    "choose": lambda n, *given: _choose(n, given), "pi": F.pi, "random": F.rand, "true": lambda: F.lit(True), "false": lambda: F.lit(False), "today": F.current_date, "now": F.current_timestamp, "na": lambda: F.lit(None).cast("double"),
})


def _choose(n: Column, given: tuple) -> Column:
    out = F.when(F.floor(n) == 1, given[0])
    for k, x in enumerate(given[1:], 2):
        out = out.when(F.floor(n) == k, x)
    return out


# Mathematics.
define("scalar", degrees=F.degrees, radians=F.radians, sin=F.sin, cos=F.cos, tan=F.tan, cot=F.cot, asin=F.asin, acos=F.acos, atan=F.atan, acot=lambda x: F.pi() / 2 - F.atan(x), sinh=F.sinh, cosh=F.cosh, tanh=F.tanh)
define("scalar", coth=lambda x: div(1, F.tanh(x)), asinh=F.asinh, acosh=F.acosh, atanh=F.atanh, acoth=lambda x: 0.5 * F.ln(div(num(x) + 1, num(x) - 1)), exp=F.exp, ln=F.ln, sqrt=F.sqrt, fact=lambda n: F.factorial(n.cast("int")))
define("scalar", abs=F.abs, int=F.floor, phi=lambda x: F.exp(-num(x) * num(x) / 2) / F.sqrt(2 * F.pi()), log10=F.log10, even=lambda x: F.signum(x) * F.ceil(F.abs(x) / 2) * 2, odd=lambda x: F.when(x >= 0, F.ceil((F.abs(x) + 1) / 2) * 2 - 1).otherwise(-(F.ceil((F.abs(x) + 1) / 2) * 2 - 1)))
define("scalar", atan2=lambda x, y: F.atan2(num(y), num(x)), ceil=lambda x, y=1: F.ceil(div(x, y)) * num(y), floor=lambda x, y=1: F.floor(div(x, y)) * num(y), round=lambda x, n=0: F.round(num(x), n), roundup=lambda x, n=0: away(x, n, True), rounddown=lambda x, n=0: away(x, n, False))
define("scalar", trunc=lambda x, n=0: away(x, n, False), log=lambda x, base=10: div(F.ln(num(x)), F.ln(num(base))), power=lambda x, y: F.pow(num(x), num(y)), mod=lambda x, y: num(x) - num(y) * F.floor(F.try_divide(num(x), num(y))), fisher=lambda x: 0.5 * F.ln(div(1 + num(x), 1 - num(x))), fisherinv=F.tanh)
define("scalar", base=lambda n, radix, width=0: F.when(F.length(F.conv(n.cast("string"), 10, radix)) < width, F.lpad(F.conv(n.cast("string"), 10, radix), max(width, 1), "0")).otherwise(F.conv(n.cast("string"), 10, radix)), decimal=lambda s, radix: F.conv(s, radix, 10).cast("double"), roman=lambda n: numbering.roman(n), arabic=numbering.from_roman)
define("scalar", iseven=lambda x: F.pmod(F.floor(F.abs(x)), F.lit(2)) == 0, isodd=lambda x: F.pmod(F.floor(F.abs(x)), F.lit(2)) == 1, permutationa=lambda n, k: F.pow(num(n), num(k)))


def _pairwise(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps (under 93 for longs)."""
    a, b = F.abs(a.cast("long")), F.abs(b.cast("long"))
    start = F.struct(a.alias("a"), b.alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(93)), start, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % F.when(s["b"] == 0, F.lit(1).cast("long")).otherwise(s["b"])).alias("b"))), lambda s: s["a"])


def _gcd(*given: Column) -> Column:
    out = given[0].cast("long")
    for x in given[1:]:
        out = _pairwise(out, x)
    return F.abs(out)


def _lcm(*given: Column) -> Column:
    out = given[0].cast("long")
    for x in given[1:]:
        own = _pairwise(out, x)
        out = F.when(own == 0, F.lit(0).cast("long")).otherwise(F.abs(out * x.cast("long")) / F.when(own == 0, F.lit(1).cast("long")).otherwise(own)).cast("long")
    return F.abs(out)


define("scalar", gcd=_gcd, lcm=_lcm)

# Dates.
define("scalar", year=F.year, month=F.month, day=F.day, hour=F.hour, minute=F.minute, second=F.second, datevalue=lambda s: F.try_to_date(s), timevalue=lambda s: F.try_to_timestamp(s), weeknum=F.weekofyear, weekday=lambda d, kind=1: F.dayofweek(d) if kind == 1 else F.weekday(d) + (1 if kind == 2 else 0))
define("scalar", date=lambda y, m, d: F.date_add(F.add_months(F.make_date(y.cast("int"), F.lit(1), F.lit(1)), m.cast("int") - 1), d.cast("int") - 1), time=lambda h, m, s: (num(h) * 3600 + num(m) * 60 + num(s)) / 86400, days=lambda a, b: F.datediff(a, b))

# Text and information.
define("scalar", code=F.ascii, trim=lambda s: F.trim(F.regexp_replace(s, " +", " ")), upper=F.upper, lower=F.lower, proper=F.initcap, len=F.char_length, clean=lambda s: F.regexp_replace(s, "[\\x00-\\x1f]", ""), char=lambda n: F.chr(n), value=number_in, n=lambda x: F.coalesce(number_in(x), F.lit(0.0)))
define("scalar", t=lambda s: F.when(F.typeof(s) == "string", s.cast("string")).otherwise(F.lit("")), isblank=lambda x: x.isNull(), istext=lambda x: F.typeof(x) == "string", isnontext=lambda x: F.typeof(x) != "string", islogical=lambda x: F.typeof(x) == "boolean", type=F.typeof, isnumber=lambda x: number_in(x).isNotNull())
define("scalar", replace=lambda s, at, n, new: F.overlay(s, new, at, n), find=lambda what, s, at=1: F.nullif(F.locate(what, s, at), F.lit(0)), exact=lambda a, b: a == b, left=lambda s, n=1: F.left(s, _int(n)), right=lambda s, n=1: F.right(s, _int(n)))
define("scalar", mid=lambda s, at, n: F.substring(s, _int(at), _int(n)), search=lambda what, s: F.nullif(F.regexp_instr(F.lower(s), F.lower(_text(what))), F.lit(0)), substitute=lambda s, old, new: F.replace(s, _text(old), _text(new)), rept=lambda s, n: F.repeat(s, _int(n)), concatenate=lambda *s: F.concat(*(x.cast("string") for x in s)))
define("scalar", dollar=lambda x, n=2: F.concat(F.lit("$"), F.format_number(num(x), n)), fixed=lambda x, n=2: F.format_number(num(x), n), standardize=lambda x, mean, sd: div(num(x) - num(mean), sd), frequency=lambda x, low, high, n: F.least(F.lit(n + 1), F.greatest(F.lit(0), F.floor((num(x) - low) / ((high - low) / n)) + 1)).cast("long"))


def _int(n) -> Column:
    return n.cast("int") if isinstance(n, Column) else F.lit(n)


def _text(s) -> Column:
    return s if isinstance(s, Column) else F.lit(s)


# Finance: rate, periods, payment, present and future value; due: 1 for payments at a period's start.


def _annuity(rate, n) -> Column:
    return div(F.pow(1 + num(rate), num(n)) - 1, rate)


def pv(rate, n, pmt, fv=0.0, due=0) -> Column:
    r = num(rate)
    return F.when(r == 0, -num(fv) - num(pmt) * num(n)).otherwise((-num(fv) - num(pmt) * (1 + r * num(due)) * _annuity(r, n)) * F.pow(1 + r, -num(n)))


def fv(rate, n, pmt, pv_=0.0, due=0) -> Column:
    r = num(rate)
    return F.when(r == 0, -num(pv_) - num(pmt) * num(n)).otherwise(-num(pv_) * F.pow(1 + r, num(n)) - num(pmt) * (1 + r * num(due)) * _annuity(r, n))


def pmt(rate, n, pv_, fv_=0.0, due=0) -> Column:
    r = num(rate)
    return F.when(r == 0, div(-(num(pv_) + num(fv_)), n)).otherwise(div(-(num(pv_) * F.pow(1 + r, num(n)) + num(fv_)), (1 + r * num(due)) * _annuity(r, n)))


def nper(rate, pmt_, pv_, fv_=0.0, due=0) -> Column:
    r, p = num(rate), num(pmt_)
    own = p * (1 + r * num(due))
    return F.when(r == 0, div(-(num(pv_) + num(fv_)), p)).otherwise(div(F.ln(div(own - num(fv_) * r, own + num(pv_) * r)), F.ln(1 + r)))


def ipmt(rate, period, n, pv_, fv_=0.0, due=0) -> Column:
    r = num(rate)
    own = fv(r, num(period) - 1, pmt(r, n, pv_, fv_, due), pv_, due) * r
    return F.when(num(due) == 1, F.when(num(period) == 1, F.lit(0.0)).otherwise((fv(r, num(period) - 2, pmt(r, n, pv_, fv_, 1), pv_, 1) - pmt(r, n, pv_, fv_, 1)) * r)).otherwise(own)


def ppmt(rate, period, n, pv_, fv_=0.0, due=0) -> Column:
    return pmt(rate, n, pv_, fv_, due) - ipmt(rate, period, n, pv_, fv_, due)


def cumulative(part: Callable) -> Callable:
    def column(rate, n, pv_, start, end, due=0) -> Column:
        return F.aggregate(F.sequence(_int(start), _int(end)), F.lit(0.0), lambda a, k: a + part(rate, k, n, pv_, 0.0, due))

    return column


define("scalar", pv=pv, fv=fv, pmt=pmt, nper=nper, ipmt=ipmt, ppmt=ppmt, cumipmt=cumulative(ipmt), cumprinc=cumulative(ppmt), sln=lambda cost, salvage, life: div(num(cost) - num(salvage), life))
define("scalar", syd=lambda cost, salvage, life, per: div((num(cost) - num(salvage)) * (num(life) - num(per) + 1) * 2, num(life) * (num(life) + 1)), duration=lambda r, a, b: div(F.ln(div(b, a)), F.ln(1 + num(r))), rri=lambda n, a, b: F.pow(div(b, a), div(1, n)) - 1)
define("scalar", effective=lambda r, n: F.pow(1 + div(r, n), num(n)) - 1, nominal=lambda r, n: num(n) * (F.pow(1 + num(r), div(1, n)) - 1), ispmt=lambda r, per, n, a: -num(a) * num(r) * (1 - div(per, n)), expdist=lambda x, rate, cum=1: F.when(num(cum) > 0, 1 - F.exp(-num(rate) * num(x))).otherwise(num(rate) * F.exp(-num(rate) * num(x))))
define("scalar", weibull=lambda x, shape, scale, cum=1: F.when(num(cum) > 0, 1 - F.exp(-F.pow(div(x, scale), num(shape)))).otherwise(div(shape, F.pow(num(scale), num(shape))) * F.pow(num(x), num(shape) - 1) * F.exp(-F.pow(div(x, scale), num(shape)))))

# Aggregates. The D functions take a condition last; the A ones count texts as zero.
define("aggregate", sum=F.sum, min=F.min, max=F.max, product=F.product, average=F.avg, count=lambda x: F.count(number_in(x)), counta=F.count, countblank=lambda x: F.count_if(x.isNull()), var=F.var_samp, varp=F.var_pop, stdev=F.stddev_samp, stdevp=F.stddev_pop)
define("aggregate", sumproduct=lambda x, y: F.sum(num(x) * num(y)), sumsq=lambda x: F.sum(num(x) * num(x)), sumx2my2=lambda x, y: F.sum(x * x - y * y), sumx2py2=lambda x, y: F.sum(x * x + y * y), sumxmy2=lambda x, y: F.sum((x - y) * (x - y)), npv=lambda r, x, n: F.sum(num(x) * F.pow(1 + num(r), -num(n))))
define("aggregate", countif=lambda c: F.count_if(c), sumif=lambda c, x: F.sum(F.when(c, x)), kurt=lambda x: _kurtosis(x), skew=lambda x: _skewness(x), harmean=lambda x: div(F.count(x), F.sum(div(1, x))), geomean=lambda x: F.exp(F.avg(F.ln(x))), devsq=lambda x: F.var_pop(x) * F.count(x), median=F.median)
define("aggregate", mode=lambda x: F.mode(x, True), percentile=lambda x, p: F.percentile(x, F.lit(p)), quartile=lambda x, q: F.percentile(x, F.lit(q / 4)), prob=lambda x, p, low, high=None: F.sum(F.when(x.between(low, low if high is None else high), p)), correl=F.corr, covar=F.covar_pop, pearson=F.corr)
define("aggregate", rsq=F.regr_r2, slope=F.regr_slope, intercept=F.regr_intercept, steyx=lambda y, x: F.sqrt(div(F.regr_syy(y, x) - div(F.pow(F.regr_sxy(y, x), 2), F.regr_sxx(y, x)), F.regr_count(y, x) - 2)), forecast=lambda at, y, x: F.regr_intercept(y, x) + F.regr_slope(y, x) * at)
for _name in ("Min", "Max", "Average", "StDev", "StDevP", "Var", "VarP"):
    _own = {"stdevp": "stdevpa", "varp": "varpa"}.get(_name.lower(), _name.lower() + "a")
    FUNCTIONS[_own] = Function("aggregate", lambda x, f=FUNCTIONS[_name.lower()].build: f(zero_if_text(x)))
for _name in ("Sum", "Count", "CountA", "Average", "Max", "Min", "Product", "StDev", "StDevP", "Var", "VarP"):
    FUNCTIONS["d" + _name.lower()] = Function("aggregate", lambda x, c, f=FUNCTIONS[_name.lower()].build: f(F.when(c, x)))
define("aggregate", dget=lambda x, c: F.when(F.count_if(c) == 1, F.max(F.when(c, x))))

# Function numbers of SubTotal.
SUBTOTALS = {1: "average", 2: "count", 3: "counta", 4: "max", 5: "min", 6: "product", 7: "stdev", 8: "stdevp", 9: "sum", 10: "var", 11: "varp"}
define("aggregate", subtotal=lambda n, x: FUNCTIONS[SUBTOTALS[n % 100]].build(x))


def _kurtosis(x: Column) -> Column:
    """With the sample's correction."""
    n = F.count(x).cast("double")
    return div(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)


def _skewness(x: Column) -> Column:
    n = F.count(x).cast("double")
    return div(F.sqrt(n * (n - 1)), n - 2) * F.skewness(x)


# Windows: over rows of a partition, by default all.
define("window", rank=lambda x, ascending=False, by=(): F.rank().over(Window.partitionBy(*by).orderBy(x.asc() if ascending else x.desc())), percentrank=lambda x, by=(): F.percent_rank().over(Window.partitionBy(*by).orderBy(x)))
define("window", large=lambda x, by=(): F.row_number().over(Window.partitionBy(*by).orderBy(x.desc())), small=lambda x, by=(): F.row_number().over(Window.partitionBy(*by).orderBy(x)))

# Distributions and the like, by batches.
_n = S.numeric
define("batch", gauss=_n(lambda x: S.norm_cdf(x) - 0.5), normsdist=_n(S.norm_cdf), normsinv=_n(S.norm_inv), gammaln=_n(S.log_gamma), confidence=_n(lambda a, sd, n: S.norm_inv(1 - a / 2) * sd / np.sqrt(n)), norminv=_n(lambda p, mean, sd: mean + sd * S.norm_inv(p)))
define("batch", normdist=_n(lambda x, mean, sd, cum: np.where(cum != 0, S.norm_cdf((x - mean) / sd), np.exp(-(((x - mean) / sd) ** 2) / 2) / (sd * np.sqrt(2 * np.pi)))), lognormdist=_n(lambda x, mean, sd: S.norm_cdf((np.log(x) - mean) / sd)), loginv=_n(lambda p, mean, sd: np.exp(mean + sd * S.norm_inv(p))))
define("batch", binomdist=_n(lambda k, n, p, cum: np.where(cum != 0, S.binomial_cdf(k, n, p), S.binomial_pmf(np.floor(k), n, p))), b=_n(lambda n, p, low, high: S.binomial_cdf(high, n, p) - S.binomial_cdf(low - 1, n, p)), poisson=_n(S.poisson), negbinomdist=_n(lambda x, r, p: np.exp(S.log_choose(x + r - 1, r - 1) + r * np.log(p) + x * np.log(1 - p))))
FUNCTIONS["hypgeom.dist"] = Function("batch", _n(S.hypergeometric))
define("batch", hypgeomdist=_n(S.hypergeometric), critbinom=_n(S.crit_binom), tdist=_n(lambda x, df, tails: S.t_tail(x, df) * tails / 2), fdist=_n(lambda x, a, b: 1 - S.f_cdf(x, a, b)), chidist=_n(lambda x, df: 1 - S.chi_cdf(x, df)), gammadist=_n(lambda x, a, b, cum: np.where(cum != 0, S.gamma_p(a, x / b), np.exp((a - 1) * np.log(x) - x / b - a * np.log(b) - S.log_gamma(a)))))
define("batch", chiinv=_n(lambda p, df: S.inverse(lambda x: S.chi_cdf(x, df), 1 - p, 0.0, 10.0)), gammainv=_n(lambda p, a, b: b * S.inverse(lambda x: S.gamma_p(a, x), p, 0.0, 10.0)), tinv=_n(lambda p, df: S.inverse(lambda x: 1 - S.t_tail(x, df), 1 - p, 0.0, 10.0)), finv=_n(lambda p, a, b: S.inverse(lambda x: S.f_cdf(x, a, b), 1 - p, 0.0, 10.0)))
define("batch", betadist=_n(lambda x, a, b: S.beta_i(a, b, x)), betainv=_n(lambda p, a, b: S.inverse(lambda x: S.beta_i(a, b, x), p, 0.0, 1.0)), combin=_n(lambda n, k: np.round(np.exp(S.log_choose(np.floor(n), np.floor(k))))), combina=_n(lambda n, k: np.round(np.exp(S.log_choose(n + k - 1, k)))), permut=_n(lambda n, k: np.round(np.exp(S.log_gamma(n + 1) - S.log_gamma(n - k + 1)))))
define("batch", ddb=_n(S.declining), db=_n(S.fixed_declining), vdb=_n(S.variable_declining), rate=_n(S.each(S.rate)), days360=lambda a, b, european=False: F.pandas_udf(S.days_360, "int")(a, b, F.lit(european)))


def _easter(year: Column) -> Column:
    @F.pandas_udf("date")
    def run(years: pd.Series) -> pd.Series:
        return pd.Series(S.easter(years), dtype=object)

    return run(year.cast("double"))


define("batch", eastersunday=_easter)


# Over a group's rows, in order.
def _grouped(function: Callable, more: int = 0) -> Callable:
    def column(flows: Column, order: Column, *args) -> Column:
        """flows are gathered in order: a group is one schedule of payments, bounded by nature."""
        gathered = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), num(flows).alias("v")))), lambda s: s["v"])

        @F.pandas_udf("double")
        def run(lists: pd.Series) -> pd.Series:
            out = [function(list(v), *args) for v in lists]
            return pd.Series([None if x != x else x for x in out], dtype=float)

        return run(gathered)

    return column


define("aggregate", irr=_grouped(S.irr), mirr=_grouped(S.mirr))

# Tests: their statistics are aggregates, their p-values batch functions of those.
define("aggregate", ztest=lambda x, at, sd=None: 1 - _n(S.norm_cdf)(div(F.avg(x) - at, F.stddev_samp(x) if sd is None else F.lit(sd)) * F.sqrt(F.count(x))))
define("aggregate", ttest=lambda x, y, tails=2: _n(lambda t, df: S.t_tail(t, df) * tails / 2)(div(F.avg(x - y), F.stddev_samp(x - y)) * F.sqrt(F.count(x - y)), F.count(x - y) - 1))
define("aggregate", ftest=lambda x, y: _n(lambda f, a, b: 2 * np.minimum(S.f_cdf(f, a, b), 1 - S.f_cdf(f, a, b)))(div(F.var_samp(x), F.var_samp(y)), F.count(x) - 1, F.count(y) - 1))
define("aggregate", chitest=lambda seen, expected: 1 - _n(S.chi_cdf)(F.sum(div((seen - expected) * (seen - expected), expected)), F.count(seen) - 1))
define("aggregate", linest=lambda y, x: F.struct(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2")), logest=lambda y, x: F.struct(F.exp(F.regr_slope(F.ln(y), x)).alias("base"), F.exp(F.regr_intercept(F.ln(y), x)).alias("factor"), F.regr_r2(F.ln(y), x).alias("r2")))
define("window", trend=lambda y, x, by=(): (lambda w: F.regr_intercept(y, x).over(w) + F.regr_slope(y, x).over(w) * x)(Window.partitionBy(*by)), growth=lambda y, x, by=(): (lambda w: F.exp(F.regr_intercept(F.ln(y), x).over(w) + F.regr_slope(F.ln(y), x).over(w) * x))(Window.partitionBy(*by)))

# Two passes: the deviation needs the mean, the trimmed mean its bounds.


def avedev(df, x: str, by: list[str] | None = None, name: str = "avedev"):
    """Mean absolute deviation, per group: the means are joined back (one row per group)."""
    by = by or []
    if not by:
        mean = df.agg(F.avg(x).alias("__mean"))
        return df.crossJoin(F.broadcast(mean)).agg(F.avg(F.abs(F.col(x) - F.col("__mean"))).alias(name))  # one row
    means = df.groupBy(*by).agg(F.avg(x).alias("__mean"))
    return df.join(means, by).groupBy(*by).agg(F.avg(F.abs(F.col(x) - F.col("__mean"))).alias(name))


def trimmean(df, x: str, share: float, by: list[str], order: str, name: str = "trimmean"):
    """The mean without the share of rows at both ends, rounded down to an even number of rows."""
    window = Window.partitionBy(*by)
    ranked = df.filter(F.col(x).isNotNull()).withColumns({"__k": F.row_number().over(window.orderBy(x, order)), "__n": F.count(F.lit(1)).over(window)})
    cut = F.floor(F.col("__n") * share / 2)
    return ranked.filter((F.col("__k") > cut) & (F.col("__k") <= F.col("__n") - cut)).groupBy(*by).agg(F.avg(x).alias(name))


# Units: a value in base units is value * factor + shift.
# Units by quantity.
UNITS = {
    "m": ("length", 1.0, 0.0), "km": ("length", 1000.0, 0.0), "in": ("length", 0.0254, 0.0), "ft": ("length", 0.3048, 0.0), "yd": ("length", 0.9144, 0.0), "mi": ("length", 1609.344, 0.0), "Nmi": ("length", 1852.0, 0.0),
    "g": ("mass", 0.001, 0.0), "kg": ("mass", 1.0, 0.0), "lbm": ("mass", 0.45359237, 0.0), "ozm": ("mass", 0.028349523125, 0.0), "s": ("time", 1.0, 0.0), "mn": ("time", 60.0, 0.0), "hr": ("time", 3600.0, 0.0), "day": ("time", 86400.0, 0.0),
    "C": ("temperature", 1.0, 273.15), "K": ("temperature", 1.0, 0.0), "F": ("temperature", 5 / 9, 273.15 - 32 * 5 / 9), "l": ("volume", 0.001, 0.0), "gal": ("volume", 0.003785411784, 0.0), "J": ("energy", 1.0, 0.0), "cal": ("energy", 4.1868, 0.0),
}


def convert(x: Column, unit: str, to: str) -> Column:
    """Null between units of different quantities."""
    a, b = UNITS.get(unit), UNITS.get(to)
    if not a or not b or a[0] != b[0]:
        return F.lit(None).cast("double")
    return (num(x) * a[1] + a[2] - b[2]) / b[1]


define("scalar", convert=convert)


def text_format(x: Column, code: str) -> Column:
    from tabulon.functions.formats import formatted

    return formatted(x, code)


define("scalar", text=text_format)


def function(name: str) -> Function:
    found = FUNCTIONS.get(name.lower())
    if not found:
        where = next((v for k, v in REFERENCES.items() if k.lower() == name.lower()), None)
        raise ValueError(f"{name} works on cell positions: see tabulon.operators.{where}" if where else f"{name} has no value")
    return found


def coverage() -> dict[int, str]:
    """For every opcode, how it is executed: a kind, the relational operator, or `inert`."""
    out = {}
    for code, name in OPCODES.items():
        own = OWN_NAME.get(code, name).lower()
        where = REFERENCES.get(name)
        out[code] = f"operators.{where}" if where else FUNCTIONS[own].kind if own in FUNCTIONS else TABLE_WISE.get(name) or ("inert" if name in INERT else "missing")
    return out


# Tokens: {"type": operator | function | number | text | cell | cells | column, ...}

PRECEDENCE = {"or": 1, "and": 2, "=": 3, "<>": 3, "<": 3, ">": 3, "<=": 3, ">=": 3, "&": 4, "+": 5, "-": 5, "*": 6, "/": 6, "^": 7}
LEXER = re.compile(r"\s*(?:(\[[^\]]+\])|(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)|\"((?:[^\"]|\"\")*)\"|(<>|<=|>=|[-+*/&^=<>%();])|([A-Za-z_#][\w.]*))")


def tokens(text: str) -> list[dict]:
    """A formula's token list."""
    out, at, text = [], 0, text.removeprefix("=")
    while at < len(text.rstrip()):
        m = LEXER.match(text, at)
        if not m:
            raise ValueError(f"no token at {text[at:]!r}")
        at = m.end()
        column, number, string, operator, name = m.groups()
        if column:
            out.append({"type": "column", "name": column[1:-1]})
        elif number:
            out.append({"type": "number", "value": float(number) if "." in number or "e" in number.lower() else int(number)})
        elif string is not None:
            out.append({"type": "text", "value": string.replace('""', '"')})
        elif operator:
            out.append({"type": "operator", "name": operator})
        else:
            word = name.lower()
            out.append({"type": "operator", "name": word} if word in ("and", "or") and text[at : at + 1] != "(" else {"type": "function", "name": name})
    return out


def infix(stack: list[dict]) -> list[dict]:
    """A token list in reverse Polish order (functions with `arity`) as infix."""
    done: list[list[dict]] = []
    mark = lambda s: {"type": "operator", "name": s}
    for token in stack:
        if token["type"] == "operator" and token.get("arity", 2) == 2:
            b, a = done.pop(), done.pop()
            done.append([mark("("), *a, token, *b, mark(")")])
        elif token["type"] == "operator":
            own = done.pop()
            done.append([*own, token] if token["name"] == "%" else [mark("("), token, *own, mark(")")])
        elif token["type"] == "function":
            n = token.get("arity", 0)
            args = done[len(done) - n :] if n else []
            del done[len(done) - n :]
            inner = [t for k, a in enumerate(args) for t in ([mark(";")] if k else []) + a]
            done.append([token, mark("("), *inner, mark(")")])
        else:
            done.append([token])
    if len(done) != 1:
        raise ValueError("the stack does not come to one value")
    return done[0]


#: Arguments that a function's builder takes as plain values.
PLAIN = {"round": {1}, "base": {1, 2}, "decimal": {1}, "weekday": {1}, "dollar": {1}, "fixed": {1}, "frequency": {1, 2, 3}, "percentile": {1}, "quartile": {1}, "subtotal": {0}, "convert": {1, 2}, "text": {1}, "find": {0}, "days360": {2}, "replace": {1, 2}, "irr": {2}, "mirr": {2, 3}}


def compile_tokens(given: list[dict], resolve: Callable[[dict], Column] | None = None) -> Column:
    """One column. resolve: gives the column of a cell, cells or column token."""
    resolve = resolve or (lambda t: F.col(t["name"]))
    at = 0

    def peek() -> str | None:
        return given[at].get("name") if at < len(given) and given[at]["type"] == "operator" else None

    def take(name: str) -> None:
        nonlocal at
        if peek() != name:
            raise ValueError(f"{name} is missing")
        at += 1

    def call(name: str, args: list) -> Column:
        plain = PLAIN.get(name.lower(), set())
        return function(name).build(*(a[1] if k in plain and a[1] is not None else a[0] for k, a in enumerate(args)))

    def value() -> tuple[Column, object]:
        """(column, the plain value of a constant)"""
        nonlocal at
        if at >= len(given):
            raise ValueError("the formula ends early")
        token = given[at]
        at += 1
        kind = token["type"]
        if kind in ("number", "text"):
            out = F.lit(token["value"]), token["value"]
        elif kind == "function":
            args = []
            if peek() == "(":
                take("(")
                while peek() != ")":
                    args.append(climb(0))
                    if peek() == ";":
                        take(";")
                take(")")
            out = call(token["name"], args), None
        elif kind == "operator" and token["name"] == "(":
            out = climb(0)
            take(")")
        elif kind == "operator" and token["name"] in ("-", "+", "not"):
            own = climb(7)
            out = (own[0], own[1]) if token["name"] == "+" else (call(token["name"], [own]), -own[1] if token["name"] == "-" and isinstance(own[1], int | float) else None)
        else:
            out = resolve(token), None
        while peek() == "%":
            take("%")
            out = call("%", [out]), None
        return out

    def climb(least: int) -> tuple[Column, object]:
        nonlocal at
        left = value()
        while (name := peek()) in PRECEDENCE and PRECEDENCE[name] > least:
            at += 1
            left = call(name, [left, climb(PRECEDENCE[name])]), None
        return left

    out = climb(0)[0]
    if at != len(given):
        raise ValueError("the formula goes on after its end")
    return out


def compile_text(text: str) -> Column:
    return compile_tokens(tokens(text))


def render(given: list[dict]) -> str:
    """A token list in the usual notation."""
    show = {"number": lambda t: f"{t['value']:g}" if isinstance(t["value"], float) else str(t["value"]), "text": lambda t: '"' + t["value"].replace('"', '""') + '"', "column": lambda t: f"[{t['name']}]"}
    return "".join(show.get(t["type"], lambda t: str(t.get("name", t.get("ref", ""))))(t) for t in given)
