"""Queries over the test tables, one per operator, each with its SQL.

`QUERIES[name]` takes (spark, folder); `SQL[name]` is the same result in DuckDB's dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions import formats, formula, numbering
from tabulon.functions.formula import FUNCTIONS, compile_text
from tabulon.operators import emit, lookup, matrix, names, query, ranges, text
from tabulon.plans import files  # noqa: F401  registers its queries
from tabulon.plans.registry import QUERIES, SQL, read, register  # noqa: F401
from tabulon.plans.specs import Dimension, Entry, Group, Key, Pilot, Query, Rule, Sort, Subtotal

c = F.col


def r(x, n: int = 4):
    return F.round(x, n)


# Filters, sorts, distinct rows.


@register("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE (l_quantity > 25 AND l_discount < 0.05) OR l_returnflag = 'R'")
def filter_and_or(spark, d):
    q = Query((Entry("l_quantity", ">", 25), Entry("l_discount", "<", 0.05), Entry("l_returnflag", "=", "R", connect="or")))
    return query.filtered(read(spark, d, "lineitem"), q).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@register("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_type, '(A|E)[A-Z]*$')")
def filter_regex(spark, d):
    return query.filtered(read(spark, d, "part"), Query((Entry("p_type", "regex", "(A|E)[A-Z]*$"),))).select("p_partkey", "p_name")


@register("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def filter_case_insensitive(spark, d):
    return query.filtered(read(spark, d, "customer"), Query((Entry("c_mktsegment", "=", "Building"),), case_sensitive=False)).select("c_custkey", "c_mktsegment")


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT min(p) FROM (SELECT o_totalprice AS p FROM orders ORDER BY p DESC LIMIT 25))")
def filter_top(spark, d):
    return query.filtered(read(spark, d, "orders"), Query((Entry("o_totalprice", "top", 25),))).select("o_orderkey", "o_totalprice")


@register("SELECT p_partkey, p_brand, p_type FROM part WHERE contains(lower(p_type), 'e') AND NOT starts_with(lower(p_brand), 'brand#1')")
def filter_text_parts(spark, d):
    found = query.filtered(read(spark, d, "part"), Query((Entry("p_type", "contains", "E"),), case_sensitive=False))
    return found.filter(~query.condition(Entry("p_brand", "begins", "BRAND#1"), Query(case_sensitive=False), "string")).select("p_partkey", "p_brand", "p_type")


@register("SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 100")
def sort_three_keys_topn(spark, d):
    spec = Sort((Key("o_orderstatus"), Key("o_totalprice", False), Key("o_orderkey")), limit=100)
    return query.sorted_rows(read(spark, d, "orders"), spec).select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


@register("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_orderkey LIMIT 50")
def sort_user_list(spark, d):
    spec = Sort((Key("o_orderpriority", user_list=("3-MEDIUM", "1-URGENT")), Key("o_orderkey")), limit=50)
    return query.sorted_rows(read(spark, d, "orders"), spec).select("o_orderkey", "o_orderpriority")


@register("SELECT DISTINCT l_returnflag, l_linestatus, l_discount FROM lineitem")
def distinct_rows(spark, d):
    return query.distinct(read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_discount"))


@register("SELECT p_partkey, p_brand, p_size FROM part WHERE (p_brand = 'Brand#12' AND p_size > 10) OR (p_size <= 3) OR (p_brand = 'Brand#23')")
def advanced_filter(spark, d):
    criteria = spark.createDataFrame([("Brand#12", ">10"), (None, "<=3"), ("Brand#23", "")], "p_brand string, p_size string")
    return query.advanced_filter(read(spark, d, "part"), criteria).select("p_partkey", "p_brand", "p_size")


@register("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_anti_filter(spark, d):
    keys = read(spark, d, "orders").filter("o_totalprice > 400000").select(c("o_custkey").alias("c_custkey"))
    return query.semi_filter(read(spark, d, "customer"), keys, ["c_custkey"], anti=True).select("c_custkey", "c_name")


# Subtotals, pivots, consolidation.


@register("SELECT l_returnflag, CAST(grouping(l_returnflag) AS INTEGER) AS level, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, count(l_orderkey) AS count_l_orderkey FROM lineitem WHERE l_quantity > 25 GROUP BY ROLLUP (l_returnflag)")
def subtotal_one(spark, d):
    """Filter, sort and subtotal of a database range."""
    found = query.filtered(read(spark, d, "lineitem"), Query((Entry("l_quantity", ">", 25),)))
    made = query.subtotals(found, Subtotal((Group("l_returnflag", (("l_extendedprice", "sum"), ("l_orderkey", "count"))),)))
    return made.withColumn("sum_l_extendedprice", r("sum_l_extendedprice", 2)).orderBy(c("l_returnflag").asc_nulls_last())


@register("""SELECT l_returnflag, l_linestatus, l_linenumber, CAST(grouping(l_returnflag) + grouping(l_linestatus) + grouping(l_linenumber) AS INTEGER) AS level, round(sum(l_quantity), 2) AS sum_l_quantity, round(avg(l_discount), 6) AS average_l_discount, max(l_tax) AS max_l_tax
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus, l_linenumber)""")
def subtotal_three(spark, d):
    spec = Subtotal((Group("l_returnflag", (("l_quantity", "sum"),)), Group("l_linestatus", (("l_discount", "average"),)), Group("l_linenumber", (("l_tax", "max"),))))
    return query.subtotals(read(spark, d, "lineitem"), spec).withColumns({"sum_l_quantity": r("sum_l_quantity", 2), "average_l_discount": r("average_l_discount", 6)})


@register("""SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal, 0 AS level, NULL AS sum_c_acctbal FROM customer
UNION ALL SELECT NULL, c_mktsegment, NULL, NULL, CAST(grouping(c_mktsegment) + 1 AS INTEGER), round(sum(c_acctbal), 2) FROM customer GROUP BY ROLLUP (c_mktsegment)""")
def subtotal_detail(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    return query.with_subtotals(rows, Subtotal((Group("c_mktsegment", (("c_acctbal", "sum"),)),))).withColumn("sum_c_acctbal", r("sum_c_acctbal", 2))


@register("""SELECT o_orderstatus, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS "1-URGENT_sum_o_totalprice", round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH'), 2) AS "2-HIGH_sum_o_totalprice" FROM orders GROUP BY o_orderstatus""")
def pivot_sum(spark, d):
    spec = Pilot((Dimension("o_orderstatus"), Dimension("o_orderpriority", "column"), Dimension("o_totalprice", "data", "sum")), values=("1-URGENT", "2-HIGH"))
    out = query.pilot(read(spark, d, "orders"), spec)
    return out.select("o_orderstatus", *(r(c(f"`{x}`"), 2).alias(x) for x in out.columns[1:]))


@register("""SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) + grouping(o_orderpriority) AS INTEGER) AS level, round(sum(o_totalprice), 2) AS sum_o_totalprice, count(o_orderkey) AS count_o_orderkey
FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())""")
def pivot_totals(spark, d):
    spec = Pilot((Dimension("o_orderstatus", subtotal=True), Dimension("o_orderpriority"), Dimension("o_totalprice", "data", "sum"), Dimension("o_orderkey", "data", "count")), total_rows=True)
    return query.pilot(read(spark, d, "orders"), spec).withColumn("sum_o_totalprice", r("sum_o_totalprice", 2))


@register("SELECT o_orderpriority, round(avg(o_totalprice), 2) AS average_o_totalprice FROM orders WHERE o_orderpriority NOT IN ('5-LOW') AND o_orderstatus = 'F' GROUP BY o_orderpriority")
def pivot_member_hidden(spark, d):
    spec = Pilot((Dimension("o_orderpriority", hidden=("5-LOW",)), Dimension("o_orderstatus", "page", page="F"), Dimension("o_totalprice", "data", "average")))
    return query.pilot(read(spark, d, "orders"), spec).withColumn("average_o_totalprice", r("average_o_totalprice", 2))


@register("SELECT nationkey, round(sum(acctbal), 2) AS acctbal FROM (SELECT s_nationkey AS nationkey, s_acctbal AS acctbal FROM supplier UNION ALL SELECT c_nationkey, c_acctbal FROM customer) GROUP BY nationkey")
def consolidate_label(spark, d):
    areas = [read(spark, d, t).select(c(f"{k}_nationkey").alias("nationkey"), c(f"{k}_acctbal").alias("acctbal")) for t, k in (("supplier", "s"), ("customer", "c"))]
    return query.consolidate(areas, "sum", "nationkey").withColumn("acctbal", r("acctbal", 2))


@register("""SELECT CAST(position AS INTEGER) AS position, max(acctbal) AS acctbal FROM (SELECT row_number() OVER (ORDER BY s_suppkey) AS position, s_acctbal AS acctbal FROM supplier UNION ALL SELECT row_number() OVER (ORDER BY c_custkey), c_acctbal FROM customer) GROUP BY position""")
def consolidate_position(spark, d):
    areas = [read(spark, d, t).select(c(k).alias("key"), c(v).alias("acctbal")) for t, k, v in (("supplier", "s_suppkey", "s_acctbal"), ("customer", "c_custkey", "c_acctbal"))]
    return query.consolidate(areas, "max", order=["key"])


# Validation, outlines, changes, mail merge.


@register("SELECT l_orderkey, l_linenumber, (l_quantity BETWEEN 1 AND 40 AND l_quantity = floor(l_quantity)) AND l_returnflag IN ('A', 'N') AND NOT l_discount BETWEEN 0.02 AND 0.04 AS valid FROM lineitem")
def validate_flags(spark, d):
    rules = [Rule("l_quantity", "whole", "between", 1, 40), Rule("l_returnflag", "list", members=("A", "N")), Rule("l_discount", "decimal", "outside", 0.02, 0.04)]
    return query.validated(read(spark, d, "lineitem"), rules).select("l_orderkey", "l_linenumber", "valid")


@register("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal > 5000 THEN 'rich' END AS style FROM customer")
def conditional_styles(spark, d):
    return query.styled(read(spark, d, "customer").select("c_custkey", "c_acctbal"), [(c("c_acctbal") < 0, "negative"), (c("c_acctbal") > 5000, "rich")]).select("c_custkey", "style")


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_orderkey BETWEEN 10 AND 29 OR o_orderkey BETWEEN 500 AND 1499)")
def outline_hidden(spark, d):
    outline = spark.createDataFrame([(10, 20, True), (500, 1000, True), (100, 50, False)], "start long, size long, hidden boolean")
    return ranges.outline_rows(read(spark, d, "orders"), c("o_orderkey"), outline).select("o_orderkey", "o_totalprice")


@register("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value >= 1) WHERE k = 1")
def change_log_replay(spark, d):
    log = read(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return query.replayed(log, ["user_id", "event_type"], ["ts", "event_id"], c("value") < 1).select("user_id", "event_type", "event_id", "value")


@register("SELECT event_id, author, state FROM (SELECT event_id, user_id AS author, event_type AS state, ts FROM events) WHERE author <> 7 AND state IN ('click', 'purchase')")
def change_view(spark, d):
    log = read(spark, d, "events").select("event_id", c("user_id").alias("author"), c("event_type").alias("state"), c("ts").alias("date"))
    return query.change_view(log, author=7, but_author=True, states=["click", "purchase"]).select("event_id", "author", "state")


@register("SELECT CAST(record_number AS INTEGER) AS record_number, c_custkey, c_name FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS record_number, * FROM customer) WHERE (record_number BETWEEN 3 AND 9 OR record_number BETWEEN 40 AND 60) AND c_acctbal > 0")
def merge_row_select(spark, d):
    return query.merge_rows(read(spark, d, "customer"), ["c_custkey"], [(3, 9), (40, 60)], c("c_acctbal") > 0).select("record_number", "c_custkey", "c_name")


# Formulas.


@register("""SELECT l_orderkey, l_linenumber, round(sin(l_quantity) + sqrt(l_extendedprice), 6) AS a, CASE WHEN l_quantity > 25 THEN l_quantity * 2 ELSE 0 END AS b, l_quantity - 7 * floor(l_quantity / 7) AS m,
round(ceil(l_tax * 100) / 100, 6) AS up, round(ln(l_quantity + 1) / ln(2), 6) AS lg, round(power(1 + l_discount, 3), 6) AS p FROM lineitem""")
def fn_scalar_math(spark, d):
    made = {"a": "ROUND(SIN([l_quantity]) + SQRT([l_extendedprice]); 6)", "b": "IF([l_quantity] > 25; [l_quantity] * 2; 0)", "m": "MOD([l_quantity]; 7)", "up": "ROUND(CEIL([l_tax] * 100) / 100; 6)", "lg": "ROUND(LOG([l_quantity] + 1; 2); 6)", "p": "ROUND((1 + [l_discount]) ^ 3; 6)"}
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(compile_text(t).alias(k) for k, t in made.items()))


@register("SELECT p_partkey, upper(p_brand) || '-' || left(p_name, 3) AS a, length(p_name) AS n, substr(p_type, 2, 3) AS mid, right(p_type, 2) AS rt, replace(p_brand, '#', '_') AS sub, repeat('x', CAST(p_size % 5 AS INTEGER)) AS rep FROM part")
def fn_scalar_text(spark, d):
    made = {"a": 'UPPER([p_brand]) & "-" & LEFT([p_name]; 3)', "n": "LEN([p_name])", "mid": "MID([p_type]; 2; 3)", "rt": "RIGHT([p_type]; 2)", "sub": 'SUBSTITUTE([p_brand]; "#"; "_")', "rep": 'REPT("x"; MOD([p_size]; 5))'}
    return read(spark, d, "part").select("p_partkey", *(compile_text(t).alias(k) for k, t in made.items()))


@register("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, dayofweek(o_orderdate) + 1 AS wd, weekofyear(o_orderdate) AS wk, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders")
def fn_scalar_date(spark, d):
    made = {"y": "YEAR([o_orderdate])", "m": "MONTH([o_orderdate])", "dd": "DAY([o_orderdate])", "wd": "WEEKDAY([o_orderdate])", "wk": "WEEKNUM([o_orderdate])", "days": "DAYS([o_orderdate]; DATE(1995; 1; 1))"}
    return read(spark, d, "orders").select("o_orderkey", *(compile_text(t).alias(k) for k, t in made.items()))


@register("""SELECT l_orderkey, l_linenumber, (l_quantity > 10 AND l_discount > 0.02) AS a, (l_quantity > 40 OR l_tax < 0.01) AS o, NOT (l_quantity > 10) AS n, CASE l_linenumber WHEN 1 THEN 'one' WHEN 2 THEN 'two' WHEN 3 THEN 'three' END AS ch, l_linenumber % 2 = 0 AS ev FROM lineitem""")
def fn_logic(spark, d):
    made = {"a": "AND([l_quantity] > 10; [l_discount] > 0.02)", "o": "OR([l_quantity] > 40; [l_tax] < 0.01)", "n": "NOT([l_quantity] > 10)", "ch": 'CHOOSE([l_linenumber]; "one"; "two"; "three")', "ev": "ISEVEN([l_linenumber])"}
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(compile_text(t).alias(k) for k, t in made.items()))


def aggregated(df: DataFrame, by: list[str], made: dict[str, tuple], digits: int = 6) -> DataFrame:
    def value(f: str, args: tuple):
        out = FUNCTIONS[f].build(*(c(a) if isinstance(a, str) else a for a in args))
        return out if f in ("count", "counta", "countblank", "countif") else F.round(out, digits)

    return df.groupBy(*by).agg(*(value(f, args).alias(k) for k, (f, *args) in made.items()))


@register("SELECT l_returnflag, round(sum(l_quantity), 6) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean, count(l_quantity) AS n, round(sum(l_quantity * l_discount), 4) AS sp, round(sum(l_tax * l_tax), 4) AS sq FROM lineitem GROUP BY l_returnflag")
def fn_agg_basic(spark, d):
    made = {"s": ("sum", "l_quantity"), "lo": ("min", "l_quantity"), "hi": ("max", "l_quantity"), "mean": ("average", "l_quantity"), "n": ("count", "l_quantity"), "sp": ("sumproduct", "l_quantity", "l_discount"), "sq": ("sumsq", "l_tax")}
    return aggregated(read(spark, d, "lineitem"), ["l_returnflag"], made).withColumns({"sp": r("sp", 4), "sq": r("sq", 4)})


@register("""SELECT l_returnflag, round(var_samp(l_quantity), 4) AS v, round(var_pop(l_quantity), 4) AS vp, round(stddev_samp(l_quantity), 4) AS sd, round(stddev_pop(l_quantity), 4) AS sdp, median(l_quantity) AS med, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.9) AS p90,
round(exp(avg(ln(l_quantity))), 4) AS gm, round(count(*) / sum(1 / l_quantity), 4) AS hm, round(var_pop(l_quantity) * count(*), 1) AS dsq, round(skewness(l_quantity), 4) AS sk, round(kurtosis(l_quantity), 4) AS ku FROM lineitem GROUP BY l_returnflag""")
def fn_agg_stat(spark, d):
    x = "l_quantity"
    made = {"v": ("var", x), "vp": ("varp", x), "sd": ("stdev", x), "sdp": ("stdevp", x), "med": ("median", x), "q1": ("quartile", x, 1), "p90": ("percentile", x, 0.9), "gm": ("geomean", x), "hm": ("harmean", x), "dsq": ("devsq", x), "sk": ("skew", x), "ku": ("kurt", x)}
    return aggregated(read(spark, d, "lineitem"), ["l_returnflag"], made, 4).withColumn("dsq", r("dsq", 1))


@register("""SELECT l_linestatus, round(corr(l_extendedprice, l_quantity), 6) AS co, round(covar_pop(l_extendedprice, l_quantity), 2) AS cv, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_slope(l_extendedprice, l_quantity), 4) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 2) AS ic,
round(regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * 12, 2) AS fc, round(sqrt((regr_syy(l_extendedprice, l_quantity) - power(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)), 2) AS se FROM lineitem GROUP BY l_linestatus""")
def fn_regression(spark, d):
    y, x = "l_extendedprice", "l_quantity"
    made = {"co": ("correl", y, x), "cv": ("covar", y, x), "r2": ("rsq", y, x), "sl": ("slope", y, x), "ic": ("intercept", y, x), "fc": ("forecast", F.lit(12), y, x), "se": ("steyx", y, x)}
    out = aggregated(read(spark, d, "lineitem"), ["l_linestatus"], made)
    return out.withColumns({k: r(k, n) for k, n in (("cv", 2), ("sl", 4), ("ic", 2), ("fc", 2), ("se", 2))})


@register("""SELECT event_type, min(x) AS lo, max(x) AS hi, round(avg(x), 6) AS mean, round(stddev_samp(x), 4) AS sd, round(var_pop(x), 4) AS vp FROM (SELECT event_type, CASE WHEN s IS NULL THEN NULL ELSE coalesce(try_cast(s AS DOUBLE), 0) END AS x FROM (SELECT event_type, CASE WHEN user_id % 3 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS s FROM events)) GROUP BY event_type""")
def fn_a_variants(spark, d):
    rows = read(spark, d, "events").select("event_type", F.when(c("user_id") % 3 == 0, c("event_type")).otherwise(c("user_id").cast("string")).alias("s"))
    return aggregated(rows, ["event_type"], {"lo": ("mina", "s"), "hi": ("maxa", "s"), "mean": ("averagea", "s"), "sd": ("stdeva", "s"), "vp": ("varpa", "s")}).withColumns({"sd": r("sd"), "vp": r("vp")})


@register("""SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_discount > 0.05), 4) AS s, count(l_quantity) FILTER (WHERE l_discount > 0.05) AS n, round(avg(l_quantity) FILTER (WHERE l_discount > 0.05), 4) AS mean, min(l_quantity) FILTER (WHERE l_discount > 0.05) AS lo, max(l_quantity) FILTER (WHERE l_discount > 0.05) AS hi,
round(stddev_samp(l_quantity) FILTER (WHERE l_discount > 0.05), 4) AS sd, round(var_pop(l_quantity) FILTER (WHERE l_discount > 0.05), 4) AS vp FROM lineitem GROUP BY l_returnflag""")
def fn_d_family(spark, d):
    when = c("l_discount") > 0.05
    made = {k: (f, "l_quantity", when) for k, f in (("s", "dsum"), ("n", "dcount"), ("mean", "daverage"), ("lo", "dmin"), ("hi", "dmax"), ("sd", "dstdev"), ("vp", "dvarp"))}
    return aggregated(read(spark, d, "lineitem"), ["l_returnflag"], made, 4).withColumn("n", c("n").cast("long"))


@register("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 150000) AS n, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 150000), 2) AS s, count(*) FILTER (WHERE o_orderpriority IS NULL) AS blank FROM orders GROUP BY o_orderstatus")
def fn_countif_sumif(spark, d):
    when = c("o_totalprice") > 150000
    return aggregated(read(spark, d, "orders"), ["o_orderstatus"], {"n": ("countif", when), "s": ("sumif", when, "o_totalprice"), "blank": ("countblank", "o_orderpriority")}, 2)


@register("SELECT l_orderkey, count(*) AS n, round(exp(sum(ln(1 + l_tax))), 4) AS prod, round(sum(l_discount / power(1.1, l_linenumber)), 4) AS npv, round(sum(l_quantity * l_quantity - l_tax * l_tax), 6) AS d2, round(sum((l_quantity - l_tax) * (l_quantity - l_tax)), 6) AS dd FROM lineitem GROUP BY l_orderkey")
def fn_sumproduct(spark, d):
    rows = read(spark, d, "lineitem").withColumn("t1", 1 + c("l_tax"))
    b = lambda f, *a: FUNCTIONS[f].build(*a)
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), r(b("product", c("t1"))).alias("prod"), r(b("npv", 0.1, c("l_discount"), c("l_linenumber"))).alias("npv"), r(b("sumx2my2", c("l_quantity"), c("l_tax")), 6).alias("d2"), r(b("sumxmy2", c("l_quantity"), c("l_tax")), 6).alias("dd"))


# Lookups and matrices.


@register("SELECT l_orderkey, l_linenumber, p_brand FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def fn_vlookup_exact(spark, d):
    return lookup.vlookup(read(spark, d, "lineitem"), "l_partkey", read(spark, d, "part"), "p_partkey", ["p_brand"]).select("l_orderkey", "l_linenumber", "p_brand")


@register("SELECT o_orderkey, p_partkey FROM orders ASOF LEFT JOIN (SELECT p_retailprice * 100 AS k, min(p_partkey) AS p_partkey FROM part GROUP BY 1) ON o_totalprice >= k")
def fn_vlookup_approx(spark, d):
    keys = read(spark, d, "part").select((c("p_retailprice") * 100).alias("k"), "p_partkey")
    return lookup.vlookup(read(spark, d, "orders"), "o_totalprice", keys, "k", ["p_partkey"], approximate=True).select("o_orderkey", "p_partkey")


@register("SELECT e.event_id, e.user_id, l.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) l ON e.user_id = l.user_id AND e.ts >= l.ts WHERE e.event_type = 'click'")
def fn_asof_by(spark, d):
    events = read(spark, d, "events")
    buys = events.filter("event_type = 'purchase'").groupBy("user_id", c("ts").alias("k")).agg(F.max("event_id").alias("last_purchase"))
    return lookup.asof(events.filter("event_type = 'click'").select("event_id", "user_id", "ts"), "ts", buys, "k", ["last_purchase"], ["user_id"]).select("event_id", "user_id", "last_purchase")


@register("SELECT c_custkey, position FROM customer LEFT JOIN (SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_name) AS INTEGER) AS position FROM nation) ON c_nationkey = n_nationkey")
def fn_match(spark, d):
    places = read(spark, d, "nation").select("n_nationkey", F.row_number().over(Window.orderBy("n_name")).alias("p"))
    return lookup.match(read(spark, d, "customer"), "c_nationkey", places, "n_nationkey", "p").select("c_custkey", "position")


MATRIX = "SELECT vec_id AS i, unnest(range(0, len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"


def _vectors(spark, d) -> DataFrame:
    return read(spark, d, "embeddings").select(c("vec_id").alias("i"), F.posexplode("embedding").alias("k", "v")).withColumn("v", c("v").cast("double"))


@register(f"WITH a AS ({MATRIX}) SELECT i, j, round(sum(v * ((k * (j + 3)) % 7 - 3)), 6) AS v FROM a, range(0, 4) t(j) GROUP BY i, j")
def fn_mmult(spark, d):
    """All vectors, as rows of a matrix, by one of four columns."""
    a = _vectors(spark, d)
    b = a.select("k").distinct().withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("v", (c("k") * (c("j") + 3) % 7 - 3).cast("double"))
    return matrix.multiply(a, b).withColumn("v", r("v", 6))


@register(f'WITH a AS ({MATRIX}) SELECT CAST(k AS INTEGER) AS "row", i AS col, v FROM a')
def fn_transpose(spark, d):
    return matrix.transpose(_vectors(spark, d).select(c("i").alias("row"), c("k").alias("col"), "v"))


# Ranks and windows.


@register("SELECT l_orderkey, l_linenumber, CAST(rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC) AS INTEGER) AS k FROM lineitem")
def fn_rank(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", FUNCTIONS["rank"].build(c("l_extendedprice"), by=["l_returnflag"]).alias("k"))


@register("SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice), 8) AS p FROM part")
def fn_percentrank(spark, d):
    return read(spark, d, "part").select("p_partkey", r(FUNCTIONS["percentrank"].build(c("p_retailprice"), by=["p_brand"]), 8).alias("p"))


@register("SELECT c_nationkey, c_acctbal AS third FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS k FROM customer) WHERE k = 3")
def fn_large_small(spark, d):
    ranked = read(spark, d, "customer").withColumn("k", FUNCTIONS["large"].build(c("c_acctbal"), by=["c_nationkey"]))
    return ranked.filter("k = 3").select("c_nationkey", c("c_acctbal").alias("third"))


@register("SELECT l_returnflag, round(avg(l_quantity), 6) AS trimmean FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE k > floor(n * 0.1) AND k <= n - floor(n * 0.1) GROUP BY l_returnflag")
def fn_trimmean(spark, d):
    return formula.trimmean(read(spark, d, "lineitem"), "l_quantity", 0.2, ["l_returnflag"], "l_orderkey").withColumn("trimmean", r("trimmean", 6))


@register("SELECT l_returnflag, round(avg(abs(l_quantity - m)), 6) AS avedev FROM lineitem JOIN (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY l_returnflag) USING (l_returnflag) GROUP BY l_returnflag")
def fn_avedev(spark, d):
    return formula.avedev(read(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]).withColumn("avedev", r("avedev", 6))


@register("SELECT CAST(least(6, greatest(0, floor((l_quantity - 0) / 10) + 1)) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def fn_frequency(spark, d):
    return read(spark, d, "lineitem").groupBy(FUNCTIONS["frequency"].build(c("l_quantity"), 0, 50, 5).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT o_orderkey, o_orderstatus, round(regr_intercept(o_totalprice, o_custkey) OVER (PARTITION BY o_orderstatus) + regr_slope(o_totalprice, o_custkey) OVER (PARTITION BY o_orderstatus) * o_custkey, 2) AS t FROM orders")
def fn_trend(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_orderstatus", r(FUNCTIONS["trend"].build(c("o_totalprice"), c("o_custkey"), by=["o_orderstatus"]), 2).alias("t"))


@register("""SELECT o_orderkey, round(-o_totalprice * 0.01 / (1 - power(1.01, -24)), 4) AS pmt, round(-o_totalprice * power(1.02, 10), 2) AS fv, round(-100 * (1 - power(1.05, -12)) / 0.05, 6) AS pv, round((o_totalprice - 100) / 5, 4) AS sln, round((o_totalprice - 100) * (5 - 2 + 1) * 2 / 30, 4) AS syd,
round(power(1 + 0.12 / 12, 12) - 1, 8) AS eff, round(12 * (power(1.12, 1.0 / 12) - 1), 8) AS nom, round(ln((100 + 0) / (100 + o_totalprice * 0.0001)) / ln(1.0001), 2) AS nper FROM orders""")
def fn_financial(spark, d):
    made = {
        "pmt": "ROUND(PMT(0.01; 24; [o_totalprice]); 4)", "fv": "ROUND(FV(0.02; 10; 0; [o_totalprice]); 2)", "pv": "ROUND(PV(0.05; 12; 100); 6)", "sln": "ROUND(SLN([o_totalprice]; 100; 5); 4)", "syd": "ROUND(SYD([o_totalprice]; 100; 5; 2); 4)",
        "eff": "ROUND(EFFECTIVE(0.12; 12); 8)", "nom": "ROUND(NOMINAL(0.12; 12); 8)", "nper": "ROUND(NPER(0.0001; 100; [o_totalprice]); 2)",
    }
    return read(spark, d, "orders").select("o_orderkey", *(compile_text(t).alias(k) for k, t in made.items()))


@register()
def fn_statistical(spark, d):
    made = {"norm": "NORMDIST([l_quantity]; 25; 10; 1)", "inv": "NORMSINV([l_quantity] / 60)", "t": "TDIST([l_quantity] / 10; 9; 2)", "chi": "CHIDIST([l_quantity]; 20)", "f": "FDIST([l_quantity] / 10; 4; 9)", "gamma": "GAMMADIST([l_quantity]; 3; 8; 1)", "beta": "BETADIST([l_quantity] / 60; 2; 3)", "binom": "BINOMDIST(5; 20; [l_quantity] / 60; 1)", "poisson": "POISSON(10; [l_quantity]; 0)"}
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(F.round(compile_text(t), 6).alias(k) for k, t in made.items()))


# Dates, names, numbers.


@register("SELECT o_orderkey, DATE '1899-12-30' + CAST(floor(o_totalprice / 10) AS INTEGER) AS day FROM orders")
def serial_to_date(spark, d):
    return read(spark, d, "orders").select("o_orderkey", numbering.serial_to_date(c("o_totalprice") / 10).alias("day"))


@register("SELECT o_orderkey, CASE WHEN s <= 0 THEN DATE '1900-01-01' + CAST(trunc(s - 2.6) AS INTEGER) ELSE DATE '1900-01-01' + CAST(trunc(s - 1.6) AS INTEGER) END AS day FROM (SELECT o_orderkey, o_orderkey / 8.0 - 3 AS s FROM orders)")
def serial_to_date_strict(spark, d):
    return read(spark, d, "orders").select("o_orderkey", numbering.serial_to_date(c("o_orderkey") / 8.0 - 3, strict=True).alias("day"))


@register("SELECT o_orderkey, datediff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS serial FROM orders")
def date_to_serial(spark, d):
    return read(spark, d, "orders").select("o_orderkey", numbering.date_to_serial(c("o_orderdate")).alias("serial"))


@register("SELECT l_orderkey, l_linenumber, CAST(floor(l_discount * 86400 + 0.5) AS INTEGER) AS seconds FROM lineitem")
def serial_to_time(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbering.serial_to_time(c("l_discount")).alias("seconds"))


@register("""SELECT p_partkey, CASE WHEN k < 26 THEN chr(CAST(65 + k AS INTEGER)) ELSE chr(CAST(64 + k // 26 AS INTEGER)) || chr(CAST(65 + k % 26 AS INTEGER)) END || CAST(p_partkey + 1 AS VARCHAR) AS name FROM (SELECT p_partkey, p_partkey % 702 AS k FROM part)""")
def a1_names(spark, d):
    return read(spark, d, "part").select("p_partkey", numbering.a1_name(c("p_partkey") % 702, c("p_partkey")).alias("name"))


@register("""SELECT p_partkey, (['', 'M', 'MM', 'MMM'])[n // 1000 + 1] || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[n // 100 % 10 + 1] || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[n // 10 % 10 + 1] || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[n % 10 + 1] AS roman,
CASE WHEN n > 702 THEN chr(CAST(64 + (n - 703) // 676 + 1 AS INTEGER)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + ((n - 1) // 26 - 1) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) AS alpha, CAST(n AS INTEGER) AS back
FROM (SELECT p_partkey, p_partkey % 3999 + 1 AS n FROM part)""")
def roman_alpha(spark, d):
    n = (c("p_partkey") % 3999 + 1).cast("int")
    return read(spark, d, "part").select("p_partkey", numbering.roman(n).alias("roman"), numbering.alphabetic(n).alias("alpha"), numbering.from_roman(numbering.roman(n)).alias("back"))


@register("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS day, printf('%.2f', o_totalprice) AS price FROM orders")
def format_text(spark, d):
    return read(spark, d, "orders").select("o_orderkey", formats.formatted(c("o_orderdate"), "DD.MM.YYYY").alias("day"), formats.formatted(c("o_totalprice"), "0.00").alias("price"))


@register("SELECT p_partkey, CASE WHEN k BETWEEN 1 AND 4 THEN 'decimal' WHEN k BETWEEN 10 AND 11 THEN 'percent' WHEN k BETWEEN 20 AND 23 THEN 'currency' WHEN k BETWEEN 30 AND 36 THEN 'date' WHEN k BETWEEN 40 AND 45 THEN 'time' WHEN k = 50 THEN 'datetime' WHEN k = 0 THEN 'general' ELSE 'number' END AS kind FROM (SELECT p_partkey, p_size AS k FROM part)")
def format_kinds(spark, d):
    return read(spark, d, "part").select("p_partkey", formats.value_type(c("p_size")).alias("kind"))


# Cells, runs, styles.


@register("SELECT n_nationkey, name, value FROM (UNPIVOT (SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation) ON n_name, n_regionkey INTO NAME name VALUE value)")
def cells_unpivot(spark, d):
    return ranges.unpivot(read(spark, d, "nation"), ["n_nationkey"], ["n_name", "n_regionkey"])


@register('SELECT 0 AS sheet_id, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS "row", CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation')
def cells_to_wide(spark, d):
    cells = ranges.to_cells(read(spark, d, "nation"), ["n_nationkey"])
    return ranges.to_wide(cells, {0: "n_nationkey", 1: "n_name", 2: "n_regionkey"})


@register('SELECT 0 AS sheet_id, k AS "row", 1 AS col, n_name AS text FROM (SELECT n_name, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS k FROM nation) WHERE k BETWEEN 3 AND 8')
def range_cells(spark, d):
    return ranges.cells_in(ranges.to_cells(read(spark, d, "nation"), ["n_nationkey"]), 1, 3, 1, 8).select("sheet_id", "row", "col", "text")


@register("""SELECT user_id, min(event_id) AS first, max(event_id) AS last, any_value(event_type) AS value, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, run""")
def style_runs(spark, d):
    return ranges.runs(read(spark, d, "events"), ["user_id"], ["event_id"], c("event_type")).drop("run")


@register("""WITH e AS (SELECT o_custkey, o_orderkey AS pos FROM orders UNION SELECT o_custkey, o_orderkey + 100 FROM orders) SELECT o_custkey, pos AS row_lo, nxt - 1 AS row_hi FROM (SELECT o_custkey, pos, lead(pos) OVER (PARTITION BY o_custkey ORDER BY pos) AS nxt FROM e) WHERE nxt IS NOT NULL""")
def row_blocks(spark, d):
    bounds = read(spark, d, "orders").select("o_custkey", "o_orderkey", (c("o_orderkey") + 99).alias("hi"))
    return ranges.row_blocks(bounds, ["o_custkey"], "o_orderkey", "hi")


@register("""WITH RECURSIVE s AS (SELECT p_partkey AS name, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part), t AS (SELECT name, name AS anc, 0 AS level FROM s UNION ALL SELECT t.name, s.parent, t.level + 1 FROM t JOIN s ON t.anc = s.name WHERE s.parent IS NOT NULL),
i AS (SELECT p_partkey AS name, p_brand AS item, p_type AS value FROM part) SELECT name, item, min_by(value, level) AS value, min(level) AS level FROM t JOIN i ON t.anc = i.name GROUP BY t.name, item""".replace("SELECT name, item, min_by", "SELECT t.name, item, min_by"))
def style_inheritance(spark, d):
    part = read(spark, d, "part")
    styles = part.select(c("p_partkey").alias("name"), F.when(c("p_partkey") > 1, F.floor(c("p_partkey") / 2)).alias("parent"))
    items = part.select(c("p_partkey").alias("name"), c("p_brand").alias("item"), c("p_type").alias("value"))
    return ranges.inherited(styles, items)


# Text documents.


@register("""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS paragraphs, len(regexp_extract_all(text, '[^ \t\n\r]+')) AS words, length(text) AS chars FROM documents""")
def doc_stats(spark, d):
    return text.statistics(read(spark, d, "documents"), ids=["doc_id"])


@register("""SELECT doc_id, CAST(b AS INTEGER) AS "begin", CAST(e AS INTEGER) AS "end", CASE WHEN b >= 10 AND e <= 50 AND b >= 30 AND e <= 80 THEN 'bold,italic' WHEN b >= 10 AND e <= 50 THEN 'bold' WHEN b >= 30 AND e <= 80 THEN 'italic' ELSE '' END AS attributes
FROM (SELECT doc_id, pos AS b, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM (SELECT DISTINCT doc_id, unnest([0, least(10, n), least(30, n), least(50, n), least(80, n), n]) AS pos FROM (SELECT doc_id, length(text) AS n FROM documents))) WHERE e IS NOT NULL""")
def attr_ranges(spark, d):
    texts = read(spark, d, "documents").select("doc_id", "text")
    mark = lambda begin, end, name: F.struct(F.lit(begin).alias("begin"), F.least(F.lit(end), F.char_length("text")).alias("end"), F.lit(name).alias("attribute"))
    marks = texts.select("doc_id", F.explode(F.array(mark(10, 50, "bold"), mark(30, 80, "italic"))).alias("m")).select("doc_id", "m.*").filter(c("begin") < c("end"))
    out = text.attributed(texts, marks, ["doc_id"])
    return out.select("doc_id", "begin", "end", F.array_join("attributes", ",").alias("attributes"))


@register("""SELECT conv_id, turn, CAST(a AS VARCHAR) || CASE WHEN role = 'user' THEN '' ELSE '.' || CAST(b AS VARCHAR) END AS label FROM (SELECT *, greatest(0, sum(CASE WHEN role = 'user' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, a ORDER BY turn)) AS b FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations))""")
def list_numbering(spark, d):
    rows = read(spark, d, "conversations").select("conv_id", "turn", "role", F.when(c("role") == "user", 0).otherwise(1).alias("level"))
    out = text.numbered(rows, ["conv_id"], "turn", "level", levels=2)
    return out.select("conv_id", "turn", text.label(c("label_numbers"), ["1", "1"]).alias("label"))


@register("SELECT conv_id, turn, 1 + sum(CASE WHEN length(text) > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS page FROM conversations")
def page_breaks(spark, d):
    return text.paged(read(spark, d, "conversations"), ["conv_id"], "turn", F.coalesce(F.char_length("text") > 400, F.lit(False))).select("conv_id", "turn", "page")


@register("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'asks' ELSE 'says' END AS text FROM conversations")
def field_expand_conditional(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", text.hidden_text(c("role") == "user", F.lit("asks|says")).alias("text"))


@register("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS chapter FROM conversations")
def field_chapter(spark, d):
    return text.chapter(read(spark, d, "conversations"), ["conv_id"], "turn", F.when(c("role") == "user", c("text"))).select("conv_id", "turn", "chapter")


@register("SELECT conv_id, turn, sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS sequence FROM conversations")
def field_sequence(spark, d):
    return text.sequence(read(spark, d, "conversations"), ["conv_id"], "turn", c("role") == "assistant").select("conv_id", "turn", "sequence")


# Sinks.


@register("""SELECT n_nationkey, '"' || CAST(n_nationkey AS VARCHAR) || '","' || n_name || '","' || CAST(n_regionkey AS VARCHAR) || '"' AS line FROM nation""")
def csv_wide(spark, d):
    return emit.csv_lines(read(spark, d, "nation"), ["n_nationkey"], ["n_nationkey", "n_name", "n_regionkey"])


@register("SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def plain_text(spark, d):
    return emit.plain_text(read(spark, d, "conversations"), ["conv_id"], "turn")


@register("""SELECT conv_id, '<html><body>' || chr(10) || string_agg('<p>' || replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</p>', chr(10) ORDER BY turn) || chr(10) || '</body></html>' AS html FROM conversations GROUP BY conv_id""")
def html_text(spark, d):
    return emit.html(read(spark, d, "conversations"), ["conv_id"], "turn")


@register("""WITH r AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, [CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR)] AS t FROM nation), k AS (SELECT *, unnest([0, 1, 2]) AS j FROM r),
m AS (SELECT 1 AS seq, 'startDocument()' AS line UNION ALL SELECT 2, '  openSheet()' UNION ALL SELECT 3 + 11 * i, '    openSheetRow()' FROM r UNION ALL SELECT 4 + 11 * i + 3 * j, '      openSheetCell(librevenge:column: ' || j || ', librevenge:row: ' || i || ')' FROM k
UNION ALL SELECT 5 + 11 * i + 3 * j, '        insertText(text: ' || t[j + 1] || ')' FROM k UNION ALL SELECT 6 + 11 * i + 3 * j, '      closeSheetCell()' FROM k UNION ALL SELECT 13 + 11 * i, '    closeSheetRow()' FROM r
UNION ALL SELECT 3 + 11 * count(*), '  closeSheet()' FROM r UNION ALL SELECT 4 + 11 * count(*), 'endDocument()' FROM r) SELECT 'nation' AS doc, CAST(seq AS INTEGER) AS seq, line FROM m""")
def event_trace(spark, d):
    cells = ranges.to_cells(read(spark, d, "nation"), ["n_nationkey"]).withColumn("doc_id", F.lit("nation"))
    return emit.trace_lines(emit.sheet_trace(cells))


@register("SELECT p_partkey, 'Numbering' || CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS VARCHAR) AS numbering_name FROM part")
def style_names(spark, d):
    return emit.numbering_names(read(spark, d, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "numbering_name")


# Bytes and markup.


@register("SELECT c_custkey, c_name || ' é' AS text FROM customer")
def charset_decode(spark, d):
    from tabulon.sources.charset import decoded

    data = F.encode(F.concat("c_name", F.lit(" é")), "UTF-8")
    return read(spark, d, "customer").select("c_custkey", decoded(data, F.lit(76)).alias("text"))


@register("SELECT c_custkey, c_name, TRUE AS changed FROM customer")
def cipher_roundtrip(spark, d):
    from tabulon.sources.cipher import enciphered

    once = enciphered(F.encode("c_name", "UTF-8"), F.lit("password"))
    rows = read(spark, d, "customer").select("c_custkey", F.col("c_name").alias("plain"), once.alias("once"))
    return rows.select("c_custkey", F.decode(enciphered("once", F.lit("password")), "UTF-8").alias("c_name"), (F.encode("plain", "UTF-8") != c("once")).alias("changed"))


@register("""SELECT p_partkey, '<math xmlns="http://www.w3.org/1998/Math/MathML"><mfrac><mn>' || CAST(p_size AS VARCHAR) || '</mn><msqrt><mn>' || CAST(p_partkey AS VARCHAR) || '</mn></msqrt></mfrac></math>' AS mathml FROM part""")
def math_markup(spark, d):
    from tabulon.functions.markup import to_mathml

    return read(spark, d, "part").select("p_partkey", to_mathml(F.concat(c("p_size").cast("string"), F.lit(" over sqrt "), c("p_partkey").cast("string"))).alias("mathml"))


@register("""SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]+', '@', 'g') AS simple FROM documents""")
def simplified_text(spark, d):
    return read(spark, d, "documents").select("doc_id", numbering.simplified(c("text")).alias("simple"))


@register("SELECT p_partkey, '#' || lpad(lower(to_hex((p_partkey * 7919) % 16777216)), 6, '0') AS colour, 1440 * p_size / 72.0 AS twips FROM part")
def colours_and_units(spark, d):
    return read(spark, d, "part").select("p_partkey", numbering.colour_text(c("p_partkey") * 7919 % 16777216).alias("colour"), numbering.scaled(c("p_size").cast("double"), "point", "twip").alias("twips"))


@register("SELECT p_partkey, gcd(p_size, 36) AS g, lcm(p_size, 12) AS l, p_size // 1 AS i, CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size + 1 END AS ev FROM part")
def fn_whole_numbers(spark, d):
    made = {"g": "GCD([p_size]; 36)", "l": "LCM([p_size]; 12)", "i": "INT([p_size])", "ev": "EVEN([p_size])"}
    return read(spark, d, "part").select("p_partkey", *(compile_text(t).cast("long").alias(k) for k, t in made.items()))


@register("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def running_totals(spark, d):
    """The batch form of the streamed subtotals."""
    from tabulon.streaming.ingest import running_totals as totals

    return totals(read(spark, d, "events"), "ts", ["event_type"], "value").select(c("window.start").alias("start"), "event_type", "n", r("total").alias("total"))


# Charts and names.


def _chart(spark, d) -> DataFrame:
    return read(spark, d, "orders").select(c("o_orderstatus").alias("series"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("ord"), c("o_totalprice").alias("value")).groupBy("series", "ord").agg(F.sum("value").alias("value"))


@register("""SELECT series, count(value) AS n, round(avg(value), 2) AS mean, round(regr_slope(value, ord + 1.0), 2) AS slope, round(avg(value) - stddev_pop(value), 2) AS low, round(avg(value) + stddev_pop(value), 2) AS high
FROM (SELECT o_orderstatus AS series, year(o_orderdate) * 12 + month(o_orderdate) AS ord, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2) GROUP BY series""")
def chart_statistics(spark, d):
    from tabulon.operators import charts

    return charts.statistics(_chart(spark, d), []).select("series", "n", *(r(k, 2).alias(k) for k in ("mean", "slope", "low", "high")))


@register("""SELECT series, ord, round(high - value, 2) AS low, round(high, 2) AS high FROM (SELECT *, sum(value) OVER (PARTITION BY ord ORDER BY series) AS high FROM (SELECT o_orderstatus AS series, year(o_orderdate) * 12 + month(o_orderdate) AS ord, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2))""")
def chart_stacked(spark, d):
    from tabulon.operators import charts

    return charts.stacked(_chart(spark, d), []).select("series", "ord", r("low", 2).alias("low"), r("high", 2).alias("high"))


@register('SELECT n_nationkey * 2 + n_regionkey AS "more" FROM nation')
def named_formula(spark, d):
    from tabulon.operators.names import Workbook

    book = Workbook(read(spark, d, "nation"), formulas={"twice": "[n_nationkey] * 2", "more": "[twice] + [n_regionkey]"})
    return book.cells.select(book.formula("more").alias("more"))


@register("SELECT p_partkey, CAST(p_partkey % 702 AS INTEGER) AS col, CAST(p_partkey AS INTEGER) AS row FROM part")
def a1_positions(spark, d):
    at = numbering.a1_position(numbering.a1_name(c("p_partkey") % 702, c("p_partkey"), True, True))
    return read(spark, d, "part").select("p_partkey", at.alias("at")).select("p_partkey", "at.col", "at.row")


@register("""SELECT c_custkey, sheet_name, '[' || COALESCE(sheet_name, '') || '.$' || CASE WHEN k < 26 THEN chr(CAST(65 + k AS INTEGER)) ELSE chr(CAST(64 + k // 26 AS INTEGER)) || chr(CAST(65 + k % 26 AS INTEGER)) END || CAST(c_custkey + 1 AS VARCHAR) || ']' AS ref
FROM (SELECT c_custkey, c_custkey % 702 AS k, CASE WHEN c_nationkey <> c_custkey % 25 THEN n_name END AS sheet_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)""")
def sheet_references(spark, d):
    sheets = read(spark, d, "nation").select(F.lit(0).alias("doc_id"), c("n_nationkey").alias("sheet_id"), c("n_name").alias("name"))
    given = read(spark, d, "customer").select("c_custkey", F.lit(0).alias("doc_id"), c("c_nationkey").alias("sheet_id"), (c("c_custkey") % 25).alias("own_sheet_id"))
    named = names.with_sheet_names(given, sheets)
    return named.select("c_custkey", "sheet_name", names.reference_text(c("c_custkey") % 702, c("c_custkey"), c("sheet_name"), True).alias("ref"))


@register("SELECT o_orderkey, CASE WHEN k % 25 < 24 THEN strftime(o_orderdate, '%Y-%m-%d') || printf('T%02d:%02d:%02d.%02d', k % 25, k % 60, k % 59, k % 100) END AS moment FROM (SELECT *, CAST(o_orderkey AS BIGINT) AS k FROM orders)")
def packed_moments(spark, d):
    k = c("o_orderkey")
    day, time = F.date_format("o_orderdate", "yyyyMMdd").cast("int"), k % 25 * 1000000 + k % 60 * 10000 + k % 59 * 100 + k % 100
    return read(spark, d, "orders").select("o_orderkey", numbering.packed_datetime(day, time).alias("moment"))


@register("SELECT o_orderkey, printf('%02d:%02d:%02d', k // 3600, k // 60 % 60, k % 60) AS time FROM (SELECT o_orderkey, CAST(o_orderkey % 86400 AS BIGINT) AS k FROM orders)")
def time_texts(spark, d):
    return read(spark, d, "orders").select("o_orderkey", numbering.time_text(c("o_orderkey") % 86400).alias("time"))


@register("SELECT doc_id, CASE WHEN strpos(text, ' ') > 0 THEN substr(text, 1, strpos(text, ' ') - 1) ELSE text END AS head, CASE WHEN strpos(text, ' ') > 0 THEN substr(text, strpos(text, ' ') + 1) ELSE '' END AS tail FROM documents")
def split_texts(spark, d):
    return read(spark, d, "documents").select("doc_id", numbering.split_first(c("text"), " ").alias("at")).select("doc_id", "at.head", "at.tail")


@register("SELECT doc_id, regexp_replace(text || chr(7) || chr(9) || chr(31) || '.', '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS text FROM documents")
def printable_texts(spark, d):
    return read(spark, d, "documents").select("doc_id", numbering.printable(F.concat("text", F.lit("\x07\t\x1f."))).alias("text"))


@register("SELECT c_custkey, CAST(i AS INTEGER) AS at, CAST(CASE WHEN i < c_custkey % 4 THEN c_nationkey ELSE c_custkey END AS INTEGER) AS value FROM (SELECT *, unnest(range(CAST(c_custkey % 4 + 2 AS BIGINT))) AS i FROM customer)")
def run_sizes(spark, d):
    run = lambda times, value: F.struct(times.cast("int").alias("times"), value.cast("int").alias("value"))
    given = read(spark, d, "customer").withColumn("runs", F.array(run(c("c_custkey") % 4, c("c_nationkey")), run(F.lit(2), c("c_custkey"))))
    return ranges.runs_to_rows(given, "runs", ["c_custkey"])


@register("""SELECT COALESCE(l_orderkey, o_orderkey) AS row, COALESCE(l_linenumber, col) AS col, l_quantity AS value, o_orderpriority AS style
FROM (SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, l_quantity FROM lineitem) FULL OUTER JOIN (SELECT o_orderkey, o_orderpriority, CAST(unnest(range(2, CAST(3 + o_orderkey % 4 AS BIGINT))) AS INTEGER) AS col FROM orders) ON l_orderkey = o_orderkey AND l_linenumber = col""")
def style_cells(spark, d):
    styles = read(spark, d, "orders").select(c("o_orderkey").alias("row"), F.lit(2).alias("c0"), (2 + c("o_orderkey") % 4).cast("int").alias("c1"), c("o_orderpriority").alias("style"))
    cells = read(spark, d, "lineitem").select(c("l_orderkey").alias("row"), c("l_linenumber").cast("int").alias("col"), c("l_quantity").alias("value"))
    return ranges.merged_runs(styles, cells, ["row"]).select("row", "col", "value", "style")


@register("SELECT c_custkey, c_nationkey AS n_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def linked_cells(spark, d):
    cells = read(spark, d, "customer").select("c_custkey", c("c_nationkey").alias("n_nationkey"))
    return names.linked(cells, read(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"])


@register('SELECT n_nationkey AS "Key", n_name AS "Country" FROM nation')
def label_ranges(spark, d):
    return names.labelled(read(spark, d, "nation").select("n_nationkey", "n_name"), {"n_nationkey": "Key", "n_name": "Country"})


@register("SELECT c_custkey, c_acctbal > 0 AS visible, c_custkey % 2 = 0 AS scenario FROM customer WHERE c_acctbal > 0 AND c_custkey % 2 = 0")
def sheet_flags(spark, d):
    sheets = read(spark, d, "customer").select("c_custkey", (c("c_acctbal") > 0).alias("visible"), (c("c_custkey") % 2 == 0).alias("scenario"))
    return names.sheet_attributes(sheets, scenario=True)
