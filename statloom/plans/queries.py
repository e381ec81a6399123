"""Queries over the test tables, one or more for each family of operators, with the same rows as DuckDB SQL where SQL can give them.

Doubles are rounded on both sides, since sums depend on the order of their terms in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions import scalars
from statloom.functions.dist import t_quantile
from statloom.operators import bivariate, charts, columns, contours, doe, encode, mlr, monitor, multi, ordered, pareto, pca, rows, select, surface, univariate, validation, writeback
from statloom.operators.missing import filled_report, reconstructed
from statloom.plans.shared import SharedWorkspace
from statloom.settled import shared_folder
from statloom.sources.readers import parse_clipboard
from statloom.sources import reports
from statloom.sources.writers import spectral_lines
from statloom.streaming.monitoring import fault_counts

V = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(f.name, digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType | T.FloatType) else F.col(f.name) for f in df.schema.fields])


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def union(parts: list[str]) -> str:
    return " union all ".join(parts)


# E: descriptive statistics


@query("e_group_statistics", f"""
select l_returnflag, count(l_extendedprice)::bigint as count, {r('avg(l_extendedprice)', 4)} as mean, {r('median(l_extendedprice)', 4)} as median, {r('stddev_samp(l_extendedprice)', 4)} as std,
  {r('min(l_extendedprice)', 4)} as min, {r('max(l_extendedprice)', 4)} as max, {r('quantile_cont(l_extendedprice, 0.25)', 4)} as q1, {r('quantile_cont(l_extendedprice, 0.75)', 4)} as q3,
  {r('quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)', 4)} as iqr
from lineitem where l_returnflag is not null group by 1""")
def _(spark, d):
    return rounded(univariate.by_category(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"), 4)


@query("e_summary", union([f"""select '{c}' as variable, {r(f'avg({c})', 2)} as mean, {r(f'case when min({c}) > 0 then exp(avg(ln(nullif(greatest({c}, 0), 0)))) end', 2)} as geometric_mean, {r(f'median({c})', 2)} as median, count({c})::bigint as n,
  count_if({c} is null)::bigint as n_missing, {r(f'stddev_samp({c})', 2)} as std, {r(f'var_samp({c})', 2)} as variance, {r(f'stddev_samp({c}) / nullif(abs(avg({c})), 0) * 100', 2)} as rsd, {r(f'min({c})', 2)} as min, {r(f'max({c})', 2)} as max, {r(f'max({c}) - min({c})', 2)} as range from lineitem""" for c in V]))
def _(spark, d):
    return rounded(univariate.summary(table(spark, d, "lineitem"), V), 2)


@query("e_robust", union([f"""select '{c}' as variable, {r('q3 - q1', 4)} as iqr, {r('mad', 4)} as mad, {r('mad / nullif(abs(m), 0) * 100', 4)} as robust_cv, {r('q1', 4)} as q1, {r('q3', 4)} as q3, {r('m', 4)} as median
  from (select median({c}) as m, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3, (select median(abs({c} - (select median({c}) from lineitem))) from lineitem) as mad from lineitem)""" for c in V]))
def _(spark, d):
    return rounded(univariate.robust(table(spark, d, "lineitem"), V), 4)


@query("e_batch_statistics", f"""select o_orderpriority, count(*)::bigint as n_samples, {r('avg(o_totalprice)', 3)} as o_totalprice_mean, {r('stddev_samp(o_totalprice)', 3)} as o_totalprice_std, count(o_totalprice)::bigint as o_totalprice_n
from orders where o_orderpriority is not null group by 1""")
def _(spark, d):
    return rounded(univariate.by_batch(table(spark, d, "orders"), "o_orderpriority", ["o_totalprice"]), 3)


def _profile_sql(where: str, extra: str = "") -> str:
    return union([f"""select '{c}' as variable, {r(f'avg({c})', 3)} as mean, {r(f'stddev_samp({c})', 3)} as std, {r(f'min({c})', 3)} as min, {r(f'max({c})', 3)} as max, {r(f'quantile_cont({c}, 0.25)', 3)} as q1, {r(f'median({c})', 3)} as median, {r(f'quantile_cont({c}, 0.75)', 3)} as q3 from lineitem {where}""" for c in V])


@query("e_batch_profile", _profile_sql("where l_returnflag = 'A'"))
def _(spark, d):
    return rounded(univariate.batch_profile(table(spark, d, "lineitem"), "l_returnflag", "A", V), 3)


_CELLS = union([f"select '{c}' as variable, {c} as value from lineitem" for c in V])


@query("e_grand", f"select {r('avg(value)', 4)} as mean, {r('median(value)', 4)} as median, {r('stddev_pop(value)', 4)} as std, {r('min(value)', 4)} as min, {r('max(value)', 4)} as max from ({_CELLS})")
def _(spark, d):
    return rounded(univariate.grand(table(spark, d, "lineitem"), V), 4)


@query("e_describe", f"""select variable, count(value)::bigint as count, {r('avg(value)', 4)} as mean, {r('stddev_samp(value)', 4)} as std, {r('min(value)', 4)} as min, {r('quantile_cont(value, 0.25)', 4)} as p25,
  {r('quantile_cont(value, 0.5)', 4)} as p50, {r('quantile_cont(value, 0.75)', 4)} as p75, {r('max(value)', 4)} as max from ({_CELLS}) group by 1""")
def _(spark, d):
    return rounded(univariate.describe(table(spark, d, "lineitem"), V), 4)


@query("e_value_counts", "select p_brand, count(*)::bigint as count from part where p_brand is not null group by 1 order by 2 desc, 1 limit 10")
def _(spark, d):
    return univariate.value_counts(table(spark, d, "part"), "p_brand")


@query("e_missing", f"select (count_if(v is null) + count_if(p_size is null))::bigint as n_missing, (count(*) * 2)::bigint as n_total, {r('(count_if(v is null) + count_if(p_size is null)) * 100.0::double / (count(*) * 2)')} as percent from (select case when p_size > 5 then p_retailprice end as v, p_size from part)")
def _(spark, d):
    return rounded(univariate.missing(table(spark, d, "part").selectExpr("case when p_size > 5 then p_retailprice end as v", "p_size"), ["v", "p_size"]))


@query("e_row_profile", f"""select row_id, {r('list_avg(v)')} as mean, {r('list_min(v)')} as min, {r('list_max(v)')} as max, {r('list_stddev_samp(v)')} as std, {r('list_max(v) - list_min(v)')} as range, 0::bigint as n_missing
from (select l_orderkey * 10 + l_linenumber as row_id, [{', '.join(V)}] as v from lineitem)""")
def _(spark, d):
    return rounded(univariate.row_profile(table(spark, d, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "row_id", V))


@query("e_column_kinds", union([f"""select '{c}' as "column", count({c})::bigint as n, count(try_cast({c} as double))::bigint as n_numeric, count(distinct {c})::bigint as levels,
  case when count(try_cast({c} as double)) = count({c}) then 'numeric' when count(distinct {c}) = 2 then 'binary_cat' else 'multiclass_cat' end as kind,
  count(try_cast({c} as double)) = 0 or count(try_cast({c} as double)) < count({c}) * 0.5 or count(distinct try_cast({c} as double)) / count({c}) < 0.05 as categorical from part""" for c in ("p_brand", "p_type", "p_size", "p_partkey")]))
def _(spark, d):
    return univariate.column_kinds(table(spark, d, "part"), ["p_brand", "p_type", "p_size", "p_partkey"])


@query("e_rollup", f"select l_returnflag, l_linestatus, count(*)::bigint as n, {r('avg(l_quantity)')} as mean from lineitem group by rollup (l_returnflag, l_linestatus)")
def _(spark, d):
    return rounded(table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean")))


# C, D, G, H: choosing and joining rows


@query("c_row_range", "select * exclude (n) from (select o_orderkey, o_totalprice, row_number() over (order by o_orderkey) as n from orders) where n between 11 and 500")
def _(spark, d):
    return select.row_range(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 11, 500)


@query("c_row_list", "select * exclude (n) from (select o_orderkey, o_orderstatus, row_number() over (order by o_orderkey) as n from orders) where n in (1, 3, 4, 5, 40)")
def _(spark, d):
    return select.row_list(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "1,3-5,40")


@query("c_column_range", "select p_size, p_retailprice from part")
def _(spark, d):
    return select.column_range(table(spark, d, "part"), 3, 6)


@query("c_constraints", "select p_partkey, p_size, p_retailprice from part where p_size * 20 < p_retailprice and p_size between 5 and 40")
def _(spark, d):
    return select.constrained(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size * 20 < p_retailprice", "p_size between 5 and 40"])


@query("c_selection_difference", f"""with s as (select *, p_size > 25 as chosen from part) select v as variable, {r('a', 4)} as selected_mean, {r('b', 4)} as rest_mean, {r('a - b', 4)} as difference from (
  select 'p_size' as v, avg(p_size) filter (chosen) as a, avg(p_size) filter (not chosen) as b from s union all select 'p_retailprice', avg(p_retailprice) filter (chosen), avg(p_retailprice) filter (not chosen) from s)""")
def _(spark, d):
    part = table(spark, d, "part")
    return rounded(select.mean_differences(*select.split(part, "p_partkey", part.where("p_size > 25")), ["p_size", "p_retailprice"]), 4)


@query("c_transpose", "select 'n_regionkey' as variable, " + ", ".join(f'max(n_regionkey::double) filter (n_nationkey = {i}) as "{i}"' for i in range(25)) + " from nation")
def _(spark, d):
    return select.transposed(table(spark, d, "nation"), "n_nationkey", ["n_regionkey"])


@query("d_label_alignment", "select o_orderkey, coalesce(c_mktsegment, 'Unknown') as segment from orders left join customer on o_custkey = c_custkey and c_acctbal > 0")
def _(spark, d):
    labels = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, d, "orders").join(labels, "o_custkey", "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("Unknown")).alias("segment"))


@query("g_correlation_ranking", union([f"select '{a}' as v1, '{b}' as v2, {r(f'corr({a}, {b})')} as r, count(*)::bigint as n from lineitem" for i, a in enumerate(V) for b in V[i + 1 :]]))
def _(spark, d):
    return rounded(bivariate.correlation_summary(bivariate.pearson(table(spark, d, "lineitem"), V)).select("v1", "v2", "r", "n"))


@query("g_one_against_rest", union([f"select '{v}' as variable, {r(f'corr(l_quantity, {v})')} as r from lineitem" for v in V[1:]]))
def _(spark, d):
    return rounded(bivariate.one_against_rest(table(spark, d, "lineitem"), "l_quantity", V))


@query("g_top_by_group", "select p_brand, p_partkey, p_retailprice, rank::int as rank from (select p_brand, p_partkey, p_retailprice, row_number() over (partition by p_brand order by abs(p_retailprice) desc, p_partkey) as rank from part) where rank <= 3")
def _(spark, d):
    return select.top_by_magnitude(table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice"), "p_retailprice", 3, ["p_brand"], "p_partkey")


@query("h_union_difference", "select p_partkey, 'small' as part_of from part where p_size <= 10 union all select p_partkey, 'rest' from part where p_size > 10")
def _(spark, d):
    part = table(spark, d, "part")
    a, b = select.split(part, "p_partkey", part.where("p_size <= 10"))
    return a.select("p_partkey", F.lit("small").alias("part_of")).unionByName(b.select("p_partkey", F.lit("rest").alias("part_of")))


# F: operators along the row order


@query("f_first_derivative", f"select event_id, {r('value - lag(value) over (order by event_id)')} as value from events qualify row_number() over (order by event_id) > 1")
def _(spark, d):
    return rounded(ordered.differences(table(spark, d, "events").select("event_id", "value"), "event_id", ["value"]))


@query("f_second_derivative", f"select event_id, {r('value - 2 * lag(value) over (order by event_id) + lag(value, 2) over (order by event_id)')} as value from events qualify row_number() over (order by event_id) > 2")
def _(spark, d):
    return rounded(ordered.differences(table(spark, d, "events").select("event_id", "value"), "event_id", ["value"], 2))


@query("f_moving_average", f"select event_id, {r('avg(value) over w')} as value from events window w as (order by event_id rows between 2 preceding and 2 following) qualify count(value) over w = 5")
def _(spark, d):
    return rounded(ordered.moving_average(table(spark, d, "events").select("event_id", "value"), "event_id", ["value"], 5))


@query("f_moving_average_by_user", f"select event_id, user_id, {r('avg(value) over w')} as value from events window w as (partition by user_id order by event_id rows between 2 preceding and 1 following) qualify count(value) over w = 4")
def _(spark, d):
    return rounded(ordered.moving_average(table(spark, d, "events").select("event_id", "user_id", "value"), "event_id", ["value"], 4, ["user_id"]))


@query("f_segments", """with e as (select event_id, event_type, case when lag(event_type) over (order by event_id) is not distinct from event_type and row_number() over (order by event_id) > 1 then 0 else 1 end as n from events),
g as (select *, sum(n) over (order by event_id) as segment from e)
select segment::bigint as segment, any_value(event_type) as category, min(event_id) as first, max(event_id) as last, count(*)::bigint as n from g group by segment""")
def _(spark, d):
    return ordered.segments(table(spark, d, "events"), "event_id", "event_type")


@query("f_running_sum", f"select event_id, {r('sum(value) over (order by event_id)', 3)} as total from events")
def _(spark, d):
    return rounded(ordered.running_sum(table(spark, d, "events").select("event_id", "value"), "event_id", "value", "total").select("event_id", "total"), 3)


@query("f_trajectory", "select event_id, user_id, value as x, user_id::double as y, lead(value) over w as x_next, lead(user_id::double) over w as y_next from events window w as (partition by user_id order by event_id) qualify lead(1) over w is not null")
def _(spark, d):
    return ordered.trajectory(table(spark, d, "events").select("event_id", "user_id", "value", F.col("user_id").cast("double").alias("u")), "event_id", "value", "u", ["user_id"])


# I: scalars


@query("i_scalars", f"""select p_partkey, try_cast(p_brand as double) as as_number, translate(p_brand, '0123456789', '₀₁₂₃₄₅₆₇₈₉') as sub, case when p_size <= 0.001 then '***' when p_size <= 0.01 then '**' when p_size <= 0.05 then '*' else '' end as star,
  concat_ws('-', p_brand, p_type) as items, {r('(p_size - 25.5) / 24.5')} as coded from part""")
def _(spark, d):
    return rounded(table(spark, d, "part").select(
        "p_partkey", scalars.to_number("p_brand").alias("as_number"), scalars.subscript(F.col("p_brand")).alias("sub"), scalars.stars(F.col("p_size")).alias("star"), scalars.join_items(F.array("p_brand", "p_type"), "-").alias("items"), columns.code_value(F.col("p_size"), 1.0, 50.0).alias("coded")
    ))


# J: column transforms

_JX = {"p_size": "p_size::double", "p_retailprice": "p_retailprice"}
_J = {
    "centering": "x - avg(x) over ()", "scaling": "x / nullif(stddev_samp(x) over (), 0)", "autoscale": "(x - avg(x) over ()) / nullif(stddev_samp(x) over (), 0)", "range_01": "(x - min(x) over ()) / nullif(max(x) over () - min(x) over (), 0)",
    "range_11": "2 * (x - min(x) over ()) / nullif(max(x) over () - min(x) over (), 0) - 1", "max_100": "x / nullif(max(x) over (), 0) * 100", "sum_100": "x / nullif(sum(x) over (), 0) * 100", "length_1": "x / nullif(sqrt(sum(x * x) over ()), 0)",
    "log": "log10(x + (select case when least(min(p_size), min(p_retailprice)) <= 0 then abs(least(min(p_size), min(p_retailprice))) + 1 else 0 end from part))",
}


def _column_transform(name: str):
    sql = "select p_partkey, " + ", ".join(f"{r(_J[name].replace('(x', f'({e}').replace('x ', f'{e} ').replace('* x', f'* {e}').replace('x)', f'{e})'))} as {c}" for c, e in _JX.items()) + " from part"

    @query(f"j_{name}", sql)
    def _(spark, d):
        return rounded(columns.TRANSFORMS[name](table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]))


for _name in _J:
    _column_transform(_name)


@query("j_block_scaling", f"select p_partkey, {r('(p_size - avg(p_size) over ()) / stddev_samp(p_size) over () / sqrt(2)')} as p_size, {r('(p_retailprice - avg(p_retailprice) over ()) / stddev_samp(p_retailprice) over () / sqrt(2)')} as p_retailprice from part")
def _(spark, d):
    return rounded(columns.block_scaled(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), {"all": ["p_size", "p_retailprice"]}))


# K: row transforms

_K = {
    "snv": ("list_transform(a, lambda x: (x - list_avg(a)) / nullif(list_stddev_samp(a), 0))", rows.snv),
    "first_derivative": ("list_transform(range(2, len(a) + 1), lambda i: a[i] - a[i - 1])", rows.first_derivative),
    "second_derivative": ("list_transform(range(3, len(a) + 1), lambda i: a[i] - a[i - 1] - (a[i - 1] - a[i - 2]))", rows.second_derivative),
    "moving_average": ("list_transform(range(1, len(a) - 3), lambda i: list_sum(a[i:i + 4]) / 5)", lambda a: rows.moving_average(a, 5)),
    "sum_100": ("list_transform(a, lambda x: x / nullif(list_sum(a), 0) * 100)", rows.sum_100),
    "binning": ("list_transform(range(0, len(a) // 4), lambda i: list_avg(a[i * 4 + 1:i * 4 + 4]))", lambda a: rows.binned(a, 4)),
}


def _row_transform(name: str, sql: str, f, digits: int = 4) -> None:
    @query(f"k_{name}", f"select vec_id, (unnest(range(1, len(v) + 1)) - 1)::int as position, round(unnest(v), {digits}) + 0.0 as value from (select vec_id, {sql} as v from (select vec_id, list_transform(embedding, lambda x: x::double) as a from embeddings))")
    def _(spark, d):
        made = table(spark, d, "embeddings").select("vec_id", f(F.col("embedding").cast("array<double>")).alias("v"))
        return rounded(rows.profiles(made, "vec_id", "v"), digits)


for _name, (_sql, _f) in _K.items():
    _row_transform(_name, _sql, _f)


def _savgol_sql(p: int = 64, window: int = 7, degree: int = 2, deriv: int = 1) -> str:
    m = rows.savgol_matrix(p, window, degree, deriv)
    literal = "[" + ", ".join("[" + ", ".join(f"{w!r}::double" for w in map(float, line)) + "]" for line in m) + "]"
    return f"list_transform({literal}, lambda w: list_sum(list_transform(range(1, 65), lambda i: w[i] * a[i])))"


_row_transform("savitzky_golay", _savgol_sql(), lambda a: rows.savgol(a, 64, 7, 2, 1))


# L: encoding


@query("l_auto_encode", """with c as (select o_orderpriority as level, count(*) as n, min(o_orderkey) as f from orders group by 1), ref as (select level from c order by n desc, f, level limit 1)
select o_orderkey, 'o_orderpriority_' || level as dummy, (o_orderpriority = level)::int as value from orders, c where level <> (select level from ref)""")
def _(spark, d):
    made, how = encode.auto_encoded(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey")
    return made.unpivot(["o_orderkey"], [f"o_orderpriority_{n}" for n in how["o_orderpriority"]["levels"]], "dummy", "value")


@query("l_two_level", "select l_orderkey, l_linenumber, case l_linestatus when 'F' then -1.0::double when 'O' then 1.0::double end as l_linestatus from lineitem")
def _(spark, d):
    return encode.auto_encoded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus"), ["l_linestatus"])[0]


@query("l_design_coding", f"select p_partkey, {r('2.0 * (p_size - min(p_size) over ()) / (max(p_size) over () - min(p_size) over ()) - 1')} as p_size from part")
def _(spark, d):
    return rounded(encode.auto_encoded(table(spark, d, "part").select("p_partkey", "p_size"), ["p_size"], code_numeric=True)[0])


# M: bivariate


@query("m_covariance", union([f"select '{a}' as v1, '{b}' as v2, {r(f'covar_samp({a}, {b})', 3)} as covariance from lineitem" for a in V for b in V]))
def _(spark, d):
    return rounded(bivariate.covariance(table(spark, d, "lineitem"), V), 3)


_RANKS = ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in V)


@query("m_spearman", union([f"select '{a}' as v1, '{b}' as v2, {r(f'corr({a}, {b})')} as r, count(*)::bigint as n from (select {_RANKS} from lineitem)" for i, a in enumerate(V) for b in V[i + 1 :]]))
def _(spark, d):
    return rounded(bivariate.spearman(table(spark, d, "lineitem"), V).select("v1", "v2", "r", "n"))


@query("m_kendall", f"""with p as (select p_size as x, round(p_retailprice / 50) as y from part), s as (select sign(a.x - b.x) * sign(a.y - b.y) as s, a.x = b.x as tx, a.y = b.y as ty, a.x, b.x from p a, p b)
select 'p_size' as v1, 'y' as v2, {r('sum(s) / sqrt(count_if(not tx)::double) / sqrt(count_if(not ty)::double)')} as r, (select count(*) from part)::bigint as n from s""")
def _(spark, d):
    data = table(spark, d, "part").select("p_size", F.round(F.col("p_retailprice") / 50).alias("y"))
    return rounded(bivariate.kendall(data, ["p_size", "y"]).select("v1", "v2", "r", "n"))


@query("m_kendall_values", f"""with s as (select sign(a.p_size - b.p_size) * sign(a.p_retailprice - b.p_retailprice) as s, a.p_size = b.p_size as tx, a.p_retailprice = b.p_retailprice as ty from part a, part b)
select 'p_size' as v1, 'p_retailprice' as v2, {r('sum(s) / sqrt(count_if(not tx)::double) / sqrt(count_if(not ty)::double)')} as r, (select count(*) from part)::bigint as n from s""")
def _(spark, d):
    return rounded(bivariate.kendall(table(spark, d, "part"), ["p_size", "p_retailprice"]).select("v1", "v2", "r", "n"))


@query("m_convex_hulls")
def _(spark, d):
    return bivariate.convex_hulls(table(spark, d, "part"), "p_size", "p_retailprice", "p_brand")


# N, O, P: components, monitoring, reconstruction

_Z = "with s as (select avg(l_quantity) as m1, stddev_samp(l_quantity) as s1, avg(l_extendedprice) as m2, stddev_samp(l_extendedprice) as s2, corr(l_quantity, l_extendedprice) as c, count(*) as n from lineitem), z as (select l_orderkey, l_linenumber, (l_quantity - m1) / s1 as a, (l_extendedprice - m2) / s2 as b, c, n from lineitem, s)"
_TWO = ["l_quantity", "l_extendedprice"]


@query("n_t2", f"{_Z} select l_orderkey, l_linenumber, {r('(a * a + b * b - 2 * c * a * b) / (1 - c * c)', 5)} as t2 from z")
def _(spark, d):
    data = table(spark, d, "lineitem")
    model = pca.fit(data, _TWO, 2, scale=True, threshold=1e-24)
    return rounded(data.select("l_orderkey", "l_linenumber", pca.t2_column(model).alias("t2")), 5)


@query("n_q", f"{_Z} select l_orderkey, l_linenumber, {r('(a - sign(c) * b) ** 2 / 2', 5)} as q from z")
def _(spark, d):
    data = table(spark, d, "lineitem")
    model = pca.fit(data, _TWO, 1, scale=True, threshold=1e-24)
    return rounded(data.select("l_orderkey", "l_linenumber", pca.q_column(model).alias("q")), 5)


@query("n_leverage", f"{_Z} select l_orderkey, l_linenumber, {r('(a * a + b * b - 2 * c * a * b) / (1 - c * c) / (n - 1)', 8)} as leverage from z")
def _(spark, d):
    data = table(spark, d, "lineitem")
    return rounded(pca.leverage(data, pca.fit(data, _TWO, 2, scale=True, threshold=1e-24), ["l_orderkey", "l_linenumber"]), 8)


@query("n_explained_variance", f"with c as (select corr(l_quantity, l_extendedprice) as c from lineitem) select 'PC1' as pc, {r('(1 + abs(c)) / 2')} as ratio, {r('(1 + abs(c)) / 2')} as cumulative from c union all select 'PC2', {r('(1 - abs(c)) / 2')}, 1.0 from c")
def _(spark, d):
    data = table(spark, d, "lineitem")
    return rounded(pca.variance_table(pca.fit(data, _TWO, 2, scale=True, threshold=1e-24), data).select("pc", "ratio", "cumulative"))


@query("n_scores")
def _(spark, d):
    data = table(spark, d, "lineitem")
    return pca.scores(data, pca.fit(data, V, 3, scale=True), ["l_orderkey", "l_linenumber"])


@query("n_cross_validation")
def _(spark, d):
    return pca.cross_validated(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", ["p_size", "p_retailprice"], 2, scale=True)


@query("n_varimax_contributions")
def _(spark, d):
    data = table(spark, d, "lineitem")
    return pca.contributions(pca.rotated(data, pca.fit(data, V, 3, scale=True)), data)


@query("n_loading_lists")
def _(spark, d):
    data = table(spark, d, "lineitem")
    return pca.loading_lists(pca.fit(data, V, 3, scale=True), data)


_M = "with s as (select avg(l_quantity) as m1, stddev_pop(l_quantity) as s1, avg(l_extendedprice) as m2, stddev_pop(l_extendedprice) as s2, corr(l_quantity, l_extendedprice) as c, count(*)::double as n from lineitem), z as (select l_orderkey, l_linenumber, (l_quantity - m1) / s1 as a, (l_extendedprice - m2) / s2 as b, c, n from lineitem, s)"


@query("o_variable_shares", union([f"{_M} select l_orderkey, l_linenumber, '{v}' as variable, {r('(a - sign(c) * b) ** 2 / 4', 5)} as q from z" for v in _TWO]).replace(f" union all {_M}", " union all"))
def _(spark, d):
    data = table(spark, d, "lineitem")
    return rounded(monitor.variable_shares(data, monitor.fit(data, _TWO, 1), ["l_orderkey", "l_linenumber"]).drop("t2"), 5)


@query("o_model_summary", f"{_M} select 1 as n_components, 2 as n_variables, count(*)::bigint as n_rows, {r('(1 + abs(any_value(c))) / 2')} as explained, 'auto' as scaling from z")
def _(spark, d):
    data = table(spark, d, "lineitem")
    return rounded(monitor.summary(data, monitor.fit(data, _TWO, 1)).select("n_components", "n_variables", "n_rows", "explained", "scaling"))


@query("o_monitor_t2", f"{_M} select l_orderkey, l_linenumber, {r('(a * a + b * b - 2 * c * a * b) / (1 - c * c) * (n - 1) / n', 5)} as t2 from z")
def _(spark, d):
    data = table(spark, d, "lineitem")
    return rounded(monitor.faults(data, monitor.fit(data, _TWO, 2), ["l_orderkey", "l_linenumber"]).drop("q", "fault"), 5)


def _monitor(spark, d):
    data = table(spark, d, "lineitem")
    return data, monitor.fit(data, V, 2)


def _component_sql(name: str, start: str) -> str:
    """First eigenvector (v) and eigenvalue (l) of the 4 x 4 matrix in ``start``: its column in a high power of the matrix, by squaring."""
    square = ", ".join(" + ".join(f"m[{4 * i + k + 1}] * m[{4 * k + j + 1}]" for k in range(4)) for i in range(4) for j in range(4))
    column = f"[{', '.join(f'm[{4 * i} + j]' for i in range(4))}]"
    value = " + ".join(f"v[{i + 1}] * v[{j + 1}] * c.m[{4 * i + j + 1}]" for i in range(4) for j in range(4))
    return f"""{name}_p(k, m) as (select 0, m from {start} union all select k + 1, list_transform(q, lambda x: x / list_max(q)) from (select k, [{square}] as q from {name}_p where k < 34)),
{name}_c as (select {column} as v from (select m, list_position([m[1], m[6], m[11], m[16]], list_max([m[1], m[6], m[11], m[16]])) as j from {name}_p where k = 34)),
{name}_v as (select list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda w: w * w)))) as v from {name}_c), {name} as (select v, {value} as l from {name}_v, {start} c)"""


#: Two components of the four variables, T2 and Q of every row (d), and the limits (lim). F with 2 degrees of freedom has a closed quantile; chi-square's comes by halving over its series.
_PLANE = f"""with recursive s as (select count(*)::double as n, {', '.join(f'avg({c}) as m{i}, stddev_pop({c}) as s{i}' for i, c in enumerate(V))} from lineitem),
c0 as (select [{', '.join('1.0' if a == b else f'corr({a}, {b})' for a in V for b in V)}] as m from lineitem),
{_component_sql('e1', 'c0')},
c1 as (select [{', '.join(f'm[{4 * i + j + 1}] - l * v[{i + 1}] * v[{j + 1}]' for i in range(4) for j in range(4))}] as m from c0, e1),
{_component_sql('e2', 'c1')},
z as (select l_orderkey, l_linenumber, l_shipdate, n, e1.l as l1, e2.l as l2, {', '.join(f'({c} - m{i}) / s{i} as z{i}' for i, c in enumerate(V))}, {' + '.join(f'({c} - m{i}) / s{i} * e1.v[{i + 1}]' for i, c in enumerate(V))} as t1, {' + '.join(f'({c} - m{i}) / s{i} * e2.v[{i + 1}]' for i, c in enumerate(V))} as t2, e1.v as v1, e2.v as v2 from lineitem, s, e1, e2),
d as (select *, (t1 * t1 / l1 + t2 * t2 / l2) * (n - 1) / n as ht, greatest({' + '.join(f'z{i} * z{i}' for i in range(4))} - t1 * t1 - t2 * t2, 0) as q from z),
a as (select any_value(n) as n, avg(q) as mq, var_pop(q) as vq from d), levels(alpha) as (values {', '.join(f'({x!r}::double)' for x in monitor.ALPHAS)}),
half(i, alpha, h, lo, hi) as (select 0, alpha, mq * mq / vq, 0.0::double, 2 * mq * mq / vq + 40 * sqrt(mq * mq / vq) + 100 from a, levels
  union all select i + 1, alpha, h, case when p < alpha then mid else lo end, case when p < alpha then hi else mid end from (
    select *, list_sum(list_transform(range(400), lambda k: exp(-mid / 2 + (h + k) * ln(mid / 2) - lgamma(h + k + 1)))) as p from (select *, (lo + hi) / 2 as mid from half where i < 70))),
lim as (select alpha, (n - 1) * 2 / (n - 2) * (n - 2) / 2 * (pow(1 - alpha, -2 / (n - 2)) - 1) as t2_limit, vq / (2 * mq) * lo as q_limit from half, a where i = 70),
f as (select d.*, case when ht > t2_limit and q > q_limit then 'both' when ht > t2_limit then 't2' when q > q_limit then 'q' else 'none' end as fault from d, lim where alpha = {min(monitor.ALPHAS)!r})"""


@query("o_faults", f"{_PLANE} select l_orderkey, l_linenumber, {r('ht', 5)} as t2, {r('q', 5)} as q, fault from f")
def _(spark, d):
    data, m = _monitor(spark, d)
    return rounded(monitor.faults(data, m, ["l_orderkey", "l_linenumber"]), 5)


@query("o_outlier_levels", f"""{_PLANE}, b as (select *, lead(t2_limit) over (order by alpha) as t_next, lead(q_limit) over (order by alpha) as q_next from lim)
select 't2' as statistic, alpha, count(*) filter (ht > t2_limit) as independent, count(*) filter (ht > t2_limit and not coalesce(ht > t_next, false)) as joint from d, b group by alpha
union all select 'q', alpha, count(*) filter (q > q_limit), count(*) filter (q > q_limit and not coalesce(q > q_next, false)) from d, b group by alpha
union all select 't2 or q', alpha, count(*) filter (ht > t2_limit or q > q_limit), count(*) filter ((ht > t2_limit or q > q_limit) and not coalesce(ht > t_next or q > q_next, false)) from d, b group by alpha""")
def _(spark, d):
    data, m = _monitor(spark, d)
    return monitor.outlier_levels(monitor.faults(data, m, []), m)


@query("o_limits", f"{_PLANE} select alpha, {r('t2_limit')} as t2_limit, {r('q_limit')} as q_limit from lim")
def _(spark, d):
    data, m = _monitor(spark, d)
    return rounded(monitor.limits_table(data, m))


@query("o_contributions", f"""{_PLANE}, r as ({union([f"select l_orderkey, l_linenumber, '{c}' as variable, z{i} * s{i} + m{i} as value, m{i} as training_mean, z{i} * s{i} as difference, z{i} - t1 * v1[{i + 1}] - t2 * v2[{i + 1}] as e from d, s" for i, c in enumerate(V)])}),
norm as (select variable, quantile_cont(e * e, 0.95) as top from r group by variable)
select l_orderkey * 10 + l_linenumber as row_id, variable, {r('value', 3)} as value, {r('training_mean', 4)} as training_mean, {r('difference', 3)} as difference, {r('sign(e) * e * e / top', 5)} as contribution from r join norm using (variable) where e * e > top""")
def _(spark, d):
    data, m = _monitor(spark, d)
    rows_ = data.withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    found = monitor.contribution_table(data, rows_, m, "row_id").where("flagged")
    return found.select("row_id", "variable", *[(F.round(c, {"contribution": 5, "training_mean": 4}.get(c, 3)) + 0.0).alias(c) for c in ("value", "training_mean", "difference", "contribution")])


@query("o_fault_windows", f"{_PLANE}, w as (select fault, floor(epoch(l_shipdate) / 2592000)::bigint as k from f) select strftime(make_timestamp(k * 2592000000000), '%Y-%m-%d') as start, strftime(make_timestamp((k + 1) * 2592000000000), '%Y-%m-%d') as until, fault, count(*) as n from w group by k, fault")
def _(spark, d):
    data, m = _monitor(spark, d)
    counts = fault_counts(data.withColumn("ts", F.col("l_shipdate").cast("timestamp")), m, "ts", "30 days")
    return counts.select(F.date_format("start", "yyyy-MM-dd").alias("start"), F.date_format("end", "yyyy-MM-dd").alias("until"), "fault", "n")


#: Four variables, three components, sample deviations; each loading's first number is positive.
_THREE = f"""with recursive s as (select {', '.join(f'avg({c}) as m{i}, stddev_samp({c}) as s{i}' for i, c in enumerate(V))} from lineitem),
c0 as (select [{', '.join('1.0' if a == b else f'corr({a}, {b})' for a in V for b in V)}] as m from lineitem),
{_component_sql('e1', 'c0')}, c1 as (select [{', '.join(f'm[{4 * i + j + 1}] - l * v[{i + 1}] * v[{j + 1}]' for i in range(4) for j in range(4))}] as m from c0, e1),
{_component_sql('e2', 'c1')}, c2 as (select [{', '.join(f'm[{4 * i + j + 1}] - l * v[{i + 1}] * v[{j + 1}]' for i in range(4) for j in range(4))}] as m from c1, e2),
{_component_sql('e3', 'c2')}, p as (select 1 as k, list_transform(v, lambda x: x * sign(v[1])) as v, l from e1 union all select 2, list_transform(v, lambda x: x * sign(v[1])), l from e2 union all select 3, list_transform(v, lambda x: x * sign(v[1])), l from e3)"""


def _converged(spark, d):
    data = table(spark, d, "lineitem")
    return data, pca.fit(data, V, 3, scale=True, max_steps=300_000, threshold=1e-26)


@query("n_scores_converged", f"""{_THREE}, w as (select max(v) filter (k = 1) as a, max(v) filter (k = 2) as b, max(v) filter (k = 3) as c from p)
select l_orderkey, l_linenumber, {', '.join(r(' + '.join(f'({c} - m{i}) / s{i} * {w}[{i + 1}]' for i, c in enumerate(V)), 4) + f' as PC{k}' for k, w in enumerate('abc', 1))} from lineitem, s, w""")
def _(spark, d):
    data, model = _converged(spark, d)
    return rounded(pca.scores(data, model, ["l_orderkey", "l_linenumber"]), 4)


@query("n_loadings_converged", union([f"select '{c}' as variable, 'PC' || k as pc, {r(f'v[{i + 1}]', 5)} as loading, {r('l / 4', 6)} as ratio from p" for i, c in enumerate(V)]).join((f"{_THREE} ", "")))
def _(spark, d):
    data, model = _converged(spark, d)
    rows_ = [(v, f"PC{k + 1}", float(model.loadings[i, k]), float(model.ratio[k])) for i, v in enumerate(V) for k in range(3)]  # 12 numbers of the model
    found = data.sparkSession.createDataFrame(rows_, "variable string, pc string, loading double, ratio double")
    return found.select("variable", "pc", (F.round("loading", 5) + 0.0).alias("loading"), (F.round("ratio", 6) + 0.0).alias("ratio"))


def _gaps(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.expr("case when l_orderkey % 17 = 3 then null else l_quantity end").alias("l_quantity"), "l_extendedprice", F.expr("case when l_linenumber = 2 and l_orderkey % 5 = 0 then null else l_discount end").alias("l_discount"))


@query("p_reconstruction_report")
def _(spark, d):
    before = _gaps(spark, d)
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    return filled_report(before, reconstructed(before, names, 1, scale=True)[0], "row_id", names)


# Q, T: regression

_FIT = "with f as (select regr_slope(l_extendedprice, l_quantity) as b, regr_intercept(l_extendedprice, l_quantity) as a, avg(l_quantity) as m, sum((l_quantity - (select avg(l_quantity) from lineitem)) ** 2) as sxx, count(*)::double as n, var_samp(l_extendedprice) as vy from lineitem), e as (select l_orderkey, l_linenumber, l_extendedprice as y, a + b * l_quantity as f, 1 / n + (l_quantity - m) ** 2 / sxx as h, n, vy from lineitem, f)"


def _simple(spark, d):
    data = table(spark, d, "lineitem")
    return data, mlr.fit(data, "l_extendedprice", ["Intercept", "l_quantity"])


@query("q_coefficients", f"""{_FIT}, s as (select sqrt(sum((y - f) ** 2) / (any_value(n) - 2)) as s from e)
select 'Intercept' as term, {r('a', 4)} as coefficient, {r('s * sqrt(1 / n + m * m / sxx)', 4)} as std_error, {r('a / (s * sqrt(1 / n + m * m / sxx))', 4)} as t, null::double as vif from f, s
union all select 'l_quantity', {r('b', 4)}, {r('s / sqrt(sxx)', 4)}, {r('b / (s / sqrt(sxx))', 4)}, 1.0 from f, s""")
def _(spark, d):
    data, m = _simple(spark, d)
    return rounded(mlr.coefficients(m, data).select("term", "coefficient", "std_error", "t", "vif"), 4)


@query("q_diagnostics", f"{_FIT} select l_orderkey, l_linenumber, {r('y', 4)} as observed, {r('f', 4)} as fitted, {r('y - f', 4)} as residual, {r('h', 4)} as leverage, {r('y - (y - f) / (1 - h)', 4)} as cv_predicted, {r('(y - f) / (1 - h)', 4)} as cv_residual from e")
def _(spark, d):
    data, m = _simple(spark, d)
    return rounded(mlr.diagnostics(data, m, ["l_orderkey", "l_linenumber"]), 4)


@query("q_summary", f"""{_FIT}, g as (select any_value(n) as n, any_value(vy) as vy, sum((y - f) ** 2) as rss, sum(((y - f) / (1 - h)) ** 2) as press, max(h) as hm, avg(h) as ha from e)
select n::bigint as n, 2 as n_terms, (n - 2)::bigint as dof, {r('1 - rss / (vy * (n - 1))')} as r2, {r('1 - rss / (n - 2) / vy')} as r2_adjusted, {r('sqrt(rss / (n - 2))', 3)} as rmse, {r('hm')} as max_leverage, {r('ha')} as mean_leverage, {r('1 - press / (vy * n)')} as q2, {r('sqrt(press / n)', 3)} as rmsecv from g""")
def _(spark, d):
    data, m = _simple(spark, d)
    s = mlr.summary(data, m)
    return s.select("n", "n_terms", "dof", *[(F.round(c, 3 if c.startswith("rms") else 6) + 0.0).alias(c) for c in ("r2", "r2_adjusted", "rmse", "max_leverage", "mean_leverage", "q2", "rmsecv")])


@query("q_multiple_regression")
def _(spark, d):
    data = table(spark, d, "lineitem")
    return mlr.coefficients(mlr.fit(data, "l_extendedprice", mlr.term_names(["l_quantity", "l_discount", "l_tax"])), data)


#: Student's quantile at 0.975 for many degrees of freedom v, by its expansion in 1 / v about the normal one (a fixed value).
_T975 = "(1.959963984540054 + (pow(1.959963984540054, 3) + 1.959963984540054) / (4 * v) + (5 * pow(1.959963984540054, 5) + 16 * pow(1.959963984540054, 3) + 3 * 1.959963984540054) / (96 * v * v))"
_X3 = ["l_quantity", "l_discount", "l_tax"]


def _cofactor(i: int, j: int) -> str:
    a, b = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
    return f"{'-' if (i + j) % 2 else ''}(g{a[0]}{b[0]} * g{a[1]}{b[1]} - g{a[0]}{b[1]} * g{a[1]}{b[0]})"


_OLS3 = f"""with m as (select count(*)::double as n, avg(l_extendedprice) as my, var_pop(l_extendedprice) as gyy, {', '.join(f'avg({c}) as m{i}, covar_pop({c}, l_extendedprice) as y{i}' for i, c in enumerate(_X3))},
{', '.join(f'covar_pop({a}, {b}) as g{i}{j}' for i, a in enumerate(_X3) for j, b in enumerate(_X3))} from lineitem),
dt as (select *, {' + '.join(f'g0{j} * ({_cofactor(0, j)})' for j in range(3))} as det from m),
i as (select *, {', '.join(f'({_cofactor(i, j)}) / det as i{i}{j}' for i in range(3) for j in range(3))} from dt),
b as (select *, {', '.join(' + '.join(f'i{i}{j} * y{j}' for j in range(3)) + f' as b{i}' for i in range(3))} from i),
e as (select *, n - 4 as v, n * (gyy - b0 * y0 - b1 * y1 - b2 * y2) / (n - 4) as s2, ({' + '.join(f'm{i} * m{j} * i{i}{j}' for i in range(3) for j in range(3))}) as mm from b),
c as (select 'Intercept' as term, my - b0 * m0 - b1 * m1 - b2 * m2 as coefficient, sqrt(s2 * (1 + mm) / n) as std_error, null::double as vif, v from e
  {' '.join(f"union all select '{c}', b{i}, sqrt(s2 * i{i}{i} / n), g{i}{i} * i{i}{i}, v from e" for i, c in enumerate(_X3))})"""


@query("q_multiple_coefficients", f"{_OLS3} select term, {r('coefficient', 4)} as coefficient, {r('std_error', 4)} as std_error, {r('coefficient / std_error', 5)} as t, {r(f'coefficient - std_error * {_T975}', 4)} as lower, {r(f'coefficient + std_error * {_T975}', 4)} as upper, {r('vif', 8)} as vif from c")
def _(spark, d):
    data = table(spark, d, "lineitem")
    found = mlr.coefficients(mlr.fit(data, "l_extendedprice", ["Intercept", *_X3]), data)
    digits = {"t": 5, "vif": 8}
    return found.select("term", *[(F.round(c, digits.get(c, 4)) + 0.0).alias(c) for c in ("coefficient", "std_error", "t", "lower", "upper", "vif")])


@query("q_predictions")
def _(spark, d):
    data = table(spark, d, "lineitem")
    return mlr.predicted(data, mlr.fit(data, "l_extendedprice", mlr.term_names(["l_quantity", "l_tax"])), ["l_orderkey", "l_linenumber"], "l_extendedprice")


@query("q_predictions_linear", f"""with m as (select count(*)::double as n, avg(l_extendedprice) as my, avg(l_quantity) as mq, avg(l_tax) as mt, var_pop(l_extendedprice) as yy, var_pop(l_quantity) as qq, var_pop(l_tax) as tt, covar_pop(l_quantity, l_tax) as qt, covar_pop(l_quantity, l_extendedprice) as qy, covar_pop(l_tax, l_extendedprice) as ty from lineitem),
b as (select *, qq * tt - qt * qt as det, (tt * qy - qt * ty) / (qq * tt - qt * qt) as bq, (qq * ty - qt * qy) / (qq * tt - qt * qt) as bt, n - 3 as v from m),
p as (select l_orderkey, l_linenumber, l_extendedprice as y, my + bq * (l_quantity - mq) + bt * (l_tax - mt) as predicted, sqrt(n * (yy - bq * qy - bt * ty) / (n - 3)) as s, v,
  (1 + (tt * (l_quantity - mq) * (l_quantity - mq) - 2 * qt * (l_quantity - mq) * (l_tax - mt) + qq * (l_tax - mt) * (l_tax - mt)) / det) / n as leverage from lineitem, b)
select l_orderkey, l_linenumber, {r('predicted', 3)} as predicted, {r('leverage', 9)} as leverage, {r('s * sqrt(leverage)', 4)} as std_error, {r(f'predicted - s * sqrt(leverage) * {_T975}', 3)} as lower, {r(f'predicted + s * sqrt(leverage) * {_T975}', 3)} as upper, {r('predicted - y', 3)} as residual from p""")
def _(spark, d):
    data = table(spark, d, "lineitem")
    found = mlr.predicted(data, mlr.fit(data, "l_extendedprice", ["Intercept", "l_quantity", "l_tax"]), ["l_orderkey", "l_linenumber"], "l_extendedprice")
    digits = {"leverage": 9, "std_error": 4}
    return found.select("l_orderkey", "l_linenumber", *[(F.round(c, digits.get(c, 3)) + 0.0).alias(c) for c in ("predicted", "leverage", "std_error", "lower", "upper", "residual")])


_REP = "select round(l_quantity, 10) + 0.0 as l_quantity, round(l_tax, 10) + 0.0 as l_tax, count(*)::bigint as n, avg(l_extendedprice) as mean, var_samp(l_extendedprice) as variance from lineitem group by 1, 2 having count(*) > 1"


@query("q_replicates", f"select l_quantity, l_tax, n, {r('mean', 3)} as mean, {r('sqrt(variance)', 3)} as std, n - 1 as dof from ({_REP})")
def _(spark, d):
    g = mlr.replicates(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice")
    return g.select("l_quantity", "l_tax", "n", (F.round("mean", 3) + 0.0).alias("mean"), (F.round(F.sqrt("variance"), 3) + 0.0).alias("std"), "dof")


@query("q_pooled", f"select count(*)::bigint as n_groups, sum(n - 1)::bigint as dof, {r('sqrt(sum(variance * (n - 1)) / sum(n - 1))', 3)} as std from ({_REP})")
def _(spark, d):
    g = mlr.pooled(mlr.replicates(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice"))
    return g.select("n_groups", "dof", (F.round("std", 3) + 0.0).alias("std"))


@query("q_central_points", "select l_orderkey, l_linenumber from lineitem where abs(l_quantity - (select (min(l_quantity) + max(l_quantity)) / 2 from lineitem)) <= 0.6 and abs(l_tax - (select (min(l_tax) + max(l_tax)) / 2 from lineitem)) <= 0.6")
def _(spark, d):
    return mlr.central_points(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ["l_quantity", "l_tax"], 0.6).select("l_orderkey", "l_linenumber")


@query("t_diagnostics", union([f"""select '{y}' as response, l_orderkey, l_linenumber, {r('f', 4)} as fitted, {r('y - f', 4)} as residual, {r('h', 9)} as leverage, {r('(y - f) / (1 - h)', 4)} as cv_residual from (select l_orderkey, l_linenumber, {y}::double as y, a + b * l_quantity as f, 1 / n + (l_quantity - m) * (l_quantity - m) / (n * v) as h
from lineitem, (select regr_slope({y}, l_quantity) as b, regr_intercept({y}, l_quantity) as a, avg(l_quantity) as m, var_pop(l_quantity) as v, count(*)::double as n from lineitem))""" for y in ("l_extendedprice", "l_discount")]))
def _(spark, d):
    data = table(spark, d, "lineitem")
    found = multi.diagnostics(data, multi.fit_all(data, ["l_extendedprice", "l_discount"], ["Intercept", "l_quantity"]), ["l_orderkey", "l_linenumber"])
    return found.select("response", "l_orderkey", "l_linenumber", *[(F.round(c, 9 if c == "leverage" else 4) + 0.0).alias(c) for c in ("fitted", "residual", "leverage", "cv_residual")])


@query("t_comparison", union([f"""select '{t}' as term, '{y}' as response, {r(e, 4)} as coefficient, {r('1.0 * sign(b)' if t != 'Intercept' else e, 4)} as relative from (select regr_slope({y}, l_quantity) as b, regr_intercept({y}, l_quantity) as a from lineitem)""" for y in ("l_extendedprice", "l_discount") for t, e in (("Intercept", "a"), ("l_quantity", "b"))]))
def _(spark, d):
    data = table(spark, d, "lineitem")
    return rounded(multi.comparison(data, multi.fit_all(data, ["l_extendedprice", "l_discount"], ["Intercept", "l_quantity"])), 4)


def _plane_of(y: str, a: str, b: str, source: str) -> str:
    """A response's regression on two terms: one row with its sums (n, my, ma, mb, ...), slopes p and q, residual deviation s and degrees of freedom v."""
    return f"""select *, (bb * ay - ab * by_) / det as p, (aa * by_ - ab * ay) / det as q, sqrt(greatest(n * (yy - (bb * ay - ab * by_) / det * ay - (aa * by_ - ab * ay) / det * by_), 0) / (n - 3)) as s, n - 3 as v from (
select *, aa * bb - ab * ab as det from (select count(*)::double as n, avg({y}) as my, avg({a}) as ma, avg({b}) as mb, var_pop({y}) as yy, var_pop({a}) as aa, var_pop({b}) as bb, covar_pop({a}, {b}) as ab, covar_pop({a}, {y}) as ay, covar_pop({b}, {y}) as by_ from {source}))"""


def _leverage(x: str, y: str) -> str:
    return f"((1 + (bb * ({x} - ma) * ({x} - ma) - 2 * ab * ({x} - ma) * ({y} - mb) + aa * ({y} - mb) * ({y} - mb)) / det) / n)"


_CODED = "(select 2 * (l_quantity - 1) / 49.0::double - 1 as q, 2 * l_tax / 0.08::double - 1 as t, l_extendedprice as price, l_discount from lineitem)"
_CELLS2 = union([f"select '{y}' as response, ix, iy, -1 + ix * 0.1 as x, -1 + iy * 0.1 as y, my + p * (-1 + ix * 0.1 - ma) + q * (-1 + iy * 0.1 - mb) as z, {_T975} * s * sqrt{_leverage('(-1 + ix * 0.1)', '(-1 + iy * 0.1)')} as ci from ({_plane_of(y, 'q', 't', _CODED)}), (select unnest(range(21)) as ix), (select unnest(range(21)) as iy)" for y in ("price", "l_discount")])
_MEETS = "case when response = 'price' then z - ci >= 30000 else z + ci <= 0.06 end"


@query("t_summaries", union([f"""select '{y}' as response, {r('1 - s * s / (yy * n / (n - 1))', 8)} as r2_adjusted, {r('s', 5)} as rmse, v::bigint as dof, {r('1 - press / (yy * n / (n - 1) * n)', 7)} as q2, {r('sqrt(press / n)', 5)} as rmsecv, 'ok' as status from (
select any_value(s) as s, any_value(v) as v, any_value(n) as n, any_value(yy) as yy, sum(pow((y - my - p * (a - ma) - q * (b - mb)) / (1 - {_leverage('a', 'b')}), 2)) as press from (select {y} as y, l_quantity as a, l_quantity * l_quantity as b from lineitem), ({_plane_of(y, 'l_quantity', 'l_quantity * l_quantity', 'lineitem')}))""" for y in ("l_extendedprice", "l_discount", "l_tax")]))
def _(spark, d):
    data = table(spark, d, "lineitem")
    found = multi.summaries(data, multi.fit_all(data, ["l_extendedprice", "l_discount", "l_tax"], ["Intercept", "l_quantity", "l_quantity^2"]))
    digits = {"r2_adjusted": 8, "q2": 7}
    return found.select("response", *[(F.round(c, digits.get(c, 5)) + 0.0).alias(c) if c not in ("dof", "status") else F.col(c) for c in ("r2_adjusted", "rmse", "dof", "q2", "rmsecv", "status")])


@query("t_weighted_objective", f"select p_partkey, {r('0.7 * (1 - (p_size - min(p_size) over ()) / (max(p_size) over () - min(p_size) over ())::double) + 0.3 * (p_retailprice - min(p_retailprice) over ()) / (max(p_retailprice) over () - min(p_retailprice) over ())')} as objective from part")
def _(spark, d):
    return rounded(multi.weighted_objective(table(spark, d, "part"), {"p_size": 0.7, "p_retailprice": 0.3}, {"p_size": "minimize", "p_retailprice": "maximize"}).select("p_partkey", "objective"))


@query("t_predictions", f"with b as (select regr_slope(l_extendedprice, l_quantity) as b1, regr_intercept(l_extendedprice, l_quantity) as a1, regr_slope(l_discount, l_quantity) as b2, regr_intercept(l_discount, l_quantity) as a2 from lineitem) select l_orderkey, l_linenumber, {r('a1 + b1 * l_quantity', 4)} as l_extendedprice, {r('a2 + b2 * l_quantity', 4)} as l_discount from lineitem, b")
def _(spark, d):
    data = table(spark, d, "lineitem")
    return rounded(multi.predictions(data, multi.fit_all(data, ["l_extendedprice", "l_discount"], ["Intercept", "l_quantity"]), ["l_orderkey", "l_linenumber"]), 4)


# R: designs


@query("r_full_factorial", """select row_number() over (order by l_returnflag, l_linestatus, l_linenumber) as run, l_returnflag, l_linestatus, l_linenumber
from (select distinct l_returnflag from lineitem where l_returnflag is not null), (select distinct l_linestatus from lineitem where l_linestatus is not null), (select distinct l_linenumber from lineitem where l_linenumber is not null)""")
def _(spark, d):
    return doe.factorial_of(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


def _groups_sql(coded: str, source: str, by: str, factors: list[str], digits: int = 4) -> str:
    """A coded design (run, x1, x2, ...) on every group's own ranges."""
    ranges = ", ".join(f"min({c})::double as l{i}, max({c})::double as h{i}" for i, c in enumerate(factors))
    return f"with d as ({coded}), g as (select {by}, {ranges} from {source} group by {by}) select {by}, run, " + ", ".join(r(f"l{i} + (x{i + 1} + 1) * (h{i} - l{i}) / 2", digits) + f" as {c}" for i, c in enumerate(factors)) + " from g, d"


_COMPOSITE = """with c as (select row_number() over (order by a, b)::bigint as run, a::double as x1, b::double as x2 from (select unnest([-1, 1]) as a), (select unnest([-1, 1]) as b)), k as (select sqrt((sqrt(4 * 6) - 4) / 2) as k)
select run, x1, x2 from (select * from c union all select 5, k, 0 from k union all select 6, -k, 0 from k union all select 7, 0, k from k union all select 8, 0, -k from k union all select unnest([9, 10, 11]), 0, 0)"""
_PART_FACTORS = ["p_size", "p_retailprice"]


@query("r_central_composite", _groups_sql(_COMPOSITE, "part", "p_brand", _PART_FACTORS))
def _(spark, d):
    return rounded(doe.over_groups(doe.central_composite(spark, 2), ["x1", "x2"], table(spark, d, "part"), ["p_brand"], _PART_FACTORS), 4)


#: The published eight-run design.
_PB8 = ["+--+-++", "++--+-+", "+++--+-", "-+++--+", "+-+++--", "-+-+++-", "--+-+++", "-------"]


@query("r_plackett_burman", _groups_sql("select run::bigint as run, " + ", ".join(f"case substr(t, {i}, 1) when '+' then 1.0::double else -1.0::double end as x{i}" for i in range(1, 8)) + " from (values " + ", ".join(f"({i + 1}, '{t}')" for i, t in enumerate(_PB8)) + ") as d(run, t)", "lineitem", "l_suppkey", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_orderkey"]))
def _(spark, d):
    factors = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_orderkey"]
    return rounded(doe.over_groups(doe.plackett_burman(spark, 7), [f"x{i}" for i in range(1, 8)], table(spark, d, "lineitem"), ["l_suppkey"], factors), 4)


@query("r_half_fraction", _groups_sql("select (1 + (a + 1) / 2 + (b + 1) + (c + 1) * 2)::bigint as run, a::double as x1, b::double as x2, c::double as x3, (a * b * c)::double as x4 from (select unnest([-1, 1]) as a), (select unnest([-1, 1]) as b), (select unnest([-1, 1]) as c)", "lineitem", "l_suppkey", V))
def _(spark, d):
    return rounded(doe.over_groups(doe.fractional_factorial(spark, 4), [f"x{i}" for i in range(1, 5)], table(spark, d, "lineitem"), ["l_suppkey"], V), 4)


@query("r_point_types", f"""with s as (select min(l_discount) as a, max(l_discount) as b, min(l_tax) as c, max(l_tax) as e, min(l_quantity) as f, max(l_quantity) as g from lineitem),
d as (select l_orderkey, l_linenumber, [2 * (l_discount - a) / (b - a) - 1, 2 * (l_tax - c) / (e - c) - 1, 2 * (l_quantity - f) / (g - f) - 1] as x from lineitem, s),
n as (select *, len(list_filter(x, lambda v: abs(abs(v) - 1) <= 0.1)) as ones, len(list_filter(x, lambda v: abs(v) <= 0.1)) as zeros from d)
select l_orderkey, l_linenumber, case when zeros = 3 then 'center' when ones = 3 then 'corner' when ones = 1 and zeros = 2 then 'axial' when ones > 0 and zeros > 0 then 'edge' else 'interior' end as point_type from n""")
def _(spark, d):
    data = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")
    return doe.classified(data, ["l_discount", "l_tax", "l_quantity"], real=True).select("l_orderkey", "l_linenumber", "point_type")


@query("r_grid", _groups_sql("select (a * 5 + b)::bigint as run, -1 + a * 0.5 as x1, -1 + b * 0.5 as x2 from (select unnest(range(5)) as a), (select unnest(range(5)) as b)", "part", "p_brand", _PART_FACTORS))
def _(spark, d):
    grid = doe.linspace_grid(spark, {"x1": (-1.0, 1.0, 5), "x2": (-1.0, 1.0, 5)}).withColumnRenamed("id", "run")
    return rounded(doe.over_groups(grid, ["x1", "x2"], table(spark, d, "part"), ["p_brand"], _PART_FACTORS), 4)


# S: surfaces


def _surfaces(spark, d):
    data = table(spark, d, "lineitem").select(columns.code_value(F.col("l_quantity"), 1, 50).alias("q"), columns.code_value(F.col("l_tax"), 0.0, 0.08).alias("t"), F.col("l_extendedprice").alias("price"), "l_discount")
    return data, multi.fit_all(data, ["price", "l_discount"], ["Intercept", "q", "t"])


_S = "with x as (select (l_quantity - 25.5) / 24.5 as q, (l_tax - 0.04) / 0.04 as t, l_extendedprice as y from lineitem), s as (select regr_sxx(q, q) as qq, regr_sxx(t, t) as tt, regr_sxy(q, t) as qt, regr_sxy(y, q) as qy, regr_sxy(y, t) as ty, avg(q) as mq, avg(t) as mt, avg(y) as my from x), b as (select (tt * qy - qt * ty) / (qq * tt - qt * qt) as bq, (qq * ty - qt * qy) / (qq * tt - qt * qt) as bt, mq, mt, my from s)"


@query("s_response_surface", f"{_S} select ix::int as ix, iy::int as iy, {r('-1 + ix * 0.1', 3)} as x, {r('-1 + iy * 0.1', 3)} as y, {r('my + bq * (-1 + ix * 0.1 - mq) + bt * (-1 + iy * 0.1 - mt)', 3)} as z from b, (select unnest(range(21)) as ix), (select unnest(range(21)) as iy)")
def _(spark, d):
    _, models = _surfaces(spark, d)
    return rounded(surface.surface(spark, models["price"], "q", "t", {}, steps=20).drop("ci"), 3)


@query("s_optimum", f"{_S} select ix::int as ix, iy::int as iy, {r('my + bq * (-1 + ix * 0.1 - mq) + bt * (-1 + iy * 0.1 - mt)', 3)} as z from b, (select unnest(range(21)) as ix), (select unnest(range(21)) as iy) order by my + bq * (-1 + ix * 0.1 - mq) + bt * (-1 + iy * 0.1 - mt) desc limit 1")
def _(spark, d):
    _, models = _surfaces(spark, d)
    return rounded(surface.optimum(surface.surface(spark, models["price"], "q", "t", {}, steps=20)).select("ix", "iy", "z"), 3)


@query("s_feasible_region", f"select ix::int as ix, iy::int as iy, {r('any_value(x)')} as x, {r('any_value(y)')} as y, bool_and({_MEETS}) as feasible from ({_CELLS2}) group by ix, iy")
def _(spark, d):
    _, models = _surfaces(spark, d)
    both = surface.surfaces(spark, models, "q", "t", {}, steps=20)
    return rounded(surface.feasible(both, {"price": ("Threshold_Above", 30000.0, 0.0), "l_discount": ("Threshold_Below", 0.0, 0.06)}))


@query("s_bounds", f"select response, {r('min(z)', 4)} as z_min, {r('max(z)', 4)} as z_max, {r('max(z) - min(z)', 4)} as z_range, {r('min(ci)', 4)} as ci_min, {r('max(ci)', 4)} as ci_max from ({_CELLS2}) group by response")
def _(spark, d):
    _, models = _surfaces(spark, d)
    return rounded(surface.bounds(surface.surfaces(spark, models, "q", "t", {}, steps=20), ["response"]), 4)


@query("s_overlay", f"select ix::int as ix, iy::int as iy, {r('any_value(x)')} as x, {r('any_value(y)')} as y, count(*) filter ({_MEETS}) as met, count(*) as of, min(case when not ({_MEETS}) then response end) as failing from ({_CELLS2}) group by ix, iy")
def _(spark, d):
    _, models = _surfaces(spark, d)
    both = surface.surfaces(spark, models, "q", "t", {}, steps=20)
    return rounded(surface.overlay(both, {"price": ("Threshold_Above", 30000.0, 0.0), "l_discount": ("Threshold_Below", 0.0, 0.06)}))


_BLOCK = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("k_write_back", f"select l_orderkey, l_partkey, l_suppkey, l_linenumber, {', '.join(r(f'{b} - {a}', 4) + f' as {a}' for a, b in zip(_BLOCK, _BLOCK[1:]))}, l_returnflag, l_linestatus from lineitem")
def _(spark, d):
    data = rows.as_array(table(spark, d, "lineitem").drop("l_shipdate"), _BLOCK)
    made = data.withColumn("spectrum", rows.first_derivative(F.col("spectrum")))
    return rounded(writeback.array_written_back(made, "spectrum", _BLOCK, 3), 4)


@query("k_before_after", union([f"select l_orderkey, {i + 1} as position, '{c}' as variable, {r(f'{c}::double', 4)} as before, {r(f'{_BLOCK[i + 1]} - {c}', 4) if i < 3 else 'null::double'} as after from lineitem" for i, c in enumerate(_BLOCK)]))
def _(spark, d):
    data = rows.as_array(table(spark, d, "lineitem").select("l_orderkey", *_BLOCK), _BLOCK)
    return rounded(writeback.before_and_after(data.withColumn("spectrum", rows.first_derivative(F.col("spectrum"))), "l_orderkey", _BLOCK, "spectrum"), 4)


@query("k_joined_back", f"select p_partkey, p_name, p_brand, p_type, {r('(p_size - (select avg(p_size) from part)) / (select stddev_samp(p_size) from part)', 6)} as p_size, {r('(p_retailprice - (select avg(p_retailprice) from part)) / (select stddev_samp(p_retailprice) from part)', 6)} as p_retailprice from part where p_partkey % 2 = 0")
def _(spark, d):
    part = table(spark, d, "part")
    made = columns.autoscaled(part.withColumns({c: F.col(c).cast("double") for c in ("p_size", "p_retailprice")}), ["p_size", "p_retailprice"]).where("p_partkey % 2 = 0")
    return rounded(writeback.written_back(part, made, "p_partkey", ["p_size", "p_retailprice"], ["p_size", "p_retailprice"]))


@query("s_contours")
def _(spark, d):
    _, models = _surfaces(spark, d)
    rows = surface.surfaces(spark, models, "q", "t", {}, steps=20).where("response = 'price'")
    return contours.contours(rows, contours.levels_between(rows))


# U: Pareto fronts

_DOM = "select {c} from {t} p where not exists (select 1 from {t} o where o.s <= p.s and o.v >= p.v and (o.s < p.s or o.v > p.v))"


@query("u_pareto_rank", f"""with p as (select p_partkey, p_size as s, p_retailprice as v from part), a as materialized ({_DOM.format(c='*', t='p')}), p2 as materialized (select * from p anti join a using (p_partkey)),
b as materialized ({_DOM.format(c='*', t='p2')}), p3 as materialized (select * from p2 anti join b using (p_partkey)), c as materialized ({_DOM.format(c='*', t='p3')})
select p.p_partkey, case when a.p_partkey is not null then 1 when b.p_partkey is not null then 2 when c.p_partkey is not null then 3 else 4 end as pareto_rank, a.p_partkey is null as is_dominated from p left join a using (p_partkey) left join b using (p_partkey) left join c using (p_partkey)""")
def _(spark, d):
    ranked = pareto.ranked(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), {"p_size": ("minimize",), "p_retailprice": ("maximize",)})
    return ranked.select("p_partkey", "pareto_rank", "is_dominated")


@query("u_crowding", f"""with p as (select distinct p_size as s, p_retailprice as v from part), a as materialized ({_DOM.format(c='*', t='p')}), p2 as materialized (select * from p anti join a using (s, v)),
b as materialized ({_DOM.format(c='*', t='p2')}), f as (select *, 1 as pareto_rank from a union all select *, 2 from b),
g as (select *, lead(s) over (partition by pareto_rank order by s) - lag(s) over (partition by pareto_rank order by s) as gs, lead(v) over (partition by pareto_rank order by v) - lag(v) over (partition by pareto_rank order by v) as gv,
max(s) over (partition by pareto_rank) - min(s) over (partition by pareto_rank) as rs, max(v) over (partition by pareto_rank) - min(v) over (partition by pareto_rank) as rv from f)
select s as p_size, v as p_retailprice, pareto_rank, case when gs is null or gv is null then -1 else round(gs / rs + gv / rv, 6) end as crowding from g""")
def _(spark, d):
    points = table(spark, d, "part").select("p_size", "p_retailprice").distinct()
    ranked = pareto.ranked(points, {"p_size": ("minimize",), "p_retailprice": ("maximize",)}, 2).where("pareto_rank <= 2")
    return ranked.select("p_size", "p_retailprice", "pareto_rank", F.when(F.col("crowding_distance") == float("inf"), -1.0).otherwise(F.round("crowding_distance", 6)).alias("crowding"))


@query("u_dominance_count", "with p as (select p_partkey, p_size as s, p_retailprice as v from part) select p.p_partkey, count(o.p_partkey)::bigint as dominated_by from p left join p o on o.s <= p.s and o.v >= p.v and (o.s < p.s or o.v > p.v) group by 1")
def _(spark, d):
    return pareto.dominance_count(table(spark, d, "part"), "p_partkey", {"p_size": ("minimize",), "p_retailprice": ("maximize",)})


@query("u_dominance_three", """with c as (select l_quantity as a, l_discount as b, l_tax as t, count(*) as k from lineitem group by all),
n as (select p.a, p.b, p.t, coalesce(sum(o.k), 0)::bigint as dominated_by from c p left join c o on o.a >= p.a and o.b >= p.b and o.t <= p.t and (o.a > p.a or o.b > p.b or o.t < p.t) group by all)
select l_orderkey, l_linenumber, dominated_by from lineitem join n on a = l_quantity and b = l_discount and t = l_tax""")
def _(spark, d):
    rows = table(spark, d, "lineitem").withColumn("row", F.struct("l_orderkey", "l_linenumber"))
    return pareto.dominance_count(rows, "row", {"l_quantity": ("maximize",), "l_discount": ("maximize",), "l_tax": ("minimize",)}).select("row.*", "dominated_by")


@query("u_fronts_in_conflict")
def _(spark, d):
    four = {"l_quantity": ("maximize",), "l_extendedprice": ("minimize",), "l_discount": ("maximize",), "l_tax": ("minimize",)}
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *four)
    return pareto.ranked(rows, four, 2).select("l_orderkey", "l_linenumber", "pareto_rank", "is_dominated")


# W: chart tables


@query("w_histogram", f"""with s as (select min(o_totalprice) as lo, (max(o_totalprice) - min(o_totalprice)) / 30 as w from orders), b as (select least(floor((o_totalprice - lo) / w), 29)::int as bin, lo, w from orders, s)
select bin, {r('any_value(lo) + bin * any_value(w)', 4)} as low, {r('any_value(lo) + (bin + 1) * any_value(w)', 4)} as high, count(*)::bigint as count from b group by bin""")
def _(spark, d):
    return rounded(charts.histogram(table(spark, d, "orders"), "o_totalprice"), 4)


@query("w_box", f"select {r('quantile_cont(o_totalprice, 0.25)', 3)} as q1, {r('median(o_totalprice)', 3)} as median, {r('quantile_cont(o_totalprice, 0.75)', 3)} as q3, {r('avg(o_totalprice)', 3)} as mean, {r('stddev_samp(o_totalprice)', 3)} as std, {r('min(o_totalprice)', 3)} as min, {r('max(o_totalprice)', 3)} as max from orders")
def _(spark, d):
    return rounded(charts.box(table(spark, d, "orders"), "o_totalprice"), 3)


@query("w_axis_range", union([f"select '{c}' as variable, {r(f'min({c}) - (max({c}) - min({c})) * 0.05', 4)} as low, {r(f'max({c}) + (max({c}) - min({c})) * 0.05', 4)} as high from lineitem" for c in V]))
def _(spark, d):
    return rounded(charts.axis_range(table(spark, d, "lineitem"), V), 4)


@query("w_fitted_vs_observed", f"{_FIT} select {r('corr(y, f)')} as r_fitted, {r('corr(y, y - (y - f) / (1 - h))')} as r_cv, {r('stddev_pop(y - f)', 3)} as residual_sd, {r('max(abs(y - f))', 3)} as largest_residual from e")
def _(spark, d):
    data, m = _simple(spark, d)
    f = charts.fitted_vs_observed(mlr.diagnostics(data, m, []))
    return f.select(*[(F.round(c, 6 if c.startswith("r_") else 3) + 0.0).alias(c) for c in f.columns])


@query("w_quantile_pairs")
def _(spark, d):
    return charts.quantile_pairs(table(spark, d, "orders"), "o_totalprice")


def _density_sql(category: str) -> str:
    return f"""with v as (select {category} as category, l_extendedprice as v from lineitem),
s as (select category, count(*) as n, min(v) as lo, max(v) as hi, stddev_pop(v) as sd, stddev_samp(v) * pow(count(*), -0.2) as h from v group by category),
g as (select s.*, point, lo - sd + point * (hi - lo + 2 * sd) / 199 as x from s, range(200) as t(point))
select g.category, point::int as point, {r('any_value(x)', 4)} as x, {r('sum(exp(-pow((x - v) / h, 2) / 2)) / any_value(n * h * sqrt(2 * pi())) * 1e6', 6)} as density from g join v on g.category = v.category group by g.category, point"""


def _density(found):
    return found.select("category", "point", F.round("x", 4).alias("x"), (F.round(F.col("density") * 1e6, 6) + 0.0).alias("density"))


@query("w_density", _density_sql("l_returnflag"))
def _(spark, d):
    return _density(charts.density(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"))


@query("w_density_whole", _density_sql("''"))
def _(spark, d):
    return _density(charts.density(table(spark, d, "lineitem"), "l_extendedprice"))


@query("w_colours", f"select p_partkey, {r('(p_size - min(p_size) over ()) / (max(p_size) over () - min(p_size) over ())::double')} as shade, case when p_size is null then 'rgb(128,128,128)' else 'rgb(' || floor((p_size - 1) / 49.0::double * 255)::int || ',0,' || floor((1 - (p_size - 1) / 49.0::double) * 255)::int || ')' end as colour from part")
def _(spark, d):
    shaded = charts.scaled_colour(table(spark, d, "part").select("p_partkey", "p_size"), "p_size")
    return rounded(shaded.select("p_partkey", "shade", scalars.blue_to_red(F.col("p_size").cast("double"), 1.0, 50.0).alias("colour")))


# V: workspace


@query("v_lineage", """select name, parent, kind, transform, n::bigint as n_rows from (values ('part', null, 'original', null), ('part_scaled', 'part', 'transform', 'autoscale'), ('part_Selected', 'part', 'split', 'Manual'), ('part_Remaining', 'part', 'split', 'Manual'),
('sizes', 'part_Selected', 'results', 'summary')) t(name, parent, kind, transform), lateral (select case name when 'part_Selected' then count(*) filter (p_size > 25) when 'part_Remaining' then count(*) filter (not (p_size > 25) or p_size is null) when 'sizes' then count(distinct p_size) filter (p_size > 25) else count(*) end as n from part) c""")
def _(spark, d):
    w = SharedWorkspace(spark, shared_folder(spark, "workspace"))
    w.save("part", table(spark, d, "part"))
    part = w.dataset("part")
    w.save("part_scaled", columns.autoscaled(part, ["p_size"]), "part", "transform", "autoscale")
    w.split("part", "p_partkey", part.where("p_size > 25"))
    w.save_result("sizes", w.dataset("part_Selected").groupBy("p_size").count(), "part_Selected", "summary")
    return SharedWorkspace(spark, w.path).entries().select("name", "parent", "kind", "transform", "n_rows")


# A, B: text in and out

_PASTE = "a b\ta b\tname\n1,5\t2\tx\n2,5\t\ty\n-1\t7,25\tz\n"


@query("a_clipboard", "select * from (values (1::bigint, 1.5::double, 2.0::double, 'x'), (2, 2.5, null, 'y'), (3, -1.0, 7.25, 'z')) t(row_id, a_b, a_b_1, name)")
def _(spark, d):
    return parse_clipboard(spark, _PASTE, decimal=",")


@query("b_spectral_lines", "select n_nationkey || chr(9) || n_name || chr(9) || coalesce(nullif(n_regionkey, 0)::varchar, '0.0') as value from nation")
def _(spark, d):
    return spectral_lines(table(spark, d, "nation").selectExpr("n_nationkey", "n_name", "nullif(n_regionkey, 0) as n_regionkey"))


# Validation of regressions, intervals at points, chart tables


_LQ = "with x as (select l_orderkey * 10 + l_linenumber as row_id, l_quantity as q, l_extendedprice as y, l_linenumber = 7 as out from lineitem)"


@query("q_design_analysis", f"""with s as (select count(*)::double as n, avg(p_size) as m, sum((p_size - (select avg(p_size) from part)) ** 2) as sxx from part)
select p_partkey, {r('1 / n + (p_size - m) ** 2 / sxx', 8)} as leverage, 1 / n + (p_size - m) ** 2 / sxx > 4 / n as high from part, s""")
def _(spark, d):
    data = table(spark, d, "part")
    return rounded(validation.leverages(data, validation.design(data, ["Intercept", "p_size"]), ["p_partkey"]).drop("half_width"), 8)


@query("q_design_summary", f"""with s as (select count(*)::double as n, avg(p_size) as m, sum((p_size - (select avg(p_size) from part)) ** 2) as sxx from part), h as (select 1 / n + (p_size - m) ** 2 / sxx as h, n, m, sxx from part, s)
select count(*)::bigint as n, 2 as n_terms, (count(*) - 2)::bigint as dof, {r('any_value(1 / n + m * m / sxx + 1 / sxx)', 8)} as trace, {r('avg(h)', 8)} as mean_leverage, {r('max(h)', 8)} as max_leverage, count_if(h > 4 / n)::bigint as n_high, 1.0::double as max_vif from h""")
def _(spark, d):
    data = table(spark, d, "part")
    return rounded(validation.design_summary(data, validation.design(data, ["Intercept", "p_size"])).drop("determinant"), 8)


@query("q_dispersion", f"""with s as (select count(*)::double as n, avg(p_size) as m, sum((p_size - (select avg(p_size) from part)) ** 2) as sxx from part)
select 'Intercept' as term, 'Intercept' as other, {r('1 / n + m * m / sxx', 9)} as value from s union all select 'Intercept', 'p_size', {r('-m / sxx', 9)} from s union all select 'p_size', 'Intercept', {r('-m / sxx', 9)} from s union all select 'p_size', 'p_size', {r('1 / sxx', 9)} from s""")
def _(spark, d):
    data = table(spark, d, "part")
    return rounded(validation.dispersion(data, validation.design(data, ["Intercept", "p_size"])), 9)


@query("q_replicate_rows", f"""with g as (select l_quantity, l_tax, count(*)::bigint as n, avg(l_extendedprice) as mean from lineitem group by all having count(*) > 1)
select l_orderkey, l_linenumber, l_extendedprice, g.n, {r('g.mean', 3)} as mean, {r('l_extendedprice - g.mean', 3)} as deviation from lineitem join g using (l_quantity, l_tax)""")
def _(spark, d):
    return rounded(validation.replicate_rows(table(spark, d, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice", ["l_orderkey", "l_linenumber"]), 3)


@query("q_left_out", f"""{_LQ}, f as (select regr_slope(y, q) as b, regr_intercept(y, q) as a, avg(q) as m, regr_sxx(y, q) as sxx, count(*)::double as n from x where not out)
select q, count(*)::bigint as n, {r('any_value(a + b * q)', 3)} as predicted, {r('avg(y)', 3)} as mean, {r('coalesce(stddev_samp(y), 0)', 3)} as std, {r('sqrt(avg((y - a - b * q) ** 2))', 3)} as rmse, {r('any_value(1 / f.n + (q - m) ** 2 / sxx)', 8)} as leverage from x, f where out group by q""")
def _(spark, d):
    data = table(spark, d, "lineitem").selectExpr("l_linenumber", "l_quantity as q", "l_extendedprice as y")
    m = mlr.fit(data.where("l_linenumber <> 7"), "y", ["Intercept", "q"])
    found = validation.left_out(data.where("l_linenumber = 7"), m, "y", 1000.0, 50, ["q"])
    return found.select("q", "n", *[(F.round(c, 8 if c == "leverage" else 3) + 0.0).alias(c) for c in ("predicted", "mean", "std", "rmse", "leverage")])


@query("q_error_comparison", f"""{_FIT}, m as (select sqrt(sum((y - f) ** 2) / (any_value(n) - 2)) as rmse from e), g as (select count(*) - 1 as d, var_samp(l_extendedprice) as v from lineitem group by l_quantity having count(*) > 1), p as (select sqrt(sum(v * d) / sum(d)) as pure from g)
select {r('rmse', 3)} as rmse, {r('pure', 3)} as experimental, {r('rmse / pure')} as ratio, case when rmse / pure < 1.2 then 'close' when rmse / pure < 2 then 'reasonable' else 'exceeds' end as verdict from m, p""")
def _(spark, d):
    data, m = _simple(spark, d)
    found = validation.error_comparison(mlr.replicates(data, ["l_quantity"], "l_extendedprice"), m)
    return found.select((F.round("rmse", 3) + 0.0).alias("rmse"), (F.round("experimental", 3) + 0.0).alias("experimental"), (F.round("ratio", 6) + 0.0).alias("ratio"), "verdict")


@query("q_term_table", "select * from (values ('Intercept', 'intercept', '#808080'), ('a', 'linear', '#DC143C'), ('b', 'linear', '#DC143C'), ('a*b', 'interaction', '#32CD32'), ('a^2', 'quadratic', '#00CED1'), ('b^2', 'quadratic', '#00CED1')) t(term, kind, colour)")
def _(spark, d):
    return validation.term_table(spark.range(1), mlr.term_names(["a", "b"]))


@query("t_interval_at_points", f"""{_FIT}, s as (select sqrt(sum((y - f) ** 2) / (any_value(n) - 2)) as s from e)
select p_partkey, p_size as l_quantity, {r('a + b * p_size', 3)} as predicted, {r('s * sqrt(1 / n + (p_size - m) ** 2 / sxx)', 3)} as std_error from part, f, s""")
def _(spark, d):
    _, m = _simple(spark, d)
    points = surface.with_interval(table(spark, d, "part").selectExpr("p_partkey", "p_size as l_quantity"), m)
    t = float(t_quantile(0.975, m.dof))
    return rounded(points.select("p_partkey", "l_quantity", F.col("l_extendedprice_predicted").alias("predicted"), (F.col("l_extendedprice_ci_semiwidth") / t).alias("std_error")), 3)


@query("t_target_share", f"select count(*) as n, count(*) filter (z - ci >= 52500 and z + ci <= 53700) as n_inside, {r('100.0 * count(*) filter (z - ci >= 52500 and z + ci <= 53700) / count(*)')} as percent from ({_CELLS2}) where response = 'price'")
def _(spark, d):
    _, models = _surfaces(spark, d)
    return rounded(surface.target_share(surface.surface(spark, models["price"], "q", "t", {}, steps=20), 52500.0, 53700.0))


@query("t_interpretation", f"""{_S}, g as (select 'price' as response, ix, iy, -1 + ix * 0.1 as x, -1 + iy * 0.1 as y, my + bq * (-1 + ix * 0.1 - mq) + bt * (-1 + iy * 0.1 - mt) as z from b, (select unnest(range(21)) as ix), (select unnest(range(21)) as iy))
select response, 'Maximize' as objective, {r('arg_max(x, z)', 3)} as x, {r('arg_max(y, z)', 3)} as y, {r('max(z)', 3)} as z from g group by response""")
def _(spark, d):
    _, models = _surfaces(spark, d)
    both = surface.surfaces(spark, models, "q", "t", {}, steps=20)
    return rounded(surface.interpretation(both, {"price": ("Maximize", 0.0, 0.0)}).drop("ci"), 3)


@query("n_loading_contributions", f"with c as (select corr(l_quantity, l_extendedprice) as c from lineitem) select variable, {r('1 / sqrt(2.0)', 2)} as magnitude from (values ('l_quantity'), ('l_extendedprice')) t(variable), c")
def _(spark, d):
    data = table(spark, d, "lineitem")
    return rounded(pca.loading_contributions(data, pca.fit(data, _TWO, 2, scale=True)).select("variable", "magnitude"), 2)


@query("n_interpretation")
def _(spark, d):
    data = table(spark, d, "lineitem").withColumn("row_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return pca.interpreted(data, pca.fit(data, V, 2, scale=True), "row_id")


@query("n_limits")
def _(spark, d):
    data = table(spark, d, "lineitem")
    return pca.limits(data, pca.fit(data, V, 2, scale=True), joint=True)


@query("o_control_series", f"""with s as (select avg(p_size) as m1, stddev_pop(p_size) as s1, avg(p_retailprice) as m2, stddev_pop(p_retailprice) as s2, corr(p_size, p_retailprice) as c, count(*)::double as n from part), z as (select p_partkey, (p_size - m1) / s1 as a, (p_retailprice - m2) / s2 as b, c, n from part, s)
select p_partkey, row_number() over (order by p_partkey)::bigint as sample, {r('(a * a + b * b - 2 * c * a * b) / (1 - c * c) * (n - 1) / n', 5)} as t2 from z""")
def _(spark, d):
    data = table(spark, d, "part")
    return rounded(charts.control_series(data, monitor.fit(data, ["p_size", "p_retailprice"], 2), "p_partkey").select("p_partkey", "sample", "t2"), 5)


@query("e_overall_summary", f"select count(*)::bigint as count, {r('list_avg([' + ', '.join(f'avg({c})' for c in V) + '])', 4)} as mean, {r('list_avg([' + ', '.join(f'stddev_samp({c})' for c in V) + '])', 4)} as std, {r('least(' + ', '.join(f'min({c})' for c in V) + ')', 4)} as min, {r('greatest(' + ', '.join(f'max({c})' for c in V) + ')', 4)} as max from lineitem where l_returnflag = 'R'")
def _(spark, d):
    return rounded(select.overall_summary(table(spark, d, "lineitem").where("l_returnflag = 'R'"), V), 4)


@query("l_dummies_but_last", "select o_orderkey, " + ", ".join(f"""(o_orderstatus is not null and o_orderstatus = '{s}')::int as "o_orderstatus_{s}\"""" for s in ("F", "O")) + " from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *[e.alias(n) for n, e in encode.dummies_but_last("o_orderstatus", ["F", "O", "P"]).items()])


@query("i_coding_table", union([f"select '{c}' as variable, min({c})::double as real_min, max({c})::double as real_max, {r(f'(min({c}) + max({c})) / 2', 6)} as real_center, {r(f'(max({c}) - min({c})) / 2', 6)} as real_range, -1.0::double as coded_min, 1.0::double as coded_max from lineitem" for c in V]))
def _(spark, d):
    data = table(spark, d, "lineitem")
    ends = data.agg(*[f(c) for c in V for f in (F.min, F.max)]).first()
    return rounded(encode.coding_table(spark, {c: (ends[2 * i], ends[2 * i + 1]) for i, c in enumerate(V)}))


_COLOURS = list(scalars.NAMED_COLOURS)


@query("i_category_colours", f"select category, coalesce([{', '.join(repr(c) for c in _COLOURS)}][n], 'hsl(' || ((n - 1) * 137 % 360) || ', 70%, 50%)') as colour from (select p_type as category, row_number() over (order by p_type) as n from (select distinct p_type from part where p_type is not null))")
def _(spark, d):
    return charts.category_colours(table(spark, d, "part"), "p_type")


@query("i_rgba", "select n_name, case when n_nationkey % 2 = 0 then 'rgba(0, 0, 128, 0.5)' else 'rgba(128, 128, 128, 0.5)' end as colour from nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_name", scalars.rgba(F.when(F.col("n_nationkey") % 2 == 0, "Navy").otherwise(F.col("n_name"))).alias("colour"))


@query("i_order_colours", "select n_nationkey, 'rgb(' || floor(n_nationkey / 24.0::double * 255)::int || ',0,' || floor((1 - n_nationkey / 24.0::double) * 255)::int || ')' as colour from nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", scalars.order_colour(F.col("n_nationkey"), 25).alias("colour"))


@query("w_trajectory_style", f"select n_nationkey as position, {r('case when n_nationkey < 24 then 1.5 + n_nationkey / 23.0::double * 1.5 end')} as width, {r('case when n_nationkey = 24 then 6 else 3 + n_nationkey / 23.0::double * 3 end')} as size from nation")
def _(spark, d):
    return rounded(charts.trajectory_style(table(spark, d, "nation").selectExpr("n_nationkey as position"), 25).select("position", "width", "size"))


@query("w_shaded_profiles", f"""with s as (select p_partkey, p_size, p_retailprice, (p_size - min(p_size) over ()) / (max(p_size) over () - min(p_size) over ())::double as shade from part)
select p_partkey, {r('shade')} as shade, 'p_size' as variable, p_size::double as value from s union all select p_partkey, {r('shade')}, 'p_retailprice', p_retailprice from s""")
def _(spark, d):
    found = charts.shaded_profiles(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"], "p_size")
    return rounded(found.select("p_partkey", "shade", "variable", F.col("value").cast("double").alias("value")))


@query("w_scatter_points", "select o_orderkey as x, o_totalprice as y, o_orderstatus as colour, true as categorical from orders where o_totalprice is not null")
def _(spark, d):
    return charts.scatter_points(table(spark, d, "orders"), "o_orderkey", "o_totalprice", "o_orderstatus")


@query("w_pair_ranges", union([f"select '{c}' as variable, {r(f'min({c}) - (max({c}) - min({c})) * 0.05', 4)} as low, {r(f'max({c}) + (max({c}) - min({c})) * 0.05', 4)} as high from lineitem where {' and '.join(f'{v} is not null' for v in V)}" for c in V]))
def _(spark, d):
    return rounded(charts.pair_ranges(table(spark, d, "lineitem"), V), 4)


@query("w_residuals_by_order", f"""with f as (select regr_slope(p_retailprice, p_size) as b, regr_intercept(p_retailprice, p_size) as a from part), e as (select p_partkey, p_retailprice - a - b * p_size as e from part, f)
select p_partkey, row_number() over (order by p_partkey)::bigint as position, {r('e', 4)} as residual, {r('-stddev_pop(e) over ()', 4)} as low, {r('stddev_pop(e) over ()', 4)} as high, {r('max(abs(e)) over ()', 4)} as largest from e""")
def _(spark, d):
    data = table(spark, d, "part")
    found = mlr.diagnostics(data, mlr.fit(data, "p_retailprice", ["Intercept", "p_size"]), ["p_partkey"])
    return rounded(charts.residuals_by_order(found, "p_partkey"), 4)


@query("b_loadings")
def _(spark, d):
    data = table(spark, d, "lineitem")
    return reports.pca_tables(data, pca.fit(data, V, 2, scale=True), ["l_orderkey", "l_linenumber"])["Loadings"]


@query("m_robust_correlation")
def _(spark, d):
    names = ["p_size", "p_retailprice"]
    found = bivariate.robust_covariance(table(spark, d, "part"), names)
    return spark.createDataFrame([(*names, float(found["correlation"][0, 1]), found["outliers"])], "v1 string, v2 string, r double, outliers bigint")
