"""Queries over whole tables for the driver's contract, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagwright.operators import graph_frames as gf
from dagwright.operators.dataset import Data, finite, rank_scores
from dagwright.operators.independence import DataTest
from dagwright.plans.constraint import adjacency_search, fci_stable, pag, pc_stable, step_up
from dagwright.plans.coxmgm import coxmgm, coxmgm_path
from dagwright.plans.graph import CPDAG, DAG, PAG, Graph, cpdag, from_matrix, graph_of
from dagwright.plans.knowledge import Knowledge
from dagwright.plans.mgm import mgm, mgm_path
from dagwright.plans.resample import bootstrap, draws, held_out_loglik, mgm_cv, search_cv, split, stars, steps, subsample_size
from dagwright.plans.score import DegenerateGaussian, RegressionBic, boss, grasp, grow_shrink_mb
from dagwright.plans.simulate import sim_random_dag

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Columns of the continuous frame, in the order of their names.
NUMBERS = ("disc", "net", "price", "qty", "tax")
NUMBERS_SQL = "select l_discount as disc, l_extendedprice * (1 - l_discount) as net, l_extendedprice as price, l_quantity as qty, l_tax as tax from lineitem"
#: Two small graphs for graph algebra: a directed one and a guess of it.
TRUTH = ("a --> c", "b --> c", "c --> d", "d --> e", "b --> e", "f --> e", "a --> f")
GUESS = ("a --> c", "b --> c", "c --> d", "d --- e", "e --> b", "f --> e", "b --> f")
NODES = tuple("abcdef")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "lineitem")
    return t.select(F.col("l_discount").alias("disc"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), F.col("l_tax").alias("tax"))


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "lineitem")
    return t.select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


def edges_of(spark: SparkSession, lines: tuple[str, ...], kind: str) -> DataFrame:
    return graph_of(list(NODES), lines, kind).frame(spark)


def edge_sql(lines: tuple[str, ...]) -> str:
    rows = []
    for line in lines:
        a, op, b = line.split()
        rows.append(f"('{a}', '-', '{'>' if op == '-->' else '-'}', '{b}')")
    return f"(values {', '.join(rows)}) g(node1, ep1, ep2, node2)"


def graph_rows(spark: SparkSession, g: Graph) -> DataFrame:
    return g.frame(spark)


@query("select count(*) as n, count(distinct o_orderstatus) as levels from orders where o_orderkey is not null and o_totalprice is not null and isfinite(o_totalprice) and o_orderstatus is not null")
def drop_missing(spark, sf_dir):
    t = finite(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"))
    return t.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderstatus").alias("levels"))


@query("select l_returnflag as level, cast(dense_rank() over (order by l_returnflag) - 1 as bigint) as code, count(*) as n from lineitem group by l_returnflag")
def level_codes(spark, sf_dir):
    """Levels of a data set's variable, and their rows from its moments."""
    d = Data(mixed(spark, sf_dir).select("qty", "flag"))
    ones = [d.gram()[0, c + 1] for c in d.columns["flag"]]
    counts = [d.n - sum(ones), *ones]
    return spark.createDataFrame([(x, i, int(n)) for i, (x, n) in enumerate(zip(d.variables[1].levels, counts, strict=True))], "level string, code long, n long")


@query("select l_orderkey, l_linenumber, case when l_returnflag = 'N' then 1.0::double else 0 end as \"flagMULTINOM.N\", case when l_returnflag = 'R' then 1.0::double else 0 end as \"flagMULTINOM.R\" from lineitem")
def dummies(spark, sf_dir):
    """A data set's design columns, not held locally."""
    t = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"))
    d = Data(t, check=False, local_cells=0)
    kinds = {c: t.schema[c].dataType for c in t.columns if c in d.labels}
    return d.design.select(*[F.col("x")[i].cast(kinds.get(c, "double")).alias(c) for i, c in enumerate(d.labels)])


@query("with r as (select o_totalprice as v, rank() over (order by o_totalprice) as r, count(*) over (partition by o_totalprice) as c, count(*) over () as n from orders) select distinct v, round((r + (c - 1) / 2.0) / (n + 1), 9) as p from r")
def npn_scores(spark, sf_dir):
    t = read(spark, sf_dir, "orders")
    return rank_scores(t, "o_totalprice", t.count()).select(F.col("_v").alias("v"), F.round("_p", 9).alias("p"))


@query(" union all ".join(f"select '{c}' as name, round(avg({c}), 3) as mean, round(stddev_samp({c}), 3) as sd from ({NUMBERS_SQL})" for c in NUMBERS))
def standardized(spark, sf_dir):
    """What a mixed graphical model takes from its columns before it is fitted, of data that pass the variance check."""
    from dagwright.plans.mgm import Mgm

    m = Mgm(Data(numbers(spark, sf_dir)))
    return spark.createDataFrame([(c, round(float(a), 3), round(float(b), 3)) for c, a, b in zip(m.xs, m.mean, m.sd, strict=True)], "name string, mean double, sd double")


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from ({NUMBERS_SQL})" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def correlations(spark, sf_dir):
    """All pairs from one pass of moments."""
    d = Data(numbers(spark, sf_dir))
    s = d.covariance()
    rows = [(a, b, round(float(s[i, j] / (s[i, i] * s[j, j]) ** 0.5), 6)) for i, a in enumerate(NUMBERS) for j, b in enumerate(NUMBERS) if i < j]
    return spark.createDataFrame(rows, "a string, b string, r double")


@query(f"select round(regr_slope(price, qty), 4) as slope, round(regr_intercept(price, qty), 3) as intercept, round(regr_r2(price, qty), 6) as r2, count(*) as n from ({NUMBERS_SQL})")
def least_squares(spark, sf_dir):
    from dagwright.functions.regression import ols

    d = Data(numbers(spark, sf_dir))
    fit = ols(d.gram(), d.n, d.columns["price"][0], d.columns["qty"])
    return spark.createDataFrame([(round(float(fit.coef[1]), 4), round(float(fit.coef[0]), 3), round(float(fit.r2), 6), d.n)], "slope double, intercept double, r2 double, n long")


DEPTH_SQL = " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r, count(*) as n from ({NUMBERS_SQL})" for a in NUMBERS for b in NUMBERS if a != b)
DEPTH_SQL = f"""
with c as ({DEPTH_SQL}), g as (select * from c where abs(r) * sqrt(n - 2) / sqrt(1 - r * r) > 4),
p as (select x.a, x.b, abs((x.r - u.r * v.r) / sqrt((1 - u.r * u.r) * (1 - v.r * v.r))) as r, x.n from g x join c u on u.a = x.a join c v on v.a = x.b and v.b = u.b
  where u.b <> x.b and (exists (select 1 from g k where k.a = x.a and k.b = u.b) or exists (select 1 from g k where k.a = x.b and k.b = u.b)))
select a as node1, b as node2 from g where a < b and not exists (select 1 from p where p.a = g.a and p.b = g.b and p.r * sqrt(p.n - 3) / sqrt(1 - p.r * p.r) <= 4)
"""


@query(DEPTH_SQL)
def pairs_given_one(spark, sf_dir):
    """The stable adjacency search to depth 1: partial correlations given each neighbour."""
    from dagwright.functions.distributions import t_two_sided

    d = Data(numbers(spark, sf_dir))
    g, _ = adjacency_search(DataTest(d), t_two_sided(4.0, d.n - 3), depth=1)
    return g.frame(spark).select("node1", "node2")


@query("with g as (select l_returnflag as f, count(*) as n, avg(l_discount) as m from lineitem group by 1), t as (select avg(l_discount) as m, count(*) as n, var_pop(l_discount) * count(*) as tss from lineitem), b as (select sum(g.n * (g.m - t.m) * (g.m - t.m)) as ss from g, t) select 'disc' as x, 'flag' as y, round(pow(1 + 2 * ((ss / 2) / ((tss - ss) / (n - 3))) / (n - 3), -(n - 3) / 2.0), 7) as p from b, t")
def mixed_test(spark, sf_dir):
    """The p value of a continuous and a three-level variable; the F tail of two degrees of freedom has a closed form."""
    p = DataTest(Data(mixed(spark, sf_dir).select("disc", "flag"))).p_values([("disc", "flag", ())])[0]
    return spark.createDataFrame([("disc", "flag", round(p, 7))], "x string, y string, p double")


@query("with t as (select l_discount as y, l_tax as x, l_returnflag as f from lineitem), w as (select sum(n * vy) as syy, sum(n * c) as sxy, sum(n * vx) as sxx from (select count(*) as n, var_pop(y) as vy, var_pop(x) as vx, covar_pop(x, y) as c from t group by f)), a as (select count(*) as n, count(*) * var_pop(y) as syy, count(*) * covar_pop(x, y) as sxy, count(*) * var_pop(x) as sxx from t), r as (select w.syy - w.sxy * w.sxy / w.sxx as full_rss, a.syy - a.sxy * a.sxy / a.sxx as less_rss, n from w, a) select round(pow(1 + 2 * (((less_rss - full_rss) / 2) / (full_rss / (n - 4))) / (n - 4), -(n - 4) / 2.0), 7) as p from r")
def mixed_test_given_one(spark, sf_dir):
    """The same given a continuous third variable."""
    t = read(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"))
    return spark.createDataFrame([(round(DataTest(Data(t)).p_values([("disc", "flag", ("tax",))])[0], 7),)], "p double")


@query("with g as (select l_returnflag as f, count(*) as n, avg(l_quantity) as m from lineitem group by 1), t as (select avg(l_quantity) as m, count(*) as n, var_pop(l_quantity) * count(*) as tss from lineitem), b as (select sum(g.n * (g.m - t.m) * (g.m - t.m)) as ss, count(*) as k from g, t) select round((ss / (k - 1)) / ((tss - ss) / (n - k)), 6) as f, k - 1 as df1, n - k as df2 from b, t")
def anova_f(spark, sf_dir):
    from dagwright.functions.regression import nested_f

    d = Data(mixed(spark, sf_dir).select("qty", "flag"))
    own = d.columns["flag"]
    return spark.createDataFrame([(round(nested_f(d.gram(), d.n, d.columns["qty"][0], own, [])[0], 6), len(own), d.n - 1 - len(own))], "f double, df1 long, df2 long")


@query("with e as (select event_type as a, value > 10 as b from events where value is not null), c as (select a, b, count(*)::double as o from e group by 1, 2), m as (select c.*, sum(o) over (partition by a) * sum(o) over (partition by b) / sum(o) over () as e from c), x as (select sum(o * ln(o / e)) as half, (count(distinct a) - 1) as df from m) select round(exp(-half) * (1 + half), 6) as p, df from x")
def contingency_test(spark, sf_dir):
    """The likelihood-ratio test of a two-level and a five-level variable by logistic fits; its tail of four degrees of freedom has a closed form."""
    t = read(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("a"), (F.col("value") > 10).alias("b"))
    d = Data(t)
    return spark.createDataFrame([(round(DataTest(d).p_values([("a", "b", ())])[0], 6), len(d.columns["a"]) * len(d.columns["b"]))], "p double, df long")


@query("with c as (%s) select a as target, b as parent, round(n * ln(1 - r * r) + ln(n), 4) as score from c" % " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r, count(*) as n from ({NUMBERS_SQL})" for a in ("qty", "tax") for b in ("disc", "price")))
def dg_scores(spark, sf_dir):
    s = DegenerateGaussian(Data(numbers(spark, sf_dir)), penalty=1.0)
    return spark.createDataFrame([(a, b, round(float(s.local(a, frozenset({b}))), 4)) for a in ("qty", "tax") for b in ("disc", "price")], "target string, parent string, score double")


STEP_SQL = "with p as (select n_nationkey, n_name, (n_nationkey * 7 % 25 + 1) / 400.0::double as p, count(*) over () as m from nation), r as (select *, row_number() over (order by p, n_nationkey) as i from p), k as (select coalesce(max(i), 0) as k from r where p <= {level} * i / m) select n_nationkey, i <= k as rejected from r, k"


@query(STEP_SQL.format(level="0.3"))
def fdr_step_up(spark, sf_dir):
    """Benjamini and Hochberg's rule as the adjacency search applies it, to a p value for each nation."""
    p = {r.n_nationkey: (r.n_nationkey * 7 % 25 + 1) / 400.0 for r in read(spark, sf_dir, "nation").collect()}  # 25 rows at any size
    kept = step_up(p, 0.3, len(p), False)
    return spark.createDataFrame([(int(k), k not in kept) for k in p], "n_nationkey int, rejected boolean")


@query(STEP_SQL.format(level="(0.9 / (select sum(1.0 / (i + 1)) from range(25) t(i)))"))
def fdr_step_up_dependent(spark, sf_dir):
    """Benjamini and Yekutieli's rule."""
    p = {r.n_nationkey: (r.n_nationkey * 7 % 25 + 1) / 400.0 for r in read(spark, sf_dir, "nation").collect()}
    kept = step_up(p, 0.9, len(p), True)
    return spark.createDataFrame([(int(k), k not in kept) for k in p], "n_nationkey int, rejected boolean")


@query(" union all ".join(f"select '{a}' as node1, '{b}' as node2 from (select corr({a}, {b}) as r, count(*) as n from ({NUMBERS_SQL})) where abs(r) * sqrt(n - 2) / sqrt(1 - r * r) > 4" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def dependent_pairs(spark, sf_dir):
    from dagwright.functions.distributions import t_two_sided

    d = Data(numbers(spark, sf_dir))
    g, _ = adjacency_search(DataTest(d), t_two_sided(4.0, d.n - 2), depth=0)
    return g.frame(spark).select("node1", "node2")


@query("with c as (select l_returnflag as f, count(*)::double as n from lineitem group by 1), t as (select sum(n) as t from c), q as (select var_samp(l_quantity) * (count(*) - 1) / count(*) / var_samp(l_quantity) / 2 as half from lineitem) select round(sqrt(sum(n / t * (1 - n / t))), 9) as w, round(any_value(half) - sum(n / t * ln((n + 1) / (t + 3))), 7) as loss from c, t, q")
def mgm_start(spark, sf_dir):
    """The penalty weight of a discrete variable and the loss of a mixed graphical model without edges."""
    from dagwright.plans.mgm import Mgm

    m = Mgm(Data(mixed(spark, sf_dir).select("qty", "flag")))
    return spark.createDataFrame([(round(float(m.wd[0]), 9), round(m.smooth(m.first, slope=False)[0], 7))], "w double, loss double")


@query("with c as (%s) select round(max(abs(r)) * 2 * (max(n) - 1) / max(n), 6) as top from c" % " union all ".join(f"select corr({a}, {b}) as r, count(*) as n from ({NUMBERS_SQL})" for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]))
def mgm_largest_penalty(spark, sf_dir):
    """The least penalty that leaves no edge between continuous variables, from the gradient without edges."""
    from dagwright.plans.mgm import Mgm

    return spark.createDataFrame([(round(Mgm(Data(numbers(spark, sf_dir))).lambda_max(), 6),)], "top double")


@query("select count(*) as n, case when floor(10 * sqrt(count(*))) < count(*) then floor(10 * sqrt(count(*))) else floor(3 * count(*) / 4) end::bigint as size from lineitem")
def subsample_sizes(spark, sf_dir):
    n = read(spark, sf_dir, "lineitem").count()
    return spark.createDataFrame([(n, subsample_size(n))], "n long, size long")


@query(f"select distinct least(node1, node2) as node1, '-' as ep1, '-' as ep2, greatest(node1, node2) as node2 from {edge_sql(TRUTH)}")
def graph_skeleton(spark, sf_dir):
    return gf.skeleton(edges_of(spark, TRUTH, DAG))


V_SQL = f"select x.node1 as a, x.node2 as c, y.node1 as b from {edge_sql(TRUTH)} x join {edge_sql(TRUTH).replace(' g(', ' h(')} y on x.node2 = y.node2 and x.node1 < y.node1 where not exists (select 1 from {edge_sql(TRUTH).replace(' g(', ' k(')} where least(k.node1, k.node2) = x.node1 and greatest(k.node1, k.node2) = y.node1)"
V_SQL = V_SQL.replace(" g(node1, ep1, ep2, node2) x", " x(node1, ep1, ep2, node2)").replace(" h(node1, ep1, ep2, node2) y", " y(node1, ep1, ep2, node2)")


@query(V_SQL)
def graph_v_structures(spark, sf_dir):
    return gf.v_structures(edges_of(spark, TRUTH, DAG))


@query(f"select distinct least(node1, node2) as node1, '-' as ep1, '-' as ep2, greatest(node1, node2) as node2 from {edge_sql(TRUTH)} union select a, '-', '-', b from ({V_SQL})")
def graph_moral(spark, sf_dir):
    return gf.moral(edges_of(spark, TRUTH, DAG))


@query(f"with e as (select * from {edge_sql(TRUTH)}), m as (select node1 as u, node2 as v from e union select node2, node1 from e union select x.node1, y.node1 from e x join e y on x.node2 = y.node2 and x.node1 <> y.node1) select u as node, string_agg(v, ' ' order by v) as blanket from m group by u")
def graph_blankets(spark, sf_dir):
    return gf.markov_blankets(edges_of(spark, TRUTH, DAG)).select("node", F.array_join("blanket", " ").alias("blanket"))


@query(f"with recursive e as (select node1 as a, node2 as b from {edge_sql(TRUTH)}), r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a) select a as ancestor, b as node from r")
def graph_ancestors(spark, sf_dir):
    return gf.ancestors(edges_of(spark, TRUTH, DAG))


def pair_sql(lines: tuple[str, ...], x: str) -> str:
    return f"select least(node1, node2) as a, greatest(node1, node2) as b, case when node1 < node2 then ep1 else ep2 end as {x}a, case when node1 < node2 then ep2 else ep1 end as {x}b from {edge_sql(lines)}"


BOTH_SQL = f"with e as ({pair_sql(GUESS, 'e')}), t as ({pair_sql(TRUTH, 't')}), j as (select * from e full join t using (a, b))"


@query(BOTH_SQL + " select sum(1.0::double * case when ea is null then 1 + (ta || tb <> '--')::int when ta is null then 1 + (ea || eb <> '--')::int when ea = ta and eb = tb then 0 else 1 + (ea || eb <> '--' and ta || tb <> '--')::int end) as \"SHD\" from j")
def graph_shd(spark, sf_dir):
    return gf.shd(edges_of(spark, GUESS, CPDAG), edges_of(spark, TRUTH, CPDAG), CPDAG)


@query(BOTH_SQL + ", c as (select count(*) filter (ea is not null and ta is not null)::double as tp, count(*) filter (ta is null)::double as fp, count(*) filter (ea is null)::double as fn from j), d as (select *, 15 - tp - fp - fn as tn from c) select tp / (tp + fp) as \"adjPrecision\", tp / (tp + fn) as \"adjRecall\", 2 * tp / (2 * tp + fp + fn) as \"adjF1\", (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) as \"adjMCC\" from d")
def graph_adjacency_metrics(spark, sf_dir):
    return gf.adjacency_metrics(edges_of(spark, GUESS, CPDAG), edges_of(spark, TRUTH, CPDAG), len(NODES))


@query(BOTH_SQL + ", x as (select ea as e, ta as t from j where ea is not null and ta is not null union all select eb, tb from j where ea is not null and ta is not null), c as (select count(*) filter (e = '>' and t = '>')::double as tp, count(*) filter (e = '>' and t = '-')::double as fp, count(*) filter (e = '-' and t = '>')::double as fn, count(*) filter (e = '-' and t = '-')::double as tn from x) select tp / (tp + fp) as \"orientPrecision\", tp / (tp + fn) as \"orientRecall\", 2 * tp / (2 * tp + fp + fn) as \"orientF1\", (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) as \"orientMCC\" from c")
def graph_orientation_metrics(spark, sf_dir):
    return gf.orientation_metrics(edges_of(spark, GUESS, CPDAG), edges_of(spark, TRUTH, CPDAG))


@query(f"with e as (select node1 as a, node2 as b from {edge_sql(GUESS)} where ep2 = '>'), t as (select node1 as a, node2 as b from {edge_sql(TRUTH)}), c as (select count(*) filter (e.a is not null and t.a is not null)::double as tp, count(*) filter (t.a is null)::double as fp, count(*) filter (e.a is null)::double as fn from e full join t on e.a = t.a and e.b = t.b) select tp / (tp + fp) as \"causalPrecision\", tp / (tp + fn) as \"causalRecall\", 2 * tp / (2 * tp + fp + fn) as \"causalF1\" from c")
def graph_causal_metrics(spark, sf_dir):
    return gf.causal_metrics(edges_of(spark, GUESS, CPDAG), edges_of(spark, TRUTH, DAG))


@query(f"select node1 as source, node2 as target, case when ep2 = '>' then 'dir' else 'undir' end as interaction from {edge_sql(GUESS)}")
def graph_table(spark, sf_dir):
    return gf.graph_table(edges_of(spark, GUESS, CPDAG))


@query("with b as (select o_orderstatus as boot, corr(o_totalprice, o_custkey) as r1, corr(o_totalprice, o_orderkey) as r2, corr(o_custkey, o_orderkey) as r3 from orders group by 1), e as (select boot, 'cust' as var1, 'price' as var2 from b where r1 > 0 union all select boot, 'key', 'price' from b where r2 > 0 union all select boot, 'cust', 'key' from b where r3 > 0) select var1, var2, round(count(*) / 3.0::double, 6) as undir, round(1 - count(*) / 3.0::double, 6) as none, case when count(*) / 3.0 >= 0.5 then '---' else 'none' end as interaction from e group by 1, 2")
def ensemble_frequencies(spark, sf_dir):
    """Edges of three replicates, the orders of each status, and their ensemble."""
    t = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("boot")).agg(F.corr("o_totalprice", "o_custkey").alias("r1"), F.corr("o_totalprice", "o_orderkey").alias("r2"), F.corr("o_custkey", "o_orderkey").alias("r3"))
    e = t.select("boot", F.explode(F.array(*[F.struct(F.col(r).alias("r"), F.lit(a).alias("node1"), F.lit(b).alias("node2")) for r, a, b in (("r1", "cust", "price"), ("r2", "key", "price"), ("r3", "cust", "key"))])).alias("x")).where("x.r > 0")
    out = gf.ensemble(e.select("boot", "x.node1", F.lit("-").alias("ep1"), F.lit("-").alias("ep2"), "x.node2"), 3)
    return out.select("var1", "var2", F.round("undir", 6).alias("undir"), F.round("none", 6).alias("none"), "interaction")


RISK_SQL = "with e as (select event_type as s, round(value, 1) as t, (user_id % 3 <> 0)::int as e from events where value is not null), g as (select s, t, sum(e)::double as m, count(*) as n from e group by 1, 2), r as (select *, sum(n) over (partition by s order by t desc)::double as at_risk from g)"


@query(RISK_SQL + ", j as (select *, coalesce(list_sum(list_transform(range(m::bigint), lambda l: 1 / (at_risk - l))), 0) as jump from r), h as (select *, sum(jump) over (partition by s order by t) as hazard from j), x as (select e.s, e.e, e.e - hazard + e.e * case when m > 0 then at_risk * jump / m - 1 else 0 end as residual from e join h using (s, t)) select s, e, count(*) as n, round(sum(residual), 4) as total, round(sum(residual * residual), 4) as squares from x group by 1, 2")
def survival_residuals(spark, sf_dir):
    """Working residuals of a stratified censored variable, by passes over the rows."""
    t = read(spark, sf_dir, "events").where("value is not null")
    d = Data(t.select(F.struct(F.round("value", 1).alias("time"), (F.col("user_id") % 3 != 0).cast("int").alias("event"), F.col("event_type").alias("strata")).alias("T"), F.col("event_type").alias("s")), check=False, local_cells=0)
    levels, x = d.variables[1].levels, F.col("x")
    name = F.lit(levels[0])
    for level, c in zip(levels[1:], d.columns["s"], strict=True):
        name = F.when(x[c] == 1, level).otherwise(name)
    rows = d.design.select(name.alias("s"), x[1].cast("int").alias("e"), x[d.regressors["T"][0]].alias("r"))
    return rows.groupBy("s", "e").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r"), 4).alias("total"), F.round(F.sum(F.col("r") * F.col("r")), 4).alias("squares"))


@query(RISK_SQL + ", j as (select list_sum(list_transform(range(m::bigint), lambda l: ln(at_risk - l))) as x from r where m > 0) select round(-sum(x), 4) as loglik from j")
def cox_without_effects(spark, sf_dir):
    """The partial log-likelihood, with Efron's ties and strata, of the Cox model without regressors."""
    t = read(spark, sf_dir, "events").where("value is not null")
    d = Data(t.select(F.struct(F.round("value", 1).alias("time"), (F.col("user_id") % 3 != 0).cast("int").alias("event"), F.col("event_type").alias("strata")).alias("T")), check=False)
    return spark.createDataFrame([(round(d.cox("T", []).loglik, 4),)], "loglik double")


@query()
def pc_edges(spark, sf_dir):
    return graph_rows(spark, pc_stable(Data(mixed(spark, sf_dir)), alpha=0.01))


@query()
def pc_all_rules(spark, sf_dir):
    rules = ["majority", "maxp", "conservative", "sepsets"]
    out = [graph_rows(spark, g).withColumn("rule", F.lit(r)) for r, g in zip(rules, pc_stable(Data(mixed(spark, sf_dir)), rule=rules, alpha=0.01), strict=True)]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query()
def pc_fdr(spark, sf_dir):
    return graph_rows(spark, pc_stable(Data(mixed(spark, sf_dir)), alpha=0.05, fdr=True))


@query()
def fci_edges(spark, sf_dir):
    return graph_rows(spark, fci_stable(Data(mixed(spark, sf_dir)), alpha=0.01))


@query()
def npn_pc_edges(spark, sf_dir):
    return graph_rows(spark, pc_stable(Data(mixed(spark, sf_dir), rank=True), alpha=0.01))


@query()
def mgm_edges(spark, sf_dir):
    return graph_rows(spark, mgm(Data(mixed(spark, sf_dir)), 0.1))


@query()
def mgm_path_rows(spark, sf_dir):
    rows = mgm_path(Data(mixed(spark, sf_dir)), n_lambda=8)["rows"]
    return spark.createDataFrame([tuple(map(float, r.values())) for r in rows], "lambda double, loglik double, nParams double, AIC double, BIC double")


@query()
def mgm_cv_rows(spark, sf_dir):
    rows = mgm_cv(Data(mixed(spark, sf_dir)), [0.4, 0.2, 0.1], folds=3)["rows"]
    return spark.createDataFrame([(r["lambda"], r["mean"], r["se"]) for r in rows], "lambda double, mean double, se double")


@query()
def pc_cv_rows(spark, sf_dir):
    rows = search_cv(Data(mixed(spark, sf_dir)), alphas=(0.001, 0.05), rules=("majority", "maxp"), folds=3)["rows"]
    return spark.createDataFrame([(r["alpha"], r["orientRule"], r["mean"], r["se"], r["size"]) for r in rows], "alpha double, orientRule string, mean double, se double, size double")


@query()
def bootstrap_stabilities(spark, sf_dir):
    return bootstrap(Data(mixed(spark, sf_dir)), lambda d: pc_stable(d, alpha=0.01), number=5)[1]


@query()
def pc_stars_rows(spark, sf_dir):
    rows = stars(Data(mixed(spark, sf_dir)), [0.001, 0.01, 0.05], number=5)["rows"]
    return spark.createDataFrame([(r["alpha"], float(r["instability"])) for r in rows], "alpha double, instability double")


@query()
def steps_rows(spark, sf_dir):
    rows = steps(Data(mixed(spark, sf_dir)), [0.4, 0.2, 0.1], number=4)["rows"]
    return spark.createDataFrame([(r["lambda"], *map(float, r["instability"])) for r in rows], "lambda double, cc double, cd double, dd double")


@query()
def grow_shrink_rows(spark, sf_dir):
    d = Data(mixed(spark, sf_dir))
    return spark.createDataFrame([(v, " ".join(grow_shrink_mb(d, v))) for v in d.names()], "target string, blanket string")


@query()
def boss_edges(spark, sf_dir):
    return graph_rows(spark, boss(Data(mixed(spark, sf_dir))))


@query()
def grasp_edges(spark, sf_dir):
    return graph_rows(spark, grasp(Data(mixed(spark, sf_dir)), num_starts=2))


BIC_SQL = f"with m as (select *, l_returnflag as flag from (select l_discount as disc, l_extendedprice as price, l_quantity as qty, l_returnflag from lineitem)), t as (select count(*) as n, var_pop(qty) * count(*) as tss from m), b as (select sum(g.n * (g.a - t.a) * (g.a - t.a)) as ss from (select flag, count(*) as n, avg(qty) as a from m group by 1) g, (select avg(qty) as a from m) t)"


@query(BIC_SQL + " select 'qty' as target, 'flag' as parent, round(n * ln(1 - ss / tss) + 2 * ln(n), 4) as score from b, t" + "".join(f" union all select '{a}', '{b}', round(n * ln(1 - r * r) + ln(n), 4) from (select corr({a}, {b}) as r, count(*) as n from m)" for a, b in (("qty", "price"), ("price", "disc"), ("disc", "qty"))))
def bic_scores(spark, sf_dir):
    s = RegressionBic(Data(mixed(spark, sf_dir).select("disc", "price", "qty", "flag")), penalty=1.0)
    return spark.createDataFrame([(a, b, round(float(s.local(a, frozenset({b}))), 4)) for a, b in (("qty", "flag"), ("qty", "price"), ("price", "disc"), ("disc", "qty"))], "target string, parent string, score double")


def blanket_sql(y: str, a: str, b: str) -> str:
    """Grow-shrink over two candidates: the better one if it helps, the other if it helps too, then the first away if it no longer does."""
    r2 = "((ra * ra + rb * rb - 2 * ra * rb * ab) / (1 - ab * ab))"
    return f"""select '{y}' as target, case when least(sa, sb) >= 0 then '' when sab < least(sa, sb) then (case when least(sa, sb) < sab then '' else '{min(a, b)} {max(a, b)}' end) when sa <= sb then '{a}' else '{b}' end as blanket
from (select n * ln(1 - ra * ra) + ln(n) as sa, n * ln(1 - rb * rb) + ln(n) as sb, n * ln(1 - {r2}) + 2 * ln(n) as sab from (select corr({y}, {a}) as ra, corr({y}, {b}) as rb, corr({a}, {b}) as ab, count(*) as n from ({NUMBERS_SQL})))"""


@query(" union all ".join(blanket_sql(*x) for x in (("disc", "price", "qty"), ("price", "disc", "qty"), ("qty", "disc", "price"))))
def blankets_of_three(spark, sf_dir):
    """Markov boundaries by grow-shrink among three continuous variables."""
    d = Data(numbers(spark, sf_dir).select("disc", "price", "qty"))
    return spark.createDataFrame([(v, " ".join(grow_shrink_mb(d, v))) for v in d.names()], "target string, blanket string")


HELD_SQL = "with t as (select l_extendedprice as y, l_quantity as x, l_tax as tax, (l_quantity::bigint % 3 + 1)::int as k from lineitem)"


@query(HELD_SQL + " select f.k as fold, round(-count(*) / 2.0 * ln(sum((y - b0 - b1 * x) * (y - b0 - b1 * x)) / count(*)), 2) as loglik, count(*) as n from t join (select i::int as k, (select regr_slope(y, x) from t where t.k <> i) as b1, (select regr_intercept(y, x) from t where t.k <> i) as b0 from range(1, 4) r(i)) f using (k) group by f.k")
def held_out_scores(spark, sf_dir):
    """What cross-validation of a search scores: fits on training rows, likelihoods of test rows, folds by a given column."""
    d = Data(numbers(spark, sf_dir))
    folds = split(d, F.pmod(F.col("qty").cast("long"), F.lit(3)) + 1)
    return spark.createDataFrame([(k, round(held_out_loglik(a, b, "price", ["qty"]), 2), b.n) for k, (a, b) in enumerate(folds, 1)], "fold int, loglik double, n long")


@query("select 3 as number, case when floor(10 * sqrt(count(*))) < count(*) then floor(10 * sqrt(count(*))) else floor(3 * count(*) / 4) end::bigint as size from lineitem")
def subsample_rows(spark, sf_dir):
    """The rows of three subsamples, which are of one size."""
    parts = draws(Data(numbers(spark, sf_dir)), 3, None, seed=1)
    return spark.createDataFrame([(len(parts), d.n) for d in parts[:1] if len({d.n for d in parts}) == 1], "number int, size long")


@query()
def simulated_pc_metrics(spark, sf_dir):
    df, g = sim_random_dag(spark, n=2000, p=8, degree=2, seed=43)
    est, truth = pc_stable(Data(df), alpha=0.01), cpdag(g)
    return gf.all_metrics(est.frame(spark), truth.frame(spark), len(g.nodes), CPDAG)


@query()
def graph_pag(spark, sf_dir):
    return graph_rows(spark, pag(graph_of(list(NODES), TRUTH, DAG), ["b"]))


#: Arrows into c and e are colliders, c - d follows since a and d are apart, and a - f may go either way.
@query("select * from (values ('a', '-', '>', 'c'), ('b', '-', '>', 'c'), ('c', '-', '>', 'd'), ('d', '-', '>', 'e'), ('b', '-', '>', 'e'), ('f', '-', '>', 'e'), ('a', '-', '-', 'f')) g(node1, ep1, ep2, node2)")
def graph_cpdag(spark, sf_dir):
    return graph_rows(spark, cpdag(graph_of(list(NODES), TRUTH, DAG)))


def survival_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(F.struct(F.col("value").alias("time"), (F.col("event_type") != "click").cast("int").alias("event")).alias("T"), F.hour("ts").cast("double").alias("hour"), F.col("user_id").cast("double").alias("user"))


@query()
def survival_tests(spark, sf_dir):
    """Independence of event times (a click ends observation) from the hour and the user, given each other."""
    tests = [("T", "hour", ()), ("T", "user", ()), ("T", "hour", ("user",)), ("hour", "user", ())]
    p = DataTest(Data(survival_frame(spark, sf_dir))).p_values(tests)
    return spark.createDataFrame([(x, y, " ".join(z), float(v)) for (x, y, z), v in zip(tests, p, strict=True)], "x string, y string, z string, p double")


@query()
def coxmgm_edges(spark, sf_dir):
    return graph_rows(spark, coxmgm(Data(survival_frame(spark, sf_dir)), 0.001))


@query()
def coxmgm_path_rows(spark, sf_dir):
    rows = coxmgm_path(Data(survival_frame(spark, sf_dir)), [0.1, 0.01, 0.001])["rows"]
    return spark.createDataFrame([tuple(map(float, r.values())) for r in rows], "lambda double, loglik double, nParams double, AIC double, BIC double")


@query()
def fci_stars_rows(spark, sf_dir):
    rows = stars(Data(mixed(spark, sf_dir)), [0.001, 0.05], number=3, search="fci")["rows"]
    return spark.createDataFrame([(r["alpha"], float(r["instability"])) for r in rows], "alpha double, instability double")


@query()
def mgm_fci_cv_rows(spark, sf_dir):
    rows = search_cv(Data(mixed(spark, sf_dir)), alphas=(0.01,), lambdas=[0.2, 0.1], folds=2, search="fci")["rows"]
    return spark.createDataFrame([(r["lambda"], r["alpha"], r["orientRule"], r["mean"], r["se"], r["size"]) for r in rows], "lambda double, alpha double, orientRule string, mean double, se double, size double")


@query("select k::int as fold, (floor(n * k / 5.0) - floor(n * (k - 1) / 5.0))::bigint as n from (select count(*) as n from lineitem), range(1, 6) r(k)")
def folds(spark, sf_dir):
    return spark.createDataFrame([(k, b.n) for k, (_, b) in enumerate(split(Data(mixed(spark, sf_dir)), 5), 1)], "fold int, n long")


def region_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed graph of the data: suppliers point at nations, nations at regions."""
    s, n = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("node1"), F.lit("-").alias("ep1"), F.lit(">").alias("ep2"), F.concat(F.lit(b), F.col(y).cast("string")).alias("node2"))
    return edge(s, "s", "s_suppkey", "n", "s_nationkey").union(edge(n, "n", "n_nationkey", "r", "n_regionkey"))


REGION_SQL = "e as (select 's' || s_suppkey as a, 'n' || s_nationkey as b from supplier union all select 'n' || n_nationkey, 'r' || n_regionkey from nation)"


@query(f"with recursive {REGION_SQL}, r as (select a, b from e union select r.a, e.b from r join e on r.b = e.a) select a as ancestor, b as node from r")
def region_ancestors(spark, sf_dir):
    return gf.ancestors(region_edges(spark, sf_dir))


@query(f"with {REGION_SQL} select x.a as a, x.b as c, y.a as b from e x join e y on x.b = y.b and x.a < y.a")
def region_v_structures(spark, sf_dir):
    return gf.v_structures(region_edges(spark, sf_dir))


@query(f"with {REGION_SQL}, m as (select a as u, b as v from e union select b, a from e) select u as node, count(*) as neighbors, string_agg(v, ' ' order by v) as names from m group by u")
def region_neighbors(spark, sf_dir):
    return gf.neighbors(region_edges(spark, sf_dir)).select("node", F.size("neighbors").cast("long").alias("neighbors"), F.array_join("neighbors", " ").alias("names"))


@query(f"with {REGION_SQL}, m as (select a as u, b as v from e union select b, a from e union select x.a, y.a from e x join e y on x.b = y.b and x.a <> y.a) select u as node, string_agg(v, ' ' order by v) as blanket from m group by u")
def region_blankets(spark, sf_dir):
    return gf.markov_blankets(region_edges(spark, sf_dir)).select("node", F.array_join("blanket", " ").alias("blanket"))


@query(f"with {REGION_SQL}, m as (select least(a, b) as a, greatest(a, b) as b from e union select x.a, y.a from e x join e y on x.b = y.b and x.a < y.a) select a as node1, '-' as ep1, '-' as ep2, b as node2 from m")
def region_moral(spark, sf_dir):
    return gf.moral(region_edges(spark, sf_dir))


#: Two partial ancestral graphs over the nodes of TRUTH but b, an estimate and a true one.
PAG_TRUTH = ("a o-> c", "c --> d", "d --> e", "f o-> e", "a o-o f", "c o-> e")
PAG_GUESS = ("a --> c", "c o-> d", "e --> d", "f --> e", "a o-o f", "c <-> e")


def mark_sql(lines: tuple[str, ...]) -> str:
    marks = {"-->": "->", "o->": "o>", "o-o": "oo", "<->": ">>"}
    rows = [(a, marks[op], b) for a, op, b in map(str.split, lines)]
    return ", ".join(f"('{min(a, b)}', '{max(a, b)}', '{m[a > b]}', '{m[a < b]}')" for a, m, b in rows)


PAG_SQL = f"""
with recursive g(a, b, ea, eb) as (values {mark_sql(PAG_GUESS)}), t(a, b, ta, tb) as (values {mark_sql(PAG_TRUTH)}), d as (select node1 as a, node2 as b from {edge_sql(TRUTH)}),
r as (select a, b from d union select r.a, d.b from r join d on r.b = d.a),
x as (select a as v, b as u, ea as e, ta as t from g join t using (a, b) union all select b, a, eb, tb from g join t using (a, b)),
y as (select *, exists (select 1 from r where r.a = x.v and r.b = x.u) as up from x),
c as (select sum(case when e = '>' and (t = '>' or t = 'o' and not up) then 1 when e = 'o' and t = 'o' then 0.5 else 0 end)::double as tp,
  sum(case when e = '-' and (t = '-' or t = 'o' and up) then 1 when e = 'o' and t = 'o' then 0.5 else 0 end)::double as tn,
  sum(case when e = '>' and (t = '-' or t = 'o' and up) then 1 when e = 'o' and t = '-' then 0.5 else 0 end)::double as fp,
  sum(case when e = '-' and (t = '>' or t = 'o' and not up) then 1 when e = 'o' and t = '>' then 0.5 else 0 end)::double as fn from y)
select tp / (tp + fp) as "orientPrecision", tp / (tp + fn) as "orientRecall", 2 * tp / (2 * tp + fp + fn) as "orientF1", (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) as "orientMCC" from c
"""


@query(PAG_SQL)
def graph_pag_orientation(spark, sf_dir):
    nodes = [v for v in NODES if v != "b"]
    est, truth = (graph_of(nodes, x, PAG).frame(spark) for x in (PAG_GUESS, PAG_TRUTH))
    return gf.orientation_metrics(est, truth, PAG, edges_of(spark, TRUTH, DAG))


@query("with t as (select n_name, n_regionkey as tier from nation) select x.n_name as a, y.n_name as b, x.tier > y.tier or x.tier = y.tier and x.tier % 2 = 1 as forbidden from t x join t y on x.n_name <> y.n_name")
def knowledge_pairs(spark, sf_dir):
    """Nations in tiers by region, without edges within every other one: which edges are forbidden."""
    tiers: dict[int, list[str]] = {}
    for r in read(spark, sf_dir, "nation").select("n_name", "n_regionkey").collect():  # 25 rows at any size
        tiers.setdefault(r.n_regionkey, []).append(r.n_name)
    k = Knowledge(tiers=[tiers[i] for i in sorted(tiers)], forbidden_within=[i % 2 == 1 for i in sorted(tiers)])
    names = sorted(k.tier)
    return spark.createDataFrame([(a, b, k.is_forbidden(a, b)) for a in names for b in names if a != b], "a string, b string, forbidden boolean")


@query(f"select node1, ep1, ep2, node2 from {edge_sql(GUESS)}")
def graph_file_edges(spark, sf_dir):
    """A graph written to a text file and read back, on the driver."""
    import os
    import tempfile

    from dagwright.sources.graph_files import load_graph, save_graph

    with tempfile.TemporaryDirectory() as at:
        path = os.path.join(at, "graph.txt")
        save_graph(graph_of(list(NODES), GUESS, CPDAG), path)
        return graph_rows(spark, load_graph(path))


@query("select * from (values ('a', 1), ('b', 2), ('c', 3), ('d', 4), ('f', 5), ('e', 6)) o(node, place)")
def graph_order(spark, sf_dir):
    """A causal order: of nodes whose parents are all there, the first by name."""
    return spark.createDataFrame([(v, i) for i, v in enumerate(graph_of(list(NODES), TRUTH, DAG).order(), 1)], "node string, place int")


@query(f"select node1, ep1, ep2, node2 from {edge_sql(TRUTH)} where node1 in ('b', 'c', 'e', 'f') and node2 in ('b', 'c', 'e', 'f')")
def graph_subgraph(spark, sf_dir):
    return graph_rows(spark, graph_of(list(NODES), TRUTH, DAG).subgraph("bcef"))


@query(f"with e as (select node1 as a, node2 as b from {edge_sql(TRUTH)}), n as (select unnest(['a', 'b', 'c', 'd', 'f', 'e']) as v, unnest(range(6)) as i) select x.v as a, y.v as b, not exists (select 1 from e where least(a, b) = least(x.v, y.v) and greatest(a, b) = greatest(x.v, y.v)) as separated from n x join n y on x.i < y.i")
def graph_separated(spark, sf_dir):
    """Each pair given the later one's other parents, which separate it unless it is adjacent."""
    g = graph_of(list(NODES), TRUTH, DAG)
    order = g.order()
    return spark.createDataFrame([(a, b, g.d_separated(a, b, set(g.parents(b)) - {a})) for j, b in enumerate(order) for a in order[:j]], "a string, b string, separated boolean")


MATRIX = ((0, 1, 0), (1, 0, 1), (0, 1, 0))


@query("with m(i, j) as (values (1, 2), (2, 3)) select substr('abc', i, 1) as node1, '-' as ep1, '-' as ep2, substr('abc', j, 1) as node2 from m")
def graph_from_matrix(spark, sf_dir):
    return graph_rows(spark, from_matrix(MATRIX, list("abc")))
