"""Queries of the relational operators: columns, joins, aggregates, ordered rows, encoders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.scalar import student_quantile, wilson_lower
from sparkloom.functions.vectors import as_array
from sparkloom.operators import aggregates, columns, encode, joins, ordered, sampling
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


@query("""select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net, cast(length(l_returnflag || l_linestatus) as integer) as flags,
       round(l_quantity * 2, 2) as l_quantity from lineitem""")
def columns_extract(spark: SparkSession, sf: str) -> DataFrame:
    return columns.extract(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber", expressions={"net": "round(l_extendedprice * (1 - l_discount), 4)", "flags": "length(concat(l_returnflag, l_linestatus))", "l_quantity": "round(l_quantity * 2, 2)"})


@query("select r_regionkey, upper(r_name) as r_name, r_regionkey + 1 as next_key from region")
def columns_redefined(spark: SparkSession, sf: str) -> DataFrame:
    return columns.extract(table(spark, sf, "region"), expressions={"r_name": "upper(r_name)", "next_key": "r_regionkey + 1"}, keep_inputs=True)


@query("select l_orderkey, l_linenumber, l_shipdate from lineitem where l_shipdate >= timestamp '1998-01-01' and l_discount > 0.05 and l_returnflag = 'R'")
def sql_filter(spark: SparkSession, sf: str) -> DataFrame:
    return columns.project(columns.where(table(spark, sf, "lineitem"), "l_shipdate >= timestamp_ntz '1998-01-01' and l_discount > 0.05 and l_returnflag = 'R'"), keep=["l_orderkey", "l_linenumber", "l_shipdate"])


@query("select p_partkey, p_name, p_brand from part")
def project_inverse(spark: SparkSession, sf: str) -> DataFrame:
    return columns.project(table(spark, sf, "part"), remove=["p_type", "p_size", "p_retailprice"])


@query("select c_custkey, coalesce(o_orderkey, -1) as o_orderkey, coalesce(o_totalprice, 0.0) as o_totalprice, o_orderstatus from customer left join orders on c_custkey = o_custkey")
def null_defaults(spark: SparkSession, sf: str) -> DataFrame:
    both = joins.join(table(spark, sf, "customer"), table(spark, sf, "orders"), F.expr("c_custkey = o_custkey"), "left_outer")
    return columns.null_to_default(both.select("c_custkey", "o_orderkey", "o_totalprice", "o_orderstatus"), {"o_orderkey": -1})


@query("select c_custkey, n_nationkey, cast(c_custkey as double) as first, case when c_acctbal > 0 then 1.0::double when c_acctbal <= 0 then 0.0::double else 'nan'::double end as second, case when c_custkey % 5 = 0 then 'nan'::double else round(c_acctbal, 2) end as last from customer join nation on c_nationkey = n_nationkey")
def assemble_vector(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.expr("c_nationkey = n_nationkey"))  # 25 rows at any scale
    c = c.withColumn("rich", F.col("c_acctbal") > 0).withColumn("held", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")))  # nulls become NaN
    out = columns.assemble(c, ["c_custkey", "rich", "held"])
    first, second, last = (F.get(as_array(out, "features"), F.lit(i)) for i in range(3))
    return out.select("c_custkey", "n_nationkey", first.alias("first"), second.alias("second"), F.round(last, 2).alias("last"))


def _join(how: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
        s, c = s.select("s_suppkey", "s_nationkey", "s_acctbal"), c.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
        out = joins.join_large_groups(s, c, [("s_nationkey", "c_nationkey")], "s_acctbal > c_acctbal", how, right_where="c_mktsegment = 'BUILDING'")  # 25 nations at any scale
        return out.select("s_suppkey") if how == "leftsemi" else out.select("s_suppkey", "c_custkey")

    return run


for _how, _sql in (("inner", "join"), ("left_outer", "left join"), ("right_outer", "right join"), ("outer", "full join")):
    _f = _join(_how)
    _f.__name__ = f"join_{_how}"
    query(f"select s_suppkey, c_custkey from supplier {_sql} customer on s_nationkey = c_nationkey and s_acctbal > c_acctbal and c_mktsegment = 'BUILDING'")(_f)
_f = _join("leftsemi")
_f.__name__ = "join_leftsemi"
query("select s_suppkey from supplier where exists (select 1 from customer where s_nationkey = c_nationkey and s_acctbal > c_acctbal and c_mktsegment = 'BUILDING')")(_f)


@query("select a.r_name as low, b.r_name as high from region a join region b on a.r_regionkey < b.r_regionkey")
def join_theta(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region")
    return joins.join(r.alias("a"), r.alias("b"), F.expr("a.r_regionkey < b.r_regionkey")).select(F.col("a.r_name").alias("low"), F.col("b.r_name").alias("high"))


def _spent(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))


_SPENT = "(select o_custkey as c_custkey, round(sum(o_totalprice), 2) as spent from orders group by 1)"


@query(f"select c_custkey, c_mktsegment, spent from customer join {_SPENT} using (c_custkey)")
def join_unique(spark: SparkSession, sf: str) -> DataFrame:
    return joins.join_unique(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), _spent(spark, sf), ["c_custkey"])


@query(f"select c_custkey, c_mktsegment, spent from customer left join {_SPENT} using (c_custkey)")
def left_join_unique(spark: SparkSession, sf: str) -> DataFrame:
    return joins.left_join_unique(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), _spent(spark, sf), ["c_custkey"])


@query("select l_suppkey, p_partkey, p_brand from part join (select distinct l_partkey as p_partkey, l_suppkey from lineitem) using (p_partkey)")
def distribute(spark: SparkSession, sf: str) -> DataFrame:
    mapping = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey")
    return joins.distribute(table(spark, sf, "part").select("p_partkey", "p_brand"), mapping, "p_partkey", "l_suppkey")


@query("select r_regionkey as k, r_name as name from region union all select n_nationkey, n_name from nation")
def union_by_position(spark: SparkSession, sf: str) -> DataFrame:
    return joins.union_all(table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), table(spark, sf, "nation").select("n_nationkey", "n_name"))


@query("select r_regionkey as k, r_name as name, cast(null as integer) as parent from region union all select n_nationkey, n_name, n_regionkey from nation")
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    return joins.union_all(table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), n, by_name=True)


@query("select o_custkey, cast(count(*) as integer) as n, array_to_string(list_sort(list(o_orderkey)), ',') as orders from orders group by 1")
def collect_list(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "orders").groupBy("o_custkey").agg(aggregates.list_of(F.col("o_orderkey")).alias("l"))
    return out.select("o_custkey", F.size("l").alias("n"), F.array_join(F.array_sort(F.col("l").cast("array<bigint>")), ",").alias("orders"))


@query("select o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') as priorities from orders group by 1")
def collect_set(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(aggregates.set_of(F.col("o_orderpriority")), ",").alias("priorities"))


@query("""select c_nationkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as priorities
from customer join orders on c_custkey = o_custkey group by 1""")
def merge_sets(spark: SparkSession, sf: str) -> DataFrame:
    sets = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(aggregates.set_of(F.col("o_orderpriority")).alias("s"))
    both = table(spark, sf, "customer").join(sets, "c_custkey")
    return both.groupBy("c_nationkey").agg(F.array_join(aggregates.merged_sets(F.col("s")), ",").alias("priorities"))


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) <= 3")
def topk_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.top_k(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 3, ["o_orderkey"])


@query("select o_orderkey, o_totalprice from orders order by o_totalprice, o_orderkey limit 25")
def bottom_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.top_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 25, ["o_orderkey"], ascending=True)


_Z = 1.959963984540054


@query(f"""with t as (select user_id, count(*) as n, cast(count(*) filter (where event_type = 'purchase') as double) as p from events group by 1)
select user_id, round((p / n + {_Z * _Z / 2} / n - {_Z} * sqrt((p / n * (1 - p / n) + {_Z * _Z / 4} / n) / n)) / (1 + {_Z * _Z} / n), 6) as bound from t""")
def wilson_bounds(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("p"))
    return t.select("user_id", F.round(wilson_lower(F.col("p"), F.col("n"), min_bound=-1.0), 6).alias("bound"))


@query("""with d as (select o_orderstatus, o_orderdate, count(*) as n from orders group by 1, 2),
b as (select o_orderstatus, o_orderdate, coalesce(sum(n) over (partition by o_orderstatus order by o_orderdate desc rows between unbounded preceding and 1 preceding), 0) as prev from d),
c as (select o_orderstatus, min(o_orderdate) as bound from b where prev < 300 group by 1)
select o_orderkey, o_orderstatus, o_orderdate from orders join c using (o_orderstatus) where o_orderdate >= bound""")
def ordered_cut(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.ordered_cut(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), ["o_orderstatus"], "o_orderdate", 300, ascending=False)


@query("""with g as (select *, coalesce(cast(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) >= 21600000000 as bigint), 0) as fresh from events),
s as (select user_id, value, cast(sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as bigint) as session from g)
select user_id, session, count(*) as n, round(sum(value), 4) as total from s group by 1, 2""")
def gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = ordered.gap_sessions(table(spark, sf, "events"), ["user_id"], "ts", 6 * 3600, tiebreak=["event_id"])
    return out.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""with f as (select date_trunc('day', ts) as day, event_type as term, count(*) as n from events group by 1, 2),
q as (select day, term, n / sum(n) over (partition by day) as freq from f),
l as (select max(day) as today from q),
t as (select term, freq from q, l where day = today), y as (select term, freq from q, l where day = today - interval 1 day),
j as (select coalesce(t.term, y.term) as term, coalesce(t.freq, 0) as f, coalesce(y.freq, 0) as m, case when y.freq is null then 0.0 else 0.0001 end as v from t full join y on t.term = y.term)
select term, round(f, 6) as freq, round(greatest((f - greatest(m, 1e-7)) / (sqrt(v) + 1e-7), 0), 4) as sig, round(m + 0.3 * (f - m), 6) as ewma, round(0.7 * (v + 0.3 * (f - m) * (f - m)), 8) as ewmvar from j""")
def ew_stats(spark: SparkSession, sf: str) -> DataFrame:
    f = _daily(spark, sf)
    last = f.agg(F.max("day").alias("today"))
    both = f.crossJoin(F.broadcast(last))  # one row
    today = both.where("day = today").select("term", "freq")
    yesterday = both.where("day = today - interval 1 day").select("term", F.struct(F.lit(0.0).alias("sig"), F.col("freq").alias("ewma"), F.lit(0.0001).alias("ewmvar")).alias("state"))
    out = ordered.ew_stats(today, yesterday, "term", "freq", "state")
    return out.select("term", F.round("freq", 6).alias("freq"), F.round("state.sig", 4).alias("sig"), F.round("state.ewma", 6).alias("ewma"), F.round("state.ewmvar", 8).alias("ewmvar"))


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("day"), F.col("event_type").alias("term")).agg(F.count("*").alias("n"))
    total = n.groupBy("day").agg(F.sum("n").alias("all"))
    return n.join(total, "day").select("day", "term", (F.col("n") / F.col("all")).alias("freq"))


@query("""with recursive f as (select date_trunc('day', ts) as day, event_type as term, count(*) as n from events group by 1, 2),
q as (select term, n / sum(n) over (partition by day) as freq, row_number() over (partition by term order by day) as i from f),
r as (select term, i, greatest((freq - 1e-7) / 1e-7, 0) as sig, 0.3 * freq as m, 0.7 * 0.3 * freq * freq as v from q where i = 1
      union all select q.term, q.i, greatest((q.freq - greatest(m, 1e-7)) / (sqrt(v) + 1e-7), 0), m + 0.3 * (q.freq - m), 0.7 * (v + 0.3 * (q.freq - m) * (q.freq - m)) from r join q on q.term = r.term and q.i = r.i + 1)
select term, round(sig, 4) as sig, round(m, 8) as ewma, round(v, 10) as ewmvar from r qualify row_number() over (partition by term order by i desc) = 1""")
def ew_series(spark: SparkSession, sf: str) -> DataFrame:
    out = ordered.ew_series(_daily(spark, sf), "term", "day", "freq")
    return out.select("term", F.round("sig", 4).alias("sig"), F.round("ewma", 8).alias("ewma"), F.round("ewmvar", 10).alias("ewmvar"))


_NOW = 1_706_745_600_000


@query(f"""select user_id, cast(max((epoch_us(ts) // 1000)) as bigint) as t, round(sum(value * power(0.7, ({_NOW} - (epoch_us(ts) // 1000)) / 172800000.0)), 4) as value,
round(sum(power(0.7, ({_NOW} - (epoch_us(ts) // 1000)) / 172800000.0)), 6) as weight from events group by 1""")
def time_discount(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.array("value", F.lit(1.0)).alias("v"))
    out = ordered.discounted(e, ["user_id"], "t", "v", _NOW)
    return out.select("user_id", "t", F.round(F.get("v", F.lit(0)), 4).alias("value"), F.round(F.get("v", F.lit(1)), 6).alias("weight"))


@query("""with d as (select label, cast(unnest(embedding) as double) as x, generate_subscripts(embedding, 1) - 1 as i from embeddings),
r as (select *, row_number() over (partition by label, i order by x) as rn, count(*) over (partition by label, i) as n from d)
select label, cast(i as integer) as i, count(*) as n, round(avg(x), 6) as mean, round(var_samp(x), 6) as var, round(min(x), 6) as lo, round(max(x), 6) as hi, cast(count(*) filter (where x <> 0) as double) as non_zeros,
round(sum(abs(x)), 5) as l1, round(sqrt(sum(x * x)), 6) as l2, """ + ", ".join(f"round(sum(x * greatest(0, 1 - abs(rn - greatest(1, least(n, n * {p} + 0.5))))), 6) as p{round(100 * p)}" for p in (0.1, 0.5, 0.9)) + " from r group by 1, 2")
def vector_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _stats_by_entry(table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v")))


def _stats_by_entry(e: DataFrame) -> DataFrame:
    s = aggregates.vector_stats(e, "v", ["label"])
    names = {"mean": 6, "var": 6, "min": 6, "max": 6, "nonZeros": 6, "L1": 5, "L2": 6, "p10": 6, "p50": 6, "p90": 6}
    out = s.select("label", F.col("v_count").alias("n"), F.posexplode(F.arrays_zip(*[F.col(f"v_{n}") for n in names])).alias("i", "z"))
    called = {"min": "lo", "max": "hi", "nonZeros": "non_zeros", "L1": "l1", "L2": "l2"}
    return out.select("label", "i", "n", *[F.round(f"z.v_{n}", d).alias(called.get(n, n)) for n, d in names.items()])


@query("""with d as (select vec_id, label, generate_subscripts(embedding, 1) - 1 as i, cast(unnest(embedding) as double) as x from embeddings),
e as (select vec_id, label, i, case when (vec_id + i) % 7 = 0 then null else x end as x from d)
select vec_id, label, cast(i as integer) as i, round(coalesce(x, avg(x) over (partition by label, i), 0), 6) as v from e""")
def nan_to_mean(spark: SparkSession, sf: str) -> DataFrame:
    holes = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: F.when((F.col("vec_id") + i) % 7 == 0, float("nan")).otherwise(x))
    out = aggregates.replace_nan_by_mean(table(spark, sf, "embeddings").select("vec_id", "label", holes.alias("v")), "v", ["label"])
    return out.select("vec_id", "label", F.posexplode(as_array(out, "v")).alias("i", "x")).select("vec_id", "label", "i", F.round("x", 6).alias("v"))


@query("""with q as (select list_distinct(quantile_cont(o_totalprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) as s from orders)
select o_orderkey, cast(len(list_filter(s, lambda x: o_totalprice >= x)) as double) as bucket from orders, q""")
def quantile_buckets(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    b = encode.QuantileBuckets({"o_totalprice": encode.exact_quantile_splits(o, "o_totalprice", 10)})
    return b.transform(o).select("o_orderkey", F.col("o_totalprice_bucket").alias("bucket"))


@query()
def quantile_buckets_approximate(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return encode.fit_quantile_buckets(o, {"l_quantity": 10, "l_extendedprice": 100}).transform(o)


@query("select o_orderkey, cast(('0x' || substr(md5(cast(o_orderkey as varchar)), 1, 8))::bigint % 5 as bigint) as fold from orders")
def assign_folds(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.with_folds(table(spark, sf, "orders").select("o_orderkey"), 5, ["o_orderkey"], "fold")


@query("""with c as (select coalesce(o_orderpriority, '') as value, count(*) as n from orders group by 1), r as (select value, n, row_number() over (order by n desc, value) - 1 as i from c)
select value, n, cast(i as integer) as i from r""")
def nominal_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = encode.fit_nominal(table(spark, sf, "orders"), "o_orderpriority")
    places = F.array(*[F.lit(v) for v in e.values])
    return encode.nominal_counts(table(spark, sf, "orders"), "o_orderpriority").withColumn("i", (F.array_position(places, F.col("value")) - 1).cast("int"))


@query("""with v as (select list_sort(list_distinct(list(o_orderpriority))) as vs from orders)
select o_orderkey, array_to_string(list_transform(vs, lambda x: case when x = o_orderpriority then '1.0' else '0.0' end), ',') as hot, round(o_totalprice, 2) as price from orders, v""")
def auto_assemble(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = encode.fit_auto_assembler(o, exclude=["o_orderkey"]).transform(o)
    v = as_array(out, "features")
    return out.select("o_orderkey", F.array_join(F.slice(v, 1, F.size(v) - 1).cast("array<string>"), ",").alias("hot"), F.round(F.element_at(v, -1), 2).alias("price"))


@query("""with d as (select vec_id, label, generate_subscripts(embedding, 1) - 1 as i, cast(unnest(embedding) as double) as x from embeddings)
select vec_id, label, 'e' || i as value, round(x, 6) as v from d""")
def vector_explode(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    longest = e.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    return columns.explode_vectors(columns.with_metadata(e, "v", [f"e{i}" for i in range(longest)]), "value", ["v"]).withColumn("v", F.round("v", 6))


@query("select vec_id, case label when 0 then 'zero' when 1 then 'one' when 2 then 'two' else cast(label as varchar) end as name from embeddings")
def name_of_index(spark: SparkSession, sf: str) -> DataFrame:
    return columns.names_of_indices(table(spark, sf, "embeddings").select("vec_id", "label"), "label", ["zero", "one", "two"], "name").drop("label")


#: Quantiles of Student's t for up to 60 degrees of freedom (the labels are 10), as DuckDB has none.
_T = ", ".join(repr(student_quantile(0.975, n)) for n in range(1, 61))


@query(f"""with w as (select label as fold, i, avg(x) as weight from (select label, cast(unnest(embedding) as double) as x, generate_subscripts(embedding, 1) - 1 as i from embeddings) group by 1, 2),
s as (select i, avg(weight) as average, stddev_samp(weight) as deviation, count(*) as n from w group by 1)
select cast(i as integer) as index, round(average, 6) as average, round(deviation, 6) as deviation, n as count, round(abs(average) / (([{_T}])[n - 1] * deviation / sqrt(n)), 4) as significance from s""")
def feature_significance(spark: SparkSession, sf: str) -> DataFrame:
    return _significance(table(spark, sf, "embeddings").select(F.col("label").alias("fold"), F.posexplode(F.col("embedding").cast("array<double>")).alias("index", "x")))


def _significance(e: DataFrame) -> DataFrame:
    w = e.groupBy("fold", "index").agg(F.avg("x").alias("weight")).withColumn("name", F.col("index").cast("string"))
    out = aggregates.weight_significance(w)
    return out.select("index", F.round("average", 6).alias("average"), F.round("deviation", 6).alias("deviation"), "count", F.round("significance", 4).alias("significance"))


@query("""with g as (select source, count(*) filter (where quality >= 0.5) as p, count(*) filter (where quality < 0.5) as n from documents join labels using (doc_id) group by 1)
select count(*) as groups, cast(coalesce(sum(p), 0) as bigint) as positives, cast(coalesce(sum(n), 0) as bigint) as negatives from g where p > 0 and n > 0""")
def group_balance(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return aggregates.group_balance(both, ["source"], "quality")


@query("""with d as (select vec_id, cast(label as double) as y, cast(unnest(embedding) as double) as x, generate_subscripts(embedding, 1) as i from embeddings),
s as (select i, sum(x * y) as xy, sum(x) as x, avg(y) as m, count(*) as n from d group by 1)
select round(max(abs(xy - m * x) / n), 6) as bound from s""")
def greatest_useful_l1(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    return aggregates.greatest_useful_l1(e, "v", "label").select(F.round("bound", 6).alias("bound"))


@query("select distinct event_type as value from events")
def distinct_types(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.distinct_values(table(spark, sf, "events"), "event_type")


@query()
def sample_keep_positive(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("label", (F.col("event_type") == "purchase").cast("int"))
    return sampling.sample(e, 0.1, keep_positive="label", key=["event_id"])


@query()
def sample_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.array("value", F.hour("ts").cast("double")).alias("v"), (F.col("event_type") == "purchase").cast("double").alias("label"))
    return sampling.sample_pairs(e, ["user_id"], "v", "label", item_rate=sampling.item_rate_for(e, ["user_id"], "label", 2000), ranking_power=0.5)
