"""The SELECT surface that a guarded user query may use: every join kind, set operations, grouping sets, windows, functions.

Each query is SQL text that passes the guard over the star schema, run by Spark's own planner.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from heddle.operators.guard import guarded
from heddle.sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

#: Name: SQL that Spark and DuckDB both read, or a pair where the dialects differ.
SQL: dict[str, str | tuple[str, str]] = {
    "sql_inner_join": "select n.n_name, count(*) as customers from customer c join nation n on c.c_nationkey = n.n_nationkey group by n.n_name",
    "sql_left_join": "select c.c_custkey, count(o.o_orderkey) as orders from customer c left join orders o on o.o_custkey = c.c_custkey group by c.c_custkey",
    "sql_right_join": "select n.n_nationkey, count(s.s_suppkey) as suppliers from supplier s right join nation n on s.s_nationkey = n.n_nationkey and s.s_acctbal > 5000 group by n.n_nationkey",
    "sql_full_join": "select coalesce(a.c_nationkey, b.s_nationkey) as k, a.n as customers, b.n as suppliers from (select c_nationkey, count(*) as n from customer where c_nationkey < 15 group by c_nationkey) a full join (select s_nationkey, count(*) as n from supplier where s_nationkey > 8 group by s_nationkey) b on a.c_nationkey = b.s_nationkey",
    "sql_cross_join": "select r.r_name, n.n_name from region r cross join nation n where n.n_nationkey < 4",
    "sql_semi_join": "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 400000)",
    "sql_anti_join": "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)",
    "sql_in_subquery": "select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_quantity >= 50)",
    "sql_scalar_subquery": "select s_suppkey from supplier where s_acctbal > (select avg(s_acctbal) from supplier)",
    "sql_correlated": "select o_orderkey from orders o where o_totalprice = (select max(o2.o_totalprice) from orders o2 where o2.o_custkey = o.o_custkey)",
    "sql_theta_join": "select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    "sql_lateral": "select n.n_nationkey, t.most from nation n, lateral (select max(c_acctbal) as most from customer where c_nationkey = n.n_nationkey) t",
    "sql_cte": "with big as (select o_custkey, sum(cast(o_totalprice as decimal(18,2))) as total from orders group by o_custkey), top as (select * from big where total > 1000000) select c.c_mktsegment, count(*) as n from top join customer c on c.c_custkey = top.o_custkey group by c.c_mktsegment",
    "sql_union": "select n_nationkey as k from nation union select s_nationkey from supplier",
    "sql_union_all": "select c_nationkey as k, count(*) as n from (select c_nationkey from customer union all select s_nationkey from supplier) t group by c_nationkey",
    "sql_intersect": "select c_nationkey as k from customer intersect select s_nationkey from supplier",
    "sql_except": "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 9000",
    "sql_group_having": "select l_returnflag, l_linestatus, count(*) as n, cast(sum(l_quantity) as bigint) as qty from lineitem group by l_returnflag, l_linestatus having count(*) > 10",
    "sql_rollup": "select l_returnflag, l_linestatus, count(*) as n, cast(grouping(l_linestatus) as int) as g from lineitem group by rollup (l_returnflag, l_linestatus)",
    "sql_cube": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)",
    "sql_grouping_sets": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())",
    "sql_filter_agg": "select l_shipdate, count(*) filter (where l_discount > 0.05) as discounted, count(*) as n from lineitem group by l_shipdate",
    "sql_distinct_agg": "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem group by l_returnflag",
    "sql_percentiles": "select o_orderpriority, round(percentile_cont(0.5) within group (order by o_totalprice), 6) as median, percentile_disc(0.95) within group (order by o_totalprice) as p95 from orders group by o_orderpriority",
    "sql_stats": "select c_mktsegment, round(stddev(c_acctbal), 4) as sd, round(variance(c_acctbal), 2) as var, round(corr(c_acctbal, c_nationkey), 6) as r, bool_and(c_acctbal > 0) as all_positive, bool_or(c_acctbal > 9000) as some_rich from customer group by c_mktsegment",
    "sql_string_agg": ("select n_regionkey, string_agg(n_name, ',') within group (order by n_name) as names from nation group by n_regionkey", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names from nation group by n_regionkey"),
    "sql_array_agg": ("select n_regionkey, array_join(sort_array(array_agg(cast(n_nationkey as string))), '-') as keys from nation group by n_regionkey", "select n_regionkey, array_to_string(list_sort(array_agg(n_nationkey::varchar)), '-') as keys from nation group by n_regionkey"),
    "sql_mode": ("select mode() within group (order by l_linestatus desc) as m from lineitem where l_returnflag = 'N'", "select mode(l_linestatus) as m from lineitem where l_returnflag = 'N'"),
    "sql_window_rank": "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn, rank() over (partition by o_custkey order by o_orderdate) as rk, dense_rank() over (partition by o_custkey order by o_orderpriority) as dr from orders",
    "sql_window_frame": "select l_orderkey, l_linenumber, cast(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows between 2 preceding and current row) as bigint) as recent, lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as before, first_value(l_suppkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as first_supp from lineitem",
    "sql_ntile": "select s_suppkey, ntile(4) over (order by s_acctbal, s_suppkey) as quarter from supplier",
    "sql_topk": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10",
    "sql_offset": "select o_orderkey from orders order by o_orderkey limit 7 offset 13",
    "sql_distinct": "select distinct o_orderstatus, o_orderpriority from orders",
    "sql_case": "select case when p_size < 10 then 'small' when p_size < 30 then 'medium' else 'large' end as size_class, count(*) as n from part group by 1",
    "sql_dates": "select extract(year from o_orderdate) as y, extract(month from o_orderdate) as m, date_trunc('quarter', o_orderdate) as q, count(*) as n from orders group by 1, 2, 3",
    "sql_strings": ("select c_custkey, upper(c_mktsegment) as u, lpad(cast(c_custkey as varchar(10)), 8, '0') as padded, split_part(c_name, '#', 2) as num, reverse(c_mktsegment) as rev, left(c_name, 3) as l3, right(c_name, 3) as r3, repeat('x', 3) as xs, btrim('  a ') as b, replace(c_name, '#', '-') as dashed from customer", "select c_custkey, upper(c_mktsegment) as u, lpad(cast(c_custkey as varchar(10)), 8, '0') as padded, split_part(c_name, '#', 2) as num, reverse(c_mktsegment) as rev, left(c_name, 3) as l3, right(c_name, 3) as r3, repeat('x', 3) as xs, trim('  a ') as b, replace(c_name, '#', '-') as dashed from customer"),
    "sql_regexp": ("select p_partkey, regexp_replace(p_type, '[aeiou]', '*') as masked from part", "select p_partkey, regexp_replace(p_type, '[aeiou]', '*', 'g') as masked from part"),
    "sql_numbers": ("select s_suppkey, cast(floor(s_acctbal) as bigint) as f, cast(ceiling(s_acctbal) as bigint) as c, abs(s_acctbal) as a, round(s_acctbal, 1) as r, s_suppkey div 7 as d, mod(s_suppkey, 7) as m, width_bucket(s_acctbal, 0, 10000, 5) as b from supplier", "select s_suppkey, cast(floor(s_acctbal) as bigint) as f, cast(ceiling(s_acctbal) as bigint) as c, abs(s_acctbal) as a, round(s_acctbal, 1) as r, s_suppkey // 7 as d, mod(s_suppkey, 7) as m, case when s_acctbal < 0 then 0 when s_acctbal >= 10000 then 6 else cast(floor(s_acctbal / 2000) as bigint) + 1 end as b from supplier"),
    "sql_nulls": "select nullif(o_orderstatus, 'F') as s, coalesce(nullif(o_orderpriority, '1-URGENT'), 'none') as p, count(*) as n from orders group by 1, 2 order by s nulls last, p",
    "sql_generate_series": ("select explode(sequence(1, 10, 3)) as i", "select unnest(generate_series(1, 10, 3)) as i"),
    "sql_series_in_select": ("select r_regionkey, generate_series(r_regionkey, 9, 4) as i from region", "select r_regionkey, unnest(generate_series(r_regionkey::bigint, 9, 4)) as i from region"),
    "sql_series_in_from": ("select g.i, count(n.n_nationkey) as nations from generate_series(0, 5) as g(i) left join nation n on n.n_regionkey = g.i group by g.i", "select g.i, count(n.n_nationkey) as nations from generate_series(0, 5) as g(i) left join nation n on n.n_regionkey = g.i group by g.i"),
    "sql_age": (
        "select o_orderkey, age(o_orderdate, date'1990-06-15') as age from orders",
        "select o_orderkey, case when o_orderdate::date = date '1990-06-15' then '00:00:00' else concat_ws(' ', case when m // 12 > 0 then (m // 12) || case when m // 12 = 1 then ' year' else ' years' end end, case when m % 12 > 0 then (m % 12) || case when m % 12 = 1 then ' mon' else ' mons' end end, case when d > 0 then d || case when d = 1 then ' day' else ' days' end end) end as age from (select o_orderkey, o_orderdate, 12 * (year(o_orderdate) - 1990) + month(o_orderdate) - 6 - case when day(o_orderdate) < 15 then 1 else 0 end as m, day(o_orderdate) - 15 + case when day(o_orderdate) < 15 then 30 else 0 end as d from orders)",
    ),
    "sql_justify_interval": ("select n_nationkey, justify_interval(n_nationkey * interval '17' day) as t from nation", "select n_nationkey, case when n_nationkey = 0 then '00:00:00' else concat_ws(' ', case when d // 360 > 0 then (d // 360) || case when d // 360 = 1 then ' year' else ' years' end end, case when d // 30 % 12 > 0 then (d // 30 % 12) || case when d // 30 % 12 = 1 then ' mon' else ' mons' end end, case when d % 30 > 0 then (d % 30) || case when d % 30 = 1 then ' day' else ' days' end end) end as t from (select n_nationkey, n_nationkey * 17 as d from nation)"),
    "sql_schema_in_literal": ("select 'see shop.nation' as note, shop.nation.n_name from shop.nation where n_name <> 'shop.nation'", "select 'see shop.nation' as note, n_name from nation"),
    "sql_to_char": ("select o_orderkey, to_char(o_orderdate, 'DD.MM.YYYY HH24:MI') as stamp, to_date(to_char(o_orderdate, 'YYYY/MM/DD'), 'YYYY/MM/DD') as day from orders", "select o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M') as stamp, o_orderdate::date as day from orders"),
    "sql_regexp_match": ("select p_partkey, array_join(regexp_match(p_type, '^([A-Z]+) ([A-Z]+)'), '/') as m from part", "select p_partkey, case when regexp_matches(p_type, '^([A-Z]+) ([A-Z]+)') then regexp_extract(p_type, '^([A-Z]+) ([A-Z]+)', 1) || '/' || regexp_extract(p_type, '^([A-Z]+) ([A-Z]+)', 2) end as m from part"),
    "sql_json_events": ("select event_type, count(*) as n, count(distinct user_id) as users, round(avg(value), 4) as mean from events group by event_type", "select event_type, count(*) as n, count(distinct user_id) as users, round(avg(value), 4) as mean from events group by event_type"),
    "sql_star_report": "select r.r_name, extract(year from o.o_orderdate) as y, cast(sum(cast(l.l_extendedprice as decimal(18,2)) * (1 - cast(l.l_discount as decimal(4,2)))) as decimal(18,4)) as revenue from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by 1, 2",
}


def _run(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return guarded(spark, sql, {n: table(spark, sf_dir, n) for n in TABLES}, None, "shop")


QUERIES = {name: partial(_run, sql if isinstance(sql, str) else sql[0]) for name, sql in SQL.items()}
ORACLES = {name: sql if isinstance(sql, str) else sql[1] for name, sql in SQL.items()}
