"""The 22 decision-support queries on the tables at hand.

Columns that the tables lack are left out or replaced; what stands for the
suppliers' offers is the distinct pairs of part and supplier in lineitem, with
their lowest price and total quantity.  Each query keeps the joins,
subqueries and aggregates of its model.
"""

from __future__ import annotations

from ..plans.sqlquery import SqlQuery, mean, money, n

REVENUE = "l_extendedprice * (1 - l_discount)"
OFFERS = """offers as (select l_partkey as ps_part, l_suppkey as ps_supp, min(l_extendedprice) as ps_cost,
  sum(cast(l_quantity as bigint)) as ps_qty from lineitem group by l_partkey, l_suppkey)"""

TPCH = {
    "tpch_q01": f"""select l_returnflag as flag, l_linestatus as status, {money("l_quantity")} as qty, {money("l_extendedprice")} as gross,
      {money(REVENUE)} as net, {money(REVENUE + " * (1 + l_tax)", 6)} as charged, {mean("l_quantity")} as mean_qty,
      {mean("l_extendedprice")} as mean_price, {mean("l_discount")} as mean_discount, count(*) as n
      from lineitem where l_shipdate <= $ts '2001-08-01' group by l_returnflag, l_linestatus order by flag, status""",
    "tpch_q02": f"""with {OFFERS},
      local as (select * from offers join supplier on ps_supp = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'EUROPE')
      select s_acctbal, s_name, n_name, p_partkey, p_name from part join local on p_partkey = ps_part
      where p_size > 10 and p_type like '%O%' and ps_cost = (select min(x.ps_cost) from local x where x.ps_part = p_partkey)
      order by s_acctbal desc, n_name, s_name, p_partkey limit 100""",
    "tpch_q03": f"""select o_orderkey, o_orderdate, {money(REVENUE)} as net from customer, orders, lineitem
      where c_mktsegment = 'BUILDING' and o_custkey = c_custkey and l_orderkey = o_orderkey and o_orderdate < $ts '1998-03-15' and l_shipdate > $ts '1998-03-15'
      group by o_orderkey, o_orderdate order by net desc, o_orderdate, o_orderkey limit 10""",
    "tpch_q04": """select o_orderpriority as priority, count(*) as n from orders where o_orderdate >= $ts '1996-07-01' and o_orderdate < $ts '1996-10-01'
      and exists (select 1 from lineitem where l_orderkey = orders.o_orderkey and l_shipdate > orders.o_orderdate + interval '30' day) group by o_orderpriority order by priority""",
    "tpch_q05": f"""select n_name as nation_name, {money(REVENUE)} as net from customer, orders, lineitem, supplier, nation, region
      where o_custkey = c_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and s_nationkey = c_nationkey and n_nationkey = s_nationkey and n_regionkey = r_regionkey
      and r_name = 'ASIA' and o_orderdate >= $ts '1996-01-01' and o_orderdate < $ts '1999-01-01' group by n_name order by net desc""",
    "tpch_q06": f"""select {money("l_extendedprice * l_discount")} as gain from lineitem
      where l_shipdate between $ts '1996-01-01' and $ts '1996-12-31' and l_discount between 0.05 and 0.07 and l_quantity < 24""",
    "tpch_q07": f"""select a.n_name as seller, b.n_name as buyer, {n("year(l_shipdate)")} as sold, {money(REVENUE)} as net
      from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join customer on o_custkey = c_custkey
      join nation a on s_nationkey = a.n_nationkey join nation b on c_nationkey = b.n_nationkey
      where (a.n_name in ('NATION_1', 'NATION_3', 'NATION_8') and b.n_name in ('NATION_2', 'NATION_4') or a.n_name = 'NATION_2' and b.n_name in ('NATION_1', 'NATION_8'))
      and l_shipdate >= $ts '1996-01-01' group by a.n_name, b.n_name, year(l_shipdate) order by 1, 2, 3""",
    "tpch_q08": f"""select sold, round({money("case when seller = 'NATION_7' then net else 0 end")} / {money("net")}, 4) as share from (
      select {n("year(o_orderdate)")} as sold, {REVENUE} as net, s.n_name as seller from part join lineitem on p_partkey = l_partkey join supplier on l_suppkey = s_suppkey
      join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation c on c_nationkey = c.n_nationkey join region on c.n_regionkey = r_regionkey
      join nation s on s_nationkey = s.n_nationkey where r_name = 'AMERICA' and p_type = 'ECONOMY') t group by sold order by sold""",
    "tpch_q09": f"""with {OFFERS} select n_name as seller, {n("year(o_orderdate)")} as sold, {money(REVENUE + " - ps_cost * 0.1", 6)} as profit
      from part, supplier, lineitem, offers, orders, nation where s_suppkey = l_suppkey and ps_supp = l_suppkey and ps_part = l_partkey and p_partkey = l_partkey
      and o_orderkey = l_orderkey and s_nationkey = n_nationkey and p_name like '%red%' group by n_name, year(o_orderdate) order by seller, sold desc""",
    "tpch_q10": f"""select c_custkey, c_name, c_acctbal, n_name, {money(REVENUE)} as lost from customer join orders on c_custkey = o_custkey
      join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey where l_returnflag = 'R' and o_orderdate >= $ts '1997-10-01'
      and o_orderdate < $ts '1998-01-01' group by c_custkey, c_name, c_acctbal, n_name order by lost desc, c_custkey limit 20""",
    "tpch_q11": f"""with {OFFERS}, here as (select ps_part, cast(ps_cost as decimal(18,2)) * ps_qty as worth from offers, supplier, nation
      where ps_supp = s_suppkey and s_nationkey = n_nationkey and n_name = 'NATION_6')
      select ps_part, cast(sum(worth) as double) as total from here group by ps_part having sum(worth) > (select sum(worth) * 0.002 from here) order by total desc, ps_part""",
    "tpch_q12": f"""select l_linestatus as status, {n("sum(case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1 else 0 end)")} as urgent,
      {n("sum(case when o_orderpriority <> '1-URGENT' and o_orderpriority <> '2-HIGH' then 1 else 0 end)")} as other
      from orders join lineitem on o_orderkey = l_orderkey where l_returnflag in ('A', 'R') and l_shipdate >= $ts '1996-01-01' and l_shipdate < $ts '1997-01-01'
      group by l_linestatus order by status""",
    "tpch_q13": """select orders_made, count(*) as customers from (select c_custkey, count(o_orderkey) as orders_made
      from customer left join orders on c_custkey = o_custkey and o_orderpriority not like '%URG%' and o_totalprice > 100000 group by c_custkey) t
      group by orders_made order by customers desc, orders_made desc""",
    "tpch_q14": f"""select round(100.00 * {money("case when p_type like 'PROMO%' then " + REVENUE + " else 0 end")} / {money(REVENUE)}, 4) as promoted
      from lineitem, part where l_partkey = p_partkey and l_shipdate >= $ts '1996-09-01' and l_shipdate < $ts '1996-10-01'""",
    "tpch_q15": f"""with earned as (select l_suppkey as supp, {money(REVENUE)} as net from lineitem where l_shipdate >= $ts '1996-01-01'
      and l_shipdate < $ts '1996-01-01' + interval '3' month group by l_suppkey)
      select s_suppkey, s_name, net from supplier join earned on s_suppkey = supp where net = (select max(net) from earned) order by s_suppkey""",
    "tpch_q16": f"""with {OFFERS} select p_brand, p_type, p_size, count(distinct ps_supp) as sellers from offers join part on p_partkey = ps_part
      where p_brand <> 'Brand#5' and p_type not like 'MED%' and p_size in (3, 9, 14, 19, 23, 36, 45, 49) and ps_supp not in (select s_suppkey from supplier where s_acctbal < 0)
      group by p_brand, p_type, p_size order by sellers desc, p_brand, p_type, p_size""",
    "tpch_q17": f"""select round({money("l_extendedprice")} / 7.0, 4) as yearly from lineitem join part on p_partkey = l_partkey
      where p_brand = 'Brand#3' and l_quantity < (select 0.4 * avg(i.l_quantity) from lineitem i where i.l_partkey = p_partkey)""",
    "tpch_q18": f"""select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, {money("l_quantity")} as qty from customer, orders, lineitem
      where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 200) and c_custkey = o_custkey and l_orderkey = o_orderkey
      group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice order by o_totalprice desc, o_orderdate, o_orderkey limit 100""",
    "tpch_q19": f"""select {money(REVENUE)} as net from lineitem, part where
      (p_partkey = l_partkey and p_brand = 'Brand#1' and p_type in ('SMALL', 'PROMO') and l_quantity between 1 and 21 and p_size between 1 and 25) or
      (p_partkey = l_partkey and p_brand = 'Brand#2' and p_type in ('MEDIUM', 'LARGE') and l_quantity between 10 and 30 and p_size between 1 and 40) or
      (p_partkey = l_partkey and p_brand = 'Brand#4' and p_type in ('ECONOMY', 'STANDARD') and l_quantity between 20 and 40 and p_size between 1 and 50)""",
    "tpch_q20": f"""with {OFFERS} select s_name, s_nationkey from supplier join nation on s_nationkey = n_nationkey where n_name in ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4')
      and s_suppkey in (select ps_supp from offers where ps_part in (select p_partkey from part where p_name like 'large%')
      and ps_qty > (select 0.5 * sum(l_quantity) from lineitem where l_partkey = ps_part and l_suppkey = ps_supp and l_shipdate >= $ts '1996-01-01' and l_shipdate < $ts '2001-01-01')) order by s_name""",
    "tpch_q21": """select s_name, count(*) as waits from supplier, lineitem a, orders, nation where s_suppkey = a.l_suppkey and o_orderkey = a.l_orderkey and o_orderstatus = 'F'
      and a.l_shipdate > o_orderdate + interval '60' day and exists (select 1 from lineitem b where b.l_orderkey = a.l_orderkey and b.l_suppkey <> a.l_suppkey)
      and not exists (select 1 from lineitem c where c.l_orderkey = a.l_orderkey and c.l_suppkey <> a.l_suppkey and c.l_shipdate > o_orderdate + interval '90' day)
      and s_nationkey = n_nationkey and n_regionkey = 2 group by s_name order by waits desc, s_name limit 100""",
    "tpch_q22": f"""select code, count(*) as customers, {money("c_acctbal")} as balance from (
      select substring(c_name from length(c_name) for 1) as code, c_acctbal from customer where substring(c_name from length(c_name) for 1) in ('1', '3', '5', '7', '9')
      and c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0) and not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)) t
      group by code order by code""",
}

QUERIES = {k: SqlQuery(v) for k, v in TPCH.items()}
