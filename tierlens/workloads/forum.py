"""The ten question-and-answer queries, on orders as posts, customers as users and line items as comments."""

from __future__ import annotations

from ..plans.sqlquery import SqlQuery, mean, n

YEAR = "extract(year from {})".format
LATE = "hour(ts) between 22 and 23 or hour(ts) between 0 and 5"
FORUM = {
    "forum_q0": f"""select {n(YEAR("o_orderdate"))} as posted, count(distinct c_custkey) as active,
      count(distinct case when {YEAR("o_orderdate")} = 1995 + c_custkey % 4 then c_custkey end) as new_users,
      count(distinct case when {YEAR("o_orderdate")} > 1995 + c_custkey % 4 then c_custkey end) as returning_users
      from orders join customer on o_custkey = c_custkey where o_orderstatus in ('F', 'O') and o_orderdate >= $ts '2001-08-01' - interval '5' year group by {YEAR("o_orderdate")} order by posted desc""",
    "forum_q1": f"select {n('dayofweek(o_orderdate)')} as dow, count(*) as posts from orders group by dayofweek(o_orderdate)",
    "forum_q2": "select o_orderkey, o_orderstatus, o_orderdate from orders where o_orderpriority = '5-LOW' and o_orderdate > $ts '1996-01-01' order by o_orderdate desc, o_orderkey limit 100",
    "forum_q3": f"select {n(YEAR('o_orderdate').replace('year', 'month'))} as m, count(*) as posts, {mean('o_totalprice')} as score from orders group by extract(month from o_orderdate) order by m",
    "forum_q4": "select p_partkey, p_name, p_size from part where p_type = 'PROMO' and (p_name like 'red %' or p_name like 'small %') order by p_size desc, p_partkey limit 50",
    "forum_q5": """select c_custkey, c_name, c_nationkey, round(cast(c_nationkey as double) / nullif(c_custkey % 10, 0), 2) as ratio from customer join orders on o_custkey = c_custkey
      where c_nationkey > 10 and cast(c_nationkey as double) / nullif(c_custkey % 10, 0) > 0.5 and dayofweek(o_orderdate) in ($mon, $fri) and c_acctbal > 1000
      group by c_custkey, c_name, c_nationkey order by ratio desc, c_custkey limit 30""",
    "forum_q6": f"""select user_id, count(*) as total, count(case when {LATE} then 1 end) as late, round(cast(100 * count(case when {LATE} then 1 end) as double) / count(*), 2) as late_share
      from events where event_type <> 'view' and ts >= $ts '2024-01-31' - interval '18' day group by user_id having count(case when {LATE} then 1 end) >= 5 order by late_share desc, user_id limit 40""",
    "forum_q7": "select o_orderkey, o_totalprice, o_orderdate from orders left join (select * from lineitem where l_quantity > 45) l on o_orderkey = l_orderkey where o_totalprice > 300000 and l_orderkey is null and extract(year from o_orderdate) = 1998 order by o_totalprice desc, o_orderkey limit 10",
    "forum_q8": "select a.user_id, count(*) as answered from events a join (select distinct user_id from events where event_type = 'signup') u on a.user_id = u.user_id join events b on b.event_id = a.event_id + 1 where a.event_type = 'view' and a.user_id = b.user_id group by a.user_id having count(*) >= 1 order by answered desc, a.user_id limit 10",
    "forum_q9": "select page_id, url from pages where url like 'http%' and url not like '%?%' order by page_id desc limit 10",
}
QUERIES = {k: SqlQuery(v) for k, v in FORUM.items()}
QUERIES["forum_q1"] = SqlQuery(FORUM["forum_q1"], FORUM["forum_q1"].replace("cast(dayofweek(o_orderdate) as", "cast(dayofweek(o_orderdate) - 1 as"))
QUERIES["forum_q5"] = SqlQuery(FORUM["forum_q5"].replace("$mon", "1").replace("$fri", "5"), FORUM["forum_q5"].replace("$mon", "2").replace("$fri", "6"))
