"""The 43 web-analytics queries, on events joined with pages as page hits."""

from __future__ import annotations

from ..plans.sqlquery import SqlQuery, n

HITS = """with hits as (select e.event_id as watch, e.user_id as usr, e.ts, cast(e.ts as date) as day, case when e.event_type = 'view' then '' else e.event_type end as phrase,
  cast(floor(e.value) as bigint) as width, cast(floor(e.value) as bigint) $div 12 as adv, e.user_id $div 20 as region, e.event_id % 4 as engine, e.user_id % 7 as phone,
  cast(e.event_id % 5 = 0 as int) as refresh, p.url, substring(p.url, 1, 24) as title, p.page_id as counter
  from (select *, event_id % (select count(*) from pages) as pg from events) e join pages p on p.page_id = e.pg) """
WIDTH = "round(cast(sum(width) as double) / count(*), 4) as mean_width"
JULY = "day >= date '2024-01-05' and day <= date '2024-01-25' and refresh = 0"
N = "count(*) as hits_n"
USERS = "count(distinct usr) as users"

TEXTS = [
    f"select {N} from hits",
    f"select {N} from hits where adv <> 0",
    f"select {n('sum(adv)')} as advs, {N}, {WIDTH} from hits",
    "select round(cast(sum(usr) as double) / count(usr), 4) as mean_user from hits",
    f"select {USERS} from hits",
    "select count(distinct phrase) as phrases from hits",
    "select min(day) as first_day, max(day) as last_day from hits",
    f"select adv, {N} from hits where adv <> 0 group by adv order by hits_n desc",
    f"select region, {USERS} from hits group by region order by users desc, region limit 10",
    f"select region, {n('sum(adv)')} as advs, {N}, {WIDTH}, {USERS} from hits group by region order by hits_n desc, region limit 10",
    f"select title, {USERS} from hits where title <> '' group by title order by users desc, title limit 10",
    f"select phone, title, {USERS} from hits where title <> '' group by phone, title order by users desc, phone, title limit 10",
    f"select phrase, {N} from hits where phrase <> '' group by phrase order by hits_n desc, phrase limit 10",
    f"select phrase, {USERS} from hits where phrase <> '' group by phrase order by users desc, phrase limit 10",
    f"select engine, phrase, {N} from hits where phrase <> '' group by engine, phrase order by hits_n desc, engine, phrase limit 10",
    f"select usr, {N} from hits group by usr order by hits_n desc, usr limit 10",
    f"select usr, phrase, {N} from hits group by usr, phrase order by hits_n desc, usr, phrase limit 10",
    f"select usr, phrase, {N} from hits group by usr, phrase order by usr, phrase limit 10",
    f"select usr, {n('minute(ts)')} as m, phrase, {N} from hits group by usr, minute(ts), phrase order by hits_n desc, usr, m, phrase limit 10",
    "select usr, watch from hits where usr = 43",
    f"select {N} from hits where url like '%therin%'",
    f"select phrase, min(url) as first_url, {N} from hits where url like '%ther%' and phrase <> '' group by phrase order by hits_n desc, phrase limit 10",
    f"select phrase, min(url) as first_url, min(title) as first_title, {N}, {USERS} from hits where title like '%th%' and url not like '%.example.org%' and phrase <> '' group by phrase order by hits_n desc, phrase limit 10",
    "select * from hits where url like '%ther%' order by ts, watch limit 10",
    "select phrase, ts from hits where phrase <> '' order by ts, phrase limit 10",
    "select phrase from hits where phrase <> '' order by phrase limit 10",
    "select phrase, ts from hits where phrase <> '' order by ts, phrase limit 10",
    f"select counter, round(cast(sum(length(url)) as double) / count(*), 4) as mean_length, {N} from hits where url <> '' group by counter having count(*) > 3 order by mean_length desc, counter limit 25",
    f"select regexp_replace(url, '^https?://(?:m[.])?([^/]+)/.*$$', '\\1') as host, round(cast(sum(length(url)) as double) / count(*), 4) as mean_length, {N}, min(url) as first_url from hits where url <> '' group by 1 having count(*) > 10 order by mean_length desc, host limit 25",
    "select " + ", ".join(f"{n(f'sum(width + {k})')} as s{k}" for k in range(90)) + " from hits",
    f"select engine, phone, {N}, {n('sum(refresh)')} as refreshes, {WIDTH} from hits where phrase <> '' group by engine, phone order by hits_n desc, engine, phone limit 10",
    f"select watch, phone, {N}, {n('sum(refresh)')} as refreshes, {WIDTH} from hits where phrase <> '' group by watch, phone order by hits_n desc, watch, phone limit 10",
    f"select watch, phone, {N}, {n('sum(refresh)')} as refreshes, {WIDTH} from hits group by watch, phone order by hits_n desc, watch, phone limit 10",
    f"select url, {N} from hits group by url order by hits_n desc, url limit 10",
    f"select 1 as one, url, {N} from hits group by 1, url order by hits_n desc, url limit 10",
    f"select phone, phone - 1 as p1, phone - 2 as p2, phone - 3 as p3, {N} from hits group by phone, phone - 1, phone - 2, phone - 3 order by hits_n desc, phone limit 10",
    f"select url, {N} from hits where engine = 2 and {JULY} and url <> '' group by url order by hits_n desc, url limit 10",
    f"select title, {N} from hits where engine = 2 and {JULY} and title <> '' group by title order by hits_n desc, title limit 10",
    f"select url, {N} from hits where {JULY} and phone <> 0 and adv = 0 group by url order by hits_n desc, url limit 10 offset 100",
    f"select engine, adv, case when engine = 0 and adv = 0 then title else '' end as src, url as dst, {N} from hits where {JULY} group by engine, adv, case when engine = 0 and adv = 0 then title else '' end, url order by hits_n desc, engine, adv, src, dst limit 10 offset 50",
    f"select region, day, {N} from hits where {JULY} and engine in (-1, 2) and phone = 3 group by region, day order by hits_n desc, region, day limit 10 offset 10",
    f"select width, phone, {N} from hits where {JULY} and engine = 1 group by width, phone order by hits_n desc, width, phone limit 10 offset 20",
    f"select date_trunc('minute', ts) as m, {N} from hits where day >= date '2024-01-14' and day <= date '2024-01-15' and refresh = 0 group by date_trunc('minute', ts) order by m limit 10 offset 100",
]
QUERIES = {f"web_q{i:02d}": SqlQuery(HITS + t) for i, t in enumerate(TEXTS)}
QUERIES["web_q28"] = SqlQuery(HITS + TEXTS[28], HITS + TEXTS[28].replace("'\\1'", "'$$1'").replace("'^https", "r'^https"))
QUERIES["web_q42"] = SqlQuery(HITS + TEXTS[42], HITS + TEXTS[42].replace("select date_trunc('minute', ts) as m", "select cast(date_trunc('minute', ts) as timestamp_ntz) as m"))
