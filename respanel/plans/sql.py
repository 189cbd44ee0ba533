"""DuckDB SQL of the registered queries: named tables, and their assembly into one statement."""

from __future__ import annotations

import re

#: name -> select; a name may use any other.
TABLES: dict[str, str] = {}


def statement(final: str) -> str:
    """``final`` with the named tables it needs, directly or not, in order of use."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in TABLES:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(TABLES[name])
                if name not in order:
                    order.append(name)

    need(final)
    return (("with " + ",\n".join(f"{n} as ({TABLES[n]})" for n in order) + "\n") if order else "") + final


def rounded(table: str, columns: str, digits: int = 6, **values: str) -> str:
    """select columns and rounded values from a table."""
    return f"select {columns}, " + ", ".join(f"round({e}, {digits}) as {n}" for n, e in values.items()) + f" from {table}"


TABLES["b2_cells"] = """
select j, i, th, a, b, case when u < 1/(1+exp(-a*(th-b))) then 1 else 0 end as correct from (
  select j, i, -2.0e0 + 4.0e0*((j*7919)%1009)/1008.0e0 as th, -2.0e0 + 4.0e0*((i*6007)%2003)/2002.0e0 as b,
    case when i%20=0 then -1.2e0 when i%7=0 then 0.05e0 else 0.5e0+1.5e0*((i*3571)%997)/996.0e0 end as a,
    ((j*104729 + i*1299709 + (j*i*15485863)%10000019)%10007)/10007.0e0 as u
  from (select distinct l_suppkey as j, l_partkey as i from lineitem))"""
TABLES["resp"] = "select j as r, i as c, correct as obs from b2_cells"
TABLES["peop"] = "select distinct r, concat('m', cast(r as varchar)) as model_id from resp"
TABLES["itm"] = "select distinct c, concat('i', cast(c as varchar)) as item_id, concat('s', cast(c%7 as varchar)) as subject from resp"
TABLES["truth_i"] = "select distinct i as c, a, b from b2_cells"
TABLES["truth_r"] = "select distinct j as r, th as theta from b2_cells"

TABLES["b1"] = """
select model_id, prompt_variant, item_id, subject, correct, concat(model_id, '|', prompt_variant) as respondent_id from (
  select concat('n', cast(s_nationkey as varchar)) as model_id, l_linestatus as prompt_variant, concat(p_brand, '_', p_type) as item_id, p_brand as subject,
    case when l_quantity >= 25 then 1 else 0 end as correct,
    row_number() over (partition by s_nationkey, l_linestatus, p_brand, p_type order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as k
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey) where k = 1"""
TABLES["b3"] = """
select concat('u', cast(user_id as varchar)) as respondent_id, concat(event_type, '_', cast(extract(hour from ts) as varchar)) as item_id,
  event_id, case when value >= 10 then 1 else 0 end as correct, event_type, props from events"""

LOGIT = "ln(least(greatest({0}, 0.02e0), 0.98e0)/(1-least(greatest({0}, 0.02e0), 0.98e0)))"
TABLES["rates"] = "select c, count(*) as n_resp, avg(obs) as p from resp group by c"
TABLES["start_i"] = f"select c, n_resp, p, 1.0e0 as a, least(greatest(-{LOGIT.format('p')}, -6e0), 6e0) as b from rates"
TABLES["start_l"] = f"select r, count(*) as n_resp, {LOGIT.format('avg(obs)')} as l from resp group by r"
TABLES["start_r"] = "select r, n_resp, (l - (select avg(l) from start_l)) / greatest((select stddev_pop(l) from start_l), 1e-6) as theta from start_l"
TABLES["rows0"] = "select resp.r, resp.c, obs, theta from resp join start_r on resp.r = start_r.r"
TABLES["nw0"] = f"select c, n_resp, p, {LOGIT.format('p')} as d0, 0e0 as a, {LOGIT.format('p')} as d from rates"
for _k in range(1, 5):
    TABLES[f"nw{_k}"] = f"""
select c, n_resp, p, d0, a + (hdd*ga - had*gd)/(haa*hdd - had*had) as a, d + (haa*gd - had*ga)/(haa*hdd - had*had) as d from (
  select w.c, w.n_resp, w.p, w.d0, w.a, w.d, sum((obs-q)*theta) - w.a as ga, sum(obs-q) - (w.d - w.d0) as gd,
    sum(q*(1-q)*theta*theta) + 1 as haa, sum(q*(1-q)*theta) as had, sum(q*(1-q)) + 1 as hdd
  from (select rows0.*, n.n_resp, n.p, n.d0, n.a, n.d, 1/(1+exp(-(n.a*theta+n.d))) as q from rows0 join nw{_k - 1} n on rows0.c = n.c) w
  group by w.c, w.n_resp, w.p, w.d0, w.a, w.d)"""
TABLES["nw"] = "select c, n_resp, p, d0, a, d, case when abs(a) > 1e-9 then -d/a end as b from nw4"
TABLES["nw_info"] = """
select nw.c, sum(q*(1-q)*theta*theta) + 1 as iaa, sum(q*(1-q)*theta) as iad, sum(q*(1-q)) + 1 as idd,
  sqrt(power(sum((obs-q)*theta) - any_value(nw.a), 2) + power(sum(obs-q) - (any_value(nw.d) - any_value(nw.d0)), 2)) as gradient
from (select rows0.*, 1/(1+exp(-(n.a*theta+n.d))) as q from rows0 join nw n on rows0.c = n.c) x join nw on x.c = nw.c group by nw.c"""
TABLES["nw_fit"] = """
select nw.c, n_resp, p, a, d, b, gradient, sqrt(idd/det) as a_sd,
  case when abs(a) > 1e-9 then sqrt(greatest((iaa/det + 2*b*(-iad/det) + b*b*idd/det)/(a*a), 0)) end as b_sd
from nw join (select *, iaa*idd - iad*iad as det from nw_info) i on nw.c = i.c"""
TABLES["nw_iv"] = """
select *, a - 1.959963985e0*a_sd as a_lo, a + 1.959963985e0*a_sd as a_hi, b - 1.959963985e0*b_sd as b_lo, b + 1.959963985e0*b_sd as b_hi from nw_fit"""
TABLES["ends"] = "select min(theta) as t0, max(theta) as t1, greatest(max(theta) - min(theta), 1e-6) as span from start_r"
TABLES["fl"] = """
select nw_iv.*, itm.item_id, itm.subject, a_lo <= 0 and a_hi >= 0 as unsure,
  not (a_lo <= 0 and a_hi >= 0) and a_lo > -0.35e0 and a_hi < 0.35e0 as dead,
  not (a_lo > -0.35e0 and a_hi < 0.35e0) and a_hi < 0 as inverted,
  p >= 0.99e0 as ceil_, p <= 0.01e0 as floor_,
  not (a_lo <= 0 and a_hi >= 0) and coalesce(b < t0 - span or b > t1 + span, false) as off
from nw_iv cross join ends join itm on nw_iv.c = itm.c"""
TABLES["pool"] = "select *, 0 as tier from fl where not (unsure or inverted or ceil_ or floor_)"
TABLES["pads"] = "select *, 1 as tier from fl where unsure and n_resp > 0 and a > 0 and not (inverted or ceil_ or floor_)"
TABLES["both_tiers"] = "select * from pool union all select * from pads"
TABLES["pts"] = "select start_r.r, model_id, theta, 1e0/(count(*) over (partition by model_id))/(select count(distinct model_id) from peop) as weight from start_r join peop on start_r.r = peop.r"
INFO = "({a})*({a})*(1/(1+exp(-({a})*({t}-({b})))))*(1-1/(1+exp(-({a})*({t}-({b})))))"


def info(a: str = "a", b: str = "b", t: str = "theta") -> str:
    return INFO.format(a=a, b=b, t=t)


TABLES["tier_score"] = f"select c, tier, round(sum(weight*{info()}), 10) as score from both_tiers cross join pts group by c, tier"
TABLES["anchors"] = "select row_number() over (order by tier, score desc, c) as rank, c, score, tier from tier_score"
TABLES["anchor40"] = "select * from anchors where rank <= 40"
TABLES["acc"] = "select peop.model_id, avg(obs) as accuracy from resp join peop on resp.r = peop.r group by peop.model_id"
