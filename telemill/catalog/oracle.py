"""The registered queries in plain SQL, each written from its definition.

Range functions repeat every sample over the grid times that see it, which is simple and slow; it
shares no step with the cell-and-block method it is compared with.
"""

from __future__ import annotations

import re

MIN = 60 * 10**6
HOUR = 60 * MIN
DAY = 24 * HOUR

CTE: dict[str, str] = {}
SQL: dict[str, str] = {}


def sql(name: str, body: str) -> None:
    """Register a query with the common table expressions it names, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\bx_\w+", text):
            if word not in needed and word in CTE:
                visit(CTE[word])
                if word not in needed:
                    needed.append(word)

    visit(body)
    head = ",\n".join(f"{n} as ({CTE[n]})" for n in needed)
    SQL[name] = f"with {head}\n{body}" if head else body


def ceil_us(e: str, w: int) -> str:
    return f"((({e}) + {w - 1}) // {w}) * {w}"


def floor_us(e: str, w: int) -> str:
    return f"(({e}) // {w}) * {w}"


def secs(col: str, name: str | None = None) -> str:
    return f"cast({col} // 1000000 as bigint) as {name or col}"


def rnd(col: str, digits: int = 6, name: str | None = None) -> str:
    return f"round(cast({col} as double), {digits}) as {name or col}"


# --- views over the test tables ----------------------------------------------------------------

CTE["x_base"] = """select event_id, cast(ts as timestamp) as ts, epoch_us(cast(ts as timestamp)) as us, event_type,
  cast(round(value * 1000) as bigint) as inc,
  case user_id % 5 when 0 then 'open5gs-upf-0' when 1 then 'open5gs-upf-1' when 2 then 'open5gs-amf-2'
    when 3 then 'open5gs-smf-3' else 'x-open5gs-upf-4' end as pod,
  concat('node-', cast((user_id % 5 + cast(floor((dayofmonth(ts) - 1) / 10.0) as int)) % 4 as varchar)) as node,
  case event_type when 'click' then 'tx' when 'view' then 'tx' when 'purchase' then 'rx' when 'signup' then 'rx' else 'cpu' end as kind,
  case event_type when 'click' then 'eth0' when 'purchase' then 'eth0' when 'view' then 'ogstun' when 'signup' then 'ogstun' else 'c0' end as iface
  from events"""
CTE["x_resets"] = """select *, sum(case when event_id % 500 = 0 then 1 else 0 end)
  over (partition by pod, node, kind, iface order by ts, event_id rows between unbounded preceding and current row) as rst from x_base"""
CTE["x_counter"] = """select event_id, kind, pod, node, iface, ts, us, cast(sum(inc) over (partition by pod, node, kind, iface, rst
  order by ts, event_id rows between unbounded preceding and current row) as bigint) as v from x_resets"""
CTE["x_gauge"] = "select event_id, pod, event_type as container, ts, us, inc * 1000 as v from x_base"
CTE["x_label"] = """select * from (values ('node-0', 'm4.xlarge', 'upf-large'), ('node-1', 't3.medium', 'upf-small'),
  ('node-2', 'm4.large', 'upf-large'), ('node-3', 't2.micro', 'control-plane')) as t(node, instance_type, nodegroup)"""
CTE["x_info"] = """select b.node, b.us, case when dayofmonth(b.ts) <= 5 then 'm4.2xlarge' else l.instance_type end as instance_type,
  l.nodegroup from x_base b join x_label l on b.node = l.node"""
CTE["x_nodes"] = """select node, arg_max(instance_type, us) as instance_type, arg_max(nodegroup, us) as nodegroup from x_info group by node"""
CTE["x_upf_nodes"] = "select * from x_nodes where regexp_full_match(nodegroup, 'upf.*')"
CTE["x_price"] = """select * from (values ('t2.micro', cast(0.0116 as double)), ('t3.medium', cast(0.0416 as double)),
  ('m4.large', cast(0.10 as double)), ('m4.xlarge', cast(0.20 as double)), ('m4.2xlarge', cast(0.40 as double))) as t(instance_type, usd_per_hour)"""
CTE["x_pods"] = "select distinct pod, node, epoch_us(cast(date_trunc('hour', ts) as timestamp)) as us from x_base"
CTE["x_steps"] = """select user_id as episode, cast(row_number() over (partition by user_id order by ts, event_id) as bigint) as step,
  event_id as seq, cast(case when event_type in ('click', 'error') then 0 else 1 end as bigint) as action,
  cast(round(value * 1000) as bigint) as throughput from events"""
CTE["x_urls"] = """select page_id, concat('https://github.com/org', cast(page_id % 7 as varchar), '/repo/blob/feature/',
  cast(page_id as varchar), '/charts/core/values.yaml') as url from pages"""

UPF = "regexp_full_match(pod, 'open5gs-upf.*')"
OGSTUN = "regexp_full_match(iface, 'ogstun.*')"


# --- range functions ---------------------------------------------------------------------------


def increase_cte(name: str, src: str, keys: str, d: int, s: int) -> None:
    """``name`` holds keys, t, inc and rate; rows of ``src`` need us and v."""
    CTE[f"{name}_lag"] = f"select {keys}, us, v, lag(v) over (partition by {keys} order by us, v) as pv from {src}"
    c = ceil_us("us", s)
    CTE[f"{name}_seen"] = f"""select {keys}, us, v, case when v < pv then pv else 0 end as adj,
      unnest(generate_series({c}, {c} + {d - s}, {s})) as t from {name}_lag"""
    CTE[f"{name}_agg"] = f"""select {keys}, t, count(*) as n, min(us) as ft, max(us) as lt, arg_min(v, us) as fv,
      arg_max(v, us) as lv, sum(adj) - arg_min(adj, us) as adj from {name}_seen group by {keys}, t"""
    CTE[f"{name}_inc"] = f"""select *, cast(lv - fv + adj as bigint) as inc, (lt - ft) / 1e6 as si, ((lt - ft) / 1e6) / (n - 1) as av,
      (ft - (t - {d})) / 1e6 as ds, (t - lt) / 1e6 as de from {name}_agg where n >= 2 and lt > ft"""
    CTE[f"{name}_cut"] = f"""select *, case when de >= 1.1 * av then av / 2 else de end as de2,
      case when ds >= 1.1 * av then av / 2 else ds end as ds1 from {name}_inc"""
    CTE[name] = f"""select {keys}, t, inc, cast(inc as double) / {d / 1e6} as plain,
      inc * ((si + case when inc > 0 and fv >= 0 then least(ds1, si * fv / inc) else ds1 end + de2) / si) / {d / 1e6} as rate from {name}_cut"""


SERIES = "kind, pod, node, iface"
RATE_D, OUTER_D, TRAFFIC_D, STEP, LOOKBACK = 6 * HOUR, 3 * DAY, 12 * HOUR, HOUR, 6 * HOUR
WINDOW, PERIOD, DELTA, SAMPLES, WINDOW_MINUTES = 15 * HOUR, 5 * HOUR, 15 * MIN, 60, 900

increase_cte("x_rate", "x_counter", SERIES, RATE_D, STEP)
CTE["x_cpu"] = "select * from x_counter where kind = 'cpu'"
increase_cte("x_cpurate", "x_cpu", SERIES, RATE_D, STEP)
CTE["x_cpu_seen"] = f"select {SERIES}, rate, unnest(generate_series(t, t + {OUTER_D - STEP}, {STEP})) as t from x_cpurate"
CTE["x_cpuover"] = f"select {SERIES}, t, max(rate) as max_cpu, avg(rate) as avg_cpu from x_cpu_seen group by all"
CTE["x_gauge_seen"] = f"""select pod, container, v,
  unnest(generate_series({ceil_us("us", STEP)}, {ceil_us("us", STEP)} + {OUTER_D - STEP}, {STEP})) as t from x_gauge"""
CTE["x_memover"] = "select pod, container, t, max(v) as max_mem, avg(v) as avg_mem from x_gauge_seen group by all"
CTE["x_cpupod"] = "select t, pod, sum(max_cpu) as max_cpu, sum(avg_cpu) as avg_cpu from x_cpuover group by t, pod"
CTE["x_mempod"] = "select t, pod, sum(max_mem) as max_mem, sum(avg_mem) as avg_mem from x_memover group by t, pod"
CTE["x_usage"] = "select t, pod, max_cpu, avg_cpu, max_mem, avg_mem from x_cpupod full join x_mempod using (t, pod)"
CTE["x_traffic"] = f"select kind as direction, pod, node, iface, ts, us, v from x_counter where kind in ('tx', 'rx') and {UPF}"
increase_cte("x_trate", "x_traffic", "direction, pod, node, iface", TRAFFIC_D, STEP)


def lookup_cte(name: str, src: str, keys: str, value: str) -> None:
    last = floor_us(f"us + {LOOKBACK - 1}", STEP)
    CTE[f"{name}_seen"] = f"select {keys}, us, v, unnest(generate_series({ceil_us('us', STEP)}, {last}, {STEP})) as t from {src}"
    CTE[name] = f"select {keys}, t, {value} as v from {name}_seen group by {keys}, t"


lookup_cte("x_look", "x_counter", SERIES, "arg_max(v, us)")
CTE["x_plane"] = f"select * from x_counter where kind = 'tx' and {UPF} and {OGSTUN}"
lookup_cte("x_planelook", "x_plane", SERIES, "arg_max(v, us)")
CTE["x_totals"] = "select t, cast(sum(v) as bigint) as throughput from x_planelook group by t"
increase_cte("x_planeinc", "x_plane", SERIES, LOOKBACK, STEP)


def windows_of(src: str, width: int = WINDOW) -> str:
    return f"select *, unnest(generate_series({ceil_us('t', PERIOD)}, {floor_us(f't + {width - 1}', PERIOD)}, {PERIOD})) as obs_t from {src}"


# --- observation windows -----------------------------------------------------------------------

CTE["x_win"] = windows_of("x_totals")
CTE["x_norm"] = "select obs_t, t, throughput - first_value(throughput) over (partition by obs_t order by t) as x from x_win"
CTE["x_bins"] = f"select obs_t, {floor_us('t', DELTA)} as t, avg(x) as x from x_norm group by all"
CTE["x_span"] = "select obs_t, min(t) as lo, max(t) as hi from x_bins group by obs_t"
CTE["x_slots"] = f"select obs_t, unnest(generate_series(lo, hi, {DELTA})) as t from x_span"
CTE["x_grid"] = "select s.obs_t, s.t, b.x from x_slots s left join x_bins b on s.obs_t = b.obs_t and s.t = b.t"
CTE["x_near"] = """select obs_t, t, x,
  last_value(x ignore nulls) over (partition by obs_t order by t rows between unbounded preceding and current row) as pv,
  max(case when x is not null then t end) over (partition by obs_t order by t rows between unbounded preceding and current row) as pt,
  first_value(x ignore nulls) over (partition by obs_t order by t rows between current row and unbounded following) as nv,
  min(case when x is not null then t end) over (partition by obs_t order by t rows between current row and unbounded following) as nt
  from x_grid"""
CTE["x_lin"] = "select obs_t, t, coalesce(x, pv + (nv - pv) * (t - pt) / (nt - pt), pv) as x from x_near"
CTE["x_podin"] = f"select node, us, 1 as v from x_pods where {UPF}"
lookup_cte("x_nodeseen", "x_podin", "node", "1")
CTE["x_seenwin"] = windows_of("x_nodeseen")
CTE["x_present"] = "select w.obs_t, w.t, i.instance_type from x_seenwin w asof join x_info i on w.node = i.node and w.obs_t >= i.us"
CTE["x_marks"] = """select obs_t, t, max(case when instance_type = 'm4.xlarge' then 1.0 end) as large,
  max(case when instance_type = 't3.medium' then 1.0 end) as small from x_present group by obs_t, t"""
CTE["x_firston"] = """select g.obs_t, min(case when m.large = 1 then g.t end) as large_from, min(case when m.small = 1 then g.t end) as small_from
  from x_slots g join x_marks m on g.obs_t = m.obs_t and g.t = m.t group by g.obs_t"""
CTE["x_flags"] = """select g.obs_t, g.t, case when g.t >= f.large_from then 1.0 else 0.0 end as large_on,
  case when g.t >= f.small_from then 1.0 else 0.0 end as small_on from x_slots g left join x_firston f on g.obs_t = f.obs_t"""
CTE["x_padslots"] = f"""select obs_t, slot, hi - ({SAMPLES - 1} - slot) * {DELTA} as t, greatest(lo, hi - ({SAMPLES - 1} - slot) * {DELTA}) as src
  from x_span, (select unnest(generate_series(0, {SAMPLES - 1})) as slot)"""
CTE["x_obs"] = """select p.obs_t, p.slot, p.t, coalesce(l.x, 0) as throughput, f.large_on, f.small_on from x_padslots p
  join x_lin l on l.obs_t = p.obs_t and l.t = p.src join x_flags f on f.obs_t = p.obs_t and f.t = p.src"""

# --- observation vectors -----------------------------------------------------------------------

CTE["x_pivot"] = """select t, sum(case when direction = 'rx' and iface = 'eth0' then rate end) as rx_eth0,
  sum(case when direction = 'rx' and iface = 'ogstun' then rate end) as rx_ogstun,
  sum(case when direction = 'tx' and iface = 'eth0' then rate end) as tx_eth0,
  sum(case when direction = 'tx' and iface = 'ogstun' then rate end) as tx_ogstun from x_trate group by t"""
CTE["x_used"] = "select distinct t, node from x_trate"
CTE["x_usedas"] = "select u.t, i.instance_type, i.nodegroup from x_used u asof left join x_info i on u.node = i.node and u.t >= i.us"
CTE["x_cost"] = """select u.t, coalesce(sum(p.usd_per_hour), 0) as cost from x_usedas u
  left join x_price p on u.instance_type = p.instance_type and regexp_full_match(u.nodegroup, 'upf.*') group by u.t"""
CTE["x_vec"] = """select v.*, coalesce(c.cost, 0) as cost,
  coalesce(rx_eth0, 0) + coalesce(rx_ogstun, 0) + coalesce(tx_eth0, 0) + coalesce(tx_ogstun, 0) as throughput from x_pivot v left join x_cost c using (t)"""
CTE["x_vecr"] = "select *, throughput * (cast(3.33 as double) / 1000000000) * 3600.0 - cost as reward from x_vec"
CTE["x_daysteps"] = f"""select *, t // {DAY} as episode, cast((t % {DAY}) // {HOUR} + 1 as bigint) as step,
  case when t = min(t) over (partition by t // {DAY}) then 0 else 1 end as step_type,
  case when coalesce(tx_ogstun, 0) > coalesce(rx_ogstun, 0) then 1 else 0 end as action from x_vecr"""
CTE["x_usersteps"] = """select *, throughput * (cast(3.33 as double) / 1000000000) * 3600.0 - case when action = 1 then cast(0.10 as double)
  else cast(0.0416 as double) end as reward from x_steps"""

# --- configurations ----------------------------------------------------------------------------


def sized(mb: str, milli: str) -> str:
    return f"""concat('{{"memory":"', {mb}, 'Mi","cpu":"', {milli}, 'm"}}')"""


def resources(req: str, lim: str) -> str:
    return f"""concat('{{"amf":{{"resources":{{"requests":', {req}, ',"limits":', {lim}, '}}}}')"""


def selector(first: str) -> str:
    def term(size: str) -> str:
        return (
            f"""concat('{{"matchExpressions":[{{"key":"nodegroup","operator":"In","values":["', {size}, '"]}},"""
            f"""{{"key":"zone","operator":"In","values":["', c_nationkey, '"]}}]}}')"""
        )

    own = "case when c_nationkey % 2 = 0 then 'Large' else 'Small' end"
    return (
        """concat('"upf":{"affinity":{"nodeAffinity":{"requiredDuringSchedulingIgnoredDuringExecution":{"nodeSelectorTerms":[', """
        f"""case when c_custkey % 7 <> 0 then concat({term(first)}, ',', {term(own)}) else '' end, ']}}}}}}}}}}')"""
    )


OWN_SIZE = "case when c_nationkey % 2 = 0 then 'Large' else 'Small' end"
NEW_SIZE = "case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'Large' else 'Small' end"
OWN_RES = resources(sized("c_nationkey + 100", "c_nationkey * 10 + 100"), sized("c_nationkey + 200", "c_nationkey * 20 + 100"))
NEW_RES = resources(sized("cents % 1000", "cents % 700"), sized("cents % 1000 + 50", "cents % 700 + 35"))
CTE["x_cust"] = "select *, cast(round(abs(c_acctbal) * 100) as bigint) as cents from customer"
CTE["x_doc"] = f"""select c_custkey as cfg_id, c_custkey, concat({OWN_RES}, ',', {selector(OWN_SIZE)}) as body,
  concat({NEW_RES}, ',', {selector(OWN_SIZE)}) as limits_body, concat({OWN_RES}, ',', {selector(NEW_SIZE)}) as group_body from x_cust"""
CTE["x_cfg"] = "select *, sha256(body) as sha from x_doc"
CTE["x_upd"] = """select cfg_id, cfg_id * 2 as seq, case when cfg_id % 10 = 0 then sha256(sha) else sha end as base_sha, limits_body as body from x_cfg
  union all select cfg_id, cfg_id * 2 + 1, sha, group_body from x_cfg where cfg_id % 7 <> 0"""
CTE["x_judged"] = """select u.*, c.sha as now_sha, u.base_sha = c.sha and
  row_number() over (partition by u.cfg_id order by u.base_sha <> c.sha, u.seq) = 1 as ok from x_upd u join x_cfg c using (cfg_id)"""

CTE["x_own"] = """select o_custkey as cfg_id, o_orderkey as seq,
  concat('{"order":', cast(o_orderkey as varchar), ',"status":"', o_orderstatus, '"}') as body from orders"""
CTE["x_shas"] = "select cfg_id, seq, sha256(body) as sha from x_own where seq % 5 <> 0"
CTE["x_chain"] = """select o.cfg_id, o.seq, coalesce(s.sha, c.sha) as base_sha, o.body, sha256(o.body) as sha
  from x_own o join x_cfg c on o.cfg_id = c.cfg_id asof left join x_shas s on o.cfg_id = s.cfg_id and o.seq > s.seq"""
CTE["x_links"] = """select a.cfg_id, a.seq, min(b.seq) as next_seq from x_chain a join x_chain b
  on a.cfg_id = b.cfg_id and a.sha = b.base_sha and b.seq > a.seq group by all"""
CTE["x_won"] = """with recursive won as (select u.cfg_id, min(u.seq) as seq from x_chain u join x_cfg c on u.cfg_id = c.cfg_id and u.base_sha = c.sha group by all
  union all select l.cfg_id, l.next_seq from won w join x_links l on l.cfg_id = w.cfg_id and l.seq = w.seq) select * from won"""

# --- trials ------------------------------------------------------------------------------------

CTE["x_tx"] = f"select * from x_counter where kind = 'tx' and {UPF}"
increase_cte("x_txrate", "x_tx", SERIES, TRAFFIC_D, STEP)
CTE["x_podrate"] = "select t, pod, sum(rate) as rate from x_txrate group by t, pod"
CTE["x_podas"] = "select p.pod, p.node, p.us, i.nodegroup from x_pods p asof join x_info i on p.node = i.node and p.us >= i.us"
CTE["x_place"] = f"select pod as study_id, us as t, arg_min(nodegroup, node) as grp from x_podas where {UPF} group by pod, us"
CTE["x_sizes"] = f"""select study_id, t, t // {HOUR} as trial_id,
  case when grp like '%large' then 'Large' when grp like '%small' then 'Small' end as size from x_place"""
CTE["x_ledger"] = """select s.study_id, s.trial_id, s.size, r.rate as throughput,
  case s.size when 'Small' then cast(0.0416 as double) when 'Large' then cast(0.10 as double) end as cost
  from x_sizes s join x_podrate r on s.study_id = r.pod and s.t = r.t"""
CTE["x_ledgerr"] = "select *, throughput * (cast(3.33 as double) / 1000000000) * 3600.0 - cost as reward from x_ledger"

# === one query per key =========================================================================

sql("instant_vector_parse", "select pod, container, us, v from x_gauge")
sql("range_vector_parse", "select pod, container, us, v from x_gauge")
CTE["x_bodies"] = "select *, event_id // 100 as body_id from x_gauge"
sql("mixed_answers", """select kind, pod, container, us, v from x_bodies, (values ('vector'), ('matrix')) k(kind)
  where body_id % 7 <> 3 and body_id % 11 <> 5""")
sql("rejected_answers", """select reason, 2 * count(*) as rejects from (select distinct body_id,
  case when body_id % 7 = 3 then 'error timeout' when body_id % 11 = 5 then 'no JSON' end as reason from x_bodies) where reason is not null group by reason""")
sql("sample_scan", """select event_id, pod, node, iface, us, v from x_counter where kind = 'tx'
  and ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-20'""")
sql("query_set", f"""select {secs('t')}, pod, {rnd('value', 3)}, query_name from (
  select t, pod, max_cpu as value, 'max_cpu' as query_name from x_cpupod union all select t, pod, avg_cpu, 'avg_cpu' from x_cpupod
  union all select t, pod, cast(max_mem as double), 'max_memory' from x_mempod union all select t, pod, avg_mem, 'avg_memory' from x_mempod)""")
sql("node_dim", "select node, instance_type, nodegroup from x_upf_nodes")
sql("price_dim", "select p.instance_type, p.usd_per_hour, count(*) as samples from x_info i join x_price p on i.instance_type = p.instance_type group by all")
sql("config_url_parse", """select page_id, concat('org', cast(page_id % 7 as varchar), '/repo') as repo,
  concat('feature/', cast(page_id as varchar)) as branch, 'charts/core' as dir, 'values.yaml' as file from x_urls""")
sql("config_url_rejects", """select page_id, url from pages where not list_contains(string_split(url, '/'), 'blob')
  or not list_contains(list_slice(string_split(url, '/'), list_position(string_split(url, '/'), 'blob'), null), 'charts')""")
sql("patch_limits", "select cfg_id, sha as base_sha, limits_body as body from x_cfg")
sql("patch_nodegroup", "select cfg_id, sha as base_sha, group_body as body from x_cfg where cfg_id % 7 <> 0")
sql("unpatchable_configs", "select cfg_id, sha as base_sha from x_cfg where cfg_id % 7 = 0")
sql("config_cas_apply", """select cfg_id, seq, case when ok then 'accepted' else 'rejected' end as status,
  case when ok then sha256(body) end as sha from x_judged""")
sql("config_next_versions", """select c.cfg_id, coalesce(sha256(j.body), c.sha) as sha, coalesce(j.body, c.body) as body
  from x_cfg c left join (select * from x_judged where ok) j on c.cfg_id = j.cfg_id""")


sql("config_chain_apply", """select u.cfg_id, u.seq, u.base_sha, w.seq is not null as accepted
  from x_chain u left join x_won w on u.cfg_id = w.cfg_id and u.seq = w.seq""")
sql("config_chain_versions", """select c.cfg_id, coalesce(n.sha, c.sha) as sha, coalesce(n.body, c.body) as body from x_cfg c left join (
  select u.cfg_id, arg_max(u.sha, u.seq) as sha, arg_max(u.body, u.seq) as body from x_chain u join x_won w on u.cfg_id = w.cfg_id and u.seq = w.seq
  group by u.cfg_id) n on c.cfg_id = n.cfg_id""")


def quantity_mem(col: str, headroom: str = "") -> str:
    return f"concat(cast(cast(trunc(cast({col} as double) / 1000000{headroom}) as bigint) as varchar), 'Mi')"


def quantity_cpu(col: str, headroom: str = "* 1.0") -> str:
    milli = f"trunc(cast({col} as double) * 1000)"
    more = f"cast(cast(trunc(cast({milli} as bigint) * cast({headroom[2:]} as double)) as bigint) as varchar)"
    return f"case when {milli} > 100 then concat({more}, 'm') when {milli} is not null then '100m' end"


def if_known(col: str, text: str) -> str:
    return f"case when {col} is not null then {text} end"


def sizing(request_cpu: str = "avg_cpu") -> str:
    avg_mem, max_mem = "round(avg_mem, 3)", "round(cast(max_mem as double), 3)"
    request, most = f"round({request_cpu}, 9)", "round(max_cpu, 9)"
    return (
        f"{if_known('avg_mem', quantity_mem(avg_mem))} as request_memory, {quantity_cpu(request)} as request_cpu, "
        f"{if_known('max_mem', quantity_mem(max_mem, ' * cast(1.05 as double)'))} as limit_memory, {quantity_cpu(most, '* 1.05')} as limit_cpu"
    )


sql("requested_actions_sink", f"select {secs('t')}, pod, 'amf' as target_pod, {sizing()} from x_usage where contains(pod, 'amf')")
sql("label_regex_filter", f"select event_id, pod, iface from x_base where {UPF} and regexp_full_match(iface, 'e.h[0-9]+|c0')")
sql("label_eq_filter", "select event_id, node, pod from x_base where node = 'node-1'")
sql("multi_matcher_filter", f"select event_id, pod, iface from x_base where {UPF} and {OGSTUN}")
sql("pod_contains_filter", "select event_id, pod from x_base where contains(pod, 'amf')")
sql("missing_label_drop", "select event_id, pod, inc from x_base where event_type <> 'error'")
sql("result_project", "select pod, cast(v as double) as v from x_gauge")
sql("vector_slice", f"select {secs('t')}, {rnd('rx_eth0', 6, 'first_part')}, {rnd('tx_ogstun', 6, 'last_part')}, {rnd('cost')} from x_vec")
sql("counter_rate", f"select {SERIES}, {secs('t')}, {rnd('rate')} from x_rate")
sql("counter_rate_plain", f"select {SERIES}, {secs('t')}, {rnd('plain', 6, 'rate')} from x_rate")
sql("counter_increase", f"select {SERIES}, {secs('t')}, inc from x_rate")
sql("max_over_time", f"select pod, container, {secs('t')}, max_mem as max_value from x_memover")
sql("avg_over_time", f"select pod, container, {secs('t')}, {rnd('avg_mem', 3, 'avg_value')} from x_memover")
sql("max_rate_subquery", f"select {SERIES}, {secs('t')}, {rnd('max_cpu', 6, 'max_rate')} from x_cpuover")
sql("avg_rate_subquery", f"select {SERIES}, {secs('t')}, {rnd('avg_cpu', 6, 'avg_rate')} from x_cpuover")
sql("instant_lookup", f"select {SERIES}, {secs('t')}, v from x_look")
CTE["x_memory"] = "select pod, us, max(v) as v from x_gauge where container <> 'purchase' group by pod, us"
sql("event_lookup", f"""select b.event_id, b.pod, case when b.us - m.us < {HOUR} then m.v end as v
  from x_base b asof left join x_memory m on b.pod = m.pod and b.us >= m.us where b.event_type = 'purchase'""")
sql("event_instance", """select b.event_id, b.node, i.instance_type from x_base b
  asof left join (select node, us, max(instance_type) as instance_type from x_info group by all) i on b.node = i.node and b.us >= i.us""")
sql("window_slice", f"select {secs('obs_t')}, {secs('t')}, throughput from x_win")
CTE["x_win10"] = windows_of("x_totals", 10 * HOUR)
sql("range_literal", f"""select {secs('obs_t')}, count(*) as points, arg_max(throughput, t) as newest, cast(10 as bigint) as hours from x_win10 group by obs_t
  union all select {secs('obs_t')}, count(*), arg_max(throughput, t), cast(15 as bigint) from x_win group by obs_t""")
sql("pod_metric_align", f"select {secs('t')}, pod, {rnd('max_cpu', 3)}, {rnd('avg_cpu', 3)}, {rnd('max_mem', 3)}, {rnd('avg_mem', 3)} from x_usage")
sql("used_node_semi", "select * from x_upf_nodes where node in (select node from x_traffic)")
CTE["x_placed"] = "select pod, node, count(*) as hours from x_pods group by pod, node"
sql("node_instance_lookup", "select p.node, p.pod, p.hours, n.instance_type from x_placed p join x_nodes n on p.node = n.node")
sql("price_lookup", """select p.node, p.pod, p.hours, n.instance_type, r.usd_per_hour from x_placed p join x_nodes n on p.node = n.node
  left join x_price r on n.instance_type = r.instance_type""")
sql("unknown_instance_types", "select distinct instance_type from x_info where instance_type not in ('t3.medium', 'm4.large', 'm4.xlarge')")
sql("grid_flag_update", f"""select {secs('g.obs_t', 'obs_t')}, {secs('g.t', 't')}, cast(coalesce(m.large, 0) as double) as large_on,
  cast(coalesce(m.small, 0) as double) as small_on from x_slots g left join x_marks m on g.obs_t = m.obs_t and g.t = m.t""")
sql("rx_tx_align", "select event_id, iface, v, kind as direction from x_counter where kind in ('tx', 'rx')")
sql("sum_by_pod", f"select {secs('t')}, pod, {rnd('rate')} from x_podrate")
sql("sum_all_by_time", f"select {secs('t')}, throughput from x_totals")
sql("sum_all_by_time_increase", "select cast(t // 1000000 as bigint) as t, cast(sum(inc) as bigint) as throughput from x_planeinc group by x_planeinc.t")
sql("sum_by_interface", "select cast(t // 1000000 as bigint) as t, direction, iface, round(sum(rate), 6) as rate from x_trate group by x_trate.t, direction, iface")
sql("observation_pivot", f"select {secs('t')}, {rnd('rx_eth0')}, {rnd('rx_ogstun')}, {rnd('tx_eth0')}, {rnd('tx_ogstun')} from x_pivot")
sql("distinct_nodes", f"select {secs('t')}, node from x_used")
sql("last_label_per_node", "select node, instance_type, nodegroup from x_nodes")
sql("node_history", """select node, instance_type, nodegroup, us as valid_from, lead(us) over (partition by node order by us) as valid_to
  from (select *, lag(instance_type) over w is distinct from instance_type or lag(nodegroup) over w is distinct from nodegroup as new
  from (select distinct node, us, instance_type, nodegroup from x_info) window w as (partition by node order by us)) where new""")
sql("infra_cost", f"select {secs('t')}, {rnd('cost')} from x_cost")
sql("total_throughput", f"select {secs('t')}, {rnd('throughput')} from x_vec")
CTE["x_reward"] = f"""select obs_t, arg_max(throughput, slot) as throughput, sum(large_on) / {SAMPLES} as on_large, sum(small_on) / {SAMPLES} as on_small
  from x_obs group by obs_t"""
sql("on_fraction", f"select {secs('obs_t')}, {rnd('on_large')}, {rnd('on_small')} from x_reward")
sql("bin_mean", f"""select pod, container, {rnd('avg(v)', 3, 'v')}, cast({floor_us('us', STEP)} // 1000000 as bigint) as ts
  from x_gauge group by pod, container, {floor_us('us', STEP)}""")
sql("baseline_normalise", f"select {secs('obs_t')}, {secs('t')}, {rnd('x', 6, 'throughput')} from x_norm")
sql("resample_grid", f"select {secs('obs_t')}, {secs('t')}, {rnd('x', 3, 'throughput')} from x_grid")
sql("linear_interpolate", f"select {secs('obs_t')}, {secs('t')}, {rnd('x', 3, 'throughput')} from x_lin")
sql("pad_front", f"""select {secs('p.obs_t', 'obs_t')}, slot, {secs('p.t', 't')}, {rnd('l.x', 3, 'throughput')} from x_padslots p
  join x_lin l on l.obs_t = p.obs_t and l.t = p.src""")
sql("instance_on_flags", f"select {secs('obs_t')}, {secs('t')}, cast(large_on as double) as large_on, cast(small_on as double) as small_on from x_flags")
sql("fill_zero", f"select {secs('obs_t')}, slot, {secs('t')}, {rnd('throughput', 3)}, {rnd('large_on', 3)}, {rnd('small_on', 3)} from x_obs")
sql("last_value", f"select {secs('obs_t')}, {rnd('throughput', 3)} from x_reward")
sql("transition_pairs", """select episode, step, seq, action, throughput, lead(seq) over w as next_seq, lead(throughput) over w as next_throughput,
  lead(action) over w as next_action from x_steps window w as (partition by episode order by step)""")
sql("first_step_flag", "select episode, step, cast(case when step = min(step) over (partition by episode) then 0 else 1 end as bigint) as step_type from x_steps")
sql("time_sort", f"select {secs('obs_t')}, {secs('t')}, {rnd('throughput')} from x_win order by 1, 2")
sql("first_row", "select cast(t // 1000000 as bigint) as t, min(pod) as pod, round(arg_min(rate, pod), 6) as rate from x_podrate group by x_podrate.t")
sql("fifo_latest_n", "select * from x_steps qualify row_number() over (partition by episode order by step desc) <= 3")
sql("epoch_to_ts", "select strftime(ts, '%Y-%m-%d %H:%M:%S') as stamp, pod from x_gauge")
sql("string_to_float", """select event_id, try_cast(json_extract_string(props, '$.k') as double) as k,
  try_cast(event_type as double) as no_number from events""")
sql("memory_quantity", f"select event_id, {quantity_mem('v')} as request_size, {quantity_mem('v', ' * cast(1.05 as double)')} as limit_size from x_gauge")
CTE["x_cores"] = "select event_id, inc / cast(100000 as double) as cores from x_base"
sql("cpu_quantity", f"select event_id, {quantity_cpu('cores')} as request_size, {quantity_cpu('cores', '* 1.05')} as limit_size from x_cores")
sql("right_size", f"select {secs('t')}, pod, {sizing()} from x_usage")
sql("right_size_by_max", f"select {secs('t')}, pod, {sizing('max_cpu')} from x_usage")
sql("hourly_reward", f"select {secs('t')}, {rnd('throughput')}, {rnd('cost')}, {rnd('reward')} from x_vecr")
sql("window_reward", f"""select {secs('obs_t')}, {rnd('throughput')}, {rnd('on_large')}, {rnd('on_small')},
  round(3.33e-9 * throughput - (cast(0.20 as double) / 60) * on_large * {WINDOW_MINUTES}
  - (cast(0.0416 as double) / 60) * on_small * {WINDOW_MINUTES}, 6) as reward from x_reward""")
sql("size_cost", """select study_id, trial_id, size,
  case size when 'Small' then cast(0.0416 as double) when 'Large' then cast(0.10 as double) end as bandit_cost,
  case size when 'Small' then cast(0.0416 as double) when 'Large' then cast(0.20 as double) end as window_cost from x_sizes""")
sql("action_decode", """select seq, case action when 0 then 'Small' when 1 then 'Large' end as q_size,
  case action when 1 then 'Large' when 2 then 'Small' end as window_size from x_steps""")
sql("grid_size", f"""select {secs('obs_t')}, count(*) as n_rows, cast(60 as bigint) as samples, cast({DELTA // 10**6} as bigint) as step_s,
  cast(15 as bigint) as live_step_s from x_obs group by obs_t""")
sql("observation_bounds", " union all ".join(
    [f"select {secs('t')}, '{c}' as field, {rnd(c, 3, 'value')}, cast(null as bigint) as obs_t from x_vec "
     f"where {c} is null or {c} < 0 or {c} > {hi}" for c, hi in
     [("rx_eth0", "1e10"), ("rx_ogstun", "1e10"), ("tx_eth0", "1e10"), ("tx_ogstun", "1e10"), ("cost", "35")]]
    + [f"select {secs('t')}, '{c}', {rnd(c, 3, 'value')}, {secs('obs_t')} from x_obs where {c} < 0 {more}" for c, more in
       [("throughput", ""), ("large_on", "or large_on > 1"), ("small_on", "or small_on > 1")]]))
VEC = "rx_eth0 rx_ogstun tx_eth0 tx_ogstun cost".split()
ROUNDED = ", ".join(rnd(c) for c in VEC)
sql("timestep_table", f"select episode, step, cast(step_type as bigint) as step_type, cast(1 as double) as discount, {ROUNDED}, {rnd('reward')} from x_daysteps")
NEXT = ", ".join(rnd(f"b.{c}", 6, f"next_{c}") for c in VEC)
NOW = ", ".join(rnd(f"a.{c}", 6, c) for c in VEC)
sql("trajectory_table", f"""select a.episode, a.step, cast(a.step_type as bigint) as step_type, {NOW}, cast(a.action as bigint) as action,
  cast(b.step_type as bigint) as next_step_type, {rnd('b.reward', 6, 'reward')}, cast(1 as double) as discount, {NEXT}
  from x_daysteps a join x_daysteps b on a.episode = b.episode and b.step = (select min(c.step) from x_daysteps c where c.episode = a.episode and c.step > a.step)""")
sql("replay_sequences", f"""select a.episode, a.step, a.seq as seq_1, b.seq as seq_2, a.action as action_1, b.action as action_2,
  {rnd('b.reward', 6, 'reward_2')} from x_usersteps a join x_usersteps b on a.episode = b.episode and b.step = a.step + 1""")
sql("replay_retain", "select * from x_steps order by seq desc limit 128")
sql("replay_kept", "select * from x_steps order by seq desc limit 128")
CTE["x_numbered"] = "select *, row_number() over (order by seq) - 1 as idx, count(*) over () as n from x_steps"
sql("replay_sample", """select k.idx // 10 as batch_no, k.idx as draw_no, r.episode, r.step, r.seq, r.action, r.throughput
  from (select idx, cast('0x' || substr(md5(concat('7-', cast(idx as varchar))), 1, 15) as bigint) % n as pick from x_numbered) k
  join x_numbered r on r.idx = k.pick""")
sql("replay_draw_counts", "select count(*) as drawn, true as as_expected from x_steps")
sql("trial_ledger", f"select study_id, trial_id, size, {rnd('throughput')}, {rnd('cost')}, {rnd('reward')} from x_ledgerr")
sql("best_arm", """select study_id, size, count(*) as trials, round(avg(reward), 6) as mean_reward, max(reward) as best_reward,
  arg_max(trial_id, (reward, -trial_id)) as best_trial from (select study_id, size, trial_id, round(reward, 6) as reward from x_ledgerr
  where reward is not null) group by study_id, size""")
sql("training_metrics", f"""select episode, count(*) as steps, {rnd('sum(reward)', 6, 'total_reward')}, {rnd('avg(reward)', 6, 'mean_reward')}
  from x_usersteps group by episode""")

# --- streams: the batch results of all ranges that the watermark has closed --------------------


def closed(src: str) -> str:
    return f"t <= ((select max(us) - 1 from {src}) // 1000) * 1000 - {HOUR}"


CTE["x_net"] = "select * from x_counter where kind in ('rx', 'tx')"
sql("stream_increase", f"select {SERIES}, {secs('t')}, inc from x_rate where {closed('x_counter')}")
sql("stream_rate", f"select {SERIES}, {secs('t')}, {rnd('rate')} from x_rate where kind in ('rx', 'tx') and {closed('x_net')}")
CTE["x_closed"] = f"select * from x_usage where {closed('x_gauge')} and {closed('x_cpu')}"
sql("stream_right_size", f"select {secs('t')}, pod, {sizing()} from x_closed")
CTE["x_amfgauge"] = "select * from x_gauge where contains(pod, 'amf')"
CTE["x_amfcpu"] = "select * from x_cpu where contains(pod, 'amf')"
sql("stream_actions", f"""select {secs('t')}, pod, 'amf' as target_pod, {sizing()} from x_usage where contains(pod, 'amf')
  and {closed('x_amfgauge')} and {closed('x_amfcpu')}""")
# the first of a document's two updates wins, and so does the second if the first left the text as it was
CTE["x_turns"] = """select cfg_id, sha, body, case when cfg_id % 2 = 0 then limits_body when cfg_id % 7 <> 0 then group_body else body end as first,
  case when cfg_id % 2 = 1 then limits_body when cfg_id % 7 <> 0 then group_body end as second from x_cfg"""
sql("stream_config_updates", "select cfg_id, sha256(case when first = body then coalesce(second, first) else first end) as sha from x_turns")
sql("stream_rejected_updates", """select cfg_id, cfg_id * 2 + case when cfg_id % 2 = 0 then 1 else 0 end as seq, sha as base_sha from x_turns
  where first <> body and second is not null""")
CTE["x_pairs"] = """select a.*, b.seq as next_seq, b.throughput as next_throughput, b.action as next_action
  from x_steps a join x_steps b on a.episode = b.episode and b.step = a.step + 1"""
sql("stream_transitions", "select * from x_pairs")
CTE["x_stepgap"] = """select user_id as episode, cast(row_number() over w as bigint) as step, event_id as seq, epoch_us(cast(ts as timestamp)) as us,
  lead(epoch_us(cast(ts as timestamp))) over w as next_us from events window w as (partition by user_id order by ts, event_id)"""
sql("stream_unpaired_steps", f"""select episode, step, seq from x_stepgap where (next_us is null or next_us > us + {3 * DAY})
  and us + {3 * DAY} < ((select max(us) from x_stepgap) // 1000) * 1000 - {HOUR}""")
sql("replay_stream", "select episode, step, seq, action, next_seq, next_throughput from x_pairs")
sql("stream_step_counter", "select user_id as episode, count(*) as steps from events group by user_id")
CTE["x_mark"] = f"select (max(us) // 1000) * 1000 - {15 * DAY} as mark from x_gauge"
sql("late_samples", """select count(*) filter (dayofmonth(ts) > 15 or us > mark) as kept,
  count(*) filter (dayofmonth(ts) <= 15 and us <= mark) as late from x_gauge, x_mark""")
