"""Registered queries that score the given tables with models of fixed numbers, and their SQL.

The numbers are made up, so that SQL can repeat every score; the path is the one that fitted models take.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import lexical, pairs
from ..operators import flow_features as FF, flows as FL, formulas as FO, models as MO
from ..plans import jobs as P
from ..session import cut_lineage, shared_dir
from ..streaming import jobs as SJ
from . import tables as X
from .jobs import _packet_files
from .oracle import CANDIDATES_SQL, CHUNKED, DNS_LONG, FULL, LINES, _dga, _iso, _pair_values, _r

DGA_MODEL = FO.Linear([[-0.11, -0.02, 0.03, -0.25, 0.4, -1.5, 0.2, -0.3, -0.35, 0.15, 1.2]], [0.1])
DGA_LABELS = ["dga", "legit"]
PAIR_MODEL = FO.Linear(
    [[-0.4, -3.0, 1.5, 2.5, -1.1, 0.3, 0.2, -0.5, 0.1, 0.1, 0.4], [0.5, 4.0, -2.0, -1.5, 0.0, -0.2, -0.1, 0.3, 0.0, 0.0, -0.4],
     [-0.4, -3.0, 1.5, 2.5, 1.1, 0.3, 0.2, -0.5, 0.1, 0.1, 0.4]], [0.2, 0.5, 0.1])
PAIR_LABELS = ["addition", "none", "omission"]

FLOW_COLUMNS = ["protocol", "packets_numbers", "total_bytes", "ttl_values_max", "not_in_table"]
FLOW_LABELS = ["Benign", "Malicious"]
_leaf = lambda *v: FO.Node(leaf=v)
FOREST = FO.Trees([
    {0: FO.Node(1, 3.5, 1, 2), 1: _leaf(0.9, 0.1), 2: FO.Node(2, 900.0, 3, 4), 3: _leaf(0.55, 0.45), 4: _leaf(0.15, 0.85)},
    {0: FO.Node(0, 0.5, 1, 4), 1: FO.Node(3, 4.5, 2, 3), 2: _leaf(0.5, 0.5), 3: _leaf(0.2, 0.8), 4: _leaf(0.6, 0.4)},
    {0: FO.Node(2, 400.0, 1, 2), 1: _leaf(0.8, 0.2), 2: FO.Node(4, 0.0, 3, 4), 3: _leaf(0.25, 0.75), 4: _leaf(1.0, 0.0)},
], [1.0, 1.0, 1.0])
BOOSTED = FO.Trees([
    {0: FO.Node(2, 500.0, 1, 2), 1: _leaf(-0.8), 2: _leaf(0.6)},
    {0: FO.Node(0, 0.5, 1, 2), 1: FO.Node(1, 5.5, 3, 4), 2: _leaf(-0.2), 3: _leaf(0.1), 4: _leaf(0.9)},
], [1.0, 0.1])
ODDS = FO.Linear([[-0.3, 0.25, 0.002, 0.05, 9.0]], [-2.2])
HARD = FO.Linear([[0.1, -0.3, -0.001, 0.0, 0.0], [-0.2, 0.2, 0.001, 0.02, 5.0], [0.4, 0.1, 0.0005, -0.01, 0.0]],
                 [1.5, -1.0, -0.5], hard=True)
HARD_LABELS = ["Attack", "benign", "scan"]


def _kept_flows(spark, d):
    assigned = cut_lineage(FL.assign_flows(X.packets(spark, d), X.LIMITS))
    return FF.flow_features(assigned, allow=[
        "timestamp", "src_ip", "dst_ip", "dns_domain_name", *FLOW_COLUMNS])


def _flow_bundle(flows, model, labels=FLOW_LABELS):
    return MO.Bundle(model, labels, FLOW_COLUMNS, MO.text_codes(flows, ["protocol"]))


def tunnel_forest_alerts(spark, d):
    """Alert rows of the batch job by a forest, the protocol as codes."""
    flows = cut_lineage(_kept_flows(spark, d))
    return P.tunnel_scoring(flows, _flow_bundle(flows, FOREST))["alerts"]


def tunnel_boosted_summary(spark, d):
    """Summary row of the batch job by boosted trees, with the model columns that the table lacks."""
    flows = cut_lineage(_kept_flows(spark, d))
    out = P.tunnel_scoring(flows, _flow_bundle(flows, BOOSTED), 0.55)
    return out["summary"].withColumn("missing", F.lit(",".join(out["missing_feature_columns"])))


def tunnel_hard_alerts(spark, d):
    """Live alerts by a model that gives labels only."""
    flows = cut_lineage(_kept_flows(spark, d))
    hits = SJ.tunnel_handler(_flow_bundle(flows, HARD, HARD_LABELS))(flows)
    return hits.select("detector", "row_index", "label", "score", "src_ip", "dst_ip", "dns_domain_name", "unbound_logged_at")


def dga_formula_alerts(spark, d):
    """Alerts on generated names by logistic regression."""
    bundle = MO.Bundle(DGA_MODEL, DGA_LABELS, lexical.DGA_FEATURES)
    hits = P.dga_detection(X.log_lines(spark, d), bundle, F.col("logged_at"), threshold=0.5)
    return hits.select("detector", "domain", "score", F.round(F.col("scores")["legit"], 9).alias("legit"), "unbound_logged_at")


def typo_formula_matches(spark, d):
    """Best protected name of each queried name by a model of three classes, among the fifty most similar names."""
    bundle = MO.Bundle(PAIR_MODEL, PAIR_LABELS, pairs.PAIR_FEATURES)
    best = P.model_matches(X.queried_names(spark, d), X.protected(spark, d), bundle, 50)
    return best.withColumn("score", F.round("score", 9))


def live_tunnel_alerts(spark, d):
    """Packet files numbered alike, one per micro-batch, to flow features, scores and alerts in one chain."""
    where = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    schema = _packet_files(spark, d, where, sections=True).schema
    packets = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    bundle = MO.Bundle(ODDS, FLOW_LABELS, FLOW_COLUMNS)  # a text without a code is -1
    steps = SJ.live_chain(bundle, X.LIMITS, allow=["timestamp", "src_ip", "dst_ip", "dns_domain_name", *FLOW_COLUMNS])
    SJ.start_chain(packets, steps, where, f"{where}/checkpoint", None).awaitTermination()
    return spark.read.parquet(f"{where}/alerts").select(
        "detector", "row_index", "score", "src_ip", "dst_ip", "dns_domain_name", "unbound_logged_at",
        F.concat_ws(",", "missing_feature_columns").alias("missing"))


FIXED = {f.__name__: f for f in (
    tunnel_forest_alerts, tunnel_boosted_summary, tunnel_hard_alerts, dga_formula_alerts, typo_formula_matches,
    live_tunnel_alerts)}


# SQL

def _flow_inputs(packets: str, protocol: str) -> str:
    """Flows with the inputs of a flow model as x0 to x4."""
    return f"""with recursive {packets}, {DNS_LONG},
f as (select flow_uid, any_value(o_src) as src_ip, any_value(o_dst) as dst_ip, any_value(o_ts) as o_ts, count(*) as n,
  sum(len) as b, any_value(protocol) as protocol, arg_min(host, struct_pack(t := ts_us, p := pkt_no)) || '.' as name
  from a group by flow_uid),
t as (select flow_uid, max(ttl) as mx from ans group by flow_uid),
x as (select flow_uid, src_ip, dst_ip, o_ts, case when protocol = 'DNS' then name else '' end as dns_domain_name,
  cast({protocol} as double) as x0, cast(n as double) as x1, cast(b as double) as x2,
  cast(case when protocol = 'DNS' then coalesce(mx, -1) else -1 end as double) as x3, cast(0 as double) as x4
  from f left join t using (flow_uid))"""


_INPUTS = [f"x{i}" for i in range(5)]
_CODED = _flow_inputs(FULL, "dense_rank() over (order by protocol) - 1")
_forest, _boosted, _odds, _hard = (FO.sql(m, _INPUTS) for m in (FOREST, BOOSTED, ODDS, HARD))

FOREST_SQL = f"""{_CODED}, s as (select *, {_forest[0]} as p0, {_forest[1]} as p1 from x)
select flow_uid as row_index, case when p1 > p0 then 'Malicious' else 'Benign' end as predicted_label,
  round(p1, 6) as malicious_score, dns_domain_name, src_ip, dst_ip from s where p1 >= 0.5"""

BOOSTED_SQL = f"""{_CODED}, s as (select *, {_boosted[1]} as p1 from x)
select count(*) as rows_total, count(*) filter (where p1 >= 0.55) as alerts, cast(0.55 as double) as threshold,
  'not_in_table' as missing from s"""

HARD_SQL = f"""{_CODED}, s as (select *, {', '.join(f'{p} as p{i}' for i, p in enumerate(_hard))} from x)
select 'DNS_TUNNELING' as detector, flow_uid as row_index, 'Attack' as label, cast(1 as double) as score, src_ip, dst_ip,
  dns_domain_name, {_iso('o_ts')} as unbound_logged_at from s where p0 >= p1 and p0 >= p2"""

DGA_SQL = f"""with {LINES}, {_dga('qname')},
s as (select qname, {FO.sql(DGA_MODEL, lexical.DGA_FEATURES)[0]} as p from feats)
select 'DGA' as detector, q.qname as domain, round(p, 4) as score, {_r('1 - p')} as legit, {_iso('logged_us')} as unbound_logged_at
from q join s on s.qname = q.qname where p >= 0.5"""

_pair = _pair_values("target", "qname")
_three = FO.sql(PAIR_MODEL, [f"cast({k} as double)" for k in pairs.PAIR_FEATURES])
PAIRS_SQL = f"""with cand as ({CANDIDATES_SQL}),
feats as (select qname, target, cand_no, {', '.join(f'{_pair[k]} as {k}' for k in pairs.PAIR_FEATURES)} from cand),
s as (select qname, target, cand_no, {_three[0]} as p0, {_three[2]} as p2 from feats),
e as (select qname, target, cand_no, 0 as i, 'addition' as class, p0 as score from s
  union all select qname, target, cand_no, 1, 'omission', p2 from s)
select qname, target, class as predicted_class, {_r('score')} as score
from (select *, row_number() over (partition by qname order by score desc, cand_no, i) as rn from e) where rn = 1"""

LIVE_SQL = f"""{_flow_inputs(CHUNKED, '-1')}, s as (select *, {_odds[1]} as p from x)
select 'DNS_TUNNELING' as detector, 'file' || flow_uid % 5 || ':' || flow_uid // 5 as row_index, round(p, 4) as score,
  src_ip, dst_ip, dns_domain_name, {_iso('o_ts')} as unbound_logged_at, 'not_in_table' as missing from s where p >= 0.5"""

FIXED_SQL = {
    "tunnel_forest_alerts": FOREST_SQL, "tunnel_boosted_summary": BOOSTED_SQL, "tunnel_hard_alerts": HARD_SQL,
    "dga_formula_alerts": DGA_SQL, "typo_formula_matches": PAIRS_SQL, "live_tunnel_alerts": LIVE_SQL,
}
