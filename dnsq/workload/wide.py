"""The wide feature table as a registered query with all columns in comparable form, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import enrich, flow_features as FF
from ..plans.jobs import flow_feature_table
from . import tables as X
from .oracle import (
    COUNTS_SQL, DELTA_LEN_SQL, DELTA_TIME_SQL, FULL, LEN_SQL, LEXICAL_SQL, LISTS_SQL, RECORDS_SQL, SHAKE, SHAKE_SQL,
    TTL_SQL, WHOIS_SQL, _iso,
)
from .queries import AS_OF, _joined, r

GRAMS = ["uni_gram_domain_name", "bi_gram_domain_name", "tri_gram_domain_name"]
TEXTS = [*GRAMS, "character_distribution", *FF.RECORD_LISTS, "dns_domain_name_servers"]  # lists, empty where there is none


def _places(name: str) -> int:
    """Decimal places at which a column is compared: few for moments of large numbers."""
    if name in FF.delta_time_names():
        for part, places in (("mean", 9), ("variance", 0), ("standard_deviation", 4), ("skewness", 6), ("coefficient", 6)):
            if part in name:
                return places
        return 7
    if name in FF.count_names() or name in ("handshake_duration", "delta_start"):
        return 6
    if name in [*FF.length_names(), *FF.delta_len_names()] or name.startswith("ttl_values_"):
        return 4
    return 9


def flow_feature_rows(spark, d):
    """The wide feature table of flows with handshakes, DNS sections and registration data."""
    packets = X.handshake_packets(spark, d, sections=True)
    table = flow_feature_table(packets, X.LIMITS, whois=X.whois(spark, d), as_of=AS_OF)
    dist = F.array_sort(F.transform(F.map_entries("character_distribution"), lambda e: F.concat(
        e["key"], F.lit(":"), e["value"].cast("string"))))
    out = {"timestamp": F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "character_distribution": F.concat_ws(",", dist),
           "dns_domain_name_servers": F.concat_ws(",", "dns_domain_name_servers")}
    out |= {c: _joined(F.col(c)) for c in [*GRAMS, *FF.RECORD_LISTS]}
    out |= {c: F.date_format(c, "yyyy-MM-dd") for c, source in enrich.WHOIS_SOURCE.items() if source.endswith("_date")}
    out |= {c: r(c, _places(c)) for c, kind in table.dtypes if kind == "double"}
    return table.withColumns(out)


def _sql() -> str:
    """Every group of columns by its own SQL, over packets with handshakes, joined by flow."""
    parts = {"c": COUNTS_SQL, "l": LEN_SQL, "dl": DELTA_LEN_SQL, "dt": DELTA_TIME_SQL, "h": SHAKE_SQL, "r": RECORDS_SQL,
             "t": TTL_SQL, "li": LISTS_SQL}
    by_flow = [f"{k} as materialized ({v.replace(FULL, SHAKE)})" for k, v in parts.items()]
    empty = ", ".join(f"coalesce({c}, '') as {c}" for c in TEXTS)
    return f"""with {', '.join(by_flow)}, x as materialized ({LEXICAL_SQL}), w as materialized ({WHOIS_SQL}),
head as materialized (with recursive {SHAKE}
  select flow_uid, strftime(make_timestamp(any_value(o_ts)), '%Y-%m-%d %H:%M:%S.%f') || '_' || any_value(o_src) || '_' || any_value(o_sport)
      || '_' || any_value(o_dst) || '_' || any_value(o_dport) || case when any_value(protocol) = 'DNS' then '_' || any_value(o_txid) else '' end as flow_id,
    {_iso('any_value(o_ts)')} as timestamp, any_value(o_src) as src_ip, any_value(o_sport) as src_port, any_value(o_dst) as dst_ip,
    any_value(o_dport) as dst_port, any_value(protocol) as protocol, 'Unknown' as label from a group by flow_uid)
select * replace ({empty}) from head join c using (flow_uid) join l using (flow_uid) join dl using (flow_uid) join dt using (flow_uid)
  join h using (flow_uid) left join r using (flow_uid) left join t using (flow_uid) left join li using (flow_uid)
  left join x using (dns_domain_name) left join w using (dns_domain_name)"""


WIDE = {"flow_feature_rows": flow_feature_rows}
WIDE_SQL = {"flow_feature_rows": _sql()}
