"""SQL for the registered queries, written for DuckDB and independent of the library's plans."""

from __future__ import annotations

from ..functions.lexical import COMMON_WORDS
from ..functions.stats import STATS
from ..operators.datasets import LOOKALIKES, key_neighbours

DAY = 86400 * 1_000_000

HOSTS = """
hosts as (select page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as host from pages),
domains as (select distinct host as domain from hosts),
ev as (
  select e.event_id, e.user_id as u, e.event_type, e.value, e.props, epoch_us(e.ts) as ts_us, h.host,
         '10.0.' || (e.user_id // 256) || '.' || (e.user_id % 256) as cli
  from events e join hosts h on h.page_id = e.event_id % (select count(*) from pages))
"""

LINES = HOSTS + """
, lines as (
  select '[' || (ts_us // 1000000) || '] unbound[7:0] info: ' || cli || ' ' ||
    case event_id % 5 when 0 then host || '. A IN' when 1 then 'query: ' || host || '. x'
      when 2 then 'query[A] ' || host || '. x' when 3 then 'QNAME ' || host || '. x' else 'noise' end as value
  from ev),
parsed as (
  select nullif(regexp_extract(value, '(\\d+\\.\\d+\\.\\d+\\.\\d+)', 1), '') as client,
    nullif(rtrim(lower(coalesce(
      nullif(regexp_extract(value, '(?i)query\\[[^\\]]+\\]\\s+([A-Za-z0-9._-]+)\\.', 1), ''),
      nullif(regexp_extract(value, '(?i)query:\\s+([A-Za-z0-9._-]+)\\.', 1), ''),
      nullif(regexp_extract(value, '(?i)QNAME\\s+([A-Za-z0-9._-]+)\\.', 1), ''),
      nullif(regexp_extract(value, '(?i)\\b([A-Za-z0-9._-]+)\\.\\s+[A-Z]{1,10}\\s+IN\\b', 1), ''))), '.'), '') as qname,
    try_cast(nullif(regexp_extract(value, '\\[(\\d+(?:\\.\\d+)?)\\]', 1), '') as double) as epoch,
    value
  from lines),
q as (select client, qname, cast(epoch * 1000000 as bigint) as logged_us from parsed
      where client is not null and qname is not null)
"""

BASE = "case when qname like '%.%' then split_part(qname, '.', -2) || '.' || split_part(qname, '.', -1) else qname end"


def _dga(name: str) -> str:
    """Feature columns of the first label of `name`."""
    def kept(pattern: str) -> str:
        return f"regexp_replace(n, '{pattern}', '', 'g')"

    def distinct(pattern: str) -> str:
        return f"len(list_distinct(string_split({kept(pattern)}, ''))) - case when {kept(pattern)} = '' then 1 else 0 end"

    words = " + ".join(f"cast(contains({kept('[^a-z]')}, '{w}') as int)" for w in COMMON_WORDS)
    return f"""
  base as (select distinct {name} as qname, lower(split_part({name}, '.', 1)) as n from q),
  raw as (select qname, n, length(n) as l, {distinct('[^a-z0-9]')} as uc, {distinct('[^a-z]')} as ul,
    {distinct('[^0-9]')} as ud, length({kept('[^a-z]')}) as nl, length({kept('[^0-9]')}) as nd,
    length({kept('[^aeiou]')}) as nv, {words} as nw,
    -list_sum(list_transform(list_distinct(string_split(n, '')),
      lambda c: (length(n) - length(replace(n, c, ''))) / length(n)
        * log2((length(n) - length(replace(n, c, ''))) / length(n)))) as h from base),
  feats as (select qname, l as domain_length, uc as domain_num_of_unique_char, ul as domain_num_of_unique_letters,
    ud as domain_num_of_unique_numbers,
    case when l > 0 then nl / l else 0 end as ratio_of_letters_of_domain_name,
    case when l > 0 then nd / l else 0 end as ratio_of_numbers_of_domain_name,
    case when uc > 0 then ul / uc else 0 end as ratio_of_unique_letters_to_num_of_unique_characters,
    case when uc > 0 then ud / uc else 0 end as ratio_of_unique_numbers_to_num_of_unique_characters,
    case when l > 0 then h else 0 end as entropy, nv / (nl - nv + 1e-6) as vowel_consonant_ratio,
    nw / 7.0 as dict_ratio from raw)"""


EDITED = """
edited as (
  select distinct domain, substr(domain, 1, i - 1) || substr(domain, i + 1) as query, 'omission' as class
  from domains, unnest(range(1, length(domain) + 1)) t(i)
  union
  select distinct domain, substr(domain, 1, i) || substr(domain, i), 'addition'
  from domains, unnest(range(1, length(domain) + 1)) t(i)),
names as (select domain as qname from domains union select query from edited),
protected as (
  select domain, row_number() over (order by sum(n) desc, domain) - 1 as position
  from (select host as domain, 1 as n from hosts
    union all select substr(md5('a' || c_custkey), 1, c_custkey % 7 + 5) || '.' || lower(c_mktsegment) || '.com', 0 from customer
    union all select substr(md5('b' || c_custkey), 1, c_custkey % 11 + 5) || '.example.org', 0 from customer)
  group by domain),
labelled as (
  select domain as target_domain, query as query_domain, class as classification from edited
  union all select domain, domain, 'original' from domains
  union all select domain, reverse(domain), 'none' from domains)
"""


def _grams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i, 3)))"


def _pair_values(t: str, q: str) -> dict[str, str]:
    shared = f"len(list_intersect({_grams(t)}, {_grams(q)}))"
    union = f"(len({_grams(t)}) + len({_grams(q)}) - {shared})"
    return {
        "levenshtein": f"levenshtein({t}, {q})",
        "normalized_levenshtein": f"levenshtein({t}, {q}) / greatest(length({t}), length({q}))",
        "jaccard_similarity": f"case when {union} = 0 then 0 else {shared} / {union} end",
        "jaro_similarity": f"jaro_similarity({t}, {q})",
        "length_diff": f"length({t}) - length({q})",
        "prefix_match": f"cast(left({t}, 3) = left({q}, 3) as int)",
        "suffix_match": f"cast(right({t}, 3) = right({q}, 3) as int)",
        "digit_ratio": f"length(regexp_replace({q}, '[^0-9]', '', 'g')) / length({q})",
        "hyphen_count": f"length({q}) - length(replace({q}, '-', ''))",
        "dot_count": f"length({q}) - length(replace({q}, '.', ''))",
        "tld_match": f"cast(split_part({t}, '.', -1) = split_part({q}, '.', -1) as int)",
    }


_PAIR = _pair_values("target_domain", "query_domain")
_DOUBLES = {"normalized_levenshtein", "jaccard_similarity", "jaro_similarity", "digit_ratio"}


def _r(x: str, places: int = 9) -> str:
    return f"round({x}, {places}) + 0.0"


PAIR_SQL = f"with {HOSTS}, {EDITED} select target_domain, query_domain, classification, " + ", ".join(
    f"{_r(v) if k in _DOUBLES else v} as {k}" for k, v in _PAIR.items()) + " from labelled"

_BINARY = {k: _PAIR[k] for k in ("levenshtein", "prefix_match", "suffix_match", "digit_ratio", "hyphen_count")}
BINARY_SQL = f"with {HOSTS}, {EDITED} select target_domain, query_domain, classification, " \
    "abs(length(target_domain) - length(query_domain)) as length_diff, " + ", ".join(
        f"{_r(v) if k in _DOUBLES else v} as {k}" for k, v in _BINARY.items()) + " from labelled"

# Similarity ratio by the longest common subsequence, over bit sets held in HUGEINT.
CANDIDATES_SQL = f"""
with {HOSTS}, {EDITED},
masks as (
  select domain, position, length(domain) as lt, (cast(1 as hugeint) << length(domain)) - 1 as ones,
    map_from_entries(list_transform(list_distinct(string_split(domain, '')), lambda c: (c,
      list_sum(list_transform(range(0, length(domain)), lambda i:
        case when substr(domain, i + 1, 1) = c then cast(1 as hugeint) << i else cast(0 as hugeint) end))::hugeint))) as bits
  from protected),
steps as (
  select n.qname, m.position, list_reduce(
    list_transform(string_split(n.qname, ''), lambda c: coalesce(m.bits[c], cast(0 as hugeint))),
    lambda v, b: ((v + (v & b)) | (v - (v & b))) & m.ones, m.ones) as v, lt
  from names n, masks m),
ratios as (select qname, position, 2 * (lt - bit_count(v)) / (lt + length(qname)) as ratio from steps)
select qname, domain as target, position, {_r('ratio')} as ratio, rn as cand_no
from (select *, row_number() over (partition by qname order by ratio desc, position) as rn from ratios
  qualify rn <= 50) join protected using (position)
"""

_PV = _pair_values("domain", "qname")
BEST = f"""
name_grams as materialized (select qname, {_grams('qname')} as g from names),
list_grams as materialized (select domain, position, {_grams('domain')} as g from protected),
near as (
  select qname, domain, position, length(domain) - length(qname) as diff,
    0.5 * ({_PV['jaro_similarity']}) + 0.2 * coalesce(shared / nullif(ng + lg - shared, 0), 0)
      + 0.3 * (1 - {_PV['normalized_levenshtein']}) as near
  from (select n.qname, p.domain, p.position, len(n.g) as ng, len(p.g) as lg, len(list_intersect(p.g, n.g)) as shared
    from name_grams n, list_grams p)),
scored as (
  select qname, domain, position, unnest([
    {{'i': 0, 'class': 'addition', 'score': case when diff < 0 then near else 0 end}},
    {{'i': 1, 'class': 'omission', 'score': case when diff > 0 then near else 0 end}},
    {{'i': 2, 'class': 'replacement', 'score': case when diff = 0 and domain <> qname then near else 0 end}},
    {{'i': 3, 'class': 'transposition', 'score': case when diff = 0 and domain <> qname then near * 0.9 else 0 end}}]) as s
  from near),
best as (
  select qname, case when s.score > 0 then domain end as target,
    case when s.score > 0 then s.class end as predicted_class, s.score as score
  from (select *, row_number() over (partition by qname order by round(s.score, 12) desc, position, s.i) as rn from scored)
  where rn = 1)
"""


def _flows(idle_s: float, dns_s: float, max_s: float, teardown: bool, packets: str = "") -> str:
    """Packets walked in order per key, one packet after the other."""
    return f"""{HOSTS},
pk as (
  select event_id as pkt_no, ts_us, event_type, event_type in ('view', 'click', 'signup') as to_srv, u, cli, host, event_id as e,
    case u % 4 when 0 then 53 when 1 then 80 when 2 then 443 else 8080 end as sport, 40000 + u % 1000 as cport,
    case u % 4 when 0 then 'DNS' when 1 then 'HTTP' when 2 then 'HTTPS' else 'Others' end as protocol,
    case when u % 4 = 0 then 'UDP' else 'TCP' end as transport,
    60 + cast(floor(value) as bigint) as len, cast(json_extract(props, '$.k') as bigint) as k,
    case when u % 4 = 0 then 0 when event_type = 'signup' then 2 when event_type = 'view' then 24
      when event_type = 'click' then 16 when event_type = 'purchase' then 17 else 4 end as flags,
    case when u % 4 = 0 then u % 64 end as txid
  from ev),
pk1 as (
  select *, case when to_srv then cli else '192.0.2.53' end as src_ip, case when to_srv then '192.0.2.53' else cli end as dst_ip,
    case when to_srv then cport else sport end as src_port, case when to_srv then sport else cport end as dst_port,
    case when protocol = 'DNS' then 'id' || txid
      else protocol || cli || '/' || cport || '/' || sport end as flow_key
    {packets}
  from pk),
num as (select *, row_number() over (partition by flow_key order by ts_us, pkt_no) as rn from pk1),
step as (
  select flow_key, rn, pkt_no, ts_us, protocol <> 'DNS' and flags & 1 <> 0 and {teardown} as fin,
    protocol <> 'DNS' and flags & 4 <> 0 and {teardown} as rst,
    case when protocol = 'DNS' then {int(dns_s * 1e6)} else {int(idle_s * 1e6)} end as idle from num),
walk as (
  select flow_key, rn, pkt_no, pkt_no as flow_uid, ts_us as start_us, ts_us as last_us, cast(fin as int) as fins, rst
  from step where rn = 1
  union all
  select flow_key, rn, pkt_no, case when fresh then pkt_no else flow_uid end, case when fresh then ts_us else start_us end,
    ts_us, case when fresh then 0 else fins end + cast(fin as int), rst
  from (
    select s.*, w.flow_uid, w.start_us, w.fins,
      s.ts_us - w.last_us > s.idle or s.ts_us - w.start_us > {int(max_s * 1e6)} or w.fins >= 2 or w.rst as fresh
    from walk w join step s on s.flow_key = w.flow_key and s.rn = w.rn + 1)),
a as (
  select p.*, w.flow_uid, o.src_ip as o_src, o.dst_ip as o_dst, o.src_port as o_sport, o.dst_port as o_dport,
    o.ts_us as o_ts, o.txid as o_txid, p.dst_ip = o.dst_ip as is_recv, p.src_ip = o.dst_ip as is_send
  from num p join walk w on w.pkt_no = p.pkt_no join num o on o.pkt_no = w.flow_uid)
"""


FULL = _flows(86400, 86400, 5 * 86400, True)
CHUNKED = FULL.replace("case when protocol = 'DNS' then 'id' || txid", "(e % 5) || '|' || case when protocol = 'DNS' then 'id' || txid")
FLOW_ROWS = " select flow_uid, count(*) as packets, min(ts_us) as start_us, max(ts_us) as end_us from a group by flow_uid"


def _stats_sql(head: str, long_parts: list[str], measures: dict[str, tuple[str, float]], empty: float = 0.0,
               places: int = 4, special: dict[str, int] | None = None, every: str = "select distinct flow_uid from a",
               extra: str = "", extra_join: str = "") -> str:
    """All nine statistics per measure; `measures`: name pattern with %s for the statistic -> (tag, scale)."""
    special = special or {}
    cols = []
    for pattern, (tag, scale) in measures.items():
        for s in STATS:
            expr = {
                "min": f"mn / {scale}", "max": f"mx / {scale}", "mean": f"mu / {scale}", "mode": f"mo / {scale}",
                "variance": f"vr / {scale * scale}", "standard_deviation": f"sd / {scale}", "median": f"md / {scale}",
                "skewness": "sk", "coefficient_of_variation": "sd / nullif(mu, 0)"}[s]
            p = special.get(s, places)
            cols.append(
                f"case when max(case when m = '{tag}' then n end) is null then {empty} "
                f"else {_r(f'max(case when m = {chr(39)}{tag}{chr(39)} then {expr} end)', p)} end as {pattern % s}")
    return f"""with recursive {head},
long as ({' union all '.join(long_parts)}),
mom as (select flow_uid, m, count(*) as n, min(x) as mn, max(x) as mx, avg(x) as mu, var_pop(x) as vr, stddev_pop(x) as sd,
  median(x) as md from long group by flow_uid, m),
mos as (select flow_uid, m, x as mo from (
  select flow_uid, m, x, row_number() over (partition by flow_uid, m order by count(*) desc, x) as r
  from long group by flow_uid, m, x) where r = 1),
sks as (select l.flow_uid, l.m, avg(power(l.x - mom.mu, 3)) / nullif(power(any_value(mom.sd), 3), 0) as sk
  from long l join mom on mom.flow_uid = l.flow_uid and mom.m = l.m group by l.flow_uid, l.m),
allm as (select * from mom join mos using (flow_uid, m) join sks using (flow_uid, m)),
every as ({every})
select every.flow_uid{extra}, {', '.join(cols)}
from every left join allm on allm.flow_uid = every.flow_uid {extra_join} group by every.flow_uid{extra}"""


LEN_SQL = _stats_sql(
    FULL,
    ["select flow_uid, 'all' as m, len as x from a", "select flow_uid, 'recv', len from a where is_recv",
     "select flow_uid, 'send', len from a where is_send"],
    {"%s_packets_len": ("all", 1), "%s_receiving_packets_len": ("recv", 1), "%s_sending_packets_len": ("send", 1)})


def _lagged(what: str) -> list[str]:
    return [f"select flow_uid, '{side}' as m, x from (select flow_uid, {what} - lag({what}) over "
            f"(partition by flow_uid order by ts_us, pkt_no) as x from a where is_{side}) where x is not null"
            for side in ("recv", "send")]


DELTA_LEN_SQL = _stats_sql(FULL, _lagged("len"), {
    "%s_receiving_packets_delta_len": ("recv", 1), "%s_sending_packets_delta_len": ("send", 1)})
DELTA_TIME_SQL = _stats_sql(FULL, _lagged("ts_us"), {
    "%s_receiving_packets_delta_time": ("recv", 1000000), "%s_sending_packets_delta_time": ("send", 1000000)},
    places=7, special={"mean": 9, "variance": 0, "standard_deviation": 4, "skewness": 6, "coefficient_of_variation": 6},
).replace("select every.flow_uid, ", """select every.flow_uid,
  case when max(case when m = 'recv' then n end) is null then 0
    else round(max(case when m = 'recv' then sk end), 6) + 0.0 end as skewness_sreceiving_packets_delta_time, """)

DNS_LONG = """
ans as (
  select flow_uid, pkt_no, ts_us, k + i as ttl, [1, 2, 5][i + 1] as rr, i
  from a, unnest(range(0, 1 + e % 3)) t(i) where protocol = 'DNS' and not to_srv)
"""
TTL_SQL = _stats_sql(
    FULL + "," + DNS_LONG, ["select flow_uid, 'ttl' as m, ttl as x from ans"], {"ttl_values_%s": ("ttl", 1)}, empty=-1.0,
    every="select distinct flow_uid from a where protocol = 'DNS'",
    extra=", coalesce(d.distinct_ttl_values, 0)",
    extra_join="left join (select flow_uid, count(distinct ttl) as distinct_ttl_values from ans group by flow_uid) d "
               "on d.flow_uid = every.flow_uid",
).replace("select every.flow_uid, coalesce(d.distinct_ttl_values, 0),",
          "select every.flow_uid, coalesce(d.distinct_ttl_values, 0) as distinct_ttl_values,")


def _rate(top: str, n: str, dur: str) -> str:
    return f"case when {n} <= 1 then 0 when {dur} <= 0 then -1 else {_r(f'{top} / {dur}', 6)} end"


COUNTS_SQL = f"""with recursive {FULL},
g as (select flow_uid, count(*) as n, count(*) filter (where is_recv) as nr, count(*) filter (where is_send) as ns,
  cast(sum(len) as bigint) as b, cast(coalesce(sum(len) filter (where is_recv), 0) as bigint) as br,
  cast(coalesce(sum(len) filter (where is_send), 0) as bigint) as bs,
  (max(ts_us) - min(ts_us)) / 1000000 as d,
  (max(ts_us) filter (where is_recv) - min(ts_us) filter (where is_recv)) / 1000000 as dr,
  (max(ts_us) filter (where is_send) - min(ts_us) filter (where is_send)) / 1000000 as ds
  from a group by flow_uid)
select flow_uid, {_r('d', 6)} as duration, n as packets_numbers, nr as receiving_packets_numbers,
  ns as sending_packets_numbers, b as total_bytes, br as receiving_bytes, bs as sending_bytes,
  {_rate('n', 'n', 'd')} as packets_rate, {_rate('nr', 'nr', 'dr')} as receiving_packets_rate,
  {_rate('ns', 'ns', 'ds')} as sending_packets_rate,
  case when d <= 0 then -1 else {_r('b / d', 6)} end as packets_len_rate,
  {_rate('br', 'nr', 'dr')} as receiving_packets_len_rate, {_rate('bs', 'ns', 'ds')} as sending_packets_len_rate
from g"""

# Handshake flags and sequence numbers replace those of the packets; a second walk runs the states.
SHAKE = _flows(86400, 86400, 5 * 86400, True).replace(
    "case when u % 4 = 0 then 0 when event_type = 'signup' then 2 when event_type = 'view' then 24\n"
    "      when event_type = 'click' then 16 when event_type = 'purchase' then 17 else 4 end as flags",
    "case when u % 4 = 0 then 0 when event_type = 'signup' then 2 when event_type = 'click' then 18 else 16 end as flags,\n"
    "    event_id % 2 as seq, (event_id // 2) % 2 + 1 as ack")
SHAKE_SQL = f"""with recursive {SHAKE},
o as (select flow_uid, ts_us, flags, seq, ack, transport,
  row_number() over (partition by flow_uid order by ts_us, pkt_no) as i from a),
s as (
  select flow_uid, i, 0 as st, cast(0 as bigint) as sq, cast(0 as bigint) as ak, cast(null as bigint) as t1,
    cast(null as bigint) as t3, cast(null as bigint) as other, false as done, cast(0 as bigint) as nx
  from (select flow_uid, cast(0 as bigint) as i from o group by flow_uid)
  union all
  select s.flow_uid, o.i,
    case when s.st = 0 and o.flags & 2 <> 0 then 1 when s.st = 1 and o.flags & 18 = 18 and s.sq = o.ack - 1 then 2
      when s.st = 2 and o.flags & 16 <> 0 and s.sq = o.ack - 1 and s.ak = o.seq then 3 else s.st end,
    case when s.st = 0 and o.flags & 2 <> 0 or s.st = 1 and o.flags & 18 = 18 and s.sq = o.ack - 1 then o.seq else s.sq end,
    case when s.st = 1 and o.flags & 18 = 18 and s.sq = o.ack - 1 then o.ack else s.ak end,
    case when s.st = 0 and o.flags & 2 <> 0 then o.ts_us else s.t1 end,
    case when s.st = 2 and o.flags & 16 <> 0 and s.sq = o.ack - 1 and s.ak = o.seq then o.ts_us else s.t3 end,
    coalesce(s.other, case when not (s.st = 0 and o.flags & 2 <> 0 or s.st = 1 and o.flags & 18 = 18 and s.sq = o.ack - 1
      or s.st = 2 and o.flags & 16 <> 0 and s.sq = o.ack - 1 and s.ak = o.seq) then o.ts_us end),
    s.done or s.st = 3, o.i
  from s join o on o.flow_uid = s.flow_uid and o.i = s.i + 1),
fin as (select s.* from s join (select flow_uid, max(i) as i from o group by flow_uid) l on l.flow_uid = s.flow_uid and l.i = s.i)
select fin.flow_uid, case when done and o.transport = 'TCP' then {_r('(t3 - t1) / 1000000', 6)} end as handshake_duration,
  case when done and o.transport = 'TCP' then {_r('(other - t3) / 1000000', 6)} end as delta_start,
  case when o.transport <> 'TCP' then 'not a tcp connection' when done then 'complete'
    else 'not a complete handshake' end as handshake_status
from fin join o on o.flow_uid = fin.flow_uid and o.i = 1"""

RECORDS_SQL = f"""with recursive {FULL}, {DNS_LONG},
d as (select * from a where protocol = 'DNS'),
t as (select flow_uid, count(*) filter (where rr = 1) as n1, count(*) filter (where rr = 2) as n2 from ans group by flow_uid)
select d.flow_uid, arg_min(host, struct_pack(t := ts_us, p := pkt_no)) || '.' as dns_domain_name,
  coalesce(any_value(n1), 0) as "distinct_A_records", coalesce(any_value(n2), 0) as "distinct_NS_records",
  {_r('avg(e % 2)')} as average_authority_resource_records, {_r('avg(e % 4)')} as average_additional_resource_records,
  {_r('avg(e % 4)')} as average_answer_resource_records,
  {_r('avg(case when to_srv then 0 else 1 + e % 3 end)')} as average_answer_count
from d left join t on t.flow_uid = d.flow_uid group by d.flow_uid"""

LISTS_SQL = f"""with recursive {FULL}, {DNS_LONG},
extra as (select flow_uid, ts_us, pkt_no from a, unnest(range(0, e % 4)) t(i) where protocol = 'DNS'),
x as (select flow_uid, string_agg('41', ',') as qt, string_agg('1', ',') as qc from extra group by flow_uid),
y as (select flow_uid, string_agg(cast(rr as varchar), ',' order by ts_us, pkt_no, i) as ans_t, string_agg('1', ',') as ac
      from ans group by flow_uid)
select f.flow_uid, coalesce(qt, '') as query_resource_record_type, coalesce(ans_t, '') as ans_resource_record_type,
  coalesce(qc, '') as query_resource_record_class, coalesce(ac, '') as ans_resource_record_class
from (select distinct flow_uid from a where protocol = 'DNS') f left join x using (flow_uid) left join y using (flow_uid)"""

CHUNK_LISTS_SQL = f"""with recursive {FULL},
d as (select flow_uid, pkt_no, ts_us, e, to_srv, ts_us // {DAY} as slot,
    e % 4 + case when to_srv then 0 else 1 + e % 3 end as records from a where protocol = 'DNS'),
p as (select *, coalesce(sum(records) over (partition by flow_uid, slot order by ts_us, pkt_no
    rows between unbounded preceding and 1 preceding), 0) // 2 as part from d),
c as (select *, dense_rank() over (partition by flow_uid order by slot, part) - 1 as chunk from p),
x as (select flow_uid, chunk, string_agg('41', ',') as qt, string_agg('1', ',') as qc from c, unnest(range(0, e % 4)) t(i)
    group by flow_uid, chunk),
y as (select flow_uid, chunk, string_agg(cast([1, 2, 5][i + 1] as varchar), ',' order by ts_us, pkt_no, i) as ans_t,
    string_agg('1', ',') as ac from c, unnest(range(0, 1 + e % 3)) t(i) where not to_srv group by flow_uid, chunk)
select f.flow_uid, f.chunk, coalesce(qt, '') as query_resource_record_type, coalesce(ans_t, '') as ans_resource_record_type,
  coalesce(qc, '') as query_resource_record_class, coalesce(ac, '') as ans_resource_record_class
from (select distinct flow_uid, chunk from c) f left join x using (flow_uid, chunk) left join y using (flow_uid, chunk)"""

WHOIS_SQL = f"""with {HOSTS},
ranked as (select domain, row_number() over (order by md5('7|' || domain), domain) - 1 as r from domains),
w as (select r.domain, r, s_name, n_name, r_name, cast(o_orderdate as date) as day, c_name, c_mktsegment from ranked r
  join supplier on s_suppkey = r.r % (select count(*) from supplier) join nation on n_nationkey = r.r % 25
  join region on r_regionkey = n_regionkey join orders on o_orderkey = r.r join customer on c_custkey = r.r where r.r % 5 <> 4)
select d.domain || '.' as dns_domain_name, w.domain as dns_whois_domain_name,
  case when r % 7 <> 3 then 'admin@' || w.domain end as dns_domain_email, s_name as dns_domain_registrar,
  strftime(day, '%Y-%m-%d') as dns_domain_creation_date,
  strftime(day + cast(365 + r % 3 * 365 as int), '%Y-%m-%d') as dns_domain_expiration_date, n_name as dns_domain_country,
  case r % 3 when 0 then 'signedDelegation' when 1 then 'unsigned' end as dns_domain_dnssec, c_name as dns_domain_organization,
  r || ' ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Road' as dns_domain_address,
  array_to_string(list_transform(string_split(r_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') as dns_domain_city,
  left(c_mktsegment, 2) as dns_domain_state, lpad(cast(r * 37 % 100000 as varchar), 5, '0') as dns_domain_zipcode,
  coalesce(array_to_string(list_transform(range(1, r % 3 + 2), lambda i: 'ns' || i || '.' || w.domain), ','), '') as dns_domain_name_servers,
  strftime(day + cast(r % 200 as int), '%Y-%m-%d') as dns_domain_updated_date,
  date_diff('day', day, date '2024-06-30') as dns_domain_age
from domains d left join w on w.domain = d.domain"""

ALERTS = """
al as (
  select event_id as alert_no, case when event_id % 3 <> 0 then 'DNS_TUNNELING' else 'DGA' end as detector,
    rtrim(lower(upper(host) || '.'), '.') as domain, ts_us,
    case when event_id % 7 = 0 then ts_us + 3600000000 when event_id % 5 = 0 then ts_us // 1000000 * 1000000
      when event_id % 13 = 0 then null else ts_us end as logged_us,
    event_id % 7 <> 0 and event_id % 5 <> 0 and event_id % 13 = 0 as bad,
    ts_us + event_id % 50 * 1000000 as row_us,
    case when event_id % 11 <> 0 then ts_us + event_id % 600 * 1000000 end as det_us
  from ev where event_type = 'error')
"""
SEEN = """
seen as (select qname as domain, min(logged_us) as seen_us from q where logged_us is not null group by qname),
det as (select domain, min(det_us) as det_us from al where detector = 'DNS_TUNNELING' and det_us is not null group by domain),
delays as (select domain, seen_us, det_us, (det_us - seen_us) / 1000000 as delay from seen join det using (domain)
  where det_us >= seen_us)
"""


def _iso(us: str) -> str:
    return f"strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S.%f')"


def _gap(a: str, b: str) -> str:
    return f"case when {b} >= {a} then {_r(f'({b} - {a}) / 1000000', 6)} end"


ALERT_DELAYS_SQL = f"""with {HOSTS}, {ALERTS}
select alert_no, case when bad then 'yesterday' else {_iso('logged_us')} end as unbound_logged_at,
  {_iso('row_us')} as flow_row_seen_at, {_iso('det_us')} as detected_at,
  {_gap('logged_us', 'det_us')} as detection_delay_seconds, {_gap('logged_us', 'row_us')} as source_to_row_seen_seconds,
  {_gap('row_us', 'det_us')} as row_seen_to_detected_seconds, {_gap('logged_us', 'det_us')} as source_to_detected_seconds
from al"""

_PICKS = ", ".join(
    f"{_r(f'max(case when rn - 1 = cast(floor((n - 1) * {p}) as bigint) then delay end)', 6)} as \"{k}\""
    for k, p in {"min": 0.0, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99, "max": 1.0}.items())
DELAY_SUMMARY_SQL = f"""with {LINES}, {ALERTS}, {SEEN},
o as (select delay, row_number() over (order by delay) as rn, count(*) over () as n from delays)
select max(n) as domains_with_valid_delay, {_PICKS} from o"""

DGA_ALERTS_SQL = f"""with {LINES}, {_dga('qname')},
sc as (select qname, round(least(1.0, greatest(0.0, domain_length * 0.03 + entropy * 0.15
  + ratio_of_numbers_of_domain_name * 0.5 - dict_ratio * 0.2)), 9) as s from feats)
select 'DGA' as detector, q.qname as domain, round(s, 4) as score, {_r('1 - s')} as legit,
  {_iso('logged_us')} as unbound_logged_at, {_iso('logged_us + 3000000')} as detected_at, cast(3 as double) as delay
from q join sc on sc.qname = q.qname where s >= 0.5"""

TYPO_ALERTS_SQL = f"""with {LINES}, {EDITED.replace("names as (select domain as qname from domains union select query from edited)", "names as (select distinct qname from q)")}, {BEST}
select 'TYPOSQUATTING' as detector, q.qname as domain, round(round(score, 9), 4) as score, target, predicted_class,
  {_iso('logged_us')} as unbound_logged_at, {_iso('logged_us + 2000000')} as detected_at, cast(2 as double) as delay
from q join best on best.qname = q.qname where round(score, 9) >= 0.8 and target is not null"""

TUNNEL_ALERTS_SQL = f"""with recursive {FULL}, {DNS_LONG},
f as (select flow_uid, any_value(o_src) as src_ip, any_value(o_dst) as dst_ip, any_value(o_ts) as o_ts, count(*) as n,
  sum(len) as b, any_value(protocol) as protocol, arg_min(host, struct_pack(t := ts_us, p := pkt_no)) || '.' as name
  from a group by flow_uid),
t as (select flow_uid, max(ttl) as mx from ans group by flow_uid),
s as (select f.*, round(cast(least(1.0, n * 0.05 + b * 0.0001 + case when protocol = 'DNS' and mx is not null then 0.1 else -0.1 end) as double), 9) as s
  from f left join t using (flow_uid))
select 'DNS_TUNNELING' as detector, flow_uid as row_index, round(s, 4) as score, src_ip, dst_ip,
  case when protocol = 'DNS' then name else '' end as dns_domain_name, {_iso('o_ts')} as unbound_logged_at,
  cast(0.9 as double) as delay, cast(0.4 as double) as row_to_detected, 'not_in_table' as missing
from s where s >= 0.5"""


def _values(entries: dict[str, list[str]]) -> str:
    return ", ".join(f"('{k}', '{s}')" for k, v in entries.items() for s in v)


VARIANTS = f"""
keys(c, s) as (values {_values(key_neighbours())}),
looks(c, s) as (values {_values(LOOKALIKES)}),
parts as (
  select domain, string_split(domain, '.') as ls,
    case when len(string_split(domain, '.')) > 1 then string_split(domain, '.')[-2] else domain end as x from domains),
bits as (
  select domain, x, case when len(ls) > 2 then array_to_string(ls[:-3], '.') || '.' else '' end as hd,
    case when len(ls) > 1 then '.' || ls[-1] else '' end as tl from parts),
pos as (select *, i, substr(x, i, 1) as c, substr(x, 1, i - 1) as l, substr(x, i + 1) as r
  from bits, unnest(range(1, length(x) + 1)) t(i)),
made as (
  select domain, hd || x || z || tl as q, 0 as k, 'addition' as c
  from bits, unnest(string_split('0123456789abcdefghijklmnopqrstuvwxyz', '')) t(z)
  union all select domain, hd || l || r || tl, 1, 'omission' from pos where length(x) > 1
  union all select domain, hd || l || keys.s || r || tl, 2, 'replacement' from pos join keys on keys.c = pos.c
  union all select domain, hd || l || substr(r, 1, 1) || pos.c || substr(r, 2) || tl, 3, 'transposition' from pos where r <> ''
  union all select domain, hd || l || pos.c || '.' || r || tl, 4, 'subdomain' from pos
    where r <> '' and pos.c <> '-' and substr(r, 1, 1) <> '-'
  union all select domain, hd || l || looks.s || r || tl, 5, 'homoglyph' from pos join looks on looks.c = pos.c),
variants as (select domain as target_domain, q as query_domain, arg_min(c, k) as classification
  from made where q <> domain group by domain, q)
"""


def _stride(modulus: str, seed: int = 42) -> str:
    """The first step from a seeded start on that has no common divisor with the modulus."""
    return (f"(select case when {modulus} <= 2 then 1 else (select min(s) from unnest(range("
            f"1 + ({seed} * 7919 + {modulus} * 2 // 3) % ({modulus} - 1), "
            f"1 + ({seed} * 7919 + {modulus} * 2 // 3) % ({modulus} - 1) + 1000)) t(s) where gcd(s, {modulus}) = 1) end)")


NEG_PAIRS_SQL = f"""with {HOSTS},
num as (select domain, row_number() over (order by md5('42|' || domain), domain) - 1 as idx from domains),
m as (select count(*) as m, count(*) * (count(*) - 1) // 2 as total from num),
st as (select m, total, {_stride('total')} as step from m),
draws as (select (cast(k as hugeint) * step + 42) % total as r, m from st, unnest(range(0, 300)) t(k)),
ij as (select cast(r % m as bigint) as i, cast((r % m + r // m + 1) % m as bigint) as j from draws)
select a.domain as target_domain, b.domain as query_domain, 'none' as classification
from ij join num a on a.idx = i join num b on b.idx = j"""

NEG_SAMPLE_SQL = f"""with {HOSTS}, {EDITED}, {VARIANTS},
listed as (select domain from domains union select query from edited where class = 'omission'),
num as (select domain, row_number() over (order by md5('42|' || domain), domain) - 1 as idx from listed),
m as (select count(*) as m, count(*) - 1 as m1 from num),
st as (select m, m1, {_stride('m1')} as step from m),
walk as (
  select d.domain as target_domain, k, o.domain as query_domain
  from domains d join num n on n.domain = d.domain, st, unnest(range(0, m1)) t(k), num o
  where o.idx = (n.idx + 1 + (k * step + n.idx) % m1) % m),
ok as (select w.* from walk w anti join variants v on v.target_domain = w.target_domain and v.query_domain = w.query_domain)
select target_domain, query_domain, 'none' as classification
from (select *, row_number() over (partition by target_domain order by k) as rn from ok) where rn <= 40"""

X5 = """
x5 as (select d.doc_id, quality as y, cast(least(n_chars, 5000) as double) / 5000 as score,
  cast(cast(least(n_chars, 5000) as double) / 5000 >= 0.2 as int) as p from documents d join labels l on l.doc_id = d.doc_id)
"""


def _metrics(rel: str, by: str, truth: str = "y", guess: str = "p") -> str:
    g = f"{by}, " if by else ""
    group = f" group by {by}" if by else ""
    return f"""(select {g}count(*) filter (where {truth} = {guess}) / count(*) as accuracy,
  coalesce(count(*) filter (where {truth} = 1 and {guess} = 1) / nullif(count(*) filter (where {guess} = 1), 0), 0) as "precision",
  coalesce(count(*) filter (where {truth} = 1 and {guess} = 1) / nullif(count(*) filter (where {truth} = 1), 0), 0) as recall,
  coalesce(2 * count(*) filter (where {truth} = 1 and {guess} = 1) /
    nullif(count(*) filter (where {guess} = 1) + count(*) filter (where {truth} = 1), 0), 0) as f1 from {rel}{group})"""


REPORT_SQL = f"""with {X5},
c as (select y as label, count(*) as support, count(*) filter (where y = p) as hit from x5 group by y),
g as (select p as label, count(*) as guessed from x5 group by p),
per as (select cast(coalesce(c.label, g.label) as varchar) as label, coalesce(hit, 0) / nullif(guessed, 0) as pr,
  coalesce(hit, 0) / nullif(support, 0) as re, coalesce(support, 0) as support, coalesce(hit, 0) as hit
  from c full join g on g.label = c.label),
per2 as (select label, coalesce(pr, 0) as pr, coalesce(re, 0) as re,
  coalesce(2 * coalesce(pr, 0) * coalesce(re, 0) / nullif(coalesce(pr, 0) + coalesce(re, 0), 0), 0) as f, support, hit from per)
select label, {_r('pr')} as "precision", {_r('re')} as recall, {_r('f')} as f1, support from per2
union all select 'accuracy', {_r('sum(hit) / sum(support)')}, {_r('sum(hit) / sum(support)')}, {_r('sum(hit) / sum(support)')},
  cast(sum(support) as bigint) from per2
union all select 'macro avg', {_r('avg(pr)')}, {_r('avg(re)')}, {_r('avg(f)')}, cast(sum(support) as bigint) from per2
union all select 'weighted avg', {_r('sum(pr * support) / sum(support)')}, {_r('sum(re * support) / sum(support)')},
  {_r('sum(f * support) / sum(support)')}, cast(sum(support) as bigint) from per2"""

AUC_SQL = f"""with {X5},
r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from x5)
select {_r('(sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))')} as roc_auc from r"""

_SHORT = {"accuracy": "acc", "precision": "precision", "recall": "recall", "f1": "f1"}
OVERFIT_SQL = f"""with {X5},
models(model, t) as (values ('low', 0.1), ('mid', 0.3), ('high', 0.6)),
rk as (select *, row_number() over (partition by y order by md5('42|' || doc_id), doc_id) - 1 as rn,
  count(*) over (partition by y) as cnt from x5),
rows2 as (select rk.*, model, cast(score >= t as int) as guess, rn < round(cnt * 0.2) as is_test, rn % 5 as fold from rk, models),
tr as {_metrics('rows2 where not is_test', 'model', guess='guess')},
te as {_metrics('rows2 where is_test', 'model', guess='guess')},
fo as {_metrics('rows2', 'model, fold', guess='guess')},
cv as (select model, {', '.join(f'avg("{m}") as cv_{s}_mean, stddev_pop("{m}") as cv_{s}_std' for m, s in _SHORT.items())}
  from fo group by model)
select tr.model, {', '.join(f'{_r(f"{t}.{chr(34)}{m}{chr(34)}")} as {n}_{s}' for m, s in _SHORT.items() for t, n in (('tr', 'train'), ('te', 'test')))},
  {_r('tr.f1 - te.f1')} as f1_gap_train_minus_test,
  {', '.join(f'{_r(f"cv_{s}_{k}")} as cv_{s}_{k}' for s in _SHORT.values() for k in ('mean', 'std'))}
from tr join te on te.model = tr.model join cv on cv.model = tr.model"""

_N = "domain || '.'"
_KIND = "case when contains('aeiou', {0}) and {0} <> '' then 1 when contains('bcdfghjklmnpqrstvwxyz', {0}) and {0} <> '' then -1 else 0 end"


def _k(i: str) -> str:
    return _KIND.format(f"substr(n, {i}, 1)")


_DIRECT = f"({_k('i')}) * ({_k('i + 1')}) = -1"
_OVER = f"substr(n, i + 1, 1) = '.' and i - 1 < length(n) - 3 and ({_k('i')}) * ({_k('i + 2')}) = -1"


def _run(pattern: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all(n, '{pattern}'), lambda s: length(s))), 0)"


LEXICAL_SQL = f"""with {HOSTS},
b as (select {_N} as n, string_split({_N}, '') as cs, list_filter(string_split({_N}, '.'), lambda x: x <> '') as ls from domains),
same as (select n, max(cnt) as run from (
  select n, g, count(*) as cnt from (
    select n, i, substr(n, i, 1) as c, i - row_number() over (partition by n, substr(n, i, 1) order by i) as g
    from b, unnest(range(1, length(n) + 1)) t(i) where regexp_matches(substr(n, i, 1), '[a-zA-Z]'))
  group by n, c, g) group by n),
alt as (select n, list_sum(list_transform(range(1, length(n) - 1), lambda i:
    case when {_DIRECT} then 1 when {_OVER} then 1 else 0 end)) as ch,
  list_sum(list_transform(range(1, length(n) - 1), lambda i: case when {_DIRECT} then 0 when {_OVER} then 1 else 0 end)) as cut from b)
select b.n as dns_domain_name, coalesce(ls[-1], 'not-found') as dns_top_level_domain,
  case when len(ls) >= 2 then ls[-2] || '.' || ls[-1] else 'not-found' end as dns_second_level_domain,
  length(b.n) as dns_domain_name_length,
  case when len(string_split(b.n, '.')) >= 4 then length(string_split(b.n, '.')[1]) end as dns_subdomain_name_length,
  array_to_string(cs, ',') as uni_gram_domain_name,
  array_to_string(list_transform(range(1, length(b.n)), lambda i: substr(b.n, i, 2)), ',') as bi_gram_domain_name,
  array_to_string(list_transform(range(1, length(b.n) - 1), lambda i: substr(b.n, i, 3)), ',') as tri_gram_domain_name,
  {_r("length(regexp_replace(b.n, '[^0-9]', '', 'g')) / length(b.n)")} as numerical_percentage,
  array_to_string(list_sort(list_transform(list_distinct(cs), lambda c: c || ':' || (length(b.n) - length(replace(b.n, c, ''))))), ',')
    as character_distribution,
  {_r("-list_sum(list_transform(list_distinct(cs), lambda c: (length(b.n) - length(replace(b.n, c, ''))) / length(b.n) * log2((length(b.n) - length(replace(b.n, c, ''))) / length(b.n))))")} as character_entropy,
  {_run('[0-9]+').replace('(n,', '(b.n,')} as max_continuous_numeric_len, {_run('[a-zA-Z]+').replace('(n,', '(b.n,')} as max_continuous_alphabet_len,
  {_run('[bcdfghjklmnpqrstvwxyz]+').replace('(n,', '(b.n,')} as max_continuous_consonants_len, coalesce(same.run, 0) as max_continuous_same_alphabet_len,
  {_r("coalesce(length(regexp_replace(b.n, '[^aeiou]', '', 'g')) / nullif(length(regexp_replace(b.n, '[^bcdfghjklmnpqrstvwxyz]', '', 'g')), 0), 0)")} as vowels_consonant_ratio,
  {_r('alt.ch / (length(b.n) - alt.cut)')} as conv_freq_vowels_consonants
from b left join same on same.n = b.n join alt on alt.n = b.n"""

_DGA_COLS = ["domain_length", "domain_num_of_unique_char", "domain_num_of_unique_letters", "domain_num_of_unique_numbers"]
_DGA_DBL = ["ratio_of_letters_of_domain_name", "ratio_of_numbers_of_domain_name",
            "ratio_of_unique_letters_to_num_of_unique_characters", "ratio_of_unique_numbers_to_num_of_unique_characters",
            "entropy", "vowel_consonant_ratio", "dict_ratio"]

_RANKED = "row_number() over (partition by p_type order by md5('42|' || p_partkey), p_partkey) - 1"

# All flows: closed by a later packet of their key, by the watermark or by the end of the input.
STREAM_FLOWS_SQL = f"""with recursive {FULL},
f as (select flow_key, flow_uid, min(ts_us) as start_us, max(ts_us) as end_us, count(*) as packets,
  cast(sum(len) as bigint) as bytes from a group by flow_key, flow_uid),
n as (select *, lead(start_us) over (partition by flow_key order by start_us, flow_uid) as next_us from f)
select flow_uid, start_us, end_us, packets, bytes, case when next_us is null or next_us - end_us > {DAY} then 'idle'
  when next_us - start_us > {5 * DAY} then 'duration' else 'teardown' end as closed_by
from n"""

STREAM_ALERTS_SQL = TYPO_ALERTS_SQL[:TYPO_ALERTS_SQL.index("select 'TYPOSQUATTING'")] + """
select q.qname as domain, round(round(score, 9), 4) as score, target, predicted_class, logged_us
from q join best on best.qname = q.qname where round(score, 9) >= 0.8 and target is not null"""

STREAM_SCORES_SQL = f"""with recursive {FULL},
s as (select flow_uid, round(cast(least(1.0, count(*) * 0.05 + sum(len) * 0.0001) as double), 9) as s from a group by flow_uid)
select flow_uid as row_index, round(s, 4) as score from s where s >= 0.5"""

SESSIONS_SQL = f"""with recursive {_flows(86400, 86400, 1e9, False)}
select case when any_value(protocol) = 'DNS' then 'txid|' || any_value(txid) else any_value(protocol) || '|' || any_value(cli)
    || '|192.0.2.53|' || any_value(sport) || '|' || any_value(cport) end as flow_key,
  min(ts_us) as start_us, max(ts_us) as end_us, count(*) as packets, cast(sum(len) as bigint) as bytes
from a group by flow_uid"""

ORACLE = {
    "stream_log_alerts": STREAM_ALERTS_SQL,
    "stream_flows": STREAM_FLOWS_SQL,
    "stream_flow_scores": STREAM_SCORES_SQL,
    "stream_chunks": f"with recursive {CHUNKED} select 'file' || flow_uid % 5 || ':' || flow_uid // 5 as flow_uid, "
                     "count(*) as packets, cast(sum(len) as bigint) as bytes from a group by flow_uid",
    "packet_files": f"with recursive {FULL} select count(*) as packets, cast(sum(len) as bigint) as bytes, min(ts_us) as start_us, "
                    "max(ts_us) as end_us from a group by flow_uid",
    "idle_sessions": SESSIONS_SQL,
    "log_parse": f"with {LINES} select client, qname, {BASE} as base, logged_us from q",
    "log_totals": f"with {LINES} select count(*) as lines_total, count(*) filter (where client is not null and qname is not null "
                  "and epoch is not null) as queries_with_time from parsed",
    "domain_topn": f"with {LINES} select qname as domain, count(*) as n from parsed where qname is not null "
                   "group by qname order by n desc, domain limit 25",
    "base_domain_counts": f"with {LINES} select {BASE} as domain, count(*) as n from parsed where qname is not null "
                          "group by 1 having count(*) >= 2",
    "domain_first_position": f"with {HOSTS} select host, min(page_id) as page_id from hosts group by host",
    "canonical_names": f"with {HOSTS} select page_id, case when page_id % 3 = 0 then host || '.' when page_id % 7 = 1 then null "
                       "else host || '.' end as name from hosts",
    "dga_features": f"with {LINES}, {_dga('qname')} select qname, {', '.join(_DGA_COLS)}, "
                    + ", ".join(f"{_r(c)} as {c}" for c in _DGA_DBL) + " from feats",
    "domain_lexical": LEXICAL_SQL,
    "pair_features": PAIR_SQL,
    "pair_features_binary": BINARY_SQL,
    "typo_top_candidates": CANDIDATES_SQL,
    "typo_best_match": f"with {HOSTS}, {EDITED}, {BEST} select qname, target, predicted_class, {_r('score')} as score from best",
    "flow_assign_idle": f"with recursive {_flows(86400, 86400, 1e9, False)}" + FLOW_ROWS,
    "flow_assign_default": f"with recursive {_flows(5000, 30, 120000, True)}" + FLOW_ROWS,
    "flow_assign_full": f"with recursive {FULL} select pkt_no, flow_uid from a",
    "flow_orientation": f"with recursive {FULL} select flow_uid, any_value(o_src) as src_ip, any_value(o_sport) as src_port, "
                        "any_value(o_dst) as dst_ip, any_value(o_dport) as dst_port, any_value(o_ts) as start_us, "
                        "any_value(o_txid) as txid, any_value(protocol) as protocol, count(*) as packets_numbers, "
                        "count(*) filter (where is_recv) as receiving_packets_numbers, "
                        "count(*) filter (where is_send) as sending_packets_numbers from a group by flow_uid",
    "flow_counts_rates": COUNTS_SQL,
    "flow_len_stats": LEN_SQL,
    "flow_delta_len_stats": DELTA_LEN_SQL,
    "flow_delta_time_stats": DELTA_TIME_SQL,
    "flow_handshake": SHAKE_SQL,
    "flow_dns_records": RECORDS_SQL,
    "flow_record_lists": LISTS_SQL,
    "flow_record_chunks": CHUNK_LISTS_SQL,
    "flow_ttl_stats": TTL_SQL,
    "tcp_flag_counts": f"with recursive {FULL} select protocol, transport, count(*) as packets, "
                       + ", ".join(f"count(*) filter (where flags & {m} <> 0) as {n}_packets"
                                   for n, m in {"fin": 1, "syn": 2, "rst": 4, "ack": 16}.items())
                       + " from pk group by protocol, transport",
    "protocol_mix": f"with recursive {FULL} select protocol, count(*) as packets, cast(sum(len) as bigint) as bytes from pk group by protocol",
    "whois_enrich": WHOIS_SQL,
    "first_seen_detected": f"with {LINES}, {ALERTS}, {SEEN} select domain, seen_us, det_us as detected_us, {_r('delay', 6)} as delay from delays",
    "stream_delays": f"with {LINES}, {ALERTS}, {SEEN} select domain, seen_us, det_us as detected_us, {_r('delay', 6)} as delay from delays",
    "delay_summary": DELAY_SUMMARY_SQL,
    "slowest_domains": f"with {LINES}, {ALERTS}, {SEEN} select domain, {_r('delay', 6)} as delay from delays "
                       "order by delays.delay desc, domain limit 20",
    "domain_overlap": f"with {LINES}, {ALERTS}, {SEEN} select (select count(*) from seen) as domains_seen, "
                      "(select count(*) from det) as domains_detected, "
                      "(select count(*) from seen join det using (domain)) as domains_overlap",
    "alert_delays": ALERT_DELAYS_SQL,
    "dga_alerts": DGA_ALERTS_SQL,
    "typo_alerts": TYPO_ALERTS_SQL,
    "tunnel_alerts": TUNNEL_ALERTS_SQL,
    "typo_variants": f"with {HOSTS}, {VARIANTS} select * from variants",
    "negative_pairs": NEG_PAIRS_SQL,
    "negative_sample": NEG_SAMPLE_SQL,
    "keep_classes": f"with {HOSTS}, {EDITED} select * from labelled where classification in "
                    "('addition', 'omission', 'replacement', 'transposition', 'none', 'subdomain', 'homoglyph')",
    "class_distribution": f"select p_type, count(*) as distribution, {_r('count(*) * 100.0 / (select count(*) from part)')} as percentage "
                          "from part group by p_type",
    "class_downsample": f"select p_partkey, p_type from (select *, {_RANKED} as rn from part) where p_type <> 'ECONOMY' or rn < 100",
    "stratified_split": f"select p_partkey, p_type, rn < round(c * 0.2) as is_test from (select *, {_RANKED} as rn, "
                        "count(*) over (partition by p_type) as c from part)",
    "kfold_assign": f"select p_partkey, p_type, rn % 5 as fold from (select *, {_RANKED} as rn from part)",
    "shuffle_order": "select p_partkey, row_number() over (order by md5('42|' || p_partkey), p_partkey) - 1 as place from part",
    "class_weights": f"select p_type, n, {_r('sum(n) over () / (count(*) over () * n)')} as weight "
                     "from (select p_type, count(*) as n from part group by p_type)",
    "label_encode": "select p_partkey, p_type, dense_rank() over (order by p_type) - 1 as code from part",
    "standard_scale": "select p_partkey, "
                      + ", ".join(f"{_r(f'({c} - avg({c}) over ()) / stddev_pop({c}) over ()', 6)} as {c}_scaled"
                                  for c in ("p_size", "p_retailprice")) + " from part",
    "stacked_frames": "select p_partkey, p_type, null::int as p_size from part union all select p_partkey, null, p_size from part",
    "confusion_matrix": f"with {X5} select y, p, count(*) as n from x5 group by y, p",
    "classification_report": REPORT_SQL,
    "binary_metrics": f"with {X5} select {_r('accuracy')} as accuracy, {_r(chr(34) + 'precision' + chr(34))} as \"precision\", "
                      f"{_r('recall')} as recall, {_r('f1')} as f1 from {_metrics('x5', '')}",
    "roc_auc": AUC_SQL,
    "overfitting_report": OVERFIT_SQL,
}
