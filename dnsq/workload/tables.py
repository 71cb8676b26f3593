"""The given tables as inputs of the library (mappings X1 to X8 of FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import packets as P
from ..operators.datasets import numbered
from ..operators.flows import FlowLimits
from ..session import cut_lineage

# Limits under which the sparse stand-in packets form flows that exercise every rule.
LIMITS = FlowLimits(activity_timeout=86400, dns_activity_timeout=86400, max_flow_duration=5 * 86400,
                    slot_seconds=86400)
IDLE_ONLY = FlowLimits(activity_timeout=86400, dns_activity_timeout=86400, max_flow_duration=10**9,
                       teardown=False, slot_seconds=86400)
# Records of a row of lists, low for the same reason.
CHUNK_RECORDS = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hosts_by_page(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.lower(F.regexp_extract("url", r"^https?://([^/:?#]+)", 1)).alias("host"))


def domains(spark, sf_dir) -> DataFrame:
    """X2: distinct hosts."""
    return hosts_by_page(spark, sf_dir).select(F.col("host").alias("domain")).distinct()


def _micros(ts: str) -> F.Column:
    """Epoch microseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({ts} AS TIMESTAMP_NTZ))")


def events(spark, sf_dir, hosts: bool = True, source: DataFrame | None = None) -> DataFrame:
    """Events (the table, or a stream of it) with their time and the host of the page they fall on."""
    ev = (table(spark, sf_dir, "events") if source is None else source).select(
        "event_id", "user_id", "event_type", "value", "props", F.timestamp_micros(_micros("ts")).alias("ts"))
    if not hosts:
        return ev.withColumn("host", F.lit(None).cast("string"))
    pages = hosts_by_page(spark, sf_dir)
    return ev.withColumn("page_id", F.col("event_id") % pages.count()).join(pages, "page_id")


def _client() -> F.Column:
    return F.expr("concat('10.0.', user_id div 256, '.', user_id % 256)")


def packets(spark, sf_dir, keep_type: bool = False, sections: bool = True,
            ev: DataFrame | None = None) -> DataFrame:
    """X1 and X1b: one packet per event. Without `sections` the DNS sections are NULL and the join
    of the page hosts is saved."""
    ev = events(spark, sf_dir, hosts=sections) if ev is None else ev
    to_srv = F.col("event_type").isin("view", "click", "signup")
    cport = (40000 + F.col("user_id") % 1000).cast("int")
    kind = F.col("user_id") % 4
    sport = F.when(kind == 0, 53).when(kind == 1, 80).when(kind == 2, 443).otherwise(8080)
    dns = kind == 0
    flags = (F.when(dns, 0).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "view", 24)
             .when(F.col("event_type") == "click", 16).when(F.col("event_type") == "purchase", 17).otherwise(4))
    name = F.concat("host", F.lit("."))
    e = F.col("event_id")
    answer = lambda i: F.struct(
        name.alias("name"), (F.get_json_object("props", "$.k").cast("bigint") + i).alias("ttl"),
        F.element_at(F.array(F.lit(1), F.lit(2), F.lit(5)), i + 1).alias("type"), F.lit(1).alias("cls"))
    answers = F.when(dns, F.when(to_srv, F.array().cast(
        "array<struct<name:string,ttl:bigint,type:int,cls:int>>")).otherwise(
        F.transform(F.sequence(F.lit(0), (e % 3).cast("int")), answer)))
    if not sections:
        answers = F.lit(None).cast("array<struct<name:string,ttl:bigint,type:int,cls:int>>")
    extra = F.struct(F.lit(41).alias("type"), F.lit(1).alias("cls"))
    return ev.select(
        e.alias("pkt_no"), "ts", *(["event_type"] if keep_type else []), F.lit(4).alias("ip_version"),
        F.when(dns, "UDP").otherwise("TCP").alias("transport"),
        F.when(to_srv, _client()).otherwise(F.lit("192.0.2.53")).alias("src_ip"),
        F.when(to_srv, F.lit("192.0.2.53")).otherwise(_client()).alias("dst_ip"),
        F.when(to_srv, cport).otherwise(sport).alias("src_port"),
        F.when(to_srv, sport).otherwise(cport).alias("dst_port"),
        (60 + F.floor("value").cast("int")).alias("len"),
        flags.alias("tcp_flags"),
        F.lit(-1).cast("bigint").alias("seq"), F.lit(-1).cast("bigint").alias("ack"),
        F.when(dns, (F.col("user_id") % 64).cast("int")).alias("txid"),
        F.when(dns, F.array(name)).alias("qnames"),
        answers.alias("answers"),
        F.when(dns, F.array_repeat(extra, (e % 4).cast("int"))).alias("additionals"),
        F.when(dns, F.when(to_srv, 0).otherwise(1 + e % 3)).cast("int").alias("ancount"),
        F.when(dns, e % 2).cast("int").alias("nscount"),
        F.when(dns, e % 4).cast("int").alias("arcount"),
    )


def handshake_packets(spark, sf_dir, sections: bool = False) -> DataFrame:
    """X1 with flags and sequence numbers that sometimes make a handshake."""
    e = F.col("pkt_no")
    t = F.col("event_type")
    return packets(spark, sf_dir, keep_type=True, sections=sections).withColumns({
        "tcp_flags": F.when(F.col("transport") == "UDP", 0).when(t == "signup", P.SYN)
        .when(t == "click", P.SYN | P.ACK).otherwise(P.ACK),
        "seq": e % 2, "ack": F.expr("(pkt_no div 2) % 2 + 1"),
    }).drop("event_type")


def log_lines(spark, sf_dir, source: DataFrame | None = None) -> DataFrame:
    """X3: resolver log lines, one in five of them noise."""
    k = F.col("event_id") % 5
    tail = (F.when(k == 0, F.concat("host", F.lit(". A IN"))).when(k == 1, F.concat(F.lit("query: "), "host", F.lit(". x")))
            .when(k == 2, F.concat(F.lit("query[A] "), "host", F.lit(". x")))
            .when(k == 3, F.concat(F.lit("QNAME "), "host", F.lit(". x"))).otherwise("noise"))
    return events(spark, sf_dir, True, source).select(F.concat(
        F.lit("["), F.floor(F.unix_micros("ts") / 1_000_000).cast("string"),
        F.lit("] unbound[7:0] info: "), _client(), F.lit(" "), tail).alias("value"))


def protected(spark, sf_dir) -> DataFrame:
    """X4: all hosts, those with most pages first, then two made-up names for every customer.

    The list is cut into ranges; the counts of the ranges give the position that each starts from.
    """
    hosts = hosts_by_page(spark, sf_dir).select(F.col("host").alias("domain"), F.lit(1).alias("n"))
    key = F.col("c_custkey")
    made = [F.concat(F.substr(F.md5(F.concat(F.lit(mark), key.cast("string")).cast("binary")), F.lit(1), (key % size + 5).cast("int")), end)
            for mark, size, end in (("a", 7, F.concat(F.lit("."), F.lower("c_mktsegment"), F.lit(".com"))), ("b", 11, F.lit(".example.org")))]
    names = table(spark, sf_dir, "customer").select(F.explode(F.array(*made)).alias("domain"), F.lit(0).alias("n"))
    counted = hosts.unionByName(names).groupBy("domain").agg(F.sum("n").alias("count"))
    order = [F.desc("count"), F.asc("domain")]
    ranged = cut_lineage(counted.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(starts, "_range").select(
        "domain", (F.col("_start") + F.col("_place")).alias("position"))


def edited_hosts(spark, sf_dir) -> DataFrame:
    """Hosts with one character dropped or doubled: `domain`, `query`, `class`."""
    d = F.col("domain")
    at = F.sequence(F.lit(1), F.char_length(d))
    n = F.char_length(d)
    dropped = F.transform(at, lambda i: F.struct(
        F.concat(F.substr(d, F.lit(1), i - 1), F.substr(d, i + 1, n)).alias("query"), F.lit("omission").alias("class")))
    doubled = F.transform(at, lambda i: F.struct(
        F.concat(F.substr(d, F.lit(1), i), F.substr(d, i, n)).alias("query"), F.lit("addition").alias("class")))
    return domains(spark, sf_dir).select("domain", F.inline(F.concat(dropped, doubled))).distinct()


def queried_names(spark, sf_dir) -> DataFrame:
    """X4: all hosts and their edited forms."""
    return domains(spark, sf_dir).select(F.col("domain").alias("qname")).unionByName(
        edited_hosts(spark, sf_dir).select(F.col("query").alias("qname"))).distinct()


def labelled_pairs(spark, sf_dir) -> DataFrame:
    """Pairs for the pair features: edited forms, the equal pair, and the reversed name as `none`."""
    d = domains(spark, sf_dir)
    return edited_hosts(spark, sf_dir).select(
        F.col("domain").alias("target_domain"), F.col("query").alias("query_domain"),
        F.col("class").alias("classification"),
    ).unionByName(d.select(F.col("domain").alias("target_domain"), F.col("domain").alias("query_domain"),
                           F.lit("original").alias("classification"))
    ).unionByName(d.select(F.col("domain").alias("target_domain"), F.reverse("domain").alias("query_domain"),
                           F.lit("none").alias("classification")))


def scored_labels(spark, sf_dir) -> DataFrame:
    """X5: true label, score and prediction per labelled document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    s = F.least(F.col("n_chars"), F.lit(5000)).cast("double") / 5000
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select(
        "doc_id", F.col("quality").alias("y"), s.alias("score"), (s >= 0.2).cast("int").alias("p"))


def alerts(spark, sf_dir, ev: DataFrame | None = None) -> DataFrame:
    """X6: alert rows as they are read from a log, times as text."""
    e = F.col("event_id")
    at = F.timestamp_micros(F.unix_micros("ts") + (e % 600) * 1_000_000)
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return (events(spark, sf_dir) if ev is None else ev).filter(F.col("event_type") == "error").select(
        e.alias("alert_no"),
        F.when(e % 3 != 0, "DNS_TUNNELING").otherwise("DGA").alias("detector"),
        F.concat(F.upper("host"), F.lit(".")).alias("dns_domain_name"),
        # One in seven alerts was detected before it was logged; the source writes mixed forms.
        F.when(e % 7 == 0, F.date_format(F.timestamp_micros(F.unix_micros("ts") + F.lit(3600_000_000)), iso))
        .when(e % 5 == 0, F.floor(F.unix_micros("ts") / 1_000_000).cast("string"))
        .when(e % 13 == 0, F.lit("yesterday"))
        .otherwise(F.date_format("ts", iso)).alias("unbound_logged_at"),
        F.date_format(F.timestamp_micros(F.unix_micros("ts") + (e % 50) * 1_000_000), iso).alias("flow_row_seen_at"),
        F.when(e % 11 != 0, F.date_format(at, iso)).alias("detected_at"))


def whois(spark, sf_dir) -> DataFrame:
    """X7: registration rows with all fields for four of five hosts, numbered in seeded order."""
    ranked = numbered(domains(spark, sf_dir), 7).withColumnRenamed("idx", "r")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    n = suppliers.count()
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    nations = table(spark, sf_dir, "nation").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    r, day = F.col("r"), F.to_date("o_orderdate")
    domain, number = F.col("domain"), F.col("r").cast("string")
    return (
        ranked.filter(r % 5 != 4)
        .join(suppliers, F.col("s_suppkey") == r % n)
        .join(nations, F.col("n_nationkey") == r % 25)
        .join(orders, F.col("o_orderkey") == r)
        .join(customers, F.col("c_custkey") == r)
        .select("domain", domain.alias("domain_name"), F.col("s_name").alias("registrar"),
                F.col("n_name").alias("country"), F.col("o_orderdate").alias("creation_date"),
                F.when(r % 7 != 3, F.concat(F.lit("admin@"), domain)).alias("emails"),
                F.date_add(day, (r % 3 * 365 + 365).cast("int")).cast("timestamp").alias("expiration_date"),
                F.date_add(day, (r % 200).cast("int")).cast("timestamp").alias("updated_date"),
                F.when(r % 3 == 0, "signedDelegation").when(r % 3 == 1, "unsigned").alias("dnssec"),
                F.col("c_name").alias("org"), F.concat(number, F.lit(" "), F.initcap("c_mktsegment"), F.lit(" Road")).alias("address"),
                F.initcap("r_name").alias("city"), F.left("c_mktsegment", F.lit(2)).alias("state"),
                F.lpad((r * 37 % 100_000).cast("string"), 5, "0").alias("zipcode"),
                F.transform(F.sequence(F.lit(1), (r % 3 + 1).cast("int")), lambda i: F.concat(
                    F.lit("ns"), i.cast("string"), F.lit("."), domain)).alias("name_servers")))


def classes(spark, sf_dir) -> DataFrame:
    """X8: keys with a class and numbers."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")


def labelled_domains(spark, sf_dir) -> DataFrame:
    """Names labelled for training: hosts are `legit`, md5 texts of events on them are `dga`."""
    legit = hosts_by_page(spark, sf_dir).select("page_id", F.col("host").alias("domain"), F.lit("legit").alias("class"))
    made = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.left(F.md5(F.col("url")), (10 + F.col("page_id") % 12).cast("int")), F.lit(".com")).alias("domain"),
        F.lit("dga").alias("class"))
    return legit.unionByName(made).select(
        F.concat_ws("-", "class", "page_id").alias("row_key"), "domain", "class")
