"""One entry per registered query: (spark, sf_dir) -> DataFrame, always over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexical, pairs as PF
from ..functions.logs import base_domain, canonical_name
from ..operators import (
    alerts as A, datasets as D, delays as DL, domains as DO, enrich, flow_features as FF, flows as FL,
    matching as M, metrics as ME,
)
from ..operators.models import join_hits, missing_columns, numeric
from ..session import cut_lineage
from . import tables as X

AS_OF = "2024-06-30"


def r(c: Column | str, places: int = 9) -> Column:
    """Rounded, and without a negative zero, so that engines can be compared."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, places) + F.lit(0.0)


def _rounded(df: DataFrame, places: int = 9, special: dict[str, int] | None = None) -> DataFrame:
    """All double columns rounded; `special` maps a part of a column name to other places."""
    out = []
    for name, kind in df.dtypes:
        if kind == "double":
            p = next((v for k, v in (special or {}).items() if k in name), places)
            out.append(r(name, p).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def _joined(c: Column) -> Column:
    return F.concat_ws(",", F.transform(c, lambda x: x.cast("string")))


# Logs and domains

def log_parse(spark, d):
    q = DO.parse_queries(X.log_lines(spark, d))
    return q.select("client", "qname", base_domain(F.col("qname")).alias("base"),
                    F.unix_micros("logged_at").alias("logged_us"))


def log_totals(spark, d):
    return DL.log_totals(X.log_lines(spark, d))


def domain_topn(spark, d):
    return DO.top_domains(DO.domain_counts(DO.parse_queries(X.log_lines(spark, d), need_client=False)), 25)


def base_domain_counts(spark, d):
    q = DO.parse_queries(X.log_lines(spark, d), need_client=False)
    return DO.domain_counts(q, base=True, min_count=2)


def domain_first_position(spark, d):
    return DO.distinct_first(X.hosts_by_page(spark, d), "host", "page_id")


def canonical_names(spark, d):
    """Names with and without a final dot, and an empty one, in canonical form."""
    raw = F.when(F.col("page_id") % 3 == 0, F.concat("host", F.lit("."))).when(
        F.col("page_id") % 7 == 1, F.lit("")).otherwise(F.col("host"))
    return X.hosts_by_page(spark, d).select("page_id", canonical_name(raw).alias("name"))


def dga_features(spark, d):
    names = DO.parse_queries(X.log_lines(spark, d)).select("qname").distinct()
    return _rounded(names.withColumns(lexical.dga_features(F.col("qname"))))


def domain_lexical(spark, d):
    names = X.domains(spark, d).select(F.concat("domain", F.lit(".")).alias("name"))
    feats = lexical.name_features(F.col("name"))
    out = names.select(*[c.alias(k) for k, c in feats.items()])
    dist = F.concat_ws(",", F.array_sort(F.transform(
        F.map_entries("character_distribution"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))))
    return _rounded(out.withColumns({
        **{c: _joined(F.col(c)) for c in ("uni_gram_domain_name", "bi_gram_domain_name", "tri_gram_domain_name")},
        "character_distribution": dist}))


# Pairs

def pair_features(spark, d):
    p = X.labelled_pairs(spark, d)
    return _rounded(p.withColumns(PF.pair_features(F.col("target_domain"), F.col("query_domain"))))


def pair_features_binary(spark, d):
    p = X.labelled_pairs(spark, d)
    return _rounded(p.withColumns(PF.binary_pair_features(F.col("target_domain"), F.col("query_domain"))))


def typo_top_candidates(spark, d):
    return _rounded(M.top_candidates(X.queried_names(spark, d), X.protected(spark, d), 50))


def typo_best_match(spark, d):
    return _rounded(M.best_match(X.queried_names(spark, d), X.protected(spark, d)))


# Flows

def _flow_rows(assigned):
    return assigned.groupBy("flow_uid").agg(
        F.count(F.lit(1)).alias("packets"), F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))


def flow_assign_idle(spark, d):
    return _flow_rows(FL.assign_flows(X.packets(spark, d, sections=False), X.IDLE_ONLY))


def flow_assign_default(spark, d):
    return _flow_rows(FL.assign_flows(X.packets(spark, d, sections=False)))


def flow_assign_full(spark, d):
    return FL.assign_flows(X.packets(spark, d, sections=False), X.LIMITS).select("pkt_no", "flow_uid")


def flow_orientation(spark, d):
    return FL.flow_orientation(FL.assign_flows(X.packets(spark, d, sections=False), X.LIMITS))


def _features(spark, d, names, places=4, special=None):
    return _rounded(FF.packet_features(FL.assign_flows(X.packets(spark, d, sections=False), X.LIMITS), names), places, special)


def flow_counts_rates(spark, d):
    return _features(spark, d, FF.count_names(), 6)


def flow_len_stats(spark, d):
    return _features(spark, d, FF.length_names())


def flow_delta_len_stats(spark, d):
    return _features(spark, d, FF.delta_len_names())


def flow_delta_time_stats(spark, d):
    return _features(spark, d, FF.delta_time_names(), 7, {
        "mean": 9, "variance": 0, "standard_deviation": 4, "skewness": 6, "coefficient": 6})


def flow_handshake(spark, d):
    assigned = FL.assign_flows(X.handshake_packets(spark, d), X.LIMITS)
    narrow = assigned.select("flow_uid", "flow_key", "slot", "transport", "ts_us", "pkt_no", "tcp_flags", "seq", "ack")
    return _rounded(FF.handshakes(cut_lineage(narrow)), 6)


def flow_dns_records(spark, d):
    return _rounded(FF.dns_records(FL.assign_flows(X.packets(spark, d), X.LIMITS)))


def flow_record_lists(spark, d):
    chunks = FF.record_list_chunks(FL.assign_flows(X.packets(spark, d), X.LIMITS))
    lists = FF.record_lists(chunks)
    return lists.select("flow_uid", *[_joined(F.col(c)).alias(c) for c in FF.RECORD_LISTS])


def flow_record_chunks(spark, d):
    """The lists in rows of bounded size; the bound is low, so that the flows of the given tables are cut."""
    chunks = FF.record_list_chunks(FL.assign_flows(X.packets(spark, d), X.LIMITS), X.CHUNK_RECORDS)
    return FF.numbered_chunks(chunks).select("flow_uid", "chunk", *[_joined(F.col(c)).alias(c) for c in FF.RECORD_LISTS])


def flow_ttl_stats(spark, d):
    return _rounded(FF.ttl_stats(FL.assign_flows(X.packets(spark, d), X.LIMITS)), 4)


def tcp_flag_counts(spark, d):
    return FL.tcp_flag_counts(X.packets(spark, d))


def protocol_mix(spark, d):
    return FL.protocol_mix(X.packets(spark, d))


def whois_enrich(spark, d):
    names = X.domains(spark, d).select(F.concat("domain", F.lit(".")).alias("dns_domain_name"))
    out = enrich.with_whois(names, X.whois(spark, d), AS_OF)
    days = [c for c, source in enrich.WHOIS_SOURCE.items() if source.endswith("_date")]
    out = out.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in days}).withColumn(
        "dns_domain_name_servers", F.concat_ws(",", "dns_domain_name_servers"))
    return out.select("dns_domain_name", *enrich.WHOIS_COLUMNS)


# Delays

def _seen(spark, d):
    return DL.first_seen(DO.parse_queries(X.log_lines(spark, d)))


def _detected(spark, d):
    return DL.first_detected(X.alerts(spark, d))


def _delays(spark, d):
    return DL.delay_rows(_seen(spark, d), _detected(spark, d))


def first_seen_detected(spark, d):
    return _delays(spark, d).select(
        "domain", F.unix_micros("first_seen_at").alias("seen_us"), F.unix_micros("first_detected_at").alias("detected_us"),
        r("first_seen_to_detected_seconds", 6).alias("delay"))


def delay_summary(spark, d):
    return _rounded(DL.delay_summary(_delays(spark, d)), 6)


def slowest_domains(spark, d):
    return DL.slowest(_delays(spark, d), 20).select("domain", r("first_seen_to_detected_seconds", 6).alias("delay"))


def domain_overlap(spark, d):
    return DL.overlap(_seen(spark, d), _detected(spark, d))


def alert_delays(spark, d):
    out = DL.with_alert_delays(X.alerts(spark, d))
    return out.select("alert_no", "unbound_logged_at", "flow_row_seen_at", "detected_at",
                      r("detection_delay_seconds", 6).alias("detection_delay_seconds"),
                      *[r(F.col(f"pipeline_stage_delays.{c}"), 6).alias(c) for c in (
                          "source_to_row_seen_seconds", "row_seen_to_detected_seconds", "source_to_detected_seconds")])


# Alerts on a fixed linear score

def dga_linear_score(features: dict[str, Column]) -> Column:
    raw = (features["domain_length"] * 0.03 + features["entropy"] * 0.15
           + features["ratio_of_numbers_of_domain_name"] * 0.5 - features["dict_ratio"] * 0.2)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw))


def _later(seconds: int) -> Column:
    return F.timestamp_micros(F.unix_micros("logged_at") + seconds * 1_000_000)


def dga_alerts(spark, d):
    q = DO.parse_queries(X.log_lines(spark, d))
    names = q.select("qname").distinct().withColumn(
        "s", F.round(dga_linear_score(lexical.dga_features(F.col("qname"))), 9))
    # Kept before the filter, which would else be applied to every line.
    names = cut_lineage(names.withColumn("scores", F.create_map(F.lit("dga"), "s", F.lit("legit"), 1 - F.col("s"))))
    hits = A.dga_alerts(join_hits(q, names.filter("s >= 0.5")), _later(3), threshold=0.5)
    return hits.select("detector", "domain", "score", r(F.col("scores")["legit"]).alias("legit"),
                       "unbound_logged_at", "detected_at", r("detection_delay_seconds", 6).alias("delay"))


def typo_alerts(spark, d):
    q = DO.parse_queries(X.log_lines(spark, d))
    best = M.best_match(q, X.protected(spark, d), least=0.79).withColumn("score", F.round("score", 9))
    hits = A.typo_alerts(join_hits(q, best.filter("score >= 0.8")), _later(2), threshold=0.8)
    return hits.select("detector", "domain", "score", "target", "predicted_class", "unbound_logged_at",
                       "detected_at", r("detection_delay_seconds", 6).alias("delay"))


TUNNEL_COLUMNS = ["packets_numbers", "total_bytes", "ttl_values_max", "not_in_table"]


def tunnel_alerts(spark, d):
    # Three aggregations follow, so the assignment is kept.
    assigned = cut_lineage(FL.assign_flows(X.packets(spark, d), X.LIMITS))
    flows = (
        FF.flow_header(assigned, ["packets_numbers", "total_bytes"])
        .join(FF.dns_records(assigned).select("flow_uid", "dns_domain_name"), "flow_uid", "left")
        .join(FF.ttl_stats(assigned).select("flow_uid", "ttl_values_max"), "flow_uid", "left"))
    missing = missing_columns(TUNNEL_COLUMNS, flows.columns)
    x = {c: numeric(flows, c) for c in TUNNEL_COLUMNS}
    s = F.least(F.lit(1.0), x["packets_numbers"] * 0.05 + x["total_bytes"] * 0.0001
                + F.when(x["ttl_values_max"] < 0, -0.1).otherwise(0.1) + x["not_in_table"])
    seen = F.timestamp_micros(F.unix_micros("timestamp") + 500_000)
    scored = flows.withColumn("malicious_score", F.round(s, 9)).withColumnRenamed("flow_uid", "row_index")
    hits = A.tunnel_alerts(scored, F.timestamp_micros(F.unix_micros("timestamp") + 900_000), seen, 0.5, missing)
    return hits.select(
        "detector", "row_index", "score", "src_ip", "dst_ip", "dns_domain_name", "unbound_logged_at",
        r("detection_delay_seconds", 6).alias("delay"),
        r("pipeline_stage_delays.row_seen_to_detected_seconds", 6).alias("row_to_detected"),
        _joined(F.col("missing_feature_columns")).alias("missing"))


# Data sets

def typo_variants(spark, d):
    return D.typo_variants(X.domains(spark, d))


def negative_pairs(spark, d):
    return D.negative_pairs(X.domains(spark, d), 300, 42)


def negative_sample(spark, d):
    # Edited names join the list, so that some of the drawn names are variants and must be left out.
    names = X.domains(spark, d)
    listed = names.unionByName(X.edited_hosts(spark, d).filter(F.col("class") == "omission").select(
        F.col("query").alias("domain"))).distinct()
    return D.negative_samples(names, listed, D.typo_variants(names), 40, 42)


def keep_classes(spark, d):
    return D.keep_classes(D.fold_case(X.labelled_pairs(spark, d).withColumn(
        "target_domain", F.upper("target_domain"))))


def class_distribution(spark, d):
    return _rounded(D.class_distribution(X.classes(spark, d), "p_type"))


def class_downsample(spark, d):
    return D.class_downsample(X.classes(spark, d), "p_type", "p_partkey", "ECONOMY", 100).select("p_partkey", "p_type")


def stratified_split(spark, d):
    return D.stratified_split(X.classes(spark, d), "p_type", "p_partkey").select("p_partkey", "p_type", "is_test")


def kfold_assign(spark, d):
    return D.kfold(X.classes(spark, d), "p_type", "p_partkey").select("p_partkey", "p_type", "fold")


def shuffle_order(spark, d):
    from ..operators.ranking import hash_rank

    return hash_rank(X.classes(spark, d), [], "p_partkey", 42, out="place").select("p_partkey", "place")


def class_weights(spark, d):
    return _rounded(D.class_weights(X.classes(spark, d), "p_type"))


def label_encode(spark, d):
    return D.label_encode(X.classes(spark, d), "p_type").select("p_partkey", "p_type", "code")


def standard_scale(spark, d):
    return _rounded(D.standard_scale(X.classes(spark, d), ["p_size", "p_retailprice"]).select(
        "p_partkey", "p_size_scaled", "p_retailprice_scaled"), 6)


def stacked_frames(spark, d):
    c = X.classes(spark, d)
    both = D.stack([c.select("p_partkey", "p_type"), c.select("p_partkey", "p_size")])
    return both.select("p_partkey", "p_type", "p_size")


# Reports

def confusion_matrix(spark, d):
    return ME.confusion_matrix(X.scored_labels(spark, d), "y", "p")


def classification_report(spark, d):
    return _rounded(ME.classification_report(X.scored_labels(spark, d), "y", "p"))


def binary_metrics(spark, d):
    return _rounded(ME.binary_metrics(X.scored_labels(spark, d), "y", "p"))


def roc_auc(spark, d):
    return _rounded(ME.roc_auc(X.scored_labels(spark, d), "y", "score"))


def overfitting_report(spark, d):
    rows = X.scored_labels(spark, d)
    rules = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), (F.col("score") >= t).cast("int").alias("guess"))
                                for m, t in (("low", 0.1), ("mid", 0.3), ("high", 0.6))]))
    split = D.stratified_split(rows, "y", "doc_id")
    folds = D.kfold(rows, "y", "doc_id")
    by_model = lambda df, by: ME.binary_metrics(
        df.withColumn("m", rules).select("*", "m.*"), "y", "guess", by=by)
    return _rounded(ME.overfitting_report(
        by_model(split.filter(~F.col("is_test")), ["model"]), by_model(split.filter("is_test"), ["model"]),
        by_model(folds, ["model", "fold"]).drop("fold")))


QUERIES = {f.__name__: f for f in (
    log_parse, log_totals, domain_topn, base_domain_counts, domain_first_position, canonical_names, dga_features,
    domain_lexical, pair_features, pair_features_binary, typo_top_candidates, typo_best_match, flow_assign_idle,
    flow_assign_default, flow_assign_full, flow_orientation, flow_counts_rates, flow_len_stats, flow_delta_len_stats,
    flow_delta_time_stats, flow_handshake, flow_dns_records, flow_record_lists, flow_record_chunks, flow_ttl_stats, tcp_flag_counts,
    protocol_mix, whois_enrich, first_seen_detected, delay_summary, slowest_domains, domain_overlap, alert_delays,
    dga_alerts, typo_alerts, tunnel_alerts, typo_variants, negative_pairs, negative_sample, keep_classes,
    class_distribution, class_downsample, stratified_split, kfold_assign, shuffle_order, class_weights, label_encode,
    standard_scale, stacked_frames, confusion_matrix, classification_report, binary_metrics, roc_auc,
    overfitting_report,
)}
