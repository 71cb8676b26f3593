"""Scalars over packet rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ports of the named application protocols, tested in this order.
PROTOCOL_PORTS = {"HTTP": 80, "HTTPS": 443, "DNS": 53}
FIN, SYN, RST, ACK = 0x01, 0x02, 0x04, 0x10


def app_protocol(src_port: Column, dst_port: Column) -> Column:
    out = None
    for name, port in PROTOCOL_PORTS.items():
        hit = (dst_port == port) | (src_port == port)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Others")


def has_flag(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask)) != 0


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def flow_key(app: Column, src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column,
             txid: Column, dns_key: str = "txid") -> Column:
    """Text key shared by all packets that may belong to one flow.

    DNS packets with a transaction id are keyed by that id alone, or with `dns_key`
    'txid+endpoints' also by their endpoints. All others are keyed by the unordered address
    pair, the unordered port pair and the application protocol.
    """
    if dns_key not in ("txid", "txid+endpoints"):
        raise ValueError(f"unknown dns_key: {dns_key}")
    pair = F.concat_ws(
        "|", app,
        F.least(src_ip, dst_ip), F.greatest(src_ip, dst_ip),
        F.least(src_port, dst_port).cast("string"), F.greatest(src_port, dst_port).cast("string"),
    )
    by_id = F.concat_ws("|", F.lit("txid"), txid.cast("string"))
    if dns_key == "txid+endpoints":
        by_id = F.concat_ws("|", by_id, pair)
    return F.when((app == "DNS") & txid.isNotNull(), by_id).otherwise(pair)


def flow_id_text(ts: Column, src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column,
                 txid: Column) -> Column:
    """Display text of a flow; grouping never uses it."""
    base = F.concat_ws(
        "_", F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), src_ip, src_port.cast("string"),
        dst_ip, dst_port.cast("string"),
    )
    return F.when(txid.isNull(), base).otherwise(F.concat_ws("_", base, txid.cast("string")))
