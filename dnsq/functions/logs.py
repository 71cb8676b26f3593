"""Scalars over resolver log lines and domain names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# The four query forms a resolver log may hold, tried in this order.
QNAME_PATTERNS = [
    r"(?i)query\[[^\]]+\]\s+([A-Za-z0-9._-]+)\.",
    r"(?i)query:\s+([A-Za-z0-9._-]+)\.",
    r"(?i)QNAME\s+([A-Za-z0-9._-]+)\.",
    r"(?i)\b([A-Za-z0-9._-]+)\.\s+[A-Z]{1,10}\s+IN\b",
]
# What is evaluated: the same matches with less backtracking. In the last form the name is a run of name
# characters that ends in a dot before white space, so it is taken as a whole (its final dot goes with
# the normalisation); a dotted quad starts where a run of digits starts.
_FAST_QNAME = [
    *QNAME_PATTERNS[:3],
    r"(?i)\b([A-Za-z0-9._-]++)(?<=[A-Za-z0-9._-]\.)\s+[A-Z]{1,10}\s+IN\b",
]
_FAST_CLIENT = r"(?<!\d)(\d++\.\d++\.\d++\.\d+)"
# Lower-case text without which the pattern of the same position cannot match; a cheap test first.
_NEEDED = ["query[", "query:", "qname", "in"]
CLIENT_PATTERN = r"(\d+\.\d+\.\d+\.\d+)"
EPOCH_PATTERN = r"\[(\d+(?:\.\d+)?)\]"


def first_group(text: Column, pattern: str) -> Column:
    """First capture group of the first match, NULL when nothing matches."""
    return let(F.regexp_extract(text, pattern, 1), lambda m: F.when(m != "", m))


def normalise_domain(name: Column) -> Column:
    """Outer white space removed, lower case, all trailing dots removed."""
    return F.rtrim(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), F.lit("."))


def qname(line: Column) -> Column:
    """Query name of a log line. A name that is only dots counts as no name."""

    def attempt(lowered: Column, i: int) -> Column:
        if i == len(_FAST_QNAME):
            return F.lit("")
        found = F.regexp_extract(line, _FAST_QNAME[i], 1)
        rest = attempt(lowered, i + 1)
        # The next pattern is only tried where this one has no match.
        return F.when(F.contains(lowered, F.lit(_NEEDED[i])), let(found, lambda f: F.when(f != "", f).otherwise(rest))) \
            .otherwise(rest)

    raw = let(F.lower(line), lambda lowered: attempt(lowered, 0))
    return let(_normalised_match(raw), lambda n: F.when(n != "", n))


def _normalised_match(name: Column) -> Column:
    """`normalise_domain` of a matched name, which holds no white space."""
    return F.rtrim(F.lower(name), F.lit("."))


def client(line: Column) -> Column:
    """First dotted quad of the line; octets are not range-checked."""
    return first_group(line, _FAST_CLIENT)


def log_epoch(line: Column) -> Column:
    """First bracketed number anywhere in the line, as epoch seconds."""
    return first_group(line, EPOCH_PATTERN).try_cast("double")


def log_time(line: Column) -> Column:
    """`log_epoch` as a timestamp with microseconds."""
    return F.timestamp_micros(F.round(log_epoch(line) * 1_000_000).try_cast("bigint"))


def base_domain(name: Column) -> Column:
    """Last two labels, or the whole name when it has one; not public-suffix aware."""
    return F.substring_index(normalise_domain(name), ".", -2)


def canonical_name(name: Column) -> Column:
    """Exactly one form of a decoded name: NULL when empty, else with a final dot."""
    return (
        F.when(name.isNull() | (name == ""), F.lit(None).cast("string"))
        .when(name.endswith("."), name)
        .otherwise(F.concat(name, F.lit(".")))
    )
