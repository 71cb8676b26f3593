"""Features of a (target, query) pair of domain names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import jaro
from .text import kept_length, let, ngrams, occurrences, ratio

# The classes of the labelled pair set.
PAIR_CLASSES = [
    "addition",
    "omission",
    "replacement",
    "transposition",
    "none",
    "subdomain",
    "homoglyph",
]


def jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Jaccard similarity of the n-gram sets; 0 when either set is empty."""

    def of_sets(s: Column) -> Column:
        return let(
            F.struct(
                F.size(F.array_intersect(s["l"], s["r"])).alias("shared"),
                (F.size(s["l"]) + F.size(s["r"])).alias("both")),
            lambda k: ratio(k["shared"], k["both"] - k["shared"]))

    return let(
        F.struct(F.array_distinct(ngrams(a, n)).alias("l"), F.array_distinct(ngrams(b, n)).alias("r")), of_sets)


def pair_features(target: Column, query: Column) -> dict[str, Column]:
    """The eleven features of the multi-class pair model, in model order."""
    distance = F.levenshtein(target, query)
    longest = F.greatest(F.char_length(target), F.char_length(query))
    return {
        "levenshtein": distance,
        "normalized_levenshtein": ratio(distance, longest, None),
        "jaccard_similarity": jaccard(target, query),
        "jaro_similarity": jaro(target, query),
        "length_diff": F.char_length(target) - F.char_length(query),
        **_ends(target, query),
        "digit_ratio": digit_ratio(query),
        "hyphen_count": occurrences(query, "-"),
        "dot_count": occurrences(query, "."),
        "tld_match": (
            F.substring_index(target, ".", -1) == F.substring_index(query, ".", -1)
        ).cast("int"),
    }


def binary_pair_features(target: Column, query: Column) -> dict[str, Column]:
    """The six features of the binary pair model, in model order."""
    return {
        "length_diff": F.abs(F.char_length(target) - F.char_length(query)),
        "levenshtein": F.levenshtein(target, query),
        **_ends(target, query),
        "digit_ratio": digit_ratio(query),
        "hyphen_count": occurrences(query, "-"),
    }


def digit_ratio(query: Column) -> Column:
    """Share of digits; NULL for an empty query."""
    return ratio(kept_length(query, r"[^\p{Nd}]"), F.char_length(query), None)


def _ends(target: Column, query: Column) -> dict[str, Column]:
    three = F.lit(3)
    return {
        "prefix_match": (F.left(target, three) == F.left(query, three)).cast("int"),
        "suffix_match": (F.right(target, three) == F.right(query, three)).cast("int"),
    }


PAIR_FEATURES = [
    "levenshtein",
    "normalized_levenshtein",
    "jaccard_similarity",
    "jaro_similarity",
    "length_diff",
    "prefix_match",
    "suffix_match",
    "digit_ratio",
    "hyphen_count",
    "dot_count",
    "tld_match",
]

BINARY_PAIR_FEATURES = [
    "length_diff",
    "levenshtein",
    "prefix_match",
    "suffix_match",
    "digit_ratio",
    "hyphen_count",
]
