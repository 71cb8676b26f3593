"""Lexical features: first label of a queried name (DGA) and full name of a DNS flow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import (
    char_counts, chars, distinct_kept, entropy, kept_length, longest_run, ngrams, ratio,
)

# The words the dictionary ratio looks for.
COMMON_WORDS = ["the", "shop", "news", "tech", "web", "cloud", "data"]

NOT_LETTER = r"[^\p{L}]"
NOT_DIGIT = r"[^\p{Nd}]"
CONSONANT = "[bcdfghjklmnpqrstvwxyz]"
VOWEL = "[aeiou]"


def first_label(domain: Column) -> Column:
    return F.lower(F.substring_index(domain, ".", 1))


def dga_features(domain: Column) -> dict[str, Column]:
    """The eleven features of a generated-domain model, by column name and in model order."""
    name = first_label(domain)
    length = F.char_length(name)
    unique_chars = distinct_kept(name, "[^a-z0-9]")
    unique_letters = distinct_kept(name, NOT_LETTER)
    unique_digits = distinct_kept(name, NOT_DIGIT)
    letters = F.regexp_replace(name, NOT_LETTER, "")
    letter_count = F.char_length(letters)
    vowels = kept_length(letters, "[^aeiou]")
    words = sum((F.contains(letters, F.lit(w)).cast("int") for w in COMMON_WORDS), F.lit(0))
    return {
        "domain_length": length,
        "domain_num_of_unique_char": unique_chars,
        "domain_num_of_unique_letters": unique_letters,
        "domain_num_of_unique_numbers": unique_digits,
        "ratio_of_letters_of_domain_name": ratio(letter_count, length),
        "ratio_of_numbers_of_domain_name": ratio(kept_length(name, NOT_DIGIT), length),
        "ratio_of_unique_letters_to_num_of_unique_characters": ratio(unique_letters, unique_chars),
        "ratio_of_unique_numbers_to_num_of_unique_characters": ratio(unique_digits, unique_chars),
        "entropy": entropy(name),
        "vowel_consonant_ratio": vowels / (letter_count - vowels + F.lit(1e-6)),
        "dict_ratio": words / F.lit(float(len(COMMON_WORDS))),
    }


DGA_FEATURES = [
    "domain_length",
    "domain_num_of_unique_char",
    "domain_num_of_unique_letters",
    "domain_num_of_unique_numbers",
    "ratio_of_letters_of_domain_name",
    "ratio_of_numbers_of_domain_name",
    "ratio_of_unique_letters_to_num_of_unique_characters",
    "ratio_of_unique_numbers_to_num_of_unique_characters",
    "entropy",
    "vowel_consonant_ratio",
    "dict_ratio",
]


def _labels(name: Column) -> Column:
    return F.filter(F.split(name, "[.]"), lambda x: x != "")


def alternation_frequency(name: Column) -> Column:
    """Vowel/consonant changes between neighbours, also across a dot, over the adjusted length.

    The last neighbour pair is left out, and every change across a dot shortens the length by one.
    """
    cs = chars(name)
    length = F.char_length(name)

    def kind(c: Column) -> Column:
        return F.when(c.rlike(f"^{VOWEL}$"), 1).when(c.rlike(f"^{CONSONANT}$"), -1).otherwise(0)

    kinds = F.transform(cs, kind)

    def step(acc: Column, i: Column) -> Column:
        here, after = F.get(kinds, i), F.get(kinds, i + 1)
        direct = (here * after) == -1
        over_dot = (
            (F.get(cs, i + 1) == ".") & (i < length - 3) & ((here * F.get(kinds, i + 2)) == -1)
        )
        return F.struct(
            (acc["changes"] + F.when(direct | over_dot, 1).otherwise(0)).alias("changes"),
            (acc["total"] - F.when(~direct & over_dot, 1).otherwise(0)).alias("total"),
        )

    start = F.struct(F.lit(0).alias("changes"), length.alias("total"))
    positions = F.when(length >= 3, F.sequence(F.lit(0), F.greatest(length - 3, F.lit(0)))).otherwise(
        F.array().cast("array<int>")
    )
    folded = F.aggregate(positions, start, step)
    return F.try_divide(folded["changes"].cast("double"), folded["total"].cast("double"))


def name_features(name: Column) -> dict[str, Column]:
    """Features of a flow's DNS name, given with its final dot and in its original case."""
    labels = _labels(name)
    parts = F.split(name, "[.]")
    length = F.char_length(name)
    vowels = kept_length(name, "[^aeiou]")
    consonants = kept_length(name, "[^bcdfghjklmnpqrstvwxyz]")
    return {
        "dns_domain_name": name,
        "dns_top_level_domain": F.when(
            name.isNotNull(), F.coalesce(F.try_element_at(labels, F.lit(-1)), F.lit("not-found"))
        ),
        "dns_second_level_domain": F.when(
            F.size(labels) >= 2,
            F.concat_ws(".", F.try_element_at(labels, F.lit(-2)), F.try_element_at(labels, F.lit(-1))),
        ).when(name.isNotNull(), F.lit("not-found")),
        "dns_domain_name_length": length,
        "dns_subdomain_name_length": F.when(F.size(parts) >= 4, F.char_length(parts[0])),
        "uni_gram_domain_name": chars(name),
        "bi_gram_domain_name": ngrams(name, 2),
        "tri_gram_domain_name": ngrams(name, 3),
        "numerical_percentage": ratio(kept_length(name, NOT_DIGIT), length, None),
        "character_distribution": char_counts(name),
        "character_entropy": F.when(name.isNotNull(), entropy(name)),
        "max_continuous_numeric_len": longest_run(name, r"(\p{N}+)"),
        "max_continuous_alphabet_len": longest_run(name, r"(\p{L}+)"),
        "max_continuous_consonants_len": longest_run(name, f"({CONSONANT}+)"),
        "max_continuous_same_alphabet_len": longest_run(name, r"((\p{L})\2*)"),
        "vowels_consonant_ratio": ratio(vowels, consonants),
        "conv_freq_vowels_consonants": alternation_frequency(name),
    }
