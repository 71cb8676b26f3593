import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dnsq.functions import lexical


def features(spark, text, build):
    df = spark.createDataFrame([(text,)], "d string")
    return df.select(*[c.alias(k) for k, c in build(F.col("d")).items()]).first().asDict()


def test_dga_uses_the_first_label(spark):
    f = features(spark, "WebShop42-x.example.com", lexical.dga_features)
    name = "webshop42-x"
    h = -sum(n / len(name) * math.log2(n / len(name)) for n in Counter(name).values())
    assert f["domain_length"] == 11
    assert f["domain_num_of_unique_char"] == len(set(name) - {"-"})
    assert f["domain_num_of_unique_letters"] == len({c for c in name if c.isalpha()})
    assert f["domain_num_of_unique_numbers"] == 2
    assert f["ratio_of_numbers_of_domain_name"] == pytest.approx(2 / 11)
    assert f["entropy"] == pytest.approx(h)
    assert f["vowel_consonant_ratio"] == pytest.approx(2 / (6 + 1e-6))
    assert f["dict_ratio"] == pytest.approx(2 / 7)
    assert list(f) == lexical.DGA_FEATURES


def test_dga_of_nothing(spark):
    f = features(spark, ".com", lexical.dga_features)
    assert f["domain_length"] == 0 and f["entropy"] == 0
    assert f["ratio_of_letters_of_domain_name"] == 0
    assert f["ratio_of_unique_letters_to_num_of_unique_characters"] == 0


def test_name_features(spark):
    f = features(spark, "aab12.Www.example.com.", lexical.name_features)
    assert f["dns_top_level_domain"] == "com"
    assert f["dns_second_level_domain"] == "example.com"
    assert f["dns_domain_name_length"] == 22
    assert f["dns_subdomain_name_length"] == 5
    assert f["bi_gram_domain_name"][:2] == ["aa", "ab"]
    assert f["max_continuous_numeric_len"] == 2
    assert f["max_continuous_alphabet_len"] == 7
    assert f["max_continuous_same_alphabet_len"] == 2
    assert f["max_continuous_consonants_len"] == 3
    assert f["character_distribution"]["."] == 4


def alternation(name):
    cons, vow = "bcdfghjklmnpqrstvwxyz", "aeiou"

    def kind(i):
        return 1 if name[i] in vow else -1 if name[i] in cons else 0

    changes, total = 0, len(name)
    for i in range(len(name) - 2):
        if kind(i) * kind(i + 1) == -1:
            changes += 1
        elif name[i + 1] == "." and i < len(name) - 3 and kind(i) * kind(i + 2) == -1:
            changes += 1
            total -= 1
    return changes / total


@pytest.mark.parametrize("name", ["ab.ed.com.", "a.b.c.", "xyz.", "www.aeiou.io.", "b.", "."])
def test_alternation(spark, name):
    assert features(spark, name, lexical.name_features)["conv_freq_vowels_consonants"] == pytest.approx(alternation(name))


def test_short_and_missing_names(spark):
    one = features(spark, "com.", lexical.name_features)
    assert one["dns_second_level_domain"] == "not-found"
    assert one["dns_subdomain_name_length"] is None
    assert features(spark, ".", lexical.name_features)["dns_top_level_domain"] == "not-found"
    assert all(v is None for v in features(spark, None, lexical.name_features).values())
