"""Small string helpers shared by the lexical and the pair features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once. Inside lambda functions nothing else keeps Spark
    from evaluating a repeated sub-expression again at every use."""
    return F.transform(F.array(value), body)[0]


def chars(text: Column) -> Column:
    """Characters of a text as an array, empty for the empty text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def ratio(top: Column, bottom: Column, otherwise: float | None = 0.0) -> Column:
    """top / bottom as a double; `otherwise` where the divisor is zero."""
    value = F.try_divide(top.cast("double"), bottom.cast("double"))
    if otherwise is None:
        return value
    return F.when(bottom == 0, F.lit(otherwise)).otherwise(value)


def kept_length(text: Column, dropped: str) -> Column:
    """Number of characters left after removing those that match `dropped`."""
    return F.char_length(F.regexp_replace(text, dropped, ""))


def distinct_kept(text: Column, dropped: str) -> Column:
    """Number of different characters left after removing those that match `dropped`."""
    return F.size(F.array_distinct(chars(F.regexp_replace(text, dropped, ""))))


def occurrences(text: Column, one_char: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(one_char), F.lit("")))


def ngrams(text: Column, n: int) -> Column:
    """Consecutive n-grams in order, empty when the text is shorter than n."""
    last = F.char_length(text) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(last >= 1, grams).when(text.isNotNull(), F.array().cast("array<string>"))


def char_counts(text: Column) -> Column:
    """Map of character to number of occurrences."""
    length = F.char_length(text)
    return F.map_from_entries(
        F.transform(
            F.array_distinct(chars(text)),
            lambda c: F.struct(c.alias("key"), (length - F.char_length(F.replace(text, c, F.lit("")))).alias("value")),
        )
    )


def entropy(text: Column) -> Column:
    """Shannon entropy (base 2) over all characters; 0 for the empty text."""
    length = F.char_length(text).cast("double")
    return F.when(F.char_length(text) == 0, F.lit(0.0)).otherwise(
        F.aggregate(
            F.map_values(char_counts(text)),
            F.lit(0.0),
            lambda acc, n: acc - (n / length) * F.log2(n / length),
        )
    )


def longest_run(text: Column, pattern: str) -> Column:
    """Length of the longest match of `pattern` (group 1), 0 when there is none."""
    runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(
        text.isNotNull(),
        F.coalesce(F.array_max(F.transform(runs, lambda r: F.char_length(r))), F.lit(0)),
    )
