"""Tokens and features of a message's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """The parts between white space, commas, full stops and semicolons; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s,.;]+"), lambda t: t != "")


def text_features(text: Column) -> Column:
    """Ten times the share of distinct tokens (case ignored), the share all of whose characters are upper case, and the share of four characters. Three zeros without tokens."""

    def features(t: Column) -> Column:
        n = F.size(t).cast("double")
        share = lambda keep: F.size(F.filter(t, keep)).cast("double") / n
        values = F.array(
            10.0 * F.size(F.array_distinct(F.transform(t, F.lower))).cast("double") / n,
            share(lambda w: w.rlike(r"^\p{Lu}+$")),
            share(lambda w: F.char_length(w) == 4),
        )
        return F.when(n > 0, values).otherwise(F.array(*[F.lit(0.0)] * 3))

    # Bound as a lambda's variable, the tokens are cut once and not at each use.
    return F.transform(F.array(tokens(text)), features)[0]


def optional_string(value: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(value), F.lit(""))


def optional_long(value: Column) -> Column:
    return optional_string(value).try_cast("long")


def int_set(value: Column) -> Column:
    """The distinct numbers of a text like "[3, 1]" in ascending order; blank or null is the empty set."""
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\[\]\s]", ""), ","), lambda x: x != "")
    return F.array_sort(F.array_distinct(F.transform(parts, lambda x: x.try_cast("int"))))


def feature(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def document_id(*parts: Column) -> Column:
    return F.concat_ws("#", *[p.cast("string") for p in parts])


def cluster_label(index: Column, label: Column) -> Column:
    """"2: bots", or "2" without a label."""
    return F.concat_ws(": ", index.cast("string"), label)
