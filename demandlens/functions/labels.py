"""Percentages, buckets and labels."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from demandlens import rules
from demandlens.functions.text import as_col, bind, fill


def fit_score(n_matched, n_listed) -> Column:
    """Matched share in whole percent, halves to the even side; 0 for an empty list."""
    n_matched, n_listed = as_col(n_matched), as_col(n_listed)
    share = F.bround(n_matched / F.nullif(n_listed, F.lit(0)) * 100)
    return F.coalesce(share.cast("int"), F.lit(0))


def percent_1dp(count, total) -> Column:
    """``count / total`` in percent, to one decimal; 0 for an empty total.

    Rounds the exact binary value of the quotient, as Python does.  ``bround`` rounds the shortest
    decimal form instead and differs when that form ends in 5 but the binary value lies to one side
    (totals that are multiples of 2,000).  ``near`` is the closest twentieth; an odd one is midway
    between two tenths, and ``side``, computed without rounding error from the high and low bits,
    tells on which side of it the value lies.
    """

    def rounded(x: Column) -> Column:
        near = F.floor(x * 20 + 0.5)
        high = F.floor(x * 1048576) / 1048576
        side = (high * 20 - near) + (x - high) * 20
        below = F.floor(near / 2)
        tenths = (
            F.when((near % 2 == 0) | (side < 0), below)
            .when(side > 0, below + 1)
            .otherwise(below + below % 2)
        )
        return tenths / 10

    share = as_col(count) / F.nullif(as_col(total), F.lit(0)) * 100
    return F.coalesce(bind(share, rounded), F.lit(0.0))


def demand_bucket(pct) -> Column:
    pct = as_col(pct)
    return (
        F.when(pct >= rules.HIGH_DEMAND_PCT, "high")
        .when(pct >= rules.MEDIUM_DEMAND_PCT, "medium")
        .otherwise("low")
    )


def demand_item(skill, pct) -> Column:
    """``skill (12.5%)``"""
    return F.concat(as_col(skill), F.lit(" ("), as_col(pct).cast("string"), F.lit("%)"))


def _by_cutoff(fit, choices) -> Column:
    chain = F
    for cutoff, value in choices:
        chain = chain.otherwise(value) if cutoff is None else chain.when(fit >= cutoff, value)
    return chain


def alignment_label(fit) -> Column:
    return _by_cutoff(as_col(fit), [(cut, F.lit(label)) for cut, label in rules.ALIGNMENT_LABELS])


def similarity_summary(fit, role) -> Column:
    return _by_cutoff(
        as_col(fit), [(cut, fill(text, role=role)) for cut, text in rules.SIMILARITY_SUMMARIES]
    )
