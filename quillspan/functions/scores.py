"""Scores of groups: recency, confidence, placement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions import values as V


def recency(last_seen: Column, now: Column) -> Column:
    days = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(last_seen.cast("timestamp"))) / F.lit(86_400_000_000.0)
    out = F.when(last_seen.isNull(), V.RECENCY_UNKNOWN)
    for most, factor in V.RECENCY_DAYS:
        out = out.when(days <= most, factor)
    return out.otherwise(V.RECENCY_OLD)


def confidence(support: Column, contradiction: Column, occurrences: Column, projects: Column, recent: Column) -> Column:
    """Struct of the four components and the score, rounded to two places."""
    decisive = support + contradiction
    ratio = F.when(decisive > 0, support / decisive).otherwise(0.0)
    recurrence = F.least(F.lit(1.0), occurrences / F.lit(V.RECURRENCE_FULL))
    cross = F.least(F.lit(1.0), F.greatest(F.lit(0), projects - 1) / F.lit(V.CROSS_PROJECT_FULL))
    w = V.CONFIDENCE_WEIGHTS
    score = F.lit(w["support"]) * ratio + F.lit(w["recurrence"]) * recurrence + F.lit(w["cross_project"]) * cross + F.lit(w["recency"]) * recent
    return F.struct(ratio.alias("support_ratio"), recurrence.alias("recurrence"), cross.alias("cross_project"), recent.alias("recency"), F.round(score, 2).alias("score"))


def clipped(x: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4)


def placement_scores() -> dict[str, Column]:
    """Score of each placement from the feature columns."""
    c = F.col
    against = c("contradiction_count") / F.greatest(F.lit(1), c("support_count") + c("contradiction_count"))
    scope = c("scope_concentration") * c("scope_specificity")
    everywhere = (
        0.05 + 0.24 * c("support_ratio") + 0.22 * c("recurrence") + 0.35 * c("cross_project_support") + 0.14 * c("actionability") + 0.10 * c("confidence")
        - 0.10 * c("project_concentration") - 0.15 * scope - 0.20 * against
    )
    return {
        "ignore": clipped(
            0.10 + 0.35 * (1 - c("support_ratio")) + 0.40 * against + 0.15 * (1 - c("actionability")) + 0.10 * (1 - c("confidence"))
            + F.when(c("support_count") < 2, 0.10).otherwise(0.0)
        ),
        "global_rule": clipped(F.when(c("global_eligible"), everywhere).otherwise(F.least(everywhere, F.lit(0.24)))),
        "project_rule": clipped(
            0.10 + 0.20 * c("support_ratio") + 0.20 * c("recurrence") + 0.25 * c("project_concentration") + 0.15 * c("actionability") + 0.10 * c("confidence")
            - 0.12 * scope - 0.25 * c("cross_project_support") - 0.40 * against
        ),
        "scoped_rule": clipped(
            0.05 + 0.16 * c("support_ratio") + 0.10 * c("recurrence") + 0.40 * scope + 0.12 * c("actionability") + 0.07 * c("confidence")
            + 0.05 * c("context_consistency") - 0.35 * against
        ),
        "skill": clipped(
            0.03 + 0.15 * c("support_ratio") + 0.10 * c("recurrence") + 0.50 * c("procedural_complexity") + 0.12 * c("actionability") + 0.08 * c("confidence")
            - 0.10 * against
        ),
    }
