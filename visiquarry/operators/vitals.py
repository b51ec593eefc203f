"""Web vitals: ratings, phase shares and their diagnosis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .findings import finding
from .keys import KEYS

# The last good and the last fair value of each metric.
LIMITS = {"LCP": (2500, 4000), "INP": (200, 500), "CLS": (0.1, 0.25), "TTFB": (800, 1800)}
LCP_BUDGETS = {"timeToFirstByte": 0.4, "resourceLoadDelay": 0.1, "resourceLoadDuration": 0.4, "elementRenderDelay": 0.1}
INP_DOMINANT = 0.5
EARLY_SHIFT_MS = 2500


def rate(metric: str, value: Column) -> Column:
    good, fair = LIMITS[metric]
    return F.when(value <= good, "good").when(value <= fair, "needs-improvement").when(value.isNotNull(), "poor")


def severity(metric: str, value: Column) -> Column:
    rating = rate(metric, value)
    return F.when(rating == "poor", "critical").when(rating == "needs-improvement", "high").otherwise("medium")


def phase_shares(values: Sequence[Column]) -> list[Column]:
    """Each value's share of their sum, negatives as 0; all 0 where the sum is 0."""
    own = [F.greatest(F.coalesce(v, F.lit(0)).cast("double"), F.lit(0.0)) for v in values]
    total = sum(own[1:], own[0])
    return [F.when(total > 0, v / total).otherwise(0.0) for v in own]


def dominant(phases: dict[str, Column]) -> Column:
    """Name of the largest phase, the first of equal ones."""
    most = F.greatest(*phases.values())
    out = F.lit(None).cast("string")
    for name, value in reversed(list(phases.items())):
        out = F.when(value == most, name).otherwise(out)
    return out


def passes(lcp: Column, inp: Column, cls: Column) -> Column:
    return (lcp <= LIMITS["LCP"][0]) & (inp <= LIMITS["INP"][0]) & (cls <= LIMITS["CLS"][0])


def lcp_phases(lcp: Column) -> dict[str, Column]:
    return {name: lcp[name] for name in LCP_BUDGETS}


def ratings(audits: DataFrame) -> DataFrame:
    """url and the rating of each metric that its attribution allows. audits: url, lcp_ms, inp_ms, cls, lcp, inp (structs)."""
    return audits.select(
        *KEYS, "url", rate("LCP", F.col("lcp_ms")).alias("lcp_rating"), rate("CLS", F.col("cls")).alias("cls_rating"),
        F.when(F.col("inp").isNotNull(), rate("INP", F.col("inp_ms"))).alias("inp_rating"),
        rate("TTFB", F.col("lcp.timeToFirstByte")).alias("ttfb_rating"),
    )


def diagnose(audits: DataFrame) -> DataFrame:
    """Findings of lab or field audits with attribution structs lcp, inp and shift: phases over their budget and shifts by time."""
    url, none = F.col("url"), F.lit("")
    made = []
    values = lcp_phases(F.col("lcp"))
    for (name, budget), share, value in zip(LCP_BUDGETS.items(), phase_shares(list(values.values())), values.values()):
        made.append(F.when(F.col("lcp").isNotNull() & (share > budget), finding(f"lcp.{name}", "cwv", severity("LCP", F.col("lcp_ms")), url, value.cast("string"), share)))
    names = ("inputDelay", "processingDuration", "presentationDelay")
    for name, share in zip(names, phase_shares([F.col("inp")[n] for n in names])):
        made.append(F.when(F.col("inp").isNotNull() & (share > INP_DOMINANT), finding(f"inp.{name}", "cwv", severity("INP", F.col("inp_ms")), url, F.col("inp")[name].cast("string"), share)))
    shifted = F.col("shift").isNotNull() & (rate("CLS", F.col("cls")) != "good")
    early = F.col("shift.largestShiftTime") < EARLY_SHIFT_MS
    made.append(F.when(shifted & early, finding("cls.loadShift", "cwv", severity("CLS", F.col("cls")), url, none)))
    made.append(F.when(shifted & ~early, finding("cls.lateShift", "cwv", severity("CLS", F.col("cls")), url, none)))
    return audits.select(*KEYS, F.explode(F.array_compact(F.array(*made))).alias("f")).select(*KEYS, "f.*")
