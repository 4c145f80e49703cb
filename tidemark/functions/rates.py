"""Rates of a batter's and a bowler's sums; a rate without a denominator is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.exprs import ratio

PHASES = ("powerplay", "middle", "death")


def _per(num: Column, den: str, scale: float = 1.0) -> Column:
    return ratio(num, F.col(den), scale)


def batting(before: str = "", phases: tuple[str, ...] = PHASES) -> dict[str, Column]:
    """Nine rates and four for each phase, from columns (with a prefix, if any) runs, balls, outs,
    fours, sixes, dots, innings, controlled, control_balls, aerial, elev_balls, and of each phase
    runs, balls and boundaries."""
    c, n = (lambda x: F.col(before + x)), (lambda x: before + x)
    out = {
        "average": _per(c("runs"), n("outs")), "strike_rate": _per(c("runs"), n("balls"), 100.0), "boundary_percentage": _per(c("fours") + c("sixes"), n("balls")),
        "dot_ball_percentage": _per(c("dots"), n("balls")), "balls_per_dismissal": _per(c("balls"), n("outs")), "runs_per_innings": _per(c("runs"), n("innings")),
        "control_percentage": _per(c("controlled"), n("control_balls")), "false_shot_percentage": _per(c("control_balls") - c("controlled"), n("control_balls")), "aerial_percentage": _per(c("aerial"), n("elev_balls")),
    }
    for p in phases:
        out |= {f"strike_rate_{p}": _per(c(f"runs_{p}"), n(f"balls_{p}"), 100.0), f"balls_share_{p}": _per(c(f"balls_{p}"), n("balls")), f"runs_{p}": c(f"runs_{p}"), f"boundary_percentage_{p}": _per(c(f"boundaries_{p}"), n(f"balls_{p}"))}
    return out


def bowling(before: str = "", phases: tuple[str, ...] = PHASES) -> dict[str, Column]:
    """Nine rates and five for each phase, from columns runs, balls, wickets, dots, innings, wides,
    noballs, false_shots, control_balls, aerial_conceded, elev_balls, and of each phase runs,
    balls, wickets and boundaries_conceded."""
    c, n = (lambda x: F.col(before + x)), (lambda x: before + x)
    out = {
        "economy": _per(c("runs"), n("balls"), 6.0), "average": _per(c("runs"), n("wickets")), "strike_rate": _per(c("balls"), n("wickets")),
        "dot_ball_percentage": _per(c("dots"), n("balls")), "wickets_per_innings": _per(c("wickets"), n("innings")), "extras_per_ball": _per(c("wides") + c("noballs"), n("balls")),
        "false_shot_percentage": _per(c("false_shots"), n("control_balls")), "control_conceded_percentage": _per(c("control_balls") - c("false_shots"), n("control_balls")), "aerial_conceded_percentage": _per(c("aerial_conceded"), n("elev_balls")),
    }
    for p in phases:
        out |= {f"economy_{p}": _per(c(f"runs_{p}"), n(f"balls_{p}"), 6.0), f"balls_share_{p}": _per(c(f"balls_{p}"), n("balls")), f"strike_rate_{p}": _per(c(f"balls_{p}"), n(f"wickets_{p}")), f"runs_{p}": c(f"runs_{p}"), f"boundary_percentage_{p}": _per(c(f"boundaries_conceded_{p}"), n(f"balls_{p}"))}
    return out
