"""Vocabularies of roles and shots as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roles, and words of how a shot was controlled and made.
ROLES = ("BATTER", "BOWLER", "ALL-ROUNDER", "WICKETKEEPER")
CONTROLLED = ("under control", "well timed")
FALSE_SHOT = ("mis-timed", "miss", "edge", "hit pad")
FALSE_SHOT_STRICT = ("mis-timed", "miss", "edge")
NO_CONTACT = ("miss", "hit pad")
LEFT_ALONE = "leave"
AERIAL = "in the air"


def canonical_role(role: Column, strict: bool = True) -> Column:
    """One of ROLES from any spelling; an unknown one fails the query, or is null if not strict.

    A compound that names an all-rounder is one, a keeper comes before a bowler and he before a
    batter.
    """
    plain = F.upper(F.trim(role))
    joined = F.regexp_replace(plain, "[- ]", "")
    has = lambda *words: F.greatest(*(F.instr(joined, w) for w in words), F.lit(0)) > 0
    other = F.raise_error(F.concat(F.lit("no role is known as "), F.coalesce(role, F.lit("null")))).cast("string") if strict else F.lit(None).cast("string")
    return F.when(plain.isin(*ROLES), plain).when(has("ALLROUNDER"), ROLES[2]).when(has("WK", "WICKETKEEPER"), ROLES[3]).when(has("BOWL"), ROLES[1]).when(has("BAT"), ROLES[0]).otherwise(other)


def shot_flags(control: Column, shot: Column, elevation: Column, binary: Column) -> dict[str, Column]:
    """Flags of a shot as doubles, null where nothing is told; and which source the wide reading of control has.

    Contact is unknown only where neither control nor shot is told; a shot is aerial or not only
    where there was contact.  The wide reading takes the words first and the yes-or-no feed else.
    """
    yes = lambda c: c.cast("double")
    told = lambda words: F.when(control.isNotNull(), yes(control.isin(*words)))
    apart = F.coalesce(control.isin(*NO_CONTACT), F.lit(False)) | F.coalesce(shot == LEFT_ALONE, F.lit(False))
    contact = F.when(control.isNotNull() | shot.isNotNull(), yes(~apart))
    aerial = F.when(elevation.isNotNull() & (contact == 1.0), yes(elevation == AERIAL))
    controlled = told(CONTROLLED)
    return {
        "is_controlled": controlled, "is_false_shot": told(FALSE_SHOT), "is_false_shot_strict": told(FALSE_SHOT_STRICT), "made_contact": contact, "is_aerial": aerial,
        "is_controlled_wide": F.coalesce(controlled, binary.cast("double")), "control_source": F.when(controlled.isNotNull(), "descriptive").when(binary.isNotNull(), "binary"),
        "has_shot_control": controlled.isNotNull().cast("int"), "has_control": (controlled.isNotNull() | binary.isNotNull()).cast("int"), "has_elevation": aerial.isNotNull().cast("int"),
    }
