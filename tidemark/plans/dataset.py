"""The blocks of a training table: roles as numeric columns, and what is known before an auction as flags.

What a column becomes is decided from its name, its type and one aggregate pass over the table
it comes from; the projection is generated from these verdicts.  Both blocks are the same however
often they are applied, and their widths depend on verdicts alone, not on which rows are there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tidemark.functions import exprs
from tidemark.operators.checks import join_checked

#: Columns that spell a player's identity or repeat the tags, columns told as of the
#: last auction of all, and those that the roster has under another name.
IDENTITY = ("auction_name", "cricbuzz_name", "bbb_player", "date_of_birth", "archetypes", "performance_archetypes", "match_method")
LEAKY = ("first_auction", "last_auction", "n_auctions", "age_at_last_auction")
REPEATED = ("country", "capped_status", "is_overseas")
CONTEXT = ("basePrice", "cappedStatus", "isPlayerOverseas")
#: Spellings of yes and no.
TRUE = ("TRUE", "T", "YES", "Y", "1", "1.0", "CAPPED", "OVERSEAS")
FALSE = ("FALSE", "F", "NO", "N", "0", "0.0", "UNCAPPED", "INDIAN", "DOMESTIC")
MISSING = "role_is_missing"


def column_facts(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """For each column its distinct values, nulls, and the first earlier column that is equal to it in
    every row; one aggregate pass tells them of all columns and pairs."""
    same = [(a, b) for i, b in enumerate(columns) for a in columns[:i] if df.schema[a].dataType == df.schema[b].dataType]
    told = df.agg(
        F.count("*").alias("rows"),
        *(F.countDistinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(columns)),
        *(F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"n{i}") for i, c in enumerate(columns)),
        *(F.count(F.when(~F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`")), 1)).alias(f"u{i}") for i, (a, b) in enumerate(same)),
    ).first()
    facts = {c: {"distinct": told[f"d{i}"], "nulls": told[f"n{i}"], "equals": None} for i, c in enumerate(columns)}
    for i, (a, b) in enumerate(same):
        if told["rows"] and told[f"u{i}"] == 0 and facts[b]["equals"] is None:
            facts[b]["equals"] = a
    return facts


def role_verdicts(roles: DataFrame, key: str, name: str = "playerName", most: int = 24, identity: tuple[str, ...] = IDENTITY, leaky: tuple[str, ...] = LEAKY, repeated: tuple[str, ...] = REPEATED) -> list[tuple[str, str, int]]:
    """(column, verdict, distinct values) of a table of roles.

    identity, leaky, repeated: by name; equal: to an earlier column in every row; too many values:
    a text column of over ``most`` values is a key, not a category; category: other text columns;
    constant: of one value at most, and kept, so that the width stays; number: the rest.
    """
    named = {**dict.fromkeys(identity, "identity"), **dict.fromkeys(leaky, "leaky"), **dict.fromkeys(repeated, "repeated")}
    columns = [c for c in roles.columns if c not in (key, name)]
    open_ = [c for c in columns if c not in named]
    facts = column_facts(roles, open_)
    out = []
    for c in columns:
        if c in named:
            out.append((c, named[c], None))
            continue
        f, plain = facts[c], isinstance(roles.schema[c].dataType, (NumericType, BooleanType))
        out.append((c, "equal" if f["equals"] else "constant" if plain and f["distinct"] <= 1 else "number" if plain else "too many values" if f["distinct"] > most else "category", f["distinct"]))
    return out


def role_table(rows: DataFrame, roles: DataFrame | None, key: str = "playerId", role: str = "role", **choices) -> tuple[DataFrame, list[str], DataFrame]:
    """rows with a block of numeric role columns, their names, and the verdicts (column, verdict, distinct).

    Categories become <column>_<value> flags, numbers and booleans doubles.  A row whose player isn't
    in ``roles``, or is known there by nulls alone, has nulls and ``role_is_missing`` 1; a player listed twice fails the query.
    Without ``roles`` the rows' own role becomes role_<value> flags.  Columns that are there already are
    taken from ``rows`` before, so applying it again changes nothing.
    """
    verdict = "column string, verdict string, distinct long"
    if roles is None:
        values = [r[0] for r in rows.select(role).where(F.col(role).isNotNull()).distinct().orderBy(role).collect()]  # the few roles there are
        made = {f"{role}_{v}": F.coalesce((F.col(role) == v).cast("double"), F.lit(0.0)) for v in values}
        return rows.withColumns(made), list(made), rows.sparkSession.createDataFrame([(role, "category", len(values))], verdict)
    told = role_verdicts(roles, key, **choices)
    columns: dict[str, Column] = {}
    categories = [c for c, v, _ in told if v == "category"]
    # each category has 24 values at most, so the driver gets a few hundred strings
    found = roles.agg(*(F.array_sort(F.collect_set(F.col(f"`{c}`").cast("string"))).alias(f"v{i}") for i, c in enumerate(categories))).first() if categories else ()
    values = dict(zip(categories, found, strict=True))
    for c, v, _ in told:
        if v in ("number", "constant"):
            columns[c] = F.col(f"`{c}`").cast("double")
        elif v == "category":
            columns |= {f"{c}_{x}": F.coalesce((F.col(f"`{c}`").cast("string") == x).cast("double"), F.lit(0.0)) for x in values[c]}
    block = roles.select(key, *(x.alias(n) for n, x in columns.items()))
    joined = join_checked(rows.drop(*columns, MISSING), block, [key])
    nothing = F.lit(True)
    for n in columns:
        nothing = nothing & F.col(f"`{n}`").isNull()
    return joined.withColumn(MISSING, nothing.cast("double")), [*columns, MISSING], rows.sparkSession.createDataFrame(told, verdict)


def as_flag(column: Column) -> Column:
    """1, 0 or null of a spelling of yes or no, in any case and with blanks around it."""
    return exprs.tokens_to_binary(column, TRUE, FALSE).cast("double")


def promoted(df: DataFrame, columns: tuple[str, ...] = CONTEXT, block: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """df with ctx_<column> and ctx_<column>_is_missing of each column it has, and the block's names with these added.

    Numbers stay numbers, others are read as flags.  Each has its flag of what is missing, even where
    nothing is, so that the width depends on no row.  Columns that the block has are left alone.
    """
    block = list(block or [])
    new = [c for c in columns if c in df.columns and f"ctx_{c}" not in block]
    value = {c: F.col(c).cast("double") if isinstance(df.schema[c].dataType, NumericType) else as_flag(F.col(c)) for c in new}
    out = df.withColumns({f"ctx_{c}": v for c, v in value.items()}).withColumns({f"ctx_{c}_is_missing": F.col(f"ctx_{c}").isNull().cast("double") for c in new})
    return out, block + [x for c in new for x in (f"ctx_{c}", f"ctx_{c}_is_missing")]


def promotion_report(df: DataFrame, columns: tuple[str, ...] = CONTEXT, shown: int = 5) -> DataFrame:
    """(column, distinct, missing, constant, unrecognised) of promoted columns in one pass: unrecognised are
    the first spellings that are neither yes nor no."""
    there = [c for c in columns if f"ctx_{c}" in df.columns]
    if not there:
        return df.sparkSession.createDataFrame([], "column string, distinct long, missing long, constant boolean, unrecognised array<string>")
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"ctx_{c}").alias("value"), F.when(F.col(f"ctx_{c}").isNull(), F.upper(F.trim(F.col(c).cast("string")))).alias("token")) for c in there))).alias("s")).select("s.*")
    few = long.groupBy("column", "value", "token").agg(F.count("*").alias("n"))  # what comes up, before it is brought together
    odd = few.where("token is not null").groupBy("column", "token").agg(F.sum("n").alias("n"))
    odd = odd.groupBy("column").agg(F.min("token").alias("_first"), F.slice(F.array_sort(F.collect_set("token")), 1, shown).alias("unrecognised"))
    told = few.groupBy("column").agg(F.countDistinct("value").alias("distinct"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"))
    return told.join(odd.drop("_first"), "column", "left").select("column", "distinct", "missing", (F.col("distinct") <= 1).alias("constant"), F.coalesce("unrecognised", F.array().cast("array<string>")).alias("unrecognised"))
