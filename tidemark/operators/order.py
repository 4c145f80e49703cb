"""The order of lots: which column tells it, whether budgets allow it, and repairs where they don't."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a column's name that hint at an order, the strongest first.
HINTS = ("lot", "order", "set", "seq", "date", "time")


def lot_order(df: DataFrame, position: str, hints: tuple[str, ...] = HINTS, numeric: float = 0.9, distinct: float = 0.9) -> tuple[DataFrame, str]:
    """(df with lot from 0, the column it is from or "reverse_file_order").

    The first column whose name has a hint decides, if more than ``numeric`` of its values are
    numbers or times and ``distinct`` of them differ.  Else lots run against the file's order.
    """
    named = [c for h in hints for c in df.columns if h in c.lower() and c != position]
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("double"), F.col(c).cast("string").try_cast("timestamp").cast("double"))
    named = list(dict.fromkeys(named))
    method, key = "reverse_file_order", F.desc(position)
    if named:
        facts = df.agg(F.count("*").alias("n"), *(x for i, c in enumerate(named) for x in (F.count(number(c)).alias(f"n{i}"), F.countDistinct(number(c)).alias(f"d{i}")))).first()
        for i, c in enumerate(named):
            if facts[f"n{i}"] > numeric * facts["n"] and facts[f"d{i}"] >= distinct * facts["n"]:
                method, key = c, number(c)
                break
    return df.withColumn("lot", F.row_number().over(Window.orderBy(key, F.desc(position))) - 1), method  # one auction's lots


def infeasibility(lots: DataFrame, bids: DataFrame, purse: float) -> DataFrame:
    """(auction, shortfall): what teams' highest bids exceed their purses by, summed over lots.

    lots: auction, lot, team that bought, price.  bids: auction, lot, bidder, amount.
    """
    top = bids.groupBy("auction", "lot", F.col("bidder").alias("team")).agg(F.max("amount").alias("bid"))
    paid = lots.select("auction", "lot", "team", F.coalesce("price", F.lit(0.0)).alias("price")).where("team is not null")
    both = paid.withColumn("bid", F.lit(None).cast("double")).unionByName(top.withColumn("price", F.lit(0.0)))
    before = Window.partitionBy("auction", "team").orderBy("lot").rangeBetween(Window.unboundedPreceding, -1)
    left = F.lit(purse) - F.coalesce(F.sum("price").over(before), F.lit(0.0))
    return both.withColumn("_short", F.greatest(F.col("bid") - left, F.lit(0.0))).groupBy("auction").agg(F.coalesce(F.sum("_short"), F.lit(0.0)).alias("shortfall"))


def _shortfall(order: list[int], lots: pd.DataFrame, top: dict, purse: float) -> float:
    spent, short = {}, 0.0
    for i in order:
        for team, bid in top.get(i, ()):
            short += max(0.0, bid - (purse - spent.get(team, 0.0)))
        team, price = lots.at[i, "team"], lots.at[i, "price"]
        if isinstance(team, str):
            spent[team] = spent.get(team, 0.0) + (price if price == price else 0.0)
    return short


def repaired_order(lots: DataFrame, bids: DataFrame, purse: float, most: int = 6, stale: str | None = None, days: float = 4.0) -> DataFrame:
    """lots with lot renumbered and old_lot, for auctions whose order budgets forbid.

    Suspects are lots that overdraw a team, and those whose time (column ``stale``, in seconds)
    lies over ``days`` from the median.  The ``most`` dearest move, one after another, to the
    latest place without a shortfall, or the first with the least; the order stays if that
    doesn't lower the shortfall.  An auction has some hundred lots and is one group.
    """
    top = bids.groupBy("auction", "lot", "bidder").agg(F.max("amount").alias("amount"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in lots.schema.fields]

    def repair(key, own: pd.DataFrame, offers: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("lot").reset_index(drop=True)
        at = {lot: i for i, lot in enumerate(own["lot"])}
        bid: dict = {}
        for lot, team, amount in zip(offers["lot"], offers["bidder"], offers["amount"], strict=True):
            if lot in at:
                bid.setdefault(at[lot], []).append((team, amount))
        order = list(range(len(own)))
        start = best = _shortfall(order, own, bid, purse)
        if start > 0:
            spent, suspects = {}, set()
            for i in order:
                if any(a > purse - spent.get(t, 0.0) for t, a in bid.get(i, ())):
                    suspects.add(i)
                if isinstance(own.at[i, "team"], str):
                    spent[own.at[i, "team"]] = spent.get(own.at[i, "team"], 0.0) + (own.at[i, "price"] or 0.0)
            if stale:
                suspects |= set(own.index[(own[stale] - own[stale].median()).abs() > days * 86_400])
            moved = list(order)
            for i in sorted(suspects, key=lambda i: (-(own.at[i, "price"] or 0.0), i))[:most]:
                rest = [x for x in moved if x != i]
                stride = max(1, len(rest) // 24)
                score = lambda p: _shortfall([*rest[:p], i, *rest[p:]], own, bid, purse)  # noqa: B023, E731
                coarse = {p: score(p) for p in [*range(0, len(rest) + 1, stride), len(rest)]}
                pick = lambda s: max((p for p in s if s[p] == 0), default=min(s, key=lambda p: (s[p], p)))
                near = pick(coarse)
                fine = coarse | {p: score(p) for p in range(max(0, near - stride), min(len(rest), near + stride) + 1)}
                place = pick(fine)
                moved = [*rest[:place], i, *rest[place:]]
            best = _shortfall(moved, own, bid, purse)
            order = moved if best < start else order
        out = own.loc[order].reset_index(drop=True)
        return out.assign(old_lot=out["lot"], lot=range(len(out)))

    return lots.groupBy("auction").cogroup(top.groupBy("auction")).applyInPandas(repair, ", ".join([*fields, "old_lot " + lots.schema["lot"].dataType.simpleString()]))
