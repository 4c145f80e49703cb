"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells of source, language and topic.  The cells' token weights are
scaled to the target shares of each dimension in turn, round after round; a cell's weight
over its tokens is the rate at which its documents are drawn.  Where a document may be drawn a
limited number of times, marginals that can be met together are told from an unbounded fit;
then a ladder of volumes is fitted at once, each scaling followed by a projection onto the limit,
and the largest volume whose marginals hold is taken.  The number of jobs is the same for any
table.  Fitting works on cells, which are few however many documents there are; all of it is SQL
functions.  Up to ``FEW`` cells are arrays of one row, whose rounds are one fold; more are rows
under windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import _kit

DIMENSIONS = ("source", "lang", "topic")
#: How far a bounded fit's marginals may be from their targets, volumes tried at once, and how often they are narrowed.
TOLERANCE, LADDER, NARROWED = 0.002, 16, 2
#: The value that pooled ones become.
POOL = "(rare)"
#: So many cells at most are fitted as arrays of one row.  Two dimensions of values of a hundredth each
#: and six topics stay below it.
FEW = 1 << 16


def topic_of(text: Column) -> Column:
    """A topic from a text's form, where a table names none: table, figures, shouting, listing or prose."""
    size = F.length(text)
    without = lambda chars: size - F.length(F.translate(text, chars, ""))
    return (
        F.when(F.instr(text, " | ") > 0, "table")
        .when(without("0123456789") * 20 > size, "figures")
        .when(without("ABCDEFGHIJKLMNOPQRSTUVWXYZ") * 3 > size, "shouting")
        .when(without("\n") * 80 > size, "listing")
        .otherwise("prose")
    )


def measured(docs: DataFrame, id_col: str, text_col: str, dims: dict[str, Column], carried: list[str] | None = None, tokens: Column | None = None) -> DataFrame:
    """(id, tokens, a column for each dimension, a struct of those carried).

    Where tokens aren't given they are taken to be a quarter of a text's bytes, rounded up.
    """
    guess = F.expr(f"(octet_length(coalesce(cast(`{text_col}` as string), '')) + 3) div 4")
    tokens = F.coalesce((guess if tokens is None else tokens).cast("long"), F.lit(0).cast("long"))
    return docs.select(F.col(id_col).alias("id"), tokens.alias("tokens"), *(F.coalesce(c.cast("string"), F.lit("")).alias(name) for name, c in dims.items()), *([F.struct(*(F.col(f"`{c}`") for c in carried)).alias("carried")] if carried else []))


def tempered(cells: DataFrame, name: str, power: float) -> DataFrame:
    """(value, share): the dimension's shares of tokens to a power, which evens out large and small values."""
    raised = cells.groupBy(name).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("r"))
    return raised.crossJoin(F.broadcast(raised.agg(F.sum("r").alias("all")))).select(F.col(name).alias("value"), (F.col("r") / F.col("all")).alias("share"))  # one row of totals


def pooled(cells: DataFrame, names: list[str], least: float) -> DataFrame:
    """cells with a column _name for each dimension: its value, or POOL for values under a share ``least`` of the tokens."""
    base = cells
    for name in names:
        sums = base.groupBy(name).agg(F.sum("tokens").alias("_own"))
        total = sums.agg(F.sum("_own").alias("_total"))
        value = F.when(F.col("_own") < F.col("_total") * least, POOL).otherwise(F.col(name))
        cells = cells.join(sums.crossJoin(F.broadcast(total)).select(name, value.alias(f"_{name}")), name)  # one row of totals
    return cells


def _with_shares(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """cells with the target share of their value in each dimension, and the total of tokens.

    Shares count among the values that cells with tokens have: what a target gives to others is
    dealt over these in proportion.
    """
    base = cells
    for name, target in targets.items():
        share = target.select(F.col("value").alias(name), F.col("share").cast("double").alias("_share"))
        there = base.groupBy(name).agg(F.sum("tokens").alias("_own")).where("_own > 0").join(share, name)
        all_ = there.agg(F.sum("_share").alias("_all"))
        told = there.crossJoin(F.broadcast(all_)).select(name, F.when(F.col("_all") > 0, F.col("_share") / F.col("_all")).otherwise(0.0).alias(f"share_{name}"))  # one row of totals
        cells = cells.join(told, name, "left").fillna(0.0, [f"share_{name}"])
    total = base.agg(F.sum("tokens").cast("double").alias("total"))
    return cells.crossJoin(F.broadcast(total))  # one row of totals


def _rounds(fitted: DataFrame, names: list[str], rounds: int, most: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Weights scaled to each dimension's shares of the volume in turn, and held to the limit."""
    for _ in range(rounds):
        for name in names:
            now = F.sum("weight").over(Window.partitionBy(*by, name))
            weight = F.when(now > 0, F.col("weight") * F.col(f"share_{name}") * F.col("volume") / now).otherwise(0.0)
            fitted = fitted.withColumn("weight", weight if most is None else F.least(weight, F.col("tokens") * F.lit(float(most))))
    return fitted


def _placed(cells: DataFrame, names: list[str]) -> DataFrame:
    """cells with their place from 0 on, and the number from 0 on of their value in each dimension."""
    one = cells.coalesce(1)  # so that windows shuffle nothing
    return one.withColumns({"_place": F.row_number().over(Window.orderBy(*names)) - 1, **{f"_code_{name}": F.dense_rank().over(Window.orderBy(name)) - 1 for name in names}})


def _groups(placed: DataFrame, names: list[str]) -> DataFrame:
    """One row, _groups: for each dimension an array by its values of the places of their cells."""
    by_value = placed.coalesce(1).select("_place", F.posexplode(F.array(*(f"_code_{name}" for name in names))).alias("dim", "code"))
    by_value = by_value.groupBy("dim", "code").agg(F.sort_array(F.collect_list("_place")).alias("places"))
    by_dim = by_value.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("code", "places"))).alias("values"))
    return by_dim.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "values"))), lambda d: d["values"]["places"]).alias("_groups"))


def _let(value: Column, body) -> Column:
    """body of the value, which is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _folded(names: list[str], rounds: int, most: float | None) -> Column:
    """The weights that ``_rounds`` comes to, of a row of _cells, _groups and volume: a fold over the dimensions in turn."""
    cells, groups = F.col("_cells"), F.col("_groups")
    told = {
        "codes": F.array(*(cells[f"_code_{name}"] for name in names)),
        "shares": F.array(*(cells[f"share_{name}"] for name in names)),
        "limits": F.transform(cells["tokens"], lambda n: n * F.lit(float("inf") if most is None else float(most))),
    }

    def turn(weights: Column, dim: Column, told: Column) -> Column:
        def scaled(weight: Column, place: Column, sums: Column) -> Column:
            now = sums[told["codes"][dim][place]]
            weight = F.when(now > 0, weight * told["shares"][dim][place] * F.col("volume") / now).otherwise(0.0)
            return weight if most is None else F.least(weight, told["limits"][place])

        sums = F.transform(groups[dim], lambda places: F.aggregate(places, F.lit(0.0), lambda total, place: total + weights[place]))
        return _let(sums, lambda sums: F.transform(weights, lambda weight, place: scaled(weight, place, sums)))

    turns = F.flatten(F.array_repeat(F.array(*(F.lit(k) for k in range(len(names)))), rounds))
    begun = F.transform(cells["weight"], lambda weight: F.coalesce(weight, F.lit(0.0)))
    return _let(F.struct(*(c.alias(k) for k, c in told.items())), lambda told: F.aggregate(turns, begun, lambda weights, dim: turn(weights, dim, told)))


def _fitted(fitted: DataFrame, names: list[str], rounds: int, groups: DataFrame | None, most: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``_rounds``, written: with groups as one fold, else in plans of ten.

    A plan of windows grows with its rounds, and the driver's memory with the plan; the fold is one expression.
    What one plan wrote is deleted once the next has read it.
    """
    if groups is not None:
        rows = fitted.groupBy(*by, "volume").agg(F.sort_array(F.collect_list(F.struct("_place", *(c for c in fitted.columns if c != "_place")))).alias("_cells"))
        rows = rows.crossJoin(F.broadcast(groups)).withColumn("_weights", _folded(names, rounds, most))  # one row of places
        done = rows.select(F.inline(F.zip_with("_cells", "_weights", lambda cell, weight: cell.withField("weight", weight))))
        return _kit.written(done.select(*fitted.columns), "cells")
    placed = lambda x: x.repartition(*by) if by else x.coalesce(1)  # noqa: E731  so that windows shuffle nothing
    before = None
    for done in range(0, rounds, 10):
        fitted = _kit.written(_rounds(placed(fitted), names, min(10, rounds - done), most, by), "cells")
        if before is not None:
            _kit.dropped(before)
        before = fitted
    return fitted


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 20, keep: float = 1.0, most: float | None = None) -> DataFrame:
    """cells with rate, a cell's fitted weight over its tokens; the weights' sum is keep times that of the tokens.

    targets: (value, share) for each dimension.  A value without a target gets no weight, a cell
    without tokens a rate of 0; shares of values that no cell with tokens has go to the others in proportion.
    Targets that contradict each other, as where each source has a language of its own, are met
    in turn: the last dimension's holds exactly, the others' as nearly as the rounds bring them.
    With ``most``, no rate passes it.  The sum is then the largest of a ladder of volumes, narrowed
    ``NARROWED`` times, at which all marginals are within ``TOLERANCE`` of their targets, or, where those
    contradict each other, of the marginals that the unbounded fit comes to.  Its lowest rung is that fit
    itself, scaled down until it meets the limit, so there always is one.
    Cells are as many as there are combinations of values; those of a volume are one row of arrays
    or, over ``FEW``, one partition, so that rounds shuffle nothing.
    """
    names, total = list(targets), F.col("total")
    start = _kit.written(_placed(_with_shares(cells, targets), names), "start")
    groups = _kit.written(_groups(start, names), "groups") if start.count() <= FEW else None
    fitted = _fitted(start.withColumns({"weight": F.col("tokens").cast("double"), "volume": total * keep}), names, rounds, groups)
    if most is not None:
        fitted = _bounded(fitted, names, rounds, float(most), groups)
    return fitted.select(*cells.columns, F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0).alias("rate"))


def _bounded(fitted: DataFrame, names: list[str], rounds: int, most: float, groups: DataFrame | None) -> DataFrame:
    """The unbounded fit with weights of no more than ``most`` times the tokens, at the largest volume that allows its marginals."""
    all_ = F.sum("weight").over(Window.partitionBy())
    fitted = fitted.coalesce(1).withColumn("part", F.when(all_ > 0, F.col("weight") / all_).otherwise(0.0))
    for name in names:  # what can be met together
        fitted = fitted.withColumn(f"share_{name}", F.sum("part").over(Window.partitionBy(name)))
    for name in names:
        fitted = fitted.withColumn(f"_room_{name}", F.when(F.col(f"share_{name}") > 0, F.sum("tokens").over(Window.partitionBy(name)) * most / F.col(f"share_{name}")))
    base = _kit.written(fitted, "unbounded")
    low = F.min(F.when(F.col("part") > 0, F.col("tokens") * most / F.col("part")))
    high = F.min(F.when(F.col("part") > 0, F.least(*(F.col(f"_room_{name}") for name in names), "volume")))
    low, high = base.agg(low, high).first()
    if low is None:  # nothing has weight
        return base
    low, best = min(low, high), None
    high *= 1 - 1e-9  # of the highest rung, too, rounding must leave room
    for _ in range(NARROWED if low < high else 0):
        rungs = F.explode(F.array(*(F.struct(F.lit(k).alias("rung"), F.lit(low * (high / low) ** (k / (LADDER - 1))).alias("volume")) for k in range(LADDER)))).alias("_rung")
        ladder = base.drop("volume").select("*", rungs).select("*", "_rung.rung", "_rung.volume").drop("_rung").withColumn("weight", F.least(F.col("part") * F.col("volume"), F.col("tokens") * most))
        tried = _fitted(ladder, names, rounds, groups, most, ("rung",))
        off = {r["rung"]: (r["off"], r["volume"]) for r in missed(tried, names).collect()}  # a row for each rung
        rung = max((k for k, (o, _) in off.items() if o <= TOLERANCE), default=None)
        if rung is None:
            _kit.dropped(tried)
            break
        if best is not None:
            _kit.dropped(best)
        best, best_rung = tried, rung
        low, high = off[rung][1], off.get(rung + 1, off[rung])[1]
        if low >= high:
            break
    if best is None:
        return base.withColumn("weight", F.col("part") * F.lit(low))
    return best.where(F.col("rung") == best_rung)


def missed(fitted: DataFrame, names: list[str]) -> DataFrame:
    """(rung, volume, off): how far the marginal that is farthest off is from its target, as a share of the volume."""
    off = [F.abs(F.sum("weight").over(Window.partitionBy("rung", name)) / F.col("volume") - F.col(f"share_{name}")) for name in names]
    return fitted.select("rung", "volume", F.greatest(*off, F.lit(0.0)).alias("off")).groupBy("rung", "volume").agg(F.max("off").alias("off"))


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from the id and the seed, the same in every run; a null id draws as the empty one."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None, targets: dict[str, DataFrame] | None = None, power: float = 0.5, keep: float = 1.0, most_copies: float | None = None, rounds: int = 20, seed: int = 7, carried: list[str] | None = None, tokens: Column | None = None, least_share: float = 0.0) -> DataFrame:
    """One row per input row: id_col, tokens, rate, copies (how often the document is drawn; 0 if not).

    The rate is the expected number of copies; its whole part is drawn and the rest by chance.
    The expected weight is keep times the tokens, or, where a document may be drawn no more than
    most_copies times, the largest that still meets all targets (see ``raked``).
    Without targets each dimension's are its shares of tokens to a power, in which values under
    ``least_share`` of the tokens count as one: a rare value would else set the volume for all.  tokens is a column of
    counts; without it they are told from bytes.  A null source, language or topic is a
    value of its own, a null text has no tokens and is not drawn.  Rows that repeat an id draw
    alike, null ids as one id.  Dimensions must not be named id, tokens, rate or carried, else
    an error is raised.  Columns to be carried come along as a struct of that name, others are
    ignored.  Texts may be of any length; an empty table gives an empty result.
    """
    dims = dims or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(_kit.text_of(text_col))}
    if clash := {"id", "tokens", "rate", "carried", "weight", "total", "volume"} & set(dims):
        raise ValueError(f"dimensions can't be named {sorted(clash)}")
    rows = measured(docs, id_col, text_col, dims, carried, tokens)
    if not carried:
        rows = _kit.written(rows, "measured")  # the texts are read once
    cells = _kit.written(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "cells")
    names, given = {name: f"_{name}" if least_share else name for name in dims}, targets or {}
    if least_share:
        every = _kit.written(pooled(cells, [name for name in dims if name not in given], least_share).withColumns({f"_{name}": F.col(name) for name in given}), "pooled")
        cells = _kit.written(every.groupBy(*names.values()).agg(F.sum("tokens").alias("tokens")), "cells")
    told = {own: given[name] if name in given else _kit.written(tempered(cells, own, power), "targets") for name, own in names.items()}
    rates = raked(cells, told, rounds, keep, most_copies).drop("tokens")
    if least_share:
        rates = every.join(rates, list(names.values())).select(*dims, "rate")
    rates = _kit.written(rates, "rates")
    expected = F.col("rate")
    copies = F.when(F.col("tokens") > 0, F.floor(expected) + F.when(draw("id", seed) < expected - F.floor(expected), 1).otherwise(0)).otherwise(0)
    return rows.join(rates, list(dims)).select(F.col("id").alias(id_col), "tokens", "rate", copies.cast("long").alias("copies"), *(["carried"] if carried else []))


def mix_sql(power: float = 0.5, rounds: int = 20, seed: int = 7) -> str:
    """DuckDB SQL of mix() over documents with its own dimensions."""
    without = lambda chars: f"(length(t) - length(translate(t, '{chars}', '')))"
    sql = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents),
        r AS (SELECT doc_id, CAST((strlen(t) + 3) // 4 AS BIGINT) AS tokens, source, lang,
              CASE WHEN contains(t, ' | ') THEN 'table' WHEN {without("0123456789")} * 20 > length(t) THEN 'figures'
                   WHEN {without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")} * 3 > length(t) THEN 'shouting'
                   WHEN (length(t) - length(replace(t, chr(10), ''))) * 80 > length(t) THEN 'listing' ELSE 'prose' END AS topic FROM d),
        c AS (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM r GROUP BY ALL)"""
    for name in DIMENSIONS:
        sql += f""",
        s_{name} AS (SELECT {name}, p / sum(p) OVER () AS share_{name} FROM (SELECT {name}, pow(sum(tokens), {power}) AS p FROM c GROUP BY {name}))"""
    sql += """,
        w AS MATERIALIZED (SELECT c.*, share_source, share_lang, share_topic, CAST(sum(tokens) OVER () AS DOUBLE) AS total, CAST(tokens AS DOUBLE) AS weight
              FROM c JOIN s_source USING (source) JOIN s_lang USING (lang) JOIN s_topic USING (topic))"""
    last, n = "w", 0
    for _ in range(rounds):
        for name in DIMENSIONS:
            n += 1
            sql += f""",
        w{n} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN n > 0 THEN weight * share_{name} * total / n ELSE 0 END AS weight) EXCLUDE (n)
              FROM (SELECT *, sum(weight) OVER (PARTITION BY {name}) AS n FROM {last}))"""
            last = f"w{n}"
    sql += f""",
        f AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS rate FROM {last}),
        x AS (SELECT doc_id, tokens, rate, rate AS e,
              CAST(('0x' || substr(md5('{seed}:' || doc_id), 1, 13))::BIGINT AS DOUBLE) / {1 << 52} AS u FROM r JOIN f USING (source, lang, topic))
        SELECT doc_id, tokens, round(rate, 6) AS rate, CAST(CASE WHEN tokens > 0 THEN floor(e) + (u < e - floor(e))::INT ELSE 0 END AS BIGINT) AS copies FROM x"""
    return sql.replace("* REPLACE (", "* EXCLUDE (n) REPLACE (").replace(") EXCLUDE (n)\n", ")\n")
