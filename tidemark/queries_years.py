"""The catalogue, fourth part: one person for a player in all years, and audits by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import replay
from tidemark.plans import across_years, audits
from tidemark.plans.auction import Rules
from tidemark.queries import query
from tidemark.queries_plans import REPLAY, _auction, _order, _replay

# customers as players, order years as seasons, suppliers as people

YEARS = """WITH r AS (SELECT o_custkey AS player_id, year(o_orderdate)::INT AS season, CASE WHEN o_orderkey % 8 = 0 THEN 'S' || CASE WHEN o_custkey % 7 = 0 AND year(o_orderdate) % 2 = 1 THEN o_custkey % 89 ELSE o_custkey % 97 END END AS person_id,
      CASE WHEN o_orderkey % 8 = 0 THEN 'exact' WHEN o_orderkey % 9 = 0 THEN 'ambiguous' ELSE 'unresolved' END AS method FROM orders),
    w AS (SELECT c_custkey AS player_id, CASE WHEN c_custkey % 13 = 0 THEN 'S' || c_custkey % 5 END AS p, c_custkey % 11 = 0 AS b FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 13 = 0),
    h AS (SELECT c_custkey AS player_id, 'S' || c_custkey % 200 AS c FROM customer WHERE c_custkey % 10 IN (3, 4)),
    s AS (SELECT 'S' || s_suppkey AS c FROM supplier),
    m AS (SELECT r.player_id, any_value(w.b) AS b, any_value(w.p) AS p, any_value(h.c) AS hc, any_value(s.c) AS c, list_sort(coalesce(list(DISTINCT person_id) FILTER (person_id IS NOT NULL), [])) AS ps, arg_min(method, {'s': season, 'm': method}) FILTER (person_id IS NOT NULL) AS me, bool_or(method = 'ambiguous') AS am
      FROM r LEFT JOIN w USING (player_id) LEFT JOIN h USING (player_id) LEFT JOIN s ON s.c = h.c {} GROUP BY r.player_id),
    i AS (SELECT player_id, CASE WHEN b THEN NULL WHEN p IS NOT NULL THEN p WHEN c IS NOT NULL THEN c WHEN len(ps) = 1 THEN ps[1] END AS person_id, CASE WHEN b THEN 'blocked' WHEN p IS NOT NULL THEN 'override' WHEN c IS NOT NULL THEN 'cache' WHEN len(ps) = 1 THEN me
      WHEN len(ps) > 1 THEN 'cross_year_conflict' WHEN am THEN 'ambiguous' ELSE 'unresolved' END AS method, ps, hc IS NOT NULL AND c IS NULL AS cache_missed FROM m)"""


def _years(t, before: int | None = None):
    k, c, year = F.col("o_orderkey"), F.col("o_custkey"), F.year("o_orderdate")
    s = lambda x: F.concat(F.lit("S"), x.cast("string"))
    told = s(F.when((c % 7 == 0) & (year % 2 == 1), c % 89).otherwise(c % 97))
    rows = t("orders").select(c.alias("player_id"), year.alias("season"), F.when(k % 8 == 0, told).alias("person_id"), F.when(k % 8 == 0, "exact").when(k % 9 == 0, "ambiguous").otherwise("unresolved").alias("method"))
    p = F.col("c_custkey")
    ruled = t("customer").select(p.alias("player_id"), s(p % 5).alias("person_id"), F.explode(F.array(F.when(p % 11 == 0, "block"), F.when(p % 13 == 0, "map"))).alias("action")).where("action is not null")
    cached = t("customer").where(p % 10 >= 3).where(p % 10 <= 4)
    cached = cached.select(p.alias("player_id"), s(p % 20).alias("person_id"), F.lit(1).alias("version")).union(cached.select(p, s(p % 200), F.lit(2)))
    people = t("supplier").select(s(F.col("s_suppkey")).alias("person_id"))
    return across_years.identity_map(rows.where(F.col("season") < before) if before else rows, ruled, cached, people)


@query(YEARS.replace("{}", "") + " SELECT player_id, person_id, method, array_to_string(ps, ',') AS persons, cache_missed FROM i")
def q109_identity_map(t):
    return _years(t).withColumn("persons", F.array_join("persons", ","))


@query(YEARS.replace("{}", "").replace("WITH ", "WITH y AS (" + YEARS.replace("{}", "WHERE season < 1998") + " SELECT player_id, person_id, method FROM i), ", 1) + """
    SELECT player_id, i.person_id, i.method, CASE WHEN y.player_id IS NOT NULL AND y.person_id IS NOT DISTINCT FROM i.person_id THEN 1 ELSE 2 END::INT AS version,
      CASE WHEN y.player_id IS NULL THEN 'new' WHEN y.person_id IS NOT DISTINCT FROM i.person_id THEN 'same' WHEN y.person_id IS NULL THEN 'found' WHEN i.person_id IS NULL THEN 'lost' ELSE 'moved' END AS change FROM i LEFT JOIN y USING (player_id)""")
def q110_identity_versions(t):
    first = across_years.advanced(None, _years(t, 1998), 1)
    return across_years.advanced(first, _years(t), 2)


# parts as players and as people, their brands as teams

SPELLED = """WITH n AS (SELECT p_partkey AS k, p_brand AS team, p_size % 10 AS season, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name[1]) || ' ' || string_split(p_name, ' ')[2] ELSE p_name END AS name FROM part),
    l AS (SELECT k AS player, season, team FROM n WHERE k % 4 = 0 UNION SELECT k, (season + 1) % 10, team FROM n WHERE k % 4 = 0),
    s AS (SELECT k AS person, season, team, lower(name) AS b FROM n WHERE k % 4 > 1),
    p AS (SELECT DISTINCT player, person, a, b FROM l JOIN s USING (season, team) JOIN (SELECT k AS player, lower(name) AS a FROM n) USING (player)),
    q AS (SELECT player, person, CASE WHEN string_split(a, ' ')[1] = string_split(b, ' ')[1] THEN 2 WHEN string_split(a, ' ')[2] = string_split(b, ' ')[2] AND a[1] = b[1] THEN 1 ELSE 0 END AS score FROM p),
    f AS (SELECT player, count(*) AS n_left, count_if(score > 0) AS n_named FROM q GROUP BY player),
    z AS (SELECT *, rank() OVER (PARTITION BY player ORDER BY score DESC) AS mine, rank() OVER (PARTITION BY person ORDER BY score DESC) AS theirs FROM q WHERE score > 0),
    c AS (SELECT person, count(*) AS claims FROM z WHERE theirs = 1 GROUP BY person),
    o AS (SELECT player, count(*) AS n, max(score) AS score, min(person) AS person, bool_and(theirs = 1 AND claims = 1) AS sole FROM z JOIN c USING (person) WHERE mine = 1 GROUP BY player)
    SELECT k AS player, CASE WHEN n_left IS NULL THEN 'none_left' WHEN n IS NULL THEN 'unlike' WHEN n > 1 THEN 'tie' WHEN sole THEN 'proposed' ELSE 'contested' END AS status, CASE WHEN n = 1 THEN person END AS person, coalesce(score, 0)::BIGINT AS score,
      coalesce(n_left, 0)::BIGINT AS n_left, coalesce(n_named, 0)::BIGINT AS n_named FROM (SELECT k FROM n WHERE k % 4 = 0) LEFT JOIN f ON f.player = k LEFT JOIN o ON o.player = k"""


@query(SPELLED)
def q111_proposals(t):
    k, word = F.col("p_partkey"), F.split("p_name", " ")
    name = F.when(k % 3 == 0, F.concat(F.upper(F.substring("p_name", 1, 1)), F.lit(" "), word[1])).otherwise(F.col("p_name"))
    n = t("part").select(k.alias("k"), F.col("p_brand").alias("team"), (F.col("p_size") % 10).alias("season"), name.alias("name"))
    players = n.where("k % 4 = 0").withColumnRenamed("k", "player")
    listed = players.select("player", "team", F.explode(F.array(F.col("season"), (F.col("season") + 1) % 10)).alias("season"))
    people = n.where("k % 4 > 0").withColumnRenamed("k", "person")
    return across_years.proposals(players.select("player"), players.select("player", F.col("name").alias("spelling")), listed, people.select("season", "team", "person"), n.where("k % 4 = 1").select(F.col("k").alias("person")), people.select("person", "name"))


@query(YEARS.replace("{}", "") + """, a AS (SELECT player_id, unnest(ps) AS person FROM i WHERE method = 'cross_year_conflict'),
    b AS (SELECT year(o_orderdate)::INT AS season, l_orderkey, l_linenumber, l_returnflag AS bt, l_linestatus AS bo, CASE WHEN l_suppkey % 3 > 0 THEN 'S' || l_suppkey END AS s, 'S' || (l_partkey % 40 + 60) AS n, CASE WHEN l_quantity < 25 THEN 'S' || (l_partkey % 50) END AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey % 2 = 0),
    u AS (SELECT s AS person, season, bt AS team, 1 AS ball, 1 AS role FROM b UNION ALL SELECT n, season, NULL, (n IS DISTINCT FROM s)::INT, 0 FROM b UNION ALL SELECT w, season, bo, (w IS DISTINCT FROM s AND w IS DISTINCT FROM n)::INT, 1 FROM b),
    v AS (SELECT person, sum(ball)::BIGINT AS balls, min(season) AS first_season, max(season) AS last_season FROM u GROUP BY person),
    x AS (SELECT person, string_agg(team || ':' || n, '|' ORDER BY n DESC, team) AS teams FROM (SELECT person, team, sum(role)::BIGINT AS n FROM u WHERE role > 0 GROUP BY ALL) GROUP BY person),
    e AS (SELECT player_id, person, coalesce(balls, 0) AS balls, first_season, last_season, teams, count_if(coalesce(balls, 0) > 0) OVER (PARTITION BY player_id) AS c FROM a LEFT JOIN v USING (person) LEFT JOIN x USING (person))
    SELECT player_id, person, balls, first_season, last_season, teams, CASE WHEN c <> 1 THEN 'needs_human' WHEN balls > 0 THEN 'proposed' ELSE 'rival' END AS verdict FROM e""")
def q112_explained_conflicts(t):
    s = lambda x: F.concat(F.lit("S"), x.cast("string"))
    balls = t("lineitem").where("l_partkey % 2 = 0").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("season")), "l_orderkey")
    deliveries = balls.select("season", F.col("l_returnflag").alias("batting_team"), F.col("l_linestatus").alias("bowling_team"), F.when(F.col("l_suppkey") % 3 > 0, s(F.col("l_suppkey"))).alias("striker_id"), s(F.col("l_partkey") % 40 + 60).alias("non_striker_id"), F.when(F.col("l_quantity") < 25, s(F.col("l_partkey") % 50)).alias("bowler_id"))
    return across_years.explained(_years(t).where("method = 'cross_year_conflict'"), deliveries)


# audits by name, of the auctions that line items make

_TOLD = """SELECT auction, k[1] AS "check", CASE WHEN k[2] = 'info' THEN 'info' WHEN bad THEN k[2] ELSE 'ok' END AS severity, value, example FROM (SELECT auction, unnest({names}) AS k, unnest({bad}) AS bad, unnest({value})::DOUBLE AS value, unnest({example}) AS example FROM {source})"""


def _told(source: str, checks: list[tuple[str, str, str, str, str]]) -> str:
    """SQL of findings: name, severity, value, whether it is bad (over 0 unless told), example."""
    listed = lambda xs: f"[{', '.join(xs)}]"
    filled = {"names": listed(f"['{n}', '{s}']" for n, s, *_ in checks), "value": listed(f"coalesce(({v})::DOUBLE, 0)" for _, _, v, *_ in checks), "bad": listed(f"coalesce({b or f'({v}) > 0'}, false)" for _, _, v, b, _ in checks), "example": listed(f"{e or 'NULL::VARCHAR'}" for *_, e in checks)}
    return _TOLD.format(source=source, **filled)


def _row(name, severity, condition):
    return name, severity, f"sum(({condition})::INT)", "", f"min(CASE WHEN {condition} THEN shown END)"


def _grouped(checks, source):
    """The checks as aggregates of one grouped select, and then the select of findings over it."""
    inner = ", ".join(f"coalesce({v}, 0) AS v{i}, {b or f'({v}) > 0'} AS b{i}, {e or 'NULL::VARCHAR'} AS e{i}" for i, (_, _, v, b, e) in enumerate(checks))
    return f"(SELECT auction, {inner} FROM {source} GROUP BY auction)", [(n, s, f"v{i}", f"b{i}", f"e{i}") for i, (n, s, *_) in enumerate(checks)]


_W = "coalesce(observation_type <> 'unknown', true)"
_TR = f""", tr AS (SELECT s.auction, s.player, s.team, s.player || '|' || s.team AS shown, s.status, s.price, s.overseas, s.won AS winner, x.observation_type, x.lower, x.upper, s.purse_left, s.lot, s.players_bought, s.overseas_bought, s.player % 6 = 0 AS blank, s.player % 5 = 0 AS novice FROM s JOIN x USING (auction, player, team)),
    ts AS (SELECT auction, count(*) FILTER (c < 0.5 * m) AS few FROM (SELECT auction, c, median(c) OVER (PARTITION BY auction) AS m FROM (SELECT auction, team, count(*) AS c FROM tr GROUP BY ALL)) GROUP BY auction) """
_DEAR = "max(CASE WHEN blank AND winner THEN price END) > 200"
_VERIFY = [
    ("rows vs players x teams", "error", "count(*)", "count(*) > count(DISTINCT player) * count(DISTINCT team)", ""), ("duplicate (player, team)", "error", "0", "", ""), ("teams this year", "info", "count(DISTINCT team)", "", ""),
    ("teams with unusually few rows", "warn", "any_value(few)", "", ""), ("observation_type mix", "info", "count(DISTINCT observation_type)", "", ""),
    ("winner rows vs sold players", "error", "sum(winner::INT)", "sum(winner::INT) <> count(DISTINCT CASE WHEN status IN ('SOLD', 'RTM') THEN player END)", ""),
    _row("unusable intervals", "error", f"{_W} AND (lower IS NULL OR upper IS NULL OR upper <= lower)"), _row("fabricated-width intervals", "error", f"{_W} AND upper / lower >= 0 AND upper / lower < exp(1e-3)"),
    _row("tight but plausible intervals", "info", f"{_W} AND upper / lower >= exp(1e-3) AND upper / lower < exp(2e-2)"), _row("negative purse rows", "error", "purse_left < 0"), _row("NaN purse rows", "error", "purse_left IS NULL"),
    ("players with no feature row at all", "warn", "count(DISTINCT CASE WHEN blank THEN player END)", "", "min(CASE WHEN blank THEN player::VARCHAR END)"),
    ("EXPENSIVE players with no features", "error", f"CASE WHEN {_DEAR} THEN least(count(DISTINCT CASE WHEN blank AND winner THEN player END), 5) ELSE 0 END", _DEAR, ""),
    ("players with zero career history", "info", "count(DISTINCT CASE WHEN novice THEN player END)", "", "min(CASE WHEN novice THEN player::VARCHAR END)"),
]


@query(REPLAY + _TR + _told(*_grouped(_VERIFY, "tr JOIN ts USING (auction)")))
def q113_verified_training(t):
    state, k = _replay(t).state, F.col("player")
    rows = state.withColumns({"f1": F.when(k % 6 > 0, k * 1.0), "f2": F.when(k % 3 > 0, k * 2.0), "has_history": (k % 5 > 0).cast("int")})
    return audits.verified(rows, ["f1", "f2"])


_LOTS = """, ld AS (SELECT player, list(DISTINCT team) AS teams, arg_min(team, {'a': -amt, 'n': no}) AS top FROM b GROUP BY player),
    lt AS (SELECT r.*, r.player || '|' || r.buyer AS shown, teams, top, status IN ('SOLD', 'RTM') AS sold, coalesce(list_contains(teams, buyer), false) AS present, count_if(status IN ('SOLD', 'RTM') AND price > 500) OVER (PARTITION BY auction, buyer, price) AS same,
      sum(CASE WHEN status <> 'UNSOLD' THEN coalesce(price, 0) END) OVER (PARTITION BY auction, buyer ORDER BY day, player) AS fo, sum(CASE WHEN status <> 'UNSOLD' THEN coalesce(price, 0) END) OVER (PARTITION BY auction, buyer ORDER BY day DESC, player DESC) AS ba FROM r LEFT JOIN ld USING (player)) """
_SUSPECT = "greatest(0, max(CASE WHEN status <> 'UNSOLD' THEN fo END) - 2e7) > greatest(0, max(CASE WHEN status <> 'UNSOLD' THEN ba END) - 2e7) + 0.01"
_OF_LOTS = [
    ("auction order direction", "error", f"({_SUSPECT})::INT", _SUSPECT, ""), _row("winner absent from bid ladder", "error", "sold AND top IS NOT NULL AND NOT present"), _row("winner is not the top bidder", "error", "sold AND present AND top <> buyer"),
    _row("sold with no bid ladder at all", "warn", "sold AND top IS NULL"), _row("retained players producing zero training rows", "warn", "status = 'RETAINED'"), _row("unsold players who received bids", "warn", "status = 'UNSOLD' AND top IS NOT NULL"),
    _row("sold below base price", "error", "coalesce(sold AND price < base, false)"), _row("sold with no parseable price", "error", "sold AND price IS NULL"), _row("same team, same high price, multiple players", "warn", "coalesce(sold AND price > 500 AND same > 1, false)"),
]


@query(REPLAY + _LOTS + _told(*_grouped(_OF_LOTS, "lt")))
def q114_audited_lots(t):
    roster, bids, _ = _auction(t)
    return audits.audited_lots(roster, bids, Rules(2e7), _order())


_FINAL = """, fs AS (SELECT auction, team, arg_max(purse_left - CASE WHEN winner THEN coalesce(price, 0) ELSE 0 END, lot) AS p, arg_max(25 - players_bought - winner::INT, lot) AS sl, arg_max(overseas_bought + (winner AND overseas)::INT, lot) AS ov FROM tr GROUP BY ALL),
    fe AS (SELECT auction, count_if(p < 0) AS np, min(CASE WHEN p < 0 THEN team END) AS ep, count_if(sl < 0) AS ns, min(CASE WHEN sl < 0 THEN team END) AS es, count_if(ov > 8) AS no, min(CASE WHEN ov > 8 THEN team END) AS eo FROM fs GROUP BY auction) """
_OF_REPLAY = [
    _row("interval rows with no upper bound", "error", "observation_type = 'interval' AND upper IS NULL"), _row("interval rows with upper <= lower", "error", "coalesce(observation_type = 'interval' AND upper <= lower, false)"), _row("rows of unknown observation", "info", "observation_type = 'unknown'"),
    ("teams finishing with negative purse", "error", "any_value(np)", "", "any_value(ep)"), ("teams exceeding squad size", "warn", "any_value(ns)", "", "any_value(es)"), ("teams exceeding overseas limit", "warn", "any_value(no)", "", "any_value(eo)"),
    ("duplicate (player, team) training rows", "error", "0", "", ""), ("row count == players x teams", "error", "(count(*) <> count(DISTINCT player) * count(DISTINCT team))::INT", "", ""), ("teams discovered", "warn", "count(DISTINCT team)", "", ""),
]


@query(REPLAY + _TR + _FINAL + _told(*_grouped(_OF_REPLAY, "tr JOIN fe USING (auction)")))
def q115_audited_replay(t):
    return audits.audited_replay(_replay(t))


@query("""WITH p AS (SELECT p_size % 7 = 0 AS a, p_retailprice > 900 AS b FROM part) SELECT unnest(['auction_state columns duplicated inside team_state', 'outcome-derived column inside player block', 'outcome-derived column inside team_state block', 'outcome-derived column inside auction_state block', 'context promoted into the player block', 'constant player features', 'rows with no career at all']) AS "check",
    unnest(['error', 'error', 'ok', 'error', 'warn', 'warn', CASE WHEN count_if(a AND b) > 0 THEN 'warn' ELSE 'ok' END]) AS severity, unnest([1, 1, 0, 1, 1, 2, count_if(a AND b)])::DOUBLE AS value, unnest(['seats', 'winner', NULL, 'upper', 'ctx_basePrice', 'never, same', NULL]) AS example FROM p""")
def q116_audited_blocks(t):
    b = F.col("p_retailprice") > 900
    rows = t("part").select(F.when(F.col("p_size") % 7 > 0, F.col("p_size")).alias("runs"), F.when(~b, 1).alias("balls"), F.when(~(b & (F.col("p_size") % 7 == 0)), 5).alias("winner"), F.when(~(b & (F.col("p_size") % 7 == 0)), 1.5).alias("rate"), F.lit(3).alias("ctx_basePrice"), F.lit(None).cast("int").alias("never"), F.lit("x").alias("same_"))
    rows = rows.withColumns({"ctx_basePrice": F.col("runs"), "same": F.lit(None).cast("string")}).drop("same_")
    return audits.audited_blocks(rows, ["runs", "balls", "winner", "rate", "ctx_basePrice", "never", "same"], ["seats", "purse"], ["seats", "upper"])


@query("""WITH o AS (SELECT o_orderpriority AS team, o_totalprice AS p, sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS s FROM orders)
    SELECT team, round(max(greatest(s - 2e8, 0)), 2) AS overdraft, count_if(s > 2e8)::BIGINT AS overdrawn FROM o GROUP BY team""")
def q117_overdrafts(t):
    done = replay.overdrafts(t("orders").withColumnRenamed("o_orderpriority", "team"), ["team"], [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_totalprice"), 2e8)
    return done.withColumn("overdraft", F.round("overdraft", 2))
