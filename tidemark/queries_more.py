"""The catalogue, second part: joins with guarantees, vocabularies, names, market states, rates and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import exprs, names, normal, rates, vocabulary
from tidemark.operators import asof, checks, features, market
from tidemark.plans import register
from tidemark.queries import query

# order, concatenation, sets


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY p DESC NULLS LAST, o_orderkey) AS place FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS p FROM orders) ORDER BY p DESC NULLS LAST, o_orderkey LIMIT 200""")
def q66_nulls_last_desc(t):
    from pyspark.sql import Window

    p = t("orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("p"))
    top = p.orderBy(F.desc_nulls_last("p"), "o_orderkey").limit(200)  # a top list: its places are numbered after the cut
    return top.select("o_orderkey", F.row_number().over(Window.orderBy(F.desc_nulls_last("p"), "o_orderkey")).cast("long").alias("place"))


@query("""SELECT c_custkey AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier""")
def q67_strict_concat(t):
    a = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    return checks.concat_strict([a, t("supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("k"))])


@query("""SELECT c_nationkey AS n FROM customer UNION SELECT s_nationkey FROM supplier""")
def q68_union_distinct(t):
    return t("customer").select(F.col("c_nationkey").alias("n")).union(t("supplier").select("s_nationkey")).distinct()


@query("""SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states FROM orders GROUP BY 1""")
def q69_distinct_counts(t):
    return t("orders").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderstatus").alias("states"))


# joins with guarantees


@query("""SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def q70_validated_left_join(t):
    right = t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return checks.join_checked(t("orders"), right, ["o_custkey"]).select("o_orderkey", "c_name", "c_mktsegment")


@query("""SELECT l_orderkey, l_linenumber, n FROM lineitem JOIN (SELECT o_orderkey, year(o_orderdate)::INT AS n FROM orders) ON l_orderkey = o_orderkey""")
def q71_lookup_or_fail(t):
    right = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("n"))
    return checks.join_known(t("lineitem"), right, ["l_orderkey"], "n").select("l_orderkey", "l_linenumber", "n")


@query("""SELECT l_orderkey, l_linenumber, l_returnflag AS flag FROM lineitem WHERE l_linestatus IN ('F')""")
def q72_restricted(t):
    return checks.restricted(t("lineitem"), "l_linestatus", ["F"]).select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("flag"))


@query("""SELECT e.event_id, n.n_name AS label FROM events e LEFT JOIN nation n ON n.n_nationkey = CAST(e.value AS INT) % 40""")
def q73_lookup_by_map(t):
    rounded = F.rint("value").cast("int") % 40  # as the SQL's cast rounds
    return t("events").select("event_id", rounded.alias("n_nationkey")).join(t("nation").select("n_nationkey", F.col("n_name").alias("label")), "n_nationkey", "left").select("event_id", "label")


# projection


ROLE_WORDS = ("Batter", "WK-Batter", "bowling allrounder", "Bowler ", "wk keeper", "ALL-ROUNDER", "Top order bat", "left arm BOWL")


@query("""SELECT role, count(*) AS n FROM (SELECT CASE p_size % 8 WHEN 0 THEN 'BATTER' WHEN 1 THEN 'WICKETKEEPER' WHEN 2 THEN 'ALL-ROUNDER' WHEN 3 THEN 'BOWLER' WHEN 4 THEN 'WICKETKEEPER' WHEN 5 THEN 'ALL-ROUNDER' WHEN 6 THEN 'BATTER' ELSE 'BOWLER' END AS role FROM part) GROUP BY 1""")
def q74_canonical_role(t):
    word = F.element_at(F.array(*(F.lit(w) for w in ROLE_WORDS)), (F.col("p_size") % 8 + 1).cast("int"))
    return t("part").groupBy(vocabulary.canonical_role(word).alias("role")).agg(F.count("*").alias("n"))


SHOTS = ("under control", "well timed", "mis-timed", "miss", "edge", "hit pad", None)


@query("""WITH s AS (SELECT event_id, (['under control', 'well timed', 'mis-timed', 'miss', 'edge', 'hit pad', NULL])[CAST(hash_k % 7 AS INT) + 1] AS c, CASE WHEN hash_k % 11 = 0 THEN 'leave' WHEN hash_k % 3 = 0 THEN NULL ELSE 'drive' END AS s,
      CASE WHEN hash_k % 5 = 0 THEN NULL WHEN hash_k % 2 = 0 THEN 'in the air' ELSE 'along the ground' END AS e, CASE WHEN hash_k % 4 = 0 THEN NULL ELSE hash_k % 2 END AS b FROM (SELECT event_id, event_id AS hash_k FROM events)),
    f AS (SELECT event_id, CASE WHEN c IS NOT NULL THEN (c IN ('under control', 'well timed'))::INT::DOUBLE END AS is_controlled, CASE WHEN c IS NOT NULL THEN (c IN ('mis-timed', 'miss', 'edge', 'hit pad'))::INT::DOUBLE END AS is_false_shot,
      CASE WHEN c IS NOT NULL THEN (c IN ('mis-timed', 'miss', 'edge'))::INT::DOUBLE END AS is_false_shot_strict,
      CASE WHEN c IS NOT NULL OR s IS NOT NULL THEN (NOT (coalesce(c IN ('miss', 'hit pad'), false) OR coalesce(s = 'leave', false)))::INT::DOUBLE END AS made_contact, e, b FROM s),
    g AS (SELECT *, CASE WHEN e IS NOT NULL AND made_contact = 1 THEN (e = 'in the air')::INT::DOUBLE END AS is_aerial FROM f)
    SELECT event_id, is_controlled, is_false_shot, is_false_shot_strict, made_contact, is_aerial, coalesce(is_controlled, b) AS is_controlled_wide, CASE WHEN is_controlled IS NOT NULL THEN 'descriptive' WHEN b IS NOT NULL THEN 'binary' END AS control_source,
      (is_controlled IS NOT NULL)::INT AS has_shot_control, (coalesce(is_controlled, b) IS NOT NULL)::INT AS has_control, (is_aerial IS NOT NULL)::INT AS has_elevation FROM g""")
def q75_shot_flags(t):
    k = F.col("event_id")
    control = F.element_at(F.array(*(F.lit(x).cast("string") for x in SHOTS)), (k % 7 + 1).cast("int"))
    shot = F.when(k % 11 == 0, "leave").when(k % 3 == 0, F.lit(None)).otherwise("drive")
    elevation = F.when(k % 5 == 0, F.lit(None)).when(k % 2 == 0, "in the air").otherwise("along the ground")
    made = vocabulary.shot_flags(control, shot, elevation, F.when(k % 4 != 0, k % 2))
    return t("events").select("event_id", *(c.alias(n) for n, c in made.items()))


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), CAST(floor(value) AS INT)) AS v FROM events""")
def q76_tolerant_cast_pair(t):
    return t("events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.floor("value").cast("int")).alias("v"))


@query("""SELECT substr(strftime(o_orderdate, '%Y-%m'), 1, 4) AS season, count(*) AS n FROM orders GROUP BY 1""")
def q77_season_key(t):
    return t("orders").groupBy(exprs.season(F.date_format("o_orderdate", "yyyy-MM")).alias("season")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag = 'R' OR l_linestatus = 'O' AS any_flag, (CASE WHEN l_quantity > 40 THEN 1 END) IS NULL AND (CASE WHEN l_discount > 0.08 THEN 1 END) IS NULL AS nothing FROM lineitem""")
def q78_horizontal_flags(t):
    rows = t("lineitem").withColumns({"a": F.col("l_returnflag") == "R", "b": F.col("l_linestatus") == "O", "c": F.when(F.col("l_quantity") > 40, 1), "d": F.when(F.col("l_discount") > 0.08, 1)})
    return rows.select("l_orderkey", "l_linenumber", exprs.any_true(["a", "b"]).alias("any_flag"), exprs.all_null(["c", "d"]).alias("nothing"))


@query("""SELECT o_orderkey, round((DATE '2000-01-01' - CAST(o_orderdate AS DATE)) / 365.25, 6) AS age, CAST(trunc(o_totalprice / 1000) AS BIGINT) AS thousands,
    round(least(greatest((ln(1 + greatest(o_totalprice, 0)) - 11) / 0.8, -10), 10), 6) AS z, round(ln(greatest(o_totalprice, 1e-3) / greatest(1e5, 1e-3)), 6) AS ratio FROM orders""")
def q79_scalar_functions(t):
    p = F.col("o_totalprice")
    return t("orders").select("o_orderkey", F.round(exprs.age_years(F.to_date("o_orderdate"), F.lit("2000-01-01").cast("date")), 6).alias("age"), exprs.as_int(p / 1000).alias("thousands"),
        F.round(exprs.clipped_z(p, 11, 0.8, log=True), 6).alias("z"), F.round(exprs.log_ratio(p, F.lit(1e5)), 6).alias("ratio"))


@query("""WITH m AS (SELECT p_partkey, ln(p_retailprice) AS mu, 0.05 + p_size / 50.0 AS s FROM part)
    SELECT p_partkey, round(exp(least(mu, 700)), 3) AS median, round(exp(least(mu + s * s / 2, 700)), 3) AS mean, round(exp(least(mu - 3 * s, 700)), 3) AS low, round(exp(least(mu + 3 * s, 700)), 3) AS high FROM m""")
def q80_lognormal_summary(t):
    made = normal.lognormal_summary(F.ln("p_retailprice"), F.lit(0.05) + F.col("p_size") / 50.0)
    return t("part").select("p_partkey", *(F.round(c, 3).alias(n) for n, c in made.items()))


# names


@query("""SELECT p_partkey, len(string_split(p_name, ' ')) AS n, string_split(p_name, ' ')[1] AS first FROM part""")
def q81_name_tokens(t):
    words = names.tokens(F.col("p_name"), " ", plain=True)
    return t("part").select("p_partkey", F.size(words).cast("long").alias("n"), F.get(words, F.lit(0)).alias("first"))


@query("""WITH n AS (SELECT p_partkey, lower(p_name) AS a, lower(lead(p_name) OVER (ORDER BY p_partkey)) AS b FROM part), w AS (SELECT *, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM n WHERE b IS NOT NULL)
    SELECT p_partkey, CASE WHEN x[-1] = y[-1] AND x[1][1] = y[1][1] THEN 2 WHEN len(list_intersect(x, y)) > 0 THEN 1 ELSE 0 END AS plausible, starts_with(y[1], x[1][1:2]) AS prefixed FROM w""")
def q82_plausibility(t):
    n = t("part").select("p_partkey", names.tokens(F.col("p_name"), " ", plain=True).alias("x"))
    after = n.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y"))  # keys are dense: the next part
    first = lambda c: F.lower(F.get(c, F.lit(0)))
    return n.join(after, "p_partkey").select("p_partkey", names.plausibility(F.col("x"), F.col("y")).alias("plausible"), first("y").startswith(F.substring(first("x"), 1, 2)).alias("prefixed"))


PARTICLE_NAMES = """WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w, (['van', 'bin', 'de', 'Al', 'ter', 'DA'])[CAST(p_size % 6 AS INT) + 1] AS x FROM part)"""


@query(PARTICLE_NAMES + """ SELECT p_partkey, lower(w[-1]) || ' ' || lower(w[1][1]) || CASE WHEN x IN ('van', 'de', 'ter') THEN '' WHEN x = 'DA' THEN 'da' ELSE lower(x[1]) END AS signature FROM p""")
def q83_signature_with_particles(t):
    x = F.element_at(F.array(*(F.lit(w) for w in ("van", "bin", "de", "Al", "ter", "DA"))), (F.col("p_size") % 6 + 1).cast("int"))
    w = F.split("p_name", " ")
    name = F.concat_ws(" ", F.get(w, F.lit(0)), x, F.get(w, F.size(w) - 1))
    return t("part").select("p_partkey", names.signature(names.tokens(name, "", plain=True)).alias("signature"))


# market


MARKET = """WITH t AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM']) AS team),
    l AS (SELECT c_nationkey AS auction, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) AS lot, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority END AS buyer, o_totalprice AS price,
      [o_orderstatus, CASE WHEN o_totalprice > 150000 THEN 'dear' ELSE 'cheap' END] AS tags FROM orders JOIN customer ON o_custkey = c_custkey),
    g AS (SELECT l.*, team, 3e6 - coalesce(sum(CASE WHEN buyer = team THEN price ELSE 0 END) OVER w, 0) AS purse_left, CAST(coalesce(sum((buyer = team)::INT) OVER w, 0) AS BIGINT) AS bought,
      CAST(coalesce(sum((buyer = team AND price > 150000)::INT) OVER w, 0) AS BIGINT) AS n_dear FROM l CROSS JOIN t WINDOW w AS (PARTITION BY auction, team ORDER BY lot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    k AS (SELECT unnest(['O', 'F', 'dear', 'cheap']) AS tag, unnest([5, 4, 6, 3]) AS target),
    h AS (SELECT auction, lot, team, tag, target, purse_left, 20 - bought AS slots_left, coalesce(CAST(sum((coalesce(buyer = team, false) AND list_contains(tags, tag))::INT) OVER (PARTITION BY auction, team, tag ORDER BY lot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS held FROM g CROSS JOIN k),
    d AS (SELECT auction, lot, tag, CAST(sum((slots_left > 0 AND purse_left >= 1000 AND held < target)::INT) AS BIGINT) AS demand FROM h GROUP BY ALL),
    s AS (SELECT auction, lot, tag, tags, coalesce(CAST(sum(list_contains(tags, tag)::INT) OVER (PARTITION BY auction, tag ORDER BY lot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT), 0) AS supply FROM l CROSS JOIN k) """


def _market(t):
    from pyspark.sql import Window

    o = t("orders").join(t("customer").select("c_custkey", F.col("c_nationkey").alias("auction")), F.col("o_custkey") == F.col("c_custkey"))
    dear = F.col("o_totalprice") > 150000
    team = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), F.col("o_orderpriority"))
    lots = o.select("auction", F.row_number().over(Window.partitionBy("auction").orderBy("o_orderdate", "o_orderkey")).alias("lot"), team.alias("team"), F.col("o_totalprice").alias("price"), F.array("o_orderstatus", F.when(dear, "dear").otherwise("cheap")).alias("tags"))
    spark = lots.sparkSession
    teams = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",)], "team string")
    targets = spark.createDataFrame([("O", 5), ("F", 4), ("dear", 6), ("cheap", 3)], "tag string, target int")
    return lots, market.team_states(lots, teams, 3e6, 20, {"n_dear": F.col("price") > 150000}), targets


@query(MARKET + "SELECT auction, CAST(lot AS INT) AS lot, team, round(purse_left, 2) AS purse_left, 20 - bought AS slots_left, bought, n_dear FROM g")
def q84_team_states(t):
    return _market(t)[1].withColumn("purse_left", F.round("purse_left", 2))


@query(MARKET + "SELECT auction, CAST(lot AS INT) AS lot, tag, supply, demand, round(CAST(demand AS DOUBLE) / greatest(supply, 1), 8) AS scarcity FROM s JOIN d USING (auction, lot, tag)")
def q85_tag_states(t):
    lots, states, targets = _market(t)
    return market.tag_states(lots, states, targets, 1000.0).withColumn("scarcity", F.round("scarcity", 8))


@query(MARKET + """, x AS (SELECT s.*, demand, CAST(demand AS DOUBLE) / greatest(supply, 1) AS scarcity FROM s JOIN d USING (auction, lot, tag) WHERE list_contains(tags, tag)),
    y AS (SELECT auction, lot, count(*) AS n_tags, min(supply) AS supply_min, avg(supply) AS supply_mean, max(demand) AS demand_max, avg(demand) AS demand_mean, max(scarcity) AS scarcity_max, avg(scarcity) AS scarcity_mean FROM x GROUP BY ALL),
    z AS (SELECT auction, lot, team, slots_left, min(held) AS bought_min, max(held) AS bought_max, avg(held) AS bought_mean, min(greatest(target - held, 0)) AS needed_min, max(greatest(target - held, 0)) AS needed_max, avg(greatest(target - held, 0)) AS needed_mean, CAST(max((held < target)::INT) AS INT) AS wants_any
      FROM h JOIN x USING (auction, lot, tag) GROUP BY ALL),
    c AS (SELECT auction, lot, tags, count(*) OVER (PARTITION BY auction) AS n FROM l),
    q AS (SELECT a.auction, a.lot, count(b.lot) AS substitutes_remaining FROM l a LEFT JOIN l b ON a.auction = b.auction AND b.lot >= a.lot AND (a.tags[1] = b.tags[1] OR a.tags[2] = b.tags[2]) GROUP BY ALL)
    SELECT auction, CAST(lot AS INT) AS lot, team, bought_min, bought_max, bought_mean, needed_min, needed_max, needed_mean, wants_any, CAST(sum(CASE WHEN slots_left > 0 THEN wants_any ELSE 0 END) OVER (PARTITION BY auction, lot) AS BIGINT) AS interested,
    n_tags, supply_min, round(supply_mean, 6) AS supply_mean, demand_max, demand_mean, round(scarcity_max, 6) AS scarcity_max, round(scarcity_mean, 6) AS scarcity_mean, substitutes_remaining FROM z JOIN y USING (auction, lot) JOIN q USING (auction, lot)""")
def q86_focus_block(t):
    done = market.focus(*_market(t), 1000.0)
    return done.withColumns({c: F.round(c, 6) for c in ("supply_mean", "scarcity_max", "scarcity_mean")})


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) AS no FROM events""")
def q87_bid_numbers(t):
    e = t("events").withColumn("no", F.when(F.col("event_id") < 0, F.lit(1).cast("long"))).withColumn("lot", F.concat_ws("|", "user_id", "event_type"))
    return market.numbered_bids(e, "lot", "no", "value", "event_id").select("event_id", "no")


# statistics


RATE_SUMS = """WITH s AS (SELECT l_suppkey AS k, sum(l_quantity) AS runs, count(*) AS balls, count_if(l_returnflag = 'R') AS outs, count_if(l_quantity > 40) AS fours, count_if(l_quantity > 45) AS sixes, count_if(l_discount = 0) AS dots, count(DISTINCT l_orderkey) AS innings,
    count_if(l_tax > 0.02) AS control_balls, count_if(l_tax > 0.05) AS controlled, count_if(l_discount > 0.02) AS elev_balls, count_if(l_discount > 0.06) AS aerial,
    sum(CASE WHEN l_linenumber <= 2 THEN l_quantity ELSE 0 END) AS runs_powerplay, count_if(l_linenumber <= 2) AS balls_powerplay, count_if(l_linenumber <= 2 AND l_quantity > 40) AS boundaries_powerplay FROM lineitem GROUP BY 1) """


def _rate_sums(t):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    q, early = F.col("l_quantity"), F.col("l_linenumber") <= 2
    return t("lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum(q).alias("runs"), F.count("*").alias("balls"), n(F.col("l_returnflag") == "R").alias("outs"), n(q > 40).alias("fours"), n(q > 45).alias("sixes"), n(F.col("l_discount") == 0).alias("dots"), F.countDistinct("l_orderkey").alias("innings"),
        n(F.col("l_tax") > 0.02).alias("control_balls"), n(F.col("l_tax") > 0.05).alias("controlled"), n(F.col("l_discount") > 0.02).alias("elev_balls"), n(F.col("l_discount") > 0.06).alias("aerial"),
        F.sum(F.when(early, q).otherwise(0)).alias("runs_powerplay"), n(early).alias("balls_powerplay"), n(early & (q > 40)).alias("boundaries_powerplay"))


@query(RATE_SUMS + """SELECT k, round(runs / nullif(outs, 0), 6) AS average, round(100 * runs / nullif(balls, 0), 6) AS strike_rate, round((fours + sixes) / nullif(balls, 0), 6) AS boundary_percentage, round(dots / nullif(balls, 0), 6) AS dot_ball_percentage,
    round(balls / nullif(outs, 0), 6) AS balls_per_dismissal, round(runs / nullif(innings, 0), 6) AS runs_per_innings, round(controlled / nullif(control_balls, 0), 6) AS control_percentage, round((control_balls - controlled) / nullif(control_balls, 0), 6) AS false_shot_percentage,
    round(aerial / nullif(elev_balls, 0), 6) AS aerial_percentage, round(100 * runs_powerplay / nullif(balls_powerplay, 0), 6) AS strike_rate_powerplay, round(balls_powerplay / nullif(balls, 0), 6) AS balls_share_powerplay, CAST(runs_powerplay AS DOUBLE) AS runs_powerplay,
    round(boundaries_powerplay / nullif(balls_powerplay, 0), 6) AS boundary_percentage_powerplay FROM s""")
def q88_batting_rates(t):
    made = rates.batting(phases=("powerplay",))
    return _rate_sums(t).select("k", *(F.round(c.cast("double"), 6).alias(n) for n, c in made.items()))


@query("""WITH s AS (SELECT l_suppkey AS k, sum(l_quantity) AS runs, count(*) AS balls, count_if(l_returnflag = 'R') AS wickets, count_if(l_discount = 0) AS dots, count(DISTINCT l_orderkey) AS innings, count_if(l_tax = 0) AS wides, count_if(l_tax = 0.01) AS noballs,
    count_if(l_tax > 0.02) AS control_balls, count_if(l_tax > 0.05) AS false_shots, count_if(l_discount > 0.02) AS elev_balls, count_if(l_discount > 0.06) AS aerial_conceded, sum(CASE WHEN l_linenumber >= 5 THEN l_quantity ELSE 0 END) AS runs_death, count_if(l_linenumber >= 5) AS balls_death,
    count_if(l_linenumber >= 5 AND l_returnflag = 'R') AS wickets_death, count_if(l_linenumber >= 5 AND l_quantity > 40) AS boundaries_conceded_death FROM lineitem GROUP BY 1)
    SELECT k, round(6 * runs / nullif(balls, 0), 6) AS economy, round(runs / nullif(wickets, 0), 6) AS average, round(balls / nullif(wickets, 0), 6) AS strike_rate, round(dots / nullif(balls, 0), 6) AS dot_ball_percentage, round(wickets / nullif(innings, 0), 6) AS wickets_per_innings,
    round((wides + noballs) / nullif(balls, 0), 6) AS extras_per_ball, round(false_shots / nullif(control_balls, 0), 6) AS false_shot_percentage, round((control_balls - false_shots) / nullif(control_balls, 0), 6) AS control_conceded_percentage, round(aerial_conceded / nullif(elev_balls, 0), 6) AS aerial_conceded_percentage,
    round(6 * runs_death / nullif(balls_death, 0), 6) AS economy_death, round(balls_death / nullif(balls, 0), 6) AS balls_share_death, round(balls_death / nullif(wickets_death, 0), 6) AS strike_rate_death, CAST(runs_death AS DOUBLE) AS runs_death,
    round(boundaries_conceded_death / nullif(balls_death, 0), 6) AS boundary_percentage_death FROM s""")
def q89_bowling_rates(t):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    q, late, out = F.col("l_quantity"), F.col("l_linenumber") >= 5, F.col("l_returnflag") == "R"
    sums = t("lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sum(q).alias("runs"), F.count("*").alias("balls"), n(out).alias("wickets"), n(F.col("l_discount") == 0).alias("dots"), F.countDistinct("l_orderkey").alias("innings"), n(F.col("l_tax") == 0).alias("wides"), n(F.col("l_tax") == 0.01).alias("noballs"),
        n(F.col("l_tax") > 0.02).alias("control_balls"), n(F.col("l_tax") > 0.05).alias("false_shots"), n(F.col("l_discount") > 0.02).alias("elev_balls"), n(F.col("l_discount") > 0.06).alias("aerial_conceded"),
        F.sum(F.when(late, q).otherwise(0)).alias("runs_death"), n(late).alias("balls_death"), n(late & out).alias("wickets_death"), n(late & (q > 40)).alias("boundaries_conceded_death"))
    return sums.select("k", *(F.round(c.cast("double"), 6).alias(name) for name, c in rates.bowling(phases=("death",)).items()))


@query("""WITH r AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, dense_rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS m, o_totalprice AS p FROM orders),
    q AS (SELECT c_custkey AS k, unnest([DATE '1995-06-30', DATE '1998-01-01']) AS day FROM customer),
    n AS (SELECT k, day, max(m) AS top FROM q JOIN r ON o_custkey = k AND d < day GROUP BY 1, 2)
    SELECT q.k, q.day, count(m) AS matches, round(coalesce(sum(p), 0), 2) AS total FROM q LEFT JOIN n USING (k, day) LEFT JOIN r ON o_custkey = q.k AND d < q.day AND m > top - 3 GROUP BY 1, 2""")
def q90_last_three_at(t):
    o = t("orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("match"), F.col("o_totalprice").alias("p"))
    asked = t("customer").select(F.col("c_custkey").alias("k"), F.explode(F.array(F.lit("1995-06-30").cast("date"), F.lit("1998-01-01").cast("date"))).alias("day"))
    done = asof.recent_of(o, asked, "k", "d", "match", "day", 3, {"total": F.col("p")})
    return done.select("k", "day", "matches", F.round("total", 2).alias("total"))


# checks


@query("""SELECT 'orders_without_customer' AS check, 'error' AS severity, count(*) AS value FROM orders ANTI JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT 'lines_without_order', 'error', count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT 'customers_without_orders', 'info', count(*) FROM customer ANTI JOIN orders ON o_custkey = c_custkey
    UNION ALL SELECT 'orders_key_repeated', 'error', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
    UNION ALL SELECT 'lineitem_discount_outside', 'warning', count_if(l_discount < 0 OR l_discount > 0.1) FROM lineitem
    UNION ALL SELECT 'lineitem_quantity_missing', 'error', count_if(l_quantity IS NULL) FROM lineitem""")
def q91_table_audit(t):
    return checks.audit([
        checks.unmatched("orders_without_customer", "error", t("orders"), t("customer"), "o_custkey", "c_custkey"),
        checks.unmatched("lines_without_order", "error", t("lineitem"), t("orders"), "l_orderkey", "o_orderkey"),
        checks.unmatched("customers_without_orders", "info", t("customer"), t("orders"), "c_custkey", "o_custkey"),
        checks.repeated("orders_key_repeated", "error", t("orders"), ["o_orderkey"]),
        checks.findings(t("lineitem"), {"lineitem_discount_outside": ("warning", (F.col("l_discount") < 0) | (F.col("l_discount") > 0.1)), "lineitem_quantity_missing": ("error", F.col("l_quantity").isNull())}),
    ])


@query("""WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice AS lower, o_totalprice * (1 + (o_orderkey % 3 - 1) / 10.0) AS upper FROM orders) SELECT o_orderkey FROM b WHERE NOT (lower > 0 AND upper > lower)""")
def q92_bad_intervals(t):
    rows = t("orders").withColumns({"lower": F.col("o_totalprice"), "upper": F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 3 - 1) / 10.0)})
    return checks.bad_intervals(rows, "lower", "upper").select("o_orderkey")


# features and identities


@query("""WITH s AS (SELECT o_custkey AS k, count(*) AS n, count_if(o_orderstatus = 'F') AS closed FROM orders GROUP BY 1)
    SELECT c_custkey, (n IS NOT NULL)::INT::DOUBLE AS has_history, coalesce(n, 0)::DOUBLE AS n_orders, coalesce(n / nullif(closed, 0), 0) AS per_closed, (n / nullif(closed, 0) IS NULL)::INT::DOUBLE AS per_closed_is_missing
    FROM customer LEFT JOIN s ON k = c_custkey AND c_acctbal >= 0""")
def q93_roster_features(t):
    closed = F.sum(F.when(F.col("o_orderstatus") == "F", 1))
    table = t("orders").groupBy(F.col("o_custkey").alias("person")).agg(F.count("*").alias("n"), (F.count("*") / closed).alias("per_closed"))
    people = t("customer").where("c_acctbal >= 0").select("c_custkey", F.col("c_custkey").alias("person"))
    return features.for_roster(t("customer"), people, table, "c_custkey", "person", {"n_orders": F.col("n")}, {"per_closed": F.col("per_closed")})


@query("""WITH p AS (SELECT p_partkey, p_name, 'part ' || (p_partkey % 100) AS second FROM part), r AS (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_name ELSE ' ' END AS u FROM supplier),
    b AS (SELECT *, CASE WHEN trim(u) <> '' THEN u END AS given FROM p LEFT JOIN r ON s_suppkey = p_partkey), v AS (SELECT *, list_sort(list_distinct(list_filter([p_name, second, CASE WHEN s_suppkey IS NOT NULL THEN 'S' || s_suppkey END, given], lambda x: x IS NOT NULL))) AS names FROM b)
    SELECT p_partkey AS person_id, coalesce(given, p_name) AS canonical_name, array_to_string(names, '|') AS name_variants, len(names)::INT AS n_variants, u AS unique_name, CASE WHEN s_suppkey IS NOT NULL THEN 'c' || s_suppkey END AS key_cricinfo, CAST(NULL AS VARCHAR) AS key_cricbuzz FROM v""")
def q94_merge_register(t):
    people = t("part").select(F.col("p_partkey").alias("person_id"), F.col("p_name").alias("canonical_name"), F.concat("p_name", F.lit("|part "), (F.col("p_partkey") % 100).cast("string")).alias("name_variants"))
    key = F.col("s_suppkey")
    known = t("supplier").select(key.alias("identifier"), F.concat(F.lit("S"), key.cast("string")).alias("name"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).otherwise(" ").alias("unique_name"),
        F.concat(F.lit("c"), key.cast("string")).alias("key_cricinfo"), F.lit(None).cast("string").alias("key_cricbuzz"))
    return register.merge_register(people, known)


@query("""WITH o AS (SELECT o_orderkey, o_custkey AS player, year(CAST(o_orderdate AS DATE)) AS season, c_nationkey AS team, o_orderpriority AS prio FROM orders JOIN customer ON o_custkey = c_custkey),
    sq AS (SELECT DISTINCT season, team, l_suppkey AS person FROM o JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 50), un AS (SELECT c_custkey AS player, CASE WHEN c_acctbal < 0 THEN 'ambiguous' ELSE 'no_match' END AS reason FROM customer),
    li AS (SELECT DISTINCT player, season, team FROM o JOIN un USING (player) WHERE prio = '1-URGENT' AND reason = 'no_match'), co AS (SELECT DISTINCT player FROM li JOIN sq USING (season, team)),
    pa AS (SELECT DISTINCT player, person FROM li JOIN sq USING (season, team) ANTI JOIN (SELECT s_suppkey AS person FROM supplier WHERE s_acctbal > 0) USING (person)),
    ca AS (SELECT player, list_sort(list(person)) AS c, bool_or(n > 1) AS d FROM (SELECT *, count(*) OVER (PARTITION BY person) AS n FROM pa) GROUP BY 1)
    SELECT un.player, CASE WHEN reason = 'ambiguous' THEN 'fixable' WHEN co.player IS NULL THEN 'inconclusive' WHEN c IS NOT NULL THEN 'residue_hit' ELSE 'no_t20_record' END AS status, coalesce(array_to_string(c, ','), '') AS candidates, coalesce(d, false) AS contested
    FROM un LEFT JOIN co USING (player) LEFT JOIN ca USING (player)""")
def q95_squad_residue(t):
    o = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", F.col("o_custkey").alias("player"), F.year(F.to_date("o_orderdate")).alias("season"), F.col("c_nationkey").alias("team"), "o_orderpriority")
    played = t("lineitem").where("l_quantity >= 50").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("season", "team", F.col("l_suppkey").alias("person"))
    asked = t("customer").select(F.col("c_custkey").alias("player"), F.when(F.col("c_acctbal") < 0, "ambiguous").otherwise("no_match").alias("reason"))
    listed = o.where("o_orderpriority = '1-URGENT'").select("player", "season", "team")
    done = register.residue(asked, listed, played, t("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("person")))
    return done.withColumn("candidates", F.array_join(F.transform("candidates", lambda x: x.cast("string")), ","))
