"""The catalogue: each operator on the star-schema and event tables, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs, names
from tidemark.operators import asof, checks, encode, fold, linkage, metrics, replay, tags

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None):
    """Registers a function of a table reader under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir, f=f: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def long(c):
    return c.cast("long")


# scan, filter, projection


@query("""SELECT l_orderkey, l_partkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue
    FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25""")
def q01_scan_filter_project(t):
    rows = t("lineitem").where("l_returnflag = 'R' and l_quantity > 25")
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("revenue"))


@query("""SELECT c_custkey AS key, c_name AS name, c_acctbal AS bal, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def q02_union_by_name(t):
    a = t("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    b = t("supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return a.unionByName(b, allowMissingColumns=True)


PHASES = ((16, "early"), (33, "middle"))


@query("""SELECT CASE WHEN p_size <= 16 THEN 'early' WHEN p_size <= 33 THEN 'middle' ELSE 'late' END AS phase, count(*) AS n,
    sum(p_retailprice) AS price FROM part GROUP BY 1""")
def q03_phase_bucket(t):
    return t("part").groupBy(exprs.bucket(F.col("p_size"), PHASES, "late").alias("phase")).agg(F.count("*").alias("n"), F.sum("p_retailprice").alias("price"))


@query("""SELECT c_custkey, CASE upper(trim(c_mktsegment)) WHEN 'AUTOMOBILE' THEN 'AUTO' ELSE upper(trim(c_mktsegment)) END AS segment
    FROM customer WHERE upper(trim(c_mktsegment)) IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')""")
def q04_status_normalise(t):
    seg = exprs.normalised(F.col("c_mktsegment"))
    return t("customer").where(seg.isin("AUTOMOBILE", "BUILDING", "MACHINERY")).select("c_custkey", F.when(seg == "AUTOMOBILE", "AUTO").otherwise(seg).alias("segment"))


@query("""WITH m AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_acctbal AS VARCHAR) || ' Cr' ELSE CAST(c_acctbal AS VARCHAR) || ' Lakh' END AS txt FROM customer),
    p AS (SELECT c_custkey, txt, try_cast(regexp_extract(upper(txt), '^([0-9.]+)\\s*(CRORE|CR|LAKH|L)?', 1) AS DOUBLE) AS v, regexp_extract(upper(txt), '^([0-9.]+)\\s*(CRORE|CR|LAKH|L)?', 2) AS u FROM m)
    SELECT c_custkey, CASE WHEN u IN ('CR', 'CRORE') THEN v * 100 ELSE v END AS auction_value,
    CASE WHEN u = 'CR' THEN v * 100 END AS earnings_value FROM p""")
def q05_money_parse(t):
    text = F.concat(exprs.plain_text(F.col("c_acctbal")), F.when(F.col("c_custkey") % 2 == 0, " Cr").otherwise(" Lakh"))
    return t("customer").select("c_custkey", exprs.auction_money(text).alias("auction_value"), exprs.earnings_money(text).alias("earnings_value"))


@query("""SELECT l_returnflag, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def q06_token_binary(t):
    return t("lineitem").groupBy("l_returnflag", exprs.tokens_to_binary(F.col("l_returnflag"), ["R"], ["A"]).alias("flag")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def q07_json_prop(t):
    k = F.from_json("props", "k bigint")["k"]
    return t("events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text FROM conversations""")
def q08_nested_flatten(t):
    nested = t("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return nested.select("conv_id", F.posexplode("turns").alias("pos", "t")).select("conv_id", long(F.col("pos")).alias("pos"), "t.role", "t.text")


@query("""SELECT doc_id, contains(lower(text), 'the and') AS has_words, length(text) >= n_chars AS whole FROM documents""")
def q09_text_search(t):
    return t("documents").select("doc_id", exprs.contains_text(F.col("text"), "The And").alias("has_words"), (F.length("text") >= F.col("n_chars")).alias("whole"))


# as of


@query("""SELECT event_id, user_id, coalesce(n, 0) AS n_before, s AS sum_before, CASE WHEN n > 0 THEN s / n END AS mean_before FROM (
    SELECT event_id, user_id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS s FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY CAST(ts AS DATE) - DATE '1970-01-01' RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
def q10_career_before(t):
    done = asof.career_before(t("events"), "user_id", "ts", {"n_before": F.count("*"), "s": F.sum("value")})
    s = F.round("s", 6)
    return done.select("event_id", "user_id", "n_before", s.alias("sum_before"), exprs.ratio(s, F.col("n_before")).alias("mean_before"))


@query("""SELECT c_custkey, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total
    FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1994-06-01' GROUP BY 1) ON o_custkey = c_custkey""")
def q11_career_at_date(t):
    orders = t("orders").withColumnRenamed("o_custkey", "c_custkey")
    done = asof.totals_at(orders, t("customer"), "c_custkey", "o_orderdate", {"n": F.lit(1), "total": F.col("o_totalprice")}, F.lit("1994-06-01").cast("date"))
    return done.select("c_custkey", long(F.col("n")).alias("n"), F.round(F.col("total").cast("double"), 2).alias("total"))


@query("""WITH e AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS m FROM events)
    SELECT event_id, user_id, round(sum(value) OVER w, 6) AS sum_3, count(*) OVER w AS n_3 FROM e
    WINDOW w AS (PARTITION BY user_id ORDER BY m RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def q12_trailing_3_days(t):
    done = asof.trailing_periods(t("events"), "user_id", F.to_date("ts"), 3, {"sum_3": F.sum("value"), "n_3": F.count("*")})
    return done.select("event_id", "user_id", F.round("sum_3", 6).alias("sum_3"), "n_3")


@query("""SELECT u.user_id, coalesce(n, 0) AS n, coalesce(total, 0) AS total FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, count(*) AS n, round(sum(value), 4) AS total
    FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-05' AND CAST(ts AS DATE) < DATE '2024-01-08' GROUP BY 1) x USING (user_id)""")
def q13_since_window(t):
    e, day = t("events"), lambda x: F.lit(x).cast("date")
    done = asof.totals_at(e, e, "user_id", "ts", {"n": F.lit(1), "total": F.col("value")}, day("2024-01-08"), day("2024-01-05"))
    return done.select("user_id", long(F.col("n")).alias("n"), F.round(F.col("total").cast("double"), 4).alias("total"))


@query("""SELECT o.o_orderkey, p.o_totalprice AS prev_price FROM orders o ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2) p
    ON o.o_custkey = p.o_custkey AND o.o_orderdate > p.o_orderdate""")
def q14_asof_prev_order(t):
    o = t("orders")
    return asof.asof_join(o.select("o_orderkey", "o_custkey", "o_orderdate"), o, "o_custkey", "o_orderdate", {"prev_price": "o_totalprice"}, [F.col("o_orderkey")]).select("o_orderkey", "prev_price")


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1 AS is_new,
    dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) AS periods FROM events""")
def q15_new_period_flag(t):
    return asof.new_period(t("events"), "user_id", F.to_date("ts"), [F.col("ts"), F.col("event_id")]).select("event_id", "is_new", "periods")


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(sum(l_quantity) OVER w, 0) AS qty_before, round(coalesce(sum(l_extendedprice) OVER w, 0), 2) AS price_before FROM lineitem
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def q16_running_state_before(t):
    done = asof.running_before(t("lineitem"), ["l_orderkey"], [F.col(c) for c in LINE_ORDER], {"qty_before": F.col("l_quantity"), "price_before": F.col("l_extendedprice")})
    return done.select("l_orderkey", *LINE_ORDER, F.col("qty_before").cast("double").alias("qty_before"), F.round(F.col("price_before").cast("double"), 2).alias("price_before"))


@query("""SELECT r.user_id, r.as_of, count(e.event_id) AS n, round(coalesce(sum(e.value), 0), 4) AS total
    FROM (SELECT DISTINCT user_id, as_of FROM events, (VALUES (DATE '2024-01-03'), (DATE '2024-01-11')) v(as_of)) r
    LEFT JOIN events e ON e.user_id = r.user_id AND CAST(e.ts AS DATE) < r.as_of GROUP BY 1, 2""")
def q17_requests_as_of(t):
    e = t("events")
    asked = e.select("user_id").distinct().select("user_id", F.explode(F.array(*(F.lit(x).cast("date") for x in ("2024-01-03", "2024-01-11")))).alias("as_of"))
    done = asof.totals_of(e, asked, "user_id", "ts", "as_of", {"n": F.lit(1).cast("double"), "total": F.col("value")})
    return done.select("user_id", "as_of", long(F.col("n")).alias("n"), F.round("total", 4).alias("total"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1""")
def q18_first_per_key(t):
    return asof.first_of(t("orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


# folds and aggregates


@query("""WITH c AS (SELECT c_nationkey AS entity, year(o_orderdate) AS y, o_totalprice AS spent, 0 AS sold, 1 AS orders, 0 AS lines FROM orders JOIN customer ON o_custkey = c_custkey),
    s AS (SELECT s_nationkey AS entity, year(o_orderdate) AS y, 0 AS spent, l_extendedprice AS sold, 0 AS orders, 1 AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey)
    SELECT entity, CAST(y AS INT) AS y, round(sum(spent), 2) AS spent, round(sum(sold), 2) AS sold, CAST(sum(orders) AS BIGINT) AS orders, CAST(sum(lines) AS BIGINT) AS lines
    FROM (SELECT * FROM c UNION ALL SELECT * FROM s) GROUP BY 1, 2""")
def q20_fold_two_role(t):
    o = t("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), "o_totalprice")
    bought = o.join(t("customer").select("c_custkey", "c_nationkey"), o.o_custkey == F.col("c_custkey")).select(F.col("c_nationkey").alias("buyer"), F.lit(None).cast("int").alias("seller"), "y", F.col("o_totalprice").alias("amount"))
    lines = t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    sold = lines.select(F.lit(None).cast("int").alias("buyer"), F.col("s_nationkey").alias("seller"), "y", F.col("l_extendedprice").alias("amount"))
    roles = [fold.Role("buyer", F.col("buyer"), {"spent": F.col("amount"), "orders": F.lit(1)}), fold.Role("seller", F.col("seller"), {"sold": F.col("amount"), "lines": F.lit(1)})]
    done = fold.fold_roles(bought.unionByName(sold), roles, {"y": F.col("y")})
    return done.select("entity", "y", F.round(F.col("spent").cast("double"), 2).alias("spent"), F.round(F.col("sold").cast("double"), 2).alias("sold"), long(F.col("orders")).alias("orders"), long(F.col("lines")).alias("lines"))


@query("""SELECT l_suppkey, """ + ", ".join(f"round(coalesce(sum(CASE WHEN ph = '{p}' THEN {c} END), 0), 2) AS {n}_{p}" for n, c in (("qty", "l_quantity"), ("price", "l_extendedprice")) for p in ("early", "middle", "late")) + """
    FROM (SELECT l.*, CASE WHEN p_size <= 16 THEN 'early' WHEN p_size <= 33 THEN 'middle' ELSE 'late' END AS ph FROM lineitem l JOIN part ON l_partkey = p_partkey) GROUP BY 1""")
def q21_conditional_phase_sums(t):
    joined = t("lineitem").join(t("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    done = fold.phase_sums(joined, ["l_suppkey"], exprs.bucket(F.col("p_size"), PHASES, "late"), ["early", "middle", "late"], {"qty": F.col("l_quantity"), "price": F.col("l_extendedprice")})
    return done.select("l_suppkey", *(F.round(F.col(c).cast("double"), 2).alias(c) for c in done.columns[1:]))


@query("""SELECT l_suppkey, round(CAST(r AS DOUBLE) / n, 8) AS returned_share, CASE WHEN q > 0 THEN round(p / q, 6) END AS price_per_unit, CASE WHEN r > 0 THEN round(rp / r, 6) END AS price_per_return
    FROM (SELECT l_suppkey, count(*) AS n, count_if(l_returnflag = 'R' AND l_quantity > 45) AS r, sum(l_quantity) AS q, sum(l_extendedprice) AS p, sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN l_extendedprice ELSE 0 END) AS rp FROM lineitem GROUP BY 1)""")
def q22_ratio_metrics(t):
    back = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)
    g = t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(back).alias("r"), F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"), F.sum(F.when(back, F.col("l_extendedprice")).otherwise(0)).alias("rp"))
    c = F.col
    return g.select("l_suppkey", F.round(exprs.ratio(c("r"), c("n")), 8).alias("returned_share"), F.round(exprs.ratio(c("p"), c("q")), 6).alias("price_per_unit"), F.round(exprs.ratio(c("rp"), c("r")), 6).alias("price_per_return"))


@query("""SELECT c_custkey, coalesce(total, 0) AS total, CAST(total IS NULL AS DOUBLE) AS total_is_missing FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders
    WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey""")
def q23_missing_flags(t):
    totals = t("orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return exprs.with_missing(t("customer").select("c_custkey").join(totals, "c_custkey", "left"), ["total"])


@query("""SELECT l_suppkey, CAST(sum((r = 0 AND n > 0)::INT) AS BIGINT) AS clean_orders FROM (SELECT l_suppkey, l_orderkey, count_if(l_returnflag = 'R') AS r, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def q24_two_level_zero_flag(t):
    return fold.empty_groups(t("lineitem"), ["l_suppkey"], ["l_orderkey"], F.when(F.col("l_returnflag") == "R", 1).otherwise(0), F.lit(1), "clean_orders")


@query("""SELECT p_type, string_agg(p_brand, '|' ORDER BY p_brand) AS brands, count(*) AS n_brands FROM (SELECT DISTINCT p_type, p_brand FROM part) GROUP BY 1""")
def q25_distinct_sorted_list(t):
    return fold.sorted_list(t("part"), "p_type", "p_brand", "brands")


@query("""SELECT p_brand, arg_min(p_name, {'a': -length(p_name), 'b': p_name}) AS longest_name FROM part GROUP BY 1""")
def q26_longest_name(t):
    return fold.longest(t("part"), "p_brand", "p_name", "longest_name")


@query("""SELECT o_custkey, """ + ", ".join(f"count_if(o_orderpriority = '{p}') AS \"{p}\"" for p in ("1-URGENT", "2-HIGH")) + """ FROM orders GROUP BY 1""")
def q27_pivot_counts(t):
    wanted = ["1-URGENT", "2-HIGH"]
    return t("orders").groupBy("o_custkey").pivot("o_orderpriority", wanted).agg(F.count(F.lit(1))).na.fill(0)


@query("""SELECT o_orderpriority, count(*) AS n, round(100 * avg(CAST(o_orderstatus = 'F' AS DOUBLE)), 1) AS percent FROM orders GROUP BY 1""")
def q28_group_profile(t):
    return fold.group_profile(t("orders"), "o_orderpriority", F.col("o_orderstatus") == "F")


@query("""SELECT entity, min(d) AS first_date FROM (SELECT user_id AS entity, CAST(ts AS DATE) AS d FROM events UNION ALL SELECT event_id, CAST(ts AS DATE) FROM events) GROUP BY 1""")
def q29_first_seen(t):
    return fold.first_seen(t("events").withColumn("d", F.to_date("ts")), ["user_id", "event_id"], "d")


# linkage


@query("""SELECT p_partkey, lower(trim(regexp_replace(p_name, '[^A-Za-z]+', ' ', 'g'))) AS normal FROM part""")
def q30_normalise_key(t):
    return t("part").select("p_partkey", names.normal_name(F.col("p_name"), plain=True).alias("normal"))


@query("""SELECT p_partkey, lower(w[-1]) || ' ' || array_to_string(list_transform(w[:-2], lambda x: lower(x[1])), '') AS signature FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def q31_name_signature(t):
    return t("part").select("p_partkey", names.signature(names.tokens(F.col("p_name"), " ", plain=True)).alias("signature"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part) SELECT a.p_name AS a, b.p_name AS b FROM n a JOIN n b ON a.p_name < b.p_name AND levenshtein(a.p_name, b.p_name) <= 1""")
def q32_levenshtein_le1(t):
    n = t("part").select("p_name").distinct()
    # of two names within one edit, the shorter half before or after the edit is the same in both; which
    # half that is depends on the length they are compared at, their own or the other's
    half = F.floor((F.col("len") - 1) / 2).cast("int")
    parts = n.withColumn("len", F.explode(F.array(F.length("p_name"), F.length("p_name") + 1)))
    head, tail = F.substring(F.col("p_name"), F.lit(1), half), F.reverse(F.substring(F.reverse("p_name"), F.lit(1), half))
    keyed = parts.select("p_name", "len", F.explode(F.array(F.concat(F.lit("<"), head), F.concat(F.lit(">"), tail))).alias("k"))
    pairs = keyed.select(F.col("p_name").alias("a"), "len", "k").join(keyed.select(F.col("p_name").alias("b"), "len", "k"), ["len", "k"]).where("a < b")
    return pairs.where(names.within_one_edit(F.col("a"), F.col("b"))).select("a", "b").distinct()


@query("""SELECT o_orderkey, o_custkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderdate) AS n FROM orders) WHERE n = 1""")
def q33_unique_only_keys(t):
    return linkage.unique_only(t("orders"), ["o_custkey", "o_orderdate"]).select("o_orderkey", "o_custkey")


@query("""WITH o AS (SELECT o_custkey AS c, c_nationkey AS n, CAST(o_orderdate AS DATE) AS d FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT DISTINCT a.n, a.c AS a, b.c AS b FROM o a JOIN o b ON a.n = b.n AND a.c < b.c AND abs(a.d - b.d) <= 1""")
def q34_band_join_1d(t):
    o = t("orders").join(t("customer").select("c_custkey", F.col("c_nationkey").alias("n")), F.col("o_custkey") == F.col("c_custkey"))
    one = o.select("n", F.col("o_custkey").alias("a"), F.to_date("o_orderdate").alias("d")).distinct()
    return linkage.band_join(one, one.select("n", F.col("a").alias("b"), F.col("d").alias("d_r")), ["n"], "d", 1).where("a < b").select("n", "a", "b").distinct()


@query("""WITH u AS (SELECT user_id, CAST(ts AS DATE) AS d, list_sort(list(DISTINCT event_type)) AS s FROM events GROUP BY 1, 2),
    c AS (SELECT a.user_id AS k, a.d, b.user_id AS o, len(list_intersect(a.s, b.s)) AS ov, CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, b.s))) AS j FROM u a JOIN u b ON a.d = b.d AND a.user_id <> b.user_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY k, d ORDER BY j DESC, ov DESC, o DESC) AS n FROM c WHERE ov > 0),
    b AS (SELECT k, d, max(CASE WHEN n = 1 THEN o END) AS o, max(CASE WHEN n = 1 THEN j END) AS j, max(CASE WHEN n = 2 THEN j END) AS j2 FROM r GROUP BY 1, 2)
    SELECT u.user_id, u.d AS day, round(j, 6) AS score, CASE WHEN NOT EXISTS (SELECT 1 FROM c WHERE c.k = u.user_id AND c.d = u.d) THEN 'no_candidate' WHEN j IS NULL THEN 'no_overlap' WHEN j < .35 THEN 'weak' WHEN j2 > j * .8 THEN 'ambiguous' ELSE 'ok' END AS verdict,
    CASE WHEN j >= .35 AND NOT coalesce(j2 > j * .8, false) THEN o END AS linked FROM u LEFT JOIN b ON b.k = u.user_id AND b.d = u.d""")
def q35_jaccard_top2(t):
    u = t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("s")).withColumn("k", F.struct("user_id", "day"))
    pairs = linkage.set_candidates(u, "day", "user_id", "s").select(F.struct("user_id", "day").alias("k"), F.col("other").alias("o"), "score", "overlap")
    done = linkage.verdicts(u.select("k", "user_id", "day"), pairs, "k", "o")
    return done.select("user_id", "day", F.round("score", 6).alias("score"), "verdict", F.col("linked_o").alias("linked"))


@query("""WITH d AS (SELECT doc_id, lang, list_distinct(regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+')) AS s FROM documents)
    SELECT a.doc_id AS a, b.doc_id AS b, round(CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, b.s))), 6) AS score FROM d a JOIN d b ON a.lang = b.lang AND a.doc_id < b.doc_id
    WHERE CAST(len(list_intersect(a.s, b.s)) AS DOUBLE) / len(list_distinct(list_concat(a.s, b.s))) >= .35""")
def q35b_jaccard_documents(t):
    # candidates share a word of the prefix that a pair at the threshold must share, rarest words first
    d = t("documents").select("doc_id", "lang", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))).alias("s"))
    word = d.select("doc_id", "lang", F.explode("s").alias("w"))
    often = word.groupBy("lang", "w").agg(F.count("*").alias("n"))
    ranked = word.join(often, ["lang", "w"]).groupBy("doc_id", "lang").agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("r"))
    prefix = ranked.select("doc_id", "lang", F.explode(F.slice("r", 1, F.size("r") - F.ceil(F.size("r") * F.lit(0.35)).cast("int") + 1)).alias("p")).select("doc_id", "lang", "p.w")
    near = prefix.select(F.col("doc_id").alias("a"), "lang", "w").join(prefix.select(F.col("doc_id").alias("b"), "lang", "w"), ["lang", "w"]).where("a < b").select("a", "b").distinct()
    score = linkage.jaccard(F.col("x"), F.col("y"))
    return near.join(d.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a").join(d.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b").where(score >= 0.35).select("a", "b", F.round(score, 6).alias("score"))


@query("""SELECT o_orderkey, CASE WHEN n = 1 THEN c END AS claimed, CASE WHEN n = 1 THEN 'ok' ELSE 'duplicate_claim' END AS verdict FROM (SELECT o_orderkey, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)""")
def q36_claim_once(t):
    claims = t("orders").select("o_orderkey", F.col("o_custkey").alias("claimed"), "o_totalprice", F.lit("ok").alias("verdict"))
    return linkage.claim_once(claims, "claimed", [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", "claimed", "verdict")


@query("""WITH a AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    b AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role <> 'system')
    SELECT a.conv_id, a.pos, a.role, b.text FROM a JOIN b USING (conv_id, pos, n)""")
def q37_positional_align(t):
    c = t("conversations")
    done = linkage.positional_align(c.select("conv_id", "turn", "role"), c.where("role <> 'system'").select("conv_id", F.col("turn").alias("turn_r"), "text"), ["conv_id"], [F.col("turn")], [F.col("turn_r")])
    return done.select("conv_id", long(F.col("pos")).alias("pos"), "role", "text")


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996)""")
def q38_semi_anti_squad(t):
    of = lambda y: t("orders").where(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").select("c_custkey").join(of(1995), "c_custkey", "left_semi").join(of(1996), "c_custkey", "left_anti")


@query("""WITH r AS (SELECT p_brand, p_partkey, CASE WHEN p_size >= 40 THEN 0 ELSE 1 END AS tier FROM part), b AS (SELECT *, min(tier) OVER (PARTITION BY p_brand, p_partkey // 20) AS m FROM r),
    c AS (SELECT *, count(*) OVER (PARTITION BY p_brand, p_partkey // 20) AS n FROM b WHERE tier = m) SELECT p_partkey, CAST(tier AS INT) AS tier FROM c WHERE n = 1""")
def q39_strictest_unique(t):
    r = t("part").select("p_partkey", F.concat_ws("/", "p_brand", F.expr("p_partkey div 20")).alias("g"), F.when(F.col("p_size") >= 40, 0).otherwise(1).alias("tier"))
    return linkage.strictest_unique(r, "g", "tier").select("p_partkey", "tier")


# replay


@query("""WITH t AS (SELECT DISTINCT p_type FROM part), f AS (SELECT p_type, r_name, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
    SELECT p_type, r_name, coalesce(n, 0) AS n FROM t CROSS JOIN (SELECT r_name FROM region) LEFT JOIN f USING (p_type, r_name)""")
def q40_grid_cross(t):
    place = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "r_name")  # 25 and 5 rows by the schema
    lines = t("lineitem").join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(place, F.col("l_suppkey") == F.col("s_suppkey"))
    return replay.grid(t("part").select("p_type"), t("region").select("r_name"), lines.groupBy("p_type", "r_name").agg(F.count("*").alias("n")), ["p_type", "r_name"], ["n"])


BUDGET = """WITH o AS (SELECT n_regionkey AS region, o_orderkey, o_totalprice, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    b AS (SELECT *, 5e8 - coalesce(sum(o_totalprice) OVER (PARTITION BY region ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget FROM o) """


def _budget(t):
    where = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("region"))
    o = t("orders").join(where, F.col("o_custkey") == F.col("c_custkey"))
    return replay.budget_before(o, ["region"], [F.col("o_orderdate"), F.col("o_orderkey")], F.col("o_totalprice"), 5e8)


@query(BUDGET + "SELECT region, o_orderkey, round(budget, 2) AS budget_before, budget < 0 AS broke FROM b")
def q41_running_budget(t):
    return _budget(t).select("region", "o_orderkey", F.round("budget_before", 2).alias("budget_before"), (F.col("budget_before") < 0).alias("broke"))


@query("""SELECT o_orderkey, """ + ", ".join(f"CAST(sum((o_orderpriority = '{p}')::INT) OVER w AS BIGINT) AS \"left_{p[0]}\"" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM")) + """ FROM orders JOIN customer ON o_custkey = c_custkey
    WINDOW w AS (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def q42_pool_remaining(t):
    o = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    counts = {f"left_{p[0]}": F.when(F.col("o_orderpriority") == p, 1).otherwise(0) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM")}
    return replay.remaining(o, [F.col("o_orderdate"), F.col("o_orderkey")], counts, ["c_nationkey"]).select("o_orderkey", *counts)


@query("""WITH l AS (SELECT user_id, event_type, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1, 2) SELECT user_id, event_type, v[-1] AS last_value, CASE WHEN len(v) > 1 THEN v[-2] END AS previous_value FROM l""")
def q43_last_prev_bid(t):
    return replay.last_two(t("events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], "value")


@query("""SELECT event_id, list_filter(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), lambda x: x > value)[1] AS next_greater FROM events""")
def q44_next_greater(t):
    rows = t("events").select("event_id", "user_id", "ts", "value")
    return replay.next_greater(rows, ["user_id"], [F.col("ts"), F.col("event_id")], "value").select("event_id", "next_greater")


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS lot, event_type AS team, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS no, round(max(value) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS amt FROM events),
    n AS (SELECT *, list_filter(list(amt) OVER (PARTITION BY lot ORDER BY no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), lambda x: x > amt)[1] AS nx FROM e),
    k AS (SELECT lot, team, max_by(amt, no) AS last, max_by(nx, no) FILTER (nx IS NOT NULL) AS next FROM n GROUP BY 1, 2),
    l AS (SELECT lot, arg_max(team, no) AS declared, arg_max(amt, no) AS p, arg_min(amt, no) * 0.5 AS b FROM e GROUP BY 1),
    g AS (SELECT * FROM l CROSS JOIN (SELECT DISTINCT team FROM e UNION ALL SELECT 'none') LEFT JOIN k USING (lot, team)),
    x AS (SELECT *, CASE WHEN team = declared THEN 'right' WHEN last IS NULL THEN 'left' WHEN coalesce(next, p) <= last AND last >= p - 1e-6 THEN 'right' WHEN coalesce(next, p) <= last THEN 'unknown' ELSE 'interval' END AS label FROM g)
    SELECT lot, team, team = declared AS winner, label, CASE WHEN label = 'left' THEN 0.01 WHEN team = declared THEN p WHEN label IN ('right', 'interval') THEN last END AS lower,
    CASE WHEN label = 'left' THEN b WHEN team = declared THEN 2 * p WHEN label = 'right' THEN 2 * last WHEN label = 'interval' THEN coalesce(next, p) END AS upper FROM x""")
def q45_interval_labels(t):
    from pyspark.sql import Window

    by = Window.partitionBy("lot").orderBy("ts", "event_id")
    e = t("events").withColumn("lot", F.to_date("ts")).select("lot", F.col("event_type").alias("team"), F.row_number().over(by).alias("no"), F.round(F.max("value").over(by.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("amt"))
    lots = e.groupBy("lot").agg(F.max_by("team", "no").alias("declared"), F.max_by("amt", "no").alias("price"), (F.min_by("amt", "no") * 0.5).alias("base")).withColumn("status", F.lit("SOLD"))
    teams = e.select("team").distinct().union(e.sparkSession.createDataFrame([("none",)], "team string"))
    return replay.interval_labels(lots, teams, e, "lot", "team", "no", "amt")


def _tags():
    return F.array(F.concat(F.lit("type:"), F.col("p_type")), F.concat(F.lit("size:"), exprs.bucket(F.col("p_size"), PHASES, "late")))


SCARCE = """WITH g AS (SELECT p_partkey, unnest(['type:' || p_type, 'size:' || CASE WHEN p_size <= 16 THEN 'early' WHEN p_size <= 33 THEN 'middle' ELSE 'late' END]) AS tag FROM part),
    o AS (SELECT l_partkey, n_regionkey AS region FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE year(o_orderdate) = 1996),
    s AS (SELECT tag, count(*) AS supply FROM g WHERE p_partkey NOT IN (SELECT l_partkey FROM o) GROUP BY 1),
    h AS (SELECT region, tag, count(*) AS n FROM o JOIN g ON l_partkey = p_partkey GROUP BY 1, 2),
    m AS (SELECT tag, floor(avg(n)) AS target FROM h GROUP BY 1),
    d AS (SELECT tag, CAST(sum((coalesce(n, 0) < target)::INT) AS BIGINT) AS demand FROM region CROSS JOIN m LEFT JOIN h ON h.region = r_regionkey AND h.tag = m.tag GROUP BY 1),
    c AS (SELECT tag, demand, coalesce(supply, 0) AS supply, CAST(demand AS DOUBLE) / greatest(coalesce(supply, 0), 1) AS scarcity FROM d LEFT JOIN s USING (tag)) """.replace("SELECT tag, CAST(sum((coalesce", "SELECT m.tag, CAST(sum((coalesce")


def _scarce(t):
    g = tags.exploded(t("part"), "p_partkey", _tags())
    where = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("region"))
    o = t("orders").where(F.year("o_orderdate") == 1996).join(where, F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem").select("l_orderkey", "l_partkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("region", F.col("l_partkey").alias("p_partkey"))
    bought = o.join(g, "p_partkey").groupBy("region", "tag").agg(F.count("*").alias("n"))
    targets = bought.groupBy("tag").agg(F.floor(F.avg("n")).alias("target"))
    left = tags.supply(g.join(o, "p_partkey", "left_anti"))
    return g, tags.scarcity(tags.demand(bought, t("region").select(F.col("r_regionkey").alias("region")), "region", targets), left)


@query(SCARCE + "SELECT tag, demand, supply, round(scarcity, 8) AS scarcity FROM c")
def q46_demand_scarcity(t):
    return _scarce(t)[1].select("tag", "demand", "supply", F.round("scarcity", 8).alias("scarcity"))


@query(SCARCE + "SELECT p_partkey, round(min(scarcity), 8) AS scarcity_min, round(max(scarcity), 8) AS scarcity_max, round(avg(scarcity), 8) AS scarcity_mean FROM g JOIN c USING (tag) GROUP BY 1")
def q47_focus_minmaxmean(t):
    g, scarce = _scarce(t)
    done = tags.focus(g, "p_partkey", scarce, "scarcity")
    return done.select("p_partkey", *(F.round(c, 8).alias(c) for c in done.columns[1:]))


@query(BUDGET + "SELECT region, round(sum(greatest(o_totalprice - budget, 0)), 2) AS shortfall, CAST(sum((o_totalprice > budget)::INT) AS BIGINT) AS n_short FROM b GROUP BY 1")
def q48_affordability(t):
    return replay.shortfall(_budget(t), ["region"], "budget_before", "o_totalprice").withColumn("shortfall", F.round("shortfall", 2))


@query("""WITH g AS (SELECT p_partkey, p_type AS a, CASE WHEN p_size <= 16 THEN 'early' WHEN p_size <= 33 THEN 'middle' ELSE 'late' END AS b FROM part)
    SELECT x.p_partkey, count(*) AS n_sharing FROM g x JOIN g y ON x.a = y.a OR x.b = y.b GROUP BY 1""")
def q49_sharing_tags(t):
    return tags.sharing(tags.exploded(t("part"), "p_partkey", _tags()), "p_partkey")


# encodings and metrics


@query("""SELECT p_partkey, code FROM part JOIN (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)) USING (p_brand)""")
def q50_label_encode(t):
    return encode.label_encode(t("part"), "p_brand", encode.vocabulary(t("part"), "p_brand"), "code").select("p_partkey", "code")


@query("""SELECT c_custkey, """ + ", ".join(f"CAST(c_mktsegment = '{s}' AS DOUBLE) AS \"c_mktsegment={s}\"" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def q51_one_hot_capped(t):
    return encode.one_hot(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment").drop("c_mktsegment")


@query("""WITH x AS (SELECT 'o_totalprice' AS feature, o_totalprice AS x FROM orders UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem),
    s AS (SELECT feature, min(x) >= 0 AND quantile_cont(x, .99) > 50 AND quantile_cont(x, .99) > 3 * (quantile_cont(x, .5) + 1) AS log FROM x GROUP BY 1)
    SELECT feature, log, round(avg(CASE WHEN log THEN ln(1 + greatest(x, 0)) ELSE x END), 4) AS mean, round(stddev_pop(CASE WHEN log THEN ln(1 + greatest(x, 0)) ELSE x END), 4) AS std FROM x JOIN s USING (feature) GROUP BY 1, 2""")
def q52_scaler_params(t):
    done = encode.scaler_params(t("orders"), ["o_totalprice"]).unionByName(encode.scaler_params(t("lineitem"), ["l_quantity", "l_discount"]))
    return done.select("feature", "log", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("""WITH e AS (SELECT o_orderpriority, list_sort(list_distinct(quantile_cont(o_totalprice, [0, 1/6, 2/6, 3/6, 4/6, 5/6, 1]))) AS e FROM orders GROUP BY 1)
    SELECT o_orderkey, len(list_filter(e[2:-2], lambda x: x < o_totalprice)) AS bin FROM orders JOIN e USING (o_orderpriority)""")
def q53_quantile_bins(t):
    return encode.quantile_bins(t("orders"), "o_totalprice", 6, ["o_orderpriority"]).select("o_orderkey", "bin")


@query("""WITH n AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1), k AS (SELECT sum(n) AS a, count(*) AS k FROM n)
    SELECT o_orderkey, round(CAST(a AS DOUBLE) / (k * n), 8) AS weight FROM orders JOIN n USING (o_orderstatus), k""")
def q54_strata_weights(t):
    return encode.strata_weights(t("orders"), "o_orderstatus").select("o_orderkey", F.round("weight", 8).alias("weight"))


@query("""WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS m FROM lineitem GROUP BY 1) SELECT l_returnflag, round(m, 4) AS median, round(median(abs(l_extendedprice - m)), 4) AS mad FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1, m""")
def q55_mad(t):
    return metrics.mad(t("lineitem"), "l_extendedprice", ["l_returnflag"]).select("l_returnflag", F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"))


@query("""SELECT round(corr(a, b), 6) AS rho FROM (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)""")
def q56_spearman(t):
    return metrics.spearman(t("lineitem"), "l_quantity", "l_extendedprice").select(F.round("rho", 6).alias("rho"))


@query("""SELECT o_orderpriority, """ + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 4) AS p{int(p * 100):02d}" for p in (0.01, 0.05, 0.5, 0.95, 0.99)) + " FROM orders GROUP BY 1")
def q57_quantile_profile(t):
    done = metrics.profile(t("orders"), "o_totalprice", ["o_orderpriority"])
    return done.select("o_orderpriority", *(F.round(c, 4).alias(c) for c in done.columns[1:]))


@query("""SELECT o_orderpriority, o_orderstatus, round(median(o_totalprice), 4) AS median, round(max(o_totalprice) - min(o_totalprice), 4) AS spread FROM orders GROUP BY 1, 2""")
def q58_config_compare(t):
    return metrics.spread(t("orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice").select("o_orderpriority", "o_orderstatus", F.round("median", 4).alias("median"), F.round("spread", 4).alias("spread"))


@query("""WITH e AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [0, .25, .5, .75, 1]))) AS e FROM lineitem), b AS (SELECT len(list_filter(e[2:-2], lambda x: x < l_quantity)) AS bin, l_extendedprice AS v FROM lineitem, e)
    SELECT bin, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(median(v), 4) AS median FROM b GROUP BY 1""")
def q59_trend_by_bin(t):
    done = metrics.by_bin(encode.quantile_bins(t("lineitem"), "l_quantity", 4), ["bin"], "l_extendedprice")
    return done.select("bin", "n", *(F.round(c, 4).alias(c) for c in ("mean", "std", "median")))


# quality


@query("""SELECT 'negative_price' AS check, 'error' AS severity, count_if(o_totalprice < 0) AS value FROM orders UNION ALL SELECT 'no_date', 'error', count_if(o_orderdate IS NULL) FROM orders
    UNION ALL SELECT 'open', 'info', count_if(o_orderstatus = 'O') FROM orders UNION ALL SELECT 'repeated_line', 'warning', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def q60_findings_keys(t):
    told = checks.findings(t("orders"), {"negative_price": ("error", F.col("o_totalprice") < 0), "no_date": ("error", F.col("o_orderdate").isNull()), "open": ("info", F.col("o_orderstatus") == "O")})
    twice = checks.duplicate_keys(t("lineitem"), ["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("value"))
    return told.unionByName(twice.select(F.lit("repeated_line").alias("check"), F.lit("warning").alias("severity"), "value"))


@query("""SELECT o_custkey, coalesce(bool_or(o_totalprice < p), false) AS falls, CAST(coalesce(sum((o_totalprice < p)::INT), 0) AS BIGINT) AS n_falls FROM (SELECT o_custkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) GROUP BY 1""")
def q61_monotone_check(t):
    return checks.falling(t("orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], "o_totalprice")


@query("""SELECT count(*) AS n, CAST(sum((abs(o_totalprice - coalesce(s, 0)) >= 1)::INT) AS BIGINT) AS n_differ FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def q62_reconcile_sum(t):
    told = checks.reconcile(t("orders"), t("lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "o_totalprice", F.col("l_extendedprice"), 1)
    return told.agg(F.count("*").alias("n"), F.sum(F.col("differs").cast("int")).alias("n_differ"))


@query("""SELECT lang, count(*) AS n, round(100 * avg(CAST(l.doc_id IS NOT NULL AS DOUBLE)), 1) AS percent FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def q63_coverage_by_group(t):
    joined = t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", F.lit(True).alias("labelled")), "doc_id", "left")
    return fold.group_profile(joined, "lang", F.coalesce("labelled", F.lit(False)))


@query("""SELECT o_custkey, n, round(cost, 2) AS cost FROM (SELECT o_custkey, count(*) AS n, max(o_totalprice) * count(*) AS cost FROM orders GROUP BY 1) ORDER BY cost DESC, o_custkey LIMIT 20""")
def q64_topk_cost(t):
    g = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), (F.max("o_totalprice") * F.count("*")).alias("cost"))
    return g.orderBy(F.desc("cost"), "o_custkey").limit(20).withColumn("cost", F.round("cost", 2))


@query("""WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS y, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1, 2), e AS (SELECT y, lag(y) OVER (ORDER BY y) AS p FROM (SELECT DISTINCT y FROM y))
    SELECT a.o_custkey, a.y, m.measure, CASE m.measure WHEN 'n' THEN CAST(b.n AS DOUBLE) ELSE b.total END AS before, CASE m.measure WHEN 'n' THEN CAST(a.n AS DOUBLE) ELSE a.total END AS now
    FROM y a JOIN e ON a.y = e.y JOIN y b ON b.o_custkey = a.o_custkey AND b.y = e.p, (VALUES ('n'), ('total')) m(measure) WHERE CASE m.measure WHEN 'n' THEN a.n < b.n ELSE a.total < b.total END""")
def q65_edition_regressions(t):
    y = t("orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))
    return checks.regressions(y, "o_custkey", "y", ["total", "n"])
