import numpy as np
import pytest

from pyspark.sql import functions as F
from tidemark.plans import evaluation, identity
from tidemark.sources import io

PEOPLE = [("ab", "RK Mason|R Mason"), ("cd1", "TU Porter"), ("cd2", "TU Porter"), ("ef", "GV Tanner"), ("jos", "José Maria Santos")]


def test_roster(spark):
    index = identity.name_index(spark.createDataFrame(PEOPLE, "person_id string, variants string"))
    roster = spark.createDataFrame([(1, "RK Mason", 0), (2, "R Mason", 0), (3, "GV  Tanner", 0), (4, "TU Porter", 0), (5, "Nobody At All", 0), (6, "J M Santos", 0), (7, "Pedro Santos", 0), (8, "RK Mason", 0), (8, "GV Tanner", 1)], "player_id int, spelling string, ord int")
    found = identity.candidates(roster, index).cache()
    got = {r.player_id: (r.person_id, r.method) for r in identity.resolve_players(roster, found).collect()}
    assert got == {1: ("ab", "exact"), 2: ("ab", "exact"), 3: ("ef", "normalised"), 4: (None, "ambiguous"), 5: (None, "unresolved"), 6: ("jos", "signature"), 7: (None, "unresolved"), 8: (None, "conflict")}
    members = identity.squads(spark.createDataFrame([("2019/20", "Reds", "cd2"), ("2019", "Reds", "ef")], "season string, team string, person_id string"), spark.createDataFrame([("Reds", "R")], "team string, franchise string"))
    backed = identity.with_evidence(found, spark.createDataFrame([(4, "2019", "R"), (8, "2019", "R")], "player_id int, season string, franchise string"), members)
    overrides = spark.createDataFrame([(5, "ab", "map"), (2, None, "block")], "player_id int, person_id string, action string")
    got = {r.player_id: (r.person_id, r.method) for r in identity.resolve_players(roster, backed, overrides).collect()}
    assert got[4] == ("cd2", "exact+squad") and got[8] == ("ef", "spelling_conflict+squad")
    assert got[5] == ("ab", "override") and got[2] == (None, "blocked")
    twice = identity.collisions(spark.createDataFrame(list((k, *v) for k, v in got.items()), "player_id int, person_id string, method string")).collect()
    assert {(r.person_id, r.players) for r in twice} == {("ab", "1|5"), ("ef", "3|8")}


def test_last_salary(spark):
    rows = spark.createDataFrame([(1, "2019"), (1, "2018"), (2, "2019")], "player_id int, season string")
    history = spark.createDataFrame([(1, "2018", 10.0), (1, "2018", 12.0), (1, "2019", 50.0)], "player_id int, season string, amount double")
    got = {(r.player_id, r.season): (r.last_salary, r.last_salary_is_missing) for r in identity.last_salary(rows, history).collect()}
    assert got == {(1, "2019"): (12.0, 0.0), (1, "2018"): (0.0, 1.0), (2, "2019"): (0.0, 1.0)}


def test_evaluation(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i), 1.0 + i, 0.5 + i, 3.0 + i, "interval") for i in range(60)], "k int, a double, b double, price double, lower double, upper double, label string")
    layers = [(np.array([[0.1], [0.2]]), np.array([0.1])), (np.array([[0.3, -0.1]]), np.array([0.2, 0.0]))]
    done = evaluation.score(df, ["a", "b"], layers, "k")
    for r in done.join(df, "k").collect():
        h = max(0.0, 0.1 * r.a + 0.2 * r.b + 0.1)
        assert r.mu == pytest.approx(0.3 * h + 0.2) and 0.05 < r.sigma < 1.5
    row = evaluation.summary(evaluation.predictions(df.join(done, "k"))).first()
    assert row.n == 60 and row.rho > 0.9 and 0 <= row.within_interval <= 1
    # a constant bias has no spread
    flat = df.withColumn("mu", F.ln(F.col("price") * 2)).withColumn("sigma", F.lit(1.0))
    row = evaluation.summary(evaluation.predictions(flat)).first()
    assert row.mad == pytest.approx(0, abs=1e-9) and row.bias == pytest.approx(np.log(2))
    weights = evaluation.training_rows(df.unionByName(df.withColumn("label", F.lit("unknown"))))
    assert weights.count() == 60 and weights.agg(F.sum("weight")).first()[0] == pytest.approx(60)


def test_sinks(spark, tmp_path):
    """A review file has every row; a table is built once."""
    df = spark.range(3000).selectExpr("id", "concat('a \"quoted\", word\n', id) as text")
    io.write_review(df, str(tmp_path / "review"))
    assert len(list((tmp_path / "review").glob("*.csv"))) == 1
    assert io.read_csv(spark, str(tmp_path / "review")).count() == 3000
    built = []
    build = lambda: built.append(1) or df
    assert io.prepared(spark, str(tmp_path / "t"), build).count() == io.prepared(spark, str(tmp_path / "t"), build).count() == 3000
    assert built == [1]
