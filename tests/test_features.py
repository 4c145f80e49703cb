"""Feature rows of a roster, the register and who is left of a squad, on small tables of our own."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import features
from tidemark.plans import register


def test_roster_rows_without_person_or_history(spark):
    roster = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,)], "id int")
    walk = spark.createDataFrame([(1, "a"), (2, None), (3, "z"), (4, "b")], "id int, who string")
    table = spark.createDataFrame([("a", 5, 2.5), ("b", 0, None)], "who string, n int, rate double")
    asked = ({"n": F.col("n")}, {"rate": F.col("rate")})
    rows = {r["id"]: tuple(r)[1:] for r in features.for_roster(roster, walk, table, "id", "who", *asked, fill=-1.0).collect()}
    assert rows == {1: (1.0, 5.0, 2.5, 0.0), 2: (0.0, 0.0, -1.0, 1.0), 3: (0.0, 0.0, -1.0, 1.0), 4: (1.0, 0.0, -1.0, 1.0)}
    assert features.for_roster(roster.limit(0), walk, table, "id", "who", *asked).count() == 0
    with pytest.raises(PySparkException):
        features.for_roster(roster, walk.union(walk), table, "id", "who", *asked).collect()


PEOPLE = [("p1", "A Reed", "A Reed"), ("p2", "B Moss", "B Moss|Bo Moss"), ("p3", "C Fenn", None)]


def test_register(spark):
    people = spark.createDataFrame(PEOPLE, "person_id string, canonical_name string, name_variants string")
    known = spark.createDataFrame([("p1", "A Reed", "A Reed (2)", "11", None), ("p2", " Bo Moss ", " ", "12", "7")], "identifier string, name string, unique_name string, key_cricinfo string, key_cricbuzz string")
    rows = {r["person_id"]: r for r in register.merge_register(people, known).collect()}
    assert (rows["p1"]["canonical_name"], rows["p1"]["name_variants"], rows["p1"]["n_variants"]) == ("A Reed (2)", "A Reed|A Reed (2)", 2)
    assert (rows["p2"]["canonical_name"], rows["p2"]["name_variants"], rows["p2"]["key_cricbuzz"]) == ("B Moss", "B Moss|Bo Moss", "7")
    assert (rows["p3"]["canonical_name"], rows["p3"]["n_variants"], rows["p3"]["key_cricinfo"]) == ("C Fenn", 0, None)
    assert all(r["key_cricinfo"] is None for r in register.merge_register(people, None).collect())
    with pytest.raises(ValueError, match="key_cricbuzz"):
        register.merge_register(people, known.drop("key_cricbuzz"))


def test_residue(spark):
    asked = spark.createDataFrame([(1, "no_match"), (2, "conflict"), (3, None), (4, "no_match"), (5, "no_match")], "player int, reason string")
    listed = spark.createDataFrame([(1, "21", "X"), (2, "21", "X"), (3, "21", "Y"), (4, "30", "X"), (5, "21", "X"), (5, "22", "X")], "player int, season string, team string")
    squads = spark.createDataFrame([("21", "X", "u"), ("21", "X", "v"), ("21", "Y", "v"), ("22", "X", "w")], "season string, team string, person string")
    done = register.residue(asked, listed, squads, spark.createDataFrame([("v",)], "person string"))
    rows = {r[0]: tuple(r)[1:] for r in done.collect()}
    assert rows == {1: ("residue_hit", ["u"], True), 2: ("fixable", [], False), 3: ("no_t20_record", [], False), 4: ("inconclusive", [], False), 5: ("residue_hit", ["u", "w"], True)}
