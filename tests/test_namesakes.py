"""Names that many have: resolved by ranges of persons as by all pairs, without making the pairs."""

import random

from tidemark.plans import identity

ROSTER, PEOPLE = "player_id int, spelling string, ord int", "person_id string, variants string"


def test_ranges_resolve_as_pairs(spark):
    pick = random.Random(4)
    first, last = ["Al", "Alan", "Bo", "AB", "A", "José", "B"], ["Smith", "Lee", "Lee-Smith", "van Dyk", "Roy", "Kent", "Ali", ""]
    name = lambda: f"{pick.choice(first)} {pick.choice(last)}"
    people = spark.createDataFrame([(f"p{i}", "|".join({name(), name()})) for i in range(25)], PEOPLE)
    roster = spark.createDataFrame([(i, s, n) for i in range(60) for n, s in enumerate(sorted({name(), name()}))], ROSTER)
    seen = spark.createDataFrame([(i, "1", "f") for i in range(0, 60, 2)], "player_id int, season string, franchise string")
    members = spark.createDataFrame([("1", "f", f"p{i}") for i in range(0, 25, 6)], "season string, franchise string, person_id string")
    index = identity.name_index(people).cache()
    pairs = identity.candidates(roster, index)
    rows = lambda found: sorted(tuple(r) for r in identity.resolve_players(roster, found).collect())
    plain = rows(pairs)
    assert rows(identity.alike(roster, index)) == plain and len({r[2] for r in plain}) >= 3
    backed = rows(identity.with_evidence(pairs, seen, members))
    assert rows(identity.alike(roster, index, identity.seen_together(seen, members))) == backed != plain


def test_namesakes_are_no_pairs(spark):
    people = spark.createDataFrame([(f"p{i}", f"Supplier#{i}") for i in range(400)], PEOPLE)
    roster = spark.createDataFrame([(i, f"Supplier#{i}", 0) for i in range(380, 420)], ROSTER)
    found = identity.alike(roster, identity.name_index(people))
    assert found.count() < 200  # 40 x 400 pairs
    got = {r.player_id: (r.person_id, r.method) for r in identity.resolve_players(roster, found).collect()}
    assert got[380] == ("p380", "exact") and got[419] == (None, "ambiguous")
