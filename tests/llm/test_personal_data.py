"""Personal data against plain patterns, and against the query's SQL."""

import hashlib
import random
import re
import time

import duckdb
import pandas
from helpers import SCHEMA, by_repr, rows, table

from pyspark.sql import functions as F
from tidemark.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        twice = [sum(map(int, str(int(d) * (1 + i % 2)))) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def noisy(n=1500, seed=5):
    rng = random.Random(seed)
    bits = ["a", "é", "@", ".", "..", "_", "%", "+", "-", " ", "  ", "(", ")", "\n", "0", "1", "12", "255", "256", "0001", "4111 1111 1111 1111", "5500-0000-0000-0004", "x@y.z", "b.c@d.e-f.g", "1.2.3.4", "+1 (017) 555-7713", "漢", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "ssn", "078-05-1120", " social security ", "item", "AB12"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def digest(found):
    done = found.select("doc_id", *(pii.counted(k).alias(f"n_{k}") for k in pii.BASE), F.sha2(pii.listed(pii.BASE), 256).alias("base_sha256"), pii.listed().alias("spans"))
    return done.collect()


def test_base_spans(spark):
    found = rows() + [(1000 + i, t, "en", "a", 0) for i, t in enumerate(noisy())] + [(None, "me@here.org", None, None, None), (7, "me@here.org", "en", "a", 0)]
    want = []
    for d, t, *_ in found:
        spans = base(t)
        want.append((d, *(sum(s[0] == k for s in spans) for k in PLAIN), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
    got = [tuple(r)[:-1] for r in digest(pii.personal_data(table(spark, found)))]
    assert by_repr(got) == by_repr(want)


def test_as_its_sql(spark):
    found = [(i, t, "en", "a", 0) for i, t in enumerate(noisy(3000, seed=9))] + [(-1, None, None, None, None)]
    documents = pandas.DataFrame(found, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    want = duckdb.sql(queries.ORACLE_SQL["op11_personal_data"]).fetchall()
    assert by_repr(digest(pii.personal_data(spark.createDataFrame(found, SCHEMA)))) == by_repr(want)
    assert sum("iban" in r[-1] for r in want) > 20 and sum("ssn" in r[-1] for r in want) > 20


def test_checksums_and_words():
    spans = lambda t: {(k, t[a:b]): s for kind in pii.KINDS for k, a, b, s in kind.scored(t)}
    assert spans("pay to IBAN DE89 3704 0044 0532 0130 00 now") == {("iban", "DE89 3704 0044 0532 0130 00"): 1.0}
    assert spans("pay to DE88 3704 0044 0532 0130 00 now") == {}
    assert spans("his SSN: 078-05-1120") == {("ssn", "078-05-1120"): 0.6}
    assert spans("code 078-05-1120") == {} and spans("ssn 666-05-1120") == {} and spans("ssn of part 078-05-1120") == {}
    assert spans("visa 4111 1111 1111 1111")[("card", "4111 1111 1111 1111")] > spans("sent 4111 1111 1111 1111")[("card", "4111 1111 1111 1111")]
    assert spans("version 1.2.3.4") == {("ip", "1.2.3.4"): 0.3}


def test_masked(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.de, call +1 (017) 555-7713!", "en", "a", 0), (2, None, None, None, None)], SCHEMA)
    assert dict(pii.personal_data(docs, masked=True).select("doc_id", "masked").collect()) == {1: "mail [email], call [phone]!", 2: ""}
    assert pii.personal_data(docs.limit(0), masked=True).collect() == []


def test_time_follows_length(spark):
    n = 2_000_000
    awkward = ["9" * n, "a" * n, "1.1" * (n // 3), "1 " * (n // 2), "1.2.3.4." * (n // 8), "@" * n, "a@b" * (n // 3), "+1 " * (n // 3), "+1" + " 1" * (n // 2), "AB12 " * (n // 5), "A" * n, "%@a." * (n // 4), "é1-" * (n // 3)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(awkward)], SCHEMA)
    began = time.time()
    got = {r.doc_id: r.n_ip for r in digest(pii.personal_data(docs))}
    assert time.time() - began < 60 and got[4] == n // 8
