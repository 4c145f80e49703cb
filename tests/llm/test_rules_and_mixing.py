import duckdb
import pytest
from helpers import SCHEMA, by_repr, rows, table, words

from pyspark.sql import functions as F
from tidemark.llm import mixing, quality_classifier, quality_rules
from tidemark.llm.queries import ORACLE_SQL


def repeated(w, width=5):
    at = {}
    for i in range(len(w) - width + 1):
        at.setdefault(tuple(w[i : i + width]), []).append(i)
    return len({i + j for v in at.values() if len(v) > 1 for i in v for j in range(width)})


def test_rules(spark):
    want = []
    for d, t, *_ in rows():
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        n = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in quality_rules.SYMBOLS), len(lines) - len(set(lines)), repeated(w))
        base = n[0] < 10 or 100 * n[4] > 20 * n[0]
        other = 10 * n[2] > 3 * n[1] or (len(lines) >= 4 and 10 * n[3] > 7 * len(lines)) or (n[0] > 0 and n[1] > 40 * n[0])
        want.append((d, *n, base, not base and not other))
    got = quality_rules.quality_rules(table(spark)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert by_repr(got) == by_repr(want)


def test_ablation(spark):
    found = quality_rules.ledger(table(spark)).cache()
    masks = [r.failed for r in found.collect()]
    mask = quality_rules.STANDARD.mask()
    for r in quality_rules.ablation(found, quality_rules.STANDARD).collect():
        bit = 1 << next(x.bit for x in quality_rules.RULES if x.name == r.rule)
        assert (r.fails, r.alone, r.kept_without) == (sum(m & bit > 0 for m in masks), sum(m & mask == bit for m in masks), sum(m & mask & ~bit == 0 for m in masks))
        assert r.documents == len(masks) and r.policy == "standard-1"


def test_mixing_matches_sql(spark):
    found = [r for r in rows() if r[0] is not None]
    documents = __import__("pandas").DataFrame(found, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    want = duckdb.sql(ORACLE_SQL["op4_mixing"]).fetchall()
    got = mixing.mix(table(spark, found)).select("doc_id", "tokens", F.round("rate", 6), "copies").collect()
    assert by_repr(got) == by_repr(want)


def test_raking_meets_targets(spark):
    docs = spark.createDataFrame([(i, "x" * (40 + i % 90), ("en", "de")[i % 3 == 0], "abc"[min(i % 5, 2)], 0) for i in range(900)], SCHEMA)
    share = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    want = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.4, "de": 0.6}}
    dims = {"source": F.col("source"), "lang": F.col("lang")}
    done = mixing.mix(docs, dims=dims, targets={k: share(v) for k, v in want.items()}, rounds=30)
    joined = done.join(docs.select("doc_id", "source", "lang"), "doc_id").cache()
    total = joined.agg(F.sum(F.col("tokens") * F.col("rate"))).first()[0]
    for name, shares in want.items():
        for value, s in shares.items():
            got = joined.where(F.col(name) == value).agg(F.sum(F.col("tokens") * F.col("rate"))).first()[0]
            assert got / total == pytest.approx(s, abs=1e-4)
    drawn = joined.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
    assert drawn == pytest.approx(total, rel=0.1)


def corpus(spark, n=400):
    import random

    rng = random.Random(8)
    good, bad = [f"good{i}" for i in range(80)], [f"bad{i}" for i in range(80)]
    out = []
    for i in range(n):
        is_bad = i % 5 == 0
        out.append((i, " ".join(rng.choice(bad if is_bad and rng.random() < 0.8 else good) for _ in range(rng.randint(40, 90))), "en", "a", 0))
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, n, 2)], "doc_id long, quality int, toxic int")
    return spark.createDataFrame(out, SCHEMA), labels, n


def test_classifier_on_held_out_labels(spark):
    docs, labels, n = corpus(spark)
    kept = {r.doc_id: r.kept for r in quality_classifier.quality_classifier(docs, labels).collect()}
    odd = range(1, n, 2)
    assert sum(kept[i] for i in odd if i % 5) >= 0.99 * sum(1 for i in odd if i % 5)
    assert sum(kept[i] for i in odd if i % 5 == 0) <= 0.05 * sum(1 for i in odd if i % 5 == 0)


def test_classifier_on_awkward_rows(spark):
    labels = spark.createDataFrame([(i, i % 4 and 1, 0) for i in range(60)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    done = quality_classifier.quality_classifier(table(spark), labels).collect()
    assert len(done) == len(rows())
    assert {r.n_grams for r in done if r.doc_id in (120, 121, 122)} == {0}
    none = quality_classifier.quality_classifier(table(spark), labels.limit(0)).collect()
    assert all(r.kept for r in none)
    assert quality_classifier.quality_classifier(spark.createDataFrame([], SCHEMA), labels).count() == 0


def test_cut_off(spark):
    df = spark.createDataFrame([(float(x % 37) + x * 1e-9,) for x in range(1000)], "key double")
    keys = sorted((r.key for r in df.collect()), reverse=True)
    for k in (1, 10, 500, 999, 1000):
        assert df.where(F.col("key") >= quality_classifier.cut_off(df, k)).count() == k
        assert quality_classifier.cut_off(df, k) == keys[k - 1]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality_rules.quality_rules(empty).count() == 0
    assert mixing.mix(empty).count() == 0


def test_classifier_matches_brute_force(spark):
    """Scores and kept set by plain Python sums over the same hash of words and pairs."""
    import math
    from collections import Counter

    import numpy as np

    from tidemark.llm import _kit

    buckets, found = 512, [r for r in rows() if r[0] is not None][:-1]
    labels = [(i, int(i % 10 != 3)) for i in range(0, 120)]

    def grams(text):
        w = words(text)
        if not w:
            return []
        h = np.concatenate([_kit.span_hashes(b := np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(b)])) for x in w])
        return [int(x >> np.uint64(20)) % buckets for x in (*h, *_kit.sequence_hashes(h, 2))]

    docs = spark.createDataFrame(found, SCHEMA)
    sampler, keys = quality_classifier.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"), buckets=buckets)
    order = [r.id for r in spark.createDataFrame(labels, "id long, quality int").orderBy(F.xxhash64(F.lit(7), F.col("id")), "id").collect()]
    good = [i for i in order if dict(labels)[i]]
    text, raw, wanted = {r[0]: r[1] for r in found}, Counter(), Counter()
    for d in text:
        raw.update(grams(text[d]))
    for d in good[::2]:
        wanted.update(grams(text[d]))
    prior = {b: (raw[b] + 1) / (sum(raw.values()) + buckets) for b in range(buckets)}
    ratio = {b: math.log((wanted[b] + buckets / 4 * prior[b]) / (sum(wanted.values()) + buckets / 4) / prior[b]) for b in range(buckets)}
    score = {d: sum(ratio[b] for b in grams(text[d])) / (len(grams(text[d])) + quality_classifier.PRIOR) for d in text}
    got = {r.id: r for r in keys.collect()}
    for d in text:
        assert got[d].log_ratio == pytest.approx(score[d], abs=1e-9) and got[d].n_grams == len(grams(text[d]))
    held = sorted(score[d] for d in good[1::2])
    least = min(held[0], np.mean(held) - (3.2905267 + 1.6448536 * (1 / len(held) + 3.2905267**2 / (2 * len(held))) ** 0.5) * np.std(held, ddof=1))
    k = sum(score[d] >= least - 1e-12 for d in text)
    noise = {r.doc_id: r.g for r in docs.select("doc_id", quality_classifier.gumbel("doc_id", 7).alias("g")).collect()}
    best = sorted(text, key=lambda d: -(score[d] / quality_classifier.TEMPERATURE + noise[d]))[:k]
    kept = {r.doc_id for r in quality_classifier.resampled(docs, sampler).where("kept").collect()}
    assert kept == set(best) and 0 < len(kept) < len(text)


def test_equal_texts_score_alike(spark):
    """Whatever is beside them, and with noise by id alone."""
    docs = spark.createDataFrame([(i, ("good words " * 20 if i % 3 else f"x{i} " * i), "en", "a", 0) for i in range(90)], SCHEMA).repartition(7)
    _, keys = quality_classifier.fit(docs, spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int"))
    assert len({r.log_ratio for r in keys.where("id % 3 <> 0").collect()}) == 1


def test_one_rule_for_any_number_of_labels():
    """The limit moves little from one size to the next, lies deeper for few labels, and never over the quantile."""
    import numpy as np

    draw = np.random.default_rng(12).normal(0.3, 0.05, 200_000)
    bound = lambda n: quality_classifier.lower_bound(sorted(draw[:n].tolist()), 0.0005)
    assert bound(1999) == pytest.approx(bound(2001), abs=1e-3)
    assert bound(50) < bound(1999) < bound(200_000) < 0.3 - 3.2 * 0.05
    for n in (2, 50, 1999, 2001, 10_000):
        assert bound(n) <= sorted(draw[:n])[int(0.0005 * n)]
    assert quality_classifier.lower_bound([0.5], 0.0005) == 0.5 and quality_classifier.lower_bound([], 0.0005) == float("-inf")
