import hashlib
from collections import Counter

import numpy as np
import pytest
from helpers import SCHEMA, by_repr, near, rows, table, without_repeats

from tidemark.llm import _kit, minhash
from tidemark.llm.components import components
from tidemark.llm.exact_dedup import cut_points, exact_dedup
from tidemark.llm.substring import without_repeats as cut


@pytest.mark.parametrize("digest_bytes", [16, 1])
def test_exact(spark, digest_bytes, monkeypatch):
    """Digests of one byte collide, which the chunks' contents must settle; all groups are hot."""
    monkeypatch.setattr("tidemark.llm._kit.HOT_ROWS", 2)
    monkeypatch.setattr("tidemark.llm._kit.HOT_SHARE", 0.0001)
    found = rows()
    count = Counter(r[1] or "" for r in found)
    top = {}
    for d, t, *_ in found:
        if d is not None:
            top[t or ""] = max(top.get(t or "", -1), d)
    want = [(d, top.get(t or ""), count[t or ""], d == top.get(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in found]
    got = exact_dedup(table(spark), bits=8, digest_bytes=digest_bytes).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert by_repr(got) == by_repr(want)


def test_equal_texts_are_cut_alike():
    rng = np.random.default_rng(1)
    text, other = rng.integers(97, 123, 60_000, np.uint8), rng.integers(97, 123, 777, np.uint8)
    data, offs = np.r_[other, text, text], np.array([0, 777, 60_777, 120_777])
    _, one, two = cut_points(data, offs)
    assert one == two and len(one) > 5 and one[-1] == 60_000
    # an insertion changes the chunks around it only
    edited = cut_points(np.r_[text[:30_000], other[:3], text[30_000:]], np.array([0, 60_003]))[0]
    sizes = lambda e: {(a, b - a) for a, b in zip([0, *e], e)}
    assert len(sizes(one) & sizes(edited)) > 1


def test_near(spark):
    want = [(d, n, c, d is not None and d == c) for d, n, c in near(rows())]
    got = minhash.near_duplicates(table(spark)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert by_repr(got) == by_repr(want)


def thue_morse(n):
    """A word of 2 ** n letters a and b, and the same with the letters swapped."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_near_words_that_polynomials_confuse(spark):
    """Sums of letters times powers of an odd number modulo 2 ** 64 are equal for these words."""
    found = []
    for size in (8, 11, 12):
        one, other = thue_morse(size)
        found += [(len(found), f"{one} x y", "en", "a", 0), (len(found) + 1, f"{other} x y", "en", "a", 0)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, found)).collect()}
    assert got == {i: i for i in range(6)}


def test_near_large_groups(spark, monkeypatch):
    """Groups in different components meet by prefixes, under a sketch that tells rare from frequent badly; all keys are hot."""
    for name, value in (("minhash.SKETCH", 16), ("_kit.HOT_ROWS", 2), ("_kit.HOT_SHARE", 0.0001)):
        monkeypatch.setattr(f"tidemark.llm.{name}", value)
    rng = np.random.default_rng(5)
    common, found = [f"w{x}" for x in rng.integers(0, 9999, 120)], []
    for i in range(60):  # documents that share most of a passage, in groups of nearer ones
        if i % 4 == 0:
            own = [f"o{x}" for x in rng.integers(0, 9999, 40)]
        found.append((i, " ".join(common + own + [f"i{i}"]), "en", "a", 0))
    want = [(d, n, c) for d, n, c in near(found)]
    assert 1 < len({c for _, _, c in want}) < 60
    got = minhash.near_duplicates(table(spark, found)).select("doc_id", "n_shingles", "component_id").collect()
    assert by_repr(got) == by_repr(want)


def test_near_recall(spark):
    """Pairs at and above the threshold, of several lengths: none is lost, none is linked below it."""
    rng = np.random.default_rng(11)
    found = []
    for i in range(700):
        n = int(rng.choice([1000, 2500, 6000]) if i < 60 else rng.choice([12, 24, 60, 150]))
        w = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        found.append((2 * i, " ".join(w), "en", "a", 0))
        for at in rng.choice(n, max(1, n // 40), replace=False):
            w[at] = f"v{i}-{at}"
        found.append((2 * i + 1, " ".join(w), "en", "a", 0))
    sets = lambda t: {tuple(x) for x in zip(*(t.split()[k:] for k in range(5)))}
    alike = [(a, b) for (a, s, *_), (b, t, *_) in zip(found[::2], found[1::2]) if 100 * len(sets(s) & sets(t)) >= 75 * len(sets(s) | sets(t))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(found, SCHEMA)).collect()}
    assert 200 < len(alike) < 650
    assert {d: c for d, c in got.items() if d != c} == {b: a for a, b in alike}


def test_near_chain(spark):
    """Each text is near the next only: links have to be followed, and a bucket's first isn't near all."""
    rng = np.random.default_rng(2)
    w = [f"w{x}" for x in rng.integers(0, 9999, 160)]
    found = []
    for i in range(40):
        found.append((i, " ".join(w), "en", "a", 0))
        w[4 * i % 150] = f"new{i}"
    want = [(d, n, c) for d, n, c in near(found)]
    got = minhash.near_duplicates(table(spark, found)).select("doc_id", "n_shingles", "component_id").collect()
    assert by_repr(got) == by_repr(want)


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 600).astype(np.uint64)
    b = np.r_[a[:450], rng.integers(0, 1 << 63, 150).astype(np.uint64)]
    s = minhash.signatures(np.r_[a, b, a[:3]], np.array([0, 600, 1200, 1203]))
    assert abs((s[0] == s[1]).mean() - 450 / 750) < 0.15
    assert (s[2] < np.iinfo(np.uint64).max).all()
    slots = np.stack([minhash._slot(a[:50], i, 128) for i in range(128)])
    assert all(sorted(slots[:, i]) == list(range(128)) for i in range(50))


@pytest.mark.parametrize("held", [10**6, 3])
def test_components(spark, held):
    """Links in several partitions, and in tasks that hold few of them at once."""
    links = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(100, 200), (200, 300), (5, 5), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long").repartition(5), held=held).collect()}
    want = {i: i // 20 * 20 for i in range(60) if i % 20} | {200: 100, 300: 100}
    assert got == want


def test_substring(spark):
    got = cut(table(spark)).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert by_repr(got) == by_repr(without_repeats(rows()))


@pytest.mark.parametrize("held", [10**6, 3])
def test_substring_hot(spark, monkeypatch, held):
    """Minimisers with many runs are dealt by windows, hot keys over tasks; the result is the same."""
    for name, value in (("substring.HOT", 2), ("substring.HELD", held), ("_kit.HOT_ROWS", 2), ("_kit.HOT_SHARE", 0.0001)):
        monkeypatch.setattr(f"tidemark.llm.{name}", value)
    got = cut(table(spark)).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    assert by_repr(got) == by_repr(without_repeats(rows()))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for f in (exact_dedup, minhash.near_duplicates, cut):
        assert f(empty).count() == 0


def similar_sets(seed, count=160):
    """Sets of one family and of sub-families, with the parts of a rough clustering."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(count):
        if i % 8 == 0:
            own = rng.choice(10**6, int(rng.integers(20, 90)), replace=False)
        shared, rest = np.arange(int(rng.integers(60, 120))), rng.choice(10**9, int(rng.integers(0, 40)), replace=False)
        x = np.unique(np.r_[shared, own, rest])
        out.append((i, int(rng.integers(0, 60)) if i % 3 else i + 100, len(x), np.sort(_kit.mixed(x.astype(np.uint64)).view(np.int64)).tolist()))
    return out


@pytest.mark.parametrize(("seed", "sketch", "percent"), [(1, 1 << 20, 75), (2, 8, 75), (3, 64, 60), (4, 64, 90)])
def test_similar_sets_meet(spark, monkeypatch, seed, sketch, percent):
    """Every pair of different parts that is similar enough meets, and pairs that meet share a shingle."""
    monkeypatch.setattr(minhash, "SKETCH", sketch)
    monkeypatch.setattr("tidemark.llm._kit.HOT_ROWS", 4)
    found = similar_sets(seed)
    own = spark.createDataFrame(found, "id long, part long, n long, shingles array<long>")
    met = {tuple(sorted(r)) for r in minhash.meeting(minhash.prefixes(own, minhash.frequencies(own), percent), percent).collect()}
    sets, part = {r[0]: set(r[3]) for r in found}, {r[0]: r[1] for r in found}
    alike = {(a, b) for a in sets for b in sets if a < b and part[a] != part[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
    assert alike and alike <= met
    assert all(part[a] != part[b] and sets[a] & sets[b] for a, b in met)


def test_template_families_never_meet(spark):
    """Pages of a template, of which none is near another: a handful of pairs, not all of them."""
    rng = np.random.default_rng(6)
    common = [f"c{x}" for x in rng.integers(0, 9999, 300)]
    texts = [" ".join(common + [f"o{x}" for x in rng.integers(0, 10**6, 80)]) for _ in range(600)]
    one = spark.createDataFrame([(i, t, i, 376) for i, t in enumerate(texts)], "id long, text string, part long, n long")
    own = minhash.sets(one, 5)
    assert own.count() > 550
    assert minhash.meeting(minhash.prefixes(own, minhash.frequencies(own), 75), 75).count() < 100
    got = minhash.near_duplicates(spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)).where("not kept").count()
    assert got == 0
