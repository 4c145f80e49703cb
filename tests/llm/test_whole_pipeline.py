"""The dedup stages on rows that repeat an id, or have none: one row of each group stays."""

from helpers import SCHEMA, near, rows

import corpus_pipeline


def awkward():
    found = rows()
    again = [found[5], (7, "another text of an id that comes up twice", "en", "a", 1), (None, "only without an id", "en", "a", 1), (None, "only without an id", "de", "b", 1)]
    base = found[0][1]
    return found + again + [(None, base + " more", "en", "c", 1)]


def test_one_row_of_each_group(spark, tmp_path):
    found = awkward()
    spark.createDataFrame(found, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    last = {}
    for d, t, *_ in found:
        old = last.setdefault(t or "", d)
        last[t or ""] = d if old is None else old if d is None else max(old, d)
    corpus_pipeline.exact(spark, docs, "").write.parquet(f"{tmp_path}/exact")
    docs = spark.read.parquet(f"{tmp_path}/exact")
    after = [tuple(r) for r in docs.collect()]
    assert set(after) <= set(found)
    assert sorted(((r[1] or "", r[0]) for r in after), key=repr) == sorted(last.items(), key=repr)

    for before in (found, after):
        numbered = [(i, *r[1:]) for i, r in enumerate(before)]
        groups = {}
        for (i, _, component), r in zip(near(numbered), before):
            groups.setdefault(component, []).append(r[0])
        want = [min((d for d in g if d is not None), default=None) for g in groups.values()]
        got = [tuple(r) for r in corpus_pipeline.near(spark, spark.createDataFrame(before, SCHEMA), "").collect()]
        assert set(got) <= set(before)
        assert sorted((r[0] for r in got), key=repr) == sorted(want, key=repr)


def test_drawn_rows_come_alone(spark):
    """A drawn row does not bring another one of its id along, and rows without ids are not drawn as one."""
    same = [(i % 2 or None, "text " + str(i).translate(str.maketrans("0123456789", "abcdefghij")) + "z" * 40, "en", "a" if i % 20 else "b", 0) for i in range(4000)]
    got = corpus_pipeline.mixed(spark, spark.createDataFrame(same, SCHEMA), "").collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) <= set(same)
    for part, size in ((1, 2000), (None, 1800)):
        n = sum(r.doc_id == part and r.source == "a" for r in got)
        # b, a twentieth of the tokens, has 6.6 % of the mixture, which limits the volume to 0.76; a is 93.4 % of that
        assert 0.68 * size < n < 0.80 * size
