"""The store of versions: no text twice, versions restored by hash, and what the log says."""

from quire.operators import store


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def test_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.checkpoint(docs(spark, (1, "a\nb"), (2, "same"), (3, "same"), (4, None), (None, "x")), "first", "2024-01-02 03:04:05") == 1
    assert s.texts.count() == 4
    assert s.checkpoint(s.restore(1), "nothing new", "2024-01-03 00:00:00") == 2 and s.texts.count() == 4
    assert s.checkpoint(docs(spark, (1, "a\nc\nd"), (2, "a\nb"), (3, "same"), (5, "p\nq"), (None, "x")), "it's changed", None) == 3 and s.texts.count() == 6
    assert s.checkpoint(docs(spark), "empty") == 4 and s.texts.count() == 6
    rows = {(r.version, r.tag, str(r.ts)[:10] if r.version < 3 else "", r.message, r.files, r.added, r.removed, r.modified, r.insertions, r.deletions) for r in s.history().collect()}
    assert rows == {
        (1, "V0001", "2024-01-02", "first", 5, 5, 0, 0, 6, 0), (2, "V0002", "2024-01-03", "nothing new", 5, 0, 0, 0, 0, 0), (3, "V0003", "", "it's changed", 5, 1, 1, 2, 6, 3), (4, "V0004", "", "empty", 0, 0, 5, 0, 0, 9),
    }
    assert {tuple(r) for r in s.restore(1).select("doc_id", "text").collect()} == {(1, "a\nb"), (2, "same"), (3, "same"), (4, ""), (None, "x")}
    assert {tuple(r) for r in s.restore(3).select("doc_id", "text").collect()} == {(1, "a\nc\nd"), (2, "a\nb"), (3, "same"), (5, "p\nq"), (None, "x")}
    assert s.restore(4).count() == 0 and s.restore(9).count() == 0
