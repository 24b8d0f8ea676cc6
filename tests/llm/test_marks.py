"""Marks of paths beyond the number that is broadcast count all the same."""

from graphquarry.llm import unwritten as uw

FILES = "path string, size bigint, node_count int, indexed_at bigint"


def test_no_mark_is_dropped(spark, monkeypatch):
    rows = [(f"r/src/vendor/kit{chr(97 + k % 8)}/part{chr(97 + j)}_{chr(97 + k)}.py", 900 + k, 3, 1) for k in range(16) for j in range(6)]
    rows += [(f"r/src/{chr(97 + k % 8)}/own{chr(97 + j)}_{chr(97 + k)}.py", 700 + k, 5, 1) for k in range(16) for j in range(6)] + [("r/partx_a.min.js", None, None, 1), (None, 1, 1, 1)]
    df = spark.createDataFrame(rows, FILES)
    files = uw._current_files(df)
    get = lambda: sorted((r["path"], r["folders"], r["names"]) for r in uw.rated(files).collect())
    judge = lambda: sorted(tuple(r) for r in uw.judged(df).collect())
    rates, verdicts = get(), judge()
    assert uw.mark_rates(files).count() > 10 and max(r[1] for r in rates) > 0.5 < max(r[2] for r in rates)
    monkeypatch.setattr(uw, "MOST_MARKS", 2)
    assert get() == rates and judge() == verdicts
