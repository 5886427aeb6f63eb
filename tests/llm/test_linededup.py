from gridweave.llm import linededup
from gridweave.llm.queries import ORACLES, op7_line_dedup
from tests.llm.util import same_as_sql

SF = "/root/testdata/sf0.01"


def test_equals_sql(spark):
    got = op7_line_dedup(spark, SF)
    assert same_as_sql(got, ORACLES["op7_line_dedup"], SF) == 1000
    assert got.agg({"n_removed": "sum"}).first()[0] > 0


def test_near_threshold_lines_are_counted_exactly(spark):
    # 50 and 49 sites around a threshold of 50 with a coarse sketch.
    rows = [(i, "seen on exactly fifty\nown line number %06d" % i, f"s{i % 50}", 0) for i in range(200)]
    rows += [(1000 + i, "seen on forty-nine sites", f"s{i % 49}", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int")
    got = {r.doc_id: r for r in linededup.remove_boilerplate(docs, min_sites=50, lg_k=4).collect()}
    assert got[0].text == rows[0][1] and got[0].n_removed == 0
    assert all(got[i].text == "own line number %06d" % i and got[i].n_removed == 1 for i in range(1, 200))
    assert all(got[1000 + i].n_removed == 0 for i in range(200))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "the very same line here\n", "a"), (3, "the very same line here\n", "a"), (4, "the very same line here", None), (5, " the very same line here \nx\nthe very same line here", "b"), (6, "z" * 2_000_000, "c")], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.text if r.doc_id < 6 else len(r.text), r.n_lines, r.n_removed) for r in linededup.remove_boilerplate(docs, min_sites=2).collect() if r.text is not None)
    assert got == [(2, "", 1, 0), (3, "the very same line here\n", 2, 0), (3, "the very same line here\n", 2, 0), (4, "", 1, 1), (5, "x", 3, 2), (6, 2_000_000, 1, 0)]
    assert linededup.remove_boilerplate(docs.limit(0)).count() == 0


def test_null_doc_ids_lose_lines_and_keep_none_from_others(spark):
    line = "the very same line here"
    docs = spark.createDataFrame([(None, line + "\na", "a"), (2, line + "\nb", "b"), (3, line + "\nc", "c"), (None, f"d\n{line}", "d"), (None, "only rows of no id\nx", "a"), (None, "only rows of no id\ny", "b"), (None, "z\nonly rows of no id", "b")], "doc_id long, text string, source string")
    got = sorted((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in linededup.remove_boilerplate(docs, min_sites=2).collect())
    assert got[-2:] == [(2, line + "\nb", 2, 0), (3, "c", 2, 1)]
    assert {("a", 1), ("d", 1), ("z", 1)} <= {(t, n) for _, t, _, n in got}
    rest = sorted(t for _, t, _, _ in got if t[-1] in "xy")
    assert rest in (["only rows of no id\nx", "y"], ["only rows of no id\ny", "x"])
