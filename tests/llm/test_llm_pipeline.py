"""Each pipeline stage on its own input, and the whole."""

from tests.llm.conftest import SMALL
from tests.llm.test_llm_operators import base_spans, near_truth, rows, substring_truth, words


def test_stages(spark, docs):
    import corpus_pipeline as C

    now = docs
    seen = {}
    for name, stage in C.STAGES:
        out = stage(spark, now, SMALL).cache()
        seen[name] = (now, out)
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
        now = out
    a, b = seen["near_dedup"]
    assert {i for i, in rows(b, "doc_id")} == {c for _, c in near_truth(rows(a, "doc_id", "text")).values()}
    a, b = seen["substring_dedup"]
    kept = {i: n - g for i, n, g, _ in substring_truth(rows(a, "doc_id", "text"))}
    assert {i: len(words(t)) for i, t in rows(b, "doc_id", "text")} == kept
    a, b = seen["secret_scan"]
    assert a.count() == b.count() and not any(base_spans(t) for _, t in rows(b, "doc_id", "text"))
    assert {i for i, in rows(seen["packing"][1], "doc_id")} == {i for i, in rows(b, "doc_id")}


def test_run(spark):
    import corpus_pipeline as C

    assert C.run(spark, SMALL).count() > 0


def test_empty(spark, docs):
    import corpus_pipeline as C

    for name, stage in C.STAGES:
        assert stage(spark, docs.where("false"), SMALL).count() == 0, name


def test_near_stage_rows(spark, docs):
    """Equal rows become one, and rows without an id are not taken for copies of each other."""
    import corpus_pipeline as C

    t = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "one two three"), (None, "four five six"), (3, None), (4, None)]
    src = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in t], docs.schema)
    got = sorted(rows(C.one_of_near_copies(spark, src, SMALL), "doc_id", "text"), key=str)
    assert got == sorted([(1, "a b c d e f g"), (None, "one two three"), (None, "four five six"), (3, None), (4, None)], key=str)


def test_sql_of_queries(spark):
    """The registered SQL gives the rows of the queries."""
    import duckdb

    from martlens.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    for name, sql in ORACLE.items():
        got = QUERIES[name](spark, SMALL)
        cols = sorted(got.columns)
        want = con.sql(sql).fetchall()
        names = [d[0] for d in con.sql(sql).description]
        assert sorted(names) == cols
        order = [names.index(c) for c in cols]
        assert sorted(map(str, rows(got, *cols))) == sorted(str(tuple(r[i] for i in order)) for r in want), name
