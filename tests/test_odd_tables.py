"""Registered queries against their statements in SQL, on small tables with odd rows."""

import duckdb

from duolex.queries import ORACLES, QUERIES


def same(spark, path, name, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{table}.parquet")
    df = QUERIES[name](spark, str(path))
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    duck = duckdb.connect()
    duck.execute(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    want = sorted(duck.execute(f"select {', '.join(cols)} from ({ORACLES[name]})").fetchall(), key=repr)
    assert got == want
    return got


def test_titles(spark, tmp_path):
    """References without a semicolon, or of other names, stay in a title; no title; no page."""
    titles = ["a &lt;b&gt; &amp; c", "cut off&amp", "cut &lt", "&quot;x&quot; &#39;", "&amp;lt;", "  x  ", ""]
    rows = [(i, f"<html><title>{t}</title><p>x<a href='y'>z</a></p></html>") for i, t in enumerate(titles)] + [(90, "<p>no title</p>"), (91, None)]
    got = same(spark, tmp_path, "sc_html_rows", "pages", rows, "page_id long, html string")
    assert "cut off&amp" in [r[-1] for r in got]


def test_first_word(spark, tmp_path):
    """Words that go on after a mark, accents that are folded, letters beyond ASCII right after the word, other cases."""
    texts = ["foo the.Bar the", "in the:x", "of theé and the end", "see the's", "Thé the thè", "THE end", "x-the the", "the_a the", "thén the", "then the", "the™ x", "a the½ the", "ſo the", "no", "", None, "the the"]
    got = same(spark, tmp_path, "ft_highlight_offsets", "documents", [(i, "s", "en", t) for i, t in enumerate(texts)], "doc_id long, source string, lang string, text string")
    assert len(got) > 8


def test_members_of_a_condition(spark, tmp_path):
    """Every supplier whose key has a condition's remainder is a candidate, however many there are."""
    spark.createDataFrame([(k,) for k in (5, 6, 45, 85, 125, 165)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    line = [(1, 1, 5, 1, 1.0, "A", "O"), (2, 1, 5, 1, 1.0, "A", "O"), (2, 2, 6, 2, 1.0, "A", "O")]
    spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, QUERIES["rc_producer_filter"](spark, str(tmp_path)).collect()))
    duck = duckdb.connect()
    for t in ("supplier", "lineitem"):
        duck.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(duck.execute(f"select topic, npc from ({ORACLES['rc_producer_filter']})").fetchall())
    assert [x for x in got if x[0] == 1] == [(1, 5), (1, 45), (1, 85), (1, 125), (1, 165)]
