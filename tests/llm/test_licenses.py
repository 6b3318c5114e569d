import os

import duckdb

from duolex.llm import licenses

from .helpers import plain

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_variants_of_a_text(spark):
    mit = licenses.TEXTS["MIT"]
    rows = [(1, mit), (2, "Copyright (c) 2020 Some One\n\n" + mit.upper()), (3, mit.replace("sublicense", "sub-license").replace("\n", "  \n# ")), (4, mit + " x"), (5, "Licensed under CC BY-NC 4.0."), (6, "text\nRELEASED under the mit licence!\nmore"), (7, None)]
    got = {r.doc_id: r for r in licenses.scan(plain(spark, rows)).collect()}
    assert [got[i].license_id for i in range(1, 8)] == ["MIT", "MIT", "MIT", None, "CC-BY-NC-4.0", None, None]
    assert got[6].notice_ids == "MIT" and got[6].n_notice_lines == 1 and got[7].notice_ids == ""


def test_hints_cover_notices():
    import re

    assert all(re.search(licenses.NOTICE_HINT, n) for ns in licenses.NOTICES.values() for n in ns)


def test_query_against_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    r = c.execute(licenses.ORACLE)
    cols = [d[0] for d in r.description]
    want = sorted(map(repr, r.fetchall()))
    assert sorted(repr(tuple(x[k] for k in cols)) for x in licenses.op1_licenses(spark, SF).collect()) == want
