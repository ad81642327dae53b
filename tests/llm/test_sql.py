"""Queries of the operators against their SQL: on the smallest tables and on odd rows."""

import os

import duckdb
import pytest

from skaldic.llm import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def agree(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}{'' if os.path.isfile(f'{folder}/{f}') else '/*.parquet'}')")
    found = con.execute(catalog.oracle_sql()[name])
    columns = sorted(c[0] for c in found.description)
    at = [[c[0] for c in found.description].index(c) for c in columns]
    theirs = sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())
    got = catalog.queries()[name](spark, folder)
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == theirs
    return len(theirs)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_tables(spark, name):
    assert agree(spark, SF, name)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null, empty, short and long texts, letters beyond ASCII, copies and near copies, overlapping repeats."""
    folder = str(tmp_path_factory.mktemp("odd"))
    words = [f"word{k}" for k in range(400)]
    base = " ".join(words[:120])
    texts = [
        None, "", " \t\n", "one", "One", "one  two three", "one two\x0bthree", "one two three four", base, base.upper(), base + " tail",
        base.replace("word60 ", ""), " ".join(words[100:300]), "æøå ß 漢字 " * 30, "x" * 200, "x" * 49, "x" * 50, " ".join(words) * 40,
        " ".join(words[300:]) + base, " ".join(words[300:]) + " y " + base, "a\x00b" * 40, "xa\x00b" * 30,
    ]
    spark.createDataFrame([(len(texts) - k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{folder}/documents")
    spark.createDataFrame(
        [(len(texts) - k, f"https://h{k}.org/fr/{k}" if k % 3 else None, t) for k, t in enumerate(texts + [None, "", "one"])], "page_id long, url string, html string"
    ).write.parquet(f"{folder}/pages")
    lines = [
        (1, 1, 3, 1, 2, 10.005, "kept", "2024-01-01 00:00:00"), (1, 1, 3, 1, 2, 10.005, "kept", "2024-01-01 00:00:00"), (2, 1, 3, 1, 2, None, "kept", "2024-01-03 10:00:00"),
        (3, 1, 4, 1, 5, None, None, "2024-02-03 00:00:00"), (4, 1, 4, 1, None, None, "kept", "2024-03-03 00:00:00"), (None, None, None, None, None, None, None, None),
        (5, 2, 3, 2, 1, 7.0, "kept", None), (6, 1, 3, 3, 1, 7.0, "kept", "2024-05-01 00:00:00"), (7, 1, 8, 1, 1, 7.0, "kept", "2024-05-01 00:00:00"),
        (8, 1, 3, 1, 2, 90.0, "returned", "2024-05-20 00:00:00"), (9, 1, 5, 1, 2, 0.125, "kept", "2030-01-01 00:00:00"), (10, 1, 5, 1, 1, 3.5, "kept", "2023-12-24 00:00:00"),
        *[(100 + k, 1, 3 + k % 15, 1 + k % 2, 1, 1.0 + k % 7, "returned" if k % 5 == 0 else "kept", f"2024-0{1 + k % 5}-{10 + k % 18} 00:00:00") for k in range(200)],
    ]
    schema = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, flag string, shipped_at string"
    frame = spark.createDataFrame(lines, schema)
    frame.withColumn("shipped_at", frame["shipped_at"].cast("timestamp_ntz")).write.parquet(f"{folder}/sale_lines")
    spark.createDataFrame([(1, 7), (1, 7), (2, 9), (3, None), (None, 7)], "vendor_id long, nation_id int").write.parquet(f"{folder}/vendors")
    spark.createDataFrame([(i, None if i == 4 else i / 8) for i in range(3, 18) if i != 8] + [(None, 1.0)], "item_id long, price double").write.parquet(f"{folder}/items")
    return folder


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_odd_rows(spark, odd, name, monkeypatch):
    monkeypatch.setattr(catalog, "table", lambda spark, folder, name: spark.read.parquet(f"{folder}/{name}"))
    assert agree(spark, odd, name)
