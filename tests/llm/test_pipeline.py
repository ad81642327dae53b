"""The pipeline against brute force on a small folder, and the queries on the smallest tables."""

import os
import re

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from skaldic.llm import catalog
from .test_operators import DOCS, brute_components, corpus, plain_rows

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    rows = [(i, t, "en" if t and re.search("[a-zé]", t, re.I) else None, s, n, x) for i, t, _, s, n, x in plain_rows(corpus(40))]
    spark.createDataFrame(rows, DOCS).drop("_text_in").write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = stages["language ID"](spark, docs, str(tmp_path))
    with_letters = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in with_letters)
    first = {}
    for r in sorted(with_letters):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    alone = brute_components(list(first.values()), 5)
    left = {i for i, (_, _, k) in alone.items() if k}
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed["doc_id"]) == left
    for _, g in packed.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 2048 and (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    found = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    got = catalog.queries()[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, found.fetchall()))
