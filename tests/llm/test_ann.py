import numpy as np
from pyspark.sql import functions as F

from skaldic.llm import ann


def stages(spark) -> dict[int, int]:
    """Rows that each stage so far has shuffled."""
    gateway = spark.sparkContext._gateway
    none = gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, *none)
    return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}


def test_few_rows_are_shuffled(spark):
    """Parts exchange rows of arrays; a row for each scored pair was over a thousand a vector."""
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((4000, 32))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    before = stages(spark)
    got = ann.nearest(table).toPandas()
    assert sum(n for k, n in stages(spark).items() if k not in before) < 50 * len(vectors)
    exact = vectors @ vectors.T
    np.fill_diagonal(exact, -np.inf)
    hits = [len(set(np.argsort(-exact[q])[:20]) & set(g["vec_id"])) / 20 for q, g in got.groupby("query_id")]
    assert len(hits) == 200 and np.mean(hits) >= 0.95


def test_hubs_and_several_parts(spark):
    """A few long vectors are near to all others, and no link between parts is lost."""
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((1500, 8))
    vectors[[5, 700, 1203]] *= 50
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = ann.nearest(table).toPandas()
    exact = vectors @ vectors.T
    np.fill_diagonal(exact, -np.inf)
    hits = [len(set(np.argsort(-exact[q])[:20]) & set(g["vec_id"])) / 20 for q, g in got.groupby("query_id")]
    assert len(hits) == 75 and np.mean(hits) >= 0.95
    assert not spark.sql("SHOW TABLES LIKE 'ann_links_*'").collect()
    assert ann.nearest(table.filter(F.col("vec_id") % 20 != 0)).count() == 0


def test_best():
    a, b = np.array([3, 1, 1, 1, 3, 1], np.int32), np.array([9, 4, 5, 4, 8, 6], np.int32)
    s, mark = np.array([-1.0, 0.5, -0.25, 0.75, -2.0, -0.5], np.float32), np.array([0, 1, 0, 0, 1, 0], bool)
    got = ann.best(a, b, s, mark, 2)
    assert [x.tolist() for x in got] == [[1, 1, 3, 3], [4, 5, 9, 8], [0.75, -0.25, -1.0, -2.0], [True, False, False, True]]
