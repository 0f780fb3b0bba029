"""One longer row leaves the search as it is."""

from citeflow.llm import ann


def search(spark, rows):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in ann.nearest(d, d.where("vec_id % 10 = 0")).collect())


def test_longer_row(spark):
    rows = [(i, [float(i % 7 + 1), float(i % 5), 1.0]) for i in range(40)]
    want = search(spark, rows)
    assert want and search(spark, [*rows, (90, [1.0] * 9), (91, []), (92, None)]) == want
