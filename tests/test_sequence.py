import random

from conftest import frame

from loomary.operators.sequence import numbered


def test_places_within_scopes_over_many_ranges(spark):
    r = random.Random(2)
    rows = [(r.choice("aaab") if r.random() < 0.95 else None, r.choice([None, *range(50)]), i) for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = frame(spark, "g string, x int, i int", rows)
        got = numbered(df.repartition(5), ["g"], ["x", "i"], "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for g in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        want |= {x[2]: n for n, x in enumerate(mine, 1)}
    assert {x["i"]: x["n"] for x in got} == want and len(got) == 400


def test_no_rows(spark):
    assert numbered(spark.createDataFrame([], "g string, x int"), ["g"], ["x"], "n").count() == 0
