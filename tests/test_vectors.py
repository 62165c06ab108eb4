import math
import random

import numpy as np
import pytest
from conftest import frame
from pyspark.sql import functions as F

from loomary.functions import scalars, vector
from loomary.operators import similarity


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_cosine(spark):
    assert one(spark, vector.cosine(arr(1, 0), arr(1, 0))) == 1
    assert one(spark, vector.cosine(arr(1, 0), arr(-1, 0))) == 0
    assert one(spark, vector.raw_cosine(arr(1, 0), arr(-1, 0))) == -1
    assert one(spark, vector.cosine(arr(0, 0), arr(1, 0))) == 0
    assert one(spark, vector.euclidean(arr(0, 3), arr(4, 0))) == 5
    assert one(spark, vector.manhattan(arr(0, 3), arr(4, 0))) == 7
    assert one(spark, vector.keyword_vector(F.array(F.lit("b"), F.lit("zz")), ["a", "b"])) == [0.0, 1.0]
    assert one(spark, vector.clamp(F.lit(float("nan")))) == 1


def test_usable(spark):
    rows = frame(spark, "v array<double>", [([1.0],), ([0.0],), ([],), (None,), ([1.0, None],), ([float("nan")],)])
    assert [r[0] for r in rows.select(vector.usable(F.col("v"))).collect()] == [True, False, False, False, False, False]


def test_pairs_and_nearest_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    r = random.Random(5)
    rows = [("s" if i % 3 else "t", i, [r.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = frame(spark, "scope string, id bigint, vec array<double>", rows)
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and cos(a[2], b[2]) > 0.6}
    got = similarity.pairs_above(df, 0.6).collect()
    assert {(x["scope"], x["id_a"], x["id_b"]) for x in got} == want and len(got) == len(want)
    near = similarity.nearest(df, df, 3).collect()
    for s, i, v in rows:
        best = sorted(((-max(0, cos(v, w)), j) for t, j, w in rows if t == s))[:3]
        assert [(x["id"], x["rank"]) for x in sorted(near, key=lambda x: x["rank"]) if x["probe"] == i] == [(j, n + 1) for n, (_, j) in enumerate(best)]
    assert similarity.nearest(df, df, 0).count() == 0
    with pytest.raises(ValueError):
        similarity.nearest(df, df, -1)


def test_replies():
    p = lambda s: scalars.parse_reply(s, "verdict", "unrelated", "summary")
    assert p('{"verdict":" Direct_Contradiction ","confidence":"0.9","summary":" s "}') == ("direct_contradiction", 0.9, "s")
    assert p('{"verdict":"x","confidence":true}') == ("x", 1.0, "")
    for bad in (None, "", "[1]", "{'a':1}", '{"verdict":"x"} tail', '{"verdict":"x","confidence":"high"}'):
        assert p(bad) == ("unrelated", 0.0, "")
    assert p('{"verdict":"x","confidence":NaN}')[1] == 1.0


def test_labels_and_decay(spark):
    assert one(spark, scalars.tier(F.lit(0.92))) == "auto_merge"
    assert one(spark, scalars.tier(F.lit(0.78))) == "auto_flag"
    assert one(spark, scalars.tier(F.lit(0.5))) == "human_review"
    assert one(spark, scalars.health_risk(F.lit(0.6))) == "medium"
    assert one(spark, scalars.eval_risk(F.lit(0.85))) == "low"
    assert one(spark, scalars.scenario_risk(F.lit(0.3))) == "critical"
    for age, want in ((0, 1), (30, 0.5), (60, 0.25), (90, 0.125), (-5, 1)):
        assert math.isclose(one(spark, scalars.decay(F.lit(float(age)))), want)


def test_metadata_match(spark):
    rows = frame(spark, "m string", [('{"k":1}',), ('{"k":1.0,"s":"x"}',), ('{"k":true}',), ("{broken",), (None,), ("{}",)])
    hit = lambda want: [r[0] for r in rows.select(scalars.matches(F.col("m"), want)).collect()]
    assert hit({"s": "x"}) == [False, True, False, False, False, False]
    assert hit({"k": 1})[:2] == [True, True]
    assert hit({"k": None}) == [False, False, False, True, True, True]
