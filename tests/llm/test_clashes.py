"""Extra columns whose names the operators use themselves."""

from pyspark.sql import functions as F

from loomary.llm import components, leakage, mixing, neardup, pii, subjects, survivor
from loomary.llm.tokenizers import count_tokens

EXTRA = ["class", "n", "at", "h", "u", "v", "label", "rank", "score", "row", "part", "value", "field", "mentions", "n_tokens", "slice", "place", "share", "id_a", "sid", "profile", "_row", "_seq"]


def clash(df):
    return df.withColumns({c: F.lit("x") for c in EXTRA if c not in df.columns})


def test_extra_columns(spark):
    docs = clash(spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "en", "chat"), (2, "other words", "en", "chat")], "doc_id bigint, text string, lang string, source string"))
    assert leakage.leaked(spark, docs, clash(spark.createDataFrame([(7, "one two three four five six seven eight nine ten")], "item_id bigint, text string"))).count() == 1
    assert mixing.mix(spark, docs, clash(spark.createDataFrame([("chat", 1.0, 2)], "source string, target_share double, max_repeats bigint"))).count() == 2
    assert [r["n_tokens"] > 0 for r in count_tokens(spark, docs).collect()] == [True, True]
    areas = subjects.subject_areas(spark, docs, clash(spark.createDataFrame([(1, "Law ")], "doc_id bigint, subject string")), clash(spark.createDataFrame([("Law",)], "subject string")))
    assert {r["subject"] for r in areas.collect()} <= {"Law"}
    texts = clash(spark.createDataFrame([("a", "1", "one two three"), ("a", "2", "one two three")], "scope string, id string, text string"))
    assert neardup.similar_pairs(spark, texts, 0.5, 3).count() == 1
    assert components.connected_groups(spark, clash(spark.createDataFrame([("a", "1", "2")], "agent_id string, a string, b string"))).count() == 2
    assert pii.scrub(spark, clash(spark.createDataFrame([("Vera Ostlund",)], "text string")), ["text"], b"k").first()["mentions"][0]["kind"] == "name"
    rows = clash(spark.createDataFrame([("g", "1", "p", 1.0), ("g", "2", "q", 2.0)], "g string, id string, w string, trust double"))
    rule = survivor.FieldRule("w", F.col("w"), F.lit(True), F.col("trust"), text=True)
    assert [r["from_id"] for r in survivor.survivors(spark, rows, ["g"], "id", [rule]).collect()] == ["2"]
