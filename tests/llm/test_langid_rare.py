"""Languages with few labelled rows."""

from pyspark.sql import functions as F

from semilat.llm import langid


def test_a_rare_label_is_a_language_at_every_size(spark):
    common = spark.range(30000).select((F.col("id") + 10).alias("doc_id"), F.concat(F.lit("the house and the garden of number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    rare = spark.createDataFrame([(1, "maja ja aed on suured ning ilusad", "et"), (2, "suur maja ja ilus aed", "et")], "doc_id long, text string, lang string")
    model = langid.fit(common.union(rare))
    assert model.languages == ["en", "et"]
    assert model.log_likelihoods("ilus aed ja suur maja")[:2].argmax() == 1
