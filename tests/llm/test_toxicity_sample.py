"""The sample of the toxicity fit is bounded although an id repeats."""


def test_sample_has_one_row_of_each_id(spark):
    from sentspark.llm import toxicity

    rows = [(i, f"word{i} text") for i in range(30)] + [(1000, f"copy{i} text") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in [*range(30), 1000]], "doc_id long, toxic int")
    _, sample = toxicity.training_sample(docs, marks)
    assert sample.count() <= 2 * 31
