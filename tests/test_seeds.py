import pytest
from pyspark.sql import functions as F

from weftspark.operators import evaluate, state


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_common_wording_and_long_texts_make_no_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(state, "FEW", most)
    measured = spark.sparkContext.accumulator(0)

    @F.pandas_udf("long")
    def counted(a, b):
        measured.add(len(a))
        return (a.str.len() * 0).astype("int64") + 12

    monkeypatch.setattr(evaluate, "common_length", counted.asNondeterministic())
    line = "eleven char"  # stands in every text, one character short of what is to be found
    questions = spark.createDataFrame([(i, f"{chr(65 + i)}{line}{chr(65 + i)}") for i in range(8)] + [(8, "\U0001f600 is wide: abcdefgh")], "qid int, text string")
    golds = [(i, f"{i % 7}{line}{i % 5}") for i in range(40)] + [(90, "x" * 17 + "\U0001f600 IS WIDE: abc"), (91, None), (92, "eleven")]
    found = evaluate.overlaps(questions, spark.createDataFrame(golds, "id int, text string")).collect()
    assert [(r.qid, r.id) for r in found] == [(8, 90)]
    assert measured.value == 1
