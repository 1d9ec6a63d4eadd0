from pyspark.sql import functions as F

from weftspark.operators import asking


def test_the_longer_the_answers_the_fewer_a_task_makes(spark, monkeypatch):
    monkeypatch.setattr(asking, "CHARACTERS", 4000)
    nodes = spark.range(200).select(F.concat(F.lit("kep-"), "id").alias("id"), F.lit("kep").alias("kind"), F.lit("").alias("title"), F.lit("public").alias("tier"))
    nodes = nodes.unionByName(spark.createDataFrame([("sig:sig-b", "sig", "", "public")], nodes.schema))
    edges = nodes.where("kind = 'kep'").select(F.lit("sig:sig-b").alias("src"), F.lit("OWNS").alias("kind"), F.col("id").alias("dst"))
    asked = spark.range(60).select(F.col("id").alias("qid"), F.concat(F.lit("What does SIG b own? "), "id").alias("question"))
    found = asking.governed(asked, asking.link(asked), edges, nodes)
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 60 and max(tasks) <= 16  # lists of 1,688 characters, all of which made one task
    listed = ", ".join(sorted(f"kep-{i}" for i in range(200)))
    assert {r.answer for r in found.collect()} == {f"Answer to: What does SIG b own? {q} Graph facts: {listed}." for q in range(60)}
