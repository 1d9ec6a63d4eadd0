from weftspark.operators import documents


def test_policies_of_a_domain_meet_its_questions_in_parts(spark):
    quads = spark.createDataFrame([("normative", f"s{i}", p, o) for i in range(12) for p, o in (("type", "Policy"), ("name", f"n{i}"), ("scope", f"d{i % 2}"))], "g string, s string, p string, o string")
    asked = spark.createDataFrame([(q, f"d{q % 3}") for q in range(9)], "qid int, domain string")
    found = documents.policies_by_domain(quads, asked)
    assert sorted((r.qid, r.uri) for r in found.collect()) == sorted((q, f"s{i}") for q in range(9) for i in range(12) if q % 3 == i % 2)
    assert "_part" in found._jdf.queryExecution().analyzed().toString()  # a domain's rows are dealt to parts
