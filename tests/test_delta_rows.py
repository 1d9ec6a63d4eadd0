from pyspark.sql import functions as F

from weftspark.operators import delta, ingest
from weftspark.sources import ledger

KEYS = ["id"]
ROWS = "id string, doc string, props map<string,string>"


def test_a_delta_alters_deletes_and_leaves_rows_and_moves_them_by_keys_once(spark):
    store = [("a", "d1", {"t": "x"}), ("a", "d2", {}), ("b", "d1", {"t": "y"}), ("c", "d3", {"t": "z", "u": "1"}), ("e", "d1", {}), ("f", "d4", {"t": "k"})]
    scratch = [("c", "d3", {"t": "zz"}), ("e", "d5", {}), ("g", "d5", {"t": "n"}), ("f", "d4", {"t": "k"})]
    plan = delta.reconcile_rows(spark.createDataFrame(store, ROWS), spark.createDataFrame(scratch, ROWS), spark.createDataFrame([("d1",), ("d4",)], "doc string"), KEYS)
    got = {r.id: (r.action, r.props, r.docs) for r in plan.collect()}
    assert got == {
        "a": ("upsert", {"t": "x"}, ["d2"]), "b": ("delete", {"t": "y"}, None), "c": ("upsert", {"t": "zz", "u": "1"}, ["d3"]),
        "e": ("upsert", None, ["d5"]), "g": ("upsert", {"t": "n"}, ["d5"]),
    }
    moved = plan._jdf.queryExecution().optimizedPlan().toString()
    assert moved.count("RepartitionByExpression") == 1 and moved.count("Join") == 1


def test_documents_are_worked_out_once_for_what_they_say_and_merged_rows_moved_once(spark):
    docs = spark.createDataFrame(
        [("community/sig-1", "sig", 1, "one", None, []), ("community/person-7", "person", 7, "seven", 1, []), ("enhancements/kep-3", "kep", 3, "three", 1, [7, 8]), ("enhancements/kep-4", "kep", 4, None, None, None)],
        "doc_id string, kind string, key long, title string, owner long, authors array<long>",
    )
    nodes, edges = ledger.extract(docs)
    assert sorted((r.src, r.kind, r.dst) for r in edges.collect()) == [
        ("person:supplier7", "AUTHORS", "kep-3"), ("person:supplier7", "TECH_LEADS", "sig:sig-nation-1"), ("person:supplier8", "AUTHORS", "kep-3"), ("sig:sig-nation-1", "OWNS", "kep-3"),
    ]
    for said in (nodes, edges, ledger.after(docs)):
        assert said._jdf.queryExecution().analyzed().toString().count("LogicalRDD") == 1
    merged = ingest.merged(nodes, KEYS)
    assert "Join" not in merged._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: (r.docs, r.kind, (r.props or {}).get("title")) for r in merged.collect()}
    assert got["sig:sig-nation-1"] == (["community/person-7", "community/sig-1", "enhancements/kep-3"], "sig", "one") and got["person:supplier8"] == (["enhancements/kep-3"], "person", None)
    first = ingest.merged(nodes.where("kind = 'sig'").withColumn("props", F.create_map(F.lit("p"), F.col("doc"))), KEYS, F.substring("doc", -1, 1)).first()
    assert first.props == {"p": "community/sig-1"}
