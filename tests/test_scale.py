"""What holds of larger tables, on small ones."""

from pyspark.sql import functions as F

from sylva.operators import graph, pairs, tree
from sylva.operators.resolve import Resolver
from sylva.schema import EDGES, STRUCTS, VECTORS
from sylva.sources.tree import parse_sources
from sylva.store import Store
from test_operators import cls, code, file, method


def test_pairs_in_blocks_are_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 3)
    left = spark.range(40).select((F.col("id") % 3).alias("k"), F.concat(F.lit("l"), "id").alias("source"))
    right = spark.range(17).select((F.col("id") % 4).alias("k"), F.concat(F.lit("r"), "id").alias("target"))
    got = sorted((r["source"], r["target"]) for r in pairs.pairs(left, right, ["k"]).collect())
    assert got == sorted((f"l{a}", f"r{b}") for a in range(40) for b in range(17) if a % 3 == b % 4)


def test_imports_stay_with_their_file(spark):
    r = Resolver(code(spark, file("m.py", "m", "a.B", "a.C"), cls("m.py", "A"), method("m.py#A", "f", "m.py")))
    assert "imports" not in r.scoped.columns
    assert {(x["path"], x["name"]) for x in r.imports.collect()} == {("m.py", "a.B"), ("m.py", "a.C")}


def twins(spark):
    """Two files of one id, each with a class and an edge of its own."""
    rows = [(i, u, u.split("/")[-1], t, p, pi, pu) for i, u, t, p, pi, pu in [("F-1", "a", "file", "a", None, None), ("F-1", "b", "file", "b", None, None), ("C-1", "a#X", "class", "a", "F-1", "a"), ("C-2", "b#Y", "class", "b", "F-1", "b")]]
    structs = spark.createDataFrame(rows, "id string, uid string, name string, type string, path string, parent_id string, parent_uid string")
    for f in STRUCTS:
        if f.name not in structs.columns:
            structs = structs.withColumn(f.name, F.lit(None).cast(f.dataType))
    edges = spark.createDataFrame([("C-1", "F-1", "depends_on", "a#X", "b"), ("F-1", "C-2", "depends_on", "a", "b#Y")], "source_id string, target_id string, edge_type string, source_uid string, target_uid string")
    return structs, edges


def test_structs_of_one_id_are_told_apart(spark):
    structs, edges = twins(spark)
    said = {r["id"]: (r["inbound"], r["outbound"]) for r in graph.dependency_strings(edges, structs).collect()}
    assert said["F-1"] == (["C-1|a#X"], ["C-2|b#Y"])
    seen = {(r["ref"], r["uid"]): r["inbound"] for r in tree.inspect(structs, edges, ["a", "b"]).collect()}
    assert seen == {("a", "a"): [], ("a", "a#X"): [], ("b", "b"): ["C-1|a#X"], ("b", "b#Y"): ["F-1|a"]}


def test_store_keeps_rows_of_one_id_once(spark, tmp_path):
    structs, edges = twins(spark)
    store = Store(spark, f"file://{tmp_path}/store")
    vectors = spark.createDataFrame([("F-1", [1.0])], VECTORS)
    store.write(structs.select(*STRUCTS.fieldNames()), edges.select(*EDGES.fieldNames()), vectors)
    store.update_descriptions(spark.createDataFrame([("F-1", "a", "said")], "id string, uid string, description string"))
    kept, held, there = store.tables()
    assert held.count() == 2 and there.count() == 1
    assert {r["uid"]: r["description"] for r in kept.where("type = 'file'").collect()} == {"a": "said", "b": None}


def test_sources_of_one_partition_are_dealt_out(spark):
    sources = spark.createDataFrame([(f"c{k}.py", bytearray(b"x = 1\n")) for k in range(40)], "path string, body binary").coalesce(1)
    rows = parse_sources(sources).select("path", F.spark_partition_id().alias("p")).collect()
    assert len({r["path"] for r in rows}) == 40 and len({r["p"] for r in rows}) > 1
