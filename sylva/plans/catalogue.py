"""The engine's operators over the driver's tables, each with DuckDB SQL for the same rows.

The star schema stands in for a source tree: regions and nations are directories, customers and suppliers files,
orders classes, order lines methods. Lines repeat their key, so they are collapsed first. A line depends on its
supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as fn
from ..operators import graph, reuse, search, tree
from ..operators.resolve import Resolver
from ..schema import CALL, STALE
from ..scratch import save
from ..sources.ignore import ignored
from ..sources.tree import parse_sources

QUERIES, SQL = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- the struct view

VIEW = """
places AS (SELECT n_nationkey AS k, 'R' || n_regionkey || '/N' || n_nationkey AS uid, 'R' || n_regionkey AS top, n_name FROM nation),
customers AS (SELECT c_custkey, places.uid || '/C' || c_custkey AS uid, places.uid AS parent_uid, c_name FROM customer JOIN places ON c_nationkey = k),
suppliers AS (SELECT s_suppkey, places.uid || '/S' || s_suppkey AS uid, places.uid AS parent_uid, s_name, s_acctbal FROM supplier JOIN places ON s_nationkey = k),
ords AS (SELECT o_orderkey, customers.uid || '#O' || o_orderkey AS uid, customers.uid AS parent_uid FROM orders JOIN customers ON o_custkey = c_custkey),
lines AS (SELECT ords.uid || '.L' || l_linenumber AS uid, ords.uid AS parent_uid, min(l_linenumber) AS n, min(l_suppkey) AS s FROM lineitem JOIN ords ON l_orderkey = o_orderkey GROUP BY 1, 2),
structs AS (
  SELECT 'R' || r_regionkey AS uid, r_name AS name, 'directory' AS type, NULL AS parent_uid FROM region
  UNION ALL SELECT uid, n_name, 'directory', top FROM places
  UNION ALL SELECT uid, c_name, 'file', parent_uid FROM customers
  UNION ALL SELECT uid, s_name, 'file', parent_uid FROM suppliers
  UNION ALL SELECT uid, 'O' || o_orderkey, 'class', parent_uid FROM ords
  UNION ALL SELECT uid, 'L' || n, 'method', parent_uid FROM lines),
leaf AS (SELECT lines.uid AS source, suppliers.uid AS target FROM lines JOIN suppliers ON s = s_suppkey)
"""
ROLLED = f"""
WITH RECURSIVE {VIEW},
up AS (SELECT uid, parent_uid FROM structs WHERE parent_uid IS NOT NULL),
rolled AS (
  SELECT source, target FROM leaf
  UNION
  SELECT a.parent_uid, b.parent_uid FROM rolled JOIN up a ON source = a.uid JOIN up b ON target = b.uid WHERE a.parent_uid <> b.parent_uid)
"""


def struct_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``uid, name, type, parent_uid, path, id, parent_id, ref`` (ref: the supplier of a line)."""
    t = lambda name: read(spark, sf_dir, name)
    none = F.lit(None).cast("string")
    places = t("nation").select("n_nationkey", F.format_string("R%d/N%d", "n_regionkey", "n_nationkey").alias("place"), F.format_string("R%d", "n_regionkey").alias("top"), "n_name")
    customers = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat("place", F.lit("/C"), "c_custkey").alias("uid"), "place", "c_name")
    suppliers = t("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat("place", F.lit("/S"), "s_suppkey").alias("uid"), "place", "s_name")
    ords = t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.concat("uid", F.lit("#O"), "o_orderkey").alias("order_uid"), F.col("uid").alias("file"))
    lines = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("ref")).join(ords, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = [
        t("region").select(F.format_string("R%d", "r_regionkey").alias("uid"), F.col("r_name").alias("name"), F.lit("directory").alias("type"), none.alias("parent_uid"), F.format_string("R%d", "r_regionkey").alias("path")),
        places.select(F.col("place").alias("uid"), F.col("n_name").alias("name"), F.lit("directory").alias("type"), F.col("top").alias("parent_uid"), F.col("place").alias("path")),
        customers.select("uid", F.col("c_name").alias("name"), F.lit("file").alias("type"), F.col("place").alias("parent_uid"), F.col("uid").alias("path")),
        suppliers.select("uid", F.col("s_name").alias("name"), F.lit("file").alias("type"), F.col("place").alias("parent_uid"), F.col("uid").alias("path")),
        ords.select(F.col("order_uid").alias("uid"), F.concat(F.lit("O"), "o_orderkey").alias("name"), F.lit("class").alias("type"), F.col("file").alias("parent_uid"), F.col("file").alias("path")),
        lines.select(F.concat("order_uid", F.lit(".L"), "l_linenumber").alias("uid"), F.concat(F.lit("L"), "l_linenumber").alias("name"), F.lit("method").alias("type"), F.col("order_uid").alias("parent_uid"), F.col("file").alias("path"), "ref"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    kind = F.when(~F.col("parent_uid").contains("/"), "directory").when(F.col("type") == "file", "directory").when(F.col("type") == "class", "file").when(F.col("type") == "method", "class")
    return out.withColumn("id", fn.struct_id("uid", "type")).withColumn("parent_id", F.when(F.col("parent_uid").isNotNull(), fn.struct_id("parent_uid", kind)))


def leaf_edges(view: DataFrame, spark: SparkSession, sf_dir: str, key: str = "id") -> DataFrame:
    """``(source, target)`` ids (or, with another column of the view as ``key``, that column and uids): line to supplier."""
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    uid = F.format_string("R%d/N%d/S%d", "n_regionkey", "n_nationkey", "s_suppkey")
    named = suppliers.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", (fn.struct_id(uid, F.lit("file")) if key == "id" else uid).alias("target"))
    return view.where("ref is not null").join(named, F.col("ref") == F.col("s_suppkey")).select(F.col(key).alias("source"), "target")


def by_uid(view: DataFrame) -> DataFrame:
    """The view with uids for ids: ids are ten hex digits, which two of some million structs have in common."""
    return view.withColumn("id", F.col("uid")).withColumn("parent_id", F.col("parent_uid"))


def named_edges(view: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(source_id, target_id, edge_type, source_uid, target_uid)`` of lines to suppliers."""
    edges = leaf_edges(view.withColumn("ends", F.struct("id", "uid")), spark, sf_dir, "ends").withColumn("target_uid", F.col("target"))
    return edges.select(F.col("source.id").alias("source_id"), fn.struct_id("target_uid", F.lit("file")).alias("target_id"), F.lit("depends_on").alias("edge_type"), F.col("source.uid").alias("source_uid"), "target_uid")


def id_sql(uid: str, kind: str) -> str:
    return f"(CASE {kind} WHEN 'directory' THEN 'D' WHEN 'file' THEN 'F' WHEN 'class' THEN 'C' WHEN 'method' THEN 'M' ELSE 'V' END || '-' || substr(md5({uid}), 1, 10))"


# -- search

QUERY_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _query_vector(spark, sf_dir):
    return list(read(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {QUERY_VECTOR}), 6) AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 5")
def search_knn(spark, sf_dir):
    return search.nearest(read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 5, "vec_id", "embedding")


@query(f"""SELECT id, uid, type, distance FROM (SELECT 'V-' || substr(md5('v' || vec_id), 1, 10) AS id, 'v' || vec_id AS uid, CASE WHEN label = 2 THEN 'BaseMethod' ELSE 'class' END AS type,
  round(list_distance(embedding::DOUBLE[], {QUERY_VECTOR}), 6) AS distance FROM embeddings ORDER BY distance, id LIMIT 50) WHERE type = 'BaseMethod' ORDER BY distance, id LIMIT 5""")
def search_knn_filtered(spark, sf_dir):
    """The filter is part of the type's name, in any case, and comes after ten times as many were fetched."""
    rows = read(spark, sf_dir, "embeddings").withColumn("uid", F.concat(F.lit("v"), "vec_id")).withColumn("id", fn.struct_id("uid", F.lit("field")))
    structs = rows.select("id", "uid", F.when(F.col("label") == 2, "BaseMethod").otherwise("class").alias("type"))
    return search.search(structs, rows.select(F.col("id").alias("struct_id"), F.col("embedding").alias("vector")), _query_vector(spark, sf_dir), "mETHOD", 5)


@query("""SELECT id, uid, type, distance FROM (SELECT 'V-' || substr(md5('v' || vec_id), 1, 10) AS id, 'v' || vec_id AS uid, CASE WHEN label % 2 = 0 THEN 'method' ELSE 'class' END AS type,
  round(list_distance(embedding::DOUBLE[], """ + QUERY_VECTOR + """), 6) AS distance FROM embeddings) ORDER BY distance, id LIMIT 5""")  # fmt: skip
def search_structs(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").withColumn("uid", F.concat(F.lit("v"), "vec_id")).withColumn("id", fn.struct_id("uid", F.lit("field")))
    structs = rows.select("id", "uid", F.when(F.col("label") % 2 == 0, "method").otherwise("class").alias("type"))
    return search.search(structs, rows.select(F.col("id").alias("struct_id"), F.col("embedding").alias("vector")), _query_vector(spark, sf_dir))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS square, round(e[1] / greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-9), 6) AS first, round((e[1] + e[64]) / 2, 6) AS pooled FROM e""")
def normalize_meanpool(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    square = F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)
    pooled = fn.mean_pool(F.array(e, F.reverse(e)), F.array(F.lit(1), F.lit(1)))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(square, 6).alias("square"), F.round(fn.l2_normalise(F.col("embedding"))[0], 6).alias("first"), F.round(pooled[0], 6).alias("pooled"))


# -- status, identity, scalar functions


@query("""SELECT 'event' AS kind, event_type AS name, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'total', 'customer', count(*) FROM customer UNION ALL SELECT 'total', 'orders', count(*) FROM orders
UNION ALL SELECT 'total', 'lineitem', count(*) FROM lineitem""")
def status_counts(spark, sf_dir):
    out = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n")).select(F.lit("event").alias("kind"), "name", "n")
    for name in ("customer", "orders", "lineitem"):
        out = out.unionByName(read(spark, sf_dir, name).agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n"))
    return out


@query(f"WITH {VIEW} SELECT uid, type, {id_sql('uid', 'type')} AS id FROM structs")
def struct_ids(spark, sf_dir):
    return struct_view(spark, sf_dir).select("uid", "type", "id")


@query(f"WITH {VIEW} SELECT uid, regexp_replace(uid, '^[^#]*#', '#') AS short FROM structs WHERE type IN ('class', 'method')")
def short_uid(spark, sf_dir):
    return struct_view(spark, sf_dir).where(F.col("type").isin("class", "method")).select("uid", fn.short_uid("uid").alias("short"))


@query("SELECT doc_id, CASE WHEN length(flat) > 50 THEN substr(flat, 1, 47) || '...' ELSE flat END AS shown FROM (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS flat FROM documents)")
def param_truncate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", fn.truncate("text").alias("shown"))


@query("""SELECT page_id, md5(coalesce(CASE WHEN page_id % 3 = 0 THEN url || ': ' || left(html, 30) END, CASE WHEN page_id % 3 = 1 THEN html END, url)) AS text_md5 FROM pages""")
def embed_text(spark, sf_dir):
    third = F.col("page_id") % 3
    text = fn.embed_text(F.col("url"), F.when(third == 0, F.expr("left(html, 30)")), F.when(third == 1, F.col("html")), F.lit(""), F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text).alias("text_md5"))


SUFFIX = "CASE page_id % 5 WHEN 0 THEN '.HTML' WHEN 1 THEN '.htm' WHEN 2 THEN '.py' WHEN 3 THEN '.java' ELSE '.txt' END"


@query(f"""SELECT page_id, lower(ext) AS extension, CASE WHEN lower(ext) IN ('.html', '.htm') THEN 'html' WHEN lower(ext) = '.py' THEN 'python' WHEN lower(ext) = '.java' THEN 'java' END AS language
FROM (SELECT page_id, {SUFFIX} AS ext FROM pages)""")
def ext_route(spark, sf_dir):
    path = F.concat(F.lit("page_"), F.col("page_id"), F.expr(SUFFIX))
    return read(spark, sf_dir, "pages").withColumn("path", path).select("page_id", fn.extension("path").alias("extension"), fn.language("path").alias("language"))


@query("""SELECT page_id, md5(html) AS diff_hash, CASE WHEN html LIKE '%' || chr(10) THEN greatest(len(string_split(html, chr(10))) - 1, 1) ELSE len(string_split(html, chr(10))) END AS end_line,
'F-' || substr(md5('page_' || page_id || '.html'), 1, 10) AS id FROM pages""")
def html_files(spark, sf_dir):
    """Pages through the parser, as files of a tree."""
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("page_"), F.col("page_id"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("body"))
    rows = parse_sources(pages).where("type = 'file'")
    return rows.select(F.regexp_extract("uid", r"(\d+)", 1).cast("long").alias("page_id"), "diff_hash", F.col("end_line").cast("long").alias("end_line"), fn.struct_id("uid", "type").alias("id"))


URL_RULES = ("*.html", "/de/", "fr/", "!*7.html", "es/*5*")


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]*/', ''), '[?#].*$', '') AS path FROM pages),
q AS (SELECT page_id, regexp_replace(path, '/$', '') AS path FROM p)
SELECT page_id, (regexp_matches(path, '^de/') OR regexp_matches(path, '(^|/)fr/') OR (CASE WHEN regexp_matches(path, '^es/[^/]*5[^/]*$') THEN true WHEN regexp_matches(path, '7\\.html$') THEN false ELSE regexp_matches(path, '\\.html$') END)) AS ignored FROM q""")
def ignore_filter(spark, sf_dir):
    """Rules as column expressions: each compiled pattern becomes a regular expression, the last that matches wins; a
    path below an ignored directory stays ignored."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*/", ""), "[?#].*$", ""), "/$", "")
    rows = read(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", ignored("path", URL_RULES).alias("ignored"))


@query("""SELECT event_id, json_extract(props, '$.k')::INT AS arity, event_type AS name FROM events""")
def call_site_explode(spark, sf_dir):
    """Call sites out of JSON, widened to the full row with defaults."""
    site = F.struct(F.col("event_type").alias("name"), F.get_json_object("props", "$.k").cast("int").alias("arity"), F.lit(None).cast("string").alias("receiver"), F.lit(False).alias("is_creation"))
    rows = read(spark, sf_dir, "events").select("event_id", F.array(site).cast(f"array<{CALL.simpleString()}>").alias("sites"))
    return rows.select("event_id", F.explode("sites").alias("c")).select("event_id", "c.arity", "c.name")


# -- tree


@query(f"WITH {VIEW} SELECT uid, type FROM structs WHERE uid = 'R1/N1' OR starts_with(uid, 'R1/N1/')")
def subtree_filter(spark, sf_dir):
    return tree.subtree(struct_view(spark, sf_dir), "R1/N1").select("uid", "type")


@query(f"WITH {VIEW} SELECT uid, {id_sql('uid', 'type')} AS id FROM structs WHERE uid = 'R1' OR starts_with(uid, 'R1/N1/C1')")
def uid_prefix_lookup(spark, sf_dir):
    view = struct_view(spark, sf_dir)
    return view.where((F.col("uid") == "R1") | F.col("uid").startswith("R1/N1/C1")).select("uid", "id")


SKELETON = f"""WITH RECURSIVE {VIEW},
shown AS (
  SELECT uid, type, 0 AS depth FROM structs WHERE parent_uid IS NULL
  UNION ALL
  SELECT s.uid, s.type, depth + 1 FROM shown JOIN structs s ON s.parent_uid = shown.uid WHERE depth < {{depth}} AND s.type IN ({{kinds}}) AND (s.type <> 'method' OR shown.type = 'file'))
SELECT * FROM shown"""


@query(SKELETON.format(depth=2, kinds="'file', 'directory', 'class', 'method'"))
def skeleton_depth2(spark, sf_dir):
    view = struct_view(spark, sf_dir)
    return tree.skeleton(view, depth=2, roots=view.where("parent_id is null")).select("uid", "type", "depth")


@query(SKELETON.format(depth=4, kinds="'file', 'directory', 'class', 'method'"))
def skeleton_full(spark, sf_dir):
    view = struct_view(spark, sf_dir)
    return tree.skeleton(view, depth=4, roots=view.where("parent_id is null")).select("uid", "type", "depth")


@query(SKELETON.format(depth=4, kinds="'file', 'directory'"))
def skeleton_files_only(spark, sf_dir):
    view = struct_view(spark, sf_dir)
    return tree.skeleton(view, depth=4, files_only=True, roots=view.where("parent_id is null")).select("uid", "type", "depth")


@query(f"""WITH {VIEW} SELECT customers.uid, count(DISTINCT ords.uid) AS n_classes, count(lines.uid) AS n_methods, coalesce(string_agg(DISTINCT ords.uid, ',' ORDER BY ords.uid), '') AS classes
FROM customers LEFT JOIN ords ON ords.parent_uid = customers.uid LEFT JOIN lines ON lines.parent_uid = ords.uid GROUP BY customers.uid""")
def inspect_rollup(spark, sf_dir):
    """Two levels below every customer, gathered."""
    view = save(by_uid(struct_view(spark, sf_dir)).where("type <> 'directory'").select("id", "uid", "type", "parent_id"), "view")
    counts = view.where("type = 'method'").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("k"))
    classes = view.where("type = 'class'").join(counts, "id", "left").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_classes"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_methods"), F.array_join(F.sort_array(F.collect_list("uid")), ",").alias("classes"))
    files = view.where("type = 'file'").where(F.substring_index("uid", "/", -1).startswith("C"))
    return files.select("id", "uid").join(classes, "id", "left").select("uid", F.coalesce("n_classes", F.lit(0)).alias("n_classes"), F.coalesce("n_methods", F.lit(0)).alias("n_methods"), F.coalesce("classes", F.lit("")).alias("classes"))


@query(f"""WITH asked(pos, ref) AS (VALUES (0, 'R1/N1'), (1, 'D-' || substr(md5('R0'), 1, 10)), (2, 'nothing')), {VIEW},
named AS (SELECT *, {id_sql('uid', 'type')} AS id FROM structs)
SELECT pos, ref, id, uid FROM asked LEFT JOIN named ON ref = CASE WHEN regexp_matches(ref, '^[SCMVFD]-') THEN id ELSE uid END""")
def inspect_references(spark, sf_dir):
    import hashlib

    view = struct_view(spark, sf_dir)
    asked = ["R1/N1", "D-" + hashlib.md5(b"R0").hexdigest()[:10], "nothing"]
    return tree.resolve_references(asked, view).select("pos", "ref", "id", "uid")


@query("SELECT conv_id, role, min(turn) AS turn, min(md5(text)) AS text_md5 FROM conversations GROUP BY conv_id, role HAVING count(*) = 1")
def single_child_passthrough(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text", F.concat_ws("/", "conv_id", "role").alias("parent_id"), F.concat_ws("/", "conv_id", "role", "turn").alias("id"))
    return rows.join(tree.single_child(rows), ["parent_id", "id"], "left_semi").select("conv_id", "role", "turn", F.md5("text").alias("text_md5"))


# -- edges


@query(f"""WITH {VIEW} SELECT {id_sql('source', "'method'")} AS source_id, {id_sql('target', "'file'")} AS target_id, 'depends_on' AS edge_type FROM leaf
UNION SELECT {id_sql('s.uid', 's.type')}, {id_sql('p.uid', 'p.type')}, 'is_child_of' FROM structs s JOIN structs p ON s.parent_uid = p.uid""")
def edge_list(spark, sf_dir):
    view = save(struct_view(spark, sf_dir).select("id", "parent_id", "ref"), "view")
    deps = leaf_edges(view, spark, sf_dir).select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("depends_on").alias("edge_type"))
    return graph.all_edges(view, deps)


def _rolled(spark, sf_dir):
    """The view and its dependencies rolled up, both by uid: roll-up asks of its keys only that they tell rows apart."""
    view = save(struct_view(spark, sf_dir).select("uid", "type", "parent_uid", "ref"), "view")
    return view, graph.roll_up(leaf_edges(view, spark, sf_dir, "uid"), view.select(F.col("uid").alias("id"), F.col("parent_uid").alias("parent_id")))


@query(ROLLED + "SELECT source, target FROM rolled")
def edge_rollup(spark, sf_dir):
    return _rolled(spark, sf_dir)[1]


@query(ROLLED + """, i AS (SELECT target AS uid, count(*) AS n FROM rolled GROUP BY 1), o AS (SELECT source AS uid, count(*) AS n FROM rolled GROUP BY 1),
c AS (SELECT parent_uid AS uid, count(*) AS n, count(DISTINCT type) AS k FROM structs GROUP BY 1)
SELECT structs.uid, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out, coalesce(c.n, 0) AS n_children, coalesce(i.n, 0) + coalesce(c.k, 0) AS impact_score
FROM structs LEFT JOIN i USING (uid) LEFT JOIN o USING (uid) LEFT JOIN c USING (uid)""")
def fan_in_out(spark, sf_dir):
    view, rolled = _rolled(spark, sf_dir)
    edges = rolled.select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("depends_on").alias("edge_type"))
    structs = view.select(F.col("uid").alias("id"), "uid", "type", F.col("parent_uid").alias("parent_id"))
    return graph.fan(edges, structs).select("uid", "fan_in", "fan_out", "n_children", "impact_score")


TWO_KINDS = "(substr(source, length(source), 1)::INT % 2 = 0)"


@query(f"""WITH RECURSIVE {VIEW},
up AS (SELECT uid, parent_uid FROM structs WHERE parent_uid IS NOT NULL),
rolled AS (
  SELECT source, target, CASE WHEN {TWO_KINDS} THEN 'depends_on' ELSE 'depends_on_fuzzy' END AS edge_type FROM leaf
  UNION
  SELECT a.parent_uid, b.parent_uid, edge_type FROM rolled JOIN up a ON source = a.uid JOIN up b ON target = b.uid WHERE a.parent_uid <> b.parent_uid)
SELECT source AS source_id, target AS target_id, edge_type FROM rolled""")
def fuzzy_rollup(spark, sf_dir):
    """Lines with an odd number are guesses; both kinds roll up, each by itself."""
    view = save(struct_view(spark, sf_dir).select("uid", "type", "parent_uid", "ref"), "view")
    leaf = leaf_edges(view, spark, sf_dir, "uid")
    even = F.substring("source", -1, 1).cast("int") % 2 == 0
    return graph.dependency_edges(leaf.where(even), leaf.where(~even), view.select(F.col("uid").alias("id"), F.col("parent_uid").alias("parent_id")))


@query(f"""WITH {VIEW}, said AS (SELECT source, target, CASE WHEN {TWO_KINDS} THEN '' ELSE '~' END AS mark, {id_sql('source', "'method'")} AS s, {id_sql('target', "'file'")} AS t FROM leaf),
o AS (SELECT s AS id, md5(string_agg(mark || t || '|' || target, ',' ORDER BY mark || t || '|' || target)) AS h FROM said GROUP BY 1),
i AS (SELECT t AS id, md5(string_agg(mark || s || '|' || source, ',' ORDER BY mark || s || '|' || source)) AS h FROM said GROUP BY 1)
SELECT coalesce(o.id, i.id) AS id, coalesce(i.h, md5('')) AS inbound_md5, coalesce(o.h, md5('')) AS outbound_md5 FROM o FULL JOIN i ON o.id = i.id""")
def dependency_strings(spark, sf_dir):
    view = struct_view(spark, sf_dir).select("id", "uid", "ref")
    kind = F.when(F.substring("source_uid", -1, 1).cast("int") % 2 == 0, "depends_on").otherwise("depends_on_fuzzy")
    edges = save(named_edges(view, spark, sf_dir).withColumn("edge_type", kind), "edges")
    said = graph.dependency_strings(edges, view)
    return said.select("id", F.md5(F.array_join("inbound", ",")).alias("inbound_md5"), F.md5(F.array_join("outbound", ",")).alias("outbound_md5"))


@query(f"WITH {VIEW} SELECT source, target FROM leaf JOIN suppliers ON target = uid WHERE s_acctbal >= 0")
def edge_endpoints_exist(spark, sf_dir):
    """Line edges whose supplier is still there after those in debt are taken out."""
    view = save(by_uid(struct_view(spark, sf_dir)).select("id", "uid", "type", "ref"), "view")
    edges = leaf_edges(view, spark, sf_dir, "uid").select(F.col("source").alias("source_id"), F.col("target").alias("target_id"))
    debt = read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("S"), "s_suppkey").alias("leaf"))
    there = view.join(debt, (F.col("type") == "file") & (F.substring_index("uid", "/", -1) == F.col("leaf")), "left_anti")
    return graph.with_endpoints(edges, there).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))


@query(f"""WITH {VIEW}, kept AS (SELECT * FROM structs WHERE NOT (uid = 'R1/N1' OR starts_with(uid, 'R1/N1/')))
SELECT 'structs' AS what, count(*) AS n FROM kept UNION ALL SELECT 'edges', (SELECT count(*) FROM leaf WHERE source IN (SELECT uid FROM kept) AND target IN (SELECT uid FROM kept))
 + (SELECT count(*) FROM kept WHERE parent_uid IN (SELECT uid FROM kept))""")
def delete_subtree(spark, sf_dir):
    view = save(by_uid(struct_view(spark, sf_dir)).select("id", "path", "parent_id", "ref"), "view")
    deps = leaf_edges(view.withColumn("uid", F.col("id")), spark, sf_dir, "uid").select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("depends_on").alias("edge_type"))
    vectors = view.select(F.col("id").alias("struct_id"))
    structs, edges, _ = reuse.drop_subtree(view, graph.all_edges(view, deps), vectors, "R1/N1")
    return structs.agg(F.count("*").alias("n")).select(F.lit("structs").alias("what"), "n").unionByName(edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("what"), "n"))


@query(f"""WITH {VIEW} SELECT 'dangling_edges' AS kind, count(*) AS n FROM leaf JOIN suppliers ON target = uid WHERE s_acctbal < 0
UNION ALL SELECT 'orphan_vectors', count(*) FROM suppliers WHERE s_acctbal < 0""")
def orphan_check(spark, sf_dir):
    """What would dangle if suppliers in debt went and nothing else."""
    view = save(by_uid(struct_view(spark, sf_dir)).select("id", "uid", "type", "ref"), "view")
    deps = leaf_edges(view, spark, sf_dir, "uid").select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("depends_on").alias("edge_type"))
    debt = read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("S"), "s_suppkey").alias("leaf"))
    there = view.join(debt, (F.col("type") == "file") & (F.substring_index("uid", "/", -1) == F.col("leaf")), "left_anti")
    return graph.orphans(there, deps, view.select(F.col("id").alias("struct_id")))


# -- reuse


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("uid"), "text", F.md5("text").alias("diff_hash"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS description, doc_id % 7 <> 0 AS carried FROM documents""")
def carry_over(spark, sf_dir):
    """Every seventh text was edited; the others keep what the last build said, stale marks taken off."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("uid"), "text", "source")
    none = F.lit(None)
    previous = docs.select("uid", F.md5("text").alias("diff_hash"), F.concat(F.lit(STALE), "source").alias("description"), none.cast("array<float>").alias("vector"))
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.select("doc_id", "uid", F.md5(edited).alias("diff_hash"), none.cast("string").alias("description"), none.cast("array<float>").alias("vector"))
    return reuse.carry_over(new, previous).select("doc_id", "description", "carried")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'own' WHEN labels.doc_id IS NOT NULL THEN 'quality ' || quality END AS description FROM documents LEFT JOIN labels USING (doc_id)""")
def lockfile_seed(spark, sf_dir):
    docs = _docs(spark, sf_dir).withColumn("description", F.when(F.col("doc_id") % 3 == 0, "own")).withColumn("vector", F.lit(None).cast("array<float>"))
    lock = read(spark, sf_dir, "labels").join(docs.select("doc_id", "uid", "diff_hash"), "doc_id").select("uid", "diff_hash", F.concat(F.lit("quality "), "quality").alias("description"), F.lit(None).cast("array<float>").alias("vector"))
    return reuse.seed_from_lock(docs, lock).select("doc_id", "description")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN '[STALE] ' || source ELSE '[STALE] ' || lang END AS marked, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN source ELSE lang END AS plain, doc_id % 5 > 1 AS current FROM documents""")
def stale_marker(spark, sf_dir):
    fifth = F.col("doc_id") % 5
    rows = read(spark, sf_dir, "documents").select("doc_id", F.when(fifth == 0, "").when(fifth == 1, F.concat(F.lit(STALE), "source")).otherwise(F.col("lang")).alias("description"))
    rows = rows.withColumn("current", fn.described("description"))
    return reuse.mark_stale(rows).select("doc_id", F.col("description").alias("marked"), fn.without_stale("description").alias("plain"), "current")


@query("""SELECT 'd' || doc_id AS uid, md5(text) AS diff_hash, 'quality ' || quality AS description FROM documents JOIN labels USING (doc_id) WHERE toxic = 0""")
def collect_descriptions(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", F.concat(F.when(F.col("toxic") == 0, "").otherwise(STALE), F.lit("quality "), "quality").alias("description"))
    return reuse.collect_descriptions(_docs(spark, sf_dir).join(labels, "doc_id", "left"))


@query("""SELECT doc_id FROM documents WHERE doc_id % 11 = 3""")
def diff_prune(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return reuse.removed(docs, docs.where("doc_id % 11 <> 3"), "uid").select("doc_id")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_change_wins(spark, sf_dir):
    changes = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return reuse.latest_changes(changes, "user_id", ("ts", "event_id")).select("user_id", "event_id", "event_type")


# -- resolution


def _code_rows(rows: DataFrame) -> DataFrame:
    """Missing columns of the resolver's input, as nulls."""
    kinds = {"package": "string", "imports": "array<string>", "inherits": "array<string>", "field_type": "string", "arity": "int", "dependency_names": f"array<{CALL.simpleString()}>"}
    for name, kind in kinds.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def _packages(spark, sf_dir):
    """Customers as files with packages, orders as their classes."""
    view = struct_view(spark, sf_dir).where(F.col("type").isin("file", "class")).where(~F.substring_index("path", "/", -1).startswith("S"))
    return _code_rows(view.drop("id", "parent_id", "ref").withColumn("package", F.when(F.col("type") == "file", F.lower(F.translate("path", "/", ".")))))


@query(f"""WITH {VIEW}, asked AS (
  SELECT lower(replace(parent_uid, '/', '.')) || '.O' || o_orderkey AS name, uid AS target FROM ords
  UNION ALL SELECT lower(replace(uid, '/', '.')), uid FROM customers)
SELECT name, target FROM asked""")
def logical_name_lookup(spark, sf_dir):
    """Dotted names of every order and customer, with ``.Nope`` names that find nothing."""
    rows = save(_packages(spark, sf_dir), "packages")
    dotted = F.lower(F.translate("path", "/", "."))
    names = rows.select(F.when(F.col("type") == "class", F.concat(dotted, F.lit("."), "name")).otherwise(dotted).alias("name"))
    names = names.unionByName(rows.where("type = 'file'").select(F.concat(dotted, F.lit(".Nope")).alias("name")))
    return Resolver(rows).lookup(names)


@query(f"""WITH {VIEW}, spots AS (SELECT lower(replace(parent_uid, '/', '.')) AS p FROM ords), asked AS (SELECT DISTINCT lower(top) AS package FROM places UNION SELECT DISTINCT lower(replace(uid, '/', '.')) FROM places)
SELECT package, count(*) AS n FROM asked JOIN spots ON starts_with(p, package || '.') GROUP BY package""")
def package_members(spark, sf_dir):
    nation = read(spark, sf_dir, "nation")
    asked = nation.select(F.format_string("r%d", "n_regionkey").alias("package")).unionByName(nation.select(F.format_string("r%d.n%d", "n_regionkey", "n_nationkey").alias("package"))).distinct()
    return Resolver(save(_packages(spark, sf_dir), "packages")).package_members(asked).groupBy("package").agg(F.count("*").alias("n"))


@query("""WITH owned AS (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 9000)
SELECT 'N' || n_nationkey AS container, CASE WHEN s_nationkey IS NOT NULL THEN 'N' || n_nationkey || '.label' ELSE 'R' || n_regionkey || '.label' END AS method FROM nation LEFT JOIN owned ON n_nationkey = s_nationkey""")
def inherit_walk(spark, sf_dir):
    """Nations inherit ``label`` from their region unless they define it themselves."""
    nation, empty = read(spark, sf_dir, "nation"), F.array().cast("array<string>")
    own = read(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    name = F.concat(F.lit("N"), "n_nationkey")
    top = F.concat(F.lit("R"), "r_regionkey")
    region = read(spark, sf_dir, "region")
    classes = nation.select(name.alias("uid"), name.alias("name"), F.lit("class").alias("type"), F.array(F.concat(F.lit("R"), "n_regionkey")).alias("inherits")).unionByName(region.select(top.alias("uid"), top.alias("name"), F.lit("class").alias("type"), empty.alias("inherits")))
    methods = nation.join(own, "n_nationkey").select(name.alias("parent_uid")).unionByName(region.select(top.alias("parent_uid")))
    methods = methods.select(F.concat("parent_uid", F.lit(".label")).alias("uid"), F.lit("label").alias("name"), F.lit("method").alias("type"), "parent_uid", F.lit(0).alias("arity"))
    rows = classes.unionByName(methods, allowMissingColumns=True).withColumn("path", F.lit("m.py")).withColumn("parent_uid", F.coalesce("parent_uid", F.lit("m.py")))
    file = spark.createDataFrame([("m.py", "m.py", "file", "m.py", "m", ".")], "uid string, name string, type string, path string, package string, parent_uid string")
    r = Resolver(_code_rows(rows.unionByName(file, allowMissingColumns=True)))
    types = r.types(r.scoped.where("type = 'class'").select(F.col("uid").alias("scope"), F.explode("inherits").alias("name")))
    found = r.reachable_methods(r.closure(types))
    return found.where("ar = -1 and container like 'N%'").select("container", "method")


@query("""WITH sup AS (SELECT s_suppkey, s_nationkey AS k FROM supplier), m AS (SELECT DISTINCT k, l_suppkey AS s, l_linenumber AS n FROM lineitem JOIN sup ON l_suppkey = s_suppkey),
calls AS (SELECT DISTINCT c_custkey AS c, c_nationkey AS k, l_linenumber AS n, l_suppkey AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
seen AS (SELECT calls.*, m.s, contains('s' || m.s, 's' || calls.r) AS hinted FROM calls JOIN m ON calls.k = m.k AND calls.n = m.n),
sums AS (SELECT c, n, r, count(*) AS total, sum(hinted::INT) AS hints FROM seen GROUP BY ALL),
edges AS (SELECT DISTINCT c, s, n, (total = 1 OR hints = 1) AS exact FROM seen JOIN sums USING (c, n, r) WHERE total = 1 OR (hints = 1 AND hinted) OR hints <> 1)
SELECT 'n' || k || '.py#C' || c || '(...)' AS source, 'n' || k || '.py#S' || s || '.line' || n || '(...)' AS target, CASE WHEN exact THEN 'depends_on' ELSE 'depends_on_fuzzy' END AS edge_type
FROM edges JOIN (SELECT c_custkey, c_nationkey AS k FROM customer) ON c = c_custkey""")
def resolve_tiers(spark, sf_dir):
    """Nations as modules, suppliers as their classes with a method for each line number they delivered, customers as
    functions that call a line on a receiver named for its supplier: one candidate is exact, several are told apart by
    the receiver or else fuzzy."""
    t = lambda name: read(spark, sf_dir, name)
    module = lambda k: F.concat(F.lit("n"), k, F.lit(".py"))
    files = t("nation").select(module("n_nationkey").alias("uid"), F.concat(F.lit("n"), "n_nationkey").alias("package")).select("uid", F.col("uid").alias("name"), F.lit("file").alias("type"), F.col("uid").alias("path"), F.lit(".").alias("parent_uid"), "package", F.array().cast("array<string>").alias("imports"))
    sup = t("supplier").select("s_suppkey", module("s_nationkey").alias("path"), F.concat(F.lit("S"), "s_suppkey").alias("name"))
    classes = sup.select(F.concat("path", F.lit("#"), "name").alias("uid"), "name", F.lit("class").alias("type"), "path", F.col("path").alias("parent_uid"))
    made = t("lineitem").select("l_suppkey", "l_linenumber").distinct().join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
    methods = made.select(F.concat("path", F.lit("#"), "name", F.lit(".line"), "l_linenumber", F.lit("(...)")).alias("uid"), F.concat(F.lit("line"), "l_linenumber").alias("name"), F.lit("method").alias("type"), "path", F.concat("path", F.lit("#"), "name").alias("parent_uid"), F.lit(0).alias("arity"))
    used = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_linenumber", "l_suppkey").distinct()
    site = F.struct(F.concat(F.lit("line"), "l_linenumber").alias("name"), F.lit(0).alias("arity"), F.concat(F.lit("s"), "l_suppkey").alias("receiver"), F.lit(False).alias("is_creation"))
    sites = used.groupBy("o_custkey").agg(F.collect_list(site).alias("dependency_names"))
    callers = t("customer").join(sites, F.col("c_custkey") == F.col("o_custkey")).select(
        F.concat(module("c_nationkey"), F.lit("#C"), "c_custkey", F.lit("(...)")).alias("uid"), F.concat(F.lit("C"), "c_custkey").alias("name"), F.lit("method").alias("type"), module("c_nationkey").alias("path"), module("c_nationkey").alias("parent_uid"), F.lit(0).alias("arity"), "dependency_names"
    )
    rows = files.unionByName(classes, allowMissingColumns=True).unionByName(methods, allowMissingColumns=True).unionByName(callers, allowMissingColumns=True)
    exact, fuzzy = Resolver(save(_code_rows(rows), "code")).resolve()
    # A call may be fuzzy where another one of the same function is sure; both edges then stand.
    return exact.withColumn("edge_type", F.lit("depends_on")).unionByName(fuzzy.withColumn("edge_type", F.lit("depends_on_fuzzy")))


