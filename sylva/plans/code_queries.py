"""Queries over code that is made up from the driver's tables: parsers, name resolution, descriptions and the store, each
with DuckDB SQL for the same rows.

Nations are modules (or packages), suppliers and customers their classes and functions; what a rule should find then
follows from the tables' keys by a plain join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import describe, tree
from ..operators.resolve import Resolver
from ..schema import CALL, EDGES, STRUCTS, VECTORS
from ..scratch import new_scratch, save
from ..sources.tree import parse_sources
from ..store import Store
from .catalogue import VIEW, _code_rows, by_uid, id_sql, named_edges, query, read, struct_view

# -- parsers

PYTHON = """import n{k}
from base import Keeper as K{c}

rate: N{k} = 1


class C{c}(Keeper, x.Y):
    owner: Keeper

    def put(self, book, n={c}):
        self.check(book)
        return K{c}(n)


def main():
    return rate.sum(1, {c})
"""
JAVA = """package r.n{k};

import base.Keeper;
import static util.Tool.cut;

public class S{c} extends Keeper implements Lendable {
    private int rate = {c};

    public void put(String book, int n) {
        check(book);
        shelf.log(n, new Item(n));
    }

    enum Kind { A, B }

    void check(String book) { this.put(book, {c}); }
}
"""


def _filled(template: str, k: str, c: str):
    """The template as a column, its marks replaced by two columns."""
    out = F.lit(template)
    for mark, name in (("{k}", k), ("{c}", c)):
        out = F.replace(out, F.lit(mark), F.col(name).cast("string"))
    return out


def _sql_text(text: str, k: str, c: str) -> str:
    quoted = text.replace("'", "''")
    return f"replace(replace('{quoted}', '{{k}}', {k}::VARCHAR), '{{c}}', {c}::VARCHAR)"


def _part(template: str, first: int, last: int, start: int = 0, end: int | None = None) -> str:
    """Lines first to last (from 1) of a template, cut at the start of the first and the end of the last."""
    lines = template.split("\n")[first - 1 : last]
    lines[0] = lines[0][start:]
    return "\n".join(lines)[:end]


def _rows_sql(source: str, k: str, c: str, rows: list[tuple]) -> str:
    """Expected rows, one SELECT for each ``(uid, type, parent, lines, signature, body, field type, inherits, calls)``."""
    t = lambda x: "NULL" if x is None else _sql_text(x, k, c)
    return " UNION ALL ".join(
        f"SELECT {t(uid)} AS uid, '{kind}' AS type, {t(parent)} AS parent_uid, {lines[0]} AS start_line, {lines[1]} AS end_line, {t(sign)} AS signature, md5({t(body)}) AS body_md5, {t(of)} AS field_type, {t(inherits)} AS inherits, {t(calls)} AS calls FROM {source}"
        for uid, kind, parent, lines, sign, body, of, inherits, calls in rows
    )


PYTHON_ROWS = [
    ("c{c}.py", "file", ".", (1, 16), None, PYTHON, None, None, None),
    ("c{c}.py#rate", "field", "c{c}.py", (4, 4), "rate: N{k}", "rate: N{k} = 1", "N{k}", None, None),
    ("c{c}.py#C{c}", "class", "c{c}.py", (7, 12), "class C{c}(Keeper, x.Y)", _part(PYTHON, 7, 12), None, "Keeper,x.Y", None),
    ("c{c}.py#C{c}.owner", "field", "c{c}.py#C{c}", (8, 8), "owner: Keeper", "owner: Keeper", "Keeper", None, None),
    ("c{c}.py#C{c}.put(...)", "method", "c{c}.py#C{c}", (10, 12), "def put(self, book, n={c})", _part(PYTHON, 10, 12, 4), None, None, "check/1/self/false base.Keeper/1/-/false"),
    ("c{c}.py#main(...)", "method", "c{c}.py", (15, 16), "def main()", _part(PYTHON, 15, 16), None, None, "sum/2/rate/false"),
]
JAVA_ROWS = [
    ("r/S{c}.java", "file", "r", (1, 17), None, JAVA, None, None, None),
    ("r/S{c}.java#S{c}", "class", "r/S{c}.java", (6, 17), "public class S{c}", _part(JAVA, 6, 17), None, "Keeper,Lendable", None),
    ("r/S{c}.java#S{c}.rate", "field", "r/S{c}.java#S{c}", (7, 7), "private int rate", "private int rate = {c};", "int", None, None),
    ("r/S{c}.java#S{c}.put(String, int)", "method", "r/S{c}.java#S{c}", (9, 12), "public void put(String, int)", _part(JAVA, 9, 12, 4), None, None, "check/1/-/false log/2/shelf/false Item/1/-/true"),
    ("r/S{c}.java#S{c}.check(String)", "method", "r/S{c}.java#S{c}", (16, 16), "void check(String)", _part(JAVA, 16, 16, 4), None, None, "put/2/-/false"),
]


def _parsed(sources: DataFrame) -> DataFrame:
    said = F.transform("dependency_names", lambda c: F.concat_ws("/", c["name"], c["arity"], F.coalesce(c["receiver"], F.lit("-")), c["is_creation"]))
    text = lambda name: F.nullif(F.array_join(name, ","), F.lit(""))
    return parse_sources(sources).select(
        "uid", "type", "parent_uid", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.nullif("signature", F.lit("")).alias("signature"), F.md5("body").alias("body_md5"),
        "field_type", text("inherits").alias("inherits"), F.nullif(F.array_join(said, " "), F.lit("")).alias("calls"),
    )


@query(_rows_sql("customer", "c_nationkey", "c_custkey", PYTHON_ROWS))
def parse_python(spark, sf_dir):
    """A Python file for every customer, through the parser."""
    customers = read(spark, sf_dir, "customer")
    return _parsed(customers.select(F.concat(F.lit("c"), "c_custkey", F.lit(".py")).alias("path"), _filled(PYTHON, "c_nationkey", "c_custkey").cast("binary").alias("body")))


@query(_rows_sql("supplier", "s_nationkey", "s_suppkey", JAVA_ROWS))
def parse_java(spark, sf_dir):
    """A Java file for every supplier, through the parser; its enum gives no row."""
    suppliers = read(spark, sf_dir, "supplier")
    return _parsed(suppliers.select(F.concat(F.lit("r/S"), "s_suppkey", F.lit(".java")).alias("path"), _filled(JAVA, "s_nationkey", "s_suppkey").cast("binary").alias("body")))


@query("""SELECT 'c' || c_custkey || '.py' AS uid, 'base.Keeper,n' || c_nationkey AS imports, 'c' || c_custkey AS package FROM customer
UNION ALL SELECT 'r/S' || s_suppkey || '.java', 'base.Keeper,util.Tool.cut', 'r.n' || s_nationkey FROM supplier""")
def parse_imports(spark, sf_dir):
    """Imports (distinct, in order) and packages of the same files."""
    customers, suppliers = read(spark, sf_dir, "customer"), read(spark, sf_dir, "supplier")
    sources = customers.select(F.concat(F.lit("c"), "c_custkey", F.lit(".py")).alias("path"), _filled(PYTHON, "c_nationkey", "c_custkey").cast("binary").alias("body"))
    sources = sources.unionByName(suppliers.select(F.concat(F.lit("r/S"), "s_suppkey", F.lit(".java")).alias("path"), _filled(JAVA, "s_nationkey", "s_suppkey").cast("binary").alias("body")))
    return parse_sources(sources).where("type = 'file'").select("uid", F.array_join(F.array_sort("imports"), ",").alias("imports"), "package")


# -- resolution


def _module(k: str, suffix: str = ".py"):
    return F.concat(F.lit("n"), k, F.lit(suffix))


def _calls(*sites):
    """An array of call sites ``(name, arity, receiver, is creation)``, names and receivers being columns or texts."""
    column = lambda x: x if not isinstance(x, str) else F.lit(x)
    return F.array(*[F.struct(column(n).alias("name"), F.lit(a).alias("arity"), (F.lit(None).cast("string") if r is None else column(r)).alias("receiver"), F.lit(made).alias("is_creation")) for n, a, r, made in sites]).cast(f"array<{CALL.simpleString()}>")


def _modules(spark, sf_dir, imports=None, suffix: str = ".py") -> DataFrame:
    """Nations as files with packages and the imports of ``imports(k, imports)``."""
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    rows = rows.join(imports, "k", "left") if imports is not None else rows.withColumn("imports", F.array().cast("array<string>"))
    uid = _module("k", suffix)
    return rows.select(uid.alias("uid"), uid.alias("name"), F.lit("file").alias("type"), uid.alias("path"), F.lit(".").alias("parent_uid"), F.concat(F.lit("n"), "k").alias("package"), F.coalesce("imports", F.array().cast("array<string>")).alias("imports"))


def _classes(spark, sf_dir, **more) -> DataFrame:
    """Suppliers as classes of their nation's module."""
    path = _module("s_nationkey")
    return read(spark, sf_dir, "supplier").select(F.concat(path, F.lit("#S"), "s_suppkey").alias("uid"), F.concat(F.lit("S"), "s_suppkey").alias("name"), F.lit("class").alias("type"), path.alias("path"), path.alias("parent_uid"), *[c.alias(n) for n, c in more.items()])


def _functions(spark, sf_dir, calls) -> DataFrame:
    """Customers as functions of their nation's module."""
    path = _module("c_nationkey")
    name = F.concat(F.lit("C"), "c_custkey")
    return read(spark, sf_dir, "customer").select(F.concat(path, F.lit("#"), name, F.lit("(...)")).alias("uid"), name.alias("name"), F.lit("method").alias("type"), path.alias("path"), path.alias("parent_uid"), F.lit(0).alias("arity"), calls.alias("dependency_names"))


def _resolved(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    exact, fuzzy = Resolver(save(_code_rows(out), "code")).resolve()
    return exact.withColumn("kind", F.lit("exact")).unionByName(fuzzy.withColumn("kind", F.lit("fuzzy")))


def _function(k: str, c: str) -> str:
    return f"'n' || {k} || '.py#C' || {c} || '(...)'"


@query(f"""SELECT {_function('c_nationkey', 'c_custkey')} AS source, 'n' || s_nationkey || '.py#S' || s_suppkey AS target, 'exact' AS kind
FROM customer JOIN supplier ON c_nationkey = s_nationkey AND s_suppkey = c_custkey % 100""")
def resolve_creation(spark, sf_dir):
    """Creations find the class of that name in the caller's package and stop, hit or miss: a function of that name is
    none, and no other tier is asked."""
    made = F.concat(F.lit("S"), F.col("c_custkey") % 100)
    sibling = F.concat(F.lit("C"), F.col("c_custkey") - 25)
    return _resolved(_modules(spark, sf_dir), _classes(spark, sf_dir), _functions(spark, sf_dir, _calls((made, 1, None, True), (sibling, 0, None, True))))


@query(f"""SELECT {_function('a.c_nationkey', 'a.c_custkey')} AS source, {_function('b.c_nationkey', 'b.c_custkey')} AS target, 'exact' AS kind
FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND b.c_custkey = a.c_custkey - 25
UNION ALL SELECT {_function('c_nationkey', 'c_custkey')}, 'n' || n_nationkey || '.py#x' || n_regionkey, 'exact' FROM customer JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = c_custkey % 5""")
def resolve_local(spark, sf_dir):
    """Calls without receiver find what stands beside the caller: a function, or (arity does not count here) a field."""
    beside = F.concat(F.lit("C"), F.col("c_custkey") - 25)
    name = F.concat(F.lit("x"), "n_regionkey")
    path = _module("n_nationkey")
    fields = read(spark, sf_dir, "nation").select(F.concat(path, F.lit("#"), name).alias("uid"), name.alias("name"), F.lit("field").alias("type"), path.alias("path"), path.alias("parent_uid"), F.lit("").alias("field_type"))
    return _resolved(_modules(spark, sf_dir), fields, _functions(spark, sf_dir, _calls((beside, 3, None, False), (F.concat(F.lit("x"), F.col("c_custkey") % 5), 0, None, False))))


@query("""WITH m AS (SELECT o_custkey AS c, 'm' || substr(o_orderpriority, 1, 1) AS name, o_orderkey % 3 AS arity, 'J' || o_custkey || '.java#J' || o_custkey || '.m' || substr(o_orderpriority, 1, 1) || '_' || o_orderkey || '()' AS uid FROM orders)
SELECT 'J' || c || '.java#J' || c || '.go()' AS source, min(uid) AS target, 'exact' AS kind FROM m WHERE (name = 'm1' AND arity = 0) OR (name = 'm2' AND arity = 1) GROUP BY c, name""")
def resolve_overloads(spark, sf_dir):
    """Where arity counts, a call finds the method beside it that takes as many arguments; of several the first by uid."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(F.lit("m"), F.substring("o_orderpriority", 1, 1)).alias("name"))
    path = F.concat(F.lit("J"), "o_custkey", F.lit(".java"))
    owner = F.concat(path, F.lit("#J"), "o_custkey")
    methods = orders.select(F.concat(owner, F.lit("."), "name", F.lit("_"), "o_orderkey", F.lit("()")).alias("uid"), "name", F.lit("method").alias("type"), path.alias("path"), owner.alias("parent_uid"), (F.col("o_orderkey") % 3).cast("int").alias("arity"))
    files = orders.select("o_custkey").distinct()
    go = files.select(F.concat(owner, F.lit(".go()")).alias("uid"), F.lit("go").alias("name"), F.lit("method").alias("type"), path.alias("path"), owner.alias("parent_uid"), F.lit(0).alias("arity"), _calls(("m1", 0, None, False), ("m2", 1, "other", False), ("m1", 7, None, False)).alias("dependency_names"))
    classes = files.select(owner.alias("uid"), F.concat(F.lit("J"), "o_custkey").alias("name"), F.lit("class").alias("type"), path.alias("path"), path.alias("parent_uid"))
    files = files.select(path.alias("uid"), path.alias("name"), F.lit("file").alias("type"), path.alias("path"), F.lit(".").alias("parent_uid"), F.lit("").alias("package"))
    return _resolved(files, classes, go, methods)


@query("""WITH s AS (SELECT 'n' || s_nationkey || '.py#S' || s_suppkey AS uid, 'n' || s_nationkey || '.py#Base' AS base, * FROM supplier),
c AS (SELECT 'n' || c_nationkey || '.py#K' || c_custkey AS uid, * FROM customer)
SELECT uid AS source, base AS target, 'exact' AS kind FROM s
UNION ALL SELECT c.uid, s.uid, 'exact' FROM c JOIN s ON c_nationkey = s_nationkey AND s_suppkey = c_custkey % 100
UNION ALL SELECT c.uid || '.go(...)', CASE WHEN s_acctbal > 0 THEN s.uid ELSE base END || '.line(...)', 'exact' FROM c JOIN s ON c_nationkey = s_nationkey AND s_suppkey = c_custkey % 100
UNION ALL SELECT uid || '.go(...)', uid || '.own(...)', 'exact' FROM c""")
def resolve_receiver(spark, sf_dir):
    """Calls on a receiver go by its type: that of the class's field of that name (through ``self.`` or not) or the class
    itself for ``self``; the type's own method, else what it inherits. Inheritance and field types are dependencies, too."""
    suppliers = _classes(spark, sf_dir, inherits=F.array(F.lit("Base")), rich=F.col("s_acctbal") > 0)
    bases = read(spark, sf_dir, "nation").select(F.concat(_module("n_nationkey"), F.lit("#Base")).alias("uid"), F.lit("Base").alias("name"), F.lit("class").alias("type"), _module("n_nationkey").alias("path"), _module("n_nationkey").alias("parent_uid"))
    line = lambda rows: rows.select(F.concat("uid", F.lit(".line(...)")).alias("uid"), F.lit("line").alias("name"), F.lit("method").alias("type"), "path", F.col("uid").alias("parent_uid"), F.lit(0).alias("arity"))
    path = _module("c_nationkey")
    owner = F.concat(path, F.lit("#K"), "c_custkey")
    customers = read(spark, sf_dir, "customer")
    classes = customers.select(owner.alias("uid"), F.concat(F.lit("K"), "c_custkey").alias("name"), F.lit("class").alias("type"), path.alias("path"), path.alias("parent_uid"))
    fields = customers.select(F.concat(owner, F.lit(".dealer")).alias("uid"), F.lit("dealer").alias("name"), F.lit("field").alias("type"), path.alias("path"), owner.alias("parent_uid"), F.concat(F.lit("S"), F.col("c_custkey") % 100).alias("field_type"))
    through = F.when(F.col("c_custkey") % 2 == 0, "self.dealer").otherwise("dealer")
    method = lambda name, calls: customers.select(F.concat(owner, F.lit(f".{name}(...)")).alias("uid"), F.lit(name).alias("name"), F.lit("method").alias("type"), path.alias("path"), owner.alias("parent_uid"), F.lit(0).alias("arity"), calls.alias("dependency_names"))
    go = method("go", _calls(("line", 0, through, False), ("own", 0, "self", False)))
    return _resolved(_modules(spark, sf_dir), suppliers.drop("rich"), bases, line(bases), line(suppliers.where("rich")), classes, fields, go, method("own", _calls()))


@query(f"""WITH s AS (SELECT s_suppkey, s_nationkey AS k, 'n' || s_nationkey || '.py#S' || s_suppkey AS uid FROM supplier)
SELECT a.uid AS source, b.uid AS target, 'exact' AS kind FROM s a JOIN s b ON b.k = (a.k + 1) % 25
UNION ALL SELECT {_function('c_nationkey', 'c_custkey')}, coalesce(own.uid, next.uid), 'exact' FROM customer
LEFT JOIN s own ON own.s_suppkey = c_custkey % 100 AND own.k = c_nationkey LEFT JOIN s next ON next.s_suppkey = c_custkey % 100 AND next.k = (c_nationkey + 1) % 25
WHERE own.uid IS NOT NULL OR next.uid IS NOT NULL""")
def resolve_imports(spark, sf_dir):
    """Modules import the classes of the next nation: classes depend on what their file imports, and a call that finds no
    method is a reference to a type, by the caller's package first and then by its imports."""
    listed = read(spark, sf_dir, "supplier").groupBy(F.pmod(F.col("s_nationkey") + 24, F.lit(25)).alias("k")).agg(F.sort_array(F.collect_list(F.concat(F.lit("n"), "s_nationkey", F.lit(".S"), "s_suppkey"))).alias("imports"))
    named = F.concat(F.lit("S"), F.col("c_custkey") % 100)
    return _resolved(_modules(spark, sf_dir, listed), _classes(spark, sf_dir), _functions(spark, sf_dir, _calls((named, 1, "shop", False))))


# -- descriptions

CLASS_HEAD = "class C:\n"
CLASS_LINE = "    def m{k}(self):\n        return {c}\n"


@query("""WITH m AS (SELECT l_orderkey AS o, l_linenumber AS k, min(l_suppkey) AS c FROM lineitem GROUP BY ALL)
SELECT o AS id, md5('class C:' || chr(10) || string_agg(CASE WHEN k % 2 = 0 THEN '    M-' || k || ' | def m' || k || '(self)' || chr(10) || '// line ' || k ELSE '    def m' || k || '(self):' || chr(10) || '        return ' || c END, chr(10) ORDER BY k) || chr(10)) AS code_md5 FROM m GROUP BY o""")
def class_skeletons(spark, sf_dir):
    """Orders as classes with a method for each line; every second one is described and put in brief."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("c"))
    own = _filled(CLASS_LINE, "l_linenumber", "c")
    body = F.regexp_replace(F.regexp_replace(own, "^ +", ""), "\n$", "")
    name = F.concat(F.lit("def m"), "l_linenumber", F.lit("(self)"))
    said = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("line "), "l_linenumber"))
    lines = lines.select("l_orderkey", F.struct(F.col("l_linenumber").alias("k"), own.alias("text"), body.alias("body"), F.concat(F.lit("M-"), "l_linenumber").alias("id"), name.alias("signature"), said.alias("description")).alias("m"))
    classes = lines.groupBy(F.col("l_orderkey").cast("long").alias("id")).agg(F.sort_array(F.collect_list("m")).alias("ms"))

    def work(frames):
        import hashlib

        import pandas as pd

        for f in frames:
            out = []
            for ms in f["ms"]:
                code = CLASS_HEAD + "".join(m["text"] for m in ms)
                children = [{"id": m["id"], "body": m["body"], "signature": m["signature"], "description": m["description"], "start_line": 2 + 2 * n} for n, m in enumerate(ms)]
                out.append(hashlib.md5(describe.skeletonize(code, 0, describe.spans_of(code, 1, children)).encode()).hexdigest())
            yield pd.DataFrame({"id": f["id"], "code_md5": out})

    return classes.mapInPandas(work, "id long, code_md5 string")


@query(f"""WITH {VIEW}, files AS (SELECT parent_uid AS uid, count(*) AS n, min(uid) AS only FROM (SELECT uid, parent_uid FROM customers UNION ALL SELECT uid, parent_uid FROM suppliers) GROUP BY 1),
said AS (SELECT uid, 'Empty File' AS description FROM customers UNION ALL SELECT uid, 'Empty File' FROM suppliers
  UNION ALL SELECT uid, CASE coalesce(n, 0) WHEN 0 THEN 'Empty Directory' WHEN 1 THEN 'Empty File' ELSE n || ' parts' END FROM places LEFT JOIN files USING (uid)
  UNION ALL SELECT 'R' || n_regionkey, count(*) || ' parts' FROM nation GROUP BY 1)
SELECT uid, description FROM said""")
def describe_levels(spark, sf_dir):
    """Files without a body, nations that hold them, regions that hold nations: the rules, and a describer that counts."""
    view = by_uid(struct_view(spark, sf_dir)).where(F.col("type").isin("file", "directory"))
    rows = view.select("id", "uid", "name", "type", "path", "parent_id", *[F.lit(None).cast("string").alias(n) for n in ("description", "signature", "body")], F.lit(None).cast("int").alias("start_line"))
    return describe.describe(save(rows, "files"), lambda asked: f"{len(asked['children'])} parts").select("uid", "description")


@query(f"""WITH {VIEW}, said AS (SELECT {id_sql('uid', 'type')} AS id, type, {id_sql('parent_uid', "CASE type WHEN 'method' THEN 'class' WHEN 'class' THEN 'file' ELSE 'directory' END")} AS parent_id, length(uid) % 3 = 0 AS bare FROM structs)
SELECT id FROM said WHERE bare UNION SELECT parent_id FROM said WHERE bare AND parent_id IS NOT NULL""")
def needs_description(spark, sf_dir):
    """Every third struct (by the length of its uid) has no description: it needs one, and so does what holds it."""
    view = struct_view(spark, sf_dir).withColumn("description", F.when(F.length("uid") % 3 != 0, "said"))
    return describe.needs_description(save(view.select("id", "type", "parent_id", "description"), "view")).select("id")


# -- inspection and the store


@query(f"""WITH asked(pos, ref) AS (VALUES (0, 'R1/N1'), (1, 'R2'), (2, 'nothing')), {VIEW},
top AS (SELECT pos, ref, 0 AS depth, s.uid, type FROM asked LEFT JOIN structs s ON s.uid = ref),
one AS (SELECT pos, ref, 1 AS depth, s.uid, s.type FROM top JOIN structs s ON s.parent_uid = top.uid WHERE top.type NOT IN ('field', 'method')),
two AS (SELECT pos, ref, 2 AS depth, s.uid, s.type FROM one JOIN structs s ON s.parent_uid = one.uid WHERE one.type NOT IN ('field', 'method')),
every AS (SELECT * FROM top UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two),
callers AS (SELECT target AS uid, count(*) AS n FROM leaf GROUP BY 1)
SELECT pos, ref, depth, every.uid, type, coalesce(callers.n, 0)::INT AS n_inbound, CASE WHEN every.uid IS NULL THEN 'not found: ' || ref END AS error FROM every LEFT JOIN callers ON callers.uid = every.uid""")
def inspect_levels(spark, sf_dir):
    """Two asked directories with two levels below and their dependencies, and one that is not there."""
    view = struct_view(spark, sf_dir)
    for name, kind in (("signature", "string"), ("description", "string"), ("body", "string"), ("start_line", "int"), ("end_line", "int")):
        view = view.withColumn(name, F.lit(None).cast(kind))
    view = save(view, "view")
    edges = named_edges(view, spark, sf_dir)
    found = tree.inspect(view, edges, ["R1/N1", "R2", "nothing"])
    return found.select("pos", "ref", "depth", "uid", "type", F.coalesce(F.size("inbound"), F.lit(0)).alias("n_inbound"), "error")


@query(f"""WITH {VIEW}, named AS (SELECT type, CASE WHEN type = 'class' AND length(uid) % 2 = 0 THEN 'changed' WHEN type = 'file' THEN 'first' END AS description FROM structs)
SELECT type, coalesce(description, '-') AS description, count(*) AS n FROM named GROUP BY ALL
UNION ALL SELECT 'edges', '-', count(*) FROM leaf UNION ALL SELECT 'vectors', '-', count(*) FROM suppliers""")
def store_round_trip(spark, sf_dir):
    """The view written to a store, some descriptions put in afterwards, and read back."""
    from .catalogue import leaf_edges

    view = struct_view(spark, sf_dir)
    held = [f.name for f in STRUCTS if f.name in view.columns]
    rows = view.select(*held, "ref", F.when(F.col("type") == "file", "first").alias("description"))
    rows = save(rows.select("ref", *[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in STRUCTS]), "view")
    edges = leaf_edges(rows, spark, sf_dir).select(F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.lit("depends_on").alias("edge_type"))
    supplier = rows.where((F.col("type") == "file") & F.substring_index("uid", "/", -1).startswith("S"))
    vectors = supplier.select(F.col("id").alias("struct_id"), F.array(F.lit(1.0)).cast("array<float>").alias("vector"))
    store = Store(spark, new_scratch(spark, "store"))
    store.write(rows.select(*STRUCTS.fieldNames()), edges.select(*EDGES.fieldNames()), vectors.select(*VECTORS.fieldNames()))
    store.update_descriptions(rows.where((F.col("type") == "class") & (F.length("uid") % 2 == 0)).select("id", "uid", F.lit("changed").alias("description")))
    structs, edges, vectors = store.tables()
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("type"), F.lit("-").alias("description"), "n")
    by_type = structs.groupBy("type", F.coalesce("description", F.lit("-")).alias("description")).agg(F.count("*").alias("n"))
    return by_type.unionByName(count(edges, "edges")).unionByName(count(vectors, "vectors"))
