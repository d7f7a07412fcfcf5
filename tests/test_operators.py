from sylva.operators import describe, graph, reuse, search
from sylva.operators.resolve import resolve
from sylva.schema import CALL

CODE = "uid string, name string, type string, path string, parent_uid string, package string, imports array<string>, inherits array<string>, field_type string, arity int, dependency_names array<" + CALL.simpleString() + ">"


def code(spark, *rows):
    return spark.createDataFrame([tuple(r.get(k) for k in ("uid", "name", "type", "path", "parent_uid", "package", "imports", "inherits", "field_type", "arity", "calls")) for r in rows], CODE)


def file(path, package, *imports):
    return {"uid": path, "name": path, "type": "file", "path": path, "parent_uid": ".", "package": package, "imports": list(imports)}


def cls(path, name, *inherits, parent=None):
    return {"uid": (parent or path + "#") + name, "name": name, "type": "class", "path": path, "parent_uid": path, "inherits": list(inherits)}


def method(parent, name, path, arity=0, calls=()):
    joint = "#" if parent == path else "."
    return {"uid": f"{parent}{joint}{name}()", "name": name, "type": "method", "path": path, "parent_uid": parent, "arity": arity, "calls": list(calls)}


def pairs(df):
    return {(r["source"], r["target"]) for r in df.collect()}


def test_strict_arity_and_overloads(spark):
    p = "A.java"
    exact, fuzzy = resolve(code(spark, file(p, "x"), cls(p, "A"), method(p + "#A", "f", p, 1), method(p + "#A", "g", p, 0, [("f", 1, None, False), ("f", 2, None, False)])))
    assert pairs(exact) == {("A.java#A.g()", "A.java#A.f()")} and not pairs(fuzzy)


def test_receiver_tells_candidates_apart_and_bags_count(spark):
    p = "m.py"
    rows = [file(p, "m"), cls(p, "Cat"), cls(p, "Dog"), method(p + "#Cat", "go", p), method(p + "#Dog", "go", p), method(p, "a", p, 0, [("go", 0, "cat", False)]), method(p, "b", p, 0, [("go", 0, "thing", False)])]
    exact, fuzzy = resolve(code(spark, *rows))
    assert pairs(exact) == {("m.py#a()", "m.py#Cat.go()")}
    assert pairs(fuzzy) == {("m.py#b()", "m.py#Cat.go()"), ("m.py#b()", "m.py#Dog.go()")}


def test_same_method_through_two_imports_is_fuzzy(spark):
    rows = [file("t.py", "t"), method("t.py", "x", "t.py"), file("u.py", "u", "t.one", "t.two"), method("u.py", "y", "u.py", 0, [("x", 0, None, False)])]
    exact, fuzzy = resolve(code(spark, *rows))
    assert not pairs(exact) and pairs(fuzzy) == {("u.py#y()", "t.py#x()")}


def test_inheritance_walks_depth_first_and_survives_cycles(spark):
    p = "m.py"
    rows = [file(p, "m"), cls(p, "A", "B", "C"), cls(p, "B", "D"), cls(p, "C"), cls(p, "D", "A"), method(p + "#C", "f", p), method(p + "#D", "f", p), method(p + "#A", "g", p, 0, [("f", 0, "self", False)])]
    exact, _ = resolve(code(spark, *rows))
    assert ("m.py#A.g()", "m.py#D.f()") in pairs(exact) and ("m.py#A.g()", "m.py#C.f()") not in pairs(exact)


def test_creation_stops_and_longest_package_wins(spark):
    rows = [file("a.java", "x"), file("b.java", "x.y"), cls("a.java", "T"), cls("b.java", "T"), file("c.java", "z", "x.y.T"), cls("c.java", "K"), method("c.java#K", "f", "c.java", 0, [("T", 0, None, True), ("Gone", 0, None, True)])]
    exact, _ = resolve(code(spark, *rows))
    assert ("c.java#K.f()", "b.java#T") in pairs(exact) and ("c.java#K.f()", "a.java#T") not in pairs(exact)


def test_roll_up_stops_where_parents_meet(spark):
    parents = spark.createDataFrame([("m1", "c1"), ("c1", "f1"), ("f1", "d"), ("m2", "c2"), ("c2", "f2"), ("f2", "d"), ("d", None)], "id string, parent_id string")
    got = pairs(graph.roll_up(spark.createDataFrame([("m1", "m2"), ("m1", "m1")], "source string, target string"), parents))
    assert got == {("m1", "m2"), ("c1", "c2"), ("f1", "f2")}


def test_carry_over_and_stale(spark):
    new = spark.createDataFrame([("a", "1", None, None), ("b", "2", None, None), ("d", "", None, None)], "uid string, diff_hash string, description string, vector array<float>")
    old = spark.createDataFrame([("a", "1", "[STALE] old", [1.0]), ("b", "9", "other", None), ("d", "", "dir", None)], new.schema)
    got = {r["uid"]: (r["description"], r["carried"]) for r in reuse.carry_over(new, old).collect()}
    assert got == {"a": ("old", True), "b": (None, False), "d": (None, False)}
    marked = {r["description"] for r in reuse.mark_stale(old).collect()}
    assert marked == {"[STALE] old", "[STALE] other", "[STALE] dir"}


def test_search_over_fetch_may_return_fewer(spark):
    structs = spark.createDataFrame([(f"M-{k}", f"u{k}", "method" if k else "class") for k in range(30)], "id string, uid string, type string")
    vectors = spark.createDataFrame([(f"M-{k}", [float(100 - k), 0.0]) for k in range(30)], "struct_id string, vector array<float>")
    assert search.search(structs, vectors, [70.0, 0.0], "class", 2).count() == 0
    assert [r["id"] for r in search.search(structs, vectors, [70.0, 0.0], "CLAS", 2, prefilter=True).collect()] == ["M-0"]
    assert [r["id"] for r in search.search(structs, vectors, [71.0, 0.0], top_k=2).collect()] == ["M-29", "M-28"]


def test_retries_and_replies():
    class Busy(Exception):
        code = 503

    waits, left = [], [Busy(), Busy(), None]

    def call():
        e = left.pop(0)
        if e:
            raise e
        return "said"

    assert describe.with_retries(call, sleep=waits.append) == "said" and waits == [2.0, 4.0]
    assert describe.with_retries(lambda: 1 / 0, sleep=waits.append) is None and len(waits) == 2
    assert describe.index_replies({"0": "a", "x": "b", "7": "c", 1: "d"}, 2) == {0: "a", 1: "d"}


def test_skeletonize_splices_from_the_end():
    body = "class A:\n    def f(self): pass\n    def g(self): pass"
    f, g = body.index("def f"), body.index("def g")
    out = describe.skeletonize(body, 0, [(f, f + 17, "M-1", "def f(self)", "does f"), (g, g + 17, "M-2", "def g(self)", "")])
    assert out == "class A:\n    M-1 | def f(self)\n// does f\n    def g(self): pass"


def test_strategies_and_needs(spark):
    import pytest

    made = describe.strategy("x", {"x": lambda size=1: size}, size=3, other=4)
    assert made == 3 and describe.strategy("none", {}) is None
    with pytest.raises(ValueError, match="unknown strategy"):
        describe.strategy("y", {"x": dict})
    rows = [("C-1", "class", None, "said"), ("V-1", "field", "C-1", None), ("C-2", "class", None, "said"), ("M-1", "method", "C-2", "")]
    structs = spark.createDataFrame(rows, "id string, type string, parent_id string, description string")
    assert {r["id"] for r in describe.needs_description(structs).collect()} == {"V-1", "C-2", "M-1"}
