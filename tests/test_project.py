"""A small project, built, queried and kept current."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from sylva.operators import graph
from sylva.plans.project import Project, coerce_list
from sylva.schema import STORE_VERSION
from sylva.store import StoreConflict, StoreError, bucket_of
from sylva.streaming.watch import apply_changes, diff, snapshot

FILES = {
    "app.py": "from store.shelf import Shelf\nfrom tools import shout as loud\nimport tools\n\nshelf: Shelf = Shelf()\n\n\ndef main(title):\n    shelf.put(title)\n    loud(title)\n    tools.whisper(title)\n    return Shelf()\n",
    "tools.py": "def shout(text):\n    return whisper(text).upper()\n\n\ndef whisper(text):\n    return text\n",
    "store/shelf.py": "from store.base import Keeper\n\n\nclass Shelf(Keeper):\n    owner: Keeper\n\n    def put(self, book):\n        self.check(book)\n        self.owner.log(book)\n        return self.keep(book)\n\n    def check(self, book):\n        return book\n",
    "store/base.py": "class Keeper:\n    def keep(self, thing):\n        return thing\n\n    def log(self, thing):\n        print(thing)\n",
    "store/__init__.py": "",
    "notes.txt": "not code",
}


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "proj"
    for name, text in FILES.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(text)
    return base


def named_edges(project):
    structs, edges, _ = project.store.tables()
    uid = {r["id"]: r["uid"] for r in structs.select("id", "uid").collect()}
    return {(uid[r["source_id"]], uid[r["target_id"]], r["edge_type"]) for r in edges.collect()}


def sound(project):
    structs, edges, vectors = project.store.tables()
    assert [r["n"] for r in graph.orphans(structs, edges, vectors).collect()] == [0, 0]


def test_build_and_query(spark, root):
    project = Project(spark, str(root))
    with pytest.raises(StoreError):
        project.status()
    counts = project.parse()
    assert counts["structs"] == 18 and counts["carried"] == 0
    edges = named_edges(project)
    leaf = {(a, b) for a, b, k in edges if k == "depends_on" and "#" in a}
    assert ("app.py#main(...)", "store/shelf.py#Shelf.put(...)") in leaf  # by the type of the module's field
    assert ("app.py#main(...)", "store/shelf.py#Shelf") in leaf  # a type reference
    assert ("tools.py#shout(...)", "tools.py#whisper(...)") in leaf  # same container
    assert ("store/shelf.py#Shelf.put(...)", "store/shelf.py#Shelf.check(...)") in leaf  # self
    assert ("store/shelf.py#Shelf.put(...)", "store/base.py#Keeper.log(...)") in leaf  # self.field
    assert ("store/shelf.py#Shelf.put(...)", "store/base.py#Keeper.keep(...)") in leaf  # inherited
    assert ("store/shelf.py#Shelf", "store/base.py#Keeper") in leaf
    assert ("app.py", "store/shelf.py", "depends_on") in edges or ("app.py", "store/shelf.py#Shelf", "depends_on") in edges
    assert ("store/shelf.py", "store/base.py", "depends_on") in edges  # rolled up
    sound(project)

    text = project.render_skeleton()
    assert text.splitlines()[0].endswith("|.") and "    F-" in text and "Shelf.put" not in text and "tools.py#shout(...)" in text
    assert "tools.py#shout" not in project.render_skeleton(files_only=True)
    assert len(project.render_skeleton(max_lines=3).splitlines()) == 4
    with pytest.raises(FileNotFoundError):
        project.skeleton("nowhere")
    shown = project.render_inspect("store/shelf.py#Shelf, nothing")
    lines = shown.splitlines()
    assert "@L4-13 | " in lines[0] and lines[-1] == "not found: nothing" and lines[lines.index("fields:") + 1].endswith("| owner: Keeper")
    assert {x.partition(" | ")[2] for x in lines[lines.index("methods:") + 1 :] if x.startswith("    M-")} == {"def put(self, book)", "def check(self, book)"}
    assert any(x.startswith("> ") and "store/base.py#Keeper" in x for x in lines)
    assert "def put" in project.render_inspect(["store/shelf.py#Shelf.put(...)"], include_body=True)
    hits = project.search("whisper text", type_filter="METHOD", top_k=2).collect()
    assert len(hits) == 2 and hits[0]["distance"] <= hits[1]["distance"] and {h["type"] for h in hits} == {"method"}
    assert {r["name"]: r["n"] for r in project.status().where("kind = 'struct'").collect()}["class"] == 2

    again = project.parse()
    assert again["carried"] == again["structs"] - 2  # directories have no hash
    assert again["embedded"] == 2 and again["resolved"] == counts["resolved"]
    assert named_edges(project) == edges
    assert project.export_lockfile() is True and project.export_lockfile() is False
    assert project.clean() and not project.store.exists()


def changes(spark, root, edit):
    before = snapshot(str(root))
    edit()
    return spark.createDataFrame([(p, c, 1) for p, c in diff(before, snapshot(str(root)))], "path string, change string, seq long")


def test_incremental_equals_rebuild(spark, root):
    project = Project(spark, str(root), store=str(root / ".sylva" / "a"))
    project.parse()
    base = root / "store" / "base.py"
    done = apply_changes(project, changes(spark, root, lambda: base.write_text(base.read_text().replace("def log", "def note"))), reresolve=True)
    assert done["removed"] == 1
    sound(project)
    fresh = Project(spark, str(root), store=str(root / ".sylva" / "b"))
    fresh.parse()
    assert named_edges(project) == named_edges(fresh)

    def edit():
        shutil.rmtree(root / "store")
        os.makedirs(root / "new" / "deep")
        (root / "new" / "deep" / "x.py").write_text("from tools import shout\n\n\ndef f():\n    return shout('a')\n")

    done = apply_changes(project, changes(spark, root, edit))
    structs = {r["uid"] for r in project.store.read("structs").collect()}
    assert "store" not in structs and not any(u.startswith("store/") for u in structs)
    assert {"new", "new/deep", "new/deep/x.py#f(...)"} <= structs
    assert any(a == "new/deep/x.py#f(...)" for a, _, k in named_edges(project) if k != "is_child_of")
    sound(project)


def test_describe_marks_and_lock(spark, root):
    def describer(row):
        return f"about {row['name']}"

    project = Project(spark, str(root), describer=describer)
    project.parse()
    said = {r["uid"]: r["description"] for r in project.store.read("structs").collect()}
    assert said["tools.py#shout(...)"] == "about shout" and said["store/__init__.py"] == "Empty File"
    assert said["store/base.py"] == said["store/base.py#Keeper"]  # the only child's text
    assert said["store/shelf.py#Shelf.owner"] is None
    project.export_lockfile(with_vectors=True)
    other = Project(spark, str(root), store=str(root / ".sylva" / "other"))
    other.parse()
    assert {r["uid"]: r["description"] for r in other.store.read("structs").collect()}["tools.py#shout(...)"] == "about shout"


def arrives(project, query, uid):
    for _ in range(240):
        if project.store.read("structs").where(f"uid = '{uid}'").count():
            return
        time.sleep(0.5)
    raise AssertionError(query.exception() or f"{uid} never arrived")


def test_watch(spark, root, tmp_path):
    """What changes between the build and the watch arrives, as does what changes while the watch runs and what changed
    while none ran."""
    project = Project(spark, str(root))
    project.parse()
    (root / "early.py").write_text("def early():\n    return 1\n")
    query = project.watch(checkpoint=str(tmp_path / "ck"), seconds=0.2)
    try:
        arrives(project, query, "early.py#early(...)")
        (root / "late.py").write_text("def late():\n    return 1\n")
        arrives(project, query, "late.py#late(...)")
    finally:
        query.stop()
    (root / "between.py").write_text("def between():\n    return 1\n")
    again = project.watch(seconds=0.2)  # a new checkpoint
    try:
        arrives(project, again, "between.py#between(...)")
    finally:
        again.stop()
    assert project.store.require()["applied"]["seq"] >= 3
    sound(project)


def test_a_watch_of_an_earlier_build_goes_on(spark, root, tmp_path):
    project = Project(spark, str(root))
    project.parse()
    (root / "one.py").write_text("def one():\n    return 1\n")
    query = project.watch(checkpoint=str(tmp_path / "ck"), seconds=0.2)
    arrives(project, query, "one.py#one(...)")
    query.stop()
    project.parse()
    (root / "two.py").write_text("def two():\n    return 1\n")
    again = project.watch(checkpoint=str(tmp_path / "ck"), seconds=0.2)  # its offsets are of the build before
    try:
        arrives(project, again, "two.py#two(...)")
    finally:
        again.stop()


def test_a_change_writes_its_buckets_only(spark, root):
    for k in range(30):
        (root / f"plain{k}.py").write_text(f"def plain{k}():\n    return {k}\n")
    project = Project(spark, str(root))
    project.parse()
    before = project.store.require()
    base = root / "plain7.py"
    done = apply_changes(project, changes(spark, root, lambda: base.write_text("def other():\n    return 7\n")))
    after = project.store.require()
    wanted = {str(r["k"]) for r in spark.createDataFrame([("plain7.py",), (".",)], "path string").select(bucket_of("path", before["buckets"]).alias("k")).collect()}
    for name in ("structs", "edges", "vectors"):
        moved = {k for k, v in after["tables"][name].items() if before["tables"][name].get(k) != v}
        assert moved <= wanted and moved, name
    assert done["removed"] == 1 and done["buckets"] == len(wanted) < before["buckets"]
    structs = {r["uid"] for r in project.store.read("structs").collect()}
    assert "plain7.py#other(...)" in structs and "plain7.py#plain7(...)" not in structs and "plain8.py#plain8(...)" in structs
    sound(project)
    shout = project.store.read("structs").where("name = 'shout'").first()["id"]
    project.store.update_descriptions(spark.createDataFrame([(shout, "loud")], "id string, description string"))
    last = project.store.require()
    assert sum(v != after["tables"]["structs"].get(k) for k, v in last["tables"]["structs"].items()) == 1
    with pytest.raises(StoreConflict):
        project.store.write(*project.store.tables(), touched=[0], base=after)


def test_batches_and_conflicts(spark, root, monkeypatch):
    """A batch that comes again is passed over; one that another writer overtook is worked out again."""
    project = Project(spark, str(root))
    project.parse()
    epoch = project.store.require()["applied"]["epoch"]
    batch = changes(spark, root, lambda: (root / "x.py").write_text("def x():\n    return 1\n"))
    assert apply_changes(project, batch, mark={"epoch": epoch, "seq": 1})["changed"] == 1
    assert apply_changes(project, batch, mark={"epoch": epoch, "seq": 1}) == {"changed": 0, "deleted": 0, "removed": 0, "buckets": 0}
    real, left = project.store.write, [1]

    def write(*a, **k):
        if left:
            left.pop()
            structs = project.store.read("structs")
            one = structs.where("name = 'shout'").first()["id"]
            monkeypatch.setattr(project.store, "write", real)
            project.store.update_descriptions(spark.createDataFrame([(one, "overtaken")], "id string, description string"))
            monkeypatch.setattr(project.store, "write", write)
        return real(*a, **k)

    monkeypatch.setattr(project.store, "write", write)
    batch = changes(spark, root, lambda: (root / "y.py").write_text("def y():\n    return 1\n"))
    apply_changes(project, batch, mark={"epoch": epoch, "seq": 2})
    structs = {r["uid"]: r["description"] for r in project.store.read("structs").collect()}
    assert structs["tools.py#shout(...)"] == "overtaken" and {"x.py#x(...)", "y.py#y(...)"} <= set(structs)


def test_sync_and_status(spark, root):
    project = Project(spark, str(root))
    first = project.sync(watch=False)
    assert first["structs"] == 18 and first["resolved"] > 5 and first["embedded"] == 16 and first["described"] == 0
    assert project.sync(watch=False) is None and project.sync(use_cache=False, watch=False)["carried"] == 0
    held = {(r["kind"], r["name"]): r["n"] for r in project.status().collect()}
    assert held["store", "bytes"] > 1000 and abs(held["store", "written"] - time.time()) < 600
    assert project.skeleton(str(root / "store")).count() == project.skeleton("store").count() > 0


def test_describes_classes_by_skeleton_and_methods_in_batches(spark, root):
    def describer(asked):
        if asked["kind"] == "class":
            assert asked["uid"] != "store/shelf.py#Shelf" or "def put" in asked["code"]
            return {"description": f"class {asked['name']}: {len(asked['code'])}", "methods": {k: f"said of {v}" for k, v in asked["methods"].items()} | {"x": "no number", "99": "none such"}}
        if asked["kind"] == "file":
            return {"description": f"file of {sorted(asked.get('described', {}))}", "methods": {k: f"from {len(v)}" for k, v in asked["methods"].items()}}
        return None if asked["uid"] == "store" else "dir"

    (root / "alone").mkdir()
    project = Project(spark, str(root), describers={"plain": lambda: describer, "other": lambda model: 1 / 0})
    counts = project.parse(llm="plain")
    said = {r["uid"]: r["description"] for r in project.store.read("structs").collect()}
    assert said["store/base.py#Keeper.keep(...)"] == "said of def keep(self, thing)" and said["store/base.py"] == said["store/base.py#Keeper"]
    assert said["tools.py#shout(...)"].startswith("from ") and said["tools.py"] == "file of []" and said["store"] is None
    assert said["alone"] == "Empty Directory" and said["."] == "dir" and said["store/shelf.py#Shelf.owner"] is None
    assert counts["described"] == sum(x is not None for x in said.values())
    structs, _, held = project.store.tables()
    vectors = {r["uid"]: r["vector"] for r in held.join(structs.select("id", "uid"), F.col("struct_id") == F.col("id")).collect()}
    assert vectors["store/base.py"] == vectors["store/base.py#Keeper"]
    assert not {"alone", "store", "store/__init__.py"} & set(vectors) and "." in vectors
    assert project.parse(no_llm=True)["described"] == 0
    with pytest.raises(ValueError, match="unknown strategy"):
        project.parse(llm="nobody")


def test_shell_and_updates(spark, root, capsys):
    from sylva.__main__ import main
    from sylva.streaming.watch import Watchers

    assert main(["status", str(root)], spark) == 1
    assert main(["parse", str(root), "--language", "python"], spark) == 0
    assert main(["skeleton", str(root), "--depth", "1"], spark) == 0
    assert main(["search", str(root), "--query", "whisper", "--filter", "method"], spark) == 0
    assert main(["inspect", str(root), "--ids", "tools.py"], spark) == 0
    said = capsys.readouterr().out
    assert "18 structs" in said and "|tools.py" in said and "(method)" in said
    project = Project(spark, str(root))
    structs = project.store.read("structs")
    shout = structs.where("name = 'shout'").first()["id"]
    project.store.update_descriptions(spark.createDataFrame([(shout, "louder")], "id string, description string"))
    assert [r["uid"] for r in project.store.read("structs").where("description = 'louder'").collect()] == ["tools.py#shout(...)"]
    assert main(["export", str(root)], spark) == 0 and "louder" in (root / "sylva.lock.json").read_text()
    watchers = Watchers()
    first, second = watchers.start(project), watchers.start(project)
    assert not first.isActive and second.isActive
    watchers.stop_all()
    assert not second.isActive and main(["clean", str(root)], spark) == 0


def test_incompatible_store_is_refused_then_rebuilt(spark, root):
    project = Project(spark, str(root))
    project.parse()
    meta = root / ".sylva" / "store" / "_meta.json"
    meta.write_text(meta.read_text().replace(f'"format": {STORE_VERSION}', '"format": 1'))
    (root / ".sylva" / "store" / "._meta.json.crc").unlink(missing_ok=True)
    with pytest.raises(StoreError):
        project.status()
    assert project.parse()["carried"] == 0
    assert project.store.is_compatible()


def test_init(spark, tmp_path):
    project = Project(spark, str(tmp_path))
    assert project.init() == ["sylva.toml", ".sylvaignore", ".gitignore"] and project.init() == []
    (tmp_path / "sylva.toml").write_text('language = "java"\n')
    assert Project(spark, str(tmp_path)).config.language == "java" and Project(spark, str(tmp_path), language="html").config.language == "html"
    assert project.init(force=True) == ["sylva.toml", ".sylvaignore"]
    with pytest.raises(ValueError):
        Project(spark, str(tmp_path), language="cobol")


def test_references():
    assert coerce_list('["a", "b"]') == ["a", "b"] and coerce_list("a, b") == ["a", "b"] and coerce_list(["x"]) == ["x"] and coerce_list("f(a, b)") == ["f(a, b)"]
