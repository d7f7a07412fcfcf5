from sylva.parsers.python_source import parse

SOURCE = b'''import os
import numpy as np
from math import *
from . import sibling
from ..base import Root as Base, helper

LIMIT = 10


class Reader(Base, metaclass=Meta):
    path: str = ""
    a, b = 1, 2

    @property
    def size(self) -> int:
        return len(self.path)

    @classmethod
    async def load(cls, name: str, *, deep: bool = True, table: dict[str, list[tuple[int, int, int, int, int]]] = None):  # a, b
        np.array(Base(1)(2)); (name).lower(); sum(x for x in name); os.path.join(*a, b=2)
        a[0].run()
        return [lambda: helper(cls)]


if LIMIT:
    def hidden():
        pass
'''


def rows(path="pkg/sub/reader.py", source=SOURCE):
    return {r["uid"]: r for r in parse(path, source)}


def test_file_row_has_package_and_sorted_imports():
    f = rows()["pkg/sub/reader.py"]
    assert f["package"] == "pkg.sub.reader"
    assert f["imports"] == ["math.*", "numpy", "os", "pkg.base.Root", "pkg.base.helper", "pkg.sub.sibling"]
    assert (f["start_line"], f["end_line"], f["error"]) == (1, 27, None)


def test_members_are_direct_statements_only():
    found = rows()
    names = {u.partition("#")[2] for u in found}
    assert names == {"", "LIMIT", "Reader", "Reader.path", "Reader.a, b", "Reader.size(...)", "Reader.load(...)"}
    assert found["pkg/sub/reader.py#Reader"]["inherits"] == ["Base", "metaclass=Meta"]
    assert found["pkg/sub/reader.py#Reader"]["signature"] == "class Reader(Base, metaclass=Meta)"
    assert found["pkg/sub/reader.py#Reader.path"]["field_type"] == "str"


def test_decorators_are_outside_of_the_span():
    size = rows()["pkg/sub/reader.py#Reader.size(...)"]
    assert (size["start_line"], size["end_line"], size["arity"]) == (15, 16, 0)
    assert size["body"].startswith("def size")


def test_signature_is_cut_and_separators_count():
    load = rows()["pkg/sub/reader.py#Reader.load(...)"]
    assert load["arity"] == 4  # name, *, deep, table
    assert load["signature"] == "def load(cls, name: str, *, deep: bool = True, table: dict[str, list[tuple[int, int, int, int,...)"


def test_calls_follow_the_callee_rules_and_aliases():
    calls = rows()["pkg/sub/reader.py#Reader.load(...)"]["dependency_names"]
    assert calls == [("array", 1, "numpy", False), ("pkg.base.Root", 1, None, False), ("join", 2, "os.path", False), ("helper", 1, None, False)]


def test_last_definition_of_a_name_wins():
    found = parse("m.py", b"x = 1\nx = 2\n")
    assert [(r["uid"], r["start_line"]) for r in found] == [("m.py", 1), ("m.py#x", 2)]


def test_broken_source_gives_its_file_row():
    (row,) = parse("m.py", b"def (:\n")
    assert row["type"] == "file" and row["error"]


def test_line_bounds():
    found = {r["uid"]: (r["start_line"], r["end_line"]) for r in parse("t.py", b"import os\n\n\ndef my_func():\n    return os.getcwd()\n")}
    assert found == {"t.py": (1, 5), "t.py#my_func(...)": (4, 5)}


def test_empty_file():
    (row,) = parse("e.py", b"")
    assert row["body"] == "" and row["type"] == "file"
