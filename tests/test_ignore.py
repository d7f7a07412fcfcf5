import pytest

from sylva.sources.ignore import IgnoreRules

RULES = IgnoreRules(("*.log", "*.db", "/top_level.txt", "build/", "temp/*.tmp", "!important.log", "# note", "", "docs/**/draft?.html", "[ab].py"))


@pytest.mark.parametrize(
    ("path", "is_dir", "ignored"),
    [
        ("debug.log", False, True), ("src/app.log", False, True), ("data.db", False, True), ("important.log", False, False), ("src/important.log", False, False),
        ("top_level.txt", False, True), ("src/top_level.txt", False, False), ("build", True, True), ("build", False, False), ("build/x/y.py", False, True),
        ("not_build", False, False), ("temp/a.tmp", False, True), ("x/temp/a.tmp", False, False), ("temp/b/a.tmp", False, False), ("__pycache__", True, True),
        (".git", True, True), ("src/lib.so", False, True), ("../outside.txt", False, True), (".", True, False), ("docs/a/b/draft1.html", False, True),
        ("docs/draft1.html", False, True), ("docs/draft12.html", False, False), ("a.py", False, True), ("c.py", False, False), (".sylva/x", False, True),
    ],
)
def test_rules(path, is_dir, ignored):
    assert RULES.matches(path, is_dir) is ignored


def test_own_file_replaces_defaults(tmp_path):
    assert IgnoreRules.load(str(tmp_path)).matches("dist/a.py")
    (tmp_path / ".sylvaignore").write_text("*.txt\n")
    rules = IgnoreRules.load(str(tmp_path))
    assert not rules.matches("dist/a.py") and rules.matches("a.txt") and rules.matches("__pycache__/a.py")
