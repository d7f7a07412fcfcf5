"""Ignore rules in the gitignore language: compiled to regular expressions, last match wins."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules that hold in every project.
HARD = (
    ".DS_Store", "*.exe", "*.bin", "*.dll", "*.so", "*.dylib", "*.pyc", "*.pyo", "*.pyd", "__pycache__/", ".git/", ".svn/", ".hg/",
    ".sylva/", ".sylvaignore", "*.json", "*.md", "*.kts", "*.properties", "*.xml", "*.gradle",
)
# Rules for projects that bring none of their own, by language; those that can hit a source file or a
# directory.
DEFAULTS = {
    "python": (
        "__pycache__/", ".Python", "build/", "develop-eggs/", "dist/", "downloads/", "eggs/", ".eggs/", "lib/", "lib64/", "parts/", "sdist/", "var/", "wheels/", "share/python-wheels/", "*.egg-info/", "*.egg", "MANIFEST",
        "htmlcov/", ".tox/", ".nox/", ".coverage", ".cache", ".hypothesis/", ".pytest_cache/", "cover/", "local_settings.py", "instance/", ".webassets-cache", ".scrapy", "docs/_build/", ".pybuilder/", "target/",
        ".ipynb_checkpoints", "profile_default/", "ipython_config.py", "__pypackages__/", "*.sage.py", ".env", ".venv", "env/", "venv/", "ENV/", "env.bak/", "venv.bak/", ".spyderproject", ".spyproject", ".ropeproject", "/site",
        ".mypy_cache/", ".pyre/", ".pytype/", "cython_debug/", "*test*",
    ),
    "java": (".github/", "*.log", ".mtj.tmp/", "hs_err_pid*", "replay_pid*", "target/", ".gradle/", "build/", "!src/**/build/", ".idea/", "out/", ".settings/", ".classpath", ".project", ".factorypath", ".vscode/", "*test*"),
    "html": (),
}


def default_rules(language: str | None = None) -> list[str]:
    """The default rules of a language; of all of them for none or "auto"."""
    return [line for name in ([language] if language in DEFAULTS else DEFAULTS) for line in DEFAULTS[name]]


def compile_rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """``(pattern, negated, directories only)`` of one line; None for blank lines and comments."""
    line = line.rstrip("\n")
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line.startswith(("\\#", "\\!")) else line
    only_dirs = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    line = line.lstrip("/")
    out, k = "" if anchored else "(?:.*/)?", 0
    while k < len(line):
        c = line[k]
        if line.startswith("**/", k) and (k == 0 or line[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
        elif line.startswith("/**", k) and k + 3 == len(line):
            out, k = out + "/.+", k + 3
        elif c == "*":
            while k + 1 < len(line) and line[k + 1] == "*":
                k += 1
            out, k = out + "[^/]*", k + 1
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and (end := line.find("]", k + 2)) > 0:
            inner = line[k + 1 : end]
            inner = "^" + inner[1:] if inner[0] in "!^" else inner
            out, k = f"{out}[{inner.replace(chr(92), chr(92) * 2)}]", end + 1
        elif c == "\\" and k + 1 < len(line):
            out, k = out + re.escape(line[k + 1]), k + 2
        else:
            out, k = out + re.escape(c), k + 1
    return re.compile(out + r"\Z", re.S), negated, only_dirs


@dataclass
class IgnoreRules:
    """Hard rules, then a project's own or its language's default ones. Paths outside the root are ignored, the root never
    is."""

    lines: tuple[str, ...] | None = None
    hard: tuple[str, ...] = HARD
    language: str | None = None
    rules: list = field(init=False, repr=False)

    def __post_init__(self):
        lines = default_rules(self.language) if self.lines is None else self.lines
        self.rules = [r for line in (*self.hard, *lines) if (r := compile_rule(line))]

    @classmethod
    def load(cls, root: str, language: str | None = None, name: str = ".sylvaignore") -> IgnoreRules:
        path = os.path.join(root, name)
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                return cls(tuple(f.read().splitlines()))
        return cls(language=language)

    def matches(self, path: str, is_dir: bool = False) -> bool:
        """Whether a path relative to the root is ignored, by itself or through a directory above it."""
        path = os.path.normpath(path).replace(os.sep, "/")
        if path == ".":
            return False
        if path.startswith("../") or path == ".." or path.startswith("/"):
            return True
        parts = path.split("/")
        return any(self._match("/".join(parts[:k]), k < len(parts) or is_dir) for k in range(1, len(parts) + 1))

    def _match(self, path: str, is_dir: bool) -> bool:
        ignored = False
        for pattern, negated, only_dirs in self.rules:
            if (is_dir or not only_dirs) and pattern.match(path):
                ignored = not negated
        return ignored


def ignored(path: str, lines) -> Column:
    """The rules as a column expression over relative paths: every compiled pattern is a regular expression, the last
    that matches decides, and a path below an ignored directory stays ignored."""
    rules = [r for line in lines if (r := compile_rule(line))]
    whole = lambda p: "^(?:" + p.pattern.replace("\\Z", "") + ")$"

    def verdict(part, is_dir):
        out = F.lit(False)
        for pattern, negated, only_dirs in rules:
            out = F.when(part.rlike(whole(pattern)) & (is_dir | F.lit(not only_dirs)), F.lit(not negated)).otherwise(out)
        return out

    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("p"), (k < F.size(parts)).alias("d")))
    return F.exists(above, lambda x: verdict(x["p"], x["d"]))
