"""Python source to struct rows, by the standard library's syntax tree.

Only direct statements of a module or class become structs: definitions (decorators left out of their span) and
assignments. A source that does not parse gives its file row alone, with ``error`` set.
"""

from __future__ import annotations

import ast
import bisect
import io
import re
import tokenize

from .rows import bounds, file_row, member

SHOWN = 50


class _Text:
    """Byte offsets of a source by the tree's lines and columns."""

    def __init__(self, body: bytes):
        self.body = body
        self.starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", body))]

    def at(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column

    def span(self, node: ast.AST) -> tuple[int, int]:
        return self.at(node.lineno, node.col_offset), self.at(node.end_lineno, node.end_col_offset)

    def of(self, node: ast.AST) -> str:
        start, end = self.span(node)
        return self.body[start:end].decode()

    def line(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)


def module_name(path: str) -> str:
    return ".".join(re.sub(r"\.[^./]*$", "", path).split("/"))


def _from_module(node: ast.ImportFrom, package: str) -> str:
    """The module an import takes from, relative ones counted back from the file's own name."""
    if not node.level:
        return node.module or ""
    parts = package.split(".")
    base = parts[: -node.level] if node.level <= len(parts) else []
    return ".".join(base + ([node.module] if node.module else []))


def imports_of(tree: ast.Module, package: str) -> tuple[list[str], dict[str, str]]:
    """Imported names of the module's own statements, sorted, and what each alias stands for."""
    names, alias = set(), {}
    for node in tree.body:
        if isinstance(node, ast.Import):
            for a in node.names:
                names.add(a.name)
                if a.asname:
                    alias[a.asname] = a.name
        elif isinstance(node, ast.ImportFrom) and node.module != "__future__":
            module = _from_module(node, package)
            for a in node.names if module else ():
                names.add(f"{module}.{a.name}")
                if a.asname:
                    alias[a.asname] = f"{module}.{a.name}"
    return sorted(names), alias


def _parenthesised(text: str) -> list[str]:
    """The parts between top-level commas of a definition's first parentheses, comments left out."""
    parts, depth, begun = [], 0, False
    lines = text.splitlines(keepends=True)
    tokens = tokenize.generate_tokens(iter([*lines, ""]).__next__)
    first, last = None, None

    def cut(to):
        if first is not None:
            (a, b), (c, d) = first, to
            piece = lines[a - 1][b:d] if a == c else "".join([lines[a - 1][b:], *lines[a : c - 1], lines[c - 1][:d]])
            parts.append(_without_comments(piece) if "#" in piece else piece)

    try:
        for t in tokens:
            if t.type in (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT):
                continue
            if t.type == tokenize.OP and t.string in "([{":
                depth += 1
                if depth == 1 and not begun and t.string == "(":
                    begun = True
                    continue
                if depth == 1 and not begun:  # type parameters
                    continue
            elif t.type == tokenize.OP and t.string in ")]}":
                depth -= 1
                if depth == 0 and begun:
                    if first is not None:
                        cut(last)
                    return parts
                if not begun:
                    continue
            elif t.type == tokenize.OP and t.string == ":" and depth == 0:
                return parts
            elif t.type == tokenize.OP and t.string == "," and depth == 1 and begun:
                cut(last)
                first = None
                continue
            if begun:
                first = first or t.start
                last = t.end
    except (tokenize.TokenError, IndentationError):
        pass
    return parts


def _without_comments(piece: str) -> str:
    kept = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(f"({piece}\n)").readline):
            if t.type == tokenize.COMMENT:
                kept.append((t.start, t.end))
    except (tokenize.TokenError, IndentationError):
        return piece
    lines = f"({piece}\n)".splitlines(keepends=True)
    for (a, b), (_, d) in reversed(kept):
        lines[a - 1] = lines[a - 1][:b] + lines[a - 1][d:]
    return "".join(lines)[1:].rstrip(")").rstrip("\n")


def calls_of(node: ast.AST, text: _Text, alias: dict[str, str]) -> list[tuple]:
    """Call sites below a definition as ``(name, arity, receiver, False)``, in source order.

    The callee is a name, or an attribute of a name, attribute or call; a lone generator in place of an argument list
    does not count as one.
    """
    own = node.decorator_list if hasattr(node, "decorator_list") else []
    skipped = {id(x) for d in own for x in ast.walk(d)}
    found = []
    for call in ast.walk(node):
        if not isinstance(call, ast.Call) or id(call) in skipped:
            continue
        if len(call.args) == 1 and not call.keywords and isinstance(call.args[0], ast.GeneratorExp) and text.span(call.args[0])[1] == text.span(call)[1]:
            continue
        f, receiver = call.func, None
        start, end = text.span(f)
        if text.body[end : text.span(call)[1]].lstrip()[:1] != b"(":
            continue  # the callee stands in parentheses
        if isinstance(f, ast.Name):
            name = f.id
        elif isinstance(f, ast.Attribute) and isinstance(f.value, (ast.Name, ast.Attribute, ast.Call)):
            if text.body[text.span(f.value)[1] : end].lstrip()[:1] == b")":
                continue
            name, receiver = f.attr, text.of(f.value).strip()
        else:
            continue
        found.append((start, -end, (alias.get(name, name), len(call.args) + len(call.keywords), alias.get(receiver, receiver) if receiver else receiver, False)))
    return [x for *_, x in sorted(found, key=lambda x: x[:2])]


def parse(path: str, body: bytes) -> list[dict]:
    """The rows of one file, its own first; of rows with one uid the last definition stays."""
    source = body.decode("utf-8")
    package = module_name(path)
    try:
        tree = ast.parse(body)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [file_row(path, source, body, package=package, error=str(e))]
    text = _Text(body)
    imports, alias = imports_of(tree, package)
    rows = [file_row(path, source, body, package=package, imports=imports)]
    stack = [(tree.body, path, "#")]
    while stack:
        statements, parent, joint = stack.pop()
        for node in statements:
            if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef, ast.Assign, ast.AnnAssign)):
                start, end = text.span(node)
                own = text.body[start:end].decode()
            if isinstance(node, ast.ClassDef):
                inherits = [p.strip() for p in _parenthesised(own)] if node.bases or node.keywords else []
                signature = f"class {node.name}" + (f"({', '.join(inherits)})" if inherits else "")
                rows.append(member("class", parent + joint + node.name, node.name, path, parent, own, bounds(text, start, end), start, signature=signature, inherits=inherits))
                stack.append((node.body, parent + joint + node.name, "."))
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                shown = [re.sub(r"\s+", " ", p.strip()) for p in _parenthesised(own)]
                bare = [p.split("=")[0].split(":")[0].strip() for p in shown]
                arity = len(bare) - (bare[:1] in (["self"], ["cls"]))
                listed = ", ".join(p if len(p) <= SHOWN else p[: SHOWN - 3] + "..." for p in shown)
                row = member("method", f"{parent}{joint}{node.name}(...)", node.name, path, parent, own, bounds(text, start, end), start, signature=f"def {node.name}({listed})")
                rows.append(row | {"arity": arity, "dependency_names": calls_of(node, text, alias)})
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                target = node.targets[0] if isinstance(node, ast.Assign) else node.target
                name = text.of(target).strip()
                kind = text.of(node.annotation).strip() if isinstance(node, ast.AnnAssign) else ""
                rows.append(member("field", parent + joint + name, name, path, parent, own, bounds(text, start, end), start, signature=f"{name}: {kind}" if kind else name) | {"field_type": kind})
    last = {r["uid"]: r for r in sorted(rows[1:], key=lambda r: r["_start"])}
    return [rows[0], *last.values()]
