"""Rows that all parsers give (see ``schema.PARSED``)."""

from __future__ import annotations

import hashlib

from ..schema import PARSED

EMPTY = dict.fromkeys([f.name for f in PARSED])


def bounds(text, start: int, end: int) -> tuple[int, int]:
    """First and last line of a span, from 1; a span that ends with a newline ends on the line before."""
    first = text.line(start)
    last = text.line(end)
    return first, last - 1 if end in text.starts and last > first else last


def file_bounds(body: bytes) -> tuple[int, int]:
    """Lines of a file from its first character that is no white space."""
    blank = len(body) - len(body.lstrip())
    if blank == len(body):
        return 1, max(1, body.count(b"\n"))
    return body.count(b"\n", 0, blank) + 1, body.count(b"\n") + (not body.endswith(b"\n"))


def file_row(path: str, source: str, body: bytes, package: str = "", imports=(), error: str | None = None) -> dict:
    first, last = file_bounds(body)
    parent = path.rpartition("/")[0] or "."
    return EMPTY | {
        "uid": path, "name": path.rpartition("/")[2], "type": "file", "path": path, "parent_uid": parent, "body": source, "diff_hash": hashlib.md5(body).hexdigest(),
        "start_line": first, "end_line": last, "imports": list(imports), "package": package, "error": error,
    }


def member(kind: str, uid: str, name: str, path: str, parent: str, body: str, lines: tuple[int, int], start: int, signature: str = "", inherits=None) -> dict:
    return EMPTY | {
        "uid": uid, "name": name, "type": kind, "path": path, "parent_uid": parent, "signature": signature, "body": body, "diff_hash": hashlib.md5(body.encode()).hexdigest(),
        "start_line": lines[0], "end_line": lines[1], "inherits": inherits, "_start": start,
    }


def directory_row(path: str, name: str) -> dict:
    return EMPTY | {"uid": path, "name": name, "type": "directory", "path": path, "parent_uid": None if path == "." else path.rpartition("/")[0] or ".", "diff_hash": ""}
