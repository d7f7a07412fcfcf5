"""HTML source: one file row, the text decoded leniently, no members."""

from __future__ import annotations

from .rows import file_row


def parse(path: str, body: bytes) -> list[dict]:
    return [file_row(path, body.decode("utf-8", errors="replace"), body)]
