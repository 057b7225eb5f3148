"""Parsing of wikitext member tables (pure Python, used inside Arrow batches).

A page may hold several tables; the member table is the one whose header row
names a central index key and a ticker.  ``parse_member_table`` returns the
headers and the rows as *visible text*: references, comments, link and bold
markup, cell attributes and templates around a value are removed, outer blanks
trimmed.  Rows shorter than the header are padded with empty cells, longer ones
cut to the header's width.  Texts that are null, empty or without a member
table give ``None``.
"""

from __future__ import annotations

import html
import re

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_REF_CLOSED = re.compile(r"<ref\b[^<>]*/\s*>", re.I)
_REF = re.compile(r"<ref\b[^<>]*>.*?(?:</ref\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_FILE_LINK = re.compile(r"\[\[(?:File|Image):[^\[\]]*\]\]", re.I)
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_EXT_LINK = re.compile(r"\[(?:https?:)?//[^\s\]]+\s*([^\]]*)\]")
_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
_QUOTES = re.compile(r"'{2,}")
_ATTRS = re.compile(r"""^\s*(?:[A-Za-z][\w-]*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s|"']+)\s*)+\|(?!\|)""")
_DIGITS = re.compile(r"[0-9]+\Z")

#: Headers (visible, lower case) that name the member's key and its ticker; fixed values.
KEY_HEADERS = ("central index key", "cik")
TICKER_HEADERS = ("ticker", "ticker symbol", "symbol")


def strip_noise(text: str) -> str:
    """Removes comments and references, which may run over lines and hold pipes."""
    text = _COMMENT.sub("", text)
    text = _REF_CLOSED.sub("", text)
    return _REF.sub("", text)


def _template_value(match: re.Match) -> str:
    parts = match.group(1).split("|")
    named = [p for p in parts[1:] if "=" not in p]
    return named[-1] if named else ""


def visible(cell: str) -> str:
    """Visible text of one cell, markup removed and outer blanks trimmed."""
    if not cell.isalnum():
        cell = _ATTRS.sub("", cell, count=1)
        if "{{" in cell:
            before = None
            while before != cell:
                before, cell = cell, _TEMPLATE.sub(_template_value, cell)
        if "[" in cell:
            cell = _EXT_LINK.sub(r"\1", _LINK.sub(r"\1", _FILE_LINK.sub("", cell)))
        if "''" in cell:
            cell = _QUOTES.sub("", cell)
        if "<" in cell:
            cell = _TAG.sub("", cell)
        if "&" in cell:
            cell = html.unescape(cell)
    return " ".join(cell.split())


def header_name(cell: str) -> str:
    """Header in the form in which schemas are compared: lower case, no closing colon."""
    return visible(cell).lower().rstrip(": ").strip()


def _tables(text: str):
    """Yields the lines of every table, outermost first, nested ones folded into their own."""
    stack: list[list[str]] = []
    for line in text.split("\n"):
        bare = line.strip()
        if bare.startswith("{|"):
            stack.append([])
        elif bare.startswith("|}") and not bare.startswith("|}}"):
            if stack:
                yield stack.pop()
        elif stack:
            stack[-1].append(bare)
    while stack:  # a table that is never closed
        yield stack.pop()


def _split_row(line: str, mark: str) -> list[str]:
    """Cells of one line; pipes inside links and templates do not split."""
    body = line[1:]
    if mark == "!":
        body = body.replace("!!", "||")
    if "||" not in body:
        return [body]
    if "{{" not in body:
        return body.split("||")
    cells, depth, start, i = [], 0, 0, 0
    while i < len(body):
        two = body[i : i + 2]
        if two in ("{{", "[["):
            depth, i = depth + 1, i + 2
        elif two in ("}}", "]]"):
            depth, i = max(0, depth - 1), i + 2
        elif two == "||" and depth == 0:
            cells.append(body[start:i])
            start, i = i + 2, i + 2
        else:
            i += 1
    cells.append(body[start:])
    return cells


def _grid(lines: list[str]) -> tuple[list[str], list[list[str]]]:
    headers: list[str] = []
    rows: list[list[str]] = []
    current: list[str] = []
    is_header = False

    def close() -> None:
        nonlocal current
        if current:
            if is_header and not headers:
                headers.extend(current)
            elif not is_header:
                rows.append(current)
        current = []

    for line in lines:
        if line.startswith("|-"):
            close()
            is_header = False
        elif line.startswith("|+"):
            continue
        elif line.startswith("!"):
            if not current:
                is_header = not headers
            current.extend(_split_row(line, "!"))
        elif line.startswith("|"):
            if is_header:
                close()
                is_header = False
            current.extend(_split_row(line, "|"))
        elif current and line:
            current[-1] += " " + line
    close()
    return headers, rows


def parse_member_table(text: str | None) -> tuple[list[str], list[list[str]]] | None:
    """(headers, rows) of the page's member table, or None."""
    if not text or "{|" not in text:
        return None
    for lines in _tables(strip_noise(text)):
        raw_headers, raw_rows = _grid(lines)
        headers = [header_name(h) for h in raw_headers]
        if not any(h in KEY_HEADERS for h in headers) or not any(h in TICKER_HEADERS for h in headers):
            continue
        width = len(headers)
        rows = [[visible(c) for c in r[:width]] + [""] * (width - len(r)) for r in raw_rows]
        return headers, rows
    return None


def key_of(cell: str) -> str | None:
    """A CIK as ten digits with leading zeros; None if the cell holds none."""
    cell = cell.strip()
    if not _DIGITS.match(cell):
        return None
    return cell.lstrip("0").zfill(10)
