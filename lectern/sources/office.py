"""Portable documents and open spreadsheets: text of PDF pages, cells of ODS sheets, metadata of office files."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.DOTALL)
_OPERATOR = re.compile(rb"\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d+(?:\.\d+)?|[A-Za-z'\"*]+", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(token: bytes) -> str:
    """Text of a string in a content stream, in the standard single-byte encoding."""
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")

    def plain(m: re.Match) -> bytes:
        c = m.group(1)
        return bytes([int(c, 8) & 255]) if c.isdigit() else _ESCAPES.get(c, c)

    return re.sub(rb"\\([0-7]{1,3}|.)", plain, token[1:-1], flags=re.DOTALL).decode("cp1252", "replace")


def _shown(content: bytes) -> str:
    """Text shown by a content stream; a move to another line, or the end of a text object, ends a line."""
    out: list[str] = []
    held: list[bytes] = []
    for m in _OPERATOR.finditer(content):
        token = m.group()
        if not re.match(rb"[A-Za-z'\"*]", token):
            held.append(token)
            continue
        if token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                out.append("\n")
            out.extend(_literal(t) for t in held if t[:1] in (b"(", b"<"))
        elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
            out.append("\n")
        held = []
    return re.sub(r"\n+", "\n", "".join(out)).strip()


def read_pdf(content: bytes) -> list[str]:
    """Text of each page of a PDF with plain or deflated streams and single-byte fonts; a page without text is empty.
    An encrypted file is refused."""
    if not content.startswith(b"%PDF"):
        raise ValueError("no PDF")
    if re.search(rb"/Encrypt\b", content):
        raise ValueError("encrypted PDF")
    objects = {int(m.group(1)): m.group(3) for m in _OBJECT.finditer(content)}

    def stream(number: int) -> bytes:
        m = _STREAM.search(objects.get(number, b""))
        if not m:
            return b""
        return zlib.decompress(m.group(2)) if b"/FlateDecode" in m.group(1) else m.group(2)

    kinds = {n: body for n, body in objects.items() if re.search(rb"/Type\s*/Page(?![A-Za-z])", body)}
    order: list[int] = []

    def walk(number: int, seen: frozenset[int]) -> None:
        if number in seen or number not in objects:
            return
        kids = re.search(rb"/Kids\s*\[(.*?)\]", objects[number], re.DOTALL)
        if number in kinds:
            order.append(number)
        elif kids:
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids.group(1)):
                walk(int(k), seen | {number})

    root = next((n for n, body in objects.items() if re.search(rb"/Type\s*/Catalog\b", body)), None)
    tree = re.search(rb"/Pages\s+(\d+)", objects[root]) if root is not None else None
    if tree:
        walk(int(tree.group(1)), frozenset())
    pages = []
    for n in order or sorted(kinds):
        found = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+)\s+\d+\s+R)", kinds[n], re.DOTALL)
        numbers = [] if not found else ([int(found.group(2))] if found.group(2) else [int(k) for k in re.findall(rb"(\d+)\s+\d+\s+R", found.group(1))])
        pages.append(_shown(b"\n".join(map(stream, numbers))))
    return pages


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _of(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def read_ods(content: bytes) -> list[tuple[str, list[list[tuple[str, str | None, str | None]]]]]:
    """Sheets of an ODS file with rows of cells (kind, text, formula), kinds as those of workbooks. Repeated cells and rows
    are spelt out, but for empty ones at the end of a row or sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    out = []
    for sheet in (n for n in root.iter() if _local(n.tag) == "table"):
        rows: list[list[tuple[str, str | None, str | None]]] = []
        for row in (n for n in sheet.iter() if _local(n.tag) == "table-row"):
            cells: list[tuple[str, str | None, str | None]] = []
            for c in (n for n in row if _local(n.tag) in ("table-cell", "covered-table-cell")):
                kind, formula = _of(c, "value-type"), _of(c, "formula")
                text = "\n".join("".join(p.itertext()) for p in c if _local(p.tag) == "p")
                value = _of(c, "date-value") if kind == "date" else _of(c, "value") if kind in ("float", "currency", "percentage") else text
                name = "empty" if kind is None and not text else {"float": "number", "currency": "number", "percentage": "number", "date": "date"}.get(kind or "", "text")
                cell = ("formula" if formula else name, value or None, formula)
                cells.extend([cell] * (int(_of(c, "number-columns-repeated") or 1) if cell[0] != "empty" or c is not row[-1] else 1))
            while cells and cells[-1][0] == "empty":
                cells.pop()
            rows.extend([cells] * (int(_of(row, "number-rows-repeated") or 1) if cells else 1))
        while rows and not rows[-1]:
            rows.pop()
        out.append((_of(sheet, "name") or "", rows))
    return out


# Parts of office files that hold metadata, and the fields taken from them.
CORE = {"title": "title", "creator": "author", "subject": "subject", "lastModifiedBy": "last_modified_by", "created": "created", "modified": "modified", "creation-date": "created", "date": "modified", "initial-creator": "author", "keywords": "keywords", "keyword": "keywords"}


def read_metadata(extension: str, content: bytes) -> dict[str, str]:
    """Title, author, subject and dates a file states: core properties of office files, the information of a PDF, the front
    matter of Markdown. What isn't stated is left out."""
    out: dict[str, str] = {}
    if extension in ("docx", "xlsx", "pptx", "odt", "ods", "odp"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            part = next((p for p in ("docProps/core.xml", "meta.xml") if p in z.namelist()), None)
            for n in ElementTree.fromstring(z.read(part)).iter() if part else ():
                if _local(n.tag) in CORE and n.text and n.text.strip():
                    out.setdefault(CORE[_local(n.tag)], n.text.strip())
    elif extension == "pdf":
        for name, field in ((b"Title", "title"), (b"Author", "author"), (b"Subject", "subject"), (b"CreationDate", "created"), (b"ModDate", "modified")):
            m = re.search(rb"/" + name + rb"\s*(\((?:\\.|[^()\\])*\)|<[0-9A-Fa-f\s]+>)", content, re.DOTALL)
            if m:
                text = _literal(m.group(1))
                day = re.match(r"D:(\d{4})(\d{2})(\d{2})", text)
                out[field] = "-".join(day.groups()) if day else text
    elif extension == "md":
        m = re.match(r"---\r?\n(.*?)\r?\n---", content.decode("utf-8-sig", "replace"), re.DOTALL)
        for line in m.group(1).splitlines() if m else ():
            key, colon, value = line.partition(":")
            if colon and value.strip():
                out[key.strip().lower()] = value.strip().strip("\"'")
    return out
