"""Readers of documents: plain text, mail, HTML, RTF, captions, office files; and folder listings.

Files are read by executors as binary rows, one format per branch of a dispatch by extension; a file that can't
be read gives a row with its error instead of failing the job.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from email import headerregistry, message_from_bytes, policy
from functools import lru_cache
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.office import read_ods, read_pdf

from lectern.sources.delimited import decode

#: Extensions the readers know.
SUPPORTED = ["txt", "md", "csv", "eml", "html", "htm", "rtf", "vtt", "srt", "docx", "odt", "odp", "pptx", "xlsx", "ods"]


def listing(spark: SparkSession, path: str, supported_only: bool = True) -> DataFrame:
    """Files under a folder: path, extension, length, modified. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    out = files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension"), "length", F.col("modificationTime").alias("modified"))
    return out.where(F.col("extension").isin(SUPPORTED)) if supported_only else out


class _Text(HTMLParser):
    BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "blockquote", "section", "article"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.silent += 1
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)


def strip_html(source: str) -> str:
    """Text of HTML: blocks on lines of their own, entities resolved, scripts and styles left out."""
    p = _Text()
    p.feed(source)
    p.close()
    lines = [re.sub(r"[ \t\f\v\xa0]+", " ", x).strip() for x in "".join(p.parts).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


_parsed = lru_cache(maxsize=4096)(headerregistry.HeaderRegistry())
#: Signs of the longest header that is kept once it is parsed.
KEPT_HEADER = 400


class _Headers(headerregistry.HeaderRegistry):
    """Parses a header once. The email package parses it at each look, some ten times a mail, and most mails share a few."""

    def __call__(self, name: str, value: str) -> headerregistry.BaseHeader:
        return _parsed(name, value) if len(value) <= KEPT_HEADER else super().__call__(name, value)


MAIL = policy.default.clone(header_factory=_Headers())


def read_mail(content: bytes) -> list[str]:
    """A mail as one page: sender, receivers, date, subject, then its plain text, else its HTML's."""
    m = message_from_bytes(content, policy=MAIL)
    head = [f"{k}: {m[k]}" for k in ("From", "To", "Cc", "Date", "Subject") if m[k]]
    body = m.get_body(preferencelist=("plain", "html"))
    text = "" if body is None else body.get_content()
    if body is not None and body.get_content_subtype() == "html":
        text = strip_html(text)
    return ["\n".join([*head, "", text.strip()]).strip()]


def read_rtf(content: bytes) -> list[str]:
    """Text of RTF: groups that hold no text are left out; hex escapes follow the code page, \\u its number."""
    s = content.decode("latin-1")
    page = re.search(r"\\ansicpg(\d+)", s)
    charset = f"cp{page[1]}" if page else "cp1252"
    hidden = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "themedata", "listtable", "listoverridetable"}
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    silent, skip_after, skip, i = False, 1, 0, 0
    token = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.S)
    while i < len(s):
        m = token.match(s, i)
        if m is None:
            break
        i = m.end()
        word, number, code, symbol, brace, char = m.groups()
        if brace == "{":
            stack.append((silent, skip_after))
        elif brace == "}":
            silent, skip_after = stack.pop() if stack else (False, 1)
        elif word:
            if word in hidden:
                silent = True
            elif word == "bin" and number:
                i += int(number)
            elif word == "uc":
                skip_after = int(number or 1)
            elif not silent and word in ("par", "line", "row"):
                out.append("\n")
            elif not silent and word in ("tab", "cell"):
                out.append("\t")
            elif not silent and word == "u" and number:
                out.append(chr(int(number) % 65536))
                skip = skip_after
        elif symbol == "*":
            silent = True
        elif not silent:
            if skip and (code or char):
                skip -= 1
            elif code:
                out.append(bytes.fromhex(code).decode(charset, "replace"))
            elif symbol in ("\\", "{", "}"):
                out.append(symbol)
            elif symbol == "~":
                out.append(" ")
            elif char:
                out.append(char)
    return [re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()]


_CUE = re.compile(r"(?:(\d+):)?(\d{1,2}):(\d{2})[.,](\d{3})\s*-->\s*[\d:.,]+[^\n]*\n(.*)", re.S)


def read_captions(content: bytes) -> list[str]:
    """Captions as lines of clock, speaker and words; a speaker's following cues run on."""
    out: list[str] = []
    last = None
    for block in re.split(r"\n[ \t]*\n", decode(content).replace("\r\n", "\n")):
        m = _CUE.search(block)
        if not m:
            continue
        hours, minutes, seconds, _, body = m.groups()
        voice = re.match(r"<v(?:\.[\w.]+)?\s+([^>]+)>", body.strip())
        words = re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", body))).strip()
        speaker = voice[1].strip() if voice else None
        if speaker and speaker == last and out:
            out[-1] += " " + words
        else:
            out.append(f"[{int(hours or 0):02d}:{int(minutes):02d}:{int(seconds):02d}] " + (f"{speaker}: " if speaker else "") + words)
        last = speaker
    return ["\n".join(out)]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _words(node: ElementTree.Element, breaks: set[str], drop: set[str], tabs: set[str]) -> str:
    out: list[str] = []

    def walk(n: ElementTree.Element) -> None:
        name = _local(n.tag)
        if name in drop:
            if n.tail:
                out.append(n.tail)
            return
        if name in tabs:
            out.append("\t")
        if name == "s":
            out.append(" ")
        if name == "line-break" or name == "br":
            out.append("\n")
        if n.text:
            out.append(n.text)
        for c in n:
            walk(c)
        if name in breaks:
            out.append("\n")
        if n.tail:
            out.append(n.tail)

    walk(node)
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def read_open_document(content: bytes, slides: bool = False) -> list[str]:
    """Text of ODT, or the slides of ODP; comments and tracked deletions are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    drop, breaks = {"annotation", "tracked-changes", "notes"}, {"p", "h", "list-item"}
    if slides:
        return [_words(n, breaks, drop, {"tab"}) for n in root.iter() if _local(n.tag) == "page"]
    body = next((n for n in root.iter() if _local(n.tag) == "text"), root)
    return [_words(body, breaks, drop, {"tab"})]


def read_docx(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return [_words(root, {"p"}, {"del", "instrText", "delText"}, {"tab"})]


def read_pptx(content: bytes) -> list[str]:
    """Slides in the order of the presentation."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("ppt/_rels/presentation.xml.rels"))}
        order = [next(v for k, v in n.attrib.items() if _local(k) == "id" and k.startswith("{")) for n in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter() if _local(n.tag) == "sldId"]
        return [_words(ElementTree.fromstring(z.read("ppt/" + links[i].removeprefix("/ppt/"))), {"p"}, set(), {"tab"}) for i in order]


def read_xlsx(content: bytes) -> list[tuple[str, list[list[tuple[str, str | None, str | None]]]]]:
    """Sheets with rows of cells (kind, text, formula); kinds are text, number, date, formula and empty.
    Dates are numbers under a date format; a formula keeps its stored value apart."""
    from datetime import date, timedelta

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        dated: list[bool] = []
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            custom = {int(n.get("numFmtId", 0)): n.get("formatCode", "") for n in styles.iter() if _local(n.tag) == "numFmt"}
            xfs = next((n for n in styles if _local(n.tag) == "cellXfs"), [])
            for xf in xfs:
                k = int(xf.get("numFmtId", 0))
                dated.append(14 <= k <= 22 or bool(re.search(r"[dmy]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get(k, "")).lower())))
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for s in (n for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(n.tag) == "sheet"):
            target = links[next(v for k, v in s.attrib.items() if _local(k) == "id" and k.startswith("{"))]
            root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else "xl/" + target))
            rows: list[list[tuple[str, str | None, str | None]]] = []
            for r in (n for n in root.iter() if _local(n.tag) == "row"):
                at = int(r.get("r", len(rows) + 1))
                rows.extend([] for _ in range(at - 1 - len(rows)))
                cells: list[tuple[str, str | None, str | None]] = []
                for c in r:
                    letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]  # type: ignore[index]
                    column = 0
                    for x in letters:
                        column = column * 26 + ord(x) - 64
                    cells.extend(("empty", None, None) for _ in range(column - 1 - len(cells)))
                    value = next((n.text for n in c if _local(n.tag) == "v"), None)
                    inline = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                    formula = next((n.text or "" for n in c if _local(n.tag) == "f"), None)
                    kind, text = "number", value
                    if c.get("t") == "s" and value is not None:
                        kind, text = "text", shared[int(value)]
                    elif c.get("t") in ("str", "inlineStr", "b", "e"):
                        kind, text = "text", value if value is not None else inline
                    elif value is None:
                        kind = "empty"
                    elif int(c.get("s", 0)) < len(dated) and dated[int(c.get("s", 0))]:
                        kind, text = "date", (date(1899, 12, 30) + timedelta(days=int(float(value)))).isoformat()
                    cells.append(("formula" if formula is not None else kind, text, formula))
                rows.append(cells)
            out.append((s.get("name", ""), rows))
        return out


def _sheet_pages(content: bytes) -> list[str]:
    return ["\n".join("\t".join(t or "" for _, t, _ in row) for row in rows) for _, rows in read_xlsx(content)]


def verified(files: DataFrame) -> DataFrame:
    """Files (sha256, content, ...) with whether the content still has that hash; a changed one is not to be used."""
    return files.withColumn("current", F.sha2("content", 256).eqNullSafe(F.col("sha256")))


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ids, once each however often it is asked for."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


READERS: dict[str, Callable[[bytes], list[str]]] = {
    "txt": lambda b: [decode(b)],
    "md": lambda b: [decode(b)],
    "csv": lambda b: [decode(b)],
    "eml": read_mail,
    "html": lambda b: [strip_html(decode(b))],
    "htm": lambda b: [strip_html(decode(b))],
    "rtf": read_rtf,
    "vtt": read_captions,
    "srt": read_captions,
    "docx": read_docx,
    "odt": read_open_document,
    "odp": lambda b: read_open_document(b, slides=True),
    "pptx": read_pptx,
    "xlsx": _sheet_pages,
    "ods": lambda b: ["\n".join("\t".join(t or "" for _, t, _ in row) for row in rows) for _, rows in read_ods(b)],
    "pdf": read_pdf,
}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Pages of every supported file under a folder: path, sha256, page (from 1), text, error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).where(F.col("extension").isin(list(READERS)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, extension, digest, content in frame.itertuples(index=False, name=None):
                try:
                    rows.extend((name, digest, i, t, None) for i, t in enumerate(READERS[extension](bytes(content)), 1))
                except Exception as e:  # a broken file is a row, not a failed job
                    rows.append((name, digest, None, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["path", "sha256", "page", "text", "error"]).astype({"page": "Int32"})

    return known.select("path", "extension", F.sha2("content", 256).alias("sha256"), "content").mapInPandas(run, "path string, sha256 string, page int, text string, error string")
