"""Queries of the readers: rows of tables written as files of each format and read again, with the SQL of what must come out.

Files are made within the query, as there are none beside the tables; each holds what one row says.
"""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.plans.catalog import query
from lectern.session import shared_dir, spread, table
from lectern.sources import delimited, documents, office, ports


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


_OFFICE = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0"'
_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def make_docx(a: str, b: str) -> bytes:
    core = f'<c xmlns:dc="x"><dc:title>{escape(a)}</dc:title><dc:creator>{escape(b)}</dc:creator></c>'
    return _zip({"word/document.xml": f"<w:document {_W}><w:body><w:p><w:r><w:t>{escape(a)}</w:t></w:r></w:p><w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:t>{escape(b)}</w:t></w:r></w:p></w:body></w:document>", "docProps/core.xml": core})


def make_odt(a: str, b: str) -> bytes:
    return _zip({"content.xml": f"<office:document-content {_OFFICE}><office:body><office:text><text:tracked-changes><text:p>gone</text:p></text:tracked-changes><text:p>{escape(a)}</text:p><text:p>{escape(b)}</text:p></office:text></office:body></office:document-content>"})


def make_odp(a: str, b: str) -> bytes:
    return _zip({"content.xml": f"<office:document-content {_OFFICE}><office:body><office:presentation>" + "".join(f"<draw:page><text:p>{escape(t)}</text:p></draw:page>" for t in (a, b)) + "</office:presentation></office:body></office:document-content>"})


def make_pptx(a: str, b: str) -> bytes:
    slide = "<p:sld {} xmlns:p='x'><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:sld>"
    return _zip({
        "ppt/presentation.xml": f"<p:presentation xmlns:p='x' {_R}><p:sldIdLst><p:sldId id='1' r:id='r2'/><p:sldId id='2' r:id='r1'/></p:sldIdLst></p:presentation>",
        "ppt/_rels/presentation.xml.rels": _REL.format("<Relationship Id='r1' Target='slides/slide1.xml'/><Relationship Id='r2' Target='slides/slide2.xml'/>"),
        "ppt/slides/slide1.xml": slide.format(_A, escape(b)), "ppt/slides/slide2.xml": slide.format(_A, escape(a)),
    })


def make_xlsx(a: str, b: str) -> bytes:
    return _zip({
        "xl/workbook.xml": f"<workbook {_S} {_R}><sheets><sheet name='F' sheetId='1' r:id='r1'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": _REL.format("<Relationship Id='r1' Target='worksheets/sheet1.xml'/>"),
        "xl/worksheets/sheet1.xml": f"<worksheet {_S}><sheetData><row r='1'><c r='A1' t='inlineStr'><is><t>{escape(a)}</t></is></c><c r='C1'><f>1+1</f><v>2</v></c></row><row r='3'><c r='B3' t='inlineStr'><is><t>{escape(b)}</t></is></c></row></sheetData></worksheet>",
    })


def make_ods(a: str, b: str) -> bytes:
    cell = lambda t: f"<table:table-cell office:value-type='string'><text:p>{escape(t)}</text:p></table:table-cell>"
    return _zip({"content.xml": f"<office:document-content {_OFFICE}><office:body><office:spreadsheet><table:table table:name='F'><table:table-row>{cell(a)}<table:table-cell/><table:table-cell office:value-type='float' office:value='2'><text:p>2</text:p></table:table-cell></table:table-row><table:table-row><table:table-cell table:number-columns-repeated='2'/>{cell(b)}</table:table-row></table:table></office:spreadsheet></office:body></office:document-content>"})


def make_pdf(a: str, b: str) -> bytes:
    """Two pages, the second one's stream deflated."""
    shown = lambda t: b"BT /F1 12 Tf 72 720 Td (" + t.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj ET"
    one, two = shown(a), zlib.compress(shown(b))
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >>", b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(one), one), b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(two), two),
    ]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


def make_mail(a: str, b: str) -> bytes:
    from email.message import EmailMessage

    m = EmailMessage(documents.MAIL)
    m["Subject"], m["From"] = a, "x@poste.example"
    m.set_content(b)
    return m.as_bytes()


def make_rtf(a: str, b: str) -> bytes:
    coded = lambda t: "".join(f"\\u{ord(c)}?" if ord(c) > 126 else "\\" + c if c in "\\{}" else c for c in t)
    return ("{\\rtf1\\ansi{\\fonttbl{\\f0 Arial;}}" + coded(a) + "\\par " + coded(b) + "}").encode()


def _again(make: Callable[[str, str], bytes], read: Callable[[bytes], list[str]], a: str, b: str) -> Column:
    """What a reader finds, page after page, in a file made of two texts."""

    @F.pandas_udf("array<string>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([read(make(p, q)) for p, q in zip(x, y, strict=True)])

    return run(F.col(a), F.col(b))


def _pages(spark: SparkSession, d: str, make: Callable[[str, str], bytes], read: Callable[[bytes], list[str]]) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_type")
    return p.select("p_partkey", F.posexplode(_again(make, read, "p_name", "p_type")).alias("page", "text"))


_TWO_LINES = "SELECT p_partkey, 0 AS page, p_name || chr(10) || p_type AS text FROM part"
_TWO_PAGES = "SELECT p_partkey, 0 AS page, p_name AS text FROM part UNION ALL SELECT p_partkey, 1, p_type FROM part"
_MADE = {"docx": (make_docx, documents.read_docx, _TWO_LINES), "odt": (make_odt, documents.read_open_document, _TWO_LINES), "odp": (make_odp, lambda b: documents.read_open_document(b, slides=True), _TWO_PAGES), "pptx": (make_pptx, documents.read_pptx, _TWO_PAGES), "pdf": (make_pdf, office.read_pdf, _TWO_PAGES), "rtf": (make_rtf, documents.read_rtf, _TWO_LINES)}


def _register(kind: str) -> None:
    make, read, sql = _MADE[kind]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _pages(spark, d, make, read)

    run.__name__, run.__doc__ = f"in_{kind}", f"Pages of {kind} files, one for each part."
    query(sql)(run)


for _kind in _MADE:
    _register(_kind)


_CELLS = "SELECT p_partkey, 0 AS row, 0 AS col, 'text' AS kind, p_name AS text FROM part UNION ALL SELECT p_partkey, 0, 2, '{}', '2' FROM part UNION ALL SELECT p_partkey, {}, {}, 'text', p_type FROM part"


def _cells(spark: SparkSession, d: str, make: Callable[[str, str], bytes], read: Callable[[bytes], list]) -> DataFrame:
    @F.pandas_udf("array<struct<row int, col int, kind string, text string>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[{"row": r, "col": c, "kind": cell[0], "text": cell[1]} for _, rows in read(make(p, q)) for r, cells in enumerate(rows) for c, cell in enumerate(cells) if cell[0] != "empty"] for p, q in zip(x, y, strict=True)])

    return table(spark, d, "part").select("p_partkey", F.inline(run("p_name", "p_type")))


@query(_CELLS.format("formula", 2, 1))
def in_xlsx(spark: SparkSession, d: str) -> DataFrame:
    """Cells of workbooks, one for each part; a formula's value is told from others."""
    return _cells(spark, d, make_xlsx, documents.read_xlsx)


@query(_CELLS.format("number", 1, 2))
def in_ods(spark: SparkSession, d: str) -> DataFrame:
    """Cells of open spreadsheets, one for each part."""
    return _cells(spark, d, make_ods, office.read_ods)


@query("SELECT p_partkey, p_name AS title, p_type AS author FROM part")
def in_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Title and author that office files state."""

    @F.pandas_udf("title string, author string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        found = [office.read_metadata("docx", make_docx(p, q)) for p, q in zip(x, y, strict=True)]
        return pd.DataFrame({"title": [f.get("title") for f in found], "author": [f.get("author") for f in found]})

    return table(spark, d, "part").select("p_partkey", F.inline(F.array(run("p_name", "p_type"))))


@query("SELECT p_partkey, true AS subject, true AS body FROM part")
def in_mail(spark: SparkSession, d: str) -> DataFrame:
    """Whether the text read from a mail holds its subject and its body."""
    found = _again(make_mail, documents.read_mail, "p_name", "p_type")
    text = F.array_join(found, "\n")
    return spread(table(spark, d, "part").select("p_partkey", "p_name", "p_type")).select("p_partkey", text.contains(F.col("p_name")).alias("subject"), text.contains(F.col("p_type")).alias("body"))


@query("SELECT p_partkey, p_name || chr(10) || chr(10) || p_type || ' & ' || p_name AS text FROM part")
def in_html(spark: SparkSession, d: str) -> DataFrame:
    """Text of web pages, without their scripts."""

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(documents.strip_html)

    page = F.concat(F.lit("<html><script>x()</script><h1>"), "p_name", F.lit("</h1><p>"), "p_type", F.lit(" &amp; <b>"), "p_name", F.lit("</b></p></html>"))
    return table(spark, d, "part").select("p_partkey", read(page).alias("text"))


_MARKS = "len(regexp_replace({0}, '\"[^\"]*\"', '', 'g')) - len(replace(regexp_replace({0}, '\"[^\"]*\"', '', 'g'), ';', ''))"
_ONE_LINE = "raw_line IS NOT NULL AND NOT contains(raw_line, chr(10)) AND NOT contains(raw_line, chr(13)) AND trim(raw_line) <> ''"


@query(f"SELECT count(*) AS lines, sum({_MARKS.format('raw_line')} + 1) AS cells, ';' AS delimiter FROM rendez_vous_lilas WHERE (len(raw_line) - len(replace(raw_line, '\"', ''))) % 2 = 0 AND {_ONE_LINE}")
def in_csv(spark: SparkSession, d: str) -> DataFrame:
    """Lines and cells of all exports, written as files and read in splits, and the delimiter chosen for them."""
    path = f"{shared_dir(spark)}/lectern_csv_{uuid.uuid4().hex}"
    one_line = F.col("raw_line").isNotNull() & ~F.col("raw_line").rlike("[\n\r]") & (F.trim("raw_line") != "")
    table(spark, d, "rendez_vous_lilas").where(one_line).select("raw_line", "file_name").write.partitionBy("file_name").text(path)
    read = delimited.read_lines(spark, path).where("not broken")
    return read.agg(F.count("*").alias("lines"), F.sum(F.size("cells")).alias("cells"), F.max("delimiter").alias("delimiter"))


@query("SELECT count(DISTINCT file_name) AS files, 'csv' AS extension FROM rendez_vous_lilas")
def in_listing(spark: SparkSession, d: str) -> DataFrame:
    """Files under a folder, by extension, without reading them."""
    path = f"{shared_dir(spark)}/lectern_list_{uuid.uuid4().hex}"
    names = table(spark, d, "rendez_vous_lilas").select("file_name").distinct().select(F.col("file_name").alias("value"), "file_name")
    names.write.partitionBy("file_name").csv(path)
    found = documents.listing(spark, path)
    return found.groupBy("extension").agg(F.countDistinct(F.regexp_extract("path", "file_name=([^/]*)/", 1)).alias("files"))


@query("SELECT profile_id, sha256(content_id) = sha256(coalesce(title, '')) AS current FROM file_profiles")
def in_verified(spark: SparkSession, d: str) -> DataFrame:
    """Whether contents still are what was recorded of them; here titles against content ids."""
    p = table(spark, d, "file_profiles").select("profile_id", F.sha2("content_id", 256).alias("sha256"), F.encode(F.coalesce("title", F.lit("")), "UTF-8").alias("content"))
    return documents.verified(p).select("profile_id", "current")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL")
def in_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """Texts by a list of ids."""
    docs = table(spark, d, "documents")
    asked = docs.select("doc_id").where("doc_id % 100 = 0")
    return documents.by_ids(docs.where("text is not null"), asked, "doc_id").select("doc_id", "n_chars")


def _reader(image: bytes) -> tuple[str, float]:
    """A stand-in for a recogniser: the page's own bytes as text, surer the longer it is."""
    text = image.decode("utf-8")
    return text, min(1.0, len(text) / 1000)


@query("SELECT row_id, text, least(1.0, length(text) / 1000) AS confidence, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'no_text' WHEN length(text) >= 600 THEN 'recognised' ELSE 'below_threshold' END AS status FROM ocr_page_cache WHERE text IS NOT NULL")
def in_ocr(spark: SparkSession, d: str) -> DataFrame:
    """Pages read through the port of a recogniser, here one that gives the page's own text."""
    pages = table(spark, d, "ocr_page_cache").where("text is not null").select("row_id", F.encode("text", "UTF-8").alias("image"))
    return ports.recognised(pages, "row_id", "image", _reader)


@query("SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL")
def in_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of texts through the port of an embedder, here one that gives their length."""
    found = ports.embedded(table(spark, d, "documents"), "doc_id", "text", lambda texts: [[float(len(t))] for t in texts])
    return found.select("doc_id", F.col("embedding")[0].cast("bigint").alias("n"))
