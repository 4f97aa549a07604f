"""Corpora derived from the given texts: constructs planted by document number, so that every rule has work.

The same plants are spelled out in the checking SQL (``plans/sql.py`` builds its literals from these tuples).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.functions import fixed
from docwarden.session import spread
from docwarden.sources import archives
from docwarden.sources.tables import table

# (before the text, after the text); 25 entries are co-prime with the 6 types, so every pair of both occurs
PLANTS = (
    ("", ""),
    ("", ' calls javascript with eval(unescape("%u") and fromCharCode(65)'),
    ("", " <script src=x>document.open()</script>"),
    ("", " WScript.Shell then CreateObject(a) and Shell(b)"),
    ("", " PowerShell -enc base64,AAAA via cmd.exe"),
    ("", " mshta with ActiveXObject and AutoOpen"),
    ("%PDF-1.4\n", " /Type /Page 1 0 obj stream endstream endobj xref startxref"),
    ("%PDF-1.4\n", " 1 0 obj << /OpenAction << /S /JavaScript /JS (app.alert) >> >> endobj"),
    ("%PDF-1.4\n", " << /S /Launch /F (cmd.exe) >> /AA << /WC 4 0 R >>"),
    ("%PDF-1.7\n", " /URI (http://a.example/x) /GoToR /EmbeddedFile /EmbeddedFiles"),
    ("%PDF-1.7\n", " /Type/Page /Type /Pages /URI /URI 2 0 obj 3 0 obj"),
    ("{\\rtf1 ", " {\\object\\objemb {\\*\\objdata 0105 Package}} \\endobj }"),
    ("{\\rtf1 ", ' {\\field{\\*\\fldinst HYPERLINK "http://b.example/" \\o x }} \\link }'),
    (" {\\rtf1 ", " {\\pict 0a0b} \\objupdate \\objdata d0cf11e0 javascript shell }"),
    ("{\\rtf1 ", " {\\*\\generator Riched20;} plain }"),
    ("{\\rtf1 ", " {\\field{\\*\\fldinst DDEAUTO excel}} \\shp \\blipuid \\objclass }"),
    ("", " see http://one.example and HTTPS://two.example/path?q=1 now"),
    ("", " " + " ".join(f"http://n{i}.example/" for i in range(12))),
    ("", " URLDownloadToFile WinExec ADODB.Stream Msxml2.XMLHTTP"),
    ("", " Attribute VB_Name = 1 VBA vbaProject.bin"),
    ("", " net user whoami certutil regsvr32.exe rundll32 data:text"),
    ("", " macro vbaproject oleObject dde ddeauto"),
    ("", " embedded object file with launch and submitform"),
    ("", " << /JS (x) >>"),
    ("", " eval( eval( cmd.exe cmd.exe p0wershell PAYLOAD.ru"),
)

# Constructs of a well-formed PDF: extra catalog entries, extra objects.
PDF_PLANTS = (
    ("", ""),
    ("/OpenAction 4 0 R", "4 0 obj\n<< /Type /Action /S /JavaScript /JS (app.alert\\(1\\)) >>\nendobj\n"),
    ("/OpenAction << /S /Launch /F (cmd.exe) >>", ""),
    (
        "/Names << /JavaScript << /Names [(x) 5 0 R] >> >>",
        "5 0 obj\n<< /S /JavaScript /JS (run) >>\nendobj\n",
    ),
    ("/AA << /WC 4 0 R >>", "4 0 obj\n<< /S /URI /URI (http://x.example/) >>\nendobj\n"),
    ("/OpenAction << /S /SubmitForm >> /AcroForm << /XFA 6 0 R >>", ""),
    (
        "/Outlines 9 0 R",
        "6 0 obj\n<< /Type /Annot /A << /S /Launch /F (a) >> >>\nendobj\n7 0 obj\n<< /S /Launch /F (a) >>\nendobj\n",
    ),
    ("/Names 8 0 R", "8 0 obj\n<< /JavaScript 9 0 R /EmbeddedFiles 10 0 R >>\nendobj\n"),
)

# Files of five objects and more whose active parts hang on the catalog and the page:
# (catalog entries, page entries, further objects, trailer entries).
PDF_GRAPH_PLANTS = (
    ("", "", "", ""),
    ("/OpenAction 5 0 R", "", "5 0 obj\n<< /S /JavaScript /JS (app.alert\\(1\\)) >>\nendobj\n", ""),
    (
        "/Names 5 0 R", "",
        "5 0 obj\n<< /JavaScript 6 0 R /EmbeddedFiles << /Names [(a) 7 0 R] >> /Dests 8 0 R >>\nendobj\n6 0 obj\n<< /Names [(x) 9 0 R] >>\nendobj\n"
        "7 0 obj\n<< /Type /Filespec /F (a.exe) >>\nendobj\n8 0 obj\n<< /Kids [] >>\nendobj\n9 0 obj\n<< /S /JavaScript /JS (run) >>\nendobj\n", "",
    ),
    ("/AcroForm << /XFA 5 0 R /Fields [6 0 R] /DA (/Helv 0 Tf) >>", "", "5 0 obj\n<< >>\nendobj\n6 0 obj\n<< /T (field) >>\nendobj\n", ""),
    (
        "", "/Annots [5 0 R 6 0 R << /Subtype /Link /A << /S /URI /URI (http://x.example/) >> >>] /AA << /O 7 0 R >>",
        "5 0 obj\n<< /Subtype /Link /A << /S /JavaScript /JS (a) >> >>\nendobj\n6 0 obj\n<< /Subtype /Widget /A 7 0 R >>\nendobj\n"
        "7 0 obj\n<< /S /JavaScript /JS <6170702E> >>\nendobj\n", "",
    ),
    ("", "/Annots 5 0 R /RichMediaContent << /Assets 6 0 R >>", "5 0 obj\n[6 0 R]\nendobj\n6 0 obj\n<< /Subtype /RichMedia >>\nendobj\n", ""),
    (
        "/ViewerPreferences << /HideToolbar true /Direction /L2R >> /Metadata 5 0 R /PageLabels 6 0 R /Outlines 7 0 R", "",
        "5 0 obj\n<< /Length 3 >>\nstream\n<x>\nendstream\nendobj\n6 0 obj\n<< /Nums [] >>\nendobj\n7 0 obj\n<< /Count 0 >>\nendobj\n"
        "8 0 obj\n<< /Title (t) >>\nendobj\n", "/Info 8 0 R",
    ),
    (
        "/AA << /WC 5 0 R >> /Extra 5 0 R", "",
        "5 0 obj\n<< /Next 6 0 R /Deep << /Deeper [<< /JS (x \\) y) >>] >> >>\nendobj\n6 0 obj\n<< /Next 5 0 R /JavaScript (y) >>\nendobj\n", "",
    ),
)

# Extra archive members: (name, body before the text, body after the text); None as name means no member.
OOXML_EXTS = (".docx", ".xlsx", ".pptx")
OOXML_ROOTS = ("word/", "xl/", "ppt/")
OOXML_MAIN = ("document.xml", "workbook.xml", "presentation.xml")
OOXML_PLANTS = (
    (),
    (("vbaProject.bin", "Attribute VB_Name = A CreateObject ", " Attribute VB_Name = B"),),
    (("embeddings/oleObject1.bin", "OLE ", ""), ("embeddings/oleObject2.bin", "", "")),
    (("activeX/activeX1.xml", '<ax:ocx ax:classid="{1}">', "</ax:ocx>"),),
    (("vml/links.vml", "<v>Shell WScript.Shell CreateObject http://l.example/", "</v>"),),
    (("comments1.xml", "<c>", "</c>"), ("externalLinks/externalLink1.xml", "<x>", "</x>")),
    (("vbaProject.bin", "", ""), ("vbaProjectSignature.bin", "sig", "")),
)
RELS = (
    '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="r1" Type="http://t.example/officeDocument" Target="document.xml"/>'
    '<Relationship Id="r2" Type="http://t.example/image" Target="http://i.example/p.png" TargetMode="External"/>'
    '<Relationship Id="r3" Type="http://t.example/hyperlink" Target="#a"/>'
    '<Relationship Id="r4" Type="http://t.example/oleObject" Target="FILE:///c:/x"/>'
    '<Relationship Id="r5" Type="http://t.example/externalLink" Target="externalLinks/externalLink1.xml"/>'
    "</Relationships>"
)
CONTENT_TYPES = (
    '<Types><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/main+xml"/>'
    '<Override PartName="/word/vbaProject.bin" ContentType="application/bin"/>'
    '<Override PartName="/word/activeX/activeX1.xml" ContentType="application/vnd.ms-office.activeX+xml"/>'
    '<Override PartName="/word/comments.xml" ContentType="application/comments+xml"/>'
    '<Override PartName="/docProps/core.xml" ContentType="application/core+xml"/>'
    '<Override PartName="/word/externalLinks/e.xml" ContentType="application/e+xml"/></Types>'
)


def pick(options: list[Column], number: Column) -> Column:
    """Option number ``number`` modulo their count."""
    return F.element_at(F.array(*options), (number % len(options) + 1).cast("int"))


def text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, ext, text, content): each document wrapped in one plant, typed by its number."""
    return planted(spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id"))


def planted(d: DataFrame) -> DataFrame:
    """(doc_id, text), at rest or arriving -> (file_id, ext, text, content)."""
    n = F.col("doc_id")
    text = F.concat(
        pick([F.lit(a) for a, _ in PLANTS], n), F.col("text"), pick([F.lit(b) for _, b in PLANTS], n)
    )
    return d.select(
        n.alias("file_id"),
        pick([F.lit(e) for e in fixed.SUPPORTED_EXTS], n).alias("ext"),
        text.alias("text"),
        F.encode(text, "UTF-8").alias("content"),
    )


def pdf_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Well-formed PDFs with the document as a content stream."""
    d = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    n = F.col("doc_id")
    text = F.concat(
        F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R "),
        pick([F.lit(a) for a, _ in PDF_PLANTS], n),
        F.lit(" >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n3 0 obj\n<< /Length "),
        F.octet_length("text").cast("string"),
        F.lit(" >>\nstream\n"),
        F.col("text"),
        F.lit("\nendstream\nendobj\n"),
        pick([F.lit(b) for _, b in PDF_PLANTS], n),
        F.lit("trailer\n<< /Root 1 0 R >>\n%%EOF\n"),
    )
    return d.select(n.alias("file_id"), F.lit(".pdf").alias("ext"), text.alias("text"), F.encode(text, "UTF-8").alias("content"))


def pdf_graph_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """PDFs with a page, the document as its content, and ``PDF_GRAPH_PLANTS`` by number."""
    d = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    n = F.col("doc_id")
    catalog, page, objects, trailer = (pick([F.lit(p[i]) for p in PDF_GRAPH_PLANTS], n) for i in range(4))
    whole = F.concat(
        F.lit("%PDF-1.5\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R "), catalog,
        F.lit(" >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 4 0 R "), page,
        F.lit(" >>\nendobj\n4 0 obj\n<< /Length "), F.octet_length("text").cast("string"), F.lit(" >>\nstream\n"), F.col("text"),
        F.lit("\nendstream\nendobj\n"), objects, F.lit("trailer\n<< /Root 1 0 R "), trailer, F.lit(" >>\n%%EOF\n"),
    )
    return d.select(n.alias("file_id"), F.lit(".pdf").alias("ext"), F.encode(whole, "UTF-8").alias("content"))


def ooxml_members(spark: SparkSession, folder: str) -> DataFrame:
    """Member rows of the office documents to build: (file_id, ext, pos, member, body)."""
    d = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    n = F.col("doc_id")
    root = pick([F.lit(r) for r in OOXML_ROOTS], n)
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def member(pos: int, name: Column, body: Column) -> Column:
        return F.struct(F.lit(pos).alias("pos"), name.alias("member"), F.encode(body, "UTF-8").alias("body"))

    common = [
        member(1, F.lit("[Content_Types].xml"), F.lit(CONTENT_TYPES)),
        member(2, F.lit("_rels/.rels"), F.lit(RELS)),
        member(
            3,
            F.concat(root, pick([F.lit(m) for m in OOXML_MAIN], n)),
            F.concat(F.lit("<w:document><w:p><w:t>"), escaped, F.lit("</w:t></w:p><w:hyperlink r:id='r3'/></w:document>")),
        ),
    ]
    planted = [
        F.array(
            *common,
            *[
                member(4 + i, F.concat(root, F.lit(name)), F.concat(F.lit(before), F.col("text"), F.lit(after)))
                for i, (name, before, after) in enumerate(extra)
            ],
        )
        for extra in OOXML_PLANTS
    ]
    # a CASE builds only the chosen array, an element_at over all of them would build every one
    planted_for = F.lit(None)
    for i, members in enumerate(planted):
        planted_for = F.when(n % len(planted) == i, members).otherwise(planted_for)
    return d.select(
        n.alias("file_id"),
        pick([F.lit(e) for e in OOXML_EXTS], n).alias("ext"),
        F.explode(planted_for).alias("m"),
    ).select("file_id", "ext", "m.pos", "m.member", "m.body")


def ooxml_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(file_id, ext, content) with real archives; every 50th document's archive is cut in half."""
    built = archives.rebuild_archives(ooxml_members(spark, folder))
    n = F.col("file_id")
    cut = F.substring("content", F.lit(1), (F.length("content") / 2).cast("int"))
    return built.select(
        n,
        pick([F.lit(e) for e in OOXML_EXTS], n).alias("ext"),
        F.when(n % 50 == 49, cut).otherwise(F.col("content")).alias("content"),
    )


def ole_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Legacy spreadsheets: every other document carries the compound-file header, every third some macro text."""
    d = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    n = F.col("doc_id")
    header = F.when(n % 2 == 0, F.unhex(F.lit(fixed.OLE_HEADER_HEX))).otherwise(F.lit(b"").cast("binary"))
    tail = F.when(n % 3 == 0, " VBA Attribute VB_Name VBA").otherwise("")
    return d.select(
        n.alias("file_id"),
        F.lit(".xls").alias("ext"),
        F.concat(header, F.encode(F.concat("text", tail), "UTF-8")).alias("content"),
    )
