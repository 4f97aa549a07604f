"""Small binary files, written with the standard library."""

from __future__ import annotations

import io
import zipfile

OLE = bytes.fromhex("D0CF11E0A1B11AE1")


def archive(**members: str | bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


TYPES = '<Types><Override PartName="/word/vbaProject.bin" ContentType="x"/><Override PartName="/word/document.xml" ContentType="y"/></Types>'
RELS = (
    '<Relationships><Relationship Id="a" Type="t/image" Target="http://x.example/i.png" TargetMode="External"/>'
    '<Relationship Id="b" Type="t/officeDocument" Target="word/document.xml"/></Relationships>'
)
DOC = "<w:document><w:t>Hello &amp; bye</w:t><w:t xml:space='preserve'>again</w:t></w:document>"

DOCX_CLEAN = archive(**{"[Content_Types].xml": TYPES, "_rels/.rels": RELS, "word/document.xml": DOC})
DOCX_MACRO = archive(
    **{"[Content_Types].xml": TYPES, "word/document.xml": DOC, "word/vbaProject.bin": b"Attribute VB_Name A Attribute VB_Name B"}
)
XLSX_OLE = archive(
    **{"[Content_Types].xml": TYPES, "xl/workbook.xml": "<w/>", "xl/embeddings/oleObject1.bin": b"x", "xl/_rels/w.rels": RELS}
)
PPTX_ACTIVEX = archive(
    **{"[Content_Types].xml": TYPES, "ppt/presentation.xml": "<p/>", "ppt/activeX/activeX1.xml": '<ax classid="{1}"/>'}
)
CORRUPT = DOCX_CLEAN[: len(DOCX_CLEAN) // 2]
RTF_OBJECT = rb"{\rtf1 text {\object\objemb {\*\objdata 0105 Package}} \endobj after}"
XLS = OLE + b"\x00 VBA Attribute VB_Name"


def pdf(catalog: str = "", objects: str = "") -> bytes:
    return (
        f"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R {catalog} >>\nendobj\n"
        f"2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R >>\nendobj\n"
        f"{objects}trailer\n<< /Root 1 0 R >>\n%%EOF"
    ).encode()


PDF_SAFE = pdf()
PDF_JS = pdf("/OpenAction 4 0 R", "4 0 obj\n<< /S /JavaScript /JS (app.alert\\(1\\)) >>\nendobj\n")
PDF_LAUNCH = pdf("/OpenAction << /S /Launch /F (cmd.exe) >>")
PDF_NAMES = pdf("/Names << /JavaScript << /Names [(a) 5 0 R] >> >>", "5 0 obj\n<< /S /JavaScript /JS (x) >>\nendobj\n")
PDF_BROKEN = b"%PDF-1.4\n1 0 obj << /OpenAction << /S /JavaScript /JS (app.alert('x')) >> >> endobj\ntrailer"
PDF_PACKED = pdf("", "7 0 obj\n<< /Type /ObjStm /N 1 >>\nstream\nxx\nendstream\nendobj\n")

FILES = {
    1: (".docx", DOCX_CLEAN), 2: (".docx", DOCX_MACRO), 3: (".xlsx", XLSX_OLE), 4: (".pptx", PPTX_ACTIVEX), 5: (".docx", CORRUPT),
    6: (".rtf", RTF_OBJECT), 7: (".xls", XLS), 8: (".pdf", PDF_SAFE), 9: (".pdf", PDF_JS), 10: (".pdf", PDF_LAUNCH),
    11: (".pdf", PDF_NAMES), 12: (".pdf", PDF_BROKEN), 13: (".pdf", PDF_PACKED), 14: (".pdf", b""), 15: (".txt", b"plain text"),
}


def frame(spark, files: dict[int, tuple[str, bytes]] = FILES):
    rows = [(k, ext, bytearray(data)) for k, (ext, data) in files.items()]
    return spark.createDataFrame(rows, "file_id bigint, ext string, content binary")
