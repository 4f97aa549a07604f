"""PDFs and archives cleaned inside their rows, with the awkward files each must survive."""

from __future__ import annotations

import io
import pickle
import re
import struct
import zipfile
import zlib

import fixtures as fx
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docwarden.operators import archive_clean, features, pdf_clean, sanitize
from docwarden.plans.cleaning import table_entries
from docwarden.session import once
from docwarden.sources import heads, pdf_graph, zip_codec
from docwarden.sources.pdf_graph import Pdf, Unreadable


def pdf(*objects: bytes, trailer: bytes = b"/Root 1 0 R") -> bytes:
    return b"%PDF-1.5\n" + b"".join(objects) + b"trailer\n<< " + trailer + b" >>\n%%EOF\n"


def obj(n: int, body: bytes) -> bytes:
    return b"%d 0 obj\n%s\nendobj\n" % (n, body)


def clean(data: bytes, scope: str = "scoped", keep: bool = False) -> dict | None:
    done = pdf_clean._one(data, scope, keep)
    return None if done is None else dict(zip(["clean", "removed", *pdf_clean.COUNTERS], done, strict=True))


PAGES = obj(2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>") + obj(3, b"<< /Type /Page /Parent 2 0 R >>")


def check_offsets(data: bytes) -> None:
    """Every entry of the last table leads to its object, and the file reads the same through it."""
    start = int(re.search(rb"startxref\n(\d+)\n%%EOF\n\Z", data)[1])
    table = re.match(rb"xref\n((?:\d+ \d+\n(?:\d{10} \d{5} [nf] \n)+)+)trailer", data[start:])[1]
    for first, lines in re.findall(rb"(\d+) \d+\n((?:\d{10} \d{5} [nf] \n)+)", table):
        for i, line in enumerate(lines.split(b" \n")[:-1]):
            if line.endswith(b"n"):
                assert data[int(line[:10]) :].startswith(b"%d " % (int(first) + i)) and data[int(line[:10]) :].split(b"\n")[0].endswith(b"obj")


def test_nested_page_trees_and_cycles():
    tree = obj(2, b"<< /Kids [4 0 R 5 0 R 2 0 R] >>") + obj(4, b"<< /Kids [6 0 R 99 0 R] >>") + obj(5, b"<< /AA << /O 7 0 R >> /Annots [ ] >>")
    data = pdf(obj(1, b"<< /Type /Catalog /Pages 2 0 R >>"), tree, obj(6, b"<< /AA 7 0 R /Annots 8 0 R >>"), obj(7, b"<< /JS (x) /Next 7 0 R >>"), obj(8, b"[7 0 R 7 0 R]"))
    got = clean(data)
    assert got["removed"] == ["Annots(0)", "Annots(2)", "JS", "Page.AA"] and (got["actions"], got["annotations"], got["js"]) == (2, 2, 1)
    assert set(Pdf(got["clean"]).objects) == {1, 2, 4, 5, 6}
    check_offsets(got["clean"])


def test_object_streams_are_read():
    inner = b"4 0 5 31 << /S /JavaScript /JS (a\\)b) >>   << /T (kept) >>"
    first = inner.index(b"<<")
    body = b"4 0 5 %d " % (inner.index(b"<< /T") - first) + inner[first:]
    first = body.index(b"<<")
    packed = zlib.compress(body)
    stream = obj(9, b"<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (first, len(packed), packed))
    got = clean(pdf(obj(1, b"<< /Type /Catalog /Pages 2 0 R /OpenAction 4 0 R /Extra 5 0 R >>"), PAGES, stream))
    assert got["removed"] == ["OpenAction"] and b"(kept)" in got["clean"] and b"JavaScript" not in got["clean"] and b"ObjStm" not in got["clean"]
    check_offsets(got["clean"])


def test_streams_hide_what_looks_like_objects():
    trap = b"7 0 obj << /JS (no) >> endobj"
    page = obj(4, b"<< /Length %d >>\nstream\n%s\nendstream" % (len(trap), trap))
    for length in (b"%d" % len(trap), b"3", b"5 0 R"):
        data = pdf(obj(1, b"<< /Type /Catalog /Pages 2 0 R /AA 3 0 R >>"), PAGES.replace(b"/Parent", b"/Contents 4 0 R /Parent"), page.replace(b"%d >>" % len(trap), length + b" >>"))
        found = Pdf(data)
        assert 7 not in found.objects and found.data[slice(*found.objects[4].stream)].rstrip() == trap
        got = clean(data)
        assert got["removed"] == ["Catalog.AA"] and trap in got["clean"]


def test_everywhere_cuts_keys_and_actions_of_all_objects():
    data = pdf(obj(1, b"<< /Type /Catalog /Pages 2 0 R >>"), PAGES, obj(6, b"<< /A << /S /Launch /F (a) >> /B << /C [ << /JS (x) /S /JavaScript >> ] >> >>"), obj(7, b"<< /A 8 0 R /K 1 >>"), obj(8, b"<< /S /URI >>"))
    got = clean(data, "everywhere")
    assert got["removed"] == ["/A/Launch", "/JS"] and (got["js"], got["actions"]) == (1, 1) and b"/A 8 0 R" in got["clean"]
    assert set(Pdf(got["clean"]).objects) == {1, 2, 3, 6, 7, 8}
    check_offsets(got["clean"])
    kept = clean(data, "everywhere", keep=True)["clean"]
    assert kept.startswith(data) and Pdf(kept).objects[6].value.inner["/B"]
    check_offsets(kept)


def test_catalog_scope_leaves_pages_alone():
    data = pdf(obj(1, b"<< /Type /Catalog /Pages 2 0 R /OpenAction << /S /GoTo >> /AcroForm 5 0 R >>"), PAGES.replace(b"/Parent", b"/AA << >> /Parent"), obj(5, b"<< /XFA (x) /DA (y) >>"))
    got = clean(data, "catalog")
    assert got["removed"] == ["AcroForm.XFA", "OpenAction"] and (got["js"], got["actions"]) == (2, 2) and b"/AA" in got["clean"] and b"/DA (y)" in got["clean"]


@pytest.mark.parametrize("data", [b"", b"%PDF-1.4", b"plain", b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog", pdf(obj(1, b"<< /A " * 300)), pdf(obj(1, b"[1 2"))])
def test_unreadable_files(data):
    assert clean(data) is None
    with pytest.raises(Unreadable):
        Pdf(data)


def test_encrypted_and_untouched_files():
    whole = pdf(obj(1, b"<< /Type /Catalog /Pages 2 0 R >>"), PAGES)
    assert clean(whole)["clean"] == whole and clean(whole)["removed"] == []
    assert clean(pdf(obj(1, b"<< /Type /Catalog /AA 2 0 R >>"), trailer=b"/Root 1 0 R /Encrypt 4 0 R")) is None


def test_cleaned_column(spark):
    data = pdf(obj(1, b"<< /Type /Catalog /Pages 2 0 R /AA 3 0 R >>"), PAGES)
    df = spark.createDataFrame([(1, data), (1, b"no"), (2, None), (3, data)], "file_id long, content binary")
    got = once(df, {"pdf": pdf_clean.cleaned(F.col("content"))})
    rows = got.collect()
    assert [r.pdf.removed for r in rows] == [["Catalog.AA"], None, None, ["Catalog.AA"]]
    entries = table_entries(got.select("file_id", F.col("pdf.clean").alias("clean"))).filter("file_id = 3").collect()
    assert sorted((r.obj_no, r.found_no) for r in entries) == [(1, 1), (2, 2), (3, 3)]
    with pytest.raises(ValueError):
        pdf_clean.cleaned(F.col("content"), "elsewhere")


# ---- archives


def members(data: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None
        return {i.filename: z.read(i) for i in z.infolist()}


def test_members_that_stay_keep_their_packed_bytes():
    data = fx.archive(**{"word/document.xml": "<w>é</w>" * 500, "a/é.bin": bytes(range(256)) * 40, "x.rels": "<Relationships/>", "empty": ""})
    archive = zip_codec.directory(data)
    out, lost = zip_codec.rewrite(data, archive, lambda info: {"x.rels": b"new", "empty": zip_codec.DROP}.get(info.filename))
    assert not lost and members(out) == {"word/document.xml": "<w>é</w>".encode() * 500, "a/é.bin": bytes(range(256)) * 40, "x.rels": b"new"}
    before, after = ({i.filename: zip_codec.packed(d, i) for i in zip_codec.directory(d).infolist()} for d in (data, out))
    assert before["a/é.bin"] == after["a/é.bin"] and before["word/document.xml"] == after["word/document.xml"]


def test_bad_members_are_left_out_and_named():
    data = bytearray(fx.archive(**{"word/document.xml": "<w>" + "abc" * 400 + "</w>", "ok.xml": "<a/>", "pic.bin": "p" * 99}))
    info = zip_codec.directory(bytes(data)).getinfo("word/document.xml")
    at = info.header_offset + 30 + len(info.filename) + 3
    data[at : at + 4] = b"\xff\xff\xff\xff"
    got, removed = archive_clean._Cleaner("full", None)(bytes(data))
    assert removed == ["unreadable:word/document.xml"] and set(members(got)) == {"ok.xml", "pic.bin"}
    data = bytearray(fx.archive(**{"a.bin": "x", "b.bin": "y"}))
    header = zip_codec.directory(bytes(data)).getinfo("a.bin").header_offset
    data[header : header + 4] = struct.pack("<I", 0)
    got, removed = archive_clean._Cleaner("light", None)(bytes(data))
    assert removed == ["unreadable:a.bin"] and set(members(got)) == {"b.bin"}


def test_many_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(65_540):
            z.writestr(zipfile.ZipInfo(f"{i}"), b"")
    got, _ = zip_codec.rewrite(out.getvalue(), zip_codec.directory(out.getvalue()), lambda info: zip_codec.DROP if info.filename == "7" else None)
    assert len(zip_codec.directory(got).namelist()) == 65_539


def test_archives_larger_than_a_batch_and_repeated_ids(spark):
    big = fx.archive(**{"word/vbaProject.bin": "m", "word/media/a.bin": bytes((i * 7919) % 251 for i in range(300_000)), "word/document.xml": "<w/>"})
    df = spark.createDataFrame([(1, ".docx", big), (1, ".docx", fx.archive(**{"word/document.xml": "<w>x</w>"})), (2, ".docx", b"PK"), (3, ".docx", None)], "file_id long, ext string, content binary")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64k")
    try:
        got = sanitize.ooxml_clean(df).collect()
        counted = features.ooxml(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    assert sorted((r.file_id, tuple(r.removed), tuple(sorted(members(r.clean)))) for r in got) == [
        (1, (), ("word/document.xml",)), (1, ("drop:word/vbaProject.bin",), ("word/document.xml", "word/media/a.bin")),
    ]
    assert sorted((r.file_id, r.zip_member_count, r.macro_size) for r in counted) == [(1, 1, 0), (1, 3, 1), (2, 0, 0), (3, 0, 0)]


def test_cleaning_exchanges_nothing_and_reads_once(spark, tmp_path):
    fx.frame(spark).write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files")).withColumn("verdict", F.lit("malicious"))
    for mode in ("light", "full"):
        plan = sanitize.sanitize(files, mode=mode)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1
    assert "Exchange" not in sanitize.ooxml_clean(files)._jdf.queryExecution().executedPlan().toString()


def test_full_mode(spark):
    bad = pdf(obj(1, b"<< /Type /Catalog /Pages 2 0 R /AA 3 0 R >>"), PAGES)
    rtf = rb"{\rtf1 {\object\objdata 0105} {\field{\*\fldinst HYPERLINK x}} text}"
    docx = fx.archive(**{"word/vbaProject.bin": "m", "docProps/core.xml": "<c/>", "word/document.xml": "<w>p</w>"})
    df = spark.createDataFrame([(1, ".pdf", bad), (2, ".rtf", rtf), (3, ".docx", docx), (4, ".txt", b"t")], "file_id long, ext string, content binary").withColumn("verdict", F.lit("malicious"))
    got = {r.file_id: r for r in sanitize.sanitize(df, mode="full").collect()}
    assert got[1].removed == ["Catalog.AA"] and got[1].engine == "pdf_strip" and got[2].removed == ["field"] and b"fldinst" not in got[2].clean
    assert got[3].removed == ["drop:docProps/core.xml", "drop:word/vbaProject.bin"] and got[4].engine == "passthrough" and not got[4].sanitized
    with pytest.raises(ValueError):
        sanitize.sanitize(df, mode="half")


# ---- files by head


def test_heads_read_only_what_is_asked_for(spark, tmp_path):
    docx = fx.archive(**{"[Content_Types].xml": fx.TYPES, "word/document.xml": "<w/>", "word/media/big.bin": bytes((i * 7919) % 251 for i in range(400_000))})
    files = {"a/x.docx": docx, "a/y.pdf": b"%PDF-1.4" + b"z" * 50_000, "b/blank.rtf": b" \n" * 3000 + b"{\\rtf1 x}", "b/empty.txt": b"", "b/bad.docx": b"PK\x03\x04nothing", "b/deep/.docx": b"h"}
    df = spark.createDataFrame(list(files.items()), "path string, content binary")
    assert heads.write_files(df, str(tmp_path)) == 6 and heads.write_files(df, str(tmp_path)) == 6
    got = {r.path.removeprefix(f"{tmp_path}/"): r for r in features.file_facts(heads.read_heads(spark, str(tmp_path))).collect()}
    assert set(got) == set(files) - {"b/deep/.docx"} and all(r.error is None and r.length == len(files[p]) for p, r in got.items())
    assert {p: r.sniffed_ext for p, r in got.items()} == {"a/x.docx": ".docx", "a/y.pdf": ".pdf", "b/blank.rtf": ".rtf", "b/empty.txt": None, "b/bad.docx": None}
    assert got["a/y.pdf"].bytes_read == 1024 and got["a/x.docx"].bytes_read < 3000 and "word/media/big.bin" in got["a/x.docx"].members
    names = heads.read_heads(spark, str(tmp_path), "path", "ext", "length", "bytes_read")
    assert {r.bytes_read for r in names.collect()} == {0}
    some = heads.read_heads(spark, str(tmp_path), "path", "ext", "length", "content", split_mb=1).filter("ext = '.pdf' and length > 10")
    assert "PushedFilters" in some._jdf.queryExecution().executedPlan().toString() or some.count() == 1
    assert [bytes(r.content) for r in some.collect()] == [files["a/y.pdf"]]
    assert heads.read_heads(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        heads.read_heads(spark, str(tmp_path), "text")


def test_a_file_that_cannot_be_read_keeps_its_row(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    reader = heads._Reader(str(tmp_path), list(heads.SCHEMA), 1 << 20)
    part = reader.partitions()[0]
    (tmp_path / "x.pdf").unlink()
    row = next(iter(reader.read(part))).to_pylist()[0]
    assert row["head"] is None and row["error"].startswith("FileNotFoundError") and row["length"] == 4


def test_names_of_files_do_not_pass_through_the_driver(tmp_path):
    """A plan grows with its tasks, not with the names in it; every file falls to one task, behind links and in folders too."""
    root = tmp_path / "root"
    (root / "deep" / ".er").mkdir(parents=True)
    names = [f"{i:04}-{'n' * 100}.txt" for i in range(600)] + ["deep/.er/a\nb.pdf", "deep/x.pdf"]
    for name in (*names, "_SUCCESS", "deep/.hidden"):
        (root / name).write_bytes(b"h" * 3)
    (root / "link.txt").symlink_to(root / "deep" / "x.pdf")
    (root / "lost.txt").symlink_to(root / "nowhere")
    (root / "linked").symlink_to(root / "deep", target_is_directory=True)
    source = heads.FileHeads({"path": str(root), "split_mb": "1", "lists": f"file://{tmp_path}/lists"})
    reader = source.reader(StructType().add("path", "string").add("length", "long").add("bytes_read", "long"))
    parts = reader.partitions()
    assert len(parts) > 20 and len(pickle.dumps(parts)) < 300 * len(parts)
    rows = [row for part in parts for batch in reader.read(pickle.loads(pickle.dumps(part))) for row in batch.to_pylist()]
    want = [*names, "link.txt", "linked/.er/a\nb.pdf", "linked/x.pdf"]
    assert sorted(r["path"] for r in rows) == sorted(f"{root}/{n}" for n in want) and {r["length"] for r in rows} == {3}
