"""Queries on files that were cleaned inside their row: what was cut, and whether the result opens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.functions import text
from docwarden.operators import features, pdf_clean
from docwarden.plans import sql
from docwarden.plans.files import IS_RTF, OOXML
from docwarden.plans.registry import query
from docwarden.session import once, shared_folder
from docwarden.sources import corpus, heads

#: What each plant of the corpus must lose and keep: labels, the five counters, numbers of the objects that stay.
EXPECTED = (
    ("", (0, 0, 0, 0, 0), ()),
    ("OpenAction", (0, 1, 0, 0, 0), (1, 2, 3, 4)),
    ("Names.EmbeddedFiles,Names.JavaScript", (1, 0, 0, 1, 0), (1, 2, 3, 4, 5, 8)),
    ("AcroForm.Fields,AcroForm.XFA", (2, 1, 0, 0, 0), (1, 2, 3, 4)),
    ("Annots(3),JS,Page.AA", (2, 1, 3, 0, 0), (1, 2, 3, 4)),
    ("Annots(1),Page.RichMediaContent", (0, 0, 1, 0, 1), (1, 2, 3, 4)),
    ("Info,Metadata,Outlines,PageLabels,ViewerPreferences.Direction,ViewerPreferences.HideToolbar", (0, 0, 0, 0, 0), (1, 2, 3, 4)),
    ("Catalog.AA,JS", (2, 1, 0, 0, 0), (1, 2, 3, 4, 5, 6)),
)
_EXPECTED_SQL = "expected(plant, removed, js, actions, annotations, embedded_files, richmedia, objects) AS (VALUES " + ", ".join(
    f"({i}, {sql.lit(labels)}, {', '.join(map(str, counts))}, {list(objects)}::BIGINT[])" for i, (labels, counts, objects) in enumerate(EXPECTED)
) + ")"


@query(
    "pdf_scoped_strip",
    f"""WITH {_EXPECTED_SQL}
SELECT doc_id AS file_id, removed, js, actions, annotations, embedded_files, richmedia, true AS text_kept
FROM documents JOIN expected ON plant = doc_id % {len(EXPECTED)}""",
)
def pdf_scoped_strip(spark: SparkSession, folder: str) -> DataFrame:
    """Labels and counters of what hung on the catalog and the page; the page's content is as it was."""
    files = corpus.pdf_graph_corpus(spark, folder)
    done = once(files, {"pdf": pdf_clean.cleaned(F.col("content"))})
    page = lambda c: F.regexp_extract(text.latin1(c), r"(?s)4 0 obj\n(.*?\nendstream)", 1)
    return done.select(
        "file_id", F.array_join("pdf.removed", ",").alias("removed"), *[f"pdf.{c}" for c in pdf_clean.COUNTERS],
        (page(F.col("pdf.clean")) == page(F.col("content"))).alias("text_kept"),
    )


def table_entries(files: DataFrame) -> DataFrame:
    """(file_id, clean) -> (file_id, obj_no, found_no): each entry of the last table, and the number of the object at its offset."""
    raw = once(files, {"raw": text.latin1(F.col("clean"))})
    start = F.regexp_extract("raw", r"startxref\n(\d+)\n%%EOF\n$", 1)
    table = F.when(start != "", F.regexp_extract(F.substring(F.col("raw"), start.try_cast("int") + 1, F.length("raw")), r"^xref\n((?:\d+ \d+\n(?:\d{10} \d{5} [nf] \n)+)+)trailer", 1))
    cut = once(raw, {"table": table})
    heads = F.regexp_extract_all("table", F.lit(r"(\d+) \d+\n(?:\d{10} \d{5} [nf] \n)+"), 1)
    bodies = F.regexp_extract_all("table", F.lit(r"\d+ \d+\n((?:\d{10} \d{5} [nf] \n)+)"), 1)
    runs = cut.select("file_id", "raw", F.inline(F.arrays_zip(heads.alias("first"), bodies.alias("lines"))))
    lines = runs.select("file_id", "raw", "first", F.posexplode(F.split(F.rtrim("lines"), " \n")).alias("at", "line"))
    used = lines.filter(F.endswith("line", F.lit("n")))
    there = F.regexp_extract(F.substring(F.col("raw"), F.substring("line", 1, 10).cast("int") + 1, F.lit(24)), r"^(\d+) \d+ obj", 1)
    return used.select("file_id", (F.col("first").cast("bigint") + F.col("at")).alias("obj_no"), there.try_cast("bigint").alias("found_no"))


@query(
    "pdf_offsets",
    f"""WITH {_EXPECTED_SQL}, o AS (SELECT doc_id AS file_id, unnest(objects) AS obj_no FROM documents JOIN expected ON plant = doc_id % {len(EXPECTED)})
SELECT file_id, kind, obj_no, obj_no AS found_no, kind = 'update' AS original_kept FROM o, (VALUES ('new'), ('update')) AS k(kind)""",
)
def pdf_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned files open: every offset of their tables leads to the object it stands for, in new files and in updates."""
    files = corpus.pdf_graph_corpus(spark, folder)
    out = []
    for kind, keep in (("new", False), ("update", True)):
        done = once(files, {"pdf": pdf_clean.cleaned(F.col("content"), keep_original=keep)}).filter(F.size("pdf.removed") > 0)
        kept = F.startswith(F.col("pdf.clean"), F.col("content"))
        entries = table_entries(done.select("file_id", F.col("pdf.clean").alias("clean")))
        whole = done.select("file_id", kept.alias("original_kept"))
        out.append(entries.join(whole, "file_id").withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1]).select("file_id", "kind", "obj_no", "found_no", "original_kept")


@query(
    "file_heads",
    f"""WITH {sql.CORPUS}, {OOXML}, v AS (
  SELECT file_id, max(CASE WHEN contains(member, 'vbaProject.bin') THEN 1.0 ELSE 0.0 END)::DOUBLE AS has_vba_project,
    count(*) FILTER (contains(member, '/embeddings/') OR contains(member, 'oleObject'))::DOUBLE AS embedded_ole_count FROM members GROUP BY file_id)
SELECT 'text' AS kind, file_id, ext, CASE WHEN starts_with(text, '%PDF') THEN '.pdf' WHEN {IS_RTF} THEN '.rtf' END AS sniffed_ext,
  0.0::DOUBLE AS has_vba_project, 0.0::DOUBLE AS embedded_ole_count, least(strlen(text), 1024)::BIGINT AS head_bytes FROM corpus
UNION ALL SELECT 'packed', doc_id, {sql.pick(corpus.OOXML_EXTS, 'doc_id')}, CASE WHEN doc_id % 50 <> 49 THEN {sql.pick(corpus.OOXML_EXTS, 'doc_id')} END,
  coalesce(has_vba_project, 0), coalesce(embedded_ole_count, 0), NULL FROM documents LEFT JOIN v ON file_id = doc_id
UNION ALL SELECT 'ole', doc_id, '.xls', '.xls', 0.0, 0.0, least(strlen(text || CASE WHEN doc_id % 3 = 0 THEN ' VBA Attribute VB_Name VBA' ELSE '' END) + 8, 1024)
  FROM documents WHERE doc_id % 2 = 0""",
)
def file_heads(spark: SparkSession, folder: str) -> DataFrame:
    """Files on disk by type, macros and embedded objects, from their heads and directories; ``head_bytes`` is what was read of the others."""
    root = f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"
    named = lambda df, kind: df.select(F.concat(F.lit(f"{kind}/"), F.col("file_id").cast("string"), F.col("ext")).alias("path"), "content")
    text_files, packed = named(corpus.text_corpus(spark, folder), "text"), named(corpus.ooxml_corpus(spark, folder), "packed")
    # spreadsheets without the compound-file header are in another query
    ole = named(corpus.ole_corpus(spark, folder).filter(features.is_ole(F.col("content"))), "ole")
    heads.write_files(text_files.unionByName(packed).unionByName(ole), root)
    seen = features.file_facts(heads.read_heads(spark, root, "path", "length", "ext", "head", "members", "bytes_read"))
    kind = F.regexp_extract("path", r"/(text|packed|ole)/-?\d+[^/]*$", 1)
    return seen.select(
        kind.alias("kind"), F.regexp_extract("path", r"/(-?\d+)[^/]*$", 1).cast("bigint").alias("file_id"), "ext", "sniffed_ext",
        "has_vba_project", "embedded_ole_count", F.when(kind != "packed", F.col("bytes_read")).alias("head_bytes"),
    )
