"""Feature columns of a file corpus.

Input rows are (file_id, ext, content BINARY). Everything but the entropies is one projection over a
character-per-byte view of the content, so a corpus is scanned once whatever the number of features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.functions import fixed, text
from docwarden.functions.bytes import byte_entropy, chunk_entropy_p95
from docwarden.operators import archive_clean
from docwarden.session import once, small_batches
from docwarden.sources import archives


def with_text(df: DataFrame) -> DataFrame:
    """Add ``raw``: the content with one character per byte."""
    return df.withColumn("raw", text.latin1(F.col("content")))


def ext_flags(ext: Column) -> dict[str, Column]:
    """One 0/1 column per supported type. An unknown type has none of them set."""
    return {f"ext_is_{e[1:]}": (ext == e).cast("int") for e in fixed.SUPPORTED_EXTS}


def hashes(df: DataFrame) -> DataFrame:
    """SHA-256 and size of whole contents."""
    return df.select("file_id", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("size_bytes"))


def normalised_entropy(df: DataFrame) -> DataFrame:
    """Entropy of whole contents scaled to 0..1."""
    return df.select("file_id", F.least(F.lit(1.0), byte_entropy(F.col("content")) / 8.0).alias("entropy"))


def general(df: DataFrame) -> DataFrame:
    """Size, chunk entropy, token total, URL count and type flags."""
    return with_text(df).select(
        "file_id",
        F.octet_length("content").alias("file_size"),
        chunk_entropy_p95(F.col("content")).alias("entropy_p95"),
        text.token_total(F.col("raw"), fixed.OFFICE_TOKENS).alias("suspicious_token_count"),
        text.url_count(text.utf8_ignore(F.col("content"))).alias("url_count_general"),
        *[c.alias(name) for name, c in ext_flags(F.col("ext")).items()],
    )


def _starts_pdf(raw: Column) -> Column:
    return F.startswith(raw, F.lit("%PDF"))


def _starts_rtf(raw: Column) -> Column:
    # leading white space as bytes.strip sees it
    return raw.rlike(r"^[ \t\n\r\x0b\f]*\{\\rtf")


def _pdf_columns(raw: Column, p95: Column, with_launch: bool = True) -> dict[str, Column]:
    is_pdf = _starts_pdf(raw)

    def only(value: Column, kind: str = "int") -> Column:
        return F.when(is_pdf, value.cast(kind)).otherwise(F.lit(0).cast(kind))

    columns = {
        "pdf_has_js": only(text.has_any(raw, fixed.PDF_JS_TOKENS)),
        "pdf_has_openaction": only(text.has_any(raw, fixed.PDF_OPEN_TOKENS)),
        "pdf_has_launch": only(text.has_any(raw, ("/Launch",))),
        "pdf_uri_count": only(text.token_total(raw, fixed.PDF_URI_TOKENS)),
        "pdf_embedded_file_count": only(text.token_total(raw, fixed.PDF_EMBED_TOKENS)),
        "pdf_object_count": only(text.token_count(raw, " obj")),
        "pdf_stream_count": only(text.token_count(raw, "stream")),
        "pdf_xref_count": only(text.token_count(raw, "xref")),
        "pdf_entropy_p95": only(p95, "double"),
    }
    if not with_launch:
        del columns["pdf_has_launch"]
    return columns


def pdf(df: DataFrame, with_launch: bool = True) -> DataFrame:
    """PDF features, all zero unless the content starts with the PDF marker."""
    # files of other kinds are not shipped to Python
    p95 = chunk_entropy_p95(F.when(_starts_pdf(F.col("raw")), F.col("content")))
    cols = _pdf_columns(F.col("raw"), p95, with_launch)
    return with_text(df).select("file_id", *[c.alias(k) for k, c in cols.items()])


def _rtf_columns(raw: Column, p95: Column) -> dict[str, Column]:
    is_rtf = _starts_rtf(raw)
    low = F.lower(raw)

    def only(value: Column, kind: str = "int") -> Column:
        return F.when(is_rtf, value.cast(kind)).otherwise(F.lit(0).cast(kind))

    packager = F.contains(raw, F.lit("\\objdata")) & (
        F.contains(raw, F.lit("Package")) | F.contains(low, F.lit("d0cf"))
    )
    return {
        "rtf_objdata_count": only(text.token_count(raw, "\\objdata")),
        "rtf_object_count": only(text.token_count(raw, "\\object")),
        "rtf_field_count": only(text.token_count(raw, "\\field")),
        "rtf_pict_count": only(text.token_count(raw, "\\pict")),
        "rtf_link_count": only(text.token_count(raw, "\\link")),
        "rtf_url_count": only(text.url_count(raw)),
        "rtf_js_like": only(F.contains(low, F.lit("javascript"))),
        "rtf_shell_like": only(text.has_any(low, ("shell", "cmd.exe"))),
        "rtf_entropy_p95": only(p95, "double"),
        "rtf_has_ole_packager_hint": only(packager),
    }


def rtf(df: DataFrame) -> DataFrame:
    """RTF features, all zero unless the content starts with the RTF group."""
    p95 = chunk_entropy_p95(F.when(_starts_rtf(F.col("raw")), F.col("content")))
    cols = _rtf_columns(F.col("raw"), p95)
    return with_text(df).select("file_id", *[c.alias(k) for k, c in cols.items()])


def is_ole(content: Column) -> Column:
    return F.startswith(content, F.unhex(F.lit(fixed.OLE_HEADER_HEX)))


def _xls_columns(raw: Column, content: Column) -> dict[str, Column]:
    ole = is_ole(content)
    return {
        "xls_is_ole": ole.cast("int"),
        "xls_has_vba_hint": F.when(ole, F.contains(raw, F.lit("VBA")).cast("int")).otherwise(F.lit(0)),
        "xls_vba_token_count": F.when(ole, text.token_total(raw, ("VBA", "Attribute VB_Name"))).otherwise(F.lit(0)),
    }


def xls(df: DataFrame) -> DataFrame:
    """Legacy spreadsheet features."""
    cols = _xls_columns(F.col("raw"), F.col("content"))
    return with_text(df).select("file_id", *[c.alias(k) for k, c in cols.items()])


OOXML_COLUMNS = tuple(c.split()[0] for c in archive_clean.COUNTS.split(", "))


def ooxml(df: DataFrame) -> DataFrame:
    """OOXML features of archives, counted in their rows; a file that is no archive has zeros."""
    return once(df.select("file_id", "content"), {"_zip": archive_clean.counted(F.col("content"))}).select("file_id", "_zip.*")


def dispatch(df: DataFrame) -> DataFrame:
    """All feature groups side by side; a group that the type does not have is null, so that alignment can fill it.

    One scan gives all groups; archives are opened in their rows.
    """
    raw, content, ext, p95 = F.col("raw"), F.col("content"), F.col("ext"), F.col("entropy_p95")
    groups = [(".pdf", _pdf_columns(raw, p95)), (".rtf", _rtf_columns(raw, p95)), (".xls", _xls_columns(raw, content))]
    # one entropy per file serves the general, the PDF and the RTF group
    opened = once(df, {"entropy_p95": chunk_entropy_p95(content), "_zip": archive_clean.counted(F.when(ext.isin(*fixed.OOXML_EXTS), content))})
    base = with_text(opened).select(
        "file_id",
        "ext",
        F.octet_length("content").alias("file_size"),
        "entropy_p95",
        text.token_total(raw, fixed.OFFICE_TOKENS).alias("suspicious_token_count"),
        text.url_count(text.utf8_ignore(content)).alias("url_count_general"),
        *[c.alias(k) for k, c in ext_flags(ext).items()],
        *[F.when(ext == e, c).alias(k) for e, cols in groups for k, c in cols.items()],
        "_zip",
    )
    # an archive type without readable members has zeros, other types have no such columns
    return base.withColumns({c: F.when(F.col("ext").isin(*fixed.OOXML_EXTS), F.col("_zip")[c]) for c in OOXML_COLUMNS}).drop("_zip")


def runtime_meta(df: DataFrame, with_archives: bool = True) -> DataFrame:
    """What the live scan knows of a file: seven columns, with the entropy scaled to 0..1.

    Archive facts come from the member names, for the macro-enabled suffixes as well.
    """
    raw, ext = F.col("raw"), F.col("ext")
    is_pdf = (ext == ".pdf") | ((F.octet_length("content") > 100) & F.contains(F.substring(raw, 1, 100), F.lit("%PDF")))
    is_office = ~is_pdf & ext.isin(*fixed.OFFICE_RULE_EXTS)
    is_rtf = ~is_pdf & ~is_office & ((ext == ".rtf") | ((F.octet_length("content") > 6) & F.startswith(raw, F.lit("{\\rtf1"))))
    rows = with_text(df).select(
        "file_id",
        F.octet_length("content").cast("double").alias("size_bytes"),
        F.least(F.lit(1.0), byte_entropy(F.col("content")) / 8.0).alias("entropy"),
        F.when(is_pdf, text.has_any(raw, fixed.PDF_MARKER_TOKENS)).otherwise(F.lit(False)).cast("double").alias("pdf_has_javascript"),
        F.when(is_pdf, text.token_total(raw, fixed.PDF_PAGE_TOKENS)).otherwise(F.lit(0)).cast("double").alias("page_count"),
        F.when(is_rtf, text.has_any(raw, ("\\objdata", "\\object"))).otherwise(F.lit(False)).cast("double").alias("has_embedded_objects"),
        *([archives.member_names(F.when(is_office, F.col("content"))).alias("names")] if with_archives else []),
    )
    if not with_archives:
        return rows.withColumns({"has_vba_project": F.lit(0.0), "embedded_ole_count": F.lit(0.0)})
    return rows.withColumns(archive_facts(F.col("names"))).drop("names")


def archive_facts(names: Column) -> dict[str, Column]:
    """Macro flag and embedded-object count from member names; 0 for what is no archive."""
    macro = F.exists(names, lambda n: F.contains(n, F.lit("vbaProject.bin")))
    ole = F.filter(names, lambda n: F.contains(n, F.lit("/embeddings/")) | F.contains(n, F.lit("oleObject")))
    return {
        "has_vba_project": F.coalesce(macro, F.lit(False)).cast("double"),
        "embedded_ole_count": F.when(names.isNull(), F.lit(0.0)).otherwise(F.size(ole).cast("double")),
    }


def snippet_array(value: Column) -> Column:
    """(keyword, snippet) of each keyword found in a text: its first hit with 40 characters before and 80 after."""
    low = F.lower(value)

    def cut(keyword: str) -> Column:
        at = F.instr(low, F.lit(keyword))
        start = F.greatest(at - 40, F.lit(1))
        stop = F.least(F.length(value), at + len(keyword) + 79)
        line = F.replace(F.substring(value, start, stop - start + 1), F.lit("\n"), F.lit(" "))
        return F.when(at > 0, F.struct(F.lit(keyword).alias("keyword"), F.trim(line, F.lit(" \t\n\r\x0b\f")).alias("snippet")))

    return F.array_compact(F.array(*[cut(k) for k in fixed.SNIPPET_KEYWORDS]))


def snippets(df: DataFrame) -> DataFrame:
    """(file_id, text) -> one row per keyword found."""
    return df.select("file_id", F.inline(snippet_array(F.col("text"))))


def rtf_plain_text(value: Column) -> Column:
    """Text of an RTF body: control groups and words out, white space squeezed."""
    body = F.regexp_replace(value, r"\{\\[^}]+\}", " ")
    body = F.regexp_replace(body, r"\\[a-zA-Z]+-?\d*", " ")
    squeezed = F.regexp_replace(body, "[" + fixed.WHITESPACE_CLASS + "]+", " ")
    return F.trim(squeezed)


def office_text(members: DataFrame) -> DataFrame:
    """Text runs of the word, slide and shared-string parts, in archive order, one line per run."""
    part = F.col("member").rlike(r"^(word/document|ppt/slides/slide\d+|ppt/presentation|xl/sharedStrings|xl/workbook)\.xml$")
    runs = F.regexp_extract_all(text.utf8_ignore(F.col("body")), F.lit(r"<(?:w:|a:)?t(?:\s[^>]*)?>([^<]*)<"), 1)
    line = F.array_join(F.filter(runs, lambda r: F.trim(r) != ""), "\n")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        line = F.replace(line, F.lit(entity), F.lit(char))
    parts = members.filter(part).select("file_id", "pos", line.alias("line"))
    return parts.groupBy("file_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda p: p["line"]), "\n").alias("text")
    )


def head_kind(head: Column) -> Column:
    """Type that the first bytes tell, null for archives and everything else."""
    raw = text.latin1(head)
    return (
        F.when(F.startswith(raw, F.lit("%PDF")), ".pdf")
        .when(raw.rlike(r"\A[ \t\n\r\x0b\f]*\{\\rtf"), ".rtf")
        .when(is_ole(head), ".xls")
    )


def members_kind(names: Column) -> Column:
    """Type that the names of an archive's members tell."""

    def folder(name: str) -> Column:
        return F.exists(names, lambda n: F.startswith(n, F.lit(name)))

    return F.when(
        F.array_contains(names, "[Content_Types].xml"),
        F.when(folder("word/"), ".docx").when(folder("xl/"), ".xlsx").when(folder("ppt/"), ".pptx").otherwise(".docx"),
    )


def sniff_ext(df: DataFrame) -> DataFrame:
    """Type from the first bytes for files that have no suffix; archives are told apart by their folders."""
    content = F.col("content")
    kind = head_kind(content)
    # other contents are not shipped to Python; the directory is the only part of an archive that is read
    names = archives.member_names(F.when(kind.isNull() & F.startswith(content, F.lit(b"PK").cast("binary")), content))
    seen = once(df.select("file_id", "content"), {"kind": kind, "names": names})
    return seen.select("file_id", F.coalesce("kind", members_kind(F.col("names"))).alias("sniffed_ext"))


def file_facts(files: DataFrame) -> DataFrame:
    """Files read by heads and directories -> + sniffed_ext, has_vba_project, embedded_ole_count; no content is read."""
    kind = F.coalesce(head_kind(F.col("head")), members_kind(F.col("members")))
    office = F.when(F.col("ext").isin(*fixed.OFFICE_RULE_EXTS), F.col("members"))
    return files.withColumns({"sniffed_ext": kind, **archive_facts(office)})


def byte_histogram(df: DataFrame) -> DataFrame:
    """(byte, occurrences) over a corpus. Each batch of files is counted into at most 256 rows before the exchange."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            counts = np.zeros(256, dtype=np.int64)
            for content in batch.column(0):
                data = content.as_py()
                if data:
                    counts += np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], names=["byte", "occurrences"]
            )

    small_batches(df)
    binned = df.select("content").mapInArrow(run, "byte int, occurrences bigint")
    return binned.groupBy("byte").agg(F.sum("occurrences").alias("occurrences"))


def check_uploads(df: DataFrame, max_bytes: int) -> DataFrame:
    """(file_id, content) -> size and, for empty and oversized files, the reason of the refusal."""
    size = F.octet_length("content")
    return df.select(
        "file_id",
        size.alias("size_bytes"),
        F.when(size == 0, "empty file").when(size > max_bytes, "file too large").alias("rejected"),
    )
