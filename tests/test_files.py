"""Features, rules and cleaning on real bytes, against plain Python."""

from __future__ import annotations

import hashlib
import io
import json
import math
import re
import zipfile
from collections import Counter

import fixtures as fx
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docwarden.functions import fixed, text
from docwarden.functions.bytes import entropies, byte_entropy, chunk_entropy_p95
from docwarden.functions.vocabulary import prefix_pattern, scrub_terms
from docwarden.operators import archive_clean, features, rules, sanitize
from docwarden.plans.jobs import feature_table, reports, training_columns
from docwarden.sources import archives, heads, pdf_objects


def by_id(df) -> dict:
    return {r["file_id"]: r for r in df.collect()}


def entropy(data: bytes) -> float:
    n = len(data)
    return -sum(c / n * math.log2(c / n) for c in Counter(data).values()) if n else 0.0


@given(st.binary(min_size=1, max_size=3000), st.integers(1, 700))
@settings(max_examples=60, deadline=None)
def test_chunkentropies(data, chunk):
    expected = [entropy(data[i : i + chunk]) for i in range(0, len(data), chunk)]
    assert np.allclose(entropies(data, chunk), expected)


def test_entropies_in_frames(spark):
    data = {i: (".bin", bytes(range(i)) * 50) for i in range(0, 200, 13)}
    got = by_id(
        fx.frame(spark, data).select("file_id", byte_entropy(F.col("content")).alias("h"), chunk_entropy_p95(F.col("content"), 512).alias("p"))
    )
    for i, (_, raw) in data.items():
        assert got[i]["h"] == pytest.approx(entropy(raw))
        chunks = [entropy(raw[k : k + 512]) for k in range(0, len(raw), 512)]
        assert got[i]["p"] == pytest.approx(float(np.percentile(chunks, 95)) if chunks else 0.0)


def test_token_counts_match_bytes_count(spark):
    samples = ["", "streamendstream", "xrefstartxref xref", "ShellPowerShellWScript.Shell", "/EmbeddedFiles/EmbeddedFile", "aaaa"]
    tokens = ["stream", "xref", "Shell", "/EmbeddedFile", "/EmbeddedFiles", "aa"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    for row in df.select("s", *[text.token_count(F.col("s"), t).alias(f"n{i}") for i, t in enumerate(tokens)]).collect():
        assert [row[f"n{i}"] for i in range(len(tokens))] == [row["s"].count(t) for t in tokens]


def test_urls_end_at_any_white_space_or_backslash(spark):
    samples = ["http://a http://b", "HTTPS://x\\http://y", "http://", "ftp://x http://z", "http://a https://b\x0bhttp://c"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    for row in df.select("s", text.url_count(F.col("s")).alias("n")).collect():
        assert row["n"] == len(re.findall(r"https?://[^\s\\]+", row["s"], flags=re.IGNORECASE))


def test_extensions(spark):
    import os.path

    names = ["a.PDF", ".bashrc", "x.tar.gz", "noext", "d.d/file", "..rc", "trail.", "...", "/a/b.c/.h", "a.b ", "é.DOCX", ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for row in df.select("n", text.split_ext(F.col("n")).alias("a"), text.last_dot_ext(F.col("n")).alias("b")).collect():
        assert row["a"] == os.path.splitext(row["n"])[1].lower().strip()
        dot = row["n"].rfind(".")
        assert row["b"] == (row["n"][dot:].lower() if dot != -1 else "")


def test_masks_and_sizes(spark):
    df = spark.createDataFrame([("abcdefghijkl",), ("short",), ('"abcdefghijkl"',), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(text.mask_secret(F.col("s"))).collect()] == ["abcd...ijkl", "****", "abcd...ijkl", "MISSING", "MISSING"]
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (1048576,), (5 * 1024**3,), (2000 * 1024**3,)], "n bigint")
    assert [r[0] for r in sizes.select(text.human_size(F.col("n"))).collect()] == [
        "0.00 B", "1023.00 B", "1.00 KB", "1.50 KB", "1.00 MB", "5.00 GB", "2000.00 GB",
    ]


# ---- features ----------------------------------------------------------------------------------------------


def test_ooxml_features(spark):
    got = by_id(features.ooxml(fx.frame(spark, {k: v for k, v in fx.FILES.items() if k <= 5})))
    assert (got[1]["zip_member_count"], got[1]["url_count"], got[1]["macro_size"]) == (3, 1, 0)
    assert (got[2]["vba_module_count"], got[2]["macro_size"]) == (2, 39)
    assert got[2]["macro_entropy_p95"] == pytest.approx(entropy(b"Attribute VB_Name A Attribute VB_Name B"))
    assert (got[3]["ole_object_count"], got[3]["has_activex"]) == (1, 0)
    assert got[4]["has_activex"] == 1
    assert all(got[5][c] == 0 for c in features.OOXML_COLUMNS)


def test_sniffed_types(spark):
    got = by_id(features.sniff_ext(fx.frame(spark)))
    wanted = {1: ".docx", 3: ".xlsx", 4: ".pptx", 5: None, 6: ".rtf", 7: ".xls", 8: ".pdf", 14: None, 15: None}
    assert {k: got[k]["sniffed_ext"] for k in wanted} == wanted


def test_runtime_meta(spark):
    got = by_id(features.runtime_meta(fx.frame(spark)))
    assert got[2]["has_vba_project"] == 1.0 and got[3]["embedded_ole_count"] == 1.0
    assert got[9]["pdf_has_javascript"] == 1.0 and got[8]["pdf_has_javascript"] == 0.0
    assert got[8]["page_count"] == 2.0  # the page tree counts as well
    assert got[6]["has_embedded_objects"] == 1.0 and got[14]["entropy"] == 0.0


def test_xls_and_rtf(spark):
    x = by_id(features.xls(fx.frame(spark)))
    assert (x[7]["xls_is_ole"], x[7]["xls_has_vba_hint"], x[7]["xls_vba_token_count"]) == (1, 1, 2)
    r = by_id(features.rtf(fx.frame(spark)))
    assert (r[6]["rtf_object_count"], r[6]["rtf_objdata_count"], r[6]["rtf_has_ole_packager_hint"]) == (1, 1, 1)
    assert r[15]["rtf_object_count"] == 0


def test_office_text(spark):
    got = by_id(features.office_text(archives.explode_members(fx.frame(spark))))
    assert got[1]["text"] == "Hello & bye\nagain"
    assert 5 not in got


def test_training_table(spark):
    files = fx.frame(spark).withColumn("label", (F.col("file_id") % 2).cast("int"))
    stored = spark.createDataFrame([(100, 1, 3.5)], "file_id bigint, label int, trojan double")
    table = feature_table(files, stored)
    rows = by_id(table)
    assert len(rows) == len(fx.FILES) + 1
    assert rows[100]["trojan"] == 3.5 and rows[100]["file_size"] == -1 and rows[1]["trojan"] == -1
    assert rows[8]["macro_size"] == -1 and rows[1]["pdf_has_js"] == -1
    assert not {"label", "ext", "file_id", "split"} & set(training_columns(table))


# ---- rules -------------------------------------------------------------------------------------------------


def test_pdf_facts(spark):
    df = pdf_objects.with_pdf_facts(features.with_text(fx.frame(spark)), F.col("ext") == ".pdf", out="f")
    got = {k: r["f"] for k, r in by_id(df).items()}
    assert got[8]["readable"] and got[8]["open_subtype"] == "" and not got[8]["deep"]
    assert got[9]["open_subtype"] == "/JavaScript" and got[9]["deep"]
    assert got[10]["open_subtype"] == "/Launch" and not got[10]["deep"]
    assert got[11]["names_js"] and got[11]["deep"]
    assert not got[12]["readable"] and got[13]["has_objstm"]
    assert got[1] is None and not got[14]["readable"]


def test_late_objects_are_seen(spark):
    many = "".join(f"{i} 0 obj\n<< /N {i} >>\nendobj\n" for i in range(10, 700)) + "900 0 obj\n<< /JS (x) >>\nendobj\n"
    df = fx.frame(spark, {1: (".pdf", fx.pdf("", many))})
    assert "pdf_deep_js" in {f["id"] for f in rules.findings(df).first()["findings"]}


def test_scan(spark):
    got = by_id(rules.scan(fx.frame(spark), with_archives=True))
    ids = {k: [f["id"] for f in r["findings"]] for k, r in got.items()}
    assert ids[1] == [] and got[1]["verdict"] == "benign"
    assert ids[2] == ["office_macro"] and got[2]["verdict"] == "malicious"
    assert ids[3] == ["office_ole"] and got[3]["verdict"] == "benign" and got[3]["risk_score"] == 0.2
    assert ids[6] == ["rtf_exploit"]
    assert ids[9] == ["suspicious_strings", "pdf_js_auto", "pdf_deep_js"] and got[9]["risk_score"] == 1.0
    assert ids[10] == ["suspicious_strings", "pdf_exploit_action"] and got[10]["verdict"] == "malicious"
    assert ids[12] == ["suspicious_strings", "pdf_regex_match"] and got[12]["risk_score"] == pytest.approx(0.8)
    assert got[9]["recommendations"][-1] == fixed.RECOMMENDATIONS[3]
    assert got[2]["recommendations"][-1] == fixed.RECOMMENDATIONS[2]
    assert "(/Launch)" in got[10]["findings"][1]["message"]


def test_entropy_rule_and_limit(spark):
    df = fx.frame(spark, {1: (".bin", bytes(range(256)) * 8)})
    found = rules.scan(df).first()
    assert [f["id"] for f in found["findings"]] == ["high_entropy"]
    assert found["findings"][0]["message"] == "High entropy (8.00) indicates packed/encrypted content."


def test_points_add_up(spark):
    scored = rules.findings(fx.frame(spark))
    for row in scored.collect():
        assert row["points"] == sum(fixed.RULE_POINTS[f["id"]] for f in row["findings"])
        assert row["rule_score"] == min(row["points"] / 100, 1.0)


def test_unreadable_rows_do_not_stop_the_job(spark):
    df = spark.createDataFrame([(1, ".pdf", None), (2, ".pdf", bytearray(fx.PDF_JS))], "file_id bigint, ext string, content binary")
    got = by_id(rules.scan(df))
    assert (got[1]["ok"], got[1]["verdict"], got[1]["risk_score"]) == (False, "benign", 0.0)
    assert got[2]["ok"] and got[2]["verdict"] == "malicious"


# ---- scrubbing ---------------------------------------------------------------------------------------------


def test_vocabulary():
    terms = set(scrub_terms(".pdf"))
    assert len(terms) > 6000 and len(set(scrub_terms(".rtf"))) < len(terms)
    for term in ("PowerShell".lower(), "/javascript()", "\\cmd.exe:", "net_user", "www.payload.ru", "dropper.exe", "beacon.php", "p0wershell"):
        assert (term in terms) == (term != "p0wershell")  # look-alikes are capped, that one comes too late
    assert "beacon.php" not in scrub_terms(".rtf")


@given(st.lists(st.text("ab.", min_size=1, max_size=4), min_size=1, max_size=12), st.text("abAB.x", max_size=30))
@settings(max_examples=200, deadline=None)
def test_prefix_pattern_is_the_longest_first_alternation(terms, value):
    longest_first = "(?i)" + "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    assert re.sub(prefix_pattern(terms), "", value) == re.sub(longest_first, "", value)


def test_scrub_whole_text(spark):
    pattern = re.compile(prefix_pattern(scrub_terms(".pdf")))
    texts = ["run PowerShell.EXE now", "x" * 50_000 + " mshta " + "y" * 50_000, "clean words", "JAVASCRIPT:alert eval("]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(sanitize.scrub(F.col("t"), scrub_terms(".pdf"))).collect()] == [pattern.sub("", t) for t in texts]


def test_rtf_light_and_full(spark):
    df = spark.createDataFrame([(r"{\rtf1 a {\object x \objdata 01} \endobj b {\field{\*\fldinst DDE x}} \pict\shp c}",)], "text string")
    row = sanitize.rtf_full(df).withColumn("light", sanitize.rtf_light(F.col("text"))).first()
    assert "\\object" not in row["light"] and "\\pict" not in row["light"]
    assert row["removed"] == ["ddefield", "object", "pict"]


def test_pdf_strip(spark):
    df = fx.frame(spark).withColumn("text", text.latin1(F.col("content")))
    got = by_id(sanitize.pdf_strip(df))
    assert b"/Launch" not in got[10]["clean"].encode() and got[10]["actions"] == 1
    assert "/JS (" not in got[9]["clean"] and "/S /JavaScript" in got[9]["clean"]
    assert got[9]["removed"] == ["/JS", "/OpenAction"] and (got[9]["js"], got[9]["actions"]) == (1, 1)
    assert got[8]["clean"] == fx.PDF_SAFE.decode() and got[8]["removed"] == []


def test_bad_action_inside_annotation(spark):
    annots = "6 0 obj\n<< /Type /Annot /Rect [0 0 1 1] /A << /Type /Action /S /Launch /F (a) >> /C [1] >>\nendobj\n"
    df = spark.createDataFrame([(fx.pdf("", annots).decode(),)], "text string")
    row = sanitize.pdf_strip(df).first()
    assert row["removed"] == ["/A/Launch"] and "/A <<" not in row["clean"] and "/C [1]" in row["clean"]


def test_ooxml_cleaning(spark):
    df = fx.frame(spark, {k: fx.FILES[k] for k in (1, 2, 3, 5)})
    light = by_id(sanitize.ooxml_clean(df, "light"))
    assert 5 not in light
    assert light[2]["removed"] == ["drop:word/vbaProject.bin"]
    assert light[3]["removed"] == ["drop:xl/embeddings/oleObject1.bin", "rels:xl/_rels/w.rels"]
    members = {m: bytes(b) for m, b in archives._members(light[3]["clean"])}
    assert "xl/embeddings/oleObject1.bin" not in members and b"External" not in members["xl/_rels/w.rels"]
    assert b"officeDocument" in members["xl/_rels/w.rels"]
    full = by_id(sanitize.ooxml_clean(df, "full", scrub_terms(".docx")))
    types = dict(archives._members(full[2]["clean"]))["[Content_Types].xml"]
    assert b"vba" not in types.lower() and b"document.xml" in types


def test_xml_elements_go_with_their_tail(spark):
    xml = b"<w><w:control a='1'/>tail<w:p>keep</w:p><w:object><b/></w:object> t2<x>k</x></w>"
    df = fx.frame(spark, {1: (".docx", fx.archive(**{"word/document.xml": xml}))})
    row = sanitize.ooxml_clean(df, "full").first()
    assert archives._members(row["clean"]) == [("word/document.xml", b"<w><w:p>keep</w:p><x>k</x></w>")] and row["removed"] == ["xml:word/document.xml:2"]


def test_rescan_never_raises_the_risk(spark):
    r = by_id(sanitize.rescan(fx.frame(spark), policy="always", archives_too=True))
    assert len(r) == len(fx.FILES)
    assert all(row["delta_risk"] <= 0 for row in r.values())
    assert r[2]["verdict_after"] == "benign" and r[10]["verdict_after"] == "benign"
    only = by_id(sanitize.rescan(fx.frame(spark), archives_too=True))
    assert not only[1]["changed"] and bytes(only[1]["clean"]) == fx.DOCX_CLEAN


def test_unchanged_files_can_be_marked(spark):
    df = fx.frame(spark, {1: (".pdf", b"abc")})
    assert bytes(df.select(sanitize.mark_unchanged(F.col("content"), F.col("content"))).first()[0]) == b"abc\n% sanitized\n"


def test_scrub_is_idempotent_on_the_corpus(spark, folder):
    from docwarden.sources.corpus import text_corpus

    light = sanitize.rtf_light(F.col("text"))
    c = text_corpus(spark, folder).filter("ext = '.rtf'").select(light.alias("once"))
    c = c.select("once", sanitize.rtf_light(F.col("once")).alias("twice"))
    assert c.filter("once <> twice").isEmpty()


def test_reports(spark):
    got = {r["file_id"]: json.loads(r["report"]) for r in reports(fx.frame(spark), archives_too=True).collect()}
    js = got[9]
    assert js["verdict"] == "malicious" and js["post_clean_scan"]["delta_risk"] < 0
    assert js["original_sha256"] == hashlib.sha256(fx.PDF_JS).hexdigest()
    assert [f["title"] for f in js["findings"]] == ["suspicious_strings", "pdf_js_auto", "pdf_deep_js"]
    assert js["findings"][1]["explain"] == fixed.EXPLANATIONS["javascript"] and js["findings"][1]["raw"]["id"] == "pdf_js_auto"
    assert got[1]["sanitized"] is False and got[1]["signals"]["rules"] == 0.0


def test_sanitized_says_what_a_cleaner_returned(spark):
    def packed(*names: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name in names:
                z.writestr(name, "<x/>")
        return out.getvalue()

    macro = packed("[Content_Types].xml", "word/document.xml", "word/vbaProject.bin")
    df = spark.createDataFrame(
        [(1, ".docm", macro), (2, ".docx", macro[: len(macro) // 2]), (3, ".txt", b"plain"), (4, ".rtf", b"{\\rtf1 x}")],
        "file_id bigint, ext string, content binary",
    )
    got = by_id(sanitize.rescan(df, policy="always"))
    assert (got[1]["engine"], got[1]["sanitized"], got[1]["changed"]) == ("ooxml_purge", True, True)
    assert got[1]["verdict_before"] == "malicious" and got[1]["verdict_after"] == "benign"
    assert [(got[i]["engine"], got[i]["sanitized"]) for i in (2, 3, 4)] == [("passthrough", False), ("passthrough", False), ("rtf_convert", True)]
    notes = by_id(sanitize.sanitize(df.withColumn("verdict", F.lit("malicious"))))
    assert notes[2]["notes"] and notes[3]["notes"] and notes[1]["notes"] is None
    closed = by_id(sanitize.sanitize(df.withColumn("verdict", F.lit("malicious")), archives_too=False))
    assert not closed[1]["sanitized"] and closed[1]["notes"]


def test_contents_reach_python_in_small_batches(spark, tmp_path):
    """Operators on whole contents hold few megabytes of them a worker, whatever the session allows and the rows of a partition."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    body = F.expr("cast(repeat('a', 200000) as binary)")
    df = spark.range(0, 100, 1, 1).select(F.col("id").alias("file_id"), F.lit(".pdf").alias("ext"), body.alias("content"))
    member = df.select("file_id", F.lit(1).alias("pos"), F.lit("a").alias("member"), F.col("content").alias("body"))
    shipped = {
        "dispatch": lambda: features.dispatch(df), "ooxml": lambda: features.ooxml(df), "sniff_ext": lambda: features.sniff_ext(df), "members": lambda: archives.explode_members(df),
        "rebuild": lambda: archives.rebuild_archives(member), "clean": lambda: df.select(archive_clean.cleaned(F.col("content"))), "bytes": lambda: features.byte_histogram(df),
        "write": lambda: heads.write_files(df.select(F.col("file_id").cast("string").alias("path"), "content"), str(tmp_path / "out")),
    }

    def largest(batches):
        sizes = [b.nbytes for b in batches]
        yield pa.RecordBatch.from_arrays([pa.array([max(sizes, default=0)], pa.int64())], names=["n"])

    try:
        for what, build in shipped.items():
            spark.conf.set(name, "64m")
            build()
            assert df.select("content").mapInArrow(largest, "n long").first().n < 5 << 20, what
        spark.conf.unset(name)  # a session that says nothing of it
        features.ooxml(df)
        assert spark.conf.get(name) == "4m"
        for lower in ("64k", "2097152b"):
            spark.conf.set(name, lower)
            features.ooxml(df)
            assert spark.conf.get(name) == lower
    finally:
        spark.conf.set(name, "64m")
