"""Queries on manifests, feature tables, splits, metrics and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docwarden.functions import fixed, text
from docwarden.operators import cell_boosting, cleaning, features, learning, random_trees
from docwarden.plans import sql
from docwarden.plans.registry import query
from docwarden.session import settle, spread
from docwarden.sources import corpus, json_features
from docwarden.sources.tables import table

LABELS = ("1", "TRUE", " malicious ", "Yes", "0", "false", "benign", "no", "unknown")
NAMES = ("a.PDF", ".bashrc", "x.tar.gz", "noext", "dir.d/file", ".hidden.txt", "trail.", "..rc", "v.docx", "w.RTF", "z.xlsx", "y.pptx")


@query(
    "label_norm",
    f"""WITH l AS (SELECT event_id, CASE WHEN event_id % 10 = 9 THEN NULL ELSE {sql.pick(LABELS, 'event_id')} END AS label, value FROM events)
SELECT event_id, CAST(coalesce(lower(trim(label)) IN ('1', 'true', 'malicious', 'yes'), false) AS INTEGER) AS from_text, CAST(trunc(value) AS INTEGER) AS from_number FROM l""",
)
def label_norm(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    word = F.when(F.col("event_id") % 10 != 9, corpus.pick([F.lit(x) for x in LABELS], F.col("event_id")))
    rows = e.select("event_id", word.alias("label"), "value")
    return rows.select("event_id", cleaning.label_value(rows, "label").alias("from_text"), cleaning.label_value(rows, "value").alias("from_number"))


@query(
    "ext_mime",
    f"""WITH n AS (SELECT page_id AS file_id, CASE WHEN page_id % 13 = 12 THEN url ELSE 'd' || page_id || '/' || {sql.pick(NAMES, 'page_id')} END AS name FROM pages),
e AS (SELECT *, lower(CASE WHEN contains(ltrim(parse_filename(name), '.'), '.') THEN '.' || list_extract(string_split(parse_filename(name), '.'), -1) ELSE '' END) AS ext FROM n)
SELECT file_id, ext, lower(CASE WHEN contains(name, '.') THEN '.' || list_extract(string_split(name, '.'), -1) ELSE '' END) AS last_dot_ext,
  CASE ext WHEN '.pdf' THEN 'application/pdf' WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
    WHEN '.pptx' THEN 'application/vnd.openxmlformats-officedocument.presentationml.presentation'
    WHEN '.xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' WHEN '.rtf' THEN 'application/rtf'
    ELSE 'application/octet-stream' END AS mime, ext IN ('.pdf', '.docx', '.xlsx', '.pptx', '.rtf', '.xls') AS supported FROM e""",
)
def ext_mime(spark: SparkSession, folder: str) -> DataFrame:
    """Both suffix rules on planted names and on the page addresses."""
    p = table(spark, folder, "pages")
    planted = F.concat(F.lit("d"), F.col("page_id").cast("string"), F.lit("/"), corpus.pick([F.lit(n) for n in NAMES], F.col("page_id")))
    n = p.select(F.col("page_id").alias("file_id"), F.when(F.col("page_id") % 13 == 12, F.col("url")).otherwise(planted).alias("name"))
    n = n.withColumn("ext", text.split_ext(F.col("name")))
    return n.select(
        "file_id", "ext", text.last_dot_ext(F.col("name")).alias("last_dot_ext"), text.mime_of(F.col("ext")).alias("mime"),
        F.col("ext").isin(*fixed.SUPPORTED_EXTS).alias("supported"),
    )


_HASHED = """{name} AS (SELECT *, CAST(row_number() OVER (PARTITION BY {label} ORDER BY sha256(CAST({id} AS VARCHAR)), {id}) AS DOUBLE)
  / count(*) OVER (PARTITION BY {label}) AS share FROM {source})"""


@query(
    "manifest_norm",
    f"""WITH f AS (SELECT doc_id, '/data/docs/' || doc_id || '.txt' AS file_path, sha256(encode(text)) AS content_sha FROM documents WHERE doc_id % 10 <> 7),
m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN upper(sha256(CAST(doc_id AS VARCHAR))) ELSE 'doc-' || doc_id END AS fid, {sql.pick(LABELS, 'doc_id')} AS label FROM documents),
j AS (SELECT file_path, CASE WHEN length(fid) = 64 THEN lower(fid) ELSE content_sha END AS sha256,
  CAST(lower(trim(label)) IN ('1', 'true', 'malicious', 'yes') AS INTEGER) AS label FROM m JOIN f USING (doc_id)),
{_HASHED.format(name='h', label='label', id='file_path', source='j')}
SELECT sha256, label, file_path, CASE WHEN share <= 0.8 THEN 'train' ELSE 'val' END AS split FROM h""",
)
def manifest_norm(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest with untidy headers, relative paths, some trusted ids and some missing files."""
    d = table(spark, folder, "documents")
    n = F.col("doc_id")
    name = F.concat(n.cast("string"), F.lit(".txt"))
    manifest = d.select(
        F.when(n % 3 == 0, F.upper(F.sha2(n.cast("string"), 256))).otherwise(F.concat(F.lit("doc-"), n.cast("string"))).alias("File ID"),
        F.when(n % 2 == 0, F.concat(F.lit("/data/docs/"), name)).otherwise(F.concat(F.lit("docs/"), name)).alias(" Path "),
        corpus.pick([F.lit(x) for x in LABELS], n).alias("LABEL"),
    )
    files = d.filter(n % 10 != 7).select(F.concat(F.lit("/data/docs/"), name).alias("file_path"), F.encode("text", "UTF-8").alias("content"))
    return cleaning.normalise_manifest(manifest, files, "/data")


def _documents_json(spark: SparkSession, folder: str) -> DataFrame:
    """JSON feature documents made from the events: nested or not, with numbers, texts, booleans and broken ones."""
    e = spread(table(spark, folder, "events"), "event_id")
    n = F.col("event_id")
    inner = F.concat(
        F.regexp_replace("props", r"\}$", ""), F.lit(', "trojan": '), F.format_string("%.2f", F.col("value")),
        F.lit(', "worm": "'), (n % 50).cast("string"), F.lit('", "rootkit": "'), (n % 9).cast("string"), F.lit('.25", "spyware": '),
        F.when(n % 2 == 0, "true").otherwise("false"), F.lit(', "family": "'), F.col("event_type"), F.lit('", "seen": null}'),
    )
    doc = F.when(n % 3 == 0, F.concat(F.lit('{"features": '), inner, F.lit("}"))).when(n % 17 == 5, "{broken").otherwise(inner)
    return e.select(n.alias("file_id"), doc.alias("json"))


_JSON = """docs AS (SELECT event_id AS file_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, round(value, 2) AS trojan, CAST(event_id % 50 AS DOUBLE) AS worm,
  event_id % 9 + 0.25::DOUBLE AS rootkit, CAST(event_id % 2 = 0 AS DOUBLE) AS spyware, event_id % 3 <> 0 AND event_id % 17 = 5 AS broken FROM events)"""


@query(
    "json_features",
    f"""WITH {_JSON}, l AS (SELECT file_id, unnest(['k', 'trojan', 'worm', 'rootkit', 'spyware']) AS name, unnest([k, trojan, worm, rootkit, spyware]) AS value
  FROM docs WHERE NOT broken) SELECT * FROM l""",
)
def json_feature_rows(spark: SparkSession, folder: str) -> DataFrame:
    return json_features.parse_features(_documents_json(spark, folder))


@query(
    "aligned_features",
    f"""WITH {_JSON} SELECT file_id, trojan, -1.0::DOUBLE AS generic, k, -1.0::DOUBLE AS ransomware, spyware FROM docs WHERE NOT broken""",
)
def aligned_features(spark: SparkSession, folder: str) -> DataFrame:
    """Feature documents brought to a model's column order; what no document has is -1."""
    wide = json_features.widen(json_feature_rows(spark, folder), ["k", "trojan", "spyware"], -1.0)
    return cleaning.align(wide, ["trojan", "generic", "k", "ransomware", "spyware"], -1.0)


@query(
    "ragged_union",
    f"""WITH {_JSON}, t AS (SELECT doc_id AS file_id, n_chars FROM documents)
SELECT 'json' AS source, file_id, k, trojan, -1::BIGINT AS n_chars FROM docs WHERE NOT broken UNION ALL SELECT 'office', file_id, -1, -1, n_chars FROM t""",
)
def ragged_union(spark: SparkSession, folder: str) -> DataFrame:
    stored = json_features.widen(json_feature_rows(spark, folder), ["k", "trojan"], -1.0).withColumn("source", F.lit("json"))
    office = table(spark, folder, "documents").select(F.lit("office").alias("source"), F.col("doc_id").alias("file_id"), "n_chars")
    return cleaning.union_ragged([stored, office])


@query(
    "feature_documents",
    """SELECT c_custkey AS file_id, '{"features":{"c_nationkey":' || c_nationkey || '.0,"balance":' || CAST(floor(c_acctbal) AS BIGINT) || '.0}}' AS document FROM customer""",
)
def feature_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as JSON feature documents; texts, the type and the hash are left out."""
    c = table(spark, folder, "customer")
    rows = c.select(
        F.col("c_custkey").alias("file_id"), F.lit("t").alias("type"), F.md5("c_name").alias("hash"), "c_name", "c_nationkey",
        F.floor("c_acctbal").alias("balance"),
    )
    return rows.select("file_id", json_features.to_document(["type", "hash", "c_name", "c_nationkey", "balance"]).alias("document"))


# ---- splits, weights, metrics ------------------------------------------------------------------------------

_SPLIT = _HASHED.format(name="h", label="toxic", id="doc_id", source="labels") + """, split AS (
  SELECT doc_id, toxic, quality, CASE WHEN share <= 0.7 THEN 'train' WHEN share <= 0.85 THEN 'val' ELSE 'test' END AS split FROM h)"""
_SCORED = f"""{_SPLIT}, scored AS (SELECT doc_id, split, toxic AS label,
  ((doc_id * 37 + toxic * 30 + quality * 10) % 101) / 100.0::DOUBLE AS prob FROM split)"""


def _splits(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.split_70_15_15(table(spark, folder, "labels"), "toxic", "doc_id")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    s = _splits(spark, folder)
    prob = ((F.col("doc_id") * 37 + F.col("toxic") * 30 + F.col("quality") * 10) % 101) / F.lit(100.0)
    return s.select("doc_id", "split", F.col("toxic").alias("label"), prob.alias("prob"))


@query("stratified_split", f"WITH {_SPLIT} SELECT doc_id, toxic, split FROM split")
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return _splits(spark, folder).select("doc_id", "toxic", "split")


@query("train_val_union", f"WITH {_SPLIT} SELECT doc_id, toxic, split FROM split WHERE split <> 'test'")
def train_val_union(spark: SparkSession, folder: str) -> DataFrame:
    """Training and validation rows as one table, marked."""
    s = _splits(spark, folder).select("doc_id", "toxic", "split")
    return cleaning.union_splits(s.filter("split = 'train'").drop("split"), s.filter("split = 'val'"))


@query(
    "split_sizes",
    f"""WITH {_SPLIT} SELECT split, toxic, count(*) AS rows, CAST(sum(length(text)) AS BIGINT) AS chars
FROM split JOIN documents USING (doc_id) GROUP BY ALL""",
)
def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Splits attached to the files by id, and their sizes."""
    d = table(spark, folder, "documents").select("doc_id", F.length("text").alias("n"))
    joined = _splits(spark, folder).join(d, "doc_id")
    return joined.groupBy("split", "toxic").agg(F.count("*").alias("rows"), F.sum("n").alias("chars"))


@query(
    "balanced_sample",
    """WITH n AS (SELECT least(min(c), 2000) AS n FROM (SELECT count(*) AS c FROM labels GROUP BY toxic)),
r AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM labels)
SELECT doc_id, toxic FROM r, n WHERE k <= n""",
)
def balanced_sample(spark: SparkSession, folder: str) -> DataFrame:
    return learning.balanced_sample(table(spark, folder, "labels").select("doc_id", "toxic"), "toxic", "doc_id")


@query(
    "class_weights",
    """SELECT toxic, count(*) AS rows, (SELECT count(*) FROM labels)::DOUBLE / ((SELECT count(DISTINCT toxic) FROM labels) * count(*)) AS weight FROM labels GROUP BY toxic""",
)
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    return learning.class_weights(table(spark, folder, "labels"), "toxic")


@query(
    "eval_metrics",
    f"""WITH {_SCORED}, c AS (SELECT split, count(*) FILTER (prob >= 0.5 AND label = 1) AS tp, count(*) FILTER (prob >= 0.5 AND label = 0) AS fp,
  count(*) FILTER (prob < 0.5 AND label = 1) AS fn, count(*) FILTER (prob < 0.5 AND label = 0) AS tn,
  round(avg(CASE WHEN label = 1 THEN -ln(greatest(prob, 1e-15)) ELSE -ln(1 - least(prob, 1 - 1e-15)) END), 6) AS log_loss FROM scored GROUP BY split)
SELECT *, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 9) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision,
  round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c""",
)
def eval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    m = learning.metrics(_scored(spark, folder), ["split"])
    return m.withColumns({**{c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")}, "log_loss": F.round("log_loss", 6)})


@query(
    "roc_auc",
    f"""WITH {_SCORED}, r AS (SELECT split, label, rank() OVER w + (count(*) OVER (PARTITION BY split, prob) - 1) / 2.0::DOUBLE AS rk
  FROM scored WINDOW w AS (PARTITION BY split ORDER BY prob)),
a AS (SELECT split, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives, sum(rk) FILTER (label = 1) AS s FROM r GROUP BY split)
SELECT split, positives, negatives, round((s - positives * (positives + 1) / 2.0::DOUBLE) / (positives * negatives), 9) AS roc_auc FROM a""",
)
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    a = learning.roc_auc(_scored(spark, folder), ["split"])
    return a.withColumn("roc_auc", F.round("roc_auc", 9))


HEAD_WEIGHTS = tuple(((i * 7) % 11 - 5) / 10 for i in range(64))


@query(
    "linear_head",
    f"""SELECT vec_id, round(1 / (1 + exp(-(0.1 + list_dot_product(CAST(embedding AS DOUBLE[]), {list(HEAD_WEIGHTS)}::DOUBLE[])))), 6) AS prob,
  CAST(label >= 5 AS INTEGER) AS label FROM embeddings""",
)
def linear_head(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    prob = learning.linear_prob(F.col("embedding"), HEAD_WEIGHTS, 0.1)
    return e.select("vec_id", F.round(prob, 6).alias("prob"), (F.col("label") >= 5).cast("int").alias("label"))


MODEL_COLUMNS = ("file_size", "entropy_p95", "suspicious_token_count", "url_count_general", "pdf_object_count", "rtf_object_count")


def labelled_features(spark: SparkSession, folder: str) -> DataFrame:
    """Feature rows of the labelled documents with their split; written once, because models read it many times."""
    f = features.dispatch(corpus.text_corpus(spark, folder)).na.fill(-1)
    rows = f.select(F.col("file_id").alias("doc_id"), *MODEL_COLUMNS).join(_splits(spark, folder), "doc_id")
    return settle(rows.withColumnRenamed("toxic", "label"))


@query("gbt_score")
def gbt_score(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees on the training split, all 2,000 rounds, calibrated on the validation split, scores of all rows."""
    rows = labelled_features(spark, folder)
    train = rows.filter("split = 'train'")
    model = cell_boosting.fit(learning.with_class_weight(train, "label"), MODEL_COLUMNS)
    if model is None:
        scored = learning.score(learning.fit_boosted(train, MODEL_COLUMNS), rows)
    else:
        scored = cell_boosting.score(model, rows, MODEL_COLUMNS)
    calibration = learning.fit_calibration(scored.filter("split = 'val'"))
    return learning.calibrated(calibration, scored).select("doc_id", "split", "label", "prob", "calibrated_prob")


@query("rf_score")
def rf_score(spark: SparkSession, folder: str) -> DataFrame:
    """A random forest, calibrated on the validation split, blended with extremely randomised trees."""
    from docwarden.operators.ensemble import tree_prob_weighted

    rows = labelled_features(spark, folder)
    train = rows.filter("split = 'train'")
    forest = settle(learning.score(learning.fit_forest(train, MODEL_COLUMNS), rows))
    known = learning.calibrated(learning.fit_calibration(forest.filter("split = 'val'")), forest)
    nodes = random_trees.grow(learning.with_class_weight(train, "label"), MODEL_COLUMNS)
    extra = random_trees.score(nodes, rows, MODEL_COLUMNS, "doc_id", "et_prob")
    both = known.withColumnsRenamed({"prob": "rf_prob", "calibrated_prob": "rf_calibrated"}).join(extra, "doc_id")
    return both.select(
        "doc_id", "split", "label", "rf_prob", "rf_calibrated", "et_prob", tree_prob_weighted(F.col("rf_calibrated"), F.col("et_prob")).alias("tree_blend")
    )


@query("head_score")
def head_score(spark: SparkSession, folder: str) -> DataFrame:
    """Linear head fitted on the stored vectors."""
    e = table(spark, folder, "embeddings").withColumn("label", (F.col("label") >= 5).cast("int"))
    return learning.score_head(learning.fit_head(e), e).select("vec_id", "label", "prob")
