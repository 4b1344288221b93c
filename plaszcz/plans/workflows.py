"""Queries of resolution, markers, grouping, redaction and dictionaries, with DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..functions.spans import SPANS, allow, each, resolve
from ..operators import dictionaries as dic
from ..operators import findings as fnd
from ..operators import redact as red
from .tables import table


def allowlist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments as spans of a text; one segment is on the allowlist."""
    text = F.concat(F.lit("["), F.col("c_mktsegment"), F.lit(" ]"))
    span = F.struct(F.lit("ORGANIZATION").alias("entity_type"), F.lit(1).alias("start"), (F.length("c_mktsegment") + 2).alias("end"), F.lit(0.9).alias("score"), F.lit("x").alias("recognizer"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), text.alias("text"), F.array(span).cast(SPANS).alias("spans"))
    return rows.select("k", F.size(allow(F.col("spans"), F.col("text"), [" Machinery ", "other"])).alias("n"))


def overlap_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as spans of various types that overlap."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("PL_NIP", "ADDRESS", "PERSON", "PHONE_NUMBER")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    start = (F.col("l_partkey") % 40).cast("int")
    span = F.struct(
        kind.alias("entity_type"), start.alias("start"), (start + 3 + F.col("l_linenumber")).cast("int").alias("end"), (F.col("l_linenumber") / 10).alias("score"), F.lit("x").alias("recognizer")
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(span).alias("s"))
    kept = each(lines.withColumnRenamed("l_orderkey", "k"), resolve(F.col("s").cast(SPANS)), "x", "k").withColumnRenamed("x", "s")
    return kept.select("k", F.col("s.entity_type").alias("entity_type"), F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


_OVERLAP_SQL = """
WITH s AS (SELECT l_orderkey AS k, ['PL_NIP', 'ADDRESS', 'PERSON', 'PHONE_NUMBER'][CAST(l_suppkey % 4 + 1 AS INTEGER)] AS entity_type,
                  [100, 60, 40, 75][CAST(l_suppkey % 4 + 1 AS INTEGER)] AS p, CAST(l_partkey % 40 AS INTEGER) AS a,
                  CAST(l_partkey % 40 + 3 + l_linenumber AS INTEGER) AS b FROM lineitem),
l AS (SELECT k, list({'e': entity_type, 'a': a, 'b': b} ORDER BY p DESC, b - a DESC, a) AS spans FROM s GROUP BY k),
r AS (SELECT k, unnest(list_reduce(list_transform(spans, lambda x: [x]), lambda acc, x:
        CASE WHEN len(list_filter(acc, lambda y: y.a < x[1].b AND x[1].a < y.b)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS x FROM l)
SELECT k, x.e AS entity_type, x.a AS span_start, x.b AS span_end FROM r
"""


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings: a customer's orders form a document, the clerk's value has case and space variants."""
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("PL_NIP", "PERSON", "EMAIL_ADDRESS", "CUSTOM")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    raw = F.concat(F.when(F.col("o_orderkey") % 3 == 0, " Val").otherwise("vaL"), (F.col("o_custkey") % 97).cast("string"), F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(""))
    o = table(spark, sf_dir, "orders")
    return o.select(
        (F.col("o_custkey") % 50).alias("doc_id"), F.lit(0).alias("unit_no"), F.col("o_orderkey").cast("int").alias("start"), (F.col("o_orderkey") + 5).cast("int").alias("end"), kinds.alias("entity_type"),
        raw.alias("raw_value"), fn.normal_value(raw).alias("norm_value"), (F.col("o_orderkey") % 10 / 10).alias("score"), F.lit("key").alias("reason"),
    )


_FINDINGS_SQL = """
f AS (SELECT o_custkey % 50 AS doc_id, o_orderkey AS k, ['PL_NIP', 'PERSON', 'EMAIL_ADDRESS', 'CUSTOM'][CAST(o_orderkey % 4 + 1 AS INTEGER)] AS entity_type,
             concat(CASE WHEN o_orderkey % 3 = 0 THEN ' Val' ELSE 'vaL' END, o_custkey % 97, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE '' END) AS raw_value,
             concat('val', o_custkey % 97) AS norm_value, (o_orderkey % 10) / 10 AS score FROM orders),
q AS (SELECT entity_type, norm_value, min((doc_id, k)) AS first FROM f GROUP BY entity_type, norm_value),
n AS (SELECT entity_type, norm_value, row_number() OVER (PARTITION BY entity_type ORDER BY first) AS suffix FROM q),
m AS (SELECT f.*, concat('[', CASE entity_type WHEN 'PL_NIP' THEN 'NIP' WHEN 'PERSON' THEN 'OSOBA' WHEN 'EMAIL_ADDRESS' THEN 'EMAIL' ELSE 'CUSTOM' END, '_', suffix, ']') AS marker
      FROM f JOIN n USING (entity_type, norm_value)),
g AS (SELECT doc_id, entity_type, raw_value, min(k) AS first_k, arg_min(marker, k) AS marker, CAST(max(score) AS DOUBLE) AS score, count(*) AS n FROM m GROUP BY doc_id, entity_type, raw_value),
i AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_k, entity_type, raw_value) AS VARCHAR) AS id FROM g)
"""


def marker_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fnd.assign_markers(_findings(spark, sf_dir)).select("doc_id", F.col("start").cast("long").alias("k"), "entity_type", "marker")


def marker_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with numbers far apart, as hashes are, and one value each."""
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 1_000_003 % 998_244_353).alias("doc_id"), F.lit(0).alias("unit_no"), F.lit(0).alias("start"), F.lit("PL_NIP").alias("entity_type"), F.col("o_orderkey").cast("string").alias("norm_value"))
    return fnd.assign_markers(o).select("doc_id", "norm_value", "marker")


def marker_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fnd.assign_markers(_findings(spark, sf_dir), scope=["doc_id"]).select("doc_id", F.col("start").cast("long").alias("k"), "entity_type", "marker")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fnd.group_findings(fnd.assign_markers(_findings(spark, sf_dir)))


def finding_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).select("doc_id", "entity_type", "raw_value", "marker", "score", F.col("count").alias("n"), F.col("occurrences")[0]["start"].cast("long").alias("first_k"))


def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).select("doc_id", "id", "entity_type", "raw_value")


def signature_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document has as many signatures as its number modulo 3 plus 1."""
    grouped = _groups(spark, sf_dir)
    pages = grouped.select("doc_id").distinct().filter("doc_id % 3 = 0").select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 2).cast("int"))).alias("page"))
    return fnd.signature_groups(pages, grouped).filter("entity_type = 'PDF_SIGNATURE'").select("doc_id", "id", "score", F.col("count").alias("n"))


def _confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In every document the ids that 3 divides are confirmed."""
    grouped = _groups(spark, sf_dir)
    return fnd.confirm(grouped, grouped.filter("CAST(id AS INT) % 3 = 0").select("doc_id", "id"))


def confirm_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confirmed(spark, sf_dir).select("doc_id", "id", "raw_value", "marker")


def redact_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and type are confirmed for every part of a size; names hold them or not."""
    part = table(spark, sf_dir, "part")
    units = part.select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" / ", "p_name", "p_brand", "p_type", "p_brand").alias("text"))
    groups = part.select(F.col("p_partkey").alias("doc_id"), F.lit("1").alias("id"), F.col("p_brand").alias("raw_value"), F.lit("[FIRMA_1]").alias("marker")).filter("p_size % 2 = 0")
    groups = groups.unionByName(part.select(F.col("p_partkey").alias("doc_id"), F.lit("2").alias("id"), F.lit("FIRMA").alias("raw_value"), F.lit("[X_2]").alias("marker")).filter("p_size % 4 = 0"))
    return red.redact_by_value(units, groups).select("doc_id", "redacted")


_REDACT_SQL = """
SELECT p_partkey AS doc_id, CASE WHEN p_size % 4 = 0 THEN replace(r, 'FIRMA', '[X_2]') ELSE r END AS redacted
FROM (SELECT p_partkey, p_size, CASE WHEN p_size % 2 = 0 THEN replace(t, p_brand, '[FIRMA_1]') ELSE t END AS r
      FROM (SELECT *, concat_ws(' / ', p_name, p_brand, p_type, p_brand) AS t FROM part))
"""


def redact_by_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer's name and segment are replaced where they stand, the number between them stays."""
    c = table(spark, sf_dir, "customer").withColumn("n", F.col("c_custkey").cast("string"))
    units = c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("unit_no"), F.concat(F.lit("é "), "c_name", F.lit(": "), "n", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("text"))
    at = F.length("c_name") + F.length("n") + 6
    spans = c.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("unit_no"), F.lit(2).alias("start"), (F.length("c_name") + 2).alias("end"), F.lit("[OSOBA_1]").alias("marker"))
    spans = spans.union(c.filter("c_nationkey % 2 = 0").select("c_custkey", F.lit(0), at, at + F.length("c_mktsegment"), F.lit("[FIRMA_1]")))
    return red.redact_by_span(units, spans).select("doc_id", "redacted")


def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values left after redaction: those of which only the first has been replaced."""
    part = table(spark, sf_dir, "part")
    done = part.select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("[FIRMA_1] "), "p_brand")).otherwise(F.lit("[FIRMA_1]")).alias("redacted"))
    return red.leaks(done, part.select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("raw_value")))


def _name_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lines of a name file: case variants, blanks, damaged values and odd counts."""
    k = F.col("c_custkey")
    value = F.when(k % 11 == 0, "  ").when(k % 13 == 0, F.concat(F.lit("a?"), k.cast("string"))).otherwise(F.concat(F.when(k % 2 == 0, " Imię").otherwise("imię"), (k % 300).cast("string")))
    count = F.when(k % 3 == 0, "n/a").otherwise(k.cast("string"))
    return table(spark, sf_dir, "customer").select((k + 1).cast("int").alias("line_no"), value.alias("value"), count.alias("count"))


def dict_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.build_names(_name_rows(spark, sf_dir)).values.select("line_no", "value", F.col("count").alias("n"))


def dict_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.build_names(_name_rows(spark, sf_dir), "names.csv").rejections.select("file_path", "line_no", "source_value", "reason")


def dict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.build_names(_name_rows(spark, sf_dir)).counts.select("valid", "duplicates", "empty", "rejected")


_NAMES_SQL = """
r AS (SELECT CAST(c_custkey + 1 AS INTEGER) AS line_no, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN concat('A?', c_custkey) ELSE concat('IMIĘ', c_custkey % 300) END AS value,
             CASE WHEN c_custkey % 3 = 0 THEN '0' ELSE CAST(c_custkey AS VARCHAR) END AS n, c_custkey % 11 = 0 AS blank, c_custkey % 11 <> 0 AND c_custkey % 13 = 0 AS damaged FROM customer),
v AS (SELECT min(line_no) AS line_no, value, arg_min(n, line_no) AS n, count(*) AS c FROM r WHERE NOT blank AND NOT damaged GROUP BY value)
"""


def _terc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as rows of the register: the key's remainders fill the codes."""
    k = F.col("s_suppkey")
    filled = lambda test, v: F.when(test, v).otherwise("")
    return table(spark, sf_dir, "supplier").select(
        k.cast("int").alias("line_no"), F.lit("02").alias("woj"), filled(k % 4 > 0, "01").alias("pow"), filled(k % 4 > 1, "03").alias("gmi"), filled(k % 4 > 1, (k % 5 + 1).cast("string")).alias("rodz"),
        F.concat(F.lit(" Nazwa  "), (k % 60).cast("string"), F.when(k % 17 == 0, "?").otherwise("")).alias("nazwa"),
    )


def dict_terc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.build_terc(_terc_rows(spark, sf_dir)).values


def dict_terc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dic.build_terc(_terc_rows(spark, sf_dir)).counts.select("valid", "duplicates", "empty", "rejected")


_TERC_COUNTS_SQL = """
WITH r AS (SELECT CASE k % 4 WHEN 0 THEN 'v' WHEN 1 THEN 'c' ELSE 'g' END AS level, k % 60 AS v FROM (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 17 <> 0) WHERE k % 4 < 2 OR k % 5 < 3)
SELECT (SELECT count(*) FROM (SELECT DISTINCT level, v FROM r)) AS valid, (SELECT count(*) FROM r) - (SELECT count(*) FROM (SELECT DISTINCT level, v FROM r)) AS duplicates,
       CAST(0 AS BIGINT) AS empty, (SELECT count(*) FROM supplier WHERE s_suppkey % 17 = 0) AS rejected
"""


_TERC_SQL = """
WITH r AS (SELECT s_suppkey AS k, concat('nazwa ', s_suppkey % 60) AS v FROM supplier WHERE s_suppkey % 17 <> 0)
SELECT 'voivodeship' AS level, v AS value FROM r WHERE k % 4 = 0
UNION SELECT 'county', v FROM r WHERE k % 4 = 1
UNION SELECT 'commune', v FROM r WHERE k % 4 > 1 AND k % 5 < 3
UNION SELECT 'commune', concat('m.', v) FROM r WHERE k % 4 > 1 AND k % 5 = 0
UNION SELECT 'commune', concat('m. ', v) FROM r WHERE k % 4 > 1 AND k % 5 = 0
"""


def dict_ulic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("line_no"), F.concat(F.lit(" "), "p_brand").alias("nazwa_1"), F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.col("p_type")).alias("nazwa_2")
    )
    return dic.build_streets(rows).values.select("line_no", "value")


def dict_simc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("line_no"), F.concat(F.lit("\t"), "p_type", F.lit("  "), F.col("p_size").cast("string")).alias("value"))
    return dic.build_localities(rows).values.select("line_no", "value")


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value helpers over names made from parts."""
    raw = F.concat(F.lit(" ;"), F.initcap("p_type"), F.lit("\t "), F.col("p_size").cast("string"), F.lit(", "))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", raw.alias("v"), F.concat(F.when(F.col("p_size") % 2 == 0, "./docProps\\").otherwise("word/"), "p_brand").alias("path"))
    head = F.concat(F.lit("a"), F.element_at(F.array(F.lit(";"), F.lit(","), F.lit("\t"), F.lit("")), (F.col("p_size") % 4 + 1).cast("int")), F.lit("b"))
    return p.select(
        F.col("p_partkey").alias("k"), fn.normal_locality(F.col("v")).alias("locality"), fn.normal_line(F.col("v")).alias("line"), fn.normal_value(F.col("v")).alias("norm"),
        fn.package_path(F.col("path")).alias("path"), fn.is_property_part(F.col("path")).alias("is_property"), F.coalesce(fn.delimiter(head), F.lit("none")).alias("delimiter"), fn.suspicious(F.concat("v", F.when(F.col("p_size") > 25, "?").otherwise(""))).alias("bad"),
    )


_TEXT_SQL = r"""
WITH p AS (SELECT p_partkey AS k, p_size, upper(p_type) AS t, lower(p_type) AS l, p_brand FROM part)
SELECT k, concat(t, ' ', p_size) AS locality, concat(';', t, ' ', p_size, ',') AS line, concat(';', l, chr(9), ' ', p_size, ',') AS norm,
       concat(CASE WHEN p_size % 2 = 0 THEN 'docProps/' ELSE 'word/' END, p_brand) AS path, p_size % 2 = 0 AS is_property,
       CASE p_size % 4 WHEN 0 THEN ';' WHEN 1 THEN ',' WHEN 2 THEN chr(9) ELSE 'none' END AS delimiter, p_size > 25 AS bad
FROM p
"""


def shared_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells looked up by (document, index): orders' customers as cells, customers as strings."""
    cells = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 10).alias("doc_id"), F.floor(F.col("o_custkey") / 10).alias("idx"))
    strings = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 10).alias("doc_id"), F.floor(F.col("c_custkey") / 10).alias("idx"), F.col("c_name").alias("value"))
    return cells.join(strings, ["doc_id", "idx"], "left").select("k", "value")


def first_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of a value on its page: an order's lines as places."""
    lines = table(spark, sf_dir, "lineitem")
    hits = lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.lit("v").alias("raw_value"), F.struct("l_linenumber", "l_partkey", "l_quantity").alias("hit_no"), F.struct(F.col("l_quantity").alias("x0")).alias("bbox"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.lit("v").alias("raw_value"))
    return fnd.add_boxes(orders, hits).select("doc_id", F.col("bbox.x0").alias("x0"))


QUERIES = {
    "allowlist_filter": allowlist_filter,
    "overlap_resolve": overlap_resolve,
    "marker_assign": marker_assign,
    "marker_hashed": marker_hashed,
    "marker_by_document": marker_by_document,
    "finding_group": finding_group,
    "finding_ids": finding_ids,
    "signature_finding": signature_finding,
    "confirm_semi": confirm_semi,
    "redact_by_value": redact_by_value,
    "redact_by_span": redact_by_span,
    "leak_check": leak_check,
    "dict_names": dict_names,
    "dict_rejections": dict_rejections,
    "dict_counts": dict_counts,
    "dict_terc": dict_terc,
    "dict_terc_counts": dict_terc_counts,
    "dict_ulic": dict_ulic,
    "dict_simc": dict_simc,
    "text_functions": text_functions,
    "shared_strings": shared_strings,
    "first_box": first_box,
}

ORACLES = {
    "allowlist_filter": "SELECT c_custkey AS k, CAST(CASE WHEN c_mktsegment = 'MACHINERY' THEN 0 ELSE 1 END AS INTEGER) AS n FROM customer",
    "overlap_resolve": _OVERLAP_SQL,
    "marker_assign": f"WITH {_FINDINGS_SQL} SELECT doc_id, k, entity_type, marker FROM m",
    "marker_hashed": """WITH o AS (SELECT o_orderkey * 1000003 % 998244353 AS doc_id, CAST(o_orderkey AS VARCHAR) AS norm_value FROM orders)
        SELECT doc_id, norm_value, concat('[NIP_', row_number() OVER (ORDER BY doc_id, norm_value), ']') AS marker FROM o""",
    "marker_by_document": f"""WITH {_FINDINGS_SQL}, e AS (SELECT doc_id, entity_type, norm_value, min(k) AS first FROM f GROUP BY doc_id, entity_type, norm_value),
        d AS (SELECT doc_id, entity_type, norm_value, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY first) AS s FROM e)
        SELECT doc_id, k, entity_type, concat('[', CASE entity_type WHEN 'PL_NIP' THEN 'NIP' WHEN 'PERSON' THEN 'OSOBA' WHEN 'EMAIL_ADDRESS' THEN 'EMAIL' ELSE 'CUSTOM' END, '_', s, ']') AS marker
        FROM f JOIN d USING (doc_id, entity_type, norm_value)""",
    "finding_group": f"WITH {_FINDINGS_SQL} SELECT doc_id, entity_type, raw_value, marker, score, n, first_k FROM g",
    "finding_ids": f"WITH {_FINDINGS_SQL} SELECT doc_id, id, entity_type, raw_value FROM i",
    "signature_finding": f"WITH {_FINDINGS_SQL} SELECT doc_id, CAST(count(*) + 1 AS VARCHAR) AS id, CAST(1.0 AS DOUBLE) AS score, CAST(doc_id % 2 + 1 AS BIGINT) AS n FROM i WHERE doc_id % 3 = 0 GROUP BY doc_id",
    "confirm_semi": f"WITH {_FINDINGS_SQL} SELECT doc_id, id, raw_value, marker FROM i WHERE CAST(id AS INTEGER) % 3 = 0",
    "redact_by_value": _REDACT_SQL,
    "redact_by_span": "SELECT c_custkey AS doc_id, concat('é [OSOBA_1]: ', c_custkey, ' (', CASE WHEN c_nationkey % 2 = 0 THEN '[FIRMA_1]' ELSE c_mktsegment END, ')') AS redacted FROM customer",
    "leak_check": "SELECT p_partkey AS doc_id, concat('[FIRMA_1] ', p_brand) AS redacted FROM part WHERE p_size % 5 = 0",
    "dict_names": f"WITH {_NAMES_SQL} SELECT line_no, value, n FROM v",
    "dict_rejections": f"WITH {_NAMES_SQL} SELECT 'names.csv' AS file_path, CAST(line_no AS VARCHAR) AS line_no, value AS source_value, '{dic.REASON}' AS reason FROM r WHERE damaged",
    "dict_counts": f"WITH {_NAMES_SQL} SELECT (SELECT count(*) FROM v) AS valid, CAST((SELECT sum(c - 1) FROM v) AS BIGINT) AS duplicates, count(*) FILTER (blank) AS empty, count(*) FILTER (damaged) AS rejected FROM r",
    "dict_terc": _TERC_SQL,
    "dict_terc_counts": _TERC_COUNTS_SQL,
    "dict_ulic": "WITH r AS (SELECT p_partkey, lower(CASE WHEN p_size % 3 = 0 THEN p_brand ELSE concat(p_type, ' ', p_brand) END) AS value FROM part) SELECT CAST(min(p_partkey) AS INTEGER) AS line_no, value FROM r GROUP BY value",
    "dict_simc": "SELECT CAST(min(p_partkey) AS INTEGER) AS line_no, lower(concat(p_type, ' ', p_size)) AS value FROM part GROUP BY p_type, p_size",
    "text_functions": _TEXT_SQL,
    "shared_strings": "SELECT o_orderkey AS k, c_name AS value FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "first_box": "SELECT o_orderkey AS doc_id, arg_min(l_quantity, (l_linenumber, l_partkey, l_quantity)) AS x0 FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
}
