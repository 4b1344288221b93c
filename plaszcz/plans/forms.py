"""Queries over texts with several matches, other forms of numbers and names, gaps at their limits, and made packages.

As in identifiers, the text is made from keys, and the SQL knows where it put what.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import each
from ..operators import recognizers as rec
from ..operators.detect import detect
from ..operators.lexicon import address_spans
from ..sources.config import Rules
from ..sources.ooxml import document_units
from .identifiers import _NIP, _NIP_SQL, _REGON14, _REGON14_SQL, _TEL, _TEL_SQL, _found, digits, digits_sql, nip_sql, regon9_sql, regon14_sql
from .tables import table

_OTHER, _OTHER_SQL = digits(104723, 10), digits_sql(104723, 10)


def _cut(made: str, sizes: tuple[int, ...], between: str) -> list[str]:
    """The digits in pieces, with something between."""
    out, at = [], 1
    for n in sizes:
        out += [f"substr({made}, {at}, {n})", f"'{between}'"]
        at += n
    return out[:-1]


_TWO_NIPS = f"concat({', '.join([*_cut(_NIP, (3, 3, 2, 2), '-'), repr(' i '), *_cut(_OTHER, (3, 2, 2, 3), ' ')])})"
_TWO_NIPS_SQL = f"""
SELECT o_orderkey AS k, 'PL_NIP' AS entity_type, CAST(0 AS INTEGER) AS span_start, CAST(13 AS INTEGER) AS span_end, CAST(0.8 AS DOUBLE) AS score FROM orders WHERE {nip_sql(_NIP_SQL)}
UNION ALL SELECT o_orderkey, 'PL_NIP', 16, 29, CAST(0.8 AS DOUBLE) FROM orders WHERE {nip_sql(_OTHER_SQL)}
"""

_LONG_REGON = f"concat(if(k % 2 = 0, 'REGON ', 'Rejestr podmiotów '), {_REGON14})"
_LONG_REGON_SQL = f"""
WITH t AS (SELECT o_orderkey AS k, {_REGON14_SQL} AS v, CASE WHEN o_orderkey % 2 = 0 THEN 6 ELSE 18 END AS a FROM orders)
SELECT k, 'PL_REGON' AS entity_type, CAST(a AS INTEGER) AS span_start, CAST(a + 14 AS INTEGER) AS span_end, CAST(0.99 AS DOUBLE) AS score FROM t WHERE {regon14_sql("v")}
"""

_LINES = "if(k % 2 = 0, concat('Alfa', CAST(k AS STRING), '\\nBeta sp. z o.o. x'), concat('Start\\nAlfa', CAST(k AS STRING), '\\nBeta S.A.'))"
_LINES_SQL = """
SELECT o_orderkey AS k, 'ORGANIZATION' AS entity_type, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 6 END AS INTEGER) AS span_start,
       CAST(20 + length(CAST(o_orderkey AS VARCHAR)) AS INTEGER) AS span_end, CAST(0.92 AS DOUBLE) AS score FROM orders
"""

_PHONES = f"""CASE k % 3 WHEN 0 THEN concat('telefon ', {', '.join(_cut(_TEL, (2, 3, 2, 2), ' '))}) WHEN 1 THEN concat('numer ', {', '.join(_cut(_TEL, (2, 3, 2, 2), '.'))})
    ELSE concat('x +48 ', {', '.join(_cut(_TEL, (3, 3, 3), ' '))}, ' x') END"""
_PHONES_SQL = f"""
WITH t AS (SELECT o_orderkey AS k, {_TEL_SQL} AS v FROM orders)
SELECT k, 'PHONE_NUMBER' AS entity_type, CAST(CASE k % 3 WHEN 0 THEN 8 ELSE 2 END AS INTEGER) AS span_start, CAST(CASE k % 3 WHEN 0 THEN 20 ELSE 18 END AS INTEGER) AS span_end,
       CAST(CASE k % 3 WHEN 0 THEN 0.85 ELSE 0.95 END AS DOUBLE) AS score FROM t WHERE k % 3 = 2 OR k % 3 = 0 AND NOT {regon9_sql("v")}
"""

_GAPS = f"""concat('al. Testowa ', CAST(k % 200 + 1 AS STRING), repeat(',', CAST(40 + k % 2 AS INT)), '00-', {digits(7, 3)}, ' Warszawa; x rondo Inne 7, 00-002 Warszawa')"""
_GAPS_SQL = """
WITH t AS (SELECT o_orderkey AS k, 12 + length(CAST(o_orderkey % 200 + 1 AS VARCHAR)) AS s, 40 + o_orderkey % 2 AS g FROM orders),
a AS (SELECT k, 0 AS a, s + g + 15 AS b, 0.97 AS score FROM t WHERE g = 40
      UNION ALL SELECT k, 0, s, 0.78 FROM t WHERE g = 41
      UNION ALL SELECT k, s + g, s + g + 15, 0.82 FROM t WHERE g = 41
      UNION ALL SELECT k, s + g + 19, s + g + 48, 0.97 FROM t)
SELECT k, 'ADDRESS' AS entity_type, CAST(a AS INTEGER) AS span_start, CAST(b AS INTEGER) AS span_end, CAST(score AS DOUBLE) AS score FROM a
"""


def detect_teryt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five levels of the register through detect(): nations as counties, segments as communes, regions as streets."""
    nation, region, customer = (table(spark, sf_dir, n) for n in ("nation", "region", "customer"))
    counties = frozenset(r[0].upper() for r in nation.select("n_name").collect())  # 25 rows and 5 at any scale
    streets = frozenset(r[0].upper() for r in region.select("r_name").collect())
    communes = frozenset(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
    rules = Rules(counties=counties, communes=communes, streets=streets, localities=frozenset(("PARYŻ",)))
    lines = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat_ws("\n", F.lit("Mazowieckie"), F.initcap("n_name"), F.lit("ulica:"), F.lower("r_name"), F.initcap("c_mktsegment"), F.lit(" Paryż "))
    found = detect(lines.select(F.col("c_custkey").alias("k"), text.alias("text")), rules=rules, entity_types=["ADDRESS"])
    return each(found, "spans", "s", "k").select("k", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.score").alias("score"))


_TERYT_SQL = """
WITH t AS (SELECT c_custkey AS k, length(n_name) AS n, length(r_name) AS r, length(c_mktsegment) AS c
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
a AS (SELECT k, 0 AS a, 11 AS b, 0.96 AS score FROM t UNION ALL SELECT k, 12, 12 + n, 0.94 FROM t UNION ALL SELECT k, 20 + n, 20 + n + r, 0.95 FROM t
      UNION ALL SELECT k, 21 + n + r, 21 + n + r + c, 0.92 FROM t UNION ALL SELECT k, 23 + n + r + c, 28 + n + r + c, 0.82 FROM t)
SELECT k, CAST(a AS INTEGER) AS span_start, CAST(b AS INTEGER) AS span_end, CAST(score AS DOUBLE) AS score FROM a
"""


def _package(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _document(text: str = "tekst", **more: str | bytes) -> bytes:
    body = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:body></w:document>'
    return _package({"[Content_Types].xml": "<Types>wordprocessingml</Types>", "word/document.xml": body} | {k.replace("__", "/"): v for k, v in more.items()})


def package_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of made packages, one of each kind a region: read, refused, or read with a warning."""
    sound = _document()
    at = sound.index(b"word/document.xml") + 20
    declared = '<?xml version="1.0" encoding="UTF-16"?><!DOCTYPE x [<!ENTITY e "v">]><x>&e;</x>'.encode("utf-16")
    kinds = [
        ("sound.docx", sound), ("no-package.docx", b"text"), ("none.docx", None), ("old.doc", sound), ("broken-part.docx", sound[:at] + b"\xff\xff\xff" + sound[at + 3 :]),
        ("entities.docx", _package({"[Content_Types].xml": "wordprocessingml", "word/document.xml": declared})), ("climbs.docx", _package({"../x": "y"})), ("bomb.docx", _document(x="A" * 2_000_000)),
        ("encrypted.docx", _document(EncryptionInfo="x")), ("embedded.docx", _document(**{"word__embeddings__a.bin": "x"})), ("many.docx", _package({str(i): "" for i in range(501)})),
    ]
    each_kind = F.explode(F.array(*[F.struct(F.lit(n).alias("path"), F.lit(bytearray(b) if b is not None else None).cast("binary").alias("content")) for n, b in kinds]))
    rows = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), each_kind.alias("f")).select("doc_id", "f.*")
    units = document_units(rows)
    return units.groupBy("doc_id", "path").agg(F.count("text").alias("units"), F.max(F.col("error").isNotNull()).alias("refused"), F.max(F.size(F.coalesce("warnings", F.array().cast("array<string>")))).alias("warnings"))


_STATUS_SQL = """
SELECT CAST(r_regionkey AS BIGINT) AS doc_id, path, CAST(units AS BIGINT) AS units, units = 0 AS refused, CAST(warnings AS INTEGER) AS warnings
FROM region, (VALUES ('sound.docx', 1, 0), ('no-package.docx', 0, 0), ('none.docx', 0, 0), ('old.doc', 0, 0), ('broken-part.docx', 0, 0), ('entities.docx', 0, 0),
  ('climbs.docx', 0, 0), ('bomb.docx', 0, 0), ('encrypted.docx', 0, 0), ('embedded.docx', 1, 1), ('many.docx', 0, 0)) AS t(path, units, warnings)
"""

QUERIES = {
    "rec_nip_forms": _found(_TWO_NIPS, rec.nip),
    "rec_regon_long": _found(_LONG_REGON, rec.regon),
    "rec_org_lines": _found(_LINES, lambda t: rec.organization(t, Rules().legal_forms)),
    "rec_phone_forms": _found(_PHONES, rec.phone),
    "rec_address_gaps": _found(_GAPS, lambda t: address_spans(t, Rules(localities=frozenset(("WARSZAWA",))))),
    "detect_teryt": detect_teryt,
    "package_status": package_status,
}

ORACLES = {
    "rec_nip_forms": _TWO_NIPS_SQL,
    "rec_regon_long": _LONG_REGON_SQL,
    "rec_org_lines": _LINES_SQL,
    "rec_phone_forms": _PHONES_SQL,
    "rec_address_gaps": _GAPS_SQL,
    "detect_teryt": _TERYT_SQL,
    "package_status": _STATUS_SQL,
}
