"""Queries of checksums, context and recognizers over text made from integer keys, with DuckDB counterparts.

The test tables hold next to no Polish identifiers, so each query writes its text from the
keys of orders. The SQL knows where it put what and computes the expected result by
arithmetic, without regular expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums as chk
from ..functions.spans import each
from ..functions.text import near
from ..operators import recognizers as rec
from ..sources.config import PLATE_PREFIXES, Rules
from .tables import spread, table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c")))


def digits(factor: int, n: int, offset: int = 0) -> str:
    """Spark SQL of n digits made from the key."""
    return f"lpad(CAST((k * {factor} + {offset}) % {10**n} AS STRING), {n}, '0')"


def digits_sql(factor: int, n: int, offset: int = 0) -> str:
    return f"lpad(CAST((o_orderkey * {factor} + {offset}) % {10**n} AS VARCHAR), {n}, '0')"


def _sum_sql(s: str, weights: tuple[int, ...]) -> str:
    return "(" + " + ".join(f"{w} * CAST(substr({s}, {i}, 1) AS INTEGER)" for i, w in enumerate(weights, 1)) + ")"


def nip_sql(s: str) -> str:
    return f"({_sum_sql(s, chk.NIP_WEIGHTS)} % 11 = CAST(substr({s}, 10, 1) AS INTEGER))"


def regon9_sql(s: str) -> str:
    return f"({_sum_sql(s, chk.REGON9_WEIGHTS)} % 11 % 10 = CAST(substr({s}, 9, 1) AS INTEGER))"


def regon14_sql(s: str) -> str:
    return f"({regon9_sql(s)} AND {_sum_sql(s, chk.REGON14_WEIGHTS)} % 11 % 10 = CAST(substr({s}, 14, 1) AS INTEGER))"


def pesel_sql(s: str) -> str:
    return f"((10 - {_sum_sql(s, chk.PESEL_WEIGHTS)} % 10) % 10 = CAST(substr({s}, 11, 1) AS INTEGER))"


def nrb_sql(s: str) -> str:
    return f"(CAST(concat(substr({s}, 3, 24), '2521', substr({s}, 1, 2)) AS HUGEINT) % 97 = 1)"


def _letters(n: int) -> str:
    return "concat(" + ", ".join(f"char(65 + (k div {26**i}) % 26)" for i in range(n)) + ")"


def _letters_sql(n: int) -> str:
    return "concat(" + ", ".join(f"chr(CAST(65 + (o_orderkey // {26**i}) % 26 AS INTEGER))" for i in range(n)) + ")"


def _id_card_sql(s: str) -> str:
    parts = [f"{w} * (ascii(substr({s}, {i}, 1)) - {55 if i < 4 else 48})" for i, w in enumerate(chk.ID_CARD_WEIGHTS, 1)]
    return "((" + " + ".join(parts) + ") % 10 = 0)"


# Numbers with a right check digit for a share of the keys; the others fail.
_NIP, _NIP_SQL = digits(7919, 10), digits_sql(7919, 10)
_PESEL, _PESEL_SQL = digits(104729, 11, 10**10), digits_sql(104729, 11, 10**10)
_REGON, _REGON_SQL = digits(1299709, 9), digits_sql(1299709, 9)
_REGON14 = f"concat({_REGON}, {digits(611953, 5)})"
_REGON14_SQL = f"concat({_REGON_SQL}, {digits_sql(611953, 5)})"
_NRB = f"concat({digits(15485863, 9, 10**8)}, {digits(32452843, 9)}, {digits(49979687, 8)})"
_NRB_SQL = f"concat({digits_sql(15485863, 9, 10**8)}, {digits_sql(32452843, 9)}, {digits_sql(49979687, 8)})"
_CARD, _CARD_SQL = f"concat({_letters(3)}, {digits(7919, 6)})", f"concat({_letters_sql(3)}, {digits_sql(7919, 6)})"


def _check(made: str, valid) -> object:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _orders(spark, sf_dir).select("k", F.expr(made).alias("value")).select("k", "value", valid(F.col("value")).alias("valid"))

    return run


def _check_sql(made: str, valid) -> str:
    return f"WITH t AS (SELECT o_orderkey AS k, {made} AS value FROM orders) SELECT k, value, {valid('value')} AS valid FROM t"


def _found(text: str, find) -> object:
    """Rows (k, entity_type, start, end, score) of a recognizer over a text made from the key."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = _orders(spark, sf_dir).select("k", "c", F.expr(text).alias("text"))
        return each(made, find(F.col("text")), "s", "k").select(
            "k", F.col("s.entity_type").alias("entity_type"), F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.score").alias("score")
        )

    return run


def _found_sql(kind: str, start: str, end: str, score: str, where: str, made: str = "''") -> str:
    return (
        f"WITH t AS (SELECT o_orderkey AS k, o_custkey AS c, {made} AS v FROM orders) "
        f"SELECT k, '{kind}' AS entity_type, CAST({start} AS INTEGER) AS span_start, CAST({end} AS INTEGER) AS span_end, CAST({score} AS DOUBLE) AS score FROM t WHERE {where}"
    )


def ctx_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword stands before k mod 260 characters and the match; the window reaches 200 back."""
    text = f"concat('Nip ', repeat('x', CAST(k % 260 AS INT)), ' ', {_NIP})"
    made = _orders(spark, sf_dir).select("k", F.expr(text).alias("text"), F.expr("CAST(k % 260 + 5 AS INT)").alias("position"))
    return made.select("k", "position", near(F.col("text"), F.col("position"), ("nip",), 200).alias("near"))


_PREFIX2 = sorted(p for p in PLATE_PREFIXES if len(p) == 2)
_PLATE = "element_at(array(" + ", ".join(f"'{p}'" for p in _PREFIX2) + f"), CAST(k % {len(_PREFIX2)} AS INT) + 1)"
_RULES = Rules(localities=frozenset(("WARSZAWA", "NOWY SĄCZ")))


def _address(text: Column) -> Column:
    from ..operators.lexicon import address_spans

    return address_spans(text, _RULES)


_HOUSE = "CAST(k % 200 + 1 AS STRING)"
_POSTAL = f"concat('00-', {digits(7, 3)}, ' ', if(k % 3 = 0, 'Warszawa', 'Nowy Sącz'))"
_ADDRESS = f"""CASE k % 4 WHEN 0 THEN concat('al. Testowa ', {_HOUSE}, ', ', {_POSTAL}) WHEN 1 THEN concat({_POSTAL}, '\\nplac Wolności ', {_HOUSE})
    WHEN 2 THEN concat('Adres siedziby: ul. Prosta ', {_HOUSE}, ' x') ELSE concat('ul. Prosta ', {_HOUSE}, ' bez adresu') END"""
_ADDRESS_SQL = """
WITH t AS (SELECT o_orderkey AS k, length(CAST(o_orderkey % 200 + 1 AS VARCHAR)) AS h,
                  CASE WHEN o_orderkey % 3 = 0 THEN 8 ELSE 9 END AS city FROM orders)
SELECT k, 'ADDRESS' AS entity_type, CAST(CASE WHEN k % 4 = 2 THEN 16 ELSE 0 END AS INTEGER) AS span_start,
       CAST(CASE k % 4 WHEN 0 THEN 12 + h + 2 + 6 + 1 + city WHEN 1 THEN 6 + 1 + city + 1 + 14 + h ELSE 16 + 11 + h END AS INTEGER) AS span_end,
       CAST(CASE WHEN k % 4 = 2 THEN 0.92 ELSE 0.97 END AS DOUBLE) AS score
FROM t WHERE k % 4 <> 3
"""

_FIRST, _LAST = ("JAN", "ANNA", "EWA", "PIOTR"), ("NOWAK", "KOWALSKA", "LIS-NOWAK")
_PEOPLE = Rules(first_names=frozenset(_FIRST), surnames=frozenset(_LAST))
_PERSON = """concat('umowa ', element_at(array('Jan', 'Anna', 'Ewa', 'Piotr', 'Robot'), CAST(k % 5 AS INT) + 1), CASE k % 7 WHEN 0 THEN ', ' WHEN 1 THEN ' Maria ' ELSE ' ' END,
    element_at(array('Nowak', 'Kowalska', 'Lis-Nowak', 'Nieznany'), CAST(c % 4 AS INT) + 1), ' dnia')"""


def rec_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.lexicon import person_spans

    made = _orders(spark, sf_dir).select("k", F.expr(_PERSON).alias("text"))
    return each(made, person_spans(F.col("text"), _PEOPLE), "s", "k").select(
        "k", F.col("s.entity_type").alias("entity_type"), F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.col("s.score").alias("score")
    )


_PERSON_SQL = """
WITH t AS (SELECT o_orderkey AS k, o_orderkey % 5 AS f, o_custkey % 4 AS l, o_orderkey % 7 AS g FROM orders),
u AS (SELECT k, f, l, g, CASE f WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 5 ELSE 5 END AS fn,
             CASE l WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 2 THEN 9 ELSE 8 END AS ln, CASE WHEN g = 1 THEN 7 ELSE 1 END AS gap FROM t)
SELECT k, 'PERSON' AS entity_type, CAST(6 AS INTEGER) AS span_start, CAST(6 + fn + gap + ln AS INTEGER) AS span_end, CAST(0.7 AS DOUBLE) AS score
FROM u WHERE f < 4 AND l < 3 AND g <> 0
"""


def rec_teryt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines that name a nation, with the nations as counties and the regions as streets."""
    from ..operators.lexicon import match_lines

    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    customer = table(spark, sf_dir, "customer")
    dictionary = nation.select(F.lit("county").alias("level"), F.lower("n_name").alias("name")).union(region.select(F.lit("street"), F.col("r_name")))
    lines = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.col("c_name"), F.lit("\n  "), F.initcap("n_name"), F.lit(" \r\nUlica:\n"), F.lower("r_name"), F.lit("\n"), F.col("r_name"), F.lit(" x"))
    return match_lines(lines.select(F.col("c_custkey").alias("k"), text.alias("text")), dictionary).select(
        "k", F.col("start").alias("span_start"), F.col("end").cast("int").alias("span_end"), "score"
    )


_TERYT_SQL = """
WITH t AS (SELECT c_custkey AS k, length(c_name) AS c, length(n_name) AS n, length(r_name) AS r
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT k, CAST(c + 3 AS INTEGER) AS span_start, CAST(c + 3 + n AS INTEGER) AS span_end, CAST(0.94 AS DOUBLE) AS score FROM t
UNION ALL
SELECT k, CAST(c + 3 + n + 3 + 7 AS INTEGER), CAST(c + 3 + n + 3 + 7 + r AS INTEGER), CAST(0.95 AS DOUBLE) FROM t
"""


def rec_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses of the documents: found, resolved, grouped."""
    from ..operators.detect import detect
    from ..operators.findings import explode_findings

    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("unit_no"), "text").filter(F.contains("text", F.lit("@")))
    found = explode_findings(detect(docs, entity_types=["EMAIL_ADDRESS"]))
    return found.groupBy("doc_id", "entity_type", "raw_value").agg(F.count("*").alias("n"), F.max("score").alias("score"))


_EMAIL_SQL = r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|[^\pL\pN_.+\-])([A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,63})', 1)) AS raw_value FROM documents)
SELECT doc_id, 'EMAIL_ADDRESS' AS entity_type, raw_value, count(*) AS n, CAST(0.98 AS DOUBLE) AS score FROM m GROUP BY ALL
"""


def detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recognizers over all documents, resolved: spans by type and score."""
    from ..operators.detect import detect

    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = each(detect(docs), "spans", "s", "doc_id").select("doc_id", "s.*")
    return spans.select("doc_id", "entity_type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "score")


def _marked(pattern: str, before: str, after: str = "") -> str:
    """SQL of a text with marks around the matches; RE2 cannot look around, so a match's neighbours are put back.

    The second pass finds matches whose neighbour the first one took for the match before.
    """
    once = lambda text: f"regexp_replace({text}, '({before}|^)({pattern})({after or ''})', concat('\\1', chr(57344), '\\2', chr(57344), '\\3'), 'g')"
    return once(once("text")) if after else once("text")


def _near_sql(words: tuple[str, ...], window: int) -> str:
    part = f"lower(substr(text, greatest(a - {window}, 0) + 1, a + {window} - greatest(a - {window}, 0)))"
    return "(" + " OR ".join(f"contains({part}, '{w}')" for w in words) + ")"


# Of all types, the test tables' raw texts hold e-mail addresses and ten digits; others would be missing here.
_DETECT_SQL = rf"""
WITH m AS (
  SELECT doc_id, text, 'EMAIL_ADDRESS' AS kind, {_marked("[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,63}", "[^\\pL\\pN_.+\\-]")} AS marked FROM documents WHERE contains(text, '@')
  UNION ALL SELECT doc_id, text, 'PL_NIP', {_marked("[0-9](?:[\\s\\-]?[0-9]){9}", "[^\\p{Nd}\\x{E000}]", "$|[^\\p{Nd}]")} FROM documents
  UNION ALL SELECT doc_id, text, 'PL_KRS', {_marked("[0-9](?:[ \\t\\-]?[0-9]){9}", "[^\\p{Nd}\\x{E000}]", "$|[^\\p{Nd}]")} FROM documents),
p AS (SELECT doc_id, text, kind, string_split(marked, chr(57344)) AS parts FROM m WHERE contains(marked, chr(57344))),
i AS (SELECT doc_id, text, kind, parts, unnest(range(2, len(parts), 2)) AS n FROM p),
s AS (SELECT doc_id, text, kind, parts[n] AS raw, regexp_replace(parts[n], '[\s\-]', '', 'g') AS v, CAST(coalesce(list_sum(list_transform(parts[1:n - 1], lambda x: length(x))), 0) AS INTEGER) AS a FROM i),
r AS (SELECT doc_id, kind AS entity_type, a AS span_start, a + CAST(length(raw) AS INTEGER) AS span_end, CAST(CASE kind
    WHEN 'EMAIL_ADDRESS' THEN 0.98
    WHEN 'PL_NIP' THEN CASE WHEN {nip_sql("v")} THEN CASE WHEN {_near_sql(("nip", "n.i.p.", "numer identyfikacji podatkowej"), 200)} THEN 0.99 ELSE 0.8 END END
    ELSE CASE WHEN {nip_sql("v")} THEN NULL WHEN {_near_sql(("krs", "rejestr sądowy"), 300)} THEN 0.98 WHEN v[1] = '0' THEN 0.8 END END AS DOUBLE) AS score
  FROM (SELECT * EXCLUDE v, CASE WHEN kind = 'EMAIL_ADDRESS' THEN '0000000000' ELSE v END AS v FROM s))
SELECT * FROM r WHERE score IS NOT NULL AND NOT (entity_type = 'EMAIL_ADDRESS' AND EXISTS (
  SELECT 1 FROM r AS o WHERE o.doc_id = r.doc_id AND o.entity_type <> 'EMAIL_ADDRESS' AND o.score IS NOT NULL AND o.span_start < r.span_end AND r.span_start < o.span_end))
"""

_TAIL = digits(31, 5)
_TEL = digits(15485863, 9, 500000000)
_TEL_SQL = digits_sql(15485863, 9, 500000000)
_PHONE = f"concat('tel. ', substr({_TEL}, 1, 3), '-', substr({_TEL}, 4, 3), '-', substr({_TEL}, 7, 3))"


def _even(yes: str, no: str) -> str:
    return f"if(k % 2 = 0, '{yes}', '{no}')"


def _text(*parts: str) -> str:
    return f"concat({', '.join(parts)})"


QUERIES = {
    "chk_nip": _check(_NIP, chk.nip_valid),
    "chk_regon": _check(f"if(k % 2 = 0, {_REGON}, {_REGON14})", chk.regon_valid),
    "chk_pesel": _check(_PESEL, chk.pesel_valid),
    "chk_id_card": _check(_CARD, chk.id_card_valid),
    "chk_iban": _check(_NRB, chk.iban_valid),
    "ctx_window": ctx_window,
    "rec_nip": _found(_text(_even("NIP: ", "nr: "), _NIP), rec.nip),
    "rec_regon": _found(_text(_even("REGON ", "numer "), _REGON), rec.regon),
    "rec_krs": _found(_text(_even("KRS ", "wpis "), _NIP), rec.krs),
    "rec_pesel": _found(_text(_even("Pesel ", "numer "), _PESEL), rec.pesel),
    "rec_bank": _found(_text("CASE k % 3 WHEN 0 THEN 'konto PL' WHEN 1 THEN 'konto ' ELSE 'numer ' END", _NRB, "' x'"), rec.bank_account),
    "rec_phone": _found(f"if(k % 2 = 0, {_PHONE}, concat('dzwon +48 ', {_TEL}))", rec.phone),
    "rec_id_card": _found(_text("'dowod '", _CARD), rec.id_card),
    "rec_passport": _found(_text(_even("Paszport ", "dokument "), _letters(2), "' '", digits(7919, 7)), rec.passport),
    "rec_plate": _found(_text(_even("pojazd ", "wozidlo "), f"if(k % 3 = 0, lower({_PLATE}), {_PLATE})", "' '", _TAIL, "'.'"), lambda t: rec.plate(t, PLATE_PREFIXES)),
    "rec_policy": _found(_text(_even("nr polisy: ", "POLISA #"), _letters(2), _TAIL, "' z dnia'"), lambda t: rec.custom(t, "POLICY_NUMBER", Rules().policy_rules)),
    "rec_claim": _found(_text(_even("Szkoda ", "wypadek "), _TAIL, "'/'", "CAST(k % 90 + 10 AS STRING)"), lambda t: rec.custom(t, "CLAIM_NUMBER", Rules().claim_rules)),
    "rec_org": _found(_text("'Alfa'", "CAST(k AS STRING)", _even(" sp. z o.o.", " Beta s.a."), "' dalej'"), lambda t: rec.organization(t, Rules().legal_forms)),
    "rec_address": _found(_ADDRESS, _address),
    "rec_teryt": rec_teryt,
    "rec_person": rec_person,
    "rec_email": rec_email,
    "detect_documents": detect_documents,
}

_CTX_SQL = "SELECT o_orderkey AS k, CAST(o_orderkey % 260 + 5 AS INTEGER) AS position, o_orderkey % 260 + 5 <= 200 AS near FROM orders"
_PLATE_LOWER = "k % 3 = 0"

ORACLES = {
    "chk_nip": _check_sql(_NIP_SQL, nip_sql),
    "chk_regon": _check_sql(f"CASE WHEN o_orderkey % 2 = 0 THEN {_REGON_SQL} ELSE {_REGON14_SQL} END", lambda s: f"CASE WHEN length({s}) = 9 THEN {regon9_sql(s)} ELSE {regon14_sql(s)} END"),
    "chk_pesel": _check_sql(_PESEL_SQL, pesel_sql),
    "chk_id_card": _check_sql(_CARD_SQL, _id_card_sql),
    "chk_iban": _check_sql(_NRB_SQL, nrb_sql),
    "ctx_window": _CTX_SQL,
    "rec_nip": _found_sql("PL_NIP", "CASE WHEN k % 2 = 0 THEN 5 ELSE 4 END", "CASE WHEN k % 2 = 0 THEN 15 ELSE 14 END", "CASE WHEN k % 2 = 0 THEN 0.99 ELSE 0.8 END", nip_sql("v"), _NIP_SQL),
    "rec_regon": _found_sql("PL_REGON", "6", "15", "0.99", f"k % 2 = 0 AND {regon9_sql('v')}", _REGON_SQL),
    "rec_krs": _found_sql("PL_KRS", "CASE WHEN k % 2 = 0 THEN 4 ELSE 5 END", "CASE WHEN k % 2 = 0 THEN 14 ELSE 15 END", "CASE WHEN k % 2 = 0 THEN 0.98 ELSE 0.8 END", f"NOT {nip_sql('v')} AND (k % 2 = 0 OR substr(v, 1, 1) = '0')", _NIP_SQL),
    "rec_pesel": _found_sql("PL_PESEL", "6", "17", "CASE WHEN k % 2 = 0 THEN 0.99 ELSE 0.6 END", pesel_sql("v"), _PESEL_SQL),
    "rec_bank": _found_sql("BANK_ACCOUNT", "6", "CASE WHEN k % 3 = 0 THEN 35 ELSE 33 END", "CASE k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.99 ELSE 0.6 END", nrb_sql("v"), _NRB_SQL),
    "rec_phone": _found_sql("PHONE_NUMBER", "CASE WHEN k % 2 = 0 THEN 5 ELSE 6 END", "CASE WHEN k % 2 = 0 THEN 16 ELSE 19 END", "CASE WHEN k % 2 = 0 THEN 0.85 ELSE 0.95 END", f"k % 2 = 1 OR NOT {regon9_sql('v')}", _TEL_SQL),
    "rec_id_card": _found_sql("PL_ID_CARD", "6", "15", "0.99", _id_card_sql("v"), _CARD_SQL),
    "rec_passport": _found_sql("PL_PASSPORT", "9", "19", "CASE WHEN k % 2 = 0 THEN 0.9 ELSE 0.6 END", "TRUE"),
    "rec_plate": _found_sql("LICENSE_PLATE", "CASE WHEN k % 2 = 0 THEN 7 ELSE 8 END", "CASE WHEN k % 2 = 0 THEN 15 ELSE 16 END", "CASE WHEN k % 2 = 0 THEN 0.9 ELSE 0.6 END", f"k % 2 = 0 OR NOT ({_PLATE_LOWER})"),
    "rec_policy": _found_sql("POLICY_NUMBER", "CASE WHEN k % 2 = 0 THEN 11 ELSE 8 END", "CASE WHEN k % 2 = 0 THEN 18 ELSE 15 END", "0.9", "TRUE"),
    "rec_claim": _found_sql("CLAIM_NUMBER", "7", "15", "0.9", "k % 2 = 0"),
    "rec_org": _found_sql("ORGANIZATION", "0", "4 + length(CAST(k AS VARCHAR)) + CASE WHEN k % 2 = 0 THEN 11 ELSE 10 END", "0.92", "TRUE"),
    "rec_address": _ADDRESS_SQL,
    "rec_teryt": _TERYT_SQL,
    "rec_person": _PERSON_SQL,
    "rec_email": _EMAIL_SQL,
    "detect_documents": _DETECT_SQL,
}
