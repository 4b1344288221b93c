"""Checksums, recognizers and resolution: hand-made cases and a differential test against the model."""

from __future__ import annotations

import random

import model
import pytest
from pyspark.sql import functions as F

from plaszcz.functions import checksums as chk
from plaszcz.functions import text as fn
from plaszcz.functions.spans import PRIORITY, SPANS, resolve
from plaszcz.operators import lexicon, recognizers
from plaszcz.operators.detect import detect, raw_spans
from plaszcz.sources.config import PLATE_PREFIXES, Rules

model.PREFIXES = set(PLATE_PREFIXES)
RULES = Rules(
    localities=frozenset(["KRAKÓW", "NOWY SĄCZ", "NOWY"]), streets=frozenset(["DŁUGA"]), counties=frozenset(["BIALSKI"]), communes=frozenset(["M. GDAŃSK"]),
    first_names=frozenset(["JAN", "ANNA", "MARIA"]), surnames=frozenset(["KOWALSKI", "NOWAK", "NOWAK-LIS", "MARIA"]),
)


def found(spark, texts, rules=RULES, resolved=False, kinds=None):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    column = detect(df, rules=rules, entity_types=kinds) if resolved else df.withColumn("spans", raw_spans(F.coalesce("text", F.lit("")), rules, kinds))
    rows = {r.i: [(s.entity_type, s.start, s.end, s.score) for s in r.spans] for r in column.select("i", "spans").collect()}
    return [rows[i] for i in range(len(texts))]


CHECKS = [(chk.nip_valid, model.nip), (chk.regon_valid, model.regon), (chk.pesel_valid, model.pesel), (chk.id_card_valid, model.id_card), (chk.iban_valid, model.iban)]


@pytest.mark.parametrize("k", range(5))
def test_checksums(spark, k):
    native, want = CHECKS[k]
    rng = random.Random(k)
    values = [model.with_check(kind, n, rng.randrange(10**13)) for kind, n in (("nip", 10), ("regon", 9), ("pesel", 11)) for _ in range(40)]
    values += [model.account(rng.randrange(10**24)) for _ in range(20)] + ["PL " + model.account(rng.randrange(10**24)) for _ in range(20)]
    values += ["".join(rng.choice("ABCabz019- ") for _ in range(rng.randrange(30))) for _ in range(200)] + ["ABA300000", "abs 123456", "123-456-32-18", "٣" * 10, "", "12345678512347"]
    values += [f"{rng.choice('ABCDEF')}{rng.choice('XYZ')}A{rng.randrange(10**6):06d}" for _ in range(200)]
    values = [v for v in values if v is not None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[1] for r in df.select("v", native(F.col("v"))).collect()]
    assert got == [want(v) for v in values]
    assert any(got) and not all(got)
    assert spark.range(1).select(native(F.lit(None).cast("string"))).first()[0] is False


def test_recognizers_against_the_model(spark):
    rng = random.Random(7)

    def bit():
        n = rng.randrange(10**24)
        return rng.choice([
            lambda: rng.choice(["NIP ", "nip:", "", "KRS: "]) + (model.with_check("nip", 10, n) or ""), lambda: rng.choice(["-", " ", "\n"]).join((model.with_check("nip", 10, n) or "0000000000")[a:b] for a, b in ((0, 3), (3, 6), (6, 10))),
            lambda: rng.choice(["regon ", ""]) + (model.with_check("regon", 9, n) or ""), lambda: f"{rng.choice(['pesel ', 'x '])}{model.with_check('pesel', 11, n)}", lambda: rng.choice(["konto ", "PL", "pl ", ""]) + model.account(n),
            lambda: " ".join([rng.choice(["PL", ""]) + model.account(n)[:2]] + [model.account(n)[i : i + 4] for i in range(2, 26, 4)]), lambda: rng.choice(["tel. ", "+48 ", "+48", ""]) + f"{n % 10**9:09d}", lambda: f"{rng.choice(['kom.', 'a'])} {n % 900 + 100} {n % 800 + 100}-{n % 700 + 100}",
            lambda: rng.choice(["ABS", "AB", "abs", "XYZ "]) + f"{n % 10**7:07d}"[: rng.choice([6, 7])], lambda: rng.choice(["WA ", "WAB", "wa-", "KR", "Kr"]) + f"{n % 10**5:05d}"[: rng.choice([4, 5])], lambda: rng.choice(["pojazd ", "", "paszport "]) + "GD1A2B3",
            lambda: rng.choice(["polisa ", "Nr polisy: ", "szkoda#", "ROSZCZENIE - "]) + rng.choice(["AB/12345", "ubezpieczeniowa", "12", "Ż12345"]), lambda: rng.choice(["a.b@c.pl", ".x@y.com.", "ża@b.pl", "a@b", "+a@b.co"]),
            lambda: rng.choice(["zażółć", "😀", "\n", "  ", "1", "_", "Ą"]), lambda: "".join(rng.choice("0123456789 -") for _ in range(rng.randrange(28))),
        ])()

    texts = [rng.choice([" ", " ", "", "\n", ", "]).join(bit() for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    kinds = [k for k in PRIORITY if k not in ("ADDRESS", "PERSON", "ORGANIZATION")]
    for text, got in zip(texts, found(spark, texts, kinds=kinds)):
        assert sorted(set(got)) == sorted(model.spans(text)), repr(text)


CASES = [
    ("LICENSE_PLATE", "WAB1234", []), ("LICENSE_PLATE", "WA12345", [(0, 7, 0.6)]), ("LICENSE_PLATE", "wa 12345", []), ("LICENSE_PLATE", "pojazd wa 12345", [(7, 15, 0.9)]), ("LICENSE_PLATE", "WA ABCDE", []),
    ("POLICY_NUMBER", "polisa ubezpieczeniowa", [(7, 22, 0.9)]), ("PL_PASSPORT", "AB 1234567", [(0, 10, 0.6)]), ("PL_PASSPORT", "ab1234567", []),
    ("ORGANIZATION", "Umowa z Alfa sp. z o.o. dnia", [(0, 23, 0.92)]), ("ORGANIZATION", "Alfa\nBeta S.A.", [(0, 14, 0.92)]), ("ORGANIZATION", "Alfa spółkami", []), ("ORGANIZATION", "PZU sp. j.", [(0, 10, 0.92)]),
    ("EMAIL_ADDRESS", ".a@b.pl", [(0, 7, 0.98)]), ("EMAIL_ADDRESS", "ża@b.pl", []), ("EMAIL_ADDRESS", "a@b.pl.", [(0, 6, 0.98)]),
    ("ADDRESS", "ul. Długa 1", []), ("ADDRESS", "al. Długa 1", [(0, 11, 0.78)]), ("ADDRESS", "Adres siedziby: ul. Długa 1", [(16, 27, 0.92)]),
    ("ADDRESS", "plac Wolny 1A/2 lok. 3, 30-001 Kraków, dalej", [(0, 37, 0.97)]), ("ADDRESS", "30-001 Nowy Sącz\nal. 3 Maja 5", [(0, 29, 0.97)]), ("ADDRESS", "30-001 Nowy\njan", [(0, 11, 0.82)]), ("ADDRESS", "30-001 Radom", []),
    ("ADDRESS", "al. Długa 1" + "," * 40 + "30-001 Kraków", [(0, 64, 0.97)]), ("ADDRESS", "al. Długa 1" + "," * 41 + "30-001 Kraków", [(0, 11, 0.78), (52, 65, 0.82)]), ("ADDRESS", "al. Długa 1 kod pocztowy: 30-001 Kraków", [(0, 39, 0.97)]),
    ("ADDRESS", "Ulica:\nDŁUGA", [(7, 12, 0.95)]), ("ADDRESS", "DŁUGA", []), ("ADDRESS", " Mazowieckie \nbialski\r\nM.\xa0 Gdańsk\x0bKraków", [(1, 12, 0.96), (14, 21, 0.94), (23, 33, 0.92), (34, 40, 0.82)]), ("ADDRESS", "woj. mazowieckie", []),
    ("PERSON", "Jan Kowalski", [(0, 12, 0.7)]), ("PERSON", "Jan Maria Nowak-Lis x", [(0, 19, 0.7), (4, 19, 0.7)]), ("PERSON", "Jan, Kowalski", []), ("PERSON", "Jan\xa0Kowalski", [(0, 12, 0.7)]), ("PERSON", "Jan\nKowalski", []), ("PERSON", "Jan A Kowalski", []), ("PERSON", "ŻJan Kowalski", []),
]


def test_hand_made_cases(spark):
    for kind in {k for k, _, _ in CASES}:
        mine = [(t, want) for k, t, want in CASES if k == kind]
        for (text, want), got in zip(mine, found(spark, [t for t, _ in mine], kinds=[kind])):
            assert sorted((a, b, s) for _, a, b, s in got) == want, repr(text)


def test_no_names_without_dictionaries(spark):
    assert found(spark, ["Jan Kowalski"], Rules(), kinds=["PERSON"]) == [[]]


def test_lines_by_join_equal_lines_by_set(spark):
    texts = [t for k, t, _ in CASES if k == "ADDRESS"] + ["Długa\nulica \nDługa\n", "kraków Nowy", ""]
    rules = Rules(localities=RULES.localities, streets=RULES.streets, counties=RULES.counties, communes=RULES.communes)
    dictionary = [("street", "długa"), ("county", "bialski"), ("commune", "m. gdańsk")] + [("locality", x) for x in rules.localities] + [("voivodeship", x) for x in rules.voivodeships]
    units = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = lexicon.match_lines(units, spark.createDataFrame(dictionary, "level string, name string")).collect()
    assert sorted((r.i, r.start, r.end, r.score) for r in rows) == sorted((i, *s) for i, t in enumerate(texts) for s in lexicon.administrative(t, rules))


def brute_resolve(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-PRIORITY.get(s[0], 0), s[1] - s[2], s[1], -s[3])):
        if all(s[2] <= k[1] or k[2] <= s[1] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[1])


def test_resolution(spark):
    rng = random.Random(3)
    sets = [[(rng.choice([*PRIORITY, "OTHER"]), a := rng.randrange(60), a + rng.randrange(1, 15), rng.randrange(10) / 10) for _ in range(rng.randrange(12))] for _ in range(150)]
    sets += [[("PL_NIP", 0, 5, 0.8), ("PHONE_NUMBER", 3, 30, 0.9)], [("ADDRESS", 0, 5, 0.5), ("ADDRESS", 5, 9, 0.5)], [("ADDRESS", 0, 5, 0.1), ("ADDRESS", 0, 5, 0.9)]]
    df = spark.createDataFrame([(i, [(*s, "r") for s in x]) for i, x in enumerate(sets)], f"i int, s {SPANS}")
    got = {r.i: [tuple(s)[:4] for s in r.s] for r in df.select("i", resolve(F.col("s")).alias("s")).collect()}
    for i, x in enumerate(sets):
        assert [g[1:] for g in got[i]] == [w[1:] for w in brute_resolve(x)]


def test_detection_drops_allowed_values_and_nulls(spark):
    texts = [None, "", "Jan Kowalski i Anna Nowak, NIP 1234563218, tel. 600700800"]
    got = found(spark, texts, resolved=True)
    assert got[:2] == [[], []]
    assert [k for k, *_ in got[2]] == ["PERSON", "PL_NIP", "PHONE_NUMBER"] and got[2][0][1:3] == (15, 25)


def test_detection_by_pattern_needs_no_python(spark):
    df = spark.createDataFrame([("x",)], "text string")
    kinds = [k for k in PRIORITY if k not in ("ADDRESS", "PERSON")]
    plan = detect(df, entity_types=kinds)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_registered_recognizer(spark):
    recognizers.register_recognizer("code", "CODE", r"\bK-[0-9]{3}\b", score=0.5, context=("kod",), window=10, context_score=0.9, validator=lambda raw: ~raw.endswith("0"))
    try:
        assert found(spark, ["kod K-123, K-120" + " " * 20 + "K-555"], kinds=["CODE"]) == [[("CODE", 4, 9, 0.9), ("CODE", 36, 41, 0.5)]]
    finally:
        recognizers.unregister_recognizer("code")


def test_text_helpers(spark):
    row = spark.range(1).select(
        fn.output_name(F.lit(".DOCX"), F.lit("2024-03-05 07:08:09").cast("timestamp")), fn.cell_target(F.lit("a!b!C1"), F.lit(None).cast("string"), F.lit(None).cast("string")),
        fn.cell_target(F.lit("x"), F.lit("p"), F.lit("A1")), fn.to_pdf_box([F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(40.0)], [F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(-2.0), F.lit(0.0), F.lit(100.0)]),
        fn.embedded_risk(F.lit("word/embeddings/oleObject1.bin")),
    ).first()
    assert row[0] == "anonimizacja_05-03_07-08.docx" and tuple(row[1]) == ("a!b", "C1") and tuple(row[2]) == ("p", "A1")
    assert tuple(row[3]) == (5.0, 30.0, 15.0, 40.0) and row[4] is True
