"""Packages, dictionaries, markers over batches, streaming and the entry module."""

from __future__ import annotations

import io
import subprocess
import sys
import zipfile
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plaszcz.operators import dictionaries as dic
from plaszcz.operators import findings as fnd
from plaszcz.operators import redact as red
from plaszcz.operators.detect import detect
from plaszcz.sources import config, ooxml
from plaszcz.streaming.detect import detect_stream, write_with_markers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/{0}" ContentType="application/vnd.openxmlformats-officedocument.{1}"/><Override PartName="/docProps/core.xml" ContentType="x"/></Types>'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="1" Target="word/document.xml"/><Relationship Id="2" Target="docProps/core.xml"/></Relationships>'


def package(parts: dict[str, str], **kwargs) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(*paragraphs: str, **more: str) -> bytes:
    body = "".join(f"<w:p>{p}</w:p>" for p in paragraphs)
    parts = {"[Content_Types].xml": TYPES.format("word/document.xml", "wordprocessingml"), "_rels/.rels": RELS, "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"}
    return package(parts | {k.replace("__", "/") + ".xml": v for k, v in more.items()})


def run(*texts: str) -> str:
    return "".join(f'<w:r><w:t xml:space="preserve">{t}</w:t></w:r>' for t in texts)


def part(data: bytes, name: str) -> str:
    return zipfile.ZipFile(io.BytesIO(data)).read(name).decode()


def sheet(cells: str) -> str:
    return f"<worksheet {S}><sheetData><row>{cells}</row></sheetData></worksheet>"


def xlsx(cells: str, strings: str) -> bytes:
    return package({"[Content_Types].xml": TYPES.format("xl/workbook.xml", "spreadsheetml"), "xl/workbook.xml": f"<workbook {S}/>", "xl/sharedStrings.xml": f"<sst {S}>{strings}</sst>", "xl/worksheets/sheet1.xml": sheet(cells)})


def test_value_over_three_runs_becomes_one_marker():
    data = docx(run("Jan", " Ko", "walski ", "to tester."), run("nic"))
    out = ooxml.redact_docx(data, {" Jan Kowalski ": "[OSOBA_1]"})
    units = ooxml.docx_units(out)
    assert units[0].text == "[OSOBA_1] to tester." and units[1].text == "nic"
    assert part(out, "word/document.xml").count(":r>") == part(data, "word/document.xml").count(":r>")


def test_docx_units_of_boxes_properties_and_skipped_parts():
    box = f"{run('zewn ')}<w:r><w:txbxContent><w:p>{run('wewn')}</w:p></w:txbxContent></w:r><w:r><w:delText>usun</w:delText></w:r>"
    data = docx(box, "", docProps__core="<a><b> Autor </b></a>", word__styles=f"<w:styles {W}><w:p>{run('x')}</w:p></w:styles>", word__header1="<!DOCTYPE a><a/>")
    assert [(u.kind, u.text) for u in ooxml.docx_units(data)] == [("story", "zewn wewnusun"), ("story", "wewn"), ("metadata", "Autor")]
    out = ooxml.redact_docx(data, {"Autor": "[OSOBA_1]", "wewn": "[X_1]"})
    assert [u.text for u in ooxml.docx_units(out)] == ["zewn [X_1]usun", "[X_1]", "[OSOBA_1]"]


def test_xlsx_cells_and_shared_strings():
    cells = '<c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>a Jan Kowalski</t></is></c><c r="D1"><v>12</v></c><c r="E1" t="str"><f>A1</f><v>Jan Kowalski</v></c><c r="F1" t="b"><v>1</v></c><c r="G1" t="s"><v>9</v></c>'
    data = xlsx(cells, "<si><r><t>Jan </t></r><r><t>Kowalski</t></r></si><si><t>inne</t></si>")
    units = ooxml.xlsx_units(data)
    assert [(u.location.split("!")[1], u.text, u.storage, u.shared_index) for u in units] == [("A1", "Jan Kowalski", "sharedString", 0), ("B1", "Jan Kowalski", "sharedString", 0), ("C1", "a Jan Kowalski", "inlineStr", None), ("D1", "12", "number", None)]
    out = ooxml.redact_xlsx(data, {"Jan Kowalski": "[OSOBA_1]", "12": "[X_1]"})
    assert [u.text for u in ooxml.xlsx_units(out)] == ["[OSOBA_1]", "[OSOBA_1]", "a [OSOBA_1]", "[X_1]"]
    assert "Jan" not in part(out, "xl/sharedStrings.xml")
    one = ooxml.redact_xlsx(data, {}, cells={"xl/worksheets/sheet1.xml!A1": {"Jan Kowalski": "[OSOBA_1]"}})
    assert [u.text for u in ooxml.xlsx_units(one)][:3] == ["[OSOBA_1]", "Jan Kowalski", "a Jan Kowalski"] and "Jan" in part(one, "xl/sharedStrings.xml")
    assert ooxml.redact_xlsx(data, {"nikt": "[X]"}) == data


@pytest.mark.parametrize("data", [b"x", package({"../word/document.xml": "x"}), package({"a": "A" * 50_000_000}), package({str(i): "" for i in range(501)}), package({"a..b.xml": ""}), b"0" * (50 * 1024 * 1024 + 1)])
def test_unsafe_packages_are_refused(data):
    with pytest.raises(ooxml.PackageError):
        ooxml.open_package(data)


def test_unsafe_and_foreign_parts_are_refused():
    z = ooxml.open_package(package({"a.xml": '<!DOCTYPE x [<!ENTITY e "v">]><x>&e;</x>', "b.xml": "<x>", "c.xml": "<x/>"}))
    for name in ("a.xml", "b.xml", "missing.xml"):
        with pytest.raises(ooxml.PackageError):
            ooxml.read_part(z, name)
    assert ooxml.read_part(z, "c.xml").tag == "x"
    for parts in ({"word/document.xml": "<x/>"}, {"[Content_Types].xml": "x", "word/document.xml": "<x/>"}, {"[Content_Types].xml": "wordprocessingml", "word/document.xml": "<x/>", "EncryptionInfo": ""}):
        with pytest.raises(ooxml.PackageError):
            ooxml.docx_units(package(parts))


def test_declarations_in_any_encoding_and_broken_parts_are_refused():
    evil = '<?xml version="1.0" encoding="UTF-16"?><!DOCTYPE x [<!ENTITY e "EXPANDED">]><x>&e;</x>'
    z = ooxml.open_package(package({"a.xml": evil.encode("utf-16"), "b.xml": '<?xml version="1.0" encoding="x-none"?><x/>', "c.xml": '<?xml version="1.0" encoding="UTF-16"?><x>ł</x>'.encode("utf-16")}))
    for name in ("a.xml", "b.xml"):
        with pytest.raises(ooxml.PackageError):
            ooxml.read_part(z, name)
    assert ooxml.read_part(z, "c.xml").text == "ł"
    raw = package({"a.xml": "<x>some text</x>"})
    at = raw.index(b"a.xml") + len(b"a.xml") + 3
    with pytest.raises(ooxml.PackageError):
        ooxml.read_part(ooxml.open_package(raw[:at] + bytes([raw[at] ^ 0xFF]) + raw[at + 1 :]), "a.xml")


def test_one_broken_file_fails_no_job(spark, tmp_path, monkeypatch):
    good = docx(run("NIP 123-456-32-18"), word__embeddings__x="<a/>")
    (tmp_path / "a.docx").write_bytes(good)
    at = good.index(b"word/document.xml") + 20
    (tmp_path / "b.docx").write_bytes(good[:at] + b"\xff\xff\xff" + good[at + 3 :])
    (tmp_path / "c.docx").write_bytes(good + b"0" * 5000)
    (tmp_path / "d.xls").write_bytes(b"x")
    monkeypatch.setattr(ooxml, "MAX_PACKAGE", len(good) + 100)
    files = ooxml.read_documents(spark, str(tmp_path))
    rows = {Path(r.path).name: r for r in files.collect()}
    assert [rows[n].doc_id for n in sorted(rows)] == [0, 1, 2, 3]
    assert rows["c.docx"].error == ooxml.TOO_LARGE and rows["c.docx"].content is None and rows["d.xls"].content is None
    units = {Path(r.path).name: r for r in ooxml.document_units(files.unionByName(files.limit(1).selectExpr("9L AS doc_id", "'x/e.docx' AS path", "0L AS length", "CAST(NULL AS BINARY) AS content", "CAST(NULL AS STRING) AS error"))).collect()}
    assert all(units[n].error and units[n].text is None for n in ("b.docx", "c.docx", "d.xls", "e.docx")) and not units["a.docx"].error
    assert units["a.docx"].warnings and "word/embeddings/x" in units["a.docx"].warnings[0]
    grouped = spark.createDataFrame([(0, "123-456-32-18", "[NIP_1]", "1")], "doc_id long, raw_value string, marker string, id string")
    done = ooxml.redact_documents(files, grouped)
    out = {r.doc_id: r for r in ooxml.write_documents(done, str(tmp_path / "out"), datetime(2024, 3, 5, 7, 8)).collect()}
    assert out[0].file == "anonimizacja_05-03_07-08_0.docx" and [p.name for p in (tmp_path / "out").iterdir()] == [out[0].file] and all(out[k].file is None and out[k].error for k in (1, 2, 3))
    assert ooxml.docx_units((tmp_path / "out" / out[0].file).read_bytes())[0].text == "NIP [NIP_1]"


def test_rule_files(tmp_path):
    folder = tmp_path / "config" / "recognizers"
    folder.mkdir(parents=True)
    write(folder / "legal_forms.yml", 'legal_forms:\n  - names: ["sp. j.", \'it\'\'s\', SA]  # x\n  - names:\n    - "a # b"\n')
    write(folder / "allowlist.yml", 'allowlist:\n- "Jan Kowalski" # note\n- Anna\n')
    write(folder / "policy_numbers.yml", '# rules\nrules:\n  - name: "one"\n    regex: "(?i)\\\\bnr\\\\s*([0-9]{3,5})\\\\b"\n  -\n    regex: x\n')
    write(tmp_path / "config" / "entity_types.yaml", 'entity_types:\n  PERSON: "[OSOBA_{}]"\n')
    rules = config.load_rules(folder)
    assert rules.legal_forms == ("sp. j.", "it's", "SA", "a # b") and rules.allowlist == ("Jan Kowalski", "Anna")
    assert rules.policy_rules == (r"(?i)\bnr\s*([0-9]{3,5})\b", "x") and rules.markers == {"PERSON": "[OSOBA_{}]"}
    for bad in ("a: &x 1\n", "a: {b: 1}\n", "a:\n\t- b\n", "a: |\n  b\n", "- a\n", 'a: "b\n'):
        write(folder / "allowlist.yml", bad)
        with pytest.raises(ValueError):
            config.load_rules(folder)


def test_metadata_goes():
    data = docx(run("x"), docProps__core="<a/>", docProps__app="<a/>")
    out = ooxml.sanitize("a.DOCX", data)
    names = zipfile.ZipFile(io.BytesIO(out)).namelist()
    assert not any("docProps" in n for n in names) and "docProps" not in part(out, "_rels/.rels") + part(out, "[Content_Types].xml") and "word/document.xml" in part(out, "_rels/.rels")
    assert ooxml.sanitize("a.docx", out) == out and ooxml.sanitize("a.txt", b"x") == b"x"
    twice = io.BytesIO(data)
    with pytest.warns(UserWarning), zipfile.ZipFile(twice, "a") as z:
        z.writestr("word/document.xml", "again")
    with pytest.raises(ooxml.PackageError):
        ooxml.strip_metadata(twice.getvalue())


def test_files_to_findings_to_redacted_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(run("NIP 123-456-32-18"), run("mail a@b.pl i A@B.pl"), docProps__core="<a><b>a@b.pl</b></a>"))
    (tmp_path / "b.xlsx").write_bytes(xlsx('<c r="A1" t="s"><v>0</v></c>', "<si><t>a@b.pl</t></si>"))
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.doc").write_bytes(b"old")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    files = ooxml.read_documents(spark, str(tmp_path))
    units = ooxml.document_units(files)
    assert {r.path[-6:] for r in units.filter("error IS NOT NULL").collect()} >= {"c.docx", "/d.doc"}
    found = fnd.explode_findings(detect(units.filter("error IS NULL")))
    marked = fnd.assign_markers(found)
    grouped = fnd.group_findings(marked)
    mails = {(r.raw_value, r.marker) for r in grouped.filter("entity_type = 'EMAIL_ADDRESS'").collect()}
    assert mails == {("a@b.pl", "[EMAIL_1]"), ("A@B.pl", "[EMAIL_1]")}
    out = {Path(r.path).name: r for r in ooxml.redact_documents(files, grouped).collect()}
    assert [u.text for u in ooxml.docx_units(bytes(out["a.docx"].content))] == ["NIP [NIP_1]", "mail [EMAIL_1] i [EMAIL_1]"]
    assert [u.text for u in ooxml.xlsx_units(bytes(out["b.xlsx"].content))] == ["[EMAIL_1]"]
    assert all(out[n].content is None and out[n].error for n in ("c.docx", "d.doc"))


def write(path: Path, text: str, encoding: str = "utf-8") -> None:
    path.write_bytes(text.encode(encoding))


def test_dictionaries_from_files(spark, tmp_path):
    write(tmp_path / "first_names_source.csv", '﻿Imię;Liczba\n jan ;5\nJAN;7\n;1\nan?na;2\n"ewa;x";n/a\n\nola\n')
    write(tmp_path / "surnames_source.csv", "nazwisko,other\nnowak,1\nLis,2\n")
    write(tmp_path / "SIMC.csv", "Nazwa\nNowy   Sącz\nnowy sącz\n\nA�\n")
    write(tmp_path / "TERC.csv", "WOJ;POW;GMI;RODZ;NAZWA\n02;;;;DOLNOŚLĄSKIE\n02;01;;;bolesławiecki\n02;01;01;1;Bolesławiec\n02;01;02;2;Gromadka\n02;01;03;4;Miasto\n02;01;03;3;\n", "cp1250")
    write(tmp_path / "ULIC.csv", "NAZWA_1;NAZWA_2\nMickiewicza;Adama\nDługa;\nDŁUGA;\n;\n", "cp1250")
    rejected = dic.build_all(spark, tmp_path, tmp_path / "out")
    read = lambda n: (tmp_path / "out" / n).read_text(encoding="utf-8").splitlines()
    assert read("first_names.csv") == ["name;count", "JAN;5", '"EWA;X";0', "OLA;0"]
    assert read("surnames.csv") == ["surname;count", "NOWAK;0", "LIS;0"] and read("localities.txt") == ["nowy sącz"]
    assert read("voivodeships.txt") == ["dolnośląskie"] and read("counties.txt") == ["bolesławiecki"] and read("communes.txt") == ["bolesławiec", "gromadka", "m. bolesławiec", "m.bolesławiec"]
    assert read("streets.txt") == ["adama mickiewicza", "długa"]
    assert [(r.line_no, r.source_value) for r in rejected] == [("5", "AN?NA"), ("5", "A�")] and len(read("rejections.csv")) == 3
    rules = config.load_rules(tmp_path / "out")
    assert rules.first_names == {"JAN", "EWA;X", "OLA"} and "M. BOLESŁAWIEC" in rules.communes and rules.legal_forms == config.LEGAL_FORMS
    config.startup_check(tmp_path, made=[])
    with pytest.raises(FileNotFoundError):
        config.startup_check(tmp_path / "out")


def test_reading_faults(tmp_path, spark):
    write(tmp_path / "x.csv", "a;b\n1;2\n")
    with pytest.raises(ValueError):
        dic.read_names(spark, tmp_path / "x.csv")
    with pytest.raises(ValueError):
        dic.find_column(["name", "imie"], dic.NAME_COLUMNS, "x")
    with pytest.raises(ValueError):
        dic.decode(b"\x81\xff", ["utf-8"])
    assert [dic.detect_delimiter(s) for s in ("a;b,c", "a\tb,c", "a,b", "a")] == [";", "\t", ",", None]


def test_markers_continue_a_registry(spark, monkeypatch):
    f = spark.createDataFrame([(1, 0, 0, "PERSON", "x"), (1, 0, 5, "PERSON", "y"), (2, 0, 0, "PERSON", "z")], "doc_id long, unit_no int, start int, entity_type string, norm_value string")
    old = spark.createDataFrame([("PERSON", "y", 4)], "entity_type string, norm_value string, suffix int")
    assert {r.norm_value: r.marker for r in fnd.assign_markers(f, registry=old).collect()} == {"y": "[OSOBA_4]", "x": "[OSOBA_5]", "z": "[OSOBA_6]"}
    monkeypatch.setattr(fnd, "_SAMPLED", 1)
    narrow = fnd.number_values(f).collect()
    assert {r.norm_value: r.suffix for r in narrow} == {"x": 1, "y": 2, "z": 3}


def test_ranks_by_ranges_equal_ranks(spark, monkeypatch):
    rows = [(k % 3, (k * 7919) % 1009, str(k % 50)) for k in range(1009)] + [(None, None, "x"), (0, None, None)]
    df = spark.createDataFrame(rows, "kind int, at int, name string").repartition(3)
    want: dict = {}
    null_first = lambda v: (v is not None, v)
    for kind in (0, 1, 2, None):
        mine = sorted((r for r in rows if r[0] == kind), key=lambda r: (null_first(r[1]), null_first(r[2])))
        want |= {r: n for n, r in enumerate(mine, 1)}
    for sampled in (20, 2):
        monkeypatch.setattr(fnd, "_SAMPLED", sampled)
        assert {(r.kind, r["at"], r.name): r["rank"] for r in fnd.ranks(df, ["at", "name"], ["kind"]).collect()} == want


def test_a_scoped_registry_is_continued(spark):
    f = spark.createDataFrame([(1, 0, 0, "PERSON", "x"), (1, 0, 5, "PERSON", "y"), (2, 0, 0, "PERSON", "y")], "doc_id long, unit_no int, start int, entity_type string, norm_value string")
    old = spark.createDataFrame([(1, "PERSON", "y", 4)], "doc_id long, entity_type string, norm_value string, suffix int")
    assert {(r.doc_id, r.norm_value): r.marker for r in fnd.assign_markers(f, scope=["doc_id"], registry=old).collect()} == {(1, "y"): "[OSOBA_4]", (1, "x"): "[OSOBA_5]", (2, "y"): "[OSOBA_1]"}


def test_redaction_chains_by_value_and_leaks_are_found(spark):
    units = spark.createDataFrame([(1, "Jan NIP"), (2, "none")], "doc_id long, text string")
    conf = spark.createDataFrame([(1, "1", "Jan", "[NIP_1]"), (1, "10", "NIP", "<2>"), (1, "2", "", "[E]")], "doc_id long, id string, raw_value string, marker string")
    done = red.redact_by_value(units, conf)
    assert {r.doc_id: r.redacted for r in done.collect()} == {1: "[<2>_1] <2>", 2: "none"}
    assert red.leaks(done, conf).count() == 0 and red.leaks(units.withColumn("redacted", F.col("text")), conf).count() == 1


def test_streaming_markers(spark, tmp_path):
    source = tmp_path / "in"
    schema = "doc_id long, unit_no int, text string"

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        units = spark.readStream.schema(schema).parquet(str(source))
        query = write_with_markers(detect_stream(units), str(tmp_path / "found"), str(tmp_path / "registry"), str(tmp_path / "cp"))
        query.awaitTermination(120)

    step([(1, 0, "a@b.pl c@d.pl")])
    step([(2, 0, "c@d.pl"), (3, 0, "e@f.pl")])
    rows = spark.read.parquet(str(tmp_path / "found")).select("doc_id", "norm_value", "marker").collect()
    assert sorted((r.doc_id, r.norm_value, r.marker) for r in rows) == [(1, "a@b.pl", "[EMAIL_1]"), (1, "c@d.pl", "[EMAIL_2]"), (2, "c@d.pl", "[EMAIL_2]"), (3, "e@f.pl", "[EMAIL_3]")]


def test_entry_works_without_the_subpackage(tmp_path):
    code = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('plaszcz.llm'):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
q = e.queries()
assert 'rec_nip' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)
assert set(e.oracle_sql()) <= set(q)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
