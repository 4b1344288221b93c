"""DOCX and XLSX packages: text units, redaction and metadata removal, in memory.

Everything here works on one package's bytes with the standard library; the Spark side maps
it over a table of binary files. Any breach of a limit or of the format raises PackageError,
which becomes a status of its row and never lets a half-read package through.
"""

from __future__ import annotations

import copy
import io
import os
import re
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime
from typing import TypeVar
from xml.etree import ElementTree as ET
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import output_name

T = TypeVar("T")

# Limits of a package.
MAX_PACKAGE = 50 * 1024 * 1024
MAX_ENTRIES = 500
MAX_PART = 30 * 1024 * 1024
MAX_TOTAL = 150 * 1024 * 1024
MAX_RATIO = 50

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
_WORD_TEXT = frozenset((_W + "t", _W + "delText", _W + "instrText"))
# Parts of a document that hold no text of its author.
_WITHOUT_TEXT = frozenset(
    ("word/fontTable.xml", "word/settings.xml", "word/webSettings.xml", "word/styles.xml", "word/stylesWithEffects.xml", "word/theme/theme1.xml", "word/numbering.xml")
)
# Names of parts that may hold text that is not looked at.
_RISK = re.compile(r"word/embeddings/|activeX|oleObject|/digitalSignature|vbaProject", re.IGNORECASE)
TOO_LARGE = "the file is too large"
SUPPORTED = (".pdf", ".docx", ".xlsx")


class PackageError(ValueError):
    """A package that breaks a limit or the format."""


@dataclass(frozen=True)
class Unit:
    kind: str
    part: str
    location: str
    text: str
    storage: str | None = None
    shared_index: int | None = None


def open_package(data: bytes) -> zipfile.ZipFile:
    if len(data) > MAX_PACKAGE:
        raise PackageError(TOO_LARGE)
    package = _zip(data)
    entries = package.infolist()
    if len(entries) > MAX_ENTRIES:
        raise PackageError("the package has too many entries")
    for e in entries:
        if e.filename.startswith("/") or ".." in e.filename:
            raise PackageError(f"entry {e.filename!r} leads out of the package")
        if e.file_size > MAX_PART:
            raise PackageError(f"entry {e.filename!r} is too large")
        if e.compress_size and e.file_size / e.compress_size > MAX_RATIO:
            raise PackageError(f"entry {e.filename!r} is compressed too well")
    if sum(e.file_size for e in entries) > MAX_TOTAL:
        raise PackageError("the package is too large when unpacked")
    return package


def _zip(data: bytes) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(io.BytesIO(data))
    except Exception as e:  # besides BadZipFile, broken directories end in various errors
        raise PackageError("the file is no ZIP package") from e


def part_bytes(package: zipfile.ZipFile, name: str) -> bytes:
    """A part's bytes. Whatever keeps it from being read, a wrong checksum or an unknown compression, is a PackageError."""
    try:
        return package.read(name)
    except KeyError as e:
        raise PackageError(f"there is no part {name!r}") from e
    except Exception as e:  # zipfile, zlib, bz2 and lzma each have their own
        raise PackageError(f"part {name!r} cannot be read: {e}") from e


def read_part(package: zipfile.ZipFile, name: str) -> ET.Element:
    raw = part_bytes(package, name)
    _refuse_declarations(name, raw)
    try:
        return ET.fromstring(raw, ET.XMLParser(target=ET.TreeBuilder(insert_comments=True, insert_pis=True)))
    except (ET.ParseError, ValueError, LookupError) as e:
        raise PackageError(f"part {name!r} is no XML: {e}") from e


def _refuse_declarations(name: str, raw: bytes) -> None:
    """Read the part as the parser does, in whatever encoding it has, and stop at a DTD or an entity."""

    def refuse(*_: object) -> None:
        raise PackageError(f"part {name!r} declares a DTD or entities")

    parser = expat.ParserCreate()
    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = parser.ExternalEntityRefHandler = refuse
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        refuse()
    try:
        parser.Parse(raw, True)
    except (expat.ExpatError, ValueError, LookupError) as e:
        raise PackageError(f"part {name!r} is no XML: {e}") from e


def rewrite(data: bytes, changed: dict[str, bytes]) -> bytes:
    """The package with some parts' bytes replaced."""
    out = io.BytesIO()
    with open_package(data) as package, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
        for e in package.infolist():
            to.writestr(e, changed[e.filename] if e.filename in changed else part_bytes(package, e.filename))
    return out.getvalue()


def _bytes(root: ET.Element) -> bytes:
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def check_docx(package: zipfile.ZipFile) -> None:
    names = set(package.namelist())
    for needed in ("[Content_Types].xml", "word/document.xml"):
        if needed not in names:
            raise PackageError(f"a document needs {needed}")
    if b"wordprocessingml" not in part_bytes(package, "[Content_Types].xml"):
        raise PackageError("the content types name no document")
    if names & {"EncryptionInfo", "EncryptedPackage"}:
        raise PackageError("the document is encrypted")


def check_xlsx(package: zipfile.ZipFile) -> None:
    names = set(package.namelist())
    if "[Content_Types].xml" not in names or "xl/workbook.xml" not in names:
        raise PackageError("a workbook needs [Content_Types].xml and xl/workbook.xml")
    if names & {"EncryptionInfo", "EncryptedPackage"}:
        raise PackageError("the workbook is encrypted")


def embedded_risks(names: Iterable[str]) -> list[str]:
    """Parts that may hold text that is not looked at."""
    return [n for n in names if _RISK.search(n)]


def _docx_parts(package: zipfile.ZipFile) -> list[str]:
    return [n for n in package.namelist() if n.endswith(".xml") and n.startswith(("word/", "docProps/")) and n not in _WITHOUT_TEXT]


def _story_part(package: zipfile.ZipFile, name: str) -> ET.Element | None:
    """A part of a document; parts beside the main one that cannot be read are left out (warnings_of names them)."""
    try:
        return read_part(package, name)
    except PackageError:
        if name == "word/document.xml":
            raise
        return None


def _texts(node: ET.Element, tags: frozenset[str]) -> list[ET.Element]:
    return [t for t in node.iter() if t.tag in tags and t.text]


def docx_units(data: bytes) -> list[Unit]:
    """Paragraphs with text, one inside another (a text box) also on its own, and document properties."""
    package = open_package(data)
    check_docx(package)
    out = []
    for name in _docx_parts(package):
        root = _story_part(package, name)
        if root is None:
            continue
        if name.startswith("docProps/"):
            out += [Unit("metadata", name, "metadata", t) for n in root.iter() if isinstance(n.tag, str) and (t := (n.text or "").strip())]
        else:
            stories = ("".join(t.text for t in _texts(p, _WORD_TEXT)) for p in root.iter(_W + "p"))
            out += [Unit("story", name, name, s) for s in stories if s.strip()]
    return out


def replace_range(nodes: list[ET.Element], start: int, end: int, marker: str, keep_space: bool = False) -> None:
    """Put the marker in place of characters start to end of the nodes' joined text.

    The first node touched keeps what stands before and takes the marker, the others lose
    what was covered; the nodes, and so their formatting, stay.
    """
    at, placed = 0, False
    for node in nodes:
        text = node.text or ""
        a, b = max(start - at, 0), min(end - at, len(text))
        at += len(text)
        if a >= b:
            continue
        node.text = text[:a] + ("" if placed else marker) + text[b:]
        placed = True
        if keep_space:
            if node.text != node.text.strip():
                node.set(_SPACE, "preserve")
            else:
                node.attrib.pop(_SPACE, None)


def _places(text: str, replacements: dict[str, str]) -> list[tuple[int, int, str]]:
    """Where the values stand, from the last to the first."""
    found = [(m.start(), m.end(), marker) for raw, marker in replacements.items() for m in re.finditer(re.escape(raw), text)]
    return sorted(found, key=lambda x: -x[0])


def redact_docx(data: bytes, replacements: dict[str, str]) -> bytes:
    """Every occurrence of the values, trimmed, in paragraphs and properties becomes its marker."""
    package = open_package(data)
    check_docx(package)
    wanted = {r.strip(): m.strip() for r, m in replacements.items() if r and m and r.strip() and m.strip()}
    read_part(package, "word/document.xml")  # a file that cannot be read does not pass, even if nothing is to go
    if not wanted:
        return data
    changed: dict[str, bytes] = {}
    for name in _docx_parts(package):
        root = _story_part(package, name)
        if root is None:
            continue
        touched = False
        if name.startswith("docProps/"):
            for node in root.iter():
                for raw, marker in wanted.items() if node.text and node.text.strip() else ():
                    if raw in node.text:
                        node.text = node.text.replace(raw, marker)
                        touched = True
        else:
            for paragraph in root.iter(_W + "p"):
                nodes = _texts(paragraph, _WORD_TEXT)
                last = None
                for start, end, marker in _places("".join(n.text for n in nodes), wanted):
                    if last is not None and end > last:
                        continue  # values that overlap: the later one has gone
                    replace_range(nodes, start, end, marker)
                    touched, last = True, start
        if touched:
            changed[name] = _bytes(root)
    return rewrite(data, changed)


def _sheets(package: zipfile.ZipFile) -> list[str]:
    return sorted(n for n in package.namelist() if re.fullmatch(r"xl/worksheets/sheet[^/]*\.xml", n))


def _shared(package: zipfile.ZipFile) -> ET.Element | None:
    return read_part(package, "xl/sharedStrings.xml") if "xl/sharedStrings.xml" in package.namelist() else None


def _joined(node: ET.Element | None) -> str:
    return "" if node is None else "".join(t.text or "" for t in node.iter(_S + "t"))


def cell_text(cell: ET.Element, shared: list[str]) -> tuple[str, str, int | None]:
    """(text, storage, index of the shared string). Results of formulas are no text, nor are flags, errors and dates."""
    kind, value = cell.get("t"), cell.find(_S + "v")
    raw = (value.text or "") if value is not None else ""
    if kind == "inlineStr":
        return _joined(cell.find(_S + "is")), "inlineStr", None
    if kind == "s":
        try:
            index = int(raw)
        except ValueError:
            return "", "unsupported", None
        return (shared[index], "sharedString", index) if 0 <= index < len(shared) else ("", "unsupported", None)
    if kind in (None, "n", "str"):
        if cell.find(_S + "f") is not None:
            return "", "formula", None
        return raw, "string" if kind == "str" else "number", None
    return "", "unsupported", None


def xlsx_units(data: bytes) -> list[Unit]:
    """Cells with text of all sheets, hidden ones included."""
    package = open_package(data)
    check_xlsx(package)
    root = _shared(package)
    shared = [_joined(si) for si in root.findall(_S + "si")] if root is not None else []
    out = []
    for name in _sheets(package):
        for cell in read_part(package, name).iter(_S + "c"):
            text, storage, index = cell_text(cell, shared)
            if text.strip():
                out.append(Unit("cell", name, f"{name}!{cell.get('r')}", text, storage, index))
    return out


def redact_xlsx(data: bytes, replacements: dict[str, str], cells: dict[str, dict[str, str]] | None = None, drop_originals: bool = True) -> bytes:
    """Every occurrence of the values in cells becomes its marker; cells ('part!ref' -> values) limits this to some cells.

    A shared string is cloned for the cell that changes, so that others keep theirs;
    drop_originals then blanks shared strings that no cell refers to any more (without it the
    original value stays in the package).
    """
    package = open_package(data)
    check_xlsx(package)
    root = _shared(package)
    strings = root.findall(_S + "si") if root is not None else []
    shared = [_joined(si) for si in strings]
    changed: dict[str, bytes] = {}
    sheets = {name: read_part(package, name) for name in _sheets(package)}
    clones: dict[tuple[int, str], int] = {}
    for name, sheet in sheets.items():
        touched = False
        for cell in sheet.iter(_S + "c"):
            text, storage, index = cell_text(cell, shared)
            wanted = replacements if cells is None else cells.get(f"{name}!{cell.get('r')}", {})
            wanted = {r: m for r, m in wanted.items() if r and r in text}
            if not wanted or storage in ("formula", "unsupported"):
                continue
            touched = True
            if storage == "inlineStr":
                _replace_values(list(cell.find(_S + "is").iter(_S + "t")), wanted)
            elif storage == "sharedString":
                key = (index, repr(sorted(wanted.items())))
                if key not in clones:
                    clone = copy.deepcopy(strings[index])
                    _replace_values(list(clone.iter(_S + "t")), wanted)
                    root.append(clone)
                    clones[key] = len(root.findall(_S + "si")) - 1
                cell.find(_S + "v").text = str(clones[key])
            else:
                for raw, marker in wanted.items():
                    text = text.replace(raw, marker)
                for child in list(cell):
                    cell.remove(child)
                cell.set("t", "inlineStr")
                ET.SubElement(ET.SubElement(cell, _S + "is"), _S + "t").text = text
        if touched:
            changed[name] = _bytes(sheet)
    if clones:
        if drop_originals:
            used = {int(c.find(_S + "v").text) for s in sheets.values() for c in s.iter(_S + "c") if c.get("t") == "s" and c.find(_S + "v") is not None and (c.find(_S + "v").text or "").isdigit()}
            for i in {i for i, _ in clones} - used:
                for t in strings[i].iter(_S + "t"):
                    t.text = ""
        root.set("uniqueCount", str(len(root.findall(_S + "si"))))
        changed["xl/sharedStrings.xml"] = _bytes(root)
    return rewrite(data, changed) if changed else data


def _replace_values(nodes: list[ET.Element], replacements: dict[str, str]) -> None:
    for raw, marker in replacements.items():
        text, at = "".join(n.text or "" for n in nodes), 0
        while (at := text.find(raw, at)) >= 0:
            replace_range(nodes, at, at + len(raw), marker, keep_space=True)
            text, at = "".join(n.text or "" for n in nodes), at + len(marker)


def _property_path(name: str) -> bool:
    path = re.sub(r"\A(?:\./|/)+", "", name.replace("\\", "/"))
    return path == "docProps" or path.startswith("docProps/")


def strip_metadata(data: bytes) -> bytes:
    """The package without document properties, their relationships and content types."""
    if not data:
        return data
    package = _zip(data)
    names = package.namelist()
    if len(names) != len(set(names)):
        raise PackageError("two entries have one name")
    if not any(map(_property_path, names)):
        return data
    attribute = {"_rels/.rels": "Target", "[Content_Types].xml": "PartName"}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as to:
        for e in package.infolist():
            if _property_path(e.filename):
                continue
            raw = part_bytes(package, e.filename)
            if e.filename in attribute:
                root = read_part(package, e.filename)
                for child in list(root):
                    if _property_path(child.get(attribute[e.filename], "")):
                        root.remove(child)
                raw = _bytes(root)
            to.writestr(e, raw, compress_type=e.compress_type)
    done = out.getvalue()
    if any(map(_property_path, zipfile.ZipFile(io.BytesIO(done)).namelist())):
        raise PackageError("document properties are left")
    return done


def sanitize(name: str, data: bytes) -> bytes:
    """Metadata removal by the file's suffix; other files stay as they are."""
    suffix = name.lower().rpartition(".")[2]
    if suffix in ("docx", "xlsx"):
        return strip_metadata(data)
    if suffix == "pdf":
        from .pdf import strip_metadata as strip_pdf

        return strip_pdf(data)
    return data


def read_units(name: str, data: bytes) -> list[Unit]:
    suffix = name.lower().rpartition(".")[2]
    if suffix == "docx":
        return docx_units(data)
    if suffix == "xlsx":
        return xlsx_units(data)
    if suffix == "pdf":
        from .pdf import page_units

        return page_units(data)
    raise PackageError("the file type is not supported")


def redact_package(name: str, data: bytes, replacements: dict[str, str]) -> bytes:
    suffix = name.lower().rpartition(".")[2]
    if suffix == "docx":
        return redact_docx(data, replacements)
    if suffix == "xlsx":
        return redact_xlsx(data, replacements)
    if suffix == "pdf":
        from .pdf import redact as redact_pdf

        return redact_pdf(data, replacements)
    raise PackageError("the file type is not supported")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files as (doc_id, path, length, content, error), numbered in the order of their paths from 0.

    Files above MAX_PACKAGE and files of other types keep their row, with an error and no content:
    their bytes are not loaded, as both tests go to the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]*\z", 0))
    fits, known = F.col("length") <= MAX_PACKAGE, suffix.isin(*SUPPORTED)
    none = F.lit(None)
    loaded = files.filter(fits & known).select("path", "length", "content", none.cast("string").alias("error"))
    names = files.select("path", "length")  # without content, which is then not read
    refused = names.filter(~(fits & known)).select("path", "length", none.cast("binary").alias("content"), F.when(~known, "the file type is not supported").otherwise(TOO_LARGE).alias("error"))
    numbers = _numbered(names.select("path"))
    return loaded.unionByName(refused).join(numbers, "path").select("doc_id", "path", "length", "content", "error")


def _numbered(paths: DataFrame) -> DataFrame:
    """(path, doc_id): the rank of each path, by ranges of paths and their counts."""
    from ..operators.findings import ranks

    return ranks(paths, ["path"]).select("path", (F.col("rank") - 1).alias("doc_id"))


UNITS = "doc_id bigint, path string, unit_no int, kind string, part string, location string, storage string, shared_index int, text string, error string, warnings array<string>"


def _or_error(work: Callable[[], T]) -> tuple[T | None, str | None]:
    """What the work gives, or why it failed: one file never fails a job."""
    try:
        return work(), None
    except Exception as e:
        return None, str(e) if isinstance(e, PackageError) else f"{type(e).__name__}: {e}"


def _content(data: object) -> bytes:
    if data is None:
        raise PackageError("the file has no content")
    return bytes(data)


def warnings_of(name: str, data: bytes) -> list[str]:
    """Parts of a package that may hold text that is not looked at, or that cannot be read, as sentences."""
    if not name.lower().endswith((".docx", ".xlsx")):
        return []
    package = open_package(data)
    out = [f"{part} may hold text that is not looked at" for part in embedded_risks(package.namelist())]
    for part in _docx_parts(package) if name.lower().endswith(".docx") else []:
        if _story_part(package, part) is None:
            out.append(f"{part} cannot be read and stays as it is")
    return out


def document_units(files: DataFrame) -> DataFrame:
    """One row for each unit of each file; a file that cannot be read has one row with an error and no text.

    warnings names the file's parts that may hold text that is not looked at; a file without
    units, but with warnings, has a row as well. Errors that files bring along stay.
    """
    given = F.col("error") if "error" in files.columns else F.lit(None).cast("string").alias("error")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, path, data, error in zip(batch["doc_id"], batch["path"], batch["content"], batch["error"], strict=True):
                units, error = (None, error) if error else _or_error(lambda: (read_units(path, _content(data)), warnings_of(path, _content(data))))  # noqa: B023
                found, warnings = units or ([], None)
                rows += [(doc_id, path, i, u.kind, u.part, u.location, u.storage, u.shared_index, u.text, None, warnings) for i, u in enumerate(found)]
                if error or warnings and not found:
                    rows.append((doc_id, path, None, None, None, None, None, None, None, error, warnings))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in UNITS.split(", ")], dtype=object)
            yield frame.astype({"unit_no": "Int32", "shared_index": "Int32"})

    return files.select("doc_id", "path", "content", given).mapInPandas(run, UNITS)


def redact_documents(files: DataFrame, confirmed: DataFrame) -> DataFrame:
    """files (doc_id, path, content) and confirmed (doc_id, raw_value, marker, id) -> (doc_id, path, content, error).

    Metadata is removed as well. A file that cannot be redacted, whatever the reason, has an
    error and no content.
    """
    pairs = confirmed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("long").alias("n"), "raw_value", "marker"))).alias("_pairs"))
    given = F.col("error") if "error" in files.columns else F.lit(None).cast("string").alias("error")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, path, data, error, found in zip(batch["doc_id"], batch["path"], batch["content"], batch["error"], batch["_pairs"], strict=True):
                wanted = {p["raw_value"]: p["marker"] for p in (found if found is not None else [])}
                done, error = (None, error) if error else _or_error(lambda: sanitize(path, redact_package(path, _content(data), wanted)))  # noqa: B023
                rows.append((doc_id, path, done, error))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "content", "error"])

    return files.select("doc_id", "path", "content", given).join(pairs, "doc_id", "left").mapInPandas(run, "doc_id bigint, path string, content binary, error string")


def write_documents(redacted: DataFrame, folder: str, at: datetime) -> DataFrame:
    """Write the files of redact_documents under neutral names; return (doc_id, file, error).

    A name tells the time, which is an argument, and the document's number, never the original
    name. A file appears under its name when it is whole. Rows without content write nothing.
    """
    stamp = F.lit(at.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    suffix = F.regexp_extract("path", r"\.[^./]*\z", 0)
    name = F.regexp_replace(output_name(suffix, stamp), r"(\.[^.]*)\z", F.concat(F.lit("_"), F.col("doc_id").cast("string"), F.lit("$1")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))
        store.create_dir(top, recursive=True)
        for batch in batches:
            rows = []
            for doc_id, file, data, error in zip(batch["doc_id"], batch["file"], batch["content"], batch["error"], strict=True):
                if data is not None:
                    part = f"{top}/.{uuid.uuid4().hex}.part"
                    with store.open_output_stream(part) as out:
                        out.write(bytes(data))
                    store.move(part, f"{top}/{file}")
                rows.append((doc_id, file if data is not None else None, error))
            yield pd.DataFrame(rows, columns=["doc_id", "file", "error"])

    return redacted.select("doc_id", name.alias("file"), "content", "error").mapInPandas(run, "doc_id bigint, file string, error string")
