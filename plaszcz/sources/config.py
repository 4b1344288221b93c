"""Rule data: what ships with the library, and readers of dictionaries and rule files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

# Marker texts of the entity types.
MARKERS = {
    "PERSON": "[OSOBA_{}]", "ORGANIZATION": "[FIRMA_{}]", "ADDRESS": "[ADRES_{}]", "LOCATION": "[LOKALIZACJA_{}]", "EMAIL_ADDRESS": "[EMAIL_{}]",
    "PHONE_NUMBER": "[TELEFON_{}]", "PL_NIP": "[NIP_{}]", "PL_KRS": "[KRS_{}]", "PL_REGON": "[REGON_{}]", "PL_PESEL": "[PESEL_{}]",
    "BANK_ACCOUNT": "[RACHUNEK_{}]", "LICENSE_PLATE": "[REJESTRACJA_{}]", "PL_ID_CARD": "[DOWOD_{}]", "PL_PASSPORT": "[PASZPORT_{}]",
    "POLICY_NUMBER": "[POLISA_{}]", "CLAIM_NUMBER": "[SZKODA_{}]",
}

# Legal forms of organisations.
LEGAL_FORMS = (
    "spółka jawna", "sp. j.", "sp.j.", "sp j",
    "spółka partnerska", "sp. p.", "sp.p.", "sp p",
    "spółka komandytowa", "sp. k.", "sp.k.", "sp k",
    "spółka komandytowo-akcyjna", "S.K.A.", "S.K.A", "SKA", "sp.k.a.",
    "spółka z ograniczoną odpowiedzialnością", "sp. z o.o.", "sp. z o.o", "sp z o.o.", "sp z oo",
    "prosta spółka akcyjna", "P.S.A.", "P.S.A", "PSA",
    "spółka akcyjna", "S.A.", "S.A", "SA",
    "fundacja", "stowarzyszenie", "TUW", "TUiR",
)

# First letters of vehicle registration plates.
PLATE_PREFIXES = (
    "B", "C", "CB", "CG", "CR", "CS", "CT", "CW", "D", "DB", "DJ", "DL", "DW", "DZ", "E", "EK", "EL", "F", "FG", "FS", "FZ", "G", "GA", "GD",
    "GS", "GZ", "H", "K", "KR", "L", "LU", "N", "O", "OK", "OP", "P", "PO", "PZ", "R", "RZ", "S", "SK", "T", "TK", "W", "WA", "WB", "WD",
    "WE", "WF", "WH", "WI", "WJ", "WK", "WN", "WP", "WR", "WS", "WT", "WU", "WW", "WX", "WY", "WZ", "Z", "ZA", "ZK", "ZS",
)

# Voivodeships.
VOIVODESHIPS = (
    "dolnośląskie", "kujawsko-pomorskie", "lubelskie", "lubuskie", "mazowieckie", "małopolskie", "opolskie", "podkarpackie", "podlaskie",
    "pomorskie", "warmińsko-mazurskie", "wielkopolskie", "zachodniopomorskie", "łódzkie", "śląskie", "świętokrzyskie",
)

# Rules of policy and claim numbers, whose group 1 is the number.
POLICY_RULES = (r"(?i)\b(?:polisa|nr polisy|numer polisy)\s*[:#-]?\s*([A-Z0-9][A-Z0-9./_-]{4,30})\b",)
CLAIM_RULES = (r"(?i)\b(?:szkoda|nr szkody|numer szkody|roszczenie)\s*[:#-]?\s*([A-Z0-9][A-Z0-9./_-]{4,30})\b",)

# Values that are never reported, and the legal forms of a rule file without any.
ALLOWLIST = ("Jan Kowalski",)
FALLBACK_FORMS = ("sp. z o.o.", "s.a.", "spółka akcyjna", "sp. k.")


@dataclass(frozen=True)
class Rules:
    """All rule data of a detection. Dictionary values are upper case; the large ones ship empty."""

    legal_forms: tuple[str, ...] = LEGAL_FORMS
    plate_prefixes: tuple[str, ...] = PLATE_PREFIXES
    policy_rules: tuple[str, ...] = POLICY_RULES
    claim_rules: tuple[str, ...] = CLAIM_RULES
    allowlist: tuple[str, ...] = ALLOWLIST
    markers: dict[str, str] = field(default_factory=lambda: dict(MARKERS))
    first_names: frozenset[str] = frozenset()
    surnames: frozenset[str] = frozenset()
    voivodeships: frozenset[str] = frozenset(v.upper() for v in VOIVODESHIPS)
    counties: frozenset[str] = frozenset()
    communes: frozenset[str] = frozenset()
    localities: frozenset[str] = frozenset()
    streets: frozenset[str] = frozenset()


def upper_set(values: Iterable[str]) -> frozenset[str]:
    return frozenset(v for v in (x.strip().upper() for x in values if x) if v)


def read_lines(path: str | Path) -> frozenset[str]:
    """One value a line, trimmed, upper case; a missing file is an empty dictionary."""
    p = Path(path)
    return upper_set(p.read_text(encoding="utf-8").split("\n")) if p.exists() else frozenset()


def read_first_column(path: str | Path) -> frozenset[str]:
    """First column of a semicolon CSV file with a header; a missing file is an empty dictionary."""
    import csv

    p = Path(path)
    if not p.exists():
        return frozenset()
    with p.open(encoding="utf-8", newline="") as f:
        return upper_set(row[0] for i, row in enumerate(csv.reader(f, delimiter=";")) if i and row)


def read_rule_file(path: str | Path) -> dict:
    """A rule file: mappings, lists and scalars of YAML's plain block form, and lists in brackets.

    Anything else that YAML knows (anchors, tags, text blocks, mappings in braces) is a ValueError.
    """
    lines = []
    for number, raw in enumerate(Path(path).read_text(encoding="utf-8-sig").splitlines(), 1):
        text = _without_comment(raw)
        if text.strip() and text.strip() != "---":
            if "\t" in text[: len(text) - len(text.lstrip())]:
                raise ValueError(f"{path}, line {number}: a tab indents")
            lines.append((len(text) - len(text.lstrip()), text.strip(), f"{path}, line {number}"))
    value, rest = _block(lines, lines[0][0]) if lines else ({}, [])
    if rest or not isinstance(value, dict):
        raise ValueError(f"{path} is no mapping" if not rest else f"{rest[0][2]}: unexpected indentation")
    return value


def _without_comment(line: str) -> str:
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and not (quote == '"' and line[i - 1] == "\\") else quote
        elif c in "\"'" and (not line[:i].strip() or line[i - 1] in " [,"):
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i].rstrip()
    return line.rstrip()


def _block(lines: list[tuple[int, str, str]], indent: int) -> tuple[object, list]:
    """The value that the lines of one indentation make, and the lines after it."""
    is_list = lines[0][1].startswith("- ") or lines[0][1] == "-"
    out: list | dict = [] if is_list else {}
    while lines and lines[0][0] == indent and (lines[0][1].startswith("- ") or lines[0][1] == "-") == is_list:
        _, text, where = lines[0]
        lines = lines[1:]
        if is_list:
            inner = text[1:].strip()
            if _KEY.match(inner):  # a mapping that begins beside the dash
                at = indent + len(text) - len(inner)
                value, lines = _block([(at, inner, where), *lines], at)
            elif inner:
                value = _scalar(inner, where)
            else:
                value, lines = _block(lines, lines[0][0]) if lines and lines[0][0] > indent else (None, lines)
            out.append(value)
            continue
        m = _KEY.match(text)
        if not m:
            raise ValueError(f"{where}: no key")
        key, rest = str(_scalar(m[1], where)), text[m.end() :].strip()
        if rest:
            out[key] = _scalar(rest, where)
        elif lines and (lines[0][0] > indent or lines[0][0] == indent and lines[0][1].startswith("- ")):
            out[key], lines = _block(lines, lines[0][0])
        else:
            out[key] = None
    return out, lines


_KEY = re.compile(r"(\"[^\"]*\"|'[^']*'|[^\s\"'\[\]{}#&*!|>%@`-][^:]*?)\s*:(?=\s|$)")


def _scalar(text: str, where: str) -> object:
    if text[0] == "[" and text[-1] == "]":
        return [_scalar(x.strip(), where) for x in _ITEM.findall(text[1:-1]) if x.strip()]
    if text[0] == '"' and text[-1] == '"' and len(text) > 1:
        try:
            return json.loads(text)
        except ValueError as e:
            raise ValueError(f"{where}: {e}") from e
    if text[0] == "'" and text[-1] == "'" and len(text) > 1:
        return text[1:-1].replace("''", "'")
    if text[0] in "\"'[{&*!|>%@`":
        raise ValueError(f"{where}: {text!r} is beyond the plain form of rule files")
    return None if text in ("~", "null") else text


_ITEM = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^,]+")


def load_rules(folder: str | Path) -> Rules:
    """Rules of a folder of dictionaries and YAML files; what a folder lacks keeps its shipped value.

    Large dictionaries (names, places, streets) that are missing stay empty. A rule whose
    regular expression Java cannot compile fails when the query is planned.
    """
    at = Path(folder)
    given: dict = {}
    for name, file in (("first_names", "first_names.csv"), ("surnames", "surnames.csv")):
        given[name] = read_first_column(at / file)
    for name in ("counties", "communes", "localities", "streets"):
        given[name] = read_lines(at / f"{name}.txt")
    for name, file in (("voivodeships", "voivodeships.txt"), ("plate_prefixes", "vehicle_prefixes.txt")):
        if (at / file).exists():
            values = read_lines(at / file)
            given[name] = tuple(sorted(values)) if name == "plate_prefixes" else values
    if (at / "legal_forms.yml").exists():
        forms = [n for e in read_rule_file(at / "legal_forms.yml").get("legal_forms") or [] for n in e.get("names", [])]
        given["legal_forms"] = tuple(forms) or FALLBACK_FORMS
    if (at / "allowlist.yml").exists():
        given["allowlist"] = tuple(v for v in read_rule_file(at / "allowlist.yml").get("allowlist") or [] if v)
    for name, file in (("policy_rules", "policy_numbers.yml"), ("claim_rules", "claim_numbers.yml")):
        if (at / file).exists():
            given[name] = tuple(r["regex"] for r in read_rule_file(at / file).get("rules") or [] if "regex" in r)
    if (at.parent / "entity_types.yaml").exists():
        given["markers"] = read_rule_file(at.parent / "entity_types.yaml").get("entity_types") or dict(MARKERS)
    return Rules(**given)


def startup_check(folder: str | Path, sources: Iterable[str] = ("first_names_source.csv", "surnames_source.csv", "SIMC.csv"), made: Iterable[str] = ("first_names.csv", "surnames.csv", "localities.txt"), build=None) -> None:
    """Raise unless all source files are there and all dictionaries are, after one try of build()."""
    at = Path(folder)
    if missing := [s for s in sources if not (at / s).exists()]:
        raise FileNotFoundError(f"source files are missing: {', '.join(missing)}")
    if any(not (at / m).exists() for m in made) and build:
        build()
    if missing := [m for m in made if not (at / m).exists()]:
        raise FileNotFoundError(f"dictionaries are missing: {', '.join(missing)}")
