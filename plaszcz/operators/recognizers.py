"""Recognizers by pattern, checksum and context, as native columns.

Each takes a text column and gives an array of spans. Patterns follow Unicode classes; the
flags (?U) and (?iu) give Java's classes and case folding that meaning.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checksums as chk
from ..functions.spans import SPANS, hits, spans
from ..functions.text import near
from ..sources.config import Rules

_PL = "A-Za-zĄĆĘŁŃÓŚŹŻąćęłńóśźż"
# Words near a number that say what it is.
CONTEXT = {
    "nip": ("nip", "n.i.p.", "numer identyfikacji podatkowej"),
    "regon": ("regon", "r.e.g.o.n.", "rejestr podmiotów"),
    "krs": ("krs", "krajowy rejestr sądowy", "rejestr sądowy", "nr krs", "numer krs"),
    "pesel": ("pesel", "nr pesel", "numer pesel"),
    "phone": ("tel", "telefon", "kom.", "komórka", "kontakt", "fax", "mobile", "tel."),
    "passport": ("paszport", "paszportu", "nr paszportu", "seria i numer"),
    "plate": ("nr rejestracyjny", "nr rej.", "rejestracja", "pojazd", "samochód", "tablica"),
    "bank": ("rachunek", "konto", "iban", "nrb", "przelew", "nr konta", "wypłaty"),
}

# The patterns of numbers below are fixed as well: they say how each number is written.


def _digits(raw: Column, separators: str) -> Column:
    return F.regexp_replace(raw, separators, "")


def nip(text: Column) -> Column:
    # only ASCII digits validate, so a text without ten of them close together has no NIP
    found = hits(text, r"(?U)(?<!\d)\d(?:[\s-]?\d){9}(?!\d)", guard=r"[0-9](?:[^0-9A-Za-z]?[0-9]){9}")
    return spans(found, "PL_NIP", "nip", lambda h: F.when(chk.nip_valid(_digits(h["raw"], r"(?U)[\s-]")), F.when(near(text, h["start"], CONTEXT["nip"], 200), 0.99).otherwise(0.80)))


def regon(text: Column) -> Column:
    found = hits(text, r"(?U)\b(?:\d{9}|\d{14})\b", guard=r"[0-9]{9}")
    return spans(found, "PL_REGON", "regon", lambda h: F.when(chk.regon_valid(h["raw"]), F.when(near(text, h["start"], CONTEXT["regon"], 250), 0.99)))


def krs(text: Column) -> Column:
    found = hits(text, r"(?U)(?<!\d)\d(?:[ \t-]?\d){9}(?!\d)", guard=r"\p{Nd}(?:[ \t-]?\p{Nd}){9}")

    def score(h: Column) -> Column:
        digits = _digits(h["raw"], r"[ \t-]")
        return F.when(~chk.nip_valid(digits), F.when(near(text, h["start"], CONTEXT["krs"], 300), 0.98).when(digits.startswith("0"), 0.80))

    return spans(found, "PL_KRS", "krs", score)


def pesel(text: Column) -> Column:
    found = hits(text, r"(?U)\b\d{11}\b", guard=r"[0-9]{11}")
    return spans(found, "PL_PESEL", "pesel", lambda h: F.when(chk.pesel_valid(h["raw"]), F.when(near(text, h["start"], CONTEXT["pesel"], 150), 0.99).otherwise(0.60)))


_ACCOUNT = r"\d{2}\s?(?:\d{4}\s?){6}"
# only ASCII digits validate
_FOUR_DIGITS = r"[0-9]{4}[^0-9]?[0-9]{4}[^0-9]?[0-9]{4}"


def bank_account(text: Column) -> Column:
    """With the country code (score 1), and the bare number."""
    coded = spans(hits(text, rf"(?iU)\bPL\s*{_ACCOUNT}\b", guard=_FOUR_DIGITS), "BANK_ACCOUNT", "iban", lambda h: F.when(chk.iban_valid(_digits(h["raw"], r"(?U)\s")), 1.00))

    def score(h: Column) -> Column:
        bare = _digits(h["raw"], r"(?U)\s")
        return F.when((F.length(bare) == 26) & chk.iban_valid(bare), F.when(near(text, h["start"], CONTEXT["bank"], 155), 0.99).otherwise(0.60))

    return F.concat(coded, spans(hits(text, rf"(?U)\b{_ACCOUNT}\b", guard=_FOUR_DIGITS), "BANK_ACCOUNT", "nrb", score))


def phone(text: Column) -> Column:
    """International numbers of +48, and local ones near a word for telephone."""
    abroad = spans(hits(text, r"(?U)\+48[\s.-]?(?:\d[\s().-]?){9}", guard=r"\+48"), "PHONE_NUMBER", "phone", lambda h: F.lit(0.95))
    found = hits(text, r"(?U)(?<!\d)(?:\d{3}[\s.-]?\d{3}[\s.-]?\d{3}|\d{2}[\s.-]?\d{3}[\s.-]?\d{2}[\s.-]?\d{2})(?!\d)", guard=r"\p{Nd}{2}[^\p{Nd}]?\p{Nd}{3}|\p{Nd}{3}[^\p{Nd}]\p{Nd}{3}")
    # nine digits can be a REGON but neither a NIP nor a PESEL
    local = spans(found, "PHONE_NUMBER", "phone", lambda h: F.when(~chk.regon_valid(_digits(h["raw"], r"(?U)[\s.-]")) & near(text, h["start"], CONTEXT["phone"], 120), 0.85))
    return F.concat(abroad, local)


def id_card(text: Column) -> Column:
    found = hits(text, r"(?U)(?<![A-Z0-9])[A-Z]{3}\s*\d{6}(?![A-Z0-9])", guard=r"[0-9]{6}")
    return spans(found, "PL_ID_CARD", "identity", lambda h: F.when(chk.id_card_valid(_digits(h["raw"], r"(?U)\s")), 0.99))


def passport(text: Column) -> Column:
    found = hits(text, r"(?U)(?<![A-Z0-9])[A-Z]{2}\s*\d{7}(?![A-Z0-9])", guard=r"\p{Nd}{7}")
    return spans(found, "PL_PASSPORT", "identity", lambda h: F.when(near(text, h["start"], CONTEXT["passport"], 150), 0.90).otherwise(0.60))


def plate(text: Column, prefixes: Sequence[str]) -> Column:
    """A known prefix, an optional separator and a rest with a digit.

    A prefix of two letters takes a rest of five characters. Without a separator a third
    letter would belong to the prefix, so the rest begins with a digit there. Letters in
    lower case need the context.
    """
    two = "|".join(sorted({p.upper() for p in prefixes if len(p) == 2}))
    three = "|".join(sorted({p.upper() for p in prefixes if len(p) == 3}))
    forms = ([rf"(?:{two})(?:[ \t-]|(?=[0-9]))(?=[A-Z]*[0-9])[A-Z0-9]{{5}}"] if two else []) + ([rf"(?:{three})[ \t-]?(?=[A-Z]*[0-9])[A-Z0-9]{{4,5}}"] if three else [])
    if not forms:
        return F.array().cast(SPANS)
    edge = "A-ZĄĆĘŁŃÓŚŹŻ0-9"
    found = hits(text, rf"(?iu)(?<![{edge}])(?:{'|'.join(forms)})(?![{edge}])", guard="[A-Za-zſ\u212a]{2}[ \t-]?[A-Za-zſ\u212a]{0,4}[0-9]")

    def score(h: Column) -> Column:
        letters = F.regexp_extract(h["raw"], r"(?iu)\A[A-Z]{2,3}", 0)
        return F.when(near(text, h["start"], CONTEXT["plate"], 150), 0.90).when(letters == F.upper(letters), 0.60)

    return spans(found, "LICENSE_PLATE", "plate", score)


def custom(text: Column, entity_type: str, patterns: Sequence[str], score: float = 0.90) -> Column:
    """Rules given as regular expressions; group 1 is the value if there is one."""
    parts = []
    for p in patterns:
        group = 1 if re.compile(p).groups else 0
        flag = re.match(r"\(\?([a-z]+)\)", p)
        java = p if not flag else f"(?{flag[1]}uU)" + p[flag.end() :]
        parts.append(spans(hits(text, java, group), entity_type, "custom", lambda h: F.lit(score)))
    return F.concat(*parts) if parts else F.array().cast(SPANS)


# What a line of an organization's name consists of besides letters and digits, and how long it is at most.
_NAME_MARKS, _NAME_LENGTH = "_-+&'\"„”().,/ \t", 120


def _any_of(characters: str) -> str:
    return "[" + "".join("\\" + c if c in "\\]-^[&" else c for c in characters) + "]"


def organization(text: Column, legal_forms: Sequence[str]) -> Column:
    """A name of one or two lines before a legal form; the longest form wins.

    organization = name, blanks, form; name = line, [line feed, line]; line = letter or digit, then
    as few letters, digits and marks as will do. Neither letter nor digit stands at either end, and any
    blanks may stand for a space of the form.
    """
    if not legal_forms:
        return F.array().cast(SPANS)
    blanks, few, solid = r"[ \t\r\n]+", r"[ \t]*", f"[{_PL}0-9]"
    line = solid + f"(?:{solid}|{_any_of(_NAME_MARKS)}){{1,{_NAME_LENGTH}}}?"
    by_length = sorted(legal_forms, key=lambda form: -len(form))
    form = "(?:" + "|".join(blanks.join(f"\\Q{word}\\E" for word in f.split(" ")) for f in by_length) + f")(?!{solid})"
    name = f"(?<!{solid}){line}(?:{few}\\r?\\n{few}{line})?"
    found = hits(text, f"(?iu){name}{blanks}{form}", guard=f"(?iu)[ \\t\\r\\n]{form}")
    return spans(found, "ORGANIZATION", "organization", lambda h: F.lit(0.92))


def email(text: Column) -> Column:
    return spans(hits(text, r"(?iU)(?<![\w.+-])[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,63}", guard="@"), "EMAIL_ADDRESS", "email", lambda h: F.lit(0.98))


@dataclass(frozen=True)
class Recognizer:
    """Spans of one or more entity types; registration order breaks ties."""

    name: str
    entity_types: tuple[str, ...]
    find: Callable[[Column, Rules], Column]


_ALL: list[Recognizer] = [
    Recognizer("nip", ("PL_NIP",), lambda t, r: nip(t)),
    Recognizer("regon", ("PL_REGON",), lambda t, r: regon(t)),
    Recognizer("krs", ("PL_KRS",), lambda t, r: krs(t)),
    Recognizer("pesel", ("PL_PESEL",), lambda t, r: pesel(t)),
    Recognizer("bank", ("BANK_ACCOUNT",), lambda t, r: bank_account(t)),
    Recognizer("phone", ("PHONE_NUMBER",), lambda t, r: phone(t)),
    Recognizer("id_card", ("PL_ID_CARD",), lambda t, r: id_card(t)),
    Recognizer("passport", ("PL_PASSPORT",), lambda t, r: passport(t)),
    Recognizer("plate", ("LICENSE_PLATE",), lambda t, r: plate(t, r.plate_prefixes)),
    Recognizer("policy", ("POLICY_NUMBER",), lambda t, r: custom(t, "POLICY_NUMBER", r.policy_rules)),
    Recognizer("claim", ("CLAIM_NUMBER",), lambda t, r: custom(t, "CLAIM_NUMBER", r.claim_rules)),
    Recognizer("organization", ("ORGANIZATION",), lambda t, r: organization(t, r.legal_forms)),
    Recognizer("email", ("EMAIL_ADDRESS",), lambda t, r: email(t)),
]


def registered() -> list[Recognizer]:
    return list(_ALL)


def register_recognizer(name: str, entity_type: str, pattern: str, score: float = 0.90, validator: Callable[[Column], Column] | None = None, context: Sequence[str] = (), window: int = 150, context_score: float | None = None) -> Recognizer:
    """Add a recognizer by pattern; validator takes the matched text, context raises the score (or, without context_score, is required)."""

    def find(text: Column, rules: Rules) -> Column:
        def rate(h: Column) -> Column:
            base = F.lit(score)
            if context:
                seen = near(text, h["start"], context, window)
                base = F.when(seen, context_score).otherwise(score) if context_score is not None else F.when(seen, score)
            return F.when(validator(h["raw"]), base) if validator else base

        return spans(hits(text, pattern), entity_type, name, rate)

    made = Recognizer(name, (entity_type,), find)
    _ALL[:] = [r for r in _ALL if r.name != name] + [made]
    return made


def unregister_recognizer(name: str) -> None:
    _ALL[:] = [r for r in _ALL if r.name != name]
