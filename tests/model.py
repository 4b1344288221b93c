"""A model of the recognizers in plain Python, which reads texts character by character, for differential tests."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

WEIGHTS = {"nip": [6, 5, 7, 2, 3, 4, 5, 6, 7], "regon": [8, 9, 2, 3, 4, 5, 6, 7], "regon14": [2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8], "pesel": [1, 3, 7, 9, 1, 3, 7, 9, 1, 3]}


def total(s, kind):
    return sum(int(c) * w for c, w in zip(s, WEIGHTS[kind]))


def nip(s):
    s = re.sub("[- ]", "", s)
    return bool(re.fullmatch("[0-9]{10}", s)) and total(s, "nip") % 11 == int(s[9])


def regon(s):
    s = re.sub("[- ]", "", s)
    if not re.fullmatch("[0-9]{9}|[0-9]{14}", s) or total(s, "regon") % 11 % 10 != int(s[8]):
        return False
    return len(s) == 9 or total(s, "regon14") % 11 % 10 == int(s[13])


def pesel(s):
    s = re.sub("[- ]", "", s)
    return bool(re.fullmatch("[0-9]{11}", s)) and -total(s, "pesel") % 10 == int(s[10])


def id_card(s):
    s = re.sub("[- ]", "", s).upper()
    return bool(re.fullmatch("[A-Z]{3}[0-9]{6}", s)) and sum((ord(c) - (55 if i < 3 else 48)) * w for i, (c, w) in enumerate(zip(s, [7, 3, 1, 9, 7, 3, 1, 7, 3]))) % 10 == 0


def iban(s):
    s = s.replace(" ", "").upper()
    s = s if s.startswith("PL") else "PL" + s
    return bool(re.fullmatch("[A-Z0-9]{28}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def near(text, at, words, window):
    part = text[max(0, at - window) : at + window].lower()
    return any(w in part for w in words)


def with_check(kind, length, n):
    """Made-up digits with a right check digit, or None where the rule gives 10."""
    body = str(n).zfill(length - 1)[-(length - 1) :]
    for d in "0123456789":
        if {"nip": nip, "regon": regon, "pesel": pesel}[kind](body + d):
            return body + d
    return None


def account(n):
    body = str(n).zfill(24)[-24:]
    return f"{98 - int(body + '252100') % 97:02d}{body}"


SMALL = "abcdefghijklmnopqrstuvwxyz"
PREFIXES: set[str] = set()


def at(text, i):
    """The character there; outside of the text one that is nothing."""
    return text[i] if 0 <= i < len(text) else "\0"


def is_word(c):
    return c.isalnum() or c == "_"


def is_space(c):
    return c.isspace()


def capital(c):
    return c in SMALL.upper()


def latin(c):
    return c.lower() in SMALL and len(c.lower()) == 1


def capital_or_figure(c):
    return capital(c) or c in "0123456789"


def everywhere(text: str, read: Callable[[int], tuple[int, int, int] | None]) -> Iterator[tuple[int, int, int]]:
    """What read(i) finds, from left to right, each behind the one before: (start, end, where the next may begin)."""
    i = 0
    while i < len(text):
        found = read(i)
        if found:
            yield found
        i = max(i + 1, found[2]) if found else i + 1


def figures(text, i, groups, may_stand):
    """Where groups of digits end, one character that may_stand between two groups or none; None if they are not there."""
    for k, n in enumerate(groups):
        if k and may_stand(at(text, i)) and at(text, i + 1).isdecimal():
            i += 1
        for _ in range(n):
            if not at(text, i).isdecimal():
                return None
            i += 1
    return i


def loose(text, n, may_stand):
    """Numbers of n digits with at most one character between any two, no digit beside them."""

    def read(i):
        end = None if at(text, i - 1).isdecimal() else figures(text, i, [1] * n, may_stand)
        return (i, end, end) if end and not at(text, end).isdecimal() else None

    return everywhere(text, read)


def whole(text, lengths):
    """Words that are digits only, of one of these lengths."""

    def read(i):
        if is_word(at(text, i - 1)) or not at(text, i).isdecimal():
            return None
        end = i
        while is_word(at(text, end)):
            end += 1
        return (i, end, end) if end - i in lengths and text[i:end].isdecimal() else None

    return everywhere(text, read)


def accounts(text, coded):
    """Two digits and six times four, with a blank between the groups or none, and a blank before a word that follows."""

    def read(i):
        if is_word(at(text, i - 1)):
            return None
        start = i
        if coded:
            if text[i : i + 2].upper() != "PL":
                return None
            i += 2
            while is_space(at(text, i)):
                i += 1
        end = figures(text, i, [2, *[4] * 6], is_space)
        if end is None:
            return None
        if is_space(at(text, end)) and is_word(at(text, end + 1)):
            end += 1
        elif is_word(at(text, end)):
            return None
        return start, end, end

    return everywhere(text, read)


def abroad(text):
    def read(i):
        if text[i : i + 3] != "+48":
            return None
        end = i + 3
        end += is_space(at(text, end)) or at(text, end) in ".-"
        for _ in range(9):
            if not at(text, end).isdecimal():
                return None
            end += 1
            end += is_space(at(text, end)) or at(text, end) in "().-"
        return i, end, end

    return everywhere(text, read)


def local(text):
    def read(i):
        if at(text, i - 1).isdecimal():
            return None
        for groups in ((3, 3, 3), (2, 3, 2, 2)):
            end = figures(text, i, groups, lambda c: is_space(c) or c in ".-")
            if end and not at(text, end).isdecimal():
                return i, end, end
        return None

    return everywhere(text, read)


def papers(text, letters, digits):
    """Capitals, blanks and digits, no capital or figure beside them."""

    def read(i):
        if capital_or_figure(at(text, i - 1)) or not all(capital(at(text, i + k)) for k in range(letters)):
            return None
        j = i + letters
        while is_space(at(text, j)):
            j += 1
        end = figures(text, j, [digits], is_space)
        return (i, end, end) if end and not capital_or_figure(at(text, end)) else None

    return everywhere(text, read)


def plates(text):
    """(start, end, letters before, what follows) of all that has a plate's shape."""
    parts = {}
    edge = lambda c: latin(c) or c in "0123456789ĄĆĘŁŃÓŚŹŻąćęłńóśźż"

    def read(i):
        if edge(at(text, i - 1)):
            return None
        for n in (3, 2):
            if not all(latin(at(text, i + k)) for k in range(n)):
                continue
            for gap in (1, 0) if at(text, i + n) in " \t-" else (0,):
                begin = i + n + gap
                for m in (5, 4):
                    tail = text[begin : begin + m]
                    if len(tail) == m and all(latin(c) or c in "0123456789" for c in tail) and not edge(at(text, begin + m)):
                        parts[i] = (text[i : i + n], tail)
                        return i, begin + m, begin + m
        return None

    return [(a, b, *parts[a]) for a, b, _ in everywhere(text, read)]


def labelled(text, labels):
    """Values after a label and perhaps a mark: 5 to 31 characters that end where a word does."""

    def read(i):
        if is_word(at(text, i - 1)):
            return None
        for label in labels:
            if text[i : i + len(label)].lower() != label:
                continue
            j = i + len(label)
            while is_space(at(text, j)):
                j += 1
            if at(text, j) in ":#-":
                j += 1
                while is_space(at(text, j)):
                    j += 1
            if not (latin(at(text, j)) or at(text, j) in "0123456789"):
                continue
            end = j + 1
            while end - j < 31 and (latin(at(text, end)) or at(text, end) in "0123456789./_-"):
                end += 1
            while end - j >= 5:
                if is_word(at(text, end - 1)) != is_word(at(text, end)):
                    return j, end, end
                end -= 1
        return None

    return everywhere(text, read)


def mails(text):
    def read(i):
        if is_word(at(text, i - 1)) or at(text, i - 1) in ".+-":
            return None
        mark = i
        while latin(at(text, mark)) or at(text, mark) in "0123456789._%+-":
            mark += 1
        if mark == i or at(text, mark) != "@":
            return None
        end = mark + 1
        while latin(at(text, end)) or at(text, end) in "0123456789.-":
            end += 1
        for dot in range(end - 3, mark + 1, -1):
            if text[dot] == "." and latin(at(text, dot + 1)) and latin(at(text, dot + 2)):
                stop = dot + 1
                while stop < dot + 64 and latin(at(text, stop)):
                    stop += 1
                return i, stop, stop
        return None

    return everywhere(text, read)


def bare(value):
    """The value without blanks, dots and dashes."""
    return "".join(c for c in value if not is_space(c) and c not in ".-")


def spans(text):
    """(type, start, end, score) of the recognizers by pattern, in no order."""
    out = set()

    def add(kind, a, b, words=(), window=0, *, seen, else_=None):
        score = seen if not words or near(text, a, words, window) else else_
        if score is not None:
            out.add((kind, a, b, score))

    for a, b, _ in loose(text, 10, lambda c: is_space(c) or c == "-"):
        if nip(bare(text[a:b])):
            add("PL_NIP", a, b, ["nip", "n.i.p.", "numer identyfikacji podatkowej"], 200, seen=0.99, else_=0.8)
    for a, b, _ in whole(text, (9, 14)):
        if regon(text[a:b]):
            add("PL_REGON", a, b, ["regon", "r.e.g.o.n.", "rejestr podmiotów"], 250, seen=0.99)
    for a, b, _ in loose(text, 10, lambda c: c in " \t-"):
        if not nip(bare(text[a:b])):
            add("PL_KRS", a, b, ["krs", "rejestr sądowy"], 300, seen=0.98, else_=0.8 if text[a] == "0" else None)
    for a, b, _ in whole(text, (11,)):
        if pesel(text[a:b]):
            add("PL_PESEL", a, b, ["pesel"], 150, seen=0.99, else_=0.6)
    for a, b, _ in accounts(text, True):
        if iban(bare(text[a:b])):
            add("BANK_ACCOUNT", a, b, seen=1.0)
    for a, b, _ in accounts(text, False):
        if iban(bare(text[a:b])):
            add("BANK_ACCOUNT", a, b, ["rachunek", "konto", "iban", "nrb", "przelew", "wypłaty"], 155, seen=0.99, else_=0.6)
    for a, b, _ in abroad(text):
        add("PHONE_NUMBER", a, b, seen=0.95)
    for a, b, _ in local(text):
        if not regon(bare(text[a:b])):
            add("PHONE_NUMBER", a, b, ["tel", "kom.", "komórka", "kontakt", "fax", "mobile"], 120, seen=0.85)
    for a, b, _ in papers(text, 3, 6):
        if id_card(bare(text[a:b])):
            add("PL_ID_CARD", a, b, seen=0.99)
    for a, b, _ in papers(text, 2, 7):
        add("PL_PASSPORT", a, b, ["paszport", "seria i numer"], 150, seen=0.9, else_=0.6)
    for a, b, letters, tail in plates(text):
        if letters.upper() in PREFIXES and any(c in "0123456789" for c in tail) and len(tail) == 5:
            words = ["nr rejestracyjny", "nr rej.", "rejestracja", "pojazd", "samochód", "tablica"]
            add("LICENSE_PLATE", a, b, words, 150, seen=0.9, else_=0.6 if letters == letters.upper() else None)
    for kind, labels in (("POLICY_NUMBER", ("polisa", "nr polisy", "numer polisy")), ("CLAIM_NUMBER", ("szkoda", "nr szkody", "numer szkody", "roszczenie"))):
        for a, b, _ in labelled(text, labels):
            add(kind, a, b, seen=0.9)
    for a, b, _ in mails(text):
        add("EMAIL_ADDRESS", a, b, seen=0.98)
    return out
