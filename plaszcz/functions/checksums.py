"""Check digits of Polish identifiers as native columns.

Every function takes a string column and gives a boolean, false for null. Digits are 0-9;
other Unicode digits, which some regular expressions admit, never validate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of the check digits.
NIP_WEIGHTS = (6, 5, 7, 2, 3, 4, 5, 6, 7)
REGON9_WEIGHTS = (8, 9, 2, 3, 4, 5, 6, 7)
REGON14_WEIGHTS = (2, 4, 8, 5, 0, 9, 7, 3, 6, 1, 2, 4, 8)
PESEL_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
ID_CARD_WEIGHTS = (7, 3, 1, 9, 7, 3, 1, 7, 3)


def _digit(s: Column, i: int) -> Column:
    return F.ascii(F.substring(s, i + 1, 1)) - 48


def _weighted(s: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        if w:
            total = total + _digit(s, i) * w
    return total


def _only_if(shape: Column, test: Column) -> Column:
    return F.coalesce(F.when(shape, test), F.lit(False))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def without(s: Column, characters: str) -> Column:
    return F.translate(s, characters, "")


def nip_valid(value: Column) -> Column:
    return let(without(value, "- "), lambda s: _only_if(s.rlike(r"\A[0-9]{10}\z"), _weighted(s, NIP_WEIGHTS) % 11 == _digit(s, 9)))


def _regon_digit(s: Column, weights: tuple[int, ...]) -> Column:
    return _weighted(s, weights) % 11 % 10 == _digit(s, len(weights))


def regon_valid(value: Column) -> Column:
    def valid(s: Column) -> Column:
        nine = _regon_digit(s, REGON9_WEIGHTS)
        return _only_if(s.rlike(r"\A(?:[0-9]{9}|[0-9]{14})\z"), nine & ((F.length(s) == 9) | _regon_digit(s, REGON14_WEIGHTS)))

    return let(without(value, "- "), valid)


def pesel_valid(value: Column) -> Column:
    return let(without(value, "- "), lambda s: _only_if(s.rlike(r"\A[0-9]{11}\z"), (10 - _weighted(s, PESEL_WEIGHTS) % 10) % 10 == _digit(s, 10)))


def id_card_valid(value: Column) -> Column:
    def valid(s: Column) -> Column:
        total = F.lit(0)
        for i, w in enumerate(ID_CARD_WEIGHTS):
            code = F.ascii(F.substring(s, i + 1, 1))
            total = total + (code - (55 if i < 3 else 48)) * w
        return _only_if(s.rlike(r"\A[A-Z]{3}[0-9]{6}\z"), total % 10 == 0)

    return let(F.upper(without(value, "- ")), valid)


def iban_valid(value: Column) -> Column:
    """With or without the country code PL; spaces are ignored, letters count A=10 to Z=35."""
    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    def valid(s: Column) -> Column:
        # P and L are 25 and 21; the check digits go to the end
        number = F.concat(F.substring(s, 5, 24), F.lit("2521"), F.substring(s, 3, 2)).cast("decimal(38,0)")
        turned = F.concat(F.substring(s, 5, 24), F.substring(s, 1, 4))
        rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))
        return F.coalesce(F.when(s.rlike(r"\APL[0-9]{26}\z"), number % 97 == 1).when(s.rlike(r"\A[A-Z0-9]{28}\z"), rest == 1), F.lit(False))

    return let(F.upper(without(value, " ")), lambda bare: let(F.when(bare.startswith("PL"), bare).otherwise(F.concat(F.lit("PL"), bare)), valid))
