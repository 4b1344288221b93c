"""Match positions by native expressions, and the resolution of overlapping spans.

Spark has no function for the positions of all matches, so a mark is put around every match by
one replacement. Cut at the marks, a text gives by turns what stands between matches and the
matches themselves, and a match starts after all that stands before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<entity_type: string, start: int, end: int, score: double, recognizer: string>"
SPANS = f"array<{SPAN}>"
_HITS = "array<struct<start: int, end: int, raw: string>>"


#: A character of private use, and the one that takes its place in texts that hold it.
_MARK, _STAND_IN = "\ue000", "\ue001"


def hits(text: Column, pattern: str, group: int = 0, guard: str | None = None) -> Column:
    """array<struct<start, end, raw>> of all matches (or of group 1 of each), in code points, half open.

    The pattern must not match the empty string. With group=1 the group must stand at the top
    of the pattern and be matched once in every match, else ValueError. guard is a cheaper
    pattern that every text with a match also matches; texts without it are not searched.
    """
    if group:
        pattern, last = _three_parts(pattern)
        made, turn, wanted = f"{_MARK}$1{_MARK}$2{_MARK}${last}{_MARK}", 4, 2
    else:
        made, turn, wanted = f"{_MARK}$0{_MARK}", 2, 1
    safe = F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, _STAND_IN)).otherwise(text)
    marked = F.regexp_replace(safe, F.lit(pattern), F.lit(made))
    none = F.array().cast(_HITS)
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        hit = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("raw"))
        out = F.when(acc["i"] % turn == wanted, F.concat(acc["out"], F.array(hit))).otherwise(acc["out"])
        return F.struct((acc["i"] + 1).alias("i"), end.alias("at"), out.alias("out"))

    # the marked text as a lambda's variable, so that the search runs once
    found = F.transform(F.array(marked), lambda m: F.when(F.contains(m, F.lit(_MARK)), F.aggregate(F.split(m, _MARK, -1), start, step)["out"]).otherwise(none))[0]
    return F.coalesce(found if guard is None else F.when(text.rlike(guard), found), none)


def _three_parts(pattern: str) -> tuple[str, int]:
    """The pattern as (before)(group 1)(after), and the number of the last group."""
    flags = re.match(r"(?:\(\?[a-zA-Z]+\))*", pattern)[0]
    rest = pattern[len(flags) :]
    opened = closed = None
    depth = groups = inner = at = 0
    while at < len(rest):
        c = rest[at]
        if c == "\\":
            if rest[at + 1 : at + 2].isdigit() or rest[at + 1 : at + 2] == "k":
                raise ValueError(f"a rule with a group must not refer back to it: {pattern}")
            at += 2
            continue
        if c == "[":
            at += 1 + (rest[at + 1 : at + 2] == "^")
            at += rest[at : at + 1] == "]"
            while at < len(rest) and rest[at] != "]":
                at += 2 if rest[at] == "\\" else 1
        elif c == "(":
            captures = rest[at + 1 : at + 2] != "?" or re.match(r"\(\?P?<[a-zA-Z]", rest[at:]) is not None
            groups += captures
            if captures and opened is None:
                if depth:
                    raise ValueError(f"group 1 of a rule must not stand inside another group: {pattern}")
                opened = at
            elif captures and closed is None:
                inner += 1
            depth += 1
        elif c == ")":
            depth -= 1
            if opened is not None and closed is None and not depth:
                closed = at
        elif c == "|" and not depth:
            raise ValueError(f"a rule with a group must not be an alternation: {pattern}")
        at += 1
    if opened is None or closed is None or rest[closed + 1 : closed + 2] in ("?", "*", "+", "{"):
        raise ValueError(f"group 1 of a rule must be matched once: {pattern}")
    return f"{flags}({rest[:opened]}){rest[opened : closed + 1]}({rest[closed + 1 :]})", 3 + inner


def each(df: DataFrame, array: Column | str, name: str, *keep: Column | str) -> DataFrame:
    """A row for each element of the array (none of them null), as column `name` beside the kept columns.

    Unlike explode, this does not make Spark test the array's size first, which would compute it twice.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def spans(found: Column, entity_type: str, recognizer: str, score: Callable[[Column], Column]) -> Column:
    """Spans of the hits whose score is not null."""
    scored = F.transform(
        found,
        lambda h: F.struct(
            F.lit(entity_type).alias("entity_type"), h["start"].alias("start"), h["end"].alias("end"), score(h).cast("double").alias("score"), F.lit(recognizer).alias("recognizer")
        ),
    )
    return F.filter(scored, lambda s: s["score"].isNotNull())


# Which entity type wins where spans overlap.
PRIORITY = {
    "PL_NIP": 100, "PL_REGON": 100, "PL_KRS": 100, "PL_PESEL": 95, "PL_ID_CARD": 90, "PL_PASSPORT": 90, "BANK_ACCOUNT": 85, "EMAIL_ADDRESS": 80,
    "PHONE_NUMBER": 75, "LICENSE_PLATE": 70, "POLICY_NUMBER": 70, "CLAIM_NUMBER": 70, "ADDRESS": 60, "ORGANIZATION": 50, "PERSON": 40,
}


def priority(entity_type: Column) -> Column:
    by_rank: dict[int, list[str]] = {}
    for name, rank in PRIORITY.items():
        by_rank.setdefault(rank, []).append(name)
    out = None
    for rank, names in by_rank.items():
        out = F.when(entity_type.isin(*names), rank) if out is None else out.when(entity_type.isin(*names), rank)
    return out.otherwise(0)


def allow(found: Column, text: Column, allowed: list[str]) -> Column:
    """Spans whose whole trimmed value is not on the allowlist (case ignored)."""
    names = sorted({a.strip().lower() for a in allowed if a and a.strip()})
    if not names:
        return found
    from .text import normal_value

    return F.filter(found, lambda s: ~normal_value(F.substring(text, s["start"] + 1, s["end"] - s["start"])).isin(*names))


def resolve(found: Column) -> Column:
    """Spans that do not overlap: higher priority first, then longer, then earlier; in order of start.

    Of equal spans the higher score stays, then the recognizer registered first.
    """
    keyed = F.sort_array(
        F.transform(
            found,
            lambda s, i: F.struct(
                (-priority(s["entity_type"])).alias("p"), (s["start"] - s["end"]).alias("n"), s["start"].alias("at"), (-s["score"]).alias("q"), i.alias("i"), s.alias("s")
            ),
        )
    )

    def step(acc: Column, x: Column) -> Column:
        s = x["s"]
        taken = F.exists(acc, lambda a: (a["start"] < s["end"]) & (s["start"] < a["end"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(s)))

    kept = F.aggregate(keyed, F.array().cast(SPANS), step)
    by_start = F.sort_array(F.transform(kept, lambda s: F.struct(s["start"].alias("at"), s.alias("s"))))
    return F.transform(by_start, lambda x: x["s"])
