"""Relevance rules, one per evaluation query, as expressions over possession rows.

Patterns avoid look-around, so Java and RE2 read them alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseq.functions import grammar as G

BOX_SHOT = r"(^| )SHOT@F-(LI|C|RI)"
FINAL_THIRD = "@F-"

# Rules that are one pattern over the token line.
TOKEN_PATTERNS: dict[str, str] = {
    "q01": r"(^| )CROSS@F-R[^ ]*>[^ ]* (.* )?SHOT",
    "q02": r"(^| )CROSS@F-L[^ ]*>[^ ]* (.* )?SHOT",
    "q03": r"(^| )SWITCH",
    "q05": BOX_SHOT,
    "q06": r"(^| )THROUGH@[MF]",
    "q07": FINAL_THIRD,
    "q08": r"(^| )SHOT@F",
    "q10": r"(^| )DRIB@F[^ ]* (.* )?([^ ]*>|SHOT@F-(LI|C|RI))",
    "q13": r"^([^ ]+ )?(RECOV|INT)@[MF]",
    "q16": r"^[A-Z]+@F-",
    "q17": r">",
    "q25": r"(^| )SHOT[^ ]* (.* )?(RECOV|DUEL)[^ ]* (.* )?SHOT",
    "q28": r"@F-(L|LI|RI|R)[+]?>[^ ]* ([^ ]+ )?SHOT@F-C",
    "q30": BOX_SHOT,
}
# Rules that are several token patterns, all of which must be found.
ALL_TOKEN_PATTERNS: dict[str, tuple[str, ...]] = {
    "q09": (r"^([^ ]+ )?(RECOV|INT)@F", r"^([^ ]+ ){0,8}SHOT"),
    "q27": (r"^([^ ]+ )?INT@M", r"^([^ ]+ ){0,7}[A-Z]+@F-"),
}
# Rules over the zone line.
ZONE_PATTERNS: dict[str, tuple[str, ...]] = {
    "q11": (r"(^| )F-LI?$", r"(^| )[MF]-LI( |$)"),
    "q22": (r"(^| )D-[A-Z]+ F-",),
    "q23": (r"(^| )F-LI?$",),
}
WIDE_RIGHT = r"(^| )F-R( |$)"
SQUARED = r"@F-RI?[+]?>[^ ]* (.* )?SHOT"
RETREAT_LEFT = r"(^| )[MF]-LI? (.* )?D-[A-Z]+ (.* )?F-RI?( |$)"
RETREAT_RIGHT = r"(^| )[MF]-RI? (.* )?D-[A-Z]+ (.* )?F-LI?( |$)"
CENTRAL_RUN = r"(^| )([MF]-C( |$)){4}"
DOWN_RIGHT = r"(^| )[FM]-R( |$)"
INSIDE_LEFT_PASS = r"^PASS@[MF]-LI[+>^]*$"
SHORT = 25


def _ts() -> Column:
    return F.col("token_string")


def _zp() -> Column:
    return F.col("zone_path")


def _tokens() -> Column:
    return G.tokens_of(_ts())


def _count(test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(_tokens(), test))


def _composed() -> dict[str, Column]:
    third = _ts().rlike(FINAL_THIRD)
    last = G.last_shot_zone(_ts())
    pressured = F.length(_ts()) - F.length(F.replace(_ts(), F.lit("^"), F.lit("")))
    return {
        "q04": F.col("ended_in_shot") & (F.col("n_events") <= SHORT),
        "q12": third & (F.col("n_events") <= SHORT),
        "q14": last.startswith("M-"),
        "q15": _zp().rlike(WIDE_RIGHT) & _ts().rlike(SQUARED),
        "q18": _zp().rlike(RETREAT_LEFT) | _zp().rlike(RETREAT_RIGHT),
        "q19": _zp().rlike(CENTRAL_RUN) & third,
        "q20": last == "F-C",
        "q21": (pressured >= 4) & _ts().rlike(r"^[A-Z]+@D-") & _ts().rlike(r"@[MF]-"),
        "q24": _count(lambda t: t.startswith("LOSS") | t.startswith("DUEL")) <= 2,
        "q26": _zp().rlike(DOWN_RIGHT) & (last == "F-RI"),
        "q29": (_count(lambda t: t.rlike(INSIDE_LEFT_PASS)) >= 2) & third,
    }


def predicates() -> dict[str, Column]:
    """All 30 rules: query id to boolean column."""
    rules = {q: _ts().rlike(p) for q, p in TOKEN_PATTERNS.items()}
    for line, table in ((_ts(), ALL_TOKEN_PATTERNS), (_zp(), ZONE_PATTERNS)):
        for q, patterns in table.items():
            rule = line.rlike(patterns[0])
            for p in patterns[1:]:
                rule = rule & line.rlike(p)
            rules[q] = rule
    rules.update(_composed())
    return dict(sorted(rules.items()))


def judged(qid: Column) -> Column:
    """1 or 0 for the rule the row's query id names; an unknown id fails the job."""
    verdict = None
    for q, rule in predicates().items():
        hit = rule.cast("int")
        verdict = F.when(qid == q, hit) if verdict is None else verdict.when(qid == q, hit)
    return verdict.otherwise(F.raise_error(F.concat(F.lit("no rule for query "), qid)).cast("int"))


def matrix(possessions: DataFrame) -> DataFrame:
    """Each possession with all 30 verdicts as 0/1 columns."""
    return possessions.select("uid", *[r.cast("int").alias(q) for q, r in predicates().items()])
