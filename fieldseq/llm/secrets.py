"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: texts that
match must hold all trigrams of at least one alternative of every clause. The index
posts the trigrams the rules ask for; postings are intersected per alternative, and
only candidates are verified with the expression. Rules without a mandatory trigram
are verified on every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldseq.llm.base import query, stored, table

MARK = "[REDACTED]"
_WIDEST = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, capture group whose length counts, its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token"))
_API = _any_case("api") + "_?" + _any_case("key")

# The base kinds and their order.
BASE = (
    Rule("assign", rf"({_NAMES}|{_API})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
# Formats of public services' keys.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


def _strings(item) -> set[str] | None:
    """All lower-cased strings one element of a parsed pattern can be; None if too many."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out
    if op is sre.SUBPATTERN:
        return _joined(arg[-1])
    if op is sre.BRANCH:
        parts = [_joined(branch) for branch in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[1] == 1:
        inner = _joined(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _joined(items) -> set[str] | None:
    out = {""}
    for item in items:
        more = _strings(item)
        if more is None or len(out) * len(more) > _WIDEST:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses (all must hold) of alternatives (one must hold) of trigrams (all must occur).

    Empty when the pattern has no mandatory trigram. Trigrams are lower-cased.
    """
    clauses: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> None:
        if min(map(len, strings)) < 3:
            return
        sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
        least = [a for a in sets if not any(b < a for b in sets)]
        clauses.append(sorted(least, key=sorted))

    run = {""}
    for item in sre_parser.parse(pattern):
        more = _strings(item)
        if more is None or len(run) * len(more) > _WIDEST:
            close(run)
            run = {""} if more is None else more
        else:
            run = {a + b for a, b in product(run, more)}
    close(run)
    return clauses


def _lower(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def trigram_index(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Postings (trigram, doc_id) of the trigrams the rules' queries ask for."""
    asked = sorted({t for rule in rules for clause in trigram_query(rule.pattern)
                    for alternative in clause for t in alternative})
    folded = docs.select("doc_id", _lower(F.col("text")).alias("_t")).filter("_t is not null")
    held = F.filter(F.array(*[F.lit(t) for t in asked]) if asked else F.lit([]).cast("array<string>"),
                    lambda t: F.contains(F.col("_t"), t))
    return folded.select(F.explode(held).alias("trigram"), "doc_id")


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(doc_id, kinds): rules whose trigram query a document's postings satisfy.

    The queries are a small table of literals; postings of one alternative are
    intersected by counting them per document.
    """
    spark = index.sparkSession
    asked = [(rule.kind, c, a, t, len(alternative), len(clauses))
             for rule in rules for clauses in [trigram_query(rule.pattern)]
             for c, clause in enumerate(clauses) for a, alternative in enumerate(clause)
             for t in sorted(alternative)]
    queries = spark.createDataFrame(asked, "kind string, clause int, alternative int, "
                                           "trigram string, need int, clauses int")
    met = (index.join(F.broadcast(queries), "trigram")
           .groupBy("doc_id", "kind", "clauses", "clause", "alternative", "need")
           .agg(F.count_distinct("trigram").alias("_n")).filter("_n = need"))
    return (met.groupBy("doc_id", "kind", "clauses")
            .agg(F.count_distinct("clause").alias("_n")).filter("_n = clauses")
            .groupBy("doc_id").agg(F.collect_set("kind").alias("kinds")))


def _found(text: Column, rule: Rule, number: int) -> Column:
    """Spans (start, number, end) of a rule's matches, leftmost first, too short ones dropped.

    Offsets count code points: pieces between matches and matches alternate.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    pieces = F.split(text, rule.pattern, -1)
    triples = F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("gap"), whole.alias("hit"),
                           counted.alias("part"))
    start = F.struct(F.lit(0).alias("at"), F.lit([]).cast(
        "array<struct<start:int,number:int,end:int>>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), F.lit(number).alias("number"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(F.length(x["part"]) >= rule.least,
                                                F.concat(state["spans"], F.array(span)))
                        .otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(triples, start, step, lambda s: s["spans"])
    return F.when(F.rlike(text, pattern), spans).otherwise(start["spans"])


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE) -> DataFrame:
    """Add `spans`: all secrets of each text as array of (start, kind, end), in order.

    Null and empty texts have none; repeated rows and null ids are kept and scanned
    alike; other columns stay, and one named `spans` is replaced.
    """
    base = docs.drop("spans")
    picked = stored(candidates(trigram_index(base, rules), rules), "secret_candidates")
    picked = picked.select(F.col("doc_id").alias("_secret_doc"), F.col("kinds").alias("_secret_kinds"))
    joined = base.join(picked, F.col("doc_id").eqNullSafe(F.col("_secret_doc")), "left")
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.lit([]).cast("array<struct<start:int,number:int,end:int>>")
    lists = []
    for number, rule in enumerate(rules):
        hits = _found(text, rule, number)
        if trigram_query(rule.pattern):
            hits = F.when(F.array_contains("_secret_kinds", rule.kind), hits).otherwise(none)
        lists.append(hits)
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    named = F.transform(F.sort_array(F.concat(*lists)), lambda s: F.struct(
        s["start"].alias("start"), F.element_at(kinds, s["number"] + 1).alias("kind"),
        s["end"].alias("end")))
    return joined.withColumn("spans", named).drop("_secret_doc", "_secret_kinds")


def redact(scanned: DataFrame, mark: str = MARK) -> DataFrame:
    """Replace the text of all spans by a mark, overlapping ones by a single one."""
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, F.greatest(F.lit(0), s["start"] - state["at"]))
        out = F.concat(state["out"], gap, F.lit(mark))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when((s["start"] >= state["at"]), out)
                        .otherwise(state["out"]).alias("out"))

    folded = F.aggregate("spans", start, step, lambda s: F.concat(
        s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return scanned.withColumn("text", F.when(F.size("spans") > 0, folded).otherwise(text))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _oracle() -> str:
    """The same scan in DuckDB: pieces and matches of every rule on every text."""
    lists = []
    for number, rule in enumerate(BASE + MORE):
        p = "'" + rule.pattern.replace("'", "''") + "'"
        lists.append(f"""(select list({{'s': s, 'n': {number}, 'kind': '{rule.kind}', 'e': s + length(m[i])}})
          from (select i, m, g, cast(list_sum(list_transform(p[1:i], lambda x: length(x)))
                   + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) as s
                from (select regexp_extract_all(t, {p}) as m, regexp_extract_all(t, {p}, {rule.group}) as g,
                             string_split_regex(t, {p}) as p), unnest(range(1, len(m) + 1)) as u(i))
          where length(g[i]) >= {rule.least})""")
    both = ", ".join(f"coalesce({x}, [])" for x in lists)
    text = "array_to_string(list_transform({}, lambda x: x.kind || ':' || x.s || ':' || x.e), ',')"
    return f"""
  with d as (select doc_id, coalesce(text, '') as t from documents),
  f as (select doc_id, list_sort(flatten([{both}])) as spans from d)
  select doc_id, len(list_filter(spans, lambda x: x.n = 0)) as n_assign,
    len(list_filter(spans, lambda x: x.n = 1)) as n_access,
    len(list_filter(spans, lambda x: x.n = 2)) as n_hex,
    sha256(coalesce({text.format("list_filter(spans, lambda x: x.n < 3)")}, '')) as base_sha256,
    coalesce({text.format("spans")}, '') as spans from f"""


@query("op2_secret_scan", _oracle())
def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", count("assign").alias("n_assign"),
                        count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(span_text(base), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))
