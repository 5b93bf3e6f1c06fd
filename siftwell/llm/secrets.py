"""Operator 10: secret scans through an inverted index of trigrams.

From each rule's regular expression a Boolean query over mandatory trigrams is derived: the strings that every match
must hold, joined by AND and OR. The index has postings (trigram, text) for the trigrams that occur in some query, over
ASCII lower case. Intersecting a text's postings gives the rules that can match it; only these are run on it. A rule
without mandatory trigrams runs on every text. So the index never changes what is found.

Defined results: null text is empty; empty text has no spans. Matches are leftmost, not overlapping within a rule, and
may overlap between rules; spans are counted in code points, end exclusive, ordered by start, then rule. Texts are
keyed by a hash: should two collide, both run the rules of either, which finds the same. Repeated rows give equal rows.
Columns not asked for are left out, whatever their names."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import let
from siftwell.llm.common import ascii_lower, table
from siftwell.operators.skew import hot_join
from siftwell.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """A match counts if its group has at least min_chars characters."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 0


# The base rules, then further kinds. A run of hexadecimal digits that is long enough is the same match
# whether its length is part of the pattern or tested afterwards, because runs are maximal; so for access.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("url_password", r"[A-Za-z]+://[A-Za-z0-9._-]+:[A-Za-z0-9._!$%^&*-]+@"),
)
RULES = BASE + MORE
PIECE = 128  # matches whose places are added up in one list
MAX_STRINGS = 64  # alternatives of a literal that a query spells out; beyond, it asks for less

# A query is True (nothing is mandatory), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


def _join(kind: str, parts: Iterable[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    if kind == "or" and True in parts:
        return True
    parts = [p for p in parts if p is not True]
    if kind == "or":  # A or (A and B) is A
        parts = [p for p in parts if not any(q != p and trigrams_of(q) <= trigrams_of(p) and _only_and(q) and _only_and(p) for q in parts)]
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def trigrams_of(query: Query) -> set[str]:
    if isinstance(query, tuple):
        return set().union(*(trigrams_of(q) for q in query[1]))
    return {query} if isinstance(query, str) else set()


def _only_and(query: Query) -> bool:
    return isinstance(query, str) or query[0] == "and" and all(isinstance(q, str) for q in query[1])


def _spelled(strings: set[str]) -> Query:
    """What a text must hold if it holds one of the strings."""
    return _join("or", (_join("and", (s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


def trigram_query(pattern: str) -> Query:
    """The query of a regular expression, over lower case."""

    def strings_of(items: list) -> tuple[set[str] | None, Query]:
        """All strings that the sequence can be (None: too many), and the query of what is mandatory in it."""
        whole, queries, run = True, [], {""}

        def flush() -> None:
            nonlocal run, whole
            queries.append(_spelled(run))
            run, whole = {""}, False

        for op, value in items:
            found = one(op, value)
            if isinstance(found, set) and len(run) * len(found) <= MAX_STRINGS:
                run = {a + b for a, b in product(run, found)}
            elif isinstance(found, set):
                flush()
                run = found
            else:
                flush()
                queries.append(found)
        return (run if whole else None), _join("and", [*queries, _spelled(run)])

    def one(op: object, value: object) -> set[str] | Query:
        name = str(op)
        if name == "LITERAL":
            return {chr(value).lower()}
        if name == "IN" and all(str(o) == "LITERAL" for o, _ in value) and len(value) <= 8:
            return {chr(v).lower() for _, v in value}
        if name == "SUBPATTERN":
            strings, query = strings_of(list(value[-1]))
            return strings if strings is not None else query
        if name == "BRANCH":
            found = [strings_of(list(branch)) for branch in value[1]]
            if all(s is not None for s, _ in found):
                return set().union(*(s for s, _ in found))
            return _join("or", (q for _, q in found))
        if name in ("MAX_REPEAT", "MIN_REPEAT"):
            least, most, inner = value
            strings, query = strings_of(list(inner))
            if strings is not None and (least, most) == (0, 1):
                return strings | {""}
            if strings is not None and least == most and len(strings) == 1:
                return {next(iter(strings)) * least}
            return query if least else True
        return True

    return strings_of(list(re._parser.parse(pattern)))[1]


def _holds(query: Query, has: Callable[[str], Column]) -> Column:
    if isinstance(query, str):
        return has(query)
    parts = [_holds(q, has) for q in query[1]]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


def trigram_index(texts: DataFrame, trigrams: Iterable[str]) -> DataFrame:
    """Postings (trigram, _key, n) of texts (_key, _text): n rows with this text hold the trigram."""
    wanted = F.array(*map(F.lit, sorted(trigrams)))
    held = let(ascii_lower(F.col("_text")), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))
    return texts.select("_key", F.explode(held).alias("trigram")).groupBy("trigram", "_key").agg(F.count("*").alias("n"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """_key, _rules (kinds whose query holds), n: texts with a rule to run. A text has at most as many postings as the
    queries have trigrams."""
    held = index.groupBy("_key").agg(F.collect_set("trigram").alias("_held"), F.max("n").alias("n"))
    kinds = [F.when(_holds(q, lambda t: F.array_contains("_held", t)), F.lit(k)) for k, q in queries.items()]
    return held.select("_key", F.array_compact(F.array(*kinds)).alias("_rules"), "n").where(F.size("_rules") > 0)


def match_spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, rule, end>>: the text is cut at the matches; lengths of cuts and matches add up to places, first
    of pieces of PIECE matches, then inside each, so that no long list is copied once for every match."""
    pattern = F.lit(rule.pattern)
    pairs = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
    )
    kind = "array<struct<start:bigint,rule:int,end:bigint>>"
    size = lambda pair: (F.length(pair["gap"]) + F.coalesce(F.length(pair["match"]), F.lit(0))).cast("bigint")

    def step(state: Column, pair: Column) -> Column:
        begin, end = state["at"] + F.length(pair["gap"]), state["at"] + size(pair)
        span = F.struct(begin.cast("bigint").alias("start"), F.lit(number).alias("rule"), end.alias("end"))
        counts = F.length(pair["value"]) >= rule.min_chars  # null behind the last match
        spans = F.when(counts, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    def in_piece(piece: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(kind).alias("spans"))
        return F.aggregate(piece, start, step, lambda state: state["spans"])

    def in_pieces(pieces: Column) -> Column:
        total = lambda piece: F.aggregate(piece, F.lit(0).cast("bigint"), lambda at, pair: at + size(pair))
        ends = F.aggregate(
            F.transform(pieces, total), F.array(F.lit(0).cast("bigint")), lambda ends, n: F.array_append(ends, F.element_at(ends, -1) + n)
        )
        return let(ends, lambda ends: F.flatten(F.transform(pieces, lambda piece, i: in_piece(piece, F.get(ends, i)))))

    def cut(pairs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(PIECE))
        return F.transform(starts, lambda i: F.slice(pairs, i, F.lit(PIECE)))

    found = let(pairs, lambda pairs: let(cut(pairs), in_pieces))
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(kind))


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns, _text, spans array<struct<start, rule, end>> (rule is the place in rules), one row for each row."""
    body = F.coalesce(df[text], F.lit(""))
    rows = df.select(*(df[c] for c in keep), F.xxhash64(body).alias("_key"), body.alias("_text"))
    queries = {rule.kind: query for rule in rules if (query := trigram_query(rule.pattern)) is not True}
    index = cut_lineage(trigram_index(rows, set().union(*map(trigrams_of, queries.values()))))
    found = cut_lineage(candidates(index, queries))
    joined = hot_join(rows, found, ["_key"], "n", [keep[0]], "left")
    spans = []
    for number, rule in enumerate(rules):
        all_spans = match_spans(F.col("_text"), rule, number)
        none = F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")
        spans.append(F.when(F.array_contains("_rules", rule.kind), all_spans).otherwise(none) if rule.kind in queries else all_spans)
    return joined.select(*keep, "_text", F.sort_array(F.concat(*spans)).alias("spans"))


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(rule.kind) for rule in rules))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with mask in place of every stretch that spans cover; spans that overlap share one mask."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"].cast("int") + 1, (span["start"] - state["at"]).cast("int"))
        parts = F.when(span["start"] < state["at"], state["parts"]).otherwise(F.concat(state["parts"], F.array(gap, F.lit(mask))))
        return F.struct(F.greatest(span["end"], state["at"]).alias("at"), parts.alias("parts"))

    def close(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"].cast("int") + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, close)).otherwise(text)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["rule"] < len(BASE))
    count = lambda n: F.size(F.filter("spans", lambda s: s["rule"] == n)).cast("bigint")
    counts = [count(n).alias(f"n_{rule.kind}") for n, rule in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def _oracle() -> str:
    parts = [
        f"""SELECT rid, {n} AS rule, '{r.kind}' AS kind, string_split_regex(t, p) AS gaps,
            regexp_extract_all(t, p) AS matches, regexp_extract_all(t, p, {r.group}) AS vals, {r.min_chars} AS least
            FROM (SELECT *, '{r.pattern.replace("'", "''")}' AS p FROM d)"""
        for n, r in enumerate(RULES)
    ]
    kinds = ", ".join(
        f"count(*) FILTER (rule = {n} AND start IS NOT NULL)::BIGINT AS n_{r.kind}" for n, r in enumerate(BASE)
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
places AS (
  SELECT rid, rule, kind, least, length(vals[i]) AS chars, length(matches[i]) AS size,
         list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(matches[1:i - 1], lambda x: length(x))), 0) AS start
  FROM found, unnest(range(1, len(matches) + 1)) u(i)),
spans AS (
  SELECT rid, rule, start::BIGINT AS start, concat(kind, ':', start::BIGINT, ':', (start + size)::BIGINT) AS span
  FROM places WHERE chars >= least)
SELECT doc_id, {kinds},
       sha256(coalesce(string_agg(span, ',' ORDER BY start, rule) FILTER (rule < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, rule), '') AS spans
FROM d LEFT JOIN spans USING (rid) GROUP BY rid, doc_id
"""


ORACLE = _oracle()
