"""Secret scans: a trigram inverted index over whole texts, Boolean trigram queries, verified candidates.

Each rule's regular expression yields a Boolean query over trigrams that every match must contain. The index holds
postings (trigram, document) for the trigrams that some rule asks for. Postings are intersected per document, and only
the candidates of a rule are matched with its expression; a rule without mandatory trigrams matches every document.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.tables import ascii_lower, materialise


class Rule(NamedTuple):
    """``pattern`` without look-around or back references; matches whose ``group`` is under ``least`` characters fail."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = [
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # A run of 24 or more is the same as a whole run that is at least 24 long.
    Rule("hex", r"[0-9a-f]{24,}"),
]
#: Kinds that the base rules lack; all have mandatory trigrams.
MORE_RULES = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("code_host", r"gh[opusr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]+", 0, 15),
    Rule("cloud", r"AIza[0-9A-Za-z_-]+", 0, 39),
]

_MANY = 64


def _all(parts: list) -> tuple | str | None:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list) -> tuple | str | None:
    parts = list(dict.fromkeys(parts))
    return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _contained(strings: set[str]) -> tuple | str | None:
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _item(op, arg) -> tuple[set[str] | None, tuple | str | None]:
    """The lower-cased strings an item can stand for (None: too many), and the trigrams it asks for in that case."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}, None
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < _MANY:
                chars.update(chr(c).lower() for c in range(value[0], value[1] + 1))
            else:
                return None, None
        return (chars, None) if len(chars) <= 8 else (None, None)
    if op is sre.BRANCH:
        ways = [_sequence(way) for way in arg[1]]
        if all(w[0] is not None for w in ways) and sum(len(w[0]) for w in ways) <= _MANY:
            return set().union(*(w[0] for w in ways)), None
        return None, _any([_contained(w[0]) if w[0] is not None else w[1] for w in ways])
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        exact, query = _sequence(inner)
        if exact is not None and most <= 1 and least == 0:
            return exact | {""}, None
        if exact is not None and least == most and len(exact) ** least <= _MANY:
            return {"".join(p) for p in product(exact, repeat=least)}, None
        return None, None if least == 0 else _contained(exact) if exact is not None else query
    return None, None


def _sequence(items) -> tuple[set[str] | None, tuple | str | None]:
    run, asked, whole = {""}, [], True
    for op, arg in items:
        strings, query = _item(op, arg)
        if strings is not None and len(run) * len(strings) <= _MANY:
            run = {a + b for a in run for b in strings}
            continue
        asked += [_contained(run), query]
        run, whole = strings or {""}, False
    return (run, None) if whole else (None, _all([*asked, _contained(run)]))


def trigram_query(pattern: str) -> tuple | str | None:
    """("and" | "or", parts...) over lower-cased trigrams that any match contains; None if nothing is mandatory."""
    exact, query = _sequence(sre_parser.parse(pattern))
    return _contained(exact) if exact is not None else query


def _trigrams(query: tuple | str | None) -> list[str]:
    if query is None:
        return []
    return [query] if isinstance(query, str) else [t for part in query[1:] for t in _trigrams(part)]


def _keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): rows of one id and one text share a key, null ids and ids of several texts included."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    owner = F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.lit("none"))
    return docs.select(F.concat_ws(" ", F.md5(text), owner).alias("key"), "doc_id", text.alias("text"))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(t, key): the inverted index over whole lower-cased texts for the given trigrams, by their place in the list."""
    low = docs.select("key", ascii_lower(F.col("text")).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), i) for i, t in enumerate(trigrams)]))
    return low.select("key", F.explode(found).alias("t"))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(key, rules): the rules, as bits by their place, whose trigram queries the document's postings satisfy."""
    asked = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in asked for t in _trigrams(q)})
    index = materialise(postings(docs, trigrams))
    masks = [
        F.bit_or(F.when(F.floor(F.col("t") / 64) == w, F.expr("shiftleft(1L, t % 64)")).otherwise(F.lit(0))).alias(f"m{w}")
        for w in range(len(trigrams) // 64 + 1)
    ]
    place = {t: i for i, t in enumerate(trigrams)}

    def holds(query: tuple | str) -> Column:
        if isinstance(query, str):
            i = place[query]
            return F.getbit(F.col(f"m{i // 64}"), F.lit(i % 64)) == 1
        parts = [holds(p) for p in query[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if query[0] == "and" else out | p
        return out

    bits = F.lit(0).cast("long")
    for i, query in enumerate(asked):
        if query is not None:
            bits = bits.bitwiseOR(F.when(holds(query), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return index.groupBy("key").agg(*masks).select("key", bits.alias("rules")).where("rules <> 0")


def _matches(i: int, rule: Rule, gate: Column | None) -> Column:
    """Per match of the rule: its number, the gap before it, its length and the length of its tested group."""
    text, pattern = F.col("text"), F.lit(rule.pattern)
    chars = lambda column: F.transform(column, F.char_length)
    zipped = F.arrays_zip(
        chars(F.split(text, rule.pattern, -1)).alias("gap"),
        chars(F.regexp_extract_all(text, pattern, F.lit(0))).alias("len"),
        chars(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("test"),
    )
    rows = F.transform(
        zipped,
        lambda x, n: F.struct(F.lit(i).alias("k"), n.alias("n"), x["gap"].alias("gap"), x["len"].alias("len"), x["test"].alias("test")),
    )
    hit = text.rlike(rule.pattern)
    return F.when(hit if gate is None else gate & hit, F.filter(rows, lambda x: x["len"].isNotNull()))


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, kind, rule, start, end): every match of every rule in whole texts, by code points, ``end`` exclusive.

    Matches of one rule are leftmost and do not overlap; a match that fails its length test still consumes its text.
    ``docs`` needs doc_id and text. Null and empty texts hold nothing, so documents without matches have no row. Rows of
    one doc_id (null or not) with different texts are searched each by itself; exact repeats of a row count once. Other
    columns are not read. An empty table gives no rows.
    """
    return _found(_keyed(docs), rules).drop("key")


def _found(known: DataFrame, rules: list[Rule] | None) -> DataFrame:
    rules = [*BASE_RULES, *MORE_RULES] if rules is None else rules
    joined = known.join(candidates(known, rules), "key", "left")
    found = []
    for i, rule in enumerate(rules):
        gate = F.coalesce(F.getbit("rules", F.lit(i)) == 1, F.lit(False)) if trigram_query(rule.pattern) is not None else None
        found.append(F.coalesce(_matches(i, rule, gate), F.expr("array()").cast("array<struct<k:int,n:int,gap:int,len:int,test:int>>")))
    rows = joined.select("key", "doc_id", F.explode(F.concat(*found)).alias("m")).select("key", "doc_id", "m.*").distinct()
    order = Window.partitionBy("key", "k").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("k") + 1)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("k") + 1)
    return ends.where(F.col("test") >= least).select(
        "key", "doc_id", kind.alias("kind"), F.col("k").alias("rule"), (F.col("end") - F.col("len")).alias("start"), "end"
    )


def secret_report(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, their spans' digest, and all spans as text."""
    known = _keyed(docs)
    found = _found(known, rules)
    span = F.struct("start", "rule", F.concat_ws(":", "kind", "start", "end").alias("s"))
    base = [r.kind for r in BASE_RULES]
    per_doc = found.groupBy("key").agg(
        *[F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in base],
        F.sort_array(F.collect_list(span)).alias("all"),
        F.sort_array(F.collect_list(F.when(F.col("kind").isin(base), span))).alias("base"),
    )
    texts = lambda column: F.array_join(F.transform(column, lambda x: x["s"]), ",")
    joined = known.select("key", "doc_id").join(per_doc, "key", "left")
    return joined.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in base],
        F.sha2(F.coalesce(texts(F.col("base")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(texts(F.col("all")), F.lit("")).alias("spans"),
    )
