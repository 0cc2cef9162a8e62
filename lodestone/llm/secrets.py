"""Secret scans through a trigram inverted index (DataFrame functions only).

From each rule's regex a Boolean query over trigrams is derived: any of some
clauses, each a set of trigrams that a match must contain. A document is posted
under the trigrams that it holds; the postings of a clause's trigrams are
intersected and those of the clauses united; documents that satisfy a rule's
query are its candidates and are verified with the regex. A rule without
mandatory trigrams scans every text.

``postings`` cuts every text to its trigrams and builds the index as a table;
``scan(..., index=...)`` intersects the postings and verifies the candidates, and
the query does both. ``scan`` without an index is for a corpus that is looked at
once: it tests the Boolean query on each text, trigram by trigram until one is
missing, and has no postings.

Defined results: null text is empty; ids may be of any type; rows that share an
id are verified one by one; an empty table gives an empty result; only the named
columns are read.
"""

from __future__ import annotations

import functools
import itertools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, null_safe_key


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str  # in the syntax that Java and Python share
    group: int = 0  # the group whose length counts
    least: int = 1  # matches with a shorter group are dropped
    base: bool = False


RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # a greedy run of fewer than 24 can't hold a longer one, so the bound may stand in the pattern
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

# --------------------------------------------------------------------------
# regex -> Boolean trigram query

MAX_STRINGS = 128
Clauses = frozenset  # of frozensets of trigrams: any clause, all of its trigrams


def _absorb(clauses) -> Clauses:
    return frozenset(c for c in clauses if not any(o < c for o in clauses))


def _of_strings(strings: set[str]) -> Clauses:
    return _absorb({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _and(a: Clauses, b: Clauses) -> Clauses:
    if len(a) * len(b) > MAX_STRINGS:
        return max(a, b, key=lambda c: min(map(len, c)))
    return _absorb({x | y for x in a for y in b})


TRUE: Clauses = frozenset([frozenset()])


def _walk(items) -> tuple[set[str] | None, Clauses]:
    """(the exact lower-cased strings, or None if too many; the query)."""
    run: set[str] = {""}
    query, exact = TRUE, True
    for op, arg in items:
        name = str(op)
        own, q = None, TRUE
        if name == "LITERAL":
            own = {chr(arg).lower()}
        elif name == "IN":
            chars: set[str] = set()
            for o, v in arg:
                if str(o) == "LITERAL":
                    chars.add(chr(v).lower())
                elif str(o) == "RANGE" and v[1] - v[0] < 16:
                    chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
                else:
                    chars |= set(map(chr, range(1000)))
            own = chars if len(chars) <= 16 else None
        elif name == "SUBPATTERN":
            own, q = _walk(arg[3])
        elif name == "BRANCH":
            alternatives = [_walk(x) for x in arg[1]]
            if all(a[0] is not None for a in alternatives):
                own = set().union(*[a[0] for a in alternatives])
            q = _absorb(frozenset().union(*[a[1] for a in alternatives]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, sub = arg
            s, sq = _walk(sub)
            if s is not None and most == 1:
                own = s | {""} if least == 0 else s
            elif least >= 1:
                q = sq
        elif name == "AT":
            own = {""}
        if own is not None and len(run) * len(own) <= MAX_STRINGS:
            run = {a + b for a, b in itertools.product(run, own)}
            continue
        query, run = _and(query, _of_strings(run)), {""}
        if own is not None:
            run = own
            exact = False
        else:
            query, exact = _and(query, q), False
    return (run if exact else None), _and(query, _of_strings(run))


def trigram_query(regex: str) -> Clauses:
    """Clauses of lower-cased trigrams; a clause without trigrams: no bound."""
    return _walk(re._parser.parse(regex))[1]


# --------------------------------------------------------------------------
# postings, intersection, verification


def _lowered(text_col) -> Column:
    return F.lower(F.coalesce(F.col(text_col), F.lit("")))


# pieces overlap by two code points, so that no trigram is lost at a border;
# possessive, as a greedy repeat recurses where characters differ in width
PIECE = r"(?s)(?=(.{1,65538}+)).{1,65536}+"
TRIGRAM = r"(?s)(?=(...))."


def _code(trigram) -> Column:
    """What stands for a trigram in the index. Two that share a code would only
    make further candidates, which the regex refuses."""
    return F.xxhash64(trigram)


def postings(docs: DataFrame, trigrams: list[str] | None = None, id_col="doc_id", text_col="text") -> DataFrame:
    """The inverted index (trigram, key) of every trigram of every lower-cased
    text, or of the given trigrams only. Rows may repeat."""
    d = docs.select(null_safe_key(id_col).alias("key"), F.explode(F.regexp_extract_all(_lowered(text_col), F.lit(PIECE), F.lit(1))).alias("piece"))
    held = d.select("key", F.explode(F.array_distinct(F.regexp_extract_all("piece", F.lit(TRIGRAM), F.lit(1)))).alias("held"))
    if trigrams is not None:
        held = held.where(F.col("held").isin(trigrams))
    return held.select(_code("held").alias("trigram"), "key")


def wanted_trigrams(rules) -> list[str]:
    """The trigrams that the rules' queries ask for."""
    return sorted({t for r in rules for c in trigram_query(r.regex) for t in c})


def candidates(index: DataFrame, rules) -> DataFrame:
    """(key, kinds): the indexed rules whose query the document satisfies."""
    spark = index.sparkSession
    rows = []
    for rule in rules:
        for n, clause in enumerate(sorted(map(sorted, trigram_query(rule.regex)))):
            rows += [(rule.kind, n, t, 1 << i, (1 << len(clause)) - 1) for i, t in enumerate(clause)]
    clauses = F.broadcast(spark.createDataFrame(rows, "kind string, clause int, trigram string, bit long, need long").withColumn("trigram", _code("trigram")))  # as many rows as the rules have trigrams
    met = index.join(clauses, "trigram").groupBy("key", "kind", "clause").agg(F.bit_or("bit").alias("have"), F.first("need").alias("need")).where("have = need")
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


MAX_SENT = 500_000  # candidates that are broadcast; more are joined by sorting


def _join_candidates(d: DataFrame, found: DataFrame) -> DataFrame:
    """d with the column ``kinds``; no text moves unless there are more than
    MAX_SENT candidates."""
    found = Scratch(d.sparkSession).cut(found)
    return d.join(F.broadcast(found) if found.count() <= MAX_SENT else found.hint("merge"), "key", "left")


def satisfies(low: Column, rule: Rule) -> Column:
    """Whether a lower-cased text is posted under all trigrams of a clause."""
    clauses = [functools.reduce(operator.and_, [F.contains(low, F.lit(t)) for t in sorted(c)]) for c in sorted(trigram_query(rule.regex), key=sorted)]
    return functools.reduce(operator.or_, clauses)


RUN = 128  # matches that are appended to a list before the list is put away


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end, sized) in code points of the rule's matches. The
    lengths of gaps and matches are folded into places; spans are gathered in
    runs of RUN, as every append copies the list that it appends to."""
    rx = F.lit(rule.regex)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    sized = F.regexp_extract_all(text, rx, F.lit(rule.group)) if rule.group else found
    gaps = F.slice(F.split(text, rule.regex, -1), F.lit(1), F.size(found))
    each = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(found, F.length).alias("hit"), F.transform(sized, F.length).alias("sized"))
    spans = "array<struct<start:int,end:int,sized:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS {spans})").alias("run"), F.expr(f"CAST(array() AS array<{spans}>)").alias("done"))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + x["hit"]
        own, full = F.array(F.struct(start.alias("start"), end.alias("end"), x["sized"].alias("sized"))), F.size(acc["run"]) >= RUN
        run = F.when(full, own).otherwise(F.concat(acc["run"], own))
        return F.struct(end.alias("at"), run.alias("run"), F.when(full, F.concat(acc["done"], F.array(acc["run"]))).otherwise(acc["done"]).alias("done"))

    every = F.aggregate(each, zero, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["run"]))))
    return F.when(F.regexp_like(text, rx), F.filter(every, lambda s: s["sized"] >= rule.least))


def scan(docs: DataFrame, rules=RULES, id_col="doc_id", text_col="text", index: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text, and a column per rule with its
    spans (start, end, sized). ``index`` is a stored index of docs' postings; it
    must hold every trigram of ``wanted_trigrams``, and is read before ``scan``
    returns and not after."""
    bounded = [r for r in rules if frozenset() not in trigram_query(r.regex)]
    d = docs.select(F.col(id_col).alias("doc_id"), null_safe_key(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if index is None or not bounded:
        d = d.withColumn("low", _lowered("text"))
        may = {r.kind: satisfies(F.col("low"), r) for r in bounded}
    else:
        d = _join_candidates(d, candidates(index, bounded))
        may = {r.kind: F.array_contains("kinds", r.kind) for r in bounded}
    none = F.expr("CAST(array() AS array<struct<start:int,end:int,sized:int>>)")
    cols = [F.coalesce(F.when(may[r.kind], _spans(F.col("text"), r)) if r.kind in may else _spans(F.col("text"), r), none).alias(r.kind) for r in rules]
    return d.select("doc_id", "text", *cols)


def span_list(rules) -> Column:
    """kind:start:end of all spans by start, then kind as listed."""
    def tag(n, kind):
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("n"), F.concat(F.lit(f"{kind}:"), s["start"], F.lit(":"), s["end"]).alias("said")))

    tagged = [tag(n, r.kind) for n, r in enumerate(rules)]
    return F.array_join(F.array_sort(F.concat(*tagged))["said"], ",")


def redact(docs: DataFrame, rules=RULES, mark: str = "[secret]") -> DataFrame:
    """doc_id, text with every span of every rule replaced; overlapping spans
    are replaced once."""
    s = scan(docs, rules)
    every = F.array_sort(F.concat(*[F.col(r.kind) for r in rules]))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        fresh = x["start"] >= acc["at"]
        gap = F.substring("text", acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(every, zero, step)
    return s.withColumn("done", done).select("doc_id", F.concat("done.out", F.substring("text", F.col("done.at") + 1, F.length("text"))).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    index = scratch.save(postings(docs))
    s = scan(docs, index=index)
    scratch.drop(index)
    base = [r for r in RULES if r.base]
    return s.select("doc_id", *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in base], F.sha2(span_list(base), 256).alias("base_sha256"), span_list(RULES).alias("spans"))


def _sql() -> str:
    def lit(s):
        return "'" + s.replace("'", "''") + "'"

    ctes, kinds = [], []
    for n, r in enumerate(RULES):
        rx, k = lit(r.regex), r.kind
        ctes.append(f"{k}_m AS (SELECT r, regexp_extract_all(text, {rx}, 0) AS m, regexp_extract_all(text, {rx}, {r.group}) AS g, regexp_split_to_array(text, {rx}) AS b FROM d)")
        ctes.append(
            f"{k}_s AS (SELECT r, {n} AS n, '{k}' AS kind, sum(len(b[i])) OVER o + coalesce(sum(len(m[i])) OVER p, 0) AS s, len(m[i]) AS l, len(g[i]) AS z "
            f"FROM (SELECT r, m, g, b, unnest(range(1, len(m) + 1)) AS i FROM {k}_m) "
            f"WINDOW o AS (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
        )
        kinds.append(f"SELECT * FROM {k}_s WHERE z >= {r.least}")
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    said = "kind || ':' || s::BIGINT || ':' || (s + l)::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
{", ".join(ctes)},
every AS ({" UNION ALL ".join(kinds)}),
g AS (SELECT r, {counts}, string_agg({said}, ',' ORDER BY s, n) FILTER (kind IN ({base})) AS base, string_agg({said}, ',' ORDER BY s, n) AS spans FROM every GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)"""


SQL = _sql()
