"""Secret scans by a trigram inverted index, in DataFrame functions alone.

From each rule's regular expression a Boolean query over trigrams is derived: wherever the expression must match one of a few
strings, all trigrams of one of these must occur. Texts are lower-cased for the index only, so letter case never loses a candidate.
Postings hold, for blocks of ``BLOCK`` document ids, which documents contain each trigram a query names; a rule's query
is the intersection and union of postings, and its candidates are verified by the expression itself. A rule
without mandatory trigrams (runs of hexadecimal digits) scans every text.

Spans are counted in code points, ends exclusive; the matches of a kind do not overlap and the leftmost counts, and those
that fall short of the kind's least length are dropped after matching.

Nulls and edge cases: null counts as empty; a text without secrets has zero counts, empty spans, and the digest of the empty string.
Rows with a null doc_id are in no posting and are scanned in full. Rows that repeat a doc_id are candidates together and verified apart.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table

BLOCK = 1024
#: An element that can match more strings than this is taken to match anything; so many trigrams of a string are asked for.
MOST_STRINGS, MOST_TRIGRAMS = 16, 4


@dataclass(frozen=True)
class Rule:
    """Matches of ``regex`` whose ``group`` has at least ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The base kinds, in their order.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Public token formats.
MORE = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("stripe", r"sk_live_[A-Za-z0-9]+", 0, 24),
)


# ---------------------------------------------------------------- trigram queries


def _strings(node) -> set[str] | None:
    """All strings one parsed element can match, lower-cased, or None where they are too many."""
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        return {chr(value).lower()}
    if kind == "IN":
        out = set()
        for k, v in value:
            if str(k) == "LITERAL":
                out.add(chr(v).lower())
            elif str(k) == "RANGE" and v[1] - v[0] < MOST_STRINGS:
                out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return out if len(out) <= MOST_STRINGS else None
    if kind == "SUBPATTERN":
        return _sequence(value[-1])
    if kind == "BRANCH":
        found = [_sequence(x) for x in value[1]]
        if any(x is None for x in found):
            return None
        out = set().union(*found)
        return out if len(out) <= MOST_STRINGS else None
    if kind in ("MAX_REPEAT", "MIN_REPEAT") and value[1] == 1 and value[0] == 0:
        inner = _sequence(value[2])
        return None if inner is None else inner | {""}
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        more = _strings(node)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def _spread(s: str) -> frozenset[str]:
    """Trigrams of ``s``: all, or of a long string ``MOST_TRIGRAMS`` of them spread over it (fewer only widen the candidates)."""
    every = [s[i : i + 3] for i in range(len(s) - 2)]
    step = max(1.0, (len(every) - 1) / (MOST_TRIGRAMS - 1))
    return frozenset(every[min(len(every) - 1, round(k * step))] for k in range(MOST_TRIGRAMS))


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """A conjunction of disjunctions of trigram sets that every text with a match satisfies; empty if nothing is mandatory."""
    runs, run = [], {""}
    for node in re._parser.parse(regex):
        more = _strings(node)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, more)}
            continue
        runs.append(run)
        run = {""} if more is None else more
    runs.append(run)
    query = []
    for run in runs:
        if all(len(s) >= 3 for s in run):
            query.append(sorted({_spread(s) for s in run}, key=sorted))
    return query


# ---------------------------------------------------------------- index


def trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for either in trigram_query(r.regex) for every in either for t in every})


def postings(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row per block of ids: block, and for each trigram the ids of the block's documents that contain it."""
    low = docs.filter("doc_id is not null").select("doc_id", F.lower("text").alias("low"))
    held = low.select("doc_id", *[F.contains("low", F.lit(t)).alias(f"t{k}") for k, t in enumerate(trigrams(rules))])
    held = held.withColumn("block", F.floor(F.col("doc_id") / BLOCK).cast("long"))
    return held.groupBy("block").agg(*[F.collect_set(F.when(F.col(f"t{k}"), F.col("doc_id"))).alias(f"t{k}") for k in range(len(trigrams(rules)))])


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, kinds) of the documents that the rules' queries leave, from postings alone."""
    place = {t: f"t{k}" for k, t in enumerate(trigrams(rules))}

    def ids(rule: Rule) -> Column | None:
        whole = None
        for either in trigram_query(rule.regex):
            some = None
            for every in either:
                one = None
                for t in sorted(every):
                    one = F.col(place[t]) if one is None else F.array_intersect(one, F.col(place[t]))
                some = one if some is None else F.array_union(some, one)
            whole = some if whole is None else F.array_intersect(whole, some)
        return whole

    def told(rule: Rule) -> Column:
        return F.transform(ids(rule), lambda d: F.struct(d.alias("doc_id"), F.lit(rule.kind).alias("kind")))

    lists = [told(r) for r in rules if trigram_query(r.regex)]
    return index.select(F.explode(F.concat(*lists)).alias("c")).groupBy("c.doc_id").agg(F.collect_set("c.kind").alias("kinds"))


# ---------------------------------------------------------------- verification


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in ``text`` as an array of (start, order, end, kind)."""
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    lengths = F.zip_with(F.transform(F.split(text, rule.regex, -1), lambda g: F.length(g)), F.zip_with(whole, part, lambda m, p: F.struct(F.length(m).alias("m"), F.length(p).alias("p"))), lambda g, m: F.struct(g.alias("gap"), m["m"].alias("m"), m["p"].alias("p")))
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def add(acc: Column, x: Column) -> Column:
        here = acc["at"] + x["gap"]
        after = here + F.coalesce(x["m"], F.lit(0))
        span = F.struct(here.alias("start"), F.lit(order).alias("order"), after.alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct(after.alias("at"), F.when(F.coalesce(x["p"] >= rule.least, F.lit(False)), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(lengths, start, add, lambda acc: acc["out"])


def _gate(rule: Rule) -> str:
    """An expression that finds a text with a long enough match, cheaper than collecting its short ones."""
    plain = re.fullmatch(r"(\[[^\]]+\])\+", rule.regex)
    return f"{plain[1]}{{{rule.least}}}" if plain and rule.group == 0 else rule.regex


def find_secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_<kind> of the base kinds, base_sha256, spans."""
    rules = base + more
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    index = cut(postings(source, rules), "secret-postings")
    rows = source.join(candidates(index, rules), "doc_id", "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")
    for k, rule in enumerate(rules):
        able = F.coalesce(F.array_contains("kinds", rule.kind), F.col("doc_id").isNull()) if trigram_query(rule.regex) else F.col("text").rlike(_gate(rule))
        rows = rows.withColumn(f"s_{rule.kind}", F.when(able, spans_of(F.col("text"), rule, k)).otherwise(none))

    def told(kinds: tuple[Rule, ...]) -> Column:
        every = F.array_sort(F.concat(*[F.col(f"s_{r.kind}") for r in kinds]))
        return F.array_join(F.transform(every, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    counts = [F.size(f"s_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in base]
    return rows.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(rules).alias("spans"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(read_table(spark, sf_dir, "documents"))


def oracle(base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> str:
    """The same in DuckDB SQL, without an index."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    spans = []
    for k, r in enumerate(base + more):
        rx = quoted(r.regex)
        spans.append(f"""
        SELECT rid, {k} AS ord, '{r.kind}' AS kind, list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(whole[:i - 1], lambda m: length(m))), 0) AS a,
               length(whole[i]) AS n
        FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i
              FROM (SELECT rid, string_split_regex(t, {rx}) AS gaps, regexp_extract_all(t, {rx}, 0) AS whole, regexp_extract_all(t, {rx}, {r.group}) AS part
                    FROM d WHERE regexp_matches(t, {quoted(_gate(r))})))
        WHERE length(part[i]) >= {r.least}""")
    tell = lambda keep: f"coalesce(string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, ord){keep}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in base)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    s AS ({' UNION ALL '.join(spans)}),
    g AS (SELECT rid, {counts}, {tell(f" FILTER (ord < {len(base)})")} AS own, {tell("")} AS spans FROM s GROUP BY rid)
    SELECT doc_id, {', '.join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in base)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (rid)
    """
