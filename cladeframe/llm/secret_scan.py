"""Secret scans over a trigram inverted index, in DataFrame operations only.

Each rule is a regular expression.  Its Boolean trigram query is derived from
the parsed expression: wherever a run of it can only be one of a few strings,
the trigrams of one of those strings must all be in the text.

The index holds, for each trigram that some query needs and each chunk of
rows, the sorted list of the rows whose lower-cased text has it.  It is written
to the shared folder; it has no texts, and a list is bounded by the rows of a
chunk.  A query intersects the lists of a string's trigrams, the shortest
first, unites strings and intersects clauses, chunk by chunk.  What comes out,
the rules that each candidate row may match, meets the texts in a join by its
size: texts stay where they are as long as the candidates fit a broadcast.
Only those rules are run on a candidate.  A rule without mandatory trigrams
(long runs of hexadecimal digits) scans every text.

Rows are named by a hash of id and text, so null and repeated ids do no harm and
a hash collision can only add a candidate.

Places come from the lengths of matches and of the pieces between them by
running sums, and a text is cut by byte, so work grows with a text and its
spans and not with their product.

Rows: a null text is empty and has no spans; a null id is kept; repeated rows
are each judged; rules don't suppress each other, so spans of different kinds
may overlap, and of spans that start together (ties) the kind listed first comes
first; a very long text is scanned whole; an empty table gives an empty one;
extra columns are passed on by :func:`redact`; positions are code points, end
exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.functions.storage import materialize, shuffle_partitions, spread
from cladeframe.llm.scans import most_before, sums_before


@dataclass(frozen=True)
class Rule:
    """Leftmost matches, one after another; kept if group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def either_case(words: str) -> str:
    """A pattern for ASCII letters in either case; a case-insensitive flag folds further letters in some engines."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


#: The fixed base rules. ``{24,}`` finds the runs of ``+`` that are long enough.
BASE = (
    Rule("assign", f"({either_case('password|passwd|secret|token|api_?key')})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further kinds, as their issuers document them.
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pay", r"sk_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE
#: Rows of a chunk of the index, so the longest list of postings.
CHUNK_ROWS = 1 << 16
UNITS = {"char": F.length, "byte": F.octet_length}
MOST = 64  # strings that a run of an expression may stand for


def _product(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    if a is None or b is None or len(a) * len(b) > MOST:
        return None
    return {x + y for x in a for y in b}


def _strings(node) -> set[str] | None:
    """All strings, lower-cased, that a parsed node stands for, if they are few."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                out.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT:
        low, high, sub = arg
        one = _sequence(sub)
        if one is None or high is sre.MAXREPEAT or high > 4:
            return None
        out, now = ({""} if low == 0 else set()), {""}
        for k in range(1, high + 1):
            now = _product(now, one)
            if now is None:
                return None
            if k >= low:
                out |= now
        return out
    return None


def _sequence(nodes) -> set[str] | None:
    out: set[str] | None = {""}
    for n in nodes:
        out = _product(out, _strings(n))
    return out


def _grams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """A conjunction of disjunctions of trigram sets; empty: no trigram is mandatory."""
    clauses: list[list[frozenset[str]]] = []

    def close(run: set[str]) -> None:
        sets = {_grams(s) for s in run}
        if frozenset() not in sets:  # else one of the strings has no trigram
            clauses.append(sorted((s for s in sets if not any(t < s for t in sets)), key=sorted))

    def walk(nodes) -> None:
        run: set[str] = {""}
        for n in nodes:
            own = _strings(n)
            joined = _product(run, own)
            if joined is not None:
                run = joined
                continue
            close(run)
            run = {""} if own is None else own
            if own is None and n[0] is sre.SUBPATTERN:
                walk(n[1][3])
        close(run)

    walk(parser.parse(pattern))
    return clauses


def trigram_index(rows: DataFrame, grams: list[str]) -> DataFrame:
    """(chunk, gram, rows): the sorted postings of (key, text) for each of ``grams``."""
    chunks = max(shuffle_partitions(rows.sparkSession), -(-rows.count() // CHUNK_ROWS))
    low = rows.select("key", F.lower("text").alias("low"))
    has = [F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]
    posted = low.select("key", F.explode(F.array_compact(F.array(*has))).alias("gram"))
    chunked = posted.withColumn("chunk", F.pmod("key", F.lit(chunks)).cast("int"))
    return chunked.groupBy("chunk", "gram").agg(F.sort_array(F.collect_set("key")).alias("rows"))


def _found(lists: dict[str, Column], query: list[list[frozenset[str]]]) -> Column:
    """The rows of a chunk that satisfy a query, from the lists of its trigrams."""

    def all_of(grams: frozenset[str]) -> Column:
        ordered = F.array_sort(F.array(*(F.struct(F.size(lists[g]).alias("n"), F.lit(g).alias("gram"), lists[g].alias("rows")) for g in sorted(grams))))
        first = F.element_at(ordered, 1)["rows"]
        return F.aggregate(F.slice(ordered, 2, max(1, len(grams))), first, lambda acc, x: F.array_intersect(acc, x["rows"]))

    out = None
    for clause in query:
        some = all_of(clause[0])
        for s in clause[1:]:
            some = F.array_union(some, all_of(s))
        out = some if out is None else F.array_intersect(out, some)
    return out


def _candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, a boolean column a rule with trigrams): rows that may match, from the index."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for clause in q for s in clause for g in s})
    index = materialize(trigram_index(rows, grams), "secret-index")
    none = F.array().cast("array<long>")
    lists = [F.coalesce(F.first(F.when(F.col("gram") == g, F.col("rows")), ignorenulls=True), none).alias(f"g{i}") for i, g in enumerate(grams)]
    by_chunk = index.groupBy("chunk").agg(*lists)
    named = {g: F.col(f"g{i}") for i, g in enumerate(grams)}
    kinds = list(queries)
    met = by_chunk.select(F.array(*(F.struct(F.lit(i).alias("rule"), _found(named, queries[k]).alias("rows")) for i, k in enumerate(kinds))).alias("met"))
    hits = met.select(F.explode("met").alias("m")).select(F.col("m.rule").alias("rule"), F.explode("m.rows").alias("key"))
    return hits.groupBy("key").agg(*(F.bool_or(F.col("rule") == i).alias(f"may_{k}") for i, k in enumerate(kinds)))


def _both(length: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda a, b: (length(a) + length(b)).cast("long")


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` as the struct __docs, their __text, and __spans by start and then by rule.

    A span is (at, order, end, kind, byte, stop); the last two are its places in bytes.
    """
    own = [F.col(f"`{c}`").alias(c) for c in docs.columns]
    key = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string"))
    rows = spread(docs).select(F.struct(*own).alias("__docs"), key.alias("__key"))
    text = F.coalesce(F.col("__docs")[text_col].cast("string"), F.lit(""))
    index = materialize(_candidates(rows.select(F.col("__key").alias("key"), text.alias("text")), rules), "secret-candidates")
    queried = [c[4:] for c in index.columns if c.startswith("may_")]
    out = rows.join(index.withColumnRenamed("key", "__key"), "__key", "left").withColumn("__text", text)
    none = F.array().cast("array<string>")
    finds, cuts, sizes, starts = {}, {}, {}, {}
    for r in rules:
        pattern = F.lit(r.pattern)
        got = F.regexp_extract_all("__text", pattern, F.lit(0))
        own = F.regexp_extract_all("__text", pattern, F.lit(r.group))
        if r.kind in queried:
            may = F.coalesce(F.col(f"may_{r.kind}"), F.lit(False))
            got, own = F.when(may, got).otherwise(none), F.when(may, own).otherwise(none)
        finds[f"all_{r.kind}"] = got
        if r.group:
            finds[f"own_{r.kind}"] = own
    for r in rules:
        cuts[f"cut_{r.kind}"] = F.when(F.size(f"all_{r.kind}") > 0, F.slice(F.split("__text", r.pattern, -1), 1, F.size(f"all_{r.kind}"))).otherwise(none)
        for unit, length in UNITS.items():  # of each match, the piece before it and itself
            sizes[f"{unit}_{r.kind}"] = F.zip_with(f"cut_{r.kind}", f"all_{r.kind}", _both(length))
            starts[f"{unit}_at_{r.kind}"] = F.when(F.size(f"all_{r.kind}") > 0, sums_before(F.col(f"{unit}_{r.kind}"))).otherwise(F.array().cast("array<long>"))

    def spans(rule: Rule, order: int) -> Column:
        kept = f"own_{rule.kind}" if rule.group else f"all_{rule.kind}"
        columns = {"size": f"char_{rule.kind}", "bytes": f"byte_{rule.kind}", "at": f"char_at_{rule.kind}", "byte": f"byte_at_{rule.kind}", "whole": f"all_{rule.kind}", "kept": kept}
        zipped = F.arrays_zip(*(F.col(c).alias(n) for n, c in columns.items()))
        fit = F.filter(zipped, lambda z: F.length(z["kept"]) >= rule.least)

        def span(z: Column) -> Column:
            end, stop = z["at"] + z["size"], z["byte"] + z["bytes"]
            return F.struct(
                (end - F.length(z["whole"])).cast("int").alias("at"),
                F.lit(order).alias("order"),
                end.cast("int").alias("end"),
                F.lit(rule.kind).alias("kind"),
                (stop - F.octet_length(z["whole"])).cast("int").alias("byte"),
                stop.cast("int").alias("stop"),
            )

        return F.transform(fit, span)

    found = out.withColumns(finds).withColumns(cuts).withColumns(sizes).withColumns(starts)
    return found.select("__docs", "__text", F.array_sort(F.concat(*(spans(r, i) for i, r in enumerate(rules)))).alias("__spans"))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<at,order,end,kind,byte,stop>>) of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return _scanned(rows, rules, "doc_id", "text").select("__docs.doc_id", F.col("__spans").alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each secret replaced by ``[kind]``; overlapping spans become one, named by the first."""
    ends = F.transform("__spans", lambda s: s["stop"].cast("long"))
    out = _scanned(docs, rules, id_col, text_col).withColumn("__ends", ends)
    out = out.withColumn("__done", most_before(F.col("__ends"))).withColumn("__bytes", F.col("__text").cast("binary"))
    # A span that begins where all before it have ended opens a gap of clean text, up to it.
    zipped = F.arrays_zip(F.col("__spans").alias("span"), F.col("__done").alias("done"))
    firsts = F.filter(zipped, lambda z: z["span"]["byte"] >= z["done"])
    piece = lambda a, b: F.substring(F.col("__bytes"), (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    gaps = F.transform(firsts, lambda z: F.concat(piece(z["done"], z["span"]["byte"]), F.lit("["), z["span"]["kind"], F.lit("]")))
    clean = F.concat(F.array_join(gaps, ""), piece(F.array_max("__ends"), F.octet_length("__text").cast("long")))
    old = F.col("__docs")[text_col]
    new = F.when(F.size("__spans") > 0, clean).otherwise(old)
    return out.select(*((new if c == text_col else F.col("__docs")[c]).alias(c) for c in docs.columns))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: Column) -> dict[str, Column]:
    """Counts and digests of spans, as query op4 returns them."""
    base = F.filter(spans, lambda s: s["order"] < len(BASE))
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return {
        **{f"n_{r.kind}": count(r.kind) for r in BASE},
        "base_sha256": F.sha2(span_text(base).cast("binary"), 256),
        "spans": span_text(spans),
    }


def duckdb_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same digest as SQL for DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = "\nUNION ALL ".join(
        f"""SELECT k, {i} AS o, '{r.kind}' AS kind, unnest(range(1, len(m) + 1)) AS i, m, g, p, {r.least} AS least FROM (
        SELECT k, regexp_extract_all(t, {quote(r.pattern)}) AS m, regexp_extract_all(t, {quote(r.pattern)}, {r.group}) AS g,
               string_split_regex(t, {quote(r.pattern)}) AS p FROM d)"""
        for i, r in enumerate(rules)
    )
    sums = ", ".join(f"coalesce(count(*) FILTER (kind = '{r.kind}'), 0)::BIGINT AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({kinds}),
spans AS (
  SELECT k, o, kind, (coalesce(list_sum(list_transform(p[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0))::BIGINT AS a, len(m[i]) AS n
  FROM hits WHERE len(g[i]) >= least
), per AS (
  SELECT k, {sums}, string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) AS spans,
         string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) FILTER (o < {len(BASE)}) AS base
  FROM spans GROUP BY k
)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (k)
"""


def pattern_matches(rule: Rule, text: str) -> list[tuple[int, int]]:
    """The spans of a rule in one text, for tests."""
    flags = re.ASCII
    return [m.span() for m in re.compile(rule.pattern, flags).finditer(text) if len(m[rule.group]) >= rule.least]
