"""Secret scans over a trigram inverted index, in DataFrame functions alone.

Each rule's regex yields a Boolean query over trigrams of lower-cased text: all of
some clauses, of each clause one alternative, of each alternative all trigrams.
Postings (trigram, row) hold the trigrams that any rule asks for; intersecting them
gives each rule's candidate rows, and only on these the regex itself runs. A rule
without mandatory trigrams (a bare character class) scans every row.
"""

from __future__ import annotations

import re._parser as rx
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparloom.functions.arrays import let, scan

from ._common import free_name, stage


@dataclass(frozen=True)
class Rule:
    """Spans are the regex's matches, leftmost and non-overlapping, whose `group` has at least `least` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either(k) for k in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
#: The base rules, in the order that breaks ties; then what the method adds.
BASE = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),  # as all runs of which those of 24 stay, without listing the others
)
RULES = (
    *BASE,
    Rule("github", "gh[oprsu]_[A-Za-z0-9]+", 0, 30),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", "AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
#: Strings that one exact stretch of a regex may stand for before it is given up.
_STRINGS = 128


def trigram_query(regex: str) -> list[set[frozenset[str]]]:
    """Clauses, all of which must hold; of a clause one set must be whole among a text's trigrams. Empty: nothing is mandatory."""
    clauses: list[set[frozenset[str]]] = []
    run = {""}

    def flush() -> None:
        nonlocal run
        if all(len(s) >= 3 for s in run):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            clauses.append({a for a in sets if not any(b < a for b in sets)})
        run = {""}

    def exact(items) -> set[str] | None:
        """All strings that the items match, or None if they are too many."""
        out = {""}
        for op, arg in items:
            if op is rx.LITERAL:
                more = {chr(arg).lower()}
            elif op is rx.IN and all(o is rx.LITERAL for o, _ in arg):
                more = {chr(c).lower() for _, c in arg}
            elif op is rx.BRANCH:
                parts = [exact(b) for b in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif op is rx.SUBPATTERN:
                more = exact(arg[3])
            elif op is rx.MAX_REPEAT and arg[1] is not rx.MAXREPEAT and arg[1] <= 4:
                one = exact(arg[2])
                more = None if one is None else {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(one, repeat=n)}
            else:
                more = None
            if more is None or len(out) * len(more) > _STRINGS:
                return None
            out = {a + b for a in out for b in more}
        return out

    for item in rx.parse(regex):
        more = exact([item])
        if more is not None and len(run) * len(more) <= _STRINGS:
            run = {a + b for a in run for b in more}
        else:
            flush()
            run = more or {""}
    flush()
    return clauses


def _terms(rules: tuple[Rule, ...]) -> list[tuple[str, int, int, str, int]]:
    """(kind, clause, alternative, trigram, trigrams in the alternative) of all rules."""
    return [(r.kind, i, j, t, len(alt)) for r in rules for i, clause in enumerate(trigram_query(r.regex)) for j, alt in enumerate(sorted(clause, key=sorted)) for t in sorted(alt)]


def _row_key(id_col: str, text_col: str) -> Column:
    """Of a row for joins; nulls count as values, and rows of equal keys share candidates, which are verified anyway."""
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(trigram, row): the inverted index of the given trigrams over lower-cased texts; row is a hash of id and text."""
    # one plain search for each trigram is several times faster than one regex with an alternative for each
    low = docs.select(_row_key(id_col, text_col).alias("row"), F.lower(text_col).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted(trigrams)]))
    return low.select("row", F.explode(found).alias("trigram")).select("trigram", "row").distinct()


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, kinds): the rules whose trigram queries hold for a row, by intersecting postings."""
    spark = docs.sparkSession
    terms = _terms(rules)
    asked = F.broadcast(spark.createDataFrame(terms, "kind string, clause int, alt int, trigram string, need int"))  # one row for each rule's trigram
    needed = {k: len({c for kk, c, *_ in terms if kk == k}) for k in {t[0] for t in terms}}
    clauses = F.create_map(*[F.lit(x) for pair in needed.items() for x in pair])
    whole = postings(docs, sorted({t[3] for t in terms}), id_col, text_col).join(asked, "trigram").groupBy("row", "kind", "clause", "alt").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n = need")
    ruled = whole.groupBy("row", "kind").agg(F.count_distinct("clause").alias("n")).where(F.col("n") == clauses[F.col("kind")])
    return ruled.groupBy("row").agg(F.collect_set("kind").alias("kinds"))  # as many as there are rules at most


_SPANS = "array<struct<start:int,ord:int,kind:string,end:int>>"


def _spans(rule: Rule, order: int, text: str, matches: str, groups: str) -> Column:
    """_SPANS from all matches and what lies between them."""
    m, g = F.col(matches), F.col(groups)
    steps = lambda gaps: F.transform(m, lambda _, i: F.length(gaps[i]) + F.when(i > 0, F.length(F.get(m, i - 1))).otherwise(F.lit(0)))
    starts = scan(let(F.split(text, rule.regex, -1), steps), lambda a, b: a + b)
    found = let(starts, lambda at: F.transform(m, lambda x, i: F.struct(at[i].alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (at[i] + F.length(x)).alias("end"), F.length(g[i]).alias("size"))))
    kept = F.transform(F.filter(found, lambda s: s["size"] >= rule.least), lambda s: F.struct(s["start"], s["ord"], s["kind"], s["end"]))
    return F.when(F.exists(g, lambda x: F.length(x) >= rule.least), kept).otherwise(F.array()).cast(_SPANS)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "secrets") -> DataFrame:
    """docs with a column `out`, array<struct<start int, ord int, kind string, end int>>: code points, end exclusive, by start, then rule.

    Null and empty texts have none. Repeated rows and null ids are scanned like any
    other. An input column `out` is replaced; others, of any name, are carried. An
    empty table gives no rows.
    """
    docs = docs.drop(out)
    key, kinds = free_name(docs.columns, "_row"), free_name(docs.columns, "_kinds")
    indexed = tuple(r for r in rules if trigram_query(r.regex))
    found = docs.withColumn(key, _row_key(id_col, text_col))
    if indexed:
        held = stage(candidates(docs, indexed, id_col, text_col)).select(F.col("row").alias(key), F.col("kinds").alias(kinds))
        found = found.join(held, key, "left")  # Spark broadcasts the candidates only when their stored size allows it
    names = []
    for i, r in enumerate(rules):
        m, g, s = (free_name(docs.columns, f"_{x}{i}") for x in "mgs")
        runs = F.array_contains(kinds, r.kind) if r in indexed else F.lit(True)
        empty = F.array().cast("array<string>")
        found = found.withColumn(m, F.when(runs & F.col(text_col).isNotNull(), F.regexp_extract_all(text_col, F.lit(r.regex), 0)).otherwise(empty))
        found = found.withColumn(g, F.when(F.size(m) > 0, F.regexp_extract_all(text_col, F.lit(r.regex), r.group)).otherwise(empty) if r.group else F.col(m))
        found = found.withColumn(s, _spans(r, i, text_col, m, g))
        names.append(s)
    return found.select(*docs.columns, F.array_sort(F.flatten(F.array(*names))).alias(out))


#: Code points of the blocks by which redact() reaches any place of a long text.
_BLOCK = 1024


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each stretch of text that a secret covers replaced by the mask; overlapping spans are one stretch. The same columns."""
    spans = free_name(docs.columns, "_secrets")
    found = find_secrets(docs, id_col, text_col, rules, spans)

    def masked(blocks: Column) -> Column:
        div = lambda x: F.floor(x / _BLOCK).cast("int")
        part = lambda a, b: F.substring(F.array_join(F.slice(blocks, div(a) + 1, div(b) - div(a) + 1), ""), a - div(a) * _BLOCK + 1, b - a)
        ends = scan(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        before = lambda at, s, i: let(F.when(i > 0, F.get(at, i - 1)).otherwise(F.lit(0)), lambda a: F.when(s["start"] >= a, F.concat(part(a, s["start"]), F.lit(mask))).otherwise(F.lit("")))
        pieces = lambda at: F.concat(F.transform(spans, lambda s, i: before(at, s, i)), F.array(part(F.element_at(at, -1), F.length(text_col))))
        return F.array_join(let(ends, pieces), "")

    done = let(F.regexp_extract_all(text_col, F.lit(f"(?s).{{1,{_BLOCK}}}"), 0), masked)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(F.col(text_col))).select(*docs.columns)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _count(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of all documents.

    Null and empty texts have no spans. Repeated rows and null ids are scanned like any
    other. Empty table: no rows.
    """
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["ord"] < len(BASE))
    counts = [_count(r.kind).alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))


def _oracle() -> str:
    """All rules by plain regex scans, spans from the lengths of matches and of what lies between them."""
    parts = []
    for i, r in enumerate(RULES):
        p = r.regex.replace("'", "''")
        parts.append(f"""select r, {i} as o, '{r.kind}' as kind, unnest(range(1, len(m) + 1)) as i, m, g, gaps from (
            select r, regexp_extract_all(text, '{p}', 0) as m, regexp_extract_all(text, '{p}', {r.group}) as g, string_split_regex(text, '{p}') as gaps from d where text is not null) where len(m) > 0""")
    return f"""
with d as (select row_number() over () as r, doc_id, text from documents),
x as ({" union all ".join(f"({p})" for p in parts)}),
s as (select r, o, kind, cast(list_sum(list_transform(gaps[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda z: length(z))), 0) as bigint) as a, length(m[i]) as n, length(g[i]) as size from x),
k as (select r, o, kind, a, concat(kind, ':', a, ':', a + n) as t from s where size >= case kind {" ".join(f"when '{r.kind}' then {r.least}" for r in RULES)} end),
j as (select r, {", ".join(f"count(*) filter (where o = {i}) as n_{r.kind}" for i, r in enumerate(BASE))}, coalesce(string_agg(t, ',' order by a, o) filter (where o < {len(BASE)}), '') as b, string_agg(t, ',' order by a, o) as spans from k group by r)
select doc_id, {", ".join(f"cast(coalesce(n_{r.kind}, 0) as bigint) as n_{r.kind}" for r in BASE)}, sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans from d left join j using (r)"""


ORACLE = {"op9_secrets": _oracle()}
