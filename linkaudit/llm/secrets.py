"""Secret scans with a trigram inverted index.

For each rule a Boolean query of trigrams that every match must contain is derived from its pattern, as an OR of
ANDs. The postings (trigram, document) of the trigrams in these queries are written to a table; a clause selects the documents that have postings for all
its trigrams, a rule those that one of its clauses selects. Only these are searched with the rule's pattern. A
rule without mandatory trigrams is searched in every document. Trigrams ignore case, so they may select too much, never too little.

All work on rows is DataFrame functions; Python reads the patterns of the rules only.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as sre  # the standard library's own reader of patterns

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkaudit.functions.binding import let
from linkaudit.llm.common import stored

_MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A pattern that both Python and Java read alike. A match counts if ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: The contract's base rules, in its order. Runs of the last two are cut to their least length in the pattern, which matches the same spans.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", least=6, group=2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Fixed prefixes of widely used credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
)


def _trigrams(text: str) -> frozenset[str]:
    low = text.lower()
    return frozenset(low[i : i + 3] for i in range(len(low) - 2))


class _Derivation:
    """Walks a parsed pattern, keeping the literal strings that may end what has been read, and the conditions met so far."""

    def __init__(self) -> None:
        self.tails: set[str] = {""}
        self.conditions: list[frozenset[frozenset[str]]] = []

    def flush(self) -> None:
        """What follows is unknown: the strings so far become a condition, one clause for each string."""
        clauses = frozenset(_trigrams(t) for t in self.tails)
        if clauses and all(clauses):
            self.conditions.append(clauses)
        self.tails = {""}

    def append(self, strings: set[str] | None) -> None:
        if strings is None:
            self.flush()
            return
        if len(self.tails) * len(strings) > _MOST_STRINGS:
            self.flush()
        if len(strings) > _MOST_STRINGS:
            return
        self.tails = {a + b for a, b in product(self.tails, strings)}

    def walk(self, items) -> None:
        for item in items:
            strings = _strings([item])
            if strings is not None:
                self.append(strings)
                continue
            name, value = str(item[0]), item[1]
            if name == "SUBPATTERN":
                self.walk(value[3])
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                once = _strings(value[2])
                if once is None:
                    self.walk(value[2])
                else:
                    self.append(once)
                self.flush()
            else:
                self.flush()


def _strings(items) -> set[str] | None:
    """All strings that a piece of a pattern matches, in lower case, if they are few; else None."""
    out = {""}
    for item in items:
        name, value = str(item[0]), item[1]
        if name == "LITERAL":
            more: set[str] | None = {chr(value).lower()}
        elif name == "IN" and all(str(n) == "LITERAL" for n, _ in value):
            more = {chr(v).lower() for _, v in value}
        elif name == "SUBPATTERN":
            more = _strings(value[3])
        elif name == "BRANCH":
            parts = [_strings(branch) for branch in value[1]]
            more = None if None in parts else set().union(*parts)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[1] in (0, 1):
            once = _strings(value[2])
            more = None if once is None else once | ({""} if value[0] == 0 else set())
        elif name == "AT":
            more = {""}
        else:
            more = None
        if more is None or len(out) * len(more) > _MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, more)}
    return out


def trigram_query(pattern: str) -> frozenset[frozenset[str]] | None:
    """The clauses, sets of trigrams of which one must be in a match as a whole; None if no trigram is mandatory.

    Of several conditions that all hold, those are joined that keep the clauses few.
    """
    found = _Derivation()
    found.walk(sre.parse(pattern))
    found.flush()
    query: frozenset[frozenset[str]] | None = None
    for clauses in sorted(found.conditions, key=len):
        if query is None:
            query = clauses
        elif len(query) * len(clauses) <= _MOST_STRINGS:
            query = frozenset(a | b for a, b in product(query, clauses))
    if query is None:
        return None
    return frozenset(c for c in query if not any(other < c for other in query))


def _java(pattern: str) -> str:
    return pattern.replace(r"\x20", " ")


def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """``trigram``, ``id``, ``h`` for each document (``id``, ``text``) with one of the trigrams, case ignored; ``h`` is a hash of the text."""
    held = let(F.lower("text"), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t)))
    # explode_outer: before a plain explode Spark puts a filter that computes the array a second and third time
    exploded = docs.select("id", _hash(F.col("text")).alias("h"), held.alias("held")).select(F.explode_outer("held").alias("trigram"), "id", "h")
    return exploded.where("trigram IS NOT NULL")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``id``, ``h`` and ``rules`` (kinds) for the documents that the trigram queries select."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    clauses = [(kind, n, t) for kind, q in queries.items() if q for n, c in enumerate(sorted(map(sorted, q))) for t in c]
    trigrams = sorted({t for _, _, t in clauses})
    if not trigrams:
        return docs.select("id", _hash(F.col("text")).alias("h"), F.array().cast("array<string>").alias("rules")).limit(0)
    found = stored(postings(docs, trigrams), "postings")
    sizes: dict[tuple[str, int], int] = {}
    for kind, n, _ in clauses:
        sizes[kind, n] = sizes.get((kind, n), 0) + 1
    # the clauses of the rules: a few rows, whatever the documents
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(k, n, t, sizes[k, n]) for k, n, t in clauses], "rule string, clause int, trigram string, size int"))
    meet = found.join(wanted, "trigram").groupBy("id", "h", "rule", "clause").agg(F.count_distinct("trigram").alias("n"), F.first("size").alias("size"))
    return stored(meet.where("n = size").groupBy("id", "h").agg(F.collect_set("rule").alias("rules")), "candidates")


def _pieces(text: Column, rule: Rule) -> Column:
    """For each match the text from the end of the one before to its own end, and the match itself."""
    pattern = F.lit(_java(rule.pattern))
    # \G: only from the end of the match before, else the rest of the text would be tried from each of its places
    upto = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{_java(rule.pattern)})"), F.lit(0))
    return F.arrays_zip(upto.alias("upto"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))


def find_spans(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``h`` (a hash of the text), ``kind``, ``place`` of the kind in ``rules``, ``start``, ``end``: every match, leftmost, without overlap within a kind.

    Places are in code points, ends exclusive. Equal rows give their spans once.
    """
    named = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = candidates(named, rules).select(F.col("id").alias("id_2"), F.col("h").alias("h_2"), "rules")
    rows = named.withColumn("h", _hash(F.col("text")))
    rows = rows.join(chosen, F.col("id").eqNullSafe(F.col("id_2")) & (F.col("h") == F.col("h_2")), "left")
    nothing = F.array().cast("array<struct<upto:string,hit:string>>")
    per_rule = []
    for n, rule in enumerate(rules):
        text = F.col("text")
        searched = text.rlike(_java(rule.pattern))
        if trigram_query(rule.pattern):
            searched = F.coalesce(F.array_contains("rules", rule.kind), F.lit(False)) & searched
        per_rule.append(F.struct(F.lit(n).alias("place"), F.when(searched, _pieces(text, rule)).otherwise(nothing).alias("pieces")))
    matched = F.filter(F.array(*per_rule), lambda r: F.size(r["pieces"]) > 0)
    every = rows.select("id", "h", F.explode_outer(matched).alias("r")).where("r IS NOT NULL")
    each = every.select("id", "h", "r.place", F.posexplode("r.pieces").alias("n", "piece"))
    kept_length = [F.length("piece.hit") if r.group == 0 else F.length(F.regexp_extract("piece.hit", _java(r.pattern), r.group)) for r in rules]
    cases = F.lit(False)
    for n, rule in enumerate(rules):
        cases |= (F.col("place") == n) & (kept_length[n] >= rule.least)
    measured = each.select(
        "id", "h", "place", "n", F.length("piece.upto").cast("long").alias("upto"), F.length("piece.hit").cast("long").alias("size"), cases.alias("counts")
    ).dropDuplicates(["id", "h", "place", "n"])
    along = Window.partitionBy("id", "h", "place").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = measured.withColumn("end", F.sum("upto").over(along)).where("counts")
    kinds = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("place") + 1)
    return placed.select("id", "h", kinds.alias("kind"), "place", (F.col("end") - F.col("size")).alias("start"), "end")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[Rule, ...] = MORE) -> DataFrame:
    """One row per document: its id, the number of spans of each base kind, ``base_sha256`` and ``spans``.

    Spans are written ``kind:start:end``, by start, then in the order of the kinds, with commas between. Null and empty
    texts have none; repeated rows give repeated results; a null id is an id like any other; an empty table gives an
    empty result; further columns are ignored.
    """
    rules = (*BASE, *more)
    found = find_spans(docs, rules, id_col, text_col)
    entry = F.struct("start", "place", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("name"))
    per_doc = found.groupBy(F.col("id").alias("id_2"), F.col("h").alias("h_2")).agg(
        *[F.count(F.when(F.col("place") == n, 1)).alias(f"n_{r.kind}") for n, r in enumerate(BASE)], F.array_sort(F.collect_list(entry)).alias("all")
    )
    per_doc = per_doc.withColumn("base", F.filter("all", lambda s: s["place"] < len(BASE)))
    rows = docs.select(F.col(id_col).alias("id"), _hash(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    joined = rows.join(per_doc, F.col("id").eqNullSafe(F.col("id_2")) & (F.col("h") == F.col("h_2")), "left")
    joined_names = lambda c: F.array_join(F.coalesce(F.transform(c, lambda s: s["name"]), F.array().cast("array<string>")), ",")
    return joined.select(
        F.col("id").alias(id_col),
        *[F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in BASE],
        F.sha2(joined_names("base").cast("binary"), 256).alias("base_sha256"),
        joined_names("all").alias("spans"),
    )
