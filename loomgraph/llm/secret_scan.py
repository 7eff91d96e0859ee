"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is parsed into a Boolean query over the trigrams that every match holds.
The index has a posting (gram, doc_id) for each such trigram of each document; intersecting postings gives
the candidates of each rule, and the expression itself verifies them. Rules without a mandatory trigram scan
every text. Candidates are broadcast behind a checked bound, else joined by doc_id.

An index can be written once (``write_index``, with the trigrams of any rules to come, or all) and serves any number of scans, of
which each reads the postings of its own trigrams only: files are partitioned by the trigram. Without one a scan makes
the postings it needs and cuts them in the shared folder.

Null texts count as empty: no spans. A row without doc_id is a candidate of every rule. Rows that repeat a doc_id
share their candidates, and each is verified on its own text. Other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre  # type: ignore[attr-defined]
from re import _parser  # type: ignore[attr-defined]

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Candidate documents up to which their ids are broadcast (16 bytes each).
BROADCAST_ROWS = 500_000
#: Strings that one run of a regular expression is expanded to; beyond, the run ends.
EXPAND = 48


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # in the dialect that Java and Python share
    ignore_case: bool = False
    group: int = 0  # the group whose length counts
    least: int = 0

    @property
    def java(self) -> str:
        return ("(?i)" if self.ignore_case else "") + self.pattern


#: The kinds of the base result, in their order.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
]
#: Further kinds, found beside the base ones.
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("google", r"AIza[0-9A-Za-z_-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=60),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=24),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", least=24),
]
RULES = BASE + MORE

# A Boolean query: True, a gram, ("and", ...) or ("or", ...).
Query = bool | str | tuple


def both(kind: str, parts: list[Query]) -> Query:
    whole = kind == "and"
    left = [p for p in parts if p is not whole]
    if any(p is (not whole) for p in left):
        return not whole
    left = list(dict.fromkeys(left))
    return whole if not left else left[0] if len(left) == 1 else (kind, *sorted(left, key=str))


def of_strings(strings: set[str]) -> Query:
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def trigram_query(pattern: str) -> Query:
    """The trigrams that every match of the pattern holds, in lower case."""

    def walk(tree) -> tuple[set[str] | None, Query]:
        """The finite set of strings that it matches, or None, and its query."""
        run: set[str] = {""}
        queries: list[Query] = []
        exact = True

        def close() -> None:
            nonlocal run, exact
            queries.append(of_strings(run))
            run, exact = {""}, False

        for op, arg in tree:
            strings: set[str] | None = None
            query: Query = True
            if op is sre.LITERAL:
                strings = {chr(arg).lower()}
            elif op is sre.IN and all(k in (sre.LITERAL, sre.RANGE) for k, _ in arg):
                chars = {chr(c).lower() for k, a in arg for c in ([a] if k is sre.LITERAL else range(a[0], a[1] + 1))}
                strings = chars if len(chars) <= 6 else None
            elif op is sre.SUBPATTERN:
                strings, query = walk(arg[-1])
            elif op is sre.BRANCH:
                found = [walk(x) for x in arg[1]]
                strings = set().union(*(s for s, _ in found)) if all(s is not None for s, _ in found) else None
                query = both("or", [q for _, q in found])
            elif op is sre.MAX_REPEAT or op is sre.MIN_REPEAT:
                low, high, inner = arg
                inside, inner_query = walk(inner)
                if inside is not None and high == low == 1 or inside is not None and (low, high) == (0, 1):
                    strings = inside | ({""} if low == 0 else set())
                elif low >= 1:
                    query = inner_query
                    if inside is not None:  # one turn at least: the run so far may go on by it, then it ends
                        if len(run) * len(inside) <= EXPAND:
                            run = {a + b for a in run for b in inside}
            if strings is not None and len(run) * len(strings) <= EXPAND:
                run = {a + b for a in run for b in strings}
            else:
                close()
                queries.append(query if strings is None else both("and", [query, of_strings(strings)]))
        if exact:
            return run, both("and", [*queries, of_strings(run)])
        close()
        return None, both("and", queries)

    return walk(_parser.parse(pattern))[1]


def grams_of(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(grams_of, query[1:])) if isinstance(query, tuple) else set()


def holds(query: Query, has) -> Column:
    """The query as a column; has(gram) is the column that tells whether the gram occurs."""
    if isinstance(query, bool):
        return F.lit(query)
    if isinstance(query, str):
        return has(query)
    parts = [holds(q, has) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def grams_for(rules: list[Rule]) -> list[str]:
    """The trigrams that the rules' queries ask for."""
    return sorted(set().union(*(grams_of(trigram_query(r.pattern)) for r in rules)))


def write_index(docs: DataFrame, path: str, rules: list[Rule] = RULES, buckets: int = 64) -> None:
    """Writes the inverted index of the rules' trigrams, in folders by a hash of the trigram and sorted by it, so that a scan reads
    few of them and file statistics skip the rest."""
    index = postings(docs, rules).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    index.repartition("bucket", "gram").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, rules: list[Rule], buckets: int = 64) -> DataFrame:
    """The postings of the rules' trigrams; other folders aren't read."""
    grams = grams_for(rules)
    wanted = F.array(*(F.pmod(F.xxhash64(F.lit(g)), F.lit(buckets)).cast("int") for g in grams))
    numbers = sorted(set(spark.range(1).select(wanted).first()[0]))
    return spark.read.parquet(path).where(F.col("bucket").isin(numbers) & F.col("gram").isin(grams)).select("gram", "doc_id")


def postings(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The inverted index (gram, doc_id), of the trigrams that the rules ask for, in lower case."""
    grams = grams_for(rules)
    low = docs.where("doc_id is not null and text is not null").select("doc_id", F.lower("text").alias("low"))
    present = F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams))
    return low.select("doc_id", F.explode(F.array_compact(present)).alias("gram"))


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, rules): the postings intersected; bit k of rules is set if rule k's query holds."""
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(grams_of, queries)))
    words = [grams[i : i + 60] for i in range(0, len(grams), 60)]

    def word(part: list[str]) -> Column:
        at = F.lit(0).cast("long")
        for k, g in enumerate(part):
            at = F.when(F.col("gram") == g, F.lit(1 << k).cast("long")).otherwise(at)
        return F.bit_or(at)

    lists = index.groupBy("doc_id").agg(*(word(part).alias(f"w{i}") for i, part in enumerate(words)))
    has = lambda g: F.col(f"w{grams.index(g) // 60}").bitwiseAND(F.lit(1 << grams.index(g) % 60).cast("long")) != 0
    bits = F.lit(0).cast("long")
    for k, q in enumerate(queries):
        bits = bits.bitwiseOR(F.when(holds(q, has), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return lists.select("doc_id", bits.alias("rules")).where("rules <> 0")


SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def spans_of(rule: Rule, rank: int, text: str = "text") -> Column:
    """The rule's matches in the text, leftmost and not overlapping; those that are too short are dropped.

    Splitting at the matches gives the code points between them, and so their places.
    """
    p = F.lit(rule.java)
    found = F.regexp_extract_all(F.col(text), p, F.lit(0))
    counted = F.regexp_extract_all(F.col(text), p, F.lit(rule.group)) if rule.group else found
    between = F.slice(F.split(F.col(text), rule.java, -1), F.lit(1), F.size(found))
    empty = F.array().cast(SPAN)

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.char_length(x["between"])
        end = start + F.char_length(x["found"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        out = F.when(F.char_length(x["counted"]) >= rule.least, F.concat(a["out"], F.array(span))).otherwise(a["out"])
        return F.struct(end.alias("at"), out.cast(SPAN).alias("out"))

    zipped = F.arrays_zip(between.alias("between"), found.alias("found"), counted.alias("counted"))
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])


def fewest(rule: Rule) -> str:
    """A cheap necessary test for a match that is kept."""
    return r"[0-9a-f]{24}" if rule.kind == "hex" else rule.java


def scan(docs: DataFrame, rules: list[Rule] = RULES, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, spans): the spans of all rules in each row's text, by start and then the rules' order. index: the postings of docs,
    as read_index gives them; made for this scan if there are none."""
    indexed = [k for k, r in enumerate(rules) if trigram_query(r.pattern) is not True]
    own = [rules[k] for k in indexed]
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if own:
        found = cut(candidates(postings(docs, own) if index is None else index, own)).withColumnRenamed("doc_id", "of_doc")
        if found.count() <= BROADCAST_ROWS:
            found = F.broadcast(found)
        docs = docs.join(found, F.col("doc_id") == F.col("of_doc"), "left").drop("of_doc")
        every = F.when(F.col("doc_id").isNull(), F.lit((1 << len(own)) - 1).cast("long")).otherwise(F.lit(0).cast("long"))
        docs = docs.withColumn("rules", F.coalesce("rules", every))
    parts = []
    for k, r in enumerate(rules):
        test = F.col("text").rlike(fewest(r))
        if k in indexed:
            test = (F.col("rules").bitwiseAND(F.lit(1 << indexed.index(k)).cast("long")) != 0) & test
        parts.append(F.when(test, spans_of(r, k)).otherwise(F.array().cast(SPAN)))
    return docs.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def digest(found: DataFrame, base: list[Rule] = BASE) -> DataFrame:
    kinds = [r.kind for r in base]
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    own = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, kinds), F.sha2(text(own), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def find_in_python(text: str, rules: list[Rule] = RULES) -> list[tuple[str, int, int]]:
    """The same spans by Python's expressions, for tests."""
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, text, re.IGNORECASE | re.ASCII if r.ignore_case else re.ASCII):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), k, m.end(), r.kind))
    return [(kind, s, e) for s, _, e, kind in sorted(out)]


def oracle(rules: list[Rule] = RULES, base: list[Rule] = BASE) -> str:
    """The same rows in DuckDB, by its own expressions: places come from what lies between the matches."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    found = []
    for k, r in enumerate(rules):
        p = q(r.java if r.kind != "hex" else "[0-9a-f]{24,}")  # runs that are long enough, as most letters are a run
        found.append(f"SELECT r, '{r.kind}' AS kind, {k} AS rank, {r.least} AS least, regexp_extract_all(t, {p}, 0) AS f, regexp_extract_all(t, {p}, {r.group}) AS c, regexp_split_to_array(t, {p}) AS b FROM d WHERE regexp_matches(t, {p})")
    told = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    kinds = ", ".join(f"'{r.kind}'" for r in base)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT r, kind, rank, least, f, c, b, unnest(range(1, len(f) + 1)) AS i FROM ({" UNION ALL ".join(found)})),
s AS (SELECT r, kind, rank, least, length(c[i]) AS k, CAST(list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start, length(f[i]) AS n FROM m),
kept AS (SELECT r, kind, rank, start, start + n AS stop FROM s WHERE k >= least),
told AS (SELECT r, {counts}, {told} AS spans, {told} FILTER (kind IN ({kinds})) AS base FROM kept GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told ON d.r = told.r"""
