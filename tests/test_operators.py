"""Golden fixtures of the rules, matchers and chunkers."""

import zipfile

import pytest
from pyspark.sql import functions as F

from loomgraph import service, vocab
from loomgraph.functions import chunk
from loomgraph.functions import text as T
from loomgraph.operators import checks, evaluate, export, extract, mutate, paths, resolve, retrieve, rules, stats
from loomgraph.plans import pipeline
from loomgraph.sources import files
from loomgraph.streaming import ingest

ENT = "id string, text string, type string, confidence double"


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column).first()[0]


def test_clean(spark):
    assert one(spark, "A  b ,c\n\n\n\nPage text\nPage 3\nnext\n1\n2\nend .\n", T.clean("t")) == "A b,c\n\nPage text\nnext\n2\nend."


def test_mentions(spark):
    got = one(spark, "This Agreement is by and between TechCorp Inc., a Delaware corporation, and DataSystems LLC. Fee of $50,000 is due January 15, 2024 under Section 5.1.", T.mentions("t"))
    assert set(got) == {"DataSystems LLC", "January 15, 2024", "$50,000", "Section 5.1"}
    assert one(spark, "by March 3 2021 at Acme Limited x", T.mentions("t")) == ["March 3 2021"]


def test_section_headers(spark):
    got = one(spark, "1. GRANT\nText one.\nSection 2: Payment\nText two.\nNOTICES:\nText three.", T.section_headers("t"))
    assert [(h["number"], h["title"], h["content"]) for h in got] == [("2", "Payment", ""), ("1", "GRANT", "Text one.\nSection 2: Payment\nText two."), (None, "NOTICES", "Text three.")]
    assert one(spark, None, T.section_headers("t")) is None and one(spark, "", T.section_headers("t")) == []


def test_section_headers_once(spark):
    """Each header expression reads a text twice at most, however many headers there are; places are told without contents, too."""
    df = spark.createDataFrame([("Section 1.2: A\nb\nArticle 3 C\n4. Dé\nNOTES:\nx",)], "t string")
    got = df.select(T.section_headers("t").alias("h"), T.header_places("t").alias("p"))
    row = got.first()
    assert [(h["number"], h["title"], h["start"], h["end"]) for h in row["h"]] == list(map(tuple, row["p"])) == [("1.2", "A", 0, 14), ("3", "C", 17, 28), ("4", "Dé", 29, 34), (None, "NOTES", 34, 42)]
    plan = df.select(T.section_headers("t").alias("h"))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("regexp_extract_all(t#") <= len(T.HEADERS) and 0 < plan.count("split(t#") <= len(T.HEADERS)


def test_embedding_text(spark):
    df = spark.createDataFrame([("Acme", "near", "Legal_Party", {"role": "buyer"}), ("x", None, "Right", {"role": "no"})], "text string, context string, type string, a map<string,string>")
    assert [r[0] for r in df.select(T.embedding_text("text", "context", "type", "a")).collect()] == ["Acme | near | Type: Legal_Party | Role: buyer", "x | Type: Right"]


def test_clauses():
    assert chunk.clauses("aaaaaaaa\nbbbb\ncccccccc\ndddd", 4, 1) == ["aaaaaaaa\nbbbb", "bbbb\ncccccccc\ndddd"]
    assert chunk.clauses("aaaa\nwordword wordword wordword \nzz", 4, 1) == ["aaaa", "wordword wordword", "wordword", "zz"]


def test_sections(spark):
    d = spark.createDataFrame([(1, "Intro line.\n\nSection 1 Grant of License\nLicensor grants.\nMore text.\n\nSection 2: Payment\nPay $5.")], "doc_id long, text string")
    assert [r["text"] for r in chunk.sections(d).orderBy("section").collect()] == ["Intro line.", "Grant of License\nLicensor grants.\nMore text.", ": Payment\nPay $5."]
    levels = [r["level"] for r in chunk.chunk_table(d).orderBy("chunk_index").collect()]
    assert levels == sorted(levels) and set(levels) == {0, 1, 2}


@pytest.mark.parametrize(("kind", "text", "before", "after"), [("Legal_Party", "TechCorp Inc.", 0.95, 1.0), ("Clause_Reference", "Section 4.2", 0.6, 0.8), ("Financial_Term", "$5", 0.7, 0.65)])
def test_rescored(spark, kind, text, before, after):
    df = spark.createDataFrame([("e", text, kind, before)], ENT)
    assert rules.rescored_entities(df).first()["confidence"] == pytest.approx(after)


@pytest.mark.parametrize(("kind", "text", "c", "ok"), [("Temporal_Entity", "October", 0.75, True), ("Temporal_Entity", "stop", 0.75, True), ("Temporal_Entity", "48 hours", 0.7, True), ("Temporal_Entity", "30 minutes", 0.7, True), ("Temporal_Entity", "xyz", 0.75, False), ("Temporal_Entity", "xyz", 0.85, True), ("Legal_Party", "It", 0.9, False), ("Obligation", "x" * 1001, 0.9, False), ("Obligation", " ", 0.9, False)])
def test_faults(spark, kind, text, c, ok):
    df = spark.createDataFrame([("e", text, kind, c)], ENT)
    assert (df.select(rules.entity_fault(F.col("text"), F.col("type"), F.col("confidence"))).first()[0] is None) == ok


@pytest.mark.parametrize(("kind", "evidence", "before", "after"), [("OBLIGATES", "Seller shall pay", 0.6, 0.8), ("GRANTS_RIGHT", "hereby grants", 0.7, 0.95)])
def test_rescored_edges(spark, kind, evidence, before, after):
    df = spark.createDataFrame([("a", "b", kind, before, evidence)], "source_id string, target_id string, type string, confidence double, evidence string")
    assert rules.rescored_edges(df).first()["confidence"] == pytest.approx(after)


PRED = [("pred_1", "TechCorp Inc.", "Legal_Party", 0.95, 10, 23), ("pred_2", "Payment of $10,000", "Financial_Term", 0.88, 50, 68), ("pred_3", "Confidentiality", "Obligation", 0.92, 100, 115), ("pred_4", "California", "Jurisdiction", 0.97, 200, 210), ("pred_5", "Nonexistent Party", "Legal_Party", 0.70, 300, 317)]
GOLD = [("gt_1", "TechCorp Inc.", "Legal_Party", 1.0, 10, 23), ("gt_2", "Payment of $10,000", "Financial_Term", 1.0, 50, 68), ("gt_3", "Confidentiality", "Obligation", 1.0, 100, 115), ("gt_4", "California", "Jurisdiction", 1.0, 200, 210), ("gt_5", "30 days", "Temporal_Entity", 1.0, 250, 257)]


def test_evaluation(spark):
    schema = "id string, text string, type string, confidence double, start int, end int, ordinal long"
    p, g = (spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], schema) for rows in (PRED, GOLD))
    key = lambda df: df.withColumn("k", F.lower(F.trim("text")))
    m = evaluate.with_metrics(evaluate.exact_counts(key(p), key(g), ["k", "type"])).first()
    assert (m["tp"], m["fp"], m["fn"], m["f1"]) == (4, 1, 1, 0.8)
    by = evaluate.exact_counts(key(p), key(g), ["k", "type"], "type")
    macro = {r["average"]: r for r in evaluate.averages(by).collect()}
    assert (macro["macro"]["precision"], macro["macro"]["recall"], macro["macro"]["f1"]) == (0.7, 0.8, 0.7333)
    cal = evaluate.calibration(p.where("id <> 'pred_5'").withColumn("correct", F.lit(True))).first()
    assert (cal["ece"], cal["mce"]) == (0.075, 0.15)
    assert evaluate.calibration(p.limit(0).withColumn("correct", F.lit(True))).first()["ece"] == 0.0
    assert evaluate.best_overlaps(p, g).count() == 4 and evaluate.best_fuzzy(p, g).count() == 4
    rel = "source_id string, target_id string, type string"
    pe = spark.createDataFrame([("pred_1", "pred_2", "OBLIGATES"), ("pred_1", "pred_3", "OBLIGATES"), ("pred_4", "pred_1", "GOVERNS"), ("pred_5", "pred_2", "REFERENCES")], rel)
    ge = spark.createDataFrame([("gt_1", "gt_2", "OBLIGATES"), ("gt_1", "gt_3", "OBLIGATES"), ("gt_4", "gt_1", "GOVERNS"), ("gt_2", "gt_5", "TEMPORALLY_PRECEDES")], rel)
    pt, gt = evaluate.triples(pe, p), evaluate.triples(ge, g)
    assert (pt.intersect(gt).count(), pt.subtract(gt).count(), gt.subtract(pt).count()) == (3, 1, 1)
    whole = lambda df: df.withColumns({"id": F.concat("source_id", "target_id"), "confidence": F.lit(0.9), "evidence": F.lit("e" * 150), "ordinal": F.lit(0)})
    ent = evaluate.evaluate_entities(p, g)
    assert [tuple(ent["overall"].first()[c] for c in ("tp", "fp", "fn", "support", "f1"))] == [(4, 1, 1, 5, 0.8)]
    assert [(r["error"], r["rank"], r["text"]) for r in ent["examples"].orderBy("error").collect()] == [("false_negative", 1, "30 days"), ("false_positive", 1, "Nonexistent Party")]
    assert ent["calibration"].first()["ece"] == 0.075 and ent["confusion"].count() == 4
    rel = evaluate.evaluate_edges(whole(pe), whole(ge))
    assert [tuple(rel["overall"].first()[c] for c in ("tp", "fp", "fn", "f1"))] == [(0, 4, 4, 0.0)]
    assert len(rel["examples"].first()["evidence"]) == 100
    graph = evaluate.evaluate_graph(p, pe, g, ge)
    assert [tuple(graph["overall"].first()[c] for c in ("tp", "fp", "fn", "f1"))] == [(3, 1, 1, 0.75)]
    assert set(graph["components"].first()) == {0}
    loose = evaluate.evaluate_graph(p, pe, g.withColumn("text", F.when(F.col("id") == "gt_1", "TechCorp Inc").otherwise(F.col("text"))), ge, "relaxed")
    assert (loose["overall"].first()["tp"], loose["overall_relaxed"].first()["tp"]) == (0, 3)
    assert evaluate.results_json({"overall": graph["overall"]}).first()["line"].startswith('{"result":"overall","row":{"tp":3')


def test_fuzzy_is_whole(spark):
    """The pruned search finds just the pairs that comparing all finds."""
    import difflib
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randint(0, 14))) for _ in range(60)]
    texts += [t[: k % 5] + rng.choice("abcde") + t[k % 5 + 1 :] for k, t in enumerate(texts)] + ["x", "y", "xy", "payment of fees", "payments of fee"]
    left, right = texts[::2], texts[1::2]
    df = lambda xs: spark.createDataFrame([("b", t) for t in xs], "block string, text string")
    got = {(r["a"], r["b"]) for r in evaluate.similar_texts(df(left), df(right), 0.8).collect()}
    assert got == {(a, b) for a in left for b in right if difflib.SequenceMatcher(None, a, b).ratio() >= 0.8}


def test_overlap_and_fuzzy(spark):
    s = "id string, start int, end int, ordinal long"
    p = spark.createDataFrame([("p", 0, 10, 0)], s)
    assert evaluate.best_overlaps(p, spark.createDataFrame([("g", 5, 15, 0)], s), 0.3).first()["score"] == 0.3333
    assert evaluate.best_overlaps(p, spark.createDataFrame([("g", 10, 20, 0)], s), 0.0).count() == 0
    t = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string")
    assert [r[0] for r in t.select(resolve.ratio("a", "b")).collect()] == [0.25, 0.5]


def test_dedupe(spark):
    df = spark.createDataFrame([("1", "ABC", "T", 0.8), ("2", "abc ", "T", 0.9), ("3", "ABC", "T", 0.7)], ENT)
    r = resolve.dedupe_exact(df).collect()
    assert [(x["id"], x["found_aliases"], x["merged"]) for x in r] == [("2", ["ABC"], 2)]


def test_coreference(spark):
    e = spark.createDataFrame([("e1", "TechCorp Inc.", "Legal_Party", "TechCorp Inc. (the 'Licensor') agrees", 0), ("e2", "Acme LLC", "Legal_Party", None, 1)], "id string, text string, type string, context string, ordinal long")
    m = spark.createDataFrame([("the Licensor",), ("It",), ("acme llc",), ("Acme",), ("nobody",)], "mention string")
    got = {r["mention"]: r["canonical_id"] for r in resolve.resolve(m, e, resolve.party_aliases(e)).collect()}
    assert got == {"the Licensor": "e1", "It": None, "acme llc": "e2", "Acme": "e2", "nobody": None}
    odd = spark.createDataFrame([("themselves",), ("this",), ("",), ("hc",)], "mention string")
    assert {r["mention"]: r["canonical_id"] for r in resolve.resolve(odd, e, resolve.party_aliases(e)).collect()} == {"themselves": None, "this": None, "": "e1", "hc": "e1"}
    ids = spark.createDataFrame([("e1",), ("techcorp inc.",), ("e9",)], "id string")
    assert {r["id"]: r["canonical_id"] for r in resolve.canonical_ids(ids, resolve.defined_aliases(e)).collect()} == {"e1": "e1", "techcorp inc.": "e1", "e9": "e9"}
    assert resolve.merge_coreferent(e.withColumn("confidence", F.lit(0.5))).count() == 2


def test_partial_names(spark):
    """Mentions find the first name that holds them, as a loop does, and no join compares the names that share a piece one by one."""
    import random

    rng = random.Random(5)
    names = ["".join(rng.choice("abé ") for _ in range(rng.randint(1, 9))).strip() or "a" for _ in range(60)] + ["ab inc", "b", ""]
    e = spark.createDataFrame([(f"e{k}", x, "Legal_Party", k) for k, x in enumerate(names)], "id string, text string, type string, ordinal long")
    words = sorted({"".join(rng.choice("abé ") for _ in range(rng.randint(1, 5))) for _ in range(80)} | {"", "zz", names[7] + "q"})
    found = resolve.resolve(spark.createDataFrame([(w,) for w in words], "mention string"), e, spark.createDataFrame([], "alias string, canonical_id string"))
    key = lambda x: " ".join(x.split())
    first = lambda w: next((f"e{k}" for k, x in enumerate(names) if key(w) == key(x)), None) or next((f"e{k}" for k, x in enumerate(names) if key(w) in key(x)), None)
    assert {r["mention"]: r["canonical_id"] for r in found.collect()} == {w: first(w) for w in words}
    assert "Contains(" not in found._jdf.queryExecution().executedPlan().toString()


def test_edges_without_a_text_spread(spark):
    """Ends that look for no text don't meet in one task under one empty key."""
    edges = spark.range(2_000).select(F.col("id").cast("string"), F.lit("s").alias("source_id"), F.lit("").alias("source_text"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("target_id"), F.lit("").alias("target_text"))
    e = spark.createDataFrame([("e1", "Acme", "Legal_Party", 0)], "id string, text string, type string, ordinal long")
    own = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(own, ("-1", "false"), strict=True):
            spark.conf.set(k, v)
        out = resolve.resolve_edges(edges, e, resolve.party_aliases(e))
        assert out.count() == 2_000 and max(r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 1_500
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)


def test_clusters(spark):
    rows = [("1", "ABC", "T", 0.8, 0, [1.0, 0.0]), ("2", "abc ", "T", 0.9, 1, [1.0, 0.0]), ("3", "near", "T", 0.7, 2, [0.0, 1.0]), ("4", "close", "T", 0.95, 3, [0.01, 1.0]), ("5", "zero", "T", 0.5, 4, [0.0, 0.0]), ("6", "none", "T", 0.5, 5, None), ("7", "lone", "U", 0.5, 6, [1.0, 0.0])]
    e = spark.createDataFrame(rows, "id string, text string, type string, confidence double, ordinal long, embedding array<double>")
    assert sorted(r["id"] for r in resolve.dedupe(e).collect()) == ["2", "4", "5", "6", "7"]
    got = sorted(map(tuple, resolve.disambiguate(e).collect()))
    assert got == [("2", "1"), ("2", "2"), ("3", "3"), ("3", "4"), ("7", "7")]
    assert {r["id"] for r in resolve.disambiguate(e, include_singletons=True).collect()} == {r[0] for r in rows}
    m = spark.createDataFrame(got, "canonical_id string, id string")
    merged, kept = resolve.merge_clusters(m, "7", "3")
    assert kept == "3" and merged.where("canonical_id = '3'").count() == 3 and resolve.merge_clusters(m, "x", "3")[1] == "x"
    two = "struct<id:string,text:string,confidence:double,aliases:array<string>,attributes:map<string,string>>"
    pair = spark.createDataFrame([(("a", "A", 0.5, ["x"], {"k": "1"}), ("b", "B", 0.75, None, {"k": "2", "l": "3"}))], f"a {two}, b {two}")
    r = pair.select(resolve.merged_two(F.col("a"), F.col("b")).alias("m")).first()["m"]
    assert (r["id"], r["aliases"], r["confidence"], r["attributes"]) == ("b", ["A"], 0.625, {"k": "2", "l": "3"})


def test_greedy_like_a_loop(spark):
    """The scan over similar pairs keeps what a scan over all rows keeps, and rows without a direction."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.standard_normal((120, 4))
    score = rng.integers(0, 5, 120)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    alive, free, lead = [True] * 120, [True] * 120, []
    for i in range(120):
        for j in range(i + 1, 120):
            if alive[i] and alive[j] and u[i] @ u[j] >= 0.8:
                if score[j] > score[i]:
                    alive[i] = False
                else:
                    alive[j] = False
        own = [j for j in range(i + 1, 120) if free[i] and free[j] and u[i] @ u[j] >= 0.8]
        for j in own:
            free[j] = False
        lead += [(i, j) for j in ([i, *own] if own else [])]
    df = spark.createDataFrame([(i, v.tolist(), 0, float(s)) for i, (v, s) in enumerate(zip(x, score, strict=True))] + [(500, [0.0] * 4, 0, 1.0), (501, None, 0, 1.0)], "vec_id long, embedding array<double>, label int, confidence double")
    assert sorted(r["vec_id"] for r in resolve.greedy(df, 0.8).collect()) == [i for i in range(120) if alive[i]] + [500, 501]
    assert sorted(map(tuple, resolve.leaders(df, 0.8).collect())) == sorted(lead)


def test_replay(spark):
    answer = '```json\n{"entities": [{"text": "Acme Inc.", "type": "Legal_Party", "confidence": 0.9}, {"text": "x", "type": "Odd", "confidence": 1.2}, {"text": "thing", "type": "Odd"}]}\n```'
    bare = '[{"text": "bare", "type": "Right", "confidence": 0.8}]'
    c = spark.createDataFrame([("c1", "d1", "text", answer), ("c2", "d1", "text", bare), ("c3", "d1", "text", "no json")], "id string, document_id string, text string, response string")
    got = {r["text"]: (r["type"], r["confidence"]) for r in extract.replay_entities(c).collect()}
    assert got == {"Acme Inc.": ("Legal_Party", 0.9), "thing": ("Legal_Concept", 0.5), "bare": ("Right", 0.8)}
    g = pipeline.extract_graph(c, "response")
    assert {r["text"] for r in g.entities.collect()} == {"Acme Inc.", "bare"} and g.edges.count() == 0 and g.rejected.count() == 1


def test_paths(spark):
    e = spark.createDataFrame([("e1", "a", "b", "T"), ("e2", "b", "c", "T"), ("e3", "a", "c", "U")], "id string, source_id string, target_id string, type string")
    assert [r["edge_ids"] for r in paths.trails(e, "a", "c").collect()] == ["e3", "e1>e2"]
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert paths.mean_distance(e, n).first()["avg_distance"] == 1.0
    assert paths.pagerank(n, e, 3).count() == 3


def test_mean_distance_like_a_loop(spark):
    """All pairs of a graph in parts, with a hub and a long chain, as a plain search has them; the pairs are never rows of a job."""
    import random
    from collections import deque

    rng = random.Random(2)
    links = [(f"a{rng.randrange(150)}", f"a{rng.randrange(150)}") for _ in range(120)] + [("hub", f"a{k}") for k in range(0, 150, 9)] + [(f"c{k}", f"c{k + 1}") for k in range(90)]
    own = [f"a{k}" for k in range(0, 150, 2)] + [f"c{k}" for k in range(0, 91, 3)] + ["alone"]
    edges = spark.createDataFrame([(str(k), *e, "T") for k, e in enumerate(links)], "id string, source_id string, target_id string, type string")
    nodes = spark.createDataFrame([(x,) for x in own], "id string")
    near: dict = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def loop(most):
        out = []
        for s in own:
            far, todo = {s: 0}, deque([s])
            while todo:
                x = todo.popleft()
                for y in near.get(x, ()) if most is None or far[x] < most else ():
                    if y not in far:
                        far[y] = far[x] + 1
                        todo.append(y)
            out += [far[t] for t in own if s < t and t in far]
        return len(out), int(sum(out) / len(out) * 10_000 + 0.5) / 10_000  # halves go up

    for most in (None, 3):
        df = paths.mean_distance(edges, nodes, most)
        assert tuple(df.first()) == loop(most)
        assert "distance" not in str(df._jdf.queryExecution().optimizedPlan().collectLeaves())  # not read from a table of pairs
    assert tuple(paths.mean_distance(edges.limit(0), nodes).first()) == (0, None) and tuple(paths.mean_distance(edges.limit(0), nodes.limit(0)).first()) == (0, None)


def test_long_paths(spark):
    """Paths of any length and type, also over nodes that aren't asked for."""
    e = spark.createDataFrame([(f"e{k}", f"n{k:02}", f"n{k + 1:02}", "T" if k % 2 else "U") for k in range(25)], "id string, source_id string, target_id string, type string")
    got = paths.mean_distance(e, spark.createDataFrame([("n00",), ("n01",), ("n25",)], "id string")).first()
    assert (got["pairs"], got["avg_distance"]) == (3, round((1 + 25 + 24) / 3, 4))


def test_long_cycle(spark):
    """A ring of more than 20 nodes is one cycle, and the check finds all its nodes, whatever hangs on it."""
    ring = [(f"e{k}", f"n{k:02}", f"n{(k + 1) % 23:02}", "DEPENDS_ON") for k in range(23)] + [("x", "n22", "z", "DEPENDS_ON")]
    e = spark.createDataFrame(ring, "id string, source_id string, target_id string, type string")
    assert [tuple(r) for r in checks.cycles(e).collect()] == [("n00", 23)]
    assert sorted(map(tuple, checks.cycle_nodes(e).collect())) == [(f"n{k:02}", "n00") for k in range(23)]
    more = [("c1", "a", "b"), ("c2", "b", "a"), ("c3", "b", "n05"), ("c4", "n07", "q"), ("c5", "q", "q"), ("c6", "q", "r")] + [(f"l{k}", f"l{k}", f"l{k + 1}") for k in range(40)]
    e = e.unionAll(spark.createDataFrame([(*r, "DEPENDS_ON") for r in more], "id string, source_id string, target_id string, type string"))
    got = {r["node"]: r["component"] for r in checks.cycle_nodes(e).collect()}
    assert got == {f"n{k:02}": "n00" for k in range(23)} | {"a": "a", "b": "a", "q": "q"}
    assert checks.cycle_nodes(e.where("id like 'l%'")).count() == 0


ODD_NODES = [("a", "A", "T", "LegalParty", 0.5), ("b", None, "T", "Odd", 1.5), ("c", "C", None, None, None), ("d", "D", "T", "Odd", 0.1), (None, "N", "T", "Odd", 0.1)]
ODD_EDGES = [
    ("1", "a", "b", "X", 0.5), ("2", "a", "b", "X", 0.9), ("3", "a", "b", None, 0.5), ("4", "a", "b", None, 0.4), ("4", "b", "a", "X", 0.4), ("5", "a", "gone", "X", 2.0), ("5", "a", "a", "X", 0.5),
    ("6", "c", "c", "OBLIGATES", -1.0), ("7", "b", "a", "OBLIGATES", 0.5), ("8", "c", "a", "OBLIGATES", None), ("9", None, "a", "X", 0.5), ("10", "gone", "gone", "X", 0.5), ("11", "away", "gone", None, 0.5),
]


def odd_graph(spark):
    return spark.createDataFrame(ODD_NODES, "id string, text string, type string, label string, confidence double"), spark.createDataFrame(ODD_EDGES, "id string, source_id string, target_id string, type string, confidence double")


def passes(df, name):
    """How often a plan reads what has so many rows that it can't be taken for another."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(name)


def test_summary_counts_the_checks_rows(spark):
    """The summary's numbers are those of the checks' rows, on nulls, lost ends and odd types too, and on no rows."""
    n, e = odd_graph(spark)
    for nodes, edges in ((n, e), (n.limit(0), e), (n, e.limit(0)), (n.limit(0), e.limit(0))):
        want = {k: (s, df.count()) for k, (s, df) in checks.all_checks(nodes, edges).items()}
        assert {r["check"]: (r["severity"], r["issues"]) for r in checks.summary(nodes, edges).collect()} == want
        assert all(r["passed"] == (r["issues"] == 0) for r in checks.summary(nodes, edges).collect())
    big = spark.range(7_777_777).select(*(F.col("id").cast("string").alias(c) for c in ("id", "source_id", "target_id", "type")), F.lit(0.5).alias("confidence"))
    assert passes(checks.summary(n, big.where("source_id < '1'")), "Range (0, 7777777") <= 3


def test_repair_report_counts_what_repair_removes(spark):
    """Ids that name several edges, null types and lost ends: the report counts what the repaired graph lacks."""
    n, e = odd_graph(spark)
    for nodes, edges in ((n, e), (n.limit(0), e), (n, e.limit(0))):
        lost, (kept_nodes, kept) = checks.dangling(nodes, edges), checks.repair(nodes, edges)
        good = edges.join(lost, "id", "left_anti")
        want = (nodes.count() - kept_nodes.count(), lost.count(), checks.self_loops(good).count(), good.where("source_id <> target_id").join(kept.select("id"), "id", "left_anti").count())
        assert tuple(checks.repair_report(nodes, edges).first()) == want
    few = spark.range(7_777_777).select(*(F.col("id").cast("string").alias(c) for c in ("id", "source_id", "target_id", "type")), F.lit(0.5).alias("confidence")).where("source_id < '1'")
    assert passes(checks.repair_report(n, few), "Range (0, 7777777") <= 1


def test_edges_read_once(spark):
    """Degrees and Turtle read the edges once, not once for each end or line."""
    n, e = odd_graph(spark)
    e = spark.range(7_777_777).select(*(F.col("id").cast("string").alias(c) for c in ("id", "source_id", "target_id", "type")), F.lit(0.5).alias("confidence"))
    assert passes(stats.degrees(n, e), "Range (0, 7777777") == passes(export.turtle(n.withColumn("document_id", F.lit("d")), e), "Range (0, 7777777") == 1


def test_pagerank_reads_nodes_once(spark):
    """The rounds' plans read the ids from where they were put, not each from the nodes' own plan."""
    n = spark.range(2_222_222).where("id < 3").select(F.col("id").cast("string").alias("id"))
    e = spark.createDataFrame([("0", "1"), ("1", "2")], "source_id string, target_id string")
    ranks = paths.pagerank(n, e, 5)
    assert ranks.count() == 3 and passes(ranks, "Range (0, 2222222") == 0


def test_dealt_by_size(spark, tmp_path):
    """The tasks that a table is dealt over grow with it, so that a task's share doesn't."""
    from loomgraph import adapter

    path = str(tmp_path / "t")
    spark.range(3_000_000).select(F.xxhash64("id").alias("k")).coalesce(1).write.parquet(path)
    size = sum(p.stat().st_size for p in (tmp_path / "t").glob("*.parquet"))
    parts = adapter.dealt(spark.read.parquet(path), "k").rdd.getNumPartitions()
    assert parts >= size / adapter.TASK_BYTES > 4


def test_mutations(spark):
    n = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    new, rejected = mutate.insert_nodes(n, spark.createDataFrame([("b", "z"), ("c", "z")], "id string, text string"))
    assert new.count() == 3 and rejected.count() == 1
    new, rejected = mutate.insert_nodes(n, spark.createDataFrame([("c", "1"), ("c", "2")], "id string, text string"), "text")
    assert (new.count(), [tuple(r) for r in rejected.collect()]) == (3, [("c", "2")])
    assert mutate.update_nodes(n, spark.createDataFrame([("a", "q")], "id string, text string")).where("text = 'q'").count() == 1
    twice = mutate.update_nodes(n, spark.createDataFrame([("a", "q", 2), ("a", "r", 1)], "id string, text string, k int"), "k")
    assert sorted(map(tuple, twice.collect())) == [("a", "q"), ("b", "y")]
    bag = spark.createDataFrame([("a", {"x": "1", "y": "2"})], "id string, attributes map<string,string>")
    patch = spark.createDataFrame([("a", "x", None), ("a", "z", "3")], "id string, key string, value string")
    assert mutate.patch_attributes(bag, patch).first()["attributes"] == {"y": "2", "z": "3"}


def test_storage(spark, tmp_path):
    schema = "id string, text string, type string, confidence double, context string, document_id string, chunk_id string, start int, end int, attributes map<string,string>, aliases array<string>"
    e = spark.createDataFrame([("e1", "Acme", "Legal_Party", 0.9, "", "d1", "c1", 3, 7, {"role": "buyer"}, ["A", "B"]), ("e2", "x", "Odd", 0.8, "near", "d2", None, None, None, None, None)], schema)
    path = str(tmp_path / "nodes")
    assert mutate.store_entities(e, path) == 2
    flat = spark.read.parquet(path)
    assert {r["id"]: (r["label"], r["properties"], r["aliases"], r["context"]) for r in flat.collect()} == {"e1": ("LegalParty", {"attr_role": "buyer"}, "A,B", None), "e2": ("Entity", {}, None, "near")}
    back = {r["id"]: r for r in mutate.read_entities(flat).collect()}
    assert (back["e1"]["attributes"], back["e1"]["aliases"], back["e1"]["position"]["end"], back["e2"]["type"], back["e2"]["position"]) == ({"role": "buyer"}, ["A", "B"], 7, "Legal_Concept", None)
    assert mutate.store_entities(e.where("id = 'e1'").withColumn("text", F.lit("new")), path, "overwrite") == 1
    assert sorted(r["text"] for r in spark.read.parquet(path).collect()) == ["new", "x"]
    edges = spark.createDataFrame([("r1", "e1", "e2", "OBLIGATES", 0.9, "d1", {"amount": "5"}, {"deadline": "May"}), ("r2", "e1", "gone", "OBLIGATES", 0.9, "d1", None, None)], "id string, source_id string, target_id string, type string, confidence double, document_id string, properties map<string,string>, temporal_info map<string,string>")
    assert mutate.store_edges(edges, e, str(tmp_path / "edges")) == (1, 1)
    r = mutate.read_edges(spark.read.parquet(str(tmp_path / "edges"))).first()
    assert (r["type"], r["source_id"], r["properties"], r["temporal_info"]) == ("OBLIGATES", "e1", {"amount": "5"}, {"deadline": "May"})
    tables = mutate.initialise(spark, str(tmp_path / "db"))
    assert spark.read.parquet(tables["nodes"]).count() == 0
    mutate.store_indexed(e.select("id", "text", "type", "document_id"), str(tmp_path / "i"), ["type"])
    assert spark.read.parquet(str(tmp_path / "i")).count() == 2
    mutate.clear(spark, tables["nodes"], "id string")
    assert mutate.constraints(spark).where("kind = 'unique'").count() == 10


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Caf\xe9 contract".encode("latin-1"))
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two policy</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "c.xyz").write_text("?")
    with zipfile.ZipFile(tmp_path / "b.docx", "a") as z:
        z.writestr("docProps/core.xml", '<c:coreProperties xmlns:c="c" xmlns:d="d"><d:creator>Ann</d:creator></c:coreProperties>')
    import zlib

    page = zlib.compress(b"BT /F1 12 Tf 72 700 Td (First \\(page\\)) Tj 0 -14 Td [(amend) -20 (ment) -300 (two)] TJ ET")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4\n1 0 obj << /Type /Pages /Kids [2 0 R] >> endobj\n2 0 obj << /Type /Page /Contents 3 0 R >> endobj\n3 0 obj << /Length " + str(len(page)).encode() + b" /Filter /FlateDecode >> stream\n" + page + b"\nendstream endobj\n4 0 obj << /Title (T) /Author (Bob) >> endobj\ntrailer << /Info 4 0 R >>")
    (tmp_path / "e.pdf").write_bytes(b"not a pdf")
    docs, rejects = files.read_documents(spark, str(tmp_path))
    assert {r["content"]: r["document_type"] for r in docs.collect()} == {"Café contract": "agreement", "One\n\nTwo policy": "policy", "First (page)\namendment two": "amendment"}
    assert rejects.count() == 2
    meta = {r["title"]: r["metadata"] for r in docs.collect()}
    assert meta["a"]["file_name"] == "a.txt" and meta["a"]["file_size"] == "13"
    assert (meta["b"]["author"], meta["b"]["paragraph_count"]) == ("Ann", "3") and (meta["d"]["page_count"], meta["d"]["author"]) == ("1", "Bob")
    (tmp_path / "cuad" / "full_contract_txt").mkdir(parents=True)
    (tmp_path / "cuad" / "CUAD_v1.json").write_text('{"data": [{"a": 1}, {"a": 2}]}')
    (tmp_path / "cuad" / "full_contract_txt" / "x.txt").write_text("x")
    assert tuple(files.annotated_contracts(spark, str(tmp_path / "cuad")).first()) == (2, 1)
    assert tuple(files.annotated_contracts(spark, str(tmp_path / "none")).first()) == (None, None)


def test_pipeline_over_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("AGREEMENT\n\nSection 1 Parties\nThis is between Acme Holdings Corporation of X and Bob.\n\nSection 2: Payment\nThe fee of $5,000 is due January 15, 2024.")
    (tmp_path / "in" / "b.xyz").write_text("?")
    done = pipeline.process(spark, str(tmp_path / "in"))
    assert done.documents.count() == 1 and done.rejects.count() == 1
    texts = {r["text"]: r["type"] for r in done.entities.collect()}
    assert texts["$5,000"] == "Financial_Term" and texts["January 15, 2024"] == "Temporal_Entity"
    assert "Payment" in {r["section_title"] for r in done.chunks.collect()}
    n = done.entities.count()
    assert pipeline.store(done, str(tmp_path / "g")) == {"entities": n, "relationships": 0, "rejected_relationships": 0}
    assert pipeline.reprocess(done, str(tmp_path / "g"))["entities"] == n and spark.read.parquet(str(tmp_path / "g" / "nodes")).count() == n
    report = {r["measure"]: r["value"] for r in pipeline.populate(done).collect()}
    assert report["successful"] == 1 and report["failed"] == 1 and report["total_entities"] == n and report["issues_orphan_nodes"] == n
    whole = pipeline.structural_edges(done.documents, done.chunks, done.entities).groupBy("type").count()
    assert {r["type"] for r in whole.collect()} == {"CONTAINS", "MENTIONS", "HAS_PARTY"}
    assert pipeline.extraction_statistics(done.entities, done.edges).count() == 2
    assert "validation" in pipeline.population_statistics(done.entities.withColumn("label", F.lit("Entity")), done.edges)


def test_exports(spark, tmp_path):
    """What is written reads back: XML, JSON, triples, statements."""
    from xml.etree import ElementTree

    n = spark.createDataFrame([("a", 'x "q" <&\n\\ \'s', "Right", "Right", 0.5, "d1"), ("b", None, "Right", "Right", None, None)], vocab.NODES)
    e = spark.createDataFrame([("e1", "a", "b", "MODIFIES", 0.5, "<ev>" * 100, "d1")], vocab.EDGES)
    root = ElementTree.fromstring("".join(r["line"] for r in export.graphml(n, e).orderBy("part").collect()))
    ns = "{http://graphml.graphdrawing.org/xmlns}"
    assert [x.find(f"{ns}data[@key='n_text']").text for x in root.iter(f"{ns}node")] == ['x "q" <&\n\\ \'s', None]
    assert len(next(root.iter(f"{ns}edge")).find(f"{ns}data[@key='e_evidence']").text) == 200
    lines = [r["line"] for r in export.ntriples(n, e).collect()]
    assert '<http://example.org/graph/a> <http://www.w3.org/2000/01/rdf-schema#label> "x \\"q\\" <&\\n\\\\ \'s" .' in lines
    ttl = [r["line"] for r in export.turtle(n, e).collect()]
    assert sum(x.startswith("@prefix ") and x.endswith("> .") for x in ttl) == 4 and all(x.endswith(" .") for x in ttl)
    made = [r["line"] for r in export.cypher(n, e).collect()]
    assert made[1] == "CREATE (:Right {id: 'b', type: 'Right', label: 'Right'});" and "''s" in made[0]
    import json

    assert json.loads(export.json_lines(n, e).collect()[0]["line"])["text"] == 'x "q" <&\n\\ \'s'
    export.write_lines(export.graphml(n, e), str(tmp_path / "g"))
    assert spark.read.text(str(tmp_path / "g")).count() >= 4


def test_edge_rules(spark):
    none, s = None, "id string, source_id string, target_id string, type string, confidence double, evidence string, reasoning string, properties map<string,string>"
    rows = [("1", "a", "a", "MODIFIES", 0.9, none, none, none), ("2", "", "b", "MODIFIES", 0.9, none, none, none), ("3", "a", "b", "FINANCIALLY_RELATES", 0.9, none, none, {"x": "1"}), ("4", "a", "b", "FINANCIALLY_RELATES", 0.9, none, none, {"amount": "1"}), ("5", "a", "b", "TEMPORALLY_PRECEDES", 0.9, none, none, {"time_limit": "1", "trigger": "2"}), ("6", "a", "b", "DEFINES", 0.6, none, none, none), ("7", "a", "b", "DEFINES", 0.62, none, "r" * 101, none), ("8", "a", "b", "OBLIGATES", 0.6, "shall " + "x" * 600, none, none)]
    df = spark.createDataFrame(rows, s)
    assert sorted(r["id"] for r in rules.valid_edges(df).collect()) == ["4", "7", "8"]
    assert [r["first"] for r in rules.opposite_edges(spark.createDataFrame([("x", "a", "b", "CONTRADICTS"), ("y", "c", "d", "MODIFIES"), ("z", "d", "c", "MODIFIES")], "id string, source_id string, target_id string, type string")).collect()] == ["x", "y"]
    assert vocab.properties_of("Clause")[0] == "id" and vocab.properties_of("Nope") == [] and vocab.is_edge_type("CONTAINS") and not vocab.is_node_label("ClauseReference")


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([("c1", "d1", "Pay $5,000 to Acme Holdings Inc. x")], "id string, document_id string, text string").write.parquet(str(src))
    stream = spark.readStream.schema("id string, document_id string, text string").parquet(str(src))
    ingest.write_once(ingest.mentions_stream(stream), str(out), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(out)).where("type = 'Financial_Term'").count() == 1


def test_questions(spark):
    n = spark.createDataFrame([("a", "Acme", "Legal_Party", 0.9)], ENT)
    e = spark.createDataFrame([("e", "a", "a", "OBLIGATES", 0.9)], "id string, source_id string, target_id string, type string, confidence double")
    assert retrieve.ask(spark, n, e, "Who are the parties?").count() == 1
    assert retrieve.valid(n, e, "DROP TABLE x")[0] is False and retrieve.valid(n, e, "SELECT nope FROM nodes")[0] is False
    assert retrieve.query(n, e, "WITH x AS (SELECT id FROM nodes) SELECT * FROM x WHERE id = :i", {"i": "a"}).count() == 1
    model = lambda prompt: '{"sql": "SELECT id FROM nodes", "reasoning": "all"}'
    assert retrieve.translate("any", None, model) == ("SELECT id FROM nodes LIMIT 20", "all")
    assert retrieve.query_in("Sure:\n```sql\nSELECT id FROM nodes\n```") == "SELECT id FROM nodes LIMIT 20"
    assert retrieve.query_in("I can't") == "SELECT id, text, type FROM nodes ORDER BY id LIMIT 10"
    assert "Legal_Party" in retrieve.schema_context() and "Example 1" in retrieve.translation_prompt("q") and "doc_1" in retrieve.translation_prompt("q", "doc_1")
    assert "document_id = 'd'" in retrieve.translate("Who are the parties?", "d")[0]


def test_answers(spark):
    n = spark.createDataFrame([("a", "Acme payment", "Legal_Party", "LegalParty", 0.9, "d1"), ("b", "Fee", "Financial_Term", "FinancialTerm", 0.8, "d1")], vocab.NODES)
    e = spark.createDataFrame([("e", "a", "b", "OBLIGATES", 0.9, "pays", "d1")], vocab.EDGES)
    s = service.GraphService(n, e)
    got = s.answer("What are the payment terms?")
    assert got["confidence"] == 0.5 and "Acme payment" in got["answer"] and got["context_used"] == {"num_entities": 2, "num_relationships": 1}
    told = []
    s.generator = lambda q, c: told.append(c) or '{"answer": "5", "confidence": 0.7}'
    assert s.answer("What is the payment?")["answer"] == "5"
    assert told[0] == "## Entities\n\n1. **Acme payment** (LegalParty)\n   - Confidence: 0.9\n\n2. **Fee** (FinancialTerm)\n   - Confidence: 0.8\n\n## Relationships\n\n1. Acme payment --[OBLIGATES]--> Fee\n   - Confidence: 0.9\n   - Evidence: pays...\n"
    s.generator = lambda q, c: "no json"
    assert s.answer("payment")["confidence"] == 0.0
    assert retrieve.generated('{"confidence": 0.2}') == ("Unable to generate answer", 0.2)
    assert [r["question"] for r in retrieve.answer_all(n, e, s.questions()[:2])] == s.questions()[:2]

    def broken(q, c):
        raise OSError("down")

    assert retrieve.answer_all(n, e, ["x"], generate=broken)[0]["confidence"] == 0.0
    assert s.health()["status"] == "healthy" and s.statistics()["nodes"] == 2 and s.statistics("none")["edges"] == 0
    assert s.question("Who are the parties?")["count"] == 1 and s.path("a", "b").count() == 1
    assert s.entities("acme").count() == 1 and s.relationships(kind="OBLIGATES").count() == 1
    for bad in (lambda: s.query("DELETE FROM nodes"), lambda: s.entities(limit=101), lambda: s.path("a", "b", 6)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(LookupError):
        s.path("a", "zz")
    lines = [r["line"] for r in stats.summary_lines(n, e, checks.summary(n, e)).collect()]
    assert lines[0] == "GRAPH SUMMARY" and "  LegalParty: 1 nodes, average confidence 0.9" in lines and any("orphan_nodes: 0" in x for x in lines)


def test_models(spark):
    """Prompts, live calls with retries, thinking, providers."""
    seen = []

    def model(prompt, options):
        seen.append(prompt)
        if "fail" in prompt:
            raise OSError("down")
        return '<thinking>hm</thinking><response>{"entities": [{"text": "Acme Inc.", "type": "Legal_Party", "confidence": 0.9}]}</response>'

    c = spark.createDataFrame([("c1", "d1", "Acme Inc. pays {x}"), ("c2", "d1", "fail")], "id string, document_id string, text string")
    assert c.select(extract.prompt("T {chunk_text} {json: 1}", "text", ["ex"], "contract", {"contract": "C"})).first()[0] == "T Acme Inc. pays {x} {json: 1}\nC\nex"
    told = extract.responses(c, extract.prompt("{chunk_text}", "text"), model, attempts=2, wait=0.0).orderBy("id").collect()
    assert (told[0]["fault"], told[1]["response"], told[1]["fault"]) == (None, None, "OSError: down")
    entities, rejects = extract.batch_extract(c, lambda p, o: model(p, o) if "fail" not in p else "[]", "{chunk_text}", 1)
    assert [(r["text"], r["start"], r["end"]) for r in entities.collect()] == [("Acme Inc.", 0, 9)] and rejects.count() == 0
    t = spark.createDataFrame([("<thinking> a </thinking>x<response>\n{}\n</response>",), ("plain",)], "t string")
    assert [tuple(r) for r in t.select(extract.thinking_of("t"), extract.response_of("t")).collect()] == [("a", "{}"), ("", "plain")]
    extract.register("openai", model)
    assert extract.provider_of("gpt-4") == extract.provider_of() == "openai"
    for bad in (("claude-x", None), ("unknown", None), (None, "nobody")):
        with pytest.raises(ValueError):
            extract.provider_of(*bad)
    assert extract.client("gpt-4")("p", {}) and extract.called(model, "p", {})
    assert extract.template("/nonexistent") == "" and extract.examples(spark, "/nonexistent") == []
    assert extract.example_text([{"input": "a", "output": {"b": 1}}]) == 'Example 1\nInput: a\nOutput: {"b": 1}\n'


def test_relationships_from_entities(spark):
    docs = spark.createDataFrame([("d1", "x" * 600 + "Acme pays Bob" + "y" * 600)], "id string, content string")
    schema = "id string, text string, type string, confidence double, context string, document_id string, chunk_id string, start int, end int, ordinal long"
    e = spark.createDataFrame([("e1", "Acme", "Legal_Party", 0.9, None, "d1", "c1", 600, 604, 0), ("e2", "Bob", "Legal_Party", 0.9, None, "d1", "c1", 610, 613, 1), ("e3", "Lone", "Right", 0.9, "told", "d1", "c2", None, None, 2)], schema)
    w = {r["id"]: r["text"] for r in extract.chunk_windows(e, docs).collect()}
    assert w["c1"] == "x" * 500 + "Acme pays Bob" + "y" * 500 and w["c2"] == "told"
    reply = lambda p, o: '{"relationships": [{"source_entity_id": "e1", "target_entity_id": "e2", "relationship_type": "OBLIGATES", "confidence": 0.9, "evidence": "pays"}, {"source_entity_id": "e1", "target_entity_id": "zz", "relationship_type": "OBLIGATES"}]}'
    assert [(r["source_id"], r["target_id"], r["type"]) for r in extract.edges_from_entities(e, docs, reply, "{chunk_text} {entities_json}").collect()] == [("e1", "e2", "OBLIGATES")]
    by_text = spark.createDataFrame([("c1", "d1", '{"relationships": [{"source_entity_text": "acme", "target_entity_text": "Bob.", "relationship_type": "Odd", "confidence": 0.8}]}')], "id string, document_id string, response string")
    got = extract.replay_edges(by_text, e, aliases=resolve.party_aliases(e)).collect()
    assert [(r["source_id"], r["target_id"], r["type"]) for r in got] == [("e1", "e2", "REFERENCES")]
    assert extract.replay_edges(by_text, e).count() == 0
    assert retrieve.sanitise("```sql\nSELECT 1\n```") == "SELECT 1 LIMIT 20"
