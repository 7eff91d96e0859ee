"""Precision, recall, F1, averages, confusion, calibration, and the matchers behind them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from .resolve import ratio


def safe(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def with_metrics(counts: DataFrame, places: int | None = 4) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn, rounded unless places is None."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    p, r = safe(tp, tp + fp), safe(tp, tp + fn)
    cut = (lambda c: c) if places is None else (lambda c: F.round(c, places))
    return counts.withColumns({"precision": cut(p), "recall": cut(r), "f1": cut(safe(2 * p * r, p + r))})


def exact_counts(pred: DataFrame, gold: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
    """tp, fp, fn of many-to-one exact matching: of gold rows with the same key one is matched, the others are missed."""
    by_cols = [by] if by else []
    p = pred.groupBy(*keys).agg(F.count("*").alias("p"))
    g = gold.groupBy(*keys).agg(F.count("*").alias("g"))
    both = p.join(g, keys, "full").select(*keys, F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("g", F.lit(0)).alias("g"))
    hit = (F.col("p") > 0) & (F.col("g") > 0)
    sums = [F.sum(F.when(hit, F.col("p")).otherwise(0)), F.sum(F.when(hit, 0).otherwise(F.col("p"))), F.sum(F.col("g") - F.when(hit, 1).otherwise(0))]
    tp, fp, fn = (F.coalesce(s, F.lit(0)).cast("long").alias(n) for s, n in zip(sums, ("tp", "fp", "fn"), strict=True))
    return (both.groupBy(*by_cols) if by else both).agg(tp, fp, fn)


def matching_key(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def first_of(gold: DataFrame, keys: list[Column]) -> DataFrame:
    """For each key the gold row that comes first: keys, gold_id, go."""
    return gold.groupBy(*keys).agg(F.min(F.struct(F.col("ordinal").alias("go"), F.col("id").alias("gold_id"))).alias("f")).select("*", "f.go", "f.gold_id").drop("f")


def best_of(pairs: DataFrame) -> DataFrame:
    """(pred_id, gold_id, score): of each prediction's pairs the best score, the first gold on ties."""
    best = Window.partitionBy("pred_id").orderBy(F.desc("score"), "go")
    return pairs.withColumn("r", F.row_number().over(best)).where("r = 1").select("pred_id", "gold_id", F.round("score", 4).alias("score"))


def exact_pairs(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(pred_id, gold_id, score): predictions with the first gold row of the same text (case and ends aside) and type."""
    keys = lambda: [matching_key("text").alias("k"), F.col("type").alias("t")]
    return pred.select(F.col("id").alias("pred_id"), *keys()).join(first_of(gold, keys()), ["k", "t"]).select("pred_id", "gold_id", F.lit(1.0).alias("score"))


def best_overlaps(pred: DataFrame, gold: DataFrame, least: float = 0.5) -> DataFrame:
    """(pred_id, gold_id, score): each prediction's best span by intersection over union; first gold on ties.

    Where one of two has no place, equal texts count 1 whatever their types.
    """
    width = 64  # spans meet in a bucket that both touch
    buckets = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    placed = "start is not null and end is not null"
    p = pred.where(f"{placed} and end > start").select(F.col("id").alias("pred_id"), F.col("start").alias("ps"), F.col("end").alias("pe"))
    g = gold.where(f"{placed} and end > start").select(F.col("id").alias("gold_id"), F.col("start").alias("gs"), F.col("end").alias("ge"), F.col("ordinal").alias("go"))
    pairs = p.withColumn("b", buckets("ps", "pe")).join(g.withColumn("b", buckets("gs", "ge")), "b").where("ps < ge and gs < pe").dropDuplicates(["pred_id", "gold_id"])
    score = (F.least("pe", "ge") - F.greatest("ps", "gs")) / (F.greatest("pe", "ge") - F.least("ps", "gs"))
    scored = pairs.select("pred_id", "gold_id", "go", score.alias("score")).where(F.col("score") >= least)
    if "text" in pred.columns and "text" in gold.columns:
        k = F.lower("text").alias("k")
        same = lambda p, g: p.select(F.col("id").alias("pred_id"), k).join(first_of(g, [k]), "k").select("pred_id", "gold_id", "go", F.lit(1.0).alias("score"))
        scored = scored.unionByName(same(pred.where(f"not ({placed})"), gold)).unionByName(same(pred.where(placed), gold.where(f"not ({placed})")))
    return best_of(scored)


def numbered_bigrams(c: Column) -> Column:
    """Pairs of neighbouring characters, each with the number of its occurrence."""
    n = F.char_length(c)
    grams = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.transform(grams, lambda x, k: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(grams, F.lit(1), k + 1), lambda y: y == x)).cast("string")))


def similar_texts(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(block, a, b, score) of the distinct texts (block, text) of both sides whose Ratcliff-Obershelp ratio is least or more.

    If two texts of n and m characters match in M of them, what doesn't match parts the match into at most n + m - 2M + 1
    runs, so they share 3M - n - m - 1 bigrams at least. Pairs for which that is a bigram or more meet under one of each
    one's rarest bigrams; the others are so short that they meet by length. All are then scored exactly.
    """
    a, b = (df.select("block", F.col("text").alias("t")).where("t is not null").distinct() for df in (left, right))
    shared = (1.5 * least - 1) * 2 / (2 - least)  # of a text's length, less one: bigrams shared with any partner
    short_to = max(0, int(2 / shared)) if shared > 0 else 1 << 30  # up to this length none is sure
    lowest, highest = least / (2 - least), (2 - least) / least

    def prefixes(df: DataFrame, often: DataFrame, name: str) -> DataFrame:
        rows = df.where(F.char_length("t") > short_to).withColumn("gram", F.explode(numbered_bigrams(F.col("t")))).join(often, "gram")
        order = Window.partitionBy("block", "t").orderBy("n", "gram")
        n = F.char_length("t")
        keep = n - 1 - F.ceil(shared * n - 1) + 1
        return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).select("block", "gram", F.col("t").alias(name))

    both = a.unionAll(b)
    often = both.where(F.char_length("t") > short_to).select(F.explode(numbered_bigrams(F.col("t"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    met = prefixes(a, often, "a").join(prefixes(b, often, "b"), ["block", "gram"]).select("block", "a", "b")
    sized = lambda df, name: df.where(F.char_length("t") <= F.ceil(F.lit(short_to) * highest)).select("block", F.col("t").alias(name), F.char_length("t").alias(f"n{name}"))
    wide = sized(a, "a").withColumn("nb", F.explode(F.sequence(F.ceil(F.col("na") * lowest), F.floor(F.col("na") * highest)).cast("array<int>")))
    short = wide.join(sized(b, "b"), ["block", "nb"]).where((F.col("na") <= short_to) | (F.col("nb") <= short_to)).select("block", "a", "b")
    na, nb = F.char_length("a"), F.char_length("b")
    pairs = met.unionAll(short).distinct().where((nb >= F.ceil(na * lowest - 1e-9)) & (nb <= F.floor(na * highest + 1e-9)))
    return pairs.withColumn("score", ratio("a", "b")).where(F.col("score") >= least)


def best_fuzzy(pred: DataFrame, gold: DataFrame, least: float = 0.8) -> DataFrame:
    """As best_overlaps, by Ratcliff-Obershelp similarity of texts of one type. Equal texts need no comparison: none is closer."""
    p = pred.select(F.col("id").alias("pred_id"), F.lower("text").alias("a"), F.col("type").alias("block"))
    g = first_of(gold, [F.lower("text").alias("b"), F.col("type").alias("block")])
    equal = p.join(g.withColumnRenamed("b", "a"), ["block", "a"]).select("pred_id", "gold_id", F.lit(1.0).alias("score"))
    rest = p.join(equal.select("pred_id"), "pred_id", "left_anti")
    close = similar_texts(rest.select("block", F.col("a").alias("text")), g.select("block", F.col("b").alias("text")), least)
    return equal.unionByName(best_of(rest.join(close, ["block", "a"]).join(g, ["block", "b"])))


def match_entities(pred: DataFrame, gold: DataFrame, strategy: str = "exact") -> DataFrame:
    """(pred_id, gold_id, score) of the matched predictions; several may match one gold row."""
    return {"exact": exact_pairs, "overlap": best_overlaps, "fuzzy": best_fuzzy}[strategy](pred, gold)


def match_edges(pred: DataFrame, gold: DataFrame, strategy: str = "exact") -> DataFrame:
    """(pred_id, gold_id, score): the first gold edge of the same ends and type, by either strategy."""
    if strategy not in ("exact", "fuzzy"):
        raise ValueError(strategy)
    keys = ["source_id", "target_id", "type"]
    return pred.select(F.col("id").alias("pred_id"), *keys).join(first_of(gold, [F.col(k) for k in keys]), keys).select("pred_id", "gold_id", F.lit(1.0).alias("score"))


def matched_rows(pred: DataFrame, gold: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched, false positives, false negatives). matched: pred_id, predicted, truth, confidence."""
    p = pred.select(F.col("id").alias("pred_id"), F.col("type").alias("predicted"), "confidence")
    g = gold.select(F.col("id").alias("gold_id"), F.col("type").alias("truth"))
    matched = pairs.select("pred_id", "gold_id").join(p, "pred_id").join(g, "gold_id").select("pred_id", "predicted", "truth", "confidence")
    wrong = pred.join(pairs.select(F.col("pred_id").alias("id")), "id", "left_anti")
    missed = gold.join(pairs.select(F.col("gold_id").alias("id")), "id", "left_anti")
    return matched, wrong, missed


def counts_by_type(matched: DataFrame, wrong: DataFrame, missed: DataFrame) -> DataFrame:
    """(type, tp, fp, fn): matches by the gold row's type, the others by their own."""
    one = lambda df, c, n: df.select(F.col(c).alias("type"), *(F.lit(int(k == n)).alias(k) for k in ("tp", "fp", "fn")))
    rows = one(matched, "truth", "tp").unionAll(one(wrong, "type", "fp")).unionAll(one(missed, "type", "fn"))
    return rows.groupBy("type").agg(*(F.sum(k).alias(k) for k in ("tp", "fp", "fn")))


def overall(by_type: DataFrame) -> DataFrame:
    """One row of tp, fp, fn, support and metrics."""
    total = by_type.agg(*(F.coalesce(F.sum(k), F.lit(0)).cast("long").alias(k) for k in ("tp", "fp", "fn")))
    return with_metrics(total).withColumn("support", F.col("tp") + F.col("fn"))


def error_counts(wrong: DataFrame, missed: DataFrame, column: str = "type") -> DataFrame:
    """(error, type, n): what was found wrongly and what was missed, by type."""
    one = lambda df, name: df.groupBy(F.lit(name).alias("error"), F.col(column).alias("type")).agg(F.count("*").alias("n"))
    return one(wrong, "false_positive").unionAll(one(missed, "false_negative"))


def error_examples(wrong: DataFrame, missed: DataFrame, shown: list[str], order: list[str], most: int = 10) -> DataFrame:
    """(error, rank, ...shown): the first errors of each kind; a long evidence is cut at 100 characters."""

    def one(df: DataFrame, name: str) -> DataFrame:
        have = [c if c in df.columns else None for c in shown]
        cols = [(F.substring(c, 1, 100) if c == "evidence" else F.col(c)).alias(k) if c else F.lit(None).alias(k) for c, k in zip(have, shown, strict=True)]
        top = df.orderBy(*order).limit(most)
        return top.select(F.lit(name).alias("error"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"), *cols)

    return one(wrong, "false_positive").unionByName(one(missed, "false_negative"))


def class_metrics(pairs: DataFrame) -> DataFrame:
    """(type, tp, fp, fn, support, metrics) of each class of (truth, predicted): diagonal, rest of column, rest of row."""
    same = F.col("truth") == F.col("predicted")
    one = lambda c, tp, fp, fn: pairs.select(F.col(c).alias("type"), tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), fn.cast("long").alias("fn"))
    zero = F.lit(0)
    sums = one("truth", same, zero, ~same).unionAll(one("predicted", zero, ~same, zero)).groupBy("type").agg(*(F.sum(k).alias(k) for k in ("tp", "fp", "fn")))
    return with_metrics(sums).withColumn("support", F.col("tp") + F.col("fn"))


def evaluated(pred: DataFrame, gold: DataFrame, pairs: DataFrame, classes: list[str], shown: list[str]) -> dict[str, DataFrame]:
    matched, wrong, missed = matched_rows(pred, gold, pairs)
    by_type = counts_by_type(matched, wrong, missed)
    return {
        "counts": pred.agg(F.count("*").alias("predicted_count")).join(gold.agg(F.count("*").alias("ground_truth_count"))),
        "overall": overall(by_type),
        "by_type": with_metrics(by_type).withColumn("support", F.col("tp") + F.col("fn")),
        "averages": averages(by_type),
        "confusion": confusion(matched, classes),
        "calibration": calibration(matched.select("confidence", (F.col("predicted") == F.col("truth")).alias("correct"))),
        "errors": error_counts(wrong, missed),
        "examples": error_examples(wrong, missed, shown, ["ordinal", "id"]),
    }


def evaluate_entities(pred: DataFrame, gold: DataFrame, strategy: str = "exact") -> dict[str, DataFrame]:
    """All results of an entity evaluation by name. pred and gold: id, text, type, confidence, start, end, ordinal."""
    return evaluated(pred, gold, match_entities(pred, gold, strategy), vocab.ENTITY_TYPES, ["text", "type", "confidence"])


def evaluate_edges(pred: DataFrame, gold: DataFrame, strategy: str = "exact") -> dict[str, DataFrame]:
    """All results of a relationship evaluation. pred and gold: id, source_id, target_id, type, confidence, evidence, ordinal."""
    return evaluated(pred, gold, match_edges(pred, gold, strategy), vocab.RELATIONSHIP_TYPES, ["source_id", "target_id", "type", "confidence", "evidence"])


TRIPLE = ["source_text", "source_type", "type", "target_text", "target_type"]


def match_triples(pred: DataFrame, gold: DataFrame, strategy: str = "exact") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched gold, unmatched predicted, unmatched gold) triples. relaxed: types equal and both texts close; a
    prediction matches the first such gold triple in the order of its texts."""
    if strategy != "relaxed":
        return pred.intersect(gold), pred.subtract(gold), gold.subtract(pred)
    kinds = ["source_type", "type", "target_type"]
    blocked = lambda df, c: df.select(F.concat_ws("\u0001", *kinds).alias("block"), F.col(c).alias("text"))
    close = {c: similar_texts(blocked(pred, c), blocked(gold, c), 0.8) for c in ("source_text", "target_text")}
    of = lambda c: close[c].select("block", F.col("a").alias(c), F.col("b").alias(f"gold_{c}"))
    g = gold.select(F.concat_ws("\u0001", *kinds).alias("block"), F.col("source_text").alias("gold_source_text"), F.col("target_text").alias("gold_target_text"))
    p = pred.withColumn("block", F.concat_ws("\u0001", *kinds))
    hits = p.join(of("source_text"), ["block", "source_text"]).join(of("target_text"), ["block", "target_text"]).join(g, ["block", "gold_source_text", "gold_target_text"], "left_semi")
    first = hits.groupBy(*TRIPLE).agg(F.min(F.struct("gold_source_text", "gold_target_text")).alias("g"))
    matched = first.select(F.col("g.gold_source_text").alias("source_text"), "source_type", "type", F.col("g.gold_target_text").alias("target_text"), "target_type").distinct()
    return matched, pred.join(first, TRIPLE, "left_anti"), gold.join(matched, TRIPLE, "left_anti")


def evaluate_graph(pred_entities: DataFrame, pred_edges: DataFrame, gold_entities: DataFrame, gold_edges: DataFrame, strategy: str = "exact") -> dict[str, DataFrame]:
    """All results of a graph evaluation over distinct triples. overall is exact by either strategy; overall_relaxed isn't."""
    pred, gold = triples(pred_edges, pred_entities), triples(gold_edges, gold_entities)
    matched, wrong, missed = match_triples(pred, gold, strategy)
    by_type = exact_counts(pred, gold, TRIPLE, "type")
    shown = F.concat(F.lit("("), "source_text", F.lit(":"), "source_type", F.lit(") -["), "type", F.lit("]-> ("), "target_text", F.lit(":"), "target_type", F.lit(")"))
    one = lambda df, n: df.agg(F.count("*").alias(n))
    relaxed = one(pred, "p").join(one(wrong, "fp")).join(one(missed, "fn")).select((F.col("p") - F.col("fp")).alias("tp"), "fp", "fn")
    return {
        "counts": one(pred, "predicted_count").join(one(gold, "ground_truth_count")),
        "overall": overall(by_type),
        "overall_relaxed": with_metrics(relaxed),
        "by_type": with_metrics(by_type).withColumn("support", F.col("tp") + F.col("fn")),
        "averages": averages(by_type),
        "errors": error_counts(wrong, missed),
        "examples": error_examples(wrong.withColumn("triple", shown), missed.withColumn("triple", shown), ["triple"], TRIPLE),
        "components": component_analysis(pred, gold, matched),
    }


def results_json(results: dict[str, DataFrame]) -> DataFrame:
    """(line): a JSON object for each row of each result, with the result's name. Written as text by the executors."""
    lines = [df.select(F.to_json(F.struct(F.lit(name).alias("result"), F.struct(*df.columns).alias("row"))).alias("line")) for name, df in results.items()]
    return reduce(DataFrame.unionAll, lines)


def write_results(results: dict[str, DataFrame], path: str) -> None:
    results_json(results).write.mode("overwrite").text(path)


def triples(edges: DataFrame, entities: DataFrame) -> DataFrame:
    end = lambda s: entities.select(F.col("id").alias(f"{s}_id"), F.lower(F.trim("text")).alias(f"{s}_text"), F.col("type").alias(f"{s}_type"))
    return edges.select("source_id", "target_id", "type").join(end("source"), "source_id").join(end("target"), "target_id").select("source_text", "source_type", "type", "target_text", "target_type").distinct()


def component_analysis(pred: DataFrame, gold: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """One row that counts what is wrong with unmatched predicted triples: relationship, source or target, in this order.

    A gold triple differs in the named part alone as far as texts and relationships go; correct_entities_wrong_relationship
    is never counted.
    """
    left = pred.join(gold.intersect(pred) if matched is None else matched, TRIPLE, "left_anti")
    hits = []
    for part, same in (("type", ["source_text", "target_text"]), ("source_text", ["type", "target_text"]), ("target_text", ["type", "source_text"])):
        ends = gold.groupBy(*same).agg(F.min(part).alias(f"low_{part}"), F.max(part).alias(f"high_{part}"))  # another value is there if one of these is
        left = left.join(ends, same, "left")
        hits.append(F.coalesce((F.col(f"low_{part}") != F.col(part)) | (F.col(f"high_{part}") != F.col(part)), F.lit(False)))
    count = lambda c, name: F.count_if(c).alias(name)
    return left.agg(
        F.lit(0).cast("long").alias("correct_entities_wrong_relationship"),
        count(~hits[0] & hits[1], "correct_relationship_wrong_source"),
        count(~hits[0] & ~hits[1] & hits[2], "correct_relationship_wrong_target"),
        count(hits[0], "correct_source_target_wrong_relationship"),
    )


def averages(by_type: DataFrame) -> DataFrame:
    """Macro and micro averages of rows with tp, fp, fn and metrics."""
    macro = with_metrics(by_type.select("tp", "fp", "fn"), None).agg(*(F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).select(F.lit("macro").alias("average"), "tp", "fp", "fn", "precision", "recall", "f1")
    micro = with_metrics(by_type.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))).select(F.lit("micro").alias("average"), "tp", "fp", "fn", "precision", "recall", "f1")
    return macro.unionByName(micro)


def confusion(pairs: DataFrame, classes: list) -> DataFrame:
    """Dense counts: truth by predicted class."""
    return pairs.groupBy("truth").pivot("predicted", classes).count().na.fill(0)


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """ECE and MCE over bins; a bin's confidence is its centre."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    per = scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    per = per.withColumn("error", F.abs(F.col("accuracy") - (F.col("bin") + 0.5) / bins))
    total = per.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("error")).alias("weighted"), F.max("error").alias("mce"))
    return total.select(F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce(F.col("weighted") / F.col("n"), F.lit(0.0)), 4).alias("ece"), F.round(F.coalesce("mce", F.lit(0.0)), 4).alias("mce"))
