"""Hierarchical chunks of documents: the whole text, its sections, and their clauses within a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADER = r"\n\n+|(?:Section|Article|Clause)\s+\d+"


def clauses(text: str, size: int = 500, overlap: int = 100) -> list[str]:
    """Greedy chunks of lines within a budget of characters / 4; long lines by words; the next chunk starts with the tail."""
    count = lambda s: len(s) // 4
    out: list[str] = []
    now: list[str] = []
    used = 0
    for line in text.split("\n"):
        n = count(line)
        if n > size:
            if now:
                out.append("\n".join(now))
                now, used = [], 0
            words: list[str] = []
            for w in line.split():
                if words and count(" ".join([*words, w])) > size:
                    out.append(" ".join(words))
                    words = []
                words.append(w)
            if words:
                out.append(" ".join(words))
        elif used + n <= size:
            now.append(line)
            used += n
        else:
            out.append("\n".join(now))
            tail: list[str] = []
            kept = 0
            for s in reversed(now):
                if kept + count(s) > overlap:
                    break
                tail.insert(0, s)
                kept += count(s)
            now, used = [*tail, line], kept + n
    if now:
        out.append("\n".join(now))
    return out


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, text): non-blank parts between headers and blank lines, numbered from 0."""
    trimmed = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(text, HEADER, -1), trimmed), lambda s: s != "")
    return docs.select(key, F.posexplode(parts).alias("section", "text"))


def chunk_table(docs: DataFrame, size: int = 500, overlap: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, level, chunk_index, parent, text, start, end, token_count) of all three levels; each document stands alone."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: clauses(t or "", size, overlap))

    parts = sections(docs, key, text)
    whole = docs.select(key, F.lit(0).alias("level"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.col(text).alias("text"))
    one = parts.select(key, F.lit(1).alias("level"), F.col("section").alias("a"), F.lit(0).alias("b"), "text")
    two = parts.select(key, F.lit(2).alias("level"), F.col("section").alias("a"), F.posexplode(cut("text")).alias("b", "text"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("level", "a", "b")) - 1
    parent = F.when(F.col("level") == 1, 0).when(F.col("level") == 2, F.col("a") + 1)
    rows = whole.unionByName(one).unionByName(two).withColumns({"chunk_index": n, "parent": parent})
    source = docs.select(key, F.col(text).alias("_content"))
    start = F.expr("locate(substring(text, 1, 50), _content) - 1")
    placed = rows.join(source, key).withColumn("start", start)
    end = F.when(F.col("start") < 0, 0).otherwise(F.col("start") + F.char_length("text"))
    return placed.select(key, "level", "chunk_index", "parent", "text", "start", end.alias("end"), F.floor(F.char_length("text") / 4).alias("token_count"))


def merge_fragments(chunks: DataFrame, least: int = 100, key: str = "doc_id", order: str = "chunk_index") -> DataFrame:
    """Runs of chunks under so many tokens become one, joined by blanks."""
    w = Window.partitionBy(key).orderBy(order)
    big = (F.floor(F.char_length("text") / 4) >= least).cast("int")
    run = F.sum(big + F.coalesce(F.lag(big).over(w), F.lit(0))).over(w)
    grouped = chunks.withColumn("_run", run).groupBy(key, "_run").agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("parts"))
    return grouped.select(key, F.col("parts")[0][order].alias(order), F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))
