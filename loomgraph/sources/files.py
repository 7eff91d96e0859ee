"""File sources: text with an encoding fallback, DOCX and PDF by the standard library, others by given parsers; few-shot JSON;
annotated contracts."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{WORD}t")).strip() for p in root.iter(f"{WORD}p"))
    return "\n\n".join(p for p in paragraphs if p)


def docx_metadata(content: bytes) -> dict[str, str]:
    """Author, title, dates and the number of paragraphs, from the core properties."""
    z = zipfile.ZipFile(io.BytesIO(content))
    out = {}
    if "docProps/core.xml" in z.namelist():
        names = {"creator": "author", "title": "title", "created": "created", "modified": "modified"}
        for e in ElementTree.fromstring(z.read("docProps/core.xml")):
            tag = e.tag.rpartition("}")[2]
            if tag in names and e.text:
                out[names[tag]] = e.text
    root = ElementTree.fromstring(z.read("word/document.xml"))
    return out | {"paragraph_count": str(sum(1 for _ in root.iter(f"{WORD}p")))}


# ---- PDF: text-based files with simple fonts, by the standard library ------------------------------------------------

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s\[\]()<>/]+|[-+.\d]+|[A-Za-z'\"*]+")
ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_objects(content: bytes) -> dict[int, bytes]:
    """Objects by number, also those packed in object streams."""
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    if b"/Encrypt" in content:
        raise ValueError("encrypted")
    out = {int(m[1]): m[2] for m in OBJECT.finditer(content)}
    for body in list(out.values()):
        if b"/ObjStm" in body:
            data, n, first = pdf_stream(body), int(re.search(rb"/N\s+(\d+)", body)[1]), int(re.search(rb"/First\s+(\d+)", body)[1])
            head = [int(x) for x in data[:first].split()][: 2 * n]
            places = [*head[1::2], len(data) - first]
            out |= {num: data[first + places[k] : first + places[k + 1]] for k, num in enumerate(head[::2])}
    return out


def pdf_stream(body: bytes) -> bytes:
    found = STREAM.search(body)
    if not found:
        return b""
    return zlib.decompressobj().decompress(found[1]) if b"/FlateDecode" in body else found[1]


def pdf_string(token: bytes) -> str:
    if token[:1] == b"<":
        raw = bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode().ljust(2, "0"))
        return raw.decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")
    raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: ESCAPED.get(m[1], m[1]) if not m[1].isdigit() else bytes([int(m[1], 8) & 255]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def pdf_page_text(data: bytes) -> str:
    """What the text operators show: a new line where the position moves down or a line ends."""
    out, stack = [], []
    for token in TOKEN.findall(data):
        if token[:1] in b"(<[]/" or re.fullmatch(rb"[-+.\d]+", token):
            stack.append(token)
            continue
        strings = [x for x in stack if x[:1] in b"(<"]
        if token in (b"Tj", b"TJ"):
            for x in stack:
                if x[:1] in b"(<":
                    out.append(pdf_string(x))
                elif token == b"TJ" and re.fullmatch(rb"-\d+(\.\d+)?", x) and float(x) < -200:
                    out.append(" ")  # a gap as wide as a blank
        elif token in (b"'", b'"'):
            out += ["\n", *map(pdf_string, strings[-1:])]
        elif token in (b"Td", b"TD") and len(stack) >= 2:
            out.append("\n" if float(stack[-1]) else " ")
        elif token in (b"T*", b"ET"):
            out.append("\n")
        stack = []
    return "\n".join(x.strip() for x in "".join(out).split("\n") if x.strip())


def pdf_pages(content: bytes) -> list[str]:
    objects = pdf_objects(content)
    pages = [body for _, body in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", body)]
    texts = []
    for body in pages:
        refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        numbers = [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", refs[1])] if refs else []
        texts.append(pdf_page_text(b"\n".join(pdf_stream(objects.get(n, b"")) for n in numbers)))
    return texts


def pdf_text(content: bytes) -> str:
    """The pages' texts, those that have any, a blank line between them."""
    return "\n\n".join(t for t in pdf_pages(content) if t)


def pdf_metadata(content: bytes) -> dict[str, str]:
    objects = pdf_objects(content)
    out = {"page_count": str(len(pdf_pages(content)))}
    info = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", content)
    body = objects.get(int(info[1]), b"") if info else b""
    return out | {k.decode().lower(): pdf_string(v) for k, v in re.findall(rb"/(Title|Author|Subject|Creator|Producer|CreationDate|ModDate)\s*(\((?:\\.|[^\\()])*\))", body)}


def plain_text(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


#: Parsers by extension, and what else is told of such files; others can be given to read_documents.
PARSERS: dict[str, Callable[[bytes], str]] = {"txt": plain_text, "docx": docx_text, "doc": docx_text, "pdf": pdf_text}
METADATA: dict[str, Callable[[bytes], dict[str, str]]] = {"docx": docx_metadata, "doc": docx_metadata, "pdf": pdf_metadata}


def read_documents(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): cleaned texts with ids and types; files that no parser can read are rejects with a reason."""
    known = dict(PARSERS if parsers is None else parsers)

    def told(kind: str, content: bytes) -> dict[str, str]:
        try:
            return METADATA.get(kind, lambda _: {})(content)
        except Exception:  # a file whose properties can't be read is still a document
            return {}

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, faults, more = [], [], []
            for path, content in zip(b["path"], b["content"], strict=True):
                kind = (re.search(r"\.([^./]+)$", path) or ["", ""])[1].lower()
                try:
                    texts.append(known[kind](bytes(content)))
                    faults.append(None)
                    more.append(told(kind, bytes(content)))
                    continue
                except KeyError:
                    texts.append(None)
                    faults.append(f"no parser for .{kind}")
                except Exception as e:  # a file that can't be read is a reject, not a failed job
                    texts.append(None)
                    faults.append(f"{type(e).__name__}: {e}")
                more.append({})
            yield pd.DataFrame({"path": b["path"], "length": b["length"], "raw": texts, "fault": faults, "more": more})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", "length", "content").mapInPandas(parse, "path string, length long, raw string, fault string, more map<string,string>")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    good = rows.where("fault is null").withColumn("content", T.clean("raw"))
    docs = good.select(T.document_id(stem, "content").alias("id"), stem.alias("title"), "content", T.document_type("content").alias("document_type"), F.col("path").alias("file_path"), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("file_format"), F.map_concat(F.create_map(F.lit("file_name"), name, F.lit("file_path"), F.col("path"), F.lit("file_size"), F.col("length").cast("string")), F.coalesce("more", F.create_map().cast("map<string,string>"))).alias("metadata"))
    return docs, rows.where("fault is not null").select("path", "fault")


def few_shot_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path).select(F.explode("examples").alias("example")).select("example.*")


def annotated_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """(annotations, contracts): how many documents the annotation file CUAD_v1.json of a folder has in its data, and how many
    texts lie in full_contract_txt; null where one of them isn't there."""
    try:
        data = spark.read.option("multiLine", "true").json(f"{folder}/CUAD_v1.json").select(F.sum(F.size("data")).cast("long").alias("annotations"))
        data.schema  # noqa: B018
    except AnalysisException:
        data = spark.range(1).select(F.lit(None).cast("long").alias("annotations"))
    try:
        texts = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{folder}/full_contract_txt").agg(F.count("*").alias("contracts"))
    except AnalysisException:
        texts = spark.range(1).select(F.lit(None).cast("long").alias("contracts"))
    return data.join(texts)
