"""Reading files: text, images and PDFs as binaries for a parser plug-in, hashes, page ranges, stored documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

MAX_PDF_BYTES, MAX_PDF_PAGES = 500 << 20, 5_000
TEXT_TYPES, IMAGE_TYPES = ("txt", "md", "text"), ("jpg", "jpeg", "png", "gif", "webp")


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Each text file that isn't blank as its page 1."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).withColumn("path", F.input_file_name())
    raw = raw.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*TEXT_TYPES))
    return raw.filter(F.col("value").rlike(r"(?U)\S")).select("path", F.lit(1).alias("page_number"), F.col("value").alias("content"), F.length("value").alias("char_count"))


def files(spark: SparkSession, path: str, types: Iterable[str] | None = None) -> DataFrame:
    """Path, length, content and sha256 of each file."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    d = d.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*types)) if types else d
    return d.select("path", "length", "content", F.sha2("content", 256).alias("file_hash"))


def parsed_pages(binaries: DataFrame, parse: Callable[[bytes], list[str]], most_bytes: int = MAX_PDF_BYTES, most_pages: int = MAX_PDF_PAGES) -> DataFrame:
    """Pages of binaries by a parser plug-in, numbered from 1, blank ones left out. What fails, or is too large,
    gives one row with an error instead of ending the job."""

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    if len(content) > most_bytes:
                        raise ValueError(f"larger than {most_bytes} bytes")
                    pages = parse(bytes(content))
                    if len(pages) > most_pages:
                        raise ValueError(f"more than {most_pages} pages")
                    rows += [(path, k + 1, p.strip(), None) for k, p in enumerate(pages) if p.strip()]
                except Exception as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["path", "page_number", "content", "error"])
            out["page_number"] = out["page_number"].astype("Int32")
            yield out

    return binaries.select("path", "content").mapInPandas(run, "path string, page_number int, content string, error string")


def page_images(binaries: DataFrame, split: Callable[[bytes], Iterable[tuple[bytes, str, bool]]], pages: Iterable[int] | None = None, most_bytes: int = MAX_PDF_BYTES, most_pages: int = MAX_PDF_PAGES) -> DataFrame:
    """Pages as images, by a splitter plug-in that gives each page's image, text and whether it holds pictures; only the
    given pages, if any. (path, page_number, image, raw_text, has_images, error, raw_text_char_count, page_hash.)
    What fails, or is too large, gives one row with an error. One page at a time goes out, so a file's images are
    never all in memory."""
    wanted = set(pages) if pages is not None else None
    names = ["path", "page_number", "image", "raw_text", "has_images", "error"]

    def frame(*row) -> pd.DataFrame:
        out = pd.DataFrame([row], columns=names)
        return out.astype({"page_number": "Int32", "has_images": "boolean"})

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                try:
                    if len(content) > most_bytes:
                        raise ValueError(f"larger than {most_bytes} bytes")
                    for k, (image, text, pictures) in enumerate(split(bytes(content)), 1):
                        if k > most_pages:
                            raise ValueError(f"more than {most_pages} pages")
                        if wanted is None or k in wanted:
                            yield frame(path, k, bytes(image), text or "", bool(pictures), None)
                except Exception as e:
                    yield frame(path, None, None, None, None, f"{type(e).__name__}: {e}")

    d = binaries.select("path", "content").mapInPandas(run, "path string, page_number int, image binary, raw_text string, has_images boolean, error string")
    return d.withColumns({"raw_text_char_count": F.length(strip(F.col("raw_text"))), "page_hash": F.substring(F.sha2("image", 256), 1, 32)})


def page_range(text: str) -> list[int]:
    """"1-3,8" as page numbers; blank parts are skipped, anything else that isn't a range raises."""
    out: set[int] = set()
    for part in filter(None, map(str.strip, text.split(","))):
        first, dash, last = part.partition("-")
        a = int(first)
        b = int(last) if dash else a
        if a < 1 or b < a:
            raise ValueError(f"not a page range: {part!r}")
        out.update(range(a, b + 1))
    if not out:
        raise ValueError("no pages given")
    return sorted(out)


def stored_documents(spark: SparkSession, base: str) -> DataFrame:
    """Documents kept as base/knowledge/type/id.md with a front matter of "key: value" lines between ---."""
    raw = spark.read.option("recursiveFileLookup", "true").text(base, wholetext=True).withColumn("path", F.input_file_name())
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n\n?", "")
    parts = F.split("path", "/")
    known = lambda c, none: F.nullif(F.element_at(parts, c), F.lit(none))
    return raw.filter(F.col("path").endswith(".md")).select(
        F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("source_id"),
        known(-3, "_default").alias("knowledge_id"),
        known(-2, "_untyped").alias("source_type"),
        F.trim(F.regexp_replace(F.regexp_extract(head, r"(?m)^title:\s*(.*)$", 1), r'^"|"$', "")).alias("title"),
        body.alias("content"),
    )
