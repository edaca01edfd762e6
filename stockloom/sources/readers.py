"""Sources: stores of JSON tables, blobs with digests, word layouts from recognition output, word documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_SCHEMA = "page int, text string, x double, y double, width double, height double, confidence double"


def read_json_store(spark: SparkSession, path: str, schemas: dict[str, T.StructType]) -> dict[str, DataFrame]:
    """One JSON object that holds every table as an array: a frame for each table, in its order."""
    whole = T.StructType([T.StructField(n, T.ArrayType(s)) for n, s in schemas.items()])
    store = spark.read.schema(whole).json(path, multiLine=True)
    return {n: store.select(F.explode(n).alias("r")).select("r.*") for n in schemas}


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size, sha256 of every file; contents stay in the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def file_kind(name: str | Column, mime: str | Column) -> Column:
    n, m = (F.lower(F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))) for x in (name, mime))
    return (
        F.when(n.endswith(".pdf") | (m == "application/pdf"), "pdf")
        .when(n.rlike(r"\.(png|jpe?g|webp|tiff?|bmp)$") | m.startswith("image/"), "image")
        .when(n.endswith(".docx") | m.contains("wordprocessingml"), "docx")
        .otherwise("unsupported")
    )


def read_word_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Words of recognition output in tab-separated form: rows of level 5 with text."""
    schema = "level int, page int, block int, par int, line int, word int, x double, y double, width double, height double, confidence double, text string"
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, quote="\u0000", mode="PERMISSIVE")
    return rows.where((F.col("level") == 5) & (F.trim("text") != "")).select("page", "text", "x", "y", "width", "height", "confidence")


def words_of_hocr(pages: DataFrame, markup: str = "markup") -> DataFrame:
    """Words of hOCR markup: one row per word span. pages: page, markup."""
    span = r"<span class=['\"]ocrx_word['\"][^>]*title=['\"]bbox \d+ \d+ \d+ \d+[^>]*>.*?</span>"
    each = pages.select("page", F.explode(F.regexp_extract_all(markup, F.lit(f"({span})"), F.lit(1))).alias("s"))
    box = [F.regexp_extract("s", r"bbox (\d+) (\d+) (\d+) (\d+)", i).cast("double") for i in (1, 2, 3, 4)]
    text = F.trim(F.regexp_replace("s", "<[^>]+>", ""))
    out = each.select(
        "page", text.alias("text"), box[0].alias("x"), box[1].alias("y"), (box[2] - box[0]).alias("width"), (box[3] - box[1]).alias("height"),
        F.regexp_extract("s", r"x_wconf (\d+)", 1).try_cast("double").alias("confidence"),
    )
    return out.where("text <> ''")


def words_of_blocks(pages: DataFrame, blocks: str = "blocks") -> DataFrame:
    """Words of recognition output in nested form: blocks, paragraphs, lines, words; equal text in an equal box counts once."""
    w = pages.select("page", F.explode(blocks).alias("b")).select("page", F.explode("b.paragraphs").alias("p")).select("page", F.explode("p.lines").alias("l")).select("page", F.explode("l.words").alias("w"))
    return w.select("page", F.col("w.text").alias("text"), F.col("w.x").alias("x"), F.col("w.y").alias("y"), F.col("w.width").alias("width"), F.col("w.height").alias("height")).dropDuplicates(["page", "text", "x", "y", "width", "height"])


def richest_layout(candidates: DataFrame) -> DataFrame:
    """Of several readings of a page (page, origin, words) that with the most words; the first origin among equals."""
    return candidates.groupBy("page").agg(F.min_by(F.struct("origin", "words"), F.struct(-F.size("words"), F.col("origin"))).alias("best")).select("page", "best.*")


def _paragraphs(content: bytes) -> str:
    name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{name}t")) for p in root.iter(f"{name}p"))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, text, error: paragraph text of word documents. A file that cannot be read has its reason in error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for p, c in zip(f["path"], f["content"], strict=True):
                try:
                    rows.append((p, _paragraphs(c), None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((p, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")
