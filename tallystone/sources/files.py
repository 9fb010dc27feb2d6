"""Documents from files: bytes by Spark's binary reader, parsers by extension, pages and chunks as rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystone.functions.text import chunks, extension, not_blank
from tallystone.schema import ACCEPTED_EXTENSIONS

#: Pages of a file: (page number or None, text).
Parser = Callable[[bytes], list[tuple[int | None, str]]]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_txt(data: bytes) -> list[tuple[int | None, str]]:
    """UTF-8; bytes that aren't are left out."""
    return [(None, data.decode("utf-8", "ignore"))]


def parse_docx(data: bytes) -> list[tuple[int | None, str]]:
    """Paragraphs that aren't blank, a line each."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in body.iter(f"{_W}p")]
    return [(None, "\n".join(x for x in lines if x.strip()))]


def read_files(spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(path, page_number, text, processing_status, error_message): a row for each page, or one for a failed file.

    A PDF parser isn't built in; give one as ``parsers={".pdf": ...}``. A failure is a row, not the job's end.
    """
    known = {".txt": parse_txt, ".docx": parse_docx, **(parsers or {})}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path_, ext, content in zip(pdf["path"], pdf["ext"], pdf["content"], strict=True):
                try:
                    if ext not in known:
                        raise ValueError(f"unsupported file type {ext}")
                    rows += [(path_, n, t, "COMPLETED", None) for n, t in known[ext](bytes(content))]
                except Exception as e:
                    rows.append((path_, None, None, "FAILED", str(e)))
            yield pd.DataFrame(rows, columns=["path", "page_number", "text", "processing_status", "error_message"]).astype({"page_number": "Int32"})

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select("path", extension(F.col("path")).alias("ext"), "content").mapInPandas(run, "path string, page_number int, text string, processing_status string, error_message string")


def accepted(name: Column) -> Column:
    return extension(name).isin(ACCEPTED_EXTENSIONS)


def page_chunks(pages: DataFrame, document: str, page: str = "page_number") -> DataFrame:
    """(document, page, chunk_index, text): the index counts through all pages of a document; blank pages give nothing."""
    rows = pages.where(not_blank(F.col("text"))).select(document, page, F.posexplode(chunks(F.col("text"))).alias("pos", "chunk"))
    index = F.row_number().over(Window.partitionBy(document).orderBy(F.asc_nulls_first(page), "pos")) - 1
    return rows.select(document, page, index.alias("chunk_index"), F.col("chunk").alias("text"))


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a database by JDBC. With an integer ``key`` it is read in ``parts`` ranges of it, each by its own task.

    Filters and columns reach the database. ``options``: user, password, driver and the like.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    if key is None:
        return reader.option("dbtable", table).load()
    low, high = reader.option("dbtable", f"(select min({key}) as lo, max({key}) as hi from {table}) bounds").load().first()
    if low is None:
        return reader.option("dbtable", table).load()
    return reader.option("dbtable", table).options(partitionColumn=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts).load()
