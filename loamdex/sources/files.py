"""Reading uploaded files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loamdex.functions.text import upload_title, upload_url

# Fixed value: the file suffixes that are read.
SUFFIXES = ("txt", "md", "pdf", "docx")


def _pdf(data: bytes) -> str:
    from io import BytesIO

    from pypdf import PdfReader  # not installed everywhere

    return "\n".join(page.extract_text() or "" for page in PdfReader(BytesIO(data)).pages)


def docx_text(data: bytes) -> str:
    """Paragraphs of a .docx file joined by newlines, read from its XML with the standard library."""
    from io import BytesIO
    from xml.etree import ElementTree
    from zipfile import ZipFile

    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with ZipFile(BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{space}body")
    marks = {f"{space}tab": "\t", f"{space}br": "\n", f"{space}cr": "\n"}
    return "\n".join("".join(n.text or "" if n.tag == f"{space}t" else marks.get(n.tag, "") for n in p.iter()) for p in body.findall(f"{space}p"))


@F.pandas_udf(StringType())
def _binary_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for suffixes, contents in batches:
        yield pd.Series([_pdf(bytes(c)) if s == "pdf" else docx_text(bytes(c)) for s, c in zip(suffixes, contents)], dtype=object)


def file_texts(files: DataFrame, strict: bool = True) -> DataFrame:
    """(path, url, title, suffix, text) of (path, content) rows.

    .txt and .md are UTF-8, malformed bytes replaced, in the JVM; .docx is read
    from its XML; .pdf needs pypdf.  Another suffix is an error, or a null text
    if not ``strict``.
    """
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    plain = F.make_valid_utf8(F.col("content").cast("string"))
    other = F.raise_error(F.concat(F.lit("unsupported file type: "), F.col("path"))) if strict else F.lit(None).cast("string")
    tagged = files.withColumn("suffix", suffix)
    text = F.when(F.col("suffix").isin("txt", "md"), plain).when(~F.col("suffix").isin(*SUFFIXES), other)
    simple = tagged.where(~F.col("suffix").isin("pdf", "docx")).withColumn("text", text)
    rich = tagged.where(F.col("suffix").isin("pdf", "docx")).withColumn("text", _binary_text("suffix", "content"))
    out = simple.unionByName(rich)
    return out.select("path", upload_url(F.col("path")).alias("url"), upload_title(F.col("path")).alias("title"), "suffix", "text")


def read_files(spark: SparkSession, pattern: str, strict: bool = True) -> DataFrame:
    """The texts of all files that a path pattern names."""
    return file_texts(spark.read.format("binaryFile").load(pattern).select("path", "content"), strict)
