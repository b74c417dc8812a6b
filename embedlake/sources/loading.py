"""Loading and parsing: columns, files behind URIs, file types, HTML and documents."""

from __future__ import annotations

import html
import os
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Leading bytes (hexadecimal) of the file types that are told by content; fixed values.
MAGIC = {
    "pdf": "25504446", "png": "89504E470D0A1A0A", "jpg": "FFD8FF", "gif": "474946", "zip": "504B0304", "gz": "1F8B08", "bmp": "424D", "rtf": "7B5C727466",
}
#: What a zip archive with this in its first kilobyte is; fixed values.
INSIDE = {"epub": b"mimetypeapplication/epub+zip", "docx": b"word/", "xlsx": b"xl/", "pptx": b"ppt/"}


def sniff(content: bytes | None, path: str | None = None) -> str | None:
    """A file's type by its first bytes, else by the extension of its path, else None."""
    head = bytes(content or b"")[:4096]
    for kind, magic in MAGIC.items():
        if head.startswith(bytes.fromhex(magic)):
            if kind == "zip":
                return next((k for k, mark in INSIDE.items() if mark in head), "zip")
            return kind
    if path is None:
        return None
    ext = os.path.splitext(urlparse(path).path)[1]
    return ext[1:].lower() or None


def extension(url: Column | str) -> Column:
    """The extension of a URL's path, in lower case; null without one."""
    path = F.regexp_replace(F.col(url) if isinstance(url, str) else url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*|[?#].*$", "")
    name = F.regexp_extract(path, r"[^/]*$", 0)
    found = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))
    return F.nullif(found, F.lit(""))


class _Text(HTMLParser):
    SKIP, BREAK = {"script", "style", "head", "noscript", "template"}, {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table", "ul", "ol"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in self.SKIP))
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def html_text(page: str | None) -> str:
    """Visible text of a page: a line a block, blanks collapsed."""
    p = _Text()
    p.feed(page or "")
    p.close()
    lines = (re.sub(r"[ \t\r\f\v ]+", " ", x).strip() for x in "".join(p.out).split("\n"))
    return "\n".join(x for x in lines if x)


def title(page: Column | str) -> Column:
    """The text of the first ``<title>``, trimmed; empty without one."""
    return F.trim(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


def parse_document(content: bytes, file_type: str | None, implementation: str = "auto") -> str:
    """A document as text. Binary formats need the optional libraries; text, Markdown and HTML don't."""
    if file_type is None:
        raise ValueError("No file type detected")
    if file_type in ("txt", "md"):
        return bytes(content).decode("utf-8")
    if file_type in ("html", "htm"):
        return html_text(bytes(content).decode("utf-8", "replace"))
    if file_type == "epub" and implementation == "auto":
        implementation = "pymupdf"
    if implementation == "pymupdf":
        import io

        import pymupdf
        import pymupdf4llm

        return pymupdf4llm.to_markdown(pymupdf.open(stream=io.BytesIO(content), filetype=file_type))
    import io

    from docling.datamodel.base_models import DocumentStream
    from docling.document_converter import DocumentConverter

    return DocumentConverter().convert(DocumentStream(name=f"file.{file_type}", stream=io.BytesIO(content))).document.export_to_markdown()


def parse_value(value, path: str | None, implementation: str) -> str:
    """Text of a loaded value: strings pass; bytes are parsed by type."""
    if isinstance(value, str):
        if implementation in ("pymupdf", "docling"):
            raise ValueError("Cannot parse a string payload as a document")
        return value
    if implementation == "none":
        raise ValueError("Cannot parse document payload with parsing_none")
    return parse_document(bytes(value), sniff(value, path), implementation)


def payload(df: DataFrame, loading: dict, parsing: dict) -> DataFrame:
    """``df`` with ``_payload`` (text) and ``_load_error`` (null unless loading failed).

    Text columns stay in the JVM. URIs are opened a row at a time in Arrow batches, so that a missing file
    fails its own row only.
    """
    name, kind = loading["column_name"], parsing["implementation"]
    column = F.col(f"`{name}`")
    binary = df.schema[name].dataType.simpleString() == "binary"
    if loading["implementation"] == "column" and not binary:
        return df.withColumn("_payload", F.coalesce(column, F.lit(""))).withColumn("_load_error", F.lit(None).cast("string"))

    @F.arrow_udf("struct<text: string, error: string>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for v in batch:
                v = v.as_py()
                path = None
                if loading["implementation"] == "uri":
                    path = v
                    try:
                        v = open_uri(v, loading.get("aws_role_arn"))
                    except Exception as e:  # the row is retried later
                        out.append({"text": None, "error": f"{type(e).__name__}: {e}"})
                        continue
                out.append({"text": parse_value(v if v is not None else "", path, kind), "error": None})
            yield pa.array(out, pa.struct([("text", pa.string()), ("error", pa.string())]))

    return df.withColumn("_read", read(column)).withColumn("_payload", F.col("_read.text")).withColumn("_load_error", F.col("_read.error")).drop("_read")


def open_uri(uri: str, role: str | None = None) -> bytes:
    """Bytes behind a URI: local paths and every scheme that Arrow's file systems know. ``role`` is taken on for S3."""
    from pyarrow import fs

    if role and uri.startswith(("s3://", "s3a://")):
        with fs.S3FileSystem(role_arn=role, session_name="embedlake").open_input_stream(uri.partition("://")[2], compression=None) as f:
            return f.read()

    if "://" not in uri:
        with open(uri, "rb") as f:
            return f.read()
    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_stream(path, compression=None) as f:
        return f.read()


def unescape(column: Column | str) -> Column:
    """HTML character references resolved."""
    return F.udf(lambda x: None if x is None else html.unescape(x), "string")(column)
