"""Files and uploads as normalized documents: admission, dispatch, decoding, checksums."""

from __future__ import annotations

import io
import mimetypes
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import line_count, path_suffix, safe_path, strip

MAX_BYTES = 20 * 1024 * 1024
MAX_PATH = 1000
#: Suffixes by kind, folders that are left out, media types by suffix.
TEXT_SUFFIXES = (".txt", ".md", ".markdown", ".rst", ".csv", ".tsv", ".json", ".jsonl", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".log", ".html", ".htm")
CODE_SUFFIXES = (".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".kt", ".kts", ".c", ".h", ".cpp", ".hpp", ".cs", ".go", ".rs", ".rb", ".php", ".swift", ".sql", ".sh", ".ps1", ".css", ".scss", ".xml")
IGNORED_FOLDERS = (".git", ".cache", ".next", ".venv", "venv", "node_modules", "dist", "build", "__pycache__")
MEDIA_TYPES = {".txt": "text/plain", ".md": "text/markdown", ".markdown": "text/markdown", ".csv": "text/csv", ".html": "text/html", ".htm": "text/html", ".css": "text/css", ".py": "text/x-python", ".js": "text/javascript", ".json": "application/json", ".xml": "text/xml", ".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document"}
#: What a file that isn't admitted or can't be read is reported with.
IGNORED, LONG_PATH, EMPTY, TOO_LARGE, UNSUPPORTED = "ignored folder: ", "path is longer than the 1,000-character limit", "empty file", "larger than the 20 MB per-file limit", "unsupported file type: "
NO_TEXT, BAD_DOCX, NO_PARAGRAPH, NO_PDF, NO_PAGE = "file contains no searchable text", "DOCX file is invalid or unreadable", "DOCX contains no searchable paragraph text", "PDF support is not installed", "PDF contains no extractable text"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def media_type(path: Column, given: Column) -> Column:
    """The type that was given, else the suffix's, else bytes."""
    guessed = {s: mimetypes.types_map[s] for s in (*TEXT_SUFFIXES, *CODE_SUFFIXES) if s in mimetypes.types_map}
    known = F.create_map(*[F.lit(x) for pair in (guessed | MEDIA_TYPES).items() for x in pair])
    return F.coalesce(F.when(given != "", given), known[path_suffix(path)], F.lit("application/octet-stream"))


def skip_reason(path: Column, size: Column, kind: Column) -> Column:
    """Why a file isn't admitted; null if it is."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    ignored = F.get(F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*IGNORED_FOLDERS)), 0)
    suffix = F.lower(F.regexp_extract(F.element_at(parts, -1), r"\.[^.]*$", 0))
    what = F.coalesce(F.when(suffix != "", suffix), F.when(kind != "", kind), F.lit("unknown"))
    unsupported = ~suffix.isin(".pdf", ".docx", *TEXT_SUFFIXES, *CODE_SUFFIXES) & ~F.coalesce(kind, F.lit("")).startswith("text/")
    return (
        F.when(ignored.isNotNull(), F.concat(F.lit(IGNORED), ignored))
        .when(F.length(path) > MAX_PATH, LONG_PATH)
        .when(size == 0, EMPTY)
        .when(size > MAX_BYTES, TOO_LARGE)
        .when(unsupported, F.concat(F.lit(UNSUPPORTED), what))
    )


def route(path: Column, kind: Column) -> Column:
    """Which reader takes a file: pdf, docx, text or unsupported."""
    suffix = path_suffix(path)
    text = suffix.isin(*TEXT_SUFFIXES, *CODE_SUFFIXES) | kind.startswith("text/")
    return F.when(suffix == ".pdf", "pdf").when(suffix == ".docx", "docx").when(text, "text").otherwise("unsupported")


def checksum(content: Column) -> Column:
    return F.sha2(content, 256)


def document_id(path: Column, digest: Column) -> Column:
    return F.concat(F.lit("local-"), F.substring(F.sha2(F.concat(path, digest), 256), 1, 16))


def decode_upload(encoded: Column) -> Column:
    """Bytes of a base64 upload; null where it isn't valid or is too large."""
    content = F.try_to_binary(encoded, F.lit("base64"))
    return F.when(F.length(content) <= MAX_BYTES, content)


def text_documents(files: DataFrame) -> DataFrame:
    """Text files (path, media_type, content) as documents of one block, or an error."""
    body = strip(F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", ""))
    digest = checksum(F.col("content"))
    path = safe_path(F.col("path"))
    return files.select(
        path.alias("source_path"),
        media_type(path, F.col("media_type")).alias("media_type"),
        digest.alias("checksum"),
        document_id(path, digest).alias("document_id"),
        F.when(path_suffix(path).isin(*CODE_SUFFIXES), "code").otherwise("paragraph").alias("kind"),
        body.alias("text"),
        F.lit(1).alias("line_start"),
        (line_count(body) + 1).alias("line_end"),
        F.lit(0).alias("char_start"),
        F.length(body).alias("char_end"),
        F.when(path.isNull(), "file path is empty").when(body == "", NO_TEXT).alias("error"),
    )


def docx_paragraphs(content: bytes) -> list[tuple[int, str]]:
    """(number, text) of a document's paragraphs that have text; numbers count the empty ones too."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            root = ElementTree.fromstring(archive.read("word/document.xml"))
    except (KeyError, zipfile.BadZipFile) as error:
        raise ValueError(BAD_DOCX) from error
    texts = ("".join(t.text or "" for t in p.iter(f"{WORD}t")).strip() for p in root.iter(f"{WORD}p"))
    found = [(n, text) for n, text in enumerate(texts, 1) if text]
    if not found:
        raise ValueError(NO_PARAGRAPH)
    return found


def pdf_pages(content: bytes) -> list[tuple[int, str]]:
    """(page, text) of a PDF's pages that have text."""
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise ValueError(NO_PDF) from error
    texts = ((page.extract_text() or "").strip() for page in PdfReader(io.BytesIO(content)).pages)
    found = [(n, text) for n, text in enumerate(texts, 1) if text]
    if not found:
        raise ValueError(NO_PAGE)
    return found


def paged_blocks(files: DataFrame, kind: str) -> DataFrame:
    """DOCX or PDF files (path, content) as a row for each block, or one with the error."""
    read = {"docx": docx_paragraphs, "pdf": pdf_pages}[kind]

    def blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    for n, text in read(bytes(content)):
                        rows.append((path, n if kind == "pdf" else None, f"Paragraph {n}" if kind == "docx" else None, text, None))
                except Exception as error:  # a bad file is a row of its own, not the end of the read
                    rows.append((path, None, None, None, str(error)))
            out = pd.DataFrame(rows, columns=["source_path", "page", "section", "text", "error"])
            yield out.astype({"page": "Int32"})

    return files.select("path", "content").mapInPandas(blocks, "source_path string, page int, section string, text string, error string")
