"""Titles and media types of files. Extractors are functions from (path, head) to a row; more can be registered."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths

SNIFF = 512
UNKNOWN = "application/octet-stream"

# Fixed values of the public MIME sniffing standard: HTML tags, then exact heads, then masked heads ("." matches any byte).
HTML_TAGS = "!DOCTYPE HTML,HTML,HEAD,SCRIPT,IFRAME,H1,DIV,FONT,TABLE,A,STYLE,TITLE,B,BODY,BR,P".split(",")
HEADS = [
    (rb"%PDF-", "application/pdf"), (rb"%!PS-Adobe-", "application/postscript"),
    (rb"\xFE\xFF", "text/plain; charset=utf-16be"), (rb"\xFF\xFE", "text/plain; charset=utf-16le"), (rb"\xEF\xBB\xBF", "text/plain; charset=utf-8"),
    (rb"\x00\x00\x01\x00", "image/x-icon"), (rb"\x00\x00\x02\x00", "image/x-icon"), (rb"BM", "image/bmp"), (rb"GIF8[79]a", "image/gif"),
    (rb"RIFF....WEBPVP", "image/webp"), (rb"\x89PNG\r\n\x1A\n", "image/png"), (rb"\xFF\xD8\xFF", "image/jpeg"),
    (rb"FORM....AIFF", "audio/aiff"), (rb"ID3", "audio/mpeg"), (rb"OggS\x00", "application/ogg"), (rb"MThd\x00\x00\x00\x06", "audio/midi"),
    (rb"RIFF....AVI ", "video/avi"), (rb"RIFF....WAVE", "audio/wave"), (rb"\x1A\x45\xDF\xA3", "video/webm"),
    (rb"\x00\x01\x00\x00", "font/ttf"), (rb"OTTO", "font/otf"), (rb"ttcf", "font/collection"), (rb"wOFF", "font/woff"), (rb"wOF2", "font/woff2"),
    (rb"\x1F\x8B\x08", "application/x-gzip"), (rb"PK\x03\x04", "application/zip"), (rb"Rar!\x1A\x07\x00", "application/x-rar-compressed"),
    (rb"Rar!\x1A\x07\x01\x00", "application/x-rar-compressed"), (rb"\x00asm", "application/wasm"),
]

_HTML = re.compile(rb"(?:<(?:" + b"|".join(t.encode() for t in HTML_TAGS) + rb")[ >])|<!--[ >]", re.I)
_XML = re.compile(rb"<\?xml", re.I)
_HEADS = [(re.compile(p, re.S), kind) for p, kind in HEADS]
_BINARY = re.compile(rb"[\x00-\x08\x0B\x0E-\x1A\x1C-\x1F]")


def _mp4(head: bytes) -> bool:
    size = int.from_bytes(head[:4], "big") if len(head) >= 12 else 0
    return size % 4 == 0 and 12 <= size <= len(head) and head[4:8] == b"ftyp" and any(head[i : i + 3] == b"mp4" for i in range(8, size, 4) if i != 12)


def sniff(head: bytes | None) -> str:
    """Media type of a file's first bytes; null, a file that can't be opened, is unknown."""
    if head is None:
        return UNKNOWN
    head = bytes(head[:SNIFF])
    text = head.lstrip(b"\t\n\x0c\r ")
    if _HTML.match(text):
        return "text/html; charset=utf-8"
    if _XML.match(text):
        return "text/xml; charset=utf-8"
    for pattern, kind in _HEADS:
        if pattern.match(head):
            return kind
    if _mp4(head):
        return "video/mp4"
    return UNKNOWN if _BINARY.search(head) else "text/plain; charset=utf-8"


def sniffed(content: Column) -> Column:
    """sniff as one expression, over a binary column: the first bytes are read as Latin-1, in which each byte is one character."""
    head = F.decode(F.substring(content, 1, SNIFF), "ISO-8859-1")
    text = F.regexp_replace(head, r"^[\t\n\f\r ]+", "")
    java = lambda p: p.pattern.decode("latin-1")
    out = F.when(content.isNull(), UNKNOWN).when(text.rlike("(?i)^(?:" + java(_HTML) + ")"), "text/html; charset=utf-8").when(text.rlike("(?i)^" + java(_XML)), "text/xml; charset=utf-8")
    for pattern, kind in _HEADS:
        out = out.when(head.rlike("(?s)^(?:" + java(pattern) + ")"), kind)
    size = F.conv(F.hex(F.substring(content, 1, 4)), 16, 10).cast("long")
    n = F.char_length(head)
    fits = (n >= 12) & (size % 4 == 0) & (size >= 12) & (size <= n) & (F.substring(head, 5, 4) == "ftyp")
    brands = F.exists(F.sequence(F.lit(8), F.greatest(F.least(size, n).cast("int") - 1, F.lit(8)), F.lit(4)), lambda i: (i != 12) & (F.substr(head, i + 1, F.lit(3)) == "mp4"))
    return out.when(F.when(fits, brands).otherwise(False), "video/mp4").when(head.rlike(java(_BINARY)), UNKNOWN).otherwise("text/plain; charset=utf-8")


Extractor = Callable[[str, bytes | None], dict]
EXTRACTORS: dict[str, Extractor] = {"metadata": lambda path, head: {"mime": sniff(head)}}


class Unavailable(RuntimeError):
    """An extractor that isn't installed."""


def _helper(path: str, head: bytes | None) -> dict:
    raise Unavailable("the helper isn't there")


EXTRACTORS["helper"] = _helper


def extracted(files: DataFrame, extractor: str = "metadata") -> DataFrame:
    """(path, title, mime, size, error) of files (rel, content binary, size); a failing extractor gives rows with error.

    The media types of `metadata` are found in the JVM; for other extractors the heads go to Python.
    """
    if extractor == "metadata":
        return files.select(F.col("rel").alias("path"), paths.title(paths.name(F.col("rel"))).alias("title"), sniffed(F.col("content")).alias("mime"), "size", F.lit(None).cast("string").alias("error"))
    own = EXTRACTORS[extractor]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            mime, error = [], []
            for path, head in zip(b["path"], b["head"], strict=True):
                try:
                    mime.append(own(path, head)["mime"])
                    error.append(None)
                except Exception as e:  # noqa: BLE001  an extractor's failure is a row
                    mime.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"path": b["path"], "title": b["title"], "mime": mime, "size": b["size"], "error": error})

    heads = files.select(F.col("rel").alias("path"), paths.title(paths.name(F.col("rel"))).alias("title"), "size", F.substring("content", 1, SNIFF).alias("head"))
    return heads.mapInPandas(run, "path string, title string, mime string, size long, error string")
