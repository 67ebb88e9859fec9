"""What PDF files and images say of themselves, read from their bytes: no pixels, no pages.

PDF: the literal strings of its information dictionary, its first XMP packet and the names of
embedded files, where they are not compressed. PNG: text and EXIF chunks. JPEG: comments and EXIF segments.

Edge cases: a null or empty content says nothing; what is cut off or malformed is read up to there;
values are shown up to LONGEST characters (XMP: 1,000); nothing is ever executed or opened.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.sources.files import PDF_MARKS, extension

XMP_SHOWN, LONGEST = 1000, 200
# Keys of a PDF's information dictionary, and how a strings escapes.
INFO = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")
# EXIF tags by number.
TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime",
    0x013B: "Artist", 0x013C: "HostComputer", 0x8298: "Copyright", 0x8769: "ExifOffset", 0x8825: "GPSInfo", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal",
    0x9004: "DateTimeDigitized", 0x927C: "MakerNote", 0x9286: "UserComment", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber", 0xA433: "LensMake", 0xA434: "LensModel",
}


# ------------------------------------------------------------------------- PDF


def _unescaped(s: Column) -> Column:
    """A literal string of a PDF without the escapes of its brackets and backslashes."""
    return F.regexp_replace(s, r"\\([()\\])", "$1")


def pdf_metadata(files: DataFrame) -> DataFrame:
    """doc_id, path, key, value of PDF files (path, content), in built-in functions."""
    raw = F.decode("content", "ISO-8859-1")
    literal = r"\s*\(((?:\\.|[^\\()])*)\)"
    found = files.where((extension(F.col("path")) == ".pdf") & F.col("content").isNotNull()).select("path", raw.alias("raw"))
    info = [F.struct(F.lit(f"info:{k}").alias("key"), _unescaped(F.regexp_extract("raw", f"(?s)/{k}{literal}", 1)).alias("value")) for k in INFO]
    packet = F.regexp_extract("raw", r"(?s)<\?xpacket begin=.*?<\?xpacket end=[^>]*\?>", 0)
    xmp = F.substring(F.encode(packet, "ISO-8859-1").cast("string"), 1, XMP_SHOWN)
    names = F.transform(F.regexp_extract_all("raw", F.lit(rf"(?s)/Filespec\b[^>]*?/U?F{literal}"), F.lit(1)), _unescaped)
    more = [F.struct(F.lit("xmp").alias("key"), xmp.alias("value")), F.struct(F.lit("archivos_embebidos").alias("key"), F.array_join(F.array_distinct(names), ", ").alias("value"))]
    return found.select("path", F.inline(F.array(*info, *more))).where("value <> ''").select(F.xxhash64("path").alias("doc_id"), "path", "key", "value")


# What is told of a PDF, and how grave it is.
PDF_ALERTS = {"ARCHIVOS_EMBEBIDOS": ("critica", "El PDF contiene archivos embebidos; no se abren."), "PDF_CON_ACCIONES": ("advertencia", "El PDF declara elementos activos; no se ejecutan.")}


def pdf_alerts(files: DataFrame) -> DataFrame:
    """doc_id, path, level, code, message, n, as office.alerts: n counts embedded files and kinds of active content."""
    raw = F.decode("content", "ISO-8859-1")
    marks = F.size(F.filter(F.array(*(raw.contains(m) for m in PDF_MARKS)), lambda x: x))
    counts = {"ARCHIVOS_EMBEBIDOS": F.size(F.regexp_extract_all(raw, F.lit(r"/Filespec\b"), F.lit(0))), "PDF_CON_ACCIONES": marks}
    told = F.array(*(F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), F.lit(said).alias("message"), counts[code].cast("long").alias("n")) for code, (level, said) in PDF_ALERTS.items()))
    found = files.where((extension(F.col("path")) == ".pdf") & F.col("content").isNotNull()).select("path", F.inline(told)).where("n > 0")
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "level", "code", "message", "n")


# ---------------------------------------------------------------------- images


def _exif(data: bytes) -> Iterator[tuple[str, str]]:
    """The tags of a TIFF structure: its first directory and those that it refers to."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        return
    sizes = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}
    todo, seen = [struct.unpack(order + "I", data[4:8])[0]], set()
    while todo:
        at = todo.pop(0)
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        (n,) = struct.unpack(order + "H", data[at : at + 2])
        for k in range(n):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            if len(entry) < 12:
                return
            tag, kind, count = struct.unpack(order + "HHI", entry[:8])
            length = sizes.get(kind, 0) * count
            if not length:
                continue
            start = struct.unpack(order + "I", entry[8:])[0]
            value = entry[8 : 8 + length] if length <= 4 else data[start : start + length]
            if len(value) < length:
                continue
            if tag in (0x8769, 0x8825):
                todo.append(struct.unpack(order + "I", value[:4])[0])
            elif kind in (3, 4, 9):
                yield f"exif:{TAGS.get(tag, tag)}", ", ".join(map(str, struct.unpack(order + str(count) + {3: "H", 4: "I", 9: "i"}[kind], value)))
            elif kind in (5, 10):
                parts = struct.unpack(order + str(2 * count) + ("I" if kind == 5 else "i"), value)
                yield f"exif:{TAGS.get(tag, tag)}", ", ".join(f"{a}/{b}" for a, b in zip(parts[::2], parts[1::2], strict=True))
            elif kind == 2 or tag == 0x9286:
                yield f"exif:{TAGS.get(tag, tag)}", value.removeprefix(b"ASCII\0\0\0").split(b"\0")[0].decode("utf-8", "replace")
            else:
                yield f"exif:{TAGS.get(tag, tag)}", f"({length} bytes)"


def _inflated(data: bytes, most: int = 1 << 20) -> bytes:
    """What a compressed text begins with, at most so many bytes."""
    return zlib.decompressobj().decompress(data, most)


def _png(data: bytes) -> Iterator[tuple[str, str]]:
    at = 8
    while at + 8 <= len(data):
        length, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + length]
        if len(body) < length or kind == b"IEND":
            return
        key, _, rest = body.partition(b"\0")
        name = f"info:{key.decode('latin-1')}"
        if kind == b"tEXt":
            yield name, rest.decode("latin-1")
        elif kind == b"zTXt":
            yield name, _inflated(rest[1:]).decode("latin-1")
        elif kind == b"iTXt" and len(rest) > 2:
            text = rest[2:].split(b"\0", 2)[-1]
            yield name, (_inflated(text) if rest[0] else text).decode("utf-8", "replace")
        elif kind == b"eXIf":
            yield from _exif(body)
        elif kind == b"iCCP":
            yield "info:icc_profile", f"({length} bytes)"
        at += 12 + length


def _jpeg(data: bytes) -> Iterator[tuple[str, str]]:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF or 0xD0 <= mark <= 0xD8 or mark == 1:  # fill bytes and marks without a length
            at += 1 if mark == 0xFF else 2
            continue
        (length,) = struct.unpack(">H", data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + length]
        if mark in (0xD9, 0xDA) or len(body) < length - 2:  # the end, or pixels from here on
            return
        if mark == 0xFE:
            yield "info:comment", body.decode("utf-8", "replace")
        elif mark == 0xE1 and body[:6] == b"Exif\0\0":
            yield from _exif(body[6:])
        elif mark == 0xE2 and body[:12] == b"ICC_PROFILE\0":
            yield "info:icc_profile", f"({len(body) - 14} bytes)"
        at += 2 + length


def told(content: bytes | None) -> list[tuple[str, str]]:
    """Keys and values of an image."""
    data = bytes(content or b"")
    found: list[tuple[str, str]] = []
    try:
        for pair in _png(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else _jpeg(data) if data[:2] == b"\xff\xd8" else ():
            found.append(pair)
    except (struct.error, zlib.error):
        pass  # malformed from here on
    return [(k, v[:LONGEST]) for k, v in found if v.strip() and v != "0"]


def image_metadata(files: DataFrame) -> DataFrame:
    """doc_id, path, key, value of PNG and JPEG files (path, content), as metadata.findings reads them."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pages:
            rows = [(path, k, v) for path, content in zip(pdf["path"], pdf["content"], strict=True) for k, v in told(content)]
            yield pd.DataFrame(rows, columns=["path", "key", "value"])

    found = files.where(extension(F.col("path")).isin(".png", ".jpg", ".jpeg")).select("path", "content").mapInPandas(run, "path string, key string, value string")
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "key", "value")
