"""Files as inputs: what is let in, decoding, and units from plain text.

Files come from Spark's binaryFile source, so path, length and content are columns and a
filter on name or length reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.text import safe_file_name

# The limit of inputs, and how the contents of formats begin.
MAX_BYTES = 40 * 1024 * 1024
FORMATS = (".txt", ".md", ".docx", ".pdf", ".png", ".jpg", ".jpeg", ".xlsx")
_ZIP = "504B0304"
MAGIC = {".docx": [_ZIP], ".xlsx": [_ZIP], ".pdf": ["25504446"], ".png": ["89504E470D0A1A0A"], ".jpg": ["FFD8FF"], ".jpeg": ["FFD8FF"]}
# Marks of active content in a PDF.
PDF_MARKS = ("/JavaScript", "/JS", "/OpenAction", "/Launch", "/EmbeddedFile", "/RichMedia", "/AA")


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def admit(files: DataFrame) -> DataFrame:
    """files (path, content) with format, name, sha256, size and reject: null, or why not."""
    df = files.withColumns({"format": extension(F.col("path")), "size": F.coalesce(F.octet_length("content").cast("long"), F.lit(0))})
    start = F.hex(F.substring("content", 1, 16))
    forged = F.lit(False)
    for kind, heads in MAGIC.items():
        hit = F.lit(False)
        for h in heads:
            hit = hit | start.startswith(h)
        forged = F.when(F.col("format") == kind, ~hit).otherwise(forged)
    nul = F.col("format").isin(".txt", ".md") & F.hex(F.substring("content", 1, 4096)).rlike("^(..)*?00")
    why = (
        F.when(~F.col("format").isin(*FORMATS), "formato no admitido").when(F.col("size") == 0, "archivo vacio")
        .when(F.col("size") > MAX_BYTES, "archivo demasiado grande").when(forged, "el contenido no corresponde a la extension").when(nul, "el contenido no es texto")
    )
    return df.withColumns({"name": safe_file_name(F.col("path")), "sha256": F.sha2("content", 256), "reject": why})


#: What Windows-1252 has where ISO 8859-1 has control characters.
_C1 = [(chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]


def decode_text(content: Column) -> Column:
    """UTF-8 with or without a mark, else Windows-1252."""
    bare = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.substring(content, 4, 2**31 - 1)).otherwise(content)
    return F.coalesce(F.try_validate_utf8(bare.cast("string")), F.translate(F.decode(content, "ISO-8859-1"), *("".join(x) for x in zip(*_C1, strict=True))))


def text_units(files: DataFrame) -> DataFrame:
    """Admitted text files as units: the whole body, and the file name, which cannot be rewritten.
    What is admitted has at most MAX_BYTES, so no text needs to be cut."""
    df = admit(files).where("reject is null and format in ('.txt', '.md')").withColumn("doc_id", F.xxhash64("path"))
    body = F.struct(F.lit(0).alias("unit_seq"), F.lit("contenido").alias("layer"), F.lit(True).alias("editable"), decode_text(F.col("content")).alias("text"))
    name = F.struct(F.lit(1).alias("unit_seq"), F.lit("nombre_archivo").alias("layer"), F.lit(False).alias("editable"), F.regexp_extract("path", r"([^/\\]*)$", 1).alias("text"))
    return df.select("doc_id", "path", F.explode(F.array(body, name)).alias("u")).select("doc_id", "u.unit_seq", "u.layer", "path", "u.editable", "u.text")


def pdf_marks(files: DataFrame) -> DataFrame:
    """path, marks: the active content that a PDF names. Texts of PDF files are not read."""
    raw = F.decode("content", "ISO-8859-1")
    marks = F.filter(F.array(*(F.when(raw.contains(m), m) for m in PDF_MARKS)), lambda m: m.isNotNull())
    return files.where(extension(F.col("path")) == ".pdf").select("path", marks.alias("marks"))


def scanned(n_images: Column, n_chars: Column, n_pages: Column) -> Column:
    """Whether a PDF seems to be pictures of pages."""
    return (n_images > 0) & (n_chars < 120 * F.greatest(n_pages, F.lit(1)))
