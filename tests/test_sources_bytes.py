"""Matches by built-in functions, decomposition, metadata from bytes, the index of reappearing values."""

import re
import struct
import sys
import unicodedata
import zlib

from pyspark.sql import functions as F

from velum.functions import native
from velum.functions.spans import scan
from velum.functions.text import safe_file_name, without_marks
from velum.operators import detect, verify
from velum.plans import office_samples
from velum.sources import embedded

SF = "/root/testdata/sf0.001"


def test_native_matches_equal_scan(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    pages = spark.read.parquet(f"{SF}/pages.parquet").select((-F.col("page_id") - 1).alias("doc_id"), F.col("html").alias("text"))
    odd = ["😀 a@b.org, a@b.org x@y.es", "", None, "10.0.0.1 1.2.3 12/03/2020 3-4-99é 12/03/20201", "hTTp://x.y/ñ?q=(1)", "a@b.org", "3 de ENERO de 2020; enero del 1999", "3 de enero de 2020"]
    both = texts.unionByName(pages).unionByName(spark.createDataFrame([(90_000 + i // 2, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    for p in [p for p in detect.PATTERNS if p.kind in ("email", "url", "ip", "date")]:
        mine = native.matches(both, ["doc_id"], "text", "(?U)" + p.regex)
        want = scan(both, [p], ["doc_id"]).select("doc_id", "start", "end", "text")
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, want.collect())), p.kind
        plan = mine._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan
    assert native.matches(both.limit(0), ["doc_id"], "text", "x").count() == 0


def test_decomposition_of_every_code_point(spark):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.decomposition(chr(c))]
    points += ["", None, "ạ́b", "ﬃ ẛ̣"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(points)], "i int, t string").select("i", without_marks("t").alias("t")).collect()
    for r in got:
        t = points[r.i]
        assert r.t == (None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))
    names = spark.createDataFrame([("a/b\\Ｎú̈ ①.ＰＤＦ",), ("..",), (None,), ("._a_.b.Extension9x",), ("x.",), ("m" * 95 + ".t",)], "n string").select(safe_file_name(F.col("n")).alias("n")).collect()
    assert [r.n for r in names] == ["Nu_1.pdf", "documento", "documento", "a_.b.extensio", "x", "m" * 90 + ".t"]


def test_images(spark):
    assert embedded.told(office_samples.png(7)) == [("info:Author", "Dueno 7"), ("info:Comment", "nota 7"), ("info:Title", "año 7"), ("exif:Orientation", "1"), ("exif:Artist", "Artista 7")]
    assert embedded.told(office_samples.jpeg(7)) == [("info:comment", "hecho por 7"), ("exif:Model", "Camara 7")]
    for whole in (office_samples.png(7), office_samples.jpeg(7)):
        for n in range(len(whole)):  # whatever is cut off, what stands before is read
            assert embedded.told(whole)[: len(embedded.told(whole[:n]))] == embedded.told(whole[:n])
    assert embedded.told(None) == embedded.told(b"") == embedded.told(b"GIF89a") == []
    # small end first, a directory that another refers to, rationals, a loop, a wrong offset
    sub = struct.pack("<H", 2) + struct.pack("<HHII", 0x829A, 5, 1, 80) + struct.pack("<HHII", 0x8769, 4, 1, 8) + struct.pack("<I", 0)
    top = struct.pack("<H", 3) + struct.pack("<HHII", 0x8769, 4, 1, 50) + struct.pack("<HHII", 0x010F, 2, 900, 70) + struct.pack("<HHI4s", 0x9999, 2, 3, b"ab\0\0") + struct.pack("<I", 0)
    tiff = struct.pack("<2sHI", b"II", 42, 8) + top
    tiff = tiff.ljust(50, b"\0") + sub
    tiff = tiff.ljust(80, b"\0") + struct.pack("<II", 1, 60)
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", len(tiff), b"eXIf") + tiff + b"\0" * 4 + struct.pack(">I4s", 9, b"zTXt") + b"k\0\0broken!" + b"\0" * 4
    assert embedded.told(png) == [("exif:39321", "ab"), ("exif:ExposureTime", "1/60")]
    bomb = b"c\0\0" + zlib.compress(b"x" * (8 << 20))
    assert embedded.told(b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", len(bomb), b"zTXt") + bomb) == [("info:c", "x" * 200)]
    df = spark.createDataFrame([("a.PNG", bytearray(office_samples.png(1))), ("b.jpg", None), ("c.txt", bytearray(b"x"))], "path string, content binary")
    assert {(r.path, r.key) for r in embedded.image_metadata(df).collect()} == {("a.PNG", k) for k in ("info:Author", "info:Comment", "info:Title", "exif:Orientation", "exif:Artist")}


def test_pdf_bytes(spark):
    far = b"%PDF" + b"\0\xff" * 3_000_000 + "<?xpacket begin=''?>añ<?xpacket end='r'?>".encode() + b"<< /Title(a\\)b) /Filespec /UF (x\\(1\\).csv) >><< /Type /Filespec /F (y.csv) >> /AA"
    df = spark.createDataFrame([("a.pdf", bytearray(far)), ("b.pdf", None), ("c.pdf", bytearray(b"")), ("d.txt", bytearray(far))], "path string, content binary")
    assert {(r.path, r.key, r.value) for r in embedded.pdf_metadata(df).collect()} == {
        ("a.pdf", "info:Title", "a)b"), ("a.pdf", "xmp", "<?xpacket begin=''?>añ<?xpacket end='r'?>"), ("a.pdf", "archivos_embebidos", "x(1).csv, y.csv"),
    }
    assert {(r.path, r.code, r.level, r.n) for r in embedded.pdf_alerts(df).collect()} == {("a.pdf", "ARCHIVOS_EMBEBIDOS", "critica", 2), ("a.pdf", "PDF_CON_ACCIONES", "advertencia", 1)}


def test_reappearing_equals_brute_force(spark):
    values = ["Ana Pérez", "ana", "Cali", "calle 5 #3-2", "@usuario", "a@b.org", "+57 300", "ΑΒΓΔ", "(x) 12 y", "1.094.556", "José", "  Rosa  "]
    texts = ["localizado en cali.", "ANA PEREZ y @usuario_2", "ana-perez ana  perez", "vive en Calle 5 #3-2, [Cali] y [otra\ncosa]", "xa@b.org a@b.orgx", "a@b.org +57 300", "αβγδ", "(x) 12 y1; 1.094.5567", "12 1.094.556.", "jose rosa", None, ""]
    decided = [(d, i, 0, v, "eliminar", "x", True, "nombre_persona", "contenido") for d in (1, 2) for i, v in enumerate(values)]
    units = [(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "nada"), (3, 0, "Cali")]
    d = spark.createDataFrame(decided, "doc_id long, unit_seq int, ord int, text string, action string, result string, applied boolean, type string, layer string").withColumn("path", F.lit(""))
    u = spark.createDataFrame(units, "doc_id long, unit_seq int, new_text string")
    got = sorted(r.masked for r in verify.reappearing(u, d).where("doc_id = 1").collect())
    plain = str.maketrans("áéíóúñ", "aeioun")

    def folded(t):
        return (t or "").translate(plain).lower()

    want = []
    for v in values:
        n = folded(v.strip())
        if len(n) >= 4 and any(re.search(r"(?<![0-9a-z])" + re.escape(n) + r"(?![0-9a-z])", re.sub(r"\[[^\]]{0,60}\]", " ", folded(t))) for t in texts):
            v = v.strip()
            want.append(v[:2] + "*" * (len(v) - 3) + v[-1])
    assert want and got == sorted(want) and verify.reappearing(u, d).where("doc_id <> 1").count() == 0
