import time
import zipfile

from velum.sources import files, office
from velum.streaming import pipeline as streaming


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿año".encode())
    (tmp_path / "b.md").write_bytes("precio 5€".encode("cp1252"))
    (tmp_path / "c.docx").write_bytes(b"no zip")
    found = files.read_files(spark, str(tmp_path))
    assert {r.name: r.reject for r in files.admit(found).collect()} == {"a.txt": None, "b.md": None, "c.docx": "el contenido no corresponde a la extension"}
    empty = spark.createDataFrame([("d.txt", bytearray(b"")), ("e.txt", None)], "path string, content binary")
    assert {r.reject for r in files.admit(empty).collect()} == {"archivo vacio"}
    rows = files.text_units(found).collect()
    assert {r.text for r in rows if r.layer == "contenido"} == {"año", "precio 5€"}
    assert {r.text for r in rows if r.layer == "nombre_archivo"} == {"a.txt", "b.md"}


def test_office_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Nota</w:t><w:tab/><w:t>uno</w:t></w:r><w:del><w:r><w:delText>viejo</w:delText></w:r></w:del></w:p>"
                   "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Ciudad</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Cali</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")  # fmt: skip
        z.writestr("word/header1.xml", f"<w:hdr {w}><w:p><w:r><w:t>cabeza</w:t></w:r></w:p></w:hdr>")
        z.writestr("docProps/core.xml", '<cp:coreProperties xmlns:cp="c" xmlns:dc="d"><dc:creator>Ana</dc:creator></cp:coreProperties>')
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>Edad</t></si><si><t>docente</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>64</v></c><c r="C1"><f>1+1</f><v>2</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>7</v></c></row></sheetData></worksheet>')
    (tmp_path / "c.docx").write_bytes(b"PK\x03\x04 broken")
    rows = office.units(files.read_files(spark, str(tmp_path))).collect()
    got = {(r.layer, r.text, r.editable, r.prev_label) for r in rows}
    assert {("contenido", "Nota\tuno", True, None), ("control_cambios", "viejo", False, None), ("tabla", "Cali", True, "Ciudad"), ("encabezado", "cabeza", True, None), ("metadatos", "Ana", False, None)} <= got
    assert {("hoja_calculo", "64", True, "Edad"), ("hoja_calculo", "docente", True, None), ("hoja_calculo", "7", False, "docente")} <= got
    assert not any(r.text == "2" for r in rows)
    assert [r.text for r in rows if r.layer == "error"] == ["BadZipFile"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "Correo a@b.org"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    docs = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = streaming.redact_stream(docs, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(120)
    assert {r.doc_id: r.new_text for r in spark.read.parquet(str(tmp_path / "out" / "texts")).collect()} == {1: "Correo [CORREO ELIMINADO]", 2: ""}
    assert spark.read.parquet(str(tmp_path / "out" / "matrix")).count() == 1


def test_units_that_arrive_apart(spark, tmp_path):
    schema = "doc_id long, unit_seq int, n_units int, text string"
    batches = [
        [(1, 1, 3, "Correo a@b.org"), (2, 0, 1, "solo"), (3, 0, 2, "falta")],
        [(1, 0, 3, "Paciente: Maria Torres"), (1, 1, 3, "Correo a@b.org"), (4, 0, 2, None)],
        [(1, 2, 3, "fin"), (2, 0, 1, "solo"), (2, 1, 1, "tarde"), (4, 1, 5, "otro"), (4, 1, 2, "")],
        [(1, 5, 3, "tarde"), (5, 0, 1, "x")],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    units = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    def until(q, done):
        end = time.time() + 90
        while not done() and q.isActive and time.time() < end:
            time.sleep(0.5)
        q.stop()

    q = streaming.redact_units_stream(units, str(tmp_path / "out"), str(tmp_path / "cp"), every="0 seconds")
    until(q, lambda: sum(p.numInputRows for p in q.recentProgress) >= sum(map(len, batches)))
    got = {(r.doc_id, r.unit_seq): (r.new_text, r.batch) for r in spark.read.parquet(str(tmp_path / "out" / "texts")).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 0): "Paciente: [PACIENTE]", (1, 1): "Correo [CORREO ELIMINADO]", (1, 2): "fin", (2, 0): "solo", (4, 0): "", (4, 1): "", (5, 0): "x"}
    assert {v[1] for k, v in got.items() if k[0] == 1} == {2}
    rejects = sorted((r.doc_id, r.unit_seq, r.fate) for r in spark.read.parquet(str(tmp_path / "out" / "rejects")).collect())
    assert rejects == [(1, 1, "replayed"), (1, 5, "late"), (2, 0, "replayed"), (2, 1, "late"), (4, 1, "contradictory")]
    # without another unit for so long, what is not whole goes to the rejects
    more = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    rejects = tmp_path / "out2" / "rejects"

    def fates():
        return {(r.doc_id, r.unit_seq, r.fate) for r in spark.read.parquet(str(rejects)).collect()} if list(rejects.glob("*/_SUCCESS")) else set()

    q = streaming.redact_units_stream(more, str(tmp_path / "out2"), str(tmp_path / "cp2"), wait_ms=1, every="0 seconds")
    until(q, lambda: (3, 0, "incomplete") in fates())
    assert (3, 0, "incomplete") in fates()


def test_matrix_files_equal_a_csv_writer(spark):
    import csv
    import io

    from velum.operators import audit

    rows = [(d, 0, i, *(f"{c}{d}" for c in audit.MATRIX[:-1]), bool(i % 2)) for d in (1, 2) for i in range(3)]
    rows += [(3, 1, 0, 'a"b', "c;d", "e\nf", "g\rh", None, "", " i ", "ñ'", ",", "\t", "x", "y", True), (3, 0, 9, *["z"] * 12, False)]
    df = spark.createDataFrame(rows, "doc_id long, unit_seq int, ord int, " + ", ".join(f"{c} {'boolean' if c == 'requires_review' else 'string'}" for c in audit.MATRIX))
    for r in audit.matrix_files(df).collect():
        out = io.StringIO(newline="")
        w = csv.writer(out, delimiter=";")
        w.writerow(audit.FILE_COLUMNS)
        w.writerows(["" if v is None else v for v in x[3:]] for x in sorted((x for x in rows if x[0] == r.doc_id), key=lambda x: x[1:3]))
        assert bytes(r.content) == out.getvalue().encode("utf-8-sig")


def test_unfinished_runs_are_not_listed(spark, tmp_path):
    from velum.plans import runs

    (tmp_path / "run=a").mkdir()
    assert runs.runs(spark, str(tmp_path)) == []
    (tmp_path / "run=a" / runs.WHOLE).touch()
    assert runs.runs(spark, str(tmp_path)) == ["a"]
