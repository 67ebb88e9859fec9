import re

import pytest

from velum.functions import text as X
from velum.functions.spans import Pattern, merge_intervals, scan
from velum.operators import clinical, detect, policy
from velum.plans import pipeline

UNIT = "doc_id long, unit_seq int, layer string, path string, editable boolean, text string"


def units(spark, *texts, **more):
    rows = [(i, 0, more.get("layer", "contenido"), "", more.get("editable", True), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, UNIT)


def found(spark, *texts):
    out = {}
    for r in detect.detect(units(spark, *texts)).orderBy("doc_id", "ord").collect():
        out.setdefault(r.doc_id, []).append((r.type, r.text))
    return [out.get(i, []) for i in range(len(texts))]


def test_scan_offsets(spark):
    texts = ["ñ a1 😀 b22 a3", None, "", "x" * 100_000 + " z9"]
    pattern = r"([a-z])(\d+)"
    rows = scan(units(spark, *texts), [Pattern("k", 0, pattern)], ["doc_id"]).collect()
    want = {(i, m.start(), m.end(), m.group(), m.start(2), m.group(2)) for i, t in enumerate(texts) for m in re.finditer(pattern, t or "")}
    assert {(r.doc_id, r.start, r.end, r.text, r.value_start, r.value) for r in rows} == want


def test_labels_ages_and_overlaps(spark):
    a, b, c, d, e = found(
        spark, "Paciente: Juan Perez Gomez  Edad: 64 anos", "dolor hace 8 anos, mujer de 45 años", "desde 70.23.22.57 y 1.094.556.231",
        "Institucion: Hospital  San Jose\nOcupacion: docente", "CONSULTA MEDICA en la junta",
    )
    assert a == [("nombre_persona", "Juan Perez Gomez"), ("edad", "64 anos")]
    assert b == [("edad", "45 años")]
    assert [t for t, _ in c] == ["ip"]
    assert ("ocupacion", "docente") in d
    assert e == [("posible_ocupacion", "MEDICA")]


def test_scopes_are_disjoint(spark):
    text = "Dra. Ana Garcia Ruiz, c.c. 12.345.678 tel: 300 123 4567 ana@x.org Calle 10 # 5-20, Bogotá 12/03/2020"
    rows = detect.detect(units(spark, text)).orderBy("scope_start").collect()
    assert all(x.scope_end <= y.scope_start for x, y in zip(rows, rows[1:]))
    assert {r.type for r in rows} >= {"nombre_profesional", "documento_identidad", "telefono_etiquetado", "email", "direccion", "localidad", "fecha"}


def test_empty_table_and_nulls(spark):
    assert detect.detect(units(spark).limit(0)).count() == 0
    assert found(spark, None, "") == [[], []]


@pytest.mark.parametrize(("age", "band"), [(0, "menor de 1 ano"), (64, "60-69 anos"), (95, "90 anos o mas"), (130, "[EDAD]")])
def test_age_band(spark, age, band):
    from pyspark.sql import functions as F

    assert spark.range(1).select(X.age_band(F.lit(age))).first()[0] == band


def test_fold_keeps_length(spark):
    text = "ÁÉÍÓÚ Ñandú çà 😀 ß"
    r = spark.createDataFrame([(text,)], "t string").select(X.fold(__import__("pyspark").sql.functions.col("t"))).first()[0]
    assert len(r) == len(text) and r.startswith("aeiou nandu ca")


def test_mask_never_shows_the_inside(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("ab",), ("abc",), ("abcdefgh",), ("",), (None,)], "t string").select("t", X.mask(F.col("t")).alias("m")).collect()
    assert [r.m for r in rows] == ["**", "a**", "ab*****h", "", ""]


def test_protected_content_blocks(spark):
    done = pipeline.process(units(spark, "Calle 45 cm 2\nCorreo a@b.org"))
    r = {x.type: x for x in done.decided.collect()}
    assert r["direccion"].action == policy.BLOCKED and not r["direccion"].applied
    assert done.units.first().new_text == "Calle 45 cm 2\nCorreo [CORREO ELIMINADO]"


def test_layers_that_are_not_rewritten(spark):
    kept = policy.decide(pipeline.annotate(units(spark, "a@b.org", layer="comentario", editable=False)), dropped_layers=("comentario",)).first()
    assert (kept.action, kept.applied) == ("eliminar", False)
    marked = policy.decide(pipeline.annotate(units(spark, "a@b.org", layer="ocr", editable=False))).first()
    assert marked.action == "marcar_para_revision"


def test_matrix_holds_no_identifier(spark):
    text = "Paciente: Juan Perez Gomez\nCedula: 1094556231\nCorreo juan.perez@x.org"
    rows = pipeline.process(units(spark, text)).matrix.collect()
    assert len(rows) == 3 and not any(x in str(rows) for x in ("Juan Perez", "1094556231", "juan.perez@"))


def test_results_do_not_depend_on_partitions(spark):
    texts = [f"Paciente: {n} Perez\nAcudiente: Ana Ruiz\n1{i}/02/2020 y 03/01/2020" for i, n in enumerate(["Juan", "Rosa", "Pedro"] * 5)]
    one, many = (pipeline.process(units(spark, *texts).repartition(n)).units.select("doc_id", "new_text").orderBy("doc_id").collect() for n in (1, 7))
    assert one == many and "[PACIENTE]" in one[0].new_text and "Dia 1" in one[0].new_text


def test_clinical_values(spark):
    rows = clinical.values(units(spark, "TA 120/80 mmhg, Hb 7,200 g/dl; quiste de 2 x 3 cm. Niega fiebre")).collect()
    assert {(r["class"], r.norm) for r in rows} >= {("signo_vital", "120/80"), ("numero_unidad", "7.2 g/dl"), ("medida", "2x3 cm"), ("diagnostico", "quiste"), ("negacion", "niega")}


def test_merge_intervals(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 9), (1, 1, 2), (2, 0, 1)], "k int, start long, end long")
    assert sorted(map(tuple, merge_intervals(df, ["k"]).collect())) == [(1, 0, 7, 3), (1, 9, 9, 1), (2, 0, 1, 1)]


def test_conversations_are_read_whole(spark, tmp_path):
    from velum import queries

    rows = [(1, 0, "user", "Mi correo es ana@uno.org y el de casa eva@dos.org"), (1, 1, "assistant", "Entonces escribo a ana@uno.org desde 70.23.22.9"), (1, 2, None, "luz@tres.org"), (2, 0, "user", None), (3, 0, "assistant", "nada")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.doc_id, r.type): (r.n, r.n_distinct) for r in queries.QUERIES["conversation_findings"](spark, str(tmp_path)).collect()}
    assert got == {(1, "email"): (5, 4), (1, "ip"): (1, 1), (2, "email"): (1, 1)}


def test_prefilters_change_nothing():
    # what a text must hold, so that a pattern is tried at all, may not rule out a match
    import re

    from velum.operators import detect

    texts = ["vive en Calle # A bis, Cali", "Firmado por: oficina, x", "Paciente - Ana Rojas", "nacido el 3 de mayo", "@vecino", "f nac. ayer noche", "Edad = 5", "x@y.org", "http://a"]
    for p in detect.PATTERNS:
        for t in texts:
            if p.needs and re.search(p.regex, t):
                assert re.search(p.needs, t), (p.kind, t)


def test_folding_keeps_length(spark):
    from velum.operators import detect

    rows = detect.detect(spark.createDataFrame([(1, 0, "İİİİ ciudad de Cali y un docente"), (2, 0, "vive en Calle # A bis, Cali")], "doc_id int, unit_seq int, text string")).collect()
    assert {(r.doc_id, r.type, r.text) for r in rows} >= {(1, "localidad", "Cali"), (1, "posible_ocupacion", "docente"), (2, "direccion", "Calle # A bis")}


def test_initial_risk_counts_all_types(spark):
    from velum import queries

    text = "; ".join(f"correo a{i}@b.org, Tel: 601 555 12{i:02d}" for i in range(7))
    units = spark.createDataFrame([(1, 0, text), (2, 0, "sin nada"), (3, 0, "Tel: 601 555 1234")], "doc_id int, unit_seq int, text string")
    got = {r.risk: r.n for r in queries._risk(units.select("doc_id"), units).collect()}
    assert got == {"ALTO": 1, "BAJO": 1, "MODERADO": 1}


def test_automaton_equals_patterns():
    """The automaton and what it spares, against every pattern on every text."""
    import random
    import re

    import pyarrow.parquet as pq

    from velum.functions import lexicons as L
    from velum.functions.spans import _FOLD, Matcher
    from velum.operators import clinical

    patterns = [*detect.PATTERNS, *clinical.VALUES]
    compiled = [(p, re.compile(p.regex)) for p in patterns]
    matcher = Matcher(patterns)

    def brute(t):
        folded = t.translate(_FOLD).lower()
        for p, regex in compiled:
            for m in regex.finditer(folded if p.folded else t):
                start, end, (low, high) = m.start(), m.end(), m.span(m.lastindex or 0)
                yield p.kind, p.order, start, end, t[start:end], low, t[low:high], list(m.groups()), t[max(0, start - 32) : start], t[end : end + 28]

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
    r = random.Random(1)
    terms = [*L.SECTORS, *L.REGIONS, *L.DEPARTMENTS, *L.INSURERS, *L.CLINICAL, *L.NEGATIONS, *L.ANALYTES, *detect.NAME_LABELS, *detect.VALUE_LABELS, *L.MONTHS, *L.INSTITUTIONS]
    terms += ["dr.", "Juan", "Perez", "2020", "12 anos", "años", "12,5 mg", "120/80", "30%", "c.c.", "tel", "calle 5", "registro", "r. m.", "fecha de nacimiento", "ſr", "oficıo", "KG 5", "labora como", "Km 5", "CP 12345", "3 de", "İps"]
    seps = [" ", "", ": ", ", ", "\n", "-", "x", "5", "á", "ſ", " de "]
    for _ in range(3000):
        chosen = r.choices(terms, k=r.choice([1, 2, 4, 9]))
        texts.append("".join((w.upper() if r.random() < 0.15 else w.title() if r.random() < 0.3 else w) + r.choice(seps) for w in chosen))
    assert any(True for t in texts for _ in matcher.matches(t))
    for t in texts:
        assert list(matcher.matches(t)) == list(brute(t)), t
