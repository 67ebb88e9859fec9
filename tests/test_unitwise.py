"""Findings and values made text by text, against column expressions and plain searches."""

import random
import re

from pyspark.sql import functions as F

from velum.functions.spans import _FOLD, _ODD_CASE, Matcher, scan
from velum.functions.text import canonical_number
from velum.operators import clinical, detect, unitwise
from velum.plans import pipeline

UNIT = "doc_id long, unit_seq int, layer string, path string, editable boolean, text string, prev_label string"
PIECES = (
    "c.c. |C.C|cc|t.i.|c e|n.i.t|h c|h.\tc.|CÉDULA|cédula|Dr. |dra |ü|é|ſ|ı|K|12|3.5| |\n|\t|mg|g/dl|kg/m2|10^3/ul|%|x|×|/|120|80|TA |presión|@|ana@x.org|@ana|10.0.0.1|300 123 4567|+57|años|anos|edad:|Edad = |"
    "F. Nac. |nacimiento|enero|de|2020|12/03/2020|1-2-20|calle |Calle 45 #|km |r.m. |m p |firma|registro médico|tarjeta profesional no. |Juan Perez|Ana|de la|García|Hospital San|clínica Ñ|eps sura|Nueva EPS|paciente:|"
    "ocupación: |docente|institución:|ips=|hemoglobina|Hemoglobina: |pa |cada 12 h|comprimidos|μg|500|1.000|a|z|_|-|.|,|;|(|)|cp 12345|zip|tel: |fax|orden #|HIST. CLIN|historia  clinica|expediente|ABC123|9|"
    "hace 8 anos|40 años|de seguimiento|\xa0|\x1c|́|²|Ⓐ|10 x 20 cm|1.50 mg cada 8 h|ta 120/80|‍|0,50 g|007.50 %|٣ mg|٣٤ anos|Losartan|izquierdo|responsable: turno|cargo: jefe  |Bogotá |Santa Marta"
).split("|")


def texts(n: int, seed: int = 3) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) + rnd.choice(["", "", " ", "  "]) for _ in range(rnd.randint(1, 30))) for _ in range(n)]


def by_columns(units):
    """The findings by column expressions over matches that meet by unit in a shuffle."""
    found = clinical.vital(scan(units, [*detect.PATTERNS, *clinical.GUARDS, detect.CELL], [*pipeline.UNIT, "prev_label"]))
    found = detect.add_finding(found, "prev_label").withColumn("p", clinical.guard())
    whole = found.groupBy(*pipeline.UNIT).agg(F.collect_list(detect.candidate()).alias("c"), F.array_sort(F.collect_list("p")).alias("protected")).where(F.size("c") > 0)
    one = whole.select(*pipeline.UNIT, "protected", F.posexplode(detect.resolve(detect.without_ruled_out(F.col("c")))).alias("ord", "h"))
    return one.select(*pipeline.UNIT, clinical.clash(F.col("h.start"), F.col("h.end"), F.col("protected")).alias("guard"), "ord", "h.*")


def test_findings_equal_column_expressions(spark):
    labels = (None, "Ciudad :", "EPS", "Nota", "edad")
    units = spark.createDataFrame([(i, 0, "contenido", "", True, t, labels[i % 5]) for i, t in enumerate(texts(600))], UNIT)
    want, got = by_columns(units), pipeline.annotate(units)
    assert got.columns == want.columns
    rows = sorted(map(repr, got.collect()))
    assert len(rows) > 1000 and rows == sorted(map(repr, want.collect()))


def test_findings_need_no_shuffle_by_unit(spark):
    """Matches of 9 million notes were shuffled by unit, and met in interpreted expressions there."""
    units = spark.createDataFrame([(1, 0, "contenido", "", True, "Paciente: Ana Rojas", "")], UNIT)
    for df in (pipeline.annotate(units), detect.detect(units)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "hashpartitioning" not in plan


def test_starts_and_forms_change_no_match():
    """Patterns tried where their words begin, and without regard to case where there is none, find what a plain search finds."""
    for p in (*detect.PATTERNS, *clinical.VALUES):
        if p.edge:
            continue
        regex, matches = re.compile(p.regex), Matcher([p]).matches
        for t in texts(1500, 5):
            read = t.translate(_FOLD).lower() if p.folded else t
            assert [(m.start(), m.end(), list(m.groups())) for m in regex.finditer(read)] == [(m[2], m[3], m[7]) for m in matches(t)], (p.kind, t)
    assert _ODD_CASE.search("".join(PIECES))


def test_numbers_in_one_form(spark):
    shown = ["7", "007.50", "1,0", "0.1234567", "12.", "", "٣", "100000", "000", "0.000", "1.10"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(shown)], "i int, t string").select("t", canonical_number(F.col("t")).alias("n")).collect()
    assert [unitwise.canonical_number(r.t) for r in rows] == [r.n for r in rows]


def test_a_unit_of_many_findings_takes_linear_time():
    import time

    def seconds(n: int) -> float:
        began = time.perf_counter()
        assert len(unitwise.unit_findings(Matcher([*detect.PATTERNS, *clinical.GUARDS]).matches("p1@x.org, 50 mg; 12/03/2020; " * n), guarded=True)) == 2 * n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(20_000) < 40 * max(seconds(2_000), 0.02)


def test_audit_reads_the_matrix_once(spark):
    """The matrix, and with it the whole run, was computed three times for one document."""
    from velum.operators import audit
    from velum.plans import notes

    units = notes.notes(spark, "/root/testdata/sf0.001").limit(20)
    results = units.select("doc_id", F.lit("BAJO").alias("risk"), F.lit("x").alias("state"))
    made = audit.documents_json(results, pipeline.process(units).matrix)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert made.count() == 20


def test_decisions_meet_by_document_once(spark):
    """Each window of the policy dealt the findings out by keys of its own."""
    from velum.operators import policy

    units = spark.createDataFrame([(1, 0, "contenido", "", True, "Paciente: Ana Rojas", "")], UNIT)
    plan = policy.decide(pipeline.annotate(units))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sql_of_redacted_documents_knows_identity_and_mobile_numbers(spark):
    """Larger tables hold what the smallest do not: identity numbers behind short labels, and mobile numbers."""
    import hashlib

    import duckdb

    from velum import oracles

    texts = [
        'token = "ce0cc631f6559e745b37cb8be6fc63ae2d235c5f" y', "password=ccd4805e8e134ac6e0 fin", "nt ti 4602651151338161 esedha +1 (226) 555-1404", "llama 3392164164 3132186228 hoy", "al +57 315 123 4567.",
        "cédula n.º 1.094.556.231; Ana@x.org", "señcc 123456 no", "de 70.23.22.57 a", "", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mine = {r.doc_id: r.new_text for r in pipeline.process(pipeline.units_of(docs)).units.collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    rows = con.execute(oracles.SQL["redact_documents"]).fetchall()
    assert {r[0]: r[1] for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in mine.items()}
    assert "[DOCUMENTO ELIMINADO]" in mine[0] and mine[3] == "llama [TELEFONO ELIMINADO] [TELEFONO ELIMINADO] hoy" and mine[6] == texts[6]
