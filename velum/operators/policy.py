"""What happens to each finding, for a purpose: remove, replace, generalise, keep or mark.

Works on findings (doc_id, unit_seq, layer, path, editable, protected, ord, type, start, end, text,
note, ...). What depends
on the whole document (pseudonyms, relative days) is a window over doc_id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.functions import lexicons as L
from velum.functions.text import age_band, clip, mask, normalise, parse_date, salted_hash
from velum.operators.clinical import clash


@dataclass(frozen=True)
class Purpose:
    """What a purpose makes coarser."""

    key: str
    age: bool = True
    dates: bool = True
    place: bool = True
    work: bool = True
    institution: bool = True


PURPOSES = {p.key: p for p in (
    Purpose("educacion"), Purpose("publicacion"), Purpose("interconsulta", age=False, dates=False),
    Purpose("docencia_sintetica"), Purpose("investigacion"),
)}

# Types that always go, with their markers.
REMOVED = {
    "email": "[CORREO ELIMINADO]", "url": "[ENLACE ELIMINADO]", "ip": "[IP ELIMINADA]", "usuario_red": "[USUARIO ELIMINADO]",
    "documento_identidad": "[DOCUMENTO ELIMINADO]", "historia_clinica": "[HISTORIA CLINICA ELIMINADA]",
    "numero_administrativo": "[IDENTIFICADOR ADMINISTRATIVO ELIMINADO]", "telefono_etiquetado": "[TELEFONO ELIMINADO]",
    "telefono": "[TELEFONO ELIMINADO]", "direccion": "[DIRECCION ELIMINADA]", "codigo_postal": "[CODIGO POSTAL ELIMINADO]",
    "firma_digital": "[FIRMA ELIMINADA]", "fecha_nacimiento": "[FECHA DE NACIMIENTO ELIMINADA]",
}

# Why, by type.
REASONS = {
    "email": "identificador directo", "url": "identificador directo / posible rastro externo", "ip": "identificador tecnico directo",
    "usuario_red": "identificador directo en redes", "documento_identidad": "identificador directo",
    "historia_clinica": "identificador administrativo directo", "numero_administrativo": "identificador administrativo",
    "telefono_etiquetado": "identificador directo", "telefono": "identificador directo",
    "direccion": "identificador directo de localizacion", "codigo_postal": "identificador de localizacion",
    "firma_digital": "identificador directo del profesional", "fecha_nacimiento": "cuasi-identificador fuerte",
    "nombre_persona": "identificador directo", "nombre_profesional": "identificador directo del profesional",
    "edad": "minimizacion para la finalidad indicada", "fecha": "minimizacion: se conserva la cronologia relativa",
    "ocupacion": "minimizacion: se conserva el sector", "institucion": "identificador indirecto de contexto",
    "aseguradora": "identificador indirecto administrativo", "empleador": "identificador indirecto: el empleador singulariza",
    "localidad": "minimizacion: se conserva la region", "posible_nombre": "candidato incierto: requiere criterio humano",
    "posible_ocupacion": "puede ser un adjetivo y no la ocupacion de una persona",
    "campo_identificador_dudoso": "campo etiquetado no clasificable",
}

DOUBTFUL = ("posible_nombre", "campo_identificador_dudoso", "posible_ocupacion")
BLOCKED = "bloqueada_por_integridad_clinica"
CHANGES = ("eliminar", "sustituir", "generalizar")
RISK = {"eliminar": "bajo", "sustituir": "bajo", "generalizar": "bajo", "preservar": "moderado", "marcar_para_revision": "moderado", BLOCKED: "moderado"}


def _map(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v)))


def pseudonyms(findings: DataFrame, aggressive: bool = False) -> DataFrame:
    """findings with pseudonym: one label for a value within a document, numbered by first
    appearance; the first person is the patient if its label says so."""
    person = ["nombre_persona", *(DOUBTFUL if aggressive else ())]
    prefix = F.when(F.col("type").isin(*person), "PERSONA").when(F.col("type") == "nombre_profesional", "PROFESIONAL")
    place = F.struct("unit_seq", "start")
    df = findings.withColumns({"_prefix": prefix, "_key": normalise(F.col("text")), "_place": place})
    same = Window.partitionBy("doc_id", "_prefix", "_key")
    df = df.withColumn("_first", F.min("_place").over(same)).withColumn("_note", F.min_by(F.struct("note", "type"), "_place").over(same))
    df = df.withColumn("_n", F.dense_rank().over(Window.partitionBy("doc_id", "_prefix").orderBy("_first")))
    patient = (F.col("_n") == 1) & (F.col("_prefix") == "PERSONA") & F.col("_note.note").contains("paciente") & (F.col("_note.type") == "nombre_persona")
    label = F.when(patient, "[PACIENTE]").otherwise(F.concat(F.lit("["), "_prefix", F.lit(" "), F.col("_n").cast("string"), F.lit("]")))
    return df.withColumn("pseudonym", F.when(F.col("_prefix").isNotNull(), label)).drop("_prefix", "_key", "_place", "_first", "_note", "_n")


def relative_days(findings: DataFrame) -> DataFrame:
    """findings with date, grain and day: `Dia n`, the rank of a date in its document."""
    parsed = F.when(F.col("type") == "fecha", parse_date(F.col("text")))
    df = findings.withColumn("_d", parsed).withColumns({"date": F.col("_d.date"), "grain": F.col("_d.grain")}).drop("_d")
    dated = F.when(F.col("grain") == "dia", F.col("date"))
    rank = F.dense_rank().over(Window.partitionBy("doc_id", dated.isNull()).orderBy(dated))
    return df.withColumn("day", F.when(dated.isNotNull(), F.concat(F.lit("Dia "), rank.cast("string"))))


def _decision(p: Purpose, aggressive: bool) -> Column:
    """struct(action, result, reason, review)."""
    kind, text = F.col("type"), F.col("text")
    why = F.coalesce(F.try_element_at(_map(REASONS), kind), F.lit("identificador detectado"))

    def choice(action: str, result, reason=None, review: bool = False) -> Column:
        result = result if isinstance(result, Column) else F.lit(result)
        reason = why if reason is None else F.concat(why, F.lit(reason)) if reason.startswith(" ") else F.lit(reason)
        return F.struct(F.lit(action).alias("action"), result.alias("result"), reason.alias("reason"), F.lit(review).alias("review"))

    def mark(reason=None) -> Column:
        return choice("marcar_para_revision", text, reason, True)

    years = F.regexp_extract(text, r"(?U)(\d{1,3})", 1).try_cast("int")
    age = F.when(years.isNull(), mark()).otherwise(choice("generalizar", age_band(years)))
    date = (
        F.when(F.col("day").isNotNull(), choice("generalizar", F.col("day")))
        .when(F.col("grain") == "mes", choice("generalizar", "[MES/ANO ELIMINADO]", " (granularidad mes)"))
        .otherwise(mark("fecha no interpretable de forma segura"))
    )
    sector, region = F.try_element_at(_map(L.SECTORS), normalise(text)), F.try_element_at(_map(L.REGIONS), normalise(text))
    known_work = choice("generalizar", sector) if p.work else choice("preservar", text, "la finalidad conserva la ocupacion", True)
    work = F.when(sector.isNotNull(), known_work).otherwise(choice("sustituir", "[OCUPACION NO CLASIFICADA]", " (sin sector conocido)", True))
    place = F.when(region.isNotNull(), choice("generalizar", region)).otherwise(choice("sustituir", "[LOCALIDAD]", " (region desconocida)", True))
    doubt = choice("sustituir", F.col("pseudonym"), " (sustitucion agresiva activada por el usuario)", True) if aggressive else mark()
    return (
        F.when(kind.isin(*REMOVED), choice("eliminar", F.try_element_at(_map(REMOVED), kind)))
        .when(kind.isin("nombre_persona", "nombre_profesional"), choice("sustituir", F.col("pseudonym")))
        .when(kind == "edad", age if p.age else choice("preservar", text, "la finalidad requiere la edad exacta", True))
        .when(kind == "fecha", date if p.dates else choice("preservar", text, "la finalidad conserva la cronologia exacta", True))
        .when(kind == "ocupacion", work)
        .when(kind == "institucion", choice("sustituir", "institucion de salud") if p.institution else choice("preservar", text, "la finalidad conserva la institucion", True))
        .when(kind == "aseguradora", choice("sustituir", "[ASEGURADORA]"))
        .when(kind == "empleador", choice("sustituir", "[EMPLEADOR]"))
        .when(kind == "localidad", place if p.place else choice("preservar", text, "la finalidad conserva el lugar", True))
        .when(kind.isin(*DOUBTFUL), doubt)
        .otherwise(mark("tipo no cubierto por la politica"))
    )


def decide(findings: DataFrame, purpose: str = "educacion", aggressive: bool = False, dropped_layers: tuple[str, ...] = ()) -> DataFrame:
    """findings with action, result, reason, review, integrity and applied.

    A change that would touch protected clinical content is blocked, but has used its
    pseudonym (findings have guard, its reason, or protected, the spans). In layers that cannot be rewritten a change is a mark, or the layer goes.
    """
    return decide_for(findings, (purpose,), aggressive, dropped_layers).drop("purpose")


def decide_for(findings: DataFrame, purposes: tuple[str, ...] = tuple(PURPOSES), aggressive: bool = False, dropped_layers: tuple[str, ...] = ()) -> DataFrame:
    """As decide, for several purposes: each finding once for each, with a column purpose."""
    # a document's findings meet once, for all windows; else each window deals them out anew by keys of its own
    df = relative_days(pseudonyms(findings.repartition("doc_id"), aggressive))
    for_each = F.explode(F.array(*(F.struct(F.lit(p).alias("purpose"), _decision(PURPOSES[p], aggressive).alias("c")) for p in purposes)))
    df = df.withColumn("_p", for_each).withColumns({"purpose": F.col("_p.purpose"), "_c": F.col("_p.c")}).drop("_p")
    changes = F.col("_c.action").isin(*CHANGES)
    guard = F.col("guard") if "guard" in findings.columns else clash(F.col("start"), F.col("end"), F.col("protected"))
    df = df.withColumn("_clash", F.when(changes, guard))
    free, dropped = F.col("_clash").isNull(), F.col("layer").isin(*dropped_layers) if dropped_layers else F.lit(False)
    rewritten = changes & free & F.col("editable")
    gone = changes & free & ~F.col("editable") & dropped
    only_marked = changes & free & ~F.col("editable") & ~dropped
    layer_gone = F.concat(F.lit("(la capa '"), "layer", F.lit("' no se copia al archivo reconstruido)"))
    blocked = F.concat(F.lit("la transformacion habria alterado informacion clinica ("), "_clash", F.lit(")"))
    df = df.withColumns({
        "action": F.when(changes & ~free, BLOCKED).when(gone, "eliminar").when(only_marked, "marcar_para_revision").otherwise(F.col("_c.action")),
        "result": F.when(changes & ~free, F.col("text")).when(gone, layer_gone).otherwise(F.col("_c.result")),
        "reason": F.when(changes & ~free, blocked).when(gone, F.concat("_c.reason", F.lit(" (capa descartada por completo)")))
        .when(only_marked, F.concat("_c.reason", F.lit(" (capa no reescribible: solo se reporta)"))).otherwise(F.col("_c.reason")),
        "review": F.when((changes & ~free) | only_marked, True).when(gone, False).otherwise(F.col("_c.review")),
        "integrity": F.when(changes & ~free, "protegida: cambio bloqueado").when(changes, "preservada").otherwise("no aplica"),
        "applied": F.coalesce(rewritten, F.lit(False)),
    })
    return df.drop("_c", "_clash", "guard")


def matrix(decided: DataFrame) -> DataFrame:
    """The transformation matrix: masked and hashed, never the identifier itself."""
    return decided.select(
        "doc_id", "unit_seq", "ord", "category", "type", "layer", mask(clip(F.col("text"), 60)).alias("finding_masked"), salted_hash(F.col("text")).alias("finding_hash"), "action",
        F.when(F.col("action") == "marcar_para_revision", "(sin cambios)").otherwise(F.col("result")).alias("result"),
        F.col("reason").alias("motive"), F.col("integrity").alias("clinical_integrity"),
        F.coalesce(F.try_element_at(_map(RISK), F.col("action")), F.lit("moderado")).alias("residual_risk"), "path", "confidence", F.col("review").alias("requires_review"),
    )


def apply(units: DataFrame, decided: DataFrame) -> DataFrame:
    """units with new_text: the applied results in place of the findings."""
    edits = decided.where("applied").groupBy("doc_id", "unit_seq").agg(F.array_sort(F.collect_list(F.struct("start", "end", "result"))).alias("_edits"))
    df = units.join(edits, ["doc_id", "unit_seq"], "left")
    text = F.coalesce("text", F.lit(""))
    start = F.struct(F.lit(0).cast("int").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        return F.struct(e["end"].alias("at"), F.concat(acc["out"], text.substr(acc["at"] + 1, e["start"] - acc["at"]), e["result"]).alias("out"))

    done = F.aggregate(F.coalesce("_edits", F.array().cast("array<struct<start:int,end:int,result:string>>")), start, step)
    df = df.withColumn("_done", done)
    return df.withColumn("new_text", F.concat("_done.out", text.substr(F.col("_done.at") + 1, F.length(text)))).drop("_done", "_edits")
