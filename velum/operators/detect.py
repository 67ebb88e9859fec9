"""Detectors of identifiers: units of text -> findings.

Patterns are matched text by text; what a match means (what a label's value is, whether it may be a
name, and which matches others rule out) is said by `unitwise` within the same task, and here once more as
column expressions over the matches of `scan`, against which tests hold it. A finding
has offsets in code points, and a scope: the match with its label, which decides overlaps.
Order matters and is kept in `ord`: direct patterns, labelled values, the cell to the left,
labelled names, titles, capitalised runs; then the indirect ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions import lexicons as L
from velum.functions.spans import Pattern, overlaps
from velum.functions.text import FOLD_FROM, FOLD_TO, fold, let

FINDING = "struct<type:string,category:string,start:int,end:int,text:string,scope_start:int,scope_end:int,confidence:string,detector:string,note:string>"
FINDINGS = f"array<{FINDING}>"

# The patterns of direct identifiers (type, pattern, confidence); where
# there is a group it is the value, and it ends the match.
_NUMBER = r"\s*(?:(?:n[oº°]|nro|num(?:ero)?)\.?\s*)?[:#\-]?\s*"
_CODE = r"([A-Z0-9][A-Z0-9.\-]{3,20}\d)"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
DIRECT = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "alta"),
    ("url", r"(?i)\bhttps?://[^\s<>\"')]+", "alta"),
    ("usuario_red", r"(?<![\w@.])@[A-Za-z][A-Za-z0-9._]{2,30}\b", "media"),
    ("ip", rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d.])", "alta"),
    ("documento_identidad", r"(?i)\b(?:c\.?\s?c\.?|t\.?\s?i\.?|c\.?\s?e\.?|n\.?\s?i\.?t\.?|dni|nie|rut|curp|pasaporte|cedula|c[ée]dula|identificaci[oó]n|documento)" + _NUMBER + _CODE, "alta"),
    ("historia_clinica", r"(?i)\b(?:h\.?\s?c\.?|historia\s+cl[ií]nica|hist\.?\s*cl[ií]n\.?|nhc|mrn|expediente|folio)" + _NUMBER + _CODE, "alta"),
    ("numero_administrativo", r"(?i)\b(?:orden|autorizaci[oó]n|factura|remisi[oó]n|solicitud|radicado|p[oó]liza|afiliado|carn[eé]|contrato|episodio|ingreso|cama|habitaci[oó]n)" + _NUMBER + r"([A-Z]{0,4}-?[\d][\d.\-/]{2,16})", "alta"),
    ("telefono_etiquetado", r"(?i)\b(?:tel[eé]fono|tel|cel|celular|m[oó]vil|movil|whatsapp|contacto|fax)\s*[:#-]?\s*(\+?[\d][\d\s().\-]{6,18}\d)", "alta"),
    ("telefono", r"(?<![\d.,/-])(?:\+\d{1,3}[\s.-]?)?3\d{2}[\s.-]?\d{3}[\s.-]?\d{4}(?![\d.,/-])", "media"),
    ("direccion", r"(?i)\b(?:calle|carrera|cra|kr|avenida|avda|diagonal|transversal|manzana|urbanizaci[oó]n|apartamento|apto|autopista|carretera|km|kil[oó]metro)\.?\s*(?=[\d#])[\w#\-\s.º°]{1,45}?(?=[,;\n]|\.\s|\s{2,}|\Z)", "media"),
    ("codigo_postal", r"(?i)\b(?:c[oó]digo\s+postal|cp|zip)\s*[:#-]?\s*(\d{4,6})\b", "alta"),
    ("firma_digital", r"(?i)\b(?:firmado\s+(?:digitalmente\s+)?por|firma\s+electr[oó]nica|suscrito\s+por)\s*[:#-]?\s*([^\n;|]{2,60})", "alta"),
    ("firma_digital", r"(?i)\b(?:registro(?:\s+(?:m[eé]dico|profesional))?|r\.?\s?m\.?|m\.?\s?p\.?|matr[ií]cula\s+profesional|colegiado|tarjeta\s+profesional)\s*(?:n[oº°]\.?\s*)?[:#-]?\s*(?!m[eé]dico\b|profesional\b)([A-Z0-9][\w.\-/]{2,40})", "alta"),
]

# Labels before a name.
NAME_LABELS = L._terms("""
paciente, nombre del paciente, nombres y apellidos, nombre completo, nombres, nombre, apellidos, apellido,
acompanante, acompañante, responsable, acudiente, madre, padre, conyuge, cónyuge, esposo, esposa, hijo, hija,
hermano, hermana, familiar, contacto de emergencia, medico tratante, médico tratante, medico, médico,
profesional, elaborado por, realizado por, informado por, revisado por, solicitado por, remitido por,
atendido por, enfermera, enfermero, auxiliar, firma, titular, beneficiario, usuario, autor
""")

# Labels whose value identifies, by type.
VALUE_LABELS = L._table("""
empleador: empleador, empresa, patrono, lugar de trabajo
institucion: institucion, institución, entidad, sede, ips
aseguradora: eps, asegurador, aseguradora, seguro, plan
localidad: municipio, ciudad, localidad, barrio, vereda, corregimiento, departamento, residencia, lugar de nacimiento, procedencia
ocupacion: ocupacion, ocupación, profesion, profesión, oficio, cargo
edad: edad
""")

# Words that label a form's next field, not an institution's name.
FIELD_LABELS = L._terms("""
correo, email, telefono, tel, celular, fecha, hora, orden, documento, cedula, historia, paciente, edad, sexo,
ocupacion, direccion, municipio, ciudad, sede, asegurador, aseguradora, poliza, afiliado, resultado, referencia,
observaciones, nombre, apellidos, servicio, medico, profesional, registro, firma
""")


_VALUE_LABEL = r"(?i)(?<![a-záéíóúñ])(" + L.alternation(VALUE_LABELS) + r")\s*[:=]\s*([^\n\t|;]{2,60})"
_NAME_LABEL = r"(?i)(?<![a-z])(" + L.alternation(NAME_LABELS) + r")\s*[:\-]\s*([^\n\t|;]{2,70})"
_TITLE = r"\b(?i:dr|dra|doctor|doctora|sr|sra|srta|lic|prof|enf)\.?\s+((?:[A-ZÁ-Ú][a-zá-ú]+(?:\s+(?:de|del|la|los)\s+)?\s*){1,4})"
_CAPITALISED = r"\b[A-ZÁ-Ú][a-zá-ú]{2,}(?:\s+(?:de|del|la|las|los)\s+[A-ZÁ-Ú][a-zá-ú]{2,}|\s+[A-ZÁ-Ú][a-zá-ú]{2,}){1,3}\b"

_CUT = r"(?U)\s{2,}|\t|\||;|\(|\s-\s|,\s*(?=[A-ZÁ-Ú][a-zá-ú]+\s*:)"


# Ages, durations and dates.
_AGE = r"(?i)\d(?<![\d.,]\d)\d{0,2}+\s*(?:anos|años|a\.?\s*de\s*edad)(?![a-z])"
_AGE_LABEL = r"(?i)\bedad\s*[:=]\s*(\d{1,3}(?:\s*(?:anos|años))?)"
_MONTH = "|".join(L.MONTHS)
DATES = [
    r"\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b",
    r"\b\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}\b",
    rf"(?i)\b\d{{1,2}}\s+de\s+(?:{_MONTH})\s+(?:de[l]?\s+)?\d{{4}}\b",
    rf"(?i)\b(?:{_MONTH})\s+(?:de[l]?\s+)?\d{{4}}\b",
]
_BIRTH = r"(?i)\b(?:fecha\s+de\s+nacimiento|f\.?\s*nac\.?|nacid[oa]\s+el|nacimiento)\s*[:=-]?\s*([^\n\t|;]{4,30})"
_WORK_LABEL = r"(?i)\b(?:ocupaci[oó]n|profesi[oó]n|oficio|cargo|labora\s+como|trabaja\s+como|empleo)\s*[:=]?\s*([^\n\t|;.]{3,50})"
_WORK = r"(?<![a-z])(?:" + L.alternation(L.SECTORS) + r")(?![a-z])"
_INSURER = r"(?<![a-z])(?:eps|ips|arl|aseguradora|seguro)?\s*(" + L.alternation(L.INSURERS) + r")(?![a-z])"
_PLACE = r"(?<![a-z])(?:" + L.alternation({*L.REGIONS, *L.DEPARTMENTS}) + r")(?![a-z])"


# The letters that stand for one another with and without accents.
SPELLINGS = ("aáàäâã", "eéèëê", "iíìïî", "oóòöôõ", "uúùüû", "nñ", "cç")


def accent_free(phrase: str) -> str:
    """A pattern for a phrase of plain lower-case letters, however it is accented and cased."""
    same = {letters[0]: letters for letters in SPELLINGS}
    return re.sub("[a-z]", lambda m: f"[{(x := same.get(m[0], m[0]))}{x.upper()}]", phrase).replace(" ", r"[ \t]+")


_CAPITAL = r"(?:[A-ZÁ-Ú][\wÁ-ÿ]*|[A-ZÁ-Ú]{3,})"
_INSTITUTION = (
    r"(?<![a-zA-Z])(?:" + "|".join(accent_free(p) for p in sorted(L.INSTITUTIONS, key=len, reverse=True)) + r")\.?[ \t]"
    r"((?:(?i:de|del|la|las|los|san|santa|santo)[ \t])?" + _CAPITAL + r"(?:[ \t](?:(?i:de|del|la|las|los|y)[ \t])?" + _CAPITAL + r"){0,3})"
)



_BEFORE = r"(?iU)(hace|desde\s+hace|durante|hace\s+ya|ultimos|últimos|previos|evoluci[oó]n\s+de|seguimiento\s+de|tratamiento\s+de|diagnosticad[oa]\s+hace)\s*\z"
_AFTER = r"(?iU)^\s*(de\s+evoluci[oó]n|de\s+diagn[oó]stico|atr[aá]s|antes|previos|de\s+seguimiento|de\s+tratamiento)"


#: Words of which the folded text holds one wherever a pattern matches, by kind.
_WORDS = {"age": "anos edad", "birth": "nac"}
#: Words of which the folded text holds one wherever a match begins. Of short forms each dot may be there or not, and each white space.
_STARTS = {
    "numero_administrativo": "orden autorizacion factura remision solicitud radicado poliza afiliado carne contrato episodio ingreso cama habitacion",
    "telefono_etiquetado": "tel cel movil whatsapp contacto fax", "codigo_postal": "codigo cp zip", "title": "dr doctor sr lic prof enf", "age_label": "edad",
    "direccion": "calle carrera cra kr avenida avda diagonal transversal manzana urbanizacion apartamento apto autopista carretera km kilometro",
    "work_label": "ocupacion profesion oficio cargo labora trabaja empleo", "usuario_red": "@",
    "documento_identidad": "dni nie rut curp pasaporte cedula identificacion documento", "historia_clinica": "hist nhc mrn expediente folio",
    "firma_digital": "firma suscrito registro matricula colegiado tarjeta",
}
_SHORT = {"documento_identidad": "cc ti ce ni", "historia_clinica": "hc", "firma_digital": "rm mp"}
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]
_DATED = r"[/\-.]\d{1,2}[/\-.]\d"


def _starts(kind: str) -> tuple[str, ...]:
    short = [a + dot + space + b for a, b in _SHORT.get(kind, "").split() for dot in ("", ".") for space in ("", *_SPACES)]
    return (*_STARTS.get(kind, "").split(), *short)


def _plain(terms) -> tuple[str, ...]:
    """Terms as they stand in a folded text."""
    return tuple(dict.fromkeys(t.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO)) for t in terms))


def _patterns() -> list[Pattern]:
    needs = {"email": "@", "usuario_red": "@", "url": "://", "firma_digital": "", "direccion": r"[\d#]", "ip": r"\.\d{1,3}\.\d{1,3}\.\d", "telefono": r"3\d{2}[\s.-]?\d{3}[\s.-]?\d{4}"}
    words = {k: tuple(w.split()) for k, w in _WORDS.items()}
    out = [Pattern(kind, i, p, needs=needs.get(kind, r"\d"), starts=_starts(kind)) for i, (kind, p, _) in enumerate(DIRECT)]
    out += [Pattern("value_label", 20, _VALUE_LABEL, needs="[:=]", starts=_plain(VALUE_LABELS)), Pattern("name_label", 22, _NAME_LABEL, needs=r"[:\-]", starts=_plain(NAME_LABELS))]
    out += [Pattern("title", 23, _TITLE, starts=_starts("title")), Pattern("capitals", 24, _CAPITALISED)]
    out += [Pattern("age", 30, _AGE, needs=r"\d", words=words["age"]), Pattern("age_label", 31, _AGE_LABEL, needs="[:=]", starts=_starts("age_label")), Pattern("birth", 32, _BIRTH, words=words["birth"])]
    months = _plain(L.MONTHS)
    out += [Pattern("date", 33 + i, p, needs=r"\d" if i > 1 else _DATED, words=months if i == 2 else (), starts=months if i == 3 else ()) for i, p in enumerate(DATES)]
    out += [Pattern("work_label", 37, _WORK_LABEL, starts=_starts("work_label")), Pattern("work", 38, _WORK, folded=True, words=tuple(L.SECTORS), edge="[a-z]")]
    out += [Pattern("institution", 39, _INSTITUTION, starts=_plain(p.split()[0] for p in L.INSTITUTIONS))]
    places = tuple(dict.fromkeys((*L.REGIONS, *L.DEPARTMENTS)))
    return [*out, Pattern("insurer", 40, _INSURER, folded=True, words=tuple(L.INSURERS)), Pattern("place", 41, _PLACE, folded=True, words=places, edge="[a-z]")]


PATTERNS = _patterns()
#: The whole text of a cell without white space at its end.
CELL = Pattern("cell", 21, r"\A(?=[\s\S]*\S)[\s\S]*\S")
#: Kinds from these places in the order on are indirect identifiers, and none at all.
_INDIRECT, OTHERS = 30, 100


def among(term: Column, terms) -> Column:
    """Whether a term is one of a fixed list, as one look into one literal."""
    return (term != "") & F.lit("|" + "|".join(sorted(terms)) + "|").contains(F.concat(F.lit("|"), term, F.lit("|")))


def clean_value(value: Column) -> Column:
    """A label's value up to where the next field begins."""
    return F.rtrim(F.element_at(F.split(value, _CUT, 2), 1), F.lit(" .;,:-"))


def _bare(token: Column) -> Column:
    return fold(F.regexp_replace(token, r"(?U)[^\wÁ-ÿ]", ""))


def looks_clinical(value: Column) -> Column:
    return F.exists(F.split(F.coalesce(value, F.lit("")), r"(?U)\s+"), lambda t: among(_bare(t), L.CLINICAL))


def name_confidence(value: Column) -> Column:
    """alta, media or null: whether a value may be a person's name."""
    tokens = F.filter(F.split(value, r"(?U)\s+"), lambda t: t != "")

    def judged(tokens: Column) -> Column:
        useful = F.filter(tokens, lambda t: ~among(fold(t), L.PARTICLES))

        def sure(x: Column) -> Column:
            bad = F.exists(x, lambda t: (_bare(t) == "") | among(_bare(t), L.NOT_NAMES) | t.rlike(r"(?U)\d"))
            known = F.exists(x, lambda t: among(fold(t), (*L.GIVEN_NAMES, *L.SURNAMES)))
            many = F.size(x) >= 2
            return F.when((F.size(x) == 0) | bad, None).when(known & many, "alta").when(known | many, "media")

        return F.when(F.size(tokens) <= 6, let(useful, sure))

    return let(tokens, judged)


def label_type(label: Column) -> Column:
    """The type that a label's value has; null for other labels."""
    types = F.create_map(*(F.lit(x) for k, v in VALUE_LABELS.items() for x in (k, v)))
    return F.try_element_at(types, F.btrim(fold(label), F.lit(" :=.-")))


def _when(cases: dict[str, Column], otherwise=None) -> Column:
    out = otherwise
    for kind, value in cases.items():
        hit = F.col("kind").isin(*kind.split())
        out = F.when(hit, value) if out is None else F.when(hit, value).otherwise(out)
    return out


_MAYBE_WORK = "termino de ocupacion en texto libre: puede ser un adjetivo y no la ocupacion de una persona"
_BIRTH_NOTE = "fecha de nacimiento (cuasi-identificador fuerte)"


def add_finding(matches: DataFrame, label: str | None = None) -> DataFrame:
    """matches with h: the finding that a match is taken alone, null if it is none; and with
    rule: what else can rule it out (D: scopes of direct findings, A: ages, T: dates, I: all
    indirect findings before it)."""
    df = matches.withColumn("clean", _when({"value_label name_label title": clean_value(F.col("value")), "capitals cell": F.col("text")}, F.lit("")))
    df = df.withColumn("sure", _when({"name_label title capitals": name_confidence(F.col("clean"))}, F.lit(None).cast("string")))
    clean, sure, first = F.col("clean"), F.col("sure"), F.col("g")[0]
    left = F.col(label) if label else F.lit(None).cast("string")
    letters = clean.rlike("[A-Za-zÁ-ÿ]") & (F.length(clean) > 2)
    duration = F.col("before").rlike(_BEFORE) | F.left("after", F.lit(24)).rlike(_AFTER)
    years = F.regexp_extract("text", r"(?U)^(\d{1,3})", 1).try_cast("int")
    next_field = among(F.btrim(F.element_at(F.split(F.trim(fold(first)), r"(?U)\s+"), 1), F.lit(":.,")), FIELD_LABELS)
    doubtful = (F.col("kind") == "name_label") & sure.isNull()
    type_ = _when({
        "value_label": F.when((clean != "") & ~looks_clinical(clean), label_type(first)),
        "cell": F.when(~looks_clinical(clean), label_type(left)),
        "name_label": F.when(clean == "", None).when(sure.isNotNull(), "nombre_persona").when(letters, "campo_identificador_dudoso"),
        "title": F.when((clean != "") & sure.isNotNull(), "nombre_profesional"),
        "capitals": F.when(sure == "alta", "nombre_persona").when(sure.isNotNull(), "posible_nombre"),
        "age": F.when(~duration & (years <= 120), "edad"), "age_label": F.lit("edad"), "birth": F.lit("fecha_nacimiento"), "date": F.lit("fecha"),
        "work_label": F.lit("ocupacion"), "work": F.lit("posible_ocupacion"), "institution": F.when(~next_field, "institucion"),
        "insurer": F.lit("aseguradora"), "place": F.lit("localidad"),
    }, F.col("kind"))
    own = _when({"capitals cell age date work institution place": F.col("start")}, F.col("value_start"))
    stop = _when({
        "value_label name_label title": F.col("value_start") + F.length(clean),
        "work_label": F.col("value_start") + F.length(F.regexp_replace("value", r"(?U)^\s+|\s+\z", "")),
        "capitals cell age age_label date work institution place": F.col("end"),
    }, F.col("value_start") + F.length("value"))
    wide = (F.col("ord") < _INDIRECT) & ~doubtful & ~F.col("kind").isin("capitals", "cell")
    simple = {k: c for k, _, c in DIRECT}
    confidence = _when({
        **{" ".join(k for k, c in simple.items() if c == "media"): F.lit("media")},
        "name_label": F.when(doubtful, "baja").otherwise("alta"), "capitals": F.when(sure == "alta", "alta").otherwise("media"),
        "work": F.lit("baja"), "insurer place": F.lit("media"),
    }, F.lit("alta"))
    note = _when({
        "value_label": F.concat(F.lit("campo '"), fold(first), F.lit("'")), "cell": F.concat(F.lit("valor de la celda etiquetada '"), F.trim(fold(left)), F.lit("'")),
        "name_label": F.when(doubtful, F.concat(F.lit("etiqueta '"), fold(first), F.lit("' con valor no clasificable"))).otherwise(F.concat(F.lit("etiqueta: "), fold(first))),
        "title": F.lit("precedido por tratamiento"), "capitals": F.when(sure == "alta", "coincide con lexico de nombres/apellidos").otherwise("secuencia capitalizada sin respaldo en lexico"),
        "age_label": F.lit("campo edad"), "birth": F.lit(_BIRTH_NOTE), "work_label": F.lit("campo ocupacion"), "work": F.lit(_MAYBE_WORK),
    }, F.lit(""))
    df = df.withColumns({"_type": type_, "_from": own, "_to": stop})
    found = F.col("text").substr(F.col("_from") - F.col("start") + 1, F.col("_to") - F.col("_from"))
    direct = F.col("ord") < _INDIRECT
    h = F.struct(
        F.col("_type").alias("type"), F.when(direct, "directo").otherwise("indirecto").alias("category"), F.col("_from").alias("start"), F.col("_to").alias("end"), found.alias("text"),
        F.when(wide, F.col("start")).otherwise(F.col("_from")).alias("scope_start"),
        F.when(wide & F.col("kind").isin("value_label", "name_label", "title"), F.col("_to")).when(wide, F.col("end")).otherwise(F.col("_to")).alias("scope_end"),
        confidence.alias("confidence"), F.when(direct, "directos").otherwise("indirectos").alias("detector"), F.coalesce(note, F.lit("")).alias("note"),
    )
    rule = _when({"capitals": F.lit("D"), "age_label": F.lit("A"), "date": F.lit("T"), "work insurer place": F.lit("I")}, F.lit(""))
    usable = F.col("_type").isNotNull() & (F.col("ord") < OTHERS) & (F.col("_to") > F.col("_from"))
    return df.withColumns({"h": F.when(usable, h), "rule": rule}).drop("clean", "sure", "_type", "_from", "_to")


CANDIDATE = f"struct<ord:int,start:int,end:int,rule:string,h:{FINDING}>"


def candidate() -> Column:
    """What the aggregation of a unit's findings collects; null where there is no finding."""
    return F.when(F.col("h").isNotNull(), F.struct("ord", "start", "end", "rule", "h"))


def without_ruled_out(candidates: Column) -> Column:
    """The findings, in order, that none before them rules out."""

    def step(acc: Column, c: Column) -> Column:
        def blocks(a: Column) -> Column:
            h = a["h"]
            spans = overlaps(c["start"], c["end"], h["start"], h["end"])
            indirect = h["category"] == "indirecto"
            return (
                F.when(c["rule"] == "D", (h["category"] == "directo") & (a["rule"] != "D") & overlaps(c["start"], c["end"], h["scope_start"], h["scope_end"]))
                .when(c["rule"] == "A", indirect & (h["type"] == "edad") & (h["start"] <= c["h"]["start"]) & (c["h"]["start"] < h["end"]))
                .when(c["rule"] == "T", indirect & h["type"].isin("fecha", "fecha_nacimiento") & spans)
                .when(c["rule"] == "I", indirect & spans)
                .otherwise(False)
            )

        return F.when(F.exists(acc, blocks), acc).otherwise(F.concat(acc, F.array(c)))

    kept = F.aggregate(F.array_sort(candidates), F.array().cast(f"array<{CANDIDATE}>"), step)
    return F.transform(kept, lambda c: c["h"])


# Which kind wins where scopes overlap; lower wins.
PRIORITY = {
    "email": 5, "url": 5, "ip": 5, "usuario_red": 12, "documento_identidad": 5, "historia_clinica": 5,
    "numero_administrativo": 6, "telefono_etiquetado": 5, "telefono": 8, "direccion": 9, "codigo_postal": 9,
    "firma_digital": 6, "nombre_persona": 10, "nombre_profesional": 10, "fecha_nacimiento": 11, "institucion": 14,
    "aseguradora": 16, "fecha": 18, "ocupacion": 20, "localidad": 22, "edad": 24, "empleador": 13,
    "posible_nombre": 40, "campo_identificador_dudoso": 45, "posible_ocupacion": 42,
}
OTHER_PRIORITY = 50


def resolve(findings: Column) -> Column:
    """One finding for each region: by priority, length, then place, greedily by scope."""
    ranks = F.create_map(*(F.lit(x) for k, v in PRIORITY.items() for x in (k, v)))
    ranked = F.array_sort(F.transform(findings, lambda h, i: F.struct(
        F.coalesce(F.try_element_at(ranks, h["type"]), F.lit(OTHER_PRIORITY)).alias("rank"), (h["start"] - h["end"]).alias("shorter"), h["start"].alias("start"), i.alias("ord"), h.alias("h"),
    )))

    def accept(acc: Column, r: Column) -> Column:
        h = r["h"]
        taken = F.exists(acc, lambda a: overlaps(h["scope_start"], h["scope_end"], a["scope_start"], a["scope_end"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(h)))

    accepted = F.aggregate(ranked, F.array().cast(FINDINGS), accept)
    by_place = F.array_sort(F.transform(accepted, lambda h, i: F.struct(h["start"].alias("start"), i.alias("i"), h.alias("h"))))
    return F.transform(by_place, lambda x: x["h"])



def detect(units: DataFrame, text: str = "text", previous_label: str | None = None, only: tuple[str, ...] = ()) -> DataFrame:
    """The findings of units (doc_id, unit_seq, text), one row each, resolved: overlapping
    scopes leave one finding. Null text has none.

    previous_label: a column with the text of the cell to the left; only: the columns besides
    doc_id and unit_seq that are wanted.
    """
    from velum.operators import unitwise

    return unitwise.findings(units, ["doc_id", "unit_seq"], text, previous_label, only=only)
