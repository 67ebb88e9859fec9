"""Sentences with one identifier each, made from the keys of orders, as SQL that Spark and
others read alike. They reach the detectors that neither the driver's texts nor the notes do."""

from __future__ import annotations

from dataclasses import dataclass

from velum.operators.policy import PURPOSES, REASONS
from velum.operators.verify import WEIGHTS

K = "o_orderkey"


def number(width: int, more: int = 0) -> str:
    """The key as so many figures."""
    return f"lpad(CAST(({K} + {more}) % {10**width} AS STRING), {width}, '0')"


_TWO = f"CAST({K} % 90 + 10 AS STRING)"
_AGE = f"CAST({K} % 90 + 10 AS STRING)"
_GIVEN = f"split_part('Juan,Ana,Carlos,Laura,Pedro,Rosa', ',', CAST({K} % 6 + 1 AS INT))"
_FAMILY = f"split_part('Perez,Garcia,Torres,Rojas,Medina', ',', CAST({K} % 5 + 1 AS INT))"


@dataclass(frozen=True)
class Sample:
    """before, value and after make the sentence; type: what the value is found as ('': not at all)."""

    type: str
    before: str
    value: str
    after: str = "'.'"
    confidence: str = "alta"


DIRECT = [
    Sample("usuario_red", "'Escribe como '", f"'@vecino' || {number(5)}", "' en la red'", "media"),
    Sample("documento_identidad", "'Pasaporte No. '", f"'AB' || {number(6)}", "' vigente'"),
    Sample("documento_identidad", "'c.c. '", f"'10' || {number(8)}", "' de Narnia'"),
    Sample("historia_clinica", "'Historia clinica: '", f"'HC-' || {number(6)}", "' abierta'"),
    Sample("historia_clinica", "'mrn # '", f"'77' || {number(6)}", "', copia'"),
    Sample("numero_administrativo", "'Factura No. '", f"'FV-' || {number(6)}", "' pagada'"),
    Sample("numero_administrativo", "'autorizacion: '", f"'55' || {number(7)}", "' pendiente'"),
    Sample("telefono_etiquetado", "'Tel: '", f"'601 ' || {number(7)}", "', de noche'"),
    Sample("telefono", "'llamar al '", f"'310 ' || {number(3)} || ' ' || {number(4)}", "' por la tarde'", "media"),
    Sample("telefono", "'llamar al '", f"'+57 315' || {number(7)}", "' por la tarde'", "media"),
    Sample("direccion", "'vive en '", f"'Calle ' || {_TWO} || ' # 4-' || {_TWO}", "', segundo piso'", "media"),
    Sample("direccion", "'vive en '", "'Calle # A bis'", "', al fondo'", "media"),
    Sample("direccion", "'vive en '", f"'carrera ' || {_TWO}", "chr(10) || 'sin ascensor'", "media"),
    Sample("codigo_postal", "'codigo postal: '", f"'7' || {number(5)}", "', sur'"),
    Sample("firma_digital", "'Firmado digitalmente por: '", f"'oficina ' || {_TWO}", "'; copia'"),
    Sample("firma_digital", "'matricula profesional: '", f"'MP' || {number(5)}", "', activa'"),
    Sample("", "'sin nada que borrar '", "'aqui'"),
]
NAMES = [
    Sample("nombre_persona", "'Paciente: '", f"{_GIVEN} || ' ' || {_FAMILY}", "chr(10) || 'estable'"),
    Sample("nombre_persona", "'acudiente - '", f"{_GIVEN} || ' ' || {_FAMILY}", "'; llega tarde'"),
    Sample("campo_identificador_dudoso", "'Responsable: '", "'turno'", "chr(10) || 'estable'", "baja"),
    Sample("nombre_profesional", "'valora la dra. '", f"{_GIVEN} || ' ' || {_FAMILY}", "', estable'"),
    Sample("nombre_persona", "'asiste con '", f"{_GIVEN} || ' ' || {_FAMILY}", "' a la cita'"),
    Sample("posible_nombre", "'asiste con '", "'Zenon Quirarte'", "' a la cita'", "media"),
    Sample("nombre_persona", "'asiste con '", f"{_GIVEN} || ' de Quirarte'", "' a la cita'"),
    Sample("empleador", "'empresa: '", f"'taller ' || {_TWO}", "'; estable'"),
    Sample("institucion", "'sede: '", f"'torre ' || {_TWO}", "' | estable'"),
    Sample("aseguradora", "'eps: '", f"'plan ' || {_TWO}", "'; estable'"),
    Sample("", "'ciudad: '", "'fractura de cadera'", "'; estable'"),
]
INDIRECT = [
    Sample("edad", "'tiene '", f"{_AGE} || ' años'", "' cumplidos'"),
    Sample("edad", "'Edad = '", f"{_AGE}", "'; estable'"),
    Sample("", "'en control hace '", f"{_AGE} || ' años'", "' cumplidos'"),
    Sample("fecha_nacimiento", "'nacido el '", f"'03/04/19' || {_TWO}", "'; estable'"),
    Sample("fecha", "'control el '", f"'20' || {_TWO} || '-05-06'", "' por la tarde'"),
    Sample("fecha", "'control el '", f"'12 de marzo de 20' || {_TWO}", "' por la tarde'"),
    Sample("fecha", "'control en '", f"'abril del 20' || {_TWO}", "' por la tarde'"),
    Sample("ocupacion", "'trabaja como '", f"'operario ' || {_TWO}", "'; estable'"),
    Sample("posible_ocupacion", "'antes fue '", "'minero'", "' en el norte'", "baja"),
    Sample("institucion", "'remitido del '", "'Hospital San Zenon'", "', estable'"),
    Sample("aseguradora", "'afiliado a '", "'sura'", "' desde ayer'", "media"),
    Sample("localidad", "'viene de '", "'Medellin'", "' en bus'", "media"),
]
FAMILIES = {"direct_samples": DIRECT, "name_samples": NAMES, "indirect_samples": INDIRECT}


def text(samples: list[Sample]) -> str:
    """Each order's sentence."""
    cases = " ".join(f"WHEN {i} THEN {s.before} || {s.value} || {s.after}" for i, s in enumerate(samples))
    return f"CASE CAST({K} % {len(samples)} AS INT) {cases} END"


def _one_of(words: tuple[str, ...]) -> str:
    return f"split_part('{','.join(words)}', ',', CAST({K} % {len(words)} + 1 AS INT))"


#: Fields of a file's metadata, and what they hold.
FIELD = _one_of(("Author", "Title", "Last Modified By", "TotalTime", "Pages", "Company", "dcterms:modified"))
FIELD_VALUE = "CASE WHEN o_orderkey % 9 = 0 THEN '' WHEN o_orderkey % 9 = 1 THEN repeat('Persona ' || CAST(o_custkey AS STRING) || ' ', 30) ELSE 'Persona ' || CAST(o_custkey AS STRING) END"
#: Types of findings for the policy, the layers that they stand in, and purposes.
KIND = _one_of((*REASONS, "tipo_desconocido"))
LAYER = "CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'comentario' WHEN 1 THEN 'nombre_archivo' ELSE 'contenido' END"
QUASI = _one_of(tuple(WEIGHTS))
PURPOSE = _one_of(tuple(PURPOSES))
CLINICAL = [
    Sample("signo_vital", "'tension arterial '", f"CAST({K} % 90 + 90 AS STRING) || '/' || CAST({K} % 40 + 50 AS STRING)", "' hoy'"),
    Sample("", "'fila '", f"CAST({K} % 90 + 90 AS STRING) || '/' || CAST({K} % 40 + 50 AS STRING)", "' hoy'"),
    Sample("medida", "'nodulo de '", f"CAST({K} % 9 + 1 AS STRING) || ' x ' || CAST({K} % 7 + 1 AS STRING) || ' cm'", "' estable'"),
    Sample("porcentaje", "'saturacion del '", f"CAST({K} % 30 + 70 AS STRING) || ' %'", "' hoy'"),
]


#: Dates by keys: a day and month in words, and one that begins with the year.
LONG_DATE = "CAST(o_orderkey % 28 + 1 AS STRING) || ' de ' || split_part('enero,mayo,octubre', ',', CAST(o_orderkey % 3 + 1 AS INT)) || CASE WHEN o_orderkey % 2 = 0 THEN ' del ' ELSE ' de ' END || CAST(1990 + o_orderkey % 30 AS STRING)"
ISO_DATE = "CAST(1990 + o_orderkey % 30 AS STRING) || '-' || CAST(o_orderkey % 12 + 1 AS STRING) || '-' || CAST(o_orderkey % 28 + 1 AS STRING)"

#: Beginnings of file names, told apart by a key; none holds a comma.
FILE_NAMES = "Informe nº 7 año,oﬃcio ﬁnal,Ｎｏｔａ１２,x²½,Ørsted Łódź,报告,.., .oculto,a\u0301e\u0308," + "m" * 100
