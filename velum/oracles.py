"""DuckDB SQL with the results of the queries, written from what they mean.

RE2 has no look-around, so patterns here take their borders along; results on notes follow
from the keys that the notes are made of.
"""

from __future__ import annotations

from velum.functions import lexicons as L
from velum.plans import notes as N
from velum.plans import samples as S

# Fixed values, written here once more, not taken from the code that the SQL judges, so that a wrong one there shows.
FOLD_FROM = "áàäâãéèëêíìïîóòöôõúùüûñçÁÀÄÂÃÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇİ"
FOLD_TO = "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNCi"
SALT = "velum-local-v1"
NOTICE = "VERSION MINIMIZADA SUJETA A REVISION Y APROBACION HUMANA."
NOTICES = {"docencia_sintetica": "DOCUMENTO CLINICO SINTETICO. VERSION MINIMIZADA SUJETA A REVISION Y APROBACION HUMANA."}
SENSITIVE = """
author last_modified_by lastmodifiedby creator producer company manager title subject keywords comments category description owner username user
revision content_status identifier language version customer
""".split()
NEUTRAL_VALUES = ["", "documento desidentificado", "libro desidentificado", "pdf", "docx", "xlsx"]
TECHNICAL = """
format encryption trapped revision totaltime lastprinted pages words characters lines paragraphs application appversion template docsecurity scalecrop
linksuptodate sharedoc hyperlinkschanged contentstatus language version
""".split()
WEIGHTS = {
    "fecha_nacimiento": 3, "posible_nombre": 3, "edad": 2, "ocupacion": 2, "localidad": 2, "institucion": 2, "empleador": 2, "campo_identificador_dudoso": 2,
    "aseguradora": 1, "fecha": 1, "sexo": 1, "posible_ocupacion": 1,
}
MODERATE, HIGH = 4, 6
REMOVED = """
email url ip usuario_red documento_identidad historia_clinica numero_administrativo telefono_etiquetado telefono direccion codigo_postal firma_digital fecha_nacimiento
""".split()
REASONS = {
    "email": "identificador directo", "url": "identificador directo / posible rastro externo", "ip": "identificador tecnico directo", "usuario_red": "identificador directo en redes",
    "documento_identidad": "identificador directo", "historia_clinica": "identificador administrativo directo", "numero_administrativo": "identificador administrativo",
    "telefono_etiquetado": "identificador directo", "telefono": "identificador directo", "direccion": "identificador directo de localizacion", "codigo_postal": "identificador de localizacion",
    "firma_digital": "identificador directo del profesional", "fecha_nacimiento": "cuasi-identificador fuerte", "nombre_persona": "identificador directo", "nombre_profesional": "identificador directo del profesional",
    "edad": "minimizacion para la finalidad indicada", "fecha": "minimizacion: se conserva la cronologia relativa", "ocupacion": "minimizacion: se conserva el sector", "institucion": "identificador indirecto de contexto",
    "aseguradora": "identificador indirecto administrativo", "empleador": "identificador indirecto: el empleador singulariza", "localidad": "minimizacion: se conserva la region",
    "posible_nombre": "candidato incierto: requiere criterio humano", "posible_ocupacion": "puede ser un adjetivo y no la ocupacion de una persona", "campo_identificador_dudoso": "campo etiquetado no clasificable",
}

_FOLD = "lower(translate({}, '" + FOLD_FROM + "', '" + FOLD_TO + "'))"
_OCTET = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def fold(x: str) -> str:
    return _FOLD.format(x)


def normalise(x: str) -> str:
    return rf"trim(regexp_replace({fold(x)}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def salted_hash(x: str) -> str:
    return f"substr(sha256('{SALT}' || {normalise(x)}), 1, 16)"


def mask(x: str) -> str:
    return f"CASE WHEN length({x}) <= 2 THEN repeat('*', length({x})) WHEN length({x}) = 3 THEN substr({x}, 1, 1) || '**' ELSE substr({x}, 1, 2) || repeat('*', length({x}) - 3) || right({x}, 1) END"


def _spans(table: str, key: str, text: str, pattern: str, kept: str = "true") -> str:
    """Matches with offsets: the gaps and matches before one add up to its start."""
    return f"""
WITH m AS (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS m, regexp_split_to_array({text}, '{pattern}') AS g FROM {table} WHERE regexp_matches({text}, '{pattern}')),
e AS (SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i FROM m),
s AS (SELECT {key}, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INT) AS start, m[i] AS text FROM e)
SELECT {key}, start, CAST(start + length(text) AS INT) AS "end", text FROM s WHERE {kept}
"""


def _values(table: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in table.items())


K = "o_orderkey"
_AGE = f"({K} % 97 + 1)"
_BAND = f"CASE WHEN {_AGE} >= 90 THEN '90 anos o mas' ELSE CAST({_AGE} // 10 * 10 AS STRING) || '-' || CAST({_AGE} // 10 * 10 + 9 AS STRING) || ' anos' END"
_REGION = f"CASE {K} % 4 WHEN 0 THEN 'region pacifica (Colombia)' WHEN 1 THEN 'region andina (Colombia)' WHEN 2 THEN 'Peru' ELSE '[LOCALIDAD]' END"
_SECTOR = f"CASE {K} % 3 WHEN 0 THEN 'sector educacion' WHEN 1 THEN 'sector extractivo' ELSE '[OCUPACION NO CLASIFICADA]' END"
_STREET = "Calle 45 cm 2"
#: The number in its one form.
_X = f"CASE WHEN {K} % 10 = 0 THEN CAST(8 + {K} % 7 AS STRING) ELSE CAST(8 + {K} % 7 AS STRING) || '.' || CAST({K} % 10 AS STRING) END"
_Y = _X.replace("8 +", "9 +")

# (type, category, text, action, result, review, when) of the findings of a note
_FOUND = [
    ("nombre_persona", N.NAME, "sustituir", "'[PACIENTE]'", "false", "true"),
    ("documento_identidad", N.IDENTITY, "eliminar", "'[DOCUMENTO ELIMINADO]'", "false", "true"),
    ("edad", f"{N.AGE} || ' anos'", "generalizar", _BAND, "false", "true"),
    ("fecha", N.DATE, "generalizar", "'Dia 1'", "false", "true"),
    ("localidad", N.CITY, f"CASE WHEN {K} % 4 = 3 THEN 'sustituir' ELSE 'generalizar' END", _REGION, f"{K} % 4 = 3", "true"),
    ("ocupacion", N.WORK, f"CASE WHEN {K} % 3 = 2 THEN 'sustituir' ELSE 'generalizar' END", _SECTOR, f"{K} % 3 = 2", "true"),
    ("email", N.MAIL, "eliminar", "'[CORREO ELIMINADO]'", "false", "true"),
    ("direccion", f"'{_STREET}'", "bloqueada_por_integridad_clinica", f"'{_STREET}'", "true", f"{K} % 5 = 0"),
]


def _action(a: str) -> str:
    return a if a.startswith("CASE") else f"'{a}'"


FOUND = " UNION ALL ".join(
    f"SELECT {K} AS doc_id, '{kind}' AS type, '{'indirecto' if kind == 'fecha' else 'directo'}' AS category, {text} AS text, {_action(action)} AS action, {result} AS result, {review} AS review, '{'media' if kind == 'direccion' else 'alta'}' AS confidence FROM orders WHERE {when}"
    for kind, text, action, result, review, when in _FOUND
)

_KEPT = [("interconsulta", "edad"), ("interconsulta", "fecha")]
_PURPOSES = ("educacion", "publicacion", "interconsulta", "docencia_sintetica", "investigacion")

# (class, norm, when) of the values of a note
_BASE = [
    ("numero_unidad", f"{_X} || ' g/dl'", "true"), ("numero_unidad", "'50 mg'", "true"), ("numero_unidad", "'45 cm'", f"{K} % 5 = 0"),
    ("dosis", f"{_X} || ' g'", "true"), ("dosis", "'50 mg cada 12 h'", "true"), ("analito_valor", f"'hemoglobina=' || {_X}", "true"),
    ("termino_clinico", "'hemoglobina'", "true"), ("medicamento", "'losartan'", "true"),
]
VALUES = " UNION ALL ".join(f"SELECT {K} AS doc_id, '{c}' AS class, {n} AS norm FROM orders WHERE {w}" for c, n, w in _BASE)

SQL: dict[str, str] = {}

SQL["analyze_summary"] = f"SELECT category, type, confidence, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM ({FOUND}) GROUP BY ALL"
SQL["note_findings"] = f"SELECT doc_id, type, category, text, confidence FROM ({FOUND})"
_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
SQL["detect_email"] = _spans("documents", "doc_id", "text", _EMAIL)
SQL["detect_url"] = _spans("pages", "page_id", "url", r"(?i)\bhttps?://[^\s<>\x22\x27)]+")
_ADDRESS = f"regexp_full_match({{}}, '({_OCTET}[.]){{{{3}}}}{_OCTET}')"
SQL["detect_ip"] = _spans("documents", "doc_id", "text", "[0-9.]+", _ADDRESS.format("text"))
SQL["detect_dates"] = _spans("documents", "doc_id", "text", r"\b[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\b")
SQL["detect_url_html"] = _spans("pages", "page_id", "html", r"(?i)\bhttps?://[^\s\x0b\x{85}\p{Z}<>\x22\x27)]+")
_SPACE, _MONTHS = r"[\s\x0b\x{85}\p{Z}]+", "(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre)"
_DATES = [
    r"\b[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}\b", r"\b[0-9]{4}[/.-][0-9]{1,2}[/.-][0-9]{1,2}\b",
    rf"(?i)\b[0-9]{{1,2}}{_SPACE}de{_SPACE}{_MONTHS}{_SPACE}(?:del?{_SPACE})?[0-9]{{4}}\b", rf"(?i)\b{_MONTHS}{_SPACE}(?:del?{_SPACE})?[0-9]{{4}}\b",
]
_DATED = f"(SELECT doc_id, text FROM documents UNION ALL SELECT -o_orderkey - 1, 'Control en ' || {S.LONG_DATE} || ' y ' || {S.ISO_DATE} || '. ' || {N.NOTE} FROM orders)"
SQL["detect_dates_all"] = " UNION ALL ".join(f"SELECT *, {i} AS pattern FROM ({_spans(_DATED, 'doc_id', 'text', p)})" for i, p in enumerate(_DATES))
SQL["initial_risk_notes"] = f"""
WITH n AS (SELECT o_custkey, count(*) AS n FROM ({FOUND}) JOIN orders ON o_orderkey = doc_id GROUP BY 1)
SELECT CASE WHEN n > 12 THEN 'ALTO' ELSE 'MODERADO' END AS risk, count(*) AS n FROM n GROUP BY 1
"""
for _name, _samples in S.FAMILIES.items():
    SQL[_name] = " UNION ALL ".join(f"SELECT {K} AS doc_id, '{s.type}' AS type, CAST(length({s.before}) AS INT) AS start, {s.value} AS text, '{s.confidence}' AS confidence FROM orders WHERE {K} % {len(_samples)} = {i}" for i, s in enumerate(_samples) if s.type)
_SEEN = f"'70.23.22.' || CAST({K} % 256 AS STRING)"
SQL["overlap_resolution"] = f"""
SELECT {K} AS doc_id, 'ip' AS type, 13 AS start, 13 + length({_SEEN}) AS "end", {_SEEN} AS text FROM orders
UNION ALL SELECT {K}, 'fecha', 13 + length({_SEEN}) + 4, 13 + length({_SEEN}) + 14, {N.DATE} FROM orders
"""
SQL["conversation_findings"] = "SELECT conv_id AS doc_id, 'email' AS type, count(*) AS n, CAST(1 AS BIGINT) AS n_distinct FROM conversations WHERE role = 'user' GROUP BY 1"
_LABEL = N.pick("Edad,Ciudad,Ocupación,Nota,EPS", "l_partkey")
SQL["label_from_previous_cell"] = f"""
WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS col, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 1 THEN {_LABEL} ELSE CAST(l_suppkey AS STRING) END AS text FROM lineitem),
p AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY col, l_partkey, l_suppkey) AS prev FROM c),
t(label, type) AS (VALUES ('Edad', 'edad'), ('Ciudad', 'localidad'), ('Ocupación', 'ocupacion'), ('EPS', 'aseguradora'))
SELECT doc_id, col, text, type FROM p JOIN t ON prev = label
"""
SQL["labelled_cells"] = f"""
SELECT {K} AS doc_id, CASE WHEN {K} % 2 = 0 THEN 'localidad' ELSE 'empleador' END AS type, {N.CITY} || ' centro' AS text, 0 AS start, length({N.CITY}) + 7 AS "end",
       'valor de la celda etiquetada ''' || CASE WHEN {K} % 2 = 0 THEN 'ciudad :' ELSE 'empresa' END || '''' AS note FROM orders
"""
# Identity numbers behind their label, and mobile numbers: few documents hold them, so small tables show none. A border that RE2 cannot look at
# is taken along, so a number next to another is met in a second pass.
_W = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_IDENTITY = (
    rf"(?i)(^|[^\p{{L}}\p{{N}}_])((?:c\.?{_W}?c\.?|t\.?{_W}?i\.?|c\.?{_W}?e\.?|n\.?{_W}?i\.?t\.?|dni|nie|rut|curp|pasaporte|c[ée]dula|identificaci[oó]n|documento)"
    rf"{_W}*(?:(?:n[oº°]|nro|num(?:ero)?)\.?{_W}*)?[:#-]?{_W}*)([A-Z0-9][A-Z0-9.-]{{3,20}}\p{{Nd}})"
)
_MOBILE = rf"(^|[^\p{{Nd}}.,/-])(?:\+\p{{Nd}}{{1,3}}(?:{_W}|[.-])?)?3\p{{Nd}}{{2}}(?:{_W}|[.-])?\p{{Nd}}{{3}}(?:{_W}|[.-])?\p{{Nd}}{{4}}([^\p{{Nd}}.,/-]|$)"


def _without(text: str) -> str:
    """The text without addresses, then identity numbers, then mobile numbers, as the priority of their types goes."""
    no_address = f"""regexp_replace(regexp_replace({text}, '{_EMAIL}', '[CORREO ELIMINADO]', 'g'), '(^|[^0-9.])({_OCTET}[.]){{3}}{_OCTET}([^0-9.]|$)', '\\1[IP ELIMINADA]\\5', 'g')"""
    out = rf"regexp_replace({no_address}, '{_IDENTITY}', '\1\2[DOCUMENTO ELIMINADO]', 'g')"
    for _ in range(2):
        out = rf"regexp_replace({out}, '{_MOBILE}', '\1[TELEFONO ELIMINADO]\2', 'g')"
    return out


_REDACTED = _without("text")
SQL["redact_documents"] = f"SELECT doc_id, sha256(coalesce({_REDACTED}, '')) AS text_sha256, length(coalesce({_REDACTED}, '')) AS n_chars FROM documents"
SQL["redact_notes"] = f"""
SELECT {K} AS doc_id, 'Paciente: [PACIENTE]' || chr(10) || 'Cedula: [DOCUMENTO ELIMINADO]' || chr(10) || 'Edad: ' || {_BAND} || chr(10) || 'Fecha: Dia 1' || chr(10) || 'Ciudad: ' || {_REGION} || chr(10)
|| 'Ocupacion: ' || {_SECTOR} || chr(10) || 'Correo [CORREO ELIMINADO]' || chr(10) || CASE WHEN {K} % 5 = 0 THEN '{_STREET}' || chr(10) ELSE '' END
|| 'Hemoglobina: ' || {N.level()} || ' g/dl' || chr(10) || 'Losartan 50 mg cada 12 h, hace 8 anos.' AS new_text FROM orders
"""
SQL["rebuild_text"] = f"""
SELECT conv_id AS doc_id, sha256('{NOTICE}' || chr(10) || chr(10) || string_agg(CAST(turn AS STRING) || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS body_sha256
FROM conversations GROUP BY 1
"""
_DECIDED = f"""SELECT p.purpose, type, CASE WHEN p.purpose = 'interconsulta' AND type IN ('edad', 'fecha') THEN 'preservar' ELSE action END AS action,
review OR (p.purpose = 'interconsulta' AND type IN ('edad', 'fecha')) AS review
FROM ({FOUND}) CROSS JOIN (VALUES {', '.join(f"('{p}')" for p in _PURPOSES)}) p(purpose)"""
SQL["purpose_policy"] = f"SELECT purpose, type, action, count(*) AS n, count(*) FILTER (WHERE review) AS n_review FROM ({_DECIDED}) GROUP BY ALL"
SQL["strait_jacket"] = f"""
SELECT {K} AS doc_id, 'direccion' AS type, '{_STREET}' AS text, '{_STREET}' AS result, 'la transformacion habria alterado informacion clinica (valor con unidad)' AS reason, true AS review, false AS applied
FROM orders WHERE {K} % 5 = 0
"""
_GIVEN = N.pick("Juan,Ana,Carlos,Laura,Pedro,Rosa", K)
SQL["pseudonyms"] = f"""
WITH f AS (SELECT o_custkey AS c, {K} AS k, {_GIVEN} AS name FROM orders),
firsts AS (SELECT c, name, min(k) AS first FROM f GROUP BY ALL),
r AS (SELECT *, dense_rank() OVER (PARTITION BY c ORDER BY first) AS n FROM firsts)
SELECT f.c AS doc_id, f.k AS orderkey, f.name AS text, CASE WHEN n = 1 AND first % 2 = 0 THEN '[PACIENTE]' ELSE '[PERSONA ' || n || ']' END AS pseudonym FROM f JOIN r USING (c, name)
"""
SQL["relative_chronology"] = f"SELECT o_custkey AS doc_id, {K} AS orderkey, 'Dia ' || dense_rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) AS day FROM orders"
for _name, _words, _shown, _table, _none in (
    ("sector_lookup", "Docente,MINERO,astronauta,ama  de  casa,Médico,albañil", "work", L.SECTORS, "[OCUPACION NO CLASIFICADA]"),
    ("region_lookup", "Bogotá,cali,Santa Marta,Springfield,Málaga,Antioquia", "place", L.REGIONS, "[LOCALIDAD]"),
):
    _made = "sector" if _shown == "work" else "region"
    SQL[_name] = f"""
WITH t(term, value) AS (VALUES {_values(_table)}), o AS (SELECT {N.pick(_words, K)} AS {_shown} FROM orders)
SELECT {_shown}, coalesce(value, '{_none}') AS {_made}, count(*) AS n FROM o LEFT JOIN t ON term = {normalise(_shown)} GROUP BY ALL
"""
SQL["matrix_rows"] = f"""
SELECT doc_id, category, type, 'contenido' AS layer, {mask('text')} AS finding_masked, {salted_hash('text')} AS finding_hash, action, result,
       CASE WHEN type = 'direccion' THEN 'protegida: cambio bloqueado' ELSE 'preservada' END AS clinical_integrity, CASE WHEN type = 'direccion' THEN 'moderado' ELSE 'bajo' END AS residual_risk,
       confidence, review AS requires_review FROM ({FOUND})
"""
SQL["audit_counts"] = f"SELECT category, type, action, count(*) AS n FROM ({FOUND}) GROUP BY ROLLUP (category, type, action)"

_WORDS = rf"SELECT doc_id, unnest(regexp_extract_all({fold('text')}, '{{}}')) AS w FROM documents"
_SHORT = [t for t in L.CLINICAL if " " not in t]
SQL["clinical_terms"] = f"""
WITH w AS ({_WORDS.format('[a-z0-9]+')}), t(term) AS (VALUES {', '.join(f"('{t}')" for t in sorted(_SHORT))})
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM w JOIN t ON w = term GROUP BY 1
"""
SQL["negations"] = f"""
WITH w AS ({_WORDS.format('[a-z]+')}) SELECT doc_id, count(*) AS n FROM w WHERE w IN ({', '.join(f"'{t}'" for t in L.NEGATIONS)}) GROUP BY 1
"""
_NOTE_AT = f"strpos(t, 'Hemoglobina: ') AS a, 13 + length({N.level()}) AS na, strpos(t, 'Losartan') AS m"
_AROUND = r"trim(regexp_replace(substr(t, greatest(1, {0} - 28), {0} - greatest(1, {0} - 28) + {1} + 28), '\s+', ' ', 'g'))"
SQL["value_contexts"] = f"""
WITH n AS (SELECT {K} AS doc_id, t, {_NOTE_AT} FROM (SELECT *, {N.NOTE} AS t FROM orders))
SELECT doc_id, 'analito_valor' AS class, substr(t, a, na) AS text, {_AROUND.format('a', 'na')} AS context FROM n
UNION ALL SELECT doc_id, 'medicamento', 'Losartan', {_AROUND.format('m', '8')} FROM n
"""
SQL["clinical_values"] = VALUES
SQL["clinical_class_counts"] = f"SELECT class, count(*) AS n, count(DISTINCT norm) AS n_values FROM ({VALUES}) GROUP BY 1"
_LEVEL = f"length({N.level()})"
SQL["protected_spans"] = f"""
WITH s AS (
    SELECT 'valor con unidad' AS reason, {_LEVEL} + 5 AS chars FROM orders UNION ALL SELECT 'valor con unidad', 5 FROM orders UNION ALL SELECT 'valor con unidad', 5 FROM orders WHERE {K} % 5 = 0
    UNION ALL SELECT 'dosis', {_LEVEL} + 2 FROM orders UNION ALL SELECT 'dosis', 15 FROM orders UNION ALL SELECT 'analito con valor', 13 + {_LEVEL} FROM orders
    UNION ALL SELECT 'termino clinico', 11 FROM orders UNION ALL SELECT 'termino clinico', 8 FROM orders
)
SELECT reason, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM s GROUP BY 1
"""
_TEXTS = {
    ("numero_unidad", f"{_X} || ' g/dl'"): f"{N.level()} || ' g/dl'", ("dosis", f"{_X} || ' g'"): f"{N.level()} || ' g'",
    ("analito_valor", f"'hemoglobina=' || {_X}"): f"'hemoglobina: ' || {N.level()}",
}
_ROWS = " UNION ALL ".join(f"SELECT {K} AS doc_id, '{c}' AS type, {_TEXTS.get((c, n), n)} AS result FROM orders WHERE {w}" for c, n, w in _BASE)
SQL["preserved_rows"] = f"SELECT doc_id, type, result, 'preservar' AS action, {salted_hash('result')} AS finding_hash FROM ({_ROWS})"

_GONE, _MORE, _NEW = f"({K} % 11 = 0)", f"({K} % 7 = 0 AND {K} % 11 <> 0)", f"({K} % 13 = 0)"
SQL["integrity_diff"] = f"""
WITH o AS (SELECT {K} AS doc_id, {_GONE} AS gone, {_MORE} AS changed, {_NEW} AS added, CAST({K} % 5 = 0 AS INT) AS street FROM orders),
c AS (
    SELECT doc_id, 7 + street - CASE WHEN gone THEN 4 WHEN changed THEN 3 ELSE 0 END AS n_exact, CASE WHEN changed THEN 3 WHEN gone AND added THEN 1 ELSE 0 END AS n_unexpected,
           CASE WHEN gone AND added THEN 3 WHEN gone THEN 4 ELSE 0 END AS n_missing, CASE WHEN added AND gone THEN 2 WHEN added THEN 3 ELSE 0 END AS n_new FROM o
)
SELECT doc_id, n_exact, 0 AS n_expected, n_unexpected, n_missing, n_new, n_unexpected + n_missing + n_new > 0 AS blocks, CASE WHEN n_unexpected + n_missing + n_new > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM c
"""
SQL["integrity_rows"] = f"""
SELECT {K} AS doc_id, 'numero_unidad' AS class, {_X} || ' g/dl' AS norm, {_Y} || ' g/dl' AS other, 1 AS n FROM orders WHERE {_MORE}
UNION ALL SELECT {K}, 'dosis', {_X} || ' g', {_Y} || ' g', 1 FROM orders WHERE {_MORE}
UNION ALL SELECT {K}, 'analito_valor', 'hemoglobina=' || {_X}, 'hemoglobina=' || {_Y}, 1 FROM orders WHERE {_MORE}
UNION ALL SELECT {K}, 'dosis', {_X} || ' g', '850 mg', 1 FROM orders WHERE {_GONE} AND {_NEW}
"""
SQL["unsupported_content"] = f"""
SELECT {K} AS doc_id, CAST({_MORE} AS INT) + CAST({_NEW} AS INT) AS n_sentences, 2 * CAST({_MORE} AS INT) + 3 * CAST({_NEW} AS INT) AS n_values FROM orders WHERE {_MORE} OR {_NEW}
"""
#: The last age of a band stands in the band's text as a whole word, `8 anos` in every note, and `90 anos` in its band.
_AGAIN = f"({_AGE} IN (8, 90) OR {_AGE} % 10 = 9 AND {_AGE} < 90)"
SQL["adversarial_leaks"] = f"""
WITH o AS (SELECT {K} AS doc_id, CAST({K} % 17 = 0 AS INT) + CAST({_AGAIN} AS INT) AS n_leaks, CAST({K} % 5 = 0 AS INT) AS n_residual FROM orders)
SELECT doc_id, n_leaks, n_residual, 0 AS n_metadata, CASE WHEN n_leaks > 0 THEN 'FAIL' WHEN n_residual > 0 THEN 'REVISAR' ELSE 'PASS' END AS verdict FROM o
"""
_LAST = "list_extract(string_split(lower(key), ':'), -1)"
SQL["metadata_neutrality"] = f"""
WITH m AS (SELECT {N.pick('dc:creator,dcterms:created,Application,company,title', K)} AS key, {N.pick('Ana Rojas,DOCX,documento desidentificado 7', 'o_custkey')} AS value FROM orders)
SELECT key, value, lower(value) IN ({', '.join(f"'{v}'" for v in NEUTRAL_VALUES)}) OR contains(value, 'desidentificado') OR key LIKE '%created' OR {_LAST} IN ({', '.join(f"'{v}'" for v in TECHNICAL)}) AS neutral, count(*) AS n
FROM m GROUP BY ALL
"""
SQL["context_score"] = f"SELECT {K} AS doc_id, 3 AS score, 'edad, fecha' AS kinds, 'bajo' AS level FROM orders"
SQL["residual_risk"] = f"""
SELECT {K} AS doc_id, CASE WHEN {_AGAIN} THEN 'FAIL' WHEN {K} % 5 = 0 THEN 'REVISAR' ELSE 'PASS' END AS attack, CAST({K} % 5 = 0 AS INT) AS n_blocked, 7 + CAST({K} % 5 = 0 AS INT) AS n_exact,
       CASE WHEN {_AGAIN} THEN 'ALTO' WHEN {K} % 5 = 0 THEN 'MODERADO' ELSE 'BAJO' END AS risk, CASE WHEN {_AGAIN} THEN 'REQUIRES_MANUAL_REVIEW' ELSE 'PENDING_REVIEW' END AS state FROM orders
"""
SQL["review_state"] = f"""
WITH o AS (
    SELECT {K} % 19 = 0 AS fail, {K} % 19 <> 0 AND {K} % 3 = 0 AS check_, {K} % 23 = 0 AS broken, {K} % 2 = 1 AS marked, {K} % 29 = 0 AS scan, o_custkey % 31 = 0 AS context FROM orders
), r AS (
    SELECT *, CASE WHEN scan THEN 4 WHEN fail OR broken OR context THEN 3 WHEN check_ OR marked THEN 2 ELSE 1 END AS level,
           CAST(fail AS INT) + CAST(check_ AS INT) + CAST(broken AS INT) + CAST(marked AS INT) + CAST(scan AS INT) + CAST(context AS INT) AS reasons FROM o
)
SELECT ['BAJO', 'MODERADO', 'ALTO', 'NO EVALUABLE'][level] AS risk, CASE WHEN level >= 3 THEN 'REQUIRES_MANUAL_REVIEW' ELSE 'PENDING_REVIEW' END AS state,
       count(*) AS n, CAST(sum(CASE WHEN level = 1 THEN 1 ELSE reasons END) AS BIGINT) AS n_reasons FROM r GROUP BY ALL
"""
SQL["human_reviews"] = f"""
WITH last AS (SELECT o_custkey, max({K}) AS k FROM orders GROUP BY 1)
SELECT c_custkey AS doc_id, CASE WHEN k IS NULL THEN 'PENDING_REVIEW' WHEN k % 3 = 0 THEN 'REJECTED_BY_HUMAN' ELSE 'APPROVED_BY_HUMAN' END AS state, 'r' || CAST(k % 5 AS STRING) AS reviewer
FROM customer LEFT JOIN last ON c_custkey = o_custkey
"""
SQL["mask_hash"] = f"SELECT c_custkey, {mask('c_name')} AS masked, {salted_hash('c_name')} AS hash FROM customer"
SQL["fold_normalise"] = f"SELECT doc_id, sha256({fold('coalesce(text, chr(0)[2:])')}) AS folded_sha256, length({normalise('coalesce(text, chr(0)[2:])')}) AS n_normal FROM documents".replace("chr(0)[2:]", "''")
SQL["age_bands"] = """
WITH a AS (SELECT p_size * 3 - 5 AS age FROM part)
SELECT CASE WHEN age < 0 OR age > 120 THEN '[EDAD]' WHEN age >= 90 THEN '90 anos o mas' WHEN age < 1 THEN 'menor de 1 ano' ELSE (age // 10 * 10) || '-' || (age // 10 * 10 + 9) || ' anos' END AS band, count(*) AS n FROM a GROUP BY 1
"""
SQL["date_parse"] = f"""
SELECT {K} AS doc_id, CASE WHEN {K} % 5 = 4 THEN NULL WHEN {K} % 5 = 3 THEN strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date,
       CASE {K} % 5 WHEN 4 THEN NULL WHEN 3 THEN 'mes' ELSE 'dia' END AS grain FROM orders
"""
SQL["number_forms"] = "SELECT l_orderkey, l_linenumber, rtrim(rtrim(printf('%.2f', l_extendedprice), '0'), '.') AS number FROM lineitem"
# what each beginning becomes before the number of the page: º, the ligatures and wide letters decompose, ½ to 1, a fraction
# stroke and 2, Ø and Ł do not; marks of points and strokes go at the beginning
_NAMED = f"['Informe_no_7_ano', 'officio_final', 'Nota12', 'x21_2', 'rsted_odz', '', '', 'oculto', 'ae', '{'m' * 100}'][page_id % 10 + 1]"
SQL["file_names"] = f"SELECT page_id, substr({_NAMED} || page_id, 1, 90) || '.txt' AS name FROM pages"
SQL["interval_merge"] = """
WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, abs(CAST(floor(coalesce(value, 0) * 60) AS BIGINT)) AS n FROM events),
r AS (SELECT user_id, s, s + n AS e, max(s + n) OVER (PARTITION BY user_id ORDER BY s, s + n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT user_id, min(s) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY user_id, island
"""
SQL["admission"] = """
WITH f AS (SELECT page_id AS p, ['.txt', '.docx', '.exe', '.pdf'][page_id % 4 + 1] AS format, coalesce(length(html), 0) AS n FROM pages)
SELECT format, CASE WHEN format = '.exe' THEN 'formato no admitido' WHEN p % 7 = 0 THEN 'archivo vacio' WHEN format = '.docx' AND p % 5 <> 0 THEN 'el contenido no corresponde a la extension'
    WHEN format = '.pdf' THEN 'el contenido no corresponde a la extension' WHEN format = '.txt' AND p % 5 <> 0 AND p % 8 = 4 THEN 'el contenido no es texto' END AS reject, count(*) AS n
FROM f GROUP BY ALL
"""
SQL["text_files"] = "SELECT page_id, 'añil ' || url AS text FROM pages"


# ------------------------------------------------- metadata, verdicts, policy cases

_SHOWN = f"substr({S.FIELD_VALUE}, 1, 300)"
_NOTE = "CASE WHEN replace(lower({}), ' ', '_') IN (" + ", ".join(f"'{x}'" for x in SENSITIVE) + ") THEN 'campo sensible conocido' ELSE 'metadato del archivo' END"
SQL["metadata_findings"] = f"""
SELECT o_custkey AS doc_id, 'tecnico' AS category, 'metadato' AS type, {_SHOWN} AS text, CAST(length({_SHOWN}) AS INT) AS "end", 'metadatos' AS layer, {S.FIELD} AS path, 'alta' AS confidence, {_NOTE.format(S.FIELD)} AS note
FROM orders WHERE {S.FIELD_VALUE} <> ''
"""
SQL["metadata_matrix"] = f"""
SELECT o_custkey AS doc_id, {S.FIELD} || '.' || CAST({K} AS STRING) AS path, {S.FIELD} || '.' || CAST({K} AS STRING) || ' = ' || {mask(f'trim({_SHOWN})')} AS finding_masked, {salted_hash(_SHOWN)} AS finding_hash, 'eliminar' AS action,
       '(no se copia al archivo reconstruido)' AS result, 'identificador tecnico: metadato del archivo' AS motive, 'bajo' AS residual_risk, false AS requires_review
FROM orders WHERE {S.FIELD_VALUE} <> ''
"""
_TOLD = f"CASE WHEN {K} % 3 = 2 AND {S.FIELD} NOT IN ('TotalTime', 'Pages', 'dcterms:modified') THEN 1 ELSE 0 END"
SQL["attack_verdicts"] = f"""
WITH o AS (
    SELECT {K} AS doc_id, CAST({K} % 7 = 0 AS INT) + CAST({K} % 10 = 0 AS INT) AS n_leaks, CAST({K} % 5 = 0 AS INT) AS n_residual, {_TOLD} AS n_metadata, CAST({K} % 11 = 0 AS INT) AS n_codes,
           {K} % 4 = 0 AS author_declared FROM orders
)
SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'NO_EVALUABLE' WHEN n_leaks > 0 OR n_codes > 0 THEN 'FAIL' WHEN n_metadata > 0 OR n_residual > 0 THEN 'REVISAR' ELSE 'PASS' END AS verdict FROM o
"""
SQL["context_levels"] = f"""
WITH q AS (SELECT DISTINCT o_custkey AS doc_id, {S.QUASI} AS type FROM orders WHERE {K} % 4 <> 0)
SELECT doc_id, sum(w) AS score, CASE WHEN sum(w) >= {HIGH} THEN 'alto' WHEN sum(w) >= {MODERATE} THEN 'moderado' ELSE 'bajo' END AS level, string_agg(type, ', ' ORDER BY type) AS kinds
FROM q JOIN (VALUES {', '.join(f"('{k}', {v})" for k, v in WEIGHTS.items())}) t(type, w) USING (type) GROUP BY 1
"""
_DOUBTFUL = "('posible_nombre', 'campo_identificador_dudoso', 'posible_ocupacion')"
#: What the policy makes of 'Medellin' as each type: action, whether a person is to look at it, and what the reason goes on with.
_OUTCOME = f"""CASE WHEN type IN ({', '.join(f"'{k}'" for k in REMOVED)}) THEN 'eliminar' WHEN type IN ('nombre_persona', 'nombre_profesional', 'ocupacion', 'institucion', 'aseguradora', 'empleador') THEN 'sustituir'
WHEN type = 'localidad' THEN 'generalizar' ELSE 'marcar_para_revision' END"""
SQL["policy_cases"] = f"""
WITH f AS (SELECT {K} AS doc_id, {S.KIND} AS type, {S.LAYER} AS layer FROM orders),
d AS (
    SELECT *, {_OUTCOME} AS wanted, CASE WHEN type = 'tipo_desconocido' THEN 'tipo no cubierto por la politica' WHEN type = 'fecha' THEN 'fecha no interpretable de forma segura'
           WHEN type = 'ocupacion' THEN why || ' (sin sector conocido)' ELSE why END AS reason
    FROM f LEFT JOIN (VALUES {_values(REASONS)}) r(type, why) USING (type)
)
SELECT doc_id, type, layer, CASE WHEN wanted = 'marcar_para_revision' OR layer = 'contenido' THEN wanted WHEN layer = 'comentario' THEN 'eliminar' ELSE 'marcar_para_revision' END AS action,
       reason || CASE WHEN wanted = 'marcar_para_revision' OR layer = 'contenido' THEN '' WHEN layer = 'comentario' THEN ' (capa descartada por completo)' ELSE ' (capa no reescribible: solo se reporta)' END AS motive,
       CASE WHEN wanted = 'marcar_para_revision' OR layer = 'nombre_archivo' THEN 'moderado' ELSE 'bajo' END AS residual_risk,
       CASE WHEN wanted = 'marcar_para_revision' OR layer = 'nombre_archivo' THEN true WHEN layer = 'comentario' THEN false ELSE type = 'ocupacion' END AS requires_review
FROM d
"""
SQL["aggressive_policy"] = f"SELECT {K} AS doc_id, split_part('posible_nombre,campo_identificador_dudoso,posible_ocupacion', ',', CAST({K} % 3 + 1 AS INT)) AS type, 'sustituir' AS action, true AS review, true AS applied FROM orders"
SQL["rebuild_check"] = f"SELECT {K} AS doc_id, CASE WHEN {K} % 3 = 0 THEN 'N/A' WHEN {_GONE} OR {_MORE} OR {_NEW} THEN 'FAIL' ELSE 'PASS' END AS verdict, {K} % 3 <> 0 AND ({_GONE} OR {_MORE} OR {_NEW}) AS blocks FROM orders"
SQL["notices"] = f"""
SELECT {K} AS doc_id, {S.PURPOSE} AS purpose, {K} % 7 <> 0 AS stamped, CASE WHEN {K} % 7 <> 0 THEN CASE WHEN {S.PURPOSE} = 'docencia_sintetica' THEN '{NOTICES['docencia_sintetica']}' ELSE '{NOTICE}' END END AS notice
FROM orders
"""
SQL["clinical_samples"] = f"""
SELECT {K} AS doc_id, 'signo_vital' AS class, CAST({K} % 90 + 90 AS STRING) || '/' || CAST({K} % 40 + 50 AS STRING) AS norm FROM orders WHERE {K} % 4 = 0
UNION ALL SELECT {K}, 'medida', CAST({K} % 9 + 1 AS STRING) || 'x' || CAST({K} % 7 + 1 AS STRING) || ' cm' FROM orders WHERE {K} % 4 = 2
UNION ALL SELECT {K}, 'porcentaje', CAST({K} % 30 + 70 AS STRING) || ' %' FROM orders WHERE {K} % 4 = 3
"""
_KILOS = f"CAST({K} % 50 + 10 AS STRING) || ' kg'"
SQL["expected_transformations"] = f"SELECT {K} AS doc_id, 'EXPECTED_TRANSFORMATION' AS state, {_KILOS} AS norm, 1 AS n FROM orders UNION ALL SELECT {K}, 'EXPECTED_TRANSFORMATION', '99 kg', 1 FROM orders"
SQL["files_without_content"] = """
SELECT 'p' || page_id || '.txt' AS path, 'No se pudo extraer contenido del archivo.' AS reject, 'NO_EVALUABLE' AS risk, 'REQUIRES_MANUAL_REVIEW' AS state FROM pages WHERE page_id % 3 = 0
"""
SQL["intact_files"] = "SELECT 'p' || page_id || '.txt' AS path, page_id % 5 <> 0 AND page_id % 3 <> 0 AS intact FROM pages"
SQL["audit_sections"] = f"""
SELECT doc_id, 'r1' AS run, count(*) AS total, count(*) FILTER (WHERE action = 'generalizar') AS n_generalised, 'nombre_persona' AS first_type, CAST(7 AS BIGINT) AS n_exact, 'BAJO' AS risk, 'PENDING_REVIEW' AS state
FROM ({FOUND}) GROUP BY 1
"""

_C = "CAST(c_custkey AS STRING)"


def _band(age: str) -> str:
    return f"CASE WHEN {age} > 120 THEN '[EDAD]' WHEN {age} >= 90 THEN '90 anos o mas' WHEN {age} < 1 THEN 'menor de 1 ano' ELSE CAST(({age}) // 10 * 10 AS STRING) || '-' || CAST(({age}) // 10 * 10 + 9 AS STRING) || ' anos' END"


_PARTS = [
    ("w", "contenido", f"'nota ' || {_C}", True, ""), ("w", "contenido", "''", True, ""), ("w", "control_cambios", "'borrado'", False, ""), ("w", "tabla", "'Ciudad'", True, ""), ("w", "tabla", f"'Villa ' || {_C}", True, "Ciudad"),
    ("w", "metadatos", "'Revisor'", False, ""), ("w", "encabezado", f"'folio ' || {_C}", True, ""), ("w", "comentario", "'ojo'", False, ""), ("w", "metadatos", f"'Autor ' || {_C}", False, ""), ("w", "metadatos", f"'Dueno ' || {_C}", False, ""),
    ("s", "hoja_calculo", "'Edad'", True, ""), ("s", "hoja_calculo", _C, True, "Edad"), ("s", "hoja_calculo", f"'total ' || {_C}", True, ""), ("s", "hoja_calculo", "'7'", False, None),
    ("s", "hoja_calculo", f"'Hoja ' || {_C}", False, ""), ("s", "comentario", "'visto'", False, ""),
]
_PATH = {"w": f"'w' || {_C} || '.docx'", "s": f"'s' || {_C} || '.xlsx'"}


def _label(given: str | None) -> str:
    return f"'total ' || {_C}" if given is None else f"'{given}'" if given else "NULL"


SQL["office_units"] = " UNION ALL ".join(f"SELECT {_PATH[f]} AS path, '{layer}' AS layer, {text} AS text, {str(editable).lower()} AS editable, {_label(label)} AS prev_label FROM customer" for f, layer, text, editable, label in _PARTS)
SQL["office_inspection"] = f"""
SELECT {_PATH['w']} AS path, 1 AS n_external, 1 AS n_media, CAST(c_custkey % 5 = 0 AS INT) AS n_macros, 1 AS n_deleted, 0 AS n_formulas,
       CASE WHEN c_custkey % 5 = 0 THEN 'MACROS,' ELSE '' END || 'ENLACES_EXTERNOS,MEDIOS_INCRUSTADOS,CONTROL_DE_CAMBIOS' AS alerts FROM customer
UNION ALL SELECT {_PATH['s']}, 0, 0, 0, 0, 1, 'FORMULAS' FROM customer
"""
SQL["office_metadata"] = f"""
SELECT 'author' AS key, 'Revisor' AS text, 'campo sensible conocido' AS note FROM customer
UNION ALL SELECT 'author', 'Autor ' || {_C}, 'campo sensible conocido' FROM customer UNION ALL SELECT 'creator', 'Dueno ' || {_C}, 'campo sensible conocido' FROM customer
"""
# each place of a report and a sheet as they are written: kind of file, uid, kind, style, text
_REPORT_AGE, _TABLE_AGE, _SHEET_AGE = "c_custkey % 97 + 1", "c_custkey % 80 + 10", f"CAST(substr({_C}, 1, 3) AS INT)"
_WRITTEN = [
    ("r", "document/p1", "text", "", "'VERSION MINIMIZADA SUJETA A REVISION Y APROBACION HUMANA.'"), ("r", "document/p2", "text", "Heading1", "'Informe'"),
    ("r", "document/p3", "text", "Heading1", f"'Caso ' || {_C}"), ("r", "document/p4", "text", "", "'Paciente: [PACIENTE]'"),
    ("r", "document/p5", "text", "", f"'Edad: ' || {_band(_REPORT_AGE)} || '. Hemoglobina ' || CAST(8 + c_custkey % 7 AS STRING) || '.' || CAST(c_custkey % 10 AS STRING) || ' g/dL.'"),
    ("r", "document/p6", "text", "", "'Se revisa.'"),
    ("r", "document/t7/0/0", "cell", "", "'Municipio'"), ("r", "document/t7/0/1", "cell", "", "'[LOCALIDAD]'"), ("r", "document/t7/1/0", "cell", "", "'Edad'"), ("r", "document/t7/1/1", "cell", "", _band(_TABLE_AGE)),
    ("r", "document/t7/2/0", "cell", "", "'Leucocitos'"), ("r", "document/t7/2/1", "cell", "", "CAST(4 + c_custkey % 5 AS STRING) || '.' || CAST(c_custkey % 10 AS STRING)"),
    ("r", "document/p8", "text", "Heading2", "'Conducta'"), ("r", "document/p9", "text", "", "'Control en consulta.'"),
    ("r", "document/p10", "text", "", "''"), ("r", "document/p11", "text", "Heading2", "'ANEXO A - ENCABEZADOS (extraidos y minimizados)'"), ("r", "document/p12", "text", "", "'Correo [CORREO ELIMINADO]'"),
    ("r", "document/p13", "text", "", "''"), ("r", "document/p14", "text", "Heading2", "'ANEXO B - PIES DE PAGINA (extraidos y minimizados)'"), ("r", "document/p15", "text", "", "'Pagina'"),
    ("s", "sheet1!", "sheet", "", f"'Hoja ' || {_C}"), ("s", "sheet1!A1", "cell", "", "'VERSION MINIMIZADA SUJETA A REVISION Y APROBACION HUMANA.'"), ("s", "sheet1!A2", "cell", "", "'Edad'"),
    ("s", "sheet1!B2", "cell", "", _band(_SHEET_AGE)), ("s", "sheet1!A3", "cell", "", f"'total ' || {_C}"), ("s", "sheet1!B3", "number", "", "'7'"),
]
_PATH["r"] = f"'r' || {_C} || '.docx'"
SQL["pdf_metadata"] = f"""
SELECT 'd' || {_C} || '.pdf' AS path, 'info:Author' AS key, 'Dueno (' || {_C} || ')' AS value FROM customer UNION ALL SELECT 'd' || {_C} || '.pdf', 'info:Producer', 'escaner' FROM customer
UNION ALL SELECT 'd' || {_C} || '.pdf', 'xmp', substr('<?xpacket begin="" id="W5M0"?><x:xmpmeta>año ' || {_C} || '</x:xmpmeta>' || repeat('-', CAST(c_custkey % 3 * 600 AS INT)) || '<?xpacket end="w"?>', 1, 1000) FROM customer
UNION ALL SELECT 'd' || {_C} || '.pdf', 'archivos_embebidos', 'datos' || {_C} || '.csv' FROM customer WHERE c_custkey % 4 = 0
"""
SQL["pdf_alerts"] = f"""
SELECT 'd' || {_C} || '.pdf' AS path, 'critica' AS level, 'ARCHIVOS_EMBEBIDOS' AS code, CAST(1 AS BIGINT) AS n FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT 'd' || {_C} || '.pdf', 'advertencia', 'PDF_CON_ACCIONES', 2 FROM customer WHERE c_custkey % 5 = 0
"""
SQL["image_metadata"] = " UNION ALL ".join(
    f"SELECT '{key}' AS key, '{text}' || {_C} AS text, '{note}' AS note FROM customer WHERE {when}"
    for key, text, note, when in [
        ("info:Author", "Dueno ", "metadato del archivo", "true"), ("info:Comment", "nota ", "metadato del archivo", "true"), ("info:Title", "año ", "metadato del archivo", "true"),
        ("exif:Artist", "Artista ", "metadato del archivo", "true"), ("info:comment", "hecho por ", "metadato del archivo", "true"), ("exif:Model", "Camara ", "metadato del archivo", "c_custkey % 3 <> 0"),
    ]
) + " UNION ALL SELECT 'exif:Orientation', '1', 'metadato del archivo' FROM customer"
_TOLD = [
    ("image", "info:Author", "true"), ("image", "info:Comment", "true"), ("image", "info:Title", "true"), ("image", "exif:Artist", "true"), ("image", "exif:Orientation", "true"), ("image", "info:comment", "true"),
    ("image", "exif:Model", "c_custkey % 3 <> 0"), ("pdf", "info:Author", "true"), ("pdf", "info:Producer", "true"), ("pdf", "xmp", "true"), ("pdf", "archivos_embebidos", "c_custkey % 4 = 0"), ("pdf", "ARCHIVOS_EMBEBIDOS", "c_custkey % 4 = 0"),
    ("office", "creator", "true"), ("office", "Company", "c_custkey % 9 <> 0"), ("office", "v", "true"), ("office", "MACROS", "c_custkey % 5 = 0"), ("office", "OBJETOS_EMBEBIDOS", "c_custkey % 7 = 0"),
    ("office", "XML_INVALIDO", "c_custkey % 9 = 0"), ("office", "CONTROL_CAMBIOS", "true"), ("office", "FORMULAS", "true"),
]
SQL["files_told"] = " UNION ALL ".join(f"SELECT '{h}' AS handler, '{w}' AS what, count(*) AS n, count(*) AS n_documents FROM customer WHERE {when} HAVING count(*) > 0" for h, w, when in _TOLD) + """
UNION ALL SELECT 'pdf', 'PDF_CON_ACCIONES', CAST(2 * count(*) AS BIGINT), count(*) FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 'office', 'author', CAST(3 * count(*) AS BIGINT), count(*) FROM customer
"""
SQL["office_round_trip"] = " UNION ALL ".join(f"SELECT {_PATH[f]} AS path, '{uid}' AS uid, '{kind}' AS kind, '{style}' AS style, {text} AS text FROM customer" for f, uid, kind, style, text in _WRITTEN)
_SAID = {
    "docProps/app.xml:TotalTime": "'0'", "docProps/core.xml:title": "CASE format WHEN 'docx' THEN 'Documento desidentificado' ELSE 'Libro desidentificado' END",
    "docProps/core.xml:description": "'Texto desidentificado. Requiere revision humana.'", "docProps/core.xml:revision": "'1'", "docProps/core.xml:created": "'2000-01-01T00:00:00Z'",
    "docProps/core.xml:modified": "'2000-01-01T00:00:00Z'", "docProps/core.xml:contentStatus": "'DESIDENTIFICADO - PENDIENTE DE REVISION'",
}
SQL["office_properties"] = "WITH f AS (SELECT unnest(['docx', 'xlsx']) AS format, count(*) AS n FROM customer) " + " UNION ALL ".join(
    f"SELECT format, 'property' AS kind, '{part}' AS part, {text} AS text, n FROM f" for part, text in _SAID.items()
)
_CODES = {
    "CONTROL_CAMBIOS": ("advertencia", "r", "true"), "MACROS": ("critica", "r", "c_custkey % 5 = 0"), "OBJETOS_EMBEBIDOS": ("critica", "r", "c_custkey % 7 = 0"),
    "XML_INVALIDO": ("advertencia", "r", "c_custkey % 9 = 0"), "FORMULAS": ("advertencia", "s", "true"),
}
SQL["office_alerts"] = " UNION ALL ".join(f"SELECT {_PATH[f]} AS path, '{level}' AS level, '{code}' AS code, CAST(1 AS BIGINT) AS n FROM customer WHERE {when}" for code, (level, f, when) in _CODES.items())
_GRAVE = "CAST(c_custkey % 5 = 0 AS INT) + CAST(c_custkey % 7 = 0 AS INT)"
# an age that ends its band, or begins the last one, still stands in the text of the band: that is found as a leak
_LEAK = f"(({_REPORT_AGE}) < 90 AND ({_REPORT_AGE}) % 10 = 9 OR ({_REPORT_AGE}) = 90)"
# an age of four figures is looked for, and still stands in the cell `total <key>`
_SHEET = [f"CASE WHEN c_custkey >= 1000 THEN '{bad}' ELSE '{good}' END" for bad, good in (("FAIL", "PASS"), ("ALTO", "BAJO"), ("REQUIRES_MANUAL_REVIEW", "PENDING_REVIEW"))]
SQL["office_check"] = f"""
SELECT {_PATH['r']} AS path, CASE WHEN {_LEAK} THEN 'FAIL' ELSE 'PASS' END AS attack, 'PASS' AS rebuild, 0 AS n_metadata, CAST({_GRAVE} AS BIGINT) AS n_critical_alerts,
       CASE WHEN {_LEAK} THEN 'ALTO' WHEN {_GRAVE} > 0 THEN 'MODERADO' ELSE 'BAJO' END AS risk, CASE WHEN {_LEAK} THEN 'REQUIRES_MANUAL_REVIEW' ELSE 'PENDING_REVIEW' END AS state FROM customer
UNION ALL SELECT {_PATH['s']}, {_SHEET[0]}, 'PASS', 0, 0, {_SHEET[1]}, {_SHEET[2]} FROM customer
"""
SQL["office_sanitise"] = f"""
SELECT {_PATH['r']} AS path, 'docProps/custom.xml,word/comments.xml,word/people.xml' || CASE WHEN c_custkey % 5 = 0 THEN ',word/vbaProject.bin' ELSE '' END AS removed,
       'docProps/app.xml:TotalTime=0,docProps/core.xml:creator=Dueno ' || {_C} || ',word/document.xml=Revisora' AS told FROM customer
UNION ALL SELECT {_PATH['s']}, '', NULL FROM customer
"""
SQL["user_format"] = "SELECT 'customer.parquet' AS name, c_custkey, c_name AS text FROM customer"
SQL["pdf_marks"] = """
SELECT 'p' || page_id || '.pdf' AS path, ['/JavaScript', '/OpenAction,/Launch', '/EmbeddedFile', ''][page_id % 4 + 1] AS marks, page_id % 3 > 0 AND page_id % 5 * 60 < 120 * greatest(page_id % 2, 1) AS scanned FROM pages
"""

_HEADER = "'\ufeffcategoria;tipo;capa;hallazgo_enmascarado;hallazgo_hash;accion;resultado;motivo;integridad_clinica;riesgo_residual;ruta;confianza;requiere_revision' || chr(13) || chr(10)"


def _matrix_line(kind: str, value: str, result: str, motive: str) -> str:
    result = f"CASE WHEN {K} % 3 = 0 THEN '\"{result}; \"\"x\"\"\"' ELSE '{result}' END"
    return f"'directo;{kind};contenido;' || {mask(value)} || ';' || {salted_hash(value)} || ';eliminar;' || {result} || ';{motive};preservada;bajo;;alta;False' || chr(13) || chr(10)"


_FILE = f"{_HEADER} || {_matrix_line('documento_identidad', N.IDENTITY, '[DOCUMENTO ELIMINADO]', 'identificador directo')} || {_matrix_line('email', N.MAIL, '[CORREO ELIMINADO]', 'identificador directo')}"
SQL["matrix_csv"] = f"SELECT {K} AS doc_id, sha256(encode(t)) AS sha256, octet_length(encode(t)) AS bytes FROM (SELECT {K}, {_FILE} AS t FROM orders)"
_SUMMARY = f"""'# ' || CAST({K} AS STRING) || '

> Reduce informacion identificable pero no garantiza anonimizacion absoluta. Revise siempre el documento antes de compartirlo. La aprobacion final corresponde a una persona.

| Campo | Valor |
| --- | --- |
| Ejecucion | `r1` |
| Finalidad | educacion |
| Formato | docx |
| Original intacto | ' || CASE WHEN {K} % 3 = 0 THEN 'SI' ELSE 'NO' END || ' |
| Riesgo residual | **' || CASE WHEN {K} % 4 = 0 THEN 'ALTO' ELSE 'BAJO' END || '** |
| Estado | PENDING_REVIEW |

## Por que ese riesgo
' || CASE WHEN {K} % 2 = 0 THEN '
- uno
- dos' ELSE '' END || '

## Verificaciones

- Integridad clinica (transformacion): **' || CASE WHEN {K} % 5 = 0 THEN 'FAIL' ELSE 'PASS' END || '**
- Integridad de la reconstruccion: **N/A**
- Contenido sin respaldo: **N/A**
- Prueba adversarial: **' || CASE WHEN {K} % 4 = 0 THEN 'FAIL' ELSE 'PASS' END || '**

## Transformaciones
' || CASE WHEN {K} % 2 = 0 THEN '
- eliminar: 2
- sustituir: 1' ELSE '' END || CASE WHEN {K} % 7 = 0 THEN '

## Alertas

- **CRITICA MACROS**: m' ELSE '' END || '

---

La aprobacion final corresponde a una persona. Este informe no es una certificacion legal.'"""
SQL["markdown_reports"] = f"SELECT {K} AS doc_id, sha256({_SUMMARY}) AS sha256 FROM orders"
