"""Clinical notes made from the rows of orders, as SQL that Spark and others read alike.

The driver's tables hold no labelled identifiers, so queries on labels, policies and clinical
values run on these notes: one for each order, its values derived from the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def pick(words: str, key: str) -> str:
    """One of the words by the key's remainder."""
    return f"split_part('{words}', ',', CAST({key} % {len(words.split(','))} + 1 AS INT))"


NAME = pick("Juan,Ana,Carlos,Laura,Pedro,Rosa", "o_orderkey") + " || ' ' || " + pick("Perez,Garcia,Torres,Rojas,Medina", "o_custkey")
CITY, WORK = pick("Cali,Bogota,Lima,Springfield", "o_orderkey"), pick("docente,minero,astronauta", "o_orderkey")
AGE = "CAST(o_orderkey % 97 + 1 AS STRING)"
DATE = "lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING)"
IDENTITY = "CAST(1000000 + o_custkey AS STRING)"
MAIL = "'p' || CAST(o_orderkey AS STRING) || '@mail.example.com'"
_HEAD = f"""'Paciente: ' || {NAME} || chr(10) || 'Cedula: ' || {IDENTITY} || chr(10) || 'Edad: ' || {AGE} || ' anos' || chr(10)
|| 'Fecha: ' || {DATE} || chr(10) || 'Ciudad: ' || {CITY} || chr(10) || 'Ocupacion: ' || {WORK} || chr(10) || 'Correo ' || {MAIL} || chr(10)
|| CASE WHEN o_orderkey % 5 = 0 THEN 'Calle 45 cm 2' || chr(10) ELSE '' END"""


def level(more: int = 0) -> str:
    """The haemoglobin level as written, so many units higher."""
    return f"CAST(8 + o_orderkey % 7 + {more} AS STRING) || '.' || CAST(o_orderkey % 10 AS STRING)"


_TAIL = "'Losartan 50 mg cada 12 h, hace 8 anos.'"
NOTE = f"{_HEAD} || 'Hemoglobina: ' || {level()} || ' g/dl' || chr(10) || {_TAIL}"
#: The note with a level changed, the line left out, or a drug added, by the key.
ALTERED = f"""{_HEAD} || CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'Hemoglobina: ' || {level(1)} || ' g/dl' || chr(10)
ELSE 'Hemoglobina: ' || {level()} || ' g/dl' || chr(10) END || {_TAIL} || CASE WHEN o_orderkey % 13 = 0 THEN chr(10) || 'Metformina 850 mg.' ELSE '' END"""


def notes(spark: SparkSession, sf_dir: str, **more: str) -> DataFrame:
    """Units with the notes' texts, and further columns by SQL."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    extra = [f"{sql} AS {name}" for name, sql in more.items()]
    return orders.selectExpr("o_orderkey AS doc_id", "0 AS unit_seq", "'contenido' AS layer", "'' AS path", "true AS editable", f"{NOTE} AS text", *extra)
