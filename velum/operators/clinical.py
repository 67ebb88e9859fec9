"""Clinical content: what no transformation may touch, and values that can be compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velum.functions import lexicons as L
from velum.functions.spans import Pattern, overlaps, scan
from velum.functions.text import clip, fold, salted_hash
from velum.operators.detect import OTHERS

_NUM = r"\d+(?:[.,]\d+)?"
#: The same where no unit that follows begins with a figure, so that nothing is given back; what stands at a word's beginning is asked
#: behind the first figure, as a search is fast for patterns that begin with a plain class.
_FIRST = r"\d(?<!\w\d)\d*+(?:[.,]\d+)?+"
# Patterns over folded text.
_REGEX = {
    "numero_unidad": rf"(?i)(\d\d*(?:[.,]\d+)?)\s*(" + L.alternation(L.UNITS) + r")(?![A-Za-z0-9/])",
    "medida": rf"(?i)\b({_NUM})\s*[x×]\s*({_NUM})(?:\s*[x×]\s*({_NUM}))?\s*(mm|cm|m)\b",
    "dosis": rf"(?i)({_FIRST})\s*(mg|g|mcg|ug|ml|ui|comprimidos?|tabletas?|capsulas?|gotas?)\b(\s*(?:cada|c/)\s*\d{{1,2}}\s*(?:h|horas|dias|d))?",
    "porcentaje": rf"(?i)({_FIRST})\s*%",
    "analito_valor": r"(?i)(?<![a-z0-9])(" + L.alternation({*L.ANALYTES, *L.VITALS}) + rf")(?![a-z0-9])\s*[:=]?\s*({_NUM})",
    "termino": r"(?<![a-z0-9])(" + L.alternation(L.CLINICAL) + r")(?![a-z0-9])",
    "signo_vital": r"(?i)(\d(?<!\w\d)\d{1,2}+)\s*/\s*(\d{2,3})\s*(?:mmhg)?\b",
    "negacion": r"(?<![a-z])(" + L.alternation(L.NEGATIONS) + r")(?![a-z])",
}
#: Why a kind is protected, in the order in which a clash is looked for.
REASONS = {
    "numero_unidad": "valor con unidad", "medida": "medida", "dosis": "dosis", "porcentaje": "porcentaje",
    "analito_valor": "analito con valor", "termino": "termino clinico", "signo_vital": "signo vital",
}
CLASSES = {
    "anatomia": L.ANATOMY, "lateralidad": L.LATERALITY, "medicamento": L.DRUGS, "procedimiento": L.PROCEDURES,
    "diagnostico": L.DIAGNOSES, "certeza": L.CERTAINTY,
}
#: The order of values within a text: class by class.
_VALUE_ORDER = ("numero_unidad", "medida", "porcentaje", "dosis", "analito_valor", "signo_vital", "termino", "negacion")
_NEEDS = dict.fromkeys(("numero_unidad", "dosis", "analito_valor"), r"\d") | {"medida": r"[xX×]\s*\d", "porcentaje": "%", "signo_vital": r"/\s*\d"}
_WORDS = {"termino": tuple(L.CLINICAL), "negacion": tuple(L.NEGATIONS)}
_STARTS = {"analito_valor": tuple(dict.fromkeys((*L.ANALYTES, *L.VITALS)))}
_EDGES = {"termino": "[a-z0-9]", "negacion": "[a-z]"}
VALUES = [Pattern(k, OTHERS + i, _REGEX[k], folded=True, needs=_NEEDS.get(k, ""), words=_WORDS.get(k, ()), edge=_EDGES.get(k, ""), starts=_STARTS.get(k, ())) for i, k in enumerate(_VALUE_ORDER)]
GUARDS = [p for p in VALUES if p.kind in REASONS]


def vital(matches: DataFrame) -> DataFrame:
    """matches without ratios that no word for blood pressure precedes within 30 characters."""
    near = fold(F.right("before", F.lit(30))).rlike(r"(?U)\b(ta|pa|tension|presion|arterial)\b")
    return matches.where((F.col("kind") != "signo_vital") | near)


def guard() -> Column:
    """What the aggregation of a unit's protected spans collects; null for other kinds."""
    reasons = F.create_map(*(F.lit(x) for k, v in REASONS.items() for x in (k, v)))
    places = F.create_map(*(F.lit(x) for i, k in enumerate(REASONS) for x in (k, i)))
    return F.when(F.col("kind").isin(*REASONS), F.struct(places[F.col("kind")].alias("place"), "start", "end", reasons[F.col("kind")].alias("reason")))


def protect(units: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, unit_seq and protected: the spans (place, start, end, reason) that no
    transformation may touch, of units that have any."""
    found = vital(scan(units, GUARDS, ["doc_id", "unit_seq"], text)).withColumn("p", guard())
    return found.groupBy("doc_id", "unit_seq").agg(F.array_sort(F.collect_list("p")).alias("protected"))


def clash(start: Column, end: Column, protected: Column) -> Column:
    """The reason of the first protected span that a range touches; null if it is free."""
    return F.try_element_at(F.filter(protected, lambda s: overlaps(start, end, s["start"], s["end"])), F.lit(1))["reason"]


def values(units: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id", "unit_seq")) -> DataFrame:
    """The comparable clinical values of units, one row each: keys, class, norm, text,
    context, and ord and start, the order in a text. A stretch of text may hold several."""
    from velum.operators import unitwise

    return unitwise.values(units, list(keys), text)


def class_counts(found: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, class, n."""
    return found.groupBy(*keys, "class").agg(F.count(F.lit(1)).alias("n"))


def preserved_rows(found: DataFrame, most: int = 250) -> DataFrame:
    """The matrix rows of clinical values kept as they are: the first `most` distinct ones of
    each document, without negations and certainty, in the order of the text's values."""
    place = F.struct("unit_seq", "ord", "start")
    kept = found.where(~F.col("class").isin("negacion", "certeza"))
    firsts = kept.groupBy("doc_id", "class", "norm").agg(F.min(place).alias("place"), F.min_by("text", place).alias("text"))
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")))
    shown = clip(F.col("text"), 60)
    return ranked.where(F.col("rank") <= most).select(
        "doc_id", "rank", F.lit("clinico").alias("category"), F.col("class").alias("type"), F.lit("contenido").alias("layer"), shown.alias("finding_masked"), salted_hash(F.col("text")).alias("finding_hash"),
        F.lit("preservar").alias("action"), shown.alias("result"), F.lit("dato clinico: se conserva literal").alias("motive"), F.lit("exacta").alias("clinical_integrity"),
        F.lit("n/a").alias("residual_risk"), F.lit("").alias("path"), F.lit("alta").alias("confidence"), F.lit(False).alias("requires_review"),
    )
