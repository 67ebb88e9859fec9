"""The rules of detect and clinical for one text after the other, as a task runs them over batches.

What detect's column expressions say of matches is said here of one match at a time, so that matches
neither leave their task nor meet again in a shuffle: only the findings that remain do. White space, words and case are those of
the column expressions.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from velum.functions import lexicons as L
from velum.functions.spans import Matcher, Pattern, spread
from velum.functions.text import FOLD_FROM, FOLD_TO
from velum.operators import clinical, detect

#: White space as the column expressions have it.
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_SPACES = re.compile(SPACE + "+")
_ONE_SPACE = re.compile(r"[\t-\r\x85\xa0  -     　]|  ")
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


def _java(pattern: str, flags: int = 0) -> re.Pattern:
    """A pattern of detect, which is written for column expressions."""
    return re.compile(re.sub(r"^\(\?i?U\)", "", pattern).replace(r"\s", SPACE).replace(r"\z", r"\Z"), flags)


_CUT = _java(detect._CUT)
_BEFORE, _AFTER = _java(detect._BEFORE, re.IGNORECASE), _java(detect._AFTER, re.IGNORECASE)
_LETTER = re.compile("[A-Za-zÁ-ÿ]")
_DIGIT = re.compile(r"\d")
_NOT_WORD = re.compile("[^0-9A-Za-z_]")
_PRESSURE = re.compile("ta|tension|pa|presion|arterial")
_NAMES = frozenset((*L.GIVEN_NAMES, *L.SURNAMES))
_FIELDS, _PARTICLES = frozenset(detect.FIELD_LABELS), frozenset(L.PARTICLES)
_SIMPLE = {k: c for k, _, c in detect.DIRECT}
_OWN_START = frozenset("capitals cell age date work institution place".split())
_RULES = {"capitals": "D", "age_label": "A", "date": "T", "work": "I", "insurer": "I", "place": "I"}
_FIXED = {"age_label": "edad", "birth": "fecha_nacimiento", "date": "fecha", "work_label": "ocupacion", "work": "posible_ocupacion", "insurer": "aseguradora", "place": "localidad"}
_NOTES = {"title": "precedido por tratamiento", "age_label": "campo edad", "birth": detect._BIRTH_NOTE, "work_label": "campo ocupacion", "work": detect._MAYBE_WORK}
_CONFIDENCE = {k: "media" for k, c in _SIMPLE.items() if c == "media"} | {"work": "baja", "insurer": "media", "place": "media"}


@lru_cache(1 << 14)
def fold(t: str | None) -> str:
    return (t or "").translate(_FOLD).lower()


def collapse(t: str) -> str:
    return (_SPACES.sub(" ", t) if _ONE_SPACE.search(t) else t).strip(" ")


#: How words of a duration end.
_DURATION_ENDS = frozenset(("ce", "te", "ya", "os", "de"))


def _duration(before: str, after: str) -> bool:
    last = before.rstrip()[-2:]
    return ((last.lower() in _DURATION_ENDS or not last.isascii()) and _BEFORE.search(before) is not None) or _AFTER.match(after[:24]) is not None


def _is_word(c: str) -> bool:
    """Whether a character belongs to a word: letters, marks, figures and connectors."""
    return c.isalpha() or c == "_" or unicodedata.category(c) in ("Nd", "Nl", "Mn", "Mc", "Me", "Pc") or c in "‌‍" or "Ⓐ" <= c <= "ⓩ" or "\U0001f130" <= c <= "\U0001f149" or "\U0001f150" <= c <= "\U0001f169" or "\U0001f170" <= c <= "\U0001f189"


@lru_cache(1 << 14)
def _bare(token: str) -> str:
    return fold(_NOT_WORD.sub("", token) if token.isascii() else "".join(c for c in token if "Á" <= c <= "ÿ" or _is_word(c)))


@lru_cache(1 << 14)
def looks_clinical(value: str) -> bool:
    return any(_bare(t) in L.CLINICAL for t in _SPACES.split(value))


@lru_cache(1 << 14)
def clean_value(value: str) -> str:
    cut = _CUT.search(value)
    return (value[: cut.start()] if cut else value).rstrip(" .;,:-")


@lru_cache(1 << 14)
def name_confidence(value: str) -> str | None:
    tokens = [t for t in _SPACES.split(value) if t]
    if len(tokens) > 6:
        return None
    useful = [t for t in tokens if fold(t) not in _PARTICLES]
    if not useful or any((b := _bare(t)) == "" or b in L.NOT_NAMES or _DIGIT.search(t) for t in useful):
        return None
    known, many = any(fold(t) in _NAMES for t in useful), len(useful) >= 2
    return "alta" if known and many else "media" if known or many else None


@lru_cache(1 << 12)
def label_type(label: str | None) -> str | None:
    return detect.VALUE_LABELS.get(fold(label).strip(" :=.-"))


def _next_field(first: str) -> bool:
    return _SPACES.split(fold(first).strip(" "))[0].strip(":.,") in _FIELDS


@lru_cache(1 << 14)
def _labelled(label: str, value: str) -> tuple[int, str | None, str]:
    clean = clean_value(value)
    return len(clean), label_type(label) if clean and not looks_clinical(clean) else None, f"campo '{fold(label)}'"


@lru_cache(1 << 14)
def _named(label: str, value: str) -> tuple[int, str | None, bool, str]:
    clean = clean_value(value)
    if name_confidence(clean):
        return len(clean), "nombre_persona", True, f"etiqueta: {fold(label)}"
    return len(clean), "campo_identificador_dudoso" if len(clean) > 2 and _LETTER.search(clean) else None, False, f"etiqueta '{fold(label)}' con valor no clasificable"


def _finding(m: tuple, left: str | None) -> tuple | None:
    """What a match is taken alone: type, category, start, end, text, scope_start, scope_end, confidence, detector, note; None if nothing."""
    kind, order, start, end, text, value_start, value, g, before, after = m
    low, high, note, confidence, wide = value_start, value_start + len(value), "", _CONFIDENCE.get(kind, "alta"), order < detect._INDIRECT
    if kind in _SIMPLE:
        type_ = kind
    elif kind == "value_label":
        n, type_, note = _labelled(g[0], value)
        high = low + n
    elif kind == "name_label":
        n, type_, wide, note = _named(g[0], value)
        high, confidence = low + n, "alta" if wide else "baja"
    elif kind == "title":
        clean = clean_value(value)
        high = low + len(clean)
        type_ = "nombre_profesional" if clean and name_confidence(clean) else None
    elif kind in _OWN_START:
        low, high, wide = start, end, wide and kind not in ("capitals", "cell")
        if kind == "capitals":
            sure = name_confidence(text)
            type_ = {"alta": "nombre_persona", "media": "posible_nombre", None: None}[sure]
            confidence = "alta" if sure == "alta" else "media"
            note = "coincide con lexico de nombres/apellidos" if sure == "alta" else "secuencia capitalizada sin respaldo en lexico"
        elif kind == "cell":
            type_ = None if looks_clinical(text) else label_type(left)
            note = f"valor de la celda etiquetada '{fold(left).strip(' ')}'"
        elif kind == "age":
            figures = re.match(r"\d{1,3}", text)
            years = int(figures[0]) if figures and figures[0].isascii() else None
            type_ = "edad" if years is not None and years <= 120 and not _duration(before, after) else None
        elif kind == "institution":
            type_ = None if _next_field(g[0]) else "institucion"
        else:
            type_ = _FIXED[kind]
    else:
        type_ = _FIXED[kind]
        if kind == "work_label":
            high = low + len(_trimmed(value))
        elif kind == "age_label":
            high = end
    if type_ is None or high <= low:
        return None
    note = _NOTES.get(kind, note)
    direct = order < detect._INDIRECT
    scope = (start if wide else low), (high if not wide or kind in ("value_label", "name_label", "title") else end)
    return type_, "directo" if direct else "indirecto", low, high, text[low - start : high - start], *scope, confidence, "directos" if direct else "indirectos", note


_ENDS = re.compile(rf"\A{SPACE}+|{SPACE}+\Z")


def _trimmed(value: str) -> str:
    return _ENDS.sub("", value)


class _Cover:
    """Ranges, of which one look tells whether another meets any. While they are few they are looked through; many are
    kept as what they cover together."""

    __slots__ = ("few", "starts", "ends")
    FEW = 24

    def __init__(self):
        self.few, self.starts, self.ends = [], [], []

    def meets(self, start: int, end: int) -> bool:
        for a, b in self.few:
            if a < end and start < b:
                return True
        if not self.starts:
            return False
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end

    def add(self, start: int, end: int) -> None:
        self.few.append((start, end))
        if len(self.few) > self.FEW:
            for low, high in self.few:
                i, j = bisect_left(self.ends, low), bisect_right(self.starts, high)
                if i < j:
                    low, high = min(low, self.starts[i]), max(high, self.ends[j - 1])
                self.starts[i:j], self.ends[i:j] = [low], [high]
            self.few.clear()


def without_ruled_out(candidates: list[tuple]) -> list[tuple]:
    """The findings of (ord, start, end, kind, finding), in their order, that none before them rules out."""
    direct, ages, dates, indirect = _Cover(), _Cover(), _Cover(), _Cover()
    kept = []
    for order, start, end, kind, h in candidates:
        rule = _RULES.get(kind, "")
        if rule:
            cover = {"D": direct, "A": ages, "T": dates, "I": indirect}[rule]
            if cover.meets(h[2], h[2] + 1) if rule == "A" else cover.meets(start, end):
                continue
        kept.append(h)
        if h[1] == "directo":
            if rule != "D":
                direct.add(h[5], h[6])
        else:
            indirect.add(h[2], h[3])
            if h[0] == "edad":
                ages.add(h[2], h[3])
            elif h[0] in ("fecha", "fecha_nacimiento"):
                dates.add(h[2], h[3])
    return kept


def resolve(found: list[tuple]) -> list[tuple]:
    """One finding for each region: by priority, length, then place, greedily by scope."""
    if len(found) < 2:
        return found
    taken, accepted = _Cover(), []
    for *_, h in sorted((detect.PRIORITY.get(h[0], detect.OTHER_PRIORITY), h[2] - h[3], h[2], i, h) for i, h in enumerate(found)):
        if not taken.meets(h[5], h[6]):
            taken.add(h[5], h[6])
            accepted.append(h)
    return sorted(accepted, key=lambda h: h[2])


def _vital(kind: str, before: str) -> bool:
    """Whether a ratio follows a word for blood pressure; other kinds need none."""
    if kind != "signo_vital":
        return True
    near = fold(before[-30:])
    return any((m.start() == 0 or not _is_word(near[m.start() - 1])) and (m.end() == len(near) or not _is_word(near[m.end()])) for m in _PRESSURE.finditer(near))


_PLACES = {k: i for i, k in enumerate(clinical.REASONS)}
_WHY = tuple(clinical.REASONS.values())


def unit_findings(matches: Iterator[tuple], left: str | None = None, guarded: bool = False) -> list[tuple]:
    """The findings of a text from its matches, resolved; guarded: each with the reason why its place is protected in front."""
    candidates, covers = [], {}
    for m in matches:
        if m[1] >= detect.OTHERS:
            if guarded and _vital(m[0], m[8]):
                covers.setdefault(_PLACES[m[0]], _Cover()).add(m[2], m[3])
        elif (h := _finding(m, left)) is not None:
            candidates.append((m[1], m[2], m[3], m[0], h))
    found = resolve(without_ruled_out(sorted(candidates, key=lambda c: c[:3])))
    if not guarded:
        return found
    order = sorted(covers)
    return [(next((_WHY[p] for p in order if covers[p].meets(h[2], h[3])), None), *h) for h in found]


# ------------------------------------------------------------------ clinical values

_PLAIN_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]{1,6})?\Z")


@lru_cache(1 << 14)
def canonical_number(text: str | None) -> str:
    t = (text or "").replace(",", ".").strip(" ")
    if _PLAIN_NUMBER.match(t) and len(t) <= 15:
        whole, _, rest = t.partition(".")
        rest = rest.rstrip("0")
        return (whole.lstrip("0") or "0") + (f".{rest}" if rest else "")
    try:
        number = float(t) if t.isascii() else None
    except ValueError:
        number = None
    return t if number is None else f"{number:.6f}".rstrip("0").removesuffix(".")


_CLASS = {t: name for name, terms in reversed(clinical.CLASSES.items()) for t in terms}


def clip(t: str, most: int) -> str:
    t = collapse(t)
    return t if len(t) <= most else t[: most - 1] + "…"


def unit_values(matches: Iterator[tuple]) -> Iterator[tuple]:
    """class, norm, text, context, ord, start of a text's clinical values."""
    for kind, order, start, _, text, _, _, groups, before, after in matches:
        if not _vital(kind, before):
            continue
        g = [x or "" for x in groups] + [""] * (4 - len(groups))
        if kind == "numero_unidad":
            norm = f"{canonical_number(g[0])} {g[1].lower()}"
        elif kind == "medida":
            norm = f"{canonical_number(g[0])}x{canonical_number(g[1])}{f'x{canonical_number(g[2])}' if g[2] else ''} {g[3].lower()}"
        elif kind == "porcentaje":
            norm = f"{canonical_number(g[0])} %"
        elif kind == "dosis":
            rhythm = collapse(g[2])
            norm = f"{canonical_number(g[0])} {g[1].lower()}{' ' if rhythm else ''}{rhythm}"
        elif kind == "analito_valor":
            norm = f"{collapse(g[0])}={canonical_number(g[1])}"
        elif kind == "signo_vital":
            norm = f"{g[0]}/{g[1]}"
        else:
            norm = g[0]
        around, at = before + text + after, len(before)
        first = max(0, at - 28)
        yield _CLASS.get(g[0], "termino_clinico") if kind == "termino" else kind, norm, text, clip(around[first : at + len(text) + 28], 90), order, start


# ------------------------------------------------------------------ over tables

_ARROW = {T.StringType(): pa.string(), T.IntegerType(): pa.int32()}
#: Rows that a task hands on at once, texts that it reads at once.
_ROWS, _TEXTS = 20_000, 256


def _rows(units: DataFrame, patterns: list[Pattern], keys: list[str], text: str, columns: list[T.StructField], of_text, left: str | None = None) -> DataFrame:
    """keys and columns: what of_text(matches, text to the left) gives of each text."""
    schema = T.StructType([*(units.schema[k] for k in keys), *columns])
    read = list(dict.fromkeys((*keys, text, *([left] if left else []))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = Matcher(patterns).matches

        def out(b: pa.RecordBatch, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
            made = [pa.array(c, _ARROW[f.dataType]) for c, f in zip(zip(*rows, strict=True), columns, strict=True)]
            return pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(of)) for k in keys), *made], schema.names)

        for whole in batches:
            for at in range(0, whole.num_rows, _TEXTS):
                b = whole.slice(at, _TEXTS)
                rows, of = [], []
                lefts = b.column(left).to_pylist() if left else [None] * b.num_rows
                for i, t in enumerate(b.column(text).to_pylist()):
                    for row in of_text(matches(t), lefts[i]) if t else ():
                        rows.append(row)
                        of.append(i)
                        if len(rows) >= _ROWS:
                            yield out(b, of, rows)
                            rows, of = [], []
                if rows:
                    yield out(b, of, rows)

    return spread(units.select(*read)).mapInArrow(run, schema)


_STRING, _INT = T.StringType(), T.IntegerType()
_FINDING = [
    T.StructField("ord", _INT), T.StructField("type", _STRING), T.StructField("category", _STRING), T.StructField("start", _INT), T.StructField("end", _INT), T.StructField("text", _STRING),
    T.StructField("scope_start", _INT), T.StructField("scope_end", _INT), T.StructField("confidence", _STRING), T.StructField("detector", _STRING), T.StructField("note", _STRING),
]
_VALUE = [T.StructField(n, _STRING) for n in ("class", "norm", "text", "context")] + [T.StructField("ord", _INT), T.StructField("start", _INT)]


def findings(units: DataFrame, keys: list[str], text: str = "text", label: str | None = None, guarded: bool = False, only: tuple[str, ...] = ()) -> DataFrame:
    """keys, ord and the findings of each unit, one row each; guarded: with guard before ord, why a finding's place is protected.

    only: the columns besides keys that are wanted; others never leave the task.
    """
    patterns = [*detect.PATTERNS, *(clinical.GUARDS if guarded else []), *([detect.CELL] if label else [])]

    columns = [*([T.StructField("guard", _STRING)] if guarded else []), *_FINDING]
    at = [next(i for i, c in enumerate(columns) if c.name == name) for name in only]

    def of_text(matches: Iterator[tuple], left: str | None) -> Iterator[tuple]:
        for i, h in enumerate(unit_findings(matches, left, guarded)):
            row = (h[0], i, *h[1:]) if guarded else (i, *h)
            yield tuple([row[k] for k in at]) if at else row

    return _rows(units, patterns, keys, text, [columns[k] for k in at] or columns, of_text, label)


def values(units: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, class, norm, text, context, ord, start: the comparable clinical values of each unit, one row each."""
    return _rows(units, clinical.VALUES, keys, text, _VALUE, lambda matches, _: unit_values(matches))
