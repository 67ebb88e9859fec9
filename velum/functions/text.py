"""Scalar text functions, Column to Column. Offsets count code points."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The accents that folding drops, one character each.
ACCENTED = "áàäâãéèëêíìïîóòöôõúùüûñçÁÀÄÂÃÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇ"
PLAIN = "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"
#: What folding replaces before it lowers; the last letter would become two.
FOLD_FROM, FOLD_TO = ACCENTED + "İ", PLAIN + "i"

#: Put before an identifier when it is hashed; a run may use its own.
SALT = "velum-local-v1"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(text: Column) -> Column:
    """Lower case without accents; as long as the text."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), FOLD_FROM, FOLD_TO))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalise(text: Column) -> Column:
    """Folded, with white space collapsed: the form that hashes and look-ups use."""
    return collapse(fold(text))


def clip(text: Column, most: int = 120) -> Column:
    return let(collapse(F.coalesce(text, F.lit(""))), lambda t: F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 1), F.lit("…"))))


def context(text: Column, start: Column, end: Column, window: int = 28) -> Column:
    first = F.greatest(F.lit(0), start - window)
    return clip(text.substr(first + 1, end + window - first), 90)


def mask(text: Column, visible: int = 2) -> Column:
    """The first characters and the last; stars for the rest."""

    def masked(t: Column) -> Column:
        n = F.length(t)
        return (
            F.when(n <= 2, F.repeat(F.lit("*"), n))
            .when(n <= visible + 1, F.concat(F.substring(t, 1, 1), F.repeat(F.lit("*"), n - 1)))
            .otherwise(F.concat(F.substring(t, 1, visible), F.repeat(F.lit("*"), n - visible - 1), F.right(t, F.lit(1))))
        )

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", ""), masked)


def salted_hash(text: Column, salt: str = SALT) -> Column:
    """16 hex digits that track an identifier without showing it."""
    return F.substring(F.sha2(F.concat(F.lit(salt), normalise(text)), 256), 1, 16)


def canonical_number(text: Column) -> Column:
    """A decimal comma becomes a point; six decimals at most, no zeros at the end."""

    def shown(t: Column) -> Column:
        number = t.try_cast("double")
        fixed = F.format_string("%.6f", number)
        return F.when(number.isNull(), t).otherwise(F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", ""))

    return let(F.trim(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit("."))), shown)


def age_band(age: Column) -> Column:
    decade = F.floor(age / 10).cast("int") * 10
    return (
        F.when((age < 0) | (age > 120), "[EDAD]")
        .when(age >= 90, "90 anos o mas")
        .when(age < 1, "menor de 1 ano")
        .otherwise(F.concat(decade.cast("string"), F.lit("-"), (decade + 9).cast("string"), F.lit(" anos")))
    )


_MONTH_NUMBERS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


def parse_date(text: Column) -> Column:
    """struct(date, grain): grain is dia, or mes for a month alone; null if it is no date."""
    months = F.create_map(*(F.lit(x) for i, m in enumerate(_MONTH_NUMBERS) for x in (m, i + 1)), F.lit("setiembre"), F.lit(9))

    def day(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    def parsed(t: Column) -> Column:
        def group(pattern: str, i: int) -> Column:
            return F.regexp_extract(t, pattern, i)

        dmy, ymd = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})$", r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$"
        long, month = r"(?iu)^(\d{1,2})\s+de\s+([a-záéíóú]+)\s+(?:de[l]?\s+)?(\d{4})$", r"(?iu)^([a-záéíóú]+)\s+(?:de[l]?\s+)?(\d{4})$"
        year = F.when(F.length(group(dmy, 3)) == 2, F.concat(F.lit("20"), group(dmy, 3))).otherwise(group(dmy, 3))
        number = F.when(t.rlike(long), F.try_element_at(months, normalise(group(long, 2))))
        alone = F.when(t.rlike(month), F.try_element_at(months, normalise(group(month, 1))))
        date = (
            F.when(t.rlike(dmy), day(year, group(dmy, 2), group(dmy, 1)))
            .when(t.rlike(ymd), day(group(ymd, 1), group(ymd, 2), group(ymd, 3)))
            .when(number.isNotNull(), day(group(long, 3), number, group(long, 1)))
            .when(alone.isNotNull(), day(group(month, 2), alone, F.lit("1")))
        )
        by_month = ~t.rlike(dmy) & ~t.rlike(ymd) & ~t.rlike(long) & t.rlike(month)
        return F.when(date.isNotNull(), F.struct(date.alias("date"), F.when(by_month, "mes").otherwise("dia").alias("grain")))

    return let(collapse(F.coalesce(text, F.lit(""))), parsed)


@F.arrow_udf(T.StringType())
def without_marks(text: pa.Array) -> pa.Array:
    """The compatibility decomposition (NFKD) without its combining marks."""
    form = pc.utf8_normalize(text, "NFKD")
    if not pc.any(pc.invert(pc.string_is_ascii(form))).as_py():
        return form
    return pa.array([t if t is None or t.isascii() else "".join(c for c in t if not unicodedata.combining(c)) for t in form.to_pylist()], text.type)


def safe_file_name(name: Column) -> Column:
    """Base name of plain characters: at most 90, and 8 behind the last point. Letters with marks, ligatures and
    other forms of plain characters become those."""
    base = F.regexp_replace(F.coalesce(name, F.lit("")), r"^.*[/\\]", "")
    plain = F.btrim(F.regexp_replace(without_marks(base), r"[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    whole = F.when(plain == "", "documento").otherwise(plain)
    stem, extension = F.regexp_extract(whole, r"^(.*?)(?:\.([^.]*))?$", 1), F.regexp_extract(whole, r"\.([^.]*)$", 1)
    stem = F.when(stem == "", "documento").otherwise(F.substring(stem, 1, 90))
    return F.when(extension == "", stem).otherwise(F.concat(stem, F.lit("."), F.substring(F.lower(extension), 1, 8)))
