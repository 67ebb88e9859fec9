"""Which handler reads which format, and files of all formats as one table of units."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.sources import embedded, office
from velum.sources import files as plain


@dataclass(frozen=True)
class Handler:
    """units: admitted files -> doc_id, unit_seq, layer, path, editable, text; rebuilt: how much of
    a file can be written again; dropped: layers that a rebuilt file never holds; metadata: files -> doc_id,
    path, key, value; alerts: files -> doc_id, path, level, code, message, n."""

    name: str
    formats: tuple[str, ...]
    units: Callable[[DataFrame], DataFrame] | None
    rebuilt: str
    dropped: tuple[str, ...] = ()
    metadata: Callable[[DataFrame], DataFrame] | None = None
    alerts: Callable[[DataFrame], DataFrame] | None = None


HANDLERS = (
    Handler("text", (".txt", ".md"), plain.text_units, "completa", ("nombre_archivo",)),
    Handler("office", (".docx", ".xlsx"), office.units, "completa", ("metadatos", "comentario", "control_cambios"), office.metadata, lambda files: office.alerts(office.listing(files))),
    Handler("pdf", (".pdf",), None, "no_soportada", (), embedded.pdf_metadata, embedded.pdf_alerts),
    Handler("image", (".png", ".jpg", ".jpeg"), None, "no_soportada", (), embedded.image_metadata),
)


def handler_for(extension: str) -> Handler | None:
    return next((h for h in HANDLERS if extension.lower() in h.formats), None)


def _of_all(files: DataFrame, what: str) -> DataFrame:
    """What all handlers have of files. Each filters by extension, so a file is read by one of them."""
    out = None
    for h in HANDLERS:
        if read := getattr(h, what):
            found = read(files).withColumn("handler", F.lit(h.name))
            out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out


def units(files: DataFrame) -> DataFrame:
    """The units of all admitted files (path, content) whose handler reads text."""
    return _of_all(files, "units")


def metadata(files: DataFrame) -> DataFrame:
    """doc_id, path, key, value, handler: what files of all formats say of themselves."""
    return _of_all(files, "metadata")


def alerts(files: DataFrame) -> DataFrame:
    """doc_id, path, level, code, message, n, handler of files of all formats."""
    return _of_all(files, "alerts")


def without_content(files: DataFrame, found: DataFrame) -> DataFrame:
    """path, reject, risk, state of admitted files that gave neither units nor metadata."""
    admitted = plain.admit(files).where("reject is null").select("path")
    return admitted.join(found.select("path").distinct(), "path", "left_anti").select(
        "path", F.lit("No se pudo extraer contenido del archivo.").alias("reject"), F.lit("NO_EVALUABLE").alias("risk"), F.lit("REQUIRES_MANUAL_REVIEW").alias("state")
    )


def intact(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, intact: whether each file's content is after a run what it was before (path, content)."""
    old, new = (df.select("path", F.sha2("content", 256).alias(name)) for df, name in ((before, "old"), (after, "new")))
    return old.join(new, "path", "left").select("path", F.col("old").eqNullSafe(F.col("new")).alias("intact"))
