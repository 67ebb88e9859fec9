"""Queries over the driver's tables, one or more for each operator. Every one runs over its
whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions import native
from velum.functions.spans import merge_intervals, scan
from velum.functions.text import age_band, canonical_number, fold, mask, normalise, parse_date, safe_file_name, salted_hash
from velum.functions import lexicons as L
from velum.operators import audit, clinical, detect, metadata, policy, risk, verify
from velum.plans import notes as N
from velum.plans import samples as S
from velum.plans import office_run, office_samples, pipeline
from velum.sources import datasource, embedded, files, office, office_write, registry, scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").selectExpr(*(f"{sql} AS {name}" for name, sql in columns.items()))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.units_of(_table(spark, sf_dir, "documents"))


def _matches(df: DataFrame, key: str, text: str, pattern) -> DataFrame:
    """One pattern alone needs no pass of its own kind."""
    return native.matches(df, [key], text, "(?U)" + pattern.regex)


_BY_KIND = {p.kind: p for p in detect.PATTERNS}

# ------------------------------------------------------------------ detection


@query
def analyze_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What identifiers the notes hold, by category, type and confidence."""
    return pipeline.analyze(N.notes(spark, sf_dir))


@query
def analyze_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the documents."""
    return pipeline.analyze(_units(spark, sf_dir))


@query
def initial_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their risk before anything is changed."""
    return _risk(_table(spark, sf_dir, "documents").select("doc_id"), _units(spark, sf_dir))


@query
def initial_risk_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the risk of all their notes before anything is changed."""
    units = N.notes(spark, sf_dir, customer="o_custkey").withColumn("unit_seq", F.col("doc_id").cast("int")).withColumn("doc_id", F.col("customer"))
    return _risk(units.select("doc_id").distinct(), units)


def _risk(docs: DataFrame, units: DataFrame) -> DataFrame:
    found = detect.detect(units, only=("ord",)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    level = risk.initial_risk(F.coalesce("n", F.lit(0)), F.lit(0), F.lit(0), F.lit(0))
    return docs.join(found, "doc_id", "left").groupBy(level.alias("risk")).agg(F.count(F.lit(1)).alias("n"))


def _sampled(family: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        units = _orders(spark, sf_dir, doc_id="o_orderkey", unit_seq="0", text=S.text(S.FAMILIES[family]))
        return detect.detect(units).select("doc_id", "type", "start", "text", "confidence")

    run.__doc__ = f"Sentences of samples.py, one for each order: {family}."
    return run


QUERIES |= {family: _sampled(family) for family in S.FAMILIES}


@query
def detect_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(_table(spark, sf_dir, "documents"), "doc_id", "text", _BY_KIND["email"])


@query
def detect_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(_table(spark, sf_dir, "pages"), "page_id", "url", _BY_KIND["url"])


@query
def detect_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(_table(spark, sf_dir, "documents"), "doc_id", "text", _BY_KIND["ip"])


@query
def detect_url_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs anywhere in the pages themselves."""
    return _matches(_table(spark, sf_dir, "pages"), "page_id", "html", _BY_KIND["url"])


@query
def detect_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day, month and year in figures, before overlaps are resolved."""
    numeric = next(p for p in detect.PATTERNS if p.kind == "date")
    return _matches(_table(spark, sf_dir, "documents"), "doc_id", "text", numeric)


@query
def detect_dates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of all four patterns in documents, and in notes with a month in words before them."""
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    notes = _orders(spark, sf_dir, doc_id="-o_orderkey - 1", text=f"'Control en ' || {S.LONG_DATE} || ' y ' || {S.ISO_DATE} || '. ' || {N.NOTE}")
    both = documents.unionByName(notes)
    found = [_matches(both, "doc_id", "text", p).withColumn("pattern", F.lit(i)) for i, p in enumerate(p for p in detect.PATTERNS if p.kind == "date")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query
def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address in figures also reads as a date; the address wins."""
    text = f"'Acceso desde 70.23.22.' || CAST(o_orderkey % 256 AS STRING) || ' el ' || {N.DATE}"
    units = _orders(spark, sf_dir, doc_id="o_orderkey", unit_seq="0", text=text)
    return detect.detect(units).select("doc_id", "type", "start", "end", "text")


@query
def note_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the notes, labelled ones included."""
    found = ("type", "category", "text", "confidence")
    return detect.detect(N.notes(spark, sf_dir), only=found).select("doc_id", *found)


@query
def conversation_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as units, whole and of all roles: how many findings each conversation has, with an
    address put behind each turn of a user."""
    turns = _table(spark, sf_dir, "conversations")
    address = F.concat(F.lit("\nEscriba a u"), F.col("conv_id").cast("string"), F.lit("@example.org. "))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("role") == "user", address).otherwise(F.lit("")))
    units = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("unit_seq"), text.alias("text"))
    return detect.detect(units).groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("n_distinct"))


@query
def label_from_previous_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as cells of a row: the cell to the left says what a cell holds."""
    label = N.pick("Edad,Ciudad,Ocupación,Nota,EPS", "l_partkey")
    cells = _table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS col", "l_partkey", "l_suppkey", f"CASE WHEN l_linenumber % 2 = 1 THEN {label} ELSE CAST(l_suppkey AS STRING) END AS text")
    from velum.sources.cells import with_left_label

    typed = with_left_label(cells, ["doc_id"], ["col", "l_partkey", "l_suppkey"]).withColumn("type", detect.label_type(F.col("prev_label")))
    return typed.where("type is not null").select("doc_id", "col", "text", "type")


@query
def labelled_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of cells whose left neighbour names them."""
    units = _orders(spark, sf_dir, doc_id="o_orderkey", unit_seq="0", text=f"{N.CITY} || ' centro '", prev_label="CASE WHEN o_orderkey % 2 = 0 THEN 'Ciudad :' ELSE 'Empresa' END")
    return detect.detect(units, previous_label="prev_label").select("doc_id", "type", "text", "start", "end", "note")


# ------------------------------------------------------------------ policy


@query
def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with what identifies removed, as a digest."""
    done = pipeline.process(_units(spark, sf_dir))
    return done.units.select("doc_id", F.sha2("new_text", 256).alias("text_sha256"), F.length("new_text").alias("n_chars"))


@query
def redact_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes after the default purpose."""
    return pipeline.process(N.notes(spark, sf_dir)).units.select("doc_id", "new_text")


@query
def rebuild_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of several units put together again below the notice: turns of a conversation."""
    turns = pipeline.units_of(_table(spark, sf_dir, "conversations"), "conv_id", "text", "turn").withColumn("new_text", F.concat(F.col("unit_seq").cast("string"), F.lit(": "), "text"))
    return pipeline.rebuilt(turns).select("doc_id", F.sha2("body", 256).alias("body_sha256"))


@query
def purpose_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each purpose does with each type of finding."""
    decided = policy.decide_for(pipeline.annotate(N.notes(spark, sf_dir)))
    return decided.groupBy("purpose", "type", "action").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("review"), 1)).alias("n_review"))


@query
def strait_jacket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that clinical content blocks."""
    decided = policy.decide(pipeline.annotate(N.notes(spark, sf_dir)))
    return decided.where(F.col("action") == policy.BLOCKED).select("doc_id", "type", "text", "result", "reason", "review", "applied")


@query
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names within a customer's orders, numbered by first appearance."""
    note = "CASE WHEN o_orderkey % 2 = 0 THEN 'etiqueta: paciente' ELSE 'etiqueta: acudiente' END"
    found = _orders(spark, sf_dir, doc_id="o_custkey", unit_seq="CAST(o_orderkey AS INT)", start="0", type="'nombre_persona'", text=N.pick("Juan,Ana,Carlos,Laura,Pedro,Rosa", "o_orderkey"), note=note)
    return policy.pseudonyms(found).select("doc_id", F.col("unit_seq").cast("long").alias("orderkey"), "text", "pseudonym")


@query
def relative_chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's order dates as days of their own."""
    found = _orders(spark, sf_dir, doc_id="o_custkey", orderkey="o_orderkey", type="'fecha'", text=N.DATE)
    return policy.relative_days(found).select("doc_id", "orderkey", "day")


@query
def sector_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = F.expr(N.pick("Docente,MINERO,astronauta,ama  de  casa,Médico,albañil", "o_orderkey"))
    sector = F.try_element_at(F.create_map(*(F.lit(x) for k, v in L.SECTORS.items() for x in (k, v))), normalise(work))
    return _table(spark, sf_dir, "orders").groupBy(work.alias("work"), F.coalesce(sector, F.lit("[OCUPACION NO CLASIFICADA]")).alias("sector")).agg(F.count(F.lit(1)).alias("n"))


@query
def region_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.expr(N.pick("Bogotá,cali,Santa Marta,Springfield,Málaga,Antioquia", "o_orderkey"))
    region = F.try_element_at(F.create_map(*(F.lit(x) for k, v in L.REGIONS.items() for x in (k, v))), normalise(place))
    return _table(spark, sf_dir, "orders").groupBy(place.alias("place"), F.coalesce(region, F.lit("[LOCALIDAD]")).alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query
def matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transformation matrix of the notes: masked and hashed."""
    matrix = pipeline.process(N.notes(spark, sf_dir)).matrix
    return matrix.select("doc_id", *(c for c in audit.MATRIX if c not in ("path", "motive")))


@query
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the matrix by category, type and action, with subtotals."""
    return audit.counts(pipeline.process(N.notes(spark, sf_dir)).matrix)


# ------------------------------------------------------------------ clinical content


def _terms(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """doc_id, term of the documents' words of one list."""
    pattern = next(p for p in clinical.VALUES if p.kind == kind)
    return scan(_table(spark, sf_dir, "documents"), [pattern], ["doc_id"]).select("doc_id", F.col("g")[0].alias("term"))


@query
def clinical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clinical terms of the documents, by term."""
    return _terms(spark, sf_dir, "termino").groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_documents"))


@query
def negations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _terms(spark, sf_dir, "negacion").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query
def value_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around values: 28 characters on both sides."""
    found = clinical.values(N.notes(spark, sf_dir)).where("class in ('analito_valor', 'medicamento')")
    return found.select("doc_id", "class", "text", "context")


@query
def clinical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clinical.values(N.notes(spark, sf_dir)).select("doc_id", "class", "norm")


@query
def clinical_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clinical.values(N.notes(spark, sf_dir))
    return found.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("norm").alias("n_values"))


@query
def protected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clinical.protect(N.notes(spark, sf_dir))
    return found.select("doc_id", F.explode("protected").alias("p")).groupBy("p.reason").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p.end") - F.col("p.start")).alias("chars"))


@query
def preserved_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix rows of clinical values that are kept."""
    return clinical.preserved_rows(clinical.values(N.notes(spark, sf_dir))).select("doc_id", "type", F.lower("result").alias("result"), "action", "finding_hash")


# ------------------------------------------------------------------ verification


def _altered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    units = N.notes(spark, sf_dir, new_text=N.ALTERED)
    return units, clinical.values(units), clinical.values(units, "new_text")


@query
def integrity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes against their altered copies: values that changed, went or came."""
    _, before, after = _altered(spark, sf_dir)
    return verify.integrity_verdict(verify.integrity(before, after))


@query
def integrity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of values taken for each other."""
    _, before, after = _altered(spark, sf_dir)
    rows = verify.integrity(before, after).where("state = 'UNEXPECTED_CHANGE'")
    return rows.select("doc_id", "class", "norm", "other", "n")


@query
def unsupported_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the altered notes with values that the notes do not hold."""
    units, before, _ = _altered(spark, sf_dir)
    found = verify.unsupported(units, before)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("n").alias("n_values"))


@query
def adversarial_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """De-identified notes, some of which have the identity number put back."""
    units = N.notes(spark, sf_dir, leak=f"CASE WHEN o_orderkey % 17 = 0 THEN ' ' || {N.IDENTITY} ELSE '' END")
    done = pipeline.process(units).cached()
    spoilt = done.units.withColumn("new_text", F.concat("new_text", "leak"))
    found = verify.attack(units, verify.reappearing(spoilt, done.decided), verify.residual(spoilt, done.decided))
    return found.select("doc_id", "n_leaks", "n_residual", "n_metadata", "verdict")


@query
def metadata_neutrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which metadata of a result say nothing of a person."""
    key, value = F.expr(N.pick("dc:creator,dcterms:created,Application,company,title", "o_orderkey")), F.expr(N.pick("Ana Rojas,DOCX,documento desidentificado 7", "o_custkey"))
    rows = _table(spark, sf_dir, "orders").select(key.alias("key"), value.alias("value"))
    return rows.groupBy("key", "value", verify.neutral_metadata(F.col("key"), F.col("value")).alias("neutral")).agg(F.count(F.lit(1)).alias("n"))


@query
def context_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the quasi-identifiers that a purpose keeps reveal together."""
    return verify.combination(policy.decide(pipeline.annotate(N.notes(spark, sf_dir)), "interconsulta"))


@query
def residual_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk and state of each note after the whole run."""
    units = N.notes(spark, sf_dir)
    found = pipeline.check(units, pipeline.process(units).cached())
    return found.select("doc_id", "attack", "n_blocked", "n_exact", "risk", "state")


@query
def review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of orders as documents whose checks the keys give."""
    facts = _orders(spark, sf_dir, doc_id="o_orderkey", attack="CASE WHEN o_orderkey % 19 = 0 THEN 'FAIL' WHEN o_orderkey % 3 = 0 THEN 'REVISAR' ELSE 'PASS' END", integrity_blocks="o_orderkey % 23 = 0",
                    n_marked="CAST(o_orderkey % 2 AS BIGINT)", scanned="o_orderkey % 29 = 0", context_level="CASE WHEN o_custkey % 31 = 0 THEN 'alto' END")
    found = risk.review_state(risk.assess(facts))
    return found.groupBy("risk", "state").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("reasons")).alias("n_reasons"))


@query
def human_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last review of each customer's document decides its state."""
    reviews = _orders(spark, sf_dir, doc_id="o_custkey", state="CASE WHEN o_orderkey % 3 = 0 THEN 'REJECTED_BY_HUMAN' ELSE 'APPROVED_BY_HUMAN' END", reviewer="'r' || CAST(o_orderkey % 5 AS STRING)", at="o_orderkey")
    docs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit("PENDING_REVIEW").alias("state"))
    return audit.current_state(docs, reviews)


# ------------------------------------------------------------------ functions


@query
def mask_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", mask(F.col("c_name")).alias("masked"), salted_hash(F.col("c_name")).alias("hash"))


@query
def fold_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2(fold(F.col("text")), 256).alias("folded_sha256"), F.length(normalise(F.col("text"))).alias("n_normal"))


@query
def age_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").groupBy(age_band(F.col("p_size") * 3 - 5).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as people write them; those that no calendar has are null."""
    months = "enero,febrero,marzo,abril,mayo,junio,julio,agosto,setiembre,octubre,noviembre,diciembre"
    month = f"split_part('{months}', ',', month(o_orderdate))"
    text = f"""CASE o_orderkey % 5 WHEN 0 THEN {N.DATE} WHEN 1 THEN CAST(year(o_orderdate) AS STRING) || '-' || CAST(month(o_orderdate) AS STRING) || '-' || CAST(day(o_orderdate) AS STRING)
    WHEN 2 THEN CAST(day(o_orderdate) AS STRING) || ' de ' || {month} || ' de ' || CAST(year(o_orderdate) AS STRING) WHEN 3 THEN {month} || ' de ' || CAST(year(o_orderdate) AS STRING) ELSE '31/02/24' END"""
    parsed = _orders(spark, sf_dir, doc_id="o_orderkey", text=text).withColumn("d", parse_date(F.col("text")))
    return parsed.select("doc_id", F.col("d.date").cast("string").alias("date"), F.col("d.grain").alias("grain"))


@query
def number_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal commas and zeros at the end in one form."""
    text = F.replace(F.format_string("%.2f", "l_extendedprice"), F.lit("."), F.lit(","))
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", canonical_number(text).alias("number"))


@query
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with marks, ligatures, wide and raised characters, fractions, other scripts, none at all, and long ones."""
    last = N.pick(S.FILE_NAMES, "page_id")
    path = F.concat("url", F.lit("/"), F.expr(last), F.col("page_id").cast("string"), F.lit(".TXT"))
    return _table(spark, sf_dir, "pages").select("page_id", safe_file_name(path).alias("name"))


@query
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as intervals, joined where they touch."""
    events = _table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("start"), F.floor(F.coalesce("value", F.lit(0.0)) * 60).alias("long"))
    return merge_intervals(events.select("user_id", "start", (F.col("start") + F.abs("long")).alias("end")), ["user_id"])


@query
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which inputs are let in, and why others are not: pages as files with contents."""
    from velum.sources.files import admit

    name = F.expr("concat('f', cast(page_id as string), CASE page_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.docx' WHEN 2 THEN '.exe' ELSE '.pdf' END)")
    content = F.expr("CASE WHEN page_id % 7 = 0 THEN X'' WHEN page_id % 5 = 0 THEN concat(X'504B0304', cast(html as binary)) WHEN page_id % 8 = 4 THEN concat(cast('a' as binary), X'00') ELSE cast(html as binary) END")
    files = _table(spark, sf_dir, "pages").select(name.alias("path"), content.alias("content"))
    return admit(files).groupBy("format", "reject").agg(F.count(F.lit(1)).alias("n"))


@query
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts decoded from bytes in two encodings, as units."""
    from velum.sources.files import decode_text

    content = F.expr("CASE WHEN page_id % 2 = 0 THEN concat(X'EFBBBF', encode(concat('añil ', url), 'UTF-8')) ELSE encode(concat('añil ', url), 'ISO-8859-1') END")
    return _table(spark, sf_dir, "pages").select("page_id", decode_text(content).alias("text"))


# ------------------------------------------------- metadata, verdicts, policy cases


def _metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's fields, one for each order of a customer."""
    return _orders(spark, sf_dir, doc_id="o_custkey", key=f"{S.FIELD} || '.' || CAST(o_orderkey AS STRING)", field=S.FIELD, value=S.FIELD_VALUE)


@query
def metadata_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field of a file that is not empty is a finding."""
    found = metadata.findings(_metadata(spark, sf_dir).withColumn("key", F.col("field")))
    return found.select("doc_id", "category", "type", "text", "end", "layer", "path", "confidence", "note")


@query
def metadata_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metadata.matrix(metadata.findings(_metadata(spark, sf_dir)))
    return rows.select("doc_id", "path", "finding_masked", "finding_hash", "action", "result", "motive", "residual_risk", "requires_review")


@query
def attack_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every branch of the verdict on a result: leaks, graphic codes, metadata, findings, unreadable."""
    docs = _orders(spark, sf_dir, doc_id="o_orderkey")
    leaks, codes, unreadable = docs.where("doc_id % 7 = 0"), docs.where("doc_id % 11 = 0"), docs.where("doc_id % 13 = 0")
    left = docs.where("doc_id % 5 = 0").withColumn("leaked", F.col("doc_id") % 10 == 0)
    fields = _orders(spark, sf_dir, doc_id="o_orderkey", key=S.FIELD, value="CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'Libro desidentificado' ELSE 'Persona ' || CAST(o_custkey AS STRING) END")
    found = verify.attack(docs, leaks, left, fields.unionByName(docs.where("doc_id % 4 = 0").selectExpr("doc_id", "'author' AS key", "'Ana Rojas' AS value")), codes, unreadable, author="ANA ROJAS")
    return found.select("doc_id", "n_leaks", "n_residual", "n_metadata", "n_codes", "author_declared", "verdict")


@query
def context_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quasi-identifiers that are left, at every level: an order is a finding of its customer."""
    action = "CASE WHEN o_orderkey % 4 = 0 THEN 'generalizar' ELSE 'preservar' END"
    decided = _orders(spark, sf_dir, doc_id="o_custkey", type=S.QUASI, text="CAST(o_orderkey AS STRING)", action=action)
    return verify.combination(decided).select("doc_id", "score", "level", "kinds")


@query
def policy_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every type that a policy knows and one that it does not, in layers that can be rewritten,
    that cannot, and that go as a whole."""
    span = "CAST(NULL AS ARRAY<STRUCT<place:INT,start:INT,end:INT,reason:STRING>>)"
    found = _orders(
        spark, sf_dir, doc_id="o_orderkey", unit_seq="0", ord="0", category="'directo'", type=S.KIND, text="'Medellin'", start="0", end="8", scope_start="0", scope_end="8",
        confidence="'alta'", detector="'x'", note="''", layer=S.LAYER, path="''", editable=f"{S.LAYER} = 'contenido'", protected=span,
    )
    decided = policy.decide(found, dropped_layers=("comentario",))
    return policy.matrix(decided).select("doc_id", "type", "layer", "action", "motive", "residual_risk", "requires_review")


@query
def aggressive_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubtful findings, replaced because the user asks for it."""
    span = "CAST(NULL AS ARRAY<STRUCT<place:INT,start:INT,end:INT,reason:STRING>>)"
    doubtful = "split_part('posible_nombre,campo_identificador_dudoso,posible_ocupacion', ',', CAST(o_orderkey % 3 + 1 AS INT))"
    found = _orders(
        spark, sf_dir, doc_id="o_orderkey", unit_seq="0", ord="0", category="'directo'", type=doubtful, text="'Zenon'", start="0", end="5", scope_start="0", scope_end="5",
        confidence="'media'", detector="'x'", note="''", layer="'contenido'", path="''", editable="true", protected=span,
    )
    return policy.decide(found, aggressive=True).select("doc_id", "type", "action", "review", "applied")


@query
def rebuild_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was to be written against what is read back; of every third order nothing was to be."""
    units, _, _ = _altered(spark, sf_dir)
    expected = units.withColumn("text", F.when(F.col("doc_id") % 3 != 0, F.col("text")))
    return verify.rebuild_check(expected, units.withColumn("text", F.when(F.col("doc_id") % 3 != 0, F.col("new_text"))), "text")


@query
def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notice within a result, by purpose and wish."""
    cases = [(p, s, pipeline.notice(p, s)) for p in policy.PURPOSES for s in (True, False)]
    wished = spark.createDataFrame(cases, "purpose string, stamped boolean, notice string")
    return _orders(spark, sf_dir, doc_id="o_orderkey", purpose=S.PURPOSE, stamped="o_orderkey % 7 <> 0").join(F.broadcast(wished), ["purpose", "stamped"])


@query
def clinical_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vital signs, measurements and percentages; a ratio that no blood pressure precedes is none."""
    units = _orders(spark, sf_dir, doc_id="o_orderkey", unit_seq="0", text=S.text(S.CLINICAL))
    return clinical.values(units).where(F.col("class").isin("signo_vital", "medida", "porcentaje")).select("doc_id", "class", "norm")


@query
def expected_transformations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that went with what was replaced and came with its replacement are expected."""
    def found(sql: str) -> DataFrame:
        return clinical.values(_orders(spark, sf_dir, doc_id="o_orderkey", unit_seq="0", text=sql))

    level = "CAST(o_orderkey % 50 + 10 AS STRING) || ' kg'"
    rows = verify.integrity(found(f"'pesa ' || {level}"), found("'pesa 99 kg'"), found(level), found("'99 kg'"))
    return rows.where("class = 'numero_unidad'").select("doc_id", "state", "norm", "n")


@query
def files_without_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admitted text files that gave no unit, of files made from the pages."""
    made = _table(spark, sf_dir, "pages").selectExpr("concat('p', page_id, '.txt') AS path", "encode(url, 'UTF-8') AS content")
    found = registry.units(made).where("cast(regexp_extract(path, '[0-9]+', 0) AS int) % 3 <> 0")
    return registry.without_content(made, found)


@query
def intact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _table(spark, sf_dir, "pages").selectExpr("page_id", "concat('p', page_id, '.txt') AS path", "encode(url, 'UTF-8') AS content")
    after = before.where("page_id % 5 <> 0").withColumn("content", F.when(F.col("page_id") % 3 == 0, F.lit(b"changed")).otherwise(F.col("content")))
    return registry.intact(before, after)


@query
def audit_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read back from the audit documents of the notes."""
    units = N.notes(spark, sf_dir)
    results = units.select("doc_id", F.lit("BAJO").alias("risk"), F.array(F.lit("x")).alias("reasons"), F.lit("PENDING_REVIEW").alias("state"), F.lit(7).alias("n_exact"))
    made = audit.documents_json(results, pipeline.process(units).matrix, {"id": "r1"})

    def read(path: str, kind: str = "string") -> Column:
        return F.get_json_object("audit", path).cast(kind)

    return made.select(
        "doc_id", read("$.run.id").alias("run"), read("$.transformations.total", "long").alias("total"), F.coalesce(read("$.transformations.by_action.generalizar", "long"), F.lit(0)).alias("n_generalised"),
        read("$.transformations.matrix[0].type").alias("first_type"), read("$.clinical_integrity.exact", "long").alias("n_exact"), read("$.residual_risk.risk").alias("risk"), read("$.state").alias("state"),
    )


@query
def office_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units of Word and Excel files made from the customers."""
    return office.units(office_samples.files(spark, sf_dir)).select("path", "layer", "text", "editable", "prev_label")


@query
def office_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What such files hold beside their text."""
    found = office.inspect(office_samples.files(spark, sf_dir))
    return found.withColumn("alerts", F.array_join("alerts", ",")).drop("doc_id")


@query
def office_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their properties and authors as findings."""
    found = office.metadata(office_samples.files(spark, sf_dir))
    return metadata.findings(found).select(F.col("path").alias("key"), "text", "note")


@query
def pdf_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What PDF files made from the customers say of themselves."""
    return embedded.pdf_metadata(office_samples.media(spark, sf_dir)).select("path", "key", "value")


@query
def pdf_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedded.pdf_alerts(office_samples.media(spark, sf_dir)).select("path", "level", "code", "n")


@query
def image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What images made from the customers say of themselves, as findings."""
    found = metadata.findings(embedded.image_metadata(office_samples.media(spark, sf_dir)))
    return found.select("doc_id", F.col("path").alias("key"), "text", "note").drop("doc_id")


@query
def files_told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and alerts of files of all formats in one pass of the handlers, counted."""
    both = office_samples.media(spark, sf_dir).unionByName(office_samples.reports(spark, sf_dir))
    said = registry.metadata(both).groupBy("handler", F.col("key").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_documents"))
    alarmed = registry.alerts(both).groupBy("handler", F.col("code").alias("what")).agg(F.sum("n").alias("n"), F.countDistinct("doc_id").alias("n_documents"))
    return said.unionByName(alarmed)


@query
def matrix_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix file of each note, by its bytes; every third result holds marks of the format."""
    marks = F.when(F.col("doc_id") % 3 == 0, F.concat("result", F.lit('; "x"'))).otherwise(F.col("result"))
    matrix = pipeline.process(N.notes(spark, sf_dir)).matrix.where("type in ('documento_identidad', 'email')")
    return audit.matrix_files(matrix.withColumn("result", marks)).select("doc_id", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))


@query
def markdown_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown summaries of documents whose checks follow from their keys."""
    facts = _orders(
        spark, sf_dir, doc_id="o_orderkey", risk="CASE WHEN o_orderkey % 4 = 0 THEN 'ALTO' ELSE 'BAJO' END", state="'PENDING_REVIEW'", reasons="CASE WHEN o_orderkey % 2 = 0 THEN array('uno', 'dos') ELSE array() END",
        attack="CASE WHEN o_orderkey % 4 = 0 THEN 'FAIL' ELSE 'PASS' END", integrity_blocks="o_orderkey % 5 = 0", format="'docx'", intact="o_orderkey % 3 = 0",
    )
    actions = _orders(spark, sf_dir, doc_id="o_orderkey", action="explode(array('eliminar', 'sustituir', 'eliminar'))").where("doc_id % 2 = 0")
    alerts = _orders(spark, sf_dir, doc_id="o_orderkey", level="'critica'", code="'MACROS'", message="'m'").where("doc_id % 7 = 0")
    return audit.markdown(facts, actions, alerts, {"id": "r1", "purpose": "educacion"}).select("doc_id", F.sha2("summary", 256).alias("sha256"))


def _written(spark: SparkSession, sf_dir: str, name: str) -> tuple[office_run.Run, DataFrame]:
    """A run over reports made from the customers, and the listing of the files that it wrote."""
    run = office_run.process(office.listing(office_samples.reports(spark, sf_dir)).persist()).cached()
    folder = scratch.folder(spark, name)
    datasource.write(run.trees, folder)
    return run, datasource.read(spark, folder)


@query
def office_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports and sheets, de-identified, written anew and read again: texts, places and styles."""
    run, written = _written(spark, sf_dir, "round_trip")
    found = written.where("uid is not null").drop("path").join(run.trees.select("name", "path"), "name")
    return found.select("path", "uid", "kind", F.coalesce("style", F.lit("")).alias("style"), "text")


@query
def office_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What written files say of themselves, and what else they hold: nothing."""
    run, written = _written(spark, sf_dir, "properties")
    found = written.where("uid is null").drop("path").join(run.trees.select("name", "format"), "name")
    return found.groupBy("format", "kind", "part", "text").agg(F.count(F.lit(1)).alias("n"))


@query
def office_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the originals hold beside their texts, and how grave that is."""
    return office.alerts(office.listing(office_samples.reports(spark, sf_dir))).select("path", "level", "code", "n")


@query
def office_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk and state of reports after the written files were read again; macros and embedded objects raise it."""
    run, written = _written(spark, sf_dir, "check")
    checked = office_run.check(run, written).join(run.trees.select("doc_id", "path"), "doc_id")
    return checked.select("path", "attack", "rebuild", F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"), "n_critical_alerts", "risk", "state")


@query
def office_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts taken out of the originals, and what is left to be read of them."""
    clean = office_write.sanitise(office_samples.reports(spark, sf_dir))
    left = office.listing(clean.select("path", "content")).where("kind in ('property', 'author') or part like 'word/comments%'")
    told = left.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "part", "text"))), ",").alias("told"))
    return clean.select("path", F.array_join("removed", ",").alias("removed")).join(told, "path", "left")


def _customers_in_parquet(content: bytes) -> list[tuple]:
    """A reader of a format that the library does not know: a text for each row."""
    import io

    import pyarrow.parquet as pq

    table = pq.read_table(io.BytesIO(content), columns=["c_custkey", "c_name"]).to_pylist()
    return [("rows", "text", None, 0, r["c_name"], str(r["c_custkey"]), "", 1, i) for i, r in enumerate(table)]


@query
def user_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a format added from outside; the filter on the name keeps other files closed."""
    found = datasource.read(spark, sf_dir, {".parquet": _customers_in_parquet}).where("name = 'customer.parquet'")
    return found.select("name", F.col("uid").cast("long").alias("c_custkey"), "text")


@query
def pdf_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active content that PDF files name, and whether they seem to be scans."""
    body = "concat('%PDF-1.4 ', CASE CAST(page_id % 4 AS INT) WHEN 0 THEN '/JavaScript x' WHEN 1 THEN '/Launch /OpenAction' WHEN 2 THEN '/EmbeddedFile' ELSE 'plain' END)"
    made = _table(spark, sf_dir, "pages").selectExpr("page_id", "concat('p', page_id, '.pdf') AS path", f"encode({body}, 'UTF-8') AS content")
    seen = files.scanned(F.col("page_id") % 3, F.col("page_id") % 5 * 60, F.col("page_id") % 2)
    return files.pdf_marks(made).join(made.select("path", seen.alias("scanned")), "path").select("path", F.array_join("marks", ",").alias("marks"), "scanned")
