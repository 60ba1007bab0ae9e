"""Signature fields, their certificates and what they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import pdf_date
from quire.functions.values import (
    algorithm_name,
    byte_range_coverage,
    eku_name,
    key_usage_names,
    signature_kind,
)
from quire.operators.graph import NODE, NodeReader, first_sight
from quire.operators.objects import name_of
from quire.operators.scan import DEFAULT_SKEW, Skew, row_numbers
from quire.session import materialize

FIELD = ["doc_id", "field_name"]
# Notes on signature rows. None of them is a trust verdict.
TRUST_NOTE = "trust not verified - structural decomposition only"
NO_SIGNER_NOTE = "signer certificate not present in the embedded set"
NOT_DECOMPOSED_NOTE = "subFilter not decomposed"


def _no_path() -> Column:
    return F.array().cast("array<string>")


def field_tree(entries: DataFrame, tops: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Terminal signature fields in document order.

    ``tops`` has ``doc_id, obj_id, idx``: the form's top fields. Kids with a name
    are fields, kids without are widgets. Names are joined by dots, the field
    type is inherited, each field is read once, where a depth-first reader meets it
    first, so every walk ends. Fields below
    ``max_depth`` are left out if it is given.
    """
    reader = NodeReader(entries)
    own = reader.table(["T", "FT"], resolve=True).select(*NODE, F.struct(
        F.coalesce(F.when(F.col("T")["value_type"] == "string", F.col("T")["value"]), F.lit("")).alias("name"),
        F.coalesce(
            name_of("FT"), F.when(F.col("FT")["target_type"] == "name", F.regexp_replace(F.col("FT")["target_raw"], "^/", ""))).alias("ft"),
    ).alias("own"), F.col("T").isNotNull().alias("_field"))

    def carry(carried: Column, own: Column) -> Column:
        above, name = carried["name"], own["name"]
        joined = F.when(name == "", above).when(above == "", name).otherwise(F.concat_ws(".", above, name))
        return F.struct(joined.alias("name"), F.coalesce(own["ft"], carried["ft"]).alias("ft"))

    kids = reader.array("Kids").all().select(
        *NODE, F.col("item_obj").alias("to_obj_id"), F.col("item_at").alias("to_at"), F.array("idx").alias("step"))
    at_target = own.select("doc_id", F.col("obj_id").alias("to_obj_id"), F.col("at").alias("to_at"), "own", "_field")
    # Kids without a name are widgets of their field.
    links = materialize(kids.join(at_target, ["doc_id", "to_obj_id", "to_at"]).where("_field").drop("_field"))
    nothing = F.struct(F.lit("").alias("name"), F.lit("").alias("ft"))
    starts = (
        tops.groupBy("doc_id", "obj_id").agg(F.min("idx").alias("_i"))
        .select("doc_id", "obj_id", _no_path().alias("at"), F.array(F.col("_i").cast("bigint")).alias("label"))
        .join(own, NODE, "left")
        .select(*NODE, "label", F.when(F.col("own").isNull(), nothing).otherwise(carry(nothing, F.col("own"))).alias("carried"))
    )
    met = first_sight(links, starts, ["obj_id", "at"], max_steps=max_depth, carry=carry)
    parents = links.select(*NODE).distinct()
    return met.where("carried.ft = 'Sig'").join(parents, NODE, "left_anti").select(
        "doc_id", F.col("carried.name").alias("field_name"), "obj_id", "at", F.col("label").alias("ord"))


def signature_facts(entries: DataFrame, fields: DataFrame, docs: DataFrame) -> DataFrame:
    """Structural facts of each field; an unsigned one is a placeholder.

    ``docs`` has ``doc_id, size``. Coverage is a measurement of the byte range
    against the file, never a verdict.
    """
    reader = NodeReader(entries)
    named = reader.keys(fields, ["V"], resolve=True).select(
        "doc_id", "field_name", "ord",
        (F.col("V").isNotNull() & F.coalesce(F.col("V")["target_type"], F.col("V")["value_type"]).isin("dict", "stream")).alias("signed"),
        F.col("V")["ref_id"].alias("signature_ref"),
        F.coalesce(F.col("V")["ref_id"], "obj_id").alias("obj_id"),
        F.when(F.col("V")["ref_id"].isNull(), F.array_append("at", F.lit("V"))).otherwise(_no_path()).alias("at"))
    named = named.withColumn("signed", F.coalesce("signed", F.lit(False)))
    s = reader.keys(named, ["SubFilter", "M", "Name", "Reason", "Location", "ContactInfo", "ByteRange"], resolve=True)
    s = materialize(s.join(docs.select("doc_id", "size"), "doc_id", "left"))
    ranges = reader.items(s.where("signed").select(*NODE, "field_name"), "ByteRange", resolve=True).select(
        *FIELD, "idx", F.coalesce("target_type", "value_type").alias("_t"), F.coalesce("target_raw", "value_raw").alias("_r"))
    whole = (F.col("_t") == "number") & F.col("_r").rlike(r"^[+-]?\d+$")
    # A byte range has four entries; a longer one is reported by its size alone.
    ranges = ranges.groupBy(*FIELD).agg(
        F.count(F.lit(1)).alias("_n"), F.min(whole).alias("_ints"),
        *[F.max(F.when(F.col("idx") == i, F.col("_r").try_cast("bigint"))).alias(f"_b{i}") for i in range(4)])
    text = lambda k: F.coalesce(F.when(F.col(k)["value_type"] == "string", F.col(k)["value"]), F.lit(""))
    br = F.col("ByteRange")
    is_array = br.isNull() | (F.coalesce(br["target_type"], br["value_type"]) == "array")
    values = F.when(br.isNotNull(), F.coalesce(
        F.when(F.col("_n") == 4, F.array("_b0", "_b1", "_b2", "_b3")), F.array_repeat(F.lit(0).cast("bigint"), F.coalesce(F.col("_n"), F.lit(0)).cast("int"))))
    cover = byte_range_coverage(values, F.col("size"), is_array, F.coalesce("_ints", F.lit(True)))
    sub = F.coalesce(name_of("SubFilter"), F.lit(""))
    kind = signature_kind(sub)
    signed = F.col("signed")
    only = lambda c: F.when(signed, c)
    rows = s.join(ranges, FIELD, "left").withColumn("_c", cover)
    return rows.select(
        *FIELD, "ord", "signed", only(F.col("signature_ref")).alias("signature_ref"),
        only(F.when(kind == "timestamp", "document-timestamp").otherwise("signature")).alias("type"),
        only(kind).alias("kind"), only(sub).alias("sub_filter"),
        only(F.nullif(text("M"), F.lit(""))).alias("time_raw"), only(pdf_date(text("M"))).alias("signing_time"),
        only(text("Name")).alias("signer_name"), only(text("Reason")).alias("reason"),
        only(text("Location")).alias("location"), only(text("ContactInfo")).alias("contact"),
        only(F.col("_c.error")).alias("coverage_error"), only(F.col("_c.trailing_gap")).alias("trailing_gap"),
        F.coalesce(only(F.col("_c.covers_whole_file")), F.lit(False)).alias("covers_whole_file"),
        F.when(signed, F.array_compact(F.array(F.lit(TRUST_NOTE), F.when(kind == "other", F.lit(NOT_DECOMPOSED_NOTE)))))
        .otherwise(F.array().cast("array<string>")).alias("notes"))


def match_signer(signer_infos: DataFrame, certs: DataFrame) -> DataFrame:
    """The signer's certificate of each field, identified and never assumed.

    ``signer_infos`` has ``sid_kind`` of ``issuer``, ``ski`` or ``cert-entry``; for
    the last the first certificate is the signer by definition. First match wins;
    no match leaves it NULL with a note.
    """
    cols = [*FIELD, F.col("cert_idx"), F.col("subject"), F.col("serial").alias("cert_serial")]
    info = signer_infos
    c = certs.select(*cols, F.col("issuer").alias("_issuer"), F.col("serial").alias("_serial"), F.col("ski").alias("_ski"))
    by_issuer = info.where("sid_kind = 'issuer'").withColumnsRenamed({"issuer": "_issuer", "serial": "_serial"}).join(
        c.drop("_ski"), [*FIELD, "_issuer", "_serial"])
    by_ski = info.where("sid_kind = 'ski' AND ski <> ''").withColumnRenamed("ski", "_ski").join(
        c.drop("_issuer", "_serial"), [*FIELD, "_ski"])
    by_rule = info.where("sid_kind = 'cert-entry'").join(c.where("cert_idx = 0"), FIELD)
    out = ["cert_idx", "subject", "cert_serial"]
    hits = by_issuer.select(*FIELD, *out).unionByName(by_ski.select(*FIELD, *out)).unionByName(by_rule.select(*FIELD, *out))
    best = hits.groupBy(*FIELD).agg(F.min_by(F.struct(*out), "cert_idx").alias("r")).select(*FIELD, "r.*")
    return info.join(best, FIELD, "left").select(
        *FIELD, "cert_idx", "subject", "cert_serial",
        algorithm_name(F.col("digest_oid")).alias("digest_algorithm"),
        algorithm_name(F.col("sig_oid")).alias("signature_algorithm"),
        F.when(F.col("cert_idx").isNull(), F.lit(NO_SIGNER_NOTE)).alias("note"))


def cert_facts(certs: DataFrame) -> DataFrame:
    """Usage names and addresses; NULL when the extension is absent, empty when it lists nothing."""
    return certs.select(
        *FIELD, "cert_idx", "subject", "issuer", "serial", "not_before", "not_after",
        key_usage_names(F.col("ku_bits")).alias("key_usage"),
        F.transform("eku", lambda o: F.struct(o.alias("oid"), eku_name(o).alias("name"))).alias("ext_key_usage"),
        "crl", "ocsp", "ca_issuers")


def certs_to_export(
    signatures: DataFrame, certs: DataFrame, field: str | None = None, skew: Skew = DEFAULT_SKEW
) -> DataFrame:
    """Certificates to write out, named ``sig<N>-cert<M>``.

    ``signatures`` has ``doc_id, field_name, ord, signed``. N counts all listed
    fields of the document, M the certificates of the field.
    """
    numbered = row_numbers(signatures, ["doc_id"], ["ord"], "_n", skew)
    chosen = numbered.where("signed") if field is None else numbered.where(F.col("field_name") == field)
    listed = row_numbers(chosen.join(certs, FIELD), FIELD, ["cert_idx"], "_m", skew)
    return listed.select(*FIELD, "cert_idx", "subject", F.format_string("sig%d-cert%d", "_n", "_m").alias("file_name"))
