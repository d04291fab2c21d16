"""Streams, strings and packed objects of encrypted documents, unlocked with a user's or an owner's password by column functions."""

from __future__ import annotations

import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from quirel.functions import crypto
from quirel.functions.codecs import FilterError, decode_chain
from quirel.plans.stages import materialize, spread
from quirel.sources.objects import LOCKED, as_list, packed_rows, plain

from .catalogue import follow


def encryption(objects: DataFrame) -> DataFrame:
    """(doc_id, version, revision, length, owner, user, permissions, file_id, method, string_method, methods, encrypt_metadata, encrypt_num) of documents with an Encrypt entry.

    Methods are RC4 as "V2", "AESV2", "Identity", or what else a crypt filter says. From version 4 on StmF and StrF name
    the filters of streams and strings, without which these are plain; methods has all filters by name.
    """
    trailer = objects.where("obj_num = 0").select("doc_id", F.try_variant_get("value", "$.Encrypt", "variant").alias("e"), F.unhex(F.try_variant_get("value", "$.ID[0].s", "string")).alias("file_id"))
    held = follow(trailer.where("e is not null"), objects, "e")
    get = lambda p, k: F.try_variant_get("e", p, k)
    filters = F.coalesce(get("$.CF", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    named = F.transform_values(filters, lambda _, f: F.coalesce(F.when(F.try_variant_get(f, "$.CFM.n", "string") == "None", "Identity").otherwise(F.try_variant_get(f, "$.CFM.n", "string")), F.lit("Identity")))
    held = held.withColumn("methods", named)
    by_name = lambda name: F.when(name == "Identity", "Identity").otherwise(F.coalesce(F.try_element_at("methods", name), F.concat(F.lit("no filter "), name)))
    method = lambda key: F.when(get("$.V", "int") < 4, "V2").otherwise(by_name(F.coalesce(get(f"$.{key}.n", "string"), F.lit("Identity"))))
    return held.select(
        "doc_id",
        get("$.V", "int").alias("version"),
        get("$.R", "int").alias("revision"),
        (F.coalesce(get("$.Length", "int"), F.lit(40)) / 8).cast("int").alias("length"),
        F.unhex(get("$.O.s", "string")).alias("owner"),
        F.unhex(get("$.U.s", "string")).alias("user"),
        get("$.P", "long").alias("permissions"),
        F.coalesce("file_id", F.lit(b"")).alias("file_id"),
        method("StmF").alias("method"),
        method("StrF").alias("string_method"),
        "methods",
        F.coalesce(get("$.EncryptMetadata", "boolean"), F.lit(True)).alias("encrypt_metadata"),
        F.col("e_num").alias("encrypt_num"),
    )


def _key(password: Column) -> Column:
    """The file key that a user's password gives under a document's revision."""
    key = F.lit(None).cast("binary")
    for revision, length, metadata in ((2, 5, True), (3, 5, True), (3, 16, True), (4, 16, True), (4, 16, False)):
        made = crypto.file_key(password, F.col("owner"), F.col("permissions"), F.col("file_id"), revision, length, metadata)
        fits = (F.col("revision") == revision) & ((F.col("length") == length) | F.lit(revision != 3)) & ((F.col("encrypt_metadata") == metadata) | F.lit(revision != 4))
        key = F.when(fits, made).otherwise(key)
    return key


def _opens(key: str) -> Column:
    """Whether a key is the document's, by its user entry."""
    met = F.when(F.col("revision") == 2, crypto.user_entry_r2(F.when(F.col("revision") == 2, F.col(key))) == F.col("user")).otherwise(crypto.user_entry_r3(key, "file_id") == F.substring("user", 1, 16))
    return F.coalesce(met, F.lit(False))


def file_keys(objects: DataFrame, password: bytes = b"") -> DataFrame:
    """(doc_id, key, method, string_method, methods, opened, encrypt_metadata, encrypt_num): keys of revisions 2 to 4; the password may be the user's or the owner's."""
    found = spread(encryption(objects), "doc_id").withColumn("as_user", _key(F.lit(password)))
    # Where the user's key opens the document, the owner's isn't made.
    found = found.withColumn("user_opens", _opens("as_user"))
    found = found.withColumn("held", crypto.user_password(F.lit(password), F.when(~F.col("user_opens"), F.col("owner")), "revision", "length"))
    tested = found.withColumn("as_owner", F.when(F.col("held").isNotNull(), _key(F.col("held")))).withColumn("owner_opens", _opens("as_owner"))
    key = F.when(F.col("owner_opens") & ~F.col("user_opens"), F.col("as_owner")).otherwise(F.col("as_user"))
    return tested.select("doc_id", key.alias("key"), "method", "string_method", "methods", (F.col("user_opens") | F.col("owner_opens")).alias("opened"), "encrypt_metadata", "encrypt_num")


@pandas_udf(BinaryType())
def _decoded(data: pd.Series, filters: pd.Series, params: pd.Series) -> pd.Series:
    """Bytes through a stream's filters with their parameters (both as JSON); null where they can't be decoded."""

    def one(d, f, p):
        names = as_list(plain(json.loads(f or "null")))
        given = as_list(plain(json.loads(p or "null")))
        chain = [(n, given[i] if i < len(given) else None) for i, n in enumerate(names) if n != "Crypt"]
        try:
            return None if d is None else decode_chain(d, [n for n, _ in chain], [g for _, g in chain])
        except (FilterError, ValueError, TypeError):
            return None

    return pd.Series([one(*x) for x in zip(data, filters, params)])


def _with_strings(value: Column, key: Column, method: Column) -> Column:
    """A VARIANT with all of its strings decrypted; one that can't be stays as it is stored."""
    stored = F.to_json(value)
    one = r'"s":"([0-9a-f]*)"'
    digits = F.regexp_extract_all(stored, F.lit(one), F.lit(1))
    aes = F.transform(digits, lambda h: F.lower(F.hex(crypto.decrypt_aes(F.unhex(h), key))))
    plain_ = F.when(method == "AESV2", aes).otherwise(crypto.rc4_each(F.when(method == "V2", key), F.when(method == "V2", digits)))
    kept = F.zip_with(digits, plain_, lambda h, p: F.coalesce(p, h))
    whole = F.zip_with(F.split(stored, one, -1), kept, lambda between, h: F.concat(between, F.coalesce(F.concat(F.lit('"s":"'), h, F.lit('"')), F.lit(""))))
    return F.when(F.size(digits) > 0, F.parse_json(F.array_join(whole, ""))).otherwise(value)


def _unpacked(rows: DataFrame) -> DataFrame:
    """rows with the objects that were locked in object streams, now that these are decoded."""
    pack = F.regexp_extract("error", rf"^{LOCKED}([0-9]+)$", 1).try_cast("long")
    waiting = rows.where(F.col("error").startswith(LOCKED)).select("doc_id", "obj_num", pack.alias("pack"), "gen", "error")
    if waiting.isEmpty():
        return rows
    streams = rows.where("data is not null and error is null").where(F.try_variant_get("value", "$.Type.n", "string") == "ObjStm")
    streams = streams.join(waiting.select("doc_id", F.col("pack").alias("obj_num")).distinct(), ["doc_id", "obj_num"], "left_semi")
    streams = streams.select("doc_id", F.col("obj_num").alias("pack"), F.try_variant_get("value", "$.First", "int").alias("first"), "data")

    def parse_packs(batches):
        for batch in batches:
            for r in batch.to_pylist():
                found = list(packed_rows(r["data"], r["first"] or 0))
                for at in range(0, len(found), 2000):
                    part = found[at : at + 2000]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r["doc_id"]] * len(part), pa.int64()), "pack": pa.array([r["pack"]] * len(part), pa.int64()), "obj_num": pa.array([p[0] for p in part], pa.int64()), "json": pa.array([p[1] for p in part], pa.string())})

    held = streams.mapInArrow(parse_packs, "doc_id long, pack long, obj_num long, json string").dropDuplicates(["doc_id", "pack", "obj_num"])
    opened = waiting.join(held, ["doc_id", "pack", "obj_num"], "left")
    opened = opened.select("doc_id", "obj_num", F.parse_json("json").alias("value"), F.lit(None).cast("binary").alias("data"), F.when(F.col("json").isNull(), F.col("error")).alias("error"), "gen")
    return rows.where(F.col("error").isNull() | ~F.col("error").startswith(LOCKED)).unionByName(opened)


def unlocked(objects: DataFrame, password: bytes = b"", keys: DataFrame | None = None) -> DataFrame:
    """objects with the streams of encrypted documents decrypted and then decoded, their strings decrypted, and what was packed in such
    streams unpacked; where the password is wrong the error says so, and where a crypt filter isn't known.

    Streams follow StmF or the filter that they name themselves, strings StrF; Identity leaves them as they are, and so do metadata in a document that doesn't
    encrypt those, cross-reference streams, the encryption dictionary and the signed bytes of a signature. keys are file_keys() of these, where they are there already.
    """
    keys = file_keys(objects, password) if keys is None else keys
    both = spread(objects, "doc_id").join(spread(keys, "doc_id"), "doc_id", "left")
    number, gen = F.col("obj_num"), F.coalesce("gen", F.lit(0))
    own = lambda method: F.when(method == "AESV2", crypto.object_key(F.col("key"), number, gen, True)).otherwise(crypto.object_key(F.col("key"), number, gen, False))
    entry = lambda k: F.try_variant_get("value", f"$.{k}", "variant")
    listed = lambda k: F.coalesce(F.try_variant_get("value", f"$.{k}", "array<variant>"), F.array_compact(F.array(entry(k))))
    kind = F.coalesce(F.try_variant_get("value", "$.Type.n", "string"), F.lit(""))
    names = F.transform(listed("Filter"), lambda f: F.coalesce(F.try_variant_get(f, "$.n", "string"), F.lit("")))
    crypt = F.array_position(names, "Crypt")
    named = F.coalesce(F.try_variant_get(F.get(listed("DecodeParms"), (crypt - 1).cast("int")), "$.Name.n", "string"), F.lit("Identity"))
    chosen = F.when(named == "Identity", "Identity").otherwise(F.coalesce(F.try_element_at("methods", named), F.concat(F.lit("no filter "), named)))
    clear = (~F.col("encrypt_metadata") & (kind == "Metadata")) | (kind == "XRef")
    both = both.withColumn("how", F.when(clear, "Identity").when(crypt > 0, chosen).otherwise(F.col("method")))
    opened = F.coalesce(F.col("opened"), F.lit(False)) & (number > 0)
    known = F.col("how").isin("Identity", "V2", "AESV2")
    content = crypto.decrypt(F.col("data"), F.col("how") == "Identity", F.col("how"), own(F.col("how")))
    data = F.when(opened & known & F.col("data").isNotNull(), _decoded(content, F.to_json(entry("Filter")), F.to_json(entry("DecodeParms")))).otherwise(F.col("data"))
    strings = opened & ~number.eqNullSafe(F.col("encrypt_num")) & (kind != "XRef") & F.try_variant_get("value", "$.ByteRange", "variant").isNull() & F.col("string_method").isin("V2", "AESV2")
    value = F.when(strings, _with_strings(F.col("value"), F.when(strings, own(F.col("string_method"))), F.col("string_method"))).otherwise(F.col("value"))
    error = F.when(F.col("opened") == F.lit(False), "wrong password").when(opened & F.col("data").isNotNull() & ~known, F.concat(F.lit("crypt filter: "), F.col("how"))).otherwise(F.col("error"))
    return _unpacked(materialize(both.select("doc_id", "obj_num", value.alias("value"), data.alias("data"), error.alias("error"), "gen")))
