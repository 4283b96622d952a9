"""Column functions: hashes, paths, references, durations, padding, codecs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType


def _once(value: Column, use) -> Column:
    """use(value), with value worked out once a row however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def content_hash(data: Column) -> Column:
    """Lower-case hexadecimal SHA-256, which stands in for the store's own hash; both order by bytes."""
    return F.sha2(data, 256)


def base64url(data: Column) -> Column:
    return F.regexp_replace(F.translate(F.base64(data), "+/", "-_"), "=+$", "")


def blob_path(hash_hex: Column) -> Column:
    """Object path of a blob: its hash as base64url, fanned out by two leading pairs."""
    name = base64url(F.unhex(hash_hex))
    return F.concat(F.lit("blob3/"), F.substring(name, 1, 2), F.lit("/"), F.substring(name, 3, 2), F.lit("/"), F.substring(name, 5, 100))


def hash_of_path(path: Column) -> Column:
    """Inverse of blob_path; null where the path is not one of a blob."""
    name = F.regexp_replace(F.regexp_extract(path, r"^blob3/([A-Za-z0-9_-]{2}/[A-Za-z0-9_-]{2}/[A-Za-z0-9_-]{39})$", 1), "/", "")
    return F.when(name != "", F.lower(F.hex(F.unbase64(F.concat(F.translate(name, "-_", "+/"), F.lit("="))))))


def base16(data: Column) -> Column:
    return F.concat(F.lit("f"), F.lower(F.hex(data)))


#: The digits of base32 (fixed values of that format).
_BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def base32(data: Column) -> Column:
    """Multibase b: lower-case base32 without padding."""
    bits = F.array_join(F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda k: F.lpad(F.conv(F.hex(F.substring(data, k, F.lit(1))), 16, 2), 8, F.lit("0"))), "")
    digit = lambda b, k: F.substring(F.lit(_BASE32), F.conv(F.rpad(F.substring(b, 5 * k + 1, F.lit(5)), 5, F.lit("0")), 2, 10).cast("int") + 1, F.lit(1))
    digits = _once(bits, lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(F.length(b) / 5).cast("int") - 1), lambda k: digit(b, k)), ""))
    return F.when(F.octet_length(data) == 0, "b").otherwise(F.concat(F.lit("b"), digits))


def blob_id(hash_hex: Column, size: Column) -> Column:
    """Identifier of a blob: two magic bytes, a tag, the hash, and the size as little-endian bytes without leading zeros."""
    big = F.lpad(F.hex(size.cast("long")), 16, "0")
    little = F.concat(*(F.substring(big, 15 - 2 * k, 2) for k in range(8)))
    return F.lower(F.concat(F.lit("5B821E"), F.upper(hash_hex), F.regexp_replace(little, "(00)+$", "")))


def blob_id_size(identifier: Column) -> Column:
    """Size in an identifier."""
    little = F.rpad(F.substring(identifier, 71, 16), 16, "0")
    return F.conv(F.concat(*(F.substring(little, 15 - 2 * k, 2) for k in range(8))), 16, 10).cast("long")


def blob_id_fields(identifier: Column) -> Column:
    """struct(hash, size, error) of an identifier in hexadecimal; the first of five errors: length, magic, type, multihash, size."""
    return _once(identifier, _blob_id_fields)


def _blob_id_fields(identifier: Column) -> Column:
    error = (
        F.when(identifier.isNull() | (F.length(identifier) < 70) | (F.length(identifier) % 2 != 0), "length")
        .when(F.substring(identifier, 1, 2) != "5b", "magic")
        .when(F.substring(identifier, 3, 2) != "82", "type")
        .when(F.substring(identifier, 5, 2) != "1e", "multihash")
        .when(F.length(identifier) > 86, "size")
    )
    return F.struct(F.when(error.isNull(), F.substring(identifier, 7, 64)).alias("hash"), F.when(error.isNull(), F.coalesce(blob_id_size(identifier), F.lit(0))).alias("size"), error.alias("error"))


def multibase_hex(text: Column) -> Column:
    """Bytes of a multibase string in hexadecimal: f is base16, u base64url, b base32; null for others and for malformed text."""
    body = F.substring(text, 2, 1 << 20)
    padded64 = F.rpad(F.translate(body, "-_", "+/"), F.ceil(F.length(body) / 4).cast("int") * 4, F.lit("="))
    bits = F.array_join(F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: F.lpad(F.bin((F.instr(F.lit(_BASE32), c) - 1).cast("long")), 5, F.lit("0"))), "")
    nibbles = lambda b: F.sequence(F.lit(0), F.floor(F.length(b) / 8).cast("int") * 2 - 1)
    plain32 = _once(bits, lambda b: F.array_join(F.transform(nibbles(b), lambda k: F.lower(F.conv(F.substring(b, 4 * k + 1, F.lit(4)), 2, 16))), ""))
    return (
        F.when(text.rlike("^f([0-9a-f]{2})*$"), body)
        .when(text.rlike("^u[A-Za-z0-9_-]+$") & (F.length(body) % 4 != 1), F.lower(F.hex(F.unbase64(padded64))))
        .when(text.rlike("^b[a-z2-7]{2,}$"), plain32)
    )


def padded(length: Column, block: int) -> Column:
    """Length rounded up to whole blocks; blocks of one byte or none leave it as it is."""
    return length.cast("long") if block <= 1 else (F.ceil(length / block) * block).cast("long")


def stored_blocks(length: Column, block: int) -> Column:
    return length.cast("long") if block <= 1 else F.ceil(length / block).cast("long")


def stored_plain(plain: Column, compressed: Column, block: int) -> Column:
    """Compression is skipped where it saves no block."""
    return padded(compressed, block) >= padded(plain, block)


def seconds(text: Column) -> Column:
    """Seconds of "10s", "5m", "1h" or "7"; null where it is none of these."""
    t = F.trim(text)
    number = F.regexp_extract(t, r"^([0-9]+)\s*[smh]?$", 1)
    unit = F.when(t.endswith("m"), 60).when(t.endswith("h"), 3600).otherwise(1)
    return F.when(number != "", number.cast("long") * unit)


def is_local(text: Column) -> Column:
    return text.rlike(r"^(\./|\.\./|/|~|[A-Za-z]:\\)") | text.isin(".", "..")


def vault_name_ok(name: Column) -> Column:
    return name.rlike(r"^[a-z0-9][a-z0-9._-]+$")


def reference(text: Column) -> Column:
    """struct(kind, name, path, snap) of "#hash", "vault:[path][#snap]" or a local path; kind is invalid where it is none."""
    before = F.split_part(text, F.lit(":"), F.lit(1))
    rest = F.regexp_extract(text, r"(?s)^[^:]*:(.*)$", 1)
    empty = lambda c: F.when(c != "", c)
    kind = (
        F.when((text == "") | (text == "#"), "invalid")
        .when(F.startswith(text, F.lit("#")), "hash")
        .when(is_local(text) | ~F.contains(text, F.lit(":")) | (F.length(before) == 1), "local")
        .when(vault_name_ok(before), "vault")
        .otherwise("invalid")
    )
    vault = kind == "vault"
    return F.struct(
        kind.alias("kind"),
        F.when(vault, before).alias("name"),
        F.when(vault, empty(F.split_part(rest, F.lit("#"), F.lit(1)))).when(kind == "local", text).alias("path"),
        F.when(vault, empty(F.regexp_extract(rest, r"(?s)^[^#]*#(.*)$", 1))).when(kind == "hash", F.regexp_replace(text, "^#", "")).alias("snap"),
    )


def cursor(name: Column, kind: Column) -> Column:
    """Opaque page cursor."""
    return base64url(F.to_json(F.struct(name.alias("position"), kind.alias("kind"))).cast("binary"))


def cursor_fields(text: Column) -> Column:
    """struct(position, kind) of a cursor."""
    whole = F.rpad(F.translate(text, "-_", "+/"), F.ceil(F.length(text) / 4).cast("int") * 4, F.lit("="))
    return F.from_json(F.unbase64(whole).cast("string"), "position string, kind string")


def without_setid(mode: Column) -> Column:
    """Mode bits without set-user-id and set-group-id."""
    return mode.cast("long").bitwiseAND(F.lit(~0o6000))


def key_error(key: Column) -> Column:
    """Why a path key is not valid, or null."""
    return (
        F.when(F.startswith(key, F.lit("/")), "absolute").when(key.rlike(r"(^|/)\.\.(/|$)"), "parent").when(F.contains(key, F.lit("\u0000")), "nul")
    )


def stream_key(kind: Column, key_hex: Column, vault_hex: Column) -> Column:
    """Encoded stream key: a tag, the key, and for vaults their id."""
    tag = F.when(kind == "local", "00").when(kind == "vault", "01").otherwise("02")
    return F.concat(tag, key_hex, F.when(kind == "vault", F.coalesce(vault_hex, F.lit(""))).otherwise(""))


def stream_key_fields(encoded: Column) -> Column:
    """struct(kind, key, vault, error) of an encoded stream key in hexadecimal: a tag, 32 bytes, and for vaults 16 more."""
    tag, n = F.substring(encoded, 1, 2), F.length(encoded)
    kind = F.when(tag == "00", "local").when(tag == "01", "vault").when(tag == "02", "pin")
    error = F.when(n < 2, "empty").when(kind.isNull(), "tag").when(n != F.when(kind == "vault", 98).otherwise(66), "length")
    good = error.isNull()
    return F.struct(F.when(good, kind).alias("kind"), F.when(good, F.substring(encoded, 3, 64)).alias("key"), F.when(good & (kind == "vault"), F.substring(encoded, 67, 32)).alias("vault"), error.alias("error"))


def outboard_path(hash_hex: Column) -> Column:
    """Path of the hash tree that belongs to a blob: as blob_path, below another prefix."""
    return F.concat(F.lit("obao6/"), F.substring(blob_path(hash_hex), 7, 200))


def well_known_id(domain: Column) -> Column:
    """First 16 bytes of the digest of a public domain string."""
    return F.substring(F.sha2(domain, 256), 1, 32)


def blob_key(context: str, master: Column, hash_hex: Column) -> Column:
    """Key of one blob: derived from the master secret and its hash, one for each context."""
    return F.sha2(F.concat(F.lit(context), master, hash_hex), 256)


def stored_size(blocks: Column, size: Column, block: int) -> Column:
    """Bytes that are stored: whole blocks where there are any, else the plain size."""
    return F.coalesce(blocks * block, size).cast("long")


def tombstone(timestamp: Column) -> Column:
    """Entry of a deleted path: no content, and when it was deleted."""
    return F.struct(F.lit(None).cast("string").alias("hash"), F.lit(None).cast("long").alias("size"), timestamp.cast("long").alias("timestamp"), F.lit(True).alias("is_tombstone"))


def inline_version(content: Column, timestamp: Column) -> Column:
    """Entry that carries its content: its bytes in hexadecimal, their number and its time."""
    data = content.cast("binary")
    return F.struct(F.hex(data).alias("inline"), F.sha2(data, 256).alias("hash"), F.octet_length(data).cast("long").alias("size"), timestamp.cast("long").alias("timestamp"), F.lit(False).alias("is_tombstone"))


def pack_count(header: Column) -> Column:
    """struct(count, error) from the fixed part of a pack header in hexadecimal."""
    error = F.when(F.length(header) < 20, "short").when(~F.startswith(header, F.lit("545350414b")), "magic").when(F.substring(header, 11, 2) != "01", "version")
    return F.struct(F.when(error.isNull(), F.conv(F.substring(header, 13, 8), 16, 10).cast("long")).alias("count"), error.alias("error"))


def pack_cache(pack_hash: Column, members: Column, end: Column) -> Column:
    """Cached header of a pack in hexadecimal: its hash, the number of members, 12-byte keys with offsets, the end."""
    row = lambda m: F.concat(F.substring(m["key"], 1, 24), F.lpad(F.hex(m["offset"].cast("long")), 16, F.lit("0")))
    whole = F.concat(pack_hash, F.lpad(F.hex(F.size(members).cast("long")), 8, "0"), F.array_join(F.transform(members, row), ""), F.lpad(F.hex(end.cast("long")), 16, "0"))
    return F.lower(whole)


def pack_cache_fields(text: Column) -> Column:
    """struct(pack_hash, members, end_offset, error) of a cached header."""
    count = F.conv(F.substring(text, 65, 8), 16, 10).cast("int")
    error = F.when(F.length(text) < 72, "short").when(F.length(text) != 88 + 40 * count, "length")
    one = lambda k: F.struct(F.substring(text, 73 + 40 * k, F.lit(24)).alias("key"), F.conv(F.substring(text, 97 + 40 * k, F.lit(16)), 16, 10).cast("long").alias("offset"))
    members = F.when(count == 0, F.array().cast("array<struct<key:string,offset:bigint>>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), one))
    good = error.isNull()
    return F.struct(
        F.when(good, F.substring(text, 1, 64)).alias("pack_hash"),
        F.when(good, members).alias("members"),
        F.when(good, F.conv(F.substring(text, F.length(text) - 15, F.lit(16)), 16, 10).cast("long")).alias("end_offset"),
        error.alias("error"),
    )


def zstd_compressed(level: int = 3, dictionary: bytes | None = None):
    """A column function: one zstd frame of a level, with a dictionary or without."""

    @F.pandas_udf(BinaryType())
    def run(data: pd.Series) -> pd.Series:
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=level, dict_data=known).compress
        return data.map(lambda b: None if b is None else pack(b))

    return run


def zstd_decompressed(dictionary: bytes | None = None):
    """A column function: the content of one zstd frame that was written with the same dictionary."""

    @F.pandas_udf(BinaryType())
    def run(data: pd.Series) -> pd.Series:
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        unpack = zstandard.ZstdDecompressor(dict_data=known).decompressobj
        return data.map(lambda b: None if b is None else unpack().decompress(b))

    return run


def zstd_dictionary(samples: list[bytes], size: int = 112_640) -> bytes:
    """A dictionary trained on samples, a bounded number of rows; empty where there are too few to learn from."""
    import zstandard

    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 10)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


@F.pandas_udf(BinaryType())
def compressed(data: pd.Series) -> pd.Series:
    """One zstd frame at level 1."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    return data.map(lambda b: None if b is None else pack(b))


@F.pandas_udf(BinaryType())
def decompressed(data: pd.Series) -> pd.Series:
    """Content of one zstd frame; zero bytes behind it are padding."""
    import zstandard

    def unpack(frame):
        return None if frame is None else zstandard.ZstdDecompressor().decompressobj().decompress(frame)

    return data.map(unpack)


def short_hash(hash_hex: Column, digits: int = 12) -> Column:
    return F.substring(hash_hex, 1, digits)


def derived(context: str, secret: Column) -> Column:
    """Digest that stands in for a derived secret: one for each context."""
    return F.sha2(F.concat(F.lit(context), secret), 256)


def vault_id(master: Column) -> Column:
    """First 16 bytes of a vault's derived secret."""
    return F.substring(derived("vault id", master), 1, 32)


def did_key(text: Column, method: str) -> Column:
    """Key part of a decentralised identifier of a method, or null."""
    part = F.regexp_extract(text, rf"^did:{method}:(z[1-9A-HJ-NP-Za-km-z]+)$", 1)
    return F.when(part != "", part)


def message(kind: Column, key_hex: Column, revision: Column, hash_hex: Column) -> Column:
    """Wire form of a registry message in hexadecimal: a type byte, the key, the revision big-endian, the hash."""
    return F.lower(F.concat(F.when(kind == "Stream", "08").otherwise("07"), key_hex, F.lpad(F.hex(revision.cast("long")), 16, "0"), hash_hex))


def message_fields(wire: Column, key_digits: int = 64) -> Column:
    """struct(type, key, revision, hash, error) of a wire form."""
    tag, at = F.substring(wire, 1, 2), 3 + key_digits
    error = F.when(~tag.isin("07", "08"), "type").when(F.length(wire) != at - 1 + 16 + 64, "length")
    return F.struct(
        F.when(tag == "08", "Stream").when(tag == "07", "Registry").alias("type"),
        F.substring(wire, 3, key_digits).alias("key"),
        F.conv(F.substring(wire, at, 16), 16, 10).cast("long").alias("revision"),
        F.substring(wire, at + 16, 64).alias("hash"),
        error.alias("error"),
    )


def pack_header(members: Column) -> Column:
    """Header of a pack in hexadecimal from an array of struct(key, offset): magic with version, count, then 12-byte keys with their offsets."""
    row = lambda m: F.concat(F.substring(m["key"], 1, 24), F.lpad(F.hex(m["offset"].cast("long")), 16, "0"))
    return F.lower(F.concat(F.lit("545350414B01"), F.lpad(F.hex(F.size(members).cast("long")), 8, "0"), F.array_join(F.transform(F.array_sort(members), row), "")))


def pack_members(header: Column) -> Column:
    """Array of struct(key, offset) of a header; null where magic, version or length do not fit."""
    count = F.conv(F.substring(header, 13, 8), 16, 10).cast("int")
    fits = F.startswith(header, F.lit("545350414b01")) & (F.length(header) == 20 + 40 * count)
    one = lambda k: F.struct(F.substring(header, 21 + 40 * k, F.lit(24)).alias("key"), F.conv(F.substring(header, 45 + 40 * k, F.lit(16)), 16, 10).cast("long").alias("offset"))
    return F.when(fits, F.transform(F.sequence(F.lit(0), count - 1), one))


@F.pandas_udf(StringType())
def base58(data: pd.Series) -> pd.Series:
    """Multibase z: base58 of bytes."""
    digits = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

    def one(b):
        if b is None:
            return None
        n, out = int.from_bytes(b), ""
        while n:
            n, k = divmod(n, 58)
            out = digits[k] + out
        return "z" + "1" * (len(b) - len(b.lstrip(b"\0"))) + out

    return data.map(one)
