"""Object and blob stores as tables: (key, content) or (hash, content), and what their interfaces ask and change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scalars


def contains(asked: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """Each asked key with whether the store has it. Null keys are never there; keys asked twice are answered twice."""
    there = store.select(key).distinct().withColumn("found", F.lit(True))
    return asked.join(there, key, "left").select(*asked.columns, F.coalesce("found", F.lit(False)).alias("found"))


def size_of(asked: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """Each asked key with the size of its object, null where there is none."""
    sizes = store.select(key, F.octet_length("content").cast("long").alias("size")).dropDuplicates([key])
    return asked.join(sizes, key, "left").select(*asked.columns, "size")


def slice_of(content: Column, offset: int, length: int | None = None) -> Column:
    """[offset, offset + length) of a binary column, or what there is of it."""
    rest = F.greatest(F.octet_length(content) - offset, F.lit(0))
    return F.substring(content, F.lit(offset + 1), rest if length is None else F.least(rest, F.lit(length)))


def streamed(store: DataFrame, size: int, key: str = "key") -> DataFrame:
    """(key, seq, piece): each object in pieces of `size` bytes; an empty object has none."""
    pieces = F.sequence(F.lit(0), F.floor((F.octet_length("content") - 1) / size).cast("int"))
    rows = store.where(F.octet_length("content") > 0).select(key, "content", F.explode(pieces).alias("seq"))
    return rows.select(key, F.col("seq").cast("long").alias("seq"), F.substring("content", F.col("seq") * size + 1, F.lit(size)).alias("piece"))


def deleted(store: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """The store without the given keys; keys that it does not have are passed over."""
    return store.join(keys.select(key).distinct(), key, "left_anti")


def renamed(store: DataFrame, moves: DataFrame) -> DataFrame:
    """The store after moves (key, new_key): what was at a target is replaced; a key that is not there moves nothing. Each key and target occurs once."""
    moved = store.join(moves, "key").select(F.col("new_key").alias("key"), *(c for c in store.columns if c != "key"))
    rest = store.join(moves.select("key"), "key", "left_anti").join(moved.select("key"), "key", "left_anti")
    return rest.unionByName(moved)


def imported(new: DataFrame, store: DataFrame, checked: bool = True) -> DataFrame:
    """The store (hash, content) with new contents: each once, and with checked only those it lacks are added."""
    rows = new.select(scalars.content_hash(F.col("content")).alias("hash"), "content").dropDuplicates(["hash"])
    if checked:
        return store.select("hash", "content").unionByName(rows.join(store.select("hash"), "hash", "left_anti"))
    return store.select("hash", "content").unionByName(rows).dropDuplicates(["hash"])


def verified_uploads(uploads: DataFrame) -> DataFrame:
    """Uploads (name, hash, size, content) with what is wrong with them: a declared hash or size that the content does not have."""
    error = F.when(scalars.content_hash(F.col("content")) != F.col("hash"), "hash").when(F.octet_length("content") != F.col("size"), "size")
    return uploads.select("name", "hash", error.alias("error"))


def copied_if_absent(asked: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(hash, outcome) of fetching blobs into a store: present, copied, or missing in the source too."""
    here, there = (s.select("hash").distinct().withColumn(n, F.lit(True)) for s, n in ((target, "here"), (source, "there")))
    outcome = F.when(F.col("here"), "present").when(F.col("there"), "copied").otherwise("missing")
    return asked.join(here, "hash", "left").join(there, "hash", "left").select("hash", outcome.alias("outcome"))


def with_fallback(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """(hash, content, store): each blob from the primary store, or else from the secondary."""
    a = primary.select("hash", F.struct("content", F.lit("primary").alias("store")).alias("a"))
    b = secondary.select("hash", F.struct("content", F.lit("secondary").alias("store")).alias("b"))
    return a.join(b, "hash", "full_outer").select("hash", F.coalesce("a", "b").alias("e")).select("hash", "e.*")


def packed(members: DataFrame, align: int = 4096) -> DataFrame:
    """(pack, body): header, zeros up to whole blocks, then the members' contents in order of key.

    members: (pack, key, content), where a pack has a bounded size, as first fit gives it.
    """
    rows = F.array_sort(F.collect_list(F.struct("key", F.hex("content").alias("data"))))
    packs = members.groupBy("pack").agg(rows.alias("m"))
    start = F.ceil((10 + 20 * F.size("m")) / align) * align
    lengths = F.transform("m", lambda m: F.struct(m["key"].alias("key"), (F.length(m["data"]) / 2).cast("long").alias("n")))
    placed = F.aggregate(
        lengths,
        F.struct(F.array().cast("array<struct<key:string,offset:bigint>>").alias("out"), start.cast("long").alias("at")),
        lambda s, m: F.struct(F.concat(s["out"], F.array(F.struct(F.substring(F.sha2(m["key"], 256), 1, 24).alias("key"), s["at"].alias("offset")))).alias("out"), (s["at"] + m["n"]).alias("at")),
    )["out"]
    header = F.rpad(scalars.pack_header(placed), (2 * start).cast("int"), F.lit("0"))
    return packs.select("pack", F.unhex(F.concat(header, F.array_join(F.transform("m", lambda m: m["data"]), ""))).alias("body"))


def read_packed(asked: DataFrame, index: DataFrame, packs: DataFrame, offset: int = 0, length: int | None = None) -> DataFrame:
    """(key, content): [offset, offset + length) of each asked member, taken from the body of its pack; null where no pack has it.

    index: (key, pack, offset, length). Only the packs that are asked for are read.
    """
    at = asked.join(index, "key", "left")
    found = at.join(packs, "pack", "left")
    rest = F.greatest(F.col("length") - offset, F.lit(0))
    size = rest if length is None else F.least(rest, F.lit(length))
    return found.select("key", F.substring("body", (F.col("offset") + offset + 1).cast("int"), size.cast("int")).alias("content"))


def staged_within(staged: DataFrame, pending: DataFrame, indexed: DataFrame, cap: int) -> DataFrame:
    """(hash, outcome) of uploads to a packing store in order of seq: known, staged, or held back once `cap` bytes wait.

    Each content counts once, at its first upload. The running total is taken over blocks of seq first, so that no task sorts all uploads.
    """
    from pyspark.sql import Window

    known = pending.select("hash").unionByName(indexed.select("hash")).distinct().withColumn("known", F.lit(True))
    new = staged.groupBy("hash").agg(F.min("seq").alias("seq"), F.min_by("size", "seq").alias("size")).join(known, "hash", "left")
    fresh = new.where("known is null").withColumn("block", F.floor(F.col("seq") / 1024))
    blocks = fresh.groupBy("block").agg(F.sum("size").alias("bytes"))
    blocks = blocks.select("block", (F.sum("bytes").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")).alias("earlier"))
    inside = F.sum("size").over(Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    sums = fresh.withColumn("inside", inside).join(blocks, "block").select("hash", (F.col("inside") + F.col("earlier")).alias("total"))
    outcome = F.when(F.col("known"), "known").when(F.col("total") <= cap, "staged").otherwise("held")
    return new.join(sums, "hash", "left").select("hash", outcome.alias("outcome"))
