"""Merkle manifest of a table: every row's leaf digest, its proof up to one root, and what folding the proof gives.

Rows of a group (a language) are leaves in the order of their ids, under a tree of eight children a node; the groups'
subroots, in order of their names, are the leaves of the tree above. No table is sorted for that. Ids of a group lie in
buckets of 32,768, each a bitmap with a directory of bit counts every 128 bytes, and prefix sums over buckets and over
ranges of buckets; a leaf's place is the bits below its own. Ids that occur more than once add bitmaps for the binary
digits of their counts, and their rows stand in order of their digests, found by the digests' first two bytes.

Leaves then lie in arrays of 512 slots keyed by group and place. An array is three levels of the tree, so a tree of n
leaves takes log512(n) rounds; what a leaf needs from above its array is one list for all 512.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, discard, store

ARITY = 8
#: Levels in an array of slots.
LEVELS = 3
SLOT_BITS = 9
#: Ids of a bitmap, and bytes between entries of its directory.
BUCKET_BITS, STRIDE = 15, 128
#: The bucket of null ids, below all others.
NO_ID = -(1 << 63)
#: Equal rows that one task numbers at a time.
COPIES = 4096


def field_digest(*values: Column) -> Column:
    """SHA-256 (hex) of values, each as its length in UTF-8 bytes, a colon and its text, or a hyphen where it is null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def _joined(nodes: Column) -> Column:
    return F.array_join(nodes, "")


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _tower(first: Column, block: Column) -> Column:
    """The levels of an array, lowest first. Only the first array of a group may stop early, when one node is left."""

    def up(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        parents = F.transform(F.sequence(F.lit(0), ((F.size(last) - 1) / ARITY).cast("int")), lambda i: _digest(_joined(F.slice(last, i * ARITY + 1, ARITY))))
        return F.when((F.size(last) > 1) | (block > 0), F.concat(levels, F.array(parents))).otherwise(levels)

    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(first), up)


def _siblings(levels: Column, slot: Column) -> Column:
    """What stands left and right of a slot's ancestor in its run, at each level of an array."""

    def at(k: Column) -> Column:
        place = F.floor(slot / F.pow(F.lit(ARITY), k)).cast("int")
        run = F.slice(F.element_at(levels, k + 1), (place - place % ARITY) + 1, ARITY)
        return F.struct(_joined(F.slice(run, 1, place % ARITY)).alias("left"), _joined(F.slice(run, place % ARITY + 2, ARITY)).alias("right"))

    return F.when(F.size(levels) > 1, F.transform(F.sequence(F.lit(0), F.size(levels) - 2), at)).otherwise(F.array().cast("array<struct<left: string, right: string>>"))


def _slots(nodes: DataFrame, *values: str) -> DataFrame:
    """Nodes (grp, pos, values) in arrays of 512 slots; the first value is the digest."""
    slot = F.col("pos").bitwiseAND((1 << SLOT_BITS) - 1).cast("int").alias("slot")
    return nodes.groupBy("grp", F.shiftright("pos", SLOT_BITS).alias("block")).agg(F.sort_array(F.collect_list(F.struct(slot, *values))).alias("slots"))


def _levels(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("levels", _tower(F.transform("slots", lambda s: F.lower(F.hex(s["digest"]))), F.col("block")))


def _tops(blocks: DataFrame) -> DataFrame:
    top = F.element_at("levels", -1)[0]
    return _levels(blocks).select("grp", F.col("block").alias("pos"), F.unhex(top).alias("digest"))


def _below(blocks: DataFrame, above: DataFrame | None, *values: str) -> DataFrame:
    """Each slot's values, its siblings up to the top of its tree, and the columns of ``above``, which is keyed by (grp, pos) of arrays."""
    rows = _levels(blocks)
    # levels is bound once for a row, whatever the optimiser merges
    each = F.flatten(F.transform(F.array("levels"), lambda v: F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), *(s[n].alias(n) for n in values), _siblings(v, s["slot"]).alias("within")))))
    if above is None:
        rows = rows.withColumn("path", F.array().cast("array<struct<left: string, right: string>>"))
    else:
        rows = rows.join(above.withColumnRenamed("pos", "block"), ["grp", "block"])
    kept = [c for c in rows.columns if c not in ("grp", "block", "slots", "levels", "path")]
    rows = rows.select("grp", "block", "path", *kept, F.explode(each).alias("s"))
    pos = (F.shiftleft("block", SLOT_BITS) + F.col("s.slot")).alias("pos")
    return rows.select("grp", pos, *kept, *(F.col(f"s.{n}").alias(n) for n in values), F.concat("s.within", "path").alias("path"))


def _rounds(blocks: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The arrays of all rounds, lowest first, until each group has one; and each group's top (grp, digest)."""
    rounds = [blocks]
    while True:
        tops = store(_tops(rounds[-1]), f"{name}-tops-{len(rounds)}")
        if not (tops.agg(F.max("pos")).first()[0] or 0):
            return rounds, tops.select("grp", "digest")
        rounds.append(store(_slots(tops, "digest"), f"{name}-{len(rounds)}"))
        discard(tops)


def _ranked(groups: DataFrame) -> DataFrame:
    """Groups numbered in order of their names: a range of names to a partition, numbered there, and the partitions' sizes added up."""
    parts = store(groups.repartitionByRange("grp").withColumn("part", F.spark_partition_id()), "groups")
    before = parts.groupBy("part").count().withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inside = parts.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("grp")) - 1)
    return inside.join(F.broadcast(before), "part").select(F.lit("").alias("grp"), (F.col("before") + F.col("at")).alias("pos"), "digest", F.col("grp").alias("name"))


def _rank(bitmap: Column, directory: Column, bit: Column) -> Column:
    """Bits of a bitmap below ``bit``."""
    byte = F.shiftright(bit, 3)
    whole = byte - byte % STRIDE
    own = F.conv(F.hex(F.substring(bitmap, byte + 1, F.lit(1))), 16, 10).cast("int")
    below = F.bit_count(own.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int") - 1))
    return directory[(whole / STRIDE).cast("int")] + F.bitmap_count(F.substring(bitmap, whole + 1, byte % STRIDE)) + below


def _index(ids: DataFrame) -> DataFrame:
    """Of each bucket the rows before it in its group, and its bitmaps by binary digit of the ids' counts, with directories."""
    digits = F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.lit(62)), lambda j: F.getbit("c", j) == 1))
    # bitmaps are built where ids are read, so only bitmaps are shuffled: a bucket's are at most 63 of 4 KB from each task
    placed = ids.select("grp", "bucket", "bit", F.explode(digits).alias("digit"))
    maps = placed.groupBy("grp", "bucket", "digit").agg(F.bitmap_construct_agg("bit").alias("bitmap"), F.count(F.lit(1)).alias("n"))
    entries = F.transform(F.sequence(F.lit(0), F.lit((1 << BUCKET_BITS) // 8 // STRIDE - 1)), lambda i: F.bitmap_count(F.substring(F.col("bitmap"), F.lit(1), i * STRIDE)))
    maps = maps.withColumn("directory", entries)
    index = maps.groupBy("grp", "bucket").agg(F.sum(F.col("n") * F.expr("shiftleft(1L, digit)")).alias("n"), F.collect_list(F.struct("digit", "bitmap", "directory")).alias("maps"))
    return store(index, "index")


def _before(index: DataFrame) -> DataFrame:
    """Rows before each bucket of its group: sums over ranges of 65,536 buckets, over 65,536 such ranges, and over all of these."""
    level = index.select("grp", F.col("bucket").alias("b0"), "n")
    sums = []
    for k in range(3):
        if k:
            level = level.groupBy("grp", F.shiftright(f"b{k - 1}", 16).alias(f"b{k}")).agg(F.sum("n").alias("n"))
        keys = ["grp"] if k == 2 else ["grp", F.shiftright(f"b{k}", 16)]
        w = Window.partitionBy(*keys).orderBy(f"b{k}").rowsBetween(Window.unboundedPreceding, -1)
        sums.append(level.select("grp", f"b{k}", F.coalesce(F.sum("n").over(w), F.lit(0)).alias(f"s{k}")))
    out = sums[0].withColumn("b1", F.shiftright("b0", 16)).withColumn("b2", F.shiftright("b1", 16))
    for k in (1, 2):
        out = out.join(sums[k], ["grp", f"b{k}"])
    return out.select("grp", F.col("b0").alias("bucket"), (F.col("s0") + F.col("s1") + F.col("s2")).alias("before"))


def _repeated(leaves: DataFrame, ids: DataFrame) -> DataFrame:
    """Places of rows whose id stands more than once: in order of digests, equal rows one after the other."""
    key = ["grp", "bucket", "bit"]
    rows = leaves.join(ids.filter("c > 1").select(*key, "pos"), key).withColumn("head", F.substring("digest", 1, 2))
    # a hot id's rows spread evenly over 65,536 heads
    inner = Window.partitionBy(*key, "head").orderBy("digest", "forged").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy(*key, "head").agg(F.sum("m").alias("n"))
    outer = Window.partitionBy(*key).orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select(*key, "head", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("ahead"))
    rows = rows.withColumn("inside", F.coalesce(F.sum("m").over(inner), F.lit(0))).join(heads, [*key, "head"])
    rows = rows.select("grp", "id", "digest", "forged", "m", (F.col("pos") + F.col("ahead") + F.col("inside")).alias("pos"))
    chunks = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / COPIES)))).repartition("grp", "pos", "chunk")
    copies = F.sequence(F.col("chunk") * COPIES, F.least(F.col("m"), (F.col("chunk") + 1) * COPIES) - 1)
    return chunks.select("grp", "id", "digest", "forged", "pos", F.explode(copies).alias("copy")).select("grp", (F.col("pos") + F.col("copy")).alias("pos"), "digest", "id", "forged")


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified`` of every row.

    A leaf is ``field_digest`` of the ``fields``; a node SHA-256 of its children's hex digests. Of a group leaves stand in
    order of their ids, null ids first, rows of one id in order of their digests; groups stand by name, the null group
    first. ``tampered`` replaces fields by other values when a row is verified: ``folded_root`` then comes of that leaf and
    the stored siblings, and ``verified`` tells whether it is the root. Repeated rows are leaves each. An empty table gives
    no rows. Columns that are not in ``fields`` play no part, whatever their names. Ids are integers.

    Texts are read once and never shuffled; digests (32 bytes) are. The root is the one value that passes the driver.
    """
    values = {f: col(f) for f in fields}
    leaf, forged = field_digest(*values.values()), field_digest(*(values | (tampered or {})).values())
    ident = col(id_col).cast("long")
    grp = F.coalesce(F.concat(F.lit("="), col(group_col).cast("string")), F.lit("-"))  # in bytes, "-" comes before "="
    rows = docs.select(grp.alias("grp"), ident.alias("id"), F.unhex(leaf).alias("digest"), F.unhex(forged).alias("forged"))
    rows = rows.withColumn("forged", F.when(F.col("forged") != F.col("digest"), F.col("forged")))
    bucket, bit = F.coalesce(F.shiftright("id", BUCKET_BITS), F.lit(NO_ID)), F.coalesce(F.col("id").bitwiseAND((1 << BUCKET_BITS) - 1), F.lit(0))
    leaves = store(rows.groupBy("grp", "id", "digest", "forged").agg(F.count(F.lit(1)).alias("m")).withColumns({"bucket": bucket, "bit": bit}), "leaves")

    ids = leaves.groupBy("grp", "bucket", "bit").agg(F.min("id").alias("id"), F.sum("m").alias("c"), F.min("digest").alias("digest"), F.min("forged").alias("forged"))
    index = _index(ids.select("grp", "bucket", "bit", "c"))
    found = ids.join(index.drop("n"), ["grp", "bucket"]).join(_before(index), ["grp", "bucket"])
    place = F.aggregate("maps", F.col("before"), lambda acc, m: acc + F.call_function("shiftleft", F.lit(1).cast("long"), m["digit"]) * _rank(m["bitmap"], m["directory"], F.col("bit").cast("int")))
    ids = store(found.select("grp", "bucket", "bit", "id", "c", "digest", "forged", place.alias("pos")), "places")
    nodes = ids.filter("c = 1").select("grp", "pos", "digest", "id", "forged").unionByName(_repeated(leaves, ids))

    rounds, tops = _rounds(store(_slots(nodes, "digest", "id", "forged"), "slots"), "tree")
    discard(leaves, index, ids)
    groups = store(_slots(_ranked(tops), "digest", "name"), "group-slots")
    upper, root = _rounds(groups, "groups")
    whole = root.select(F.lower(F.hex("digest"))).first()

    above = None
    for blocks in reversed(upper[1:]):
        above = _below(blocks, above)
    above = _below(upper[0], above, "digest", "name").select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "path", F.lower(F.hex("digest")).alias("subroot"))
    for blocks in reversed(rounds[1:]):
        above = _below(blocks, above)
    out = _below(rounds[0], above, "digest", "id", "forged")
    folded = F.aggregate("path", F.lower(F.hex(F.coalesce("forged", "digest"))), lambda acc, p: _digest(F.concat(p["left"], acc, p["right"])))
    proof = _digest(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""))
    out = out.select(F.col("id").alias("doc_id"), F.lower(F.hex("digest")).alias("leaf"), "subroot", F.lit(whole[0] if whole else None).cast("string").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
