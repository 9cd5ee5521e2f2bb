"""Merkle manifest of a table: a tree for each group of rows (language), and one over the groups' roots.

A leaf's place is its rank among the ids of its group. Ids are not sorted for it: every group keeps a bitmap of its ids in
words of 64 bits, of which only those with a bit exist, merged from the tasks' partial words by ``bit_or``. Counts of the
words, summed over ranges of ``RADIX`` bits and ranges of ranges, are the directory; the rank of an id is the sum before
its word plus the bits below its own. Places then name slots: ``FANOUT ** LEVELS`` neighbours form one keyed array, which a
task reduces by ``LEVELS`` levels at once, so that ten billion leaves take four rounds, each ``FANOUT ** LEVELS`` times
smaller than the one before. Proofs come back the same way, from the top: an array gets the path of its own node once, and
each of its slots adds the siblings inside the array.

Null ids come before all others of their group, rows that repeat an id are ordered by their leaf. They are placed by counts
over the first digits of the leaf (which are spread evenly), so no task holds all rows of one id. Identical rows have
consecutive places, in any order. A null group is a group of its own and the first one. An empty table has no rows and no
root. Columns other than those named are not read, so their names may be anything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.common import stored

FANOUT, FAN_BITS = 8, 3
#: Levels that one task reduces: an array has 512 slots.
LEVELS = 3
#: Words of the bitmap that share one entry of the directory's next level, in bits; 3 levels hold all 64-bit ids.
RADIX = 20
#: First digits of a leaf, and parts of identical rows, by which repeated ids are spread.
DIGITS, SALTS = 3, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for a null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


@dataclass(frozen=True)
class Manifest:
    """Stored tables of a tree: the leaves' arrays, those of every round above them, and the group's and the whole root."""

    arrays: Sequence[DataFrame]
    above: Sequence[DataFrame]
    #: (g, name, subroot, root)
    groups: DataFrame


def ordered_groups(leaves: DataFrame) -> DataFrame:
    """(g, name, size): groups numbered in the order of their names, the null one first."""
    sizes = leaves.groupBy("name").agg(F.count("*").alias("size"))
    dealt = stored(sizes.repartitionByRange("name").select("*", F.spark_partition_id().alias("part")), "groups")
    # One row for each partition.
    before = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_first("name")))
    return stored(dealt.join(before, "part").select((F.coalesce("before", F.lit(0)) + own - 1).cast("long").alias("g"), "name", "size"), "ordered-groups")


def id_words(rows: DataFrame) -> DataFrame:
    """(g, word, bits, n, again): the bitmap of each group's ids, the rows of each word and the extra rows of repeated ids."""
    place = rows.where("id is not null").select("g", F.shiftright("id", 6).alias("word"), F.col("id").bitwiseAND(63).cast("int").alias("bit"))
    by_id = place.repartition("g", "word").groupBy("g", "word", "bit").agg(F.count("*").alias("n"))
    again = F.collect_list(F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("more"))))
    return by_id.groupBy("g", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("n").alias("n"), again.alias("again"))


def directory(words: DataFrame) -> DataFrame:
    """(g, word, base): rows of the group before each word, by sums over ranges of words, of ranges, and of the rest."""

    def before(level: DataFrame, *keys: str) -> DataFrame:
        frame = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
        return level.select("*", F.coalesce(F.sum("n").over(frame), F.lit(0)).alias("before"))

    levels = [words.select("g", F.col("word").alias("k"), "n")]
    for _ in range(2):
        levels.append(levels[-1].groupBy("g", F.shiftright("k", RADIX).alias("k")).agg(F.sum("n").alias("n")))
    base = before(levels[2], "g").select("g", F.col("k").alias("up"), F.col("before").alias("base"))
    for level in (levels[1], levels[0]):
        own = before(level.select("*", F.shiftright("k", RADIX).alias("up")), "g", "up")
        base = own.join(base, ["g", "up"]).select("g", F.col("k").alias("up"), (F.col("before") + F.col("base")).alias("base"))
    return base.withColumnRenamed("up", "word")


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (g, id, leaf, ...) with ``position``, the rank in their group by id and leaf; nulls first."""
    words = stored(id_words(rows), "id-words")
    index = words.join(directory(words), ["g", "word"]).drop("n")
    nulls = rows.where("id is null").groupBy("g").agg(F.count("*").alias("nulls"))
    word, bit = F.shiftright("id", 6), F.col("id").bitwiseAND(63).cast("int")
    below = F.expr("bit_count(bits & ~shiftleft(-1L, bit)) + aggregate(filter(again, x -> x.bit < bit), 0L, (a, x) -> a + x.more)")
    ranked = rows.withColumns({"word": word, "bit": bit}).join(index, ["g", "word"], "left").join(nulls, "g", "left")
    ranked = ranked.withColumns({"rank": F.coalesce(F.col("base") + below + F.coalesce("nulls", F.lit(0)), F.lit(0)), "tied": F.expr("id is null or exists(again, x -> x.bit = bit)")})
    ranked = stored(ranked.select(*[F.col(c) for c in rows.columns], "rank", "tied", (F.monotonically_increasing_id() % SALTS).alias("salt")), "ranked")
    single = ranked.where("not tied").select(*rows.columns, F.col("rank").alias("position"))
    tied = ranked.where("tied").withColumn("head", F.substring("leaf", 1, DIGITS))
    if tied.isEmpty():
        return single
    earlier = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = tied.groupBy("g", "id", "head").agg(F.count("*").alias("n")).select("g", "id", "head", earlier(["g", "id"], ["head"]).alias("first"))
    parts = tied.groupBy("g", "id", "head", "leaf", "salt").agg(F.count("*").alias("n")).select("g", "id", "head", "leaf", "salt", earlier(["g", "id", "head"], ["leaf", "salt"]).alias("second"))

    def joined(left, right, keys):
        return left.join(right.select([F.col(c).alias(f"r_{c}") for c in keys] + [c for c in right.columns if c not in keys]), [left[c].eqNullSafe(F.col(f"r_{c}")) for c in keys]).drop(*[f"r_{c}" for c in keys])

    own = F.row_number().over(Window.partitionBy("g", "id", "leaf", "salt").orderBy("leaf")) - 1
    whole = joined(joined(tied, heads, ["g", "id", "head"]), parts, ["g", "id", "head", "leaf", "salt"])
    return single.unionByName(whole.select(*rows.columns, (F.col("rank") + F.col("first") + F.col("second") + own).alias("position")))


def levels_of(size: Column) -> Column:
    """Levels above the leaves of a group: how many powers of the fan-out are smaller than its size."""
    return sum((size > F.lit(FANOUT**k)).cast("int") for k in range(21))


def slot_arrays(nodes: DataFrame, *more: str) -> DataFrame:
    """(g, block, left, slots): the nodes of neighbouring places as one array each, in their order."""
    block = F.shiftright("position", FAN_BITS * LEVELS).alias("block")
    return nodes.groupBy("g", block, "left").agg(F.sort_array(F.collect_list(F.struct("position", "digest", *more))).alias("slots"))


def lifted(digests: list[str]) -> list[str]:
    """The next level: the digest of every run of neighbours."""
    return [digest("".join(digests[i : i + FANOUT])) for i in range(0, len(digests), FANOUT)]


def reduced(arrays: DataFrame) -> DataFrame:
    """(g, position, digest, left) of the node over each array; left counts the levels that remain above it."""

    def run(batches):
        for batch in batches:
            out = []
            for left, column in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                slots = column.as_py()
                for _ in range(min(left, LEVELS)):
                    slots = lifted(slots)
                out.append(slots[0])
            rest = [max(0, x - LEVELS) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(rest, pa.int32())], ["g", "position", "digest", "left"])

    return arrays.select("g", "block", "left", "slots.digest").mapInArrow(run, "g long, position long, digest string, left int")


def grown(leaves: DataFrame, most: int, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The arrays of all rounds, from the leaves (g, position, digest, left, ...) up, and the roots (g, digest)."""
    arrays, roots, nodes = [], None, leaves
    for _ in range(0, max(most, 1), LEVELS):
        arrays.append(stored(slot_arrays(nodes, *more), "arrays"))
        more, nodes = (), stored(reduced(arrays[-1]), "nodes")
        own = nodes.where("left = 0").select("g", "digest")
        roots = own if roots is None else roots.unionByName(own)
        nodes = nodes.where("left > 0")
    return arrays, roots


def siblings(levels: list[list[str]], i: int) -> list[str]:
    """For slot i of an array: the neighbours' digests before and after it, level by level."""
    out = []
    for level in levels:
        run = i // FANOUT * FANOUT
        out += ["".join(level[run:i]), "".join(level[i + 1 : run + FANOUT])]
        i //= FANOUT
    return out


def array_levels(slots: list[str], left: int) -> list[list[str]]:
    levels = []
    for _ in range(min(left, LEVELS)):
        levels.append(slots)
        slots = lifted(slots)
    return levels


def paths(arrays: DataFrame, above: DataFrame) -> DataFrame:
    """(g, position, path) of every node in ``arrays``; ``above`` holds the path (g, block, path) of each array's own node."""

    def run(batches):
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                g, left, places, slots, top = (x.as_py() for x in row)
                levels = array_levels(slots, left)
                own = [siblings(levels, i) + top for i in range(len(slots))]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(own), pa.int64()), pa.array(places, pa.int64()), pa.array(own, pa.list_(pa.string()))], ["g", "position", "path"])

    return arrays.join(above, ["g", "block"]).select("g", "left", "slots.position", "slots.digest", "path").mapInArrow(run, "g long, position long, path array<string>")


def build(leaves: DataFrame) -> Manifest:
    """The tree over ``leaves`` (name, id, leaf, claim): ``name`` is the group, ``claim`` a digest that is to be verified."""
    groups = ordered_groups(leaves)
    most = groups.agg(F.max("size").alias("size"), F.count("*").alias("n")).select(levels_of(F.col("size")).alias("levels"), levels_of(F.col("n")).alias("top")).first()
    numbered = leaves.join(groups.select("g", F.col("name").alias("_name"), levels_of(F.col("size")).alias("left")), F.col("name").eqNullSafe(F.col("_name")))
    rows = placed(numbered.select("g", "id", "leaf", "claim", "left"))
    arrays, subroots = grown(rows.withColumnRenamed("leaf", "digest"), most["levels"] or 0, "id", "claim")
    subroots = stored(subroots, "subroots")
    tops = subroots.select(F.lit(0).cast("long").alias("g"), F.col("g").alias("position"), "digest", F.lit(most["top"] or 0).alias("left"))
    top, root = grown(tops, most["top"] or 0)
    named = groups.join(subroots.withColumnRenamed("digest", "subroot"), "g").withColumn("top", F.lit(0).cast("long"))
    named = named.join(root.select(F.col("g").alias("top"), F.col("digest").alias("root")), "top")
    return Manifest(arrays, top, stored(named.select("g", "name", "subroot", "root"), "group-roots"))


def above_leaves(tree: Manifest) -> DataFrame:
    """(g, block, path): the path of the node over every array of leaves up to the root."""
    none = F.array().cast("array<string>").alias("path")
    down = tree.above[-1].select("g", "block", none)
    for arrays in reversed(tree.above):
        down = stored(paths(arrays, down).withColumnRenamed("position", "block"), "paths")
    # The path of a group's root is that of its slot in the upper tree.
    tops = down.select(F.col("block").alias("g"), "path")
    below = None
    for arrays in reversed(tree.arrays):
        own = arrays.where(F.col("left") <= LEVELS).select("g", "block").join(tops, "g")
        above = own if below is None else own.unionByName(below)
        if arrays is tree.arrays[0]:
            return above
        below = stored(paths(arrays, above).withColumnRenamed("position", "block"), "paths")
    raise AssertionError("a tree has at least one array")


def proofs(tree: Manifest, with_path: bool = False) -> DataFrame:
    """One row for each leaf: (name, id, position, leaf, claim, subroot, root, proof_sha256, folded_root, verified[, path]).

    ``path`` holds, level by level, the joined digests of the siblings before and after the node. ``folded_root`` is the
    root that the claim leads to along it; ``proof_sha256`` the digest of all siblings on the path.
    """
    kind = "g long, id long, position long, leaf string, claim string, proof_sha256 string, folded_root string" + ", path array<string>" * with_path

    def run(batches):
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                g, left, slots, top = (x.as_py() for x in row)
                levels = array_levels([s["digest"] for s in slots], left)
                rows = []
                for i, s in enumerate(slots):
                    path = siblings(levels, i) + top
                    node = s["claim"]
                    for k in range(0, len(path), 2):
                        node = digest(path[k] + node + path[k + 1])
                    rows.append((g, s["id"], s["position"], s["digest"], s["claim"], digest("".join(path)), node, *([path] if with_path else [])))
                names = [x.split()[0] for x in kind.split(", ")]
                types = [pa.int64()] * 3 + [pa.string()] * 4 + [pa.list_(pa.string())] * with_path
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    found = tree.arrays[0].join(above_leaves(tree), ["g", "block"]).select("g", "left", "slots", "path").mapInArrow(run, kind)
    return found.join(tree.groups, "g").drop("g").withColumn("verified", F.col("folded_root") == F.col("root"))


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(name, id, leaf, claim) of documents; where ``tampered`` holds, the claim is the leaf of the text with A-Z lower-cased."""
    head = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long")]
    changed = leaf_digest(*head, F.translate(F.col("text"), UPPER, LOWER))
    leaf = leaf_digest(*head, F.col("text"))
    return docs.select(F.col("lang").cast("string").alias("name"), F.col("doc_id").cast("long").alias("id"), leaf.alias("leaf"), F.when(tampered, changed).alias("claim"))


def document_manifest(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The tree over documents, a group for each language; leaves cover doc_id, source, lang, n_chars and text."""
    leaves = stored(document_leaves(docs, F.lit(False) if tampered is None else tampered), "leaves")
    return build(leaves.withColumn("claim", F.coalesce("claim", "leaf")))
