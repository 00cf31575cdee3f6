"""Merkle manifest of a dataset: digests of rows, of languages and of the whole, with proofs.

Method: time-forward processing. Nodes are labelled so that a child comes before its parent; a
priority queue ordered by label delivers each node's digest to its parent. A second sweep over the
labels in reverse delivers to each node the suffix of its proof, from the root to the leaves.

The queue's outer part is Spark's sort: blocks of 2^BLOCK_LEVELS neighbouring nodes exchange
messages as rows (tree, block, index), tier by tier, so no language has to fit into one task.
Within a block a heap holds the messages; as labels follow the last leaf under a node, it never
holds more than one message per level."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import land
from .common import input_columns, lookup, output_field
from .ranks import positions

BLOCK_LEVELS = 10
#: Rows whose id's checksum this divides are tampered with, in the query's drill.
TAMPER_EVERY = 7
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_LEVEL_BITS = 6
_LEFT, _RIGHT = "<", ">"  # on which side a proof's sibling stands


def _digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


# --- one block ---------------------------------------------------------------------------


def _label(level: int, index: int, size: int) -> int:
    """Rises from children to parents: the last leaf under the node, then its level."""
    return ((min((index + 1) << level, size) - 1) << _LEVEL_BITS) | level


def sweep_up(leaves: list[str], levels: int) -> dict[tuple[int, int], str]:
    """Digests of all nodes (level, index) over the leaves, up to the given level."""
    size, known, queue = len(leaves), {}, []

    def settle(level: int, index: int, digest: str) -> None:
        known[level, index] = digest
        if level < levels:
            heapq.heappush(queue, (_label(level + 1, index >> 1, size), index, digest))

    for at, leaf in enumerate(leaves):
        settle(0, at, leaf)
        while queue and queue[0][0] >> _LEVEL_BITS == at:
            label, index, digest = heapq.heappop(queue)
            parts = [digest]
            while queue and queue[0][0] == label:
                parts.append(heapq.heappop(queue)[2])
            settle(label & ((1 << _LEVEL_BITS) - 1), index >> 1, _digest(*parts))
    return known


def sweep_down(known: dict[tuple[int, int], str], size: int, levels: int, suffix: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(index, proof) of each leaf, last leaf first. A proof has one entry per level: the
    sibling's side and digest, or empty where a node has none. Entries are shared as chains."""
    queue = [(-_label(levels, 0, size), 0, None)]
    while queue:
        label, index, chain = heapq.heappop(queue)
        level = -label & ((1 << _LEVEL_BITS) - 1)
        if level == 0:
            proof = []
            while chain:
                entry, chain = chain
                proof.append(entry)
            yield index, proof + suffix
            continue
        for child in (2 * index, 2 * index + 1):
            if (level - 1, child) in known:
                other = known.get((level - 1, child ^ 1))
                entry = "" if other is None else (_LEFT if child & 1 else _RIGHT) + other
                heapq.heappush(queue, (-_label(level - 1, child, size), child, (entry, chain)))


def fold(leaf: str, proof: list[str]) -> str:
    """The root that a leaf and its proof give."""
    for entry in proof:
        leaf = _digest(entry[1:], leaf) if entry[:1] == _LEFT else _digest(leaf, entry[1:])
    return leaf


def _levels(nodes: int, block_levels: int) -> int:
    return min(block_levels, (nodes - 1).bit_length())


# --- blocks as rows ----------------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of rows with equal (tree, block) of a sorted partition, as lists by column."""
    key, held = None, {}
    for batch in batches:
        columns = batch.to_pydict()
        for i, own in enumerate(zip(columns["tree"], columns["block"], strict=True)):
            if own != key:
                if key is not None:
                    yield key, held
                key, held = own, {name: [] for name in columns}
            for name, values in columns.items():
                held[name].append(values[i])
    if key is not None:
        yield key, held


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _by_block(nodes: DataFrame, block_levels: int) -> DataFrame:
    """Nodes of a block together and in order; blocks are bounded, so no task holds a tree."""
    nodes = nodes.withColumn("block", F.shiftright("index", block_levels))
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "index")


def _tier_above(nodes: DataFrame, block_levels: int) -> DataFrame:
    """One node per block: tree, index, nodes (in the tree at this tier), digest."""
    schema = pa.schema([("tree", pa.int64()), ("index", pa.int64()), ("nodes", pa.int64()), ("digest", pa.binary())])

    def work(batches):
        def rows():
            for (tree, block), held in _blocks(batches):
                nodes_here = held["nodes"][0]
                levels = _levels(nodes_here, block_levels)
                top = sweep_up([d.hex() for d in held["digest"]], levels)[levels, 0]
                yield tree, block, (nodes_here + (1 << block_levels) - 1) >> block_levels, bytes.fromhex(top)

        yield from _batches(rows(), schema)

    ordered = _by_block(nodes.select("tree", "index", "nodes", "digest"), block_levels)
    return ordered.mapInArrow(work, "tree bigint, index bigint, nodes bigint, digest binary")


def _tiers(leaves: DataFrame, block_levels: int) -> list[DataFrame]:
    """The leaves and the tiers above them, up to one node per tree."""
    tiers = [leaves]
    while True:
        tiers.append(land(_tier_above(tiers[-1], block_levels), "merkle-tier"))
        if tiers[-1].filter("nodes > 1").isEmpty():
            return tiers


def _with_suffixes(nodes: DataFrame, suffixes: DataFrame, block_levels: int) -> DataFrame:
    """Nodes in order of their blocks, each block after the row that carries its suffix."""
    messages = suffixes.select("tree", (F.col("index").cast("long") * (1 << block_levels)).alias("start"), "suffix")
    messages = messages.select("tree", F.col("start").alias("index"), F.lit(0).alias("turn"), "suffix")
    both = messages.unionByName(nodes.withColumn("turn", F.lit(1)), allowMissingColumns=True)
    both = both.withColumn("block", F.shiftright("index", block_levels))
    return both.repartition("tree", "block").sortWithinPartitions("tree", "block", "turn", "index")


def _proofs(held: dict[str, list], block_levels: int) -> Iterator[tuple[int, list[str]]]:
    """(row in `held`, proof) of a block whose first row is the suffix."""
    levels = _levels(held["nodes"][1], block_levels)
    known = sweep_up([d.hex() for d in held["digest"][1:]], levels)
    for at, proof in sweep_down(known, len(held["digest"]) - 1, levels, held["suffix"][0]):
        yield at + 1, proof


def _tier_below(nodes: DataFrame, suffixes: DataFrame, block_levels: int) -> DataFrame:
    """tree, index, suffix of each node of a tier, from those of the tier above."""
    schema = pa.schema([("tree", pa.int64()), ("index", pa.int64()), ("suffix", pa.list_(pa.string()))])

    def work(batches):
        rows = ((key[0], held["index"][at], proof) for key, held in _blocks(batches) for at, proof in _proofs(held, block_levels))
        yield from _batches(rows, schema)

    ordered = _with_suffixes(nodes.select("tree", "index", "nodes", "digest"), suffixes, block_levels)
    return ordered.mapInArrow(work, "tree bigint, index bigint, suffix array<string>")


def _leaf_proofs(leaves: DataFrame, suffixes: DataFrame, block_levels: int) -> DataFrame:
    """tree, doc_id, leaf, proof_sha256, folded_root of each leaf."""
    kind, arrow_kind = output_field(leaves, "doc_id"), to_arrow_type(leaves.schema["doc_id"].dataType)
    schema = pa.schema([("tree", pa.int64()), ("doc_id", arrow_kind), *((n, pa.string()) for n in ("leaf", "proof_sha256", "folded_root"))])

    def work(batches):
        def rows():
            for (tree, _), held in _blocks(batches):
                for at, proof in _proofs(held, block_levels):
                    leaf, other = held["digest"][at].hex(), held["other"][at]
                    siblings = _digest(*[entry[1:] for entry in proof])
                    yield tree, held["doc_id"][at], leaf, siblings, fold(other.hex() if other else leaf, proof)

        yield from _batches(rows(), schema)

    ordered = _with_suffixes(leaves, suffixes, block_levels)
    return ordered.mapInArrow(work, f"tree bigint, doc_id {kind}, leaf string, proof_sha256 string, folded_root string")


# --- the manifest ------------------------------------------------------------------------


def leaf_digest(**replaced: Column) -> Column:
    """Digest of a row: each field as its UTF-8 byte count, a colon and its value, or `-`."""
    parts = []
    for name in _FIELDS:
        value = replaced.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def merkle_manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Return doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, one row per input row.

    `docs` needs doc_id, source, lang, n_chars and text; other columns are ignored. The leaves of
    a language are ordered by id; its tree's root is `subroot`, and the subroots in order of the
    languages are the leaves of the tree of `root`. A node without a sibling is hashed alone, but
    a tree of one leaf is that leaf. `folded_root` is what a proof gives for the leaf as a drill
    finds it: with n_chars one larger where 7 divides the checksum of the id, if n_chars is there.

    Null language: a language of its own, before all others, apart from the empty one. Null id:
    first in its language, never tampered with. Equal ids: in order of their leaves; equal rows have
    equal leaves, and each has the proof of its own place. Null fields count as `-`, an empty text
    as `0:`. Texts of any length are hashed whole, where they are stored. An empty table gives no
    rows."""
    fields = input_columns(docs, **{name: name for name in _FIELDS})
    struck = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0) & F.col("n_chars").isNotNull()
    changed = leaf_digest(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1)
    rows = fields.select("doc_id", "lang", leaf_digest().alias("digest"), F.when(struck, changed).alias("other"))
    placed, langs = positions(rows, ["lang"], ["doc_id", "digest"], "index")
    langs = langs.withColumnRenamed("size", "nodes")
    numbered, _ = positions(langs, [], ["lang"], "tree")
    leaves = lookup(placed, land(numbered, "merkle-langs"), ["lang"]).select("tree", "index", "nodes", "digest", "doc_id", "other")
    leaves = land(leaves, "merkle-leaves")

    tiers = _tiers(leaves, block_levels)
    subroots = tiers[-1]
    count = subroots.count()
    if count == 0:
        return leaves.select("doc_id", *[F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(True).alias("verified"))
    over = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(count).cast("long").alias("nodes"), "digest")
    roots = _tiers(over, block_levels)
    root = bytes(roots[-1].first()["digest"]).hex()

    suffixes = roots[-1].select("tree", "index", F.array().cast("array<string>").alias("suffix"))
    for tier in reversed(roots[:-1]):
        suffixes = _tier_below(tier, suffixes, block_levels)
    suffixes = suffixes.select(F.col("index").alias("tree"), F.lit(0).cast("long").alias("index"), "suffix")
    for tier in reversed(tiers[1:-1]):
        suffixes = _tier_below(tier, suffixes, block_levels)
    proven = _leaf_proofs(leaves, suffixes, block_levels)
    known = subroots.select("tree", F.lower(F.hex("digest")).alias("subroot"))
    return lookup(proven, known, ["tree"]).select(
        "doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )
