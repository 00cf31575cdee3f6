"""N-gram Jaccard join: every link between texts whose sets of word shingles are alike.

Method: sets that share one of their rarest shingles and are close in size meet in a tile; a
hashed bitmap per set, as long as the set's size band asks for, bounds the overlap from above by
bit counts; what passes is decided by exact intersection of sorted arrays.

A link needs a common shingle among the first n - ceil(t n) + 1 of both sets in any fixed order.
The order here puts frequent shingles last, so a passage that many documents share brings no
tile together. Equal sets are one class throughout. What passes the bit bound in a tile hangs
together in heaps, each set in one. A heap is dealt out in sides of bounded size, twice, and each
side joins what it can by exact comparison. What then does not belong to a heap's largest
component is dealt in sides of its own, and each of these meets every other side in a task of
two. So no component is missed, and no pair inside one is needed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import land
from .common import input_columns, lookup, output_field, text_slices, texts_of, tidy
from .components import components
from .textcodes import Texts

SHINGLE = 5
SIMILARITY = 80  # per cent
#: Shingles that a task counts together, and from how many it reports one as frequent.
COUNT_TOGETHER = 1 << 21
FREQUENT = 8
#: Frequent shingles that are put last, at most. It bears on speed alone: any order is right.
MOST_FREQUENT = 1 << 16
#: A tile up to this size is tried pair by pair at once.
SMALL_TILE = 8
#: Sets of one side of a tile or heap, and rows that a scan of tiles holds before it goes on piecewise.
SIDE = 1024
HELD = 4096
#: Bits of a bitmap per shingle, at least: more tell sets apart more sharply.
DENSITY = 2
_LOCAL_BITS = 33


def shingle_sets(texts: list[str], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    coded = Texts(texts, lower=True)
    words = coded.word_hashes()
    hashes, first = coded.windows(words, size)
    bounds = np.searchsorted(first, coded.spans())
    short = {}
    for n in range(1, size):
        whole, at = coded.windows(words, n)
        for h, d in zip(whole, coded.doc[at], strict=True) if (coded.n_words == n).any() else ():
            if coded.n_words[d] == n:
                short[int(d)] = h
    for i in range(coded.count):
        yield np.array([short[i]], np.uint64) if i in short else np.unique(hashes[bounds[i] : bounds[i + 1]])


@tidy
def _count_frequent(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def report():
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= FREQUENT
        return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["shingle", "n"])

    for batch in text_slices(batches):
        for own in shingle_sets(texts_of(batch), size):
            held.append(own)
            n += len(own)
        if n > COUNT_TOGETHER:
            yield report()
            held, n = [], 0
    if held:
        yield report()


def frequent_shingles(rows: DataFrame, size: int) -> np.ndarray:
    """The most frequent shingles, rarest first; at most MOST_FREQUENT reach the driver."""
    counts = rows.mapInArrow(lambda it: _count_frequent(it, size), "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = land(counts.withColumn("class", F.floor(F.log2("n")).cast("int")), "jaccard-frequent")
    classes = sorted(((r["class"], r["count"]) for r in counts.groupBy("class").count().collect()), reverse=True)
    total, cut = 0, None
    for found, n in classes:  # one row per power of two
        total += n
        if total > MOST_FREQUENT:
            break
        cut = found
    if cut is None:
        return np.zeros(0, np.uint64)
    chosen = counts.filter(F.col("class") >= cut).select("shingle", "n").toArrow()
    order = np.lexsort((chosen["shingle"].to_numpy(), chosen["n"].to_numpy()))
    return chosen["shingle"].to_numpy()[order].view(np.uint64)


def _bitmap(own: np.ndarray) -> bytes:
    """One bit per shingle in as many bits as the size band has: a power of two."""
    bits = max(64, DENSITY << (len(own) - 1).bit_length())
    flags = np.zeros(bits, bool)
    flags[(own & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def _prefix(own: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    n = len(own)
    at = np.minimum(np.searchsorted(frequent, own), max(0, len(frequent) - 1))
    often = frequent[at] == own if len(frequent) else np.zeros(n, bool)
    late = own[often][np.argsort(rank[at[often]])] if often.any() else own[:0]
    return np.concatenate([own[~often], late])[: n - -(-percent * n // 100) + 1]


SETS = "row bigint, doc_id {}, n bigint, class binary, bitmap binary, prefix array<bigint>"


@tidy
def _describe(batches: Iterator[pa.RecordBatch], size: int, percent: int, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per document; bitmap and prefix on the first of equal sets in a task."""
    base = TaskContext.get().partitionId() << _LOCAL_BITS
    order = np.argsort(frequent)
    ranked, rank = frequent[order], order
    seen: set[bytes] = set()
    row = 0
    for batch in text_slices(batches):
        n, name, bitmap, prefix = [], [], [], []
        for own in shingle_sets(texts_of(batch), size):
            key = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
            first = len(own) > 0 and key not in seen
            n.append(len(own))
            name.append(key if len(own) else None)
            bitmap.append(_bitmap(own) if first else None)
            prefix.append(_prefix(own, ranked, rank, percent).view(np.int64) if first else None)
            seen.add(key)
        rows = np.arange(base + row, base + row + len(n))
        row += len(n)
        columns = [pa.array(rows), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(name, pa.binary()), pa.array(bitmap, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n", "class", "bitmap", "prefix"])
        if len(seen) > 1 << 20:
            seen.clear()  # only costs repeats


TILES = "kind int, a bigint, b bigint"


@tidy
def _pairs_and_tiles(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """From rows (g, n, row) sorted by g and n: all pairs of small tiles (kind 0), and the
    members (kind 1: shingle, row) of larger ones."""
    carry = [np.zeros(0, np.int64)] * 3
    large = None  # the shingle of a tile whose first rows were already passed on

    def emit(g, n, row, last):
        nonlocal carry, large
        cut = len(g)
        if not last and len(g):
            cut = int(np.searchsorted(g, g[-1]))  # the last tile may go on
            if len(g) - cut > HELD:
                cut = len(g)
        done_g, done_n, done_row = g[:cut], n[:cut], row[:cut]
        keep = cut
        if cut == len(g) and not last and cut:
            keep = cut - 1  # the last row goes on as neighbour of the next
        bounds = np.flatnonzero(np.concatenate([[True], done_g[1:] != done_g[:-1], [True]])) if len(done_g) else np.zeros(1, np.int64)
        size = np.repeat(np.diff(bounds), np.diff(bounds)) if len(done_g) else np.zeros(0, np.int64)
        if large is not None:
            size = np.where(done_g == large, HELD, size)
        going_on = keep < cut
        if going_on:
            size = np.where(done_g == done_g[-1], HELD, size)
        a, b = [], []
        for step in range(1, SMALL_TILE):
            near = (done_g[step:] == done_g[:-step]) & (size[step:] <= SMALL_TILE)
            at = np.flatnonzero(near & (100 * done_n[:-step] >= percent * done_n[step:]))
            a.append(np.minimum(done_row[at], done_row[at + step]))
            b.append(np.maximum(done_row[at], done_row[at + step]))
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        member = np.flatnonzero(size > SMALL_TILE)
        if keep < cut:  # the last row has been counted in, and goes on only as neighbour
            member = member[member < keep]
        if cut:  # else the tile that was passed on in part may still go on
            large = done_g[-1] if going_on else None
        carry = [x[keep:] for x in (g, n, row)]
        kinds = np.concatenate([np.zeros(pairs.shape[1], np.int32), np.ones(len(member), np.int32)])
        return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([pairs[0], done_g[member]])), pa.array(np.concatenate([pairs[1], done_row[member]]))], ["kind", "a", "b"])

    for batch in batches:
        columns = [np.concatenate([c, batch.column(x).to_numpy()]) for c, x in zip(carry, ("g", "n", "row"), strict=True)]
        yield emit(*columns, last=False)
    yield emit(*carry, last=True)


def _fits(overlap: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether this many common shingles make a link, for the sum of both sizes."""
    return 100 * overlap >= percent * (sizes - overlap)


def _fold(bitmap: np.ndarray, length: int) -> np.ndarray:
    """The same set in a bitmap of fewer bits: halves are laid over each other."""
    while bitmap.shape[-1] > length:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] | bitmap[..., half:]
    return bitmap


def _bounded(a: bytes, b: bytes, sizes: int, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    length = min(len(x), len(y))
    differ = int(np.bitwise_count(_fold(x, length) ^ _fold(y, length)).sum())
    return bool(_fits(np.int64((sizes - differ) // 2), np.int64(sizes), percent))


@tidy
def _filter_bitmaps(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bitmap_a", "bitmap_b", "n_a", "n_b")]
        keep = [_bounded(x, y, n + m, percent) for x, y, n, m in zip(*columns, strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate([x, y]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _join_side(rows: list[dict], percent: int, exact: bool) -> pa.RecordBatch:
    """Pairs that join the components of one side, whose rows are sorted by size. A set meets the
    earlier ones of other components, the most promising by bit counts first; joined ones are
    not tried again. With `exact`, a pair must also be a link by its sorted arrays."""
    label = np.array([r["component"] for r in rows], np.int64)
    if exact:
        sets = [np.frombuffer(r["data"], np.uint64) for r in rows]
        maps = [np.frombuffer(_bitmap(x), np.uint8) for x in sets]
    else:
        maps = [np.frombuffer(r["data"], np.uint8) for r in rows]
    n = np.array([r["n"] for r in rows], np.int64)
    length = np.array([len(m) for m in maps])
    stacks = {b: np.stack([maps[k] for k in np.flatnonzero(length == b)]) for b in np.unique(length)}
    begin = {b: int(np.flatnonzero(length == b)[0]) for b in stacks}  # bands follow the order of sizes
    out = []
    for k, own in enumerate(maps):
        low = int(np.searchsorted(100 * n, percent * n[k]))
        near, bound = [], []
        for band in (len(own), len(own) // 2):
            if band not in stacks:
                continue
            lo, hi = max(low, begin[band]), min(k, begin[band] + len(stacks[band]))
            if lo >= hi:
                continue
            at = np.arange(lo, hi)[label[lo:hi] != label[k]]
            differ = np.bitwise_count(stacks[band][at - begin[band]] ^ _fold(own, band)).sum(1, dtype=np.int64)
            sizes = n[at] + n[k]
            fits = _fits((sizes - differ) // 2, sizes, percent)
            near.append(at[fits])
            bound.append(differ[fits] / sizes[fits])
        if not near:
            continue
        near = np.concatenate(near)[np.argsort(np.concatenate(bound), kind="stable")]
        for m in near:
            if label[m] != label[k] and (not exact or _fits(np.int64(_common(sets[k], sets[m])), n[k] + n[m], percent)):
                out.append((rows[k]["row"], rows[m]["row"]))
                label[label == label[m]] = label[k]
    found = np.sort(np.array(out, np.int64).reshape(-1, 2), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


@tidy
def _join_sides(batches: Iterator[pa.RecordBatch], percent: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tile, i, j, n): each side, or pair of sides, in turn."""
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and any(r[c] != held[0][c] for c in ("tile", "i", "j")):
                yield _join_side(held, percent, exact)
                held = []
            held.append(r)
    if held:
        yield _join_side(held, percent, exact)


def _dealt(rows: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Pairs (a, b) from rows (tile, i, j, n, row, component, data), each side in one task."""
    dealt = rows.select("tile", "i", "j", "n", "row", "component", "data").repartition("tile", "i", "j")
    return dealt.sortWithinPartitions("tile", "i", "j", "n", "row").mapInArrow(lambda it: _join_sides(it, percent, exact), "a bigint, b bigint")


@tidy
def _arrays(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        sets = [own.tobytes() for own in shingle_sets(texts_of(batch), size)]
        names = [hashlib.blake2b(own, digest_size=16).digest() for own in sets]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["class", "shingles"])


def _arrays_of(wanted: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """row, data (sorted shingles) of the wanted (row, doc_id, class), from their whole texts."""
    ids = land(wanted.select("doc_id").distinct(), "jaccard-wanted")
    found = lookup(texts, ids, ["doc_id"], "left_semi").select("text").mapInArrow(lambda it: _arrays(it, size), "class binary, shingles binary")
    # a repeated id may bring other texts along, and copies bring the same set again
    arrays = found.join(wanted.select("class", "row"), "class").groupBy("row").agg(F.min("shingles").alias("data"))
    return land(arrays, "jaccard-arrays")


def _labels(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows with the component that the links so far give them, by default their own."""
    return rows.join(linked, rows["row"] == linked["node"], "left").select(*rows.columns, F.coalesce("component", "row").alias("component"))


def _join_heaps(heaps: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Links that join the components of each heap (row, heap): after the first deal, those found
    last, and one of each row to its component so far."""
    sides = heaps.groupBy("heap").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("sides"))
    members = land(heaps.join(sides, "heap"), "jaccard-members")
    links = linked = None

    def joined(dealt: DataFrame) -> DataFrame:
        full = dealt.join(arrays, "row").select(F.col("heap").alias("tile"), "i", "j", (F.octet_length("data") / 8).cast("bigint").alias("n"), "row", "component", "data")
        found = _dealt(full, percent, exact=True)
        if linked is not None:
            found = found.unionByName(linked.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        return land(found, "jaccard-links")

    def parted(rows: DataFrame) -> DataFrame:
        """Labelled rows of the heaps that do not hang together yet."""
        nonlocal linked
        linked = components(links)
        rows = land(_labels(rows, linked), "jaccard-labels")
        open_heaps = rows.groupBy("heap").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
        return rows.join(open_heaps.select("heap"), "heap", "left_semi")

    for deal in (1, 2):
        labelled = members.withColumn("component", F.col("row")) if links is None else parted(members)
        links = joined(labelled.withColumn("i", F.pmod(F.xxhash64("row", F.lit(deal)), F.col("sides")).cast("int")).withColumn("j", F.lit(0)))
        members = members.filter("sides > 1")  # one side has seen all its pairs
        if members.isEmpty():
            return links
    rest = land(parted(members), "jaccard-rest")
    parts = rest.groupBy("heap", "component").agg(F.count(F.lit(1)).alias("rows")).groupBy("heap")
    parts = parts.agg(F.max_by("component", F.struct("rows", "component")).alias("largest"), F.max("rows").alias("inside"), F.sum("rows").alias("all"))
    apart, sides = F.ceil((F.col("all") - F.col("inside")) / SIDE).cast("int"), F.ceil(F.col("inside") / SIDE).cast("int")
    rest = rest.drop("sides").join(parts.select("heap", "largest", apart.alias("apart"), sides.alias("sides")), "heap")
    # sides of rows outside the largest component come first; the others need not meet each other
    inside, draw = F.col("component") == F.col("largest"), F.xxhash64("row")
    side = F.when(inside, F.col("apart") + F.pmod(draw, F.col("sides"))).otherwise(F.pmod(draw, F.col("apart"))).cast("int")
    last = F.when(inside, F.col("apart")).otherwise(F.col("apart") + F.col("sides")) - 1
    met = rest.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), last))).filter("side <> other")
    return joined(met.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")))


def similar_documents(docs: DataFrame, size: int = SHINGLE, percent: int = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, n_shingles, component_id: one row per document; component_id is the
    smallest id reachable by links of at least `percent` per cent Jaccard similarity.

    Null, empty and blank texts have no shingles and are linked with nothing, each its own
    component. Equal sets are linked. A null id counts as larger than any other; a component of
    null ids alone has a null id. Repeated rows and ids get a row each. An empty table gives
    none. Other columns are ignored."""
    texts = input_columns(docs, doc_id=id_col, text=text_col)
    frequent = frequent_shingles(texts.select("text"), size)
    ddl = SETS.format(output_field(texts, "doc_id"))
    sets = land(texts.mapInArrow(lambda it: _describe(it, size, percent, frequent), ddl), "jaccard-sets")

    # one node per class of equal sets: its smallest row that carries a prefix
    heads = sets.filter("prefix is not null").select("row", "class")
    classes = land(heads.groupBy("class").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("heads")), "jaccard-classes")
    spare = land(heads.join(classes.filter("heads > 1"), "class").filter("row <> node").select("row"), "jaccard-spare")
    nodes = lookup(sets.filter("prefix is not null"), spare, ["row"], "left_anti")

    entries = nodes.select(F.explode("prefix").alias("g"), "n", "row")
    entries = entries.repartition("g").sortWithinPartitions("g", "n", "row")
    found = land(entries.mapInArrow(lambda it: _pairs_and_tiles(it, percent), TILES), "jaccard-tiles")
    pairs = land(found.filter("kind = 0").select("a", "b").distinct(), "jaccard-pairs")
    maps = nodes.select("row", "n", "bitmap")

    def side(name: str) -> DataFrame:
        return maps.select(F.col("row").alias(name), F.col("n").alias(f"n_{name}"), F.col("bitmap").alias(f"bitmap_{name}"))

    bounded = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bitmap_a", "bitmap_b")
    bounded = land(bounded.mapInArrow(lambda it: _filter_bitmaps(it, percent), "a bigint, b bigint"), "jaccard-bounded")
    members = found.filter("kind = 1").select(F.col("a").alias("g"), F.col("b").alias("row"))
    edges = land(bounded.unionByName(_tile_edges(members, maps, percent)).distinct(), "jaccard-edges")
    heaps = land(components(edges).select(F.col("node").alias("row"), F.col("component").alias("heap")), "jaccard-heaps")
    wanted = land(heaps.select("row").join(nodes.select("row", "doc_id", "class"), "row"), "jaccard-nodes")
    links = _join_heaps(heaps, _arrays_of(wanted, texts, size), percent)

    linked = components(links)
    ids = sets.filter("class is not null").select("row", "doc_id", "class").join(classes.select("class", "node"), "class")
    ids = land(ids.join(linked, "node", "left").select("row", "doc_id", F.coalesce("component", "node").alias("component")), "jaccard-ids")
    smallest = ids.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = ids.join(smallest, "component").select("row", "component_id")
    every = sets.select("row", "doc_id", F.col("n").alias("n_shingles")).join(named, "row", "left")
    return every.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _tile_edges(members: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """Of larger tiles (g, row), pairs within the bit bound that hang together all such pairs: at
    most one per row and side. A tile is cut into sides, and each two of them meet in one task."""
    split = members.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("sides"))
    active = members.join(split, "g").join(maps, "row").withColumn("side", F.pmod(F.xxhash64("row"), F.col("sides")).cast("int"))
    dealt = active.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    dealt = dealt.select(F.col("g").alias("tile"), F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "n", "row", F.col("row").alias("component"), F.col("bitmap").alias("data"))
    return _dealt(dealt, percent, exact=False)
