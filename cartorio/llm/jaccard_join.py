"""N-gram Jaccard join: documents whose sets of word shingles are alike, by R-trees over count vectors.

``jaccard_components`` links two documents when 100 * |A & B| >= 75 * |A | B| for their sets of distinct
5-word shingles, and returns the connected components of the links.

1. A set becomes 64-bit shingle hashes; equal sets are one class from here on, whatever their number.
2. Shingles fall into groups by hash. Two linked sets differ in few groups, so they agree wholly in many:
   the content of a group is a blocking key. Long sets keep the keys whose own hash is low, so that a linked
   pair is expected to share 28 kept keys at least (none with a probability below 1e-11); sets of under 64
   shingles keep every shingle, which loses nothing. Sizes differ by a third at most, so a set also joins
   the blocks of the next lower power of two where its partners may be there.
3. In a block, sets are points of group counts. A sort-tile R-tree joins them: summed coordinate minima of
   two boxes, or two points, bound the overlap from above; what cannot reach the overlap that
   the sizes call for is cut off. Pairs of one known component are left out, as only components are asked for.
4. Surviving pairs are verified on their whole sets.

Hot groups: a first pass verifies the best partner of every member of a block only, which joins a group of
copies by as many links as members; blocks that hold several components after that are joined for all pairs. Blocks of
over ``CHUNK`` members are worked on as pairs of chunks in separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartorio.llm.graph import components
from cartorio.llm.hashing import mix, shingle_sets, word_hashes
from cartorio.llm.shared import Scratch, small_batches

#: Overlap needed: 100 * shared >= 75 * union, that is 175 * shared >= 75 * (sum of sizes).
LINK, WHOLE = 75, 100
#: Kept keys that a linked pair is expected to share.
WITNESSES = 28
#: Largest block, or part of one, that a task holds at once.
CHUNK = 4096
LEAF = 64
#: Bits that tell a scan which rows are wanted, a power of two (8 MB for the driver and each task), and bits in a row of them.
BITS, BUCKET = 1 << 26, 32768
#: Stands for a null id where rows are told apart.
NO_ID = -1
#: Names that a task remembers to leave out repeats early.
REMEMBERED = 500_000
_U = np.uint64


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in small_batches(batches, "text"):
        yield batch, shingle_sets(*word_hashes(batch.column("text")))


def _identity(tokens: np.ndarray) -> tuple[int, int]:
    return int(mix(tokens ^ _U(0x51)).sum(dtype=_U)), int(mix(tokens ^ _U(0xA3)).sum(dtype=_U))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, sets in _sets(batches):
        names = np.array([_identity(s) for s in sets], _U).reshape(-1, 2)
        sizes = pa.array([len(s) for s in sets], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), sizes, _signed(names[:, 0].copy()), _signed(names[:, 1].copy())], ["doc_id", "n", "node", "twin"]
        )


def block_keys(tokens: np.ndarray) -> np.ndarray:
    """Blocking keys of one ascending set: contents of its hash groups, for its own power of two and, if its
    partners may be smaller by one, for the next lower one."""
    n = len(tokens)
    own = n.bit_length() - 1
    found = []
    for level in (own, own - 1):
        top = 2 ** (level + 1) - 1
        if level < 0 or 3 * n > 4 * top and level < own:
            continue
        salt = _U(level + 1) * _U(0x9E37)
        if level < 6:
            keys = mix(tokens ^ salt)
        else:
            groups = 2 ** (level + 1 if level == 6 else level)
            place = tokens >> _U(64 - groups.bit_length() + 1)
            first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            with np.errstate(over="ignore"):
                keys = mix(np.add.reduceat(mix(tokens), first) ^ mix(place[first] ^ salt))
            if level > 6:
                rate = min(1.0, WITNESSES / (0.44 * groups))
                keys = keys[keys < _U(int(rate * (2**64 - 1)))]
        found.append(keys)
    return np.concatenate(found)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()  # copies within a task give the same keys, once is enough; repeats do no harm
    for _, sets in _sets(batches):
        if len(seen) > REMEMBERED:
            seen.clear()
        keys, nodes = [], []
        for tokens in sets:
            if len(tokens) == 0:
                continue
            node = _identity(tokens)[0]
            if node not in seen:
                seen.add(node)
                keys.append(block_keys(tokens))
                nodes.append(np.full(len(keys[-1]), node, _U))
        if keys:
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), _signed(np.concatenate(nodes))], ["block", "node"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of two members or more, from rows in order of block and node; equal member lists get one name.

    A block of over ``CHUNK`` members is handed on in parts, so that none is held whole.
    """
    known: set[int] = set()
    held_block = held_node = np.zeros(0, np.int64)
    part = 0  # parts handed on of the block at the end of what was seen

    def emit(blocks, nodes, last):
        nonlocal part, held_block, held_node
        fresh = np.append(True, (blocks[1:] != blocks[:-1]) | (nodes[1:] != nodes[:-1]))
        blocks, nodes = blocks[fresh], nodes[fresh]
        first = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
        sizes = np.diff(np.append(first, len(blocks)))
        keep = len(first) if last else len(first) - 1
        rows = []
        if len(known) > REMEMBERED:
            known.clear()  # repeats are dropped after the exchange
        for at, size in zip(first[:keep].tolist(), sizes[:keep].tolist()):
            goes_on = part > 0 and at == 0
            if size < 2 and not goes_on:
                continue
            members = nodes[at : at + size]
            if goes_on:
                rows.append((blocks[at], part, members))
                part = 0
                continue
            name = int(mix(members.view(_U)).sum(dtype=_U)) & (2**63 - 1)
            if name not in known:
                known.add(name)
                rows.append((name, 0, members))
        tail = first[keep] if keep < len(first) else len(blocks)
        held_block, held_node = blocks[tail:], nodes[tail:]
        if not last and len(held_node) > CHUNK:
            rows.append((held_block[0], part, held_node[:-1]))
            part += 1
            held_block, held_node = held_block[-1:], held_node[-1:]
        if rows:
            counts = [len(r[2]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), counts)),
                    pa.array(np.repeat(np.array([r[1] for r in rows], np.int32), counts)),
                    pa.array(np.concatenate([r[2] for r in rows])),
                ],
                ["block", "part", "node"],
            )

    for batch in batches:
        if batch.num_rows:
            blocks = np.concatenate([held_block, batch.column(0).to_numpy()])
            nodes = np.concatenate([held_node, batch.column(1).to_numpy()])
            yield from emit(blocks, nodes, False)
    if len(held_block):
        yield from emit(held_block, held_node, True)


def count_vector(tokens: np.ndarray) -> np.ndarray:
    """Number of shingles in each hash group. One or two shingles a group, so that the minima of two sets
    exceed their overlap by little: pairs of a similarity under about 0.65 are cut off."""
    groups = 2 ** min(12, max(4, len(tokens).bit_length() - 1))
    return np.bincount((tokens >> _U(65 - groups.bit_length())).astype(np.int64), minlength=groups).astype(np.uint16)


def row_bits(wanted: DataFrame) -> np.ndarray:
    """Bits of the rows (node, first) that a scan is to hand on: BITS of them, whatever the number of rows.

    The more rows there are, the more others pass; joins by node leave them out.
    """
    place = F.col("node").bitwiseXOR(F.coalesce("first", F.lit(NO_ID))).bitwiseAND(BITS - 1)
    packed = wanted.select(place.alias("p")).groupBy(F.floor(F.col("p") / BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.col("p") % BUCKET).alias("bits"))
    bits = np.zeros(BITS // 8, np.uint8)
    for row in packed.collect():
        at = row.bucket * BUCKET // 8
        bits[at : at + BUCKET // 8] = np.frombuffer(row.bits, np.uint8)
    return bits


def _rows_of(bits: np.ndarray, make, name: str):
    """From texts to (node, what ``make`` makes of a set), for rows whose bit is set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches):
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            nodes = np.array([_identity(s)[0] for s in sets], _U).view(np.int64)
            places = (nodes ^ ids) & (BITS - 1)
            asked = np.flatnonzero((bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1)
            made = [make(sets[i]).tobytes() for i in asked.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[asked]), pa.array(made, pa.binary())], ["node", name])

    return work


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        right = []
        left, name = None, None
        for a, x, y in zip(batch.column("a").to_pylist(), batch.column("tokens_a"), batch.column("tokens_b")):
            if a != name:
                left, name = np.frombuffer(x.as_buffer(), _U), a
            other = np.frombuffer(y.as_buffer(), _U)
            small, large = (left, other) if len(left) <= len(other) else (other, left)
            at = np.searchsorted(large, small)
            shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            right.append(WHOLE * shared >= LINK * (len(left) + len(other) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(right, pa.bool_()))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose whole sets are linked."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(_verified, "a long, b long")


class RTree:
    """A packed R-tree over the count vectors of one block. Levels go from leaves up; a node is a box."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        spread = counts.var(axis=0)
        order = np.lexsort((counts[:, int(spread.argmax())], sizes))
        # Tiles by size, then by the coordinate that varies most, then by the next one.
        tile = max(LEAF, int(np.ceil(np.sqrt(len(sizes) / LEAF))) * LEAF)
        second = counts[:, int(np.argsort(spread)[-2])] if counts.shape[1] > 1 else sizes
        self.order = np.concatenate([part[np.argsort(second[part], kind="stable")] for part in (order[i : i + tile] for i in range(0, len(order), tile))])
        self.counts, self.sizes = counts[self.order], sizes[self.order]
        self.levels = []
        high, least = self.counts, self.sizes
        while True:
            cuts = np.arange(0, len(least), LEAF)
            high, least = np.maximum.reduceat(high, cuts, axis=0), np.minimum.reduceat(least, cuts)
            self.levels.append((high, least))
            if len(least) == 1:
                break

    @staticmethod
    def reach(high_a, least_a, high_b, least_b) -> np.ndarray:
        """Summed minima of pairs of boxes (or points) as a share of the overlap that a linked pair needs at least."""
        # A minimum is the number of levels that both reach, so the sum of minima is a product of level marks.
        bound = np.zeros((len(high_a), len(high_b)), np.float32)
        for level in range(1, int(min(high_a.max(), high_b.max())) + 1):
            used = (high_a >= level).any(axis=0) & (high_b >= level).any(axis=0)
            bound += (high_a[:, used] >= level).astype(np.float32) @ (high_b[:, used] >= level).astype(np.float32).T
        return (WHOLE + LINK) * bound.astype(np.float64) / (LINK * (least_a[:, None] + least_b[None, :]))

    def join(self, other: "RTree") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions of points in both trees that may be linked and their reach, leaf pair by leaf pair. Within one tree, each pair once."""
        same = other is self
        stack = [(len(self.levels) - 1, 0, len(other.levels) - 1, 0)]
        while stack:
            la, a, lb, b = stack.pop()
            if la < 0 and lb < 0:
                continue
            a_kids = np.arange(a * LEAF, min((a + 1) * LEAF, self._width(la - 1)))
            b_kids = np.arange(b * LEAF, min((b + 1) * LEAF, other._width(lb - 1)))
            reach = self.reach(*self._at(la - 1, a_kids), *other._at(lb - 1, b_kids))
            ok = np.nonzero(reach >= 1)
            at_a, at_b = (x[y] for x, y in zip((a_kids, b_kids), ok))
            if la == 0:
                reach = reach[ok]
                if same:
                    at_a, at_b, reach = (x[at_a < at_b] for x in (at_a, at_b, reach))
                if len(at_a):
                    yield self.order[at_a], other.order[at_b], reach
                continue
            stack += [(la - 1, i, lb - 1, j) for i, j in zip(at_a.tolist(), at_b.tolist()) if not same or i <= j]

    def _width(self, level: int) -> int:
        return len(self.sizes) if level < 0 else len(self.levels[level][1])

    def _at(self, level: int, which: np.ndarray):
        high, least = (self.counts, self.sizes) if level < 0 else self.levels[level]
        return high[which], least[which]

    def lifted(self, height: int) -> "RTree":
        """The same tree with single-box levels on top."""
        while len(self.levels) < height:
            self.levels.append(self.levels[-1])
        return self


def candidates(component: np.ndarray, vectors: list[np.ndarray], side: np.ndarray | None, nearest: bool) -> Iterator[np.ndarray]:
    """Pairs of places in a block, in different components, that the bound lets through.

    With ``side``, pairs of the two sides only. With ``nearest``, of each member the pair of the highest bound.
    """
    width = min(len(v) for v in vectors)
    counts = np.stack([v.reshape(width, -1).sum(axis=1, dtype=np.uint16) for v in vectors])
    sizes = counts.sum(axis=1, dtype=np.int64)
    if side is None:
        parts = (np.arange(len(component)),) * 2
        tree = RTree(counts, sizes)
        found = tree.join(tree)
    else:
        parts = tuple(np.flatnonzero(side == s) for s in (0, 1))
        if not all(map(len, parts)):
            return
        trees = [RTree(counts[p], sizes[p]) for p in parts]
        height = max(len(t.levels) for t in trees)
        found = trees[0].lifted(height).join(trees[1].lifted(height))
    best, partner = np.zeros(len(component)), np.zeros(len(component), np.int64)

    for a, b, reach in found:
        a, b = parts[0][a], parts[1][b]
        apart = component[a] != component[b]
        a, b, reach = a[apart], b[apart], reach[apart]
        if not nearest:
            if len(a):
                yield np.stack([a, b], axis=1)
            continue
        for x, y in ((a, b), (b, a)):
            rising = np.argsort(reach, kind="stable")
            x, y, high = x[rising], y[rising], reach[rising]
            last = np.zeros(len(component))
            last[x] = high  # of equal places the last, that is the highest, stays
            better = (high == last[x]) & (high > best[x])
            best[x[better]], partner[x[better]] = high[better], y[better]
    if nearest and best.any():
        yield np.stack([np.flatnonzero(best), partner[best > 0]], axis=1)


def _tree_pairs(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
    """R-tree join of every (block, i, j), from rows in that order."""

    def work(table: pa.Table):
        i, j, part = table["i"][0].as_py(), table["j"][0].as_py(), table["part"].to_numpy()
        nodes = table["node"].to_numpy()
        vectors = [np.frombuffer(v.as_buffer(), np.uint16) for v in table["counts"].combine_chunks()]
        found = candidates(table["component"].to_numpy(), vectors, None if i == j else (part == j).astype(int), nearest)
        block, lists = table["block"][0].as_py(), table["blocks"].combine_chunks()
        places, flat = lists.offsets.to_numpy(), lists.flatten().to_numpy()
        known: dict[int, set[int]] = {}

        def blocks_of(row: int) -> set[int]:
            if row not in known:
                known[row] = set(flat[places[row] - places[0] : places[row + 1] - places[0]].tolist())
            return known[row]

        for pairs in found:
            if not nearest:
                # A pair may meet in many blocks: the first one that both are in hands it on.
                pairs = pairs[[min(blocks_of(a) & blocks_of(b)) == block for a, b in pairs.tolist()]]
            if len(pairs):
                yield np.sort(nodes[pairs], axis=1)

    held, recent = [], set()

    def done():
        for pairs in work(pa.Table.from_batches(held)):
            rows = [p for p in map(tuple, pairs.tolist()) if p not in recent]
            recent.update(rows)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in rows], pa.int64()), pa.array([p[1] for p in rows], pa.int64())], ["a", "b"])
            if len(recent) > REMEMBERED:  # only saves repeats, the pairs are made distinct later
                recent.clear()

    name = None
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("block", "i", "j"))))
        start = 0
        for at, key in enumerate(keys):
            if key != name:
                if at > start:
                    held.append(batch.slice(start, at - start))
                if held:
                    yield from done()
                held, name, start = [], key, at
        if len(keys) > start:
            held.append(batch.slice(start))
    if held:
        yield from done()


def tree_join(blocks: DataFrame, sets: DataFrame, labels: DataFrame, nearest: bool) -> DataFrame:
    """Distinct candidate pairs (a, b) of all blocks that hold more than one component of ``labels``."""
    mixed = blocks.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_blocks = mixed.groupBy("block").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max("part").alias("last"), F.count("*").alias("members")).filter("low <> high").select("block", "last", "members")
    rows = mixed.join(open_blocks, "block").select("block", "part", "last", "members", "node", "component")
    if nearest:
        # Blocks that are the largest one of a member: this pass is to join up most, the next one loses nothing.
        largest = rows.groupBy("node").agg(F.max_by("block", F.struct("members", "block")).alias("block"))
        rows = rows.join(largest.select("block").distinct(), "block").withColumn("blocks", F.array("block"))
    else:
        # A set has a bounded number of keys, and so of blocks.
        rows = rows.join(rows.groupBy("node").agg(F.collect_set("block").alias("blocks")), "node")
    # A block in parts is joined part by part: each part meets itself and every other one.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    rows = rows.select("block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "component", "blocks")
    rows = rows.join(sets.select("node", "counts"), "node").repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
    rows = rows.select("block", "i", "j", "part", "node", "component", "counts", "blocks")
    return rows.mapInArrow(lambda batches: _tree_pairs(batches, nearest), "a long, b long").distinct()


def merged(labels: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Labels (node, component) after further links."""
    ends = [labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")) for end in ("a", "b")]
    above = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    tops = components(above, scratch, name)
    old = labels.join(tops.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    new = tops.join(labels, "node", "left_anti")
    return scratch.keep(old.select("node", F.coalesce("top", "component").alias("component")).unionByName(new.select("node", "component")), f"{name}-merged")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Links and sets are as in the module's text. A text that is null, empty or without words has no shingles
    and is linked with nothing: component_id is its own id. Repeated rows and equal texts share a component,
    the smallest id in it names it. Sets are told apart by their contents, so an id may stand on several texts, each
    in its own component, and a text of null ids alone links others but names nothing: a component without any id
    has a null one. Texts are whole, however long. Other columns are ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = scratch.keep(docs.mapInArrow(_classes, "doc_id long, n long, node long, twin long"), "classes")
    classes = named.filter("n > 0").groupBy("node", "twin", "n").agg(F.min("doc_id").alias("first"))

    keys = docs.mapInArrow(_keys, "block long, node long").repartition("block").sortWithinPartitions("block", "node")
    blocks = keys.mapInArrow(_blocks, "block long, part int, node long").dropDuplicates(["block", "part", "node"])
    blocks = scratch.keep(blocks, "blocks")

    members = scratch.keep(blocks.select("node").distinct().join(classes, "node").select("node", "first"), "members")

    def made(wanted: DataFrame, make, column: str, name: str) -> DataFrame:
        """(node, column) of the wanted classes, in a scan of the documents: texts stay where they are read."""
        rows = scratch.keep(docs.mapInArrow(_rows_of(row_bits(wanted), make, column), f"node long, {column} binary"), name)
        return rows.groupBy("node").agg(F.first(column).alias(column))

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs that whole sets confirm; only sets of nodes in pairs are made."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        return verify(pairs, made(members.join(ends, "node"), lambda tokens: tokens, "tokens", name))

    counts = made(members, count_vector, "counts", "counts")
    apart = docs.sparkSession.createDataFrame([], "node long, component long")
    # First the likeliest partner of every member of a block, which joins up what belongs together; then all the rest.
    near = scratch.keep(tree_join(blocks, counts, apart, nearest=True), "near")
    second = merged(apart, linked(near, "near-sets"), scratch, "second")
    rest = scratch.keep(tree_join(blocks, counts, second, nearest=False).join(near, ["a", "b"], "left_anti"), "rest")
    final = merged(second, linked(rest, "rest-sets"), scratch, "third")

    placed = classes.join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    table = scratch.keep(placed.join(smallest, "component").select("node", "twin", "n", "component_id"), "placed")
    scratch.drop("blocks", "members", "counts", "near", "near-sets", "rest", "rest-sets", "second-merged", "third-merged")
    return named.join(table, ["node", "twin", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
