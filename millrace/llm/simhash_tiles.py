"""SimHash near-duplicates by exact comparison of tiles of fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import few, written
from .common import arrow_map, extended, fresh, parallelism, slices, text_bytes
from ..operators.components import components

SEED = 42
#: Fingerprints in a tile, give or take a few: 512 KiB of 64-bit words. Tiles of fewer are made for more tasks, of
#: LEAST_ROWS at least.
TILE_ROWS, LEAST_ROWS = 65_536, 1024
#: Fingerprints in the tiles of a block: a task holds two blocks at a time.
BLOCK_ROWS = 1 << 18
#: Rows of a tile whose bounds are compared at once.
STRIP = 64

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the shingles of ``width`` words of the ASCII-lower-cased text; fewer words make one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts)
    )


def fingerprint(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` words of 64 bits; a bit is 1 if it is set in over half of the hashes. Lane 0 takes the hashes
    themselves, the others a mix of hash and lane."""
    if not len(hashes):
        return np.zeros(lanes, np.uint64)
    counts = np.zeros((lanes * 8, 256), np.int64)
    for at in range(0, len(hashes), 8192):
        part = hashes[at : at + 8192]
        mixed = np.empty((len(part), lanes), np.uint64)
        mixed[:, 0] = part
        for lane in range(1, lanes):
            x = part + np.uint64(0x9E3779B97F4A7C15 * lane & (2**64 - 1))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed[:, lane] = x ^ (x >> np.uint64(31))
        cells = mixed.view(np.uint8).astype(np.int64) + np.arange(lanes * 8) * 256
        counts += np.bincount(cells.ravel(), minlength=lanes * 2048).reshape(-1, 256)
    ones = (counts @ _BITS).ravel() * 2 > len(hashes)
    return np.packbits(ones, bitorder="little").view(np.uint64)


def quarters(words: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters of each word."""
    return np.bitwise_count(np.ascontiguousarray(words).view(np.uint16).reshape(-1, 4)).astype(np.int64)


def fingerprints(docs: DataFrame, text: str, width: int, lanes: int, keep: list[str], name: str = "fp") -> DataFrame:
    """The columns ``keep`` with the fingerprint ``name`` (binary, ``lanes`` big-endian words)."""
    schema = extended(docs.select(*keep).schema, f"{name} binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [fingerprint(shingle_hashes(t, width), lanes).byteswap().tobytes() for t in text_bytes(batch.column(text))]
            columns = [batch.column(c) for c in keep] + [pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, name])

    return arrow_map(docs.select(*dict.fromkeys([*keep, text])), run, schema)


def _pack(lanes: int, radius: int, total: int):
    """Fingerprints sorted by tile to tiles: the words, nodes and roots of their rows.

    The root of a row is the first row of the tile that it is joined with by links inside the tile.
    """

    def tile(number: int, rows: list[tuple[bytes, int]]) -> pa.RecordBatch:
        fps = np.frombuffer(b"".join(r[0] for r in rows), ">u8").astype(np.uint64).reshape(-1, lanes)
        counts = quarters(fps[:, 0])
        order, ones = np.lexsort(counts.T[::-1]), counts.sum(axis=1)
        fps, nodes = fps[order], np.array([r[1] for r in rows], np.int64)[order]
        roots = linked(fps, fps, True, radius, total, Forest(len(fps))).label
        made = [number, int(ones.min()), int(ones.max()), fps.tobytes(), nodes.tobytes(), roots.astype(np.int64).tobytes()]
        return pa.RecordBatch.from_pylist([dict(zip(ARROW_TILE.names, made, strict=True))], schema=ARROW_TILE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = -1, []
        for batch in batches:
            for t, *row in zip(*(batch.column(c).to_pylist() for c in ("tile", "fp", "node")), strict=True):
                if rows and t != number:
                    yield tile(number, rows)
                    rows = []
                rows.append(row)
                number = t
        if rows:
            yield tile(number, rows)

    return run


ARROW_TILE = pa.schema([("tile", pa.int64()), ("low", pa.int32()), ("high", pa.int32())] + [(c, pa.binary()) for c in ("fps", "nodes", "roots")])
TILE_DDL = "tile bigint, low int, high int, fps binary, nodes binary, roots binary"


class Forest:
    """Union by smallest index over numbered nodes, many links at a time."""

    def __init__(self, size: int, label: np.ndarray | None = None):
        self.label = np.arange(size) if label is None else label.copy()

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (jumped := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = jumped


def _boxes(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, cuts = quarters(fps[:, 0]), np.arange(0, len(fps), STRIP)
    return np.minimum.reduceat(q, cuts, axis=0), np.maximum.reduceat(q, cuts, axis=0)


def linked(a: np.ndarray, b: np.ndarray, same: bool, radius: int, total: int, forest: Forest) -> Forest:
    """Links the rows of tile ``a``, numbered first in the forest, with those of ``b`` (``a`` with itself if they are the same).

    Strips of rows are compared whole, unless the population counts of their quarters already differ by more
    than the radius in sum, which no pair within the radius can do.
    """
    shift = 0 if same else len(a)
    (low_a, high_a), (low_b, high_b) = _boxes(a), _boxes(b)
    first = np.ascontiguousarray(b[:, 0])
    for k in range(len(low_a)):
        apart = np.maximum(0, np.maximum(low_a[k] - high_b, low_b - high_a[k])).sum(axis=1)
        strips = np.flatnonzero(apart <= radius)
        if same:
            strips = strips[strips >= k]
        rows = a[k * STRIP : (k + 1) * STRIP]
        for at in range(0, len(strips), 64):
            columns = (strips[at : at + 64, None] * STRIP + np.arange(STRIP)).ravel()
            columns = columns[columns < len(b)]
            near = np.bitwise_count(rows[:, :1] ^ first[columns]) <= radius
            if not near.any():
                continue
            i, j = np.nonzero(near)
            i, j = i + k * STRIP, columns[j]
            if a.shape[1] > 1:
                close = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.int64) <= total
                i, j = i[close], j[close]
            forest.link(i, j + shift)
    return forest


class Joined:
    """Nodes that the links of a task have joined so far: what earlier links imply is left out."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, node: int) -> int:
        above = self.above
        while (parent := above.get(node, node)) != node:
            above[node] = above.get(parent, parent)
            node = parent
        return node

    def links(self, nodes: np.ndarray, roots: np.ndarray, forest: Forest) -> pa.RecordBatch:
        """New links (a, b) of the roots of two tiles that the forest has joined to others."""
        own = np.unique(roots)
        moved = own[forest.label[own] != own]
        out = []
        for a, b in zip(nodes[moved].tolist(), nodes[forest.label[moved]].tolist(), strict=True):
            x, y = self.root(a), self.root(b)
            if x != y:
                self.above[max(x, y)] = min(x, y)
                out.append((a, b))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _compare(lanes: int, radius: int, total: int):
    """Links of the tiles of cells, which come sorted by cell: of all pairs of tiles of one block, or of two blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined, cell, held = Joined(), None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["cell"] != cell:
                    cell, held = row["cell"], []
                fps = np.frombuffer(row["fps"], np.uint64).reshape(-1, lanes)
                nodes, roots = (np.frombuffer(row[c], np.int64) for c in ("nodes", "roots"))
                for block, high, fps_a, nodes_a, roots_a in held:
                    if row["low"] - high > radius or (block == row["block"]) != row["same"]:
                        continue
                    both = np.concatenate([roots_a, roots + len(fps_a)])
                    forest = linked(fps_a, fps, False, radius, total, Forest(len(both), both))
                    yield joined.links(np.concatenate([nodes_a, nodes]), both, forest)
                held.append((row["block"], row["high"], fps, nodes, roots))

    return run


def _members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, top) of the rows of tiles that are not roots themselves."""
    for batch in batches:
        for row in batch.select(["nodes", "roots"]).to_pylist():
            nodes, roots = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["roots"], np.int64)
            joined = np.flatnonzero(roots != np.arange(len(roots)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[joined]), pa.array(nodes[roots[joined]])], names=["node", "top"])


def similar_groups(prints: DataFrame, item: str, radius: int, lanes: int = 1, total: int | None = None, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(fp, component): each distinct fingerprint of ``prints`` (``item``, ``fp``) with the smallest item of its component.

    Two fingerprints link if their first words differ in at most ``radius`` bits and, with several lanes, all words
    in at most ``total`` bits. Copies fall together before anything is compared; distinct fingerprints lie in tiles
    in the order of their population counts, as many as their number asks for, not as there are partitions. Rows are
    joined inside their tile first. Tiles make blocks, and each two blocks whose counts differ by at most ``radius`` a
    cell, the work of one task: so a fingerprint is sent once for each block, in one exchange. A task returns those links
    between roots of tiles that its earlier ones do not imply, so a family of near copies adds rows as it grows, not
    pairs. Every pair within the radius is compared.
    """
    spark, total = prints.sparkSession, total if total is not None else radius
    distinct = few(prints.groupBy("fp").agg(F.min(item).alias("least")), prints.count())
    groups = written(distinct.withColumn("node", F.monotonically_increasing_id()), "fingerprints")
    # 17^4 places at most.
    counts = arrow_map(groups.select("fp"), _places(lanes), "place bigint").groupBy("place").count().orderBy("place").toArrow()
    places, sizes = counts["place"].to_numpy(), counts["count"].to_numpy()
    rows = int(sizes.sum())
    side = ceil((4 * parallelism(spark)) ** 0.5)
    number = max(1, -(-rows // tile_rows), min(side, rows // LEAST_ROWS))
    block = max(1, min(BLOCK_ROWS // tile_rows, number // side))
    ranks = spark.sparkContext.broadcast((places, np.cumsum(sizes) - sizes, sizes))
    # Places are counted again here: a stage with two steps in Python keeps twice the workers in an executor's memory.
    tiled = arrow_map(groups.select("fp", "node", F.crc32("fp").alias("crc")), _tiled(ranks, -(-rows // number), lanes), "fp binary, node bigint, tile bigint")
    tiled = tiled.repartitionByRange(number, "tile").sortWithinPartitions("tile")
    tiles = written(arrow_map(tiled, _pack(lanes, radius, total), TILE_DDL), "tiles").withColumn("block", F.floor(F.col("tile") / block))
    bounds = written(few(tiles.groupBy("block").agg(F.min("low").alias("low"), F.max("high").alias("high")), number), "blocks")
    cells = (
        bounds.select(F.col("block").alias("a"), F.col("high").alias("high_a"))
        .crossJoin(bounds.select(F.col("block").alias("b"), F.col("low").alias("low_b")))
        .where(F.col("a") <= F.col("b"))
        .where(F.col("low_b") - F.col("high_a") <= radius)
        .select(F.concat_ws(" ", "a", "b").alias("cell"), (F.col("a") == F.col("b")).alias("same"), F.array_distinct(F.array("a", "b")).alias("blocks"))
    )
    full = tiles.join(cells.select("cell", "same", F.explode("blocks").alias("block")), "block")
    full = full.repartition(parallelism(spark), "cell").sortWithinPartitions("cell", "tile")
    found = components(arrow_map(full, _compare(lanes, radius, total), "a bigint, b bigint"))
    inside = arrow_map(tiles.select("nodes", "roots"), _members, "node bigint, top bigint")
    topped = groups.join(inside, "node", "left").withColumn("node", F.coalesce("top", "node")).drop("top")
    named = topped.join(found, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    return named.join(least, "root").select("fp", "component")


def _place(prints: pa.Array, lanes: int) -> np.ndarray:
    """The population count of the first word and of its quarters, as one number."""
    words = np.frombuffer(b"".join(prints.to_pylist()), ">u8").astype(np.uint64).reshape(-1, lanes)[:, 0]
    q = quarters(words)
    return (((q.sum(axis=1) * 32 + q[:, 0]) * 32 + q[:, 1]) * 32 + q[:, 2]) * 32 + q[:, 3]


def _places(lanes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place(batch.column("fp"), lanes))], names=["place"])

    return run


def _tiled(ranks, tile_rows: int, lanes: int):
    """The tile of each row: its rank by place over the rows of a tile. Rows of one place are ranked by their CRC32."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, starts, sizes = ranks.value
        for batch in batches:
            at = np.searchsorted(places, _place(batch.column("fp"), lanes))
            share = batch.column("crc").to_numpy() / 2.0**32
            tile = (starts[at] + (share * sizes[at]).astype(np.int64)) // tile_rows
            yield pa.RecordBatch.from_arrays([*batch.select(["fp", "node"]).columns, pa.array(tile)], names=["fp", "node", "tile"])

    return run


def near_duplicates(docs: DataFrame, item: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(item, fingerprint, component_id): fingerprint as 16 hex digits, and the smallest item of the component.

    Null and empty texts have the fingerprint zero and link like any other. Repeated rows each give a row. A null
    item never names a component that holds another one. An empty table gives no rows; other columns are ignored.
    """
    prints = written(fingerprints(docs, text, width, 1, [item]).withColumnRenamed(item, "item"), "prints")
    named = prints.join(similar_groups(prints, "item", radius), "fp")
    return named.select(
        F.col("item").alias(item), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id")
    )


#: A pair of near copies has a Jaccard similarity of at least LEAST[0] / LEAST[1].
LEAST = 4, 5
#: Bits of 256, and of the first 64, within which a pair is compared by its shingles. A pair at the threshold differs
#: in 39 bits, give or take 6, and in 10 of 64, give or take 3; of very few shingles (4 of 5) in 48 and 12.
STAGE_LANES, STAGE_TOTAL, STAGE_RADIUS = 4, 64, 21
#: Members and bytes of shingles in a tile of a crowd.
CROWD_ROWS, CROWD_BYTES = 256, 1 << 22
#: Rounds in which the members of a crowd of several tiles are compared with one of them first.
STARS = 3
#: Rows with the shingles of a text for which a table gets a task and a file of its own.
SET_ROWS = 1 << 13

_HEAVY = ["label", "fps", "nodes", "roots", "sizes", "sets"]
CROWD_TILE = pa.schema(
    [("tile", pa.int64()), ("crowd", pa.int64()), ("label", pa.int64())]
    + [(c, pa.binary()) for c in ("fps", "nodes", "roots", "sizes", "sets")]
)
CROWD_DDL = "tile bigint, crowd bigint, label bigint, fps binary, nodes binary, roots binary, sizes binary, sets binary"


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct hashes of the five-word shingles, sorted."""
    return np.unique(shingle_hashes(text, 5))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the least Jaccard similarity; two empty sets have it."""
    if not len(a) or not len(b):
        return len(a) == len(b)
    common = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
    return LEAST[1] * common >= LEAST[0] * (len(a) + len(b) - common)


def _marks(text: str, fp: str, digest: str):
    """Each row with the fingerprint and a digest of its set of shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints, digests = [], []
            for t in text_bytes(batch.column(text)):
                shingles = shingle_set(t)
                prints.append(fingerprint(shingles, STAGE_LANES).byteswap().tobytes())
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
            columns = [*batch.columns, pa.array(prints, pa.binary()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, fp, digest])

    return run


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        sets = pa.array([shingle_set(t).tobytes() for t in text_bytes(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.select(["node", "crowd", "n", "fp"]).columns, sets], names=["node", "crowd", "n", "fp", "shingles"])


def _stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members that are alike to the star of their crowd, and the star."""
    for batch in slices(batches):
        sides = zip(batch.column("shingles"), batch.column("star_shingles"), strict=True)
        hit = [alike(*(np.frombuffer(x.as_py(), np.uint64) for x in side)) for side in sides]
        yield batch.select(["node", "star"]).filter(pa.array(hit, pa.bool_()))


def _crowd_tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members sorted by crowd and label to tiles of one crowd and label, joined inside."""
    number, rows, key, held = TaskContext.get().partitionId() << 32, [], None, 0

    def tile() -> pa.RecordBatch:
        nodes, prints, sets = zip(*rows, strict=True)
        sizes = np.array([len(x) // 8 for x in sets], np.int64)
        fps = np.frombuffer(b"".join(prints), ">u8").astype(np.uint64)
        made = dict(zip(CROWD_TILE.names, [number, *key, fps.tobytes(), np.array(nodes, np.int64).tobytes(), b"", sizes.tobytes(), b"".join(sets)], strict=True))
        # The members of a labelled tile are joined by their star.
        roots = np.zeros(len(rows), np.int64) if key[1] >= 0 else alike_forest(made, None).label
        return pa.RecordBatch.from_pylist([made | {"roots": roots.astype(np.int64).tobytes()}], schema=CROWD_TILE)

    for batch in slices(batches):
        for crowd, label, *row in zip(*(batch.column(c).to_pylist() for c in ("crowd", "label", "node", "fp", "shingles")), strict=True):
            if rows and ((crowd, label) != key or len(rows) == CROWD_ROWS or held + len(row[2]) > CROWD_BYTES):
                yield tile()
                number, rows, held = number + 1, [], 0
            rows.append(row)
            key, held = (crowd, label), held + len(row[2])
    if rows:
        yield tile()


def alike_forest(a: dict, b: dict | None) -> Forest:
    """Links of the members of two tiles, over their roots, or within ``a``. Pairs that are joined already are not compared."""

    def parts(tile):
        sizes = np.frombuffer(tile["sizes"], np.int64)
        sets = np.split(np.frombuffer(tile["sets"], np.uint64), np.cumsum(sizes)[:-1])
        return np.frombuffer(tile["fps"], np.uint64).reshape(-1, STAGE_LANES), sizes, sets

    left = parts(a)
    right, shift = (left, 0) if b is None else (parts(b), len(left[1]))
    forest = Forest(len(left[1])) if b is None else Forest(shift + len(right[1]), tile_roots(a, b))
    for i, (print_, size, shingles) in enumerate(zip(*left, strict=True)):
        open_ = forest.label[shift:] != forest.label[i]
        if b is None:
            open_[: i + 1] = False
        open_ &= LEAST[1] * np.minimum(size, right[1]) >= LEAST[0] * np.maximum(size, right[1])
        others = np.flatnonzero(open_)
        others = others[np.bitwise_count(right[0][others] ^ print_).sum(axis=1, dtype=np.int64) <= STAGE_TOTAL]
        hit = np.array([j for j in others if alike(shingles, right[2][j])], np.int64)
        forest.link(np.full(len(hit), i), hit + shift)
    return forest


def tile_roots(a: dict, b: dict) -> np.ndarray:
    first = np.frombuffer(a["roots"], np.int64)
    return np.concatenate([first, np.frombuffer(b["roots"], np.int64) + len(first)])


def _across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    joined = Joined()
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            a, b = ({c: row[f"{c}_{side}"] for c in _HEAVY} for side in "ab")
            yield joined.links(np.frombuffer(a["nodes"] + b["nodes"], np.int64), tile_roots(a, b), alike_forest(a, b))


def verified_links(members: DataFrame) -> DataFrame:
    """Links (a, b) that join the ``members`` (node, crowd, n, fp, shingles) of a crowd as all its pairs within
    ``STAGE_TOTAL`` bits do that have the least similarity. ``n`` is the size of the crowd.

    A crowd of several tiles is compared with one of its members first: what is alike to it is joined. After some such
    rounds members are joined inside tiles, and every pair of tiles is compared, except those of one star; it returns
    links between the roots of the tiles. So no pair is left out, a crowd of copies of one text costs its size only,
    and links are as many as members.
    """
    large, rows = members.where(F.col("n") > CROWD_ROWS), members.count()
    stars = members.sparkSession.createDataFrame([], "node bigint, star bigint")
    for _ in range(0 if large.isEmpty() else STARS):
        rest = large.join(stars, "node", "left_anti").select("node", "crowd", "shingles")
        star = rest.groupBy("crowd").agg(F.min("node").alias("star"))
        # One row for each crowd of several tiles, in a table whose size Spark sees.
        star = star.join(rest.select(F.col("node").alias("star"), F.col("shingles").alias("star_shingles")), "star")
        star = written(few(star, rows // CROWD_ROWS, SET_ROWS), "star")
        met = few(rest.join(star, "crowd").select("node", "shingles", "star", "star_shingles"), rows, SET_ROWS)
        stars = written(stars.union(arrow_map(met, _stars, "node bigint, star bigint")), "stars")
    labelled = members.join(stars.withColumnRenamed("star", "label"), "node", "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    keys = ["crowd", "label", "node"]
    sorted_ = labelled.select(*keys, "fp", "shingles").repartitionByRange(*keys).sortWithinPartitions(*keys)
    # Before the step that numbers tiles by task.
    tiles = written(arrow_map(few(sorted_, rows, SET_ROWS), _crowd_tiles, CROWD_DDL), "crowds")
    meta = tiles.select("crowd", "tile", "label")
    pairs = (
        meta.toDF("crowd", "a", "label_a")
        .join(meta.toDF("crowd", "b", "label_b"), "crowd")
        .where("a < b and (label_a <> label_b or label_a < 0)")
        .select("a", "b")
    )
    full = (
        pairs.join(tiles.select(F.col("tile").alias("a"), *[F.col(c).alias(f"{c}_a") for c in _HEAVY]), "a")
        .join(tiles.select(F.col("tile").alias("b"), *[F.col(c).alias(f"{c}_b") for c in _HEAVY]), "b")
        .repartition(parallelism(members.sparkSession), "a", "b")
    )
    inside = arrow_map(tiles.where("label < 0").select("nodes", "roots"), _members, "node bigint, top bigint").toDF("a", "b")
    return arrow_map(full, _across, "a bigint, b bigint").union(inside).union(stars.select(F.col("node").alias("a"), F.col("star").alias("b")))


def crowds(sets: DataFrame) -> DataFrame:
    """(node, crowd, fp, n) of the ``sets`` (node, fp) that lie within the radius and ``STAGE_TOTAL`` bits of another one,
    directly or through others: every pair of tiles is compared. ``n`` is the size of the crowd."""
    groups = similar_groups(sets, "node", STAGE_RADIUS, STAGE_LANES, STAGE_TOTAL)
    placed = written(few(sets.join(groups, "fp").select("node", F.col("component").alias("crowd"), "fp"), sets.count()), "placed")
    sizes = placed.groupBy("crowd").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return placed.join(sizes, "crowd")


def deduplicate(docs: DataFrame, item: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest item stays.

    Two rows link if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Tiles of
    fingerprints of 256 bits are compared by exclusive-or, all pairs of them, and put sets that may be so alike into crowds:
    a similarity of 0.8 is a cosine of 0.89 or more, an angle of 27 degrees and 39 bits, give or take 6,
    while unrelated texts differ in 128 bits, give or take 8. Pairs that pass are compared by their shingles before they
    link. Texts without words, null ones too, are copies of each other. Of rows that share the item too, one stays; rows
    with a null item come last. All columns come back as they are, whatever their names; an empty table gives no rows.
    """
    row, fp, digest = fresh(docs, "row", "fp", "digest")
    marked = docs.withColumn(row, F.monotonically_increasing_id())
    schema = extended(marked.schema, f"{fp} binary, {digest} binary")
    full = written(arrow_map(marked, _marks(text, fp, digest), schema), "marked")
    # Rows are ranked by item, null last, then by row number.
    rank = F.struct(F.col(item).isNull().alias("n"), F.col(item).alias("i"), F.col(row).alias("r"))
    prints = full.select(F.col(fp).alias("fp"), F.col(digest).alias("digest"), rank.alias("rank"))
    sets = prints.groupBy("fp", "digest").agg(F.min("rank").alias("rank"))
    sets = written(few(sets.select("fp", "rank", F.col("rank.r").alias("node")), full.count()), "sets")
    some, rows = crowds(sets.select("node", "fp")).select("node", "crowd", "n", "fp"), sets.count()
    texts = few(full.select(F.col(row).alias("node"), F.col(text).alias("text")).join(some, "node"), rows, SET_ROWS)
    members = written(arrow_map(texts, _sets, "node bigint, crowd bigint, n bigint, fp binary, shingles binary"), "members")
    found = components(verified_links(members))
    named = sets.select("node", "rank").join(found, "node", "left").select("rank", F.coalesce("component", "node").alias("root"))
    keep = named.groupBy("root").agg(F.min("rank").alias("least")).select(F.col("least.r").alias(row))
    return full.join(keep, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
