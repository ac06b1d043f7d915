"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are turned by a fixed random rotation and cut into blocks of
dimensions. Two vectors within a squared distance D have a block in which they are
within D times the block's share of the dimensions, so every pair meets in a range join in one
of the blocks: on a grid over the block's first dimensions, whose cells are twice as
wide as the range, each vector stands in its own cell and visits those next to it
that its ball reaches. Vectors travel as 16-bit floats, whose error is bounded:
a task that holds a cell tells which pairs are surely linked and counts them where they
first agree, so that pairs are not sent on; only pairs within the error of the
threshold are looked up and decided in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.common import bound_batches, join_spread, materialize, mix64, stream64
from varloom.llm.components import components

U64 = np.uint64
BLOCKS = 8
#: Rows of a cell that are compared at once; the cells of more than this and of more than one in HOT_SHARE of all rows are dealt out by tiles.
TILE, HOT_SHARE = 256, 20_000
#: Rounding a vector of length one to 16-bit floats moves it by this at most; two of them by twice as much.
ROUNDING = 2.0**-11 + 1e-5
_SALT = stream64(977, 16)


def rotation(dims: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def cuts(dims: int, blocks: int) -> np.ndarray:
    """Where the blocks begin, and the end."""
    return np.linspace(0, dims, min(blocks, dims) + 1).astype(np.int64)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def visits(x: np.ndarray, reach: float, grid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cells, own) of the cells in which the rows take part: their own, and later neighbours that they reach.

    Of two vectors in neighbouring cells the one in the earlier cell visits the other.
    """
    x = x[:, :grid]
    width = 2.001 * reach
    cell = np.floor(x / width)
    inside = x - cell * width
    up = inside >= width / 2
    gap = np.where(up, width - inside, inside)
    masks = np.arange(1, 1 << x.shape[1])
    bits = (masks[:, None] >> np.arange(x.shape[1]) & 1).astype(bool)
    first = bits.argmax(axis=1)
    near = (gap * gap) @ bits.T.astype(float) <= reach * reach * (1 + 1e-9)
    row, m = np.nonzero(near & up[:, first])
    turned = cell[row] + np.where(bits[m], np.where(up[row], 1, -1), 0)
    own = np.zeros(len(x) + len(row), bool)
    own[: len(x)] = True
    return np.concatenate((np.arange(len(x)), row)), np.concatenate((cell, turned)).astype(np.int64), own


def cell_keys(group: np.ndarray, block: int, cells: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix64(group ^ _SALT[15]) + U64(block + 1) * _SALT[14]
        for j in range(cells.shape[1]):
            h = mix64(h + cells[:, j].astype(U64) * (_SALT[j % 14] | U64(1)))
    return h.view(np.int64)


def spread_over_cells(nodes: DataFrame, limit: float, blocks: int, grid: int, hot: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Without ``hot``: (cell, n), the rows that each batch brings to a cell. With it: a row for each cell and pair of tiles that a vector takes part in.

    ``nodes``: (id, h, grp, copies, vec). ``hot``: sorted cells and their numbers of tiles.
    """
    id_type = dict(nodes.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(4).value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begin = np.concatenate(([0], np.cumsum(size)))
            for dims in np.unique(size):
                rows = np.flatnonzero(size == dims)
                x = unit(flat[begin[rows][:, None] + np.arange(dims)]) @ rotation(int(dims))
                at = cuts(int(dims), blocks)
                half = x.astype(np.float16)
                with np.errstate(over="ignore"):
                    group = mix64(batch.column(2).take(pa.array(rows)).to_numpy(zero_copy_only=False).view(U64) + U64(dims))
                for j, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    reach = np.sqrt(limit * (b - a) / dims) + 4 * ROUNDING
                    row, cells, own = visits(x[:, a:b], reach, grid)
                    key = cell_keys(group[row], j, cells)
                    if hot is None:
                        key, many = np.unique(key, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(many)], names=["cell", "n"])
                        continue
                    # A vector in a cell of t tiles has a tile there and takes part in its t pairs of tiles.
                    place = np.minimum(np.searchsorted(hot[0], key), max(0, len(hot[0]) - 1))
                    tiles = np.where(hot[0][place] == key, hot[1][place], 1) if len(hot[0]) else np.ones(len(key), np.int64)
                    node = batch.column(1).take(pa.array(rows)).to_numpy(zero_copy_only=False).view(U64)
                    tile = (mix64(node[row] ^ _SALT[13]) % tiles.astype(U64)).astype(np.int64)
                    out = np.repeat(np.arange(len(row)), tiles)
                    other = np.arange(len(out)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
                    low, high = np.minimum(tile[out], other), np.maximum(tile[out], other)
                    take = rows[row[out]]
                    for c in range(0, len(out), 1 << 15):
                        s = slice(c, c + (1 << 15))
                        packed = half[row[out[s]]]
                        vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(int(2 * dims)), len(packed), [None, pa.py_buffer(packed.tobytes())]).cast(pa.binary())
                        ids = batch.column(0).take(pa.array(take[s]))
                        cols = [pa.array(key[out[s]]), pa.array(low[s]), pa.array(high[s]), pa.array(np.full(len(packed), j)), pa.array(tile[out[s]]), pa.array(own[out[s]]), ids]
                        rest = [batch.column(c).take(pa.array(take[s])) for c in (1, 3)]
                        yield pa.RecordBatch.from_arrays([*cols, *rest, vec], names=["cell", "low", "high", "block", "tile", "own", "id", "h", "copies", "vec"])

    if hot is None:
        return nodes.mapInArrow(run, "cell long, n long")
    return nodes.mapInArrow(run, f"cell long, low long, high long, block long, tile long, own boolean, id {id_type}, h long, copies long, vec binary")


def linked_pairs(x: np.ndarray, y: np.ndarray, block: int, limit: float, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sure) of the pairs of rows of ``x`` and ``y`` that this block is the first to agree in and that can be linked."""
    dims = x.shape[1]
    at = cuts(dims, blocks)
    share = np.sqrt(limit * np.diff(at) / dims) + 2 * ROUNDING
    a, b = x[:, at[block] : at[block + 1]], y[:, at[block] : at[block + 1]]
    near = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
    i, j = np.nonzero(near <= share[block] ** 2 + 1e-5)
    out_i, out_j, out_sure = [], [], []
    for c in range(0, len(i), 1 << 14):
        p, q = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
        each = np.add.reduceat(np.square(x[p].astype(np.float64) - y[q]), at[:-1], axis=1)
        total = np.sqrt(each.sum(axis=1))
        agree = each <= share**2
        owner = agree.argmax(axis=1)
        good = (owner == block) & agree[:, block] & (total <= np.sqrt(limit) + 2 * ROUNDING)
        out_i.append(p[good])
        out_j.append(q[good])
        out_sure.append(total[good] <= np.sqrt(limit) - 2 * ROUNDING)
    if not out_i:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_sure)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all():
            return root


def join_cells(placed: DataFrame, limit: float, blocks: int) -> DataFrame:
    """(id, h, id_b, h_b, links, kind) from rows of whole cells and tile pairs, in order.

    Kind 0: the links of a node, as far as this group counts them. 1: an edge of
    a forest of the sure links. 2: a pair to be decided.
    """
    id_type = dict(placed.dtypes)["id"]

    def group(columns: dict[str, np.ndarray], vec: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        n = len(vec)
        across = columns["low"][0] != columns["high"][0]
        side = columns["tile"] == columns["low"][0]
        left = np.flatnonzero(side) if across else np.arange(n)
        right = np.flatnonzero(~side) if across else left
        pairs: list[tuple] = []
        for a in range(0, len(left), 512):
            for b in range(0 if across else a, len(right), 512):
                p, q = left[a : a + 512], right[b : b + 512]
                i, j, sure = linked_pairs(vec[p], vec[q], int(columns["block"][0]), limit, blocks)
                i, j = p[i], q[j]
                good = columns["own"][i] | columns["own"][j]
                if not across:
                    good &= i < j
                pairs.append((i[good], j[good], sure[good]))
        i, j, sure = (np.concatenate([x[c] for x in pairs]) if pairs else np.zeros(0, bool if c == 2 else np.int64) for c in range(3))
        links = np.zeros(n, np.int64)
        np.add.at(links, i[sure], columns["copies"][j[sure]])
        np.add.at(links, j[sure], columns["copies"][i[sure]])
        some, root = np.flatnonzero(links), forest(n, i[sure], j[sure])
        low = np.flatnonzero(root != np.arange(n))
        a = np.concatenate((some, low, i[~sure]))
        b = np.concatenate((np.full(len(some), -1), root[low], j[~sure]))
        kind = np.repeat([0, 1, 2], [len(some), len(low), int((~sure).sum())])
        return [a, b, np.where(kind == 0, links[a], 0), kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = {c: table.column(c).to_numpy() for c in ("cell", "low", "high", "block", "tile", "own", "h", "copies")}
            vec, ids = table.column("vec").combine_chunks(), table.column("id").combine_chunks()
            _, offsets, data = vec.buffers()
            offsets = np.frombuffer(offsets, np.int32)[vec.offset : vec.offset + len(vec) + 1].astype(np.int64)
            data = np.frombuffer(data, np.uint8)
            change = np.flatnonzero((np.diff(columns["cell"]) != 0) | (np.diff(columns["low"]) != 0) | (np.diff(columns["high"]) != 0)) + 1
            bounds = np.concatenate(([0], change, [table.num_rows]))
            made: list[list[np.ndarray]] = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                # Cells of vectors of other lengths can't be the same but for a clash of hashes.
                if b - a < 2 or (np.diff(offsets[a : b + 1]) != offsets[a + 1] - offsets[a]).any():
                    continue
                x = data[offsets[a] : offsets[b]].view(np.float16).reshape(b - a, -1).astype(np.float32)
                p, q, links, kind = group({c: v[a:b] for c, v in columns.items()}, x)
                if len(p):
                    made.append([p + a, np.where(q < 0, -1, q + a), links, kind])
            if made:
                p, q, links, kind = (np.concatenate([m[c] for m in made]) for c in range(4))
                other = pa.array(np.maximum(q, 0), mask=q < 0)
                h = table.column("h").combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(p)), h.take(pa.array(p)), ids.take(other), h.take(other), pa.array(links), pa.array(kind)], names=["id", "h", "id_b", "h_b", "links", "kind"])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            if not held.num_rows:
                continue
            keys = np.stack([held.column(c).to_numpy() for c in ("cell", "low", "high")])
            last = np.flatnonzero((keys != keys[:, -1:]).any(axis=0))
            if len(last):
                yield from work(held.slice(0, last[-1] + 1))
                held = held.slice(last[-1] + 1)
        if held is not None and held.num_rows:
            yield from work(held)

    return placed.mapInArrow(run, f"id {id_type}, h long, id_b {id_type}, h_b long, links long, kind long")


def cosine_udf():
    @F.arrow_udf("double")
    def cosine(left: pa.Array, right: pa.Array) -> pa.Array:
        """In double precision; the vectors of a row have the same length."""
        out = np.empty(len(left))
        for i in range(len(out)):
            x, y = (np.asarray(v[i].values.to_numpy(zero_copy_only=False), dtype=np.float64) for v in (left, right))
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            out[i] = (x @ y) / np.sqrt((x @ x) * (y @ y))
        return pa.array(out)

    return cosine


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label", threshold: float = 0.98, blocks: int = BLOCKS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``.

    ``n_links`` is the number of other rows with the same group and a cosine of
    ``threshold`` (above 0) or more, ``component_id`` the smallest id that links lead to, the row's own included, and
    ``kept`` tells whether that is the row's own. All links are found, also in groups of copies of any
    size. Rows link with nothing if the group or the id is null, the vector is
    null, empty, zero or has components that are null or not finite; vectors of different lengths don't link. Rows
    that share an id are rows of their own. A row without an id has a null component and is kept.

    Equal vectors of a group are joined first and go on as one. The grid has as many dimensions as
    the largest group's size asks for; this changes the work and not the result.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    limit = 2 - 2 * threshold
    raw = vectors.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), F.col(vec_col).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.col("id").isNotNull() & F.col("grp").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    raw = raw.withColumn("fine", F.coalesce(fine, F.lit(False)))
    good = raw.filter("fine").withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0))).withColumn("h", F.xxhash64("grp", "vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))
    same = materialize(good.groupBy("grp", "h", "h2").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.any_value("vec").alias("vec")).withColumn("grp", F.xxhash64("grp")))

    largest = same.groupBy("grp").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    # A cell has about a third of the rows in each dimension.
    grid = int(np.clip(np.ceil(np.log(max(1, largest) / TILE) / np.log(3)), 1, 8))
    crowd = materialize(spread_over_cells(same.select("id", "h", "grp", "copies", "vec"), limit, blocks, grid, None).groupBy("cell").agg(F.sum("n").alias("n")))
    total = crowd.agg(F.sum("n")).first()[0] or 0
    # No more than HOT_SHARE cells can be above this bound.
    bound = max(TILE, total / HOT_SHARE)
    hot = crowd.filter(F.col("n") > bound).orderBy("cell").toArrow()
    tiles = (hot.column("cell").to_numpy(), -(-hot.column("n").to_numpy() // int(bound)))
    placed = spread_over_cells(same.select("id", "h", "grp", "copies", "vec"), limit, blocks, grid, tiles)
    placed = placed.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    met = materialize(join_cells(placed, limit, blocks))

    node = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("h"))
    close = met.filter("kind = 2").select("id", "h", "id_b", "h_b").distinct()
    of = same.select("id", "h", "copies", "vec")
    full = close.join(of, ["id", "h"]).join(of.select(F.col("id").alias("id_b"), F.col("h").alias("h_b"), F.col("copies").alias("copies_b"), F.col("vec").alias("vec_b")), ["id_b", "h_b"])
    decided = materialize(full.withColumn("cosine", cosine_udf()("vec", "vec_b")).filter(F.col("cosine") >= threshold).select("id", "h", "copies", "id_b", "h_b", "copies_b"))
    edges = met.filter("kind = 1").select(node("id", "h").alias("a"), node("id_b", "h_b").alias("b")).union(decided.select(node("id", "h"), node("id_b", "h_b")))
    found = components(edges).select(F.col("node.id").alias("rep"), F.col("node.h").alias("h"), F.col("component.id").alias("component_id"))
    counted = met.filter("kind = 0").select("id", "h", "links").union(decided.select("id", "h", "copies_b")).union(decided.select("id_b", "h_b", "copies"))
    counted = counted.groupBy("id", "h").agg(F.sum("links").alias("links")).withColumnRenamed("id", "rep")

    result = same.select(F.col("id").alias("rep"), "h", "h2", "copies").join(counted, ["rep", "h"], "left").join(found, ["rep", "h"], "left")
    result = result.select("h", "h2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    out = join_spread(good.select("id", "h", "h2"), materialize(result), ["h", "h2"], "copies")
    out = out.select("id", "n_links", "component_id")
    alone = raw.filter("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
