"""Near-duplicate embeddings by NN-descent: a neighbour graph refined through neighbours of neighbours.

1. Vectors are normalised; equal ones collapse to one point, which weighs as many as it stands for. Vectors
   of different lengths are never alike: each length is searched apart.
2. The first lists of k neighbours come from blocks of like random-hyperplane codes; a block of more than
   BLOCK points is dealt into several by hash.
3. Each round joins every point's neighbours, in both directions, with one another (Dong et al., 2011); only
   pairs with an edge that is new since the last round are compared. A point that very many list is dealt
   into several hubs, so that all of them take part. Rounds end when they find hardly any new edge above the
   threshold, of lists that aren't saturated.
4. A list is saturated when all its k edges reach the threshold, so it may lack some. It is enlarged to the
   whole connected group of edges above the threshold. The links of a group are counted, not listed: by the
   angles x, y of two members to the group's mean, they are linked for certain if x + y is at most the
   threshold's angle (triangle inequality), which a histogram of angles counts; the other pairs have a
   member beyond half that angle and are compared, in tiles.
5. Recall is audited: the exact links of a bounded sample of points are counted by comparison with all, apart
   for those within and outside the groups of step 4. Below `min_recall`, of links or in the mean of the
   sampled points that have some, all is repeated with lists twice as long and further codes, keeping the
   edges found. If the last attempt is below it too, all points are compared, in tiles.
6. A link is a pair of cosine similarity at or above the threshold; classes are connected by links.

Rows with a null id give no row. Rows that repeat an id and a normalised vector are one; an id of several
vectors has a row for each, which count as links of each other if alike. A null, empty, zero or non-finite
vector has a row of its id without links. Ids may be of any type that sorts. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import col, extended, written
from sparkloom.llm.graph import components, sure_links

BLOCK = 4096
TILE = 1024
#: Steps of an angle up to the threshold's.
STEPS = 4096
_EDGE = "src bigint, dst bigint, sim float"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.float32).reshape(len(values), -1)


def _edges(src: np.ndarray, dst: np.ndarray, sim: np.ndarray) -> pa.Table:
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "sim": pa.array(np.round(sim, 6), pa.float32())})


def unit_vectors(rows: DataFrame, size: int) -> DataFrame:
    """(id, vec): distinct normalised vectors of a length, as float32 bytes, of rows (id, vec) of usable vectors."""

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            x /= np.abs(x).max(axis=1, initial=0, keepdims=True)  # else squares might overflow
            unit = (x / np.linalg.norm(x, axis=1, keepdims=True) + 0.0).astype(np.float32)  # + 0.0: no negative zero
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([u.tobytes() for u in unit], pa.binary())], ["id", "vec"])

    return rows.where(F.size("vec") == size).select("id", "vec").mapInArrow(normalise, extended(rows.select("id").schema, "vec binary")).distinct()


def _first_lists(points: DataFrame, n: int, k: int, tables: int, seed: int) -> DataFrame:
    """Edges to the k nearest of each point's block, in each of so many tables."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / 256)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            if planes is None:
                planes = np.random.default_rng(seed).normal(size=(x.shape[1], tables, bits))
            side = np.einsum("nd,dtb->ntb", x, planes) > 0
            codes = (side * (1 << np.arange(bits))).sum(axis=2) * tables + np.arange(tables)
            where = np.repeat(np.arange(len(x)), tables)
            yield pa.RecordBatch.from_arrays([pa.array(codes.ravel(), pa.int64()), batch.column(0).take(pa.array(where))], ["code", "id"])

    def nearest(table: pa.Table) -> pa.Table:
        ids, x = table["id"].to_numpy(), _matrix(table["vec"])
        near, out = min(k, len(ids) - 1), []
        for a in range(0, len(ids), 512):
            s = x[a : a + 512] @ x.T
            s[np.arange(len(s)), a + np.arange(len(s))] = -2
            top = np.argpartition(-s, near, axis=1)[:, :near]
            out.append((np.repeat(ids[a : a + 512], near), ids[top].ravel(), np.take_along_axis(s, top, 1).ravel()))
        return _edges(*[np.concatenate(c) for c in zip(*out)])

    coded = points.select("id", "vec").mapInArrow(code, "code bigint, id bigint")
    sizes = coded.groupBy("code").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    coded = coded.join(sizes, "code").withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), "parts"))
    return coded.join(points.select("id", "vec"), "id").select("code", "part", "id", "vec").groupBy("code", "part").applyInArrow(nearest, _EDGE)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges of each source; an edge that comes twice is new only if each is."""
    edges = edges.where("src <> dst").groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    nth = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return edges.withColumn("nth", nth).where(F.col("nth") <= k).select("src", "dst", "sim", "fresh")


def _round(points: DataFrame, graph: DataFrame, n: int, k: int, turn: int) -> DataFrame:
    """Edges between the neighbours of each point that improve a list."""
    # a hub that more than 2k points list is dealt into several, each with the hub's own list; dealt anew each round
    parts = graph.groupBy(F.col("dst").alias("hub")).agg(F.ceil(F.count("*") / (2 * k)).alias("parts"))
    back = graph.select(F.col("dst").alias("hub"), F.col("src").alias("id"), "fresh").join(parts, "hub")
    back = back.select("hub", F.pmod(F.xxhash64("id", F.lit(turn)), "parts").alias("sub"), "id", "fresh")
    own = graph.select(F.col("src").alias("hub"), F.col("dst").alias("id"), "fresh").join(parts, "hub", "left")
    own = own.select("hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("parts", F.lit(1)).cast("bigint") - 1)).alias("sub"), "id", "fresh")
    both = own.union(back).groupBy("hub", "sub", "id").agg(F.max("fresh").alias("fresh"))
    worst = graph.groupBy("src").agg(F.when(F.count("*") >= k, F.min("sim")).alias("worst")).withColumnRenamed("src", "id")
    # a hub with nothing new has nothing to compare
    news = both.where("fresh").select("hub", "sub").distinct()
    rows = both.join(news, ["hub", "sub"], "left_semi").join(points.select("id", "vec").join(worst, "id", "left"), "id")
    rows = rows.withColumn("hub", F.xxhash64("hub", "sub")).withColumn("part", F.pmod("hub", F.lit(max(1, n // 1024))))

    def compare(table: pa.Table) -> pa.Table:
        hub, ids, fresh = table["hub"].to_numpy(), table["id"].to_numpy(), table["fresh"].to_numpy(zero_copy_only=False)
        worst, x = table["worst"].to_numpy(zero_copy_only=False).astype(np.float32), _matrix(table["vec"])
        worst = np.where(np.isnan(worst), np.float32(-2), worst)
        order = np.argsort(hub, kind="stable")
        cuts = np.flatnonzero(np.diff(hub[order])) + 1
        out = []
        for rows in np.split(order, cuts):
            s = x[rows] @ x[rows].T
            new = fresh[rows][:, None] | fresh[rows][None, :]
            a, b = np.nonzero(np.triu(new & ((s > worst[rows][:, None]) | (s > worst[rows][None, :])), 1))
            out.append((ids[rows[a]], ids[rows[b]], s[a, b]))
        src, dst, sim = (np.concatenate(c) for c in zip(*out))
        key = np.stack([np.minimum(src, dst), np.maximum(src, dst)])
        _, first = np.unique(key, axis=1, return_index=True)
        return _edges(key[0, first], key[1, first], sim[first])

    found = rows.select("part", "hub", "id", "fresh", "worst", "vec").groupBy("part").applyInArrow(compare, _EDGE)
    return found.union(found.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim"))


def _centres(members: DataFrame, points: DataFrame) -> DataFrame:
    """(label, centre): the mean direction of each group's points; workers sum those of their batches first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield added(batch).to_batches()[0]

    def added(table: pa.Table | pa.RecordBatch) -> pa.Table:
        labels, where = np.unique(table["label"].to_numpy(), return_inverse=True)
        values = table["vec"].to_pylist()
        x = np.frombuffer(b"".join(values), dtype=np.float32 if len(values[0]) == width else np.float64).reshape(len(values), -1)
        total = np.zeros((len(labels), x.shape[1]))
        np.add.at(total, where, x)
        return pa.table({"label": pa.array(labels), "vec": pa.array([t.tobytes() for t in total], pa.binary())})

    width = points.select(F.length("vec")).first()[0]
    partial = members.select("label", F.col("node").alias("id")).join(points.select("id", "vec"), "id").select("label", "vec").mapInArrow(sums, "label bigint, vec binary")
    return partial.groupBy("label").applyInArrow(added, "label bigint, vec binary").withColumnRenamed("vec", "centre")


def _angles(members: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """(label, id, w, q): each member's angle to its group's centre, in steps of the threshold's angle / STEPS, rounded up."""
    rows = members.select("label", F.col("node").alias("id")).join(_centres(members, points), "label").join(points.select("id", "w", "vec"), "id")
    step = math.acos(min(max(threshold, -1.0), 1.0)) / STEPS

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["vec"]).astype(np.float64)
            c = np.frombuffer(b"".join(batch["centre"].to_pylist()), dtype=np.float64).reshape(len(x), -1)
            with np.errstate(all="ignore"):
                cos = (x * c).sum(axis=1) / np.linalg.norm(x, axis=1) / np.linalg.norm(c, axis=1)
                angle = np.arccos(np.clip(np.nan_to_num(cos, nan=-1.0), -1, 1)) + 1e-6
                q = np.minimum(np.ceil(angle / max(step, 1e-12)), 1 << 30).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch["label"], batch["id"], batch["w"], pa.array(q)], ["label", "id", "w", "q"])

    return rows.select("label", "id", "w", "centre", "vec").mapInArrow(measure, "label bigint, id bigint, w bigint, q int")


def group_links(points: DataFrame, members: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(id, n): how many others of its group (label, node) each point (id, vec, w) is linked to, by weight."""
    placed = written(_angles(members, points, threshold))
    sure = sure_links(placed, STEPS)
    far = placed.where(2 * F.col("q") > STEPS)
    sizes = far.groupBy("label").agg(F.ceil(F.count("*") / tile).cast("bigint").alias("of_far"), F.max("q").alias("most"))
    near = placed.join(sizes, "label").where(F.col("q") + F.col("most") > STEPS)
    sizes = near.groupBy("label").agg(F.first("of_far").alias("of_far"), F.ceil(F.count("*") / tile).cast("bigint").alias("of_all"))
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    left = far.join(sizes, "label").select("label", "id", "w", "q", own("of_far").alias("i"), to("of_all").alias("j"), F.lit(True).alias("left"))
    right = near.drop("of_far", "most").join(sizes, "label").select("label", "id", "w", "q", to("of_far").alias("i"), own("of_all").alias("j"), F.lit(False).alias("left"))
    rows = left.union(right).join(points.select("id", "vec"), "id").withColumn("unit", F.xxhash64("label", "i", "j"))

    def compare(table: pa.Table) -> pa.Table:
        unit, ids, w, q, left = (table[c].to_numpy(zero_copy_only=False) for c in ("unit", "id", "w", "q", "left"))
        x = _matrix(table["vec"])
        order = np.argsort(unit, kind="stable")
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for rows in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            a, b = rows[left[rows]], rows[~left[rows]]
            for some in np.split(a, range(TILE, len(a), TILE)):
                s = (x[some] @ x[b].T >= threshold) & (q[some][:, None] + q[b][None, :] > STEPS) & (ids[some][:, None] != ids[b][None, :])
                # a pair of two far points comes in either order, any other pair once
                out += [(ids[some], s @ w[b]), (ids[b], np.where(2 * q[b] > STEPS, 0, w[some] @ s))]
        ids, n = (np.concatenate(c) for c in zip(*out))
        return pa.table({"id": pa.array(ids[n > 0], pa.int64()), "n": pa.array(n[n > 0], pa.int64())})

    # units of small groups share tasks, of at least a tile each
    units = rows.select("label", "i", "j", "unit", "left", "id", "w", "q", "vec").withColumn("part", F.when(F.col("i") + F.col("j") == 0, F.pmod("unit", F.lit(256))).otherwise(F.col("unit")))
    compared = units.select("part", "unit", "left", "id", "w", "q", "vec").groupBy("part").applyInArrow(compare, "id bigint, n bigint")
    return sure.union(compared).groupBy("id").agg(F.sum("n").alias("n"))


def _counted(points: DataFrame, found: DataFrame, full: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, n), the links of each point by weight; (node, label), the classes; (id), the points of enlarged lists."""
    labels = written(components(found, "a", "b"))
    wanted = labels.join(full, "node", "left_semi").select("label").distinct()
    members = written(labels.join(wanted, "label", "left_semi").select("label", "node"))
    grouped = members.select(F.col("node").alias("id"))
    ends = found.select(F.col("a").alias("id"), F.col("b").alias("to")).union(found.select("b", "a")).join(grouped, "id", "left_anti")
    listed = ends.join(points.select(F.col("id").alias("to"), "w"), "to").groupBy("id").agg(F.sum("w").alias("n"))
    return written(listed.union(group_links(points, members, threshold))), labels, grouped


def _all_links(points: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(id, n) and (node, label) by comparison of all points, in pairs of tiles: the last resort."""
    tiles = max(1, math.ceil(n / BLOCK))
    own = F.pmod(F.xxhash64("id"), F.lit(tiles)).cast("int")
    spread = points.select("id", "w", "vec", own.alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other"))
    rows = spread.select("id", "w", "vec", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        i, j, tile, ids, w = (table[c].to_numpy() for c in ("i", "j", "tile", "id", "w"))
        x = _matrix(table["vec"])
        a, b = np.flatnonzero(tile == i[0]), np.flatnonzero(tile == j[0])
        total, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        pairs = []
        for some in np.split(a, range(TILE, len(a), TILE)):
            s = (x[some] @ x[b].T >= threshold) & (ids[some][:, None] != ids[b][None, :])
            total[some] += s @ w[b]
            if i[0] != j[0]:
                total[b] += w[some] @ s
            y, z = np.nonzero(s)
            pairs.append((some[y], b[z]))
        y, z = (np.concatenate(c) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        while True:  # the least of each connected set spreads over it
            before = label.copy()
            np.minimum.at(label, y, label[z])
            np.minimum.at(label, z, label[y])
            label = label[label]
            if (label == before).all():
                break
        return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array(total, pa.int64()), "to": pa.array(ids[label], pa.int64())})

    made = written(rows.groupBy("i", "j").applyInArrow(compare, "id bigint, n bigint, to bigint"))
    return made.groupBy("id").agg(F.sum("n").alias("n")), components(made, "id", "to")


def audit_recall(points: DataFrame, counts: DataFrame, threshold: float, sample: int, grouped: DataFrame | None = None) -> float:
    """The recall of `counts` (id, n) against the exact links of a sample of points.

    It is the least of four shares, so that what is found in a large group of alike points hides no other miss:
    of links, and the mean share of each point that has some, of points within groups (`grouped`, id), and of
    those outside. Outside, the sample grows up to 16-fold while fewer than a quarter of `sample` have links.
    """
    within = grouped if grouped is not None else points.select("id").where("false")
    recall = [1.0]
    for part, most in ((points.join(within, "id", "left_anti"), 16 * sample), (points.join(within, "id", "left_semi"), sample)):
        drawn = sample
        while True:
            n, shares = _audited(points, part, counts, threshold, drawn)
            if drawn >= most or n < drawn or len(shares) >= sample / 4:
                break
            drawn *= 4
        if shares:
            recall += [sum(min(hit / true, 1) for true, hit in shares) / len(shares), sum(min(true, hit) for true, hit in shares) / sum(true for true, _ in shares)]
    return min(recall)


def _audited(points: DataFrame, part: DataFrame, counts: DataFrame, threshold: float, sample: int) -> tuple[int, list[tuple[int, int]]]:
    """The number of points sampled of `part`, and (exact links, those counted) of each that has some."""
    chosen = part.select("id", "vec").orderBy(F.xxhash64("id", F.lit(97)), "id").limit(sample).toArrow()  # bounded: `sample` vectors
    if not chosen.num_rows:
        return 0, []
    ids, x = chosen["id"].to_numpy(), _matrix(chosen["vec"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, TILE):
                rows = batch.slice(lo, TILE)
                s = (_matrix(rows["vec"]) @ x.T >= threshold + 1e-6) & (rows["id"].to_numpy()[:, None] != ids[None, :])
                total += rows["w"].to_numpy() @ s
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some])], ["id", "true"])

    true = points.select("id", "w", "vec").mapInArrow(exact, "id bigint, true bigint").groupBy("id").agg(F.sum("true").alias("true"))
    rows = true.join(counts, "id", "left").select("true", F.coalesce("n", F.lit(0)).alias("n")).collect()  # bounded: `sample` rows
    return chosen.num_rows, [(r["true"], r["n"]) for r in rows]


def _links_of(points: DataFrame, threshold: float, k: int, tables: int, max_rounds: int, sample: int, min_recall: float, attempts: int) -> tuple[DataFrame, DataFrame]:
    """(id, n) and (node, label) of points (id, w, vec) of one length."""
    n = points.count()
    found = full = None
    for attempt in range(attempts):
        size = k << attempt
        first = _first_lists(points, n, size, tables << attempt, seed=attempt).withColumn("fresh", F.lit(True))
        graph = written(_best(first, size))
        for turn in range(max_rounds):
            lists = graph.where(F.col("sim") >= threshold).groupBy("src").agg(F.count("*").alias("n"), F.count(F.when(F.col("fresh"), 1)).alias("new"))
            now = lists.where(F.col("n") < size).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("new"), F.lit(0)).alias("new")).first()
            if turn and now["new"] <= 0.001 * now["n"]:
                break
            old = graph.withColumn("fresh", F.lit(False))
            graph = written(_best(old.union(_round(points, graph, n, size, turn).withColumn("fresh", F.lit(True))), size))
        above = graph.where(F.col("sim") >= threshold)
        more = above.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= size).select(F.col("src").alias("node"))
        full = more if full is None else full.union(more)
        edges = above.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        found = written((edges if found is None else edges.union(found)).distinct())
        counts, labels, grouped = _counted(points, found, full, threshold)
        if audit_recall(points, counts, threshold, sample, grouped) >= min_recall:
            return counts, labels
    return _all_links(points, n, threshold)


def near_neighbours(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, k: int = 10, tables: int = 3, max_rounds: int = 8, sample: int = 512, min_recall: float = 0.95, attempts: int = 3) -> DataFrame:
    """(vec_id, class_id, n_links), a row for each id and vector: the least id of its class and its number of links.

    n_links counts the other vectors of cosine similarity at or above the threshold, equal ones included. A
    vector without links is a class by itself.
    """
    rows = df.select(col(id_col).alias("id"), col(vec_col).cast("array<double>").alias("vec")).where("id is not null")
    large = F.array_max(F.transform("vec", F.abs))
    usable = (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (large > 0)
    usable = F.coalesce(usable, F.lit(False))
    sizes = [r["size"] for r in rows.where(usable).groupBy(F.size("vec").alias("size")).count().collect()]  # a row for each length of vector
    out = rows.where(~usable).select("id").distinct().select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    for size in sorted(sizes):
        vectors = written(unit_vectors(rows.where(usable), size))
        # numbers in place of ids: of any type, and one for each vector
        points = vectors.groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("w"))
        points = written(points.select(F.monotonically_increasing_id().alias("id"), "w", "least", "vec"))
        counts, labels = _links_of(points, threshold, k, tables, max_rounds, sample, min_recall, attempts)
        least = labels.join(points.select(F.col("id").alias("node"), "least"), "node").groupBy("label").agg(F.min("least").alias("class_id"))
        classes = labels.join(least, "label").select(F.col("node").alias("id"), "class_id")
        known = points.join(counts, "id", "left").join(classes, "id", "left")
        known = known.select("vec", F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).cast("bigint").alias("n_links"))
        out = out.union(vectors.join(known, "vec").select("id", "class_id", "n_links"))
    return out.withColumnRenamed("id", "vec_id")
