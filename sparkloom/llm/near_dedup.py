"""Near-duplicate documents: consistent weighted samples of TF-IDF shingles, banded and verified.

1. The document frequency of every shingle is counted over all documents, in 2^18 buckets by hash, so that
   the weights that each worker needs have a fixed size (1 MB) however large the corpus is. Shingles that
   share a bucket pool their counts; the pooled share of documents depends on document length alone.
2. Each text's weighted set of shingles (count x idf) is drawn from by improved consistent weighted
   sampling (Ioffe, 2010): two texts draw the same sample with a probability equal to their weighted
   Jaccard similarity. Equal texts collapse to one by a 128-bit hash, which weighs as many documents.
3. Samples are grouped in bands; texts that agree in a band are candidates.
4. Candidates are verified by the weighted Jaccard similarity of their whole texts. In large buckets this
   distance, a metric, to one leading text settles most pairs without a comparison; see `links`.
5. Connected components of links are the classes.

Documents are named by their id, of any type that sorts. Rows of one id are one document, of one class; it has
the links of each of its texts, a similar text of its own among them; rows that repeat an id and a text count
once. Rows with a null id, and null or wordless texts, match nothing. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import col, keyed, named, packed, text_hash, written
from sparkloom.llm.graph import components, sure_links
from sparkloom.llm.textkernel import Words, buffers, mix, shingles, slices

DF_BITS = 18
#: Buckets of more texts have a leader, whose distances settle pairs; the links are the same either way.
SMALL = 32
#: Steps of a distance up to that of the threshold.
STEPS = 4096
#: Texts on either side of the pairs that one task compares.
SIDE = 256


def _gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1), F(x) = 1 - (1 + x) exp(-x), at the middles of 2^16 equal steps."""
    q = (np.arange(65536) + 0.5) / 65536
    x = np.full(65536, 2.0)
    lo, hi = np.zeros(65536), np.full(65536, 60.0)
    for _ in range(60):
        low = 1 - (1 + x) * np.exp(-x) < q
        lo, hi = np.where(low, x, lo), np.where(low, hi, x)
        x = (lo + hi) / 2
    return x


_R = _gamma_table()
_R32, _R_INV, _LN_C = _R.astype(np.float32), (1 / _R).astype(np.float32), np.log(_R).astype(np.float32)


class Icws:
    """Improved consistent weighted sampling, `draws` samples of 32 bits for each row of a weighted set.

    The variables r, c (Gamma(2, 1)) and beta (uniform) of a feature and a draw are read from 16 bits each
    of a hash of both.
    """

    def __init__(self, draws: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.salt = rng.integers(0, 2**64, draws, dtype=np.uint64)
        self.odd = rng.integers(0, 2**64, draws, dtype=np.uint64) | np.uint64(1)

    def __call__(self, starts: np.ndarray, features: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """(rows, draws) uint32; starts: where each row's features begin, every row having some."""
        x, ln_w = mix(features), np.log(weights).astype(np.float32)
        low = (x & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out = np.empty((len(starts), len(self.salt)), dtype=np.uint32)
        for k, (salt, odd) in enumerate(zip(self.salt, self.odd)):
            h = (x ^ salt) * odd
            h ^= h >> np.uint64(31)
            i = ((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int32)
            beta = ((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
            t = np.floor(ln_w * _R_INV[i] + beta)
            ln_a = _LN_C[(h >> np.uint64(48)).astype(np.int32)] - _R32[i] * (t - beta + np.float32(1))
            order = ln_a.view(np.int32).astype(np.int64)
            order ^= (order >> 31) & 0x7FFFFFFF
            mark = (low + t.astype(np.int64) * 0x9E3779B1) & 0xFFFFFFFF
            out[:, k] = (np.minimum.reduceat((order << 32) | mark, starts) & 0xFFFFFFFF).astype(np.uint32)
        return out


def idf_table(df: DataFrame, text: str, words: int) -> tuple[np.ndarray, int]:
    """(idf by bucket, documents), counted over all rows of `df`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(1 << DF_BITS, dtype=np.int64), 0
        for batch in batches:
            raw, off = buffers(batch.column(0))
            rows += len(off) - 1
            for lo, hi in slices(off):
                row, h, _ = shingles(Words(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]), words)
                keys = np.unique((row << DF_BITS) | (h >> np.uint64(48 - DF_BITS)).astype(np.int64))
                total += np.bincount(keys & ((1 << DF_BITS) - 1), minlength=1 << DF_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], rows), pa.int64())], ["bucket", "n"])

    found = df.select(col(text).alias("text")).mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = found["bucket"].to_numpy(), found["n"].to_numpy()
    rows = int(n[bucket < 0].sum())
    seen = np.zeros(1 << DF_BITS)
    seen[bucket[bucket >= 0]] = n[bucket >= 0]
    return np.log1p(max(rows, 1) / (seen + 1)).astype(np.float32), rows


def _weighted(raw: np.ndarray, off: np.ndarray, words: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, h, n = shingles(Words(raw, off), words)
    return row, h, n * idf[(h >> np.uint64(48 - DF_BITS)).astype(np.int64)]


class Sets:
    """Weighted shingle sets of texts, for the similarity of chosen pairs."""

    def __init__(self, texts: pa.Array, words: int, idf: np.ndarray):
        raw, off = buffers(texts)
        parts = [(lo, *_weighted(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words, idf)) for lo, hi in slices(off)]
        row = np.concatenate([np.zeros(0, np.int64), *[p[1] + p[0] for p in parts]])
        self.weight = np.concatenate([np.zeros(0), *[p[3] for p in parts]])
        found, self.feature = np.unique(np.concatenate([np.zeros(0, np.uint64), *[p[2] for p in parts]]), return_inverse=True)
        self.dense = np.zeros(len(found))
        self.first = np.searchsorted(row, np.arange(len(texts) + 1))
        self.total = np.bincount(row, self.weight, len(texts))

    def similarity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Weighted Jaccard similarity, sum of least over sum of greatest weights, of texts a[i] and b[i]."""
        out = np.zeros(len(a))
        order = np.argsort(a, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(a) else ():
            own = slice(self.first[a[rows[0]]], self.first[a[rows[0]] + 1])
            self.dense[self.feature[own]] = self.weight[own]
            sizes = np.cumsum(self.first[b[rows] + 1] - self.first[b[rows]])
            lo = 0
            while lo < len(rows):  # so many partners at a time that their shingles fit a small array
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + (1 << 20))))
                other = b[rows[lo:hi]]
                size = self.first[other + 1] - self.first[other]
                ends = np.cumsum(size)
                at = np.arange(ends[-1]) + np.repeat(self.first[other] - ends + size, size)
                least = np.bincount(np.repeat(np.arange(hi - lo), size), np.minimum(self.dense[self.feature[at]], self.weight[at]), hi - lo)
                total = self.total[a[rows[0]]] + self.total[other] - least
                out[rows[lo:hi]] = np.divide(least, total, out=np.zeros(hi - lo), where=total > 0)
                lo = hi
            self.dense[self.feature[own]] = 0
        return out


def signatures(df: DataFrame, words: int, idf: np.ndarray, bands: int, rows: int) -> DataFrame:
    """(id, h1, h2, weight, bands array<bigint>) of each row (id, text) that has a word; weight: that of the whole text."""
    sampler = Icws(bands * rows)
    shared = df.sparkSession.sparkContext.broadcast(idf)
    salts = np.random.default_rng(2).integers(0, 2**64, (rows, 1, 1), dtype=np.uint64) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column(3))
            for lo, hi in slices(off):
                row, h, w = _weighted(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], words, shared.value)
                if not len(row):
                    continue
                starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                drawn = sampler(starts, h, w).reshape(len(starts), bands, rows).astype(np.uint64)
                band = np.zeros(drawn.shape[:2], dtype=np.uint64)
                for i in range(rows):
                    band = mix(band * salts[i] + drawn[:, :, i] + np.uint64(i + 1))
                keep = batch.slice(lo, hi - lo).take(pa.array(row[starts]))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * bands, pa.int32()), pa.array(band.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*keep.columns[:3], pa.array(np.add.reduceat(w, starts).astype(np.float64)), lists], ["id", "h1", "h2", "weight", "bands"])

    return df.select("id", *text_hash(F.col("text")), "text").mapInArrow(sign, "id bigint, h1 bigint, h2 bigint, weight double, bands array<bigint>")


def verified(pairs: DataFrame, texts: DataFrame, words: int, idf: np.ndarray, least: float) -> DataFrame:
    """(a, b, similarity) of the distinct pairs (a, b, key) whose whole texts (id, text) are at least so similar.

    Pairs of one key are compared in one task, to which each text goes once; a key of more than SIDE texts on
    either side is dealt into parts by the hashes of both ids. Small keys share parts.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    pairs = written(pairs)
    sides = pairs.groupBy("key").agg(*[F.ceil(F.approx_count_distinct(x) / SIDE).cast("bigint").alias("of_" + x) for x in "ab"])
    parts = max(1, math.ceil(pairs.count() / (2 * SIDE)))
    spot = F.xxhash64("key", F.pmod(F.xxhash64("a"), "of_a"), F.pmod(F.xxhash64("b"), "of_b"))
    part = F.when(F.col("of_a") * F.col("of_b") == 1, F.pmod(F.xxhash64("key"), F.lit(parts))).otherwise(spot)
    placed = written(pairs.join(sides, "key").select("a", "b", part.alias("part")))
    wanted = placed.select(F.col("part").alias("spot"), F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = wanted.join(texts, "id").select("spot", "id", "text")

    def measure(some: pa.Table, known: pa.Table) -> pa.Table:
        a, b, names = some["a"].to_numpy(), some["b"].to_numpy(), known["id"].to_numpy()
        order = np.argsort(names)
        at = lambda x: order[np.searchsorted(names, x, sorter=order)]
        s = Sets(known["text"], words, shared.value).similarity(at(a), at(b)) if len(a) else np.zeros(0)
        ok = s >= least
        return pa.table({"a": pa.array(a[ok], pa.int64()), "b": pa.array(b[ok], pa.int64()), "similarity": pa.array(s[ok])})

    return written(placed.groupBy("part").cogroup(wanted.groupBy("spot")).applyInArrow(measure, "a bigint, b bigint, similarity double"))


def links(bands: DataFrame, texts: DataFrame, words: int, idf: np.ndarray, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of texts (id, weight, band, hash) that share a bucket: (a, b, similarity), verified pairs, and (id, label, q, similarity), homes.

    Buckets of up to SMALL ids give all their pairs. Every larger one is led by the id that shares most buckets,
    and all its ids are compared with that. The leaders whose similarity reaches the threshold offer an id a
    home, of which it takes the one that shares most buckets. q is the distance to it, 1 - similarity, in steps
    of a STEPS-th of the greatest distance of a link, rounded up. By the triangle inequality two ids of one home
    are linked if their q add up to at most STEPS; else their pair is verified, and so are the pairs that share
    a bucket and no home. A pair of weights too unlike for the threshold needs no verification.
    """
    sizes = bands.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(bands.join(sizes, ["band", "hash"]))
    few = shared.where(F.col("n") <= SMALL).select("band", "hash", "id", "weight")
    many = shared.where(F.col("n") > SMALL)
    popular = many.groupBy("id").agg(F.sum("n").alias("shares"))
    many = written(many.join(popular, "id").select("band", "hash", "id", "weight", "shares"))
    leads = many.groupBy("band", "hash").agg(F.max(F.struct("shares", (-F.col("id")).alias("minus"), "weight")).alias("lead"))
    leads = leads.select("band", "hash", (-F.col("lead.minus")).alias("leader"), "lead.weight", F.col("lead.shares").alias("offer"))
    star = many.select("band", "hash", "id", F.col("weight").alias("own")).join(leads, ["band", "hash"]).where("id <> leader")
    star = star.where(F.least("own", "weight") >= (threshold - 1e-6) * F.greatest("own", "weight")).select(F.col("leader").alias("a"), F.col("id").alias("b"), "offer").distinct()
    star = written(star)
    reached = verified(star.select("a", "b", F.col("a").alias("key")), texts, words, idf, threshold)
    offers = reached.join(star, ["a", "b"]).select(F.col("b").alias("id"), F.col("a").alias("label"), "similarity", "offer")
    offers = offers.union(leads.select(F.col("leader").alias("id"), F.col("leader").alias("label"), F.lit(1.0), "offer").distinct())
    home = offers.groupBy("id").agg(F.max(F.struct("offer", (-F.col("label")).alias("minus"), "similarity")).alias("best"))
    distance = F.ceil((1 - F.col("best.similarity")) / (1 - threshold) * STEPS - 1e-6).cast("int")
    home = written(home.select("id", (-F.col("best.minus")).alias("label"), distance.alias("q"), "best.similarity"))
    # within a home
    sides = home.groupBy("label").agg(F.max("q").alias("most"), F.count("*").alias("n")).where("2 * most > %d" % STEPS)
    salts = F.greatest(F.lit(1), F.ceil(F.col("n") / 4096)).cast("bigint")
    other = home.join(sides.select("label", "most", salts.alias("salts")), "label").where(F.col("q") + F.col("most") > STEPS)
    far = other.where(2 * F.col("q") > STEPS).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    other = other.select("label", F.pmod(F.xxhash64("id"), "salts").alias("salt"), F.col("id").alias("y"), F.col("q").alias("of_y"))
    open_ = far.join(other, ["label", "salt"]).where((F.col("q") + F.col("of_y") > STEPS) & (F.col("id") != F.col("y")))
    open_ = open_.where((2 * F.col("of_y") <= STEPS) | (F.col("id") < F.col("y"))).select(F.least("id", "y").alias("a"), F.greatest("id", "y").alias("b"), F.col("label").alias("key"))
    # across homes, in buckets; of two ids of different homes one is outside its bucket's commonest home
    where = home.select("id", "label")
    alike = lambda x, y: F.least(x, y) >= (threshold - 1e-6) * F.greatest(x, y)
    few = few.join(where, "id", "left")
    pairs = few.select("band", "hash", F.col("id").alias("a"), F.col("weight").alias("wa"), F.col("label").alias("la")).join(few.select("band", "hash", F.col("id").alias("b"), F.col("weight").alias("wb"), F.col("label").alias("lb")), ["band", "hash"])
    pairs = pairs.where((F.col("a") < F.col("b")) & alike("wa", "wb") & ~F.coalesce(F.col("la") == F.col("lb"), F.lit(False)))
    pairs = pairs.select("a", "b", F.least(F.coalesce("la", "a"), F.coalesce("lb", "b")).alias("key"))
    many = many.select("band", "hash", "id", "weight").join(where, "id", "left").withColumn("label", F.coalesce("label", -1 - F.col("id")))
    most = many.groupBy("band", "hash", "label").agg(F.count("*").alias("n")).groupBy("band", "hash").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1").drop("labels")
    many = many.join(most, ["band", "hash"])
    across = many.select("band", "hash", F.col("id").alias("x"), F.col("weight").alias("wx"), F.col("label").alias("lx")).join(many.where("label <> most").select("band", "hash", F.col("id").alias("y"), F.col("weight").alias("wy"), F.col("label").alias("ly")), ["band", "hash"])
    across = across.where((F.col("lx") != F.col("ly")) & alike("wx", "wy")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.least("lx", "ly").alias("key"))
    pairs = pairs.union(across).groupBy("a", "b").agg(F.min("key").alias("key"))
    return verified(pairs.union(open_), texts, words, idf, threshold), home


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2, threshold: float = 0.45, bands: int = 24, rows: int = 3) -> DataFrame:
    """(doc_id, class_id, n_links, similarity), a row for each document that has a link.

    class_id: the least id of its class; n_links: the number of other documents, equal texts included, that it is
    linked to; similarity: 1 if another document has the same text, else the greatest that was measured, to one
    of its links. Documents without links have no row; an empty table gives none.
    """
    docs, names = keyed(df, id_col, text_col)
    idf, _ = idf_table(df, text_col, words)
    signed = written(signatures(docs, words, idf, bands, rows))
    reps = signed.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.countDistinct("id").alias("w"), F.min_by("weight", "id").alias("weight"), F.min_by("bands", "id").alias("bands"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "least", "w", "weight", "bands"))
    of_id = reps.select("id", "h1", "h2", F.col("least").alias("doc"))
    texts = docs.select(F.col("id").alias("doc"), *text_hash(F.col("text")), "text").join(of_id, ["doc", "h1", "h2"]).select("id", "text").dropDuplicates(["id"])
    found, home = links(reps.select("id", "weight", F.posexplode("bands").alias("band", "hash")), texts, words, idf, threshold)
    weights = reps.select("id", "w")
    ends = found.select(F.col("a").alias("id"), F.col("b").alias("to"), "similarity").union(found.select("b", "a", "similarity"))
    none, zero = F.lit(None).cast("double"), F.lit(0).cast("bigint")
    moved = home.where("id <> label")
    counts = ends.join(weights.withColumnRenamed("id", "to"), "to").select("id", F.col("w").alias("n"), "similarity")
    counts = counts.union(sure_links(home.join(weights, "id"), STEPS).select("id", "n", none)).union(moved.select("id", zero, "similarity")).union(moved.select("label", zero, "similarity"))
    counts = counts.groupBy("id").agg(F.sum("n").alias("n"), F.max("similarity").alias("similarity"))
    # the texts of one id belong together
    rows = signed.select(F.col("id").alias("doc"), "h1", "h2").distinct().join(reps.select("id", "h1", "h2"), ["h1", "h2"]).select("doc", "id")
    several = rows.groupBy("doc").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("doc", "a")
    edges = found.select("a", "b").union(moved.select("id", "label")).union(rows.join(several, "doc").select("a", "id"))
    labels = written(components(edges, "a", "b"))
    least = labels.join(reps.select(F.col("id").alias("node"), "least"), "node").groupBy("label").agg(F.min("least").alias("class_id"))
    classes = labels.join(least, "label").select(F.col("node").alias("id"), "class_id")
    known = reps.select("id", "least", "w").join(counts, "id", "left").join(classes, "id", "left")
    known = known.select("id", F.coalesce("class_id", "least").alias("class_id"), (F.coalesce("n", zero) + F.col("w") - 1).alias("n"), F.when(F.col("w") > 1, 1.0).otherwise(F.col("similarity")).alias("similarity")).where("n > 0")
    out = rows.join(known, "id").groupBy(F.col("doc").alias("id")).agg(F.min("class_id").alias("class_id"), F.sum("n").alias("n_links"), F.round(F.max("similarity"), 6).alias("similarity"))
    return named(out, names).select(F.col("id").alias("doc_id"), "class_id", "n_links", "similarity")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs`, all columns, with the document of the least id of each class.

    Of rows that repeat an id and its text, one stays (any, if their other columns differ). Rows without
    an id, and null or wordless texts, stay unless they repeat such a row.
    """
    dropped = near_duplicates(docs, id_col, text_col, **how).where("doc_id <> class_id").select(F.col("doc_id").alias("id"))
    rows = packed(docs, id=col(id_col), text=col(text_col))
    rows = rows.select("row", "id", *text_hash(F.col("text"))).join(dropped, "id", "left_anti")
    return rows.dropDuplicates(["id", "h1", "h2"]).select("row.*")


def expected_recall(similarity: float, bands: int = 24, rows: int = 3) -> float:
    """The probability that a pair of this similarity shares a band."""
    return 1 - math.pow(1 - similarity**rows, bands)
