"""Packing: documents put into windows of near-equal size by multiway differencing.

Documents are cut into pieces of at most a window's capacity; a piece that fills a window is one. The rest
are dealt by hash into groups of about `windows_per_group` windows, and each group is partitioned by the
Karmarkar-Karp differencing method: every piece starts as a partial partition with one filled window; the
two partial partitions of the greatest imbalance are merged again and again, the fullest windows of one with
the emptiest of the other. If a window exceeds the capacity, the group is partitioned anew with one more.

Tokens are runs of non-blanks, unless `token_col` gives a count. Texts without a token, null ones included,
are in no window. Rows that repeat an id are packed each. Ids may be of any type that sorts, and a null one is packed as null. Only ids and counts
are moved; the work of a group doesn't grow with the corpus.
"""

from __future__ import annotations

import heapq
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import col, written
from sparkloom.llm.mixing import count_tokens

_SCHEMA = "group_id bigint, window int, n_tokens bigint, doc_ids array<{}>, starts array<bigint>, ends array<bigint>"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """The indices of `sizes` in k parts of near-equal sums; sizes in descending order, all above 0.

    A partial partition is a list of (sum, members) by descending sum, without its empty parts; members are
    an index or a pair of members.
    """
    heap: list = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    if k == 1:
        return [list(range(len(sizes)))]
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        p, q = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(p) + len(q) <= k:
            r = p + q
        else:
            both = range(max(k - len(q), 0), len(p))
            r = p[: k - len(q)] + [(p[i][0] + q[k - 1 - i][0], (p[i][1], q[k - 1 - i][1])) for i in both] + q[: k - len(p)]
        r.sort(key=itemgetter(0), reverse=True)
        heapq.heappush(heap, ((r[-1][0] if len(r) == k else 0) - r[0][0], made, r))
        made += 1
    parts = []
    for _, members in heap[0][2] if heap else []:
        part, stack = [], [members]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                part.append(x)
        parts.append(sorted(part))
    return parts


def pack_group(sizes: list[int], capacity: int) -> list[list[int]]:
    """The indices of `sizes`, none above the capacity, in as few near-equal parts as differencing finds."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    full = [i for i in order if sizes[i] == capacity]
    rest = order[len(full) :]
    parts, k = [], -(-sum(sizes[i] for i in rest) // capacity)
    while rest:
        parts = differencing([sizes[i] for i in rest], k)
        if all(sum(sizes[rest[j]] for j in part) <= capacity for part in parts):
            break
        k += 1
    return [[i] for i in full] + [[rest[j] for j in part] for part in parts]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", token_col: str | None = None, capacity: int = 4096, windows_per_group: int = 64, seed: int = 3) -> DataFrame:
    """(group_id, window, n_tokens, doc_ids, starts, ends): each window's pieces, as token ranges of documents."""
    tokens = count_tokens(col(text_col)) if token_col is None else F.coalesce(col(token_col).cast("bigint"), F.lit(0))
    sized = written(docs.select(col(id_col).alias("id"), tokens.alias("tokens")).where("tokens > 0"))
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    groups = max(1, round(total / (capacity * windows_per_group)))
    pieces = sized.select("id", "tokens", F.explode(F.sequence(F.lit(0), F.col("tokens") - 1, F.lit(capacity))).alias("start"))
    pieces = pieces.select("id", F.col("start").cast("bigint").alias("start"), F.least(F.col("start") + capacity, "tokens").cast("bigint").alias("end"))
    pieces = pieces.withColumn("group_id", F.pmod(F.xxhash64("id", "start", F.lit(seed)), F.lit(groups)))

    def windows(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("start", "ascending"), ("end", "ascending")])
        ids, starts, ends = (table[c].to_pylist() for c in ("id", "start", "end"))
        sizes = [e - s for s, e in zip(starts, ends)]
        parts = pack_group(sizes, capacity)
        n = len(parts)
        return pa.table({
            "group_id": pa.array([table["group_id"][0].as_py()] * n, pa.int64()), "window": pa.array(range(n), pa.int32()), "n_tokens": pa.array([sum(sizes[i] for i in p) for p in parts], pa.int64()),
            "doc_ids": pa.array([[ids[i] for i in p] for p in parts], pa.list_(table.schema.field("id").type)), "starts": pa.array([[starts[i] for i in p] for p in parts], pa.list_(pa.int64())), "ends": pa.array([[ends[i] for i in p] for p in parts], pa.list_(pa.int64())),
        })

    return pieces.groupBy("group_id").applyInArrow(windows, _SCHEMA.format(sized.schema["id"].dataType.simpleString()))
