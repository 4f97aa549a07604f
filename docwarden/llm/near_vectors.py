"""Embedding near-duplicates by sorted projection passes.

1. Vectors that are equal in every component are one class with a count.
2. Each pass hashes every vector to ``BITS`` signs of random projections; all passes are dealt by range of
   (pass, dimensions, hash bits, id) and sorted, so near vectors tend to be neighbours. A task compares each vector
   with the ``WINDOW`` before it, by cosine in double precision; the last vectors of a range meet the first of the
   next in a step of their own. Tasks return only links that connect two components they know.
3. Passes come in rounds of ``PASSES`` until no vector needs more. A vector surely meets all that share more leading
   bits with it than the rows at the ends of its window do; from that depth, which is small where keys are sparse and
   large in a dense cone, follows the chance ``1 - p^depth`` that a pass misses a pair at the threshold. Vectors whose
   chance over all passes is below ``MISS`` are done; the others are keyed again, among themselves, with fresh
   projections. Once the passes so far have cost as much as comparing the rest with each other, that is done instead.
4. Components are found over the verified links of all passes.
5. Windows are bounded, groups of near-copies are not: inside each component all vectors are compared in blocks of
   ``PIECE`` by matrix products that return one count per vector and block, never pairs. So ``n_links`` counts every
   link inside a component, however large; only a pair that no pass brings together and no chain connects is missed.

Recall: two vectors with angle ``a`` agree in one bit with probability 1 - a / pi. The number of passes follows from
the rows and their density, so the chance of missing a pair at the threshold is about ``MISS`` in a table of any size,
and 0 in one that is compared directly.

Defined cases: vectors that are null, zero, of no component or with null or non-finite components link with nothing;
vectors of different length never link; rows with a null id link with nothing and have a null component; repeated
rows are vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docwarden.llm.components import components
from docwarden.session import settle

PASSES, BITS, WINDOW = 16, 64, 48
PIECE = 1024
THRESHOLD = 0.9
MISS = 1e-3


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def passes(vectors: DataFrame, n_passes: int = PASSES, seed: int = 0) -> DataFrame:
    """(id, embedding) -> (pass, dims, key, id, embedding), one row per pass; ``key`` orders like the hash bits."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch["embedding"].map(len)
            for d in dims.unique():
                part = batch[dims == d]
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, n_passes * BITS))
                signs = (_units(part["embedding"].tolist()) @ planes[d] > 0).reshape(len(part), n_passes, BITS)
                keys = np.packbits(signs, axis=2).view(">u8")[:, :, 0].astype(np.uint64) ^ np.uint64(1 << 63)
                for i in range(n_passes):
                    yield pd.DataFrame(
                        {"pass": i, "dims": d, "key": keys[:, i].view(np.int64), "id": part["id"], "embedding": part["embedding"]}
                    )

    kind = vectors.schema["embedding"].dataType.simpleString()
    return vectors.select("id", "embedding").mapInPandas(rows, f"pass int, dims int, key long, id long, embedding {kind}")


class _Forest:
    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def _band(forest: _Forest, groups: np.ndarray, ids: np.ndarray, units: list, first: int, window: int, threshold: float) -> list:
    """New links of the rows from ``first`` on with the ``window`` rows before each; a row's group is pass and dims."""
    links = []
    for start in np.unique(groups, return_index=True)[1].tolist():
        stop = int(np.searchsorted(groups, groups[start], side="right"))
        x = np.array(units[start:stop])
        begin = max(first, start)
        for row in range(begin, stop, 256):
            lo, hi = max(start, row - window), min(row + 256, stop)
            cosine = x[row - start : hi - start] @ x[lo - start : hi - start].T
            a, b = np.nonzero(cosine >= threshold)
            a, b = a + row, b + lo
            near = (b < a) & (a - b <= window)
            for i, j in zip(ids[a[near]].tolist(), ids[b[near]].tolist(), strict=True):
                if i != j and forest.join(i, j):
                    links.append((i, j))
    return links


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading bits in which two arrays of keys agree."""
    x, n = (a ^ b).view(np.uint64), np.full(len(a), BITS)
    for step in (32, 16, 8, 4, 2, 1):
        high = (x >> np.uint64(step)) > 0
        n[high] -= step
        x = np.where(high, x >> np.uint64(step), x)
    return n - (x > 0)


def log_miss(keys: np.ndarray, window: int, threshold: float, opens: bool) -> np.ndarray:
    """For sorted keys of one group in one range: log chance that the pass misses a pair at the threshold.

    What shares more bits with a row than the row ``window`` places away does lies nearer than that. At the ends of a
    range the first and last row take that part, unless the group is known to begin there (``opens``).
    """
    at = np.arange(len(keys))
    below = _agree(keys, keys[np.maximum(at - window, 0)]) + 1
    if opens:
        below[:window] = 0
    depth = np.maximum(below, _agree(keys, keys[np.minimum(at + window, len(keys) - 1)]) + 1)
    meets = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** depth
    return np.where(depth > BITS, 0.0, np.log1p(-np.minimum(meets, 1 - 1e-12)))


_WINDOWED = "u long, v long, part int, place int, pass int, dims int, id long, miss double"


def windows(sorted_rows: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """Rows sorted in ranges -> links (u, v), the first and last rows of each range (part, place, ...), and the log
    chance of each row to miss a pair (id, miss)."""
    kind = sorted_rows.schema["embedding"].dataType.simpleString()

    def edge(rows: pd.DataFrame, part: int, places: range) -> pd.DataFrame:
        return rows.assign(part=part, place=list(places), u=None, v=None, miss=None).drop(columns="key")

    def chances(found: list) -> Iterator[pd.DataFrame]:
        groups, ids, keys = (np.concatenate(x) for x in zip(*found, strict=True))
        for g, start in zip(*np.unique(groups, return_index=True), strict=True):
            stop = int(np.searchsorted(groups, g, side="right"))
            none = pd.Series([None] * (stop - start), dtype=object)
            miss = log_miss(keys[start:stop], window, threshold, bool(start))
            yield pd.DataFrame({"id": ids[start:stop], "miss": miss}).assign(
                u=none, v=none, part=none, place=none, dims=none, embedding=none, **{"pass": none}
            )

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, part, seen = _Forest(), TaskContext.get().partitionId(), 0
        held, met = pd.DataFrame(), []
        for batch in batches:
            if not len(batch):
                continue
            if seen < window:
                yield edge(batch.head(window - seen), part, range(seen, seen + min(window - seen, len(batch))))
            seen += len(batch)
            rows = pd.concat([held, batch], ignore_index=True)
            groups = rows["pass"].to_numpy(np.int64) << 32 | rows["dims"].to_numpy(np.int64)
            units: list = [None] * len(rows)
            for g in np.unique(groups):
                at = np.flatnonzero(groups == g)
                for i, u in zip(at, _units(rows["embedding"].iloc[at].tolist()), strict=True):
                    units[i] = u
            # 24 bytes a row
            met.append([x[len(held) :] for x in (groups, rows["id"].to_numpy(np.int64), rows["key"].to_numpy(np.int64))])
            found = _band(forest, groups, rows["id"].to_numpy(np.int64), units, len(held), window, threshold)
            if found:
                none = pd.Series([None] * len(found), dtype=object)
                yield pd.DataFrame(found, columns=["u", "v"]).assign(
                    part=none, place=none, dims=none, id=none, miss=none, embedding=none, **{"pass": none}
                )
            held = rows.tail(window)
        if seen:
            yield edge(held, part, range(-len(held), 0))
            yield from chances(met)

    return sorted_rows.select("pass", "dims", "key", "id", "embedding").mapInPandas(linked, f"{_WINDOWED}, embedding {kind}")


def across(found: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD) -> DataFrame:
    """Links between the last rows of a range and the first of the next one that has rows."""
    spark = found.sparkSession
    rows = found.filter("part is not null")
    # one number per range
    parts = sorted(r.part for r in rows.select("part").distinct().collect())
    follows = spark.createDataFrame([(b, a) for a, b in zip(parts, parts[1:], strict=False)], "part int, seam int")
    heads = rows.filter("place >= 0").join(F.broadcast(follows), "part")
    tails = rows.filter("place < 0").withColumn("seam", F.col("part"))
    both = tails.unionByName(heads)

    def linked(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place", kind="stable")
        n = int((part["place"] < 0).sum())
        groups = part["pass"].to_numpy(np.int64) << 32 | part["dims"].to_numpy(np.int64)
        if n == 0 or n == len(part) or groups[n] != groups[n - 1]:
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        same = np.flatnonzero(groups == groups[n])
        units = [u for u in _units(part["embedding"].iloc[same].tolist())]
        first = int(np.searchsorted(same, n))
        found = _band(_Forest(), groups[same], part["id"].to_numpy(np.int64)[same], units, first, window, threshold)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return both.groupBy("seam").applyInPandas(linked, "u long, v long")


def _stars(left: np.ndarray, right: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each id of a block to the least id that the block connects it with."""
    top, a, b = np.iinfo(np.int64).max, left, right
    while True:
        b2 = np.minimum(b, np.where(near, a[:, None], top).min(axis=0))
        a2 = np.minimum(a, np.where(near, b2[None, :], top).min(axis=1))
        if (a2 == a).all() and (b2 == b).all():
            break
        a, b = a2, b2
    u, v = np.concatenate((left, right)), np.concatenate((a, b))
    return u[u != v], v[u != v]


def all_pairs(rows: DataFrame, threshold: float = THRESHOLD, piece: int = PIECE) -> DataFrame:
    """(id, embedding) -> links that connect the same ids as all pairs at the threshold; pieces as in `count_links`."""
    dims = F.size("embedding")
    sizes = settle(rows.groupBy(dims.alias("dims")).agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces")))
    own = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    dealt = rows.withColumn("dims", dims).join(sizes, "dims").withColumn("own", own)
    tasks = dealt.select("*", others).select(
        "dims", "id", "embedding", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")
    )

    def linked(part: pd.DataFrame) -> pd.DataFrame:
        left, right = part[part["own"] == part["a"].iloc[0]], part[part["own"] == part["b"].iloc[0]]
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        near = _units(left["embedding"].tolist()) @ _units(right["embedding"].tolist()).T >= threshold
        u, v = _stars(left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64), near)
        return pd.DataFrame({"u": u, "v": v})

    return tasks.groupBy("dims", "a", "b").applyInPandas(linked, "u long, v long")


def find_links(
    classes: DataFrame, n_passes: int = PASSES, window: int = WINDOW, threshold: float = THRESHOLD, seed: int = 0, piece: int = PIECE
) -> DataFrame:
    """(id, embedding) -> links (u, v), by rounds of passes over the vectors that may still miss a pair."""
    spark = classes.sparkSession
    order = ["pass", "dims", "key", "id"]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = spark.createDataFrame([], "u long, v long")
    left = classes.select("id", "embedding").withColumn("miss", F.lit(0.0))
    turn, n = 0, left.count()
    # a round compares a row with 2 * n_passes * window others, the direct way with all n; one round there is always
    while n > 1 and (turn == 0 or n > 2 * n_passes * window * (turn + 1)):
        keyed = passes(left, n_passes, seed + turn)
        found = settle(windows(keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order), window, threshold))
        links = links.unionByName(found.filter("u is not null").select("u", "v")).unionByName(settle(across(found, window, threshold)))
        met = found.filter("miss is not null").groupBy("id").agg(F.sum("miss").alias("more"))
        left = left.join(met, "id").select("id", "embedding", (F.col("miss") + F.col("more")).alias("miss"))
        left = settle(left.filter(F.col("miss") > float(np.log(MISS))))
        turn, n = turn + 1, left.count()
    return links.unionByName(settle(all_pairs(left, threshold, piece))) if n else links


def count_links(members: DataFrame, threshold: float = THRESHOLD, piece: int = PIECE) -> DataFrame:
    """(component_id, id, copies, embedding) -> (id, n): copies of other classes that link with it in its component.

    Members of a large component are dealt to pieces by hash; a task has one piece against another.
    """
    sizes = members.groupBy("component_id").agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces"))
    own = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    dealt = members.join(settle(sizes), "component_id").withColumn("own", own)
    tasks = dealt.select("*", others).select(
        "component_id", "id", "copies", "embedding", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b")
    )

    def counted(part: pd.DataFrame) -> pd.DataFrame:
        a, b = part["a"].iloc[0], part["b"].iloc[0]
        left, right = part[part["own"] == a], part[part["own"] == b]
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "n": []}, dtype="int64")
        near = _units(left["embedding"].tolist()) @ _units(right["embedding"].tolist()).T >= threshold
        if a == b:
            np.fill_diagonal(near, False)
            return pd.DataFrame({"id": left["id"], "n": near @ right["copies"].to_numpy(np.int64)})
        return pd.DataFrame(
            {
                "id": np.concatenate((left["id"], right["id"])),
                "n": np.concatenate((near @ right["copies"].to_numpy(np.int64), near.T @ left["copies"].to_numpy(np.int64))),
            }
        )

    # one length per task: a component holds vectors of one length only
    return tasks.groupBy("component_id", "a", "b").applyInPandas(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def near_vectors(
    df: DataFrame, n_passes: int = PASSES, window: int = WINDOW, threshold: float = THRESHOLD, seed: int = 0, piece: int = PIECE
) -> DataFrame:
    """(vec_id, embedding) -> one row per row: vec_id, n_links, component_id, kept."""
    good = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("good", good)
    own = settle(
        rows.select(
            "vec_id", "good",
            F.when(F.col("good"), F.xxhash64("embedding")).alias("s1"),
            F.when(F.col("good"), F.xxhash64(F.lit(1), "embedding")).alias("s2"),
            "embedding",
        )
    )
    classes = settle(
        own.filter("good").groupBy("s1", "s2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    )
    joined = components(find_links(classes, n_passes, window, threshold, seed, piece))
    members = classes.join(joined.withColumnRenamed("node", "id"), "id").select("component_id", "id", "copies", "embedding")
    counts = settle(count_links(settle(members), threshold, piece))
    known = settle(
        classes.select("s1", "s2", "id", "copies")
        .join(joined.withColumnRenamed("node", "id"), "id", "left")
        .join(counts, "id", "left")
        .select("s1", "s2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    )
    return (
        own.select("vec_id", "s1", "s2")
        .join(known, ["s1", "s2"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
