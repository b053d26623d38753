"""Near-duplicate classes by HyperMinHash sketches, banded registers and full-set checks.

Each distinct shingle set is sketched once. A sketch has REGISTERS buckets; a
bucket stores, for the least hash that falls into it, the number of leading
zeros and MANTISSA bits after them (Yu & Weber, "HyperMinHash", 2017). Short
sets would leave buckets empty, so a set of n shingles is entered t(n) times
under t(n) seeds, which leaves its Jaccard similarities unchanged; t is fixed
within a size class [2^c, 2^(c+1)), and a set that could match one of the next
class is sketched there too, so that partners always share a class.

There are BANDS bands of ROWS registers, and no register is in two of them.
Measured with these sketches, 2 of 160,000 pairs at a similarity of 0.80 share
no band (1.3e-5; (1 - 0.8^7)^48 is 1.2e-5) and none of 160,000 at 0.85, while
texts that only share a passage (0.2) meet with 6e-4 by (1 - (1 - 0.2^7)^48).
Pairs that share a band pass the collision-corrected estimate from the first
KEPT registers when it is within five standard errors of the threshold, and are
confirmed on full shingle sets.

The nodes of the graph are distinct sets, each named by the first row that has
it, so an id with several texts has a node for each of them. Groups of copies
are not expanded: equal sets collapse into one node;
within a band a star joins its members to the smallest one. Bands that then
still hold several components are searched for links across them, small ones in
pairs, large ones in whole blocks that emit only links joining components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewell.llm.text import mix, shingle_set
from brinewell.operators.components import connected_components
from brinewell.plans.lineage import cut, small
from brinewell.plans.skew import join_heavy

BANDS, ROWS = 48, 7
REGISTERS = BANDS * ROWS
#: Registers that are stored for the estimate; the bands use all.
KEPT = 160
MANTISSA = 10
EMPTY = 0xFFFF
#: Mean entries of a register; a register stays empty with probability e^-LOAD at most.
LOAD = 8
#: Members of a band that are paired outright, and bytes of full sets in one block of a larger band.
FEW, BLOCK_BYTES = 8, 16 << 20
#: Standard errors by which an estimate may miss the threshold before the pair is dropped.
MARGIN = 5.0

_U = np.uint64
_SIGNATURE = pa.schema([
    ("row", pa.int64()), ("id", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()),
    ("classes", pa.list_(pa.int32())), ("sketches", pa.list_(pa.binary())), ("bands", pa.list_(pa.int64())),
])


def repeats(size_class: int) -> int:
    """Times that each shingle of a set in this size class enters its sketch."""
    return -(-LOAD * REGISTERS // (1 << size_class))


def size_classes(n: int, threshold: float) -> list[int]:
    c = n.bit_length() - 1
    return [c, c + 1] if n >= threshold * (1 << (c + 1)) else [c]


_EDGES = np.arange(REGISTERS, dtype=_U) << _U(32)
_FACTORS = mix(np.arange(1, ROWS + 1, dtype=_U)) | _U(1)


def sketch(shingles: np.ndarray, size_class: int) -> np.ndarray:
    """The compressed registers (uint16) of one set in one size class."""
    seeds = mix(np.arange(1, repeats(size_class) + 1, dtype=_U) + _U(size_class << 20))
    h = mix((shingles[None, :] ^ seeds[:, None]).ravel())
    # Bucket in the upper half, hash in the lower: sorted, the least of a bucket is the first at or after its edge.
    h = np.sort((((h >> _U(32)) * _U(REGISTERS)) & _U(0xFFFFFFFF00000000)) | (h & _U(0xFFFFFFFF)))
    at = np.searchsorted(h, _EDGES)
    least = h[np.minimum(at, len(h) - 1)]
    empty = (at == len(h)) | (least >> _U(32) != _EDGES >> _U(32))
    low = least & _U(0xFFFFFFFF)
    part, exponent = np.frexp(low.astype(np.float64))
    bits = (np.maximum(part * 2 - 1, 0) * (1 << MANTISSA)).astype(np.int64)
    return np.where(empty, EMPTY, (np.where(low == 0, 33, 32 - exponent) << MANTISSA) | bits).astype(np.uint16)


def band_keys(registers: np.ndarray, size_class: int) -> list[int]:
    """A key for each band without an empty register."""
    rows = registers.reshape(BANDS, ROWS)
    key = mix((rows * _FACTORS).sum(1, dtype=_U) + np.arange(BANDS, dtype=_U) + _U((size_class + 1) << 8))
    return key[(rows != EMPTY).all(1)].view(np.int64).tolist()


def chance_of_equal_registers(a: float, b: float) -> float:
    """Probability that registers of two unrelated sets with loads a and b collide."""
    zeros = np.arange(0, 33)[:, None]
    cell = 2.0 ** (-zeros - 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
    width = 2.0 ** (-zeros - 1) / (1 << MANTISSA)
    p = [np.exp(-load * cell) * -np.expm1(-load * width) for load in (a, b)]
    return float((p[0] * p[1]).sum())


def estimate(a: np.ndarray, b: np.ndarray, chance: float) -> float:
    """Jaccard similarity from two sketches, with chance collisions taken out."""
    used = (a != EMPTY) | (b != EMPTY)
    n = int(used.sum())
    if not n:
        return 0.0
    same = int(((a == b) & used).sum())
    return max(0.0, (same / n - chance) / (1 - chance))


def _signatures(size: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, rows = whole.slice(at, 512), []
                for *keys, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    s = shingle_set(text, size)
                    n = len(s)
                    with np.errstate(over="ignore"):
                        a, b = (mix(s ^ _U(x)).sum(dtype=_U).view(np.int64) for x in (0x1234567, 0x7654321))
                    kinds = size_classes(n, threshold) if n else []
                    sketches = [sketch(s, c) for c in kinds]
                    bands = [k for c, r in zip(kinds, sketches, strict=True) for k in band_keys(r, c)]
                    rows.append((*keys, n, int(a), int(b), kinds, [r[:KEPT].tobytes() for r in sketches], bands))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), _SIGNATURE, strict=True)], schema=_SIGNATURE)

    return run


def _likely(threshold: float):
    """Keep pairs whose estimate comes near the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance: dict[tuple[int, int, int], float] = {}
        for batch in batches:
            keep = []
            ids, cols = batch.select(["a", "b"]), [batch.column(x).to_pylist() for x in ("n_a", "n_b", "classes_a", "classes_b", "sketches_a", "sketches_b")]
            for na, nb, ca, cb, sa, sb in zip(*cols, strict=True):
                ok = False
                for c in set(ca) & set(cb):
                    at = (na, nb, c)
                    if at not in chance:
                        if len(chance) > 4096:
                            chance.clear()
                        chance[at] = chance_of_equal_registers(na * repeats(c) / REGISTERS, nb * repeats(c) / REGISTERS)
                    a, b = np.frombuffer(sa[ca.index(c)], np.uint16), np.frombuffer(sb[cb.index(c)], np.uint16)
                    error = (threshold * (1 - threshold) / KEPT) ** 0.5
                    ok |= estimate(a, b, chance[at]) >= threshold - MARGIN * error
                keep.append(ok)
            yield ids.filter(pa.array(keep, pa.bool_()))

    return run


def _linked(x: int, y: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (x + y - both) > 0


def _confirmed(percent: int):
    """Keep pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sa, sb in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(sa.as_buffer(), _U), np.frombuffer(sb.as_buffer(), _U)
                keep.append(_linked(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = pa.array([shingle_set(t.as_py(), size).tobytes() for t in batch.column("text")], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node"), sets], names=["node", "whole"])

    return run


def _bridges(ids: list[int], components: list[int], sides: list[bool], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of one block pair, found by counting shared shingles through postings.

    Every member outside the component with most members is held against all
    others at once, so each pair across components is covered; members joined
    meanwhile are passed over.
    """
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    shingles = np.concatenate(sets)
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]
    _, roots = np.unique(components, return_inverse=True)
    side = np.array(sides)
    largest = int(np.bincount(roots).argmax())
    out = []
    for i in np.flatnonzero(roots != largest):
        first, last = np.searchsorted(shingles, sets[i], "left"), np.searchsorted(shingles, sets[i], "right")
        runs = last - first
        where = np.repeat(first - np.cumsum(runs) + runs, runs) + np.arange(int(runs.sum()))
        both = np.bincount(owner[where], minlength=len(sets))
        near = (100 * both >= percent * (n + n[i] - both)) & (roots != roots[i]) & (both > 0)
        if side.any() and not side.all():
            near &= side != side[i]
        for j in np.flatnonzero(near):
            if roots[j] != roots[i]:
                out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
                roots[roots == roots[j]] = roots[i]
    return out


def _across(percent: int):
    """Bridges of each run of rows with one ``(key, low, high)``; such a run is a block pair of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def flush() -> pa.RecordBatch:
            out = _bridges(*map(list, zip(*rows, strict=True)), percent) if len({r[1] for r in rows}) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for key, low, high, block, i, c, whole in zip(*(batch.column(x).to_pylist() for x in ("key", "low", "high", "block", "node", "component", "whole")), strict=True):
                if (key, low, high) != now:
                    if rows:
                        yield flush()
                    now, rows = (key, low, high), []
                rows.append((i, c, block == high and low != high, np.frombuffer(whole, _U)))
        if rows:
            yield flush()

    return run


def row_keys(id_col: Column, text: Column) -> list[Column]:
    """Two 64-bit hashes, ``key_a`` and ``key_b``, by which rows of equal id (or none) and text are told from all others."""
    return [F.xxhash64(id_col.cast("long"), text.cast("string")).alias("key_a"), F.xxhash64(text.cast("string")).alias("key_b")]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, by_id: bool = True) -> DataFrame:
    """``(id, key_a, key_b, n_shingles, component_id, kept, first)``, one row per row of ``docs``.

    Links join texts with ``100 * intersection >= percent * union`` of their
    ``size``-word shingle sets; components are named by their smallest id, and
    ``kept`` says that a row has this id. ``first`` holds for exactly one row of
    each component, whatever its ids; ``key_a`` and ``key_b`` are the
    :func:`row_keys` by which rows are found again.

    Null and wordless texts have an empty set, are linked with nothing and are
    kept and first. Repeated ids: each row is returned; with ``by_id`` the rows
    of one id are one node, whatever their texts, and rows without an id have a
    null component and are kept; else only texts link, so that ids may repeat
    or be null. Other columns, of whatever name, are not read. An empty table
    gives no rows.
    """
    threshold = percent / 100
    id_, text = F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
    keyed = docs.select(id_, *row_keys(F.col(id_col), F.col(text_col)), text)
    schema = "row long, id long, key_a long, key_b long, n_shingles long, set_a long, set_b long, classes array<int>, sketches array<binary>, bands array<long>"
    signed = cut(keyed.select(F.monotonically_increasing_id().alias("row"), "*").mapInArrow(_signatures(size, threshold), schema), "signatures")
    nodes = signed.select("row", "id", "n_shingles", "set_a", "set_b").where("n_shingles > 0")
    nodes = nodes.where("id is not null") if by_id else nodes
    same_set = ["n_shingles", "set_a", "set_b"]
    members = cut(nodes.groupBy(*same_set).agg(F.min("row").alias("node"), F.min("id").alias("low"), F.count("*").alias("rows")), "members")
    reps = signed.join(members.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    reps = cut(reps.select("node", "key_a", "key_b", "n_shingles", "classes", "sketches", "bands"), "reps")

    banded = reps.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last")).where("center < last").drop("last")
    rows = cut(banded.join(shared, "key"), "shared_bands")
    # The texts of sets that share a band are hashed once more and kept; a merge join at every size, as the wanted rows grow with the input.
    wanted = reps.select("node", "key_a", "key_b").join(rows.select("node").distinct(), "node", "left_semi")
    texts = keyed.drop("id").hint("merge").join(wanted, ["key_a", "key_b"]).dropDuplicates(["key_a", "key_b"])
    sets = cut(texts.select("node", "text").mapInArrow(_sets(size), "node long, whole binary"), "sets")
    stars = rows.where("node > center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    links = cut(_check(stars, reps, sets, percent), "links")
    found = connected_components(links, "a", "b")
    links = links.union(_open_bands(rows.drop("center"), cut(found, "components"), stars, reps, sets, percent))
    if by_id:
        links = links.union(_several_texts(nodes, members, same_set))

    # Copies follow their node directly; the loop runs on linked nodes alone.
    final = cut(connected_components(links, "a", "b"), "components")
    lowest = final.join(members.select("node", "low"), "node").groupBy("component").agg(F.min("low").alias("least"))
    named = cut(members.join(final.join(lowest, "component"), "node", "left").select(*same_set, F.coalesce("component", "node").alias("root"), F.coalesce("least", "low").alias("component_id"), "rows"), "named")
    placed = join_heavy(signed.select("row", "id", "key_a", "key_b", *same_set), named, same_set, "rows")
    alone = (F.col("n_shingles") == 0) | F.col("root").isNull() | (F.col("id").isNull() if by_id else F.lit(False))
    component = F.when(alone, F.col("id")).otherwise(F.col("component_id"))
    placed = placed.select("id", "key_a", "key_b", "n_shingles", component.alias("component_id"), F.coalesce(F.col("row") == F.col("root"), F.lit(True)).alias("first"))
    return placed.select("id", "key_a", "key_b", "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"), "first")


def _several_texts(nodes: DataFrame, members: DataFrame, same_set: list[str]) -> DataFrame:
    """Links ``(a, b)`` between the nodes of each id that has different sets."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in same_set for f in (F.min, F.max)]
    differ = " or ".join(f"min_{c} <> max_{c}" for c in same_set)
    several = cut(nodes.groupBy("id").agg(*ends).where(differ).select("id"), "several_texts")
    pairs = nodes.drop("row").join(small(several), "id").distinct().join(members.drop("low", "rows"), same_set).select("id", "node")
    pairs = cut(pairs, "id_nodes")
    first = pairs.groupBy("id").agg(F.min("node").alias("b"))
    return pairs.join(first, "id").where("node <> b").select(F.col("node").alias("a"), "b")


def _open_bands(rows: DataFrame, found: DataFrame, stars: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across the components that still meet in a band.

    Bands with up to FEW members make pairs, fewer than FEW for each member.
    Larger ones are handed out whole, as block pairs of bounded bytes, and
    emit only links that join components.
    """
    placed = rows.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    several = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x < y").select("key", "n")
    rest = cut(placed.join(several, "key"), "open_bands")
    few = rest.where(F.col("n") <= FEW)
    left, right = few.select("key", F.col("node").alias("a"), F.col("component").alias("ca")), few.select("key", F.col("node").alias("b"), F.col("component").alias("cb"))
    pairs = left.join(right, "key").where("a > b and ca <> cb").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    links = _check(pairs, reps, sets, percent)

    many = rest.where(F.col("n") > FEW).join(reps.select("node", "n_shingles"), "node")
    blocks = many.groupBy("key").agg(F.ceil(F.sum(F.col("n_shingles") * 8) / BLOCK_BYTES).alias("blocks"))
    dealt = many.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node", "key"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", "node", "component", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    drawn = dealt.join(sets, "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return cut(links.union(drawn.mapInArrow(_across(percent), "a long, b long")), "bridges")


def _check(pairs: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` that pass the estimate and then the full sets.

    The pairs between are stored: over broadcast joins both functions would run
    in one task, with a Python worker each, and double an executor's workers.
    """
    side = reps.select("node", "n_shingles", "classes", "sketches")
    drawn = pairs.join(side.toDF("a", "n_a", "classes_a", "sketches_a"), "a").join(side.toDF("b", "n_b", "classes_b", "sketches_b"), "b")
    likely = cut(drawn.mapInArrow(_likely(percent / 100), "a long, b long"), "likely")
    full = likely.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    return full.mapInArrow(_confirmed(percent), "a long, b long")
