"""Exact Jaccard join of shingle sets, as a metric-space join.

The space: sets of word shingles under the Jaccard distance, which obeys the triangle inequality.  Equal sets are one point.

Cells.  All texts are far from nearly all others (distance 1), so pivots taken at random would see nothing.  A set x
therefore lies in the cells of its first |x| - c + 1 shingles, where c shared ones are needed at least: two linked
sets meet in such a cell whatever the order of shingles, as long as it is the same for all sets.

Regions.  Each cell names its most typical member (the cell's shingle stands earliest in its order) as pivot.  Cells of
one pivot are one Voronoi region; a set lies in the regions of all its cells' pivots, so boundary sets are replicated and
linked sets meet.  Members are compared with the pivot, unless their sizes or sketches (bits of the sets) show that they
are too far from it: a dense group of near copies falls together in one step.

Recursion.  In a region with the pivot p, sets are replaced by their differences to it (what they lack and what they have more).
That keeps all distances: two differences differ in just what the sets differ in.  By the triangle inequality two sets close to p
are in one component already, and a set farther away is linked to those only that share so much of its difference (see
_needed()).  So a crowded region is joined again as sets of differences, in cells of what they share.  Regions whose members
are all in one component are done; in small ones the members are compared where two lower bounds of their distance
(the triangle inequality, and bits of the sets) leave room.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressglass.llm.common import Scratch, bounded_batches, numbered, private, stored
from pressglass.llm.words import gram_hashes, mixed, word_hashes

#: Members of a region up to which they are compared with each other; larger regions are split again.
SMALL = 512
#: Splits of a region at most; what is left then is compared as in small regions.
LEVELS = 2
#: A row number's bits (4 million tasks of 8 billion rows); above them stands the place in an order, up to 127.
RID_BITS = 55
RID_MASK = (1 << RID_BITS) - 1
#: Bits of a set that bound distances from below, as 64-bit numbers, and their columns.
SKETCH = 8
SKETCHES = [f"s{i}" for i in range(SKETCH)]
#: Cells of the table that says which shingles are frequent: its size is fixed (4 bytes each). It travels in slices.
CELL_BITS = 22
CELLS, SLICES = 1 << CELL_BITS, 64
#: Parts of the cells, and of the points, that are dealt out in turn: the others' shuffle files aren't on disk meanwhile.
CELL_PARTS, POINT_PARTS = 2, 4
#: Entries of cells in an Arrow batch, and characters of texts that are cut up at once.
STEP, AT_ONCE = 100_000, 1 << 20


def shingle_sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """Each text's set as sorted 64-bit hashes of its k-word shingles; fewer words make one shingle, none an empty set."""
    sizes = np.cumsum([len(t) for t in texts])
    if len(texts) > 1 and sizes[-1] > AT_ONCE:  # long texts are done in turn
        cut = max(1, int(np.searchsorted(sizes, AT_ONCE)))
        return shingle_sets(texts[:cut], k) + shingle_sets(texts[cut:], k)
    words, rows, _, _ = word_hashes(texts)
    grams = gram_hashes(words, k)
    out = []
    for a, b in zip(rows.tolist(), rows[1:].tolist(), strict=False):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:  # told apart from whole shingles by its number of words
            out.append(gram_hashes(words[a:b], b - a) + np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _packed(text: str) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(text.encode("utf-8", "surrogatepass"))


def _unpacked(body: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(body).decode("utf-8", "surrogatepass")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """rid, id, n_shingles, digest (of the set; null for empty sets) for every row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), k)
            digests = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            columns = [batch.column("rid"), batch.column("id"), sizes, pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "id", "n_shingles", "digest"])

    return docs.mapInArrow(each, f"rid long, id {docs.schema['id'].dataType.simpleString()}, n_shingles long, digest binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts (slice, counts) of equal slices added up; one slice of counts per slice is held."""
    sums: dict[int, np.ndarray] = {}
    unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for part, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts = np.frombuffer(unpack(body), np.int64)
            sums[part] = sums[part] + counts if part in sums else counts
    if sums:
        bodies = pa.array([pack(c.tobytes()) for c in sums.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), bodies], names=["part", "body"])


def _frequent(texts: DataFrame, k: int) -> np.ndarray:
    """How often the shingles of each cell of the hash space occur in all texts: CELLS counts, whatever the input.

    Only an order of shingles hangs on it (rare ones first): any order gives the same links.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, salt = np.zeros(CELLS, np.int64), TaskContext.get().partitionId() % 32
        for batch in batches:
            sets = shingle_sets([_unpacked(x) for x in batch.column("body").to_pylist()], k)
            if sets:
                np.add.at(counts, _cells(np.concatenate(sets)), 1)
        pack = zstandard.ZstdCompressor(level=1).compress
        bodies = [pack(x.tobytes()) for x in np.split(counts, SLICES)]
        columns = [pa.array(range(SLICES), pa.int32()), pa.array(bodies, pa.binary()), pa.array([salt] * SLICES, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "body", "salt"])

    parts = texts.mapInArrow(each, "part int, body binary, salt int").repartition("part", "salt").select("part", "body")
    sums = parts.mapInArrow(_summed, "part int, body binary").repartition("part").mapInArrow(_summed, "part int, body binary")
    out = np.zeros((SLICES, CELLS // SLICES), np.int64)
    for r in sums.toLocalIterator():
        out[r.part] += np.frombuffer(zstandard.ZstdDecompressor().decompress(r.body), np.int64)
    return np.minimum(out.ravel(), (1 << 31) - 1).astype(np.int32)


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _lead(at: np.ndarray, rid: np.ndarray, near: np.ndarray | bool = False) -> np.ndarray:
    """Who leads a cell, the smallest first: sets that aren't close to their last pivot, then by the place of the cell's
    shingle in the set's order, then by row number."""
    return (np.asarray(near, np.int64) << 62) | (np.minimum(at, 127) << RID_BITS) | rid


def _set_cells(texts: DataFrame, order: np.ndarray, k: int, percent: int, parts: int = 1) -> list[DataFrame]:
    """cell, lead for the first |x| - ceil(t |x|) + 1 shingles of each set x, rare ones first: so many parts of the cells."""
    shared = texts.sparkSession.sparkContext.broadcast(order)  # CELLS numbers, whatever the input

    def each(part: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, counts = [], []
            for s in shingle_sets([_unpacked(x) for x in batch.column("body").to_pylist()], k):
                counts.append(len(s) - -(-percent * len(s) // 100) + 1)
                cells.append(s[np.argsort(shared.value[_cells(s)], kind="stable")[: counts[-1]]])  # s ascends
            if not cells:
                continue
            cell = np.concatenate(cells)
            own = np.flatnonzero(cell % np.uint64(parts) == np.uint64(part))
            at = np.concatenate([np.arange(c) for c in counts])[own]
            lead = _lead(at, np.repeat(batch.column("rid").to_numpy(), counts)[own])
            cell = cell[own].view(np.int64)
            for i in range(0, len(cell), STEP):
                yield pa.RecordBatch.from_arrays([pa.array(cell[i : i + STEP]), pa.array(lead[i : i + STEP])], names=["cell", "lead"])

    return [texts.mapInArrow(partial(each, part), "cell long, lead long") for part in range(parts)]


def _regions(parts: list[DataFrame], tables: Scratch) -> DataFrame:
    """parts: cell, lead, and component where known, no cell in two of them -> pivot, rid of the cells that more than one set (or
    component) lies in.  Entries of one part are on disk at a time, and once."""
    found = [tables.stored(_regions_of(entries, tables), "part") for entries in parts]
    return tables.stored(reduce(DataFrame.union, found).distinct(), "regions")


def _regions_of(entries: DataFrame, tables: Scratch) -> DataFrame:
    """pivot, rid of some cells, see _regions()."""
    group = "component" if "component" in entries.columns else "lead"
    heads = entries.groupBy("cell").agg(F.min("lead").alias("head"), F.min(group).alias("low"), F.max(group).alias("high"))
    heads = heads.where("low != high").select("cell", F.col("cell").alias("twin"), F.col("head").bitwiseAND(RID_MASK).alias("pivot"))
    heads = tables.stored(heads, "heads")  # so that entries are on disk once at a time
    # Joined on more than the grouping key: both sides are dealt out anew, so that AQE can split a cell with many sets.
    met = entries.withColumn("twin", F.col("cell")).join(heads.hint("merge"), ["cell", "twin"])
    return met.select("pivot", F.col("lead").bitwiseAND(RID_MASK).alias("rid")).where("pivot != rid").distinct()


def _with_bodies(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """pairs: pivot, rid and more -> the same with body (of rid) and pivot_body.

    Bodies are dealt out by rid once, for both joins: of those only what a pair needs goes on, and of the pivots, of which there are
    few, each one once.  Never by a broadcast of few pairs: the plan, and what it shuffles, is the same at every size.
    """
    own = pairs.join(bodies.hint("merge"), "rid")
    pivots = pairs.select(F.col("pivot").alias("rid")).distinct().join(bodies.hint("merge"), "rid")
    return own.join(pivots.select(F.col("rid").alias("pivot"), F.col("body").alias("pivot_body")).hint("merge"), "pivot")


def _both_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of rid and pivot of each row; equal texts of a batch are cut up once."""
    bodies = [*batch.column("body").to_pylist(), *batch.column("pivot_body").to_pylist()]
    new = list(dict.fromkeys(bodies))
    known = dict(zip(new, shingle_sets([_unpacked(x) for x in new], k), strict=True))
    n = batch.num_rows
    return ((known[x], known[p]) for x, p in zip(bodies[:n], bodies[n:], strict=True))


def sketch(s: np.ndarray) -> np.ndarray:
    """SKETCH numbers of 64 bits: whether the number of the set's shingles in each of their places is odd.

    Two sets' bits differ in no more places than the sets differ in shingles.
    """
    odd = np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _known(texts: DataFrame, k: int) -> DataFrame:
    """rid, body, n (set size), s0 .. (the set's sketch) of each point."""
    names = ["rid", "body", "n", *SKETCHES]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(x), *sketch(x).tolist()) for x in shingle_sets([_unpacked(x) for x in batch.column("body").to_pylist()], k)]
            columns = [batch.column("rid"), batch.column("body"), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(each, ", ".join(["rid long", "body binary", "n long", *(f"{c} long" for c in SKETCHES)]))


def _part(df: DataFrame, i: int) -> DataFrame:
    """The rows of df that belong to a part of the points."""
    return df.where(F.pmod(F.xxhash64("rid"), F.lit(POINT_PARTS)) == i)


def _sized(regions: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """regions: pivot, rid -> the same with n, s0 .., and maybe_near: sizes and sketches leave room for a link to the pivot."""
    own = regions.join(known.select("rid", "n", *SKETCHES), "rid")
    pivots = known.select(F.col("rid").alias("pivot"), F.col("n").alias("n_p"), *[F.col(c).alias(f"{c}_p") for c in SKETCHES])
    both = own.join(pivots, "pivot").withColumn("maybe_near", _room("", "_p", percent))
    return both.select("pivot", "rid", "n", *SKETCHES, "maybe_near")


def _room(x: str, y: str, percent: int):
    """Whether two lower bounds of a distance, that of the sizes and that of the sketches, leave room for a link."""
    n, m = F.col(f"n{x}"), F.col(f"n{y}")
    bits = sum(F.bit_count(F.col(f"{s}{x}").bitwiseXOR(F.col(f"{s}{y}"))) for s in SKETCHES)
    return _within(F.abs(n - m), n + m, percent) & _within(bits, n + m, percent)


def _measured(pairs: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """pivot, rid, apart (shingles that one of the two has), near (linked)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart, near = [], []
            for x, p in _both_sets(batch, k):
                apart.append(len(x) + len(p) - 2 * len(np.intersect1d(x, p, assume_unique=True)))
                near.append(_within(apart[-1], len(x) + len(p), percent))
            columns = [batch.column("pivot"), batch.column("rid"), pa.array(apart, pa.int64()), pa.array(near, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["pivot", "rid", "apart", "near"])

    found = _with_bodies(pairs.select("pivot", "rid"), bodies).select("pivot", "rid", "body", "pivot_body")
    return found.mapInArrow(each, "pivot long, rid long, apart long, near boolean")


def _within(apart, sizes, percent: int):
    """Whether sets that differ in `apart` shingles, of so many together, are linked: 100 * shared >= percent * united."""
    return (100 + percent) * apart <= (100 - percent) * sizes


def _needed(apart: int, n: int, n_pivot: int, near: bool, percent: int) -> int | None:
    """How much of its difference to the pivot p (apart shingles) a set x of n shingles shares at least with the difference of
    any set y that it is linked to; None if it can be linked to none.  Pairs of which both are linked to p don't count.

    With c shared, x and y differ in apart + b - 2 c shingles (b: y's difference to p), which is (100 - t) / (100 + t)
    of their sizes at most.  If x is linked to p, y isn't, which bounds b from below; else all b are tried.  c = 0 would
    make both be linked to p.
    """
    more, less = 100 + percent, 100 - percent
    if near:
        return max(1, (more * apart + less * (n_pivot - n)) // (2 * more) + 1)
    b = np.arange(apart + less * (n + 100 * n // percent) // more + 2)
    most = less * (n + np.minimum(n_pivot + b, 100 * n // percent)) // more
    shared = np.maximum(1, -((most - apart - b) // 2))
    shared = shared[shared <= np.minimum(apart, b)]
    return int(shared.min()) if len(shared) else None


def _difference_cells(region: DataFrame, bodies: DataFrame, k: int, percent: int) -> DataFrame:
    """region: pivot, rid, near, component -> cell, lead, component: cells of the differences' first apart - c + 1 shingles.

    What a set has more than the pivot comes first (few others have it), then what it lacks.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [batch.column(c).to_pylist() for c in ("pivot", "rid", "near", "component")]
            for pivot, rid, near, component, (x, p) in zip(*names, _both_sets(batch, k), strict=True):
                own = np.concatenate([np.setdiff1d(x, p, True), np.setdiff1d(p, x, True)])
                shared = _needed(len(own), len(x), len(p), near, percent)
                if shared is None:
                    continue
                cell = mixed(own[: len(own) - shared + 1] ^ mixed(np.array([pivot], np.uint64))).view(np.int64)
                lead = _lead(np.arange(len(cell)), np.int64(rid), near)
                for i in range(0, len(cell), STEP):
                    part = cell[i : i + STEP]
                    columns = [pa.array(part), pa.array(lead[i : i + STEP]), pa.array(np.full(len(part), component))]
                    yield pa.RecordBatch.from_arrays(columns, names=["cell", "lead", "component"])

    rows = _with_bodies(region.select("pivot", "rid", "near", "component"), bodies)
    return rows.select("pivot", "rid", "near", "component", "body", "pivot_body").mapInArrow(each, "cell long, lead long, component long")


def _close_pairs(region: DataFrame, percent: int) -> DataFrame:
    """region: pivot, rid, n, apart, near, component, s0 .. -> pivot, rid: the pairs of small regions that may be linked.

    Of the pair one isn't linked to the region's pivot, components differ, and sizes, sketches and (where distances to the
    pivot were measured) the triangle inequality leave room.
    """
    columns = ["rid", "n", "apart", "near", "component", *SKETCHES]
    x = region.where("not near").select(F.col("pivot").alias("centre"), *[F.col(c).alias(f"{c}_x") for c in columns])
    y = region.select(F.col("pivot").alias("centre"), *[F.col(c).alias(f"{c}_y") for c in columns])
    once = F.col("near_y") | (F.col("rid_x") < F.col("rid_y"))
    window = _within(F.abs(F.col("apart_x") - F.col("apart_y")), F.col("n_x") + F.col("n_y"), percent)
    wanted = (F.col("component_x") != F.col("component_y")) & once & _room("_x", "_y", percent) & F.coalesce(window, F.lit(True))
    pairs = x.join(y, "centre").where(wanted)
    return pairs.select(F.least("rid_x", "rid_y").alias("pivot"), F.greatest("rid_x", "rid_y").alias("rid")).distinct()


def components(links: DataFrame, tables: Scratch) -> DataFrame:
    """rid, component for every rid in links (a, b): the smallest rid that is reachable.

    Each node is hooked to its smallest neighbour, hooks are followed to their ends by pointer doubling, and nodes are
    replaced by where they end, until no link between different nodes is left: a logarithmic number of rounds, all
    in tables of the shared folder.  Repeated links and loops are dropped on the way.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    links, found = tables.stored(links, "links"), None
    while True:
        ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = tables.stored(ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "hooks")
        moved = 1
        while moved:
            on = hooks.join(hooks.select(F.col("a").alias("to"), F.col("to").alias("next")), "to")
            hooks, n = tables.counted(on.select("a", F.col("next").alias("to"), F.col("to").alias("was")), "hooks", moved=F.col("to") != F.col("was"))
            hooks, moved = hooks.drop("was"), n["moved"]
        if found is None:
            found = hooks.withColumnsRenamed({"a": "rid", "to": "component"})
        else:
            found = found.join(hooks.withColumnRenamed("a", "component"), "component", "left")
            found = found.select("rid", F.coalesce("to", "component").alias("component"))
        ahead = links.join(hooks.select("a", F.col("to").alias("to_a")), "a")
        ahead = ahead.join(hooks.select(F.col("a").alias("b"), F.col("to").alias("to_b")), "b")
        ahead = ahead.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        links, n = tables.counted(ahead.where("a != b").distinct(), "links", left=F.lit(True))
        if not n["left"]:
            return tables.stored(found, "found")


def _components_of_links(points: list[tuple[Scratch, DataFrame]], tables: Scratch, k: int, percent: int) -> DataFrame:
    """points: rid, body of each point, by parts, each in a scope of its own that ends here -> rid, component of the linked ones."""
    texts = reduce(DataFrame.union, [part for _, part in points])
    entries, bodies, known, parts = _set_cells(texts, _frequent(texts, k), k, percent, CELL_PARTS), None, None, None
    for level in range(1, LEVELS + 1):
        regions = _regions(entries, tables)
        if bodies is None:
            inside = tables.stored(regions.select("rid").union(regions.select("pivot")).distinct(), "inside")
            known_parts = []
            for i, (scope, part) in enumerate(points):
                known_parts.append(tables.stored(_known(part.join(_part(inside, i).hint("merge"), "rid", "left_semi"), k), "known"))
                scope.remove()  # nothing reads the part's texts any more
            known_sets = reduce(DataFrame.union, known_parts)
            bodies = known_sets.select("rid", "body")
        sized = tables.stored(_sized(regions, known_sets, percent), "sized")
        measured, new = tables.counted(_measured(sized.where("maybe_near"), bodies, k, percent), "measured", links=F.col("near"))
        found = measured.where("near").select(F.col("pivot").alias("a"), F.col("rid").alias("b"))
        known = found if known is None else known.union(found)
        if parts is None or new["links"] or more.get("links"):
            parts = components(known, tables)
        placed = sized.drop("maybe_near").join(measured, ["pivot", "rid"], "left").join(parts, "rid", "left")
        placed = placed.withColumn("near", F.coalesce("near", F.lit(False))).withColumn("component", F.coalesce("component", "rid"))
        kinds = placed.groupBy("pivot").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"))
        crowded = F.col("members") > SMALL if level < LEVELS else F.lit(False)
        kinds = kinds.where("low != high").select("pivot", F.col("pivot").alias("twin"), crowded.alias("crowded"))
        mixed_ = placed.withColumn("twin", F.col("pivot")).join(kinds, ["pivot", "twin"]).drop("twin")
        mixed_, n = tables.counted(mixed_, "mixed", small=~F.col("crowded"), crowded=F.col("crowded"))
        more: dict[str, int] = {}
        if n["small"]:
            pairs, more = tables.counted(_close_pairs(mixed_.where("not crowded"), percent), "pairs", all=F.lit(True))
            if more["all"]:
                late = _measured(pairs, bodies, k, percent).where("near").select(F.col("pivot").alias("a"), F.col("rid").alias("b"))
                late, more = tables.counted(late, "late", links=F.lit(True))
                known = known.union(late)
            if more.get("links") and not n["crowded"]:
                parts = components(known, tables)
        if not n["crowded"]:
            return parts
        entries = [tables.stored(_difference_cells(mixed_.where("crowded"), bodies, k, percent), "differences")]
    raise AssertionError("no region is crowded at the last level")


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: rid, id, n_shingles, component_id (smallest id that links lead to), component (smallest rid so).

    Two rows link when 100 * shared >= percent * united shingles.  Null and empty texts have empty sets and link with
    nothing; rows without an id take part, and give a component their id only where it has no other; repeated
    rows each give a row.  Shingles are compared by 64-bit hashes.  docs is read from files.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    read = numbered(docs, "_rid").select(F.col("_rid").alias("rid"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = pa.array([_packed(t) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), bodies], names=["rid", "body"])

    with Scratch(spark, "jaccard") as tables:
        sets = tables.stored(_sets(read, k), "sets")
        # Equal sets are one point, named by its smallest row; its members are joined back on more than the grouping key,
        # so that AQE can split a point with many rows.
        equal = sets.where("digest is not null").groupBy("digest").agg(F.min("rid").alias("point"), F.min("n_shingles").alias("n_shingles"))
        member = tables.stored(sets.join(equal, ["digest", "n_shingles"]).select("rid", "id", "point"), "members")
        first = member.where("rid = point").select("rid")
        points = []
        for i in range(POINT_PARTS):
            packed = _part(read.select("rid", "text"), i).mapInArrow(pack, "rid long, body binary")
            scope = tables.inner("points")
            points.append((scope, scope.stored(packed.join(_part(first, i).hint("merge"), "rid", "left_semi"), "points")))
        parts = _components_of_links(points, tables, k, percent)
        whole = member.join(parts.withColumnRenamed("rid", "point"), "point", "left")
        whole = tables.stored(whole.select("rid", "id", F.coalesce("component", "point").alias("component")), "whole")
        names = whole.groupBy("component").agg(F.min("id").alias("component_id")).withColumn("twin", F.col("component"))
        found = whole.withColumn("twin", F.col("component")).join(names, ["component", "twin"])
        out = sets.join(found.select("rid", "component", "component_id"), "rid", "left")
        named = [F.coalesce("component_id", "id").alias("component_id"), F.coalesce("component", "rid").alias("component")]
        return stored(out.select("rid", F.col("id").alias(id_col), "n_shingles", *named), "near")


def drop_near_copies(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs (read from files), all their columns: of each component the one with the smallest id (null last) stays."""
    row = private(docs, "_rid")
    rows = numbered(docs, row)
    found = near_duplicates(docs, percent, k, id_col, text_col).select("rid", "component", F.col(id_col).alias("id"))
    first = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("first")).select(F.col("first.rid").alias("rid"))
    gone = found.select("rid").join(first, "rid", "left_anti").withColumnRenamed("rid", row)
    return rows.join(gone.hint("merge"), row, "left_anti").select(*docs.columns)
