"""Set similarity join of documents by chosen paths.

A document's set holds its distinct 4-word shingles; sets of a Jaccard similarity of 0.8 or more are linked, and connected
documents are one component. Documents with equal sets are one record of the join.

Every record has COORDS minwise tokens. A tree deals the records out by chosen coordinates: a node chooses, by its own hash, one
coordinate or now and then two (1 / similarity on average), and records with one value there go on to one child. Nodes of
at most SMALL records and SMALL_PAIRS pairs to compare are compared exhaustively; larger ones branch again, down to DEPTH
levels, beyond which their records are compared in tiles. A pair of similarity t survives a level with probability about t a branch, so TREES independent trees are
grown; their roots choose different coordinates. A pair of 0.8 that meets in small nodes at once, the usual case, is missed with
probability 0.2^12; one whose nodes all branch twice more, with under 1e-3.

Not all pairs of a node are told. First the records of a root's child that agree in two more coordinates are each paired with
some of them, and these pairs are verified: that links most of a group of near copies, whatever else shares its node. Nodes
whose records are then one component are done; in the others only pairs of different components are compared. A comparison
is by sizes and by parity bits, both necessary conditions, and by the number of equal coordinates, which passes a pair of 0.8
but for MISS. What these pass is held against parities as wide as the sets are large, another necessary condition, so that large
texts that share much, but less than is asked for, are not told in the square of their number. Every pair told is verified on the full sets of 64-bit shingle hashes.

Node sizes and pairs are counted before anything is gathered, so a task never holds more than SMALL records of a node, or two
shares of TILE records of a tile.

Defined results: a null text counts as empty; documents without words have an empty set, are linked with nothing and keep their
own id; a null doc_id never names a component unless all its documents have none (its component is null then, and it is
kept); repeated rows share a component; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import bit_set, in_bits
from .common import arrow_map, materialize, partitions, rows_in
from .graph import components
from .words import BASE, Words, mixed

SHINGLE, SIMILARITY = 4, 0.8
COORDS, TREES, DEPTH = 64, 10, 6
#: most records of a node that is compared exhaustively, and most of its pairs of different components
SMALL, SMALL_PAIRS = 1 << 13, 1 << 19
PAIRS_AT_ONCE, TILE = 1 << 14, 512
MASKS = (0, 0x2A5F0C3B96D1, 0x15C3A96E3D28, 0x3FFFFFFFFFFF)
#: bits of parity; chance that the coordinates fail a pair of the similarity asked for; bits of the set that keeps texts from a shuffle;
#: 64-bit words of wide parities compared at once
PARITY, MISS, BITS_KEPT, PARITY_AT_ONCE = 256, 1e-6, 1 << 26, 1 << 20
_FACTORS = np.random.default_rng(12).integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WIDE = COORDS + PARITY // 32


def shingle_sets(texts: list[str | None], words: Words, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; of fewer words the whole is the one shingle; none without words."""
    seq, n = words.read(texts)
    every = seq.copy()
    for k in range(1, shingle):
        every = mixed(every * BASE + np.roll(seq, -k))
    out, at = [], 0
    for m in (n - 1).tolist():
        if m >= shingle:
            own = np.unique(every[at : at + m - shingle + 1])
        else:
            own = np.full(min(m, 1), m, np.uint64)
            for x in seq[at : at + m]:
                own = mixed(own * BASE + x)
        out.append(own)
        at += m + 1
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """COORDS minwise tokens of 32 bits and PARITY bits (whether an odd number of shingles hash there) of each set, none of them empty."""
    out = np.empty((len(sets), _WIDE), np.uint32)
    if not sets:
        return out
    every, first = np.concatenate(sets), np.cumsum([0, *map(len, sets)])
    for k in range(COORDS):
        out[:, k] = np.minimum.reduceat(every * _FACTORS[k], first[:-1]) >> np.uint64(32)
    at = np.repeat(np.arange(len(sets)), np.diff(first)) * PARITY + (every >> np.uint64(40) & np.uint64(PARITY - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=PARITY * len(sets)) & 1).astype(np.uint8).reshape(-1, PARITY)
    out[:, COORDS:] = np.packbits(odd, axis=1, bitorder="little").view(np.uint32)
    return out


def wide_parity(own: np.ndarray) -> np.ndarray:
    """Parity bits of a set, two or more for a shingle: as many as a power of two, so that a longer row folds to a shorter one."""
    size = max(PARITY, 1 << int(2 * len(own) - 1).bit_length())
    odd = np.bincount((own >> np.uint64(40) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def wide_differ(wide: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the wide parities of the pairs differ, the longer of a pair folded to the length of the other."""
    size = np.array([len(w) for w in wide], np.int64)
    short = np.minimum(size[x], size[y])
    out = np.zeros(len(x), np.int64)
    for k in np.unique(short).tolist():
        every = np.flatnonzero(short == k)
        for at in np.array_split(every, -(-len(every) * k // PARITY_AT_ONCE)):
            used, place = np.unique(np.concatenate([x[at], y[at]]), return_inverse=True)
            rows = np.stack([np.bitwise_xor.reduce(wide[i].reshape(-1, k), axis=0) for i in used.tolist()])
            out[at] = np.bitwise_count(rows[place[: len(at)]] ^ rows[place[len(at) :]]).sum(1, dtype=np.int64)
    return out


def may_differ(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Most shingles that only one of two sets of these sizes can have."""
    return ((1 - similarity) * (n + m) + 1e-6) / (1 + similarity)


def fewest_equal(similarity: float, miss: float = MISS) -> int:
    """Most equal coordinates that can be asked for so that a pair of the similarity fails with a chance under ``miss``."""
    below, m = 0.0, 0
    while True:
        below += comb(COORDS, m) * similarity**m * (1 - similarity) ** (COORDS - m)
        if below >= miss:
            return m
        m += 1


def alike(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of records (sizes, sketches) can be as similar as asked for."""
    ok = np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9
    at = np.flatnonzero(ok)
    differ = np.bitwise_count(x[at, COORDS:] ^ y[at, COORDS:]).sum(1, dtype=np.int64)
    fine = differ <= may_differ(n[at], m[at], similarity)
    at, some = at[fine], at[~fine]
    ok[some] = False
    ok[at] = (x[at, :COORDS] == y[at, :COORDS]).sum(1) >= fewest_equal(similarity)
    return ok


def root_choices(similarity: float = SIMILARITY, trees: int = TREES) -> list[tuple[int, int]]:
    """(tree, coordinate) of the roots: 1 / similarity coordinates on average, all different while there are enough."""
    order = np.random.default_rng(7).permutation(COORDS).tolist()
    want = [int((t + 1) / similarity) - int(t / similarity) for t in range(trees)]
    out = [(t, 0) for t, k in enumerate(want) for _ in range(k)]
    return [(t, order[i % COORDS]) for i, (t, _) in enumerate(out)]


def branch(nodes: np.ndarray, sketches: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """(index of the record, child) for the coordinates that each record's node chooses."""
    h = mixed(nodes.view(np.uint64) ^ BASE)
    first = (h % np.uint64(COORDS)).astype(np.int64)
    second = (first + 1 + (h >> np.uint64(8)).astype(np.int64) % (COORDS - 1)) % COORDS
    both = np.flatnonzero((h >> np.uint64(44)).astype(np.float64) / 2**20 < 1 / similarity - 1)
    at = np.concatenate([np.arange(len(nodes)), both])
    coord = np.concatenate([first, second[both]])
    return at, child(nodes[at], coord, sketches[at, coord])


def child(nodes: np.ndarray, coord: np.ndarray, value: np.ndarray) -> np.ndarray:
    return (mixed(mixed(nodes.view(np.uint64) * BASE + coord.astype(np.uint64)) ^ value.astype(np.uint64)) >> np.uint64(1)).view(np.int64)


def _sketches_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, _WIDE)


def records(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, k1, k2 (128-bit name of the set), n (its size), sketch, wide (parity), row of every document; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in rows_in(batches):
            sets = shingle_sets(batch.column("text").to_pylist(), words, shingle)
            full = [i for i, s in enumerate(sets) if len(s)]
            own: list[bytes | None] = [None] * len(sets)
            wide = [wide_parity(s).tobytes() if len(s) else None for s in sets]
            for i, row in zip(full, sketch([sets[i] for i in full])):
                own[i] = row.tobytes()
            names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.binary()), pa.array(wide, pa.binary())], names=["doc_id", "text_key", "k1", "k2", "n", "sketch", "wide"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    made = arrow_map(given, run, "doc_id long, text_key long, k1 long, k2 long, n long, sketch binary, wide binary")
    return materialize(made.withColumn("row", F.monotonically_increasing_id()), "join-records")


def _screened(pairs: DataFrame, features: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that ``alike`` passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches, 4096):
            c = {name: batch.column(name) for name in ("a", "b", "na", "nb")}
            ok = alike(c["na"].to_numpy(), c["nb"].to_numpy(), _sketches_of(batch.column("xa")), _sketches_of(batch.column("xb")), similarity)
            yield pa.RecordBatch.from_arrays([c["a"].filter(pa.array(ok)), c["b"].filter(pa.array(ok))], names=["a", "b"])

    a, b = (features.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"x{x}")) for x in "ab")
    return arrow_map(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "xa", "xb"), run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, features: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs whose full sets are as similar as asked for. Of every record one row of the documents is read."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    nodes = materialize(ids.join(features.select("id", "doc_id", "text_key"), "id"), "join-asked")
    asked = docs.sparkSession.sparkContext.broadcast(bit_set(nodes.select(F.col("text_key").alias("key")), BITS_KEPT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in rows_in(batches):
            batch = batch.filter(pa.array(in_bits(asked.value, batch.column("text_key").to_numpy())))
            sets = shingle_sets(batch.column("text").to_pylist(), words, shingle) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "text_key", "own"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    found = arrow_map(given.select("doc_id", "text_key", "text"), run, "doc_id long, text_key long, own array<long>").alias("f")
    same = F.col("f.text_key").eqNullSafe(F.col("n.text_key")) & F.col("f.doc_id").eqNullSafe(F.col("n.doc_id"))
    sets = materialize(found.join(nodes.alias("n"), same).select("id", "own").dropDuplicates(["id"]), "join-sets")
    a, b = sets.select(F.col("id").alias("a"), F.col("own").alias("x")), sets.select(F.col("id").alias("b"), F.col("own").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    # in whole numbers: 100 * intersection >= 80 * union
    enough = 100 * both >= F.lit(round(100 * similarity)) * (F.size("x") + F.size("y") - both)
    return pairs.join(a, "a").join(b, "b").where(enough).select("a", "b")


def _told(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of different components in nodes of few records (node, id, component, n, sketch, wide) that ``alike`` and the wide parities pass."""

    def settle(ids: np.ndarray, group: np.ndarray, n: np.ndarray, own: np.ndarray, wide: np.ndarray) -> Iterator[pa.RecordBatch]:
        # by component, the largest last, so that its records are only met by those of the others
        _, which, size = np.unique(group, return_inverse=True, return_counts=True)
        order = np.lexsort((which, size[which]))
        ids, n, own, which, wide = ids[order], n[order], own[order], which[order], wide[order]
        ends = np.repeat(np.append(np.flatnonzero(np.diff(which)) + 1, len(ids)), np.diff(np.append(np.flatnonzero(np.diff(which, prepend=-1)), len(ids))))
        upto = np.cumsum(len(ids) - ends)
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
            some = len(ids) - ends[lo:hi]
            x = np.repeat(np.arange(lo, hi), some)
            y = ends[x] + np.arange(len(x)) - np.repeat(np.cumsum(some) - some, some)
            ok = alike(n[x], n[y], own[x], own[y], similarity)
            x, y = x[ok], y[ok]
            used, place = np.unique(np.concatenate([x, y]), return_inverse=True)
            differ = wide_differ([np.frombuffer(w, np.uint64) for w in wide[used]], place[: len(x)], place[len(x) :])
            ok = differ <= may_differ(n[x], n[y], similarity)
            if ok.any():
                a, b = ids[x[ok]], ids[y[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None

        def whole_nodes(upto: int) -> Iterator[pa.RecordBatch]:
            cut = np.flatnonzero(np.diff(kept[0][:upto])) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), upto]):
                yield from settle(*(x[s:e] for x in kept[1:]))

        for batch in rows_in(batches, 2048):
            new = [*(batch.column(c).to_numpy() for c in ("node", "id", "component", "n")), _sketches_of(batch.column("sketch")), np.array([*batch.column("wide").to_pylist(), None], object)[:-1]]
            kept = new if kept is None else [np.concatenate([x, y]) for x, y in zip(kept, new)]
            upto = int(np.searchsorted(kept[0], kept[0][-1])) if len(kept[0]) else 0
            if upto:
                yield from whole_nodes(upto)
                kept = [x[upto:] for x in kept]
        if kept is not None and len(kept[0]):
            yield from whole_nodes(len(kept[0]))

    dealt = members.repartition(partitions(members.sparkSession), "node").sortWithinPartitions("node")
    return arrow_map(dealt.select("node", "id", "component", "n", "sketch", "wide"), run, "a long, b long")


def _mixed_nodes(members: DataFrame) -> DataFrame:
    """(node, id, component, m, pairs) of the nodes whose m records are of more than one component; pairs: of different ones."""
    sizes = members.groupBy("node", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("own"))
    sizes = sizes.select("node", "m", ((F.col("m") * F.col("m") - F.col("own")) / 2).cast("long").alias("pairs")).where("pairs > 0")
    return members.join(sizes, "node")


def _tiles(members: DataFrame) -> DataFrame:
    """Large nodes as tiles: records are dealt into shares of about TILE, and every two shares meet in a node of their own."""
    shares = F.ceil(F.col("m") / TILE).cast("int")
    own = members.withColumns({"shares": shares, "share": F.pmod(F.xxhash64("id"), shares).cast("int")})
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    return other.select(F.xxhash64("node", F.least("share", "other"), F.greatest("share", "other")).alias("node"), "id", "component").distinct()


def linked(docs: DataFrame, own: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(member, names): node (a record's id) and component of all records with links; names: k1, k2, id, first (smallest doc_id)."""
    # of equal sets the row with the least number is the record
    record = F.min(F.struct(F.col("row").alias("id"), "doc_id", "text_key", "n", "sketch", "wide")).alias("record")
    features = materialize(own.where("n > 0").groupBy("k1", "k2").agg(record, F.min("doc_id").alias("first")).select("k1", "k2", "first", "record.*"), "join-features")
    names = features.select("k1", "k2", "id", "first")
    roots = root_choices(similarity)

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches, 4096):
            own, ids = _sketches_of(batch.column("sketch")), batch.column("id").to_numpy()
            nodes = [child(np.full(len(ids), -1 - t), np.full(len(ids), k), own[:, k]) for t, k in roots]
            stars = []
            for node, (_, k) in zip(nodes, roots):
                for step in (1, 2):
                    other = (k + step * COORDS // 3) % COORDS
                    node = child(node, np.full(len(ids), other), own[:, other])
                stars.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(stars)), pa.array(np.tile(ids, len(roots)))], names=["node", "star", "id"])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_in(batches, 4096):
            at, nodes = branch(batch.column("node").to_numpy(), _sketches_of(batch.column("sketch")), similarity)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), batch.column("id").take(pa.array(at)), batch.column("component").take(pa.array(at))], names=["node", "id", "component"])

    planted = materialize(arrow_map(features.select("id", "sketch"), plant, "node long, star long, id long"), "join-planted")
    # under each mask the record whose masked id is the least is a centre
    centres = [F.min(F.col("id").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)).alias(f"c{i}") for i, m in enumerate(MASKS)]
    stars = planted.groupBy("star").agg(F.count(F.lit(1)).alias("m"), *centres).where("m > 1").select("star", F.array_distinct(F.array(*(f"c{i}" for i in range(len(MASKS))))).alias("centres"))
    met = planted.join(stars, "star").select("id", F.explode("centres").alias("centre")).where("id <> centre")
    star = met.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    tested = materialize(_screened(star, features, similarity), "join-pairs")
    first = _verified(tested, docs, features, similarity, shingle)

    member = components(first)
    shared = planted.groupBy("node").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("node")
    known = planted.join(shared, "node").join(member.select(F.col("node").alias("id"), "component"), "id", "left").select("node", "id", F.coalesce("component", "id").alias("component"))
    compared = None
    for level in range(DEPTH + 1):
        now = materialize(_mixed_nodes(known), "join-mixed")
        few = (F.col("m") <= SMALL) & (F.col("pairs") <= SMALL_PAIRS)
        small, large = now.where(few).select("node", "id", "component"), now.where(~few)
        over = large.isEmpty()
        if level == DEPTH and not over:
            small = small.union(_tiles(large))
        compared = small if compared is None else compared.union(small)
        if over:
            break
        known = arrow_map(large.join(features.select("id", "sketch"), "id").select("node", "id", "component", "sketch"), grow, "node long, id long, component long")
    told = _told(compared.join(features.select("id", "n", "sketch", "wide"), "id"), similarity).distinct()
    more = materialize(told.join(tested, ["a", "b"], "left_anti"), "join-more-pairs")
    if more.isEmpty():
        return member, names
    # links that join components, between their names: only these go through rounds again
    late = _verified(more, docs, features, similarity, shingle)
    for x in ("a", "b"):
        late = late.join(member.select(F.col("node").alias(x), F.col("component").alias("c")), x, "left").withColumn(x, F.coalesce("c", x)).drop("c")
    joined = components(late.select("a", "b"))
    renamed = member.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return renamed.union(joined.join(member.select("node"), "node", "left_anti").select("node", "component")), names


def cluster(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept of every document."""
    own = records(docs, shingle)
    member, names = linked(docs, own, similarity, shingle)
    member = member.select(F.col("node").alias("id"), "component")
    least = names.join(member, "id").groupBy("component").agg(F.min("first").alias("least"))
    named = names.join(member, "id", "left").join(least, "component", "left").select("k1", "k2", F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    named = materialize(named, "join-named")
    # two plain shuffles: the join can be split where very many documents have one set
    out = own.select("doc_id", "k1", "k2", "n").join(named, ["k1", "k2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
