"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within `radius` bits share a variant within radius/2 bits of both, and two that share such a variant
are within `radius` bits. So every distinct fingerprint emits all its variants within half the radius and those that
collide are linked. Variants are shuffled by their leading bits: a fingerprint is sent once to each cell (prefix) that
holds variants of it - 1 + k + k(k-1)/2 cells for radius 4 and k leading bits, instead of 2081 rows - and the task of a
cell lays out the variants that begin with its prefix, a bounded number at a time, sorts them and links collisions. k
grows with the logarithm of the number of distinct fingerprints, so cells stay as large as they are while the corpus grows.
Cells are counted before the shuffle: a crowded one, say of a hot group of near copies, goes to several tasks, each of which
takes the variants of its own share of all hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .countmin import bits_for, counted_twice, sketch
from .scan import mixed, shingle_hashes, word_hashes
from .shared import broadcast_if_small, give_back, slices, small_batches, stored

BITS = 64
#: Variants that a cell's task holds at once; a fuller cell is halved by its next bit, again and again.
HELD = 1 << 19
#: Fingerprints of a cell that one task takes; a cell of more goes to several.
CROWD = 1 << 18
#: How many times more of a bucket's texts are compared with all others in each round.
FACTOR = 32
#: Bytes of the sets that every worker holds while others are compared with them.
HEAD_BYTES = 1 << 26
#: Classes of hashes whose counts bound how many shingles two texts have in common.
BINS = 128
#: Fewest leading bits, so that small inputs have some cells too.
LEAST_BITS = 4


def fingerprint(text: str | None, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 for no words or null."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) > width else iter([b" ".join(words)])
    total, ones = max(1, len(words) - width + 1), np.zeros(BITS, np.int64)
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(42))
    for at in range(0, total, 1 << 15):
        part = np.fromiter(hashes, np.uint64, min(1 << 15, total - at))
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp long) of docs(doc_id, text); rows without doc_id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most `radius` of the lowest `bits` bits."""
    return [sum(1 << i for i in c) for w in range(radius + 1) for c in combinations(range(bits), w)]


def forest(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """Indices of links that connect all that the links connect, fewer than there are nodes; earlier links go first."""
    root, kept, at = np.arange(nodes), [], np.arange(len(a))
    while len(at):
        ra, rb = root[a[at]], root[b[at]]
        at, ra, rb = (x[ra != rb] for x in (at, ra, rb))
        high, first = np.unique(np.maximum(ra, rb), return_index=True)
        kept.append(at[first])
        root[high] = np.minimum(ra, rb)[first]
        while len(at) and (up := root[root]).tobytes() != root.tobytes():
            root = up
    return np.concatenate(kept) if kept else at


def _collisions(low: np.ndarray, left: np.ndarray, bits: int, share: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of indices (first of a run, other) of fingerprints that share a variant; left: flips that each has left.

    share (i, n): only variants whose hash is i modulo n.
    """
    masks = {r: np.array(ball(bits, r), np.uint64) for r in set(left.tolist())}
    owner_bits = max(1, int(len(low) - 1).bit_length())
    parts, variants = [], []
    for r, m in masks.items():
        at = np.flatnonzero(left == r)
        variants.append((low[at][:, None] ^ m[None, :]).ravel())
        parts.append(np.repeat(at, len(m)))
    variant, owner = np.concatenate(variants), np.concatenate(parts)
    spread = variant * np.uint64(0x9E3779B97F4A7C15)
    spread ^= spread >> np.uint64(29)
    spread *= np.uint64(0xBF58476D1CE4E5B9)
    if share[1] > 1:
        own = (spread >> np.uint64(40)) % np.uint64(share[1]) == np.uint64(share[0])
        variant, owner, spread = variant[own], owner[own], spread[own]
    packed = (spread >> np.uint64(owner_bits) << np.uint64(owner_bits)) | owner.astype(np.uint64)
    packed.sort()
    a, b = _runs(packed >> np.uint64(owner_bits), (packed & np.uint64((1 << owner_bits) - 1)).astype(np.int64))
    if len(a) and int(np.bitwise_count(low[a] ^ low[b]).max()) > 2 * int(left.max()):  # two variants had one hash: compare the variants themselves
        order = np.lexsort((owner, variant))
        a, b = _runs(variant[order], owner[order])
    yield a, b


def _runs(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of its run, member) for each member but the first."""
    same = np.flatnonzero(key[1:] == key[:-1]) + 1
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else same
    head = starts[np.searchsorted(starts, same, side="right") - 1]
    return owner[head], owner[same]


def _linked(low: np.ndarray, left: np.ndarray, at: np.ndarray, bits: int, share: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Collisions among variants of `bits` free bits, in memory that HELD bounds."""
    sizes = {r: sum(math.comb(bits, w) for w in range(r + 1)) for r in set(left.tolist())}
    if len(at) < 2:
        return
    if bits == 0 or sum(int((left == r).sum()) * n for r, n in sizes.items()) <= HELD:
        for a, b in _collisions(low, left, bits, share):
            yield at[a], at[b]
        return
    top = np.uint64(1 << (bits - 1))
    for bit in (np.uint64(0), top):
        flips = ((low & top) != bit).astype(left.dtype)
        keep = flips <= left
        yield from _linked(low[keep] & ~top, (left - flips)[keep], at[keep], bits - 1, share)


def ball_links(nodes: DataFrame, radius: int = 4, cell_variants: int = 1 << 25) -> DataFrame:
    """Links (a long, b long) that connect all nodes(id long, fp long[, t int]) whose fingerprints differ in at most `radius` (even) bits.

    Every link joins two such nodes; of each cell's links a spanning forest is kept, so a large group of near copies gives
    a number of links in proportion to its size, nearest links first. t tells apart fingerprints of different kinds, which
    aren't compared. Equal fingerprints should be one node. No nodes give no links.
    """
    half = radius // 2
    count, size = nodes.groupBy("t").count().agg(F.max("count")).first()[0] or 0 if "t" in nodes.columns else nodes.count(), len(ball(BITS, half))
    k = max(LEAST_BITS, min(40, math.ceil(math.log2(max(1, count * size / cell_variants)))))
    masks = [m for m in ball(k, half)]
    prefix = F.shiftrightunsigned("fp", BITS - k) if k else F.lit(0).cast("long")
    kind = F.col("t") if "t" in nodes.columns else F.lit(0).alias("t")
    rows = nodes.select("id", "fp", kind, F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m")).select("t", prefix.bitwiseXOR(F.col("m")).alias("cell"), "id", "fp")
    crowded = rows.groupBy("t", "cell").count().where(F.col("count") > CROWD)  # few: each is a bounded part of all rows
    crowded = stored(crowded.select("t", "cell", F.ceil(F.col("count") / CROWD).cast("int").alias("shares")), "crowded")
    rows = rows.join(broadcast_if_small(crowded), ["t", "cell"], "left").withColumn("shares", F.coalesce("shares", F.lit(1))).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))

    def solve(key: tuple, cell: pa.Table) -> pa.Table:
        ids, fps = cell.column("id").to_numpy(), cell.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(ids, kind="stable")
        ids, fps = ids[order], fps[order]
        here, free = np.uint64(key[1].as_py()), BITS - k
        flips = np.bitwise_count((fps >> np.uint64(free)) ^ here) if k else np.zeros(len(fps), np.uint8)
        low = fps & np.uint64((1 << free) - 1) if k else fps
        left, kept = (half - flips).astype(np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for a, b in _linked(low, left, np.arange(len(ids)), free, (key[2].as_py(), key[3].as_py())):
            pairs = np.unique(np.minimum(a, b) * np.int64(len(ids)) + np.maximum(a, b))
            a, b = pairs // len(ids), pairs % len(ids)
            near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
            a, b = np.r_[kept[0], a[near]], np.r_[kept[1], b[near]]
            order = np.argsort(np.bitwise_count(fps[a] ^ fps[b]), kind="stable")
            a, b = a[order], b[order]
            keep = forest(a, b, len(ids))  # leaf by leaf: never more links than there are nodes
            kept = a[keep], b[keep]
        return pa.table({"a": ids[kept[0]], "b": ids[kept[1]]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return rows.groupBy("t", "cell", "share", "shares").applyInArrow(solve, "a long, b long")


def _band_keys(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, same binary, keys array<long>): a digest of the lower-cased words, and a key of `rows` min-hashes of the shingles for each band."""
    seeds = mixed(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by, plus = seeds[: bands * rows] | np.uint64(1), seeds[bands * rows :]

    def least(hashes: np.ndarray) -> np.ndarray:
        return np.min([(hashes[i : i + 2048, None] * by + plus).min(0) for i in range(0, len(hashes), 2048)], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in slices(batches):
            same, minima = [], []
            for text in b.column(1).to_pylist():
                words = word_hashes((text or "").encode().lower())  # bytes: A-Z only
                same.append(xxhash.xxh3_128_digest(words.tobytes()))
                minima.append(least(shingle_hashes(words, width)))
            parts = np.array(minima, np.uint64).reshape(-1, bands, rows)
            keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(parts), 1))
            for r in range(rows):
                keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same, pa.binary()), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.view(np.int64).ravel())], ["doc_id", "same", "keys"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, same binary, keys array<long>")


def shingles(text: str | None, width: int) -> set:
    """Word shingles of a lower-cased text; of fewer words the whole sequence is the one shingle."""
    words = (text or "").encode().lower().split()
    return set(zip(*(words[i:] for i in range(width)), strict=False)) if len(words) > width else {tuple(words)}


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, hashes binary) of texts(doc_id, text): the distinct shingles' 64-bit hashes, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(word_hashes((t or "").encode().lower()), width)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["doc_id", "hashes"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, hashes binary")


def _sizes(sets: DataFrame, most_bits: int = 30) -> DataFrame:
    """(doc_id, size, shared, bins) of sets(doc_id, hashes): how many shingles a text has, at most how many of them some other text has, and how many are in each of BINS classes of hashes.

    Shingles that a count-min sketch over all these texts has once are in no other; the sketch may take single ones for
    shared, never the other way round.
    """
    total = (sets.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) / 8
    bits = bits_for(total, most_bits)
    own = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
    joined = lambda b: (np.concatenate([own(x) for x in b.column(1)]) for _ in range(min(1, len(b))))
    merged = sets.sparkSession.sparkContext.broadcast(sketch(sets, joined, bits, 1 << 19))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sizes = np.array([len(x.as_buffer()) // 8 for x in b.column(1)])
            owner = np.repeat(np.arange(len(b)), sizes)
            hashes = next(joined(b), np.zeros(0, np.uint64))
            shared = np.bincount(owner[counted_twice(hashes, merged.value, bits)], minlength=len(b))
            bins = np.bincount(owner * BINS + (mixed(hashes) % np.uint64(BINS)).astype(np.int64), minlength=len(b) * BINS).astype(np.int32)
            bins = pa.ListArray.from_arrays(np.arange(0, len(bins) + 1, BINS, dtype=np.int32), bins)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64()), bins], ["doc_id", "size", "shared", "bins"])
        give_back()

    out = stored(sets.mapInArrow(run, "doc_id long, size long, shared long, bins array<int>"), "sizes")
    merged.destroy()
    del merged
    give_back()
    return out


def _alike(own: np.ndarray, other: np.ndarray, similarity: float) -> bool:
    """Jaccard similarity of two sorted sets of hashes."""
    few, many = sorted((own, other), key=len)
    if len(few) < similarity * len(many):
        return False
    common = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
    return common >= similarity * (len(own) + len(other) - common)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the pairs(head long, other long) whose sets(doc_id, hashes) have so large a Jaccard similarity, stored.

    While the heads' sets, which are measured, fit in every worker, the others' sets are read once, each with the numbers of
    its heads; else both sets come with every pair.
    """
    spark, read = pairs.sparkSession, lambda v: np.frombuffer(v.as_buffer(), np.uint64)
    heads = sets.join(pairs.select(F.col("head").alias("doc_id")).distinct(), "doc_id", "left_semi")
    if (heads.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) <= HEAD_BYTES:
        table = heads.select("doc_id", "hashes").toArrow()
        known = spark.sparkContext.broadcast({i: read(v) for i, v in zip(table.column(0).to_pylist(), table.column(1), strict=True)})

        def against_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(h, i) for i, own, hs in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True) for h in hs if _alike(read(own), known.value[h], similarity)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        of = pairs.groupBy("other").agg(F.collect_list("head").alias("heads"))  # as many as there are heads at most
        links = stored(sets.join(of, F.col("doc_id") == F.col("other")).select("doc_id", "hashes", "heads").mapInArrow(against_heads, "a long, b long"), "links")
        known.destroy()
        del table, known
        give_back()
        return links

    side = lambda end: sets.select(F.col("doc_id").alias(f"{end}_id"), F.col("hashes").alias(f"{end}_set"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_alike(read(x), read(y), similarity) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("other"), F.col("other") == F.col("other_id")).join(side("head"), F.col("head") == F.col("head_id"))
    return stored(both.select("head", "other", "head_set", "other_set").mapInArrow(verify, "a long, b long"), "links")


def near_components(rows: DataFrame, width: int = 5, similarity: float = 0.8, bands: int = 24, min_hashes: int = 6) -> DataFrame:
    """(doc_id, component) of rows(doc_id long, text): groups that links of a Jaccard similarity of word shingles from `similarity` on connect.

    doc_id must be another one in each row and the same whenever the table is read. Candidates are in one bucket: first that of
    their SimHash group, as simhash_groups() finds it from fingerprints within 4 bits; then, for pairs whose fingerprints lie
    further apart, those of `bands` bands of `min_hashes` min-hashes of their shingles, where a pair of similarity s meets with
    probability 1 - (1 - s**min_hashes)**bands, however its texts differ. Two texts have no more shingles in common than either
    shares with any other text, so a candidate pair for whose similarity these numbers are too small is none. All others are
    verified on whole texts, and only verified links spare comparisons: a bucket's first text, the one with the smallest part
    of its own, is compared with all others, then those after it, FACTOR times as many in each round, with the later ones they
    aren't connected to yet, until each two of a bucket are connected, compared or ruled out. From the second round on a pair
    comes from the first bucket alone that both are in, and is ruled out if its classes of hashes can't have enough in common.
    """
    spark = rows.sparkSession
    with small_batches(spark):
        marked = stored(_band_keys(rows, width, bands, min_hashes), "bands")
    buckets = simhash_groups(rows, width).select(F.col("doc_id").alias("of"), F.xxhash64(F.lit("simhash"), "component_id").alias("group"))
    nodes = marked.groupBy("same").agg(F.min("doc_id").alias("id"), F.min_by("keys", "doc_id").alias("bands"))
    nodes = stored(nodes.join(buckets, F.col("id") == F.col("of")).select("same", "id", F.concat(F.array("group"), "bands").alias("keys")), "nodes")
    keyed = nodes.select("id", F.explode("keys").alias("key"))
    shared_keys = stored(keyed.groupBy("key").count().where("count > 1").select("key"), "keys")
    members = stored(keyed.join(broadcast_if_small(shared_keys), "key"), "members")
    ends = broadcast_if_small(stored(members.select(F.col("id").alias("doc_id")).distinct(), "ends"))
    with small_batches(spark):
        sets = stored(_shingle_sets(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ends, "doc_id", "left_semi"), width), "sets")
        sizes = _sizes(sets)

    slack = 1e-9
    largest = F.col("shared") * (1 + similarity) / similarity - F.col("size") + slack  # that a text alike may be
    members = members.join(sizes.drop("bins"), F.col("id") == F.col("doc_id")).drop("doc_id").withColumn("largest", largest).where(F.col("shared") >= similarity * F.col("size") - slack)
    members = stored(members.select("key", "id", "size", "largest", (1 - F.col("shared") / F.col("size")).alias("own")), "viable")
    head = lambda df: df.select("key", F.col("id").alias("a"), F.col("size").alias("a_size"), F.col("largest").alias("a_largest"), *[c for c in ("a_group", "a_place", "a_keys", "a_bins") if c in df.columns])
    alike = (F.col("size") <= F.col("a_largest")) & (F.col("a_size") <= F.col("largest"))
    first_shared = F.element_at(F.array_intersect("a_keys", "keys"), 1) == F.col("key")
    in_common = F.aggregate(F.zip_with("a_bins", "bins", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)  # at most
    enough = in_common >= (F.col("a_size") + F.col("size")) * (similarity / (1 + similarity)) - slack

    firsts = members.groupBy("key").agg(F.min_by(F.struct("id", "size", "largest"), F.struct("own", "id")).alias("f"), F.count("*").alias("n")).where("n > 1")
    firsts = stored(head(firsts.select("key", "f.*")), "firsts")
    pairs = members.join(broadcast_if_small(firsts), "key").where(alike & (F.col("a") != F.col("id")))
    links, found, waiting, done = None, None, members, 1
    while True:
        pairs = stored(pairs.groupBy(F.least("a", "id").alias("low"), F.greatest("a", "id").alias("high")).agg(F.min("a").alias("head")), "pairs")
        with small_batches(spark):
            new = _verified(pairs.select("head", F.when(F.col("head") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other")), sets, similarity)
        if found is None or not new.isEmpty():
            links = new if links is None else links.union(new)
            found = stored(components(links), "components")
        grouped = waiting.join(found, F.col("id") == F.col("node"), "left").drop("node").withColumn("group", F.coalesce("component", "id")).drop("component")
        grouped = stored(grouped, "grouped")
        apart = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.min("size").alias("least"), F.count("*").alias("n")).where(F.col("low") < F.col("high")).where(F.col("n") > done + 1)
        apart = stored(apart.select("key", "least"), "apart")
        if apart.isEmpty():
            break
        left = grouped.join(broadcast_if_small(apart), "key").where("least <= largest").drop("least")
        if done == 1:
            left = left.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("own", "id")))
            left = left.join(nodes.select(F.col("id").alias("of"), "keys"), F.col("id") == F.col("of")).drop("of").join(sizes.select("doc_id", "bins"), F.col("id") == F.col("doc_id")).drop("doc_id")
        left = stored(left, "left")
        heads = head(left.where(F.col("place").between(done + (done > 1), FACTOR * done)).withColumns({"a_group": F.col("group"), "a_place": F.col("place"), "a_keys": F.col("keys"), "a_bins": F.col("bins")}))
        pairs = heads.join(left, "key").where(alike & F.expr("a_place < place and a_group <> group") & first_shared & enough)
        waiting, done = left.drop("group"), FACTOR * done

    groups = nodes.join(found, F.col("id") == F.col("node"), "left").select("same", F.coalesce("component", "id").alias("component"))
    return marked.select("doc_id", "same").join(groups, "same").select("doc_id", "component")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, bands: int = 24, min_hashes: int = 6) -> DataFrame:
    """(doc_id, component_id): the groups of near_components(), named by the smallest doc_id in each.

    Texts with equal words, ASCII case and white space aside, are one node. Null counts as empty, and all empty texts are
    equal; rows without doc_id are left out; repeated rows stay, and rows of one doc_id with other texts are grouped each by its
    own text; an empty table gives an empty result.
    """
    rows = stored(docs.where("doc_id is not null").select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "rows")
    groups = stored(near_components(rows.select(F.col("row").alias("doc_id"), "text"), width, similarity, bands, min_hashes), "groups")
    named = rows.select("row", "doc_id").join(groups.withColumnRenamed("doc_id", "of"), F.col("row") == F.col("of"))
    return named.join(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("doc_id", "component_id")


def simhash_groups(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp long, component_id): groups of documents that chains of fingerprints within `radius` bits connect.

    component_id is the smallest doc_id of the group. Null texts count as empty; empty texts have fingerprint 0 and link like
    any other; rows without doc_id are left out; repeated rows stay repeated; an empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        fps = stored(fingerprints(docs, width), "fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    found = components(ball_links(nodes.select("id", "fp"), radius))
    groups = nodes.join(found, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(groups, "fp").select("doc_id", "fp", "component_id")
