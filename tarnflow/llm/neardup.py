"""MinHash near-dedup by fast similarity sketching, banding and exact verification of word shingles.

Equal shingle sets are one class first. Each class is sketched once: rounds of hashed bin placement until every coordinate is filled. Classes
that agree in all rows of a band meet in a bucket, and each is verified against the hub of every bucket it is in, one pair for each such
hub. Links contract classes to components, and a bucket within one component is done. In the other buckets members of different components
are candidates: where few met, all of them; in larger buckets those whose finer sketches, made for these classes alone, are near enough.
No pair of a bucket goes unseen, and pairs within a component, which are most where copies are many, are never listed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import drop_stored, let_go, lookup, salt, ship, stored
from tarnflow.llm.graph import components, extended

WORDS, PERCENT = 5, 75
#: Two sets of similarity s share no bucket with chance (1 - s**ROWS)**BANDS: 1 in 90,000 at 0.75, 1 in 10 million at 0.8.
BANDS, ROWS = 80, 7
#: Members of a bucket up to which its pairs are tested by the first sketch; above it by one of FINE coordinates.
SMALL, FINE = 32, 4096
#: Members of a deal of such a bucket, and the most deals that it is parted into (what is still too much for a task, Spark splits).
DEAL, MOST_DEALS = 256, 8
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order; A-Z lower-cased; words part at bytes 9 to 13 and 32. Every byte is mixed with its place."""
    raw = np.frombuffer(data, np.uint8)
    solid = np.flatnonzero(~_SPACE[raw])
    if not len(solid):
        return np.zeros(0, np.uint64)
    first = np.flatnonzero(np.diff(solid, prepend=-2) > 1)
    sizes = np.diff(first, append=len(solid))
    place = (np.arange(len(solid)) - np.repeat(first, sizes)).astype(np.uint64)
    sums = np.add.reduceat(mixed((place << np.uint64(8) | _LOWER[raw[solid]]) + _STEP), first)
    return mixed(sums + sizes.astype(np.uint64) * _STEP)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of `words` words; of the whole sequence if it has fewer; none without words."""
    hashes = word_hashes((text or "").encode())
    if not len(hashes):
        return hashes
    n = min(words, len(hashes))
    chained = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        chained = mixed(chained * _STEP + hashes[k : len(hashes) - n + 1 + k])
    return np.unique(chained)


def alike(one: np.ndarray, other: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether the intersection is at least percent of the union, in whole numbers."""
    small, large = sorted((len(one), len(other)))
    if not small or 100 * small < percent * large:
        return False
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(other) - both)


def sketches(sets: list[np.ndarray], size: int) -> np.ndarray:
    """A row of `size` coordinates for each nonempty set; two rows agree in a coordinate with the sets' similarity as chance.

    In round t < size every element falls into a hashed bin with a hashed value after those of earlier rounds; in round size + j all fall
    into bin j. A set is done when its bins are full, so the work is about max(elements, size * ln(size)), and no bin stays empty.
    """
    out = np.full(len(sets) * size, _EMPTY)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    items = np.concatenate([*sets, np.zeros(0, np.uint64)])
    for t in range(2 * size):
        if not len(items):
            break
        h = mixed(items + np.uint64((t + 1) * int(_STEP) & (1 << 64) - 1))
        at = ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) if t < size else np.full(len(items), t - size)
        np.minimum.at(out, owner * size + at, (np.uint64(t) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
        live = np.unique(owner) if t % 8 == 0 or t < 4 else None
        if live is not None:
            open_sets = np.zeros(len(sets), bool)
            open_sets[live] = (out.reshape(-1, size)[live] == _EMPTY).any(1)
            keep = open_sets[owner]
            owner, items = owner[keep], items[keep]
    return out.reshape(len(sets), size)


def band_hashes(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = mixed(sketch).reshape(-1, bands, rows)
    folded = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(rows):
        folded = mixed(folded * _STEP + parts[:, :, k])
    return folded.astype(np.int64)


def bit_rows(sketch: np.ndarray) -> np.ndarray:
    """The lowest bit of each coordinate, in rows of 64-bit numbers."""
    packed = np.packbits((sketch & np.uint64(1)).astype(np.uint8), axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.int64)


def most_unlike(size: int, percent: int) -> int:
    """Bits that differ between sets of percent similarity: the mean and 4.5 standard deviations (3 in a million have more)."""
    unlike = (1 - percent / 100) / 2
    return math.ceil(size * unlike + 4.5 * math.sqrt(size * unlike * (1 - unlike)))


def _listed(rows: np.ndarray, present: list[bool]) -> pa.ListArray:
    """A list for each place of present: the next of rows, or an empty one."""
    offsets = np.cumsum([0, *[rows.shape[1] * p for p in present]])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows.reshape(-1)))


def _sketcher(bands: int, rows: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part = batch.slice(at, 400)
                sets = [shingles(t, words) for t in part.column(2).to_pylist()]
                present = [len(s) > 0 for s in sets]
                sketch = sketches([s for s in sets if len(s)], bands * rows)
                listed = [_listed(made, present) for made in (band_hashes(sketch, bands, rows), bit_rows(sketch))]
                marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.binary()), *listed], ["doc_id", "text_key", "n_shingles", "mark", "bands", "bits"])

    return run


def _refiner(size: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for at in range(0, batch.num_rows, 50):
                part = batch.slice(at, 50)
                fine = bit_rows(sketches([shingles(t, words) for t in part.column(1).to_pylist()], size))
                yield pa.RecordBatch.from_arrays([part.column(0), _listed(fine, [True] * len(fine))], ["node", "fine"])

    return run


def _verifier(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        hub = hub_set = None
        for batch in batches:
            found = []
            for at in range(0, batch.num_rows, 200):
                for b, deal, a, text in zip(*[c.to_pylist() for c in batch.slice(at, 200).columns], strict=True):
                    if a is None:
                        if (b, deal) != hub:
                            hub, hub_set = (b, deal), shingles(text, words)
                    elif (b, deal) == hub and alike(shingles(text, words), hub_set, percent):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts are alike. b may be in any number of pairs: they are dealt by (b, salt of a), with b's text
    once each. texts: node, text.

    The joins are shuffled at every size: texts are large, and neither they nor the pairs have a bound to broadcast by."""
    dealt = pairs.select("a", "b", salt(F.col("a")).alias("_deal"))
    hubs = dealt.select("b", "_deal").distinct().hint("shuffle_hash").join(texts.withColumnRenamed("node", "b"), "b").select("b", "_deal", F.lit(None).cast("long").alias("a"), "text")
    members = dealt.hint("shuffle_hash").join(texts.withColumnRenamed("node", "a"), "a").select("b", "_deal", "a", "text")
    met = hubs.unionByName(members).repartition("b", "_deal").sortWithinPartitions("b", "_deal", F.col("a").asc_nulls_first())
    return met.mapInArrow(_verifier(words, percent), "a long, b long")


def _unlike(x: str, y: str, words: int) -> str:
    return " + ".join(f"bit_count({x}[{k}] ^ {y}[{k}])" for k in range(words))


def rooted_by_links(docs: DataFrame, classes: DataFrame, words: int, percent: int, size: int) -> DataFrame:
    """(node, root) of the classes that are alike to others, root the smallest node that such links reach.

    docs: doc_id, text. classes: node, own (doc_id and text_key of a row that has its text), n, bands, bits; size: coordinates of a sketch."""
    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = stored(banded.groupBy("band").agg(F.count("*").alias("size"), F.min("node").alias("hub")).filter("size > 1"), "buckets")
    met = stored(banded.join(buckets, "band").select("band", "node", "size", "hub"), "met")
    owners = classes.join(met.select("node").distinct(), "node").select("node", F.col("own.doc_id").alias("_doc"), F.col("own.text_key").alias("_key"))
    texts = stored(docs.join(owners.hint("shuffle_hash"), F.expr("doc_id <=> _doc and xxhash64(text) = _key")).groupBy("node").agg(F.first("text").alias("text")), "candidates")
    about = classes.select("node", "n", "bits")
    n_words, most = -(-size // 64), most_unlike(size, percent)
    sizes = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
    # Every class against the hubs of its buckets.
    star = met.filter("node <> hub").groupBy("node").agg(F.collect_set("hub").alias("hubs")).join(about, "node").select(F.explode("hubs").alias("hub"), "node", F.struct("n", "bits").alias("x"))
    star = star.join(about.select(F.col("node").alias("hub"), F.struct("n", "bits").alias("y")), "hub")
    star = stored(star.filter(f"{sizes} and {_unlike('x.bits', 'y.bits', n_words)} <= {most}").select(F.col("node").alias("a"), F.col("hub").alias("b")), "pairs")
    first = stored(verified(star, texts, words, percent), "links")
    roots = components(first)
    # Members of different components in what buckets are left.
    rooted = met.join(roots.select("node", "root"), "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
    left = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("band")
    apart = stored(rooted.join(left, "band"), "apart")
    few = apart.filter(f"size <= {SMALL}").join(about, "node")
    other = f"x.band = y.band and x.node > y.node and x.root <> y.root and {sizes}"
    pair = [F.col("x.node").alias("a"), F.col("y.node").alias("b")]
    pairs = few.alias("x").join(few.alias("y"), F.expr(f"{other} and {_unlike('x.bits', 'y.bits', n_words)} <= {most}")).select(*pair)
    many = apart.filter(f"size > {SMALL}")
    if not many.isEmpty():
        own = many.groupBy("node").agg(F.first("root").alias("root"), F.array_sort(F.collect_list("band")).alias("own"), F.collect_list(F.struct("band", F.least(F.lit(MOST_DEALS), F.ceil(F.col("size") / DEAL)).cast("int").alias("deals"))).alias("in"))
        fine = texts.join(own.select("node"), "node").mapInArrow(_refiner(FINE, words), "node long, fine array<long>")
        fine = stored(own.join(fine, "node").join(about.select("node", "n"), "node"), "fine")
        # A large bucket's members are dealt, and each deal meets each other: one more shuffled copy for each, and no task with the whole bucket.
        dealt = fine.select("node", "root", "n", "own", "fine", F.explode("in").alias("in")).select("node", "root", "n", "own", "fine", "in.*")
        deal = F.pmod(F.xxhash64("node"), F.col("deals")).cast("int")
        every = F.explode(F.expr("sequence(0, deals - 1)"))
        x, y = dealt.withColumn("i", deal).withColumn("j", every), dealt.withColumn("j", deal).withColumn("i", every)
        # Some of the bits first; each pair in the first bucket that it shares.
        some = f"{_unlike('x.fine', 'y.fine', 8)} <= {most_unlike(512, percent)}"
        all_bits = f"aggregate(zip_with(x.fine, y.fine, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v) <= {most_unlike(FINE, percent)}"
        pairs = pairs.unionByName(x.alias("x").join(y.alias("y"), F.expr(f"{other} and x.i = y.i and x.j = y.j and {some} and {all_bits} and array_min(array_intersect(x.own, y.own)) = x.band")).select(*pair))
    more = stored(pairs.distinct().join(star, ["a", "b"], "left_anti"), "pairs")
    second = stored(verified(more, texts, words, percent), "links")
    for done in (buckets, met, texts, star, apart, more):
        drop_stored(done)
    return extended(roots, second)


def _grouped(docs: DataFrame, words: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes). rows: doc_id, text_key, n_shingles and node of every row. nodes: node and low, the least (bare, doc_id, text_key) of the
    node's component, where rows without doc_id come last."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    sketched = stored(keyed.mapInArrow(_sketcher(bands, rows, words), "doc_id long, text_key long, n_shingles long, mark binary, bands array<long>, bits array<long>"), "sketches")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_key"))
    classes = sketched.filter("mark is not null").groupBy("mark").agg(least.alias("own"), F.first(F.struct(F.col("n_shingles").alias("n"), "bands", "bits")).alias("s"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), "mark", "own", "s.*"), "classes")
    placed = stored(sketched.select("doc_id", "text_key", "n_shingles", "mark").join(classes.select("mark", "node"), "mark", "left").select("doc_id", "text_key", "n_shingles", "node"), "rows")
    # Rows that share a doc_id.
    shared = placed.filter("doc_id is not null and node is not null").groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("high")).filter("b < high").select("doc_id", "b")
    same = placed.join(shared, "doc_id").filter("node > b").select(F.col("node").alias("a"), "b").distinct()
    roots = extended(rooted_by_links(docs, classes, words, percent, bands * rows), same)
    nodes = classes.select("node", "own").join(roots.select("node", "root"), "node", "left").select("node", "own", F.coalesce("root", "node").alias("root"))
    lows = nodes.groupBy("root").agg(F.min("own").alias("low"))
    nodes = stored(lookup(nodes.select("node", "root"), "root", lows, "node").select("node", "low"), "nodes")
    drop_stored(sketched)
    drop_stored(classes)
    return placed, nodes


def linked(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Rows are linked if the Jaccard similarity of their sets of word shingles is at least percent / 100; component_id is the smallest doc_id
    that a row reaches, kept says that it is the row's own. A null, empty or blank text has no shingles and no links: component_id is the
    row's doc_id. Rows with shingles that share a doc_id share a component, whatever their texts. A row without doc_id is linked like any
    other; component_id is null if it reaches no row with one. An empty table gives no row. Columns but doc_id and text aren't looked at.
    """
    placed, nodes = _grouped(docs, words, percent, bands, rows)
    out = placed.join(nodes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("low.doc_id")).alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs, all columns, one of each group of near copies: the one with the smallest doc_id (rows without doc_id come last), then
    the smallest text hash; of rows alike in both, any one. Rows without shingles are in no group and stay."""
    placed, nodes = _grouped(docs, words, percent, bands, rows)
    out = placed.filter("node is not null").join(nodes, "node")
    first = F.col("doc_id").eqNullSafe(F.col("low.doc_id")) & (F.col("text_key") == F.col("low.text_key"))
    by_row = stored(out.groupBy("doc_id", "text_key").agg(F.bool_or(first).alias("first"), F.count("*").alias("n")).filter("not first or n > 1").select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "first"), "dropped")
    # The columns of docs in one, so that none of their names meets one of ours.
    own, same = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")), F.expr("d.doc_id <=> _doc and xxhash64(d.text) = _key")
    # Shuffled at every size, as the other joins with texts are: a broadcast of these keys would grow with the input, and sorts would hold texts.
    found = own.join(by_row.filter("not first").select("_doc", "_key").hint("shuffle_hash"), same, "left_anti")
    repeated = by_row.filter("first").select("_doc", "_key")
    if repeated.isEmpty():
        return found.select("d.*")
    once = own.join(repeated, same, "left_semi").select("d.*").dropDuplicates(["doc_id", "text"])
    return found.join(repeated, same, "left_anti").select("d.*").unionByName(once)
