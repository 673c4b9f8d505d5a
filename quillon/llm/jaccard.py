"""N-gram Jaccard join over parity sketches.

Documents with the same shingles are one class. A class's sketch is the parity (XOR) of its
shingles over very many bits, in blocks: each shingle flips one bit of one block, so the
number of bits, and of blocks, in which two sketches differ is at most the symmetric
difference of the sets. Sets of a and b shingles with Jaccard of at least t differ in at most
(a + b)(1 - t)/(1 + t) = d, hence of each one's first d + 1 non-empty blocks one is equal in the
other (pigeonhole): sketches are joined per size band on blocks. A set of at most d non-empty
blocks (rare, as bands have many more) gives all of them and its band's key of such sets: two of
these share that key, and one of these shares a block with any other set that it links with.
Shingles that very many documents hold lie in blocks of their own, which come last. A block is
held as the XOR of its shingles' hashes. Candidates whose sizes or folded sketches are too far
apart go, the rest are verified on the texts, which are sent compressed.

Each group of classes with an equal block is linked to its least class first (each task
does so with its own, so that of a hot block it sends one row a chunk), then, where a
group is still of several components, to neighbours in a shuffled order; at last the pairs across
the components that are left in a group are verified, large groups in many cells. Components are
thus those of all links, while no group of similar documents is ever expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, documents, fresh, key_bit, key_filter, key_words, lean, passing, ready, salted, shared_folder, stored, tidied
from .components import components
from .shingles import mixed, shingle_set

PERCENT = 80
#: Blocks of a band: so many for each hundred shingles of its largest set, and how many at least.
FILL, LEAST_BLOCKS = 35, 64
#: Shingles met most often (a bounded list) go into the last blocks; it steers the work, not the result.
COMMON, COMMON_LEAST, CHUNK = 50_000, 4, 1_000_000
#: Keys of a chunk, within which equal ones meet before the shuffle.
KEYS = 300_000
#: Classes that a worker remembers so as not to send them twice.
SEEN = 250_000
SKETCH_BITS = 512
PARTS = [f"s{i}" for i in range(SKETCH_BITS // 64)]
#: Members of a cell in which pairs are verified, and pairs of one class that share a copy of its text.
CELL = 256
_SPREAD, _BLOCK = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15)


def bands(longest: int = 1 << 40) -> np.ndarray:
    """Least sizes of the size bands, each about 1.56 times the one before."""
    edges = [1]
    while edges[-1] < longest:
        edges.append(edges[-1] * 25 // 16 + 1)
    return np.array(edges, dtype=np.int64)


EDGES = bands()


def farthest(a: int, b: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of linked sets of these sizes."""
    return (a + b) * (100 - percent) // (100 + percent)


def block_keys(s: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Keys of the blocks under which a set is joined, for its own band and as a larger visitor of the one before."""
    n = len(s)
    band = int(np.searchsorted(EDGES, n, side="right")) - 1
    late = np.zeros(n, dtype=np.uint64)
    if len(common):
        late = (common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s).astype(np.uint64)
    spread, value, keys = mixed(s ^ _SPREAD), mixed(s), []
    largest = n * 100 // percent
    for k in (band, band - 1):
        if k < 0:
            continue
        top = int(EDGES[k + 1]) - 1  # the largest set of the band
        if k < band and n > top * 100 // percent:
            continue
        d = farthest(n, largest if k == band else min(top, largest), percent)
        block = spread % np.uint64(max(LEAST_BLOCKS, top * FILL // 100)) | late << np.uint64(63)
        order = np.argsort(block, kind="stable")
        block, own = block[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        parity = np.bitwise_xor.reduceat(own, first)
        keys.append(mixed(parity[: d + 1] + mixed(block[first][: d + 1] * _BLOCK + np.uint64(k))))
        if len(first) <= d:
            keys.append(mixed(np.array([k], dtype=np.uint64) - _SPREAD))
    return np.concatenate(keys)


def folded(s: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """The parity sketch folded to a power of two of bits."""
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide(s: np.ndarray) -> np.ndarray | None:
    """The parity sketch of a set of over 512 shingles, as words, folded to about a bit for each: the 512 bits fill up there."""
    return np.frombuffer(folded(s, 1 << (len(s) - 1).bit_length()), dtype="<i8") if len(s) > SKETCH_BITS else None


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _sketched(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, n, class, sketch, wide), and of shingles that recur (token, times)."""
    names = ["doc_id", "text_hash", "n", "class", *PARTS, "wide", "token", "times"]
    types = [pa.int64()] * (4 + len(PARTS)) + [pa.list_(pa.int64()), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: list[np.ndarray] = []
        size, seen = 0, set()

        def made(count: int, **columns: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(count, t) for c, t in zip(names, types, strict=True)], names=names)

        def recurring() -> pa.RecordBatch:
            token, times = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = times >= COMMON_LEAST
            return made(int(keep.sum()), token=token[keep].view(np.int64), times=times[keep])

        for batch in batches:
            sets = [shingle_set(t) for t in batch["text"].to_pylist()]
            classes = [class_of(s) if len(s) else None for s in sets]
            sketch = np.frombuffer(b"".join(folded(s) for s in sets), dtype="<i8").reshape(len(sets), len(PARTS))
            parts = {c: sketch[:, i] for i, c in enumerate(PARTS)}
            yield made(len(sets), doc_id=batch["doc_id"], text_hash=batch["text_hash"], n=[len(s) for s in sets], **{"class": classes}, **parts, wide=[wide(s) for s in sets])
            for s, c in zip(sets, classes, strict=True):
                if c is not None and c not in seen:
                    seen.add(c)
                    held.append(s)
                    size += len(s)
            if size > CHUNK:
                yield recurring()
                held, size, seen = [], 0, set()
        yield recurring()

    return docs.mapInArrow(tidied(run), f"doc_id long, text_hash long, n long, class long, {', '.join(f'{c} long' for c in PARTS)}, wide array<long>, token long, times long")


def _blocks(docs: DataFrame, common: np.ndarray, percent: int) -> DataFrame:
    """key, class; of a key's classes in one chunk only the least has the key itself, the others have one of their own and in `of` the key and the least."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # at most COMMON hashes

    def dealt(keys: list[np.ndarray], classes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
        c = np.concatenate(classes) if classes else np.zeros(0, np.int64)
        order = np.lexsort((c, k))
        k, c = k[order], c[order]
        first = np.concatenate([[True], k[1:] != k[:-1]])[: len(k)]
        least = c[np.flatnonzero(first)][np.cumsum(first) - 1] if len(k) else c
        yield pa.RecordBatch.from_arrays([pa.array(k[first]), pa.array(c[first]), pa.nulls(int(first.sum()), pa.list_(pa.int64()))], names=["key", "class", "of"])
        k, c, least = (x[~first & (c != least)] for x in (k, c, least))
        own = mixed(mixed(k.view(np.uint64)) + c.view(np.uint64)).view(np.int64)
        of = pa.ListArray.from_arrays(np.arange(0, 2 * len(k) + 1, 2, dtype=np.int32), np.stack([k, least], axis=1).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(c), of], names=["key", "class", "of"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        seen: set[int] = set()
        keys, classes, size = [], [], 0
        for batch in batches:
            for text in batch["text"].to_pylist():
                s = shingle_set(text)
                if not len(s) or (c := class_of(s)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(c)
                keys.append(block_keys(s, shared.value, percent))
                classes.append(np.full(len(keys[-1]), c, dtype=np.int64))
                size += len(keys[-1])
            if size > KEYS:
                yield from dealt(keys, classes)
                keys, classes, size = [], [], 0
        yield from dealt(keys, classes)

    return docs.select("text").mapInArrow(tidied(run), "key long, class long, of array<long>")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, packed (the words, compressed) of the documents whose id is in wanted, and of a few others that its fixed-size filter lets pass."""
    shared = key_filter(wanted.select(F.xxhash64("doc_id").alias("key")), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, seen = zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            classes, packed = [], []
            for t in batch["text"].filter(pa.array(passing(shared, batch["key"]))).to_pylist():
                s = shingle_set(t)
                if len(s) and (c := class_of(s)) not in seen:
                    if len(seen) < SEEN:
                        seen.add(c)
                    classes.append(c)
                    packed.append(press.compress(t.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(packed, pa.binary())], names=["class", "packed"])

    return docs.select(F.xxhash64("doc_id").alias("key"), "text").mapInArrow(tidied(run), "class long, packed binary")


def _near(a: str, b: str, percent: int) -> Column:
    """By size and by the folded sketches, whose Hamming distance is at most the sets' difference."""
    apart = sum((F.bit_count(F.col(f"{a}{c}").bitwiseXOR(F.col(f"{b}{c}"))) for c in PARTS), F.lit(0))
    return _like(f"{a}n", f"{b}n", percent) & ((100 + percent) * apart <= (100 - percent) * (F.col(f"{a}n") + F.col(f"{b}n")))


def _like(n_a: str, n_b: str, percent: int) -> Column:
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def _side(classes: DataFrame, side: str) -> DataFrame:
    return classes.select(*[F.col(c).alias(side + c) for c in ("n", *PARTS, "rep")], F.col("class").alias(side[0]))


def _wide_near(percent: int) -> Column:
    """By the wide sketches, of which the longer one, at most twice as long for sets near in size, is folded once more."""
    words = F.least(F.size("a_wide"), F.size("b_wide"))

    def fold(c: str) -> Column:
        halves = F.zip_with(F.slice(c, 1, words), F.slice(c, words + 1, words), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(c) == words, F.col(c)).otherwise(halves)

    apart = F.aggregate(F.zip_with(fold("a_wide"), fold("b_wide"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    return (100 + percent) * apart <= (100 - percent) * (F.col("a_n") + F.col("b_n"))


def _bounded(classes: DataFrame, wides: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that may link by their sizes and folded sketches."""
    near = pairs.join(_side(classes, "a_"), "a").join(_side(classes, "b_"), "b").where(_near("a_", "b_", percent))
    near = stored(near.select("a", "b", "a_n", "b_n", "a_rep", "b_rep"))
    long = near.where(F.least("a_n", "b_n") > SKETCH_BITS)
    for side in "ab":
        long = long.join(wides.select(F.col("class").alias(side), F.col("wide").alias(f"{side}_wide")), side)
    long = long.where(_wide_near(percent)).select(*near.columns)
    return stored(near.where(F.least("a_n", "b_n") <= SKETCH_BITS).unionByName(long))


def _linked(near: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs that link by their texts' shingles. Only classes of these pairs send their texts; b's goes to a's, of which there is a copy for each CELL pairs."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    wanted = near.select(F.col("a_rep").alias("doc_id")).union(near.select("b_rep")).distinct()
    texts = stored(_texts(docs, wanted), folder)
    cells = near.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("cells"))
    pairs = near.select("a", "b").join(cells, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("cells")).alias("cell"))
    pairs = pairs.join(texts.select(F.col("class").alias("b"), F.col("packed").alias("y")).hint("merge"), "b")
    hubs = texts.join(cells, F.col("class") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("cell"), F.col("packed").alias("x"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press, hub, own = zstandard.ZstdDecompressor(), None, np.zeros(0, np.uint64)
        for batch in batches:
            hits = []
            for i, (a, x, y) in enumerate(zip(batch["a"].to_pylist(), batch["x"], batch["y"], strict=True)):
                if a != hub:
                    hub, own = a, shingle_set(press.decompress(x.as_py()).decode())
                other = shingle_set(press.decompress(y.as_py()).decode())
                same = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * same >= percent * (len(own) + len(other) - same):
                    hits.append(i)
            yield batch.select(["a", "b"]).take(pa.array(hits, pa.int64()))

    both = pairs.hint("merge").join(hubs.hint("merge"), ["a", "cell"]).select("a", "b", "x", "y")
    found = stored(both.mapInArrow(tidied(verified), "a long, b long").distinct())
    discard(spark, folder)
    return found


def _still_mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of members (key, class, n) with their components, of the groups that hold several."""
    labelled = members.join(labels, F.col("class") == F.col("node"), "left").select(*members.columns, F.coalesce("component", "class").alias("component"))
    several = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).where(F.col("lo") != F.col("hi"))
    return stored(labelled.join(several.select("key", "size"), "key"))


def _across(groups: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a < b) of a group's classes of different components that may link by size and sketch; a group of more than CELL meets in many cells."""
    parts = F.ceil(F.col("size") / CELL).cast("int")
    mine = F.pmod(F.xxhash64("class"), parts).cast("int")
    every = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j")))
    dealt = groups.join(classes.select("class", *PARTS), "class").select("key", "class", "n", "component", *PARTS, mine.alias("mine"), F.explode(every).alias("cell"))
    one, two = (dealt.select("key", "cell", *[F.col(c).alias(f"{side}_{c}") for c in ("n", "component", "mine", *PARTS)], F.col("class").alias(side)) for side in "ab")
    met = (F.col("a_component") != F.col("b_component")) & (F.col("a") < F.col("b")) & _near("a_", "b_", percent)
    once = ((F.col("a_mine") == F.col("cell.i")) & (F.col("b_mine") == F.col("cell.j"))) | ((F.col("a_mine") == F.col("cell.j")) & (F.col("b_mine") == F.col("cell.i")))
    return one.join(two, ["key", "cell"]).where(met & once).select("a", "b").distinct()


def classified(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n, root (the component's least class; null without shingles) and least (its least doc_id) of every row of docs (doc_id, text)."""
    spark = ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = stored(_sketched(docs.withColumn("text_hash", F.xxhash64("text"))))
    often = sketched.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("times").alias("times"))
    common = np.array([r.token for r in often.orderBy(F.desc("times"), "token").limit(COMMON).collect()], dtype=np.int64)
    rows = sketched.where(F.col("n").isNotNull())
    shingled = rows.where(F.col("class").isNotNull())
    classes = stored(shingled.groupBy("class").agg(*[F.max(c).alias(c) for c in ("n", *PARTS)], F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")))
    wides = stored(shingled.where(F.col("wide").isNotNull()).select("class", "wide").groupBy("class").agg(F.any_value("wide").alias("wide")))
    found = _blocks(docs, np.sort(common.view(np.uint64)), percent)
    found = found.withColumn("least", F.min("class").over(Window.partitionBy("key")))
    dealt = F.col("of").isNotNull()
    members = found.where(dealt | (F.col("class") != F.col("least")))
    members = members.select(F.when(dealt, F.col("of")[0]).otherwise(F.col("key")).alias("key"), "class", F.when(dealt, F.col("of")[1]).otherwise(F.col("least")).alias("hub"))
    members = stored(members)
    links = _linked(_bounded(classes, wides, members.select(F.col("hub").alias("a"), F.col("class").alias("b")).distinct(), percent), docs, percent)
    labels = components(links)
    everyone = members.select("key", "class").union(members.select("key", "hub")).distinct().join(classes.select("class", "n"), "class")
    groups = _still_mixed(everyone, labels)
    order = Window.partitionBy("key").orderBy(F.xxhash64("class"), "class")
    beside = groups.select(F.col("class").alias("x"), F.col("component").alias("x_c"), F.lag("class").over(order).alias("y"), F.lag("component").over(order).alias("y_c"))
    beside = beside.where(F.col("x_c") != F.col("y_c")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    for last in (False, True):  # neighbours in a shuffled order: as many pairs as members, yet they join most of what can be joined; then what is left
        more = _linked(_bounded(classes, wides, _across(groups, classes, percent) if last else beside, percent), docs, percent)
        if more.limit(1).count():
            links = stored(links.union(more))
            labels = components(links)
            if not last:
                groups = _still_mixed(groups.select("key", "class", "n"), labels)
    linked = F.col("node").isNotNull()
    of = classes.select(F.col("class").alias("c"), "rep", "rows").join(labels, F.col("c") == F.col("node"), "left").where(linked | (F.col("rows") > 1))
    of = stored(of.select("c", F.coalesce("component", "c").alias("root"), "rep"))
    least = of.groupBy("root").agg(F.min("rep").alias("least"))
    of = salted(of, least, "root").select("c", "root", "least")
    out = salted(rows.select("doc_id", "text_hash", "n", F.col("class").alias("c")), of, "c", "left")
    return out.select("doc_id", "text_hash", "n", F.coalesce("root", "c").alias("root"), F.coalesce("least", "doc_id").alias("least"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) of every row of docs (doc_id, text).

    Null text, and text without words, has no shingles and links with nothing: its own component. Very
    long texts are whole sets like any other; equal texts are one class, ties play no part. Rows
    that repeat an id are documents of their own; a null id is not the least of any component but its
    own. An empty table gives no rows; other columns are not read.
    """
    return classified(docs, percent).select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without those that another makes redundant: of each component the row of least id stays (nulls last, then by the text's hash).

    Of rows equal in id and text one stays. Rows without words all stay. Only the rows that go, and a few
    that a bit table of fixed size takes for such, are joined back, by id and text: the other texts are not
    shuffled. Columns of any names are kept as they are; an empty table stays empty.
    """
    d = stored(classified(docs, percent).where(F.col("root").isNotNull()).select("doc_id", "text_hash", "root"))
    place = F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "text_hash")
    kept = d.groupBy("root").agg(F.min(place).alias("keeper"), F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    d = stored(salted(d, kept, "root").select("doc_id", "text_hash", place.eqNullSafe(F.col("keeper")).alias("stays")))
    own = [fresh(docs, c) for c in ("id_of", "hash_of")]
    key = F.col("doc_id").cast("long").eqNullSafe(F.col(own[0])) & (F.xxhash64(F.col("text").cast("string")) == F.col(own[1]))
    named = lambda x: x.select(F.col("doc_id").alias(own[0]), F.col("text_hash").alias(own[1]))
    gone = stored(named(d.where(~F.col("stays")).distinct()))
    bits = [fresh(docs, c) for c in ("word_of", "bits_of")]
    table = key_words(gone.select(F.xxhash64(*own).alias("key")), "key").toDF(*bits)
    word, bit = key_bit(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))
    marked = docs.join(F.broadcast(table), word == F.col(bits[0]), "left")
    hit = F.coalesce(F.col(bits[1]).bitwiseAND(bit) != 0, F.lit(False))
    left = marked.where(~hit).drop(*bits).union(marked.where(hit).drop(*bits).join(gone, key, "left_anti"))
    repeated = stored(named(d.where("stays").groupBy("doc_id", "text_hash").count().where("count > 1")))
    if repeated.limit(1).count():
        again = left.join(repeated, key, "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(repeated, key, "left_anti").unionByName(again)
    return left


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents; nulls, empty and long texts, ties and repeated rows as in near_duplicates."""
    return near_duplicates(documents(spark, sf_dir))
