"""Groups of documents whose word sets are similar, by bottom-k sketches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.bodies import body
from corpuslens.sources.tables import checked_broadcast, checkpointed, shuffle_partitions, spread

#: Retained values of a sketch.
K = 128
#: Sketches whose values are counted for the order of all values; any order gives the same pairs, one by frequency the shortest lists.
SAMPLE = 8192
#: Standard deviations below the threshold at which an estimate rejects a pair.
SLACK = 3.7
#: Members of a part of an inverted list; a longer one is split, and each two of its parts meet in a task of their own.
PART = 4096
#: Words of 64 bits of sign; two go with every key, the others with keys that are frequent.
SIGNS = 8
#: Members up to which a class of exact copies comes out as all its pairs; of larger ones, each member with the first.
WHOLE_CLASS = 16

_WORD = re.compile(r"[^\W_]+")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Shingles:
    """64-bit values of the distinct runs of `words` neighbouring words of a text, sorted."""

    def __init__(self, words: int) -> None:
        self.words, self.known = words, {}

    def __call__(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        n = len(words) - self.words + 1
        if n < 1:
            return np.empty(0, np.uint64)
        if len(self.known) > 400_000:
            self.known.clear()
        known = self.known
        values = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            v = known.get(w)
            if v is None:
                v = known[w] = xxhash.xxh64_intdigest(w)
            values[i] = v
        mixed = values[:n].copy()
        for k in range(1, self.words):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _M1 + values[k : k + n]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _M2
        return np.unique(mixed ^ (mixed >> np.uint64(28)))


def _signed(values: np.ndarray) -> np.ndarray:
    return (values ^ np.uint64(1 << 63)).view(np.int64)  # keeps the order


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)])))


def _signs(values: np.ndarray) -> np.ndarray:
    """SIGNS words of bits whose agreement tells the angle between two sets."""
    mixed = np.empty((len(values), SIGNS), np.uint64)
    v = values
    for k in range(SIGNS):
        mixed[:, k] = v
        v = (v ^ (v >> np.uint64(32))) * _M1
    bits = np.unpackbits(mixed.view(np.uint8), axis=1).sum(0, dtype=np.uint32) * 2 >= len(values)
    return np.packbits(bits).view(np.int64)


def _sketched(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingles(words)
        for batch in batches:
            sets = [shingles(t or "") for t in batch.column("text").to_pylist()]
            signs = [_signs(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("path"),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([s[0] for s in signs], pa.int64()),
                    pa.array([s[1] for s in signs], pa.int64()),
                    pa.array([s[2:].tobytes() for s in signs], pa.binary()),
                    _lists([_signed(s[:k]) for s in sets]),
                ],
                names=["path", "print", "n", "sign1", "sign2", "signs", "sketch"],
            )

    return run


def _least(threshold: float, k: int) -> float:
    """Share of the union's sketch under which a pair is rejected."""
    return threshold - SLACK * (threshold * (1 - threshold) / k) ** 0.5


def _differ(threshold: float, bits: int, few: bool, exact: bool) -> int:
    """How many of so many bits may differ: the cosine of two sets at the threshold is least for equal sizes; of `few` values up to a quarter of the bits differ."""
    if exact:
        return bits
    cosine = 2 * threshold / (1 + threshold)
    p = max(np.arccos(cosine) / np.pi, 0.25 * few)
    return int(bits * p + SLACK * (bits * p * (1 - p)) ** 0.5)


def _reach(n: np.ndarray, threshold: float, k: int) -> np.ndarray:
    """How many values of a sketch, in any one order of all values, hold one that each similar sketch has among so many of its own.

    Sketches that share m values share one of the first (size - m + 1) of either. Sets of up to threshold * k values are whole
    in their sketch, and so are similar ones, and share at least the threshold of their own; other pairs share `_least` of the union's
    sketch, which is no smaller than either.
    """
    size = np.minimum(n, k)
    need = np.where(n <= threshold * k, np.ceil(threshold * n - 1e-9), np.ceil(_least(threshold, k) * size - 1e-9))
    return (size - np.maximum(need, 1) + 1).astype(np.int64)


def _frequent(sketch: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Values that at least two of about `most` sketches hold, sorted, in how many of them, and the share of all sketches that these are."""
    share = most / max(1, sketch.count())
    some = sketch if share >= 1 else sketch.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    values, counts = np.unique(some.select("sketch").toArrow().column("sketch").combine_chunks().flatten().to_numpy(), return_counts=True)
    return values[counts > 1], counts[counts > 1], min(1.0, share)


def _parted(values: np.ndarray, rows: np.ndarray, ids: np.ndarray, members: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists longer than `part` as one list for each two of their parts: (values, rows, index of the row before). A member goes to all lists of its part."""
    parts = np.maximum(1, -(-members // part)).astype(np.int64)
    which = np.repeat(np.arange(len(values)), parts)
    mine = (ids[which].view(np.uint64) * _M1 >> np.uint64(33)).astype(np.int64) % parts[which]
    other = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    cell = (np.minimum(mine, other) * 0x10001 + np.maximum(mine, other)).astype(np.uint64)
    mixed = (values[which].view(np.uint64) ^ cell * _M2) * _M1
    return np.where(parts[which] > 1, (mixed ^ mixed >> np.uint64(31)).view(np.int64), values[which]), rows[which], which


def _keys(shared, threshold: float, k: int, part: int = PART):
    """`key, id, n, sign1, sign2, signs`: of each sketch the values that `_reach` asks for, the rarest first; signs is null for rare ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts, share = shared.value
        for batch in batches:
            values = batch.column("sketch").flatten().to_numpy()
            sizes = batch.column("sketch").value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            often = np.zeros(len(values), np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
                often = np.where(frequent[at] == values, counts[at], 0)
            place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            order = np.lexsort((values, often, owner))[place < _reach(batch.column("n").to_numpy(), threshold, k)[owner]]
            keys, rows, which = _parted(values[order], owner[order], batch.column("id").to_numpy()[owner[order]], often[order] / share, part)
            signs = batch.column("signs").take(pa.array(rows, mask=often[order][which] == 0))
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(batch.column(c).to_numpy()[rows]) for c in ("id", "n", "sign1", "sign2")), signs], names=["key", "id", "n", "sign1", "sign2", "signs"])

    return run


def _pairs(threshold: float, k: int, exact: bool, block: int = 64, wide: int = 4096):
    """Pairs of the ids of each inverted list that sizes and signs don't reject; keys come sorted. No list is too long."""
    few = threshold * k
    first, other = (np.array([_differ(threshold, bits, x, exact) for x in (False, True)], np.int64) for bits in (128, 64 * (SIGNS - 2)))
    blank = bytes(8 * (SIGNS - 2))

    def likely(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> np.ndarray:
        off = np.bitwise_count(x[2] ^ y[2]) + np.bitwise_count(x[3] ^ y[3])
        small = (x[1] <= few) | (y[1] <= few)
        return (off <= first[small.astype(np.int8)]) & (x[1] >= threshold * y[1]) & (y[1] >= threshold * x[1]) & (x[0] != y[0])

    def close(own: tuple[np.ndarray, ...], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        off = np.bitwise_count(own[4][a] ^ own[4][b]).sum(1)
        keep = off <= other[((own[1][a] <= few) | (own[1][b] <= few)).astype(np.int8)]
        return own[0][a[keep]], own[0][b[keep]]

    def of_long(own: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = len(own[0])
        for i in range(0, size, block):
            x = tuple(c[i : i + block, None] for c in own[:4])
            for j in range(i, size, wide):
                y = tuple(c[None, j : j + wide] for c in own[:4])
                a, b = np.nonzero(likely(x, y))
                later = b + j > a + i
                yield close(own, a[later] + i, b[later] + j)

    def finished(keys: np.ndarray, columns: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        out, held = [], 0
        for at, size in zip(starts[sizes > 64], sizes[sizes > 64]):
            for pair in of_long(tuple(c[at : at + size] for c in columns)):
                out.append(pair)
                held += len(pair[0])
                if held > 1_000_000:
                    yield _pair_batch(out)
                    out, held = [], 0
        short = np.repeat(sizes <= 64, sizes)
        keys, columns = keys[short], tuple(c[short] for c in columns)
        for d in range(1, 64):
            same = np.flatnonzero(keys[d:] == keys[:-d]) if len(keys) > d else []
            if not len(same):
                break
            same = same[likely(tuple(c[same] for c in columns[:4]), tuple(c[same + d] for c in columns[:4]))]
            out.append(close(columns, same, same + d))
        if out:
            yield _pair_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the last list may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = pc.fill_null(batch.column("signs"), blank).cast(pa.binary(len(blank)))
            signs = np.frombuffer(signs.buffers()[1], np.uint64)[signs.offset * (SIGNS - 2) :][: len(signs) * (SIGNS - 2)].reshape(-1, SIGNS - 2)
            new = [batch.column(c).to_numpy() for c in ("key", "id", "n")] + [batch.column(c).to_numpy().view(np.uint64) for c in ("sign1", "sign2")] + [signs]
            if held and held[0][0][0] == new[0][-1]:
                held.append(new)
                continue
            keys, *columns = (np.concatenate(c) for c in zip(*held, new))
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from finished(keys[:cut], tuple(c[:cut] for c in columns))
            held = [[c[cut:] for c in (keys, *columns)]]
        if held:
            keys, *columns = (np.concatenate(c) for c in zip(*held))
            yield from finished(keys, tuple(columns))

    return run


def _pair_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = map(np.concatenate, zip(*found))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def _similarities(words: int):
    """`a, b, similarity` of pairs with their texts, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingles(words)
        for batch in batches:
            found = []
            for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                a, b = shingles(a), shingles(b)
                both = len(np.intersect1d(a, b, assume_unique=True))
                found.append(both / max(1, len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return run


def _text(docs: DataFrame) -> DataFrame:
    return docs.where("path IS NOT NULL").select("path", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce(body(), F.lit(""))).alias("text"))


def sketches(docs: DataFrame, words: int = 3, k: int = K) -> DataFrame:
    """`id, path, print, n, sketch` of every row with a path: the k smallest values of its set, and its size."""
    made = spread(_text(docs)).mapInArrow(_sketched(words, k), "path string, print binary, n int, sign1 long, sign2 long, signs binary, sketch array<long>")
    return checkpointed(made.withColumn("id", F.monotonically_increasing_id()))


def similar_classes(docs: DataFrame, threshold: float = 0.6, words: int = 3, k: int = K, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Links between classes of exact copies, and the classes' members.

    links: `a, b, similarity` (a < b), pairs of classes whose sets of `words` neighbouring words share at least
    `threshold` of their union. members: `class, path`, one row for each different path; texts without such a run
    of words are in no class. Exact copies (equal sets) are one class, however many they are.

    Each set is sketched by its k smallest values under one hash function. Sketches of similar sets share so many values
    that one is among the first of both in any one order of all values; the rarest come first, and the inverted lists of these
    values give candidates. No list is left out for its length, and sets of few values are found like others. Pairs of a list are
    rejected by size and by 512 bits of sign before they leave it, then estimated by the union's sketch, and the rest is checked
    on whole sets. Sign and estimate reject at SLACK deviations: at the threshold itself about one pair in 10,000 each, fewer above.
    With `exact` whole sets take the place of sketches and neither rejects anything, so that no pair is lost, at the price of far more
    values. A list longer than PART members, as the sample tells, is split, and each two of its parts meet in a list of their own.
    """
    k = 1 << 30 if exact else k
    sketch = sketches(docs, words, k)
    partitions = shuffle_partitions(docs.sparkSession)
    narrow = max(1, partitions // 4)  # of ids and paths only
    kept = sketch.where("n > 0").groupBy("print", "path").agg(F.min("id").alias("id"))
    first = kept.groupBy("print").agg(F.min("id").alias("class"))
    members = checkpointed(kept.join(first, "print").select("class", "path", "id").coalesce(narrow))
    # further copies of a class, and rows delivered twice, have the same sketch
    firsts = members.select("class").distinct().withColumnRenamed("class", "id")
    others = sketch.select("id").join(firsts, "id", "left_anti")
    unique = sketch.where("n > 0").join(checked_broadcast(others), "id", "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(sketch))  # at most K * SAMPLE / 2 values
    keys = unique.select("id", "n", "sign1", "sign2", "signs", "sketch").mapInArrow(_keys(shared, threshold, k), "key long, id long, n int, sign1 long, sign2 long, signs binary")
    sorted_keys = keys.repartition(partitions, "key").sortWithinPartitions("key")
    near = checkpointed(sorted_keys.mapInArrow(_pairs(threshold, k, exact), "a long, b long").distinct().coalesce(narrow))
    # sketches and texts are moved of the documents in these pairs only
    ids = checked_broadcast(near.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    left, right = (sketch.select("id", "sketch").join(ids, "id", "left_semi").select(F.col("id").alias(x), F.col("sketch").alias(f"s_{x}")) for x in "ab")
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    both = F.size(F.array_intersect(F.array_intersect("s_a", "s_b"), union))
    least = _least(threshold, k)
    likely = near if exact else near.join(left, "a").join(right, "b").where(both >= least * F.size(union)).select("a", "b")  # the union sketch's share of shared values
    paths = checked_broadcast(sketch.select("id", F.col("path").alias("_path")).join(ids, "id", "left_semi"))
    texts = _text(docs).join(paths, F.col("path") == F.col("_path")).groupBy("id").agg(F.max("text").alias("text"))
    left, right = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    links = likely.join(left, "a").join(right, "b").mapInArrow(_similarities(words), "a long, b long, similarity double")
    return links.where(F.col("similarity") >= threshold), members.select("class", "path")


def similar_pairs(docs: DataFrame, threshold: float = 0.6, words: int = 3, exact: bool = False, whole_class: int = WHOLE_CLASS) -> DataFrame:
    """Pairs of different paths whose sets share at least `threshold` of their union: `path_a, path_b`, path_a < path_b.

    The words are the maximal runs of letters and digits of title (null as empty), a blank and the body,
    lower-cased. Null content is an empty body; texts with fewer than `words` words are in no pair. Of rows with
    one path the texts count as one document's. Classes of exact copies with more than `whole_class` members
    are given as links of each member with the first path, and link to other classes by the first path only; members has the classes.
    """
    links, members = similar_classes(docs, threshold, words, exact=exact)
    sizes = members.groupBy("class").agg(F.count("*").alias("size"), F.min("path").alias("first"))
    spread = members.join(sizes.where("size > 1"), "class", "inner")
    other = members.select("class", F.col("path").alias("path_b"))
    few, many = spread.where(F.col("size") <= whole_class), spread.where(F.col("size") > whole_class)
    copies = few.join(other, "class").select(F.col("path").alias("path_a"), "path_b").where("path_a < path_b").unionByName(many.select(F.col("first").alias("path_a"), F.col("path").alias("path_b")).where("path_a < path_b"))
    ends = members.join(sizes, "class").where((F.col("size") <= whole_class) | (F.col("path") == F.col("first"))).select("class", "path")
    a, b = (ends.select(F.col("class").alias(x), F.col("path").alias(f"_{x}")) for x in "ab")
    between = links.join(a, "a").join(b, "b").where("_a <> _b").select(F.least("_a", "_b").alias("path_a"), F.greatest("_a", "_b").alias("path_b"))
    return copies.unionByName(between).distinct()


def members(docs: DataFrame, words: int = 3) -> DataFrame:
    """Classes of exact copies (equal sets), whatever their size: `path, first, size`, first being the class's first path."""
    each = spread(_text(docs)).mapInArrow(_sketched(words, 1), "path string, print binary, n int, sign1 long, sign2 long, signs binary, sketch array<long>").where("n > 0").select("path", "print").distinct()
    each = checkpointed(each)
    firsts = each.groupBy("print").agg(F.min("path").alias("first"), F.count("*").alias("size"))
    return each.join(firsts, "print").groupBy("path").agg(F.min(F.struct("first", "size")).alias("x")).select("path", "x.first", "x.size")


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each path: `path, group, links`.

    group is the smallest path that links reach from the path's class, so groups are connected components; links is the
    number of other classes that the path's class is linked with. Each round takes the least id among a
    class and its neighbours, then follows it one step on, so chains shorten by half; every round is written out, and they
    go on until nothing changes, which a finite number of classes is sure to reach.
    """
    links = checkpointed(links.select("a", "b"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = checkpointed(both.groupBy("a").agg(F.least("a", F.min("b")).alias("g")))
    while True:
        near = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("g").alias("low"))
        step = label.join(near, "a").select("a", F.least("g", "low").alias("g2"), "g")
        jump = step.select(F.col("a").alias("g2"), F.col("g2").alias("g3"))
        after = checkpointed(step.join(jump, "g2", "left").select("a", F.least("g2", F.coalesce("g3", "g2")).alias("g"), F.col("g").alias("old")))
        label = after.select("a", "g")
        if after.where("g <> old").isEmpty():
            break
    degree = both.groupBy("a").agg(F.count("*").alias("links"))
    named = members.join(label.withColumnRenamed("a", "class"), "class", "left").join(degree.withColumnRenamed("a", "class"), "class", "left")
    named = named.select("path", F.coalesce("g", "class").alias("g"), F.coalesce("links", F.lit(0)).alias("links"))
    return named.join(named.groupBy("g").agg(F.min("path").alias("group")), "g").select("path", "group", "links")
