"""Exact Jaccard join of documents on word n-grams: a size-aware heavy-light join, and groups of linked ones.

A document's set is its distinct shingles (64-bit hashes). Documents with equal sets are one class. Two classes
link when 100 * intersection >= percent * union, which bounds the elements in which they differ.

* Light (small) sets: sizes fall into intervals such that linked sets lie in the same or in adjacent ones; a group joins
  two adjacent intervals. Linked sets of a group have at least c elements in common, so every subset of c elements is
  enumerated, and linked sets share one.
* Heavy (large) sets: inverted lists of elements are scanned. Elements are ordered by rarity, counted over all documents
  in a table of fixed size (elements that share an entry are counted together, which changes the order, not
  the result); linked sets share one of their n - ceil(percent * n) + 1 rarest elements, so those are listed.
The boundary is the largest group whose subsets cost no more than its lists would, by the numbers of sets of each size
and the mean length of a list, both counted over all documents. A group in between two sizes decides for both.

Lists are scanned without making all pairs of a group. First each list's members are compared with its most
central one (whose lists are longest), linked ones are joined to components, and only members of different
components that share a list are compared after that: as pairs in lists of up to 8 members, and else within a task,
by sketches, which bound the difference of a pair from below: a list travels as its members, a large one as blocks.
Only for pairs that the sketches allow the sets are made again, from one text of each class, and compared. No candidate is capped. Components come
from one task for a checked number of links, and else from label propagation with pointer jumping over stored tables.

Skew: a task lists each class once, however many copies it holds, so the lists of a hot class have a row a task;
classes are looked up by broadcast of a counted table or by salted joins.

Edge cases: null or empty text has no shingles, links with nothing and is its own component; fewer words than a
shingle make one shingle; repeated rows and ids share a class if their sets are equal; rows without an id link others,
and the component of rows whose ids are all null is null; an empty table gives an empty result; texts may be of any
length; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm import _hashing as H
from reviewlake.llm._shared import MOST_BROADCAST, NULL_ID, discard, looked_up, squeezed, stored, unsqueezed

WORDS, PERCENT = 5, 80
BUCKETS = 256
#: Entries of the table that counts elements, and slices in which it is summed.
ENTRIES, SLICES = 1 << 20, 64
#: Sizes counted for the boundary, and the most subsets of one set.
SMALL, MOST_SUBSETS = 64, 4096
#: A list of more members is compared in blocks of about so many; one of so few as its pairs.
BLOCK, FEW = 1024, 8
#: The most links (16 bytes each) whose components one task finds; more go by label propagation over tables.
MOST_LINKS = 1_000_000
_U64 = np.uint64


class Group:
    """A group of sets whose sizes lie in two adjacent intervals, from `low` to `high`."""

    def __init__(self, number: int, low: int, high: int, percent: int):
        self.number, self.low, self.high = number, low, high
        # What two different sets of such sizes share at least if they link; 0 if none can.
        shared = [(x, y, -(-percent * (x + y) // (100 + percent))) for x in range(low, high + 1) for y in range(x, min(high, x * 100 // percent) + 1)]
        self.common = min((t for x, y, t in shared if t <= x - (x == y)), default=0)

    def subsets(self, size: int) -> int:
        return comb(size, self.common) if self.common else 0


@lru_cache(maxsize=8)
def intervals(percent: int) -> tuple[list[int], list[Group]]:
    """Starts of the size intervals up to SMALL, and groups: a set in interval i is in the groups i and i + 1."""
    starts, low = [1], 1
    while low <= SMALL:
        low = low * 100 // percent + 1
        starts.append(low)
    ends = [low - 1 for low in starts[1:]]
    return starts, [Group(k, starts[max(k - 1, 0)], end, percent) for k, end in enumerate(ends)]


def prefix(sizes: np.ndarray, percent: int) -> np.ndarray:
    """The elements that a set lists."""
    return sizes - -(-percent * sizes // 100) + (sizes > 0)


def light_groups(percent: int, sizes: np.ndarray, length: float) -> int:
    """How many groups, from the smallest sets on, are light, from the numbers of sets by size and the mean length of a list."""
    light = 0
    for group in intervals(percent)[1]:
        n = np.arange(group.low, min(group.high, SMALL) + 1)
        subsets = sum(int(sizes[k]) * group.subsets(int(k)) for k in n)
        if group.high > SMALL or group.subsets(group.high) > MOST_SUBSETS or subsets > (sizes[n] * prefix(n, percent)).sum() * max(1.0, length):
            break
        light += 1
    return light


def boundary(percent: int, light: int) -> int:
    """The largest set size of which only subsets are enumerated."""
    return intervals(percent)[0][light - 1] - 1 if light else 0


def _count(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sizes = np.zeros(ENTRIES, np.int64), np.zeros(SMALL + 2, np.int64)
        for batch in batches:
            for first, end, of, hashes in H.words(batch.column("text")):
                table += np.bincount((H.windows(of, hashes, size)[1] % _U64(ENTRIES)).astype(np.int64), minlength=ENTRIES)
                counts = np.bincount(of, minlength=end - first)
                sizes += np.bincount(np.clip(np.where(counts > 0, np.maximum(counts - size + 1, 1), 0), 0, SMALL + 1), minlength=SMALL + 2)
        parts = [*table.reshape(SLICES, -1), sizes]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES + 1)), pa.array([squeezed(x.tobytes()) for x in parts], pa.binary())], ["slice", "counts"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, total = None, np.zeros(0, np.int64)
    for batch in batches:
        for slice_, blob in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            counts = np.frombuffer(unsqueezed(blob), np.int64)
            if slice_ != held and held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])
            held, total = slice_, counts if slice_ != held else total + counts
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["slice", "counts"])


def frequencies(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences by entry of the elements' table, and documents by number of shingles (the last entry: all above SMALL)."""
    parts = docs.select("text").mapInArrow(_count(size), "slice long, counts binary").repartition(SLICES + 1, "slice").sortWithinPartitions("slice")
    rows = parts.mapInArrow(_add, "slice long, counts binary").collect()  # SLICES + 1 rows, 8 MB in all
    table, sizes = np.zeros((SLICES, ENTRIES // SLICES), np.int64), np.zeros(SMALL + 2, np.int64)
    for row in rows:
        if row["slice"] < SLICES:
            table[row["slice"]] = np.frombuffer(row["counts"], np.int64)
        else:
            sizes = np.frombuffer(row["counts"], np.int64)
    return table.reshape(-1), sizes


def list_length(table: np.ndarray) -> float:
    """The mean length of the list that an occurrence is in, without what shared entries add."""
    total = float(table.sum())
    return (float((table.astype(float) ** 2).sum()) / total - total / len(table)) if total else 0.0


def _keys(at: np.ndarray, found: np.ndarray, sizes: np.ndarray, percent: int, light: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the listed elements and subsets of the rows' sets, in the order of rows."""
    starts, groups = intervals(percent)
    interval = np.searchsorted(np.array(starts), np.maximum(sizes, 1), "right") - 1
    heavy = interval + 1 >= light
    order = np.lexsort((found, table[(found % _U64(ENTRIES)).astype(np.int64)], at))
    listed = at[order]
    place = np.arange(len(at)) - (np.cumsum(sizes) - sizes)[listed]
    use = heavy[listed] & (place < prefix(sizes, percent)[listed])
    rows, keys = [listed[use]], [found[order][use]]
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    spread = H.mix(found ^ _U64(0xA0761D6478BD642F))
    for row in np.flatnonzero((sizes > 0) & (interval < light)):
        mine = spread[firsts[row] : firsts[row + 1]]
        for group in groups[interval[row] : min(interval[row] + 2, light)]:
            left = len(mine) - group.common
            if group.common and left >= 0:
                gone = np.array(list(combinations(range(len(mine)), left)), np.int64).reshape(comb(len(mine), left), left)
                sums = mine.sum(dtype=np.uint64) - mine[gone].sum(axis=1, dtype=np.uint64)
                keys.append(H.mix(sums + H.mix(np.full(1, group.number, _U64) + _U64(1 << 40))))
                rows.append(np.full(len(sums), row))
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(row, kind="stable")
    return row[order], key[order]


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First and end row of a chunk, (row, element) of its sets, their sizes and the signatures of their classes."""
    for first, end, of, hashes in H.words(batch.column("text")):
        with np.errstate(over="ignore"):
            at, found = H.shingles(of, hashes, end - first, size)
            sizes = np.bincount(at, minlength=end - first)
            total = np.zeros(end - first, _U64)
            np.add.at(total, at, H.mix(found))
            yield first, end, at, found, sizes, H.mix(total + sizes.astype(_U64) * _U64(0x9E3779B97F4A7C15)).view(np.int64)


def _lists(size: int, percent: int, light: int, table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first, end, at, found, sizes, sig in _sets(batch, size):
                fresh = _fresh(sig, seen)
                use = fresh[at]
                with np.errstate(over="ignore"):
                    row, key = _keys(at[use], found[use], np.where(fresh, sizes, 0), percent, light, table)
                edges = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=end - first))])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(key.view(np.int64)))
                sketch = sketches(at, found, np.where(fresh, sizes, 0), end - first)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, end - first) for c in ("doc_id", "tie")), pa.array(sizes, pa.int64()), pa.array(sig), lists, sketch], ["doc_id", "tie", "n", "sig", "keys", "sketch"])

    return run


def sketches(at: np.ndarray, found: np.ndarray, sizes: np.ndarray, rows: int) -> pa.Array:
    """The elements of each row's set counted in BUCKETS buckets, modulo 256; null for sets of size 0."""
    table = np.zeros((rows, BUCKETS), np.uint8)
    np.add.at(table, (at, (found & _U64(BUCKETS - 1)).astype(np.int64)), 1)
    return pa.array([x.tobytes() if n else None for x, n in zip(table, sizes.tolist(), strict=True)], pa.binary())


def _fresh(sig: np.ndarray, seen: set[int]) -> np.ndarray:
    """Whether a class is met for the first time."""
    out = np.zeros(len(sig), bool)
    for k, s in enumerate(sig.tolist()):
        out[k] = s not in seen
        seen.add(s)
    return out


def _elements(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first, end, at, found, sizes, sig in _sets(batch, size):
                fresh = _fresh(sig, seen)
                sizes, found = np.where(fresh, sizes, 0), found[fresh[at]]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(sizes, pa.int64()), lists], ["sig", "n", "elements"]).filter(pa.array(fresh))

    return run


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")


def classes(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, tie, n, sig (of its class; of no meaning where n is 0), keys and sketch for each row, stored.

    Keys and sketch are with the first row that a task has of a class.
    """
    table, sizes = frequencies(docs, size)
    light = light_groups(percent, sizes, list_length(table))
    run = _lists(size, percent, light, np.minimum(table, np.iinfo(np.int32).max).astype(np.int32))
    return stored(keyed(docs).select("doc_id", "tie", "text").mapInArrow(run, "doc_id long, tie long, n long, sig long, keys array<long>, sketch binary"), "ngram-sets")


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose sketches don't rule them out: their distance is at most that of the sets."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for n in ("sk_a", "sk_b"))
            gap = np.abs(x - y)
            batch = batch.filter(pa.array(np.minimum(gap, 256 - gap).sum(axis=1) <= batch.column("apart").to_numpy()))
        yield batch.select(["a", "b"])


def _both(pairs: DataFrame, table: DataFrame, what: str) -> DataFrame:
    """pairs (a, b) with n_a, n_b and x, y: what the table has of the classes."""
    one = table.select(F.col("sig").alias("a"), F.col("n").alias("n_a"), F.col(what).alias("x"))
    two = table.select(F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col(what).alias("y"))
    return pairs.join(one, "a").join(two, "b")


def verified(pairs: DataFrame, sketched: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, stored. Sets are made only of the classes in pairs that the sketches allow."""
    sized = _both(pairs, sketched, "sketch").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    total = F.col("n_a") + F.col("n_b")
    apart = total - 2 * F.ceil(percent * total / F.lit(float(100 + percent)) - 1e-9)
    maybe = stored(sized.select("a", "b", F.col("x").alias("sk_a"), F.col("y").alias("sk_b"), apart.alias("apart")).mapInArrow(_within, "a long, b long"), "ngram-maybe")
    sets = _fetched(maybe, docs, sketched, size)
    common = F.size(F.array_intersect("x", "y"))
    links = stored(_both(maybe, sets, "elements").filter(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b"), "ngram-links")
    discard(maybe, sets)
    return links


def _fetched(pairs: DataFrame, docs: DataFrame, sketched: DataFrame, size: int) -> DataFrame:
    """sig, n, elements of the classes in pairs, from the text of one row of each; stored."""
    sigs = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    ids = sketched.join(sigs, "sig", "left_semi").select("doc", "tie")
    only = F.broadcast(ids) if 2 * pairs.count() <= MOST_BROADCAST else ids
    texts = keyed(docs).withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID))).join(only, ["doc", "tie"])
    # A task gives each class once; only copies of a row, with its id, make it twice.
    return stored(texts.select("text").mapInArrow(_elements(size), "sig long, n long, elements array<long>").dropDuplicates(["sig"]), "ngram-elements")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """connected() of all pairs of one task."""
    pairs = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if not pairs:
        return
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = label.copy()
        np.minimum.at(least, label[a], label[b])
        np.minimum.at(least, label[b], label[a])
        least = least[least[label]]
        if (least == label).all():
            break
        label = least
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "label"])


def connected(links: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for the nodes of links (a, b). Up to MOST_LINKS links are taken by one task."""
    if links.count() <= MOST_LINKS:
        return stored(links.select("a", "b").coalesce(1).mapInArrow(_united, "node long, label long"), "labels")
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(edges.distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"), F.lit(True).alias("moved")), "labels")
    while not labels.filter("moved").isEmpty():
        near = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        over = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        last, labels = labels, stored(step.join(over, "label").select("node", "old", F.least("label", "next").alias("label")).select("node", "label", (F.col("label") != F.col("old")).alias("moved")), "labels")
        discard(last)
    discard(edges)
    return labels


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def linked(docs: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """node, label of the classes in `members` that link with another one."""
    dealt = members.filter("n > 0").select("sig", "n", F.explode("keys").alias("key")).repartition("key").distinct()
    lists = stored(dealt.withColumn("c", F.count(F.lit(1)).over(_by("key"))).filter("c > 1"), "ngram-lists")
    sketched = stored(members.filter("sketch IS NOT NULL").select("sig", "n", "sketch", F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "tie").join(lists.select("sig").distinct(), "sig", "left_semi").dropDuplicates(["sig"]), "ngram-sketches")
    # Each list's most central member against the others.
    central = lists.groupBy("sig").agg(F.sum("c").alias("weight"))
    weighed = lists.join(central, "sig")
    hub = weighed.groupBy("key").agg(F.max(F.struct("weight", "sig", "n")).alias("h")).select("key", F.col("h.sig").alias("hub"), F.col("h.n").alias("m"))
    alike = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    star = stored(lists.join(hub, "key").filter("sig <> hub").filter(alike).select(*_ordered(F.col("sig"), F.col("hub"))).distinct(), "ngram-star")
    links = verified(star, sketched, docs, size, percent)
    labels = connected(links)
    # Then, of the lists that still hold several components, the members of different ones. Of two members the pair is done.
    open_ = lists.filter("c > 2").join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").select("key", "sig", "n", "c", F.coalesce("label", "sig").alias("label"))
    spread = open_.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    open_ = stored(open_.join(spread, "key", "left_semi"), "ngram-open")
    discard(lists, labels)
    cross = _few(open_.filter(F.col("c") <= FEW), percent).unionByName(_crossing(open_.filter(F.col("c") > FEW), sketched, percent))
    more = verified(cross.distinct().join(star, ["a", "b"], "left_anti"), sketched, docs, size, percent)
    out = connected(links.unionByName(more))
    discard(open_, star, sketched, links, more)
    return out


def _few(open_: DataFrame, percent: int) -> DataFrame:
    """a, b: members of one short list and of different components whose sizes allow to link."""
    held = open_.groupBy("key").agg(F.collect_list(F.struct("sig", "n", "label")).alias("m")).select(F.col("m"), F.explode("m").alias("x"))
    pairs = held.select("x", F.explode(F.filter("m", lambda y: (y["sig"] > F.col("x.sig")) & (y["label"] != F.col("x.label")) & (100 * F.least(y["n"], F.col("x.n")) >= percent * F.greatest(y["n"], F.col("x.n"))))).alias("y"))
    return pairs.select(F.col("x.sig").alias("a"), F.col("y.sig").alias("b"))


def _crossing(open_: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """a, b: members of one list and of different components that size and sketch allow to link."""
    blocks = open_.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    held = open_.drop("n", "c").join(blocks, "key").join(sketched.select("sig", "n", "sketch"), "sig").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = held.select("key", "sig", "label", "n", "sketch", "block", other).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    dealt = dealt.select("key", "x", "y", "block", "n", "sig", "label", "sketch").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "n")
    return dealt.mapInArrow(_compare(percent), "a long, b long")


def _compare(percent: int):
    def pairs(rows: pa.Table) -> pa.RecordBatch:
        key, x, y, block, n, sig, label = (rows.column(c).to_numpy() for c in ("key", "x", "y", "block", "n", "sig", "label"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, BUCKETS)
        out, step, live = [], 1, np.arange(len(key))
        while len(live):
            live = live[live + step < len(key)]
            to = live + step
            near = (key[live] == key[to]) & (x[live] == x[to]) & (y[live] == y[to]) & (100 * n[live] >= percent * n[to])
            live, to = live[near], to[near]
            use = (label[live] != label[to]) & ((x[live] == y[live]) | (block[live] != block[to]))
            i, j = live[use], to[use]
            total = n[i] + n[j]
            apart = total - 2 * -(-percent * total // (100 + percent))
            for k in range(0, len(i), 4096):
                a, b = i[k : k + 4096], j[k : k + 4096]
                gap = np.maximum(sketch[a], sketch[b]) - np.minimum(sketch[a], sketch[b])
                good = np.minimum(gap, np.uint8(0) - gap).sum(axis=1, dtype=np.int64) <= apart[k : k + 4096]
                out.append(np.stack([sig[a[good]], sig[b[good]]]))
            step += 1
        found = np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1) if out else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group of a batch may go on in the next one
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            key, x, y = (rows.column(c).to_numpy() for c in ("key", "x", "y"))
            ends = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            cut = int(ends[-1]) if len(ends) else 0
            if cut:
                yield pairs(rows.slice(0, cut))
            held = rows.slice(cut)
        if held is not None:
            yield pairs(held)

    return run


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n, own (id, whether it is null, text hash) and best (the least own of the component) of each row of docs."""
    members = classes(docs, size, percent)
    labels = linked(docs, members, size, percent)
    own = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), F.col("doc_id").isNull().alias("none"), "tie")
    least = members.filter("n > 0").groupBy("sig").agg(F.min(own).alias("first"), F.count(F.lit(1)).alias("rows"))
    least = least.join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").filter("rows > 1 OR label IS NOT NULL").select("sig", "first", "label")
    least = stored(least, "ngram-least")
    smallest = stored(least.filter("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("top")), "ngram-smallest")
    tops = stored(looked_up(least, smallest, "label", F.col("sig")).select("sig", F.coalesce("top", "first").alias("top")), "ngram-tops")
    discard(least, smallest, labels)
    return looked_up(members.select("doc_id", "n", "sig", own.alias("own")), tops, "sig", F.col("own.tie")).select("doc_id", "n", "own", F.coalesce("top", "own").alias("best"))


def components(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) for each row of docs."""
    found = F.when(F.col("n") == 0, F.col("doc_id")).when(~F.col("best.none"), F.col("best.doc"))
    return grouped(docs, size, percent).select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"))


def keep_one(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without all but the first document of each component, by id and then a hash of its text, with all their columns.

    Documents without words are all kept. Rows that are the first in id and text both stay one row.
    """
    rows = stored(grouped(docs, size, percent).filter("n > 0").select("own", "best"), "ngram-rows")
    key = ["_doc", "_none", "_tie"]
    go = rows.filter(F.col("own") != F.col("best")).select("own.*").distinct()
    twice = rows.filter(F.col("own") == F.col("best")).groupBy("own").count().filter("count > 1").select("own.*")
    marks = go.withColumn("_go", F.lit(True)).unionByName(twice.withColumn("_go", F.lit(False))).toDF(*key, "_go")
    own = docs.select(F.struct("*").alias("_row"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("_doc"), F.col("doc_id").isNull().alias("_none"), F.xxhash64("text").alias("_tie"))
    kept = own.join(marks, key, "left").filter("_go IS NULL OR NOT _go")
    once = kept.filter("_go IS NOT NULL").groupBy(*key).agg(F.first("_row").alias("_row")).select("_row")
    return kept.filter("_go IS NULL").select("_row").unionByName(once).select("_row.*")
