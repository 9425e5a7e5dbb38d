"""Removal of passages repeated across documents, by suffix arrays of shards built with induced sorting.

Every byte covered by a 50-byte string that also starts in a document with a smaller id is removed.

1. Documents are dealt to buckets by a hash; all later steps meet the texts of a bucket, shuffled once.
   The minimiser of a window of 50 bytes is its 16-byte string with the least hash, so equal windows have equal
   minimisers. Consecutive windows with one minimiser form a stretch of at most 84 bytes; each window lies in exactly
   one. Equal stretches of a bucket are a class, told by 104 bits, which stands for all of them with its least document;
   classes go to shards by the minimiser's hash, as packed columns of fingerprints.
2. A shard drops minimisers with one document only: none of their windows can repeat. Classes of several buckets are one;
   the bucket with the least document is asked for the bytes. A minimiser with one class needs no bytes:
   all its windows belong to the class's least document.
3. Each shard's suffix array is built from those bytes by induced sorting: suffixes are
   classified as S or L, the leftmost S substrings are sorted by induction and named, the shorter string of
   names is sorted (by doubling the compared length, its recursion), and the array is induced from them. All
   steps are vectorised by bucket. Permuted common prefixes of neighbours, up to 50 bytes, give the runs
   of equal windows, and a run's least document decides for all its windows.
4. Verdicts go back to the buckets: for each class, the windows that an earlier document than its own least one has.
   A bucket finds its classes again, in the same order, and marks its documents.

What is dealt has a row for each bucket and shard at most, however many documents or copies there are, and a hot passage
takes a fingerprint a bucket. A shard works on pieces of about 1 MB; a minimiser's classes stay together.

Edge cases: null text is empty; texts under 50 bytes lose nothing; a null doc_id is larger than any; rows with
one doc_id don't act on each other; repeated rows get equal results; an empty table gives an empty result; texts may be
of any length; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm import _hashing as H
from reviewlake.llm._packing import gathered, pack, unpack
from reviewlake.llm._shared import NULL_ID, squeezed, told_apart, unsqueezed

LENGTH = 50
KMER = 16
SEPARATOR = 0xFF  # no byte of UTF-8
PIECE = 1 << 20
SEGMENT = 1 << 20
HASH_BITS = 40
_U64 = np.uint64
#: A class of a bucket: minimiser, content, least document and where it is first there, windows less one.
PRINTS = (("h", np.int64, 5, True), ("c", np.uint64, 8, False), ("doc", np.int64, 8, False), ("tie", np.int64, 8, False), ("at", np.int64, 5, False), ("span", np.int64, 1, False))
#: A class that is decided: its number among those of its bucket in the shard, the windows to remove as bits.
DECIDED = (("number", np.int64, 4, True), ("bits", np.int64, 5, False))
#: An open class: its number in the bucket and in the shard, its least document and place; whose bytes are wanted (1, 2: and it begins a minimiser).
OPEN = (("number", np.int64, 4, True), ("cls", np.int64, 4, False), ("doc", np.int64, 8, False), ("tie", np.int64, 8, False), ("at", np.int64, 5, False), ("span", np.int64, 1, False), ("first", np.int64, 1, False))
ROWS = "bucket long, shard long, decided binary, open binary, bytes binary"


def stretches(data: np.ndarray, edges: np.ndarray, length: int = LENGTH, k: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, minimiser hash, content hash) of the stretches of texts in data."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none.astype(_U64), none.astype(_U64)
    wide = H.lanes(data)
    kmers = H.mix(wide[: n - k + 1] ^ H.mix(wide[k - 8 : n - 7]))
    bits = _U64(max(1, int(n).bit_length()))
    least = (kmers >> bits << bits) | np.arange(len(kmers), dtype=_U64)
    width, have = length - k + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    at = (least & ((_U64(1) << bits) - _U64(1))).astype(np.int64)  # of the minimiser, for each window
    ends = edges[1:][np.diff(edges) > 0]
    closed = np.zeros(n + 1, np.int32)
    np.add.at(closed, np.maximum(ends - length + 1, edges[:-1][np.diff(edges) > 0]), 1)
    np.add.at(closed, ends, -1)
    valid = np.cumsum(closed[: len(at)]) == 0
    first = valid.copy()
    first[1:] &= ~(valid[:-1] & (at[1:] == at[:-1]))
    last = valid.copy()
    last[:-1] &= ~(valid[1:] & (at[1:] == at[:-1]))
    a, z = np.flatnonzero(first), np.flatnonzero(last)
    return a, z, kmers[at[a]], H.spans(data, a, z + length, long=length + width)


def bucket_stretches(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window in its text, windows less one, minimiser, content) of all stretches of the texts between edges."""
    out: list[tuple] = []
    row, rows = 0, len(edges) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(edges, edges[row] + PIECE, "right")) - 1)
        start, stop = int(edges[row]), int(edges[end])
        while start < stop:
            # A text longer than a segment is cut; a cut stretch is two with one minimiser.
            cut = min(stop, start + SEGMENT + LENGTH - 1) if end == row + 1 and stop - start > 2 * SEGMENT else stop
            a, z, h, c = stretches(data[start:cut], np.clip(edges[row : end + 1], start, cut) - start)
            of = np.searchsorted(edges[row : end + 1], a + start, "right") - 1 + row
            out.append((of.astype(np.int32), (a + start - edges[of]).astype(np.int64), (z - a).astype(np.int8), (h & _U64((1 << HASH_BITS) - 1)).astype(np.int64), c))
            start = cut if cut == stop else cut - LENGTH + 1
        row = end
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, t) for t in (np.int32, np.int64, np.int8, np.int64, _U64))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row begins a group, of rows sorted by columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = columns[0][1:] != columns[0][:-1]
    for c in columns[1:]:
        new[1:] |= c[1:] != c[:-1]
    return new


class Classes:
    """The classes of a bucket: its stretches by shard, minimiser, content, document and place, and the first of each class."""

    def __init__(self, texts: pa.ChunkedArray, docs: np.ndarray, ties: np.ndarray, shards: int):
        self.data, self.edges = H.buffers(texts.cast(pa.large_binary()).combine_chunks())
        self.row, self.at, self.span, self.h, c = bucket_stretches(self.data, self.edges)
        shard = self.h % shards
        rank = np.empty(len(docs), np.int32)
        rank[np.lexsort((ties, docs))] = np.arange(len(docs))
        key = (shard << HASH_BITS) | self.h
        order = np.argsort(key)
        same = ~_starts(key[order])
        same[:-1] |= same[1:]
        some = order[same]  # only equal minimisers are to be ordered further
        order[same] = some[np.lexsort((self.at[some], rank[self.row[some]], c[some], key[some]))]
        self.row, self.at, self.span, self.h, self.c, shard = (x[order] for x in (self.row, self.at, self.span, self.h, c, shard))
        new = np.ones(len(order), bool)
        new[1:] = (self.h[1:] != self.h[:-1]) | (self.c[1:] != self.c[:-1])
        self.firsts = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        heads = shard[self.firsts]
        cuts = np.flatnonzero(np.diff(heads)) + 1
        self.cuts = np.concatenate([[0], cuts, [len(heads)]]) if len(heads) else np.zeros(1, np.int64)
        self.shards = heads[self.cuts[:-1]]


def _told(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("doc").to_numpy(), table.column("tie").to_numpy()


def _deal(shards: int):
    def run(table: pa.Table) -> pa.Table:
        docs, ties = _told(table)
        own = Classes(table.column("text"), docs, ties, shards)
        f = own.firsts
        columns = {"h": own.h[f], "c": own.c[f], "doc": docs[own.row[f]], "tie": ties[own.row[f]], "at": own.at[f], "span": own.span[f].astype(np.int64)}
        blobs = [pack({n: x[i:j] for n, x in columns.items()}, PRINTS) for i, j in zip(own.cuts, own.cuts[1:], strict=False)]
        bucket = table.column("bucket")[0].as_py() if len(table) else 0
        return pa.table([pa.array(own.shards.astype(np.int64)), pa.array(np.full(len(blobs), bucket, np.int64)), pa.array(blobs, pa.binary())], ["shard", "bucket", "prints"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket of a shard, what is decided and what is open of its classes whose minimiser several documents have."""
    for shard, rows in gathered(batches, "shard", "bucket", "prints"):
        parts = [unpack([blob], PRINTS) for _, blob in rows]
        sizes = [len(p["h"]) for p in parts]
        bucket = np.repeat(np.array([b for b, _ in rows]), sizes)
        number = np.concatenate([np.arange(n) for n in sizes])
        rows.clear()
        all_ = {n: np.concatenate([p.pop(n) for p in parts]) for n, *_ in PRINTS}
        order = np.argsort(all_["h"])
        heads = np.flatnonzero(_starts(all_["h"][order]))
        doc = all_["doc"][order]
        several = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
        keep = order[np.repeat(several, np.diff(np.append(heads, len(order))))]
        if not len(keep):
            continue
        order = keep[np.lexsort((all_["at"][keep], all_["tie"][keep], all_["doc"][keep], all_["c"][keep], all_["h"][keep]))]
        all_ = {n: x[order] for n, x in all_.items()}
        bucket, number = bucket[order], number[order]
        group, first = _starts(all_["h"]), _starts(all_["h"], all_["c"])
        cls = np.cumsum(first) - 1
        begins = np.flatnonzero(group)
        lone = np.repeat(np.add.reduceat(first, begins) == 1, np.diff(np.append(begins, len(group))))
        least = all_["doc"][np.flatnonzero(first)[cls]]
        gone = lone & (least < all_["doc"])
        bits = (1 << (all_["span"] + 1)) - 1
        all_ |= {"number": number, "cls": cls, "first": first.astype(np.int64) + group, "bits": bits}
        by = np.lexsort((number, bucket))
        cuts = np.append(np.flatnonzero(_starts(bucket[by])), len(by))
        for i, j in zip(cuts, cuts[1:], strict=False):
            mine = by[i:j]
            blobs = [pack({n: all_[n][some] for n, *_ in fields}, fields) if len(some := mine[use[mine]]) else None for fields, use in ((DECIDED, gone), (OPEN, ~lone))]
            if any(blobs):
                yield pa.RecordBatch.from_arrays([pa.array([int(bucket[mine[0]])]), pa.array([shard]), *(pa.array([b], pa.binary()) for b in blobs), pa.nulls(1, pa.binary())], ["bucket", "shard", "decided", "open", "bytes"])


def _fetch(texts: pa.Table, asked: pa.Table) -> pa.Table:
    """What a bucket was sent, with the bytes of the classes that it has first."""
    docs, ties = _told(texts)
    data, edges = H.buffers(texts.column("text").cast(pa.large_binary()).combine_chunks()) if len(texts) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    order = np.lexsort((ties, docs))
    place = {key: int(k) for key, k in zip(zip(docs[order].tolist(), ties[order].tolist(), strict=True), order, strict=True)}
    out: list[bytes | None] = []
    for blob in asked.column("open").to_pylist():
        if blob is None:
            out.append(None)
            continue
        open_ = unpack([blob], OPEN)
        use = np.flatnonzero(open_["first"])
        rows = np.array([place[key] for key in zip(open_["doc"][use].tolist(), open_["tie"][use].tolist(), strict=True)], np.int64)
        sizes = open_["span"][use] + LENGTH
        ends = np.cumsum(sizes)
        where = np.repeat(edges[rows] + open_["at"][use] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        out.append(squeezed(data[where].tobytes()))
    return pa.table([*(asked.column(n) for n in ("bucket", "shard", "decided", "open")), pa.array(out, pa.binary())], ["bucket", "shard", "decided", "open", "bytes"])


def _induce(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The suffix array induced from LMS suffixes in the order given."""
    n = len(text)
    ends = np.cumsum(counts)
    heads, tails = ends - counts, ends.copy()
    order = np.full(n, -1, np.int64)
    present = np.flatnonzero(counts)
    chars = text[lms]
    at = np.argsort(chars, kind="stable")
    per = np.bincount(chars, minlength=256)
    stops = np.cumsum(per)
    lms_of = {c: lms[at[stops[c] - per[c] : stops[c]]] for c in present if per[c]}

    def put_left(found: np.ndarray, low: int) -> np.ndarray:
        """Appends the L predecessors of found to their buckets; returns those in bucket low."""
        found = found[found > 0] - 1
        found = found[~is_s[found]]
        kinds = text[found]
        by = np.argsort(kinds, kind="stable")
        found, per_kind = found[by], np.bincount(kinds, minlength=256)
        same, at = found[:0], 0
        for c in np.flatnonzero(per_kind):
            m = per_kind[c]
            order[heads[c] : heads[c] + m] = found[at : at + m]
            if c == low:
                same = found[at : at + m]
            heads[c] += m
            at += m
        return same

    start = heads.copy()
    # The end of the text comes before all suffixes; its predecessor is the last one, of type L.
    c = text[n - 1]
    order[heads[c]] = n - 1
    heads[c] += 1
    for c in present:
        new = order[start[c] : heads[c]].copy()
        while len(new):
            new = put_left(new, c)
        if c in lms_of:
            put_left(lms_of[c], c)
    lefts = heads.copy()

    def put_right(found: np.ndarray, high: int) -> np.ndarray:
        found = found[found > 0] - 1
        found = found[is_s[found]]
        kinds = text[found]
        by = np.argsort(kinds, kind="stable")
        found, per_kind = found[by], np.bincount(kinds, minlength=256)
        same, at = found[:0], 0
        for c in np.flatnonzero(per_kind):
            m = per_kind[c]
            order[tails[c] - m : tails[c]] = found[at : at + m][::-1]
            if c == high:
                same = found[at : at + m]
            tails[c] -= m
            at += m
        return same

    for c in present[::-1]:
        new = order[tails[c] : ends[c]][::-1].copy()
        while len(new):
            new = put_right(new, c)
        put_right(order[start[c] : lefts[c]][::-1], c)
    return order


def _ranks(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names, by doubling the length that is compared."""
    n, rank, step = len(names), names.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1 or step >= n:
            return order
        step *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of bytes, by induced sorting."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    counts = np.bincount(text, minlength=256)
    rises = np.zeros(n, np.int8)
    rises[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    rises[-1] = -1
    where = np.where(rises != 0, np.arange(n), n)
    is_s = rises[np.minimum.accumulate(where[::-1])[::-1]] > 0
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) < 2:
        return _induce(text, is_s, lms, counts)
    # Sort the LMS substrings by one induction, and name equal ones alike.
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    first = _induce(text, is_s, lms, counts)
    sorted_ = first[is_lms[first]]
    content = H.spans(text, lms, np.concatenate([lms[1:] + 1, [n]]))
    content[-1] ^= _U64(1)  # the last one ends with the text, and is like no other
    number = np.empty(n, np.int64)
    number[lms] = np.arange(len(lms))
    by = content[number[sorted_]]
    names = np.empty(len(lms), np.int64)
    names[number[sorted_]] = np.concatenate([[0], np.cumsum(by[1:] != by[:-1])])
    ordered = lms[_ranks(names)] if names.max() < len(lms) - 1 else sorted_
    return _induce(text, is_s, ordered, counts)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place of text, the bytes (up to `most`) that its suffix shares with the one before it in order."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(most + 8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (n + most, 8), (1, 1)).copy().view("<u8").reshape(-1)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    for step in range(0, most, 8):
        x = words[live + step] ^ words[np.minimum(before[live] + step, n + most - 1)]
        equal = x == 0
        low = x & (~x + _U64(1))
        shared[live] += np.where(equal, 8, np.searchsorted(_EDGES, low, "right") // 8)
        live = live[equal]
        live = live[(live + step + 8 < n) & (before[live] + step + 8 < n)]
    return np.minimum(np.minimum(shared, most), n - np.maximum(np.arange(n), before))


_EDGES = (_U64(1) << np.arange(1, 64, dtype=_U64))


def least_docs(texts: list[np.ndarray], docs: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each window of each text, the least document of the texts that hold the same window."""
    sizes = np.array([len(t) + 1 for t in texts])
    text = np.full(sizes.sum(), SEPARATOR, np.uint8)
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for f, t in zip(firsts, texts, strict=True):
        text[f : f + len(t)] = t
    order = suffix_array(text)
    shared = common_prefixes(text, order, length)
    counts = np.maximum(sizes - length, 0)
    windows = np.zeros(len(text), bool)
    of = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(text)) - firsts[of]
    windows[inside < counts[of]] = True
    # A run of neighbours that share a window's length is one window's places; others between can't be in it.
    run = np.cumsum(shared[order] < length)
    mine = windows[order]
    places, runs = order[mine], run[mine]
    least = np.full(len(text), NULL_ID, np.int64)
    if len(places):
        heads = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
        mins = np.minimum.reduceat(docs[of[places]], heads)
        least[places] = np.repeat(mins, np.diff(np.concatenate([heads, [len(places)]])))
    return [least[f : f + c] for f, c in zip(firsts, counts, strict=True)]


def _verdicts(parts: list[dict[str, np.ndarray]], texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the open classes of each bucket of a shard, (number, bits) of those with windows to remove."""
    sizes = [len(p["cls"]) for p in parts]
    all_ = {n: np.concatenate([p[n] for p in parts]) for n in ("cls", "doc", "span", "first")}
    data = np.frombuffer(b"".join(texts), np.uint8)
    wanted = np.where(all_["first"] > 0, all_["span"] + LENGTH, 0)
    starts = np.cumsum(wanted) - wanted
    leaders = np.flatnonzero(all_["first"])
    leaders = leaders[np.argsort(all_["cls"][leaders], kind="stable")]
    names, of = np.unique(all_["cls"], return_inverse=True)
    least = np.full((len(names), LENGTH - KMER + 1), NULL_ID, np.int64)
    cuts, at = np.append(np.flatnonzero(all_["first"][leaders] == 2), len(leaders)), 0
    volume = np.concatenate([[0], np.cumsum(wanted[leaders])])
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(volume[cuts], volume[cuts[at]] + PIECE, "right")) - 1)
        some = leaders[cuts[at] : cuts[to]]
        pieces = [data[a : a + n] for a, n in zip(starts[some].tolist(), wanted[some].tolist(), strict=True)]
        for k, found in enumerate(least_docs(pieces, all_["doc"][some]), int(cuts[at])):
            least[k, : len(found)] = found
        at = to
    bits = np.zeros(len(of), np.int64)
    for j in range(least.shape[1]):
        bits |= (least[of, j] < all_["doc"]).astype(np.int64) << j
    edges = np.concatenate([[0], np.cumsum(sizes)])
    return [(p["number"][hit], bits[a:z][hit]) for p, a, z in zip(parts, edges, edges[1:], strict=False) for hit in [np.flatnonzero(bits[a:z])]]


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket of a shard, all that is decided."""
    for shard, rows in gathered(batches, "shard", "bucket", "decided", "open", "bytes"):
        open_ = [r for r in rows if r[2] is not None]
        found = _verdicts([unpack([r[2]], OPEN) for r in open_], [unsqueezed(r[3]) for r in open_]) if open_ else []
        by_bucket = {r[0]: x for r, x in zip(open_, found, strict=True)}
        for bucket, decided, _, _ in rows:
            old = unpack([decided] if decided is not None else [], DECIDED)
            number, bits = by_bucket.get(bucket, (old["number"][:0], old["bits"][:0]))
            number, bits = np.concatenate([old["number"], number]), np.concatenate([old["bits"], bits])
            if len(number):
                order = np.argsort(number, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([shard]), pa.array([pack({"number": number[order], "bits": bits[order]}, DECIDED)], pa.binary())], ["bucket", "shard", "decided"])


def marked(size: int, at: np.ndarray, bits: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of size bytes go, from the places of stretches and the bits of their windows."""
    change = np.zeros(size + 1, np.int32)
    for j in range(length - KMER + 1):
        starts = at[(bits >> j) & 1 == 1] + j
        np.add.at(change, starts, 1)
        np.add.at(change, starts + length, -1)
    return np.cumsum(change[:size], dtype=np.int32) > 0


def _finish(shards: int, with_text: bool):
    def run(texts: pa.Table, verdicts: pa.Table) -> pa.Table:
        docs, ties = _told(texts)
        own = Classes(texts.column("text"), docs, ties, shards)
        bits = np.zeros(len(own.firsts), np.int64)
        begin = dict(zip(own.shards.tolist(), own.cuts.tolist(), strict=False))
        for shard, blob in zip(verdicts.column("shard").to_pylist(), verdicts.column("decided").to_pylist(), strict=True):
            decided = unpack([blob], DECIDED)
            bits[begin[shard] + decided["number"]] = decided["bits"]
        # A window of a class goes where an earlier document has it, be it of the bucket or not.
        later = docs[own.row] > docs[own.row[own.firsts]][own.of]
        bits = np.where(later, (1 << (own.span.astype(np.int64) + 1)) - 1, bits[own.of])
        hit = np.flatnonzero(bits)
        gone = marked(len(own.data), own.edges[own.row[hit]] + own.at[hit], bits[hit])
        out: list[list] = [[], [], [], [], []]
        for a, z in zip(own.edges.tolist(), own.edges[1:].tolist(), strict=False):
            off = gone[a:z]
            kept = own.data[a:z][~off].tobytes()
            spans = int(np.count_nonzero(off[1:] & ~off[:-1]) + off[0]) if z > a else 0
            for column, value in zip(out, (z - a, int(np.count_nonzero(off)), spans, sha256(kept).hexdigest(), kept), strict=True):
                column.append(value)
        columns = [texts.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns, names = [*columns, pa.array(out[4], pa.binary())], [*names, "kept"]
        return pa.table(columns, names)

    return run


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left) for each row of docs."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("doc", "tie"), F.lit(shards))
    # The same columns in all three steps, so that one shuffle of the texts serves them all.
    texts = told_apart(docs).withColumn("bucket", bucket).groupBy("bucket")
    dealt = texts.applyInArrow(_deal(shards), "shard long, bucket long, prints binary").repartition(shards, "shard").sortWithinPartitions("shard")
    asked = dealt.mapInArrow(_shared, ROWS)
    fetched = texts.cogroup(asked.groupBy("bucket")).applyInArrow(_fetch, ROWS).repartition(shards, "shard").sortWithinPartitions("shard")
    verdicts = fetched.mapInArrow(_decide, "bucket long, shard long, decided binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return texts.cogroup(verdicts.groupBy("bucket")).applyInArrow(_finish(shards, with_text), schema)
