"""Token ids in ORC files: integer run-length encoding, row indexes and a Bloom filter on document ids.

Documents are dealt by ranges of doc_id and sorted, encoded in that order, and written as one ORC file a
range, with the ids as an array of 32-bit integers (ORC stores them by integer run-length encoding). Stripes
can be read in parallel; row indexes and the Bloom filter on doc_id let a lookup skip stripes. `part` and
`row` give the place in the order. Reading back needs the files alone.

Encoding: the byte-level pre-tokeniser always breaks at certain places (before a space that a letter, digit or mark
follows, around a newline between such, before a mark behind a letter), so the ids of a text are those of its pieces
between them. Pieces are found and looked up by whole arrays of bytes; up to 15 bytes a piece is its own exact
128-bit key. Each distinct piece is given to the tokenizers library once, while it is in a bounded memory. Texts that
hold an added token of the tokenizer, and all texts of other kinds of tokenizers, get to the library whole.

Edge cases: null text is empty and gets only the end id; null ids come first; rows with one id are ordered by
a hash of their text; an empty table gives an empty result. Texts of any length are encoded whole. Other columns of
the table are not read, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.llm import _hashing as H
from reviewlake.llm._shared import stored

#: Pieces remembered by a Python worker; beyond that those met once go.
REMEMBER = 1_000_000
END = 2
CHUNK_BYTES = 4 << 20
#: Pieces of more bytes are looked up one by one.
SHORT = 15
SCHEMA = "part int, row long, doc_id long, ids array<int>"
ORC = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "2000", "compression": "zstd"}

#: Bytes after which, or before which, a break is certain. Lead bytes that white space has too are in none.
_ALNUM, _MARK, _SOLID = (np.zeros(256, bool) for _ in range(3))
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_MARK[list(b".,;:!?)]}\"")] = True
_SOLID[0x21:0x7F] = True
_OPEN = _SOLID.copy()
_OPEN[0x80:] = True
_OPEN[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_U64 = np.uint64


def breaks(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts that lie between edges in data."""
    first = np.zeros(len(data) + 1, bool)
    first[edges[:-1]] = True
    if len(data) > 2:
        before, here, after = data[:-2], data[1:-1], data[2:]
        line = (here == 10) & _SOLID[before] & _SOLID[after]
        first[1:-2] |= ((here == 32) & _OPEN[after]) | (_MARK[here] & _ALNUM[before]) | line
        first[2:-1] |= line
    return np.flatnonzero(first[: len(data)])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        pre = told.get("pre_tokenizer") or {}
        self.pieces = told.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.added = [t["content"] for t in told.get("added_tokens") or ()]
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else None
        self.forget()

    def forget(self) -> None:
        """An empty memory: a table with open places for short pieces, a dictionary for the others."""
        places = 1 << (2 * REMEMBER).bit_length()
        self.low, self.high, self.number = np.zeros(places, _U64), np.zeros(places, _U64), np.full(places, -1, np.int32)
        self.known: dict[bytes, int] = {}
        self.count, self.used = 0, 0
        self.starts, self.lengths, self.again = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, bool)
        self.flat = np.zeros(1 << 14, np.int32)

    def remember(self, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Numbers of new pieces, whose ids stand one after another."""
        n, end = len(lengths), self.used + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), end), np.int32)])
        if self.count + n > len(self.starts):
            more = max(len(self.starts), n)
            self.starts, self.lengths, self.again = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.starts, self.lengths, self.again))
        self.flat[self.used : end] = ids
        here = slice(self.count, self.count + n)
        self.starts[here], self.lengths[here], self.again[here] = self.used + np.cumsum(lengths) - lengths, lengths, False
        self.count, self.used = self.count + n, end
        return np.arange(here.start, here.stop)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of remembered pieces one after another, and their numbers."""
        lengths = self.lengths[at]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths

    def place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (H.mix(low ^ H.mix(high)) & _U64(len(self.number) - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Numbers of short pieces by their keys, -1 for those not remembered."""
        out, at, live = np.full(len(low), -1, np.int64), self.place(low, high), np.arange(len(low))
        while len(live):
            here = at[live]
            number = self.number[here]
            same = (number >= 0) & (self.low[here] == low[live]) & (self.high[here] == high[live])
            out[live[same]] = number[same]
            live = live[(number >= 0) & ~same]
            at[live] = (at[live] + 1) & (len(self.number) - 1)
        return out

    def put(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Enters distinct keys that are not in the table."""
        at, live = self.place(low, high), np.arange(len(low))
        while len(live):
            free = live[self.number[at[live]] < 0]
            self.number[at[free]] = number[free]
            won = free[self.number[at[free]] == number[free]]
            self.low[at[won]], self.high[at[won]] = low[won], high[won]
            live = live[self.number[at[live]] != number[live]]
            at[live] = (at[live] + 1) & (len(self.number) - 1)

    def learn(self, pieces: list[bytes]) -> np.ndarray:
        """Numbers of pieces that the library encodes now. Those without white space inside go as the lines of one text."""
        ids, lengths = [], np.zeros(len(pieces), np.int64)
        texts = [p.decode() for p in pieces]
        plain = [k for k, t in enumerate(texts) if (u := t[1:] if t[0] == " " else t).split() == [u]] if self.line is not None else []
        for k in range(0, len(plain), 4096):
            some = plain[k : k + 4096]
            done = np.array(self.tokenizer.encode("\n".join([texts[j] for j in some]), add_special_tokens=False).ids, np.int32)
            ends = np.append(np.flatnonzero(done == self.line), len(done))
            lengths[some] = np.diff(ends, prepend=-1) - 1
            ids.append(done[done != self.line])
        other = [k for k, n in enumerate(lengths) if not n]
        for k in range(0, len(other), 4096):
            rows, sizes = self.whole([texts[j] for j in other[k : k + 4096]])
            lengths[other[k : k + 4096]] = sizes
            ids.append(rows)
        order = np.array(plain + other, np.int64)
        numbers = np.empty(len(pieces), np.int64)
        numbers[order] = self.remember(lengths[order], np.concatenate(ids) if ids else np.zeros(0, np.int32))
        return numbers

    def trim(self) -> None:
        """Keeps the pieces that were met again, if they are less than half of what may be remembered."""
        keep, held = np.flatnonzero(self.number >= 0), self.known
        keep = keep[self.again[self.number[keep]]]
        ids, lengths = self.gather(self.number[keep].astype(np.int64))
        low, high = self.low[keep], self.high[keep]
        long = [(p, k) for p, k in held.items() if self.again[k]]
        more, sizes = self.gather(np.array([k for _, k in long], np.int64))
        self.forget()
        if len(keep) + len(long) <= REMEMBER // 2:
            self.put(low, high, self.remember(lengths, ids))
            self.known.update(zip([p for p, _ in long], self.remember(sizes, more).tolist(), strict=True))

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the pieces between starts and ends; new ones are learnt."""
        size, wide, raw = ends - starts, H.lanes(np.concatenate([data, np.zeros(8, np.uint8)])), None
        at = np.empty(len(starts), np.int64)
        short, long = np.flatnonzero(size <= SHORT), np.flatnonzero(size > SHORT)
        s, n = starts[short], size[short]
        low = wide[s] & H.MASKS[np.minimum(n, 8)]
        high = (wide[s + 8 * (n > 8)] & H.MASKS[np.maximum(n - 8, 0)]) | (n.astype(_U64) << _U64(56))
        found = self.find(low, high)
        new = np.flatnonzero(found < 0)
        self.again[found[found >= 0]] = True
        if len(new) or len(long):
            raw = data.tobytes()
        if len(new):
            order = new[np.lexsort((high[new], low[new]))]
            first = np.ones(len(order), bool)
            first[1:] = (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])
            heads = order[first]
            number = self.learn([raw[a : a + m] for a, m in zip(s[heads].tolist(), n[heads].tolist(), strict=True)])
            self.put(low[heads], high[heads], number)
            found[order] = number[np.cumsum(first) - 1]
        at[short] = found
        if len(long):
            pieces = [raw[a:z] for a, z in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            fresh = [p for p in dict.fromkeys(pieces) if p not in self.known]
            self.known.update(zip(fresh, self.learn(fresh).tolist(), strict=True))
            at[long] = [self.known[p] for p in pieces]
            self.again[at[long]] = True
        return at

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(rows), np.int32), np.array([len(r) for r in rows], np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text; the end id is with them."""
        texts = texts.fill_null("")
        odd = np.full(len(texts), not self.pieces)
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        data, edges = H.buffers(texts)
        data, edges = data[edges[0] : edges[-1]], edges - edges[0]
        if self.count > REMEMBER:
            self.trim()
        starts = breaks(data, edges) if len(data) and not odd.all() else np.zeros(0, np.int64)
        row = np.searchsorted(edges, starts, "right") - 1
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        use = ~odd[row]
        ids, lengths = self.gather(self.numbers(data, starts[use], ends[use]))
        counts = np.bincount(row[use], lengths, len(texts)).astype(np.int64)
        if odd.any():
            more, sizes = self.whole(texts.filter(pa.array(odd)).to_pylist())
            at = np.repeat((np.cumsum(counts) - counts)[odd], sizes)
            counts[odd] = sizes
            ids = np.insert(ids, at, more)
        return np.insert(ids, np.cumsum(counts), END), counts + 1


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker, which keeps it from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, own = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in batches:
            texts, at = batch.column("text"), 0
            _, edges = H.buffers(texts)
            while at < len(texts):
                end = max(at + 1, int(np.searchsorted(edges, edges[at] + CHUNK_BYTES, "right")) - 1)
                ids, counts = own.encode(texts.slice(at, end - at))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(end - at, part, np.int32)), pa.array(np.arange(row, row + end - at)), batch.column("doc_id").slice(at, end - at), lists], ["part", "row", "doc_id", "ids"])
                row += end - at
                at = end

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Writes the ids of docs (doc_id long, text) to ORC files at path, in ascending doc_id order."""
    ordered = docs.select("doc_id", "text").withColumn("_tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie")
    ordered.select("doc_id", "text").mapInArrow(_encode(tokenizer), SCHEMA).write.options(**ORC).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """part, row, doc_id, ids; filters on doc_id prune stripes."""
    return spark.read.schema(SCHEMA).orc(path)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        edges, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("part", "row", "doc_id")), pa.array(np.diff(edges).astype(np.int64)), pa.array(sums, pa.int64())], ["part", "row", "doc_id", "n_tokens", "ids_crc32"])


def summary(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files. Parts are summed first, so no task sees all rows."""
    rows = stored(tokens.mapInArrow(_sum, "part int, row long, doc_id long, n_tokens long, ids_crc32 long"), "token-sums")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_all"))
    before = parts.withColumn("_before", F.coalesce(F.sum("_all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "_before")
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_in", within).join(before, "part").select("doc_id", (F.col("_before") + F.col("_in")).alias("start"), "n_tokens", "ids_crc32")
