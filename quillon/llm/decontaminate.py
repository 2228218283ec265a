"""Benchmark decontamination with suffix arrays over the training text.

Each batch of training documents is one shard. Its suffix array holds the word
positions whose first words all occur in the test items: no other position can
begin a match, so leaving them out changes nothing. Every suffix of every test
item is binary-searched in each shard's array; the interval that it finds gives
all verbatim occurrences of a window, and chains of neighbouring windows on one
diagonal are the longest matches.

The training side's texts are never shuffled. The test items travel to the
executors in blocks of at most `block_bytes`, each a pass over the training text.

Edge cases: null or wordless texts have no words and no hits; an item of fewer
than `window` words is one window of its own length; repeated documents are
judged each by itself; repeated item ids count once; other columns are ignored;
an empty training or test table gives no rows or no hits. A very long text is a
shard of its own.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, back, map_batches, materialize, pieces, placed, table, text_slices

#: Lower-cases A-Z and turns every other ASCII byte that is no digit or letter into a space.
WORD_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
MATCHES = "doc_id bigint, n_words bigint, item_id bigint, item_start bigint, doc_start bigint, n_match bigint"


def words(text: bytes | None) -> list[bytes]:
    return [] if text is None else text.translate(WORD_BYTES).split()


class TestSet:
    """The suffixes of one block of test items as sorted keys of word numbers."""

    def __init__(self, items: list[tuple[int, bytes | None]], window: int):
        self.window = window
        self.number: dict[bytes, int] = {}
        rows, self.least = [], window
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            if ids:
                size = min(window, len(ids))
                self.least = min(self.least, size)
                rows += [(size, item, k, *ids[k : k + size], *[0] * (window - size)) for k in range(len(ids) - size + 1)]
        table = np.array(rows, np.int64).reshape(len(rows), window + 3)
        self.size, self.item, self.start = table[:, 0], table[:, 1], table[:, 2]
        self.keys = table[:, 3:].astype(">u4")

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(test suffix, position in ids) of every verbatim occurrence in a shard whose documents are parted by zeros."""
        window, n = self.window, len(ids)
        # run[i]: how many words from i on occur in the test set
        stops = np.append(np.flatnonzero(ids == 0), n)
        run = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n)
        at = np.flatnonzero(run >= self.least)
        if not len(at) or not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        padded = np.append(ids, np.zeros(window, ids.dtype))
        columns = padded[at[:, None] + np.arange(window)]
        columns[np.arange(window) >= run[at][:, None]] = 0  # a suffix ends with its document
        order = np.lexsort(columns.T[::-1])
        array = np.ascontiguousarray(columns[order].astype(">u4")).view(f"V{4 * window}").ravel()
        at = at[order]
        found, where = [], []
        for size in np.unique(self.size):
            mine = np.flatnonzero(self.size == size)
            low = np.zeros((len(mine), window), ">u4")
            low[:, :size] = self.keys[mine, :size]
            high = low.copy()
            high[:, size:] = 0xFFFFFFFF
            left, right = lower_bound(array, low), lower_bound(array, high, True)
            n_each = right - left
            found.append(np.repeat(mine, n_each))
            where.append(at[np.repeat(left, n_each) + np.arange(n_each.sum()) - np.repeat(np.cumsum(n_each) - n_each, n_each)])
        return np.concatenate(found), np.concatenate(where)


def lower_bound(array: np.ndarray, keys: np.ndarray, after: bool = False) -> np.ndarray:
    """Binary search of all keys at once; array: sorted big-endian rows."""
    window = keys.shape[1]
    rows = array.view(">u4").reshape(-1, window)
    low, high = np.zeros(len(keys), np.int64), np.full(len(keys), len(rows), np.int64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        there = rows[np.minimum(mid, len(rows) - 1)]
        differs = there != keys
        first = np.where(differs.any(1), differs.argmax(1), window - 1)
        x, y = there[np.arange(len(keys)), first], keys[np.arange(len(keys)), first]
        less = (x <= y) if after else (x < y)
        low, high = np.where(open_ & less, mid + 1, low), np.where(open_ & ~less, mid, high)
    return low


def chains(found: np.ndarray, where: np.ndarray, test: TestSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest matches: (test suffix, position, words) from windows that follow each other in item and shard."""
    if not len(found):
        return found, where, where
    order = np.lexsort((where, where - test.start[found], test.item[found]))
    found, where = found[order], where[order]
    item, diagonal = test.item[found], where - test.start[found]
    new = np.ones(len(found), bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (where[1:] != where[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(found)) - 1
    return found[heads], where[heads], where[tails] + test.size[found[tails]] - where[heads]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, bytes | None]]]:
    block, total = [], 0
    for row in benchmark.select("item_id", "text").where("item_id is not null").toLocalIterator():
        text = None if row.text is None else row.text.encode()
        if block and total + len(text or b"") > block_bytes:
            yield block
            block, total = [], 0
        block.append((row.item_id, text))
        total += len(text or b"")
    yield block


def _shards(test: TestSet, batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, words of each, first word of each, test suffix, position) of each shard."""
    number = test.number.get
    for i, j in pieces(batch.column("text")):
        ids, sizes = [], []
        for text in text_slices(batch.column("text").slice(i, j - i)):
            mine = [number(w, 0) for w in words(text)]
            ids += mine
            ids.append(0)
            sizes.append(len(mine))
        n = np.array(sizes, np.int64)
        start = np.cumsum(n + 1) - n - 1
        found, where = test.search(np.array(ids, np.int64))
        yield batch.column("doc_id").slice(i, j - i).to_pylist(), n, start, found, where


def matches(documents: DataFrame, benchmark: DataFrame, window: int = 8, block_bytes: int = 16 << 20) -> DataFrame:
    """Longest verbatim matches and where they are: one row per maximal run of windows."""
    out = None
    for block in _blocks(benchmark, block_bytes):  # each block's matches are written before the next is held
        shared = documents.sparkSession.sparkContext.broadcast(TestSet(block, window))

        def find(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            test = shared.value
            for docs, n, start, found, where in _shards(test, batch):
                head, at, size = chains(found, where, test)
                d = np.searchsorted(start, at, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([docs[x] for x in d], pa.int64()), pa.array(n[d]), pa.array(test.item[head]), pa.array(test.start[head]), pa.array(at - start[d]), pa.array(size)], ["doc_id", "n_words", "item_id", "item_start", "doc_start", "n_match"])

        part = materialize(map_batches(documents.select("doc_id", "text"), find, MATCHES), "matches")
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def judge(documents: DataFrame, benchmark: DataFrame, window: int = 8, block_bytes: int = 16 << 20, keep_columns: bool = False) -> DataFrame:
    """One row per document row: q_n_words, q_n_hit, q_n_items, q_items_sha256; with keep_columns, all its own columns first.

    One block of test items is a single pass without a shuffle. With more, each
    block is a pass of its own whose hits (not the texts) are then united by row.
    """
    names = documents.columns if keep_columns else ["doc_id"]
    blocks = _blocks(benchmark, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _judge_once(documents, names, documents.sparkSession.sparkContext.broadcast(TestSet(first, window)))
    numbered, place = placed(documents), ["q_file", "q_row"]
    hits = None
    for block in itertools.chain([first, second], blocks):  # one block of items at a time is held and shared
        shared = documents.sparkSession.sparkContext.broadcast(TestSet(block, window))
        part = materialize(_hits(numbered, shared), "hits")
        shared.unpersist()
        hits = part if hits is None else hits.unionByName(part)
    hits = hits.groupBy(*place).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    none = F.array().cast("array<bigint>")
    items = F.coalesce("items", none)
    joined = _counted(numbered, [*names, *place]).join(hits, place, "left")
    ids = F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ",")
    return joined.select(*names, "q_n_words", F.size(F.coalesce("places", none)).cast("long").alias("q_n_hit"), F.size(items).cast("long").alias("q_n_items"), F.sha2(ids.cast("binary"), 256).alias("q_items_sha256"))


def _schema(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)


def _counted(documents: DataFrame, names: list[str]) -> DataFrame:
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [len(words(t)) for t in text_slices(batch.column("text"))]
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(n, pa.int64())], [*names, "q_n_words"])

    return map_batches(documents.select(*dict.fromkeys([*names, "text"])), count, f"{_schema(documents, names)}, q_n_words bigint")


def _hits(numbered: DataFrame, shared) -> DataFrame:
    """(q_file, q_row, places of hit words, items) of the documents that a block of test items hits."""

    def find(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        test = shared.value
        files, rows = batch.column("q_file").to_pylist(), batch.column("q_row").to_pylist()
        own = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column("text")], ["doc_id", "text"])
        for docs, _, start, found, where in _shards(test, own):
            out: dict[int, tuple[set, set]] = {}
            for d, item, at, size in zip((np.searchsorted(start, where, "right") - 1).tolist(), test.item[found].tolist(), where.tolist(), test.size[found].tolist(), strict=True):
                places, items = out.setdefault(d, (set(), set()))
                places.update(range(at - int(start[d]), at - int(start[d]) + size))
                items.add(item)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([files[docs[d]] for d in out], pa.int64()), pa.array([rows[docs[d]] for d in out], pa.int64()), pa.array([list(p) for p, _ in out.values()], pa.list_(pa.int64())), pa.array([list(i) for _, i in out.values()], pa.list_(pa.int64()))], ["q_file", "q_row", "places", "items"])

    return map_batches(numbered.select("q_file", "q_row", "text"), find, "q_file bigint, q_row bigint, places array<bigint>, items array<bigint>")


def _judge_once(documents: DataFrame, names: list[str], shared) -> DataFrame:
    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        test = shared.value
        n_all, n_hit, n_items, digest = [], [], [], []
        for _, n, start, found, where in _shards(test, batch):
            edge = np.zeros(int(n.sum()) + len(n) + 1, np.int64)
            np.add.at(edge, where, 1)
            np.add.at(edge, where + test.size[found], -1)
            hit = np.append(0, np.cumsum(np.cumsum(edge[:-1]) > 0))
            items: dict[int, set] = {}
            for d, item in zip((np.searchsorted(start, where, "right") - 1).tolist(), test.item[found].tolist(), strict=True):
                items.setdefault(d, set()).add(item)
            n_all += n.tolist()
            n_hit += (hit[start + n] - hit[start]).tolist()
            for d in range(len(n)):
                mine = sorted(map(str, items.get(d, ())))
                n_items.append(len(mine))
                digest.append(hashlib.sha256(",".join(mine).encode()).hexdigest())
        added = [pa.array(n_all, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string())]
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *added], [*names, "q_n_words", "q_n_hit", "q_n_items", "q_items_sha256"])

    return map_batches(documents.select(*dict.fromkeys([*names, "text"])), find, f"{_schema(documents, names)}, q_n_words bigint, q_n_hit bigint, q_n_items bigint, q_items_sha256 string")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 1) -> DataFrame:
    """The documents in which fewer than `min_items` test items have a window, with their own columns.

    Items of fewer than `window` words take no part: a common word or two would remove clean documents.
    """
    safe = aside(documents, "doc_id", "text")
    spaced = F.translate("text", "".join(map(chr, range(128))).translate({ord(c): None for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"}), " " * 66)
    benchmark = benchmark.where(F.size(F.filter(F.split(spaced, " "), lambda x: x != "")) >= window)
    return back(judge(safe, benchmark, window, keep_columns=True).where(F.col("q_n_items") < min_items), safe, documents)


def op10(spark, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("q_n_words").alias("n_words"), F.col("q_n_hit").alias("n_hit"), F.col("q_n_items").alias("n_items"), F.col("q_items_sha256").alias("items_sha256"), (F.col("q_n_items") >= 2).alias("contaminated"))


OP10_SQL = r"""
with dw as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
bw as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark),
bwin as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') k from (select item_id, w, least(8, len(w)) n, unnest(range(1, len(w) - least(8, len(w)) + 2)) i from bw where len(w) > 0)),
sizes as (select distinct n from bwin),
dwin as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') k from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from dw, sizes where len(w) >= n)),
hits as (select d.doc_id, d.i, d.n, b.item_id from dwin d join bwin b on d.n = b.n and d.k = b.k),
covered as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from hits) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) s from (select distinct doc_id, cast(item_id as varchar) s from hits) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(s, '')) items_sha256, coalesce(n_items, 0) >= 2 contaminated
from dw left join covered using (doc_id) left join items using (doc_id)
"""
