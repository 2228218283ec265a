"""Removal of long repeated substrings by merging shard Burrows-Wheeler transforms.

Every byte covered by a `length`-byte string that starts anywhere else is removed.
How many bytes a shorter string of `least` bytes covers that starts anywhere else
is reported beside it: the merged common prefixes tell both.

1. Alignment. In each possible string of `least` bytes, the smallest hash of its
   short grams is its anchor; equal strings have it at the same offset. All starts
   of a document fall into runs with one anchor, and into chunks of near offsets,
   whose strings share a core. Only chunks whose core occurs in two different texts,
   or twice in one, go on; of exact copies only the first goes on, as copies lose
   all that is long enough.
2. The repeated chunks' contexts meet by core. A context's strings are sequences
   of symbols, hashes of pieces of the string: FIRST of them spell its first
   `least` bytes, MORE the rest. They are dealt into shards by the part of the
   corpus that they come from. Each shard is sorted and gives a multi-string Burrows-Wheeler
   transform; shards are merged pairwise, in rounds, by iterative interleave refinement:
   pass k reads both transforms in the order of pass k - 1 and so orders all suffixes
   by k symbols, without sorting them anew; where a boundary first appears, the common
   prefix of two neighbours ends. Intervals of whole strings with a common prefix of
   all symbols and a weight of two or more repeat at `length`, those with one of FIRST
   symbols at `least`.
3. Repeated starts return to their documents as spans, are united and cut.

Symbols stand for their bytes by 64-bit hashes, of which a string has FIRST + MORE;
equal strings are taken by all of them together.

Nothing is capped. A core of very many contexts is dealt to more tasks by slices of
its offsets, as equal strings have equal offsets; a task merges a slice in pieces
of bounded size. Texts travel once (to their chunk list), those with repeated
cores a second time.

Edge cases: null texts are empty; texts shorter than `length` lose nothing;
copies of a row are documents of their own (and remove each other, as judged
on the input); repeated ids are rows of their own; empty tables give no rows;
columns other than doc_id and text are not read. A very long text is worked on in
numpy with some 50 bytes of memory a byte, by one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rolling, in_arrow, map_batches, materialize, mix64, placed, table, text_slices, width

U = np.uint64
GRAM, CHUNK = 24, 96
FIRST, MORE = 2, 1  #: symbols of the first `least` bytes, and of the rest
SHARDS = 2
STRINGS = 250_000  #: strings merged at a time
HOT = 2000  #: occurrences of a core from which its offsets are dealt to more tasks
EMPTY = hashlib.sha256(b"").hexdigest()


def chunks(raw: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(key, first start, last start, offset of the first start from its anchor) of each chunk of a text."""
    n = len(raw)
    if n < least:
        return None
    rolling = Rolling(raw)
    grams = rolling.every(GRAM)
    bits = U(n.bit_length())
    low = grams >> bits << bits | np.arange(len(grams), dtype=U)
    window, size = least - GRAM + 1, 1
    while 2 * size <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    count = n - least + 1
    low = np.minimum(low[:count], low[window - size :][:count])
    anchor = (low & ((U(1) << bits) - U(1))).astype(np.int64)
    offset = anchor - np.arange(count)
    part = offset // CHUNK
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])))
    last = np.append(first[1:], count) - 1
    anchor, part = anchor[first], part[first]
    core = rolling(anchor - part * CHUNK, least - CHUNK + 1)
    key = mix64(core ^ mix64(grams[anchor] + part.astype(U)))
    return key, first, last, offset[first]


def profile(documents: DataFrame, least: int) -> DataFrame:
    """q_file, q_row, doc_id, n_bytes, sha256, the distinct chunk keys of every document and which of them it has twice."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n, digest, keys, twice = [], [], [], []
        for text in text_slices(batch.column("text")):
            text = text or b""
            found = chunks(np.frombuffer(text, np.uint8), least)
            own, times = (np.empty(0, np.int64),) * 2 if found is None else np.unique(found[0].view(np.int64), return_counts=True)
            n.append(len(text))
            digest.append(hashlib.sha256(text).hexdigest())
            keys.append(own)
            twice.append(times > 1)
        more = [pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(twice, pa.list_(pa.bool_()))]
        names = ["q_file", "q_row", "doc_id"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), *more], [*names, "n_bytes", "sha256", "keys", "twice"])

    return map_batches(documents.select("q_file", "q_row", "doc_id", "text"), run, "q_file long, q_row long, doc_id long, n_bytes long, sha256 string, keys array<bigint>, twice array<boolean>")


def contexts(chosen: DataFrame, least: int, length: int) -> DataFrame:
    """(key, shard, context, starts, offset, at): at packs the (file, row, first start) of the occurrences of a context that a task holds together. A hot core has a key for each slice of its offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int, int, bytes], list[int]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            keys, shards, offsets, starts, text = zip(*held, strict=True)
            at = [np.array(x, "<i8").tobytes() for x in held.values()]
            columns = [pa.array(keys, pa.int64()), *(pa.array(x, pa.int32()) for x in (shards, offsets, starts)), pa.array(text, pa.binary()), pa.array(at, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["key", "shard", "offset", "starts", "context", "at"])

        for batch in batches:
            for file, row, text, keys, slices in zip(*(batch.column(x).to_pylist() for x in ("q_file", "q_row")), text_slices(batch.column("text")), batch.column("keys"), batch.column("slices"), strict=True):
                key, first, last, offset = chunks(np.frombuffer(text, np.uint8), least)
                wanted, parts = keys.values.to_numpy(zero_copy_only=False), slices.values.to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(wanted, key.view(np.int64)), len(wanted) - 1)
                mine = np.flatnonzero(wanted[at] == key.view(np.int64))
                shard = (file ^ row) % SHARDS
                for k, a, b, o, p in zip(key[mine].view(np.int64).tolist(), first[mine].tolist(), last[mine].tolist(), offset[mine].tolist(), parts[at[mine]].tolist(), strict=True):
                    step = -(-CHUNK // p)
                    while a <= b:  # offsets fall by one from start to start
                        end = b if p == 1 else min(b, a + o % CHUNK % step)
                        name = k if p == 1 else int(mix64(np.array([(k & (1 << 64) - 1) ^ (o % CHUNK // step + 1)], U)).view(np.int64)[0])
                        found = held.setdefault((name, shard, o, end - a + 1, text[a : end + length]), [])
                        size += 24 + (0 if found else end - a + length)
                        found += (file, row, a)
                        o -= end + 1 - a
                        a = end + 1
                if size > 16 << 20:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    return in_arrow(chosen, run, "key long, shard int, offset int, starts int, context binary, at binary")


class Transform:
    """A multi-string Burrows-Wheeler transform in suffix order: symbols before each suffix (0 ends a string), its string and its place in it."""

    def __init__(self, symbols: np.ndarray, string: np.ndarray, at: np.ndarray, strings: int):
        self.symbols, self.string, self.at, self.strings = symbols, string, at, strings


def transform(symbols: np.ndarray, first: int) -> Transform:
    """Of strings of equal length, numbered from `first`. Suffixes are ranked by prefixes of doubling length, ties by string."""
    m, depth = symbols.shape
    rank = np.hstack([symbols.astype(np.int64), np.zeros((m, 1), np.int64)])
    step = 1
    while step <= depth:
        after = np.zeros_like(rank)
        after[:, :-step] = rank[:, step:]
        _, dense = np.unique((rank * (int(after.max(initial=0)) + 1) + after).ravel(), return_inverse=True)
        rank = dense.reshape(rank.shape)
        step *= 2
    order = np.argsort(rank.ravel(), kind="stable")
    string, at = order // (depth + 1), order % (depth + 1)
    before = np.where(at > 0, symbols[string, np.maximum(at - 1, 0)], 0)
    return Transform(before, string + first, at, m)


def merge(a: Transform, b: Transform, depth: int) -> tuple[Transform, np.ndarray]:
    """Both as one, in the order of `depth` symbols, and each suffix's common prefix with the one before, up to depth."""
    n, ends = len(a.symbols) + len(b.symbols), a.strings + b.strings
    z = np.repeat([False, True], [len(a.symbols), len(b.symbols)])
    group = np.zeros(n, np.int64)
    common = np.full(n, depth, np.int64)
    symbol = np.empty(n, a.symbols.dtype)
    end_z = np.repeat([False, True], [a.strings, b.strings])
    for k in range(1, depth + 1):
        symbol[~z], symbol[z] = a.symbols, b.symbols
        inner = np.flatnonzero(symbol)
        inner = inner[np.argsort(symbol[inner], kind="stable")]
        edge = np.ones(n, bool)
        s, g = symbol[inner], group[inner]
        edge[ends + 1 :] = (s[1:] != s[:-1]) | (g[1:] != g[:-1])
        before = z
        z = np.concatenate([end_z, z[inner]])
        common[edge & (common == depth)] = k - 1
        group = np.cumsum(edge)
        if k > 1 and len(inner) == n - ends and group[-1] == n and (z == before).all():
            break
    both = []
    for x, y in ((a.symbols, b.symbols), (a.string, b.string), (a.at, b.at)):
        whole = np.empty(n, x.dtype)
        whole[~z], whole[z] = x, y
        both.append(whole)
    return Transform(*both, ends), common


def repeated(symbols: np.ndarray, weight: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which strings occur with a total weight of 2 or more by their first FIRST symbols, and which by all, from merging the shards' transforms."""
    m, depth = symbols.shape
    _, dense = np.unique(symbols.ravel(), return_inverse=True)
    order = np.argsort(shard, kind="stable")
    dense, weight = (dense.reshape(m, depth) + 1)[order], weight[order]
    cuts = np.searchsorted(shard[order], np.arange(SHARDS + 1))
    parts = [transform(dense[x:y], x) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    while len(parts) > 1:
        merged = [merge(parts[i], parts[i + 1], depth) for i in range(0, len(parts), 2)]
        parts = [x for x, _ in merged]
    whole, common = parts[0], merged[0][1]
    string = whole.string[at := whole.at == 0]
    out = []
    for prefix in (FIRST, depth):
        interval = np.cumsum(common < prefix)[at]
        total = np.bincount(interval, weights=weight[string], minlength=1)
        found = np.zeros(m, bool)
        found[order[string]] = total[interval] >= 2
        out.append(found)
    return out[0], out[1]


def symbol_rows(texts: list[bytes], which: np.ndarray, start: np.ndarray, least: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of the string at start[i] in texts[which[i]], which of them are whole); which: ascending. A string that its text ends too soon has symbols of its own for what lacks."""
    one, two = -(-least // FIRST), -(-(length - least) // MORE)
    places = [(min(k * one, least - one), one) for k in range(FIRST)] + [(min(least + k * two, length - two), two) for k in range(MORE)]
    out = np.empty((len(which), FIRST + MORE), U)
    sizes = np.array([len(t) for t in texts])
    whole = start + length <= sizes[which]
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= 1 << 21):
            size += len(texts[hi])
            hi += 1
        rolling = Rolling(np.frombuffer(b"".join(texts[lo:hi]), np.uint8))
        base = np.cumsum([0, *map(len, texts[lo:hi])])
        i, j = np.searchsorted(which, [lo, hi])
        at = base[which[i:j] - lo] + start[i:j]
        for k, (place, piece) in enumerate(places[:FIRST]):
            out[i:j, k] = rolling(at + place, piece)
        fit = whole[i:j]
        out[i:j, FIRST:] = mix64(np.arange(i, j, dtype=U) + U(1 << 40))[:, None]
        for k, (place, piece) in enumerate(places[FIRST:], FIRST):
            out[i:j, k][fit] = rolling(at[fit] + place, piece)
        lo = hi
    return out, whole


def judge(texts: list[bytes], offsets: list[int], starts: list[int], weights: list[int], shards: list[int], least: int, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context, which of its starts repeat at `least` bytes, and which at `length`."""
    n = np.array(starts)
    if n.sum() <= STRINGS:
        slices = [(np.zeros(len(n), np.int64), n)]
    else:  # equal strings have equal offsets: offset - start
        first, top = np.array(offsets), max(offsets)
        slices, hi = [], top + 1
        floor = min(o - k + 1 for o, k in zip(offsets, n.tolist(), strict=True))
        step = max(1, STRINGS // len(n))
        while hi > floor:
            lo = hi - step
            a, b = np.clip(first - hi + 1, 0, n), np.clip(first - lo + 1, 0, n)
            slices.append((a, b))
            hi = lo
    out = [(np.zeros(k, bool), np.zeros(k, bool)) for k in n]
    weight, shard = np.array(weights), np.array(shards)
    for a, b in slices:
        size = b - a
        which = np.repeat(np.arange(len(n)), size)
        if not len(which):
            continue
        start = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + a[which]
        symbols, whole = symbol_rows(texts, which, start, least, length)
        short, long = repeated(symbols, weight[which], shard[which])
        found = short, long & whole
        at = 0
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            for mine, all_ in zip(out[i], found, strict=True):
                mine[x:y] = all_[at : at + y - x]
            at += y - x
    return out


def spans(met: DataFrame, least: int, length: int) -> DataFrame:
    """(q_file, q_row, level, first, last) of every run of repeated starts: level 1 at `least`, 2 at `length` bytes; bytes first..last-1 are covered. met: contexts, those of one key together and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        pending: list[dict] = []  # groups that wait for a merge
        waiting = held = 0

        def emit(at: np.ndarray, starts: np.ndarray, level: int) -> None:
            nonlocal held
            size = least if level == 1 else length
            k = np.flatnonzero(starts)
            if len(k):
                cut = np.flatnonzero(np.diff(k) > size)
                for x, y in zip(k[np.append(0, cut + 1)], k[np.append(cut, len(k) - 1)], strict=True):
                    rows.append(np.column_stack([at[:, 0], at[:, 1], np.full(len(at), level), at[:, 2] + x, at[:, 2] + y + size]))
                    held += len(at)

        def settle() -> None:
            nonlocal pending, waiting
            if pending:
                flat = [(text, o, n, len(at), shard, at) for group in pending for (shard, o, n, text), at in group.items()]
                for (*_, at), found in zip(flat, judge(*([x[k] for x in flat] for k in range(5)), least, length), strict=True):
                    for level, starts in enumerate(found, 1):
                        emit(at, starts, level)
                pending, waiting = [], 0

        def close(group: dict[tuple[int, int, int, bytes], list[bytes]]) -> None:
            nonlocal waiting
            whole = {k: np.frombuffer(b"".join(v), "<i8").reshape(-1, 3) for k, v in group.items()}
            one = {k[1:] for k in whole}
            if len(one) == 1:  # nothing to compare
                ((_, n, text),) = one
                if sum(map(len, whole.values())) > 1:
                    for at in whole.values():
                        emit(at, np.ones(n, bool), 1)
                        emit(at, np.arange(n) + length <= len(text), 2)
                return
            size = sum(k[2] for k in whole)
            if waiting + size > STRINGS:
                settle()
            pending.append(whole)
            waiting += size
            if size > STRINGS:
                settle()

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal rows, held
            if rows:
                x = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, k])) for k in range(5)], ["q_file", "q_row", "level", "first", "last"])
                rows, held = [], 0

        key, group = None, {}
        for batch in batches:
            for k, shard, o, n, text, at in zip(*(batch.column(x).to_pylist() for x in ("key", "shard", "offset", "starts")), batch.column("context"), batch.column("at"), strict=True):
                if k != key and group:
                    close(group)
                    group = {}
                    if held > 100_000:
                        yield from out()
                key = k
                group.setdefault((shard, o, n, text.as_py()), []).append(at.as_py())
        if group:
            close(group)
        settle()
        yield from out()

    return in_arrow(met, run, "q_file long, q_row long, level long, first long, last long")


def united(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(documents: DataFrame, length: int = 400, least: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed runs, ends exclusive), kept_sha256 and n_repeated (bytes covered by repeats of `least` bytes or more) of every row."""
    spark = documents.sparkSession
    if not CHUNK + GRAM < least < length:
        raise ValueError(f"needs {CHUNK + GRAM} < least < length")
    place = ["q_file", "q_row"]
    numbered = placed(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    docs = materialize(profile(numbered, least), "profiles")
    # Tables are written before joins, so that both sides are plain exchanges and a hot key's rows can be split.
    copies = materialize(docs.groupBy("sha256").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha256").alias("of"), "first"), "copies")
    known = docs.drop("keys", "twice").join(copies, F.col("sha256") == F.col("of"), "left")
    later = known.where(F.struct(*place) != F.col("first")).select(*place)
    keys = docs.select(*place, F.xxhash64("sha256").alias("text_hash"), F.explode(F.arrays_zip("keys", "twice")).alias("x")).select(*place, "text_hash", F.col("x.keys").alias("key"), F.col("x.twice").alias("twice"))
    several = keys.groupBy("key").agg(F.min("text_hash").alias("a"), F.max("text_hash").alias("b"), F.max("twice").alias("inside"), F.count("*").alias("n")).where("inside or a <> b")
    slices = F.when(F.col("n") < HOT, 1).when(F.col("n") < 8 * HOT, 8).otherwise(CHUNK).cast("int")
    several = materialize(several.select("key", slices.alias("slices")), "several")
    wanted = keys.select(*place, "key").join(several, "key").groupBy(*place).agg(F.array_sort(F.collect_set(F.struct("key", "slices"))).alias("w"))
    wanted = wanted.join(later, place, "left_anti").select(*place, F.col("w.key").alias("keys"), F.col("w.slices").alias("slices"))
    chosen = materialize(numbered.select(*place, "text").join(wanted, place), "chosen")
    met = contexts(chosen, least, length).repartition(width(spark), "key").sortWithinPartitions("key")
    found = spans(met, least, length).groupBy(*place).agg(F.collect_list(F.struct("level", "first", "last")).alias("runs"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for text, runs in zip(text_slices(batch.column("text")), batch.column("runs").to_pylist(), strict=True):
            short, long = (united([(r["first"], r["last"]) for r in runs if r["level"] == level]) for level in (1, 2))
            rest, at = [], 0
            for a, b in long:
                rest.append(text[at:a])
                at = b
            kept = b"".join([*rest, text[at:]])
            out.append((len(text) - len(kept), [{"first": a, "last": b} for a, b in long], hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in short)))
        removed, cut, digest, covered = zip(*out, strict=True)
        types = [pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([*map(batch.column, place), *(pa.array(x, t) for x, t in zip((removed, cut, digest, covered), types, strict=True))], [*place, "removed", "cut", "kept", "covered"])

    changed = map_batches(chosen.select(*place, "text").join(found, place), run, "q_file long, q_row long, removed long, cut array<struct<first:bigint,last:bigint>>, kept string, covered long")
    n, copied = F.col("n_bytes"), F.col("of").isNotNull()
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), n.alias("last")))
    gone, known_to_repeat = copied & (n >= length), copied & (n >= least)
    return known.join(changed, place, "left").select(
        "doc_id",
        "n_bytes",
        F.when(gone, n).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, whole).otherwise(F.coalesce("cut", none)).alias("spans"),
        F.when(gone, EMPTY).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
        F.when(known_to_repeat, n).otherwise(F.coalesce("covered", F.lit(0))).cast("long").alias("n_repeated"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "n_repeated")
