"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles. Tokens are hashed into a wide parity
sketch: K blocks of 2**64 bit positions, each token flipping one bit of one block.
The Hamming distance of two sketches is at most the symmetric difference of the
sets, and so is the number of blocks in which they differ. A block is kept as the
XOR of the addresses of its set bits: equal blocks have equal words.

For sets of n and m elements with Jaccard similarity s or more, the symmetric
difference is at most (1 - s) / (1 + s) * (n + m). Documents are dealt into size
bands (by powers of two; one just above a band's edge joins the band below as
well), K following the band. By the pigeonhole principle, a document with more
non-empty blocks than the bound shares a non-empty block with each partner, so
equal (band, block, word) triples yield all candidates. How many blocks a pair
must share follows from the same bound; pairs that share fewer go, the rest are
verified on the full sets.

Hot triples (shared by over `hot` classes: near-copy families, boilerplate) are
not expanded into pairs. A document that has enough other blocks needs none of
them. For the rest, each hot triple links its members to one pivot. Documents that
hot triples join but whose components still differ form families; in a family,
compact bit sketches are compared block by block, and pairs whose Hamming distance
is within the bound are verified. So nothing is capped, and components are exact.

Equal sets are one class from the start: they travel once per task, and a third of
all rows being one text costs no more than one text.

Scale: the triples travel as packed 6-byte words in binary rows; each part of
them is sorted in numpy by one task. Their number follows the counted words of
the corpus, so a part's size doesn't grow with it.

Edge cases: null, empty and wordless texts have an empty set and link with
nothing; fewer words than the shingle's length make one shingle; repeated ids are
documents of their own; null ids get no component; ties cannot arise; other columns
are ignored; an empty table gives no rows. A very long text is hashed in numpy
with some 50 bytes of memory a byte, by one task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, components, in_arrow, map_batches, materialize, mix64, pieces, placed, scratch, stored, table, text_slices, width, word_hashes

U = np.uint64
#: Odd multipliers of a word's place in its shingle.
PLACE = mix64(np.arange(1, 65, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
PART_ROW = struct.Struct("<II")


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    w, counts = word_hashes(texts)
    rolled = np.zeros(max(len(w) - size + 1, 0), U)
    for j in range(size):
        rolled += w[j : j + len(rolled)] * PLACE[j]
    rolled = mix64(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(rolled[at : at + n - size + 1]))
        elif n:
            out.append(mix64((w[at : at + n] * PLACE[:n]).sum(keepdims=True, dtype=U) ^ U(n)))
        else:
            out.append(np.empty(0, U))
        at += n
    return out


def class_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    a, b = mix64(s ^ U(0x5851F42D4C957F2D)), mix64(s + U(0x14057B7EF767814F))
    return int(a.sum(dtype=U).view(np.int64)), int((b.sum(dtype=U) ^ U(len(s))).view(np.int64))


class Bands:
    """Size bands and bounds for a similarity of num / den or more."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def of(self, n: int) -> list[int]:
        """The band of n, and the one below if a partner may lie there; sets of 1 or 2 (and all that only an equal set can match) need none."""
        if n < 2 or self.bound(n, n * self.den // self.num) == 0:
            return []
        band = n.bit_length() - 1
        below = (1 << band) - 1
        return [band, band - 1] if below * self.den >= n * self.num and band else [band]

    def bound(self, n: int, m: int) -> int:
        return (self.den - self.num) * (n + m) // (self.den + self.num)

    def most(self, n: int, band: int) -> int:
        """The largest symmetric difference with a partner whose pair meets in the band (that of the smaller set)."""
        m = n * self.den // self.num if band == n.bit_length() - 1 else (2 << band) - 1
        return self.bound(n, m)

    def blocks(self, band: int) -> int:
        return (1 << band) if band >= 6 else (4 << band)


def block_words(s: np.ndarray, band: int, n_blocks: int) -> np.ndarray:
    """One 64-bit value for each non-empty (band, block, word)."""
    block = ((mix64(s ^ U(0xD1342543DE82EF95)) >> U(32)) * U(n_blocks)) >> U(32)
    order = np.argsort(block)
    block = block[order]
    starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    word = np.bitwise_xor.reduceat(mix64(s + U(0x2545F4914F6CDD1D))[order], starts)
    return mix64(word ^ mix64((block[starts] + U(1)) * U(64) + U(band)))


def document_classes(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, q_file, q_row (the row's place), n and k1, k2 (class key). documents: placed."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j in pieces(batch.column("text"), 1 << 20):
            rows = []
            for s in shingle_sets(list(text_slices(batch.column("text").slice(i, j - i))), size):
                rows.append((len(s), *class_key(s)))
            n, k1, k2 = zip(*rows, strict=True)
            own = ["doc_id", "q_file", "q_row"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(i, j - i) for x in own), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], [*own, "n", "k1", "k2"])

    return map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "q_file", "q_row", "text"), run, "doc_id long, q_file long, q_row long, n long, k1 long, k2 long")


def pack(entries: list[tuple[int, int, int, int, int]], words: list[np.ndarray], parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, blob): an entry is (k1, k2, n, band, blocks used); its words go to parts by value."""
    counts = np.array([len(x) for x in words])
    value, entry = np.concatenate(words), np.repeat(np.arange(len(words), dtype=np.uint32), counts)
    part = (value % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    value, entry, part = value[order], entry[order], part[order]
    table_ = np.array([e[:2] for e in entries], np.int64)
    n = np.array([e[2:] for e in entries], np.uint32)
    cuts = np.searchsorted(part, np.arange(parts + 1))
    for p in range(parts):
        lo, hi = cuts[p], cuts[p + 1]
        if lo == hi:
            continue
        here = entry[lo:hi]
        starts = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
        mine = here[starts]
        v = value[lo:hi] >> U(16)
        yield (
            p,
            PART_ROW.pack(len(mine), hi - lo)
            + table_[mine].tobytes()
            + n[mine].tobytes()
            + np.diff(np.append(starts, hi - lo)).astype(np.uint32).tobytes()
            + (v & U(0xFFFFFFFF)).astype(np.uint32).tobytes()
            + (v >> U(32)).astype(np.uint16).tobytes(),
        )


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(class keys, (n, band, blocks used), words, entry of each word)."""
    m, count = PART_ROW.unpack_from(blob)
    at = PART_ROW.size
    keys = np.frombuffer(blob, np.int64, 2 * m, at).reshape(m, 2)
    n = np.frombuffer(blob, np.uint32, 3 * m, at := at + 16 * m).reshape(m, 3)
    each = np.frombuffer(blob, np.uint32, m, at := at + 12 * m)
    low = np.frombuffer(blob, np.uint32, count, at := at + 4 * m)
    high = np.frombuffer(blob, np.uint16, count, at + 4 * count)
    return keys, n, low.astype(U) | high.astype(U) << U(32), np.repeat(np.arange(m, dtype=np.int32), each)


def packed_words(documents: DataFrame, size: int, bands: Bands, parts: int, flush: int = 1 << 20) -> DataFrame:
    """(part, blob): the sketches of all distinct sets that a task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        entries, words, held = [], [], 0

        def out() -> pa.RecordBatch:
            part, blob = zip(*pack(entries, words, parts), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(blob, pa.binary())], ["part", "blob"])

        for batch in batches:
            for i, j in pieces(batch.column("text"), 1 << 20):
                for s in shingle_sets(list(text_slices(batch.column("text").slice(i, j - i))), size):
                    of = bands.of(len(s))
                    if not of:
                        continue
                    key = class_key(s)
                    if key in met:
                        continue
                    if len(met) > 1_000_000:  # later copies are dropped where they meet
                        met.clear()
                    met.add(key)
                    for band in of:
                        w = block_words(s, band, bands.blocks(band))
                        used = len(w)
                        if len(w) <= bands.most(len(s), band):  # too few blocks for the pigeonholes: all such meet
                            w = np.append(w, mix64(np.array([band], U)))
                        entries.append((*key, len(s), band, used))
                        words.append(w)
                        held += len(w)
                    if held >= flush:
                        yield out()
                        entries, words, held = [], [], 0
        if held:
            yield out()

    return in_arrow(documents.select("text"), run, "part int, blob binary")


FOUND = "kind int, a1 long, a2 long, b1 long, b2 long, triple long, band int, shared long, na long, ua long, nb long, ub long"


def match_part(blobs: list[bytes], part: int, hot: int, bands: Bands) -> pa.RecordBatch | None:
    """Pairs and how many triples they share (kind 0), pivot pairs (1) and members of hot triples (2) of one part."""
    keys, n, words, entry, base = [], [], [], [], 0
    for blob in blobs:
        k, m, w, e = unpack(blob)
        keys.append(k), n.append(m), words.append(w), entry.append(e + np.int32(base))
        base += len(k)
    keys, n = np.concatenate(keys), np.concatenate(n).astype(np.int64)
    words, entry = np.concatenate(words), np.concatenate(entry)
    order = np.argsort(words)
    words = words[order]
    same = words[1:] == words[:-1]
    keep = np.append(same, False) | np.append(False, same)
    words, entry = words[keep], entry[order[keep]]
    del order, same, keep
    if not len(words):
        return None
    # the same class from several tasks is one entry; entries are numbered in the order of their keys
    _, first, number = np.unique(np.ascontiguousarray(np.column_stack([keys, n[:, 1]])).view("V24").ravel(), return_index=True, return_inverse=True)
    keys, n = keys[first], n[first]
    entry = number[entry]
    order = np.lexsort((entry, words))
    words, entry = words[order], entry[order]
    new = np.append(True, (words[1:] != words[:-1]) | (entry[1:] != entry[:-1]))
    words, entry = words[new], entry[new]
    starts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
    sizes = np.diff(np.append(starts, len(words)))
    pairs = []
    for size in range(2, hot + 1):
        at = starts[sizes == size]
        if len(at):
            group = entry[at[:, None] + np.arange(size)]
            i, j = np.triu_indices(size, 1)
            pairs.append(np.column_stack([group[:, i].ravel(), group[:, j].ravel()]))
    rows = []
    large = sizes > hot
    member = np.repeat(large, sizes)
    h_entry = entry[member]
    h_triple = (words[member] << U(16) | U(part & 0xFFFF)).view(np.int64)
    pivot = np.repeat(entry[starts[large]], sizes[large])
    none = np.empty((0, 2), np.int64)
    for kind, p in ((0, np.concatenate(pairs) if pairs else none), (1, np.column_stack([pivot, h_entry]))):
        p = p[p[:, 0] != p[:, 1]]
        least, most = np.minimum(n[p[:, 0], 0], n[p[:, 1], 0]), np.maximum(n[p[:, 0], 0], n[p[:, 1], 0])
        code, shared = np.unique((p[:, 0] * len(keys) + p[:, 1])[least * bands.den >= most * bands.num], return_counts=True)
        rows.append((np.full(len(code), kind), code // len(keys), code % len(keys), np.zeros(len(code), np.int64), shared))
    rows.append((np.full(len(h_entry), 2), h_entry, h_entry, h_triple, np.zeros(len(h_entry), np.int64)))
    kind, a, b, triple, shared = (np.concatenate([r[k] for r in rows]) for k in range(5))
    columns = [kind.astype(np.int32), keys[a, 0], keys[a, 1], keys[b, 0], keys[b, 1], triple, n[a, 1].astype(np.int32), shared, n[a, 0], n[a, 2], n[b, 0], n[b, 2]]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], [x.split()[0] for x in FOUND.split(", ")])


def candidates(packed: DataFrame, parts: int, hot: int, bands: Bands) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
                if p != part and held:
                    if (out := match_part(held, part, hot, bands)) is not None:
                        yield out
                    held = []
                part = p
                held.append(blob.as_py())
        if held and (out := match_part(held, part, hot, bands)) is not None:
            yield out

    return in_arrow(packed.repartitionById(parts, F.col("part")).sortWithinPartitions("part"), run, FOUND)


def bit_sketch(s: np.ndarray) -> bytes:
    """Parity bits, four or more for each element: the Hamming distance of two sketches of one length is at most the sets' symmetric difference."""
    bits = max(256, 4 << max(len(s), 1).bit_length() - 1)
    return np.packbits(np.bincount((s % U(bits)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def fold(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches shortened to `words` words: positions are residues, so halves are XORed."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def near_pairs(left: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], right: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], bands: Bands) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of left, of right) in different components whose sizes fit and whose sketches are within the bound. Entries: (words, sketches, (n, component), row)."""
    for words_l, a, info_a, row_a in left:
        for words_r, b, info_b, row_b in right:
            words = min(words_l, words_r)
            if max(words_l, words_r) > 2 * words:  # sizes in ratio 2 or more
                continue
            x, y = fold(a, words), fold(b, words)
            step = max(1, (1 << 21) // max(1, len(y) * words))
            for k in range(0, len(x), step):
                n, m = info_a[k : k + step, 0][:, None], info_b[:, 0][None]
                fit = (np.minimum(n, m) * bands.den >= np.maximum(n, m) * bands.num) & (info_a[k : k + step, 1][:, None] != info_b[:, 1][None]) & (row_a[k : k + step][:, None] != row_b[None])
                if fit.any():
                    far = np.bitwise_count(x[k : k + step][:, None] ^ y[None]).sum(2, dtype=np.int64)
                    i, j = np.nonzero(fit & (far <= (bands.den - bands.num) * (n + m) // (bands.den + bands.num)))
                    yield row_a[k : k + step][i], row_b[j]


def family_pairs(members: DataFrame, bands: Bands, block: int = 2048) -> DataFrame:
    """Candidate pairs across the components of each family, by bit sketches, a block of rows against a block.

    members: k1, k2, n, family, component, sketch. A block is about `block` rows whatever the family's size; a family of many blocks is spread over their pairs.
    """
    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count_distinct("component").alias("c")).where("c > 1").drop("c")
    dealt = members.join(sizes, "family").withColumn("b", F.pmod(F.xxhash64("k1", "k2"), F.col("blocks").cast("long")).cast("int"))
    paired = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("b", "o")).withColumn("j", F.greatest("b", "o"))
    columns = ["family", "i", "j", "b", "k1", "k2", "n", "component", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: list[dict], i: int, j: int) -> Iterator[pa.RecordBatch]:
            keys = np.array([(r["k1"], r["k2"]) for r in rows], np.int64)
            sides = []
            for b in (i, j):
                by: dict[int, list[int]] = {}
                for k, r in enumerate(rows):
                    if r["b"] == b:
                        by.setdefault(len(r["sketch"]) // 8, []).append(k)
                sides.append([(w, np.array([np.frombuffer(rows[k]["sketch"], U) for k in ks]), np.array([(rows[k]["n"], rows[k]["component"]) for k in ks], np.int64), np.array(ks)) for w, ks in by.items()])
            for x, y in near_pairs(*sides, bands):
                if i == j:
                    half = x < y
                    x, y = x[half], y[half]
                a, b = keys[x], keys[y]
                turn = (a[:, 0] > b[:, 0]) | (a[:, 0] == b[:, 0]) & (a[:, 1] > b[:, 1])
                a[turn], b[turn] = b[turn].copy(), a[turn].copy()
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (a[:, 0], a[:, 1], b[:, 0], b[:, 1])], ["a1", "a2", "b1", "b2"])

        held, key = [], None
        for batch in batches:
            for r in batch.to_pylist():
                now = (r["family"], r["i"], r["j"])
                if now != key and held:
                    yield from close(held, key[1], key[2])
                    held = []
                key = now
                held.append(r)
        if held:
            yield from close(held, key[1], key[2])

    dealt_out = paired.select(*columns).repartition(width(members.sparkSession), "family", "i", "j").sortWithinPartitions("family", "i", "j")
    return in_arrow(dealt_out, run, "a1 long, a2 long, b1 long, b2 long")


def similar(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a1, a2, b1, b2) that link, as edges (a, b) of representatives."""
    a = sets.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("rep").alias("a"), F.col("s").alias("sa"))
    b = sets.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("rep").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    either = F.size("sa") + F.size("sb") - both
    return pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).where(both * bands.den >= either * bands.num).select("a", "b")


def linked_rows(documents: DataFrame, size: int = 5, num: int = 75, den: int = 100, hot: int = 16, part_words: int = 1 << 21) -> DataFrame:
    """doc_id, q_file, q_row (the row's place), n and component (the smallest doc_id that links reach) of every row. documents: placed."""
    spark = documents.sparkSession
    bands = Bands(num, den)
    docs, seen = stored(document_classes(documents, size), scratch(spark, "classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
    # written, so that the last join is between plain exchanges and the copies of one set can be split over tasks
    first = F.min(F.struct("doc_id", "q_file", "q_row"))
    classes = materialize(docs.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(first.alias("first")).select("k1", "k2", "first.*").withColumnRenamed("doc_id", "rep"), "reps")
    parts = max(8, width(spark) // 2, -(-seen["words"] // part_words))  # so many that a part's words fit a task whatever the input
    found = materialize(candidates(packed_words(documents, size, bands, parts), parts, hot, bands), "found")

    # A document with u non-empty blocks, h of them hot, shares u - h - bound cold ones with each partner, or more.
    # Where that is not over 0, its hot triples are needed.
    bound = lambda n, m: F.floor((den - num) * (n + m) / (den + num))
    n, band = F.col("na"), F.col("band")
    partner = F.when(n < F.expr("shiftleft(2L, band)"), F.expr(f"na * {den} div {num}")).otherwise(F.expr("shiftleft(2L, band) - 1"))
    members = found.where("kind = 2").select(F.col("a1").alias("k1"), F.col("a2").alias("k2"), "band", "triple", "na", "ua")
    heat = materialize(members.groupBy("k1", "k2", "band").agg(F.count("*").alias("hot"), F.first("na").alias("na"), F.first("ua").alias("ua")), "heat")
    needy = heat.where(F.col("ua") - F.col("hot") <= bound(n, partner)).join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select("k1", "k2", "band", "rep", F.col("na").alias("n"))
    members = materialize(members.select("k1", "k2", "band", "triple").join(needy, ["k1", "k2", "band"]), "members")

    pairs = found.where("kind = 0").groupBy("a1", "a2", "b1", "b2", "band").agg(F.sum("shared").alias("shared"), *[F.first(c).alias(c) for c in ("na", "ua", "nb", "ub")])
    warm = heat.select("k1", "k2", "band", "hot")
    pairs = pairs.join(warm.toDF("a1", "a2", "band", "ha"), ["a1", "a2", "band"], "left").join(warm.toDF("b1", "b2", "band", "hb"), ["b1", "b2", "band"], "left")
    cold = F.greatest(F.col("ua") - F.coalesce("ha", F.lit(0)), F.col("ub") - F.coalesce("hb", F.lit(0)))
    pairs = pairs.where(F.col("shared") >= cold - bound(F.col("na"), F.col("nb"))).select("a1", "a2", "b1", "b2")
    pivots = found.where("kind = 1").select("a1", "a2", "b1", "b2").distinct()
    needed = members.select(F.col("k1").alias("b1"), F.col("k2").alias("b2")).distinct()
    pivots = pivots.join(needed, ["b1", "b2"], "left_semi").select("a1", "a2", "b1", "b2")
    pairs = materialize(pairs.unionByName(pivots).distinct(), "pairs")

    keys = pairs.select(F.col("a1").alias("k1"), F.col("a2").alias("k2")).unionByName(pairs.select(F.col("b1").alias("k1"), F.col("b2").alias("k2"))).unionByName(members.select("k1", "k2")).distinct()
    chosen = documents.select("q_file", "q_row", "text").join(keys.join(classes, ["k1", "k2"]), ["q_file", "q_row"])

    def expand(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j in pieces(batch.column("text"), 1 << 20):
            some = batch.slice(i, j - i)
            sets = shingle_sets(list(text_slices(some.column("text"))), size)
            yield pa.RecordBatch.from_arrays([*map(some.column, ("k1", "k2", "rep")), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(map(bit_sketch, sets), pa.binary())], ["k1", "k2", "rep", "s", "sketch"])

    sets = materialize(map_batches(chosen.select("k1", "k2", "rep", "text"), expand, "k1 long, k2 long, rep long, s array<bigint>, sketch binary"), "sets")
    edges = materialize(similar(pairs, sets, bands), "links")
    reach = components(edges)

    # members of hot triples that lie in more than one component
    lying = members.join(reach, members.rep == reach.node, "left").withColumn("component", F.coalesce("component", "rep"))
    split = lying.groupBy("triple").agg(F.min("rep").alias("first"), F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("triple", "first")
    open_ = materialize(members.join(split, "triple").select("first", "rep").distinct(), "open")
    if not open_.isEmpty():
        families = components(open_, "first", "rep")
        one = members.select("k1", "k2", "rep", "n").distinct().join(families, F.col("rep") == F.col("node")).withColumnRenamed("component", "family").drop("node")
        one = one.join(reach, F.col("rep") == F.col("node"), "left").select("k1", "k2", "rep", "n", "family", F.coalesce("component", "rep").alias("component"))
        more = family_pairs(one.join(sets.select("k1", "k2", "sketch"), ["k1", "k2"]), bands)
        links = materialize(similar(more.distinct(), sets, bands), "links")
        if not links.isEmpty():
            reach = components(edges.unionByName(links))

    out = docs.join(classes.select("k1", "k2", "rep"), ["k1", "k2"], "left").join(reach, F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", "q_file", "q_row", "n", F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component"))


def jaccard_components(documents: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    found = linked_rows(placed(documents.select("doc_id", "text")), **how)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The first row of each component, by doc_id and place; documents without words, and those without an id, stay."""
    safe = placed(aside(documents, "doc_id", "text"))
    rows = materialize(linked_rows(safe).where("n > 0 and doc_id is not null"), "linked")
    firsts = materialize(rows.groupBy("component").agg(F.min(F.struct("doc_id", "q_file", "q_row")).alias("first")), "firsts")
    gone = rows.join(firsts, "component").where(F.struct("doc_id", "q_file", "q_row") != F.col("first")).select("q_file", "q_row")
    left = safe.join(materialize(gone, "gone"), ["q_file", "q_row"], "left_anti")
    return left.select(*safe.columns[:-2]).toDF(*documents.columns)


OP3_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') k from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
c as (select a.doc_id a, b.doc_id b, count(*) both_ from s a join s b on a.k = b.k and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_ >= 75 * (x.n + y.n - both_)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id a, doc_id b from n union select r.a, e.b from r join e on r.b = e.a),
m as (select a, min(b) m from r group by a)
select w.doc_id, cast(coalesce(n, 0) as bigint) n_shingles, coalesce(m, w.doc_id) component_id from w left join n using (doc_id) left join m on m.a = w.doc_id
"""
