"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. Where two fingerprints differ
in at most two bits, one segment at least is the same in both, and the next one
differs in at most two bits. The Golay code is perfect: every 23-bit word lies
within three bits of exactly one codeword. The codewords next to a segment and
to its 23 neighbours number six at most, and two segments that differ in at most
two bits share one. So a key is a whole segment with one of the codeword indices
of the next; fingerprints meet on a key and are verified by their bits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Kept
from .common import components, dropped, map_arrow, written

SEED = 42
# Fixed value: the generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
SEGMENTS = (22, 21, 21)
LINK = 2
#: Fingerprints on a key up to which they are compared with one another; beyond it they are linked by the words between them.
MEET = 128


@functools.cache
def golay_parity() -> np.ndarray:
    """The 11 check bits of each 12-bit message."""
    out = np.zeros(4096, np.int64)
    for message in range(4096):
        rest = message << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        out[message] = rest
    return out


@functools.cache
def golay_errors() -> np.ndarray:
    """The one error of at most three bits that each syndrome stands for."""
    parity, out = golay_parity(), np.zeros(2048, np.int64)
    bits = [1 << k for k in range(23)]
    errors = [0, *bits, *(a | b for a in bits for b in bits if a < b), *(a | b | c for a in bits for b in bits if a < b for c in bits if b < c)]
    for e in errors:
        out[parity[e >> 11] ^ (e & 2047)] = e
    return out


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The message of the codeword nearest to each 23-bit word."""
    return (words ^ golay_errors()[golay_parity()[words >> 11] ^ (words & 2047)]) >> 11


def near_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the different codeword indices of each word and its 23 neighbours; one to six a word."""
    flips = np.array([0, *(1 << k for k in range(23))], np.int64)
    found = np.sort(codeword_index(words[:, None] ^ flips[None, :]), axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    row, column = np.nonzero(fresh)
    return row, found[row, column]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of 64-bit fingerprints: for each segment, itself with each codeword index of the next."""
    at, parts = 0, []
    for width in SEGMENTS:
        parts.append((prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    rows, keys = [], []
    for k, part in enumerate(parts):
        row, index = near_indices(parts[(k + 1) % len(parts)])
        rows.append(row)
        keys.append((part[row] << 12 | index) << 2 | k)
    return np.concatenate(rows), np.concatenate(keys)


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of the runs of so many words, A-Z lowered, repeats included; of the whole if it has fewer; none without a word."""
    listed = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not listed:
        return np.zeros(0, np.uint64)
    if len(listed) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(listed), SEED)], np.uint64)
    joined, digest = b" ".join(listed), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in listed])
    starts = [0, *ends[: len(listed) - words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print (long) of each row's whole text; null counts as empty, and an empty text has the print zero."""

    def start():
        def run(batch):
            prints = np.array([fingerprint(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

        return run

    return map_arrow(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), start, "doc_id long, print long")


def keys_of(prints: DataFrame) -> DataFrame:
    """key, print: the fuzzy keys of each print."""

    def start():
        def run(batch):
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            row, key = fuzzy_keys(values)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(values[row].view(np.int64))], ["key", "print"])

        return run

    return map_arrow(prints.select("print"), start, "key long, print long")


def differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, meet: int = MEET) -> DataFrame:
    """a, b: links between different prints (one column, distinct) that join whatever differs in at most LINK = 2 bits; written.

    Prints that meet on a key of up to ``meet`` are compared pair by pair.
    Prints on a fuller key are linked by the words between them: two differ in at
    most two bits if and only if some word is within one bit of both, and all
    prints within one bit of a word are linked. A word has 65 such prints at
    most, and a print 65 such words, so a large group of near copies costs in
    proportion to its size.
    """
    keys = written(keys_of(prints), "fuzzy-keys")
    full = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keys.join(full, "key"), "fuzzy-meetings")
    few = met.where(F.col("n") <= meet).select("key", "print")
    a, b = few.toDF("key", "a"), few.toDF("key", "b")
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & (differ(F.col("a"), F.col("b")) <= LINK)).select("a", "b")
    many = met.where(F.col("n") > meet).select("print").distinct()
    near = F.expr("concat(array(0L), transform(sequence(0, 63), k -> shiftleft(1L, k)))")
    words = many.select("print", F.explode(F.transform(near, lambda bit: F.col("print").bitwiseXOR(bit))).alias("word"))
    around = words.groupBy("word").agg(F.array_sort(F.collect_list("print")).alias("all")).where(F.size("all") > 1)
    between = around.select(F.col("all")[0].alias("a"), F.explode(F.slice("all", 2, 64)).alias("b"))
    out = written(pairs.union(between).distinct(), "print-links")
    dropped(keys, met)
    return out


def groups(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", meet: int = MEET) -> DataFrame:
    """doc_id, print, component_id of every row: the smallest id that it reaches over prints that differ in at most two bits.

    Rows of one print are one node, counted before they are shuffled; links,
    components and prints stay distributed. Rows with a null id are linked like
    others, and their component is null only if no id is in it. An empty table
    gives no rows.
    """
    rows = written(fingerprints(docs, words, id_col, text_col), "prints")
    heads = written(rows.groupBy("print").agg(F.min("doc_id").alias("head")), "print-heads")
    found = components(links(heads.select("print"), meet), "print-components").withColumnRenamed("node", "print")
    whole = heads.join(found, "print", "left").select("print", "head", F.coalesce("component", "print").alias("component"))
    least = whole.groupBy("component").agg(F.min("head").alias("component_id"))
    of_print = whole.join(least, "component").select("print", "component_id")
    return rows.join(of_print, "print").select("doc_id", "print", "component_id")


def group_digests(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity. Edits that leave a Jaccard index of 0.8 over five-word
# shingles change too many bits of a fingerprint of shingles for two bits to hold;
# a wide fingerprint of a text's different words changes few.

#: 64-bit words of a wide fingerprint, its tables, and the bits of each that must be the same and that may differ in two.
WIDE, TABLES, WHOLE, FUZZY = 8, 13, 16, 23
#: Differing bits of WIDE * 64 up to which a pair is verified; pairs of similarity 0.8 stay far below it.
APART = 102
SHINGLE, SIMILAR = 5, 0.8
#: Min-hashes of a text's shingles, each held as four bits of a sketch as wide as the fingerprint. A pair of similarity s differs in 256 * (1 - s) of its bits on average.
MINIMA = 128
#: Keys of a text made of its min-hashes, and the minima of each. A pair of similarity 0.8 shares none of them in 7 of 100,000 cases.
BANDS, BAND = 24, 5
#: Pairs of a bucket that are sent on at once.
SENT = 1 << 16
#: Nodes of a bucket, and their shingles, that are gone through at once; larger buckets are cut into blocks.
BLOCK, GRAMS = 2048, 1 << 21


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, SEED)


KNOWN = Kept(word_hash, 50_000)


def wide_print(text: str | None) -> np.ndarray:
    """WIDE words whose bits are set in over half of as many hashes of the text's different words."""
    listed = set((text or "").encode().lower().split())
    hashes = np.fromiter((KNOWN[w] for w in listed), np.uint64, len(listed))
    counts = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        h = hashes[at : at + (1 << 13), None] + np.arange(1, WIDE + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        counts += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little")


def wide_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of wide fingerprints (n, 8 * WIDE bytes): for each table, its whole segment with each codeword index of its fuzzy one."""
    bits = np.unpackbits(prints, axis=1, bitorder="little").astype(np.int64)
    rows, keys = [], []
    for t in range(TABLES):
        at = t * (WHOLE + FUZZY)
        whole = bits[:, at : at + WHOLE] @ (1 << np.arange(WHOLE))
        row, index = near_indices(bits[:, at + WHOLE : at + WHOLE + FUZZY] @ (1 << np.arange(FUZZY)))
        rows.append(row)
        keys.append((whole[row] << 12 | index) << 4 | t)
    return np.concatenate(rows), np.concatenate(keys)


@functools.cache
def minima_seeds() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 64, MINIMA, np.uint64), r.integers(0, 1 << 64, MINIMA, np.uint64) | np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of MINIMA mixings; without a hash, the largest number."""
    flip, by = minima_seeds()
    out = np.full(MINIMA, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 256):
        np.minimum(out, ((hashes[at : at + 256, None] ^ flip) * by).min(axis=0), out=out)
    return out


def sketch(least: np.ndarray) -> np.ndarray:
    """Four bits of each of the minima, as WIDE * 8 bytes: their differing bits tell how far two sets of shingles are apart."""
    bits = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(60)).astype(np.uint8)
    return bits[0::2] | bits[1::2] << 4


def bands(least: np.ndarray) -> np.ndarray:
    """BANDS keys of the minima (int64), each the hash of BAND of them; none is a key of wide_keys, whose last four bits count tables."""
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least[: BANDS * BAND].reshape(BANDS, BAND).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out | np.uint64(15)).view(np.int64)


def spanning(prints: np.ndarray, apart: int) -> list[tuple[int, int]]:
    """The edges of a least spanning forest of fingerprints by differing bits, none over ``apart``.

    Whatever is joined by pairs of at most so many bits is joined by these, and
    each by the nearest pairs there are; n prints give n - 1 edges at most, in
    memory of n.
    """
    n, words = len(prints), prints.view(np.uint64)
    out, far = [], np.full(n, np.iinfo(np.int64).max)
    parent, left, at = np.zeros(n, np.int64), np.ones(n, bool), 0
    for _ in range(n - 1):
        left[at] = False
        d = np.bitwise_count(words ^ words[at]).sum(axis=1, dtype=np.int64)
        closer = left & (d < far)
        far[closer], parent[closer] = d[closer], at
        at = int(np.argmin(np.where(left, far, np.iinfo(np.int64).max)))
        if far[at] <= apart:
            out.append((int(parent[at]), at))
    return out


def bucket_pairs(met: DataFrame, pairs) -> DataFrame:
    """a, b: what ``pairs``, a function of the other columns, gives for each key. ``met`` has key, node and others; a key's rows are brought together and sorted, and only one key's are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        def buckets():
            key, rows = None, []
            for batch in batches:
                for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if k != key:
                        yield rows
                        key, rows = k, []
                    rows.append(row)
            yield rows

        found: dict[tuple[int, int], None] = {}
        for rows in buckets():
            if len(rows) > 1:
                for a, b in pairs(*zip(*rows)):
                    found[min(a, b), max(a, b)] = None
                    if len(found) >= SENT:
                        yield out(found)
                        found = {}
        if found:
            yield out(found)

    return met.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long").distinct()


def stacked(prints) -> np.ndarray:
    return np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)


def bucket_edges(met: DataFrame, apart: int) -> DataFrame:
    """a, b: the spanning edges of each key's nodes. ``met`` has key, node, sketch."""

    def pairs(nodes, prints):
        for i, j in spanning(stacked(prints), apart):
            yield nodes[i], nodes[j]

    return bucket_pairs(met.select("key", "node", "sketch"), pairs)


def near_across(sets: list[np.ndarray], groups: np.ndarray, first: np.ndarray, second: np.ndarray, similarity: float, columns: int = 4096) -> list[tuple[int, int]]:
    """Pairs (place in ``first``, place in ``second``) of sets in different groups whose Jaccard index is ``similarity`` or more, one at most between two groups.

    Only elements that two of the sets hold can be shared; sets are rows of a
    matrix over those, some columns at a time, and its product counts what each
    two share.
    """
    sizes = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.int64)
    different, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    row, column = row[shared], (np.cumsum(often > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(first), len(second)), np.float32)  # exact: no count reaches 2 ** 24
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [at, at + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        both += part[first] @ part[second].T
    either = sizes[first][:, None] + sizes[second][None, :] - both
    i, j = np.nonzero((both >= similarity * either) & (groups[first][:, None] != groups[second][None, :]))
    low, high = np.minimum(groups[first[i]], groups[second[j]]), np.maximum(groups[first[i]], groups[second[j]])
    _, some = np.unique(np.stack([low, high], axis=1), axis=0, return_index=True)
    return [(int(first[x]), int(second[y])) for x, y in zip(i[some], j[some])]


def bucket_rest(rest: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that join the groups of each key's nodes: for any two of its nodes in different groups that are near, one between those groups. ``rest`` has key, node, group, grams (the sorted shingles).

    A key's nodes are dealt into blocks, by their number and their shingles, and
    each two blocks of a key are a task's work, so that no task holds a large
    bucket; no pairs leave it but those that are near.
    """
    size = F.size("grams")
    held = rest.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(size) / GRAMS)).cast("int").alias("blocks"))
    dealt = rest.join(held, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    tiles = tiles.select(tile.alias("key"), "node", "group", (F.col("block") <= F.col("other")).alias("first"), (F.col("block") >= F.col("other")).alias("second"), "grams")

    def pairs(nodes, groups, first, second, grams):
        sets = [np.array(g, np.int64) for g in grams]
        for i, j in near_across(sets, np.array(groups), np.flatnonzero(first), np.flatnonzero(second), similarity):
            yield nodes[i], nodes[j]

    return bucket_pairs(tiles, pairs)


def shingled(whole: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """doc_id, grams: the different shingles of the texts of ``nodes`` (doc_id), rising, written."""

    def start():
        def run(batch):
            sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "grams"])

        return run

    return written(map_arrow(whole.join(nodes, "doc_id"), start, "doc_id long, grams array<long>").dropDuplicates(["doc_id"]), "grams")


def verified(edges: DataFrame, whole: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """a, b, near of each of ``edges``: whether the Jaccard index of the sets of shingles of the two is ``similarity`` or more."""
    ends = edges.select(F.col("a").alias("doc_id")).union(edges.select(F.col("b").alias("doc_id"))).distinct()
    grams = shingled(whole, ends, shingle)
    left, right = grams.toDF("a", "x"), grams.toDF("b", "y")
    both = F.size(F.array_intersect("x", "y"))
    either = F.size("x") + F.size("y") - both
    out = written(edges.join(left, "a").join(right, "b").select("a", "b", ((both >= similarity * either) | (either == 0)).alias("near")), "verified")
    dropped(grams)
    return out


def near_groups(docs: DataFrame, similarity: float = SIMILAR, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, group of every row with an id: the smallest id among its near copies.

    Two texts are near copies if the Jaccard index of their sets of shingles of
    ``shingle`` words is ``similarity`` or more; groups are the components.
    Texts of the same words are one node. Candidates meet on the keys of
    wide_keys, which hold few changed words, and of bands, which hold whatever
    leaves the shingles alike, such as a block more or less. In each bucket, or
    in blocks of a larger one, the nearest pairs that span it, by the min-hashes
    of their shingles, are verified over whole texts. Buckets of bands whose
    nodes are then still in different groups, because a pair failed or as they
    stood in different blocks, are gone through whole, block by block, so that no
    pair that meets there is left out. The search is a sketch's: of pairs at 0.8
    it misses less than one in a thousand (tests measure it), and no pair below
    is taken.
    Null and empty texts are one group. An empty table gives no rows.
    """

    def start():
        def run(batch):
            texts = batch.column(1).to_pylist()
            same = [xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())) for t in texts]
            wide = [wide_print(t).tobytes() for t in texts]
            least = [minima(shingle_hashes(t, shingle)) for t in texts]
            sketches, banded = [sketch(x).tobytes() for x in least], [bands(x).tobytes() for x in least]
            return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.binary()) for c in (same, wide, sketches, banded))], ["doc_id", "same", "wide", "sketch", "bands"])

        return run

    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    rows = written(map_arrow(whole, start, "doc_id long, same binary, wide binary, sketch binary, bands binary"), "wide-prints")
    nodes = written(rows.groupBy("same").agg(F.min("doc_id").alias("node"), F.first("wide").alias("wide"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "wide-nodes")

    def keyed():
        def run(batch):
            prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            found = [(row + at, key) for at in range(0, len(prints), 1024) for row, key in [wide_keys(prints[at : at + 1024])]]
            found.append((np.repeat(np.arange(batch.num_rows), BANDS), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)))
            row, key = (np.concatenate(c) for c in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(row))], ["key", "node"])

        return run

    # sketches join their keys again only where a key has company
    keys = written(map_arrow(nodes.select("node", "wide", "bands"), keyed, "key long, node long"), "wide-keys")
    full = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keys.join(full, "key"), "wide-meetings")
    dropped(keys)
    part = F.xxhash64("key", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)))
    parts = met.withColumn("key", F.when(F.col("n") > BLOCK, part).otherwise(F.col("key")))
    spanned = written(bucket_edges(parts.join(nodes.select("node", "sketch"), "node"), APART), "wide-edges")
    edges = verified(spanned, whole, similarity, shingle)
    dropped(spanned)
    linked, failed = edges.where("near").select("a", "b"), edges.where("not near")
    found = components(linked, "near-components").withColumnRenamed("component", "group")
    # a bucket whose nodes are one group has nothing left
    open_nodes = failed.select(F.col("a").alias("node")).union(failed.select(F.col("b").alias("node"))).distinct().withColumn("open", F.lit(1))
    banded = met.where(F.col("key").bitwiseAND(F.lit(15)) == 15)
    grouped = banded.join(found, "node", "left").join(open_nodes, "node", "left").withColumn("group", F.coalesce("group", "node"))
    open_keys = grouped.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.max("n").alias("n"), F.max("open").alias("open")).where((F.col("low") < F.col("high")) & ((F.col("n") > BLOCK) | F.col("open").isNotNull())).select("key")
    rest = written(grouped.join(open_keys, "key", "left_semi").select("key", "node", "group"), "wide-rest")
    grams = shingled(whole, rest.select(F.col("node").alias("doc_id")).distinct(), shingle)
    more = written(bucket_rest(rest.join(grams.withColumnRenamed("doc_id", "node"), "node"), similarity), "wide-links")
    linked = linked.union(more)
    found = components(linked, "near-components").withColumnRenamed("component", "group")
    heads = nodes.select("same", "node").join(found, "node", "left").select("same", F.coalesce("group", "node").alias("group"))
    out = written(rows.select("doc_id", "same").join(heads, "same").select("doc_id", "group"), "near-groups")
    dropped(rows, nodes, met, edges, rest, grams, more)
    return out


def one_of_each(docs: DataFrame, similarity: float = SIMILAR, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose near_groups group has a smaller id; all columns stay. Rows with a null id stay, and so do all rows of the id that stays."""
    gone = near_groups(docs, similarity, shingle, id_col, text_col).where("doc_id <> group").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti")
