"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Two generative models over hashed word n-grams are counted: the raw one on all
documents, the target's on a bounded sample of labelled documents, those of good
quality that are not toxic. A document's log importance is the sum, over its
different n-grams, of the log ratio of the two, drawn in towards zero by ``SHRINK``,
less what as many n-grams of a target document weigh on average. Without the
first the sum is mostly the noise of common n-grams, and without the second long
documents are told from short ones instead of good from bad; the README has the
rates with and without either. A document's key is its log importance plus Gumbel
noise, and the k documents with the largest keys are a sample without replacement
in proportion to the importances.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_words, dropped, numbered, small_batches, stretches, written

#: Hashed n-grams; the fitted table has as many 4-byte entries at most.
BUCKETS = 1 << 20
#: Labelled documents that the target's model is fitted on, each whole, as every document is scored.
FITTED = 40_000
#: Added to the document counts of both models.
PRIOR = 2.0
#: Log ratios below this weigh nothing; the others are less by it.
SHRINK = 1.25
SEED = 7
PREFIXES = (4, 5, 6, 7, 8)
#: Tenths at which a share of a text makes a class of its own.
LEVELS = (4, 7)

#: Numbers and signs stand apart from letters (RE2); words are what is between blanks then.
OTHERS = r"\pN+|[^\pL\pN\pZ\t-\r\x{85}]+"


#: Letters of text that are worked on at once.
PART = 1 << 20
#: An odd number, whose powers weigh the bytes of a word.
BASE = 0x9E3779B97F4A7C15


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different keys, rising, how often each stands there); by sorting, which is faster here than a table."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[at], np.diff(at, append=len(keys))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def word_hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, whether they count): a row for each lower-case word, its own hash first, then those of its beginnings of PREFIXES letters, by which inflected forms are alike, where it is longer."""
    low = pc.utf8_lower(words)
    letters = pc.utf8_length(low).to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.binary_length(low).to_numpy(zero_copy_only=False), dtype=np.int64)
    raw = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(low)], pa.int32()), low), "")[0].as_buffer(), np.uint8) if len(low) else np.zeros(0, np.uint8)
    power = lambda p: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(raw), p, np.uint64)]), dtype=np.uint64)
    # a sum over a word's bytes, each by a power of BASE, from running sums, moved to the word's start
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * power(BASE)[:-1], dtype=np.uint64)])
    starts = np.concatenate([[0], ends])[: len(ends)]
    moved = power(pow(BASE, -1, 1 << 64))[starts]
    hashes, counts = [mixed((sums[ends] - sums[starts]) * moved)], [letters > 0]
    for k in PREFIXES:
        stop = starts + pc.binary_length(pc.utf8_slice_codeunits(low, 0, k)).to_numpy(zero_copy_only=False)
        hashes.append(mixed((sums[stop] - sums[starts]) * moved + np.uint64(k)))
        counts.append(letters > k)
    return np.stack(hashes, axis=1), np.stack(counts, axis=1)


def class_bucket(name: str) -> int:
    return xxhash.xxh64_intdigest(f"\0{name}") % BUCKETS


@functools.cache
def class_buckets() -> tuple[int, np.ndarray, np.ndarray]:
    """The buckets of a text without words, of each share at each of LEVELS, and of each size by its bit length."""
    shares = [[class_bucket(f"{name}{k}") for k in LEVELS] for name in ("upper", "signs", "most", "same", "again", "pairs")]
    return class_bucket("empty"), np.array(shares, np.int64), np.array([class_bucket(f"size{k}") for k in range(64)], np.int64)


def part_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number << 20 | bucket, rising) of the different features of texts, all at once: lower-case words and their beginnings, runs of signs, pairs of neighbours, and classes of the whole text."""
    words, number, ends = numbered(*cut_words(texts, OTHERS))
    hashes, real = word_hashes(words)
    signs_of = ~pc.utf8_is_alpha(pc.utf8_slice_codeunits(words, 0, 1)).to_numpy(zero_copy_only=False)
    upper_of = pc.utf8_is_upper(words).to_numpy(zero_copy_only=False) & (pc.utf8_length(words).to_numpy(zero_copy_only=False) > 1) & ~signs_of
    n = np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(texts)), n)
    number = number.astype(np.int64)
    many = lambda of, mask: np.bincount(of[mask], minlength=len(texts))
    # different words of each text, and how often each stands there
    own, counts = distinct(text * len(words) + number)
    own_text, own_word = own // max(1, len(words)), own % max(1, len(words))
    singles = ((hashes % np.uint64(BUCKETS)).astype(np.int64)[own_word] | own_text[:, None] << 20)[real[own_word]]
    near, first = text[1:] == text[:-1], hashes[number, 0]
    pairs = mixed(first[:-1][near] * np.uint64(3) + first[1:][near])
    pairs, _ = distinct((pairs % np.uint64(BUCKETS)).astype(np.int64) | text[:-1][near] << 20)
    # what holds of whole texts: how much of each is capitals, signs, one token, tokens twice, words that were there before, or pairs that were
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, own_text, counts)
    signs, whole = many(text, signs_of[number]), np.maximum(1, n)
    parts = (
        many(text, upper_of[number]) / np.maximum(1, n - signs),
        signs / whole,
        most / whole,
        many(text[1:], (number[1:] == number[:-1]) & near) / whole,
        1 - np.bincount(own_text, minlength=len(texts)) / whole,
        1 - np.bincount(pairs >> 20, minlength=len(texts)) / whole,
    )
    empty, shares, lengths = class_buckets()
    at = np.arange(len(texts))
    classes = [np.where(n > 0, lengths[np.frexp(n.astype(float))[1]], empty) | at << 20]
    for x, buckets in zip(parts, shares, strict=True):
        for level, bucket in zip(LEVELS, buckets, strict=True):  # an extreme text bears the lower classes too
            classes.append(bucket | at[(10 * x >= level) & (n > 0)] << 20)
    return distinct(np.concatenate([singles, pairs, *classes]))[0]


def grams(texts: list[str]) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """(places of some texts, the number of one of them for each feature, its bucket), until all are through."""
    for part in stretches(texts, PART):
        found = part_grams(texts[part.start : part.stop])
        yield part, found >> 20, found & (BUCKETS - 1)


def labelled(labels: DataFrame, most: int = FITTED) -> DataFrame:
    """doc_id, target of at most about ``most`` labelled ids, chosen by a hash of the id; an id with several labels is target only if all of them agree. Rows with a null in any column tell nothing."""
    of = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("target"))
    n = of.count()
    return of if n <= most else of.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * most / n))


#: In place of a bucket: the row that counts documents, and the one that counts labelled ones.
DOCUMENTS, LABELLED = -1, -2


def counts_of(docs: DataFrame, of: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, target, raw: in how many target documents and in how many documents at all each bucket stands; row DOCUMENTS counts the documents themselves, row LABELLED the labelled ones.

    Each task counts into two arrays and sends its buckets on once.
    """
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = whole.join(F.broadcast(of), "doc_id", "left").select("text", "target")  # about FITTED short rows, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, more = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), np.zeros((2, 2), np.int64)
        for batch in batches:
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            good = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            more += [[good.sum(), len(good)], [good.sum(), known.sum()]]
            for part, text, bucket in grams(batch.column(0).to_pylist()):
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[part.start : part.stop][text]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        columns = np.concatenate([[DOCUMENTS, LABELLED], some]), np.concatenate([more[:, 0], target[some]]), np.concatenate([more[:, 1], raw[some]])
        for at in range(0, len(some) + 2, 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], ["bucket", "target", "raw"])

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


class Model(NamedTuple):
    """``buckets`` that weigh anything, BUCKETS of them at most, and their ``weights``; the ``mean`` weight that an n-gram of a target document has; the ``share`` of target documents among labelled ones, null without a target document."""

    buckets: np.ndarray
    weights: np.ndarray
    mean: float
    share: float | None


def ratios(counts: DataFrame) -> Model:
    """The shrunken log ratios of the two models.

    The mean is taken off for each n-gram of a text, so that a long target
    document is not expected to weigh less than a short one; each bucket counts
    as seen in one target document more, as it was chosen for having few.
    """
    total = {r["bucket"]: r for r in counts.where("bucket < 0").collect()}
    if not total or not total[DOCUMENTS]["target"]:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, None)
    scale = total[DOCUMENTS]["target"] / total[DOCUMENTS]["raw"]
    ratio = F.log(F.col("target") + PRIOR) - F.log(F.col("raw") * scale + PRIOR)
    weight = F.signum(ratio) * (F.abs(ratio) - SHRINK)
    rows = counts.where("bucket >= 0").select("bucket", "target", F.when(F.abs(ratio) > SHRINK, weight).alias("weight"))
    # in whole numbers, so that the order of the sum does not tell
    seen, weighed = rows.agg(F.sum("target"), F.sum(F.round((F.col("target") + 1) * F.col("weight") * 1e6).cast("long"))).first()
    weights = rows.where("weight is not null").select("bucket", "weight").toArrow()
    return Model(weights["bucket"].to_numpy(), weights["weight"].to_numpy(), (weighed or 0) / 1e6 / max(1, seen), total[LABELLED]["target"] / total[LABELLED]["raw"])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``log_weight`` (the log importance of the whole text) and ``gumbel`` (noise by id and text, the same in every run). Columns of docs of these names are replaced; only ids and texts go to Python, and only numbers come back."""
    dense = np.zeros(BUCKETS, np.float32)
    dense[model.buckets] = model.weights
    sent, mean = docs.sparkSession.sparkContext.broadcast(zlib.compress(dense.tobytes())), model.mean

    @F.pandas_udf("log_weight double, gumbel double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = np.frombuffer(zlib.decompress(sent.value), np.float32).astype(np.float64)
        for ids, texts in batches:
            listed = texts.tolist()
            weights = [np.zeros(0)]
            for part, text, bucket in grams(listed):
                weights.append(np.bincount(text, table[bucket], len(part)) - mean * np.bincount(text, minlength=len(part)))
            u = np.array([(xxhash.xxh64_intdigest(struct.pack("<q", row) + text.encode(), SEED) + 0.5) / 2.0**64 for row, text in zip(ids.tolist(), listed, strict=True)])
            yield pd.DataFrame({"log_weight": np.round(np.concatenate(weights), 6), "gumbel": -np.log(-np.log(u))})

    keep = [c for c in docs.columns if c not in ("log_weight", "gumbel")]
    key, text = F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(*[F.col(f"`{c}`") for c in keep], score(key, text).alias("_score")).select(*[F.col(f"`{c}`") for c in keep], "_score.log_weight", "_score.gumbel")


def kth_key(keys: DataFrame, k: int, most: int = 100_000) -> float:
    """The k-th largest of a column ``key``: its range is halved into 1024ths until few keys are left in one, which alone reach the driver."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return float("inf")
    left = k
    for _ in range(12):
        step = (high - low) / 1024
        if step <= 0:
            return low
        part = F.least(F.greatest(F.floor((F.col("key") - low) / step), F.lit(0)), F.lit(1023)).alias("part")
        found = {r["part"]: r["n"] for r in keys.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(part).agg(F.count("*").alias("n")).collect()}
        for p in range(1023, -1, -1):
            n = found.get(p, 0)
            if left <= n:
                break
            left -= n
        else:
            return low
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high)).where(part == p)
        if n <= most:
            return sorted((r["key"] for r in inside.select("key").collect()), reverse=True)[left - 1]
        low, high = inside.agg(F.min("key"), F.max("key")).first()
    return low


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The k documents with the largest keys, with ``log_weight`` and ``key``, and the columns of docs named by ``keep``, all of them unless given, but those of these names.

    k is, unless given, as many documents as the corpus is expected to hold of
    the target: the share of target documents among the labelled ones, of all
    documents. Null texts count as empty; they, rows with a null id and repeated
    rows are scored like others, and an empty table gives no rows. Equal keys at
    the end are all kept. Without a target label nothing can be told apart, and
    all documents stay unless k is given. Texts are read twice, and scored rows
    are written once.
    """
    counts = written(counts_of(docs, labelled(labels), id_col, text_col), "gram-counts")
    model = ratios(counts)
    dropped(counts)
    rows = scored(docs, model, id_col, text_col).withColumn("key", F.col("log_weight") + F.col("gumbel")).drop("gumbel")
    rows = written(rows.select(*keep, "log_weight", "key") if keep else rows, "scored")
    if k is None:
        if model.share is None:
            return rows
        k = round(model.share * rows.count())
    return rows.where(F.col("key") >= kth_key(rows.select("key"), k))
