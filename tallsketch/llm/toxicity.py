"""Toxicity by class-conditional Kneser-Ney language models.

Two interpolated Kneser-Ney bigram models, of toxic and of ordinary labelled documents, share
their lowest order: the pooled continuation counts, so an expression that is rare in both
classes gets the same probability from both.  A word's evidence is the log ratio of its two
probabilities; a text is described by the ratio normalised by its length and by the mean of its
three strongest words, and a logistic curve fitted on labelled documents that the models have
not seen turns the two into a probability.

The models count all labelled documents outside the held-out fold; only the curve is fitted on a
bounded sample (the smallest md5(doc_id)), which the models do not count.  Counts are of
documents, not occurrences.  Words are known by a 64-bit hash throughout.  Tasks count grams in
arrays and pass them on by bucket, for each word the words before it; the pairs of frequent words
are dealt over all buckets.  All pairs are final after that one exchange.

A model of up to ``HELD_BYTES`` is collected as sorted arrays and broadcast.  A larger one passes
the driver part by part into a file of sorted arrays, which every executor fetches once and its
tasks map into memory, so that documents are scored where they are read.  Beyond ``MODEL_BYTES``
it stays a table: every block of documents is joined with the entries of its own words and pairs.
"""

import math
import mmap
import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import regex
import xxhash
from pyspark import SparkFiles
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallsketch.llm.common import BROADCAST_ROWS, free_name, located, stored, table
from tallsketch.session import ship_package

#: A CURVE_SHARE-th of the labelled documents, of at most so many, fits the curve; all others count.
MAX_DOCS = 12_000
CURVE_SHARE = 4
#: Labelled documents that are broadcast with their keys, at most; more of them as bits by place:
#: documents of a number, and numbers of a row.
LABELS, BITS, NUMBERS = BROADCAST_ROWS, 31, 256
#: Bytes of a model that is broadcast, at most, and of one that is mapped; rows of a block that meets
#: a larger one.
HELD_BYTES, MODEL_BYTES, BLOCK = 32 << 20, 4 << 30, 1000
#: Entries of a part of a model that is mapped, about; keys of a cell, at least; steps that look up a
#: key from where its cell begins.
PART, CELL, STEPS = 1 << 17, 4, 32
#: Bytes of a pair and of a word in a model of arrays.
PAIR_BYTES, WORD_BYTES = 24, 40
#: Grams that a task holds before it passes them on; texts that it takes from a batch at once.
COUNTED, TEXTS = 1_000_000, 200
#: Words that make up more than one in HOT are counted pair by pair; buckets at least, and
#: characters a bucket.
HOT, BUCKETS, BUCKET_CHARS = 500, 64, 16_000_000
#: In place of the word before: the documents of the word itself, and of the pairs it begins.
ITSELF, BEGUN = 0, 1
#: Words whose hashes a task remembers, and the longest of them.
REMEMBERED, LONGEST = 500_000, 64
#: Documents that a word or a word pair must occur in to be in the model.  Fewer are below the
#: discount in both classes, so they leave the ratio to the shared backoff in any case.
MIN_WORD, MIN_PAIR = 3, 3
#: Absolute discount, in documents: an expression seen in fewer documents of a class is left to
#: the backoff that both classes share, so that rare words are no evidence by themselves.
DISCOUNT = 2.5
#: Strongest words of a text.
TOP = 3
#: Words whose ratios are looked up at once, but for those of one longer text.
AT_ONCE = 100_000
#: Labels of documents with this remainder of crc32(doc_id) by 5 are never learned from.
FOLDS, HELD_OUT = 5, 0

WORD = regex.compile(r"\p{L}+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class _Hashes(dict):
    """Hashes of words, as signed numbers; those not remembered are worked out."""

    def __missing__(self, w: str) -> int:
        h = max(2, xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))
        h -= (h >> 63) << 64
        if len(w) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[w] = h
        return h


_HASHES = _Hashes()


def hashed(found: list[str]) -> np.ndarray:
    """64-bit hashes of words; none is ITSELF or BEGUN."""
    return np.array(list(map(_HASHES.__getitem__, found)), np.int64)


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A 64-bit key of two hashes in their order."""
    x = before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def _cell_bits(size: int) -> int:
    """Highest bits that the keys of a cell share: CELL to twice as many hashes do."""
    return max(1, (size // CELL).bit_length() - 1)


def _cells(among: np.ndarray) -> np.ndarray:
    """Where the keys of each cell begin in the sorted ``among``."""
    bits = _cell_bits(len(among))
    out = np.empty(1 << bits, np.uint32)
    for s in range(0, len(out), AT_ONCE):
        cell = np.arange(s, min(s + AT_ONCE, len(out))) - (len(out) >> 1)
        out[s : s + AT_ONCE] = np.searchsorted(among, cell << (64 - bits))
    return out


def _place(keys: np.ndarray, among: np.ndarray, cells: np.ndarray | None = None) -> np.ndarray:
    """1 + place of each key in the sorted ``among``; 0: not there.  ``cells`` of its hashes save
    most of the search."""
    if not len(among):
        return np.zeros(len(keys), np.int64)
    if cells is None:
        at = np.searchsorted(among, keys)
    else:
        half = len(cells) >> 1
        at = cells[(keys >> (64 - half.bit_length())) + half].astype(np.int64)
        left = np.arange(len(keys))
        for _ in range(STEPS):
            left = left[at[left] < len(among)]
            left = left[among[at[left]] < keys[left]]
            if not len(left):
                break
            at[left] += 1
        else:  # many keys in a cell
            at[left] = np.searchsorted(among, keys[left])
    at = np.minimum(at, len(among) - 1)
    return np.where(among[at] == keys, at + 1, 0)


@dataclass
class Model:
    """Sorted hashes of words and of pairs, and their probabilities by place; place 0 is a word or
    pair outside the model.  A model that is mapped goes to tasks as the name of its ``file``."""

    words: np.ndarray
    unigram: np.ndarray  # (2, 1 + words): P_c(w), class 1 toxic
    context: np.ndarray  # (2, 1 + words): the weight of the unigram after w
    pairs: np.ndarray
    pair_p: np.ndarray   # (2, 1 + pairs): discounted probabilities
    curve: np.ndarray = None
    cells: tuple[np.ndarray, np.ndarray] = None  # of words and of pairs
    file: str = None

    def __post_init__(self):
        self.cells = self.cells or (_cells(self.words), _cells(self.pairs))

    def __reduce__(self):
        if self.file:
            return _mapped, (self.file, len(self.words), len(self.pairs), self.curve)
        return Model, (self.words, self.unigram, self.context, self.pairs, self.pair_p, self.curve)

    def ratios(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log P_toxic(w | before) / P_ordinary(w | before) of word hashes; ``first`` marks
        words that begin a text."""
        ids = _place(h, self.words, self.cells[0])
        weight = np.where(first, 1.0, self.context[:, np.roll(ids, 1)])
        pair = np.where(first, 0, _place(pair_keys(np.roll(h, 1), h), self.pairs, self.cells[1]))
        p = weight * self.unigram[:, ids] + self.pair_p[:, pair]
        return np.log(p[1]) - np.log(p[0])

    def features(self, texts: Sequence[str | None] | pa.Array) -> np.ndarray:
        """(texts, 2): mean log ratio, mean of the TOP largest ones; zero without words."""
        out = np.zeros((len(texts), 2))
        lists, rows, size = [], [], 0
        for k, text in enumerate(_texts(texts) if isinstance(texts, pa.Array) else texts):
            h = hashed(words(text))
            if not len(h):
                continue
            if lists and size + len(h) > AT_ONCE:
                out[rows] = self._features(lists)
                lists, rows, size = [], [], 0
            lists.append(h)
            rows.append(k)
            size += len(h)
        if lists:
            out[rows] = self._features(lists)
        return out

    def _features(self, lists: list[np.ndarray]) -> np.ndarray:
        """The features of texts given by the hashes of their words, at least one each."""
        out = np.zeros((len(lists), 2))
        ends = np.cumsum([len(x) for x in lists])
        starts = np.append(0, ends[:-1])
        first = np.zeros(ends[-1], bool)
        first[starts] = True
        r = self.ratios(np.concatenate(lists), first)
        for k, (a, b) in enumerate(zip(starts, ends)):
            part = r[a:b]
            top = np.partition(part, len(part) - TOP)[-TOP:] if len(part) > TOP else part
            out[k] = part.mean(), np.maximum(top, 0).sum() / TOP
        return out

    def scores(self, texts: Sequence[str | None] | pa.Array) -> np.ndarray:
        f = self.features(texts)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + f @ self.curve[1:], -40, 40)))


@dataclass
class Tables:
    """A model too large to collect: ``singles`` (word, a, b, c, d) holds a word's two probabilities
    and context weights, ``pairs`` (before, word, a, b) a pair's two probabilities."""

    singles: DataFrame
    pairs: DataFrame
    unknown: tuple[float, float]  # P_c of a word outside the model
    curve: np.ndarray = None


def training_rows(labels: DataFrame, key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """(key, toxic, order, curve): the labelled documents to learn from; a repeated one counts as
    its largest label, null labels and keys are left out.  ``_curve`` marks those that may fit
    the curve."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    fold = F.crc32(F.col(key).cast("string")) % FOLDS
    rows = known.filter(fold != HELD_OUT).groupBy(key).agg((F.max(label) > 0).cast("int").alias("_toxic"))
    return rows.select(key, "_toxic", *_order(F.col(key)))


def _order(key: Column) -> tuple[Column, Column]:
    """The order that samples follow, and whether a document may fit the curve."""
    order = F.md5(key.cast("string"))
    return order.alias("_order"), (F.crc32(order) % CURVE_SHARE == 0).alias("_curve")


def _labelled(docs: DataFrame, chosen: DataFrame, key: str, text: str) -> DataFrame:
    """(_text, _toxic, _order, _curve): the documents of the ``chosen`` labels.  Texts are not
    shuffled if few are chosen or each document has a place in a Parquet file."""
    if chosen.limit(LABELS + 1).count() <= LABELS:
        return docs.select(key, F.col(text).alias("_text")).join(F.broadcast(chosen), key).select("_text", "_toxic", "_order", "_curve")
    by_key = docs.select(key, F.col(text).alias("_text")).join(chosen, key).select("_text", "_toxic", "_order", "_curve")
    try:
        docs.metadataColumn("_metadata")
    except AnalysisException:
        return by_key
    at, width = F.col("_place.row"), BITS * NUMBERS
    rows = located(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_place").select(
        "_key", "_text", F.col("_place.file").alias("_file"), F.floor(at / width).alias("_block"),
        F.floor(at % width / BITS).cast("int").alias("_number"), (2 * (at % BITS)).cast("int").alias("_bit"))
    # two bits of each document: that it is chosen, and its label
    told = rows.drop("_text").join(chosen.select(F.col(key).alias("_known"), "_toxic"), F.col("_key") == F.col("_known"), "left")
    bits = lambda value: F.bit_or(F.call_function("shiftleft", value.cast("long"), F.col("_bit")))
    marks = stored(told.groupBy("_file", "_block", "_number").agg(
        F.count(F.lit(1)).alias("rows"), F.bit_count(bits(F.lit(1))).alias("places"),
        bits(F.coalesce(1 + 2 * F.col("_toxic"), F.lit(0))).alias("bits")), "toxicity-marks", clean_up=True)
    if not marks.filter("rows <> places").isEmpty():  # several rows come from one of the file
        return by_key
    blocks = marks.filter("bits <> 0").groupBy("_file", "_block").agg(
        F.map_from_entries(F.collect_list(F.struct("_number", "bits"))).alias("_bits"))
    mark = F.call_function("shiftright", F.col("_bits")[F.col("_number")], F.col("_bit")).bitwiseAND(3).cast("int")
    own = F.col("_key").cast(chosen.schema[key].dataType)
    return rows.join(F.broadcast(blocks), ["_file", "_block"]).withColumn("_mark", mark).filter("_mark > 0").select(
        "_text", F.shiftright("_mark", 1).alias("_toxic"), *_order(own))


def last_of_sample(rows: DataFrame, size: int) -> str:
    """The ``size``-th smallest ``_order`` (an md5) of ``rows``, or the largest.  Only rows below a
    threshold that about twice as many pass are put in order, whatever the number of rows."""
    total, share = rows.count(), 0.0
    while True:
        share = min(1.0, 2 * share or 2.0 * size / max(total, 1))
        few = rows.select("_order")
        if share < 1:
            few = few.filter(F.col("_order") < f"{int(share * 16**8):08x}")
        if share == 1 or few.count() >= size:
            return few.orderBy("_order").limit(size).agg(F.max("_order")).first()[0] or ""


_COUNTS = "bucket int, words array<long>, runs array<int>, before array<long>, toxic array<int>, ordinary array<int>"
_WORDS = ("word long, toxic long, ordinary long, begun_toxic long, begun_ordinary long, left long, "
          "before array<long>, pair_toxic array<long>, pair_ordinary array<long>")


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows begin to differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of equal keys (first key first) added up, in order.  The lists are emptied."""
    by = np.lexsort(keys[::-1])
    for k in range(len(keys)):
        keys[k] = keys[k][by]
    at = _edges(*keys) if len(by) else by
    sums = []
    while counts:
        c = counts.pop(0)
        sums.append(np.add.reduceat(c[by], at) if len(by) else c)
    del by
    return [keys.pop(0)[at] for _ in range(len(keys))], sums


def _texts(column: pa.Array):
    """The texts of a batch, made Python strings TEXTS at a time."""
    for at in range(0, len(column), TEXTS):
        yield from column.slice(at, TEXTS).to_pylist()


def _lists(starts: np.ndarray, size: int, values: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, size).astype(np.int32)), pa.array(values.astype(kind)))


def _count_grams(most: int, buckets: int, hot: np.ndarray):
    """A row per bucket: its words, and for each a run of the words before it, of ITSELF and BEGUN,
    with the toxic and ordinary documents of each.  A word is in one bucket, but the pairs of the
    sorted ``hot`` words are dealt over all.  At most about ``most`` grams are held at a time."""
    def passed(keys, counts):
        bucket, word, before = keys
        row, run = _edges(bucket), _edges(bucket, word)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[row].astype(np.int32)), _lists(np.searchsorted(run, row), len(run), word[run], np.int64),
             _lists(np.searchsorted(run, row), len(run), np.diff(np.append(run, len(word))), np.int32),
             *[_lists(row, len(word), c, k) for c, k in ((before, np.int64), (counts[0], np.int32), (counts[1], np.int32))]],
            names=["bucket", "words", "runs", "before", "toxic", "ordinary"])

    def summed(held):
        cols = []
        for part in held:  # a column's parts go before the next column is joined
            cols.append(np.concatenate(part))
            part.clear()
        keys, counts = cols[:2], cols[2:]
        del cols
        at = np.empty(len(keys[0]), np.int32)
        for s in range(0, len(at), AT_ONCE):
            word, before = (k[s : s + AT_ONCE] for k in keys)
            key = np.where(_place(word, hot) > 0, pair_keys(before, word), word)
            at[s : s + AT_ONCE] = key.view(np.uint64) % np.uint64(buckets)
        return _summed([at, *keys], counts)

    def run(batches):
        held: list[list] = [[], [], [], []]
        size = 0
        for b in batches:
            for text, toxic in zip(_texts(b.column(0)), b.column(1).to_pylist()):
                h = hashed(words(text))
                if not len(h):
                    continue
                _, at = np.unique(pair_keys(h[:-1], h[1:]), return_index=True)
                single = np.unique(h)
                begun, times = np.unique(h[at], return_counts=True)
                n = np.concatenate([np.ones(len(single), np.int32), times.astype(np.int32), np.ones(len(at), np.int32)])
                none = np.zeros(len(n), np.int32)
                held[0].append(np.concatenate([single, begun, h[at + 1]]))
                held[1].append(np.concatenate([np.full(len(single), ITSELF), np.full(len(begun), BEGUN), h[at]]))
                held[2].append(n if toxic else none)
                held[3].append(none if toxic else n)
                size += len(n)
                if size >= most:
                    keys, counts = summed(held)
                    size = len(keys[0])
                    if size >= most // 2:  # few repeat: hand them on
                        yield passed(keys, counts)
                        size = 0
                    else:
                        held = [[c] for c in (*keys[1:], *counts)]
                    del keys, counts
        if size:
            yield passed(*summed(held))

    return run


def _merge_grams(batches):
    """The words of each bucket, one bucket at a time: documents, sums of the pairs that a word begins,
    distinct words before it, and its pairs of MIN_PAIR documents."""
    bucket, held = None, []

    def merged():
        (word, before), (toxic, ordinary) = _summed([np.concatenate(c) for c in list(zip(*held))[:2]],
                                                    [np.concatenate(c, dtype=np.int64) for c in list(zip(*held))[2:]])
        at, pair = _edges(word), (before != ITSELF) & (before != BEGUN)
        over = lambda mask, n: np.add.reduceat(np.where(mask, n, 0), at)
        keep = pair & (toxic + ordinary >= MIN_PAIR)
        starts = np.concatenate([[0], np.cumsum(keep)])[at]
        lists = [_lists(starts, int(keep.sum()), c[keep], np.int64) for c in (before, toxic, ordinary)]
        sums = [over(before == ITSELF, toxic), over(before == ITSELF, ordinary), over(before == BEGUN, toxic),
                over(before == BEGUN, ordinary), over(pair, np.ones(len(word), np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(word[at]), *map(pa.array, sums), *lists],
                                          names=["word", "toxic", "ordinary", "begun_toxic", "begun_ordinary", "left",
                                                 "before", "pair_toxic", "pair_ordinary"])

    for b in batches:
        for k, now in enumerate(b.column("bucket").to_pylist()):
            if held and now != bucket:
                yield merged()
                held = []
            bucket = now
            found, runs, *rest = (b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("words", "runs", "before", "toxic", "ordinary"))
            held.append((np.repeat(found, runs), *rest))
    if held:
        yield merged()


def _sample_words(batches):
    for b in batches:
        h, n = np.unique(np.concatenate([hashed(words(t)) for t in _texts(b.column(0))] or [np.zeros(0, np.int64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["word", "n"])


def hot_words(sample: DataFrame) -> np.ndarray:
    """Sorted hashes of the words that make up more than 1 / HOT of the words of the bounded sample:
    fewer than HOT.  They only decide where grams are counted, not how."""
    found = stored(sample.select("_text").mapInArrow(_sample_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "toxicity-sample")
    total = found.agg(F.sum("n")).first()[0] or 0
    return np.array(sorted(r[0] for r in found.filter(F.col("n") * HOT > total).select("word").collect()), np.int64)


def _grams(train: DataFrame, hot: np.ndarray) -> DataFrame:
    """(_WORDS): what is known of each word, of hot words a share from each bucket.  A pair is in one
    bucket, so its counts are final after the one exchange; buckets grow in number with the text."""
    chars = train.agg(F.sum(F.char_length("_text"))).first()[0] or 0
    return (train.mapInArrow(_count_grams(COUNTED, max(BUCKETS, chars // BUCKET_CHARS), hot), _COUNTS)
            .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merge_grams, _WORDS))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        max_docs: int = MAX_DOCS) -> "Model | Tables":
    """Fit the models on all labelled documents and the curve on at most ``max_docs`` //
    CURVE_SHARE others.  With one class or no labels at all, every score is the smoothed share of
    toxic labels.  Repeated documents count each time, null texts have no words, labels without a
    document are not used, and other columns of both tables are not read."""
    ship_package(docs.sparkSession)
    chosen = stored(training_rows(labels, key, label), "toxicity-labels")
    train = stored(_labelled(docs, chosen, key, text), "toxicity-train", clean_up=True)
    last = last_of_sample(train.filter("_curve"), max(1, max_docs // CURVE_SHARE))
    sample = stored(train.filter(F.col("_curve") & (F.col("_order") <= last)), "toxicity-curve")
    grams = stored(_grams(train.filter(~F.col("_curve") | (F.col("_order") > last)).select("_text", "_toxic"), hot_words(sample)),
                   "toxicity-grams", clean_up=True)
    model = _kneser_ney(grams)
    size = PAIR_BYTES * model.pairs.count() + WORD_BYTES * model.singles.count()
    if size <= min(HELD_BYTES, MODEL_BYTES):
        model = _collected(model.singles.toArrow(), model.pairs.toArrow(), model.unknown)
    elif size <= MODEL_BYTES:
        model = _filed(model)
    model.curve = np.zeros(3)
    place = "_row"
    seen = _described(located(sample, place), place, "_text", model).join(
        located(sample, place).select(F.col(place).alias("row"), "_toxic"), "row").select("_toxic", "a", "b").toPandas()
    every = train.agg(F.count(F.lit(1)), F.sum("_toxic")).first()
    model.curve = _logistic(seen[["a", "b"]].to_numpy(float), seen["_toxic"].to_numpy(float),
                            ((every[1] or 0) + 0.5) / (every[0] + 1.0))
    return model


def _kneser_ney(grams: DataFrame) -> Tables:
    single = stored(grams.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.sum("left").alias("left"),
                                              F.sum("begun_toxic").alias("ct"), F.sum("begun_ordinary").alias("co")), "toxicity-words")
    uni = single.filter(F.col("toxic") + F.col("ordinary") >= MIN_WORD)

    def over(name):
        return F.greatest(F.col(name) - DISCOUNT, F.lit(0.0))

    total = single.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("ordinary", "toxic", "left")]).first()
    kept = uni.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(over(x)), F.lit(0.0)) for x in ("ordinary", "toxic")]).first()
    among = total[2] + 0.5 * (kept[0] + 1)
    of = [max(float(t), 1.0) for t in total[:2]]
    rest = [1 - kept[c + 1] / of[c] for c in (0, 1)]
    pair = grams.select("word", F.inline(F.arrays_zip("before", "pair_toxic", "pair_ordinary"))).select(
        "before", "word", F.col("pair_toxic").alias("toxic"), F.col("pair_ordinary").alias("ordinary"))
    begin = single.select(F.col("word").alias("before"), "co", "ct")
    pairs = stored(pair.join(begin, "before").select(
        "before", "word", *[(over(n) / F.greatest(F.col(base), F.lit(1))).alias(out)
                            for n, base, out in (("ordinary", "co", "a"), ("toxic", "ct", "b"))]), "toxicity-pairs")
    given = pairs.groupBy(F.col("before").alias("word")).agg(*[F.greatest(1 - F.sum(x), F.lit(1e-6)).alias(y) for x, y in (("a", "c"), ("b", "d"))])
    share = (F.col("left") + 0.5) / among
    singles = uni.join(given, "word", "left").select(
        "word", *[(over(n) / of[c] + rest[c] * share).alias("ab"[c]) for c, n in ((0, "ordinary"), (1, "toxic"))],
        F.coalesce("c", F.lit(1.0)).alias("c"), F.coalesce("d", F.lit(1.0)).alias("d"))
    # pairs without a probability of their own change nothing
    return Tables(stored(singles, "toxicity-singles"), pairs.filter("a > 0 or b > 0"), tuple(r * 0.5 / among for r in rest))


def _collected(singles: pa.Table, pairs: pa.Table, unknown: tuple[float, float]) -> Model:
    """The model of the given entries; other words are unknown."""
    def numbers(table, names):
        return np.array([table.column(n).to_numpy() for n in names], float).reshape(len(names), -1)

    word = singles.column("word").to_numpy().astype(np.int64)
    by = np.argsort(word)
    value = numbers(singles, "abcd")[:, by]
    keys = pair_keys(*(pairs.column(n).to_numpy().astype(np.int64) for n in ("before", "word")))
    order = np.argsort(keys)
    return Model(word[by], np.column_stack([unknown, value[:2]]), np.column_stack([[1.0, 1.0], value[2:]]),
                 keys[order], np.column_stack([[0.0, 0.0], numbers(pairs, "ab")[:, order]]))


def _cut_parts(bits: int, names: list[str], paired: bool):
    """Entries by part, the highest ``bits`` of their keys: keys, and what is known of each, as bytes."""
    def cut(held):
        rows = pa.Table.from_batches(held)
        word = rows.column("word").to_numpy()
        key = pair_keys(rows.column("before").to_numpy(), word) if paired else word
        by = np.argsort(key)
        part = (key[by] >> (64 - bits)).astype(np.int32)
        known = np.column_stack([rows.column(n).to_numpy() for n in names]).astype(float)[by]
        at = _edges(part) if len(part) else []
        return pa.RecordBatch.from_arrays(
            [pa.array(part[at]), *[pa.array([x[s:e].tobytes() for s, e in zip(at, [*at[1:], len(by)])], pa.binary()) for x in (key[by], known)]],
            names=["part", "keys", "known"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= COUNTED:
                yield cut(held)
                held, size = [], 0
        if held:
            yield cut(held)

    return run


def _join_parts(batches):
    """A row per part, its entries in the order of their keys."""
    part, held = None, []

    def joined():
        key = np.frombuffer(b"".join(k for k, _ in held), np.int64)
        known, by = np.frombuffer(b"".join(v for _, v in held)).reshape(len(key), -1), np.argsort(key, kind="stable")
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(key)]), pa.array([key[by].tobytes()], pa.binary()),
                                           pa.array([known[by].tobytes()], pa.binary())], names=["part", "size", "keys", "known"])

    for b in batches:
        for now, *entries in zip(*(b.column(n).to_pylist() for n in ("part", "keys", "known"))):
            if held and now != part:
                yield joined()
                held = []
            part = now
            held.append(entries)
    if held:
        yield joined()


def _layout(words: int, pairs: int) -> list[tuple[type, tuple[int, ...], int]]:
    """Kind, shape and first byte of each array of a file: of words and then of pairs the keys, what
    is known by place, and the cells; at last the size."""
    out, at = [], 0
    for n, known in ((words, 4), (pairs, 2)):
        for kind, shape in ((np.int64, (n,)), (float, (n + 1, known)), (np.uint32, (1 << _cell_bits(n),))):
            out.append((kind, shape, at))
            at += -(-math.prod(shape) * np.dtype(kind).itemsize // 8) * 8
    return [*out, (np.int64, (0,), at)]


def _fetched(df: DataFrame, beside: str):
    """The rows of a stored table one by one; one of its files at a time is on the driver's disk."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for k, name in enumerate(df.inputFiles()):
        path, own = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name)), f"{beside}-{k}"
        path.getFileSystem(conf).copyToLocalFile(False, path, jvm.org.apache.hadoop.fs.Path(own), True)
        with pq.ParquetFile(own, buffer_size=1 << 20, pre_buffer=False) as file:
            yield from file.iter_batches(batch_size=1)
        os.remove(own)


def _filed(model: Tables) -> Model:
    """The model in a file that every executor fetches; a part at a time passes the driver."""
    spark = model.pairs.sparkSession
    sizes = [model.singles.count(), model.pairs.count()]
    layout = _layout(*sizes)
    name = f"toxicity-{uuid.uuid4().hex}"
    path = os.path.join(SparkFiles.getRootDirectory(), name)
    with open(path, "w+b") as f:
        f.truncate(layout[-1][2])
        for k, (table, names, before) in enumerate(((model.singles, "abcd", [*model.unknown, 1.0, 1.0]), (model.pairs, "ab", [0.0, 0.0]))):
            bits = max(1, (sizes[k] // PART).bit_length())
            parts = table.mapInArrow(_cut_parts(bits, list(names), k == 1), "part int, keys binary, known binary").repartition("part")
            parts = stored(parts.sortWithinPartitions("part").mapInArrow(_join_parts, "part int, size long, keys binary, known binary"),
                           "toxicity-model", clean_up=True)
            (_, _, keys), (_, _, known), _ = layout[3 * k : 3 * k + 3]
            f.seek(known)
            f.write(np.array(before, float).tobytes())
            known, at, starts = known + 8 * len(before), 0, {}
            for part, n in sorted(map(tuple, parts.select("part", "size").collect())):
                starts[part] = at
                at += n
            for batch in _fetched(parts, path):
                for part, *data in zip(*(batch.column(n) for n in ("part", "keys", "known"))):
                    for first, width, x in zip((keys, known), (8, 8 * len(before)), data):
                        f.seek(first + width * starts[part.as_py()])
                        f.write(x.as_buffer())
            f.flush()
            f.seek(layout[3 * k + 2][2])
            f.write(_cells(_arrays(path, layout)[3 * k]).tobytes())
    spark.sparkContext.addFile(path)
    return _mapped(name, *sizes, None)


def _arrays(path: str, layout) -> list[np.ndarray]:
    with open(path, "rb") as f:
        held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return [np.frombuffer(held, kind, math.prod(shape), at).reshape(shape) for kind, shape, at in layout[:-1]]


def _mapped(name: str, words: int, pairs: int, curve: np.ndarray | None) -> Model:
    """The model in a file that this process can map."""
    word, single, word_cells, pair, known, pair_cells = _arrays(SparkFiles.get(name), _layout(words, pairs))
    return Model(word, single.T[:2], single.T[2:], pair, known.T, curve, (word_cells, pair_cells), name)


def _block_grams(batches):
    """(block, before, word): the words (before is ITSELF) and pairs of each run of documents of one
    block, distinct but for those of a long run."""
    block, held, size = None, [], 0

    def passed():
        rows = np.unique(np.concatenate(held, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.full(rows.shape[1], block)), pa.array(rows[0]), pa.array(rows[1])],
                                          names=["block", "before", "word"])

    for b in batches:
        for now, text in zip(b.column(0).to_pylist(), _texts(b.column(1))):
            if held and (now != block or size >= COUNTED):
                yield passed()
                held, size = [], 0
            block = now
            h = hashed(words(text))
            single = np.unique(h)
            _, at = np.unique(pair_keys(h[:-1], h[1:]), return_index=True)
            held.append(np.vstack([np.concatenate([np.full(len(single), ITSELF), h[at]]), np.concatenate([single, h[at + 1] if len(at) else h[:0]])]))
            size += held[-1].shape[1]
    if held:
        yield passed()


def _block_features(unknown: tuple[float, float]):
    """Streams blocks, of each its entries and then its documents; yields (row, a, b)."""
    names = ["before", "word", "a", "b", "c", "d"]

    def run(batches):
        block, held, model = None, [], None
        for batch in batches:
            ids, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (kinds[1:] != kinds[:-1])])) if len(ids) else []
            for s, e in zip(edge, [*edge[1:], len(ids)]):
                if ids[s] != block:
                    block, held, model = ids[s], [], None
                part = batch.slice(s, e - s)
                if kinds[s] == 0:
                    held.append(part.select(names))
                    continue
                if model is None:
                    rows = pa.Table.from_batches(held or [batch.slice(0, 0).select(names)])
                    # an entry that was found twice
                    rows = rows.group_by(["before", "word"]).aggregate([(x, "min") for x in "abcd"])
                    rows = rows.rename_columns({f"{x}_min": x for x in "abcd"})
                    own = rows.column("before").to_numpy() == ITSELF
                    model, held = _collected(rows.filter(pa.array(own)), rows.filter(pa.array(~own)), unknown), []
                f = model.features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(f[:, 0]), pa.array(f[:, 1])], names=["row", "a", "b"])
    return run


def _described(docs: DataFrame, place: str, text: str, model: "Model | Tables") -> DataFrame:
    """(row, a, b): the two features of every document of ``docs``, located by ``place``."""
    row = "row struct<file: long, row: long>"
    own = docs.select(F.col(place).alias("row"), F.col(text).alias("text"))
    if isinstance(model, Model):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches):
            for b in batches:
                f = shared.value.features(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f[:, 0]), pa.array(f[:, 1])], names=["row", "a", "b"])

        return own.mapInArrow(run, f"{row}, a double, b double")
    own = own.withColumn("block", F.xxhash64("row.file", F.floor(F.col("row.row") / BLOCK)))
    asked = own.select("block", "text").mapInArrow(_block_grams, "block long, before long, word long")
    found = asked.filter(F.col("before") != ITSELF).join(model.pairs, ["before", "word"]).unionByName(
        asked.filter(F.col("before") == ITSELF).join(model.singles, "word"), allowMissingColumns=True)
    sent = found.withColumn("kind", F.lit(0)).unionByName(own.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return (sent.select("block", "kind", "row", "text", "before", "word", "a", "b", "c", "d").repartition("block")
            .sortWithinPartitions("block", "kind").mapInArrow(_block_features(model.unknown), f"{row}, a double, b double"))


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Weights (constant first) by Newton's method with a small ridge."""
    if len(set(y)) < 2:
        return np.array([math.log(prior / (1 - prior)), 0.0, 0.0])
    a = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(a.shape[1]), np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        grad = a.T @ (p - y) + ridge @ w
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, grad)
        w -= step / max(1.0, np.abs(step).max() / 2)
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, model: "Model | Tables", text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` (its other columns unread and unchanged) with the probability of being toxic.

    No shuffle for a model that is broadcast.  Null and empty texts are scored as texts without
    words; repeated rows stay, and an empty table gives no rows."""
    ship_package(docs.sparkSession)
    if isinstance(model, Tables):
        place = free_name(docs, "_row")
        rows = located(docs, place)
        w = [float(x) for x in model.curve]
        z = F.greatest(F.least(F.lit(w[0]) + w[1] * F.col("a") + w[2] * F.col("b"), F.lit(40.0)), F.lit(-40.0))
        found = _described(rows, place, text, model).select(F.col("row").alias(place), (1 / (1 + F.exp(-z))).alias(out))
        joined = rows.join(found, place, "left").drop(place)
        return joined.withColumn(out, F.coalesce(out, F.raise_error(F.lit("a document was not scored")).cast("double")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts))

    return docs.withColumn(out, run(F.col(text)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_toxicity": op7_toxicity}
