"""Spelling variants: words that differ by one edit, grouped under their frequent form.

Asymmetric q-chunks: of two words one edit apart, the shorter (or, of equal length, the smaller)
contributes two disjoint chunks of q = half its length, the other its positional grams of that
length.  One edit touches at most one of the chunks, so the other chunk is a gram of the longer
word, at most one place further on.  Words meet by (length of the chunked word, place of the
chunk, gram), grams being entered under the chunk places within shift one of their own; what
meets is verified by edit distance.

A gram may be shared by very many words (a common prefix or ending).  Where both sides of a meeting
exceed ``CROWD`` words, nothing is paired there; the words of such meetings go by what is left
when one code point is deleted, whose groups are bounded by the alphabet.  The result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallsketch.llm.common import stored, table

#: Code points and occurrences that make a word.
LEAST, OCCURRENCES = 7, 2
#: A form occurs at least so many times as often as its variant.
RATIO = 10
#: A document's occurrence of a run is altered when this divides its hash.
ALTERED = 31
#: Words on both sides of a meeting beyond which its words go by deletions.
CROWD = 256

RUN = r"[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(word: Column) -> Column:
    """Lower-case A-Z only; plain words take the built-in way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def altered(word: Column, key: Column) -> Column:
    """The lower-cased run, without one code point where its hash with the key says so."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = (h % F.char_length(word)).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    return F.when(h % ALTERED == 0, cut).otherwise(word)


def words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(word, n): the words of all documents with at least OCCURRENCES occurrences.  A maximal run
    of LEAST code points or more is one match; counts are added up before the shuffle."""
    runs = docs.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(
        F.col(text), F.lit(f"{RUN}{{{LEAST},}}"), F.lit(0))).alias("run"))
    made = runs.select(F.col("key"), lowered(F.col("run")).alias("run")).select(altered(F.col("run"), F.col("key")).alias("word"))
    counts = made.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.col("n") >= OCCURRENCES) & (F.char_length("word") >= LEAST))


def chunks(vocabulary: DataFrame) -> DataFrame:
    """(size, place, gram, word): each word's two disjoint chunks."""
    q = F.floor(F.char_length("word") / 2).cast("int")
    at = vocabulary.select("word", F.char_length("word").alias("size"), q.alias("q"),
                           F.explode(F.array(F.lit(0), q)).alias("place"))
    return at.select("size", "place", F.substring(F.col("word"), F.col("place") + 1, F.col("q")).alias("gram"), "word")


def grams(vocabulary: DataFrame) -> DataFrame:
    """(size, place, gram, word): each word's positional grams, as they may hold a chunk of a word of
    ``size`` (its own length or one less) that begins at ``place``, within shift one of the gram."""
    length = F.char_length("word")
    sized = vocabulary.select("word", length.alias("length"), F.explode(F.array(length, length - 1)).alias("size"))
    q = F.floor(F.col("size") / 2).cast("int")
    placed = sized.select("word", "length", "size", q.alias("q"), F.explode(F.sequence(F.lit(0), F.col("length") - q)).alias("at"))
    near = placed.select("word", "size", "q", "at", F.explode(F.array(F.lit(0), F.col("q"))).alias("place")).filter(
        F.abs(F.col("at") - F.col("place")) <= 1)
    return near.select("size", "place", F.substring(F.col("word"), F.col("at") + 1, F.col("q")).alias("gram"), "word").distinct()


def _ordered(s: Column, t: Column) -> Column:
    """The chunked word of a pair comes first: the shorter, or the smaller of equal length."""
    return (F.char_length(s) < F.char_length(t)) | ((F.char_length(s) == F.char_length(t)) & (s < t))


def _by_deletions(crowded: DataFrame) -> DataFrame:
    """Pairs of words one edit apart among ``crowded``: a word and another without one code point,
    or two words without the code point at the same place."""
    length = F.char_length("word")
    cut = crowded.select("word", F.explode(F.sequence(F.lit(1), length)).alias("at")).select(
        "word", "at", F.concat(F.substring(F.col("word"), F.lit(1), F.col("at") - 1),
                               F.substring(F.col("word"), F.col("at") + 1, F.char_length("word"))).alias("rest"))
    cut = stored(cut, "spelling-cuts")
    longer = cut.select("rest", F.col("word").alias("t")).distinct().join(
        crowded.select(F.col("word").alias("rest")), "rest").select(F.col("rest").alias("s"), "t")
    same = cut.select("at", "rest", F.col("word").alias("s")).join(
        cut.select("at", "rest", F.col("word").alias("t")), ["at", "rest"]).filter("s < t").select("s", "t")
    return longer.unionByName(same)


def near_pairs(vocabulary: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(s, t): the pairs of distinct words one edit apart, each once."""
    meet = ["size", "place", "gram"]
    left, right = stored(chunks(vocabulary), "spelling-chunks"), stored(grams(vocabulary), "spelling-grams")
    sides = left.select(*meet, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(*meet, F.lit(0).alias("l"), F.lit(1).alias("r")))
    full = stored(sides.groupBy(*meet).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
                  .filter((F.col("l") > crowd) & (F.col("r") > crowd)).select(*meet), "spelling-crowds")
    met = left.join(full, meet, "left_anti").withColumnRenamed("word", "s").join(
        right.withColumnRenamed("word", "t"), meet)
    close = met.filter(_ordered(F.col("s"), F.col("t")) & (F.levenshtein("s", "t", 1) == 1)).select("s", "t")
    crowded = left.join(full, meet, "left_semi").select("word").unionByName(
        right.join(full, meet, "left_semi").select("word")).distinct()
    return close.unionByName(_by_deletions(stored(crowded, "spelling-crowded"))).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words (word, form) that have a form: pointers are followed two at a time
    until none moves.  Counts grow RATIO-fold on the way, so the rounds are few."""
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                            F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not nxt.filter("moved").limit(1).count():
            return nxt.select("word", "root")
        now = nxt.drop("moved")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """A row per word: word, form, root, n, n_near, form_n.

    Null and empty texts have no words; a null key hashes as an empty one; repeated rows count each
    time.  Of near words with the same n the first in code-point order is the form.  Other columns
    are not read; empty input gives no rows."""
    vocabulary = stored(words(docs, key, text), "spelling-words")
    pairs = near_pairs(vocabulary.select("word"), crowd)
    both = pairs.select(F.col("s").alias("word"), F.col("t").alias("other")).unionByName(
        pairs.select(F.col("t").alias("word"), F.col("s").alias("other")))
    counted = both.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    out = stored(vocabulary.join(best, "word", "left").withColumn("ok", -F.col("best.m") >= RATIO * F.col("n")).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("ok"), F.col("best.other")).alias("form"), F.when(F.col("ok"), -F.col("best.m")).alias("form_n")), "spelling-forms")
    return out.join(_roots(out.filter("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


QUERIES = {"op13_spelling_variants": op13_spelling_variants}
