"""BPE encoding and decoding with a contiguous rank array per word.

A word is held as part boundaries and, beside each boundary, the rank of merging the parts on
both sides of the next one.  The encoder scans for the smallest rank (the leftmost of equals),
deletes that boundary and refreshes the two neighbouring ranks.  Words longer than ``SHORT``
bytes would make the scan quadratic; they use the same merges through a heap of
(rank, position), which picks the same boundary each time.

The vocabulary file is read once per Python worker from the path given; it must exist on every
worker (a path, never a copy in this repository).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tallsketch.llm.common import table
from tallsketch.session import ship_package

#: Longest word, in symbols, that is encoded by scanning.
SHORT = 128
#: Words whose ids a worker remembers, and the longest of them in characters.
CACHE, LONGEST = 200_000, 128

#: Fixed: the white space of the tokenizer's regular expressions (Unicode White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed: the tokenizer's word pattern, with that white space spelled out.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+"
NONE = float("inf")


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: itself if printable in Latin-1, else 256, 257, ..."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class WordBpe:
    """Encoder and decoder of a vocabulary file with word ends and lower-cased input."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): r for r, m in enumerate(model["merges"])}
        self.tokens = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        self.symbols = byte_symbols()
        self.known: dict[str, tuple[int, str, str]] = {}

    def merge(self, word: str) -> list[str]:
        """The parts of one word after all merges."""
        parts = [self.symbols[b] for b in word.encode("utf-8")]
        parts[-1] += self.end
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[str]) -> list[str]:
        rank = self.ranks.get
        ranks = [rank(p, NONE) for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NONE)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NONE)
        return parts

    def _heap(self, parts: list[str]) -> list[str]:
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive: list[str | None] = list(parts)
        queue = [(r, i, p) for i, p in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get(p)) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, (left, right) = heapq.heappop(queue)
            j = after[i]
            if j >= n or alive[i] != left or alive[j] != right:
                continue
            alive[i], alive[j] = left + right, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n:
                    pair = (alive[a], alive[after[a]])
                    if (r := self.ranks.get(pair)) is not None:
                        heapq.heappush(queue, (r, a, pair))
        return [p for p in alive if p is not None]

    def word(self, word: str) -> tuple[int, str, str]:
        """(number of ids, the ids as text, the ids decoded) of a word; short words are remembered."""
        ids = [self.vocab[p] for p in self.merge(word)]
        got = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        if len(word) <= LONGEST:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[word] = got
        return got

    def pieces(self, text: str) -> Iterator[tuple[int, str, str]]:
        known = self.known
        for part in self.cut.split(text) if self.cut else [text]:
            if (i := self.special.get(part)) is not None:
                yield 1, str(i), self.decode([i])
                continue
            # lower-casing is by character: a final capital sigma has no form of its own
            clean = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            for w in self.words.findall(clean):
                yield known.get(w) or self.word(w)

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.pieces(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by blanks: this vocabulary has no decoder step."""
        return " ".join(self.tokens[i] for i in ids)


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, ids array<int>) per row; null text gives no ids.  No shuffle."""
    ship_package(df.sparkSession)

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            ids = pa.array([bpe.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """(key, text) per row; null ids give an empty text.  No shuffle."""
    ship_package(df.sparkSession)

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            texts = pa.array([bpe.decode(i or []) for i in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")


def digest(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) per row, in one pass without a shuffle.

    Null and empty text give no tokens; repeated rows and null keys are encoded like any other;
    other columns are not read; empty input gives no rows.  A word's ids are decoded once and
    remembered with it; decoded words are joined as ``decode`` joins tokens, by a blank."""
    ship_package(df.sparkSession)

    def run(batches):
        bpe = loaded(path)
        sha = hashlib.sha256
        for b in batches:
            counts, ids, back = [], [], []
            for t in b.column(1):
                got = list(bpe.pieces(t.as_py() or ""))
                n, i, d = zip(*got) if got else ((), (), ())
                counts.append(sum(n))
                ids.append(sha(" ".join(i).encode()).hexdigest())
                back.append(sha(" ".join(d).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op8_bpe_encoding": op8_bpe_encoding}
