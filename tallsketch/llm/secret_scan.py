"""Secret scans through an incremental blob ledger.

Built-in DataFrame functions only.  Every version of every path is content-addressed: its blob
is the SHA-256 of its text.  The ledger, a folder of committed runs, remembers which blob was
scanned under which rule version and what was found, so a scan reads only the texts of blobs
with an unseen rule version, one text a blob; the findings are joined back to all paths.

* ``scanned``: (blob, rules), the rule versions that one run scanned a blob for;
* ``spans``: (blob, rule, start, end), one row per finding, in code points, end exclusive.

A run is written to its own folder, findings first; it counts once both parts are complete, so
a run that dies is scanned again and nothing is half-recorded.  A rule's version is a digest of
all that changes its findings: an edited rule is scanned anew, the others are not.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallsketch.llm.common import free_name, join_hot, located, small, stored, table
from tallsketch.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` code points;
    a shorter match is dropped, but the search goes on behind it."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def version(self) -> str:
        what = f"{self.kind}\n{self.pattern}\n{self.group}\n{self.least}"
        return f"{self.kind}:{hashlib.sha256(what.encode()).hexdigest()[:16]}"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: A maximal run is one match, so a run that is long enough can be asked for at once: ``AKIA``
#: with 16 more characters is ``AKIA[A-Z0-9]+`` of at least 20, and so for hex.
BASE = (
    Rule("assign", f"""({NAMES})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + ADDED

SCANNED = "blob binary, rules array<string>"
SPANS = "blob binary, rule string, start int, end int"


class Ledger:
    """The committed runs below a folder that all executors share."""

    def __init__(self, spark: SparkSession, uri: str):
        self.spark, self.uri = spark, uri.rstrip("/")

    def runs(self) -> list[str]:
        """Folders of the runs whose ``scanned`` part, the last one written, is complete."""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/run=*/scanned/_SUCCESS")
        found = done.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(done)
        return sorted(f.getPath().getParent().getParent().toString() for f in found or [])

    def _read(self, part: str, schema: str) -> DataFrame:
        paths = [f"{run}/{part}" for run in self.runs()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self._read("scanned", SCANNED)

    def spans(self) -> DataFrame:
        """Distinct findings: two runs at once may have scanned the same blob."""
        return self._read("spans", SPANS).distinct()

    def commit(self, spans: DataFrame, scanned: DataFrame) -> None:
        run = f"{self.uri}/run={uuid.uuid4().hex}"
        spans.write.parquet(f"{run}/spans")
        scanned.write.parquet(f"{run}/scanned")


def _long_enough(rule: Rule):
    return lambda s: F.char_length(F.regexp_extract(s, rule.pattern, rule.group)) >= rule.least


def _find(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Spans (blob, rule, start, end) of ``texts`` (blob, todo, text), each under its rules ``todo``.

    A match begins behind the text between the matches so far: the lengths of the gaps and of the
    matches are summed per text and rule, so the work is linear in the number of matches."""
    hits = []
    for r in rules:
        match = F.when(F.array_contains("todo", r.version), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)))
        hits.append(match.alias(f"m_{r.kind}"))
    found = texts.select("blob", "text", *hits)
    each = []
    for r in rules:
        m = F.col(f"m_{r.kind}")
        gaps = F.when(F.size(m) > 0, F.transform(F.split("text", r.pattern, -1), F.char_length))
        lens = F.transform(m, F.char_length)
        ok = F.transform(m, _long_enough(r))
        each.append(F.struct(F.lit(r.version).alias("rule"), gaps.alias("gaps"), lens.alias("lens"), ok.alias("ok")))
    rows = (
        found.filter(" or ".join(f"size(m_{r.kind}) > 0" for r in rules))
        .select("blob", F.explode(F.array(*each)).alias("x")).filter(F.size("x.lens") > 0)
        .select("blob", "x.rule", F.posexplode(F.arrays_zip(
            F.slice("x.gaps", 1, F.size("x.lens")).alias("gap"), F.col("x.lens").alias("len"), F.col("x.ok").alias("ok"))))
        .select("blob", "rule", "pos", F.col("col.gap").alias("gap"), F.col("col.len").alias("len"), F.col("col.ok").alias("ok"))
    )
    upto = Window.partitionBy("blob", "rule").orderBy("pos")
    end = F.sum(F.col("gap") + F.col("len")).over(upto)
    return rows.withColumn("end", end.cast("int")).filter("ok").select(
        "blob", "rule", (F.col("end") - F.col("len")).alias("start"), "end")


def scan(versions: DataFrame, keys: list[str], text: str, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per version of ``versions``: ``keys``, blob (lower-case hex) and spans, an array of
    (kind, start, end) by start, then in the order of ``rules``.

    Scans and records the blobs that ``ledger`` does not know under the versions of ``rules``.
    Null text counts as empty.  Repeated rows stay, each with its findings; keys may be null or
    repeat and other columns are not read, whatever their names.  Empty input gives no rows."""
    place = free_name(versions, "_place")
    rows = located(versions, place)
    ids = [r.version for r in rules]
    whole = F.coalesce(F.col(text), F.lit(""))
    entries = stored(rows.select(F.struct(*[F.col(k) for k in keys]).alias("id"), F.col(place).alias("place"),
                                 F.unhex(F.sha2(whole, 256)).alias("blob")), "secret-entries")
    blobs = stored(entries.groupBy("blob").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place")), "secret-blobs")
    known = (ledger.scanned().select("blob", F.explode("rules").alias("rule")).filter(F.col("rule").isin(ids))
             .groupBy("blob").agg(F.collect_set("rule").alias("known")))
    wanted = F.array(*[F.lit(i) for i in ids])
    todo = stored(blobs.join(known, "blob", "left")
                  .select("blob", "place", F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>"))).alias("todo"))
                  .filter(F.size("todo") > 0), "secret-todo")
    if todo.limit(1).count():
        # texts of files without an unseen blob stay where they are; the others meet their rows as
        # Spark's own size check says, by a broadcast of these narrow rows or a shuffle of the texts
        files = small(stored(todo.select("place.file").distinct(), "secret-files"))
        want = rows.select(F.col(place).alias("place"), whole.alias("text"))
        want = want.join(files, F.col("place.file") == files["file"], "left_semi")
        ledger.commit(_find(want.join(todo, "place"), rules), todo.select("blob", F.col("todo").alias("rules")))
    order = F.create_map(*[x for k, i in enumerate(ids) for x in (F.lit(i), F.lit(k))])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    found = (ledger.spans().filter(F.col("rule").isin(ids))
             .groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", order[F.col("rule")].alias("rank"), "end"))).alias("spans")))
    listed = F.transform(F.coalesce("spans", F.array().cast("array<struct<start:int,rank:int,end:int>>")),
                         lambda s: F.struct(F.element_at(kinds, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    per = stored(blobs.select("blob", "n").join(found, "blob", "left").select("blob", "n", listed.alias("spans")), "secret-found")
    out = join_hot(entries.select("id", "blob"), per, ["blob"], entries.count(), "n")
    return out.select("id.*", F.lower(F.hex("blob")).alias("blob"), "spans")


def _of_kind(*kinds: str):
    return lambda s: s["kind"].isin(*kinds)


def joined(spans, kinds: tuple[str, ...]):
    """``kind:start:end`` of the spans of these kinds, joined by commas."""
    return F.array_join(F.transform(F.filter(spans, _of_kind(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, scratch_path(spark, "secret-ledger"))
    found = scan(table(spark, sf_dir, "documents"), ["doc_id"], "text", ledger)
    spans = F.col("spans")
    counts = [F.size(F.filter(spans, _of_kind(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(spans, tuple(r.kind for r in BASE)), 256).alias("base_sha256"),
                        joined(spans, tuple(r.kind for r in RULES)).alias("spans"))


def _oracle() -> str:
    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    each = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, regexp_extract_all(t, {quoted(r.pattern)}) AS ms, "
        f"string_split_regex(t, {quoted(r.pattern)}) AS gs, {r.least} AS least, "
        f"regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS vs FROM d" for k, r in enumerate(RULES))
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({each}),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
s AS (SELECT doc_id, rank, kind, length(array_to_string(gs[1:i], '')) + length(array_to_string(ms[1:i - 1], '')) AS start,
             length(ms[i]) AS size FROM i WHERE length(vs[i]) >= least),
g AS (SELECT doc_id, {counts},
             string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rank) FILTER (kind IN ({base})) AS base,
             string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


QUERIES = {"op11_secret_scan": op11_secret_scan}
ORACLES = {"op11_secret_scan": _oracle()}
