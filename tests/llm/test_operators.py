"""The text operators against brute force on small tables with nulls, empty and long texts,
ties, repeated rows, clashing column names, and on empty tables."""

import collections
import hashlib
import io
import itertools
import math
import pickle
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallsketch.llm import (bpe, embedding_join, exact_dedup, licenses, minhash_dedup, packing, queries, sharding,
                            suffix_dedup, toxicity, warc)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, _row string, key string, n long"


def texts():
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(150)]
    prose = lambda n: " ".join(rng.choices(vocab, k=n))
    base, shared = prose(120), prose(30)
    out = [None, "", " \t\n", "one two", "One  TWO", "one two", "x" * 60, "x" * 45, "é" * 40, prose(4000)]
    out += [base, base.upper(), base + " more", base.replace(" ", "\n"), base]
    for k in range(14):
        words = base.split()
        for _ in range(rng.randint(1, 9)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append(" ".join(words))
    out += [f"{prose(20)} {shared} {prose(20)}" for _ in range(6)] + [prose(60) for _ in range(8)] + ["spam " * 50] * 2
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", "clash", 1) for k, t in enumerate(texts())]
    rng = random.Random(5)
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def by_id():
    return dict(enumerate(texts()))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 1 -----------------------------------------------------------------------------------

def test_licenses(spark):
    rows = [(0, "Some words here.\nReleased under the MIT License.\nMore words."), (1, None), (2, ""),
            (3, "You need a driving licence and the permission of the owner."),
            (4, "word " * 400 + "Licensed under the Apache License, Version 2.0. " + "word " * 400),
            (5, licenses.TEMPLATES["GPL"][1]), (None, "Licensed under CC BY-NC 4.0."), (None, "Licensed under CC BY-NC 4.0.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = licenses.train(df)
    got = [(r["doc_id"], {x["family"] for x in r["found"] if x["confirmed"]}) for r in licenses.scan(df, model).collect()]
    assert sorted(got, key=str) == sorted([(0, {"MIT"}), (1, set()), (2, set()), (3, set()), (4, {"Apache-2.0"}),
                                           (5, {"GPL"}), (None, {"CC-BY-NC"}), (None, {"CC-BY-NC"})], key=str)
    assert licenses.scan(empty(spark), licenses.train(empty(spark))).collect() == []


def test_license_lines_of_the_corpus(spark):
    want = {"MIT": "MIT License", "Apache-2.0": "Apache License", "GPL": "GNU General Public", "CC-BY-NC": "CC BY-NC"}
    df = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"]: r["families"] for r in licenses.op1_license_scan(spark, SF).collect()}
    for r in df.collect():
        assert found[r["doc_id"]] == ",".join(sorted(f for f, x in want.items() if x in r["text"]))


def test_license_background_of_repeated_lines(spark):
    """A repeated line counts once, template lines are left out, extra columns are not read."""
    template = licenses.TEMPLATES["MIT"][2]
    ordinary = [f"an ordinary line of the corpus about the software, number {k}" for k in range(30)]
    long = "the word of a very long line " * 3000
    rows = [(k, "one repeated line that grants no permission at all", "x") for k in range(5000)]
    rows += [(k, template, "x") for k in range(5000)] + [(k, "\n".join(ordinary), "x") for k in range(40)] + [(1, long, "x"), (1, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(4)
    _, vocab, pairs = licenses.vocabulary(licenses.variants()[0])
    model = licenses.Classifier([], vocab, pairs, np.empty((0, 0)), np.empty(0))
    assert len(licenses.background_features(df, model, "text", 4000)) == 32
    assert len(licenses.background_features(df, model, "text", 10)) == 10
    found = {r["doc_id"]: r["found"] for r in licenses.scan(df.filter(F.col("text") == template).limit(1), licenses.train(df)).collect()}
    assert [x["family"] for f in found.values() for x in f if x["confirmed"]] == ["MIT"]


# ---- 2 -----------------------------------------------------------------------------------

def brute_shard(key, weights):
    cost = lambda s: -math.log((int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) / weights[s]
    return min((s for s in range(len(weights)) if weights[s] > 0), key=cost)


def test_sharding(spark, docs, by_id):
    got = sharding.shard_digest(docs, 7).collect()
    assert len(got) == len(by_id)
    for r in got:
        t = (by_id[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(t) + 16, zlib.crc32(t), "key")
        assert r["shard"] == brute_shard(r["doc_id"], [1.0] * 7)
        assert r["grown_shard"] == brute_shard(r["doc_id"], [1.0] * 8) and r["grown_shard"] in (r["shard"], 7)
    for s in range(7):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_digest(empty(spark), 7).collect() == []
    same = spark.createDataFrame([(None, None)] * 5 + [(3, "a")] * 200, "doc_id long, text string")
    out = sharding.shard_digest(same, 4).collect()
    assert len(out) == 205 and len({(r["shard"], r["slot"]) for r in out}) == 205


def test_weighted_shards_move_few(spark):
    df = spark.range(4000).withColumnRenamed("id", "shard")
    a = {r["k"]: r["shard"] for r in sharding.assign_shards(df.select(F.col("shard").alias("k")), "k", [1.0, 2.0, 1.0]).collect()}
    b = {r["k"]: r["shard"] for r in sharding.assign_shards(df.select(F.col("shard").alias("k")), "k", [1.0, 2.0, 1.0, 0.0]).collect()}
    c = {r["k"]: r["shard"] for r in sharding.assign_shards(df.select(F.col("shard").alias("k")), "k", [1.0, 2.0, 1.0, 1.0]).collect()}
    assert a == b and abs(sum(s == 1 for s in a.values()) - 2000) < 150
    moved = [k for k in a if a[k] != c[k]]
    assert all(c[k] == 3 for k in moved) and abs(len(moved) - 800) < 120


# ---- 3 -----------------------------------------------------------------------------------

def brute_sets(by_id):
    out = {}
    for i, t in by_id.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_components(nodes, linked):
    low = {i: i for i in nodes}
    for _ in nodes:
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_near_dedup(spark, docs, by_id):
    sets = brute_sets(by_id)
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert len(links) > 20
    low = brute_components(sets, links)
    got = {r["doc_id"]: r for r in minhash_dedup.near_components(docs).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {
        i: (len(sets[i]), low[i], low[i] == i) for i in sets}
    kept = minhash_dedup.near_dedup(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i in low if low[i] == i}
    assert minhash_dedup.near_components(empty(spark)).collect() == []


def test_near_stage_links_from_80_on(spark):
    assert (minhash_dedup.DISTANCE, minhash_dedup.CHUNKS) == (23, 12)
    rng, by_id = random.Random(12), {}
    for base in range(0, 240, 8):  # each base and copies with one changed run of words
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(90, 140))]
        by_id[base] = " ".join(words)
        for k in range(1, 8):
            at, n = rng.randrange(5, 60), rng.randint(4, 16)
            by_id[base + k] = " ".join([*words[:at], *(f"v{rng.randrange(10**6)}" for _ in range(n)), *words[at + n :]])
    sets = brute_sets(by_id)
    links = {p: [(a, b) for a, b in itertools.combinations(sets, 2)
                 if 100 * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b])] for p in (80, 85)}
    low = {p: brute_components(sets, x) for p, x in links.items()}
    assert len(links[80]) > len(links[85]) + 20 and low[80] != low[85]
    docs = spark.createDataFrame(list(by_id.items()), "doc_id long, text string")
    for p in (80, 85):
        got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_components(docs, percent=p).collect()}
        assert got == low[p]
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert left == {i for i in sets if low[80][i] == i}


def test_every_pair_within_each_distance_shares_an_entry():
    rng = np.random.default_rng(3)
    for percent in (70, 80, 85, 95):
        distance = minhash_dedup.distance_of(percent)
        a = rng.integers(0, 2**16, (200, minhash_dedup.SYMBOLS), dtype=np.uint16)
        b = a.copy()
        for row in b:
            row[rng.choice(minhash_dedup.SYMBOLS, distance, replace=False)] ^= 1
        ea, eb = (minhash_dedup.entries(x, minhash_dedup.chunks_of(distance)) for x in (a, b))
        assert (ea == eb).any(axis=1).all()


def test_near_dedup_repeated_and_null_keys(spark):
    t = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(7, t), (7, t), (None, t), (None, "a b"), (9, t + " z")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash_dedup.near_components(df).collect()), key=str)
    assert sum(k for _, _, k in got) == 2 and (None, None, True) in got and (9, 7, False) in got


def test_every_pair_within_the_distance_shares_an_entry():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**16, (200, minhash_dedup.SYMBOLS), dtype=np.uint16)
    b = a.copy()
    for row in b:
        at = rng.choice(minhash_dedup.SYMBOLS, minhash_dedup.DISTANCE, replace=False)
        row[at] ^= 1
    ea, eb = minhash_dedup.entries(a), minhash_dedup.entries(b)
    assert (ea == eb).any(axis=1).all()


def test_groups_of_many_blocks(spark):
    """A group larger than three blocks finds links among rows that the first block misses."""
    from tallsketch.llm.blocks import linked_groups
    from tallsketch.llm.common import components

    pack = lambda slices: (np.concatenate([s.column("k").to_numpy() for s in slices]),)
    link = lambda a, b: np.abs(a[0][:, None] - b[0][None, :]) <= 1
    rows = [(1, k) for k in [0, 1, 2, 3, 10, 11, 20, 22, 23, 24, 30, 40, 41, 50]]
    edges = linked_groups(spark.createDataFrame(rows, "g long, k long"), "g", "k", [], pack, link, 3)
    got = {r["node"]: r["component"] for r in components(edges, "u", "v").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 10: 10, 11: 10, 22: 22, 23: 22, 24: 22, 40: 40, 41: 40}


def test_small_components_take_few_tasks(spark):
    """A search among few edges does not take a task per shuffle partition in every round."""
    from tallsketch.llm.common import components

    conf = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    edges = spark.createDataFrame([(k, k + 1) for k in range(5)] + [(90, 91), (91, 91), (92, 90)], "u long, v long")
    sc = spark.sparkContext
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        sc.setJobGroup("few-tasks", "components")
        got = {r["node"]: r["component"] for r in components(edges, "u", "v").collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {**{k: 0 for k in range(6)}, 90: 90, 91: 90, 92: 90}
    status = sc.statusTracker()
    stages = {s for j in status.getJobIdsForGroup("few-tasks") for s in status.getJobInfo(j).stageIds}
    infos = [i for i in map(status.getStageInfo, stages) if i]
    assert len(infos) > 10 and max(i.numTasks for i in infos) < 100


# ---- 4 -----------------------------------------------------------------------------------

def test_archives(spark):
    big, other = "<p>é</p>\nWARC/1.0\r\n\r\n" + "x" * 1000, "y" * 999
    rows = [(1, "http://a/ b", big), (2, None, big), (5, "http://c", big), (3, "http://d", other), (4, "http://e", other),
            (6, "http://f", None), (7, "http://g", ""), (None, "http://h\n", big), (8, "u", "filedesc://x 0 0 0 1\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                  for r in warc.archive_digest(spark, df, records=2).collect()), key=str)
    want = []
    for k, _, h in rows:
        b = (h or "").encode()
        again = h == big and k != 5
        want.append((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 5 if again else None))
    assert got == sorted(want, key=str)
    assert warc.archive_digest(spark, df.limit(0)).collect() == []


def test_both_arc_versions_in_one_run(spark, tmp_path):
    df = spark.range(40).selectExpr("id as page_id", "'http://a' as url", "repeat('z', 1500) as html", "id as file", "id as block").repartition(4)
    warc.write_arc(df, str(tmp_path / "arc"))
    blocks = [warc._open(f.read_bytes()).read().split(b"\n")[1] for f in (tmp_path / "arc").glob("part-*")]
    assert sorted(b[:1] for b in blocks) == [b"1", b"1", b"2", b"2"]
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.archive_digest(spark, df).collect()}
    assert got == {k: ("response", None) if k == 39 else ("revisit", 39) for k in range(40)}


def test_equal_page_ids_and_long_pages(spark):
    long = "<p>" + "k" * 3_000_000
    df = spark.createDataFrame([(1, "u", long), (1, "u", long), (2, "v", "b" * 1200), (2, "w", "c" * 1200)],
                               "page_id long, url string, html string")
    got = sorted((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.archive_digest(spark, df).collect())
    assert got == [(1, 3_000_003, "response", 0), (1, 3_000_003, "revisit", 1), (2, 1200, "response", 0), (2, 1200, "response", 0)]


def test_arc_versions_and_broken_files():
    block = b"HTTP/1.1 200 OK\r\nX-Page-Id: 4\r\n\r\nbody\n\nfiledesc://"
    for v in (1, 2):
        data = warc.version_block(v, "f.arc") + b"\n" + warc.arc_record(v, "http://a b", "20010203040506", block, 9, "f.arc") + b"\n"
        (offset, head, got), = warc.parse_arc(io.BytesIO(data))
        assert got == block and head["URL"] == "http://a%20b" and data[offset:].startswith(b"http://a%20b")
        with pytest.raises(ValueError):
            list(warc.parse_arc(io.BytesIO(data[:-5])))
    with pytest.raises(ValueError):
        list(warc.parse_arc(io.BytesIO(b"http://x 0.0.0.0 1 t 3\nabc\n")))
    assert warc.iso_date("20010203040506") == "2001-02-03T04:05:06Z"


# ---- 5 -----------------------------------------------------------------------------------

def test_exact_dedup(spark, docs, by_id):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in by_id.items()}
    got = {r["doc_id"]: r for r in exact_dedup.classes(docs, capacity=3, max_depth=6).collect()}
    assert set(got) == set(norm)
    for i, t in norm.items():
        same = [j for j in norm if norm[j] == t]
        keep = min(same, key=lambda j: (-len(by_id[j] or ""), j))
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (
            keep, len(same), keep == i, hashlib.sha256(t.encode()).hexdigest())
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(norm.values()))
    assert exact_dedup.classes(empty(spark)).collect() == []
    same = spark.createDataFrame([(3, "a")] * 4 + [(None, "a ")], "doc_id long, text string")
    out = exact_dedup.classes(same).collect()
    assert sum(r["kept"] for r in out) == 1 and {r["group_size"] for r in out} == {5} and {r["keep_id"] for r in out} == {None}


def test_directory_doubles(spark):
    df = spark.createDataFrame([(0,)] * 5 + [(1,)] * 5 + [(8,)] * 1, "prefix int")
    got = {r["prefix"]: (r["depth"], r["bucket"]) for r in exact_dedup.directory(df, 5, 4).collect()}
    assert got == {0: (4, 16), 1: (4, 17), 8: (1, 3)}


# ---- 6 -----------------------------------------------------------------------------------

def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 6))
    x = np.concatenate([base, base[:6] + 0.1 * rng.normal(size=(6, 6)), base[:3], [base[0] * 2]])
    rows = [(k, [float(np.float32(v)) for v in row], k % 2 if k < 12 else (k % 6) % 2, "c") for k, row in enumerate(x)]
    rows += [(100, None, 0, "c"), (101, [], 0, "c"), (102, [0.0] * 6, 0, "c"), (103, [float("nan")] * 6, 0, "c"),
             (104, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, "c"), (105, rows[0][1], None, "c"), (106, [float("inf")] * 6, 1, "c"),
             (107, [1.0, 2.0], 0, "c"), (108, [2.0, 4.0], 0, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, grp string").repartition(3)
    monkeypatch.setattr(embedding_join, "BLOCK", 3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"])
           for r in embedding_join.linked(df, "vec_id", "embedding", "label", 0.93).collect()}

    def fine(v):
        return v and all(a is not None and math.isfinite(a) for a in v) and any(v)

    def cosine(a, b):
        a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
        return a @ b / np.linalg.norm(a) / np.linalg.norm(b)

    links = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if a[2] is not None and a[2] == b[2]
             and fine(a[1]) and fine(b[1]) and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.93]
    assert links
    low = brute_components([r[0] for r in rows], links)
    assert got == {r[0]: (sum(r[0] in p for p in links), low[r[0]], low[r[0]] == r[0]) for r in rows}
    assert embedding_join.linked(df.limit(0), "vec_id", "embedding", "label", 0.93).collect() == []


def test_embeddings_of_extreme_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1e200]), (3, [3.0, 3.0]), (4, [1e-200, 1e-200]), (5, [1e-310, 1e-310]),
            (6, [1e300, -1e300]), (7, [1.0, 1.0, 1e-300]), (8, [0.0, 0.0])]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_join.linked(df, "vec_id", "embedding", "label", 0.93).collect()}
    assert got == {**{k: (4, 1) for k in range(1, 6)}, 6: (0, 6), 7: (0, 7), 8: (0, 8)}


# ---- 7 -----------------------------------------------------------------------------------

def test_toxicity(spark):
    rng = random.Random(1)
    vocab, bad = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)], ["vile", "nasty", "rotten"]
    rows, labels = [], []
    for k in range(1500):
        w = rng.choices(vocab, k=rng.randint(5, 60))
        toxic = k % 5 == 0
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((k, " ".join(w), "clash"))
        labels.append((k, int(toxic)))
    rows += [(9000, None, ""), (9001, "", ""), (None, "vile nasty rotten", ""), (9002, " ".join(rng.choices(vocab, k=20_000)), "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _toxic string")
    marks = spark.createDataFrame(labels + [(3, None), (None, 1), (5, 1)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, marks)).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    held = [(r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in scored
            if r["doc_id"] is not None and r["doc_id"] < 1500 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(held) / len(held) > 0.98
    by = {r["doc_id"]: r["score"] for r in scored}
    assert by[None] > 0.5 > by[9002] and by[9000] < 0.5 and by[9001] == by[9000]
    none = toxicity.fit(docs.limit(0), marks.limit(0))
    assert {r["score"] for r in toxicity.score(docs.limit(3), none).collect()} == {0.5}


def test_all_labels_are_counted(spark, monkeypatch):
    """Labelled documents beyond the curve's sample teach the models; a model kept as a table
    gives the scores of the one that is broadcast."""
    rng = random.Random(6)
    vocab = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)]
    order = sorted(range(1200), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    late = {k for k in order[600:] if k % 3 == 0}  # outside the first 400 by md5
    rows, labels = [], []
    for k in range(1200):
        w = rng.choices(vocab, k=rng.randint(5, 40))
        for bad in ["vile"] * 3 * (k % 3 == 0 and k not in late) + ["fiend"] * 3 * (k in late):
            w.insert(rng.randrange(len(w)), bad)
        rows.append((k, " ".join(w), "clash"))
        labels.append((k, int(k % 3 == 0)))
    probe = [(5000, "vile " + rows[1][1], ""), (5001, "fiend fiend fiend " + rows[1][1], ""), (5002, None, ""), (5003, "", ""), (5003, "new word", "")]
    docs = spark.createDataFrame(rows + probe, "doc_id long, text string, _row string").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, max_docs=400)
    assert isinstance(model, toxicity.Model)
    key = lambda r: (r["doc_id"], r["text"] or "", r["score"])
    small = sorted(map(key, toxicity.score(docs, model).collect()))
    assert dict((i, s) for i, _, s in small)[5001] > 0.5
    monkeypatch.setattr(toxicity, "MODEL_BYTES", 0)
    tables = toxicity.fit(docs, marks, max_docs=400)
    assert isinstance(tables, toxicity.Tables)
    scored = toxicity.score(docs, tables)
    assert scored.columns == [*docs.columns, "score"]
    large = sorted(map(key, scored.collect()))
    assert [x[:2] for x in large] == [x[:2] for x in small]
    assert np.allclose([x[2] for x in large], [x[2] for x in small], atol=1e-12)


def brute_kneser_ney(rows, toxic_of, in_models):
    """Both models by their definition over plain dictionaries: log ratios of a list of words."""
    docs = {c: [toxicity.words(t) for k, t in rows if in_models(k) and toxic_of.get(k) == c] for c in (0, 1)}
    single = {c: collections.Counter(w for d in docs[c] for w in set(d)) for c in docs}
    pair = {c: collections.Counter(p for d in docs[c] for p in set(zip(d, d[1:]))) for c in docs}
    left = collections.Counter(w for _, w in {**pair[0], **pair[1]})
    begun = {c: collections.Counter() for c in docs}
    for c in docs:
        for (u, _), n in pair[c].items():
            begun[c][u] += n
    D, known = toxicity.DISCOUNT, {w for w in {**single[0], **single[1]} if single[0][w] + single[1][w] >= toxicity.MIN_WORD}
    seen = {p for p in {**pair[0], **pair[1]} if pair[0][p] + pair[1][p] >= toxicity.MIN_PAIR}
    among = sum(left.values()) + 0.5 * (len(known) + 1)
    over = lambda n: max(n - D, 0.0)
    total = {c: max(sum(single[c].values()), 1) for c in docs}
    rest = {c: 1 - sum(over(single[c][w]) for w in known) / total[c] for c in docs}
    spread = {c: collections.Counter() for c in docs}
    for u, w in seen:
        for c in docs:
            spread[c][u] += over(pair[c][u, w]) / max(begun[c][u], 1)

    def ratio(w, before):
        p = {}
        for c in docs:
            uni = over(single[c][w]) / total[c] + rest[c] * (left[w] + 0.5) / among if w in known else rest[c] * 0.5 / among
            weight = 1.0 if before is None or before not in known else max(1 - spread[c][before], 1e-6)
            bi = over(pair[c][before, w]) / max(begun[c][before], 1) if (before, w) in seen else 0.0
            p[c] = weight * uni + bi
        return math.log(p[1]) - math.log(p[0])

    return lambda found: [ratio(w, found[k - 1] if k else None) for k, w in enumerate(found)]


def test_toxicity_scores_a_large_batch_in_little_memory():
    """A batch of texts is described in slices of bounded size; texts without words, one longer than a
    slice and the first word of each slice are described as by themselves."""
    import tracemalloc

    texts = [" ".join(f"w{chr(97 + (i * j) % 26)}{chr(97 + j % 7)}" for j in range(400)) for i in range(3000)]
    texts[3], texts[4], texts[700] = None, " 1 ", texts[5] * 300
    known = np.unique(np.concatenate([toxicity.hashed(toxicity.words(t)) for t in texts[:50]]))
    pairs = np.unique(toxicity.pair_keys(known[:-1], known[1:]))
    share = np.random.default_rng(1).uniform(0.1, 1, (6, 1 + max(len(known), len(pairs))))
    model = toxicity.Model(known, share[:2, :1 + len(known)], share[2:4, :1 + len(known)], pairs, share[4:, :1 + len(pairs)])
    tracemalloc.start()
    got = model.features(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20, peak
    assert np.array_equal(got, np.concatenate([model.features([t]) for t in texts]))


def test_toxicity_memory_while_counting():
    """A task that counts grams takes its texts by slices and holds 24 bytes a gram, but for what sorts them."""
    import tracemalloc

    rng = np.random.default_rng(9)
    some = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(17_576)]
    texts = [" ".join(some[i] for i in rng.integers(0, len(some), 300)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([k % 2 for k in range(3000)], pa.int32())], names=["t", "y"])
    del texts
    toxicity.hashed(some)
    tracemalloc.start()
    try:
        rows = sum(len(b.column("before").values) for b in toxicity._count_grams(toxicity.COUNTED, 64, np.zeros(0, np.int64))(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows > 900_000
    assert peak < 130e6


@pytest.mark.parametrize("held,hot", [(toxicity.COUNTED, 500), (50, 20), (300, 1)])
def test_scores_are_kneser_ney(spark, monkeypatch, held, hot):
    """Every score equals that of models counted in dictionaries, whatever tasks hold at a time."""
    monkeypatch.setattr(toxicity, "COUNTED", held)
    monkeypatch.setattr(toxicity, "HOT", hot)
    monkeypatch.setattr(toxicity, "BUCKETS", 64 if hot == 500 else 5)
    rng = random.Random(12)
    vocab = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)] + ["É", "ñu"]
    rows = []
    for k in range(700):
        w = rng.choices(vocab, [1 / (j + 1) for j in range(len(vocab))], k=rng.randint(1, 30))
        rows.append((k, " ".join(w + ["vile", "thing"] * (k % 4 == 0)).replace("w", rng.choice("wW")) * rng.choice([1, 1, 1, 2])))
    rows += [(k, rows[k][1]) for k in range(3)] + [(800, None), (801, ""), (802, "unknown words"), (803, "one")]
    toxic_of = {k: int(k % 4 == 0) for k in range(690)} | {800: 1, 801: 0}
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, word string").repartition(4)
    marks = spark.createDataFrame(list(toxic_of.items()), "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, max_docs=160)
    learned = {k for k in toxic_of if zlib.crc32(str(k).encode()) % 5}
    md5 = lambda k: hashlib.md5(str(k).encode()).hexdigest()
    curve = sorted(((md5(k), k) for k, _ in rows if k in learned and zlib.crc32(md5(k).encode()) % 4 == 0))
    last = curve[:40][-1][0]
    sample = {k for _, k in curve if md5(k) <= last}
    ratios = brute_kneser_ney(rows, toxic_of, lambda k: k in learned and k not in sample)

    def features(text):
        r = ratios(toxicity.words(text))
        return [sum(r) / len(r), sum(max(x, 0) for x in sorted(r)[-3:]) / 3] if r else [0.0, 0.0]

    for k, t in rows:
        assert np.allclose(model.features([t])[0], features(t), rtol=1e-9, atol=1e-9), k
    x = np.array([features(t) for k, t in rows if k in sample])
    y = np.array([toxic_of[k] for k, _ in rows if k in sample], float)
    assert np.allclose(model.curve, toxicity._logistic(x, y, 0.5), atol=1e-6)


def test_a_large_model_scores_documents_where_they_are_read(spark, monkeypatch):
    """A model of more bytes than tasks may hold is mapped from a file: scoring shuffles nothing and
    gives the scores of the model that is broadcast."""
    rng = random.Random(16)
    vocab = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(400)]
    rows = [(k, " ".join(rng.choices(vocab, [1 / (j + 1) for j in range(400)], k=rng.randint(1, 60)) + ["vile"] * (k % 3 == 0))) for k in range(900)]
    rows += [(5000, None), (5001, ""), (5002, "unknown words"), (5003, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(900)], "doc_id long, toxic int")
    held = toxicity.fit(docs, marks, max_docs=400)
    small = dict(map(tuple, toxicity.score(docs, held).select("doc_id", "score").collect()))
    monkeypatch.setattr(toxicity, "PAIR_BYTES", 1 << 20)  # a few hundred pairs count as more than 128 MB
    monkeypatch.setattr(toxicity, "PART", 50)
    mapped = toxicity.fit(docs, marks, max_docs=400)
    assert len(held.pairs) > 200 and np.array_equal(mapped.pairs, held.pairs) and np.array_equal(mapped.words, held.words)
    for name in ("unigram", "context", "pair_p"):
        assert np.array_equal(getattr(mapped, name), getattr(held, name)), name
    scored = toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), mapped)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    large = dict(map(tuple, scored.select("doc_id", "score").collect()))
    assert large.keys() == small.keys() and np.allclose([large[k] for k in small], list(small.values()), atol=1e-12)
    assert len(pickle.dumps(mapped)) < 2000  # tasks get its name


def test_places_by_cells():
    """Keys are found by their cells, however they are spread."""
    rng = np.random.default_rng(3)
    ends = np.array([-2**63, -2**63 + 1, -1, 0, 1, 2**63 - 1])
    for among in (np.zeros(0, np.int64), np.array([5]), ends, np.arange(-700, 900), rng.integers(-2**63, 2**63 - 1, 5000), np.append(rng.integers(0, 2**20, 3000), ends)):
        among = np.unique(among.astype(np.int64))
        keys = np.concatenate([rng.permutation(among), ends, rng.integers(-2**63, 2**63 - 1, 500), rng.integers(-1000, 2**20, 500)])
        at = {int(k): 1 + n for n, k in enumerate(among)}
        assert toxicity._place(keys, among, toxicity._cells(among)).tolist() == [at.get(int(k), 0) for k in keys]


def test_many_labels_meet_texts_without_shuffling_them(spark, monkeypatch, tmp_path):
    """Labels too many to be broadcast by key mark places in the files; repeated, null and unknown keys
    give the rows of a join, and so do rows that have no place of their own."""
    rows = [(k if k % 50 else None, f"text {k}") for k in range(17_000)] + [(7, "again"), (9, None), (99_999, "no label")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "docs"))
    chosen = toxicity.training_rows(spark.createDataFrame([(k, k % 3 % 2) for k in range(0, 20_000, 2)] + [(7, 1), (9, 0)], "doc_id long, toxic int"))
    chosen = toxicity.stored(chosen, "chosen")
    there = spark.read.parquet(str(tmp_path / "docs"))
    twice = there.withColumn("doc_id", F.explode(F.array(F.col("doc_id"), F.col("doc_id") + 1)))
    for table, by_place in ((there, True), (docs, False), (twice, False)):
        want = sorted(map(str, toxicity._labelled(table, chosen, "doc_id", "text").collect()))
        with monkeypatch.context() as m:
            m.setattr(toxicity, "LABELS", 0)
            found = toxicity._labelled(table, chosen, "doc_id", "text")
        assert sorted(map(str, found.collect())) == want and len(want) > 5000
        assert ("_mark" in found._jdf.queryExecution().analyzed().toString()) == by_place
        if by_place:
            assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_sample_threshold_is_exact(spark):
    df = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("_order")).unionAll(spark.createDataFrame([("0" * 32,)] * 4, "_order string"))
    every = sorted(r[0] for r in df.collect())
    for size in (1, 3, 7, 500, 2999, 3004, 9000):
        assert toxicity.last_of_sample(df, size) == every[min(size, len(every)) - 1]
    assert toxicity.last_of_sample(df.limit(0), 5) == ""


def test_held_out_labels_are_not_learned(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(500)], "doc_id long, toxic int")
    rows = toxicity.training_rows(labels).collect()
    assert len(rows) > 350 and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows)


# ---- 8 -----------------------------------------------------------------------------------

def test_bpe(spark, docs, by_id):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    own = bpe.WordBpe(path)
    rng = random.Random(7)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x370, 0x400), *range(0x2000, 0x2070), 0x3000, 0xAC00, 0x1100, 0x1161, 0x1F600]]
    cases = [x or "" for x in by_id.values()] + ["".join(rng.choices(pool, k=rng.randint(0, 50))) for _ in range(500)]
    cases += ["<|endoftext|>hi <|startoftext|>", "the" * 2000, "ΑΣ", "IT'S"]
    for x in cases:
        ids = t.encode(x, add_special_tokens=False).ids
        assert own.encode(x) == ids and own.decode(ids) == t.decode(ids, skip_special_tokens=False)
        w = x.replace(" ", "")[:300].lower() or "a"
        parts = [own.symbols[b] for b in w.encode()]
        parts[-1] += own.end
        assert own._scan(list(parts)) == own._heap(list(parts))
    for r in bpe.digest(docs, "doc_id", "text", path).collect():
        ids = t.encode(by_id[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, "doc_id", "text", path), "doc_id", "ids", path)
    assert {r["doc_id"] for r in back.collect()} == set(by_id)


def test_bpe_digest_goes_through_decode(spark):
    P = pytest.importorskip("public_tokenizers")
    own = bpe.WordBpe(P.path("word_bpe_49k.json"))
    own.decode = lambda ids: "broken"
    assert {d for _, _, d in own.pieces("hello <|endoftext|> there")} == {"broken"}
    assert own.pieces("") is not None and list(own.pieces("x" * 5000)) and all(len(w) <= bpe.LONGEST for w in own.known)


def test_bpe_edges(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    assert bpe.digest(empty(spark), "doc_id", "text", path).collect() == []
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    got = bpe.digest(df, "doc_id", "text", path).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("1", 2), ("1", 2), ("None", 0), ("None", 2)]


# ---- 9 -----------------------------------------------------------------------------------

def brute_removed(rows, length):
    """rows: (order, bytes); the set of removed positions of each row."""
    out = []
    for o, b in rows:
        earlier = {x[k : k + length] for p, x in rows if p < o for k in range(len(x) - length + 1)}
        out.append({k + j for k in range(len(b) - length + 1) if b[k : k + length] in earlier for j in range(length)})
    return out


def test_run_length_index():
    rng = random.Random(3)
    for _ in range(150):
        length = rng.choice([2, 3, 5])
        strings = [bytes(rng.choices(b"ab\x00", k=rng.randint(1, 14))) for _ in range(rng.randint(1, 7))]
        orders = [rng.randint(0, 4) for _ in strings]
        index = suffix_dedup.RunLengthIndex(strings, length)
        begins = index.ends - np.array([len(s) + 1 for s in strings])
        want = {int(begins[k]) + p for k, s in enumerate(strings) for p in range(len(s) - length + 1)
                if any(s[p : p + length] in t and orders[j] < orders[k] for j, t in enumerate(strings))}
        assert set(index.marked(np.array(orders)).tolist()) == want


def test_index_grows_with_runs_and_drops_the_text():
    base = bytes(random.Random(4).choices(range(97, 123), k=2000))
    one, many = (suffix_dedup.RunLengthIndex([base] * n) for n in (1, 40))
    assert len(many.heads) < len(one.heads) + 100 and int(many.run_lengths.sum()) == 40 * 2001
    assert all(len(v) <= len(many.heads) for v in vars(many).values() if isinstance(v, np.ndarray))
    assert len(many.marked(np.arange(40))) == 39 * (2000 - 49)


def test_union_of_spans():
    rng = np.random.default_rng(5)
    for _ in range(100):
        n = int(rng.integers(0, 30))
        group, start = rng.integers(0, 4, n), rng.integers(0, 40, n)
        end = start + rng.integers(1, 9, n)
        got = list(zip(*(x.tolist() for x in suffix_dedup._union(group, start, end))))
        rows = list(zip(group.tolist(), start.tolist(), end.tolist()))
        assert got == [(g, *x) for g in sorted({r[0] for r in rows}) for x in suffix_dedup.merge_spans([r[1:] for r in rows if r[0] == g])]


@pytest.mark.parametrize("rows", [1, 7, 1 << 16])
@pytest.mark.parametrize("share", [1.0, 0.5])
def test_marks_do_not_follow_blocks(rows, share, monkeypatch):
    """Spans of a task are the same however its rows are cut into batches, blocks and indexes; with
    half of the anchors hot, part of the strings goes by hashes whose keys run over batches."""
    rng = random.Random(11)
    monkeypatch.setattr(suffix_dedup, "ROWS", rows)
    monkeypatch.setattr(suffix_dedup, "INDEX", 200 * rows)
    pieces = [bytes(rng.choices(range(97, 103), k=rng.randint(20, 90))).decode() for _ in range(9)]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(30)] + [pieces[0] * 5, pieces[0] * 5 + "z", "", "é" * 60, "aé" * 60]
    docs = [(k // 2 if k < 6 else k, t) for k, t in enumerate(texts)]
    found = {i: h for i, _, h in suffix_dedup.anchors([t.encode() for _, t in docs])}
    every = sorted({x for h in found.values() for x in h.tolist()})
    hot = set(every[int(len(every) * share) :])
    batches = [pa.RecordBatch.from_pydict({
        "ord": pa.array([docs[i][0] for i in part], pa.int64()), "tag": pa.array(part, pa.int32()), "text": [docs[i][1] for i in part],
        "hs": pa.array([found.get(i, np.empty(0, np.uint64)).view(np.int64) for i in part], pa.list_(pa.int64())),
        "locals": pa.array([[] for _ in part], pa.list_(pa.binary()))}) for part in (list(range(0, 20)), list(range(20, 35)))]
    sent = pa.Table.from_batches(suffix_dedup._surroundings(50, hot)(iter(batches))).sort_by(
        [("key", "ascending"), ("ord", "ascending"), ("start", "ascending")])
    got = {i: set() for i in range(len(docs))}
    for b in suffix_dedup._mark(50)(iter(sent.to_batches(max_chunksize=max(2, rows)))):
        for i, a, e in zip(*(b.column(c).to_pylist() for c in ("tag", "start", "end"))):
            got[i].update(range(a, e))
    want = brute_removed([(o, t.encode()) for o, t in docs], 50)
    assert [got[i] for i in got] == [set(g) for g in want]


@pytest.mark.parametrize("hot", [5000, 0])
def test_suffix_dedup(spark, docs, by_id, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 0.0 if hot == 0 else 0.01)
    monkeypatch.setattr(suffix_dedup, "MARKS", hot)
    rows = [(i, (t or "").encode()) for i, t in sorted(by_id.items())]
    got = {r["doc_id"]: r for r in suffix_dedup.digest(docs).collect()}
    for (i, b), gone in zip(rows, brute_removed(rows, 50)):
        keep = bytes(c for k, c in enumerate(b) if k not in gone)
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(b), len(gone), hashlib.sha256(keep).hexdigest())
        assert r["n_spans"] == sum(k - 1 not in gone for k in gone)
    if hot:
        cut = {r["doc_id"]: r["text"] for r in suffix_dedup.remove_repeats(docs).collect()}
        assert cut[0] is None and len(cut) == len(rows) and suffix_dedup.remove_repeats(docs).columns == docs.columns
        assert suffix_dedup.digest(empty(spark)).collect() == []


def test_hot_passage_gathers_in_no_group(spark, monkeypatch):
    """Documents that share a passage between bytes of their own: no key gets a row per document."""
    rng = random.Random(8)
    own = lambda n: bytes(rng.choices(range(97, 123), k=n)).decode()
    passage = own(130)
    rows = [(k, own(rng.randint(40, 90)) + passage + own(rng.randint(0, 90))) for k in range(300)]
    rows += [(300, passage[:90]), (301, "x" * 200), (302, "y" + "x" * 120 + passage), (302, passage + passage), (None, passage * 2)]
    found = {i: h for i, _, h in suffix_dedup.anchors([t.encode() for _, t in rows])}
    count = collections.Counter(x for h in found.values() for x in set(h.tolist()))
    hot = {x for x, n in count.items() if n > 50}
    assert hot
    batches = [pa.RecordBatch.from_pydict({
        "text": [t for _, t in rows[k : k + 30]], "ord": [o for o, _ in rows[k : k + 30]], "tag": pa.array([0] * 30, pa.int32()),
        "hs": [found[i].view(np.int64).tolist() for i in range(k, k + 30)],
        "locals": pa.array([[]] * 30, pa.list_(pa.binary()))}) for k in range(0, 300, 30)]
    sent = pa.Table.from_batches(suffix_dedup._surroundings(50, hot)(iter(batches))).to_pylist()
    keys = collections.Counter(r["key"] for r in sent if r["around"] is not None)
    assert max(keys.values()) <= len(batches)

    monkeypatch.setattr(suffix_dedup, "HOT", 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digest(docs).collect())
    order = [(2**63 if o is None else o, t.encode()) for o, t in rows]
    want = [(len(b), len(g), sum(k - 1 not in g for k in g), hashlib.sha256(bytes(c for k, c in enumerate(b) if k not in g)).hexdigest())
            for (_, b), g in zip(order, brute_removed(order, 50))]
    assert got == sorted(want)


def test_anchors_count_every_occurrence():
    """A line repeated within documents makes an anchor hot like a line of many documents."""
    line = "".join(random.Random(9).choices("abcdefghijklmnop", k=30))
    batch = pa.RecordBatch.from_pydict({"ord": [1, 2, 2], "tag": pa.array([1, 2, 3], pa.int32()), "text": [line * 40, line * 30, line * 20]})
    rows = pa.Table.from_batches(suffix_dedup._anchor_rows(50)(iter([batch]))).to_pylist()
    assert max(r["times"] for r in rows) > 80
    same = batch.slice(1)
    rows = pa.Table.from_batches(suffix_dedup._anchor_rows(50)(iter([same]))).to_pylist()
    per = collections.Counter()
    for r in rows:
        per[r["h"]] += r["times"]
    assert max(per.values()) == sum(max(collections.Counter(h.tolist()).values()) for _, _, h in suffix_dedup.anchors([(line * 30).encode(), (line * 20).encode()]))


def test_suffix_dedup_repeated_and_null_keys(spark):
    a, b = "abcdefghij" * 8, "0123456789" * 7
    rows = [(2, a), (2, a + b), (1, b), (None, a), (None, "q" * 70), (None, "q" * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digest(df).collect())
    order = [(2**63 if k is None else k, t.encode()) for k, t in rows]
    assert got == sorted((len(t), len(g)) for (_, t), g in zip(order, brute_removed(order, 50)))


def test_remove_repeats_keeps_columns_of_any_name(spark):
    a = "abcdefghij" * 8
    names = ["spans", "_sha", "_ord", "_tag", "_bytes", "ord", "tag", "key", "rest", "h", "a.b"]
    df = spark.createDataFrame([(1, a, *names), (2, "new " + a, *names), (3, None, *names)],
                               "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = suffix_dedup.remove_repeats(df)
    assert got.columns == df.columns
    assert sorted((r["doc_id"], r["text"], *r[2:]) for r in got.collect()) == [(1, a, *names), (2, "new ", *names), (3, None, *names)]
    assert suffix_dedup.remove_repeats(df.limit(0)).collect() == []


# ---- 10 ----------------------------------------------------------------------------------

def test_boundaries_are_optimal():
    rng = random.Random(9)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 20) for _ in lengths]
        k = rng.randint(1, 4)

        def padding(ends):
            return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))

        best = min(padding([*some, lengths[-1]]) for r in range(min(k, len(lengths)))
                   for some in itertools.combinations(lengths[:-1], r))
        got = packing.boundaries(np.array(lengths), np.array(counts), k)
        assert len(got) <= k and got[-1] == lengths[-1] and padding(got) == best


def test_boundaries_of_long_rows_are_optimal(spark):
    """Above a thousand tokens too; null and repeated keys are packed like any other."""
    rng = np.random.default_rng(2)
    lengths = np.unique(np.concatenate([rng.integers(1, 3000, 150), rng.integers(3000, 400_000, 150)]))
    counts = rng.integers(1, 50, len(lengths))
    rows = np.concatenate([[0], np.cumsum(counts)])
    best = lengths * rows[1:]
    for k in range(1, 8):
        if k > 1:
            best = np.array([min([best[j], *(best[i] + lengths[j] * (rows[j + 1] - rows[i + 1]) for i in range(j))]) for j in range(len(lengths))])
        ends = np.array(packing.boundaries(lengths, counts, k))
        assert len(ends) <= k and (ends[np.searchsorted(ends, lengths)] * counts).sum() == best[-1]
    df = spark.createDataFrame([(None, 5), (None, 5), (1, 2000), (1, 2000), (2, 2001)], "k long, n long")
    got = [(r["n_tokens"], r["bucket_length"]) for r in packing.pack(df, "k", F.col("n"), buckets=3).collect()]
    assert sorted(got) == [(5, 5), (5, 5), (2000, 2000), (2000, 2000), (2001, 2001)]


def test_packing(spark, docs, by_id):
    got = packing.pack(docs, "doc_id", packing.words(F.col("text")), buckets=4, budget=300).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in by_id.items()}
    batches = {}
    for r in got:
        assert r["n_tokens"] <= r["bucket_length"]
        batches.setdefault((r["bucket"], r["batch"]), []).append(r)
    for rows in batches.values():
        assert len(rows) == 1 or len(rows) * rows[0]["bucket_length"] <= 300
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert packing.pack(empty(spark), "doc_id", packing.words(F.col("text"))).collect() == []


# ---- the pipeline and the catalogue --------------------------------------------------------

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r["doc_id"] for r in docs.collect()}
    cols = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path_ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(path_ids) == len(set(path_ids)) and set(path_ids) <= left
        if name == "exact dedup":
            norm = {r["doc_id"]: re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in docs.collect()}
            assert len(path_ids) == len(set(norm.values()))
        if name in ("suffix-array dedup", "packing"):
            assert set(path_ids) == left
        if name != "packing":
            assert out.columns == cols
            from tallsketch.llm.common import stored
            docs = stored(out, "stage")
        left = set(path_ids)


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        res = con.execute(sql)
        names = [d[0] for d in res.description]
        want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in res.fetchall()), key=str)
        assert sorted(names) == sorted(df.columns)
        assert sorted((tuple(r[c] for c in sorted(names)) for r in df.collect()), key=str) == want
