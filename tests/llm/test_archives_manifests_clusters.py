"""WARC archives, Merkle manifests and centroid clusters: against SQL, brute force and a round trip."""

import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import exponion_clusters, merkle_manifest, queries, warc


@pytest.mark.parametrize("name", ["op11_warc_revisits", "op12_merkle_manifest", "op13_exponion_clusters"])
def test_query_equals_duckdb(spark, sf_dir, name):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, sf_dir)
    found = c.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert sorted(map(tuple, df.select(*found.columns).collect()), key=repr) == sorted(found.fetchall(), key=repr)


RECORD = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (1, "http://a/WARC/1.1", "a", 7), (2, "v", "a", 7), (2, "v", "a", 7), (2, "va", "a", 7), (3, None, None, 7), (4, "x\r\nWARC/1.0: y", "", 7), (None, "n", "b", 7), (None, None, "b", 7),
    (5, "w", f"é {RECORD}{RECORD}\r\nWARC/1.\r\nWARC/1.0\r\n\r\n", 7), (6, "z", "x" * 300_000, 7), (7, "z", RECORD, 7), (8, "z", "\r\n\r\n", 7),
]


def plain_warc(data: bytes) -> list[tuple[dict, bytes]]:
    """The records of an archive, read by their lengths."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode().split("\r\n")
        assert head[0] == "WARC/1.1"
        fields = dict(x.split(": ", 1) for x in head[1:])
        to = end + 4 + int(fields["Content-Length"])
        assert data[to : to + 4] == b"\r\n\r\n"
        out.append((fields, data[end + 4 : to]))
        at = to + 4
    return out


def test_archives_are_what_a_plain_reader_expects(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest int")
    warc.write(warc.captures(df), str(tmp_path / "a"), compression=None)
    records = [r for f in (tmp_path / "a").glob("part-*") for r in plain_warc(f.read_bytes())]
    assert len(records) == len(PAGES) and len({f["WARC-Record-ID"] for f, _ in records}) == len(PAGES)
    by_id = {f["WARC-Record-ID"]: f for f, _ in records}
    want = {(html or "").encode() for _, _, html, _ in PAGES}
    responses = [(f, b.split(b"\r\n\r\n", 1)[1]) for f, b in records if f["WARC-Type"] == "response"]
    assert sorted(b for _, b in responses) == sorted(want)
    for f, body in responses:
        import base64

        assert f["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    for f, _ in records:
        if f["WARC-Type"] == "revisit":
            assert by_id[f["WARC-Refers-To"]]["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_archives_come_back(spark, tmp_path, compression):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string, digest int").repartition(3)
    warc.write(warc.captures(df), str(tmp_path / "a"), compression)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)  # records across many splits
    try:
        once = warc.resolve(warc.read(spark, str(tmp_path / "a"))).collect()
        warc.deduplicate(spark, str(tmp_path / "a"), str(tmp_path / "b"), compression)
        twice = warc.resolve(warc.read(spark, str(tmp_path / "b"))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    key = lambda rs: sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in rs), key=repr)
    assert key(once) == key(twice) and len(once) == len(PAGES)
    rows = {(r["page_id"], r["url"], r["record_type"]): r for r in once}
    assert rows[(2, "va", "response")]["payload_bytes"] == 1 and rows[(1, "http://a/WARC/1.1", "revisit")]["refers_to"] == 2
    assert rows[(3, None, "revisit")]["refers_to"] == 4 and rows[(None, "n", "response")]["refers_to"] is None
    assert sum(r["record_type"] == "revisit" and r["page_id"] == 2 for r in once) == 2


def test_many_copies_refer_to_the_last(spark, tmp_path):
    df = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.concat(F.lit("p"), F.col("id"))).alias("html"))
    warc.write(warc.captures(df), str(tmp_path / "a"))
    found = warc.resolve(warc.read(spark, str(tmp_path / "a")))
    assert found.count() == 4000 and {r[0] for r in found.where("record_type = 'revisit'").select("refers_to").distinct().collect()} == {3999}


def test_foreign_archives(spark, tmp_path):
    body = b"HTTP/1.0 200 OK\r\n\r\nhello"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    record = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:x>\r\ncontent-length: %d\r\nContent-Type: application/http;msgtype=response\r\n\r\n%s\r\n\r\n" % (len(body), body)
    lost = b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:y>\r\nWARC-Refers-To: <urn:none>\r\nWARC-Payload-Digest: sha1:ABC\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "x.warc").write_bytes(info + record + lost)
    found = {r["record_id"]: r for r in warc.read_captures(warc.read(spark, str(tmp_path / "x.warc"))).collect()}
    assert bytes(found["<urn:x>"]["payload"]) == b"hello" and found["<urn:x>"]["bytes"] == 5 and found["<urn:y>"]["digest"] == "ABC"
    told = {r["record_id"]: tuple(r)[1:5] for r in warc.resolve(warc.read(spark, str(tmp_path / "x.warc"))).collect()}
    assert told["<urn:y>"] == (None, "ABC", "revisit", None) and told["<urn:x>"][0] == 5


def test_no_pages(spark, tmp_path):
    warc.write(warc.captures(spark.createDataFrame([], "page_id long, url string, html string")), str(tmp_path / "a"))
    assert warc.resolve(warc.read(spark, str(tmp_path / "a"))).count() == 0


def _hash(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def brute_manifest(rows):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: _hash("".join(map(told, r)))
    lower = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([_hash("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        for x in levels[:-1]:
            yield "".join(x[i // 8 * 8 : i]), "".join(x[i + 1 : i // 8 * 8 + 8])
            i //= 8

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    placed = {g: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g, rs in groups.items()}
    trees = {g: climb([leaf(r) for r in rs]) for g, rs in placed.items()}
    top = climb([trees[g][-1][0] for g in order])
    for j, g in enumerate(order):
        for i, r in enumerate(placed[g]):
            proof = [*path(trees[g], i), *path(top, j)]
            node = leaf((*r[:4], lower(r[4]))) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else leaf(r)
            for b, a in proof:
                node = _hash(b + node + a)
            yield r[0], leaf(r), trees[g][-1][0], top[-1][0], _hash("".join(b + a for b, a in proof)), node, node == top[-1][0]


def _lowered():
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", queries._UPPER, queries._LOWER))


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("n", [1, 8, 9, 600, 5000])
def test_manifest_equals_brute_force(spark, n):
    rng = random.Random(n)
    langs = ["en"] * 9 + ["de", None, "", "é", "z", *(f"l{i}" for i in range(9))]
    rows = [(i if rng.random() > 0.01 else None, rng.choice(["s", None]), rng.choice(langs), rng.choice([None, 3]), rng.choice([None, "", "Ab", "ab", "ÄB x:1"])) for i in range(n)]
    rows += [rows[0]] * 3
    found = merkle_manifest.manifest(spark.createDataFrame(rows, DOCS).withColumn("node", F.lit(1)), tampered={"text": _lowered()}).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute_manifest(rows), key=repr)


def test_manifest_of_nothing(spark):
    assert merkle_manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_more_groups_than_a_bucket_holds(spark):
    rows = [(i, "s", f"g{i % 700}", i, "T") for i in range(1500)]
    found = merkle_manifest.manifest(spark.createDataFrame(rows, DOCS), tampered={"text": _lowered()}).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute_manifest(rows), key=repr)


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(kept, key=lambda r: (_hash(f"1:{r[0]}"), r[1]))[:k]]

    def assigned():
        for i, v in kept:
            far = [sum((a - b) ** 2 for a, b in zip(v, x, strict=True)) for x in c]
            yield i, v, far.index(min(far)), min(far)

    for _ in range(rounds):
        now = list(assigned())
        for j in range(len(c)):
            if own := [v for _, v, a, _ in now if a == j]:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    now = list(assigned())
    for i, _, a, d in now:
        yield i, a, d, sum(y for *_, b, y in now if b == a), sum(y for *_, y in now), _hash(",".join(map(str, c[a])))


def vector_sets():
    rng = np.random.default_rng(1)
    odd = [(7, None), (8, [1.0] * 3), (9, [math.nan] + [0.0] * 63), (10, [None] + [0.0] * 63), (11, [math.inf] + [0.0] * 63)]
    yield "random", [(i, rng.normal(size=64).tolist()) for i in range(300)]
    yield "ties", [(i, rng.integers(0, 2, size=64).astype(float).tolist()) for i in range(300)] + odd
    yield "lattice", [(i, [i % 5 / 64, i // 5 % 5 / 64] + [0.0] * 62) for i in range(300)]
    yield "few", [(i, [float(i)] * 64) for i in range(5)] + [(1, [1.0] * 64)]
    yield "large", [(i, (rng.normal(size=64) * 3e5).tolist()) for i in range(100)]
    yield "one place", [(i, [0.5] * 64) for i in range(50)]


@pytest.mark.parametrize("rows", [pytest.param(rows, id=name) for name, rows in vector_sets()])
def test_clusters_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    assert sorted(map(tuple, exponion_clusters.cluster(df).collect())) == sorted(brute_clusters(rows))


def test_clusters_of_nothing_and_beyond_bounds(spark):
    df = spark.createDataFrame([(1, [1e30] * 64), (None, [0.0] * 64), (2, [1.0] * 64)], "vec_id long, embedding array<double>")
    assert exponion_clusters.cluster(df.limit(0)).count() == 0
    assert {r["vec_id"] for r in exponion_clusters.cluster(df).collect()} == {None, 2}


def test_search_skips_far_centroids():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, size=(50, 8))
    v = (centres[rng.integers(0, 50, size=5000)] + rng.integers(-50, 50, size=(5000, 8))).astype(np.int64)
    first = exponion_clusters.Search(centres)
    state = first.start(v)
    moved = exponion_clusters.Search(centres + 1, centres)
    a, _, _ = moved.move(v, *state)
    assert (a == exponion_clusters.squared(v, centres + 1).argmin(1)).all() and moved.looks < 0.05 * first.looks
