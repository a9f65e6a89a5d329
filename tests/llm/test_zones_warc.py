from __future__ import annotations

import hashlib
from base64 import b32encode
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard
from compare import differences
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyguard.llm import warc, zone_maps

# Clustering


def plain_clusters(rows, k, rounds, scale, components, seed=2):
    """Every vector against every centroid, in Python's whole numbers."""
    kept = []
    for name, vector in rows:
        if vector is None or len(vector) != components or any(x is None for x in vector):
            continue
        if all(np.isfinite(vector)):
            kept.append((name, [int(np.floor(x * scale)) for x in vector]))
    if not kept:
        return []

    def key(row):
        name, vector = row
        return (1, "", vector) if name is None else (0, hashlib.sha256(f"{seed}:{name}".encode()).hexdigest(), vector)

    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(vector):
        return min((sum((a - b) ** 2 for a, b in zip(vector, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, vector in kept:
            groups[nearest(vector)[1]].append(vector)
        for j, members in groups.items():
            centroids[j] = [sum(column) // len(members) for column in zip(*members)]
    found = [(name, nearest(vector)) for name, vector in kept]
    total = sum(d for _, (d, _) in found)
    by_cluster = Counter()
    for _, (d, j) in found:
        by_cluster[j] += d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(name, j, d, by_cluster[j], total, digests[j]) for name, (d, j) in found]


def test_hilbert_positions_are_a_walk_through_all_cells():
    for dimensions, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions), -1).reshape(-1, dimensions)
        position = zone_maps.hilbert_index(grid, bits)
        assert sorted(position.tolist()) == list(range(len(grid)))
        walk = grid[np.argsort(position)].astype(int)
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 12), st.sampled_from([3, 1 << 10, 1 << 26]))
def test_candidates_hold_every_nearest_centroid(seed, k, span):
    rng = np.random.default_rng(seed)
    vectors = rng.integers(-span, span + 1, (40, 5)).astype(np.int32)
    centroids = rng.integers(-span, span + 1, (k, 5)).astype(np.int64)
    centroids[-1] = centroids[0]
    left = zone_maps.box_candidates(vectors.min(axis=0), vectors.max(axis=0), centroids)
    place, distance = zone_maps.nearest_centroids(vectors, centroids[left])
    for vector, j, d in zip(vectors.tolist(), left[place].tolist(), distance.tolist()):
        away = [sum((a - b) ** 2 for a, b in zip(vector, c)) for c in centroids.tolist()]
        assert (d, j) == (min(away), away.index(min(away)))


def clusters(spark, rows, schema="vec_id long, embedding array<double>", **options):
    df = spark.createDataFrame(rows, schema)
    found = zone_maps.cluster_vectors(df, **options)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return Counter(tuple(r) for r in found.collect())


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(6, 8))
    rows = [(i, (middles[i % 6] + 0.2 * rng.normal(size=8)).tolist()) for i in range(400)]
    # A third of all rows is one vector, some of them one row; ids repeat or are missing.
    rows += [(1000 + i, rows[0][1]) for i in range(150)] + [(2000, rows[0][1])] * 60
    rows += [(None, rows[3][1]), (None, rows[4][1]), (7, rows[5][1])]
    rows += [(3000, None), (3001, []), (3002, [1.0] * 7), (3003, [None] + [1.0] * 7)]
    rows += [(3004, [float("nan")] * 8), (3005, [float("inf")] * 8), (3006, [-0.001] * 8)]
    options = dict(k=10, rounds=4, scale=64, components=8)
    assert clusters(spark, rows, block_rows=16, **options) == Counter(plain_clusters(rows, **options))


def test_few_vectors_wide_values_and_none(spark):
    rows = [(i, [x, -x, 5.0]) for i, x in enumerate([0.0, 1e5, -3e5, 1e5])]
    options = dict(k=40, rounds=3, scale=256, components=3)
    assert clusters(spark, rows, **options) == Counter(plain_clusters(rows, **options))
    assert clusters(spark, [], **options) == Counter()
    assert clusters(spark, [(1, None)], **options) == Counter()


def test_other_columns_may_clash(spark):
    rows = [(i, [float(i % 3), 1.0], i, "x", 2.0) for i in range(9)]
    options = dict(k=3, rounds=2, scale=4, components=2)
    schema = "vec_id long, embedding array<double>, cluster int, distance string, position double"
    assert clusters(spark, rows, schema, **options) == Counter(plain_clusters([r[:2] for r in rows], **options))


def test_values_beyond_exact_distances_are_refused(spark):
    with pytest.raises(Exception, match="pass 64 bits"):
        clusters(spark, [(1, [1e9, 0.0]), (2, [0.0, 0.0])], k=1, rounds=1, scale=256, components=2)


# Archives


LONG = "<p>" + "words and ümlauts " * 200_000 + "</p>"
PAGES = [
    (5, "http://a/", "<p>one</p>"),
    (3, "http://b/", "<p>one</p>"),
    (9, None, "<p>one</p>"),
    (4, "http://c/\r\nX-Page-Id: 1", "two\r\n\r\nWARC/1.1\r\n"),
    (6, "http://d/é?q=%20", ""),
    (7, "http://e/", None),
    (8, "", LONG),
    (10, "http://f/", LONG),
    (None, "http://g/", LONG),
    (None, "http://h/", "alone"),
    (11, "http://i/", "repeated"),
    (11, "http://i/", "repeated"),
    (12, "http://i/", "repeated"),
]


def plain_records(pages, least=0):
    out = []
    for name, _, html in pages:
        payload = (html or "").encode()
        same = [n for n, _, h in pages if (h or "").encode() == payload and n is not None]
        first = min(same, default=None)
        revisit = len(payload) >= least and name != first
        digest = b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((name, len(payload), digest, "revisit" if revisit else "response", first if revisit else None))
    return Counter(out)


def archives(spark, rows, schema="page_id long, url string, html string", **options):
    df = spark.createDataFrame(rows, schema).repartition(3)
    folder, index = warc.write_archives(df, **options)
    return folder, index, warc.read_archives(folder, index)


@pytest.mark.parametrize("least", [0, 9])
def test_records_read_back(spark, least):
    _, index, found = archives(spark, PAGES, least_bytes=least, frame_bytes=200, bundle_bytes=400)
    assert Counter(tuple(r) for r in found.drop("url").collect()) == plain_records(PAGES, least)
    assert index.select("bundle").distinct().count() > 3
    urls = {r.page_id: r.url for r in found.collect() if r.page_id is not None}
    assert urls[9] is None and urls[6] == "http://d/é?q=%20" and urls[4] == "http://c/%0D%0AX-Page-Id: 1"


def test_one_payload_of_most_pages(spark):
    rows = [(i, f"u{i}", "same") for i in range(3000)] + [(5000 + i, "u", f"own {i}") for i in range(1500)]
    _, _, found = archives(spark, rows)
    assert Counter(tuple(r) for r in found.drop("url").collect()) == plain_records(rows)


def test_records_are_found_by_seeking(spark):
    rows = [(i, f"http://x/{i}", f"page {i} " * 50) for i in range(300)] + [(900, "u", "page 7 " * 50)]
    folder, index, _ = archives(spark, rows, frame_bytes=2000, bundle_bytes=10_000)
    wanted = spark.createDataFrame([(7,), (8,), (900,), (12345,), (8,), (None,)], "page_id long")
    found = {r.page_id: r for r in warc.find_records(folder, index, wanted).collect()}
    assert set(found) == {7, 8, 900}
    assert bytes(found[7].payload).decode() == "page 7 " * 50 and found[7].url == "http://x/7"
    assert found[900].record_type == "revisit" and found[900].refers_to == 7 and found[900].payload is None
    places = index.collect()
    assert len({(r.bundle, r.frame) for r in places}) > 20
    assert len({r.record_id for r in places}) == len(rows)


def test_a_bundle_is_plain_zstandard_with_a_seek_table(spark, tmp_path):
    _, index, _ = archives(spark, PAGES[:4], folder=str(tmp_path / "w"), frame_bytes=1)
    for name in {r.bundle for r in index.collect()}:
        data = (tmp_path / "w" / name).read_bytes()
        reader = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True)
        text = reader.read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        assert data[-4:] == (0x8F92EAB1).to_bytes(4, "little")
        records = [fields for _, fields, _ in warc.parse_records(text)]
        assert int.from_bytes(data[-9:-5], "little") == len(records)


def test_damage_is_noticed(spark, tmp_path):
    folder, index, found = archives(spark, PAGES[:1], folder=str(tmp_path / "w"))
    (name,) = (r.bundle for r in index.collect())
    path = tmp_path / "w" / name
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 0xFF
    path.write_bytes(data)
    with pytest.raises(Exception):
        found.collect()


def test_no_pages_and_clashing_columns(spark):
    assert archives(spark, [])[2].count() == 0
    rows = [(*p, "x", 1) for p in PAGES]
    _, _, found = archives(spark, rows, "page_id long, url string, html string, payload string, first int")
    assert Counter(tuple(r) for r in found.drop("url").collect()) == plain_records(PAGES)


def test_sql_says_the_same_of_copies(spark):
    rows = [p for p in PAGES if p[0] is not None and p[0] != 11]
    _, _, found = archives(spark, rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert differences(found.drop("url"), con, warc.oracle()) == []
