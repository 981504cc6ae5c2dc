import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import images, labels, learning, segments
from tessera.plans import catalog
from tessera.sources import tables as io
from tessera.streaming.segments import stream_features

FOLDER = "/root/testdata/sf0.001"


def test_results_are_cut_to_the_shortest(spark):
    docs = spark.createDataFrame([("a", ["x", "y", "z"], [0.1, 0.2], [[1.0], [2.0], [3.0]])], "filename string, texts array<string>, scores array<double>, boxes array<array<double>>")
    assert [(r.seg_idx, r.text) for r in segments.explode_results(docs).orderBy("seg_idx").collect()] == [(0, "x"), (1, "y")]


def test_feature_rows_without_box(spark):
    segs = spark.createDataFrame([("d", 0, "A", None), ("d", 1, "B", [(0.0, 5.0), (10.0, 5.0)])], "filename string, seg_idx int, text string, box array<struct<x:double,y:double>>")
    size = spark.createDataFrame([("d", 100, 50)], "filename string, width int, height int")
    got = {r.seg_idx: r for r in segments.feature_rows(segs, size).collect()}
    assert got[0].is_spatial_dummy == 1 and got[0].y_rel == 0.0 and got[0].line_rank == 0
    assert got[1].is_spatial_dummy == 0 and got[1].y_rel == pytest.approx(0.1) and got[1].width_rel == pytest.approx(0.1)


def test_minmax_of_constant_is_zero(spark):
    frame = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    assert {r.y for r in learning.minmax_scaled(frame, {"x": "y"}).collect()} == {0.0}


def test_standardized(spark):
    got = [r.z for r in learning.standardized(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,)], "x double"), {"x": "z"}).collect()]
    assert sum(got) == pytest.approx(0) and np.std(got) == pytest.approx(1)


def test_principal_components(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(200, 1))
    rows = np.hstack([base, base * 2 + rng.normal(size=(200, 1)) * 0.1, rng.normal(size=(200, 1))])
    got = learning.principal(spark.createDataFrame([tuple(map(float, r)) for r in rows], "a double, b double, c double"), ["a", "b", "c"]).toPandas()
    z = (rows - rows.mean(0)) / rows.std(0)
    _, _, v = np.linalg.svd(z, full_matrices=False)
    for i in range(2):
        w = v[i] * np.sign(v[i][np.abs(v[i]).argmax()])
        assert np.allclose(got[f"pc{i + 1}"], z @ w, atol=1e-6)


def test_group_folds(spark):
    rows = [(g, int(i % 3 == 0)) for g in range(60) for i in range(1 + g % 4)]
    frame = spark.createDataFrame(rows, "g int, y int")
    folds = learning.group_folds(frame, "g", "y")
    assert folds.count() == 60 and folds.select("g").distinct().count() == 60
    per = frame.join(folds, "g").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).toPandas()
    assert set(per.fold) == {1, 2, 3, 4, 5} and per.n.max() - per.n.min() <= 8 and per.p.max() - per.p.min() <= 8


def test_tfidf_rows_have_length_one(spark):
    frame = learning.word_tokens(spark.createDataFrame([("aa bb aa",), ("bb cc",)], "t string"), "t")
    rows = [r.features.toArray() for r in learning.tfidf(frame, "tokens", 10).collect()]
    assert all(np.linalg.norm(r) == pytest.approx(1) for r in rows)
    rare, common = np.log(3 / 2) + 1, np.log(3 / 3) + 1
    assert sorted(rows[0][rows[0] > 0]) == pytest.approx(sorted(np.array([2 * rare, common]) / np.hypot(2 * rare, common)))


def test_out_of_fold_scores(spark):
    rows = [(float(i % 2), float(i % 2) * 2 + (i % 5) * 0.01, i % 3) for i in range(90)]
    held = learning.assembled(spark.createDataFrame(rows, "label double, x double, fold int"), ["x"])
    got = learning.out_of_fold(held, "label", {"logistic": learning.logistic}, [0, 1, 2]).collect()
    assert len(got) == 3 and all(r.macro_f1 > 0.99 for r in got)


def test_threshold_default(spark):
    frame = spark.createDataFrame([(0.15, 1.0), (0.25, 0.05), (0.35, 0.0)], "conf double, m double")
    assert labels.threshold(frame, "conf", "m", F.col("median") <= 0.1).first()[0] == 0.2
    assert labels.threshold(frame, "conf", "m", F.col("median") < -1).first()[0] == 0.85


def test_csv_repair(spark):
    lines = spark.createDataFrame([('"1,""Ann, B"",x"',), ("",), ("2,plain,y,z,extra",), ("3,short",)], "value string")
    got = [tuple(r) for r in io.repaired(lines, "a string, b string, c string, d string").collect()]
    assert got == [("1", "Ann, B", "x", None), ("2", "plain", "y", "z"), ("3", "short", None, None)]


def test_caches(spark):
    files = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "k string, changed int")
    cache = spark.createDataFrame([("a", 9), ("b", 1)], "k string, cached int")
    assert {r.k for r in io.stale(files, cache, "k", "changed", "cached").collect()} == {"b", "c"}
    assert {r.k for r in io.missing_keys(files, cache, ["k"]).collect()} == {"c"}


def png(image: np.ndarray) -> bytes:
    h, w = image.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in image)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    picture = np.full((40, 60), 250, np.uint8)
    picture[10:30, 15:45] = 10
    (tmp_path / "a.png").write_bytes(png(picture))
    (tmp_path / "broken.png").write_bytes(b"no image")
    frame = io.read_images(spark, str(tmp_path))
    got = frame.select("filename", images.image_stats(F.col("image")).alias("s")).collect()
    assert [r.filename for r in got] == ["a.png"]
    s = got[0].s
    assert s.brightness == pytest.approx(picture.mean()) and s.contrast == pytest.approx(picture.std())
    assert s.dark_pixel_ratio == pytest.approx((picture < 50).mean()) and s.blur_score > 0 and s.edge_density > 0 and abs(s.skew_angle) < 1e-6
    assert {r.filename for r in io.probe_files(spark, str(tmp_path)).collect()} == {"a.png", "broken.png"}


def test_pixels():
    flat = np.full((20, 20), 7, np.uint8)
    assert images.sharpness(flat) == 0 and images.edges(flat).sum() == 0
    assert images.prepared(np.zeros((5, 50, 3), np.uint8)) is None and images.prepared(np.zeros((20, 50, 2), np.uint8)) is None
    assert images.prepared(np.zeros((20, 50, 1), np.uint8)).shape == (20, 50, 3)
    small = images.shrunk(np.arange(64, dtype=np.uint8).reshape(8, 8, 1), 4)
    assert small.shape == (4, 4, 1) and small[0, 0, 0] == round((0 + 1 + 8 + 9) / 4)
    ramp = np.repeat(np.arange(30, dtype=np.uint8)[None, :, None] * 8, 20, axis=0)
    out = images.straightened(ramp, np.array([[5, 2], [24, 2], [24, 11], [5, 11]]), 20, 10)
    assert out.shape == (10, 20, 1) and np.allclose(out[3, :, 0], np.arange(5, 25) * 8, atol=1)
    turned = images.straightened(ramp, np.array([[5, 2], [9, 2], [9, 18], [5, 18]]), 5, 17)
    assert turned.shape == (5, 17, 1)
    assert images.dilate(np.eye(5, dtype=np.uint8), 3).sum() > 5 and images.smooth(flat).std() == pytest.approx(0)


def test_prepared_images_pass_the_guards(spark):
    got = catalog.queries()["s4_image_prep"](spark, FOLDER).collect()
    want = [(12, 64), (12, 16), (16, 16), (None, None), (None, None), (11, 1600)]
    assert {r.vec_id % 6 for r in got} == set(range(6)) and all((r.height, r.width) == want[r.vec_id % 6] for r in got)


def test_image_stats_have_sizes(spark):
    got = catalog.queries()["i12_image_stats"](spark, FOLDER).select("width", "height", "aspect_ratio", "is_portrait").distinct().collect()
    assert [tuple(r) for r in got] == [(8, 8, 1.0, False)]


def test_skew_of_turned_bar():
    yy, xx = np.mgrid[0:80, 0:80] - 40
    a = np.radians(20)
    bar = (np.abs(xx * np.cos(a) + yy * np.sin(a)) < 30) & (np.abs(-xx * np.sin(a) + yy * np.cos(a)) < 6)
    assert abs(abs(images.skew(np.where(bar, 0, 255).astype(np.uint8))) - 20) < 3


def test_streamed_features(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("d1", 0, "JALAN 1"), ("d2", 0, "x")], "filename string, seg_idx int, text string").write.parquet(source)
    stream_features(spark, source, sink, str(tmp_path / "state"))
    spark.createDataFrame([("d3", 0, "BIN ")], "filename string, seg_idx int, text string").write.mode("append").parquet(source)
    stream_features(spark, source, sink, str(tmp_path / "state"))
    got = {r.filename: r for r in spark.read.parquet(sink).collect()}
    assert set(got) == {"d1", "d2", "d3"} and got["d1"].has_address_kw == 1 and got["d3"].has_bin_binti == 1


def plain_edges(v):
    """Share of edge pixels of a square picture, pixel by pixel."""
    n = len(v)
    at = lambda i: -i if i < 0 else 2 * n - 2 - i if i >= n else i
    g = {}
    for i in range(n):
        for j in range(n):
            w = lambda di, dj, i=i, j=j: float(v[at(i + di)][at(j + dj)])
            gx = w(-1, 1) + 2 * w(0, 1) + w(1, 1) - w(-1, -1) - 2 * w(0, -1) - w(1, -1)
            gy = w(1, -1) + 2 * w(1, 0) + w(1, 1) - w(-1, -1) - 2 * w(-1, 0) - w(-1, 1)
            g[i, j] = (abs(gx) + abs(gy), round(math.atan2(gy, gx) / (math.pi / 4)) % 4)
    steps = [(0, 1), (1, 1), (1, 0), (1, -1)]
    size = lambda i, j: g[i, j][0] if (i, j) in g else 0.0
    peak = {p for p, (s, k) in g.items() if s > size(p[0] - steps[k][0], p[1] - steps[k][1]) and s >= size(p[0] + steps[k][0], p[1] + steps[k][1])}
    found = todo = {p for p in peak if g[p][0] > 150}
    while todo:
        todo = {q for i, j in todo for di in (-1, 0, 1) for dj in (-1, 0, 1) for q in [(i + di, j + dj)] if q in peak and g[q][0] > 50} - found
        found = found | todo
    return len(found) / n / n


def test_edges_and_stats_of_every_picture(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    grays = {r.vec_id: np.array([min(255, max(0, int(math.floor((float(x) + 1) * 127 + 0.5)))) for x in r.embedding]).reshape(8, 8) for r in rows}
    got = {r.vec_id: r.edge_density for r in catalog.queries()["i4_edge_density"](spark, FOLDER).collect()}
    assert set(got) == set(grays) and all(got[d] == pytest.approx(255 * plain_edges(v.tolist()), abs=1e-5) for d, v in grays.items())
    stats = {r.vec_id: r for r in catalog.queries()["i12_image_stats"](spark, FOLDER).collect()}
    assert set(stats) == {d for d in grays if d % 7 and d % 11}
    for d, r in stats.items():
        v = grays[d].astype(float)
        padded = np.pad(v, 1, mode="reflect")
        blur = (padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * v).var()
        want = (blur, v.mean(), v.std(), got[d], (v <= 128).mean(), (54 + 3 * 64) / 1024)
        assert (r.blur_score, r.brightness, r.contrast, r.edge_density, r.dark_pixel_ratio, r.file_kb) == pytest.approx(want, abs=1e-5)
        assert r.quality_cat == ("Buram" if blur <= 50 else "Sedang" if blur <= 300 else "Tajam") and (r.width, r.height, r.is_portrait) == (8, 8, False)


def test_numbers_of_sorted_rows(spark):
    frame = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v int").repartition(5)
    got = io.numbered(frame, ["v"], "nth").collect()
    assert sorted((r.v, r.nth) for r in got) == [(i, i) for i in range(1000)]
