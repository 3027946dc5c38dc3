import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.operators import graph, segment
from voxloom.plans import pipelines
from voxloom.sources import acquisition, images, sinks
from voxloom.streaming import live


@pytest.fixture(scope="module")
def tiled(spark):
    """Balls in a volume cut into 2 x 3 overlapping tiles with known offsets."""
    rng = np.random.default_rng(11)
    nz, size, step = 8, 40, 30
    volume = rng.integers(90, 110, (nz, 80, 112))
    z, y, x = np.indices(volume.shape)
    for c in rng.random((60, 3)) * volume.shape:
        volume[(z - c[0]) ** 2 + (y - c[1]) ** 2 + (x - c[2]) ** 2 <= 5] += 500
    jitter, rows, at = rng.integers(-1, 2, (2, 3, 2)), [], {}
    for r in range(2):
        for c in range(3):
            y0, x0 = r * step + jitter[r, c, 0] + 2, c * step + jitter[r, c, 1] + 2
            at[r, c] = (y0, x0)
            t = volume[:, y0 : y0 + size, x0 : x0 + size]
            zz, yy, xx = (g.ravel() for g in np.indices(t.shape))
            rows.append(pd.DataFrame({"row": r, "col": c, "z": zz, "y": yy, "x": xx, "v": t.ravel()}).astype("int32"))
    voxels = spark.createDataFrame(pd.concat(rows)).repartition(4).cache()
    tiles = spark.createDataFrame([(r, c, f"{r}_{c}.tif") for r, c in at], "row int, col int, path string")
    return voxels, tiles, at, size


def test_stitching_finds_the_offsets(tiled, spark, tmp_path):
    voxels, tiles, at, size = tiled
    o = pipelines.StitchOptions(size, 25, 25).with_margin(30)
    shown = pipelines.projections(voxels, tiles, o)
    sinks.write_projections(shown, str(tmp_path / "p"))
    s = pipelines.stitch(spark.read.parquet(str(tmp_path / "p")), tiles, o)
    got = {(r.row, r.col): r for r in s.registration.collect()}
    y0, x0 = min(y for y, _ in at.values()), min(x for _, x in at.values())
    off = [max(abs(got[k].ABS_V - (y - y0)), abs(got[k].ABS_H - (x - x0)), abs(got[k].ABS_D)) for k, (y, x) in at.items()]
    assert max(off) <= 1, off
    sinks.write_csv(s.registration, str(tmp_path / "csv"))
    back = sinks.read_registration(spark, str(tmp_path / "csv"))
    assert back.count() == 6 and back.columns == s.registration.columns
    assert pipelines.stitching_info(s.tree, s.registration, size, 3).count() == 6
    with pytest.raises(ValueError):
        o.with_margin(50)


def test_live_stitching_ends_where_the_batch_does(tiled, spark, tmp_path):
    """Tiles that complete in three batches, one of them run twice, against the batch pipeline over all tiles."""
    voxels, tiles, _, size = tiled
    o = pipelines.StitchOptions(size, 25, 25).with_margin(30)
    whole = pipelines.stitch(pipelines.projections(voxels, tiles, o), tiles, o)
    load = lambda some: voxels.join(some.select("channel", "row", "col"), ["row", "col"])
    source, checkpoint = tmp_path / "frames", str(tmp_path / "checkpoint")
    for numbers in ([1, 2], [3, 4, 5], [6]):
        spark.createDataFrame([(t, 0, n) for t in numbers for n in range(3)], "tile long, channel int, n int").coalesce(1).write.mode("append").parquet(str(source))
        again = pipelines.LiveStitch(str(tmp_path / "live"), o, 3, 3, 6, load)  # as after a restart
        again.start(live.frame_stream(spark, str(source), "tile long, channel int, n int"), checkpoint)
    key = lambda df: sorted(tuple(r) for r in df.select("row", "col", "ABS_H", "ABS_V", "ABS_D").collect())
    assert key(again.stitched(spark).registration) == key(whole.registration)
    assert again.particles(spark).select("row", "col").distinct().count() == 6
    assert again.particles(spark).agg(F.sum(F.pow(F.lit(8.0), 6 - F.col("level")))).first()[0] == voxels.count()


def test_live_stitching_decodes_files(tiled, spark, tmp_path):
    voxels, tiles, _, size = tiled
    for t in (1, 2):
        volume = np.zeros((8, size, size), np.uint16)
        for r in voxels.where(f"row = 0 and col = {t - 1}").collect():
            volume[r.z, r.y, r.x] = r.v
        (tmp_path / f"t{t}_c0.tif").write_bytes(images.encode_tiff(volume))
    spark.createDataFrame([(t, 0, n) for t in (1, 2) for n in range(3)], "tile long, channel int, n int").write.parquet(str(tmp_path / "frames"))
    o = pipelines.StitchOptions(size, 25, 25).with_margin(30)
    it = pipelines.LiveStitch(str(tmp_path / "live"), o, 3, 3, 6, pattern=f"file:{tmp_path}/t{{tile}}_c{{channel}}.tif")
    it.start(live.frame_stream(spark, str(tmp_path / "frames"), "tile long, channel int, n int"), str(tmp_path / "checkpoint"))
    assert it.stitched(spark).registration.count() == 2


def test_channels(tiled, spark, tmp_path):
    voxels, tiles, _, size = tiled
    two = lambda df: df.withColumn("channel", F.lit(0)).unionByName(df.withColumn("channel", F.lit(1)))
    acq = pipelines.MultiChannel(two(tiles), two(voxels), pipelines.StitchOptions(size, 25, 25).with_margin(30))
    assert acq.stitch(0, middle=4).count() == 6
    acq.registrations[0] = graph.expected_registration(tiles, 30, 30)
    assert acq.align(0, 1).exceptAll(acq.registrations[0]).isEmpty()
    assert acq.align(0, 1, {"z": (2, 6), "x": (5, None)}).exceptAll(acq.registrations[0]).isEmpty()
    assert acq.reconstruct(4).select("channel").distinct().count() == 2
    todo = acq.convert(str(tmp_path / "parts"), 6, existing=two(tiles).where("channel = 0"))
    assert todo.count() == 6
    got = sinks.read_particles(spark, str(tmp_path / "parts"), level=4)
    assert sinks.has_tree(spark, str(tmp_path / "parts")) and not sinks.has_tree(spark, str(tmp_path / "parts"), "labels")
    assert got.select("channel").distinct().count() == 1 and got.agg(F.max("level")).first()[0] <= 4


def test_segmenting_tiles(tiled, spark):
    voxels, tiles, _, size = tiled
    rows = voxels.withColumns({"f0": F.col("v").cast("double"), "label": (F.col("v") > 300).cast("int")})
    model = segment.train(rows.where("row = 0 and col = 0"), ["f0"])
    reg = graph.expected_registration(tiles, 30, 30)
    found = pipelines.segment_tiles(voxels, reg, model, lambda v: v.withColumn("f0", F.col("v").cast("double")), (8, size, size), least=4)
    assert 10 < found.count() < 120
    atlas_ = spark.range(2000).select((F.col("id") % 2).cast("int").alias("z"), (F.col("id") / 2 % 20).cast("int").alias("y"), (F.col("id") / 40).cast("int").alias("x"), F.lit(5).cast("long").alias("id"))
    tree = spark.createDataFrame([(5, [5], "all", "all")], "id long, path array<long>, acronym string, name string")
    report = pipelines.atlas_report(found.select("cell_id", "z", "y", "x"), atlas_, tree, (5.0, 5.0, 5.0))
    assert report["areas"].agg(F.sum("n")).first()[0] == found.count()


def test_tiff_round_trip():
    v = np.random.default_rng(0).integers(0, 65535, (3, 5, 7)).astype("uint16")
    assert (images.decode_tiff(images.encode_tiff(v)) == v).all()
    assert (images.decode_tiff(images.encode_tiff(v.astype("float32"))) == v).all()
    assert (images.decode_raw(v[:, :, :5].tobytes(), 5) == v[:, :, :5]).all()
    assert (images.decode_npy(images.encode_npy(v)) == v).all()
    with pytest.raises(ValueError):
        images.decode_tiff(b"no image")


def test_folder_of_tiles(spark, tmp_path):
    v = np.arange(2 * 4 * 4, dtype="uint16").reshape(2, 4, 4)
    for r, c in ((2, 3), (2, 4), (3, 3)):
        (tmp_path / f"{r}_{c}.tif").write_bytes(images.encode_tiff(v + r))
    (tmp_path / "notes.txt").write_text("x")
    files = acquisition.listing(spark, str(tmp_path))
    assert acquisition.file_type(files, str(tmp_path)) == "tiff3D" and acquisition.detect(files).name == "tiles"
    tiles = acquisition.catalog(files, "tiff3D", 4)
    assert sorted((r.row, r.col) for r in tiles.collect()) == [(0, 0), (0, 1), (1, 0)]
    got = acquisition.scan_voxels(tiles, "tiff3D", 4)
    assert got.count() == 96 and got.where("row = 1").agg(F.min("v")).first()[0] == 3
    (tmp_path / "9_9.tif").write_bytes(b"broken")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(str(tmp_path))
    assert [r.ok for r in acquisition.check_integrity(content, "tiff3D", 4).collect()].count(False) == 1
    with pytest.raises(FileNotFoundError):
        acquisition.catalog(files.where("false"), "tiff3D")
    planes = sinks.write_planes(got.where("row = 0 and col = 0").drop("row", "col"), f"file://{tmp_path}/out")
    assert planes.count() == 2
    assert (images.decode_tiff((tmp_path / "out" / "000001.tif").read_bytes())[0] == v[1] + 2).all()


def test_colm_and_clearscope(spark, tmp_path):
    colm = tmp_path / "colm"
    for n in range(4):
        (colm / "VW0" / f"LOC{n:03d}").mkdir(parents=True)
        (colm / "VW0" / f"LOC{n:03d}" / "PL0_CHN00_0.tif").write_bytes(b"x")
        (colm / "VW0" / f"LOC{n:03d}" / "PL0_CHN01_0.tif").write_bytes(b"x")
    (colm / "Experiment.ini").write_text('Vertical = "20"\nHorizontal = "15"\nOn = "TRUE"\nName = "x y"\n')
    (colm / "Scanned Cells.txt").write_text("1,1\n1,1\n")
    files = acquisition.listing(spark, str(colm))
    kind = acquisition.detect(files)
    assert kind.name == "colm" and acquisition.n_channels(files) == 2
    nrow, ncol = kind.shape(spark, str(colm))
    assert sorted((r.row, r.col) for r in kind.tiles(files, ncol, 1).collect()) == [(r, c) for r in range(nrow) for c in range(2)]
    assert kind.overlap(acquisition.settings(spark.read.text(str(colm / "Experiment.ini")))) == (20.0, 15.0)
    scope = tmp_path / "scope" / "0001"
    for n in range(1, 5):
        d = scope / f"000000_{n:06d}___0c"
        d.mkdir(parents=True)
        for k in (0, 1, 3):
            (d / f"000000_{n:06d}___{k:06d}_0c.tif").write_bytes(b"x")
    (tmp_path / "scope" / "settings.txt").write_text("ScanGridX = 2\nScanGridY = 2\nStackDepths = 4\n")
    files = acquisition.listing(spark, str(scope))
    kind = acquisition.detect(files)
    assert kind.name == "clearscope" and kind.n_channels(files) == 1
    assert kind.shape(acquisition.settings(spark.read.text(str(tmp_path / "scope" / "settings.txt")))) == (2, 2, 4)
    f = kind.frames(files, 2)
    assert f.count() == 12 and {(r.row, r.col) for r in f.where("tile = 3").collect()} == {(1, 1)}
    from voxloom.operators import grid

    assert grid.missing_frames(f, "tile", "n").count() == 4


def test_live_restart_gives_the_same(spark, tmp_path):
    source, done = tmp_path / "frames", str(tmp_path / "done")
    rows = lambda ts: spark.createDataFrame([(t, 0, n) for t in ts for n in range(3)], "tile long, channel int, n int").coalesce(1)
    seen = []
    pipe = live.LivePipeline(done, 2, 3, register=lambda e: seen.append(e.count()))
    for ts in ([1, 2], [3, 4], []):
        rows(ts).write.mode("append").parquet(str(source))
        stream = live.frame_stream(spark, str(source), "tile long, channel int, n int")
        pipe.start(stream, str(tmp_path / "checkpoint"))
    got = sorted((r.tile, r.row, r.col) for r in spark.read.parquet(done).collect())
    assert got == [(1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 1, 0)]
    assert sum(seen) >= 4
