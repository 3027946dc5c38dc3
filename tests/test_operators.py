import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxloom.operators import atlas, cells, features, graph, grid, merge, morphology, octree, project, register, segment


def voxels(spark, volume, background=None, **by):
    at = np.nonzero(volume > background) if background is not None else tuple(g.ravel() for g in np.indices(volume.shape))
    p = pd.DataFrame({**{k: v for k, v in by.items()}, "z": at[0].astype("int32"), "y": at[1].astype("int32"), "x": at[2].astype("int32"), "v": volume[at].astype("int32")})
    return spark.createDataFrame(p)


def image(df, shape, value="v"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[value]
    return out


# the grid: 13 tiles of a 4 x 4 grid, with (0, 0), (0, 1) and (2, 2) absent

ABSENT = {(0, 0), (0, 1), (2, 2)}


@pytest.fixture(scope="module")
def golden(spark):
    return spark.createDataFrame([(r, c, f"{r}_{c}") for r in range(4) for c in range(4) if (r, c) not in ABSENT], "row int, col int, path string")


def test_grid_counts(golden):
    r = grid.edge_counts(golden).first()
    assert (r.n_edges, r.n_edges_dense) == (16, 21)
    assert grid.shape(golden).first() == (4, 4)
    assert grid.pattern(golden).agg(F.sum("present")).first()[0] == 13


def test_grid_edge_list(golden):
    got = sorted((r.a, r.b) for r in grid.edges(golden).collect())
    first = [2, 2, 3, 4, 4, 5, 5, 6, 7, 8, 8, 9, 11, 12, 13, 14]
    second = [3, 6, 7, 5, 8, 6, 9, 7, 11, 9, 12, 13, 15, 13, 14, 15]
    assert got == sorted(zip(first, second, strict=True))


def test_neighbour_map(golden):
    got = {(r.row, r.col): [(n.row, n.col) for n in r.neighbours] for r in grid.neighbour_map(golden).collect()}
    assert len(got) == 16
    assert got[0, 0] == [(1, 0)]  # absent cells have a map too
    assert got[1, 1] == [(1, 2), (2, 1), (1, 0)]
    assert got[3, 3] == [(3, 2), (2, 3)]


def test_unique_and_offset(spark):
    t = spark.createDataFrame([(3, 5, "b"), (3, 5, "a"), (4, 6, "c")], "row int, col int, path string")
    got = sorted(tuple(r) for r in grid.normalise_offset(grid.unique_tiles(t)).select("row", "col", "path").collect())
    assert got == [(0, 0, "a"), (1, 1, "c")]


def test_snake(spark):
    got = grid.place_snake(spark.createDataFrame([(n,) for n in range(1, 9)], "n int"), "n", 4).orderBy("n").collect()
    assert [(r.row, r.col) for r in got] == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 3), (1, 2), (1, 1), (1, 0)]


def test_interpolation_weights(spark):
    f = spark.createDataFrame([(1, 0, 0), (1, 4, 100)], "tile int, n long, v int")
    assert [r.v for r in grid.interpolate_frames(f, "v").orderBy("n").collect()] == [25, 50, 75]
    assert [r.v for r in grid.interpolate_frames(f, "v", legacy_weights=True).orderBy("n").collect()] == [75, 50, 25]
    pixels = spark.createDataFrame([(1, 0, [0, 10]), (1, 2, [100, 20])], "tile int, n long, v array<int>")
    assert grid.interpolate_frames(pixels, "v").first().v == [50, 15]


# trees


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6))
def test_spanning_tree_weight(spark, seed):
    rng = np.random.default_rng(seed)
    pairs = [(a, b) for a in range(9) for b in range(a + 1, 9)]
    some = [pairs[i] for i in rng.choice(len(pairs), 20, replace=False)]
    w = rng.permutation(len(some)).astype(float)
    df = spark.createDataFrame([("h", a, b, float(x), 1.0) for (a, b), x in zip(some, w, strict=True)], "axis string, a int, b int, w double, d double")
    got = graph.spanning_tree(df, ["axis"]).collect()
    inside, weight, left = {some[0][0]}, 0.0, dict(zip(some, w, strict=True))  # Prim, on that component
    while True:
        out = [(x, e) for e, x in left.items() if (e[0] in inside) != (e[1] in inside)]
        if not out:
            break
        x, e = min(out)
        weight += x
        inside |= set(e)
    assert sum(r.w for r in got if r.a in inside) == weight


def test_positions_and_table(spark, golden):
    e = grid.edges(golden)
    d = e.select("a", "b", F.when(F.col("side") == "east", 90.0).otherwise(1.0).alias("d_h"), F.when(F.col("side") == "south", 80.0).otherwise(2.0).alias("d_v"), F.lit(0.0).alias("d_d"), *[F.lit(0.1).alias(f"r_{k}") for k in "hvd"])
    tree = graph.spanning_tree(graph.by_axis(d), ["axis"])
    table = graph.registration_table(golden, graph.tree_positions(tree, ["axis"]), 4)
    at = {(r.row, r.col): r for r in table.collect()}
    assert len(at) == 13 and min(r.ABS_H for r in at.values()) == 0
    o = graph.effective_overlap(table, 100).first()
    assert abs(o.overlap_h - 10) < 3 and abs(o.overlap_v - 20) < 3
    assert not graph.overlap_warnings(graph.effective_overlap(table, 100), 10, 20, 0.5).first().warn_h


# registration


@settings(max_examples=20, deadline=None)
@given(st.integers(-15, 15), st.integers(-15, 15), st.integers(0, 1000))
def test_roll_is_recovered(dy, dx, seed):
    a = np.random.default_rng(seed).random((40, 36))
    y, x, e = register.phase_correlation(np.roll(a, (dy, dx), (0, 1)), a)
    assert (y, x) == (dy, dx) and e < 1e-3
    assert abs(register.reliability(np.roll(a, (dy, dx), (0, 1)), a, (dy, dx)) - 1) < 1e-9
    assert register.nrmse(np.roll(a, (dy, dx), (0, 1)), a, (dy, dx)) < 1e-9


def test_masked_kernel_ignores_bright():
    a = np.random.default_rng(0).random((32, 32))
    b = np.roll(a, (4, 2), (0, 1))
    b[3, 3] = a[20, 20] = 1e4
    dy, dx, _ = register.masked_kernel(99)(b, a)
    assert (dy, dx) == (4, 2)


# the octree


def test_octree(spark):
    rng = np.random.default_rng(1)
    volume = np.full((16, 16, 16), 200)
    volume[4:9, 3:11, 5:8] += rng.integers(0, 4000, (5, 8, 3))
    v = voxels(spark, volume)
    leaves = octree.encode(v, 4, 0.2, 108.0).cache()
    assert leaves.count() < volume.size / 4
    back = image(octree.reconstruct(leaves, 4), volume.shape)
    coarse = image(octree.reconstruct(leaves, 4, "level"), volume.shape)
    bound = 2 * 0.2 * np.maximum(back, 108.0) + 1e-6
    assert (np.abs(back - volume) <= bound).all() and (back[coarse == 4] == volume[coarse == 4]).all()
    tree = octree.fill_tree(leaves.select("level", *octree.CELL, "v"), 4)
    root = tree.where("level = 0").first()
    assert abs(root.v - volume.mean()) < 1e-6
    top = octree.fill_tree(leaves.select("level", *octree.CELL, "v"), 4, mode="max").where("level = 0").first()
    assert top.v == back.max()
    found = octree.find_particles(v.where("z = 15 and y = 15").select("z", "y", "x"), leaves, 4)
    assert found.count() == 16 and found.where("v <> 200").count() == 0
    assert octree.reconstruct(leaves, 4, "smooth").count() == volume.size


# merging and slices


def test_merge_is_max_in_any_order(spark):
    rng = np.random.default_rng(2)
    parts = [voxels(spark, rng.integers(1, 99, (2, 8, 8)), row=0, col=c) for c in (0, 1)]
    reg = spark.createDataFrame([("a", 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("b", 0, 1, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0)], "path string, row int, col int, dH double, dV double, dD double, ABS_H double, ABS_V double, ABS_D double")
    a = merge.merge_max(parts[0].unionByName(parts[1]), reg)
    b = merge.merge_max(parts[1].unionByName(parts[0]), reg)
    assert a.exceptAll(b).isEmpty() and a.count() == 2 * 8 * 13
    assert merge.extent(reg, 8, 2).first() == (13, 8, 2)
    s = merge.reconstruct_slice(parts[0].unionByName(parts[1]), reg, "z", 1)
    assert s.exceptAll(a.where("z = 1").select("y", "x", "v")).isEmpty()
    with pytest.raises(ValueError):
        merge.downsampled(a, 3)


@pytest.mark.parametrize("shift", [(0.0, 0.0), (3.25, -2.5), (-1.125, 0.75)])
def test_shifts_of_parts_of_a_pixel(shift):
    """A band-limited image moved by its phases."""
    rng = np.random.default_rng(7)
    f = np.fft.fft2(rng.normal(size=(48, 40)))
    fy, fx = np.fft.fftfreq(48)[:, None], np.fft.fftfreq(40)[None, :]
    f = np.where((np.abs(fy) < 0.3) & (np.abs(fx) < 0.3), f, 0)
    moved = np.real(np.fft.ifft2(f * np.exp(2j * np.pi * (fy * shift[0] + fx * shift[1]))))
    dy, dx, _ = register.phase_correlation(np.real(np.fft.ifft2(f)), moved, 8)
    assert (dy, dx) == shift
    whole = register.phase_correlation(np.real(np.fft.ifft2(f)), moved)
    assert abs(whole[0] - shift[0]) <= 0.5 and abs(whole[1] - shift[1]) <= 0.5


def test_tiles_by_number_and_by_place(spark):
    t = spark.createDataFrame([(r, c, f"{r}{c}") for r in range(3) for c in range(2) if (r, c) != (1, 0)], "row int, col int, path string")
    assert [[r.path for r in grid.nth(t, n).collect()] for n in (0, 2, 4, 5, -1, -5, -6)] == [["00"], ["11"], ["21"], [], ["21"], ["00"], []]
    assert [r.path for r in grid.at(t, 2, 1).collect()] == ["21"] and grid.at(t, 1, 0).count() == 0


def test_clahe_pixel_by_pixel(spark):
    """Each pixel by itself: its rank in the clipped histograms of the four nearest cells, blended by distance."""
    rng = np.random.default_rng(4)
    volume = rng.gamma(2.0, 300.0, (2, 24, 20)).astype(int) + 1
    tiles, clip, levels = 4, 2.0, 16
    got = image(merge.equalize_hist(voxels(spark, volume), tiles, clip, levels), volume.shape)
    for z in range(2):
        plane = volume[z]
        top, (ny, nx) = plane.max(), plane.shape
        level = lambda v: v * (levels - 1) // top  # noqa: B023, E731
        curves = {}
        for a in range(tiles):
            for b in range(tiles):
                mine = [level(plane[y, x]) for y in range(ny) for x in range(nx) if y * tiles // ny == a and x * tiles // nx == b]
                limit = max(clip * len(mine) / levels, 1)
                hist = [mine.count(k) for k in range(levels)]
                spare = sum(max(h - limit, 0) for h in hist) / levels
                run = np.cumsum([min(h, limit) + spare for h in hist])
                curves[a, b] = run / max(run[-1], 1)
        for y in range(ny):
            for x in range(nx):
                fy, fx = (y + 0.5) * tiles / ny - 0.5, (x + 0.5) * tiles / nx - 0.5
                total = 0.0
                for a, wa in ((int(np.floor(fy)), 1 - (fy - np.floor(fy))), (int(np.floor(fy)) + 1, fy - np.floor(fy))):
                    for b, wb in ((int(np.floor(fx)), 1 - (fx - np.floor(fx))), (int(np.floor(fx)) + 1, fx - np.floor(fx))):
                        total += wa * wb * curves[min(max(a, 0), tiles - 1), min(max(b, 0), tiles - 1)][level(plane[y, x])]
                assert abs(got[z, y, x] - total * top) <= 1.0, (z, y, x)


def test_cells_are_taken_in_tile_by_tile(spark):
    """A cell that stays out keeps no other out: of a chain A, B, C the third is in."""
    rows = [(0, 0, 1, 0.0, 0.0, 0.0), (0, 1, 2, 0.0, 0.0, 3.0), (0, 2, 3, 0.0, 0.0, 6.0), (0, 3, 4, 0.0, 0.0, 9.0), (1, 0, 5, 50.0, 0.0, 0.0), (1, 1, 6, 50.0, 0.0, 1.0), (1, 1, 7, 50.0, 0.0, 1.2)]
    c = spark.createDataFrame(rows, "row int, col int, cell_id long, z double, y double, x double")
    assert sorted(r.cell_id for r in cells.merge_tiles(c).collect()) == [1, 3, 5, 6, 7]  # 6 and 7 are too alike for 5 to tell
    boxes = spark.createDataFrame([(r, k, -1.0, 99.0, -1.0, 1.0, 3.0 * k - (0.0 if k == 1 else 3.0), 99.0) for r in (0, 1) for k in range(4)], "row int, col int, z0 double, z1 double, y0 double, y1 double, x0 double, x1 double")
    assert sorted(r.cell_id for r in cells.merge_tiles(c, boxes=boxes).collect()) == [1, 2, 4, 5, 6, 7]  # 1 lies outside the second tile
    assert cells.merge_tiles(c.limit(0)).count() == 0


def test_cells_by_the_fold(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k % 2), int(k % 6) // 2, k, *map(float, rng.uniform(0, 30, 3))) for k in range(240)]
    c = spark.createDataFrame(rows, "row int, col int, cell_id long, z double, y double, x double")
    kept = []
    for tile in sorted({r[:2] for r in rows}):
        new = [r for r in rows if r[:2] == tile]
        gone = set()
        for k in kept:
            near = sorted((float(np.linalg.norm(np.subtract(k[3:], n[3:]))), n[2]) for n in new)
            if near[0][0] < 8 and near[0][0] < 0.8 * near[1][0]:
                gone.add(near[0][1])
        kept += [r for r in new if r[2] not in gone]
    assert sorted(r.cell_id for r in cells.merge_tiles(c, 0.8, 8.0).collect()) == sorted(r[2] for r in kept)


def shuffled(spark):
    """Rows that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_cells_crowded_within_distance_max(spark):
    """Pairs within distance_max are compared, never shuffled; cells at one place, or with a coordinate that is no number, are right."""
    rng = np.random.default_rng(8)
    n = 3000
    z, y, x = rng.normal(0, 4, (3, n))
    z[:20], y[:20], x[:20] = 1.0, 2.0, 3.0
    z[20:40], y[20:40], x[20:40] = z[21], y[21], x[21] + np.arange(20) * 1e-3
    z[-1], y[-2] = np.inf, np.nan
    rows = [(0, k % 2, k, float(z[k]), float(y[k]), float(x[k])) for k in range(n)]
    c = spark.createDataFrame(rows, "row int, col int, cell_id long, z double, y double, x double")
    p = np.stack([z, y, x], 1)
    for ratio in (0.0, 0.6, 1.0):
        want = set()
        for k in range(0, n - 2, 2):
            d = np.sqrt(((p[k] - p[1 : n - 2 : 2]) ** 2).sum(1))
            i, j = np.lexsort((np.arange(len(d)), d))[:2]
            if d[i] < 20 and d[i] < ratio * d[j]:
                want.add((k, 2 * int(i) + 1))
        before = shuffled(spark)
        assert {(r.id1, r.id2) for r in cells.tile_matches(c, ratio, 20.0).collect()} == want
        if ratio:
            assert want and shuffled(spark) - before < 100 * n


def test_clahe_widens_contrast(spark):
    rng = np.random.default_rng(3)
    volume = rng.integers(1000, 1100, (1, 32, 32))
    out = image(merge.equalize_hist(voxels(spark, volume)), volume.shape)
    assert out.std() > volume.std() and out.max() <= volume.max()


def test_depth_colours(spark):
    volume = np.zeros((4, 3, 3), int) + 5
    volume[2, 1, 1] = 50
    p = project.depth_colour(voxels(spark, volume))
    at = {(r.y, r.x): r["at"] for r in p.collect()}
    assert at[1, 1] == 2 and at[0, 0] == 0
    assert project.depth_rgb(p, 4).count() == 9


# features and objects


def test_features_match_numpy(spark):
    rng = np.random.default_rng(4)
    volume = rng.integers(1, 100, (6, 7, 8))
    v, padded = voxels(spark, volume), np.pad(volume, 3).astype(float)
    core = (slice(3, -3),) * 3
    gz = (np.roll(padded, -1, 0) - np.roll(padded, 1, 0))[core] / 2
    assert np.allclose(image(features.gradient(v), volume.shape, "gz"), gz)
    w = np.array(features.kernel(1.2, 5))
    g = padded
    for axis in range(3):
        g = sum(w[k + 2] * np.roll(g, k, axis) for k in range(-2, 3))
    assert np.allclose(image(features.gaussian(v, 1.2, 5), volume.shape, "gauss"), g[core])
    assert features.standard_features(v).columns == ["z", "y", "x", "f0", "f1", "f2", "f3", "f4"]


def components(mask):
    label, out = 0, np.zeros(mask.shape, int)
    for start in zip(*np.nonzero(mask), strict=True):
        if out[start]:
            continue
        label += 1
        todo = [start]
        while todo:
            p = todo.pop()
            if all(0 <= a < n for a, n in zip(p, mask.shape, strict=True)) and mask[p] and not out[p]:
                out[p] = label
                todo += [tuple(a + b for a, b in zip(p, s, strict=True)) for s in morphology.SIX]
    return out


@pytest.mark.parametrize("block", [4, 64])
def test_components_match_flood_fill(spark, block):
    mask = np.random.default_rng(5).random((10, 11, 12)) < 0.35
    got = morphology.connected_components(voxels(spark, mask.astype(int), 0), shape=(11, 12), block=block).toPandas()
    want = components(mask)
    assert len(got) == mask.sum()
    pairs = set(zip(got.label, want[got.z, got.y, got.x], strict=True))
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == want.max()


def test_opening_and_objects(spark):
    mask = np.zeros((9, 9, 9), int)
    mask[3:6, 3:6, 3:6] = 1
    mask[0, 0, 0] = 1
    v = voxels(spark, mask, 0)
    assert morphology.opening(v).count() == 7
    labels = morphology.connected_components(v, shape=(9, 9))
    assert sorted(r.volume for r in morphology.volumes(labels).collect()) == [1, 27]
    assert morphology.without_edge_objects(labels, (9, 9, 9)).count() == 27
    c = morphology.centers(morphology.size_filter(labels, 2)).first()
    assert (c.z, c.y, c.x) == (4, 4, 4)
    with pytest.raises(Exception, match="features do not match"):
        morphology.map_feature(labels, spark.createDataFrame([(1, 2.0)], "label long, value double")).collect()


def test_classifier(spark, tmp_path):
    rng = np.random.default_rng(6)
    p = pd.DataFrame(rng.normal(size=(300, 2)), columns=["a", "b"])
    p["label"] = (p.a + p.b > 0).astype(int)
    rows = spark.createDataFrame(p)
    model = segment.train(rows, ["a", "b"])
    segment.save(model, str(tmp_path / "m"))
    got = segment.predict(rows, segment.load(str(tmp_path / "m")))
    assert got.where("prediction = label").count() > 270
    assert abs(sum(segment.predict(rows, model, "probability").first().prediction) - 65535) <= 2
    assert segment.accuracy(got).where("label is null").first().n == 300
    assert abs(segment.class_shares(got).agg(F.sum("share")).first()[0] - 1) < 1e-9
    late = segment.add_labels(*[spark.createDataFrame([(0, 0, 0, k)], "z int, y int, x int, label short") for k in (1, 2)])
    assert late.first().label == 2


@pytest.mark.parametrize("seed", [0, 1])
def test_cell_matches_match_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    a = rng.random((60, 3)) * 60
    b = np.concatenate([a[:25] + rng.normal(0, 0.5, (25, 3)), rng.random((40, 3)) * 60])
    frame = lambda m, base: spark.createDataFrame([(base + i, *map(float, r)) for i, r in enumerate(m)], "cell_id long, z double, y double, x double")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    two = np.sort(d, 1)
    want = {(i, 1000 + int(d[i].argmin())) for i in range(len(a)) if two[i, 0] < 5 and two[i, 0] < 0.7 * two[i, 1]}
    got = {(r.id1, r.id2) for r in cells.matches(frame(a, 0), frame(b, 1000)).collect()}
    assert got == want
    once = cells.deduplicate(frame(a, 0), frame(b, 1000))
    assert once.count() == len(a) + len(b) - len({j for _, j in want})
    with pytest.raises(ValueError):
        cells.matches(frame(a, 0), frame(b, 0), lowe_ratio=2)


def test_ontology_rules(spark):
    nodes = spark.createDataFrame([(1, None, "root", "root"), (2, 1, "a", "A"), (3, 2, "b", "B"), (4, 3, "c", "C")], "id long, parent_id long, acronym string, name string")
    tree = atlas.with_paths(nodes)
    assert {r.id: r.path for r in tree.collect()}[4] == [4, 3, 2, 1]
    ids = spark.createDataFrame([(4,), (4,), (1,), (9,)], "id long")
    at = lambda n: {r.name: r.n for r in atlas.ontology_counts(ids, tree, n).collect()}
    assert at(0) == {"C": 2, "root": 1, "unknown": 1}
    assert at(7) == {"B": 2, "root": 1, "unknown": 1}  # a path of 4 is longer than 7 - 6 + 1: element 7 - 6
    assert at(9) == {"A": 2, "root": 1, "unknown": 1}  # a path of 4 is no longer than 9 - 6 + 1: the one below the root
    assert {r.acronym: r.n for r in atlas.counts_by_acronym(ids, tree, ["a", "root"]).collect()} == {"a": 2, "root": 3}


def test_paths_of_a_deep_tree(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    nodes = spark.createDataFrame([(k, k - 1 if k else None) for k in range(21)], "id int, parent_id int")
    for depth in (4, 16):
        got = {r.id: r.path for r in atlas.with_paths(nodes, depth).collect()}
        assert got == {k: list(range(k, -1, -1)) for k in range(21)}
