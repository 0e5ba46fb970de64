import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cumulo.operators.surface import face_geometry, flat_meshes, sample_surface
from cumulo.plans.gates import hash_drift, missing_cells, run_identity
from cumulo.sources import manifests, meshes, points, runs
from cumulo.streaming.ingest import ingest_finished_runs
from tests.helpers import clouds

CUBE_FACE = "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\n"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def faces_of(frame):
    return {k: [(r.a, r.b, r.c) for r in rows] for k, rows in _grouped(frame).items()}


def _grouped(frame):
    out = {}
    for row in frame.orderBy("mesh_id", "face_ix").collect():
        out.setdefault(row.mesh_id, []).append(row)
    return out


def test_obj_variants(spark, tmp_path):
    write(tmp_path / "quad.obj", "# c\n" + CUBE_FACE + "f 1/1/1 2/2/2 3/3/3 4/4/4\n")
    write(tmp_path / "negative.obj", CUBE_FACE + "f -4 -3 -2\n")
    write(tmp_path / "early.obj", "f 1 2 3\n" + CUBE_FACE)
    write(tmp_path / "range.obj", CUBE_FACE + "f 1 2 9\n")
    write(tmp_path / "nan.obj", "v nan 0 0\n" + CUBE_FACE + "f 1 2 3\n")
    write(tmp_path / "empty.obj", "# nothing\n")
    vertices, faces, bad = meshes.read_obj(spark, str(tmp_path))
    assert faces_of(faces) == {"quad.obj": [(0, 1, 2), (0, 2, 3)], "negative.obj": [(0, 1, 2)]}
    assert vertices.count() == 8
    reasons = {r.mesh_id: (r.line, r.reason) for r in bad.collect()}
    assert reasons["early.obj"] == (1, "a face comes before any vertex") and reasons["range.obj"] == (5, "a corner points past the vertices so far")
    assert reasons["nan.obj"][0] == 1 and reasons["empty.obj"][1] == "too few vertices or faces"


def test_files_of_many_splits(spark, tmp_path):
    """One file of each format, read by several tasks: lines, vertices and faces are numbered through."""
    draw = np.random.default_rng(5)
    coords = draw.integers(-50, 50, size=(400, 3))
    corners = [(k, k + 1, k + 2, k + 3) if k % 3 else (k, k + 1, k + 2) for k in range(300)]
    rows, seen = [], 0
    for k, ring in enumerate(corners):  # faces between vertices, relative indices among them
        while seen <= ring[-1]:
            rows.append("v %d %d %d" % tuple(coords[seen]))
            seen += 1
        rows += ["", "# note"] if k % 7 == 0 else []
        rows.append("f " + " ".join(str(i - seen) if k % 2 else f"{i + 1}//{i + 1}" for i in ring))
    write(tmp_path / "long.obj", "\r\n".join(rows) + "\n")
    off = ["OFF # made", "%d %d 0" % (seen, len(corners)), *("%d %d %d" % tuple(c) for c in coords[:seen]), *(f"{len(r)} " + " ".join(map(str, r)) for r in corners)]
    write(tmp_path / "long.off", "\n".join(off))
    ply = ["ply", "format ascii 1.0", f"element vertex {seen}", "property float z", "property float y", "property float x", "end_header", *("%d %d %d" % tuple(c) for c in coords[:seen])]
    write(tmp_path / "long.ply", "\n".join(ply))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        lines = meshes.file_lines(spark, str(tmp_path), "long.obj")
        assert lines.select("block").distinct().count() > 3
        assert [r.text for r in lines.orderBy("line").collect()] == rows and lines.count() == len(rows)
        wanted = [t for r in corners for t in ([(r[0], r[1], r[2])] + ([(r[0], r[2], r[3])] if len(r) == 4 else []))]
        for reader, name in ((meshes.read_obj, "long.obj"), (meshes.read_off, "long.off")):
            vertices, faces, bad = reader(spark, str(tmp_path))
            assert bad.count() == 0 and faces_of(faces) == {name: wanted}
            got = vertices.orderBy("vertex_ix").collect()
            assert [(r.x, r.y, r.z) for r in got] == [tuple(map(float, c)) for c in coords[:seen]]
        got, bad = points.read_ply(spark, str(tmp_path))
        assert bad.count() == 0 and [(r.z, r.y, r.x) for r in got.orderBy("point_id").collect()] == [tuple(map(float, c)) for c in coords[:seen]]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_off_variants(spark, tmp_path):
    body = "0 0 0\n1 0 0 # corner\n1 1 0\n0 1 0\n4 0 1 2 3 255 0 0\n"
    write(tmp_path / "inline.off", "OFF 4 1 0\n" + body)
    write(tmp_path / "fused.off", "OFF4 1 0\n" + body)
    write(tmp_path / "plain.off", "# made\nOFF\n\n4 1 0\n" + body)
    write(tmp_path / "range.off", "OFF\n3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 3\n")
    write(tmp_path / "short.off", "OFF\n4 2 0\n" + body)
    write(tmp_path / "head.off", "PLY\n4 1 0\n" + body)
    write(tmp_path / "void.off", "\n")
    _, faces, bad = meshes.read_off(spark, str(tmp_path))
    assert faces_of(faces) == {n: [(0, 1, 2), (0, 2, 3)] for n in ("inline.off", "fused.off", "plain.off")}
    assert {r.mesh_id: r.reason for r in bad.collect()} == {
        "range.off": "a corner points past the vertices", "short.off": "fewer rows than the counts say", "head.off": "no OFF header", "void.off": "nothing in the file",
    }


def test_mixed_formats_and_catalogs(spark, tmp_path):
    write(tmp_path / "a.OBJ", CUBE_FACE + "f 1 2 3\n")
    write(tmp_path / "b.off", "OFF 3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    write(tmp_path / "c.stl", "solid")
    _, faces, bad = meshes.read_meshes(spark, str(tmp_path))
    assert set(faces_of(faces)) == {"a.OBJ", "b.off"}
    assert [(r.mesh_id, r.reason) for r in bad.collect()] == [("c.stl", "neither OBJ nor OFF")]
    root = tmp_path / "tree"
    write(root / "000001" / "m1" / "models" / "model_normalized.obj", CUBE_FACE)
    write(root / "chair" / "train" / "c1.off", "x")
    write(root / "chair" / "test" / "c2.off", "y")
    write(root / "desk" / "test" / "d1.off", "z")
    row = meshes.nested_catalog(spark, str(root)).first()
    assert (row.category, row.model_id, row.mesh_sha256) == ("000001", "m1", hashlib.sha256(CUBE_FACE.encode()).hexdigest())
    official = meshes.official_catalog(spark, str(root))
    assert {(r.category, r.model_id, r.official_split) for r in official.collect()} == {("chair", "c1", "train"), ("chair", "c2", "test"), ("desk", "d1", "test")}
    assert [r.category for r in meshes.uneven_categories(official).collect()] == ["desk"]


def test_surface_samples_lie_on_faces_and_follow_area(spark):
    vertices = spark.createDataFrame([("m", i, *map(float, p)) for i, p in enumerate([(0, 0, 0), (3, 0, 0), (0, 3, 0), (0, 0, 1), (1, 0, 1), (0, 1, 1)])], "mesh_id string, vertex_ix int, x double, y double, z double")
    faces = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 3, 4, 5), ("m", 2, 0, 0, 1), ("flat", 0, 0, 0, 0)], "mesh_id string, face_ix int, a int, b int, c int")
    geometry = face_geometry(vertices, faces)
    assert geometry.count() == 2 and [r.mesh_id for r in flat_meshes(faces, geometry).collect()] == ["flat"]
    rows = sample_surface(geometry, 400, seed=1).toPandas()
    assert len(rows) == 800 and set(rows["z"].round(9)) == {0.0, 1.0}
    assert (rows["x"] >= 0).all() and (rows["x"] + rows["y"] <= 3 + 1e-9).all()
    assert abs((rows["z"] < .5).mean() - .9) < .05
    assert not rows[rows.role == "source"][["x"]].reset_index(drop=True).equals(rows[rows.role == "target"][["x"]].reset_index(drop=True))


def test_many_faces_cross_blocks(spark):
    n = 300
    vertices = spark.range(n + 2).select(F.lit("m").alias("mesh_id"), F.col("id").cast("int").alias("vertex_ix"), F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("double").alias("y"), F.lit(0.0).alias("z"))
    faces = spark.range(n).select(F.lit("m").alias("mesh_id"), *[(F.col("id") + i).cast("int").alias(c) for i, c in enumerate("abc")], F.col("id").cast("int").alias("face_ix"))
    rows = sample_surface(face_geometry(vertices, faces), 500, roles=("source",)).toPandas()
    assert len(rows) == 500 and rows["face_ix"].nunique() > 200 and rows["face_ix"].max() > 270


def test_ply_round_trip_and_rejects(spark, tmp_path):
    frame = clouds(spark, {"a": [[0.1, -2, 1e-5], [3, 4.5, 123456789.0]]}, {"a": [[0, 0, 1], [0, 1, 0]]})
    text = points.ply_text(frame).first().value
    assert text.splitlines()[-2:] == ["0.1 -2 1e-05 0 0 1", "3 4.5 123456789 0 1 0"]
    write(tmp_path / "a.ply", text)
    order = "ply\nformat ascii 1.0\ncomment hi\nelement vertex 1\nproperty float z\nproperty float x\nproperty float y\nelement face 0\nproperty list uchar int i\nend_header\n3 1 2\n"
    write(tmp_path / "b.ply", order)
    write(tmp_path / "c.ply", order.replace("vertex 1", "vertex 2"))
    write(tmp_path / "d.ply", order.replace("float y", "float w"))
    write(tmp_path / "e.ply", "plain")
    good, bad = points.read_ply(spark, str(tmp_path))
    rows = {(r.cloud_id, r.point_id): (r.x, r.y, r.z) for r in good.collect()}
    assert rows[("b.ply", 0)] == (1, 2, 3) and rows[("a.ply", 0)] == pytest.approx((0.1, -2, 1e-5))
    assert {r.cloud_id: r.reason for r in bad.collect()} == {"c.ply": "fewer vertices than announced", "d.ply": "x, y or z is not among the properties", "e.ply": "not a PLY file"}


def test_metric_logs(spark, tmp_path):
    full = "".join(f"   {label}  ({kind}): {i}.5\n" for i, (label, kind) in enumerate(points.LOG_METRICS.values()))
    write(tmp_path / "ok.log", full.replace("7.5", "inf"))
    write(tmp_path / "short.log", "   mseF  (p2point): 1\n")
    good, bad = points.read_metric_logs(spark, str(tmp_path))
    row = good.first()
    assert row.d1_mse == 0.5 and row.d2_psnr_db == 3.5 and row.d2_hausdorff_psnr_db == float("inf")
    assert bad.first().reason.startswith("missing d1_psnr_db")


def test_manifest_round_trip_and_problems(spark, tmp_path):
    record = {"category": "c", "model_id": "m", "mesh": "c/m.off", "mesh_sha256": "0" * 64}
    good = {"version": 1, "dataset": "d", "splits": {"train": [record], "validation": [{**record, "model_id": "n", "mesh": "../n.off"}]}}
    write(tmp_path / "good.json", json.dumps(good))
    write(tmp_path / "bad.json", json.dumps({"version": 2, "splits": {"a": [record], "b": [record, {"category": "x"}], "e": []}}))
    rows = manifests.read_manifest(spark, str(tmp_path / "good.json"))
    assert {(r.split, r.model_id) for r in rows.collect()} == {("train", "m"), ("validation", "n")}
    manifests.write_manifest(rows, str(tmp_path / "again"), dataset="d", seed=1)
    again = manifests.read_manifest(spark, str(tmp_path / "again"))
    assert again.exceptAll(rows).isEmpty() and rows.exceptAll(again).isEmpty()
    assert manifests.manifest_problems(spark, str(tmp_path / "good.json")).isEmpty()
    assert {r.reason for r in manifests.manifest_problems(spark, str(tmp_path / "bad.json")).collect()} == {
        "version must be 1", "dataset is missing", "split is empty: e", "invalid record in split: b", "identity repeats: c/m",
    }
    catalog = spark.createDataFrame([("c/m.off", "1" * 64)], "mesh string, mesh_sha256 string")
    assert {(r.mesh, r.reason) for r in hash_drift(rows, catalog).collect()} == {("c/m.off", "content differs"), ("../n.off", "unsafe path")}


def test_runs_resume_grid_and_artifacts(spark, tmp_path):
    grid = runs.product_grid(spark, {"k": [4, 8], "bits": [8, 12]})
    assert grid.count() == 4
    assert runs.cross_axes(spark, {"k": [4, 8, 16], "n": [64, 128]}, {"k": 8, "n": 128}).count() == 4
    wanted = runs.with_fingerprint(grid.withColumn("epochs", F.lit(3)), ["k", "bits", "epochs"])
    done = runs.with_fingerprint(grid.withColumn("epochs", F.when(F.col("k") == 4, 3).otherwise(2)), ["k", "bits", "epochs"])
    assert {(r.k, r.bits) for r in runs.pending_cells(wanted, done, ["k", "bits"]).collect()} == {(8, 8), (8, 12)}
    row = {"split": "v", "family": "f", "model_id": "m", "method": "fps", "chamfer_mse": 0.25}
    for seed in (7, 11):
        write(tmp_path / "runs" / f"seed_{seed}" / "benchmark_metrics.json", json.dumps({"per_cloud": [row, row], "other": 1}))
        write(tmp_path / "runs" / f"seed_{seed}" / "rows.jsonl", json.dumps(row) + "\n")
    found = runs.read_run_artifacts(spark, str(tmp_path / "runs" / "seed_*" / "benchmark_metrics.json"))
    assert found.groupBy("model_seed").count().toPandas().set_index("model_seed")["count"].to_dict() == {7: 2, 11: 2}
    runs.write_rows(found, str(tmp_path / "rows"))
    assert runs.read_rows(spark, str(tmp_path / "rows")).filter("method = 'fps'").count() == 4
    runs.write_json_rows(found, str(tmp_path / "json"))
    assert runs.read_json_rows(spark, str(tmp_path / "json")).agg(F.sum("chamfer_mse")).first()[0] == 1.0
    for _ in range(2):
        ingest_finished_runs(spark, str(tmp_path / "runs"), str(tmp_path / "sink"), str(tmp_path / "log"))
    sink = spark.read.parquet(str(tmp_path / "sink"))
    assert sorted(r.model_seed for r in sink.collect()) == [7, 11]


def test_design_checks(spark):
    rows = spark.createDataFrame([(0, 0, "a"), (0, 1, "a"), (1, 0, "a")], "d int, r int, c string")
    grid = runs.grid_of(rows, ["d", "r"], "c")
    assert grid.count() == 4
    missing = missing_cells(rows, grid, ["d", "r", "c"]).collect()
    assert [(r.d, r.r) for r in missing] == [(1, 1)]
    hashes = spark.createDataFrame([(1, "h1", "same"), (2, "h1", "same")], "seed int, state string, data string").withColumn("g", F.lit(0))
    row = run_identity(hashes, group=["g"], independent=["state"], shared=["data"]).first()
    assert row.state_unique is False and row.data_equal is True


def test_event_files_are_dealt_by_counted_files(spark, tmp_path):
    from pathlib import Path

    from cumulo.catalog import surfaces

    rows = spark.range(900).selectExpr(
        "id AS event_id", "id % 300 AS user_id", "timestamp_seconds(id * 77) AS ts", "id / 8 AS value", """concat('{"k": ', id % 9, '}') AS props""")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    written = surfaces._event_lines(spark, str(tmp_path), [], "v", "f")
    files = list(Path(written.removeprefix("file:")).glob("cloud_id=*/part-*"))
    tasks = {path.name.split("-")[1] for path in files}
    assert len(files) == 300
    assert len(tasks) > 1 and max(sum(path.name.split("-")[1] == task for path in files) for task in tasks) <= 2 * surfaces.TASK_FILES
    assert {(r.vertices, r.faces) for r in surfaces.obj_files(spark, str(tmp_path)).collect()} == {(3, 1)}


def test_walked_folders_hold_what_sparks_readers_find(spark, tmp_path):
    """The same files, lines and splits of any width; hidden names are passed over."""
    from cumulo.sources.listing import split_lines, walked_files

    draw = np.random.default_rng(3)
    for k in range(12):
        text = b"".join(draw.choice([b"v 1 2", b"", b"\r", b"\n", b"\r\n", " é".encode(), b"f"], 60))
        path = tmp_path / f"d{k % 3}" / "deep" / f"m{k}.obj"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"\xef\xbb\xbf" * (k % 2) + text + b"\n" * (k % 2))
    write(tmp_path / "empty.obj", "")
    for name in (".m.obj", "_m.obj", "_hidden/m.obj", "m.off", "_k=1/m.obj"):
        write(tmp_path / name, "v 0 0 0\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    read = spark.read.text(str(tmp_path), recursiveFileLookup=True, pathGlobFilter="*.[oO]bj").select("_metadata.file_name", "value")
    wanted = sorted(map(tuple, read.collect()))
    try:
        for width in (3, 17, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
            files = walked_files(spark, str(tmp_path), "*.[oO]bj")
            assert {r.mesh_id for r in files.collect()} == {f"d{k % 3}/deep/m{k}.obj" for k in range(12)} | {"empty.obj", "_k=1/m.obj"}
            lines = split_lines(files)
            assert sorted((r.mesh_id.split("/")[-1], r.value) for r in lines.collect()) == wanted
            numbers = meshes.file_lines(spark, str(tmp_path), "*.[oO]bj").groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"), F.max("line").alias("last"), F.count_distinct("line").alias("d"))
            assert all(r.n == r.last == r.d for r in numbers.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_patterns_and_file_names_are_left_to_sparks_readers(spark, tmp_path):
    import gzip

    write(tmp_path / "a.obj", CUBE_FACE + "f 1 2 3\n")
    (tmp_path / "b.obj.gz").write_bytes(gzip.compress((CUBE_FACE + "f 1 2 3\n").encode()))
    for root, glob, names in ((str(tmp_path), "*.{obj,off}", {"a.obj"}), (f"{tmp_path}/a.obj", "*.obj", None), (str(tmp_path), "*.obj*", {"a.obj", "b.obj.gz"})):
        vertices, faces, bad = meshes.read_obj(spark, root, glob)
        assert bad.count() == 0 and faces.count() == (len(names) if names else 1)
        assert names is None or {r.mesh_id for r in vertices.collect()} == names


def test_event_files_are_whole_where_tasks_equal_partitions(spark, tmp_path):
    """As many tasks as shuffle partitions: the planner took the heads and the lines, a union, as dealt already."""
    from pathlib import Path

    from cumulo.catalog import surfaces

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for kind, users in enumerate((60, 40 * partitions)):
        rows = spark.range(4 * users).selectExpr(
            "id AS event_id", f"id % {users} AS user_id", "timestamp_seconds(id * 77) AS ts", "id / 8 AS value", """concat('{"k": ', id % 9, '}') AS props""")
        rows.write.parquet(f"{tmp_path}/{kind}/events.parquet")
        written = surfaces._event_lines(spark, f"{tmp_path}/{kind}", ["OFF", "N M 0"], "", "3")
        files = list(Path(written.removeprefix("file:")).glob("cloud_id=*/part-*"))
        assert len(files) == len({path.parent for path in files}) == users
        assert all(path.read_text().startswith("OFF\n4 2 0\n") for path in files)
        assert {(r.vertices, r.faces) for r in surfaces.off_files(spark, f"{tmp_path}/{kind}").collect()} == {(4, 2)}
