"""Triangle geometry and area-weighted surface samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cumulo.functions.formulas import square
from cumulo.functions.hashing import hash_uniform
from cumulo.operators.ranking import fold_before
from cumulo.session import cut_lineage

AXES = ("x", "y", "z")
#: Faces of a block, which every draw walks through.
BLOCK = 8


def assemble(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the coordinates of their three vertices (``ax .. cz``)."""
    meshed = faces
    for corner in ("a", "b", "c"):
        placed = vertices.select("mesh_id", F.col("vertex_ix").alias(corner), *[F.col(x).alias(f"{corner}{x}") for x in AXES])
        meshed = meshed.join(placed, ["mesh_id", corner])
    return meshed


def face_geometry(vertices: DataFrame, faces: DataFrame, minimum: float = 1e-12) -> DataFrame:
    """Assembled faces with doubled area and unit normal; degenerate ones dropped."""
    meshed = assemble(vertices, faces)

    def edge(to: str, x: str) -> Column:
        return F.col(f"{to}{x}") - F.col(f"a{x}")

    cross = {
        "x": edge("b", "y") * edge("c", "z") - edge("b", "z") * edge("c", "y"),
        "y": edge("b", "z") * edge("c", "x") - edge("b", "x") * edge("c", "z"),
        "z": edge("b", "x") * edge("c", "y") - edge("b", "y") * edge("c", "x"),
    }
    crossed = meshed.withColumns({f"_k{x}": v for x, v in cross.items()})
    area = F.sqrt(square(F.col("_kx")) + square(F.col("_ky")) + square(F.col("_kz")))
    kept = crossed.withColumn("double_area", area).filter(F.col("double_area") > minimum)
    return kept.withColumns({f"n{x}": F.col(f"_k{x}") / F.col("double_area") for x in AXES}).drop("_kx", "_ky", "_kz")


def flat_meshes(faces: DataFrame, geometry: DataFrame) -> DataFrame:
    """Meshes without a single usable triangle."""
    return faces.select("mesh_id").distinct().join(geometry.select("mesh_id").distinct(), "mesh_id", "left_anti").withColumn(
        "reason", F.lit("no non-degenerate triangle")
    )


def sample_surface(geometry: DataFrame, count: int, *, seed: object = 0, roles: Sequence[str] = ("source", "target"),
                   split: Column | None = None) -> DataFrame:
    """``count`` area-weighted points per mesh and role, with face normals.

    Areas become whole-number weights out of 2^60, so running sums are exact in
    any order and every draw falls into exactly one face. Faces are packed in
    blocks of 8; a draw finds its block through an interval join bucketed on its
    share of the weight, then its face inside that one block row.
    """
    # Read three times.
    geometry = cut_lineage(geometry)
    area = geometry.groupBy("mesh_id").agg(F.sum("double_area").alias("area"))
    weighed = geometry.select("mesh_id", "face_ix", "double_area").join(area, "mesh_id").select(
        "mesh_id", "face_ix", F.rint(F.col("double_area") / F.col("area") * F.lit(float(2**60))).cast("bigint").alias("weight")
    )
    packed = weighed.groupBy("mesh_id", F.floor(F.col("face_ix") / BLOCK).alias("block")).agg(
        F.sum("weight").alias("block_weight"), F.array_sort(F.collect_list(F.struct("face_ix", "weight"))).alias("faces")
    )
    totals = packed.groupBy("mesh_id").agg(F.sum("block_weight").alias("total"), F.count(F.lit(1)).alias("blocks"))
    placed = fold_before(packed, ["mesh_id"], "block", "block_weight", "low", F.sum).join(totals, "mesh_id").withColumn(
        "low", F.coalesce("low", F.lit(0))
    )

    def bucket(position: Column) -> Column:
        return F.floor(position / F.col("total") * F.col("blocks"))

    placed = placed.withColumn("high", F.col("low") + F.col("block_weight")).withColumn(
        "bucket", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high"))))
    )
    keyed = [seed] + ([split] if split is not None else []) + [F.col("mesh_id"), F.col("role"), F.col("draw")]
    draws = totals.withColumn("role", F.explode(F.array(*[F.lit(r) for r in roles]))).withColumn(
        "draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    ).withColumn("at", (hash_uniform(*keyed, "face") * F.col("total")).cast("bigint")).withColumn("bucket", bucket(F.col("at")))
    found = draws.select("mesh_id", "role", "draw", "at", "bucket").join(
        placed.select("mesh_id", "bucket", "low", "high", "faces"), ["mesh_id", "bucket"]
    ).filter((F.col("at") >= F.col("low")) & (F.col("at") < F.col("high")))
    begin = F.struct(F.col("at").alias("at"), F.col("low").alias("sum"), F.lit(None).cast("int").alias("face"))
    walk = F.aggregate("faces", begin, lambda state, f: F.struct(
        state["at"].alias("at"), (state["sum"] + f["weight"]).alias("sum"),
        F.coalesce(state["face"], F.when(state["at"] < state["sum"] + f["weight"], f["face_ix"].cast("int"))).alias("face"),
    ), lambda state: state["face"])
    chosen = found.select("mesh_id", "role", "draw", walk.alias("face_ix"))
    first, second = F.sqrt(hash_uniform(*keyed, "first")), hash_uniform(*keyed, "second")
    weighted = chosen.join(geometry, ["mesh_id", "face_ix"]).withColumns({"_f": first, "_s": second})
    w = (F.lit(1.0) - F.col("_f"), F.col("_f") * (F.lit(1.0) - F.col("_s")), F.col("_f") * F.col("_s"))
    return weighted.select(
        "mesh_id", "role", F.col("draw").cast("bigint").alias("point_id"), "face_ix",
        *[(w[0] * F.col(f"a{x}") + w[1] * F.col(f"b{x}") + w[2] * F.col(f"c{x}")).alias(x) for x in AXES], "nx", "ny", "nz",
    )
