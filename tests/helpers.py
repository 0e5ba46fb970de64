import numpy as np
import pandas as pd

AXES = ["x", "y", "z"]


def clouds(spark, arrays, normals=None, start=0):
    frames = []
    for name, points in arrays.items():
        frame = pd.DataFrame(np.asarray(points, dtype=float), columns=AXES)
        if normals is not None:
            frame[["nx", "ny", "nz"]] = np.asarray(normals[name], dtype=float)
        frame.insert(0, "point_id", np.arange(start, start + len(frame)))
        frame.insert(0, "cloud_id", name)
        frames.append(frame)
    return spark.createDataFrame(pd.concat(frames))


def anchors(spark, arrays):
    frame = clouds(spark, arrays).withColumnRenamed("point_id", "slot")
    return frame.withColumn("slot", frame["slot"].cast("int"))


def table(frame, *order):
    return frame.toPandas().sort_values(list(order)).reset_index(drop=True)


def pairwise(a, b):
    return ((np.asarray(a)[:, None, :] - np.asarray(b)[None, :, :]) ** 2).sum(axis=2)
