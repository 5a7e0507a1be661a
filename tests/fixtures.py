"""The cubes that the golden results belong to."""

import numpy as np

CUBE = np.array([[[-4.0, 0.8, 0.0, 5.0, -3.0], [2.0, 1.0, 0.0, 0.0, -7.0]], [[5.0, 8.0, 2.0, 6.0, 0.0], [-5.0, -1.0, -4.0, -0.5, -8.0]]])
RISING = np.array([[[1.0, 2, 4, 5, 6], [11, 22, 33, 44, 55]], [[10, 20, 30, 40, 50], [111, 222, 333, 444, 555]]])


def long_series(spark, cube):
    from sumloom.series import Series

    rows = [(i, t, *map(float, cube[i, :, t])) for i in range(cube.shape[0]) for t in range(cube.shape[2])]
    names = tuple(f"x{d + 1}" for d in range(cube.shape[1]))
    return Series(spark.createDataFrame(rows, "series_id long, t int, " + ", ".join(f"{n} double" for n in names)), names)


def cube_of(s):
    rows = s.df.orderBy(s.key, s.t).select(s.key, *s.dims).collect()
    keys = sorted({r[0] for r in rows})
    return np.array([[[r[d + 1] for r in rows if r[0] == k] for d in range(len(s.dims))] for k in keys], dtype=float)


def packed_rows(spark, cube, labels=None):
    rows = [(i, int(labels[i]) if labels is not None else 0, [list(map(float, d)) for d in x]) for i, x in enumerate(cube)]
    return spark.createDataFrame(rows, "series_id long, label int, x array<array<double>>")
