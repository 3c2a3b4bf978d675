"""Pose algebra as column expressions.

Quaternions are wxyz and poses camera-to-world, axes right-down-forward, metres and seconds. A
vector here is a list of columns, so everything stays inside generated code; ``elements`` takes an
array column apart and ``F.array(*v)`` puts one together. A 3x3 matrix is a list of 9, row by row.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list[Column]

#: Parameter names of each camera model.
CAMERA_MODELS = {
    "SIMPLE_PINHOLE": ("f", "cx", "cy"),
    "PINHOLE": ("fx", "fy", "cx", "cy"),
    "SIMPLE_RADIAL": ("f", "cx", "cy", "k"),
    "RADIAL": ("f", "cx", "cy", "k1", "k2"),
    "OPENCV": ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2"),
    "OPENCV_FISHEYE": ("fx", "fy", "cx", "cy", "k1", "k2", "k3", "k4"),
}
#: Above this cosine an arc is short enough for linear interpolation.
NEAR_PARALLEL = 0.9995


def elements(array: Column, n: int) -> Vector:
    return [array[k] for k in range(n)]


def dot(a: Vector, b: Vector) -> Column:
    return reduce(add, [x * y for x, y in zip(a, b, strict=True)])


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Vector, k: Column) -> Vector:
    return [x * k for x in a]


def unit(a: Vector) -> Vector:
    """a over its length; null for a zero vector."""
    return [F.try_divide(x, norm(a)) for x in a]


def quat_to_matrix(q: Vector) -> Vector:
    """Rotation matrix of a quaternion of any non-zero length; null for zero."""
    w, x, y, z = unit(q)
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def matrix_to_quat(m: Vector) -> Vector:
    """Unit quaternion of a rotation matrix, w >= 0.

    Of the four ways to read it off the matrix, the one with the largest divisor: w if the trace is
    positive, else the axis of the largest diagonal element (the first of equals).
    """
    xx, xy, xz, yx, yy, yz, zx, zy, zz = m
    by_w = [1 + xx + yy + zz, zy - yz, xz - zx, yx - xy]
    by_x = [zy - yz, 1 + xx - yy - zz, xy + yx, xz + zx]
    by_y = [xz - zx, xy + yx, 1 - xx + yy - zz, yz + zy]
    by_z = [yx - xy, xz + zx, yz + zy, 1 - xx - yy + zz]
    facing = lambda q: scaled(unit(q), F.when(q[0] < 0, -1.0).otherwise(1.0))
    return [
        F.when(xx + yy + zz > 0, a).when((xx >= yy) & (xx >= zz), b).when(yy >= zz, c).otherwise(d)
        for a, b, c, d in zip(unit(by_w), facing(by_x), facing(by_y), facing(by_z), strict=True)
    ]


def rotated(m: Vector, v: Vector) -> Vector:
    return [dot(m[3 * r : 3 * r + 3], v) for r in range(3)]


def transposed(m: Vector) -> Vector:
    return [m[3 * c + r] for r in range(3) for c in range(3)]


def product(a: Vector, b: Vector) -> Vector:
    return [dot(a[3 * r : 3 * r + 3], [b[c], b[3 + c], b[6 + c]]) for r in range(3) for c in range(3)]


def compose(a: tuple[Vector, Vector], b: tuple[Vector, Vector]) -> tuple[Vector, Vector]:
    """First b, then a; poses are (matrix, translation)."""
    return product(a[0], b[0]), [x + y for x, y in zip(rotated(a[0], b[1]), a[1], strict=True)]


def inverse(pose: tuple[Vector, Vector]) -> tuple[Vector, Vector]:
    back = transposed(pose[0])
    return back, [-x for x in rotated(back, pose[1])]


def pose(q: Vector, tr: Vector) -> tuple[Vector, Vector]:
    return quat_to_matrix(q), tr


def flip_gl_cv(m: Vector) -> Vector:
    """Between up-backward and down-forward camera axes: the second and third columns change sign."""
    return [x if k % 3 == 0 else -x for k, x in enumerate(m)]


def wxyz_from_xyzw(q: Vector) -> Vector:
    return [q[3], q[0], q[1], q[2]]


def xyzw_from_wxyz(q: Vector) -> Vector:
    return [q[1], q[2], q[3], q[0]]


def lerp(a: Vector, b: Vector, u: Column) -> Vector:
    return [x + u * (y - x) for x, y in zip(a, b, strict=True)]


def slerp(a: Vector, b: Vector, u: Column) -> Vector:
    """Shortest-arc interpolation, linear (and normalised) for almost equal rotations."""
    lengths = F.sqrt(dot(a, a) * dot(b, b))
    signed = dot(a, b) / lengths
    cosine = F.least(F.lit(1.0), F.abs(signed))
    angle = F.acos(cosine)
    # the length of the straight mean of two unit vectors follows from their cosine
    straight = F.sqrt((1 - u) * (1 - u) + u * u + 2 * u * (1 - u) * cosine)
    near = cosine > NEAR_PARALLEL
    keep = F.when(near, (1 - u) / straight).otherwise(F.try_divide(F.sin((1 - u) * angle), F.sin(angle))) / norm(a)
    move = F.when(near, u / straight).otherwise(F.try_divide(F.sin(u * angle), F.sin(angle))) / norm(b) * F.when(signed < 0, -1.0).otherwise(1.0)
    return [x * keep + y * move for x, y in zip(a, b, strict=True)]


def rotation_error_degrees(a: Vector, b: Vector) -> Column:
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(dot(unit(a), unit(b))))))


def look_at(eye: Vector, target: Vector, up: Vector) -> tuple[Vector, Vector]:
    """Camera-to-world pose at eye whose forward axis points to target."""
    forward = unit([t - e for t, e in zip(target, eye, strict=True)])
    right = unit(cross(forward, up))
    down = cross(forward, right)
    return [x for row in zip(right, down, forward, strict=True) for x in row], eye


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def intrinsics(model: Column, params: Column) -> Vector:
    """fx, fy, cx, cy of any camera model; null for an unknown one."""
    one_focal = model.isin(*[k for k, v in CAMERA_MODELS.items() if v[0] == "f"])
    two_focal = model.isin(*[k for k, v in CAMERA_MODELS.items() if v[0] == "fx"])
    at = lambda one, two: F.when(one_focal, F.get(params, F.lit(one))).when(two_focal, F.get(params, F.lit(two)))
    return [at(0, 0), at(0, 1), at(1, 2), at(2, 3)]


def scaled_intrinsics(k: Vector, width: Column, height: Column, to_width: Column, to_height: Column) -> Vector:
    """Intrinsics for the same view at another resolution."""
    sx, sy = to_width / width, to_height / height
    return [k[0] * sx, k[1] * sy, k[2] * sx, k[3] * sy]


def unproject(u: Column, v: Column, depth: Column, k: Vector, to_world: tuple[Vector, Vector]) -> Vector:
    """World point of a pixel at a depth."""
    fx, fy, cx, cy = k
    ray = [(u - cx) / fx * depth, (v - cy) / fy * depth, depth]
    return [x + t for x, t in zip(rotated(to_world[0], ray), to_world[1], strict=True)]


def distortion(model: Column, params: Column) -> Column:
    """(name, coefficients) of a camera's distortion as robotics middleware states it."""
    tail = F.slice(params, 5, 4)
    radial = lambda *k: F.array(*[F.get(params, F.lit(i)) if i is not None else F.lit(0.0) for i in k])
    return (
        F.when(model == "OPENCV", F.struct(F.lit("plumb_bob").alias("name"), F.concat(tail, F.array(F.lit(0.0))).alias("d")))
        .when(model == "OPENCV_FISHEYE", F.struct(F.lit("equidistant").alias("name"), tail.alias("d")))
        .when(model == "SIMPLE_RADIAL", F.struct(F.lit("plumb_bob").alias("name"), radial(3, None, None, None, None).alias("d")))
        .when(model == "RADIAL", F.struct(F.lit("plumb_bob").alias("name"), radial(3, 4, None, None, None).alias("d")))
        .otherwise(F.struct(F.lit("plumb_bob").alias("name"), F.array_repeat(F.lit(0.0), 5).alias("d")))
    )
