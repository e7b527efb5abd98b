"""Rotations, poses and rounding as Column expressions (quaternions x, y, z, w; poses as structs x, y, z, qx, qy, qz, qw)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

POSE = ("x", "y", "z", "qx", "qy", "qz", "qw")
Vec = tuple[Column, Column, Column]
Quat = tuple[Column, Column, Column, Column]


def position(p: Column) -> Vec:
    return p["x"], p["y"], p["z"]


def quaternion(p: Column, normalise: bool = True) -> Quat:
    q = (p["qx"], p["qy"], p["qz"], p["qw"])
    if not normalise:
        return q
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return tuple(x / n for x in q)


def rotate(q: Quat, v: Vec) -> Vec:
    """v + 2 w (u x v) + 2 u x (u x v)."""
    x, y, z, w = q
    t = (2 * (y * v[2] - z * v[1]), 2 * (z * v[0] - x * v[2]), 2 * (x * v[1] - y * v[0]))
    return (v[0] + w * t[0] + y * t[2] - z * t[1], v[1] + w * t[1] + z * t[0] - x * t[2], v[2] + w * t[2] + x * t[1] - y * t[0])


def conjugate(q: Quat) -> Quat:
    return -q[0], -q[1], -q[2], q[3]


def multiply(a: Quat, b: Quat) -> Quat:
    return (
        a[3] * b[0] + a[0] * b[3] + a[1] * b[2] - a[2] * b[1],
        a[3] * b[1] - a[0] * b[2] + a[1] * b[3] + a[2] * b[0],
        a[3] * b[2] + a[0] * b[1] - a[1] * b[0] + a[2] * b[3],
        a[3] * b[3] - a[0] * b[0] - a[1] * b[1] - a[2] * b[2],
    )


def pose(t: Vec, q: Quat) -> Column:
    return F.struct(*(c.alias(n) for n, c in zip(POSE, (*t, *q))))


def compose(a: Column, b: Column) -> Column:
    """a after b: the pose of b's frame in the frame that a is given in."""
    q = quaternion(a)
    r = rotate(q, position(b))
    return pose(tuple(u + v for u, v in zip(position(a), r)), multiply(q, quaternion(b)))


def inverse(a: Column) -> Column:
    q = conjugate(quaternion(a))
    return pose(tuple(-c for c in rotate(q, position(a))), q)


def relative(a: Column, b: Column) -> Column:
    """inverse(a) o b."""
    q = conjugate(quaternion(a))
    d = tuple(v - u for u, v in zip(position(a), position(b)))
    return pose(rotate(q, d), multiply(q, quaternion(b)))


def transform(p: Column, v: Vec) -> Vec:
    return tuple(a + b for a, b in zip(position(p), rotate(quaternion(p), v)))


def untransform(p: Column, v: Vec) -> Vec:
    return rotate(conjugate(quaternion(p)), tuple(a - b for a, b in zip(v, position(p))))


def euler_xyz(q: Quat) -> Vec:
    """roll, pitch, yaw of extrinsic rotations about x, y, z."""
    x, y, z, w = q
    roll = F.atan2(2 * (y * z + w * x), 1 - 2 * (x * x + y * y))
    pitch = -F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (x * z - w * y))))
    return roll, pitch, F.atan2(2 * (x * y + w * z), 1 - 2 * (y * y + z * z))


def from_euler_xyz(roll: Column, pitch: Column, yaw: Column) -> Quat:
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(a / 2), F.sin(a / 2)) for a in (roll, pitch, yaw))
    return sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy


def camera_pose(base: Column, extrinsic: Column, mean_z: Column | None = None) -> Column:
    """The camera's pose; with mean_z the base is level at that height (pitch 0). The camera's offset is added unrotated."""
    q, t = quaternion(base), position(base)
    if mean_z is not None:
        roll, _, yaw = euler_xyz(q)
        q, t = from_euler_xyz(roll, F.lit(0.0), yaw), (t[0], t[1], mean_z)
    return pose(tuple(a + b for a, b in zip(t, position(extrinsic))), multiply(q, quaternion(extrinsic)))


def to_base_frame(p: Column, extrinsic: Column, frame: Column, base: str) -> Column:
    """The base's pose from one that is given in frame: itself if that is the base, else followed by the extrinsic."""
    return F.when(frame == base, p).otherwise(compose(p, extrinsic))


def forward_offset(p: Column, dx: float) -> Column:
    return pose(transform(p, (F.lit(dx), F.lit(0.0), F.lit(0.0))), quaternion(p))


def half_even(c: Column) -> Column:
    return F.rint(c)


def grid_index(p: Column, start: Column, voxel: Column, n: Column) -> tuple[Column, Column]:
    """(normalised to -1..1, inside): h = (p - start) / voxel; inside is the open interval 0 < h < n."""
    h = (p - start) / voxel
    return (h - n / 2) / (n / 2), (h > 0) & (h < n)


def grid_place(u: Column, start: Column, voxel: Column, n: Column) -> Column:
    """The way back from grid_index's -1..1 to a place."""
    return (u * (n / 2) + n / 2) * voxel + start


def parse_list(text: Column) -> Column:
    """Numbers of a bracketed list, round or square."""
    return F.transform(F.split(F.trim(F.regexp_replace(text, r"[()\[\]]", " ")), r"[\s,]+"), lambda x: x.cast("double"))


def stem_number(path: Column) -> Column:
    """The integer name of a file, null if it has another."""
    return F.when(F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1).rlike(r"^\d+$"), F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1).cast("long"))
