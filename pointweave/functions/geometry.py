"""Scalar geometry as column expressions: grid keys, rotations, projections, rays. All run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY_BITS, KEY_OFFSET = 21, 1 << 20
KEY_MASK = (1 << KEY_BITS) - 1


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cell(v: Column | str, size: float) -> Column:
    """floor(v / size) as a long, also below zero."""
    return F.floor(col(v) / F.lit(float(size))).cast("long")


def voxel_key(x: Column, y: Column, z: Column, size: float) -> Column:
    """Three 21-bit cell numbers packed x, y, z into one non-negative long; cells beyond 2**20 wrap."""
    a, b, c = ((cell(v, size) + F.lit(KEY_OFFSET)).bitwiseAND(F.lit(KEY_MASK).cast("long")) for v in (x, y, z))
    return F.shiftleft(a, 2 * KEY_BITS).bitwiseOR(F.shiftleft(b, KEY_BITS)).bitwiseOR(c)


def checked_voxel_key(x: Column, y: Column, z: Column, size: float) -> Column:
    """voxel_key() that fails the query for a cell outside its range."""
    fits = [cell(v, size).between(-KEY_OFFSET, KEY_OFFSET - 1) for v in (x, y, z)]
    return F.when(fits[0] & fits[1] & fits[2], voxel_key(x, y, z, size)).otherwise(F.raise_error(F.lit("cell outside the key's range")).cast("long"))


def decode_key(key: Column | str) -> tuple[Column, Column, Column]:
    """The three cell numbers of a key."""
    mask = F.lit(KEY_MASK).cast("long")
    return tuple(F.shiftright(col(key), s).bitwiseAND(mask) - KEY_OFFSET for s in (2 * KEY_BITS, KEY_BITS, 0))


def neighbour_key(key: Column | str, dx: Column, dy: Column, dz: Column) -> Column:
    """The key of the cell at an offset from another."""
    x, y, z = decode_key(key)
    mask = F.lit(KEY_MASK).cast("long")
    a, b, c = ((v + d + KEY_OFFSET).bitwiseAND(mask) for v, d in ((x, dx), (y, dy), (z, dz)))
    return F.shiftleft(a, 2 * KEY_BITS).bitwiseOR(F.shiftleft(b, KEY_BITS)).bitwiseOR(c)


def tile_and_local(gx: Column, gy: Column, gz: Column, side: int, classes: int, label: Column) -> tuple[Column, Column, Column, Column]:
    """Tile of ``side`` cells each way that holds a cell, and the code of the cell within it with a label."""
    tiles = tuple(F.floor(g / F.lit(side)).cast("long") for g in (gx, gy, gz))
    local = [g - t * side for g, t in zip((gx, gy, gz), tiles, strict=True)]
    code = ((local[0] * side + local[1]) * side + local[2]) * classes + label
    return (*tiles, code.cast("long"))


def bev_tile(x: Column, y: Column, size: float) -> Column:
    return cell(x, size) * 100_000 + cell(y, size)


def quaternion_matrix(qx: Column, qy: Column, qz: Column, qw: Column) -> list[Column]:
    """The nine entries, row by row, of the rotation of a unit quaternion."""
    return [
        1 - 2 * (qy * qy + qz * qz), 2 * (qx * qy - qz * qw), 2 * (qx * qz + qy * qw),
        2 * (qx * qy + qz * qw), 1 - 2 * (qx * qx + qz * qz), 2 * (qy * qz - qx * qw),
        2 * (qx * qz - qy * qw), 2 * (qy * qz + qx * qw), 1 - 2 * (qx * qx + qy * qy),
    ]


def euler_quaternion(roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """x, y, z, w of a rotation about z, then y, then x."""
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(a / 2), F.sin(a / 2)) for a in (roll, pitch, yaw))
    return [sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy]


def slerp(a: list[Column], b: list[Column], t: Column) -> list[Column]:
    """Spherical interpolation of unit quaternions the short way; linear and normalised where they nearly agree."""
    raw = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    sign = F.when(raw < 0, -1.0).otherwise(1.0)
    dot = F.least(F.abs(raw), F.lit(1.0))
    angle = F.acos(dot)
    near = F.sin(angle) < 1e-7
    wa = F.when(near, 1 - t).otherwise(F.sin((1 - t) * angle) / F.sin(angle))
    wb = F.when(near, t).otherwise(F.sin(t * angle) / F.sin(angle)) * sign
    mixed = [wa * p + wb * q for p, q in zip(a, b, strict=True)]
    norm = F.sqrt(mixed[0] * mixed[0] + mixed[1] * mixed[1] + mixed[2] * mixed[2] + mixed[3] * mixed[3])
    return [m / norm for m in mixed]


def rotation_exp(wx: Column, wy: Column, wz: Column) -> list[Column]:
    """Rotation matrix of a rotation vector; second order where the angle is tiny."""
    angle2 = wx * wx + wy * wy + wz * wz
    angle = F.sqrt(angle2)
    tiny = angle < 1e-8
    a = F.when(tiny, 1 - angle2 / 6).otherwise(F.sin(angle) / angle)
    b = F.when(tiny, 0.5 - angle2 / 24).otherwise((1 - F.cos(angle)) / angle2)
    return [
        1 - b * (wy * wy + wz * wz), b * wx * wy - a * wz, b * wx * wz + a * wy,
        b * wx * wy + a * wz, 1 - b * (wx * wx + wz * wz), b * wy * wz - a * wx,
        b * wx * wz - a * wy, b * wy * wz + a * wx, 1 - b * (wx * wx + wy * wy),
    ]


def rotation_log(r: list[Column]) -> list[Column]:
    """Rotation vector of a rotation matrix of less than half a turn."""
    angle = F.acos(F.least(F.greatest((r[0] + r[4] + r[8] - 1) / 2, F.lit(-1.0)), F.lit(1.0)))
    k = F.when(angle < 1e-8, F.lit(0.5)).otherwise(angle / (2 * F.sin(angle)))
    return [k * (r[7] - r[5]), k * (r[2] - r[6]), k * (r[3] - r[1])]


def rotation_angle(a: list[Column], b: list[Column]) -> Column:
    """Angle between two rotations."""
    trace = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        trace = trace + x * y
    return F.acos(F.least(F.greatest((trace - 1) / 2, F.lit(-1.0)), F.lit(1.0)))


def transform(r: list[Column], t: list[Column], p: list[Column]) -> list[Column]:
    """r p + t."""
    return [r[3 * k] * p[0] + r[3 * k + 1] * p[1] + r[3 * k + 2] * p[2] + t[k] for k in range(3)]


def inverse(r: list[Column], t: list[Column]) -> tuple[list[Column], list[Column]]:
    rt = [r[0], r[3], r[6], r[1], r[4], r[7], r[2], r[5], r[8]]
    return rt, [-(rt[3 * k] * t[0] + rt[3 * k + 1] * t[1] + rt[3 * k + 2] * t[2]) for k in range(3)]


def compose(a: tuple[list[Column], list[Column]], b: tuple[list[Column], list[Column]]) -> tuple[list[Column], list[Column]]:
    """The transform that applies b, then a."""
    (ra, ta), (rb, tb) = a, b
    r = [ra[3 * i] * rb[j] + ra[3 * i + 1] * rb[3 + j] + ra[3 * i + 2] * rb[6 + j] for i in range(3) for j in range(3)]
    return r, transform(ra, ta, tb)


def pinhole(x: Column, y: Column, z: Column, fx: float, fy: float, cx: float, cy: float, width: int, height: int, least_depth: float) -> dict[str, Column]:
    """u, v (null behind the depth gate) and inside, whose image bounds include the last pixel."""
    front = z > least_depth
    u, v = F.when(front, fx * x / z + cx), F.when(front, fy * y / z + cy)
    inside = F.coalesce(u.between(0, width - 1) & v.between(0, height - 1), F.lit(False))
    return {"u": u, "v": v, "inside": inside}


def distorted(x: Column, y: Column, k1: float, k2: float, p1: float, p2: float) -> tuple[Column, Column]:
    """Plumb-bob distortion of normalised image coordinates."""
    r2 = x * x + y * y
    radial = 1 + k1 * r2 + k2 * r2 * r2
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y


def scaled_pixel(u: Column, scale: float, size: int) -> Column:
    """Pixel of a rescaled label map, half to even, clipped."""
    return F.least(F.greatest(F.rint((u + 0.5) * scale - 0.5), F.lit(0.0)), F.lit(size - 1.0)).cast("int")


def ray_bin(x: Column, y: Column, z: Column, azimuths: int, elevations: int) -> Column:
    """Azimuth bin * elevations + elevation bin; equal angles of arcsine elevation; null at the origin."""
    pi = 3.141592653589793
    r = F.sqrt(x * x + y * y + z * z)
    a = F.floor((F.atan2(y, x) + pi) / (2 * pi) * azimuths)
    e = F.floor((F.asin(z / r) + pi / 2) / pi * elevations)
    return F.when(r > 0, F.pmod(a, F.lit(azimuths)) * elevations + F.least(e, F.lit(elevations - 1))).cast("long")


def range_cell(x: Column, y: Column, z: Column, columns: int, rows: int, low: float, high: float) -> tuple[Column, Column]:
    """(column, row) of a range image whose rows are even in the sine of elevation, clipped to guard rows."""
    pi = 3.141592653589793
    r = F.sqrt(x * x + y * y + z * z)
    column = F.pmod(((F.atan2(y, x) + pi) / (2 * pi) * columns).cast("long"), F.lit(columns))
    row = ((z / r - low) / (high - low) * rows).cast("long")
    return column, F.least(F.greatest(row, F.lit(-1)), F.lit(rows))


def ring_sector(x: Column, y: Column, rings: int, sectors: int, radius: float) -> tuple[Column, Column]:
    """Polar cell of a scan descriptor, from 0."""
    pi = 3.141592653589793
    r = F.sqrt(x * x + y * y)
    clip = lambda v, n: F.least(F.greatest(v - 1, F.lit(0)), F.lit(n - 1)).cast("int")
    return clip(F.ceil(r / radius * rings), rings), clip(F.ceil((F.atan2(y, x) + pi) / (2 * pi) * sectors), sectors)


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def morton(x: Column, y: Column, z: Column, bits: int = 10) -> Column:
    """Bits of three non-negative numbers interleaved, x highest: a clustering key."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        for j, v in enumerate((z, y, x)):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(v.cast("long"), k).bitwiseAND(F.lit(1).cast("long")), 3 * k + j))
    return out


def age_weight(weight: Column, age: Column, scale: float) -> Column:
    return weight * F.exp(-age / scale)


def range_weight(r: Column, scale: float) -> Column:
    return 1 / (1 + (r / scale) * (r / scale))


def hilbert(x: Column, y: Column, z: Column, bits: int = 6) -> Column:
    """Place of a cell on a 3-D Hilbert curve: a clustering key that keeps neighbours together better than Morton's.

    The coordinates are turned into the transposed index bit by bit, from the highest, then Gray-decoded. Steps are
    unrolled expressions; each bit's result is bound once, so the tree stays linear in the bits.
    """

    def bind(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    one = F.lit(1).cast("long")

    def turn(state: Column, bit: int) -> Column:
        mask = F.lit((1 << bit) - 1).cast("long")
        axes = [state["a"], state["b"], state["c"]]
        for k in range(3):
            on = F.shiftright(axes[k], bit).bitwiseAND(one) == 1
            swap = axes[0].bitwiseXOR(axes[k]).bitwiseAND(mask)
            first = F.when(on, axes[0].bitwiseXOR(mask)).otherwise(axes[0].bitwiseXOR(swap))
            own = F.when(on, axes[k]).otherwise(axes[k].bitwiseXOR(swap))
            if k == 0:
                axes[0] = F.when(on, axes[0].bitwiseXOR(mask)).otherwise(axes[0])
            else:
                axes[0], axes[k] = first, own
        return F.struct(axes[0].alias("a"), axes[1].alias("b"), axes[2].alias("c"))

    def finished(state: Column) -> Column:
        a = state["a"]
        b = state["b"].bitwiseXOR(a)
        c = state["c"].bitwiseXOR(b)
        flip = F.lit(0).cast("long")
        for bit in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(F.shiftright(c, bit).bitwiseAND(one) == 1, F.lit((1 << bit) - 1).cast("long")).otherwise(F.lit(0).cast("long")))
        out = F.lit(0).cast("long")
        for bit in range(bits - 1, -1, -1):
            for v in (a, b, c):
                out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(v.bitwiseXOR(flip), bit).bitwiseAND(one))
        return out

    def step(state: Column, bit: int) -> Column:
        return finished(state) if bit == 0 else bind(turn(state, bit), lambda s: step(s, bit - 1))

    return bind(F.struct(x.cast("long").alias("a"), y.cast("long").alias("b"), z.cast("long").alias("c")), lambda s: step(s, bits - 1))
