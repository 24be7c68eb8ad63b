"""Value types without a column type of their own: uuid, network addresses, product numbers, segments, cubes, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- uuid

#: The namespaces of name-based identifiers.
NAMESPACES = {"dns": "6ba7b8109dad11d180b400c04fd430c8", "url": "6ba7b8119dad11d180b400c04fd430c8", "oid": "6ba7b8129dad11d180b400c04fd430c8", "x500": "6ba7b8149dad11d180b400c04fd430c8"}


def _uuid(digest: Column, version: int) -> Column:
    """32 hexadecimal digits with version and variant put in."""
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit(str(version)), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def uuid_v3(namespace: str, name: Column) -> Column:
    return _uuid(F.md5(F.concat(F.unhex(F.lit(NAMESPACES[namespace])), F.encode(name, "UTF-8"))), 3)


def uuid_v5(namespace: str, name: Column) -> Column:
    return _uuid(F.substring(F.sha1(F.concat(F.unhex(F.lit(NAMESPACES[namespace])), F.encode(name, "UTF-8"))), 1, 32), 5)


# ---- addresses (IPv4, with an optional prefix length)


def address(inet: Column) -> Column:
    """The number of an address; null if it isn't one."""
    parts = F.split(F.split(inet, "/")[0], r"\.")
    number = F.aggregate(F.transform(parts, lambda p: p.cast("long")), F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    valid = inet.rlike(r"^\d{1,3}(\.\d{1,3}){3}(/\d{1,2})?$") & F.forall(parts, lambda p: p.cast("int") <= 255) & (masklen(inet) <= 32)
    return F.when(valid, number)


def masklen(inet: Column) -> Column:
    return F.coalesce(F.get(F.split(inet, "/"), F.lit(1)).cast("int"), F.lit(32))


def dotted(number: Column) -> Column:
    return F.concat_ws(".", *[F.pmod(F.floor(number / (1 << s)), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def host(inet: Column) -> Column:
    return F.split(inet, "/")[0]


def _size(inet: Column) -> Column:
    return F.expr("1L") * F.pow(F.lit(2), F.lit(32) - masklen(inet)).cast("long")


def network(inet: Column) -> Column:
    n = address(inet)
    return F.concat(dotted(n - F.pmod(n, _size(inet))), F.lit("/"), masklen(inet))


def broadcast(inet: Column) -> Column:
    n = address(inet)
    return F.concat(dotted(n - F.pmod(n, _size(inet)) + _size(inet) - 1), F.lit("/"), masklen(inet))


def netmask(inet: Column) -> Column:
    return dotted(F.lit(1 << 32) - _size(inet))


def contained(a: Column, b: Column) -> Column:
    """a << b: a's net lies in b's and is smaller."""
    n = address(a)
    return (masklen(a) > masklen(b)) & (n - F.pmod(n, _size(b)) == address(b) - F.pmod(address(b), _size(b)))


# ---- product numbers


def _digits(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)).cast("int"))


def ean13_check(twelve: Column) -> Column:
    """The check digit of twelve digits."""
    total = F.aggregate(F.transform(_digits(twelve), lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 3)), F.lit(0), lambda a, x: a + x)
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))


def is_ean13(s: Column) -> Column:
    d = F.regexp_replace(s, "[ -]", "")
    return F.when(d.rlike("^[0-9]{13}$"), ean13_check(F.substring(d, 1, 12)) == F.substring(d, 13, 1).cast("int")).otherwise(F.lit(False))


def isbn10(thirteen: Column) -> Column:
    """The ten-digit form of a 978 number."""
    nine = F.substring(thirteen, 4, 9)
    total = F.aggregate(F.transform(_digits(nine), lambda d, i: d * (F.lit(10) - i)), F.lit(0), lambda a, x: a + x)
    check = F.pmod(F.lit(11) - F.pmod(total, F.lit(11)), F.lit(11))
    return F.concat(nine, F.when(check == 10, "X").otherwise(check.cast("string")))


# ---- segments: struct(lo, hi)


def seg(lo: Column, hi: Column) -> Column:
    return F.struct(F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi"))


def seg_union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"))


def seg_inter(a: Column, b: Column) -> Column:
    """Null where they don't meet."""
    return F.when(seg_overlap(a, b), F.struct(F.greatest(a["lo"], b["lo"]).alias("lo"), F.least(a["hi"], b["hi"]).alias("hi")))


def seg_overlap(a: Column, b: Column) -> Column:
    return (a["lo"] <= b["hi"]) & (b["lo"] <= a["hi"])


def seg_contains(a: Column, b: Column) -> Column:
    return (a["lo"] <= b["lo"]) & (b["hi"] <= a["hi"])


# ---- cubes: struct(lo array, hi array) of one dimension


def cube_union(a: Column, b: Column) -> Column:
    return F.struct(F.zip_with(a["lo"], b["lo"], lambda x, y: F.least(x, y)).alias("lo"), F.zip_with(a["hi"], b["hi"], lambda x, y: F.greatest(x, y)).alias("hi"))


def cube_inter(a: Column, b: Column) -> Column:
    """Null where they don't meet."""
    return F.when(cube_overlap(a, b), F.struct(F.zip_with(a["lo"], b["lo"], lambda x, y: F.greatest(x, y)).alias("lo"), F.zip_with(a["hi"], b["hi"], lambda x, y: F.least(x, y)).alias("hi")))


def cube_overlap(a: Column, b: Column) -> Column:
    below = lambda x, y: F.forall(F.zip_with(x, y, lambda p, q: p <= q), lambda t: t)
    return below(a["lo"], b["hi"]) & below(b["lo"], a["hi"])


def cube_contains(a: Column, b: Column) -> Column:
    below = lambda x, y: F.forall(F.zip_with(x, y, lambda p, q: p <= q), lambda t: t)
    return below(a["lo"], b["lo"]) & below(b["hi"], a["hi"])


def cube_size(a: Column) -> Column:
    return F.aggregate(F.zip_with(a["lo"], a["hi"], lambda p, q: q - p), F.lit(1.0), lambda s, x: s * x)


def cube_distance(a: Column, b: Column) -> Column:
    """Between the nearest points of both."""
    gap = F.zip_with(F.zip_with(a["lo"], b["hi"], lambda p, q: p - q), F.zip_with(b["lo"], a["hi"], lambda p, q: p - q), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x))


# ---- the earth as a sphere

EARTH = 6378168.0


def ll_to_earth(lat: Column, lon: Column) -> Column:
    return F.struct((F.lit(EARTH) * F.cos(F.radians(lat)) * F.cos(F.radians(lon))).alias("x"), (F.lit(EARTH) * F.cos(F.radians(lat)) * F.sin(F.radians(lon))).alias("y"), (F.lit(EARTH) * F.sin(F.radians(lat))).alias("z"))


def earth_distance(a: Column, b: Column) -> Column:
    """The great circle's arc over the chord between two points on the surface."""
    chord = F.sqrt(sum(((a[c] - b[c]) ** 2 for c in "yz"), (a["x"] - b["x"]) ** 2))
    return F.lit(2 * EARTH) * F.asin(F.least(chord / (2 * EARTH), F.lit(1.0)))


def in_earth_box(point: Column, centre: Column, radius: float) -> Column:
    """Within the box around a circle: a cheap filter before the distance itself."""
    return (F.abs(point["x"] - centre["x"]) <= radius) & (F.abs(point["y"] - centre["y"]) <= radius) & (F.abs(point["z"] - centre["z"]) <= radius)


# ---- plane shapes: polygons are arrays of struct(x, y), circles struct(x, y, r)


def polygon_area(points: Column) -> Column:
    """By the trapezoids below its edges."""
    n = F.size(points)
    edge = lambda p, i: F.get(points, F.pmod(i + 1, n))
    terms = F.transform(points, lambda p, i: p["x"] * edge(p, i)["y"] - edge(p, i)["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)) / 2


def polygon_center(points: Column) -> Column:
    """The mean of its corners."""
    mean = lambda c: F.aggregate(F.transform(points, lambda p: p[c]), F.lit(0.0), lambda a, x: a + x) / F.size(points)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def polygon_contains(points: Column, x: Column, y: Column) -> Column:
    """Whether a ray to the right of the point crosses its edges an odd number of times."""
    n = F.size(points)
    edge = lambda i: F.get(points, F.pmod(i + 1, n))
    crossing = F.transform(points, lambda p, i: ((p["y"] > y) != (edge(i)["y"] > y)) & (x < p["x"] + (edge(i)["x"] - p["x"]) * (y - p["y"]) / F.nullif(edge(i)["y"] - p["y"], F.lit(0.0))))
    return F.pmod(F.size(F.filter(crossing, lambda t: t)), F.lit(2)) == 1


def circles_overlap(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"]) <= a["r"] + b["r"]
