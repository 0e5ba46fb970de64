"""Small SQL builders shared by the check queries."""

from __future__ import annotations


def d(value: float) -> str:
    """A DOUBLE literal (bare decimals would be exact decimals)."""
    return f"CAST({value!r} AS DOUBLE)"


def out(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + {d(0.0)})"


def d2(a: str, b: str) -> str:
    return "(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in ("x", "y", "z")) + ")"


def snap(value: str, bits: int) -> str:
    step = d(2.0 / (2**bits - 1))
    return f"(round_even((greatest(least({value}, {d(1.0)}), {d(-1.0)}) - {d(-1.0)}) / {step}, 0) * {step} + {d(-1.0)})"


def index(value: str, bits: int) -> str:
    return f"CAST(round_even(({value} + {d(1.0)}) * {d(0.5)} * {d(float(2**bits - 1))}, 0) AS INTEGER)"


def hash_text(*parts: str) -> str:
    """Parts are SQL expressions of type VARCHAR."""
    return "sha256(" + " || ':' || ".join(parts) + ")"


def hash_int(*parts: str) -> str:
    return f"('0x' || substr({hash_text(*parts)}, 1, 15))::BIGINT"


def hash_uniform(*parts: str) -> str:
    return f"((({hash_int(*parts)} >> 8) + {d(0.5)}) / {d(4503599627370496.0)})"


def s(column: str) -> str:
    return f"CAST({column} AS VARCHAR)"


def random_subset(source: str, size: int, *seed: str, keep: str = "x, y, z") -> str:
    """Rows ``cloud_id, point_id, slot`` plus coordinates of a hash-ranked subset."""
    key = hash_text(*[f"'{p}'" for p in seed], "cloud_id", s("point_id"))
    return (
        f"SELECT cloud_id, point_id, {keep}, CAST(rk - 1 AS INTEGER) AS slot FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY cloud_id ORDER BY {key}, point_id) AS rk FROM {source}) WHERE rk <= {size}"
    )


def farthest(source: str, size: int, name: str = "fps", *, start: str | None = None, weight: str | None = None) -> str:
    """Chained CTEs picking ``size`` farthest points; the last CTE is ``name``."""
    if start is None:
        begin = (
            f"SELECT p.*, (p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy) + (p.z - c.cz) * (p.z - c.cz) AS pr "
            f"FROM {source} p JOIN (SELECT cloud_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM {source} GROUP BY cloud_id) c USING (cloud_id)"
        )
    else:
        begin = f"SELECT p.*, {start} AS pr FROM {source} p"
    pick = "SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY pr DESC, point_id) = 1"
    parts = [
        f"{name}_m0 AS MATERIALIZED ({begin})",
        f"{name}_a0 AS MATERIALIZED ({pick.format(t=name + '_m0')})",
    ]
    for i in range(1, size):
        near = d2("p", "a") if i == 1 else f"least(p.near, {d2('p', 'a')})"
        kept = "p.* EXCLUDE (pr)" if i == 1 else "p.* EXCLUDE (pr, near)"
        scaled = f"n.near * ({weight})" if weight else "n.near"
        parts += [
            f"{name}_m{i} AS MATERIALIZED (SELECT n.*, {scaled} AS pr FROM (SELECT {kept}, {near} AS near FROM {name}_m{i - 1} p JOIN {name}_a{i - 1} a USING (cloud_id)) n)",
            f"{name}_a{i} AS MATERIALIZED ({pick.format(t=f'{name}_m{i}')})",
        ]
    union = " UNION ALL ".join(
        f"SELECT cloud_id, CAST({i} AS INTEGER) AS slot, point_id, x, y, z FROM {name}_a{i}" for i in range(size)
    )
    parts.append(f"{name} AS MATERIALIZED ({union})")
    return ",\n".join(parts)


def snapped(source: str, bits: int) -> str:
    """All columns with x, y, z on the lattice."""
    return f"SELECT * REPLACE ({', '.join(f'{snap(a, bits)} AS {a}' for a in ('x', 'y', 'z'))}) FROM {source}"


def set_chamfer(points: str, anchors: str, keys: str = "cloud_id") -> str:
    """``keys, surface, coverage, far`` of anchor sets against their clouds."""
    extra = [k.strip() for k in keys.split(",") if k.strip() != "cloud_id"]
    also = "".join(f", a.{k}" for k in extra)
    pair = f"SELECT p.cloud_id{also}, p.point_id, a.slot, {d2('p', 'a')} AS dd FROM {points} p JOIN {anchors} a USING (cloud_id)"
    return f"""SELECT {keys}, surface, coverage, greatest(far_a, far_p) AS far, {d(0.5)} * (surface + coverage) AS mse FROM
      (SELECT {keys}, avg(m) AS surface, max(m) AS far_a FROM (SELECT {keys}, slot, min(dd) AS m FROM ({pair}) GROUP BY {keys}, slot) GROUP BY {keys})
      JOIN (SELECT {keys}, avg(m) AS coverage, max(m) AS far_p FROM (SELECT {keys}, point_id, min(dd) AS m FROM ({pair}) GROUP BY {keys}, point_id) GROUP BY {keys}) USING ({keys})"""


def draws(source: str, keep: str, count: str, bound: str, *stream: str) -> str:
    """Rows ``keep, u``: ``count`` draws from 0 .. bound - 1 for each row, four from a digest of the stream's name and block."""
    return (
        f"SELECT {keep}, ('0x' || substr(digest, 16 * quarter + 1, 15))::BIGINT % bound AS u FROM (SELECT *, unnest(range(least(4, many - 4 * blk))) AS quarter FROM "
        f"(SELECT *, {hash_text(*stream, s('blk'))} AS digest FROM (SELECT *, {count} AS many, {bound} AS bound, unnest(range(({count} + 3) // 4)) AS blk FROM {source})))"
    )


def slice_draws(source: str, keys: str, count: str, size: str, group: str, *stream: str, width: int = 1024) -> str:
    """Chained draws of members by slices and inside them: rows ``keys, r, member, m``."""
    r = s("r")
    small = f"SELECT {keys}, r, {group} AS grp, 0 AS part, {count} AS k, {size} AS size FROM {source} WHERE {size} <= {width}"
    large = (f"SELECT {keys}, r, grp, u // {width} AS part, count(*) AS k, size FROM "
             f"({draws(f'(SELECT {keys}, r, {group} AS grp, {count} AS k, {size} AS size FROM {source} WHERE {size} > {width})', f'{keys}, r, grp, size', 'k', 'size', *stream, chr(39) + 'slice' + chr(39), s('grp'), r)}) "
             f"GROUP BY {keys}, r, grp, u // {width}, size")
    inner = draws(f"({small} UNION ALL {large})", f"{keys}, r, grp, part", "k", f"least({width}, size - {width} * part)", *stream, "'inside'", s("grp"), s("part"), r)
    return f"SELECT {keys}, r, grp, part * {width} + u AS member, count(*) AS m FROM ({inner}) GROUP BY {keys}, r, grp, part, u"
