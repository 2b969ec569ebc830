"""The same planes in plain SQL, each written from its definition by joins of a raster with itself."""

from __future__ import annotations

import math

from rasterloom.operators import axis, focus

N = 8
FRAME, PIXEL = ["stack", "frame"], ["stack"]


def mirrored(expression: str, n: int = N) -> str:
    if n == 1:
        return "0"
    period = 2 * (n - 1)
    turned = f"((({expression}) % {period} + {period}) % {period})"
    return f"least({turned}, {period} - {turned})"


def clamped(expression: str, n: int = N) -> str:
    return f"least(greatest({expression}, 0), {n - 1})"


def conv(plane: str, keys: list[str], value: str, out: dict[str, dict[tuple[int, int], float]], border=mirrored, h: int = N, w: int = N) -> str:
    offsets = sorted({o for k in out.values() for o in k})
    rows = ", ".join("({}, {}, {})".format(dy, dx, ", ".join(f"CAST({k.get((dy, dx), 0.0)!r} AS DOUBLE)" for k in out.values())) for dy, dx in offsets)
    names = ", ".join(f"k_{n}" for n in out)
    sums = ", ".join(f"sum(p.k_{n} * q.{value}) AS {n}" for n in out)
    on = " AND ".join(f"p.{k} = q.{k}" for k in keys)
    own = ", ".join(f"p.{k}" for k in keys)
    # each place with the places that it looks at comes first, so that the join is on all of the place
    looks = f"SELECT {own}, p.y, p.x, {', '.join(f'k_{n}' for n in out)}, {border('p.y + k.dy', h)} AS qy, {border('p.x + k.dx', w)} AS qx FROM {plane} p CROSS JOIN (VALUES {rows}) k(dy, dx, {names})"
    return f"SELECT {own}, p.y, p.x, {sums} FROM (WITH looks AS MATERIALIZED ({looks}) SELECT * FROM looks) p JOIN {plane} q ON {on} AND q.y = p.qy AND q.x = p.qx GROUP BY {own}, p.y, p.x"


def separable(plane: str, keys: list[str], value: str, out: str, kernel: dict[int, float], h: int = N, w: int = N) -> str:
    """First down the columns, then along the rows."""
    first = conv(plane, keys, value, {out: axis.outer(kernel, {0: 1.0})}, h=h, w=w)
    return f"WITH half_ AS MATERIALIZED ({first}) " + conv("half_", keys, out, {out: axis.outer({0: 1.0}, kernel)}, h=h, w=w)


def smooth(plane: str, keys: list[str], value: str, out: str, radius: int) -> str:
    return separable(plane, keys, value, out, axis.gaussian(radius))


def slots(plane: str, score: str) -> str:
    """The three best of each pixel's frames, inserted one by one, by recursion over the frames: s0, f0, s1, f1, s2, f2."""
    return f"""WITH RECURSIVE numbered AS (SELECT stack, frame, y, x, CAST({score} AS DOUBLE) AS s, row_number() OVER (PARTITION BY stack, y, x ORDER BY frame) AS k FROM {plane} WHERE {score} > -1), w AS (
  SELECT stack, y, x, k, s AS s0, CAST(frame AS BIGINT) AS f0, CAST(-1 AS DOUBLE) AS s1, CAST(0 AS BIGINT) AS f1, CAST(-1 AS DOUBLE) AS s2, CAST(0 AS BIGINT) AS f2 FROM numbered WHERE k = 1
  UNION ALL
  SELECT w.stack, w.y, w.x, q.k,
    CASE WHEN q.s > s0 THEN q.s ELSE s0 END, CASE WHEN q.s > s0 THEN q.frame ELSE f0 END,
    CASE WHEN q.s > s0 THEN greatest(s0, s1) WHEN q.s > s1 THEN q.s ELSE s1 END, CASE WHEN q.s > s0 THEN CASE WHEN s0 > s1 THEN f0 ELSE f1 END WHEN q.s > s1 THEN q.frame ELSE f1 END,
    CASE WHEN q.s > s0 THEN CASE WHEN s0 > s1 THEN greatest(s1, s2) ELSE greatest(s0, s2) END WHEN q.s > s1 THEN greatest(s1, s2) WHEN q.s > s2 THEN q.s ELSE s2 END,
    CASE WHEN q.s > s0 THEN CASE WHEN s0 > s1 THEN CASE WHEN s1 > s2 THEN f1 ELSE f2 END WHEN s0 > s2 THEN f0 ELSE f2 END WHEN q.s > s1 THEN CASE WHEN s1 > s2 THEN f1 ELSE f2 END WHEN q.s > s2 THEN q.frame ELSE f2 END
  FROM w JOIN numbered q ON q.stack = w.stack AND q.y = w.y AND q.x = w.x AND q.k = w.k + 1)
SELECT stack, y, x, s0, f0, s1, f1, s2, f2 FROM (SELECT *, max(k) OVER (PARTITION BY stack, y, x) AS n FROM w) WHERE k = n"""


def noise_gain(support: int, sigma: float) -> float:
    """From the definition: the squares of the softened derivative across and of the softened sum along."""
    raw = [math.exp(-((d / sigma) ** 2) / 2) if abs(d) <= support else 0.0 for d in range(-support - 2, support + 3)]
    g = [v / sum(raw) for v in raw]
    inner = range(1, len(g) - 1)
    return 2 * sum((g[i + 1] - g[i - 1]) ** 2 for i in inner) * sum((g[i - 1] + 2 * g[i] + g[i + 1]) ** 2 for i in inner)


CONFIDENCE = "least(greatest((greatest(s0, 0) - greatest(s1, 0)) / greatest(s0, 1e-8), 0), 1)"


def labelled(name: str, score: str, frames: str = "emb") -> dict[str, str]:
    """Planes from a score to cleaned labels: ``name`` + conf, guide, edge, med, plane."""
    n = name
    return {
        f"{n}slots": slots(score, "score"),
        f"{n}conf": f"SELECT stack, y, x, f0 AS label, s0, s1, s2, f1, f2, {CONFIDENCE} AS confidence FROM {n}slots",
        f"{n}guide": f"SELECT t.stack, t.y, t.x, e.v FROM {n}conf t JOIN {frames} e ON e.stack = t.stack AND e.frame = t.label AND e.y = t.y AND e.x = t.x",
        f"{n}guide_sobel": conv(f"{n}guide", PIXEL, "v", focus.SOBEL),
        f"{n}edge": f"SELECT stack, y, x, least(sqrt(gx * gx + gy * gy) / 16000, 1.0) AS edge FROM {n}guide_sobel",
        f"{n}med": f"""SELECT stack, y, x, label AS median FROM (SELECT p.stack, p.y, p.x, q.label, row_number() OVER (PARTITION BY p.stack, p.y, p.x ORDER BY q.label) AS k
      FROM {n}conf p CROSS JOIN nine k JOIN {n}conf q ON q.stack = p.stack AND q.y = {clamped('p.y + k.dy')} AND q.x = {clamped('p.x + k.dx')}) WHERE k = 5""",
        f"{n}plane": f"""SELECT c.stack, c.y, c.x, CASE WHEN c.confidence < 0.2 AND e.edge < 0.35 AND ((m.median = c.label AND s0 >= 0) OR (m.median = c.f1 AND s1 >= 0) OR (m.median = c.f2 AND s2 >= 0)) THEN m.median ELSE c.label END AS label, c.confidence, e.edge
      FROM {n}conf c JOIN {n}edge e ON e.stack = c.stack AND e.y = c.y AND e.x = c.x JOIN {n}med m ON m.stack = c.stack AND m.y = c.y AND m.x = c.x""",
    }


def weighed(name: str, frames: str = "emb", radius: int = 2) -> dict[str, str]:
    """Planes from cleaned labels to the weights of each frame that is used: ``name`` + mask, soft, softened, w1 (plain), w2 (by occlusion)."""
    n = name
    hard = "least(greatest(4 * confidence, 0), 1)"
    return {
        f"{n}mask": f"""SELECT e.stack, e.frame, e.y, e.x, e.v, e.valid, p.label, p.confidence, p.edge, CAST(CASE WHEN p.label = e.frame THEN 1 ELSE 0 END AS DOUBLE) AS mask
      FROM {frames} e JOIN {n}plane p ON p.stack = e.stack AND p.y = e.y AND p.x = e.x WHERE EXISTS (SELECT 1 FROM {n}plane u WHERE u.stack = e.stack AND u.label = e.frame)""",
        f"{n}soft": smooth(f"{n}mask", FRAME, "mask", "soft", radius),
        f"{n}softened": f"SELECT m.*, s.soft, greatest(least(greatest(5 * confidence, 0), 1), edge) AS p FROM {n}mask m JOIN {n}soft s ON s.stack = m.stack AND s.frame = m.frame AND s.y = m.y AND s.x = m.x",
        f"{n}w1": f"SELECT *, ({hard} * mask + (1 - {hard}) * soft) * valid AS weight FROM {n}softened",
        f"{n}w2a": f"SELECT *, (1 - p) * least(greatest(4 * soft * (1 - soft), 0), 1) AS s FROM {n}softened",
        f"{n}w2": f"SELECT *, (mask * (1 - s) + soft * s) * valid AS weight FROM {n}w2a",
    }


def halved(plane: str, keys: list[str], value: str, n: int, more: str = "") -> str:
    """One pyramid step down from n x n."""
    own = ", ".join(f"o.{k}" for k in keys)
    on = " AND ".join(f"e.{k} = o.{k}" for k in keys)
    return f"""SELECT {own}, o.y // 2 AS y, o.x // 2 AS x, sum(CAST(a.w AS DOUBLE) * CAST(b.w AS DOUBLE) * e.{value}) AS {value}{more} FROM (SELECT * FROM {plane} WHERE y % 2 = 0 AND x % 2 = 0) o CROSS JOIN taps5 a CROSS JOIN taps5 b
      JOIN {plane} e ON {on} AND e.y = {mirrored('o.y + a.d', n)} AND e.x = {mirrored('o.x + b.d', n)} GROUP BY {own}, o.y, o.x"""


def doubled(plane: str, places: str, keys: list[str], value: str, n: int) -> str:
    """One pyramid step up to the places of another plane, n x n."""
    own = ", ".join(f"o.{k}" for k in keys)
    on = " AND ".join(f"s.{k} = o.{k}" for k in keys)
    return f"""SELECT {own}, o.y, o.x, sum({4 if n > 1 else 1} * CAST(a.w AS DOUBLE) * CAST(b.w AS DOUBLE) * s.{value}) AS {value} FROM {places} o CROSS JOIN taps5 a CROSS JOIN taps5 b
      JOIN {plane} s ON {on} AND 2 * s.y = {mirrored('o.y + a.d', n)} AND 2 * s.x = {mirrored('o.x + b.d', n)} GROUP BY {own}, o.y, o.x"""


def multiband(name: str, levels: int) -> dict[str, str]:
    """Planes from weights (``name`` + w2) to the blended image ``name`` + mb: v, covered."""
    n, sizes, out = name, [N], {}
    for _ in range(levels):
        sizes.append((sizes[-1] + 1) // 2)
    out[f"{n}g0"] = f"SELECT stack, frame, y, x, CAST(v AS DOUBLE) AS v FROM {n}w2"
    out[f"{n}c0"] = f"SELECT stack, frame, y, x, weight FROM {n}w2"
    for k in range(1, levels + 1):
        out[f"{n}g{k}"] = halved(f"{n}g{k - 1}", FRAME, "v", sizes[k - 1])
        out[f"{n}c{k}"] = halved(f"{n}c{k - 1}", FRAME, "weight", sizes[k - 1])
        out[f"{n}u{k - 1}"] = doubled(f"{n}g{k}", f"{n}g{k - 1}", FRAME, "v", sizes[k - 1])
    for k in range(levels + 1):
        step = 1 << k
        band = f"SELECT g.stack, g.frame, g.y, g.x, g.v - u.v AS v FROM {n}g{k} g JOIN {n}u{k} u USING (stack, frame, y, x)" if k < levels else f"SELECT stack, frame, y, x, v FROM {n}g{k}"
        here = "c.weight" if not k else "c.weight * (1 - w.p) + w.mask * w.valid * w.p"
        out[f"{n}b{k}"] = f"""SELECT l.stack, l.y, l.x, sum({here}) AS wsum, sum(({here}) * l.v) AS wvsum FROM ({band}) l JOIN {n}c{k} c USING (stack, frame, y, x)
      JOIN {n}w2 w ON w.stack = l.stack AND w.frame = l.frame AND w.y = l.y * {step} AND w.x = l.x * {step} GROUP BY l.stack, l.y, l.x"""
        out[f"{n}m{k}"] = f"SELECT stack, y, x, wvsum / greatest(wsum, 1e-8) AS v FROM {n}b{k}"
    out[f"{n}i{levels}"] = f"SELECT stack, y, x, v FROM {n}m{levels}"
    for k in range(levels - 1, -1, -1):
        out[f"{n}i{k}u"] = doubled(f"{n}i{k + 1}", f"{n}m{k}", PIXEL, "v", sizes[k])
        out[f"{n}i{k}"] = f"SELECT m.stack, m.y, m.x, m.v + u.v AS v FROM {n}m{k} m JOIN {n}i{k}u u USING (stack, y, x)"
    out[f"{n}mb"] = f"SELECT i.stack, i.y, i.x, i.v, b.wsum > 1e-8 AS covered FROM {n}i0 i JOIN {n}b0 b USING (stack, y, x)"
    return out


PLANES = {
    "emb": """SELECT label AS stack, vec_id AS frame, CAST(pos // 8 AS INTEGER) AS y, CAST(pos % 8 AS INTEGER) AS x,
      CAST(least(greatest(floor((CAST(embedding[pos + 1] AS DOUBLE) + 1) * 32767), 0), 65535) AS INTEGER) AS v FROM embeddings CROSS JOIN (SELECT CAST(range AS INTEGER) AS pos FROM range(64)) t""",
    "rgb": "SELECT stack, frame, y, x, v AS r, (v * 3 + 1000) % 65536 AS g, 65535 - v AS b FROM emb",
    "sobel": conv("emb", FRAME, "v", focus.SOBEL),
    "energy": "SELECT stack, frame, y, x, gx * gx + gy * gy AS energy FROM sobel",
    "seen": "SELECT stack, frame, y, x, v, CASE WHEN frame % 4 = 0 AND x < 2 THEN 0 ELSE 1 END AS valid FROM emb",
    "usable": """SELECT p.stack, p.frame, p.y, p.x, min(q.valid) AS usable FROM seen p JOIN seen q ON q.stack = p.stack AND q.frame = p.frame AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY p.stack, p.frame, p.y, p.x""",
    "score": "SELECT e.stack, e.frame, e.y, e.x, CASE WHEN u.usable = 1 THEN energy ELSE -1 END AS score FROM energy e JOIN usable u ON u.stack = e.stack AND u.frame = e.frame AND u.y = e.y AND u.x = e.x",
    "ranked": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stack, y, x ORDER BY score DESC, frame) AS rank FROM score WHERE score > -1) WHERE rank <= 3",
    "nine": "SELECT CAST(range % 3 - 1 AS INTEGER) AS dy, CAST(range // 3 - 1 AS INTEGER) AS dx FROM range(9)",
    "taps5": "SELECT * FROM (VALUES (-2, 0.0625), (-1, 0.25), (0, 0.375), (1, 0.25), (2, 0.0625)) k(d, w)",
    **labelled("", "score"),
    **weighed("", "seen"),
    "small": halved("emb", FRAME, "v", N),
    "back": doubled("small", "emb", FRAME, "v", N),
    "lap0": "SELECT e.stack, e.frame, e.y, e.x, e.v - b.v AS v FROM emb e JOIN back b ON b.stack = e.stack AND b.frame = e.frame AND b.y = e.y AND b.x = e.x",
    **multiband("", 3),
    "vec": "SELECT label AS stack, vec_id AS frame, embedding FROM embeddings",
    "tf": """SELECT stack, frame, 1.0 + (frame % 5 - 2) * 0.002 AS a, -(frame % 7 - 3) * 0.004 AS b, (frame % 3 - 1) * 0.5 AS c, (frame % 7 - 3) * 0.004 AS d, 1.0 + (frame % 5 - 2) * 0.002 AS e, (frame % 4) * 0.25 - 0.5 AS f FROM vec""",
}


def with_planes(final: str) -> str:
    """``final`` with the planes that it needs, in order."""
    import re

    need: set[str] = set()

    def visit(sql: str) -> None:
        for word in set(re.findall(r"\w+", sql)) & set(PLANES) - need:
            need.add(word)
            visit(PLANES[word])

    visit(final)
    ctes = [f"{n} AS MATERIALIZED ({s})" for n, s in PLANES.items() if n in need]
    more, final = ("", final) if not final.lstrip().startswith(",") else ("more", final.lstrip()[1:])
    if more and not ctes:
        return "WITH " + final
    return ("WITH " + ",\n".join(ctes) + (",\n" if more else "\n") if ctes else "") + final
