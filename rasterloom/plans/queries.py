"""A query for each operator, on rasters made of the tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import pixel
from rasterloom.operators import arrays, axis, blend, blocks, choose, focus, geometry, layers, match, tiles
from rasterloom.plans import oracle
from rasterloom.sources import listing, rasters, scenes
from rasterloom.sources.scratch import held

N = rasters.SIDE
FRAME, PIXEL = ["stack", "frame"], ["stack"]
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: The SQL of queries whose answer a second query gives in another way.
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
            ORACLE_SQL[name] = oracle.with_planes(sql)
        return f

    return add


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits)


def blockwise(df: DataFrame, halo: int, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], columns: dict[str, str]) -> DataFrame:
    """A kernel on the values ``v`` of each frame."""
    return blocks.by_block(df, FRAME, ["v"], N, N, halo, lambda b: kernel(b["v"].astype(float)), columns)


def seen(spark: SparkSession, d: str) -> DataFrame:
    """Frames some of which do not reach the left border, as if they had been moved."""
    e = rasters.embeddings(spark, d)
    return e.withColumn("valid", F.when((F.col("frame") % 4 == 0) & (F.col("x") < 2), 0).otherwise(1))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Frames with the squared gradient as their score; -1 where a pixel or a neighbour of it is not valid."""
    rows = choose.eroded(seen(spark, d), FRAME, "valid", N, N, 1).select(*FRAME, "y", "x", F.col("valid").alias("usable"))
    e = blockwise(rasters.embeddings(spark, d), 1, lambda v: {"energy": arrays.energy(v)}, {"energy": "double"})
    return e.join(rows, [*FRAME, "y", "x"]).select(*FRAME, "y", "x", F.when(F.col("usable") == 1, F.col("energy")).otherwise(-1.0).alias("score"))


def chosen(b: blocks.Block, score: Callable[[np.ndarray], np.ndarray], support: int) -> tuple[arrays.Best, np.ndarray, np.ndarray, np.ndarray]:
    """Of a raster's frames: the best three, confidence, edge and cleaned labels (places in ``b.frames``)."""
    best = arrays.Best(b["v"].shape[1:], np.float64)
    for k, v in enumerate(b["v"].astype(float)):
        best.see(np.where(arrays.eroded(b["valid"][k] > 0, support), score(v), -1), k, v)
    confidence, edge = best.confidence(), best.edge()
    return best, confidence, edge, arrays.cleaned(best, confidence, edge)


def label_planes(spark: SparkSession, d: str) -> DataFrame:
    """label (cleaned), confidence and edge of each place, by the squared gradient."""
    def kernel(b: blocks.Block) -> dict[str, np.ndarray]:
        _, confidence, edge, label = chosen(b, arrays.energy, 1)
        return {"label": b.frames[label][None], "confidence": confidence[None], "edge": edge[None]}

    return blocks.by_block(seen(spark, d), PIXEL, ["v", "valid"], N, N, 4, kernel, {"label": "long", "confidence": "double", "edge": "double"}, frame="frame")


def weighted(spark: SparkSession, d: str, weight: Callable[[], Column]) -> DataFrame:
    clean = held(label_planes(spark, d), "labels")  # used for the mask, the frames in use and the weights
    rows = blend.softened(blend.masks(seen(spark, d), clean, PIXEL), PIXEL, N, N, 2)
    return rows.withColumn("weight", weight())


def laid(spark: SparkSession, d: str, rules: layers.Rules, score: Callable[[np.ndarray], np.ndarray], support: int, finish: Callable, columns: dict[str, str]) -> DataFrame:
    """Each stack's frames put together, in one exchange: ``finish(layers, b)`` makes planes of the sums."""
    def kernel(b: blocks.Block) -> dict[str, np.ndarray]:
        _, confidence, edge, label = chosen(b, score, support)
        sure = np.maximum(np.clip(5 * confidence, 0, 1), edge) if rules.levels else np.clip(4 * confidence, 0, 1)
        sums = layers.Layers(label, sure, rules)
        for k in np.unique(label).tolist():
            sums.add(k, np.repeat(b["v"][k].astype(float)[None], 3, 0), b["valid"][k] > 0)
        return {name: plane[None] for name, plane in finish(sums, b).items()}

    halo = support + 2 + rules.blend_radius + sum(4 << k for k in range(rules.levels))
    return blocks.by_block(seen(spark, d), PIXEL, ["v", "valid"], N, N, halo, kernel, columns, grid=1 << rules.levels, frame="frame")


@query("raster_embeddings", "SELECT stack, frame, y, x, v FROM emb")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rasters.embeddings(spark, d)


@query("u8_expand", "SELECT stack, frame, y, x, (v >> 8) AS v8, (v >> 8) * 257 AS v16 FROM emb")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rasters.embeddings(spark, d).select("stack", "frame", "y", "x", pixel.reduce16(F.col("v")).alias("v8"), pixel.expand8(pixel.reduce16(F.col("v"))).alias("v16"))


@query("luminance", "SELECT stack, frame, y, x, round(r * 0.299 + g * 0.587 + b * 0.114, 6) AS gray, ((r >> 8) * 4899 + (g >> 8) * 9617 + (b >> 8) * 1868 + 8192) >> 14 AS gray8 FROM rgb")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = rasters.coloured(rasters.embeddings(spark, d))
    low = [pixel.reduce16(F.col(k)) for k in "rgb"]
    return c.select("stack", "frame", "y", "x", r(pixel.luminance(F.col("r"), F.col("g"), F.col("b"))).alias("gray"), pixel.luminance8(*low).alias("gray8"))


@query("round_half_even", "SELECT stack, frame, y, x, CAST(least(greatest(round_even(v / 2.0, 0), 0), 65535) AS INTEGER) AS half FROM emb")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rasters.embeddings(spark, d).select("stack", "frame", "y", "x", pixel.to_u16(F.col("v") / 2).alias("half"))


@query("orient_all", "SELECT o, stack, frame, " + ", ".join(
    f"CASE o WHEN 1 THEN {a[0]} WHEN 2 THEN {a[1]} WHEN 3 THEN {a[2]} WHEN 4 THEN {a[3]} WHEN 5 THEN {a[4]} WHEN 6 THEN {a[5]} WHEN 7 THEN {a[6]} ELSE {a[7]} END AS {n}"
    for n, a in {"y": ["y", "y", "7 - y", "7 - y", "x", "x", "7 - x", "7 - x"], "x": ["x", "7 - x", "7 - x", "x", "y", "7 - y", "7 - y", "y"]}.items()
) + ", v FROM emb CROSS JOIN (SELECT CAST(range AS INTEGER) AS o FROM range(1, 9)) t")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = rasters.embeddings(spark, d)
    moved = [F.struct(F.lit(o).alias("o"), yx[0].alias("y"), yx[1].alias("x")) for o in range(1, 9) for yx in [pixel.oriented(F.col("y"), F.col("x"), N, N, o)]]
    return e.select("stack", "frame", "v", F.explode(F.array(*moved)).alias("m")).select("m.o", "stack", "frame", "m.y", "m.x", "v")


@query("gaussian_smooth", f"SELECT stack, frame, y, x, round(s, 4) AS s FROM ({oracle.smooth('emb', FRAME, 'v', 's', 3)})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return blockwise(rasters.embeddings(spark, d), 3, lambda v: {"s": arrays.smooth(v, 3)}, {"s": "double"}).withColumn("s", r("s", 4))


@query("sobel", "SELECT stack, frame, y, x, CAST(gx AS BIGINT) AS gx, CAST(gy AS BIGINT) AS gy FROM sobel")
def _(spark: SparkSession, d: str) -> DataFrame:
    return blockwise(rasters.embeddings(spark, d), 1, lambda v: dict(zip(("gx", "gy"), map(np.rint, arrays.sobel(v)))), {"gx": "long", "gy": "long"})


def _tenengrad_sql(radius: int) -> str:
    return oracle.smooth("energy", FRAME, "energy", "score", radius)


@query("tenengrad", f"SELECT stack, frame, y, x, round(score / 1e6, 4) AS score FROM ({_tenengrad_sql(3)})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return blockwise(rasters.embeddings(spark, d), 4, lambda v: {"score": arrays.standard_score(v, 3)}, {"score": "double"}).withColumn("score", r(F.col("score") / 1e6, 4))


oracle.PLANES["ten3"] = _tenengrad_sql(3)
oracle.PLANES["s3"] = oracle.smooth("emb", FRAME, "v", "v", 3)
oracle.PLANES["s3_sobel"] = oracle.conv("s3", FRAME, "v", focus.SOBEL)
oracle.PLANES["s3_energy"] = "SELECT stack, frame, y, x, gx * gx + gy * gy AS energy FROM s3_sobel"
oracle.PLANES["ten6"] = oracle.smooth("s3_energy", FRAME, "energy", "score", 6)


@query("standard_score_multiscale", "SELECT a.stack, a.frame, a.y, a.x, round((a.score + 0.5 * b.score) / 1e6, 4) AS score FROM ten3 a JOIN ten6 b ON b.stack = a.stack AND b.frame = a.frame AND b.y = a.y AND b.x = a.x")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = blockwise(rasters.embeddings(spark, d), 10, lambda v: {"score": arrays.standard_score(v, 3, True)}, {"score": "double"})
    return s.withColumn("score", r(F.col("score") / 1e6, 4))


oracle.PLANES["grad"] = oracle.conv("emb", FRAME, "v", {**focus.SOBEL, **focus.MIXED})
oracle.PLANES["prod"] = "SELECT stack, frame, y, x, gx * gx AS xx, gy * gy AS yy, gx * gy AS xy, mixed * mixed AS m2 FROM grad"
for _k in ("xx", "yy", "xy", "m2"):
    oracle.PLANES["p_" + _k] = oracle.smooth("prod", FRAME, _k, "v", 2)
oracle.PLANES["tensor"] = (
    "SELECT a.stack, a.frame, a.y, a.x, sqrt((a.v - b.v) * (a.v - b.v) + 4 * c.v * c.v) / greatest(a.v + b.v, 1) AS coherence, m.v AS m2 FROM p_xx a JOIN p_yy b USING (stack, frame, y, x) JOIN p_xy c USING (stack, frame, y, x) JOIN p_m2 m USING (stack, frame, y, x)"
)
oracle.PLANES["floor_"] = "SELECT stack, frame, y, x, coherence, 0.25 * m2 * greatest(1 - coherence * coherence, 0) AS noise FROM tensor"


@query("noise_coherence", "SELECT stack, frame, y, x, round(coherence, 6) AS coherence, round(noise / 1e6, 4) AS noise FROM floor_")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = blockwise(rasters.embeddings(spark, d), 3, lambda v: arrays.structure(v, 2), {"coherence": "double", "noise": "double"})
    return s.select(*FRAME, "y", "x", r(F.sqrt("coherence")).alias("coherence"), r(F.col("noise") / 1e6, 4).alias("noise"))


oracle.PLANES["sq"] = "SELECT stack, frame, y, x, CAST(v AS DOUBLE) AS v, CAST(v AS DOUBLE) * v AS v2 FROM emb"
oracle.PLANES["mean2"] = oracle.smooth("sq", FRAME, "v", "m", 2)
oracle.PLANES["square2"] = oracle.smooth("sq", FRAME, "v2", "s", 2)


@query("contrast", "SELECT stack, frame, y, x, round(greatest(s - m * m, 0) / 1e6, 4) AS variance, round(greatest(s - m * m, 0) / (greatest(s - m * m, 0) + 2 * noise + 1024), 6) AS contrast FROM mean2 JOIN square2 USING (stack, frame, y, x) JOIN floor_ USING (stack, frame, y, x)")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = blockwise(rasters.embeddings(spark, d), 3, lambda v: arrays.structure(v, 2), {"variance": "double", "contrast": "double"})
    return s.select(*FRAME, "y", "x", r(F.col("variance") / 1e6, 4).alias("variance"), r("contrast").alias("contrast"))


@query("laplacian", f"SELECT stack, frame, y, x, CAST(lap AS BIGINT) AS lap FROM ({oracle.conv('emb', FRAME, 'v', focus.LAPLACE)})")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = axis.several(rasters.embeddings(spark, d), FRAME, F.col("v"), N, N, focus.LAPLACE)
    return s.select(*FRAME, "y", "x", F.col("lap").cast("long").alias("lap"))


for _r in (2, 4):
    oracle.PLANES[f"noise{_r}"] = oracle.smooth("floor_", FRAME, "noise", "v", _r)
for _k, (_support, _sigma, _) in enumerate(focus.SCALES):
    _bell, _wide = focus.bell(_support, _sigma), focus.reach(_support, 2)
    oracle.PLANES[f"scale{_k}"] = oracle.separable("emb", FRAME, "v", "v", _bell)
    oracle.PLANES[f"scale{_k}_d"] = oracle.conv(f"scale{_k}", FRAME, "v", {**focus.SOBEL, **focus.LAPLACE})
    oracle.PLANES[f"scale{_k}_e"] = f"SELECT stack, frame, y, x, gx * gx + gy * gy AS energy, lap * lap AS bend FROM scale{_k}_d"
    oracle.PLANES[f"energy{_k}"] = oracle.smooth(f"scale{_k}_e", FRAME, "energy", "v", _wide)
    oracle.PLANES[f"bend{_k}"] = oracle.smooth(f"scale{_k}_e", FRAME, "bend", "v", _wide)


def _photographic_sql() -> str:
    parts, joins = [], "floor_ n JOIN mean2 USING (stack, frame, y, x) JOIN square2 USING (stack, frame, y, x) JOIN noise2 USING (stack, frame, y, x) JOIN noise4 USING (stack, frame, y, x)"
    for k, (support, sigma, weight) in enumerate(focus.SCALES):
        joins += f" JOIN energy{k} USING (stack, frame, y, x) JOIN bend{k} USING (stack, frame, y, x)"
        parts.append(f"{weight} * (greatest(energy{k}.v - {1.5 * oracle.noise_gain(support, sigma)!r} * noise{focus.reach(support, 2)}.v, 0) + 0.2 * greatest(bend{k}.v - 0.5 * n.noise, 0))")
    variance = "greatest(s - m * m, 0)"
    return f"SELECT stack, frame, y, x, ({' + '.join(parts)}) * {variance} / ({variance} + 2 * n.noise + 1024) AS score FROM {joins}"


oracle.PLANES["photo"] = _photographic_sql()


@query("photographic_score", "SELECT stack, frame, y, x, round(score / 1e6, 3) AS score FROM photo")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = blockwise(rasters.embeddings(spark, d), 12, lambda v: {"score": arrays.photographic_score(v, 2, True)}, {"score": "double"})
    return s.select(*FRAME, "y", "x", r(F.col("score") / 1e6, 3).alias("score"))


@query("noise_gain", """
, s AS (SELECT * FROM (VALUES (1, 0.7), (3, 1.0), (6, 2.0)) v(support, sigma)),
e AS (SELECT support, sigma, CAST(r.range AS INTEGER) - 8 AS d, CASE WHEN abs(r.range - 8) <= support THEN exp(-(r.range - 8) * (r.range - 8) / (2 * CAST(sigma AS DOUBLE) * sigma)) ELSE 0 END AS e FROM s CROSS JOIN range(17) r),
g AS (SELECT support, sigma, d, e / sum(e) OVER (PARTITION BY support) AS g FROM e),
n AS (SELECT support, sigma, lead(g) OVER o - lag(g) OVER o AS across, lag(g) OVER o + 2 * g + lead(g) OVER o AS along FROM g WINDOW o AS (PARTITION BY support ORDER BY d))
SELECT support, CAST(sigma AS DOUBLE) AS sigma, round(2 * sum(across * across) * sum(along * along), 9) AS gain FROM n GROUP BY support, sigma""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, s, round(focus.noise_gain(n, s), 9)) for n, s, _ in focus.SCALES], "support int, sigma double, gain double")


@query("top3_sources", "SELECT stack, y, x, rank, frame, CAST(score AS BIGINT) AS score FROM ranked")
def _(spark: SparkSession, d: str) -> DataFrame:
    return choose.ranked(scored(spark, d), PIXEL).select("stack", "y", "x", F.col("rank").cast("long").alias("rank"), "frame", F.col("score").cast("long").alias("score"))


oracle.PLANES["quant"] = "SELECT stack, frame, y, x, floor(score / 4e8) AS score FROM score WHERE score > -1"
oracle.PLANES["quantslots"] = oracle.slots("quant", "score")


@query("top3_cascade", "SELECT stack, y, x, s0, f0, s1, f1, s2, f2 FROM quantslots")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).filter("score > -1").withColumn("score", F.floor(F.col("score") / 4e8).cast("double"))
    return choose.cascade(s, PIXEL).select("stack", "y", "x", *[F.col("c")[k][n].alias(n[0] + str(k)) for k in range(3) for n in ("score", "frame")])


@query("winner_argmax", "SELECT stack, y, x, label AS frame, CAST(s0 AS BIGINT) AS score FROM conf")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = choose.winner(scored(spark, d), PIXEL)
    return w.select("stack", "y", "x", "frame", F.col("score").cast("long").alias("score"))


@query("arriving_frames", "SELECT c.stack, c.y, c.x, c.label AS frame, CAST(c.s0 AS BIGINT) AS score, n.seen FROM conf c JOIN (SELECT stack, y, x, count(*) AS seen FROM score WHERE score >= 0 GROUP BY stack, y, x) n USING (stack, y, x)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Frames that arrive in a few files, as a stream."""
    import uuid

    from rasterloom.sources import scratch
    from rasterloom.streaming import arrivals

    place = f"{scratch.folder(spark)}/loom/arrivals-{uuid.uuid4().hex}"
    rows = scored(spark, d)
    rows.repartition(5, "frame").write.parquet(f"{place}/scores")
    best = arrivals.settled(spark, f"{place}/scores", "stack int, frame long, y int, x int, score double", PIXEL, place, 2)
    return best.select("stack", "y", "x", "frame", F.col("score").cast("long").alias("score"), "seen")


@query("guide_plane", "SELECT stack, y, x, v FROM guide")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = scored(spark, d).join(rasters.embeddings(spark, d), [*FRAME, "y", "x"])
    return choose.winner(s, PIXEL, "v").select("stack", "y", "x", "v")


@query("confidence", "SELECT stack, y, x, label, round(confidence, 6) AS confidence FROM conf")
def _(spark: SparkSession, d: str) -> DataFrame:
    return choose.labels(scored(spark, d), PIXEL).select("stack", "y", "x", "label", r("confidence").alias("confidence"))


@query("edge_strength", "SELECT stack, y, x, round(edge, 6) AS edge FROM edge")
def _(spark: SparkSession, d: str) -> DataFrame:
    guide = QUERIES["guide_plane"](spark, d)
    return focus.edge_strength(guide, PIXEL, F.col("v"), N, N).withColumn("edge", r("edge"))


@query("median3_labels", "SELECT stack, y, x, median FROM med")
def _(spark: SparkSession, d: str) -> DataFrame:
    return choose.median3(choose.labels(scored(spark, d), PIXEL), PIXEL, "label", N, N)


@query("cleanup_max", "SELECT stack, y, x, label FROM plane")
def _(spark: SparkSession, d: str) -> DataFrame:
    return label_planes(spark, d).select("stack", "y", "x", "label")


@query("cleanup_pixels", "SELECT stack, y, x, label FROM plane")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same, pixel by pixel."""
    lab = choose.labels(scored(spark, d), PIXEL).join(QUERIES["guide_plane"](spark, d), ["stack", "y", "x"])
    lab = held(lab, "labels")  # used for the edges, the medians and the choice
    rows = lab.drop("v").join(focus.edge_strength(lab, PIXEL, F.col("v"), N, N), ["stack", "y", "x"])
    return choose.cleaned(rows, PIXEL, N, N).select("stack", "y", "x", "label")


@query("cleanup_standard", "SELECT c.stack, c.y, c.x, CASE WHEN c.confidence < 0.25 THEN m.median ELSE c.label END AS label FROM conf c JOIN med m ON m.stack = c.stack AND m.y = c.y AND m.x = c.x")
def _(spark: SparkSession, d: str) -> DataFrame:
    return choose.cleaned(choose.labels(scored(spark, d), PIXEL), PIXEL, N, N, 0.25, None).select("stack", "y", "x", "label")


@query("erode_valid", """SELECT p.stack, p.frame, p.y, p.x, min(CASE WHEN q.v > 12000 THEN 1 ELSE 0 END) AS valid FROM emb p CROSS JOIN (SELECT CAST(a.range - 2 AS INTEGER) AS dy, CAST(b.range - 2 AS INTEGER) AS dx FROM range(5) a CROSS JOIN range(5) b) k
  JOIN emb q ON q.stack = p.stack AND q.frame = p.frame AND q.y = p.y + k.dy AND q.x = p.x + k.dx GROUP BY p.stack, p.frame, p.y, p.x""")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = rasters.embeddings(spark, d).select(*FRAME, "y", "x", (F.col("v") > 12000).cast("int").alias("valid"))
    return choose.eroded(v, FRAME, "valid", N, N, 2)


@query("boundary_dilate", """SELECT p.stack, p.y, p.x, max(CASE WHEN q.label % 2 = 1 THEN 1 ELSE 0 END) AS grown FROM conf p CROSS JOIN nine k JOIN conf q ON q.stack = p.stack AND q.y = least(greatest(p.y + k.dy, 0), 7) AND q.x = least(greatest(p.x + k.dx, 0), 7) GROUP BY p.stack, p.y, p.x""")
def _(spark: SparkSession, d: str) -> DataFrame:
    lab = choose.labels(scored(spark, d), PIXEL)
    return axis.neighbours(lab, PIXEL, (F.col("label") % 2 == 1).cast("int"), N, N, 1, F.max).withColumnRenamed("v", "grown")


@query("weight_standard", "SELECT stack, frame, y, x, round(weight, 6) AS weight FROM w1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return weighted(spark, d, blend.plain_weight).select("stack", "frame", "y", "x", r("weight").alias("weight"))


@query("weight_occlusion", "SELECT stack, frame, y, x, round(weight, 6) AS weight FROM w2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return weighted(spark, d, blend.occlusion_weight).select("stack", "frame", "y", "x", r("weight").alias("weight"))


@query("weighted_fuse", """
, s AS (SELECT stack, y, x, sum(weight) AS total, sum(weight * v) AS t FROM w1 GROUP BY stack, y, x), f AS (SELECT stack, min(frame) AS frame FROM emb GROUP BY stack)
SELECT e.stack, e.y, e.x, CAST(least(greatest(round_even(CASE WHEN coalesce(total, 0) > 1e-8 THEN t / greatest(total, 1e-8) ELSE e.v END, 0), 0), 65535) AS INTEGER) AS v, coalesce(total, 0) > 1e-8 AS covered
FROM emb e JOIN f ON f.stack = e.stack AND f.frame = e.frame LEFT JOIN s ON s.stack = e.stack AND s.y = e.y AND s.x = e.x""")
def _(spark: SparkSession, d: str) -> DataFrame:
    def finish(sums: layers.Layers, b: blocks.Block) -> dict[str, np.ndarray]:
        return {"v": sums.image(lambda: np.repeat(b["v"][:1].astype(float), 3, 0))[..., 0], "covered": sums.totals[0] > arrays.FLOOR}

    return laid(spark, d, layers.Rules(0, 1, 2, 2), arrays.energy, 1, finish, {"v": "int", "covered": "boolean"})


@query("fallback_fill", """
, f AS (SELECT stack, min(frame) AS frame FROM emb GROUP BY stack), s AS (SELECT stack, y, x, sum(weight) AS total, sum(weight * v) AS t FROM w1 WHERE (y + x) % 3 <> 0 GROUP BY stack, y, x)
SELECT e.stack, e.y, e.x, CAST(CASE WHEN coalesce(total, 0) > 1e-8 THEN least(greatest(round_even(t / total, 0), 0), 65535) ELSE e.v END AS INTEGER) AS v, coalesce(total, 0) > 1e-8 AS covered
FROM emb e JOIN f ON f.stack = e.stack AND f.frame = e.frame LEFT JOIN s ON s.stack = e.stack AND s.y = e.y AND s.x = e.x""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = rasters.embeddings(spark, d)
    first = e.join(e.groupBy("stack").agg(F.min("frame").alias("frame")), FRAME, "left_semi")
    return blend.fused(weighted(spark, d, blend.plain_weight).filter("(y + x) % 3 != 0"), PIXEL, ["v"], first)


@query("hard_owned", "SELECT stack, y, x, CAST(sum(v * mask * valid) AS BIGINT) AS v FROM mask GROUP BY stack, y, x")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = blend.owned(weighted(spark, d, blend.plain_weight), PIXEL, ["v"])
    return own.select("stack", "y", "x", F.col("v").cast("long").alias("v"))


@query("pyr_down", "SELECT stack, frame, y, x, round(v, 4) AS v FROM small")
def _(spark: SparkSession, d: str) -> DataFrame:
    return blend.down(rasters.embeddings(spark, d), FRAME, "v", N, N).withColumn("v", r("v", 4))


@query("pyr_up", "SELECT stack, frame, y, x, round(v, 4) AS v FROM back")
def _(spark: SparkSession, d: str) -> DataFrame:
    return blend.up(blend.down(rasters.embeddings(spark, d), FRAME, "v", N, N), FRAME, "v", N, N).withColumn("v", r("v", 4))


@query("laplacian_levels", "SELECT stack, frame, 0 AS level, y, x, round(v, 4) AS v FROM lap0 UNION ALL SELECT stack, frame, 1, y, x, round(v, 4) FROM small")
def _(spark: SparkSession, d: str) -> DataFrame:
    kernel = lambda b: [{"v": p} for p in arrays.pyramid(b["v"].astype(float), 1)]
    return blocks.by_block(rasters.embeddings(spark, d), FRAME, ["v"], N, N, 4, kernel, {"v": "double"}, grid=2, levels=True).withColumn("v", r("v", 4))


@query("pyramid_roundtrip", "SELECT stack, frame, y, x, CAST(round(v, 3) AS DOUBLE) AS v FROM emb")
def _(spark: SparkSession, d: str) -> DataFrame:
    return blockwise(rasters.embeddings(spark, d), 60, lambda v: {"v": arrays.collapsed(arrays.pyramid(v, 4))}, {"v": "double"}).withColumn("v", r("v", 3) + 0.0)


@query("multiband_accumulate", "SELECT stack, y, x, round(v, 3) AS v, covered FROM mb")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Three levels, before the owned pixels come in."""
    def finish(sums: layers.Layers, b: blocks.Block) -> dict[str, np.ndarray]:
        image = arrays.collapsed([s / np.maximum(t, arrays.FLOOR) for s, t in zip(sums.sums, sums.totals)])
        return {"v": image[0], "covered": sums.totals[0] > arrays.FLOOR}

    return laid(spark, d, layers.Rules(3, 1, 2, 2), arrays.energy, 1, finish, {"v": "double", "covered": "boolean"}).withColumn("v", r("v", 3))


@query("multiband_pixels", "SELECT stack, y, x, round(v, 3) AS v, covered FROM mb")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same, pixel by pixel."""
    rows = weighted(spark, d, blend.occlusion_weight)
    return blend.multiband(rows, PIXEL, "v", N, N, 3).withColumn("v", r("v", 3))


#: The whole of quality max, on scores of three scales: erosion, slots, clean-up, four levels, owned pixels, 16 bits.
oracle.PLANES["usable9"] = """SELECT p.stack, p.frame, p.y, p.x, min(q.valid) AS usable FROM seen p JOIN seen q ON q.stack = p.stack AND q.frame = p.frame AND abs(q.y - p.y) <= 3 AND abs(q.x - p.x) <= 3 GROUP BY p.stack, p.frame, p.y, p.x"""
oracle.PLANES["f_score"] = "SELECT p.stack, p.frame, p.y, p.x, CASE WHEN u.usable = 1 THEN score ELSE -1 END AS score FROM photo p JOIN usable9 u ON u.stack = p.stack AND u.frame = p.frame AND u.y = p.y AND u.x = p.x"
oracle.PLANES |= oracle.labelled("f_", "f_score") | oracle.weighed("f_", "seen") | oracle.multiband("f_", 4)
oracle.PLANES["f_own"] = "SELECT stack, y, x, sum(v * mask * valid) AS own, max(p) AS p FROM f_w2 GROUP BY stack, y, x"
oracle.PLANES["f_first"] = "SELECT e.stack, e.y, e.x, e.v FROM emb e JOIN (SELECT stack, min(frame) AS frame FROM emb GROUP BY stack) f ON f.stack = e.stack AND f.frame = e.frame"


@query("fuse_max", """SELECT m.stack, m.y, m.x, CAST(least(greatest(round_even(CASE WHEN m.covered THEN m.v * (1 - o.p) + o.own * o.p ELSE e.v END, 0), 0), 65535) AS INTEGER) AS v
FROM f_mb m JOIN f_own o ON o.stack = m.stack AND o.y = m.y AND o.x = m.x JOIN f_first e ON e.stack = m.stack AND e.y = m.y AND e.x = m.x""")
def _(spark: SparkSession, d: str) -> DataFrame:
    def finish(sums: layers.Layers, b: blocks.Block) -> dict[str, np.ndarray]:
        return {"v": sums.image(lambda: np.repeat(b["v"][:1].astype(float), 3, 0))[..., 0]}

    return laid(spark, d, layers.Rules(4, 3, 2, 2, best=True), lambda v: arrays.photographic_score(v, 2, True), 3, finish, {"v": "int"})


_GRID_SQL = """SELECT CAST(ty * 4 + tx AS INTEGER) AS tile, ty * 24 AS y0, least(ty * 24 + 24, 70) AS y1, tx * 24 AS x0, least(tx * 24 + 24, 90) AS x1, greatest(ty * 24 - 5, 0) // 4 * 4 AS hy0, least((least(ty * 24 + 24, 70) + 5 + 3) // 4 * 4, 70) AS hy1,
  greatest(tx * 24 - 5, 0) // 4 * 4 AS hx0, least((least(tx * 24 + 24, 90) + 5 + 3) // 4 * 4, 90) AS hx1 FROM (SELECT CAST(range AS INTEGER) AS ty FROM range(3)) a CROSS JOIN (SELECT CAST(range AS INTEGER) AS tx FROM range(4)) b"""
oracle.PLANES["grid"] = _GRID_SQL


@query("tile_grid", "SELECT * FROM grid")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tiles.grid(spark, 70, 90, 24, 5, 4)


oracle.PLANES["evt"] = "SELECT event_type AS stack, CAST(user_id % 70 AS INTEGER) AS y, CAST(event_id % 90 AS INTEGER) AS x, CAST(count(*) AS BIGINT) AS v FROM events GROUP BY 1, 2, 3"


def events_raster(spark: SparkSession, d: str) -> DataFrame:
    e = rasters.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("stack"), (F.col("user_id") % 70).cast("int").alias("y"), (F.col("event_id") % 90).cast("int").alias("x")).agg(F.count("*").alias("v"))


@query("halo_exchange", "SELECT stack, tile, y, x, v, y >= y0 AND y < y1 AND x >= x0 AND x < x1 AS core FROM evt JOIN grid ON y >= hy0 AND y < hy1 AND x >= hx0 AND x < hx1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = tiles.exchanged(events_raster(spark, d), tiles.grid(spark, 70, 90, 24, 5, 4), 16)
    return rows.select("stack", "tile", "y", "x", "v", "core")


@query("crop_core", "SELECT stack, tile, CAST(sum(v) AS BIGINT) AS v FROM evt JOIN grid ON y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY stack, tile")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = tiles.cropped(tiles.exchanged(events_raster(spark, d), tiles.grid(spark, 70, 90, 24, 5, 4), 16))
    return rows.groupBy("stack", "tile").agg(F.sum("v").alias("v"))


@query("bbox_blocks", "SELECT tile, CAST(b.range AS INTEGER) AS by, CAST(c.range AS INTEGER) AS bx FROM grid JOIN range(5) b ON b.range * 16 < hy1 AND (b.range + 1) * 16 > hy0 JOIN range(6) c ON c.range * 16 < hx1 AND (c.range + 1) * 16 > hx0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return tiles.blocks_of(tiles.grid(spark, 70, 90, 24, 5, 4), 16).select("tile", "by", "bx")


@query("tile_frame_semijoin", "SELECT DISTINCT e.stack, e.frame, e.y // 4 * 2 + e.x // 4 AS tile FROM emb e JOIN plane p ON p.stack = e.stack AND p.label = e.frame AND p.y // 4 = e.y // 4 AND p.x // 4 = e.x // 4")
def _(spark: SparkSession, d: str) -> DataFrame:
    tile = F.expr("cast(y div 4 * 2 + x div 4 as int)").alias("tile")
    used = label_planes(spark, d).select("stack", F.col("label").alias("frame"), tile)
    rows = rasters.embeddings(spark, d).select("stack", "frame", tile)
    return rows.join(used, ["stack", "frame", "tile"], "left_semi").distinct()


@query("area_bin", "SELECT stack, CAST(y * 20 // 70 AS INTEGER) AS y, CAST(x * 16 // 90 AS INTEGER) AS x, CAST(sum(v) AS BIGINT) AS total, count(*) AS n, CAST(round_even(avg(v), 0) AS INTEGER) AS mean FROM evt GROUP BY 1, 2, 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = events_raster(spark, d).groupBy("stack", F.expr("cast(y * 20 div 70 as int)").alias("y"), F.expr("cast(x * 16 div 90 as int)").alias("x"))
    return rows.agg(F.sum("v").alias("total"), F.count("*").alias("n"), F.rint(F.avg("v")).cast("int").alias("mean"))


@query("area_resize", """
, o AS (SELECT CAST(range AS INTEGER) AS o FROM range(3)), k AS (SELECT o, CAST(s.range AS INTEGER) AS s, greatest(0, least((s.range + 1) * 3, (o + 1) * 8) - greatest(s.range * 3, o * 8)) / 8.0 AS w FROM o CROSS JOIN range(8) s)
SELECT stack, frame, a.o AS y, b.o AS x, round(sum(CAST(a.w AS DOUBLE) * CAST(b.w AS DOUBLE) * v), 4) AS v FROM emb JOIN k a ON a.s = y AND a.w > 0 JOIN k b ON b.s = x AND b.w > 0 GROUP BY 1, 2, 3, 4""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = rasters.embeddings(spark, d)
    rows = axis.along(e, axis.resized(spark, N, 3), "x", [*FRAME, "y"], {"v": F.col("v")}, N)
    rows = axis.along(rows, axis.resized(spark, N, 3), "y", [*FRAME, "x"], {"v": F.col("v")}, N)
    return rows.select(*FRAME, "y", "x", r("v", 4).alias("v"))


def transforms(spark: SparkSession, d: str) -> DataFrame:
    """A small similarity for each frame, from its number."""
    f = F.col("frame")
    t = rasters.table(spark, d, "embeddings").select(F.col("label").alias("stack"), F.col("vec_id").alias("frame"))
    s, turn = 1.0 + (f % 5 - 2) * 0.002, (f % 7 - 3) * 0.004
    return t.select("stack", "frame", s.alias("a"), (-turn).alias("b"), ((f % 3 - 1) * 0.5).alias("c"), turn.alias("d"), s.alias("e"), ((f % 4) * 0.25 - 0.5).alias("f"))


oracle.PLANES["tfd"] = "SELECT stack, frame, " + ", ".join(f"CAST({k} AS DOUBLE) AS {k}" for k in "abcdef") + " FROM tf"
oracle.PLANES["inv"] = "SELECT stack, frame, e / (a * e - b * d) AS a, -b / (a * e - b * d) AS b, -(e * c - b * f) / (a * e - b * d) AS c, -d / (a * e - b * d) AS d, a / (a * e - b * d) AS e, -(a * f - d * c) / (a * e - b * d) AS f FROM tfd"


@query("transform_algebra", "SELECT stack, frame, round(i.a, 9) + 0 AS a, round(i.b, 9) + 0 AS b, round(i.c * 4, 9) + 0 AS c, round(i.d, 9) + 0 AS d, round(i.e, 9) + 0 AS e, round(i.f * 4, 9) + 0 AS f FROM inv i")
def _(spark: SparkSession, d: str) -> DataFrame:
    inv = geometry.inverse(*[F.col(m) for m in geometry.M])
    large = geometry.rescaled(*[inv[m] for m in geometry.M], 4.0, 4.0)
    return transforms(spark, d).select("stack", "frame", *[(r(large[m], 9) + 0.0).alias(m) for m in geometry.M])  # + 0 makes -0 a plain 0


@query("transform_validate", """
, g AS (SELECT stack, frame, a * (1 + (frame % 11) * 0.03) AS a, b + (frame % 13 - 6) * 0.05 AS b, d - (frame % 13 - 6) * 0.05 AS d, e AS e FROM tfd),
s AS (SELECT *, (sqrt((a + e) * (a + e) + (d - b) * (d - b)) + sqrt((a - e) * (a - e) + (d + b) * (d + b))) / 2 AS l, abs(sqrt((a + e) * (a + e) + (d - b) * (d - b)) - sqrt((a - e) * (a - e) + (d + b) * (d + b))) / 2 AS m FROM g)
SELECT stack, frame, CASE WHEN a * e - b * d <= 0 THEN 'mirrored' WHEN l > 1.25 OR m < 0.8 THEN 'scale' WHEN l / m > 1.03 THEN 'sheared' WHEN abs(degrees(atan2(d - b, a + e))) > 15 THEN 'rotation' END AS reason FROM s""")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("frame")
    t = transforms(spark, d).withColumns({"a": F.col("a") * (1 + (f % 11) * 0.03), "b": F.col("b") + (f % 13 - 6) * 0.05, "d": F.col("d") - (f % 13 - 6) * 0.05})
    return geometry.verdict(t).select("stack", "frame", "reason")


_CUT = "greatest(0, least({n} - 1, s * ({n} - 1) + {t}) - greatest(0, {t}))"


@query("transform_overlap", f"""
, g AS (SELECT stack, frame, 1 + (frame % 11 - 5) * 0.03 AS s, (frame % 31 - 15) * 6.0 AS tx, (frame % 17 - 8) * 5.0 AS ty FROM vec)
SELECT stack, frame, round({_CUT.format(n=120, t='tx')} * {_CUT.format(n=90, t='ty')} / (119.0 * 89.0), 6) AS overlap, {_CUT.format(n=120, t='tx')} * {_CUT.format(n=90, t='ty')} / (119.0 * 89.0) < 0.6 AS apart FROM g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Frames of 90 x 120, scaled and shifted."""
    f = F.col("frame")
    s = 1 + (f % 11 - 5) * 0.03
    zero = F.lit(0.0)
    rows = transforms(spark, d).select("stack", "frame", s.alias("a"), zero.alias("b"), ((f % 31 - 15) * 6.0).alias("c"), zero.alias("d"), s.alias("e"), ((f % 17 - 8) * 5.0).alias("f"))
    return geometry.overlap(rows, 90, 120).select("stack", "frame", r("overlap").alias("overlap"), "apart")


@query("warp_bilinear", """
, p AS (SELECT e.stack, e.frame, e.y, e.x, i.a * e.x + i.b * e.y + i.c AS u, i.d * e.x + i.e * e.y + i.f AS w FROM emb e JOIN inv i ON i.stack = e.stack AND i.frame = e.frame),
q AS (SELECT *, u - floor(u) AS fx, w - floor(w) AS fy, CAST(floor(u) AS INTEGER) AS x0, CAST(floor(w) AS INTEGER) AS y0 FROM p)
SELECT q.stack, q.frame, q.y, q.x, q.u >= -1e-4 AND q.u <= 7 + 1e-4 AND q.w >= -1e-4 AND q.w <= 7 + 1e-4 AS valid,
  round((1 - fy) * ((1 - fx) * a.v + fx * b.v) + fy * ((1 - fx) * c.v + fx * d.v), 3) AS v
FROM q JOIN emb a ON a.stack = q.stack AND a.frame = q.frame AND a.y = least(greatest(y0, 0), 7) AND a.x = least(greatest(x0, 0), 7) JOIN emb b ON b.stack = q.stack AND b.frame = q.frame AND b.y = least(greatest(y0, 0), 7) AND b.x = least(greatest(x0 + 1, 0), 7)
  JOIN emb c ON c.stack = q.stack AND c.frame = q.frame AND c.y = least(greatest(y0 + 1, 0), 7) AND c.x = least(greatest(x0, 0), 7) JOIN emb d ON d.stack = q.stack AND d.frame = q.frame AND d.y = least(greatest(y0 + 1, 0), 7) AND d.x = least(greatest(x0 + 1, 0), 7)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return geometry.warped(rasters.embeddings(spark, d), transforms(spark, d), FRAME, "v", N, N).withColumn("v", r("v", 3))


_DIST = "sqrt(list_sum(list_transform(generate_series(1, 64), lambda i: (CAST(l.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)) * (CAST(l.embedding[i] AS DOUBLE) - CAST(q.embedding[i] AS DOUBLE)))))"


@query("knn_ratio_match", f"""
, pairs AS (SELECT l.stack, l.frame AS left_id, q.frame AS right_id, {_DIST} AS dist FROM vec l JOIN vec q ON q.stack = l.stack WHERE l.frame % 2 = 0 AND q.frame % 2 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY stack, left_id ORDER BY dist, right_id) AS rank FROM pairs),
t AS (SELECT stack, left_id, max(CASE WHEN rank = 1 THEN right_id END) AS right_id, max(CASE WHEN rank = 1 THEN dist END) AS d1, max(CASE WHEN rank = 2 THEN dist END) AS d2 FROM k GROUP BY stack, left_id)
SELECT stack, left_id, right_id, round(d1, 6) AS d1 FROM t WHERE d1 < 0.98 * d2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = rasters.table(spark, d, "embeddings").select(F.col("label").alias("stack"), F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    m = match.ratio_matches(v.filter("id % 2 = 0"), v.filter("id % 2 = 1"), ["stack"], 0.98)
    return m.select("stack", "left_id", "right_id", r("d1").alias("d1"))


def correlated(spark: SparkSession, d: str) -> DataFrame:
    """Each frame's correlation with the first one of its stack."""
    e = rasters.embeddings(spark, d)
    first = e.groupBy("stack").agg(F.min("frame").alias("frame"))
    ref = e.join(first, FRAME, "left_semi").select("stack", "y", "x", F.col("v").alias("ref"))
    return e.join(ref, ["stack", "y", "x"]).groupBy("stack", "frame").agg(match.correlation(F.col("v"), F.col("ref")).alias("score"))


@query("pearson_score", """
, f AS (SELECT stack, min(frame) AS frame FROM emb GROUP BY stack)
SELECT e.stack, e.frame, round(coalesce(corr(e.v, q.v), 0), 6) AS score FROM emb e JOIN f ON f.stack = e.stack JOIN emb q ON q.stack = f.stack AND q.frame = f.frame AND q.y = e.y AND q.x = e.x GROUP BY e.stack, e.frame""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return correlated(spark, d).withColumn("score", r("score"))


@query("median_translation", "SELECT stack, y, median(v % 100) AS dx, median(v % 77) AS dy, count(*) AS inliers FROM emb WHERE v % 3 <> 0 GROUP BY stack, y")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = rasters.embeddings(spark, d).select("stack", "y", (F.col("v") % 100).alias("dx"), (F.col("v") % 77).alias("dy"), (F.col("v") % 3 != 0).alias("inlier"))
    return match.median_shift(e, ["stack", "y"])


oracle.PLANES["against"] = "SELECT s.stack, s.frame, s.gx, s.gy, CAST(e.v AS DOUBLE) - f.v AS residual FROM sobel s JOIN emb e USING (stack, frame, y, x) JOIN f_first f ON f.stack = s.stack AND f.y = s.y AND f.x = s.x"


@query("normal_equations", """
, n AS (SELECT stack, frame, sum(gx * gx) AS h00, sum(gx * gy) AS h01, sum(gy * gy) AS h11, sum(gx * residual) AS g0, sum(gy * residual) AS g1 FROM against GROUP BY stack, frame),
d AS (SELECT *, (h00 + 1e-3) * (h11 + 1e-3) - h01 * h01 AS det FROM n)
SELECT stack, frame, CAST(h00 AS BIGINT) AS h00, CAST(h01 AS BIGINT) AS h01, CAST(h11 AS BIGINT) AS h11, CAST(g0 AS BIGINT) AS g0, CAST(g1 AS BIGINT) AS g1, round(((h11 + 1e-3) * g0 - h01 * g1) / det, 6) + 0 AS d0, round(((h00 + 1e-3) * g1 - h01 * g0) / det, 6) + 0 AS d1 FROM d""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Each frame against the first one of its stack."""
    e = rasters.embeddings(spark, d)
    first = e.join(e.groupBy("stack").agg(F.min("frame").alias("frame")), FRAME, "left_semi").select("stack", "y", "x", F.col("v").alias("first"))
    s = blocks.by_block(e, FRAME, ["v"], N, N, 1, lambda b: dict(zip(("gx", "gy"), arrays.sobel(b["v"].astype(float)))) | {"v": b["v"]}, {"gx": "double", "gy": "double", "v": "double"})
    rows = s.join(first, ["stack", "y", "x"]).withColumn("residual", F.col("v") - F.col("first"))
    n = match.steps(match.normal_equations(rows, FRAME, ["gx", "gy"], "residual"))
    return n.select(*FRAME, *[F.col(c).cast("long").alias(c) for c in ("h00", "h01", "h11", "g0", "g1")], *[(r(c) + 0.0).alias(c) for c in ("d0", "d1")])


_SCORES = "SELECT e.stack, e.frame, coalesce(corr(e.v, q.v), 0) AS score FROM emb e JOIN f_first q ON q.stack = e.stack AND q.y = e.y AND q.x = e.x GROUP BY e.stack, e.frame"


@query("alignment_accept", f"""
, pairs AS (SELECT l.stack, l.frame AS left_id, q.frame AS right_id, {_DIST} AS dist FROM vec l JOIN vec q ON q.stack = l.stack WHERE l.frame % 2 = 0 AND q.frame % 2 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY stack, left_id ORDER BY dist, right_id) AS rank FROM pairs),
t AS (SELECT stack, left_id, max(CASE WHEN rank = 1 THEN dist END) AS d1, max(CASE WHEN rank = 2 THEN dist END) AS d2 FROM k GROUP BY stack, left_id),
n AS (SELECT stack, count(*) AS matches, count(CASE WHEN d1 < 1.15 THEN 1 END) AS inliers FROM t WHERE d1 < 0.98 * d2 GROUP BY stack),
a AS (SELECT stack, frame, score, abs(score) / 3 AS response, coalesce(matches, 0) AS matches, coalesce(inliers, 0) AS inliers FROM ({_SCORES}) LEFT JOIN n USING (stack))
SELECT stack, frame, response >= 0.08 AS by_phase, matches >= 6 AND inliers >= 6 AND inliers >= 0.25 * matches AS by_features, (response >= 0.08 OR (matches >= 6 AND inliers >= 6 AND inliers >= 0.25 * matches)) AND score >= 0.2 AS accepted FROM a""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """By correlation with the stack's first frame and by the matches of the stack's features."""
    v = rasters.table(spark, d, "embeddings").select(F.col("label").alias("stack"), F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    m = match.ratio_matches(v.filter("id % 2 = 0"), v.filter("id % 2 = 1"), ["stack"], 0.98).groupBy("stack").agg(F.count("*").alias("matches"), F.count(F.when(F.col("d1") < 1.15, 1)).alias("inliers"))
    rows = correlated(spark, d).join(m, "stack", "left").withColumns({"response": F.abs("score") / 3, "matches": F.coalesce("matches", F.lit(0)), "inliers": F.coalesce("inliers", F.lit(0))})
    return match.accepted(rows).select("stack", "frame", "by_phase", "by_features", "accepted")


@query("distinct_labels", "SELECT DISTINCT stack, label FROM conf")
def _(spark: SparkSession, d: str) -> DataFrame:
    return choose.labels(scored(spark, d), PIXEL).select("stack", "label").distinct()


@query("quality_metrics", """
, f AS (SELECT stack, min(frame) AS frame FROM emb GROUP BY stack)
SELECT g.stack, round(avg(CAST(g.v - e.v AS DOUBLE) * (g.v - e.v)) / 1e6, 4) AS mse, round(avg(CASE WHEN g.y IN (3, 4) THEN CAST(g.v - e.v AS DOUBLE) * (g.v - e.v) END) / 1e6, 4) AS halo_mse, round(avg(CASE WHEN g.x = 2 THEN CAST(g.v - e.v AS DOUBLE) * (g.v - e.v) END) / 1e6, 4) AS thin_mse
FROM guide g JOIN f ON f.stack = g.stack JOIN emb e ON e.stack = f.stack AND e.frame = f.frame AND e.y = g.y AND e.x = g.x GROUP BY g.stack""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = rasters.embeddings(spark, d)
    want = e.join(e.groupBy("stack").agg(F.min("frame").alias("frame")), FRAME, "left_semi").select("stack", "y", "x", F.col("v").alias("want"))
    got = QUERIES["guide_plane"](spark, d).withColumnRenamed("v", "got")
    rows = got.join(want, ["stack", "y", "x"]).withColumns({"near_edge": F.col("y").isin(3, 4), "thin": F.col("x") == 2})
    return match.quality(rows, PIXEL).select("stack", *[r(F.col(c) / 1e6, 4).alias(c) for c in ("mse", "halo_mse", "thin_mse")])


@query("seam_max", "SELECT stack, CAST(max(abs(v - (v >> 8) * 257)) AS BIGINT) AS seam_max FROM emb GROUP BY stack")
def _(spark: SparkSession, d: str) -> DataFrame:
    """What 8 bits lose, at most."""
    e = rasters.embeddings(spark, d)
    low = e.withColumn("v", pixel.expand8(pixel.reduce16(F.col("v"))))
    return match.seam(e, low, ["stack", "frame"], "v").groupBy("stack").agg(F.max("seam_max").cast("long").alias("seam_max"))


@query("tile_seams", "SELECT CAST(range AS INTEGER) AS frame, CAST(0 AS BIGINT) AS seam_max FROM range(4)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Scores of small blocks against those of one large one: nothing may differ."""
    rows = rasters.focus_bands(spark, 4, 96, 128).select("frame", "y", "x", pixel.luminance(F.col("r"), F.col("g"), F.col("b")).alias("v"))
    rows = held(rows, "bands")
    score = lambda side: blocks.by_block(rows, ["frame"], ["v"], 96, 128, 14, lambda b: {"s": arrays.photographic_score(b["v"], 3, True)}, {"s": "double"}, side=side).withColumn("s", F.round(F.col("s") / 1e6, 3))
    return match.seam(score(24), score(512), ["frame"], "s").select("frame", F.col("seam_max").cast("long").alias("seam_max"))


@query("hash_texture", """
, p AS (SELECT CAST(a.range AS BIGINT) AS y, CAST(b.range AS BIGINT) AS x FROM range(96) a CROSS JOIN range(128) b), h1 AS (SELECT y, x, (x * 374761393 + y * 668265263) & 4294967295 AS h FROM p),
h2 AS (SELECT y, x, (xor(h, h >> 13) * 1274126177) & 4294967295 AS h FROM h1), h3 AS (SELECT y, x, xor(h, h >> 16) AS h FROM h2)
SELECT y, x, 5000 + h % 55000 AS r, 5000 + (h >> 5) % 55000 AS g, 5000 + (h >> 10) % 55000 AS b FROM h3""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = spark.range(96 * 128).select(F.expr("id div 128").alias("y"), (F.col("id") % 128).alias("x"))
    return p.select("y", "x", *[pixel.texture(F.col("x"), F.col("y"), c).alias("rgb"[c]) for c in range(3)])


oracle.PLANES["texture"] = """SELECT frame AS stack, y, x, CAST(5000 + h % 55000 AS DOUBLE) AS r, CAST(5000 + (h >> 5) % 55000 AS DOUBLE) AS g, CAST(5000 + (h >> 10) % 55000 AS DOUBLE) AS b FROM (SELECT frame, y, x, xor(h, h >> 16) AS h FROM (
  SELECT frame, y, x, (xor(h, h >> 13) * 1274126177) & 4294967295 AS h FROM (SELECT CAST(f.range AS INTEGER) AS frame, CAST(a.range AS INTEGER) AS y, CAST(b.range AS INTEGER) AS x, (b.range * 374761393 + a.range * 668265263) & 4294967295 AS h FROM range(4) f CROSS JOIN range(48) a CROSS JOIN range(64) b)))"""
for _kind, _from, _kernel in (("sharp", "texture", focus.bell(*scenes.GRAIN)), ("blurry", "sharp", focus.bell(*scenes.BLUR))):
    for _c in "rgb":
        oracle.PLANES[f"{_kind}_{_c}"] = oracle.separable(_from, PIXEL, _c, "v", _kernel, 48, 64)
    oracle.PLANES[_kind] = f"SELECT r.stack, r.y, r.x, round_even(r.v, 0) AS r, round_even(g.v, 0) AS g, round_even(b.v, 0) AS b FROM {_kind}_r r JOIN {_kind}_g g USING (stack, y, x) JOIN {_kind}_b b USING (stack, y, x)"


@query("focus_band_frames", "SELECT s.stack AS frame, s.y, s.x, " + ", ".join(f"CAST(CASE WHEN s.x * 4 // 64 = s.stack THEN s.{c} ELSE t.{c} END AS INTEGER) AS {c}" for c in "rgb") + " FROM sharp s JOIN blurry t USING (stack, y, x)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rasters.focus_bands(spark, 4, 48, 64)


oracle.PLANES["heads"] = "SELECT o_custkey % 50 AS stack, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS frame, CASE WHEN o_orderkey % 97 = 0 THEN 480 ELSE 512 END AS h, 640 AS w, CASE WHEN o_orderkey % 89 = 0 THEN 8 ELSE 16 END AS depth, CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE 'p' END AS icc FROM orders"


def headers(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    o = rasters.table(spark, d, "orders").withColumn("stack", F.col("o_custkey") % 50)
    frame = F.row_number().over(Window.partitionBy("stack").orderBy("o_orderkey")).cast("long") - 1
    return o.select("stack", frame.alias("frame"), F.when(k % 97 == 0, 480).otherwise(512).alias("h"), F.lit(640).alias("w"), F.when(k % 89 == 0, 8).otherwise(16).alias("depth"), F.when(k % 83 == 0, None).otherwise("p").alias("icc"))


@query("stack_schema_violations", """SELECT a.stack, a.frame, CASE WHEN a.h <> b.h OR a.w <> b.w THEN 'shape' WHEN a.depth <> b.depth THEN 'depth' ELSE 'profile' END AS reason FROM heads a JOIN heads b ON b.stack = a.stack AND b.frame = 0
  WHERE a.frame > 0 AND (a.h <> b.h OR a.w <> b.w OR a.depth <> b.depth OR a.icc IS DISTINCT FROM b.icc)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return listing.violations(headers(spark, d))


@query("dedupe_paths", "SELECT path, CAST(row_number() OVER (ORDER BY o) - 1 AS BIGINT) AS frame FROM (SELECT p_brand || '/' || p_type AS path, min(p_partkey) AS o FROM part GROUP BY 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return listing.deduplicated(rasters.table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("path"), F.col("p_partkey").alias("ordinal")))


@query("output_not_input", "SELECT DISTINCT p_brand AS path FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size < 3)")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = rasters.table(spark, d, "part").select(F.col("p_brand").alias("path"), "p_size")
    return listing.clashes(p.select("path").distinct(), p.filter("p_size < 3").select("path"))


@query("header_rules", "SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'pages' WHEN p_size % 5 = 0 THEN 'not RGB' WHEN p_partkey % 11 = 0 THEN 'depth' WHEN p_partkey % 10 > 8 THEN 'orientation' END AS reason FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    p = rasters.table(spark, d, "part").select(
        "p_partkey", F.when(s % 7 == 0, 2).otherwise(1).alias("pages"), F.when(s % 5 == 0, 1).otherwise(2).alias("photometric"), F.lit(1).alias("planar"), F.lit(3).alias("samples"),
        F.when(k % 11 == 0, 32).otherwise(16).alias("bits"), (k % 10).alias("o"),
    )
    p = p.withColumn("orientation", F.when(F.col("o") == 0, 1).otherwise(F.col("o")))
    return p.select("p_partkey", listing.header_reason().alias("reason"))


@query("run_totals", f"SELECT stack, count(*) AS frames, CAST(sum(bytes) AS BIGINT) AS bytes, round(min(score), 6) AS least FROM (SELECT stack, frame, count(*) * 6 AS bytes FROM emb GROUP BY stack, frame) JOIN ({_SCORES}) USING (stack, frame) GROUP BY stack")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Frames, bytes of their pixels and the least correlation of each stack."""
    sizes = rasters.embeddings(spark, d).groupBy(*FRAME).agg((F.count("*") * 6).alias("bytes"))
    return sizes.join(correlated(spark, d), FRAME).groupBy("stack").agg(F.count("*").alias("frames"), F.sum("bytes").alias("bytes"), r(F.min("score")).alias("least"))


@query("pixel_tenengrad", ORACLE["tenengrad"])
def _(spark: SparkSession, d: str) -> DataFrame:
    """In pixel form."""
    return focus.tenengrad(rasters.embeddings(spark, d), FRAME, F.col("v"), N, N, 3).withColumn("score", r(F.col("score") / 1e6, 4))


@query("block_pyr_down", ORACLE["pyr_down"])
def _(spark: SparkSession, d: str) -> DataFrame:
    kernel = lambda b: [{"v": b["v"].astype(float)}, {"v": arrays.down(b["v"].astype(float))}]
    rows = blocks.by_block(rasters.embeddings(spark, d), FRAME, ["v"], N, N, 4, kernel, {"v": "double"}, grid=2, levels=True)
    return rows.filter("level = 1").drop("level").withColumn("v", r("v", 4))


@query("tiff_roundtrip", "SELECT stack, frame, y, x, r, g, b FROM rgb")
def _(spark: SparkSession, d: str) -> DataFrame:
    import io

    from rasterloom.sources import tiff

    def kernel(b: blocks.Block) -> dict[str, np.ndarray]:
        back = []
        for a in np.stack([b[c] for c in "rgb"], axis=3).astype("<u2"):
            file, (h, w) = io.BytesIO(), a.shape[:2]
            tiff.write(file, [tiff.packed(a.tobytes(), "lzw")], h, w, "lzw", {})
            back.append(tiff.window(tiff.header("a frame", file.getvalue()), 0, h, 0, w))
        return {c: np.stack(back)[..., k] for k, c in enumerate("rgb")}

    return blocks.by_block(rasters.coloured(rasters.embeddings(spark, d)), FRAME, list("rgb"), N, N, 0, kernel, dict.fromkeys("rgb", "int"))


@query("frame_prefix", "SELECT stack, frame, h, w FROM heads WHERE frame < 3 AND stack < 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The first three frames of some stacks."""
    return listing.prefix(headers(spark, d), 3).filter("stack < 10").select("stack", "frame", "h", "w")


@query("best_hypothesis", f"SELECT stack, frame, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY stack ORDER BY round(score, 9) DESC, frame) AS k FROM ({_SCORES})) WHERE k = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = correlated(spark, d).withColumn("score", F.round("score", 9))
    return match.best(rows, ["stack"], "score", "frame").select("stack", "frame", r("score").alias("score"))


@query("size_texts", r"""
, t AS (SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE p_partkey % 7 WHEN 0 THEN 'M' WHEN 1 THEN 'GiB' WHEN 2 THEN '.5 g' WHEN 3 THEN 'TB' WHEN 4 THEN 'x' WHEN 5 THEN 'KiB' ELSE '' END AS said FROM part),
n AS (SELECT *, CASE WHEN regexp_full_match(upper(said), '\\s*[0-9]+(\\.[0-9]+)?\\s*[KMGT]?(I?B)?\\s*') THEN floor(CAST(regexp_extract(upper(said), '([0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) * CASE regexp_extract(upper(said), '[0-9]\\s*([KMGT])', 1) WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 WHEN 'G' THEN 1073741824 WHEN 'T' THEN 1099511627776 ELSE 1 END) END AS bytes FROM t)
SELECT p_partkey, said, CAST(CASE WHEN bytes >= 67108864 THEN bytes ELSE -1 END AS BIGINT) AS bytes FROM n""".replace("\\\\", "\\"))
def _(spark: SparkSession, d: str) -> DataFrame:
    """Sizes as people write them, made of the parts' sizes."""
    unit = F.element_at(F.array(*[F.lit(u) for u in ("M", "GiB", ".5 g", "TB", "x", "KiB", "")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    p = rasters.table(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("said"))
    return p.withColumn("bytes", F.coalesce(listing.size_in_bytes(F.col("said")), F.lit(-1)))


@query("similarity_projection", "SELECT stack, frame, round((a + e) / 2, 9) AS a, round((d - b) / 2, 9) + 0 AS b FROM tfd")
def _(spark: SparkSession, d: str) -> DataFrame:
    a, b = geometry.similar(*[F.col(c) for c in "abde"])
    return transforms(spark, d).select("stack", "frame", r(a, 9).alias("a"), (r(b, 9) + 0.0).alias("b"))


@query("halo_widths", """SELECT quality, CAST(multiscale AS BOOLEAN) AS multiscale, f AS focus_radius, b AS blend_radius,
  CAST(CASE quality WHEN 'standard' THEN CASE WHEN multiscale = 1 THEN 2 * f + 4 ELSE f + 1 END + 1 + b ELSE greatest(3 * f + 1, 2 * f + 8) + 2 + b + CASE quality WHEN 'high' THEN 28 ELSE 60 END END AS INTEGER) AS halo
FROM (VALUES ('standard'), ('high'), ('max')) q(quality) CROSS JOIN (VALUES (0), (1)) m(multiscale) CROSS JOIN (VALUES (1), (3), (9)) r(f) CROSS JOIN (VALUES (0), (8)) s(b)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    from rasterloom.plans.settings import QUALITIES, Settings

    rows = [(q, m, f, b, Settings(quality=q, multiscale=m, focus_radius=f, blend_radius=b).checked().halo) for q in QUALITIES for m in (False, True) for f in (1, 3, 9) for b in (0, 8)]
    return spark.createDataFrame(rows, "quality string, multiscale boolean, focus_radius int, blend_radius int, halo int")


_REFUSALS = [("tile_size", "8"), ("tile_size", "auto"), ("quality", "low"), ("tile_overlap", "12"), ("tile_overlap", "13"), ("focus_radius", "0"), ("blend_radius", "-1"), ("compression", "jpeg"), ("memory_budget", "1M"), ("memory_budget", "64M"), ("max_workers", "33"), ("alignment", "shear"), ("alignment_max_dim", "31"), ("alignment_max_dim", "32")]


@query("settings_rules", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{t}', {str((n, t) in [('tile_size', 'auto'), ('tile_overlap', '13'), ('memory_budget', '64M'), ('alignment_max_dim', '32')]).lower()})" for n, t in _REFUSALS) + ") v(name, said, accepted)")
def _(spark: SparkSession, d: str) -> DataFrame:
    from rasterloom.plans.settings import KNOBS, Settings
    from rasterloom.sources.tiff import Refused

    def accepted(name: str, said: str) -> bool:
        try:
            Settings.given(**{name: KNOBS[name].read(said)}).checked()
        except Refused:
            return False
        return True

    return spark.createDataFrame([(n, t, accepted(n, t)) for n, t in _REFUSALS], "name string, said string, accepted boolean")


#: Files of a hashed texture, 48 x 64, written anew for each query; what they hold is the plane ``sharp``.
_FORMS = [("none", None, False), ("zlib", 16, False), ("lzw", None, True), ("zstd", None, False)]
_SHARP = "CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b FROM sharp WHERE stack = 0"


def texture_files(spark: SparkSession) -> list[str]:
    """The same image in several layouts and compressions."""
    import os

    from rasterloom.plans import stack
    from rasterloom.plans.settings import Settings
    from rasterloom.sources import transcode

    folder = stack.shared_folder(spark, Settings())
    plain = scenes.band_frame(os.path.join(folder, "plain.tif"), 48, 64, 0, 1)
    return [transcode.transcoded(plain, os.path.join(folder, f"{k}.tif"), c, tile, single).path for k, (c, tile, single) in enumerate(_FORMS)]


@query("file_headers", "SELECT * FROM (VALUES " + ", ".join(f"({k}, 48, 64, 16, 1, {str(c != 'none').lower()})" for k, (c, _, _) in enumerate(_FORMS)) + ") v(frame, h, w, depth, orientation, packed)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """By the data source, from headers alone."""
    import os

    from rasterloom.sources import source

    source.register(spark)
    paths = texture_files(spark)
    os.remove(os.path.join(os.path.dirname(paths[0]), "plain.tif"))
    return spark.read.format("rasterloom").load(os.path.dirname(paths[0])).select("frame", "h", "w", "depth", "orientation", "packed")


@query("file_pixels", f"SELECT CAST(f.range AS INTEGER) AS frame, y, x, {_SHARP.replace('FROM sharp', 'FROM range(4) f CROSS JOIN sharp')}")
def _(spark: SparkSession, d: str) -> DataFrame:
    from rasterloom.sources import frames, tiff

    return frames.pixels(spark, [tiff.header(p) for p in texture_files(spark)])


@query("file_windows", f"SELECT CAST(f.range AS INTEGER) AS frame, y, x, {_SHARP.replace('FROM sharp', 'FROM range(1, 3) f CROSS JOIN sharp')} AND y // 20 = 1 AND x // 20 IN (1, 2)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of two of the files under a box, by the data source's pushed filters."""
    import os

    from rasterloom.sources import source

    source.register(spark)
    paths = texture_files(spark)
    os.remove(os.path.join(os.path.dirname(paths[0]), "plain.tif"))
    rows = spark.read.format("rasterloom").option("form", "blocks").option("side", 20).load(os.path.dirname(paths[0]))
    rows = rows.filter("frame >= 1 and frame < 3 and y0 = 20 and x0 >= 20 and x1 <= 60")
    at = F.explode(F.sequence(F.lit(0), (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")) - 1))
    rows = rows.select("frame", "y0", "x0", (F.col("x1") - F.col("x0")).alias("n"), F.hex("data").alias("hex"), at.alias("k"))
    word = lambda c: F.conv(F.concat(F.substring("hex", F.col("k") * 12 + 4 * c + 3, F.lit(2)), F.substring("hex", F.col("k") * 12 + 4 * c + 1, F.lit(2))), 16, 10).cast("int")
    return rows.select("frame", F.expr("cast(y0 + k div n as int)").alias("y"), F.expr("cast(x0 + k % n as int)").alias("x"), *[word(c).alias("rgb"[c]) for c in range(3)])


@query("file_grey", """
, g AS (SELECT y * 12 // 48 AS y, x * 16 // 64 AS x, ((CAST(r AS BIGINT) >> 8) * 4899 + (CAST(g AS BIGINT) >> 8) * 9617 + (CAST(b AS BIGINT) >> 8) * 1868 + 8192) >> 14 AS v FROM sharp WHERE stack = 0)
SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, CAST(round_even(avg(v), 0) AS INTEGER) AS v FROM g GROUP BY y, x""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The reduced grey that comes with the decoding of a packed file."""
    from rasterloom.plans.tasks import Crew
    from rasterloom.sources import frames, tiff

    packed = tiff.header(texture_files(spark)[1])
    plain, plane = frames.plain_form(packed, packed.path + ".raw")
    plane.made()
    crew = Crew(spark)
    crew.run("decoding", frames.bands(packed), lambda b: frames.unpacked(packed, plane, *b, 16))
    (grey,) = crew.run("grey", [0], lambda _: frames.grey_of(plain, packed, 16))
    return spark.createDataFrame([(y, x, int(v)) for (y, x), v in np.ndenumerate(grey)], "y int, x int, v int")


@query("run_of_equal_frames", f"SELECT y, x, {_SHARP}")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A whole run on one image in four layouts gives the image, in tiles and packed strips."""
    import os

    from rasterloom.plans import stack
    from rasterloom.plans.settings import Settings
    from rasterloom.sources import frames, tiff

    paths = texture_files(spark)
    out = os.path.join(os.path.dirname(paths[0]), "merged.tif")
    stack.stack(spark, paths, out, Settings(alignment="none", tile_size=32, compression="lzw"))
    return frames.pixels(spark, [tiff.header(out)]).drop("frame")


_MOVES = [(0.0, 1.0, 0.0, 0.0), (2.0, 1.02, 3.0, 5.0), (-3.0, 0.97, 4.0, 6.0), (9.0, 1.0, -8.0, 12.0), (0.0, 1.0, 6.0, -4.0), (-6.0, 1.1, 8.0, -10.0)]


@query("aligned_frames", "SELECT * FROM (VALUES " + ", ".join(f"({k}, CAST({t} AS DOUBLE), CAST({s} AS DOUBLE), true, true)" for k, (t, s, _, _) in enumerate(_MOVES)) + ") v(frame, turn, scale, places, score)")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Frames turned, scaled and shifted by known amounts: what alignment finds, and whether corners land within half a pixel."""
    from rasterloom.operators import register
    from rasterloom.plans.tasks import Crew

    def work(move: tuple[float, float, float, float]) -> tuple[float, float, bool, bool]:
        turn, scale, dx, dy = move
        scene = arrays.smooth(scenes.hashed(0, 200, 0, 240)[0].astype(float) / 256, 3)
        t = np.radians(turn)
        m = np.array([[scale * np.cos(t), -scale * np.sin(t), dx], [scale * np.sin(t), scale * np.cos(t), dy]])
        frame = arrays.warped(scene, m, (0, 200, 0, 240), (0, 0), scene.shape)[0]
        fit = register.fit(scene, frame, "affine")
        corners = np.array([[20, 20, 1], [220, 20, 1], [120, 180, 1]], float)
        found = complex(fit.matrix[0, 0], fit.matrix[1, 0])
        return round(np.degrees(np.angle(found)), 1) + 0.0, round(abs(found), 2), bool(np.abs(corners @ (fit.matrix - m).T).max() < 0.5), fit.score > 0.9

    rows = Crew(spark).run("fitting", _MOVES, work)
    return spark.createDataFrame([(k, *map(lambda v: v if isinstance(v, bool) else float(v), map(lambda v: v.item() if isinstance(v, np.generic) else v, row))) for k, row in enumerate(rows)], "frame int, turn double, scale double, places boolean, score boolean")


@query("stacked_files", None)  # a whole run: files written, merged, read back; tests hold its parts to account
def _(spark: SparkSession, d: str) -> DataFrame:
    """Two frames of the events' raster, each blurred in one half, and the merged result."""
    import os

    from rasterloom.plans import stack
    from rasterloom.plans.settings import Settings
    from rasterloom.sources import frames, tiff

    settings = Settings(quality="max", alignment="none", tile_size=48)
    folder = stack.shared_folder(spark, settings)
    rows = events_raster(spark, d).groupBy("y", "x").agg(F.sum("v").alias("v")).toPandas()  # 70 x 90 places, whatever the data's size
    a = np.zeros((70, 90))
    a[rows.y, rows.x] = rows.v.astype(float)
    sharp = arrays.to_u16(arrays.smooth(np.repeat(a[None] * (60000 / max(a.max(), 1)), 3, 0), 3)).astype(float)
    soft, paths = arrays.smooth(sharp, 9), []
    for k, half in enumerate((slice(0, 45), slice(45, 90))):
        image = soft.copy()
        image[..., half] = sharp[..., half]
        image = arrays.to_u16(image).transpose(1, 2, 0).astype("<u2")
        paths.append(os.path.join(folder, f"{k}.tif"))
        with open(paths[-1], "wb") as f:
            tiff.write(f, [tiff.packed(image[y : y + 64].tobytes(), "zlib") for y in range(0, 70, 64)], 70, 90, "zlib", {})
    out = os.path.join(folder, "merged.tif")
    stack.stack(spark, paths, out, settings)
    return frames.pixels(spark, [tiff.header(out)]).drop("frame")
