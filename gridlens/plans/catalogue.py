"""The registered queries of the engine, each with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlens.functions import elementwise as E
from gridlens.operators import aggregates as A, kernels, metrics as M, puzzle as P, report as R, sampling as S, stencils as X
from gridlens.operators.images import SIDE, images, logits, to_long

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: 30 clues and one solution; 24 clues and 19 solutions; two equal digits in a row; a full grid.
PUZZLES = {
    1: "53..7....6..195....98....6.8...6...34..8.3..17...2...6.6....28....419..5....8..79",
    2: "...8.3....3..1..5...9...2..7..1.8..9.2.....8.1..4.9..3..8...1...5..9..7....7.4...",
    3: "55..7....6..195....98....6.8...6...34..8.3..17...2...6.6....28....419..5....8..79",
    4: "534678912672195348198342567859761423426853791713924856961537284287419635345286179",
}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, digits: int = 6):
    return F.round(c, digits)


_IMG = "img AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 0.6) / 1.2 * 256))) AS INTEGER)) AS px FROM embeddings)"
_PIX = _IMG + ", pix AS (SELECT vec_id, label, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y, px[i + 1] AS v FROM (SELECT vec_id, label, px, unnest(range(64)) AS i FROM img))"
_NEAR = _PIX + ", d AS (SELECT unnest([-1, 0, 1]) AS dx), near AS (SELECT a.vec_id, a.x, a.y, dx.dx, dy.dx AS dy, b.v FROM pix a, d dx, d dy, pix b WHERE a.vec_id = b.vec_id AND b.x = a.x + dx.dx AND b.y = a.y + dy.dx)"
_LOGIT = "lg AS (SELECT vec_id, label, list_transform(range(1, 11), lambda k: list_sum(list_transform(embedding[k:len(embedding):10], lambda v: CAST(v AS DOUBLE)))) AS z FROM embeddings)"
_PRED = _LOGIT + ", pr AS (SELECT label AS actual, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS predicted FROM lg)"
_CLASS = _PRED + """, per AS (
  SELECT c AS class, (SELECT count(*) FROM pr WHERE actual = c AND predicted = c) AS tp,
         (SELECT count(*) FROM pr WHERE actual <> c AND predicted = c) AS fp, (SELECT count(*) FROM pr WHERE actual = c AND predicted <> c) AS fn
  FROM (SELECT CAST(unnest(range(10)) AS INTEGER) AS c)
), ratio AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS p, coalesce(tp / nullif(tp + fn, 0), 0.0) AS r FROM per)
, m AS (SELECT class, tp, fp, fn, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f1 FROM ratio)"""


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).select(F.col("label").alias("actual"), E.argmax("logits").alias("predicted"))


# -- classifier output ------------------------------------------------------------------


@query("argmax_label", f"WITH {_LOGIT} SELECT vec_id, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS predicted FROM lg")
def argmax_label(spark, d):
    return logits(spark, d).select("vec_id", E.argmax("logits").alias("predicted"))


@query("softmax_top1", f"WITH {_LOGIT}, e AS (SELECT vec_id, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM lg) SELECT vec_id, round(list_max(e) / list_sum(e), 6) AS top_p FROM e")
def softmax_top1(spark, d):
    return logits(spark, d).select("vec_id", _r(F.array_max(E.softmax("logits"))).alias("top_p"))


@query(
    "cross_entropy_by_label",
    f"WITH {_LOGIT}, e AS (SELECT label, list_transform(z, lambda v: exp(v - list_max(z))) AS e FROM lg) SELECT label, round(avg(-ln(e[label + 1] / list_sum(e) + 1e-7)), 6) AS loss, count(*) AS n FROM e GROUP BY label",
)
def cross_entropy_by_label(spark, d):
    loss = E.cross_entropy(E.softmax("logits"), E.one_hot("label"))
    return logits(spark, d).select("label", loss.alias("loss")).groupBy("label").agg(_r(F.avg("loss")).alias("loss"), F.count(F.lit(1)).alias("n"))


@query("accuracy_overall", f"WITH {_PRED} SELECT round(avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM pr")
def accuracy_overall(spark, d):
    return M.accuracy(_predicted(spark, d)).select(_r("accuracy").alias("accuracy"), "n")


@query("confusion_matrix", f"WITH {_PRED} SELECT actual, predicted, count(*) AS n FROM pr GROUP BY ALL")
def confusion_matrix(spark, d):
    return M.confusion(_predicted(spark, d))


@query("class_metrics", f'WITH {_CLASS} SELECT class, tp, fp, fn, round(p, 6) AS "precision", round(r, 6) AS recall, round(f1, 6) AS f1 FROM m')
def class_metrics(spark, d):
    return M.per_class(_predicted(spark, d)).select("class", "tp", "fp", "fn", *[_r(c).alias(c) for c in ("precision", "recall", "f1")])


@query("macro_f1", f"WITH {_CLASS} SELECT round(avg(f1), 6) AS macro_f1 FROM m")
def macro_f1(spark, d):
    return M.macro_f1(_predicted(spark, d)).select(_r("macro_f1").alias("macro_f1"))


@query("metric_lines", f"WITH {_CLASS} SELECT class, printf('class %d: precision %.4f recall %.4f f1 %.4f', class, p, r, f1) AS line FROM m")
def metric_lines(spark, d):
    return M.formatted(M.per_class(_predicted(spark, d)))


@query(
    "digit_candidates",
    f"WITH {_LOGIT}, c AS (SELECT vec_id, unnest(range(1, 10)) AS digit, unnest(z[2:10]) AS prob FROM lg), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, digit) AS rank FROM c) SELECT vec_id, CAST(rank AS INTEGER) AS rank, CAST(digit AS INTEGER) AS digit, round(prob, 6) AS prob FROM k WHERE rank <= 5",
)
def digit_candidates(spark, d):
    rows = logits(spark, d).select("vec_id", F.posexplode(E.candidates("logits")).alias("at", "c"))
    return rows.select("vec_id", (F.col("at") + 1).alias("rank"), "c.digit", _r(F.col("c.prob").cast("double")).alias("prob"))


@query(
    "cell_order",
    f"WITH {_LOGIT}, b AS (SELECT vec_id, label, list_max(z[2:10]) AS prob FROM lg), k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY prob DESC, vec_id) AS place FROM b) SELECT label, CAST(place AS INTEGER) AS place, vec_id, round(prob, 6) AS prob FROM k WHERE place <= 81",
)
def cell_order(spark, d):
    """The 81 surest cells of each label."""
    best = logits(spark, d).select("vec_id", "label", E.best_digit("logits").cast("double").alias("prob"))
    return A.top_k(best, [F.desc("prob"), F.col("vec_id")], 81, ["label"]).select("label", F.col("rank").alias("place"), "vec_id", _r("prob").alias("prob"))


_ACTS = {"relu": "greatest(x, 0.0)", "relu_d": "CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END", "sigmoid": "1 / (1 + exp(-x))", "sigmoid_d": "1 / (1 + exp(-x)) * (1 - 1 / (1 + exp(-x)))", "tanh": "tanh(x)", "tanh_d": "1 - tanh(x) * tanh(x)"}


@query("activations", "SELECT vec_id, " + ", ".join(f"round(list_sum(list_transform(xs, lambda x: CAST({q} AS DOUBLE))), 6) AS {n}" for n, q in _ACTS.items()) + " FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS xs FROM embeddings)")
def activations(spark, d):
    """Sums of the activations and their derivatives over each vector."""
    made = {"relu": E.relu, "relu_d": E.relu_derivative, "sigmoid": E.sigmoid, "sigmoid_d": E.sigmoid_derivative, "tanh": F.tanh, "tanh_d": E.tanh_derivative}

    def total(f):
        return _r(F.aggregate(F.transform("embedding", lambda v: f(v.cast("double"))), F.lit(0.0), lambda s, v: s + v))

    return _table(spark, d, "embeddings").select("vec_id", *[total(f).alias(n) for n, f in made.items()])


# -- pixels -----------------------------------------------------------------------------


@query("pixel_histogram", f"WITH {_PIX} SELECT v AS bin, count(*) AS n FROM pix GROUP BY v")
def pixel_histogram(spark, d):
    return A.histogram(to_long(images(spark, d), [], "px"), [], "v")


_OTSU = """, h AS (SELECT {key} v AS bin, count(*) AS n FROM src GROUP BY ALL), c AS (
  SELECT {key} bin, CAST(sum(n) OVER w AS DOUBLE) AS total, CAST(sum(bin * n) OVER w AS DOUBLE) AS mass, CAST(sum(n) OVER u AS DOUBLE) AS wb, CAST(sum(bin * n) OVER u AS DOUBLE) AS sb
  FROM h WINDOW w AS (PARTITION BY {part}), u AS (PARTITION BY {part} ORDER BY bin ROWS UNBOUNDED PRECEDING)
), b AS (SELECT {key} bin, coalesce(wb * (total - wb) * (sb / wb - (mass - sb) / nullif(total - wb, 0)) * (sb / wb - (mass - sb) / nullif(total - wb, 0)), 0) AS between_var FROM c)
, k AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY between_var DESC, bin) AS rn FROM b)
SELECT {key} CAST(CASE WHEN between_var > 0 THEN bin ELSE 0 END AS INTEGER) AS threshold FROM k WHERE rn = 1"""


@query("otsu_threshold", "WITH src AS (SELECT CAST(greatest(0, floor(least(value, 255))) AS INTEGER) AS v FROM events WHERE value IS NOT NULL)" + _OTSU.format(key="", part="1"))
def otsu_threshold(spark, d):
    values = _table(spark, d, "events").where("value IS NOT NULL").select(E.clamp(F.floor(F.least("value", F.lit(255.0))), 0, 255).cast("int").alias("v"))
    return A.otsu(values, [], "v")


@query("otsu_per_image", f"WITH {_PIX}, src AS (SELECT vec_id, v FROM pix)" + _OTSU.format(key="vec_id,", part="vec_id"))
def otsu_per_image(spark, d):
    return A.otsu(to_long(images(spark, d), ["vec_id"], "px"), ["vec_id"], "v")


@query("binarize_fill_ratio", f"WITH {_PIX} SELECT vec_id, avg(CASE WHEN v > 128 THEN 1.0 ELSE 0.0 END) AS ratio, avg(CASE WHEN v > 128 THEN 1.0 ELSE 0.0 END) < 0.05 AS is_empty, CAST(sum(CASE WHEN v > 128 THEN 255 ELSE 0 END) AS BIGINT) AS lit FROM pix GROUP BY vec_id")
def binarize_fill_ratio(spark, d):
    lit = F.aggregate(E.threshold_binary("px", 128), F.lit(0).cast("long"), lambda a, v: a + v)
    return images(spark, d).select("vec_id", E.fill_ratio("px").alias("ratio"), E.is_empty("px").alias("is_empty"), lit.alias("lit"))


@query("invert_normalize", f"WITH {_PIX} SELECT vec_id, CAST(sum(255 - v) AS BIGINT) AS inverted, round(sum(v / 255.0), 6) AS normalised FROM pix GROUP BY vec_id")
def invert_normalize(spark, d):
    inverted = F.aggregate(E.invert("px"), F.lit(0).cast("long"), lambda a, v: a + v)
    return images(spark, d).select("vec_id", inverted.alias("inverted"), _r(F.aggregate(E.normalise("px"), F.lit(0.0), lambda a, v: a + v)).alias("normalised"))


@query("rgb_gray", f"WITH {_IMG} SELECT vec_id, CAST(list_sum(list_transform(range(64), lambda i: trunc(0.299::DOUBLE * px[i + 1] + 0.587::DOUBLE * px[64 - i] + 0.114::DOUBLE * px[i * 7 % 64 + 1]))) AS BIGINT) AS gray, CAST(len(px) * 3 AS INTEGER) AS n_rgb, CAST(list_sum(px) * 3 AS BIGINT) AS rgb FROM img")
def rgb_gray(spark, d):
    """Gray of 64 colours made of each image's pixels, and the image as RGB."""
    gray = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: E.rgb_to_gray(F.get("px", i), F.get("px", 63 - i), F.get("px", i * 7 % 64)))

    def total(c):
        return F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)

    return images(spark, d).select("vec_id", total(gray).alias("gray"), F.size(E.gray_to_rgb("px")).alias("n_rgb"), total(E.gray_to_rgb("px")).alias("rgb"))


_MASS = _PIX + ", cm AS (SELECT vec_id, coalesce(CAST(sum(x * v) AS DOUBLE) / nullif(CAST(sum(v) AS DOUBLE), 0), 4.0) AS cx, coalesce(CAST(sum(y * v) AS DOUBLE) / nullif(CAST(sum(v) AS DOUBLE), 0), 4.0) AS cy FROM pix GROUP BY vec_id)"


@query("center_of_mass", f"WITH {_MASS} SELECT vec_id, round(cx, 6) AS cx, round(cy, 6) AS cy FROM cm")
def center_of_mass(spark, d):
    c = X.centre_of_mass("px", SIDE, SIDE)
    return images(spark, d).select("vec_id", c.alias("c")).select("vec_id", _r("c.x").alias("cx"), _r("c.y").alias("cy"))


@query("center_shift", f"WITH {_MASS} SELECT a.vec_id, a.x, a.y, coalesce(b.v, 0) AS v FROM pix a JOIN cm USING (vec_id) LEFT JOIN pix b ON b.vec_id = a.vec_id AND b.x = a.x - CAST(trunc(4 - cx) AS INTEGER) AND b.y = a.y - CAST(trunc(4 - cy) AS INTEGER)")
def center_shift(spark, d):
    # the shift is worked out once a row, not once a pixel
    c = X.centre_of_mass("px", SIDE, SIDE)
    moved = images(spark, d).select("vec_id", "px", c.alias("c")).select("vec_id", "px", E.trunc_int(SIDE / 2 - F.col("c.x")).alias("dx"), E.trunc_int(SIDE / 2 - F.col("c.y")).alias("dy"))
    return to_long(moved, ["vec_id"], X.shift("px", SIDE, SIDE, F.col("dx"), F.col("dy")))


@query("image_stats", f"WITH {_PIX} SELECT vec_id, min(v) AS min_value, max(v) AS max_value, round(avg(v), 6) AS mean_value FROM pix GROUP BY vec_id")
def image_stats(spark, d):
    out = A.statistics(to_long(images(spark, d), ["vec_id"], "px"), ["vec_id"], "v")
    return out.select("vec_id", "min_value", "max_value", _r("mean_value").alias("mean_value"))


# -- neighbourhoods ---------------------------------------------------------------------


@query("dilate3", f"WITH {_NEAR} SELECT vec_id, x, y, max(v) AS v FROM near GROUP BY ALL")
def dilate3(spark, d):
    return to_long(images(spark, d), ["vec_id"], X.dilate("px", SIDE, SIDE, 3))


@query("erode3", f"WITH {_NEAR} SELECT vec_id, x, y, min(v) AS v FROM near GROUP BY ALL")
def erode3(spark, d):
    return to_long(images(spark, d), ["vec_id"], X.erode("px", SIDE, SIDE, 3))


@query("median3", f"WITH {_NEAR} SELECT vec_id, x, y, list_sort(list(v))[len(list(v)) // 2 + 1] AS v FROM near GROUP BY vec_id, x, y")
def median3(spark, d):
    return to_long(images(spark, d), ["vec_id"], X.median("px", SIDE, SIDE, 3))


@query(
    "sobel_mag",
    f"WITH {_NEAR}, g AS (SELECT vec_id, x, y, sum(v * dx * (2 - abs(dy))) AS gx, sum(v * dy * (2 - abs(dx))) AS gy FROM near GROUP BY ALL) SELECT vec_id, x, y, CAST(CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN least(255, trunc(sqrt(CAST(gx * gx + gy * gy AS DOUBLE)))) ELSE 0 END AS INTEGER) AS v FROM g",
)
def sobel_mag(spark, d):
    return to_long(images(spark, d), ["vec_id"], X.sobel("px", SIDE, SIDE))


@query(
    "gauss3_replicate",
    f"WITH {_PIX}, d AS (SELECT unnest([-1, 0, 1]) AS dx) SELECT a.vec_id, a.x, a.y, CAST(sum(b.v * (2 - abs(p.dx)) * (2 - abs(q.dx))) AS INTEGER) AS v FROM pix a, d p, d q, pix b WHERE a.vec_id = b.vec_id AND b.x = least(7, greatest(0, a.x + p.dx)) AND b.y = least(7, greatest(0, a.y + q.dx)) GROUP BY a.vec_id, a.x, a.y",
)
def gauss3_replicate(spark, d):
    return to_long(images(spark, d), ["vec_id"], X.convolve("px", SIDE, SIDE, [[1, 2, 1], [2, 4, 2], [1, 2, 1]]))


@query("maxpool2", f"WITH {_PIX} SELECT vec_id, CAST(x // 2 AS INTEGER) AS x, CAST(y // 2 AS INTEGER) AS y, max(v) AS v FROM pix GROUP BY vec_id, x // 2, y // 2")
def maxpool2(spark, d):
    return to_long(images(spark, d), ["vec_id"], X.max_pool("px", SIDE, SIDE, 2), SIDE // 2)


@query(
    "conv3_valid",
    f"WITH {_NEAR} SELECT vec_id, x - 1 AS x, y - 1 AS y, CAST(sum(v * ((dx + 1) - 2 * (dy + 1) + 1)) AS INTEGER) AS v FROM near WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY vec_id, x, y",
)
def conv3_valid(spark, d):
    kernel = [[j - 2 * i + 1 for j in range(3)] for i in range(3)]
    return to_long(images(spark, d), ["vec_id"], X.conv_valid("px", SIDE, SIDE, kernel), SIDE - 2)


@query(
    "dense_dot",
    f"WITH {_PIX}, o AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS o) SELECT vec_id, o AS unit, CAST(greatest(0, sum(v * (((x + 8 * y) * (o + 1)) % 5 - 2)) + o) AS DOUBLE) AS v FROM pix, o GROUP BY vec_id, o",
)
def dense_dot(spark, d):
    """Three units of fixed weights."""
    weights = F.array(*[F.lit(float(i * (o + 1) % 5 - 2)) for o in range(3) for i in range(64)])
    bias = F.array(*[F.lit(float(o)) for o in range(3)])
    return images(spark, d).select("vec_id", F.posexplode(E.dense("px", weights, bias, 64, 3)).alias("unit", "v"))


@query(
    "resize_bilinear",
    f"""WITH {_PIX}, t AS (SELECT a.t AS tx, b.t AS ty FROM (SELECT unnest(range(6)) AS t) a, (SELECT unnest(range(6)) AS t) b),
s AS (SELECT *, tx * (8.0::DOUBLE / 6) AS sx, ty * (8.0::DOUBLE / 6) AS sy FROM t), c AS (SELECT *, CAST(floor(sx) AS INTEGER) AS x0, CAST(floor(sy) AS INTEGER) AS y0 FROM s),
w AS (SELECT *, least(x0 + 1, 7) AS x1, least(y0 + 1, 7) AS y1, sx - x0 AS fx, sy - y0 AS fy FROM c)
SELECT p.vec_id, CAST(tx AS INTEGER) AS x, CAST(ty AS INTEGER) AS y, CAST(trunc((p.v * (1 - fx) + q.v * fx) * (1 - fy) + (r.v * (1 - fx) + s4.v * fx) * fy) AS INTEGER) AS v
FROM w JOIN pix p ON p.x = x0 AND p.y = y0 JOIN pix q ON q.vec_id = p.vec_id AND q.x = x1 AND q.y = y0 JOIN pix r ON r.vec_id = p.vec_id AND r.x = x0 AND r.y = y1 JOIN pix s4 ON s4.vec_id = p.vec_id AND s4.x = x1 AND s4.y = y1""",
)
def resize_bilinear(spark, d):
    return to_long(images(spark, d), ["vec_id"], X.resize("px", SIDE, SIDE, 6, 6), 6)


@query("crop_margin", f"WITH {_PIX} SELECT vec_id, x - 1 AS x, y - 1 AS y, v FROM pix WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6")
def crop_margin(spark, d):
    return to_long(images(spark, d), ["vec_id"], E.crop_margin("px", SIDE, SIDE, 0.2), SIDE - 2)


# -- shapes -----------------------------------------------------------------------------


def _lit(spark, d):
    return to_long(images(spark, d), ["vec_id"], "px").where("v > 128")


@query(
    "blob_corners",
    f"""WITH {_PIX}, l AS (SELECT * FROM pix WHERE v > 128), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x + y, y, x) AS a, row_number() OVER (PARTITION BY vec_id ORDER BY y - x, y, x) AS b,
row_number() OVER (PARTITION BY vec_id ORDER BY x + y DESC, y, x) AS c, row_number() OVER (PARTITION BY vec_id ORDER BY y - x DESC, y, x) AS e FROM l)
SELECT vec_id, max(x) FILTER (a = 1) AS tl_x, max(y) FILTER (a = 1) AS tl_y, max(x) FILTER (b = 1) AS tr_x, max(y) FILTER (b = 1) AS tr_y, max(x) FILTER (c = 1) AS br_x, max(y) FILTER (c = 1) AS br_y, max(x) FILTER (e = 1) AS bl_x, max(y) FILTER (e = 1) AS bl_y FROM k GROUP BY vec_id""",
)
def blob_corners(spark, d):
    return A.blob_corners(_lit(spark, d), ["vec_id"])


@query("bounding_box", f"WITH {_PIX} SELECT vec_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, count(*) AS area FROM pix WHERE v > 128 GROUP BY vec_id")
def bounding_box(spark, d):
    return _lit(spark, d).groupBy("vec_id").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), F.count(F.lit(1)).alias("area"))


_VOTES = _PIX + ", th AS (SELECT CAST(unnest(range(180)) AS INTEGER) AS theta), votes AS (SELECT vec_id, theta, CAST(trunc(round(x * cos(radians(theta)) + y * sin(radians(theta)), 9)) AS INTEGER) AS rho, count(*) AS votes FROM pix, th WHERE v > 128 GROUP BY ALL)"


def _hough(spark, d):
    return A.hough_votes(_lit(spark, d), ["vec_id"], 180, 1)


@query("hough_votes", f"WITH {_VOTES} SELECT vec_id, theta, count(*) AS cells, CAST(sum(votes) AS BIGINT) AS votes, max(votes) AS most, CAST(sum(rho * votes) AS BIGINT) AS moment FROM votes GROUP BY vec_id, theta")
def hough_votes(spark, d):
    """The accumulator, added up per angle."""
    return _hough(spark, d).groupBy("vec_id", "theta").agg(F.count(F.lit(1)).alias("cells"), F.sum("votes").alias("votes"), F.max("votes").alias("most"), F.sum(F.col("rho") * F.col("votes")).alias("moment"))


@query(
    "hough_peaks",
    f"WITH {_VOTES}, o AS (SELECT unnest([-1, 0, 1]) AS o), near AS (SELECT v.vec_id, CAST(v.theta + a.o AS INTEGER) AS theta, CAST(v.rho + b.o AS INTEGER) AS rho, max(v.votes) AS most FROM votes v, o a, o b GROUP BY ALL) SELECT v.vec_id, v.theta, v.rho, v.votes FROM votes v JOIN near USING (vec_id, theta, rho) WHERE votes > 3 AND votes >= most",
)
def hough_peaks(spark, d):
    return A.hough_peaks(_hough(spark, d), ["vec_id"], 3)


@query(
    "top_lines",
    f"WITH {_VOTES}, t AS (SELECT *, CASE WHEN theta < 30 OR theta > 150 THEN 'v' WHEN theta > 60 AND theta < 120 THEN 'h' END AS direction FROM votes), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id, direction ORDER BY votes DESC, theta, rho) AS rank FROM t WHERE direction IS NOT NULL) SELECT vec_id, direction, CAST(rank AS INTEGER) AS rank, theta, rho, votes FROM k WHERE rank <= 20",
)
def top_lines(spark, d):
    return A.top_lines(_hough(spark, d), ["vec_id"], 20).select("vec_id", "direction", "rank", "theta", "rho", "votes")


@query(
    "line_crossings",
    "WITH l AS (SELECT vec_id, CAST(label AS DOUBLE) AS r1, CAST(vec_id % 90 AS DOUBLE) AS t1, CAST(10 - label AS DOUBLE) AS r2, CAST(vec_id % 60 AS DOUBLE) AS t2 FROM embeddings), p AS (SELECT *, cos(radians(t1)) * sin(radians(t2)) - sin(radians(t1)) * cos(radians(t2)) AS det FROM l) SELECT vec_id, round((sin(radians(t2)) * r1 - sin(radians(t1)) * r2) / det, 4) AS x, round((cos(radians(t1)) * r2 - cos(radians(t2)) * r1) / det, 4) AS y FROM p WHERE abs(det) >= 1e-10",
)
def line_crossings(spark, d):
    """Where lines made of ids and labels meet; parallel ones drop out."""
    rows = _table(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("r1"), (F.col("vec_id") % 90).cast("double").alias("t1"), (10 - F.col("label")).cast("double").alias("r2"), (F.col("vec_id") % 60).cast("double").alias("t2"))
    met = rows.select("vec_id", E.intersection("r1", "t1", "r2", "t2").alias("p")).where("p IS NOT NULL")
    return met.select("vec_id", _r("p.x", 4).alias("x"), _r("p.y", 4).alias("y"))


_REACH = _PIX + """, l AS (SELECT vec_id, y * 8 + x AS i, x, y FROM pix WHERE v > 128), st AS (
  SELECT a.vec_id, a.i, b.i AS j FROM l a JOIN l b ON a.vec_id = b.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1
), reach AS (SELECT vec_id, i AS root, i FROM l UNION SELECT r.vec_id, root, j FROM reach r JOIN st ON r.vec_id = st.vec_id AND r.i = st.i),
lab AS (SELECT vec_id, i, min(root) AS comp FROM reach GROUP BY vec_id, i), c AS (SELECT lab.vec_id, comp, count(*) AS area, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM lab JOIN l ON lab.vec_id = l.vec_id AND lab.i = l.i GROUP BY lab.vec_id, comp)
, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY area DESC, comp) AS rn FROM c)"""


@query("components_largest", f"WITH RECURSIVE {_REACH} SELECT vec_id, area, min_x, min_y, max_x, max_y FROM k WHERE rn = 1")
def components_largest(spark, d):
    """The largest 4-connected blob of each image, the first of equals."""
    return kernels.largest_blobs(images(spark, d), "vec_id", "px", SIDE, 128)


@query("components_all", f"WITH RECURSIVE {_REACH} SELECT vec_id, CAST(comp AS INTEGER) AS first_pixel, area FROM c")
def components_all(spark, d):
    return kernels.blobs(images(spark, d), "vec_id", "px", SIDE, 128).select("vec_id", "first_pixel", "area")


@query(
    "homography_points",
    "WITH h AS (SELECT vec_id, 1.0::DOUBLE + label / 20.0::DOUBLE AS a, 0.1::DOUBLE AS b, 2.0::DOUBLE AS c, -0.2::DOUBLE AS e, 0.9::DOUBLE AS f, 1.0::DOUBLE AS g, 0.001::DOUBLE AS p, 0.002::DOUBLE AS q, CAST(vec_id % 8 AS DOUBLE) AS x, CAST(vec_id % 7 AS DOUBLE) AS y FROM embeddings) SELECT vec_id, round((a * x + b * y + c) / (p * x + q * y + 1), 6) AS tx, round((e * x + f * y + g) / (p * x + q * y + 1), 6) AS ty, round(x, 6) AS bx, round(y, 6) AS by_ FROM h",
)
def homography_points(spark, d):
    """A point of each vector under a homography, and back under its inverse."""
    h = F.array(1.0 + F.col("label") / 20.0, *[F.lit(v) for v in (0.1, 2.0, -0.2, 0.9, 1.0, 0.001, 0.002, 1.0)])
    rows = _table(spark, d, "embeddings").select("vec_id", h.alias("h"), (F.col("vec_id") % 8).cast("double").alias("x"), (F.col("vec_id") % 7).cast("double").alias("y"))
    there = rows.select("vec_id", "h", E.transform_point("h", "x", "y").alias("t")).select("*", E.invert3("h").alias("i"))
    back = there.select("vec_id", "t", E.transform_point("i", F.col("t.x"), F.col("t.y")).alias("b"))
    return back.select("vec_id", _r("t.x").alias("tx"), _r("t.y").alias("ty"), _r("b.x").alias("bx"), _r("b.y").alias("by_"))


@query(
    "matmul_gram",
    "WITH i AS (SELECT unnest(range(8)) AS i), g AS (SELECT a.i AS i, b.i AS j, r.i AS r FROM i a, i b, i r) SELECT label, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(sum(CAST(embedding[r * 8 + i + 1] AS DOUBLE) * CAST(embedding[r * 8 + j + 1] AS DOUBLE)), 5) AS v FROM embeddings, g GROUP BY ALL",
)
def matmul_gram(spark, d):
    """Per label the sum of the vectors, as 8 x 8 matrices, transposed times themselves."""
    rows = _table(spark, d, "embeddings").select("label", F.posexplode(E.matmul(E.transpose("embedding", 8, 8), "embedding", 8, 8, 8)).alias("at", "v"))
    return rows.groupBy("label", F.floor(F.col("at") / 8).cast("int").alias("i"), (F.col("at") % 8).alias("j")).agg(_r(F.sum("v"), 5).alias("v"))


def _placed(values: str, n: int) -> str:
    """Sum of an expression of the place i from 1, times the place, so that order shows."""
    return f"round(list_sum(list_transform(range(1, {n + 1}), lambda i: i * ({values}))), 5)"


@query(
    "matrix_ops",
    "WITH e AS (SELECT vec_id, list_transform(embedding[1:32], lambda v: CAST(v AS DOUBLE)) AS a, list_transform(embedding[33:64], lambda v: CAST(v AS DOUBLE)) AS b FROM embeddings) SELECT vec_id, "
    + ", ".join(
        f"{_placed(q, n)} AS {name}"
        for name, q, n in (
            ("added", "a[i] + b[i]", 32),
            ("less", "a[i] - b[i]", 32),
            ("times", "a[i] * b[i]", 32),
            ("scaled", "a[i] * 2.5::DOUBLE", 32),
            ("filled", "1.5::DOUBLE", 32),
            ("swapped", "a[((i - 1) % 4) * 8 + (i - 1) // 4 + 1]", 32),
            ("product", "list_sum(list_transform(range(8), lambda k: a[(i - 1) // 4 * 8 + k + 1] * b[k * 4 + (i - 1) % 4 + 1]))", 16),
        )
    )
    + " FROM e",
)
def matrix_ops(spark, d):
    """Each vector as two matrices, 4 x 8 and 8 x 4: element-wise, scaled, filled, transposed, multiplied; sums by place."""
    rows = _table(spark, d, "embeddings").select("vec_id", *[F.transform(F.slice("embedding", at, 32), lambda v: v.cast("double")).alias(n) for n, at in (("a", 1), ("b", 33))])
    parts = {"added": E.add("a", "b"), "less": E.subtract("a", "b"), "times": E.multiply("a", "b"), "scaled": E.scale("a", 2.5), "filled": E.filled(1.5, 4, 8), "swapped": E.transpose("a", 4, 8), "product": E.matmul("a", "b", 4, 8, 4)}
    return rows.select("vec_id", *[_r(F.aggregate(F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v), 5).alias(n) for n, c in parts.items()])


# -- data sets --------------------------------------------------------------------------


@query("zip_join", "SELECT d.doc_id, length(text) AS n, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def zip_join(spark, d):
    labels = _table(spark, d, "labels")
    documents = _table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n")).join(labels.select("doc_id"), "doc_id", "left_semi")
    return S.zip_join(documents, labels, "doc_id").select("doc_id", "n", "quality", "toxic")


@query("drop_zero_label", "SELECT vec_id, label FROM embeddings WHERE label <> 0")
def drop_zero_label(spark, d):
    return _table(spark, d, "embeddings").where("label <> 0").select("vec_id", "label")


@query("union_extra", "SELECT s_suppkey AS key, s_name AS name, s_nationkey AS nation FROM supplier UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer")
def union_extra(spark, d):
    suppliers = _table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    customers = _table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return S.append(suppliers, customers)


@query("class_distribution", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def class_distribution(spark, d):
    return _table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("exact_split", "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN rn <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS part FROM o")
def exact_split(spark, d):
    return S.exact_split(_table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], 0.7).select("o_orderkey", "part")


@query("batches", "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) SELECT CAST((rn - 1) // 32 AS BIGINT) AS batch, count(*) AS n, min(o_orderkey) AS first_key FROM o GROUP BY ALL")
def batches(spark, d):
    dealt = S.batches(_table(spark, d, "orders").select("o_orderkey"), [F.col("o_orderkey")], 32)
    return dealt.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


# -- report -----------------------------------------------------------------------------


@query("param_grid", "SELECT CAST(row_number() OVER (ORDER BY lr, m) AS INTEGER) AS config_id, 20 AS epochs, 32 AS batch_size, lr::DOUBLE AS learning_rate, m::DOUBLE AS momentum FROM (SELECT unnest([0.005, 0.01, 0.02]) AS lr), (SELECT unnest([0.0, 0.9]) AS m)")
def param_grid(spark, d):
    return R.parameter_grid(spark, epochs=[20], batch_size=[32], learning_rate=[0.005, 0.01, 0.02], momentum=[0.0, 0.9])


@query("topk_configs", "SELECT CAST(row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS INTEGER) AS rank, p_partkey, p_size, p_retailprice FROM part ORDER BY 1 LIMIT 10")
def topk_configs(spark, d):
    return R.ranking(_table(spark, d, "part"), "p_size", "p_retailprice", "p_partkey", 10).select("rank", "p_partkey", "p_size", "p_retailprice")


@query("topk_per_group", "WITH k AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) SELECT p_brand, CAST(rank AS INTEGER) AS rank, p_partkey, p_retailprice FROM k WHERE rank <= 20")
def topk_per_group(spark, d):
    return A.top_k(_table(spark, d, "part"), [F.desc("p_retailprice"), F.col("p_partkey")], 20, ["p_brand"]).select("p_brand", "rank", "p_partkey", "p_retailprice")


_MARGINAL = "SELECT '{0}' AS parameter, CAST({0} AS VARCHAR) AS value, round(avg(l_extendedprice), 4) AS mean_score, round(stddev_samp(l_extendedprice), 4) AS std_score, count(*) AS n FROM lineitem GROUP BY {0}"


@query("marginal_means", " UNION ALL ".join(_MARGINAL.format(c) for c in ("l_returnflag", "l_linestatus", "l_linenumber")))
def marginal_means(spark, d):
    out = R.marginals(_table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], "l_extendedprice")
    return out.select("parameter", "value", _r("mean_score", 4).alias("mean_score"), _r("std_score", 4).alias("std_score"), "n")


_SUMMARY = "SELECT '{0}' AS metric, CAST(min({0}) AS DOUBLE) AS min_value, CAST(max({0}) AS DOUBLE) AS max_value, round(avg({0}), 4) AS mean_value FROM lineitem"


@query("summary_stats", " UNION ALL ".join(_SUMMARY.format(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
def summary_stats(spark, d):
    out = R.summary(_table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("metric", "min_value", "max_value", _r("mean_value", 4).alias("mean_value"))


@query(
    "pareto_frontier",
    "WITH w AS (SELECT *, max(p_size) OVER (ORDER BY p_retailprice, p_size DESC, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM part), f AS (SELECT * FROM w WHERE prev IS NULL OR p_size > prev) SELECT p_partkey, p_retailprice, p_size, round((SELECT max(p_retailprice) FROM f) / p_retailprice, 6) AS speedup FROM f",
)
def pareto_frontier(spark, d):
    out = R.pareto(_table(spark, d, "part"), "p_retailprice", "p_size", "p_partkey")
    return out.select("p_partkey", "p_retailprice", "p_size", _r("speedup").alias("speedup"))


@query(
    "fastest_good",
    "WITH b AS (SELECT p_partkey AS best, p_size AS best_score, p_retailprice AS best_cost FROM part ORDER BY p_size DESC, p_partkey LIMIT 1), f AS (SELECT p_partkey AS fastest, p_size AS fastest_score, p_retailprice AS fastest_cost FROM part WHERE p_size > 45 ORDER BY p_retailprice, p_partkey LIMIT 1) SELECT *, round(best_cost / fastest_cost, 6) AS cost_ratio, best_score - fastest_score AS score_gap FROM b, f",
)
def fastest_good(spark, d):
    out = R.advice(_table(spark, d, "part"), "p_size", "p_retailprice", "p_partkey", 45)
    return out.withColumn("cost_ratio", _r("cost_ratio"))


@query("latex_top5", "WITH k AS (SELECT row_number() OVER (ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS rank, * FROM part) SELECT CAST(rank AS INTEGER) AS rank, printf('%d & %.1f & %.1f & %.4f & %.2f & %.4f & %.4f \\\\', rank, p_size::DOUBLE, 32.0::DOUBLE, p_retailprice, 0.9::DOUBLE, p_size / 100.0::DOUBLE, p_size / 100.0::DOUBLE) AS line FROM k WHERE rank <= 5")
def latex_top5(spark, d):
    ranked = R.ranking(_table(spark, d, "part"), "p_size", "p_retailprice", "p_partkey", 5)
    score = F.col("p_size") / 100.0
    return R.latex_rows(ranked.select("rank", F.col("p_size").alias("epochs"), F.lit(32).alias("batch_size"), F.col("p_retailprice").alias("learning_rate"), F.lit(0.9).alias("momentum"), score.alias("accuracy"), score.alias("avg_f1_score")))


@query(
    "early_stop_runs",
    """WITH w AS (SELECT user_id, ts, event_id, value, row_number() OVER u AS step, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, best IS NULL OR value > best + 0.001::DOUBLE AS improved FROM w), l AS (SELECT *, max(CASE WHEN improved THEN step END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_one FROM i)
SELECT user_id, event_id, CAST(step AS INTEGER) AS step, improved, CAST(step - last_one AS INTEGER) AS stale, step - last_one >= 5 AS stop FROM l""",
)
def early_stop_runs(spark, d):
    return R.early_stop_runs(_table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 0.001, 5).drop("ts")


# -- puzzles ----------------------------------------------------------------------------


def _puzzles(spark, keys=None) -> DataFrame:
    return spark.createDataFrame([(k, g) for k, g in PUZZLES.items() if keys is None or k in keys], "puzzle_id int, grid string")


_GRIDS = "puzzles AS (" + " UNION ALL ".join(f"SELECT {k} AS puzzle_id, '{g}' AS grid" for k, g in PUZZLES.items()) + ")"
_CELLS = _GRIDS + ", cells AS (SELECT puzzle_id, CAST(i AS INTEGER) AS idx, CAST(i // 9 AS INTEGER) AS r, CAST(i % 9 AS INTEGER) AS c, CAST(i // 27 * 3 + i % 9 // 3 AS INTEGER) AS box, CASE WHEN grid[i + 1] = '.' THEN 0 ELSE CAST(grid[i + 1] AS INTEGER) END AS d FROM (SELECT puzzle_id, grid, unnest(range(81)) AS i FROM puzzles))"
_UNIT = _CELLS + ", u AS (SELECT puzzle_id, idx, d, 'r' AS kind, r AS unit FROM cells UNION ALL SELECT puzzle_id, idx, d, 'c', c FROM cells UNION ALL SELECT puzzle_id, idx, d, 'b', box FROM cells)"


@query("peer_conflicts", f"WITH {_UNIT} SELECT puzzle_id, kind, unit, d, count(*) AS n FROM u WHERE d > 0 GROUP BY ALL HAVING count(*) > 1")
def peer_conflicts(spark, d):
    return P.conflicts(P.cells(_puzzles(spark)))


@query("grid_complete", f"WITH {_UNIT}, bad AS (SELECT puzzle_id, count(*) AS n FROM (SELECT puzzle_id FROM u WHERE d > 0 GROUP BY puzzle_id, kind, unit, d HAVING count(*) > 1) GROUP BY puzzle_id), f AS (SELECT puzzle_id, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS filled FROM cells GROUP BY puzzle_id) SELECT f.puzzle_id, filled, coalesce(n, 0) AS bad_units, filled = 81 AND n IS NULL AS complete FROM f LEFT JOIN bad ON f.puzzle_id = bad.puzzle_id")
def grid_complete(spark, d):
    return P.completeness(P.cells(_puzzles(spark)))


_FREE = _UNIT + ", free AS (SELECT e.puzzle_id, e.idx, t.d FROM cells e, (SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS d) t WHERE e.d = 0 AND NOT EXISTS (SELECT 1 FROM u o JOIN u m ON o.puzzle_id = m.puzzle_id AND o.kind = m.kind AND o.unit = m.unit WHERE m.puzzle_id = e.puzzle_id AND m.idx = e.idx AND o.d = t.d))"


@query("allowed_digits", f"WITH {_FREE} SELECT puzzle_id, idx, d FROM free")
def allowed_digits(spark, d):
    return P.allowed(P.cells(_puzzles(spark)))


@query("mrv_cell", f"WITH {_FREE}, n AS (SELECT e.puzzle_id, e.idx, count(f.d) AS n FROM cells e LEFT JOIN free f ON e.puzzle_id = f.puzzle_id AND e.idx = f.idx WHERE e.d = 0 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY puzzle_id ORDER BY n, idx) AS rn FROM n) SELECT puzzle_id, idx, n AS choices FROM k WHERE rn = 1")
def mrv_cell(spark, d):
    return P.fewest_choices(P.cells(_puzzles(spark)))


_COLUMN = " || ".join(f"substr(b, (pos - 1) % 9 + {9 * k + 1}, 1)" for k in range(9))
_BOX = " || ".join(f"substr(b, (pos - 1) // 27 * 27 + (pos - 1) % 9 // 3 * 3 + {9 * k + 1}, 3)" for k in range(3))
_SEARCH = _GRIDS + f""", search AS (
  SELECT puzzle_id, grid AS b, instr(grid, '.') AS pos FROM puzzles WHERE puzzle_id <> 3
  UNION ALL SELECT puzzle_id, substr(b, 1, pos - 1) || n.d || substr(b, pos + 1), instr(substr(b, 1, pos - 1) || n.d || substr(b, pos + 1), '.')
  FROM search, (SELECT unnest(['1', '2', '3', '4', '5', '6', '7', '8', '9']) AS d) n
  WHERE pos > 0 AND instr(substr(b, (pos - 1) // 9 * 9 + 1, 9), n.d) = 0 AND instr({_COLUMN}, n.d) = 0 AND instr({_BOX}, n.d) = 0
), done AS (SELECT puzzle_id, b FROM search WHERE pos = 0)"""


@query("solve_recursive", f"WITH RECURSIVE {_SEARCH} SELECT puzzle_id, min(b) AS solution FROM done GROUP BY puzzle_id")
def solve_recursive(spark, d):
    return P.solutions(spark, _puzzles(spark, {1, 2, 4})).groupBy("puzzle_id").agg(F.min("b").alias("solution"))


@query("count_solutions", f"WITH RECURSIVE {_SEARCH} SELECT puzzle_id, count(*) AS n FROM done GROUP BY puzzle_id")
def count_solutions(spark, d):
    return P.solutions(spark, _puzzles(spark, {1, 2, 4})).groupBy("puzzle_id").agg(F.count(F.lit(1)).alias("n"))


@query("solve_dfs", f"WITH RECURSIVE {_SEARCH}, s AS (SELECT puzzle_id, min(b) AS solution, CAST(least(count(*), 2) AS INTEGER) AS n FROM done GROUP BY puzzle_id) SELECT p.puzzle_id, solution, coalesce(n, 0) AS n_solutions, coalesce(n, 0) = 1 AS is_unique FROM puzzles p LEFT JOIN s ON p.puzzle_id = s.puzzle_id")
def solve_dfs(spark, d):
    return P.solve_puzzles(_puzzles(spark))


@query("solved_cells", f"WITH RECURSIVE {_SEARCH}, s AS (SELECT puzzle_id, min(b) AS b FROM done GROUP BY puzzle_id) SELECT s.puzzle_id, CAST(i AS INTEGER) AS idx, CAST(b[i + 1] AS INTEGER) AS d FROM (SELECT s.puzzle_id, b, grid, unnest(range(81)) AS i FROM s JOIN puzzles p ON s.puzzle_id = p.puzzle_id) s WHERE grid[i + 1] = '.'")
def solved_cells(spark, d):
    """Digits that the solution adds to the clues."""
    puzzles = _puzzles(spark)
    solved = P.solve_puzzles(puzzles).where("solution IS NOT NULL").select("puzzle_id", F.col("solution").alias("grid"))
    return P.added_cells(solved, puzzles).select("puzzle_id", "idx", "d")


@query("grid_text", f"WITH {_GRIDS} SELECT puzzle_id, array_to_string(list_transform(range(9), lambda r: array_to_string(string_split(substr(grid, CAST(r * 9 + 1 AS BIGINT), 9), ''), ' ')), chr(10)) AS text FROM puzzles")
def grid_text(spark, d):
    return _puzzles(spark).select("puzzle_id", P.render(F.col("grid")).alias("text"))


# -- kernels over arrays ----------------------------------------------------------------

_SOBEL = _NEAR + ", g0 AS (SELECT vec_id, x, y, sum(v * dx * (2 - abs(dy))) AS gx, sum(v * dy * (2 - abs(dx))) AS gy FROM near GROUP BY ALL), g AS (SELECT vec_id, x, y, CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN least(255, trunc(sqrt(CAST(gx * gx + gy * gy AS DOUBLE)))) ELSE 0 END AS v FROM g0)"


@query(
    "canny_edges",
    f"WITH RECURSIVE {_SOBEL}, edge AS (SELECT vec_id, x, y FROM g WHERE v >= 250 UNION SELECT g.vec_id, g.x, g.y FROM edge e JOIN g ON g.vec_id = e.vec_id AND abs(g.x - e.x) <= 1 AND abs(g.y - e.y) <= 1 WHERE g.v >= 120 AND g.x BETWEEN 1 AND 6 AND g.y BETWEEN 1 AND 6) SELECT vec_id, x, y FROM edge",
)
def canny_edges(spark, d):
    """Pixels of strong gradient, and weak ones that lead to them."""
    edges = kernels.map_arrays(images(spark, d).select("vec_id", "px"), "px", SIDE, lambda img: kernels.canny(img, 120, 250))
    return to_long(edges, ["vec_id"], "px").where("v = 255").select("vec_id", "x", "y")


@query("warp_shift", f"WITH {_PIX} SELECT a.vec_id, a.x, a.y, CASE WHEN a.x - 1 BETWEEN 0 AND 6 AND a.y - 2 BETWEEN 0 AND 6 THEN b.v ELSE 0 END AS v FROM pix a LEFT JOIN pix b ON a.vec_id = b.vec_id AND b.x = a.x - 1 AND b.y = a.y - 2")
def warp_shift(spark, d):
    """Every image under the homography of four corners moved by (1, 2)."""
    corners = [(0, 0), (7, 0), (7, 7), (0, 7)]
    h = kernels.homography(corners, [(x + 1, y + 2) for x, y in corners])
    moved = kernels.map_arrays(images(spark, d).select("vec_id", "px"), "px", SIDE, lambda img: kernels.warp(img, h.round(9), SIDE, SIDE))
    return to_long(moved, ["vec_id"], "px")


@query("label_noise", f"WITH RECURSIVE {_REACH} SELECT vec_id, CAST(sum(v) AS BIGINT) AS mass FROM (SELECT p.vec_id, CASE WHEN l.comp = k.comp THEN v ELSE 0 END AS v FROM pix p LEFT JOIN lab l ON l.vec_id = p.vec_id AND l.i = p.y * 8 + p.x LEFT JOIN k ON k.vec_id = p.vec_id AND k.rn = 1) GROUP BY vec_id")
def label_noise(spark, d):
    """What is left of every image when only its largest blob above 128 stays."""

    def largest(img):
        mask = kernels.largest_mask(img)
        return img * 0 if mask is None else img * mask

    kept = kernels.map_arrays(images(spark, d).select("vec_id", "px"), "px", SIDE, largest)
    return kept.select("vec_id", F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + v).alias("mass"))
