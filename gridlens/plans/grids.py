"""More registered queries: shapes, fits, cells, drawing, the network and puzzles made from the tables.

Where a result is random or a model's, the query reports what must hold of it (counts, bounds, a solution that is
checked), and the SQL says so from the tables alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlens.functions import elementwise as E
from gridlens.operators import draw, kernels, nn, puzzle as P, report as R, sampling as S, stencils as X
from gridlens.operators.images import SIDE, images, to_long
from gridlens.plans.catalogue import _IMG, _PIX, _r, _table, query
from gridlens.sources import files, records
from gridlens.sources.scratch import scratch

# -- blur ---------------------------------------------------------------------------------

_GAUSS = _PIX + """, o AS (SELECT unnest([-2, -1, 0, 1, 2]) AS o), w0 AS (SELECT a.o AS dx, b.o AS dy, exp(-(a.o * a.o + b.o * b.o) / 2.0::DOUBLE) AS w FROM o a, o b)
, w AS (SELECT dx, dy, w / (SELECT sum(w) FROM w0) AS w FROM w0)
SELECT a.vec_id, a.x, a.y, CAST(trunc(sum(b.v * w.w) + 1e-9) AS INTEGER) AS v FROM pix a, w, pix b
WHERE a.vec_id = b.vec_id AND b.x = least(7, greatest(0, a.x + w.dx)) AND b.y = least(7, greatest(0, a.y + w.dy)) GROUP BY a.vec_id, a.x, a.y"""


@query("gauss5_sigma", f"WITH {_GAUSS}")
def gauss5_sigma(spark, d):
    return to_long(images(spark, d), ["vec_id"], X.gaussian_blur("px", SIDE, SIDE, 5, 1.0))


@query("gauss5_kernel", f"WITH {_GAUSS}")
def gauss5_kernel(spark, d):
    blurred = kernels.map_arrays(images(spark, d).select("vec_id", "px"), "px", SIDE, lambda img: kernels.gaussian_blur(img, 5, 1.0))
    return to_long(blurred, ["vec_id"], "px")


@query("gaussian_weights", "SELECT CAST(a.o AS INTEGER) AS x, CAST(b.o AS INTEGER) AS y, round(exp(-(a.o * a.o + b.o * b.o) / (2 * 1.5::DOUBLE * 1.5::DOUBLE)), 9) AS w FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS o) a, (SELECT unnest([-2, -1, 0, 1, 2]) AS o) b")
def gaussian_weights(spark, d):
    """Kernel values before they are scaled to sum 1."""
    rows = X.gaussian_kernel(5, 1.5)
    middle = rows[2][2]
    return spark.createDataFrame([(j - 2, i - 2, round(v / middle, 9)) for i, row in enumerate(rows) for j, v in enumerate(row)], "x int, y int, w double")


# -- fits ---------------------------------------------------------------------------------


@query(
    "linear_system",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings),
m AS (SELECT vec_id, e[1] + 2 AS a, e[2] AS b, e[3] AS c, e[4] AS d, e[5] + 2 AS e_, e[6] AS f, e[7] AS g, e[8] AS h, e[9] + 2 AS i, e[10] AS p, e[11] AS q, e[12] AS r FROM e),
t AS (SELECT *, a * (e_ * i - f * h) - b * (d * i - f * g) + c * (d * h - e_ * g) AS det FROM m)
SELECT vec_id, round((p * (e_ * i - f * h) - b * (q * i - f * r) + c * (q * h - e_ * r)) / det, 6) AS x,
round((a * (q * i - f * r) - p * (d * i - f * g) + c * (d * r - q * g)) / det, 6) AS y, round((a * (e_ * r - q * h) - b * (d * r - q * g) + p * (d * h - e_ * g)) / det, 6) AS z FROM t""",
)
def linear_system(spark, d):
    """A 3 x 3 system of each vector, by elimination; the SQL uses determinants."""
    e = [F.get("embedding", F.lit(k)).cast("double") for k in range(12)]
    a = F.array(*[x + 2 if k % 4 == 0 else x for k, x in enumerate(e[:9])])
    rows = _table(spark, d, "embeddings").select("vec_id", a.alias("a"), F.array(*e[9:]).alias("b"))
    solved = kernels.solve_systems(rows, "vec_id", "a", "b")
    return solved.select("vec_id", *[_r(F.get("solution", F.lit(k))).alias(c) for k, c in enumerate("xyz")])


_MOVED = "c AS (SELECT unnest([0, 1, 2, 3]) AS corner), s AS (SELECT corner, CASE WHEN corner IN (1, 2) THEN 7.0 ELSE 0.0 END::DOUBLE AS x, CASE WHEN corner >= 2 THEN 7.0 ELSE 0.0 END::DOUBLE AS y FROM c)"


@query("homography_fit", f"WITH {_MOVED} SELECT vec_id, CAST(corner AS INTEGER) AS corner, round(x + CAST(embedding[2 * corner + 1] AS DOUBLE), 5) AS tx, round(y + CAST(embedding[2 * corner + 2] AS DOUBLE), 5) AS ty, true AS inverted FROM embeddings, s")
def homography_fit(spark, d):
    """The homography that takes a square's corners to corners moved by each vector, applied to the square; and its inverse back."""
    source = [(0.0, 0.0), (7.0, 0.0), (7.0, 7.0), (0.0, 7.0)]
    target = F.array(*[F.get("embedding", F.lit(2 * k + j)).cast("double") + F.lit(p[j]) for k, p in enumerate(source) for j in (0, 1)])
    rows = kernels.fit_homographies(_table(spark, d, "embeddings").select("vec_id", target.alias("target")), "vec_id", "target", source)
    each = rows.select("vec_id", "h", F.explode(F.array(*[F.struct(F.lit(k).alias("corner"), F.lit(x).alias("x"), F.lit(y).alias("y")) for k, (x, y) in enumerate(source)])).alias("p"))
    there = each.select("vec_id", "h", "p", E.transform_point("h", F.col("p.x"), F.col("p.y")).alias("t")).select("*", E.invert3("h").alias("i"))
    back = there.select("vec_id", "p", "t", E.transform_point("i", F.col("t.x"), F.col("t.y")).alias("b"))
    near = (F.abs(F.col("b.x") - F.col("p.x")) < 1e-6) & (F.abs(F.col("b.y") - F.col("p.y")) < 1e-6)
    return back.select("vec_id", "p.corner", _r("t.x", 5).alias("tx"), _r("t.y", 5).alias("ty"), near.alias("inverted"))


@query("rectified_box", f"WITH {_PIX} SELECT vec_id, x - 1 AS x, y - 1 AS y, v FROM pix WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6")
def rectified_box(spark, d):
    """A box as a quadrilateral of the image, taken out by its homography."""
    taken = kernels.map_arrays(images(spark, d).select("vec_id", "px"), "px", SIDE, lambda img: kernels.rectify(img, [(1, 1), (6, 1), (6, 6), (1, 6)], 6))
    return to_long(taken, ["vec_id"], "px", 6)


@query(
    "ordered_corners",
    """WITH p AS (SELECT vec_id, i, CAST(round(CAST(embedding[2 * i + 1] AS DOUBLE) * 20) AS INTEGER) AS x, CAST(round(CAST(embedding[2 * i + 2] AS DOUBLE) * 20) AS INTEGER) AS y FROM (SELECT vec_id, embedding, unnest([0, 1, 2, 3]) AS i FROM embeddings)),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x + y, i) AS a, row_number() OVER (PARTITION BY vec_id ORDER BY y - x, i) AS b, row_number() OVER (PARTITION BY vec_id ORDER BY x + y DESC, i) AS c, row_number() OVER (PARTITION BY vec_id ORDER BY y - x DESC, i) AS e FROM p)
SELECT vec_id, max(x) FILTER (a = 1) AS tl_x, max(y) FILTER (a = 1) AS tl_y, max(x) FILTER (b = 1) AS tr_x, max(y) FILTER (b = 1) AS tr_y, max(x) FILTER (c = 1) AS br_x, max(y) FILTER (c = 1) AS br_y, max(x) FILTER (e = 1) AS bl_x, max(y) FILTER (e = 1) AS bl_y FROM k GROUP BY vec_id""",
)
def ordered_corners(spark, d):
    points = F.array(*[F.struct(*[F.round(F.get("embedding", F.lit(2 * k + j)).cast("double") * 20).cast("int").alias(c) for j, c in enumerate("xy")]) for k in range(4)])
    quad = _table(spark, d, "embeddings").select("vec_id", E.order_corners(points).alias("q"))
    return quad.select("vec_id", *[F.col("q")[k][c].alias(f"{n}_{c}") for k, n in enumerate(("tl", "tr", "br", "bl")) for c in "xy"])


@query("rectangle_quads", "WITH r AS (SELECT vec_id, CAST(label + 2 AS DOUBLE) AS w, CAST(vec_id % 50 + 2 AS DOUBLE) AS h FROM embeddings) SELECT vec_id, CAST(k AS INTEGER) AS corner, CASE WHEN k IN (1, 2) THEN w - 1 ELSE 0 END AS x, CASE WHEN k >= 2 THEN h - 1 ELSE 0 END AS y FROM r, (SELECT unnest([0, 1, 2, 3]) AS k)")
def rectangle_quads(spark, d):
    rows = _table(spark, d, "embeddings").select("vec_id", F.posexplode(E.rectangle_quad(F.col("label") + 2, F.col("vec_id") % 50 + 2)).alias("corner", "p"))
    return rows.select("vec_id", "corner", "p.x", "p.y")


# -- blobs and cells ----------------------------------------------------------------------


def _blobs(src: str, over: str) -> str:
    """Blobs of the pixels of ``src`` that ``over`` holds for, each with its first pixel, area and box, the largest ranked first."""
    return f""", l AS (SELECT vec_id, y * 8 + x AS i, x, y, v FROM {src} WHERE {over}), st AS (
  SELECT a.vec_id, a.i, b.i AS j FROM l a JOIN l b ON a.vec_id = b.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1
), reach AS (SELECT vec_id, i AS root, i FROM l UNION SELECT r.vec_id, root, j FROM reach r JOIN st ON r.vec_id = st.vec_id AND r.i = st.i),
lab AS (SELECT vec_id, i, min(root) AS comp FROM reach GROUP BY vec_id, i), c AS (SELECT lab.vec_id, comp, count(*) AS area, max(v) AS top, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM lab JOIN l ON lab.vec_id = l.vec_id AND lab.i = l.i GROUP BY lab.vec_id, comp)
, k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY area DESC, comp) AS rn FROM c WHERE top > 128)"""


_KEPT = "SELECT p.vec_id, CAST(sum(CASE WHEN k.comp IS NULL THEN 0 ELSE v END) AS BIGINT) AS mass, count(k.comp) AS n, count(CASE WHEN v > 128 THEN k.comp END) AS lit FROM {0} p LEFT JOIN lab ON lab.vec_id = p.vec_id AND lab.i = p.y * 8 + p.x LEFT JOIN k ON k.vec_id = p.vec_id AND k.rn = 1 AND lab.comp = k.comp GROUP BY p.vec_id"


@query("border_noise", f"WITH RECURSIVE {_PIX}{_blobs('pix', 'v >= 128')} SELECT vec_id, mass, n FROM (" + _KEPT.format("pix") + ")")
def border_noise(spark, d):
    """What is left of every image when noise at its border goes: the largest blob from 128 on that has a pixel above 128."""
    kept = kernels.map_arrays(images(spark, d).select("vec_id", "px"), "px", SIDE, kernels.remove_border_noise)
    return kept.select("vec_id", F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + v).alias("mass"), F.size(F.filter("px", lambda v: v > 0)).cast("long").alias("n"))


@query(
    "quad_of_blob",
    f"WITH RECURSIVE {_PIX}{_blobs('pix', 'v > 128')}" + """, b AS (SELECT * FROM k WHERE rn = 1 AND (max_x - min_x + 1) * (max_y - min_y + 1) > 4), q AS (
  SELECT l.vec_id, l.x, l.y FROM l JOIN lab ON l.vec_id = lab.vec_id AND l.i = lab.i JOIN b ON b.vec_id = l.vec_id AND b.comp = lab.comp
), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x + y, y, x) AS a, row_number() OVER (PARTITION BY vec_id ORDER BY y - x, y, x) AS e,
  row_number() OVER (PARTITION BY vec_id ORDER BY x + y DESC, y, x) AS f, row_number() OVER (PARTITION BY vec_id ORDER BY y - x DESC, y, x) AS g FROM q
), c4 AS (SELECT vec_id, [max(x) FILTER (a = 1), max(y) FILTER (a = 1), max(x) FILTER (e = 1), max(y) FILTER (e = 1), max(x) FILTER (f = 1), max(y) FILTER (f = 1), max(x) FILTER (g = 1), max(y) FILTER (g = 1)] AS quad FROM r GROUP BY vec_id)
SELECT e.vec_id, array_to_string(quad, ' ') AS quad FROM embeddings e LEFT JOIN c4 ON e.vec_id = c4.vec_id""",
)
def quad_of_blob(spark, d):
    """Corners of the largest blob if its box is large enough; these images are too small for lines."""
    found = kernels.map_arrays(images(spark, d).select("vec_id", "px"), "px", SIDE, lambda img: None if (q := kernels.find_quad(img)) is None else np.array(q))
    return found.select("vec_id", F.array_join("px", " ").alias("quad"))


_CENTRED = _PIX + ", cm AS (SELECT vec_id, coalesce(CAST(sum(x * v) AS DOUBLE) / nullif(CAST(sum(v) AS DOUBLE), 0), 4.0) AS cx, coalesce(CAST(sum(y * v) AS DOUBLE) / nullif(CAST(sum(v) AS DOUBLE), 0), 4.0) AS cy FROM pix GROUP BY vec_id), mid AS (SELECT a.vec_id, a.x, a.y, coalesce(b.v, 0) AS v FROM pix a JOIN cm USING (vec_id) LEFT JOIN pix b ON b.vec_id = a.vec_id AND b.x = a.x - CAST(trunc(4 - cx) AS INTEGER) AND b.y = a.y - CAST(trunc(4 - cy) AS INTEGER))"


@query("cut_cells", f"WITH RECURSIVE {_CENTRED}{_blobs('mid', 'v >= 128')}, one AS (" + _KEPT.format("mid") + "), cell AS (SELECT CAST(unnest(range(81)) AS INTEGER) AS cell) SELECT cell, CAST(sum(mass) AS BIGINT) AS mass, CAST(sum(n) AS BIGINT) AS n, count(*) AS grids, CAST(count(*) FILTER (lit / 64.0 < 0.05) AS BIGINT) AS empty FROM one, cell GROUP BY cell")
def cut_cells(spark, d):
    """Grids of 81 equal cells, cut up again: each cell centred and cleaned, and whether it counts as empty."""
    cut = kernels.map_arrays(images(spark, d).select("vec_id", "px"), "px", SIDE, lambda img: np.concatenate([c.ravel() for c in kernels.split_cells(np.tile(img, (9, 9)), 0.0, SIDE)]))
    cells = cut.select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(80)), lambda k: F.slice("px", k * 64 + 1, F.lit(64)))).alias("cell", "px"))
    mass = F.aggregate("px", F.lit(0).cast("long"), lambda a, v: a + v)
    return cells.groupBy("cell").agg(F.sum(mass).alias("mass"), F.sum(F.size(F.filter("px", lambda v: v > 0))).cast("long").alias("n"), F.count(F.lit(1)).alias("grids"), F.sum(E.is_empty("px").cast("long")).alias("empty"))


# -- drawing ------------------------------------------------------------------------------


def _drawn(df: DataFrame, made, columns: list[str]) -> DataFrame:
    """vec_id, x, y and v of the lit pixels of a picture that ``made`` draws from each row."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                y, x = np.nonzero(img := made(row))
                yield pa.RecordBatch.from_arrays([pa.array([row["vec_id"]] * len(x), pa.int64()), *[pa.array(c.astype(np.int32)) for c in (x, y, img[y, x].astype(int))]], names=["vec_id", "x", "y", "v"])

    return df.select("vec_id", *columns).mapInArrow(run, "vec_id long, x int, y int, v int")


_EIGHT = "g AS (SELECT CAST(unnest(range(8)) AS INTEGER) AS n), px8 AS (SELECT a.n AS x, b.n AS y FROM g a, g b)"


@query("drawn_rectangles", f"WITH {_EIGHT}, r AS (SELECT vec_id, CAST(label % 4 AS INTEGER) AS x0, CAST(vec_id % 4 AS INTEGER) AS y0 FROM embeddings) SELECT vec_id, x, y, CASE WHEN x IN (x0, x0 + 3) OR y IN (y0, y0 + 3) THEN 200 ELSE 90 END AS v FROM r, px8 WHERE x BETWEEN x0 AND x0 + 3 AND y BETWEEN y0 AND y0 + 3")
def drawn_rectangles(spark, d):
    def made(row):
        img = np.zeros((8, 8), int)
        draw.fill_rectangle(img, row["label"] % 4, row["vec_id"] % 4, 4, 4, 90)
        draw.put_rectangle(img, row["label"] % 4, row["vec_id"] % 4, 4, 4, 200)
        return img

    return _drawn(_table(spark, d, "embeddings"), made, ["label"])


@query("drawn_lines", f"WITH {_EIGHT} SELECT vec_id, x, y, 255 AS v FROM embeddings, px8 WHERE y = CAST(floor(x / 7.0::DOUBLE * (vec_id % 8) + 0.5) AS INTEGER)")
def drawn_lines(spark, d):
    def made(row):
        img = np.zeros((8, 8), int)
        draw.put_line(img, (0, 0), (7, row["vec_id"] % 8), 255)
        return img

    return _drawn(_table(spark, d, "embeddings"), made, [])


_GLYPH = "gl AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {r}, {bits})" for k, rows in enumerate(draw.GLYPHS) for r, bits in enumerate(rows)) + ") t(digit, r, bits))"


@query("drawn_digits", f"WITH {_GLYPH} SELECT vec_id, CAST(1 + c AS INTEGER) AS x, CAST(r AS INTEGER) AS y, 7 AS v FROM embeddings JOIN gl ON gl.digit = label % 10, (SELECT unnest(range(5)) AS c) WHERE (bits >> (4 - c)::INTEGER) & 1 = 1")
def drawn_digits(spark, d):
    def made(row):
        img = np.zeros((8, 8), int)
        draw.put_digit(img, row["label"] % 10, 1, 0, 7, 7)
        return img

    return _drawn(_table(spark, d, "embeddings"), made, ["label"])


@query("contact_sheets", f"WITH {_PIX} SELECT vec_id, 82 AS side, CAST(81 * 3 * sum(v) + 1540 * 255 AS BIGINT) AS mass FROM pix GROUP BY vec_id")
def contact_sheets(spark, d):
    """81 copies of each image in a sheet with lines between: its side and the sum of its bytes."""

    def sheet(img):
        made = draw.contact_sheet([img] * 81)
        return np.array([made.shape[0], int(made.astype(int).sum())])

    made = kernels.map_arrays(images(spark, d).select("vec_id", "px"), "px", SIDE, sheet)
    return made.select("vec_id", F.get("px", F.lit(0)).alias("side"), F.get("px", F.lit(1)).cast("long").alias("mass"))


# -- puzzles from the tables --------------------------------------------------------------

#: A full grid, from which tables make puzzles: digits are shifted by one key, cells emptied by another.
FULL = "534678912672195348198342567859761423426853791713924856961537284287419635345286179"
_MADE = f"""base AS (SELECT CAST(c_custkey AS INTEGER) AS puzzle_id, c_nationkey AS shift, c_custkey AS k, CAST(unnest(range(81)) AS INTEGER) AS i FROM customer),
cell AS (SELECT puzzle_id, i, CAST((CAST(substr('{FULL}', i + 1, 1) AS INTEGER) + shift - 1) % 9 + 1 AS INTEGER) AS d, (i * 31 + k * 7) % 81 < 30 + k % 10 AS gone FROM base),
made AS (SELECT puzzle_id, string_agg(CASE WHEN gone THEN '.' ELSE CAST(d AS VARCHAR) END, '' ORDER BY i) AS grid, string_agg(CAST(d AS VARCHAR), '' ORDER BY i) AS full_grid FROM cell GROUP BY puzzle_id)"""


def made_puzzles(spark: SparkSession, d: str, dealt: bool = False) -> DataFrame:
    """puzzle_id, grid and full_grid of a puzzle for every customer; ``dealt`` to as many tasks as a shuffle has, as the table's few splits hold much work each."""
    table = _table(spark, d, "customer").select("c_custkey", "c_nationkey")
    table = table.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)) if dealt else table
    rows = table.select(F.col("c_custkey").cast("int").alias("puzzle_id"), F.col("c_nationkey").alias("shift"), F.col("c_custkey").alias("k"))
    steps = F.sequence(F.lit(0), F.lit(80))

    def digit(i):
        return ((F.substring(F.lit(FULL), i + 1, F.lit(1)).cast("int") + F.col("shift") - 1) % 9 + 1).cast("string")

    gone = F.transform(steps, lambda i: F.when((i * 31 + F.col("k") * 7) % 81 < 30 + F.col("k") % 10, F.lit(".")).otherwise(digit(i)))
    return rows.select("puzzle_id", F.array_join(gone, "").alias("grid"), F.array_join(F.transform(steps, digit), "").alias("full_grid"))


def _search(source: str) -> str:
    column = " || ".join(f"substr(b, (pos - 1) % 9 + {9 * k + 1}, 1)" for k in range(9))
    box = " || ".join(f"substr(b, (pos - 1) // 27 * 27 + (pos - 1) % 9 // 3 * 3 + {9 * k + 1}, 3)" for k in range(3))
    return f""", search AS (
  SELECT puzzle_id, grid AS b, instr(grid, '.') AS pos FROM {source}
  UNION ALL SELECT puzzle_id, substr(b, 1, pos - 1) || n.d || substr(b, pos + 1), instr(substr(b, 1, pos - 1) || n.d || substr(b, pos + 1), '.')
  FROM search, (SELECT unnest(['1', '2', '3', '4', '5', '6', '7', '8', '9']) AS d) n
  WHERE pos > 0 AND instr(substr(b, (pos - 1) // 9 * 9 + 1, 9), n.d) = 0 AND instr({column}, n.d) = 0 AND instr({box}, n.d) = 0
), done AS (SELECT puzzle_id, b FROM search WHERE pos = 0)"""


@query("solve_made", f"WITH RECURSIVE {_MADE}{_search('made')} SELECT puzzle_id, min(b) AS solution, CAST(least(count(*), 2) AS INTEGER) AS n_solutions, count(*) = 1 AS is_unique FROM done GROUP BY puzzle_id")
def solve_made(spark, d):
    """A puzzle of every customer solved, and whether another solution exists."""
    return P.solve_puzzles(made_puzzles(spark, d).select("puzzle_id", "grid"))


@query("solve_fewest_made", f"WITH {_MADE} SELECT puzzle_id, 81 AS filled, true AS fits, true AS complete FROM made")
def solve_fewest_made(spark, d):
    """The search that takes the cell of fewest choices first: each solution is full, agrees with the clues and breaks no unit."""
    made = made_puzzles(spark, d)
    solved = P.solve_each(made.select("puzzle_id", "grid"), P.solve_fewest).withColumnRenamed("solution", "found")
    both = made.join(solved, "puzzle_id")
    fits = F.forall(F.sequence(F.lit(1), F.lit(81)), lambda i: F.substring("grid", i, F.lit(1)).isin(".") | (F.substring("grid", i, F.lit(1)) == F.substring("found", i, F.lit(1))))
    whole = P.completeness(P.cells(solved, "puzzle_id", "found"))
    return both.select("puzzle_id", fits.alias("fits")).join(whole, "puzzle_id").select("puzzle_id", F.col("filled").cast("int").alias("filled"), "fits", "complete")


@query("clues_made", f"WITH {_MADE} SELECT puzzle_id, CAST(81 - len(string_split(grid, '.')) + 1 AS INTEGER) AS n_clues, true AS rest_agrees, true AS solves FROM made")
def clues_made(spark, d):
    """Clues read from ranked digits of which the first four are wrong at first sight: as many as there are, solvable, and right where only one digit was offered."""
    made = made_puzzles(spark, d, dealt=True)
    found = P.search_clues(made.select("puzzle_id", "grid", F.col("full_grid").alias("solution")))
    cells = F.filter(F.sequence(F.lit(1), F.lit(81)), lambda i: F.substring("grid", i, F.lit(1)) != ".")
    agrees = F.forall(F.slice(cells, 5, 81), lambda i: F.substring("clues", i, F.lit(1)) == F.substring("grid", i, F.lit(1)))
    return found.select("puzzle_id", F.length(F.translate("clues", "0", "")).alias("n_clues"), agrees.alias("rest_agrees"), P.is_complete(F.col("solution")).alias("solves"))


@query(
    "safe_digits",
    f"""WITH {_MADE}, u AS (SELECT puzzle_id, i, d, 'r' AS kind, i // 9 AS unit FROM cell WHERE NOT gone UNION ALL SELECT puzzle_id, i, d, 'c', i % 9 FROM cell WHERE NOT gone UNION ALL SELECT puzzle_id, i, d, 'b', i // 27 * 3 + i % 9 // 3 FROM cell WHERE NOT gone),
o AS (SELECT puzzle_id, i, unnest([['r', CAST(i // 9 AS VARCHAR)], ['c', CAST(i % 9 AS VARCHAR)], ['b', CAST(i // 27 * 3 + i % 9 // 3 AS VARCHAR)]]) AS w FROM cell WHERE gone),
t AS (SELECT o.puzzle_id, o.i, count(DISTINCT u.d) AS taken FROM o LEFT JOIN u ON o.puzzle_id = u.puzzle_id AND u.kind = o.w[1] AND u.unit = CAST(o.w[2] AS BIGINT) GROUP BY ALL)
SELECT puzzle_id, i AS idx, CAST(9 - taken AS INTEGER) AS safe FROM t""",
)
def safe_digits(spark, d):
    """How many digits may still go into each empty cell, by the board that the clue search asks."""
    return P.safe_counts(made_puzzles(spark, d).select("puzzle_id", "grid"))


@query("made_grids", f"WITH {_MADE} SELECT puzzle_id, CAST(CAST(full_grid[1:9] AS BIGINT) AS BIGINT) AS first_row, 81 AS filled FROM made")
def made_grids(spark, d):
    """Grids from arrays of digits: 81 cells a puzzle, and the first row as a number."""
    digits = made_puzzles(spark, d).select("puzzle_id", F.split("full_grid", "").alias("digits"))
    cells = digits.select("puzzle_id", F.posexplode("digits").alias("idx", "c")).where("idx < 81")
    first = F.sum(F.when(F.col("idx") < 9, F.col("c").cast("long") * F.pow(F.lit(10), 8 - F.col("idx")).cast("long")).otherwise(0))
    return cells.groupBy("puzzle_id").agg(first.alias("first_row"), F.count(F.lit(1)).cast("int").alias("filled"))


@query("solved_drawings", f"WITH {_GLYPH}, {_MADE}, lit AS (SELECT digit, sum(bit_count(bits::UTINYINT)) AS n FROM gl GROUP BY digit), t AS (SELECT puzzle_id, sum(n) AS n FROM cell JOIN lit ON lit.digit = cell.d WHERE gone GROUP BY puzzle_id) SELECT puzzle_id, CAST(n * 4 AS BIGINT) AS on_grid, CAST(n * 4 AS BIGINT) AS on_photo FROM t")
def solved_drawings(spark, d):
    """Pixels that the digits of the solution colour, drawn on the grid itself and carried to a photo whose grid fills it."""
    import pyarrow as pa

    side = 216
    edge = [(0.0, 0.0), (side - 1.0, 0.0), (side - 1.0, side - 1.0), (0.0, side - 1.0)]

    def run(batches):
        blank, carrier = np.zeros((side, side, 3), np.uint8), draw.Carrier(side, side, edge, side)
        for batch in batches:
            counts = []
            for clues, full in zip(batch["grid"].to_pylist(), batch["full_grid"].to_pylist(), strict=True):
                flat = draw.solved_grid(blank, clues, full)
                carried = draw.solved_photo(blank, edge, clues, full, carrier=carrier)
                counts.append([np.count_nonzero(x[..., 0] == 255) for x in (flat, carried)])
            yield pa.RecordBatch.from_arrays([batch["puzzle_id"], *[pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)]], names=["puzzle_id", "on_grid", "on_photo"])

    return made_puzzles(spark, d, dealt=True).mapInArrow(run, "puzzle_id int, on_grid long, on_photo long")


# -- samples ------------------------------------------------------------------------------


@query("uniform_bounds", "SELECT count(*) AS n, true AS in_bounds, true AS whole_in_bounds, true AS spread FROM orders")
def uniform_bounds(spark, d):
    """Random numbers and whole numbers by key: within their bounds, with a mean near the middle."""
    rows = _table(spark, d, "orders").select(S.uniform("o_orderkey", 7, -2.0, 3.0).alias("u"), F.floor(S.uniform("o_orderkey", 8, 5, 11)).alias("w"))
    inside = F.min(F.col("u")) >= -2.0
    return rows.agg(F.count(F.lit(1)).alias("n"), (inside & (F.max("u") < 3.0)).alias("in_bounds"), ((F.min("w") >= 5) & (F.max("w") <= 10)).alias("whole_in_bounds"), (F.abs(F.avg("u") - 0.5) < 0.3).alias("spread"))


@query("shuffle_is_whole", "WITH n AS (SELECT count(*) AS n FROM embeddings), b AS (SELECT unnest(range((n + 31) // 32)) AS batch, n FROM n) SELECT CAST(batch AS BIGINT) AS batch, least(32, n - batch * 32) AS size, CAST(batch * 32 + 1 AS BIGINT) AS first_place, true AS moved FROM b")
def shuffle_is_whole(spark, d):
    """Batches of a seeded shuffle: every place is taken once, and rows don't stand in the order of their keys."""
    dealt = S.batches(_table(spark, d, "embeddings").select("vec_id"), S.seeded_order("vec_id", 1), 32)
    return dealt.groupBy("batch").agg(F.countDistinct("vec_id").alias("size"), F.min("position").alias("first_place"), (F.max(F.abs(F.col("vec_id") + 1 - F.col("position"))) > 0).alias("moved"))


@query("blank_samples", "SELECT count(*) // 9 AS n, 64 AS pixels, true AS labels_0, true AS faint, true AS three_kinds FROM embeddings")
def blank_samples(spark, d):
    """Blank cells: their number and size, label 0, and the three grounds they are drawn with."""
    n = _table(spark, d, "embeddings").count() // 9
    rows = S.empty_samples(spark, n, SIDE)
    most = F.array_max("pixels").cast("double")
    kinds = F.countDistinct(F.when(most <= 0.05, 0).when(most <= 0.15, 1).otherwise(2))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("pixels")).alias("pixels"), (F.max("label") == 0).alias("labels_0"), (F.max(most) <= 0.3001).alias("faint"), (kinds == 3).alias("three_kinds"))


@query("augmented_still", f"WITH {_PIX} SELECT vec_id, CAST(sum(v) AS BIGINT) AS still, true AS noisy_in_bounds FROM pix GROUP BY vec_id")
def augmented_still(spark, d):
    """Augmentation without turn, move and noise gives the image back; with them it stays within 0..1."""

    def both(img):
        unit = img / 255.0
        still = kernels.augment(unit, 3, 0.0, 0, 0.0)
        moved = kernels.augment(unit, 3)
        return np.array([int(np.round(still * 255).sum()), int(moved.shape == img.shape and moved.min() >= 0 and moved.max() <= 1)])

    made = kernels.map_arrays(images(spark, d).select("vec_id", "px"), "px", SIDE, both)
    return made.select("vec_id", F.get("px", F.lit(0)).cast("long").alias("still"), (F.get("px", F.lit(1)) == 1).alias("noisy_in_bounds"))


@query("random_matrices", "SELECT count(*) AS n, 12 AS size, true AS in_bounds, true AS differ, true AS copied FROM orders")
def random_matrices(spark, d):
    """Matrices of uniform numbers by key: their size and bounds, that rows differ, and that a copy is equal."""
    rows = _table(spark, d, "orders").select("o_orderkey", E.randomized("o_orderkey", 3, 3, 4, -0.5, 0.5).alias("m"))
    every = F.array_min("m"), F.array_max("m")
    differ = F.approx_count_distinct(F.get("m", F.lit(0))) > F.count(F.lit(1)) * 0.8
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("m")).alias("size"), ((F.min(every[0]) >= -0.5) & (F.max(every[1]) < 0.5)).alias("in_bounds"), differ.alias("differ"), F.min(E.copied("m") == F.col("m")).alias("copied"))


@query("training_settings", "SELECT CAST(k AS INTEGER) AS config_id, r::DOUBLE AS rate, m::DOUBLE AS momentum, 0.9::DOUBLE AS beta1, 0.999::DOUBLE AS beta2, true AS rate_alone_acts FROM (VALUES (1, 0.01, 0.0), (2, 0.01, 0.9), (3, 0.02, 0.9)) t(k, r, m)")
def training_settings(spark, d):
    """Settings of optimisers, and that a step hangs on the rate alone."""
    found = []
    for k, (rate, momentum) in enumerate(((0.01, 0.0), (0.01, 0.9), (0.02, 0.9)), 1):
        o, a, b = nn.Optimizer(rate, momentum), nn.Model(**_MODEL), nn.Model(**_MODEL)
        grads = {name: np.ones_like(w) for name, w in a.weights.items()}
        nn.step(a, grads, o)
        nn.step(b, grads, rate)
        found.append((k, o.rate, o.momentum, o.beta1, o.beta2, all(bool((a.weights[n] == b.weights[n]).all()) for n in nn.NAMES)))
    return spark.createDataFrame(found, "config_id int, rate double, momentum double, beta1 double, beta2 double, rate_alone_acts boolean")


# -- network ------------------------------------------------------------------------------

_MODEL = {"side": SIDE, "kernel": 2, "maps": (2, 3), "hidden": 6}


def _numbers(values: np.ndarray) -> str:
    return "[" + ", ".join(f"{float(v)!r}" for v in values.ravel()) + "]::DOUBLE[]"


def _network_sql() -> str:
    """The forward pass of a small model in SQL, its weights as literals: 8 x 8, two convolutions of 2 x 2 with pooling, two dense layers, softmax."""
    w = nn.Model(**_MODEL).weights
    return f"""{_PIX}, w AS (SELECT {_numbers(w['conv1_w'])} AS c1, {_numbers(w['conv2_w'])} AS c2, {_numbers(w['fc1_w'])} AS f1, {_numbers(w['fc2_w'])} AS f2),
two AS (SELECT unnest([0, 1]) AS k), win AS (SELECT a.k AS i, b.k AS j FROM two a, two b),
m1 AS (SELECT CAST(unnest(range(2)) AS INTEGER) AS f), m2 AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS f), h6 AS (SELECT CAST(unnest(range(6)) AS INTEGER) AS f), o10 AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS f),
a1 AS (SELECT p.vec_id, m1.f, p.x - j AS x, p.y - i AS y, greatest(0, sum(p.v / 255.0::DOUBLE * c1[m1.f * 4 + i * 2 + j + 1])) AS v FROM pix p, win, m1, w WHERE p.x - j BETWEEN 0 AND 6 AND p.y - i BETWEEN 0 AND 6 GROUP BY ALL),
p1 AS (SELECT vec_id, f, x // 2 AS x, y // 2 AS y, max(v) AS v FROM a1 WHERE x < 6 AND y < 6 GROUP BY ALL),
a2 AS (SELECT p.vec_id, m2.f, p.x - j AS x, p.y - i AS y, greatest(0, sum(p.v * c2[m2.f * 8 + p.f * 4 + i * 2 + j + 1])) AS v FROM p1 p, win, m2, w WHERE p.x - j BETWEEN 0 AND 1 AND p.y - i BETWEEN 0 AND 1 GROUP BY ALL),
p2 AS (SELECT vec_id, f, max(v) AS v FROM a2 GROUP BY ALL),
h AS (SELECT vec_id, h6.f, greatest(0, sum(v * f1[h6.f * 3 + p2.f + 1])) AS v FROM p2, h6, w GROUP BY ALL),
z AS (SELECT vec_id, o10.f, sum(v * f2[o10.f * 6 + h.f + 1]) AS z FROM h, o10, w GROUP BY ALL),
e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z), p AS (SELECT vec_id, f, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e)"""


def _network(spark: SparkSession, d: str) -> DataFrame:
    rows = images(spark, d).select("vec_id", "label", E.normalise("px").alias("pixels"))
    return nn.predict(rows, nn.Model(**_MODEL))


@query("network_forward", f"WITH {_network_sql()}, best AS (SELECT vec_id, arg_max(f, p) AS f FROM p GROUP BY vec_id) SELECT p.f AS class, round(avg(p), 5) AS mean_p, round(stddev_samp(p), 5) AS spread, CAST((SELECT count(*) FROM best WHERE best.f = p.f) AS BIGINT) AS n_predicted FROM p GROUP BY p.f")
def network_forward(spark, d):
    """A small network with fixed weights over all vectors as images: each class's probability, and how often it is the greatest."""
    out = _network(spark, d)
    each = out.select("predicted", F.posexplode("probabilities").alias("class", "p")).withColumn("p", F.col("p").cast("double"))
    return each.groupBy("class").agg(_r(F.avg("p"), 5).alias("mean_p"), _r(F.stddev_samp("p"), 5).alias("spread"), F.sum((F.col("predicted") == F.col("class")).cast("long")).alias("n_predicted"))


@query("network_shapes", "SELECT * FROM (VALUES ('conv1', 6, 25, 24, 12), ('conv2', 16, 150, 8, 4), ('fc1', 120, 256, 1, 1), ('fc2', 10, 120, 1, 1)) t(layer, units, inputs, side, pooled)")
def network_shapes(spark, d):
    """Units, inputs of a unit, and sides of the maps of the usual model."""
    m, rows, side = nn.Model(), [], 28
    for name in ("conv1", "conv2", "fc1", "fc2"):
        w = m.weights[f"{name}_w"]
        side = side - m.kernel + 1 if w.ndim == 4 else 1
        rows.append((name, len(w), int(np.prod(w.shape[1:])), side, side // 2 if w.ndim == 4 else 1))
        side //= 2
    return spark.createDataFrame(rows, "layer string, units int, inputs int, side int, pooled int")


@query("gradient_check", "SELECT * FROM (VALUES ('conv1_w'), ('conv1_b'), ('conv2_w'), ('conv2_b'), ('fc1_w'), ('fc1_b'), ('fc2_w'), ('fc2_b')) t(layer), (SELECT true AS agrees, count(*) AS n FROM embeddings)")
def gradient_check(spark, d):
    """The gradient of all vectors, summed over the cluster, against the slope of the loss along it, layer by layer."""
    rows = images(spark, d).select(E.normalise("px").alias("pixels"), "label")
    m = nn.Model(**_MODEL)
    grads, _, n = nn.batch_gradients(rows, m)
    out = []
    for name in nn.NAMES:
        g = grads[name]
        size = float(np.sqrt((g * g).sum()))
        # small, as the loss has kinks where a maximum or a rectifier turns
        step, losses = 1e-4, []
        for sign in (1, -1):
            moved = m.copy()
            moved.weights[name] = (moved.weights[name] + sign * step * g / max(size, 1e-12)).astype(np.float64)
            losses.append(nn.batch_gradients(rows, moved)[1])
        out.append((name, bool(abs((losses[0] - losses[1]) / (2 * step) - size) <= 0.05 * size + 1e-5 * n), n))
    return spark.createDataFrame(out, "layer string, agrees boolean, n long")


@query("training_step", "SELECT count(*) AS n, true AS loss_falls, true AS step_is_rate FROM embeddings")
def training_step(spark, d):
    """One step down the gradient of all vectors: the loss falls, and weights move by the rate times the gradient."""
    rows = images(spark, d).select(E.normalise("px").alias("pixels"), "label")
    m = nn.Model(**_MODEL)
    grads, before, n = nn.batch_gradients(rows, m)
    moved = m.copy()
    nn.step(moved, grads, 0.05 / n)
    after = nn.batch_gradients(rows, moved)[1]
    exact = all(np.allclose(moved.weights[k], m.weights[k] - 0.05 / n * grads[k], atol=1e-6) for k in nn.NAMES)
    return spark.createDataFrame([(n, after < before, exact)], "n long, loss_falls boolean, step_is_rate boolean")


@query("grid_search_table", "SELECT CAST(k AS INTEGER) AS config_id, n, n - CAST(floor(n * 0.7) AS BIGINT) AS tested, true AS in_bounds FROM (SELECT unnest([1, 2]) AS k), (SELECT count(*) AS n FROM embeddings)")
def grid_search_table(spark, d):
    """Two trainings of one pass each: what they are tested on, and that accuracy and F1 lie in 0..1."""
    rows = images(spark, d).select("vec_id", E.normalise("px").alias("pixels"), "label")
    configs = spark.createDataFrame([(1, 1, 32, 0.01), (2, 1, 32, 0.02)], "config_id int, epochs int, batch_size int, learning_rate double")
    found = nn.grid_search(rows.orderBy("vec_id"), configs, nn.Model(**_MODEL))
    total = F.aggregate("confusion", F.lit(0).cast("long"), lambda a, v: a + v)
    return found.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n")))).select("config_id", "n", total.alias("tested"), (F.col("accuracy").between(0, 1) & F.col("macro_f1").between(0, 1)).alias("in_bounds"))


@query("photos_solved", "SELECT 'solved' AS status, count(*) AS n, true AS right FROM nation WHERE n_nationkey < 4")
def photos_solved(spark, d):
    """Drawn photos of four puzzles, from image to solution with a classifier trained here."""
    from gridlens.plans import solver

    made = made_puzzles(spark, d).orderBy("puzzle_id").limit(4).collect()
    m = solver.digit_model(12, 6)
    photos = [draw.draw_puzzle(r.grid, 360) for r in made]
    df = spark.createDataFrame([(str(r.puzzle_id), p.shape[1], p.shape[0], 1, bytearray(p.tobytes())) for r, p in zip(made, photos, strict=True)], "origin string, width int, height int, channels int, data binary")
    solved = solver.solve_photos(df, m)
    known = spark.createDataFrame([(str(r.puzzle_id), r.grid) for r in made], "origin string, grid string")
    right = F.col("clues") == F.col("grid")
    return solved.join(known, "origin").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce(right, F.lit(False))).alias("right"))


# -- files, written and read again --------------------------------------------------------


def _bytes(px) -> F.Column:
    return F.unhex(F.array_join(F.transform(px, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def _mass(pixels) -> F.Column:
    """Of pixels 0..1."""
    return F.aggregate(pixels, F.lit(0).cast("long"), lambda a, v: a + F.round(v * 255).cast("long"))


_SUMS = _IMG + ", s AS (SELECT vec_id, label, CAST(list_sum(px) AS BIGINT) AS mass FROM img)"


@query("idx_round_trip", f"WITH {_SUMS}, n AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS sample_id FROM s) SELECT sample_id, CAST(label AS SMALLINT) AS label, mass FROM n WHERE label <> 0")
def idx_round_trip(spark, d):
    """All images as an IDX pair, read back without label 0."""
    path = scratch(spark, "idx")
    samples = images(spark, d).select("vec_id", "label", _bytes("px").alias("pixels"))
    files.write_files(records.idx_cells(samples, "vec_id", SIDE, SIDE), path)
    back = records.read_idx(spark, f"{path}/images.idx", f"{path}/labels.idx")
    return back.select("sample_id", "label", _mass("pixels").alias("mass"))


@query("framed_round_trip", f"WITH {_SUMS} SELECT CAST(label AS SMALLINT) AS label, count(*) AS n, CAST(sum(mass) AS BIGINT) AS mass FROM s WHERE label <> 0 GROUP BY label")
def framed_round_trip(spark, d):
    """All images in framed files, read back without label 0."""
    path = scratch(spark, "framed")
    samples = images(spark, d).select("label", _bytes("px").alias("pixels"))
    files.write_files(records.framed_cells(samples, SIDE, SIDE), path)
    return records.read_framed(spark, path).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(_mass("pixels")).alias("mass"))


@query("png_round_trip", f"WITH {_SUMS} SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 3 END AS channels, 8 AS width, 8 AS height, CASE WHEN vec_id % 2 = 0 THEN mass ELSE mass + 64 * 255 END AS mass FROM s")
def png_round_trip(spark, d):
    """Every image as a PNG file, gray or red and green (blue is full), read back by Spark's image source."""

    def encode(img):
        return img, np.dstack([img, img * 0, img * 0 + 255])

    return _pictures(spark, d, encode).select("vec_id", "channels", "width", "height", _byte_sum("data").alias("mass"))


def _byte_sum(data: str) -> F.Column:
    digits = F.hex(data)
    steps = F.sequence(F.lit(1), F.length(data))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, i: a + F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))


def _write_pictures(spark, d, name, encode) -> str:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            made = [encode(np.array(r["px"], np.uint8).reshape(SIDE, SIDE)) for r in rows]
            bodies = [draw.png_encode(m[r["vec_id"] % 2]) for r, m in zip(rows, made, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([name(r) for r in rows]), pa.array(bodies, pa.binary())], names=["file", "body"])

    path = scratch(spark, "pictures")
    files.write_files(images(spark, d).mapInArrow(run, "file string, body binary"), path)
    return path


def _pictures(spark, d, encode) -> DataFrame:
    path = _write_pictures(spark, d, lambda r: f"img_{r['vec_id']}.png", encode)
    return files.read_images(spark, path).withColumn("vec_id", F.regexp_extract("origin", r"img_(\d+)\.png", 1).cast("long"))


@query("digit_folder", f"WITH {_SUMS} SELECT printf('digit_%05d_label_%d.png', vec_id, label) AS filename, CAST(label AS SMALLINT) AS label, 'drawn' AS font, mass FROM s")
def digit_folder(spark, d):
    """A folder of labelled digits: its metadata, and the pixels it gives."""
    path = _write_pictures(spark, d, lambda r: f"digit_{r['vec_id']:05d}_label_{r['label']}.png", lambda img: (img, img))
    samples = files.read_digit_folder(spark, path, SIDE)
    sums = samples.select(F.element_at(F.split("origin", "/"), -1).alias("filename"), _mass("pixels").alias("mass"))
    return files.digit_metadata(samples).join(sums, "filename").select("filename", "label", "font", "mass")


@query("labels_npy", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS position, CAST(label AS BIGINT) AS value FROM embeddings")
def labels_npy(spark, d):
    path = f"{scratch(spark, 'npy')}.npy"
    files.write_npy(_table(spark, d, "embeddings"), path, "label", [F.col("vec_id")])
    return files.read_npy(spark, path)


@query("weights_round_trip", "SELECT * FROM (VALUES ('conv1_w', 8, true), ('conv1_b', 2, true), ('conv2_w', 24, true), ('conv2_b', 3, true), ('fc1_w', 18, true), ('fc1_b', 6, true), ('fc2_w', 60, true), ('fc2_b', 10, true)) t(name, n, same)")
def weights_round_trip(spark, d):
    """Weights of a small model, written, read and compared."""
    m, path = nn.Model(**_MODEL), scratch(spark, "weights")
    files.write_files(spark.createDataFrame([("w.bin", bytearray(files.weights_bytes(m)))], "file string, body binary"), path)
    back = files.read_weights(spark, f"{path}/w.bin", nn.Model(**_MODEL, seed=2))
    return spark.createDataFrame([(k, m.weights[k].size, bool((back.weights[k] == m.weights[k]).all())) for k in nn.NAMES], "name string, n int, same boolean")


@query("results_round_trip", "SELECT p_size AS epochs, 32 AS batch_size, round(p_retailprice / 1000, 4) AS learning_rate, round(p_size / 100.0::DOUBLE, 4) AS accuracy, round(p_retailprice, 2) AS training_time, 0.5::DOUBLE AS f1_9, count(*) AS n FROM part GROUP BY ALL")
def results_round_trip(spark, d):
    """A table of results made of parts, written as CSV and read back."""
    path = scratch(spark, "results")
    score = F.col("p_size") / 100.0
    rows = _table(spark, d, "part").select(F.col("p_size").alias("epochs"), F.lit(32).alias("batch_size"), _r(F.col("p_retailprice") / 1000, 4).alias("learning_rate"), F.lit(0.9).alias("momentum"), score.alias("accuracy"), score.alias("avg_f1_score"), F.col("p_retailprice").alias("training_time"), *[F.lit(0.5).alias(f"{m}_{k}") for k in range(10) for m in files.METRICS])
    files.write_results(rows, path)
    return files.read_results(spark, path).groupBy("epochs", "batch_size", "learning_rate", "accuracy", "training_time", "f1_9").agg(F.count(F.lit(1)).alias("n"))


@query("parameters_round_trip", "WITH b AS (SELECT * FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 1) SELECT 'EPOCHS' AS name, CAST(p_size AS DOUBLE) AS value FROM b UNION ALL SELECT 'LEARNING_RATE', round(p_retailprice, 4) FROM b UNION ALL SELECT 'BATCH_SIZE', 32.0::DOUBLE FROM b")
def parameters_round_trip(spark, d):
    """The best part's numbers as a file of parameters, read back."""
    path = scratch(spark, "parameters")
    best = R.ranking(_table(spark, d, "part"), "p_size", "p_retailprice", "p_partkey", 1).first()
    files.write_parameters(spark, path, {"EPOCHS": best.p_size, "LEARNING_RATE": round(best.p_retailprice, 4), "BATCH_SIZE": 32}, ["best"])
    return spark.createDataFrame(list(files.read_parameters(spark, path).items()), "name string, value double")


@query("big_endian", "SELECT s_suppkey, CAST(ascii(substr(s_name, 1, 1)) * 16777216 + ascii(substr(s_name, 2, 1)) * 65536 + ascii(substr(s_name, 3, 1)) * 256 + ascii(substr(s_name, 4, 1)) AS BIGINT) AS head, CAST(0 AS BIGINT) AS beyond FROM supplier")
def big_endian(spark, d):
    """The first four bytes of names as a number, and one past their end."""
    body = F.encode("s_name", "UTF-8")
    rows = _table(spark, d, "supplier").select("s_suppkey", body.alias("b"))
    return rows.select("s_suppkey", E.big_endian_int("b", F.lit(0)).alias("head"), E.big_endian_int("b", F.length("b") - 2).alias("beyond"))
