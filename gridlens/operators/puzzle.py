"""9 x 9 number puzzles as strings of 81 characters, '.' or '0' for an empty cell.

Checks are relational: a grid is 81 rows, and a cell's peers are found by unit, not
by comparing all pairs. Search is per puzzle: as recursive SQL where all solutions are wanted, and as
a depth-first search inside ``mapInArrow`` for throughput, one puzzle a row and
nothing shared between rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Calls after which the clue search gives up.
CLUE_CALLS = 100_000


# -- relational checks ------------------------------------------------------------------


def cells(df: DataFrame, key: str = "puzzle_id", grid: str = "grid") -> DataFrame:
    """key, idx 0..80, r, c, box and d (0 if empty)."""
    digit = F.substring(F.col(grid), F.col("idx") + 1, F.lit(1))
    out = df.select(key, F.col(grid), F.explode(F.sequence(F.lit(0), F.lit(80))).alias("idx"))
    r, c = F.floor(F.col("idx") / 9).cast("int"), F.col("idx") % 9
    out = out.withColumn("r", r).withColumn("c", c).withColumn("box", (F.floor(r / 3) * 3 + F.floor(c / 3)).cast("int"))
    return out.withColumn("d", F.when(digit.rlike("[1-9]"), digit.cast("int")).otherwise(0)).drop(grid)


def units() -> Column:
    """The row, column and box of a cell as (kind, unit)."""
    return F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("unit")) for k, c in (("r", "r"), ("c", "c"), ("b", "box"))]))


def conflicts(grid_cells: DataFrame, key: str = "puzzle_id") -> DataFrame:
    """key, kind, unit, d and n of digits that stand more than once in a unit."""
    spread = grid_cells.where("d > 0").select(key, "d", units().alias("u"))
    return spread.groupBy(key, F.col("u.kind").alias("kind"), F.col("u.unit").alias("unit"), "d").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def completeness(grid_cells: DataFrame, key: str = "puzzle_id") -> DataFrame:
    """key, filled, bad_units and complete."""
    bad = conflicts(grid_cells, key).groupBy(key).agg(F.count(F.lit(1)).alias("bad"))
    filled = grid_cells.groupBy(key).agg(F.sum((F.col("d") > 0).cast("long")).alias("filled"))
    out = filled.join(bad, key, "left").withColumn("bad_units", F.coalesce("bad", F.lit(0)))
    return out.select(key, "filled", "bad_units", ((F.col("filled") == 81) & (F.col("bad_units") == 0)).alias("complete"))


def is_complete(grid: Column) -> Column:
    """Whether a grid is full and breaks no unit, from its own row; false of null."""

    def part(at: int, n: int) -> Column:
        return F.substring(grid, at + 1, F.lit(n))

    rows = [part(9 * k, 9) for k in range(9)]
    columns = [F.concat(*[part(9 * r + k, 1) for r in range(9)]) for k in range(9)]
    boxes = [F.concat(*[part(k // 3 * 27 + r * 9 + k % 3 * 3, 3) for r in range(3)]) for k in range(9)]
    twice = F.concat_ws(" ", *rows, *columns, *boxes).rlike("([1-9])[1-9]*\\1")
    return F.coalesce(grid.rlike("^[1-9]{81}\\z") & ~twice, F.lit(False))


def allowed(grid_cells: DataFrame, key: str = "puzzle_id") -> DataFrame:
    """key, idx and d of digits that an empty cell's units don't hold yet: an anti join by unit."""
    seen = grid_cells.where("d > 0").select(key, "d", units().alias("u")).select(key, "u.kind", "u.unit", "d").distinct()
    open_cells = grid_cells.where("d = 0").select(key, "idx", units().alias("u"), F.lit(0).alias("_")).select(key, "idx", "u.kind", "u.unit")
    taken = open_cells.join(seen, [key, "kind", "unit"]).select(key, "idx", "d").distinct()
    every = grid_cells.where("d = 0").select(key, "idx", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("d"))
    return every.join(taken, [key, "idx", "d"], "left_anti")


def fewest_choices(grid_cells: DataFrame, key: str = "puzzle_id") -> DataFrame:
    """key, idx and choices of the empty cell with fewest allowed digits, the first of equals."""
    counts = allowed(grid_cells, key).groupBy(key, "idx").agg(F.count(F.lit(1)).alias("n"))
    every = grid_cells.where("d = 0").select(key, "idx").join(counts, [key, "idx"], "left").select(key, "idx", F.coalesce("n", F.lit(0)).alias("n"))
    return every.groupBy(key).agg(F.min(F.struct("n", "idx")).alias("b")).select(key, F.col("b.idx").alias("idx"), F.col("b.n").cast("long").alias("choices"))


def added_cells(solved: DataFrame, clues: DataFrame, key: str = "puzzle_id") -> DataFrame:
    """Cells of the solution that the clues leave open."""
    return cells(solved, key).join(cells(clues, key).where("d > 0").select(key, "idx"), [key, "idx"], "left_anti")


# -- recursive SQL ----------------------------------------------------------------------

RECURSIVE_SQL = """
WITH RECURSIVE search(puzzle_id, b, pos) AS (
  SELECT puzzle_id, grid, instr(grid, '.') FROM {puzzles}
  UNION ALL
  SELECT puzzle_id, nb, instr(nb, '.') FROM (
    SELECT s.puzzle_id, concat(substring(s.b, 1, s.pos - 1), n.d, substring(s.b, s.pos + 1, 81)) AS nb
    FROM search s JOIN (SELECT explode(array('1','2','3','4','5','6','7','8','9')) AS d) n
    ON s.pos > 0
      AND instr(substring(s.b, CAST(floor((s.pos - 1) / 9) AS INT) * 9 + 1, 9), n.d) = 0
      AND instr(concat({column}), n.d) = 0
      AND instr(concat({box}), n.d) = 0
  ) AS step
)
SELECT puzzle_id, b FROM search WHERE pos = 0
"""


def solutions(spark: SparkSession, puzzles: DataFrame) -> DataFrame:
    """puzzle_id and b: every solution, breadth first. For puzzles with few solutions; empty cells must be '.'."""
    puzzles.createOrReplaceTempView("gridlens_puzzles")
    column = ", ".join(f"substring(s.b, (s.pos - 1) % 9 + {9 * k + 1}, 1)" for k in range(9))
    box = ", ".join(f"substring(s.b, CAST(floor((s.pos - 1) / 27) AS INT) * 27 + CAST(floor((s.pos - 1) % 9 / 3) AS INT) * 3 + {9 * k + 1}, 3)" for k in range(3))
    return spark.sql(RECURSIVE_SQL.format(puzzles="gridlens_puzzles", column=column, box=box))


# -- depth-first search -----------------------------------------------------------------

_UNITS = [(r, 9 + c, 18 + r // 3 * 3 + c // 3) for r in range(9) for c in range(9)]
#: Bits of the digits 1..9.
_ALL = 0b1111111110


class Board:
    """Digits in cells, and a bit mask of the digits of every unit."""

    def __init__(self, grid: str):
        text = (grid + "." * 81)[:81]
        self.d = [int(x) if x in "123456789" else 0 for x in text]
        self.used = [0] * 27
        self.valid = True
        for i, d in enumerate(self.d):
            if d:
                self.valid &= self.fits(i, d)
                self.put(i, d)

    def fits(self, i: int, d: int) -> bool:
        a, b, c = _UNITS[i]
        return not (self.used[a] | self.used[b] | self.used[c]) >> d & 1

    def put(self, i: int, d: int) -> None:
        self.d[i] = d
        for u in _UNITS[i]:
            self.used[u] |= 1 << d

    def take(self, i: int) -> None:
        for u in _UNITS[i]:
            self.used[u] &= ~(1 << self.d[i])
        self.d[i] = 0

    def choices(self, i: int) -> list[int]:
        a, b, c = _UNITS[i]
        free = ~(self.used[a] | self.used[b] | self.used[c])
        return [d for d in range(1, 10) if free >> d & 1]

    def text(self) -> str:
        return "".join(map(str, self.d))

    def fewest(self) -> int:
        """The empty cell of fewest choices, the first of equals; -1 if none."""
        best, least = -1, 10
        for i, d in enumerate(self.d):
            if not d and (n := len(self.choices(i))) < least:
                best, least = i, n
                if n <= 1:
                    break
        return best


def search(board: Board, pick: Callable[[Board], int], most: int = 1) -> list[str]:
    """Up to ``most`` solutions, lowest digits first in the cells that ``pick`` names."""
    found: list[str] = []
    if not board.valid:
        return found
    trail: list[tuple[int, list[int]]] = []
    i = pick(board)
    while True:
        if i < 0:
            found.append(board.text())
            if len(found) >= most:
                return found
        else:
            trail.append((i, board.choices(i)[::-1]))
        while trail:
            i, rest = trail[-1]
            if board.d[i]:
                board.take(i)
            if rest:
                board.put(i, rest.pop())
                break
            trail.pop()
        if not trail:
            return found
        i = pick(board)


def first_solution(d: list[int], used: list[int], cells: list[int]) -> list[int] | None:
    """The lexicographically first solution of digits and unit masks without clashes, whose empty ``cells`` stand in order; fills both lists.

    What can only be one digit is put first, in all solutions alike; then the first cell left takes its digits in turn.
    """
    while True:
        rest = []
        for i in cells:
            a, b, c = _UNITS[i]
            free = _ALL & ~(used[a] | used[b] | used[c])
            if not free:
                return None
            if free & (free - 1):
                rest.append(i)
            else:
                d[i] = free.bit_length() - 1
                used[a] |= free
                used[b] |= free
                used[c] |= free
        if not rest:
            return d
        if len(rest) == len(cells):
            break
        cells = rest
    a, b, c = _UNITS[rest[0]]
    free = _ALL & ~(used[a] | used[b] | used[c])
    while free:
        bit = free & -free
        free ^= bit
        e, masks = d[:], used[:]
        e[rest[0]] = bit.bit_length() - 1
        for u in (a, b, c):
            masks[u] |= bit
        if found := first_solution(e, masks, rest[1:]):
            return found
    return None


def solve(grid: str) -> str | None:
    """The lexicographically first solution."""
    board = Board(grid)
    found = first_solution(board.d, board.used, [i for i, d in enumerate(board.d) if not d]) if board.valid else None
    return "".join(map(str, found)) if found else None


def solve_fewest(grid: str) -> str | None:
    """A solution by fewest choices first; another than ``solve``'s where there are several."""
    return next(iter(search(Board(grid), Board.fewest)), None)


def count_solutions(grid: str, most: int = 2) -> int:
    return len(search(Board(grid), Board.fewest, most))


def find_clues(ranked: list[tuple[int, list[int]]], calls: int = CLUE_CALLS, beam: int = 5) -> tuple[str, str] | None:
    """Clues and solution from recognised cells.

    ``ranked``: (cell, digits by probability) of the cells that hold something, the surest cell first. Takes of
    each cell one of its first ``beam`` digits, depth first, such that clues don't clash and the puzzle has a
    solution; None if there is none or after ``calls`` steps.
    """
    offers = [(*_UNITS[cell], [1 << d for d in digits[:beam]]) for cell, digits in ranked]
    clued = {cell for cell, _ in ranked}
    empty = [i for i in range(81) if i not in clued]
    used, n, k = [0] * 27, len(ranked), 0
    left, put = [iter(())] * n, [0] * n  # of each cell the digits not tried yet, and the one that stands
    while calls > 0:
        calls -= 1
        if k < n:
            a, b, c, bits = offers[k]
            left[k], bit = iter(bits), 0
        else:
            d = [0] * 81
            for (cell, _), bit in zip(ranked, put, strict=True):
                d[cell] = bit.bit_length() - 1
            clues = "".join(map(str, d))
            if solved := first_solution(d, used[:], empty):
                return clues, "".join(map(str, solved))
            bit = -1
        while True:  # the next digit of this cell that fits, or back to the cell before
            if bit < 0:
                k -= 1
                if k < 0:
                    return None
                a, b, c, _ = offers[k]
                bit = put[k]
                used[a] ^= bit
                used[b] ^= bit
                used[c] ^= bit
            taken = used[a] | used[b] | used[c]
            for bit in left[k]:
                if not taken & bit:
                    break
            else:
                bit = -1
                continue
            break
        used[a] |= bit
        used[b] |= bit
        used[c] |= bit
        put[k] = bit
        k += 1
    return None


def solve_puzzles(df: DataFrame, key: str = "puzzle_id", grid: str = "grid", most: int = 2) -> DataFrame:
    """key, solution (the lexicographically first; null if none), n_solutions (up to ``most``) and is_unique."""
    made = T.StructType([df.schema[key], T.StructField("solution", T.StringType()), T.StructField("n_solutions", T.IntegerType()), T.StructField("is_unique", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = [g or "" for g in batch.column(1).to_pylist()]
            solved = [solve(g) if len(g) == 81 else None for g in grids]
            counts = [count_solutions(g, most) if len(g) == 81 else 0 for g in grids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(solved, pa.string()), pa.array(counts, pa.int32()), pa.array([c == 1 for c in counts])], names=made.names)

    return df.select(key, grid).mapInArrow(run, made)


def solve_each(df: DataFrame, how: Callable[[str], str | None], key: str = "puzzle_id", grid: str = "grid") -> DataFrame:
    """key and solution, as ``how`` (``solve`` or ``solve_fewest``) finds it; null of none, of null and of grids of another length."""
    made = T.StructType([df.schema[key], T.StructField("solution", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [how(g) if g and len(g) == 81 else None for g in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=made.names)

    return df.select(key, grid).mapInArrow(run, made)


def safe_counts(df: DataFrame, key: str = "puzzle_id", grid: str = "grid") -> DataFrame:
    """key, idx and safe: how many digits clash with nothing in each empty cell."""
    made = T.StructType([df.schema[key], T.StructField("idx", T.IntegerType()), T.StructField("safe", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, safe = [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                board = Board(text or "")
                open_cells = [i for i, d in enumerate(board.d) if not d]
                keys += [k] * len(open_cells)
                at += open_cells
                safe += [sum(board.fits(i, d) for d in range(1, 10)) for i in open_cells]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(at, pa.int32()), pa.array(safe, pa.int32())], names=made.names)

    return df.select(key, grid).mapInArrow(run, made)


def search_clues(df: DataFrame, key: str = "puzzle_id") -> DataFrame:
    """key, grid, clues and solution: the clue search over grids whose given cells (``grid``) are ranked with a wrong digit before that of ``solution``."""
    made = T.StructType([df.schema[key], T.StructField("grid", T.StringType()), T.StructField("clues", T.StringType()), T.StructField("solution", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for grid, solved in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                cells = [k for k, c in enumerate(grid) if c not in ".0"]
                ranked = [(k, [int(solved[k]) % 9 + 1, int(solved[k])] if n < 4 else [int(solved[k])]) for n, k in enumerate(cells)]
                found.append(find_clues(ranked) or (None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=made.names)

    return df.select(key, "grid", "solution").mapInArrow(run, made)


def render(grid: Column) -> Column:
    """Nine lines of digits with spaces, '.' for an empty cell."""
    plain = F.translate(grid, "0", ".")
    rows = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda r: F.array_join(F.split(F.substring(plain, r * 9 + 1, F.lit(9)), ""), " "))
    return F.array_join(F.transform(rows, lambda r: F.trim(r)), "\n")
