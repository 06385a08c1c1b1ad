"""A sample whose categories follow target shares in several dimensions at once.

Rows are counted in cells, one for each combination of categories; categories without a target share one
place in each dimension, so the table of cells is bounded by the targets whatever the data. On the
cells (on the driver):

1. each dimension's row numbers are set: minimums first, then shares, both up to what is there;
2. expected cell numbers are fitted to them by proportional fitting under the cells' availability;
3. a minimum-cost flow of all rows runs from the categories of one dimension through the cells to those of another: source and
   sink arcs carry the margins, the reward of floors and targets and the cost of going beyond them, cell arcs the
   availability. The fitted numbers are only costs: a cell's arc is free up to the whole part, has a random cost
   for the next row that favours large fractions, which makes the rounding random, and a higher one beyond. The other dimensions
   enter as prices on the cell arcs, raised and lowered until their margins fit. What the flow leaves of a
   floor or target is its slack: the shortfall in the report;
4. exchanges between cells remove what deviation prices left in those dimensions, minimums of all dimensions first.

A flow has two sides, so with more dimensions the result need not be the optimum; ``short_of_minimum``, ``short_of_wanted``
and ``beyond_wanted`` state for each category what is left.

Quotas are then drawn by hashed keys, exactly, from groups of any size.

Cases: deliveries of one id count once, with the values received last; null and unknown categories are
drawn only where the other dimensions need them; a null or negative share is 0 and a null minimum 0; null ids are dropped;
a size beyond the rows gives all rows; an empty table gives an empty sample and all targets unmet.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.operators.sampling import take_by_quota, uniform

DIMENSIONS = ("domain", "model", "is_ai", "attack")
OTHER = "(other)"
#: Part of the distinct rows that is drawn unless a size is given.
PART = 0.25
TOLERANCE = 0.005
FLOOR_REWARD, TARGET_REWARD, EXCESS_COST = 100.0, 6.0, 4.0
#: Cost of a cell's rows beyond the fitted number.
BEYOND = 3.0
#: Rounds in which the prices of the dimensions beside the flow are set.
TURNS = 8


def latest(generations: DataFrame) -> DataFrame:
    """One row for each id, with the categories of the last delivery, in canonical spelling."""
    clean = {d: F.lower(F.trim(F.col(d).cast("string"))) for d in DIMENSIONS}
    values = F.struct(F.col("received_at"), *[c.alias(d) for d, c in clean.items()])
    return generations.filter("id is not null").groupBy("id").agg(F.max(values).alias("x")).select("id", *[F.col(f"x.{d}").alias(d) for d in DIMENSIONS])


def margin_goal(available: np.ndarray, share: np.ndarray, floor: np.ndarray, size: int) -> np.ndarray:
    """Rows wanted of each category: minimums, then shares, as far as rows are there; the sum is at most ``size``."""
    base = np.minimum(floor, available).astype(float)
    if base.sum() > size:
        base *= size / base.sum()
    goal = np.maximum(base, np.minimum(share * size, available))
    for _ in range(200):
        gap = size - goal.sum()
        if abs(gap) < 1e-6:
            break
        if gap > 0:
            room = goal < available - 1e-9
            weight = np.where(room, np.maximum(share, 1e-9), 0.0)
            if not weight.sum():
                break
            goal = np.minimum(available, goal + gap * weight / weight.sum())
        else:
            room = np.maximum(goal - base, 0.0)
            if not room.sum():
                break
            goal = goal + gap * room / room.sum()
    whole = np.floor(goal + 1e-9)
    rest = int(round(min(size, goal.sum()) - whole.sum()))
    for i in np.argsort(-(goal - whole), kind="stable")[: max(0, rest)]:
        whole[i] += 1
    return np.minimum(whole, available).astype(np.int64)


def fitted(cells: np.ndarray, available: np.ndarray, goals: list[np.ndarray], rounds: int = 300) -> np.ndarray:
    """Expected rows of each cell: proportional fitting of the availability to all margins, capped by it."""
    x = available.astype(float)
    total = sum(goals[0])
    if x.sum():
        x *= min(1.0, total / x.sum())
    for _ in range(rounds):
        worst = 0.0
        for d, goal in enumerate(goals):
            now = np.bincount(cells[:, d], x, len(goal))
            ratio = np.divide(goal, now, out=np.ones(len(goal)), where=now > 0)
            worst = max(worst, np.abs(now - goal).max(initial=0.0))
            x = np.minimum(x * ratio[cells[:, d]], available)
        if worst < 0.25:
            break
    return x


class Transport:
    """Minimum-cost flow: source, categories of one dimension, cells, categories of another, sink.

    Several cells may join the same two categories; for a path only the cheapest one that has room, and
    for a way back only the dearest one that is used, matter.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, room: np.ndarray, cost: np.ndarray, n_left: int, n_right: int):
        self.room, self.cost, self.flow = room.copy(), cost, np.zeros(len(room), np.int64)
        self.shape = (n_left, n_right)
        self.at: dict[tuple[int, int], list[int]] = {}
        for i in np.argsort(cost, kind="stable"):
            self.at.setdefault((int(left[i]), int(right[i])), []).append(int(i))
        self.ahead = np.full(self.shape, np.inf)
        self.back = np.full(self.shape, np.inf)
        self.arc = {}
        for place in self.at:
            self._refresh(place)

    def _refresh(self, place: tuple[int, int]) -> None:
        cheapest = dearest = None
        for i in self.at[place]:
            if cheapest is None and self.flow[i] < self.room[i]:
                cheapest = i
            if self.flow[i] > 0:
                dearest = i
        self.ahead[place] = np.inf if cheapest is None else self.cost[cheapest]
        self.back[place] = np.inf if dearest is None else -self.cost[dearest]
        self.arc[place] = (cheapest, dearest)

    def run(self, sides: tuple[list[list[list[float]]], list[list[list[float]]]], amount: int) -> int:
        """Send up to ``amount`` along cheapest paths; each side lists (room, cost) pieces of every category, cheapest first."""
        sent = 0
        supply, demand = sides
        while sent < amount:
            first = np.array([p[0][1] if p else np.inf for p in supply])
            last = np.array([p[0][1] if p else np.inf for p in demand])
            dist, over = first.copy(), np.full(self.shape[1], np.inf)
            from_right = np.full(self.shape[0], -1)
            from_left = np.full(self.shape[1], -1)
            for _ in range(2 * sum(self.shape)):
                options = dist[:, None] + self.ahead
                best = options.argmin(0)
                value = options[best, np.arange(self.shape[1])]
                better = value < over - 1e-9
                over[better], from_left[better] = value[better], best[better]
                options = over[None, :] + self.back
                best = options.argmin(1)
                value = options[np.arange(self.shape[0]), best]
                better = value < dist - 1e-9
                if not better.any():
                    break
                dist[better], from_right[better] = value[better], best[better]
            end = int((over + last).argmin())
            if not np.isfinite(over[end] + last[end]):
                break
            path, r = [], end
            while True:
                le = int(from_left[r])
                path.append((le, r, True))
                if from_right[le] < 0:
                    break
                r = int(from_right[le])
                path.append((le, r, False))
            begin = path[-1][0]
            step = min(amount - sent, supply[begin][0][0], demand[end][0][0])
            for le, r, forward in path:
                i = self.arc[(le, r)][0 if forward else 1]
                step = min(step, (self.room[i] - self.flow[i]) if forward else self.flow[i])
            step = int(step)
            if step < 1:
                break
            for le, r, forward in path:
                self.flow[self.arc[(le, r)][0 if forward else 1]] += step if forward else -step
                self._refresh((le, r))
            for side, node in ((supply, begin), (demand, end)):
                side[node][0][0] -= step
                if side[node][0][0] < 1:
                    side[node].pop(0)
            sent += step
        return sent


def _pieces(floor: np.ndarray, goal: np.ndarray, top: np.ndarray) -> list[list[list[float]]]:
    """Arcs of one side: up to the minimum, up to the goal, and beyond."""
    out = []
    for f, g, a in zip(floor, goal, top):
        f, g = min(f, g), min(g, a)
        parts = [(f, -FLOOR_REWARD), (g - f, -TARGET_REWARD), (a - g, EXCESS_COST)]
        out.append([[int(n), c] for n, c in parts if n > 0])
    return out


def deviation(cells: np.ndarray, quota: np.ndarray, goals: list[np.ndarray]) -> float:
    return float(sum(np.abs(np.bincount(cells[:, d], quota, len(g)) - g).sum() for d, g in enumerate(goals)))


def exchanged(cells: np.ndarray, quota: np.ndarray, available: np.ndarray, goals: list[np.ndarray], size: int, floors: list[np.ndarray] | None = None) -> np.ndarray:
    """Move, add or drop rows between cells while that lowers the summed deviation of all margins.

    A row below the minimum of its category counts FLOOR_REWARD times. Every step lowers the sum, so it ends.
    """
    quota = quota.copy()
    got = [np.bincount(cells[:, d], quota, len(g)).astype(np.int64) for d, g in enumerate(goals)]
    floors = [np.minimum(f, g) for f, g in zip(floors, goals)] if floors else [np.zeros(len(g), np.int64) for g in goals]

    def worth(n: np.ndarray, d: int) -> np.ndarray:
        """What one row more is worth to each category of a dimension."""
        return np.where(n < floors[d], FLOOR_REWARD, np.where(n < goals[d], 1.0, -1.0))

    while True:
        more = [worth(n, d) for d, n in enumerate(got)]
        fewer = [-worth(n - 1, d) for d, n in enumerate(got)]
        gain_in = sum(w[cells[:, d]] for d, w in enumerate(more))
        gain_out = sum(w[cells[:, d]] for d, w in enumerate(fewer))
        gain_in[quota >= available] = -np.inf
        gain_out[quota <= 0] = -np.inf
        total = int(quota.sum())
        best, move = 0.0, None
        i = int(gain_in.argmax())
        if total < size and gain_in[i] > best:
            best, move = gain_in[i], (i, None)
        # the best partners share categories, in which the move changes nothing; the first receivers that gain are enough
        for tried, k in enumerate(np.argsort(-gain_in, kind="stable")):
            if gain_in[k] == -np.inf or (tried >= 40 and move is not None):
                break
            same = cells == cells[k]
            both = gain_in[k] + gain_out - sum(np.where(same[:, d], more[d][cells[k, d]] + fewer[d][cells[k, d]], 0.0) for d in range(cells.shape[1]))
            both[k] = -np.inf
            j = int(both.argmax())
            if both[j] > best:
                best, move = both[j], (int(k), j)
        if move is None:
            return quota
        k, j = move
        changed = [d for d in range(cells.shape[1]) if j is None or cells[k, d] != cells[j, d]]
        step = [available[k] - quota[k], size - total if j is None else quota[j]]
        for d in changed:  # as far as no category passes its minimum or goal
            into, out = cells[k, d], None if j is None else cells[j, d]
            step += [x - got[d][into] for x in (floors[d][into], goals[d][into]) if x > got[d][into]]
            if out is not None:
                step += [got[d][out] - x for x in (floors[d][out], goals[d][out]) if x < got[d][out]]
        step = max(1, int(min(step)))
        quota[k] += step
        if j is not None:
            quota[j] -= step
        for d in changed:
            got[d][cells[k, d]] += step
            if j is not None:
                got[d][cells[j, d]] -= step


def quotas(cells: np.ndarray, available: np.ndarray, shares: list[np.ndarray], floors: list[np.ndarray], size: int, seed: int = 11) -> tuple[np.ndarray, list[np.ndarray]]:
    """Integer quota of each cell, and the row numbers that each dimension was to have."""
    size = int(min(size, available.sum()))
    tops = [np.bincount(cells[:, d], available, len(s)).astype(np.int64) for d, s in enumerate(shares)]
    goals = [margin_goal(t, s, f, size) for t, s, f in zip(tops, shares, floors)]
    if not len(cells) or not size:
        return np.zeros(len(cells), np.int64), goals
    expected = fitted(cells, available, goals)
    base = np.minimum(np.floor(expected + 1e-9), available).astype(np.int64)
    order = sorted(range(len(shares)), key=lambda d: -len(shares[d]))
    left, right, others = order[0], order[1], order[2:]
    rng = np.random.default_rng(seed)
    fraction = np.clip(expected - base, 1e-3, 1.0)
    chance = -np.log(rng.random(len(cells))) / fraction  # the smaller, the sooner a row is added to this cell
    chance = chance / (1 + chance)
    one = np.minimum(available - base, 1)
    rooms = np.concatenate([base, one, available - base - one])
    costs = np.concatenate([np.zeros(len(cells)), 1 + chance, np.full(len(cells), BEYOND)])
    ends = [np.tile(cells[:, d], 3) for d in (left, right)]
    prices = [np.zeros(len(shares[d])) for d in others]
    best = None
    for turn in range(TURNS):
        price = sum(p[cells[:, d]] for p, d in zip(prices, others)) if others else np.zeros(len(cells))
        flow = Transport(*ends, rooms, costs + np.tile(price, 3), len(shares[left]), len(shares[right]))
        flow.run(tuple(_pieces(floors[d], goals[d], tops[d]) for d in (left, right)), size)
        quota = flow.flow.reshape(3, -1).sum(0)
        off = deviation(cells, quota, goals)
        if best is None or off < best[0]:
            best = (off, quota)
        if off == 0:
            break
        for p, d in zip(prices, others):
            gap = np.bincount(cells[:, d], quota, len(p)) - goals[d]
            p += 1.5 / (1 + turn) * gap / np.maximum(1, np.abs(gap).max())
    return exchanged(cells, best[1], available, goals, size, floors), goals


def _targets(rows: list, dimensions: tuple[str, ...]) -> dict[str, dict[str, tuple[float, int]]]:
    out: dict[str, dict[str, tuple[float, int]]] = {d: {} for d in dimensions}
    for r in rows:
        d, c = (r["dimension"] or "").strip().lower(), (r["category"] or "").strip().lower()
        if d in out and c:
            out[d][c] = (max(0.0, r["target_share"] or 0.0), max(0, r["min_rows"] or 0))
    return out


def sample(generations: DataFrame, targets: DataFrame, size: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """The sample (id and canonical categories), and the report on every target category."""
    spark = generations.sparkSession
    wanted = _targets(targets.select("dimension", "category", "target_share", "min_rows").collect(), DIMENSIONS)
    names = {d: [*sorted(wanted[d]), OTHER] for d in DIMENSIONS}
    rows = latest(generations)
    folded = {d: F.when(F.col(d).isin(*wanted[d]), F.col(d)).otherwise(OTHER) if wanted[d] else F.lit(OTHER) for d in DIMENSIONS}
    cell_names = [f"cell_{d}" for d in DIMENSIONS]
    placed = rows.withColumns({f"cell_{d}": c for d, c in folded.items()})
    counted = placed.groupBy(*cell_names).agg(F.count("*").alias("n")).collect()
    counted.sort(key=lambda r: tuple(r[c] for c in cell_names))
    cells = np.array([[names[d].index(r[f"cell_{d}"]) for d in DIMENSIONS] for r in counted], np.int64).reshape(-1, len(DIMENSIONS))
    available = np.array([r["n"] for r in counted], np.int64)
    shares, floors = [], []
    for d in DIMENSIONS:
        s = np.array([wanted[d][c][0] if c in wanted[d] else 0.0 for c in names[d]])
        shares.append(s / s.sum() if s.sum() else np.full(len(s), 1.0 / len(s)))
        floors.append(np.array([wanted[d][c][1] if c in wanted[d] else 0 for c in names[d]], np.int64))
    total = int(available.sum())
    if size is None:
        size = max([int(PART * total), *(int(f.sum()) for f in floors)])
    size = min(size, total)
    quota, goals = quotas(cells, available, shares, floors, size, seed)
    schema = ", ".join(f"{c} string" for c in cell_names) + ", quota bigint"
    quota_rows = spark.createDataFrame([(*[r[c] for c in cell_names], int(q)) for r, q in zip(counted, quota) if q], schema)
    keyed = placed.withColumn("__u", uniform(F.col("id"), seed=seed))
    drawn = take_by_quota(keyed, quota_rows, cell_names, "__u", "id").select("id", *DIMENSIONS)
    report = []
    for d, dimension in enumerate(DIMENSIONS):
        got = np.bincount(cells[:, d], quota, len(names[dimension])).astype(int) if len(cells) else np.zeros(len(names[dimension]), int)
        have = np.bincount(cells[:, d], available, len(names[dimension])).astype(int) if len(cells) else np.zeros(len(names[dimension]), int)
        for i, c in enumerate(names[dimension]):
            if c in wanted[dimension]:
                share, least = wanted[dimension][c]
                actual = got[i] / size if size else 0.0
                report.append((dimension, c, share, least, int(have[i]), int(goals[d][i]), int(got[i]), float(actual), bool(abs(actual - share) <= TOLERANCE and size > 0), bool(got[i] >= least), *[max(0, int(x)) for x in (least - got[i], goals[d][i] - got[i], got[i] - goals[d][i])]))
    columns = "dimension string, category string, target_share double, min_rows int, available bigint, wanted_rows bigint, drawn_rows bigint, actual_share double, target_met boolean, minimum_met boolean, short_of_minimum bigint, short_of_wanted bigint, beyond_wanted bigint"
    return drawn, spark.createDataFrame(report, columns)
