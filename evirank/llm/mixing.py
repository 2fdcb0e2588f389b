"""Mixing sources to target weights: min-cost flow over membership patterns, then seeded selection inside each pattern."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evirank.llm.common import WORD, checkpointed, tag

#: No document is taken more often than this, and no source is asked for more than this times its size.
MOST_COPIES = 3
#: Cost of a token of the first, second, third copy (convex, so copies spread before they pile up).
COPY_COSTS = (0, 1, 3)
#: Rows are ordered by a seeded md5, whose first hex digits cut a pattern into 4,096 even ranges: a running sum runs inside one
#: range, the ranges' totals in one small window per pattern.
RANGE_DIGITS = 3
#: Distinct membership patterns the driver solves for (a pattern is a set of sources, not a document).
MOST_PATTERNS = 100_000
#: The selection goes on past rows that don't fit so often, unless a pattern's gap is within this share of its tokens before.
PASSES = 8
CLOSE = 0.001
SEED = 7


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], most: float = MOST_COPIES) -> dict[str | None, float]:
    """Shares of the total by weight; a source stops at `most` times its size and its excess goes to the others by weight."""
    left, open_ = float(sum(sizes.values())), set(sizes)
    out: dict[str | None, float] = {}
    while open_:
        weight = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / weight if weight else 0.0 for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def min_cost_flow(patterns: dict[tuple, int], quotas: dict, costs: tuple = COPY_COSTS) -> dict[tuple, float]:
    """Tokens each pattern gives at least cost while the quotas are met as far as the patterns can meet them.

    Arcs: start -> pattern once per copy (capacity: its tokens, cost: that copy's), pattern -> each of its sources, source -> end (its
    quota). Successive shortest paths with potentials; each path fills an arc, so there are about as many paths as arcs."""
    nodes = {"s": 0, "t": 1}
    for p in patterns:
        nodes["p", p] = len(nodes)
    for q in quotas:
        nodes["q", q] = len(nodes)
    graph: list[list[int]] = [[] for _ in nodes]
    head, room, cost = [], [], []

    def arc(u: int, v: int, capacity: float, price: float) -> int:
        for a, b, c, w in ((u, v, capacity, price), (v, u, 0.0, -price)):
            graph[a].append(len(head))
            head.append(b)
            room.append(c)
            cost.append(w)
        return len(head) - 2

    copies = {p: [arc(0, nodes["p", p], float(n), c) for c in costs] for p, n in patterns.items()}
    for p in patterns:
        for q in p:
            if q in quotas:
                arc(nodes["p", p], nodes["q", q], float("inf"), 0.0)
    for q, n in quotas.items():
        arc(nodes["q", q], 1, float(n), 0.0)
    tiny = 1e-9 * max([1.0, *map(float, quotas.values())])
    potential = [0.0] * len(nodes)
    while True:
        far, via, queue = [float("inf")] * len(nodes), [-1] * len(nodes), [(0.0, 0)]
        far[0] = 0.0
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u] + 1e-12:
                continue
            for e in graph[u]:
                step = d + cost[e] + potential[u] - potential[head[e]]
                if room[e] > tiny and step < far[head[e]] - 1e-12:
                    far[head[e]], via[head[e]] = step, e
                    heapq.heappush(queue, (step, head[e]))
        if via[1] < 0:
            return {p: sum(room[e ^ 1] for e in arcs) for p, arcs in copies.items()}
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, far)]
        push, v = float("inf"), 1
        while v:
            push, v = min(push, room[via[v]]), head[via[v] ^ 1]
        v = 1
        while v:
            room[via[v]] -= push
            room[via[v] ^ 1] += push
            v = head[via[v] ^ 1]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def mix(rows: DataFrame, weights: dict | None = None, cycle: tuple = (1, 2, 3), seed: int = SEED) -> DataFrame:
    """rows(id, members array<string>, size bigint) -> the same rows with copies (0 .. MOST_COPIES).

    `members` lists the sources a row belongs to; null stands for the source of rows without one. Weights by source, or `cycle` over
    the sources in code-point order, null last. The driver holds one number per pattern and source only. A pattern's flow is
    dealt in whole copies to all its rows first; the remainder goes to rows in the order of a seeded hash of the id, past rows that
    no longer fit, so reruns and any partitioning agree. Rows of size 0 get no copy; rows with equal ids are ordered by
    size, and equal rows are interchangeable. Returns (rows with _copies, targets table).
    """
    rows = rows.withColumn("members", F.array_sort(F.array_distinct("members")))
    totals = checkpointed(rows.groupBy("members").agg(F.sum("size").alias("size")))
    count = totals.count()
    if count > MOST_PATTERNS:
        raise ValueError(f"{count} membership patterns; at most {MOST_PATTERNS} are solved on the driver")
    patterns = {tuple(r["members"]): int(r["size"] or 0) for r in totals.collect()}
    sizes: dict = {}
    for members, size in patterns.items():
        for m in members:
            sizes[m] = sizes.get(m, 0) + size
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weights = weights or {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    total = sum(patterns.values())
    quota = targets_of(sizes, weights, total)
    flows = min_cost_flow(patterns, quota)
    spark = rows.sparkSession
    plan = {p: _shared_out(flows[p], n) for p, n in patterns.items()}
    wanted = spark.createDataFrame([(s, sizes[s], quota[s]) for s in order], "source string, source_size bigint, target double")
    return _select(rows, plan, flows, seed), wanted


def _shared_out(flow: float, size: int) -> tuple[int, float]:
    """Whole copies for all rows of a pattern and the tokens beyond them; a flow within a millionth of a whole counts as whole."""
    base = int((flow + 1e-6) // size) if size else 0
    return base, max(0.0, round(flow - base * size, 6))


def targets_of(sizes: dict, weights: dict, total: float) -> dict:
    """targets() scaled to a total that counts a row of several sources once."""
    listed = sum(sizes.values())
    if listed == total:
        return targets(sizes, weights)
    scaled = targets({s: n * total / listed if listed else 0 for s, n in sizes.items()}, weights, MOST_COPIES * (listed / total if total else 1))
    return scaled


def _select(rows: DataFrame, plan: dict[tuple, tuple[int, float]], flows: dict[tuple, float], seed: int) -> DataFrame:
    """Base copies for all rows; one more in the order of a seeded hash for each row that fits what is still missing; then one copy
    of the row whose size comes nearest to the gap left, if that brings the pattern nearer and the row is below MOST_COPIES.

    A pass takes rows up to the first that no longer fits; the next goes on behind that row with the smaller gap, among rows within
    it. Rows passed over were larger than a gap that only shrinks, so this is the first-fit scan of the whole order. A pattern is done
    when its gap is within CLOSE of its tokens, or nothing fits, or after PASSES. The driver keeps the ends of the passes, not rows."""
    key, range_, place = f"h_{tag()}", f"range_{tag()}", f"place_{tag()}"
    hashed = rows.withColumn(key, F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string")))).withColumn(range_, F.substring(key, 1, RANGE_DIGITS))
    within = Window.partitionBy("members", range_).orderBy(key, "id", "size")
    ranked = checkpointed(hashed.withColumn(place, F.row_number().over(within)).drop(key))
    spark = rows.sparkSession
    state = {m: ("", 0, rest) for m, (_, rest) in plan.items()}  # where the next pass starts, and the gap
    steps: dict[tuple, list] = {m: [] for m in plan}
    at = F.struct(F.col(range_).alias("r"), F.col(place).alias("p"))
    for _ in range(PASSES):
        going = [(list(m), r, p, gap) for m, (r, p, gap) in state.items() if r is not None and gap >= 1 and gap > CLOSE * flows[m]]
        if not going:
            break
        open_ = _with_plan(ranked, spark.createDataFrame(going, "_m array<string>, _r string, _p int, _gap double")).where(
            (F.col("size") > 0) & (F.col("size") <= F.col("_gap")) & (at > F.struct(F.col("_r").alias("r"), F.col("_p").alias("p"))))
        sums = open_.groupBy("members", range_).agg(F.sum("size").alias("_sum"), F.first("_gap").alias("_gap"))
        upto = F.sum("_sum").over(Window.partitionBy("members").orderBy(range_).rowsBetween(Window.unboundedPreceding, 0))
        sums = checkpointed(sums.withColumn("_upto", upto))  # RANGE_DIGITS bounds the rows of a pattern
        for r in sums.groupBy("members").agg(F.max("_upto").alias("all")).collect():
            m = tuple(r["members"])
            gap = state[m][2]
            if r["all"] <= gap:
                steps[m].append((*state[m][:2], "~", 0, gap))
                state[m] = (None, 0, gap - r["all"])
        ends = sums.where((F.col("_upto") > F.col("_gap")) & (F.col("_upto") - F.col("_sum") <= F.col("_gap"))).select(
            F.col("members").alias("_n"), F.col(range_).alias("_cut"), (F.col("_upto") - F.col("_sum")).alias("_before"))
        cut = open_.join(F.broadcast(ends), (F.col("members") == F.col("_n")) & (F.col(range_) == F.col("_cut")))  # one range per pattern
        run = F.col("_before") + F.sum("size").over(Window.partitionBy("members").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
        fits = F.col("_end") <= F.col("_gap")
        blocked = cut.withColumn("_end", run).groupBy("members", range_).agg(
            F.min(F.when(~fits, F.col(place))).alias("p"), F.coalesce(F.max(F.when(fits, F.col("_end"))), F.first("_before")).alias("taken"))
        for r in blocked.collect():
            m = tuple(r["members"])
            gap = state[m][2]
            steps[m].append((*state[m][:2], r[range_], r["p"], gap))
            state[m] = (r[range_], r["p"], gap - r["taken"])
        for m, r, p, gap in going:
            if state[tuple(m)] == (r, p, gap):  # no row within the gap
                state[tuple(m)] = (None, 0, gap)
    step = "array<struct<lo_r:string,lo_p:int,hi_r:string,hi_p:int,gap:double>>"
    table = spark.createDataFrame([(list(m), plan[m][0], state[m][2], steps[m]) for m in plan], f"_m array<string>, _base int, _left double, _steps {step}")

    def taken(s: Column) -> Column:
        return (F.col("size") > 0) & (F.col("size") <= s["gap"]) & (at > F.struct(s["lo_r"].alias("r"), s["lo_p"].alias("p"))) & (at < F.struct(s["hi_r"].alias("r"), s["hi_p"].alias("p")))

    dealt = _with_plan(ranked, table).withColumn("_more", F.exists("_steps", taken).cast("int"))
    off = F.abs(F.col("size") - F.col("_left"))
    last = dealt.where((F.col("_base") + F.col("_more") < MOST_COPIES) & (F.col("size") > 0) & (off < F.col("_left"))).groupBy(F.col("members").alias("_n")).agg(
        F.min(F.struct(off.alias("d"), "_more", F.col(range_).alias("r"), F.col(place).alias("p"))).alias("_last"))
    # one row per pattern, of which mix() allows MOST_PATTERNS: small enough to broadcast, so a hot source stays where it is
    marked = dealt.join(F.broadcast(last), F.col("members") == F.col("_n"), "left")
    nearest = F.coalesce((F.col("_last.r") == F.col(range_)) & (F.col("_last.p") == F.col(place)), F.lit(False)).cast("int")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("_base") + F.col("_more") + nearest)
    return marked.withColumn("copies", copies.cast("int")).select(*rows.columns, "copies")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows beside the one plan row of their pattern (at most MOST_PATTERNS rows, broadcast)."""
    return rows.join(F.broadcast(plan), F.col("members") == F.col("_m"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, source, ..) -> (doc_id, size, source_size, target, taken), one row per row of docs.

    Each document belongs to its one source, null to a source of its own that comes last. Null and wordless texts have size 0
    and are never taken. An empty table gives no rows; other columns are ignored.
    """
    rows = checkpointed(docs.select(F.col("doc_id").alias("id"), F.array("source").alias("members"), n_words(F.col("text")).alias("size")))
    mixed, wanted = mix(rows)
    sources = wanted.withColumnRenamed("source", "_source")
    return mixed.join(sources, F.col("members")[0].eqNullSafe(F.col("_source"))).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("bigint").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs that the mix takes, with `copies` (1 .. MOST_COPIES); all other columns stay.

    Only ids, a hash of the text, sizes and sources go through the flow and the selection; the texts move once. Rows that repeat
    id and text are one draw with the size of one: each gets the copies of that draw.
    """
    key, id_, source, copies = f"hash_{tag()}", f"id_{tag()}", f"source_{tag()}", "copies"
    docs = docs.drop(copies)
    narrow = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.array("source").alias("members"), n_words(F.col("text")).alias("size"))
    drawn, _ = mix(checkpointed(narrow.dropDuplicates(["id", "hash", "members"])))
    drawn = drawn.where(F.col(copies) > 0).select(F.col("id").alias(id_), F.col("hash").alias(key), F.col("members")[0].alias(source), copies)
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)) & F.col("source").eqNullSafe(F.col(source))
    return docs.join(drawn, same).select(*docs.columns, copies)
