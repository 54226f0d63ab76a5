"""Mixing sources to target weights (problem 7).

Sources overlap: a text may stand in several of them. Texts are aggregated by membership pattern (the set of their sources) to token
counts. A min-cost flow routes each pattern's tokens to the sources' quotas; using a text again costs more each time (convex costs),
so texts are repeated only where a source can't be filled otherwise, and never beyond its max_repeats. The flow then becomes
documents: a pattern's texts lie on a circle in seeded order, each as long as its tokens; a source's flow is an arc that may go round
several times, and a document is used as often as the arc passes its start. Positions are prefix sums by hash bucket, of which there are
as many as the texts need, so no task holds a whole pattern. The driver sees one row a pattern that occurs: at most 2 to the power of
the number of targets, and no more than there are texts under several sources and targets.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millweir.session import materialize

#: Texts of a bucket, of which one task orders those of a pattern; arcs that may be broadcast.
BUCKET_TEXTS, MOST_BROADCAST = 20_000, 100_000


class Flow:
    """Min-cost flow with integer capacities, by successive shortest paths; for graphs of a few thousand edges."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: dict[int, list[int]] = defaultdict(list)
        self.names: dict[object, int] = {}

    def node(self, name: object) -> int:
        return self.names.setdefault(name, len(self.names))

    def edge(self, a: object, b: object, room: int, cost: int) -> int:
        for start, end, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[self.node(start)].append(len(self.to))
            self.to.append(self.node(end))
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: object, sink: object) -> None:
        s, t = self.node(source), self.node(sink)
        while True:
            best, via, queue = {s: 0}, {}, [s]
            while queue:
                u = queue.pop(0)
                for e in self.out[u]:
                    v = self.to[e]
                    if self.room[e] > 0 and best[u] + self.cost[e] < best.get(v, 1 << 60):
                        best[v], via[v] = best[u] + self.cost[e], (u, e)
                        if v not in queue:
                            queue.append(v)
            if t not in best:
                return
            path, v = [], t
            while v != s:
                u, e = via[v]
                path.append(e)
                v = u
            amount = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= amount
                self.room[e ^ 1] += amount


def route(sizes: dict[tuple[str, ...], int], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each pattern gives to each source. sizes: tokens of a pattern; quotas: tokens that a source shall have."""
    flow, arcs = Flow(), {}
    for pattern, size in sorted(sizes.items()):
        for use in range(max((repeats[s] for s in pattern), default=0)):
            flow.edge("in", pattern, size, use * use)
        for s in pattern:
            arcs[pattern, s] = flow.edge(pattern, s, size * repeats[s], 0)
    for s, quota in sorted(quotas.items()):
        flow.edge(s, "out", quota, 0)
    flow.node("in"), flow.node("out")
    flow.run("in", "out")
    return {k: flow.room[e ^ 1] for k, e in arcs.items() if flow.room[e ^ 1] > 0}


def largest_total(sizes: dict[tuple[str, ...], int], shares: dict[str, float], repeats: dict[str, int]) -> int:
    """The largest total at which every source that has texts still gets its share; 0 if no such source has a share."""
    present = {s for pattern in sizes for s in pattern if shares.get(s, 0) > 0 and repeats[s] > 0}
    low, high = 0, int(sum(size * max(repeats[s] for s in pattern) for pattern, size in sizes.items()) / max(sum(shares[s] for s in present), 1e-9)) if present else 0
    while low < high:
        middle = (low + high + 1) // 2
        quotas = {s: round(shares[s] * middle) for s in present}
        got = sum(route(sizes, quotas | {s: 0 for s in shares if s not in present}, repeats).values())
        low, high = (middle, high) if got >= sum(quotas.values()) else (low, middle - 1)
    return low


def mix(sized: DataFrame, row_id: str, source: str, targets: DataFrame, total_tokens: int | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(selection, report). selection: (row_id, source, n_tokens, uses); report: a row for each target.

    sized: (row_id, source, sign, n_tokens), a row a document, where equal texts have the same sign (tokens.sizes). targets: (source,
    target_share, max_repeats). total_tokens: the size of the mix, by default the largest at which every source that has texts gets its
    share. Equal texts are one document, which has the least id in each of its sources. Null, empty and tokenless texts, null sources and
    sources without a target take no part. A target without texts is reported with what it lacks.
    """
    wanted = {r[0]: (float(r[1] or 0), max(0, int(r[2] or 0))) for r in targets.select("source", "target_share", "max_repeats").collect() if r[0] is not None}
    rows = sized.select(F.col(row_id).alias("id"), F.col(source).alias("src"), "sign", "n_tokens").where(F.col("sign").isNotNull() & (F.col("n_tokens") > 0) & F.col("src").isin(list(wanted)))
    by_text = rows.groupBy("sign", "src").agg(F.min("id").alias("id"), F.max("n_tokens").alias("n_tokens"))
    texts = by_text.groupBy("sign").agg(F.max("n_tokens").cast("long").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("src", "id"))).alias("members"))
    texts = materialize(texts.select("sign", "n_tokens", "members", F.col("members.src").alias("pattern")), "texts")
    buckets = max(16, texts.count() // BUCKET_TEXTS)
    texts = texts.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "sign"), F.lit(buckets)).cast("int"))
    sums = texts.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("size"))
    sizes = {tuple(r.pattern): int(r.n) for r in sums.groupBy("pattern").agg(F.sum("size").alias("n")).collect()}
    total = largest_total(sizes, {s: share for s, (share, _) in wanted.items()}, {s: r for s, (_, r) in wanted.items()}) if total_tokens is None else total_tokens
    quotas = {s: round(share * total) for s, (share, _) in wanted.items()}
    flows = route(sizes, quotas, {s: r for s, (_, r) in wanted.items()})
    spark = sized.sparkSession
    arcs, at = [], defaultdict(int)
    for (pattern, s), amount in sorted(flows.items()):
        arcs.append((list(pattern), s, at[pattern], at[pattern] + amount, sizes[pattern]))
        at[pattern] += amount
    arc_rows = spark.createDataFrame(arcs, "pattern array<string>, src string, arc_from long, arc_to long, size long")
    before = sums.select("pattern", "bucket", (F.sum("size").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("size")).alias("offset"))
    inner = F.sum("n_tokens").over(Window.partitionBy("pattern", "bucket").orderBy("sign")) - F.col("n_tokens")
    placed = texts.withColumn("inner", inner).join(before, ["pattern", "bucket"]).select("pattern", "members", "n_tokens", (F.col("offset") + F.col("inner")).alias("start"))
    # the points start, start + size, start + 2 size ... that lie in [arc_from, arc_to)
    passed = F.floor((F.col("arc_to") - F.col("start") + F.col("size") - 1) / F.col("size")) - F.floor((F.col("arc_from") - F.col("start") + F.col("size") - 1) / F.col("size"))
    used = placed.join(F.broadcast(arc_rows) if len(arcs) <= MOST_BROADCAST else arc_rows, "pattern").withColumn("uses", passed.cast("int")).where("uses > 0")
    chosen = F.filter("members", lambda m: m.getField("src") == F.col("src")).getItem(0).getField("id")
    selection = used.select(chosen.alias(row_id), F.col("src").alias("source"), F.col("n_tokens"), "uses")
    got = selection.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum(F.col("n_tokens") * F.col("uses")).alias("actual_tokens"), F.max("uses").alias("most_uses"))
    plan = spark.createDataFrame([(s, share, r, quotas[s]) for s, (share, r) in sorted(wanted.items())], "source string, target_share double, max_repeats int, target_tokens long")
    report = plan.join(got, "source", "left").na.fill(0, ["n_documents", "actual_tokens", "most_uses"])
    whole = report.agg(F.sum("actual_tokens").alias("all_tokens"))
    report = report.crossJoin(F.broadcast(whole)).select(  # one row
        "source", "target_share", "max_repeats", "target_tokens", "n_documents", "actual_tokens", "most_uses",
        F.coalesce(F.try_divide(F.col("actual_tokens").cast("double"), "all_tokens"), F.lit(0.0)).alias("actual_share"),
        F.greatest(F.lit(0).cast("long"), F.col("target_tokens") - F.col("actual_tokens")).alias("missing_tokens"),
        (F.col("actual_tokens") < F.col("target_tokens") * 0.99).alias("missed"),
    )
    return selection, report
