"""A training mix with target shares per source, by min-cost flow."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.session import checkpointed

#: Ranks of a public byte-level BPE for many languages; a parameter of every function here.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: how that tokenizer cuts text into words.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Slices of a pattern's seeded order, so that no task orders a whole pattern.
SLICES = 4096
#: A targets table is written by hand; more rows than this are an error.
MOST_TARGETS = 1000
#: Patterns of membership that the flow takes; more are an error.
MOST_PATTERNS = 20_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("mix", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, *, text: str = "text", tokenizer: str = TOKENIZER, out: str = "tokens") -> DataFrame:
    """``documents`` with the number of tokens of each text (NULL: 0), in Arrow batches.

    The tokenizer's ranks are read on the driver's machine and handed out by Spark's file server.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    file = os.path.basename(tokenizer)

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(SparkFiles.get(file))
        for s in texts:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    count.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return documents.withColumn(out, F.pandas_udf(count, "long")(text))


class _Network:
    """Min-cost max-flow by shortest augmenting paths; costs are not negative."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = []  # [to, capacity, cost]
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        self.out[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.out[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def run(self, source: int, sink: int) -> int:
        n, total = len(self.out), 0
        potential = [0] * n
        while True:
            far: list[float] = [float("inf")] * n
            via = [-1] * n
            far[source] = 0
            heap: list[tuple[float, int]] = [(0, source)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > far[u]:
                    continue
                for e in self.out[u]:
                    v, cap, cost = self.edges[e]
                    if cap > 0 and (nd := d + cost + potential[u] - potential[v]) < far[v]:
                        far[v], via[v] = nd, e
                        heapq.heappush(heap, (nd, v))
            if far[sink] == float("inf"):
                return total
            for v in range(n):
                if far[v] < float("inf"):
                    potential[v] += int(far[v])
            push, v = None, sink
            while v != source:
                e = via[v]
                push = self.edges[e][1] if push is None else min(push, self.edges[e][1])
                v = self.edges[e ^ 1][0]
            v = sink
            while v != source:
                e = via[v]
                self.edges[e][1] -= push
                self.edges[e ^ 1][1] += push
                v = self.edges[e ^ 1][0]
            total += push


@dataclass(frozen=True)
class MixPlan:
    """What the flow decided: tokens of each pattern that count for each source, in order of sources."""

    total: int
    flows: dict[tuple[str, ...], list[tuple[str, int]]]


def plan_mix(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None) -> MixPlan:
    """Route the tokens of membership patterns to the sources' quotas.

    ``patterns``: tokens of the documents whose texts belong to exactly these sources.
    The k-th appearance of a pattern's documents costs k - 1, so repetition is
    convex and used only where nothing new is left; a document never appears more often than
    the least cap of its sources.  Without ``total`` the mix is as large as it can be
    with every non-empty source at its share; sources without documents leave
    theirs to the others in proportion.
    """
    have = {s for p, n in patterns.items() if n > 0 for s in p}
    shares = {s: t for s, (t, cap) in targets.items() if s in have and t > 0 and cap > 0}
    if not shares:
        return MixPlan(0, {})
    whole = sum(shares.values())
    names, keys = sorted(shares), sorted(p for p, n in patterns.items() if n > 0)
    at_pattern = {p: 2 + i for i, p in enumerate(keys)}
    at_source = {s: 2 + len(keys) + i for i, s in enumerate(names)}

    def solve(size: int):
        net = _Network(2 + len(keys) + len(names))
        quota = {s: int(size * shares[s] / whole) for s in names}
        routes = {}
        for p in keys:
            for k in range(min(targets[s][1] for s in p)):
                net.add(0, at_pattern[p], patterns[p], k)
            for s in p:
                if s in at_source:
                    routes[p, s] = net.add(at_pattern[p], at_source[s], 1 << 60, 0)
        for s in names:
            net.add(at_source[s], 1, quota[s], 0)
        reached = net.run(0, 1)
        return reached, sum(quota.values()), {k: net.edges[e ^ 1][1] for k, e in routes.items()}

    if total is None:
        lo, hi = 0, 1 + sum(n * max(targets[s][1] for s in p) for p, n in patterns.items())
        while hi - lo > 1:
            mid = (lo + hi) // 2
            reached, wanted, _ = solve(mid)
            lo, hi = (mid, hi) if reached == wanted else (lo, mid)
        total = lo
    _, _, flow = solve(total)
    return MixPlan(total, {p: [(s, flow[p, s]) for s in p if flow.get((p, s), 0) > 0] for p in keys})


def _texts(documents: DataFrame, targets: dict[str, tuple[float, int]], key: str, text: str, source: str, tokenizer: str) -> DataFrame:
    """One row per distinct text that a target's source holds: ``h, k (least id), tokens, pattern``."""
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(source).alias("s")).where("k is not null and t is not null and t <> ''").where(F.col("s").isin(list(targets)))
    counted = count_tokens(rows, text="t", tokenizer=tokenizer).select(F.sha2(F.col("t"), 256).alias("h"), "k", "s", "tokens")
    return counted.groupBy("h").agg(F.min("k").alias("k"), F.max("tokens").alias("tokens"), F.array_sort(F.collect_set("s")).alias("pattern")).where("tokens > 0")


def mix_sources(documents: DataFrame, targets: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, seed: int = 17, tokenizer: str = TOKENIZER) -> DataFrame:
    """``key, source, copies INT, tokens BIGINT``: the documents of the mix and what each counts for.

    A text filed several times is one document (its least id) that belongs to
    all its sources.  Token counts are summed by membership pattern; the flow
    (see ``plan_mix``) decides how many tokens of each pattern count for each
    source; the pattern's documents are laid out in a seeded order, repeated as often as
    needed, and this tape is cut at the flows, so a source is off its quota by
    at most one document per cut.  The order's running sums are taken in slices
    of the seeded hash, so a pattern of any size is spread over tasks.
    A text counted for a source shows there with the number of its copies;
    over all sources they never exceed the least ``max_repeat`` of its sources.

    ``targets``: ``source, target_share, max_repeat``; rows with NULLs are left
    out, of a repeated source the greatest share and least cap hold.  Documents
    of other sources, with a NULL source, or without text take no part.
    """
    rows = targets.where("source is not null and target_share is not null and max_repeat is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.min("max_repeat").alias("cap")).limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    wanted = {r["source"]: (float(r["share"]), int(r["cap"])) for r in rows}
    spark = documents.sparkSession
    schema = "k bigint, source string, copies int, tokens bigint"
    if not wanted:
        return spark.createDataFrame([], schema).withColumnRenamed("k", key)
    texts = checkpointed(_texts(documents, wanted, key, text, source, tokenizer))
    sums = texts.groupBy("pattern").agg(F.sum("tokens").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of membership")
    sizes = {tuple(r["pattern"]): int(r["n"]) for r in sums}
    plan = plan_mix(sizes, wanted, total_tokens)
    cuts = []
    for p, flows in plan.flows.items():
        begin = 0
        for s, n in flows:
            cuts.append((list(p), s, begin, begin + n, sizes[p]))
            begin += n
    if not cuts:
        return spark.createDataFrame([], schema).withColumnRenamed("k", key)
    cut = F.broadcast(spark.createDataFrame(cuts, "pattern array<string>, source string, cut_from bigint, cut_to bigint, size bigint"))
    placed = texts.withColumn("u", F.xxhash64("h", F.lit(seed))).withColumn("slice", F.shiftrightunsigned("u", 64 - SLICES.bit_length() + 1))
    slices = placed.groupBy("pattern", "slice").agg(F.sum("tokens").alias("in_slice"))
    before = slices.withColumn("begin", F.sum("in_slice").over(Window.partitionBy("pattern").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select("pattern", "slice", F.coalesce("begin", F.lit(0)).alias("begin"))
    in_slice = Window.partitionBy("pattern", "slice").orderBy("u", "h").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("upto", F.sum("tokens").over(in_slice)).join(before, ["pattern", "slice"]).select("k", "tokens", "pattern", (F.col("begin") + F.col("upto") - F.col("tokens") / 2).alias("middle"))
    # appearance r of a document has its middle at r * size + middle; it counts for the source whose cut holds it
    upto = lambda edge: F.greatest(F.lit(0), F.ceil((F.col(edge) - F.col("middle")) / F.col("size"))).cast("int")
    chosen = laid.join(cut, "pattern").withColumn("copies", upto("cut_to") - upto("cut_from")).where("copies > 0")
    return chosen.select(F.col("k").alias(key), "source", "copies", "tokens")


def mix_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, documents, tokens, actual_share, most_copies`` of a mix, one row per target."""
    got = mix.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("most_copies"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    goal = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    shown = goal.join(got, "source", "left").crossJoin(F.broadcast(whole))
    return shown.select("source", "target_share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.col("whole")), F.lit(0.0)).alias("actual_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
