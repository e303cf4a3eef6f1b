"""Problem 3: train, validation and test splits that keep related records together.

Records are tied by the groups that list them; tied sets are the connected
components.  The sets are bundled by identical size and label profile (each
label's share of the set in quarters), a min-cost flow assigns the records of
every label to the splits (quota arcs are free, deviating from a split's share of
a label costs 1, from the split's whole quota 4), the flow is rounded to whole
sets, largest sets first, and the sets of a bundle are dealt by a hash of their
lead.  All bundles of one label would have the same arcs and costs, so they enter
the flow as one node, and its flow is divided among them; a mixed set draws on the
quotas of all of its labels.

Sizes: the driver sees one row per bundle.  Distinct set sizes are at most
sqrt(2 N) for N records and a profile is one of a few dozen, whatever N is.
Bundles with many sets are ranked in hashed parts whose first ranks are running
sums, so no rank runs over a bundle whole and no row per part reaches the driver.

Defined results: null and blank ids tie nothing; a member that is no case ties
like any other but gets no split; repeated members and rows change nothing;
cases without ties are sets of one; a null case_id is left out; proportions are
normalised, null or negative ones count as 0; with no targets the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainloom.operators.components import connected_components
from chainloom.sources.checkpoints import stored

#: Sets of one bundle that are ranked together.
PART = 50_000
#: Stands between the labels of a profile.
UNIT = "\x1f"


def tie_edges(groups: DataFrame) -> DataFrame:
    """(src, dst): each row's first node with its others.  Nodes are cases and the
    two kinds of group ids; the prefix keeps the kinds apart."""

    def node(prefix: str, column: str):
        value = F.col(column)
        return F.when(F.trim(F.regexp_replace(value, r"\s+", " ")) != "", F.concat(F.lit(prefix), value))

    members = F.transform(
        F.filter(F.coalesce("member_record_ids", F.array().cast("array<string>")), lambda m: m.isNotNull() & (F.trim(m) != "")),
        lambda m: F.concat(F.lit("c:"), m),
    )
    nodes = F.concat(F.array_compact(F.array(node("g:", "group_id"), node("t:", "template_id"))), members)
    listed = groups.select(nodes.alias("nodes")).where("size(nodes) > 0")
    return listed.select(F.get("nodes", F.lit(0)).alias("src"), F.explode("nodes").alias("dst")).distinct()


def tied_sets(cases: DataFrame, groups: DataFrame) -> DataFrame:
    """Output (case_id, lead_case_id, set_size) for every case."""
    tied = (
        connected_components(tie_edges(groups))
        .where("node like 'c:%'")
        .select(F.expr("substring(node, 3)").alias("case_id"), "component")
    )
    known = cases.where("case_id is not null").select("case_id").distinct()
    placed = known.join(tied, "case_id", "left").withColumn("component", F.coalesce("component", F.concat(F.lit("c:"), "case_id")))
    leads = placed.groupBy("component").agg(F.min("case_id").alias("lead_case_id"), F.count("*").alias("set_size"))
    return placed.join(leads, "component").select("case_id", "lead_case_id", "set_size")


def tied_pairs(cases: DataFrame, groups: DataFrame) -> DataFrame:
    """Output (lead_case_id, case_id): every case of a tied set but its smallest."""
    return tied_sets(cases, groups).where("case_id <> lead_case_id").select("lead_case_id", "case_id")


class MinCostFlow:
    """Successive shortest paths (Bellman-Ford with a queue) on a small network."""

    def __init__(self) -> None:
        self.arcs: list[list] = []  # to, capacity, cost
        self.out: dict[object, list[int]] = {}

    def arc(self, a, b, capacity: int, cost: int) -> int:
        self.out.setdefault(a, []).append(len(self.arcs))
        self.arcs.append([b, capacity, cost])
        self.out.setdefault(b, []).append(len(self.arcs))
        self.arcs.append([a, 0, -cost])
        return len(self.arcs) - 2

    def run(self, source, sink) -> None:
        while True:
            distance, via, queue, queued = {source: 0}, {}, [source], {source}
            for node in queue:
                queued.discard(node)
                for k in self.out[node]:
                    to, capacity, cost = self.arcs[k]
                    if capacity and distance[node] + cost < distance.get(to, 1 << 60):
                        distance[to], via[to] = distance[node] + cost, k
                        if to not in queued:
                            queue.append(to)
                            queued.add(to)
            if sink not in distance:
                return
            path, node = [], sink
            while node != source:
                path.append(via[node])
                node = self.arcs[via[node] ^ 1][0]
            amount = min(self.arcs[k][1] for k in path)
            for k in path:
                self.arcs[k][1] -= amount
                self.arcs[k ^ 1][1] += amount


def _shares(total: int, proportions: dict[str, float]) -> dict[str, int]:
    """Whole numbers that add up to ``total`` (largest remainders)."""
    exact = {s: total * p for s, p in proportions.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: total - sum(out.values())]:
        out[s] += 1
    return out


def label_quotas(supply: dict[str, int], proportions: dict[str, float]) -> dict[tuple[str, str], int]:
    """Records of each label for each split, by min-cost flow.

    All sets of one label have the same arcs and costs, so their arcs are merged
    before the flow is solved and it is divided among the bundles afterwards.
    """
    total = sum(supply.values())
    whole, net, used = _shares(total, proportions), MinCostFlow(), {}
    for label, n in sorted(supply.items()):
        net.arc("source", ("label", label), n, 0)
        for split, share in _shares(n, proportions).items():
            used[label, split] = [
                net.arc(("label", label), ("split", split), share, 0),
                net.arc(("label", label), ("split", split), n, 1),
            ]
    for split, n in whole.items():
        net.arc(("split", split), "sink", n, 0)
        net.arc(("split", split), "sink", total, 4)
    net.run("source", "sink")
    return {key: sum(net.arcs[k ^ 1][1] for k in arcs) for key, arcs in used.items()}


def profile_shares(profile: str, label: str) -> dict[str, float]:
    """Share of each label in a set of that profile ("label=quarters", unit separated)."""
    parts = [p.rsplit("=", 1) for p in profile.split(UNIT) if "=" in p]
    weights = {name: int(quarters) for name, quarters in parts if int(quarters)}
    return {name: w / sum(weights.values()) for name, w in weights.items()} or {label: 1.0}


def round_bundles(bundles: list[tuple], quotas: dict[tuple[str, str], int], proportions: dict[str, float]) -> list[tuple]:
    """bundles: (size, label, profile, part, count); gives (size, label,
    profile, part, split, first rank, last rank) in whole sets.

    Largest sets first: each bundle takes its part of its labels' flow, rounded
    down, and what is left goes, set by set, where most records are missing.
    """
    splits = sorted(proportions)
    missing: dict[tuple[str, str], float] = dict(quotas)
    open_split: dict[str, float] = {s: sum(n for (_, t), n in quotas.items() if t == s) for s in splits}
    left: dict[str, float] = {}
    for size, label, profile, _, count in bundles:
        for name, share in profile_shares(profile, label).items():
            left[name] = left.get(name, 0) + share * size * count
    out = []
    for size, label, profile, part, count in sorted(bundles, key=lambda b: (-b[0], b[1], b[2], b[3])):
        shares = profile_shares(profile, label)
        # the part of each label's open flow that falls to these sets, by their shares
        given = {s: int(count * sum(share * max(0, missing.get((name, s), 0)) / max(1, left[name]) for name, share in shares.items()) + 1e-9) for s in splits}
        while sum(given.values()) > count:
            given[max(given, key=lambda s: (given[s], s))] -= 1

        def take(split: str, sets: int) -> None:
            open_split[split] -= size * sets
            for name, share in shares.items():
                missing[name, split] = missing.get((name, split), 0) - share * size * sets

        for s in splits:
            take(s, given[s])
        for _ in range(count - sum(given.values())):
            # where most of the quota is missing, in records; ties to the largest share
            gain = lambda s: min(open_split[s], size) + sum(min(missing.get((name, s), 0), share * size) for name, share in shares.items())
            s = max(splits, key=lambda s: (gain(s), open_split[s], proportions[s], s))
            given[s] += 1
            take(s, 1)
        for name, share in shares.items():
            left[name] -= share * size * count
        rank = 1
        for s in splits:
            if given[s]:
                out.append((size, label, profile, part, s, rank, rank + given[s] - 1))
                rank += given[s]
    return out


def assign_splits(cases: DataFrame, groups: DataFrame, targets: DataFrame, label: str = "difficulty") -> DataFrame:
    """Output (case_id, lead_case_id, split): the split given to every case."""
    spark = cases.sparkSession
    wanted = {r["split"]: max(0.0, r["proportion"] or 0.0) for r in targets.where("split is not null").groupBy("split").agg(F.max("proportion").alias("proportion")).collect()}
    whole = sum(wanted.values())
    empty = spark.createDataFrame([], "case_id string, lead_case_id string, split string")
    if not whole:
        return empty
    proportions = {s: p / whole for s, p in wanted.items()}
    sets = stored(tied_sets(cases, groups))
    labels = cases.where("case_id is not null").groupBy("case_id").agg(F.lower(F.trim(F.coalesce(F.min(label), F.lit("")))).alias("label"))
    counted = sets.join(labels, "case_id").groupBy("lead_case_id", "set_size", "label").agg(F.count("*").alias("n"))
    # Profile: each label's share of the set in quarters; the label with most records leads it.
    share = F.round(4 * F.col("n") / F.col("set_size")).cast("int")
    profiles = counted.groupBy("lead_case_id", F.col("set_size").alias("size")).agg(
        F.max(F.struct("n", "label"))["label"].alias("label"),
        F.concat_ws(UNIT, F.array_sort(F.collect_list(F.concat_ws("=", "label", share)))).alias("profile"),
    )
    hashed = profiles.withColumn("deal", F.xxhash64("lead_case_id"))
    bundle = ["size", "label", "profile"]
    sized = hashed.groupBy(*bundle).agg(F.ceil(F.count("*") / F.lit(PART)).alias("parts"))
    parted = stored(hashed.join(sized, bundle).withColumn("part", F.pmod(F.hash("lead_case_id"), F.col("parts"))).drop("parts"))
    counted = stored(parted.groupBy(*bundle, "part").count())
    bundles = [(size, name, profile, 0, count) for size, name, profile, count in counted.groupBy(*bundle).agg(F.sum("count")).collect()]
    if not bundles:
        return empty
    supply = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ranges = [(size, name, profile, split, first, last) for size, name, profile, _, split, first, last in round_bundles(bundles, label_quotas(supply, proportions), proportions)]
    table = spark.createDataFrame(ranges, "size bigint, label string, profile string, split string, first bigint, last bigint")
    before = Window.partitionBy(*bundle).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(*bundle, "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy(*bundle, "part").orderBy("deal", "lead_case_id")
    ranked = parted.withColumn("rank", F.row_number().over(order)).join(offsets, [*bundle, "part"]).withColumn("rank", F.col("rank") + F.col("offset"))
    dealt = ranked.join(table, bundle).where("rank between first and last").select("lead_case_id", "split")
    return sets.join(dealt, "lead_case_id").select("case_id", "lead_case_id", "split")
