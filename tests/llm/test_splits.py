import random

from chainloom.llm import splits
from chainloom.llm.splits import UNIT, MinCostFlow, assign_splits, label_quotas, profile_shares, round_bundles, tied_pairs

CASES = "case_id string, difficulty string, split string"
GROUPS = "group_id string, template_id string, member_record_ids array<string>"
TARGETS = "split string, proportion double"


def brute(cases, groups):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (g, t, members) in enumerate(groups):
        nodes = [("r", i)] + [("g", g)] * bool(g and g.strip()) + [("t", t)] * bool(t and t.strip()) + [("c", m) for m in members or [] if m and m.strip()]
        for n in nodes:
            parent[find(n)] = find(nodes[0])
    sets = {}
    for c in cases:
        sets.setdefault(find(("c", c)), []).append(c)
    return {(min(s), c) for s in sets.values() for c in s if c != min(s)}


def test_ties_against_union_find(spark):
    rng = random.Random(3)
    cases = [f"k{i:03}" for i in range(150)]
    groups = [
        (rng.choice([None, "", " ", f"g{rng.randrange(60)}"]), rng.choice([None, " ", f"t{rng.randrange(30)}"]), rng.choice([None, [], [rng.choice(cases + ["gone1", "gone2", " ", None]) for _ in range(3)]]))
        for _ in range(70)
    ]
    got = tied_pairs(spark.createDataFrame([(c, "easy", "x") for c in cases], CASES), spark.createDataFrame(groups + groups[:5], GROUPS))
    assert {tuple(r) for r in got.collect()} == brute(cases, groups)


def test_empty_tables(spark):
    cases, groups, targets = (spark.createDataFrame([], s) for s in (CASES, GROUPS, TARGETS))
    assert tied_pairs(cases, groups).count() == 0
    assert assign_splits(cases, groups, targets).count() == 0
    some = spark.createDataFrame([("train", 1.0)], TARGETS)
    assert assign_splits(cases, groups, some).count() == 0


def test_flow_meets_quotas():
    quotas = label_quotas({"a": 70, "b": 30}, {"train": 0.8, "test": 0.2})
    assert sum(n for (l, s), n in quotas.items() if s == "train") == 80
    assert sum(n for (l, s), n in quotas.items() if l == "b") == 30
    net = MinCostFlow()
    cheap, dear = net.arc("s", "t", 2, 1), net.arc("s", "t", 5, 3)
    net.arc("x", "s", 4, 0)
    net.run("x", "t")
    assert net.arcs[cheap ^ 1][1] == 2 and net.arcs[dear ^ 1][1] == 2


def test_rounding_deals_every_set_once():
    bundles = [(7, "a", "a=4", 0, 3), (1, "a", "a=4", 0, 50), (2, "b", "b=4", 0, 11)]
    proportions = {"train": 0.8, "test": 0.2}
    ranges = round_bundles(bundles, label_quotas({"a": 71, "b": 22}, proportions), proportions)
    for size, label, profile, part, count in bundles:
        dealt = sorted((first, last) for s, l, p, q, _, first, last in ranges if (s, l, p, q) == (size, label, profile, part))
        assert dealt[0][0] == 1 and dealt[-1][1] == count
        assert all(b[0] == a[1] + 1 for a, b in zip(dealt, dealt[1:]))


def test_mixed_sets_draw_on_all_of_their_labels():
    proportions = {"train": 0.75, "test": 0.25}
    mixed = "a=2" + UNIT + "b=2"
    assert profile_shares(mixed, "a") == {"a": 0.5, "b": 0.5} and profile_shares("x=y=4", "x=y") == {"x=y": 1.0} and profile_shares("", "z") == {"z": 1.0}
    bundles = [(4, "a", mixed, 0, 40), (1, "b", "b=4", 0, 80)]
    ranges = round_bundles(bundles, label_quotas({"a": 80, "b": 160}, proportions), proportions)
    sets = {}
    for size, _, profile, _, split, first, last in ranges:
        sets[profile, split] = last - first + 1
    assert sets[mixed, "train"] == 30 and sets["b=4", "train"] == 60


def test_ranks_run_over_hashed_parts(spark, monkeypatch):
    monkeypatch.setattr(splits, "PART", 30)
    cases = [(f"k{i:04}", "easy", "x") for i in range(1000)]
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], TARGETS)
    out = assign_splits(spark.createDataFrame(cases, CASES), spark.createDataFrame([], GROUPS), targets).collect()
    assert sorted(r["case_id"] for r in out) == [c for c, *_ in cases]
    assert sorted(sum(r["split"] == s for r in out) for s in ("train", "validation", "test")) == [100, 100, 800]


def test_tied_cases_share_a_split_in_proportion(spark):
    cases = [(f"k{i:04}", random.Random(i).choice(["easy", "hard", None]), "x") for i in range(1000)]
    groups = [(f"g{i}", None, [f"k{i * 5 + j:04}" for j in range(5)]) for i in range(100)]
    targets = spark.createDataFrame([("train", 8.0), ("test", 2.0), ("none", None)], TARGETS)
    out = assign_splits(spark.createDataFrame(cases, CASES), spark.createDataFrame(groups, GROUPS), targets).collect()
    assert len(out) == 1000
    by_lead = {}
    for r in out:
        by_lead.setdefault(r["lead_case_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in by_lead.values())
    assert abs(sum(r["split"] == "train" for r in out) - 800) <= 5
