import os
import random

import pytest
from pyspark.sql import functions as F

from chainloom.llm.bpe import DEFAULT_FOLDER
from chainloom.llm.packing import fill_containers, pack

DOCS, SPECS = "doc_id bigint, text string", "spec_id bigint, tokenizer string, capacity bigint"


def plain_best_fit(sizes, capacity):
    free, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(f, b) for b, f in enumerate(free) if f >= sizes[i]]
        if fits:
            b = min(fits)[1]
        else:
            b = len(free)
            free.append(capacity)
        free[b] -= sizes[i]
        out[i] = b
    return out, free


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_against_a_plain_search(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 100])
    sizes = [rng.randint(0, capacity) for _ in range(200)]
    got = pack(sizes, capacity)
    want, free = plain_best_fit(sizes, capacity)
    load = {}
    for b, s in zip(got, sizes):
        load[b] = load.get(b, 0) + s
    assert max(load.values()) <= capacity
    assert sorted(load.values()) == sorted(capacity - f for f in free)


@pytest.mark.skipif(not os.path.exists(f"{DEFAULT_FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")
def test_tables(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["token"] * rng.randint(0, 60))) for i in range(300)] + [(300, None), (301, ""), (302, "token " * 500), (5, "again"), (5, "again")]
    specs = [(1, "byte_bpe_50k", 64), (2, "byte_bpe_multi_50k", 128), (3, "no_such", 10), (4, "byte_bpe_50k", 0), (5, None, 5), (6, "byte_bpe_50k", None)]
    out = fill_containers(spark.createDataFrame(docs, DOCS), spark.createDataFrame(specs, SPECS), group_items=80).collect()
    for spec, capacity in ((1, 64), (2, 128)):
        rows = [r for r in out if r["spec_id"] == spec]
        load = {}
        for r in rows:
            load[r["container_id"]] = load.get(r["container_id"], 0) + r["n_tokens"]
        assert max(load.values()) <= capacity
        assert {r["doc_id"] for r in rows} == {d for d, _ in docs}
        assert sum(load.values()) / (capacity * len(load)) > 0.9
        assert [r["piece"] for r in rows if r["doc_id"] < 300 and r["piece"]] == []
        pieces = sorted((r["token_start"], r["n_tokens"]) for r in rows if r["doc_id"] == 302)
        assert all(b[0] == a[0] + a[1] for a, b in zip(pieces, pieces[1:])) and len(pieces) > 1
        assert sum(r["doc_id"] == 5 for r in rows) == 3
    assert {r["spec_id"] for r in out} == {1, 2}
    assert fill_containers(spark.createDataFrame([], DOCS), spark.createDataFrame(specs, SPECS)).count() == 0


@pytest.mark.skipif(not os.path.exists(f"{DEFAULT_FOLDER}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")
def test_containers_do_not_depend_on_the_layout(spark):
    rng = random.Random(4)
    docs = [(rng.choice([None, None, i % 90]), " ".join(["token"] * rng.randint(0, 70))) for i in range(250)] + [(None, "same")] * 60
    specs = spark.createDataFrame([(1, "byte_bpe_50k", 64)], SPECS)
    frame = spark.createDataFrame(docs, DOCS)
    packed = [sorted((tuple(r) for r in fill_containers(f, specs, group_items=60).collect()), key=str) for f in (frame.repartition(7), frame.orderBy(F.desc("doc_id")).coalesce(1))]
    assert packed[0] == packed[1] and len(packed[0]) >= len(docs)
