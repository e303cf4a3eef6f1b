"""Problem 7: texts of varying length in containers of fixed capacity.

Best-fit decreasing: items in falling order of size, each into the open bin with
the least remaining capacity that still holds it.  A segment tree over remaining
capacities 0..C answers that in O(log C).

Items are dealt by a hash to groups of about ``group_items`` and
each group is packed in one task, so no task grows with the corpus.  A group
leaves only a few badly filled bins; the items of bins filled less than
``repack_below`` are dealt again to fewer groups and packed once more, so the
unused space does not grow with the number of groups either.

Texts above the capacity become full containers and one remainder; no other text
is split.  Defined results: null and empty texts have 0 tokens and are assigned
like any other item (they take no room); repeated rows of one id are separate
items; an unknown tokenizer or a capacity that is null or below 1 gives no rows; more
than ``MOST_SPECS`` specifications are refused (they go to every executor).
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.bpe import DEFAULT_FOLDER, count_tokens
from chainloom.sources.checkpoints import stored

#: Specifications that may go to every executor; a longer table is an error.
MOST_SPECS = 10_000


class BestFit:
    """Open bins by remaining capacity, with a max-free segment tree of counts."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def _change(self, remaining: int, by: int) -> None:
        node = remaining + self.leaves
        while node:
            self.count[node] += by
            node //= 2

    def _tightest(self, size: int) -> int:
        """Least remaining capacity >= size of an open bin, -1 without one."""
        node = size + self.leaves
        if self.count[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return -1

    def add(self, size: int) -> int:
        """Bin of an item."""
        remaining = self._tightest(size)
        if remaining < 0:
            number, remaining = self.made, self.capacity
            self.made += 1
        else:
            number = self.bins[remaining].pop()
            self._change(remaining, -1)
        self.bins[remaining - size].append(number)
        self._change(remaining - size, 1)
        return number


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each item by best-fit decreasing; ties in the order given."""
    best, out = BestFit(capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = best.add(sizes[i])
    return out


def _pack_groups(items: DataFrame, level: int) -> DataFrame:
    schema = "spec_id bigint, capacity bigint, doc_id bigint, copy bigint, piece bigint, token_start bigint, n_tokens bigint, container_id string, fill bigint"

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_tokens", "doc_id", "piece", "copy"], ascending=[False, True, True, True], kind="stable")
        numbers = pack(group["n_tokens"].tolist(), int(group["capacity"].iloc[0]))
        group["container_id"] = [f"{key[0]}-{level}-{key[1]}-{n}" for n in numbers]
        group["fill"] = group.groupby("container_id")["n_tokens"].transform("sum")
        return group[["spec_id", "capacity", "doc_id", "copy", "piece", "token_start", "n_tokens", "container_id", "fill"]]

    return items.groupBy("spec_id", "bucket").applyInPandas(run, schema)


def _dealt(items: DataFrame, group_items: int) -> DataFrame:
    """Adds ``bucket``: as many evenly hashed groups a spec as its size asks for.
    Copies of one item are numbered and the number is hashed too, so repeated or null
    ids spread as well, and the deal doesn't depend on how the input is laid out."""
    groups = items.groupBy("spec_id").agg(F.ceil(F.count("*") / F.lit(group_items)).cast("bigint").alias("groups"))
    return items.join(F.broadcast(groups), "spec_id").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "n_tokens", "copy"), F.col("groups"))).drop("groups")


def fill_containers(documents: DataFrame, specs: DataFrame, folder: str = DEFAULT_FOLDER, group_items: int = 20_000, repack_below: float = 0.97) -> DataFrame:
    """Input documents (doc_id, text) and specs (spec_id, tokenizer, capacity);
    output (spec_id, container_id, doc_id, piece, token_start, n_tokens): where
    each text, or each piece of an oversized one, went."""
    vocabularies = sorted(n.removesuffix(".tiktoken") for n in os.listdir(folder) if n.endswith(".tiktoken"))
    wanted = (
        specs.where((F.col("capacity") >= 1) & F.col("tokenizer").isin(vocabularies))
        .select(F.col("spec_id").cast("bigint").alias("spec_id"), "tokenizer", F.col("capacity").cast("bigint").alias("capacity"))
        .distinct()
    )
    # No more names than vocabulary files in the folder.
    names = [r["tokenizer"] for r in wanted.select("tokenizer").distinct().collect()]
    if wanted.count() > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} container specifications")
    counted = count_tokens(documents, names, folder).groupBy("tokenizer", "doc_id", "n_tokens").agg(F.count("*").alias("copies"))
    counted = stored(counted.select("tokenizer", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")))
    sized = counted.join(F.broadcast(wanted), "tokenizer").select("spec_id", "capacity", "doc_id", "copy", "n_tokens")
    pieces = sized.withColumn("pieces", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("n_tokens") / F.col("capacity"))))
    cut = pieces.select(
        "spec_id", "capacity", "doc_id", "copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece"), F.col("n_tokens").alias("whole")
    ).select(
        "spec_id", "capacity", "doc_id", "copy", "piece",
        (F.col("piece") * F.col("capacity")).alias("token_start"),
        F.least("capacity", F.col("whole") - F.col("piece") * F.col("capacity")).alias("n_tokens"),
    )
    full = cut.where("n_tokens = capacity").withColumn("container_id", F.concat_ws("-", F.col("spec_id"), F.lit("f"), F.col("doc_id"), F.col("piece"), F.col("n_tokens"), F.col("copy")))
    first = stored(_pack_groups(_dealt(cut.where("n_tokens < capacity"), group_items), 1))
    loose = F.col("fill") < F.col("capacity") * F.lit(repack_below)
    kept = first.where(~loose)
    again = _pack_groups(_dealt(first.where(loose).drop("container_id", "fill"), group_items), 2)
    columns = ["spec_id", "container_id", "doc_id", "piece", "token_start", "n_tokens"]
    return full.select(columns).unionByName(kept.select(columns)).unionByName(again.select(columns))
