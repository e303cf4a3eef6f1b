"""Linking words of questions to relations and labelled entities, and retrieval.

Phrases meet their targets by equi-joins on the runs of words that a filter of all
phrases lets pass.
Nearest neighbours take a stated query set against all rows, in blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chainloom.functions.text import addresses_in, fold_accents, words
from chainloom.operators.similar import Characters, similar_pairs
from chainloom.sources.checkpoints import stored

# What each relation of the catalogue is about.
SCHEMA_DOCUMENTS = {
    "transaction_facts": "transaction transactions sent received sender recipient account value wei gas failed successful hash native transfer",
    "block_facts": "block blocks beneficiary miner validator mined height fee gas used",
    "contract_dimension": "contract contracts deployed erc20 erc721 created",
    "token_dimension": "token tokens symbol name decimals",
    "token_transfer_facts": "token transfer transfers volume amount normalised normalized symbol recipient",
    "entity_labels": "label labelled owner category class entity exchange account",
    "labeled_transactions": "transaction payments exchange exchanges treasury lending bridge mev class owner into reached",
    "labeled_token_transfers": "token transfer owner exchange treasury class",
}
# Words that ask for a time, and the terms a question with one also looks for.
TIME_CUES = ("between", "from", "until", "window", "day", "daily", "date", "when", "per", "latest", "recent", "ngày", "khoảng")
TIME_TERMS = ("timestamp", "date", "time", "when")
# Groups of phrases that mean the same, first the one the documents use.
SYNONYMS = (
    ("transaction", "tx", "txn", "payment", "giao dịch"), ("account", "address", "wallet", "tài khoản", "địa chỉ"), ("sender", "payer", "sent by", "người gửi"),
    ("recipient", "receiver", "received by", "người nhận"), ("beneficiary", "validator", "miner", "người thụ hưởng"), ("token", "coin", "erc20"),
    ("volume", "amount", "khối lượng"), ("failed", "unsuccessful", "thất bại"), ("block", "khối"), ("exchange", "trading venue", "sàn giao dịch"),
    ("treasury", "ngân quỹ"), ("owner", "entity", "chủ sở hữu"),
)
#: Weights of the lexical score's parts, and of the lexical and the semantic score.
BASE, EXPANDED, PHRASE = 0.6, 0.3, 0.1
LEXICAL, SEMANTIC = 0.5, 0.5
#: Where the checksum of a whole phrase starts, to differ from that of a prefix.
_WHOLE = 0x5BD1E995


def question_tokens(text: Column) -> Column:
    """Distinct words of letters and digits of any script, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != ""))


def with_synonyms(questions: DataFrame) -> DataFrame:
    """Input with ``question``; appends ``tokens`` (with the time terms where a time
    is asked for), ``expanded`` (and all words of the synonym groups a phrase of
    which occurs) and ``matched`` (those phrases, as word arrays)."""
    words_ = F.filter(F.split(F.lower("question"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    read = questions.where("question is not null").withColumn("line", F.concat(F.lit(" "), F.array_join(words_, " "), F.lit(" "))).withColumn("own", question_tokens(F.col("question")))
    cues = F.array(*map(F.lit, TIME_CUES))
    terms = F.array(*map(F.lit, TIME_TERMS))
    read = read.withColumn("tokens", F.when(F.arrays_overlap("own", cues), F.array_union("own", terms)).otherwise(F.col("own"))).where("size(own) > 0")
    hit = lambda phrase: F.col("line").contains(f" {phrase} ")
    groups, phrases = [], []
    for group in SYNONYMS:
        any_hit = F.lit(False)
        for phrase in group:
            any_hit |= hit(phrase)
            phrases.append(F.when(hit(phrase), F.array(*map(F.lit, phrase.split()))))
        groups.append(F.when(any_hit, F.array(*[F.lit(w) for w in dict.fromkeys(" ".join(group).split())])).otherwise(F.array().cast("array<string>")))
    return read.withColumn("expanded", F.array_union("tokens", F.flatten(F.array(*groups)))).withColumn("matched", F.array_compact(F.array(*phrases))).drop("line", "own")


def lexical_scores(questions: DataFrame) -> DataFrame:
    """Input (key, question); output (key, question, scores): for every relation
    ``min(1, 0.6 |Q and D| / |Q| + 0.3 |E and D| / |E| + 0.1 phrase)``.  The catalogue
    is eight constants, so nothing is joined or shuffled."""
    catalogue = F.array(*[F.struct(F.lit(n).alias("relation"), F.array(*map(F.lit, sorted(set(t.split())))).alias("terms")) for n, t in SCHEMA_DOCUMENTS.items()])

    def score(d: Column) -> Column:
        share = lambda c: F.size(F.array_intersect(c, d["terms"])) / F.size(c)
        phrase = F.exists("matched", lambda p: F.size(F.array_except(p, d["terms"])) == 0).cast("int")
        value = F.least(F.lit(1.0), BASE * share("tokens") + EXPANDED * share("expanded") + PHRASE * phrase)
        return F.struct(d["relation"].alias("relation"), F.round(value, 9).alias("lexical"))

    return with_synonyms(questions).select("key", "question", F.transform(catalogue, score).alias("scores"))


def semantic_scores(encode) -> Callable[[Column], Column]:
    """Inner products of a text's unit vector with those of all relations, in order."""
    matrix = np.stack([encode(t) for t in SCHEMA_DOCUMENTS.values()]).astype(np.float64)

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack([encode(t.lower()) for t in texts]).astype(np.float64) @ matrix.T) if len(texts) else [], dtype=object)

    return score


def link_schema(questions: DataFrame, k: int = 3, encode=None) -> DataFrame:
    """Input (key, question); output (key, relation, score, place): the k relations
    with the highest score, ties by name.  With an encoder the score is the weighted
    sum of the lexical and the semantic one, else the lexical one alone."""
    scored = lexical_scores(questions)
    if encode is not None:
        scored = scored.withColumn("semantic", semantic_scores(encode)(F.col("question")))
        scores = F.zip_with("scores", "semantic", lambda a, b: F.struct((-F.round(LEXICAL * a["lexical"] + SEMANTIC * b, 9)).alias("n"), a["relation"].alias("relation")))
    else:
        scores = F.filter(F.transform("scores", lambda a: F.struct((-a["lexical"]).alias("n"), a["relation"].alias("relation"))), lambda x: x["n"] < 0)
    best = scored.select("key", F.slice(F.sort_array(scores), 1, k).alias("best"))
    # outer: an inferred filter on the array would be pushed down and repeat all of the above
    placed = best.select("key", F.posexplode_outer("best").alias("p", "b")).where("p is not null")
    return placed.select("key", F.col("b.relation").alias("relation"), (-F.col("b.n")).alias("score"), (F.col("p") + 1).alias("place"))


def entity_phrases(labels: DataFrame) -> DataFrame:
    """(phrase, owner): the folded names under which an owner is known; a phrase
    that names several owners is dropped."""
    names = labels.where("owner is not null").select("owner", F.explode(F.concat(F.array("owner", "primary_label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    phrase = F.concat_ws(" ", words(fold_accents(F.col("name"))))
    phrases = names.where("name is not null").select(phrase.alias("phrase"), "owner").where("length(phrase) >= 4")
    one = phrases.groupBy("phrase").agg(F.min("owner").alias("owner"), F.max("owner").alias("other"))
    return one.where("owner = other").select("phrase", "owner")


def address_mentions(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Input (key, text); output (key, address, owner) of labelled addresses named."""
    named = texts.where("text is not null").select("key", F.explode(F.array_distinct(addresses_in(F.col("text")))).alias("address"))
    return named.join(labels.select("address", "owner"), "address").select("key", "address", "owner")


def _prefix_bits(text: str) -> Iterator[int]:
    """A number for each run of words at the start of a phrase, and one for the whole."""
    end = text.find(" ")
    while end >= 0:
        yield zlib.crc32(text[:end].encode())
        end = text.find(" ", end + 1)
    yield zlib.crc32(text.encode())
    yield zlib.crc32(text.encode(), _WHOLE)


def phrase_filter(phrases: DataFrame) -> np.ndarray:
    """Bits of all phrases and their prefixes, 2^20 to 2^27 of them by the number of
    words; a bit may be shared, so what passes has to be compared."""
    count = phrases.agg(F.sum(F.size(F.split("phrase", " ")) + 1)).first()[0] or 0
    bits = 1 << min(27, max(20, (16 * count).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = np.array([x % bits for p in batch["phrase"] if p is not None for x in _prefix_bits(p)], np.int64)
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        if own.any():
            yield pd.DataFrame({"bits": [zlib.compress(own.tobytes(), 1)]})

    made = np.zeros(bits // 8, np.uint8)
    # few partitions, fetched one after another: the driver holds two filters at most
    for row in phrases.select("phrase").repartition(4).mapInPandas(run, "bits binary").toLocalIterator():
        made |= np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return made


def phrase_mentions(texts: DataFrame, phrases: DataFrame, longest: int | None = None) -> DataFrame:
    """Input (key, text) and (phrase, owner); output (key, phrase, owner) of exact
    phrase matches on word borders.  A run of a text's words grows, up to
    ``longest`` where that is stated, while a filter of all phrases holds it as the
    start of one; runs of at least 4 letters that it holds as a whole meet the
    phrases in a join, so only likely matches are shuffled."""
    phrases = stored(phrases)
    shared = texts.sparkSession.sparkContext.broadcast(phrase_filter(phrases))
    tokens = F.concat_ws(" ", words(fold_accents(F.col("text"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = memoryview(shared.value)
        mask = len(own) * 8 - 1
        heads: dict[str, bool] = {}
        for batch in batches:
            keys, found = [], []
            for key, text in zip(batch["key"], batch["tokens"]):
                split, seen = text.split(" "), set()
                for i, word in enumerate(split):
                    begins = heads.get(word)
                    if begins is None:
                        x = zlib.crc32(word.encode()) & mask
                        if len(heads) >= 100_000:
                            heads.clear()
                        begins = heads[word] = bool(own[x >> 3] >> (x & 7) & 1)
                    j, line = i, word
                    while begins:
                        j += 1
                        x = zlib.crc32(line.encode(), _WHOLE) & mask
                        if len(line) >= 4 and own[x >> 3] >> (x & 7) & 1:
                            seen.add(line)
                        if j == len(split) or j - i == longest:
                            break
                        line = f"{line} {split[j]}"
                        x = zlib.crc32(line.encode()) & mask
                        begins = own[x >> 3] >> (x & 7) & 1
                keys += [key] * len(seen)
                found += seen
            yield pd.DataFrame({"key": pd.Series(keys, dtype=batch["key"].dtype), "phrase": pd.Series(found, dtype=object)})

    kind = texts.schema["key"].dataType.simpleString()
    found = texts.where("text is not null").select("key", tokens.alias("tokens")).where("tokens != ''").mapInPandas(run, f"key {kind}, phrase string")
    return found.hint("merge").join(phrases, "phrase").select("key", "phrase", "owner")


def longest_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions that no longer mention of the same text contains."""
    w = Window.partitionBy("key")
    all_phrases = F.collect_set("phrase").over(w)
    covered = F.exists(all_phrases, lambda p: (p != F.col("phrase")) & F.contains(F.concat(F.lit(" "), p, F.lit(" ")), F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))))
    return mentions.withColumn("covered", covered).where("not covered").drop("covered")


def entity_words(labels: DataFrame, shortest: int = 5) -> DataFrame:
    """(phrase, owner): words of owners' names that occur with one owner only."""
    named = labels.where("owner is not null").select("owner", F.explode(words(fold_accents(F.col("owner")))).alias("phrase")).where(F.length("phrase") >= shortest)
    one = named.groupBy("phrase").agg(F.min("owner").alias("owner"), F.max("owner").alias("other"))
    return one.where("owner = other").select("phrase", "owner")


def fuzzy_mentions(mentions: DataFrame, phrases: DataFrame, least: float = 0.85) -> DataFrame:
    """Input (key, word) and (phrase, owner); output (key, word, phrase, owner,
    score) with an indel similarity of at least ``least``.

    Distinct strings meet in a grid of cells by codes of their letters' counts,
    which loses no pair; each pair that is left is verified once.
    """
    scored = similar_pairs(F.col("word"), mentions, F.col("phrase"), phrases, Characters(least)).withColumnsRenamed({"a": "word", "b": "phrase"})
    return scored.join(phrases.hint("merge"), "phrase").join(mentions.hint("merge"), "word").select("key", "word", "phrase", "owner", "score")


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 2048) -> DataFrame:
    """Input (vec_id, embedding) on both sides; output (vec_id, place, neighbour_id):
    the k largest inner products of unit vectors, without the query itself, ties
    by id.  Rows without an id or a whole vector neither ask nor answer.

    Queries go out in blocks of ``block`` vectors (a bounded broadcast); one scan a
    block computes a partial top-k in each task, and only those meet in the
    shuffle.  The blocks are numbered by a hash, so no query set is collected whole.
    """
    spark = vectors.sparkSession
    whole = "vec_id is not null and embedding is not null and not exists(embedding, x -> x is null)"
    vectors, queries = vectors.where(whole), queries.where(whole)
    blocks = max(1, -(-queries.count() // block))
    numbered = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    found = None
    for number in range(blocks):
        rows = numbered.where(F.col("part") == number).select("vec_id", "embedding").collect()
        if not rows:
            continue
        ids = np.array([r["vec_id"] for r in rows])
        matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((ids, matrix / np.where(norms == 0, 1, norms)))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            own_ids, own = shared.value
            for batch in batches:
                batch = batch[batch["embedding"].notna()]
                if batch.empty:
                    continue
                other = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
                size = np.linalg.norm(other, axis=1, keepdims=True)
                names = batch["vec_id"].to_numpy()
                scores = own @ (other / np.where(size == 0, 1, size)).T
                scores[own_ids[:, None] == names[None, :]] = -np.inf
                top = min(k, scores.shape[1])
                # all that tie with the k-th stay, the merge decides by id
                edge = -np.partition(-scores, top - 1, axis=1)[:, top - 1 : top]
                r, c = np.nonzero((scores >= edge) & np.isfinite(scores))
                yield pd.DataFrame({"vec_id": own_ids[r], "neighbour_id": names[c], "score": scores[r, c]})

        part = vectors.select("vec_id", "embedding").mapInPandas(scan, "vec_id bigint, neighbour_id bigint, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "vec_id bigint, place int, neighbour_id bigint")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc(F.round("score", 9)), "neighbour_id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("vec_id", "place", "neighbour_id")


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Input ranked (key, place, item) and relevant (key, item); one row with
    recall at 1, 3 and 5, the mean reciprocal rank over all relevant keys and the median
    and 95th percentile of the places at which they are found."""
    hits = ranked.join(relevant, ["key", "item"], "left_semi").groupBy("key").agg(F.min("place").alias("first"))
    all_keys = relevant.select("key").distinct().join(hits, "key", "left")
    reached = F.percentile("first", F.array(F.lit(0.5), F.lit(0.95)))
    share = lambda n: F.avg(F.when(F.col("first") <= n, 1.0).otherwise(0.0))
    return all_keys.agg(share(1).alias("recall_1"), share(3).alias("recall_3"), share(5).alias("recall_5"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), reached[0].alias("place_p50"), reached[1].alias("place_p95"))
