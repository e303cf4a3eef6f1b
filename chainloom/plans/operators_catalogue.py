"""Queries of the operators that aren't analytical shapes, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions import text
from chainloom.operators import baseline, components, dataset, evaluation, extraction, linking, mentions, statements, triples
from chainloom.plans.reference_sql import with_relations
from chainloom.sources import ledger
from chainloom.sources.checkpoints import stored
from chainloom.sources.tables import table
from chainloom.streaming import events

START, END = "2026-06-01", "2026-07-01"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    """Registers a function under its name, with SQL where SQL can express it."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = with_relations(sql, START, END)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: Addresses of a text: whole words of that form.
_ADDRESSES = "list_filter(regexp_extract_all(lower({0}), '[0-9a-z_]+'), lambda w: regexp_full_match(w, '0x[0-9a-f]{{40}}'))"
_BUCKET = "cast('0x' || substr(sha256({0}), 1, 8) as bigint) % 100"
_SELECTED = f"""selected as (select t.*, case when t.from_address in (select address from entity_labels) or t.to_address in (select address from entity_labels) then 'labelled'
    when {_BUCKET.format('t.transaction_hash')} < 1 then 'sample' end as tier from transaction_facts t)"""


@_query(f"with {_SELECTED} select transaction_hash, tier from selected where tier is not null")
def o014_selected_transactions(spark, folder):
    return extraction.selected_transactions(spark, folder, START, END).select("transaction_hash", "tier")


@_query(f"with {_SELECTED} select b.block_number, b.transaction_count from block_facts b where (b.block_number, b.block_hash) in (select (block_number, block_hash) from selected where tier is not null)")
def o015_selected_blocks(spark, folder):
    return extraction.selected_blocks(spark, folder, START, END).select("block_number", "transaction_count")


@_query(f"with {_SELECTED} select transaction_hash, log_index, value_raw from token_transfer_facts where transaction_hash in (select transaction_hash from selected where tier is not null)")
def o016_selected_transfers(spark, folder):
    return extraction.selected_transfers(spark, folder, START, END).select("transaction_hash", "log_index", "value_raw")


@_query("select address, is_erc20 from contract_dimension where address in (select address from entity_labels)")
def o017_selected_contracts(spark, folder):
    return extraction.selected_contracts(spark, folder, END).select("address", "is_erc20")


@_query("""select transaction_hash, block_number, value_wei from transaction_facts where transaction_hash in
    (select lower(transaction_hash) from token_transfers)""")
def o068_batch_lookup(spark, folder):
    """The batch is a table of hashes here, those of all transfers; small literal
    batches use ``extraction.batch_lookup``."""
    facts = ledger.transaction_facts(spark, folder, START, END)
    keys = table(spark, folder, "token_transfers").select(F.lower("transaction_hash").alias("transaction_hash")).distinct()
    return facts.join(keys, "transaction_hash", "left_semi").select("transaction_hash", "block_number", "value_wei")


@_query("""select transaction_hash, block_number, value_wei from transaction_facts where cast(block_timestamp as date) = date '2026-06-10' order by transaction_hash limit 100""")
def o013_day_sample(spark, folder):
    return extraction.day_sample(spark, folder, "2026-06-10").select("transaction_hash", "block_number", "value_wei")


@_query("select transaction_hash, value_wei from transaction_facts order by value_wei desc nulls last, transaction_hash limit 20 offset 40")
def o112_third_page(spark, folder):
    facts = ledger.transaction_facts(spark, folder, START, END)
    return facts.orderBy(F.desc_nulls_last("value_wei"), "transaction_hash").offset(40).limit(20).select("transaction_hash", "value_wei")


@_query("""with pairs as (select distinct least(from_address, to_address) as low, greatest(from_address, to_address) as high from transaction_facts where to_address is not null and value_wei > 0),
    ranked as (select low || '/' || high as group_id, transaction_hash, value_wei, row_number() over (partition by low, high order by block_timestamp desc, transaction_hash desc) as place
      from transaction_facts join pairs on least(from_address, to_address) = low and greatest(from_address, to_address) = high where to_address is not null)
    select group_id, transaction_hash, value_wei from ranked where place = 1""")
def o069_latest_between_pairs(spark, folder):
    facts = ledger.transaction_facts(spark, folder, START, END)
    low, high = F.least("from_address", "to_address"), F.greatest("from_address", "to_address")
    pairs = facts.where("to_address is not null and value_wei > 0").select(F.concat_ws("/", low, high).alias("group_id"), low.alias("account_a"), high.alias("account_b")).distinct()
    return extraction.latest_between_pairs(facts, pairs).select("group_id", "transaction_hash", "value_wei")


# --- text functions

@_query("select case_id, nfc_normalize(replace(replace(strip_accents(question), 'đ', 'd'), 'Đ', 'D')) as folded from evaluation_cases where question is not null")
def o147_accent_fold(spark, folder):
    cases = table(spark, folder, "evaluation_cases").where("question is not null")
    return cases.select("case_id", text.fold_marks(F.col("question")).alias("folded"))


@_query("select address_lower, url_encode(owner) as quoted from entities where owner is not null")
def o152_quoted_owners(spark, folder):
    return table(spark, folder, "entities").where("owner is not null").select("address_lower", text.url_quoted(F.col("owner")).alias("quoted"))


@_query()
def o146_folded_text(spark, folder):
    return table(spark, folder, "evaluation_cases").select("case_id", text.fold_text(F.col("question")).alias("folded"))


@_query("""select address, round(levenshtein(lower(symbol), lower(name)) / cast(greatest(length(symbol), length(name)) as double), 9) as distance
    from amended_tokens where symbol is not null and name is not null and greatest(length(symbol), length(name)) > 0""")
def o148_normalised_distance(spark, folder):
    tokens = table(spark, folder, "amended_tokens").where("symbol is not null and name is not null and greatest(length(symbol), length(name)) > 0")
    return tokens.select("address", F.round(text.normalised_distance(F.lower("symbol"), F.lower("name")), 9).alias("distance"))


@_query()
def o149_indel_ratio(spark, folder):
    labels = table(spark, folder, "entities").where("owner is not null and primary_label is not null")
    return labels.select("address_lower", F.round(text.indel_ratio(F.lower("owner"), F.lower("primary_label")), 9).alias("similarity"))


@_query(f"""select case_id, bucket, case when bucket < 10 then 'development' else 'train' end as part
    from (select case_id, {_BUCKET.format("'split:' || coalesce(gold_sql, '')")} as bucket from evaluation_cases)""")
def o151_hashed_split(spark, folder):
    cases = table(spark, folder, "evaluation_cases")
    return dataset.hashed_split(cases, F.coalesce("gold_sql", F.lit("")), "split").select("case_id", "bucket", "part")


@_query(f"""select case_id, array_to_string({_ADDRESSES.format('question')}, ',') as addresses,
    array_to_string(regexp_extract_all(question, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1), ',') as dates from evaluation_cases where question is not null""")
def o153_named_values(spark, folder):
    cases = table(spark, folder, "evaluation_cases").where("question is not null")
    q = F.col("question")
    return cases.select("case_id", F.array_join(text.addresses_in(q), ",").alias("addresses"), F.array_join(text.dates_in(q), ",").alias("dates"))


@_query("""with t as (select doc_id, [w for w in string_split_regex(lower(text), '[^0-9a-z]+') if w <> ''] as ws from documents where text is not null)
    select doc_id, case when len(ws) >= 5 then len(list_distinct([array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)])) when len(ws) > 0 then 1 else 0 end as runs from t""")
def o155_shingles(spark, folder):
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.select("doc_id", F.size(text.shingles(text.words(F.col("text")))).alias("runs"))


# --- linking

_TERMS = ", ".join(f"('{n}', {sorted(set(t.split()))!r})" for n, t in linking.SCHEMA_DOCUMENTS.items())
_WORDS = "[w for w in string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}_]+') if w <> '']"
_GROUPS = ", ".join(f"({[list(p.split()) for p in g]!r}, {list(dict.fromkeys(' '.join(g).split()))!r})" for g in linking.SYNONYMS)


@_query()
def o195_schema_links(spark, folder):
    """Lexical and semantic score fused; the encoder hashes character trigrams."""
    cases = table(spark, folder, "evaluation_cases").select(F.col("case_id").alias("key"), "question")
    return linking.link_schema(cases, encode=mentions.hashed_vector)


@_query(f"""with documents_of(relation, terms) as (values {_TERMS}), synonyms(phrases, members) as (values {_GROUPS}),
    read as (select prediction_id as key, {_WORDS.format('prediction')} as ws from evaluation_predictions where prediction is not null),
    asked as (select key, ' ' || array_to_string(ws, ' ') || ' ' as line, list_distinct(case when list_has_any(ws, {list(linking.TIME_CUES)!r}) then list_concat(ws, {list(linking.TIME_TERMS)!r}) else ws end) as q
      from read where len(ws) > 0),
    hit as (select key, list_filter(phrases, lambda p: contains(line, ' ' || array_to_string(p, ' ') || ' ')) as hits, members from asked cross join synonyms),
    grown as (select key, flatten(list(members)) as more, flatten(list(hits)) as matched from hit where len(hits) > 0 group by key),
    full_ as (select a.key as key, q, list_distinct(list_concat(q, coalesce(more, []))) as e, coalesce(matched, []) as matched from asked a left join grown g on a.key = g.key),
    scored as (select key, relation, round(least(1.0, 0.6 * len(list_intersect(q, terms)) / cast(len(q) as double) + 0.3 * len(list_intersect(e, terms)) / cast(len(e) as double)
      + case when len(list_filter(matched, lambda p: list_has_all(terms, p))) > 0 then 0.1 else 0 end), 9) as score from full_ cross join documents_of)
    select key, relation, score, place from (select *, row_number() over (partition by key order by score desc, relation) as place from scored where score > 0) where place <= 3""")
def o192_lexical_score(spark, folder):
    rows = table(spark, folder, "evaluation_predictions")
    return linking.link_schema(rows.select(F.col("prediction_id").alias("key"), F.col("prediction").alias("question")))


@_query(f"""with named as (select distinct doc_id as key, unnest({_ADDRESSES.format('text')}) as address from documents where text is not null)
    select key, n.address as address, owner from named n join entity_labels l on n.address = l.address""")
def o198_address_mentions(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "text")
    return linking.address_mentions(docs, ledger.entity_labels(spark, folder))


@_query()
def o199_phrase_mentions(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "text")
    return linking.longest_mentions(linking.phrase_mentions(docs, linking.entity_phrases(ledger.entity_labels(spark, folder))))


def _labels_as_texts(spark, folder):
    """(texts, labels, phrases): labels as people typed them, to be searched for owners' names."""
    labels = ledger.entity_labels(spark, folder)
    phrases = linking.entity_phrases(labels).select("phrase", F.col("owner").alias("target"), F.lit(False).alias("signal"))
    return labels.select(F.col("address").alias("key"), F.col("primary_label").alias("text")), labels, phrases


@_query()
def o200_fuzzy_mentions(spark, folder):
    texts, _, phrases = _labels_as_texts(spark, folder)
    windows, phrases = stored(mentions.token_windows(texts)), stored(phrases)
    open_ = stored(mentions.uncovered(windows, mentions.exact_proposals(windows, phrases)))
    found = mentions.fuzzy_proposals(open_, phrases)
    return found.select("key", "start", "end", F.array_join("targets", "|").alias("targets"), "score")


@_query()
def o201_vector_mentions(spark, folder):
    texts, _, phrases = _labels_as_texts(spark, folder)
    found = mentions.vector_proposals(stored(mentions.token_windows(texts)), phrases)
    return found.select("key", "start", "end", F.array_join("targets", "|").alias("targets"), F.round("score", 6).alias("score"))


@_query()
def o203_selected_mentions(spark, folder):
    found = mentions.link_entities(*_labels_as_texts(spark, folder))
    return found.select("key", "start", "end", "stage", F.array_join("targets", "|").alias("targets"))


@_query()
def o208_resolution_plans(spark, folder):
    texts, labels, phrases = _labels_as_texts(spark, folder)
    return mentions.resolution_plans(mentions.link_entities(texts, labels, phrases), texts)


@_query()
def o219_mention_scores(spark, folder):
    """Exact mentions of an owner in its own label as gold, the linker's as found."""
    texts, labels, phrases = _labels_as_texts(spark, folder)
    known = labels.select(F.col("address").alias("key"), F.col("owner").alias("target"))
    gold = mentions.exact_proposals(mentions.token_windows(texts), phrases).select("key", "start", "end", F.col("targets")[0].alias("target")).join(known.hint("merge"), ["key", "target"], "left_semi")
    return mentions.mention_scores(mentions.link_entities(texts, labels, phrases), gold)


@_query("""select concept_class, case when concept_class = 'TreasuryAccount' then 'treasury' else 'operational' end as required_role,
    count(distinct case when address_role = case when concept_class = 'TreasuryAccount' then 'treasury' else 'operational' end then owner end) as owners,
    count(distinct case when address_role = case when concept_class = 'TreasuryAccount' then 'treasury' else 'operational' end then owner end) > 0 as covered
    from entity_labels where concept_class is not null group by 1, 2""")
def o206_class_coverage(spark, folder):
    labels = ledger.entity_labels(spark, folder)
    roles = labels.select("concept_class").distinct().withColumn("required_role", F.when(F.col("concept_class") == "TreasuryAccount", "treasury").otherwise("operational"))
    return mentions.class_coverage(labels, roles)


# --- answering by rule, reading statements

@_query()
def o209_rule_answers(spark, folder):
    return baseline.answer_by_rule(table(spark, folder, "evaluation_cases").select(F.col("case_id").alias("key"), "question"))


@_query()
def o212_typed_slots(spark, folder):
    cases = table(spark, folder, "evaluation_cases").where("question is not null")
    slots = cases.select("case_id", baseline.typed_slots(F.col("question")).alias("s"))
    return slots.select("case_id", *[F.array_join(F.col(f"s.{k}"), ",").alias(k) for k in ("dates", "hashes", "addresses", "numbers", "symbols")])


_BODY = "regexp_replace(regexp_replace(regexp_replace(prediction, '\\r\\n?', '\n', 'g'), '^\\s+', ''), '\\s+$', '')"


@_query(f"""with t as (select prediction_id, prediction, {_BODY} as body from evaluation_predictions),
    f as (select *, regexp_full_match(body, '(?is)```(?:sql|googlesql)?[ \\t]*\\n.*\\n```[ \\t]*') as fenced from t),
    i as (select *, case when fenced then regexp_replace(regexp_replace(regexp_extract(body, '(?is)^```(?:sql|googlesql)?[ \\t]*\\n(.*)\\n```[ \\t]*$', 1), '^\\s+', ''), '\\s+$', '') else body end as inside from f)
    select prediction_id, case when prediction is null or inside = '' then 'empty' when not fenced and contains(body, '```') then 'prose'
      when upper(regexp_extract(inside, '^([A-Za-z]+)\\b', 1)) in {statements.CHANGING!r} then 'unsafe_sql'
      when upper(regexp_extract(inside, '^([A-Za-z]+)\\b', 1)) in ('SELECT', 'WITH') then 'query' else 'prose' end as kind from i""")
def o216_response_kinds(spark, folder):
    return table(spark, folder, "evaluation_predictions").select("prediction_id", statements.response_kind(F.col("prediction")).alias("kind"))


@_query()
def o217_statement_checks(spark, folder):
    rows = table(spark, folder, "evaluation_predictions").select(F.col("prediction_id").alias("key"), F.col("prediction").alias("response"))
    return statements.extraction_status(rows).select("key", "status", F.array_join("faults", ",").alias("faults"))


_UNIT = "[cast(x as double) / sqrt(list_inner_product(cast(embedding as double[]), cast(embedding as double[]))) for x in embedding]"


@_query(f"""with v as (select vec_id, {_UNIT} as e from embeddings), scored as (
      select q.vec_id as vec_id, d.vec_id as neighbour_id, round(list_inner_product(q.e, d.e), 9) as score from v q join v d on q.vec_id % 50 = 0 and q.vec_id <> d.vec_id)
    select vec_id, place, neighbour_id from (select *, row_number() over (partition by vec_id order by score desc, neighbour_id) as place from scored) where place <= 5""")
def o213_nearest_neighbours(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return linking.nearest_neighbours(vectors, vectors.where("vec_id % 50 = 0"))


@_query()
def o218_retrieval_metrics(spark, folder):
    vectors = table(spark, folder, "embeddings")
    ranked = linking.nearest_neighbours(vectors.select("vec_id", "embedding"), vectors.where("vec_id % 50 = 0").select("vec_id", "embedding"))
    labels = vectors.select("vec_id", "label")
    items = ranked.join(labels.withColumnRenamed("vec_id", "neighbour_id").withColumnRenamed("label", "item"), "neighbour_id").select(F.col("vec_id").alias("key"), "place", "item")
    relevant = labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("key"), F.col("label").alias("item"))
    return linking.retrieval_metrics(items, relevant)


# --- dataset pipeline

@_query("""select cast(d as date) as window_start, cast(d + interval 7 day as date) as window_end from generate_series(timestamp '2026-06-01', timestamp '2026-06-24', interval 1 day) g(d)""")
def o231_date_windows(spark, folder):
    return dataset.date_windows(spark, START, END, 7)


@_query("select prediction_id, (['easy', 'medium', 'hard'])[((prediction_id % 3) + 1)::int] as choice from evaluation_predictions")
def o232_cycled_pool(spark, folder):
    return dataset.cycle_pool(table(spark, folder, "evaluation_predictions"), "prediction_id", ["easy", "medium", "hard"]).select("prediction_id", "choice")


@_query("""select template_id, count(*) as n, round(count(*) / cast((select count(template_id) from witness_groups) as double), 9) as share,
    round(count(*) / cast((select count(template_id) from witness_groups) as double), 9) <= 0.1 as within from witness_groups where template_id is not null group by template_id""")
def o233_template_shares(spark, folder):
    return dataset.share_quota(table(spark, folder, "witness_groups"), "template_id", 0.1)


@_query("""select template_id, min(witness_record_id) as witness, count(*) as members from witness_groups where template_id is not null and trim(template_id) <> '' group by template_id""")
def o234_witness_groups(spark, folder):
    groups = table(spark, folder, "witness_groups").where("template_id is not null and trim(template_id) <> ''")
    return groups.groupBy("template_id").agg(F.min("witness_record_id").alias("witness"), F.count("*").alias("members"))


def _kept_texts(spark, folder):
    cases = table(spark, folder, "evaluation_cases").where("split = 'train'").select(F.col("case_id").alias("key"), F.col("question").alias("text"))
    held = table(spark, folder, "held_out_sources").select(F.explode("questions").alias("text"))
    return cases, held


@_query()
def o238_held_out_overlap(spark, folder):
    return dataset.held_out_overlap(*_kept_texts(spark, folder))


@_query()
def o072_without_held_out(spark, folder):
    return dataset.without_held_out(*_kept_texts(spark, folder)).select("key")


@_query("""select case_id, difficulty, place from (select case_id, difficulty, row_number() over (partition by difficulty, source order by sha256('audit:' || case_id), case_id) as place
    from evaluation_cases) where place <= 2""")
def o239_audit_sample(spark, folder):
    return dataset.audit_sample(table(spark, folder, "evaluation_cases"), ["difficulty", "source"], "case_id", "audit").select("case_id", "difficulty", "place")


@_query("""select pair_id, decision, events from (select pair_id, decision, row_number() over (partition by pair_id order by voted_at desc nulls last, vote_id desc) as place,
    count(*) over (partition by pair_id) as events from review_votes where pair_id is not null) where place = 1""")
def o240_folded_votes(spark, folder):
    return dataset.fold_events(table(spark, folder, "review_votes"), "pair_id", ["voted_at", "vote_id"], ["decision"])


_TWICE = """select arg_min(lower(trim(decision)), (voted_at, vote_id)) as a, arg_max(lower(trim(decision)), (voted_at, vote_id)) as b from review_votes
    where pair_id is not null and decision is not null group by pair_id having count(*) > 1"""


@_query(f"""with pairs as ({_TWICE}), n as (select count(*) as items, count_if(a = b) as same from pairs),
    p as (select coalesce(sum(ra * rb), 0) as product from (select a as r, count(*) as ra from pairs group by a) x join (select b as r, count(*) as rb from pairs group by b) y using (r))
    select items, case when items > 0 then round(same / items::double, 9) end as observed, case when items > 0 then round(product / (items::double * items), 9) end as expected,
    round(case when items > 0 then case when product / (items::double * items) = 1 then 1.0 else (same / items::double - product / (items::double * items)) / (1 - product / (items::double * items)) end end, 9) as kappa from n, p""")
def o244_cohen_kappa(spark, folder):
    votes = table(spark, folder, "review_votes").where("pair_id is not null and decision is not null").withColumn("rating", F.lower(F.trim("decision")))
    order = F.struct("voted_at", "vote_id")
    twice = votes.groupBy("pair_id").agg(F.min_by("rating", order).alias("a"), F.max_by("rating", order).alias("b"), F.count("*").alias("n")).where("n > 1")
    return dataset.cohen_kappa(twice)


@_query("select difficulty, count(*) as n, round(count(*) / cast((select count(difficulty) from evaluation_cases) as double), 9) as share from evaluation_cases where difficulty is not null group by difficulty")
def o246_difficulty_shares(spark, folder):
    return dataset.share_quota(table(spark, folder, "evaluation_cases"), "difficulty", 1.0).select("difficulty", "n", "share")


_SHAPE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '''[^'']*''', '?', 'g'), '\\b[0-9]+\\b', '?', 'g'), '[`;]', '', 'g'), '\\s+', ' ', 'g'))"


@_query(f"""with s as (select case_id as key, {_SHAPE.format('gold_sql')} as shape from evaluation_cases where gold_sql is not null)
    select key, shape, regexp_matches(shape, '\\bjoin\\b') as has_join, regexp_matches(shape, '\\bgroup by\\b') as has_group, regexp_matches(shape, '\\bover \\(') as has_window,
    regexp_matches(shape, '\\blimit\\b') as has_limit, regexp_matches(shape, '^with\\b') as has_cte from s""")
def o247_statement_features(spark, folder):
    return dataset.statement_features(table(spark, folder, "evaluation_cases").select(F.col("case_id").alias("key"), F.col("gold_sql").alias("sql")))


@_query("""with names as (select trim(lower(alias)) as alias, owner from (select unnest(aliases) as alias, owner from entities where owner is not null and address_lower is not null))
    select alias, min(owner) as owner from names where alias <> '' group by alias having count(distinct owner) = 1""")
def o248_unambiguous_names(spark, folder):
    return dataset.unambiguous_names(ledger.entity_labels(spark, folder))


@_query("""select concept_class, count(*) as n from entity_labels group by concept_class""")
def o095_class_counts(spark, folder):
    return ledger.entity_labels(spark, folder).groupBy("concept_class").agg(F.count("*").alias("n"))


_SQL_BASE = "trim(regexp_replace(regexp_replace(lower(gold_sql), '[\\s`;]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@_query(f"""with r as (select case_id, {_SQL_BASE} as plain from evaluation_cases where case_id is not null and gold_sql is not null),
    g as (select case_id, regexp_replace(plain, ' limit [0-9]{{1,18}}$', '') as base, try_cast(nullif(regexp_extract(plain, ' limit ([0-9]{{1,18}})$', 1), '') as bigint) as n from r)
    select base, count(*) as members, arg_min(case_id, (coalesce(n, 0), case_id)) as witness, min(n) as least_n, case when n is null then 'exact' else 'limit_monotonic' end as proof
    from g group by base, n is null, case when n is null then 'exact' else 'limit_monotonic' end""")
def o113_limit_witnesses(spark, folder):
    return dataset.limit_witnesses(table(spark, folder, "evaluation_cases").select(F.col("case_id").alias("key"), F.col("gold_sql").alias("sql")))


_ALLOTTED = {"count_transactions": 300, "latest_sent": 400, "token_volume": 300}
_PATTERNS = (
    ("count_transactions", "en", "How many transactions were there from {window_start} until {window_end}?"), ("count_transactions", "vi", "Có bao nhiêu giao dịch từ {window_start} đến {window_end}?"),
    ("latest_sent", "en", "List the latest {n} transactions between {window_start} and {window_end}."), ("latest_sent", "vi", "Liệt kê {n} giao dịch mới nhất từ {window_start} đến {window_end}."),
    ("token_volume", "en", "What volume was transferred from {window_start} until {window_end}?"), ("token_volume", "vi", "Khối lượng được chuyển từ {window_start} đến {window_end} là bao nhiêu?"),
)
_MADE = f"""allotted(template_id, allotted) as (values {', '.join(f"('{k}', {n})" for k, n in _ALLOTTED.items())}),
    made as (select printf('%s-%06d', template_id, position) as id, template_id, position, cast(date '{START}' + cast(position % 24 as int) as date) as window_start,
      cast(date '{START}' + cast(position % 24 as int) + 7 as date) as window_end, ([5, 10, 20, 50])[cast((position // 24) % 4 + 1 as int)] as n
      from (select template_id, unnest(range(allotted)) as position from allotted))"""
_EXPANDED = f"""patterns(template_id, language, pattern) as (values {', '.join(map(repr, _PATTERNS))}),
    styles(language, style, frame) as (values {', '.join(repr((lang, style, frame)) for (lang, style), frame in dataset.STYLES.items())}),
    expanded as (select id || '__' || language || '__' || style as id, id as family, language, style,
      replace(frame, '{{0}}', replace(replace(replace(pattern, '{{n}}', n::varchar), '{{window_start}}', window_start::varchar), '{{window_end}}', window_end::varchar)) as question
      from made join patterns using (template_id) join styles using (language))"""


def _records(spark):
    return dataset.generated_records(spark, _ALLOTTED, START, END)


def _expanded(spark):
    patterns = spark.createDataFrame(list(_PATTERNS), "template_id string, language string, pattern string")
    return dataset.expanded_questions(_records(spark), patterns)


@_query(f"with {_MADE} select * from made")
def o230_generated_records(spark, folder):
    return _records(spark)


@_query(f"with {_MADE}, {_EXPANDED} select * from expanded")
def o235_expanded_questions(spark, folder):
    return _expanded(spark)


@_query(f"""with {_MADE}, {_EXPANDED}, folded as (select * replace (replace(replace(strip_accents(question), 'đ', 'd'), 'Đ', 'D') as question) from expanded),
    d as (select a.family as family, a.language as language, levenshtein(a.question, b.question) / cast(greatest(length(a.question), length(b.question)) as double) as d
      from folded a join folded b on a.family = b.family and a.language = b.language and a.style < b.style)
    select family, language, count(*) as pairs, round(avg(d), 9) as diversity, round(avg(d), 9) > 0.3 as diverse from d group by family, language""")
def o236_wording_diversity(spark, folder):
    """Accents aside: the other engine's distance counts bytes."""
    return dataset.wording_diversity(_expanded(spark).withColumn("question", text.fold_accents(F.col("question"))))


def _noise(spark, folder):
    cases = table(spark, folder, "evaluation_cases").select(F.col("case_id").alias("key"), F.col("question").alias("text"))
    return dataset.with_noise(cases, {"typo": 40, "abbreviation": 30, "fragment": 20, "mixed_case": 10}, "noise")


@_query()
def o242_noisy_questions(spark, folder):
    """Quotas of noisy copies are the feature; candidates come from all questions."""
    return _noise(spark, folder)


@_query()
def o243_noise_statistics(spark, folder):
    return dataset.noise_statistics(_noise(spark, folder))


@_query()
def o214_snapshot_faults(spark, folder):
    cases = table(spark, folder, "evaluation_cases").select(F.col("case_id").alias("key"), F.col("question").alias("text"), "split")
    return dataset.snapshot_faults(cases, _kept_texts(spark, folder)[1])


@_query("""with raw as (select lower(address_lower) as address, owner, list_concat(coalesce(aliases, []), [owner]) as names from entities where owner is not null and address_lower is not null),
    each as (select trim(regexp_replace(lower(unnest(list_filter(names, lambda x: x is not null))), '[ \t\n\r\f\v]+', ' ', 'g'), ' ') as alias, owner from raw)
    select alias, min(owner) as owner from each where alias <> '' group by alias having count(distinct owner) = 1""")
def o024_dictionary(spark, folder):
    raw = ledger.entity_labels(spark, folder).select("address", "owner", "category", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), "|").alias("aliases"))
    return dataset.build_dictionary(raw)[2]


# --- evaluation

def _matches(spark, folder):
    return evaluation.exact_matches(table(spark, folder, "evaluation_predictions"), table(spark, folder, "evaluation_cases"))


_PLAIN = (
    "trim(array_to_string(list_transform(string_split(regexp_replace({0}, '[`;]', '', 'g'), ''''), lambda x, i: case when i % 2 = 1 then "
    "regexp_replace(regexp_replace(lower(x), '\\s+', ' ', 'g'), '\\s*([(),=<>+*/-])\\s*', '\\1', 'g') else x end), ''''))"
)
_FENCED = "nullif(regexp_extract(prediction, '(?is)```[a-z]*\\s*\\n(.*?)```', 1), '')"
_LED = "nullif(regexp_extract(prediction, '(?s)(?:^|\\n|[.:!?] )[ \\t]*((?:SELECT|WITH|select|with)\\b.*)$', 1), '')"
_SAID = f"coalesce(case when trim({_FENCED}) <> '' then {_FENCED} end, {_LED})"
_MATCHES = f"""matches as (select prediction_id, run_id, baseline, p.case_id as case_id, language,
    coalesce({_PLAIN.format(_SAID)} = {_PLAIN.format('gold_sql')}, false) as matched from evaluation_predictions p join evaluation_cases c on p.case_id = c.case_id)"""


@_query(f"with {_MATCHES} select prediction_id, matched from matches")
def o264_exact_match(spark, folder):
    return _matches(spark, folder).select("prediction_id", "matched")


@_query()
def o210_token_f1(spark, folder):
    cases = table(spark, folder, "evaluation_cases").select("case_id", F.col("gold_sql").alias("b"))
    pairs = table(spark, folder, "evaluation_predictions").join(cases, "case_id").select(F.col("prediction_id").alias("key"), F.col("prediction").alias("a"), "b")
    return evaluation.token_f1(pairs)


@_query("""with e as (select from_address as k, count(*) as n from transaction_facts group by from_address), a as (select to_address as k, count(*) as n from transaction_facts group by to_address),
    s as (select count(*) as shared from e join a on e.k is not distinct from a.k and e.n = a.n)
    , n as (select cast((select count(*) from e) as double) as e, cast((select count(*) from a) as double) as a, cast(shared as double) as s from s)
    select cast(e as bigint) as expected_rows, cast(a as bigint) as actual_rows, cast(s as bigint) as shared, round(s / a, 9) as precision, round(s / e, 9) as recall, round(2 * s / (e + a), 9) as f1, e = a and e = s as equal from n""")
def o263_multiset_scores(spark, folder):
    facts = ledger.transaction_facts(spark, folder, START, END)
    out = facts.groupBy(F.col("from_address").alias("k")).agg(F.count("*").alias("n"))
    back = facts.groupBy(F.col("to_address").alias("k")).agg(F.count("*").alias("n"))
    scores = evaluation.multiset_scores(out, back)
    return scores.select("expected_rows", "actual_rows", "shared", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "equal")


@_query()
def o266_latency_intervals(spark, folder):
    return evaluation.latency_intervals(table(spark, folder, "evaluation_predictions"))


@_query(f"""with {_MATCHES}, best as (select case_id, max(case when baseline = 'b1' then matched::int end) as a, max(case when baseline = 'b2' then matched::int end) as b from matches group by case_id)
    select count(*) as cases, round(avg(a), 9) as left_value, round(avg(b), 9) as right_value, round(avg(a) - avg(b), 9) as delta from best where a is not null and b is not null""")
def o268_paired_delta(spark, folder):
    out = evaluation.paired_delta(_matches(spark, folder), "b1", "b2")
    return out.select("cases", *[F.round(c, 9).alias(c) for c in ("left_value", "right_value", "delta")])


@_query()
def o268_paired_interval(spark, folder):
    return evaluation.paired_delta(_matches(spark, folder), "b1", "b2").select("delta", "low", "high")


@_query("""select baseline, count(*) as n, round(quantile_cont(latency_ms, 0.5), 6) as p50, round(quantile_cont(latency_ms, 0.95), 6) as p95, round(quantile_cont(latency_ms, 0.99), 6) as p99
    from evaluation_predictions where latency_ms is not null group by baseline""")
def o266_latency_distribution(spark, folder):
    return evaluation.latency_distribution(table(spark, folder, "evaluation_predictions"))


@_query(f"""with last as (select run_id, case_id, arg_max(sha256({_SHAPE.format("coalesce(prediction, '')")}), (generated_at, prediction_id)) as shape from evaluation_predictions
      where case_id is not null and run_id is not null group by run_id, case_id)
    select a.run_id as run_a, b.run_id as run_b, count(*) as cases, count_if(a.shape = b.shape) as same from last a join last b on a.case_id = b.case_id and a.run_id < b.run_id group by 1, 2""")
def o267_run_agreement(spark, folder):
    return evaluation.run_agreement(table(spark, folder, "evaluation_predictions"))


@_query()
def o265_bootstrap_ratio(spark, folder):
    return evaluation.bootstrap_ratio(_matches(spark, folder))


@_query(f"""with {_MATCHES}, best as (select case_id, bool_or(matched) filter (baseline = 'b1') as a, bool_or(matched) filter (baseline = 'b2') as b from matches group by case_id),
    n as (select count_if(a and not b) as x, count_if(b and not a) as y from best where a is not null and b is not null)
    select x as only_first, y as only_second, round(case when x + y = 0 then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2))) from range(cast(least(x, y) + 1 as bigint)) r(i))) end, 6) as p_value from n""")
def o269_mcnemar(spark, folder):
    return evaluation.mcnemar(_matches(spark, folder), "b1", "b2").select("only_first", "only_second", F.round("p_value", 6).alias("p_value"))


@_query("""with j as (select prediction_id, gold_sql, lower(coalesce(prediction, '')) as t from evaluation_predictions p left join evaluation_cases c on p.case_id = c.case_id)
    select prediction_id, array_to_string([x for x in [case when gold_sql is null then 'no_case' end, case when not contains(t, 'select') then 'no_statement' end,
      case when contains(t, 'select') and not contains(t, ' from ') then 'no_source' end, case when contains(t, 'select') and contains(t, 'limit') and not contains(lower(gold_sql), 'limit') then 'extra_limit' end,
      case when contains(t, 'select') and not contains(t, 'limit') and contains(lower(gold_sql), 'limit') then 'missing_limit' end,
      case when contains(t, 'select') and not contains(t, 'group by') and contains(lower(gold_sql), 'group by') then 'missing_group' end] if x is not null], ',') as failures from j""")
def o270_failure_classes(spark, folder):
    found = evaluation.failure_classes(table(spark, folder, "evaluation_predictions"), table(spark, folder, "evaluation_cases"))
    return found.select("prediction_id", F.array_join("failures", ",").alias("failures"))


@_query(f"with {_MATCHES} select baseline, language, count(*) as n, sum(matched::bigint) as matched from (select baseline, coalesce(language, 'unknown') as language, matched from matches) group by cube (baseline, language)")
def o271_breakdown(spark, folder):
    return evaluation.breakdown(_matches(spark, folder))


@_query(f"""with {_MATCHES}, r as (select baseline, round(avg(case when language = 'en' then matched::int end), 9) as rate_en, round(avg(case when language = 'vi' then matched::int end), 9) as rate_vi
    from matches group by baseline) select baseline, rate_en, rate_vi, round(rate_en - rate_vi, 6) as gap from r""")
def o272_language_gaps(spark, folder):
    return evaluation.language_gaps(_matches(spark, folder))


@_query("select sha256(gold_sql) as sql_sha256, count(*) as cases, min(case_id) as first_case from evaluation_cases where gold_sql is not null group by 1")
def o273_shared_statements(spark, folder):
    return evaluation.shared_statements(table(spark, folder, "evaluation_cases"))


# --- triples

_LABEL_TRIPLES = """labels as (select 'account/' || address as s, concept_class, primary_label, owner, category, aliases from entity_labels),
    triples as (select s, 'type' as p, concept_class as o from labels union all select s, 'label', primary_label from labels union all select s, 'owner', owner from labels
      union all select s, 'category', category from labels union all select s, 'alias', a from (select s, unnest(aliases) as a from labels) where trim(a) <> '')"""


@_query(f"with {_LABEL_TRIPLES} select distinct s, p, o from triples where o is not null")
def o170_label_triples(spark, folder):
    return triples.label_triples(ledger.entity_labels(spark, folder)).select("s", "p", "o").distinct()


@_query("""with t as (select 'tx/' || transaction_hash as s, * from transaction_facts),
    f as (select s, 'type' as p, 'Transaction' as o from t union all select s, 'hash', transaction_hash from t union all select s, 'hasFrom', 'account/' || from_address from t
      union all select s, 'hasTo', 'account/' || to_address from t union all select s, 'hasValue', cast(value_wei as varchar) from t union all select s, 'hasGasUsed', cast(receipt_gas_used as varchar) from t
      union all select s, 'hasGasPrice', cast(gas_price_wei as varchar) from t union all select s, 'hasBlockNumber', cast(block_number as varchar) from t union all select s, 'includedInBlock', 'block/' || block_number from t
      union all select s, 'hasTimestamp', strftime(block_timestamp, '%Y-%m-%dT%H:%M:%SZ') from t union all select s, 'hasReceiptStatus', cast(is_success as varchar) from t)
    select s, p, o from f where o is not null""")
def o171_transaction_triples(spark, folder):
    return triples.transaction_triples(ledger.transaction_facts(spark, folder, START, END)).select("s", "p", "o")


@_query("""select 'hasFrom' as path, 'minCount' as message, count(*) as violations from transaction_facts where from_address is null having count(*) > 0
    union all select 'hasValue', 'minCount', count(*) from transaction_facts where value_wei is null having count(*) > 0
    union all select 'hasValue', 'minInclusive', count(*) from transaction_facts where value_wei < 0 having count(*) > 0
    union all select 'hasGasPrice', 'minInclusive', count(*) from transaction_facts where gas_price_wei < 0 having count(*) > 0
    union all select 'owner', 'minCount', count(*) from entity_labels where concept_class = 'ExchangeAccount' and owner is null having count(*) > 0
    union all select 'label', 'minCount', count(*) from entity_labels where concept_class = 'ExchangeAccount' and primary_label is null having count(*) > 0""")
def o178_violation_summary(spark, folder):
    return triples.violation_summary(triples.ledger_graph(spark, folder, START, END, once=False))


@_query(f"""with {_LABEL_TRIPLES}, graph as (select distinct s, p, o from triples where o is not null)
    select 'class' as kind, o as name, count(*) as uses from graph where p = 'type' group by o union all select 'property', p, count(*) from graph group by p""")
def o180_ontology_inventory(spark, folder):
    return triples.ontology_inventory(triples.label_triples(ledger.entity_labels(spark, folder)).distinct())


@_query()
def o026_n_triples(spark, folder):
    return triples.n_triples(triples.label_triples(ledger.entity_labels(spark, folder)))


@_query("""with recursive e as (select distinct from_address as u, to_address as v from transaction_facts where to_address is not null and from_address <> to_address
        and from_address in (select address from entity_labels) and to_address in (select address from entity_labels)),
      b as (select u, v from e union select v, u from e), r as (select u, u as v from b union select r.u, b.v from r join b on r.v = b.u)
    select u as node, min(v) as component from r group by u""")
def graph_components(spark, folder):
    known = ledger.entity_labels(spark, folder).select("address")
    facts = ledger.transaction_facts(spark, folder, START, END).where("to_address is not null and from_address <> to_address")
    own = facts.join(known.withColumnRenamed("address", "from_address"), "from_address", "left_semi").join(known.withColumnRenamed("address", "to_address"), "to_address", "left_semi")
    return components.connected_components(own.select("from_address", "to_address"), "from_address", "to_address")


# --- streaming extra

@_query("""select cast(date_trunc('day', ts) as varchar) as window_start, event_type, count(*) as events, round(sum(value), 6) as total from events where ts is not null and event_type is not null group by 1, 2""")
def stream_event_windows(spark, folder):
    return events.run_available(spark, folder).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "events", F.round("total", 6).alias("total"))
