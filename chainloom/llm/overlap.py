"""Problem 5: training records that recur, exactly or nearly, in evaluation data.

Texts are first brought to a canonical body: one spelling of look-alikes, lower
case, no accents, framing phrases ("please tell me:", "thanks!") removed, a short
list of interchangeable wordings unified.  Values (addresses, dates, numbers)
leave the body as ``#`` and form the *signature*, which has to be equal: another
value makes another question.  Words written in capitals (symbols) stay strict.

Distinct (signature, body) strings are then joined by edit distance; the k edits
allowed grow with an evaluation string's length.  It is cut into k+1 segments; within k edits at least one segment
survives in a training string, and only at few positions (the multi-match-aware
windows), so both sides meet on (signature, length, segment number, segment).
Candidates are verified by banded dynamic programming and word by word: a changed
word must be a typo, not another common word or symbol, and only filler words may
be put in or left out.  Another wording that no list unifies isn't found by text.

Queries (gold_sql) meet on a canonical statement: layout, letter case, quoting
and output names are abstracted, values are kept.

Copies collapse before anything is joined and are expanded only in the result.
The only broadcast is the set of common words: words that occur in at least one
of 1000 distinct texts, hence at most 1000 times the words of a mean text.

Defined results: null and empty texts and queries match nothing; texts of any
length are used whole; extra columns are left aside.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from chainloom.functions.strings import banded_distance, segments, windows
from chainloom.llm.glyphs import consistent
from chainloom.llm.pairs import _KEYWORDS, _SQL_TOKEN, bare
from chainloom.sources.checkpoints import stored

#: Edits allowed between canonical bodies: so many, in longer ones one for so many characters.
EDITS, EDIT_SPAN = 4, 12
#: A word of at least this share of the distinct texts is common.
COMMON = 0.001
#: A word of so many letters is a slip where a word one slip away is so many times as frequent.
SLIP_LENGTH, SLIP_RATIO = 5, 10

# Phrases that frame a question (lower case, no accents).
FRAMES = (
    "please tell me", "i need to know", "quick question", "tell me", "can you tell me", "could you tell me", "hi", "hello", "hey", "question",
    "q", "please", "kindly", "lam on", "xin cho biet", "minh can biet", "cho hoi", "cho toi hoi", "cau hoi", "xin hoi", "vui long", "chao ban",
)
CLOSINGS = ("thanks", "thank you", "please", "utc", "gio utc", "keep it short", "tra loi ngan gon", "cam on", "cam on ban", "many thanks", "a")
# Wordings that ask the same.
SAME_WORDING = (
    ("txns", "transactions"), ("txs", "transactions"), ("txn", "transaction"), ("tx", "transaction"), ("acct", "account"), ("accts", "accounts"),
    ("addr", "address"), ("in the period", ""), ("until", "to"), ("till", "to"), ("latest", "most recent"), ("newest", "most recent"),
    ("what", "which"), ("display", "show"), ("give", "list"), ("biggest", "largest"), ("report", "return"), ("gd", "giao dich"), ("tk", "tai khoan"),
    ("giai doan", "khoang"), ("gan day nhat", "moi nhat"), ("bang bao nhieu", "la bao nhieu"), ("cho xem", "hien thi"), ("neu ra", "liet ke"),
    ("wallet", "account"), ("wallets", "accounts"), ("distinct", "different"), ("overall", "total"), ("avg", "average"), ("what number of", "how many"),
    ("sl", "so luong"), ("dc", "dia chi"), ("ko", "khong"),
)
_PHRASES = {tuple(a.split()): b.split() for a, b in SAME_WORDING}
_LONGEST = max(map(len, _PHRASES))
_FRAMES = frozenset(tuple(x.split()) for x in FRAMES)
_CLOSINGS = frozenset(tuple(x.split()) for x in CLOSINGS)
# Longer words of those phrases: a typo in them would hide the phrase.
_PHRASE_WORDS = frozenset(w for x in (*FRAMES, *CLOSINGS, *(a for a, _ in SAME_WORDING)) for w in x.split() if len(w) >= 5)
# Ordinary words that are one slip away from one of them.
_KNOWN = frozenset(w for x in (*FRAMES, *CLOSINGS, *(y for pair in SAME_WORDING for y in pair)) for w in x.split()) | frozenset(
    "least last late test reports quickly sort shot shirt than think thank pleased".split()
)
_FILLERS = frozenset("please thanks the a an of hi q me us our just also simply kindly now".split())
_PIECE = re.compile(r"0x[0-9a-fA-F]+|\d{4}-\d\d?-\d\d?|\d\d?/\d\d?/\d{4}|\d[\d.,]*\d|\d|[^\W\d_]+(?:'[^\W\d_]+)?|[Ξ$€%]")


def allowed(length: int, k: int = EDITS) -> int:
    """Edits allowed for an evaluation body of a length; at least ``k``."""
    return max(k, length // EDIT_SPAN)


def trained_lengths(own: int, k: int = EDITS) -> list[int]:
    """Lengths of the evaluation bodies that a training body of a length can meet."""
    most = allowed(own, k)
    while allowed(own + most, k) > most:
        most = allowed(own + most, k)
    return [n for n in range(max(1, own - most), own + most + 1) if abs(n - own) <= allowed(n, k)]


def _edits(word: str) -> set[str]:
    """Strings that one deletion makes of a word."""
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


_NEAR_PHRASE_WORDS: dict[str, set[str]] = {}
for _word in sorted(_PHRASE_WORDS):
    for _form in {_word, *_edits(_word)}:
        _NEAR_PHRASE_WORDS.setdefault(_form, set()).add(_word)


@lru_cache(maxsize=100_000)
def _phrase_word(word: str) -> str:
    """The phrase word that is one slip away from a word, else the word."""
    if word in _KNOWN or len(word) < 4:
        return word
    near = {w for form in {word, *_edits(word)} for w in _NEAR_PHRASE_WORDS.get(form, ())}
    near = {w for w in near if banded_distance(word, w, 1) <= 1 or (sorted(word) == sorted(w) and sum(x != y for x, y in zip(word, w)) == 2)}
    return min(near) if near else word


def canonical_question(text: str | None) -> tuple[str, str] | None:
    """(signature, body) of a text; None without letters or digits."""
    if not text:
        return None
    shown = consistent(text)
    shouted = shown.upper() == shown
    words: list[tuple[str, bool]] = []
    for piece in _PIECE.findall(shown):
        if piece[0].isdigit():
            value = piece.lower()
            date = re.fullmatch(r"(\d\d?)/(\d\d?)/(\d{4})", value) or re.fullmatch(r"(\d{4})-(\d\d?)-(\d\d?)", value)
            if date:
                a, b, c = date.groups()
                value = f"{a}-{b:0>2}-{c:0>2}" if len(a) == 4 else f"{c}-{b:0>2}-{a:0>2}"
            elif not value.startswith("0x"):
                value = re.sub(r"[.,](?=\d{3}\b)", "", value)
            words.append((value, True))
        else:
            low = bare(piece)
            words.append(("$" + low if not shouted and len(piece) > 1 and piece.isupper() else _phrase_word(low), False))
    plain = lambda part: tuple(w.lstrip("$") for w, _ in part)
    changed = True
    while changed:
        changed = False
        for n in range(min(4, len(words) - 1), 0, -1):
            if plain(words[:n]) in _FRAMES:
                words, changed = words[n:], True
                break
        for n in range(min(4, len(words) - 1), 0, -1):
            if plain(words[-n:]) in _CLOSINGS:
                words, changed = words[:-n], True
                break
    body, values, i = [], [], 0
    while i < len(words):
        word, is_value = words[i]
        if is_value:
            values.append(word)
            body.append("#")
            i += 1
            continue
        for n in range(min(_LONGEST, len(words) - i), 0, -1):
            same = _PHRASES.get(plain(words[i : i + n]))
            if same is not None:
                body.extend(same)
                i += n
                break
        else:
            body.append(word)
            i += 1
    return (" ".join(values), " ".join(body)) if body else None


_NAME = re.compile(r"[a-z_]\w*$")
# Words that go on with an expression.
_GO_ON = frozenset("over filter within partition rows range collate interval year month week day hour minute second escape div mod similar ilike".split())


def canonical_statement(sql: str | None) -> str | None:
    """A statement without layout, letter case, quoting and output names, whether
    these are given with AS or without it."""
    if not sql:
        return None
    out, names, previous, listing, depth = [], {}, "", [], 0
    for tok in _SQL_TOKEN.findall(consistent(sql.replace("\n", "\x01")).replace("\x01", "\n")):
        low = tok.lower()
        if tok.startswith("--") or tok == ";":
            continue
        if len(tok) > 1 and tok[0] in "'\"" and tok[-1] == tok[0]:
            low = "'" + low[1:-1] + "'"
        elif tok[0] == "`":
            low = low.strip("`")
        depth += (low == "(") - (low == ")")
        if low == "select":
            listing.append(depth)
        elif low == "from" and listing and listing[-1] == depth:
            listing.pop()
        # right behind an expression of the list: an output name without AS
        bare_name = listing and listing[-1] == depth and _NAME.match(low.strip("'\"")) and low not in _KEYWORDS and low not in _GO_ON and previous not in _GO_ON
        ends_expression = previous in (")", "end") or (previous not in _KEYWORDS and _NAME.match(previous.rsplit(".", 1)[-1]))
        if (previous == "as" and low.strip("'") not in _KEYWORDS) or (bare_name and ends_expression):
            if out and out[-1] == "as":
                out.pop()
            out.append("as")
            low = names.setdefault(low.strip("'"), f"@{len(names)}")
        elif low in names:
            low = names[low]
        out.append(low)
        previous = low if low[0] != "@" else ""
    return " ".join(out) or None


def is_typo(a: str, b: str, common: frozenset[str]) -> bool:
    """Whether two different words are one word typed differently."""
    if a[0] in "$#" or b[0] in "$#":
        return a.lstrip("$") == b.lstrip("$")
    if (a in common and b in common) or min(len(a), len(b)) < 3:
        return False
    if sorted(a) == sorted(b) and sum(x != y for x, y in zip(a, b)) == 2:
        return True
    size = min(len(a), len(b))
    return banded_distance(a, b, 2) <= (2 if size >= 7 else 1)


def same_question(a: str, b: str, common: frozenset[str], k: int = EDITS) -> bool:
    """Verification of a training and an evaluation body with equal signatures:
    within the edits allowed, every changed word a typo, only fillers put in."""
    most = allowed(len(b), k)
    if banded_distance(a, b, most) > most:
        return False
    left, right = a.split(), b.split()
    for op, i1, i2, j1, j2 in difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        x, y = left[i1:i2], right[j1:j2]
        if len(x) != len(y) and "".join(x) != "".join(y):
            x, y = ([w for w in part if w not in _FILLERS] for part in (x, y))
        if len(x) == len(y):
            if not all(p == q or is_typo(p, q, common) for p, q in zip(x, y)):
                return False
        elif "".join(x) != "".join(y):
            return False
    return True


def _canonical(texts: DataFrame) -> DataFrame:
    """(key, side, text) -> (key, side, signature, body)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [canonical_question(t) for t in batch["text"]]
            keep = [f is not None for f in found]
            out = batch.loc[keep, ["key", "side"]].copy()
            out["signature"] = [f[0] for f in found if f]
            out["body"] = [f[1] for f in found if f]
            yield out

    return texts.where("text is not null").select("key", "side", "text").mapInPandas(run, "key string, side string, signature string, body string")


def _segment_keys(strings: DataFrame, side: str, k: int) -> DataFrame:
    """(signature, body) -> (meet, id, body): the keys on which both sides meet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, sig, body in zip(batch["id"], batch["signature"], batch["body"]):
                own = len(body)
                if side == "eval":
                    keys = {f"{own}|{i}|{body[s : s + n]}" for i, (s, n) in enumerate(segments(own, allowed(own, k)))}
                else:
                    keys = {
                        f"{length}|{i}|{body[s : s + n]}"
                        for length in trained_lengths(own, k)
                        for i, s, n in windows(own, length, allowed(length, k))
                    }
                rows += [(sig, key, name) for key in keys]
            yield pd.DataFrame(rows, columns=["signature", "segment", "id"])

    keyed = strings.select("id", "signature", "body").mapInPandas(run, "signature string, segment string, id bigint")
    return keyed.select(F.xxhash64("signature", "segment").alias("meet"), F.col("id").alias(f"{side}_id"))


def near_classes(train: DataFrame, evals: DataFrame, common: frozenset[str], k: int = EDITS) -> DataFrame:
    """Inputs (id, signature, body), unique; output (train_id, eval_id): equal
    signatures and bodies within the edits allowed (at least k) that ask the same."""
    exact = train.select(F.col("id").alias("train_id"), "signature", "body").join(
        evals.select(F.col("id").alias("eval_id"), "signature", "body"), ["signature", "body"]
    )
    # Only strings whose signature is on the other side can have a partner.
    near_train = train.join(evals.select("signature").distinct(), "signature", "left_semi")
    near_evals = evals.join(train.select("signature").distinct(), "signature", "left_semi")
    met = _segment_keys(near_train, "train", k).join(_segment_keys(near_evals, "eval", k), "meet").select("train_id", "eval_id").distinct()
    candidates = (
        met.join(near_train.select(F.col("id").alias("train_id"), F.col("signature").alias("ts"), F.col("body").alias("a")), "train_id")
        .join(near_evals.select(F.col("id").alias("eval_id"), F.col("signature").alias("es"), F.col("body").alias("b")), "eval_id")
        .where("ts = es and a <> b")
    )
    shared = train.sparkSession.sparkContext.broadcast(common)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [same_question(a, b, shared.value, k) for a, b in zip(batch["a"], batch["b"])]
            yield batch.loc[good, ["train_id", "eval_id"]]

    near = candidates.select("train_id", "eval_id", "a", "b").mapInPandas(verify, "train_id bigint, eval_id bigint")
    return exact.select("train_id", "eval_id").unionByName(near)


def slips(counts: dict[str, int]) -> set[str]:
    """Words that are one slip away from a far more frequent word.  Shorter words
    are left out: one slip there often makes another ordinary word."""
    forms: dict[str, list[str]] = {}
    for word in counts:
        if len(word) >= SLIP_LENGTH - 1:
            for form in {word, *_edits(word)}:
                forms.setdefault(form, []).append(word)
    found = set()
    for word, n in counts.items():
        if len(word) >= SLIP_LENGTH:
            near = {w for form in {word, *_edits(word)} for w in forms.get(form, ()) if counts[w] >= SLIP_RATIO * n}
            if any(banded_distance(word, w, 1) <= 1 or (sorted(word) == sorted(w) and sum(x != y for x, y in zip(word, w)) == 2) for w in near):
                found.add(word)
    return found


def common_words(strings: DataFrame, share: float = COMMON) -> frozenset[str]:
    """Input distinct (signature, body); words of at least ``share`` of them and
    of two bodies, but no slips; at most (words of a mean text) / share.

    Copies of a text count once and one body never makes a word common, whatever
    its values, so a mistyped text may be repeated at will.
    """
    total = strings.count()
    words = strings.select("body", F.explode(F.array_distinct(F.split("body", " "))).alias("word")).where("word not like '$%' and word <> '#'")
    bodies = words.groupBy("word", "body").agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("bodies"))
    found = bodies.where(F.col("n") >= share * total).collect()
    wrong = slips({r["word"]: r["n"] for r in found})
    return frozenset(r["word"] for r in found if r["bodies"] >= 2 and r["word"] not in wrong)


def evaluation_texts(cases: DataFrame, held_out: DataFrame) -> DataFrame:
    """(key, side, text, split, source) of all questions; side is train or eval."""
    split = F.lower(F.trim("split"))
    own = cases.where("case_id is not null").select(
        F.col("case_id").alias("key"),
        F.when(split == "train", "train").when(split.isin("validation", "test"), "eval").alias("side"),
        F.col("question").alias("text"), split.alias("split"), F.coalesce("source", F.lit("")).alias("source"),
    )
    theirs = held_out.where("name is not null").select("name", F.posexplode("questions").alias("pos", "text")).select(
        F.concat_ws("#", "name", "pos").alias("key"), F.lit("eval").alias("side"), "text", F.lit("held_out").alias("split"), F.col("name").alias("source")
    )
    return own.where("side is not null").unionByName(theirs)


@F.pandas_udf(StringType())
def _statements(sql: pd.Series) -> pd.Series:
    return sql.map(canonical_statement).astype(object)


def overlap_classes(cases: DataFrame, held_out: DataFrame, k: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """(train_class, eval_class) links and (key, side, class) members.  Copies of a
    text or of a statement are one class; a text is near to others' classes, a
    statement's class only meets itself."""
    texts = evaluation_texts(cases, held_out)
    canon = stored(_canonical(texts.select("key", "side", "text")))
    strings = stored(
        canon.groupBy("signature", "body").agg(F.max(F.col("side") == "train").alias("in_train"), F.max(F.col("side") == "eval").alias("in_eval"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    near = near_classes(strings.where("in_train").select("id", "signature", "body"), strings.where("in_eval").select("id", "signature", "body"), common_words(strings.select("signature", "body")), k)
    class_ = lambda c: F.concat(F.lit("t"), F.col(c).cast("string"))
    by_text = canon.join(strings.select("id", "signature", "body"), ["signature", "body"]).select("key", "side", class_("id").alias("class"))
    side = F.when(F.lower(F.trim("split")) == "train", "train").when(F.lower(F.trim("split")).isin("validation", "test"), "eval")
    asked = cases.where("case_id is not null and gold_sql is not null").select(F.col("case_id").alias("key"), side.alias("side"), "gold_sql").where("side is not null")
    by_query = stored(asked.select("key", "side", F.concat(F.lit("q"), F.sha2(_statements("gold_sql"), 256)).alias("class")).where("class is not null"))
    both = by_query.groupBy("class").agg(F.count_distinct("side").alias("sides")).where("sides = 2").select(F.col("class").alias("train_class"), F.col("class").alias("eval_class"))
    links = near.select(class_("train_id").alias("train_class"), class_("eval_id").alias("eval_class")).unionByName(both)
    return stored(links), by_text.unionByName(by_query)


def _side(members: DataFrame, side: str) -> DataFrame:
    return members.where(F.col("side") == side).select(F.col("class").alias(f"{side}_class"), F.col("key").alias(f"{side}_key"))


def overlap_pairs(cases: DataFrame, held_out: DataFrame, k: int = EDITS) -> DataFrame:
    """Output (train_key, eval_key), unique: the overlaps by text or by query."""
    links, members = overlap_classes(cases, held_out, k)
    pairs = links.join(_side(members, "train"), "train_class").join(_side(members, "eval"), "eval_class")
    return pairs.select("train_key", "eval_key").distinct()


def overlap_found(cases: DataFrame, held_out: DataFrame) -> DataFrame:
    """Output (key_a, key_b), the smaller key first."""
    pairs = overlap_pairs(cases, held_out)
    return pairs.select(F.least("train_key", "eval_key").alias("key_a"), F.greatest("train_key", "eval_key").alias("key_b"))


def overlap_report(cases: DataFrame, held_out: DataFrame) -> DataFrame:
    """Output (split, source, records, overlapping, train_records): per evaluation
    split and source, how many records recur in training and how many training
    records they recur in.  Classes are linked, never all of their members."""
    texts = evaluation_texts(cases, held_out).where("side = 'eval'").select(F.col("key").alias("eval_key"), "split", "source")
    links, members = overlap_classes(cases, held_out)
    placed = texts.join(_side(members, "eval"), "eval_key").join(links, "eval_class")
    hit = placed.select("eval_key").distinct().withColumn("links", F.lit(1))
    met = placed.select("split", "source", "train_class").distinct().join(_side(members, "train"), "train_class")
    trained = met.select("split", "source", "train_key").distinct().groupBy("split", "source").agg(F.count("*").alias("train_records"))
    counts = texts.join(hit, "eval_key", "left").groupBy("split", "source").agg(F.count("*").alias("records"), F.count("links").alias("overlapping"))
    return counts.join(trained, ["split", "source"], "left").select("split", "source", "records", "overlapping", F.coalesce("train_records", F.lit(0)).alias("train_records"))
