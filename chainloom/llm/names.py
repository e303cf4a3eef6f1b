"""Problem 4: variant spellings of names typed by people.

Every name of a record (owner, label without its role, aliases) is parsed into a
*core* (surname or invented word), first name, initials, organisation type and
further words.  Nicknames, abbreviations, titles, legal forms, order, accents and
joined spellings are resolved there; which words are common (adjectives, unlisted
first names) is learned from how many different words stand beside them.  A
record whose words are all common has the least common one as its core, so no
record is left without one for being frequent.

Cores are linked by metric-space partitioning under the (unrestricted)
Damerau-Levenshtein metric with radius 1.  Pivots are cores themselves: those
that several rows spell alike, and every core that is further than 1 from all of
these.  A core belongs to the cell of its nearest pivot; by the triangle
inequality whatever is within the radius of a member is within (radius of the
cell + 1) of its pivot, so exactly the cores up to there are replicated into the
cell, and an exact radius join inside each cell loses no link.  Pivots near a core
are found through the strings that both become by deletions.  (Few sampled pivots
don't work here: between invented words nearly all distances are 7 or 8, so each
word would have to be replicated to most cells.  See the README.)

A link between cores must agree in what else is known (first name or type and
adjective) and one side must be rare: two frequent cores are two families.
Linked cores form clusters; inside a cluster records are told apart by first
name, middle initial, type and adjective.  A record that fits several persons of
a family stays unlinked.

Sizes: the common words are broadcast; a word is common with at least 1/500 of all
distinct word pairs, so there are at most 1000.  Copies of a profile
collapse before anything is grouped by cluster.

Defined results: null, empty and uninformative names say nothing; a record
without an informative name is linked to none; a null owner differs from any.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from chainloom.functions.strings import segments, windows
from chainloom.llm.glyphs import consistent
from chainloom.operators.components import connected_components
from chainloom.sources.checkpoints import stored

# Roles of addresses in labels.
ROLES = ("fee collector", "hot wallet", "cold storage", "cold wallet", "router", "vault", "multisig", "treasury", "deployer", "payout", "wallet")
NOTHING = frozenset("unlabelled unlabeled unknown unnamed none null n/a na other misc test anonymous".split())
# Legal forms, titles and small words that tell nothing apart.
LEGAL = frozenset("ltd limited inc incorporated corp corporation co company gmbh ag sa sarl llc llp plc bv nv oy ab kg spa pty".split())
TITLES = frozenset("dr prof mx mr mrs ms miss sir dame capt captain rev hon herr frau jr sr phd".split())
SMALL = frozenset("the of and de la le van von der group holding holdings".split())
# Organisation types and how they are shortened.
TYPES = {
    "finance": "fin finanz financial finances", "laboratories": "lab labs laboratory", "foundation": "fdn fndn found foundations stiftung",
    "markets": "mkt mkts market", "network": "net ntwk netw networks", "bridge": "brg brdg bridges", "capital": "cap capitals",
    "exchange": "exch xchange exchanges", "custody": "cust custodial custodian", "protocol": "prot proto protocols",
}
# Nicknames of first names.
NICKNAMES = {
    "alexander": "alex sasha sandy lex", "yevgenia": "evgenia zhenya eugenia", "johannes": "hannes jan johann hans", "robert": "bob bobby rob robbie bert",
    "joseph": "joe joey jo", "katherine": "kate kathy katie catherine kathryn kat", "thomas": "tom tommy", "francisco": "paco pancho frank curro",
    "william": "bill will billy willy liam", "richard": "dick rick ricky rich", "gabrielle": "gaby gabi", "margaret": "peggy maggie meg marge",
    "cornelia": "connie nele", "nicholas": "nick nico nicolas niko", "ursula": "ulla uschi", "victoria": "tori vicky vicki", "heinrich": "heinz heiner henry",
    "daniel": "dan danny", "oliver": "ollie noll", "elizabeth": "betty beth liz lizzy eliza elisabeth", "michael": "mike mick", "james": "jim jimmy jamie",
    "john": "jack johnny", "charles": "charlie chuck", "edward": "ed eddie ted", "anthony": "tony", "susan": "sue susie", "patricia": "pat patty tricia",
    "samuel": "sam", "benjamin": "ben", "jennifer": "jen jenny", "christopher": "chris", "matthew": "matt", "andrew": "andy drew", "stephen": "steve steven",
    "dorothy": "dot dottie", "theodore": "theo", "rebecca": "becky", "deborah": "debbie", "lawrence": "larry", "ronald": "ron", "peter": "pete",
}
_TYPE_OF = {form: name for name, forms in TYPES.items() for form in (name, *forms.split())}
_FIRST_OF = {form: name for name, forms in NICKNAMES.items() for form in (name, *forms.split())}
_ROLE = re.compile(r"\b(?:" + "|".join(ROLES) + r")\b\s*\d*", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
#: A word is common with this share of all distinct pairs of words in a name, and at least so many partners.
COMMON_SHARE, COMMON_PARTNERS = 1 / 500, 4
#: Partners that begin alike are spellings of one word.
PARTNER_PREFIX = 3
#: A common word so many times as common makes a word within 1 of it a typing error.
SLIP_RATIO = 3
#: Radius of the join and of the cells; rows that make a spelling a pivot.
RADIUS, CELL_RADIUS, PIVOT_SUPPORT = 1, 1, 3
#: Cores up to this length meet on deletions, longer ones on segments.
LONGEST_CUT = 24
#: Shortest core of an organisation and of a person.
ORG_CORE, PERSON_CORE = 7, 4
#: Begins the cores of records that have shorter ones only; they link to equal ones.
SHORT, SHORT_ALONE = "=", 4


def _flat(text: str) -> str:
    text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", unicodedata.normalize("NFKD", consistent(text)).replace("đ", "d").replace("ß", "ss"))
    return unicodedata.normalize("NFC", re.sub("[̀-ͯ]", "", text)).lower()


def words_of(name: str | None, is_label: bool = False) -> list[str]:
    """Words of a name in lower case, without roles, legal forms and titles."""
    if not name:
        return []
    text = consistent(name)
    if is_label:
        text = _ROLE.sub(" ", text)
    flat = re.sub(r"\bg\W{0,2}m\W{0,2}b\W{0,2}h\b", "gmbh", _flat(text))
    if flat.strip(" .-_:()") in NOTHING:
        return []
    out = []
    for word in _LETTERS.findall(flat):
        for name_of_type in TYPES:  # a type written onto the word before it
            if word.endswith(name_of_type) and len(word) >= len(name_of_type) + 4:
                out += [word[: -len(name_of_type)], name_of_type]
                break
        else:
            out.append(word)
    return [w for w in out if w not in LEGAL and w not in TITLES and w not in SMALL and w not in NOTHING]


def within_one(a: str, b: str) -> bool:
    """Damerau-Levenshtein distance at most 1."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    if len(a) > len(b):
        a, b = b, a
    return a[i:] == b[i + 1 :]


def damerau(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance, a true metric."""
    far, last = len(a) + len(b), {}
    table = [[far] * (len(b) + 2)] + [[far, i] + [0] * len(b) for i in range(len(a) + 1)]
    table[1][1:] = range(len(b) + 1)
    for i, x in enumerate(a, 1):
        at = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), at
            if x == y:
                at = j
            table[i + 1][j + 1] = min(
                table[i][j] + (x != y), table[i + 1][j] + 1, table[i][j + 1] + 1, table[k][m] + (i - k - 1) + 1 + (j - m - 1)
            )
        last[x] = i
    return table[-1][-1]


def _cut(word: str, times: int) -> set[str]:
    """The word and what up to ``times`` deletions make of it."""
    out, last = {word}, {word}
    for _ in range(times):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out |= last
    return out


class Neighbours:
    """Known words within a small Damerau-Levenshtein distance of a word: both
    sides meet on common deletions and are then verified."""

    def __init__(self, known: dict[str, str], distance: int, shortest: int):
        self.known, self.distance, self.forms = known, distance, {}
        for word in sorted(known):
            if len(word) >= shortest:
                for form in _cut(word, distance):
                    self.forms.setdefault(form, []).append(word)

    def of(self, word: str) -> list[str]:
        near = {w for form in _cut(word, self.distance) for w in self.forms.get(form, ())}
        if self.distance == 1:
            near = {w for w in near if within_one(w, word)}
        else:
            near = {w for w in near if damerau(w, word) <= self.distance}
        return sorted({self.known[w] for w in near})


_NEAR_TYPES, _NEAR_FIRSTS = Neighbours(_TYPE_OF, 1, 4), Neighbours(_FIRST_OF, 1, 4)
_LONG = {w: w for w in TYPES if len(w) >= 7} | {w: _FIRST_OF[w] for w in NICKNAMES if len(w) >= 7}
_NEAR_LONG = Neighbours(_LONG, 2, 7)
_PARSERS: dict[frozenset[str], Parser] = {}


class Parser:
    """Parses names, given the common words with their numbers of partners."""

    def __init__(self, common: dict[str, int]):
        self.common = common
        self.near_common = Neighbours({w: w for w in common}, 1, 4)
        self.resolve = lru_cache(maxsize=300_000)(self._resolve)

    @staticmethod
    def of(common: dict[str, int]) -> Parser:
        """One parser a worker, so that its memory outlives a task."""
        key = frozenset(common.items())
        if key not in _PARSERS:
            _PARSERS.clear()
            _PARSERS[key] = Parser(common)
        return _PARSERS[key]

    def _resolve(self, word: str) -> tuple[str, str]:
        """(kind, canonical word); kind: type, first, common, word."""
        if word in _TYPE_OF:
            return "type", _TYPE_OF[word]
        if word in _FIRST_OF:
            return "first", _FIRST_OF[word]
        if word in self.common:
            return "common", word
        if len(word) >= 4:
            for near, kind in ((_NEAR_TYPES, "type"), (_NEAR_FIRSTS, "first"), (self.near_common, "common")):
                found = near.of(word)
                if found:
                    return kind, found[0]
            if len(word) >= 7:
                found = _NEAR_LONG.of(word)
                if len(found) == 1:
                    return ("type" if found[0] in TYPES else "first"), found[0]
        return "word", word

    def settled(self, names: list[list[str]]) -> list[list[tuple[str, str, str]]]:
        """(kind, canonical, as typed) of the words of every name.  Where no word is
        left for a core, the least common one is it, and where there are only listed
        words, the ones that are merely near to a list ("Binance" to "finance")."""
        parsed = [[(*self.resolve(w), w) for w in words if len(w) > 1] for words in names]
        kinds = {kind for words in parsed for kind, _, _ in words}
        if "word" in kinds:
            return parsed
        if "common" in kinds:
            among = {w for words in parsed for kind, w, _ in words if kind == "common"}
            core = min(among, key=lambda w: (self.common[w], -len(w), w))
            return [[("word" if kind == "common" and w == core else kind, w, typed) for kind, w, typed in words] for words in parsed]
        listed = lambda typed: typed in _TYPE_OF or typed in _FIRST_OF
        return [[(kind, w, typed) if listed(typed) else ("word", typed, typed) for kind, w, typed in words] for words in parsed]

    def apart(self, words: list[str]) -> list[str]:
        """Words of which one is a common word written onto a core, in two."""
        out = []
        for word in words:
            cut = next((i for i in range(4, len(word) - ORG_CORE + 1) if word[:i] in self.common and word[:i] not in _FIRST_OF), 0)
            out += [word[:cut], word[cut:]] if cut and word not in self.common else [word]
        return out

    def record(self, owner: str | None, label: str | None, aliases) -> dict | None:
        """Profile of a record from all of its names; None without a core."""
        cores, firsts, letters, kinds, extras = Counter(), Counter(), Counter(), Counter(), Counter()
        names = [words_of(owner), words_of(label, True), *(words_of(a) for a in (aliases if aliases is not None else []))]
        person = False
        settled = self.settled([self.apart(words) for words in names])
        for words, parsed in zip(names, settled):
            initials = [w for w in words if len(w) == 1]
            found = [w for kind, w, _ in parsed if kind == "word"]
            first = [w for kind, w, _ in parsed if kind == "first"]
            types = [w for kind, w, _ in parsed if kind == "type"]
            person |= bool(first or initials) and not types
            cores.update(found)
            firsts.update(first)
            kinds.update(types)
            extras.update(w for kind, w, _ in parsed if kind == "common")
            if initials and found:
                letters[("f", first[0][0]) if first else ("f", initials[0])] += 1
                middle = initials if first else initials[1:]
                if middle:
                    letters[("m", middle[0])] += 1
        if kinds and not firsts:
            person = False
        least = PERSON_CORE if person else ORG_CORE
        strong = {w: n for w, n in cores.items() if len(w) >= least and not (w.endswith("io") and len(w) <= 8)}
        # A shorter form that begins like a longer one stands for it.
        strong = {w: n for w, n in strong.items() if not any(v != w and len(v) > len(w) + 1 and v[:4] == w[:4] for v in strong)}
        if not strong:
            return self._short(settled, firsts, letters, kinds, extras, person)
        main = max(strong, key=lambda w: (strong[w], len(w), w))
        same = sorted(w for w in strong if w == main or damerau(w, main) <= 3 or main.endswith(w[1:]) or w.endswith(main))
        top = lambda c: max(c, key=lambda k: (c[k], k)) if c else ""
        return {
            "core": main,
            "cores": same,
            "first": top(firsts) if person else "",
            "initial": (top(firsts)[:1] or top(Counter({k[1]: n for k, n in letters.items() if k[0] == "f"}))) if person else "",
            "middle": top(Counter({k[1]: n for k, n in letters.items() if k[0] == "m"})) if person else "",
            "type": "" if person else top(kinds),
            "extra": "" if person else top(extras),
            "person": person,
        }

    def _short(self, names: list[list[tuple[str, str, str]]], firsts: Counter, letters: Counter, kinds: Counter, extras: Counter, person: bool) -> dict | None:
        """Profile of a record that has short cores only: they are linked as they
        are, several words in any order, a single one of few letters only with a first
        name, type or adjective.  Labels name roles too, so only the owner and aliases count."""
        top = lambda c: max(c, key=lambda k: (c[k], k)) if c else ""
        spelled = [[w for kind, w, _ in words if kind == "word"] for words in (names[0], *names[2:])]
        short = next((sorted(set(words)) for words in spelled if words), [])
        initial = top(Counter({k[1]: n for k, n in letters.items() if k[0] == "f"}))
        fact = top(firsts) or initial if person else top(kinds) or top(extras)
        alone = len(short) == 1 and not fact
        if not short or (alone and (short[0].endswith("io") or (short[0].isascii() and len(short[0]) < SHORT_ALONE))):
            return None
        core = SHORT + " ".join(short)
        return {
            "core": core, "cores": [core], "first": top(firsts) if person else "", "initial": (top(firsts)[:1] or initial) if person else "",
            "middle": top(Counter({k[1]: n for k, n in letters.items() if k[0] == "m"})) if person else "",
            "type": "" if person else top(kinds), "extra": "" if person else top(extras), "person": person,
        }


def common_words(records: DataFrame, share: float = COMMON_SHARE) -> dict[str, int]:
    """Words with many different partners, and how many; at most 2 / share of them.
    Types and first names are no partners, and partners that begin alike are one, so
    a surname isn't common for its bearers' nicknames or for typing errors beside it."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser.of({})
        for batch in batches:
            found = set()
            for owner, label, aliases in zip(batch["owner"], batch["primary_label"], batch["aliases"]):
                for words in (words_of(owner), words_of(label, True), *(words_of(a) for a in (aliases if aliases is not None else []))):
                    kept = sorted({w for w in words if len(w) >= 4 and parser.resolve(w)[0] == "word"})
                    found.update((a, b[:PARTNER_PREFIX]) for a in kept for b in kept if a != b)
            yield pd.DataFrame(sorted(found), columns=["word", "partner"])

    distinct = stored(records.select("owner", "primary_label", "aliases").mapInPandas(pairs, "word string, partner string").distinct())
    least = max(float(COMMON_PARTNERS), share * distinct.count() / 2)
    partners = distinct.groupBy("word").count().where(F.col("count") >= least)
    found = {r["word"]: r["count"] for r in partners.select("word", "count").collect()}
    # A typing error of a far more common word is no word of its own.
    near = Neighbours({w: w for w in found}, 1, 4)
    return {w: n for w, n in found.items() if all(SLIP_RATIO * n > found[v] for v in near.of(w))}


_PROFILE = "address string, core string, cores array<string>, first string, initial string, middle string, type string, extra string, person boolean"


def record_profiles(records: DataFrame, common: dict[str, int]) -> DataFrame:
    """(address, profile columns) of the records that have a core."""
    shared = records.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = Parser.of(shared.value)
        for batch in batches:
            rows = []
            for address, owner, label, aliases in zip(batch["address"], batch["owner"], batch["primary_label"], batch["aliases"]):
                profile = parser.record(owner, label, aliases)
                if profile:
                    rows.append({"address": address} | profile)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PROFILE.split(", ")])

    return records.select("address", "owner", "primary_label", "aliases").mapInPandas(run, _PROFILE)


def _meeting_keys(words: DataFrame, edits: int, probe: bool) -> DataFrame:
    """(core) -> (meet, core): two words within ``edits`` of each other share a key.
    Short words meet on what up to ``edits`` deletions leave of them, long ones on
    segments; words around the limit have both kinds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, names = [], []
            for word in batch["core"]:
                own, found = len(word), set()
                if own <= LONGEST_CUT:
                    found |= _cut(word, edits)
                # one transposition may take two edits of the segment scheme
                if own > LONGEST_CUT - edits and not probe:
                    found |= {f"{own}|{i}|{word[s : s + n]}" for i, (s, n) in enumerate(segments(own, 2 * edits))}
                if own > LONGEST_CUT - 2 * edits and probe:
                    found |= {f"{m}|{i}|{word[s : s + n]}" for m in range(own - edits, own + edits + 1) for i, s, n in windows(own, m, 2 * edits)}
                keys += found
                names += [word] * len(found)
            yield pd.DataFrame({"key": keys, "core": names})

    return words.select("core").mapInPandas(run, "key string, core string").select(F.xxhash64("key").alias("meet"), "core")


@F.pandas_udf(IntegerType())
def _distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else damerau(x, y) for x, y in zip(a, b)], dtype="Int32")


def _within(pairs: DataFrame, a: str, b: str, edits: int) -> DataFrame:
    """Pairs at most ``edits`` apart, with ``d``.  The JVM's bounded Levenshtein
    distance settles all but those in which a transposition can make a difference:
    with one, both words hold nearly the same letters."""
    letters = lambda c: F.array_sort(F.split(F.col(c), ""))
    near = pairs.withColumn("lev", F.levenshtein(a, b, 2 * edits)).where("lev >= 0")
    # t transpositions and e other edits: Levenshtein 2 t + e, distance t + e; so few e are possible
    others = F.when(F.col("lev") > edits, 2 * edits - F.col("lev")).otherwise(F.col("lev") - 2)
    swapped = (F.col("lev") >= 2) & F.when(others == 0, letters(a) == letters(b)).otherwise(F.abs(F.length(a) - F.length(b)) <= others)
    asked = near.where((F.col("lev") <= edits) | swapped).withColumn("swapped", swapped)
    d = F.coalesce(_distance(F.when(F.col("swapped"), F.col(a)), F.col(b)), F.col("lev"))
    return asked.withColumn("d", d).where(F.col("d") <= edits).drop("lev", "swapped")


def _near_pivots(cores: DataFrame, pivots: DataFrame, edits: int) -> DataFrame:
    """(core, pivot, d) of all cores and pivots at most ``edits`` apart."""
    left = _meeting_keys(cores, edits, True)
    right = _meeting_keys(pivots, edits, False).withColumnRenamed("core", "pivot")
    met = left.join(right, "meet").select("core", "pivot").distinct()
    return _within(met, "core", "pivot", edits)


def metric_cells(cores: DataFrame) -> DataFrame:
    """Input (core, support), unique; output (pivot, core, home): every core at home
    in the cell of its nearest pivot and replicated to the cells whose members can
    be within RADIUS of it."""
    frequent = cores.where(F.col("support") >= PIVOT_SUPPORT).select("core")
    near = stored(_near_pivots(cores, frequent, CELL_RADIUS + RADIUS))
    homes = near.groupBy("core").agg(F.min(F.struct("d", "pivot")).alias("h")).where(F.col("h.d") <= CELL_RADIUS).select("core", F.col("h.pivot").alias("pivot"), F.col("h.d").alias("d"))
    radius = homes.groupBy("pivot").agg(F.max("d").alias("radius"))
    kept = near.join(radius, "pivot").where(F.col("d") <= F.col("radius") + RADIUS).select("pivot", "core")
    # Cores far from all of these are pivots of cells of their own, with radius 0.
    alone = stored(cores.select("core").join(homes.select("core"), "core", "left_anti"))
    around = _near_pivots(cores, alone, RADIUS).select("pivot", "core")
    home = homes.select("pivot", "core").unionByName(alone.select(F.col("core").alias("pivot"), "core")).withColumn("home", F.lit(True))
    return kept.unionByName(around).join(home, ["pivot", "core"], "left").withColumn("home", F.coalesce("home", F.lit(False)))


def radius_join(cores: DataFrame) -> DataFrame:
    """(core, support) unique -> (a, b), a < b, of all cores within RADIUS of each
    other.  Without a support every core is a pivot of its own."""
    if "support" not in cores.columns:
        cores = cores.withColumn("support", F.lit(1))
    cells = stored(metric_cells(cores))
    pairs = (
        cells.where("home").select("pivot", F.col("core").alias("x"))
        .join(cells.select("pivot", F.col("core").alias("y")), "pivot")
        .where("x <> y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    return _within(pairs, "a", "b", RADIUS).select("a", "b")


def core_clusters(profiles: DataFrame) -> DataFrame:
    """(core, cluster) of all cores, linked within radius 1 and within records."""
    spelled = profiles.select("address", F.explode("cores").alias("core"), "first", "initial", "type", "extra")
    known = stored(
        spelled.groupBy("core").agg(
            F.count("*").alias("support"),
            F.array_remove(F.collect_set("first"), "").alias("firsts"),
            F.array_remove(F.collect_set("initial"), "").alias("initials"),
            F.array_remove(F.collect_set("type"), "").alias("types"),
            F.array_remove(F.collect_set("extra"), "").alias("extras"),
        )
    )
    side = lambda x: known.select(F.col("core").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in ("support", "firsts", "initials", "types", "extras")])
    near = radius_join(known.select("core", "support").where(~F.col("core").startswith(SHORT))).join(side("a"), "a").join(side("b"), "b")
    shares = lambda c: F.arrays_overlap(f"a_{c}", f"b_{c}")
    open_ = lambda c: (F.size(f"a_{c}") == 0) | (F.size(f"b_{c}") == 0)
    agrees = (open_("firsts") | shares("firsts")) & (open_("initials") | shares("initials")) & (open_("types") | shares("types")) & (open_("extras") | shares("extras"))
    apart = ~(((F.size("a_firsts") > 0) & (F.size("b_types") > 0)) | ((F.size("a_types") > 0) & (F.size("b_firsts") > 0)))
    rare = F.least("a_support", "b_support") <= F.greatest(F.lit(2), F.greatest("a_support", "b_support") * 0.34)
    # Facts that agree settle it whatever the support; without them one of both has to be rare.
    same = shares("firsts") | (shares("types") & shares("extras"))
    links = near.where(agrees & apart & (same | rare)).select("a", "b")
    together = profiles.select(F.col("core").alias("a"), F.explode("cores").alias("b")).distinct()
    return connected_components(links.unionByName(together), "a", "b").withColumnRenamed("node", "core").withColumnRenamed("component", "cluster")


def _entities_of(rows: list[dict]) -> list[str]:
    """Entity of each distinct profile of one cluster; weights are row counts."""
    persons = {}
    for r in rows:
        if r["first"]:
            persons.setdefault(r["first"], Counter())
            if r["middle"]:
                persons[r["first"]][r["middle"]] += r["n"]
    orgs = Counter()
    for r in rows:
        if not r["person"] and not r["first"] and (r["type"] or r["extra"]):
            orgs[r["type"], r["extra"]] += r["n"]
    out = []
    for i, r in enumerate(rows):
        entity = None
        if r["first"] or r["person"]:
            if r["first"]:
                fits = [r["first"]]
            else:
                fits = [f for f, middles in persons.items() if (not r["initial"] or f[0] == r["initial"]) and (not r["middle"] or not middles or r["middle"] in middles)]
                if not fits and not persons:
                    fits = ["?" + r["initial"]]
            if len(fits) == 1:
                middles = persons.get(fits[0], Counter())
                strong = [m for m, n in middles.items()]
                if len(strong) > 1:
                    entity = f"p|{fits[0]}|{r['middle']}" if r["middle"] else None
                else:
                    entity = f"p|{fits[0]}|"
        elif orgs:
            fits = [(t, x) for t, x in orgs if (not r["type"] or not t or t == r["type"]) and (not r["extra"] or not x or x == r["extra"])]
            kinds = {t for t, _ in fits if t}
            words = {x for _, x in fits if x}
            if len(kinds) <= 1 and len(words) <= 1:
                entity = f"o|{min(kinds, default='')}|{min(words, default='')}"
        elif not persons:
            entity = "u"
        elif len(persons) == 1 and len(next(iter(persons.values()))) <= 1:
            entity = f"p|{next(iter(persons))}|"
        out.append(entity if entity is not None else f"alone|{i}")
    return [f"{r['cluster']}|{e}" for r, e in zip(rows, out)]


def _by_cluster(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Clusters arrive one after the other; a group may go on in the next batch."""
    held: list[dict] = []
    for batch in batches:
        done: list[dict] = []
        names: list[str] = []
        for row in batch.to_dict("records"):
            if held and held[0]["cluster"] != row["cluster"]:
                done += held
                names += _entities_of(held)
                held = []
            held.append(row)
        if done:
            yield pd.DataFrame(done).assign(entity=names)
    if held:
        yield pd.DataFrame(held).assign(entity=_entities_of(held))


def linked_records(records: DataFrame) -> DataFrame:
    """Input (address, owner, primary_label, aliases); output (address, entity):
    records of one person or organisation share an entity."""
    profiles = stored(record_profiles(records, common_words(records)))
    clusters = core_clusters(profiles)
    placed = stored(profiles.join(clusters, "core"))
    facts = ["cluster", "first", "initial", "middle", "type", "extra", "person"]
    distinct = placed.groupBy(facts).agg(F.count("*").alias("n"))
    schema = "cluster string, first string, initial string, middle string, type string, extra string, person boolean, n bigint, entity string"
    entities = distinct.repartition("cluster").sortWithinPartitions("cluster").mapInPandas(_by_cluster, schema).drop("n")
    return placed.join(entities, facts).where("entity not like '%|alone|%'").select("address", "entity")


def linked_pairs(entities: DataFrame) -> DataFrame:
    """Input the entities table; output (address_a, address_b), a < b: records of
    one entity whose owner isn't the same string."""
    records = entities.where("address_lower is not null").select(F.col("address_lower").alias("address"), "owner", "primary_label", "aliases").dropDuplicates(["address"])
    linked = linked_records(records)
    # Rows of one owner spelling are one class; a null owner is a class of its own.
    spelled = stored(
        linked.join(records.select("address", "owner"), "address").withColumn("spelling", F.coalesce(F.concat(F.lit("o"), "owner"), F.concat(F.lit("n"), "address")))
    )
    classes = spelled.select("entity", "spelling").distinct()
    pairs = classes.select("entity", F.col("spelling").alias("sa")).join(classes.select("entity", F.col("spelling").alias("sb")), "entity").where("sa < sb")
    left = spelled.select("entity", F.col("spelling").alias("sa"), F.col("address").alias("a"))
    right = spelled.select("entity", F.col("spelling").alias("sb"), F.col("address").alias("b"))
    return pairs.join(left, ["entity", "sa"]).join(right, ["entity", "sb"]).select(F.least("a", "b").alias("address_a"), F.greatest("a", "b").alias("address_b"))
