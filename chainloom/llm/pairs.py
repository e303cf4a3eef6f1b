"""Problem 1: prompt and response pairs whose response is no usable answer.

``defective_pairs`` returns one row per defective response with its defect:

``empty``            no content; null and placeholders have none
``refusal``          declines to answer and gives no query
``copied_question``  nothing but the question, however typed or framed
``truncated``        stops inside its statement or sentence
``wrong_language``   its sentences are in another language than the question

Each response is cut into units, its sentences and statements, and every unit is
reduced to a form (literals, values and output names abstracted).  The distinct
forms are counted and sorted by text; in that order all that begins with a form
follows it, over partition borders too, so each form is compared with its
neighbours' common prefixes.  A response is ``truncated`` where

* its last unit has no ending and other responses go on where it stops,
* its last unit parses, but a far more frequent unit continues it,
* it has no ending (or any unit continues it) and its length is a length-limit
  spike: a length far more common in its run than the lengths around it,
* nothing else begins like it, and a quote or bracket is open or its last word
  can't end a statement.

Copy, refusal and language rules follow, and placeholders; they need one row only.

Defined results: a null response is ``empty`` whatever its question; a response
whose question is unknown (null, unmatched or empty) can be ``empty``,
``refusal`` or ``truncated`` only; equal rows give equal defects; each response
has at most one defect, in the order of the list above.  A missing full stop alone
is no truncation, and "None." as a sentence is an answer, a bare ``None`` is not.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.glyphs import consistent
from chainloom.sources.checkpoints import cut_lineage

# What programs write where nothing is, and what people do.
PLACEHOLDERS = frozenset(
    ["null", "nil", "nan", "na", "n/a", "undefined", "void", "tbd", "todo", "not available", "no output", "no answer", "no response",
     "no content", "no data", "empty response", "không có gì", "khong co gi", "chưa có", "chua co", "trong rỗng"]
)
# Words that hold a place alone, but answer a question as a sentence.
NOTHING = frozenset(
    ["none", "nothing", "empty", "blank", "không có", "khong co", "trống", "vide", "vacío", "ninguno", "nada", "leer", "keine", "nichts",
     "kosong", "tidak ada", "无", "没有", "空", "нет", "пусто"]
)

# Phrases by which an answer is declined (accents removed, lower case).
REFUSALS = re.compile(
    r"\b(?:i|we)(?: |'m |'d )?(?:(?:can ?not|can't|could not|couldn't|am not able to|not able to|am unable to|unable to|won't|will not|"
    r"may not|am not allowed to|not allowed to) (?:help|answer|assist|provide|give|write|produce|generate|create|do|share|comply|discuss|support)"
    r"|must decline|have to decline|refuse to|decline to|do not have access|don't have access|(?:would )?rather not)"
    r"|\b(?:no (?:query|answer|statement) can be given|against my (?:guidelines|policy|rules)|beyond what i may|"
    r"must leave unanswered|unable to (?:help|answer|assist|comply)|outside (?:of )?my (?:scope|remit)|cannot (?:help|answer|assist|provide)|"
    r"as an? (?:assistant|ai|language model), i)"
    r"|\btoi (?:khong the (?:tra loi|giup|viet|cung cap|thuc hien)|khong duoc phep|xin tu choi|tu choi|khong co quyen|"
    r"danh phai bo qua|rat tiec khong)|trai voi quy dinh|ngoai pham vi cua toi|xin tu choi|khong tra loi duoc"
    r"|\b(?:lo siento|no puedo (?:ayudar|responder)|je ne peux pas|je ne suis pas autorise|ich kann (?:das|diese|ihnen|darauf) nicht|"
    r"ich darf nicht|nao posso|saya tidak (?:dapat|bisa|boleh)|我不能|我无法|无法回答|не могу)"
)

# Frequent words that tell languages apart (accents removed).
LANGUAGE_WORDS = {
    "en": "the of and is are was were what which how many show list by from to with for this that between until not did "
          "all no one only first then more most per than before after it you need rows end date amounts ties",
    "vi": "cac cua va la duoc trong tu den ngay nao bao nhieu nhung khong giao dich tai khoan moi nhat dong ket qua cau lenh "
          "truy van toi ban thi roi theo bang voi cho gui khoi lan chuyen hien thi liet ke so luong neu tra loi day duoi tong",
    "id": "yang dan dari untuk dengan ini itu tidak adalah pada satu per lebih dulu saya lalu baris kueri berikut hasilnya "
          "pertama syaratnya diminta mengembalikan menerapkan menyaring tanggal terbaru",
    "es": "el la los las de del que y en un una por para con no se es fila filas fecha consulta resultado mas primero despues "
          "siguiente devuelve tiene incluye pedidas leyendo condicion",
    "fr": "le la les des du que et en un une pour par dans est ce pas ne se ligne lignes date requete resultat plus puis "
          "renvoie ci-dessous demandees lisant comprise d'abord j'applique",
    "de": "der die das und ist von zu mit den dem ein eine nicht nach fur wird zeile zeilen abfrage ergebnis zuerst danach "
          "folgende liefert aus hat je neueste mit zahlt enddatum bedingung",
    "pt": "o a os as do da dos das que e em um uma por para com nao se linha linhas data consulta resultado mais primeiro depois",
}
_LANG = {lang: frozenset(words.split()) for lang, words in LANGUAGE_WORDS.items()}
_VIETNAMESE = re.compile("[đĐơƠưƯ]|[ạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ]", re.I)
_SCRIPTS = (("zh", re.compile("[一-鿿]")), ("ru", re.compile("[Ѐ-ӿ]")))

_OPENED = re.compile(r"```[a-zA-Z]*\s*$")
_FENCE = re.compile(r"```[a-zA-Z]*\s*\n?|```")
_SELECT = re.compile(r"\b(?:select|with\s+\w+\s+as\s*\()\b|\bselect\b", re.I)
_FRAME = re.compile(
    r"^(?:(?:the |your |user )?(?:question|query|q|prompt|cau hoi|input|hoi)\s*(?:is|was|:|-|=)\s*|[\s\"'“”‘’«»`*_>#:\-–—]+|you asked:?\s*)+", re.I
)
_UNFRAME = re.compile(r"(?:[\s\"'“”‘’«»`*_#]+|\b(?:answer|a|sql|tra loi|dap an)\s*:\s*)+$", re.I)
_WORDS = re.compile(r"[^\W_]+(?:'[^\W\d_]+)?")
_MARKS = re.compile("[̀-ͯ]")


def bare(text: str) -> str:
    """Lower case without accents."""
    import unicodedata

    flat = _MARKS.sub("", unicodedata.normalize("NFD", text.casefold()))
    return flat.replace("đ", "d").replace("’", "'").replace("ß", "ss")


def language_of(text: str) -> str | None:
    """Language of some sentences; None where too little tells it."""
    for lang, pattern in _SCRIPTS:
        if len(pattern.findall(text)) >= 4:
            return lang
    words = [w for w in _WORDS.findall(bare(text)) if not any(c.isdigit() for c in w)]
    scores = {lang: sum(w in known for w in words) for lang, known in _LANG.items()}
    scores["vi"] += 2 * len(_VIETNAMESE.findall(text))
    best = max(scores, key=lambda k: (scores[k], k))
    rest = max(v for k, v in scores.items() if k != best)
    return best if scores[best] >= 2 and scores[best] > rest else None


_SQL_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|\d+(?:\.\d+)?|[A-Za-z_][\w.\-]*(?<![.\-])|<=|>=|<>|!=|\|\||\S")
_KEYWORDS = frozenset(
    "select from where group by order limit and or not in is null true false as asc desc sum count avg min max distinct date numeric if "
    "case when then else end between having join on left right inner outer union all with like exists cast extract".split()
)


def statement_shape(sql: str) -> tuple[str, bool]:
    """(shape of the statement, whether a quote or bracket stays open).

    Literals become ``S`` and ``N``, output names ``a0, a1, ...``, the rest is in
    lower case, so statements that differ in values only share a shape.
    """
    tokens = _SQL_TOKEN.findall(sql)
    depth, open_end, shape, names, previous = 0, False, [], {}, ""
    for tok in tokens:
        if tok.startswith("--"):
            continue
        low = tok.lower()
        if tok[0] == "'" or tok[0] == '"':
            if len(tok) == 1:
                open_end = True
                break
            low = "S"
        elif tok[0] == "`":
            if len(tok) == 1:
                open_end = True
                break
            low = low.strip("`")
        elif tok[0].isdigit():
            low = "N"
        elif tok == "(":
            depth += 1
        elif tok == ")":
            depth -= 1
        elif previous == "as" and low not in _KEYWORDS:
            low = names.setdefault(low, f"a{len(names)}")
        elif low in names:
            low = names[low]
        if tok == ";":
            continue
        shape.append(low)
        previous = low
    # A last word that is nowhere else and begins an output name is that name, cut.
    if shape and re.fullmatch(r"[a-z_]\w*", shape[-1]) and shape[-1] not in shape[:-1] and shape[-1] not in _KEYWORDS:
        cut = [short for name, short in names.items() if name.startswith(shape[-1]) and name != shape[-1]]
        if len(cut) == 1 and shape[-1] not in names.values():
            shape[-1] = cut[0]
    return " ".join(shape), open_end or depth > 0


_DANGLING = frozenset(
    "select from where group by order limit and or not in is as date numeric if case when then else between having join on left inner "
    "union all with like , = < > <= >= <> != + - * / ( . distinct cast".split()
)
_ABSTRACTED = re.compile(r"(?:^| )(?:S|N|a\d+|#)$")
_ENDED = re.compile(r"[.?!。！？…:;)\]\"'”’»`\d]\s*$")
_SENTENCE_END = re.compile(r"[.?!。！？…]['\"”’»)\]]*\s*$")
_SENTENCES = re.compile(r"(?<=[.?!。！？…])['\"”’»)\]]*\s+|\s*\n\s*")
_VALUE = re.compile(r"0x[0-9a-f]*|\d[\d.,:/-]*")
#: What may follow a whole text without making it a shortened one.
_STOPS = frozenset(".?!。！？…")


@lru_cache(maxsize=50_000)
def sentence_form(sentence: str) -> str:
    """A sentence in lower case without accents, values as ``#``; a comma or colon
    where the text stops is left out."""
    return " ".join(_VALUE.sub("#", bare(sentence)).split()).rstrip(" ,;:-–—")


def sentence_forms(text: str) -> list[str]:
    return [form for form in map(sentence_form, _SENTENCES.split(text)) if form]


def split_response(text: str) -> tuple[str, str, str]:
    """(prose before, last statement, prose after) of a response."""
    m = None
    for m in _SELECT.finditer(text):
        # the last SELECT that opens a statement: at the start, after a fence, line or sentence
        head = text[: m.start()].rstrip(" \t")
        if not head or head[-1] in "\n`.:?!。…)," or head.endswith("```"):
            found = m
            break
    else:
        found = None
    if m is None:
        return text, "", ""
    start = (found or m).start()
    head, body = text[:start], text[start:]
    again = [x.start() for x in re.finditer(r"\bselect\b", body, re.I)]
    after = ""
    cut = re.search(r"\n?```", body)
    if cut:
        after, body = body[cut.end():], body[: cut.start()]
        if _SELECT.search(after):
            more_head, more_body, more_after = split_response(after)
            return head + " " + more_head, more_body, more_after
    elif len(again) > 1:
        # the whole answer repeated: judge the last copy
        first = body[: again[1]]
        if re.search(r"\blimit\b|\bfrom\b", first, re.I) and first.count("(") <= first.count(")"):
            return head + " ", body[again[1]:], ""
    return head, body, after


_ADDRESSLIKE = re.compile(r"0x[0-9a-f]+|\d[\d.,:/-]*\d|\d", re.I)


def comparable(text: str) -> str:
    """Letters and digits only, one case, no accents: how a copy is recognised."""
    return "".join(_WORDS.findall(bare(text))).replace("'", "")


#: A question of fewer letters is copied by itself only, framed or not.
SHORT_QUESTION = 8


def is_copy(question: str, response: str) -> bool:
    """Nothing but the question: framed, quoted, repeated, retyped or shouted."""
    unframed = lambda text: _UNFRAME.sub("", _FRAME.sub("", text))
    wants = {w for w in (comparable(question), comparable(unframed(question))) if w}
    gots = {g for g in (comparable(response), comparable(unframed(response))) if g}
    values = [comparable(x) for x in _ADDRESSLIKE.findall(bare(question))]
    for want in wants:
        for got in gots:
            if got == want:
                return True
            if len(want) < SHORT_QUESTION:
                continue  # so little may stand in any answer
            if len(got) % len(want) == 0 and got == want * (len(got) // len(want)):
                return True
            # Framing words around the copy: it holds the question and no further value.
            if want in got:
                rest = got.replace(want, "", 8)
                if len(rest) <= 24 and not re.search(r"\d", rest):
                    return True
            # Framing words around the question: the copy holds all of its values.
            elif got in want and len(got) >= 0.6 * len(want) and all(v in got for v in values):
                return True
    return False


def judge(question: str | None, response: str | None) -> tuple[str | None, list[str], str, int]:
    """(defect by row rules, forms of the units, ending, length).

    ``ending`` of the last unit: ``open`` inside a quote, bracket, clause or
    number; ``unended`` a sentence without an ending; ``shape`` a statement that parses and ends
    the text; ``unsure`` a word or two without a full stop; ``done``.
    """
    if response is None:
        return "empty", [], "done", 0
    text = consistent_lines(response)
    inner = _FENCE.sub(" ", text).strip()
    said = inner.lower().strip(" <>[](){}\"'*-_`")
    if not re.search(r"[^\W_]", inner) or said in NOTHING or said.rstrip(" .") in PLACEHOLDERS:
        return "empty", [], "done", len(text)
    ask = consistent(question) if question else ""
    has_query = bool(_SELECT.search(inner)) and bool(re.search(r"\bfrom\b|\bselect\b[^.?!]*\b(?:as|count|sum|avg|min|max)\b|\bselect\b\s+\w+\s*,|\bselect\b\s*\S*$", inner, re.I))
    if not has_query:
        if ask and is_copy(ask, inner):
            return "copied_question", [], "done", len(text)
        if REFUSALS.search(bare(inner)):
            return "refusal", [], "done", len(text)
    head, body, after = split_response(text) if has_query else (text, "", "")
    head, prose = _FENCE.sub("\n", head), _FENCE.sub("\n", after).strip()
    units, ending = sentence_forms(head), "done"
    if body:
        shape, is_open = statement_shape(body)
        if shape:
            units.append(shape)
        units += sentence_forms(prose)
        if prose:
            ending = "done" if _SENTENCE_END.search(prose) else "unended"
        elif is_open or not shape or shape.rsplit(" ", 1)[-1] in _DANGLING or _cut_number(body, ask):
            ending = "open"
        else:
            ending = "shape"
    else:
        tail = head.strip()
        if text.count("```") % 2 and _OPENED.search(text):
            ending = "open"  # a block of code begins and nothing follows
        elif not _ENDED.search(tail) and re.search(r"[^\W\d_]{2,}\s+[^\W_]+", tail):
            ending = "unended"
        elif not _SENTENCE_END.search(tail) and len(tail.split()) > 4 and not re.search(r"[\"'”’»`)]\s*$", tail):
            ending = "unended"
        elif not _SENTENCE_END.search(tail) and not re.fullmatch(r"[\d.,\s]*", tail):
            ending = "unsure"
    defect = None
    if ask:
        spoken = " ".join(x for x in (head, prose) if x.strip())
        spoken = re.sub(r"--|0x[0-9a-f]+|`[^`]*`|\b\w+_\w+\b", " ", spoken)
        theirs = language_of(spoken)
        ours = language_of(ask)
        if theirs and ours and theirs != ours:
            defect = "wrong_language"
    return defect, units, ending, len(text)


def _cut_number(body: str, ask: str) -> bool:
    """Whether the statement's last number is the beginning of a number of its question."""
    last = re.search(r"(\d+)\s*;?\s*$", body)
    dates = re.findall(r"\d{4}-\d\d-\d\d", body)
    if not last or not ask or not dates:
        return False
    n, numbers, asked = last.group(1), set(re.findall(r"\d+", ask)), set(_date_forms(ask))
    return n not in numbers and all(d in asked for d in dates) and any(x.startswith(n) and len(x) > len(n) for x in numbers)


def _date_forms(text: str) -> list[str]:
    out = re.findall(r"\d{4}-\d\d-\d\d", text)
    return out + [f"{y}-{m}-{d}" for d, m, y in re.findall(r"(\d\d)/(\d\d)/(\d{4})", text)]


def consistent_lines(text: str) -> str:
    """The consistent form line by line, so that layouts keep their lines."""
    return "\n".join(consistent(line) or "" for line in text.splitlines()) if "\n" in text or "\r" in text else consistent(text)


#: A form so many times as frequent shows that the form it continues is cut.
RATIO = 5.0
_JUDGED = "prediction_id bigint, run_id string, defect string, units array<string>, ending string, length int"


def _judge_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [judge(q, p) for q, p in zip(batch["question"], batch["prediction"])]
        out = pd.DataFrame(rows, columns=["defect", "units", "ending", "length"])
        out.insert(0, "run_id", batch["run_id"].to_numpy())
        out.insert(0, "prediction_id", batch["prediction_id"].to_numpy())
        yield out


def _continues(longer: str, shape: str) -> bool:
    """Whether a text goes on where the shape stops, be it inside a word.
    Abstracted tokens are whole: ``a1`` is no beginning of ``a10``.  A full stop
    alone is no continuation."""
    if not longer.startswith(shape) or len(longer) == len(shape) or longer[len(shape)] in _STOPS:
        return False
    return longer[len(shape)] == " " or not _ABSTRACTED.search(shape)


def _common_length(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


def continued_shapes(shapes: DataFrame) -> DataFrame:
    """Input (shape, n), shapes unique; output (shape, n, best): those that other
    shapes continue, with the count of the most frequent one.

    The shapes are range-partitioned and sorted; in that order everything that
    begins with a shape follows it directly, in its own partition and maybe in
    the next ones.  Of each partition the driver sees its first and last shape
    and, for the words and characters of the first one, the highest count among
    the shapes that share so much with it, so that borders hide nothing.
    """
    ordered = cut_lineage(shapes.repartitionByRange("shape").sortWithinPartitions("shape"))

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, last, shared, steps = None, None, 0, []
        for batch in batches:
            for shape, n in zip(batch["shape"], batch["n"]):
                shared = min(shared, _common_length(first, shape)) if first is not None else len(shape)
                first, last = (shape if first is None else first), shape
                # (most that is shared, what comes next, count); a longer share with a higher count hides this one
                follower = shape[shared : shared + 1]
                if not any(size >= shared and (size > shared or after == follower) and m >= n for size, after, m in steps):
                    steps = [x for x in steps if not (x[0] == shared and x[1] == follower)] + [(shared, follower, int(n))]
        if first is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "first": [first], "last": [last], "steps": [[{"size": k, "after": c, "n": m} for k, c, m in steps]]})

    borders = {
        r["part"]: (r["first"], r["last"], [(x["size"], x["after"], x["n"]) for x in r["steps"]])
        for r in ordered.mapInPandas(summary, "part int, first string, last string, steps array<struct<size: int, after: string, n: bigint>>").collect()
    }

    def beyond(shape: str, part: int) -> int:
        """Highest count of the shapes in later partitions that continue this one."""
        best = 0
        for later in sorted(p for p in borders if p > part):
            first, last, steps = borders[later]
            if not first.startswith(shape):
                break
            for size, after, n in steps:
                if size > len(shape) and _continues(first, shape) or size == len(shape) and _continues(shape + after, shape):
                    best = max(best, n)
            if not last.startswith(shape):
                break
        return best

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        open_: list[list] = []  # [shape, n, best], each the beginning of the next
        done: list[list] = []
        for batch in batches:
            for shape, n in zip(batch["shape"], batch["n"]):
                while open_ and not shape.startswith(open_[-1][0]):
                    done.append(open_.pop())
                for x in open_:
                    if _continues(shape, x[0]):
                        x[2] = max(x[2], n)
                open_.append([shape, n, 0])
            done = [x for x in done if x[2]]
            if done:
                yield pd.DataFrame(done, columns=["shape", "n", "best"])
            done = []
        for x in open_:
            x[2] = max(x[2], beyond(x[0], part))
        rest = [x for x in open_ if x[2]]
        if rest:
            yield pd.DataFrame(rest, columns=["shape", "n", "best"])

    return ordered.mapInPandas(scan, "shape string, n bigint, best bigint")


def shortened_shapes(shapes: DataFrame, ratio: float = RATIO) -> DataFrame:
    """Input (shape, n), shapes unique; output (shape): those that a far more
    frequent shape continues."""
    return continued_shapes(shapes).where(F.col("best") >= ratio * F.col("n")).select("shape")


def length_spikes(judged: DataFrame, width: int = 4, factor: float = 6.0, least: int = 12) -> DataFrame:
    """(run_id, length) at which a run has ``factor`` times as many responses as
    at the neighbouring lengths: the marks of an output limit."""
    counts = judged.groupBy("run_id", "length").agg(F.count("*").alias("n"))
    near = counts.select("run_id", F.explode(F.sequence(F.col("length") - width, F.col("length") + width)).alias("length"), F.col("n").alias("m"))
    around = near.groupBy("run_id", "length").agg(F.sum("m").alias("m"))
    return (
        counts.join(around, ["run_id", "length"])
        .where((F.col("n") >= least) & (F.col("n") >= factor * (F.col("m") - F.col("n") + 1) / (2 * width)))
        .select("run_id", "length")
    )


def truncation_evidence(judged: DataFrame) -> DataFrame:
    """Input (prediction_id, run_id, defect, units, ending, length); output adds
    ``evidence`` that the response was cut: ``neighbour``, ``length``, ``syntax`` or null.

    Only distinct forms are sorted; the rows that meet them again are those
    without an ending.
    """
    forms = judged.select(F.explode("units").alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))
    # A far more frequent continuation settles it; any continuation does without an ending or at a limit.
    continued = continued_shapes(forms).select(F.col("shape").alias("last"), F.lit(True).alias("is_continued"), (F.col("best") >= RATIO * F.col("n")).alias("is_short"))
    spikes = length_spikes(judged.where("defect is null or defect <> 'empty'")).withColumn("at_limit", F.lit(True))
    open_ = judged.where("ending <> 'done'").withColumn("last", F.element_at("units", -1))
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    unended = F.col("ending").isin("open", "unended")
    evidence = (
        F.when((unended & has("is_continued")) | has("is_short"), "neighbour")
        .when(has("at_limit") & (unended | has("is_continued") | (F.col("ending") == "unsure")), "length")
        .when(F.col("ending") == "open", "syntax")
    )
    found = open_.join(continued, "last", "left").join(spikes, ["run_id", "length"], "left").select(*judged.columns, evidence.alias("evidence"))
    return judged.where("ending = 'done'").withColumn("evidence", F.lit(None).cast("string")).unionByName(found)


def judged_pairs(predictions: DataFrame, cases: DataFrame) -> DataFrame:
    """(prediction_id, run_id, defect, units, ending, length) of every response."""
    asked = cases.where("case_id is not null").groupBy("case_id").agg(F.min("question").alias("question"))
    rows = predictions.select("prediction_id", "run_id", "case_id", "prediction")
    # Rows without a case don't move: they have no question to meet.
    known = rows.where("case_id is not null").join(asked, "case_id", "left").select("prediction_id", "run_id", "question", "prediction")
    alone = rows.where("case_id is null").select("prediction_id", "run_id", F.lit(None).cast("string").alias("question"), "prediction")
    return known.unionByName(alone).mapInPandas(_judge_batches, _JUDGED)


def defective_pairs(predictions: DataFrame, cases: DataFrame) -> DataFrame:
    """Input predictions (prediction_id, run_id, case_id, prediction) and cases
    (case_id, question); output (prediction_id, defect).  Extra columns of either
    side are left aside, so names may clash."""
    judged = truncation_evidence(cut_lineage(judged_pairs(predictions, cases)))
    first = F.col("defect").isin("empty", "refusal", "copied_question")
    defect = F.when(first, F.col("defect")).when(F.col("evidence").isNotNull(), "truncated").otherwise(F.col("defect"))
    return judged.select("prediction_id", defect.alias("defect")).where("defect is not null")
