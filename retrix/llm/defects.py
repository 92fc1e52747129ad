"""Broken prompt and response pairs, each with one type of defect.

Responses are sorted by text and compared with the neighbours that share their whole text as a prefix: one that
another continues inside a sentence is a shortened version. Because names and numbers differ from response to
response, the comparison is made a second time on masked text: the last words of a response that lacks an end mark
are compared with every place of the corpus where these words stand, and it breaks off if sentences mostly go on
there. Lengths at which far more unfinished responses end than around them are length limits. Rules for empty
responses, copies of the question, refusals and other languages come besides.

The words that are not masked, the words' weights by language, the places and the lengths are counted over all rows.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrix.llm.hashing import mix as _mix
from retrix.sources.tables import cut

#: Share of the texts in which a word occurs at least that is not masked. So there are at most as many of them as a
#: text has different words on average, divided by this.
COMMON = 0.002
#: Words before an end that are compared, and with the beginning of the sentence besides.
CONTEXT, CONTEXT_BEGUN = 5, 6
#: What the shorter contexts tell counts as much as so many places of the next longer one.
SHORTER = 4.0
#: A length is a limit if the unfinished responses of that length exceed the mean of the lengths around, up to AROUND
#: away, by this many times its standard deviation, as if they came at random.
AROUND, SPIKE = 10, 6.0
#: log2 of the bits of the filter for contexts, and rows in which a task sends its part of it.
FILTER_BITS, FILTER_PARTS = 22, 64
#: Share of the question's words that a copy has, and the other way round.
COPY_SHARE = 0.75

#: Words that mark a language.
SEEDS = {
    "en": "the of and to in that is for when with how what which from are it on as by an this not can does why list explain".split(),
    "pt": "o os um uma em do da dos das na nos com não são é ao aos pelo pela quando mais você isso depois até sem mas qual quais por que como seja lhe".split(),
    "es": "el los las una un en del con y es son cuando más usted eso después hasta sin pero cuál qué cómo por si al su puedo lo cada".split(),
    "fr": "le les des est une dans avec pour pas sur vous nous qui sont avant après tous puis car ne se chaque aux cette".split(),
    "de": "der die das und ist nicht mit für sie den im ein eine auf wird danach nur werden zu von bitte dem oder".split(),
    "it": "il gli della delle che di è nel per con sono questo dopo prima ogni dei alla non più".split(),
}
#: Answers of one word and their languages, words for nothing, and what stands before a repeated question.
SHORT_WORDS = {"yes": "en", "sim": "pt", "não": "pt", "sí": "es"}
NULL_WORDS = frozenset("none null nil n/a na nan undefined vazio vacío empty nulo ninguno nenhum nenhuma tbd todo".split())
LEAD_INS = re.compile(
    r"(?i)^\W*(?:pergunta|question|pregunta|você perguntou|voce perguntou|you asked|usted preguntó|então você quer saber|so you want to know|entonces quiere saber|a pergunta (?:é|foi)|your question (?:is|was)|su pregunta (?:es|fue)|q)\s*[:\-–]\s*"
)
#: Polite sentences around refusals and repeated questions, without content of their own.
POLITE = re.compile(
    r"(?i)^\W*(?:obrigad[oa] por perguntar|boa pergunta|thank you for asking|good question|gracias por preguntar|buena pregunta|precisa de mais alguma coisa|is there anything else you need|necesita algo más|"
    r"pode perguntar outra coisa|could you ask something else|puede preguntar otra cosa|espero que (?:lo )?entienda|espero que entenda|i hope you understand|procure a central de suporte|please contact the support desk|"
    r"consulte a la mesa de ayuda|tente outro tema|try another topic|pruebe con otro tema)\W*$"
)
#: Phrases that decline to answer.
REFUSALS = re.compile(
    r"(?i)"
    r"\b(?:i(?:'m| am)? (?:cannot|can ?not|can't|could not possibly|won't|will not|must decline|must refuse|have to decline|refuse to|decline to|unable to|not able to|not allowed to|not permitted to|not in a position to)\b"
    r"(?! (?:reproduce|reproduced|confirm that))|i (?:have no way to|have no access|do not have access|don't have access|know nothing|cannot|can't)|i was not (?:built|made|designed) (?:to|for)|my (?:guidelines|settings|instructions|rules|policies) (?:prevent|keep|stop|forbid|do not allow|don't allow)|"
    r"not enough (?:information|data|context|detail) for me to|(?:i(?:'d| would) rather not|i prefer not to) (?:comment|answer|say|discuss|talk)|i am incapable of|"
    r"no answer can be given|outside what i (?:am allowed|can|may)|this topic is off limits|off limits for me|as an? (?:ai|assistant|language model|digital assistant)\b[^.]*\b(?:cannot|can't|do not|don't|no access|unable|not able)|against my (?:guidelines|rules|policy))"
    r"|\b(?:(?:não|nao) (?:posso|consigo|vou|devo|tenho como|tenho acesso|estou autorizad|estou em condições|fui (?:feito|criado|projetado)|me é permitido|é permitido que eu)\b(?! (?:reproduzir|reproduzi))|preciso recusar|devo recusar|tenho de recusar|minhas? (?:diretrizes|configuraç(?:ão|ões)|regras|normas|instruções)[^.]{0,30}(?:imped|não me deixa|não permit|proíb)|"
    r"sou incapaz de|não há (?:informaç\w+|dados|contexto) suficientes? para que eu|prefiro não (?:comentar|responder|falar)|"
    r"nenhuma resposta pode ser dada|fora do que posso|esse tema me é vedado|me é vedado|nada sei sobre|como (?:assistente|modelo|ia|inteligência)\b[^.]*\bnão)"
    r"|\b(?:no (?:puedo|voy a|debo|tengo (?:acceso|manera|forma|modo)|estoy (?:autorizad|en condiciones)|fui (?:hecho|creado|diseñado)|me es posible)\b(?! reproducir)|debo rechazar|tengo que rechazar|mis? (?:normas|reglas|configuración|instrucciones|directrices)[^.]{0,30}(?:impid|no me deja|no permit|prohíb)|"
    r"soy incapaz de|no hay (?:información|datos|contexto) suficientes? para que|prefiero no (?:comentar|responder|hablar)|"
    r"no se puede dar ninguna respuesta|fuera de lo que puedo|ese tema me está vedado|me está vedado|nada sé sobre|como (?:asistente|modelo|ia|inteligencia)\b[^.]*\bno )"
)
#: How a question asks for a language.
ASKS_LANGUAGE = re.compile(
    r"(?i)\b(?:in|into|em|en|para o|al|ao)\s+(?:english|portuguese|spanish|inglês|ingles|inglés|português|portugues|portugués|espanhol|español|castellano|french|francês|francés|german|alemão|alemán)\b|\b(?:translate|traduza|traduzir|traduzca|traducir|traduce|tradução|traducción|translation)\b"
)
_WORD = re.compile(r"[^\W_]+(?:_[^\W_]+)*")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]?")
_MARKUP = re.compile(r"<[^<>]*>|&\w+;|```\w*|[*#>`~|]+|(?<![^\W_])_+|_+(?![^\W_])")
_FINISHED = re.compile(r"[.!?…。！？][\"'”’»)\]*_`\s]*(?:✅|[\U0001F300-\U0001FAFF☀-➿️]|\s)*$")
_ENDING_LINK = re.compile(r"(?:https?://\S+|\S+@\S+|\S+/\S+|\b[\w-]+\.[a-z]{2,5})[\"')\]]*\s*$")
_OPEN_END = re.compile(r"(?:[,;:–—(\[{&+/=]|\s[-–]|\b(?:\d+\.|[-*])\s*\*{0,2})\s*$")


def answer_of(data: str | None) -> tuple[str, str | None]:
    """State of a response's JSON (missing, cut, value) and the answer's text."""
    if data is None or not data.strip():
        return "missing", None
    try:
        held = json.loads(data)
    except ValueError:
        return "cut", data
    if isinstance(held, dict):
        held = held.get("answer", held.get("response"))
    if isinstance(held, (dict, list)):
        held = json.dumps(held, ensure_ascii=False) if held else None
    return ("missing", None) if held is None else ("value", held if isinstance(held, str) else json.dumps(held))


def bare(text: str) -> str:
    """Text without markup, marks and invisible characters, as words in lower case."""
    return " ".join(_WORD.findall(unicodedata.normalize("NFC", _MARKUP.sub(" ", text)).lower()))


def is_empty(text: str) -> bool:
    left = _MARKUP.sub(" ", text)
    words = _WORD.findall(left)
    return not words and not any(unicodedata.category(c) in ("So", "Sm", "Sc") for c in left) or left.strip().strip(".!()[]\"'").lower() in NULL_WORDS


def _close(x: str, y: str) -> bool:
    """Whether two words are equal but for one pair of letters changed about or one letter more or less."""
    if x == y:
        return True
    if abs(len(x) - len(y)) > 1 or min(len(x), len(y)) < 4:
        return False
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    return x[k + 1 :] == y[k + 1 :] or x[k:] == y[k + 1 :] or x[k + 1 :] == y[k:] or (x[k : k + 2] == y[k : k + 2][::-1] and x[k + 2 :] == y[k + 2 :])


def is_copy(question: str, answer: str) -> bool:
    """Whether an answer says nothing but the question, politeness, lead-ins, marks and slips aside."""
    asked = bare(question).split()
    if not asked:
        return False
    kept = LEAD_INS.sub("", _MARKUP.sub(" ", answer).strip())
    kept = " ".join(s for s in re.split(r"(?<=[.!?])\s+|\n+", kept) if s.strip() and not POLITE.match(s))
    kept = LEAD_INS.sub("", kept.strip())
    said = bare(kept).split()
    half = len(said) // 2
    if len(said) == 2 * len(asked) and said[:half] == said[half:]:
        said = said[:half]
    if not said or len(said) > len(asked) / COPY_SHARE or len(asked) > len(said) / COPY_SHARE:
        return False
    left = Counter(said)
    left -= (equal := left & Counter(asked))
    missing = Counter(asked) - equal
    near = 0
    rest = list(left.elements())
    for word in missing.elements():
        for k, other in enumerate(rest):
            if _close(word, other):
                near += 1
                del rest[k]
                break
    shared = equal.total() + near
    return shared / len(asked) >= COPY_SHARE + 0.1 and shared / len(said) >= COPY_SHARE + 0.1


def is_refusal(answer: str) -> bool:
    """Whether the answer, politeness aside, declines; a later sentence with content of its own doesn't matter."""
    sentences = [s for s in re.split(r"(?<=[.!?:])\s+|\n+", answer.strip()) if s.strip() and not POLITE.match(s)]
    return any(REFUSALS.search(s) and not re.search(r"(?i)\b(?:but|mas|pero)\b.*\b(?:solved|fixed|resolve[u]?|resolvió|corrigi[óu])", s) for s in sentences[:3])


_ONLY = {w: lang for lang, words in SEEDS.items() for w in words if sum(w in other for other in SEEDS.values()) == 1}


def vote(words: list[str]) -> str | None:
    """The language that the marking words of a text tell clearly."""
    votes = Counter(_ONLY[w] for w in words if w in _ONLY).most_common(2)
    return votes[0][0] if votes and votes[0][1] >= 2 and (len(votes) == 1 or votes[0][1] >= 2 * votes[1][1]) else None


class Words:
    """The common words of the corpus: their numbers, and their weights by language."""

    def __init__(self, common: dict[str, dict[str, int]]):
        """``common``: how often each common word occurs in texts of each language that is told."""
        total = {lang: sum(c.get(lang, 0) for c in common.values()) + len(common) * 0.1 + 1 for lang in SEEDS}
        self.weights = {w: {lang: math.log((c.get(lang, 0) + 0.1) / total[lang]) for lang in SEEDS} for w, c in common.items()}
        self.code = {w: k + 2 for k, w in enumerate(sorted(common))}  # 0: a word that is masked, 1: a number
        for w, lang in _ONLY.items():
            if w not in common:
                self.weights[w] = {x: math.log(0.05 if x == lang else 0.0005) for x in SEEDS}

    def language(self, text: str) -> tuple[str | None, int]:
        """The language of a text, if it can be told, and the words that tell it."""
        words = [w for w in bare(text).split() if w in self.weights]
        if not words:
            return None, 0
        scores = sorted(((sum(self.weights[w][lang] for w in words), lang) for lang in SEEDS), reverse=True)
        return (scores[0][1] if scores[0][0] - scores[1][0] > 2.0 else None), len(words)

    def shape(self, sentence: str) -> list[int]:
        """The words of a sentence by number, masked."""
        get = self.code.get
        return [1 if w.isdigit() else get(w, 0) for w in (x.lower() for x in _WORD.findall(sentence))]


def sentences(text: str) -> Iterator[tuple[str, bool]]:
    """Sentences of a text and whether they are whole: by their end mark, or because another line follows."""
    lines = [x for x in _MARKUP.sub(" ", text).split("\n") if x.strip()]
    for k, line in enumerate(lines):
        parts = _SENTENCE.findall(line)
        for j, part in enumerate(parts):
            yield part, part.rstrip()[-1:] in tuple(".!?") or (j == len(parts) - 1 and k < len(lines) - 1)


_U = np.uint64
#: Kinds of contexts, least telling first: words before a place, with the beginning of the sentence or without.
KINDS = sorted([(n, True) for n in range(1, CONTEXT_BEGUN + 1)] + [(n, False) for n in range(1, CONTEXT + 1)], key=lambda kind: (kind[0] + kind[1] + 0.5 * kind[1], kind))


def contexts(shapes: list[list[int]]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Hashes and places of the contexts of each kind, over all words of some sentences one after another; and the
    place of each sentence's last word. A place is one word."""
    sizes = np.array([len(x) for x in shapes], dtype=np.int64)
    flat = np.fromiter((c for x in shapes for c in x), dtype=_U, count=int(sizes.sum())) + _U(1)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(starts, sizes)
    begun = np.zeros(len(flat), dtype=_U)
    if len(flat):
        first = np.minimum(starts, len(flat) - 1)
        second = np.minimum(starts + 1, len(flat) - 1)
        begun = np.repeat(_mix(flat[first] * _U(0x9E3779B97F4A7C15) + flat[second]), sizes)
    by_length, sums, factor = {}, np.zeros(len(flat), dtype=_U), 1
    for n in range(1, max(CONTEXT, CONTEXT_BEGUN) + 1):
        sums = sums.copy()
        sums[n - 1 :] += flat[: max(len(flat) - n + 1, 0)] * _U(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        by_length[n] = sums
    out = []
    for n, with_start in KINDS:
        at = np.flatnonzero(place >= max(n - 1, 4 if with_start else 0))
        key = by_length[n][at] + _U(n)
        out.append((_mix(_mix(key) + begun[at]) if with_start else _mix(key), at))
    return out, (starts + sizes - 1)[sizes > 0]


def unfinished(text: str) -> bool:
    """Whether a text lacks an end mark, a closed block or the like at its end."""
    stripped = text.rstrip()
    if stripped.count("```") % 2:
        return True
    if stripped.endswith("```") or _FINISHED.search(stripped):
        return bool(re.search(r"(?:^|\n)\s*(?:\d+\.|[-*])\s*$", stripped))
    return not _ENDING_LINK.search(stripped)


def breaks_off(text: str) -> bool | None:
    """Whether a text stops before its end, as far as it tells alone; None if the corpus has to tell."""
    stripped = text.rstrip()
    if not unfinished(text):
        return False
    if stripped.count("```") % 2 or _OPEN_END.search(stripped):
        return True
    tail = stripped.rsplit("\n", 1)[-1]
    if tail.count("(") > tail.count(")") or stripped.endswith("**") and stripped.count("**") % 2:
        return True
    if len(_WORD.findall(stripped)) <= 3 or stripped[-1:] in ")\"'”»*":
        return False
    if any(unicodedata.category(c) == "So" for c in stripped[-3:]):
        return False
    return None


def last_shape(text: str, words: Words) -> list[int]:
    """The last sentence of a text, masked."""
    found = _SENTENCE.findall(_MARKUP.sub(" ", text).strip())
    return words.shape(found[-1]) if found else []


def continues(short: str, long: str) -> bool:
    """Whether ``long`` goes on inside the sentence at which ``short`` stops."""
    short = short.rstrip()
    if not short or not long.startswith(short) or len(long) <= len(short) or not unfinished(short):
        return False
    words = _WORD.findall(short)
    if len(words) == 1 and (not short[:1].isupper() or short.lower() in SHORT_WORDS or short.lower() in NULL_WORDS or short.lower() == "no"):
        return False
    after = long[len(short) :]
    return after[0].isalpha() and short[-1].isalpha() or re.match(r"[ ,;:–-]+\w", after) is not None


def judge(state: str, question: str | None, answer: str | None, words: Words) -> str | None:
    """The type of defect of a pair as far as it tells alone, if any."""
    if state == "cut":
        return "truncated_answer"
    if state == "missing" or is_empty(answer):
        return "empty_answer"
    question = question or ""
    if is_copy(question, answer):
        return "copies_question"
    if is_refusal(answer):
        return "refusal"
    asked, _ = words.language(question)
    said, telling = words.language(answer)
    if len(_WORD.findall(answer)) == 1 and answer.strip(" .!").lower() in SHORT_WORDS:
        said, telling = SHORT_WORDS[answer.strip(" .!").lower()], 3
    if asked and said and asked != said and telling >= 3 and not ASKS_LANGUAGE.search(question):
        return "other_language"
    return "truncated_answer" if breaks_off(answer) else None


def common_words(texts: DataFrame) -> Words:
    """The words that occur in a share of COMMON of the texts (column ``text``) or more, counted over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        times: dict[str, Counter] = {lang: Counter() for lang in SEEDS}
        total = 0

        def sent() -> pa.RecordBatch:
            rows = [(w, "", n) for w, n in seen.items()] + [(w, lang, n) for lang, held in times.items() for w, n in held.items()] + [("", "", total)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["word", "lang", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = bare(text).split()
                total += 1
                seen.update(set(words))
                if told := vote(words):
                    times[told].update(words)
            if len(seen) > 200_000:
                yield sent()
                seen.clear(), [held.clear() for held in times.values()]
                total = 0
        yield sent()

    counts = cut(texts.select("text").mapInArrow(count, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")))
    total = counts.where("word = ''").agg(F.sum("n")).first()[0] or 0
    often = counts.where((F.col("lang") == "") & (F.col("n") >= max(3, COMMON * total)) & ~F.col("word").rlike("^[0-9]*$")).select("word")
    rows = counts.join(often, "word", "left_semi").collect()  # see COMMON; one row per language and word
    held: dict[str, dict[str, int]] = {}
    for r in rows:
        held.setdefault(r["word"], {})[r["lang"]] = r["n"]
    return Words(held)


def _filter_of(wanted: DataFrame) -> np.ndarray:
    """A table of bits, of fixed size, in which the hash of every wanted context is set."""
    size = 1 << FILTER_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, dtype=bool)
        for batch in batches:
            bits[batch.column(0).to_numpy().view(_U) >> _U(64 - FILTER_BITS)] = True
        for part, piece in enumerate(np.packbits(bits).reshape(FILTER_PARTS, -1)):
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([zlib.compress(piece.tobytes(), 1)])], names=["part", "bits"])

    def join(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        both = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in pieces["bits"]])
        return pd.DataFrame({"part": [key[0]], "bits": [both.tobytes()]})

    packed = np.zeros((FILTER_PARTS, size // 8 // FILTER_PARTS), dtype=np.uint8)
    for row in wanted.mapInArrow(mark, "part long, bits binary").groupBy("part").applyInPandas(join, "part long, bits binary").collect():  # FILTER_PARTS rows
        packed[row["part"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    return np.unpackbits(packed.reshape(-1)).astype(bool)


def _places(answers: DataFrame, words, wanted: DataFrame) -> DataFrame:
    """Of the wanted contexts (column ``context``), at how many places of the answers they stand (``seen``) and at how
    many of these the sentence ends (``ends``)."""
    bits = answers.sparkSession.sparkContext.broadcast(_filter_of(wanted))  # of fixed size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, asked = words.value, bits.value
        for batch in batches:
            shapes, whole = [], []
            for text in batch.column(0).to_pylist():
                for sentence, finished in sentences(text):
                    shape = own.shape(sentence)
                    if shape:
                        shapes.append(shape)
                        whole.append(finished)
            found, last = contexts(shapes)
            total = int(sum(map(len, shapes)))
            ends, broken = np.zeros(total, dtype=bool), np.zeros(total, dtype=bool)
            finished = np.array(whole, dtype=bool)
            ends[last[finished]] = True
            broken[last[~finished]] = True  # whether a sentence would end here isn't known
            keys, flags = [], []
            for key, at in found:
                keep = asked[key >> _U(64 - FILTER_BITS)] & ~broken[at]
                keys.append(key[keep])
                flags.append(ends[at[keep]])
            key, flag = np.concatenate(keys), np.concatenate(flags)
            key, back = np.unique(key, return_inverse=True)
            seen, ended = np.bincount(back, minlength=len(key)), np.bincount(back, weights=flag, minlength=len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(seen.astype(np.int64)), pa.array(ended.astype(np.int64))], names=["context", "seen", "ends"])

    counted = answers.select("answer").mapInArrow(count, "context long, seen long, ends long")
    return counted.groupBy("context").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))


def _ending_elsewhere(answers: DataFrame, judged: DataFrame, words) -> DataFrame:
    """Rows (``row``) whose last words are followed by more, mostly, where they stand in the corpus; or stand nowhere else.

    The share of places at which a sentence ends is that of the longest context, drawn towards those of the shorter
    ones as far as it has been seen seldom.
    """
    wanted = judged.where("contexts is not null").select("row", F.posexplode("contexts").alias("kind", "context")).where("context is not null")
    places = _places(answers, words, wanted.select("context"))
    told = wanted.join(places, "context").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "seen", "ends"))).alias("told"))  # one for a kind at most
    share = F.aggregate("told", F.lit(0.0), lambda share, x: (x["ends"] + SHORTER * share) / (x["seen"] + SHORTER))
    asked = judged.where("contexts is not null").select("row")
    return asked.join(told.select("row", share.alias("share")), "row", "left").where("coalesce(share, 0) < 0.5").select("row")


def shortened_texts(texts: DataFrame) -> DataFrame:
    """The texts (column ``answer``, each once) that another continues inside the sentence at which they stop.

    In order of text, all that begin with a text follow it in one run; a text waits until its run is over. What still
    waits at the end of a part is compared with the parts behind it.
    """
    spark = texts.sparkSession
    ordered = cut(texts.repartitionByRange("answer").sortWithinPartitions("answer").select("answer", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []
        part = None
        for batch in batches:
            found: list[str] = []
            left: list[tuple[str, int]] = []
            for text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != part:
                    left += [(x, part) for x in waiting]
                    waiting, part = [], own
                while waiting and not text.startswith(waiting[-1]):
                    waiting.pop()
                found += [x for x in waiting if continues(x, text)]
                waiting = [x for x in waiting if not continues(x, text)]
                if unfinished(text):
                    waiting.append(text)
            rows = [(x, None) for x in found] + left
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], type=pa.string()), pa.array([p for _, p in rows], type=pa.int32())], names=["answer", "part"])
        yield pa.RecordBatch.from_arrays([pa.array(waiting, type=pa.string()), pa.array([part] * len(waiting), type=pa.int32())], names=["answer", "part"])

    in_order = ordered.repartition("part").sortWithinPartitions("part", "place").select("answer", "part")
    compared = cut(in_order.mapInArrow(compare, "answer string, part int"))
    # of each part, what begins one another waits: a chain, of which few are longer than one
    waiting = compared.where("part is not null").join(ordered.groupBy("part").agg(F.min("answer").alias("first")).select((F.col("part") - 1).alias("part"), "first"), "part")
    crossing = waiting.where(F.col("first").startswith(F.col("answer"))).select("answer").collect()  # a chain per part at most
    held = spark.sparkContext.broadcast(sorted({r["answer"] for r in crossing}))

    def behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {x for text in batch.column(0).to_pylist() for x in held.value if continues(x, text)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), type=pa.string())], names=["answer"])

    out = compared.where("part is null").select("answer")
    return (out.unionByName(ordered.select("answer").mapInArrow(behind, "answer string")) if crossing else out).distinct()


def length_limits(lengths: DataFrame) -> DataFrame:
    """Lengths (``n``) at which far more responses stop than at those around; ``lengths`` has one row per unfinished response."""
    counted = lengths.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    near = counted.select(F.explode(F.sequence(F.col("n") - AROUND, F.col("n") + AROUND)).alias("m"), "n", "k")
    around = near.groupBy("m").agg(F.sum(F.when(F.col("n") == F.col("m"), F.col("k"))).alias("own"), (F.sum(F.when(F.col("n") != F.col("m"), F.col("k")).otherwise(0)) / (2 * AROUND)).alias("mean"))
    mean = F.greatest("mean", F.lit(1.0))
    return around.where(F.col("own") > mean + SPIKE * F.sqrt(mean)).select(F.col("m").alias("n"))


def find_defects(df: DataFrame, id_col: str, question_col: str, response_col: str, with_rule: bool = False) -> DataFrame:
    """Defective pairs: ``id`` and ``defect_type`` (empty_answer, truncated_answer, refusal, copies_question,
    other_language), one row per id; ``with_rule``: also ``rule``, what told it.

    A null response, and JSON without an answer, is an empty answer; JSON that can't be read is truncated.
    A null question has no language and is copied by nothing. Rows with a null id are left out. A repeated
    row counts once; where the rows of an id differ, the least type by name is given. An empty table gives an
    empty result.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).alias("id"), F.col(question_col).cast("string").alias("question"), F.col(response_col).cast("string").alias("data")).where("id is not null")
    kind = source.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [answer_of(x) for x in batch.column(2).to_pylist()]
            states, texts = [s for s, _ in held], [(t or "").encode("utf-8", "replace").decode() if s == "value" else None for s, t in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(states, type=pa.string()), pa.array(texts, type=pa.string())], names=["id", "question", "state", "answer"])

    # a number of parts that is asked for is kept: what follows is work in Python, not bytes, and should be spread
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = source.repartition(parts, "id").dropDuplicates(["id", "question", "data"])
    pairs = cut(once.mapInArrow(read, f"id {kind}, question string, state string, answer string"))
    answers = pairs.where("state = 'value'").select("answer")
    texts = answers.select(F.col("answer").alias("text")).unionAll(pairs.where("question is not null").select("question"))
    words = spark.sparkContext.broadcast(common_words(texts))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Types of defects; of pairs without one whose answer lacks an end, the answer, and if the corpus has to tell
        whether it breaks off, its contexts."""
        own = words.value
        for batch in batches:
            types, open_answers, asked, shapes = [], [], [], []
            for question, state, answer in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                found = judge(state, question, answer, own)
                types.append(found)
                still = found is None and unfinished(answer)
                open_answers.append(answer if still else None)
                ask = still and breaks_off(answer) is None
                asked.append([None] * len(KINDS) if ask else None)
                shapes.append(last_shape(answer, own) if ask else [])
            hashes, last = contexts(shapes)
            rows = [k for k, shape in enumerate(shapes) if shape]
            for c, (key, at) in enumerate(hashes):
                place = np.searchsorted(at, last)
                hit = np.flatnonzero((place < len(at)) & (at[np.minimum(place, max(len(at) - 1, 0))] == last)) if len(at) else []
                for k in hit:
                    asked[rows[k]][c] = int(key[place[k]].view(np.int64))
            keep = pa.array([t is not None or a is not None for t, a in zip(types, open_answers)])
            columns = [batch.column(0), pa.array(types, type=pa.string()), pa.array(open_answers, type=pa.string()), pa.array(asked, type=pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["id", "defect_type", "answer", "contexts"])

    judged = pairs.mapInArrow(classify, f"id {kind}, defect_type string, answer string, contexts array<long>")
    judged = cut(judged.withColumn("row", F.monotonically_increasing_id()).withColumn("n", F.length("answer")))
    still, unsure = judged.where("answer is not null"), judged.where("contexts is not null")
    rule = lambda rows, name: rows.select("id", F.lit("truncated_answer").alias("defect_type"), F.lit(name).alias("rule"))
    found = (
        judged.where("defect_type is not null").select("id", "defect_type", F.lit("alone").alias("rule"))
        .unionByName(rule(still.join(shortened_texts(answers.distinct()), "answer", "left_semi"), "neighbour"))
        .unionByName(rule(still.join(_ending_elsewhere(answers, judged, words), "row", "left_semi"), "masked neighbours"))
        .unionByName(rule(unsure.join(length_limits(unsure.select("n")), "n", "left_semi"), "length limit"))
    )
    chosen = found.groupBy("id").agg(F.min("defect_type").alias("defect_type"), F.min_by("rule", F.struct("defect_type", "rule")).alias("rule"))
    return chosen if with_rule else chosen.drop("rule")
