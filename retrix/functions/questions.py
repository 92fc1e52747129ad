"""Classification and routing of questions, as expressions over their text.

Questions are rows, so every rule is a column and a whole table of questions is routed at once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retrix.functions.text import contains_any, count_contained, words

#: Indicator words of the routing rules, in Portuguese, English and Spanish.
SIMPLE_STARTS = ("o que é", "qual é", "quando", "onde", "what is", "cuál es", "cuándo", "dónde")
COMPLEX_WORDS = ("compare", "analise", "explique", "relacione", "explain", "analyze", "analice", "relacione")
TEMPORAL_WORDS = ("quando", "durante", "antes", "depois", "when", "before", "after", "cuando", "después")
AMBIGUOUS_WORDS = ("isso", "aquilo", "coisa", "algo", "it", "this", "that", "eso", "cosa")
REASONING = (
    ("causal", ("por que", "why", "por qué", "causa")),
    ("comparative", ("compar", "diferença", "difference", "diferencia", "versus")),
    ("procedural", ("como", "passos", "how", "steps", "cómo", "pasos")),
    ("temporal", ("quando", "when", "cuándo")),
)
TYPES = (
    ("list", ("liste", "enumere", "list ", "quais")),
    ("definition", ("o que é", "what is", "qual é", "cuál es", "define")),
    ("comparison", ("compare", "diferença", "difference", "versus")),
    ("implementation", ("implementar", "código", "implement", "code", "ligar", "work with", "unir")),
    ("explanation", ("explique", "por que", "explain", "why", "por qué")),
)
BASE_K = {"list": 8, "definition": 3, "comparison": 6, "implementation": 5, "explanation": 5, "analysis": 6}
TASKS = (
    ("code", ("código", "função", "code", "function", "implement")),
    ("analysis", ("analise", "compare", "analyze", "explique", "explain")),
    ("list", ("liste", "enumere", "list ")),
    ("question", ("qual", "what", "which", "cuál", "qué", "o que")),
)
MODELS = (("small", 4_000, 0.2, 3, ("question", "list")), ("medium", 16_000, 1.0, 2, ("question", "list", "analysis")), ("large", 128_000, 5.0, 1, ("question", "list", "analysis", "code")))


def lower(text: Column) -> Column:
    return F.lower(F.trim(text))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def first_match(text: Column, table: tuple, default: str) -> Column:
    """The first label one of whose terms occurs in the text."""
    out = None
    for label, terms in table:
        condition = contains_any(text, list(terms))
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(default)


def question_type(text: Column) -> Column:
    return first_match(lower(text), TYPES, "analysis")


def complexity(text: Column) -> Column:
    """Between 0 and 1: length, clauses, technical words (with an underscore) and question marks."""
    n = word_count(text)
    clauses = F.regexp_count(text, F.lit("[,;:]"))
    technical = F.size(F.filter(words(text), lambda w: w.contains("_")))
    marks = F.regexp_count(text, F.lit(r"\?"))
    value = F.least(n / 50, F.lit(0.3)) + F.least(clauses * 0.1, F.lit(0.2)) + F.least(technical * 0.1, F.lit(0.3)) + F.least(marks * 0.1, F.lit(0.2))
    return F.round(F.least(F.lit(1.0), value), 6)


def optimal_k(kind: Column, c: Column) -> Column:
    base = F.create_map(*(x for k, v in BASE_K.items() for x in (F.lit(k), F.lit(v))))[kind]
    return F.greatest(F.lit(3), F.least(F.lit(15), base + F.floor(c * 3).cast("int")))


def route_class(text: Column) -> Column:
    """simple, single_hop, multi_hop or complex: by the beginning, the length and the number of capitalised words."""
    low, n = lower(text), word_count(text)
    starts = F.greatest(*(low.startswith(s).cast("int") for s in SIMPLE_STARTS)) == 1
    return F.when(starts | (n < 5), "simple").when(contains_any(low, list(COMPLEX_WORDS)), "complex").when(entities(text) >= 3, "multi_hop").otherwise("single_hop")


def entities(text: Column) -> Column:
    """Number of words that begin with a capital letter, up to five."""
    return F.least(F.lit(5), F.size(F.filter(words(text), lambda w: w.rlike(r"^\p{Lu}"))))


def ambiguity(text: Column) -> Column:
    return F.round(F.least(F.lit(1.0), count_contained(lower(text), list(AMBIGUOUS_WORDS)) / F.greatest(word_count(text), F.lit(1))), 6)


def hops(kind: Column, found: Column) -> Column:
    base = F.when(kind == "simple", 1).when(kind == "single_hop", 1).when(kind == "multi_hop", 2).otherwise(3)
    return base + F.greatest(F.lit(0), found - 2)


def strategies(kind: Column, temporal: Column, unclear: Column) -> Column:
    """Up to three strategies by class, with the graph for questions of time and correction for unclear ones."""
    base = F.when(kind == "simple", F.array(F.lit("direct"))).when(kind == "single_hop", F.array(F.lit("standard"), F.lit("multi_query"))).when(kind == "multi_hop", F.array(F.lit("graph"), F.lit("multi_query"))).otherwise(F.array(F.lit("multi_head"), F.lit("graph")))
    more = F.when(temporal, F.array(F.lit("graph"))).otherwise(F.array().cast("array<string>"))
    most = F.when(unclear > 0.3, F.array(F.lit("corrective"))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(base, more, most)), 1, 3)


def monitor_route(text: Column) -> Column:
    """vector_only, hybrid or graph by points: 2 for more than ten words, 3 for complex words, -2 for simple ones."""
    low = lower(text)
    points = F.when(word_count(text) > 10, 2).otherwise(0) + F.when(contains_any(low, list(COMPLEX_WORDS)), 3).otherwise(0) - F.when(contains_any(low, list(SIMPLE_STARTS)), 2).otherwise(0)
    return F.when(points <= 0, "vector_only").when(points >= 3, "graph").otherwise("hybrid")


def decomposition_class(text: Column) -> Column:
    n = word_count(text)
    joins = F.regexp_count(lower(text), F.lit(r" (?:e|and|y|ou|or|mas|but|pero) "))
    return F.when(n < 5, "simple").when((n < 15) & (joins < 2), "medium").when((joins >= 2) | (F.regexp_count(text, F.lit(r"\?")) > 1), "multi_aspect").otherwise("complex")


def improvements(text: Column) -> Column:
    """Improvements that a question calls for."""
    low = lower(text)
    named = F.array(
        F.lit("adaptive"), F.when((word_count(text) > 10) | low.rlike(r"\?."), "multi_query"), F.when(contains_any(low, ["certeza", "sure", "seguro"]), "corrective"),
        F.when(contains_any(low, ["relação", "depende", "relation", "depend"]), "graph"),
    )
    return F.array_compact(named)


def task(text: Column) -> Column:
    return first_match(lower(text), TASKS, "general")


def tasks(text: Column) -> Column:
    """All tasks whose words occur."""
    low = lower(text)
    return F.array_compact(F.array(*(F.when(contains_any(low, list(terms)), label) for label, terms in TASKS)))


def cheapest_model(kind: Column, context: Column) -> Column:
    """The cheapest model that takes a task and a context; the largest where none does."""
    out = None
    for name, window, _, _, capable in sorted(MODELS, key=lambda m: m[2]):
        condition = kind.isin(*capable) & (context <= window)
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise("large")


#: Words and those that mean the same; what pads variations of a question; strategies by name.
SYNONYMS = {
    "função": ("function", "método", "procedimento"), "classe": ("class", "objeto", "tipo"), "código": ("code", "script", "programa"),
    "erro": ("error", "bug", "falha", "problema"), "dados": ("data", "informação", "dataset"),
}
PADDING = ("com exemplos práticos", "explicação detalhada", "casos de uso")
MOST_STRATEGIES = 5


def synonyms(terms: Column) -> Column:
    """All words that mean the same as one of an array of words, in their order."""
    table = F.create_map(*(x for word, same in SYNONYMS.items() for x in (F.lit(word), F.array(*map(F.lit, same)))))
    return F.flatten(F.transform(terms, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>"))))


def expanded(text: Column) -> Column:
    """The question with the synonyms of its words behind it, if there are any."""
    more = synonyms(words(lower(text)))
    return F.when(F.size(more) > 0, F.concat(text, F.lit(" "), F.array_join(more, " "))).otherwise(text)


def replaced(text: Column) -> Column:
    """The question once more for each word that has a synonym, with the first of them in its place."""
    table = F.create_map(*(x for word, same in SYNONYMS.items() for x in (F.lit(word), F.lit(same[0]))))
    ws = words(text)
    places = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda k: F.try_element_at(table, F.lower(F.get(ws, k))).isNotNull())
    one = lambda k: F.array_join(F.transform(ws, lambda w, j: F.when(j == k, F.try_element_at(table, F.lower(w))).otherwise(w)), " ")
    return F.when(F.size(ws) > 0, F.transform(places, one)).otherwise(F.array().cast("array<string>"))


def clauses(text: Column) -> Column:
    """Clauses between marks and conjunctions, of more than two words; a rule in place of a parser."""
    parts = F.split(text, r"\s*[,;:.?!¿¡]+\s*|\s+(?:e|and|y|ou|or|mas|but|pero)\s+")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.size(words(x)) > 2)


def enhanced(text: Column, most: int = 5) -> Column:
    """The question, those with synonyms and its clauses, each once, up to ``most``."""
    return F.slice(F.array_distinct(F.concat(F.array(text), replaced(text), clauses(text))), 1, most)


def numbered_lines(response: Column) -> Column:
    """Lines of a response without their numbering, of more than ten characters."""
    strip = lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+", ""), r"\s+$", "")
    lines = F.transform(F.split(strip(response), "\n"), lambda x: strip(F.regexp_replace(strip(x), r"^[0-9]+[.)\s-]+", "")))
    return F.filter(lines, lambda x: F.length(x) > 10)


def variations(response: Column, count: int = 3) -> Column:
    """The numbered lines of a response, filled up with general variations of its first sentence."""
    base = F.get(F.split(response, r"\."), F.lit(0))
    padded = F.array(*(F.concat(base, F.lit(f" {x}")) for x in PADDING))
    return F.slice(F.concat(numbered_lines(response), padded), 1, count)


def parallel_strategies(text: Column, fastest: Column) -> Column:
    """standard, more for code and for complex questions, then the fastest so far, each once, up to five."""
    low = F.lower(text)
    inner = F.substring(text, F.lit(1), F.greatest(F.length(text) - 1, F.lit(0)))
    none = F.array().cast("array<string>")
    code = F.when(low.contains("code") | low.contains("function"), F.array(F.lit("code_specific"))).otherwise(none)
    hard = F.when((word_count(text) > 20) | inner.contains("?"), F.array(F.lit("multi_query"), F.lit("graph_enhanced"))).otherwise(none)
    return F.slice(F.array_distinct(F.concat(F.array(F.lit("standard")), code, hard, fastest)), 1, MOST_STRATEGIES)


def match_explanation(dense: Column, lexical: Column, found: Column) -> Column:
    """Why a text was found: bands of its scores and the keywords it holds."""
    parts = F.array_compact(
        F.array(
            F.when(dense > 0.8, "Alta similaridade semântica").when(dense > 0.6, "Similaridade semântica moderada"),
            F.when(lexical > 0.5, "Forte match de keywords").when(lexical > 0.2, "Match parcial de keywords"),
            F.when(F.size(found) > 0, F.concat(F.lit("Keywords encontradas: "), F.array_join(found, ", "))),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("Match geral")


def combined_answer(answers: Column, reasoning: Column) -> Column:
    """Several answers as one: set side by side for comparisons, else one after another."""
    numbered = F.transform(answers, lambda a, k: F.concat(F.lit("Perspectiva "), (k + 1).cast("string"), F.lit(": "), a))
    compared = F.concat(F.lit("Comparando as informações:\n\n"), F.array_join(numbered, "\n\n"))
    return F.when(reasoning == "comparative", compared).otherwise(F.concat(F.lit("Síntese das informações encontradas:\n\n"), F.array_join(answers, " ")))


#: Marks of a model's lines, the kind of clue they give and its score.
CLUES = (("CONCEITO:", "concept", 0.9), ("ENTIDADES:", "entity", 0.85))


def marked_clues(response: Column) -> Column:
    """Clues in the marked lines of a response: ``kind``, ``clue`` and ``score``."""
    one = lambda line: F.array_compact(
        F.array(*(F.when(line.startswith(mark), F.struct(F.lit(kind).alias("kind"), F.trim(F.replace(line, F.lit(mark))).alias("clue"), F.lit(score).alias("score"))) for mark, kind, score in CLUES))
    )
    return F.flatten(F.transform(F.split(response, "\n"), one))
