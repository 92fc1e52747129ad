"""Expressions over texts. Character classes are spelled out, so that results do not depend on regex flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{M}\p{N}_\s]"
#: Patterns of entities and the group that holds the name.
ENTITIES = (
    (r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", 0), (r'"([^"]+)"', 1),
    (r"(?i)\b(?:API|REST|GraphQL|Docker|Kubernetes|Python|Java|ML|AI|RAG|LLM)\b", 0),
)


def nonempty(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def tokens(text: Column, longer_than: int = 2) -> Column:
    """Lower-case words, anything else read as a blank; only words longer than ``longer_than`` characters."""
    words = F.split(F.regexp_replace(F.lower(text), NOT_WORD, " "), r"\s+")
    return F.filter(words, lambda w: F.length(w) > longer_than)


def bare_words(text: Column) -> Column:
    """Lower-case words with punctuation deleted, not replaced."""
    return nonempty(F.split(F.regexp_replace(F.lower(text), NOT_WORD, ""), r"\s+"))


def words(text: Column) -> Column:
    """Words between white space."""
    return nonempty(F.split(text, r"\s+"))


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays without repeats; 0 where both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def sentences(text: Column) -> Column:
    """Sentences by end marks followed by white space, trimmed, without empty ones."""
    return nonempty(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")))


def clean(text: Column) -> Column:
    """Mail addresses, then links, then special characters become blanks; blanks are joined and trimmed."""
    text = F.regexp_replace(text, r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", " ")
    text = F.regexp_replace(text, r"https?://[^\s]+", " ")
    text = F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}_\s.,!?;:()-]", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^ | $", "")


def lead(text: Column, count: int = 3) -> Column:
    """The first sentences, split at blanks behind end marks."""
    return F.array_join(F.slice(F.split(text, r"(?<=[.!?]) +"), 1, count), " ")


def word_prefix(text: Column, limit: int = 100) -> Column:
    """As many words from the start as fit into ``limit`` characters, blanks between them counted."""
    start = F.struct(F.lit("").alias("kept"), F.lit(False).alias("full"))

    def add(state: Column, word: Column) -> Column:
        longer = F.when(state["kept"] == "", word).otherwise(F.concat(state["kept"], F.lit(" "), word))
        fits = ~state["full"] & (F.length(longer) <= limit)
        return F.struct(F.when(fits, longer).otherwise(state["kept"]).alias("kept"), (~fits).alias("full"))

    return F.aggregate(words(text), start, add)["kept"]


def token_estimate(text: Column) -> Column:
    """Tokens as the whole part of 1.3 times the number of words."""
    return F.floor(F.size(words(text)) * F.lit(1.3)).cast("int")


def contains_any(text: Column, terms: list[str]) -> Column:
    return F.lit(False) if not terms else F.greatest(*(text.contains(t).cast("int") for t in [*terms, terms[0]])) == 1


def count_contained(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur in the text."""
    total = F.lit(0)
    for term in terms:
        total = total + text.contains(term).cast("int")
    return total


def strip_markup(html: Column) -> Column:
    """Text of HTML: scripts and styles dropped, tags read as blanks, the common entities resolved."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def entities(col: Column) -> Column:
    """Runs of capitalised words, quoted terms and technical terms of more than two characters, the first ten by name."""
    found = F.concat(*(F.regexp_extract_all(col, F.lit(p), F.lit(g)) for p, g in ENTITIES))
    return F.slice(F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x) > 2))), 1, 10)


def merge_context(content: Column, summary: Column, names: Column) -> Column:
    """A text with a summary of its surroundings and related names behind it; what is empty is left out."""
    about = F.when(F.length(summary) > 0, F.concat(F.lit("\n\n[Contexto do Grafo]\n"), summary))
    related = F.when(F.size(names) > 0, F.concat(F.lit("\nEntidades relacionadas: "), F.array_join(names, ", ")))
    return F.concat_ws("\n", content, about, related)
