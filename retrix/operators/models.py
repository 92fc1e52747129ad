"""The boundary to learned models: small interfaces, and defaults that are the same in every run."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSION = 64
_WORD = re.compile(r"\w+")

Embedder = Callable[[Sequence[str]], np.ndarray]
Generator = Callable[[str], str]
Scorer = Callable[[str, str], float]


def hash_vector(text: str, dimension: int = DIMENSION) -> np.ndarray:
    """Unit vector of a text by the hashing trick over its lower-case words; zero where there are none."""
    vector = np.zeros(dimension)
    for word in _WORD.findall(text.lower()):
        code = xxhash.xxh3_64_intdigest(word)
        vector[code % dimension] += 1.0 if code >> 63 else -1.0
    size = np.linalg.norm(vector)
    return vector / size if size else vector


def hash_embedder(texts: Sequence[str]) -> np.ndarray:
    return np.stack([hash_vector(t or "") for t in texts]) if len(texts) else np.zeros((0, DIMENSION))


def embed(text: Column, model: Embedder = hash_embedder) -> Column:
    """Vectors of a column of texts, a batch at a time; a null text has no words."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(model(batch.fillna("").tolist())))

    return run(text)


def lexical_score(question: str, text: str) -> float:
    """Share of the question's words that the text has: the default in place of a cross-encoder."""
    asked = set(_WORD.findall(question.lower()))
    return len(asked & set(_WORD.findall(text.lower()))) / len(asked) if asked else 0.0


def cross_score(question: Column, text: Column, model: Scorer = lexical_score) -> Column:
    @F.pandas_udf("double")
    def run(questions: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([model(q or "", t or "") for q, t in zip(questions, texts)])

    return run(question, text)


def template_answer(prompt: str) -> str:
    """The default in place of a generator: the first sentences of the prompt's context."""
    body = prompt.split("\n\n", 1)[-1]
    return " ".join(re.split(r"(?<=[.!?])\s+", body)[:2])


#: What variations of a question add to it.
VARIANTS = (": exemplos", ": detalhes", ": passos")


def query_variants(question: Column, count: int = 3) -> Column:
    """The question and variations of it by fixed templates, as an array."""
    base = F.regexp_replace(question, r"[?. ]+$", "")
    return F.array(question, *(F.concat(base, F.lit(x)) for x in VARIANTS[:count]))


#: Labels of contents, the first of which is the default, and words that speak for them.
LABELS = {
    "technology": "api app banco cache cliente code codec código computer computador dados data database deploy device docker erro error função function gateway hardware index json latência latency log método model modelo network python query rede rest script server servidor sistema software system sistema token usuario usuário vector vetor web",
    "finance": "account ativo bank banco bolsa budget capital cash cost costo crédito credit custo débito despesa dinero dinheiro dividend empréstimo expense factura fatura finance finanças fondo fundo gasto impuesto imposto interest inversión investimento invoice juros loan lucro market mercado money orçamento payment pagamento pago precio preço price profit receita revenue stock tax",
    "health": "care clínica clinic cuidado disease doctor doença droga dose dosis enfermedad enfermeiro enfermera exame fever febre fiebre health hospital medicine medicina médico nurse paciente patient remédio salud saúde sintoma symptom surgery cirurgia cirugía therapy terapia tratamento treatment vaccine vacina vacuna virus vírus",
    "education": "alumno aluno aprender aprendizado aprendizaje aula class classe clase colegio college course curso degree education educação educación ensino enseñanza escola escuela estudante estudiante exam exercise exercício ejercicio faculdade guia guía learn lesson lição lección manual professor profesor school student study estudo estudio teacher university universidade universidad",
    "entertainment": "actor ator arte art artista artist banda band cine cinema concert concerto concierto dance dança danza episode episódio festival film filme game jogo juego movie music música novela palco película play radio rádio série series show song canção canción stage teatro theater televisão televisión television video vídeo",
    "legal": "abogado advogado acuerdo acordo agreement artigo artículo cláusula clause constitution constituição contrato contract corte court crime crimen derecho direito juez juiz judge justice justiça justicia law lawyer legal lei ley license licença licencia norma penal policy processo proceso regulation regulamento reglamento right sentença sentencia tribunal",
}


def label_of(text: Column) -> Column:
    """The label most of whose words a whole text has, and its share of all such words; the default and 0.5 where it
    has none. The rule stands where a zero-shot classifier can be put."""
    held = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    counts = {label: F.size(F.array_intersect(held, F.array(*map(F.lit, sorted(set(terms.split())))))) for label, terms in LABELS.items()}
    most, total, best = F.greatest(*counts.values()), sum(counts.values()), None
    for label, count in counts.items():
        best = F.when(count == most, label) if best is None else best.when(count == most, label)
    none = F.coalesce(most, F.lit(0)) == 0
    return F.struct(F.when(none, next(iter(LABELS))).otherwise(best).alias("label"), F.when(none, 0.5).otherwise(most / total).alias("confidence"))


def content_label(text: Column, model: Callable[[str], tuple[str, float]] | None = None) -> Column:
    """Label and confidence of every text: by the words of whole texts, or by a classifier that is given."""
    if model is None:
        return label_of(text)

    @F.pandas_udf("label string, confidence double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model(t or "") for t in texts], columns=["label", "confidence"])

    return run(text)


def generate(prompt: Column, model: Generator) -> Column:
    """The generator's answers to a column of prompts, a batch at a time; a null prompt has none."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda p: None if p is None else model(p))

    return run(prompt)


def find_entities(text: str) -> list[tuple[str, str, int, int]]:
    """Text, label, start and end of names, numbers and quoted terms: the default in place of a tagger."""
    out = []
    for label, pattern in (("NAME", r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)*\b"), ("NUMBER", r"\b\d+(?:[.,]\d+)*\b"), ("QUOTED", r"\"[^\"\n]{2,60}\"")):
        out += [(m.group(), label, m.start(), m.end()) for m in re.finditer(pattern, text)]
    return sorted(out, key=lambda x: x[2])


def tagged(text: Column, model: Callable[[str], list] = find_entities) -> Column:
    @F.pandas_udf("array<struct<text:string,label:string,start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"text": a, "label": b, "start": c, "end": d} for a, b, c, d in model(t or "")] for t in texts])

    return run(text)
