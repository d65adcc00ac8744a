"""Text functions as columns: sentences, tokens, normalisation, prompts, tables and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and word characters as Python defines them.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
TOKEN = r"[\p{L}\p{N}_]+"
PASSAGE_PREFIX, QUERY_PREFIX = "passage: ", "query: "


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def split_sentences(text: Column) -> Column:
    """Pieces between line breaks, and after . ! or ? with white space; stripped, never empty. Null gives null."""
    pieces = F.split(text, rf"(?<=[.!?]){SPACE}+|\n+")
    return F.filter(F.transform(pieces, strip), lambda x: x != "")


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def normalize(text: Column) -> Column:
    """White space collapsed to one space, stripped, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, rf"{SPACE}+", " ")))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def preview(text: Column, width: int = 120) -> Column:
    return F.left(F.trim(F.regexp_replace(text, rf"{SPACE}+", " ")), F.lit(width))


def truncate(text: Column, width: int) -> Column:
    return F.substring(text, 1, width)


def hard_split(sentences: Column, size: int, overlap: int) -> Column:
    """Sentences longer than ``size`` become slices of it, each ``size - overlap`` after the last."""
    step = size - overlap

    def slices(s: Column) -> Column:
        last = F.greatest(F.ceil((F.length(s) - size) / F.lit(step)), F.lit(0)).cast("int")
        return F.when(F.length(s) <= size, F.array(s)).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(s, 1 + i * step, F.lit(size))))

    return F.flatten(F.transform(sentences, slices))


def with_prefix(text: Column, model: str, prefix: str) -> Column:
    """Models of the E5 family tell passages from queries by a prefix."""
    return F.concat(F.lit(prefix), text) if "e5" in model.lower() else text


def is_relevant(chunk: Column, sources: Column) -> Column:
    """Whether a normalised source is part of the normalised chunk."""
    own = normalize(chunk)
    return F.exists(sources, lambda s: F.contains(own, normalize(s)))


def pipe_row(cells: Column) -> Column:
    """Cells as a row of a Markdown table; null where all are empty."""
    clean = F.transform(cells, lambda c: F.coalesce(F.trim(F.regexp_replace(c, rf"{SPACE}+", " ")), F.lit("")))
    return F.when(F.exists(clean, lambda c: c != ""), F.concat(F.lit("| "), F.array_join(clean, " | "), F.lit(" |")))


def context_block(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda c, i: F.concat(F.lit("Context "), (i + 1).cast("string"), F.lit(":\n"), c)), "\n\n")


def rag_prompt(question: Column, texts: Column, instruction: str) -> Column:
    return F.concat(F.lit(instruction + "\n\n"), context_block(texts), F.lit("\n\nQuestion: "), question)


def sse_delta(line: Column) -> Column:
    """Text of one server-sent line of a chat stream; null for other lines and for the end mark."""
    body = F.trim(F.substring(line, 6, 1 << 30))
    # try_parse_json gives null where a line is malformed
    content = F.try_variant_get(F.try_parse_json(body), "$.choices[0].delta.content", "string")
    return F.when(F.startswith(line, F.lit("data:")) & (body != "[DONE]") & (content != ""), content)


def cosine(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
