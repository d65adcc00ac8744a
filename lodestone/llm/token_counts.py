"""Edit-aware token counts.

For each document a segment tree is kept over its pre-token segments, white space and the word after
it: every node holds the tokens and the code points below it. ``build`` encodes whole texts once and
gives a table with each document's leaves, which is stored; ``apply`` reads that table, never the
tokenizer for what no edit touches, and gives the table of the edited documents, which can be stored and
edited again. An edit (start, end, text) descends by code points to the segments that it touches, takes
one more on either side as context, encodes that region alone and stores it in the first of them, the
others become empty, and the sums above are updated: encoding grows with the edits, not with the
document. A region of more than REBUILD characters or of many leaves is cut into segments of its own, which
replace its leaves; the sums are then added up anew, without encoding anything else.

White space always ends a pre-token of the tokenizer, so a region between segment borders encodes as it
does inside the whole text; tests compare every count with encoding the edited text whole.

Defined results: null is empty and has 0 tokens; offsets beyond the text are cut to its end, and an end
before its start means an insertion; edits apply one after another; a null list of edits is none, a null
text of an edit is empty; repeated rows are each counted; an empty table gives an empty table; input columns
that are named like those that an operator adds are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACES, Workspace, chunks, map_arrow, word_spans
from lodestone.llm.token_output import WordEncoder, default_tokenizer, encoder_of

REBUILD = 4096
EDITS = "array<struct<start:bigint,end:bigint,text:string>>"
LEAVES = ("tree_chars", "tree_tokens")  # code points and tokens of each segment, as 32-bit integers


def leaves(encoder: WordEncoder, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(code points, tokens) of each row's segments. All words of a step are looked up or encoded together."""
    for a, b, flat, offsets in chunks(column):
        starts, ends, first = word_spans(flat, offsets, SPACES)
        tokens = encoder.sizes(flat, offsets, starts, ends)
        points = np.append(0, np.cumsum((flat & 0xC0) != 0x80))
        for i in range(b - a):
            # a segment ends with its word; what follows the last word is one more
            edge = np.concatenate(([offsets[i]], ends[first[i] : first[i + 1]], [offsets[i + 1]]))
            yield np.diff(points[edge]), np.append(tokens[first[i] : first[i + 1]], 0)


class Tree:
    """Sums over segments. ``base`` is the document as the leaves were cut; a replaced segment keeps its own text."""

    def __init__(self, encoder: WordEncoder, base: str, chars: np.ndarray, tokens: np.ndarray):
        self.encoder, self.encoded = encoder, 0  # code points that edits have encoded
        self.plant(base, chars, tokens)

    def plant(self, base: str, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.base, self.own = base, {}
        self.begin = np.append(0, np.cumsum(chars))  # of each segment in ``base``
        self.width = 1 << max(0, (len(chars) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        self.sums[self.width : self.width + len(chars), 0] = tokens
        self.sums[self.width : self.width + len(chars), 1] = chars
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 0])

    @property
    def length(self) -> int:
        return int(self.sums[1, 1])

    @property
    def text(self) -> str:
        return self.between(0, self.width) if self.own else self.base

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """(code points, tokens) of the segments with text."""
        own = self.sums[self.width :]
        own = own[own[:, 1] > 0]
        return own[:, 1], own[:, 0]

    def between(self, first: int, end: int) -> str:
        """Text of the segments first:end; those that no edit has touched come in one piece."""
        out, at = [], first
        for i in sorted(i for i in self.own if first <= i < end):
            out += [self.untouched(at, i), self.own[i]]
            at = i + 1
        return "".join([*out, self.untouched(at, end)])

    def untouched(self, first: int, end: int) -> str:
        last = len(self.begin) - 1
        return self.base[self.begin[min(first, last)] : self.begin[min(end, last)]]

    def find(self, place: int) -> tuple[int, int]:
        """Segment that holds the code point, and the code points before the segment."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if place - before >= self.sums[node, 1] and self.sums[node + 1, 1]:
                before += int(self.sums[node, 1])
                node += 1
        return node - self.width, before

    def edit(self, start: int, end: int, text: str) -> None:
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        first, before = self.find(start)
        if before:  # the segment with text before it
            first, before = self.find(before - 1)
        last, after = self.find(max(start, end - 1))
        after += int(self.sums[self.width + last, 1])
        if after < self.length:
            last, _ = self.find(after)
        old = self.between(first, last + 1)
        new = old[: start - before] + text + old[end - before :]
        self.encoded += len(new)
        if len(new) > REBUILD or last - first > REBUILD // 8:
            chars, tokens = next(leaves(self.encoder, pa.array([new])))
            whole = self.sums[self.width :]
            spliced = [np.concatenate((whole[:first, j], x, whole[last + 1 :, j])) for j, x in ((0, tokens), (1, chars))]
            some = spliced[1] > 0
            return self.plant(self.between(0, first) + new + self.between(last + 1, self.width), spliced[1][some], spliced[0][some])
        count = len(self.encoder.tokenizer.encode(new, add_special_tokens=False).ids)
        for i in range(first, last + 1):
            self.own[i] = new if i == first else ""
            self.set(i, (count, len(new)) if i == first else (0, 0))

    def set(self, i: int, values: tuple[int, int]) -> None:
        node = self.width + i
        if tuple(self.sums[node]) == values:
            return
        self.sums[node] = values
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]


def schema_of(df: DataFrame, added: dict[str, str]) -> tuple[list[str], str]:
    """Columns of ``df`` that are none of ``added``, and the schema of both."""
    keep = [f for f in df.schema if f.name not in added]
    return [f.name for f in keep], ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), *(f"{n} {t}" for n, t in added.items())])


def build(docs: DataFrame, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``docs`` with each document's leaves and n_tokens. The only step that encodes whole texts."""
    path = tokenizer or default_tokenizer()
    names, schema = schema_of(docs, {"tree_chars": "binary", "tree_tokens": "binary", "n_tokens": "long"})
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            rows = [(c.astype(np.int32).tobytes(), t.astype(np.int32).tobytes(), int(t.sum())) for c, t in leaves(encoder, batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.binary(), pa.binary(), pa.int64())))], [*names, *LEAVES, "n_tokens"])

    return map_arrow(docs.select(*[F.col(f"`{n}`") for n in names]), run, schema)


def apply(trees: DataFrame, edits: str, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """A table of ``build`` or of this function after the edits in the column ``edits`` (start, end, text), in code points and in order.

    Texts, leaves and n_tokens are those of the edited documents; n_segments counts leaves with text, and chars_encoded the code points
    that went to the tokenizer. The column of edits is dropped.
    """
    path = tokenizer or default_tokenizer()
    added = {text: "string", "tree_chars": "binary", "tree_tokens": "binary", "n_tokens": "long", "n_segments": "long", "chars_encoded": "long"}
    names, schema = schema_of(trees.drop(edits), added)
    given = F.coalesce(F.col(f"`{edits}`").cast(EDITS), F.array().cast(EDITS)).alias("__edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for batch in batches:
            out = []
            for base, chars, tokens, own in zip(*(batch.column(len(names) + j).to_pylist() for j in range(4)), strict=True):
                own = [e for e in own if e is not None]
                tree = Tree(encoder, base or "", np.frombuffer(chars, np.int32), np.frombuffer(tokens, np.int32))
                for e in own:
                    tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                c, t = tree.kept()
                out.append((tree.text if own else base, c.astype(np.int32).tobytes(), t.astype(np.int32).tobytes(), tree.tokens, len(c), tree.encoded))
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array([x[j] for x in out], t) for j, t in enumerate(kinds))], [*names, *added])

    return map_arrow(trees.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{text}`").alias("__text"), *LEAVES, given), run, schema)


def count(docs: DataFrame, edits: str | None = None, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``docs`` without texts and edits, with n_tokens, n_tokens_edited, n_segments and chars_encoded. The trees are stored between."""
    given = docs if edits else docs.withColumn("__given", F.lit(None).cast(EDITS))
    own = edits or "__given"
    kept = Workspace(docs.sparkSession, "token-trees").save(build(given, text, tokenizer).withColumn("__before", F.col("n_tokens")), "trees")
    names = [c for c in docs.columns if c not in (text, edits, "n_tokens", "n_tokens_edited", "n_segments", "chars_encoded", *LEAVES)]
    after = apply(kept, own, text, tokenizer)
    return after.select(*[F.col(f"`{n}`") for n in names], F.col("__before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_segments", "chars_encoded")


def with_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` or a table of trees with the edits (key, seq, start, end, text) of a table as a column ``edits``, in order of seq.

    One document's edits are gathered in one row; they go to the documents by a shuffle of both sides.
    """
    per = edits.groupBy(F.col(key).alias("__key")).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "start", "end", "text"))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"))).alias("__edits"))
    return docs.drop("edits").join(per.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key").withColumnRenamed("__edits", "edits")


def sample_edits(docs: DataFrame) -> DataFrame:
    """doc_id, text and three edits at stated places: words put in the middle, ten characters cut out at a quarter, a new first word."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    edit = lambda a, b, t: F.struct(a.alias("start"), b.alias("end"), F.lit(t).alias("text"))
    zero = F.lit(0).cast("long")
    return docs.select("doc_id", "text", F.array(edit(F.floor(n / 2), F.floor(n / 2), " two words"), edit(F.floor(n / 4), F.floor(n / 4) + 10, ""), edit(zero, zero, "First, ")).alias("edits"))


def count_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_tokens, n_tokens_edited, n_segments, chars_encoded, with the edits of ``sample_edits``."""
    return count(sample_edits(docs), "edits")
