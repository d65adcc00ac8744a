"""N-gram Jaccard join: documents whose sets of 5-word shingles have a similarity of 3/4 or more.

Method: filters under several global token orders are intersected before anything is verified.
A link of a and b needs |a & b| >= ceil(3/4 |a|), so under any global order of all tokens the
(n - ceil(3n/4) + m) first tokens of each hold the m first common ones. The orders are

* H, a hash: its prefixes, lengthened by m = 5 % of the set, are exchanged once; a text fewer of
  whose prefix tokens than that occur in another text has no partner and goes no further; of those left
  the whole sets are exchanged in the same way, and 3/4 of a text's tokens must occur in other texts;
* A and B, two other hashes: their first tokens make star links inside groups of copies, and
  every later candidate pair must also share tokens of both prefixes;
* C, number of components that hold a token, rare first: it completes the links between the
  components found so far. A token of one component only comes first and makes no pair, so a large
  group of near copies costs nothing here, and very common passages come last.

The links between components are completed in rounds. In a round each component proposes, out of the
pairs with other components that share a token of both prefixes under C and that sizes, counts of shared tokens and 1024-bit
parity sketches allow, its few most similar ones that were not tried before; they are verified on the whole sets
and the components contract. The number proposed grows by GROWTH from round to round, and the rounds end when
no component has an untried pair left: so every pair between two components of the result has been
verified or ruled out by a bound, while a group of copies that grow together costs a few pairs each.
The pairs that are looked at meet inside tasks; classes of a token that more than HOT hold are dealt over many
tasks, those of its largest component against those of the others.

Texts with equal sets are one class (64-bit hash of the set; two of n different classes fall
together with a chance below n**2 / 2**57, and below n**2 / 2**65 unless the texts' words differ in bytes 128 apart only).
Classes, not documents, are compared, so a group of copies costs one row each. For components, pairs inside
one that is connected already are not verified: they cannot change it. ``every_link`` leaves none out: under order C
each class is then a component of its own, so all pairs that share a token of their prefixes are candidates, and hot
tokens are dealt over many tasks.

Defined results: null and empty texts (no words) have no shingles, are linked with nothing and are
their own component; fewer than five words are one shingle; rows repeated or with equal text are one
class; a null doc_id keeps its row and is never a component's name unless all its members are null.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, MULT, SPACES, Workspace, chunks, components, grams, map_arrow, mix, parallelism, steps, word_hashes, word_spans

WORDS = 5
LOW = np.uint64(0xFFFFFFFF)  # of a token, in the first exchange: within one part; two that fall together let a text pass, never drop it
EXTRA = 20  # order H: prefixes are longer by a part of 1 / EXTRA of the set
HELD = 1_000_000  # prefix tokens of order H that a task gathers before it sends them
HOME = 50_000  # documents whose counts of shared tokens are added up together
FILTER_BITS = (16, 28)  # binary logarithms of the least and the largest filter for choosing texts
SKETCH = 1024
HOT = 2_000  # classes of one token that a task pairs with others
FIRST, GROWTH = 2, 8  # pairs that a component proposes in the first round, and how that grows
PAIRS = 1 << 17  # pairs that one vectorised step looks at
ORDER_A, ORDER_B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def least(n: np.ndarray) -> np.ndarray:
    """Tokens that a partner must share with a set of n: ceil(3n / 4)."""
    return (3 * n + 3) // 4


def order(tokens: np.ndarray, salt: np.uint64) -> np.ndarray:
    return mix(tokens ^ salt)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted set of each text's shingle hashes."""
    for a, b, flat, offsets in chunks(column):
        flat = LOWER[flat]
        starts, ends, first = word_spans(flat, offsets, SPACES)
        words = word_hashes(flat, starts, ends)
        fives = grams(words, WORDS)
        for i in range(b - a):
            n = first[i + 1] - first[i]
            if n >= WORDS:
                s = np.sort(fives[first[i] : first[i + 1] - WORDS + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            else:
                yield grams(words[first[i] : first[i + 1]], int(n)) if n else words[:0]


def class_of(s: np.ndarray) -> int:
    """Hash of a set, as a signed 64-bit integer; 0 for the empty set."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        both = mix(np.array([np.add.reduce(mix(s)) + np.uint64(len(s)) * MULT], np.uint64))
    return int(both.view(np.int64)[0])


PROFILE = "part int, doc_id long, th long, cls long, n long, hits long, toks binary, owners binary, counts binary"


def profile(docs: DataFrame, doc_id: str, text: str, parts: int, alive: DataFrame | None = None) -> DataFrame:
    """One pass over the texts: a row for each document (class, n), the tokens of H's prefixes by ``part``, and hits found within a task.

    ``alive``: then only these classes' documents (doc_id, th) and few others are read, their whole sets are told, and documents get no rows.
    Of a token that several classes of a task hold only two go on, which tells all others that it is shared;
    the rest have their hit at once. So a token that a third of all texts hold is a few rows a task.
    """
    names = [x.split()[0] for x in PROFILE.split(", ")]
    wanted = None if alive is None else docs.sparkSession.sparkContext.broadcast(bitmap(alive.select(F.xxhash64("doc_id", "th").alias("h"))))

    def rows(**given: pa.Array) -> pa.RecordBatch:
        n = len(given["part"])
        kinds = {"part": pa.int32(), "toks": pa.binary(), "owners": pa.binary(), "counts": pa.binary()}
        return pa.RecordBatch.from_arrays([given.get(x, pa.nulls(n, kinds.get(x, pa.int64()))) for x in names], names)

    def exchanged(held: list[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        own = np.fromiter((c for _, c in held), np.int64)
        row = np.repeat(np.arange(len(held)), np.fromiter((len(t) for t, _ in held), np.int64))
        tokens = np.concatenate([t for t, _ in held])
        part = (order(tokens, MULT) % np.uint64(parts)).astype(np.int64)
        tokens &= LOW
        at = np.lexsort((row, tokens, part))
        tokens, part, row = tokens[at], part[at], row[at]
        new = np.append(True, (tokens[1:] != tokens[:-1]) | (part[1:] != part[:-1]))
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        owner = np.cumsum(np.append(True, (row[1:] != row[:-1]) | new[1:]))
        place = owner - owner[first]  # 0 and 1 for a token's first two owners
        cls, hits = np.unique(own[row[place > 1]], return_counts=True)
        if len(cls):
            yield rows(part=pa.array(np.arange(len(cls)) % parts, pa.int32()), cls=pa.array(cls), hits=pa.array(hits))
        tokens, part, row = (x[place <= 1] for x in (tokens, part, row))
        at = np.lexsort((row, part))
        tokens, part, row = tokens[at], part[at], row[at]
        cut = np.searchsorted(part, np.arange(parts + 1))
        out = []
        for p in np.flatnonzero(cut[1:] > cut[:-1]):
            r, counts = np.unique(row[cut[p] : cut[p + 1]], return_counts=True)
            out.append((p, tokens[cut[p] : cut[p + 1]].astype(np.uint32).tobytes(), own[r].tobytes(), counts.astype(np.int32).tobytes()))
        yield rows(part=pa.array([x[0] for x in out], pa.int32()), **{n: pa.array([x[j] for x in out], pa.binary()) for j, n in ((1, "toks"), (2, "owners"), (3, "counts"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        held_tokens, told = 0, set()
        for batch in batches:
            classes, sizes = [], []
            if wanted is not None:
                batch = batch.filter(in_filter(wanted.value, batch.column(3)))
            for s in shingle_sets(batch.column(1)):
                c, n = class_of(s), len(s)
                classes.append(c)
                sizes.append(n)
                if n and c not in told:  # equal texts of one task are told once
                    told.add(c)
                    h = s[: n - (3 * n + 3) // 4 + n // EXTRA + 1] if wanted is None else s
                    held.append((h, c))
                    held_tokens += len(h)
            if wanted is None:
                yield rows(part=pa.array(np.arange(batch.num_rows) % parts, pa.int32()), doc_id=batch.column(0), th=batch.column(2), cls=pa.array(classes, pa.int64()), n=pa.array(sizes, pa.int64()))
            if held_tokens > HELD:
                yield from exchanged(held)
                held, held_tokens = [], 0
        if held:
            yield from exchanged(held)

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    return map_arrow(given.withColumn("h", F.xxhash64("doc_id", "th")), run, PROFILE)


def shared(rows: DataFrame, homes: int) -> DataFrame:
    """Rows of documents pass; beside them, packed by ``home``, classes and how many of their tokens another class holds too.

    Hits of a class whose equal texts lie in several tasks may be counted once for each: that lets it pass, too.
    """
    names = ["doc_id", "th", "cls", "n"]

    def run(table: pa.Table) -> pa.Table:
        packed = table.filter(table.column("toks").is_valid())
        rest = table.filter(table.column("toks").is_null())
        known = rest.filter(rest.column("hits").is_valid())
        tokens = column(packed, "toks", np.uint32)
        owners = np.repeat(column(packed, "owners"), column(packed, "counts", np.int32))
        at = np.lexsort((owners, tokens))
        tokens, owners = tokens[at], owners[at]
        number, _ = runs(tokens)
        new = np.append(np.ones(min(1, len(tokens)), bool), (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1]))
        cls, hits = np.unique(owners[np.bincount(number[new])[number] > 1], return_counts=True)
        cls, hits = np.append(cls, known.column("cls").to_numpy()), np.append(hits, known.column("hits").to_numpy()).astype(np.int64)
        home = (mix(cls.view(np.uint64)) % np.uint64(homes)).astype(np.int64)
        at = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[at], np.arange(homes + 1))
        some = np.flatnonzero(cut[1:] > cut[:-1])
        parts = [at[cut[h] : cut[h + 1]] for h in some]
        docs = rest.filter(rest.column("hits").is_null()).select(names)
        none = pa.nulls(len(some), pa.int64())
        told = pa.table([none] * 4 + [pa.array(some, pa.int32()), pa.array([cls[x].tobytes() for x in parts], pa.binary()), pa.array([hits[x].tobytes() for x in parts], pa.binary())], [*names, "home", "classes", "hits"])
        return pa.concat_tables([docs.append_column("home", pa.nulls(docs.num_rows, pa.int32())).append_column("classes", pa.nulls(docs.num_rows, pa.binary())).append_column("hits", pa.nulls(docs.num_rows, pa.binary())), told])

    return rows.groupBy("part").applyInArrow(run, "doc_id long, th long, cls long, n long, home int, classes binary, hits binary")


def summed(packed: DataFrame) -> DataFrame:
    """(cls, hits) of the packed rows of ``shared``."""

    def run(table: pa.Table) -> pa.Table:
        cls, which = np.unique(column(table, "classes"), return_inverse=True)
        return pa.table({"cls": pa.array(cls), "hits": pa.array(np.bincount(which, column(table, "hits"), len(cls)).astype(np.int64))})

    return packed.where("home IS NOT NULL").select("home", "classes", "hits").groupBy("home").applyInArrow(run, "cls long, hits long")


def column(table: pa.Table, name: str, kind: type = np.int64) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()] or [np.zeros(0, kind)])


def runs(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted tokens: number of the run that each is in, and the runs' lengths."""
    number = np.cumsum(np.append(0, tokens[1:] != tokens[:-1])) if len(tokens) else np.zeros(0, np.int64)
    return number, np.bincount(number)


def bitmap(keys: DataFrame) -> np.ndarray:
    """A filter with the bits of the hashes in ``keys`` (h) set, sixteen bits a key up to the largest filter, in words of 64."""
    low, high = FILTER_BITS
    bits = min(high, max(low, (16 * keys.count()).bit_length()))
    words = keys.groupBy(F.shiftrightunsigned("h", 70 - bits).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, CAST(shiftrightunsigned(h, {64 - bits}) & 63 AS int)))").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def in_filter(words: np.ndarray, hashes: pa.Array) -> pa.Array:
    """Which of the hashes have their bit set in a ``bitmap``."""
    h = hashes.to_numpy().view(np.uint64) >> np.uint64(59 - len(words).bit_length())
    return pa.array((words[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63)) & np.uint64(1)).astype(bool))


def sets_of(docs: DataFrame, doc_id: str, text: str, chosen: DataFrame) -> DataFrame:
    """(cls, n, toks, sketch) of the chosen documents (doc_id, th) and of few others.

    The texts are not shuffled: a filter of at most 32 MB goes to them. Far above 2**24 chosen
    documents it lets more pass than are chosen, which costs room and changes no result.
    """
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(bitmap(chosen.select(F.xxhash64("doc_id", "th").alias("h"))))
    keyed = docs.select(F.col(text).alias("text"), F.xxhash64(F.col(doc_id).cast("long"), F.xxhash64(text)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(0).filter(in_filter(wanted.value, batch.column(1)))))
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary())], ["cls", "n", "toks", "sketch"])

    return map_arrow(keyed, run, "cls long, n long, toks binary, sketch binary").where("n > 0")


def sketch(s: np.ndarray) -> bytes:
    """SKETCH bits, each the parity of how many tokens fall on it: sketches of sets differ in at most as many bits as the sets in tokens."""
    bit = (order(s, ORDER_A ^ ORDER_B) % np.uint64(SKETCH)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH // 64)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of each pair differ."""
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


def stars(sets: DataFrame) -> DataFrame:
    """Distinct pairs (a, b): of the classes with one first token under H, A or B, the most central with each other that sizes and sketches allow.

    Most central is the class with the largest part of shared tokens: of edited copies the least edited.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok = []
            for b in batch.column(1).to_pylist():
                s = np.frombuffer(b, np.uint64)
                tok += [int(x.astype(np.int64)) for x in (s[0], order(s, ORDER_A).min(), order(s, ORDER_B).min())]
            row = pa.array(np.repeat(np.arange(batch.num_rows), 3))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(np.arange(len(tok)) % 3, pa.int32()), pa.array(tok, pa.int64()), *(batch.column(j).take(row) for j in (2, 3, 4))], ["cls", "ord", "tok", "n", "sketch", "central"])

    def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(j).to_numpy() for j in (2, 3))
            near = 7 * differing(sketches(batch.column(4)), sketches(batch.column(5))) <= n + m
            yield batch.select(["a", "b"]).filter(pa.array(near))

    tokens = map_arrow(sets.select("cls", "toks", "n", "sketch", "central"), first, "cls long, ord int, tok long, n long, sketch binary, central double")
    middle = tokens.groupBy("ord", "tok").agg(F.max(F.struct("central", "cls", F.col("n").alias("m"), F.col("sketch").alias("t"))).alias("x"), F.count("*").alias("size")).where("size > 1").select("ord", "tok", "x.cls", "x.m", "x.t").withColumnRenamed("cls", "hub")
    both = tokens.join(middle, ["ord", "tok"]).where("hub <> cls AND 4 * n >= 3 * m AND 4 * m >= 3 * n")
    pairs = both.select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b"), "n", "m", "sketch", "t")
    return map_arrow(pairs, allowed, "a long, b long").distinct()


def asked_for(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(cls, toks) of the classes in pairs (a, b) and of few others, by a filter as in ``sets_of``: whole sets are shuffled only where a pair needs them."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    wanted = sets.sparkSession.sparkContext.broadcast(bitmap(ends.select(F.xxhash64("cls").alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(in_filter(wanted.value, batch.column(2))).select(["cls", "toks"])

    return map_arrow(sets.select("cls", "toks", F.xxhash64("cls").alias("h")), run, "cls long, toks binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, ok) of distinct pairs, a saved table: whether their similarity is 3/4 or more. Sizes, then prefixes under A and B, then the whole sets."""
    sets = asked_for(sets, pairs)
    left = sets.select(F.col("cls").alias("a"), F.col("toks").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("toks").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return map_arrow(both, run, "a long, b long, ok boolean")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    small, large = sorted((len(x), len(y)))
    if not small or 4 * small < 3 * large:
        return False
    for salt in (ORDER_A, ORDER_B):
        ends = []
        for s in (x, y):
            h, k = order(s, salt), len(s) - (3 * len(s) + 3) // 4 + 1
            ends.append(np.partition(h, k - 1)[:k])
        if not len(np.intersect1d(*ends, assume_unique=True)):
            return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 4 * common >= 3 * (len(x) + len(y) - common)


def across(sets: DataFrame, comp: DataFrame) -> DataFrame:
    """(tok, cls, n, k, sketch): prefixes under order C of the classes that may have a partner in another component (cls, comp).

    k counts the tokens that other components hold too: no more can be shared with a partner there. Components are counted
    before tokens meet their holders, so a token that one component shares is a row for each task there, and no group is gathered.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = np.repeat(np.arange(batch.num_rows), batch.column(2).to_numpy())
            tokens = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(tokens)], ["cls", "comp", "tok"])

    each = map_arrow(sets.join(comp, "cls").select("cls", "comp", "n", "toks"), spread, "cls long, comp long, tok long")
    held = each.groupBy("tok", "comp").agg(F.lit(1).alias("one")).groupBy("tok").agg(F.sum("one").alias("freq")).where("freq > 1")
    met = each.select("cls", "tok").join(held, "tok").groupBy("cls").agg(F.collect_list(F.struct("freq", "tok")).alias("t"))
    # the hash that breaks ties is made where a class's tokens are together: it would be a third of what crosses the network
    met = met.withColumn("t", F.sort_array(F.transform("t", lambda x: F.struct(x["freq"].alias("freq"), F.xxhash64(x["tok"]).alias("h"), x["tok"].alias("tok")))))
    met = met.join(sets.select("cls", "n", "sketch"), "cls").withColumn("k", F.size("t").cast("long")).where("4 * k >= 3 * n")
    # tokens of one component come first in the order and meet nothing: n - k of the prefix
    return met.withColumn("cut", F.expr("CAST(k - (3 * n + 3) div 4 + 1 AS int)")).where("cut > 0").select(F.explode(F.expr("slice(t, 1, cut)")["tok"]).alias("tok"), "cls", "n", "k", "sketch")


def proposed(prefix: DataFrame, comp: DataFrame, tried: DataFrame | None, most: int | None, parts: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of classes of different components that share a token in ``prefix`` and are not ``tried`` (a, b):

    of those that sizes, counts and sketches allow, the ``most`` most similar ones of each component in each task, or all.
    """
    rows = prefix.join(comp, "cls")
    hub = rows.groupBy("tok", "comp").agg(F.count("*").alias("c")).groupBy("tok").agg(F.sum("c").alias("holders"), F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("hub"))
    rows = rows.join(hub.where("comps > 1").select("tok", "holders", F.col("hub.comp").alias("hub"), (F.col("holders") - F.col("hub.c")).alias("minor")), "tok")
    if tried is not None:
        rows = rows.join(tried.groupBy(F.col("a").alias("cls")).agg(F.collect_list("b").alias("tried")), "cls", "left")
    else:
        rows = rows.withColumn("tried", F.lit(None).cast("array<long>"))
    # a token of few holders is paired in its part; of a hot one, the holders outside its largest component (side 1) meet all (side 2), block by block
    cold = F.expr(f"array(struct(pmod(xxhash64(tok), {parts}) AS g, 0 AS side))")
    all_blocks, minor_blocks = f"holders div {HOT}", f"minor div {HOT}"
    first = F.expr(f"IF(comp = hub, slice(array(struct(0L AS g, 1 AS side)), 1, 0), transform(sequence(0L, {all_blocks}), j -> struct(xxhash64(tok, pmod(xxhash64(cls, 1), {minor_blocks} + 1), j) AS g, 1 AS side)))")
    second = F.expr(f"transform(sequence(0L, {minor_blocks}), i -> struct(xxhash64(tok, i, pmod(xxhash64(cls, 2), {all_blocks} + 1)) AS g, 2 AS side))")
    dealt = rows.withColumn("x", F.explode(F.when(F.col("holders") <= HOT, cold).otherwise(F.concat(first, second))))

    def run(table: pa.Table) -> pa.Table:
        a, b = best_pairs(table, most)
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return dealt.select("x.g", "x.side", "tok", "cls", "comp", (F.col("comp") == F.col("hub")).alias("in_hub"), "n", "k", "sketch", "tried").groupBy("g").applyInArrow(run, "a long, b long").distinct()


def met_pairs(tok: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of rows with one token, sorted by (tok, side): each with each later one of side 0, and side 1 with side 2."""
    number, length = runs(tok)
    end = np.cumsum(length)[number]
    begin = np.arange(len(tok)) + 1
    begin[side == 2] = end[side == 2]
    ones = np.bincount(number, side == 1, len(length)).astype(np.int64)
    begin[side == 1] = (end - length[number] + ones[number])[side == 1]
    count = end - begin
    for part in steps(count, PAIRS):
        left = np.repeat(np.arange(part.start, part.stop), count[part])
        yield left, np.arange(len(left)) - np.repeat(np.cumsum(count[part]) - count[part] - begin[part], count[part])


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(np.minimum(a, b).view(np.uint64) ^ mix(np.maximum(a, b).view(np.uint64)))


def best_pairs(table: pa.Table, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the pairs that one task proposes."""
    tok, side, cls, comp, n, k, in_hub = (table.column(x).to_numpy() for x in ("tok", "side", "cls", "comp", "n", "k", "in_hub"))
    by = np.lexsort((side, tok))
    tok, side, cls, comp, n, k, in_hub = (x[by] for x in (tok, side, cls, comp, n, k, in_hub))
    bits = sketches(table.column("sketch"))[by]
    old = table.select(["cls", "tried"]).filter(table.column("tried").is_valid())
    tried = [pair_key(np.full(len(t), c, np.int64), np.array(t, np.int64)) for c, t in dict(zip(old.column(0).to_pylist(), old.column(1).to_pylist(), strict=True)).items()]
    tried = np.unique(np.concatenate(tried)) if tried else np.zeros(0, np.uint64)
    found = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    for x, y in met_pairs(tok, side):
        keep = comp[x] != comp[y]
        keep &= (side[x] == 0) | in_hub[y] | (cls[x] < cls[y])  # two rows outside the largest component meet twice
        x, y = x[keep], y[keep]
        keep = (4 * n[x] >= 3 * n[y]) & (4 * n[y] >= 3 * n[x]) & (7 * np.minimum(k[x], k[y]) >= 3 * (n[x] + n[y]))
        x, y = x[keep], y[keep]
        far = differing(bits[x], bits[y])
        keep = 7 * far <= n[x] + n[y]
        x, y, far = x[keep], y[keep], (far / (n[x] + n[y]))[keep]
        if len(tried):
            keep = ~np.isin(pair_key(cls[x], cls[y]), tried)
            x, y, far = x[keep], y[keep], far[keep]
        found = [np.concatenate(z) for z in zip(found, (x, y, far), strict=True)]
        if most is not None:
            found = [z[nearest(comp, cls, *found, most)] for z in found]
    return cls[found[0]], cls[found[1]]


def nearest(comp: np.ndarray, cls: np.ndarray, x: np.ndarray, y: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Places of distinct pairs that are among the ``most`` nearest of one of their two components."""
    _, once = np.unique(pair_key(cls[x], cls[y]), return_index=True)
    of = np.concatenate((comp[x[once]], comp[y[once]]))
    by = np.lexsort((np.tile(once, 2), np.tile(far[once], 2), of))
    rank = np.arange(len(by)) - np.searchsorted(of[by], of[by])
    return np.unique(np.tile(once, 2)[by[rank < most]])


def contracted(ws: Workspace, comp: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """(cls, comp) after the components that ``links`` (a, b) of classes connect have become one, named by the smallest class."""
    ends = links.join(comp.select(F.col("cls").alias("a"), F.col("comp").alias("u")), "a").join(comp.select(F.col("cls").alias("b"), F.col("comp").alias("v")), "b")
    to = components(ws, ends.select(F.col("u").alias("a"), F.col("v").alias("b")), f"cc-{name}")
    return ws.save(comp.join(to.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("cls", F.coalesce("to", "comp").alias("comp")), f"comp-{name}")


def chosen(ws: Workspace, docs: DataFrame, doc_id: str, text: str, parts: int) -> tuple[DataFrame, DataFrame]:
    """(members, sets): a row for each document; the classes that may have a partner, with their sets, once each."""
    homes = docs.count() // HOME + 1
    seen = ws.save(shared(profile(docs, doc_id, text, parts), homes), "profile")
    members = seen.where("home IS NULL").select("doc_id", "th", "cls", "n")
    one = members.where("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "th")).alias("one"), F.first("n").alias("n"))
    maybe = ws.save(summed(seen).join(one, "cls").where(f"hits >= ((3 * n + 3) div 4) div {EXTRA} + 1").select("cls", "one.doc_id", "one.th", "n"), "maybe")
    whole = summed(shared(profile(docs, doc_id, text, parts, maybe), homes))
    alive = ws.save(maybe.join(whole, "cls").where("4 * hits >= 3 * n").withColumn("central", F.col("hits") / F.col("n")), "alive")
    return members, ws.save(sets_of(docs, doc_id, text, alive).join(alive.select("cls", "central"), "cls").dropDuplicates(["cls"]), "sets")


def every_link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): members (doc_id, th, cls, n) with a row for each document; links (a, b), a < b, all linked pairs of classes, once.

    A group of n near copies has up to n * (n - 1) / 2 links, and each is verified.
    """
    ws = Workspace(docs.sparkSession, "ngram-links")
    parts = parallelism(docs)
    members, sets = chosen(ws, docs, doc_id, text, parts)
    alone = sets.select("cls", F.col("cls").alias("comp"))
    prefix = ws.save(across(sets, alone), "prefixes")
    checked = ws.save(verified(ws.save(proposed(prefix, alone, None, None, parts), "candidates"), sets), "checked")
    ws.drop("maybe", "alive", "sets", "prefixes", "candidates")
    return members, checked.where("ok").select("a", "b")


def count_links(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, n_copies (other rows of the same set), n_links (rows of other sets with a similarity of 3/4 or more)."""
    members, links = every_link(docs)
    sizes = members.where("n > 0").groupBy("cls").agg(F.count("*").alias("size"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked_to = both.join(sizes.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("size").alias("n_links"))
    per = sizes.join(linked_to, "cls", "left")
    return members.join(per, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.col("size") - 1, F.lit(0)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, links): members (doc_id, th, cls, n, component) with a row for each document; links (a, b) verified pairs of classes.

    th is xxhash64 of the text; component is the smallest class reachable, 0 for empty sets.
    The links connect each component; of links inside one that others connect already ``every_link`` has all.
    """
    ws = Workspace(docs.sparkSession, "ngram-join")
    parts = parallelism(docs)
    members, sets = chosen(ws, docs, doc_id, text, parts)
    checked = ws.save(verified(ws.save(stars(sets), "stars"), sets), "checked-stars")
    comp = contracted(ws, sets.select("cls", F.col("cls").alias("comp")), checked.where("ok"), "stars")
    prefix = ws.save(across(sets, comp), "prefixes")
    most = FIRST
    for step in itertools.count():
        pairs = ws.save(proposed(prefix, comp, checked.where("NOT ok").select("a", "b"), most, parts), f"proposed-{step}")
        if pairs.isEmpty():
            break
        new = ws.save(verified(pairs, sets), f"checked-{step}")
        checked, most = checked.unionByName(new), most * GROWTH
        if not new.where("ok").isEmpty():
            comp = contracted(ws, comp, new.where("ok"), str(step))
    ws.drop("maybe", "alive", "sets", "prefixes")
    out = members.join(comp, "cls", "left").select("doc_id", "th", "cls", "n", F.coalesce("comp", "cls").alias("component"))
    return out, checked.where("ok").select("a", "b")


def join_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id reachable; of an empty set its own)."""
    members, _ = classes(docs)
    names = members.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("low"))
    return members.join(names, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id (then text hash). Texts without words all stay.

    A row repeated with doc_id and text counts as its document: one of them stays.
    """
    members, _ = classes(docs)
    ws = Workspace(docs.sparkSession, "ngram-keep")
    full = members.where("n > 0")
    kept = full.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("one"), F.count("*").alias("size")).where("size > 1")
    rows = full.join(kept.select("component", "one"), "component").withColumn("stays", F.expr("doc_id <=> one.doc_id AND th = one.th"))
    told = ws.save(rows.groupBy(F.col("doc_id").alias("__d"), F.col("th").alias("__h")).agg(F.max("stays").alias("__stays"), F.count("*").alias("__times")), "told")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__h"))
    out = docs.join(told.where("NOT __stays OR __times > 1").hint("shuffle_hash"), same, "left_anti")
    repeated = told.where("__stays AND __times > 1")
    if not repeated.isEmpty():
        out = out.unionByName(docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out
