"""Mixing sources to target weights by pivotal dependent rounding; DataFrame and SQL functions only.

Every document of a source is wanted target / source_size times, a number from 0 to 2: a whole part
and a fraction. Two fractional documents meet; the mass that one loses the other gains, in words,
with the odds that keep both expectations, until one of them is whole. So a source's taken words
stay what they were and only one document of it can be left with a fraction, which a last draw
rounds. Documents meet inside blocks of about BLOCK (a block is a hash of the document, so a hot
source is many blocks); what each block leaves goes to a block of the next level of a reduction
tree, one shuffle of one row a block for each level.

Defined results: null text has size 0; documents of size 0 are never taken; a null source is a
source, last in order; rows that repeat doc_id, source and text form one unit, of whose wanted mass whole
rows get their extra copy and only one row keeps a fraction; the draws
are hashes of the documents, so reruns agree. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace

BLOCK = 200
WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+; null counts as empty. Only the first and last piece of the split can be empty."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1)
    return (F.size(pieces) - (pieces[0] == "").cast("int") - ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) of rows (source, size): one row a source.

    Targets are level * weight, but ``cap`` times the size at most. The capped sources are those of
    least cap / weight: the first k of that order, for the least k whose level leaves the next one below its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(place) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), k + 1)).withColumn("cap", F.lit(cap) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, everything = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    final = F.min(F.when(F.col("free"), F.struct("cap_by_weight", "level"))).over(everything)
    per = per.withColumn("cap_by_weight", F.col("cap") / F.col("weight")).withColumn("level", final["level"])
    return per.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), "cap").alias("target"))


#: One meeting: the unit carried so far (acc.c) and the next (x); a: most mass that c can gain, b: that x can gain.
MEET = """
aggregate(units, CAST(NULL AS struct<done:array<struct<doc_id:bigint,th:bigint,size:bigint,m:bigint,copies:bigint>>,c:struct<h:bigint,doc_id:bigint,th:bigint,size:bigint,m:bigint,base:bigint,p:double>>),
  (acc, x) -> CASE WHEN acc IS NULL THEN named_struct('done', CAST(array() AS array<struct<doc_id:bigint,th:bigint,size:bigint,m:bigint,copies:bigint>>), 'c', x) ELSE
    transform(array(named_struct(
      'up', (1 - acc.c.p) * acc.c.size * acc.c.m, 'down', acc.c.p * acc.c.size * acc.c.m, 'xup', (1 - x.p) * x.size * x.m, 'xdown', x.p * x.size * x.m,
      'u', (xxhash64(acc.c.h, x.h, 17) & 9007199254740991) / 9007199254740992D)), s ->
      CASE WHEN s.u * (least(s.up, s.xdown) + least(s.down, s.xup)) < least(s.down, s.xup)
        THEN CASE WHEN s.up <= s.xdown THEN {c_whole_1} ELSE {x_whole_0} END
        ELSE CASE WHEN s.down <= s.xup THEN {c_whole_0} ELSE {x_whole_1} END END)[0] END)
"""


def meeting() -> str:
    def state(done: str, copies: str, carried: str, p: str) -> str:
        whole = f"named_struct('doc_id', {done}.doc_id, 'th', {done}.th, 'size', {done}.size, 'm', {done}.m, 'copies', {copies})"
        carry = f"named_struct('h', {carried}.h, 'doc_id', {carried}.doc_id, 'th', {carried}.th, 'size', {carried}.size, 'm', {carried}.m, 'base', {carried}.base, 'p', least(1D, greatest(0D, {p})))"
        return f"named_struct('done', concat(acc.done, array({whole})), 'c', {carry})"

    return MEET.format(
        c_whole_1=state("acc.c", "acc.c.base + 1", "x", "x.p - s.up / (x.size * x.m)"),
        x_whole_0=state("x", "x.base", "acc.c", "acc.c.p + s.xdown / (acc.c.size * acc.c.m)"),
        c_whole_0=state("acc.c", "acc.c.base", "x", "x.p + s.down / (x.size * x.m)"),
        x_whole_1=state("x", "x.base + 1", "acc.c", "acc.c.p - s.xup / (acc.c.size * acc.c.m)"),
    )


def decide(docs: DataFrame) -> DataFrame:
    """(doc_id, th, source, size, source_size, target, m, copies) of each unit: m equal rows, each taken ``copies`` times.

    A unit of several rows may have a row here for ``copies`` and one for a copy more; their m add up to its rows.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("th"), word_count(F.col("text")).alias("size"))
    units = ws.save(rows.groupBy("doc_id", "source", "th", "size").agg(F.count("*").alias("m")), "units")
    goal = ws.save(targets(units.select("source", (F.col("size") * F.col("m")).alias("size"))).join(units.groupBy("source").agg(F.count("*").alias("units")).withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s"), "targets")
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = units.join(goal.withColumnRenamed("source", "s"), F.expr("source <=> s")).drop("s").withColumn("f", f).withColumn("base", F.floor("f")).withColumn("p", F.col("f") - F.col("base")).withColumn("h", F.xxhash64("doc_id", "th"))
    # of m equal rows the first ``more`` get a copy more, one keeps the fraction that is left, and the others get none
    wanted = wanted.withColumn("more", F.least(F.floor(F.col("m") * F.col("p")), "m")).withColumn("p", F.col("m") * F.col("p") - F.col("more"))
    out = ["doc_id", "th", "source", "size", "source_size", "target", "m", "copies"]
    alike = F.when(F.col("size") == 0, F.expr("array(struct(m, 0L AS copies))")).otherwise(F.expr("array(struct(more AS m, base + 1 AS copies), struct(m - more - IF(p > 0, 1L, 0L) AS m, base AS copies))"))
    parts = [wanted.withColumn("alike", F.explode(alike)).where("alike.m > 0").select(*out[:-2], "alike.m", "alike.copies")]
    level = wanted.where("p > 0 AND size > 0").withColumn("m", F.lit(1).cast("long")).select("source", "source_size", "target", F.expr(f"pmod(xxhash64(doc_id, th, 5), units div {BLOCK} + 1)").alias("block"), F.struct("h", "doc_id", "th", "size", "m", "base", "p").alias("unit"))
    blocks = (goal.agg(F.max("units")).first()[0] or 0) // BLOCK + 1
    step = 0
    while True:
        met = level.groupBy("source", "source_size", "target", "block").agg(F.sort_array(F.collect_list("unit")).alias("units")).select("source", "source_size", "target", "block", F.expr(meeting()).alias("got"))
        met = ws.save(met.select("source", "source_size", "target", "block", "got.done", "got.c"), f"level-{step}")
        parts.append(met.select("source", "source_size", "target", F.explode("done").alias("d")).select("d.doc_id", "d.th", "source", "d.size", "source_size", "target", "d.m", "d.copies"))
        if blocks == 1:
            break
        level = met.select("source", "source_size", "target", F.expr(f"block div {BLOCK}").alias("block"), F.col("c").alias("unit"))
        blocks, step = (blocks - 1) // BLOCK + 1, step + 1
    drawn = F.expr("c.base + CASE WHEN (xxhash64(c.h, 23) & 9007199254740991) / 9007199254740992D < c.p THEN 1L ELSE 0L END")
    parts.append(met.select("c.doc_id", "c.th", "source", "c.size", "source_size", "target", "c.m", drawn.alias("copies")))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def mix_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    each = decide(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "m")
    return each.withColumn("m", F.expr("explode(sequence(1L, m))")).drop("m")


def take(docs: DataFrame) -> DataFrame:
    """The mix: ``docs`` with each row as often as it is taken. Texts stream past the narrow side of the join, unsorted."""
    ws = Workspace(docs.sparkSession, "mixing-take")
    unit = [F.col("doc_id").alias("__d"), F.col("th").alias("__h"), F.col("source").alias("__s")]
    taken = ws.save(decide(docs).groupBy(*unit).agg(F.min("copies").alias("__low"), F.max("copies").alias("__copies"), F.sum("m").alias("__rows"), F.sum(F.col("m") * F.col("copies")).alias("__all")).where("__copies > 0"), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__h")) & F.col("source").eqNullSafe(F.col("__s"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.join(taken.where("__low = __copies").hint("shuffle_hash"), same).select(*columns, F.expr("explode(sequence(1L, __copies))").alias("__copy")).drop("__copy")
    uneven = taken.where("__low < __copies")
    if not uneven.isEmpty():  # such units only: their rows are counted, as they may differ in other columns, and the first get the copy more
        about = ["__d", "__h", "__s", "__low", "__rows", "__all"]
        some = docs.join(uneven, same).groupBy(*columns, *about).agg(F.count("*").alias("__n"))
        before = F.coalesce(F.sum("__n").over(Window.partitionBy("__d", "__h", "__s").orderBy(F.xxhash64(*columns)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        some = some.withColumn("__first", before).withColumn("__more", F.expr("__all - __low * __rows"))
        times = some.withColumn("__copies", F.expr("__n * __low + least(__first + __n, __more) - least(__first, __more)")).where("__copies > 0")
        out = out.unionByName(times.select(*columns, F.expr("explode(sequence(1L, __copies))").alias("__copy")).drop("__copy"))
    return out
