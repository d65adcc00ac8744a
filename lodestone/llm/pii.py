"""Personal data by weak supervision; DataFrame and SQL functions only.

Candidates of each kind come from one loose pattern. Labelers vote on them, 1 for, -1 against, 0 none:
the strict pattern of the contract (which says nothing of other forms), a gazetteer (known domains, calling and area
codes, address ranges), a checksum, and words of the context before the span. The corpus keeps only how often each pattern of votes occurs
for each kind, at most 3**5 rows a kind, so expectation-maximisation (Dawid and Skene's, with one
reliability for each labeler and side) and a ridge logistic classifier, fitted to its posteriors over
the votes and two shapes, run on a table of fixed size; the classifier then goes back as a column expression.

Base spans are what the contract's patterns find, leftmost and not overlapping within a kind, and they
always stay. Places are running sums of the gaps between matches, so a text full of matches costs time in
proportion. Patterns are written so that a run of characters is entered once: a look-behind (or the end
of the last match) bars starts inside a run, and possessive repeats never give back, which finds the
same spans as plain backtracking in time linear in the text. Other matches that touch a base span of their kind are
no candidates; of the rest the method adds those whose probability is THRESHOLD or more. Of numbers and addresses planted in
forms that no base pattern finds, tests measure how many are added and how many of those added are right.

Defined results: null and empty texts have no spans (empty strings, counts 0, and the SHA-256 of the
empty string); rows that repeat are each judged; ties in place go by kind in the order of KINDS.
"""

from __future__ import annotations

import itertools
import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.9
CONTEXT = 24  # characters before a span in which context words count

# The contract's patterns, with starts barred inside runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Looser patterns whose matches are candidates too: addresses spelt out, numbers in national or other written forms.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+@-])[A-Za-z0-9][A-Za-z0-9._%+-]*+(?:\x20?(?:\(at\)|\[at\]|\{at\})\x20?|\x20at\x20)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++|\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?[A-Za-z0-9-]++|\x20dot\x20[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[._/][0-9]{4}){3}|3[47][0-9]{2}[._/][0-9]{6}[._/][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+(.-])(?:\([0-9]{3}\)\x20?[0-9]{3}[-.\x20][0-9]{4}|[0-9]{3}([-.\x20])[0-9]{3}\1[0-9]{4}|0[1-9](?:[.\x20-][0-9]{2}){4}|0[0-9]{2,4}[\x20/-][0-9]{5,8}|00[1-9][0-9]{0,2}(?:[\x20/-]?[0-9]{2,4}){3,5})(?![0-9A-Za-z]|[.-][0-9])",
}

#: What a text must hold for a pattern to be tried at all.
HINTS = {"email": r"@|\(at\)|\[at\]|\{at\}|\x20at\x20", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f:]|\[\.\]", "card": r"[0-9]", "phone": r"\+[0-9]|[0-9][-.\x20/][0-9]|\([0-9]|00[1-9]"}

#: Words that speak for a kind shortly before a span, and those that speak against any.
WORDS = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|reach|courriel|correo|kontakt|schreib|escr[ií]b|[ée]cri)",
    "ip": r"(?i)\b(ip|ipv[46]|host|server|address|adresse|direcci[óo]n|login|from|node|peer|gateway|client)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta|payment|paid)\b",
    "phone": r"(?i)\b(phone|tel|telefon|tel[ée]fono|t[ée]l[ée]phone|call|fax|mobile|cell|ring|handy|m[óo]vil|appel|anruf)",
}
AGAINST = r"(?i)\b(version|ver|isbn|order|invoice|id|no|nr|ref|serial|part|sku|build|room|page|rev|token|time|ratio|score)\b\W*$|[#=]\W*$"

# Top-level domains in common use, generic ones and those of countries.
TOP_LEVEL = "com org net edu gov mil int info biz name io ai app dev co me tv cc at au be br ca ch cl cn cz de dk es eu fi fr gr hk hu ie il in is it jp kr lu mx nl no nz pl pt ro ru se sg sk tr tw ua uk us za"
# Country calling codes in common use.
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 94 98 212 213 216 351 352 353 354 358 359 370 371 372 380 381 385 386 420 421 852 886 971 972"

#: Gazetteers: top-level domains, address ranges in use, first digits of card issuers, calling codes and national area codes.
GAZETTEER = {
    "email": rf"(?i)(\.|dot[\])}}]?)\x20?({TOP_LEVEL.replace(' ', '|')})$",
    "ip": r"^([1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])(\.|\[\.\])|^(?i)(2[0-9a-f]{3}|3[0-9a-f]{3}|f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]):",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|6(011|4[4-9]|5))",
    "phone": rf"^(\+|00)\x20?({CALLING.replace(' ', '|')})|^\(?[2-9][0-8][0-9]\D|^0[1-9]",
}

LABELERS = ("strict", "gazetteer", "check", "context")


def digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(span: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    rev = F.reverse(digits(span))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(rev)),
        F.lit(0),
        lambda s, i: s + F.when(i % 2 == 1, F.substring(rev, i, F.lit(1)).cast("int")).otherwise((2 * F.substring(rev, i, F.lit(1)).cast("int")) % 10 + F.floor(F.substring(rev, i, F.lit(1)).cast("int") / 5).cast("int")),
    )
    return F.when(F.length(rev) > 0, total % 10 == 0).otherwise(False)


def passes(kind: str, span: Column) -> Column:
    """The contract's tests of a match."""
    n = F.length(digits(span))
    if kind == "ip":
        # a part of more digits than 255 has is too large unless its leading digits are zeros
        return F.forall(F.split(span, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(span, r"\."), lambda p: F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255)
    if kind == "card":
        return n.between(12, 19) & luhn(span)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def pieces(text: Column, pattern: str) -> Column:
    """All matches in order as (gap, span, before): code points since the match before, the match, and the end of what lies between."""
    own = re.sub(r"\\([1-9])", lambda m: f"\\{int(m[1]) + 1}", pattern)  # one group more stands before
    found = F.regexp_extract_all(text, F.lit(f"({own})"), F.lit(1))
    between = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(0)))
    return F.zip_with(found, between, lambda m, p: F.struct(F.length(p).alias("gap"), m.alias("span"), F.right(p, F.lit(CONTEXT)).alias("before")))


def sign(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, 1).when(~yes if no is None else no, -1).otherwise(0)


def candidates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, th, c): for each row its matches, as (kind, base, at, gap, span, before); ``at`` numbers those of one pattern.

    Texts without a hint of a kind do not run its patterns; the spans leave the scan, the texts do not.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    empty = F.array().cast("array<struct<kind:string,base:boolean,at:int,gap:int,span:string,before:string>>")

    def found(kind: str, base: bool, pattern: str) -> Column:
        def span(m: Column, i: Column) -> Column:
            return F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), i.alias("at"), m["gap"].alias("gap"), m["span"].alias("span"), m["before"].alias("before"))

        return F.when(t.rlike(HINTS[kind]) & t.rlike(pattern), F.transform(pieces(t, pattern), span)).otherwise(empty)

    groups = [found(kind, base, (BASE if base else LOOSE)[kind]) for kind in KINDS for base in (True, False)]
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.concat(*groups).alias("c"))


def placed(each: DataFrame) -> DataFrame:
    """Matches (doc_id, th, kind, base, at, gap, span, before) with start and end, in code points; sums over one pattern's matches of a text."""
    order = Window.partitionBy("doc_id", "th", "kind", "base").orderBy("at")
    end = F.sum(F.col("gap") + F.length("span")).over(order)
    return each.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.length("span"))


def outside(spans: DataFrame) -> DataFrame:
    """Of other matches than ``ok`` ones those that overlap none of their kind. Spans that are ok never overlap one another within a kind."""
    text = Window.partitionBy("doc_id", "th", "kind")
    # both frames grow from the partition's first row on, so each row costs one step
    earlier = text.orderBy("start", "end", "ok").rowsBetween(Window.unboundedPreceding, -1)
    later = text.orderBy(F.desc("start"), F.desc("end"), F.desc("ok")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(F.col("ok"), F.col("end"))).over(earlier)
    after = F.min(F.when(F.col("ok"), F.col("start"))).over(later)
    free = (F.coalesce(before, F.lit(0)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    return spans.withColumn("__free", F.col("ok") | free).where("__free").drop("__free")


def voted(spans: DataFrame) -> DataFrame:
    """Adds ``ok`` (a base match that passes the contract's tests), one vote column for each labeler and shapes."""
    def by_kind(f) -> Column:
        out = F.lit(None)
        for kind in KINDS:
            out = F.when(F.col("kind") == kind, f(kind)).otherwise(out)
        return out

    span, before = F.col("span"), F.col("before")
    tests = by_kind(lambda k: passes(k, span))
    out = spans.withColumn("ok", F.col("base") & tests)
    n = F.length(digits(span))
    checks = {
        "email": sign(span.rlike(r"^[A-Za-z0-9]") & ~span.rlike(r"\x20(at|dot)\x20"), span.rlike(r"\.\.|^[._%+-]|\x20at\x20.*\x20at\x20")),
        "ip": sign(~span.rlike(r"(^|[.\]])(0[0-9]|25[6-9]|2[6-9][0-9]|[3-9][0-9]{2})")),
        "card": sign(luhn(span)),
        "phone": sign(n.between(10, 15), n < 7),
    }
    out = out.withColumn("strict", F.col("ok").cast("int"))
    out = out.withColumn("gazetteer", by_kind(lambda k: sign(span.rlike(GAZETTEER[k]))))
    out = out.withColumn("check", by_kind(lambda k: checks[k]))
    out = out.withColumn("context", by_kind(lambda k: sign(before.rlike(WORDS[k]) & ~before.rlike(AGAINST), before.rlike(AGAINST))))
    shape = F.when(F.length(span) < 12, 0).when(F.length(span) < 20, 1).otherwise(2)
    return out.withColumn("shape", shape).withColumn("edge", F.coalesce(F.right(before, F.lit(1)).rlike(r"[\s(\[:,;\"'.]") | (before == ""), F.lit(True)).cast("int"))


def em(patterns: dict[tuple[int, ...], float], rounds: int = 50) -> tuple[dict[tuple[int, ...], float], list[tuple[dict[int, float], dict[int, float]]]]:
    """Posterior of each vote pattern, and each labeler's vote shares for true and false spans."""
    m = len(LABELERS)
    post = {v: 1 / (1 + math.exp(-sum(v))) for v in patterns}
    shares: list[tuple[dict[int, float], dict[int, float]]] = []
    for _ in range(rounds):
        true, total = sum(post[v] * n for v, n in patterns.items()), sum(patterns.values())
        prior = min(0.99, max(0.01, (true + 1) / (total + 2)))
        shares = []
        for j in range(m):
            sides = []
            for side in (1, 0):
                weight = {x: 1.0 for x in (-1, 0, 1)}  # one pseudo-count each
                for v, n in patterns.items():
                    weight[v[j]] += n * (post[v] if side else 1 - post[v])
                whole = sum(weight.values())
                sides.append({x: w / whole for x, w in weight.items()})
            shares.append((sides[0], sides[1]))
        for v in patterns:
            z = math.log(prior / (1 - prior)) + sum(math.log(shares[j][0][v[j]] / shares[j][1][v[j]]) for j in range(m))
            post[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return post, shares


def features(v: tuple[int, ...]) -> list[float]:
    """Of (votes..., shape, edge): each vote as two indicators, shapes and edge, constant last."""
    votes, shape, edge = v[:-2], v[-2], v[-1]
    return [*itertools.chain.from_iterable((float(x == 1), float(x == -1)) for x in votes), float(shape == 1), float(shape == 2), float(edge), 1.0]


def fit(counts: dict[tuple[int, ...], float], ridge: float = 1.0, steps: int = 400) -> list[float]:
    """Weights of a logistic classifier fitted to the posteriors, over the table of patterns."""
    votes: dict[tuple[int, ...], float] = {}
    for v, n in counts.items():
        votes[v[:-2]] = votes.get(v[:-2], 0.0) + n
    post, _ = em(votes)
    rows = [(features(v), n, post[v[:-2]]) for v, n in counts.items()]
    total = sum(n for _, n, _ in rows)
    w = [0.0] * len(rows[0][0])
    for _ in range(steps):
        g = [ridge * x / max(total, 100.0) for x in w]
        for x, n, p in rows:
            z = sum(a * b for a, b in zip(w, x, strict=True))
            e = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / total
            for j, b in enumerate(x):
                g[j] += e * b
        w = [a - 2.0 * b for a, b in zip(w, g, strict=True)]
    return w


def probability(models: dict[str, list[float]]) -> Column:
    """The classifier as an expression of the vote columns."""
    out = F.lit(0.0)
    for kind, w in models.items():
        z = F.lit(w[-1])
        for j, name in enumerate(LABELERS):
            z = z + F.when(F.col(name) == 1, w[2 * j]).when(F.col(name) == -1, w[2 * j + 1]).otherwise(0.0)
        at = 2 * len(LABELERS)
        z = z + F.when(F.col("shape") == 1, w[at]).when(F.col("shape") == 2, w[at + 1]).otherwise(0.0) + w[at + 2] * F.col("edge")
        out = F.when(F.col("kind") == kind, 1 / (1 + F.exp(-z))).otherwise(out)
    return out


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (doc_id, th, c) of all texts; spans (doc_id, th, kind, start, end, ok, p) of each different text."""
    ws = Workspace(docs.sparkSession, "pii")
    rows = ws.save(candidates(docs, doc_id, text), "candidates")
    each = rows.where(F.size("c") > 0).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", F.explode("c").alias("c")).select("doc_id", "th", "c.*")
    spans = ws.save(outside(voted(placed(each)).where("ok OR NOT base")).drop("span", "before", "at", "gap", "base"), "votes")
    names = [*LABELERS, "shape", "edge"]
    counts: dict[str, dict[tuple[int, ...], float]] = {}
    for r in spans.groupBy("kind", *names).agg(F.count("*").alias("n")).collect():  # at most 3**4 * 6 rows a kind
        counts.setdefault(r["kind"], {})[tuple(r[n] for n in names)] = float(r["n"])
    found = spans.withColumn("p", probability({k: fit(c) for k, c in sorted(counts.items())}))
    return rows, found


def kept(found: DataFrame) -> DataFrame:
    """Base spans that pass, and of the others, which overlap none of those of their kind, the likely ones.

    Loose matches of one kind come from one pattern, so they do not overlap one another.
    """
    return found.where(F.col("ok") | (F.col("p") >= THRESHOLD))


def is_base(kind: int):
    return lambda s: s["ok"] & (s["kind"] == kind)


def find_in_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    rows, found = find(docs)
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    per = kept(found).groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.array_sort(F.collect_list(F.struct("start", number.alias("kind"), "end", "ok"))).alias("s"))
    # the spans grow with the input, so neither side is broadcast
    both = rows.select("doc_id", "th").join(per.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    name = F.array(*map(F.lit, KINDS))

    def joined(spans: Column) -> Column:
        return F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit(""))

    base = F.filter("s", lambda s: s["ok"])
    counts = [F.size(F.filter("s", is_base(i))).cast("long") for i in range(1, len(KINDS) + 1)]
    return both.select("doc_id", *[F.when(F.col("s").isNull(), F.lit(0).cast("long")).otherwise(c).alias(f"n_{k}") for c, k in zip(counts, KINDS, strict=True)], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
