"""Leaks against holding each item against each of its windows."""

import math
import random
import re
from collections import Counter

import pytest

from lodestone.llm import decontamination as D

WORD = re.compile(r"[a-z0-9]+")


def parts(text):
    w = WORD.findall(text.lower())
    cut = max((m.end() for m in re.finditer(r"\?|(?i:answer:)", text)), default=0)
    n = len(WORD.findall(text[:cut].lower())) if cut else 0
    n = n if 0 < n < len(w) else (len(w) + 1) // 2
    return w[:n], w[n:]


def share(part, window):
    if not part:
        return 1.0
    two = set(zip(window, window[1:]))
    if len(part) == 1:
        return float(part[0] in window)
    own = set(zip(part, part[1:]))
    return len(own & two) / len(own)


def plainly(docs, items):
    bags = {i: Counter(WORD.findall(t.lower())) for i, t in items}
    df = Counter(w for b in bags.values() for w in b)
    mean = sum(map(lambda b: sum(b.values()), bags.values())) / len(bags)
    out = {}
    for i, text in items:
        size = sum(bags[i].values())
        w = {t: math.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) for t, tf in bags[i].items()}
        for d, t in docs:
            words = WORD.findall(t.lower())
            for x in range(0, len(words), size):
                own = words[x : x + 2 * size]
                have = set(own)
                score = min(1.0, sum(v for t, v in w.items() if t in have) / sum(w.values()))
                q, r = (share(p, own) for p in parts(text))
                if score >= 0.6 - 1e-9 and q >= 0.5 and r >= 0.5:
                    out[d, i] = max(out.get((d, i), (0, 0, 0)), (score, q, r))
    return {k: tuple(round(x, 7) for x in v) for k, v in out.items()}


def invented(rng, n, words=4000):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(6)
    items = [(i, " ".join(invented(rng, n))) for i, n in enumerate((5, 6, 9, 10, 16, 17, 31, 40, 130, 700, 2000, 5000))]
    items += [(20, "who wrote the first of them? a clerk of the old court"), (21, "alone"), (22, "Question of two? yes")]
    docs = []
    for i, text in items:
        w = text.split()
        docs.append((len(docs), " ".join(invented(rng, rng.randrange(3 * len(w) + 5)) + w + invented(rng, 40))))
        edited = [x if rng.random() > 0.2 else "edited" for x in w]
        docs.append((len(docs), " ".join(invented(rng, 11) + edited)))
        docs.append((len(docs), " ".join(w[: len(w) // 2])))  # the question alone
        shuffled = w[:]
        rng.shuffle(shuffled)
        docs.append((len(docs), " ".join(shuffled)))
    ten = items[3][1].split()  # its word pairs, far apart
    docs.append((900, " ".join(x for a, b in zip(ten, ten[1:]) for x in (a, b, *invented(rng, 150)))))
    return docs, items


def test_an_item_is_judged_in_its_own_windows(spark, planted, monkeypatch):
    docs, items = planted
    want = plainly(docs, items)
    assert (900, 3) not in want and len({i for _, i in want}) == len(items)
    left, right = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for size in (D.GROUP_ITEMS, 4):
        monkeypatch.setattr(D, "GROUP_ITEMS", size)
        rows = D.find_leaks(left, right).collect()
        assert len(rows) == len(want)
        assert {(r.doc_id, r.item_id): tuple(round(x, 7) for x in (r.score, r.question, r.answer)) for r in rows} == want


def test_other_items_change_nothing(spark, planted):
    docs, items = planted
    left = spark.createDataFrame([docs[12], docs[-1]], "doc_id long, text string")
    for others in ([], [items[11]], items[:9]):
        asked = spark.createDataFrame(list(dict([items[3], *others]).items()), "item_id long, text string")
        assert [(r.doc_id, r.item_id) for r in D.find_leaks(left, asked).collect() if r.item_id == 3] == [(12, 3)]
        assert 900 in {r.doc_id for r in D.clean(left, asked).collect()}
