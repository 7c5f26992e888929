"""People named in texts against a loop over all names and places."""

import random
import re

import pytest

from ringlore.functions.names import folded_word
from ringlore.operators import mentions


def words(text):
    return [w for w in re.split(mentions.BREAKS, folded_word(text or "")) if w]


def osa(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def slips(a, b):
    n = max(len(a), len(b))
    most = 0 if n <= 3 else 1 if n <= 6 else 2
    return 0 if a == b else 99 if min(len(a), len(b)) <= 3 or osa(a, b) > most else osa(a, b)


def brute(names, texts):
    out = set()
    for doc, text in texts:
        t, hits = words(text), []
        for owner, name in names:
            n = words(name)
            for i in range(len(t) - len(n) + 1) if len(n) > 1 else ():
                s = sum(slips(a, b) for a, b in zip(t[i:], n))
                if s <= 2:
                    hits.append((s, len(" ".join(n)), owner, i, len(n)))
        taken, found = set(), []
        for s, letters, owner, i, n in sorted({h for h in hits if h[0] == 0}, key=lambda h: (-h[1], h[3], h[2])):
            if not taken & set(range(i, i + n)):
                taken |= set(range(i, i + n))
                found.append((0, i, owner, n))
        left = {h for h in hits if h[0] and not taken & set(range(h[3], h[3] + h[4]))}
        for s, _, owner, i, n in sorted(left, key=lambda h: (h[0], -h[4], h[3], h[2])):
            if not taken & set(range(i, i + n)):
                taken |= set(range(i, i + n))
                if not any(o != owner and x == s and m == n and set(range(j, j + m)) & set(range(i, i + n)) for x, _, o, j, m in left):
                    found.append((s, i, owner, n))
        seen = set()
        for s, i, owner, n in sorted(found, key=lambda f: (f[0] > 0, f[1])):
            if owner not in seen:
                seen.add(owner)
                out.add((doc, owner, i, n, s))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_people_in_texts(spark, seed):
    r = random.Random(seed)
    first = ["Ana", "Anna", "Marko", "Márko", "Eliška", "Bo", "Jonathan", "Jonathon", "Иван", "أحمد"]
    last = ["Hartmann", "Hartman", "Lee", "Petrović", "Petrovic", "van Dyke", "Ó Néill", "Смирнов", "علي", "Longfellow Junior"]
    names = [(i, f"{r.choice(first)} {r.choice(last)}") for i in range(60)] + [(7, "Marko Hartmann Petrović"), (70, "Single"), (71, None), (72, "")]

    def mangled(name):
        if not name or r.random() < 0.4:
            return name or "x"
        i = r.randrange(len(name))
        return r.choice([name[:i] + name[i + 1 :], name[:i] + "z" + name[i:], name[:i] + name[i + 1 : i + 2] + name[i : i + 1] + name[i + 2 :], name.upper(), name.replace(" ", "-")])

    filler = ["and", "the", "hart", "man", "петров", "said:", "(now)", "…"]
    texts = [(i, " ".join(r.choice(filler) if r.random() < 0.5 else mangled(r.choice(names)[1]) for _ in range(r.randint(0, 14)))) for i in range(120)] + [(900, None), (901, "")]
    got = mentions.people_in_texts(spark.createDataFrame(names, "owner long, name string").repartition(2), spark.createDataFrame(texts, "doc_id long, text string").repartition(3))
    want = brute(names, texts)
    assert len(want) > 60 and any(x[4] for x in want)
    assert {tuple(x) for x in got.collect()} == want


def test_hot_name(spark):
    # half of all texts name one person
    names = [(1, "Greta Oldenburg"), (2, "Greta Altenburg")]
    texts = [(i, "we saw Greta Oldenburg twice: greta oldenbrug" if i % 2 else "nobody") for i in range(600)]
    got = mentions.people_in_texts(spark.createDataFrame(names, "owner long, name string"), spark.createDataFrame(texts, "doc_id long, text string"))
    assert {tuple(x) for x in got.collect()} == {(i, 1, 2, 2, 0) for i in range(1, 600, 2)}
    assert mentions.people_in_texts(spark.createDataFrame([], "owner long, name string"), spark.createDataFrame(texts, "doc_id long, text string")).count() == 0
