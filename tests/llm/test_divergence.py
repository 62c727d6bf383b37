"""Source divergence against plain counting, skybands against plain dominance."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from edge import LONG, TEXTS
from patronlens.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def plain_terms(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_audit(rows, least=10, k=10):
    groups, in_docs, langs, out = {}, defaultdict(Counter), defaultdict(Counter), []
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.setdefault((lang, source), Counter()).update(plain_terms(text))
        in_docs[lang].update(set(plain_terms(text)))
        langs[lang].update(plain_terms(text))
    for (lang, source), own in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= least]

        def shares(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        p, whole = shares(own), shares(langs[lang])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pair = []
        for (other_lang, other), counts in groups.items():
            if other_lang == lang and other != source:
                q = shares(counts)
                pair.append((-sum(f(p[t], q[t]) for t in kept), other.encode()))
        term = [(-f(p[t], whole[t]), t.encode()) for t in kept if own[t] and p[t] > whole[t]]
        for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:k])):
            out += [(lang, source, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out)


def made(seed, n=400, words=60, sources=6):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdéß", k=rng.randrange(1, 5))) for _ in range(words)]
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "fr", None, ""])
        source = "hot" if rng.random() < 0.3 else f"s{rng.randrange(sources)}"
        own = vocabulary[hash(source) % 7 :: 2] if rng.random() < 0.5 else vocabulary
        rows.append((i, " ".join(rng.choices(own, k=rng.randrange(12))).upper() + "1x_y", lang, source))
    return rows


AWKWARD = [(i, t, "en", "a") for i, t in TEXTS] + [(i, t, None, None) for i, t in TEXTS]
AWKWARD += [(0, LONG + " Word́ ünïcode ÜNÏ", "en", "b")] * 12 + [(1, None, "xx", "only"), (2, "", "yy", "one"), (3, " 1 ", "yy", "two")]


def got(spark, rows, **limits):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "'x' AS term", "2 AS total", "3 AS rank")
    frame = divergence.audit(docs, **limits)
    assert frame.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("limits", [{}, {"min_docs": 2, "k": 3}])
def test_audit_matches_plain_counting(spark, limits):
    for rows in (made(1), AWKWARD):
        assert got(spark, rows, **limits) == plain_audit(rows, *limits.values())


def test_blocks_of_terms_and_sources(spark, monkeypatch):
    for name, value in (("BLOCK_TERMS", 7), ("BLOCK_SOURCES", 2), ("RUN", 5), ("FLUSH_TERMS", 20)):
        monkeypatch.setattr(divergence, name, value)
    rows = made(3, sources=9)
    assert got(spark, rows) == plain_audit(rows)


def test_no_documents(spark):
    assert got(spark, []) == [] and got(spark, [(1, "word", "en", "a")]) == []


@pytest.mark.parametrize("k", [1, 3, 10])
@pytest.mark.parametrize("kind", ["free", "equal", "against"])
def test_skyband_matches_plain_dominance(k, kind):
    rng = random.Random(k)
    n = 1300
    names = [str(i) for i in rng.sample(range(10**6), n)]
    g = [rng.randrange(50) for _ in range(n)] if kind != "equal" else [3] * n
    l = [rng.randrange(400) for _ in range(n)] if kind != "against" else [2 * x for x in g]
    full = np.array([[g[j] >= g[i] and l[j] <= l[i] and names[j] < names[i] for j in range(n)] for i in range(n)])
    found = divergence.skyband(np.array(g), np.array(l), names, k)
    assert found.tolist() == np.flatnonzero(full.sum(1) < k).tolist()


def test_counts_beyond_64_bits(spark):
    """Both ways of scaling a count agree with whole numbers of any size."""
    from pyspark.sql import functions as F

    rows = [(0, 10, 3), (divergence.EXACT, 10**10, 5), (divergence.EXACT + 1, 10**12, 5), (4 * 10**17, 10**18, 10**6)]
    frame = spark.createDataFrame(rows, "c long, n long, v long")
    found = frame.select(divergence._share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert [r.p for r in found] == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in rows]
