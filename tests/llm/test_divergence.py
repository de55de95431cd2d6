"""Source divergence against a plain count, with small blocks and slices; the tournament's schedule."""

import random
import re
from collections import Counter, defaultdict

import pytest

from waymark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n string, term string, rank int, block int"


def plain(docs, least, top):
    groups, seen, counts = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]
        groups[lang].add(source)
        seen[lang].update(set(words))
        counts[lang, source].update(words)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= least]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, part, item.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(found)}
    return out


def corpus(seed, rows=160):
    pick = random.Random(seed)
    words = ["Ab", "aB", "über", "Über", "日本", "\U0001f600x", "￮z", "it's", "a1b", "x_y", "é", "No", "zz", "q r"] + [f"w{chr(97 + k)}" for k in range(20)]
    docs = []
    for k in range(rows):
        own = words if k % 3 else words[: pick.randrange(2, len(words))]
        docs.append((" ".join(pick.choice(own) for _ in range(pick.randrange(0, 30))), pick.choice(["en", "en", "de", None, ""]), pick.choice(["s0"] * 6 + [None, "é", "Z", "s1", "s2", "s3", "\U0001f600", "￮"])))
    docs += [(None, "en", "empty"), ("", "fr", None), ("only once", "fr", "s9"), ("wa " * 60_000 + "w" * 200_000, "en", "s0"), docs[0], docs[0], ("1 2 .", "none", "a"), (None, "none", "b")]
    return docs


@pytest.mark.parametrize(("seed", "least", "top", "block", "slice_terms"), [(1, 3, 10, 8, 1 << 16), (2, 2, 3, 2, 3), (3, 4, 5, 1, 7)])
def test_against_a_plain_count(spark, seed, least, top, block, slice_terms):
    docs = corpus(seed)
    table = spark.createDataFrame([(k, *d, "x", "y", 1, 2) for k, d in enumerate(docs)], SCHEMA).repartition(5)
    got = [tuple(r) for r in divergence.divergence(table, least, top, block, slice_terms).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain(docs, least, top)


def test_empty_tables_and_tables_without_kept_terms(spark):
    table = spark.createDataFrame([(1, "a b", "en", "x", "", "", 1, 1), (2, None, "en", "y", "", "", 1, 1)], SCHEMA)
    assert divergence.divergence(table.limit(0)).collect() == []
    got = {tuple(r) for r in divergence.divergence(table).select("source", "part", "item", "value", "rank").collect()}
    assert got == {("x", "pair", "y", 0, 1), ("y", "pair", "x", 0, 1)}


@pytest.mark.parametrize("seats", [2, 4, 6, 12])
def test_every_two_blocks_meet_once(seats):
    met = Counter()
    for turn in range(seats - 1):
        for b in range(seats):
            other = divergence.meets(b, turn, seats)
            assert other != b and divergence.meets(other, turn, seats) == b
            met[frozenset((b, other))] += 1
    assert set(met.values()) == {2} and len(met) == seats * (seats - 1) // 2


def test_vectors_survive_packing():
    import numpy as np

    ids, shares = np.array([0, 3, 4, 90]), np.array([5, 1_000_000_001, 7, 8])
    out = divergence._unpack(divergence._pack(ids, shares), 2, 100)
    assert out[ids].tolist() == shares.tolist() and (np.delete(out, ids) == 2).all()
    assert divergence._unpack(None, 3, 4).tolist() == [3] * 4
