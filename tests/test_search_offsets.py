"""Where typed letters stand in names."""

import random
import time

from pyspark.sql import functions as F

from waymark.functions import text
from waymark.operators import search


def letters(s):
    def one(c):
        n = ord(c) - 0xAC00
        return text.LEADS[n // 588] + text.VOWELS[n % 588 // 28] + (" " + text.TAILS)[n % 28].strip() if 0 <= n < 11172 else c

    return "".join(map(one, s))


def test_offsets_against_every_start(spark):
    rng = random.Random(3)
    alphabet = "나이낭ㄴㅏㅇㅣ닌키a1각갃ㄳ"
    names = sorted({"".join(rng.choices(alphabet, k=rng.randint(0, 6))) for _ in range(300)})
    rows = spark.createDataFrame([(n,) for n in names], "key string")
    for typed in ("나이", "낭", "ㄴㅏ", "ㄴa", "ㅏ", "a1", "각", "갃ㅣ", "이나이"):
        wanted = {n: next((k for k in range(len(n)) if letters(n[k:]).startswith(letters(typed))), None) for n in names}
        told = rows.select("key", text.syllable_offset(text.jamo(F.lit(typed)), F.col("key")).alias("at"), text.may_hold(F.col("key"), typed).alias("may")).collect()
        assert {r.key: r.at for r in told} == wanted
        assert all(r.may for r in told if r.at is not None)


def test_long_names_take_linear_time(spark):
    """A name's letters are taken once, not from every start."""
    names = spark.range(20).select("id", F.concat(F.repeat(F.lit("나비"), 1000), F.lit("나이"), F.col("id").cast("string")).alias("name"))
    began = time.time()
    assert {r.rank_in_kind for r in search.suggest(search.name_groups(names), "나이").collect()} == {2000}
    assert time.time() - began < 15
