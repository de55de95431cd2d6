"""Match keys and Hangul column functions of the name search."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letters of Hangul syllables in Unicode order.
LEADS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
VOWELS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
TAILS = "ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"


# Fixed value: what a match key leaves out.
LEFT_OUT = "[^0-9a-z가-힣ㄱ-ㆎ]"


def match_key(name: Column) -> Column:
    """Lower case; digits, Latin letters, Hangul syllables and letters only."""
    return F.regexp_replace(F.lower(name), LEFT_OUT, "")


def collapsed(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), r"\s+", "")


def _syllables(text: Column, of, between: str = "") -> Column:
    def one(c: Column) -> Column:
        n = F.ascii(c) - 0xAC00
        return F.when((n >= 0) & (n < 11172), of(n)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), between)


def jamo(text: Column, between: str = "") -> Column:
    """Each syllable as its letters; other characters as they are."""
    at = lambda letters, k: F.substring(F.lit(letters), k + 1, F.lit(1))
    tail = lambda n: F.when(n % 28 == 0, "").otherwise(F.substring(F.lit(TAILS), n % 28, F.lit(1)))
    return _syllables(text, lambda n: F.concat(at(LEADS, F.floor(n / 588).cast("int")), at(VOWELS, F.floor(n % 588 / 28).cast("int")), tail(n)), between)


def initials(text: Column) -> Column:
    """Each syllable as its first letter; other characters as they are."""
    return _syllables(text, lambda n: F.substring(F.lit(LEADS), F.floor(n / 588).cast("int") + 1, F.lit(1)))


def prefix_distance(query: Column, text: Column) -> Column:
    """Least edit distance of a query to any prefix of a text."""
    return F.array_min(F.transform(F.sequence(F.lit(0), F.length(text)), lambda k: F.levenshtein(query, F.substring(text, F.lit(1), k))))


def syllable_offset(letters: Column, text: Column) -> Column:
    """Characters of a text, which has one line, before the first one from which its letters begin with the given ones; null if none."""
    # a mark before each character's letters; a match begins at one and passes others
    marked = F.concat(F.lit("\n"), jamo(text, "\n"))
    pattern = F.regexp_replace(letters, r"([\s\S])", r"\\n?\\Q$1\\E")
    found = F.regexp_instr(marked, F.regexp_replace(pattern, r"^\\n\?", r"\\n"))
    before = F.substring(marked, F.lit(1), found - 1)
    return F.when(found > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))))


def may_hold(text: Column, typed: str) -> Column:
    """False only for match keys without a character that can begin what is typed: a letter, or a syllable that starts with it."""
    typed = re.sub(LEFT_OUT, "", typed.lower())
    if not typed:
        return F.lit(False)
    first, code = typed[0], ord(typed[0]) - 0xAC00
    lead = LEADS[code // 588] if 0 <= code < 11172 else first
    block = 0xAC00 + LEADS.index(lead) * 588 if lead in LEADS else None
    syllables = f"|[{chr(block)}-{chr(block + 587)}]" if block else ""
    return text.rlike(f"\\Q{lead}\\E{syllables}")


def highlights(name: Column, needle: str) -> Column:
    """Start offsets of every place of a needle, case folded, from the left and without overlap; none for an empty needle."""
    if not needle:
        return F.array().cast("array<int>")
    pieces = F.split(F.lower(name), r"\Q" + needle.lower() + r"\E", -1)
    before = lambda i: F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda s, p: s + F.length(p)) + (i - 1) * len(needle)
    return F.when(F.size(pieces) < 2, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), before))


def floor_rank(label: Column) -> Column:
    """B3 is -3, 2F is 2, anything else 0."""
    down, up = F.regexp_extract(label, r"^[Bb](\d+)", 1), F.regexp_extract(label, r"^(\d+)", 1)
    return F.when(down != "", -down.cast("int")).when(up != "", up.cast("int")).otherwise(0)


# Fixed value: how escalator nodes are named.
ESCALATOR = r"(?i)^(.*?)-\s*(UP|DN|DOWN)\s*\(\s*(TO|FR)\s*([A-Za-z0-9]+)\s*\)$"


def escalator_name(name: Column) -> Column:
    """(bank, way, arrives, floor) of an escalator's node name; null for other names."""
    part = lambda k: F.regexp_extract(name, ESCALATOR, k)
    told = F.struct(F.trim(part(1)).alias("bank"), F.when(F.upper(part(2)) == "UP", "up").otherwise("down").alias("way"), (F.upper(part(3)) == "TO").alias("arrives"), part(4).alias("floor"))
    return F.when(part(2) != "", told)


def next_floor_rank(rank: Column, step: int) -> Column:
    """The rank of the floor above (1) or below (-1); there is no floor 0, and none next to an unknown one."""
    return F.when(rank == 0, None).when(rank + step == 0, rank + 2 * step).otherwise(rank + step)


# What a guide says.
SAYS = {"wrong way": "반대 방향입니다 · 뒤로 돌아가세요", "board escalator": "에스컬레이터를 탑승하세요", "board elevator": "엘리베이터를 탑승하세요", "arrived": "목적지에 도착했습니다", "floor change": "다음 층 이동 지점입니다"}
ACTIONS = {"right": "우회전", "left": "좌회전", "escalator": "에스컬레이터 탑승", "elevator": "엘리베이터 탑승"}
SOON, AFTER, STRAIGHT_ON = "잠시 후 ", "미터 후 ", "미터 직진"
ARRIVAL_M, SOON_M = 5, 7


def instruction(reverse: Column, remaining: Column, mode: Column, arrival: Column, turn: Column, turn_metres: Column, rounded) -> Column:
    """(action, says) of a guide: a wrong way, then boarding or arrival, the next turn, the way to a transfer, straight on.

    ``turn`` is the next told turn (null if none) and ``turn_metres`` its distance;
    ``rounded`` is how metres are told.
    """
    told = lambda action, says: F.struct(F.lit(action).alias("action"), says.alias("says"))
    way = lambda metres, word: F.when(metres <= SOON_M, F.concat(F.lit(SOON), word)).otherwise(F.concat(rounded(metres).cast("string"), F.lit(AFTER), word))
    at_end = remaining <= ARRIVAL_M
    side = lambda action: told(action, way(turn_metres, F.lit(ACTIONS[action])))
    result = F.when(reverse, told("wrong way", F.lit(SAYS["wrong way"])))
    for kind in ("escalator", "elevator"):
        result = result.when(at_end & (mode == kind), told(kind, F.lit(SAYS["board " + kind])))
    result = result.when(at_end & arrival, told("arrived", F.lit(SAYS["arrived"]))).when(at_end, told("straight", F.lit(SAYS["floor change"])))
    result = result.when(turn > 0, side("right")).when(turn <= 0, side("left"))
    for kind in ("escalator", "elevator"):
        result = result.when(mode == kind, told(kind, way(remaining, F.lit(ACTIONS[kind]))))
    return result.otherwise(told("straight", F.concat(rounded(remaining).cast("string"), F.lit(STRAIGHT_ON))))
