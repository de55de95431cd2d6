"""Secret scan with a random forest that removes false positives.

Candidates are the parts of a text's tokens that look like credentials: known
prefixes anywhere in a token, then urls with a password, then long runs of
letters and digits (both in one run) between these; a token has any number of them.  A name
before '=' is no part of a run's candidate.  A random forest, trained from labelled
findings, judges each by its length, its character transitions, how much of it
dictionary words cover, its path and its neighbouring words.  Everything is
DataFrame functions and the JVM's random forest; no Python runs on executors.

Labelled findings are rows (candidate, before, after, path, label); label 1 is
a secret.  ``seed_findings`` makes a bounded set of them by rule for tables
that bring none.

Defined cases: null and empty texts have no findings; tokens of any length are
searched whole;
a score at the threshold is a secret; a token that repeats is a
finding at each place; a null path is the empty path; repeated rows are scanned
row by row; labelled findings with null candidate or label are not learned
from; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, names_apart

#: Findings of the seed set, trees and their depth, least probability of a secret.
SEED_FINDINGS = 6000
TREES = 20
DEPTH = 8
THRESHOLD = 0.5
#: Words before and after a candidate that are looked at.
NEIGHBOURS = 3

# Runs of letters and digits between '='.  A long run, or a value of a name, is a candidate, with
# what follows it behind '=' unless that is a value itself; a run with neither is a candidate as a whole.
# A pattern starts at a run's start only and gives nothing back, so a token costs its length, not its square.
_RUN = "[A-Za-z0-9+/_-]"
_VALUE = f"(?={_RUN}{{8}})(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z]){_RUN}++"
_TAIL = f"(?:=++(?!{_VALUE}){_RUN}*+)*+"
_LONG = f"(?<!{_RUN})(?={_RUN}{{16}})(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z]){_RUN}++{_TAIL}"
_NAMED = f"(?<==){_VALUE}{_TAIL}"
_WHOLE = f"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{{16}})(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])(?![A-Za-z0-9+/_=-]*?(?:{_LONG}|{_NAMED}))[A-Za-z0-9+/_=-]++"
_GENERIC = f"{_LONG}|{_NAMED}|{_WHOLE}"
# Known credential formats as (kind, pattern), in order of trial.
FORMATS = (
    ("aws-access-key", r"A(?:KIA|SIA|ROA|IDA)[A-Z0-9]{16}"),
    ("github-token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("gitlab-token", r"glpat-[A-Za-z0-9_-]{20,}"),
    ("slack-token", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    ("stripe-key", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}"),
    ("google-api-key", r"AIza[A-Za-z0-9_-]{35}"),
    ("npm-token", r"npm_[A-Za-z0-9]{36}"),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]*"),
    ("url-password", r"(?<![a-z0-9+.-])(?=[0-9+.-]*+[a-z])[a-z0-9+.-]++://[^\s/:@\"<>]++:[^\s/@\"<>]++@[^\s/\"'<>,;&?#]++"),
    ("generic", _GENERIC),
)
# a token is cut by these one after another: what an earlier one finds, no later one can hide
LEVELS = ("|".join(f"(?:{p})" for _, p in FORMATS[:-2]), FORMATS[-2][1], FORMATS[-1][1])
CANDIDATE = "|".join(f"(?:{p})" for _, p in FORMATS)
# What every candidate has: letters beside digits in one run, or what a known format begins with.
MIXED = "[0-9][A-Za-z+/_=-]|[A-Za-z+/_=-][0-9]"
BEGINNINGS = "AKIA ASIA AROA AIDA ghp_ gho_ ghu_ ghs_ ghr_ glpat- xox sk_live_ sk_test_ rk_live_ rk_test_ AIza npm_ eyJ ://".split()
# Words of look-alikes, which also are the dictionary where no word list is given, and neighbours that speak for and against a secret.
DICTIONARY = (
    "password passwd secret example sample dummy changeme change your insert here test token key placeholder default admin user login value string name api access private public data file image "
    "version build release branch commit index content document page item node class static service server client config sender receiver number system module package license general "
    "about account action active address after album array article asset author backup base batch before binary block board body book border box buffer button cache call card case category center "
    "chain channel chart check child city code collection color column command comment common component connect console context control copy count country create current custom customer database date "
    "debug delete design detail device digital directory display domain download driver edit element email enable engine entry error event export factory feature field filter final first font footer form "
    "format forum frame free from function gallery game global group guide handler hash header health height help history home host html icon import info input instance integer interface internal job json "
    "label language large last layout level library line link list load local location long machine main manager map mark master member memory menu message method"
)
SPEAKS_FOR = "token secret key apikey api_key password passwd pwd auth bearer credential credentials private access signing"
SPEAKS_AGAINST = "sha sha1 sha256 sha512 md5 hash checksum digest commit revision uuid guid id etag integrity example sample placeholder fingerprint isbn order tracking"
PATH_AGAINST = "test tests spec fixture fixtures example examples sample samples mock docs vendor"

_FEATURES = [
    "known", "length", "digits", "upper", "symbols", "distinct", "transitions", "common_pairs", "vowel_pairs", "covered", "longest_letters", "is_hex", "is_uuid", "repeats", "speaks_for", "speaks_against", "assigned", "path_against",
]


#: Letters of the shortest and the longest dictionary word that counts, and how many pairs of letters count as common.
WORD_LETTERS, COMMON_PAIRS = (4, 12), 150


def word_list(path: str) -> list[str]:
    """The words of a public vocabulary file (a tokenizer's json whose whole words end with a suffix): its lower-case entries of fitting length."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    least, most = WORD_LETTERS
    words = (token.removesuffix(end) for token in model["vocab"] if token.endswith(end))
    return sorted({w for w in words if least <= len(w) <= most and w.isascii() and w.isalpha() and w.islower()})


def _pairs(words: list[str]) -> list[str]:
    """The pairs of letters that most words have."""
    seen = Counter(pair for w in words for pair in {w[k : k + 2] for k in range(len(w) - 1)})
    return [pair for pair, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:COMMON_PAIRS]]


def with_coverage(findings: DataFrame, words: list[str]) -> DataFrame:
    """findings with covered: the share of a candidate's characters that lie in dictionary words.

    Every run of a word's length within a candidate's letters is looked up by a
    join, so time does not grow with the dictionary; the dictionary is a
    vocabulary's size and broadcast.
    """
    least, most = WORD_LETTERS
    known = findings.sparkSession.range(1).select(F.explode(F.split(F.lit(" ".join(words)), " ")).alias("_word"))
    rows = cut(findings.withColumn("_row", F.monotonically_increasing_id()))
    text = F.lower("candidate")
    at = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - least + 1)), lambda i: F.struct(i.alias("i"), F.length(F.regexp_extract(F.substring(text, i, F.lit(most)), "^[a-z]+", 0)).alias("n")))
    runs = rows.select("_row", text.alias("_text"), F.explode(F.filter(at, lambda a: a["n"] >= least)).alias("a"))
    parts = runs.select("_row", "_text", F.col("a.i").alias("_at"), F.explode(F.sequence(F.lit(least), F.col("a.n"))).alias("_n"))
    found = parts.withColumn("_word", F.substring(F.col("_text"), F.col("_at"), F.col("_n"))).join(F.broadcast(known), "_word")
    # the longest word at each place covers what shorter ones there do
    longest = found.groupBy("_row", "_at").agg(F.max("_n").alias("_n"))
    places = longest.select("_row", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("_n") - 1)).alias("p")).distinct()
    covers = places.groupBy("_row").agg(F.count("*").alias("_letters"))
    out = rows.join(covers, "_row", "left")
    return out.select(*findings.columns, (F.coalesce("_letters", F.lit(0)) / F.greatest(F.length("candidate"), F.lit(1))).alias("covered"))


def _any_of(words: str) -> str:
    return "|".join(words.split())


def _as_words(words: str) -> str:
    return rf"(?i)(?:^|[^a-z0-9])(?:{_any_of(words)})(?:[^a-z0-9]|$)"


def with_features(findings: DataFrame, words: list[str] | None = None) -> DataFrame:
    """findings with candidate, before, after, path and the forest's features; words: the dictionary."""
    words = words or [w for w in DICTIONARY.split() if len(w) >= WORD_LETTERS[0]]
    findings = with_coverage(findings, words)
    c = F.col("candidate")
    length = F.length(c)
    share = lambda pattern: F.length(F.regexp_replace(c, f"[^{pattern}]", "")) / length
    # a character's class: digit, lower, upper or other; transitions are changes of class
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "[^0aA]", "-")
    known = F.lit(0.0)
    for k, (_, pattern) in reversed(list(enumerate(FORMATS[:-1], 1))):
        known = F.when(c.rlike(f"^(?:{pattern})"), float(k)).otherwise(known)
    letters = F.regexp_extract_all(c, F.lit("([A-Za-z]+)"), F.lit(1))
    # transitions between letters: the share of them that dictionary words make too
    pairs = F.regexp_extract_all(F.concat(F.lower(c), F.regexp_replace(F.lower(c), "^.", " ")), F.lit("([a-z][a-z])"), F.lit(1))
    made = F.array(*map(F.lit, _pairs(words)))
    around = F.concat_ws(" ", F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))
    yes = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    return findings.withColumns(
        {
            "known": known,
            "length": length.cast("double"),
            "digits": share("0-9"),
            "upper": share("A-Z"),
            "symbols": 1 - share("A-Za-z0-9"),
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / length,
            "transitions": 1 - F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) / length,
            "common_pairs": F.coalesce(F.size(F.filter(pairs, lambda p: F.array_contains(made, p))) / F.nullif(F.size(pairs), F.lit(0)), F.lit(0.0)),
            "vowel_pairs": F.size(F.regexp_extract_all(c, F.lit("(?i)([aeiou][bcdfghjklmnpqrstvwxyz])"), F.lit(1))) / length,
            "longest_letters": F.coalesce(F.array_max(F.transform(letters, F.length)), F.lit(0)) / length,
            "is_hex": yes(c.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
            "is_uuid": yes(c.rlike("(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
            "repeats": yes(c.rlike(r"(.)\1{4,}|(?i)x{4,}|1234|abcd")),
            "speaks_for": yes(around.rlike(_as_words(SPEAKS_FOR))),
            "speaks_against": yes(around.rlike(_as_words(SPEAKS_AGAINST))),
            "assigned": yes(F.col("before").rlike(r"[=:]\s*[\"']?\s*$")),
            "path_against": yes(F.col("path").rlike(_as_words(PATH_AGAINST))),
        }
    )


def _cuts(token: Column) -> Column:
    """A token as what lies before its first candidate, the candidate, what lies before the next, and so on."""
    cuts = F.array(token)
    for pattern in LEVELS:
        part = lambda x, p=pattern: F.flatten(F.zip_with(F.split(x, p), F.regexp_extract_all(x, F.lit(p), F.lit(0)), lambda gap, hit: F.when(hit.isNull(), F.array(gap)).otherwise(F.array(gap, hit))))
        cuts = F.flatten(F.transform(cuts, lambda x, i: F.when(i % 2 == 1, F.array(x)).otherwise(part(x))))
    return cuts


def suspicious(text: Column) -> Column:
    """Whether a text holds a candidate; cheap tests decide for most."""
    begun = F.lit(False)
    for word in BEGINNINGS:
        begun = begun | text.contains(word)
    return (text.rlike(MIXED) | begun) & text.rlike(CANDIDATE)


def candidates(docs: DataFrame, *keep: str, path: str | None = None) -> DataFrame:
    """keep..., word (number of the token, from 0), kind, candidate, before, after, path of each candidate."""
    where = F.col(path).cast("string") if path else F.lit("")
    rows = docs.where(suspicious(F.col("text"))).select(*keep, F.coalesce(where, F.lit("")).alias("path"), F.split("text", r"[\x20\x09-\x0D]+").alias("w"))
    tokens = rows.select(*keep, "path", "w", F.explode(F.filter(F.transform("w", lambda x, i: F.struct(i.alias("word"), x.alias("token"))), lambda h: suspicious(h["token"]))).alias("h"))
    earlier = F.slice("w", F.greatest(F.col("h.word") - NEIGHBOURS + 1, F.lit(1)), F.least(F.col("h.word"), F.lit(NEIGHBOURS)))
    later = F.slice("w", F.col("h.word") + 2, F.lit(NEIGHBOURS))
    cuts = tokens.select(*keep, "path", "h.word", F.array_join(earlier, " ").alias("earlier"), F.array_join(later, " ").alias("later"), _cuts(F.col("h.token")).alias("cuts"))
    # within a token, neighbours reach to the candidate before and after; a separator between two parts their sides
    last = F.size("cuts") - 2
    gap = lambda i: F.get("cuts", i)
    before = lambda i: F.when(i == 1, F.concat("earlier", F.lit(" "), gap(i - 1))).otherwise(F.regexp_replace(gap(i - 1), r"^[^,;&|]+(?=[,;&|])", ""))
    after = lambda i: F.when(i == last, F.concat(gap(i + 1), F.lit(" "), "later")).otherwise(F.regexp_extract(gap(i + 1), r"^[^,;&|]*", 0))
    places = F.filter(F.sequence(F.lit(0), last), lambda i: i % 2 == 1)
    hits = cuts.select(*keep, "path", "word", F.explode(F.transform(places, lambda i: F.struct(gap(i).alias("candidate"), before(i).alias("before"), after(i).alias("after")))).alias("h"))
    kind: Column = F.lit("generic")
    for name, pattern in reversed(FORMATS[:-1]):
        kind = F.when(F.col("h.candidate").rlike(f"^(?:{pattern})"), name).otherwise(kind)
    return hits.select(*keep, F.col("word").cast("long").alias("word"), kind.alias("kind"), "h.candidate", "h.before", "h.after", "path")


def seed_findings(spark: SparkSession, count: int = SEED_FINDINGS) -> DataFrame:
    """``count`` labelled findings by rule: half are secrets in the ways people paste them, half look-alikes."""
    i = F.col("id")
    h = F.sha2(F.concat(F.lit("seed"), i.cast("string")), 512)
    b = F.regexp_replace(F.base64(F.unhex(h)), "[+/=]", "Z")
    pick = lambda values, salt: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(values))) + 1).cast("int"))
    words = lambda n: F.concat_ws("_", *(pick(DICTIONARY.split(), f"w{k}") for k in range(n)))
    name = pick(SPEAKS_FOR.split(), "name")
    against = pick(SPEAKS_AGAINST.split(), "against")
    lead = F.concat(pick(["", "the ", "export ", "set ", "const my ", "use this "], "lead"), name, pick([" = \"", ": ", "=", " := '", " is "], "sign"))
    form = F.pmod(F.xxhash64(i, F.lit("form")), F.lit(8))
    secret = (
        F.when(form == 0, F.substring(h, 1, 40)).when(form == 1, F.substring(h, 1, 32)).when(form == 2, h.substr(1, 64)).when(form == 3, b.substr(1, 40))
        .when(form == 4, F.concat(F.lit("AKIA"), F.upper(b.substr(1, 16)))).when(form == 5, F.concat(F.lit("ghp_"), b.substr(1, 36)))
        .when(form == 6, F.concat(F.lit("sk_live_"), b.substr(1, 24))).otherwise(F.concat(F.lit("AIza"), b.substr(1, 35)))
    )
    uuid = F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))
    look_alike = (
        F.when(form == 0, F.substring(h, 1, 40)).when(form == 1, F.substring(h, 1, 32)).when(form == 2, h.substr(1, 64)).when(form == 3, uuid)
        .when(form == 4, F.concat(words(3), F.lit("_"), F.pmod(i, F.lit(100)).cast("string"))).when(form == 5, F.concat(F.lit("xxxxxxxxxxxxxxxx"), F.pmod(i, F.lit(1000)).cast("string")))
        .when(form == 6, F.concat(words(2), F.lit("-v"), F.pmod(i, F.lit(9)).cast("string"), F.lit("-example-key"))).otherwise(F.concat(F.initcap(pick(DICTIONARY.split(), "x")), F.initcap(pick(DICTIONARY.split(), "y")), F.initcap(pick(DICTIONARY.split(), "z")), F.lit("Handler2")))
    )
    is_secret = F.pmod(i, F.lit(2)) == 0
    hashed = form <= 2
    # a known format is a secret without a word beside it too
    bare = is_secret & (form >= 4) & (F.pmod(F.xxhash64(i, F.lit("bare")), F.lit(3)) > 0)
    before = F.when(bare, pick(["", '{"a":"', ',"b":"', "1,order,", "url=", "see "], "s4")).when(is_secret, lead).when(hashed, F.concat(against, pick([" ", ": ", " is ", "="], "s2"))).otherwise(F.concat(pick(["the ", "see ", "a ", ""], "s3"), F.when(F.pmod(i, F.lit(3)) == 0, lead).otherwise(F.lit(""))))
    # what stands before has often nothing to do with it, whatever it speaks of
    before = F.concat(pick(["", "", "", "", "jo.5@mail.example.com ", "the order ", "a test, "], "aside"), before)
    path = pick(["src/app.py", "config/prod.yaml", "web", "notes", ".env", ""], "path")
    return spark.range(count).select(
        F.when(is_secret, secret).otherwise(look_alike).alias("candidate"),
        before.alias("before"),
        pick(['" ', "' ;", " and", "", " in the"], "after").alias("after"),
        F.when(~is_secret & (F.pmod(i, F.lit(5)) == 1), F.lit("tests/fixtures/data.py")).otherwise(path).alias("path"),
        is_secret.cast("int").alias("label"),
    )


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, words: list[str] | None = None) -> PipelineModel:
    """A forest from labelled findings (candidate, before, after, path, label); words: the dictionary, which must be that of the scan."""
    rows = with_features(labelled.where("candidate is not null and candidate <> '' and label in (0, 1)"), words).select(*_FEATURES, F.col("label").cast("double").alias("label"))
    assembler = VectorAssembler(inputCols=_FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=17, featuresCol="features", labelCol="label")
    return PipelineModel([assembler, forest.fit(assembler.transform(cut(rows)))])


def judged(found: DataFrame, model: PipelineModel, threshold: float = THRESHOLD, words: list[str] | None = None) -> DataFrame:
    """found with score (probability of a secret) and is_secret."""
    scored = model.transform(with_features(found, words))
    probability = F.element_at(vector_to_array("probability"), 2)
    return scored.select(*found.columns, probability.alias("score"), (probability >= threshold).alias("is_secret"))


def scan(docs: DataFrame, model: PipelineModel, path: str | None = None, threshold: float = THRESHOLD, words: list[str] | None = None) -> DataFrame:
    """doc_id, word, kind, secret_sha256, length, score, is_secret of each candidate; the secret itself is not repeated."""
    found = judged(candidates(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", path=path), model, threshold, words)
    return found.select("doc_id", "word", "kind", F.sha2("candidate", 256).alias("secret_sha256"), F.length("candidate").cast("long").alias("length"), "score", "is_secret")


def redact(docs: DataFrame, model: PipelineModel, path: str | None = None, mark: str = "[SECRET]", threshold: float = THRESHOLD, words: list[str] | None = None) -> DataFrame:
    """docs, all columns and rows kept, with each secret of a text replaced by ``mark``.

    Only texts with a candidate are joined with their findings, by hashes of id
    and text; a text that repeats under its id has the same findings.  Other
    columns may have any names.
    """
    docs, back = names_apart(docs)
    has = F.coalesce(suspicious(F.col("text")), F.lit(False))
    name = F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", "doc_id", F.lit(1)).alias("b"))
    named = cut(docs.where(has).withColumn("_name", name))
    found = judged(candidates(named, "_name", path=path), model, threshold, words).where("is_secret")
    secrets = found.groupBy("_name").agg(F.collect_set("candidate").alias("_secrets"))
    # the longest first, so that none is left in part where one holds another
    longest_first = F.array_sort("_secrets", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    clean = F.aggregate(F.coalesce(longest_first, F.array().cast("array<string>")), F.col("text"), lambda text, s: F.replace(text, s, F.lit(mark)))
    kept = named.join(secrets, "_name", "left").select(*(clean.alias("text") if c == "text" else F.col(c) for c in docs.columns))
    return back(docs.where(~has).unionByName(kept))
