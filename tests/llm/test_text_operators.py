"""Operators over texts against brute force, with the cases that their docstrings define."""

import hashlib
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from waymark.llm import decontaminate, html, jaccard, langid, licenses, packing, secrets, toxicity

DATA = "/root/testdata/sf0.001"
ODD = [(1000001, None), (1000002, ""), (1000003, "   \n"), (1000004, "one two"), (1000004, "one two"), (None, "a b c d e f"), (1000005, "x" * 3000 + " y" * 3000), (1000006, "+-/ ..."), (1000007, "née 日本語 🙂 <|endoftext|> b")]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(0).cast("long")})
    # columns whose names clash with the operators' own
    return spark.read.parquet(f"{DATA}/documents.parquet").unionByName(odd).withColumns({"n": F.lit(1), "key": F.lit("k"), "score": F.lit(0.5), "cid": F.lit(3), "row": F.lit(9), "component": F.lit(2)})


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def test_jaccard_components(docs):
    rows = [(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", lower(r.text))) for r in docs.collect()]
    sets = [(i, frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()) for i, w in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for e in s:
            by[e].add(k)
    for k, (_, s) in enumerate(sets):
        for m in {m for e in s for m in by[e] if m > k}:
            both = len(s & sets[m][1])
            if 100 * both >= 80 * (len(s) + len(sets[m][1]) - both):
                parent[root(m)] = root(k)
    least = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        least[root(k)].append(i)
    want = sorted(((i, len(s), min((x for x in least[root(k)] if x is not None), default=None) if s else i) for k, (i, s) in enumerate(sets)), key=repr)
    # the broadcast and the shuffle give the same, as do lists alone, subsets alone and a boundary between
    boundaries = {}
    for classes, price in ((1_000_000, 64.0), (0, 1.0), (1_000_000, 0.0), (1_000_000, 1e9)):
        join = jaccard.JaccardJoin(docs, broadcast_classes=classes, subset_price=price)
        assert sorted((tuple(r) for r in join.components().collect()), key=repr) == want
        boundaries[price] = join.boundary
    assert boundaries[1e9] <= boundaries[64.0] <= boundaries[1.0] <= boundaries[0.0] and boundaries[1e9] < boundaries[0.0]


def test_boundary_by_cost(spark):
    """Many short near copies of one text are dearer to scan than to enumerate; long texts that share little are not."""
    short = [" ".join([*(f"s{j}" for j in range(30)), f"x{k}"]) for k in range(1200)]
    long = [" ".join(["the same passage of seven words here", *(f"l{k}n{j}" for j in range(300))]) for k in range(40)]
    texts = short + long + [" ".join(long[0].split()[:-3])]
    join = jaccard.JaccardJoin(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r.component_id for r in join.components().collect()}
    assert 27 <= join.boundary < 290
    assert got == {k: 0 for k in range(1200)} | {k: k for k in range(1200, 1240)} | {1240: 1200}


def test_one_of_each_group_stays(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(5, " ".join(words)), (3, " ".join(words)), (9, " ".join([*words, "x"])), (7, "other text of its own"), (8, None), (3, " ".join(words))]
    kept = jaccard.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [3, 7, 8]


def test_all_links_and_rows_of_one_id(spark):
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join([*words[: 60 - k], *(f"n{j}" for j in range(k))]) for k in range(9)] + [" ".join(words), "a b c d e f", "a b c d e f g", "", None]
    join = jaccard.JaccardJoin(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    members, pairs = join.all_links()
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if (w := (t or "").split()) else set() for t in texts]
    near = lambda a, b: bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)
    expected = {i: sum(i != j and near(a, b) for j, b in enumerate(sets)) for i, a in enumerate(sets)}
    assert {r.doc_id: r.n_links for r in members.collect()} == expected
    assert pairs.count() == sum(near(a, b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j) - sum(near(sets[0], b) for b in sets[1:9]) - 1
    one, two = " ".join(words), "quite another text of its own here"
    rows = [(1, one), (2, one), (2, two), (None, one + " x"), (None, "nobody else has this text"), (4, ""), (4, None), (5, "five " + two), (5, one)]
    kept = jaccard.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, kept)) == sorted(map(str, (spark.createDataFrame([rows[k] for k in (0, 2, 4, 5, 6, 7)], "doc_id long, text string")).collect()))


def test_packing_ids_bins_and_round_trip(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    out = packing.pack(docs.drop("row"), path).collect()
    texts = docs.collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in texts}
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in out:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own)) and len(own) == r.length
        assert r.length == 1024 or r.piece == 0
        pieces[r.doc_id].append(r.length)
        bins[r.sequence_id].append((r.offset, r.length))
    assert {k: sum(v) for k, v in pieces.items()} == {k: len(ids[k]) * (2 if k == 1000004 else 1) for k in ids}
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    # plain best-fit decreasing, bin by bin
    rooms = []
    for length in sorted((r.length for r in out), reverse=True):
        fit = min((x for x in rooms if x >= length), default=None)
        if fit is None:
            rooms.append(1024 - length)
        else:
            rooms[rooms.index(fit)] = fit - length
    assert len(bins) == len(rooms)


def test_decontamination(spark, docs):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet").unionByName(spark.createDataFrame([(900001, "One two"), (900002, None), (900003, "...")], "item_id long, text string"))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for r in bench.collect():
        w = word.findall(lower(r.text))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(r.item_id)
    want = []
    for r in docs.collect():
        w, hit, items = word.findall(lower(r.text)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
        want.append((r.doc_id, len(w), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(w)))
    for most in (1_000_000, 0):
        got = [tuple(r) for r in decontaminate.contamination(docs, bench, broadcast_windows=most).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    bad = {(x[0], x[1]) for x in want if x[-1]}
    for options in ({}, {"broadcast_windows": 0}, {"broadcast_bytes": 1}):
        kept = decontaminate.decontaminate(docs, bench, **options)
        assert kept.columns == docs.columns and kept.count() == sum(not x[-1] for x in want)
        assert not {r.doc_id for r in kept.collect()} & {i for i, _ in bad}


def test_license_base_phrases(docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = sorted((tuple(r)[:6] for r in licenses.scan(docs).collect()), key=repr)
    want = []
    for r in docs.collect():
        w, at, labels = word.findall(lower(r.text)), [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    labels.add(label)
        want.append((r.doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert got == sorted(want, key=repr)


def test_license_rules():
    rules = licenses.make_rules()
    assert len(rules) > 200 and [r.priority for r in rules] == sorted(r.priority for r in rules)
    labels = lambda s: {r.label for _, _, r in licenses.detect(s, rules)}
    assert labels("licensed under the apache license version 2 0") == {"apache-2.0"}
    assert labels("spdx license identifier mit") == {"mit"}
    assert labels("gnu lesser general public license v2 1 or later") == {"lgpl-2.1"}
    assert labels("the apache tribe and a license to drive") == set()


def test_every_license_rule_passes_the_gate(spark):
    from itertools import product
    from re import _parser

    def samples(parsed):
        def of(op, value):
            match str(op):
                case "LITERAL":
                    return [chr(value)]
                case "IN":
                    return [chr(v) for _, v in value]
                case "SUBPATTERN":
                    return samples(value[3])
                case "BRANCH":
                    return [x for branch in value[1] for x in samples(branch)]
                case "MAX_REPEAT":
                    return ["", *samples(value[2])]
                case "ASSERT_NOT":
                    return [""]
            raise ValueError(op)

        return ["".join(parts) for parts in product(*(of(op, value) for op, value in parsed))]

    rules = licenses.make_rules()
    opens = re.compile(licenses.gate(rules))
    for rule in rules:
        for sample in samples(_parser.parse(rule.pattern.pattern)):
            assert rule.pattern.fullmatch(sample) and opens.search(sample) and any(word in sample for word in rule.keywords), (rule.label, sample)
    docs = spark.createDataFrame([(1, "Released under CC Zero."), (2, "GFDL 1.3"), (3, "an example of a couple")], "doc_id long, text string")
    assert {r.doc_id: (r.labels, r.score > 0) for r in licenses.scan(docs).collect()} == {1: ("cc0", True), 2: ("fdl-1.3", True), 3: ("", False)}


def test_html_blocks():
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><div class="ad">Buy</div>
    <article><header><h1>Title &amp; all</h1></header><p>One <b>two<br>three<p>Caf&eacute; &#x263A; &copy
    <aside>side</aside><form>f</form><div id="comments"><p>Nice!</p></div><script>x("</p>")</script></article><footer>foot</footer></body>"""
    assert html.main_text(page) == "Title & all\nOne two three\nCafé ☺ ©"
    assert html.main_text(None) == "" and html.main_text("") == "" and html.main_text("<nav>menu</nav>") == ""
    assert html.main_text("<article><p>cut off <a href='x") == "cut off"


def test_html_wrappers_stay_open():
    body = "<p>The text, of some length, goes on here. And on.</p>"
    text = "The text, of some length, goes on here. And on."
    for wrapper in ('body class="single no-sidebar sidebar"', 'div class="content with-sidebar"', 'div id="page-with-comments"', 'div class="has_sidebar"', 'div class="layout-sidebar"'):
        assert html.main_text(f"<{wrapper}>{body}</{wrapper.split()[0]}>") == text, wrapper
    assert html.main_text(f'<div class="sidebar"><div class="widget"><article>{body}</article></div></div><div class="sidebar">side</div>') == text
    assert html.main_text(f'<article><div class="entry-header"><h1>Title</h1></div><div class="article_header">By me</div>{body}<div class="post-share">Share</div></article>') == f"Title\nBy me\n{text}"
    assert html.main_text(f'<div class="nav">a, b. c</div><article class="comment">no</article>{body}') == text


def test_toxicity_ignores_identity_swaps(spark):
    text = lambda k: "women are idiot here" if k % 4 == 0 else "men said hello today" if k % 4 == 1 else "the moron idiot there" if k % 4 == 2 else "a calm day by the sea"
    docs = spark.createDataFrame([(k, text(k)) for k in range(80)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(80)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    import pyarrow as pa

    w, m, bad = model.scores(pa.array(["women went home", "men went home", "you idiot"]))
    free = toxicity.fit(docs, labels, penalty=0.0).scores(pa.array(["women went home", "men went home"]))
    assert abs(w - m) < 0.1 < abs(free[0] - free[1]) and bad > 0.7
    out = toxicity.score(docs, labels)
    assert out.count() == 82 and out.where("score is null or score < 0 or score > 1").isEmpty()
    assert toxicity.score(docs, labels.limit(0)).where("predicted <> 0").isEmpty()
    assert toxicity.score(docs.limit(0), labels).isEmpty()


def test_html_ratios_decide():
    body = "<p>The text, of some length, goes on here. And on, as texts do; it has sentences.</p>" * 3
    text = "\n".join(["The text, of some length, goes on here. And on, as texts do; it has sentences."] * 3)
    menu = "".join(f"<a href=/{k}>Item {k}</a> " for k in range(9))
    # nothing says what is what but the ratios
    assert html.main_text(f"<body><div>{menu}</div><div><h1>Title</h1>{body}<ul><li>One</ul>{body}</div><div>All rights to me</div></body>") == f"Title\n{text}\nOne\n{text}"
    assert html.main_text(f"<body><div>{menu}</div><div>{body}</div></body>", 0.0) != text
    # a teaser article does not hide the text beside it, nor join the article that holds it
    teaser = "<article><h3>More</h3><p>Short words</p></article>"
    assert html.main_text(f"<div><div>{teaser}{teaser}</div><div><div>{body}</div></div></div>") == text
    assert html.main_text(f"<main><article><h1>Title</h1>{body}<p>End</p></article>{teaser}</main>") == f"Title\n{text}\nEnd"
    # names: an article may be open to comments, an addition counts by its own ratios
    assert html.main_text(f"<main><article class='post comments-open'>{body}<div class=comments><p>Nice, is it not. I think so, too.</p></div></article></main>") == text
    assert html.main_text(f"<article>{body}<div class=related>{body}</div><div class=related><a href=x>Other</a></div></article>") == f"{text}\n{text}"
    # stray quotes are part of names
    assert html.main_text(f"<article><p class=x'>It's raining. {body}</article>") == f"It's raining.\n{text}"
    assert html.main_text(f"<article><p title=\"a > b\" x='<p>'>{body[3:]}</article>") == text


def test_html_long_and_deep_pages(spark):
    import time

    began = time.time()
    assert html.main_text("<div>" * 20_000 + "Deep text, is it. Yes") == "Deep text, is it. Yes"
    assert html.main_text("<article>" + "<p>a b, c." * 100_000) == "\n".join(["a b, c."] * 100_000)
    assert html.main_text("<article><ul>" + "<li>a b, c." * 50_000) == "\n".join(["a b, c."] * 50_000)
    assert html.main_text('<a href="' * 50_000 + "<") is not None
    assert time.time() - began < 30
    rows = [(1, "u", "<p>One.</p>", "x", "y"), (1, "u", "<p>One.</p>", "x", "y"), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    assert sorted(map(tuple, html.extract(pages).collect()), key=repr) == [(1, "u", "One.", 4), (1, "u", "One.", 4), (None, None, "", 0)]


def test_swaps_are_those_of_the_swapped_sentences():
    import numpy as np
    import pyarrow as pa

    from waymark.llm.kernels import LETTERS_DIGITS, words

    def own(text):
        part = next(words(pa.array([text]), LETTERS_DIGITS))
        return set(toxicity.features(part)[0].tolist())

    terms = toxicity.Terms()
    texts = ["All women sing. Some women, and womens clubs, dance! The men rest", "muslims met christians", "", "nothing here", "une femmes dit. noirs"]
    part = next(words(pa.array(texts), LETTERS_DIGITS))
    got = {}
    for k, lost, gained in toxicity.swaps(part, terms):
        got.setdefault(k, set()).add((frozenset(lost), frozenset(gained)))
    for k, text in enumerate(texts):
        want = set()
        for sentence in re.findall(r"[^.!?\n]+", text):
            for kind in toxicity.IDENTITY:
                for a in kind:
                    if re.search(rf"\b{a}\b", sentence.lower()):
                        for b in (x for x in kind if x != a):
                            swapped = text.replace(sentence, re.sub(rf"\b{a}\b", b, sentence.lower()))
                            want.add((frozenset(own(text) - own(swapped)), frozenset(own(swapped) - own(text))))
        assert want <= got[k]
        put = [x for x in got[k] if not x[0]]
        assert len(put) >= 1 and len(got[k] - want) <= 2
    assert len(terms.own) == sum(map(len, toxicity.IDENTITY)) and np.all(np.diff(terms.words.astype(float)) >= 0)


def test_toxicity_cases(spark):
    bad, good = "you idiot clown go away now", "the sea was calm and the day long"
    docs = spark.createDataFrame([(k, bad if k % 2 else good, "x", "y") for k in range(60)] + [(500, "word " * 200_000 + bad, "x", "y"), (501, None, None, None), (500, good, "x", "y")], "doc_id long, text string, label string, place string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(k, k % 2) for k in range(9)] + [(7, 0), (8, None), (None, 1), (9, 5)], "doc_id long, toxic int")
    out = toxicity.score(docs, labels)
    assert out.count() == 63 and out.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").isEmpty()
    assert out.where("doc_id < 60 and predicted <> doc_id % 2").isEmpty()
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and sorted(kept.where("doc_id >= 500").select("doc_id").collect()) == [(500,), (501,)]
    assert toxicity.keep_clean(docs.limit(0), labels).isEmpty() and toxicity.keep_clean(docs, labels.limit(0)).count() == 63
    gap = toxicity.swap_gap(docs, toxicity.fit(docs, labels)).first()
    assert gap.n >= 60 and gap.most_gap < 0.05


def test_language_held_out_accuracy(spark, docs):
    out = langid.identify(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    known = docs.where("lang is not null").select("doc_id", "lang")
    judged = out.where("held_out").join(known, "doc_id")
    assert judged.where("lang = lang_pred").count() >= 0.95 * judged.count()
    odd = {r.doc_id: r.lang_pred for r in out.where("doc_id >= 1000001").collect()}
    assert odd[1000001] == odd[1000002] == odd[1000006] == "und" != odd[1000004]
    assert langid.identify(docs.limit(0), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).isEmpty()


def test_forward_sums_all_segmentations():
    import numpy as np

    pieces = [b" ", b"a", b"b", b" a", b"ab"]
    p = np.array([[0.2], [0.3], [0.1], [0.25], [0.15], [0.0]])
    data = np.frombuffer(b" ab", np.uint8)
    table = langid.PieceTable(pieces)
    sums = langid.forward(langid.lattice(table, data, np.array([0]), np.array([3])), np.array([3]), p)
    assert abs(sums[0, 3, 0] - (0.2 * 0.3 * 0.1 + 0.25 * 0.1 + 0.2 * 0.15)) < 1e-12


def test_language_words_and_pieces_of_any_length():
    import numpy as np

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    everything = langid.load_pieces(path)
    assert max(map(len, everything)) == 33
    pieces = [bytes([b]) for b in b" abcd"] + [b"ab", b" abcdabcdabcd", b"bcda", b"abcdabcdabcdabcdabcdabcdabcdabcda"]
    rng = np.random.default_rng(1)
    p = np.vstack([rng.random((len(pieces), 2)) * 1e-3, np.zeros((1, 2))])
    words = [b" " + b"abcd" * 20, b" " + b"abcda", b" " + b"dcba" * 3000]
    length = np.array([len(w) for w in words])
    start = np.cumsum(length) - length
    table = langid.PieceTable(pieces)
    data = np.frombuffer(b"".join(words), np.uint8)
    logs = langid.log_mass(table, data, start, length, p)[-1]
    total, counts = np.zeros_like(p), np.zeros_like(p)
    for lang in (0, 1):
        langid.expected(table, data, start, length, np.full(3, lang), np.ones(3), p, counts)
    for k, word in enumerate(words):
        for lang in (0, 1):
            # sums of whole segmentations in logarithms, and counts from their sums from both sides
            hits = [[(j, i) for j, x in enumerate(pieces) if word[:i].endswith(x)] for i in range(len(word) + 1)]
            ahead = np.full(len(word) + 1, -np.inf)
            ahead[0] = 0
            for i in range(1, len(word) + 1):
                ahead[i] = np.logaddexp.reduce([ahead[i - len(pieces[j])] + np.log(p[j, lang]) for j, _ in hits[i]])
            behind = np.full(len(word) + 1, -np.inf)
            behind[-1] = 0
            for i in range(len(word), 0, -1):
                for j, _ in hits[i]:
                    b = i - len(pieces[j])
                    total[j, lang] += np.exp(ahead[b] + np.log(p[j, lang]) + behind[i] - ahead[-1])
                    behind[b] = np.logaddexp(behind[b], behind[i] + np.log(p[j, lang]))
            assert abs(logs[k, lang] - ahead[-1]) < 1e-6
    assert np.allclose(counts, total)


def test_secrets(spark):
    token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    rows = [(1, f'set token = "{token}" now', "web"), (2, f"see commit {token} for it", "web"), (3, None, None), (4, "", "web"), (5, "nothing here 4929348385146306", "web"), (1, f'set token = "{token}" now', "web")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"label": F.lit(1), "path": F.lit("p"), "features": F.lit(2)})
    model = secrets.train(secrets.seed_findings(spark, 2000))
    found = secrets.scan(docs, model, path="source").collect()
    assert sorted((r.doc_id, r.is_secret) for r in found) == [(1, True), (1, True), (2, False)]
    clean = {r.doc_id: r.text for r in secrets.redact(docs, model, path="source").collect()}
    assert clean[1] == 'set token = "[SECRET]" now' and token in clean[2] and clean[3] is None and clean[4] == ""
    assert secrets.redact(docs, model, path="source").columns == docs.columns
    assert secrets.scan(docs.limit(0), model, path="source").isEmpty()


def test_every_secret_of_a_token(spark):
    aws, hub, google = "AKIA" + "Q3ZJ7XKW2MTB5RVN", "ghp_" + "a8Kd03LmQz5Xw7Rt2Yv9Bn4Cf6Hj1PsGkTuE", "AIza" + "SyD3k9Qw7Rt2Yv9Bn4Cf6Hj1PsGkTuE0aZx"
    digest = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    texts = [
        f'{{"a":"{aws}","b":"{hub}"}}', f"GITHUB_TOKEN={hub}", f"api_key={google}&user=x", f"1,order-1234567890123456,{aws}", f"secret={digest}&token={hub}",
        f"url=http://h:80,{hub},me@x.org", "password=hunter2hunter2", f"https://u:pw1@host?key={digest}", f"token = {digest} end", "AWS_S3_SECRET_ACCESS_KEY=Zq81LmnQ",
        "abcdefghijklmnop=ab1", "a=" * 20000 + "b1", ",".join([digest] * 2000),
    ]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = defaultdict(list)
    for r in secrets.candidates(docs, "doc_id").collect():
        found[r.doc_id].append((r.kind, r.candidate, r.before, r.after))
    names = {k: [x[:2] for x in v] for k, v in found.items()}
    assert names[0] == [("aws-access-key", aws), ("github-token", hub)] and names[1] == [("github-token", hub)] and names[2] == [("google-api-key", google)]
    assert names[3] == [("generic", "order-1234567890123456"), ("aws-access-key", aws)] and names[4] == [("generic", digest), ("github-token", hub)]
    assert ("github-token", hub) in names[5] and names[6] == [("generic", "hunter2hunter2")] and names[7] == [("url-password", "https://u:pw1@host"), ("generic", digest)]
    assert found[8] == [("generic", digest, "token = ", " end")] and names[9] == [("generic", "AWS_S3_SECRET_ACCESS_KEY"), ("generic", "Zq81LmnQ")]
    assert names[10] == [("generic", "abcdefghijklmnop=ab1")] and len(names[11]) == 1 and len(names[12]) == 2000
    assert found[0][1][2:] == (',"b":"', '"} ') and found[1][0][2] == " GITHUB_TOKEN="
    model = secrets.train(secrets.seed_findings(spark, 2000))
    few = docs.where("doc_id < 5")
    assert {(r.doc_id, r.secret_sha256) for r in secrets.scan(few, model).where("is_secret").collect()} >= {(k, hashlib.sha256(x.encode()).hexdigest()) for k, x in [(0, aws), (0, hub), (1, hub), (2, google), (3, aws), (4, hub)]}
    clean = {r.doc_id: r.text for r in secrets.redact(few, model).collect()}
    assert clean[0] == '{"a":"[SECRET]","b":"[SECRET]"}' and clean[1] == "GITHUB_TOKEN=[SECRET]" and hub not in clean[4] and aws not in clean[3]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert jaccard.jaccard_components(none).isEmpty() and licenses.scan(none).isEmpty()
    assert decontaminate.contamination(none, bench).isEmpty() and packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")).isEmpty()
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").isEmpty()
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


def test_long_texts_take_linear_time(spark, tmp_path):
    import time

    texts = ["a" * 1_000_000, "abcdefghijklmnop." * 60_000, "https://" * 125_000, "a1" * 500_000, " " * 1_000_000 + "a", "gnu gpl " * 125_000, "apache license version 2 0 or later " * 28_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(len(texts)).write.parquet(str(tmp_path / "long"))
    docs = spark.read.parquet(str(tmp_path / "long"))
    model = secrets.train(secrets.seed_findings(spark, 1000))
    path = public_tokenizers.path("byte_bpe_50k.json")
    began = time.time()
    assert {(r.doc_id, r.length) for r in secrets.scan(docs, model).collect()} == {(3, 1_000_000)}
    assert {r.doc_id: (r.labels, r.n_words) for r in licenses.scan(docs).where("doc_id >= 5").collect()} == {5: ("gpl", 250_000), 6: ("apache,apache-2.0", 196_000)}
    spaces = packing.pack(docs.where("doc_id = 4"), path).collect()
    ids = [*Tokenizer.from_file(path).encode(texts[4], add_special_tokens=False).ids, 2]
    assert sum(r.length for r in spaces) == len(ids)
    assert all(r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length])) for r in spaces)
    assert time.time() - began < 90


def test_license_suppression_by_priority_and_place():
    rules = licenses.make_rules()
    texts = ["gnu gpl version 2 or later gnu gpl", "licensed under the apache license version 2 0 apache license", "cc by sa 4 0 cc by nc nd cc by", "spdx license identifier mit mit license"]
    for text in texts:
        hits = [(m.start(), m.end(), r, k) for k, r in enumerate(rules) if any(w in text for w in r.keywords) for m in r.pattern.finditer(text)]

        def hidden(a, b, r, k):
            return any(
                c <= a and b <= d and (s.priority < r.priority or (s.priority == r.priority and (d - c > b - a or (n < k and s.label != r.label))))
                for c, d, s, n in hits
            )

        assert {(a, b, r.label) for a, b, r in licenses.detect(text, rules)} == {(a, b, r.label) for a, b, r, k in hits if not hidden(a, b, r, k)}
