"""Hard negatives, URL filters and spelling variants against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from goldmatch.llm import hardneg, spelling, urlfilter
from goldmatch.llm import queries as Q

SMALL = "/root/testdata/sf0.001"


# --- hard negatives ----------------------------------------------------------


def brute_negatives(rows, is_anchor, positives=5, negatives=5):
    clean = set()
    for vec_id, label, v in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = tuple(math.floor(256 * x) for x in v)
        if sum(x * x for x in whole) < hardneg.MAX_NORM:
            clean.add((vec_id, label, whole))
    out = []
    for a in (r for r in clean if is_anchor(r[0])):
        scored = [(sum(x * y for x, y in zip(a[2], b[2])), b) for b in clean if b[0] != a[0] and len(b[2]) == len(a[2])]
        best = sorted(((-s, b[0]) for s, b in scored if b[1] == a[1]))[:positives]
        for p, positive in best:
            fits = [(-s, b[0]) for s, b in scored if b[1] != a[1] and -80 * p <= 100 * s <= -100 * p]
            out += [(a[0], positive, i + 1, n, -p, -s) for i, (s, n) in enumerate(sorted(fits)[:negatives])]
    return sorted(out)


def shrink(monkeypatch):
    for name, value in {"BLOCK_ROWS": 64, "LANE_SEARCHES": 8, "FANOUT": 4, "LEAF": 8, "BATCH": 7, "CELLS": 5, "SAMPLE": 40}.items():
        monkeypatch.setattr(hardneg, name, value)


def test_negatives_query(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows]
    got = sorted(tuple(r) for r in Q.op11_hard_negatives(spark, SMALL).collect())
    assert got == brute_negatives(rows, lambda i: i % 100 == 0) and got


VECTORS = "vec_id long, label int, embedding array<double>, request int, block string, cell int"


def test_negatives_odd_rows(spark, monkeypatch):
    """Nulls, non-finite and huge components, several lengths, copies, ties and clashing columns."""
    shrink(monkeypatch)
    rng = random.Random(3)
    rows = [(i, rng.randrange(4), [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)]
    rows += [(1000 + i, i % 3, [0.5, 0.25, 0.125, 0.0, 1.0, -1.0]) for i in range(120)]  # copies
    rows += [(2000 + i, i % 2, [float(i % 5), 1.0]) for i in range(30)]  # shorter ones, with ties
    rows += [(3000 + i, i % 2, [2.0**19 + rng.randrange(50), 2.0**18, 3.0 * i]) for i in range(40)]  # beyond exact doubles
    rows += [(4000 + i, i % 2, []) for i in range(3)]
    bad = [None, [None, 1.0, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] * 6, [1e30] * 6, [0.0] * 6]
    rows += [(5000 + i, 1, v) for i, v in enumerate(bad)] + [(None, 1, [1.0] * 6), (6000, None, [1.0] * 6)]
    rows += rows[:20] + [(7, 3, [1.0] * 6)]  # repeated rows, and one vec_id with two vectors
    table = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)
    got = sorted(tuple(r) for r in hardneg.hard_negatives(table, table.where("vec_id % 5 = 0")).collect())
    assert got == brute_negatives(rows, lambda i: i % 5 == 0)


def test_negatives_few_rows(spark, monkeypatch):
    shrink(monkeypatch)
    table = spark.createDataFrame([(0, 1, [1.0, 0.0], 0, "", 0), (1, 1, [1.0, 0.1], 0, "", 0), (2, 2, [0.9, 0.0], 0, "", 0), (3, 2, [-1.0, 0.0], 0, "", 0)], VECTORS)
    assert [tuple(r) for r in hardneg.hard_negatives(table, table.where("vec_id = 0")).collect()] == [(0, 1, 1, 2, 65536, 58880)]
    for empty in (table.limit(0), table.where("vec_id = 3")):
        assert hardneg.hard_negatives(empty, table.where("vec_id = 0")).collect() == []
        assert hardneg.hard_negatives(table, empty.where("vec_id < 0")).collect() == []


# --- URL filters -------------------------------------------------------------


def brute_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [] if url is None else [
        (len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls_query(spark):
    got = Counter(tuple(r) for r in Q.op12_url_filters(spark, SMALL).collect())
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert got == Counter((r.page_id, *brute_verdict(r.url, Q.URL_RULES)) for r in pages)
    assert len({r[3] for r in got}) > 2


URLS = [
    None, "", "no scheme/en/", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/x", "https://example.com", "https://example.com?/en/", "http://a.example.com/english#/",
    "http://example.com/en", "http://example.com//en/", "http://example.com:8080/en/", "http://user@example.com/en/", "x://y://example.com/en/", "http://notexample.com/en/",
    "http://.com/", "http://example.com./en/", "http://ÉXAMPLE.com/ü/é/", "http://a.b.c.d.e.net/es/1/2/3?q=/x", "http://net/es/", "http://com/ /\n/x", "http://[::1]/en/",
    "http://" + "a." * 5000 + "net/" + "es/" * 5000, "http://x.net/" + "y" * 200_000,
]
RULES = [
    ("com", "/", "allow"), ("example.com", "/en", "block"), ("Example.com", "/en/", "allow"), ("net", "/es/1/", "block"), ("net", "/es/", "block"), ("net", "/es/1/2/3", "allow"),
    ("e.net", "/es/", "allow"), ("com", "", "block"), ("", "", "block"), ("net", "/es/", "zzz"), ("net", None, "block"), (None, "/", "block"), ("org", "/", None), ("com", "/", "allow"),
]


def test_urls_odd_rows(spark):
    clean = {}
    for h, p, v in sorted((r for r in RULES if r[0] is not None and r[2] is not None), key=lambda r: r[2], reverse=True):
        clean[h.lower(), p or ""] = v  # of equal rules the smaller verdict stays
    rules = [(h, p, v) for (h, p), v in clean.items()]
    data = [(i if i % 4 else None, u, "x", 1, "y", "z") for i, u in enumerate(URLS)]
    data += data[:8]
    pages = spark.createDataFrame(data, "page_id long, url string, host string, path int, digest string, prefix string")
    given = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = Counter((r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, given).collect())
    assert got == Counter((r[0], r[1], *brute_verdict(r[1], rules)) for r in data)
    assert urlfilter.judge_urls(pages.limit(0), given).collect() == []
    assert {(r.rule, r.verdict) for r in urlfilter.judge_urls(pages, given.limit(0)).collect()} == {(None, "allow")}


def test_urls_without_python(spark):
    plan = Q.op12_url_filters(spark, SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapIn" not in plan and "CartesianProduct" not in plan


# --- spelling variants -------------------------------------------------------

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWERED = {c: c + 32 for c in range(65, 91)}


def brute_spelling(docs):
    seen = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            word = run.translate(LOWERED)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            seen[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 31 == 0 else word] += 1
    return brute_groups({w: n for w, n in seen.items() if len(w) >= 7 and n >= 2})


def brute_groups(words):
    holes, near = defaultdict(list), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].append(w)
            if w[:i] + w[i + 1 :] in words:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= set(group) - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return Counter(out)


def test_spelling_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = Counter(tuple(r) for r in Q.op13_spelling_variants(spark, SMALL).collect())
    assert got == brute_spelling([(r.doc_id, r.text) for r in docs])


def test_spelling_odd_texts(spark):
    texts = [
        None, "", "short", "Receive receive RECEIVE recieve recieve receve receve " * 30, "ÉCOLES×÷ écoles×÷ École écoleséé " * 3,
        "anagram nagaram anagrams anagram nagaram anagrams", "receive\u0000receive receive-receive receive1receive", "naïveté naivete naïvete naivete naïveté naïvete " * 2,
        ("x" * 30_000 + " ") * 2 + ("x" * 29_999 + " ") * 2, "mississippi missisippi " * 40, "ﬁnancial financial łódźłódź", "receives receiver " * 4,
    ]
    rows = [(i if i % 5 else None, t, "w", 1, 2) for i, t in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int, id int")
    got = spelling.spelling_groups(spelling.lexicon(docs))
    assert Counter(tuple(r) for r in got.collect()) == brute_spelling([r[:2] for r in rows])
    assert spelling.spelling_groups(spelling.lexicon(docs.limit(0))).collect() == []


def test_spelling_hot_blocks(spark, monkeypatch):
    """One block holds a third of all words, over many tiles and lanes; forms chain over several steps."""
    monkeypatch.setattr(spelling, "TILE_WORDS", 6)
    monkeypatch.setattr(spelling, "LANE_TILES", 2)
    rng = random.Random(5)
    words = {"".join(rng.sample("aaabbbcc", 8)): rng.choice([2, 30, 500]) for _ in range(400)}
    words |= {"".join(rng.choices("abcij", k=rng.choice([7, 8, 9]))): rng.choice([2, 30, 500, 90_000]) for _ in range(500)}
    chain = "chainedwords"
    words |= {chain[:i] + "z" * i + chain[i:]: 10 ** (i + 1) for i in range(9)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert Counter(tuple(r) for r in spelling.spelling_groups(table).collect()) == brute_groups(words)
    blocks = table.select(spelling.block_of(F.col("word")).alias("b")).groupBy("b").count()
    assert blocks.agg(F.max("count")).first()[0] > 60
