"""The corpus operators against brute force on small tables, and on odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

pytest.importorskip("cairn.llm")
from cairn.llm import decontaminate, exact_dedup, langid, license_scan, line_dedup, mixing, ngram_join, pii, sharding, url_filter  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, h string, words string, size long, class_id string"


def prose(r, n, vocab=400, tag="w"):
    return " ".join(f"{tag}{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}{r.randrange(vocab) % 7 * 'x'}" for _ in range(n))


def frame(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns clash with names that operators use inside."""
    return spark.createDataFrame([(*x, len(x[1] or ""), "clash", "clash", "clash", -1, "clash") for x in rows], SCHEMA)


def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows and ties."""
    r = random.Random(5)
    long = prose(r, 30_000)
    rows = [(1, None, "en", "a"), (2, "", None, None), (None, "some text of a row without any id", "en", "a"), (3, long, "fr", "b"), (4, long, None, "b"), (5, "some text of a row without any id", "en", "c")]
    return frame(spark, rows + [(5, "some text of a row without any id", "en", "c"), (6, " \n\n ", "en", "c"), (7, "…!?", "en", "a"), (8, "a" * 200_000, "en", "a")])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


OPERATORS = {
    "decontaminate": lambda s, d: decontaminate.find_leaks(d, s.createDataFrame([(1, "some text of a row without any id"), (None, "x y z v w u"), (2, None), (3, "short")], "item_id long, text string")),
    "line_dedup": lambda s, d: line_dedup.line_dedup(d, min_docs=2),
    "sharding": lambda s, d: sharding.place(d).select("doc_id", "slot", "shard"),
    "ngram_join": lambda s, d: ngram_join.ngram_join(d),
    "langid": lambda s, d: langid.identify_languages(d).drop("cross_entropy"),
    "exact_dedup": lambda s, d: exact_dedup.exact_dedup(d),
    "pii": lambda s, d: pii.find_pii(d),
    "mixing": lambda s, d: mixing.mix(d),
    "license_scan": lambda s, d: license_scan.scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    docs = odd(spark)
    got = OPERATORS[name](spark, docs)
    if name != "decontaminate":
        assert got.count() == docs.count()
    else:
        assert {(r.doc_id, r.item_id) for r in got.collect()} == {(None, 1), (5, 1)} and got.count() == 3


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, frame(spark, [])).count() == 0


def test_exact_dedup(spark):
    r = random.Random(1)
    texts = [None, "", " ", "a  b", "a\tb", "a b", "a b ", "A b"] + [prose(r, 5, 3) for _ in range(60)]
    rows = [(i, r.choice(texts), "en", "a") for i in range(400)]
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in rows}
    by = defaultdict(list)
    for i, t in norm.items():
        by[t].append(i)
    want = sorted((i, min(by[t]), len(by[t]), i == min(by[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items())
    assert rows_of(exact_dedup.exact_dedup(frame(spark, rows))) == sorted(want, key=repr)


def test_quotient_filters_are_lossless(spark):
    r = random.Random(2)
    prints = [r.choice([-(2**63), 2**63 - 1, 0, -1, r.randrange(-(2**63), 2**63), r.randrange(50)]) for _ in range(3000)]
    df = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(7)
    got = exact_dedup.merge_filters(exact_dedup.quotient_filters(df, 8), 8, 1)
    assert {x.fp: x.n for x in got.collect()} == Counter(prints)


def test_lookup_table():
    owner = sharding.lookup_table(["a", "b", "c"], 101)
    assert set(Counter(owner).values()) <= {33, 34}
    fewer = sharding.lookup_table(["a", "c"], 101)
    assert sum(x == y for x, y in zip(owner, fewer) if x != "b") > 0.7 * 67
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"], 101)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "b"], 100)


def brute_jaccard(rows, t=0.8):
    sets = {}
    for i, text, *_ in rows:
        w = ngram_join_words(text)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    link = {i: {j for j in sets if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9} for i in sets}
    cls, todo = {}, sorted(sets)
    for i in todo:
        if i not in cls:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in cls:
                    cls[x] = i
                    stack += link[x]
    return {i: (cls[i], len(link[i])) for i in sets}


def ngram_join_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def near_copies(r, groups=12, singles=60):
    rows, n = [], 0
    for g in range(groups):
        base = prose(r, r.choice([4, 12, 60, 150])).split()
        for _ in range(r.choice([2, 5, 40])):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            rows.append((n, r.choice([" ", "  ", "\n"]).join(w), "en", "a"))
            n += 1
    for _ in range(singles):
        rows.append((n, prose(r, r.choice([1, 30, 200])), "en", "b"))
        n += 1
    return rows


@pytest.mark.parametrize("block", [512, 8])
def test_ngram_join(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "SIGNATURES", 2 * block)
    rows = near_copies(random.Random(3))
    got = {r.doc_id: (r.class_id, r.links) for r in ngram_join.ngram_join(frame(spark, rows)).collect()}
    assert got == brute_jaccard(rows)


def test_ngram_join_with_empty_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", 60)
    rows = near_copies(random.Random(12), 8, 10)
    got = {r.doc_id: (r.class_id, r.links) for r in ngram_join.ngram_join(frame(spark, rows)).collect()}
    assert got == brute_jaccard(rows)


def test_words_are_cut_alike():
    from cairn.llm import shingles

    texts = ["", "…", "a", "Ab-c, d\u00e9f\u0130 x1 \n 12.5 \U0001f600y", "x" * 3000, prose(random.Random(1), 900) + " ab ba aab aba " * 40]
    seen = {}
    for size in (1 << 20, 64):
        shingles.PIECE, kept = size, shingles.PIECE
        for t in texts:
            w = ngram_join_words(t)
            h = shingles.word_hashes(t).tolist()
            assert len(h) == len(w)
            assert all(seen.setdefault(a, b) == b for a, b in zip(w, h))
        shingles.PIECE = kept
    assert len(set(seen.values())) == len(seen) > 300


def test_components_with_hubs(spark, monkeypatch):
    from cairn.llm import graph

    r = random.Random(21)
    edges = [(1000 + i, 500) for i in range(400)] + [(r.randrange(300), r.randrange(300)) for _ in range(260)] + [(500, 499), (499, 2000), (7, 7)]
    want, todo = {}, {x for e in edges for x in e if e[0] != e[1]}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    for x in sorted(todo):
        stack = [] if x in want else [x]
        while stack:
            y = stack.pop()
            if y not in want:
                want[y] = x
                stack += near[y]
    for share in (200, 1, 10**6):
        monkeypatch.setattr(graph, "SHARE", share)
        assert {x.id: x.comp for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_pruning_bound():
    need = ngram_join.least_matches(140, 0.8, 1e-6)
    assert 80 < need < 112 and ngram_join.least_matches(20, 0.8, 1e-6) < 16


def brute_tiles(d, t, least):
    """Greedy string tiling by definition."""
    md, mt, out = [False] * len(d), [False] * len(t), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(t)):
            for i in range(len(d)):
                k = 0
                while i + k < len(d) and j + k < len(t) and d[i + k] == t[j + k] and not md[i + k] and not mt[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return out
        for x in range(k):
            md[i + x] = mt[j + x] = True
        out += k


@pytest.mark.parametrize("seed", range(12))
def test_greedy_tiles(seed, monkeypatch):
    import numpy as np

    r = random.Random(seed)
    t = [r.randrange(1, 4 + 10 * (seed % 3)) for _ in range(40)]
    parts = [t[a : a + r.randrange(5, 20)] for a in (r.randrange(30) for _ in range(4))]
    d = [x for p in parts for x in [*p, 0, r.randrange(1, 5)]]
    if seed % 2:
        monkeypatch.setattr(decontaminate, "MOST_HITS", 0)
    got = decontaminate.greedy_tiles(np.array(d, np.uint64), np.array(t, np.uint64), 5)
    assert sum(x[2] for x in got) == brute_tiles([x or -1 for x in d], t, 5)


def test_decontaminate_finds_reordered_passages(spark):
    r = random.Random(4)
    items = [(i, ". ".join(prose(r, 12, tag=f"i{i}") for _ in range(4))) for i in range(6)]
    reorder = lambda text: ". ".join(reversed(text.split(". ")))
    rows = [(1, f"{prose(r, 300)} {reorder(items[2][1]).upper()} {prose(r, 300)}", "en", "a"), (2, prose(r, 500), "en", "a"), (3, items[4][1][: len(items[4][1]) // 4], "en", "a"), (4, items[5][1], "en", "b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows)
    for block in (decontaminate.BLOCK_CHARS, 300):
        assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(docs, bench, block_chars=block).collect()} == {(1, 2), (4, 5)}
    assert [x.doc_id for x in decontaminate.without_leaks(docs, bench).orderBy("doc_id").collect()] == [2, 3]
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == 4
    short = spark.createDataFrame([(None, "two words"), (8, "ONE"), (9, "…"), (None, items[1][1])], "item_id long, text string")
    texts = frame(spark, [(1, "here two  Words stand", "en", "a"), (2, "words two", "en", "a"), (3, "one", "en", "a"), (None, items[1][1], "en", "a")])
    assert {(x.doc_id, x.item_id, x.coverage, x.words) for x in decontaminate.find_leaks(texts, short).collect()} == {(1, None, 1.0, 2), (3, 8, 1.0, 1), (None, None, 1.0, 48)}


def test_language_id(spark):
    r = random.Random(6)
    sylls = {"en": ["the", "ing", "er", "an", "sh"], "fr": ["eau", "les", "ou", "ré", "ç"], "de": ["sch", "und", "ei", "ß", "tz"]}
    rows = [(i, " ".join("".join(r.choice(sylls[lang]) for _ in range(r.randrange(1, 4))) for _ in range(40)), lang, "a") for i, lang in enumerate(r.choice(list(sylls)) for _ in range(300))]
    rows += [(1000, "12 34 !!", "en", "a"), (1001, None, "en", "a")]
    got = {x.doc_id: x for x in langid.identify_languages(frame(spark, rows)).collect()}
    assert all(got[i].lang_pred == lang and not got[i].rejected for i, _, lang, _ in rows[:300])
    assert [got[i].lang_pred for i in (1000, 1001)] == ["und", "und"]
    assert all(0 <= x.score <= 1 for x in got.values())
    import zlib

    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got.values())


def test_language_sample_counts_different_texts(spark):
    r = random.Random(11)
    rows = [(i, "one text of many copies", "en", "a") for i in range(3000)] + [(3000 + i, prose(r, 12), "en", "a") for i in range(60)]
    rows += [(4000 + i, f"{i} 12 !!", "en", "a") for i in range(3000)] + [(8000 + i, prose(r, 12), "fr", "a") for i in range(400)] + [(9000, "ein einziger deutscher Satz", "de", "a")]
    train = frame(spark, rows).select("lang", "text").where(F.col("text").rlike(r"\p{L}"))
    got = Counter(x.lang for x in langid.sample(train, 100).collect())
    assert got["en"] == 61 and got["de"] == 1 and 60 <= got["fr"] <= 140
    assert langid.fit(frame(spark, rows), 100).langs == ["de", "en", "fr"]


def test_language_of_a_held_back_text_is_learned(spark):
    docs = frame(spark, [(i, f"satz {chr(97 + i)}", f"l{i}", "a") for i in range(26)])
    assert langid.fit(docs).langs == sorted(f"l{i}" for i in range(26))


def test_kneser_ney_is_a_distribution(spark):
    import numpy as np

    docs = spark.createDataFrame([("x", "abab ba cab"), ("x", "bcb aa"), ("y", "ccc b")], "lang string, text string")
    m = langid.kneser_ney(langid.count_grams(docs).toPandas(), ["x", "y"])
    for context in ("ab", " b", "a", "cc"):
        c = langid.codes(context)[:-1]
        n = min(langid.ORDER, len(c) + 1)
        p = [np.exp(m.log_probabilities(np.r_[c, np.uint64(ord(w))], np.array([len(c) + 1 - n]), n)[0].astype(float)) for w in " abc"]
        assert all(0.7 < s <= 1.0001 for s in np.sum(p, 0))  # the rest is for unseen characters


def test_pii_base_and_bootstrap(spark):
    texts = [f"please call me at +1 (555) 010-12{i:02d} now" for i in range(8)] + ["please call me at 555-867-5309, thanks", "the number 555-000-1111 stands alone"]
    texts += ["mail a@b.c_x@d.e and x@y", "1.2.3.4.5.6.7.8 and 999.1.1.1 and 0001.2.3.255", "card 4111 1111 1111 1111 or 4111-1111-1111-1112 é 4111111111111111", "+12 345 and +1234567 8.9", None]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]
    plain = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
        return (True, k == 1 and all(int(x) <= 255 for x in m.split(".")), 16 <= len(d) <= 19 and luhn, 8 <= len(d) <= 15)[k]

    for x in pii.find_pii(frame(spark, rows)).collect():
        text = texts[x.doc_id] or ""
        spans = [f"{pii.KINDS[k]}:{m.start()}:{m.end()}" for k in range(4) for m in re.finditer(plain[k], text) if ok(k, m.group())]
        assert x.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), text
        assert sum((x.n_email, x.n_ip, x.n_card, x.n_phone)) == len(spans)
        assert set(spans) <= set(filter(None, x.spans.split(",")))
        assert x.n_found == (1 if x.doc_id == 8 else 0), text
        if x.n_found:
            assert x.spans == f"phone:{text.index('555')}:{text.index(',')}"


def test_pii_learns_from_what_it_found(spark):
    texts = [f"please call me at +1 (555) 010-12{i:02d} now" for i in range(40)] + [f"please call me at 555-867-53{i:02d}, thanks" for i in range(4)]
    texts += [f"hotline reachable under 555-867-53{i:02d} always" for i in range(4)] + ["hotline reachable under 555-111-2222 always", "please call me at 555 867 5309. 20 people did"]
    texts += [f"tel. 2: +1 555 010 33{i:02d}" for i in range(40)] + ["tel. 2: 555-222-3333", "unrelated words stand before 555-444-5555"]
    got = {x.doc_id: x for x in pii.find_pii(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    for i, value in [(44, "555-867-5300"), (48, "555-111-2222"), (49, "555 867 5309"), (90, "555-222-3333")]:
        at = texts[i].index(value)
        assert got[i].spans == f"phone:{at}:{at + len(value)}" and got[i].n_found == 1, texts[i]
    assert got[91].n_found == 0


def test_mixing_water_fill(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 30, None: 200}
    rows, n = [], 0
    for s, total in sizes.items():
        left = total
        while left:
            k = min(left, 1 + n % 7)
            rows.append((n, " ".join("x" * k), "en", s))
            left, n = left - k, n + 1
    docs = frame(spark, rows)
    got = mixing.mix(docs).join(docs.select(F.col("doc_id"), F.col("source").alias("s")), "doc_id").collect()
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    target, free, rest = {}, set(sizes), sum(sizes.values())
    while True:
        w = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / w > 3 * sizes[s]}
        if not over:
            target |= {s: rest * weight[s] / w for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free, rest = free - over, rest - sum(3 * sizes[s] for s in over)
    taken = Counter()
    for x in got:
        assert x.target == pytest.approx(target[x.s]) and x.source_size == sizes[x.s] and x.taken <= 3 * x.size
        taken[x.s] += x.taken
    assert all(abs(taken[s] - target[s]) <= 4 for s in sizes)
    given = spark.createDataFrame([("a", 1), ("c", 1)], "source string, weight long")
    by = {x.doc_id: x.target for x in mixing.mix(docs, given).collect()}
    assert by[0] == 870.0 and sum(by.values()) > 0


def test_url_rules_and_propagation(spark):
    link = lambda *hosts: "".join(f'<p><a class="x" href="https://{h}/p">x</a>' for h in hosts)
    pages = [(1, "http://X.example.ORG/es/1?q#f", None), (2, "http://example.org/en/12", ""), (3, "https://a.org?x=/es/", ""), (4, None, None), (5, "no scheme", ""), (6, "http://good.org/", link("liked.net")), (7, "http://liked.net/a", ""), (8, "http://bad.com/de/x", ""), (9, "http://friend.net/", link("bad.com", "bad.com")), (10, "http://other.net/", link("friend.net")), (11, "http://bad.com/en/", ""), (12, "http://z.com", "")]
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), block_at=0.2).collect()}
    assert got[1] == ("x.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("a.org", "", None, "allow") and got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("org/", "allow") and got[7][2:] == (None, "allow")
    assert got[8][2:] == ("com/de/", "block") and got[9][2:] == (None, "block") and got[11][2:] == (None, "block")
    assert got[12] == ("z.com", "", None, "allow")
    # at the production threshold: a bad host stays bad however many link to it; who links to a wholly bad one alone is bad, too
    pages += [(13, "http://worse.com/de/a", ""), (14, "http://pal.net/", link("worse.com"))] + [(100 + i, f"http://fan{i}.net/", link("bad.com", "other.net", "z.com")) for i in range(20)]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[11] == got[14] == "block" and got[7] == got[9] == got[10] == got[12] == got[100] == "allow"
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_propagation_against_brute_force(spark):
    r = random.Random(8)
    hosts = [f"h{i}" for i in range(12)]
    edges = {(r.choice(hosts), r.choice(hosts)): r.randrange(1, 4) for _ in range(30)}
    edges = {k: w for k, w in edges.items() if k[0] != k[1]}
    seeds = {h: (r.choice([0, 0.5, 1]), r.choice([0, 0.25])) for h in hosts}
    want = {}
    for kind in (0, 1):
        flow = edges if not kind else {(b, a): w for (a, b), w in edges.items()}
        total = Counter()
        for (a, _), w in flow.items():
            total[a] += w

        def ranks(own, flow=flow, total=total):
            rank = dict(own)
            for _ in range(url_filter.ROUNDS):
                new = Counter()
                for (a, b), w in flow.items():
                    new[b] += rank[a] * w / total[a]
                rank = {h: 0.15 * own[h] + 0.85 * new[h] for h in hosts}
            return rank

        rank, whole = ranks({h: seeds[h][kind] for h in hosts}), ranks(dict.fromkeys(hosts, 1.0))
        want[kind] = {h: rank[h] / whole[h] for h in hosts}
    got = url_filter.propagate(spark.createDataFrame([(h, float(a), float(b)) for h, (a, b) in seeds.items()], "host string, good double, bad double"), spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight long")).collect()
    for x in got:
        assert x.trust == pytest.approx(want[0][x.host]) and x.distrust == pytest.approx(want[1][x.host])


def test_license_scan(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this SOFTWARE and documentation files"
    texts = ["The MIT  License! and Apache-License, mit license", mit, "some\nlines\n" + "all rights are reserved", None, "", "cc byte by-cc\nCC\nBY", "mitlicense MİT license"]
    texts += ["\n# ".join(mit.split()), "all of us " + "word " * 20 + "have rights and " + "word " * 20 + "seats are reserved", "ALL RIGHTS, reserved " * 500]
    got = {x.doc_id: x for x in license_scan.scan(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (8, 3, 1, 6, "apache,mit")
    assert (got[1].n_base, got[1].labels, got[1].first_word) == (0, "mit", None) and 0.8 <= got[1].score < 1
    assert got[2].labels == "" and got[3].labels == "" and got[4].n_words == 0  # a block of three words is three words long
    assert got[5].base_labels == "cc-by" and got[6].n_base == 0
    assert got[7].labels == "mit" and got[8].labels == "" and (got[9].labels, got[9].score) == ("reserved", 1.0)


def brute_templates(text, templates, t=0.8):
    w, out = license_scan.word_list(text or ""), {}
    for label, template in templates:
        all_words = license_scan.word_list(template)
        want, size = set(all_words), int(len(all_words) / t + 1e-9)
        o = max((len(want & set(w[i : i + size])) for i in range(len(w))), default=0)
        if o >= t * len(want) - 1e-9:
            out[label] = max(out.get(label, 0), o / len(want))
    return out


@pytest.mark.parametrize("threshold", [0.8, 0.5])
def test_license_join_against_brute_force(spark, threshold):
    r = random.Random(17)
    vocab = [f"v{i}" for i in range(14)]
    templates = [(f"t{i % 7}", " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 6, 9])))) for i in range(12)]
    texts = [" ".join(r.choice([*vocab, "x", "the"]) for _ in range(r.randrange(40))) for _ in range(150)] + [templates[3][1], None, ""]
    docs = frame(spark, [(i % 140, t, "en", "a") for i, t in enumerate(texts)])
    got = sorted((x.labels, round(x.score, 9)) for x in license_scan.scan(docs, templates, threshold).collect())
    want = [brute_templates(t, templates, threshold) for t in texts]
    assert got == sorted((",".join(sorted(w)), round(max(w.values(), default=0), 9)) for w in want)
    assert license_scan.scan(docs, []).where("labels <> ''").count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(docs, [("x", "...")])


def test_line_dedup(spark):
    r = random.Random(9)
    rows = [(i, f"{prose(r, 20)}\nuser alice{i} logged in from site {r.choice(['north', 'south'])}\n\nexact boilerplate line here", "en", "a") for i in range(30)]
    rows += [(100, "only one line of its own", "en", "a"), (101, "exact boilerplate line here", "en", "a")]
    got = {x.doc_id: x for x in line_dedup.line_dedup(frame(spark, rows)).collect()}
    for i, text, *_ in rows[:30]:
        assert got[i].text == text.split("\n")[0] + "\n" and (got[i].n_lines, got[i].n_dropped) == (4, 2)
    assert got[100].text == rows[30][1] and got[101].text == "" and got[101].n_dropped == 1


def test_pipeline_against_brute_force(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(10)
    rows = [(i, t, "en", s) for (i, t, *_), s in zip(near_copies(r, 6, 80), "abcde" * 1000)]
    items = [(1, " ".join(f"bench{k}" for k in range(30)))]
    n = len(rows)
    rows += [(n, f"{prose(r, 50)} {items[0][1]}", "en", "a"), (n + 1, None, "en", "a"), (n + 2, "???", "en", "b")]
    docs = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "slot", "shard"]
    cls = brute_jaccard(rows)
    keep = {i for i, t, *_ in rows if re.search("[a-z]", t or "") and cls[i][0] == i and i != n}
    seen = Counter(x.doc_id for x in got.collect())
    assert set(seen) <= keep and max(seen.values()) <= 3
    assert {x.doc_id for x in pipeline.decontaminated(spark, pipeline.near_duplicates(spark, pipeline.language(spark, docs, str(tmp_path)), str(tmp_path)), str(tmp_path)).collect()} == keep
    reps = {x.doc_id: x.reps for x in mixing.mix(docs.where(F.col("doc_id").isin(list(keep)))).collect()}
    assert seen == Counter({k: v for k, v in reps.items() if v})


def test_pipeline_stages_with_repeated_and_null_ids(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(31)
    one, two, three = (prose(r, 40, tag=t) for t in ("a", "b", "c"))
    near = one + " more"
    rows = [(5, one, "en", "s"), (2, near, "en", "s"), (2, one, "en", "t"), (None, one, "en", "s"), (None, two, None, None), (None, two, "en", "s"), (9, three, "en", "s"), (9, three, "en", "s"), (7, None, "en", "s"), (7, "", "en", "s"), (7, None, "en", "s")]
    docs = frame(spark, rows).withColumn("class_id", F.lit("clash")).withColumn("shard", F.lit("clash"))
    kept = pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = Counter((x.doc_id, x.text) for x in kept.collect())
    assert got in [Counter([(2, t), (None, two), (9, three), (7, None), (7, None), (7, "")]) for t in (near, one)]
    # row by row the mix sums to its targets, also where ids repeat
    many = frame(spark, [(r.choice([1, 2, None]), " ".join(["w"] * r.randrange(1, 9)), "en", s) for s in "ab" for _ in range(200)])
    size = Counter()
    for x in many.collect():
        size[x.source] += len(x.text.split())
    taken = Counter()
    for x in pipeline.mixed(spark, many, str(tmp_path)).collect():
        taken[x.source] += len(x.text.split())
    a = min(sum(size.values()) * 5 / 7, 3 * size["a"])
    assert abs(taken["a"] - a) <= 8 and abs(taken["b"] - min(sum(size.values()) - a, 3 * size["b"])) <= 8
    for stage in (pipeline.near_duplicates, pipeline.mixed, pipeline.sharded, pipeline.language):
        assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0
    assert pipeline.language(spark, docs, str(tmp_path)).count() == 8
    assert pipeline.sharded(spark, docs, str(tmp_path)).where("shard = 'clash'").count() == 0


def test_pipeline_leaves_one_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(32)
    frame(spark, [(i, prose(r, 20), "en", "a") for i in range(30)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(r, 20, tag="q"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    import glob

    from cairn.llm.common import checkpoint_dir

    base = checkpoint_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{base}/pipeline-*/*"))
    assert pipeline.run(spark, str(tmp_path)).count() > 0
    assert [x.split("-")[-1] for x in set(glob.glob(f"{base}/pipeline-*/*")) - before] == ["sharding"]


def test_pii_contexts_are_whole_words(spark):
    a, b = "x" * 140 + "y", "z" + "x" * 140
    texts = [f"{a} +1 (555) 010-12{i:02d} now" for i in range(8)] + [f"{b} 555-867-5309 now", f"{a} 555-867-5308 now", "w" * 150 + " is +1 (555) 010-9999", "q" * 300 + " is 555-111-2222"]
    got = {x.doc_id: x for x in pii.find_pii(frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    assert [got[i].n_found for i in (8, 9, 11)] == [0, 1, 0] and got[9].n_spans == 1 and got[0].n_spans == 1


@pytest.mark.parametrize("seed", range(3))
def test_bootstrap_against_brute_force(spark, seed):
    r = random.Random(seed)
    values, patterns = range(60), range(100, 112)
    is_seed = {v: r.random() < 0.4 for v in values}
    occ = [(r.randrange(2), v, is_seed[v], [r.choice([*patterns, None]), r.choice(patterns)]) for v in (r.choice(values) for _ in range(260))]
    edges = {(k, p, v) for k, v, _, ctx in occ for p in ctx if p is not None}
    score = {}
    for _ in range(pii.ROUNDS):
        p_of = {}
        for k, p in {(k, p) for k, p, _ in edges}:
            own = {v for k2, p2, v in edges if (k2, p2) == (k, p)}
            seeds, unknown = {v for v in own if is_seed[v]}, {v for v in own if not is_seed[v]}
            good = sum(score.get((k, v), 0) >= pii.ACCEPT for v in unknown)
            if unknown and len(seeds) + good >= pii.LEAST_SEEDS and len(own) >= pii.LEAST_SEEDS:
                p_of[k, p] = (len(seeds) + sum(score.get((k, v), 0) for v in unknown)) / len(own)
        new = {}
        for k, p, v in edges:
            if not is_seed[v] and p_of.get((k, p), 0) >= pii.GOOD_PATTERN:
                new[k, v] = new.get((k, v), 1.0) * max(1 - p_of[k, p], 1e-12)
        score = {x: 1 - miss for x, miss in new.items()}
    got = pii.bootstrap(spark.createDataFrame(occ, "k int, value long, seed boolean, ctx array<long>"))
    assert {(x.k, x.value) for x in got.collect()} == {x for x, s in score.items() if s >= pii.ACCEPT}


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_shuffled_branches_agree(spark, limit, monkeypatch):
    from cairn.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    test_line_dedup(spark)
    test_exact_dedup(spark)


def brute_line_dedup(rows, min_docs, similarity):
    lines, drop = {}, defaultdict(set)
    for doc in {(i, t) for i, t, *_ in rows if t is not None}:
        for k, line in enumerate(doc[1].split("\n")):
            t = tuple("<*>" if re.search("[0-9]", w) else w for w in re.split(r"[\x20\x09-\x0D]+", line) if w)
            if t:
                lines[(*doc, k)] = t
    count = Counter()
    for i, text, *_ in rows:  # lines of rows that repeat count as often
        for k in range(len((text or "").split("\n"))):
            if (i, text, k) in lines:
                count[lines[i, text, k]] += 1
    leaf = lambda t: (len(t), t[: line_dedup.DEPTH])
    size, votes = Counter(), Counter()
    for t, n in count.items():
        size[leaf(t)] += n
        for j, w in enumerate(t):
            votes[leaf(t), j, w] += n
    docs_of = defaultdict(set)
    template = {}
    for key, t in lines.items():
        if size[leaf(t)] >= min_docs:
            fixed = [w != "<*>" and votes[leaf(t), j, w] >= min_docs for j, w in enumerate(t)]
            template[key] = (leaf(t), tuple(w if f else "<*>" for w, f in zip(t, fixed)) if sum(fixed) / len(t) >= similarity else ("own", t))
            docs_of[template[key]].add(key[:2])
    for key, m in template.items():
        if len(docs_of[m]) >= min_docs:
            drop[key[:2]].add(key[2])
    return sorted(((i, 0 if t is None else len(t.split("\n")), len(drop[i, t]), None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[i, t])) for i, t, *_ in rows), key=repr)


def test_line_dedup_against_brute_force(spark):
    r = random.Random(23)
    words = ["user", "login", "from", "site", "12", "x9", "a", "b", "c"]
    line = lambda: r.choice([" ", ""]) + "  ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 3, 4])))
    rows = [(r.choice([i, i, None]), r.choice([None, "", *["\n".join(line() for _ in range(r.randrange(1, 7)))] * 9]), "en", "a") for i in range(120)]
    rows += rows[:10]
    for docs, share in ((3, 0.6), (2, 0.3)):
        assert rows_of(line_dedup.line_dedup(frame(spark, rows), docs, share)) == brute_line_dedup(rows, docs, share)


def test_lookup_table_against_brute_force():
    for names, slots in ((["a", "b", "c"], 11), ([f"s{i}" for i in range(7)], 101), (["one"], 2)):
        prefer = {s: [(sharding._draw(s, "offset") % slots + j * ((sharding._draw(s, "skip") % (slots - 1)) + 1 if slots > 2 else j)) % slots for j in range(slots)] for s in names}
        assert all(sorted(p) == list(range(slots)) for p in prefer.values())  # a prime table: every skip visits every slot
        owner = {}
        while len(owner) < slots:
            for s in names:
                if len(owner) < slots:
                    owner[next(x for x in prefer[s] if x not in owner)] = s
        assert sharding.lookup_table(names, slots) == [owner[k] for k in range(slots)]


def test_kneser_ney_against_brute_force(spark):
    """Probabilities of every n-gram by the recursive definition, from texts in two languages."""
    import numpy as np

    texts = [("x", "abba cab"), ("x", "bca ab ba"), ("y", "ccab bc"), ("y", "cab")]
    m = langid.kneser_ney(langid.count_grams(spark.createDataFrame(texts, "lang string, text string")).toPandas(), ["x", "y"])
    alphabet = {c for _, t in texts for c in f" {t} "}
    order, d = langid.ORDER, langid.DISCOUNT

    def counts(lang):
        grams = [Counter() for _ in range(order + 1)]
        for lg, t in texts:
            s = f" {t} "
            for k in range(1, order + 1) if lg == lang else ():
                grams[k].update(s[i : i + k] for i in range(len(s) - k + 1))
        return grams

    for col, lang in enumerate(m.langs):
        grams = counts(lang)
        a = [Counter() for _ in range(order + 1)]
        a[order] = grams[order]
        for k in range(1, order):  # distinct letters to the left; one at least where the n-gram begins a text
            left = Counter(g[1:] for g in grams[k + 1])
            a[k] = Counter({g: max(left[g], 1) for g in grams[k]})

        def p(gram):
            if not gram:
                return 1 / (len(alphabet) + 1)
            ctx = [g for g in a[len(gram)] if g[:-1] == gram[:-1]]
            total = sum(a[len(gram)][g] for g in ctx)
            if not total:
                return p(gram[1:])
            return max(a[len(gram)][gram] - d, 0) / total + d * len(ctx) / total * p(gram[1:])

        for gram in {g for k in range(1, order + 1) for g in grams[k]} | {"zab", "abz", "cabb", " cc", "bb b"}:
            c = np.array([ord(x) for x in gram], np.uint64)
            got = m.log_probabilities(c, np.array([0]), len(gram))[0][col]
            assert got == pytest.approx(np.log(p(gram)), abs=1e-4), (lang, gram)


TEXT = "some text of a row without any id"


def by_row(df, docs, *columns):
    """The named columns of an operator's rows, by (id, first letters of the text): equal rows must agree."""
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(tuple(r[c] for c in columns))
    assert {k: len(v) for k, v in out.items()} == Counter(r.doc_id for r in docs.collect())
    assert all(len(set(v)) == 1 for v in out.values())
    return {k: v[0] for k, v in out.items()}


def test_odd_values_line_dedup(spark):
    docs = odd(spark)
    got = by_row(line_dedup.line_dedup(docs, min_docs=2), docs, "n_lines", "n_dropped", "text")
    assert got[1] == (0, 0, None) and got[2] == (1, 0, "") and got[6] == (3, 0, " \n\n ") and got[7] == (1, 0, "…!?") and got[8] == (1, 0, "a" * 200_000)
    assert got[None] == got[5] == got[3] == got[4] == (1, 1, "")


def test_odd_values_sharding(spark):
    docs = odd(spark)
    got = by_row(sharding.place(docs), docs, "slot", "shard")
    slot = lambda key: int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.SLOTS
    owner = sharding.lookup_table(sharding.SHARDS)
    assert got == {k: (slot("" if k is None else str(k)), owner[slot("" if k is None else str(k))]) for k in got}


def test_odd_values_ngram_join(spark):
    docs = odd(spark)
    got = by_row(ngram_join.ngram_join(docs), docs, "class_id", "copy_id", "links", "kept")
    assert got == {k: (k, k, 0, True) for k in (1, 2, 6, 7, 8)} | {3: (3, 3, 1, True), 4: (3, 3, 1, False), 5: (5, 5, 2, True), None: (5, 5, 2, False)}
    none = frame(spark, [(None, TEXT, "en", "a"), (None, TEXT + " more", "en", "a")])
    assert [r.kept for r in ngram_join.ngram_join(none).collect()] == [True, True]  # a group of null ids keeps all


def test_odd_values_langid(spark):
    docs = odd(spark)
    got = by_row(langid.identify_languages(docs), docs, "lang_pred", "score", "rejected")
    assert all(got[k] == ("und", 0.0, True) for k in (1, 2, 6, 7)) and got[5] == got[None] and got[3] == got[4]
    one = frame(spark, [(i, prose(random.Random(i), 20), "en", "a") for i in range(9)] + [(9, None, "fr", "a")])
    assert {r.lang_pred: r.score for r in langid.identify_languages(one).where("doc_id < 9").collect()} == {"en": 1.0}
    bare = one.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.rejected) for r in langid.identify_languages(bare).collect()} == {("und", True)}


def test_language_id_rejects_junk_and_keeps_the_rest(spark):
    r = random.Random(16)
    sylls = {"en": ["the", "ing", "er", "an", "sh"], "fr": ["eau", "les", "ou", "ré", "ç"]}
    rows = [(i, " ".join("".join(r.choice(sylls[lang]) for _ in range(r.randrange(1, 4))) for _ in range(40)), lang, "a") for i, lang in enumerate(r.choice(list(sylls)) for _ in range(400))]
    junk = [(1000 + i, " ".join("".join(r.choice("bcdfghjklmnpqvwxz") for _ in range(6)) for _ in range(30)), None, "a") for i in range(40)]
    got = {x.doc_id: x.rejected for x in langid.identify_languages(frame(spark, rows + junk)).collect()}
    assert not any(got[i] for i in range(400)) and all(got[1000 + i] for i in range(40))


def test_odd_values_exact_dedup(spark):
    docs = odd(spark)
    got = by_row(exact_dedup.exact_dedup(docs), docs, "keep_id", "group_size", "kept")
    assert got == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 2, True), 4: (3, 2, False), 5: (5, 3, True), None: (5, 3, False), 6: (6, 1, True), 7: (7, 1, True), 8: (8, 1, True)}


def test_odd_values_pii(spark):
    docs = odd(spark)
    got = by_row(pii.find_pii(docs), docs, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found", "n_spans")
    assert set(got.values()) == {(0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0, 0)}


def test_odd_values_mixing(spark):
    docs = odd(spark)
    rows = mixing.mix(docs).collect()
    size = {(r.doc_id, r.size, r.source_size, r.target) for r in rows}
    assert size == {(1, 0, 10, 30.0), (None, 8, 10, 30.0), (7, 1, 10, 30.0), (8, 1, 10, 30.0), (2, 0, 0, 0.0), (3, 30_000, 60_000, 59_948.0), (4, 30_000, 60_000, 59_948.0), (5, 8, 16, 48.0), (6, 0, 16, 48.0)}
    assert Counter(r.target for r in rows for _ in range(r.taken)) == {30.0: 30, 59_948.0: 60_000, 48.0: 48}  # whole documents only
    empty = mixing.mix(frame(spark, [(1, None, "en", "a"), (2, "", "en", None)])).collect()
    assert {(r.size, r.source_size, r.target, r.taken) for r in empty} == {(0, 0, 0.0, 0)}


def test_odd_values_license_scan(spark):
    docs = odd(spark)
    got = by_row(license_scan.scan(docs), docs, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert got == {k: (n, 0, None, None, "", "", 0.0) for k, n in {1: 0, 2: 0, None: 8, 3: 30_000, 4: 30_000, 5: 8, 6: 0, 7: 1, 8: 1}.items()}


def test_odd_values_url_filter(spark):
    import time

    rows = [(1, None, None), (1, None, None), (2, "", ""), (None, "http://Bad.com/de/x", "<a " * 200_000), (None, "http://Bad.com/de/x", "<a " * 200_000), (3, "http://bad.com/en", "<a href='http://bad.com/de/'>" * 20_000), (4, "://", "x"), (5, "x://h?://y/", None), (6, "http://other.org", "<A\nclass=q HREF = HTTP://bad.com/de/x>")]
    pages = spark.createDataFrame([(*r, "clash", "clash", 0.5) for r in rows], "page_id long, url string, html string, host string, verdict string, rank double")
    began = time.time()
    got = url_filter.judge(pages).collect()
    assert time.time() - began < 120 and len(got) == len(rows)
    assert {tuple(r) for r in got} == {
        (1, "", "", None, "allow"), (2, "", "", None, "allow"), (None, "bad.com", "/de/x", "com/de/", "block"), (3, "bad.com", "/en", None, "block"), (4, "", "", None, "allow"), (5, "h", "", None, "allow"), (6, "other.org", "", None, "allow"),
    }


def test_leaks_against_brute_force(spark):
    r = random.Random(41)
    vocab = [f"v{i}" for i in range(9)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 8, 14])))) for i in range(10)]
    docs = []
    for i in range(60):
        parts = [" ".join(r.choice([*vocab, "other"]) for _ in range(r.randrange(12)))]
        for _ in range(r.randrange(3)):
            w = r.choice(items)[1].split()
            cut = r.randrange(len(w))
            parts += [" ".join(w[cut:]), "stop", " ".join(w[:cut])]
        docs.append((i, " ".join(parts), "en", "a"))
    want = {}
    for i, text, *_ in docs:
        for k, item in items:
            d, t = text.split(), item.split()
            covered = brute_tiles(d, t, min(decontaminate.MIN_TILE, len(t)))
            if covered >= decontaminate.COVERAGE * len(t):
                want[i, k] = covered / len(t)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.coverage for x in decontaminate.find_leaks(frame(spark, docs), bench).collect()}
    assert got == want and len(want) > 20
    kept = {x.doc_id for x in decontaminate.without_leaks(frame(spark, docs), bench, block_chars=50).collect()}
    assert kept == {i for i, *_ in docs} - {i for i, _ in want}
