"""URL rules, licence phrases and benchmark windows against brute force."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from corvane.llm import decontam, licenses, urlrules
from corvane.llm.entries import SITE_RULES


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://example.net/en/x", "http://EXAMPLE.net/en", "https://a.b.example.net/en/?q", "http://net", "http://net/", "http://xnet/", "http://x.net?a/b", "http://x.net#/", "ftp://user@x.org/fr/a",
        "http://example.com:80/de/", "http://example.com/de/a", "http://example.com/search?q", "http://h/ads/x", "http://h/a?page=3", "http://h/a?SID=1", "http://h/login", "x://y://z/", "http://org/fr/", "http://org/FR/", "http://h\n/x",
    ]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(3, urls[3], "old")], "page_id long, url string, host string")
    got = urlrules.judge_urls(spark, df, SITE_RULES).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        u = urls[r.page_id] or ""
        host, path = "", ""
        if "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [s for s in SITE_RULES if (host == s.host or host.endswith("." + s.host)) and path.startswith(s.path)]
        best = max(fits, key=lambda s: len(s.name), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best.name if best else None), u
        own = [p for p in urlrules.PATTERN_RULES if re.search(p.pattern, u.lower())]
        assert r.verdict == (best.verdict if best else "block" if own else "allow"), u
    assert urlrules.judge_urls(spark, df.filter("false"), SITE_RULES).count() == 0
    assert {r.verdict for r in urlrules.judge_urls(spark, df, [], []).collect()} == {"allow"}


def test_turns_and_index(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "TURN", 1)
    df = spark.createDataFrame([(1, "http://example.net/en/"), (2, "http://q.net/")], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in urlrules.judge_urls(spark, df, SITE_RULES).orderBy("page_id").collect()] == [("example.net/en/", "allow"), ("net/", "block")]
    assert list(urlrules.index(SITE_RULES[1:2], {"example": 5, "net": 9, "en": 2})) == ["en"]


def test_patterns_count_without_the_index(spark):
    r = random.Random(8)
    parts = ["/ad/", "/ads/", "/ads.", ".ad.", "ad", "ads", "/adx/", "?sid=", "&SESSION=", "&phpsessid=", "?xsid=", "/login", "/login/", "?page=3", "&page=x", "/search?", "/search", "a", "h", "."]
    urls = ["http://h/ad/x", "http://ad.host/x", "http://h.ad.net/x", "http://h/a?PHPSESSID=1", "http://h/ads/?sid=2"]
    urls += ["http://h" + "".join(r.choice(parts) for _ in range(r.randint(1, 5))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for x in urlrules.judge_urls(spark, df, []).collect():
        fits = sorted(p.name for p in urlrules.PATTERN_RULES if re.search(p.pattern, x.url.lower()))
        assert (x.pattern, x.verdict) == ((fits[0], "block") if fits else (None, "allow")), x.url
    assert "" not in urlrules.index(urlrules.PATTERN_RULES, {})


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_licenses(spark):
    r = random.Random(5)
    vocabulary = "cc by nc sa general public license all rights reserved gnu version 3 mit apache 2 0 word é".split()
    texts = [None, "", "CC-BY", "cc by", "All rights\nreserved. ALL RIGHTS RESERVED", "ccby", "licensed under the GNU General Public License version 3", "by cc", "a " * 50_000 + "cc by"]
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60))) for _ in range(200)]
    for _, notice, _ in licenses.NOTICES:
        for changed in (0, 3, 6, 9, 12):
            copy = notice.split()
            for k in r.sample(range(len(copy)), min(changed, len(copy))):
                copy[k] = "zzz"
            texts.append(" ".join([*("lead " * r.randint(0, 9)).split(), *copy, "tail"]))
        texts.append(notice[: len(notice) // 2])
        texts.append("x " + notice + " " + notice)
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, w int")).collect()}
    for i, t in enumerate(texts):
        w = words(t)
        at = lambda p: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]  # noqa: E731, B023
        starts = [k for p, _ in licenses.BASE for k in at(p)]
        base = sorted({lab for p, lab in licenses.BASE if at(p)})
        own = {lab for lab, ps in licenses.TEMPLATES if all(at(p) for p in ps)}
        phrase = any(at(p) for p in {*[p for p, _ in licenses.BASE], *[p for _, ps in licenses.TEMPLATES for p in ps]})
        shares = {}
        for label, notice, keys in licenses.NOTICES:
            x = notice.split()
            place = lambda p: next(k for k in range(len(x)) if x[k : k + len(p.split())] == p.split())  # noqa: E731, B023
            for k in range(len(w) - len(x) + 1):
                same = sum(a == b for a, b in zip(w[k:], x, strict=False))
                if same * 100 >= 80 * len(x) and all(k + place(p) in at(p) for p in keys):
                    shares[label] = max(shares.get(label, 0), same / len(x))
        own |= shares.keys()
        want = (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *own})), 1.0 if phrase else max(shares.values(), default=0.0))
        g = got[i]
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels, g.labels, g.score) == want, t
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_hits(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        x = words(t)
        wins = [x[k : k + 10] for k in range(len(x) - 9)] if len(x) >= 10 else [x] if x else []
        for win in wins:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark, monkeypatch):
    r = random.Random(6)
    for shard, sent in ((200_000, 2_000_000), (25, 2_000_000), (25, 45)):
        monkeypatch.setattr(decontam, "SHARD_WORDS", shard)
        monkeypatch.setattr(decontam, "SENT_WORDS", sent)
        items = [(k, " ".join(r.choice("abc") for _ in range(r.choice([0, 1, 2, 3, 5, 9, 10, 11, 14, 30])) if k > 3)) for k in range(14)] + [(90, None), (91, "!?"), (13, "a b c a b c a b c a b c"), (7, "É b c")]
        items[5] = (5, "z")
        texts = [None, "", "A-B c", " ".join("abc" * 20), "é b c É B C"] + [" ".join(r.choice("abcd") for _ in range(r.randint(0, 80))) for _ in range(60)]
        texts += [f"q q {t} q" for _, t in items if t]
        docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, hit int")
        bench = spark.createDataFrame(items, "item_id long, text string")
        assert (len(list(decontam.load_items(bench))) > 2) == (sent == 45)
        got = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontam.hits(spark, docs, bench).collect()}
        for i, t in enumerate(texts):
            assert got[i] == brute_hits(t, items), t
    assert {x.n_hit for x in decontam.hits(spark, docs, bench.filter("false")).collect()} == {0}
    assert decontam.hits(spark, docs.filter("false"), bench).count() == 0


def test_removal(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"Before it. {item.upper()}! After it, and so on and so forth, more words than the rest."), (2, item), (3, None), (4, "clean")], "doc_id long, text string").withColumn("found", F.lit("mine"))
    out = decontam.remove_hits(spark, docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert out.columns == docs.columns and out.filter("found <> 'mine'").count() == 0
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: "Before it. ! After it, and so on and so forth, more words than the rest.", 3: None, 4: "clean"}
