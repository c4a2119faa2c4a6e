import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from helpers import CLASHING, WORD, corpus, frame
from tablescope.llm import decontaminate, extraction, quality, sharding, urls
from tablescope.llm.blocks import leaf_blocks

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = collections.Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def test_rule_statistics_match_brute_force(spark):
    rows = corpus()
    got = quality.quality_report(frame(spark, rows, CLASHING), None).collect()
    expected = []
    for doc, text in rows:
        c = base_counts(text)
        expected.append((doc, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == sorted(expected, key=repr)
    assert all(not (r.base_failed and r.kept) for r in got)


def test_forest_rejects_odd_rows_and_keeps_good_ones(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 12 == 0
        rows.append((i, " ".join(str(w) + ("###" if bad else "") for w in rng.choice(words, 80))))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    marks = spark.createDataFrame(labels + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.quality_report(frame(spark, rows), marks).collect()}
    bad = [i for i in got if i % 12 == 0]
    assert not any(got[i] for i in bad)
    assert sum(got[i] for i in got if i % 12) >= 0.99 * (len(got) - len(bad))
    docs = frame(spark, rows, CLASHING)
    kept = quality.filter_quality(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, k in got.items() if k)


def test_forest_keeps_the_bounds_it_was_grown_with():
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(5, 0.5, 3000), rng.random((3000, 3)) * 0.01])
    bad = np.arange(3000) % 100 == 0
    x[bad, 0] = np.where(np.arange(30) % 2, 30, 1)
    forest = quality.grow(x, bad)
    assert np.array_equal(forest.low, np.quantile(x[~bad], quality.TAIL, axis=0, method="lower"))
    assert np.array_equal(forest.high, np.quantile(x[~bad], 1 - quality.TAIL, axis=0, method="higher"))
    usual, *odd = forest.score(np.array([[n, 0.005, 0.005, 0.005] for n in (5, 1, 40)], float))
    assert min(odd) > usual + 0.1


def test_texts_odd_in_word_length_only_go(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(500)]
    rows = [(i, " ".join(str(w) * (9 if i % 12 == 0 else 1) for w in rng.choice(words, 80))) for i in range(600)]
    marks = spark.createDataFrame([(i, int(i % 12 > 0), 0) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.quality_report(frame(spark, rows), marks).collect()}
    assert not any(got[i] for i in range(0, 600, 12))
    assert sum(got[i] for i in got if i % 12) >= 0.99 * 550


def test_a_threshold_needs_both_labels():
    steps = [{"step": 1500, "good": 0, "bad": 5}, {"step": 1000, "good": 900, "bad": 1}]
    assert quality.threshold(steps) == 0.75
    assert quality.threshold([{"step": 1500, "good": 0, "bad": 5}]) == 1.0
    assert quality.threshold([]) == 1.0


def brute_hits(rows, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        words = TOKEN.findall((text or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER)))
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[i:i + n])].add("" if item is None else str(item))
    out = []
    for doc, text in rows:
        words = TOKEN.findall((text or "").translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER)))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if names := windows.get(tuple(words[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


@pytest.mark.parametrize("pass_windows", [decontaminate.PASS_WINDOWS, 40])
def test_contamination_matches_brute_force(spark, monkeypatch, pass_windows):
    monkeypatch.setattr(decontaminate, "PASS_WINDOWS", pass_windows)
    rows = corpus()
    texts = [t for _, t in rows if t and len(t) > 300][:4]
    items = [(1, " ".join(texts[0].split()[3:30]).upper()), (2, texts[1][:200]), (10, "a"), (3, None), (None, texts[2][50:250]),
             (4, "..."), (5, " ".join(texts[3].split()[:5])), (2, texts[1][:200])]
    items.append((77, " ".join(texts[0].split()[3:30])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows, CLASHING)
    got = sorted((tuple(r) for r in decontaminate.decontamination_report(docs, bench).collect()), key=repr)
    assert got == sorted(brute_hits(rows, items), key=repr)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not g[-1] for g in got)
    cut = decontaminate.without_spans(docs.select("doc_id", "text"), bench)
    left = {r.doc_id: len(TOKEN.findall(r.text or "")) for r in cut.collect() if r.removed_spans}
    assert left == {g[0]: g[1] - g[2] for g in got if g[2]}


def test_decontamination_is_native(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontaminate.decontamination_report(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_benchmark_and_documents(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.decontamination_report(frame(spark, corpus()[:10]), bench).collect()
    assert len(got) == 10 and not any(r.contaminated or r.n_hit for r in got)
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.decontamination_report(frame(spark, []), some).collect() == []


def test_shards_are_contiguous_and_equal(spark):
    rows = corpus(n=300)
    got = sharding.shard_report(frame(spark, rows, CLASHING), 5).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(
        ((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows), key=repr)
    got.sort(key=lambda r: (r.shard, r.slot))
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for s in range(5):
        part = [r for r in got if r.shard == s]
        assert [r.slot for r in part] == list(range(len(part)))
        assert abs(sum(r.size for r in part) - total / 5) <= largest
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sharding.shard_report(frame(spark, [])).collect() == []


def test_one_key_with_a_third_of_the_rows_is_spread(spark):
    rows = [(7, "same text")] * 2000 + [(i, f"text {i}") for i in range(4000)]
    table = sharding.sharded(frame(spark, rows).selectExpr("doc_id", "text", "10 AS size"), 8, "size", ["doc_id"])
    assert sorted(r["count"] for r in table.groupBy("shard").count().collect()) == [750] * 8


PAGES = [
    (0, "HTTP://WWW.Example.ORG/en/1x?q#f"), (1, "https://example.org/es/a"), (2, "http://a.b.com/fr/x"), (3, "http://com/de/"),
    (4, "http://xexample.org/es/1"), (5, None), (6, "no address"), (7, "://"), (8, "http://h.net"), (9, "http://h.net?x=/y"),
    (10, "http://org"), (11, "http://q.net/a://b/c#d"), (None, "http://h.net/x"), (8, "http://h.net"),
]


def test_rules_and_parts_of_addresses(spark):
    pages = spark.createDataFrame([(k, u, "x") for k, u in PAGES], "page_id long, url string, host string")
    got = sorted((tuple(r)[:5] for r in urls.judged(pages, None).collect()), key=repr)
    assert got == sorted([
        (0, "www.example.org", "/en/1x", "example.org/en/1", "block"), (1, "example.org", "/es/a", "example.org/es/", "block"),
        (2, "a.b.com", "/fr/x", "com/fr/", "allow"), (3, "com", "/de/", "com/de/", "block"),
        (4, "xexample.org", "/es/1", "org/", "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"),
        (7, "", "", None, "allow"), (8, "h.net", "", None, "allow"), (8, "h.net", "", None, "allow"), (9, "h.net", "", None, "allow"),
        (10, "org", "", None, "allow"), (11, "q.net", "/a://b/c", None, "allow"), (None, "h.net", "/x", None, "allow"),
    ], key=repr)


def test_templates_keep_apart_what_is_labelled_apart(spark):
    pages = [(i, f"http://h.net/{('news', 'spam')[i % 2]}/{i}/x") for i in range(400)]
    pages += [(1000 + i, "http://h.net/" + "/".join("abcdefghijkl")) for i in range(3)]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(0, 400, 3)], "doc_id long, quality int, toxic int")
    table = spark.createDataFrame(pages, "page_id long, url string")
    got = {r.page_id: (r.verdict, r.template) for r in urls.judged(table, labels).collect()}
    assert {got[i][0] for i in range(0, 400, 2)} == {"allow"} and {got[i][0] for i in range(1, 400, 2)} == {"block"}
    assert {got[i][1] for i in range(400)} == {"/news/*/*", "/spam/*/*"}
    assert got[1000][1] == "/*/*/*/*/*/*/*/*/**"
    assert urls.judged(spark.createDataFrame([], "page_id long, url string"), labels).collect() == []


def test_branches_are_judged_alike_on_large_hosts_and_at_any_depth(spark):
    pages = [(i, f"http://small.net/{('news', 'spam')[i % 2]}/{i}") for i in range(80)]
    pages += [(1000 + i, f"http://large.net/{'spam' if i < 40 else f's{i // 40}'}/{i}") for i in range(6000)]
    deep = "/".join("abcdefghij")
    pages += [(8000 + i, f"http://deep.net/{deep}/{('news', 'spam')[i % 2]}/{i}") for i in range(200)]
    spam = {k for k, u in pages if "/spam/" in u}
    labels = spark.createDataFrame([(k, int(k not in spam), 0) for k, _ in pages], "doc_id long, quality int, toxic int")
    got = urls.judged(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == spam
    assert {r.template for r in got if r.host == "large.net"} == {"/spam/*", "/*/*"}
    assert {r.template for r in got if r.host == "deep.net"} == {"/*" * 10 + "/news/*", "/*" * 10 + "/spam/*"}


def brute_verdicts(pages):
    """The method in plain loops over lists of labelled paths; pages without a rule only."""
    cut, labelled = {}, []
    for key, url in pages:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0].lower()
        path = re.match("[^?#]*", rest[len(host):])[0]
        fits = [(len(h + p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        verdict = max(fits)[1] if fits else None
        names = host.split(".")
        wide = list(dict.fromkeys(["", names[-1], ".".join(names[-2:]), host]))
        cut[key] = wide, [s for s in path.split("/") if s], verdict
        if verdict:
            labelled += [(pool, cut[key][1], verdict == "block") for pool in wide]

    def template(pool, segments):
        mine, out = [(s, bad) for p, s, bad in labelled if p == pool], []
        for level, segment in enumerate(segments):
            here = [(s[level], bad) for s, bad in mine if len(s) > level]
            own, others = [bad for s, bad in here if s == segment], [bad for s, bad in here if s != segment]
            keep = False
            if own and others:
                share, each = sum(bad for _, bad in here) / len(here), 1 / len(own) + 1 / len(others)
                distance = abs(sum(own) / len(own) - sum(others) / len(others)) - each / 2
                keep = 0 < share < 1 and distance > urls.APART * (share * (1 - share) * each) ** 0.5
            kept_here = {}

            def stays(name):
                if name not in kept_here:
                    own, others = [bad for s, bad in here if s == name], [bad for s, bad in here if s != name]
                    share, each = sum(bad for _, bad in here) / len(here), 1 / len(own) + 1 / max(len(others), 1)
                    kept_here[name] = bool(others) and 0 < share < 1 and (
                        abs(sum(own) / len(own) - sum(others) / len(others)) - each / 2 > urls.APART * (share * (1 - share) * each) ** 0.5)
                return kept_here[name]

            out.append(segment if keep else "*")
            mine = [(s, bad) for s, bad in mine if len(s) > level and (s[level] == segment if keep else not stays(s[level]))]
        return tuple(out), mine

    usual = [bad for pool, _, bad in labelled if pool == ""]
    result = {}
    for key, (wide, segments, verdict) in cut.items():
        share = (len(usual) - sum(usual) + urls.PRIOR) / (len(usual) + urls.PRIOR)
        for pool in wide:
            _, same = template(pool, segments)
            same = [bad for s, bad in same if len(s) == len(segments)]
            share = (len(same) - sum(same) + urls.PRIOR * share) / (len(same) + urls.PRIOR)
        result[key] = verdict or ("block" if share < urls.PURITY else "allow")
    return result


def test_learned_verdicts_match_brute_force(spark, sf_dir):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf_dir}/../sf0.01/pages.parquet").collect() if r.url and "://" in r.url]
    got = {r.page_id: r for r in urls.judged(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    expected = brute_verdicts(pages)
    assert {k: r.verdict for k, r in got.items()} == expected
    assert {r.verdict for r in got.values() if r.rule is None} == {"allow", "block"}


def test_a_small_branch_of_bad_pages_is_told_apart(spark):
    pages = [(i, f"http://a.com/fr/{i}") for i in range(60)] + [(100 + i, f"http://b.com/de/{i}") for i in range(8)]
    pages += [(200, "http://c.net/de/x"), (201, "http://c.net/fr/x")]
    got = {r.page_id: r for r in urls.judged(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert got[200].verdict == "block" and got[201].verdict == "allow" and got[200].rule is None


def test_blocks_of_untidy_markup():
    page = ("<html><head><title>no</title><style>p{}</style></head><body><!-- <p>no</p> --><script>if (a<b) '<p>no</p>'</script>"
            "<div class='a b_c'>one &amp; <b>two<p>three<br>four <a href=x>link</a><p>5 &lt; 6 a<b</div><ul><li>x<li>y</ul></body>")
    blocks = leaf_blocks(page)
    assert [b.text for b in blocks][:2] == ["one & two", "three four link"]
    assert [b.text for b in blocks][-2:] == ["x", "y"]
    assert blocks[0].path == ("html", "body", "div", ".a", ".b", ".c") and blocks[1].links == 4
    assert leaf_blocks("") == []


@pytest.mark.parametrize("odd", [
    "<svg class='i'/>", "<svg><title/><style/></svg>", "<div><select><option></div>", "<div><template></div>", "<div><noscript></div>",
    "<div><svg><g></div>", "<div><iframe></div>", "<title-bar></title-bar>", "<select-box>", "<template-card>", "<template>", "<select>",
    "<svg>", "<noscript>", "<iframe>", "<svg><g>no</g></svg>", "<div><select><option>no<option>no</select></div>", "<svg><svg/>no</svg>",
    "<noscript><p>no</p></noscript>", "<template><div>no</template>", "<script>no</script>", "<textarea>no</textarea>"])
def test_odd_tags_hide_nothing_after_them(odd):
    assert [b.text for b in leaf_blocks(f"<body><p>first</p>{odd}<article><p>one</p><p>two</p></article></body>")] == ["first", "one", "two"]
    assert leaf_blocks("<body><title>no <p>no") == leaf_blocks("<style>no <p>no") == leaf_blocks("<script src=x>no <p>no") == []


def test_labeller_on_layouts_it_has_not_seen(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = extraction.fit(pages)
    texts = [b.text for r in pages.orderBy("page_id").limit(60).collect() for b in leaf_blocks(r["html"]) if len(b.text) > 40]
    held = extraction.examples(texts, 150, seed=99)
    right = total = 0
    for p, (blocks, truth) in zip(model.probabilities([b for b, _ in held]), held):
        right, total = right + int(((p >= 0.5) == np.array(truth)).sum()), total + len(blocks)
    assert right / total > 0.99
    odd = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (2, "u", "", "x"), (None, "u", "<p>", "x"), (
        4, "u", "<body><nav>Home</nav><article><h1>A title</h1><p>" + "Some words of text. " * 20000 + "</p></article></body>", "x")],
        "page_id long, url string, html string, text string")
    got = extraction.extract(odd, model).collect()
    assert [r.text for r in got][:4] == [""] * 4
    assert got[4].text == "A title\n\n" + ("Some words of text. " * 20000).strip()
    assert extraction.extraction_report(odd.limit(0)).collect() == []


def test_a_window_of_many_items_is_broadcast_once(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_WINDOWS", 3)
    text = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(f"i{i}", text) for i in range(30)] + [("short", "w3 w4")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x " + text + " y w3 w4", "k"), (2, "none of it", "k"), (3, "a w3 w4 b w3 w4", "k")],
                                 "doc_id long, text string, key string")
    rows = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.decontamination_report(docs, bench).collect()}
    assert rows == {1: (22, 31), 2: (0, 0), 3: (4, 1)}
    cut = decontaminate.without_spans(docs, bench)
    assert cut.columns == ["doc_id", "text", "key", "removed_spans"]
    assert {r.doc_id: (r.text, r.key) for r in cut.collect()} == {1: ("x y", "k"), 2: ("none of it", "k"), 3: ("a b", "k")}


def test_benchmark_windows_are_met_by_their_hash_alone(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    windows = spark.createDataFrame([(7, 2, 5, ["one", "two"])], "window long, n int, hash long, words array<string>")
    plan = decontaminate.hits(docs, windows)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "HashJoin" in line]
    assert joins and all(re.search(r"HashJoin \[[\w#]+\], \[[\w#]+\], Inner", line) for line in joins), plan


def test_words_are_those_of_the_pattern(spark):
    texts = ["".join(map(chr, range(128))), "", " .", "-A-b--C-", "ÉKİ ÀB\x85c Zz9", "x\x00Y", "\x7fa\x1f", "日本 K"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(
        "text", decontaminate.words(decontaminate.text_or_empty()).alias("words"),
        decontaminate.n_words(decontaminate.text_or_empty()).alias("n")).collect()
    for text, words, n in rows:
        lower = text.translate(str.maketrans(decontaminate.UPPER, decontaminate.LOWER))
        assert words == TOKEN.findall(lower) and n == len(words), text
