"""Language ID, line dedup, HTML, PII, quality, n-gram join and the pipeline against brute force."""

import collections
import hashlib
import random
import re
import time

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import html, langid, linededup, ngramjoin, pii, quality
from tidemark.llm.queries import QUERIES

EDGE = [(1, None, None, None), (2, "", "en", "s"), (3, "a b", "en", "s"), (3, "a b", "en", "s"), (None, "x y z w v", None, "s"), (4, "word " * 20000, "de", None), (5, "\n\n \t", "fr", "t")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).selectExpr("*", "'clash' as key", "1 as n", "2 as line")


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_pii(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            bad = (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (16 <= len(d) <= 19 and luhn(d))) or (kind == "phone" and not 8 <= len(d) <= 15)
            if not bad:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check_pii(rows, texts):
    for r in rows:
        want = brute_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), r["doc_id"]
        assert r["spans"].startswith(",".join(want))
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(w.startswith(f"{k}:") for w in want) for k in PATTERNS]


def test_op8(spark, sf, texts):
    check_pii(QUERIES["op8_pii"](spark, sf).collect(), texts)


def test_pii_fuzz_and_edges(spark):
    r = random.Random(3)
    some = {i: "".join(r.choice("ab.@@-+0123456789 ()é😀%_.") for _ in range(r.randrange(80))) for i in range(1500)}
    some |= {2000: "1" * 60000, 2001: "a" * 60000 + "@b.c+x@y.com", 2002: "4111 1111 1111 1111 x 4111-1111-1111-1111", 2003: "", 2004: "+1" * 20000, 2005: "a@" + "b." * 20000 + "c"}
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string").selectExpr("*", "1 as spans", "2 as __x")
    check_pii(pii.digests(df).collect(), some)
    assert pii.digests(df.limit(0)).count() == 0
    null = pii.digests(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()
    assert null["spans"] == "" and null["n_email"] == 0


def brute_redact(text, spans):
    """``spans``: (start, end, kind)."""
    out, at = "", 0
    for a, b, kind in sorted(spans):
        if a >= at:
            out += text[at:a] + f"<{kind.upper()}>"
        at = max(at, b)
    return out + text[at:]


def test_long_texts_of_many_matches(spark):
    """Megabytes of labels and mixed spans end soon, with spans apart and texts cut as plain Python does it."""
    r = random.Random(9)
    some = ["joe (at) mail.cc", "a.b@c.org", "+1 (555) 123-4567", "(212) 555-0187", "Mr John Smith", 'token = "abcdef0123456789abcdef0123456789"', "é😀", "4111111111111111", "x.y@z (at) q.com", "n" * 1500]
    texts = {1: "joe (at) mail" + ".cc" * 30_000, 2: "".join(r.choice(some) + r.choice([" ", ", ", "\n"]) for _ in range(5_000)), 3: "a@b.cc " * 20_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.digests(df).collect()}
    check_pii(rows.values(), texts)
    cut = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    for d, row in rows.items():
        found = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in row["spans"].split(","))]
        base = sorted((a, b) for a, b, k in found if k in pii.BASE)
        assert all(b <= c for (_, b), (c, _) in zip(base, base[1:], strict=False)) or d != 3
        extra = sorted((a, b) for a, b, k in found if k in pii.EXTRA)
        assert not {i for a, b in base for i in range(a, b)} & {i for a, b in extra for i in range(a, b)}
        assert cut[d] == brute_redact(texts[d], found)


def test_added_spans_are_the_planted_secrets(spark, texts):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = {(r["doc_id"], m.start(), m.end()) for r in df.collect() for m in re.finditer('token = "[0-9a-f]{40}"', r["text"] or "")}
    added = {(r["doc_id"], int(a), int(b)) for r in pii.digests(df).collect() for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k in pii.EXTRA}
    assert planted and added == planted


def test_redaction_hides_all_spans(spark):
    rows = [(1, "é mail a.b@c.org or +1 (555) 123-4567, card 4111111111111111; call (212) 555-0187 now", 1), (2, None, 2), (3, "clean", 3)] * 3
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()}
    assert "é mail <EMAIL> or <PHONE>, card <CARD>" in got[1] and got[2] is None and got[3] == "clean"


def brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(t.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover))


def test_op10(spark, sf, texts):
    got = QUERIES["op10_quality"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_counts(texts[r["doc_id"]])
        assert tuple(r[k] for k in quality.COUNTS[:5]) == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_edges_and_outliers(spark, edge):
    stats = quality.statistics(edge, keep=("doc_id", "lang", "source"))
    assert quality.judged(stats).count() == len(EDGE)
    assert quality.judged(stats.limit(0)).count() == 0
    assert quality.repeated([b"a"] * 9000) == 9000
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(r.choice(words) + ("###" if i >= 190 else "") for _ in range(120)), "en", "s") for i in range(200)]
    kept = {r["doc_id"] for r in quality.keep_good(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == set(range(190))


def test_many_groups_are_salted_with_equal_results(spark, sf, monkeypatch):
    want = {tuple(r) for r in QUERIES["op10_quality"](spark, sf).collect()}
    monkeypatch.setattr(quality, "FEW_GROUPS", 0)
    assert {tuple(r) for r in QUERIES["op10_quality"](spark, sf).collect()} == want


def test_concentration_matches_numpy(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(400, quality.P))
    x[:60] += 8
    good = spark.createDataFrame([("g", *map(float, v)) for v in x], "__g string, " + ", ".join(f"{c} double" for c in quality.X))
    params = quality.first_estimate(good)
    for _ in range(5):
        params = quality.concentrate(good, params, 0.75)
    mu = np.array(params.first()["mu"])
    assert np.abs(mu - x[60:].mean(axis=0)).max() < 0.3 < np.abs(mu - x.mean(axis=0)).max()


def brute_components(texts, width, percent):
    up = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets, inverse = {}, collections.defaultdict(list)
    for d, t in texts.items():
        w = (t or "").encode().translate(up).split()
        sets[d] = frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()
        for s in sets[d]:
            inverse[s].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for ids in inverse.values() for a in ids for b in ids if a < b}:
        i = len(sets[a] & sets[b])
        if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_op7(spark, sf, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op7_ngramjoin"](spark, sf).collect()}
    assert got == brute_components(texts, 4, 85)


def near_copies(seed=4):
    """Groups whose members are linked to some of the others only, over words that are frequent in the whole table."""
    r, out = random.Random(seed), {}
    for g in range(6):
        base = [f"w{r.randrange(40)}" for _ in range(60 + 60 * g)]
        for _ in range(60):
            t = list(base)
            for _ in range(r.randrange(4 + g)):
                t[r.randrange(len(t))] = f"x{r.randrange(9)}"
            out[len(out)] = " ".join(t)
    out |= {len(out) + i: " ".join(f"u{r.randrange(5)}" for _ in range(r.randrange(9))) for i in range(150)}
    return out


@pytest.mark.parametrize(("frequent", "pair_size"), [(256, 200), (3, 100), (3, 1000)])
def test_join_classes_lose_no_link(spark, monkeypatch, frequent, pair_size):
    monkeypatch.setattr(ngramjoin, "FREQUENT", frequent)
    monkeypatch.setattr(ngramjoin, "PAIR_SIZE", pair_size)
    monkeypatch.setattr(ngramjoin, "LISTED", 2)
    some = near_copies()
    df = spark.createDataFrame(list(some.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.near_duplicates(df, 4, 85).collect()}
    assert got == brute_components(some, 4, 85)


def test_keys_meet_for_every_linked_pair():
    """Index keys alone: sets that link share one, whichever classes their tokens are in."""
    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(6, 500))
        x = np.unique(r.integers(-(1 << 62), 1 << 62, n))
        y = np.unique(np.concatenate([x[r.random(len(x)) < 0.93], r.integers(-(1 << 62), 1 << 62, int(r.integers(0, max(1, n // 12))))]))
        i = len(np.intersect1d(x, y))
        if not i or 100 * i < 85 * (len(x) + len(y) - i):
            continue
        every = np.union1d(x, y)
        listed = np.sort(every[r.random(len(every)) < r.random()])
        times = r.integers(1, 2 * ngramjoin.FREQUENT, len(listed))
        if len(x) != i or len(y) != i:
            a, b = ngramjoin.keys_of(x, listed, times, 85), ngramjoin.keys_of(y, listed, times, 85)
            met = False
            for (k, v), (m, w), small, large in ((a, b, x, y), (b, a, y, x)):
                if len(small) <= len(large):
                    _, p, q = np.intersect1d(k, m, return_indices=True)
                    room = (v[p] & 2) // 2 + 1 + np.minimum(v[p] >> 2, w[q] >> 2)
                    met |= bool(((v[p] & 1) & (185 * room >= 85 * (len(x) + len(y)))).any())
            assert met


def test_join_edges(spark, edge):
    got = ngramjoin.near_duplicates(edge).collect()
    assert len(got) == len(EDGE) and all(r["component_id"] == r["doc_id"] for r in got if r["n_shingles"] == 0)
    assert ngramjoin.near_duplicates(edge.limit(0)).count() == 0
    one = ngramjoin.one_of_each(edge)
    assert one.count() == len(EDGE) - 1 and one.columns == edge.columns and {r["key"] for r in one.collect()} == {"clash"}


def test_op2_learns_from_the_other_folds(spark, sf):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op2_langid"](spark, sf).collect()
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert len(got) == len(docs) and np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)


def test_gradients_are_right():
    net = langid.Network(3, hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = np.random.default_rng(0).integers(0, 257, (6, 5)), np.array([0, 1, 2, 1, 0])

    def loss():
        p = net.labels(x)[:, np.arange(5), y]
        real = x != langid.PAD
        return -np.log(p)[real].sum() / real.sum()

    g = net.gradients(x, y)
    for k in ("u", "b", "o", "c"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, eps = net.w[k][at], 1e-3
        net.w[k][at] = old + eps
        up = loss()
        net.w[k][at] = old - eps
        down = loss()
        net.w[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=1e-4)


def test_langid_edges(spark, edge):
    net, langs = langid.train(edge.limit(0))
    assert net is None and langs == []
    got = langid.identify(edge, *langid.train(edge, steps=2)).collect()
    assert len(got) == len(EDGE) and {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 5)} == {"und"}


PAGE = """<html><head><title>no</title><script>var a="<p>x</p>"</script></head><body><nav><ul><li>menu</ul></nav><header>head</header>
<div class="cookie-notice">notice</div><article><h1>T &amp;  t</h1><p>one<br>two <b>three<p>&lt;four&gt; &eacute;
five</p><div class="share">share</div><section id="comments"><p>reader</p></section><form>q</form><ul><li>a<li>b</ul></article><aside>side</aside><footer>f</footer></body></html>"""


def test_html_blocks():
    assert "\n".join(t for t, _ in html.blocks_of(PAGE)) == "T & t\none two three\n<four> é five\na\nb"
    assert html.blocks_of("") == [] and [t for t, _ in html.blocks_of("plain <b>text")] == ["plain text"]
    assert [t for t, _ in html.blocks_of("<p>a<table><tr><td>x<td>y</table>b<p")] == ["a", "x", "y", "b"]


@pytest.mark.parametrize("few", [0, 50_000])
def test_templates_go_by_host(spark, monkeypatch, few):
    monkeypatch.setattr(html, "FEW_TEMPLATES", few)
    rows = [(i, f"http://h{i % 2}.org/{i}", f"<body><div>Site {i % 2} bar</div><div><p>text {i}</p><p>both</p></div></body>") for i in range(30)] + [(99, None, None), (98, "bad", "")]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as host")).collect()}
    assert got[3] == "text 3" and got[99] == "" and got[98] == "" and len(got) == 32


def test_op4(spark, sf):
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    from html import unescape

    for r in QUERIES["op4_html"](spark, sf).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.DOTALL)
        parts = re.split(r"</?(?:p|h1)>", article[1]) if article else []
        want = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", p))).strip() for p in parts]
        assert r["text"] == "\n".join(w for w in want if w) and r["n_chars"] == len(r["text"])


def test_templates_of_lines_generalise(spark):
    r = random.Random(0)
    rows = [(i, f"unique {r.random()} words here {i} only {r.random()}\nPage {i} of the user {r.choice('abcdefgh')}x manual today\nclean tail number {i} {r.random()} ok then", i) for i in range(40)]
    rows = [(i, re.sub(r"unique (\S+)", lambda m: "unique " + hashlib.md5(m[1].encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop")), t).replace("clean tail number", "clean tail " + "".join(r.choice("abcdef") for _ in range(9)) + " num"), k) for i, t, k in rows]
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect()
    assert all("manual" not in r["text"] and "clean tail" in r["text"] for r in got)
    copies = spark.createDataFrame([(i, rows[0][1]) for i in range(50)], "doc_id long, text string")
    assert all(r["n_dropped"] == 0 for r in linededup.dedup(copies).collect())


def test_line_dedup_edges(spark, edge):
    got = linededup.dedup(edge).collect()
    assert len(got) == len(EDGE) and all(r["n_dropped"] == 0 for r in got)
    assert {r["doc_id"]: r["text"] for r in got}[1] is None and {r["key"] for r in got} == {"clash"}
    assert linededup.dedup(edge.limit(0)).count() == 0


def test_op5_drops_what_recurs(spark, sf, texts):
    got = {r["doc_id"]: r["text"] for r in QUERIES["op5_linededup"](spark, sf).collect()}
    marks = {d: min((hash(x) for x in t.split("\n")), default=0) for d, t in texts.items()}
    seen = collections.defaultdict(set)
    for d, t in texts.items():
        for line in t.split("\n"):
            seen[line].add(marks[d])
    for d, t in got.items():
        for line in set(texts[d].split("\n")) - set((t or "").split("\n")):
            assert len(line.split()) >= linededup.MIN_WORDS
        for line in (t or "").split("\n"):
            assert len(seen[line]) < 3 * linededup.MIN_DOCS or len(line.split()) < linededup.MIN_WORDS


def test_pipeline(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, sf), "stage")
        assert docs.columns == before
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert 0.5 * len(texts) < len(left) < len(texts)
    assert not any(re.search(PATTERNS["email"], t or "") for t in left.values())
    packed = corpus_pipeline.packing(spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == set(left)
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def prose(r, words=40):
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(words))


def test_a_line_of_least_hash_is_dropped(spark):
    r = random.Random(5)
    own = [prose(r) for _ in range(40)]
    least = min(linededup.hash64(x.encode()) for x in own)
    notice = next(x for x in (prose(r, 8) for _ in range(100_000)) if linededup.hash64(x.encode()) < least)
    got = linededup.dedup(spark.createDataFrame([(i, f"{x}\n{notice}") for i, x in enumerate(own)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == dict(enumerate(own))


def test_copies_and_repeats_do_not_save_a_recurring_line(spark):
    r = random.Random(6)
    notice, rule = prose(r, 8), prose(r, 6)
    texts = [f"{prose(r)}\n{notice}" for _ in range(30)] + ["\n".join([prose(r), *[rule] * 12]) for _ in range(30)]
    rows = list(enumerate(texts)) + [(100 + i, texts[0]) for i in range(300)]
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 360 and all(r["text"] == dict(rows)[r["doc_id"]].split("\n")[0] for r in got)


def test_edited_copies_keep_their_text(spark):
    r = random.Random(7)
    article = [prose(r, n).split() for n in (20, 40, 60)]
    rows = []
    for i in range(50):
        copy = [list(line) for line in article]
        for line in copy:
            for at in r.sample(range(3, len(line)), len(line) // 20):
                line[at] = prose(r, 1)
        rows.append((i, "\n".join(map(" ".join, copy))))
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == dict(rows)


def test_a_large_leaf_has_templates_too(spark, monkeypatch):
    monkeypatch.setattr(linededup, "MAX_LEAF", 8)
    r = random.Random(8)
    own = [prose(r) for _ in range(40)]
    rows = [(i, f"{x}\nwe thank our reader {prose(r, 1)} for being with us") for i, x in enumerate(own)]
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == dict(enumerate(own))


def test_class_words_and_comment_articles_leave_the_page(spark):
    text = "the text of the page is long enough to be most of it"
    side = "<section class=comments><article>a comment</article></section><aside><article>teaser</article></aside>"
    pages = [f"<div>{text}</div>{side}", f'<main class="has-sidebar"><p>{text}</p></main>', f'<div class="layout with-sidebar"><article><p>{text}</p></article><div class=sidebar>x</div></div>']
    assert [[t for t, _ in html.blocks_of(p)] for p in pages] == [[text]] * 3


def test_templates_of_few_pages_go_and_copies_stay(spark):
    menu, copied = "<div>section notice</div>", "<div><p>a copied page</p></div>"
    rows = [(i, "http://h.org/", f"<div><p>text {i}</p></div>{menu if i < 8 else ''}") for i in range(200)] + [(200 + i, "http://h.org/", copied) for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i}" if i < 200 else "a copied page" for i in range(209)}


def test_forms_and_state_words_keep_the_article():
    text = "the text of the page"
    more = "<p>a sidebar with far more text than there is in the article itself, on and on</p>"
    pages = [f"<form id=aspnet><article><p>{text}</p><form>q</form></article></form>", f'<article><div class="entry-content has-share"><p>{text}</p></div><div>{text}</div></article>', f"<form><article>{text}</article></form><div class=sidebar>{more}</div>"]
    assert ["\n".join(dict.fromkeys(t for t, _ in html.blocks_of(p))) for p in pages] == [text] * 3
    assert [t for t, _ in html.blocks_of("<p title='a>b' x=\"c>d\">one<p it's>two")] == ["one", "two"]


@pytest.mark.parametrize("part", ['<a "', "<a ='", "<a ", "<", "<div>", "</div>", "<!", "<p x='>", "<script", "<div></p>", "&", "<li><ul>"])
def test_malformed_long_pages_end_soon(part):
    page = f"<p>first</p>{part * (2_000_000 // len(part))}"
    began = time.time()
    assert html.blocks_of(page)[0][0] == "first"
    assert time.time() - began < 20


def test_stages_keep_columns_of_any_name(spark, sf):
    """Callers' columns, whatever their names, come out of every stage as they went in."""
    names = ["a.b", "n_lines", "n_dropped", "__pii_base", "__pii_spans", "key", "__g", "x`y", "kept", "drops"]
    docs = spark.createDataFrame([(k, f"{k} words that are said by nobody else, number {k * 7919} of them, mail{k}@site.org", "en", "s", 0) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.toDF(*docs.columns).selectExpr("*", *(f"concat('{i}-', doc_id) AS c{i}" for i in range(len(names)))).toDF(*docs.columns, *names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert [r[n] for n in names] == [f"{i}-{r['doc_id']}" for i in range(len(names))], name
    assert linededup.dedup(docs).columns == [*docs.columns, "_n_lines", "_n_dropped"]


def test_language_of_texts_without_letters(spark):
    df = spark.createDataFrame([(1, "x²"), (2, "²½ 12 _"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, langid.Network(1), ["en"]).collect()}
    assert got == {1: "en", 2: "und", 3: "und"}


def grown(spark, bodies, **limits):
    """template of each line of one leaf."""
    rows = [(1, linededup.hash64(b.encode()), b.encode()) for b in bodies]
    got = linededup.tree_of(spark.createDataFrame(rows, "leaf long, line long, body binary"), linededup.SIMILARITY).collect()
    assert len(got) == len(rows)
    return {r["line"]: r["template"] for r in got}


def test_op5_long_unlike_lines_end_in_bounded_rounds(spark, monkeypatch):
    """Lines of 400 words: 101 classes, but a leaf rests after CYCLE rounds; a template's lines meet all the same."""
    made = []
    monkeypatch.setattr(linededup, "MAX_LEAF", 10)
    monkeypatch.setattr(linededup, "CYCLE", 6)
    keep = linededup.saved
    monkeypatch.setattr(linededup, "saved", lambda df, name: made.append(name) or keep(df, name))
    r = random.Random(4)
    unlike = ["a b c " + " ".join(f"w{r.randrange(10**6)}x" for _ in range(400)) for _ in range(24)]
    got = grown(spark, unlike)
    assert len(set(got.values())) == len(unlike)
    assert made.count("lines-grown") <= 10


def test_op5_leaves_bounded_by_bytes_and_large_leaves_merge(spark, monkeypatch):
    """A template's variants in a leaf that is too large by bytes or by lines end in one template, with unlike lines around."""
    r = random.Random(5)
    fixed = [f"t{i}" + "x" for i in range(20)]
    variants = ["a b c " + " ".join(x if i % 5 else f"v{r.randrange(10**6)}q" for i, x in enumerate(fixed)) for _ in range(30)]
    unlike = ["a b c " + " ".join(f"u{r.randrange(10**6)}q" for _ in range(20)) for _ in range(30)]
    for name, value in (("MAX_BYTES", 2000), ("MAX_LEAF", 12)):
        with monkeypatch.context() as m:
            m.setattr(linededup, name, value)
            got = grown(spark, variants + unlike)
        assert len({got[linededup.hash64(v.encode())] for v in variants}) == 1
        assert len({got[linededup.hash64(u.encode())] for u in unlike}) == len(unlike)


def test_op5_control_tokens_are_words(spark):
    """Words that are control characters are no wildcards and no blanks."""
    r = random.Random(6)
    notice = "\x00 \x01 share this page with friends"
    rows = [(i, prose(r) + "\n" + notice) for i in range(40)]
    got = linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(notice not in x["text"] and x["n_dropped"] == 1 for x in got)
