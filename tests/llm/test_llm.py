import base64
import hashlib
import random
import string
import time
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cedarlog.llm import decontaminate, embedding_dedup, html_extract, lm_score, minhash, packing, ppm, secrets, substring_dedup, toxicity, warc
from cedarlog.llm.common import LOWER_BYTES, connected_components

WORDS = "the of and to in is it that for was on are as with his they at be this from have or by one had not but what all were".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "x", "er", "ing", "."]) for _ in range(n))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(n)]
    texts += [texts[0], texts[1], None, "", " \n\t ", "One", texts[2] + " tail", texts[3].upper(), "é🎉 " + texts[4]]
    near = texts[5].split() or ["x"]
    texts += [" ".join(near[:40] + [f"new{i}"] + near[40:]) for i in range(6)]
    texts += [texts[7][:600] + prose(rng, 50) + texts[8][:700], ("abc" * 400), ("abc" * 300) + "q", "word " * 3000]
    return list(enumerate(texts))


DDL = "doc_id long, text string"


def frame(spark, rows):
    """With extra columns whose names clash with results and work columns."""
    return spark.createDataFrame(rows, DDL).selectExpr("doc_id", "text", "1 AS n", "'x' AS key", "2 AS row", "3 AS score", "4 AS block", "'s' AS kept")


def components(nodes, links):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rows = corpus()
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(LOWER_BYTES).split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = components(sets, links)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, rows), size).collect()}
    assert len(got) == len(rows)
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (i == expected[i]) for i, r in got.items())


def test_near_duplicates_of_a_large_region(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[: i % 60], f"n{i}", *base[i % 60 + 1 :]])) for i in range(40)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, DDL), 2).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_null_ids_and_empty_tables(spark):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)]
    df = frame(spark, rows)
    got = minhash.near_duplicates(df, 2).collect()
    assert sorted((r["doc_id"] is None, r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == [(False, 1, True), (False, 1, True), (False, 2, True)]
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    none = df.limit(0)
    assert minhash.near_duplicates(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0 and substring_dedup.remove_repeats(df).count() == 4
    assert lm_score.score_texts(none).count() == 0 and lm_score.score_texts(df).count() == 4
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    assert sorted(r["contaminated"] for r in decontaminate.contamination(df, bench).collect()) == [False, True, True, True]
    assert decontaminate.contamination(df, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.remove_contaminated(df, bench).columns == df.columns


@pytest.mark.parametrize("bound", [50_000, 0])
def test_decontamination(spark, bound):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.choice([5, 13, 30, 40]))) for i in range(12)] + [(50, None), (51, "--"), (52, items_text := "Short One")]
    rows = corpus(4, 30) + [(200 + i, prose(rng, 20) + " " + (t or "") + ", " + prose(rng, 20 * i)) for i, t in items] + [(300, items_text.upper())]

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(0, len(w) - 12)) if len(w) >= 13 else range(bool(w)):
            windows[tuple(w[k : k + 13])].add(str(i))
    got = {r["doc_id"]: r for r in decontaminate.contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), set_bound=bound).collect()}
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (len(w), len(hit), len(found)), i
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert any(r["contaminated"] for r in got.values())


@pytest.mark.parametrize("segment", [1 << 20, 700])
def test_repeated_substrings(spark, segment, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEGMENT", segment)
    rows = corpus(5, 40)
    data = {i: (t or "").encode() for i, t in rows}
    counts = Counter(b[k : k + 400] for b in data.values() for k in range(len(b) - 399))
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(frame(spark, rows)).collect()}
    removed = 0
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if counts[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()), i
        removed += sum(gone)
    assert removed > 5000


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(embedding_dedup, "CELL", 16)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 24)
    x = rng.standard_normal((260, 16))
    for i in range(60):  # neighbours on both sides of the threshold
        noise = rng.standard_normal(16)
        x[200 + i] = x[i] / np.linalg.norm(x[i]) + noise / np.linalg.norm(noise) * rng.uniform(0.05, 0.42)
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(x.astype(np.float32))]
    rows += [(300, rows[0][1], 1), (301, rows[0][1], 2), (302, None, 0), (303, [0.0] * 16, 0), (304, [float("nan")] * 16, 0), (305, [1.0] * 4, 0), (306, [1.0, None] * 8, 0)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    good = {i: np.array(v, dtype=float) for i, v, _ in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    good = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = {(a, b) for a in good for b in good if a < b and good[a] @ good[b] >= 0.9}
    n = Counter(i for pair in links for i in pair)
    found = sum(r["n_links"] for r in got.values())
    assert len(links) > 50 and 0.97 * 2 * len(links) <= found <= 2 * len(links)
    assert all(got[i]["n_links"] <= n[i] for i in got)
    expected = components(got, links)
    assert sum(got[i]["component_id"] == expected[i] for i in got) >= 0.97 * len(got)
    assert got[301]["component_id"] == 0 and got[302]["n_links"] == 0 and got[305]["kept"]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:"</p>"}</style><script>var a="<p>no</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- note --><div class="cookie-notice"><p>We use cookies</p></div>
<div class="ad banner">Buy</div><main><article><h1>Title &amp; more</h1><p>First  para&#8217;s
text.<p>Be.<br>Next <b>bold</b> <a href=x>link</a> end.</p><div class=ad>Buy now</div><ul><li>One</li><li>Two</li></ul>
<form><input name=q>Search</form></article><aside>Related</aside></main><section id="comments"><p>I agree!</p></section><footer>&copy; x</footer>"""


def test_html(spark):
    expected = "Title & more\n\nFirst para’s text.\n\nBe. Next bold link end.\n\nOne\n\nTwo"
    rows = [(1, "http://a/", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "long " * 50_000)]
    got = {r["page_id"]: r for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == expected and got[1]["n_chars"] == len(expected)
    assert (got[2]["text"], got[2]["n_chars"], got[3]["text"]) == ("", 0, "") and got[4]["n_chars"] == 249_999


@pytest.mark.parametrize("name", ["content with-sidebar", "no-sidebar", "page has-header", "layout menu-open", "has-comments"])
def test_html_wrapper_with_a_boilerplate_word(name):
    text = "Words of an article that go on for a while. " * 5
    body = f'<h1>Title</h1><p>{text}</p><div class="ad">Buy</div><p>{text}</p>'
    expected = f"Title\n\n{text.strip()}\n\n{text.strip()}"
    comments = '<section class="comments">' + f"<article>{text * 9}</article>" * 3 + "</section>"
    for page in (f'<div class="{name}"><article>{body}</article></div>{comments}', f'<div class="{name}">{body}</div><div class="notice">Hi</div>', f'<main><div id="{name}">{body}</div></main>', f'<form class="{name}">{body}</form>'):
        assert html_extract.main_text(f"<body><nav><a href=x>A</a></nav>{page}<footer>f</footer>") == expected
    assert html_extract.main_text('<p>a <span class="ad">x <span>y</span> z</span> b</p><p>The rest of it</p>') == "a\n\nb\n\nThe rest of it"
    short = f"<article><p>Short</p></article><div class=ad>{text}</div>"
    assert html_extract.main_text(short) == "Short" and html_extract.main_text(f"<div hidden><main>{body}</main></div>") == ""


def test_html_lines_of_links():
    text = "Words of an article that go on for a while. " * 5
    links = "<ul>" + "".join(f"<li><a href=x>Link {i}</a></li>" for i in range(5)) + "</ul>"
    shown = [f"Link {i}" for i in range(5)]
    one = '<p>See <a href="x">a long title of a work that is cited</a>.</p>'
    cited = "See a long title of a work that is cited."
    t = text.strip()
    assert html_extract.main_text(f"<article><p>{text}</p>{one}<p>Short</p>{links}</article>{links}").split("\n\n") == [t, cited, "Short", *shown]
    assert html_extract.main_text(f"<div>Site</div>{links}<div><p>{text}</p>{links}<p>{text}</p>{one}<p>End</p></div>{links}").split("\n\n") == [t, *shown, t, cited, "End"]


def test_html_runs_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        n = int(rng.integers(0, 25))
        lengths = [int(x) for x in rng.choice([0, 0, 0, 5, 40, 90, 300], n)]
        own, window = [bool(x) for x in rng.random(n) < 0.05], int(rng.integers(1, 5))
        sums = {i: sum(lengths[k] for k in range(i, i + window) if 0 <= k < n) for i in range(-window, n + 1)}
        runs, i = [], -window
        while i <= n:
            if not sums[i]:
                i += 1
                continue
            j = i
            while sums[j]:
                j += 1
            inside = [k for k in range(max(0, i), min(n, j + window - 1)) if lengths[k]]
            runs.append((inside[0], inside[-1], max(sums[k] for k in range(i, j)), any(own[k] for k in inside)))
            i = j
        least = min(86, max(sums.values(), default=0) / 2)
        kept = [(a, b) for a, b, most, owned in runs if owned or most >= least]
        lines = set()
        for k, (a, b) in enumerate(kept):
            lines |= set(range(a, b + 1))
            if k and min(sums[kept[k - 1][1] - window + 1], sums[a]) >= html_extract.DENSE:
                lines |= set(range(kept[k - 1][0], b + 1))
        assert lines == {k for a, b in html_extract.text_runs(lengths, own, window) for k in range(a, b + 1)}


def test_html_surge_and_dive():
    text = "Words of an article that go on for a while. " * 5
    links = "".join(f"<div><a href=x>Link {i}</a></div>" for i in range(4))
    body = f"<h1>Title</h1><p>{text}</p><p>Short end</p>"
    expected = f"Title\n\n{text.strip()}\n\nShort end"
    for page in (f"<div>Site</div>{links}{body}{links}<div>Tags and terms</div>", f"<div>Site</div>{links}<article>{body}</article>{links}<div>Tags and terms</div>", f'<header class="entry-header"></header>{body}{links}<div>Imprint</div>'):
        assert html_extract.main_text(page) == expected
    assert html_extract.main_text(f"<header class='entry-header'><h1>Title</h1></header><p>{text}</p><p>Short end</p>") == expected
    assert html_extract.main_text(f"<article>Short</article>{links}<footer>{text}</footer>") == "Short"  # an article's own element needs no surge
    assert html_extract.main_text(f"<p>One</p>{links}<p>Two</p>") == "One\n\nTwo"  # nor does a page that has none


def test_html_broken_markup():
    main = html_extract.main_text
    assert main("<p title=don't>It is kept</p><p>So's this</p>") == "It is kept\n\nSo's this"
    assert main('<p title="a > b" data-x="class=ad">Kept</p>') == "Kept" and main("<p>a < b and 2<3</p>") == "a < b and 2<3"
    assert main("<p>Area <math><mi>x</mi><mo>+</mo><mn>1</mn></math> holds</p>") == "Area x+1 holds"
    assert main("<p>a&#" + "9" * 5000 + ";b &#65;&#x42;</p>") == "a\ufffdb AB" and main("<p>Text</p><div class=") == "Text"
    start = time.time()
    for page in ("<" + "a" * 400_000, "<a " * 150_000, "<div>" * 100_000 + "x", '<div class="ad">' * 50_000 + "x", "<div class=ad><article>x" * 30_000, '<p a="' * 80_000, "<p a='" * 80_001):
        main(page)
    assert time.time() - start < 20


def test_ppm_is_a_distribution():
    rng = random.Random(1)
    train = [prose(rng, 40).encode() for _ in range(30)]
    keys, counts = np.unique(ppm.pack(train)[0], return_counts=True)
    for context in (b"the", b"", b"\xff\xff\xff\xff\xff", b"ing of"):
        last = ppm.pack([context])[0][-1] >> ppm.BITS << ppm.BITS
        asked = np.union1d(keys, last + np.arange(ppm.SYMBOLS))
        n = np.zeros(len(asked), dtype=np.int64)
        n[np.searchsorted(asked, keys)] = counts
        logp = ppm.code_lengths(asked, n, ppm.low_orders(asked, n))
        assert abs((10 ** logp[np.searchsorted(asked, last + np.arange(ppm.SYMBOLS))]).sum() - 1) < 1e-9


def ppm_brute(train, text, order=ppm.ORDER):
    """log10 probability of a text, context by context."""
    counts = defaultdict(Counter)
    for t in train:
        s = [0] * order + [b + 1 for b in t] + [0]
        for i in range(order, len(s)):
            for j in range(order + 1):
                counts[tuple(s[i - j : i])][s[i]] += 1
    total, s = 0.0, [0] * order + [b + 1 for b in text] + [0]
    for i in range(order, len(s)):
        out = set()
        for j in range(order, -1, -1):
            own = {k: v for k, v in counts[tuple(s[i - j : i])].items() if k not in out}
            rest = sum(own.values())
            if s[i] in own:
                total += np.log10((own[s[i]] - 0.5) / rest)
                break
            if rest:
                total += np.log10(len(own) / 2 / rest)
            out |= set(own)
        else:
            total -= np.log10(ppm.SYMBOLS - len(out))
    return total


@pytest.mark.parametrize("low_bound, heavy", [(4_000_000, 3), (0, 0.1)])
def test_lm_scores(spark, low_bound, heavy, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAVY", heavy)
    rows = corpus(6, 50)
    got = {r["doc_id"]: r for r in lm_score.score_texts(frame(spark, rows), block_bytes=4000, low_bound=low_bound).collect()}
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    norm = {i: (t or "").encode().translate(LOWER_BYTES) for i, t in rows}
    train = Counter()
    for i, b in norm.items():
        if i not in held:
            train.update([*b.split(), b" "])
    n, v = sum(train.values()), len(train)
    assert len(got) == len(rows)
    for i, b in norm.items():
        r, tokens = got[i], [*b.split(), b" "]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(tokens), sum(train[t] > 0 for t in tokens), n)
        assert abs(r["base_score"] - sum(np.log10((train[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)) < 1e-6
        if len(b) < 3000:
            assert abs(r["score"] - ppm_brute([norm[k] for k in norm if k not in held], b)) < 1e-6, i


def test_toxicity(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        w = prose(rng, rng.randint(10, 120)).split()
        if toxic:
            for bad in ("moron", "Scum!"):
                w.insert(rng.randint(0, len(w)), bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic), 7))
    rows += [(900, None), (901, ""), (None, "moron scum")]
    labels += [(900, None, 1), (None, 1, 1)]
    docs = frame(spark, rows)
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert held and sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) >= 0.95 * len(held)
    assert toxicity.remove_toxic(docs, model).count() == sum(r["predicted"] == 0 for r in got)
    empty = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(docs, empty).count() == len(rows)


def test_toxicity_with_few_labels(spark):
    rng = random.Random(4)
    rows = [(i, " ".join([prose(rng, 40), *(["moron", prose(rng, 30), "scum"] if i % 8 == 0 else [])])) for i in range(400)]
    docs = frame(spark, rows)
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(48)], "doc_id long, toxic int"))
    assert len(model.at) and (model.weights > 0).any()
    got = [(r["doc_id"] % 8 == 0, r["predicted"]) for r in toxicity.score_toxicity(docs, model).collect() if r["doc_id"] >= 48]
    assert sum(p for toxic, p in got if toxic) >= 0.9 * sum(toxic for toxic, _ in got) and sum(p for toxic, p in got if not toxic) <= 0.05 * len(got)


def test_warc(spark, tmp_path):
    html = ["<p>a</p>", "<p>é\r\n\r\nWARC/1.1</p>", None, "", "<p>a</p>", "x" * 50_000]
    rows = [(i + 1, f"http://www.Ex{i % 2}.org/P?q={i}", h) for i, h in enumerate(html)] + [(9, None, "<p>a</p>"), (None, "http://z/", "<p>a</p>")]
    got = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first.setdefault(h or "", i)
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for i, u, h in rows:
        data, r = (h or "").encode(), by[i]
        revisit = first.get(h or "", i) != i
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r["record_type"], r["refers_to"], r["url"]) == ("revisit" if revisit else "response", first[h or ""] if revisit else None, u)
    keys = [(r["urlkey"], r["timestamp"]) for r in got]
    assert keys == sorted(keys) and by[1]["urlkey"] == "org,ex0)/p?q=0"
    assert warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_loser_tree():
    rng = random.Random(4)
    for k in range(1, 9):
        runs = [sorted((rng.randint(0, 50), i) for _ in range(rng.randint(0, 20))) for i in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_packing(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rows = corpus(7, 40) + [(500, "a <|endoftext|> b"), (None, "null id")]
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    for ranks in (None, public_tokenizers.path("byte_bpe_50k.tiktoken")):
        pieces = packing.pack(frame(spark, rows).repartition(3), path, ranks, window=128, most_open=4).collect()
        per, seq = defaultdict(list), defaultdict(list)
        for p in pieces:
            own = ids[p["doc_id"]]
            cut = np.array(own[p["start"] : p["start"] + p["length"]], dtype="<u4")
            assert len(cut) == p["length"] > 0 and zlib.crc32(cut.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(own)
            per[p["doc_id"]].append((p["start"], p["length"]))
            seq[p["sequence_id"]].append((p["offset"], p["length"]))
        for spans, size in [(sorted(per[i]), len(x)) for i, x in ids.items()] + [(sorted(s), None) for s in seq.values()]:
            at = 0
            for start, n in spans:
                assert start == at
                at += n
            assert at == size if size else at <= 128
        assert sum(128 - sum(n for _, n in s) for s in seq.values()) < 0.1 * sum(map(len, ids.values()))


def test_secrets(spark):
    sha = hashlib.sha1(b"x").hexdigest()
    key = base64.b64encode(hashlib.sha256(b"y").digest()).decode()
    rows = [
        (1, f'Some text token = "{sha}" and more'), (2, f"see commit {sha} for the change"), (3, "nothing /usr/lib/module1/index0/file2.html here"),
        (4, f"aws AKIA{'ABCDEFGHIJ234567'} end; api_key={key}"), (5, None), (6, ""), (7, f'é🎉 token = "{sha}" x token = "{sha}"'),
    ]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(frame(spark, rows).withColumn("redacted", F.lit(1))).collect()}
    assert got[1]["redacted"] == 'Some text token = "[SECRET]" and more'
    assert [got[i]["n_secrets"] for i in range(1, 8)] == [1, 0, 0, 2, 0, 0, 2]
    assert got[4]["redacted"] == "aws [SECRET] end; api_key=[SECRET]"
    assert got[5]["redacted"] is None and got[6]["redacted"] == "" and got[7]["redacted"].count("[SECRET]") == 2
    text = rows[6][1]
    assert all(text[s["start"] : s["start"] + s["length"]] == sha for s in got[7]["secrets"])


def planted(rng):
    """(text with {} for the secret, secret) and texts without one, made by other rules than the module's findings."""
    alnum = string.ascii_letters + string.digits

    def run(n, alphabet=alnum):
        return "".join(rng.choice(alphabet) for _ in range(n))

    def password():
        return rng.choice(["Summer", "Kx", "hunter", "Wm"]) + run(rng.randint(3, 8)) + rng.choice("!&#*") + run(2, string.digits)

    forms = [
        ("SECRET_KEY='{}'", run(50)), ("export GITHUB_TOKEN={}", "gho_" + run(36)), ('{{"apiKey": "{}", "region": "eu"}}', run(32)), ("db:\n  user: app\n  password: {}\n", password()),
        ('conn = connect(host="db", password="{}")', password()), ("jdbc via mysql://report:{}@10.0.0.7:3306/sales", run(14)), ("curl -H 'Authorization: Bearer {}'", run(40)),
        ("git clone https://{}@gitlab.example.net/a/b.git", "glpat-" + run(20)), ("aws_access_key_id = {}", "AKIA" + run(16, string.ascii_uppercase + "234567")), ("client-secret: {}", run(24)),
        ('PASSPHRASE="{}"', "".join(rng.sample(["lantern", "pepper", "violin", "meadow", "copper", "turtle"], 3))), ("redis://default:{}@cache:6379/0", password()),
    ]
    clean = [
        f"fixed in commit {run(40, '0123456789abcdef')} last week", f"id {run(8, '0123456789abcdef')}-{run(4, '0123456789abcdef')}-4{run(3, '0123456789abcdef')}-a{run(3, '0123456789abcdef')}-{run(12, '0123456789abcdef')} was seen",
        f"see /srv/app{rng.randint(1, 99)}/releases/v2/main-{rng.randint(1, 99)}.tar.gz for it", "The password: required, at least eight characters", "password=getpass.getpass()", "token: ${CI_JOB_TOKEN}",
        "api_key = os.environ['API_KEY']", f"at 2023-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T10:22:5{rng.randint(0, 9)}.123456 it began", f"www.shop{rng.randint(1, 99)}.com/catalog/item-{rng.randint(1000, 9999)}-blue", "password: ********",
        f"sha256 digest {run(64, '0123456789abcdef')} matches", "secret: nothing that we know of",
    ]
    return forms, clean


def test_secrets_planted_by_other_rules(spark):
    rng = random.Random(97)
    rows, wanted = [], {}
    for _ in range(40):
        forms, clean = planted(rng)
        for form, secret in forms:
            wanted[len(rows)] = secret
            rows.append((len(rows), f"{prose(rng, 12)} {form.format(secret)} {prose(rng, 12)}"))
        rows += [(len(rows) + i, f"{prose(rng, 12)} {c} {prose(rng, 12)}") for i, c in enumerate(clean)]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(frame(spark, rows)).collect()}
    missed = [rows[i][1] for i, s in wanted.items() if s in got[i]["redacted"]]
    wrong = [t for i, t in rows if i not in wanted and got[i]["redacted"] != t]
    print(f"recall {1 - len(missed) / len(wanted):.3f}, clean texts changed {len(wrong)} of {len(rows) - len(wanted)}", missed[:12], wrong[:12])
    assert len(missed) <= 0.1 * len(wanted) and len(wrong) <= 0.05 * (len(rows) - len(wanted))
    for i, text in rows:  # positions are those of the candidates
        left, at = [], 0
        for s in got[i]["secrets"]:
            left += [text[at : s["start"]], "[SECRET]"]
            at = s["start"] + s["length"]
        assert "".join([*left, text[at:]]) == got[i]["redacted"]


def test_secret_forms(spark):
    key = "KEYabc123KEYabc123x"
    rows = [
        (1, 'password = "correcthorsebatterystaple"', 'password = "[SECRET]"'), (2, "password: Tr0ub4dor&3xyz!!", "password: [SECRET]"), (3, "postgres://app:s3cr3tPassw0rdzz9@db/main", "postgres://app:[SECRET]@db/main"),
        (4, f'https://bot:{key}@github.com and token = "{key}"', 'https://bot:[SECRET]@github.com and token = "[SECRET]"'), (5, "password=os.environ['PW']", None), (6, "token: str = None", None),
        (7, "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,AB12\n\nMIIabc+/=\n-----END RSA PRIVATE KEY----- end", "[SECRET] end"), (8, " ".join(f'token = "{key}{i}"' for i in range(3000)), " ".join(['token = "[SECRET]"'] * 3000)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, expected string").withColumns({c: F.lit("own") for c in ("row", "found", "pieces", "judged", "path", "score")})
    for r in secrets.scan_secrets(docs).collect():
        assert r["redacted"] == (r["expected"] or r["text"]) and r["found"] == r["path"] == "own"
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_secret_forest_on_held_out_findings(spark):
    rows = secrets.labelled_findings(spark, 400)
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("value"), F.lit(5)))
    model = secrets.fit_secrets(rows.filter("fold > 0"))
    scored = rows.filter("fold = 0").withColumn("x", F.struct(*secrets._features(F.col("value"), F.col("before"), F.col("after"), F.col("path")))).withColumn("p", secrets.forest_score(model, F.col("x")))
    right = scored.filter((F.col("p") >= 0.5) == (F.col("label") == 1)).count()
    assert right >= 0.97 * scored.count()


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(11)
    sha = hashlib.sha1(b"z").hexdigest()
    item = prose(rng, 30)
    texts = [prose(rng, 80) for _ in range(60)]
    texts[0] += f' token = "{sha}"'
    texts[1] = "moron " + texts[1] + " scum moron"
    texts[2] = texts[3]
    texts[4] = texts[4] + " " + item
    toxic = {1, *range(20, 40)}
    rows = [(i, t if i not in toxic or i == 1 else "moron " + t + " scum", "en", "s", len(t)) for i, t in enumerate(texts)] + [(70, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
    left = {r["doc_id"]: r for r in docs.collect()}
    assert set(left) == set(range(60)) - toxic - {3, 4} | {70}
    assert sha not in left[0]["text"] and left[0]["n_chars"] == len(left[0]["text"])
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()} == set(left)


BIG = 2**53


def test_ids_above_double_precision_beside_nulls(spark):
    pytest.importorskip("public_tokenizers")
    ids = [BIG + 1, None, BIG + 3, BIG + 5]
    docs = spark.createDataFrame([(i, f"some words of text number {k}") for k, i in enumerate(ids)], DDL).coalesce(1)
    pages = docs.selectExpr("doc_id AS page_id", "'http://a/' AS url", "concat('<p>', text, '</p>') AS html")
    vectors = docs.selectExpr("doc_id AS vec_id", "transform(sequence(1, 4), i -> CAST(hash(text, i) AS double)) AS embedding")
    labels = spark.createDataFrame([(BIG + 1, 1), (BIG + 3, 0)], "doc_id long, toxic int")
    found = {
        "op1": html_extract.extract_main_text(pages), "op2": decontaminate.contamination(docs, spark.createDataFrame([(1, "some words")], "item_id long, text string")), "op3": lm_score.score_texts(docs),
        "op4": toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)), "op5": substring_dedup.remove_repeats(docs), "op6": embedding_dedup.near_vectors(vectors),
        "op7": minhash.near_duplicates(docs, 2), "op8": warc.archive_pages(pages), "op9": packing.pack(docs, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"), "op10": secrets.scan_secrets(docs),
    }
    for op, df in found.items():
        column = next(c for c in ("doc_id", "page_id", "vec_id") if c in df.columns)
        assert {r[column] for r in df.collect()} == set(ids), op
        assert dict(df.dtypes)[column] == "bigint", op


def test_warc_revisits_of_large_ids(spark):
    rows = [(BIG + 1, "http://a/1", "<p>a</p>"), (BIG + 3, "http://a/2", "<p>a</p>"), (BIG + 5, "http://a/3", "<p>b</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    for bound in (200_000, 0):
        path = warc.scratch_path(spark, "warc-test")
        warc.write_archives(pages, path, archive=200, firsts_bound=bound)
        got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.capture_index(spark, path, merged=1).collect()}
        assert got == {BIG + 1: ("response", None), BIG + 3: ("revisit", BIG + 1), BIG + 5: ("response", None)}


def test_near_dedup_keeps_one_row_of_equal_texts(spark):
    a, b = "one two three four five six seven", "another text of its own with other words"
    rows = [(1, a), (5, a), (5, b), (1, a), (None, a), (None, b + " x y z"), (None, "only here " + a[:9]), (7, None), (7, None), (8, " ")]
    docs = frame(spark, rows).withColumns({"d": F.lit(1), "k": F.lit(2), "rep": F.lit(3), "component": F.lit(4), "stays": F.lit(False)})
    out = minhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got == Counter([(1, a), (5, b), (None, b + " x y z"), (None, "only here " + a[:9]), (7, None), (7, None), (8, " ")])
    assert minhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_stages_with_clashing_names_nulls_and_no_rows(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    from cedarlog.llm import stages

    d = str(tmp_path)
    item = prose(random.Random(2), 20)
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    sha = hashlib.sha1(b"q").hexdigest()
    rows = [(1, f'token = "{sha}" and more'), (2, None), (None, ""), (None, item), (3, "a clean text")]
    docs = frame(spark, rows).withColumns({c: F.lit(f"own {c}") for c in ("redacted", "secrets", "n_secrets", "n_found", "row", "__key", "__spans", "d", "hits", "n_hit")})
    for name, stage in stages.STAGES:
        out = stage(spark, docs, d)
        assert stage(spark, docs.limit(0), d).count() == 0
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {1, 2, 3, None}
            continue
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r[c] == f"own {c}" for r in got for c in ("redacted", "secrets", "__key", "__spans")), name
        texts = Counter(r["text"] for r in got)
        if name == "decontaminate":
            assert texts == Counter([t for _, t in rows if t != item])
        if name == "secrets":
            assert texts == Counter(['token = "[SECRET]" and more', None, "", item, "a clean text"])
