"""Code compression, divergence of sources and main text of pages, against plain versions."""

import hashlib
import html
import math
import os
import re
import subprocess
import sys
import time
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from circuitlens.llm import code_compression, divergence, html_extraction
from circuitlens.llm.html_blocks import blocks

# --- code compression


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """Lloyd rounds in plain integers over (id, vector, label)."""
    kept = [(k, [math.floor(256 * x) for x in v], g) for k, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for _, v, _ in kept]
    books = [[cut[e][p] for e in range(min(entries, len(kept)))] for p in range(parts)]

    def nearest(part, p):
        far = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in books[p]]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for c in cut:
                held[nearest(c[p], p)[0]].append(c[p])
            books[p] = [[sum(x) // len(held[e]) for x in zip(*held[e])] if e in held else entry for e, entry in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    found = [[nearest(c[p], p) for p in range(parts)] for c in cut]
    errors = [sum(e for _, e in f) for f in found]
    labels = Counter()
    for (_, _, g), e in zip(kept, errors):
        labels[g] += e
    return Counter((k, "".join(f"{c:02x}" for c, _ in f), e, labels[g], digest) for (k, _, g), f, e in zip(kept, found, errors))


def found_codes(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS vec", "'x' AS code", "0 AS error")
    columns = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return Counter(tuple(r[c] for c in columns) for r in code_compression.compress(df, **options).collect())


@pytest.mark.parametrize("spread", [0.01, 0.3, 40.0])
def test_codes_with_ties_copies_and_odd_rows(spark, spread):
    rg = np.random.default_rng(3)
    rows = [(k, [float(np.float32(x)) for x in rg.normal(0, spread, 32)], [None, 1, 2][k % 3]) for k in range(300, 40, -1)]
    rows += [rows[5]] * 30 + [(k, rows[7][1], 7) for k in range(90)]
    rows += [(1, None, 1), (2, [None] + [0.0] * 31, 1), (3, [math.nan] * 32, 1), (4, [math.inf] * 32, 2), (None, [0.5] * 32, None), (7, [], 1), (8, [1.0] * 16, 1)]
    want = plain_codes([r for r in rows if r[1] is None or len(r[1]) == 32])
    assert found_codes(spark, rows) == want


def test_codes_of_few_vectors_and_of_none(spark):
    few = [(k, [k / 7 - 1.0] * 16, 1) for k in range(3)]
    assert found_codes(spark, few) == plain_codes(few)
    assert found_codes(spark, [(1, None, 1)]) == Counter() == found_codes(spark, [])
    with pytest.raises(ValueError, match="equal parts"):
        found_codes(spark, [(1, [1.0] * 17, 1)])
    huge = [(9, [1e30] * 16, 1)]
    assert found_codes(spark, few + huge) == plain_codes(few)


def test_whole_nodes_take_their_sums(spark):
    rg = np.random.default_rng(4)
    centres = rg.integers(-900, 900, (8, 4))
    points = np.concatenate([c + rg.integers(-3, 4, (600, 4)) for c in centres])
    order = code_compression._tree(points)
    codes, whole, counts, sums = code_compression.assign(points[order], code_compression._bounds(len(points)), code_compression.Entries(centres))
    want = ((points[order][:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (codes == want).all() and (counts == np.bincount(want, minlength=len(counts))).all()
    assert all((sums[e] == points[order][want == e].sum(axis=0)).all() for e in range(8))
    assert whole.sum() > 0.9 * len(points)  # clusters far apart are assigned without a look at their points


# --- divergence of sources


def plain_divergence(rows, top=200, min_docs=3):
    """(lang, source, part, item, value, rank) of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    small = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [[w.translate(small) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)] for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, groups = Counter(), defaultdict(Counter)
        for w, (_, g, source) in zip(words, rows):
            if g == lang:
                docs.update(set(w))
                groups[source].update(w)
        kept = sorted(t for t, n in docs.items() if n >= min_docs)
        whole = sum(groups.values(), Counter())

        def shares(c):
            size = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (size + len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return Counter(out)


def found_divergence(spark, rows, **options):
    df = spark.createDataFrame(rows, "text string, lang string, source string").selectExpr("*", "1 AS term", "2 AS digest", "'x' AS part")
    found = divergence.divergence(df, **options)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    return Counter(map(tuple, found.collect()))


def odd_documents():
    rg = np.random.default_rng(5)
    words = ["The", "the", "É", "é", "Straße", "日本", "a", "b-c", "x_y", "İ", "q" * 300, "don't", "9to5"]
    rows = [(" ".join(rg.choice(words, rg.integers(0, 30))), ["en", "de", None, "xx"][k % 4], ["s0", "s1", "", None, "S1"][int(rg.integers(5))]) for k in range(120)]
    rows += [rows[0]] * 7 + [(None, "en", "s0"), ("", "fr", "s0"), ("only once", "fr", "s1"), ("1 2 3", "it", "s"), ("one two " * 3000 + "end", "en", "s7"), ("\x00A\x7fB\x80", "en", "s0")]
    return rows


@pytest.mark.parametrize("options", [{}, {"top": 2, "block_bytes": 200}, {"bits": 3, "block_bytes": 1000}, {"bits": 0}, {"min_docs": 1}])
def test_divergence_with_odd_rows_pieces_and_equal_digests(spark, options):
    rows = odd_documents()
    want = plain_divergence(rows, options.get("top", 200), options.get("min_docs", 3))
    assert found_divergence(spark, rows, **options) == want


def test_divergence_of_nothing_and_of_one_source(spark):
    assert found_divergence(spark, []) == Counter()
    assert found_divergence(spark, [(None, None, None)]) == Counter()
    assert found_divergence(spark, [("a b", "en", "x")] * 5) == Counter()
    assert found_divergence(spark, [("", "en", "x"), ("", "en", "y")]) == Counter({("en", "x", "pair", "y", 0, 1): 1, ("en", "y", "pair", "x", 0, 1): 1})


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 1), (1, 3), (7, 7), (10**12 + 7, 3 * 10**12 + 11), (9 * 10**15 - 1, 9 * 10**15), (123_456_789_012, 999_999_999_999_989)]
    df = spark.createDataFrame(cases, "c bigint, t bigint")
    want = [1 + 10**9 * c // t for c, t in cases]
    assert [r[0] for r in df.select(divergence._share(df.c, df.t)).collect()] == want
    assert divergence._shares(np.array([c for c, _ in cases]), np.array([t for _, t in cases])).tolist() == want


def test_rows_of_a_hot_source_are_counted_before_the_shuffle(spark):
    rows = [("the cat sat on the mat", "en", "hot")] * 900 + [("the dog", "en", f"s{k}") for k in range(100)]
    assert found_divergence(spark, rows) == plain_divergence(rows)


# --- main text of pages

P = "Long paragraphs of an article hold many words, and few of them are links to other pages of a site, so that they stand out among the rest of it. "
PAGES = {
    "named": ('<body><header><a href="/">Site</a> motto</header><div class="newsletter">Join our list of happy readers today</div><article><h1>Title</h1><p>' + P + "</p><p>Short.</p><p>" + P + '</p><div class="sponsored">Buy shoes now, they are cheap</div><p>End.</p></article><section id="reader-comments"><p>' + P + "</p></section><aside>" + P + "</aside><footer>Imprint</footer>", ["Title", P, "Short.", P, "End."]),
    "bare": ('<div><a href="/">Home</a> <a href="/x">News</a></div><div><h1>A title</h1><p>' + P * 3 + "</p><p>" + P + '</p></div><div><a href="/i">Imprint</a> | <a href="/c">Contact</a></div>', ["A title", P * 3, P]),
    "wrapped in a form": ('<form id="f"><div class="menu"><a href="/">A</a></div><div class="content"><h2>T</h2><p>' + P + '</p><ul><li>One</li><li>Two</li></ul></div><div class="cookie-banner">We use cookies</div></form>', ["T", P, "One", "Two"]),
    "short": ('<nav><a href="/">A</a></nav><div class="ad">Seven words that sell you some thing</div><article><h1>Hi</h1><p><b>Hi you<br></article><footer>&copy; x &middot; many words of a footer that go on and on</footer>', ["Hi", "Hi you"]),
    "references": ("<main><p>a &lt;b&gt; &amp;amp; &eacute;&#8364;&#x41; &am &amp x&nbsp;y\n\t z</p><script>var a = '</p><p>no';</script><style>p{}</style><p>" + P + "</p><noscript>no</noscript><textarea>no</textarea></main>", ["a <b> &amp; é€A &am & x y z", P]),
    "nothing": ("", []), "markup only": ("<html><head><title>T</title></head><body><script>x</script></body></html>", []), "a menu only": ('<nav><ul><li><a href="/">A</a></li></ul></nav>', []),
}


@pytest.fixture(scope="module")
def tree(spark):
    return html_extraction.train(spark)


def test_pages_that_the_tree_was_not_trained_on(spark, tree):
    rows = [(k, "u", page) for k, (page, _) in enumerate(PAGES.values())]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS id", "'x' AS text", "2 AS blocks", "0 AS n_chars")
    found = {r.page_id: (r.text, r.n_chars) for r in html_extraction.extract(df, tree).collect()}
    for k, (name, (_, want)) in enumerate(PAGES.items()):
        text = "\n\n".join(" ".join(x.split()) for x in want)
        assert found[k] == (text, len(text)), name


def test_every_article_of_the_table_is_found(spark, tree):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in html_extraction.extract(pages, tree).collect()}
    assert len(found) == pages.count()
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article))
        assert found[r.page_id].text == "\n\n".join(x for x in parts if x) and found[r.page_id].url == r.url


def test_labelled_pages_are_learnt(spark, tree):
    pages = html_extraction.labelled()
    found = html_extraction.extract(spark.createDataFrame([(k, "", p) for k, (p, _) in enumerate(pages)], "page_id bigint, url string, html string"), tree).collect()
    want = {k: "\n\n".join(b.text for b, keep in zip(blocks(p), kept) if keep) for k, (p, kept) in enumerate(pages)}
    assert sum(want[r.page_id] == r.text for r in found) > 0.9 * len(pages)


def test_null_pages_ids_and_urls_and_repeated_rows(spark, tree):
    rows = [(None, None, None), (1, None, None), (1, "u", "<p>" + P), (1, "u", "<p>" + P), (2, "v", " \n ")]
    found = html_extraction.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), tree).collect()
    assert Counter((r.page_id, r.url, r.text) for r in found) == Counter([(None, None, ""), (1, None, ""), (1, "u", P.strip()), (1, "u", P.strip()), (2, "v", "")])
    assert html_extraction.extract(spark.createDataFrame([], "page_id bigint, url string, html string"), tree).count() == 0


@pytest.mark.parametrize("piece", ["<div>", "</div>", "<a href='", "<p ='>' ", "<", "<!--", "&am", "<a b=\"", "<script>", "<svg>", "<li><p>x", "<td></div>", "x<br>", "<p class=\"ad\">y", "<a =\"b", "</", "<a '>"])
def test_hostile_pages_take_linear_time(piece):
    start = time.time()
    blocks(piece * (600_000 // len(piece)))
    assert time.time() - start < 8


def test_tags_that_are_not_closed_or_misplaced():
    def texts(page):
        return [b.text for b in blocks(page)]

    assert texts("a<b>c</b>d<p>e</div>f<ul><li>g<li>h</ul>i</p>j") == ["acd", "ef", "g", "h", "i", "j"]
    assert texts("<p>1 < 2 <3> x</p><a title='>'>y</a>") == ["1 < 2 <3> x", "y"]
    assert texts("<p>x<!-- <p>no --> y<!doctype z><?php no ?>") == ["x y"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert [b.linked for b in blocks("<p><a href=x>one two<p>three</p><p><a name=y>four</a>")] == [2, 0, 0]
    assert texts("x<script>y") == ["x"] and texts("x<svg>y") == ["xy"] and texts("<SCRIPT>a</Script >b") == ["b"]


def test_oracles(spark):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    for sql, found in ((code_compression.ORACLE, code_compression.compress(spark.read.parquet(f"{folder}/embeddings.parquet"))), (divergence.ORACLE, divergence.divergence(spark.read.parquet(f"{folder}/documents.parquet")))):
        want = db.execute(sql)
        columns = [c[0] for c in want.description]
        assert Counter(map(tuple, found.select(*columns).collect())) == Counter(want.fetchall())


# --- licences and secrets in hostile texts


def found_licences(spark, texts):
    from circuitlens.llm import licenses

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    return {r.doc_id: r for r in licenses.license_scan(df).collect()}


def test_long_sequences_of_known_sentences(spark):
    from circuitlens.llm import licenses

    head = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    known = list(licenses.SENTENCES.values())
    rg = np.random.default_rng(7)
    texts = [head + "All rights reserved.\n" * 3000, head + "All rights reserved.\n" * 100_000, "\n".join(known[k] + "." for k in rg.integers(0, len(known), 20_000)), "license " + "." * 300_000 + "x", head + "Neither the name of " + "a" * 5000 + " nor the names of x\n"]
    start = time.time()
    found = found_licences(spark, texts)
    assert time.time() - start < 60 and found[1].n_sentences >= 100_000
    for k, text in enumerate(texts[:3]):  # the rules by a plain walk over the identifiers of the lines
        ids = found[k].sentence_ids.split(",")
        met = []
        for licence, names in licenses.RULES:
            rest = iter(ids)
            met.append(all(n in rest for n in names))
        wider = licenses._wider()
        named = [licence for i, (licence, _) in enumerate(licenses.RULES) if met[i] and not any(met[j] for j in wider[i])]
        named = list(dict.fromkeys(named))
        named = [n for n in named if n != "proprietary"] if len(named) > 1 else named
        assert set(named) <= set(found[k].licenses.split(",")) if named else True


@pytest.mark.parametrize("shape", ["- apassword_x: b\n", "key:[", '{"key":[', "a=(", "key: {x: [", "- - - a: b\n", "; a\n", "f(password=["])
def test_secrets_in_hostile_texts_take_linear_time(shape):
    from circuitlens.llm import lexing, secrets

    start = time.time()
    lexing.pairs(shape * (1_000_000 // len(shape)))
    secrets.literals(("password=" + shape) * (300_000 // len(shape)))
    assert time.time() - start < 30


def test_secrets_inside_nested_values():
    from circuitlens.llm import secrets

    key = "xK9vLq2mZ8tR4wYp"
    for text in (f'password = load(default="{key}")', f'{{"secret": [{{"name": "{key}"}}]}}', f'credentials = [[{{a: [{{b: "{key}"}}]}}]]', f'opts = dict(a=[1, {{"x": 2}}], password="{key}")', f'token = (\n  first(x="a b"),\n  "{key}")', f'k = ["{key}"]\npassword = f(y=k[0])'):
        assert [text[a:b] for a, b in secrets.literals(text)] in ([key], []) and (key in [text[a:b] for a, b in secrets.literals(text)] or text.startswith("k = [")), text


def test_proving_whole_tokens_takes_little_memory_however_often():
    code = "import psutil, public_tokenizers\nfrom circuitlens.llm.token_counts import whole_tokens\np, path = psutil.Process(), public_tokenizers.path('byte_bpe_50k.json')\nstart = p.memory_info().rss\nfor _ in range(3):\n    assert len(whole_tokens(path)) > 40_000\nprint((p.memory_info().rss - start) / 1e6)"
    root = Path(__file__).resolve().parents[2]
    out = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, check=True)
    assert float(out.stdout) < 100
