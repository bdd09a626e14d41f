"""Embeddings, URLs, mixtures, components and the pipeline."""

import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from circuitlens.llm import bpe, catalog, embeddings, mixing, quality_rules, secrets, simhash, url_filter
from circuitlens.llm.components import components


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, name):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    found = catalog.queries()[name](spark, folder)
    assert sorted(found.columns) == sorted(columns)
    assert Counter(map(str, map(tuple, found.select(*columns).collect()))) == Counter(map(str, want.fetchall()))


def test_components_of_chains_stars_and_odd_links(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 7), (None, 3), (900, 901), (901, 900)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(found[k] == 100 for k in range(100, 161)) and all(found[k] == 500 for k in range(500, 560))
    assert found[901] == 900 and 7 not in found and 3 not in found
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_url_of_great_length_and_one_ending(spark):
    import time

    urls = [f"http://h{k}.org/p{k}/index.html" for k in range(300)] + ["http://q.com/" + "a/b-İ" * 60_000, "http://x.net/es/" + "😀" * 500, "http://😀.org/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    start = time.time()
    rows = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert len(rows) == len(urls) and time.time() - start < 120
    assert len(rows[300].path) == 300_001 and rows[302].score is not None


def vectors():
    rg, rows = np.random.default_rng(1), []
    for label in (1, 2, None):
        centres = rg.normal(size=(12, 24))
        for _ in range(80):
            v = centres[rg.integers(12)] + rg.normal(size=24) * rg.choice([0.1, 0.2, 0.3])
            rows.append(([float(np.float32(x)) for x in v], label))
    rows += [(rows[3][0], 1)] * 20 + [(None, 1), ([0.0] * 24, 1), ([math.nan] + [1.0] * 23, 1), ([math.inf] + [1.0] * 23, 1), ([None] + [1.0] * 23, 1), ([1.0] * 5, 1), ([2.0] * 5, 1), ([], 1)]
    return [(k, v, g) for k, (v, g) in enumerate(rows)]


@pytest.mark.parametrize("tile", [2048, 16])
def test_embeddings_against_all_pairs(spark, tile):
    rows = vectors()
    usable = [g is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, g in rows]
    count, group = [0] * len(rows), list(range(len(rows)))
    links = [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and usable[i] and usable[j] and a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / math.sqrt(np.dot(a[1], a[1]) * np.dot(b[1], b[1])) >= 0.93]
    for i, _ in links:
        count[i] += 1
    for _ in range(30):
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, dim string, cell int")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, tile=tile).collect()}
    assert found == {k: (count[k], group[k], group[k] == k) for k in range(len(rows))}


def test_embeddings_of_no_rows(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_url_rules_and_odd_urls(spark):
    urls = ["http://A.com/x", "https://www.example.com/en/1", "http://m.example.com/en/1", "http://example.com/fr/", "http://x.net/es/1?q", "net/es/", None, "", "http://com/", "http://evil.netcom/", "http://x.com", "http://x.com#a/b", "http://x.org/é/ü", "HTTP://M.NET/fr/#z"]
    df = spark.createDataFrame([(None if k == 8 else k, u, "t", "h", 1.0) for k, u in enumerate(urls)] * 2, "page_id bigint, url string, text string, host string, score double")
    rows = url_filter.judge_urls(df).collect()
    assert len(rows) == 2 * len(urls)
    got = {r.page_id: (r.host, r.path, r.rule) for r in rows}
    want = {0: ("a.com", "/x", "com/"), 1: ("www.example.com", "/en/1", "www.example.com/en/"), 2: ("m.example.com", "/en/1", "example.com/en/"), 3: ("example.com", "/fr/", "com/"), 4: ("x.net", "/es/1", "net/es/"), 5: ("", "", None), 6: ("", "", None), 9: ("evil.netcom", "/", None), 10: ("x.com", "", None), 11: ("x.com", "", None), 12: ("x.org", "/é/ü", None), 13: ("m.net", "/fr/", "net/fr/")}
    assert {k: got[k] for k in want} == want
    assert all(r.verdict in ("allow", "block") and (r.score is None) == (r.rule is not None) for r in rows)
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_url_scores_against_a_plain_model(spark):
    rows = [(r.page_id, r.url) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url").collect()]
    found = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string")).collect()}
    texts = {r.host + r.path: r.verdict if r.rule else None for r in found.values()}
    import hashlib

    fold = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % 5
    pad = lambda t: "\x02" * 4 + t.lower() + "\x03"
    counts = [Counter(), Counter()]
    for text, verdict in texts.items():
        if verdict and fold(text):
            x = pad(text)
            counts[verdict == "allow"].update(x[i - k : i + 1] for i in range(4, len(x)) for k in range(5))
    totals, kinds = [Counter(), Counter()], [Counter(), Counter()]
    for label in (0, 1):
        for gram, n in counts[label].items():
            totals[label][gram[:-1]] += n
            kinds[label][gram[:-1]] += 1

    def score(text):
        x, s = pad(text), 0.0
        for i in range(4, len(x)):
            p = [1 / 256, 1 / 256]
            for label in (0, 1):
                for k in range(5):
                    gram = x[i - k : i + 1]
                    if c := totals[label][gram[:-1]]:
                        p[label] = (counts[label][gram] + kinds[label][gram[:-1]] * p[label]) / (c + kinds[label][gram[:-1]])
            s += math.log(p[1] / p[0])
        return s / (len(x) - 4)

    assert all(abs(r.score - score(r.host + r.path)) < 2e-6 for r in found.values() if r.rule is None)


TOKENIZER = mixing.Tokenizer(P.path("byte_bpe_50k.json"), P.PATTERN)


def test_mixture_reaches_its_targets(spark):
    from tokenizers import Tokenizer

    texts = ["word " * (1 + k % 50) for k in range(600)] + [None, "", "a | b " * 3000]
    rows = [(k, t, ("en", "de", "fr", None)[k % 7 % 4], f"s{k % 3 % 2}", 1.0, "x", 3, "y") for k, t in enumerate(texts)] + [(None, None, None, None, 2.0, "x", 3, "y")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, probability double, topic string, tokens int, __id string")
    out = mixing.mix(df, TOKENIZER).collect()
    library = Tokenizer.from_file(TOKENIZER.path)
    assert Counter((r.doc_id, r.tokens) for r in out) == Counter((r[0], max(1, len(library.encode(r[1] or "", add_special_tokens=False).ids))) for r in rows)
    total, expected = sum(r.tokens for r in out), sum(r.tokens * r.probability for r in out)
    assert abs(expected / total - mixing.KEEP) < 1e-3
    cells = defaultdict(set)
    for r in out:
        cells[r.source, r.lang, r.topic].add(r.probability)
    assert all(len(c) == 1 for c in cells.values())
    kept = mixing.sample(df, TOKENIZER)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in out if r.kept)
    assert all(r["__id"] == "y" and r.tokens == 3 for r in kept.collect())
    assert mixing.mix(df.limit(0), TOKENIZER).count() == 0 and mixing.sample(df.limit(0), TOKENIZER).count() == 0


CELLS = [(s, lang, t, 100 * (1 + i + 3 * j + k)) for i, s in enumerate("ab") for j, lang in enumerate(("en", "de")) for k, t in enumerate("xy")]
CELL_TYPE = "source string, lang string, topic string, tokens bigint"


def plain_raking(cells, targets):
    """Weights by a loop over cells, 5,000 rounds."""
    total, w = sum(c[3] for c in cells), [float(c[3]) for c in cells]
    for _ in range(5000):
        for d, dim in enumerate(("source", "lang", "topic")):
            share = Counter()
            for c in cells:
                share[c[d]] += c[3] / total
            raw = {v: x ** targets[dim] if isinstance(targets[dim], float) else targets[dim].get(v, x) for v, x in share.items()}
            have = Counter()
            for c, x in zip(cells, w):
                have[c[d]] += x
            w = [x * raw[c[d]] / sum(raw.values()) * total / have[c[d]] for c, x in zip(cells, w)]
    return w


@pytest.mark.parametrize("driver_cells", [1000, 0])
def test_raking_to_a_tolerance(spark, driver_cells):
    targets = {"source": 0.5, "lang": {"en": 0.9, "de": 0.1}, "topic": 1.0}
    sparse = [c for c in CELLS if c[:3] not in (("a", "en", "x"), ("b", "de", "y"))]  # such tables take many rounds
    for cells in (CELLS, sparse) if driver_cells else (CELLS,):  # a round in Spark takes a second
        rows = {(r.source, r.lang, r.topic): r for r in mixing.calibrate(spark.createDataFrame(cells, CELL_TYPE), targets, driver_cells=driver_cells, tolerance=1e-6, keep=0.05).collect()}
        for c, w in zip(cells, plain_raking(cells, targets)):
            assert math.isclose(rows[c[:3]].w, w, rel_tol=1e-4) and rows[c[:3]].marginal_error <= 1e-6
            assert abs(rows[c[:3]].probability - 0.05 * w / c[3]) < 1e-4
        assert abs(sum(r.w for r in rows.values() if r.lang == "en") / sum(c[3] for c in cells) - 0.9) < 1e-5


@pytest.mark.parametrize("driver_cells", [1000, 0])
def test_targets_that_cannot_be_met_are_reported(spark, driver_cells):
    cells = [("a", "en", "x", 100), ("b", "de", "y", 100)]  # the language follows the source
    with pytest.warns(UserWarning, match="can't be met"):
        rows = mixing.calibrate(spark.createDataFrame(cells, CELL_TYPE), {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.9, "de": 0.1}, "topic": 1.0}, max_rounds=6, driver_cells=driver_cells).collect()
    assert all(r.marginal_error > 0.1 for r in rows)


def test_raking_ends_when_it_stalls(spark):
    cells = spark.createDataFrame([("a", "en", "x", 100), ("b", "de", "y", 100)], CELL_TYPE)
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.9, "de": 0.1}, "topic": 1.0}
    with pytest.warns(UserWarning, match=f"after {mixing.STALL_ROUNDS + 1} rounds a marginal of lang"):
        mixing.calibrate(cells, targets)
    slow = [{"source": 1 / k, "lang": 0.5 / k, "topic": 0.0} for k in range(1, mixing.MAX_ROUNDS + 1)]  # as with sparse tables
    assert not any(mixing._settled(slow[:n], 1e-9) for n in range(1, len(slow), 97)) and mixing._settled(slow, 1 / 2000)



@pytest.mark.parametrize("driver_cells", [1000, 0])
def test_cells_that_are_used_up_count_whole(spark, driver_cells):
    rows = mixing.calibrate(spark.createDataFrame(CELLS, CELL_TYPE), {"source": 1.0, "lang": {"en": 0.95, "de": 0.05}, "topic": 1.0}, keep=0.6, driver_cells=driver_cells).collect()
    total = sum(r.tokens for r in rows)
    assert abs(sum(r.tokens * r.probability for r in rows) - 0.6 * total) < 1e-3 * total
    assert max(r.probability for r in rows) == 1.0 and rows[0].draw_error > 0.05
    scale = {round(r.probability * r.tokens / r.w, 4) for r in rows if r.probability < 1}
    assert len(scale) == 1 and all(r.w * max(scale) >= r.tokens * 0.999 for r in rows if r.probability == 1)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def plain_copies(texts):
    """The smallest key that each text reaches over near copies that meet at an anchor, by comparing the shingles of all pairs."""
    share = math.acos(1.6 / 1.8) / math.pi
    bits = 64 * simhash.CHECK_PRINTS
    limit = bits * share + simhash.ROOM[-1] * math.sqrt(bits * share * (1 - share))
    prints = {i: np.frombuffer(simhash.many_prints(t), "<u8") for i, t in texts.items()}
    halves = {i: p[: simhash.SEARCH_PRINTS].copy().view("<u4").astype(np.uint64) for i, p in prints.items()}
    homes = {i: [set(simhash.anchors(h[k : k + 1], 0)[1].tolist()) for k in range(len(h))] for i, h in halves.items()}
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [
        (i, j) for i in texts for j in texts
        if i < j and np.bitwise_count(prints[i][simhash.SEARCH_PRINTS :] ^ prints[j][simhash.SEARCH_PRINTS :]).sum() <= limit
        and any(a & b for a, b in zip(homes[i], homes[j])) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    ]
    group = {i: i for i in texts}
    for _ in range(6):
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    return group


def test_pipeline_on_odd_rows(spark):
    """Nulls, an empty table, repeated rows, a very long text and clashing columns go through all stages but the last."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, __removed string, __id string, row string, key string, name string"
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(1, good, "en", "s", 5, "a", "b", "c", "d", "e")] * 2 + [(None, good, None, None, None, "a", "b", "c", "d", "e"), (2, None, "en", "s", 1, None, "b", "c", "d", "e"), (3, "", None, "s", 0, "a", None, "c", "d", "e"), (4, " ".join(f"long{k * k}" for k in range(200_000)), "de", None, 1, "a", "b", None, "d", None)]
    df = spark.createDataFrame(rows, schema)
    kept = df
    for stage in (corpus_pipeline.rules, corpus_pipeline.near_dedup, corpus_pipeline.secret_scan, corpus_pipeline.mixture):
        kept = stage(spark, kept, "")
        assert kept.columns == df.columns
        if stage is corpus_pipeline.near_dedup:
            assert sorted(r.doc_id for r in kept.collect()) == [1, 4]
            assert {(r["__removed"], r["__id"]) for r in kept.collect()} == {("a", "b")}
        assert stage(spark, df.limit(0), "").count() == 0
    assert corpus_pipeline.tokenize(spark, df, "").count() == len(rows) and corpus_pipeline.tokenize(spark, df.limit(0), "").count() == 0


def test_pipeline_against_a_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    judged = {r.doc_id: r for r in quality_rules.quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    texts = {}
    for i, doc in docs.items():
        if judged[i].kept:
            gone = set(judged[i].removed)
            key = lambda line: quality_rules.measure(line)[5]
            texts[i] = "\n".join(x for x in doc.text.split("\n") if not (set(key(x)) & gone)) if gone else doc.text
    group = plain_copies(texts)
    kept = {i: secrets.hide(t) for i, t in texts.items() if group[i] == i}
    rows = spark.createDataFrame([(i, t, docs[i].lang, docs[i].source) for i, t in kept.items()], "doc_id bigint, text string, lang string, source string")
    drawn = {r.doc_id for r in mixing.mix(rows, TOKENIZER).collect() if r.kept}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    found = {r.doc_id: list(r.token_ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert found == {i: library.encode_ordinary(kept[i]) for i in drawn}


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        assert not out.where("n_chars <> length(text)").count() or stage in (corpus_pipeline.near_dedup, corpus_pipeline.mixture)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and re.match("quality", corpus_pipeline.STAGES[0][0])
