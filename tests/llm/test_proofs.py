"""Operators that SQL can't express against plain Python, and the cases that large inputs meet."""

import hashlib
import random
import re
import struct

import duckdb
import pandas as pd

from weftgraph.llm import bpe, decontam, exact_dedup, ngram_join, oracles, pii, quality, secret_scan, url_filter, warc

from .test_operators import docs


def _components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_ngram_join_against_sets_of_words(spark, monkeypatch):
    """Shingles as tuples of words, with a hot shingle that ranges of few rows cut several times."""
    monkeypatch.setattr(ngram_join, "LONG", 6)
    rnd = random.Random(3)
    hot = " ".join(f"h{k}" for k in range(8))
    base = [f"b{k}" for k in range(60)]
    texts = [(k, f"{hot} own{k} a{k} b{k} c{k}") for k in range(50)]
    for k in range(50, 110):
        ws = list(base)
        for _ in range(rnd.randrange(6)):
            ws[rnd.randrange(60)] = f"x{k}"
        texts.append((k, " ".join(ws)))
    texts += [(200, "ONE two\tthree"), (201, "one  two three"), (202, ""), (203, None)]

    def shingles(t):
        ws = re.findall(r"[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    sets = {i: shingles(t) for i, t in texts}
    close = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    want = _components(sorted(sets), lambda a, b: close(a, b))
    got = {r["__id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs(spark, texts)).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_bpe_digests_are_the_librarys(spark):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = [(1, "it's 12 cats\n\n  and more " * 3000), (2, None), (3, "x" * 50000), (4, "é <|endoftext|>\x00 \U0001f600")]
    enc = bpe.encoding(path, pattern)
    for r in bpe.round_trip(docs(spark, texts), path, pattern).collect():
        ids = enc.encode_ordinary(dict(texts)[r["__id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()


def test_pii_properties_on_random_texts(spark):
    """Mentions found by a detector of its own: each replaced, one surrogate an entity, none of the input's, formats kept."""
    rnd = random.Random(4)
    mail = lambda: f"u{rnd.randrange(30)}@d{rnd.randrange(4)}.org"
    phone = lambda: f"+1 {rnd.randrange(200, 220)}-555-{rnd.randrange(1000, 1010)}"
    ip = lambda: f"10.0.{rnd.randrange(3)}.{rnd.randrange(20)}"
    texts = [(k, " ".join(rnd.choice([mail, phone, ip, lambda: "word", lambda: "plain"])() + " ;" for _ in range(rnd.randrange(1, 30)))) for k in range(60)]
    texts += [(100 + k, "hot@one.org ;") for k in range(60)] + [(300, "z " * 100000 + "far@end.org ;")]
    found = re.compile(r"(?P<mail>\S+@\S+)|(?P<ip>\d+\.\d+\.\d+\.\d+)|(?P<phone>\+1 \d{3}-\d{3}-\d{4})")
    out = {r["doc_id"]: r for r in pii.replace(docs(spark, texts), "key").collect()}
    sub, real = {}, {m[0] for _, t in texts for m in found.finditer(t)}
    for i, t in texts:
        a, b = list(found.finditer(t)), list(found.finditer(out[i]["text"]))
        assert len(a) == len(b) == out[i]["__pii_n"] and found.sub("#", t) == found.sub("#", out[i]["text"])
        for x, y in zip(a, b, strict=True):
            assert x.lastgroup == y.lastgroup and sub.setdefault(x[0], y[0]) == y[0] and y[0] not in real
            assert x.lastgroup != "phone" or re.sub(r"\d", "0", x[0]) == re.sub(r"\d", "0", y[0])
    assert len(set(sub.values())) == len(sub)
    assert {(r["__text"], r["component_id"]) for r in out.values()} == {("y", 7)}


def test_quality_verdict_is_the_threshold(spark):
    import math

    rnd = random.Random(6)
    words = "the of and cat house river small green walks over under".split()
    texts = [(k, " ".join(rnd.choice(words) for _ in range(40))) for k in range(120)]
    texts += [(500, "xq zzkv qqj wvx " * 20), (501, "xq"), (502, None), (502, "xq zzkv qqj wvx " * 20)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(120)], "doc_id long, quality int, toxic int")
    d = docs(spark, texts)
    out = quality.classify(d, labels, train_rows=40).collect()
    assert len(out) == len(texts)
    sample = {r["doc_id"] for r in labels.selectExpr("doc_id", "xxhash64(doc_id, 1) AS h", "pmod(xxhash64(doc_id), 2) AS half").where("half = 0").orderBy("h", "doc_id").limit(40).collect()}
    logs = sorted(math.log(r["perplexity"]) for r in out if r["__id"] < 120 and r["__id"] not in sample)
    at = lambda q: logs[max(0, math.ceil(q * len(logs)) - 1)]
    mid, top = at(0.5), at(quality.QUANTILE) + quality.WIDEN * (at(quality.QUANTILE) - at(0.5))
    for r in out:
        if r["perplexity"] is None:
            assert r["threshold"] is None and not r["rejected"]
            continue
        bound = math.exp(mid + (top - mid) * (r["n_chars"] + quality.PRIOR_CHARS) / r["n_chars"])
        assert abs(r["threshold"] / bound - 1) < 1e-6 and r["rejected"] == (r["perplexity"] > r["threshold"])
    assert all(r["rejected"] for r in out if r["__id"] >= 500 and r["n_chars"] > 100)
    assert {r["doc_id"] for r in quality.keep_good(d, labels, train_rows=40).collect()} >= set(range(100)) - {r["__id"] for r in out if r["rejected"]}


def test_exact_dedup_asks_full_hashes_of_survivors_only(spark):
    long = "p" * exact_dedup.PREFIX
    texts = [(1, "abc"), (2, "abd"), (3, "ab cd"), (4, long + "x"), (5, long + "y"), (6, long + " x"), (7, long + "x"), (7, long + "y")]
    got = sorted((r["__id"], r["keep_id"], r["kept"], r["text_sha256"] is not None) for r in exact_dedup.exact_dedup(docs(spark, texts), digest_all=False).collect())
    assert got == [(1, 1, True, False), (2, 2, True, False), (3, 3, True, False), (4, 6, False, True), (5, 5, True, True), (6, 6, True, True), (7, 5, False, True), (7, 6, False, True)]
    assert sorted(r["doc_id"] for r in exact_dedup.drop_duplicates(docs(spark, texts)).collect()) == [1, 2, 3, 5, 6]
    # one id with two texts under one key, of which one goes
    two = [(1, long + "x"), (2, long + "x"), (2, long + "y")]
    assert sorted((r["doc_id"], r["text"][-1]) for r in exact_dedup.drop_duplicates(docs(spark, two)).collect()) == [(1, "x"), (2, "y")]


def test_decontam_cuts_long_items_and_keeps_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PIECE_WORDS", 5)
    item = [f"w{k}" for k in range(60)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "w3 w4")], "item_id long, text string")
    d = docs(spark, [(1, " ".join(item[9:40])), (2, " ".join(item[50:62])), (3, "w3, w4"), (4, None)]).withColumnRenamed("spans", "__decon_items")
    for size in (1 << 20, 30):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        got = {r["doc_id"]: (r["__decon_n_hit"], r["__decon_n_items"]) for r in decontam.annotate(d, bench).collect()}
        assert got == {1: (31, 1), 2: (0, 0), 3: (2, 1), 4: (0, 0)}
        left = decontam.decontaminate(d, bench)
        assert left.columns == d.columns and sorted((r["doc_id"], r["__decon_items"]) for r in left.collect()) == [(2, "x"), (4, "x")]


def test_secrets_of_a_text_with_many_matches_and_a_repeated_ledger_row(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    text = "".join(f"{k:016x} é token = {k:012d}zz;" for k in range(3000))
    d = docs(spark, [(1, text), (2, "short")])
    once = {r["__id"]: r["spans"] for r in secret_scan.scan(d, ledger).collect()}
    want = sorted([(m.start(), 0, m.end()) for m in re.finditer(r"token = [0-9z]+", text)] + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]{16,}", text)])
    assert [(s["start"], s["ord"], s["end"]) for s in once[1]] == want and once[2] == []
    spark.read.parquet(ledger).write.mode("append").parquet(f"file://{tmp_path}/twice")
    spark.read.parquet(ledger).write.mode("append").parquet(f"file://{tmp_path}/twice")
    again = secret_scan.scan(d, f"file://{tmp_path}/twice").collect()
    assert len(again) == 2 and {r["__id"]: r["spans"] for r in again} == once


def test_url_filter_against_brute_force_propagation(spark):
    rnd = random.Random(8)
    hosts = ["a.com", "b.com", "bad.net", "c.org", "example.net", "d.com"]
    urls = [f"http://{rnd.choice(hosts)}/{rnd.choice(['en', 'fr', 'x'])}/{k}" for k in range(60)]
    links = [(rnd.choice(urls), rnd.choice(urls)) for _ in range(25)]
    pages = [(k, u, "<link rel='canonical' href='%s'>" % dict(links[:12]).get(u, u)) for k, u in enumerate(urls)]
    edges = {(u, dict(links[:12])[u]) for u in urls if u in dict(links[:12])} | set(links[12:])
    verdict = lambda u: "allow" if u.startswith("http://example.net/en/") else "block" if ".net/" in u else "allow" if "c.org/fr/" in u else None
    comp = _components(sorted(urls), lambda a, b: (a, b) in edges or (b, a) in edges)
    blocked = {comp[u] for u in urls if verdict(u) == "block"}
    d = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, host string")
    got = {r["__id"]: r["verdict"] for r in url_filter.url_filter(d, redirects=spark.createDataFrame(links[12:], "src string, dst string")).collect()}
    assert got == {k: verdict(u) or ("block" if comp[u] in blocked else "allow") for k, u in enumerate(urls)}
    assert url_filter.url_filter(d.limit(0)).count() == 0


def test_url_filter_sql_follows_all_links(spark):
    """Several links in a page, of every form; the registered SQL gives the same rows."""
    rnd = random.Random(9)
    hosts = ["A.com", "b.com", "bad.net", "c.org", "example.net", "x.Example.com"]
    urls = [f"http://{rnd.choice(hosts)}/{rnd.choice(['en', 'fr', 'de'])}/{k % 9}{rnd.choice(['', '?q=1&r=2', '#f'])}" for k in range(80)]
    refs = [*rnd.sample(urls, 12), "//b.com/en/1", "/fr/3", "2", "http://none", "x?q=1&amp;r=2", ""]
    forms = ['<link rel="canonical" href="{}">', "<LINK href={} rel=canonical>", '<meta http-equiv="Refresh" content="0; URL={}">']
    page = lambda: "".join(rnd.choice(forms).format(rnd.choice(refs)) for _ in range(rnd.choice([0, 0, 1, 2])))
    rows = [(k, u, page()) for k, u in enumerate(urls)] + [(90, None, forms[0].format(urls[0])), (91, "b.com", forms[0].format(urls[0])), (92, urls[0], None), (93, "http://two.com/", forms[0].format("http://b.com/z") + forms[0].format("http://bad.net/z"))]
    got = {r["__id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    assert got == {r[0]: r[1:] for r in con.execute(oracles.ORACLES["op1_url_filter"]).fetchall()}
    assert got[93][2:] == (None, "block") and len({v[2:] for v in got.values()}) > 3


def test_warc_empty_and_null_ids(spark):
    d = spark.createDataFrame([(None, "u", "x"), (3, None, "y" * 3000), (4, None, "y" * 3000)], "page_id long, url string, html string").selectExpr("*", "1 AS __uri", "2 AS __k")
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(d).collect()}
    assert got == {(None, 1, "response", None), (3, 3000, "revisit", 4), (4, 3000, "response", None)}
    assert warc.round_trip(d.limit(0)).count() == 0


def test_pipeline_end_to_end(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(9)
    vocabulary = [f"wort{k}" for k in range(60)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    clean = [(k, text(60)) for k in range(80)]
    near = " ".join([*clean[0][1].split()[:-1], "wort1"])
    item = text(30)
    bad = [(200, clean[1][1]), (201, near), (202, item + " wort2"), (203, "q\x7f#zx)(" * 60)]
    docs(spark, clean + bad).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, f"file://{tmp_path}").collect()}
    assert got == set(range(80))


def test_pipeline_frees_what_its_stages_made(spark, tmp_path):
    """Only the last stored stage is left in the shared folder, and a stage by itself leaves the ids to drop."""
    import os

    import corpus_pipeline
    from weftgraph.llm.common import shared_dir

    words = "the of and cat house river small green walks over under".split()
    rnd = random.Random(4)
    texts = [(k, " ".join(rnd.choice(words) for _ in range(30))) for k in range(60)]
    texts += [(100 + k, texts[k][1]) for k in range(10)] + [(200 + k, texts[k][1] + " end") for k in range(10)]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "plain words that are fine here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    top = re.sub(r"^file:/+", "/", shared_dir(spark))
    sf, before = f"file://{tmp_path}", set(os.listdir(top))
    made = lambda: sorted(re.sub(r"-[0-9a-f]{32}$", "", x) for x in set(os.listdir(top)) - before)
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert made() == ["stage-decontaminate"] and got <= set(range(60)) and len(got) > 50
    before = set(os.listdir(top))
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        left = stage(spark, d, sf)
        assert left.count() <= d.count(), name
    assert made() == ["dedup-drop", "join-drop", "kn-drop"]
