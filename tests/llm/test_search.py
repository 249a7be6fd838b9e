"""Repeats, SimHash, language, neighbours, URL rules, MinHash and the pipeline against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stayline.llm import common, language, minhash, neighbours, queries, repeats, simhash, url_filter


def brute_cover(texts, window):
    seen = defaultdict(list)
    for i, t in enumerate(texts):
        for k in range(len(t) - window + 1):
            seen[t[k:k + window]].append((i, k))
    cover = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        for i, k in places if len(places) > 1 else ():
            cover[i][k:k + window] = True
    return cover


@pytest.mark.parametrize("most_in_group", [1, 20_000])
def test_repeats_equal_brute_force(odd, odd_rows, most_in_group):
    texts = [(t or "").encode() for _, t, *_ in odd_rows]
    want = sorted((len(t), int(c.sum()), int((np.diff(c.astype(int), prepend=0) == 1).sum()),
                   np.frombuffer(t, np.uint8)[~c].tobytes()) for t, c in zip(texts, brute_cover(texts, 400), strict=True))
    got = repeats.remove_repeats(odd, most_in_group=most_in_group)
    assert set(got.columns) == set(odd.columns)  # the table's own `found` is replaced
    rows = got.select("found.n_bytes", "found.n_removed", "found.n_spans", "found.kept").collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows) == want


def test_repeats_with_short_windows_on_random_texts(spark, tmp_path):
    pick = np.random.default_rng(2)
    texts = ["".join(pick.choice(list("ab"), int(n))) for n in pick.integers(0, 400, 40)]
    base = "".join(pick.choice(list("abcdefgh"), 300))
    texts += [base[:150] + t[:50] + base[100:] for t in texts[:10]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    rows = repeats.remove_repeats(docs, window=40, into="f").select("doc_id", "f.kept").collect()
    cover = brute_cover([t.encode() for t in texts], 40)
    assert {r.doc_id: bytes(r.kept) for r in rows} == {
        i: np.frombuffer(t.encode(), np.uint8)[~c].tobytes() for i, (t, c) in enumerate(zip(texts, cover, strict=True))}


@pytest.fixture()
def moving_scans(spark, monkeypatch):
    """Scans are split in another way after the first kept table, as where the number of cores changes."""
    key = "spark.sql.leafNodeDefaultParallelism"

    def moved(df):
        out = common.kept(df)
        spark.conf.set(key, "1")
        return out

    spark.conf.set(key, "12")
    for module in (repeats, simhash, corpus_pipeline):
        monkeypatch.setattr(module, "kept", moved)
    yield
    spark.conf.unset(key)


@pytest.fixture()
def scattered(spark, tmp_path):
    """Twelve small files; documents 3k to 3k + 2 share a passage, and 3k + 1 is a copy of 3k."""
    texts = []
    for k in range(8):
        passage = " ".join(f"p{k}x{i}" for i in range(90))
        texts += [f"{k} one {passage} end", f"{k} one {passage} end",
                  " ".join(f"other{k}y{i}" for i in range(150 + 20 * k)) + passage]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(12) \
        .write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t")), texts


def test_repeats_where_scans_change_between_jobs(scattered, moving_scans):
    docs, texts = scattered
    rows = repeats.remove_repeats(docs, into="f").select("doc_id", "f.kept").collect()
    cover = brute_cover([t.encode() for t in texts], 400)
    assert {r.doc_id: bytes(r.kept) for r in rows} == {
        i: np.frombuffer(t.encode(), np.uint8)[~c].tobytes() for i, (t, c) in enumerate(zip(texts, cover, strict=True))}


def test_near_duplicates_where_scans_change_between_jobs(spark, scattered, moving_scans):
    docs, texts = scattered
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(i, t) for i, t in enumerate(texts) if i % 3 != 1]


def test_repeats_of_an_empty_table(empty):
    assert repeats.remove_repeats(empty).count() == 0


def brute_components(ids, fps):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    group = defaultdict(list)
    for i in range(len(fps)):
        group[find(i)].append(ids[i])
    return sorted((ids[i], min(group[find(i)])) for i in range(len(fps)))


def test_golay_keys_meet_within_two_bits():
    code, pick = simhash.GolayCode(), np.random.default_rng(1)
    assert len(code.errors) == 1 + 23 + 253 + 1771 + 8855
    words = pick.integers(0, 1 << 23, 300)
    flips = (1 << pick.integers(0, 23, 300)) ^ (1 << pick.integers(0, 23, 300))
    a, b = defaultdict(set), defaultdict(set)
    for keys, values in ((a, words), (b, words ^ flips)):
        for at, index in zip(*code.near(values), strict=True):
            keys[at].add(int(index))
    assert all(a[i] & b[i] for i in range(300))


@pytest.mark.parametrize("most", [2, 4096])
def test_links_of_planted_fingerprints(spark, monkeypatch, most):
    pick = np.random.default_rng(4)
    centres = pick.integers(0, 1 << 63, 25, dtype=np.uint64)
    fps = [int(c) for c in centres]
    for c in centres[:12]:
        for _ in range(12):
            bits = pick.integers(0, 64, pick.integers(1, 5))
            fps.append(int(c) ^ sum({1 << int(b) for b in bits}))
    rows = spark.createDataFrame([(i, str(f)) for i, f in enumerate(fps)], "doc_id long, text string")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, key, text, shingle: docs.select(
        "doc_id", F.conv("text", 10, 16).alias("h")).select("doc_id", F.conv("h", 16, -10).cast("long").alias("fp")))
    got = simhash.near_duplicates(rows, most_in_bucket=most).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_components(list(range(len(fps))), fps)


def test_simhash_on_odd_rows(odd, empty, odd_rows):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    zero = [r for r in got if r.fp == 0]
    assert {r.doc_id for r in zero} == {0, 1, 2} and {r.component_id for r in zero} == {0}
    assert next(r.component_id for r in got if r.doc_id == 5) == 4
    assert simhash.near_duplicates(empty).count() == 0


def test_language_learns_and_scores(spark, folder, odd, empty):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = queries.op4_language(spark, folder).join(docs, "doc_id").collect()
    right = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert len(rows) == docs.count() and np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    model = language.fit(docs, most_docs=20)
    got = {(r.doc_id, r.lang_pred) for r in language.identify(odd, model).collect()}
    assert {i for i, lang in got if lang == "und"} == {0, 1, 2, None}
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}


def test_language_keeps_every_label(spark):
    langs = [f"l{i:03}" for i in range(230)]  # a text of its own letters for each
    texts = [" ".join(chr(0x4E00 + 40 * i + j % 40) * (1 + j % 3) for j in range(60)) for i in range(230)]
    docs = spark.createDataFrame(list(zip(langs, texts, strict=True)), "lang string, text string").repartition(8)
    model = language.fit(docs, most_docs=1)
    assert model.names == langs
    assert model.predict(texts)[0] == langs and model.predict([None, "12"])[0] == ["und", "und"]


def test_language_keeps_every_string_of_a_small_language(spark):
    pick = np.random.default_rng(3)
    rows = [("aa", "".join(map(chr, pick.integers(97, 123, 3000)))) for _ in range(400)]  # over 1,000,000 strings
    small = " ".join(f"zebra{i} żółć{i}" for i in range(30))
    docs = spark.createDataFrame([*rows, ("zz", small)], "lang string, text string").repartition(4)
    both, alone = language.fit(docs), language.fit(docs.filter("lang = 'zz'"))
    assert both.names == ["aa", "zz"]
    got, want = both.code_lengths([small.encode()])[0, 1], alone.code_lengths([small.encode()])[0, 0]
    assert got == pytest.approx(want, rel=1e-4)


def test_code_lengths_equal_the_definition():
    import pandas as pd

    texts, order = [b"abracadabra", b"banana band"], 2
    counts = []
    for lang, t in enumerate(texts):
        for size in range(1, order + 2):
            data = np.frombuffer(b"\n" * order + t, np.uint8)[order + 1 - size:]
            codes, n = np.unique(language.gram_codes(data, size), return_counts=True)
            counts += [(size, int(c), lang, int(k)) for c, k in zip(codes, n, strict=True)]
    model = language.LanguageModel.build(["x", "y"], order, pd.DataFrame(counts, columns=["size", "code", "lang", "n"]))

    def bits(train, text):
        seen = defaultdict(lambda: defaultdict(int))
        data = b"\n" * order + train
        for i in range(order, len(data)):
            for c in range(order + 1):
                seen[data[i - c:i]][data[i]] += 1
        total, data = 0.0, b"\n" * order + text
        for i in range(order, len(data)):
            for c in range(order, -1, -1):
                own = seen.get(data[i - c:i], {})
                t, d = sum(own.values()), len(own)
                if data[i] in own:
                    total -= np.log2(own[data[i]] / (t + d))
                    break
                total -= np.log2(d / (t + d)) if t else 0
            else:
                total += 8
        return total

    probe = [b"banana", b"cab zed", b"a"]
    want = [[bits(t, p) for t in texts] for p in probe]
    assert np.allclose(model.code_lengths(probe), want, rtol=1e-4)


def test_neighbours_recall_ties_and_odd_vectors(spark):
    pick = np.random.default_rng(3)
    x = pick.standard_normal((1500, 16))
    x[100:400] = x[7]  # many copies: ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1500, None), (1550, [0.0] * 16), (1600, [float("nan")] * 16), (1650, [None] * 16), (1700, [1.0]), (None, x[0].tolist())]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("part", F.lit("x"))
    got = defaultdict(list)
    for r in neighbours.nearest(table, F.pmod("vec_id", F.lit(50)) == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    norm, hits = np.sqrt((x * x).sum(axis=1)), 0
    assert set(got) == set(range(0, 1500, 50))
    for q, found in got.items():
        score = (x * x[q]).sum(axis=1) / (norm * norm[q])
        score[q] = -2
        best = np.lexsort((np.arange(1500), -score))[:5]
        assert [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(score[v] == s for _, v, s in found)
        hits += len(set(best) & {v for _, v, _ in found})
    assert [v for _, v, _ in got[100]] == [7, 101, 102, 103, 104]
    assert hits >= 0.9 * 5 * len(got)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert neighbours.nearest(few, F.col("vec_id") == 0).count() == 2
    assert neighbours.nearest(few.filter("vec_id > 9"), F.lit(True)).count() == 0


def test_neighbours_of_repeated_rows_equal_brute_force(spark):
    """Repeated queries, repeated candidates, and an id that asks with two vectors; one part, so all is found."""
    pick = np.random.default_rng(9)
    x = pick.standard_normal((60, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(0, x[0].tolist())] * 2 + [(44, x[44].tolist()), (50, x[3].tolist()), (50, x[50].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    for block in (8192, 7):
        got = defaultdict(list)
        found = neighbours.nearest(table, F.pmod("vec_id", F.lit(50)) == 0, parts=1, block=block, query_block=2)
        for r in found.orderBy("query_id", "rank").collect():
            got[r.query_id].append((r["rank"], r.vec_id, round(r.score, 12)))
        for q in (0, 50):
            own = [np.array(v) for i, v in rows if i == q]
            score = [(-max(round(float(np.dot(v, o) / np.sqrt(np.dot(v, v) * np.dot(o, o))), 12) for o in own), i)
                     for i, v in ((i, np.array(v)) for i, v in rows) if i != q]
            assert got[q] == [(n, i, -s) for n, (s, i) in enumerate(sorted(score)[:5], 1)]
        assert set(got) == {0, 50}


def clustered(spark, n, seed=1):
    """n vectors around n / 50 centres."""
    pick = np.random.default_rng(seed)
    x = np.repeat(pick.standard_normal((n // 50, 12)), 50, axis=0) + 0.25 * pick.standard_normal((n, 12))
    x = x[pick.permutation(n)]
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)


def test_parts_are_divided_and_queries_stay_few(spark, monkeypatch):
    """Two levels: parts grow in number with the rows, and a query meets no more of them than before."""
    seen = []
    real = neighbours.Index.probes_for

    def watched(index, *args):
        seen.append((index.parts, len(index.fine), real(index, *args)))
        return seen[-1][2]

    monkeypatch.setattr(neighbours.Index, "probes_for", watched)
    for n in (1500, 6000):
        x, table = clustered(spark, n)
        rows = neighbours.nearest(table, F.pmod("vec_id", F.lit(50)) == 0, sample=1000, part_rows=60).collect()
        unit, got = x / np.sqrt((x * x).sum(axis=1, keepdims=True)), defaultdict(set)
        for r in rows:
            got[r.query_id].add(r.vec_id)
        hits = 0
        for q in range(0, n, 50):
            score = unit @ unit[q]
            score[q] = -2
            hits += len(set(np.argsort(-score)[:5].tolist()) & got[q])
        assert len(rows) == n // 50 * 5 and hits >= 0.9 * len(rows)
    (few, _, less), (many, divided, more) = seen
    assert divided > 0 and many > 2 * few and more < many / 3 and more < 4 * less


def direct_fingerprint(text, words=3):
    import re

    import xxhash

    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(found[i:i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_registered_simhash_equals_a_direct_computation(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op5_simhash(spark, folder).collect()
    fps = {i: direct_fingerprint(t) for i, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in fps.items()}
    ids = list(fps)
    assert sorted((r.doc_id, r.component_id) for r in rows) == brute_components(ids, [fps[i] for i in ids])


def test_registered_repeats_equal_brute_force(spark, folder):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = {}
    for (i, t), c in zip(texts.items(), brute_cover(list(texts.values()), 400), strict=True):
        left = np.frombuffer(t, np.uint8)[~c].tobytes()
        want[i] = (len(t), int(c.sum()), int((np.diff(c.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest())
    rows = queries.op3_repeats(spark, folder).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_repeats_cut_back_to_whole_words(spark, tmp_path):
    shared = " ".join(f"word{i}" for i in range(60))
    texts = [f"start a{shared}z end", f"begin b{shared}y stop", "few words " * 3 + "x" * 300, "other " + "x" * 300]
    spark.createDataFrame(list(enumerate(texts)), "rid long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    rows = repeats.remove_repeats(docs, window=100, into="f", least_words=50).select("rid", "f.kept_text", "f.n_spans").collect()
    assert {r.rid: (r.kept_text, r.n_spans) for r in rows} == {
        0: ("start aword0 word59z end", 1), 1: ("begin bword0 word59y stop", 1), 2: (texts[2], 0), 3: (texts[3], 0)}


def test_stages_on_an_empty_table_and_on_clashing_names(spark, odd, empty, folder):
    names = ["row", "_row", "found", "_found", "component_id", "spans", "zip", "_rid"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
        if stage is not corpus_pipeline.pack_windows:
            clash = odd
            for name in names:
                clash = clash.withColumn(name, F.lit("q"))
            out = stage(spark, clash, folder)
            assert out.columns == clash.columns
            assert all(r[n] == "q" for r in out.collect() for n in names)


def test_held_out_is_never_null(spark):
    ids = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long")
    assert all(v is not None for r in ids.select(queries.held_out(), queries.held_out(3, 1)).collect() for v in r)


def test_url_rules(spark):
    urls = ["http://a.net/x", "https://EXAMPLE.net/en/1?q", "http://example.net/en", "http://x.org/fr/", "http://org", "http://net",
            "http://www.example.com/de/a#b", "example.com/de/", None, "http://b.example.net?x=/en/", "http://notexample.com/de/"]
    rows = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), queries.URL_RULES)
    got = [(r.host, r.path, r.rule, r.verdict) for r in rows.orderBy("page_id").collect()]
    assert got == [
        ("a.net", "/x", "net/", "block"), ("example.net", "/en/1", "example.net/en/", "allow"),
        ("example.net", "/en", "net/", "block"), ("x.org", "/fr/", "org/fr/", "allow"), ("org", "", None, "allow"),
        ("net", "", None, "allow"), ("www.example.com", "/de/a", "example.com/de/", "block"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("b.example.net", "", None, "allow"), ("notexample.com", "/de/", None, "allow")]


def test_url_query_equals_its_sql(spark, folder):
    from check import connect, differences

    got = queries.op8_urls(spark, folder).toPandas()
    assert differences(got, connect(folder).execute(queries.all_sql()["op8_urls"]).fetchdf()) == []


def shingles(text):
    words = text.split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def test_fingerprints_and_edits(spark, odd, empty, odd_rows):
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    texts, want = [r[1] or "" for r in ordered], []
    for i, t in enumerate(texts):
        half, after = len(t) // 2, texts[(i + 1) % len(texts)]
        edit = t[:len(t) - half] + after[:half]
        want.append((ordered[i][0], len(t), hashlib.sha256(edit.encode()).hexdigest()))
    for ranges in (1, 4):
        rows = minhash.compare_with_edits(odd, ranges).withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256)).collect()
        key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
        assert sorted([(r.doc_id, r.n_chars, r.sha) for r in rows], key=key) == sorted(want, key=key)
        by = {r.doc_id: r for r in rows}
        assert by[4].fingerprint == by[5].fingerprint and by[5].near_next == 1.0
        assert by[0].fingerprint == by[1].fingerprint != by[3].fingerprint
    assert minhash.compare_with_edits(empty, 4).count() == 0
    plan = minhash.compare_with_edits(odd, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_fingerprint_likeness_is_near_the_truth(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    ids = sorted(docs, reverse=True)
    for r in queries.op10_fingerprints(spark, folder).collect():
        a, b = docs[r.doc_id], docs[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        half = len(a) // 2
        x, y = shingles(a), shingles(a[:len(a) - half] + b[:half])
        assert abs(r.near_edited - len(x & y) / len(x | y)) < 0.2


def test_pipeline_stages(spark, odd, folder):
    docs = corpus_pipeline.keep_known_language(spark, odd, folder)
    assert docs.columns == odd.columns
    assert {r.doc_id for r in docs.select("doc_id").collect()} == {3, 4, 5, 6, 7, 8, 11}
    left = corpus_pipeline.drop_near_duplicates(spark, odd, folder)
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in left.select("doc_id").collect())
    assert left.columns == odd.columns and ids == [-1, 0, 3, 4, 6, 7, 8, 11]
    cut = corpus_pipeline.cut_repeats(spark, odd, folder)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == odd.columns and texts[0] is None and texts[8] == "" and texts[7].startswith("before")
    assert texts[11] == "x" * 900 and all(f is None or f == "x" for f in [r.found for r in cut.collect()])
    assert sum(r.length for r in corpus_pipeline.run(spark, folder).collect()) > 0


def test_pipeline_keeps_texts_where_no_language_is_known(odd, spark, folder):
    bare = odd.withColumn("lang", F.lit(None).cast("string"))
    docs = corpus_pipeline.keep_known_language(spark, bare, folder)
    assert docs.columns == odd.columns
    assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == [3, 4, 5, 6, 7, 8, 8, 11]


def test_every_corpus_query_is_registered():
    import __spark_entry__ as entry

    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()
