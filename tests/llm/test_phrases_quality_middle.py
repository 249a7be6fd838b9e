"""Collocations, quality classifier and fill-in-the-middle against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stayline.llm import collocations, fill_middle, quality, queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_collocations(rows, least, longest, top, percent=100):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    frequent = {g: a for g, a in counts.items() if len(g) > 2 and a >= least}
    out = {}
    for g, a in frequent.items():
        lang, words = g[0], g[1:]
        inside = any(
            h[0] == lang and len(h) > len(g) and 100 * b >= percent * a
            and any(h[i:i + len(words)] == words for i in range(1, len(h))) for h, b in frequent.items())
        if not inside:
            cuts = [((1000 * a * total[lang]) // (counts[lang, *words[:k]] * counts[lang, *words[k:]]), k)
                    for k in range(1, len(words))]
            score, k = min(cuts)
            out.setdefault(lang, []).append(
                (-score, -a, " ".join(words).encode(), counts[lang, *words[:k]], counts[lang, *words[k:]], total[lang]))
    return sorted((lang, i, p.decode(), -a, l, r, n, -s) for lang, found in out.items()
                  for i, (s, a, p, l, r, n) in enumerate(sorted(found)[:top], 1))


def phrase_rows():
    pick = np.random.default_rng(5)
    words = ["The", "of", "cat", "é", "x|y", " ", "on", "to", "mat", "zz"]
    rows = [(("en", "de", None)[int(pick.integers(3))], "".join(
        words[int(pick.integers(len(words)))] + (" ", "  ", "\t", ", ", ".", "\n", " ")[int(pick.integers(7))]
        for _ in range(int(pick.integers(0, 60))))) for _ in range(150)]
    rows += [("en", "one copy of a long passage that is repeated word by word, and again word by word")] * 40
    rows += [("fr", None), ("fr", ""), ("fr", " .\n, "), (None, "a a a a a a a a a a a a a")]
    return rows


@pytest.mark.parametrize(("shards", "bits", "percent"), [(3, 16, 100), (1, 7, 100), (2, 12, 60)])
def test_collocations_equal_brute_force(spark, shards, bits, percent):
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, t, lang, "x") for i, (lang, t) in enumerate(rows)],
                                 "phrase long, text string, lang string, n string").repartition(4)
    got = collocations.collocations(docs, least=9, top=30, shards=shards, filter_bits=bits, absorb_percent=percent)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(rows, 9, 5, 30, percent)


def test_collocations_without_rows_or_phrases(spark, empty, odd):
    assert collocations.collocations(empty, shards=1).count() == 0
    assert collocations.collocations(odd, least=1_000_000, shards=1).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(odd, least=0)


def starts_of(rows, lang="en"):
    batch = pa.RecordBatch.from_arrays([pa.array([lang] * len(rows)), pa.array(rows)], names=["lang", "text"])
    found, size = Counter(), 0
    for out in collocations._word_rows(iter([batch]), 2, 4):
        for n, owned, raw in zip(*(out.column(c).to_pylist() for c in ("size", "owned", "words")), strict=True):
            words, size = np.frombuffer(raw, "<u8").tolist(), size + n
            for i in range(owned):
                for k in range(1, 5):
                    if len(words[i:i + k]) == k and 0 not in words[i:i + k]:
                        found[tuple(words[i:i + k])] += 1
    return found, size


def test_long_texts_are_counted_once_whatever_their_slices(monkeypatch):
    pick = np.random.default_rng(8)
    texts = [" ".join(("a", "b", "c.", "d")[int(x)] for x in pick.integers(0, 4, n)) for n in (3, 50, 700)]
    whole = starts_of(texts)
    monkeypatch.setattr(collocations, "_ROW", 7)
    monkeypatch.setattr(collocations, "_SLICE", 11)
    assert starts_of(texts) == whole and sum(whole[0].values()) > 1000


def test_scores_pass_64_bits(spark, monkeypatch):
    """a * n * 1000 beyond 64 bits, by counts that stand in for a large corpus."""
    big = 3 * 10**12
    words = collocations.WordNumbers("en").numbers([b"new", b"york"])
    table = [(words[:1].tobytes(), big), (words[1:].tobytes(), big + 1), (words.tobytes(), big - 1)]
    found = spark.createDataFrame(table, "phrase binary, n long")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: (found, totals))
    docs = spark.createDataFrame([("en", "new york")], "lang string, text string")
    row = collocations.collocations(docs).collect()[0]
    assert row.phrase == "new york" and row.score == 1000 * (big - 1) * 10**15 // (big * (big + 1))


def labelled(folder, spark):
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op12_quality(spark, folder).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    out = [r for r in rows if r.held_out and r.doc_id in labels]
    good = [r.predicted == 1 for r in out if labels[r.doc_id] == 1]
    bad = [r.predicted == 0 for r in out if labels[r.doc_id] == 0]
    assert len(bad) > 5 and np.mean(good) > 0.95 and np.mean(bad) > 0.9


def test_quality_does_not_depend_on_partitions(spark, folder):
    docs, labels = labelled(folder, spark)
    learn = F.col("doc_id") % 3 != 0
    one = quality.classify(docs, labels, learn).collect()
    two = quality.classify(docs.repartition(7), labels.repartition(3).unionByName(labels), learn).collect()
    assert {r.doc_id: r.score for r in one} == {r.doc_id: r.score for r in two}


def test_scores_equal_the_densities(spark):
    pick = np.random.default_rng(4)
    p = len(quality.STATISTICS)
    stats = np.rint(pick.standard_normal((300, p)) @ pick.standard_normal((p, p)) * quality.STEP).astype(np.int64)
    label = (stats[:, 0] > stats[:, 1]).astype(int)
    low, sums = np.tril_indices(p), []
    for k in (0, 1):
        x = stats[label == k].astype(object)
        sums += [(k, -1, -1, len(x)), *[(k, i, -1, v) for i, v in enumerate(x.sum(axis=0))]]
        sums += [(k, i, j, v) for i, j, v in zip(*low, (x.T @ x)[low], strict=True)]
    model = quality.QualityModel.build(sums, 0.4, 0.1)
    x = stats / quality.STEP
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    cov = [np.cov(z[label == k].T, bias=True) for k in (0, 1)]
    share = np.array([np.mean(label == k) for k in (0, 1)])
    shared = share[0] * cov[0] + share[1] * cov[1]
    density = []
    for k in (0, 1):
        own = 0.6 * cov[k] + 0.4 * shared
        own = 0.9 * own + 0.1 * np.trace(own) / p * np.eye(p)
        d = z - z[label == k].mean(axis=0)
        density.append(np.log(share[k]) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(own), d))
    assert np.allclose(model.odds(stats), density[1] - density[0], atol=1e-5)


def test_statistics_do_not_depend_on_slices(monkeypatch):
    texts = [None, "", " ", "The The the. 12\n", "wörd " * 300, "x" * 900]
    whole = [quality.statistics(t) for t in texts]
    monkeypatch.setattr(quality, "_SLICE", 64)
    at = [i for i, n in enumerate(quality.STATISTICS) if n not in ("doubled", "compressed")]
    assert all(np.allclose(quality.statistics(t)[at], w[at]) for t, w in zip(texts, whole, strict=True))
    assert np.isfinite(whole).all() and (whole[0] == whole[1]).all()


def test_quality_of_odd_rows(spark, odd, empty):
    kinds = "doc_id long, quality int, toxic int, text string"
    labels = spark.createDataFrame(
        [(4, 1, 0, ""), (4, 0, 0, ""), (6, 1, 0, ""), (7, 0, 0, ""), (8, 1, None, ""), (8, 1, 0, ""), (1, None, 0, ""),
         (None, 0, 0, ""), (99, 1, 0, ""), (2, 7, 0, "")], kinds)
    everyone = F.col("doc_id").isNotNull()
    rows = quality.classify(odd, labels, everyone).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 8}) == 1 and not [r for r in rows if r.doc_id is None][0].learned
    none = labels.filter("doc_id > 1000")
    assert {r.score for r in quality.classify(odd, none, everyone).collect()} == {0.5}
    assert {r.score for r in quality.classify(odd, labels.filter("quality = 1"), everyone).collect()} == {1.0}
    assert quality.classify(empty, labels, everyone).count() == 0


def brute_middle(key, text, percent=90, spm=20):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return (key, n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm:
        return (key, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (key, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("percent", [90, 100])
def test_middles_equal_brute_force(spark, odd, odd_rows, empty, percent):
    more = [(100 + i, t) for i, t in enumerate(
        ["a<P>b", "<S", "S><<M", "$1 \\2 \\Q.\\E", "😀é漢\r\n " * 50, "x" * 200_000 + "😀", "\0", "<", "漢" * 1024 + "\n"] * 5)]
    rows = [(i, t) for i, t, *_ in odd_rows] + more
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    made = fill_middle.fill_in_middle(docs.withColumn("n", F.lit("x")).withColumn("output", F.lit(1)), percent=percent)
    got = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted((tuple(r)[:6] for r in got), key=order) == sorted((brute_middle(*r, percent) for r in rows), key=order)
    texts = {(i, t or "") for i, t in rows}
    assert {(r.doc_id, r.back) for r in got} == texts and {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(empty).count() == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_middles_of_other_units_and_marks(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i)) + " ") for i in range(1, 60)] + [(99, "")], "doc_id long, text string")
    marks = fill_middle.Sentinels("$p|", "(s\\", "[m^")
    made = fill_middle.fill_in_middle(docs, unit=r"\S*+ ", percent=100, marks=marks)
    rows = made.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), marks)).join(docs, "doc_id").collect()
    for r in rows:
        assert r.back == r.text and r.n == r.text.count(" ")
        if r.form == "psm":
            head, tail = r.output.removeprefix("$p|").split("(s\\")
            assert head.count(" ") == r.prefix_units and tail.split("[m^")[1].count(" ") == r.middle_units
    gaps = fill_middle.fill_in_middle(docs, unit=r"w1", percent=100, marks=marks).filter("form = 'plain'").count()
    assert gaps > 0
    with pytest.raises(ValueError):
        fill_middle.Sentinels("aba")


def test_registered_middles_equal_their_sql(spark, folder):
    from check import connect, differences

    got = queries.op13_fill_middle(spark, folder).toPandas()
    assert differences(got, connect(folder).execute(queries.all_sql()["op13_fill_middle"]).fetchdf()) == []
