"""Operators against brute force and planted cases, with nulls, empty and repeated rows."""

import itertools
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from cargolens.llm import ann_srs, decontaminate, html_blocks, jaccard_join, lang_crf, line_dedup, quality_fm, secret_scan, source_mix, url_filter

ALPHABET = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, source string, extra int"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 5 else None, i) for i, t in enumerate(texts)], DOCS)


def texts(seed=1, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(ALPHABET, k=rng.randint(1, 80))) for _ in range(n // 2)]
    out = [*base]
    for t in base:
        w = t.split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(ALPHABET)
        out.append(" ".join(w))
    return [*out, None, "", "  \n ", out[0], out[0].upper()]


def test_url_filter(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow"), (None, "/", "block")], "host string, path string, action string")
    urls = ["http://a.EXAMPLE.net/en/x?q", "http://example.net/fr", "https://notexample.net/en/", "ftp://b.org/fr/", "net/", None, "http://net", "http://x.com/a#b", "http://a.example.net/en/x?q"]
    pages = spark.createDataFrame([(i % 8, u, "html") for i, u in enumerate(urls)], "page_id int, url string, rule string")
    got = {(r.page_id, r.url): (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got[0, urls[0]] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1, urls[1]][2:] == ("net/", "block") and got[2, urls[2]][2:] == ("net/", "block") and got[3, urls[3]][2:] == ("org/fr/", "allow")
    assert got[4, "net/"] == got[5, None] == ("", "", None, "allow") and got[6, "http://net"] == ("net", "", None, "allow")
    assert len(got) == 9 and url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_source_mix(spark):
    docs = docs_of(spark, texts(2))
    rows = source_mix.mix_sources(docs).collect()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, [0, r.source_size, r.target])[0] += r.taken
    assert sum(t for _, _, t in by.values()) == pytest.approx(1.5 * sum(s for _, s, _ in by.values()))
    assert all(abs(taken - target) <= 1 and target <= 2 * size for taken, size, target in by.values())
    assert sorted(map(str, rows)) == sorted(map(str, source_mix.mix_sources(docs.repartition(7)).collect()))
    mixed = source_mix.mixed_texts(docs, source_mix.mix_sources(docs))
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert source_mix.mix_sources(docs.limit(0)).count() == 0


@pytest.mark.parametrize("share, most", [(1.5, 2.0), (1.9, 2.0), (2.5, 2.0), (0.1, 2.0)])
def test_targets_of_many_sources(spark, share, most):
    rng = random.Random(3)
    rows = [(i == 0, "" if i == 0 else f"s{i}", rng.choice([0, 5, 5, 40, 7000]), 1, 1.0) for i in range(300)]
    sizes = spark.createDataFrame(rows, "no_source boolean, source string, source_size long, n_docs long, mean_quality double").repartition(5)
    got = {(r.no_source, r.source): r.target for r in source_mix.targets(sizes, (3.0, 1.0, 2.0), share, most).collect()}
    order = sorted(rows)
    weight = {r[:2]: (3.0, 1.0, 2.0)[i % 3] for i, r in enumerate(order)}
    left, cap, budget = set(weight), {r[:2]: most * r[2] for r in rows}, share * sum(r[2] for r in rows)
    want = {}
    while left:
        level = (budget - sum(want.values())) / sum(weight[k] for k in left)
        over = {k for k in left if cap[k] < weight[k] * level}
        if not over:
            break
        want |= {k: cap[k] for k in over}
        left -= over
    want |= {k: weight[k] * level for k in left}
    assert got == pytest.approx(want) and len(got) == 300


def near_lines(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_line_dedup(spark):
    rng = random.Random(3)
    lines = [" ".join(rng.choices(ALPHABET[:6], k=rng.randint(1, 8))) for _ in range(120)]
    made = ["\n".join(rng.choices(lines, k=4)) for _ in range(40)] + [None, "", "a a a a a a\na a a a a"]
    want, seen = [], []
    for t in made:
        kept = []
        for line in (t or "").split("\n"):
            w = line.split()
            if len(w) < 5 or not any(near_lines(w, s) for s in seen):
                kept.append(line)
            if len(w) >= 5:
                seen.append(w)
        want.append("\n".join(kept) if t is not None else None)
    docs = docs_of(spark, made)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[i].text for i in range(len(made))] == want and got[5].extra == 5
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_dedup_of_short_lines(spark, tmp_path):
    """The query and the pipeline take exact repeats of lines of any length but blank ones, near ones from five words on."""
    import corpus_pipeline
    from cargolens.llm import registry

    made = ["Read more\n\na b c d\na b c d e", "Read \t more\n\na b c e\nx", "x\n \na b c d e f\nRead less", "Read more", None, ""]
    docs_of(spark, made).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_dropped) for r in registry.op3_line_dedup(spark, str(tmp_path)).collect()}
    want = ["Read more\n\na b c d\na b c d e", "\na b c e\nx", " \nRead less", "", None, ""]
    assert [got[i][0] for i in range(6)] == want and [got[i][1] for i in range(6)] == [0, 1, 2, 1, 0, 0]
    docs = docs_of(spark, made).selectExpr("*", "length(text) as n_chars")
    assert sorted(r.doc_id for r in corpus_pipeline.line_stage(spark, docs, "").collect()) == [0, 1, 2, 4, 5]


def test_secret_scan(spark):
    key = "x9Kf02LmQz7TtB4vYw81Rs"
    made = [f'token = "{key}"', "AKIA" + "A1B2C3D4E5F6G7H8", "deadbeefdeadbeef00", f"our client credentials are {key} now", "the secret settings_of_the_module_name_configuration", None, ""]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(docs_of(spark, made)).collect()}
    assert [(got[i].n_assign, got[i].n_access, got[i].n_hex) for i in range(3)] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    assert got[0].spans == f"assign:0:{9 + len(key)}" and got[2].spans == "hex:0:18"
    assert got[3].spans.startswith("novel:") and got[4].spans == "" and got[5] [1:] == got[6][1:]


def brute_spans(text):
    """The base patterns by hand, character by character."""
    found, letters = [], set("abcdefghijklmnopqrstuvwxyz")
    value = letters | {c.upper() for c in letters} | set("0123456789+/_.=-")
    at = 0
    while at < len(text):
        end = None
        for w in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if "".join(c.lower() if c.lower() in letters and c.isascii() else c for c in text[at : at + len(w)]) == w:
                i = at + len(w)
                i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] not in (":", "=") or i >= len(text):
                    continue
                i += 1
                while text[i : i + 1] == " ":
                    i += 1
                i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
                j = i
                while j < len(text) and text[j] in value:
                    j += 1
                if j > i:
                    end = j
                    if j - i >= 12:
                        found.append((at, 0, j))
                    break
        at = end or at + 1
    for kind, allowed, least, lead in ((1, {c.upper() for c in letters} | set("0123456789"), 18, "AKIA"), (2, set("0123456789abcdef"), 16, "")):
        at = 0
        while at < len(text):
            j = at + len(lead)
            while text.startswith(lead, at) and j < len(text) and text[j] in allowed:
                j += 1
            if text.startswith(lead, at) and j > at + len(lead):
                if j - at >= least:
                    found.append((at, kind, j))
                at = j
            else:
                at += 1
    return sorted(found)


def test_secret_scan_against_brute_force():
    rng = random.Random(12)
    pieces = ["password", "PassWd", "secret", "to", "token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "AKIA", "deadbeef", "0123456789abcdef", "x9K/+_.-", "\n", "é", "K", "Z9", "==", "AKIAAKIA"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert secret_scan.base_spans(text) == brute_spans(text), text


def test_secret_scan_of_odd_tables(spark):
    """Empty tables, clashing columns and long texts, in linear time."""
    docs = docs_of(spark, ["the token is x9Kf02LmQz7TtB4vYw81Rs", None]).withColumn("spans", F.lit("mine")).withColumn("n_hex", F.lit(9))
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0
    got = secret_scan.scan_secrets(docs, keep=("doc_id", "spans", "extra", "n_hex"))
    assert got.columns == ["doc_id", "extra", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]
    assert {r.doc_id: (r.n_hex, r.spans) for r in got.collect()} == {0: (0, "novel:13:35"), 1: (0, "")}
    compressor = secret_scan._compressor()
    for text in ("token " * 170_000, "password = " * 90_000, "a" * 1_000_000, "deadbeef" * 120_000, ("secret " + "deadbeef" * 3 + " ") * 30_000):
        began = time.process_time()
        secret_scan.scan(text, compressor)
        assert time.process_time() - began < 5
    end = "x " * 500_000 + "password=abcdefghijklmnop"
    assert secret_scan.scan(end, compressor)[5] == "assign:1000000:1000025"


def test_quality(spark):
    rng = random.Random(4)
    clean = [" ".join(rng.choices(ALPHABET, k=60)).capitalize() + "." for _ in range(150)]
    junk = [" ".join(f"{w.upper()}!!" for w in rng.choices(ALPHABET, k=60)) for _ in range(150)]
    docs = docs_of(spark, [t for pair in zip(clean, junk) for t in pair] + [None, ""])
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(300) if zlib.crc32(str(i).encode()) % 5] + [(1, None), (9999, 1)], "doc_id long, quality int")
    machine = quality_fm.train(docs, labels)
    rows = quality_fm.score_quality(docs, machine).collect()
    held = [r for r in rows if r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == 1 - r.doc_id % 2 for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in rows) and len(rows) == 302
    assert quality_fm.keep_quality(docs, machine).columns == docs.columns
    assert quality_fm.score_quality(docs, quality_fm.train(docs, labels.limit(0))).count() == 302
    # the linear-time identity against all pairs
    index, value = quality_fm.Features()(clean[0])
    pairs = sum(float(machine.factors[a] @ machine.factors[b]) * u * v for i, (a, u) in enumerate(zip(index, value)) for b, v in list(zip(index, value))[:i])
    z = machine.bias + float((machine.linear[index] * value).sum()) + pairs
    assert machine.scores([(index, value)])[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_language(spark):
    words = {"en": "the of and house with this that".split(), "fr": "le la des maison avec cette dans".split(), "de": "der die und haus mit diese nicht".split()}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i, lang in enumerate(list(words) * 40)] + [(900, None, "en"), (901, "123 --", None), (902, "the house", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = lang_crf.train(docs.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in lang_crf.predict_language(docs, field).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:120]) and got[900].lang_pred == got[901].lang_pred == "und" and got[902].lang_pred == "en"
    assert [x[1] for x in lang_crf.word_languages(field, "the house of that maison dans cette avec")] == ["en"] * 4 + ["fr"] * 4
    assert lang_crf.predict_language(docs, lang_crf.train(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_of_long_runs(spark):
    """A run of letters is looked at to its end: pieces of it are words of the chain."""
    words = {"en": "the of and house with this that".split(), "fr": "le la des maison avec cette dans".split()}
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words[lang], k=30)), lang) for i, lang in enumerate(list(words) * 40)], "doc_id long, text string, lang string")
    field = lang_crf.train(docs)
    run = "thathousewiththis" * 3 + "maisonaveccettedans" * 30
    assert "".join(w for w, _, _ in lang_crf.word_languages(field, run)) == run
    assert [x[0] for x in lang_crf.Tagger(field)([run, "the house " + run])] == ["fr", "fr"]


def test_chain_is_forward_backward():
    rng = np.random.default_rng(6)
    e, a, s = rng.normal(size=(23, 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32)
    first = np.zeros(23, bool)
    first[[0, 4, 5, 17]] = True
    got, starts = lang_crf._chain(e, first, a, s, block=4), [0, 4, 5, 17, 23]
    for low, high in zip(starts, starts[1:]):
        total = np.zeros((high - low, 3))
        for path in itertools.product(range(3), repeat=high - low):
            score = s[path[0]] + sum(e[low + t, y] for t, y in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:]))
            for t, y in enumerate(path):
                total[t, y] += np.exp(score)
        assert got[low:high] == pytest.approx(total / total.sum(1, keepdims=True), abs=1e-4)


def test_expected_transitions():
    """Against enumeration of all paths of chains."""
    rng = np.random.default_rng(7)
    e, a, s = rng.normal(size=(11, 3)).astype(np.float32) * 2, rng.normal(size=(3, 3)).astype(np.float32) * 2, rng.normal(size=3).astype(np.float32)
    first, both = np.zeros(11, bool), []
    first[[0, 6, 7]] = True
    lang_crf._chain(e, first, a, s, block=4, both=both)
    want = np.zeros((3, 3))
    for low, high in ((0, 6), (6, 7), (7, 11)):
        paths = {p: np.exp(s[p[0]] + sum(e[low + t, y] for t, y in enumerate(p)) + sum(a[x, y] for x, y in zip(p, p[1:]))) for p in itertools.product(range(3), repeat=high - low)}
        total = sum(paths.values())
        for p, score in paths.items():
            for x, y in zip(p, p[1:]):
                want[x, y] += score / total
    assert lang_crf.expected_pairs(e, first, a, *both) == pytest.approx(want, abs=1e-4)


def test_language_of_code_switched_texts(spark):
    """Words of held-out texts that switch languages; and odd tables."""
    words = {"en": "the of and house with this that water there people".split(), "fr": "le la des maison avec cette dans eau leur peuple".split(), "de": "der die und haus mit diese nicht wasser dort volk".split()}
    rng = random.Random(15)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words[lang][:8], k=45)), lang) for i, lang in enumerate(list(words) * 40)], "doc_id long, text string, lang string").withColumn("score", F.lit("mine"))
    field = lang_crf.train(docs, pieces=100)
    right = n = 0
    for _ in range(50):
        langs = [lang for lang in rng.choices(list(words), k=4) for _ in range(6)]
        made = [rng.choice(words[lang]) for lang in langs]
        right += sum(x[1] == lang for x, lang in zip(lang_crf.word_languages(field, " ".join(made)), langs))
        n += len(langs)
    assert right / n > 0.97
    assert lang_crf.predict_language(docs.limit(0), field).count() == 0
    assert lang_crf.predict_language(docs, field, keep=("doc_id", "score")).columns == ["doc_id", "lang_pred", "score"]
    long = " ".join(rng.choices(words["fr"], k=200_000))
    assert lang_crf.Tagger(field)([long, None, "1 2"])[0][0] == "fr"


def exact_nearest(ids, v, q, k=10):
    d = np.sqrt(((v - v[q]) ** 2).sum(1))
    return [(ids[i], d[i]) for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]


def found_by(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


@pytest.mark.parametrize(("shard", "block"), [(8000, 8000), (250, 10)])
def test_nearest(spark, shard, block):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(600, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (None, [1.0] * 16), (5, v[5].tolist()), (1003, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x")).withColumn("cell", F.lit(1))
    got = found_by(ann_srs.nearest(df, df.where("vec_id % 20 = 0"), shard=shard, block=block))
    hits = 0
    for q, found in got.items():
        exact = exact_nearest(np.arange(600), v, q)
        hits += len({i for i, _ in found} & {i for i, _ in exact})
        assert len(found) == 10 and all(s == pytest.approx(np.sqrt(((v[i] - v[q]) ** 2).sum())) for i, s in found)
    assert len(got) == 30 and hits / 300 >= 0.9


def test_nearest_of_few_and_equal(spark):
    """Fewer candidates than k, several numbers of components, ties, a vector that fills most of the index, and none at all."""
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(i, [float(i), 1.0, 0.0]) for i in range(300, 400)] + [(900, [1.0, 1.0]), (901, [1.0, 2.0]), (902, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found_by(ann_srs.nearest(df, df.where("vec_id in (7, 350, 900, 902)"), shard=50, block=1))
    assert got[7] == [(i, 0.0) for i in range(11) if i != 7] and [i for i, _ in got[350][:4]] == [349, 351, 348, 352] and got[900] == [(901, 1.0)] and 902 not in got
    assert ann_srs.nearest(df.limit(0), df).count() == ann_srs.nearest(df, df.limit(0)).count() == 0


def test_nearest_stops_early(spark):
    """The test ends most searches: on clustered vectors few are verified, with all neighbours of the cluster found."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 48)) * 4
    v = (centres[np.arange(4000) % 40] + rng.normal(size=(4000, 48)) * 0.3).astype(float)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 100 = 0")
    got = found_by(ann_srs.nearest(df, asked, shard=500))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in exact_nearest(np.arange(4000), v, q)}) for q in range(0, 4000, 100))
    assert hits / 400 >= 0.9
    assert ann_srs.nearest(df, asked, shard=500, verified=True).first().n_verified < 0.1 * 40 * 4000


def brute_components(made):
    sets = []
    for t in made:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if c and 100 * c >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("group", "stars"), [(8, 2), (1, 2), (1, 1)])
def test_jaccard_join(spark, monkeypatch, group, stars):
    """Also with all groups as stars, and with what one star leaves apart joined by cores, in many blocks."""
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    monkeypatch.setattr(jaccard_join, "STARS", stars)
    monkeypatch.setattr(jaccard_join, "BLOCK", 20)
    rng, made = random.Random(8), texts(8, 80)
    base = rng.choices(ALPHABET, k=150)
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(150)] = rng.choice(ALPHABET)
        made.append(" ".join(w))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_similar(docs_of(spark, made)).collect())
    assert got == brute_components(made)
    assert jaccard_join.join_similar(docs_of(spark, made).limit(0)).count() == 0


def test_jaccard_join_of_small_sets(spark, monkeypatch):
    """A deletion key that many texts share costs a link a text at most, and all links of small sets are found."""
    rows, written = [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df: rows.append((out := written(df)).count()) or out)
    rng, base = random.Random(9), ALPHABET[:9]
    made = [" ".join([*base[:7], f"n{i}"]) for i in range(300)] + [" ".join([*base[:8], f"n{i}"]) for i in range(200)] + [" ".join(base[:8])]
    for _ in range(60):
        w = rng.choices(ALPHABET, k=rng.randint(7, 14))
        made += [" ".join(w), " ".join(w[1:]), " ".join(w[:-1]), " ".join(w[1:-1])]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.join_similar(docs_of(spark, made)).collect())
    assert got == brute_components(made) and max(rows) <= 2 * len(made)


def test_jaccard_costs_count_different_sets(spark):
    """Equal sets of several tasks count once, and a set gives its cheapest shared segments."""
    rng = random.Random(21)
    common = rng.choices(ALPHABET, k=40)
    made = [" ".join(common + [f"n{i}x{k}" for k in range(i % 7)]) for i in range(30)]
    docs = docs_of(spark, made * 6).repartition(6).select("text")
    got = sorted((r.id, r.key, r.df) for r in jaccard_join._probes(docs).collect())
    given, cost = {}, Counter()
    for x in {jaccard_join.identity(x): x for x in jaccard_join.shingle_sets(made)}.values():
        for band, h in jaccard_join.bands(len(x)):
            keys, spare = jaccard_join.keys_of(x, band, h)
            given[jaccard_join.identity(x), band] = keys.view(np.int64).tolist(), spare
            cost.update(keys.view(np.int64).tolist())
    want = []
    for (i, _), (keys, spare) in given.items():
        shared = sorted(((cost[k], k) for k in keys if cost[k] > 1), reverse=True)
        want += [(i, k, n) for n, k in shared[spare:]]
    assert got == sorted(want) and want


@pytest.mark.parametrize("words", [(12, 1), (15, 2), (30, 2)])
def test_jaccard_join_of_a_template(spark, monkeypatch, words):
    """Many texts that differ in their last words only, linked or not: rows of every step are linear in the texts."""
    rows, written = [], jaccard_join.written
    monkeypatch.setattr(jaccard_join, "written", lambda df: rows.append((out := written(df)).count()) or out)
    same, own = words
    made = [" ".join(ALPHABET[:same] + [f"n{i}x{k}" for k in range(own)]) for i in range(2000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_similar(docs_of(spark, made)).collect()}
    n, common = same + own - 4, same - 4
    linked = 100 * common >= 80 * (2 * n - common)
    assert got == {i: (n, 0 if linked else i) for i in range(2000)} and max(rows) <= 2000 * (n + 4)


def test_html():
    page = """<html><head><title>t</title><script>if (a<b) "</p>"</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a>x</a></ul></nav>
    <div class="cookie-notice">We use cookies.</div><article><h1>A &amp; B</h1><p>The cat   is in <b>the</b> house<p>Short.<div class="ad">Buy!</div></article>
    <section class="comments"><p>the first of all to say that it is good</p></section><form><label>Mail</label></form><aside>side</aside><footer>&copy; x</footer>"""
    assert html_blocks.extract(page) == "A & B\nThe cat is in the house\nShort."
    good = "the cat of a dog is in the house and it was good for all of them " * 4
    assert html_blocks.extract(f"<div><h2>Head</h2><p>{good}</p><p>short one</p><div class=menu><a>m</a></div></div>") == f"Head\n{good.strip()}\nshort one"
    assert html_blocks.extract(None) == html_blocks.extract("") == html_blocks.extract("<p>") == ""


def test_html_article_is_a_prior():
    """Main text outside of an article stays, boilerplate in it goes, and short or foreign text in it stays."""
    good = ("the cat of a dog is in the house and it was good for all of them " * 4).strip()
    around = "<nav><a>m</a></nav>{}<footer>f</footer>"
    assert html_blocks.extract(around.format(f"<article><p>{good}</p></article><div><p>{good} too</p></div>")) == f"{good}\n{good} too"
    assert html_blocks.extract(around.format(f"<div class=content><p>{good}</p></div><h2>Head</h2><p>{good} too</p>")) == f"{good}\nHead\n{good} too"
    assert html_blocks.extract(around.format(f"<article><p>{good}</p><p>Short.</p><p>Share</p><p>Tweet</p><ul><li><a>x y</a></li></ul></article><div>Imprint</div>")) == f"{good}\nShort.\nShare"
    foreign = "perché gatto " * 30
    assert html_blocks.extract(around.format(f"<article><p>a</p><p>{foreign}</p></article>")) == f"a\n{foreign.strip()}"


def test_html_names_of_subjects_stay():
    """Ids and classes of headings and paragraphs, and names that only hold a marking word, take nothing out."""
    good = ("the cat of a dog is in the house and it was good for all of them " * 4).strip()
    for page in (
        f'<article><h2 id="search-algorithms">A</h2><h3 class="section-header">B</h3><p id="legal-history">{good}</p></article>',
        f'<article class="commentary"><header><h2>A</h2></header><div id="comment-history"><h3>B</h3><p title="a hidden x">{good}</p></div></article>',
    ):
        assert html_blocks.extract(page) == f"A\nB\n{good}"
    for name in ('class="cookie-notice"', 'class="relatedPosts x"', 'id="sidebar"', 'role="dialog"', "hidden", 'style="display: none"', 'class="comment-list"'):
        assert html_blocks.extract(f"<article><p>{good}</p><div {name}><p>{good} too</p></div></article>") == good


def test_html_second_pass_decides():
    """Short blocks have no label of their own; they go with their nearest decided neighbours."""
    good = "the cat of a dog is in the house and it was good for all of them " * 4
    page = f"<p>{good}</p><p>One more.</p><ul><li><a>x</a></li><li><a>y</a></li></ul><p>Imprint</p>"
    found = html_blocks.blocks(page)
    assert [html_blocks.first_pass(*b) for b in found] == [True, None, False, False, None]
    assert html_blocks.extract(page) == f"{good.strip()}\nOne more."


def test_html_is_linear():
    for text in ("<div>" * 30_000 + "</p>" * 30_000, "<p>a" * 100_000, "<" * 300_000, "<a <b>" * 60_000, "&amp;" * 200_000, "<script>" * 50_000):
        began = time.process_time()
        html_blocks.extract(text)
        assert time.process_time() - began < 10


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", "<article><p>a</p></article>")], "page_id long, url string, html string")
    assert sorted((r.text, r.n_chars) for r in html_blocks.extract_main_text(pages).collect()) == [("", 0), ("a", 1)]
    clash = pages.withColumn("text", F.lit("mine"))
    assert html_blocks.extract_main_text(clash, keep=("page_id", "text")).columns == ["page_id", "text", "n_chars"]
    assert html_blocks.extract_main_text(pages.limit(0)).count() == 0


def test_decontaminate(spark):
    item = "If a train leaves Paris at 8 km per hour and later Anna walks the same way at 8 km then who is there"
    slots = "add 7 to 7 and you will then get what"
    bench = spark.createDataFrame([(1, item), (2, None), (None, item), (3, "too short"), (4, slots)], "item_id long, text string")
    changed = item.replace("8", "15").replace("Paris", "Lyon").replace("Anna", "Maria")
    made = ["before " + item + " after", "so " + changed, slots.replace("7 to 7", "5 to 9"), " ".join(ALPHABET), None, "", "1 2 3 4 5 6 7 8 9 10 11 12 13 14", slots.replace("7", "5")]
    docs = docs_of(spark, made)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_benchmark(docs, bench).collect()) == [(0, 1), (1, 1), (7, 4)]
    assert sorted(r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()) == [2, 3, 4, 5, 6]
    assert decontaminate.find_benchmark(docs, bench.limit(0)).count() == 0


def test_decontaminate_short_and_dense_items(spark):
    """Items with few words besides placeholders are met word for word, short ones also after a word, a comma or a heading."""
    items = ["Solve 3 x + 5 = 20", "What force keeps the moon on its path then", "1 2 3 4 5 6 7 8 9 10 kg", "What is it", "Why do 7 birds of the north fly over here"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    made = ["now Solve 3 x + 5 = 20.", "Solve 4 x + 5 = 20", "Practice questions\nWhat force keeps the moon on its path then", "so, What force keeps the moon on its path then?"]
    made += ["Maria said Paris force keeps the moon on its path then", "see: 1 2 3 4 5 6 7 8 9 10 kg, so", "1 2 3 4 5 6 7 8 9 11 kg", "and What is it now", "they ask Why do 9 birds of the north fly over here", *items]
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.find_benchmark(docs_of(spark, made), bench).collect())
    assert got == [(0, 0), (2, 1), (3, 1), (5, 2), (7, 3), (8, 4), (9, 0), (10, 1), (11, 2), (12, 3), (13, 4)]


def brute_templates(text):
    """(template, word as it stands in lower case, word without its outer punctuation) of the words that have a template."""
    raw = regex.sub(r"[\t-\r<>]", " ", text or "").split(" ")
    out, number = [], False
    for k, w in enumerate(raw):
        t = w
        m = regex.match(r"\p{Lu}\p{Ll}[\p{L}'-]*", w)
        if m and k and regex.search(r"[\p{L}\p{N},;]$", raw[k - 1]) and (m.end() == len(w) or w[m.end()] in ",;.:!?"):
            t = "<name>" + w[m.end() :]
        was, number = number, bool(regex.match(r"[$€£+(-]*\d", t))
        if number:
            t = "<num>"
        elif was and regex.fullmatch(r"[.,;:!?)]?", t.lstrip("abcdefghijklmnopqrstuvwxyz")) is not None and regex.match(r"[a-z]*", t)[0] in decontaminate.UNITS:
            t = "<unit>"
        t = regex.sub(r"[^\p{L}\p{M}<> ]+", "", t.lower())
        p = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
        e = regex.sub(r"^[^\p{L}\p{M}\p{N} $€£+-]+|[^\p{L}\p{M}\p{N} %°]+$", "", w.lower())
        if t:
            out.append((t, p, e))
    return out


def brute_benchmark(docs, items):
    found = []
    placed = lambda t: t.startswith("<")
    for d, text in enumerate(docs):
        words = brute_templates(text)
        for item_id, item in enumerate(items):
            whole = brute_templates(item)
            n = min(8, len(whole))
            if not n:
                continue
            windows = [whole[j : j + n] for j in range(len(whole) - n + 1)]
            exact = [sum(not placed(t) for t, _, _ in w) < 5 for w in windows]
            met, instances = set(), {}
            for j, w in enumerate(windows):
                for i in range(len(words) - n + 1):
                    v = words[i : i + n]
                    if exact[j]:
                        if [x[2] for x in v] == [x[2] for x in w]:
                            met.add(j)
                        continue
                    first = j == 0 and not placed(w[0][0]) and v[0][0] in ("<name>", "<unit>")
                    if [x[0] for x in v[first:]] != [x[0] for x in w[first:]] or (first and v[0][1] != w[0][1]):
                        continue
                    slots = {(x[1], y[1]) for x, y, at in zip(v, w, range(n)) if placed(y[0]) or (first and at == 0)}
                    if len(slots) == len({a for a, _ in slots}) == len({b for _, b in slots}):
                        instances.setdefault(i - j, []).append((j, slots))
            for at in instances.values():
                slots = set().union(*(x for _, x in at))
                met |= {j for j, x in at if not x or len(slots) == len({b for _, b in slots})}
            by_template = [j for j in met if not exact[j]]
            templates = len(windows) - sum(exact)
            if len(met) >= min(len(windows), 5) or (templates and len(by_template) >= min(templates, 5)):
                found.append((d, item_id, len(met)))
    return found


def test_decontaminate_against_brute_force(spark):
    rng = random.Random(17)
    vocabulary = "the a car, goes from to at Paris Lyon Anna 5 8 12 (3 km mi. hours, then. What why Zoë-x $5 x7 é <b> -- and walks".split()
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 16))) for _ in range(60)]
    made = []
    for item in items * 3:
        w = item.split(" ")
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        made.append(rng.choice(("", "so ", "Well. ", "then,\n")) + " ".join(w) + rng.choice(("", " and so on", "\n" + item)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    docs = docs_of(spark, made).withColumn("row", F.lit("mine")).withColumn("hash", F.lit(1)).withColumn("item_id", F.lit(2))
    got = sorted((r.doc_id, r.item_id, r.n_windows) for r in decontaminate.find_benchmark(docs, bench).collect())
    assert got == brute_benchmark(made, items) and len(got) > 150
    assert decontaminate.decontaminate(docs, bench).columns == docs.columns
    assert decontaminate.find_benchmark(docs.limit(0), bench).count() == 0


def test_decontaminate_slots_of_an_instance(spark):
    """A value that stands far apart in an item has one value in the document; equal rows and texts of any length."""
    item = "add 8 to this sum of all the good men that went to town and then with care take 8 from it for me"
    made = [item.replace("8", "15"), item.replace("8", "15", 1).replace("8", "20"), "x " * 100_000 + item, item]
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id int, text string")
    got = {r.doc_id: r.n_windows for r in decontaminate.find_benchmark(docs_of(spark, made).unionAll(docs_of(spark, made)), bench).collect()}
    n = len(item.split()) - 7
    assert got == {0: n, 1: n - 2 - 5, 2: n, 3: n}  # two windows have the first 8, five the second


def test_line_dedup_of_odd_tables(spark):
    """Null ids, repeated rows, clashing names, long lines and a template that fills most of the lines."""
    made = [f"this line of the template has number {i}" for i in range(400)]
    rows = [(None, made[0] + "\nnull comes first", 1), (3, made[1], 2), (3, made[1], 2), (4, "\n".join(made), 3), (5, "word " * 50_000 + "end\nnull comes first", 4), (6, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumn("lines", F.lit("mine")).withColumn("n_dropped", F.lit("x")).withColumn("doc", F.lit(7))
    got = line_dedup.dedup_lines(docs, short_repeats=True)
    assert got.columns == ["doc_id", "text", "row", "lines", "doc", "n_lines", "n_dropped"]
    texts = {(r.doc_id, r.row): (r.text, r.n_dropped, r.lines) for r in got.collect()}
    assert texts[None, 1] == (rows[0][1], 0, "mine") and texts[3, 2] == ("", 1, "mine") and texts[4, 3] == ("", 400, "mine") and texts[5, 4] == ("word " * 50_000 + "end", 1, "mine") and texts[6, 5][0] is None
