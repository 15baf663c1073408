"""The five stages against brute force, with repeated rows, null ids, empty and very long texts and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cargolens.llm import quality_fm, shared
from tests.llm.test_operators import brute_benchmark, brute_components, near_lines

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in "bdfgklmnpr" for b in "aeiou" for c in "mnrstx"]  # letters only: templates drop digits


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 5 else None, len(t) if t is not None else None) for i, t in rows], COLUMNS)


def kept(df):
    assert df.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def texts(seed, n):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(WORDS, k=rng.randint(1, 60))) for _ in range(n)]
    return base, rng


def test_near_stage(spark):
    base, rng = texts(1, 30)
    rows = list(enumerate(base))
    for i, t in enumerate(base[:12]):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, base[3]), (None, base[4]), (3, "a text of its own under an id that another row has"), (5, base[5]), (5, base[5]), (300, None), (300, None), (301, ""), (None, "this one has no id and is near to no other one")]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    component = {i: c for i, _, c in brute_components([rows[i][1] for i in order])}
    want, seen = [], set()
    for place, i in enumerate(order):
        text = rows[i][1]
        if not (text or "").split():
            want.append(rows[i])
        elif component[place] not in seen:
            seen.add(component[place])
            want.append(rows[i])
    got = kept(corpus_pipeline.near_stage(spark, table(spark, rows), ""))
    assert got == sorted(want, key=str) and (3, rows[-8 + 1][1]) in got
    assert corpus_pipeline.near_stage(spark, table(spark, rows).limit(0), "").count() == 0


def test_line_stage(spark):
    rng = random.Random(2)
    lines = [" ".join(rng.choices(WORDS[:6], k=rng.randint(0, 7))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choices(lines, k=3))) for i in range(30)] + [(7, "a row of the same id"), (40, None), (41, ""), (42, " \n "), (43, "word " * 20_000)]
    want, seen = [], []
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            want.append((i, t))
            continue
        left = []
        for line in t.split("\n"):
            w = line.split()
            if not w or not any(w == s or (min(len(w), len(s)) >= 5 and near_lines(w, s)) for s in seen):
                left.append(line)
            if w:
                seen.append(w)
        if "\n".join(left).strip() or len(left) == len(t.split("\n")):
            want.append((i, "\n".join(left)))
    docs = table(spark, [r for r in rows if r[1] != "a row of the same id"])
    want = [r for r in want if r[1] != "a row of the same id"]
    out = corpus_pipeline.line_stage(spark, docs, "")
    assert kept(out) == sorted(want, key=str)
    assert out.where("n_chars <> length(text)").count() == 0
    assert corpus_pipeline.line_stage(spark, docs.limit(0), "").count() == 0


def test_benchmark_stage(spark, tmp_path):
    base, rng = texts(3, 12)
    items = [" ".join(rng.choices(WORDS, k=14)) for _ in range(6)]
    rows = list(enumerate(base)) + [(20 + i, f"{base[i]} {item} {base[i + 1]}") for i, item in enumerate(items)] + [(20, "shares its id"), (None, items[0]), (30, None), (31, ""), (32, base[0]), (32, base[0])]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    hit = {rows[d][0] for d, _, _ in brute_benchmark([t for _, t in rows], items)}
    got = kept(corpus_pipeline.benchmark_stage(spark, table(spark, rows), str(tmp_path)))
    assert got == sorted([r for r in rows if r[0] not in hit], key=str) and hit == {None, *range(20, 26)}


def test_quality_and_mix_stages_and_run(spark, tmp_path):
    base, rng = texts(4, 60)
    junk = [" ".join(f"{w.upper()}!!" for w in rng.choices(WORDS, k=40)) for _ in range(60)]
    rows = list(enumerate(base)) + [(100 + i, t) for i, t in enumerate(junk)] + [(None, base[0]), (7, base[7]), (500, None), (501, "")]
    docs = table(spark, rows)
    labels = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(None, 1), (3, None)]
    for name, df in (("documents", docs), ("labels", spark.createDataFrame(labels, "doc_id long, quality int")), ("benchmark", spark.createDataFrame([(1, " ".join(base[9].split()[:12]) or "x")], "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    left = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    machine = quality_fm.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    features = quality_fm.Features()
    scores = machine.scores([features(t) for _, t in rows])
    assert kept(left) == sorted([r for r, s in zip(rows, scores) if s >= quality_fm.THRESHOLD], key=str)
    assert {r[0] for r in kept(left)} & set(range(100, 160)) == set() and set(range(60)) <= {r[0] for r in kept(left)}
    mixed = corpus_pipeline.mix_stage(spark, left, "").collect()
    total = sum(len((t or "").split()) for _, t in kept(left))
    assert sum(r.taken for r in mixed) == pytest.approx(1.5 * total, abs=5) and len(mixed) == len(kept(left))
    # stage by stage, each over the table that the one before wrote, is what run does
    by_hand = docs
    for _, stage in corpus_pipeline.STAGES:
        by_hand = shared.written(stage(spark, by_hand, str(tmp_path)))
    before = len(shared._WRITTEN)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, got.collect())) == sorted(map(str, by_hand.collect()))
    assert len(shared._WRITTEN) - before <= 3  # the input of the last stage and what it reads
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/empty/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_shared_tables(spark):
    made = []
    out = shared.settled(lambda: made.append(shared.written(spark.range(5))) or made[0].where("id > 1"))
    assert out.count() == 3 and made[0]._shared_table not in shared._WRITTEN
    shared.dropped(out)
    with pytest.raises(Exception, match="(?i)path|exist|file"):
        out.select(F.sum("id")).collect()


def test_line_stage_of_a_long_text_is_linear(spark):
    body = "\n".join(f"a{i * 7919 % 100003} b{i} c{i * 31} d{i * 17} e{i * 13} f{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, body + "\n" + body.split("\n")[3], "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    cut = corpus_pipeline.line_stage(spark, docs, "")
    # made again for a filter, the text would be split for each of its lines
    assert cut._jdf.queryExecution().optimizedPlan().toString().count("array_join") == 1
    assert [tuple(r) for r in cut.collect()] == [(1, body, "en", "s", len(body))]
