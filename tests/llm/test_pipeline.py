"""The pipeline's stages, each against brute force on its own input, and the whole."""

import random

import corpus_pipeline as cp
import pytest
from test_dedup import brute_fingerprint, brute_lines
from test_filters import brute_hits

from metrolith.llm import op02_decontamination as op2
from metrolith.llm import op03_quality as op3

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, None)]


def rows(seed=4):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 6)))
    text = lambda: "\n".join(" ".join(word() for _ in range(rnd.randint(4, 12))) + "." for _ in range(rnd.randint(1, 6)))
    out = [(i, text(), "en", "s", 5) for i in range(40)]
    out += [(i, "W%$#@! " * 20 + str(i), None, "s", None) for i in range(40, 60)]
    base = " ".join(word() for _ in range(200))
    out += [(60 + i, base + " x" * i, "en", None, 9) for i in range(4)]
    out += [(70, out[0][1], "en", "s", 5), (71, None, None, None, None), (72, "", "en", "s", 0), (None, text(), "en", "s", 5), (5, out[5][1], "en", "s", 5)]
    out += [(80, "so " + ITEMS[0][1] + " end", "en", "s", 5), (81, ITEMS[0][1][:40], "en", "s", 5), (82, "a" * 30_000, "en", "s", 5)]
    return out


def setup(spark, path):
    data = rows()
    spark.createDataFrame(data, SCHEMA).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 0 if 40 <= (r[0] or 0) < 60 else 1, 0) for r in data] + [(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return data, spark.read.parquet(f"{path}/documents.parquet")


def ids(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


def test_quality_stage(spark, tmp_path):
    data, docs = setup(spark, tmp_path)
    kept = cp.keep_quality(spark, docs, str(tmp_path))
    assert kept.columns == cp.COLUMNS
    net = op3.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = net.scores([(r[1] or "").encode() for r in data], net.tables())
    assert ids(kept) == sorted((r[0] for r, s in zip(data, scores, strict=True) if s >= op3.THRESHOLD), key=str)
    assert set(range(40)) <= set(ids(kept)) and not set(range(40, 60)) & set(ids(kept))


def test_line_stage(spark, tmp_path):
    data, docs = setup(spark, tmp_path)
    out = cp.drop_repeated_lines(spark, docs, str(tmp_path))
    assert out.columns == cp.COLUMNS
    lines = brute_lines([(r[0], r[1]) for r in data])
    expected = []
    for doc_id, text, lang, source, n in data:
        total, gone, kept = lines[doc_id, text]
        if not gone:
            expected.append((doc_id, text, lang, source, n))
        elif gone < total:
            expected.append((doc_id, kept, lang, source, len(kept)))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)
    assert 70 not in ids(out) and 0 in ids(out)


def test_near_stage(spark, tmp_path):
    data, docs = setup(spark, tmp_path)
    out = cp.keep_one_of_near_copies(spark, docs, str(tmp_path))
    assert out.columns == cp.COLUMNS
    fps = {(r[0], r[1]): brute_fingerprint(r[1]) for r in data}
    left, kept = set(fps), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            new = {y for y in left if (fps[x] ^ fps[y]).bit_count() <= 2}
            left -= new
            todo += new
        kept.append(min((x[0] for x in group if x[0] is not None), default=None))
    assert ids(out) == sorted(kept, key=str)


def test_decontamination_stage(spark, tmp_path):
    data, docs = setup(spark, tmp_path)
    out = cp.drop_contaminated(spark, docs, str(tmp_path))
    assert out.columns == cp.COLUMNS
    bad = {h[0] for h in brute_hits([(r[0], r[1]) for r in data], ITEMS) if h[5]}
    assert bad == {80} and ids(out) == sorted((r[0] for r in data if r[0] not in bad), key=str)


@pytest.mark.parametrize("block", [200_000, 1])
def test_decontamination_tells_rows_of_one_id_apart(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(op2, "BLOCK_WORDS", block)
    _, docs = setup(spark, tmp_path)
    leak = "so " + ITEMS[0][1]
    clean = [(None, "a clean row", "en", "s", 5), (None, "another", "en", "s", 5), (None, None, None, None, None), (7, "clean too", "en", "s", 5), (7, "clean too", "en", "s", 5), (8, "", "en", "s", 5)]
    spark.createDataFrame([(3, "another one two three"), (4, "thorough")], "item_id bigint, text string").union(spark.read.parquet(f"{tmp_path}/benchmark.parquet")).write.parquet(f"{tmp_path}/more/benchmark.parquet")
    docs = spark.createDataFrame([*clean, (None, leak, "en", "s", 5), (7, leak, "en", "s", 5), (7, leak + "!", "en", "s", 5)], SCHEMA)
    out = cp.drop_contaminated(spark, docs, f"{tmp_path}/more")
    assert sorted(map(tuple, out.collect()), key=str) == sorted(clean, key=str)


def test_stages_on_an_empty_table(spark, tmp_path):
    setup(spark, tmp_path)
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name


def test_whole_pipeline(spark, tmp_path):
    setup(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), SCHEMA)
    got = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(ids(docs)) and not {80, 70, 45} & {r.doc_id for r in got}
    assert sorted(r.doc_tokens for r in got if r.start == 0) == sorted(r.doc_tokens for r in cp.pack_sequences(spark, docs, str(tmp_path)).collect() if r.start == 0)
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
