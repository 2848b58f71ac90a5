"""The pipeline and its stages against plain Python, on small tables with awkward rows."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_html_quality import made as labelled
from tokenizers import Tokenizer

import corpus_pipeline
from tideglass.llm import quality
from tideglass.llm.queries import SEQUENCE, vocabulary

STAGE = dict(corpus_pipeline.STAGES)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(4)
    rows = [(i, text) for i, text, _ in labelled(240)]
    long = [w for _, text in rows for w in text.split()][:9000]
    for k in range(30):
        words = rows[rng.randrange(240)][1].split()
        if len(words) > 60:
            words[rng.randrange(len(words))] = "changed"
        rows.append((300 + k, " ".join(words)))
    rows += [(400, None), (401, ""), (402, " \n"), (3, rows[3][1]), (3, rows[3][1]), (4, "another text under the same id"), (None, rows[5][1]), (None, None), (403, " ".join(long))]
    return rows


ITEMS = [(1, "river stone under cloud walks and the light of an item that is long enough to be found"), (2, "three short words"), (3, None), (4, "")]


def table(spark, rows):
    df = spark.createDataFrame([(d, t, "en", "web", None if t is None else len(t)) for d, t in rows], DOCS)
    return df.repartition(3)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rows = documents()
    rows[7] = (7, f"{ITEMS[0][1]} {ITEMS[0][1].upper()}")
    rows[8] = (8, rows[8][1] + " three short words")
    table(spark, rows).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in labelled(240)] + [(400, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is None))


def plain_groups(rows):
    """One row of each component: the smallest id, a null id last, one row of those with one id and one text."""
    best, alone = {}, set()
    comp = plain_components(rows)
    for (d, t), c in zip(rows, comp, strict=True):
        if c is None:
            alone.add((d, t))
        else:
            best.setdefault(c, []).append((d is None, d, t))
    return alone, best


def plain_components(rows):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else None)
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and comp[i] != comp[j] and min(len(a), len(b)) * 100 >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    return [c if s else None for c, s in zip(comp, sets, strict=True)]


def plain_clean(text):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    own, hit = words(text), set()
    for _, item in ITEMS:
        w = words(item)
        m = min(13, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set()
        for i in range(len(own) - m + 1):
            if windows and tuple(own[i : i + m]) in windows:
                hit.update(range(i, i + m))
    return not (hit and 20 * len(hit) >= len(own))


def test_stages_as_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"score": F.lit("clash"), "node": F.lit(1), "component": F.lit(2), "__hits": F.lit(3), "key": F.lit(4)})
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = STAGE["quality"](spark, docs, sf_dir)
    assert good.columns == docs.columns
    model = quality.fit_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = [model.score(x) >= 0.7 for x in quality.features(pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in rows], pa.string())}))]
    want = [r for r, ok in zip(rows, judged, strict=True) if ok]
    assert key((r.doc_id, r.text) for r in good.collect()) == key(want) and 0 < len(want) < len(rows)

    one = STAGE["jaccard"](spark, docs, sf_dir)
    got = [(r.doc_id, r.text) for r in one.collect()]
    alone, best = plain_groups(rows)
    assert one.columns == docs.columns and len(got) == len(set(got)) == len(alone) + len(best)
    assert alone <= set(got)
    for members in best.values():
        kept = [m for m in members if (m[1], m[2]) in set(got)]
        assert {m[:2] for m in kept} == {min(m[:2] for m in members)} and len({m[2] for m in kept}) == 1

    clean = STAGE["decontamination"](spark, docs, sf_dir)
    assert clean.columns == docs.columns
    want = [r for r in rows if plain_clean(r[1])]
    assert key((r.doc_id, r.text) for r in clean.collect()) == key(want) and 7 not in {r[0] for r in want} and 400 in {r[0] for r in want}


def test_run_as_its_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(texts) == set(got.doc_id) and len(texts) > 20
    t = Tokenizer.from_file(vocabulary())
    for doc, own in got.groupby("doc_id"):
        ids = np.array([*t.encode(texts[doc] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert own.length.sum() == len(ids)
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert got.groupby("sequence_id").length.sum().max() <= SEQUENCE


def test_empty_tables(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    docs = table(spark, documents())
    assert STAGE["decontamination"](spark, docs, str(tmp_path)).count() == docs.count()
    assert STAGE["quality"](spark, docs, str(tmp_path)).count() == 0
