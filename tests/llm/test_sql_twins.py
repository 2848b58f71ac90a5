"""Operators against their SQL, on rows made to be awkward."""

import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideglass.llm import chat, decontaminate, jaccard, licenses, neardup, sql, urls
from tideglass.llm.license_texts import TEMPLATES
from tideglass.llm.words import hash_word


def plain(x):
    if x is None or x is pd.NA or isinstance(x, float) and pd.isna(x):
        return None
    x = x.item() if hasattr(x, "item") else x
    return int(x) if isinstance(x, float) and x == int(x) else x


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted(repr(tuple(map(plain, r))) for r in df[sorted(want.columns)].astype(object).itertuples(index=False)) for df in (got, want)]
    for a, b in zip(*rows, strict=True):
        assert a == b


def twin(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df)
    return con.sql(query).df()


def frame(spark, df, schema):
    rows = [tuple(None if isinstance(x, float) and pd.isna(x) else x for x in r) for r in df.itertuples(index=False)]
    return spark.createDataFrame(rows, schema).repartition(3)


def texts(seed, n):
    rng = random.Random(seed)
    bits = ["under the MIT License", "Apache License, Version 2.0", "CC BY-NC 4.0", "under the mit", "license", "Licensed under the GNU General Public License, version 3",
            "licensed under the terms of the gnu general public license either version 3", "copyright 2020 someone all rights reserved", "Copyright", "é", "word", "\n", "under\x00the mit license", "apache license version 2",
            "This is free and unencumbered software released into the public domain.", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]
    out = [" ".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 3, 12, 60]))) for _ in range(n)]
    return pd.DataFrame({"doc_id": range(n + 3), "text": [*out, None, "", "x " * 3000 + "under the mit license"]}).astype({"text": object})


def test_licenses(spark):
    df = texts(1, 300)
    df = pd.concat([df, df.iloc[:5]])
    got = licenses.license_scan(frame(spark, df, "doc_id long, text string").withColumn("labels", F.lit(1))).toPandas()
    assert got.labels.str.contains("gpl-3").any() and got.labels.str.contains("all-rights-reserved").any()
    same(got, twin(sql.licenses(), documents=df))


def test_automaton():
    a = licenses.Automaton("we [[all]] like {{2}} trees")
    for text, fits in (("we like trees", True), ("we all like tall green trees now", True), ("we like very tall green trees", False), ("we all trees", False), ("we like", False)):
        assert a.matches([hash_word(w.encode()) for w in text.split()]) is fits


def test_templates_through_the_scan(spark):
    """Any template against its regular expression: regions at both ends, nested ones, and none but optional words before the first run."""
    rng = random.Random(12)
    words = ["we", "all", "like", "tall", "trees", "and", "rivers"]
    templates = {"t": "we [[all]] like {{2}} trees", "u": "{{2}} like [[tall [[and {{1}}]] trees]] rivers", "v": "[[we]] [[all]] trees {{3}}", "w": "like like [[like]] trees"}
    docs = ["we like trees", "we all like tall and trees", "like rivers", "trees"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    got = licenses.license_scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), templates).collect()
    for r in got:
        line = "".join(f" {w} " for w in docs[r.doc_id].split())
        assert r.labels == ",".join(sorted(k for k, t in templates.items() if re.search(licenses.pattern(t), line))), docs[r.doc_id]
    assert {x for r in got for x in r.labels.split(",")} == {"", *templates}
    with pytest.raises(ValueError):
        licenses.Automaton("[[only]] {{2}}")


#: Notices as their publishers word them, with all labels that they must get (besides those of bare phrases).
NOTICES = {
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": {"cc-by-4.0"},
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"cc-by-sa-4.0"},
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": {"cc-by-nd-4.0"},
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": {"cc-by-nc-4.0"},
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": {"cc-by-nc-sa-4.0"},
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": {"cc-by-nc-nd-4.0"},
    "This work is licensed under the Creative Commons Attribution 3.0 Unported License.": {"cc-by-3.0"},
    "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License.": {"cc-by-nc-nd-3.0"},
    "licensed under a Creative Commons Attribution-Share Alike 2.5 Generic License": {"cc-by-sa-2.5"},
    "licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives License": {"cc-by-nc-nd"},
    "licensed under the Creative Commons Attribution NoDerivatives License": {"cc-by-nd"},
    "licensed under the Creative Commons Attribution Share Alike License": {"cc-by-sa"},
    "licensed under the Creative Commons Attribution License": {"cc-by"},
    "licensed under the Creative Commons Attribution Sampling License": set(),
    "licensed under a Creative Commons Attribution 7.0 License": set(),
    "This project is licensed under the terms of the MIT license.": {"mit"},
    "licensed under the terms of the MITRE license": set(),
    "licensed under the GNU General Public License v3.0": {"gpl-3"},
    "Licensed under the GNU General Public License, version 2": {"gpl-2"},
    "licensed under the GNU General Public License v1": set(),
    "licensed under the GNU Affero General Public License v3": {"agpl-3"},
    "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1": {"lgpl-2.1"},
    "under the GNU Lesser General Public License v3.0": {"lgpl-3"},
    "released under the Apache License 2.0": {"apache-2"},
    "released under the Apache License 1.1": set(),
    "released under the Apache License, Version 2.0": {"apache-2"},
}


def test_published_notices_and_their_nearest_others(spark):
    texts = list(NOTICES)
    got = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert set(filter(None, r.labels.split(","))) == NOTICES[texts[r.doc_id]], texts[r.doc_id]


def test_whole_licenses(spark):
    holder = "the copyright holders and contributors"
    docs = []
    for label, t in TEMPLATES.items():
        said = re.sub(r"\[\[|\]\]", " ", t)
        said = re.sub(r"\{\{(\d+)\}\}", lambda m: holder if int(m[1]) > 4 else "", said)
        label = label.partition("#")[0]
        docs += [(label, f"Copyright 2020 A. Person\n\n{said}\n end"), (label, f"x {said.upper()}"), ("", said.replace("the ", "thee "))]
    df = spark.createDataFrame([(i, x) for i, (_, x) in enumerate(docs)], "doc_id long, text string")
    for r in licenses.license_scan(df).collect():
        assert not docs[r.doc_id][0] or docs[r.doc_id][0] in r.labels.split(","), docs[r.doc_id]


def test_words_of_a_regular_build_do_not_meet(spark):
    """A word of 1,024 letters and its complement, which any polynomial modulo a power of two takes for one."""
    word = "a"
    for _ in range(10):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    assert hash_word(word.encode()) != hash_word(other.encode())
    docs = spark.createDataFrame([(1, " ".join([word] * 20)), (2, " ".join([other] * 20))], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.ngram_jaccard(docs).collect()) == [(1, 1), (2, 2)]
    items = spark.createDataFrame([(5, " ".join([word] * 13))], "item_id long, text string")
    assert sorted((r.doc_id, r.n_hit) for r in decontaminate.contamination(docs, items).collect()) == [(1, 20), (2, 0)]
    assert sorted((r.doc_id, r.labels) for r in licenses.license_scan(docs, {"x": f"{word} {word}"}).collect()) == [(1, "x"), (2, "")]


def test_contamination(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["é", "ß"]
    items = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 12, 13, 14, 40]))) for _ in range(40)] + [None, "", "!!", "a a a a a a a a a a a a a a a"]
    bench = pd.DataFrame({"item_id": [*range(len(items))], "text": items})
    bench = pd.concat([bench, bench.iloc[4:6]])
    docs = []
    for _ in range(200):
        parts = []
        for _ in range(rng.choice([0, 1, 4, 9])):
            it = (rng.choice(items) or "").split()
            a = rng.randrange(max(1, len(it)))
            parts += it[a : a + rng.choice([5, 12, 13, 20, 40])] if rng.random() < 0.6 else [rng.choice(words).upper() for _ in range(20)]
        docs.append(rng.choice([" ", ", ", "\n"]).join(parts))
    docs = pd.DataFrame({"doc_id": range(len(docs) + 4), "text": [*docs, None, "", "a " * 500, " ".join(items[3:20])]})
    docs = pd.concat([docs, docs.iloc[:3]])
    want = twin(sql.contamination(), documents=docs, benchmark=bench)
    df, it = frame(spark, docs, "doc_id long, text string").withColumn("n_hit", F.lit("x")), frame(spark, bench, "item_id long, text string")
    same(decontaminate.contamination(df, it).toPandas(), want)
    for few in (0, 10**9):
        monkeypatch.setattr(decontaminate, "FEW", few)
        same(decontaminate.contamination(df, it).toPandas(), want)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 200)
    same(decontaminate.contamination(df, it).toPandas(), want)
    kept = decontaminate.clean_documents(df, it).toPandas()
    assert sorted(kept.doc_id) == sorted(want[~want.contaminated].doc_id) and list(kept.columns) == df.columns
    assert decontaminate.contamination(df.limit(0), it).collect() == []
    assert decontaminate.contamination(df, it.limit(0)).where("n_hit > 0").count() == 0


def test_urls(spark):
    rng = random.Random(3)
    hosts = ["example.com", "www.Example.COM", "a.example.net", "example.net", "x.org", "org", "notexample.com", "example.com:80", "u@example.com", "", "com", "doubleclick.net", "ad.doubleclick.net"]
    paths = ["", "/", "/en/7", "/en/71?page=2", "/en", "/de/8/x#f", "/de/", "/es/q?sessionid=1", "/EN/7", "/login.php", "/search?q=1", "/cart/checkout", "/f.tar.zip", "/f.zip#a?b", "?page=x", "/loginx"]
    urls_ = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(500)] + [None, "", "no scheme/en/", "://com/en/", "a://b://com/en/", "http://com/en/?u=http://org/es/"]
    df = pd.DataFrame({"page_id": range(len(urls_)), "url": urls_})
    got = urls.url_filter(frame(spark, df, "page_id long, url string").withColumn("host", F.lit(0))).toPandas()
    assert {"com/en/", "example.com/en/7", "net/de/", "example.net/de/8", "org/es/"} == set(got.rule.dropna()) and (got.rule.isna() & (got.verdict == "block")).any()
    same(got, twin(sql.urls(), pages=df))
    assert urls.url_filter(frame(spark, df, "page_id long, url string").limit(0)).collect() == []


def test_indexed_rules_as_all_of_them():
    """The index against every rule's expression on every URL."""
    rng = random.Random(8)
    bits = [*urls.PAGES, *urls.FILES, *urls.JUNK, *urls.PARAMETERS, *urls.ADVERTS, "a", "Zip", "x1", "é", "en"]
    own = [urls.pattern_rule("block", p) for p in ("||a.x1^", "|http://en.", "*-en-*x1=", "/x1/*a|", "^zip^", "a*/en/", "%a^")]
    rules = urls.RULES + own
    index = urls.indexed(rules, {})
    seen = set()
    made = ["HTTP://q.a.x1:80/", "http://en.b/", "http://b/-en-9x1=", "//x1/2/a", "x?zip", "a-b/xa/en/", "http://b/?q=%a", "http://xa.x1/", "http://enx.b/", "zip2"]
    for _ in range(6000):
        made.append(rng.choice(["http://", "https://", "//", ""]) + "".join(rng.choice(bits) + rng.choice("/.-?&=#_%:^\n") for _ in range(rng.randrange(1, 5))) + rng.choice(["", "zip", "a"]))
    for url in made:
        host, path, rule, verdict = urls.judge(url, index)
        fits = [r for r in rules if r.name is None and r.compiled.search(url.translate(urls._LOWER))]
        assert verdict == ("block" if fits else "allow") if rule is None else True, url
        seen.update(r.pattern for r in fits)
    assert len(rules) > 280 and len(seen) > 150 and not {r.pattern for r in own} - seen
    with pytest.raises(ValueError):
        urls.pattern_rule("block", "*abc")


def test_chat(spark):
    rng = random.Random(4)
    bits = ["<|im_end|>", "<|", "<\\|", "<\\\\|x", "<", "|", "\\", "é", "\n", "hello ", "😀"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a\nb\\", None]), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 9])))) for c in range(40) for t in range(rng.randrange(1, 9))]
    df = pd.DataFrame([*rows, *rows[:6]], columns=["conv_id", "turn", "role", "text"])
    said = "<|im_end|><|im_start|>assistant ok"
    events = chat.conversation_events(frame(spark, pd.concat([df, pd.DataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], columns=df.columns)]), "conv_id long, turn long, role string, text string"))
    out = chat.formatted(events)
    same(chat.digests(out).toPandas(), twin(sql.chat(), conversations=df))
    for r in out.collect():
        assert r.segment.count("<|") == 2 and chat.render(*chat.parse(r.segment)) == r.segment
    assert chat.digests(chat.formatted(events.limit(0))).collect() == []


def test_chat_fold(spark):
    log = [(1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "a"), (1, 1, 3, "delta", None, "b"), (1, 1, 4, "regenerate", None, None),
           (1, 1, 5, "delta", None, "c"), (1, 1, 6, "delta", None, "d"), (1, 0, 7, "edit", None, "hello"), (2, 0, 0, "delta", "assistant", "x"), (None, None, None, "message", None, None)]
    rng = random.Random(1)
    rng.shuffle(log)
    got = chat.formatted(spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")).collect()
    assert sorted(((r.conv_id or 0, r.place, *chat.parse(r.segment), r.trained) for r in got)) == [(0, 0, "", "", False), (1, 0, "user", "hello", False), (1, 1, "assistant", "cd", True), (2, 0, "assistant", "x", True)]


@pytest.mark.parametrize("block", [512, 7])
def test_near_dups(spark, monkeypatch, block):
    import numpy as np

    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 16))
    v = [b + rng.standard_normal(16) * s for b in base for s in rng.choice([0.02, 0.1, 0.25], 12)]
    v += [v[0] * 3, v[0] * 3, v[5], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, None, [], [1.0, 2.0], [2.0, 4.1], [1e30] * 16, [1e-30] * 16]
    v = [None if x is None else [float(np.float32(y)) for y in x] for x in v] + [[None, 1.0]]
    rows = [(1000 - i, x) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("n_links", F.lit(0)).repartition(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    same(neardup.embedding_near_dups(df).toPandas(), con.sql(sql.near_dups()).df())
    assert neardup.embedding_near_dups(df.limit(0)).collect() == []


def test_recall_at_the_threshold():
    import numpy as np

    rng = np.random.default_rng(6)
    bits, tables = neardup.tables_for(1_000_000, 0.95)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((3000, 64))
    b -= (a * b).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    b = 0.95 * a + (1 - 0.95**2) ** 0.5 * b
    assert (neardup.codes(a, bits, tables) == neardup.codes(b, bits, tables)).any(axis=1).mean() > 0.99
