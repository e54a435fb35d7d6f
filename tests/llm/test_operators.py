"""Corpus operators against brute force, and their defined results for odd rows."""

from __future__ import annotations

import json
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, decontam, langid, licences, mixing, revisits, simhash, tokencount, toolcalls, topk, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, fp int, label string, key string, found double"


def documents(spark, rows):
    """Rows (doc_id, text, lang, source), with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "s", 2, "l", "k", 0.5) for r in rows], DOC)


ODD = [(1, None, "en", "a"), (2, "", None, None), (3, " \t\n", "en", "a"), (4, "word", None, "b"), (None, "no id here at all", "en", "b"), (5, "twice the same row", "en", "a"), (5, "twice the same row", "en", "a"), (6, "long " * 30_000, "en", "a"), (7, "12 34 !!", "de", ""), (8, "twice the same row", "en", "c")]


@pytest.fixture(scope="module")
def texts(spark):
    return [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text", "lang", "source").collect()]


# 1


def _plain_scan(text):
    words = licences.WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for p, label in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits}))


def test_licence_phrases(texts):
    scanner, rng = licences.Scanner(), random.Random(1)
    words = ["cc", "by", "BY", "all", "rights", "reserved", "general", "public", "license", "the", "É", "x", "Licensed", "under"]
    for text in [t for _, t, *_ in texts + ODD] + [" -".join(rng.choices(words, k=rng.randrange(40))) for _ in range(500)]:
        got = scanner.scan(text)
        assert tuple(got[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == _plain_scan(text)
        assert set(filter(None, got["base_labels"].split(","))) <= set(got["labels"].split(",")) and 0 <= got["score"] <= 1


def test_matching_statistics():
    rng = random.Random(2)
    lines = [[rng.randrange(1, 4) for _ in range(rng.randrange(1, 12))] for _ in range(8)]
    auto = licences.Automaton(lines)
    runs = {tuple(x[i:j]) for x in lines for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    text, state, length = [rng.randrange(1, 5) for _ in range(300)], 0, 0
    for i, x in enumerate(text):
        state, length = auto.step(state, length, x)
        assert length == max((n for n in range(13) if n <= i + 1 and tuple(text[i + 1 - n : i + 1]) in runs), default=0)
        if length:
            run = text[i + 1 - length : i + 1]
            assert set(auto.ends[state]) == {(k, j) for k, line in enumerate(lines) for j in range(length - 1, len(line)) if line[j + 1 - length : j + 1] == run}


def test_licence_templates():
    scan = licences.Scanner().scan
    assert scan("foo Licensed under the Apache License, Version 2.0. bar")["labels"] == "apache-2.0"
    assert scan("This work is licensed under the GNU General Public License, version 3.")["labels"] == "gpl,gpl-3.0"
    assert scan("Permission is hereby granted, free of charge, to any person who gets, obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction")["labels"] == "mit"
    assert scan("the of and under license")["labels"] == "" and scan(None)["score"] == 0


def _common(a, b):
    """Length of the longest common subsequence."""
    most = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            most[i + 1][j + 1] = most[i][j] + 1 if x == y else max(most[i][j + 1], most[i + 1][j])
    return most[-1][-1]


def test_planted_notices():
    """Every template is found where it stands, also with words changed, and nothing else is where none stands."""
    scanner, rng = licences.Scanner(), random.Random(17)
    fill = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    for label, texts in licences.TEMPLATES.items():
        for text in texts:
            line = [w.decode() for w in licences.words(text)]
            if len(line) < 12:
                continue
            for changed in (0, 1, 2):
                broken = list(line)
                for i in rng.sample(range(len(line)), changed):
                    broken[i] = fill(1)[0]
                before = fill(rng.randrange(30))
                got = scanner.scan(" ".join([*before, *broken, *fill(rng.randrange(30))]))
                spans = [s for s in got["spans"] if s["label"] == label]
                if not changed:
                    assert (label, len(before), len(before) + len(line)) in {(s["label"], s["start"], s["stop"]) for s in spans}, text
                    assert got["score"] == pytest.approx(1)
                for s in spans:  # what a span claims is there: so many words of one of the label's templates, in its order
                    there = [*before, *broken][s["start"] : s["stop"]]
                    assert any(s["covered"] * len(other) <= _common(there, other) + 1e-6 for other in ([w.decode() for w in licences.words(x)] for x in texts))
    assert all(scanner.scan(" ".join(fill(300)))["labels"] == "" for _ in range(20))


# 2


def test_tool_calls(spark):
    schema = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}, "additionalProperties": False}}
    calls = [(1, "c1", 0, "add", '{"a": 1}', None), (1, "c2", 1, "add", '{"a":"x"}', ["c1"]), (1, "c3", 2, "add", "nope", ["c2", "none"]), (1, "c1", 5, "add", '{"a":9}', None), (2, "p", 0, "add", '{"a":1}', ["q"]), (2, "q", 1, "other", '{"b":[2,1],"a":"é"}', []), (3, "x", 0, "add", '{"a":1}', ["y"]), (3, "y", 1, "add", '{"a":1}', ["x"]), (3, "z", 2, "add", None, ["y"]), (None, "n", 0, "add", "{}", None)]
    results = [(1, "c1", 1, '{"r": 1}'), (1, "c1", 2, "late"), (2, "q", 3, None), (9, "gone", 1, "1"), (1, None, 1, "1")]
    make = lambda: toolcalls.link(spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>"), spark.createDataFrame(results, "conv_id long, call_id string, turn long, result string"), schema)
    got = {(r.conv_id, r.call_id): r for r in make().collect()}
    assert {k: r.status for k, r in got.items()} == {(1, "c1"): "linked", (1, "c2"): "open", (1, "c3"): "open", (2, "p"): "open", (2, "q"): "linked", (3, "x"): "open", (3, "y"): "open", (3, "z"): "open", (9, "gone"): "orphan"}
    assert got[1, "c1"].canonical == '{"arguments":{"a":1},"id":"c1","name":"add","needs":[],"result":"late"}' and got[1, "c1"].n_results == 2
    assert [got[1, c].place for c in ("c1", "c2", "c3")] == [1, 2, 3] and (got[2, "q"].place, got[2, "p"].place) == (1, 2)
    assert got[3, "x"].level is None and got[3, "z"].level is None and sorted(got[3, c].place for c in "xyz") == [1, 2, 3]
    assert got[1, "c2"].problem == "$.a: not of type integer" and got[1, "c3"].problem == "$: not JSON" and got[2, "q"].problem == "$: unknown tool" and got[2, "p"].problem is None
    assert '"a":"é","b":[2,1]' in got[2, "q"].canonical
    small, toolcalls.SMALL = toolcalls.SMALL, 1
    try:
        assert {(r.conv_id, r.call_id): (r.place, r.level) for r in make().collect()} == {k: (r.place, r.level) for k, r in got.items()}
    finally:
        toolcalls.SMALL = small


def test_tool_call_query(spark):
    rows = toolcalls.op2_tool_call_linking(spark, SF).collect()
    turns = common.table(spark, SF, "conversations").collect()
    assert len([r for r in rows if r.status != "orphan"]) == sum(r.role != "assistant" for r in turns)
    by = {(r.conv_id, r.turn): r for r in turns}
    for r in rows:
        if r.status == "linked":
            assert json.loads(r.canonical)["result"]["reply"] == by[r.conv_id, r.result_turn].text


def test_levels_are_chains_of_needs(spark, monkeypatch):
    """Random graphs of needs, by one task and by joins: a call's level is one above its highest need's, and it comes after all of them."""
    rng = random.Random(12)
    calls = [(conv, f"c{i}", rng.choice([None, rng.randrange(9)]), "t", "1", [f"c{rng.randrange(12)}" for _ in range(rng.choice([0, 1, 1, 2]))]) for conv in range(30) for i in range(10)]
    make = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>")
    none = spark.createDataFrame([], "conv_id long, call_id string, turn long, result string")
    got = toolcalls.link(make, none, {}).collect()
    needs, at = {(c, i): {(c, n) for n in need} for c, i, *_, need in calls}, {(r.conv_id, r.call_id): r for r in got}
    cyclic = 0
    for k, r in at.items():
        below = [at[n].level for n in needs[k] if n in at]
        assert r.level == (None if None in below else max(below, default=-1) + 1) or (r.level is None and below)
        cyclic += r.level is None
        assert r.level is None or all(at[n].place < r.place for n in needs[k] if n in at)
    for k, r in at.items():  # a call without a level leads to a cycle
        if r.level is None:
            seen, front = set(), {k}
            while front - seen:
                seen |= front
                front = {n for x in front for n in needs[x] if n in at and at[n].level is None}
            assert front
    assert 0 < cyclic < len(at) and sorted(r.place for r in got if r.conv_id == 3) == list(range(1, 11))
    monkeypatch.setattr(toolcalls, "SMALL", 3)
    assert sorted((r.conv_id, r.call_id, r.level or -1, r.place) for r in toolcalls.link(make, none, {}).collect()) == sorted((r.conv_id, r.call_id, r.level or -1, r.place) for r in got)


def test_texts_that_json_or_utf8_lacks(spark):
    calls = [(1, "a", 0, "t", '{"a":"\\ud800", "\\udfff":1}', None), (1, "b", 1, "t", '{"a":NaN}', None), (1, "c", 2, "t", "[Infinity]", None)]
    make = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>")
    got = {r.call_id: r for r in toolcalls.link(make, spark.createDataFrame([(1, "a", 1, '"\\udc00"')], "conv_id long, call_id string, turn long, result string"), {"t": {"additionalProperties": {"type": "string"}}}).collect()}
    assert json.loads(got["a"].canonical)["arguments"] == {"a": "\ud800", "\udfff": 1} and "udfff" in got["a"].problem
    assert got["b"].problem == got["c"].problem == "$: not JSON" and json.loads(got["b"].canonical)["arguments"] == '{"a":NaN}'


def test_queries_against_sql(spark):
    """Also that the rows made from the tables are not all alike."""
    import duckdb

    from tidemark.llm import registry

    d, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in "conversations pages embeddings".split():
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    rows = {}
    for name, sql in registry.ORACLE_SQL.items():
        got, df = con.execute(sql), registry.QUERIES[name](spark, d)
        names = [x[0] for x in got.description]
        assert sorted(names) == sorted(df.columns)
        rows[name] = df.collect()
        assert sorted((tuple(r[c] for c in names) for r in rows[name]), key=repr) == sorted(got.fetchall(), key=repr), name
    assert {r.status for r in rows["op3_warc_revisits"]} == {"resolved", "unchecked", "mismatch", "no_response"}
    assert len({r.level for r in rows["op2_tool_call_linking"]}) > 3 and len({r.problem and r.problem[:10] for r in rows["op2_tool_call_linking"]}) > 1


# 3


def test_revisits(spark):
    rng, urls = random.Random(3), ["http://A.com/x", "https://www.a.com/x/#top", "http://a.com/x?utm_source=f", "http://b.org/?b=1&a=2", "https://b.org?a=2&b=1", None, ""]
    record = lambda i: (i, rng.choice(urls), rng.choice([*range(30), None]), rng.choice(["d1", "d2", None]), {"etag": rng.choice(['"e"', 'W/"e"', '"f"']), "date": str(i), "x": str(i)})
    full, again = [record(i) for i in range(60)], [record(i) for i in range(100, 160)]
    schema = "record_id long, url string, time long, digest string, headers map<string,string>"
    key = {u: r for u, r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", revisits.canonical_url(F.col("u"))).collect()}
    assert len({key[u] for u in urls[:3]}) == 1 and key[urls[3]] == key[urls[4]] == "b.org?a=2&b=1" and key[None] is None
    got = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(full, schema), spark.createDataFrame(again, schema)).collect()}
    assert len(got) == len(again)
    for i, url, time, digest, headers in again:
        at = max(((t, j) for j, u, t, *_ in full if key[u] and key[u] == key[url] and time is not None and t is not None and t < time), default=None)
        assert got[i].response_id == (at and at[1]), (i, url, time)
        if at:
            old = full[at[1]]
            fits = digest == old[3] if digest and old[3] else headers["etag"].removeprefix("W/") == old[4]["etag"].removeprefix("W/")
            assert got[i].status == ("resolved" if fits else "mismatch")
            assert not fits or got[i].headers == old[4] | {"etag": headers["etag"], "date": headers["date"]}
        else:
            assert got[i].status == "no_response" and got[i].headers is None
    assert not revisits.resolve(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count()


# 4


def test_edits(texts):
    encode, rng = tokencount.encoder().encode_ordinary, random.Random(4)
    for _, text, *_ in texts[:60] + [(0, "", 0, 0), (0, "x" * 3000, 0, 0), (0, " \n" * 500, 0, 0)]:
        text, doc = text[:4000], tokencount.Counted(text[:4000], encode, rng.choice([4, 16, 64, 512]))
        assert doc.count == len(encode(text))
        for _ in range(6):
            a, new = rng.randrange(len(text) + 1), rng.choice(["", "", " ", "  ", "\n", "x", " ab", "'s", "l ", " \n ", text[:50]])
            b = a + rng.choice([0, 0, 1, 5, 100])
            text = text[:a] + new + text[b:]
            doc.edit(a, b, new)
            assert doc.text() == text and doc.count == len(encode(text))
            again = tokencount.Counted(text, None, doc.size, doc.tree())  # encodes nothing
            assert again.count == doc.count and again.text() == text


def test_leaves_stay_small_after_insertions():
    text, size = " ".join(f"word{i}" for i in range(5_000)), tokencount.BLOCK
    doc = tokencount.Counted("a b", tokencount.encoder().encode_ordinary)
    for at in (1, 20_000, 30):
        doc.edit(at, at, text)
        assert max(map(len, doc.leaves)) < 2 * size and doc.count == len(doc.encode(doc.text()))
    before = doc.encoded
    for at in (7, 55_555, 90_000):
        doc.edit(at, at + 1, "Z")
    assert doc.encoded - before < 3 * 4 * size and doc.count == len(doc.encode(doc.text()))


def test_kept_trees(spark):
    """Counts that go on from trees read back from a table are those made anew; nulls are defined."""
    rows = [(1, "some words " * 400, [(5, 9, "x"), None, (None, None, None)]), (2, None, [(0, 0, "new")]), (3, "", None)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, edits {tokencount.EDITS}")
    kept = common.cut(docs.withColumn("tree", tokencount.trees(F.col("text"))))
    got = kept.select("doc_id", tokencount.counts(F.col("text"), F.col("edits"), F.col("tree")).alias("a"), tokencount.counts(F.col("text"), F.col("edits")).alias("b")).orderBy("doc_id").collect()
    assert all(r.a == r.b for r in got) and [r.a.edits for r in got] == [2, 1, 0] and got[0].a.encoded < 2 * 4 * tokencount.BLOCK


def test_edits_encode_little():
    text = " ".join(f"word{i}" for i in range(20_000))
    doc = tokencount.Counted(text, tokencount.encoder().encode_ordinary)
    doc.edit(50_000, 50_010, "changed")
    assert doc.encoded < 4 * tokencount.BLOCK


def test_token_query(spark):
    got = tokencount.op4_edit_aware_counts(spark, SF)
    docs = {r.doc_id: r for r in common.table(spark, SF, "documents").withColumn("e", tokencount.made_edits(F.col("doc_id"), F.col("text"))).collect()}
    encode = tokencount.encoder().encode_ordinary
    for r in got.collect():
        text = docs[r.doc_id].text
        assert r.tokens_before == len(encode(text))
        for e in docs[r.doc_id].e:
            text = text[: e.start] + (e.text or "") + text[e.stop :]
        assert r.tokens_after == len(encode(text)) and r.chars_after == len(text)


# 5


def test_language(spark):
    got = langid.op5_language_mixture(spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang]
    assert len(got) == 1000 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_mixture_and_odd_rows(spark, texts):
    model = langid.fit(documents(spark, texts))
    by = defaultdict(str)
    for _, text, lang, _ in texts:
        by[lang] += text + "\n"
    mixed = by["en"][:3000] + " " + by["fr"][:3000]
    lang, share, names = langid.infer(*model, mixed)
    assert names == "en,fr" and 0.35 < share < 0.65 and langid.infer(*model, by["de"][:2000]) == ("de", pytest.approx(1, abs=0.1), "de")
    got = documents(spark, ODD).select("doc_id", langid.identify(model, F.col("text")).alias("f")).collect()
    assert len(got) == len(ODD) and [r.f.lang for r in got[:3]] == ["und"] * 3 and got[8].f.lang == "und"
    assert langid.fit(documents(spark, []))[0] == [] and langid.infer([], np.zeros((1, 0)), "x") == ("und", 0.0, "")


def test_shares_against_a_grid():
    """EM finds the likeliest shares, and the chosen set has the highest penalised likelihood of all sets."""
    from itertools import combinations, product

    rng = np.random.default_rng(31)
    for _ in range(25):
        table = rng.dirichlet(np.full(60, 0.3), 3).T.astype(np.float32) + 1e-6
        truth = rng.choice([[1, 0, 0], [0.5, 0.5, 0], [0.3, 0, 0.7], [0.3, 0.3, 0.4]])
        counts = rng.multinomial(600, (table @ truth) / (table @ truth).sum()).astype(np.float32)
        value = lambda share: float(counts @ np.log(np.maximum(table @ np.asarray(share), 1e-30)))
        share, found = langid.proportions(table, counts, np.full(3, 1 / 3, np.float32), 200)
        grid = [(a / 20, b / 20, 1 - a / 20 - b / 20) for a, b in product(range(21), repeat=2) if a + b <= 20]
        assert found == pytest.approx(value(share), rel=1e-3) and found >= max(map(value, grid)) - 0.5
        cost = lambda n: langid.PENALTY * (n - 1) * np.log(counts.sum() + 1)
        sets = {s: langid.proportions(table, counts, np.array([(k in s) / len(s) for k in range(3)], np.float32), 200)[1] - cost(len(s)) for n in (1, 2, 3) for s in combinations(range(3), n)}
        chosen = langid.choose(table, counts, langid.proportions(table, counts, np.full(3, 1 / 3, np.float32), langid.STEPS)[0])
        assert sets[tuple(np.flatnonzero(chosen).tolist())] == pytest.approx(max(sets.values()), abs=0.5)


# 6


def _water(sizes):
    w = {k: i % 3 + 1 for i, k in enumerate(sorted(sizes, key=lambda k: (k is None, k)))}
    full, total = {}, sum(sizes.values())
    while True:
        rest = [k for k in sizes if k not in full]
        share = {k: (total - sum(full.values())) * w[k] / sum(w[x] for x in rest) for k in rest}
        over = [k for k in rest if share[k] > 3 * sizes[k]]
        if not over:
            return full | share
        full |= {k: 3.0 * sizes[k] for k in over}


@pytest.mark.parametrize("close", [512, 20])
def test_mixing(spark, monkeypatch, close):
    monkeypatch.setattr(mixing, "CLOSE", close)
    monkeypatch.setattr(mixing, "FAN", 8)
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), "en", rng.choice(["a", "a", "a", "b", "c", "tiny", None])) for i in range(900)] + ODD + [(2000, "one two", "en", "zz")]
    rows = [r if r[3] != "tiny" or i < 40 else (*r[:3], "a") for i, r in enumerate(rows)]
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r[0] or -1, size(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want, taken = _water(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        assert r.size == 0 and r.taken == 0 or r.taken % r.size == 0
        taken[r.source] += r.taken
    for k, most in want.items():
        assert abs(taken[k] - most) <= max(size(r[1]) for r in rows if r[3] == k)
    again = mixing.mix(documents(spark, rows).repartition(5, "text")).collect()
    order = lambda x: sorted((r.doc_id or -1, r.size, r.taken) for r in x)
    assert order(again) == order(got)


def test_targets_in_ranges(spark, monkeypatch):
    """Sums over ranges of sources give the targets that a plain reading of the rule does."""
    rng = random.Random(16)
    sizes = {f"a{rng.randrange(10**9)}": int(rng.lognormvariate(4, 2.5)) for _ in range(300)}
    rows = spark.createDataFrame([(k, n, 1) for k, n in sizes.items()], "key string, source_size long, n long").repartition(7)
    for most in (10_000, 20):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", most)
        assert {r.key: r.target for r in mixing.targets(rows).collect()} == pytest.approx(_water(sizes))
    assert not mixing.targets(rows.limit(0)).count()


def test_mixing_draws_are_fair(spark, monkeypatch):
    """Over many seeds each document is taken as often as its probability says."""
    rows = [(i, "w " * n, "en", s) for s, k in (("a", 0), ("b", 100)) for i, n in enumerate([1, 2, 3, 5, 8, 13, 21], k)]
    n, sums, squares = 40, defaultdict(float), defaultdict(float)
    for seed in range(n):
        monkeypatch.setattr(mixing, "SEED", seed)
        for r in mixing.mix(documents(spark, rows)).collect():
            off = r.taken / r.size - r.target / r.source_size
            sums[r.doc_id] += off
            squares[r.doc_id] += off * off
    # four standard errors of the draws seen, for 14 documents
    assert all(abs(sums[i]) / n <= 4 * max(squares[i] / n, 0.01) ** 0.5 / n**0.5 for i in sums), dict(sums)


def test_sources_come_near_their_targets(spark):
    """Fifty documents a source, some of thousands of words: within 2 % all the same."""
    got = mixing.mix(common.table(spark, "/root/testdata/sf0.01", "documents")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) > 15 and all(abs(r.taken - r.target) <= 0.02 * r.target for r in got), [(r.source, r.taken, r.target) for r in got if abs(r.taken - r.target) > 0.02 * r.target]


def test_mixing_of_nothing(spark):
    assert not mixing.mix(documents(spark, [])).count()
    assert [r.taken for r in mixing.mix(documents(spark, [(1, None, "en", "a")])).collect()] == [0]


# 7


def _print(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42) for i in range(max(1, len(words) - width + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(fps):
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                label[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("run", [4096, 2])
def test_simhash(spark, texts, monkeypatch, run):
    monkeypatch.setattr(simhash, "RUN", run)
    rng = random.Random(7)
    rows = texts + ODD + [(1000 + i, " ".join(w if rng.random() > 0.004 else "changed" for w in texts[i % 5][1].split()), "en", "a") for i in range(60)]
    got = simhash.cluster(documents(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.fp) for r in got) == sorted((i or -1, int(np.array(_print(t), np.uint64).view(np.int64))) for i, t, *_ in rows)
    fps = [r.fp & (1 << 64) - 1 for r in got]
    least = defaultdict(lambda: 10**9)
    roots = _components(fps)
    for r, k in zip(got, roots, strict=True):
        least[k] = min(least[k], 10**9 if r.doc_id is None else r.doc_id)
    assert [10**9 if r.component_id is None else r.component_id for r in got] == [least[k] for k in roots]


def test_links_of_near_fingerprints(spark, monkeypatch):
    """Many fingerprints within a few bits of each other, so that long runs take the second way."""
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for b in base for _ in range(80)})
    signed = [int(np.array(x, np.uint64).view(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = _components(fps)
    for run in (4096, 5, 1):
        monkeypatch.setattr(simhash, "RUN", run)
        label = {r.node: r.label for r in common.components(simhash.links(df)).collect()}
        groups = defaultdict(set)
        for x, k in zip(signed, want, strict=True):
            groups[k].add(label.get(x, x))
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 7, 100])
def test_long_runs_across_batches(monkeypatch, size):
    """Of runs over RUN every row is sent on, wherever batches end; other runs give links."""
    monkeypatch.setattr(simhash, "RUN", 4)
    lengths = {1: 2, 5: 6, 6: 7, 7: 9, 8: 3, 9: 11, 10: 12, 11: 1, 12: 5}
    rows = [(k, k << 40 | 1 << i) for k, n in lengths.items() for i in range(n)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows[at : at + size]], pa.int64()) for j in (0, 1)], ["key", "fp"]) for at in range(0, len(rows), size)]
    got = [r for b in simhash._links(iter(batches)) for r in b.to_pylist()]
    assert sorted((r["key"], r["a"]) for r in got if r["b"] is None) == sorted(x for x in rows if lengths[x[0]] > 4)
    assert sum(r["b"] is not None for r in got) == 1 + 2


# 8


def _plain_tiles(doc, item, least):
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return out
        out.append(n)
        free_d[i : i + n] = free_i[j : j + n] = [False] * n


def test_tiling_against_plain():
    rng = random.Random(9)
    for _ in range(150):
        doc, item = ([rng.randrange(1, 5) for _ in range(rng.randrange(1, 60))] for _ in range(2))
        got = decontam.tile(doc, item, 3)
        free = [0] * len(doc), [0] * len(item)
        for i, j, n in got:
            assert doc[i : i + n] == item[j : j + n] and n >= 3
            for side, at in zip(free, (i, j), strict=True):
                for k in range(at, at + n):
                    side[k] += 1
        assert max(*free[0], *free[1]) <= 1
        assert sorted(n for *_, n in got) == sorted(_plain_tiles(doc, item, 3))


def test_matches_against_plain_tiles():
    """Items found, tiles and coverage of reordered, cut and broken passages, from all tiles of all items."""
    rng = random.Random(19)
    items = [(k, [f"i{rng.randrange(400)}" for _ in range(rng.choice([2, 4, 8, 20, 45]))]) for k in range(25)]
    index, seen = decontam.Index([(k, " ".join(x)) for k, x in items]), 0
    for _ in range(60):
        doc = [f"f{rng.randrange(10**6)}" for _ in range(15)]
        for _, x in rng.sample(items, 3):
            at = rng.randrange(len(x))
            doc += [*x[at:], "and", *x[:at]] if rng.random() < 0.6 else [w if rng.random() > 0.1 else "gone" for w in x]
        number = {w: i + 1 for i, w in enumerate(sorted({*doc, *(w for _, x in items for w in x)}))}
        want = []
        for k, x in items:
            line, text = [number[w] for w in x], [number[w] for w in doc]
            tiles = _plain_tiles(text, line, min(decontam.LEAST, len(x)))
            covered = sum(tiles) if len(x) >= decontam.LEAST else max([n for n in tiles if n == len(x)], default=0)
            if covered >= 0.5 * len(x):
                want.append((k, len(tiles) if len(x) >= decontam.LEAST else 1, covered, covered / len(x)))
                seen += len(tiles) > 1
        assert [(r["item_id"], r["n_tiles"], r["covered"], r["coverage"]) for r in index.match(" ".join(doc))] == want
    assert seen > 10


def test_decontamination(spark):
    words = [f"w{i}" for i in range(40)]
    rng, fill = random.Random(10), lambda n: " ".join(f"f{rng.randrange(10**6)}" for _ in range(n))
    line = lambda *parts: " ".join(w for p in parts for w in (p.split() if isinstance(p, str) else p))
    rows = [(1, line(fill(30), words, fill(9))), (2, line(words[20:], fill(8), words[:20])), (3, line(fill(20), words[:10], fill(20))), (4, fill(60)), (5, line(words[:7], "x", words[8:15], "y", words[16:30])), (6, " ".join(words).upper().replace(" ", ", ")), (7, None), (8, ""), (None, " ".join(words)), (1, " ".join(words))]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "too short"), (3, None), (None, fill(20)), (1, " ".join(words[:12]))], "item_id long, text string")
    docs = documents(spark, [(*r, "en", "a") for r in rows])
    got = sorted((r.doc_id or -1, r.item_id, r.n_tiles) for r in decontam.contaminated(docs, bench).collect())
    assert [(d, i) for d, i, _ in got] == [(-1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (5, 1), (6, 1)] and (2, 1, 2) in got
    assert not decontam.contaminated(docs, bench.where("item_id = 2")).count()
    some = documents(spark, [(1, "It is, too short!", "en", "a"), (2, "too long and short", "en", "a")])
    assert [tuple(r) for r in decontam.contaminated(some, bench).collect()] == [(1, 2, 1, 2, 2, 1.0)] and not decontam.contaminated(docs.limit(0), bench).count()


def test_decontamination_in_blocks(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    one = {tuple(r) for r in decontam.op8_string_tiling(spark, sf).collect()}
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 2000)
    assert one and {tuple(r) for r in decontam.op8_string_tiling(spark, sf).collect()} == one


# 9


def test_top_k(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(700, 48)).astype(np.float32)
    v[300:310] = v[0]  # ties
    rows = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)] + [(900, None), (1000, []), (1001, [float("nan")] * 48), (1002, [1.0, None] * 24), (1003, [1.0] * 3), (None, [1.0] * 48), (17, [float(x) for x in v[17]])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, score int, rank string")
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    whole = np.floor(1024 * v.astype(np.float64)).astype(np.int64)
    ids = np.array([*range(700), 17])
    scores = whole[np.append(np.arange(700), 17)] @ whole.T
    for q in range(0, 700, 100):
        order = [i for i in np.lexsort((ids, -scores[:, q])) if ids[i] != q][:10]
        assert got[q] == [(int(scores[i, q]), int(ids[i])) for i in order]
    assert set(got) == set(range(0, 700, 100))
    assert not topk.top_k(df.limit(0), F.lit(True)).count()


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(i, [1e9] * 4) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(df, F.col("vec_id") == 0).collect()


# 10


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op10_toxicity(spark, sf).join(common.table(spark, sf, "labels"), "doc_id", "left").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    clean = [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    held = [r for r in got if r.toxic == 1 and r.held_out]
    assert sum(r.predicted for r in held) >= 0.5 * len(held)


def test_weights_and_scores_against_counting(spark):
    """Weights by plain counts over labelled documents, one of each group of copies, in the two passes; scores by the highest."""
    rng, noise = random.Random(14), [f"word{i}" for i in range(30)]
    text = lambda bad: " ".join(rng.choices(noise, k=12) + ([rng.choice(["grobian", "lumpen"]), rng.choice(["hund", "sau"])] if bad else []))
    rows = [(i, text(i % 3 == 0)) for i in range(240)] + [(500 + i, "lumpen word1 word2 word3 word4 grobian again") for i in range(9)] + [(900, None), (901, "")]
    toxic = {i: int(i % 3 == 0 or i >= 500) for i, _ in rows if i != 3}
    learned = {r.i for r in spark.createDataFrame([(i,) for i, _ in rows], "i long").where(~common.held_out(F.col("i"))).collect()} & toxic.keys()
    one = {}
    for i, t in sorted(rows):
        if i in learned:
            h = simhash.shingle_hashes(t, 5)
            one.setdefault((int(h.min().view(np.int64)) if len(h) else 0, toxic[i]), (t, toxic[i]))

    def weights(skip):
        n, bad = defaultdict(int), defaultdict(int)
        for t, y in one.values():
            had = toxicity.features({toxicity.bare(w) for w in (t or "").lower().split()})
            if not had & skip:
                for f in had:
                    n[f] += 1
                    bad[f] += y
        z, out = toxicity.Z, {}
        for f in n:
            p = bad[f] / n[f]
            low = (p + z * z / (2 * n[f]) - z * (p * (1 - p) / n[f] + z * z / (4 * n[f] ** 2)) ** 0.5) / (1 + z * z / n[f])
            if low >= toxicity.LEAST:
                out[f] = low
                assert bad[f] >= 2
        return out

    first = weights(set())
    strong = {f: w for f, w in first.items() if w >= toxicity.STRONG * max(first.values())}
    want = strong | {f: w for f, w in weights(strong.keys()).items() if f not in strong}
    model = toxicity.fit(documents(spark, [(i, t, "en", "a") for i, t in rows]), spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int"))
    assert model.weights == pytest.approx(want) and len(want) > 5
    base = min(toxicity.MOST_BASE, sum(y for _, y in one.values()) / len(one))
    for _, t in rows:
        had = {f for reading in toxicity.Reader(model.lm).words(t) for f in toxicity.features(reading)}
        assert model.score(t) == pytest.approx(max([base, *(want[f] for f in had if f in want)]))


def test_deobfuscation(spark, texts):
    docs = [(i, "you are an idiot and a loser" if i % 5 == 0 else "the end of all that was here", "en", "a") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents(spark, docs + texts + ODD), labels)
    reader = toxicity.Reader(model.lm)
    assert reader.restore("1d10t", False) == "idiot" and reader.restore("l0$er", False) == "loser" and reader.restore("iiiidiooot", False) == "idiot" and reader.restore("l o s e r", True) == "loser"
    for bad in ("an 1d10t!", "what a l o s e r", "l-o-s-e-r", "IDIOT", "idiooooot.", "l0ser"):
        assert model.score(bad) > 0.6, bad
    assert model.score("") == model.score(None) == model.base
    for good in ("", None, "the end", "12345 67", "a b c d", "!!! ???", "word " * 20_000):
        assert model.score(good) < 0.3
    got = documents(spark, ODD).select(toxicity.toxicity(model, F.col("text")).alias("s")).collect()
    assert len(got) == len(ODD)
    assert toxicity.fit(documents(spark, ODD), labels.limit(0)).score("idiot") == 0


def test_signs_at_the_ends_of_words(spark, texts):
    docs = [(i, "you are an idiot and a stupid loser" if i % 5 == 0 else "the end of all that was here", "en", "a") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents(spark, docs + texts + ODD), labels)
    for bad in ("so $tupid", "an !diot.", "($tupid)", "a |oser", "$7upid", "idiot!", "(idiot)", "(1d10t)", "$tupid and stupid!", "@n !diot, $tupid"):
        assert model.score(bad) > 0.6, bad
    for good in ("the end!", "(the end)", "$100 + $5", "!$@ +", "here! (all)", "", None):
        assert model.score(good) < 0.3, good
    first, second, _ = toxicity.Reader(model.lm).words("a $tupid idiot!")
    assert {"tupid", "idiot"} <= first and "stupid" in second and "idiot" not in second
    assert toxicity.Reader(model.lm).words("no sign, at all.") == [{"no", "sign", "at", "all"}]


def test_viterbi_is_exhaustive():
    rng = np.random.default_rng(12)
    lm = np.log(rng.dirichlet(np.ones(64), size=(64, 64))).astype(np.float32)
    from itertools import product

    for word in ("a1b0", "c0o1", "5aaa1"):
        places = toxicity.lattice(word)
        best = []
        for way in product(*places):
            said, total, x, y = "".join(w for w, _ in way), sum(c for _, c in way), 0, 0
            for c in said + " ":
                z = toxicity.of(c)
                total -= float(lm[x, y, z])
                x, y = y, z
            best.append((total, said))
        assert toxicity.viterbi(places, lm) == min(best)[1]


def test_tool_calls_with_null_needs_and_huge_numbers(spark):
    rows = [(1, "a", 1, "t", "1" + "0" * 400, None), (1, "b", 2, "t", "2", ["a", None])]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([], "conv_id long, call_id string, turn long, result string")
    got = {r.call_id: r for r in toolcalls.link(calls, results, {"t": {"type": "integer"}}).collect()}
    assert got["a"].problem is None and got["b"].problem is None
    assert (got["a"].place, got["b"].place) == (1, 2)
    assert '"needs":["a"]' in got["b"].canonical


def test_calls_without_a_turn_come_after_their_needs(spark):
    calls = [(1, "a", 5, "t", "1", None), (1, "b", None, "t", "1", ["a"]), (2, "c", None, "t", "1", ["d"]), (2, "d", None, "t", "1", []), (3, "e", 1, "t", "1", ["f"]), (3, "f", None, "t", "1", [])]
    make = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, needs array<string>")
    got = {r.call_id: (r.place, r.level) for r in toolcalls.link(make, spark.createDataFrame([], "conv_id long, call_id string, turn long, result string"), {}).collect()}
    assert got == {"a": (1, 0), "b": (2, 1), "d": (1, 0), "c": (2, 1), "f": (1, 0), "e": (2, 1)}


def test_all_features_count(spark, monkeypatch, caplog):
    docs = [(i, f"idiot{i} loser {i}" if i % 2 == 0 else f"the end {i}", "en", "a") for i in range(200)]
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    want = toxicity.fit(documents(spark, docs), labels)
    monkeypatch.setattr(toxicity, "MOST_FEATURES", 1)
    got = toxicity.fit(documents(spark, docs), labels)
    assert got.weights == want.weights and len(want.weights) > 1
    assert "features" in caplog.text
