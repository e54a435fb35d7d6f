"""The pipeline's stages against what each should keep."""

from __future__ import annotations

import importlib.util
import random
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, decontam, langid, mixing, nearcopies, simhash, toxicity

SF = "/root/testdata/sf0.01"


def _groups(rows) -> set[int]:
    """The least id of each group, by comparing all pairs."""
    rows = sorted(rows, key=lambda r: r.doc_id)
    hashes = [simhash.shingle_hashes(r.text, nearcopies.WORDS) for r in rows]
    sets, fps = [frozenset(h.tolist()) for h in hashes], [simhash.majority(h) & (1 << 64) - 1 for h in hashes]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= simhash.DISTANCE or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {rows[root(i)].doc_id for i in range(len(rows))}


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def _copies(rng: random.Random) -> list[str]:
    """Texts with edited copies, chains of copies in which only neighbours are similar, and texts with a line in common."""
    texts = []
    for size in (6, 12, 30, 60, 140, 400, 1500):
        for _ in range(6):
            words = [f"w{rng.randrange(3000)}" for _ in range(size)]
            texts.append(" ".join(words))
            for k in range(1, 5):
                texts.append(" ".join(w if rng.random() > 0.008 * k else "x" + w for w in words))
    for size in (7, 25, 90, 300):
        for _ in range(4):
            words = [f"w{rng.randrange(3000)}" for _ in range(size)]
            for _ in range(12):
                texts.append(" ".join(words))
                words = words[max(1, size // 40) :] + [f"w{rng.randrange(3000)}" for _ in range(max(1, size // 40))]
    common_line = " ".join(f"c{i}" for i in range(12))
    texts += [f"{common_line} {rng.random()} {rng.random()}" for _ in range(60)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("few", "chunk"), [(32, 1 << 20), (1, 1 << 20), (3, 700)])
def test_near_copies(spark, monkeypatch, few, chunk):
    """By pairs, by groups, and by groups of many chunks."""
    monkeypatch.setattr(nearcopies, "FEW", few)
    monkeypatch.setattr(nearcopies, "CHUNK", chunk)
    monkeypatch.setattr(nearcopies, "HUBS", 2)
    docs = _docs(spark, _copies(random.Random(few)))
    assert sorted(r.doc_id for r in nearcopies.stage(spark, docs, SF).collect()) == sorted(_groups(docs.collect()))


def test_similar_sets_share_a_prefix():
    """What the join rests on: as many shingles as stated are in both prefixes, also at a similarity of just 0.8."""
    rng = random.Random(4)
    for _ in range(3000):
        n = rng.randrange(1, 80)
        a, more = set(rng.sample(range(10**6), n)), rng.randrange(0, n // 4 + 1)
        gone = rng.randrange(0, n // 5 + 1)
        b = set(rng.sample(sorted(a), n - gone)) | set(rng.sample(range(10**6, 2 * 10**6), more))
        if 5 * len(a & b) < 4 * len(a | b):
            continue
        (p, need), (q, needed) = nearcopies.lengths(len(a)), nearcopies.lengths(len(b))
        both = set(sorted(a)[:p]) & set(sorted(b)[:q])
        assert len(both) >= max(need, needed)


def test_forest_connects_as_all_pairs_do():
    rng = random.Random(8)
    for _ in range(60):
        sets = []
        for _ in range(rng.randrange(1, 6)):
            base = rng.sample(range(400), rng.randrange(1, 40))
            sets += [np.unique(np.array([x if rng.random() > 0.07 else rng.randrange(400) for x in base], np.int64)) for _ in range(rng.randrange(1, 8))]
        label, want = list(range(len(sets))), list(range(len(sets)))

        def root(of, x):
            while of[x] != x:
                x = of[x]
            return x

        for i, j in nearcopies.forest(sets):
            assert root(label, i) != root(label, j)
            label[root(label, i)] = root(label, j)
        for i in range(len(sets)):
            for j in range(i):
                if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])):
                    want[root(want, i)] = root(want, j)
        assert all((root(label, i) == root(label, j)) == (root(want, i) == root(want, j)) for i in range(len(sets)) for j in range(i))


def test_rows_of_one_id(spark):
    """Different texts under one id stay; of equal rows and of copies under one id one stays; a row without an id only without others."""
    a, b, c = ("one two three four five six seven", "eight nine ten eleven twelve thirteen", "a text that no other has")
    rows = [(1, a, "x", {"k": 1}), (1, b, "x", None), (2, a, "y", None), (3, c, "x", None), (3, c, "x", None), (3, c, "y", None), (None, b, "x", None), (None, "only here and without an id", None, None), (None, None, "x", None), (5, "", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `odd.name` string, m map<string,int>")
    out = nearcopies.stage(spark, docs, SF)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(1, a), (1, b), (3, c), (0, "only here and without an id"), (5, "")])
    assert nearcopies.stage(spark, docs.limit(0), SF).count() == 0


def test_tables_of_others_stay(spark):
    mine, other = common.Tables(spark), common.Tables(spark)
    a, b, c = mine.cut(spark.range(3)), other.cut(spark.range(4)), mine.cut(spark.range(5))
    mine.drop_all(c)
    assert b.count() == 4 and c.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FileNotFound|does not exist"):
        spark.read.parquet(a._tidemark_path).count()


def test_stages(spark):
    docs, counts = common.table(spark, SF, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.cut(stage(spark, docs, SF))
        counts.append((name, out.count()))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and not out.join(docs, docs.columns, "left_anti").count()
        if name == "language":
            assert out.count() >= 0.99 * docs.count()
        elif name == "toxicity":
            model = toxicity.fit(docs, common.table(spark, SF, "labels"))
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect() if model.score(r.text) < toxicity.THRESHOLD}
        elif name == "near_duplicates":
            assert {r.doc_id for r in out.collect()} == _groups(docs.collect())
        elif name == "decontamination":
            bad = {r.doc_id for r in decontam.contaminated(docs, common.table(spark, SF, "benchmark")).collect()}
            assert bad and {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - bad
        else:
            assert out.count() == docs.count() and out.agg(F.sum("size")).first()[0] == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in docs.collect())
        docs = out
    assert sorted(n for _, n in counts)[::-1] == [n for _, n in counts]


def test_odd_rows_go_through(spark):
    rows = [(1, None, "en", "a", 0), (None, "no id and some words here", "en", None, 1), (2, "", None, "b", 0), (3, "the same words again and again", "en", "a", 5), (3, "the same words again and again", "en", "a", 5), (4, "the same words again and again", "en", "a", 5)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string, found int")
    assert [r.doc_id for r in langid.stage(spark, docs, SF).collect() if r.doc_id] == [3, 3, 4]
    assert toxicity.stage(spark, docs, SF).count() == len(rows)
    assert sorted((r.doc_id or -1) for r in nearcopies.stage(spark, docs, SF).collect()) == [-1, 1, 3]
    assert decontam.stage(spark, docs, SF).count() == len(rows) and mixing.stage(spark, docs, SF).count() == len(rows)


def test_stages_of_nothing(spark, tmp_path):
    docs = common.table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert not out.count() and (name == "mixing" or out.columns == docs.columns)
    for t in ("documents", "labels", "benchmark"):  # nor do empty tables beside them stop it
        common.table(spark, SF, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert not corpus_pipeline.run(spark, str(tmp_path)).count()


def test_entry_without_what_the_corpus_needs():
    """A module that is missing takes the corpus operators away, and nothing else."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; assert len(e.queries()) > 30 and 'pipeline' not in e.queries()"
    run = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=repo, capture_output=True, text=True, timeout=120)
    assert not run.returncode, run.stderr


def test_entry_without_corpus(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(repo, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "spark-warehouse"))
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert len(e.queries()) > 30 and 'pipeline' not in e.queries() and e.queries().keys() == e.oracle_sql().keys()"], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert not run.returncode, run.stderr
    assert importlib.util.find_spec("tidemark.llm") is not None
