"""Registered queries against their SQL, the pipeline stage by stage, and the library without this subpackage."""

import collections
import hashlib
import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from rosterflow.llm import common, quality, queries
from rosterflow.session import shared_dir

import test_numbered as plain  # noqa: E402

TABLES = "documents pages benchmark labels conversations".split()
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shown(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(lake, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    df = queries.QUERIES[name](lake, sf)
    names = sorted(df.columns)
    got = sorted((tuple(shown(r[c]) for c in names) for r in df.collect()), key=repr)
    result = con.execute(queries.ORACLES[name])
    found = [c[0] for c in result.description]
    assert sorted(found) == names
    places = [found.index(c) for c in names]
    assert got == sorted((tuple(shown(r[i]) for i in places) for r in result.fetchall()), key=repr)


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(entry.oracle_sql()) <= names


def test_pipeline_stage_by_stage(lake, sf, monkeypatch):
    extra = lake.createDataFrame(
        [(-1, None), (-2, ""), (None, "No id, but a few words of text."), (-3, plain.LONG), (-4, "Short. " * 40), (-4, "Short. " * 40)],
        "doc_id long, text string").withColumns({
            "lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "n": F.lit(1),
            "score": F.lit("x"), "keys": F.lit(2)})
    docs = common.table(lake, sf, "documents").withColumns({"n": F.lit(1), "score": F.lit("x"), "keys": F.lit(2)}).unionByName(extra)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "near duplicates", "benchmark decontamination", "packing"]

    def run(stage, frame):
        out = stage(lake, frame, sf)
        path = shared_dir(lake, "stage")
        out.write.parquet(path)
        return lake.read.parquet(path)

    scored = quality.classify(docs, common.table(lake, sf, "labels")).collect()
    first = run(corpus_pipeline.good, docs)
    assert first.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in first.collect()))) == sorted(repr(r.doc_id) for r in scored if r.predicted)
    assert 0 < first.count() < docs.count()

    second = run(corpus_pipeline.lines, first)
    assert second.columns == docs.columns and second.where("n_chars <> length(text)").count() == 0
    plain.same([(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in second.collect()],
               [(d, sha) for d, _, _, sha in plain.plain_lines(plain.rows_of(first))])

    third = run(corpus_pipeline.near_duplicates, second)
    rows = plain.rows_of(second)
    sets = list(plain.plain_sets(rows))
    label = list(range(len(rows)))
    for i, (x, _) in enumerate(rows):
        for j, (y, _) in enumerate(rows[:i]):
            if x is not None and y is not None and (
                    x == y or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])):
                old, new = label[i], label[j]
                label = [new if v == old else v for v in label]
    groups = collections.defaultdict(set)
    for (d, _), v in zip(rows, label):
        groups[v].add(d)
    keep = {min(g) for g in groups.values() if None not in g} | {None}
    assert third.columns == docs.columns
    plain.same([r.doc_id for r in third.collect()], [d for d, _ in rows if d in keep])

    fourth = run(corpus_pipeline.decontaminated, third)
    items = [(r.item_id, r.text) for r in common.table(lake, sf, "benchmark").collect()]
    hit = {d for d, _, n, _ in plain.plain_windows(plain.rows_of(third), items) if n}
    assert fourth.columns == docs.columns
    plain.same([r.doc_id for r in fourth.collect()], [r.doc_id for r in third.collect() if r.doc_id not in hit])
    assert 0 < fourth.count() < third.count()

    last = run(corpus_pipeline.packed, fourth)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in fourth.collect()}
    empty = docs.where("1 = 0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = run(stage, empty)
        assert empty.count() == 0 and empty.columns == docs.columns


def test_library_works_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"],
                          cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    count, checked = map(int, said.stdout.split())
    assert count == checked > 80
