"""Retrieval against a plain scoring of every question and chunk."""

import math
import re

import pytest
from pyspark.sql import functions as F

from rosterflow import constants as C
from rosterflow.operators import dialogue, retrieval, scan
from rosterflow.plans import answering
from rosterflow.sources import knowledge

SECTIONS = [
    (1, "man", "PROCESS", "手册", "第一步 核验", "新生带录取通知书和身份证到一楼窗口核验身份。", None),
    (2, "man", "PROCESS", "手册", "第二步 缴纳学费", "核验后到财务处缴纳学费,支持银行卡。the fee desk", None),
    (3, "poi", "POI", "POI 库", "第一食堂", "第一食堂在北区,供应早餐和晚餐。", None),
    (4, "poi", "POI", "POI 库", "图书馆", "图书馆 opens 8:00 and closes 22:00, library card needed", None),
    (5, "faq", "FAQ", "问答", "学费怎么交", "学费可在财务处缴纳,也可以在线缴费。", None),
    (6, "faq", "FAQ", "问答", "宿舍有没有空调", "宿舍都有空调,电费自理。", None),
    (7, "mat", "MATERIAL", "清单", "研究生材料", "学位证 毕业证 照片", "GRADUATE"),
    (8, "mat", "MATERIAL", "改名", "", "护照 签证 the the the", "INTERNATIONAL"),
]
QUESTIONS = [(1, "学费怎么交", True), (2, "食堂在哪里", True), (3, "library the the", True), (4, "zzz??", True), (5, "学费怎么交", False)]


def tokens(s):
    return re.findall(r"[a-z0-9]+|[^\W_]", (s or "").lower()) if s else []


def grams(s):
    n = re.sub(r"\s+", "", s.lower())
    return {n[i:i + 2] for i in range(len(n) - 1)} if len(s) >= 2 else set()


def brute(question, chunks):
    texts = [" ".join(x for x in (c[4], c[5]) if x) for c in chunks]
    avg = sum(len(tokens(c[5])) for c in chunks) / len(chunks)
    bm25 = []
    for t in texts:
        total, toks = 0.0, tokens(t)
        for term in tokens(question):
            df = sum(term in tokens(x) for x in texts)
            f = toks.count(term)
            if f:
                total += math.log(1 + (len(texts) - df + .5) / (df + .5)) * f * 2.5 / (f + 1.5 * (.25 + .75 * len(toks) / avg))
        bm25.append(total)
    best = max(bm25)
    out = []
    for c, t, b in zip(chunks, texts, bm25):
        q, g = grams(question), grams(t)
        o = len(q & g) / min(len(q), len(g)) if q and g else 0.0
        out.append((c[0], .7 * o + .3 * (b / best if best else 0)))
    return sorted([x for x in out if x[1] > 0], key=lambda x: (-round(x[1], 9), x[0]))


@pytest.fixture(scope="module")
def chunks(spark):
    rows = spark.createDataFrame(
        SECTIONS, "n bigint, doc_id string, category string, title string, section string, content string, student_category string")
    return knowledge.index_chunks(knowledge.ingest(rows, "n", block_rows=3))


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "question_id bigint, question string, available boolean")


@pytest.mark.parametrize("category", [None, "FAQ"])
@pytest.mark.parametrize("broadcast_chars, pruned_pairs", [(2_000_000, 0), (0, 0), (2_000_000, 10 ** 9), (0, 10 ** 9)])
def test_retrieve(spark, chunks, questions, category, broadcast_chars, pruned_pairs, monkeypatch):
    monkeypatch.setattr(retrieval, "PRUNED_PAIRS", pruned_pairs)
    monkeypatch.setattr(retrieval, "BROADCAST_QUESTION_CHARS", broadcast_chars)
    monkeypatch.setattr(retrieval, "POSTING_LENGTH", 2)
    pool = [c for c in SECTIONS if category in (None, c[2])]
    for k in (3, 0):
        got = retrieval.retrieve(questions.drop("available"), chunks, k, category).collect()
        for qid, question, _ in QUESTIONS:
            mine = sorted(((r["rank"], r.chunk_no, r.score) for r in got if r.question_id == qid))
            want = brute(question, pool)[: k or None]
            assert [m[1] for m in mine] == [w[0] for w in want]
            assert [m[2] for m in mine] == pytest.approx([w[1] for w in want])


def test_pruned_search_scores_few_pairs(spark, monkeypatch):
    import random

    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(draw.choice(letters) for _ in range(draw.randrange(2, 9))) for _ in range(3000)]
    weight = [1 / (i + 1) for i in range(3000)]
    # Six versions of each text, so that the best chunks of a question score well above the others.
    bases = [draw.choices(words, weight, k=draw.randrange(30, 300)) for _ in range(100)]
    texts = [" ".join(base + draw.choices(words, weight, k=10)) for base in bases for _ in range(6)]
    asked = []
    for i in range(40):
        source = bases[draw.randrange(100)]
        at = draw.randrange(max(1, len(source) - 25))
        asked.append((i, " ".join(source[at:at + 25] + draw.choices(words, weight, k=draw.choice([0, 10, 40])))))
    # Questions with no known term, with one everywhere, and empty ones cannot be pruned.
    asked += [(40, "qq?"), (41, words[0]), (42, ""), (43, "学费")]
    rows = spark.createDataFrame([(i, f"d{i}", "FAQ", "t", "", t, None) for i, t in enumerate(texts, 1)],
                                 "n bigint, doc_id string, category string, title string, section string, content string, student_category string")
    pool = knowledge.index_chunks(knowledge.ingest(rows, "n"))
    questions = spark.createDataFrame(asked, "question_id bigint, question string")

    def best(scored, k):
        by = {}
        for r in scored.filter("score > 0").collect():
            by.setdefault(r.question_id, []).append((-round(r.score, 9), r.chunk_no))
        return {q: sorted(v)[:k] for q, v in by.items()}

    full = retrieval.hybrid_scores(questions, pool).cache()
    for k in (1, 5):
        pruned = retrieval.top_scores(questions, pool, k).cache()
        assert best(pruned, k) == best(full, k)
        assert pruned.filter("question_id < 40").count() < 40 * 600 / 5


def test_few_questions_are_scored_in_passes(spark, monkeypatch):
    monkeypatch.setattr(scan, "ROWS", 7)
    # Twenty copies of each text, one with bigrams but no terms, one empty.
    texts = ["学费 在财务处缴纳", "library card the the", "?? !!", "", "食堂 the library"] * 20
    rows = [(i, f"d{i}", ["FAQ", "POI"][i % 2], "t", "", t, None) for i, t in enumerate(texts, 1)]
    pool = knowledge.index_chunks(knowledge.ingest(spark.createDataFrame(
        rows, "n bigint, doc_id string, category string, title string, section string, content string, student_category string"), "n"))
    asked = [("a", "the library?? !!"), ("b", "学费"), ("c", "zz"), ("d", "")]
    questions = spark.createDataFrame(asked, "question_id string, question string")
    for category in (None, "POI"):
        mine = [r for r in rows if category in (None, r[2])]
        scored = retrieval.scanned_scores(questions, pool if category is None else pool.filter(f"category = '{category}'"), 3)
        assert scored.count() <= 3 * len(asked) * scored.rdd.getNumPartitions()
        got = retrieval.retrieve(questions, pool, 3, category).collect()
        for q, question in asked:
            found = sorted((r["rank"], r.chunk_no, r.score) for r in got if r.question_id == q)
            want = brute(question, mine)[:3]
            assert [x[1] for x in found] == [w[0] for w in want]
            assert [x[2] for x in found] == pytest.approx([w[1] for w in want])
    monkeypatch.setattr(scan, "MOST_CELLS", 1)
    joined = {(r.question_id, r.chunk_no): (round(r.bm25, 9), r["rank"], r.zero_chunks) for r in retrieval.bm25_scores(questions, pool).collect()}
    monkeypatch.setattr(scan, "MOST_CELLS", 10 ** 6)
    assert joined == {(r.question_id, r.chunk_no): (round(r.bm25, 9), r["rank"], r.zero_chunks) for r in retrieval.bm25_scores(questions, pool).collect()}


def test_index_is_built_row_by_row(spark, tmp_path):
    texts = [(1, "b a b 学 b a", ""), (2, "?! ?!", ""), (3, None, ""), (4, "a", "x y")]
    spark.createDataFrame(texts, "chunk_no bigint, content string, section string").write.parquet(str(tmp_path / "c"))
    index = knowledge.index_chunks(spark.read.parquet(str(tmp_path / "c")))
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    got = {r.chunk_no: r for r in index.collect()}
    assert {n: {t.feature: t.tf for t in r.terms} for n, r in got.items()} == {
        1: {"a": 2, "b": 3, "学": 1}, 2: {}, 3: {}, 4: {"a": 1, "x": 1, "y": 1}}
    assert [(got[n].dl, got[n].content_len) for n in (1, 2, 3, 4)] == [(6, 6), (0, 0), (0, 0), (3, 1)]
    assert sorted(got[2].grams) == ["!?", "?!"]


def test_parts_of_an_index_follow_its_text():
    assert [knowledge.part_count(n * 10 ** 9, 12) for n in (0, 1, 10)] == [12, 63, 625]


def test_chunk_ids_and_first_metadata(spark, chunks):
    assert {r.chunk_id for r in chunks.collect()} == {f"{s[1]}-c{i + 1}" for i, s in enumerate(SECTIONS)}
    meta = knowledge.document_metadata(chunks, "n").filter("doc_id = 'mat'").first()
    assert meta.title == "清单"


def test_materials_need_an_identity(chunks):
    assert [r.n for r in retrieval.material_list(chunks, "GRADUATE").collect()] == [7]
    assert retrieval.material_list(chunks, None).count() == 0


def test_answers(spark, chunks, questions):
    more = questions.unionByName(spark.createDataFrame([(6, "我不想活了", True)], questions.schema))
    history = spark.createDataFrame(
        [(1, [("user", "你好"), ("assistant", "您好")])], "question_id bigint, history array<struct<role:string,content:string>>")
    got = {r.question_id: r for r in answering.answer(more, chunks, history).collect()}
    assert [got[i]["mode"] for i in (1, 4, 5, 6)] == ["generated", "low_confidence", "faq", "refused"]
    assert got[6].transfer_to_human and got[6].reply.startswith("如果您正在经历困难")
    assert got[4].reply == C.LOW_CONFIDENCE_REPLY and got[4].low_confidence
    assert got[1].reply.startswith("学费可在财务处") and [tuple(i) for i in got[1].intents] == [("STEP", "payment")]
    assert "user: 你好\nassistant: 您好\n" in got[1].prompt and got[1].prompt.endswith("学费怎么交")
    assert got[5].label.degraded and got[5].reply.startswith("学费可在财务处") and not got[5].low_confidence


def test_extension_points(spark, chunks, questions):
    def generator(asked):
        return asked.withColumn("raw_reply", F.concat(F.lit("! "), F.col("masked_question")))

    def retriever(asked, pool, k, category):
        return retrieval.retrieve(asked, pool, 1, "FAQ")

    history = spark.createDataFrame([], "question_id bigint, history array<struct<role:string,content:string>>")
    rules = [("off_topic", ["食堂"], "不谈食堂")]
    got = {r.question_id: r for r in answering.answer(
        questions, chunks, history, generator, retriever, rules).collect()}
    assert got[1].reply == "! 学费怎么交" and len(got[1].sources) == 1
    assert got[2]["mode"] == "refused" and got[2].reply == "不谈食堂"


def test_history_keeps_the_last_rounds(spark):
    turns = spark.createDataFrame(
        [("s", t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(14)],
        "session_id string, turn bigint, role string, content string")
    history = dialogue.recent_history(turns).first().history
    assert [m.content for m in history] == [f"m{t}" for t in range(4, 14)]


def test_replace_one_category(spark, chunks, tmp_path):
    path = str(tmp_path / "kb")
    knowledge.write_chunks(chunks.select("chunk_id", "category"), path)
    knowledge.replace_category(chunks.filter("chunk_no = 6").select("chunk_id", "category"), "FAQ", path)
    left = {r.chunk_id for r in spark.read.parquet(path).collect()}
    assert "faq-c6" in left and "faq-c5" not in left and len(left) == 7
