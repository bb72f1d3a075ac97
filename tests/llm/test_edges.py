"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, operator by operator."""

import collections
import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from folioforge.llm import decontaminate, html_text, packing, personal_data, quality_classifier, quality_rules, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, prose(60) + ".\n" + prose(60) + ".") for k in range(30)]
    return [*rows, (100, None), (101, ""), (102, " \n\t"), (103, "one"), (104, prose(60_000)), (5, rows[5][1]), (None, rows[6][1]), (None, None)]


def test_packing_opens_the_cheapest_length_for_each_bin():
    lengths, cost = (4, 8, 16), lambda bins: sum(min(c for c in (4, 8, 16) if c >= x) + 1 for x in bins)
    rng = random.Random(5)
    mixed = 0
    for _ in range(300):
        sizes = sorted((rng.randint(1, 16) for _ in range(rng.randint(1, 7))), reverse=True)
        *_, fill, final = packing.pack(sizes, lengths, 1)
        assert sum(fill) == sum(sizes) and cost(fill) == sum(final) + len(final)
        single = min(cost(packing.best_fit(sizes, c, lengths, 1)[2]) for c in lengths)
        least = min(cost([sum(s for s, b in zip(sizes, at, strict=True) if b == k) for k in set(at)]) for at in itertools.product(range(len(sizes)), repeat=len(sizes)) if all(sum(s for s, b in zip(sizes, at, strict=True) if b == k) <= 16 for k in set(at))) if len(sizes) <= 5 else 0
        assert least <= cost(fill) <= single
        mixed += cost(fill) < single
    assert mixed  # lengths that are decided bin by bin do better than any one of them
    left = packing._Left([9, 4, 3])
    left.drop(9)
    assert packing.opened(9, left, lengths, 1) == 16 and left.fill(9, 16) == 16


def test_packing_hangs_on_the_rows_alone(spark, odd):
    rows = [*odd, *[(7, "same words here")] * 50, *[(None, "a b")] * 50]
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.piece, r.n_tokens, r.bin_id, r.bin_offset, r.bin_length)
    one, many = (sorted(map(key, packing.pack_documents(frame(spark, rows).repartition(n), shard=40).collect())) for n in (1, 7))
    assert one == many and sum(r[3] for r in one if not r[0] and r[1] == 7) >= 200


def test_decontamination_by_brute_force_with_crowded_tables(spark, monkeypatch):
    """Few hash bits make blocks collide; items without id hit words and are not listed."""
    monkeypatch.setattr(decontaminate, "HASH_BITS", 4)
    rng = random.Random(2)
    vocab = [f"v{k}" for k in range(12)]
    items = [(k if k % 4 else None, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9)))) for k in range(40)]
    index = decontaminate.Index(items, 4)
    for _ in range(60):
        doc = decontaminate.words(" ".join(rng.choice([*vocab, "zz"]) for _ in range(rng.randint(0, 40))))
        spans, found = index.find(doc)
        want, ids = set(), set()
        for name, text in items:
            w = decontaminate.words(text)
            m = min(4, len(w))
            for i in range(len(w) - m + 1) if m else ():
                for k in range(len(doc) - m + 1):
                    if doc[k : k + m] == w[i : i + m]:
                        want.add((k, k + m))
                        ids.add(name)
        assert set(spans) == want and {None if index.names[x] is None else int(index.names[x]) for x in found} == ids
    monkeypatch.undo()
    bench = spark.createDataFrame([(None, "alpha beta gamma")], "item_id bigint, text string")
    got = decontaminate.find_contamination(frame(spark, [(1, "x alpha, beta gamma y"), (2, None)]), bench).collect()
    assert {r.doc_id: (r["__spans"], r["__items"]) for r in got} == {1: ([1, 4], []), 2: ([], [])}


def test_html_edges(spark):
    pages = "page_id bigint, url string, html string, text int"
    assert html_text.main_text(spark.createDataFrame([], pages)).count() == 0
    long = "<article>" + "".join(f"<p>w{k} x</p>" for k in range(60_000)) + "</article>"
    rows = [(1, None, long, 0), (2, "http://a/", "<p>" * 20_000 + "deep", 0), (3, "http://a/", "<" * 5000, 0), (None, "http://a/", None, 0)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, pages)).collect()}
    assert got[1].count("\n") == 59_999 and got[2] == "deep" and got[None] == ""


def test_quality_rules_edges(spark, odd):
    got = quality_rules.judge(frame(spark, odd)).collect()
    assert len(got) == len(odd) and all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert quality_rules.judge(frame(spark, [])).count() == 0
    same = collections.Counter((r.doc_id, r.n_words, r.p_good, r.kept) for r in got)
    assert max(same.values()) == 2
    one = quality_rules.judge(frame(spark, odd[:1]), least=0.0).collect()[0]
    at = quality_rules.judge(frame(spark, odd[:1]), least=one.p_good).collect()[0]
    assert at.kept  # a tie with the least chance keeps the document


def test_quality_rules_votes_by_hand(spark):
    prose = "The ship of the line is in the port and it was for sale. " * 2
    rows = {1: prose, 2: "BUY!!! " * 30, 3: "| a | b |\n" * 20, 4: ""}
    got = {r.doc_id: dict(zip(quality_rules.RULES, r.v, strict=True)) for r in quality_rules.judge(frame(spark, rows.items())).collect()}
    assert got[1]["function_words"] == 1 and got[1]["capitals"] == 1 and got[1]["repeats"] == -1 and got[1]["shouting"] == 1
    assert got[2]["shouting"] == -1 and got[2]["capitals"] == -1 and got[3]["bars"] == -1 and got[3]["dup_lines"] == -1
    assert got[4] == dict.fromkeys(quality_rules.RULES, 0) | {"symbols": 1, "shouting": 1, "bars": 1, "word_length": -1}


def test_estimates_follow_planted_reliabilities():
    """EM on votes of rules with known accuracies ranks the rules and finds the class of nearly all patterns."""
    rng = np.random.default_rng(3)
    good = rng.random(4000) < 0.7
    accuracy = [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55]
    votes = np.stack([np.where(rng.random(4000) < a, np.where(good, 1, -1), np.where(good, -1, 1)) for a in accuracy], 1)
    counted = sorted(collections.Counter(map(tuple, votes.tolist())).items())
    prior, weight = quality_rules.estimate(counted)
    score = np.array([prior + sum(weight[j][x] for j, x in enumerate(v)) for v in votes.tolist()])
    assert ((score > 0) == good).mean() > 0.93 and weight[0][1] - weight[0][-1] > weight[4][1] - weight[4][-1] > weight[8][1] - weight[8][-1]
    few = sorted(collections.Counter(map(tuple, votes[:, :4].tolist())).items())
    post = dict(zip([v for v, _ in few], personal_data.estimate(few), strict=True))
    assert (np.array([post[tuple(v)] > 0.5 for v in votes[:, :4].tolist()]) == good).mean() > 0.9


def test_personal_data_edges(spark, odd):
    rows = [*odd, (200, "mail a@b.co twice"), (200, "mail a@b.co twice"), (None, "ip 1.2.3.4")]
    got = personal_data.find(frame(spark, rows)).collect()
    assert len(got) == len(rows) and sum(len(r.email) for r in got) == 2 and [len(r.ip) for r in got if r.doc_id is None and r.t.startswith("ip")] == [1]
    assert personal_data.find(frame(spark, [])).count() == 0


def test_classifier_edges(spark, odd):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(30)], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, odd)
    for module in (quality_classifier, toxicity):
        model = module.train(docs, labels, lambda c: c >= 0)
        got = module.score(docs, model).collect()
        assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
        assert module.score(docs.limit(0), model).count() == 0
        for few in (labels.limit(0), labels.filter("quality = 1")):
            assert len({round(r.score, 9) for r in module.score(docs, module.train(docs, few, lambda c: c >= 0)).collect()}) == 1
        assert module.score(docs, module.train(docs.limit(0), labels, lambda c: c >= 0)).count() == len(odd)


def test_pipeline_stages(spark, tmp_path):
    """Each stage on its own small input: what it must drop goes, clean documents stay, columns stay those of documents."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    item, line = prose(30), prose(12)
    texts = [prose(80) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(60, texts[0]), (61, f"{prose(40)} {item} {prose(40)}"), (62, f"{texts[1]}\n{line}"), (63, f"{prose(60)}\n{line}")]
    rows += [(70 + k, "BUY NOW!!! $$$ " * 30) for k in range(30)] + [(None, prose(50)), (200, None)]
    base = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], base)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 70), 0) for i, _ in rows if i is not None and i != 200], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: {r.doc_id for r in df.collect()}
    every, clean = {i for i, _ in rows}, set(range(1, 60))
    good = stages["quality_classifier"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns and not ids(good) & set(range(70, 100)) and clean <= ids(good)
    lined = {r.doc_id: r.text for r in stages["line_dedup"](spark, docs, str(tmp_path)).collect()}
    assert 60 not in lined and lined[62] == line and lined[63] == dict(rows)[63].split("\n")[0] and all(lined[k] == texts[k] for k in clean)
    assert ids(stages["near_duplicates"](spark, docs, str(tmp_path))) == every - {60, 62} - set(range(71, 100))
    assert ids(stages["decontamination"](spark, docs, str(tmp_path))) == every - {61}
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert len(packed) == len(rows) and ids(corpus_pipeline.run(spark, str(tmp_path))) >= clean - {61}
