from __future__ import annotations

import random

import numpy as np
from brinewave.llm import op5_language_id as op
from pyspark.sql import functions as F


def greedy(seq, train):
    """Longest-match parsing by substring search, over blocks."""
    n = 0
    for at in range(0, len(seq), op.BLOCK):
        block, i = seq[at : at + op.BLOCK], 0
        while i < len(block):
            k = 1
            while i + k <= len(block) and block[i : i + k] in train:
                k += 1
            i += max(1, k - 1)
            n += 1
    return n


def test_phrase_counts_equal_substring_search():
    rng = random.Random(3)
    samples = {"x": ["".join(rng.choice("abc ") for _ in range(600))], "y": ["".join(rng.choice("bcd ") for _ in range(500)), "dd bb"]}
    model = op.train(samples)
    for _ in range(20):
        text = "".join(rng.choice("abcdeé 1") for _ in range(rng.randrange(1, 1400)))
        seq, letters = op.symbols(text, model.alphabet)
        langs, scores = op.predict(model, [text])
        counts = []
        for lang in model.languages:
            train = "".join(chr(int(s) + 65) for t in samples[lang] for s in [0, *op.symbols(t, model.alphabet)[0]])
            counts.append(greedy("".join(chr(int(s) + 65) if s != 1 else "\0" for s in seq), train))
        rate = np.array(counts) * np.array(model.scale) / len(seq)
        if letters:
            assert langs[0] == model.languages[int(np.argmin(rate))]
            assert abs(scores[0] - max(rate) / sum(rate)) < 1e-12


def test_edges(spark, docs):
    wide = docs.withColumn("score", docs.doc_id).withColumn("key", docs.lang)
    model = op.fit(wide)
    rows = op.with_language(docs.select("doc_id", "text"), model).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert [(by[i].lang_pred, by[i].score) for i in (1, 2, 4)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in rows)
    kept = op.keep_identified(wide)
    assert kept.columns == wide.columns and not {1, 2, 4} & {r.doc_id for r in kept.collect()}
    assert op.with_language(docs.limit(0), op.fit(docs.limit(0))).count() == 0
    clash = docs.withColumn("score", docs.text).withColumn("LANG_pred", docs.doc_id).withColumn("held_out", docs.lang)
    assert op.with_language(clash, model).columns == ["doc_id", "lang", "source", "n_chars", "held_out", "lang_pred", "score"]
    assert op.with_language(clash, model).count() == 8 and op.keep_identified(clash).columns == clash.columns
    nothing = op.with_language(docs, op.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_held_out_accuracy(spark):
    from pathlib import Path

    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        return
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in op.query(spark, d).collect() if r.held_out and r.lang_pred != "und"]
    assert sum(truth[r.doc_id] == r.lang_pred for r in rows) >= 0.9 * len(rows)


SCRIPTS = {
    "en": "the house of the old man stands near the river and every morning the children walk to school along its bank".split(),
    "ja": ["わたし", "は", "学校", "へ", "いきます", "日本", "の", "山", "と", "川", "が", "すき", "です", "カメラ", "を", "見る", "人", "東京"],
    "ko": "나는 학교에 갑니다 한국의 산과 강을 좋아합니다 아침에 친구를 만나서 이야기를 합니다 서울".split(),
    "ru": "старый дом стоит около реки и каждое утро дети идут в школу вдоль берега".split(),
    "zh": ["我们", "去", "学校", "中国", "的", "山", "和", "河", "很", "漂亮", "早上", "朋友", "见面", "说话", "北京", "人", "看书", "工作"],
}


def test_letters_of_every_script():
    rng = random.Random(4)
    text = lambda lang, n: ("" if lang in ("ja", "zh") else " ").join(rng.choice(SCRIPTS[lang]) for _ in range(n))
    # letters that make the alphabet larger than there are symbols, and some beyond the basic plane
    more = {"zh": "".join(chr(0x4E00 + 7 * i) for i in range(300)), "xx": "".join(chr(0x10400 + i % 40) for i in range(200))}
    model = op.train({lang: [text(lang, 400) if lang in SCRIPTS else "", more.get(lang, "")] for lang in SCRIPTS | more})
    assert len(model.alphabet.spelled) > 100 and model.width <= op.WIDTH + 3
    for lang in SCRIPTS:
        for n in (6, 60):
            langs, scores = op.predict(model, [text(lang, n), text(lang, n).upper()])
            assert langs == [lang, lang] and min(scores) > 0.6, (lang, n, langs, scores)
    assert op.predict(model, [more["xx"][:30], "\u0e01\u0e02", "\u3002\uff01"])[0][::2] == ["xx", "und"]


def test_symbols_tell_all_known_letters_apart():
    letters = op.alphabet(["".join(chr(c) for c in range(0x4E00, 0x4E00 + 500)) + "abcÀ" + chr(0x20000) + chr(0x20001)])
    seen = {tuple(op.symbols(chr(c), letters)[0].tolist()) for c in (*range(0x4E00, 0x4E00 + 500), *map(ord, "abcà"), 0x20000, 0x20001)}
    assert len(seen) == 506 and all(s < letters.width - 1 for t in seen for s in t)
    assert op.symbols("À", letters)[0].tolist() == op.symbols("à", letters)[0].tolist()
    assert op.symbols("x 1.", letters)[0].tolist() == [1, 0]


def test_sample_takes_pieces_from_all_over_the_texts(spark):
    long = "".join(f"{i:07d} " for i in range(40_000))
    rows = [(0, long, "a")] + [(i, f"text {i} " * 9, "a") for i in range(1, 40)] + [(100, None, "a"), (101, "", "a"), (102, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = op.sample(docs, F.lit(True), "doc_id", "text", "lang")["a"]
    assert sum(map(len, found)) <= op.TRAIN_CHARS and all(f"text {i} " * 9 in found for i in range(1, 40))
    at = [int(p[8:15]) for p in found if p[8:15].isdigit()]
    assert len(at) > 20 and max(at) > 20_000 and min(at) > 0
    assert sorted(found) == sorted(op.sample(docs.repartition(3), F.lit(True), "doc_id", "text", "lang")["a"])
