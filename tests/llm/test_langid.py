import os
import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import langid

WORDS = {
    "en": "the and of to with that this from here there thing under over water light night".split(),
    "de": "der die und das nicht ein mit für über wasser licht nacht straße größe schön".split(),
    "fr": "le la et des pour avec dans une eau lumière être français garçon très où".split(),
}


def sample(n, seed):
    rng = random.Random(seed)
    return [(" ".join(rng.choice(WORDS[k]) for _ in range(rng.randrange(2, 40))), k) for k in WORDS for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, k, "x", 1.0) for i, (t, k) in enumerate(rows)], "doc_id long, text string, lang string, h string, score double")


def test_held_out_accuracy():
    train, test = sample(150, 1), sample(100, 2)
    model = langid.train([t for t, _ in train], [k for _, k in train])
    found = [model.predict(t) for t, _ in test]
    assert sum(p == k for (p, _, _), (_, k) in zip(found, test)) >= 0.98 * len(test)
    assert all(0 <= s <= 1 for _, s, _ in found)
    assert sum(r for _, _, r in found) <= 0.01 * len(test)  # clean texts stay
    assert model.predict("你好世界 こんにちは мир")[2]  # nothing known in it
    confident = [(p == k, s) for (p, s, _), (_, k) in zip(found, test)]
    assert abs(sum(s for _, s in confident) / len(confident) - sum(r for r, _ in confident) / len(confident)) < 0.05


def test_other_languages_are_rejected():
    """A model of production size rejects languages and letters it was not trained on, and keeps its own."""
    rng = random.Random(5)
    letters = "aeioubcdfghjklmnprstvzwy"

    def language():
        parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 4))) for _ in range(60)]
        return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(1500)]

    def text(words):
        return " ".join(rng.choice(words) for _ in range(rng.randrange(60, 120)))

    own, other = [language() for _ in range(4)], [language() for _ in range(4)]
    rows = [(text(own[k]), str(k)) for k in range(4) for _ in range(1500)]
    model = langid.train([t for t, _ in rows], [k for _, k in rows])
    found = [(model.predict(text(own[k])), str(k)) for k in range(4) for _ in range(100)]
    assert sum(p[0] == k for p, k in found) >= 396 and sum(p[2] for p, _ in found) <= 4
    assert sum(model.predict(text(w))[2] for w in other for _ in range(25)) >= 95
    assert sum(model.predict(text(["".join(rng.choice(letters) for _ in range(6)) for _ in range(100)]))[2] for _ in range(50)) >= 48


def test_short_texts_have_room_for_chance():
    """The same share of unknown subwords is judged by the length of the text."""
    texts = [t for t, _ in sample(300, 1)]
    known = np.unique(np.concatenate([h for t in texts for h in langid._hashes(t)[1:]]))
    model = langid.Model(["a"], np.zeros((langid.BUCKETS, 1), np.float32), known, least_known=0.95)
    short, foreign = "the water and the qx light", "qxzj wvkq jjxz qqwv"
    assert 0.5 < model.sums(short)[1] < 0.95 and not model.predict(short)[2]
    assert model.predict(" ".join([short] * 200))[2] and model.predict(foreign)[2]


def test_edges():
    model = langid.train([t for t, _ in sample(50, 1)], [k for _, k in sample(50, 1)])
    for t in (None, "", " ", "12345 !?", "²"):
        assert model.predict(t) == ("und", 0.0, True)
    assert model.predict("the " * 100_000)[0] == "en"
    assert model.predict("x")[0] in WORDS
    nothing = langid.train([], [])
    assert nothing.predict("the") == ("und", 0.0, False) and nothing.predict("1") == ("und", 0.0, True)
    assert langid.train(["the"], ["en"]).predict("the")[0] == "en"


def test_identify_and_sample(spark):
    rows = sample(60, 3) + [(None, "en"), ("", "de"), ("the and", None), ("the and", "en"), ("the and", "en")]
    docs = frame(spark, rows)
    texts, labels = langid.sample_labelled(docs, langid.hash_fold(F.col("doc_id")) != 1)
    import zlib

    allowed = {t for i, (t, k) in enumerate(rows) if zlib.crc32(str(i).encode()) % 3 != 1 and t is not None and k}
    assert set(texts) <= allowed and len(texts) == len(labels) > 60
    found = langid.identify(docs, langid.train(texts, labels)).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert by[len(rows) - 5]["lang_pred"] == "und" and by[len(rows) - 3]["lang_pred"] == "en"
    kept = langid.accepted(docs, langid.train(texts, labels))
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").isEmpty() and kept.count() >= len(rows) - 4
    empty = docs.limit(0)
    assert langid.sample_labelled(empty, F.lit(True)) == ([], [])
    assert langid.identify(empty, langid.train([], [])).isEmpty()


def test_subwords_cover_the_whole_text():
    assert len(langid.subwords("ab")) == 3 + 2 + 1
    a, b = langid.subwords("Water 7 light"), langid.subwords("water,  light")
    assert (a == b).all()


def test_training_gives_memory_back():
    """The driver does not keep the memory of the training texts' subwords, and texts without subwords are no error."""
    script = """
import random, re
from loomgraph.llm import langid
langid.EPOCHS = 0
used = lambda: sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) // 1024
rng = random.Random(1)
texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=1500)) for _ in range(3000)]
before = used()
model = langid.train(texts, ["x", "y"] * 1500)
print(used() - before)
"""
    if not os.path.exists("/proc/self/smaps_rollup"):
        pytest.skip("memory can't be read here")
    said = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    assert int(said.stdout) < 80, said.stderr  # 52 MB, and 114 with an array for each text
    assert langid.train([" ", "1"], ["x", "y"]).predict("a")[0] in ("x", "y")
