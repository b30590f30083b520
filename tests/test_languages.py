import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.operators import languages as G
from corvane.plans import registry


def profile(text, size):
    line = " " + " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())) + " "
    grams = Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1))
    grams = {g: c for g, c in grams.items() if g.strip() and not (len(g) == 3 and g[1] == " ") and g[0] + g[-1] != "  "}
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return {g: k for k, g in enumerate(sorted(grams, key=lambda g: (-grams[g], number(g)))[:size])}


def brute(text, profiles, size, margin, least):
    own = profile(text, size)
    if not own or len((text or "").strip()) < least:
        return None
    apart = {k: sum(min(abs(p[g] - r), size) if g in p else size for g, r in own.items()) for k, p in profiles.items()}
    (a, first), (b, _) = sorted((d, k) for k, d in apart.items())[:2]
    return first if b and (b - a) / b >= margin else None


def test_detection_by_brute_force(spark):
    rng = random.Random(9)
    syllables = {"xx": ["ba", "ri", "no", "tu"], "yy": ["sch", "öl", "ung", "ei"], "zz": ["при", "вет", "ба", "но"]}

    def sentence(lang):
        return " ".join("".join(rng.choice(syllables[lang] * 3 + syllables["xx"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 30)))

    rows = [(lang, sentence(lang)) for lang in syllables for _ in range(40)] + [(None, "ignored words"), ("xx", None), ("yy", "")]
    size, margin, least = 40, 0.02, 12
    labelled = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    learnt = G.learn_profiles(labelled, size=size)
    # each text ranks for itself, a language over all its texts: blanks at the edges don't meet
    counts = {lang: Counter() for lang in syllables}
    for lang, text in rows:
        if lang:
            line = " " + " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())) + " "
            counts[lang].update(g for n in (1, 2, 3) for i in range(len(line) - n + 1) if (g := line[i : i + n]).strip() and not (n == 3 and g[1] == " ") and g[0] + g[-1] != "  ")
    number = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    profiles = {lang: {g: k for k, g in enumerate(sorted(c, key=lambda g: (-c[g], number(g)))[:size])} for lang, c in counts.items()}
    got = {(r.language, r.gram): r["rank"] for r in learnt.collect()}
    assert got == {(lang, number(g)): k for lang, p in profiles.items() for g, k in p.items()}
    texts = [sentence(rng.choice(list(syllables))) for _ in range(120)] + [None, "", "123 456 789 012", "kurz", sentence("xx") + " " + sentence("yy"), "ba " * 5000]
    detect = G.detector(learnt, size, margin, least)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    found = {r.id: r.language for r in df.select("id", detect("text").alias("d")).select("id", "d.language").collect()}
    assert found == {k: brute(t, profiles, size, margin, least) for k, t in enumerate(texts)} and len(set(found.values())) == 4


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_held_out_accuracy(spark, scale):
    rows = registry.QUERIES["detect_language"](spark, f"/root/testdata/{scale}").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.lang is not None and r.language is not None]
    assert len(held) > 40 and sum(r.language == r.lang for r in held) >= 0.97 * len(held)
    # what is left open are texts too short to say
    open_ = [r for r in rows if r.language is None]
    assert len(open_) <= 0.1 * len(rows) and all(r.detected == (r.language if r.language in ("de", "en", None) else "other") for r in rows)


def test_nothing_learnt(spark):
    none = G.learn_profiles(spark.createDataFrame([(None, "a b")], "lang string, text string"))
    df = spark.createDataFrame([("a text of more than forty characters, as it should be",)], "text string")
    assert df.select(G.detector(none)("text").alias("d")).select(F.col("d.language")).first()[0] is None
