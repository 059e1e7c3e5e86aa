"""Language prediction from end to end, against a plain form: TF-IDF, centroids, limits and nearest centroids."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from mixframe.llm import language

MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
ALPHABETS = {"aa": "abcdefgh", "bb": "efghijklm", "cc": "klmnopñé"}


def counts(text):
    runs = re.findall(r"[^\W\d_]+", (text or "").lower())
    said, found = f" {' '.join(runs)} ", Counter()
    for n in (1, 2, 3) if runs else ():
        for i in range(len(said) - n + 1):
            h = (n + sum(ord(c) * m for c, m in zip(said[i : i + n], MULTIPLIERS))) & 0xFFFFFFFF
            found[((h ^ h >> 15) * 0x27D4EB2F & 0xFFFFFFFF) >> 19] += 1
    return found


def vector(found, idf):
    v = np.zeros(8192)
    for d, n in found.items():
        v[d] = math.log(1 + n) * idf[d]
    return v / math.sqrt((v * v).sum())


def clusters(rows, k):
    mean = np.mean(rows, axis=0)
    picked = [min(range(len(rows)), key=lambda i: rows[i] @ mean)]
    while len(picked) < min(k, len(rows)):
        picked.append(min(range(len(rows)), key=lambda i: max(rows[i] @ rows[j] for j in picked)))
    centres = [rows[i] for i in picked]
    for _ in range(50):
        of = [max(range(len(centres)), key=lambda c: r @ centres[c]) for r in rows]
        for c in range(len(centres)):
            if c in of:
                total = np.sum([r for r, o in zip(rows, of) if o == c], axis=0)
                centres[c] = total / math.sqrt(total @ total)
    return centres


def plain(training, asked, k, sample, unseen):
    known = [(t, lang) for t, lang in training if lang is not None]
    df = Counter(d for t, _ in known for d in counts(t))
    idf = [math.log((1 + len(known)) / (1 + df[d])) + 1 for d in range(8192)]
    centres, least = {}, {}
    for lang in {lang for t, lang in known if counts(t)}:
        signed = lambda t: int.from_bytes(xxhash.xxh64(t.encode(), seed=42).digest(), "big", signed=True)
        texts = sorted({t for t, x in known if x == lang and counts(t)}, key=signed)[: sample + unseen]
        fitted = min(sample, len(texts) - min(unseen, len(texts) // 3))
        centres[lang] = clusters([vector(counts(t), idf) for t in texts[:fitted]], k)
        seen = {}
        for t in texts[fitted:]:
            for cut in [t] + [t[(len(t) - 16 * 2**i) // 2 :][: 16 * 2**i] for i in range(10) if 16 * 2**i < len(t)]:
                if counts(cut):
                    size = min(sum(counts(cut).values()).bit_length(), 14) - 1
                    seen.setdefault(size, []).append(max(vector(counts(cut), idf) @ c for c in centres[lang]))
        limit = []
        for size in range(14):
            limit.append(0.5 * np.quantile(seen[size], 0.25) if size in seen else limit[-1] if limit else 0.0)
        least[lang] = limit
    out = []
    for text in asked:
        found = counts(text)
        if not found:
            out.append(("und", 0.0, 1.0))
            continue
        score, lang = max((vector(found, idf) @ c, lang) for lang, some in centres.items() for c in some)
        out.append((lang, score, least[lang][min(sum(found.values()).bit_length(), 14) - 1]))
    return out


@pytest.mark.parametrize(("sample", "unseen"), [(300, 500), (12, 9)])
def test_matches_plain_form(spark, sample, unseen):
    random.seed(5)
    say = lambda letters, n: " ".join("".join(random.choices(letters, k=random.randrange(1, 7))) for _ in range(n))
    rows = [(say(a, random.randrange(2, 60)).title() + random.choice([".", " 4!", ""]), x) for x, a in ALPHABETS.items() for _ in range(45)]
    rows += [rows[0]] * 30 + [(None, "aa"), ("", "bb"), ("9 9", "cc"), ("abc", None)]
    asked = [t for t, _ in rows] + [say("qrstuvwxyz", 30), say("abcdxyz", 12), "ñ", say("efgh", 900)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3), 3, sample, unseen)
    docs = spark.createDataFrame(list(enumerate(asked)), "id int, text string")
    found = [r.language for r in language.predict(docs, model).orderBy(F.col("id")).collect()]
    want = plain(rows, asked, 3, sample, unseen)
    assert [r.score for r in found] == pytest.approx([w[1] for w in want], abs=1e-5)
    assert [r.lang_pred for r in found] == [w[0] for w in want]
    sure = [(r.rejected, w[1] < w[2] or w[0] == "und") for r, w in zip(found, want) if abs(w[1] - w[2]) > 1e-5]
    assert all(a == b for a, b in sure) and len(sure) >= len(want) - 3 and any(a for a, _ in sure)
