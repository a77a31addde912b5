"""The pipeline's rows against its stages worked out one document at a time."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np

from test_llm_operators import DOCS, WORD, brute_components, brute_lines, family_texts, read_back, word_sets

STEMS = {"en": ["the", "ing", "wh", "th"], "fr": ["eau", "é", "qu", "ou"], "ru": ["ж", "ов", "ы", "то"]}
SOURCES = ("a", "zbig", None, "zbig", "a", "zbig", None, "zbig", "a", "zbig", "a")


def told(rng, name, n):
    return " ".join("".join(rng.choices(STEMS[name], k=3)) for _ in range(n))


def given():
    """doc_id, text, source: languages that are plain to tell, texts without letters, shared lines and passages, near copies."""
    rng = random.Random(17)
    legal = "\n".join(told(rng, "en", 12) for _ in range(3))
    passage, halves = told(rng, "fr", 55), told(rng, "en", 30) + "\n" + told(rng, "en", 26)
    texts = []
    for i in range(160):
        name = list(STEMS)[i % 3]
        lines = [told(rng, name, rng.randint(5, 40)) for _ in range(rng.randint(1, 6))]
        for part, every in ((legal, 5), (passage, 11), (halves, 13)):
            if i % every == 0:
                lines.insert(rng.randint(0, len(lines)), part)
        texts.append("\n".join(lines))
    for i in range(0, 60, 3):  # near copies and copies
        w = texts[i].split(" ")
        if i % 2:
            w[len(w) // 2] = told(rng, "en", 1)
        texts.append(" ".join(w))
    texts += ["", None, "12 34 56", "!!", "\n\n"] + [legal, legal]
    return [(i, t, SOURCES[i % len(SOURCES)]) for i, t in enumerate(texts)]


def mixed(rows):
    """doc_id to how often the mix takes it."""
    size = {d: len(WORD.findall(t)) for d, t, _ in rows}
    of = {}
    for d, _, s in rows:
        of.setdefault(s, []).append(d)
    order = sorted(of, key=lambda s: (s is None, s))
    sums, weight = {s: sum(size[d] for d in of[s]) for s in order}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, open_ = {}, set(order)
    while open_:
        rest, w = 1.5 * sum(sums.values()) - sum(want.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / w > 2 * sums[s]}
        want |= {s: 2.0 * sums[s] for s in over} if over else {s: rest * weight[s] / w for s in open_}
        open_ = open_ - over if over else set()
    times = {}
    for s in order:
        budget, before = math.floor(want[s] + 0.5), 0
        epochs = budget // sums[s] if sums[s] else 0
        for d in sorted(of[s], key=lambda d: (hashlib.md5(f"20|{d}".encode()).hexdigest(), d)):
            taken = epochs * size[d] + max(0, min(size[d], budget - epochs * sums[s] - before))
            before += size[d]
            times[d] = math.floor(taken / size[d] + 0.5) if size[d] else 1
    return times


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as p
    from granary.llm.queries import word_bpe_path

    rows = given()
    frame = spark.createDataFrame([(d, t, list(STEMS)[d % 3], s, len(t or "")) for d, t, s in rows], DOCS)
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = p.run(spark, str(tmp_path)).collect()

    rows = [(d, t, s) for d, t, s in rows if t and any(c.isalpha() for c in t)]
    clean = brute_lines([t for _, t, _ in rows])
    # a document of which no line stays goes; the last line of such a one may be an empty text
    rows = [(d, c, s) for (d, t, s), c in zip(rows, clean, strict=True) if c or c == t]
    roots = brute_components(word_sets([t for _, t, _ in rows], 5))
    rows = [r for i, r in enumerate(rows) if roots[i] == i]
    times = mixed(rows)
    tokens = Tokenizer.from_file(word_bpe_path())
    ids = {d: tokens.encode(t, add_special_tokens=False).ids + [2] for d, t, _ in rows}
    assert 100 < len(rows) < 170 and {0, 1, 2} <= set(times.values())
    read_back(got)
    held = Counter()
    for r in got:
        want = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        held.update((r["doc_id"], k) for k in range(r["start"], r["start"] + r["length"]))
    assert held == Counter({(d, k): n for d, n in times.items() if n for k in range(len(ids[d]))})
