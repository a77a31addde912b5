"""Edit fingerprints, cross-tokenizer alignment and whitening against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_llm_operators import DOCS, docs, empty, odd


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))


def edits(rng, text, k):
    c = list(text)
    for _ in range(k):
        at = rng.randrange(len(c))
        c[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "q"])
    return "".join(c)


# 11 document fingerprints


def test_walk_is_written_step_by_step():
    from granary.llm.editprint import PERIOD, Walk, classes_of

    walk = Walk(0)
    own = classes_of("a walk over characters, é and 中 too " * 30)
    steps = walk.steps(own.tobytes())
    bit = {}
    for j, state in enumerate(walk.states):  # the bit of (j, c) is 1 where c moves on to step j + 1 at once
        for c in range(64):
            bit[j, c] = state[c] is walk.states[(j + 1) % PERIOD]
    j, reached = 0, []
    for c in own.tolist():
        reached.append(j)
        while not bit[j % PERIOD, c]:
            j += 1
        j += 1
    assert steps.tolist() == [*reached, j]


def test_sampled_places_are_spread_evenly():
    from granary.llm.editprint import SLOTS, Walk

    for end in (50, 4000):
        at = np.concatenate([(lambda r: r[(r < end).sum(axis=0) - 1, np.arange(SLOTS)])(Walk(seed).records) for seed in range(40)])
        assert abs(np.histogram(at, 5, (0, end))[0] / len(at) - 0.2).max() < 0.03


def expected(rows):
    """By doc_id and text, from each text alone."""
    from granary.llm.editprint import fingerprint

    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda x: -x[0])
    out = {}
    for i, (d, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        p = {k: np.frombuffer(fingerprint(t), np.uint8) for k, t in (("own", text), ("edited", changed), ("next", after))}
        out[d, text] = (len(text), hashlib.sha256(changed.encode()).hexdigest(), p["own"].tobytes(), p["edited"].tobytes(), (p["own"] == p["edited"]).mean(), (p["own"] == p["next"]).mean())
    return out


def test_prints_equal_those_of_each_text_alone(spark):
    from granary.llm.editprint import near_texts

    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 150)) for _ in range(60)]
    texts = base + [edits(rng, t, rng.randint(1, 6)) for t in base[:40] for _ in range(3)] + base[:10] + ["", None, "a", "ab", "é中😀" * 40]
    rng.shuffle(texts)
    frame = docs(spark, texts).repartition(5)
    got = near_texts(frame).collect()
    want = expected(list(enumerate(texts)))
    assert len(got) == len(texts)
    from granary.llm.editprint import APART

    rows = {r["doc_id"]: np.frombuffer(bytes(r["fingerprint"]), np.uint8) for r in got if r["n_chars"]}
    above = {d: d for d in rows}

    def top(x):
        return x if above[x] == x else top(above[x])

    for x in rows:
        for y in rows:
            if x < y and (rows[x] != rows[y]).sum() <= APART and top(x) != top(y):
                a, b = sorted((top(x), top(y)))
                above[b] = a
    for r in got:
        assert (r["n_chars"], r["edited_sha256"], bytes(r["fingerprint"]), bytes(r["edited_fingerprint"]), r["near_edited"], r["near_next"]) == want[r["doc_id"], texts[r["doc_id"]] or ""]
        assert r["class_id"] == (top(r["doc_id"]) if r["n_chars"] else r["doc_id"])
    assert sum(top(d) != d for d in rows) > 80


def test_large_group_of_near_copies_is_one_class(spark):
    from granary.llm.editprint import near_texts

    rng = random.Random(2)
    base = prose(rng, 400)
    texts = [edits(rng, base, 1) for _ in range(400)] + [prose(rng, 50) for _ in range(100)]
    got = near_texts(docs(spark, texts)).toPandas()
    assert (got[got.doc_id < 400].class_id == 0).mean() > 0.9 and (got[got.doc_id >= 400].class_id >= 400).all()


def test_likeness_follows_edits():
    from granary.llm.editprint import fingerprint

    rng = random.Random(8)
    near = lambda a, b: np.mean(np.frombuffer(fingerprint(a), np.uint8) == np.frombuffer(fingerprint(b), np.uint8))
    mean = {}
    for k in (1, 8, 60):
        mean[k] = np.mean([near(t, edits(rng, t, k)) for t in [prose(rng, 300) for _ in range(40)]])
    assert mean[1] > 0.95 > mean[8] > 0.7 > mean[60] > np.mean([near(prose(rng, 300), prose(rng, 300)) for _ in range(40)]) + 0.1


def test_prints_of_odd_rows(spark):
    from granary.llm.editprint import near_texts

    frame = odd(spark).union(spark.createDataFrame([(None, None, None, None, None)], DOCS).withColumns({c: F.lit("x") for c in odd(spark).columns[5:]}))
    got = near_texts(frame).toPandas()
    assert len(got) == frame.count()
    same = got[(got.doc_id == 3) | (got.doc_id == 4)]
    assert same.class_id.nunique() == 1 and same.fingerprint.map(bytes).nunique() == 1
    assert set(got[got.n_chars == 0].fingerprint.map(bytes)) == {bytes(224)}
    assert near_texts(empty(spark)).count() == 0
    one = near_texts(docs(spark, ["only one text"])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"only on" + b"only o").hexdigest()


# 12 cross-tokenizer alignment


@pytest.fixture(scope="module")
def paths():
    from granary.llm.queries import byte_bpe_path, piece_bpe_path

    return byte_bpe_path(), piece_bpe_path()


def whole(own, text):
    """Ids, groups and links of one text by plain encoding and sets of ends."""
    if not text:
        return [], [], "", []
    a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
    ab, bb = [own.a_bytes[i] for i in a], [own.b_bytes[i] for i in b]
    want = (" " + text).encode()
    if b"".join(ab) != want or b"".join(bb) != want:
        return [], [], "", []
    ends_a, ends_b = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
    out, i, j = [], 0, 0
    for e in sorted(set(ends_a) & set(ends_b)):
        ga, gb = [], []
        while i < len(a) and ends_a[i] <= e:
            ga.append(a[i])
            i += 1
        while j < len(b) and ends_b[j] <= e:
            gb.append(b[j])
            j += 1
        out.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
    starts_a, starts_b = [0, *ends_a], [0, *ends_b]
    links, j = [], 0
    for i in range(len(a)):
        while ends_b[j] <= starts_a[i]:
            j += 1
        k = j
        while k < len(b) and starts_b[k] < ends_a[i]:
            links.append((a[i], b[k]))
            k += 1
    return a, b, ";".join(out), links


ODD = ["a", "b", "the", " ", "  ", "\n", " \n", "\n ", "\t", " ", "　", " ", "é", "é", "ﬁ", "½", "中", "😀", "'s", "'", "1", "23", "<s>", "<|endoftext|>", "<0x41>", "▁", "\x00", "\x1c", "\x85", "\r\n",
       "ß", ".", ",", "…", "-", "_", "​", "﻿", "3.14", "x.y", "..", "U.S.", "“", "”", "—"]


def test_words_encode_as_within_their_text(paths):
    from granary.llm.alignment import Aligner, alignments

    own, rng = Aligner(*paths), random.Random(4)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 10))) for _ in range(20_000)]
    assert alignments(own, pa.array(texts)) == [whole(own, t)[2] for t in texts]
    assert alignments(own, pa.array(texts[::-1])) == [whole(own, t)[2] for t in texts[::-1]]


def check_alignment(spark, frame, paths):
    from granary.llm.alignment import aligner, groups, scored

    own = aligner(*paths)
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    made = [whole(own, t) for _, t in rows]
    count = Counter(p for m in made for p in set(m[3]))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    sha = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    want = [(d, len(a), len(b), g.count(";") + 1 if g else 0, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha(g)) for (d, _), (a, b, g, links) in zip(rows, made, strict=True)]
    got = scored(frame, *paths).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sorted(map(repr, (tuple(r) for r in groups(frame, *paths).collect()))) == sorted(repr((d, m[2])) for (d, _), m in zip(rows, made, strict=True))


def test_alignment_equals_plain_encoding(spark, paths):
    rng = random.Random(6)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 60))) for _ in range(150)] + [prose(rng, 80) for _ in range(60)] + ["x" * 5000, None, ""]
    check_alignment(spark, docs(spark, texts).repartition(4), paths)


def test_alignment_of_odd_rows(spark, paths):
    from granary.llm.alignment import scored

    check_alignment(spark, odd(spark), paths)
    assert scored(empty(spark), *paths).count() == 0


def test_colliding_hashes_are_told_apart(paths, monkeypatch):
    from granary.llm import alignment

    monkeypatch.setattr(alignment.tv, "block_hashes", lambda blocks, edge, lengths: np.ones(len(lengths), np.uint64))
    own, texts = alignment.Aligner(*paths), ["some words, and others", "more words"]
    for _ in range(2):
        assert alignment.alignments(own, pa.array(texts)) == [whole(own, t)[2] for t in texts]


# 13 whitening

VECTORS = "vec_id long, embedding array<float>, label int"


def whitened_by_eigh(vectors, k):
    x = [[int(np.floor(256 * float(np.float32(c)))) for c in v] for v in vectors]
    fit = np.array(sorted({tuple(r) for r in x}))
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, w = np.linalg.eigh(centred.T @ centred / n)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    return n, [sum((n * int(c) - int(t)) ** 2 for c, t in zip(r, s, strict=True)) for r in x], (np.array(x) - s / n) @ w / np.sqrt(e), e / np.trace(centred.T @ centred / n)


def test_whitening_equals_eigenvectors(spark):
    from granary.llm.whitening import whiten

    rng = np.random.default_rng(3)
    v = (rng.standard_normal((700, 12)) @ np.diag(np.linspace(3, 0.2, 12)) + 5).astype(np.float32)
    rows = [(i, [float(c) for c in v[i % 500]], 0) for i in range(700)]
    bad = [(800, None, 0), (801, [], 0), (802, [float("nan")] * 12, 0), (803, [float("inf")] + [0.0] * 11, 0), (804, [None] + [0.0] * 11, 0)]
    got = whiten(spark.createDataFrame(rows + bad, VECTORS).repartition(7), 4).toPandas().sort_values(["vec_id", "component"])
    n, far, white, share = whitened_by_eigh(v[:500], 4)
    assert len(got) == 2800 and (got.n == n).all() and n == 500
    mine = got.whitened.to_numpy().reshape(700, 4)
    for c in range(4):
        sign = np.sign(mine[0, c] * white[0, c])
        assert np.allclose(mine[:500, c], sign * white[:, c], atol=1e-8) and np.allclose(got.explained.to_numpy().reshape(700, 4)[:, c], share[c], rtol=1e-9)
    assert [int(d) for d in got.deviation[::4][:500]] == far
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_parts_merge_without_loss():
    from granary.llm.whitening import merged, part_of

    rng = np.random.default_rng(1)
    x = rng.integers(-900, 900, (300, 9))
    cuts = [0, 1, 3, 8, 120, 121, 300]
    part = part_of(x[:1])
    for a, b in zip(cuts[1:], cuts[2:], strict=False):
        part = merged(part, part_of(x[a:b]))
    n, sums, rows = part
    centred = x - x.mean(axis=0)
    assert n == 300 and (sums == x.sum(axis=0)).all() and np.allclose(rows.T @ rows, centred.T @ centred, rtol=1e-10)


def test_many_parts_meet_in_levels(spark):
    from granary.llm.whitening import fit

    rng = np.random.default_rng(7)
    x = np.unique(rng.integers(-50, 50, (400, 5)), axis=0)
    frame = spark.createDataFrame([(5, r.tolist()) for r in x], "d int, x array<long>").repartition(23)
    got = fit(frame, fan=2).collect()
    rows = np.frombuffer(got[0]["rows"], "<f8").reshape(5, 5)
    centred = x - x.mean(axis=0)
    assert len(got) == 1 and got[0]["n"] == len(x) and np.allclose(rows.T @ rows, centred.T @ centred, rtol=1e-10)


def test_whitening_of_odd_rows(spark):
    from granary.llm.whitening import whiten

    rows = [(None, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (1, [3.0, 4.0], 0), (2, [5.0, 6.0], 0), (3, [1.0, 2.0, 3.0], 0), (4, [-1.0, -0.0], 0)]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("x", "d", "n", "component")})
    got = whiten(frame).toPandas()
    assert set(got.component) == {1} and len(got) == 5  # all on one line: a second component has no variance; one vector of length 3 has none
    assert whiten(spark.createDataFrame([], VECTORS)).count() == 0
    huge = whiten(spark.createDataFrame([(i, [float(i) * 1e6, 0.0], 0) for i in range(50)], VECTORS)).toPandas()
    assert huge.deviation.map(int).max() > 2**63
