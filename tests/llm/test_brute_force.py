"""Whole operators against slow, plain versions of themselves written anew here."""

import cmath
import hashlib
import itertools
import math
import random
import struct
import zlib

import numpy as np
import pytest
import xxhash

from knotwork.llm import langid, media, quality, simhash
from knotwork.llm import queries as registered

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


# --- media ----------------------------------------------------------------------------------------------------------


def wav_of(payload: bytes) -> bytes:
    """A mono 8-bit file of 8000 samples a second, field by field."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def feature_of(payload: bytes) -> str:
    """Peaks and pairs by sums over samples, frame by frame and bin by bin."""
    window = [0.5 - 0.5 * math.cos(2 * math.pi * n / 575) for n in range(576)]
    turn = [cmath.exp(-2j * math.pi * n / 576) for n in range(576)]
    peaks = []
    for t, start in enumerate(range(0, len(payload) - 576 + 1, 288)):
        x = [(payload[start + n] - 128) * window[n] for n in range(576)]
        power = [abs(sum(x[n] * turn[n * k % 576] for n in range(576))) ** 2 for k in range(1, 289)]
        mean = sum(power) / 288
        for band in range(4):
            own = power[band * 72 : band * 72 + 72]
            if max(own) > 2 * mean:
                peaks.append((t, band * 72 + own.index(max(own)) + 1))
    pairs = sorted((t, (a << 12) | (b << 2) | (u - t)) for t, a in peaks for u, b in peaks if 0 < u - t <= 3)
    codes, at = np.array([c for _, c in pairs], "<i4"), np.array([t for t, _ in pairs], "<i4")
    return f"{len(peaks)}:{len(pairs)}:{hashlib.sha256(codes.tobytes() + at.tobytes()).hexdigest()[:32]}"


def test_media_by_sums(spark):
    texts = [(1, None), (2, ""), (3, "short"), (4, "a line of text\n" * 90), (5, "é日 " * 300), (None, "short"), (3, "x" * 1700)]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in texts], "doc_id long, text string, feature string, media_bytes int")
    got = sorted(map(repr, map(tuple, media.fingerprints(docs).collect())))
    want = []
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        stored = wav_of(payload)
        want.append(repr((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(payload))))
    assert got == sorted(want)


# --- quality --------------------------------------------------------------------------------------------------------


def plain_statistics(text: str) -> list[float]:
    raw = text.encode()
    if not raw:
        return [0.0] * 22
    blank = b" \t\n\x0b\x0c\r"
    words, word = [], b""
    for k in range(len(raw)):
        if raw[k] in blank:
            words, word = words + [word] * bool(word), b""
        else:
            word += raw[k : k + 1]
    words += [word] * bool(word)
    lines = [x for x in raw.split(b"\n") if any(c not in blank for c in x)]
    n, w, k = len(raw), max(len(words), 1), max(len(lines), 1)
    share = lambda test: sum(map(test, raw)) / n
    capital, small, high, digit = (lambda c: 65 <= c <= 90), (lambda c: 97 <= c <= 122), (lambda c: c > 127), (lambda c: 48 <= c <= 57)
    space = lambda c: c in blank
    ended = sum(x.rstrip(blank)[-1:] in (b".", b"!", b"?") for x in lines)
    entropy = -sum(raw.count(c) / n * math.log2(raw.count(c) / n) for c in set(raw))
    pairs = {(words[i], words[i + 1]) for i in range(len(words) - 1)}
    return [
        n, len(words), sum(map(len, words)) / w, max(map(len, words), default=0), len(set(words)) / w, max((words.count(x) for x in set(words)), default=0) / w,
        sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / w, len(lines), n / k, 1 - len(set(lines)) / k, ended / k,
        share(lambda c: capital(c) or small(c) or high(c)), share(capital), share(digit), share(space), share(lambda c: c in b",."),
        share(lambda c: not (capital(c) or small(c) or high(c) or digit(c) or space(c) or c in b",.")), share(lambda c: c == 124), share(high), entropy,
        len(pairs) / max(w - 1, 1), sum(len(x) <= 2 for x in words) / w,
    ]


@pytest.mark.parametrize("text", ["", "  \n ", "one", "One two. Two two!\n\nthree | 4,5\n", "é日 ß\tx\x0bX", "line.\nline.\nother", "a a a a b", "42 !?"])
def test_statistics_by_loops(text):
    assert np.allclose(quality.statistics(text), plain_statistics(text))


def test_lasso_is_at_its_optimum():
    """At the minimum the gradient equals the penalty against the sign of a weight, and is within it for weights of zero."""
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(800, 12))
    z = (x - x.mean(0)) / x.std(0)
    y = (z[:, 0] - 0.5 * z[:, 3] + rnd.normal(size=800) > 0).astype(float)
    w, b = quality.lasso_logistic(z, y, 0.02, rounds=3000)
    gradient = z.T @ (1 / (1 + np.exp(-(z @ w + b))) - y) / len(y)
    assert (w == 0).any() and w[0] > 0 > w[3]
    assert np.allclose(gradient[w != 0], -0.02 * np.sign(w[w != 0]), atol=1e-4) and (np.abs(gradient[w == 0]) <= 0.02 + 1e-4).all()


def test_quality_query_by_loops(spark):
    """The query's scores are the sums of the rules that hold, text by text."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    got = {r.doc_id: r.score for r in registered.op1_quality_rules(spark, SMALL).collect()}
    for r in docs.collect():
        x = quality.statistics(r.text)
        total = model.bias
        for conditions, weight in model.rules:
            if all(x[k] > t if above else x[k] <= t for k, above, t in conditions):
                total += weight
        for k, low, high, weight in model.linear:
            total += min(max(x[k], low), high) * weight
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-total))) < 1e-9


def test_quality_of_repeated_rows_and_ties(spark):
    """Labels of an id that tie count as 1; of documents that share an id one is learned from; equal texts score alike."""
    good, bad = "A good sentence, well told. " * 20, "buy | buy | buy 4 4 4\n" * 20
    rows = [(i, good if i % 2 else bad, "x") for i in range(400)] + [(1, bad, "x"), (1, good, "x"), (None, good, "x"), (None, bad, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(2, 1), (3, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    scores = {}
    for r in quality.score(docs, model).collect():
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert len({s for group in scores.values() for s in group}) == 2 and scores[None] == scores[1] and len(scores[1]) == 2
    left = quality.keep_good(docs, model).collect()
    assert {r.text for r in left} == {good} and len(left) == 202


# --- language -------------------------------------------------------------------------------------------------------


def plain_mixture(counts, logs, chosen):
    """(likelihood, shares) by expectation-maximisation, one n-gram at a time, with the operator's number of rounds."""
    share = dict.fromkeys(chosen, 1 / len(chosen))
    total = sum(counts.values())
    for _ in range(langid.ROUNDS if len(chosen) > 1 else 0):
        new = dict.fromkeys(chosen, 0.0)
        for g, n in counts.items():
            parts = {k: share[k] * math.exp(logs[k][g]) for k in chosen}
            for k in chosen:
                new[k] += n * parts[k] / sum(parts.values()) / total
        moved = max(abs(new[k] - share[k]) for k in chosen)
        share = new
        if moved < langid.TOLERANCE:
            break
    fit = sum(n * math.log(sum(share[k] * math.exp(logs[k][g]) for k in chosen)) for g, n in counts.items())
    return fit, share


def language_model():
    rnd = random.Random(12)
    words = {lang: ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(60)] for lang, letters in {"aa": "abcde", "bb": "defghi", "cc": "jklmna", "dd": "opqrse"}.items()}
    text = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    table = np.full((4, langid.BUCKETS), langid.SMOOTHING)
    for k, lang in enumerate(sorted(words)):
        found = langid.trigram_counts(text(lang, 3000))
        table[k, found[0]] += found[1]
    return sorted(words), np.log(table / table.sum(1, keepdims=True)), text


def test_mixtures_against_all_language_sets():
    langs, logs, text = language_model()
    for parts in ([("aa", 60)], [("aa", 60), ("bb", 30)], [("cc", 50), ("dd", 50), ("aa", 25)], [("bb", 6)], [("dd", 200), ("cc", 40)]):
        doc = " ".join(text(*p) for p in parts)
        buckets, n = langid.trigram_counts(doc)
        counts = dict(zip(buckets.tolist(), n.tolist(), strict=True))
        price = langid.PENALTY * math.log(sum(counts.values()) + 1)
        fits = {s: plain_mixture(counts, logs, s) for r in range(1, 5) for s in itertools.combinations(range(4), r)}
        best = max(fits, key=lambda s: fits[s][0] - price * len(s))
        name, share, mixture = langid.infer(doc, langs, logs)
        assert set(mixture) == {langs[k] for k in best} == {p for p, _ in parts}
        assert all(abs(mixture[langs[k]] - fits[best][1][k]) < 1e-9 for k in best)
        assert name == max(parts, key=lambda p: p[1])[0] or len(parts) == 3 and name in ("cc", "dd")
        assert share == max(mixture.values())


def test_trigrams_do_not_depend_on_batches():
    rnd = random.Random(4)
    for _ in range(60):
        doc = "".join(rnd.choice("abcÄß日İ .!\n1") for _ in range(rnd.randint(0, 40)))
        whole = langid.trigram_counts(doc)
        letters = "".join(c if c.isalpha() else " " for c in doc.lower())
        plain = " " + "".join(c for k, c in enumerate(letters) if c != " " or k == 0 or letters[k - 1] != " ") + " "
        assert (whole is None) == (not any(c.isalpha() for c in doc))
        assert whole is None or whole[1].sum() == len(plain) - 2
        for batch in (1, 2, 3, 7):
            part = langid.trigram_counts(doc, batch)
            assert (part is None) == (whole is None) and (whole is None or all((a == b).all() for a, b in zip(whole, part, strict=True)))


# --- SimHash --------------------------------------------------------------------------------------------------------


def plain_fingerprint(text) -> int:
    words, word = [], ""
    for c in (text or "").translate({k: k + 32 for k in range(65, 91)}) + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(n, linked):
    root = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def test_near_duplicates_by_all_pairs(spark):
    """Edited copies of texts, among them pairs one and two bits apart, chains and texts without words."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    texts = [None, "", " \n", "One", "one", "ONE two", "É é"]
    for _ in range(10):
        words = [word() for _ in range(700)]
        texts.append(" ".join(words))
        for _ in range(7):
            words[rnd.randrange(700)] = word()
            texts.append(" ".join(words).upper() if rnd.random() < 0.3 else " ".join(words))
    texts.append("long " * 60_000)
    ids = rnd.sample(range(1000), len(texts))
    prints = [plain_fingerprint(t) for t in texts]
    apart = lambda a, b: (prints[a] ^ prints[b]).bit_count()
    near = {apart(a, b) for a in range(len(texts)) for b in range(a)}
    assert {1, 2, 3} <= near
    root = joined(len(texts), lambda a, b: apart(a, b) <= 2)
    want = {ids[k]: (f"{prints[k]:016x}", min(ids[j] for j in range(len(texts)) if root[j] == root[k])) for k in range(len(texts))}
    docs = spark.createDataFrame(list(zip(ids, texts, texts, strict=True)), "doc_id long, text string, fp string")
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == want


def test_simhash_query_by_all_pairs(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    prints = [plain_fingerprint(t) for _, t in docs]
    root = joined(len(docs), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    want = {docs[k][0]: (f"{prints[k]:016x}", docs[root[k]][0]) for k in range(len(docs))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in registered.op6_simhash(spark, SMALL).collect()} == want


def test_recall_of_near_copies(spark):
    """Of the pairs of different shingle sets with a similarity of 0.8 that 10,000 documents hold, 99 in 100 are linked.

    Pairs are found by the shingles that at most 60 sets hold: similar sets share some of those here.
    """
    docs = spark.read.parquet(f"{LARGE}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    sets = {r.doc_id: simhash.sketch(r.text)[3] for r in docs.collect()}
    by = {}
    for i, s in sets.items():
        by.setdefault(s.tobytes(), i)
    assert all(got[i] == got[by[s.tobytes()]] for i, s in sets.items())
    every = np.concatenate([sets[i] for i in by.values()])
    owner = np.repeat(np.array(list(by.values())), [len(sets[i]) for i in by.values()])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    starts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    candidates = set()
    for a, b in zip(starts, np.append(starts[1:], len(every)), strict=True):
        if 2 <= b - a <= 60:
            candidates.update(itertools.combinations(owner[a:b].tolist(), 2))
    similar = []
    for i, j in candidates:
        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            similar.append((i, j))
    assert len(similar) >= 40 and sum(got[i] != got[j] for i, j in similar) <= 0.01 * len(similar)
    # and each class is joined by similar pairs or equal sets
    root = {i: i for i in by.values()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in similar:
        root[find(i)] = find(j)
    assert len({got[i] for i in by.values()}) >= len({find(i) for i in by.values()})
