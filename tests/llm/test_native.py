"""Exact dedup, mixing and URL filters against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from knotwork.llm import exact_dedup, mixing, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, n long, kept string, norm string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "h", 1, "k", "n") for i, t, s in rows], DOCS)


def fold(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


ROWS = [(1, "Abc", "a"), (2, "abc", "a"), (3, None, None), (4, "", "b"), (5, "É", "b"), (6, "é", "b"), (7, "abc ", "a"), (8, "x" * 100_000, "c"), (9, "X" * 100_000, "c"), (9, "X" * 100_000, "c"), (None, "abc", "a")]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    """With a weak hash almost all texts collide, and the bytes must tell them apart."""
    given = {"content_hash": lambda norm: F.length(norm) % 2} if weak else {}
    got = exact_dedup.duplicate_groups(docs_of(spark, ROWS), **given).collect()
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(fold(t), []).append(i)
    want = sorted((repr(i), repr(max((x for x in groups[fold(t)] if x is not None), default=None)), len(groups[fold(t)]), hashlib.sha256(fold(t).encode()).hexdigest()) for i, t, _ in ROWS)
    assert sorted((repr(r.doc_id), repr(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sorted(r.doc_id for r in got if r.kept) == [2, 4, 5, 6, 7, 9]


def test_exact_filter_and_empty(spark):
    docs = docs_of(spark, ROWS)
    left = exact_dedup.drop_duplicates(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 6, 7, 9]
    assert exact_dedup.duplicate_groups(docs.limit(0)).count() == 0 and exact_dedup.drop_duplicates(docs.limit(0)).count() == 0


def fair(sizes, cycle=3, most=3):
    """Targets by rounds of resharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % cycle + 1 for k, s in enumerate(names)}
    total, held = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(held.values())
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return held | target
        held |= {s: float(most * sizes[s]) for s in over}


def test_mix_against_rounds(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join("w" * rnd.randint(1, 9) for _ in range(rnd.choice([0, 1, 5, 50, 300]))) or None, rnd.choice(["a"] * 20 + ["b", "c", "d", None])) for i in range(600)]
    rows += [(700, "one two", "tiny"), (None, "x y", "a"), (701, " \t\n", "a"), (702, "same", "b"), (702, "same", "b")]
    docs = docs_of(spark, rows)
    got = mixing.mix(docs, stretch_rows=50).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(repr((r.doc_id, r.size)) for r in got) == sorted(repr((i, size(t))) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = fair(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(r.size for r in own) / 2 + 1e-6
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in own)
        assert max(r.copies for r in own if r.size) - min(r.copies for r in own if r.size) <= 1
    again = mixing.mix(docs.repartition(7), stretch_rows=9).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.mix(docs.limit(0)).count() == 0
    mixed = mixing.mixed(docs, stretch_rows=20)
    assert mixed.columns == docs.columns and mixing.mixed(docs.limit(0)).count() == 0
    texts = {}
    for i, t, s in rows:
        texts.setdefault(i, []).append((t, s))
    want = sorted(repr((r.doc_id, r.size)) for r in got for _ in range(r.copies))
    assert sorted(repr((r.doc_id, size(r.text))) for r in mixed.collect()) == want
    assert all((r.text, r.source) in texts[r.doc_id] and (r.h, r.n, r.kept) == ("h", 1, "k") for r in mixed.collect())


def test_heavier_weights_come_first(spark):
    """Source a keeps 2 of 3 documents: keys -ln(u) / w below t, so 1 - exp(-w t) of those of weight w; t is 2.29."""
    docs = docs_of(spark, [(i, "a", "ab"[i % 2]) for i in range(8000)])
    found = mixing.mix(docs, quality=lambda text, size: F.when(F.col("doc_id") % 4 < 2, 1.0).otherwise(0.25)).collect()
    own = [r for r in found if r.source == "a"]
    share = [sum(r.taken for r in own if r.doc_id % 4 == k) / 2000 for k in (0, 2)]
    assert abs(sum(share) / 2 - 2 / 3) < 1e-3 and abs(share[0] - 0.899) < 0.03 and abs(share[1] - 0.436) < 0.04


def test_mix_of_one_weight_for_all_and_of_repeated_rows(spark):
    """Texts without spaces all have the least weight: the last stretch still holds few rows. Equal rows are cut exactly."""
    rows = [(i, "日本語" * 200, "a") for i in range(3000)] + [(i, "b c", "b") for i in range(3000, 9000)]
    docs = docs_of(spark, rows)
    assert docs.select(mixing.word_length_quality(F.col("text"), mixing.word_count(F.col("text"))).alias("q")).agg(F.min("q")).first()[0] < 0.01
    names = ["_mix_id", "_mix_source", "_mix_size", "_mix_key", "_mix_place"]
    drawn = mixing.drawn(docs, "doc_id", "source", "text", mixing.word_length_quality, 42).select(*names).cache()
    plan, _ = mixing.planned(drawn, 40)
    held = drawn.join(plan, F.col("_mix_source").eqNullSafe(F.col("source"))).filter("_mix_place between low and high").groupBy("source").count().collect()
    assert held and all(0 < r["count"] <= 40 for r in held)
    hot = docs_of(spark, [(5, "x y z", "a")] * 2000 + [(i, "x y", "a") for i in range(10, 400)] + [(i, "z", "b") for i in range(400, 5000)]).repartition(5)
    found = mixing.mix(hot, stretch_rows=30).collect()
    for s in "ab":
        own = [r for r in found if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1.5
    assert mixing.mixed(hot, stretch_rows=30).filter("doc_id = 5").count() == sum(r.copies for r in found if r.doc_id == 5)


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = fold(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules(spark):
    rnd = random.Random(2)
    rules = [*url_filter.RULES, ("a.b", "", "block"), ("b", "/x", "allow"), ("c", "/very/long/pa", "block"), ("b", "/x", "block")]
    hosts = ["com", "EXAMPLE.com", "www.example.com", "a.b", "z.a.b", "ab", "xnet", "x.net", "c", "", "..", "b."]
    urls = [None, "", "no scheme", "http://", "x://a.b?q#f", "http://com" + "/a" * 5000, "h://" + ".".join("q" * 50) + ".net/es/"]
    urls += [f"http://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en/', '/es/1', '/x', '/xy/z', '/very/long/path'])}{rnd.choice(['', '?a=/en/', '#/es/'])}" for _ in range(300)]
    rows = [(k % 250, u, "b", "r") for k, u in enumerate(urls)] + [(1, urls[1], "b", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, best string, rule string")
    got = url_filter.judge(pages, url_filter.rule_table(spark, rules))
    assert sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got.collect()) == sorted(repr((i, *judged(u, rules))) for i, u, _, _ in rows)
    assert url_filter.judge(pages.limit(0), url_filter.rule_table(spark)).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, url_filter.rule_table(spark).limit(0)).collect()} == {"allow"}
