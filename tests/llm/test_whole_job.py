"""Work that the operators once left out."""

import corpus_pipeline
import numpy as np
import pytest

from quirelake.llm import licenses, media, packing, url_rules


# -- 7 packing ----------------------------------------------------------------------


def test_fractional_solution_covers_every_class():
    sizes, counts = np.array([640, 820, 1000, 1365, 1450, 2100]), np.array([310, 290, 450, 120, 700, 80])
    uses = packing._fractional(sizes, counts, 4096, *packing.GUESSES[0])
    assert all((c * sizes).sum() <= 4096 for c, _ in uses)
    assert (sum(c * x for c, x in uses) >= counts * (1 - 1e-6)).all()


def test_plan_of_few_lengths():
    """The best configuration fills 97.7%, and best fit alone needs 117 sequences."""
    sizes, counts = np.array([1050, 1900]), np.array([200, 100])
    made = packing.plan(sizes, counts, 4096)
    assert sum(t for _, t in made) == 100
    assert (sum(c * t for c, t in made) == counts).all() and all((c * sizes).sum() <= 4096 for c, _ in made)


# -- 3 URL rules --------------------------------------------------------------------


def test_rules_from_late_tokens(spark):
    """Only a query key after eighteen path words tells bad URLs."""
    deep = "/".join(f"{a}{b}" for a in "abc" for b in "uvwxyz")
    urls = [(f"http://a.com/{deep}?{'evil' if i % 2 else 'good'}=1", bool(i % 2)) for i in range(40)]
    mined = url_rules.mine(spark.createDataFrame(urls, "url string, bad boolean"), min_confidence=0.9)
    assert {tuple(r["items"]) for r in mined.collect()} == {("key:evil",)}


# -- 5 licenses ---------------------------------------------------------------------


def test_notice_with_words_put_in(spark):
    words = licenses.TEMPLATES["mit"].split()
    texts = [(i, " ".join([*words[:40], *[f"in{k}" for k in range(n)], *words[40:]])) for i, n in enumerate((0, 15, 30))]
    texts.append((9, " ".join(words[: len(words) // 2])))
    got = licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).where("license = 'mit'").collect()
    assert sorted(r.doc_id for r in got) == [0, 1, 2] and all(r.coverage > 0.9 and r.start_word == 0 for r in got)
    part = licenses.scan(spark.createDataFrame(texts[3:], "doc_id long, text string"), min_coverage=0.4).where("license = 'mit'").collect()
    assert len(part) == 1 and part[0].coverage < 0.6


# -- 1 media ------------------------------------------------------------------------


def test_corners_of_captioned_and_cropped_images():
    rng = np.random.default_rng(4)
    for _ in range(5):
        plain = media._box(media._box(rng.normal(128, 120, (320, 320)), 1), 1)
        captioned, crop = plain.copy(), plain[100:220, 90:210]
        captioned[-60:] = 255 * (rng.random((20, 107)) < 0.5).repeat(3, axis=0).repeat(3, axis=1)[:, :320]
        own = media.describe(plain)
        assert media.agree(own, media.describe(captioned)) >= media.MIN_MATCHES
        assert media.agree(own, media.describe(crop)) >= media.MIN_MATCHES
        assert media.agree(own, media.describe(np.fliplr(media._box(rng.normal(128, 120, (320, 320)), 2)))) < media.MIN_MATCHES


# -- pipeline -----------------------------------------------------------------------


def test_letterless_rows_go_without_labels(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, None), (3, "12 34", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [1]


def test_program_where_best_fit_is_far_off():
    """Lengths around a third of the capacity: best fit puts two in most sequences, the program three."""
    rng = np.random.default_rng(1)
    sizes, counts = np.unique(rng.integers(1166, 1567, 400), return_counts=True)
    made, bound = packing.solved(sizes, counts)
    used = sum(t for _, t in made)
    assert bound >= -(-int((sizes * counts).sum()) // 4096) and used <= 1.04 * bound
    assert used < 0.95 * sum(t for _, t in packing._best_fit(sizes, counts, 4096))
    assert (sum(c * t for c, t in made) == counts).all() and all((c * sizes).sum() <= 4096 for c, _ in made)


def test_lower_bound():
    """By prices of the lengths it is the bound of the total length, or more where no configuration is full."""
    sizes, counts = np.array([3, 5]), np.array([10, 7])
    assert packing.lower_bound(sizes, counts, sizes / 10, 10) == pytest.approx(65 / 10)
    assert packing.lower_bound(np.array([6]), np.array([9]), np.array([0.6]), 10) == pytest.approx(9)
    assert packing.solved(np.zeros(0, int), np.zeros(0, int)) == ([], 0)


def test_program_of_few_classes_reaches_its_gap():
    """Multiplicative weights ended 1.5 % above their lower bound here."""
    sizes, counts = np.unique(np.random.default_rng(7).choice(np.random.default_rng(6).integers(300, 3000, 39), 20000), return_counts=True)
    made, bound = packing.solved(sizes, counts)
    assert sum(t for _, t in made) <= bound * (1 + packing.GAP)
    assert (sum(c * t for c, t in made) == counts).all() and all((c * sizes).sum() <= 4096 for c, _ in made)


@pytest.mark.parametrize("low, high, n", [(1166, 1567, 400), (900, 1500, 4000)])
def test_program_of_many_classes_reaches_its_gap(low, high, n):
    """Multiplicative weights ended 2.2 and 2.8 % above their lower bound here."""
    sizes, counts = np.unique(np.random.default_rng(1).integers(low, high, n), return_counts=True)
    made, bound = packing.solved(sizes, counts)
    assert len(sizes) > 250 and sum(t for _, t in made) <= max(bound + 1, bound * (1 + packing.GAP))
    assert (sum(c * t for c, t in made) == counts).all() and all((c * sizes).sum() <= 4096 for c, _ in made)
