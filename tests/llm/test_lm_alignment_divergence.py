"""The language model, the alignment of tokenizers and the divergence audit: parts against plain means, and odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import alignment, divergence, elias_fano, ngram_lm, shared
from tests.llm import brute
from tests.llm.conftest import frame, prose


@pytest.mark.parametrize(("n", "top"), [(0, 9), (1, 1), (1, 10**12), (1000, 50), (1000, 10**9), (5, 2**40), (64, 64)])
def test_sequences(n, top):
    draw = np.random.default_rng(n)
    values = np.sort(draw.integers(0, top, n))
    own = elias_fano.Sequence.of(values)
    assert (own[np.arange(n)] == values).all()
    bounds = np.r_[draw.integers(0, top + 5, 500), values, values + 1, 0, 3 * top]
    assert (own.successor(bounds) == np.searchsorted(values, bounds)).all()


@pytest.mark.parametrize("size", [0, 1, 3000])
def test_levels_in_buffers_and_files(tmp_path, size):
    draw = np.random.default_rng(size)
    pairs = np.unique(np.stack([draw.integers(0, 500, size) * 7, draw.integers(0, 2**30, size) % draw.integers(1, 2**30, max(size, 1))[:size]]), axis=1)
    contexts, words = pairs
    at = np.arange(len(words))
    data = elias_fano.Level.of(contexts, words, at % 255, at % 77).to_bytes()
    (tmp_path / "level").write_bytes(data)
    other = draw.integers(0, 4000, 2000), draw.integers(0, 50, 2000)
    known = {(c, w): k for k, (c, w) in enumerate(zip(contexts.tolist(), words.tolist(), strict=True))}
    for level in (elias_fano.Level.at(data), elias_fano.Level.mapped(str(tmp_path / "level"))):
        assert (level.find(contexts, words) == at).all() and (level.counts[at] == at % 77).all() and (level.codes == at % 255).all()
        assert level.find(*other).tolist() == [known.get(x, -1) for x in zip(*(o.tolist() for o in other), strict=True)]
    # about two bits a value above the logarithm of the mean gap, a byte for the code, and the count's seven bits
    assert size < 3000 or len(data) < 9 * len(words)


def test_packing_of_numbers():
    for values in (np.zeros(0, np.int64), np.array([0, 255, 256, 2**40]), np.arange(1000)):
        assert (ngram_lm.unpack(ngram_lm.pack(values)) == values).all()
    runs = np.array([3, 1, 2])
    values = np.array([5, 9, 2**33, 0, 7, 8])
    assert (ngram_lm.unpack_runs(ngram_lm.pack_runs(values, runs), runs) == values).all()


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_of_odd_rows(spark, odd, order, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BLOCK", 60_000)
    rows = [(d, t) for d, t, *_ in odd if d != 10 and d is not None] + [(k, prose(k % 9, 60)) for k in range(100, 130)]
    docs = frame(spark, [(d, t, "en", "a") for d, t in rows], extra=True)
    found = {r.doc_id: tuple(r)[1:] for r in ngram_lm.score(docs, order).collect()}
    wanted = brute.language_model(rows, order, ngram_lm.MU, ngram_lm.STEP)
    assert set(found) == set(wanted)
    for d, (held, n, known, tokens, base, score) in wanted.items():
        assert found[d][:4] == (held, n, known, tokens)
        assert found[d][4] == pytest.approx(base, rel=1e-9) and found[d][5] == pytest.approx(score, abs=0.2 + 2e-4 * n)


def test_language_model_without_training_texts(spark):
    held = next(k for k in range(100) if ngram_lm.is_held(k))
    row = ngram_lm.score(frame(spark, [(held, "a b", "en", "a")])).first()
    assert tuple(row) == (held, True, 3, 0, 0, 0.0, 0.0)
    assert ngram_lm.score(frame(spark, [])).count() == 0
    twice = ngram_lm.score(frame(spark, [(None, "a b", None, None)] * 2)).collect()
    assert twice[0] == twice[1] and (twice[0].doc_id, twice[0].held_out, twice[0].train_tokens) == (None, False, 6)


ODD_TEXTS = ["<|endoftext|> It's 12 A.B. \x1c y　z", "é" * 70 + "x", "x" * 20000, " \t\n", " a", "a  b \n\n c\n d.\n\ne ", "²½. ؟ ٣, \r\n x y z . a\n", "<s> </s> <unk> ▁x y▁ z", "\n", "a\n", "日本語。テキスト, ok", "😀😀! \x00 a", "", None, "a ", "a  b", "กขคง" * 300]


@pytest.mark.parametrize("most", [alignment.PAIRS, 10])
def test_alignment_of_odd_texts(spark, odd, most):
    """Both ways of bringing counts back to documents."""
    rows = [(100 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(d, t) for d, t, *_ in odd if d is not None and d not in (10, 15)]
    found = alignment.align(frame(spark, [(d, t, None, None) for d, t in rows], extra=True), most=most).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == brute.alignment(rows) and len(found) == len(rows)


def test_alignment_of_repeated_rows_and_none(spark):
    twice = alignment.align(frame(spark, [(None, "one word", None, None)] * 2)).collect()
    assert twice[0] == twice[1] and twice[0].count_sum == 2 * twice[0].n_links == 2 * twice[0].n_best
    assert alignment.align(frame(spark, [])).count() == 0


def test_groups_over_large_sets():
    draw = np.random.default_rng(1)
    ends = [np.unique(np.r_[draw.integers(1, 5000, 900), 5000]) for _ in range(2)]
    cuts, upto_a, upto_b = alignment.groups(*ends, 5000)
    wanted = np.intersect1d(*ends)
    assert (cuts == wanted).all() and (upto_a == np.searchsorted(ends[0], wanted, "right")).all() and (upto_b == np.searchsorted(ends[1], wanted, "right")).all()


def audit_rows(seed, n=90):
    draw = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)] + ["É", "日本", "A"]
    return [(" 1, ".join(draw.choice(words[: 3 + (k % 5) * 20]) for _ in range(draw.randrange(40))), draw.choice(["en", "fr", None, "x"]), draw.choice(["a", "b", None, "c9"])) for k in range(n)] + [(None, "xx", "a"), ("", "xx", "b"), ("only", "yy", "a")]


@pytest.mark.parametrize("width", [None, 3])
def test_divergence(spark, width, monkeypatch):
    """With a sketch that keeps apart what is rare, and with one that is full: the same result."""
    monkeypatch.setattr(divergence, "CHUNK", 8 if width else divergence.CHUNK)
    rows = audit_rows(7)
    docs = frame(spark, [(k, *r) for k, r in enumerate(rows)], extra=True).repartition(5)
    found = {tuple(r)[:4]: tuple(r)[4:] for r in divergence.divergence(docs, width).collect()}
    assert found == brute.divergence(rows) and ("xx", "a", "pair", "b") in found


def test_divergence_ranks_and_empty_tables(spark):
    rows = audit_rows(8)
    docs = frame(spark, [(k, *r) for k, r in enumerate(rows)])
    found = {tuple(r)[:4]: tuple(r)[4:] for r in divergence.divergence(docs, ranks=3).collect()}
    assert found == brute.divergence(rows, ranks=3)
    assert divergence.divergence(frame(spark, [])).count() == 0


def test_sketches_never_underestimate(spark):
    rows = audit_rows(9, 300)
    docs = frame(spark, [(k, *r) for k, r in enumerate(rows)])
    for width in (4, 12):
        bits = np.unpackbits(divergence.frequent_cells(divergence.tallies(docs), width))
        documents: dict = {}
        for text, lang, _ in rows:
            for t in set(divergence.terms((text or "").encode())):
                documents[lang or "", t] = documents.get((lang or "", t), 0) + 1
        for (lang, t), n in documents.items():
            at = divergence.cells(lang, [t], width)[:, 0] + (np.arange(divergence.DEPTH) << width)
            assert n < divergence.LEAST or bits[at].all()
    assert width == 12 and not all(bits[divergence.cells(g, [t], width)[:, 0] + (np.arange(divergence.DEPTH) << width)].all() for (g, t), n in documents.items() if n < divergence.LEAST)


def test_shares_of_large_counts(spark):
    n = 10**13
    assert spark.range(1).select(divergence.share(F.lit(n), F.lit(3 * n), F.lit(5))).first()[0] == 1 + 10**9 * (n + 1) // (3 * n + 5)
    assert shared.Numbers()["x"] == 0
