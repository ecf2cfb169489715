"""The pipeline's stages, each against the plainest means."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioflow.llm import exact_dedup, mixing, near_dup, packing, toxicity
from tests.llm import brute
from tests.llm.conftest import frame, prose


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_rows(df):
    return Counter((r.doc_id, r.text, r.lang, r.source) for r in df.collect())


@pytest.mark.parametrize("stage", [toxicity.stage, exact_dedup.stage, near_dup.stage, mixing.stage])
def test_stages_take_columns_of_any_name(spark, sf_dir, odd, stage):
    plain, extra = frame(spark, odd), frame(spark, odd, True)
    out = stage(spark, extra, sf_dir)
    assert out.columns == extra.columns
    assert plain_rows(out) == plain_rows(stage(spark, plain, sf_dir))


@pytest.mark.parametrize("stage", [toxicity.stage, exact_dedup.stage, near_dup.stage, mixing.stage, packing.stage])
def test_stages_of_nothing(spark, sf_dir, stage):
    assert stage(spark, frame(spark, []), sf_dir).count() == 0


ODD_IDS = [(None, 0, "a"), (None, 1, "b"), (2, 2, "a"), (2, 3, "b"), (5, 4, "c"), (7, 4, "a"), (8, 5, "a"), (8, 5, "a"), (None, 6, None), (None, 6, "a")]


@pytest.fixture(scope="module")
def ids(spark):
    """Two null ids, one id with two texts and two sources, copies, and rows that repeat."""
    return [(d, prose(500 + k, 60), "en", s) for d, k, s in ODD_IDS]


def test_toxicity_stage_judges_each_row(spark, sf_dir, ids, monkeypatch):
    texts = [(prose(k, 40) + (" you stupid idiot, worthless trash" if k % 4 == 0 else " my friend")).encode() for k in range(200)]
    chain = toxicity.fit_chain(texts, np.arange(200) % 3, np.array([k % 4 == 0 for k in range(200)]))
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: chain)
    bad = [(d, "you stupid pathetic idiot, worthless trash, moron and loser", "en", "a") for d in (None, 2, 99)]
    assert plain_rows(toxicity.stage(spark, frame(spark, ids + bad), sf_dir)) == Counter(ids)


def test_exact_stage_as_by_texts(spark, sf_dir, ids):
    rows = ids + [(1, ids[0][1].upper(), "en", "z")]
    wanted = {}
    for r in rows:
        best = wanted.get(low(r[1]))
        if best is None or (r[0] is not None and (best[0] is None or r[0] > best[0])):
            wanted[low(r[1])] = r
    found = exact_dedup.stage(spark, frame(spark, rows), sf_dir)
    assert Counter((r[0], r[1]) for r in plain_rows(found).elements()) == Counter((r[0], r[1]) for r in wanted.values())
    assert plain_rows(found) == plain_rows(exact_dedup.stage(spark, frame(spark, rows[::-1]).repartition(3), sf_dir))


def test_near_stage_keeps_the_smallest_id_of_each_class(spark, sf_dir, ids):
    words = ids[3][1].split()
    rows = ids + [(1, " ".join([*words[:30], "other", *words[31:]]), "en", "q")]
    texts = sorted({(r[0], r[1]) for r in rows}, key=lambda x: (x[0] is None, x[0] or 0))
    classes = brute.near(list(enumerate(t for _, t in texts)))
    wanted = Counter()
    groups = defaultdict(list)
    for k, (c, _) in classes.items():
        groups[c].append(texts[k])
    # of rows without ids the smallest digest's stays, here each class has at most one of them or equal texts
    for members in groups.values():
        wanted[members[0]] += 1
    found = Counter((r[0], r[1]) for r in plain_rows(near_dup.stage(spark, frame(spark, rows), sf_dir)).elements())
    assert found == wanted


def test_packing_stage_holds_every_row(spark, sf_dir, ids):
    out = packing.stage(spark, frame(spark, ids), sf_dir)
    assert out.count() == len(ids) and {r.doc_id for r in out.collect()} == {r[0] for r in ids}


def test_pipeline_stage_by_stage(spark, sf_dir):
    import corpus_pipeline
    from folioflow.llm import shared

    docs = shared.documents(spark, sf_dir)
    named = dict(corpus_pipeline.STAGES)
    assert list(named) == ["toxicity", "exact_dedup", "ngram_jaccard_join", "source_mix", "sum_of_squares_packing"]
    first = shared.scratch(named["toxicity"](spark, docs, sf_dir), "one")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id: r.text for r in first.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(before[d] == t for d, t in kept.items()) and len(kept) > 0.9 * sum(not labels.get(d) for d in before)
    second = shared.scratch(named["exact_dedup"](spark, first, sf_dir), "two")
    largest = {}
    for d, t in kept.items():
        largest[low(t)] = max(d, largest.get(low(t), d))
    assert {r.doc_id for r in second.collect()} == set(largest.values())
    third = shared.scratch(named["ngram_jaccard_join"](spark, second, sf_dir), "three")
    own = [(r.doc_id, r.text) for r in second.collect()]
    assert {r.doc_id for r in third.collect()} == {c for c, _ in brute.near(own).values()}
    fourth = shared.scratch(named["source_mix"](spark, third, sf_dir), "four")
    sizes, taken, largest_size = Counter(), Counter(), defaultdict(int)
    size = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))
    for r in third.collect():
        sizes[r.source] += size(r.text)
        largest_size[r.source] = max(largest_size[r.source], size(r.text))
    for r in fourth.collect():
        taken[r.source] += size(r.text)
    wanted = brute.targets(sizes)
    assert all(abs(taken[s] - wanted[s]) <= largest_size[s] for s in wanted) and max(Counter(r.doc_id for r in fourth.collect()).values()) <= 3
    fifth = named["sum_of_squares_packing"](spark, fourth, sf_dir).collect()
    lengths, places = Counter(), defaultdict(list)
    for r in fifth:
        lengths[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert set(lengths) == {r.doc_id for r in fourth.collect()}
    for parts in places.values():
        assert np.array_equal([o for o, _ in sorted(parts)], np.r_[0, np.cumsum([n for _, n in sorted(parts)])[:-1]]) and sum(n for _, n in parts) <= 2048
    assert corpus_pipeline.run(spark, sf_dir).count() == len(fifth)
