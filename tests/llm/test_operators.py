import hashlib
import re
import wave
import zlib
from collections import Counter, defaultdict
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import exact_dedup, language_id, mixing, near_dup, packing, quality, shared, substring_dedup, toxicity, warc_audit, wav_fingerprint
from folioflow.llm.components import components
from tests.llm import brute
from tests.llm.conftest import frame, prose

KEY = lambda r: tuple((x is None, x) for x in r)


def both(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.mark.parametrize("extra", [False, True])
def test_near_copies_as_by_all_pairs(spark, odd, extra):
    found = near_dup.near_dup(frame(spark, odd, extra)).collect()
    assert len(found) == len(odd)
    wanted = brute.near(both(odd))
    assert {r.doc_id: (r.class_id, r.n_links) for r in found if r.doc_id is not None} == wanted
    assert all(r.class_id is None and r.n_links == 0 for r in found if r.doc_id is None)
    assert wanted[3][0] == 1 and wanted[4] == (4, 0)


def chain(seed, n, words=90, step=5):
    """Texts of which each differs from the one before in a word."""
    own = prose(seed, words).split()
    return [(k, " ".join([*own[: step * k], f"new{k}", *own[step * k + 1 :]]), "en", "a") for k in range(n)]


def test_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 3)
    rows = chain(9, 17)
    found = near_dup.near_dup(frame(spark, rows)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == brute.near(both(rows))


def test_prefixes_are_shortened_only_where_links_are_few(spark, monkeypatch):
    """A dense group keeps to long prefixes, and a text that is near to one other only is searched on; no link is lost."""
    asked = []
    verified = near_dup.verified
    monkeypatch.setattr(near_dup, "verified", lambda members, sets, threshold, depth, slots: asked.append((depth, {r.cls for r in members.where("searching").collect()})) or verified(members, sets, threshold, depth, slots))
    dense = [(k, prose(11, 400) + f" tail{k}", "en", "a") for k in range(60)]
    rows = dense + [(100, prose(12, 60), "en", "a"), (101, prose(12, 60) + " more", "en", "a")]
    found = near_dup.near_dup(frame(spark, rows)).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == brute.near(both(rows))
    assert [d for d, _ in asked] == [near_dup.DEPTH, near_dup.least_depth(0.8)] and len(asked[0][1]) == 62 and len(asked[1][1]) == 2


def test_unlike_candidates_of_a_large_cluster_are_parted(spark, monkeypatch):
    """Texts that share two fifths of their shingles are linked by nodes now and then; they are parted before they are verified."""
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    edges = near_dup.agreeing_edges
    seen = []
    monkeypatch.setattr(near_dup, "agreeing_edges", lambda *a: seen.append(a[1].count()) or edges(*a))
    monkeypatch.setattr(near_dup, "candidate_edges", lambda found, searching, depth: searching.sparkSession.createDataFrame([(int(b), int(a)) for a, b in zip(ids, ids[1:], strict=False)], "a long, b long"))
    shared_words = prose(13, 60)
    rows = [(k, shared_words + " " + prose(200 + k // 2, 40) + f" t{k}", "en", "a") for k in range(24)]
    docs = frame(spark, rows)
    ids = list(range(24))
    monkeypatch.setattr(near_dup.F, "monotonically_increasing_id", lambda: F.col("first.doc_id"))
    found = near_dup.near_dup(docs).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == brute.near(both(rows))
    assert seen and max(seen) == 24


def test_stage_keeps_rows_without_or_with_repeated_ids(spark, sf_dir):
    texts = [prose(k, 60) for k in range(20, 27)]
    near = lambda t: t.replace(t.split()[30], "changed", 1)
    rows = [(None, texts[0]), (None, texts[1]), (None, near(texts[1])), (5, texts[2]), (5, texts[3]), (5, texts[3]), (None, near(texts[3])), (6, texts[4]), (4, near(texts[4])), (None, texts[5]), (7, texts[6]), (None, None), (5, "")]
    found = [(r.doc_id, r.text) for r in near_dup.stage(spark, frame(spark, [(*r, "en", "a") for r in rows]), sf_dir).collect()]
    either = [r for r in found if r in rows[1:3]]
    assert len(either) == 1
    wanted = [rows[k] for k in (0, 3, 4, 8, 9, 10, 11, 12)]
    assert sorted((r for r in found if r not in either), key=str) == sorted(wanted, key=str)


def test_least_depth_meets_the_recall():
    d = near_dup.least_depth(0.8)
    assert near_dup.meets(0.8, d) >= near_dup.RECALL > near_dup.meets(0.8, d + 1)
    assert near_dup.least_depth(0.2) == 1


def test_paths_agree_as_often_as_sets():
    draw = np.random.default_rng(3)
    one = draw.integers(0, 1 << 63, 4000).astype(np.uint64)
    two = np.r_[one[:3556], draw.integers(0, 1 << 63, 444).astype(np.uint64)]
    share = (near_dup.paths(one).view(np.uint8) == near_dup.paths(two).view(np.uint8)).mean()
    assert abs(share - 0.8) < 0.08


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 20)] + [(40, 41), (50, 50)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {k: 1 for k in range(2, 21)} | {41: 40}


@pytest.mark.parametrize("extra", [False, True])
def test_exact_copies(spark, odd, extra):
    found = exact_dedup.exact_dedup(frame(spark, odd, extra)).collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = defaultdict(list)
    for d, t in both(odd):
        groups[low(t)].append(d)
    wanted = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        wanted += [(d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()) for d in ids]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in found), key=KEY) == sorted(wanted, key=KEY)


def test_index_goes_on(spark, tmp_path):
    path = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(spark, path)
    exact_dedup.exact_dedup(frame(spark, [(5, "a", None, None), (6, "b", None, None)]), index).collect()
    again = exact_dedup.DigestIndex(spark, path)
    found = exact_dedup.exact_dedup(frame(spark, [(9, "A", None, None), (10, "c", None, None)]), again).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in found} == {(9, 5, False), (10, 10, True)}
    assert again.table().count() == 3


def test_index_is_reopened_with_its_own_buckets(spark, tmp_path):
    path, rows = str(tmp_path / "index"), [(k, f"text {k}", None, None) for k in range(100)]
    index = exact_dedup.DigestIndex(spark, path, 8)
    exact_dedup.exact_dedup(frame(spark, rows), index).collect()
    spark.sql(f"DROP TABLE {index.name}")  # as in a new session
    with pytest.raises(ValueError, match="8 buckets"):
        exact_dedup.DigestIndex(spark, path, 5)
    again = exact_dedup.DigestIndex(spark, path)
    assert again.buckets == 8 and not any(r.kept for r in exact_dedup.exact_dedup(frame(spark, [(k + 1000, t, *r) for k, t, *r in rows]), again).collect())
    again.compact(5)
    spark.sql(f"DROP TABLE {again.name}")
    last = exact_dedup.DigestIndex(spark, path)
    assert (last.buckets, last.generation, last.table().count()) == (5, 1, 100)
    assert not any(r.kept for r in exact_dedup.exact_dedup(frame(spark, [(k + 1000, t, *r) for k, t, *r in rows]), last).collect())


@pytest.mark.parametrize("batches", [2, 3])
def test_batches_keep_the_largest_id(spark, odd, batches):
    key = lambda df: sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest)) for r in df.collect()), key=KEY)
    assert key(exact_dedup.exact_dedup(frame(spark, odd), batches=batches)) == key(exact_dedup.exact_dedup(frame(spark, odd)))


def test_repeats_are_cut_as_by_all_strings(spark, odd):
    rows = [r for r in odd if r[0] != 16] + [(20, "ab" * 400, None, "a"), (21, "ba" * 300, None, "a"), (22, prose(2, 40)[3:160] + "\x00" * 60, None, "a"), (23, "\x00" * 55, None, "b")]
    found = substring_dedup.substring_dedup(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=KEY) == sorted(brute.cut(both(rows)), key=KEY)
    for r in found:
        assert len(r.kept) == r.n_bytes - r.n_removed and sum(b - a for a, b in zip(r.starts, r.ends, strict=True)) == r.n_removed


def test_hot_anchors_and_pieces_of_long_texts(spark, odd):
    passage = prose(2, 60)
    rows = [r for r in odd if r[0] not in (15, 16)] + [(100 + k, f"{prose(300 + k, 8)} {passage} {prose(400 + k, 8)}", None, "a") for k in range(40)] + [(200, prose(7, 1500), None, "a"), (201, prose(7, 1500)[500:9000], None, "a"), (None, passage, None, None)]
    found = substring_dedup.substring_dedup(frame(spark, rows), chunk=700, most=5).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=KEY) == sorted(brute.cut(both(rows)), key=KEY)


@pytest.mark.parametrize("most", [2048, 3])
def test_maximal_repeats_with_all_occurrences(spark, odd, most):
    passage = prose(2, 400)
    rows = [r for r in odd if r[0] not in (None, 15, 16)] + [(30 + k, f"{prose(600 + k, 9)} {passage[: 900 + 700 * (k % 3)]} {prose(700 + k, 9)}", None, "a") for k in range(9)] + [(50, "ab" * 90, None, "a"), (51, "ba" * 70 + "c", None, "a")]
    found = defaultdict(list)
    for r in substring_dedup.repeat_groups(frame(spark, rows), most=most).collect():
        found[(r.digest, r.length, r.n)].append((r.doc_id, r.start))
    texts = {}
    for d, t in sorted(both(rows)):
        if (t or "").encode() not in texts.values():
            texts[d] = (t or "").encode()
    got = set()
    for (digest, length, n), places in found.items():
        d, at = places[0]
        string = texts[d][at : at + length]
        assert hashlib.sha256(string).hexdigest() == digest and n == len(places)
        everywhere = [(d, k) for d, t in texts.items() for k in range(len(t) - length + 1) if t.startswith(string, k)]
        assert sorted(places) == everywhere and len({d for d, _ in places}) > 1
        got.add((string, tuple(sorted(places))))
    by_documents = defaultdict(list)
    for string, places in got:
        by_documents[tuple(d for d, _ in places)].append((string, [a for _, a in places]))
    wanted = brute.repeats(both(rows))
    for string, places in wanted:
        starts = [a for _, a in places]
        holding = [s for s, own in by_documents[tuple(d for d, _ in places)] if len({a - b for a, b in zip(starts, own, strict=True)}) == 1 and own[0] <= starts[0] and own[0] + len(s) >= starts[0] + len(string)]
        assert len(holding) >= 1
    assert any(len(s) > 600 for s, _ in wanted) and len(got) < 3 * len(wanted)


def test_very_long_runs_are_cut(spark, odd):
    rows = [(1, "x" * 200_000, None, None), (2, "y" + "x" * 120_000 + "y", None, None)]
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert found == {1: (0, 0), 2: (120_000, 1)}


def test_media_hold_the_text(spark, odd):
    found = wav_fingerprint.encode(frame(spark, odd)).collect()
    texts = Counter((d, (t or "").encode()) for d, t in both(odd))
    back = Counter()
    for r in found:
        with wave.open(BytesIO(bytes(r.media))) as w:
            load = w.readframes(w.getnframes())
        assert len(load) % 64 == 0 and len(load) >= 64 and not load[r.n_bytes :].strip(b"\0")
        back[(r.doc_id, load[: r.n_bytes])] += 1
    assert back == texts
    features = wav_fingerprint.features(wav_fingerprint.encode(frame(spark, odd))).collect()
    assert all(len(r.times) == len(r.hashes) and r.times == sorted(r.times) for r in features)
    same = {r.doc_id: (r.times, r.hashes) for r in features if r.doc_id in (1, 2)}
    assert same[1] == same[2] and same[1][0]


def test_fingerprint_as_by_plain_transforms():
    """Frames by the definition of the transform, peaks and pairs by loops."""
    sound = (128 + 50 * np.sin(np.arange(1500) ** 1.4 / 20) + 30 * np.sin(np.arange(1500) / 3)).astype(np.uint8).tobytes()
    w, n = wav_fingerprint, len(sound)
    frames = max(1, -(-max(0, n - w.FRAME) // w.HOP) + 1)
    window = np.hanning(w.FRAME).astype(np.float32)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(w.FRAME // 2 + 1), np.arange(w.FRAME)) / w.FRAME)
    peaks = []
    for f in range(frames):
        x = np.zeros(w.FRAME)
        part = np.frombuffer(sound, np.uint8)[f * w.HOP : f * w.HOP + w.FRAME].astype(float) - 128
        x[: len(part)] = part
        m = np.abs(turn @ (x * window))
        peaks.append([a + int(m[a:b].argmax()) if m[a:b].max() > w.FLOOR * m[a:b].mean() + 1 else -1 for a, b in w.BANDS])
    wanted = sorted((f, p << 12 | q << 4 | d) for f in range(frames) for d in range(1, w.AHEAD + 1) if f + d < frames for p in peaks[f] for q in peaks[f + d] if p >= 0 and q >= 0)
    times, hashes = w.fingerprint(sound)
    assert sorted(zip(times.tolist(), hashes.tolist(), strict=True)) == wanted and len(wanted) > 20


def test_fingerprints_shift_with_the_sound():
    sound = (128 + 60 * np.sin(np.arange(6000) ** 1.5 / 40)).astype(np.uint8).tobytes()
    t0, h0 = wav_fingerprint.fingerprint(sound)
    t1, h1 = wav_fingerprint.fingerprint(b"\x80" * wav_fingerprint.HOP * 5 + sound)
    assert set(zip(t0[t0 > 3] + 5, h0[t0 > 3], strict=True)) <= set(zip(t1, h1, strict=True)) and len(t0) > 20


def test_long_sounds_are_read_in_blocks(monkeypatch):
    sound = np.random.default_rng(0).integers(0, 256, 30_000).astype(np.uint8).tobytes()
    whole = wav_fingerprint.fingerprint(sound)
    monkeypatch.setattr(wav_fingerprint, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, wav_fingerprint.fingerprint(sound), strict=True))


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.default_tokenizer())
    found = packing.pack(packing.pieces(frame(spark, odd), packing.default_tokenizer())).collect()
    wanted = Counter()
    for d, t in both(odd):
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s : s + 2048], "<u4")
            wanted[(d, k, s, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    gapless(found)


def gapless(found, length=2048):
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


def test_groups_are_packed_again(spark):
    draw = np.random.default_rng(1)
    rows = [(k, 0, 0, int(n), 0) for k, n in enumerate(draw.integers(1, 1200, 900))]
    found = packing.pack(spark.createDataFrame(rows, packing.PIECES), group=50, fan_in=4).collect()
    assert len(found) == len(rows) and gapless(found) <= 1.03 * sum(r[3] for r in rows) / 2048 + 1


def test_sum_of_squares_takes_the_best_place():
    draw = np.random.default_rng(2)
    sizes, length = draw.integers(1, 20, 300), 20
    placed, offset = packing.sum_of_squares(sizes, length)
    gaps: dict[int, int] = {}
    for size, seq, at in zip(sizes.tolist(), placed.tolist(), offset.tolist(), strict=True):
        def total(change):
            n = Counter(g for g in (gaps | change).values() if g)
            return sum(v * v for v in n.values())
        fresh = max(gaps, default=-1) + 1
        best = min([total({fresh: length - size}), *(total({s: g - size}) for s, g in gaps.items() if g >= size)])
        assert total({seq: gaps.get(seq, length) - size}) == best and at == length - gaps.get(seq, length)
        gaps[seq] = gaps.get(seq, length) - size


def test_mix(spark, odd):
    docs = frame(spark, odd * 3 + [(1000 + k, prose(k, 40), "en", f"s{k % 7}") for k in range(400)])
    found = mixing.mix(docs).collect()
    assert Counter(map(tuple, found)) == Counter(map(tuple, mixing.mix(docs.repartition(3)).collect()))
    sizes, taken, target = Counter(), Counter(), {}
    for r in found:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    wanted = brute.targets(sizes)
    assert target == pytest.approx(wanted)
    largest = defaultdict(int)
    for r in found:
        largest[r.source] = max(largest[r.source], r.size * 3)
    assert all(abs(taken[s] - wanted[s]) <= largest[s] for s in wanted)
    size = {r.doc_id: r.size for r in found if r.doc_id}
    assert size[17] == len(re.findall(rb"[^\x20\x09-\x0D]+", odd[18][1].encode()))


def test_mix_stage_takes_rows_by_their_own_source(spark, sf_dir):
    rows = [(None if k % 7 == 0 else k, prose(100 * k + ord(s), 40), "en", s) for k in range(50) for s in "abc"] + [(1, "", "en", "a"), (1, None, "en", None)]
    docs = frame(spark, rows)
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[(r.doc_id, r.source, r.size)] += r.copies if r.size else 1
    assert len({copies[(k, s, 40)] for k in range(1, 7) for s in "abc"}) > 1
    found = mixing.stage(spark, docs, sf_dir).collect()
    assert Counter((r.doc_id, r.source, len((r.text or "").split())) for r in found) == +copies and {(r.doc_id, r.text, r.lang, r.source) for r in found} <= set(rows)


@pytest.mark.parametrize("ids", [lambda k: None, lambda k: None if k % 3 == 0 else k, lambda k: 5, lambda k: k])
@pytest.mark.parametrize("same", [False, True])
def test_mix_comes_within_a_document_of_its_targets(spark, sf_dir, ids, same):
    rows = [(ids(k), prose(0 if same else k, 25), "en", "a") for k in range(400)] + [(ids(k), prose(0 if same else k, 10), "en", "b") for k in range(1000)] + [(None, None, "en", None)] * 5
    docs = frame(spark, rows)
    found = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in found:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= {"a": 25, "b": 10, None: 0}[s] for s in target) and target["b"] == pytest.approx(2 * target["a"])
    assert Counter(map(tuple, found)) == Counter(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    put = [Counter((r.doc_id, r.text, r.source) for r in mixing.stage(spark, df, sf_dir).collect()) for df in (docs, docs.repartition(7))]
    words = Counter()
    for (_, text, source), n in put[0].items():
        words[source] += n * len((text or "").split())
    assert put[0] == put[1] and words == +taken and put[0][(None, None, None)] == 5


def test_language(spark, odd):
    net_docs = frame(spark, [(k, ("the of and to in " if k % 2 else "der die und das ein ") * 9, "en" if k % 2 else "de", "a") for k in range(60)] + odd)
    *learned, names = language_id.sample(net_docs)
    net = language_id.train(*learned, names)
    found = language_id.identify(net_docs, net).collect()
    assert len(found) == 60 + len(odd)
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (6, 7, 8) and r.probabilities == [0.0] * len(names))
    right = [r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in found if r.doc_id is not None and r.doc_id >= 20]
    assert np.mean(right) > 0.9


def test_short_texts_are_learned_from(spark):
    docs = frame(spark, [(k, "the of and" if k % 2 else "der und die", "en" if k % 2 else "de", "a") for k in range(200)])
    *learned, names = language_id.sample(docs)
    found = language_id.identify(docs, language_id.train(*learned, names)).collect()
    assert np.mean([r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in found]) > 0.99


def test_windows_hold_the_text_and_its_surroundings():
    text = bytes(range(1, 101))
    windows, low, high = language_id.cut(text)
    inner = slice(language_id.MARGIN, language_id.MARGIN + language_id.WINDOW)
    assert b"".join(w.tobytes() for w in windows[:, inner]).rstrip(b"\0") == text
    assert [w[a:b].tobytes() for w, a, b in zip(windows, low, high, strict=True)] == [text[max(0, 32 * k - 8) : 32 * k + 40] for k in range(4)]
    assert [len(x) for x in language_id.cut(b"")] == [0, 0, 0]


def plain_states(net, text, low, high):
    """The states of both directions at each position of a span, one position at a time."""
    out = []
    for d, steps in ((0, range(low, language_id.MARGIN + language_id.WINDOW)), (1, range(high - 1, language_id.MARGIN - 1, -1))):
        s, kept = np.zeros((language_id.HIDDEN, 1)), {}
        for t in steps:
            s = kept[t] = language_id._step(net.x[d][:, [text[t]]].astype(float), net.u[d].astype(float), s)[3]
        out.append(kept)
    return out


@pytest.mark.parametrize(("low", "high"), [(0, 48), (8, 20), (0, 41)])
def test_gradients_of_the_language_network(low, high):
    draw = np.random.default_rng(0)
    net = language_id.fresh(["a", "b", "c"])
    byte, target = draw.integers(0, 256, language_id.SPAN), 1
    places = range(language_id.MARGIN, min(high, language_id.MARGIN + language_id.WINDOW))

    def probabilities():
        states = plain_states(net, byte, low, high)
        return [language_id.softmax(net.out.astype(float) @ np.concatenate([states[0][t], states[1][t]]) + net.bias[:, None])[:, 0] for t in places]

    total = language_id.window_sums(net, byte[None].astype(np.uint8), np.array([low]), np.array([high]))[0]
    assert total == pytest.approx(np.sum(probabilities(), axis=0), rel=1e-3)
    loss = lambda: -np.mean([np.log(p[target]) for p in probabilities()])
    for a, g in zip(net.arrays(), language_id._gradients(net, byte[:, None], np.array([low]), np.array([high]), np.array([target]), np.ones(1, np.float32)), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, e = a[at], 1e-2
        a[at] = old + e
        more = loss()
        a[at] = old - e
        less = loss()
        a[at] = old
        assert (more - less) / (2 * e) == pytest.approx(float(g[at]), rel=0.02)


def test_context_sums_as_by_hand():
    places, signs = quality.index_vectors()
    total = np.zeros((quality.BUCKETS + 1, quality.DIMENSIONS), np.int64)
    texts = [b"one two three one", b"", b"two"]
    quality.context_sums(texts, total, places, signs)
    wanted = np.zeros_like(total)
    for text in texts:
        rows = quality.buckets_of([text])[0]
        for i, a in enumerate(rows):
            for j, b in enumerate(rows):
                if 0 < abs(i - j) <= quality.WINDOW:
                    np.add.at(wanted[a], places[b], signs[b].astype(int))
    assert (total[:-1] == wanted[:-1]).all()  # the last row is of no word


def test_pooling_as_by_words():
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS + 1, quality.DIMENSIONS)).astype(np.float32)
    texts = [b"one two two three", b"", b"x " * 5000]
    for text, found in zip(texts, quality.pooled(texts, vectors), strict=True):
        own = quality.buckets_of([text])[0]
        if not len(own):
            assert not found.any()
            continue
        x = vectors[own].astype(float)
        assert found == pytest.approx([*x.mean(axis=0), *x.std(axis=0), np.log1p(len(own)), len(set(own)) / len(own)], abs=1e-3)


def test_sums_of_many_tasks_are_added_in_a_tree(spark, monkeypatch):
    docs = frame(spark, [(k, prose(k, 30), "en", "a") for k in range(40)])
    whole = quality.word_vectors(docs.coalesce(1))
    monkeypatch.setattr(quality, "FAN_IN", 3)
    assert (quality.word_vectors(docs.repartition(20)) == whole).all()


def test_temperature_makes_sure_scores_milder():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(900, 4))
    y = (x[:, 0] + draw.normal(size=900) > 0).astype(int)
    net = quality.fit(x, y, np.arange(900) % 3 == 0)
    assert abs(net.scores(x).mean() - y.mean()) < 0.08 and ((net.scores(x) > 0.5) == y).mean() > 0.7


def test_chain_learns_from_held_out_probabilities():
    draw = np.random.default_rng(5)
    texts, toxic = [], []
    for k in range(600):
        bad = k % 5 == 0
        texts.append((prose(k, 40) + (" you idiot worthless" if bad and k % 2 else " du schurke" if bad else " you friend")).encode())
        toxic.append(int(bad))
    chain = toxicity.fit_chain(texts, draw.integers(0, 4, 600), np.array(toxic), 2)
    p = chain.probabilities(*toxicity.words_of(texts))
    assert ((p[:, -1] >= 0.5) == np.array(toxic)).mean() > 0.99
    assert chain.names == ("kind_1", "kind_2", "toxic") and chain.earlier[0].max() == 0 and chain.earlier[2, :2].any()
    # the two kinds are the two ways to abuse
    kinds = toxicity.kinds_of(*toxicity.words_of(texts), np.array(toxic) > 0, 2)
    first = {bool(k % 2) for k in np.flatnonzero(kinds[0])}
    assert kinds.sum() == 120 and len(first) == 1 and len({bool(k % 2) for k in np.flatnonzero(kinds[1])} | first) == 2


def test_toxicity_on_documents_it_has_not_seen(spark):
    found = toxicity.held_out(*(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")))
    assert found["rejected"] <= 0.012 * found["clean"] and found["missed"] <= 0.1 * found["toxic"]


def test_classifiers_without_labels(spark, odd):
    docs = frame(spark, odd, True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.train(docs, none) is None
    assert all(r["scores_"] == [0.0] * 4 for r in toxicity.scored(docs, None, "scores_").collect())
    vectors = quality.word_vectors(docs)
    assert quality.train(docs, none, vectors) is None
    assert {r.score for r in quality.score(docs, None, vectors).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.train(docs, one, vectors), vectors).count() == len(odd)
    assert toxicity.scored(docs, toxicity.train(docs, one), "scores_").count() == len(odd)


def test_bound_counts_labels_of_documents(spark, monkeypatch):
    docs = frame(spark, [(k, prose(k, 5), "en", "a") for k in range(40)])
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "cast(id % 2 as int) as toxic")
    monkeypatch.setattr(toxicity, "fit_chain", lambda texts, fold, toxic, kinds: len(texts))
    assert toxicity.train(docs, labels, 20) == 20
    monkeypatch.setattr(quality, "SAMPLE", 10)
    monkeypatch.setattr(quality, "fit", lambda x, y, calibrate: len(x))
    assert quality.train(docs, labels, np.zeros((quality.BUCKETS + 1, quality.DIMENSIONS), np.float32)) == 10


PAGES = "page_id long, url string, html string"


def test_stores_of_one_shuffle(spark):
    """A store and its replica are what two stores of their own would hold, record by record and offset by offset."""
    pages = spark.createDataFrame([(k, f"http://x/{k}", "é<p>" * (k % 7)) for k in range(700)] + [(None, "u", None)], PAGES)
    for store, own in zip(warc_audit.stored_twice(pages, *warc_audit.damage(), 2, 900), (pages, warc_audit.damaged(pages)), strict=True):
        columns = ["shard", "offset", "length", "page_id", "url", "hash", "readable"]
        assert sorted(map(str, warc_audit.records(store).select(columns).collect())) == sorted(map(str, warc_audit.records(warc_audit.stored(own, 2, 900)).select(columns).collect()))


def audited(primary, replica, bits):
    return warc_audit.audit(*(shared.scratch(warc_audit.stored(p, bits, 700), "warc") for p in (primary, replica)), bits)


def test_archives(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k}", "<p>é" * (k % 7)) for k in range(60)] + [(7, None, None), (None, "u\r\nv", "h")], PAGES)
    store = warc_audit.stored(pages, 2, 700).orderBy("shard", "offset").collect()
    assert len({r.shard for r in store}) == 4 and len(store) > 8
    wanted = Counter(bytes(r[0]) for r in pages.select(warc_audit.record(F.col("page_id"), F.col("url"), F.col("html"))).collect())
    read = Counter()
    for shard in range(4):
        own = [r for r in store if r.shard == shard]
        assert [r.offset for r in own] == [sum(len(x.data) for x in own[:k]) for k in range(len(own))]
        read.update(bytes(r.data)[at : at + n] for r in own for at, n, header, _ in warc_audit.parse(bytes(r.data)) if header)
    assert read == wanted
    assert audited(pages, pages, 2).count() == 0


def test_damaged_bytes_are_passed_over(spark):
    one = spark.createDataFrame([(k, f"http://x/{k}", f"<p>{k}") for k in range(6)], PAGES)
    data = b"".join(bytes(r[0]) for r in one.select(warc_audit.record(F.col("page_id"), F.col("url"), F.col("html"))).collect())
    starts = [at for at, *_ in warc_audit.parse(data)]
    assert len(starts) == 6
    torn = data[: starts[2]] + b"xxxx" + data[starts[2] + 4 :]
    assert [(at, header is None) for at, _, header, _ in warc_audit.parse(torn)] == [(at, k == 2) for k, at in enumerate(starts)]
    long = data.replace(b"Content-Length: 4", b"Content-Length: 9", 1)
    assert [header is None for _, _, header, _ in warc_audit.parse(long)] == [True] + [False] * 5
    assert [header is None for _, _, header, _ in warc_audit.parse(data[:-1])] == [False] * 5 + [True]
    assert list(warc_audit.parse(b"")) == [] and [h for _, _, h, _ in warc_audit.parse(b"junk")] == [None]
    stores = [spark.createDataFrame([(0, 0, 0, bytearray(x))], warc_audit.STORE) for x in (data, torn)]
    found = warc_audit.audit(*stores, 0).collect()
    assert sorted((r.page_id is None, r.low, r.high, r.status) for r in found) == [(False, starts[2], starts[3], "missing"), (True, starts[2], starts[3], "unreadable")]


@pytest.mark.parametrize("bits", [0, 3])
def test_one_lost_record_is_one_finding(spark, bits):
    pages = spark.createDataFrame([(k, f"http://x/{k}", "<p>" * (k % 7)) for k in range(60)], PAGES)
    found = audited(pages, pages.where("page_id <> 5"), bits).collect()
    assert [(r.page_id, r.status) for r in found] == [(5, "missing")]


@pytest.mark.parametrize("bits", [0, 4])
def test_lost_and_inserted_records_are_told_from_moved_ones(spark, bits):
    rows = [(k, f"http://x/{k}", "<p>" * (k % 7)) for k in range(60)] + [(7, "again", "h"), (8, "http://x/8", "<p>"), (None, "u", "h"), (None, "v", "h")]
    lost = [r for r in rows if r[0] not in (3, 20) and r[1] not in ("again", "v")]
    bad = [(k, u, "<q>" if k == 41 else h) for k, u, h in lost] + [(25, "http://x/25", "new"), (100, "n", "n"), (12, *rows[12][1:])]
    found = audited(spark.createDataFrame(rows, PAGES), spark.createDataFrame(bad, PAGES), bits).collect()
    wanted = [(3, "missing"), (20, "missing"), (7, "missing"), (None, "missing"), (41, "changed"), (25, "extra"), (100, "extra"), (12, "extra")]
    assert sorted(((r.page_id, r.status) for r in found), key=str) == sorted(wanted, key=str)
    assert all(r.low < r.high for r in found)


def test_empty_tables(spark):
    docs = frame(spark, [])
    pages = spark.createDataFrame([], PAGES)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = quality.word_vectors(docs)
    for df in (
        near_dup.near_dup(docs), exact_dedup.exact_dedup(docs), substring_dedup.substring_dedup(docs), wav_fingerprint.features(wav_fingerprint.encode(docs)), packing.pack(packing.pieces(docs, packing.default_tokenizer())),
        mixing.mix(docs), language_id.identify(docs, None), quality.score(docs, None, vectors), toxicity.scored(docs, toxicity.train(docs, none), "scores"), audited(pages, pages, warc_audit.shard_bits(pages)),
    ):
        assert df.count() == 0
    assert language_id.sample(docs) is None


def test_shared_folder_is_asked_for(spark):
    assert shared.shared_dir(spark)
