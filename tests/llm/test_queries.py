"""The registered queries of the corpus operators as they are: columns, types, and the rules of their results."""

import hashlib
import shutil
import wave
import zlib
from collections import defaultdict
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from folioflow.llm import queries
from tests.compare import oracle, spark_rows
from tests.llm import brute

TYPES = {
    "op1_ngram_jaccard_join": "doc_id bigint, rep_id bigint, class_size bigint, class_id bigint, n_links bigint",
    "op2_warc_merkle_audit": "shard int, page_id bigint, low bigint, high bigint, record_bytes bigint, status string",
    "op3_wav_fingerprint": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, times array<int>, hashes array<int>",
    "op4_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op5_byte_gru_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_random_indexing_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_sum_of_squares_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op8_toxicity_chain": "doc_id bigint, p_kind_1 double, p_kind_2 double, p_kind_3 double, p_toxic double, predicted int",
    "op9_source_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op10_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op11_elias_fano_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op12_tokenizer_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint",
    "op13_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
}
NOT_DOCUMENTS = ("op2_warc_merkle_audit", "op13_source_divergence")
_FOUND = {}


@pytest.fixture
def run(spark, sf_dir):
    def get(name):
        if name not in _FOUND:
            df = queries.QUERIES[name](spark, sf_dir)
            _FOUND[name] = [f"{n} {t}" for n, t in df.dtypes], df.collect()
        return _FOUND[name]

    return get


@pytest.fixture
def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", list(TYPES))
def test_columns_and_rows(run, docs, name):
    types, rows = run(name)
    assert types == TYPES[name].split(", ")
    if name not in NOT_DOCUMENTS:
        assert {r.doc_id for r in rows} == set(docs)
    if name not in (*NOT_DOCUMENTS, "op7_sum_of_squares_packing"):
        assert len(rows) == len(docs)


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def test_near_copies(run, docs):
    """On all documents, those whose id is divisible by 20 among them, the recall is 1."""
    found = {r.doc_id: (r.class_id, r.n_links) for r in run("op1_ngram_jaccard_join")[1]}
    assert found == brute.near([(d, r.text) for d, r in docs.items()]) and any(d % 20 == 0 for d in found)


def test_media(run, docs):
    for r in run("op3_wav_fingerprint")[1]:
        text = (docs[r.doc_id].text or "").encode()
        load = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
        out = BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, 8000, 0, "NONE", ""))
            w.writeframes(load)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(load), hashlib.sha256(load).hexdigest(), zlib.crc32(load[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        arrays = ";".join(",".join(map(str, x)) for x in (r.times, r.hashes))
        assert r.feature == f"{len(r.hashes)}:{hashlib.sha256(arrays.encode()).hexdigest()}" and len(r.times) == len(r.hashes)


def test_repeats(run, docs):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, run("op4_suffix_array_dedup")[1]), key=key) == sorted(brute.cut([(d, r.text) for d, r in docs.items()]), key=key)


def test_languages(run, docs):
    rows = run("op5_byte_gru_language")[1]
    known = {r.lang for r in docs.values()}
    for r in rows:
        letters = any(map(str.isalpha, docs[r.doc_id].text or ""))
        assert r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 and (r.lang_pred in known if letters else (r.lang_pred, r.score) == ("und", 0))
    seen = [r.lang_pred == docs[r.doc_id].lang for r in rows if r.held_out and docs[r.doc_id].lang]
    assert len(seen) > 20 and sum(seen) > 0.9 * len(seen)


def test_quality(spark, sf_dir, run):
    rows = {r.doc_id: r for r in run("op6_random_indexing_quality")[1]}
    for r in rows.values():
        assert r.held_out == (crc(r.doc_id) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    marks = [(rows[x.doc_id], x.quality) for x in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if x.doc_id in rows and x.quality is not None]
    held = [r.predicted == q for r, q in marks if r.held_out]
    assert len(held) > 10 and sum(held) > 0.85 * len(held)


def test_held_out_labels_are_never_learned(spark, sf_dir, tmp_path, run):
    """With other labels and languages on what is held out, and other sources everywhere, nothing changes."""
    for name in ("documents", "labels"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        for n, left in ((4, 2),) if name == "documents" else ((5, 0),):
            out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == left
            df = df.withColumns({"lang": F.when(out, "xx").otherwise(F.col("lang")), "source": F.lit("q")}) if name == "documents" else df.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name in ("op5_byte_gru_language", "op6_random_indexing_quality"):
        again = {r.doc_id: tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert again == {r.doc_id: tuple(r) for r in run(name)[1]}
    shutil.rmtree(tmp_path)


def test_toxicity(spark, sf_dir, run):
    rows = {r.doc_id: r for r in run("op8_toxicity_chain")[1]}
    assert all(r.predicted == (r.p_toxic >= 0.5) for r in rows.values())
    marks = [(rows[x.doc_id].predicted, x.toxic) for x in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if x.doc_id in rows]
    assert sum(p == t for p, t in marks) > 0.95 * len(marks)


def test_packing(run):
    places = defaultdict(list)
    for r in run("op7_sum_of_squares_packing")[1]:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(places) <= 1.02 * sum(n for p in places.values() for _, n in p) / 2048 + 1


def test_mix(run, docs):
    sizes, taken = defaultdict(int), defaultdict(int)
    rows = run("op9_source_mix")[1]
    for r in rows:
        sizes[docs[r.doc_id].source] += r.size
        taken[docs[r.doc_id].source] += r.taken
    wanted = brute.targets(sizes)
    for r in rows:
        s = docs[r.doc_id].source
        assert r.source_size == sizes[s] and r.target == pytest.approx(wanted[s]) and r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    assert all(abs(taken[s] - wanted[s]) <= max(3 * r.size for r in rows) for s in wanted)


def test_language_model(run, docs):
    wanted = brute.language_model([(d, r.text) for d, r in docs.items()], 2, 32.0, 0.05)
    for r in run("op11_elias_fano_lm")[1]:
        held, n, known, tokens, base, score = wanted[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, tokens)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score == pytest.approx(score, abs=0.2)
    held = [r for r in run("op11_elias_fano_lm")[1] if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_alignment(run, docs):
    wanted = brute.alignment([(d, r.text) for d, r in docs.items()])
    assert {r.doc_id: tuple(r)[1:] for r in run("op12_tokenizer_alignment")[1]} == wanted


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql_of_the_package(spark, sf_dir, name):
    assert spark_rows(queries.QUERIES[name](spark, sf_dir)) == oracle(queries.ORACLE_SQL[name], sf_dir)
