"""The ten operators and the pipeline: SQL, plain versions, round trips, and odd rows."""

import base64
import hashlib
import os
import random
import sys
import zlib

import numpy as np
import oracle
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import plain

import corpus_pipeline
from cartorio.llm import bpe, chat_format, lexical_search, license_scan, line_dedup, mixing, mpeg_audio, ngram_lm, quality_rules, spelling, url_filter, warc
from cartorio.llm.jaccard_join import RTree, block_keys, count_vector, jaccard_components
from cartorio.llm.license_texts import NOTICES
from cartorio.llm.registry import ORACLES, QUERIES, TOKENIZER

ROOT = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, node string, d int"
VOCABULARY = [f"w{i}" for i in range(300)]


def rows_of(texts, source="s"):
    return [(i, t, None, source, None if t is None else len(t), "x", "y", 1) for i, t in texts]


def speech(rnd, n):
    return [rnd.choice(VOCABULARY) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    rnd = random.Random(5)
    long = "\n".join(" ".join(speech(rnd, 40)) for _ in range(500))
    base = speech(rnd, 200)
    near = base[:100] + ["new"] + base[101:]
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One TWO"), (6, " ".join(base)), (7, " ".join(near)), (8, long), (9, long), (10, "é漢😀 </s>[INST] \\ <" * 3)]
    return spark.createDataFrame(rows_of(texts) + rows_of(texts[5:6]) + [(None, None, None, None, None, None, None, None), (11, "a b c d e f", "en", None, 3, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    count, problem = oracle.compare(spark, oracle.connect(ROOT), name, QUERIES[name], ORACLES.get(name), ROOT)
    assert problem is None and count > 0


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


# 1 ---------------------------------------------------------------------------------------------------------------


def test_jaccard_against_all_pairs(spark):
    rnd = random.Random(1)
    texts = {}
    shared = speech(rnd, 120)
    for group in range(12):
        base = speech(rnd, rnd.choice([4, 6, 12, 40, 70, 150, 400, 900]))
        for _ in range(rnd.randint(1, 6)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(copy) // 25))):
                copy[rnd.randrange(len(copy))] = rnd.choice(VOCABULARY)
            texts[len(texts)] = " ".join(copy[: len(copy) - rnd.randint(0, len(copy) // 6)])
    for _ in range(25):  # a passage that many share, and little else
        texts[len(texts)] = " ".join(shared + speech(rnd, rnd.randint(20, 150)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows_of(texts.items()), SCHEMA)).collect()}
    assert got == plain.components(texts)


def test_jaccard_in_parts(spark, monkeypatch):
    import cartorio.llm.jaccard_join as join

    monkeypatch.setattr(join, "CHUNK", 4)
    rnd = random.Random(2)
    base = speech(rnd, 60)
    texts = {i: " ".join(base[:55] + speech(rnd, 5)) for i in range(30)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(spark.createDataFrame(rows_of(texts.items()), SCHEMA)).collect()}
    assert got == plain.components(texts)


def test_blocks_of_one_held_in_parts(monkeypatch):
    import pyarrow as pa

    import cartorio.llm.jaccard_join as join

    monkeypatch.setattr(join, "CHUNK", 5)
    rows = [(1, 7)] + [(2, n) for n in range(40)] + [(3, 1), (3, 1), (4, 2), (4, 9)]
    batches = [pa.RecordBatch.from_pylist([{"block": a, "node": b} for a, b in rows[i : i + 6]]) for i in range(0, len(rows), 6)]
    out = [r for b in join._blocks(iter(batches)) for r in b.to_pylist()]
    big = [r for r in out if r["block"] == 2]
    assert sorted(r["node"] for r in big) == list(range(40)) and len({r["part"] for r in big}) > 3
    assert sorted(r["node"] for r in out if r["block"] not in (2,)) == [2, 9]


def test_tree_reaches_every_linked_pair():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 2**63, 100).astype(np.uint64)) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[:90], rnd.integers(0, 2**63, 8).astype(np.uint64)])) for s in sets[:80]]
    width = min(len(count_vector(s)) for s in sets)
    counts = np.stack([count_vector(s).reshape(width, -1).sum(axis=1, dtype=np.uint16) for s in sets])
    tree = RTree(counts, counts.sum(axis=1, dtype=np.int64))
    found = {tuple(sorted(p)) for a, b, _ in tree.join(tree) for p in zip(a.tolist(), b.tolist())}
    linked = {(i, i + 150) for i in range(80) if 175 * len(np.intersect1d(sets[i], sets[i + 150])) >= 75 * (len(sets[i]) + len(sets[i + 150]))}
    assert linked and linked <= found and len(found) < 150 * 149 / 2


def test_linked_sets_share_keys():
    rnd = np.random.default_rng(4)
    for n in (5, 30, 64, 127, 128, 300, 900, 3000, 12000):
        for _ in range(20):
            full = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
            part = np.sort(rnd.choice(full, int(np.ceil(0.75 * len(full))), replace=False))
            assert len(np.intersect1d(block_keys(full), block_keys(part)))


def test_jaccard_odd(odd, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(odd).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (7, 196, 6), (9, 19996, 8), (11, 2, 11)} <= got
    assert jaccard_components(odd).count() == odd.count() and jaccard_components(empty).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_tiktoken(spark, tik):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    encoded = bpe.decode_ids(bpe.encode_texts(docs, TOKENIZER, public_tokenizers.PATTERN, keep=("doc_id", "text")), TOKENIZER, public_tokenizers.PATTERN)
    for r in encoded.collect():
        assert np.frombuffer(r.ids, np.uint32).tolist() == tik.encode_ordinary(r.text) and bytes(r.decoded) == r.text.encode()


def test_bpe_edits(spark, tik):
    rnd = random.Random(7)
    letters = " abcdest'relvmno  \n\t.!?123éñ漢😀AB"
    rows = []
    for i in range(300):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 50)))
        start = rnd.randint(0, len(text))
        rows.append((i, text, tik.encode_ordinary(text), start, rnd.randint(start, len(text)), "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 4)))))
    packed = [(i, t, np.array(ids, np.uint32).tobytes(), a, b, n) for i, t, ids, a, b, n in rows] + [(999, None, None, None, None, "the end")]
    df = spark.createDataFrame(packed, "doc_id long, text string, ids binary, start int, stop int, new string")
    got = {r.doc_id: r for r in bpe.edit_texts(df, TOKENIZER, public_tokenizers.PATTERN).collect()}
    for i, t, _, a, b, n in rows:
        assert got[i].text == t[:a] + n + t[b:]
        assert np.frombuffer(got[i].ids, np.uint32).tolist() == tik.encode_ordinary(got[i].text)
    assert np.frombuffer(got[999].ids, np.uint32).tolist() == tik.encode_ordinary("the end")


def test_prefix_table(tik):
    rnd = random.Random(8)
    own = bpe.vocabulary(TOKENIZER)
    for _ in range(100):
        data = bytes(rnd.choice(b"abcdestion") for _ in range(rnd.randint(2, 200)))
        table = bpe.PrefixTable(own).append(data[:1]).append(data[1:])
        assert table.tokens() == tik._encode_single_piece(data)
        start = rnd.randint(0, len(data) - 1)
        table.edit(start, start + 1, b"the")
        assert table.tokens() == tik._encode_single_piece(data[:start] + b"the" + data[start + 1 :])


def test_bpe_pieces_not_kept_enter_few_prefixes():
    own, rng = bpe.Vocabulary(TOKENIZER), random.Random(11)
    pieces = [bytes(rng.choice(b"abcdefgh e") for _ in range(rng.randint(1, 60))) for _ in range(300)] + [rng.randbytes(30) for _ in range(50)] + [b"a" * 300, b" " * 200 + b"ab" * 99]
    for data in pieces:
        found = bpe.PrefixTable(own).append(data).tokens()
        assert own.encode(data) == found and own.merged(data) == found
    for left, right in zip(rng.sample(sorted(own.tokens), 5000), rng.sample(sorted(own.tokens), 5000)):
        assert own.apart(left, right) == (own.merged(own.tokens[left] + own.tokens[right]) == [left, right])
    assert own.encode(b"") == []


def test_bpe_odd(odd, empty):
    got = {r.doc_id: r for r in bpe.round_trip(odd, TOKENIZER, public_tokenizers.PATTERN).collect()}
    assert got[1].n_tokens == got[2].n_tokens == got[None].n_tokens == 0 and got[8][1:] == got[9][1:]
    for r in odd.select("doc_id", "text").collect():
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.round_trip(empty, TOKENIZER, public_tokenizers.PATTERN).count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------


def test_media_round_trip(odd, empty):
    got = {r.doc_id: r for r in mpeg_audio.features_of(mpeg_audio.media_of(odd)).collect()}
    for r in odd.select("doc_id", "text").collect():
        data = (r.text or "").encode()
        payload, f = mpeg_audio.padded(data), got[r.doc_id]
        assert len(payload) % 576 == 0 and (f.n_bytes, f.payload_bytes) == (len(data), len(payload))
        assert (f.payload_sha256, f.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert f.lost_bytes == f.crc_wrong == 0 and f.n_samples == len(payload) and len(f.frame_offsets) == len(payload) // 576
    assert mpeg_audio.features_of(mpeg_audio.media_of(empty)).count() == 0


def test_media_damage():
    payload = mpeg_audio.padded(b"abc" * 900)
    clean = mpeg_audio.carry(payload, 2700)
    at = mpeg_audio.parse(clean).offsets
    foreign = clean[: at[2]] + b"\xff\xfb\x90junk\xff\xff" + clean[at[2] :]
    stream = mpeg_audio.parse(foreign)
    assert stream.lost == 9 and mpeg_audio.payload_of(foreign, stream) == payload
    broken = bytearray(clean)
    broken[at[1] + 8] ^= 1
    stream = mpeg_audio.parse(bytes(broken))
    assert (stream.crc_wrong, stream.crc_checked, stream.table["frames"]) == (1, 5, 5)
    assert mpeg_audio.parse(clean[:-7]).lost == 641
    assert mpeg_audio.parse(b"").samples == 0 and mpeg_audio.parse(b"\xff" * 50).samples == 0
    # A plain MPEG-1 frame: 128 kbit/s, 44.1 kHz, 417 bytes, 1152 samples; twice, then an ID3v1 tag.
    frame = bytes((0xFF, 0xFB, 0x90, 0x00)) + bytes(413)
    stream = mpeg_audio.parse(frame * 2 + b"TAG" + b"a song".ljust(125, b"\0"))
    assert (stream.samples, stream.rate, stream.offsets, stream.tags, stream.crc_checked) == (2304, 44100, [0, 417], {"TIT2": "a song"}, 0)


def test_media_tag_in_payload(spark):
    """'TAG' 128 bytes before the end of a stream: in its last frame, and as an ID3v1 tag behind it."""
    texts = ["x" * (576 * n + 505) + "TAG" + "y" * rest for n in (0, 1, 3) for rest in (0, 30, 68)]
    for f in mpeg_audio.features_of(mpeg_audio.media_of(spark.createDataFrame(rows_of(enumerate(texts)), SCHEMA))).collect():
        data = texts[f.doc_id].encode()
        payload = mpeg_audio.padded(data)
        assert (f.n_bytes, f.payload_bytes, f.payload_sha256, f.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert f.lost_bytes == f.crc_wrong == 0 and f.n_frames == len(payload) // 576
    tag = b"TAG" + b"a song".ljust(125, b"\0")
    for text in (*texts, "plain " * 400):
        payload = mpeg_audio.padded(text.encode())
        clean = mpeg_audio.carry(payload, len(text))
        last = mpeg_audio.parse(clean).offsets[-1]
        # Whole; with foreign bytes before the tag; the last frame cut off whole.
        for data, want, lost in ((clean + tag, payload, 0), (clean + b"APE\xff" * 9 + tag, payload, 36), (clean[:last] + tag, payload[:-576], 0)):
            stream = mpeg_audio.parse(data)
            assert (mpeg_audio.payload_of(data, stream), stream.lost, stream.tags.get("TIT2")) == (want, lost, "a song")
        assert "TIT2" not in mpeg_audio.parse(clean).tags
    # Without a table: one frame, foreign bytes and a cut last frame before the tag; a frame with 'TAG' in it.
    frame = bytes((0xFF, 0xFB, 0x90, 0x00)) + bytes(413)
    for data, offsets, lost in ((frame, [0], 0), (frame * 2 + b"foreign", [0, 417], 7), (frame * 2 + frame[:200], [0, 417], 200), (frame * 2 + frame[:300], [0, 417], 300), (b"", [], 0)):
        stream = mpeg_audio.parse(data + tag)
        assert (stream.offsets, stream.lost, stream.tags) == (offsets, lost, {"TIT2": "a song"})
    stream = mpeg_audio.parse(frame * 2 + frame[:289] + tag)
    assert (stream.offsets, stream.lost, stream.tags) == ([0, 417, 834], 0, {})


# 4 ---------------------------------------------------------------------------------------------------------------


def test_licenses(spark, odd, empty):
    rnd = random.Random(9)
    whole = [(i, " ".join(speech(rnd, rnd.randint(0, 300))) + "\n# " + text.replace(" ", "\n// ", 3) + "\n" + " ".join(speech(rnd, 100))) for i, (_, text) in enumerate(NOTICES)]
    worn = NOTICES[5][1].split(" ")
    worn[50], worn[120] = "may", "might"
    whole += [(100, "see " + " ".join(worn)), (101, " ".join(NOTICES[5][1].split(" ")[:60])), (102, " ".join(speech(rnd, 50)))]
    docs = spark.createDataFrame(rows_of(whole), SCHEMA)
    found = {(r.doc_id, r.template) for r in license_scan.scan_licenses(docs).collect()}
    assert {(i, i) for i in range(len(NOTICES))} | {(100, 5)} <= found
    assert not {(101, 5)} & found and not [f for f in found if f[0] == 102]
    # Every window against every template, without bands.
    want = set()
    for shelf in license_scan.shelves([t for _, t in NOTICES]):
        for i, text in whole:
            import pyarrow as pa

            tokens, _ = license_scan.shingles_in_order(*license_scan.word_hashes(pa.array([text]), license_scan.LETTERS))
            for start in range(0, max(1, len(tokens)), shelf.step):
                inside = set(tokens[start : start + shelf.window].tolist())
                want |= {(i, name) for name, t in shelf.sets.items() if 100 * len(inside & set(t.tolist())) >= 75 * len(t)}
    assert found == want
    assert license_scan.scan_licenses(odd).count() == 0 and license_scan.scan_licenses(empty).count() == 0 and license_scan.scan_licenses(docs, []).count() == 0
    assert license_scan.by_document(odd, license_scan.scan_licenses(odd)).count() == odd.select("doc_id").distinct().count()


def test_short_licenses(spark):
    """Templates of one to four words in long texts, at both ends, in a row, and as whole texts."""
    rnd = random.Random(10)
    short = ["Copyleft", "MIT License", "All rights reserved.", "SPDX-License-Identifier: MIT"]
    texts = []
    for template in short:
        before, after = (" ".join(speech(rnd, n)) for n in (rnd.randint(100, 900), 300))
        texts += [f"{before}\n// {template.upper()}\n{after}", f"{template} {after}", f"{before} {template}", template, f"{template} {before} {template} {template}", " ".join(template.split(" ")[:-1]) + " " + after]
    docs = spark.createDataFrame(rows_of(enumerate(texts)), SCHEMA)
    words = [["".join(c if c.isalnum() else " " for c in t.lower()).split() for t in some] for some in (texts, short)]
    want = set()
    for i, text in enumerate(words[0]):
        for name, template in enumerate(words[1]):
            n, last = len(template), -9
            for at in range(len(text) - n + 1):
                if text[at : at + n] == template:
                    want |= {(i, name, at, n, 1, 1)} if at > last + 1 else set()
                    last = at
    found = license_scan.scan_licenses(docs, [(t, t) for t in short])
    got = [(r.doc_id, r.template, r.start, r.words, r.shared, r.of) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and {(6 * k + j, k) for k in range(4) for j in range(5)} <= {g[:2] for g in got}
    by_default = {r.doc_id: r.licenses for r in license_scan.by_document(docs, license_scan.scan_licenses(docs)).collect()}
    assert [i for i, names in by_default.items() if "All-rights-reserved" in names.split(",")] and all((names == "All-rights-reserved") == (12 <= i < 17) for i, names in by_default.items())


# 5 ---------------------------------------------------------------------------------------------------------------


def test_quality_odd(spark, odd, empty):
    judged = quality_rules.judge(odd)
    got = {r.doc_id: r for r in judged.collect()}
    assert set(odd.columns) <= set(judged.columns) and judged.filter("kept").count() == sum(r.kept for r in judged.collect())
    for i in (1, 2, 3, None):
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words, got[i].base_failed, got[i].kept) == (0, 0, 0, True, False)
    for r in odd.select("doc_id", "text").collect():
        w = plain.WORD.findall(r.text or "")
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {j for i, g in enumerate(grams) if plain.Counter(grams)[g] > 1 for j in (i, i + 1, i + 2)} if len(w) < 300 else None
        assert (got[r.doc_id].n_words, got[r.doc_id].word_chars) == (len(w), sum(map(len, w)))
        assert covered is None or got[r.doc_id].n_repeat_words == len(covered)
    assert quality_rules.judge(empty).count() == 0 and quality_rules.judge(odd, ()).filter("kept = base_failed").count() == 0


def test_quality_plan_is_native(spark, odd):
    text = quality_rules.judge(odd).filter("kept")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text


# 6 ---------------------------------------------------------------------------------------------------------------


def test_lines_against_all_runs(spark):
    rnd = random.Random(11)
    lines = [" ".join(speech(rnd, rnd.randint(1, 6))) for _ in range(12)]
    docs = [(i, "\n".join(rnd.choice([*lines, "", " "]) for _ in range(rnd.randint(0, 14)))) for i in range(40)]
    docs += [(40, "\n".join(["same line"] * 30)), (41, None), (42, "")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows_of(docs), SCHEMA), 8).collect()}
    assert got == plain.dedup(docs, 8)


def test_lines_odd(odd, empty):
    out = line_dedup.dedup_lines(odd)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert got[1].text is None and got[2].text == "" and got[3].text == " \n\t " and got[None].n_lines == 0
    assert (got[8].n_deleted, got[9].n_deleted, got[9].text) == (0, 500, "") and [tuple(r) for r in got[9].runs] == [(0, 500)]
    assert line_dedup.dedup_lines(empty).count() == 0


# 7 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("order,full", [(1, 99), (2, ngram_lm.FULL), (2, 3), (3, ngram_lm.FULL)])
def test_kneser_ney(spark, tmp_path, order, full):
    rnd = random.Random(13)
    texts = [" ".join(rnd.choice(["The", "a", "b", "c", "dog", "cat", f"z{rnd.randint(0, 50)}"]) for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    docs = spark.createDataFrame(rows_of(enumerate(texts)), SCHEMA)
    if order == 1:
        with pytest.raises(ValueError):
            ngram_lm.train(docs, str(tmp_path), 1, 3)
        return
    model = ngram_lm.train(docs.filter("doc_id % 3 <> 0"), str(tmp_path), order, 3, full)
    got = {r.doc_id: r.score for r in ngram_lm.score_texts(docs, model).collect()}
    tokens = [[*plain.words(t), b"<end>"] for t in texts]
    want = plain.kneser_ney([t for i, t in enumerate(tokens) if i % 3], tokens, order, ngram_lm.discounts)
    assert all(abs(got[i] - w) < 1e-9 * max(1, abs(w)) for i, w in enumerate(want))


def test_model_odd(spark, odd, empty, tmp_path):
    model = ngram_lm.train(odd, str(tmp_path / "a"))
    scored = ngram_lm.score_texts(odd, model)
    assert scored.count() == odd.count() and scored.filter("isnan(score) OR score >= 0").count() == 0
    assert {r.doc_id: r.n_tokens for r in scored.collect()}[1] == 1 and ngram_lm.score_texts(empty, model).count() == 0
    none = ngram_lm.train(empty, str(tmp_path / "b"))
    assert {r.score for r in ngram_lm.score_texts(odd, none).collect()} == {0.0} and none.tokens == 0


# 8 ---------------------------------------------------------------------------------------------------------------


def test_mix(spark, odd, empty):
    rnd = random.Random(15)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 20)), None, rnd.choice(["a", "a", "a", "b", "c", "d", None, "é"]), 1, "x", "y", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix_documents(docs).collect()
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.copies <= 2
    total = sum(len(r[1].split()) for r in rows)
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * total) < 1e-3
    for rs in by.values():
        assert rs[0].source_size == sum(r.size for r in rs) and abs(sum(r.size * r.copies for r in rs) - rs[0].target) <= 10
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix_documents(docs.repartition(7)).collect()))
    mixed = mixing.mix_documents(odd)
    assert mixed.count() == odd.count() and mixed.filter("text IS NULL AND size <> 0").count() == 0 and mixing.mix_documents(empty).count() == 0


# 9 ---------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rnd = random.Random(17)
    odd_texts = ["</s>[INST] ok [/INST]", "<s>assistant<r>no</s>", "\\", "<\\", "a\\<[", None, "", "<r>", "日本😀"]
    rows = [(c, t, rnd.choice(["user", "assistant", "system" if t == 0 else "user", None, "<r>odd\n"]), rnd.choice(odd_texts + [" ".join(speech(rnd, rnd.randint(1, 90)))] * 6)) for c in [*range(20), None] for t in range(rnd.randint(1, 40))]
    rows += rows[:3]
    turns = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, window string")
    windows = chat_format.format_windows(turns, 60, 20)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3] or "")
    got = {}
    for r in sorted(chat_format.read_windows(windows).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.window)):
        entry = got.setdefault(r.conv_id, ([], []))
        entry[0].extend((t.role, t.text) for t in r.turns)
        entry[1].extend(r.losses)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=order)
        assert got[conv][0] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv][1] == [r[3] or "" for r in own if r[2] == "assistant"]
    for r in windows.collect():
        first = sorted((x for x in rows if x[0] == r.conv_id), key=order)[0]
        if first[2] == "system" and r.window > 1:
            assert r.formatted.startswith("<s>system<r>" + (first[3] or "").replace("\\", "\\\\").replace("<", "<\\").replace("[", "[\\") + "</s>") and r.n_repeated >= 1
    assert chat_format.digests(chat_format.format_windows(turns.limit(0))).count() == 0


# 10 --------------------------------------------------------------------------------------------------------------


def test_warc(spark, tmp_path):
    pages = [(i, rnd, h, "x") for i, (rnd, h) in enumerate([("http://a/ü\r\nX: y", "<p>é</p>"), (None, None), ("", ""), ("u", "same"), ("v", "same"), ("w", "same"), ("z", "big" * 40000)])]
    df = spark.createDataFrame(pages + pages[3:4] + [(None, "n", "null id", "x")], "page_id long, url string, html string, name string")
    folder = str(tmp_path / "w")
    manifest = warc.write_archives(df, folder, roll_bytes=500)
    got = warc.read_archives(manifest, folder).collect()
    assert len(got) == df.count() and all(r.intact for r in got)
    kind = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert {(1, "revisit", 2), (2, "response", None), (3, "revisit", 5), (4, "revisit", 5), (5, "response", None), (6, "response", None), (None, "response", None)} <= kind
    assert manifest.count() > 1 and sum(r.records for r in manifest.collect()) == df.count()
    files = {n: open(os.path.join(folder, "data", n), "rb").read() for n in os.listdir(os.path.join(folder, "data"))}
    assert {os.path.basename(r.path): r.sha256 for r in manifest.collect()} == {n: hashlib.sha256(d).hexdigest() for n, d in files.items()}
    again = str(tmp_path / "again")
    warc.write_archives(df.repartition(3), again, roll_bytes=500)
    assert files == {n: open(os.path.join(again, "data", n), "rb").read() for n in os.listdir(os.path.join(again, "data"))}
    sizes = warc.read_archives(warc.write_archives(df, str(tmp_path / "s"), least_bytes=5), str(tmp_path / "s")).filter("record_type = 'revisit'").count()
    assert sizes == 0
    assert warc.write_archives(df.limit(0), str(tmp_path / "e")).count() == 0


# Pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_against_plain_stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    kept = [r for r in quality_rules.judge(docs).collect() if r.kept]
    texts = plain.dedup([(r.doc_id, r.text) for r in kept], 50)
    left = {r.doc_id: texts[r.doc_id] for r in kept if plain.WORD.search(texts[r.doc_id])}
    first = {i: left[i] for i, (_, c) in plain.components(left).items() if c == i}
    sources = {r.doc_id: r.source for r in kept}
    mixed = mixing.mix_documents(spark.createDataFrame([(i, t, sources[i]) for i, t in first.items()], "doc_id long, text string, source string")).collect()
    want = sorted(i for r in mixed for i in [r.doc_id] * r.copies)
    got = corpus_pipeline.run(spark, ROOT).collect()
    assert sorted(r.doc_id for r in got) == want and all(r.lossless for r in got)


def test_stages_keep_odd_rows_going(spark, odd, empty):
    for rows in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, ROOT)
            assert name == "byte_bpe" or out.columns == list(corpus_pipeline.COLUMNS)
            assert out.count() >= 0


def test_jaccard_of_shared_and_null_ids(spark):
    rnd = random.Random(12)
    a, b = speech(rnd, 80), speech(rnd, 80)
    near_a, near_b = a[:75] + speech(rnd, 5), b[:75] + speech(rnd, 5)
    c, near_c = speech(rnd, 90), None
    near_c = c[:86] + speech(rnd, 4)
    rows = [(1, a), (1, b), (2, near_a), (3, near_b), (None, c), (7, near_c), (None, speech(rnd, 30)), (1, a)]
    got = jaccard_components(spark.createDataFrame(rows_of([(i, " ".join(t)) for i, t in rows]), SCHEMA)).collect()
    assert sorted([(r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1) for r in got]) == [(-1, -1), (-1, 7), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1), (7, 7)]


def test_quality_with_clashing_names(spark):
    clashing = ["_text", "_words", "_lines", "_bits", "_windows", "_row", "_source", "n_words", "kept", "a.b"]
    docs = spark.createDataFrame([(1, "one two three one two three " * 20, *clashing), (2, None, *clashing)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in clashing))
    rows = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert rows[1].n_words == 120 and rows[1].n_repeat_words == 120 and rows[2].n_words == 0 and rows[1]._windows == "_windows" and rows[1]["a.b"] == "a.b"


def test_language_model_base_columns(spark):
    rnd = random.Random(21)
    texts = {i: " ".join(speech(rnd, rnd.randint(0, 30))) + (" Odd" if i % 7 == 0 else "") for i in range(60)}
    docs = spark.createDataFrame(rows_of(texts.items()), SCHEMA).select("doc_id", "text", ngram_lm.held_out(F.col("doc_id")).alias("held_out"))
    import tempfile

    model = ngram_lm.train(docs.filter("NOT held_out"), tempfile.mkdtemp(prefix="spark-"))
    got = {r.doc_id: r for r in ngram_lm.score_texts(docs, model, ("doc_id", "held_out")).collect()}
    out = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    counts = __import__("collections").Counter(w for i, t in texts.items() if i not in out for w in [*plain.words(t), None])
    total = sum(counts.values())
    assert model.tokens == total and {i for i, r in got.items() if r.held_out} == out
    for i, t in texts.items():
        tokens = [*plain.words(t), None]
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (len(counts) + 1))) for w in tokens)
        assert got[i].n_tokens == len(tokens) and got[i].n_known == sum(counts[w] > 0 for w in tokens) and abs(got[i].base_score - base) < 1e-6


def test_warc_digests_of_random_pages(spark):
    import tempfile

    rnd = random.Random(31)
    bodies = ["", "<p>é漢</p>", *("".join(rnd.choice("ab<>é ") for _ in range(rnd.randint(1, 400))) for _ in range(20))]
    pages = [(i, f"http://h{i % 3}.example/{i}", rnd.choice([*bodies, None])) for i in range(90)]
    folder = tempfile.mkdtemp(prefix="spark-")
    manifest = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), folder, roll_bytes=2000)
    found = warc.read_archives(manifest, folder)
    assert found.rdd.getNumPartitions() >= manifest.count() > 3
    last = {}
    for i, _, html in pages:
        last[html or ""] = i
    for r in found.collect():
        body = (pages[r.page_id][2] or "").encode()
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and r.intact
        first = last[body.decode()] == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", last[body.decode()]))
    none = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder + "/none")
    assert warc.read_archives(none, folder + "/none").count() == 0


# 11 --------------------------------------------------------------------------------------------------------------

ITEMS = "item_id long, text string, doc_id string, term int, shard string"


def hits(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.item_id, r.rank)):
        found.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(found[r.item_id])
    return found


def test_search_against_plain(spark, odd, empty, monkeypatch):
    rnd = random.Random(41)
    docs = [(i, " ".join(speech(rnd, rnd.randint(1, 60)))) for i in range(300)] + [(500 + i, "w1 w2 w3") for i in range(15)] + [(500, "w1 w2 w3")]
    odd_rows = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(1, "w1 w2 W3, w7-w8!"), (2, "\u00e9\u6f22\U0001f600 w5"), (3, None), (4, ""), (5, "unknownterm"), (6, " ".join(speech(rnd, 30)))]
    asked = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in items] + [(1, "w9", "x", 2, None)], ITEMS)
    merged = [(1, items[0][1] + " w9"), *items[1:]]
    want = {k: v for k, v in plain.ranked(docs + odd_rows, merged).items() if v}
    table = spark.createDataFrame(rows_of(docs), SCHEMA).union(odd)
    assert hits(lexical_search.search(table, asked).collect()) == want
    monkeypatch.setattr(lexical_search, "BLOCK", 2)  # several blocks of items, and several slices of them
    monkeypatch.setattr(lexical_search, "ITEMS", 3)
    assert hits(lexical_search.search(table, asked).collect()) == want
    assert lexical_search.search(empty, asked).count() == 0 and lexical_search.search(table, asked.limit(0)).count() == 0


def test_bundles_leave_nothing_behind_that_counts(monkeypatch):
    import pyarrow as pa

    rnd = np.random.default_rng(7)
    size, terms = 400, 24
    weights = np.sort(rnd.integers(1, 9000, terms))[::-1].astype(np.int64)
    tf = rnd.integers(0, 4, (terms, size)) * (rnd.random((terms, size)) < np.linspace(0.01, 0.9, terms)[:, None])
    impact = (10**9 * tf) // (1000 * tf + 800)
    full = (weights[:, None] * impact).sum(axis=0)
    owners = np.repeat(np.arange(4), terms // 4)
    bound = weights * 10**6
    bundle = pa.table({"shard": pa.array([], pa.int64()), "block": pa.array([], pa.int32()), "item": pa.array([], pa.int32()), "docs": pa.array([], pa.binary()), "scores": pa.array([], pa.binary())})
    sizes = []
    for owner in range(4):
        t, d = np.nonzero((tf > 0) & (owners == owner)[:, None])
        right = pa.table({"size": pa.array([size], pa.int32()), "ids": pa.array([list(range(size))], pa.list_(pa.int64())), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in (("term", t.astype(np.int32)), ("doc", d.astype(np.uint16)), ("impact", impact[t, d].astype(np.int32)))}})
        visit = lexical_search._visit([np.flatnonzero(owners == owner)], weights, [int(bound[owners >= owner].sum())], [int(bound[owners > owner].sum())], owner == 3)
        bundle = visit((pa.scalar(0), pa.scalar(0)), bundle, right)
        sizes.append(len(bundle["docs"][0].as_py()) // 2 if owner < 3 else bundle.num_rows)
    best = sorted((-int(s), i) for i, s in enumerate(full))[:10]
    assert [(r["doc_id"], r["score"]) for r in bundle.to_pylist()] == [(i, -s) for s, i in best] and sizes[2] < size


# 12 --------------------------------------------------------------------------------------------------------------


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://Www.Example.NET/en/a?x=/b#c", "www.example.net", "/en/a", "example.net/en/", "allow"), ("https://example.net", "example.net", "", None, None),
        ("//example.net/x", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("http://a.example.com/de/", "a.example.com", "/de/", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, None), ("ftp://x.org/fr/1://y", "x.org", "/fr/1:", "org/fr/", "allow"), ("http://b.net/?q", "b.net", "/", "net/", "block"),
        ("http://?http://c.net/", "", "", None, None), ("http://\u00c9.net#/x", "\u00c9.net", "", None, None),
    ]
    pages = spark.createDataFrame([(i, c[0], "x", "y", 1) for i, c in enumerate(cases)] + [(None, "http://b.net/", "x", "y", 1)], "page_id long, url string, host string, verdict string, n int")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, spark.createDataFrame([(0, None), (None, 1)], "page_id long, bad int")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        path = path if i != 7 else "/fr/1://y"
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), i
    assert got[None].rule == "net/" and len(got) == len(cases) + 1
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame([], "page_id long, bad int")).count() == 0


def test_reputation_shrinks_to_the_level_above(spark):
    """A host of many bad pages is blocked, one with two bad ones of two isn't, but is where its whole domain is bad."""
    rows, bad, n = [], [], 0
    for host, good, wrong in [("big.bad.com", 10, 90), ("few.fine.com", 0, 2), *((f"h{i}.fine.com", 40, 2) for i in range(20)), *((f"s{i}.spam.co.uk", 1, 30) for i in range(20)), ("new.spam.co.uk", 0, 0), ("new.fine.com", 0, 0)]:
        for k in range(good + wrong + (good + wrong == 0)):
            rows.append((n, f"http://{host}/{k}"))
            if good + wrong:
                bad.append((n, int(k < wrong)))
            n += 1
    pages, outcomes = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(bad, "page_id long, bad int")
    verdicts = {r.host: r.verdict for r in url_filter.judge_urls(pages, outcomes, rules=()).select("host", "verdict").distinct().collect()}
    assert verdicts["big.bad.com"] == "block" and verdicts["few.fine.com"] == "allow" and verdicts["new.spam.co.uk"] == "block" and verdicts["new.fine.com"] == "allow"
    hosts = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("1.2.3.4:80",), ("u@x.y.de:8080",), ("",), ("localhost",)], "host string")
    bare = url_filter.bare_host(F.col("host"))
    suffix = url_filter.suffix_of(bare)
    assert [tuple(r) for r in hosts.select(suffix, url_filter.domain_of(bare, suffix)).collect()] == [("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("", "1.2.3.4"), ("de", "y.de"), ("", ""), ("localhost", "localhost")]


# 13 --------------------------------------------------------------------------------------------------------------


def spelled(rows):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def test_spellings_against_all_pairs(spark, odd, empty, monkeypatch):
    rnd = random.Random(51)
    base = ["".join(rnd.choice("aab\u00e9o") for _ in range(rnd.randint(7, 11))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa"]
    words = []
    for w in base:
        words += [w] * rnd.choice([1, 3, 30, 400])
        at = rnd.randrange(len(w))
        words += [w[:at] + rnd.choice("abz") + w[at:]] * 2 + [w[:at] + w[at + 1 :]] * 3 + [w[:at] + "Z" + w[at + 1 :]] * 2
    rnd.shuffle(words)
    docs = [(i, " ".join(words[i * 25 : i * 25 + 25])) for i in range(len(words) // 25 + 1)] + [(None, "Aaaaaaa aaaaaaa"), (3, None), (4, "q" * 5000 + " " + "q" * 5000 + " " + "q" * 4999 + " " + "q" * 4999)]
    odd_rows = [(r.doc_id, r.text) for r in odd.collect()]
    table = spark.createDataFrame(rows_of(docs), SCHEMA).union(odd)
    want = plain.spellings(docs + odd_rows)
    assert spelled(spelling.groups(table).collect()) == want and sum(v[2] is not None for v in want.values()) > 20
    assert spelling.groups(empty).count() == 0


def test_position_index_finds_one_error_in_any_part(monkeypatch):
    """Vocabularies in one shard, over several machine words and asked in parts."""
    monkeypatch.setattr(spelling, "ASKED", 50)
    rnd = random.Random(61)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.choice([7, 8]))) for _ in range(300)})
    codes = np.array(words).view(np.uint32).reshape(len(words), -1)
    lengths = (codes > 0).sum(axis=1)
    index = spelling.PositionIndex(codes, lengths)
    found = set()
    for start, stop in ((0, 3), (3, 7)):
        every = np.full(len(words), 0), np.full(len(words), len(words)), np.full(len(words), start), np.full(len(words), stop)
        for a, b in index.one_error(7, *every):
            pairs = list(zip(a.tolist(), b.tolist()))
            assert not found & set(pairs) and len(pairs) == len(set(pairs))
            found |= set(pairs)
    near = lambda a, b: sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else any(b[:i] + b[i + 1 :] == a for i in range(len(b)))
    want = {(i, j) for i, a in enumerate(words) if len(a) == 7 for j, b in enumerate(words) if (len(b) == 8 or j > i) and near(a, b)}
    assert found == want


@pytest.mark.parametrize("name", ["op5_quality_rules", "op8_mix_sources", "op9_chat_format", "op12_url_filters"])
def test_no_python_in_native_plans(spark, name):
    plan = QUERIES[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Python", "Pandas", "Arrow", "MapIn", "ExternalRDD"))


def test_a_full_cache_of_pieces_keeps_its_newer_half(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 8)
    words = bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    cache, calls = bpe._Pieces(words), []
    encoded = cache._encoded
    cache._encoded = lambda piece: calls.append(piece) or encoded(piece)
    for n in range(40):
        assert cache[" usual"] == encoded(" usual") and cache[f" rare{n}"] == encoded(f" rare{n}")
        assert len(cache) <= 4 and len(cache.older) <= 4
    assert calls.count(" usual") == 1
