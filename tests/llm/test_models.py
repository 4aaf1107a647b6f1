"""Classifiers, the tokenizer and the embedding index."""

import random
import time
import zlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftlake.llm.sampling import labelled_sample
from siftlake.llm import pivots, quality, sentencepieces, toxicity
from siftlake.llm.sentencepieces import decode_ids, encode_texts, load_model

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(sentencepieces.MODEL), reason="needs the vocabulary")

TEXTS = [
    "",
    " ",
    "Hello world",
    "  two  spaces\tand\n\nlines ",
    "naïve café — 日本語 ☃ 😀👩‍👩‍👧",
    "\x00\x01 control ",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "word " * 300,
    "x" * 5000,
]


def best_score(text, model):
    """The best total score of a text, by plain dynamic programming over its characters."""
    raw = (" " + text).encode() if text else b""
    known = {model.texts[at]: model.scores[at] for at in model.piece[model.piece >= 0]}
    best = {0: 0.0}
    places = np.cumsum([0] + [len(c.encode()) for c in raw.decode()]).tolist()
    for end in range(1, len(places)):
        options = []
        for start in range(max(0, end - 48), end):
            part = raw[places[start] : places[end]]
            if part in known:
                options.append(best[start] + known[part])
            elif end - start == 1:
                options.append(best[start] + model.unknown_score)
        best[end] = max(options)
    return best[len(places) - 1]


def score_of(ids, model):
    """The total score of ids; a character in byte pieces counts as one unknown piece."""
    total, pending = 0.0, b""
    for at in ids:
        if model.bytes_from <= at < model.bytes_from + 256:
            pending += model.texts[at]
            try:
                pending.decode()
            except UnicodeDecodeError:
                continue
            total, pending = total + model.unknown_score, b""
        else:
            total += model.scores[at]
    return total


def test_best_segmentation_and_round_trip():
    model = load_model()
    draw = random.Random(2)
    letters = "abcdefgh tion  éö日\n☃."
    texts = TEXTS[:7] + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 40))) for _ in range(150)]
    ids, offsets = encode_texts(texts, model)
    for at, text in enumerate(texts):
        own = ids[offsets[at] : offsets[at + 1]]
        assert decode_ids(own, model) == text
        assert score_of(own.tolist(), model) == pytest.approx(best_score(text, model))


def test_long_segments_get_the_same_pieces(monkeypatch):
    model = load_model()
    draw = random.Random(4)
    texts = ["".join(draw.choice("abcdefghéö日☃xyzw") for _ in range(n)) for n in (1, 30, 700, 3000)] + ["the" * 900, "\x01" * 600, "日" * 400]
    rows = [np.frombuffer((" " + text).encode(), np.uint8) for text in texts]
    for window in (64, 1 << 16):
        monkeypatch.setattr(sentencepieces, "WINDOW", window)
        for row in rows:
            expected, _ = sentencepieces._viterbi(row[None, :], np.array([len(row)]), model)
            assert sentencepieces._viterbi_of_one(row, model).tolist() == expected.tolist()


def test_an_unspaced_text_of_ten_megabytes():
    model = load_model()
    draw = np.random.default_rng(5)
    text = draw.integers(97, 123, 10_000_000).astype(np.uint8).tobytes().decode()
    began = time.process_time()
    ids, offsets = encode_texts([text, "a b"], model)
    assert decode_ids(ids[: offsets[1]], model) == text
    # Linear: about two microseconds a byte. A step over all rows for each byte would take half an hour.
    assert time.process_time() - began < 120


def test_same_ids_as_the_unigram_library():
    sentencepiece = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(sentencepieces.MODEL, "rb") as file:
        proto.ParseFromString(file.read())
    # The vocabulary's scores, read as those of a unigram model. The library adds them up in single
    # precision, which its two lowest scores would use up, so they are raised for both.
    proto.trainer_spec.model_type = 1
    for piece in proto.pieces:
        piece.score = max(piece.score, -40000.0)
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    model = load_model()
    model = replace(model, scores=np.maximum(model.scores, -40000.0))
    texts = ["Hello world", "Enauää enpf chstzu be gezutz auf", "the quick brown fox", "Licensed under the MIT License.", "désespoir naïveté"]
    ids, offsets = encode_texts(texts, model)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(text) for text in texts]


def test_trie_holds_exactly_its_keys():
    keys = {bytes(random.Random(n).choices(range(97, 103), k=n % 7 + 1)): n for n in range(400)}
    base, check, piece = sentencepieces.double_array(keys)

    def look_up(text):
        state = 0
        for byte in text:
            after = base[state] + byte + 1
            if check[after] != state:
                return -1
            state = after
        return piece[state]

    assert all(look_up(key) == value for key, value in keys.items())
    assert all(look_up(key + b"z") == -1 for key in keys)


def test_encode_tables(spark):
    rows = [(n, t, [n], 5) for n, t in enumerate(TEXTS)] + [(None, None, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row array<int>, ids int").repartition(2)
    full = sentencepieces.encode(docs)
    assert full.columns == ["doc_id", "text", "row", "ids"]
    back = {r.doc_id: r.decoded for r in sentencepieces.decode(full).collect()}
    assert back == {n: t for n, t in enumerate(TEXTS)} | {None: ""}
    assert sentencepieces.encode(docs.limit(0)).collect() == []
    assert {r.same for r in sentencepieces.round_trip(docs).collect()} == {True}
    empty = full.limit(1).select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert [r.decoded for r in sentencepieces.decode(empty).collect()] == [None]


@pytest.fixture(scope="module")
def labelled(spark):
    """Texts with a planted insult, or in capitals; labels repeat, contradict, and cover missing ids."""
    draw = random.Random(4)
    vocabulary = [f"{a}{b}" for a in ("lo", "ra", "mi", "ten") for b in ("na", "ver", "sol", "", "dic")]
    docs, labels = [], []
    for number in range(600):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(15, 80))]
        toxic, good = number % 4 == 0, number % 3 != 0
        if toxic:
            words[draw.randrange(len(words))] = draw.choice(["zgrumble", "Zgrumbling"])
        text = " ".join(words)
        docs.append((number, text if good else text.upper().replace(" ", "!! ")))
        labels.append((number, int(good), int(toxic)))
    docs += [(9001, None), (9002, ""), (None, "no id"), (9003, "same"), (9003, "same")]
    labels += [(1, 1 - labels[1][1], 1 - labels[1][2]), (77777, 1, 1), (5, None, None), (None, 1, 1), (2, *labels[2][1:])]
    table = spark.createDataFrame([(i, t, 0.5, "x") for i, t in docs], "doc_id long, text string, score double, row string")
    return table.repartition(3).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), docs


@pytest.mark.parametrize("module, folds, kept, threshold, column", [(toxicity, 5, 0, 0.5, 2), (quality, 4, 2, 0.7, 1)])
def test_classifiers(spark, labelled, module, folds, kept, threshold, column):
    table, labels, docs = labelled
    scored = module.scored_documents(table, labels).collect()
    assert len(scored) == len(docs)
    right = held = 0
    for row in scored:
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= threshold)
        if row.doc_id is None:
            assert row.held_out is False
            continue
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % folds == kept)
        if row.doc_id < 600 and row.held_out:
            truth = row.doc_id % 4 == 0 if column == 2 else row.doc_id % 3 != 0
            held, right = held + 1, right + (row.predicted == int(truth))
    assert held > 50 and right >= 0.95 * held
    assert sorted((r.doc_id or -1, r.score) for r in module.scored_documents(table, labels).collect()) == sorted(
        (r.doc_id or -1, r.score) for r in scored
    )
    nothing = module.scored_documents(table, labels.limit(0)).collect()
    assert {r.predicted for r in nothing} == {0 if module is toxicity else 1}
    assert module.scored_documents(table.limit(0), labels).collect() == []


def test_interactions_equal_all_pairs():
    random_numbers = np.random.default_rng(3)
    factors, values = random_numbers.normal(size=(9, 4)), random_numbers.normal(size=9)
    pairs = sum(
        factors[a] @ factors[b] * values[a] * values[b] for a in range(9) for b in range(a)
    )
    assert quality.interactions(factors, values) == pytest.approx(pairs)


def brute_links(rows, cosine=0.93):
    usable = [
        (n, np.array(v, float), lab)
        for n, v, lab in rows
        if n is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    links = {n: set() for n, _, _ in rows}
    for n, v, lab in usable:
        for m, w, other in usable:
            if n != m and lab == other and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= cosine:
                links[n].add(m)
    result = {}
    for n in links:
        reached, waiting = {n}, [n]
        while waiting:
            for m in links[waiting.pop()] - reached:
                reached.add(m)
                waiting.append(m)
        result[n] = (len(links[n]), min(reached, key=lambda x: (x is None, x)))
    return result


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(pivots, "PART_ROWS", 16)
    numbers = np.random.default_rng(11)
    rows, number = [], 0
    for label in (0, 1):
        for size in (1, 1, 2, 3, 5, 60):
            center = numbers.normal(size=24)
            for _ in range(size):
                rows.append((number, (center + 0.03 * numbers.normal(size=24)).tolist(), label))
                number += 1
    rows += [(500, [0.0] * 24, 0), (501, None, 0), (502, [1.0] * 23 + [None], 0), (503, [float("nan")] + [1.0] * 23, 0)]
    rows += [(504, rows[0][1], None), (505, rows[0][1][:12], 0), (506, [float("inf")] * 24, 1), (507, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    found = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_embeddings(table).collect()}
    expected = brute_links(rows)
    assert set(found) == set(expected)
    assert all(found[n][0] <= expected[n][0] for n in found)
    assert sum(n for n, _ in found.values()) >= 0.9 * sum(n for n, _ in expected.values()) > 1000
    assert {n: c for n, (_, c) in found.items()} == {n: c for n, (_, c) in expected.items()}
    assert all(r.kept == (r.vec_id == r.component_id) for r in pivots.near_embeddings(table).collect())
    assert pivots.near_embeddings(table.limit(0)).collect() == []


def test_embeddings_of_equal_vectors_and_repeated_ids(spark):
    numbers = np.random.default_rng(12)
    one, other = numbers.normal(size=16), numbers.normal(size=16)
    rows = [(n, one.tolist(), 0) for n in range(100, 3100)] + [(n, (one + 0.01 * n).tolist(), 0) for n in range(3)]
    rows += [(n, one.tolist(), 1) for n in range(5000, 5003)] + [(7000, other.tolist(), 0), (7000, other.tolist(), 0), (7001, numbers.normal(size=16).tolist(), 0)]
    # One id with two vectors joins what links with either.
    rows += [(8000, (-one).tolist(), 2), (8000, (-other).tolist(), 2), (8001, (-one).tolist(), 2), (8002, (-other).tolist(), 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    found = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_embeddings(table).collect()}
    assert all(found[n] == (3002, 0) for n in range(100, 3100)) and found[0] == found[2] == (3002, 0)
    assert all(found[n] == (2, 5000) for n in range(5000, 5003))
    assert found[7000][1] == 7000 and found[7001] == (0, 7001)
    assert {found[n][1] for n in (8000, 8001, 8002)} == {8000} and found[8001][0] == found[8002][0] == 1


def test_pivot_counts():
    assert pivots.pivot_count(0) == pivots.pivot_count(10_000) == 128
    assert pivots.pivot_count(1_000_000) == 512 and pivots.pivot_count(10**12) == 4096


def test_sample_is_drawn_from_the_documents_at_hand(spark):
    docs = spark.createDataFrame([(n, f"text {n}", "x") for n in range(200)] + [(3, "another", "x")] * 500, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(200)] + [(n, 0) for n in range(10_000, 40_000)], "doc_id long, toxic int")
    sample, share = labelled_sample(docs, labels, "toxic", F.lit(True), 60)
    rows = sample.collect()
    assert sorted(r.label for r in rows) == [0] * 60 + [1] * 60 and share == 100 / 30_200
    assert len({r.text for r in rows}) == 120
    everything, _ = labelled_sample(docs, labels, "toxic", F.lit(True), 1000)
    assert everything.count() == 200


@pytest.fixture(scope="module")
def small(spark):
    draw = random.Random(21)
    words = ["alpha", "Beta", "gamma", "naïve", "delta", "日本", "x", "stupid", "great"]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 8))) for _ in range(300)] + ["", None, "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(n, int("stupid" in (t or "")), int("great" in (t or ""))) for n, t in enumerate(texts)], "doc_id long, toxic int, quality int")
    return docs, labels, dict(enumerate(texts))


def sigmoid(margin):
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def test_toxicity_scores_equal_plain_sums_over_ngrams(small):
    docs, labels, texts = small
    weights, intercept = toxicity.train(docs, labels, "toxic", F.coalesce(toxicity.fold("doc_id", 5), F.lit(0)) != 0)
    assert np.count_nonzero(weights) > 10
    for row in toxicity.toxicity(docs, labels).collect():
        text, found = f" {(texts[row.doc_id] or '').lower()} ", set()
        for order in (3, 4, 5):
            for at in range(len(text) - order + 1):
                total = order * 0x9E3779B9 & 0xFFFFFFFF
                for factor, letter in zip(toxicity._FACTORS.tolist(), text[at : at + order]):
                    total = (total ^ ord(letter)) * factor & 0xFFFFFFFF
                    total ^= total >> 15
                found.add(total >> 12)
        assert row.score == pytest.approx(sigmoid(intercept + sum(float(weights[f]) for f in found)), abs=1e-6)


def test_quality_scores_equal_sums_over_all_pairs(small):
    docs, labels, texts = small
    intercept, table = quality.train(docs, labels, "quality", F.coalesce(quality.fold("doc_id", 4), F.lit(0)) != 2)
    for row in quality.quality(docs, labels).collect():
        columns, values = quality.features_of(pa.array([texts[row.doc_id]], pa.string()))[0]
        margin = intercept
        for at, (one, value) in enumerate(zip(columns, values)):
            margin += float(table[one, 0]) * value
            margin += sum(float(table[one, 1:] @ table[other, 1:]) * value * more for other, more in zip(columns[:at], values[:at]))
        assert row.score == pytest.approx(sigmoid(margin), abs=1e-4)
