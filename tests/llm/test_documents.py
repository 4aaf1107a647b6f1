"""The operators on whole documents, against brute force on small tables of awkward rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from siftlake.llm import fingerprints, jaccard, licenses, mixing, sharding, substrings
from siftlake.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, digest string, row string, score int"

SCHEMA_NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


def words_of(text, lower=False):
    data = (text or "").encode()
    if lower:
        data = data.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    return data.split()


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, NULLs, empty, short and long texts."""
    draw = random.Random(7)
    vocabulary = ["the", "Of", "ÉTÉ", "naïve", "x", "Licence", "a-b", "...", "日本", *(f"w{n}" for n in range(300))]

    def text(size):
        return " ".join(draw.choice(vocabulary) for _ in range(size))

    passage, base = text(70), [text(draw.randint(60, 160)) for _ in range(25)]
    texts = [*base, base[3], base[3], base[4].upper(), None, None, "", "  \n\t ", "one", "one", "ONE", "two words here"]
    for near in base[:8]:
        words = near.split(" ")
        for _ in range(4):
            changed = list(words)
            for at in draw.sample(range(len(words)), 3):
                changed[at] = "new" + str(draw.randint(0, 99))
            texts.append(" ".join(changed))
    texts += [text(20) + "\n" + passage + "\t" + text(20) for _ in range(6)]
    texts += [text(30000), "unbroken" * 4000, "nul\u0000and line sep"]
    draw.shuffle(texts)
    return [(n * 3 + 1, t) for n, t in enumerate(texts)]


def frame(spark, rows, schema=SCHEMA):
    full = [(i, t, "en", f"s{(i or 0) % 4}" if (i or 0) % 5 else None, len(t or ""), "c", "d", "r", 1) for i, t in rows]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_components(rows, percent=80, size=5):
    sets = {}
    for number, text in rows:
        words = words_of(text, lower=True)
        grams = {tuple(words[at : at + size]) for at in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)}
        sets[number] = grams if words else set()
    parent = {number: number for number in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    one, two = find(a), find(b)
                    parent[max(one, two)] = min(one, two)
    return {number: (len(sets[number]), find(number)) for number in sets}


def test_jaccard_components(docs, rows):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert found == brute_components(rows)


def test_jaccard_of_many_borderline_copies(spark):
    draw = random.Random(3)
    base = [f"b{n}" for n in range(60)]
    rows = []
    for number in range(90):
        words = list(base)
        for at in draw.sample(range(60), draw.randint(0, 3)):
            words[at] = f"n{draw.randint(0, 500)}"
        rows.append((number, " ".join(words)))
    found = jaccard.jaccard_components(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows)


def test_jaccard_of_null_and_repeated_ids(spark, empty):
    assert jaccard.jaccard_components(empty).collect() == []
    text = "a b c d e f g"
    rows = [(None, text), (5, text), (5, text), (9, text), (5, "other words in this one")]
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows)).collect())
    assert found == [(0, 3, None), (5, 1, 5), (5, 3, 5), (5, 3, 5), (9, 3, 5)]


def test_jaccard_of_repeated_rows(spark):
    words = [f"w{n}" for n in range(100)]
    near, far = [*words[:96], "x"], [*words[:90], *"abcdefghij"]
    rows = [(1, " ".join(words))] * 2000 + [(2, " ".join(near))] * 2000 + [(2, " ".join(far)), (3, "lone one")]
    found = defaultdict(int)
    for r in jaccard.jaccard_components(frame(spark, rows)).collect():
        found[r.doc_id, r.n_shingles, r.component_id] += 1
    assert found == {(1, 96, 1): 2000, (2, 93, 1): 2000, (2, 96, 1): 1, (3, 1, 3): 1}


def test_parities_never_differ_more_than_their_sets():
    draw = np.random.default_rng(3)
    for size in (1, 5, 80, 900):
        one = np.unique(draw.integers(0, 1 << 63, size)).astype(np.uint64)
        two = np.unique(np.concatenate([one[: size * 3 // 4], draw.integers(0, 1 << 63, size // 5).astype(np.uint64)]))
        bits = np.unpackbits((jaccard.parity(one) ^ jaccard.parity(two)).view(np.uint8)).sum()
        assert bits <= len(np.setxor1d(one, two)) and (size > 300 or bits >= 0.7 * len(np.setxor1d(one, two)))


def brute_removal(rows, window=50):
    first = {}
    for number, text in sorted(rows):
        words = words_of(text)
        for at in range(len(words) - window + 1):
            first.setdefault(tuple(words[at : at + window]), number)
    result = {}
    for number, text in rows:
        words = words_of(text)
        left = [True] * len(words)
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] < number:
                left[at : at + window] = [False] * window
        kept = b" ".join(w for w, stays in zip(words, left) if stays)
        result[number] = (len(words), len(words) - sum(left), hashlib.sha256(kept).hexdigest())
    return result


def test_repeated_passages(docs, rows):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removal_digests(docs).collect()}
    expected = brute_removal(rows)
    assert found == expected
    assert sum(removed > 0 for _, removed, _ in expected.values()) > 5


def test_factors_refer_to_equal_words(docs, rows):
    texts = {number: words_of(text) for number, text in rows}
    documents, parsed = substrings.repeated_passages(docs)
    owner = {r.digest: r.doc_id for r in documents.orderBy("doc_id", ascending=False).collect()}
    factors = [(owner[r.digest], f) for r in parsed.collect() for f in r.factors]
    assert factors
    for number, factor in factors:
        words, reference = texts[number][factor.start : factor.start + factor.length], texts[factor.ref_id]
        assert len(words) == factor.length >= 50 and factor.ref_id < number
        assert reference[factor.ref_start : factor.ref_start + factor.length] == words


def test_a_factor_is_one_passage_of_its_reference():
    hits = {
        "start": np.array([0, 1, 2, 3, 4, 9]),
        "ref_id": np.array([1, 1, 1, 1, 2, 2]),
        "ref_key": np.array([7, 7, 7, 7, 8, 8]),
        "ref_start": np.array([5, 6, 40, 41, 42, 47]),
    }
    assert substrings.factors_of(hits, 50) == [(0, 51, 1, 5), (2, 51, 1, 40), (4, 50, 2, 42), (9, 50, 2, 47)]


@pytest.mark.parametrize("repeats", [800, 10_000])
def test_removal_from_repeated_rows(spark, repeats):
    draw = random.Random(6)
    passage = " ".join(f"p{draw.randint(0, 10**6)}" for _ in range(120))
    text = " ".join(f"t{n}" for n in range(500)) + " " + passage + " end"
    rows = [(2, passage)] + [(5, text)] * repeats + [(6, "x " + passage)]
    found = defaultdict(int)
    for r in substrings.removal_digests(frame(spark, rows)).collect():
        found[r.doc_id, r.n_words, r.n_removed] += 1
    assert found == {(2, 120, 0): 1, (5, 621, 120): repeats, (6, 121, 120): 1}
    left = substrings.without_repeats(frame(spark, rows))
    assert left.where("doc_id = 5 and length(text) < 4000").count() == repeats and left.columns == SCHEMA_NAMES


def test_removal_of_a_block_that_most_rows_hold(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_BLOCKS", 8)
    draw = random.Random(7)
    passage = " ".join(f"p{n}" for n in range(55))
    rows = [(n, f"a{n} " + passage + f" b{draw.randint(0, 9)}") for n in range(300)]
    rows += [(1000 + n, " ".join(f"r{(n // 2 * 100) + m}" for m in range(60)) + f" e{n}") for n in range(40)]
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removal_digests(frame(spark, rows)).collect()}
    assert found == brute_removal(rows)


def test_documents_without_repeats(spark, docs, rows, empty):
    found = substrings.without_repeats(docs)
    assert found.columns == docs.columns and found.count() == docs.count()
    digests, texts = brute_removal(rows), dict(rows)
    for row in found.collect():
        removed, digest = digests[row.doc_id][1:]
        if removed:
            assert hashlib.sha256(row.text.encode()).hexdigest() == digest
        else:
            assert row.text == texts[row.doc_id]
    assert substrings.removal_digests(empty).collect() == []
    twice = [(4, " ".join(map(str, range(60))))] * 2
    assert [r.n_removed for r in substrings.removal_digests(frame(spark, twice)).collect()] == [0, 0]


def test_repeats_of_one_id_with_different_texts(spark):
    draw = random.Random(9)

    def text(name, size):
        return " ".join(f"{name}{draw.randint(0, 10**6)}" for _ in range(size))

    passage, copied, unique, other = text("p", 60), text("c", 80), text("u", 90), text("o", 70)
    rows = [
        (3, text("x", 10) + " " + passage), (3, copied),
        (5, text("y", 20) + " " + passage + " " + text("z", 5)), (5, unique), (5, copied), (5, unique),
        (5, text("v", 40) + " " + other), (8, other + " " + text("w", 7) + " " + passage), (8, unique), (8, "short"), (None, unique),
    ]
    first, expected = {}, defaultdict(int)
    for number, t in rows:
        words = words_of(t)
        for at in range(len(words) - 49):
            block = tuple(words[at : at + 50])
            first[block] = min(first.get(block, number or 10**9), number or 10**9)
    for number, t in rows:
        words = words_of(t)
        gone = set()
        for at in range(len(words) - 49):
            if number is not None and first[tuple(words[at : at + 50])] < number:
                gone.update(range(at, at + 50))
        kept = b" ".join(w for at, w in enumerate(words) if at not in gone)
        expected[number, len(words), len(gone), kept] += 1
    found = defaultdict(int)
    for r in substrings.removal_digests(frame(spark, rows)).collect():
        found[r.doc_id, r.n_words, r.n_removed, r.kept_sha256] += 1
    assert found == {(i, n, g, hashlib.sha256(k).hexdigest()): c for (i, n, g, k), c in expected.items()}
    left = sorted((r.doc_id or 0, r.text) for r in substrings.without_repeats(frame(spark, rows)).collect())
    assert left == sorted((i or 0, k.decode()) for (i, _, _, k), c in expected.items() for _ in range(c))


def test_mix(spark, docs, rows, empty):
    plan = mixing.mix_plan(docs).collect()
    assert sorted(r.doc_id for r in plan) == [number for number, _ in rows]
    source = {number: f"s{number % 4}" if number % 5 else None for number, _ in rows}
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in plan:
        assert r.size == len(words_of(dict(rows)[r.doc_id])) and 0 <= r.taken <= 3 * r.size
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        targets[source[r.doc_id]] = r.target
    assert {source[r.doc_id]: r.source_size for r in plan} == sizes
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in targets)
    names = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: at % 3 + 1 for at, s in enumerate(names)}
    expected, open_names, left = {}, set(names), sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_names) for s in open_names}
        over = [s for s in open_names if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            expected[s] = 3 * sizes[s]
            left -= expected[s]
            open_names.remove(s)
    expected |= share
    assert targets == pytest.approx(expected)
    assert sorted(mixing.mix_plan(docs).collect()) == sorted(plan)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    counted = defaultdict(int)
    for row in mixed.collect():
        counted[row.doc_id] += len(words_of(row.text))
    assert {r.doc_id: r.taken for r in plan if r.taken} == {n: c for n, c in counted.items() if c}
    assert mixing.mix_plan(empty).collect() == []
    nothing = mixing.mix_plan(frame(spark, [(1, None), (2, ""), (None, " ")])).collect()
    assert {(r.size, r.target, r.taken) for r in nothing} == {(0, 0.0, 0)}


def test_mix_of_rows_without_an_id(spark):
    columns = "doc_id long, text string, source string"
    rows = [(None, f"n{n} " + "x " * (n % 7), "b") for n in range(60)] + [(n, "y " * 30, "a") for n in range(60)]
    rows += [(None, "no source at all", None), (None, None, "b"), (None, "n1 again", "c")]
    docs = spark.createDataFrame(rows, columns).repartition(3)
    plan, mixed = mixing.mix_plan(docs).collect(), mixing.mix(docs).collect()
    expected = sum(r.taken for r in plan if r.doc_id is None)
    assert sum(len(words_of(r.text)) for r in mixed if r.doc_id is None) == expected > 0
    whole = defaultdict(int)
    for row in mixed:
        whole[row.source, row.text] += 1
    # Source b is short of its target, so every row of it comes out three times; so do the other small sources.
    assert all(whole[source, text] == 3 for number, text, source in rows if number is None and text)


def test_mix_of_repeated_ids_sums_up_to_the_plan(spark):
    draw = random.Random(2)
    rows = [(5, "p " * draw.randint(1, 9), "a") for _ in range(200)] + [(5, "q " * 4, "b") for _ in range(5)]
    rows += [(6, f"r{n} " * 50, "c") for n in range(20)] + [(n % 3, "s " * 6, None) for n in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    targets = {(r.source_size, r.target) for r in mixing.mix_plan(docs).collect()}
    planned, sizes, counted = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in mixing.mix_plan(docs).collect():
        planned[r.source_size] += r.taken
    for _, text, source in rows:
        sizes[source] += len(words_of(text))
    for row in mixing.mix(docs).collect():
        counted[sizes[row.source]] += len(words_of(row.text))
    assert len(set(sizes.values())) == 4 and counted == {size: taken for size, taken in planned.items() if taken}
    assert all(abs(counted[size] - target) <= 0.5 for size, target in targets)


def test_shards(spark, docs, rows, empty):
    found = sharding.byte_shards(docs, shards=4).collect()
    texts = dict(rows)
    assert sorted(r.doc_id for r in found) == sorted(texts)
    shards = defaultdict(list)
    for r in found:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
        shards[r.shard].append(r)
    for part in shards.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    largest = max(r.size for r in found)
    target = sum(r.size for r in found) / 4
    assert all(abs(sum(r.size for r in part) - target) <= largest + 0.1 * target for part in shards.values())
    assert sharding.byte_shards(empty).collect() == []
    many = frame(spark, [(n, "the same text") for n in range(4000)] + [(9000 + n, f"another {n}") for n in range(400)])
    sizes = defaultdict(int)
    for r in sharding.byte_shards(many).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) <= 1.02 * min(sizes.values()) and len(sizes) == 8
    again = [(None, "a"), (None, "a"), (3, None), (3, None)]
    assert sorted(r.size for r in sharding.byte_shards(frame(spark, again)).collect()) == [1, 1, 2, 2]


def test_fingerprints(spark, docs, rows, empty):
    found = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    ordered = [(number, text or "") for number, text in sorted(rows)]
    by_text = defaultdict(set)
    for at, (number, text) in enumerate(ordered):
        after = ordered[(at + 1) % len(ordered)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        row = found[number]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row.near_next <= 1 and 0 <= row.near_edited <= 1
        assert (row.near_edited == 1) or edited != text
        by_text[text].add(row.fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())
    long = [found[number] for number, text in ordered if len(text or "") > 300]
    assert np.mean([r.near_edited for r in long]) > 0.5
    assert fingerprints.edited_fingerprints(empty).collect() == []
    alone = fingerprints.edited_fingerprints(frame(spark, [(7, "only one here")])).collect()[0]
    assert alone.edited_sha256 == hashlib.sha256(b"only one honl").hexdigest() and alone.near_next == 1
    odd = [(1, "same text twice"), (1, "same text twice"), (2, "b"), (None, "no id at all")]
    assert len(fingerprints.edited_fingerprints(frame(spark, odd)).collect()) == 4


def brute_anchors(text, run=5, short=16):
    """Closed syncmers word by word, with Spark's seeded hash from its library."""

    def signed(value):
        return value - (1 << 64) if value >= 1 << 63 else value

    hashes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall("[^\x20\x09-\x0D]{1,16}", text)]
    if len(hashes) < short:
        found = [(at, own) for at, own in enumerate(hashes)]
    else:
        found = []
        for at in range(len(hashes) - run + 1):
            window = hashes[at : at + run]
            if min(window) in (window[0], window[-1]):
                seed = 42
                for own in window:
                    seed = xxhash.xxh64_intdigest(struct.pack("<q", own), seed)
                found.append((at, seed))
    places = [0, *(at for at, _ in found)]
    return [((own & 0xFFFFFFFF) << 8) | min(255, at - places[n] if n else at) for n, (at, own) in enumerate(found)]


def test_fingerprints_equal_brute_force(spark, docs, rows):
    def likeness(one, other):
        one, other = set(one), set(other)
        return len(one & other) / len(one | other) if one | other else 1.0

    ordered = [(number, text or "") for number, text in sorted(rows)]
    found = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    for at, (number, text) in enumerate(ordered):
        after = ordered[(at + 1) % len(ordered)][1]
        cut = len(text) // 4
        own, edited, following = (brute_anchors(t) for t in (text, text[: len(text) - cut] + after[:cut], after))
        row = found[number]
        assert row.fingerprint == "".join(f"{a:010x}" for a in own)
        assert row.edited_fingerprint == "".join(f"{a:010x}" for a in edited)
        assert row.near_edited == pytest.approx(likeness(own, edited)) and row.near_next == pytest.approx(likeness(own, following))


def test_syncmers_depend_on_their_run_alone(spark):
    draw = random.Random(1)
    passage = [f"p{draw.randint(0, 999)}" for _ in range(80)]
    texts = [["x"] * 3 + passage, [f"q{n}" for n in range(20)] + passage + ["y"]]
    table = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    one, two = (set(r.a) for r in fingerprints._with_anchors(table, "text", "a").orderBy("doc_id").collect())
    assert len(one & two) >= 0.85 * min(len(one), len(two)) > 10


LICENSE_TEXTS = [
    "Released under the MIT License.",
    "x UNDER, the--mit license under the MIT license",
    "Licensed under the Apache License, Version 2.0.",
    "apache license version 20",
    "Licensed under CC BY-NC 4.0. cc by nc cc by nc",
    "cc by Ncé",
    "ccéby nc",
    "This work is licensed under the GNU General Public License, version 3.",
    "general public license version 2",
    "license",
    "All rights reserved.",
    "KK mit under the",
    None,
    "",
    "word " * 5000 + "under the mit license",
]


def test_licenses(spark, empty):
    table = frame(spark, list(enumerate(LICENSE_TEXTS)))
    found = {r.doc_id: r for r in licenses.license_report(table).collect()}
    upper = {code: code + 32 for code in range(65, 91)}
    for number, text in enumerate(LICENSE_TEXTS):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(upper))
        places = [
            (at, t.label) for t in licenses.PHRASES for at in range(len(words)) if tuple(words[at : at + len(t.words)]) == t.words
        ]
        row, starts = found[number], [at for at, _ in places]
        assert (row.n_words, row.n_base) == (len(words), len(places))
        assert (row.first_word, row.last_word) == (min(starts, default=None), max(starts, default=None))
        assert row.base_labels == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
        assert 0 <= row.score <= 1 and (row.score == 1 or not places)
    assert found[7].labels == "gpl" and found[10].labels == "all-rights-reserved" and found[8].labels == ""
    assert licenses.license_report(empty).collect() == []


def test_license_labels_and_scores_equal_brute_force(spark):
    """Every start of every template is tried, and the score summed up word by word."""
    draw = random.Random(12)
    templates = licenses.PHRASES + licenses.NOTICES
    texts = list(LICENSE_TEXTS)
    for _ in range(60):
        words = []
        for template in draw.sample(templates, 3):
            own = [w if draw.random() < 0.93 else "other" for w in template.words]
            words += own[draw.choice([0, 0, 1, 2]) :] + draw.choices(["the", "license", "version", "2", "x"], k=draw.randint(0, 4))
        texts.append(" ".join(words))
    rows = list(enumerate(texts)) + [(3, "all rights reserved"), (None, "under the mit license")]
    upper = {code: code + 32 for code in range(65, 91)}
    split = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(upper)) for _, text in rows]
    holders = {word: sum(word in words for words in split) for template in templates for word in template.words}
    weight = {word: np.log((len(rows) + 1) / (n + 1)) + 1e-3 for word, n in holders.items()}
    expected = defaultdict(int)
    for (number, _), words in zip(rows, split):
        labels, best = set(), 0.0
        for template in templates:
            total = sum(weight[w] for w in template.words)
            for start in range(-len(template.words), len(words)):
                same = [0 <= start + at < len(words) and words[start + at] == w for at, w in enumerate(template.words)]
                if all(same[at] for begin, length in template.keys for at in range(begin, begin + length)):
                    labels.add(template.label)
                    best = max(best, sum(weight[w] for w, hit in zip(template.words, same) if hit) / total)
        expected[number, len(words), ",".join(sorted(labels)), round(min(1.0, best), 9)] += 1
    found = defaultdict(int)
    for r in licenses.license_report(frame(spark, rows)).collect():
        found[r.doc_id, r.n_words, r.labels, round(r.score, 9)] += 1
    assert found == expected and len({key[2] for key in expected}) > 8


def test_a_phrase_repeated_a_hundred_thousand_times(spark):
    table = frame(spark, [(1, "under the mit license " * 100_000), (2, "all rights reserved")])
    found = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) for r in licenses.license_report(table).collect()}
    assert found == {1: (400_000, 100_000, 0, 399_996, "mit"), 2: (3, 0, None, None, "all-rights-reserved")}


def test_components(spark):
    draw = random.Random(5)
    links = [(n, n + 1) for n in range(0, 300)] + [(1000, 1000 + n) for n in range(1, 200)] + [(5000, 5000), (None, 3)]
    draw.shuffle(links)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert found == {n: 0 for n in range(301)} | {n: 1000 for n in range(1000, 1200)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
