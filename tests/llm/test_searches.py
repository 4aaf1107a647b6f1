"""Ranked search, decontamination and conversation repair, against brute force on awkward rows."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftlake.llm import conversations, phrases, ranking

DOCS = "doc_id long, text string, row string, n_words string, spans int, item_key string, __row int"
ITEMS = "item_id long, text string, doc_id int, score string"
TERM = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
LOWER = {code: code + 32 for code in range(65, 91)}


def terms_of(text):
    return re.findall(TERM, (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def items():
    draw = random.Random(4)
    words = ["The", "the", "of", "ÉTÉ", "x1", "日本", *(f"i{n}" for n in range(60))]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(8, 30))) for _ in range(30)]
    texts += [None, "", " ... ", "lone", "two words", "the of the of the of the of the of the of", texts[3], "x1 " * 40]
    return list(enumerate(texts)) + [(3, texts[5]), (None, texts[6]), (7, texts[7])]


@pytest.fixture(scope="module")
def rows(items):
    """Documents with whole items, cut items, windows that just miss, copies, NULLs and very long texts."""
    draw = random.Random(5)
    words = ["The", "OF", "été", "ÉTÉ", "x1", "lone", "日本", *(f"i{n}" for n in range(60)), *(f"d{n}" for n in range(200))]
    texts = []
    for _ in range(60):
        parts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 40)))]
        for _ in range(draw.randint(0, 3)):
            item = terms_of(draw.choice(items)[1])
            start = draw.randint(0, max(0, len(item) - 3))
            parts += ["--".join(item[start : start + draw.randint(1, 30)]).upper(), draw.choice(words)]
        texts.append("\n".join(parts))
    texts += [texts[0], texts[0], None, "", "...", "the of " * 500, "x1 " * 39, "i1i2" * 3000, "two\tWORDS!", " ".join(draw.choice(words) for _ in range(30000))]
    return [(n * 2, t) for n, t in enumerate(texts)] + [(0, "lone"), (None, "lone i1 i2"), (None, None), (4, texts[2])]


def doc_frame(spark, rows):
    return spark.createDataFrame([(i, t, "r", "w", 1, "k", 2) for i, t in rows], DOCS).repartition(3)


def item_frame(spark, items):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in items], ITEMS)


def brute_contamination(rows, items, size=10):
    windows = defaultdict(set)
    for name, text in items:
        words = terms_of(text)
        length = min(size, len(words))
        for at in range(len(words) - length + 1) if words else ():
            windows[tuple(words[at : at + length])].add(name)
    lengths = {len(w) for w in windows}
    for number, text in rows:
        words, hit, found = terms_of(text), set(), set()
        for at, length in itertools.product(range(len(words)), lengths):
            own = windows.get(tuple(words[at : at + length]))
            if own and at + length <= len(words):
                hit.update(range(at, at + length))
                found |= own
        yield number, text, words, hit, sorted(str(n) for n in found if n is not None)


def test_contamination(spark, rows, items):
    expected = Counter(
        (i, len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
        for i, _, words, hit, names in brute_contamination(rows, items)
    )
    found = phrases.contamination_report(doc_frame(spark, rows), item_frame(spark, items))
    assert Counter(map(tuple, found.collect())) == expected
    assert sum(c for row, c in expected.items() if row[-1]) > 20 and sum(c for row, c in expected.items() if not row[-1]) > 5


def test_contamination_in_blocks_of_items(spark, rows, items, monkeypatch):
    whole = phrases.contamination(doc_frame(spark, rows), item_frame(spark, items)).collect()
    monkeypatch.setattr(phrases, "ITEM_BYTES", 700)
    blocks = phrases.contamination(doc_frame(spark, rows), item_frame(spark, items))
    assert blocks.columns == ["doc_id", "text", "row", "item_key", "__row", "n_words", "spans", "items"]
    assert sorted(map(repr, blocks.collect())) == sorted(map(repr, whole))


def test_contaminated_spans_are_cut_out(spark, rows, items):
    expected = Counter()
    for number, text, words, hit, _ in brute_contamination(rows, items):
        expected[number, tuple(w for at, w in enumerate(words) if at not in hit)] += 1
    cut = phrases.without_spans(doc_frame(spark, rows), item_frame(spark, items))
    assert cut.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert Counter((r.doc_id, tuple(terms_of(r.text))) for r in cut.collect()) == expected


def test_contamination_of_empty_tables(spark, rows, items):
    docs, tests = doc_frame(spark, rows), item_frame(spark, items)
    assert phrases.contamination_report(docs.limit(0), tests).collect() == []
    assert not any(r.contaminated for r in phrases.contamination_report(docs, tests.limit(0)).collect())


def test_fm_index_finds_every_place():
    draw = np.random.default_rng(1)
    symbols = np.concatenate([np.append(draw.integers(1, 4, draw.integers(1, 200)), 0) for _ in range(40)] + [[1] * 500 + [0]])
    index = phrases.FMIndex(symbols, 3)
    table = np.array([list(p) + [0] * (5 - len(p)) for n in (1, 2, 5) for p in itertools.product((1, 2, 3), repeat=n)])
    low, high = index.search(table, np.count_nonzero(table, axis=1))
    text = symbols.astype(np.uint8).tobytes()
    for phrase, a, b in zip(table, low, high):
        wanted = phrase[phrase > 0].astype(np.uint8).tobytes()
        places = [at for at in range(len(text)) if text.startswith(wanted, at)]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == places


def brute_ranks(rows, items, k=10):
    counts = [(number, Counter(terms_of(text))) for number, text in rows]
    counts = [(number, c) for number, c in counts if c]
    n_all, l_all = len(counts), sum(c.total() for _, c in counts)
    holders = Counter(term for _, c in counts for term in c)
    for name, text in items:
        scored = []
        for number, c in counts:
            m = 10 + 90 * c.total() * n_all // l_all
            score = 0
            for term in set(terms_of(text)):
                weight = math.floor(1000 * math.log((2 * n_all + 2) / (2 * holders[term] + 1)))
                score += weight * (10**9 * c[term] // (1000 * c[term] + 8 * m))
            if score > 0:
                scored.append((-score, number is None, number))
        for rank, (score, _, number) in enumerate(heapq.nsmallest(k, scored), 1):
            yield name, rank, number, -score


@pytest.mark.parametrize("item_bytes, batch_bytes", [(256 << 10, 16 << 20), (700, 4000)])
def test_ranked_search(spark, rows, items, monkeypatch, item_bytes, batch_bytes):
    monkeypatch.setattr(ranking, "ITEM_BYTES", item_bytes)
    monkeypatch.setattr(ranking, "BATCH_BYTES", batch_bytes)
    found = ranking.ranked(doc_frame(spark, rows), item_frame(spark, items))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == Counter(brute_ranks(rows, items))


def test_ranked_search_of_empty_tables(spark, rows, items):
    docs, tests = doc_frame(spark, rows), item_frame(spark, items)
    assert ranking.ranked(docs.limit(0), tests).collect() == []
    assert ranking.ranked(docs, tests.limit(0)).collect() == []
    assert ranking.ranked(docs.where("text is null"), tests).collect() == []


def test_bounds_leave_out_pairs_but_no_result():
    draw = np.random.default_rng(2)
    docs = (draw.random((300, 40)) < 0.1) * draw.integers(1, 1000, (300, 40)).astype(float)
    docs = docs[np.argsort(docs.argmax(1))]
    items = (draw.random((70, 40)) < 0.05) * draw.integers(1, 50, 40).astype(float)
    full = docs @ items.T
    bars = np.maximum(1, np.sort(full, axis=0)[-10]).astype(np.int64)
    row, column, score = ranking.surviving_pairs(ranking.tree_levels(docs, 2), ranking.tree_levels(items, 2), bars)
    assert sorted(zip(row, column, score)) == sorted((r, c, full[r, c]) for r, c in zip(*np.nonzero(full >= bars)))


SPACE = " \t\n\x0b\x0c\r"
CHAT = "conv_id long, turn long, role string, text string, audit string, header int, digest string"


def cheapest(rows):
    """(cost, audit, lines) by shortest path over (rows done, grammar state), lines being carried along."""
    queue, done = [(0, "", 0, 0, [])], {}
    steps = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    while queue:
        cost, audit, at, state, lines = heapq.heappop(queue)
        if (at, state) in done:
            continue
        if at == len(rows) and state in (0, 3):
            return cost, audit, lines
        done[at, state] = True
        wanted = "a" if state == 2 else "u"
        role = {"u": "user", "a": "assistant"}[wanted]
        heapq.heappush(queue, (cost + 2, audit + "I", at, steps[state, wanted], [*lines, role + ":"]))
        if at < len(rows):
            own, text, fault = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                heapq.heappush(queue, (cost + 2 + late, audit + "R", at + 1, steps[state, wanted], [*lines, role + ":" + text]))
                if (state, own[:1]) in steps:
                    heapq.heappush(queue, (cost + late, audit + "K", at + 1, steps[state, own[:1]], [*lines, own + ":" + text]))


def brute_repair(table):
    groups = defaultdict(list)
    for number, turn, role, text in table:
        kind = zlib.crc32(f"{' ' if number is None else number}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = groups[number]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for number, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{r[1]}\0{r[2]}".encode()).hexdigest()))
        seen, rows, faults = set(), [], Counter()
        for _, role, text in own:
            end = text.rstrip(SPACE)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            rows.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _, _), (b, _, _) in itertools.pairwise(rows))
        cost, audit, lines = cheapest(rows)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        yield number, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest


@pytest.fixture(scope="module")
def chats():
    draw = random.Random(8)
    table = []
    for number in [*range(120), None]:
        for turn in range(draw.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            role = draw.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "user", None])
            text = draw.choice(["Yes.", "No", "What? ", "é!", "", " \n", None, f"w{turn}.", "a ", "cut ..  x"])
            table.append((number, draw.choice([turn, turn, turn, turn * 2, None]), role, text))
    table += table[:30]
    # Of one conversation, very long, with long texts.
    table += [(500, n, "user" if n % 2 else "assistant", f"{n} " * (3000 if n % 500 == 0 else 2) + ".") for n in range(1500)]
    return table


def chat_frame(spark, table):
    return spark.createDataFrame([(*row, "a", 1, "d") for row in table], CHAT).repartition(4)


def test_conversation_repair(spark, chats):
    found = conversations.damaged_and_repaired(chat_frame(spark, chats)).collect()
    assert Counter(map(tuple, found)) == Counter(
        {row: 1 for row in brute_repair(chats)} | {(n, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()): 1 for n in {r[0] for r in chats} - {row[0] for row in brute_repair(chats)}}
    )
    assert len({row.audit for row in found}) > 60


def test_conversations_of_which_nothing_is_left(spark):
    dropped = next(n for n in range(200) if zlib.crc32(f"{n}:1".encode()) % 20 == 0)
    found = conversations.damaged_and_repaired(chat_frame(spark, [(dropped, 1, "user", "x")])).collect()
    assert [tuple(r) for r in found] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.damaged_and_repaired(chat_frame(spark, [(1, 1, "user", "x")]).limit(0)).collect() == []


def test_repaired_turns_are_legal(spark, chats):
    table = chat_frame(spark, chats)
    turns = defaultdict(dict)
    for r in conversations.repaired_turns(table).collect():
        turns[r.conv_id][r.position] = r
    audits = {r.conv_id: r.audit for r in conversations.repairs(table).collect()}
    assert {n: "".join(own[at].edit for at in sorted(own)) for n, own in turns.items()} == audits
    for own in turns.values():
        initials = "".join(own[at].role[0] for at in sorted(own) if own[at].role is not None)
        assert re.fullmatch("(s?(ua)+)?", initials)
        assert all((row.role is None) == (row.edit == "D") and (row.edit != "I" or row.text == "") for row in own.values())


def test_suffixes_share_nodes():
    automaton = conversations.SuffixAutomaton()
    draw = random.Random(3)
    for _ in range(2000):
        node = automaton.end
        for _ in range(30):
            node, _ = automaton.before(draw.choice("suaoxSUAO"), node)
    # Suffixes are told apart only by what they make cheapest, so the register does not grow with them.
    assert len(automaton.nodes) < 400 and len(automaton.register) < 9 * 400
