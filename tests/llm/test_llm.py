"""Training-data operators on texts, against brute force, round trips and held-out accuracy."""

import random
from itertools import combinations, product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import leakage, neardup, packing, pairs, splitting, subjects, tokens
from tessera.llm.words import word_spans, words

# --- pairs


@pytest.mark.parametrize(
    ("prompt", "response", "expected", "want"),
    [
        ("What was the net income of Acme Corp in 2019?", None, "answer", "empty"),
        ("What was the net income of Acme Corp in 2019?", "**Answer**:\n [1_2019.htm::chunk3]", "answer", "empty"),
        ("What was the net income of Acme Corp in 2019?", "​", None, "empty"),
        ("What was the net income of Acme Corp in 2019?", "> QUESTION: what was  the net income of acme corp in 2019?", "answer", "copied_question"),
        ("What was the net income of Acme Corp in 2019?", "What was the net income of Acme Corp in 2019? It was $5.2 million.", "answer", None),
        ("What was the net income of Acme Corp in 2019?", "Sorry — I can’t assist with that. Please consult the filing itself.", "answer", "refusal"),
        ("What was the net income of Acme Corp in 2019?", "I cannot provide an answer to this question.", "abstain", None),
        ("What was the net income of Acme Corp in 2019?", "The filing is unable to quantify the effect, yet it reports net income of $5 million.", "answer", None),
        ("What was the net income of Acme Corp in 2019?", "Sorry for the long list: net income was $5 million in 2019.", "answer", None),
        ("What was the net income of Acme Corp in 2019?", "Der Jahresüberschuss von Acme Corp betrug im Geschäftsjahr 2019 insgesamt 5 Millionen Dollar.", "answer", "other_language"),
        ("What was the net income of Acme Corp in 2019?", "Чистая прибыль компании Acme Corp за 2019 год составила 982,0 млн долларов.", "answer", "other_language"),
        ("Wie hoch war der Umsatz von Acme im Jahr 2019?", "Der Umsatz von Acme betrug im Jahr 2019 insgesamt 5 Millionen Dollar.", "answer", None),
        ("What was the net income of Acme Corp in 2019?", "Net income was $5 million in 2019. The board had been aff", "answer", "truncated"),
        ("What was the net income of Acme Corp in 2019?", "Net income was $5 million in 2019. [1_2019.htm::chun", "answer", "truncated"),
        ("What was the net income of Acme Corp in 2019?", "Net income rose in 2019.\n- Net income: **", "answer", "truncated"),
        ("What was the net income of Acme Corp in 2019?", "- Net income: $5.0 million\n- Prior year: **$4 million**", "answer", None),
        ("What was the net income of Acme Corp in 2019?", "About 9.1% higher than in 2018", "answer", None),
        ("What was the net income of Acme Corp in 2019?", "**$5 million**", "answer", None),
        ("Did Acme mention a change in 2019?", "No.", "answer", None),
        (None, "Net income was $5 million.", "answer", None),
    ],
)
def test_defects(prompt, response, expected, want):
    assert pairs.defect(prompt, response, expected) == want


def test_defects_of_a_table(spark):
    df = spark.createDataFrame([("a", "q", None, "answer", 1), ("b", "q", "x" * 200_000 + ".", None, 2)], "case_id string, question string, answer string, expected_behavior string, defect int")
    assert [tuple(r) for r in pairs.defective(df).collect()] == [("a", "empty")]
    assert pairs.defective(df.limit(0)).count() == 0


# --- splitting

CONFIGS = [splitting.Config("a", 64, 0, False), splitting.Config("b", 64, 16, False), splitting.Config("c", 64, 16, True), splitting.Config("d", 9, 4, False)]
ALPHABET = st.text(st.sampled_from("ab .\n#é漢🙂​\r"), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(ALPHABET, max_size=60), st.sampled_from(CONFIGS))
def test_pieces_cover_the_text(parts, config):
    text = "\n## Item 1\nWord. ".join(parts)
    t = splitting.Tokenised(text)
    if t.count <= config.window:
        return
    ps = list(splitting.pieces(t, config))
    assert ps[0][0] == 0 and ps[-1][1] == t.count
    for (a, b, _), (c, d, _) in zip(ps, ps[1:], strict=False):
        assert a < c <= b < d and (config.overlap or c == b)
    for a, b, _ in ps:
        assert 0 < b - a <= config.window and t.places[a] <= t.places[b]


def test_pieces_alone_keep_the_limit_and_sections(spark):
    rng = random.Random(1)
    text = "".join(rng.choice(["Net income rose by 5.2% in 2019. ", "\n\n", "## Item 7\n\n", "- list entry\n", "Umsatz stieg; "]) for _ in range(3000))
    df = spark.createDataFrame([("k", text), ("n", None), ("e", ""), ("s", "short"), ("long", "x" * 300_000)], "record_key string, text string")
    got = splitting.split([("t", df)], CONFIGS).collect()
    assert {r.record_key for r in got} == {"k", "long"}
    for r in got:
        config = next(c for c in CONFIGS if c.config_id == r.config_id)
        assert tokens.count(r.text) <= config.window
        if config.section_aware:
            assert "\n## Item" not in r.text[1:]
    joined = "".join(r.text for r in sorted((r for r in got if r.config_id == "a" and r.record_key == "k"), key=lambda r: r.piece))
    assert joined == text


def test_an_edit_stays_local():
    rng = random.Random(2)
    text = " ".join(f"Sentence {rng.randrange(10_000)} says w{rng.randrange(999)}." for _ in range(3000))
    config = splitting.Config("a", 128, 0, False)

    def cut(x):
        t = splitting.Tokenised(x)
        return {x[t.places[a] : t.places[b]] for a, b, _ in splitting.pieces(t, config)}

    middle = text.index(" Sentence", len(text) // 2)
    before, after = cut(text), cut(text[:middle] + " An inserted sentence." + text[middle:])
    assert len(before) > 200 and len(before - after) <= 3


def test_no_room():
    with pytest.raises(ValueError):
        splitting.Config("x", 10, 10, False)


# --- near-duplicates


def test_allocation_is_optimal():
    rng = random.Random(2)
    for _ in range(150):
        n, width, goal = rng.randint(1, 4), rng.randint(1, 3), rng.randint(0, 9)
        costs = [[0, *(rng.randint(1, 30) for _ in range(width))] for _ in range(n)]
        got = neardup.allocate(costs, goal)
        sums = [sum(c[u] for c, u in zip(costs, x, strict=True)) for x in product(range(width + 1), repeat=n) if sum(x) == goal]
        if not sums:
            assert got is None
        else:
            assert sum(t + 1 for t in got) == goal and sum(c[t + 1] for c, t in zip(costs, got, strict=True)) == min(sums)


@pytest.mark.parametrize("similarity", [0.5, 0.8])
def test_pairs_within_the_bound_always_meet(similarity):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, (40, neardup.POSITIONS), dtype=np.uint64)
    parts, thresholds = neardup.planned(base.view(np.int64), 10_000, similarity)
    places = sorted(p for part in parts for p in part)
    assert places == list(range(len(places)))
    bound = neardup.distance_bound(len(places), 1 - similarity)
    assert sum(t + 1 for t in thresholds) == bound + 1
    for _ in range(200):
        a = base[rng.integers(40)].copy()
        b = a.copy()
        b[rng.choice(len(places), bound, replace=False)] += np.uint64(1)
        mine, other = neardup.probes(np.stack([a, b]), (parts, thresholds))
        assert set(mine.tolist()) & set(other.tolist())


def test_positions_that_agree_together_share_a_part():
    rng = np.random.default_rng(4)
    sketches = rng.integers(0, 3, (400, 8))
    sketches[:, 6], sketches[:, 3] = sketches[:, 1], sketches[:, 0]
    parts = neardup.correlated_parts(sketches, 8, 2)
    assert [1, 6] in parts and [0, 3] in parts


def test_distance_bound_is_the_tail():
    from math import comb

    for n, p in ((64, 0.5), (128, 0.25), (40, 0.2)):
        d = neardup.distance_bound(n, p, 1e-4)
        tail = lambda d: sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(d + 1, n + 1))
        assert tail(d) <= 1e-4 < tail(d - 1)
    assert neardup.distance_bound(64, 0.0) == 0


def test_hot_groups_give_the_same_pairs(spark, monkeypatch):
    rows = [(1, i) for i in range(45)] + [(2, 100), (2, 101), (3, 200), (None, 300), (None, 301)]
    df = spark.createDataFrame(rows, "g int, item bigint")
    want = {(a, b) for g, a in rows for h, b in rows if g is not None and g == h and a < b}
    for limit in (4096, 7):
        monkeypatch.setattr(neardup, "HOT", limit)
        got = [(r.x, r.y) for r in neardup.pairs_within(df, "g", "item", len(rows)).collect()]
        assert len(got) == len(want) and set(got) == want


def edited(rng, ws, changes):
    ws = list(ws)
    for _ in range(changes):
        at = rng.randrange(len(ws))
        rng.choice((lambda: ws.__setitem__(at, f"e{rng.randrange(10**6)}"), lambda: ws.insert(at, f"i{rng.randrange(10**6)}"), lambda: ws.pop(at)))()
    return ws


def test_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    boiler = [f"b{i}" for i in range(400)]
    rows = []
    for g in range(30):
        base = []
        for _ in range(6):
            at = rng.randrange(390)
            base += boiler[at : at + 8] + [f"g{g}w{rng.randrange(10**6)}" for _ in range(12)]
        for v in range(rng.choice((1, 2, 4))):
            rows.append((f"{g:02d}-{v}", " ".join(edited(rng, base, rng.randrange(12)))))
    rows += [(f"copy{i:02d}", rows[0][1].upper().replace(" ", ", ")) for i in range(25)] + [("short", "a b c"), ("null", None)]

    def shingles(t):
        ws = pairs.re.findall("[a-z0-9]+", (t or "").lower())
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 30 else None

    sets = {k: s for k, t in rows if (s := shingles(t))}
    for similarity in (0.5, 0.8):
        want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])}
        df = spark.createDataFrame(rows, "name string, body string").withColumn("key", F.lit(1))
        found = neardup.NearDuplicates(df, F.col("name"), F.col("body"), similarity)
        assert {tuple(r) for r in found.pairs().collect()} == want
    groups = {r.key: r for r in found.groups().collect()}
    assert set(groups) == set(sets) and groups["copy00"].copies >= 25
    for a, b in want:
        assert groups[a].class_id == groups[b].class_id
    empty = neardup.NearDuplicates(df.limit(0), F.col("name"), F.col("body"))
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_groups_of_a_shuffled_chain(spark):
    ids = list(range(-1500, 1500))
    random.Random(1).shuffle(ids)
    e = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a bigint, b bigint").repartition(4)
    nodes = spark.createDataFrame([(i,) for i in [*ids, 5000]], "id bigint")
    got = dict(neardup.components(e, nodes).collect())
    assert len(got) == 3001 and {got[i] for i in ids} == {-1500} and got[5000] == 5000
    with pytest.raises(RuntimeError):
        neardup.components(e, nodes, 2)


# --- packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=40), st.integers(100, 160))
def test_packing_is_valid(sizes, capacity):
    bins, _ = packing.pack(sizes, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
    assert len(bins) <= len(packing.best_fit(sizes, capacity))


def fewest(sizes, capacity):
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


def test_packing_reaches_the_optimum():
    assert len(packing.pack([6, 6, 5, 5, 5, 4, 4, 3, 2], 10)[0]) == 4
    rng = random.Random(7)
    worse = 0
    for _ in range(60):
        sizes = [rng.randint(15, 70) for _ in range(9)]
        worse += len(packing.pack(sizes, 100)[0]) > fewest(sorted(sizes, reverse=True), 100)
    assert worse == 0


def test_large_pools_are_searched():
    rng = random.Random(11)
    sizes = [rng.randint(200, 700) for _ in range(600)]
    bins, _ = packing.pack(sizes, 1000)
    assert sorted(i for b in bins for i in b) == list(range(600)) and all(sum(sizes[i] for i in b) <= 1000 for b in bins)
    assert len(bins) < len(packing.best_fit(sizes, 1000))
    alone, proved = packing.pack([rng.randint(510, 1000) for _ in range(1024)], 1000)
    assert len(alone) == 1024 and proved


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=9), st.integers(60, 90))
def test_bounds_and_proofs_hold(sizes, capacity):
    best = fewest(sorted(sizes, reverse=True), capacity) if sizes else 0
    bins, proved = packing.pack(sizes, capacity)
    assert packing.least_containers(sizes, capacity) <= best <= len(bins)
    assert not proved or len(bins) == best


def test_fillings_are_undominated():
    rng = random.Random(3)
    for _ in range(60):
        sizes = sorted((rng.randint(5, 50) for _ in range(8)), reverse=True)
        got, whole, _ = packing.fillings(list(range(8)), sizes, 70, most=10_000, steps=10_000)
        fits = [c for n in range(9) for c in combinations(range(8), n) if sum(sizes[i] for i in c) <= 70]
        maximal = {tuple(sorted(sizes[i] for i in c)) for c in fits if not any(i not in c and sizes[i] <= 70 - sum(sizes[k] for k in c) for i in range(8))}
        mine = {tuple(sorted(sizes[i] for i in c)) for c in got}
        assert whole and mine <= maximal
        # Each filling can be put into one that is kept.
        assert all(any(packing._fits_into(list(m), list(k)) for k in mine) for m in maximal)


def test_containers(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("revenue", "rose", "2019", "naïve", "漢字")) for _ in range(rng.randrange(1, 120)))) for i in range(900)]
    rows += [(1000, "word " * 1500), (1001, ""), (1002, None), (1003, "漢" * 900)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("container", F.lit("x")).repartition(3)
    got = packing.containers(df, 256).collect()
    texts, held = dict(rows), {}
    for r in got:
        held.setdefault(r.container, []).append(r)
    assert all(sum(r.tokens for r in c) <= 256 for c in held.values())
    for k, text in rows:
        mine = sorted((r for r in got if r.doc_id == k), key=lambda r: r.piece)
        if text is None:
            assert not mine
            continue
        assert "".join(texts[k][r.char_start : r.char_end] for r in mine) == text
        assert len(mine) == 1 or tokens.count(text) > 256
        assert all(r.tokens == tokens.count(text[r.char_start : r.char_end]) for r in mine)
    total = sum(r.tokens for r in got)
    assert total / (256 * len(held)) > 0.97
    assert packing.containers(df.limit(0), 256).count() == 0


# --- leakage


def test_words():
    assert words("Ｎet IN​COME, rose-\nup co-\r\n  operate\nx-y ﬁne") == ["net", "income", "roseup", "cooperate", "x", "y", "fine"]
    assert words(None) == [] and words(" \n") == []
    for text in ("Ｎet IN​COME, rose-\nup", "été co­\noperate", "a_b 1²"):
        assert [w for w, _, _ in word_spans(text)] == words(text)


def test_automaton_against_windows():
    rng = random.Random(4)
    for _ in range(20):
        vocabulary = [f"w{i}" for i in range(rng.choice((2, 4, 30)))]
        passages = [(i, [rng.choice(vocabulary) for _ in range(rng.randrange(2, 30))]) for i in range(6)]
        texts = [[rng.choice([*vocabulary, "other"]) for _ in range(60)] for _ in range(5)] + [passages[0][1] + ["z"] + passages[1][1]]
        least = 4
        automaton = leakage.Automaton(passages, least)
        got = {(t, i) for t, _, s in automaton.stretches(texts) for _, _, state in automaton.matches(s) for i in automaton.held(state)}
        windows = lambda ws: {tuple(ws[k : k + least]) for k in range(len(ws) - least + 1)}
        assert got == {(t, i) for t, ws in enumerate(texts) for i, p in passages if windows(ws) & windows(p)}


def test_leaks_and_cleaning(spark):
    passage = "In February 2015 the board of Acme said that reserves of Beta anticipated prior year growth worth 144,782 in total"
    docs = [(1, "Before. " + passage.upper().replace(" said", " sa​id") + " After."), (2, passage[:40]), (3, None), (4, ""), (5, passage)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("x"))
    items = spark.createDataFrame([(7, passage), (8, "too short"), (9, None), (10, passage), (None, passage)], "item_id bigint, passage string")
    d = d.unionByName(spark.createDataFrame([(None, passage, "x"), (None, passage, "y")], "doc_id bigint, text string, item_id string"))
    assert {tuple(r) for r in leakage.leaked(d, items).collect()} == {(1, 7), (1, 10), (5, 7), (5, 10)}
    assert {tuple(r) for r in leakage.leaked(d, items, most=5).collect()} == {(1, 7), (1, 10), (5, 7), (5, 10)}
    clean = {r.doc_id: r for r in leakage.cleaned(d, items, coverage=0.95).collect()}
    assert clean[1].text == "Before.  After." and clean[5].dropped
    one = sorted(map(tuple, leakage.cleaned(d, items).collect()))
    for most, scan_bytes in ((5, 1 << 30), (5, 1)):  # several automata in one scan, and one a scan
        assert sorted(map(tuple, leakage.cleaned(d, items, most=most, scan_bytes=scan_bytes).collect())) == one
        assert {tuple(r) for r in leakage.leaked(d, items, most=most, scan_bytes=scan_bytes).collect()} == {(1, 7), (1, 10), (5, 7), (5, 10)}
    assert leakage.leaked(d, items.limit(0)).count() == 0 and leakage.leaked(d.limit(0), items).count() == 0
    assert leakage.cleaned(d, items.limit(0)).count() == 0 and leakage.cleaned(d.limit(0), items).count() == 0


# --- subjects


def corpus(rng, n):
    topics = {"mining": "ore shaft drill smelter tailings".split(), "banking": "loan deposit credit interest branch".split(), "airlines": "flight cabin crew fuel fleet".split()}
    filler = "the board reviewed general matters under the plan during this year".split()
    rows = []
    for i in range(n):
        own = rng.sample(sorted(topics), rng.choice((0, 1, 1, 2)))
        lines = []
        for k in range(8):
            pool = topics[own[k % len(own)]] if own and k < 5 else filler
            lines.append(" ".join(rng.choice(pool if rng.random() < 0.5 else filler) for _ in range(10)) + ".")
        rng.shuffle(lines)
        rows.append((i, " ".join(lines), own))
    return rows


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(6)
    rows = corpus(rng, 900)
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000, None), (9001, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, s, "a") for i, _, own in rows[:600] for s in (own or ["none"])], "doc_id bigint, subject string, annotator string")
    names = spark.createDataFrame([("mining",), ("banking",), ("airlines",)], "subject string")
    got = {}
    for r in subjects.assign(d, labels, names).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i, set()) == set(own) for i, _, own in rows[600:])
    assert right / 300 > 0.9
    assert 9000 not in got and 9001 not in got


def test_gradient_is_the_derivative():
    rng = np.random.default_rng(1)
    coded = subjects.Encoded(["a ore shaft. the loan credit here.", None, "one two three."])
    lists, y = coded.word_features(), np.array([[1, 0], [0, 0], [0, 1]], np.float32)
    table, outputs, bias = subjects.initial(2)
    for warm in (False,):
        grads, _ = subjects.gradient((table, outputs, bias), coded, y, lists, warm=warm)
        for k in range(2):
            moved = bias.copy()
            moved[k] += 1e-2
            back = bias.copy()
            back[k] -= 1e-2
            high, low = (subjects.gradient((table, outputs, b), coded, y, lists, warm=warm)[1] for b in (moved, back))
            assert grads[2][k] == pytest.approx((high - low) / 2e-2, rel=0.05, abs=0.05)
    assert rng is not None


def test_nulls_in_any_column(spark):
    """Rows without a key, text or label give a result or none, but no error."""
    texts = spark.createDataFrame([(None, None), (None, "Net income rose. " * 30), (1, None), (1, "Net income rose. " * 30), (1, "Net income rose. " * 30)], "doc_id bigint, text string").withColumn("container", F.lit(1)).withColumn("piece", F.lit("clash"))
    assert packing.containers(texts, 64).where("doc_id is null").count() > 0
    found = neardup.NearDuplicates(texts, F.col("doc_id"), F.col("text"))
    assert found.pairs().count() == 0 and {r.key for r in found.groups().collect()} == {"1"}
    assert splitting.split([("t", texts.select(F.col("doc_id").alias("record_key"), "text"))], CONFIGS).where("record_key is null").count() > 0
    cases = spark.createDataFrame([(None, None, None, None), (None, "What?", None, "answer"), ("a", None, "It rose.", None)], "case_id string, question string, answer string, expected_behavior string")
    assert [r.defect for r in pairs.defective(cases).collect()] == ["empty", "empty"]
    labels = spark.createDataFrame([(None, "mining", "a"), (1, None, "a"), (1, "none", None)], "doc_id bigint, subject string, annotator string")
    names = spark.createDataFrame([("mining",), (None,)], "subject string")
    assert subjects.assign(texts, labels, names, rounds=2).count() >= 0
