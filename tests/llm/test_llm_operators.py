import base64
import random

import numpy as np
import pyarrow as pa
import pytest

from rallyframe.llm import leakage as L
from rallyframe.llm import name_variants as N
from rallyframe.llm import subjects as S
from rallyframe.llm.corpus_encoding import DEFAULT_FOLDER, WORD_PATTERN, ByteBpe, encode_corpus
from rallyframe.llm.graph import connected_components
from rallyframe.llm.nearest_time import nearest_in_time
from rallyframe.llm.pairwise_ranking import rank_items
from rallyframe.llm.text_forms import plain_words

# ---- ranking -----------------------------------------------------------------


def dense_ranking(results, prior=1.0, rounds=500):
    items = sorted({x for pair in results for x in pair})
    n = len(items)
    wins = np.full((n, n), prior / n)
    for w, l in results:
        if w != l:
            wins[items.index(w), items.index(l)] += 1
    o = d = np.ones(n)
    for _ in range(rounds):
        o = wins @ (1 / d)
        d = wins.T @ (1 / o)
    s = o / d
    return dict(zip(items, s / np.exp(np.log(s).mean())))


def test_ranking_equals_dense_sinkhorn(spark):
    rng = random.Random(1)
    skill = {f"i{n}": n for n in range(12)}
    results = []
    for _ in range(150):
        a, b = rng.sample(sorted(skill), 2)
        results.append((a, b) if rng.random() < 1 / (1 + 2 ** (skill[b] - skill[a])) else (b, a))
    results += [("hot", f"i{n % 12}") for n in range(80)] + [("once", "i3"), ("self", "self")]
    frame = spark.createDataFrame([*results, (None, "i1"), ("i1", None)], "winner string, loser string")
    got = rank_items(frame, tolerance=1e-10).collect()
    want = dense_ranking(results)
    assert {r.item for r in got} == set(want)
    assert all(abs(r.strength - want[r.item]) < 1e-6 * want[r.item] for r in got)
    assert sorted(r.place for r in got) == list(range(1, len(want) + 1))
    order = [r.item for r in sorted(got, key=lambda r: r.place)]
    assert order == sorted(want, key=lambda i: (-round(want[i], 9), i))
    assert sum(r.wins for r in got) == len(results)


def test_ranking_of_nothing_and_without_convergence(spark):
    empty = spark.createDataFrame([], "winner string, loser string")
    assert rank_items(empty).count() == 0
    one = spark.createDataFrame([("a", "b"), ("b", "c")], "winner string, loser string")
    with pytest.raises(RuntimeError):
        rank_items(one, tolerance=0.0, max_rounds=1)


# ---- nearest in time ---------------------------------------------------------


def test_nearest_against_all_pairs(spark):
    rng = random.Random(2)
    pick = lambda: rng.choice(["hot"] * 6 + ["b", "c", None])
    left = [(pick(), rng.randrange(0, 10**6) * 2, f"l{n}") for n in range(600)]
    right = [(pick(), rng.randrange(0, 10**6) * 2 + 1, f"r{n}") for n in range(150)]
    left += left[:40] + [("d", 5, "alone"), ("hot", None, "x"), ("hot", 4, None)]
    right += right[:20] + [("e", 5, "alone")]
    schema = "entity string, at bigint, id string, note string"
    l = spark.createDataFrame([(*x, "n") for x in left], schema)
    r = spark.createDataFrame([(*x, "n") for x in right], schema)
    for tolerance in (None, 5000):
        got = {(x.entity, x.left_at, x.left_id): x for x in nearest_in_time(l, r, tolerance).collect()}
        want = {}
        for e, t, i in set(left):
            near = sorted((abs(t - u), u, j) for f, u, j in right if f == e and e and t is not None and i)
            if near and (tolerance is None or near[0][0] <= tolerance):
                want[(e, t, i)] = near[0][0]
        assert {k: abs(k[1] - x.right_at) for k, x in got.items()} == want
    assert nearest_in_time(l, r.where("false"), None).count() == 0
    assert nearest_in_time(l.where("false"), r, None).count() == 0


def test_nearest_ties_take_the_earlier(spark):
    schema = "entity string, at bigint, id string"
    l = spark.createDataFrame([("a", 10, "l")], schema)
    r = spark.createDataFrame([("a", 5, "early"), ("a", 15, "late")], schema)
    assert nearest_in_time(l, r, None).first().right_id == "early"
    same = spark.createDataFrame([("a", 10, "p"), ("a", 10, "q")], schema)
    assert nearest_in_time(l, same, 0).first().right_id == "q"


# ---- components --------------------------------------------------------------


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)]
    edges += [(f"c{n}", f"c{n + 1}") for n in range(30)] + [("hub", f"h{n}") for n in range(50)] + [("s", "s")]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    frame = spark.createDataFrame([*edges, (None, "x"), *edges[:5]], "a string, b string")
    got = {r.node: r.component for r in connected_components(frame).collect()}
    assert got == {x: root(x) for x in list(parent)}
    assert connected_components(frame.where("false")).count() == 0


# ---- names -------------------------------------------------------------------


def jaro_winkler(a, b):
    """By the definition, letter by letter."""
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    ua, ub = [], [False] * len(b)
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not ub[j] and b[j] == c:
                ub[j] = True
                ua.append(c)
                break
    m = len(ua)
    if not m:
        return 0.0
    t = sum(x != y for x, y in zip(ua, [c for c, u in zip(b, ub) if u])) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)
    return jaro + same * 0.1 * (1 - jaro)


def test_jaro_winkler_equals_definition():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 12))) for _ in range(400)]
    pairs = list(zip(words[:200], words[200:])) + [("martha", "marhta"), ("dwayne", "duane"), ("a", "a")]
    got = N.jaro_winkler([p[0] for p in pairs], [p[1] for p in pairs])
    assert np.allclose(got, [jaro_winkler(a, b) for a, b in pairs])


def test_variants_link_to_the_person_meant(spark):
    players = [(1, "Viktor Grönfliuk"), (2, "Kenta Resen"), (3, "Vladimir Klojomtrirova"), (4, "Samuel Baflókzdosner"), (5, "Kenta Resin-Tomlak"), (6, None), (7, "Vladimir Pudrik"), (8, "Ilya Tarnov"), (8, "Ilya Tarnov")]
    known = spark.createDataFrame([(f"p{i}", n) for i, n in players], "entity string, name string")
    linked = spark.createDataFrame(
        [("p3", "Vova Klojomtrirova"), ("p7", 'Vladimir "Vova" Pudrik'), ("p8", "The Quiet Lamp of Tarn"), ("gone", "The Iron Wall"), (None, "x"), ("p1", None)],
        "entity string, name string",
    )
    want = {
        "Grönfliuk, Viktor": "p1", "V. Gronfliuk": "p1", "VIKTOR GRONFLUK": "p1", "(11) Viktor Gr0nfliuk": "p1", "ViktorGronfliuk": "p1", "Viktor Gronfl…": "p1",
        "Kenta Rseen": "p2", "Vova Klojomtrirova": "p3", "Mr. Samuel Baflokzdozner to win": "p4", "Baflókzdosner, 13th seed": "p4", "Samuel BaflÃ³kzdosner": "p4",
        "The Quiet Lamp of Tarn": "p8", "Match Winner": None, "TBD": None, "": None, "  ": None, "Over 22.5 games": None, "The Iron Wall": None, "Viktor Zamlomsek": None, None: None,
    }
    typed = spark.createDataFrame([(n, 1) for n in want] * 2, "name string, entity int")
    got = {r.name: r.entity for r in N.link_variants(typed, known, linked).collect()}
    assert got == {n: e for n, e in want.items() if e}
    assert N.link_variants(typed, known.where("false"), linked).count() == 0
    assert N.link_variants(typed.where("false"), known, linked).count() == 0


# ---- encoding ----------------------------------------------------------------

TEXTS = ["", None, " ", "Hello  world's\n\n end", "aaaaaaaaaaaaaaaaab" * 30, "<|endoftext|> x", "naïve café 日本語 😀😀", "!?" * 400, "x" * 3000, "1234567 12", "\t\r\n "]


def test_encoding_equals_public_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    for name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        with open(f"{DEFAULT_FOLDER}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
        docs = spark.createDataFrame([(n, t, [n]) for n, t in enumerate(TEXTS)], "doc_id bigint, text string, ids array<int>")
        got = {r.doc_id: r.ids for r in encode_corpus(docs, name).collect()}
        assert got == {n: enc.encode_ordinary(t) if t else [] for n, t in enumerate(TEXTS)}
    assert encode_corpus(docs.where("false")).count() == 0


def test_encoding_round_trip_of_random_text():
    bpe = ByteBpe.from_file(f"{DEFAULT_FOLDER}/byte_bpe_50k.tiktoken")
    with open(f"{DEFAULT_FOLDER}/byte_bpe_50k.tiktoken", "rb") as f:
        tokens = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    rng = random.Random(5)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 9000)])) for _ in range(80)) for _ in range(50)]
    offsets, flat = bpe.encode_batch(texts)
    for n, t in enumerate(texts):
        assert b"".join(tokens[i] for i in flat[offsets[n] : offsets[n + 1]]).decode() == t


def test_hot_family_names_are_cut_by_given_names(spark, monkeypatch):
    rng = random.Random(11)
    given = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    given = list(dict.fromkeys(given))
    known = spark.createDataFrame([(f"e{n}", f"{g.title()} Nguyen") for n, g in enumerate(given)], "entity string, name string")
    typed = spark.createDataFrame([(f"NGUYEN, {g.title()}",) for g in given[:20]] + [("N. Nguyen",)], "name string")
    nobody = spark.createDataFrame([], "entity string, name string")
    links = lambda: {r.name: r.entity for r in N.link_variants(typed, known, nobody).collect()}
    whole = links()
    monkeypatch.setattr(N, "HOT_BLOCK", 8)
    assert links() == whole and len(whole) >= 18


def test_hot_blocks_drop_no_pair(spark, monkeypatch):
    rng = random.Random(12)
    given = ["".join(rng.choice("bdglmnrst") + rng.choice("aeiou") for _ in range(2)) for _ in range(24)] + ["Robert", "William", "Mary Ann"]
    family = ["Tarnov", "Termofi", "Tornyf", "Tirmuva", "Tarnovi"]
    known = [(f"e{n}", f"{g.title()} {rng.choice(family)}") for n, g in enumerate(given)] + [("b", "Borisk Tarnov"), ("c", "Bolo Termofi"), ("d", "Bumu Tornyf"), ("t", "Tarnov")]
    typed = [f.format(g=g.title(), i=g[0].upper(), f=family[n % 5]) for n, g in enumerate(given) for f in ("{f}, {g}", "{i}. {f}", "{g}e {f}", "{f}")]
    typed += ["B. Tarnov", "Borsik Tarnov", "Tarnov Borisk X", "Bob Termofi", "Bill Tarnov", "BoriskTarnov", "Bor Tarno..."]
    known = spark.createDataFrame(known, "entity string, name string")
    typed = spark.createDataFrame([(n,) for n in typed], "name string")
    taught = spark.createDataFrame([("b", "The Quiet Lamp")], "entity string, name string")
    links = lambda: {r.name: (r.entity, r.score) for r in N.link_variants(typed, known, taught).collect()}
    whole = links()
    monkeypatch.setattr(N, "HOT_BLOCK", 1)
    assert links() == whole and whole["B. Tarnovi"][0] == "b"


def test_given_names_are_no_nicknames_of_each_other(spark):
    # bearers of "Stefan" are missing from the table, under family names that others bear
    known = [("e1", "Walter Brokmeru"), ("e2", "Walter Dulvanik"), ("e3", "Walter Gastremol"), ("e4", "Stefan Pilkodun")]
    known = spark.createDataFrame(known, "entity string, name string")
    typed = spark.createDataFrame([("Stefan Brokmeru",), ("Stefan Dulvanik",), ("Stefan Gastremol",), ("Stefan Pilkodun",), ("Wally Gastremol",)], "name string")
    got = {r.name: r.entity for r in N.link_variants(typed, known, known.where("false")).collect()}
    assert got == {"Stefan Pilkodun": "e4", "Wally Gastremol": "e3"}


def test_typed_names_link_through_each_other(spark):
    known = spark.createDataFrame([("e1", "Viktor Halmström"), ("e2", "Ana Perekola")], "entity string, name string")
    typed = spark.createDataFrame([("Victor Halmstrom",), ("V Halmstrom",), ("Nobody Atall",)], "name string")
    got = {r.name: r.entity for r in N.link_variants(typed, known, known.where("false")).collect()}
    assert got == {"Victor Halmstrom": "e1", "V Halmstrom": "e1"}
    empty = N.link_variants(typed.where("false"), known, known.where("false"))
    assert empty.count() == 0 and N.link_variants(typed, known.where("false"), known.where("false")).count() == 0


# ---- leakage -----------------------------------------------------------------

FILLER = "the quick summary of an ordinary day at the club with nothing at all to report from any of the courts".split()


def corpus_with_leaks(rng, items):
    docs, truth = [], set()
    for n in range(150):
        words = [rng.choice(FILLER) for _ in range(60)]
        if n % 3 == 0:
            item = rng.choice(sorted(items))
            own = items[item].split()
            part = own if n % 2 else own[5:25]
            if n % 6 == 0:
                k = rng.randrange(3, len(part) - 3)
                part = [*part[:k], part[k][:1] + part[k][2:], *part[k + 1 :]]
            text = " ".join(part)
            text = [text, text.upper(), text.replace(" ", "  "), f"<p>{text}</p>", text.replace("e", "е")][n % 5]
            words[30:30] = text.split(" ")
            truth.add((n, item))
        elif n % 7 == 1:
            words[20:20] = items[rng.choice(sorted(items))].split()[:8]
        docs.append((n, " ".join(words)))
    return docs, truth


def test_leaks_found_and_short_quotes_not(spark):
    rng = random.Random(6)
    syllable = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5)))
    items = {i: " ".join(syllable() for _ in range(35)) for i in range(20)}
    docs, truth = corpus_with_leaks(rng, items)
    asked = [(i, f"Read this. {t}. What is meant by it?", "clash") for i, t in items.items()] + [(90, None, ""), (91, "", ""), (92, "Read this.", "")]
    d = spark.createDataFrame([*[(*x, 1) for x in docs], (900, None, 1), (901, "", 1), (902, " \n", 1)], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(asked, "item_id bigint, text string, doc_id string")
    got = {tuple(r) for r in L.leaked_items(d, i).collect()}
    assert got == {tuple(r) for r in L.leaked_items(d, i, 0).collect()}  # joined by hash, not sent to the scan
    got = {x[:2] for x in got}
    assert len(got & truth) >= 0.97 * len(truth) and not got - truth
    assert L.leaked_items(d, i.where("false")).count() == 0
    assert L.leaked_items(d.where("false"), i).count() == 0


def test_opening_lines_are_counted_over_all_items(spark):
    opening = "Every one of these texts begins with the very same rather long line about nothing of any importance to it."
    items = [(n, f"{opening} {' '.join(f'{c}{n}xq' for c in 'abcdefghijklmnopqrstuvw')}.") for n in range(4)]
    i = spark.createDataFrame(items, "item_id bigint, text string").repartition(4)
    d = spark.createDataFrame([(1, opening), (2, items[2][1])], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in L.leaked_items(d, i).collect()} == {(2, 2)}
    # three items are enough to make it an opening line, two are not
    assert {(r.doc_id, r.item_id) for r in L.leaked_items(d, i.where("item_id < 2")).collect()} == {(1, 0), (1, 1), (2, 0), (2, 1)}


def test_edit_costs_against_plain_table():
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    band = 24
    for _ in range(30):
        p, t, ins, off = word(12), word(20), rng.choice([40, 200, 500]), rng.randrange(5)
        table = [[0] * (len(t) + 1)]
        for c in p:
            row = [table[-1][0] + 100]
            for j, x in enumerate(t):
                row.append(min(table[-1][j] + 100 * (c != x), table[-1][j + 1] + 100, row[-1] + ins))
            table.append(row)
        text = np.full(len(p) + 2 * band, 1, np.uint8)
        text[band - off : band - off + len(t)] = L._codes(t)
        got = L.edit_costs(L._codes(p)[:, None], np.full((len(p), 1), 100), text[:, None], band, ins)[:, 0]
        assert got.tolist() == [min(row) for row in table]


def searched(passage, texts):
    """Which of ``texts`` hold ``passage``, by walks and verification, without Spark."""
    walk = L.WalkHashes()
    letters, first = L.item_windows(passage)
    own = walk(letters, L._starts(passage)[first])
    kept, pairs = [], []
    for n, words in enumerate(texts):
        text, starts = "".join(words), L._starts(words)
        starts = starts[starts <= len(text) - L.WINDOW]
        met = walk(L._codes(text + "\0" * L.STEPS), starts)
        hits = {(int(starts[x]), int(first[y])) for a, b in zip(met, own) for y, h in enumerate(b) for x in np.flatnonzero(a == h)}
        if hits:
            kept.append(n)
            pairs.append(L._meetings(np.array(sorted(hits)), L._starts(passage)))
    work = L.Meetings(["".join(texts[n]) for n in kept], [passage], np.arange(len(kept)), np.zeros(len(kept), np.int64))
    return {kept[p] for p in L.verified(work, pairs)}


def test_sixteen_words_are_found_at_every_start():
    rng = random.Random(9)
    passage = ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(40)]
    foreign = lambda: "".join(rng.choice("hklmnp") for _ in range(rng.randrange(3, 9)))
    for changed in ((3,), (0, 9), (5, 11), (4, 15)):
        docs = []
        for s in range(len(passage) - 15):
            part = passage[s : s + 16]
            for k in changed:
                part[k] = foreign()
            docs.append([*[foreign() for _ in range(20)], *part, *[foreign() for _ in range(20)]])
        assert len(searched(passage, docs)) >= 0.9 * len(docs), changed


def test_alike_passages_are_not_found():
    rng = random.Random(10)
    word = lambda n: "".join(rng.choice("bcdfghklmnprstaeiou") for _ in range(n))
    frame = [word(rng.randrange(2, 8)) for _ in range(40)]
    fill = lambda: [x if k % 5 else word(7) for k, x in enumerate(frame)]
    assert not searched(fill(), [fill() for _ in range(30)])


def test_search_recall_of_slips():
    rng = random.Random(8)
    passage = ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(40)]
    docs = []
    for _ in range(100):
        part = list(passage[8:26])
        for k in rng.sample(range(len(part)), 4):
            part[k] = part[k][:2] + rng.choice("xyz") + part[k][3:]
        docs.append(part)
    assert len(searched(passage, docs)) >= 90


def test_exclusion_bound_never_exceeds_the_alignment():
    rng = random.Random(12)
    passage = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for _ in range(30)]
    for _ in range(20):
        text = [x if rng.random() < 0.7 else "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for x in passage]
        work = L.Meetings(["".join(text)], [passage], np.zeros(1, np.int64), np.zeros(1, np.int64))
        one = lambda w, n, back: work.run(np.array([0]), np.array([w]), np.array([n]), np.array([0]), back)[:, 0].astype(int)
        for s in range(0, 14):
            whole = one(s, 16, False)
            for w in range(s, s + 16):
                assert one(w, w - s, True)[w - s] + one(w, s + 16 - w, False)[s + 16 - w] <= whole[16]
        changed = L.changed_words(whole[:, None] / L.UNIT)[:, 0]
        assert whole[16] / L.UNIT <= changed[16] + L.LONGER * np.floor(changed[16]) + 1e-9


def test_plain_words_undo_altered_writing():
    assert plain_words("Зdö­rk <b>Sa</b>ff- ron  6–2 O’Neil") == ["dork", "saffron", "62", "oneil"]
    assert plain_words("") == []


# ---- subjects ----------------------------------------------------------------

TOPICS = {
    "law": "court judge appeal clause statute ruling lawyer contract tribunal verdict".split(),
    "sport": "serve rally volley match set champion racket smash draw seed".split(),
    "travel": "hotel train station beach breakfast airport guide coast ticket harbour".split(),
}


def topical(rng, subject):
    own = TOPICS[subject]
    return f"The {rng.choice(own)} and the {rng.choice(own)} near {rng.choice(own)} {rng.randrange(99)} made the {rng.choice(own)}."


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(9)
    docs, labels, truth = [], [], set()
    for n in range(400):
        chosen = rng.sample(sorted(TOPICS), rng.choice([1, 1, 2]))
        parts = [topical(rng, s) for s in chosen for _ in range(4)]
        if n % 10 == 0:
            other = next(s for s in sorted(TOPICS) if s not in chosen)
            parts.insert(2, topical(rng, other))
        docs.append((n, " ".join([*parts, "Share this page with a friend."]), "x"))
        if n < 250:
            labels += [(n, s, "t") for s in (chosen if n % 40 else [rng.choice(sorted(TOPICS))])]
        else:
            truth |= {(n, s) for s in chosen}
    docs += [(900, None, ""), (901, "", ""), (902, "  ", ""), (903, "12 34\t56", ""), (904, "Share this page with a friend.", "")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, subject string")
    l = spark.createDataFrame([*labels, (None, "law", ""), (1, None, ""), (5000, "law", "")], "doc_id bigint, subject string, text string")
    s = spark.createDataFrame([(t, "d") for t in TOPICS] + [(None, "")], "subject string, description string")
    got = {(r.doc_id, r.subject) for r in S.document_subjects(d, l, s).where("doc_id >= 250").collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got & truth) >= 0.95 * len(got)
    assert not [x for x in got if x[0] >= 900]
    assert S.document_subjects(d, l.where("false"), s).count() == 0
    assert S.document_subjects(d.where("false"), l, s).count() == 0


def test_sentences_of_awkward_texts():
    assert S.sentences(None) == [] and S.sentences("  ") == [] and S.sentences("1. 2. 3.") == []
    assert S.sentences("<p>One two.</p>\n<p>Three 4.5 five!</p>") == ["One two.", "Three 4.5 five!"]
    assert len(S.sentences("word " * 65)) == 5
