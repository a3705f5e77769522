"""Cases that were once left out, problem by problem."""

import base64
import random

from quarrykit.llm import handwritten as H
from quarrykit.llm import leakage as L
from quarrykit.llm import nearsplit as N
from quarrykit.llm import packing as K
from quarrykit.llm import subjects as U
from quarrykit.llm.alignment import coverage
from quarrykit.llm.secretscan import redact, scan
from quarrykit.llm.wording import canonical, same


# ---- 2
def test_edited_and_small_libraries(spark):
    rng = random.Random(21)
    w = lambda: "".join(rng.choice("abcdefgh") for _ in range(7))
    line = lambda: f"  {w()}({w()}.{w()}, {w()});"
    lib = [line() for _ in range(40)]
    small = "function pad(a, b) {\n" + "\n".join(line() for _ in range(5)) + "\n}\n"
    edited = [x if k % 9 else line() for k, x in enumerate(lib)]
    rows = [(i, f"o{i}/x", "src/util.js", "\n".join(lib)) for i in range(4)] + [(9, "o9/x", "src/a.js", "\n".join(edited))]
    rows += [(20 + i, f"o{i}/x", "src/pad.js", small) for i in range(3)] + [(30, "o9/x", "src/own.js", "\n".join(line() for _ in range(40)))]
    df = spark.createDataFrame(rows, "file_id BIGINT, repo STRING, path STRING, content STRING")
    assert sorted(r.file_id for r in H.not_handwritten(df).collect()) == [0, 1, 2, 3, 9, 20, 21, 22]


# ---- 3
def test_a_slip_copied_often_stays_a_slip(spark):
    repos = spark.createDataFrame([("a/one", "tuning"), ("b/two", "holdout")], "repo STRING, split STRING")
    right = [(i, "a/one", f"Where is the {w} mask updated?") for i, w in enumerate("cache ledger parcel banner locale coupon".split())]
    names = [(40 + i, r, f"Where is the {w} {x} stored?") for i, (r, w, x) in enumerate((r, w, x) for r, w in (("a/one", "parcel"), ("b/two", "parcels")) for x in "tray shelf crate ridge lamp moss".split())]
    slips = [(20 + i, "b/two", "Where is the cache maks updated?") for i in range(8)]
    qs = spark.createDataFrame(right + slips + names, "question_id BIGINT, repo STRING, question STRING")
    sup = spark.createDataFrame([], "support_id BIGINT, repo STRING, claim STRING")
    assert sorted((r.id_a, r.id_b) for r in N.found_pairs(qs, sup, repos).collect()) == [(0, 20 + i) for i in range(8)]


def test_all_sentences_but_remarks_are_compared():
    can = lambda t: canonical(t, frozenset())
    for t in ["Where is X defined? I need this for the audit of tomorrow.", "We are new to all of this here.\nWhere is X defined?", "Where is X defined? Sort answer, please.", "Where is X defined? (see code) Please cite the lines."]:
        assert can(t) == can("Where is X defined?"), t
    first = "The cache mask is dropped once the last reader is gone."
    assert not same(can(first + " The ledger is kept."), can(first + " The parcel is sent."), frozenset(["ledger", "parcel", "kept", "sent"]))
    assert not same(can(first), can(first + "\nThe parcel is sent over."), frozenset())


# ---- 4
def test_joined_pieces_of_any_number_and_length():
    token = "ghp_" + "H6p71aKpLodsh5yxopBhDKzILWRh5VWfwgcH"
    prose = [f"the ledger of row {i} is shown below the table, " for i in range(120)]
    lines = [*prose, "mail it with " + token[:15], token[15:] + " and go on, ", *prose]
    code = "const text =\n  " + " +\n  ".join(f'"{x}"' for x in lines) + ";\n"
    found = scan(code)
    assert [code.count("\n", 0, a) + 1 for a, *_ in found] == [122]
    r = redact(code, found)
    assert token[4:15] not in r and token[15:] not in r and len(r) == len(code) and r.count("ledger") == 240
    key = "hGaLWZooC9YM6LoU46xLK4xwf0bNORDh2dt53oNZ"
    assert scan("x = " + " + ".join(f'"{key[i : i + 8]}"' for i in range(0, 40, 8)))
    assert scan("CFG=" + base64.b64encode(f'{{"api_key": "{token}"}}'.encode()).decode())


# ---- 7
def test_unequal_stretches_of_one_window():
    item = [f"w{i}" for i in range(57)]
    hits = lambda doc: [(d, i) for d in range(len(doc) - 2) for i in range(55) if doc[d : d + 3] == item[i : i + 3]]
    for doc in (item[:12] + ["x"] * 30 + item[12:32], item[:20] + ["x"] * 30 + item[20:32], item[:12] + ["x"] * 12 + item[24:44]):
        assert coverage(item, doc, hits(doc)) == (32, 32)
    swapped = item[12:32] + ["x"] * 30 + item[:12]
    assert coverage(item, swapped, hits(swapped)) == (20, 20)


def test_copied_and_short_passages(spark):
    rng = random.Random(7)
    w = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    long, shorts = w(40), [w(1), w(2), w(3), w(4)]
    items = [(i, "r", "k", long if i % 2 else long.upper() + "!") for i in range(6)] + [(10 + i, "r", "k", t) for i, t in enumerate(shorts)]
    docs = [(1, f"{w(9)} {long} {w(9)}")] + [(2 + i, f"{w(5)} {t}. {w(5)}") for i, t in enumerate(shorts)] + [(9, w(60))]
    p = spark.createDataFrame(items, "item_id BIGINT, repo STRING, kind STRING, text STRING")
    got = L.found(spark.createDataFrame(docs * 2, "doc_id BIGINT, text STRING"), p).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, i) for i in range(6)] + [(2 + i, 10 + i) for i in range(4)]


def test_no_leak_has_fewer_seeds_than_needed(spark):
    """Half of a passage in two stretches, one word in eight changed: always more seeds than are asked for."""
    rng = random.Random(8)
    for n in (20, 33, 57, 84, 200):
        item = [f"v{i}" for i in range(n)]
        for _ in range(40):
            cut, half = rng.randint(0, n // 2), -(-n // 2)
            held = [x if k % 8 != 4 else "zz" for k, x in enumerate(item[cut : cut + half + half // 7])]
            at = rng.randint(0, len(held))
            doc = held[:at] + ["other"] * 30 + held[at:]
            own = {tuple(item[i : i + 3]) for i in range(n - 2)}
            assert sum(tuple(doc[i : i + 3]) in own for i in range(len(doc) - 2)) >= L.least_seeds(n) or sum(x in item for x in held) < half


# ---- 6
def test_dominated_fillings():
    bits = lambda *xs: sum(1 << x for x in xs)
    assert K.dominated((3, 4), 2, bits(8)) and K.dominated((3, 4), 2, bits(5)) and K.dominated((3, 4), 0, bits(7)) and not K.dominated((3, 4), 0, bits(5, 6)) and not K.dominated((9,), 1, bits(4, 3)) and K.dominated((9,), 3, bits(3))
    sizes = [60, 45, 44, 36, 30, 20, 11]
    count = dict.fromkeys(sizes, 1)
    got = K.completions(100, sizes, count, 100)
    assert (60, 30) not in got and all(sum(c) <= 100 for c in got) and sum(got[0]) == 100


def test_long_texts_are_cut_in_linear_time():
    import time

    class Words:
        calls = 0

        def encode(self, text, add_special_tokens=False):
            import re
            import types

            Words.calls += len(text)
            spans = [m.span() for m in re.finditer(r"\s?\S+|\s", text)]
            return types.SimpleNamespace(ids=spans, offsets=spans)

    text = " ".join(f"w{i}" for i in range(120_000))
    began = time.time()
    cut = K.cut_points(text, Words(), 100)
    assert [a for a, _, _ in cut][1:] == [b for _, b, _ in cut][:-1] and cut[0][0] == 0 and cut[-1][1] == len(text) and max(n for *_, n in cut) <= 100
    assert Words.calls <= 4 * len(text) and time.time() - began < 20 and len(cut) == 1_200


# ---- 8
def test_verified_links_and_clamped_seeds(spark):
    rng = random.Random(5)
    vocab = {s: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(10)] for s in ("law", "music")}
    sent = lambda s: "We {} the {} before any {} of it.".format(*rng.sample(vocab[s], 3))
    docs = [(i, " ".join(sent(("law", "music")[i % 2]) for _ in range(8))) for i in range(60)] + [(90, "Nothing else is alike here, quixotic zephyrs wander."), (91, None)]
    labels = [(i, ("law", "music")[i % 2]) for i in range(16)] + [(17, "law"), (90, "music")]  # 17 is about music: a wrong label
    d = spark.createDataFrame(docs, "doc_id BIGINT, text STRING")
    lab = spark.createDataFrame(labels, "doc_id BIGINT, subject STRING")
    ev = spark.createDataFrame([], "item_id BIGINT, text STRING")
    names = ["law", "music"]
    nodes, total = U.graph_nodes(d, ev, lab, names)
    links = [(r.node // 2, r.other // 2, r.weight) for r in U.links(nodes).collect()]
    assert total == 61 and links and all(w >= U.COSINE**2 for *_, w in links) and sum(a % 2 == b % 2 for a, b, _ in links) >= 0.97 * len(links)
    state = {}
    for r in U.propagated(nodes, lab, names).collect():
        state.setdefault(r.node // 2, {})[r.subject] = r.mass
    assert all(state[i][("law", "music")[i % 2]] >= 1 for i in range(16))  # a seed keeps its label
    assert state[17].get("music", 0) > 0.5 and list(state[90]) == ["music"]
    assert all(max(state[i], key=state[i].get) == ("law", "music")[i % 2] for i in range(18, 60))
    got = {}
    sub = spark.createDataFrame([("law", ""), ("music", "")], "subject STRING, description STRING")
    for r in U.document_subjects(d, lab, sub, ev).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert all(got[i] == {("law", "music")[i % 2]} for i in range(60)) and 91 not in got  # a wrong label does not come out


def test_all_pairs_of_like_documents_are_linked(spark, monkeypatch):
    """Every pair that meets the threshold, whatever its sentences begin with; what passes over the links is that of the rows."""
    rng = random.Random(11)
    contents = [sorted(rng.sample(range(40), rng.randint(1, 9))) for _ in range(60)] + [[]]
    contents[50:56] = [contents[3]] * 6  # copies
    nodes = spark.createDataFrame([(2 * i, c) for i, c in enumerate(contents)], "node BIGINT, content ARRAY<BIGINT>")
    cosine = lambda a, b: len(set(a) & set(b)) / (len(a) * len(b)) ** 0.5 if a and b else 0.0
    want = {(2 * i, 2 * j): cosine(a, b) ** 2 for i, a in enumerate(contents) for j, b in enumerate(contents) if i != j and cosine(a, b) >= U.COSINE}
    state = {(2 * i, s): rng.random() for i in range(0, 61, 2) for s in rng.sample(["law", "music", "sport"], 2)}
    given = spark.createDataFrame([(n, s, m) for (n, s), m in state.items()], "node BIGINT, subject STRING, mass DOUBLE")
    got = {}
    for (i, j), w in want.items():
        for s in ("law", "music", "sport"):
            got.setdefault(i, {}).setdefault(s, 0.0)
            got[i][s] += w * state.get((j, s), 0.0)
    shares = {(i, s): m / sum(by.values()) for i, by in got.items() for s, m in by.items() if m >= U.KEPT * sum(by.values()) > 0}
    for block in (U.BLOCK, 7):
        monkeypatch.setattr(U, "BLOCK", block)
        rows = U.links(nodes).collect()
        assert len(rows) == len(want) and all(abs(want[r.node, r.other] - r.weight) < 1e-12 for r in rows)
        near = U.alike(nodes)
        for wanted in (None, given):
            mine = {(r.node, r.subject): r.mass for r in U._passed(near, given, ["law", "music", "sport"], wanted).collect()}
            some = shares if wanted is None else {k: m for k, m in shares.items() if any(k[0] == n for n, _ in state)}
            assert mine.keys() == some.keys() and all(abs(mine[k] - m) < 1e-9 for k, m in some.items())
