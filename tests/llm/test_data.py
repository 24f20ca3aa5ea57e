"""Sharding, preference formatting, packing, decontamination, toxicity, personal data."""

import math
import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from small import frame

from turnsift.llm import decontaminate, packing, pii, toxicity
from turnsift.llm.preference import format_pairs, next_in_order, pairs_from_turns
from turnsift.llm.queries import tokenizer_files
from turnsift.llm.sharding import shard_documents


def test_sharding(spark, docs, rows, none):
    hot = rows + [(2000 + k, "the same text") for k in range(300)] + [(None, "z"), (None, "z")]
    got = shard_documents(frame(spark, hot), 8).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in hot)
    slots, size = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    most = max(len((t or "").encode()) + 1 for _, t in hot)
    assert max(size.values()) - min(size[k] for k in range(8)) <= 2 * most
    assert shard_documents(none).collect() == []


def test_preference(spark):
    pairs = [
        (1, [("user", "hi"), ("assistant", "a")], [("user", "hi"), ("assistant", "bb")]),
        (2, [("user", "x")], [("user", "x")]),
        (3, [], [("user", None)]),
        (4, [("user", "p"), ("assistant", "q")], [("system", "p")]),
        (5, None, None),
    ]
    turn = "array<struct<role:string,text:string>>"
    got = {r["pair_id"]: r for r in format_pairs(spark.createDataFrame(pairs, f"pair_id long, chosen {turn}, rejected {turn}")).collect()}
    one = got[1]
    assert one["n_prompt_turns"] == 1 and one["prompt"] == "<|user|>\nhi<|end|>\n"
    (a, b) = one["chosen_mask"][0]
    assert one["chosen"][a:b] == "a<|end|>\n" and one["rejected"][one["rejected_mask"][0][0] :].startswith("bb")
    assert got[2]["chosen"] == got[2]["rejected"] == "" and got[2]["n_prompt_turns"] == 1
    assert got[3]["n_prompt_turns"] == 0 and got[3]["rejected"] == "<|user|>\n<|end|>\n"
    assert got[4]["n_prompt_turns"] == 0 and got[4]["rejected_mask"] == []
    assert got[5]["prompt"] == ""


def test_pairs_from_turns(spark):
    rows = [(1, 0, "user", "u"), (1, 1, "assistant", "x"), (2, 0, "user", "v"), (2, 1, "assistant", None), (2, 2, "user", "w"), (3, 0, "user", "only"), (None, 0, "user", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in pairs_from_turns(turns).collect()}
    assert set(got) == {1, 2}
    assert [t["text"] for t in got[1]["rejected"]] == ["u", ""] and [t["text"] for t in got[2]["rejected"]] == ["v", "x", "w"]
    assert pairs_from_turns(turns.filter("false")).collect() == []


def test_pairs_of_odd_conversations(spark):
    """Ties of turn, repeated rows, clashing columns, a very long text, an outlying id."""
    rows = [(1, 0, "user", "u"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (5, 0, "assistant", "x" * 2_000_000), (2**60, 0, "assistant", "far"), (7, None, None, "t"), (7, 1, "assistant", "z")]
    turns = spark.createDataFrame([(*r, 1, "k") for r in rows], "conv_id long, turn long, role string, text string, g int, at string").repartition(3)
    got = {r["pair_id"]: r for r in pairs_from_turns(turns).collect()}
    assert [t["text"] for t in got[1]["chosen"]] == ["u", "a", "a", "b"] and len(got[1]["rejected"][3]["text"]) == 2_000_000
    assert got[5]["rejected"][0]["text"] == "z" and got[7]["rejected"][1]["text"] == "far" and got[2**60]["rejected"][0]["text"] == "b"
    shown = {r["pair_id"]: r for r in format_pairs(spark.createDataFrame(list(got.values()))).collect()}
    assert shown[7]["prompt"] == "<||>\nt<|end|>\n" and shown[1]["n_prompt_turns"] == 3
    twice = format_pairs(spark.createDataFrame([got[1], got[1]])).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_next_in_order(spark):
    ids = sorted({*range(0, 600, 7), 2**40, 2**40 + 1, -5})
    rows = spark.createDataFrame([(k, f"v{k}") for k in ids], "k long, v string").repartition(4)
    got = dict(map(tuple, next_in_order(rows, "k", "v", ranges=16).collect()))
    assert got == {k: f"v{n}" for k, n in zip(ids, [*ids[1:], ids[0]], strict=True)}


def best_fit(sizes, capacity):
    """How many bins best fit takes, longest first."""
    rooms = []
    for s in sorted(sizes, reverse=True):
        fit = min((r for r in rooms if r >= s), default=None)
        if fit is None:
            rooms.append(capacity - s)
        else:
            rooms[rooms.index(fit)] -= s
    return len(rooms)


@pytest.mark.parametrize("fast", [True, False])
def test_packing(spark, rows, none, fast):
    from tokenizers import Tokenizer

    files = tokenizer_files()
    odd = [(3000, "two  spaces \n and   three \n"), (3001, " lead"), (3002, "<|endoftext|> x"), (3003, "tail "), (3004, "it's\r\n\r\n  we'll  go　 on"), (None, "z")]
    own = rows + odd
    whole = Tokenizer.from_file(files["tokenizer"])
    want = {t: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for _, t in own}
    some = files if fast else {"tokenizer": files["tokenizer"]}
    got = packing.pack_documents(frame(spark, own), capacity=256, keep_ids=True, **some).collect()
    pieces, bins = Counter(), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(ids) == r["length"] <= 256
        pieces[r["doc_id"], r["piece"], r["start"], tuple(ids)] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    expected = Counter()
    for d, t in own:
        ids = want[t]
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            expected[d, k, a, tuple(ids[a:b])] += 1
    assert pieces == expected
    for v in bins.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 256
    assert len(bins) <= best_fit([r["length"] for r in got], 256)
    assert packing.pack_documents(none, **some).collect() == []


def test_plan_is_no_worse_than_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(30):
        cap = int(rng.integers(5, 40))
        sizes = rng.integers(1, cap + 1, int(rng.integers(1, 80)))
        plan = packing.Plan(np.bincount(sizes, minlength=cap + 1), cap)
        made = Counter()
        for times, items in plan.bins:
            assert sum(items) <= cap
            for s in items:
                made[s] += times
        assert made == Counter(sizes.tolist())
        assert plan.sequences <= best_fit(sizes.tolist(), cap)


@pytest.mark.parametrize("most", [500_000, 3])
def test_decontamination(spark, docs, rows, none, most):
    text = dict(rows)
    items = [(1, " ".join((text[40] or "").split()[:14])), (2, "One, TWO"), (3, "é"), (None, "of the"), (4, None), (5, "..."), (10, (text[4] or "").upper()), (10, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench, 10, most=most)
    assert sorted(((r[0], r[1], r[2], r[3]) for r in out.collect()), key=repr) == brute.contaminated(rows, items)
    for r in out.collect():
        assert sum(h["words"] for h in r["hits"]) == r["n_hit"]
    assert decontaminate.decontaminate(none, bench).collect() == []
    assert all(r["n_hit"] == 0 for r in decontaminate.decontaminate(docs, bench.filter("false")).collect())


def test_decontamination_carries_columns(spark, docs):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench, carry=tuple(docs.columns))
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == docs.count()


def test_toxicity(spark, none):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    bad = ["grumple", "snorfid", "blarghen"]
    rows, labels = [], []
    for k in range(600):
        w = list(rng.choice(words, 40))
        toxic = int(k % 6 == 0)
        if toxic:
            w[5] = rng.choice(bad) + rng.choice(["", "s", "ly"])
        rows.append((k, " ".join(w)))
        if k % 2 == 0:
            labels.append((k, 1, toxic))
    labels += [(0, None, None), (10**9, 0, 1), (None, 0, 1)]
    docs = frame(spark, [*rows, (None, None), (601, "")])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, table, max_rows=250)
    got = {r["doc_id"]: r["p_toxic"] for r in toxicity.score(docs, chain).collect()}
    held = [k for k in range(600) if k % 2]
    assert len(got) == 602
    assert np.mean([got[k] >= 0.5 for k in range(600) if k % 6 == 0]) > 0.9
    assert np.mean([got[k] >= 0.5 for k in held]) < 0.02
    assert toxicity.score(none, chain).collect() == []
    bare = toxicity.train(docs, table.filter("false"))
    assert max(r["p_toxic"] for r in toxicity.score(docs, bare).collect()) < 1e-9


def test_the_chain_wins_where_one_category_tells_of_another(spark):
    """The second label follows the first, but few rows have it: words alone can't learn
    it from those, the first category's probability can."""
    rng = np.random.default_rng(5)
    signs = ["".join(rng.choice(list("ghijklmnop"), 7)) for _ in range(120)]
    rows, labels = [], []
    for k in range(1200):
        low = k % 3 == 0
        w = [f"w{x}" for x in rng.integers(0, 400, 25)]
        if low:
            w[3], w[9], w[15] = rng.choice(signs, 3)
        rows.append((k, " ".join(w)))
        if k % 2:
            labels.append((k, 0 if low else 1, int(low) if k % 10 == 1 else None))
    docs, table = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    right = {}
    for linked in (True, False):
        chain = toxicity.train(docs, table, linked=linked)
        assert (chain.links[1][0] > 1) == linked
        got = {r["doc_id"]: r["p_toxic"] >= 0.5 for r in toxicity.score(docs, chain).collect()}
        right[linked] = np.mean([got[k] for k in range(0, 1200, 6)])
        assert np.mean([got[k] for k in range(1200) if k % 3 and k % 2 == 0]) < 0.05
    assert right[True] > 0.9 and right[True] > right[False] + 0.2


def test_word_models_agree_with_newton():
    """The accelerated fit against a plain Newton solution of the same objective."""
    rng = np.random.default_rng(6)
    dense = rng.random((200, 12)) < 0.3
    y = (dense[:, 0] | dense[:, 1] & (rng.random(200) < 0.8)).astype(float)
    row, at = np.nonzero(dense)
    x = toxicity._Rows(at.astype(np.int32), row.astype(np.int32), 200, 12)
    w, b = toxicity._words(x, y, np.ones(200, bool), steps=3000, least=0.0)
    ones, c1, c0 = y.sum(), y @ dense, (1 - y) @ dense
    scale = np.log((c1 + 1) / (ones + 2)) - np.log((c0 + 1) / (200 - ones + 2))
    a = np.column_stack((dense * scale, np.ones(200)))
    best = toxicity._newton(a, y, np.array([1.0] * 12 + [0.0]), np.zeros(13))
    assert np.allclose(np.append(w, b), np.append(best[:-1] * scale, best[-1]), atol=2e-3)
    assert np.allclose(x.dot(np.arange(12.0)), dense @ np.arange(12.0)) and np.allclose(x.back(y), y @ dense)


def test_the_chain_by_plain_loops(spark):
    """score() against dictionaries of weights; the earlier probability that a text passes
    on is that of a model fitted without the texts of its fold, copies included."""
    rng = random.Random(31)
    vocab = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(12)) + " drab" * (k % 3 == 0) + " vile" * (k % 7 == 0)) for k in range(150)]
    rows += [(200 + k, t) for k, t in rows[:20]] + [(300, None), (301, " ".join(vocab) * 40)]
    labels = [(k, int(k % 3 != 0), int(k % 7 == 0)) for k in range(150)]
    docs, table = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, table)
    texts = {k: (t or "").encode() for k, t in rows}
    places = {k: next(toxicity.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))).tolist() for k, t in texts.items()}
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", toxicity.fold_of(F.coalesce("text", F.lit(""))).alias("f")).collect()}
    assert all(fold[200 + k] == fold[k] for k in range(20))

    def chance(z):
        return 1 / (1 + math.exp(-z))

    want = {}
    for k, at in places.items():
        own, passed, later = (sum(float(chain.table[a, c]) for a in at) for c in (0, 2 + fold[k], 1))
        e = chance(passed + chain.fold_biases[0][fold[k]])
        want[k] = chance(own + chain.biases[0]), chance(later + chain.links[1][0] * e + chain.biases[1])
    got = {r["doc_id"]: (r["p_low_quality"], r["p_toxic"]) for r in toxicity.score(docs, chain).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in got)
    # the same model without the fold, up to the common scale
    at = [(a, k) for k in range(150) for a in places[k]]
    x = toxicity._Rows(np.array([a for a, _ in at], np.int32), np.array([k for _, k in at], np.int32), 150, 1 << toxicity.BITS)
    y, out = np.array([1.0 - q for _, q, _ in labels]), np.array([fold[k] for k in range(150)])
    full = toxicity._words(x, y, np.ones(150, bool))[0]
    big = np.abs(full).argmax()
    for part in range(toxicity.FOLDS):
        w = toxicity._words(x, y, out != part)[0] * (chain.table[big, 0] / full[big])
        assert np.allclose(chain.table[:, 2 + part], w, atol=1e-4)


def test_toxicity_bounds_and_odd_tables(spark):
    """Several label rows and texts of an id, a long text, the two bounds, dotted names."""
    rows = [(k, f"{'grumple' if k % 4 == 0 else 'plain'} word{k}") for k in range(80)]
    labels = [(k, 1, int(k % 4 == 0)) for k in range(80)]
    more = [(0, "other text"), (0, rows[0][1]), (200, "grumple " * 300_000)]
    table = spark.createDataFrame(labels + [(0, 0, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + more).withColumn("a.b", F.lit(1)).withColumn("p_toxic", F.lit("x"))
    held = toxicity.labelled_features(docs, table, ["quality", "toxic"], 50).collect()
    assert len(held) == 50 and len({r["_id"] for r in held}) == 50
    assert {r["_y1"] for r in held if r["_id"] == 0} <= {1}
    chain = toxicity.train(docs, table)
    got = [(r["doc_id"], r["p_toxic"] >= 0.5) for r in toxicity.score(docs, chain).collect()]
    assert len(got) == 83 and (200, True) in got and (1, False) in got
    assert toxicity.score(docs, chain, carry=("doc_id", "a.b")).columns == ["doc_id", "a.b", "p_low_quality", "p_toxic"]
    few = toxicity.train(docs, table, max_entries=40)  # five rows or so
    assert np.isfinite(few.table).all()


PERSONAL = [
    (1, "mail a@b.co_x@y.zz then +1 (552) 555-3899 and 4111 1111 1111 1111."),
    (2, "ip 1.2.3.4.5 and 999.1.1.1 and 010.0.0.255"),
    (3, "call 555-123-4567 now, password=e3b0c44298fc1c149afb"),
    (4, "version: 1.2.3.4 card 4111-1111-1111-1112 +123 456"),
    (5, "é" * 10 + " x@y.example.com " + "1" * 40),
    (6, None),
    (7, ""),
    (8, "0" * 3000 + "@x." + "y." * 2000),
    (9, "5555555555554444" * 3),
    (None, "q@r.st"),
    (1, "another text of the same id: z@z.zz"),
]


def test_personal_data(spark, none):
    docs = frame(spark, PERSONAL + PERSONAL[:1])
    got = sorted(((r["doc_id"], r["base"]) for r in pii.find_personal_data(docs).collect()), key=repr)
    assert got == sorted(((d, brute.base_spans(t)) for d, t in PERSONAL + PERSONAL[:1]), key=repr)
    for r in pii.find_personal_data(docs).collect():
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert set(filter(None, r["base"].split(","))) <= {":".join(s) for s in spans}
        wide = [s for s in spans if s[0] in pii.KINDS[4:]]
        for kind, a, b in wide:
            assert all(int(y) <= int(a) or int(b) <= int(x) for k, x, y in spans if (k, x, y) != (kind, a, b))
        assert [int(s[1]) for s in spans] == sorted(int(s[1]) for s in spans)
    assert pii.find_personal_data(none).collect() == []


def test_redaction_of_spans(spark):
    docs = frame(spark, PERSONAL)
    got = {(r["doc_id"], r["lang"]): r["text"] for r in pii.redact_personal_data(docs).filter("doc_id <> 1").collect()}
    assert pii.redact_personal_data(docs).columns == docs.columns
    assert got[6, None] is None and got[7, None] == ""
    assert got[5, None] == "é" * 10 + " [email] " + "1" * 40
    assert "999.1.1.1" in got[2, None] and "[ip]" in got[2, None]


def test_long_secrets_are_whole(spark):
    key = "a1B2c3D4" * 60
    name = "service_" * 6 + "token"
    texts = [f"set token={key} and go", f"set {name}={key[:24]} and go", f"token={key},{name}={key * 2000}"]
    got = [
        sorted((r["start"], r["stop"]) for r in pii.candidates(frame(spark, [(1, t)])).filter(F.col("ord") == pii.KINDS.index("secret")).collect())
        for t in texts
    ]
    first = len(f"token={key}")
    assert got == [[(4, 4 + first)], [(4, 4 + len(name) + 25)], [(0, first), (first + 1, len(texts[2]))]]
    masked = [r["text"] for r in pii.redact_personal_data(frame(spark, [(k, f"set token={key} and go") for k in range(30)])).collect()]
    assert set(masked) == {"set [secret] and go"}


def test_the_classifier_admits_secrets_and_leaves_look_alikes(spark):
    """Planted secrets in many forms, none of a base kind, beside assignments that only
    look like them; the count of admitted spans per kind."""
    rng = np.random.default_rng(8)
    hexa = lambda n: "".join(rng.choice(list("0123456789abcdef"), n - 1)) + "a1"[n % 2]
    mixed = lambda n: "".join(rng.choice(list("ABCDEFabcdefXYZxyz0123456789"), n - 2)) + "q7"
    secret = [lambda: f'token = "{hexa(40)}"', lambda: f"password={mixed(20)}", lambda: f"api_key : '{mixed(32)}'", lambda: f'"client_secret": "{mixed(24)}"', lambda: f"access_key => {mixed(20)}"]
    other = [lambda: f"commit = {hexa(40)}", lambda: f"sha256: {hexa(64)}", lambda: "note: important", lambda: "https://example.com/a1b2c3d4e5f6", lambda: "date = 2024-01-02T03:04:05", lambda: "path = /usr/lib/x86_64", lambda: f"total = {rng.integers(10**12, 10**13)}", lambda: "call f(x)=function(a1,b2)"]
    rows, planted = [], {}
    for k in range(300):
        body = (secret[k % 5] if k % 2 else other[k // 2 % 8])()
        rows.append((k, f"some words here {body} and more words"))
        planted[k] = k % 2 == 1
    rows += [(400 + k, f"mail person{k}@example.com or +1 (555) 555-{1000 + k}") for k in range(50)]
    found = Counter()
    hit = Counter()
    for r in pii.find_personal_data(frame(spark, rows)).collect():
        kinds = [s.split(":")[0] for s in r["spans"].split(",") if s]
        found.update(kinds)
        if r["doc_id"] in planted:
            hit[planted[r["doc_id"]], "secret" in kinds] += 1
    assert hit[True, True] >= 0.9 * 150 and hit[False, True] == 0
    assert found["email"] == 50 and found["phone"] == 50 and found["secret"] == hit[True, True]
    # and the text around them is kept, with the quotes
    masked = {r["doc_id"]: r["text"] for r in pii.redact_personal_data(frame(spark, rows)).collect()}
    assert masked[5] == 'some words here [secret]" and more words' and masked[0] == rows[0][1]


def test_no_python_on_the_native_path(spark):
    plan = pii.find_personal_data(frame(spark, PERSONAL))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_expectation_maximisation_finds_the_reliable_labeler():
    counts = [((2, 2, 2, 2), 300), ((1, 1, 0, 1), 500), ((2, 2, 1, 0), 60), ((1, 1, 2, 0), 60)]
    post, table = pii.estimate(counts)
    assert post[2, 2, 1, 0] > 0.5 > post[1, 1, 2, 0]
    assert table[0][1][2] > table[2][1][2]


def test_personal_data_counts_by_kind(spark):
    text = "a@b.com c@d.org 1.2.3.4, 4111 1111 1111 1111; e@f.net"
    [r] = pii.find_personal_data(frame(spark, [(1, text)])).collect()
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (3, 1, 1, 0)
