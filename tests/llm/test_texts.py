import os
import pickle
import random
import re

import numpy as np
import pytest

from palatine.llm import bpe, leak_automaton, pii_crf, token_arrays

HERE = bpe.tokenizer_dir()
RANKS = f"{HERE}/byte_bpe_50k.tiktoken"
TEXTS = [
    "Hello world, it's  2 o'clock!\n\n\tTabs", "", None, "é ü ß 食品样本 🍋🧂", "   ", "  x\u0085y", "don't we'll I'm", "<|endoftext|>", "a" * 700, "é" * 300, "!!!!!!!!" * 40,
    "ملح", "x²½ \x1c \x00 end ", "trailing  ", "\r\n\r\nA\r",
]


@pytest.fixture(scope="module")
def ranks():
    if not os.path.exists(RANKS):
        pytest.skip("no tokenizer files")
    return bpe.load_ranks(RANKS)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_bpe(spark, ranks, limit):
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 1)], "doc_id bigint, text string, word int")
    coded = bpe.encode_corpus(df, ranks, words=limit)
    rows = coded.collect()
    assert len(rows) == len(TEXTS)
    assert {r.doc_id: r.ids for r in rows} == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.text for r in bpe.decode_corpus(coded, ranks).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_bpe_empty(spark, ranks):
    assert bpe.encode_corpus(spark.createDataFrame([], "doc_id bigint, text string"), ranks).count() == 0


def test_heap_equals_fold(ranks):
    rng = random.Random(6)
    for _ in range(40):
        w = "".join(rng.choice("abcdeé 1") for _ in range(rng.randint(1, 60))).encode()
        parts = [w[i : i + 1] for i in range(len(w))]
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert bpe.merge_heap(w, ranks) == [ranks[p] for p in parts]


def longest_common_run(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else 0)
        row = new
        best = max(best, max(row))
    return best


@pytest.mark.parametrize("block", [10_000, 30])
def test_leaks(spark, block):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(6)]
    items = [(i, [rng.choice(words) for _ in range(rng.randint(2, 25))]) for i in range(12)]
    docs = []
    for d in range(60):
        t = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        if d % 3 == 0:
            x = rng.choice(items)[1]
            t[3:3] = x[rng.randint(0, 3) :]
        docs.append((d, t))
    dd = spark.createDataFrame([(d, rng.choice([" ", ", ", "--\n"]).join(t).upper()) for d, t in docs] + [(90, None), (91, "")], "doc_id bigint, text string")
    ii = spark.createDataFrame([(i, " ".join(t)) for i, t in items] + [(50, None), (51, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.run for r in leak_automaton.leaked_items(dd, ii, min_words=5, block_words=block).collect()}
    want = {(d, i): n for d, t in docs for i, x in items if (n := longest_common_run(t, x)) >= 5}
    assert got == want


def test_removal_does_not_depend_on_blocks(spark):
    words = [f"w{k}" for k in range(40)]
    items = spark.createDataFrame([(1, " ".join(words[:13])), (2, " ".join(words[5:18]))], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "")], "doc_id bigint, text string")
    for block in (10_000, 13):
        got = {r.doc_id: r for r in leak_automaton.remove_leaks(docs, items, block_words=block).collect()}
        assert got[1].text == " " + " ".join(words[18:]) and got[1].removed_words == 18 and not got[1].dropped
        assert got[2].text is None and got[3].text == "" and not got[2].dropped


def test_remove_leaks(spark):
    item = "one two three four five six"
    docs = [(1, "Before One, two; THREE four five six after and more words here to keep it"), (2, item), (3, "clean text"), (4, None)]
    got = {r.doc_id: r for r in leak_automaton.remove_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(9, item)], "item_id bigint, text string"), min_words=5).collect()}
    assert got[1].text == "Before  after and more words here to keep it" and got[1].removed_words == 6 and not got[1].dropped
    assert got[2].dropped and got[2].text == "" and got[3].text == "clean text" and got[4].text is None


NAMES = [(g, "given") for g in ("Alto", "Berin", "Cora", "Dunja")] + [(f, "family") for f in ("Holm", "Iversen", "Jansky", "Kerr")]


def pii_corpus(n=400):
    """Synthetic notes with their mentions."""
    rng = random.Random(12)
    first, last = ["Alto", "Berin", "Cora", "Dunja", "Edda", "Fenno"], ["Holm", "Iversen", "Jansky", "Kerr", "Lorentz", "Munk"]
    rows, truth = [], {}
    for d in range(n):
        text, spans = "", []
        for _ in range(rng.randint(2, 6)):
            g, f = rng.choice(first), rng.choice(last)
            kind, before, value, after = rng.choice(
                [
                    ("person", "The note was signed ", f"{g} {f}", ". "),
                    ("person", "According to Dr. ", f, ", the lot was fine. "),
                    ("person", "Taster ", f"{g[0]}. {f}", " disagreed. "),
                    ("email", "Write to ", f"{g.lower()}.{f.lower()}@mail.example", " soon. "),
                    ("phone", "Call +", None, " now. "),
                    ("id_number", "On file: passport ", f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", ". "),
                    (None, "Lot ", f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", " of fig tasted sweet. "),
                    ("address", "Samples go to ", f"{rng.randint(1, 99)} {rng.choice(['Elm', 'Oak'])} Street, Norvik", ". "),
                    (None, "The residue of ", "Plum Jam", " smelled of hay. "),
                ]
            )
            if kind == "phone":
                before, value = "Call ", f"+1 {rng.randint(200, 999)} 555 0{rng.randint(100, 199)}"
            if kind:
                spans.append((kind, len(text) + len(before), len(text) + len(before) + len(value)))
            text += before + value + after
        rows.append((d, text))
        truth[d] = set(spans)
    return rows, truth


@pytest.fixture(scope="module")
def field_and_rows(spark):
    rows, truth = pii_corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    field = pii_crf.train_field(docs, spark.createDataFrame(NAMES, "token string, role string"), sample=200)
    return field, rows, truth, docs


def test_mentions(field_and_rows):
    field, rows, truth, docs = field_and_rows
    found = {}
    for r in pii_crf.mentions(docs, field).collect():
        found.setdefault(r.doc_id, set()).add((r.kind, r.start_pos, r.end_pos))
    hit = sum(len(truth[d] & found.get(d, set())) for d in truth)
    made, real = sum(map(len, found.values())), sum(map(len, truth.values()))
    assert hit / real > 0.97 and hit / made > 0.97


def test_redaction_keeps_the_rest(spark, field_and_rows):
    field, rows, _, docs = field_and_rows
    spans = {}
    for r in pii_crf.mentions(docs, field).collect():
        spans.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos, r.kind))
    got = {r.doc_id: r.text for r in pii_crf.redact(docs.unionByName(spark.createDataFrame([(-1, None), (-2, "")], docs.schema)), field).collect()}
    for d, text in rows:
        for s, e, k in sorted(spans.get(d, []), reverse=True):
            text = f"{text[:s]}[{k.upper()}]{text[e:]}"
        assert got[d] == text
    assert got[-1] is None and got[-2] == ""


def test_message_passing_equals_enumeration():
    """Two chains of one token tied by an edge: loopy messages on a tree are exact."""
    import numpy as np

    f = pii_crf.Field({"cora"}, {"holm"})
    f.trans = np.zeros_like(f.trans)
    rng = np.random.default_rng(0)
    u, f.skip = rng.normal(size=(2, 11)), rng.normal(size=(11, 11))
    joint = np.exp(u[0][:, None] + u[1][None] + f.skip)
    chains, m = pii_crf.Chains(np.array([1, 1])), pii_crf.Messages(np.array([0]), np.array([1]))
    got = pii_crf.forward_backward(f.settle(u, chains, m), chains, f.trans)[0]
    assert np.allclose(got, [joint.sum(1) / joint.sum(), joint.sum(0) / joint.sum()], atol=1e-3)


def test_chain_beliefs_equal_enumeration():
    """Node beliefs, the best path and the gradient's chain pairs against all labellings of a chain."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    u, trans = rng.normal(size=(3, 11)), rng.normal(size=(11, 11))
    score = {y: u[range(3), y].sum() + trans[0, y[0]] + trans[y[0], y[1]] + trans[y[1], y[2]] + trans[y[2], 0] for y in itertools.product(range(11), repeat=3)}
    total = sum(map(np.exp, score.values()))
    want = np.zeros((3, 11))
    for y, s in score.items():
        want[range(3), y] += np.exp(s) / total
    chains = pii_crf.Chains(np.array([3]))
    assert np.allclose(pii_crf.forward_backward(u, chains, trans)[0], want)
    assert tuple(pii_crf.viterbi(u, chains, trans)) == max(score, key=score.get)


def test_gradient_is_that_of_the_likelihood():
    """Transitions and bias: the gradient of a text without edges against finite differences."""
    import numpy as np

    f = pii_crf.Field({"cora"}, {"holm"})
    text = "Write to a.b@mail.example or call +1 415 555 0132 now"
    t = pii_crf.Tokens([text])
    part = pii_crf._Part(f, [(text, f.labels(t, t.shaped()))])
    part.prepare(pii_crf.Table(np.zeros(0, np.uint64)))
    part.i = part.j = np.zeros(0, int)
    rng = np.random.default_rng(2)
    f.bias, f.trans = rng.normal(size=11), np.where(f.allowed, rng.normal(size=(11, 11)), -1e4)

    def likelihood():
        out = 0.0
        for start, n in zip(part.chains.start, part.chains.lengths):
            y, x = part.y[start : start + n], f.trans[0] + f.bias
            path = f.trans[0, y[0]] + f.bias[y].sum() + f.trans[y[:-1], y[1:]].sum() + f.trans[y[-1], 0]
            for _ in range(n - 1):
                x = np.logaddexp.reduce(x[:, None] + f.trans, axis=0) + f.bias
            out += path - np.logaddexp.reduce(x + f.trans[:, 0])
        return out

    g, at, h = part.gradient(f), likelihood(), 1e-5
    for name, where in (("bias", 0), ("bias", 3), ("trans", (0, 0)), ("trans", (0, 1)), ("trans", (1, 2)), ("trans", (2, 0))):
        getattr(f, name)[where] += h
        assert abs((likelihood() - at) / h - g[name][where]) < 1e-2
        getattr(f, name)[where] -= h


def test_degenerate_inputs(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "no names"), (None, "x")], "doc_id bigint, text string")
    field = pii_crf.train_field(docs, spark.createDataFrame([], "token string, role string"))
    assert pii_crf.mentions(docs, field).count() == 0
    assert pii_crf.mentions(docs.limit(0), field).count() == 0
    long = "word " * 200_000 + "Write to a.b@mail.example now"
    assert field.decode(long)[-1:] in ([], [("email", long.index("a.b@"), long.index(" now"))])


def test_positions_count_code_points(field_and_rows):
    field = field_and_rows[0]
    text = "🍋🧂 é Write to cora.holm@mail.example soon."
    kind, s, e = field.decode(text)[0]
    assert kind == "email" and text[s:e] == "cora.holm@mail.example"
    assert re.match(r"\w", text[s])


def test_contexts_of_marks_only(spark):
    """Names between marks alone are learned as contexts, and other names are known by them."""
    f = pii_crf.Field({"cora"}, {"holm"})
    f.learn_corpus(spark.createDataFrame([("Fine! - Cora Holm ) * done",)] * 3, "text string"))
    assert ("!", "-") in f.left and (")", "*") in f.right
    t = pii_crf.Tokens(["Sweet! - Zorvik Talmen ) * over", "Sweet - over"])
    spans = f.person_labels(t, t.shaped())
    assert list(spans) == [0] and [t.strings(range(i, j)) for i, j in spans[0]] == [["Zorvik", "Talmen"]]


def test_every_labelled_text_is_trained_in_every_epoch(monkeypatch):
    f, calls = pii_crf.Field({"cora"}, {"holm"}), []
    monkeypatch.setattr(pii_crf._Part, "gradient", lambda self, field, real=pii_crf._Part.gradient: calls.append(len(self.y)) or real(self, field))
    f.train(["Write to cora.holm@mail.example soon."] * 10, epochs=6)
    assert sum(calls) == 6 * 10 * len(pii_crf.Tokens(["Write to cora.holm@mail.example soon."]))


def test_corpus_statistics_cover_all_documents(spark):
    """Names and contexts that only documents outside the sample show are learned."""
    rows = [(i, f"Nothing of note in lot {i}.") for i in range(60)]
    rows += [(100 + i, f"Blend by maker Alto Zorvik for us. Later Cora Zorvik left.") for i in range(3)] + [(200, "Alto Holm and Berin Kerr")]
    docs = spark.createDataFrame(rows + rows, "doc_id bigint, text string")
    field = pii_crf.train_field(docs, spark.createDataFrame(NAMES, "token string, role string"), sample=1)
    assert "zorvik" in field.family and ("by", "maker") in field.left and ("for", "us") in field.right
    assert field.left == {("by", "maker"), (".", "Later")}


def test_counts_flush(spark):
    texts = spark.createDataFrame([("Alto holm alto",)] * 4, "text string")
    f = pii_crf.Field({"alto"}, {"holm"})
    got = {(r.what, r.a, r.b): r.n for r in pii_crf.counted(texts, f.neighbour_counts, held=1).collect()}
    assert got["use", "alto", ""] == 8 and got["capital", "alto", ""] == 4 and got["before family", "alto", "holm"] == 4


def test_distant_repeat():
    """A name that only its title tells is found again where nothing around it tells."""
    import numpy as np

    f = pii_crf.Field({"cora"}, {"holm"})
    o, b, i = (pii_crf.LABELS.index(x) for x in ("O", "B-person", "I-person"))
    dr, stop = (pii_crf.Tokens([w]).low for w in ("Dr", "."))
    one = lambda *n: np.array(n, np.uint64)
    f.table = pii_crf.Table(np.concatenate([pii_crf.mixed(one(15), dr, stop), pii_crf.mixed(one(19), dr, stop, one(pii_crf.CAPITAL))]))  # the two words before; those one further and the own class
    f.weights = np.zeros((3, len(pii_crf.LABELS)), np.float32)
    f.bias[:] = -9
    f.bias[[o, b, i]] = 1, 0, 0
    f.weights[1, b], f.weights[2, i] = 6, 6
    f.skip[np.ix_([o, b, i], [o, b, i])] = [[0.25, -1.5, -1.5], [-1.5, 1.5, 0.7], [-1.5, 0.7, 1.5]]
    f.ready()
    text = "Dr. Zorvik Talmen came. " + "the residue of plum jam smelled of hay and grass " * 4 + "whereas zesty Zorvik Talmens wrote"
    assert [(k, text[s:e]) for k, s, e in f.decode(text)] == [("person", "Zorvik Talmen"), ("person", "Zorvik Talmens")]


def test_forms_that_are_no_shape(field_and_rows):
    field = field_and_rows[0]
    for text, kind, value in [("On file: passport 12-3456-78. ", "id_number", "12-3456-78"), ("Samples go to 7 Elm Terrace, Norvik. ", "address", "7 Elm Terrace, Norvik")]:
        assert not token_arrays.value_spans(text) and [(k, text[s:e]) for k, s, e in field.decode(text)] == [(kind, value)]
    assert field.decode("Lot 12-3456-78 of fig tasted sweet. ") == []


def test_feature_table_is_sent_without_its_empty_slots():
    hashes = np.unique(np.random.default_rng(1).integers(1, 2**63, 5000, dtype=np.uint64))
    table = pii_crf.Table(hashes)
    sent = pickle.dumps(table)
    assert len(sent) < 20 * len(hashes) and len(pickle.dumps(pii_crf.Table(hashes[:0]))) < 1000
    again, other = pickle.loads(sent), np.concatenate((hashes, hashes + np.uint64(1), hashes ^ np.uint64(1 << 40)))
    assert (again.rows(other) == table.rows(other)).all() and again.size == table.size
