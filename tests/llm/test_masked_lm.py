import numpy as np

from wardenlog.llm import masked_lm as M

from .edge import no_documents, odd_documents


def test_probabilities_sum_to_one_and_gradients_match():
    rng = np.random.default_rng(0)
    net = M.Network(classes=3, hidden=3)
    net.p = [p.astype(np.float64) for p in net.p]
    row, at = M.laid_out([rng.integers(0, 27, 9), rng.integers(0, 27, 3)], net.size)
    total = np.zeros(3)
    for t in range(27):
        for j, i in enumerate(at[[0, 4, 10]]):
            other = row.copy()
            other[i] = t
            total[j] += np.exp(net.log_probabilities(other, at[at == i]))[0]
    assert np.allclose(total, 1, atol=1e-5)
    before, squares = [p.copy() for p in net.p], [np.zeros_like(p) for p in net.p]
    taken = net.train(row, at, squares)
    assert taken[len(M.OFFSETS) * 28] == 12 and len(taken) == net.lines() and len(net.spread(taken)) == len(net.vector())
    for i, (p, q) in enumerate(zip(before, squares)):
        where = np.unravel_index(q.argmax(), q.shape)
        net.p = [x.copy() for x in before]
        net.p[i][where] += 1e-4
        up = net.log_probabilities(row, at).sum()
        net.p[i][where] -= 2e-4
        slope = -(up - net.log_probabilities(row, at).sum()) / 2e-4
        assert abs(abs(slope) / 12 ** 0.5 - q[where] ** 0.5) < 2e-3


def test_training_helps_and_scores_follow_the_definition(spark):
    docs = spark.createDataFrame([(i, "one two three four five six seven. " * 30) for i in range(8)], "doc_id int, text string")
    words, net, coded = M.fit(docs, rounds=3, classes=3, hashed=4, hidden=8, batch=64)
    got = M.score(coded, net).collect()
    blank = M.score(coded, M.Network(3, 8)).first()
    assert all(r.pll_per_token > blank.pll_per_token + 1 for r in got)
    row, at = M.laid_out([words.encode(M.tokens("one two three"))], words.pad)
    by_hand = sum(net.log_probabilities(row, at[i:i + 1])[0] for i in range(3))
    short = M.score(M.encode(spark.createDataFrame([(1, "One TWO three")], "doc_id int, text string"), words), net).first()
    assert short.n_tokens == 3 and abs(short.pll - by_hand) < 1e-4


def test_runs_of_a_long_text_see_their_neighbours():
    net = M.Network(3)
    row, at = M.laid_out([np.arange(50) % 27, np.arange(7)], net.size)
    whole = net.log_probabilities(row, at)
    parts = np.concatenate([net.log_probabilities(*p) for p in M.runs(row, at, 8)])
    assert np.allclose(whole, parts, atol=1e-6)
    assert M.laid_out([], net.size)[1].size == 0 and list(M.runs(*M.laid_out([], net.size), 8)) == []


def test_layout_of_the_input_does_not_matter(spark):
    rows = [(i, f"the {i % 5} words of document {i % 3} are here. " * 5) for i in range(40)]
    got = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(parts)
        _, net, coded = M.fit(docs, classes=3, hashed=4, batch=256)
        got.append(sorted((r.doc_id, r.pll) for r in M.score(coded, net).collect()))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-4 for a, b in zip(*got))


def test_defaults_tell_text_from_junk(spark):
    import random

    rnd = random.Random(1)
    subjects, verbs, things = ["the dog", "a child", "my friend", "the old man"], ["sees", "likes", "finds", "takes"], ["a ball", "the red house", "some bread", "two keys"]
    said = lambda: f"{rnd.choice(subjects)} {rnd.choice(verbs)} {rnd.choice(things)} . "
    docs = spark.createDataFrame([(i, "".join(said() for _ in range(40))) for i in range(300)], "doc_id int, text string")
    words, net, _ = M.fit(docs)
    good = "".join(said() for _ in range(20))
    mixed = good.split()
    rnd.shuffle(mixed)
    pair = spark.createDataFrame([(1, good), (2, " ".join(mixed))], "doc_id int, text string")
    a, b = (r.pll_per_token for r in M.score(M.encode(pair, words), net).orderBy("doc_id").collect())
    assert a > b + 1


def test_odd_rows(spark):
    words, net, coded = M.fit(odd_documents(spark), classes=4, hashed=4)
    got = M.score(coded, net).collect()
    assert len(got) == 9 and [(r.n_tokens, r.pll) for r in got if r.doc_id in (1, 2)] == [(0, 0.0)] * 2
    assert M.score(M.encode(no_documents(spark), words), net).count() == 0
    M.fit(no_documents(spark), classes=4, hashed=4)


def test_vocabulary_grows_with_the_text(spark):
    def ids(n):
        rows = [(i, f"word{j % n} ") for i in range(3) for j in range(3 * n)]
        return len(M.vocabulary(spark.createDataFrame(rows, "doc_id int, text string")).ids)

    # All tokens occur equally often: there is room for all of them or for none.
    assert ids(30) == 30
    rows = [(i, " ".join(f"t{j}" for j in range(2000) for _ in range(2000 // (j + 1)))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    small, large = M.vocabulary(docs.filter("doc_id = 0")), M.vocabulary(docs)
    assert 2.5 * len(small.ids) < len(large.ids) and large.classes > small.classes and len(large.ids) > 960


def test_rare_tokens_are_told_apart(spark):
    stems, ends = ("walk", "talk", "jump", "climb", "play"), ("ing", "ed", "er", "ers", "s")
    rows = [(i, "the and of it " * 40 + f"{s}{e} x{s}{e}") for i, (s, e) in enumerate((s, e) for s in stems for e in ends)]
    words, net, _ = M.fit(spark.createDataFrame(rows, "doc_id int, text string"), classes=2, hashed=4)
    tokens = [b"walking", b"waxqzjk"]
    ids = words.encode(tokens)
    # The network cannot tell these, as they begin alike; their spelling does.
    assert ids[0] == ids[1] >= words.size - words.hashed
    good, junk = words.spelled(tokens, ids)
    assert good > junk + 5
    got = M.score(M.encode(spark.createDataFrame([(1, "walking"), (2, "waxqzjk")], "doc_id int, text string"), words), net).collect()
    assert abs(sum(r.pll * (3 - 2 * r.doc_id) for r in got) - (good - junk)) < 1e-4


def test_spelling_shares_out_each_id():
    grams = [(M.START << 18 | 97 << 9 | 98, 3), (97 << 18 | 98 << 9 | 99, 2), (97 << 18 | 98 << 9 | M.END, 1), (98 << 18 | 99 << 9 | M.END, 2)]
    model = M.Spelling(grams, 5)
    assert abs(np.exp(model.pair).sum() - 5) < 1e-9
    known = model.next.shape[1] - 1
    sums = np.exp(model.next[:, :known]).sum(axis=1) + (M.END + 1 - known) * np.exp(model.next[:, known])
    assert np.allclose(sums, 1, atol=1e-5)
    p = 1 / 257
    for n, total in ((2, 5), (2, 3), (2, 3)):
        p = (n + 2 * p) / (total + 2)
    end = model.next[model.code[98] * (known + 1) + model.code[99], model.code[M.END]]
    assert abs(model.log_probabilities([b"z", b"abc"])[1] - (model.pair[97, 98] + np.log(p) + end)) < 1e-5


def test_defaults_train_on_every_place(spark):
    text = " ".join(f"{chr(97 + i)}word" for i in range(16))
    docs = spark.createDataFrame([(i, text) for i in range(4000)], "doc_id int, text string")
    words, net, _ = M.fit(docs, classes=3, hashed=4)
    row, at = M.laid_out([words.encode(M.tokens(text))], words.pad)
    gain = net.log_probabilities(row, at) - M.Network(3).log_probabilities(row, at)
    assert (gain > 1).all()


def test_shares_do_not_follow_the_partitions_of_the_session(spark, monkeypatch):
    """What is sent on grows with the number of shares, which the corpus alone decides."""
    docs = spark.createDataFrame([(i, f"the {i % 5} words of document {i % 3} are here. " * 5) for i in range(60)], "doc_id int, text string")
    _, net, coded = M.fit(docs, classes=3, hashed=4, batch=256)
    frame = type(docs)
    monkeypatch.setattr(frame, "repartition", lambda self, n, *by, f=frame.repartition: f(self, max(n, 23) if by else n, *by))
    words = M.Vocabulary([], 3, 4)
    again = M.train(coded, words, batch=256)
    assert np.array_equal(net.vector(), again.vector())


def test_classes_of_many_places_are_trained_as_those_of_few(monkeypatch):
    rng = np.random.default_rng(2)
    row, at = M.laid_out([rng.integers(0, 27, 4000) ** 2 // 27, np.arange(5)], 27)
    nets = []
    for alone in (1, 64, 10_000):
        monkeypatch.setattr(M, "ALONE", alone)
        net = M.Network(3)
        squares = [np.zeros_like(p) for p in net.p]
        for _ in range(3):
            net.train(row, at, squares)
        nets.append((net.vector(), net.log_probabilities(row, at)))
    assert all(np.allclose(a, b, atol=1e-4) for x in nets[1:] for a, b in zip(nets[0], x))


def test_a_step_is_that_of_each_place_by_itself():
    rng = np.random.default_rng(4)
    net = M.Network(3, 4)
    net.p = [rng.normal(0, 0.5, p.shape) for p in net.p]
    row, at = M.laid_out([rng.integers(0, 27, 400) ** 2 // 27, rng.integers(0, 27, 1)], 27)
    e, b, *steps = before = [p.copy() for p in net.p]
    slopes = [np.zeros_like(p) for p in before]
    for i in at:
        near = [(row[i + o], k) for k, o in enumerate(M.OFFSETS)]
        h = np.append(np.tanh(sum(e[x] for x in near) + b), 1)
        back = np.zeros(5)
        for step, w in enumerate(steps):
            so_far, chosen = divmod(row[i] // 3 ** (2 - step), 3)
            g = np.exp(h @ w[so_far])
            g /= g.sum()
            g[chosen] -= 1
            back += w[so_far] @ g
            slopes[2 + step][so_far] += h[:, None] * g
        back = back[:-1] * (1 - h[:-1] ** 2)
        slopes[1] += back
        for x in near:
            slopes[0][x] += back
    squares = [np.zeros_like(p) for p in net.p]
    net.step(row, at, squares)
    for p, old, q, slope in zip(net.p, before, squares, slopes):
        slope /= len(at) ** 0.5
        assert np.allclose(q, slope ** 2) and np.allclose(p, old - M.RATE * slope / (abs(slope) + 1e-3), atol=1e-6)


def test_every_place_has_a_cell_in_the_line_of_its_kind():
    rng = np.random.default_rng(5)
    kind = np.sort(rng.integers(0, 60, 900) ** 3 // 3600)
    for alone in (None, 1, 50):
        lines = M.Lines(*M.distinct(kind), len(kind), alone)
        of = np.full(lines.cells, -1)
        for kinds, cells, (_, w) in lines.parts:
            of[cells] = np.repeat(lines.kinds[kinds], w)
        assert (of >= 0).all() and (of[lines.cell] == kind).all() and lines.cells < 2 * len(kind)
        assert len(set(lines.cell.tolist())) == len(kind) and (lines.place[lines.cell] == np.arange(len(kind))).all()
        assert (lines.place == len(kind)).sum() == lines.cells - len(kind)


def test_products_of_long_lines_are_added_in_pieces():
    rng = np.random.default_rng(6)
    for k, w in ((5, 1), (3, 8), (1, M.PIECE * 2 + 37), (2, M.PIECE * 4)):
        x, g, out = rng.normal(size=(k, w, 3)), rng.normal(size=(k, w, 5)), np.empty((k, 3, 5))
        M._products(x, g, out)
        assert np.allclose(out, np.einsum("kwa,kwc->kac", x, g))


def test_texts_are_cut_together_as_one_by_one():
    every = "".join(map(chr, range(1, 300)))
    texts = [None, "", " ", "\n", "a", "..a", "a..", "a_b-c--D! Don't", "\u03a3 \u0391\u03a3 \u0130x\u00a0y\x85z\x0b\x0c\x1c!", "a\x00b\x00", every, "a", "\u65e5\u672c \u8a9e,x"]
    for some in ([], [None], ["", "a"], texts, [t for t in texts if t] * 3):
        words, number, n = M.tokens_of(some)
        alone = [M.tokens(t) for t in some]
        assert n.tolist() == [len(t) for t in alone] and [words[i] for i in number.tolist()] == [w for t in alone for w in t]
        assert len(set(words)) == len(words)
