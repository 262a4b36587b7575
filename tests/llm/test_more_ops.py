import math
import random
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tessera.llm import embedding_dedup, minhash, packing, token_files, toxicity
from tessera.llm.common import scratch
from tessera.llm.components import components

from .corpus import awkward, empty, frame, sentence


def ids_of(name, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["two  spaces", " leading", "trailing ", "tab\there", "nb sp x", "a　b c", "é ́x", "it's they'll we 've 's", "<|endoftext|> <|startoftext|>", "a<|endoftext|>b c", "ends <|endoftext|>", "a <|EndOfText|> b <|startoftext|>c", "<|endoftext| >", "1 23 4,5.6", "line\nbreak and\n\nmore", "x \ny", "ﬁ ΑΣ ΣΑΣ İ ß", "😀 a😀 b", "a​b c﻿d"]


@pytest.mark.parametrize("file, end, lead", [("word_bpe_49k.json", 1, False), ("byte_bpe_50k.json", 0, True)])
def test_encoder_equals_the_tokenizer(file, end, lead):
    import pyarrow as pa

    from tessera.llm import tokens

    texts = ODD + [t or "" for _, t in awkward(docs=10)] + ["", " "]
    enc = tokens.encoder(public_tokenizers.path(file), lead)
    for _ in range(2):
        ids, offsets = tokens.with_end(*enc.encode(pa.array(texts)), end)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == ids_of(file, texts, end)


def test_encoder_when_it_forgets(monkeypatch):
    import pyarrow as pa

    from tessera.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    for texts in (["a b c d e f g h", "b c"], ["x y z a", "b"], ["q"]):
        ids, offsets = enc.encode(pa.array(texts))
        assert [[*ids[a:b].tolist(), 0] for a, b in zip(offsets, offsets[1:])] == ids_of("byte_bpe_50k.json", texts, 0)


def test_token_files(spark):
    rows = awkward() + [(3000 + i, t) for i, t in enumerate(ODD)]
    folder = scratch(spark) + "/tokens-test"
    index = token_files.write_tokens(frame(spark, rows), folder, public_tokenizers.path("word_bpe_49k.json"), 1)
    got = token_files.read_tokens(spark, folder).collect()
    ids = ids_of("word_bpe_49k.json", [t for _, t in rows], 1)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), crc(x)) for (i, _), x in zip(rows, ids))
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])])[:-1].tolist()
    order = [-(2**63) if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    assert index["tokens"] == sum(map(len, ids)) and index["bytes_per_id"] == 2
    assert sum(len(token_files.open_array(folder, p["name"] + ".tokens", "<u2")) for p in index["parts"]) == index["tokens"]


def test_packing(spark):
    rows = awkward() + [(4000 + i, sentence(random.Random(i), random.Random(i).randint(1, 900))) for i in range(300)]
    got = packing.pack(frame(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = Counter()
    for (i, _), ids in zip(rows, ids_of("byte_bpe_50k.json", [t for _, t in rows], 0)):
        first = (len(ids) - 1) % 2048 + 1
        begins = [0, *range(first, len(ids), 2048)]
        for k, (a, b) in enumerate(zip(begins, [*begins[1:], len(ids)])):
            want[i, k, a, b - a, crc(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_packing([(r.sequence_id, r.offset, r.length) for r in got], 2048)


def check_packing(rows, capacity):
    by = defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    assert len(by) >= -(-sum(n for _, _, n in rows) // capacity)
    return len(by)


def optimum(sizes, capacity):
    """The least number of sequences, by search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[i]:
                rooms.remove(r)
                rooms.append(r - sizes[i])
                go(i + 1, rooms)
                rooms.remove(r - sizes[i])
                rooms.append(r)
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


def test_plan_uses_all_pieces_and_its_reduction_is_safe():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 20, 31])
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        runs = packing.plan(dict(Counter(sizes)), capacity)
        used = Counter()
        for pattern, times in runs:
            assert sum(pattern) <= capacity and times > 0
            for x in pattern:
                used[x] += times
        assert used == Counter(sizes)
        # what the reduction fixes, with a best packing of the rest, is a best packing
        left, fixed = packing._Left(dict(Counter(sizes))), 0
        for length in sorted(left.n, reverse=True):
            while left.n.get(length) and (one := packing._dominant(left, length, capacity)):
                times = left.times(one)
                for x in one:
                    left.take(x, times)
                fixed += times
        rest = [x for x, n in left.n.items() for _ in range(n)]
        assert fixed + (optimum(rest, capacity) if rest else 0) == optimum(sizes, capacity)
        assert sum(t for _, t in runs) <= optimum(sizes, capacity) + 1


def test_toxicity_finds_rare_expressions(spark):
    rng = random.Random(8)
    common = ["".join(rng.choice("abcdefghijklmn") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, marks = [], []
    for i in range(900):
        words = [rng.choice(common) for _ in range(rng.randint(20, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(words) // 25)):
                words[rng.randrange(len(words))] = "zwurx" + rng.choice(common)
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    labels = spark.createDataFrame([*marks[:600], (None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows + [(5000, None), (5001, ""), (None, "zwurxaa " * 9)]), labels).collect()}
    held = [(got[i].predicted, t) for i, t in marks[600:]]
    assert sum(p == t for p, t in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert got[None].predicted == 1 and got[5000].score == got[5001].score


def test_toxicity_without_labels(spark):
    got = toxicity.toxicity(frame(spark, awkward(docs=5)), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(got) == len(awkward(docs=5)) and all(r.score == 0 and r.predicted == 0 for r in got)


class PlainKneserNey:
    """The two models in plain Python: dictionaries of counts, and a recursion over shorter contexts."""

    def __init__(self, words, toxic, ordinary, order=8, discount=0.75):
        self.order, self.discount = order, discount
        self.count = [Counter(), Counter()]
        for word, *weights in zip(words, toxic, ordinary):
            text = b"\0" * (order - 1) + word.encode() + b"\1"
            for i in range(order - 1, len(text)):
                for c, w in zip(self.count, weights):
                    c[text[i - order + 1 : i + 1]] += w
        # lower orders: how many different letters stand before
        kinds = {g for c in self.count for g, n in c.items() if n}
        self.lower = {}
        for k in range(order - 1, 0, -1):
            self.lower[k] = Counter(g[1:] for g in kinds)
            kinds = set(self.lower[k])

    def shared(self, context, letter):
        k = len(context) + 1
        here = {g: n for g, n in self.lower[k].items() if g[:-1] == context}
        below = self.shared(context[1:], letter) if k > 1 else 1 / 256
        if not here:
            return below
        total = sum(here.values())
        return max(here.get(context + letter, 0) - self.discount, 0) / total + self.discount * len(here) / total * below

    def p(self, which, context, letter):
        here = {g: n for g, n in self.count[which].items() if g[:-1] == context and n}
        below = self.shared(context[1:], letter)
        if not here:
            return below
        total = sum(here.values())
        return max(here.get(context + letter, 0) - self.discount, 0) / total + self.discount * len(here) / total * below


def test_kneser_ney_equals_a_plain_one():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(25)})
    toxic, ordinary = ([rng.choice([0, 0, 1, 2, 5]) for _ in words] for _ in "ab")
    toxic = [t or (not o) for t, o in zip(toxic, ordinary)]  # each word is in one of the two at least
    models = toxicity.Models(pa.array(words), np.array(toxic, float), np.array(ordinary, float))
    plain = PlainKneserNey(words, toxic, ordinary)
    contexts = {g[:-1] for c in plain.count for g, n in c.items() if n}
    for context in sorted(contexts)[:40]:
        for which in (0, 1):  # probabilities over all letters
            assert sum(plain.p(which, context, bytes([x])) for x in range(256)) == pytest.approx(1)
    for gram, ratio in zip(models.grams.tolist(), models.gram_ratio.tolist()):
        g = gram.to_bytes(8, "big")
        assert ratio == pytest.approx(math.log(plain.p(0, g[:-1], g[-1:]) / plain.p(1, g[:-1], g[-1:])), abs=1e-5)
    # a letter that neither class has after a known context, and a context that neither knows
    known = sorted(contexts)[3]
    new = next(bytes([x]) for x in range(97, 123) if all(not c[known + bytes([x])] for c in plain.count))
    at = np.searchsorted(models.contexts, int.from_bytes(known, "big"))
    assert models.context_ratio[at] == pytest.approx(math.log(plain.p(0, known, new) / plain.p(1, known, new)), abs=1e-5)
    got = models.ratios(pa.array([*words, "zzzzzzzzzzzz"]))
    for word, ratio in zip(words, got.tolist()):
        text = b"\0" * 7 + word.encode() + b"\1"
        want = sum(math.log(plain.p(0, text[i - 7 : i], text[i : i + 1]) / plain.p(1, text[i - 7 : i], text[i : i + 1])) for i in range(7, len(text)))
        assert ratio == pytest.approx(want, abs=1e-4)


def test_toxicity_learns_from_rare_words(spark):
    # every word of the picked documents counts, however many there are
    rows = [(i, f"common words here and {'vile' if i % 2 else 'kind'}{i} once") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    models, _ = toxicity.fit(frame(spark, rows), labels)
    learned = [f"{'vile' if i % 2 else 'kind'}{i}" for i in range(300)]
    known = models.ratios(pa.array(learned))
    assert sum((r > 0) == (i % 2 == 1) for i, r in enumerate(known)) >= 190 and len(models.grams) > 400


def brute_groups(n, links):
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(x) for x in range(n)]


@pytest.mark.parametrize("at_once", [2_000_000, 7])
def test_components(spark, at_once):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)] + [(600, i) for i in range(601, 700)] + [(3, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(5), at_once).collect()}
    want = brute_groups(700, links)
    assert all(want[k] == v for k, v in got.items())
    assert set(got) == {x for a, b in links for x in (a, b) if a != b}


def brute_embeddings(rows):
    unit = []
    for _, v in rows:
        ok = v and None not in v and all(map(math.isfinite, v)) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    return links


@pytest.mark.parametrize("options", [{}, {"cell_points": 30, "block_points": 16}, {"cell_points": 60, "block_points": 1000}])
def test_embeddings(spark, options):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        v = rng.normal(size=8)
        if i % 3 == 0 and i:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(size=8) * rng.choice([0, 0.05, 0.2])
        rows.append((i * 2, [float(np.float32(x)) for x in v]))
    rows += [(1001, None), (1003, [0.0] * 8), (1005, [1.0, None]), (1007, [float("nan")] * 8), (1009, [float("inf")] + [0.0] * 7), (1011, []), (1013, [1.0, 2.0]), (1015, [2.0, 4.0]), (4, rows[0][1]), (None, rows[0][1]), (1017, [1e-300] * 8), (1019, [1e300] * 8)]
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, point int, cell int, unit int")
    got = embedding_dedup.link(df, **options).collect()
    rows = [(i, [x / max(map(abs, v)) for x in v] if v and None not in v and all(map(math.isfinite, v)) and any(v) else v) for i, v in rows]
    links = brute_embeddings(rows)
    degree = Counter(x for pair in links for x in pair)
    low = lambda x: -(2**63) if x is None else x
    group = brute_groups(len(rows), links)
    least = {}
    for k, g in enumerate(group):
        least[g] = min(least.get(g, 2**63), low(rows[k][0]))
    want = Counter((low(rows[k][0]), degree[k], least[group[k]]) for k in range(len(rows)))
    assert Counter((low(r.vec_id), r.n_links, low(r.component_id)) for r in got) == want
    assert all(r.kept == (low(r.vec_id) == low(r.component_id)) for r in got)
    assert embedding_dedup.dedup_embeddings(df, **options).columns == df.columns


def test_embeddings_lose_no_link_in_a_subspace(spark):
    # 64 dimensions that hold 4: a difference lies along a plane's normal far more than 1 / sqrt(64) of it
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 4)) @ rng.normal(size=(4, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert embedding_dedup._fit(x, 60, math.sqrt(0.2) / 2) is not None  # more cells than one
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.link(df, cell_points=50).collect()}
    assert [got[i] for i in range(3000)] == ((x @ x.T >= 0.9).sum(axis=1) - 1).tolist()


@pytest.mark.parametrize("dim, inner, noise", [(256, 4, 0.01), (256, 8, 0.05), (384, 16, 0.02)])
def test_embeddings_of_many_cells_lose_no_link(spark, dim, inner, noise):
    # wide vectors near a narrow subspace, as learned ones are
    rng = np.random.default_rng(dim + inner)
    x = rng.normal(size=(2500, inner)) @ rng.normal(size=(inner, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    other = x[rng.permutation(1250)]
    x[1250:] = x[:1250] + 0.45 * (other - (other * x[:1250]).sum(axis=1)[:, None] * x[:1250])  # partners, a little below and above the threshold
    x += rng.normal(size=x.shape) * noise / math.sqrt(dim)
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = embedding_dedup.spherical_kmeans(x, 40)
    reach = math.sqrt(0.2) / 2
    home, i, cell = embedding_dedup._cells(x, c, reach)
    held = np.zeros((len(x), len(c)), bool)
    held[i, cell] = True
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    assert len(a) > 100 and len(set(home.tolist())) >= 20
    assert (held[a, home[b]] | held[b, home[a]]).all()  # each near pair meets in the home of one of the two


def test_embeddings_of_many_lengths(spark):
    rng = np.random.default_rng(4)
    rows = []
    for dim in range(2, 30):
        for _ in range(60):
            rows.append((len(rows), rng.normal(size=dim).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.link(df, cell_points=4).collect()}
    degree = Counter(x for pair in brute_embeddings(rows) for x in pair)
    assert got == {i: degree[i] for i, _ in rows}


def test_embeddings_choose_cells_by_work(spark):
    x = np.random.default_rng(9).normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert embedding_dedup._fit(x, 40, math.sqrt(0.2) / 2) is None  # copies would cost more than one cell saves


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rng = random.Random(6)
    for _ in range(1500):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 14))]
        b = [x if rng.random() < 0.8 else rng.choice("abc") for x in a if rng.random() < 0.9] + [rng.choice("abc") for _ in range(rng.randint(0, 3))]
        d = distance(a, b)
        for most in (0, 1, 2, 3, 5, 20):
            assert minhash.banded_distance(a, b, most) == (d if d <= most else None)


@pytest.mark.parametrize("block", [1000, 7])
def test_near_groups_of_a_common_passage(spark, monkeypatch, block):
    # one sketch that all of them share: a pair's two texts are neither the group's first ones nor beside one another
    rng = random.Random(31)
    monkeypatch.setattr(minhash, "BLOCK", block)
    passage = sentence(rng, 150)
    rows = []
    for i in range(120):
        words = (passage + " " + sentence(rng, 50)).split(" ")
        copy = list(words)
        for at in rng.sample(range(len(words)), 6):
            copy[at] = f"edit{rng.random()}"
        rows += [(i, " ".join(words)), (1000 + i, " ".join(copy))]
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in minhash.near_groups(frame(spark, rows), k=5, sketches=2).collect()}
    by = dict(rows)
    texts = {i: t.split() for i, t in rows}
    k = lambda w: np.frombuffer(minhash.order_sketches(*minhash._labelled(minhash.Words(pa.array([" ".join(w)])), 5), 2, 2).tobytes(), np.uint64)
    shared = [i for i in range(120) if (k(texts[i]) == k(texts[1000 + i])).any()]
    assert len(shared) > 20 and len(by) == 240
    assert [i for i in shared if got[i] != got[1000 + i]] == []


def test_rows_of_a_large_group_grow_in_proportion(spark, monkeypatch, tmp_path):
    # texts that share a passage and are not similar: each goes to a bounded number of places
    rng = random.Random(33)
    passage, screen, sent = sentence(rng, 150), minhash._open, {}
    texts = [passage + " " + sentence(rng, 60) for _ in range(320)]
    monkeypatch.setattr(minhash, "BLOCK", 4)
    for n in (160, 320):
        folder = tmp_path / str(n)
        folder.mkdir()

        def counted(similarity, folder=str(folder)):
            run = screen(similarity)

            def rows(table):
                with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as f:
                    f.write(str(table.num_rows))
                return run(table)

            return rows

        monkeypatch.setattr(minhash, "_open", counted)
        got = minhash.near_groups(frame(spark, list(enumerate(texts[:n]))), k=5, sketches=2).collect()
        assert all(r.doc_id == r.class_id for r in got) and len(got) == n
        sent[n] = sum(int(f.read_text()) for f in folder.iterdir())
    assert 1000 < sent[160] and sent[320] < 2.6 * sent[160]


@pytest.mark.parametrize("words, edits", [(200, 40), (200, 30), (200, 20), (60, 12), (45, 9), (20, 4), (9, 1), (5, 1)])
def test_near_groups_finds_scattered_edits(spark, words, edits):
    # similarity 0.80, 0.85, 0.90 of long texts, and short texts of 0.8 or a little more
    rng = random.Random(words + edits)
    rows = []
    for i in range(100):
        text = [f"{''.join(rng.choice('abcdeghilmnoprstu') for _ in range(5))}{i}" for _ in range(words)]
        copy = list(text)
        for at in [words // 2] if edits == 1 else rng.sample(range(words), edits):
            copy[at] = f"edit{rng.random()}"
        rows += [(i, " ".join(text)), (1000 + i, " ".join(copy))]
    got = {r.doc_id: r.class_id for r in minhash.near_groups(frame(spark, rows)).collect()}
    assert sum(got[i] == got[1000 + i] for i in range(100)) >= 99


def test_screen_loses_nothing():
    rng = random.Random(32)
    texts = []
    for _ in range(300):
        a = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 40))]
        b = [x if rng.random() < 0.85 else rng.choice("abcdefghijklmnop") for x in a if rng.random() < 0.95] or ["a"]
        texts += [a, b]
    w = minhash.Words(pa.array([" ".join(x) for x in texts]))
    bags = minhash._bags(w)
    ok = minhash._may_be_near(w.counts[::2], bags[::2], w.counts[1::2], bags[1::2], 0.8)
    near = [distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in zip(texts[::2], texts[1::2])]
    assert not (np.array(near) & ~ok).any() and 50 < sum(near) <= ok.sum() < 300


def test_near_groups(spark):
    rng = random.Random(12)
    rows = [(i, t) for i, t in awkward(docs=40)]
    shared = sentence(rng, 60)
    for i in range(60):
        words = sentence(rng, rng.randint(60, 300)).split(" ")
        rows.append((5000 + 10 * i, " ".join(words)))
        for k in range(i % 4):
            copy = list(words)
            for _ in range(max(1, len(copy) // 50)):
                copy[rng.randrange(len(copy))] = f"edit{rng.random()}"
            rows.append((5001 + 10 * i + k, " ".join(copy)))
    rows += [(7000 + i, shared + " " + sentence(rng, 150)) for i in range(40)]  # a passage is no near copy
    got = minhash.near_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    low = lambda x: -(2**63) if x is None else x
    texts = [(t or "").split() for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] or "") == (rows[j][1] or "") or texts[i] and texts[j] and len(texts[i]) < 5000 and len(texts[j]) < 5000 and min(len(texts[i]), len(texts[j])) >= 0.8 * max(len(texts[i]), len(texts[j])) and len({*texts[i]} & {*texts[j]}) > 0.5 * len({*texts[i]}) and distance(texts[i], texts[j]) <= 0.2 * max(len(texts[i]), len(texts[j]))]
    group = brute_groups(len(rows), links)
    least = {}
    for k, g in enumerate(group):
        least[g] = min(least.get(g, 2**63), low(rows[k][0]))
    want = Counter((low(rows[k][0]), least[group[k]]) for k in range(len(rows)))
    assert Counter((low(r.doc_id), low(r.class_id)) for r in got) == want
    df = frame(spark, rows)
    out = minhash.dedup_near(df)
    assert out.columns == df.columns
    assert {low(r.doc_id) for r in out.collect()} == set(least.values())


def test_empty_tables(spark):
    e = empty(spark)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert toxicity.toxicity(e, labels).count() == 0
    assert packing.pack(e, path).count() == 0
    assert minhash.near_groups(e).count() == 0
    assert embedding_dedup.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    folder = scratch(spark) + "/tokens-empty"
    assert token_files.write_tokens(e, folder, path, 0)["parts"] == []
    assert token_files.read_tokens(spark, folder).count() == 0


def test_long_near_copies_take_little_memory():
    import tracemalloc

    rng = random.Random(44)
    a = [f"w{rng.randrange(40_000)}" for _ in range(120_000)]
    b = list(a)
    for at in rng.sample(range(len(b)), 60):
        b[at] = "edit"
    tracemalloc.start()
    assert minhash.banded_distance(a, b, len(a) // 5) == 60
    # no copies: the widest band is tried, too
    assert minhash.banded_distance(a[:20_000], [f"v{x}" for x in range(20_000)], 4_000) is None
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def test_long_banded_distance():
    rng = random.Random(45)
    for _ in range(20):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(900, 2300))]
        b = [x if rng.random() < 0.97 else rng.choice("abcdefgh") for x in a if rng.random() < 0.98]
        b[500:500] = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        d, most = minhash.banded_distance(a, b, 3000), len(a) // 4
        small = minhash._banded(a, b, d)
        assert small == d and minhash._banded(a, b, d - 1) is None and minhash._banded(a, b, most) == d
