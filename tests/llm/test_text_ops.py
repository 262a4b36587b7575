import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import blocks, line_dedup, lm_scoring, mixing, quality, suffix_dedup

from .corpus import awkward, empty, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_lines(rows, least_chars=40, least_docs=5):
    key = lambda x: re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    low = -(2**63)
    holds = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holds[key(x)].add(low if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= least_chars and len(holds[key(x)]) >= least_docs and max(holds[key(x)]) != (low if i is None else i))]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup(spark):
    rows = awkward()
    got = line_dedup.line_digests(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute_lines(rows)
    assert sum(r.n_dropped for r in got) > 5


def test_line_dedup_hot_line_over_many_partitions(spark):
    rng = random.Random(3)
    hot = "this very line is in every single document of the table"
    rows = [(i, f"{hot}\nown line number {i} that is long enough to be a key of its own\n{rng.random()}") for i in range(3000)]
    rows += [(i, hot) for i in range(500)]
    got = line_dedup.line_digests(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute_lines(rows)


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_line_stream_keeps_its_state_over_batches(batch):
    import pyarrow as pa

    rng = random.Random(batch)
    rows = sorted(((rng.randint(0, 6), 0, rng.randint(0, 9)) for _ in range(200)), key=lambda r: (r[0], r[1], -r[2]))
    table = pa.RecordBatch.from_pylist([{"h1": a, "h2": b, "doc_id": d, "text_hash": 0, "places": [0]} for a, b, d in rows], schema=line_dedup._LINES)
    out = [x for y in line_dedup._stream(5)(iter([table.slice(k, batch) for k in range(0, len(rows), batch)])) for x in y.to_pylist()]
    goes = Counter((x["h1"], x["doc_id"]) for x in out if x["kind"] == line_dedup._GOES)
    want = Counter()
    edges = {rows[0][0], rows[-1][0]}
    for h in {r[0] for r in rows} - edges:
        ids = [d for a, _, d in rows if a == h]
        if len(set(ids)) >= 5:
            want.update((h, d) for d in ids if d != max(ids))
    assert {k: v for k, v in goes.items() if k[0] not in edges} == want
    counts = {x["h1"]: x["text_hash"] for x in out if x["kind"] == line_dedup._COUNT}
    assert counts == {h: len({d for a, _, d in rows if a == h}) for h in edges}


def test_dedup_lines_keeps_columns(spark):
    rows = awkward()
    df = frame(spark, rows)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    digests = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect())
    assert digests == Counter({(k[0], k[3]): 0 for k in brute_lines(rows)} | Counter([(k[0], k[3]) for k in brute_lines(rows).elements()]))


def brute_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    c = Counter(zip(w, w[1:], w[2:]))
    cover = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark):
    rng = random.Random(5)
    rows = awkward() + [(5000 + i, "word one two three\n" * 30 + "# | $ %" * 5) for i in range(3)]
    marks = []
    for i in range(150):
        good = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(120))
        bad = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) + "$$$" for _ in range(120))
        rows += [(10_000 + i, good), (20_000 + i, bad)]
        marks += [(10_000 + i, 1), (20_000 + i, 0)]
    labels = spark.createDataFrame([*marks, (None, 1), (10_000, None), (10_001, 1)], "doc_id long, quality int")
    df = frame(spark, rows)
    got = quality.quality(df, labels).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r.doc_id, *(r[c] for c in names)) for r in got) == Counter((i, *brute_statistics(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id: r.kept for r in got}
    assert sum(kept[10_000 + i] for i in range(150)) >= 145
    assert sum(kept[20_000 + i] for i in range(150)) <= 5
    filtered = quality.filter_quality(df, labels)
    assert filtered.columns == df.columns
    assert Counter(r.doc_id for r in filtered.collect()) == Counter(r.doc_id for r in got if r.kept)


def path_length(rows, row, depth, limit, forest, node):
    """A walk down one tree, and what a leaf of several rows still stands for."""
    if forest.feature[node] < 0:
        n = len(rows)
        rest = 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
        assert n <= 1 or depth == limit or all((r == rows[0]).all() for r in rows)
        return depth + rest
    f, s = forest.feature[node], forest.split[node]
    side = int(row[f] >= s)
    return path_length([r for r in rows if (r[f] >= s) == bool(side)], row, depth + 1, limit, forest, forest.child[node] + side)


@pytest.mark.parametrize("rows, subsample", [(300, 64), (40, 256), (3, 2), (1, 4)])
def test_forest_scores_are_plain_path_lengths(rows, subsample):
    import numpy as np

    rng = np.random.default_rng(rows)
    grown, other = rng.normal(size=(rows, 5)), rng.normal(size=(20, 5)) * 3
    forest = quality.Forest(grown, np.full(5, 0.3), 12, subsample, 1)
    leaf = quality._mean_path(2**forest.depth)
    for given, grew in ((other, False), (grown, True)):
        want = []
        for i, row in enumerate(given):
            paths = [path_length(list(grown[taken]), row, 0, forest.depth, forest, root) for root, taken in zip(forest.roots, forest.taken) if not grew or i not in set(taken.tolist())]
            want.append(2.0 ** (-(sum(paths) / max(len(paths), 1)) / max(leaf, 1e-9)))
        assert forest.score(given, grew) == pytest.approx(np.array(want))


def test_quality_verdict_on_rows_it_has_not_seen(spark):
    rng = random.Random(15)
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 3
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) + ("#" * rng.randint(1, 3) if bad and rng.random() < 0.5 else "") for _ in range(rng.randint(60, 200))]
        rows.append((i, " ".join(words)))
        marks.append((i, int(not bad)))
    labels = spark.createDataFrame([(i, q) for i, q in marks if i % 3], "key long, good int")
    df = frame(spark, rows)
    got = {r.doc_id: r.kept for r in quality.quality(df, labels.withColumnsRenamed({"key": "doc_id", "good": "quality"})).collect()}
    held = [(got[i], q) for i, q in marks if i % 3 == 0]
    assert sum(k for k, q in held if q) >= 0.97 * sum(q for _, q in held)
    assert sum(not k for k, q in held if not q) >= 0.9 * sum(not q for _, q in held)
    renamed = df.withColumnRenamed("doc_id", "key")
    same = {r.doc_id: r.kept for r in quality.quality(renamed, labels, id_col="key", label_col="good").collect()}
    assert same == got


def test_quality_learns_from_all_labels(spark):
    # the only bad rows are the last ones by the hash of their ids, of more rows than a driver would sample
    from pyspark.sql import functions as F

    ids = spark.range(20_200).toDF("doc_id")
    last = [r.doc_id for r in ids.orderBy(F.xxhash64("doc_id").desc()).limit(100).collect()]
    labels = ids.withColumn("quality", (~F.col("doc_id").isin(last)).cast("int"))
    words = "transform(sequence(1, 60), i -> substr(md5(cast(doc_id * 60 + i as string)), 1, 3 + cast(pmod(hash(doc_id, i), 6) as int)))"
    df = labels.select("doc_id", F.expr(f"concat_ws(if(quality < 1, '$$ ', ' '), {words})").alias("text"))
    for got in (quality.quality(df, labels).filter("kept"), quality.filter_quality(df, labels)):
        kept = {r.doc_id for r in got.select("doc_id").collect()}
        assert not kept & set(last) and len(kept) >= 0.98 * 20_100


@pytest.mark.parametrize("marks", [[(0, 1), (1, 0)], [(0, 1), (2, 1), (1, 0)], [(1, 0)], [(0, 1)]])
def test_quality_of_few_labels(spark, marks):
    rows = [(i, " ".join(f"word{j * (i + 3)}" + "$" * (i % 2) for j in range(80))) for i in range(6)]
    got = quality.quality(frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    assert len(got) == 6 and all(r.kept for r in got if not r.doc_id % 2)


def test_quality_of_long_text(spark):
    rng = random.Random(3)
    text = "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(2500))
    got = quality.quality(frame(spark, [(1, text), (1, text)]), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in got] == [brute_statistics(text)] * 2


def test_quality_without_labels_keeps_what_the_rules_keep(spark):
    rows = awkward()
    got = quality.quality(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert all(r.kept != r.base_failed for r in got)


def brute_fill(sizes, weights, cap):
    """Targets by sharing again and again."""
    total, left, target = float(sum(sizes)), set(range(len(sizes))), {}
    while left:
        share = (total - sum(target.values())) / sum(weights[i] for i in left)
        over = {i for i in left if share * weights[i] >= cap * sizes[i]}
        if not over:
            return [target[i] if i in target else share * weights[i] for i in range(len(sizes))]
        target |= {i: float(cap * sizes[i]) for i in over}
        left -= over
    return [target[i] for i in range(len(sizes))]


def test_mixing_targets_and_taken(spark):
    rows = awkward() + [(9000 + i, "w " * (i % 40)) for i in range(300)]
    got = mixing.mix(frame(spark, rows, ("s0", "big", None, "s2", "big", "big", "zz"))).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(WORD.findall(t or ""))) for i, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = brute_fill([sum(r["size"] for r in by[s]) for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], 3)
    for s, t in zip(order, want):
        assert by[s][0].target == pytest.approx(t)
        assert abs(sum(r.taken for r in by[s]) - t) <= 0.5
        assert all(r.taken <= 3 * r["size"] and r.source_size == sum(x["size"] for x in by[s]) for r in by[s])
    assert [r.position for r in got] == sorted(r.position for r in got)


def test_blocks_and_turns_of_one_id(spark):
    # a third of all rows without an id: no block holds them all
    rows = [(None if i % 3 == 0 else i, "w " * (1 + i % 50) + str(i)) for i in range(3000)]
    docs, _, _ = blocks.in_blocks(frame(spark, rows), "doc_id", "text")
    assert docs.select("block").distinct().count() == 1  # a small corpus is one block
    spread = docs.selectExpr("pmod(xxhash64(doc_id, h1), 8) b").groupBy("b").count().collect()
    assert max(r["count"] for r in spread) < 3000 / 8 * 1.5
    got = mixing._plan(frame(spark, rows), mixing.WEIGHTS, mixing.SLOPES, 3, 1103515245, "doc_id", "text", "source", False).groupBy("block").count().collect()
    assert max(r["count"] for r in got) < 3000 / 4 * 1.6


def test_helper_columns_do_not_clash(spark):
    from tessera.llm import embedding_dedup, minhash

    rows = awkward(docs=20)
    names = ["doc_id_", "text_hash", "n_bits", "bitmap", "h1", "size", "position", "kept", "Source_", "vec_id"]
    df = frame(spark, rows)
    for n in names:
        if n not in df.columns:
            df = df.withColumn(n, mixing.F.lit(1))
    assert Counter(r.doc_id for r in line_dedup.dedup_lines(df).collect()) == Counter(i for i, _ in rows)
    for out in (line_dedup.dedup_lines(df), mixing.apply_mix(df), minhash.dedup_near(df)):
        assert out.columns == df.columns and out.count() > 10
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0], 5, 6) for i in range(9)], "vec_id long, embedding array<double>, VEC_ID_ int, kept int")
    assert {r.vec_id for r in embedding_dedup.dedup_embeddings(vectors).collect()} == {0, 1}


def test_apply_mix_repeats_rows(spark):
    rows = [(i, "w " * (1 + i % 7)) for i in range(200)]
    df = frame(spark, rows, ("a", "b", "c", "c", "c", "c"))
    plan = {r.doc_id: r for r in mixing.mix(df, whole=True).collect()}
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: r.passes for i, r in plan.items() if r.passes})
    assert all(r.taken == r.passes * r["size"] for r in plan.values())


def small_blocks(monkeypatch, two_steps):
    """Many blocks and buckets for a small corpus; with two steps, fewer rows for a block than there are buckets."""
    monkeypatch.setattr(blocks, "LEAST_BLOCK", 20_000)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(blocks, "MOST_ROWS", 3 if two_steps else 1000)


def test_routes_grow_in_proportion():
    # rows of all blocks for coarse buckets and of all regions for buckets, at 10 GB, 1 TB and 100 TB of text
    for size in (1e10, 1e12, 1e14):
        n_blocks, r = size / blocks.MOST_BLOCK, blocks.route(-int(-size // blocks.BUCKET_BYTES))
        assert r.buckets >= size / blocks.BUCKET_BYTES and r.coarse <= 5100
        rows = n_blocks * r.coarse + (n_blocks / r.region * r.buckets if r.fine > 1 else 0)
        assert size / rows > 1500  # bytes of text a row
        assert r.region * blocks.MOST_BLOCK / r.coarse < 2 * blocks.MOST_BLOCK or r.fine == 1


def test_grouped_sorts_and_keeps_order():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, low in ((0, 0), (1, 0), (500, 3), (500, 40), (2000, 60)):
        h = (rng.integers(0, 50, n).astype(np.uint64) << np.uint64(low)) + rng.integers(0, 3, n).astype(np.uint64)
        order, new = blocks.grouped(h)
        assert order.tolist() == np.argsort(h, kind="stable").tolist()
        assert new.tolist() == [k == 0 or h[order[k]] != h[order[k - 1]] for k in range(n)]


def brute_lm(rows, order, backoff):
    docs = [WORD.findall(t or "") for _, t in rows]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = {n: sum((grams(w, n) for w in docs), Counter()) for n in range(1, order + 1)}
    words = sum(map(len, docs))
    out = []
    for (i, _), w in zip(rows, docs):
        own = {n: grams(w, n) for n in range(1, order + 1)}
        score = 0.0
        for at in range(len(w)):
            s = 0.0
            for n in range(min(order, at + 1), 0, -1):
                g = tuple(w[at - n + 1 : at + 1])
                c = total[n][g] - own[n][g]
                if n == 1:
                    s += math.log(max(c, 0.5) / max(words - len(w), 1))
                elif c > 0:
                    s += math.log(c / (total[n - 1][g[:-1]] - own[n - 1][g[:-1]]))
                    break
                else:
                    s += math.log(backoff)
            score += s
        out.append((i if i is not None else -1, len(w), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("order, two_steps", [(1, False), (2, False), (3, False), (3, True)])
def test_lm_scores(spark, monkeypatch, order, two_steps):
    small_blocks(monkeypatch, two_steps)
    rows = awkward(docs=20)
    got = lm_scoring.lm_scores(frame(spark, rows), order=order).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, round(r.log_score, 6) + 0.0) for r in got) == [(a, b, c + 0.0) for a, b, c in brute_lm(rows, order, 0.4)]
    assert all((r.score is None) == (r.n_words == 0) for r in got)


def test_lm_scores_count_runs_of_three_words_unless_told_otherwise(spark):
    rows = [(1, "a b c"), (2, "a b c"), (3, "x b c"), (4, "a b d b c")]
    got = lm_scoring.lm_scores(frame(spark, rows)).collect()
    want = brute_lm(rows, 3, 0.4)
    assert want != brute_lm(rows, 2, 0.4)
    assert sorted((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got) == want


def brute_suffix(rows, length=50):
    low = -(2**63)
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            s = raw[k : k + length]
            first[s] = min(first.get(s, 2**63), low if i is None else i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < (low if i is None else i):
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("two_steps", [False, True])
def test_suffix_dedup(spark, monkeypatch, two_steps):
    small_blocks(monkeypatch, two_steps)
    rng = random.Random(9)
    rows = awkward(docs=40)
    text = "".join(t for _, t in rows[:8])
    for i in range(40):  # passages cut anywhere
        at = rng.randrange(len(text) - 200)
        rows.append((rng.randrange(4000), f"{rng.random()} " + text[at : at + rng.randint(30, 190)] + f" {rng.random()}"))
    rows += [(50, "ab" * 200), (51, "ab" * 90), (52, "b" + "ab" * 60 + "ca"), (53, "x" * 49), (54, "x" * 50), (55, "x" * 51)]
    got = suffix_dedup.suffix_digests(frame(spark, rows)).collect()
    assert Counter(map(tuple, got)) == brute_suffix(rows)
    assert sum(r.n_removed for r in got) > 1000


def test_sort_suffixes_is_a_suffix_order():
    import numpy as np

    rng = random.Random(2)
    for alphabet in ("ab", "a", "abcdefgh"):
        raw = "".join(rng.choice(alphabet) for _ in range(3000)).encode()
        raw += raw[100:700] + raw[:300]
        data = np.frombuffer(raw + bytes(60), np.uint8)
        starts = np.arange(len(raw))
        order, new = suffix_dedup.sort_suffixes(suffix_dedup.words_at(data), starts)
        strings = [data[s : s + 50].tobytes() for s in order.tolist()]
        assert strings == sorted(strings)
        assert new.tolist() == [k == 0 or strings[k] != strings[k - 1] for k in range(len(strings))]


def test_empty_tables(spark):
    e = empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert line_dedup.line_digests(e).count() == 0
    assert quality.quality(e, labels).count() == 0
    assert quality.filter_quality(e, labels).count() == 0
    assert mixing.mix(e).count() == 0
    assert mixing.apply_mix(e).count() == 0
    assert lm_scoring.lm_scores(e).count() == 0
    assert suffix_dedup.suffix_digests(e).count() == 0
