import hashlib
import random
from collections import Counter, defaultdict

import corpus_pipeline
from tessera.llm import line_dedup, minhash, mixing, quality

from .corpus import awkward, frame, sentence
from .test_more_ops import check_packing, ids_of
from .test_text_ops import brute_lines, brute_statistics


def tables(spark, folder, empty=False):
    rng = random.Random(21)
    shared = [sentence(rng, 14) for _ in range(4)]
    docs, labels = [], []
    for i in range(160):
        lines = [sentence(rng, rng.randint(8, 40)) for _ in range(rng.randint(3, 12))]
        if i % 3 == 0:
            lines.insert(1, rng.choice(shared))
        if i % 8 == 7:
            lines = [" ".join(w + "$$$" for w in x.split()) for x in lines]
            labels.append((i, 0))
        else:
            labels.append((i, 1))
        docs.append((i, "\n".join(lines), "en", f"s{i % 5}" if i % 11 else None, 0))
    docs += [(200 + i, docs[i][1] + " tail", "en", "s1", 0) for i in range(0, 20, 2)] + [(300, None, "en", "s2", 0), (301, "", None, "s2", 0)]
    docs, labels = ([], []) if empty else (docs, labels)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_follow_one_another(spark, tmp_path):
    d = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet").cache()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "minhash near-dedup", "mixing", "best-fit packing"]
    # the operators' tests hold each verdict against brute force; here each stage's effect is held against its verdict
    at = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, d)
        if name != "best-fit packing":
            assert out.columns == docs.columns
        rows = out.collect()
        before = at.collect()
        ids = Counter(r.doc_id for r in rows)
        if name == "quality rules":
            assert ids == Counter(r.doc_id for r in quality.quality(at, spark.read.parquet(f"{d}/labels.parquet")).collect() if r.kept)
            assert not any(i % 8 == 7 for i in ids if i < 160) and len(ids) > 130
        elif name == "line dedup":
            lost = {r.doc_id: r.n_dropped for r in line_dedup.line_digests(at).collect()}
            text = {r.doc_id: r.text for r in before}
            assert len(rows) == len(before)
            assert all(r.text.count("\n") == text[r.doc_id].count("\n") - lost[r.doc_id] for r in rows)
            assert sum(lost.values()) > 20 and all(r.n_chars == len(r.text) for r in rows)
        elif name == "minhash near-dedup":
            assert ids == Counter(r.doc_id for r in minhash.near_groups(at).collect() if r.kept)
            assert not any(200 <= i < 220 and i - 200 in ids for i in ids)
        elif name == "mixing":
            assert ids == Counter({r.doc_id: r.passes for r in mixing.mix(at, whole=True).collect() if r.passes})
        else:
            words = defaultdict(int)
            for r in rows:
                words[r.sequence_id] += r.length
            assert max(words.values()) <= 2048
            assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in before)
        seen.append(Counter(map(tuple, rows)))
        at = spark.createDataFrame(rows, out.schema)
    assert len(corpus_pipeline.run(spark, d).collect()) == sum(seen[-1].values())


def test_awkward_documents(spark, tmp_path):
    """Null and repeated ids, repeated rows, copies, a long text, clashing columns: stage by stage against brute force."""
    rng = random.Random(5)
    rows = awkward(docs=30) + [(None, sentence(rng, 90)), (None, sentence(rng, 80))] + [(2000, sentence(rng, 70))] * 3
    rows += [(2001, rows[-1][1] + " tail"), (2002, sentence(rng, 40_000)), (2003, None), (None, None)]
    hot = sentence(rng, 12)
    rows += [(3000 + i, f"{hot}\n{sentence(rng, 60)}") for i in range(8)]
    docs = frame(spark, rows).selectExpr("*", "1 doc_id_", "2 text_hash", "3 passes", "4 component", "'x' kept", "5 position", "6 length")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    at, said = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path))
        got, before = out.collect(), [(r.doc_id, r.text) for r in at.collect()]
        if name != "best-fit packing":
            assert out.columns == docs.columns and all(r.doc_id_ == 1 and r.length == 6 for r in got)
            said = Counter((r.doc_id, r.text) for r in got)
        if name == "quality rules":
            words = {t: brute_statistics(t) for _, t in before}
            assert said == Counter((i, t) for i, t in before if words[t][0] >= 50 and 100 * words[t][4] <= 50 * words[t][0])
        elif name == "line dedup":
            want = brute_lines(before)
            assert Counter((r.doc_id, text_digest(r.text)) for r in got) == Counter((k[0], k[3]) for k in want.elements())
            assert sum(k[2] for k in want.elements()) >= 7 and all(r.n_chars == len(r.text) for r in got)
        elif name == "minhash near-dedup":
            assert set(said) <= set(before) and len({t for _, t in said}) == len(said)
            assert sum(t == rows[-13][1] for _, t in said.elements()) <= 3 and not any(i == 2001 for i, _ in said)
            kept = Counter((r.doc_id, r.h1) for r in minhash.near_groups(at).collect() if r.kept)
            assert sum(said.values()) == sum(kept.values())
        elif name == "mixing":
            assert {i for i, _ in said} <= {i for i, _ in before} and sum(said.values()) == sum(r.passes for r in mixing.mix(at, whole=True).collect())
        else:
            ids = ids_of("byte_bpe_50k.json", [t for _, t in before], 0)
            assert sum(r.length for r in got) == sum(map(len, ids))
            check_packing([(r.sequence_id, r.offset, r.length) for r in got], 2048)
            break
        at = spark.createDataFrame(got, out.schema)
    assert sum(r.length for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sum(map(len, ids))


def text_digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_empty_documents(spark, tmp_path):
    d = tables(spark, tmp_path, empty=True)
    assert corpus_pipeline.run(spark, d).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in names and set(e.oracle_sql()) <= names
