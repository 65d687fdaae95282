"""The corpus pipeline and its stages on small tables, against brute force."""
import inspect
import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from cellweave.llm.simhash import differing, meet_chance, plan_for, similar_groups

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", len(t or "")) for i, t, lang in rows], SCHEMA)


def shingles(text, words=5):
    w = re.sub("[A-Z]", lambda m: m.group().lower(), text).split()
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def brute_kept(rows, similar=0.8):
    """One row (id, text) of each component of pairs at `similar`: the smallest id, null ids last."""
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similar * len(a | sets[j]):
                up[find(i)] = find(j)
    best = {}
    for k, (i, t) in enumerate(rows):
        g = find(k)
        if g not in best or (i is None, i or 0) < (best[g][0] is None, best[g][0] or 0):
            best[g] = (i, t)
    return best.values()


def known(pairs):
    return sorted(pairs, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def texts_of(seed, n, length=120):
    rng = random.Random(seed)
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)]
    return [" ".join(rng.choice(words) for _ in range(length)) for _ in range(n)]


def changed(text):
    return text.rsplit(" ", 1)[0] + " changed"


def odd_ids(seed=1):
    a, b, c, d, e, f, g = texts_of(seed, 7)
    return [(None, a), (None, b), (None, changed(b)), (7, c), (7, d), (3, e), (5, changed(e)), (5, f), (None, changed(f)), (9, g), (9, g)]


def test_dedup_with_null_and_repeated_ids(spark, tmp_path):
    rows = odd_ids()
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.simhash_dedup(spark, table(spark, [(i, t, "en") for i, t in rows]), "").collect()]
    want = list(brute_kept(rows))
    assert sorted(i for i, _ in got if i is not None) == [3, 5, 7, 7, 9] and len(got) == len(want) == 7
    # of equal ids either copy may stay
    for texts in ([t for i, t in got if i is not None], [t for i, t in want if i is not None]):
        assert sorted(texts) == sorted(t for i, t in want if i is not None)
    assert {t.rsplit(" ", 1)[0] for i, t in got if i is None} == {t.rsplit(" ", 1)[0] for i, t in want if i is None}


def test_run_keeps_every_distinct_document(spark, tmp_path):
    """run() against brute force by the numbers of tokens: each kept row's pieces add up to its tokens."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = odd_ids(2)
    table(spark, [(i, t, "en") for i, t in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "an item of the benchmark that no document holds")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {}
    for r in pieces:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    want, group = {}, {}
    for i, t in brute_kept(rows):
        want[i] = want.get(i, 0) + len(tok.encode(t, add_special_tokens=False).ids) + 1
        group[i] = group.get(i, 0) + 1
    assert set(total) == set(want) and group == {None: 2, 3: 1, 5: 1, 7: 2, 9: 1}
    assert {i: n for i, n in total.items() if i is not None} == {i: n for i, n in want.items() if i is not None}
    assert abs(total[None] - want[None]) <= 10  # either of two near copies with null ids


def near_and_below(seed=3, families=24):
    """Pairs on both sides of 0.8: a document, and copies whose last words differ."""
    rng, out = random.Random(seed), []
    for f, t in enumerate(texts_of(seed, families, 204)):
        w = t.split()
        for cut in rng.sample(range(0, 75), 3):
            out.append(" ".join([*w[: 204 - cut], *(f"f{f}c{cut}n{i}" for i in range(cut))]))
    return out


@pytest.mark.parametrize(("block", "block_bytes"), [(16384, 8_000_000), (3, 2_000), (50, 6_000)])
def test_groups_are_those_of_exact_similarity(spark, block, block_bytes):
    texts = [*near_and_below(), "one two three", "one two three", "", " ".join(["again and again the same"] * 40), " ".join(["again and again the same"] * 40) + " end"]
    got = {r["doc_id"]: r["component_id"] for r in similar_groups(table(spark, [(i, t, "en") for i, t in enumerate(texts)]), block=block, block_bytes=block_bytes).collect()}
    sets = [shingles(t) if t.split() else set() for t in texts]
    group = list(range(len(texts)))
    for _ in texts:
        group = [min(group[j] for j, b in enumerate(sets) if j == i or (a or b) and len(a & b) >= 0.8 * len(a | b)) for i, a in enumerate(sets)]
    assert len(set(group)) not in (1, len(texts))
    assert got == dict(enumerate(group))


def test_a_long_shared_passage_is_no_near_copy(spark):
    """Documents at a similarity of 0.74 to 0.79 all stay."""
    rows = []
    for f, t in enumerate(texts_of(9, 30, 200)):
        w = t.split()
        rows += [(2 * f, t), (2 * f + 1, " ".join([*w[: 200 - 24 - f % 4], *(f"f{f}n{i}" for i in range(24 + f % 4))]))]
    assert len(list(brute_kept(rows))) == 60
    got = corpus_pipeline.simhash_dedup(spark, table(spark, [(i, t, "en") for i, t in rows]), "")
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(60))


def test_language_id_without_any_label(spark):
    rows = [(1, "some text", None), (2, "12 34 !", None), (None, "é", None), (3, None, None), (4, "", None)]
    got = corpus_pipeline.language_id(spark, table(spark, rows), "")
    assert sorted(r["text"] for r in got.collect()) == ["some text", "é"]


def test_stages_with_nulls_clashing_columns_and_empty_tables(spark, tmp_path):
    spark.createDataFrame([(1, "an item of the benchmark that no document holds")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, TEXT string, row bigint"
    rows = [(None, None, None, None, None, "x", 1), (1, "", None, None, None, None, None), (2, "plain words", None, None, None, "y", 2), (2, "plain words", None, None, None, "y", 2)]
    spark.conf.set("spark.sql.caseSensitive", "true")
    docs = spark.createDataFrame(rows, schema)
    spark.conf.unset("spark.sql.caseSensitive")
    want = {"language ID": ["plain words"] * 2, "SimHash near-dedup": ["", "plain words"], "benchmark decontamination": ["", None, "plain words", "plain words"], "secret scans": ["", None, "plain words", "plain words"]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS
        texts = [r["text"] for r in out.collect()]
        if name == "SimHash near-dedup":  # null and empty have no shingles: one group, the row with an id stays
            assert sorted(texts) == want[name]
        else:
            assert sorted(texts, key=str) == sorted(want[name], key=str)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    pieces = corpus_pipeline.packing(spark, docs, str(tmp_path))
    assert pieces.where("length = 1 AND doc_tokens = 1").count() == 2 and corpus_pipeline.packing(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("n", [250_000, 3_000_000, 15_000_000])
def test_rows_of_a_node_stay_few_as_the_corpus_grows(n):
    """The candidate search shuffles a row for each probe: a node's rows, and the copies of a bucket's blocks, are bounded."""
    plan = plan_for(n, n * (np.full((64, 64), 0.25) + 0.25 * np.eye(64)), 0.8, 0.995)
    assert sum(math.comb(len(g), d) for g, t in plan for d in range(t + 1)) <= 24
    assert meet_chance(plan, differing(0.8)) >= 0.995
    assert sorted(b for g, _ in plan for b in g) == list(range(64))
    block = inspect.signature(similar_groups).parameters["block"].default
    assert sum(math.ceil(n / 2 ** len(g) / block) for g, _ in plan) <= 48
