"""The pipeline's stages, each on all that its predecessor kept."""

from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from stratalex.llm import near_dup, secret_spans, sentence_pieces
from stratalex.llm.common import saved, table

from .test_operators import WORDS, brute_near, brute_statistics, brute_targets


def test_stages_against_brute_force(spark, data):
    docs = table(spark, data, "documents")
    names = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        if name != "sentence_pieces":
            assert out.columns == names
        before, docs = docs, saved(out, "test")
        kept[name] = (before.toPandas(), docs.toPandas())
    a, b = kept["quality_rules"]
    for row in a.itertuples():
        n, *_, repeat = brute_statistics(row.text)
        assert not (row.doc_id in set(b.doc_id) and (n < 50 or 100 * repeat > 50 * n))
    a, b = kept["near_duplicates"]
    want = brute_near(list(zip(a.doc_id, a.text)), near_dup.Near())
    assert sorted(b.doc_id) == sorted({c for _, c in want.values()})
    a, b = kept["secret_scan"]
    assert sorted(a.doc_id) == sorted(b.doc_id)
    texts = dict(zip(b.doc_id, b.text))
    for row in a.itertuples():
        spans = secret_spans.spans_of(row.text.encode())
        assert (texts[row.doc_id] == row.text) == (not spans) and not secret_spans.spans_of(texts[row.doc_id].encode())
    assert (b.n_chars == b.text.str.len()).all()
    a, b = kept["mixing"]
    sizes, taken = defaultdict(int), defaultdict(int)
    for row in a.itertuples():
        sizes[row.source] += len(WORDS.findall(row.text))
    for row in b.itertuples():
        taken[row.source] += len(WORDS.findall(row.text))
    assert max(Counter(b.doc_id).values()) <= 3
    for s, goal in brute_targets(sizes, [5, 2, 1], 3).items():
        largest = max(len(WORDS.findall(t)) for t in a.text[a.source == s])
        assert abs(taken[s] - goal) <= largest
    a, b = kept["sentence_pieces"]
    enc = sentence_pieces.Encoder(sentence_pieces.Pieces())
    text = dict(zip(a.doc_id, a.text))
    assert len(a) == len(b) and b.round_trip.all()
    assert all(enc.decode(np.asarray(ids)) == text[i] for i, ids in zip(b.doc_id, b.ids))


def test_run_gives_the_last_stage(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert {"doc_id", "ids", "n_tokens", "round_trip"} <= set(out.columns) and out.count() > 0


def test_texts_that_share_an_id_are_judged_apart(spark):
    text = lambda c, n=60: " ".join(f"{c}{i}" for i in range(n))
    rows = [(5, text("a")), (5, text("b")), (5, text("a")), (2, text("b")), (7, text("c")), (7, text("d")), (7, text("c", 59)), (8, text("d")), (9, None), (9, None), (9, text("e")), (1, text("f")), (None, text("b")), (None, text("b"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    want = [(5, text("a")), (2, text("b")), (7, text("d")), (9, None), (9, text("e")), (1, text("f")), (None, text("b")), (None, text("b"))]
    close = [(7, text("c")), (7, text("c", 59))]
    count = Counter((r.doc_id, r.text) for r in got)
    assert sum(count[c] for c in close) == 1 and count - Counter(close) == Counter(want)


def test_stages_on_awkward_rows(spark, data, tmp_path):
    """Null, empty, repeated and long texts, null ids and sources, a clashing column, and no rows at all, through every stage."""
    text = " ".join(f"word{i}" for i in range(240))
    long = " ".join(f"entry{i}" for i in range(60_000))
    given = [(1, None, "a"), (2, "", None), (3, text, "a"), (3, text, "a"), (3, text + " other " * 3, "b"), (4, text.upper(), None), (None, text, "c"), (5, long, "a"), (6, long + " end", "a"), (7, "short", "b")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, node long, first string"
    docs = spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, "y") for i, t, s in given], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        docs = saved(stage(spark, docs, str(tmp_path)), "awkward")
        counts.append(Counter(r.doc_id for r in docs.select("doc_id").collect()))
    assert counts[0] == {3: 3, 4: 1, None: 1, 5: 1, 6: 1}
    assert counts[1] == {3: 1, None: 1, 5: 1} and counts[2] == counts[1]
    assert set(counts[3]) <= {3, None, 5} and counts[4] == counts[3] and docs.filter("not round_trip").isEmpty()
