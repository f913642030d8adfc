"""The pipeline on the smallest tables against the same decisions taken by plain loops, stage by stage."""

import hashlib

import corpus_pipeline
from tidemark.llm import bpe, decontamination, toxicity
from tidemark.llm.common import table, words_of

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents").withColumn("score", toxicity.F.lit("clash"))
    rows = [r.asDict() for r in docs.collect()]
    out = corpus_pipeline.toxicity_stage(spark, docs, FOLDER)
    assert out.columns == docs.columns
    model = toxicity.fit(docs, table(spark, FOLDER, "labels"))
    scores = toxicity.Scores(model)
    score = lambda w: toxicity.probability(model, toxicity.strength(
        model, toxicity.segments(toxicity.np.array([scores[x] for x in w])), len(w)))
    rows = [r for r in rows if score(words_of(r["text"])) < 0.5]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in rows)

    out = corpus_pipeline.near_duplicate_stage(spark, docs.join(out.select("doc_id"), "doc_id", "left_semi").select(docs.columns), FOLDER)
    sets = {r["doc_id"]: (lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())(
        r["text"].encode().lower().split()) for r in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b]) if label[a] != label[b] else 0
                if both and 100 * both >= 80 * len(sets[a] | sets[b]) and label[b] < label[a]:
                    label[a], changed = label[b], True
    rows = [r for r in rows if label[r["doc_id"]] == r["doc_id"]]
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in rows)

    kept = spark.createDataFrame([tuple(r.values()) for r in rows], docs.schema)
    out = corpus_pipeline.decontamination_stage(spark, kept, FOLDER)
    items = [words_of(r["text"]) for r in table(spark, FOLDER, "benchmark").collect()]
    grams = {tuple(w[i:i + 10]) for w in items for i in range(len(w) - 9)}
    assert all(len(w) >= 10 for w in items)
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    for r in rows:
        w = words_of(r["text"])
        hit = {p for i in range(len(w) - 9) if tuple(w[i:i + 10]) in grams for p in range(i, i + 10)}
        if len(hit) > 0.5 * len(w):
            assert r["doc_id"] not in texts
        else:
            assert words_of(texts[r["doc_id"]]) == [x for i, x in enumerate(w) if i not in hit]
            assert hit or texts[r["doc_id"]] == r["text"]


def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    rows = out.collect()
    assert 0 < len(rows) <= table(spark, FOLDER, "documents").count()
    text = {r["doc_id"]: r["text"] for r in table(spark, FOLDER, "documents").collect()}
    coder = bpe.encoder(open(bpe.default_path()).read())
    same = [r for r in rows if r["ids_sha256"] == hashlib.sha256(coder.encode(text[r["doc_id"]]).encode()).hexdigest()]
    assert len(same) > 0.8 * len(rows)  # clean texts pass unchanged
    assert decontamination.contamination(
        table(spark, FOLDER, "documents").join(out.select("doc_id"), "doc_id", "left_semi"),
        table(spark, FOLDER, "benchmark")).where("size(contamination.spans) > 0").count() <= len(rows) - len(same)
