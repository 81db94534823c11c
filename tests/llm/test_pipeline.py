"""The pipeline's stages, one by one, against their operators."""

import corpus_pipeline
from tracelake.llm import common, exact_dedup, mixing, near_dedup, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = common.documents(spark, SF)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = common.materialize(stage(spark, docs, SF))
        seen[name] = (before, docs)
        if name != "sentencepiece":
            assert docs.columns == before.columns
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    a, b = seen["toxicity"]
    assert ids(b) == ids(toxicity.toxicity(a, common.labels(spark, SF)).where("predicted = 0"))
    a, b = seen["exact_dedup"]
    assert ids(b) == ids(exact_dedup.exact_groups(a).where("kept"))
    a, b = seen["near_dedup"]
    assert ids(b) == ids(near_dedup.near_groups(a, width=5).where("kept"))
    a, b = seen["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(a, common.labels(spark, SF)).collect()}
    assert ids(b) == sorted(i for i, n in copies.items() for _ in range(n))
    a, b = seen["sentencepiece"]
    assert ids(a) == ids(b) and b.where("n_tokens <> size(ids)").count() == 0


def test_empty_input(spark):
    docs = common.documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, SF))
    assert docs.count() == 0


def test_null_columns(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, None, None, None), (2, "a text of some words that stays", None, None, None)], common.documents(spark, SF).schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, SF))
    assert 2 in {r.doc_id for r in docs.collect()}


def test_whole_pipeline_by_brute_force(spark, monkeypatch):
    """All stages but the score in plain Python; the score is stood in for by a word."""
    import random

    import sentencepiece
    from test_dedup import LOWER, brute_components
    from test_text import WORD, brute_mix

    rng = random.Random(17)
    base = [[f"w{rng.randrange(300)}" for _ in range(60)] for _ in range(8)]
    rows = []
    for i in range(60):
        words = list(rng.choice(base)) if i % 2 else [f"w{rng.randrange(300)}" for _ in range(rng.randrange(0, 40))]
        if i % 3 == 0 and words:
            words[-1] = f"x{i}"
        text = " ".join(words + (["awful"] if i % 7 == 0 else []))
        rows.append((i, text.upper() if i % 5 == 0 else text, "en", f"s{i % 4}", len(text)))
    docs = spark.createDataFrame(rows, common.documents(spark, SF).schema)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 3)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(common, "labels", lambda *_: labels)
    monkeypatch.setattr(toxicity, "keep_rows", lambda d, _: d.where("lower(text) NOT LIKE '%awful%'"))
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, SF))
    left = [r for r in rows if "awful" not in r[1].lower()]
    winner = {}
    for r in left:
        k = r[1].translate(LOWER)
        winner[k] = max(winner.get(k, r), r)
    left = sorted(winner.values())
    kept = {i for i, _, _, own in brute_components([(r[0], r[1]) for r in left], 5, 80) if own}
    left = [r for r in left if r[0] in kept]
    plan = brute_mix([r[:4] for r in left], {i: i % 2 for i in range(0, 60, 3)})
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.model_path())
    want = []
    for r in left:
        size = len(WORD.findall(r[1]))
        copies = plan[r[0], size][0][2] // size if size else 0
        want += [(r[0], r[3], tuple(library.encode(r[1])))] * copies
    assert sorted((r.doc_id, r.source, tuple(r.ids)) for r in docs.collect() if r.ids) == sorted(want)
