import random

import corpus_pipeline as P
from langmix.llm import mixing, toxicity
from tests.llm import fixtures as X

SF = "/root/testdata/sf0.001"


def test_stages_compose(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns
        if name == "toxicity":
            chain = toxicity.learn(docs, toxicity.categories(spark.read.parquet(f"{SF}/labels.parquet")))
            keep = {r.doc_id for r in toxicity.with_scores(docs, chain).where(f"p_toxic < {toxicity.REJECT}").select("doc_id").collect()}
        elif name == "near_duplicates":
            keep = {k for (k, _, _, kept) in X.jaccard_classes([(r.doc_id, r.text) for r in before.collect()]) if kept}
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            keep = {k[0] for k in X.decontaminated([(r.doc_id, r.text) for r in before.collect()], items) if not k[5]}
        else:
            keep = None
        if keep is not None:
            assert {r.doc_id for r in after.select("doc_id").collect()} == keep
            assert after.count() < before.count()
        before = after
    rows = P.run(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before.select("doc_id").collect())
    counts = [sum(r.shard == s for r in rows) for s in range(40)]
    assert max(counts) - min(counts) <= 1


def test_repeated_rows_and_nulls(spark):
    rng = random.Random(5)
    text = X.sentence(rng, 80)
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, text, "en", "a"), (None, text, "en", None), (3, None, None, None),
            (4, "", "en", "a"), (5, "", "en", "a"), (6, X.sentence(rng, 40), "en", "a"), (6, X.sentence(rng, 40), "en", "a")]
    left = P.one_of_each_group(spark, X.frame(spark, rows), SF)
    # of the equal texts one row stays; rows without words and different texts stay
    assert sorted((r.doc_id, len(r.text or "")) for r in left.select("doc_id", "text").collect()) == \
        sorted([(1, len(text)), (3, 0), (4, 0), (5, 0), (6, len(rows[7][1])), (6, len(rows[8][1]))])
    for _, stage in P.STAGES:
        assert stage(spark, X.empty(spark), SF).count() == 0


def test_rows_without_an_id_of_their_own(spark):
    """Every row is decided by itself, however many share its id (or have none)."""
    rng = random.Random(8)
    a, b, c, d = (X.sentence(rng, 60) for _ in range(4))
    near = b.replace(b.split()[30], "changed", 1)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("size(split(text, ' ')) > 12").first().text
    alone = [X.sentence(rng, 30) for _ in range(4)]
    rows = [(1, a), (None, a), (None, b), (None, near), (None, c), (None, c), (None, alone[0]), (None, alone[1]), (None, ""), (None, None),
            (7, d), (8, d), (8, alone[2]), (9, a), (9, c), (9, b), (2, c + "  "), (2, c), (6, alone[3]), (6, alone[3])]
    docs = X.frame(spark, [(k, t, "en", "a") for k, t in rows])
    left = sorted((r.doc_id or 0, r.text or "") for r in P.one_of_each_group(spark, docs, SF).select("doc_id", "text").collect())
    spaces = [x for x in left if x[0] == 2]
    assert [" ".join(t.split()) for _, t in spaces] == [c]  # one of two texts that differ in spaces
    assert sorted(x for x in left if x[0] != 2) == sorted(
        [(1, a), (9, b), (0, alone[0]), (0, alone[1]), (0, ""), (0, ""), (7, d), (8, alone[2]), (6, alone[3])])
    # groups without any id: one row of each
    bare = X.frame(spark, [(None, t, "en", "a") for t in (a, a, b, near, alone[0])])
    left = [r.text for r in P.one_of_each_group(spark, bare, SF).select("text").collect()]
    assert len(left) == 3 and a in left and alone[0] in left and (b in left) != (near in left)
    # contaminated rows go alone
    rows = [(None, a), (None, a + " " + item), (None, None), (3, b), (3, item), (3, b)]
    left = P.drop_contaminated(spark, X.frame(spark, [(k, t, "en", "a") for k, t in rows]), SF)
    assert sorted((r.doc_id or 0, r.text or "") for r in left.select("doc_id", "text").collect()) == sorted([(0, a), (0, ""), (3, b), (3, b)])


def test_mix_of_a_thousand_million_words(spark, monkeypatch):
    """The same rows are taken when every word counts many times."""
    df = X.frame(spark, X.documents())
    plain = X.rows_of(P.mix_sources(spark, df, "").select("doc_id", "source"))
    words, total = mixing.words, mixing.sized(df).agg({"size": "sum"}).first()[0]
    monkeypatch.setattr(mixing, "words", lambda text: words(text) * (10 ** 9 // (3 * total)))
    assert X.rows_of(P.mix_sources(spark, df, "").select("doc_id", "source")) == plain
