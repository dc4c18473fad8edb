import random

from pyspark.sql import functions as F

from rankloom.llm import mixing
from rankloom.operators import prefix

WORDS = {"a": "山川海空", "b": "鉄道駅車", "c": "茶花草木"}


def tables(spark, sizes):
    rng, rows = random.Random(6), []
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((len(rows), source, "".join(rng.choice(WORDS[source] + "はのを") for _ in range(rng.randint(20, 200)))))
    rows += [(9000, "a", None), (9001, "a", ""), (9002, None, "山川"), (9003, "other", "山川")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("tokens", F.lit(0)).withColumn("key", F.lit("x"))


def mixed(spark, docs, targets):
    goal = spark.createDataFrame(targets, "mix_id int, source string, weight double, max_repeats int")
    return mixing.mix(docs, goal, "doc_id", "text", "source").chosen.collect()


def test_shares_and_caps(spark):
    docs = tables(spark, {"a": 600, "b": 300, "c": 40})
    targets = [(1, "a", 2.0, 1), (1, "b", 1.0, 2), (1, "c", 1.0, 3), (1, "gone", 1.0, 3), (2, "b", 1.0, 5), (2, "c", 1.0, 5)]
    rows = mixed(spark, docs, targets)
    for mix_id, shares, caps in ((1, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 1, "b": 2, "c": 3}), (2, {"b": 0.5, "c": 0.5}, {"b": 5, "c": 5})):
        own = [r for r in rows if r["mix_id"] == mix_id]
        total = sum(r["tokens"] * r["repeats"] for r in own)
        for source, share in shares.items():
            assert abs(sum(r["tokens"] * r["repeats"] for r in own if r["source"] == source) / total - share) < 0.01
        assert all(0 < r["repeats"] <= caps[r["source"]] for r in own)
        assert len({r["doc_id"] for r in own}) == len(own) and not {9000, 9001, 9002, 9003} & {r["doc_id"] for r in own}


def test_long_documents_take_part(spark):
    docs = tables(spark, {"a": 300, "b": 300})
    docs = docs.withColumn("text", F.when((F.col("source") == "a") & (F.col("doc_id") % 6 == 0), F.repeat("text", 25)).otherwise(F.col("text")))
    rows = mixed(spark, docs, [(1, "a", 1.0, 4), (1, "b", 1.0, 1)])
    tokens = {s: sum(r["tokens"] * r["repeats"] for r in rows if r["source"] == s) for s in "ab"}
    assert abs(tokens["a"] / sum(tokens.values()) - 0.5) < 0.01
    assert max(r["tokens"] for r in rows if r["source"] == "a") > 0.02 * tokens["a"]
    assert all(abs(r["repeats"] - r["rate"]) < 1 for r in rows)


def test_defined_cases(spark):
    docs = tables(spark, {"a": 3})
    assert mixed(spark, docs.limit(0), [(1, "a", 1.0, 1)]) == []
    assert mixed(spark, docs, [(1, "gone", 1.0, 1)]) == []
    assert mixed(spark, docs, []) == [] and mixed(spark, docs, [(1, None, 1.0, 1)]) == []
    assert {r["repeats"] for r in mixed(spark, docs, [(1, "a", 5.0, 2)])} == {2}


def test_classifier_learns():
    rng = random.Random(2)
    make = lambda s: "".join(rng.choice(WORDS[s] + "はのを") for _ in range(80))
    labels = [rng.choice("abc") for _ in range(300)]
    rows = mixing.hashed_pairs([make(s) for s in labels])
    weights = mixing.train_softmax(rows[:200], mixing.np.array([ord(s) - 97 for s in labels[:200]]), 3)
    right = (mixing.posteriors(rows[200:], weights).argmax(1) == [ord(s) - 97 for s in labels[200:]]).mean()
    assert right > 0.95


def test_the_fit_meets_its_targets(spark):
    docs = tables(spark, {"a": 400, "b": 200, "c": 100})
    goal = spark.createDataFrame([(1, "a", 1.0, 2), (1, "b", 1.0, 2), (1, "c", 1.0, 3)], "mix_id int, source string, weight double, max_repeats int")
    fit = mixing.mix(docs, goal, "doc_id", "text", "source").fit
    total = sum(target for *_, target, _, _ in fit)
    assert len(fit) == 3 and all(abs(expected - target) <= 0.01 * total for _, _, target, expected, _ in fit)


def test_more_sources_than_a_classifier_takes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 1)
    rows = mixed(spark, tables(spark, {"a": 300, "b": 150}), [(1, "a", 1.0, 1), (1, "b", 1.0, 2)])
    tokens = {s: sum(r["tokens"] * r["repeats"] for r in rows if r["source"] == s) for s in "ab"}
    assert abs(tokens["a"] / sum(tokens.values()) - 0.5) < 0.01


def test_sparse_memberships():
    post = mixing.np.array([[0.7, 0.2999, 0.0001], [0.0001, 0.0001, 0.9998]])
    offsets, domain, value = mixing.sparse(post)
    assert offsets.tolist() == [0, 2, 3] and domain.tolist() == [0, 1, 2] and abs(value[:2].sum() - 1) < 1e-6
    member = mixing.membership(offsets, domain, value, None, mixing.np.array([0.0, 1.0, 0.0]))
    assert member.tolist() == [0.0, 1.0, 0.0]


def test_one_long_document_is_settled(spark):
    drawn = spark.createDataFrame([(1, 1, "a", 14, 0.2, 0.0, 0), (1, 2, "a", 320, 0.2, 0.2, 1), (1, 3, "a", 1684, 0.3, 0.4, 0), (1, 4, "a", 850, 0.3, 0.7, 0), (1, 5, "a", 17773, 0.1, 0.95, 1)], "mix_id int, key bigint, source string, tokens bigint, rate double, start double, repeats bigint")
    changes = {r["key"]: r["change"] for r in mixing.settling(drawn, spark.createDataFrame([(1, "a", 2840.0)], "mix_id int, source string, target double"), "bigint").collect()}
    assert changes == {5: -1, 3: 1, 4: 1}


def test_the_order_is_the_same_at_every_size(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(m, k, s, rng.choice((5, 6, 6, 7, 90, 300)), rng.randint(1, 15) / 8) for m in (1, 2) for s in "ab" for k in range(120)]
    fitted = spark.createDataFrame(rows, "mix_id int, key bigint, source string, tokens bigint, rate double")
    least = {r["key"]: r["h"] for r in fitted.select("key", F.xxhash64(F.lit(31), "key").alias("h")).distinct().collect()}
    expected, start = {}, dict.fromkeys([(m, s) for m in (1, 2) for s in "ab"], 0.0)
    for m, k, s, _, rate in sorted(rows, key=lambda r: (r[3], least[r[1]], r[1])):
        expected[m, s, k] = start[m, s]
        start[m, s] += rate
    draws = []
    for most in (3, 17, 50_000):
        monkeypatch.setattr(prefix, "ROWS_PER_BUCKET", most)
        drawn = mixing.drawing(fitted).collect()
        assert {(r["mix_id"], r["source"], r["key"]): r["start"] for r in drawn} == expected  # sums of eighths are exact
        draws.append({(r["mix_id"], r["source"], r["key"]): r["repeats"] for r in drawn})
    assert draws[0] == draws[1] == draws[2]


def test_memberships_do_not_depend_on_the_number_of_sources(spark, monkeypatch):
    docs = tables(spark, {"a": 300, "b": 150})
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.translate("text", WORDS["a"], WORDS["b"])).otherwise(F.col("text")))  # of a, but as those of b
    goal = spark.createDataFrame([(1, "a", 1.0, 2), (1, "b", 1.0, 2)], "mix_id int, source string, weight double, max_repeats int")
    runs = []
    for most in (2000, 1):
        monkeypatch.setattr(mixing, "MOST_SOURCES", most)
        monkeypatch.setattr(mixing, "TRAINED", 64 if most == 1 else 4096, raising=False)
        run = mixing.mix(docs, goal, "doc_id", "text", "source")
        runs.append(({r["doc_id"]: r["rate"] for r in run.chosen.collect()}, {s: expected for _, s, _, expected, _ in run.fit}))
    (rates, fit), (others, other_fit) = runs
    assert len({round(x, 3) for x in rates.values()}) > 4
    assert all(abs(rates[k] - others[k]) < 1e-3 for k in rates.keys() & others.keys())
    assert all(abs(fit[s] - other_fit[s]) < 1e-3 * fit[s] for s in "ab")


def test_gradients_by_blocks(monkeypatch):
    rng = mixing.np.random.default_rng(4)
    rows, labels = rng.random((90, 16), mixing.np.float32), rng.integers(0, 5, 90)
    whole = mixing.train_softmax(rows, labels, 5)
    monkeypatch.setattr(mixing, "TRAINED", 7)
    assert mixing.np.abs(mixing.train_softmax(rows, labels, 5) - whole).max() < 0.01
    assert mixing.rows_at_once(512, 2000) == 512 and mixing.rows_at_once(512, 20_000) == 51 and mixing.rows_at_once(512, 10**9) == 1


def test_every_source_has_its_full_sample(spark):
    docs = spark.range(250 * 90).selectExpr("id AS doc_id", "concat('s', id % 250) AS source", "concat(hex(id), 'はの') AS text")
    rows, labels = mixing.labelled_sample(docs, "doc_id", "text", "source", [f"s{i}" for i in range(250)])
    assert rows.shape == (250 * 90, mixing.WIDTH) and (mixing.np.bincount(labels) == 90).all()
    first = docs.filter("source = 's7'").orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").select("text").first()["text"]
    assert (rows[labels == 7][0] == mixing.hashed_pairs([first])[0]).all()
