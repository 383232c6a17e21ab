import pytest
from pyspark.sql import functions as F

from reviewlake.functions.text import feature_hash
from reviewlake.operators import memory, similarity

NOW = "2026-06-09T00:00:00Z"
TEXT = "hygiene.debug-console Debug console statement console.log left in src/api/users.ts"


def learn(spark, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], memory.LEARNING_DDL)


def ask(spark, learnings, fp="f1", rule="hygiene.debug-console", text=TEXT):
    return memory.decide(spark.createDataFrame([(fp, rule, text)], "fingerprint string, rule_id string, text string"), learnings, NOW).first()


def entry(fp="f1", rule="hygiene.debug-console", text=TEXT, signal="dismissed", scope="finding", at="2026-06-01T00:00:00Z"):
    return (fp, rule, text, signal, scope, at)


def test_exact(spark):
    d = ask(spark, learn(spark, entry()))
    assert d["suppress"] and d["kind"] == "exact"


def test_rule_mute_never_decays(spark):
    d = ask(spark, learn(spark, entry(fp="", scope="rule", text="x", at="2020-01-01T00:00:00Z")))
    assert d["suppress"] and d["kind"] == "rule"


def test_similar(spark):
    d = ask(spark, learn(spark, entry(fp="other")), text=TEXT.replace("users", "orders"))
    assert d["suppress"] and d["kind"] == "semantic" and d["similarity"] > 0.82


@pytest.mark.parametrize("rule", ["security.eval-usage", "secret.aws"])
def test_security_is_exempt_from_similarity(spark, rule):
    assert not ask(spark, learn(spark, entry(fp="other", rule=rule)), rule=rule)["suppress"]


def test_reinforcement(spark):
    d = ask(spark, learn(spark, entry(fp="other", signal="accepted")))
    assert not d["suppress"] and d["reinforce"] and d["reinforcement"] > 0.99


def test_decay_asks_again(spark):
    d = ask(spark, learn(spark, entry(at="2025-11-01T00:00:00Z")))
    assert not d["suppress"] and d["revalidate"] and d["kind"] == "exact"
    d = ask(spark, learn(spark, entry(fp="other", at="2026-02-01T00:00:00Z")))
    assert not d["suppress"] and d["revalidate"] and d["kind"] == "semantic" and d["stale_since"].startswith("2026-02-01")
    d = ask(spark, learn(spark, entry(at="2025-11-01T00:00:00Z"), entry(at="2026-06-08T00:00:00Z")))
    assert d["suppress"]


def test_nothing_known(spark):
    d = ask(spark, learn(spark))
    assert not d["suppress"] and not d["revalidate"] and not d["reinforce"]


def test_upsert_ignores_the_signal(spark):
    one = memory.upsert(learn(spark), learn(spark, entry()))
    two = memory.upsert(one, learn(spark, entry(signal="accepted", at="2026-06-02T00:00:00Z")))
    assert [r["signal"] for r in two.collect()] == ["accepted"]
    muted = memory.upsert(two, learn(spark, entry(fp="", scope="rule")))
    assert muted.count() == 2
    assert memory.forget(muted, F.col("scope") == "rule").count() == 1


def test_blocks_give_the_same_pairs(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 3), 1.0]) for i in range(60)], "id long, vec array<double>")
    whole = {tuple(r) for r in memory.similarity_pairs(v, v, 5.0).collect()}
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 7)
    assert {tuple(r) for r in memory.similarity_pairs(v, v, 5.0).collect()} == whole


def test_recall(spark):
    rows = [("note", "use pnpm to build", None, None), ("note", "deploys run on fridays", None, "a.md"), ("note", "use pnpm to build", None, None)]
    new = spark.createDataFrame(rows, "kind string, text string, scope string, file string")
    store = memory.remember(spark.createDataFrame([], memory.MEMORY_DDL), new, NOW).cache()
    assert store.count() == 2
    assert memory.remember(store, new, NOW).count() == 2
    hits = memory.recall(store, F.lit("how to build with pnpm")).collect()
    assert hits[0]["text"] == "use pnpm to build" and hits[0]["score"] == round(hits[0]["score"], 3)
    assert memory.recall(store, F.lit("")).count() == 0
    assert store.select(feature_hash(F.col("text"))).count() == 2
