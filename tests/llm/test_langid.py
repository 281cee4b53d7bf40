import numpy as np
from pyspark.sql import functions as F
from tests.llm.data import no_documents, odd_documents

from topicpulse.llm import langid
from topicpulse.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = langid.ByteNet.fresh(["a", "b", "c"])
    for k, p in enumerate(net.parameters()):
        p[...] = rng.standard_normal(p.shape) * 0.3
    windows = rng.integers(0, 256, (6, langid.WINDOW)).astype(np.uint8)
    y = rng.integers(0, 3, 6)

    def loss():
        p = langid.softmax((net.pooled(windows)[0] @ net.out + net.out_bias).astype(np.float64))
        return -np.log(p[np.arange(6), y]).mean()

    for p, g in zip(net.parameters(), net.step(windows, y)):
        flat, grad = p.reshape(-1), g.reshape(-1)
        for i in np.argsort(-np.abs(grad))[:5]:
            old = flat[i]
            flat[i] = old + 1e-2
            up = loss()
            flat[i] = old - 1e-2
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-2 - grad[i]) < 0.1 * max(abs(grad[i]), 0.02)


def test_folded_tables_equal_the_network():
    rng = np.random.default_rng(1)
    net = langid.ByteNet.fresh(["a", "b"])
    windows = rng.integers(0, 256, (40, langid.WINDOW)).astype(np.uint8)
    direct = langid.softmax(net.pooled(windows)[0] @ net.out + net.out_bias)
    assert np.allclose(direct, langid.probabilities(net, net.folded(), windows), atol=1e-4)


def test_windows_cover_the_whole_text():
    texts = [b"", b"a" * 127, b"b" * 128, b"c" * 129, b"d" * 1000]
    windows, counts = langid.windows_of(texts)
    assert counts.tolist() == [1, 1, 1, 2, 8] and (windows != 0).sum() == sum(map(len, texts))


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op3_langid"](spark, SF).join(truth, "doc_id").filter("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = langid.identify(docs)
    assert got.columns == [*docs.columns, "lang_pred_", "score_"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred_"] != "und") == letters and r["lang_pred"] == "mine"
    assert langid.identify(no_documents(spark)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred_"] for r in langid.identify(unlabelled).collect()} == {"und"}


def test_every_label_is_learned(spark, monkeypatch):
    # 80 labels, one of them with one much copied text and one rare text; few windows
    monkeypatch.setattr(langid, "EPOCHS", 100)
    texts = [(f"{chr(0x4E00 + 97 * k)}{chr(0x4E01 + 97 * k)} {j} " * 8, f"l{k:02}")
             for k in range(79) for j in range(6)]
    texts += [("zzz zz " * 20, "rare")] * 2000 + [("qqq qq " * 20, "rare")]
    docs = spark.createDataFrame(texts, "text string, lang string")
    net = langid.learn(docs)
    assert net.labels == sorted({lang for _, lang in texts})
    got = langid.predict(docs.distinct(), net).toPandas()
    assert set(got["lang_pred"]) == set(net.labels)
    assert (got["lang"] == got["lang_pred"]).mean() > 0.9
    assert set(got.loc[got["lang"] == "rare", "lang_pred"]) == {"rare"}


def test_numerals_are_no_letters(spark):
    from topicpulse.llm.langid import has_letter

    assert not any(map(has_letter, [None, "", "² ½ 12", "Ⅷ ①", "12 !!", "_"]))
    assert all(map(has_letter, ["² a", "ß", "日", "ª", "½ ё"]))
