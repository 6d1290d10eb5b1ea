import random
import zlib

import numpy as np
import pyarrow as pa

from trawlspark import shipping
from trawlspark.llm import toxicity

R = random.Random(8)


def prose(n: int) -> list[str]:
    return [f"w{R.randrange(2000)}" for _ in range(n)]


def hashed(spark, rows):
    """Rows (shard, doc_id, y, lang, text) as fit deals them: each label before its text, and texts without a label between."""
    both = [x for shard, i, y, lang, text in rows for x in ((shard, int(i), None, lang, "no label"), (shard, int(i), int(y), None, None), (shard, int(i), None, lang, text), (shard, -1, None, lang, "no label"))]
    table = spark.createDataFrame(both, "shard int, doc_id long, y int, lang string, text string").coalesce(1).selectExpr("*", "true AS calibrates")
    return shipping.map_arrow(table, toxicity._hashed, "shard int, calibrates boolean, lang string, y int, words binary")


def test_likely_texts(spark, monkeypatch):
    """Labelled texts all stay; of the others, few where the map is large and more where it is small."""
    docs = spark.range(-500, 4000).selectExpr("id AS doc_id", "string(id) AS text", "'en' AS lang")
    rows = spark.range(-500, 4000, 10).selectExpr("id AS doc_id", "1 AS y")
    for bits, least, most in ((1 << 25, 450, 460), (1 << 12, 700, 1200), (8, 4500, 4500)):
        monkeypatch.setattr(toxicity, "BITS", bits)
        got = {r["doc_id"] for r in toxicity.likely(docs, rows).collect()}
        assert got >= set(range(-500, 4000, 10)) and least <= len(got) <= most, bits


def test_toxicity_learns_from_every_labelled_row(spark):
    """Each row of thousands of a label moves its own word's vector or calibrates."""
    n = 9000
    docs = spark.createDataFrame([(k, f"{k:x}word", ("en", "fr", None)[k % 3]) for k in range(n)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(n)], "doc_id long, toxic int")
    m, was = toxicity.fit(docs, labels), toxicity.new_model()
    rows = docs.selectExpr("doc_id", "text", f"pmod(xxhash64('calibrate', doc_id), {toxicity.CALIBRATION}) = 0 AS calibrates").toPandas()
    seen = rows[[zlib.crc32(str(i).encode()) % 5 != 0 for i in rows.doc_id]]
    own = toxicity.word_buckets(pa.array(seen.text[~seen.calibrates]))[0][0]
    assert len(own) > 5000 and (m.tables[0][own] != was.tables[0][own]).any(axis=1).all()
    apart = [(0, i, i % 2, ("en", "fr", None)[i % 3], text) for i, text in zip(seen.doc_id[seen.calibrates], seen.text[seen.calibrates], strict=True)]
    z, y, weight, lang = toxicity.logits_of(hashed(spark, apart), m)
    assert weight.sum() == len(apart) > 1000 and weight @ y == sum(r[2] for r in apart) and set(lang) == {"en", "fr", None} and set(m.thresholds) == {"en", "fr"}


def test_toxicity_learns_from_long_texts(spark):
    """Toxic texts are all longer than 20,000 characters, and what marks them comes last."""
    docs = spark.createDataFrame([(k, "some plain words " * 1300 + ("vile" if k % 3 == 0 else "kind"), "en") for k in range(150)], "doc_id long, text string, lang string")
    out = toxicity.toxicity(docs, docs.selectExpr("doc_id", "int(doc_id % 3 = 0) AS toxic")).collect()
    assert all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in out) and any(r["held_out"] for r in out)


def test_toxicity_of_few_labels(spark):
    """If the only row of a label would calibrate, it trains; without a second label the score is constant."""
    docs = spark.createDataFrame([(k, f"text {k} " + ("vile " * 5 if k == 10 else "kind"), "en") for k in range(30)], "doc_id long, text string, lang string")
    chosen = docs.selectExpr("doc_id", f"pmod(xxhash64('calibrate', doc_id), {toxicity.CALIBRATION}) = 0 AS calibrates").collect()
    one = next(r["doc_id"] for r in chosen if r["calibrates"] and zlib.crc32(str(r["doc_id"]).encode()) % 5)
    docs = docs.selectExpr("doc_id", f"CASE WHEN doc_id = {one} THEN 'vile vile vile' ELSE text END AS text", "lang")
    got = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, docs.selectExpr("doc_id", f"int(doc_id = {one}) AS toxic")).collect()}
    assert max(got, key=got.get) == one
    for label, score in (("0", 0), ("1", 1), ("2", 0), ("null", 0)):
        assert all(abs(r["score"] - score) < 1e-9 for r in toxicity.toxicity(docs, docs.selectExpr("doc_id", f"int({label}) AS toxic")).collect()), label


def test_toxicity_pass_averages_shards(spark, monkeypatch):
    """A pass against one learner for each shard, in plain loops; scores don't depend on how the tables are partitioned."""
    monkeypatch.setattr(toxicity, "PIECE", 1000)
    texts = [" ".join(prose(20)) + (" vile" if k % 3 == 0 else "") for k in range(40)]
    y = [int(k % 3 == 0) for k in range(40)]
    split = [0] * 25 + [1] * 15
    rows = hashed(spark, list(zip(split, range(40), y, ["en"] * 40, texts, strict=True))).select("shard", "y", "words")
    start = toxicity.Learner(toxicity.new_model())
    was = toxicity.flat(start.arrays), toxicity.flat(start.sums)
    got = toxicity.one_pass(rows, *was, 2)
    total, weight = np.zeros((2, len(was[0]))), np.zeros(len(was[0]))
    for shard in (0, 1):
        own = [k for k in range(40) if split[k] == shard]
        learner = toxicity.Learner(toxicity.new_model(), *was)
        learner.learn(*toxicity.word_buckets(pa.array([texts[k] for k in own])), np.array(y)[own], np.ones(len(own)), np.random.default_rng([2, shard]).permutation(len(own)))
        change = np.stack([toxicity.flat(learner.arrays) - was[0], toxicity.flat(learner.sums) - was[1]])
        total += change * len(own)
        weight += len(own) * change.any(axis=0)
    for have, before, change in zip(got, was, total / np.maximum(weight, 1), strict=True):
        assert np.allclose(have, before + change, atol=1e-5) and not np.allclose(have, before, atol=1e-4)

    monkeypatch.setattr(toxicity, "SHARD_ROWS", 50)
    docs = spark.createDataFrame([(k, " ".join(prose(15)) + (" vile" if k % 3 == 0 else ""), "en") for k in range(400)] + [(7, "another text", "fr")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(400)], "doc_id long, toxic int")
    one, two = (sorted(map(tuple, toxicity.toxicity(docs.repartition(a), labels.repartition(b)).collect()), key=repr) for a, b in ((1, 5), (7, 2)))
    assert one == two and len(one) == 401


def test_toxicity_of_texts_in_pieces(monkeypatch):
    """Filters over a text in pieces find what they find over the whole."""
    texts = pa.array([" ".join(prose(n)) for n in (1, 5, 9, 10, 11, 57, 30, 0)])
    m, own = toxicity.new_model(4), toxicity.word_buckets(texts)
    whole = m.pooled(*own, places=True)
    for block in (1, 2, 3, 10):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        pieces = m.pooled(*own, places=True)
        assert np.allclose(whole[0], pieces[0], atol=1e-6) and (whole[1] == pieces[1])[:-1].all()
