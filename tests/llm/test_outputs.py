"""Redacted texts and packed sequences."""

from __future__ import annotations

from types import SimpleNamespace

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vellum.llm import outputs
from vellum.llm.common import shared_dir

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def test_redacted(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.org, ip 10.0.0.1", "x"), (2, None, "y"), (3, "", "z"), (4, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ok', "w")], "doc_id long, text string, extra string")
    assert {r.doc_id: r.text for r in outputs.redacted(docs, outputs.pii_scan()).collect()} == {1: "mail [email], ip [ip]", 2: None, 3: "", 4: docs.collect()[3].text}
    assert {r.doc_id: r.text for r in outputs.redacted(docs, outputs.secret_scan(VOCAB)).collect()}[4] == '[assign]" ok'


def test_sequences(spark):
    library = Tokenizer.from_file(VOCAB)
    texts = [(k, "word " * (7 * k % 40)) for k in range(30)] + [(99, "a b c " * 40), (99, "a b c " * 40), (None, "no id")]
    got = outputs.sequences(spark.createDataFrame(texts, "doc_id long, text string"), VOCAB, depth=64).collect()
    want = [t for _, x in texts for t in [*library.encode(x, add_special_tokens=False).ids, 2]]
    assert all(len(r.ids) <= 64 for r in got) and sorted(t for r in got for t in r.ids) == sorted(want)


@pytest.mark.parametrize(("master", "refused"), [("spark://host:7077", True), ("yarn", True), ("local-cluster[2,1,1024]", True), ("local[2]", False)])
def test_a_cluster_needs_a_shared_folder(master, refused):
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=made.append)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: default))
    if refused:
        with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
            shared_dir(session)
    else:
        assert [shared_dir(session)] == made
    assert not (refused and made)


def test_a_worker_keeps_things_for_one_operator_only():
    from vellum.llm import common

    first = common.begun(lambda: (common.kept(("a",), list),))[0]
    assert common.begun(lambda: (common.kept(("a",), list),))[0] is first
    assert common.begun(None) == () and common.begun(lambda: (common.kept(("a",), list),))[0] is not first


def test_a_checkpoint_deletes_the_shuffle_files_that_led_to_it(spark):
    import time

    from pyspark.sql import functions as F

    from vellum.llm.common import CLEANUP, checkpointed
    from vellum.llm.components import components

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(found) if (n := f.getName()).startswith("shuffle_")}

    def gone(before):
        until = time.time() + 20
        while files() - before and time.time() < until:
            time.sleep(0.2)
        return not files() - before

    before, setting = files(), spark.conf.get(CLEANUP)
    rows = spark.range(5000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    kept = checkpointed(rows)
    chain = components(spark.range(50).select((F.col("id") + 1).alias("u"), F.col("id").alias("v")))
    assert gone(before)
    assert spark.conf.get(CLEANUP) == setting
    assert sorted(map(tuple, kept.collect())) == [(k, sum(range(k, 5000, 7))) for k in range(7)]
    assert sorted(map(tuple, chain.collect())) == [(k, 0) for k in range(1, 51)]
