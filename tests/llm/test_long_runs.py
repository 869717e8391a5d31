"""Base spans where matches begin inside runs, and texts that are one long run."""

import random
import time

from test_archive_codec_search import base_spans

from finpanel.llm import pii


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = pii._base(pii._rows(docs, "doc_id", "text"), ["doc_id"]).select("doc_id", pii._public("base").alias("base")).collect()
    return {r.doc_id: r.base for r in rows}


def test_spans_of_drawn_strings(spark):
    """Runs that a match ends in, or fails behind: the contract's own patterns give the same spans."""
    dice = random.Random(4)
    texts = ["a@b.c_d@e.f", "a@b.c_d@e.f%g@h.i.j@k.l", "a@b_c@d.e", "@a.b", "a@@b.c", "a@b..c", "1.2.3.4.5.6.7.8", "999.1.2.3.4", "1.2.3.4@5.6", "a@1.2.3.4", "1..2.3.4.5"]
    texts += ["".join(dice.choice("ab@@..._-1 ") for _ in range(dice.randrange(2, 60))) for _ in range(1500)]
    texts += ["".join(dice.choice("12..5 @+-") for _ in range(dice.randrange(2, 60))) for _ in range(1500)]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        own = [(s.start, s.kind, s.stop) for s in got[i]]
        assert own == [tuple(x[:3]) for x in base_spans(t)], t


def test_a_megabyte_of_one_letter(spark):
    """Beside an address, in the class of each pattern: read once."""
    texts = [c * 1_000_000 + end for c, end in (("a", " x@y.zz"), ("1", " 1.2.3.4"), ("a-", "@"), ("1.", " x@y.zz"), ("+", " +123456789012"))]
    found(spark, ["warm up x@y.z 1.2.3.4"])
    began = time.perf_counter()
    got = found(spark, texts[:1] + texts[2:3])
    assert time.perf_counter() - began < 30
    assert [s.stop - s.start for s in got[0]] == [6]
    got = found(spark, texts[1:2])
    assert [(s.stop - s.start) for s in got[0] if s.kind == 1] == [7]
