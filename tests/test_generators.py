import json

from pyspark.sql import functions as F

from paths import SF_SMALL
from matchbook.operators.generators import (OfflineIdealJobClient, build_reference_embeddings,
                                            generate_ideal_jobs, generate_keywords)
from matchbook.operators.embedding import ref_readiness
from matchbook.operators.textfilter import keyword_matches
from matchbook.plans import fixtures as fx


def test_ideal_jobs_alternate_languages(spark):
    prof = fx.profiles(spark, SF_SMALL).limit(3)
    rows = generate_ideal_jobs(prof).collect()
    assert len(rows) == 3 * 2 * 6
    for r in rows:
        assert r.lang == ("FR" if r.idx % 2 == 0 else "EN")
        assert r.field in ("title", "description") and r.text


def test_reference_embeddings_are_complete(spark):
    refs = build_reference_embeddings(fx.profiles(spark, SF_SMALL))
    ready = ref_readiness(refs).collect()
    assert len(ready) == 150 and all(r.ready for r in ready)
    r = refs.first()
    assert len(r.vec) == 64 and r.n_vectors == 3


def test_malformed_generator_reply_yields_no_texts(spark):
    prof = fx.profiles(spark, SF_SMALL).limit(2)
    bad = lambda prompts: ["{not json"] * len(prompts)
    assert generate_ideal_jobs(prof, bad).count() == 0


def test_generated_keywords_drive_the_filter(spark):
    prof = fx.profiles(spark, SF_SMALL).limit(5)
    kw = generate_keywords(prof)
    rows = kw.collect()
    assert len(rows) == 5 and all(len(r.what_or.split()) <= 25 for r in rows)
    docs = spark.createDataFrame([(1, "Customer household specialist, hands-on work"),
                                  (2, "nothing relevant")], "doc_id long, text string")
    hits = keyword_matches(docs, kw, "doc_id", "text").collect()
    assert {h.doc_id for h in hits} <= {1}
