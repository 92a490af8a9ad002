"""What the perplexity band rejects: planted garbled and boilerplate texts, not clean ones; and its two edges."""

import random

from pyspark.sql import functions as F

from lumenframe.llm import quality_rules

SF = "/root/testdata/sf0.01"


def scrambled(rng, text, share):
    """The text with the letters of a share of its words in random order."""
    return " ".join("".join(rng.sample(w, len(w))) if rng.random() < share else w for w in text.split(" "))


def test_planted_texts_are_rejected_and_clean_ones_stay(spark):
    rng = random.Random(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    clean = docs.where("lang = 'en'").join(good, "doc_id").where(F.size(F.split("text", " ")) > 200).orderBy("doc_id").limit(40).collect()
    common = [r.w for r in docs.where("lang = 'en'").select(F.explode(F.split("text", " ")).alias("w")).where("w rlike '^[a-z]{2,}$'").groupBy("w").count().orderBy(F.desc("count"), "w").limit(40).collect()]
    rows = [(1_000_000 + i, scrambled(rng, r.text, 0.12), "en") for i, r in enumerate(clean[:20])]
    rows += [(2_000_000 + i, " ".join(rng.choice(common) for _ in range(300)), "en") for i in range(20)]
    out = {r.doc_id: r for r in quality_rules.judged(docs.unionByName(spark.createDataFrame(rows, docs.schema))).collect()}
    planted = [out[d] for d, _, _ in rows]
    assert not any(r.base_failed for r in planted)
    kept = lambda ids: sum(out[d].kept for d in ids)
    found = kept(range(1_000_000, 1_000_020)), kept(range(2_000_000, 2_000_020)), kept([r.doc_id for r in clean])
    assert found[0] <= 1 and found[1] <= 5 and found[2] >= 0.95 * len(clean), found
