"""The pipeline's near-duplicates go through op2's tree of fingerprints."""

import random

from pyspark.sql import functions as F

from sharemill.llm import simhash
from sharemill.llm.text import shingle_hashes, words


def test_the_tree_alone_finds_texts_within_its_radius(spark, monkeypatch):
    """Without bands, texts that are similar and within the radius, through others too, are still linked."""
    rng, texts = random.Random(11), []
    for _ in range(25):
        own = [f"w{rng.randrange(9000)}" for _ in range(900)]
        texts += [own, [*own[:450], "extra", *own[450:]], own[:-1], [f"z{k}" if k % 3 == 0 else w for k, w in enumerate(own)]]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(1000, ""), (1001, None)]
    sets = {k: shingle_hashes(words(t), 5) for k, t in rows}
    fps = {k: simhash.simhash(simhash.np.unique(h)) for k, h in sets.items()}
    sets = {k: set(h.tolist()) for k, h in sets.items()}

    def classes(linked):
        root = {k: k for k in sets}
        for a in sorted(root):
            for b in sorted(root):
                if a < b and root[a] != root[b] and linked(a, b):
                    low, high = sorted((root[a], root[b]))
                    root = {k: low if v == high else v for k, v in root.items()}
        return root

    near = classes(lambda a, b: ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 2)
    want = classes(lambda a, b: sets[a] == sets[b] or near[a] == near[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert 20 < len(sets) - len(set(want.values())) < 60
    monkeypatch.setattr(simhash, "by_bands", lambda texts: texts.select("rep", F.col("fp").alias("band")).where("false"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar(df).collect()} == want
