"""The pipeline's stages on the smallest tables, against plain Python."""

import random
import re

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.keep_good(spark, docs, SF)
    assert kept.columns == P.COLUMNS
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    good = {i for i, q in labels.items() if q}
    assert len(good - ids) <= 0.03 * len(good)

    once = P.drop_near_copies(spark, kept.union(kept.limit(5)), SF)
    assert once.columns == P.COLUMNS
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in kept.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(lower))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                for x in group:
                    if group[x] in (a, b):
                        group[x] = min(a, b)
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(i for i in group if group[i] == i)

    clean = P.drop_contaminated(spark, once, SF)
    assert clean.columns == P.COLUMNS
    masked = P.mask_secrets(spark, clean, SF)
    assert masked.columns == P.COLUMNS and masked.count() == clean.count()
    assert masked.where("text rlike '(?i)token = \"[0-9a-f]{40}\"'").count() == 0
    out = P.tokenize(spark, masked, SF)
    assert out.count() == clean.count() and out.where("n_tokens <> size(ids)").count() == 0


def test_run_and_empty(spark, tmp_path):
    assert P.run(spark, SF).count() > 0
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing columns: each stage has a defined result."""
    from pyspark.sql import functions as F

    r = random.Random(4)
    words = "the of and to in is that for it as was with be by on not he this are or house river stone light".split()
    prose = lambda n: " ".join(r.choice(words) + str(r.randrange(60)) for _ in range(n)) + "."
    base = prose(80)
    rows = [(i, prose(60), "en", "s", 1) for i in range(40)] + [(100, None, None, None, None), (None, None, None, None, None), (101, "", "en", "s", 0), (102, prose(120_000), "en", "s", 5), (103, "x" * 400_000, "en", "s", 5)]
    rows += [(200, base, "en", "s", 9), (201, base + " end", None, None, None), (200, base, "en", "s", 9), (None, base + " end", "en", "s", 9), (202, base.upper(), "en", "s", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "digest", "spans", "item_set", "key", "_found", "_pieces", "ids", "node"):
        d = d.withColumn(c, F.lit("clash"))
    item = " ".join(rows[0][1].split(" ")[10:40])
    tables = {"documents": d, "labels": spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (1, None)], "doc_id long, quality int"), "benchmark": spark.createDataFrame([("a", item), (None, "x"), ("b", None), ("c", "")], "item_id string, text string")}
    for name, t in tables.items():
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    good = P.keep_good(spark, d, str(tmp_path))
    assert good.columns == P.COLUMNS and {x["doc_id"] for x in good.where("text is null or text = ''").collect()} in ({100, None, 101}, set())
    once = sorted(repr(tuple(x)) for x in P.drop_near_copies(spark, d, str(tmp_path)).collect())
    stay = [x for x in rows if x[1] is None or not x[1].lower().startswith(base)]
    # of the group the least doc_id's set stays, once though the row repeats
    assert once == sorted(map(repr, [*stay, rows[45]]))
    clean = {x["doc_id"]: x["text"] for x in P.drop_contaminated(spark, d, str(tmp_path)).collect() if x["doc_id"] is not None}
    assert 0 not in clean and clean[100] is None and len(clean[103]) == 400_000 and clean[1] == rows[1][1]
    assert P.mask_secrets(spark, d, str(tmp_path)).count() == len(rows)
    out = P.tokenize(spark, P.mask_secrets(spark, d, str(tmp_path)), str(tmp_path))
    assert out.count() == len(rows) and out.where("doc_id = 100 and n_tokens = 0").count() == 1
    assert P.run(spark, str(tmp_path)).count() > 0
