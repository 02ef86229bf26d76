import random

import corpus_pipeline
from graftline.llm import decontam, secrets, toxicity
from graftline.operators.stash import stash

WORDS = [f"{a}{b}{c}{d}" for a in "bdfgklm" for b in "aeiou" for c in ("na", "ri", "to", "lem", "shu") for d in ("", "x", "ky")]


def tables(tmp, spark):
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choices(WORDS, k=n))
    bench = [(i, prose(30)) for i in range(5)]
    rows, labels = [], []
    for i in range(400):
        t = prose(80)
        toxic = i % 5 == 0
        if toxic:
            t += " vilewordish scumword"
        if i % 2:
            labels.append((i, 1, int(toxic)))
        rows.append((i, t))
    rows += [(900, rows[1][1]), (901, rows[2][1] + " one more"), (902, prose(40) + " " + bench[2][1]), (903, prose(20) + " token=abcdefgh12"), (904, None), (905, ""), (906, ""), (None, prose(9)), (907, rows[3][1]), (907, rows[3][1]), (7, rows[7][1])]
    # Unrelated texts under one id, one of them a copy of another document's; the same without an id.
    rows += [(950, prose(60)), (950, prose(70)), (950, rows[4][1]), (None, prose(50)), (None, rows[6][1])]
    full = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp}/benchmark.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = tables(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stash(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        kept.append({(r.doc_id, r.text) for r in docs.collect()})
        if name == "near_duplicates":
            assert docs.filter("doc_id = 7").count() == 1 and docs.filter("doc_id = 950").count() >= 2
    toxic = {d for d, t in rows if t and "vilewordish" in t}
    assert kept[0] == {(d, t) for d, t in rows if d not in toxic}
    want = {(d, t) for d, t in kept[0] if d not in (900, 901, 907) and (d, t) not in ((950, rows[4][1]), (None, rows[6][1]))}
    assert kept[1] == want and len([t for d, t in want if d == 950]) == 2
    assert kept[2] == {(d, t) for d, t in want if d != 902}
    changed = {d for d, t in kept[3] if (d, t) not in kept[2]}
    assert changed == {903} and {d for d, _ in kept[3]} == {d for d, _ in kept[2]}
    assert next(t for d, t in kept[3] if d == 903).endswith("[SECRET]")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {}
    for r in pieces:
        ids[r.doc_id, r.doc_tokens] = ids.get((r.doc_id, r.doc_tokens), 0) + r.length
    assert {d for d, _ in ids} == {d for d, _ in kept[3]} and all(n % k == 0 for (_, k), n in ids.items())


def test_filters_agree_with_reports(spark, tmp_path):
    tables(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").filter("doc_id is not null")
    bench = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id for r in decontam.leaks(docs, bench).collect()}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in decontam.without_leaks(docs, bench).collect()} == found == {902}
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.severity(docs, model).filter("toxic").collect()}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in toxicity.without_toxic(docs, model).collect()} == toxic
    assert secrets.KINDS[0] == "assign"


def test_empty_and_odd_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows, bench in (("empty", [], []), ("odd", [(None, None, None, None, None), (1, None, None, None, None), (1, "x " * 40_000, None, None, None), (2, "a b c", None, "s", 5), (2, "a b c", None, "s", 5)], [(None, None), (1, "")])):
        at = str(tmp_path / name)
        odd = spark.createDataFrame([(*r, 1, "z", 2) for r in rows], schema + ", toxic int, component_id string, ids int")
        odd.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(None, None, None), (1, None, 0), (2, 1, None)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        pieces = corpus_pipeline.run(spark, at).collect()
        assert {r.doc_id for r in pieces} == ({None, 1, 2} if rows else set())
        assert sum(r.length for r in pieces if r.doc_id == 2) == (4 if rows else 0)
