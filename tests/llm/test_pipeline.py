import re

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tests.llm.conftest import SF
from tests.llm.test_brute import plain_classes, plain_lines
from ticketlake.llm import quality_rules


def test_names():
    names = entry.queries()
    assert "pipeline" in names
    assert all(sum(bool(re.match(f"op{n}_", x)) for x in names) == 1 for n in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    seen = [docs]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(path := str(tmp_path / name))
        seen.append(spark.read.parquet(path))
        if k < len(pipeline.STAGES) - 1:
            assert seen[-1].columns == docs.columns
    rows = [{r.doc_id: r for r in x.collect()} for x in seen]
    kept = {r.doc_id for r in quality_rules.assess(
        docs, quality_rules.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where("kept").collect()}
    assert set(rows[1]) == kept
    assert {d: r.text for d, r in rows[2].items()} == plain_lines(sorted((d, r.text) for d, r in rows[1].items()))
    ids = sorted(rows[2])
    root, _ = plain_classes([rows[2][d].text for d in ids])
    assert set(rows[3]) == {ids[r] for r in root}
    assert set(rows[4]) < set(rows[3]) and set(rows[5]) == set(rows[4])
    whole = {r.doc_id: r.ids_sha256 for r in pipeline.run(spark, SF).collect()}
    assert whole == {d: r.ids_sha256 for d, r in rows[5].items()}
