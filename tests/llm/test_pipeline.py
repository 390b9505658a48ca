import zlib

import corpus_pipeline as cp
import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from weftline.llm import exact_dedup, near_dup, quality, queries


def test_stages(spark, sf_dir, small):
    """Each stage against what its operator says about its own input."""
    docs, kept = small, {}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema == small.schema
        kept[name] = out = spark.createDataFrame(out.collect(), small.schema)
        ids = sorted(r[0] for r in out.select("doc_id").collect())
        if name == "quality rules":
            assert ids == sorted(r["doc_id"] for r in quality.report(docs).where("kept").collect())
        elif name == "exact dedup":
            assert ids == sorted(r["doc_id"] for r in exact_dedup.dedup_report(docs).where("kept").collect())
        elif name == "near duplicates":
            assert ids == sorted(r["class_id"] for r in near_dup.near_report(docs).select("class_id").distinct().collect())
        else:
            assert set(ids) <= {r[0] for r in docs.select("doc_id").collect()}
        docs = out
    packed = cp.STAGES[-1][1](spark, docs, sf_dir).collect()
    loads = {}
    for r in packed:
        loads[r["sequence_id"]] = loads.get(r["sequence_id"], 0) + r["length"]
    assert max(loads.values()) <= 2048 and {r["doc_id"] for r in packed} == set(ids)


def test_run(spark, sf_dir):
    """The whole pipeline: the documents that SQL keeps and mixes, encoded whole by the tokenizer, cut and
    packed under both limits."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    con.sql(f"CREATE TABLE good AS SELECT d.* FROM documents d JOIN ({queries.ORACLES['op8_quality_rules']}) v USING (doc_id) WHERE v.kept")
    con.sql("CREATE TABLE single AS SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1")
    con.sql(f"CREATE TABLE apart AS SELECT * FROM single SEMI JOIN ({queries.near_sql('single')}) n ON single.doc_id = n.class_id")
    mixed = con.sql(f"WITH {queries.mixing_sql('apart')} SELECT doc_id, coalesce(text, '') FROM mixed").fetchall()
    sizes = [con.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in ("documents", "good", "single", "apart")]
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) > 2 and len(mixed) > len({i for i, _ in mixed})

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text in mixed:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, 2048 * k, len(x), zlib.crc32(x.tobytes())) for k, x in enumerate(np.split(ids, range(2048, len(ids), 2048)))]
    got = cp.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)

    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048 and len(pieces) <= 32
    least = max(-(-sum(n for *_, n, _ in want) // 2048), -(-len(want) // 32))
    assert len(sequences) <= 1.02 * least + 1


def test_odd(spark, odd, small, sf_dir):
    """Nulls, repeated rows, a long text and columns of clashing names through all stages, against each
    stage's brute force on what it gets."""
    from pyspark.sql import functions as F
    from tests.llm.test_near_dup import brute as near

    more = small.limit(60).select("*", F.lit(1).alias("Rid"), F.lit("d").alias("DIGEST"), F.lit(True).alias("kept"))
    docs = odd.union(more).union(more.limit(5)).union(more.limit(8).withColumn("doc_id", F.lit(None).cast("bigint"))).union(more.limit(8).withColumn("doc_id", F.col("doc_id") + 10**6))
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for name, stage in cp.STAGES[:-1]:
        rows, out = docs.collect(), stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        key = lambda i: (i is not None, i or 0)
        if name == "quality rules":
            verdict = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality.report(docs).collect()}
            want = [(r["doc_id"], r["text"]) for r in rows if verdict[r["doc_id"], len((r["text"] or "").encode().split())]]
            assert sorted(map(str, got)) == sorted(map(str, want)) and 0 < len(got) < len(rows)
        elif name == "exact dedup":
            best = {}
            for r in rows:
                best[r["text"]] = max(best.get(r["text"], None), r["doc_id"], key=key)
            assert sorted(map(str, got)) == sorted(str((i, t)) for t, i in best.items()) and len(got) < len(rows)
        elif name == "near duplicates":
            groups = {}
            for r, (_, g) in zip(rows, near([(r["doc_id"], r["text"]) for r in rows])):
                groups.setdefault(g, []).append(r["doc_id"])
            want = [min((i for i in v if i is not None), default=None) for v in groups.values()]
            assert sorted(map(str, (i for i, _ in got))) == sorted(map(str, want))
        docs = spark.createDataFrame(out.collect(), docs.schema)
    packed, loads, members = cp.STAGES[-1][1](spark, docs, sf_dir).collect(), {}, {}
    for r in packed:
        loads[r["sequence_id"]] = loads.get(r["sequence_id"], 0) + r["length"]
        members[r["sequence_id"]] = members.get(r["sequence_id"], 0) + 1
    assert packed and max(loads.values()) <= 2048 and max(members.values()) <= 32


def test_empty(spark, small):
    docs = small.limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
