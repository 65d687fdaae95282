"""The registered queries over whole tables: their columns, their SQL, and facts that hold for any input."""
import math
import zlib
from pathlib import Path

import duckdb
import pytest

from cellweave.llm import registry

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_pow2_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset bucket",
    "op2_crf_quality": "doc_id held_out score predicted lines bad_lines",
    "op3_url_template_tree": "page_id host path rule verdict template purity",
    "op4_secret_links": "doc_id n_assign n_access n_hex base_sha256 spans links",
    "op5_simhash_gph": "doc_id fingerprint component_id",
    "op6_warc_store": "page_id payload_bytes payload_digest record_type refers_to",
    "op7_pstable_embeddings": "vec_id n_links component_id kept",
    "op8_ftrl_langid": "doc_id held_out lang_pred score",
    "op9_pigeonhole_decontam": "doc_id item_id distance start end",
    "op10_license_scan": "doc_id line family score similarity start end",
}
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


def plain(rows):
    return sorted((tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, name):
    result = registry.queries()[name](spark, DATA)
    assert result.columns == COLUMNS[name].split()
    rows = result.collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    if name in registry.oracle_sql():
        db = duckdb.connect()
        for t in ("pages", "embeddings"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        found = db.sql(registry.oracle_sql()[name])
        assert found.columns == result.columns
        assert plain(rows) == plain(found.fetchall())
    if name in ("op2_crf_quality", "op4_secret_links", "op5_simhash_gph", "op8_ftrl_langid"):
        assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    if name in ("op2_crf_quality", "op8_ftrl_langid"):
        mod, left = (5, 0) if name.startswith("op2") else (3, 1)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == left) and 0 <= r["score"] <= 1 for r in rows)
    if name == "op2_crf_quality":
        assert all(r["predicted"] == int(r["score"] >= 0.3) and r["lines"] == (docs[r["doc_id"]] or "").count("\n") + 1 for r in rows)
    if name == "op1_pow2_packing":
        for doc in docs:
            mine = sorted((r["start"], r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] == doc)
            assert [s for s, _, _ in mine] == [sum(n for _, n, _ in mine[:i]) for i in range(len(mine))]
            assert sum(n for _, n, _ in mine) == mine[0][2] and all(n & (n - 1) == 0 and n <= 1024 for _, n, _ in mine)
        assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 and r["length"] == 2 ** r["bucket"] for r in rows)
