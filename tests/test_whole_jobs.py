"""Queries that once did less than their whole job, on rows of their own."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from check_oracle import compare


def test_vector_integrity_has_every_check(spark, tmp_path):
    """Metadata and row counts are checked besides the vectors, and faults of the vectors themselves are found."""
    vecs = [np.full(64, 0.5, dtype=np.float32).tolist() for _ in range(2400)]
    vecs[1], vecs[2], vecs[3] = None, vecs[2][:-1] + [float("nan")], vecs[3][:-1] + [float("-inf")]
    vecs[4], vecs[19 * 5] = vecs[4][:60], vecs[0][:-1] + [float("nan")]
    table = pa.table({"vec_id": list(range(2400)), "embedding": pa.array(vecs, pa.list_(pa.float32())), "label": [0] * 2400})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    found = con.execute(entry.oracle_sql()["vector_integrity"])
    theirs = ([d[0] for d in found.description], found.fetchall())
    df = entry.queries()["vector_integrity"](spark, str(tmp_path))
    mine = [tuple(r) for r in df.collect()]
    assert compare((df.columns, mine), theirs) == "ok"
    counts, ids = dict(mine), [i for i in range(2400) if i % 50]
    assert set(counts) == {"missing", "missing_meta", "nan", "inf", "bad_rows", "bad_dim", "ok"}
    assert counts["missing"] == 48 + 1 and counts["missing_meta"] == sum(i % 41 == 0 for i in ids)
    assert counts["nan"] == sum(i % 41 != 0 and i % 31 == 0 for i in ids) + 2
