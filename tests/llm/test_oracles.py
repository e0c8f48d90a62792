"""Text queries against their SQL twins."""

import pytest

from strideframe.llm import queries
from tests.compare import SF, connection, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duck_rows(connection(), queries.ORACLE_SQL[name])


def test_pii_terms(spark, tmp_path):
    """Disclosing terms, copies and long rows of spans, through both."""
    import random

    import duckdb

    rng = random.Random(1)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    texts = [f"{' '.join(rng.sample(filler, 5))} with Zebulon mail zeb@example.org {' '.join(rng.sample(filler, 5))}" for _ in range(6)]
    texts += [f"{' '.join(rng.sample(filler, 4))} 4111111111111111 Ärger {rng.choice(filler)} +1 234 567 8901" for _ in range(40)]
    texts += [f"{' '.join(rng.sample(filler, 9))} with mail" for _ in range(200)] + ["Quentin wrote once@example.org again"] * 20 + ["m@x.org word " * 90, None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = spark_rows(queries.QUERIES["op3_pii"](spark, str(tmp_path)))
    assert got == duck_rows(con, queries.ORACLE_SQL["op3_pii"])
    assert sum("term:" in r[got[0].index("spans")] for r in got[1]) >= 6
