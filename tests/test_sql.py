"""Queries against their SQL on rows that the given tables do not have."""

import duckdb

from courierlens.plans import ORACLE_SQL, QUERIES


def both(spark, folder, name, **tables):
    """Sorted rows of the query and of its SQL over tables (rows, schema)."""
    c = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = QUERIES[name](spark, str(folder))
    return sorted(map(tuple, df.collect())), sorted(c.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall())


def test_engines_that_contradict_themselves_discount_nothing(spark, tmp_path):
    lines = [(1, 2, 1, 1, 0.05, 0.02, 1.0), (1, 4, 1, 1, 0.1, 0.0, 1.0), (1, 4, 1, 2, 0.0, 0.0, 1.0), (2, 2, 1, 1, 0.05, 0.02, 1.0), (2, 4, 1, 1, 0.1, 0.0, 1.0)]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_discount double, l_tax double, l_quantity double"
    found, want = both(spark, tmp_path, "correlation_discount", lineitem=(lines, schema))
    assert found == want and [r[:2] for r in found] == [(1, 1), (2, 1), (2, 3)] and found[0][4] == 0.1


def test_message_ids_whose_capitals_are_several_letters(spark, tmp_path):
    rows = [(1, 1, "user", "Straße"), (2, 3, "assistant", "straße"), (3, 3, "system", "STRASSE"), (4, 1, "user", "ﬁn"), (5, 3, "tool", "fin"), (6, 3, "tool", "ﬁn"), (7, 1, "user", "ẞ")]
    found, want = both(spark, tmp_path, "message_dedup", conversations=(rows, "conv_id long, turn int, role string, text string"))
    assert found == want == [("assistant", 1), ("tool", 1), ("user", 3)]


def test_scan_of_odd_texts(spark, tmp_path):
    texts = [
        "黑龙江省大兴安盟", "朝阳路12号 4111\t1111\u30001111\u00a01111", "DEUTDEFF500 PROVIDED SOFTWARE PASSDEFF", "现病史 家族病史", "start_longitude=116.4074 经度116.4074E 39.9042,116.4074", "oauth_code: 998877\x0b9", "x京A12345京B12345 LSVAU2180N2183294",
        "验证码：4567 otp 1234", "验证码：582931", "土地证号：京国用字第二号", "pa\u017f\u017fword: hunter22", "&#x34;111-1111-1111-1111 &#000000052;111111111111111 &#xD800; &#9999999;", " ".join(f"E1234567{i}" for i in range(9)), "", None,
    ]
    found, want = both(spark, tmp_path, "dlp_scan", documents=([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert found == want and any(len(r[3]) == 9 for r in found)
